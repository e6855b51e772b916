"""How much scanning changes scores: pairing scanned with clean paragraphs, and the paired differences.

Pairing is greedy in the scanned paragraphs' order, so it runs group by group; a group is one source, which is a
document, never the corpus.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks

LEAST_SIMILAR = 0.80


def ratio(clean: str, scanned: str) -> float:
    return SequenceMatcher(None, clean, scanned).ratio()


def pair_up(scanned: DataFrame, clean: DataFrame) -> DataFrame:
    """(source, scan_idx, ocr, clean, similarity): each scanned paragraph's best clean one not yet used, 0.80 at least."""

    def match(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        pool = right.sort_values("clean_idx")
        for _, s in left.sort_values("scan_idx").iterrows():
            best, at = 0.0, None
            for i, text in zip(pool["clean_idx"], pool["clean"], strict=True):
                if i in used:
                    continue
                m = SequenceMatcher(None, text, s["ocr"])
                if m.real_quick_ratio() <= best or m.quick_ratio() <= best:
                    continue
                r = m.ratio()
                if r > best:
                    best, at = r, (i, text)
            if at is not None and best >= LEAST_SIMILAR:
                used.add(at[0])
                out.append((key[0], s["scan_idx"], s["ocr"], at[1], best))
        return pd.DataFrame(out, columns=["source", "scan_idx", "ocr", "clean", "similarity"])

    return scanned.groupBy("source").cogroup(clean.groupBy("source")).applyInPandas(match, "source string, scan_idx int, ocr string, clean string, similarity double")


def error_rates(pairs: DataFrame) -> DataFrame:
    """Adds error: the share of characters in which a pair differs."""
    return pairs.withColumn("error", 1 - F.col("similarity"))


def error_summary(pairs: DataFrame) -> DataFrame:
    """n pairs, and the upper median and worst of the character error rates; one row."""
    rates = error_rates(pairs)
    middle = F.broadcast(ranks.upper_middle(rates, "error").select(F.col("value").alias("median_error")))
    return rates.agg(F.count("*").alias("n"), F.max("error").alias("worst_error")).crossJoin(middle).select("n", "median_error", "worst_error")


def bias_summary(scores: DataFrame) -> DataFrame:
    """Of paired scores (clean, ocr): means, mean difference, and how many are lower and higher when scanned."""
    d = F.col("ocr") - F.col("clean")
    return scores.agg(F.count("*").alias("n"), F.avg("clean").alias("clean_mean"), F.avg("ocr").alias("ocr_mean"), F.avg(d).alias("mean_delta"), F.count_if(d > 0).alias("higher"), F.count_if(d < 0).alias("lower"))
