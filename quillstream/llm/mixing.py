"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets. The budget is shared by weight; a source whose share exceeds ``max_epochs`` times its size is clamped
there, and the excess goes to the others by weight until none is above. The fixed point is found in one pass: with
sources in order of cap / weight, the clamped ones are a prefix, so running sums of caps and of weights give the
level. Sources are ordered in ranges (``operators.ranks``), so there may be as many as there are hosts.

Sampling. A source that needs r repetitions gives each document floor(r) whole ones. The rest of its target is
dealt out in a seeded order of its documents: one more whole repetition each until the target is met; the one
document at the border gives the words that are still missing (``whole=False``), or all or none of its words,
whichever is nearer (``whole=True``). The border is found from sums over seeded buckets of each source, first 4096
and then 4096 within the one at the border, so documents are only ever ordered within one of 16 million buckets of
a source; nothing is dropped, and a source that holds a third of all rows costs no more than others.

Cases. Null text: no words. Null source: a source of its own, last in order. Sources without words: target 0.
Documents that tie in the seeded order (of id and text) are ordered by size; equal rows are interchangeable, and those
at the border come to one task. Very long texts count whole. Empty table: no rows. Extra columns pass through,
whatever their names, but those named as the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranks
from .common import WORD, nested, text_or_empty, unnested, written

ADDED = ["size", "source_size", "target", "taken"]


def n_words(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """``sources`` (weight, source_size, ...; a written table) with target: min(cap, level x weight)."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ratios = sources.groupBy((cap / F.col("weight")).alias("ratio")).agg(F.sum(cap).alias("caps"), F.sum("weight").alias("weights"))
    total = sources.agg(F.sum("weight")).first()[0] or 0.0
    level = (F.lit(budget) - (F.col("caps_upto") - F.col("caps"))) / (F.lit(total) - (F.col("weights_upto") - F.col("weights")))
    run = ranks.running(ratios, "ratio", ["caps", "weights"], ranks.bounds_of(ratios, "ratio")).withColumn("level", level)
    # Null where all sources are clamped.
    found = run.where("level <= ratio").agg(F.min_by("level", "ratio")).first()[0]
    return sources.withColumn("target", cap if found is None else F.least(cap, F.lit(found) * F.col("weight")))


def _border(buckets: DataFrame, upto: DataFrame, start: Column) -> DataFrame:
    """(_key, bucket, before): of each source the bucket of words in which ``rest`` is reached, and the words before."""
    running = Window.partitionBy("_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    met = buckets.join(upto, "_key").withColumn("before", start + F.coalesce(F.sum("words").over(running), F.lit(0)))
    return met.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("_key", "bucket", "before")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, whole: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and taken (words, repeats counted).

    Sources in code-point order, null last, weigh ``weights`` in turn; the budget is ``share`` of all sizes.
    """
    # Null comes after all others.
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_or_empty().cast("binary"))).cast("binary"))
    keyed = nested(docs, docs.columns, key.alias("_key"), order.alias("_order"), F.substring(order, 1, 6).alias("_bucket"), F.col("doc_id").alias("_id"), text_or_empty().alias("_text"))
    size = n_words(F.col("_text"))
    fine = written(keyed.groupBy("_key", "_bucket").agg(F.sum(size).alias("words")), "buckets")
    sizes = fine.groupBy("_key").agg(F.sum("words").alias("source_size"))
    in_turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    sources = written(ranks.running(sizes, "_key", [], ranks.bounds_of(sizes, "_key")).select("_key", "source_size", in_turn.alias("weight")), "sources")
    budget = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0)).cast("long")
    targets = water_fill(sources, budget, max_epochs).withColumn("times", times).withColumn("rest", F.greatest(F.round(F.col("target") - F.col("times") * F.col("source_size")), F.lit(0)).cast("long"))
    targets = written(targets.select("_key", "source_size", "target", "times", "rest"), "targets")
    coarse = fine.groupBy("_key", F.substring("_bucket", 1, 3).alias("bucket")).agg(F.sum("words").alias("words"))
    first = written(_border(coarse, targets.select("_key", "rest"), F.lit(0)).select("_key", F.col("bucket").alias("near"), F.col("before").alias("start")), "borders")
    within = fine.join(first, (fine["_key"] == first["_key"]) & (F.substring("_bucket", 1, 3) == F.col("near"))).select(fine["_key"], F.col("_bucket").alias("bucket"), "words")
    edge = _border(within, targets.join(first, "_key").select("_key", "rest", "start"), F.col("start"))
    told = written(targets.join(edge.withColumnRenamed("bucket", "edge"), "_key", "left"), "told")

    placed = keyed.join(told, "_key", "left")
    at_edge = F.coalesce(F.col("_bucket") == F.col("edge"), F.lit(False))
    inside = Window.partitionBy("_key").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, -1)
    missing = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.least(F.greatest(missing, F.lit(0)), F.col("size"))
    if whole:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    border = placed.where(at_edge).withColumn("size", size).withColumn("more", part)
    # Before the border all of a document once more; where there is no border, rest is nothing or all of the source.
    before = F.when(F.col("edge").isNotNull(), F.col("_bucket") < F.col("edge")).otherwise(F.col("rest") > 0)
    others = placed.where(~at_edge).withColumn("size", size).withColumn("more", F.when(before, F.col("size")).otherwise(F.lit(0)))
    taken = (F.col("times") * F.col("size") + F.col("more")).cast("long")
    both = others.unionByName(border).select("_keep", "size", "source_size", "target", taken.alias("taken"))
    return unnested(both, docs.columns, ADDED)
