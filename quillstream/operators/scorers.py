"""Scorers: a table of (id, text) in, a table of (id, score) out.

``PairScorer`` keeps the formula of a two-model ratio, a performer's mean log loss over an observer's cross log
loss, with models that are counted here: a smoothed bigram and a smoothed unigram model of words. It is a stand-in:
thresholds fitted for neural models do not apply to it, so it is always calibrated afresh. ``LinearHead`` is the
last layer of a classifier over embeddings. ``logits_scores`` does the arithmetic on logits from any model.
Scores are directional and never evidence of who wrote a text.
"""

from __future__ import annotations

from functools import cached_property
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import pairs


class Scorer(Protocol):
    #: 1 if a high score means machine-like, -1 if a low one does
    direction: int

    def score(self, texts: DataFrame) -> DataFrame:
        """(id, score) for texts (id, text)."""
        ...


def _words(texts: DataFrame, keep: list[str]) -> DataFrame:
    return texts.select(*keep, T.tokens(F.lower("text")).alias("ws"))


def _bigrams(texts: DataFrame, keep: list[str]) -> DataFrame:
    """Word pairs; a text without any has one row of nulls."""
    pairs = F.arrays_zip(F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 1, F.lit(0))).alias("w"), F.slice("ws", F.lit(2), F.size("ws")).alias("v"))
    # Outer, as the planner would otherwise cut the text once more to see that there are pairs.
    return _words(texts, keep).select(*keep, F.inline_outer(pairs).alias("w", "v"))


def _occurrences(texts: DataFrame, keep: list[str]) -> DataFrame:
    """Words, with whether one follows them (first) and whether one precedes them (second)."""
    each = _words(texts, keep).select(*keep, F.size("ws").alias("_n"), F.posexplode_outer("ws").alias("_i", "word")).where("_i is not null and _n > 1")
    return each.select(*keep, "word", (F.col("_i") < F.col("_n") - 1).cast("int").alias("first"), (F.col("_i") > 0).cast("int").alias("second"))


def _least(counts: list[tuple[int, int]], most: int) -> int:
    """The least n such that at most ``most`` have n or more, of (n, how many have n)."""
    least = None
    for n, many in sorted(counts, reverse=True):
        most -= many
        if most < 0:
            return n + 1
        least = n
    return least or 1


class PairScorer:
    """Ratio of mean losses: -log p(v | w) by a smoothed bigram model over -log q(v) by a smoothed unigram model.

    The most frequent words and pairs are looked up where the text is, without moving it; all others are joined. Which
    ones are frequent is found in a sample, their counts are of the whole corpus, so this changes no result.
    """

    direction = -1
    #: Words and pairs that are broadcast, and one in how many texts is read to find such pairs.
    HOT_WORDS, HOT_PAIRS, SAMPLE = 1 << 17, 1 << 18, 16

    def __init__(self, corpus: DataFrame):
        self.corpus = corpus.select("text")

    @cached_property
    def _fit(self) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """Words (word, n_w, n_v), kept; the frequent ones; frequent pairs (w, v, t), t the log of n_wv + q; q's divisor."""
        spark = self.corpus.sparkSession
        words = _occurrences(self.corpus, []).groupBy("word").agg(F.sum("first").alias("n_w"), F.sum("second").alias("n_v")).persist()
        sizes = words.groupBy(F.greatest("n_w", "n_v").alias("n")).agg(F.count("*").alias("many"), F.sum("n_v").alias("total"), F.count_if(F.col("n_v") > 0).alias("vocabulary")).collect()
        divisor = sum(r["total"] + r["vocabulary"] for r in sizes) + 1
        often = words.where(F.greatest("n_w", "n_v") >= _least([(r["n"], r["many"]) for r in sizes], self.HOT_WORDS))

        # The pairs' names go through the driver, so that every branch has the same ones; rand, so that copies of a text part.
        sample = _bigrams(self.corpus.where(F.rand(7) * self.SAMPLE < 1), []).where("w is not null").groupBy("w", "v").agg(F.count("*").alias("n")).where("n > 1").persist()
        many = [(r["n"], r["many"]) for r in sample.groupBy("n").agg(F.count("*").alias("many")).collect()]
        names = spark.createDataFrame(sample.where(F.col("n") >= _least(many, self.HOT_PAIRS)).select("w", "v").toArrow(), "w string, v string")
        sample.unpersist()
        counted = _bigrams(self.corpus, []).join(F.broadcast(names), ["w", "v"], "left_semi").groupBy("w", "v").agg(F.count("*").alias("n_wv"))
        pairs = F.broadcast(counted).join(words, F.col("v") == F.col("word")).select("w", "v", F.log(F.col("n_wv") + (F.col("n_v") + 1) / divisor).alias("t")).persist()
        return words, often, pairs, divisor

    def sums(self, texts: DataFrame) -> DataFrame:
        """(id, a, b) of each text: both models' losses, summed over its word pairs; 0 and 0 without any."""
        words, often, pairs, divisor = self._fit
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        q = (zero("n_v") + 1) / F.lit(divisor)
        of = lambda role, *keep: F.broadcast(often.select(F.col("word").alias(role), *keep))
        said, paired = _bigrams(texts, ["id"]), F.col("w").isNotNull()

        # The losses are a = log(n_w + 1) - log(n_wv + q) and b = -log(q); each part is added where its count is known.
        near = said.join(F.broadcast(pairs), ["w", "v"], "left").join(of("w", "n_w"), "w", "left").join(of("v", "n_v"), "v", "left")
        known = F.coalesce(F.log(F.col("n_w") + 1), F.lit(0.0)) - F.coalesce("t", F.lit(0.0))
        parts = near.select("id", known.alias("a"), F.when(F.col("n_v").isNotNull(), -F.log(q)).otherwise(F.lit(0.0)).alias("b"))

        rare = _occurrences(texts, ["id"]).join(of("word"), "word", "left_anti").join(words, "word", "left")
        parts = parts.unionByName(rare.select("id", (F.col("first") * F.log(zero("n_w") + 1)).alias("a"), (F.col("second") * -F.log(q)).alias("b")))

        left = said.where(paired).join(F.broadcast(pairs.select("w", "v")), ["w", "v"], "left_anti")
        pair = F.concat_ws(" ", "w", "v").alias("pair")  # one string is narrower, and no word has a space
        asked = left.join(of("v", "n_v"), "v").select("id", pair, "n_v")
        asked = asked.unionByName(left.join(of("v"), "v", "left_anti").join(words.select(F.col("word").alias("v"), "n_v"), "v", "left").select("id", pair, "n_v"))
        if texts.select("text").sameSemantics(self.corpus):
            # The texts' own pairs are the counts: they move once.
            met = asked.withColumn("n_wv", F.count("*").over(Window.partitionBy("pair")))
        else:
            counts = _bigrams(self.corpus, []).where(paired).join(F.broadcast(pairs.select("w", "v")), ["w", "v"], "left_anti").groupBy(pair).agg(F.count("*").alias("n_wv"))
            met = asked.join(counts, "pair", "left")
        parts = parts.unionByName(met.select("id", (-F.log(zero("n_wv") + q)).alias("a"), F.lit(0.0).alias("b")))
        return parts.groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    def losses(self, docs: DataFrame, prose: Column, cut: Column, width: int, stride: int) -> DataFrame:
        """The same sums of all sentences' paragraphs and windows of ``docs`` (doc_id, text), see ``pairs``."""
        return pairs.losses_of_sentences(docs, self.corpus, prose, cut, width, stride)

    #: Scorers of the same base read the same sums.
    base = property(lambda self: self)

    def of_sums(self, a: Column, b: Column) -> Column:
        """The score by a text's sums; null without word pairs."""
        return F.when(b > 0, a / b)

    def score(self, texts: DataFrame) -> DataFrame:
        return self.sums(texts).where("b > 0").select("id", self.of_sums(F.col("a"), F.col("b")).alias("score"))


class Flipped:
    """A scorer of which low is bad turned to 0..1 with high bad: how far below 1.3 times the threshold a score is."""

    direction = 1

    def __init__(self, scorer: Scorer, threshold: float = 0.9):
        self.scorer, self.threshold = scorer, threshold

    #: None where the scorer does not add up sums.
    base = property(lambda self: getattr(self.scorer, "base", None))

    def of_sums(self, a: Column, b: Column) -> Column:
        score = self.scorer.of_sums(a, b)
        return F.when(score.isNotNull(), T.aiish(score, F.lit(self.threshold)))

    def score(self, texts: DataFrame) -> DataFrame:
        return self.scorer.score(texts).select("id", T.aiish(F.col("score"), F.lit(self.threshold)).alias("score"))


class LinearHead:
    """Sigmoid of a dot product: the head of a classifier over pooled embeddings (id, embedding)."""

    direction = 1

    def __init__(self, weights: list[float], bias: float = 0.0):
        self.weights, self.bias = weights, bias

    def score(self, vectors: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(float(x)) for x in self.weights])
        dot = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return vectors.select("id", (1 / (1 + F.exp(-(dot + self.bias)))).alias("score"))


def pooled(tokens: DataFrame) -> DataFrame:
    """Masked mean of token vectors: (id, hidden array<array<double>>, mask array<int>) to (id, embedding)."""
    total = F.greatest(F.aggregate("mask", F.lit(0.0), lambda a, x: a + x), F.lit(1e-9))
    masked = F.zip_with("hidden", "mask", lambda h, m: F.transform(h, lambda x: x * m))
    first = F.transform(F.get("hidden", F.lit(0)), lambda x: x * 0.0)
    return tokens.select("id", F.transform(F.aggregate(masked, first, lambda a, h: F.zip_with(a, h, lambda x, y: x + y)), lambda x: x / total).alias("embedding"))


def _log_softmax(row):
    top = F.array_max(row)
    norm = F.log(F.aggregate(F.transform(row, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)) + top
    return F.transform(F.array(norm), lambda n: F.transform(row, lambda x: x - n))


def logits_scores(rows: DataFrame) -> DataFrame:
    """(id, perplexity, cross_perplexity, score) of (id, ids array<int>, performer, observer array<array<double>>).

    Mean next-token loss of the performer; mean over all places of the observer's cross entropy with the performer;
    their ratio.
    """
    n = F.size("ids")
    losses = F.transform(F.sequence(F.lit(0), n - 2), lambda i: -F.get(F.get(_log_softmax(F.get("performer", i)), F.lit(0)), F.get("ids", i + 1)))

    def cross(p, o):
        log_p, log_o = F.get(_log_softmax(p), F.lit(0)), F.get(_log_softmax(o), F.lit(0))
        return -F.aggregate(F.zip_with(log_o, log_p, lambda a, b: F.exp(a) * b), F.lit(0.0), lambda a, x: a + x)

    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    out = rows.select("id", F.when(n > 1, mean(losses)).alias("perplexity"), mean(F.zip_with("performer", "observer", cross)).alias("cross_perplexity"))
    return out.withColumn("score", F.col("perplexity") / F.col("cross_perplexity"))


class FunctionScorer:
    """Any Python model: ``load`` is called once a worker and gives a function from texts to scores.

    Filter rows before it: it is a map over partitions, which the optimiser neither duplicates nor pushes filters
    through.
    """

    def __init__(self, load, direction: int = 1):
        self.load, self.direction = load, direction

    def score(self, texts: DataFrame) -> DataFrame:
        load = self.load

        def work(frames):
            model = load()
            for frame in frames:
                yield pd.DataFrame({"id": frame["id"], "score": [float(x) for x in model(frame["text"].tolist())]})

        kind = texts.schema["id"].dataType.simpleString()
        return texts.select("id", "text").mapInPandas(work, f"id {kind}, score double")


class PooledHead:
    """Texts to (id, score): hidden states from ``encode``, masked mean pooling, a linear head and a sigmoid.

    ``encode`` is called once a worker and gives a function from texts to (hidden states, mask), arrays of shape
    (texts, places, width) and (texts, places), cut to ``max_places``. Pooling and head are this class's own.
    """

    direction = 1

    def __init__(self, encode, weights: list[float], bias: float = 0.0, max_places: int = 768):
        self.encode, self.weights, self.bias, self.max_places = encode, weights, bias, max_places

    def score(self, texts: DataFrame) -> DataFrame:
        encode, weights, bias, most = self.encode, self.weights, self.bias, self.max_places

        def load():
            import numpy as np

            run = encode()

            def scores(batch: list[str]) -> list[float]:
                if not batch:
                    return []
                hidden, mask = (np.asarray(x, float)[:, :most] for x in run(batch))
                pooled_ = (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1e-9)[:, None]
                return (1 / (1 + np.exp(-(pooled_ @ np.asarray(weights, float) + bias)))).tolist()

            return scores

        return FunctionScorer(load).score(texts)


#: (observer, performer) pairs of causal models that share a tokenizer, by the name a record is kept under: for the
#: usual backend, and for the quantised one. Fixed values.
MODEL_PAIRS = {
    "small": ("Qwen/Qwen2.5-0.5B", "Qwen/Qwen2.5-0.5B-Instruct"),
    "big": ("Qwen/Qwen2.5-1.5B", "Qwen/Qwen2.5-1.5B-Instruct"),
    "gemma": ("google/gemma-4-E2B", "google/gemma-4-E2B-it"),
    "gemma+": ("google/gemma-4-E4B", "google/gemma-4-E4B-it"),
}
QUANTISED_PAIRS = {
    "gemma": ("google/gemma-4-E2B", "mlx-community/gemma-4-e2b-it-qat-OptiQ-4bit"),
    "gemma+": ("google/gemma-4-E4B", "mlx-community/gemma-4-e4b-it-qat-OptiQ-4bit"),
}


def neural_pair(observer: str, performer: str, max_places: int = 1024) -> FunctionScorer:
    """The ratio of losses by two causal models from local files, over at most ``max_places`` tokens of a text.

    Needs torch and transformers, and says so where they are missing. Low is machine-like.
    """

    def load():
        try:
            import torch
            from transformers import AutoModelForCausalLM, AutoTokenizer
        except ImportError as e:
            raise RuntimeError("this scorer needs torch and transformers, which are not installed") from e
        names = AutoTokenizer.from_pretrained(performer)
        models = [AutoModelForCausalLM.from_pretrained(path).eval() for path in (observer, performer)]

        def one(text: str) -> float:
            ids = names(text, truncation=True, max_length=max_places, return_tensors="pt").input_ids
            if ids.shape[1] < 2:
                return float("nan")
            with torch.no_grad():
                watched, played = (torch.log_softmax(m(ids).logits[0].float(), dim=-1) for m in models)
            loss = -played[:-1].gather(1, ids[0, 1:, None]).mean()
            return float(loss / -(watched.exp() * played).sum(dim=-1).mean())

        return lambda texts: [one(t) for t in texts]

    return FunctionScorer(load, -1)


def transformer(path: str) -> FunctionScorer:
    """A sequence classifier from local files; needs torch and transformers, and says so where they are missing."""

    def load():
        try:
            import torch
            from transformers import AutoModelForSequenceClassification, AutoTokenizer
        except ImportError as e:
            raise RuntimeError("this scorer needs torch and transformers, which are not installed") from e
        names, model = AutoTokenizer.from_pretrained(path), AutoModelForSequenceClassification.from_pretrained(path)

        def run(texts):
            with torch.no_grad():
                return torch.sigmoid(model(**names(texts, padding=True, truncation=True, max_length=768, return_tensors="pt")).logits[:, -1]).tolist()

        return run

    return FunctionScorer(load)
