"""Sentences, overlapping windows of a count of sentences, verdicts and runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

WIDTH, STRIDE = 7, 3
RED, AMBER = 0.5, 0.35
CLEAN_, AMBER_, RED_ = 0, 1, 2


def _prose(text: Column, sep: str, min_words: int) -> Column:
    """Prose paragraphs of a text, in order."""
    return F.filter(F.transform(F.split(text, f"\\Q{sep}\\E", -1), T.strip), lambda p: T.is_prose(p, min_words))


def paragraphs(docs: DataFrame, sep: str = "\n\n", min_words: int = T.MIN_PROSE_WORDS) -> DataFrame:
    """(doc_id, para_idx, text): prose paragraphs of ``docs`` (doc_id, text), numbered among those kept. No shuffle."""
    # Outer, as the planner would otherwise compute the array once more to see that it is not empty.
    return docs.select("doc_id", F.posexplode_outer(_prose(F.col("text"), sep, min_words)).alias("para_idx", "text")).where("para_idx is not null")


def _sentence_array(text: Column, sep: str, min_words: int) -> Column:
    return F.flatten(F.transform(_prose(text, sep, min_words), lambda p, i: F.transform(T.sentences(p), lambda s: F.struct(i.alias("para_idx"), s.alias("sentence")))))


def cut(docs: DataFrame, sep: str = "\n\n", min_words: int = T.MIN_PROSE_WORDS) -> DataFrame:
    """(doc_id, cut): each text's sentences as an array of (para_idx, sentence). No shuffle."""
    return docs.select("doc_id", _sentence_array(F.col("text"), sep, min_words).alias("cut"))


def sentences_of(docs: DataFrame, sep: str = "\n\n", min_words: int = T.MIN_PROSE_WORDS) -> DataFrame:
    """(doc_id, sent_idx, n_sents, para_idx, sentence) of ``docs`` (doc_id, text; one row a document). No shuffle."""
    counted = cut(docs, sep, min_words).select("doc_id", "cut", F.size("cut").cast("long").alias("n_sents"))
    each = counted.select("doc_id", "n_sents", F.posexplode_outer("cut").alias("sent_idx", "_x")).where("sent_idx is not null")
    return each.select("doc_id", "sent_idx", "n_sents", "_x.para_idx", "_x.sentence")


def document_sentences(paras: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, n_sents, para_idx, sentence) of a table of paragraphs, numbered over the document."""
    each = paras.select("doc_id", "para_idx", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    doc = Window.partitionBy("doc_id")
    return each.select("doc_id", (F.row_number().over(doc.orderBy("para_idx", "pos")) - 1).alias("sent_idx"), F.count("*").over(doc).alias("n_sents"), "para_idx", "sentence")


def _last_window(n: Column) -> Column:
    return F.when(n <= WIDTH, 0).otherwise(F.ceil((n - WIDTH) / STRIDE)).cast("int")


def windows(sents: DataFrame) -> DataFrame:
    """(doc_id, win_idx, start, end, chunk): half-open ranges and their sentences joined by a space.

    Of a table of sentences, in the one exchange by document that numbered them.
    """
    ahead = Window.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(0, WIDTH - 1)
    chunk = F.array_join(F.collect_list("sentence").over(ahead), " ")
    start, n = F.col("sent_idx"), F.col("n_sents")
    each = sents.select("doc_id", "n_sents", "sent_idx", chunk.alias("chunk")).where((start % STRIDE == 0) & (start / STRIDE <= _last_window(n)))
    return each.select("doc_id", (start / STRIDE).cast("int").alias("win_idx"), start.alias("start"), F.least(start + WIDTH, n).cast("int").alias("end"), "chunk")


def _windows_of_cut(texts: DataFrame) -> DataFrame:
    said = texts.select("doc_id", F.transform("cut", lambda x: x["sentence"]).alias("_s"))
    n = F.size("_s")
    one = lambda w: F.struct(w.alias("win_idx"), (w * STRIDE).alias("start"), F.least(w * STRIDE + WIDTH, n).alias("end"), F.array_join(F.slice("_s", w * STRIDE + 1, F.lit(WIDTH)), " ").alias("chunk"))
    every = F.when(n > 0, F.transform(F.sequence(F.lit(0), _last_window(n)), one))
    return said.select("doc_id", F.inline_outer(every)).where("win_idx is not null")


def windows_of(docs: DataFrame, sep: str = "\n\n", min_words: int = T.MIN_PROSE_WORDS) -> DataFrame:
    """(doc_id, win_idx, start, end, chunk) of ``docs`` (doc_id, text; one row a document). No shuffle."""
    return _windows_of_cut(cut(docs, sep, min_words))


def scored_sentences(docs: DataFrame, score: Callable[[DataFrame], DataFrame], sep: str = "\n\n", min_words: int = T.MIN_PROSE_WORDS) -> DataFrame:
    """(doc_id, sent_idx, n_sents, para_idx, sentence, score): each sentence with the largest of its windows' scores.

    ``score`` makes (doc_id, win_idx, score) of windows. Texts are cut once and move once, by document, in an exchange
    that both the windows and the sentences read; scores come back as a document's array.
    """
    texts = cut(docs, sep, min_words).repartition("doc_id")
    scores = score(_windows_of_cut(texts)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("win_idx", "score"))).alias("_w"))
    met = texts.join(scores, "doc_id", "left").select("doc_id", "cut", F.coalesce("_w", F.array().cast(scores.schema["_w"].dataType)).alias("_w"), F.size("cut").cast("long").alias("n_sents"))
    # Where every window has its score, those over a sentence are found by place.
    whole = F.size("_w") == _last_window(F.col("n_sents")) + 1

    def worst(i: Column) -> Column:
        low = F.greatest(F.lit(0), F.ceil((i - (WIDTH - 1)) / STRIDE)).cast("int")
        high = F.floor(i / STRIDE).cast("int")
        over = F.when(whole, F.slice("_w", low + 1, F.greatest(high - low + 1, F.lit(0)))).otherwise(F.filter("_w", lambda x: (x["win_idx"] >= low) & (x["win_idx"] <= high)))
        return F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(over, lambda x: x["score"])), F.lit(0.0)))

    told = F.transform("cut", lambda x, i: F.struct(x["para_idx"].alias("para_idx"), x["sentence"].alias("sentence"), worst(i).alias("score")))
    each = met.select("doc_id", "n_sents", F.posexplode_outer(told).alias("sent_idx", "_x")).where("sent_idx is not null")
    return each.select("doc_id", "sent_idx", "n_sents", "_x.para_idx", "_x.sentence", "_x.score")


def summed_sentences(docs: DataFrame, losses: Callable[[DataFrame, Column, Column, int, int], DataFrame], window_score: Callable[[Column, Column], Column], sep: str = "\n\n") -> DataFrame:
    """As ``scored_sentences``, and with the sums of the sentence's paragraph: (..., score, a, b, words).

    ``losses`` makes a document's sums by sentence and window (``PairScorer.losses``); ``window_score`` makes a score of a
    window's sums (null: none). Every word pair is asked for once, though windows overlap and paragraphs hold the same
    sentences.
    """
    text = F.col("text")
    told = losses(docs, _prose(text, sep, 0), _sentence_array(text, sep, 0), WIDTH, STRIDE)
    met = told.withColumn("_w", F.transform(F.arrays_zip("wa", "wb"), lambda x: window_score(x["wa"], x["wb"])))

    def worst(i: Column) -> Column:
        low = F.greatest(F.lit(0), F.ceil((i - (WIDTH - 1)) / STRIDE)).cast("int")
        over = F.slice("_w", low + 1, F.greatest(F.floor(i / STRIDE).cast("int") - low + 1, F.lit(0)))
        return F.greatest(F.lit(0.0), F.coalesce(F.array_max(over), F.lit(0.0)))

    by = F.arrays_zip("para", "sentence", "a", "b", "words")
    own = F.transform(by, lambda x, i: F.struct(x["para"].alias("para_idx"), x["sentence"].alias("sentence"), worst(i).alias("score"), x["a"].alias("a"), x["b"].alias("b"), x["words"].alias("words")))
    each = met.select("doc_id", F.size("sentence").cast("long").alias("n_sents"), F.posexplode_outer(own).alias("sent_idx", "_x")).where("sent_idx is not null")
    return each.select("doc_id", "sent_idx", "n_sents", "_x.*")


def sentence_scores(sents: DataFrame, window_scores: DataFrame) -> DataFrame:
    """Adds score: the largest of the windows that cover the sentence, 0 at least.

    Scores go to the sentences by number; texts move once, to meet them.
    """
    first = F.col("win_idx") * STRIDE
    covered = window_scores.select("doc_id", F.explode(F.sequence(first, first + WIDTH - 1)).alias("sent_idx"), "score").groupBy("doc_id", "sent_idx").agg(F.max("score").alias("_score"))
    met = sents.join(covered, ["doc_id", "sent_idx"], "left")
    return met.select("doc_id", "sent_idx", *[c for c in sents.columns if c not in ("doc_id", "sent_idx", "score")], F.greatest(F.lit(0.0), F.coalesce("_score", F.lit(0.0))).alias("score"))


def summary(scores: DataFrame, flagged: Column) -> DataFrame:
    """(doc_id, n, mean, flagged): how many paragraphs were scored, their mean, and how many are ``flagged``.

    Paragraphs that were not scored (null) count for nothing.
    """
    return scores.where("score is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.count_if(flagged).alias("flagged"))


def severity(score: Column, red: float = RED, amber: float = AMBER) -> Column:
    """High is bad: red from ``red``, amber from ``amber``."""
    return F.when(score >= red, RED_).when(score >= amber, AMBER_).otherwise(CLEAN_)


def low_severity(score: Column, threshold: Column, amber: Column) -> Column:
    """Low is bad: red below ``threshold``, amber below ``amber`` (null: none)."""
    return F.when(score < threshold, RED_).when(score < amber, AMBER_).otherwise(CLEAN_)


def worse(a: Column, b: Column) -> Column:
    return F.greatest(F.coalesce(a, F.lit(CLEAN_)), F.coalesce(b, F.lit(CLEAN_)))


def status(sev: Column) -> Column:
    return F.element_at(F.array(F.lit("clean"), F.lit("amber"), F.lit("red")), sev + 1)


def flagged_runs(sents: DataFrame) -> DataFrame:
    """(doc_id, start, end, severity, score): runs of sentences that are not clean, with the worst of each."""
    upto = Window.partitionBy("doc_id").orderBy("sent_idx")
    island = F.sum((F.col("severity") == CLEAN_).cast("int")).over(upto)
    marked = sents.withColumn("_island", island).where(F.col("severity") > CLEAN_)
    return marked.groupBy("doc_id", "_island").agg(F.min("sent_idx").alias("start"), (F.max("sent_idx") + 1).alias("end"), F.max("severity").alias("severity"), F.max("score").alias("score")).drop("_island")


def word_shares(sents: DataFrame) -> DataFrame:
    """(doc_id, words, red_words, amber_words, red_share, amber_share)."""
    n = T.word_count(F.col("sentence"))
    of = lambda s: F.sum(F.when(F.col("severity") == s, n).otherwise(0))
    out = sents.groupBy("doc_id").agg(F.sum(n).alias("words"), of(RED_).alias("red_words"), of(AMBER_).alias("amber_words"))
    share = lambda c: F.when(F.col("words") > 0, F.col(c) / F.col("words")).otherwise(F.lit(0.0))
    return out.withColumn("red_share", share("red_words")).withColumn("amber_share", share("amber_words"))
