"""The operators' queries over the test tables: ``QUERIES`` and, where SQL can say the same, ``ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, language, lm_scoring, media, mixing, ngram_join, pieces, pii, quality, secrets
from .common import read, text_or_empty, written

#: The others have trained models, seeded hashes or a tokenizer; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS o FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM s GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][k % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM g),
r AS (SELECT cap / weight AS ratio, sum(cap) AS caps, sum(weight) AS weights FROM w GROUP BY 1),
a AS (SELECT sum(source_size) * CAST(1.5 AS DOUBLE) AS budget, sum(weight) AS all_weights FROM w),
v AS (SELECT ratio, (budget - (sum(caps) OVER (ORDER BY ratio) - caps)) / (all_weights - (sum(weights) OVER (ORDER BY ratio) - weights)) AS level FROM r, a),
l AS (SELECT arg_min(level, ratio) AS level FROM v WHERE level <= ratio),
t AS (SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM w, l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS times FROM t),
e AS (SELECT *, greatest(CAST(round(target - times * source_size) AS BIGINT), 0) AS rest FROM n),
b AS (SELECT s.*, source_size, target, times, rest - coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missing FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(times * size + least(greatest(missing, 0), size) AS BIGINT) AS taken FROM b""",
}


def fold(m: int) -> Column:
    """crc32 of doc_id as text, mod m (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % m


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (fold(7) == 2).alias("held_out"))
    return lm_scoring.score(docs, docs.where(~F.col("held_out")), ["doc_id", "held_out"])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, ["doc_id"], quality.fit(docs))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold(4) == 2).alias("held_out"))
    return language.predict(docs, ["doc_id", "held_out"], language.fit(docs.where(~F.col("held_out"))))


def page_of(text: Column, digest: Column, n_bytes: Column) -> Column:
    """A document as a page: a paragraph a line, and after the first one a figure of its payload with a caption."""
    safe = text
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(mark), F.lit(name))
    part = F.split(safe, "\n", 2)
    rest = F.replace(F.coalesce(F.get(part, F.lit(1)), F.lit("")), F.lit("\n"), F.lit("<p>"))
    return F.concat(F.lit("<html><head><title>A document</title><body><p>"), F.get(part, F.lit(0)), F.lit("<figure><figcaption>"), n_bytes.cast("string"), F.lit(" bytes</figcaption><img src='sha256:"), digest, F.lit("'></figure><p>"), rest)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is a payload, and a page whose paragraphs are its lines, with a figure that refers to the payload.

    n_items counts the page's items; runs_sha256 is the digest of its runs of text joined by line feeds.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"), F.octet_length(text_or_empty().cast("binary")).cast("long").alias("n_bytes"), media.payload(F.col("text")).alias("payload"))
    files = written(media.stored(docs), "media")
    page = page_of(F.col("text"), F.sha2("payload", 256), F.col("n_bytes"))
    seqs = media.sequences(docs.select("doc_id", "n_bytes", page.alias("html")), ["doc_id", "n_bytes"])
    runs = F.array_join(F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"]), "\n")
    # Texts are digested where they are read; only references move.
    refs = seqs.select("doc_id", "n_bytes", F.size("items").alias("n_items"), F.sha2(runs.cast("binary"), 256).alias("runs_sha256"), F.filter("items", lambda x: x["kind"] == "media").alias("items"))
    # Written, so that both sides of the join are plain exchanges and a digest that many documents share is split.
    facts = written(media.features(files), "features")
    items = media.resolved(refs, ["doc_id", "n_bytes", "n_items", "runs_sha256"], facts)
    return items.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "runs_sha256")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(read(spark, sf_dir, "documents"), ["doc_id"], model)
    # Pieces follow each other without gaps, so they cover what lies between the first start and the last end.
    covered = F.element_at("ends", -1) - F.element_at("starts", 1)
    digests = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), covered.cast("long").alias("covered_bytes"), "ids")
    back = pieces.decode(digests, ["doc_id", "n_tokens", "ids_sha256", "covered_bytes"], model)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "covered_bytes")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key="example key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_mixing": op2_mixing,
    "op3_secret_scan": op3_secret_scan,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_quality": op5_quality,
    "op6_ngram_join": op6_ngram_join,
    "op7_language_id": op7_language_id,
    "op8_media_columns": op8_media_columns,
    "op9_pieces": op9_pieces,
    "op10_pii": op10_pii,
}
