"""From documents to token ids, in five stages that each hand on a table of documents.

``STAGES`` lists them in order as (name, function); a function takes (spark, docs, sf_dir) and all but the last
return the columns of their input. ``run`` applies them to the documents table, writing each stage's rows to the
shared folder, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import mixing, ngram_join, pieces, quality, secrets
from quillstream.llm.common import read, written


def _whole(docs: DataFrame) -> DataFrame:
    """All columns in one, so that no other name can clash with a stage's own, beside those that stages read."""
    return docs.select(F.struct(*docs.columns).alias("_document"), "doc_id", "text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from the votes on all of ``docs``.

    Null and empty texts, and texts without words, go; a score of exactly the threshold stays. Repeated rows have one
    score and stay or go together. Very long texts are read whole. Empty table: none. All columns pass, whatever
    their names.
    """
    model = quality.fit(docs)
    return quality.score(_whole(docs), ["_document"], model).where("kept").select("_document.*")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each cluster of near duplicates: the one with the smallest id, then text hash.

    Null and empty texts, texts without words and rows without id are in no cluster and stay. Of repeated rows of one
    id and text one stays, the first by a hash of all columns. Different texts of one id are told apart. Empty table:
    none. All columns pass, whatever their names.
    """
    hashes = [F.xxhash64(F.lit(k), docs["text"]) for k in (1, 2)]
    found = written(ngram_join.similar(docs.select("doc_id", "text", *[h.alias(f"t{k}") for k, h in enumerate(hashes)]), keep=("t0", "t1")), "similar")
    row = F.struct("doc_id", "t0", "t1")
    firsts = written(found.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n"), F.min(row).alias("first")).where("n > 1"), "firsts")
    placed = found.join(firsts, "cluster").select("doc_id", "t0", "t1", (row == F.col("first")).alias("is_first"))
    dropped = written(placed.where("not is_first").select("doc_id", "t0", "t1").distinct(), "dropped")
    repeated = written(placed.where("is_first").groupBy("doc_id", "t0", "t1").count().where("count > 1").drop("count"), "repeated")
    same = lambda other: (docs["doc_id"] == other["doc_id"]) & (hashes[0] == other["t0"]) & (hashes[1] == other["t1"])
    # Shuffled at every size: what is dropped grows with the documents, so there is no bound to broadcast it under.
    kept = docs.join(dropped.hint("shuffle_hash"), same(dropped), "left_anti")
    if repeated.isEmpty():
        return kept
    again = docs.join(repeated.hint("shuffle_hash"), same(repeated), "left_semi").select(F.struct(*docs.columns).alias("row"), "doc_id", *[h.alias(f"_{k}") for k, h in enumerate(hashes)])
    one = again.groupBy("doc_id", "_0", "_1").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")).select("row.*")
    return kept.join(repeated.hint("shuffle_hash"), same(repeated), "left_anti").unionByName(one)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with marks in place of its secrets; n_chars follows the text where there is one.

    Null and empty texts have no secrets and pass as they are, as do all rows without any. Of secrets that overlap
    one mark, the first one's, stands for all. Repeated rows stay repeated. Very long texts are read whole. Empty
    table: none. Other columns pass, whatever their names.
    """
    found = secrets.scan(_whole(docs), ["_document"], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, redacted=True)
    text = F.when(F.col("spans") != "", F.col("redacted")).otherwise(F.col("_document.text"))
    new = {"text": text, "n_chars": F.when(F.col("spans") != "", F.char_length("redacted").cast("long")).otherwise(F.col("_document.n_chars"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"_document.`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them: the sources' shares of 150 % of all words.

    Null, empty and blank texts have no words, so none are taken. A null source is one of its own, last in order.
    Documents that tie in the seeded order are ordered by id and size; repeated rows are documents of their own. Very
    long texts count whole. Empty table: none. All columns pass, whatever their names.
    """
    mixed = mixing.mix(docs.select(F.struct(*docs.columns).alias("_document"), "doc_id", "text", "source"), whole=True)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    return mixed.select("_document", F.explode(F.array_repeat(F.lit(0), times))).select("_document.*")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids with the end's, starts and ends: each id's bytes in the document's text.

    One row for each row. Null and empty texts: the end's id alone. Repeated rows give repeated results. Very long
    texts are encoded whole. Empty table: none. Other columns go.
    """
    coded = pieces.encode(docs.select("doc_id", "source", "text"), ["doc_id", "source"], public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends")


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_join", keep_first),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]
#: Trained models, hashing and a tokenizer are not for SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
