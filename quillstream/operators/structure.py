"""Outline of documents given as ordered blocks, and assessable words by section.

One exchange by document serves all windows here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def walk(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, section_idx, level, title, text): a row with null text announces a section.

    The cover page, contents sections, captions and everything from the first end heading on are left out; a
    document without headings is one section ``(no headings)``.
    """
    doc = Window.partitionBy("doc_id")
    upto = doc.orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = blocks.select("doc_id", "block_idx", T.is_heading(F.col("style")).alias("heading"), T.heading_level(F.col("style")).alias("own"), T.strip(F.col("text")).alias("t"))
    marked = marked.withColumn("opens", F.col("heading") & (F.col("t") != "")).withColumn("ends", F.col("heading") & F.lower("t").isin(*T.END_HEADINGS))
    filled = marked.select(
        "*",
        F.max("ends").over(upto).alias("ended"),
        (~F.max("heading").over(doc)).alias("whole"),
        F.last(F.when(F.col("opens"), F.struct(F.col("own").alias("level"), F.col("t").alias("title"))), ignorenulls=True).over(upto).alias("head"),
        F.sum(F.col("opens").cast("int")).over(upto).alias("section_idx"),
    )
    skipped = F.coalesce(F.lower(F.col("head.title")).isin(*T.SKIP_SECTIONS), F.lit(False))
    body = ~F.col("heading") & (F.col("t") != "") & (F.col("head").isNotNull() | F.col("whole")) & ~skipped & ~T.is_caption(F.col("t"))
    return filled.where(~F.col("ended") & (F.col("opens") | body)).select(
        "doc_id",
        "block_idx",
        F.col("section_idx").cast("int").alias("section_idx"),
        F.coalesce("head.level", F.lit(1)).alias("level"),
        F.coalesce("head.title", F.lit("(no headings)")).alias("title"),
        F.when(~F.col("opens"), F.col("t")).alias("text"),
    )


def own_words(walked: DataFrame) -> DataFrame:
    """Own words of each occurrence of a section, in order."""
    n = F.sum(F.coalesce(T.assessed_words(F.col("text")), F.lit(0)))
    return walked.groupBy("doc_id", "section_idx").agg(F.first("level").alias("level"), F.first("title").alias("title"), n.cast("long").alias("own_words"))


def _rolled(sections: Column) -> Column:
    """Sections of a document, in order, with words: own and all deeper ones' until one of the same level or above.

    One fold from the last section on: for each level the words since the last section of a lower one, which is what
    a section above them adds to its own.
    """
    empty = "cast(array() as array<struct<level:int,n:bigint>>)"
    step = """(a, s) -> named_struct(
        'open', concat(filter(a.open, e -> e.level < s.level), array(named_struct('level', s.level, 'n',
            s.own_words + aggregate(filter(a.open, e -> e.level >= s.level), 0L, (x, e) -> x + e.n)))),
        'words', concat(array(s.own_words + aggregate(filter(a.open, e -> e.level > s.level), 0L, (x, e) -> x + e.n)), a.words))"""
    fold = F.expr(f"aggregate(reverse(_sections), named_struct('open', {empty}, 'words', cast(array() as array<bigint>)), {step}, a -> a.words)")
    return F.zip_with(sections, fold, lambda s, n: F.struct(s["section_idx"], s["level"], s["title"], s["own_words"], n.alias("words")))


def _by_document(sections: DataFrame) -> DataFrame:
    return sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section_idx", F.col("level").cast("int").alias("level"), "title", "own_words"))).alias("_sections"))


def rolled_up(sections: DataFrame) -> DataFrame:
    """Adds words: own and all deeper sections'. Sections without words go."""
    return _by_document(sections).select("doc_id", F.inline(_rolled(F.col("_sections")))).where("words > 0")


def count_report(blocks: DataFrame, limit: int | None = None) -> DataFrame:
    """One row a document: sections, total, limit and over, and the same as JSON with its null keys."""
    each = _by_document(own_words(walk(blocks)))
    told = each.select("doc_id", F.filter(_rolled(F.col("_sections")), lambda s: s["words"] > 0).alias("s"), F.aggregate("_sections", F.lit(0).cast("long"), lambda a, s: a + s["own_words"]).alias("total"))
    sections = F.coalesce(F.transform("s", lambda x: F.struct(x["title"], x["words"], x["level"])), F.array().cast("array<struct<title:string,words:bigint,level:int>>"))
    out = blocks.select("doc_id").distinct().join(told, "doc_id", "left").select("doc_id", sections.alias("sections"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.lit(limit).cast("long").alias("limit"))
    out = out.withColumn("over", F.col("total") - F.col("limit"))
    return out.withColumn("json", F.to_json(F.struct("sections", "total", "limit", "over"), {"ignoreNullFields": "false"}))


def shares(sections: DataFrame) -> DataFrame:
    """Each section's share of its document's words, with a bar."""
    total = F.sum("own_words").over(Window.partitionBy("doc_id"))
    share = F.when(total > 0, F.col("words") / total).otherwise(F.lit(0.0))
    return sections.withColumn("share", share).withColumn("bar", T.bar(F.col("share")))


def prose(blocks: DataFrame) -> DataFrame:
    """(doc_id, text, words): the walked texts joined by blank lines, and their raw words."""
    said = walk(blocks).where("text is not null")
    joined = said.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return joined.withColumn("words", T.word_count(F.col("text")))
