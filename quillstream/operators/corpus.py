"""Samples from scanned pages: lines, running text, paragraphs, body, picks and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranks

# Results depend on these.
SAME_LINE, HEADER_Y, FOOTER_Y, PARAGRAPH_GAP, SHORT_LINE = 0.008, 0.93, 0.07, 1.5, 0.85
PICK_MIN, PICK_MAX = 60, 160
TITLE_SKIP = ("50 excellent extended essays", "international baccalaureate", "©")
POSITIONS = ("introduction", "analysis", "conclusion")


def lines(runs: DataFrame) -> DataFrame:
    """(essay, page, line_idx, y, left, right, width, text): runs within a line's height of its first run."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("ny"), "x", "run_idx", "text", "w")))
    pages = runs.groupBy("essay", "page").agg(ordered.alias("r"))
    fold = f"""aggregate(r, cast(array() as array<struct<y:double,p:array<struct<x:double,t:string,w:double>>>>), (a, q) ->
        if(size(a) > 0 and abs(element_at(a, -1).y + q.ny) < {SAME_LINE}D,
           concat(slice(a, 1, size(a) - 1), array(named_struct('y', element_at(a, -1).y, 'p', concat(element_at(a, -1).p, array(named_struct('x', q.x, 't', q.text, 'w', q.w)))))),
           concat(a, array(named_struct('y', -q.ny, 'p', array(named_struct('x', q.x, 't', q.text, 'w', q.w)))))))"""
    each = pages.select("essay", "page", F.posexplode(F.expr(fold)).alias("line_idx", "l"))
    parts = F.col("l.p")
    left, right = F.array_min(F.transform(parts, lambda p: p["x"])), F.array_max(F.transform(parts, lambda p: p["x"] + p["w"]))
    said = F.array_join(F.transform(F.array_sort(F.transform(parts, lambda p: F.struct(p["x"].alias("x"), p["t"].alias("t")))), lambda p: p["t"]), " ")
    return each.select("essay", "page", "line_idx", F.col("l.y").alias("y"), left.alias("left"), right.alias("right"), (right - left).alias("width"), said.alias("text"))


def _key(text):
    return F.lower(T.flat(text))


def running_text(page_lines: DataFrame) -> DataFrame:
    """(essay, key, text): lines in the margins that stand on a third of the pages, two at least."""
    pages = page_lines.groupBy("essay").agg(F.count_distinct("page").alias("pages"))
    margin = page_lines.where((F.col("y") > HEADER_Y) | (F.col("y") < FOOTER_Y)).withColumn("key", _key(F.col("text"))).where(F.length("key") > 8)
    said = F.min_by(T.flat(F.col("text")), F.struct("page", "line_idx"))
    counts = margin.groupBy("essay", "key").agg(F.count("*").alias("n"), said.alias("text"))
    return counts.join(pages, "essay").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 3))).select("essay", "key", "text")


def titles(running: DataFrame) -> DataFrame:
    """(essay, title): the longest running line that is no series name; of equal lengths the first in order."""
    plain = running
    for skip in TITLE_SKIP:
        plain = plain.where(~F.contains("key", F.lit(skip)))
    return plain.groupBy("essay").agg(F.min_by("text", F.struct((-F.length("key")).alias("l"), "key")).alias("title"))


def _joined(parts):
    """Lines as one string; a hyphen at a line's end goes with the break."""
    kept = F.filter(F.transform(parts, lambda t: T.strip(t)), lambda t: t != "")
    return T.flat(F.replace(F.replace(F.array_join(kept, "\u0001"), F.lit("-\u0001"), F.lit("")), F.lit("\u0001"), F.lit(" ")))


def paragraphs(page_lines: DataFrame, running: DataFrame) -> DataFrame:
    """(essay, para_idx, text): body paragraphs, joined over page breaks where a page ends on a full line."""
    body = page_lines.where((F.col("y") <= HEADER_Y) & (F.col("y") >= FOOTER_Y)).withColumn("key", _key(F.col("text"))).join(running.select("essay", "key"), ["essay", "key"], "left_anti")
    page = Window.partitionBy("essay", "page")
    at = page.orderBy("line_idx")
    step = body.withColumn("before_y", F.lag("y").over(at)).withColumn("before_w", F.lag("width").over(at)).withColumn("gap", F.abs(F.col("before_y") - F.col("y")))
    sized = step.withColumn("step", F.coalesce(F.median("gap").over(page), F.lit(0.03))).withColumn("measure", F.median("width").over(page))
    breaks = F.col("before_y").isNotNull() & ((F.col("gap") > PARAGRAPH_GAP * F.col("step")) | (F.col("before_w") < SHORT_LINE * F.col("measure")))
    last = F.last("width").over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) >= SHORT_LINE * F.col("measure")
    numbered = sized.withColumn("part", F.sum(breaks.cast("int")).over(at)).withColumn("tail_full", last)
    each = numbered.groupBy("essay", "page", "part").agg(F.sort_array(F.collect_list(F.struct("line_idx", "text"))).alias("l"), F.first("tail_full").alias("tail_full"))
    each = each.select("essay", "page", "part", _joined(F.transform("l", lambda x: x["text"])).alias("text"), "tail_full")
    order = Window.partitionBy("essay").orderBy("page", "part")
    carried = F.coalesce((F.col("part") == 0) & F.lag("tail_full").over(order), F.lit(False))
    grouped = each.withColumn("new", (~carried).cast("int")).withColumn("para_idx", F.sum("new").over(order) - 1)
    return grouped.groupBy("essay", "para_idx").agg(_joined(F.transform(F.sort_array(F.collect_list(F.struct("page", "part", "text"))), lambda x: x["text"])).alias("text"))


def body_slice(paras: DataFrame) -> DataFrame:
    """Paragraphs after the last introduction heading of the first 40 and before the first end heading after it."""
    doc = Window.partitionBy("essay")
    n = F.count("*").over(doc)
    intro = F.max(F.when((F.col("para_idx") < 40) & T.is_heading_line(F.col("text"), ("introduction",)), F.col("para_idx") + 1)).over(doc)
    a = paras.withColumn("n", n).withColumn("start", F.coalesce(intro, F.least(F.lit(6), F.floor(F.col("n") / 6))))
    end = F.min(F.when((F.col("para_idx") >= F.col("start")) & T.is_heading_line(F.col("text"), T.END_HEADINGS), F.col("para_idx"))).over(doc)
    b = a.withColumn("end", F.coalesce(end, F.col("n")))
    b = b.withColumn("end", F.when(F.col("end") - F.col("start") < 5, F.col("n")).otherwise(F.col("end")))
    return b.where("para_idx >= start and para_idx < end").select("essay", (F.col("para_idx") - F.col("start")).alias("para_idx"), "text")


def pick(paras: DataFrame, per_essay: int = 3) -> DataFrame:
    """(essay, slot, position, para_idx, text): the least damaged usable paragraph of each part of a body."""
    t, n_words = F.col("text"), T.word_count(F.col("text"))
    usable = paras.where(n_words.between(PICK_MIN, PICK_MAX) & t.rlike('^["“A-Z]') & t.rlike(f"[.!?][{T.PICK_CLOSERS}]?\\z"))
    doc = Window.partitionBy("essay")
    u = usable.withColumn("k", F.row_number().over(doc.orderBy("para_idx")) - 1).withColumn("n", F.count("*").over(doc)).withColumn("damage", T.damage(t)).withColumn("words", n_words)
    slots = u.select("*", F.explode(F.sequence(F.lit(0), F.lit(per_essay - 1))).alias("slot"))
    low, high = F.floor(F.col("slot") * F.col("n") / per_essay), F.floor((F.col("slot") + 1) * F.col("n") / per_essay)
    slots = slots.where(((F.col("k") >= low) & (F.col("k") < high)) | (low >= high))
    best = Window.partitionBy("essay", "slot").orderBy("damage", F.desc("words"), "para_idx")
    first = slots.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    once = first.withColumn("_o", F.row_number().over(Window.partitionBy("essay", "para_idx").orderBy("slot"))).where("_o = 1")
    return once.select("essay", "slot", F.get(F.array(*[F.lit(p) for p in POSITIONS]), F.least(F.floor(F.col("slot") * len(POSITIONS) / per_essay), F.lit(len(POSITIONS) - 1)).cast("int")).alias("position"), "para_idx", "text")


def changed_by_strip(samples: DataFrame) -> DataFrame:
    """Samples (sample_id, text) that the footnote rules would change; known-clean ones must give no row."""
    return samples.where(T.strip_markers(T.flat(F.col("text"))) != T.flat(F.col("text"))).select("sample_id")


def human_manifest(picked: DataFrame, sources: DataFrame, prefix: str) -> DataFrame:
    """Manifest rows of picks; ``sources``: essay, subject, topic, source_url, date_evidence, extraction."""
    ids = ranks.running(picked.select("essay").distinct(), "essay", []).select("essay", (F.col("idx") + 1).alias("nth"))
    letter = F.char(F.lit(97) + F.col("slot"))
    return picked.join(ids, "essay").join(sources, "essay", "left").select(
        F.concat(F.lit(prefix), F.lpad(F.col("nth").cast("string"), F.greatest(F.length(F.col("nth").cast("string")), F.lit(2)), F.lit("0")), letter).alias("id"),
        F.col("essay").alias("source_essay"),
        "position",
        F.col("para_idx").cast("int").alias("paragraph_index"),
        "subject",
        "topic",
        "source_url",
        "date_evidence",
        "extraction",
        F.sha2("text", 256).alias("sha256"),
        T.word_count(F.col("text")).cast("int").alias("words"),
        "text",
    )
