"""Running sums and ranks over all rows of a table without gathering them in one task.

Rows are parted into ranges at the values of about ``RANGES`` of them, chosen by a hash, and ranges are summed; what
is ordered in one task is a range, and what one task sees of all ranges is a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def bounds_of(rows: DataFrame, by: str) -> list:
    """About ``RANGES`` of the values of ``by`` (distinct in ``rows``), in order; computed now. Each is as likely."""
    every = max(1, -(-rows.count() // RANGES))
    return sorted(r[0] for r in rows.where(F.pmod(F.xxhash64(F.lit(31), by), F.lit(every)) == 0).select(by).collect())


def running(rows: DataFrame, by: str, sums: list[str], bounds: list | None = None) -> DataFrame:
    """``rows`` (distinct in ``by``) with idx (from 0), ``<s>_upto`` (running sum, own included), before and after.

    before and after are the neighbours' values of ``by``, null at the ends. ``bounds``: those of ``bounds_of``, or
    else they are found within the query.
    """
    if bounds is None:
        # One row: the bounds of the ranges, as in ``bounds_of``.
        n = F.broadcast(rows.agg(F.count("*").alias("_n")))
        chosen = rows.select(by).crossJoin(n).where(F.pmod(F.xxhash64(F.lit(31), by), F.greatest(F.lit(1), F.ceil(F.col("_n") / RANGES))) == 0)
        known = rows.crossJoin(F.broadcast(chosen.agg(F.array_sort(F.collect_list(by)).alias("_bounds"))))
    else:
        known = rows.withColumn("_bounds", F.array(*[F.lit(b) for b in bounds]).cast(f"array<{rows.schema[by].dataType.simpleString()}>"))
    parted = known.withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(by)))).drop("_bounds")
    ranges = parted.groupBy("_range").agg(F.count("*").alias("_n"), F.min(by).alias("_low"), F.max(by).alias("_high"), *[F.sum(s).alias(f"_{s}") for s in sums])
    # A row a range.
    order = Window.orderBy("_range")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_range", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", *sums)], F.lag("_high").over(order).alias("_prev"), F.lead("_low").over(order).alias("_next"))
    own = Window.partitionBy("_range").orderBy(by)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    return parted.join(F.broadcast(offsets), "_range").select(
        *rows.columns,
        (F.col("_n") + F.row_number().over(own) - 1).cast("long").alias("idx"),
        *[(F.col(f"_{s}") + F.sum(s).over(upto)).alias(f"{s}_upto") for s in sums],
        F.coalesce(F.lag(by).over(own), F.col("_prev")).alias("before"),
        F.coalesce(F.lead(by).over(own), F.col("_next")).alias("after"),
    )


def nearest_rank(values: DataFrame, column: str, share: float) -> DataFrame:
    """One row, value: the element at int(share * (n - 1)) of the sorted values; null if there are none."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("k"))
    total = F.broadcast(counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")))
    return running(counts, "value", ["k"]).crossJoin(total).where(F.col("k_upto") > F.floor(F.lit(share) * (F.col("n") - 1))).agg(F.min("value").alias("value"))


def upper_middle(values: DataFrame, column: str) -> DataFrame:
    """One row, value: the element at n // 2 of the sorted values; null if there are none."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("k"))
    total = F.broadcast(counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")))
    return running(counts, "value", ["k"]).crossJoin(total).where(F.col("k_upto") > F.floor(F.col("n") / 2)).agg(F.min("value").alias("value"))


def largest_within(spans: DataFrame, items: DataFrame, low: str, high: str, idx: str, value: str) -> DataFrame:
    """``spans`` with ``value``: the largest of the items whose ``idx`` is from ``low`` to ``high``; empty ones go.

    Items are summed to blocks of 1, 2, 4, ... neighbours, and a span is made of at most two blocks of each size: the
    work grows with the number of rows and the logarithm of the span, and no item is copied for a span.
    """
    sizes = F.sequence(F.lit(0), F.lit(40))
    top = F.broadcast(items.agg(F.coalesce(F.ceil(F.log2(F.max(idx) + 1)), F.lit(0)).cast("int").alias("_top")))
    each = items.crossJoin(top).select(F.explode(F.sequence(F.lit(0), "_top")).alias("_size"), idx, value)
    blocks = each.groupBy("_size", F.expr(f"shiftright({idx}, _size)").alias("_block")).agg(F.max(value).alias(value))
    block = lambda size, at: F.struct(size.cast("int").alias("_size"), at.cast("long").alias("_block"))
    start = F.struct(F.col(low).cast("long").alias("l"), (F.col(high) + 1).cast("long").alias("r"), F.array().cast("array<struct<_size:int,_block:bigint>>").alias("out"))

    def step(a, size):
        odd_l, odd_r = a["l"] % 2 == 1, a["r"] % 2 == 1
        out = F.concat(a["out"], F.when(odd_l, F.array(block(size, a["l"]))).otherwise(F.array().cast("array<struct<_size:int,_block:bigint>>")))
        # After the left end has moved on, the right one may have met it.
        l = F.when(odd_l, a["l"] + 1).otherwise(a["l"])  # noqa: E741
        take = odd_r & (l < a["r"])
        out = F.concat(out, F.when(take, F.array(block(size, a["r"] - 1))).otherwise(F.array().cast("array<struct<_size:int,_block:bigint>>")))
        r = F.when(odd_r, a["r"] - 1).otherwise(a["r"])
        moved = F.struct(F.shiftright(l, 1).alias("l"), F.shiftright(r, 1).alias("r"), out.alias("out"))
        return F.when(a["l"] < a["r"], moved).otherwise(a)

    cover = F.aggregate(sizes, start, step, lambda a: a["out"])
    met = spans.where(F.col(low) <= F.col(high)).select("*", F.inline(cover)).join(blocks, ["_size", "_block"])
    return met.drop("_size", "_block")
