"""Work on pairs within groups of any size.

Rows of a group that are known to belong together need no comparison with each other. In a group larger than a
block, a pivot is chosen from a seeded sample of about ``SAMPLE`` rows, and every row that the pivot settles (it is
linked to the pivot itself, or so near it that by the triangle inequality all such rows are linked) is passive: it
meets active rows only. Groups of copies are settled almost whole, so their work and what is shuffled for them grow
with their rows. The rows left are dealt into blocks by a hash of the item, and each pair of blocks with an active
row in it is a task's unit of work: no unit grows with the group. Only where few rows of a large group are near its
pivot does the number of units grow with the square of the rows that are not: every such pair has to be compared.

Pairs exist only inside a unit, as arrays: what leaves it is at most a row or two for each of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LEAST, MOST, AIM, SAMPLE, FEW = 64, 1024, 48, 64, 8


def dealt(scratch: Scratch, members: DataFrame, key: str, payload: DataFrame, item: str, choose: Callable[[pa.Table], pa.Table], settles: Callable[[pa.Table], np.ndarray], pivot: str, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(units, passive) of ``members`` (key, item, size; a written table), whose ``payload`` is joined by ``item``.

    ``choose`` makes of a group's sample (payload columns) a table with one row of the columns in ``pivot`` (DDL; all
    named pivot_...); ``settles`` tells of rows with payload and pivot columns which the pivot settles. units: rows
    with payload once for each unit they belong to, with _p, _q (its blocks) and _b (the row's own). passive: key,
    item, the pivot's columns that are long, and the group's smallest passive item as ``first``.
    """
    large = members.where(F.col("size") > least)
    draw = F.pmod(F.xxhash64(F.lit(23), item), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(float(SAMPLE)) / F.col("size")
    names = pivot.split(", ")
    longs = [n.split()[0] for n in names if n.endswith(" long")]

    def chosen(key_value: int, table: pa.Table) -> pa.Table:
        return choose(table).append_column("_key", pa.array([key_value], pa.int64()))

    sample = large.where(draw).join(payload, item)
    pivots = scratch.written(_each(sample, [key], chosen, f"{pivot}, _key long").withColumnRenamed("_key", key), "pivots")

    def mark(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            flags = settles(table) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in (key, item, *longs)), pa.array(flags)], [key, item, *longs, "_passive"])

    asked = large.join(payload, item).join(pivots, key)
    fields = "".join(f", {c} long" for c in longs)
    marked = scratch.written(asked.mapInArrow(mark, f"{key} long, {item} long{fields}, _passive boolean").where("_passive"), "settled")
    first = scratch.written(marked.groupBy(key).agg(F.count("*").alias("_passives"), F.min(item).alias("first")), "firsts")
    # Rows of small groups, and of groups without a pivot, are all active.
    rows = members.join(marked.select(key, item, "_passive"), [key, item], "left").join(first.select(key, "_passives"), key, "left")
    block = F.greatest(F.lit(least), F.least(F.lit(MOST), F.ceil(F.col("size") / AIM)))
    passives = F.coalesce("_passives", F.lit(0))
    n_active, n_passive = F.ceil((F.col("size") - passives) / block).cast("int"), F.ceil(passives / block).cast("int")
    spread = lambda n: F.pmod(F.xxhash64(F.lit(17), item), F.greatest(n, F.lit(1))).cast("int")
    units = (
        rows.select(key, item, n_active.alias("_na"), n_passive.alias("_np"), F.coalesce("_passive", F.lit(False)).alias("_passive"))
        .withColumn("_b", F.when(F.col("_passive"), F.col("_na") + spread(F.col("_np"))).otherwise(spread(F.col("_na"))))
        .withColumn("_c", F.explode(F.when(~F.col("_passive"), F.sequence(F.lit(0), F.col("_na") + F.col("_np") - 1)).when(F.col("_na") > 0, F.sequence(F.lit(0), F.col("_na") - 1))))
        .select(key, item, "_b", F.least("_b", "_c").alias("_p"), F.greatest("_b", "_c").alias("_q"))
    )
    return units.join(payload, item), marked.join(first, key).select(key, item, *longs, "first")


def by_unit(rows: DataFrame, key: str, item: str, prepare: Callable[[pa.Table], dict[str, np.ndarray]], few: Callable, many: Callable, counted: bool = False) -> DataFrame:
    """Links within units, as (a, b, n): a forest of the linked pairs of items with n = 0.

    With ``counted`` also (item, item, n): the sum of ``times`` of the rows it is linked to in the unit. ``prepare``
    makes arrays of a batch's rows; ``few`` tells which of the pairs of rows (arrays, i, j) are linked and ``many``
    gives a square of booleans for all rows of a unit. Units of up to ``FEW`` rows are taken together.
    """
    by = [key, "_p", "_q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole(batches, by):
            arrays = prepare(table) | {c: table.column(c).to_numpy() for c in (item, "_b", "_p", "_q")}
            if counted:
                arrays["times"] = table.column("times").to_numpy()
            ids, out = arrays[item], []
            counts = np.zeros(table.num_rows, np.int64)
            first, size = np.array(cuts[:-1]), np.diff(cuts)
            for n in range(2, FEW + 1):
                start = first[size == n]
                for some in (start[at : at + 20_000] for at in range(0, len(start), 20_000)):
                    x, y = np.triu_indices(n, 1)
                    i, j = (some[:, None] + x).reshape(-1), (some[:, None] + y).reshape(-1)
                    own = (arrays["_p"][i] == arrays["_q"][i]) | (arrays["_b"][i] != arrays["_b"][j])
                    i, j = i[own], j[own]
                    hit = few(arrays, i, j)
                    i, j = i[hit], j[hit]
                    if counted:
                        np.add.at(counts, i, arrays["times"][j])
                        np.add.at(counts, j, arrays["times"][i])
                    out.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])))
            for start, n in zip(first[size > FEW], size[size > FEW], strict=True):
                unit = {k: v[start : start + n] for k, v in arrays.items()}
                linked = many(unit) & allowed(unit)
                if counted:
                    counts[start : start + n] += (linked | linked.T) @ unit["times"]
                out.append(forest(unit[item], linked))
            a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
            some = np.flatnonzero(counts)
            a, b, n = np.r_[a, ids[some]], np.r_[b, ids[some]], np.r_[np.zeros(len(a), np.int64), counts[some]]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, n)], ["a", "b", "n"])

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long, n long")


def _each(rows: DataFrame, by: list[str], work: Callable[[int, pa.Table], pa.Table], ddl: str) -> DataFrame:
    """``work`` on the rows of each combination of values of ``by`` (longs, of which the first is passed on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole(batches, by):
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = table.slice(a, b - a)
                yield from work(part.column(by[0])[0].as_py(), part).combine_chunks().to_batches()

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, ddl)


def _whole(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups of rows that agree in ``by`` (rows come sorted), and where groups begin and end."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table])
        table = table.combine_chunks()
        cuts = _cuts(table, by)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]).combine_chunks(), cuts[:-1]
        kept = table.slice(cuts[-2]) if len(cuts) > 1 else None
    if kept is not None:
        yield kept.combine_chunks(), [0, kept.num_rows]


def _cuts(table: pa.Table, by: list[str]) -> list[int]:
    if not table.num_rows:
        return [0]
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for name in by:
        x = table.column(name).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return [*np.flatnonzero(change).tolist(), table.num_rows]


def allowed(unit: dict[str, np.ndarray]) -> np.ndarray:
    """Which pairs of rows are this unit's: those of its two blocks, or all of its one block; above the diagonal."""
    b = unit["_b"]
    allowed = np.triu(np.ones((len(b), len(b)), bool), 1)
    if unit["_p"][0] != unit["_q"][0]:
        allowed &= b[:, None] != b[None, :]
    return allowed


def forest(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``linked`` (upper half of a square of booleans) connects: each id to the smallest."""
    if not linked.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = linked | linked.T
    label = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        near = np.where(both, label[None, :], big).min(axis=1)
        new = np.minimum(label, near)
        if (new == label).all():
            break
        label = new
    move = label != ids
    return label[move], ids[move]
