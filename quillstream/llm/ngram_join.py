"""N-gram Jaccard join with Bayesian candidate pruning.

A text is the set of its runs of five words (shorter texts: one run of all their words). Texts with equal sets are
one class; classes have MinHash values of 32 bits, banded so that pairs of similarity 0.8 meet in a bucket with
probability 0.9999. Pairs that meet are compared a few MinHash values at a time. With a uniform prior the posterior
probability that the similarity reaches the threshold, after m of n values agree, is P(Binomial(n + 1, threshold)
<= m); once that falls below ``tolerance`` the pair is dropped (Satuluri and Parthasarathy). Pairs that survive all
values tie their texts into clusters; within a cluster pairs are pruned in the same way and the rest is verified
with the exact sets, which counts links and gives the final classes.

Distribution. Signatures are computed once and written; only buckets with two or more texts get signatures, and only
texts of clusters get their sets. In large buckets and clusters the texts that a pivot settles are not compared with
each other: those likely to be similar to one member are tied by it, and any two of similarity (1 + threshold) / 2 or
more to one set reach the threshold, as one less the similarity is a metric. Units of work are bounded (``groups``),
so a group of copies that holds a third of all rows is spread; links leave a unit as a forest and as counts.

Cases. Null or empty text, one without words, or a null doc_id: no links, a class of its own (kept). Words are
case-sensitive runs of anything but white space. Repeated rows, and different texts of one doc_id, count as texts of
their own: classes have numbers of their own, and only a class's name is an id. A similarity of exactly the threshold
links. Long texts are sets of all their runs. Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, mix, nested, pieces_of, session_setup, text_or_empty, unnested, utf8, with_added, words, written
from .groups import allowed, by_unit, dealt

BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
#: So many values are compared before a pair is looked at again.
STEP = 8
_MULTIPLY = np.random.Generator(np.random.PCG64(97)).integers(1, 2**63, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text its set of hashed runs of ``width`` words, sorted."""
    h, before = words(data, ends)
    whole = np.zeros(len(h), np.uint64)
    for k in range(width):
        part = mix(h + np.uint64(k + 1))
        whole[: max(len(h) - k, 0)] += part[k:] * np.uint64(2 * k + 1)
    whole = mix(whole)
    out = []
    for a, b in zip(before[:-1], before[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for k in range(a, b):
                short = mix((np.array([short]) * np.uint64(31)) ^ h[k : k + 1])[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set that is not empty."""
    best = np.full(HASHES, np.uint64(0xFFFFFFFF), np.uint64)
    for at in range(0, len(shingles), 2048):
        best = np.minimum(best, ((shingles[at : at + 2048, None] * _MULTIPLY) >> np.uint64(32)).min(axis=0))
    return best.astype(np.uint32)


def band_codes(signatures: np.ndarray) -> np.ndarray:
    code = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), 1))
    for k in range(ROWS):
        code = mix(code * np.uint64(0x100000001B3) + signatures.reshape(-1, BANDS, ROWS)[:, :, k].astype(np.uint64))
    return code


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For n = 0..HASHES compared values, the smallest number of matches with posterior >= tolerance."""
    out = []
    for n in range(HASHES + 1):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return np.array(out)


def survivors(signatures: np.ndarray, allowed: np.ndarray, least: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) among ``allowed`` that are still likely after every ``step`` MinHash values."""
    i, j = np.nonzero(allowed)
    matches = np.zeros(len(i), np.int16)
    for at in range(0, HASHES, step):
        if not len(i):
            break
        for h in range(at, at + step):
            column = np.ascontiguousarray(signatures[:, h])
            matches += column[i] == column[j]
        keep = matches >= least[at + step]
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def likely(one: np.ndarray, other: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of signatures are still likely after every ``STEP`` values."""
    matches = (one == other).reshape(len(one), -1, STEP).sum(axis=2).cumsum(axis=1)
    return (matches >= least[STEP :: STEP]).all(axis=1)


def exact(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs have a Jaccard similarity of at least ``threshold``."""
    size = np.array([len(s) for s in sets])
    both = np.zeros(len(i), np.int64)
    if len(i) <= 4 * len(sets):
        for k, (a, b) in enumerate(zip(i, j, strict=True)):
            both[k] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:
        flat, where = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        known, place = np.unique(flat, return_inverse=True)
        width = max(1, 8_000_000 // len(sets))
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(place, kind="stable")
        place, where = place[order], where[order]
        for at in range(0, len(known), width):
            lo, hi = np.searchsorted(place, [at, at + width])
            has = np.zeros((len(sets), min(width, len(known) - at)), np.float32)
            has[where[lo:hi], place[lo:hi] - at] = 1
            common += has @ has.T
        both = common[i, j].astype(np.int64)
    return both >= threshold * (size[i] + size[j] - both) - 1e-9


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _sets(column: pa.Array):
    """Shingle sets of all texts of a batch, one after another."""
    data, ends = utf8(column)
    for a, b in pieces_of(ends, 1 << 18):
        yield from shingle_sets(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])


def _key(s: np.ndarray) -> tuple[int, int, int]:
    """Two 64-bit sums over a set, and its size: what tells sets apart."""
    return int(s.sum(dtype=np.uint64).astype(np.int64)), int(mix(s).sum(dtype=np.uint64).astype(np.int64)), len(s)


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def similar(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, class_id (smallest doc_id reachable by links), n_links and kept for every row of ``docs``.

    ``keep`` names more columns of ``docs`` to carry. cluster numbers the texts that links connect (null: without
    words or id); the numbers are unique in one result and differ between runs.
    """
    session_setup(docs.sparkSession)
    scratch = Scratch()
    least = least_matches(threshold, tolerance)
    key = ["h1", "h2", "n"]

    def digests(batches):
        for batch in batches:
            h1, h2, n, signs = [], [], [], []
            for s, named in zip(_sets(batch.column(batch.num_columns - 1)), batch.column(1).is_valid().to_pylist(), strict=True):
                for into, x in zip((h1, h2, n), _key(s), strict=True):
                    into.append(x)
                n[-1] *= named
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, pa.int64()) for x in (h1, h2, n)), _binary(signs)], [*batch.schema.names[:-1], *key, "signature"])

    picked = nested(docs, list(keep), F.col("doc_id"), text_or_empty().alias("text"))
    rows = written(picked.mapInArrow(digests, with_added(picked, "h1 long, h2 long, n long, signature binary")), "digests")
    grouped = rows.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("id"), F.count("*").alias("times"), F.first("signature").alias("signature"))
    classes = scratch.written(grouped.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")

    def banded(batches):
        for batch in batches:
            s = _signatures(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(band_codes(s).reshape(-1).view(np.int64))], ["node", "code"])

    codes = classes.select("node", "signature").mapInArrow(banded, "node long, code long")
    busy = scratch.written(codes.groupBy("code").agg(F.count("*").alias("size")).where("size > 1"), "busy")
    met = scratch.written(codes.join(busy, "code"), "met")

    def signed(table: pa.Table) -> dict[str, np.ndarray]:
        return {"signature": _signatures(table.column("signature"))}

    def few(arrays: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return likely(arrays["signature"][i], arrays["signature"][j], least)

    def many(unit: dict) -> np.ndarray:
        s = unit["signature"]
        linked = np.zeros((len(s), len(s)), bool)
        linked[survivors(s, allowed(unit), least)] = True
        return linked

    def middle(table: pa.Table) -> pa.Table:
        """The sample's text that ties most others."""
        i, j = survivors(_signatures(table.column("signature")), np.triu(np.ones((table.num_rows,) * 2, bool), 1), least)
        best = int(np.bincount(np.r_[i, j, 0], minlength=table.num_rows).argmax())
        return pa.table({"pivot_signature": table.column("signature").slice(best, 1), "pivot_node": table.column("node").slice(best, 1)})

    def tied(table: pa.Table) -> np.ndarray:
        return likely(_signatures(table.column("signature")), _signatures(table.column("pivot_signature")), least)

    units, passive = dealt(scratch, met, "code", classes.select("node", "signature"), "node", middle, tied, "pivot_signature binary, pivot_node long", least=256)
    ties = by_unit(units, "code", "node", signed, few, many).select("a", "b").unionByName(passive.select(F.col("pivot_node").alias("a"), F.col("node").alias("b")).where("a != b"))
    clusters = scratch.written(components(ties.distinct(), scratch), "clusters").select(F.col("id").alias("node"), "component")

    def sets(batches):
        for batch in batches:
            found = list(_sets(batch.column(0)))
            columns = list(zip(*map(_key, found), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), _binary([s.tobytes() for s in found])], [*key, "shingles"])

    # One text of each class is needed: that of the class's id. Of other texts with that id the join leaves none.
    # Shuffled at every size, as the ids in clusters grow with the documents.
    chosen = clusters.join(classes.select("node", "id", *key, "times", "signature"), "node")
    asked = scratch.written(chosen.select(F.col("id").alias("doc_id")).distinct(), "asked")
    whole = docs.select("doc_id", text_or_empty().alias("text")).join(asked.hint("shuffle_hash"), "doc_id", "left_semi").select("text").mapInArrow(sets, "h1 long, h2 long, n long, shingles binary")
    facts = scratch.written(chosen.select("node", *key, "times", "signature").join(whole, key).dropDuplicates(["node"]).select("node", "times", "signature", "shingles"), "sets")
    sizes = scratch.written(clusters.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    members = scratch.written(clusters.join(sizes, "component"), "members")

    def whole_sets(table: pa.Table) -> dict[str, np.ndarray]:
        sets = np.empty(table.num_rows, object)
        sets[:] = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        return signed(table) | {"sets": sets}

    def few_exact(arrays: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        hit = few(arrays, i, j)
        at, own = np.unique(np.r_[i[hit], j[hit]], return_inverse=True)
        hit[hit] = exact(list(arrays["sets"][at]), own[: hit.sum()], own[hit.sum() :], threshold)
        return hit

    def many_exact(unit: dict) -> np.ndarray:
        linked = many(unit)
        i, j = np.nonzero(linked)
        ok = exact(list(unit["sets"]), i, j, threshold)
        linked[:] = False
        linked[i[ok], j[ok]] = True
        return linked

    def common(table: pa.Table) -> pa.Table:
        """The runs that more than half of the sample's texts have."""
        u, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]), return_counts=True)
        return pa.table({"pivot_shingles": _binary([u[2 * n > table.num_rows].tobytes()])})

    def near(table: pa.Table) -> np.ndarray:
        """Of similarity (1 + threshold) / 2 or more to the pivot; a little is left to rounding."""
        out, pivots = np.zeros(table.num_rows, bool), {}
        for k, (own, other) in enumerate(zip(table.column("shingles").to_pylist(), table.column("pivot_shingles").to_pylist(), strict=True)):
            a, b = np.frombuffer(own, np.uint64), pivots.setdefault(other, np.frombuffer(other, np.uint64))
            both = len(np.intersect1d(a, b, assume_unique=True))
            out[k] = both >= (1 + threshold) / 2 * (len(a) + len(b) - both) + 1e-9
        return out

    units, passive = dealt(scratch, members, "component", facts, "node", common, near, "pivot_shingles binary")
    weighed = passive.join(facts.select("node", "times"), "node")
    total = scratch.written(weighed.groupBy("component").agg(F.sum("times").alias("all")), "totals")
    sure = weighed.join(total, "component").select(F.col("node").alias("a"), F.col("node").alias("b"), (F.col("all") - F.col("times")).alias("n"))
    joined_by_pivot = passive.select(F.col("first").alias("a"), F.col("node").alias("b"), F.lit(0).cast("long").alias("n")).where("a != b")
    found = scratch.written(by_unit(units, "component", "node", whole_sets, few_exact, many_exact, counted=True).unionByName(sure).unionByName(joined_by_pivot), "links")
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    final = scratch.written(components(found.where("a < b").select("a", "b"), scratch), "final").select(F.col("id").alias("node"), "component")
    smallest = scratch.written(final.join(classes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("class_id")), "smallest")
    named = final.join(smallest, "component").select("node", "component", "class_id")
    labels = written(classes.select("node", "id", *key, "times").join(counts, "node", "left").join(named, "node", "left"), "labels")
    scratch.drop(docs.sparkSession)
    joined = rows.drop("signature").join(labels, key, "left")
    class_id = F.coalesce("class_id", "id", "doc_id")
    answer = joined.select(
        "_keep",
        "doc_id",
        class_id.cast("long").alias("class_id"),
        (F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("times") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"),
        F.coalesce("component", "node").alias("cluster"),
    )
    return unnested(answer, list(keep), ["doc_id", "class_id", "n_links", "kept", "cluster"])
