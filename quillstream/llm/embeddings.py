"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

Each of ``tables`` hashes rotates a vector three times by random signs and a fast Walsh-Hadamard transform, and
takes in each of ``parts`` rotations the coordinate of largest size with its sign: the nearest corner of a
cross-polytope. Besides its own bucket a vector also stands in ``probes`` more, those of the second-largest
coordinates that lose least. Vectors that meet in a bucket are compared in double precision.

Equal vectors are first made one class with a number of its own, whatever ids stand on them. Verified links of
buckets give components; within a component all pairs are then compared, in blocks, which counts each vector's links
and finds those that the buckets missed. In large buckets and components the vectors that a pivot settles are not
compared with each other: those linked to a member need no other link to hang together, and any two within half the
threshold's angle of one direction are linked. Units of work are bounded (``groups``); links leave a unit as a
forest, never as all pairs.

Cases. A vector that is null, empty or zero, has null or non-finite parts, or no vec_id links with nothing and is
kept. Vectors of different lengths never link. Repeated rows, and different vectors of one vec_id, count as vectors of
their own; as their ids are equal, each is kept if its id is its component's smallest. Ties: a cosine of exactly the
threshold links. Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .common import Scratch, components, mix, session_setup, written
from .groups import by_unit, dealt


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def codes(x: np.ndarray, tables: int, parts: int, probes: int, seed: int = 29) -> np.ndarray:
    """Bucket codes of unit vectors: for each table its own bucket and ``probes`` more."""
    n, dim = x.shape
    wide = 1 << max(2, int(dim - 1).bit_length())
    padded = np.zeros((n, wide))
    padded[:, :dim] = x
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((n, tables, probes + 1), np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        best, loss, second = [], [], []
        for _ in range(parts):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size=wide))
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            swap = size[rows, top[:, 0]] < size[rows, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            corner = [top[:, k] * 2 + (y[rows, top[:, k]] < 0) for k in (0, 1)]
            best.append(corner[0])
            second.append(corner[1])
            loss.append(size[rows, top[:, 0]] - size[rows, top[:, 1]])
        best, second, loss = np.array(best), np.array(second), np.array(loss)
        # every choice of first or second corner in each part, from the least loss on
        choices = np.array([[c >> k & 1 for k in range(parts)] for c in range(1 << parts)])
        cost = choices @ loss
        order = np.argsort(cost, axis=0, kind="stable")[: probes + 1]
        for k in range(probes + 1):
            picked = choices[order[k]]
            code = np.full(n, np.uint64(t * 1_000_003 + dim))
            for part in range(parts):
                code = mix(code * np.uint64(0x100000001B3) + np.where(picked[:, part] == 1, second[part], best[part]).astype(np.uint64))
            out[:, t, k] = code
    return out.reshape(n, -1)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision; all of one length."""
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(table: pa.Table):
    """Places of rows whose vectors have one length, for each length. Buckets and components hold one length each."""
    size = np.diff(table.column("vec").combine_chunks().offsets.to_numpy())
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tables: int = 12, parts: int | None = None, probes: int = 3) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding).

    ``parts`` grows with the logarithm of the number of vectors, so that unrelated ones seldom meet.
    """
    session_setup(vectors.sparkSession)
    scratch = Scratch()
    part = vectors.schema["embedding"].dataType.elementType
    part = part if isinstance(part, (FloatType, DoubleType)) else DoubleType()
    vec = F.col("embedding").cast(ArrayType(part))
    big = F.lit(float("inf"))
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)) & F.exists(vec, lambda v: v != 0)
    valid = F.coalesce(F.col("vec_id").isNotNull() & (F.size(vec) > 0) & finite, F.lit(False))
    rows = vectors.select("vec_id", F.when(valid, vec).alias("vec"))
    key = [F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(k), "vec")).alias(f"h{k}") for k in (1, 2)]
    keyed = rows.select("vec_id", "vec", *key)
    grouped = keyed.where("vec is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"), F.first("vec").alias("vec"))
    classes = scratch.written(grouped.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    payload = classes.select("node", "vec")
    n = classes.count()
    parts = parts or max(2, int(np.ceil(np.log(max(n, 1)) / np.log(128))))
    wide = f"array<{part.simpleString()}>"

    def hashed(batches):
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy().astype(np.float64)
            begin = np.cumsum(sizes) - sizes
            out = np.zeros((batch.num_rows, tables * (probes + 1)), np.uint64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = flat[begin[at][:, None] + np.arange(dim)]
                out[at] = codes(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), tables, parts, probes)
            flat_codes = pa.array(out.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * out.shape[1]), flat_codes)], ["node", "codes"])

    code_rows = scratch.written(payload.mapInArrow(hashed, "node long, codes array<long>").select("node", F.explode("codes").alias("code")), "codes")
    busy = scratch.written(code_rows.groupBy("code").agg(F.count("*").alias("size")).where("size > 1"), "busy")
    met = scratch.written(code_rows.join(busy, "code"), "met")

    def prepare(table: pa.Table) -> dict[str, np.ndarray]:
        """Unit vectors, filled up with zeros to one length, and their lengths."""
        size = np.diff(table.column("vec").combine_chunks().offsets.to_numpy())
        x = np.zeros((table.num_rows, size.max(initial=0)))
        for at in _by_length(table):
            x[at, : size[at[0]]] = _rows(table.column("vec").take(at))
        return {"x": x, "size": size}

    def few(arrays: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x = arrays["x"]
        return ((x[i] * x[j]).sum(axis=1) >= threshold) & (arrays["size"][i] == arrays["size"][j])

    def many(unit: dict) -> np.ndarray:
        return (unit["x"] @ unit["x"].T >= threshold) & (unit["size"][:, None] == unit["size"][None, :])

    def middle(table: pa.Table) -> pa.Table:
        """The sample's vector with the most links."""
        at = max(_by_length(table), key=len)
        x = _rows(table.column("vec").take(at))
        best = int(at[((x @ x.T) >= threshold).sum(axis=1).argmax()])
        return pa.table({"pivot_vec": table.column("vec").slice(best, 1), "pivot_node": table.column("node").slice(best, 1)})

    def mean(table: pa.Table) -> pa.Table:
        """The direction of the sample's mean."""
        x = _rows(table.column("vec")).mean(axis=0)
        return pa.table({"pivot_vec": pa.array([x.tolist()], table.schema.field("vec").type)})

    def within(cosine: float):
        def settles(table: pa.Table) -> np.ndarray:
            out = np.zeros(table.num_rows, bool)
            for at in _by_length(table):
                other = table.column("pivot_vec").take(at)
                if not (np.diff(other.combine_chunks().offsets.to_numpy()) == len(table.column("vec")[int(at[0])])).all():
                    continue
                x, y = _rows(table.column("vec").take(at)), _rows(other)
                out[at] = (x * y).sum(axis=1) >= cosine
            return out

        return settles

    units, passive = dealt(scratch, met, "code", payload, "node", middle, within(threshold), f"pivot_vec {wide}, pivot_node long")
    links = by_unit(units, "code", "node", prepare, few, many).select("a", "b").unionByName(passive.select(F.col("pivot_node").alias("a"), F.col("node").alias("b")).where("a != b"))
    of = scratch.written(components(links.distinct(), scratch), "components").select(F.col("id").alias("node"), "component")
    sizes = scratch.written(of.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    members = scratch.written(of.join(sizes, "component"), "members")
    facts = classes.select("node", "times", "vec")

    # Any two within half the angle of one direction are linked; a millionth of a radian is left to rounding.
    half = float(np.cos(max(np.arccos(threshold) / 2 - 1e-6, 0.0)))
    units, passive = dealt(scratch, members, "component", facts, "node", mean, within(half), f"pivot_vec {wide}")
    weighed = passive.join(facts.select("node", "times"), "node")
    total = scratch.written(weighed.groupBy("component").agg(F.sum("times").alias("all")), "totals")
    sure = weighed.join(total, "component").select("node", (F.col("all") - F.col("times")).alias("n"))
    counts = by_unit(units, "component", "node", prepare, few, many, counted=True).where("a = b").select(F.col("a").alias("node"), "n").unionByName(sure).groupBy("node").agg(F.sum("n").alias("linked"))
    smallest = scratch.written(of.join(classes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("component_id")), "smallest")
    named = of.join(smallest, "component").select("node", "component_id")
    labels = written(classes.select("node", "id", "h1", "h2", "times").join(counts, "node", "left").join(named, "node", "left"), "labels")
    scratch.drop(vectors.sparkSession)
    joined = keyed.select("vec_id", "h1", "h2").join(labels, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id", "vec_id")
    return joined.select(
        "vec_id",
        (F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("times") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
