"""What the operators share: the folder all executors see, written tables, words as arrays, link components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a maximal run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch. Texts can be long, so batches are short.
BATCH_ROWS = 2000


def session_setup(spark: SparkSession) -> None:
    """Short Arrow batches, so that a Python worker holds few texts at a time.

    Plans are made when a result is read, so the setting stays; a shorter one of the session's own is left alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or else the one given to setCheckpointDir (tests).

    Where neither is set, a local master gets a folder of its own; on a cluster this is an error, as a folder of one
    machine is not seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        folder = context._jsc.sc().getCheckpointDir()
        if folder.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
            folder = context._jsc.sc().getCheckpointDir()
        named = folder.get()
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    return Scratch().written(df, name)


class Scratch:
    """Written tables of one operator, removed together once nothing lazy reads them any more."""

    def __init__(self):
        self.paths: list[str] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        self.paths.append(f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}")
        df.write.option("compression", "zstd").parquet(self.paths[-1])
        return spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self, spark: SparkSession) -> None:
        for name in self.paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


def nested(docs: DataFrame, keep: list[str], *more: Column) -> DataFrame:
    """``keep`` columns in one struct, so that no name clashes with an operator's own, and ``more``."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in dict.fromkeys(keep)] or [F.lit(None).alias("_none")]).alias("_keep"), *more)


def unnested(df: DataFrame, keep: list[str], added: list[str]) -> DataFrame:
    """The nested columns and the added ones; a kept column of an added one's name gives way to it."""
    return df.select(*[F.col(f"_keep.{quoted(c)}").alias(c) for c in dict.fromkeys(keep) if c not in added], *added)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_added(picked: DataFrame, added: str) -> StructType:
    """Schema of what a Python step returns: all columns of ``picked`` but its last, and those added."""
    return StructType([*picked.schema.fields[:-1], *StructType.fromDDL(added).fields])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# Words as arrays ------------------------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 4096), np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a batch, and where each begins (one offset more than texts). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def pieces_of(ends: np.ndarray, size: int = 1 << 16):
    """Ranges of whole texts of about ``size`` bytes each, so that work on them stays in the cache."""
    n, at = len(ends) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        yield at, to
        at = to


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a batch, in order, and for each text the number of words before it."""
    parts = [_words(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]) for a, b in pieces_of(ends)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    sizes = np.concatenate([np.diff(b) for _, b in parts])
    return np.concatenate([h for h, _ in parts]), np.r_[0, np.cumsum(sizes)]


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = ends[(ends > 0) & (ends < len(data))]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, ends)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    at = np.arange(len(data), dtype=np.int32)
    at -= np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)])).astype(np.int32)
    at[~inside] = 0
    terms = _BYTE[data]
    terms *= _powers(int(at.max()) + 1)[at]
    terms *= inside
    return mix(np.add.reduceat(terms, starts)), before


# Components -----------------------------------------------------------------------------------------------------


def components(links: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(id, component) for every id in ``links`` (columns a, b): the smallest id reachable by links.

    Alternates two steps until nothing changes: every node is tied to the smallest of its neighbours' (large star
    and small star of Kiveris et al.). Only links are moved, each round is a written table, no node's neighbours
    are collected, and the number of rounds is logarithmic in the longest chain.
    """
    spark, round_ = links.sparkSession, Scratch()
    now = round_.written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    seen = None
    for _ in range(rounds):
        last, round_ = round_, Scratch()
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Written, so that both sides of the joins are plain exchanges and a node with very many links is split.
        low = last.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        large = last.written(large, "large")
        low2 = last.written(large.groupBy("b").agg(F.min("a").alias("m")), "low2")
        small = large.join(low2, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        then = round_.written(small.select("e.a", "e.b").where("a < b").distinct(), "links")
        state = then.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        last.drop(spark)
        now = then
        if seen == tuple(state):
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    scratch.paths += round_.paths
    stars = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
