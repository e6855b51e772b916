"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions down a tree of 255 nodes. Each node keeps zero and one counts under the contexts
of the last 0..depth bytes. Krichevsky-Trofimov estimates of all those depths are mixed with the weights of
Willems, Shtarkov and Tjalkens: a context's block probability is half its own estimate and half the product of its
longer contexts'. As block probabilities depend on counts alone, training is counting byte n-grams.

Distribution. N-grams are summed before and after one shuffle, over all training texts and over all texts to score;
no context is dropped. The tree is never in one place: what lies below contexts of three bytes is a subtree of its
own, and subtrees are dealt out, a few at a time in memory. A first pass sums the subtrees' block probabilities for
the contexts of up to two bytes (the top, which the alphabet bounds and which is gathered), a second one rates every
n-gram that occurs in the texts to score. The most frequent of these (``capacity``, at most) are broadcast, all others
are looked up by a join, so each has its exact probability. A decision whose context was never met is predicted from
its longest suffix that was. Likewise the ``hot_words`` most frequent words are broadcast for the word baseline, all
others are looked up by a join on the word's 64-bit hash.

What is scored is the text as it is, every byte of its UTF-8 form, and its end: 0xFF, which is no byte of UTF-8 and
also stands before each text. Lower case and words belong to the baseline alone.

Cases. Null text: empty, so its score is that of the end alone. Empty training set: every bit has probability 1/2.
Empty ``docs``: no rows. Texts are read whole, however long; n-grams and words that tie in frequency are broadcast or
joined together, which changes no score. Repeated rows are scored each. Columns that are not kept are ignored; a kept
one of an added one's name gives way to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, mix, nested, session_setup, text_or_empty, unnested, utf8, with_added, words, written

#: The byte before and after a text: none of UTF-8.
EDGE = 0xFF
END_OF_TEXT = mix(np.array([0x5EED0E0D], dtype=np.uint64))[0]


def _keys(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``depth + 1`` bytes at every predicted position, and each text's first position.

    Before a text come ``depth`` edges; after it one edge is predicted, its end.
    """
    n = len(ends) - 1
    sizes = np.diff(ends)
    room = np.full(len(data) + depth * (n + 1), EDGE, dtype=np.uint8)
    begin = ends[:-1] + depth * np.arange(1, n + 1)
    at = np.arange(len(data)) + np.repeat(begin - ends[:-1], sizes)
    room[at] = data
    have, key = 1, room.astype(np.uint64)
    while have < depth + 1:
        step = min(have, depth + 1 - have)
        key[have:] = key[have:] | (key[:-have] << np.uint64(8 * have)) if step == have else key[have:] | ((key[:-have] & np.uint64((1 << (8 * step)) - 1)) << np.uint64(8 * have))
        have += step
    predicted = np.ones(len(room), dtype=bool)
    predicted[:depth] = False
    for k in range(1, depth):
        predicted[begin + sizes + k] = False
    return key[predicted], ends[:-1] + np.arange(n)


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.ones_like(x)
    y = x.copy()
    for _ in range(7):
        low = y < 7
        shift = np.where(low, shift * y, shift)
        y = np.where(low, y + 1, y)
    r = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + r / 12 - r**3 / 360 + r**5 / 1260 - np.log(shift)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, node) keys in order, with the zeros and ones seen there. ``keys`` are sorted n-grams."""
    parts = []
    context, byte = keys >> np.uint64(8), keys & np.uint64(255)
    for k in range(8):
        node = (context << np.uint64(8)) | (np.uint64(1 << k) | (byte >> np.uint64(8 - k)))
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        one = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        total = np.add.reduceat(counts, first)
        ones = np.add.reduceat(np.where(one, counts, 0.0), first)
        parts.append((node[first], total - ones, ones))
    node, zeros, ones = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(node, kind="stable")
    return node[order], zeros[order], ones[order]


def _levels(grams: np.ndarray, counts: np.ndarray, low: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For contexts of ``low``..``depth`` bytes the sorted n-grams of one byte more, and counts."""
    out = []
    for d in range(low, depth + 1):
        u, back = np.unique(grams & np.uint64((1 << (8 * d + 8)) - 1), return_inverse=True)
        out.append((u, np.bincount(back, weights=counts, minlength=len(u))))
    return out


def _weighed(levels: list[tuple[np.ndarray, np.ndarray]], low: int, longer: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list, list, tuple[np.ndarray, np.ndarray]]:
    """Of each level its nodes and their weights, and of the first one the nodes and their log block probabilities."""
    nodes = [_nodes(k, c) if len(k) else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)) for k, c in levels]
    weights: list[np.ndarray] = [np.zeros(0)] * len(levels)
    for at in range(len(levels) - 1, -1, -1):
        node, zeros, ones = nodes[at]
        own = _log_kt(zeros, ones)
        if longer is None:
            weights[at], block = np.ones(len(node)), own
        else:
            parent = np.searchsorted(node, longer[0] & np.uint64((1 << (8 * (low + at) + 8)) - 1))
            split = np.bincount(parent, weights=longer[1], minlength=len(node))
            block = np.logaddexp(own, split) - math.log(2)
            weights[at] = np.exp(own - math.log(2) - block)
        longer = node, block
    return nodes, weights, longer


class ContextTree:
    """A trained tree, or the part of it below the contexts of ``above``.

    ``levels``: for each depth from the first one the sorted n-grams of d + 1 bytes, and counts. ``longer``: sorted
    nodes of the last depth and the sums of their longer contexts' log block probabilities, where these are elsewhere.
    ``vars()`` of one are plain arrays; ``ContextTree.of`` makes one of them again.
    """

    @classmethod
    def of(cls, state: dict) -> ContextTree:
        tree = cls.__new__(cls)
        tree.__dict__.update(state)
        return tree

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], above: ContextTree | None = None, longer: tuple[np.ndarray, np.ndarray] | None = None):
        low = 0 if above is None else above.depth + 1
        self.depth = low + len(levels) - 1
        nodes, weights, _ = _weighed(levels, low, longer)
        self.node, self.one = ([], []) if above is None else (list(above.node), list(above.one))
        mixed, left = (np.zeros(1), np.ones(1)) if above is None else above.passed
        for d, (node, zeros, ones), weight in zip(range(low, self.depth + 1), nodes, weights, strict=True):
            kt = (ones + 0.5) / (zeros + ones + 1.0)
            if d and len(node):
                parent = np.searchsorted(self.node[d - 1], node & np.uint64((1 << (8 * d)) - 1))
                mixed, left = mixed[parent], left[parent]
            else:
                mixed, left = np.zeros(len(node)), np.ones(len(node))
            self.node.append(node)
            self.one.append(np.clip(mixed + left * kt, 1e-12, 1 - 1e-12))
            mixed, left = mixed + left * weight * kt, left * (1 - weight)
        #: What each node of the last depth hands to longer contexts: the mixture so far and the weight left.
        self.passed = mixed, left

    def log10_probability(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probabilities: each of the eight decisions from the longest context that has met its node."""
        out = np.zeros(len(keys))
        byte = keys & np.uint64(255)
        for k in range(8):
            part = np.uint64(1 << k) | (byte >> np.uint64(8 - k))
            p, open_ = np.full(len(keys), 0.5), np.arange(len(keys))
            for d in range(self.depth, -1, -1):
                if not len(open_):
                    break
                if not len(self.node[d]):
                    continue
                want = (keys[open_] & np.uint64(((1 << (8 * d)) - 1) << 8)) | part[open_]
                at = np.minimum(np.searchsorted(self.node[d], want), len(self.node[d]) - 1)
                hit = self.node[d][at] == want
                p[open_[hit]] = self.one[d][at[hit]]
                open_ = open_[~hit]
            one = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            out += np.log10(np.where(one, p, 1 - p))
        return out


class HotGrams:
    """Log10 probabilities of the most frequent n-grams: a cache by hash, and a sorted table for what it misses."""

    def __init__(self, grams: np.ndarray, log10: np.ndarray, asked: np.ndarray, cache_bits: int = 19):
        order = np.argsort(grams)
        self.gram, self.log10 = grams[order], log10[order]
        self.cache_bits = cache_bits
        self.cache_key = np.full(1 << cache_bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.cache_log = np.full(1 << cache_bits, np.nan)
        order = np.argsort(asked, kind="stable")
        slot = self._slot(grams[order])
        self.cache_key[slot], self.cache_log[slot] = grams[order], log10[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.cache_bits)

    def log10_probability(self, keys: np.ndarray) -> np.ndarray:
        """NaN for what is not hot."""
        slot = self._slot(keys)
        out = self.cache_log[slot]
        miss = np.flatnonzero(self.cache_key[slot] != keys)
        out[miss] = np.nan
        if len(miss) and len(self.gram):
            rare, back = np.unique(keys[miss], return_inverse=True)
            at = np.minimum(np.searchsorted(self.gram, rare), len(self.gram) - 1)
            out[miss] = np.where(self.gram[at] == rare, self.log10[at], np.nan)[back]
        return out


def gram_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(gram, n): how often each run of depth + 1 bytes occurs at the positions to predict, over all texts."""

    def count(batches):
        for batch in batches:
            keys, _ = _keys(*utf8(batch.column(0)), depth)
            u, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["gram", "n"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each lower-cased word, by hash, and the end of a text occur, over all texts."""

    def count(batches):
        for batch in batches:
            data, ends = utf8(batch.column(0))
            h, _ = words(LOWER[data], ends)
            u, n = np.unique(h, return_counts=True)
            u, n = np.r_[u, END_OF_TEXT], np.r_[n, batch.num_rows]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _least_kept(sized: DataFrame, capacity: int) -> int:
    """The smallest power of two t so that the rows with size >= t number at most ``capacity``."""
    rows = sorted(sized.groupBy(F.floor(F.log2("size")).cast("int").alias("k")).agg(F.sum("rows").alias("rows")).collect(), reverse=True)
    total = 0
    for row in rows:
        total += row["rows"]
        if total > capacity:
            return 1 << (row["k"] + 1)
    return 1


def _arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.select(*names).toArrow()
    return [table.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in names]


def _whole(batches, size: int = 1 << 17):
    """Sorted n-grams of whole subtrees, some ``size`` rows at a time: columns part, gram, n, asked come sorted by part."""
    held, rows, limit = [], 0, size
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= limit:
            table = pa.Table.from_batches(held)
            part = table.column("part").to_numpy()
            cut = int(np.searchsorted(part, part[-1]))
            if cut:
                yield _sorted(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
            limit = rows + size
    if rows:
        yield _sorted(pa.Table.from_batches(held))


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gram, n, asked = (table.column(x).to_numpy() for x in ("gram", "n", "asked"))
    gram = gram.astype(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], n[order].astype(np.float64), asked[order]


def rates(training: DataFrame, docs: DataFrame, depth: int = 5) -> DataFrame:
    """(gram, asked, log10) for every n-gram of ``docs``: how often it occurs there, and its exact log10 probability."""
    spark = docs.sparkSession
    cut = min(3, depth)
    both = gram_counts(training, depth).select("gram", "n", F.lit(0).cast("long").alias("asked")).unionByName(gram_counts(docs, depth).select("gram", F.lit(0).cast("long").alias("n"), F.col("n").alias("asked")))
    scratch = Scratch()
    counted = scratch.written(both.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked")), "grams")
    part = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << (8 * cut)) - 1)).alias("part")
    deal = lambda rows: rows.select(part, "gram", "n", "asked").repartition(counted.count() // 100_000 + 1, "part").sortWithinPartitions("part")

    def blocks(batches):
        for gram, n, _ in _whole(batches):
            node, block = _weighed(_levels(gram, n, cut, depth), cut)[2]
            node, back = np.unique(node & np.uint64((1 << (8 * cut)) - 1), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(np.bincount(back, weights=block, minlength=len(node)))], ["node", "block"])

    trained = counted.where("n > 0")
    node, block = _arrays(deal(trained).mapInArrow(blocks, "node long, block double").groupBy("node").agg(F.sum("block").alias("block")), "node", "block")
    order = np.argsort(node)
    short = F.col("gram").bitwiseAND(F.lit((1 << (8 * cut)) - 1)).alias("gram")
    grams, n = _arrays(trained.groupBy(short).agg(F.sum("n").alias("n")), "gram", "n")
    top = ContextTree(_levels(grams.astype(np.int64).view(np.uint64), n.astype(np.float64), 0, cut - 1), longer=(node[order].astype(np.int64).view(np.uint64), block[order].astype(np.float64)))
    sent = spark.sparkContext.broadcast(vars(top))

    def rate(batches):
        above = ContextTree.of(sent.value)
        for gram, n, asked in _whole(batches):
            seen, wanted = n > 0, asked > 0
            tree = ContextTree(_levels(gram[seen], n[seen], cut, depth), above)
            keys = gram[wanted]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(asked[wanted]), pa.array(tree.log10_probability(keys))], ["gram", "asked", "log10"])

    out = written(deal(counted).mapInArrow(rate, "gram long, asked long, log10 double"), "rates")
    scratch.drop(spark)
    return out


def score(docs: DataFrame, training: DataFrame, keep: list[str], depth: int = 5, capacity: int = 1 << 19, hot_words: int = 1 << 18) -> DataFrame:
    """``docs`` with the model's log10 probability of each text and the word baseline, both learned from ``training``.

    ``keep`` names columns of ``docs`` to carry. ``capacity`` and ``hot_words``: how many n-grams and words are
    broadcast at most; all others are joined, so neither changes the result. Adds n_tokens, n_known, train_tokens,
    base_score, score, n_bytes and bits_per_byte (code length per byte of the text, its end's included; null where
    there are none).
    """
    spark = docs.sparkSession
    session_setup(spark)
    rated_grams = rates(training, docs, depth)
    often = _least_kept(rated_grams.select(F.col("asked").alias("size"), F.lit(1).alias("rows")), capacity)
    grams, asked, logs = _arrays(rated_grams.where(F.col("asked") >= often), "gram", "asked", "log10")
    hot_grams = spark.sparkContext.broadcast((grams.astype(np.int64).view(np.uint64), logs.astype(np.float64), asked))
    counts = written(word_counts(training), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = _least_kept(counts.select(F.col("n").alias("size"), F.lit(1).alias("rows")), hot_words)
    hot, times = _arrays(counts.where(F.col("n") >= least), "word", "n")
    hot = hot.astype(np.int64).view(np.uint64)
    order = np.argsort(hot)
    lookup = spark.sparkContext.broadcast((hot[order], np.log10(times[order] + 1.0)))

    def rate(batches):
        known, logs = lookup.value
        model = HotGrams(*hot_grams.value)
        # Few texts at a time: a position takes some 100 bytes of arrays on the way.
        for batch in (whole.slice(at, 200) for whole in batches for at in range(0, whole.num_rows, 200)):
            data, ends = utf8(batch.column(batch.num_columns - 1))
            n = len(ends) - 1
            keys, first = _keys(data, ends, depth)
            by_gram = model.log10_probability(keys)
            unlisted = np.isnan(by_gram)
            by_model = np.add.reduceat(np.where(unlisted, 0.0, by_gram), first)
            grams_before = np.r_[0, np.cumsum(unlisted)][np.r_[first, len(keys)]]
            h, before = words(LOWER[data], ends)
            at = before[1:] + np.arange(n)
            tokens = np.insert(h, before[1:], END_OF_TEXT)
            first = before[:-1] + np.arange(n)
            place = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
            is_hot = known[place] == tokens if len(known) else np.zeros(len(tokens), bool)
            value = np.where(is_hot, logs[place], 0.0) if len(known) else np.zeros(len(tokens))
            cold = tokens[~is_hot]
            cold_before = np.r_[0, np.cumsum(~is_hot)][np.r_[first, len(tokens)]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(at - first + 1), pa.array(np.add.reduceat(is_hot.astype(np.int64), first)), pa.array(np.add.reduceat(value, first)), pa.array(by_model), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(cold_before.astype(np.int32)), pa.array(cold.view(np.int64))), pa.ListArray.from_arrays(pa.array(grams_before.astype(np.int32)), pa.array(keys[unlisted].view(np.int64)))],
                [*batch.schema.names[:-1], "n_tokens", "n_hot", "log_hot", "score_hot", "n_bytes", "cold", "cold_grams"],
            )

    picked = nested(docs, keep, F.monotonically_increasing_id().alias("_row"), text_or_empty().alias("_text"))
    rated = written(picked.mapInArrow(rate, with_added(picked, "n_tokens long, n_hot long, log_hot double, score_hot double, n_bytes long, cold array<long>, cold_grams array<long>")), "rated")
    each = rated.select("_row", F.explode("cold").alias("word"))
    none = lambda kind: F.lit(None).cast(kind)
    rare_words = each.join(counts, "word").select("_row", F.lit(1).alias("one"), F.log10(F.col("n") + F.lit(1.0)).alias("log"), none("double").alias("log10"))
    rare_grams = rated.select("_row", F.explode("cold_grams").alias("gram")).join(rated_grams, "gram").select("_row", none("int").alias("one"), none("double").alias("log"), "log10")
    rare = rare_words.unionByName(rare_grams).groupBy("_row").agg(F.sum("one").alias("n_rare"), F.sum("log").alias("log_rare"), F.sum("log10").alias("score_rare"))
    score = F.col("score_hot") + F.coalesce("score_rare", F.lit(0.0))
    unit = math.log10(total + distinct + 1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = rated.drop("cold", "cold_grams").join(rare, "_row", "left").select(
        "_keep",
        "n_tokens",
        (F.col("n_hot") + zero("n_rare")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_hot") + F.coalesce("log_rare", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        score.alias("score"),
        "n_bytes",
        F.when(F.col("n_bytes") > 0, -score / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
    return unnested(out, keep, ["n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])
