"""Losses of word pairs by sentence, window and paragraph, where both the counts and the texts are large.

Texts are dealt by id into batches of some ``BATCH`` characters, words and pairs by hash into as many buckets. A batch
sends each bucket one packed list of its distinct words and pairs, with how often its part of the corpus has them; the
bucket adds up and sends back bare numbers in the order of the list. So a word or pair moves once for each batch that has
it, however frequent it is, and nothing is broadcast. Names are compared whole, so all counts are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of texts in a batch. Only the size of lists depends on it.
BATCH = 8_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _packed(parts: list) -> bytes:
    """Numbers (byte by byte, as the high ones are mostly zero) and names as one compressed string."""
    raw = []
    for x in parts:
        if isinstance(x, tuple):  # names: lengths, bytes
            raw += [np.ascontiguousarray(x[0].astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), x[1]]
        else:
            raw.append(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    whole = head + b"".join(raw)
    return len(whole).to_bytes(8, "little") + pa.Codec("zstd").compress(whole, asbytes=True)


def _unpacked(packed: bytes) -> list[bytes]:
    whole = pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    n = int.from_bytes(whole[:8], "little")
    ends = np.cumsum(np.r_[8 * (n + 1), np.frombuffer(whole, np.int64, n, 8)])
    return [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _names(lengths: list[bytes], data: list[bytes]) -> pa.Array:
    sizes = np.concatenate([_numbers(x) for x in lengths])
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(data))])


class _Slices:
    """Picked names, of which runs are taken as (lengths, bytes)."""

    def __init__(self, names: pa.Array, picked: np.ndarray):
        taken = names.take(pa.array(picked))
        _, ends, data = taken.buffers()
        self.ends = np.frombuffer(ends, np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        self.data = data

    def __getitem__(self, run: slice) -> tuple[np.ndarray, bytes]:
        ends = self.ends[run.start : run.stop + 1]
        return np.diff(ends), self.data[int(ends[0]) : int(ends[-1])].to_pybytes() if ends[-1] > ends[0] else b""


def _split(texts: pa.ChunkedArray) -> tuple[list[pa.Array], np.ndarray]:
    """Words of texts, and how many each has. Python's white space is that of ``functions.text.SPACE``."""
    parts, sizes = [], []
    for at in range(0, len(texts), 1000):
        words = [t.split() if t else [] for t in texts.slice(at, 1000).to_pylist()]
        sizes += map(len, words)
        parts.append(pa.array([w for t in words for w in t], pa.large_string()))
    return parts, np.array(sizes, np.int64)


def _coded(parts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """Distinct names, sorted, and each one's place among them. The order of rows changes neither."""
    found = pa.concat_arrays([pa.array([], pa.large_string()), *parts]).dictionary_encode()
    order = pc.array_sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found.dictionary.take(pa.array(order)), rank[found.indices.to_numpy()]


def _flat(lists: pa.ChunkedArray) -> tuple[pa.ChunkedArray, np.ndarray]:
    """Elements of a list column, and how many each row has."""
    return pc.list_flatten(lists), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


class _Lists:
    """The words and pairs of a batch in the order in which they are asked for: by bucket, then by name."""

    def __init__(self, names: pa.Array, code: np.ndarray, unit: np.ndarray, buckets: int):
        self.names, v = names, max(len(names), 1)
        self.place = np.flatnonzero(unit[1:] == unit[:-1])  # of each pair's first word
        self.first, self.second = code[self.place], code[self.place + 1]
        self.pair, self.back = np.unique(self.first * v + self.second, return_inverse=True)
        h = pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False) if len(names) else np.zeros(0, np.uint64)
        dealt = lambda x: ((x * _MIX[1]) >> np.uint64(24)) % np.uint64(buckets)
        self.w, self.v = self.pair // v, self.pair % v
        self.words, self.word_cut = self._order(dealt(h), buckets)
        self.pairs, self.pair_cut = self._order(dealt(h[self.w] * _MIX[0] + h[self.v]), buckets)

    @staticmethod
    def _order(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def _asks(buckets: int):
    def ask(batch: pa.Table) -> pa.Table:
        """A row for each bucket: words with their counts as first and as second, pairs with theirs, and which are asked for."""
        counted, sizes = _split(batch.column("counted"))
        said, per = _flat(batch.column("said"))
        asked, of = _split(said)
        names, code = _coded(counted + asked)
        rows = batch.num_rows
        unit = np.repeat(np.r_[np.arange(rows), rows + np.repeat(np.arange(rows), per)], np.r_[sizes, of])
        lists, here = _Lists(names, code, unit, buckets), int(sizes.sum())
        counts = lists.place < here
        many = lambda x, n, w: np.bincount(x, weights=w, minlength=n).astype(np.int64)
        n_w, n_v = (many(x, len(names), counts) for x in (lists.first, lists.second))
        n_wv, wanted = (many(lists.back, len(lists.pair), x) for x in (counts, ~counts))
        told = np.bincount(code[here:], minlength=len(names)) > 0
        words, firsts, seconds = (_Slices(names, x) for x in (lists.words, lists.w[lists.pairs], lists.v[lists.pairs]))
        n_w, n_v, told, n_wv, wanted = n_w[lists.words], n_v[lists.words], told[lists.words], n_wv[lists.pairs], wanted[lists.pairs] > 0
        sent = []
        for k in range(buckets):
            a, b = slice(*lists.word_cut[k : k + 2]), slice(*lists.pair_cut[k : k + 2])
            sent.append(_packed([words[a], n_w[a], n_v[a], told[a], firsts[b], seconds[b], n_wv[b], wanted[b]]))
        return pa.table({"bucket": pa.array(np.arange(buckets, dtype=np.int32)), "batch": pa.array(np.full(buckets, batch.column("batch")[0].as_py(), np.int32)), "lists": pa.array(sent, pa.binary())})

    return ask


def _adds(bucket: pa.Table) -> pa.Table:
    """For each batch the bucket's counts of what it asked for, and the sums over all words of the bucket."""
    batches = bucket.column("batch").to_numpy()
    parts = [list(x) for x in zip(*(_unpacked(x.as_py()) for x in bucket.column("lists")), strict=True)]
    numbers = lambda k: np.concatenate([_numbers(x) for x in parts[k]])

    def totals(names: pa.Array, counts: list[int], wanted: int) -> tuple[list, list]:
        code = names.dictionary_encode().indices.to_numpy()
        sums = [np.bincount(code, weights=numbers(k)).astype(np.int64) for k in counts]
        ends = np.cumsum([0, *(len(x) // 8 for x in parts[wanted])])
        flag = numbers(wanted) > 0
        picked = [code[a:b][flag[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return sums, [[s[x] for s in sums] for x in picked]

    (_, n_v), words = totals(_names(parts[0], parts[1]), [2, 3], 4)
    both = pc.binary_join_element_wise(_names(parts[5], parts[6]), _names(parts[7], parts[8]), pa.scalar(" ", pa.large_string()))
    _, pairs = totals(both, [9], 10)
    back = [i for i, b in enumerate(batches) if b >= 0]
    one = lambda x, kind: pa.array(np.full(len(back), x), kind)
    return pa.table({"batch": pa.array(batches[back], pa.int32()), "bucket": one(bucket.column("bucket")[0].as_py(), pa.int32()), "total": one(int(n_v.sum()), pa.int64()), "vocabulary": one(int((n_v > 0).sum()), pa.int64()), "counts": pa.array([_packed([*words[i], *pairs[i]]) for i in back], pa.binary())})


def _windows(start: np.ndarray, n: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents whose sentences begin at ``start``: how many windows each has, where these begin and end."""
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - width) // stride)), 0)
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = np.repeat(start, many) + within * stride
    return many, begin, np.minimum(begin + width, np.repeat(start + n, many))


def _tells(buckets: int, width: int, stride: int):
    def tell(batch: pa.Table, counts: pa.Table) -> pa.Table:
        """Each text's sentences with their paragraph's words and losses, and its windows' losses."""
        said, per = _flat(batch.column("said"))
        para = pc.list_flatten(batch.column("para")).to_numpy()
        parts, sizes = _split(said)
        names, code = _coded(parts)
        doc, sent = np.repeat(np.arange(batch.num_rows), per), np.repeat(np.arange(len(sizes)), sizes)
        lists = _Lists(names, code, doc[sent], buckets)
        if batch.num_rows and not np.array_equal(np.sort(counts.column("bucket").to_numpy()), np.arange(buckets)):
            raise ValueError("a batch needs one answer of each bucket")
        counts = counts.sort_by("bucket")
        got = [np.concatenate([np.zeros(0, np.int64), *map(_numbers, x)]) for x in zip(*(_unpacked(x.as_py()) for x in counts.column("counts")), strict=True)] or [np.zeros(0, np.int64)] * 3
        divisor = (pc.sum(counts.column("total")).as_py() or 0) + (pc.sum(counts.column("vocabulary")).as_py() or 0) + 1
        n_w, n_v, n_wv = np.empty(len(names)), np.empty(len(names)), np.empty(len(lists.pair))
        n_w[lists.words], n_v[lists.words], n_wv[lists.pairs] = got
        q = (n_v[lists.v] + 1) / divisor
        losses = [(np.log(n_w[lists.w] + 1) - np.log(n_wv + q))[lists.back], -np.log(q)[lists.back]]

        # Losses within a sentence, and those at the cut after it.
        at, n = sent[lists.place], len(sizes)
        cut = sent[lists.place + 1] != at
        inner, joint = ([np.bincount(at[x], weights=y[x], minlength=n) for y in losses] for x in (~cut, cut))
        many, begin, end = _windows(np.cumsum(per) - per, per, width, stride)
        over = [np.zeros(len(begin)) for _ in losses]
        for k in range(width):
            i = np.minimum(begin + k, max(n - 1, 0))
            for x, own, between in zip(over, inner, joint, strict=True):
                if n:
                    x += np.where(begin + k < end, own[i], 0.0) + np.where(begin + k + 1 < end, between[i], 0.0)
        new = (doc[1:] != doc[:-1]) | (para[1:] != para[:-1])
        group = np.r_[np.zeros(min(n, 1), np.int64), np.cumsum(new)]
        goes_on = np.r_[~new, np.zeros(min(n, 1), bool)]
        whole = [np.bincount(group, weights=x + np.where(goes_on, y, 0.0))[group] if n else x for x, y in zip(inner, joint, strict=True)]
        words = np.bincount(group, weights=sizes)[group].astype(np.int64) if n else sizes

        listed = lambda x, each: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)].astype(np.int32)), pa.array(x))
        kept = {c: batch.column(c) for c in ("doc_id", "sentence", "para")}
        return pa.table(kept | {"words": listed(words, per), "a": listed(whole[0], per), "b": listed(whole[1], per), "wa": listed(over[0], many), "wb": listed(over[1], many)})

    return tell


def losses_of_sentences(docs: DataFrame, corpus: DataFrame, prose: Column, cut: Column, width: int, stride: int) -> DataFrame:
    """(doc_id, sentence, para, words, a, b, wa, wb) of ``docs`` (doc_id, text), by models counted in ``corpus`` (text).

    ``prose`` makes an array of paragraphs of ``text`` and ``cut`` one of (para_idx, sentence), the same words in the same
    order: to ask, no sentences are needed. The arrays but the last two are by sentence: itself, its
    paragraph, and that paragraph's words and sums of losses; wa and wb are the sums of windows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("text").sameSemantics(corpus)
    size = lambda df: df.agg(F.sum(F.length("text"))).first()[0] or 0
    n = (size(docs) + (0 if own else size(corpus))) // BATCH + 1
    dealt = lambda key: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    # The one exchange of texts is read twice, by what asks and by what is told; both take doc_id, else it would be made twice.
    texts = docs.select("doc_id", "text", dealt("doc_id").alias("batch")).repartition(n, "batch")
    none = F.array().cast("array<string>")
    lowered = F.transform(F.coalesce(prose, none), F.lower).alias("said")
    asking = texts.select("batch", "doc_id", F.lower("text").alias("counted") if own else F.lit(None).cast("string").alias("counted"), lowered)
    if not own:
        # Batches of the corpus ask for nothing; their numbers are below zero.
        more = corpus.select("text", (-1 - dealt("text")).alias("batch")).repartition(n, "batch")
        asking = asking.unionByName(more.select("batch", F.lit(None).cast(kind).alias("doc_id"), F.lower("text").alias("counted"), none.alias("said")))
    lists = asking.groupBy("batch").applyInArrow(_asks(n), "bucket int, batch int, lists binary")
    counts = lists.repartition(n, "bucket").groupBy("bucket").applyInArrow(_adds, "batch int, bucket int, total long, vocabulary long, counts binary")
    sentences = texts.withColumn("cut", F.coalesce(cut, F.array().cast("array<struct<para_idx:int,sentence:string>>")))
    told = sentences.select("batch", "doc_id", F.transform("cut", lambda x: F.lower(x["sentence"])).alias("said"), F.transform("cut", lambda x: x["sentence"]).alias("sentence"), F.transform("cut", lambda x: x["para_idx"]).alias("para"))
    schema = f"doc_id {kind}, sentence array<string>, para array<int>, words array<long>, a array<double>, b array<double>, wa array<double>, wb array<double>"
    return told.groupBy("batch").cogroup(counts.repartition(n, "batch").groupBy("batch")).applyInArrow(_tells(n, width, stride), schema)
