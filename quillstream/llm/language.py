"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are runs of one to three characters, lower-cased, with every non-letter a space, hashed to ``2**bits``
places; term frequency is the share of the text's n-grams, inverse document frequency comes from all training
texts. The weights are learned by follow-the-regularised-leader with elastic-net penalties (McMahan et al.), which
leaves most of them at exactly zero, on a bounded sample of labelled rows: ``max_rows`` in all, shared evenly by the
languages, every fifth of them kept for choosing the temperature that calibrates the probabilities.

Distribution. One pass sums document frequencies (a row a feature and task), one collects the sample's sparse
features, one predicts with the broadcast weights; texts are never shuffled.

Cases. Null text, or no letter in it: ``und`` with score 0. No labelled training row: ``und`` everywhere. Empty table:
no rows. Ties go to the language that comes first in order. Texts are read whole, however long; repeated rows give
repeated results, and are drawn for the sample together, which its bound then cuts. There is a row a language on the
driver: languages number some hundreds. Columns that are not kept are ignored; a kept one of an added one's name
gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nested, session_setup, text_or_empty, unnested, with_added

SCALE = 30.0
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    if not _letters:
        table = np.arange(0x110000, dtype=np.uint32)
        table[~np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)] = 0
        _letters.append(table)
    return _letters[0]


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, in order of text; how many each has; whether it has a letter."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in low])
    code = _letter_table()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    of = np.repeat(np.arange(len(low)), sizes)
    multiply = np.uint32(0x9E3779B1)
    parts, whose, h = [], [], np.zeros(0)
    for n in (1, 2, 3):
        h = code * multiply if n == 1 else (h[:-1] ^ (code[n - 1 :] + np.uint32(n))) * multiply
        h = h ^ (h >> np.uint32(15))
        same = of[: len(h)] == of[n - 1 :] if n > 1 else np.ones(len(h), bool)
        own = same & (code[: len(h)] > 0 if n == 1 else True)
        parts.append((h[own] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))
        whose.append(of[: len(h)][own])
    lettered = np.bincount(of[code > 0], minlength=len(low)) > 0 if len(low) else np.zeros(0, bool)
    f, w = np.concatenate(parts), np.concatenate(whose)
    order = np.argsort(w, kind="stable")
    return f[order], np.bincount(w, minlength=len(low)), lettered


def _blocks(column: pa.Array, size: int = 64):
    for at in range(0, len(column), size):
        yield column.slice(at, size).to_pylist()


def document_frequencies(docs: DataFrame, bits: int) -> DataFrame:
    """(feature, n): the number of texts that have the feature, over all texts."""

    def count(batches):
        seen = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for texts in _blocks(batch.column(0)):
                f, n, _ = grams(texts, bits)
                for row in np.split(f, np.cumsum(n)[:-1]):
                    seen[np.bincount(row, minlength=1 << bits) > 0] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["feature", "n"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _sparse(docs: DataFrame, bits: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            at, times = [], []
            for texts in _blocks(batch.column(2)):
                f, n, _ = grams(texts, bits)
                for row in np.split(f, np.cumsum(n)[:-1]):
                    u, c = np.unique(row, return_counts=True)
                    at.append(u.astype(np.int32))
                    times.append((c / max(len(row), 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.float32()))], ["lang", "place", "at", "tf"])

    return docs.select("lang", "place", text_or_empty().alias("text")).mapInArrow(work, "lang string, place long, at array<int>, tf array<float>")


def ftrl(rows: list, labels: np.ndarray, n_classes: int, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002, epochs: int = 6, seed: int = 5) -> np.ndarray:
    """Weights (size x classes) by per-coordinate follow-the-regularised-leader on sparse rows (places, values)."""
    z, n = np.zeros((size, n_classes)), np.zeros((size, n_classes))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - s * w
            n[at] = ni + g * g
    return weights(z, n)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that gives held-out labels the least mean log loss, by golden section."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    a, b, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    while b - a > 1e-3:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(training: DataFrame, bits: int = 15, max_rows: int = 3000, seed: int = 11) -> dict:
    """Model from ``training`` (doc_id, text, lang); rows without lang are ignored."""
    session_setup(training.sparkSession)
    labelled = training.where("lang is not null")
    df = document_frequencies(labelled, bits).toArrow()
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "weights": np.zeros((1 << bits, 0), np.float32), "bits": bits, "temperature": 1.0}
    idf = np.full(1 << bits, np.log(1.0 + sum(sizes.values())))
    idf[df.column("feature").to_numpy()] = np.log((1.0 + sum(sizes.values())) / (1.0 + df.column("n").to_numpy())) + 1e-2
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40))
    # A tenth of room, so that the bound seldom cuts.
    each = max(1, 0.9 * max_rows / len(langs))
    shares = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, each / sizes[k]) * (1 << 40)))])
    drawn = labelled.select("lang", place.alias("place"), "text").where(F.col("place") < shares[F.col("lang")])
    sample = _sparse(drawn, bits).orderBy("place", "lang").limit(max_rows).toArrow().to_pydict()
    order = np.argsort([f"{k}{len(a)}{a[:8]}" for k, a in zip(sample["lang"], sample["at"], strict=True)], kind="stable")
    rows, labels = [], []
    for i in order:
        at = np.array(sample["at"][i], dtype=np.int64)
        rows.append((at, np.array(sample["tf"][i]) * idf[at] * SCALE))
        labels.append(langs.index(sample["lang"][i]))
    labels = np.array(labels, dtype=np.int64)
    held = np.arange(len(rows)) % 5 == 4
    w = ftrl([r for r, h in zip(rows, held, strict=True) if not h], labels[~held], len(langs), 1 << bits)
    logits = np.array([r[1] @ w[r[0]] for r, h in zip(rows, held, strict=True) if h]).reshape(-1, len(langs))
    return {"langs": langs, "weights": (w * idf[:, None] * SCALE).astype(np.float32), "bits": bits, "temperature": temperature(logits, labels[held])}


def predict(docs: DataFrame, keep: list[str], model: dict) -> DataFrame:
    """``keep`` columns of ``docs`` (which has text) with lang_pred and score, the calibrated probability."""
    session_setup(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = sent.value
        names, w, bits = np.array([*m["langs"], "und"], dtype=object), m["weights"], m["bits"]
        columns = [np.ascontiguousarray(w[:, k]) for k in range(w.shape[1])]
        for batch in batches:
            best, score = [], []
            for texts in _blocks(batch.column(batch.num_columns - 1)):
                f, n, lettered = grams(texts, bits)
                logits = np.zeros((len(texts), len(columns)))
                some = np.flatnonzero(n)
                first = (np.cumsum(n) - n)[some]
                if len(some):
                    for k, c in enumerate(columns):
                        logits[some, k] = np.add.reduceat(c[f], first, dtype=np.float64) / n[some]
                ok = lettered & bool(columns)
                p = _softmax(logits / m["temperature"]) if columns else np.zeros((len(texts), 1))
                best.append(np.where(ok, p.argmax(axis=1), len(columns)))
                score.append(np.where(ok, p.max(axis=1), 0.0))
            best, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (best, score))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best.astype(np.int64)].tolist(), pa.string()), pa.array(score.astype(np.float64))], [*batch.schema.names[:-1], "lang_pred", "score"])

    picked = nested(docs, keep, text_or_empty().alias("_text"))
    return unnested(picked.mapInArrow(work, with_added(picked, "lang_pred string, score double")), keep, ["lang_pred", "score"])
