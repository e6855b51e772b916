"""Quality classifier from weak labels.

Eight heuristic labellers look at a text's shape (symbols, capitals, repeats, line ends, word lengths...) and vote
good, bad or abstain. Expectation-maximisation (Dawid and Skene) estimates from all texts how often each labeller
gives each vote to good and to bad texts, and so a posterior for each pattern of votes: as votes are few, the texts
are first summed to one row a pattern (at most 3**8), which the driver holds. The posteriors then are the labels of
a linear scorer over hashed features of word shapes, which is trained on a bounded sample (``max_rows``) and scores
every text.

Distribution. One pass votes, one collects the sample's features (only of rows that can be drawn), one scores;
nothing but the sums is shuffled.

Cases. Null or empty text, or one without words: score 0, rejected. A text of so few words that no labeller votes:
the prior. Ties: a score of exactly the threshold is kept.
Empty table: no rows. Texts are read whole, however long; repeated rows give repeated results, and are drawn for the
sample together, which its bound then cuts. Columns that are not kept are ignored; a kept one of an added one's name
gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, mix, nested, pieces_of, session_setup, text_or_empty, unnested, utf8, with_added, words

GOOD, BAD, ABSTAIN = 1, 0, 2
#: (name, bad at or above or None, good at or below or None, smallest number of words for a vote)
LABELLERS = (
    ("symbols", 0.05, 0.005, 4),
    ("capitals", 0.4, 0.15, 4),
    ("repeats", 0.25, 0.08, 8),
    ("sameness", 0.7, 0.55, 30),
    ("bare_symbols", 0.1, 0.01, 4),
    ("open_lines", 0.6, 0.34, 4),
    ("long_words", 0.2, 0.05, 4),
    ("shouts", 0.1, 0.01, 4),
)
LEAST_WORDS = min(least for *_, least in LABELLERS)
_KIND = np.full(256, ord("a"), np.uint8)
_KIND[:128] = np.frombuffer(bytes(ord("A") if chr(i).isupper() else ord("a") if chr(i).isalpha() else ord("0") if chr(i).isdigit() else ord(" ") if i < 33 else i for i in range(128)), np.uint8)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:?'\"()-@+="]] = True
_UPPER, _LETTER, _CONTINUED = (_KIND == ord("A")), (_KIND == ord("A")) | (_KIND == ord("a")), (np.arange(256) & 0xC0) == 0x80
N_BITS = 14
#: So many words' worth of the prior goes into every score, so that a few odd words do not condemn a short text.
SMOOTH = 6


class _Shape:
    """What the labellers and the scorer see of some whole texts."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.n = len(ends) - 1
        self.ends = ends
        h, before = words(data, ends)
        self.hash, self.before = h, before
        self.words = np.diff(before)
        self.of = np.repeat(np.arange(self.n), self.words)
        inside = ~SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = ends[(ends > 0) & (ends < len(data))]
        first[cuts] = inside[cuts]
        self.starts = np.flatnonzero(first)
        self.kind = _KIND[data]
        self.data = data

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[self.ends[1:]] - total[self.ends[:-1]]

    def per_word(self, flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int32), self.starts) if len(self.starts) else np.zeros(0, np.int32)

    def by_text(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.of[flags], minlength=self.n)

    def values(self) -> dict[str, np.ndarray]:
        letters = _LETTER[self.data] & ~_CONTINUED[self.data]
        chars = np.maximum(self.per_text(~SPACE[self.data] & ~_CONTINUED[self.data]), 1)
        n = np.maximum(self.words, 1)
        symbol = _SYMBOL[self.data]
        again = np.zeros(len(self.hash), bool)
        again[1:] = (self.hash[1:] == self.hash[:-1]) & (self.of[1:] == self.of[:-1])
        distinct = np.bincount(np.unique(np.stack([self.of.astype(np.uint64), self.hash]), axis=1)[0].astype(np.int64), minlength=self.n) if len(self.hash) else np.zeros(self.n)
        in_word, letters_in = self.per_word(~SPACE[self.data] & ~_CONTINUED[self.data]), self.per_word(letters)
        marks = self.per_word(symbol)
        break_ = np.r_[self.data == 10, False]
        last = self.ends[1:][np.diff(self.ends) > 0]
        line_end = break_[:-1].copy()
        closed = np.zeros(len(self.data), bool)
        stop = np.isin(self.data, np.frombuffer(b".!?\"')", np.uint8))
        closed[1:] = stop[:-1] & line_end[1:]
        lines, good = self.per_text(line_end), self.per_text(closed)
        filled = np.diff(self.ends) > 0
        lines[filled] += 1
        good[filled] += stop[last - 1]
        return {
            "symbols": self.per_text(symbol) / chars,
            "capitals": self.per_text(_UPPER[self.data]) / np.maximum(self.per_text(letters), 1),
            "repeats": self.by_text(again) / n,
            "sameness": 1 - distinct / n,
            "bare_symbols": self.by_text((letters_in == 0) & (marks > 0)) / n,
            "open_lines": 1 - good / np.maximum(lines, 1),
            "long_words": self.by_text(in_word > 30) / n,
            "shouts": self.by_text((marks > 0) & (letters_in > 0)) / n,
        }

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """A hashed shape of each word, with whether it repeats the one before and ends a line: (place, text)."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.kind
        change = np.ones(len(kind), bool)
        change[1:] = (kind[1:] != kind[:-1]) | SPACE[self.data[1:]]
        change[self.starts] = True
        used = change & ~SPACE[self.data]
        at = np.cumsum(used) - 1
        place = np.arange(len(kind)) - np.repeat(np.r_[0, self.starts], np.diff(np.r_[0, self.starts, len(kind)]))
        step = at - at[np.repeat(np.r_[0, self.starts], np.diff(np.r_[0, self.starts, len(kind)]))]
        term = (kind.astype(np.uint64) + np.uint64(1)) * (np.minimum(step, 7).astype(np.uint64) * np.uint64(2654435761) + np.uint64(97))
        term[~used | (place < 0)] = 0
        shape = np.add.reduceat(term, self.starts)
        again = np.zeros(len(self.hash), np.uint64)
        again[1:] = (self.hash[1:] == self.hash[:-1]) & (self.of[1:] == self.of[:-1])
        return (mix(shape * np.uint64(2) + again) >> np.uint64(64 - N_BITS)).astype(np.int64), self.of


def _shapes(column: pa.Array):
    data, ends = utf8(column)
    for a, b in pieces_of(ends, 1 << 18):
        yield _Shape(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])


def cast_votes(shape: _Shape) -> np.ndarray:
    """One row a text, one column a labeller."""
    values, out = shape.values(), np.full((shape.n, len(LABELLERS)), ABSTAIN, np.int64)
    for k, (name, bad, good, least) in enumerate(LABELLERS):
        v, enough = values[name], shape.words >= least
        out[enough & (v <= good), k] = GOOD
        out[enough & (v >= bad), k] = BAD
    return out


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(pattern, n): how many texts got each pattern of votes, over all texts. Texts without words have none."""

    def work(batches):
        for batch in batches:
            for shape in _shapes(batch.column(0)):
                u, n = np.unique(_pattern(cast_votes(shape))[shape.words > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["pattern", "n"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(work, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, vote probabilities [class, labeller, vote], prior of good)."""
    votes = patterns[:, None] // (3 ** np.arange(len(LABELLERS))) % 3
    good, bad = (votes == GOOD).sum(axis=1), (votes == BAD).sum(axis=1)
    # One plain defect is enough for a first guess: most labellers are blind to most kinds of bad text.
    post = np.where(bad > 0, 0.1, np.where(good > 0, 0.95, 0.5))
    chance = np.zeros((2, len(LABELLERS), 3))
    prior = 0.5
    for _ in range(rounds):
        prior = float((post * counts).sum() + 1) / (counts.sum() + 2)
        for c, weight in ((GOOD, post * counts), (BAD, (1 - post) * counts)):
            for k in range(len(LABELLERS)):
                chance[c, k] = np.bincount(votes[:, k], weights=weight, minlength=3) + 0.5
            chance[c] /= chance[c].sum(axis=1, keepdims=True)
        log = [np.log(p) + np.log(chance[c][np.arange(len(LABELLERS)), votes]).sum(axis=1) for c, p in ((BAD, 1 - prior), (GOOD, prior))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post, chance, prior


def fit(docs: DataFrame, max_rows: int = 4000, seed: int = 3) -> dict:
    """Labellers' accuracies from all of ``docs`` and the scorer's weights from at most ``max_rows`` of them."""
    session_setup(docs.sparkSession)
    table = vote_patterns(docs).toArrow()
    patterns, counts = table.column("pattern").to_numpy(), table.column("n").to_numpy()
    if not len(patterns):
        return {"weights": np.zeros(1 << N_BITS), "bias": 0.0, "chance": None, "prior": 0.5}
    post, chance, prior = expectation_maximisation(patterns, counts)
    of = np.full(3 ** len(LABELLERS), np.nan)
    of[patterns] = post
    bad, good = float(((1 - post) * counts).sum()), float((post * counts).sum())
    # A tenth of room, so that the bound seldom cuts.
    share_bad, share_good = 0.45 * max_rows / max(bad, 1.0), 0.45 * max_rows / max(good, 1.0)

    def pick(batches):
        for batch in batches:
            label, at, tf, drawn, row = [], [], [], [], 0
            draw = batch.column(0).to_numpy()
            for shape in _shapes(batch.column(1)):
                p = of[_pattern(cast_votes(shape))]
                share = np.where(p < 0.5, share_bad, share_good)
                f, whose = shape.features()
                for i in np.flatnonzero((shape.words > 0) & (draw[row : row + shape.n] < share)):
                    u, n = np.unique(f[shape.before[i] : shape.before[i + 1]], return_counts=True)
                    label.append(float(p[i]))
                    drawn.append(float(draw[row + i]))
                    at.append(u.astype(np.int32))
                    tf.append((n / (shape.words[i] + SMOOTH)).astype(np.float32))
                row += shape.n
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.float64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.float32())), pa.array(drawn, pa.float64())], ["label", "at", "tf", "draw"])

    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    possible = docs.select(draw.alias("draw"), text_or_empty().alias("text")).where(F.col("draw") < max(share_bad, share_good))
    sample = possible.mapInArrow(pick, "label double, at array<int>, tf array<float>, draw double").orderBy("draw").limit(max_rows).toArrow().to_pydict()
    weights, bias = _logistic(sample["at"], sample["tf"], np.array(sample["label"]))
    return {"weights": weights, "bias": bias, "chance": chance, "prior": prior}


def _logistic(at: list, tf: list, label: np.ndarray, rounds: int = 400, rate: float = 2.0, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch adaptive gradient steps, classes weighted evenly."""
    w, bias = np.zeros(1 << N_BITS), 0.0
    if not len(label):
        return w, bias
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    col, x = np.concatenate([np.asarray(a, np.int64) for a in at]), np.sqrt(np.concatenate([np.asarray(a, float) for a in tf]))
    weight = np.where(label >= 0.5, 0.5 / max((label >= 0.5).sum(), 1), 0.5 / max((label < 0.5).sum(), 1))
    seen, seen_bias = np.full(len(w), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=x * w[col], minlength=len(at)) + bias, -30, 30)))
        g = (p - label) * weight
        step = np.bincount(col, weights=x * g[row], minlength=len(w)) + l2 * w
        seen += step * step
        seen_bias += g.sum() ** 2
        w -= rate * step / np.sqrt(seen)
        bias -= rate * g.sum() / np.sqrt(seen_bias)
    return w, float(bias)


def score(docs: DataFrame, keep: list[str], model: dict, threshold: float = 0.5) -> DataFrame:
    """``keep`` columns of ``docs`` with score (probability of good) and kept."""
    session_setup(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"], float(np.log(model["prior"] / (1 - model["prior"])))))

    def work(batches):
        w, bias, prior = sent.value
        for batch in batches:
            out = []
            for shape in _shapes(batch.column(batch.num_columns - 1)):
                f, whose = shape.features()
                # square roots of term frequencies need the counts of each place in each text
                pair, n = np.unique((whose << N_BITS) | f, return_counts=True)
                of, place = pair >> N_BITS, pair & ((1 << N_BITS) - 1)
                value = np.bincount(of, weights=w[place] * np.sqrt(n / (shape.words + SMOOTH)[of]), minlength=shape.n) + bias
                sure = np.where(shape.words >= LEAST_WORDS, shape.words / (shape.words + SMOOTH), 0.0)
                value = value * sure + prior * (1 - sure)
                out.append(np.where(shape.words > 0, 1 / (1 + np.exp(-np.clip(value, -30, 30))), 0.0))
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array(p >= threshold)], [*batch.schema.names[:-1], "score", "kept"])

    picked = nested(docs, keep, text_or_empty().alias("_text"))
    return unnested(picked.mapInArrow(work, with_added(picked, "score double, kept boolean")), keep, ["score", "kept"])
