"""SentencePiece encoding and decoding with offsets into the original bytes.

The text is normalised here: at each place the longest prefix found in the model's compiled character map (a
double-array trie with a table of replacements) is replaced, and each normalised byte remembers the original byte
it came from. Merging normalised text into pieces is the library's; it gets a copy of the model whose own
normaliser does nothing. Where no piece has a space mark after another character, merges cannot cross from a
character to a space mark, so the text is cut there and repeated words are merged once. Every piece is then
projected through the alignment to the original bytes it covers.

Cases. Null or empty text: only the end id. Empty table: no rows. Characters outside the vocabulary become byte
pieces. Merges that tie go to the first, as in the library. Texts are encoded whole, however long; repeated rows give
repeated results. Columns that are not kept are ignored; a kept one of an added one's name gives way to it.
"""

from __future__ import annotations

import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nested, session_setup, text_or_empty, unnested, with_added

MARK = "▁"


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + size]
            at += size


def _field(number: int, value: bytes) -> bytes:
    size, out = len(value), bytearray([number << 3 | 2])
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes(out) + bytes([size]) + value


class CharacterMap:
    """A compiled character map: longest prefix to replacement."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4) if size else ()
        self.replacements = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] in the map and its replacement."""
        if not self.units:
            return None
        unit, node, best = self.units[0], 0, None
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.replacements[best[1] : self.replacements.index(b"\0", best[1])]


class Pieces:
    """Encoder of one model file."""

    def __init__(self, path: str, cached: int = 200_000):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        rest, spec, names, kinds, suffix = b"", b"", [], [], 0
        for number, value in _fields(model):
            if number == 3:
                spec = value
                continue
            if number == 1:
                piece = dict(_fields(value))
                names.append(piece[1].decode())
                kinds.append(piece.get(3, 1))
            elif number == 2:
                suffix = dict(_fields(value)).get(24, 0)
            rest += _field(number, value) if isinstance(value, bytes) else b""
        asked = dict(_fields(spec))
        if suffix or 4 in kinds:
            raise ValueError("models with user-defined pieces or space marks as suffixes are not supported")
        self.map = CharacterMap(asked.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(asked.get(k, 1)) for k in (3, 4, 5))
        self.merge = sentencepiece.SentencePieceProcessor(model_proto=rest + _field(3, b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"))
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = self.library.eos_id()
        #: Bytes of normalised text that each id covers; 0 for the end and -1 where it depends on the text.
        self.width = np.array([1 if k == 6 else -1 if k == 2 else 0 if k == 3 else len(n.encode()) for n, k in zip(names, kinds, strict=True)])
        self.marked = np.array([n.startswith(MARK) for n in names])
        self.cuttable = not any(MARK in n.lstrip(MARK) for n in names)
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, int] = {}
        self.flat, self.size, self.begin = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.cached = cached

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes, and its end, the original byte it begins at."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int32)
        space, mark = b" ", MARK.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:
            raw = np.frombuffer(data, np.uint8)
            wide = np.where(raw == 0x20, len(mark), 1)
            lead = len(mark) if self.prefix else 0
            origin = np.r_[np.zeros(lead, np.int64), np.repeat(np.arange(len(raw)), wide), len(raw)]
            plain = text.replace(" ", mark.decode())
            return (mark.decode() if self.prefix else "") + plain, origin
        parts, at = [], 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                lead = data[at]
                hit = (n := 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4), data[at : at + n]
            parts.append((at, hit[1]))
            at += hit[0]
        out, origin, gap = bytearray(), [], self.squeeze
        if self.prefix:
            begun = next((a for a, p in parts if not self.squeeze or p.strip(space)), 0)
            out += mark
            origin += [begun] * len(mark)
        for a, part in parts:
            for byte in part:
                if byte == 0x20 and self.squeeze and gap:
                    continue
                gap = byte == 0x20
                one = mark if gap else bytes([byte])
                out += one
                origin += [a] * len(one)
        end = len(data)
        while self.squeeze and out.endswith(mark):
            end = origin[-len(mark)]
            del out[-len(mark) :], origin[-len(mark) :]
        return out.decode(), np.array([*origin, end])

    def learn(self, new: list[str]) -> None:
        """Pieces of cut words, kept in one flat array. Words are merged many to a string, as cuts part merges."""
        plain, other = [], []
        for w in new:
            (plain if self.cuttable and w[0] == MARK and len(w) > 1 and w[1] != MARK else other).append(w)
        parts, sizes = [], []
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = np.array(self.merge.encode("".join(some)), np.int32)
            first = np.flatnonzero(self.marked[ids])
            if len(first) != len(some):
                other += some
                continue
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
            parts.append(ids)
            sizes.append(np.diff(np.r_[first, len(ids)]))
        for w, ids in zip(other, self.merge.encode(other, num_threads=1), strict=True):
            self.known[w] = len(self.known)
            parts.append(np.array(ids, np.int32))
            sizes.append(np.array([len(ids)]))
        if parts:
            self.flat = np.concatenate([self.flat, *parts])
            self.size = np.concatenate([self.size, *sizes])
            self.begin = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str], spans: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Ids of all texts, each with the end's, how many each text has, and where each id begins and ends.

        Places are bytes of the original text; they are None unless asked for.
        """
        normal = [self.normalise(t) for t in texts]
        cut = [self.cut.findall(n) if self.cuttable else [n] if n else [] for n, _ in normal]
        every = [*chain.from_iterable(cut)]
        if len(self.known) > self.cached:
            self.known, self.flat, self.size = {}, np.zeros(0, np.int32), np.zeros(0, np.int32)
        new = set(every).difference(self.known)
        if new:
            self.learn([*new])
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        n = self.size[at].astype(np.int64) if len(at) else np.zeros(0, np.int64)
        place = np.repeat((self.begin[at] if len(at) else n) - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ids = self.flat[place]
        last = np.cumsum([len(c) for c in cut], dtype=np.int64)
        to = np.r_[0, np.cumsum(n)][last]
        if not spans:
            return np.insert(ids, to, self.end), np.diff(np.r_[0, to]) + 1, None, None
        width = self.width[ids]
        if (width < 0).any():
            width = np.array([*chain.from_iterable(self._widths(w) for w in every)], np.int64)
        widths = np.insert(width, to, 0)
        begin = np.r_[0, np.cumsum([len(o) - 1 for _, o in normal])]
        counts = np.diff(np.r_[0, to]) + 1
        # Texts lie one after another, each with one more place for its end.
        row = np.repeat(np.arange(len(texts)), counts)
        ends = np.cumsum(widths) + row
        origin = np.concatenate([o for _, o in normal]) if normal else np.zeros(0, np.int64)
        starts = ends - widths
        return np.insert(ids, to, self.end), counts, origin[starts], origin[ends]

    def _widths(self, word: str) -> list[int]:
        return [len(p.surface.encode()) for p in self.merge.encode(word, return_type="proto").pieces]


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, keep: list[str], model: str, spans: bool = True) -> DataFrame:
    """``keep`` columns of ``docs`` (which has text) with ids and, if asked for, starts and ends (byte offsets)."""
    session_setup(docs.sparkSession)

    def work(batches):
        pieces = Pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                ids, counts, starts, ends = pieces.encode(part.column(part.num_columns - 1).to_pylist(), spans)
                arrays = [_lists(x, counts) for x in ([ids, starts, ends] if spans else [ids])]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], [*part.schema.names[:-1], *["ids", "starts", "ends"][: len(arrays)]])

    added = ["ids", "starts", "ends"] if spans else ["ids"]
    picked = nested(docs, keep, text_or_empty().alias("_text"))
    return unnested(picked.mapInArrow(work, with_added(picked, ", ".join(f"{c} array<int>" for c in added))), keep, added)


def decode(encoded: DataFrame, keep: list[str], model: str) -> DataFrame:
    """``keep`` columns with decoded: the text that the library's decode gives for ids (null ids: none)."""
    session_setup(encoded.sparkSession)

    def work(batches):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                texts = library.decode([x or [] for x in part.column(part.num_columns - 1).to_pylist()], num_threads=1) if part.num_rows else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*part.schema.names[:-1], "decoded"])

    picked = nested(encoded, keep, F.col("ids"))
    return unnested(picked.mapInArrow(work, with_added(picked, "decoded string")), keep, ["decoded"])
