"""Interleaved document sequences with media columns.

HTML is parsed into an ordered sequence of structs: runs of text, and references to media by digest with their
captions. Media are stored once a batch as grey 8-bit PNG files of 64 samples a row, named by the SHA-256 of their
payload. A join on the digest resolves references; each item keeps its position and caption, so that sequences can
be put together again in order. Payloads are never shuffled: what is joined is what was read from a stored file.

Rules of parsing. Block elements end a run of text, inline ones and line breaks do not; runs of ASCII white space are
one space. A medium's caption is that of the nearest enclosing figure that has one, wherever in the figure it stands
(it counts for all media of the figure), or else its alternative text. Audio and video are one item each, with the
first source of theirs. End tags that HTML lets go may be missing. Scripts, styles, titles and templates are left out.

Cases. Null or empty text or HTML: an empty sequence, and a payload of 64 zero bytes. Empty tables: no rows.
References without a stored file stay, unresolved (null). Equal payloads have equal digests, files and features; of
files that tie in digest any one is read, as they are equal. Repeated rows stay repeated. Very long texts and pages
are taken whole. Columns that are not kept are ignored; a kept one of an added one's name gives way to it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nested, session_setup, unnested, with_added

WIDTH = 64
SCHEME = "sha256:"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_HIDDEN = {"script", "style", "title", "noscript", "template"}
_BLANK = re.compile("[ \t\n\f\r]+")
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "u", "var"}
ITEM = "struct<position int, kind string, text string, src string, digest string, caption string>"


# Stored form ----------------------------------------------------------------------------------------------------


def payload(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and zeros up to a positive multiple of 64."""
    data = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(data)
    pad = F.when(size == 0, F.lit(WIDTH)).otherwise((WIDTH - size % WIDTH) % WIDTH)
    return F.concat(data, F.substring(F.unhex(F.lit("00" * WIDTH)), F.lit(1), pad))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(data: bytes) -> bytes:
    """A grey 8-bit PNG of 64 samples a row."""
    samples = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)
    rows[:, 1:] = samples
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def samples_of(stored: bytes) -> bytes:
    """The samples of a PNG that ``png`` made; checks every chunk."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, height = 8, [], 0
    while at < len(stored):
        size = struct.unpack_from(">I", stored, at)[0]
        kind, data = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", stored, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", data)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not a grey 8-bit file of 64 samples a row")
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, WIDTH + 1)
    return rows[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Shape, mean, deviation, entropy in bits and sixteenths' counts of 8-bit samples."""
    x = np.frombuffer(data, np.uint8)
    n = np.bincount(x, minlength=256)
    value = np.arange(256)
    mean = float((n * value).sum() / len(x))
    var = float((n * (value - mean) ** 2).sum() / len(x))
    p = n[n > 0] / len(x)
    return f"{len(x) // WIDTH}x{WIDTH};mean={mean:.6f};std={var**0.5:.6f};entropy={float(-(p * np.log2(p)).sum()):.6f};hist=" + ".".join(map(str, n.reshape(16, 16).sum(axis=1)))


def stored(payloads: DataFrame) -> DataFrame:
    """(digest, media) from a column payload: PNG files, each payload once a batch."""
    session_setup(payloads.sparkSession)

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                seen = {hashlib.sha256(x).hexdigest(): x for x in batch.column(0).slice(at, 250).to_pylist() if x is not None}
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([png(x) for x in seen.values()], pa.binary())], ["digest", "media"])

    return payloads.select("payload").mapInArrow(work, "digest string, media binary")


def features(media: DataFrame) -> DataFrame:
    """What reading the stored files back gives: one row a digest, without the payloads."""

    def work(batches):
        for batch in batches:
            rows = []
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = samples_of(data)
                rows.append((digest, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(x)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    read = media.select("digest", "media").mapInArrow(work, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.groupBy("digest").agg(*[F.first(x).alias(x) for x in names[1:]])


# Sequences ------------------------------------------------------------------------------------------------------


def _squeezed(parts: list[str]) -> str | None:
    return _BLANK.sub(" ", "".join(parts)).strip(" ") or None


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden: list[str] = []
        #: Open figures, each the text of its caption; ``captioned`` is the one whose caption is being read.
        self.figures: list[list[str]] = []
        self.captioned: list[str] | None = None
        self.player: dict | None = None
        self.figures_of: list[tuple[dict, list[list[str]]]] = []

    def flush(self):
        said, self.text = _squeezed(self.text), []
        if said:
            self.items.append({"position": len(self.items), "kind": "text", "text": said, "src": None, "digest": None, "caption": None})

    def medium(self, src: str | None, alt: str | None) -> dict:
        self.flush()
        item = {"position": len(self.items), "kind": "media", "text": None, "src": None, "digest": None, "caption": _squeezed([alt or ""])}
        self.items.append(item)
        self.figures_of.append((item, self.figures[::-1]))
        self.refer(item, src)
        return item

    @staticmethod
    def refer(item: dict, src: str | None):
        item["src"] = src or None
        item["digest"] = src.removeprefix(SCHEME) if src and src.startswith(SCHEME) else None

    def gap(self):
        if self.captioned is None:
            self.flush()
        else:
            self.captioned.append(" ")

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden.append(tag)
        elif self.hidden:
            return
        elif tag == "img":
            self.medium(dict(attrs).get("src"), dict(attrs).get("alt"))
        elif tag in ("audio", "video"):
            self.player = self.medium(dict(attrs).get("src"), dict(attrs).get("title"))
        elif tag == "source":
            if self.player is not None and self.player["src"] is None:
                self.refer(self.player, dict(attrs).get("src"))
        elif tag == "br":
            (self.text if self.captioned is None else self.captioned).append(" ")
        elif tag == "figure":
            self.flush()
            self.captioned = None
            self.figures.append([])
        elif tag == "figcaption" and self.figures:
            self.captioned = self.figures[-1]
            self.captioned.append(" ")
        elif tag not in _INLINE:
            self.gap()

    def handle_endtag(self, tag):
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]
        elif self.hidden or tag in ("br", "source"):
            return
        elif tag == "figcaption":
            self.captioned = None
        elif tag == "figure":
            self.flush()
            self.captioned = None
            self.figures = self.figures[:-1]
        elif tag in ("audio", "video"):
            self.player = None
        elif tag not in _INLINE and tag != "img":
            self.gap()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.captioned is None else self.captioned).append(data)

    def finish(self) -> list[dict]:
        self.close()
        self.flush()
        for item, figures in self.figures_of:
            item["caption"] = next(filter(None, map(_squeezed, figures)), item["caption"])
        return self.items


def parse(html: str | None) -> list[dict]:
    """Ordered items of a page: text, and media with reference, digest (null if it is none) and caption."""
    seq = _Sequence()
    seq.feed(html or "")
    return seq.finish()


def sequences(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``pages`` (which has html) with items, an array of ordered structs."""
    session_setup(pages.sparkSession)
    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("src", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                items = [parse(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.list_(item))], ["_keep", "items"])

    picked = nested(pages, keep, F.col("html").cast("string").alias("html"))
    return unnested(picked.mapInArrow(work, with_added(picked, f"items array<{ITEM}>")), keep, ["items"])


def resolved(seqs: DataFrame, keep: list[str], media: DataFrame) -> DataFrame:
    """One row an item: ``keep`` columns, position, kind, text, src, digest, caption and ``media``'s columns by digest.

    A plain join, so that a digest many documents share is split by adaptive execution. Items without a digest are
    dealt out instead of meeting in one task; where their texts need not be joined, filter ``items`` before.
    """
    names = ["position", "kind", "text", "src", "digest", "caption"]
    more = [c for c in media.columns if c != "digest"]
    items = nested(seqs, keep, F.inline("items"))
    dealt = F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("_keep", "position").cast("string")))
    out = items.withColumn("_by", dealt).join(media.withColumnRenamed("digest", "_by"), "_by", "left")
    return unnested(out, [c for c in keep if c not in more], [*names, *more])


def assembled(items: DataFrame, key: str) -> DataFrame:
    """Resolved items put together again: one row a ``key``, items in order of position."""
    names = [c for c in items.columns if c not in (key, "position")]
    return items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", *names))).alias("items"))
