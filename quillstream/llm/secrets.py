"""Secret scans: patterns of known kinds, and random strings found by how badly a public vocabulary compresses them.

A byte-pair vocabulary spends few characters a token on random strings and many on words. Runs of letters,
digits and + / _ = - of ``least`` characters or more that have a letter and come to at most ``ratio`` characters a
token are reported as kind ``random``; of other runs, and of those within addresses of the web, each part between
separators is tested likewise. Not reported are bare letters of one case or capitalised (rare long words compress as
badly), known digests (bare hexadecimal of a digest's length), UUIDs, what lies within an e-mail address, and what
overlaps a span of the other kinds.

Cases. Null or empty text: no spans. Empty table: no rows. Offsets are code points, end exclusive. Spans that begin
together come in the order of kinds; of random ones that would overlap, the whole run counts. Every text is scanned
whole, however long, row by row and without a shuffle; repeated rows give repeated results. Columns that are not kept
are ignored; a kept one of an added one's name gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import nested, session_setup, text_or_empty, unnested, with_added

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Whole runs, so asking for the length at once finds the same spans as dropping short ones.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PART = re.compile(r"[A-Za-z0-9+]+")
#: Addresses of the web: in them only parts between separators are tested, as the whole is no run of its own.
_WEB = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s<>\"']+")
#: E-mail addresses and UUIDs: runs within them are not tested.
_PLAIN = (
    re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])"),
)
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGESTS = {32, 40, 56, 64, 96, 128}
_HINTS = ("passw", "secret", "token", "api")


def tokenizer(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks; no special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known kinds, by start and then kind."""
    spans = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def random_spans(text: str, taken: list[tuple[int, int, str]], encode, ratio: float, least: int) -> list[tuple[int, int, str]]:
    """Runs, or else parts of them between separators, that the vocabulary compresses badly, outside ``taken``."""
    found, plain, web = [], None, []

    def is_random(start: int, end: int) -> bool:
        run = text[start:end]
        if end - start < least or not any(c.isalpha() for c in run) or any(a < end and start < b for a, b, _ in taken):
            return False
        # Letters of one case, or capitalised, may be a long word that the vocabulary does not know.
        if run.isalpha() and (run.isupper() or run[1:].islower()):
            return False
        if len(run) in _DIGESTS and all(c in "0123456789abcdefABCDEF" for c in run):
            return False
        return len(run) <= ratio * len(encode(run))

    for m in _RUN.finditer(text):
        if m.end() - m.start() < least:
            continue
        if plain is None:
            plain = [x.span() for p in _PLAIN for x in p.finditer(text)]
            web = [x.span() for x in _WEB.finditer(text)] if "://" in text else []
        if any(a <= m.start() and m.end() <= b for a, b in plain):
            continue
        if not any(a <= m.start() and m.end() <= b for a, b in web) and is_random(m.start(), m.end()):
            found.append((m.start(), m.end(), "random"))
            continue
        for part in _PART.finditer(text, m.start(), m.end()):
            if is_random(part.start(), part.end()):
                found.append((part.start(), part.end(), "random"))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by a mark of the first one's kind."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, keep: list[str], ranks: str, pattern: str, ratio: float = 2.0, least: int = 16, redacted: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` (which has text) with the spans of each whole text.

    Adds n_assign, n_access, n_hex, n_random, base_sha256 (of the known kinds' spans as text), spans (all of them)
    and, if ``redacted``, the text with its secrets replaced.
    """
    session_setup(docs.sparkSession)

    def find(batches):
        enc = tokenizer(ranks, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                base = base_spans(text)
                more = random_spans(text, base, enc.encode_ordinary, ratio, least)
                spans = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
                kinds = [k for _, _, k in spans]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redact(text, spans) if redacted else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            names = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "redacted"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays[: 7 if redacted else 6]], [*batch.schema.names[:-1], *names[: 7 if redacted else 6]])

    picked = nested(docs, keep, text_or_empty().alias("_text"))
    added = ["n_assign long", "n_access long", "n_hex long", "n_random long", "base_sha256 string", "spans string", *["redacted string"][: int(redacted)]]
    return unnested(picked.mapInArrow(find, with_added(picked, ", ".join(added))), keep, [x.split()[0] for x in added])
