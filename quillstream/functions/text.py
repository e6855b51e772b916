"""Rules on strings, as Column functions. Patterns are literals, so that Catalyst folds them.

Three classes of white space, alphanumerics and digits are spelled out to mean what Unicode says, as the engine's
``\\s`` and ``\\d`` are ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these exact lists and numbers.
MIN_PROSE_WORDS = 25
SAMPLE_MIN_WORDS, SAMPLE_MAX_WORDS = 60, 260
NOTE_STARTS = (
    "NOTES", "Verdict", "Analysis:", "Criticism", "Mini-conclusion", "Tool definition", "Why chosen", "Overall synthesis", "Force =", "POINTS", "Safest", "Moderate",
)
END_HEADINGS = ("bibliography", "works cited", "references")
SKIP_SECTIONS = ("table of contents", "contents")
META_MARKERS = (
    "we need to", "let's", "let me", "i need to", "i should", "i'll write", "the user", "as an ai", "here is", "here's", "sure,", "certainly,", "okay,", "first, i", "no title", "word count", "i cannot", "i can't",
)
CAPTION = r"(?i)^(?:Figure|Table|Fig\.)\s*\d+\s*:"
LIST_MARKER = r"^([•▪◦·*+–—-](\s|$)|\d+[.)](\s|$)|[A-Z]{1,5}\d+[\s:])"
CITATION = r"(?iU)\((?:[^()]*(?:\b(?:1[6-9]|20)\d{2}\b|\bibid\b|\bet al\b)[^()]*)\)"
WORD_COUNT_NOTE = r"(?i)\s*\(\s*(?:about\s*|approx\.?\s*|~\s*)?\d+\s*words?\s*\)\s*$"
SENTENCE_CLOSERS, SAMPLE_CLOSERS, PICK_CLOSERS = "\"”’)\\]", "\"”')\\]", "\"”)"
STRAY_GLYPHS, FUSED_DIGIT, SHREDDED = r"[|¬~¦°]", r"[A-Za-z]\d|\d[A-Za-z]", r"(?:\b\w\b[ .]){3,}"
FOOTNOTE_MARKERS = (
    r"([\"”])\s*['|’`]*\s*[\d?*s°]{1,3}(?=[\s.,;:?!]|$)",
    r"([\"”])['’`|]{1,3}(?=[\s.,;:?!]|$)",
    r"(?<=[a-z])[°º](?=[\s.,;:?!]|$)",
    r"[⁰-₟]+",
)
SUBJECT_SPELLINGS = {"Mathmatics": "Mathematics"}

#: All that counts as white space, for trimming, and the same as a class.
SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NO_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
ALNUM = r"[\p{L}\p{N}]"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def strip(text: Column) -> Column:
    """Without white space at either end; native, as rules apply it many times."""
    return F.btrim(text, F.lit(SPACES))


def flat(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{NO_SPACE}++"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NO_SPACE}++")).cast("long")


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, " ")


def assessed_words(text: Column) -> Column:
    """Words once citations are gone; a token needs a letter or digit to be one."""
    kept = F.when(F.contains(text, F.lit("(")), without_citations(text)).otherwise(text)
    return F.regexp_count(kept, F.lit(f"{ALNUM}{NO_SPACE}*+")).cast("long")


def sentences(text: Column) -> Column:
    """Sentences: cut at white space after a stop and at most one closer."""
    parts = F.split(text, f"(?={SPACE})(?<=[.!?]|[.!?][{SENTENCE_CLOSERS}]){SPACE}+", -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def is_heading(style: Column) -> Column:
    return F.coalesce(style.like("Heading%") | (style == "Title"), F.lit(False))


def heading_level(style: Column) -> Column:
    number = F.regexp_extract(style, r"^Heading ([0-9]+)$", 1)
    return F.when(~is_heading(style), 0).when(number != "", number.try_cast("int")).otherwise(1)


def is_caption(text: Column) -> Column:
    return text.rlike(CAPTION)


def is_list_item(text: Column) -> Column:
    t = strip(text)
    return (t != "") & (F.contains(t, F.lit("\t")) | t.rlike(LIST_MARKER))


def is_prose(text: Column, min_words: int = MIN_PROSE_WORDS) -> Column:
    """Finished prose: long enough, no bullet, quote, list item or note; the empty text is none."""
    t = strip(text)
    opens_badly = r'^(?:[•\-*“"\[»]|' + "|".join(NOTE_STARTS) + ")"
    return (t != "") & ~t.rlike(opens_badly) & ~is_list_item(t) & (word_count(t) >= min_words)


def sample_problem(text: Column) -> Column:
    """Why a text cannot be a calibration sample, or null."""
    t = strip(text)
    n = word_count(t)
    return (
        F.when(n < SAMPLE_MIN_WORDS, F.concat(F.lit("only "), n.cast("string"), F.lit(" words")))
        .when(n > SAMPLE_MAX_WORDS, F.concat(n.cast("string"), F.lit(" words, too long")))
        .when(~t.rlike('^["“A-Z]'), "starts mid-sentence")
        .when(~t.rlike(f"[.!?][{SAMPLE_CLOSERS}]?\\z"), "ends mid-sentence")
        .when(is_list_item(t), "is a list item or table row")
        .when(F.contains(t, F.lit("**")) | t.startswith("#"), "contains markdown")
    )


def looks_like_prose(text: Column) -> Column:
    """No commentary on the task, no markdown, no list."""
    one = flat(text)
    opening = F.lower(F.left(one, F.lit(300)))
    markers = F.array(*[F.lit(m) for m in META_MARKERS])
    return ~F.contains(one, F.lit("**")) & ~one.startswith("#") & ~is_list_item(one) & ~F.exists(markers, lambda m: F.contains(opening, m))


def clean_response(text: Column) -> Column:
    """A model's answer without leading headings and lead-ins, on one line, without outer quotes."""
    lines = F.filter(F.transform(F.split(text, LINE_BREAK, -1), strip), lambda x: x != "")
    wanted = F.transform(lines, lambda x: ~(x.startswith("#") | x.endswith(":")))
    first = F.array_position(wanted, True)
    rest = F.when(first == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(lines), F.lit(1))))
    return F.regexp_replace(strip(F.array_join(rest, " ")), '^"+|"+\\z', "")


def trim_to_words(text: Column, budget: int) -> Column:
    """Whole sentences until ``budget`` words are reached, then back to one that ends in a stop."""
    parts = F.filter(F.split(strip(F.regexp_replace(strip(text), WORD_COUNT_NOTE, "")), f"(?<=[.!?]){SPACE}+", -1), lambda s: strip(s) != "")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("long").alias("n"))

    def take(acc: Column, s: Column) -> Column:
        done = (acc["n"] >= budget) & (F.size(acc["kept"]) > 0)
        return F.when(done, acc).otherwise(F.struct(F.concat(acc["kept"], F.array(s)).alias("kept"), (acc["n"] + word_count(s)).alias("n")))

    kept = F.aggregate(parts, start, take, lambda acc: acc["kept"])
    ended = F.array_max(F.transform(kept, lambda s, i: F.when(s.rlike(f"[.!?][{SAMPLE_CLOSERS}]?\\z"), i + 1).otherwise(0)))
    return F.array_join(F.slice(kept, F.lit(1), F.coalesce(ended, F.lit(0))), " ")


def vendor_of(model: Column) -> Column:
    return F.split_part(model, F.lit("/"), F.lit(1))


def sample_id_for(prefix: str, source_id: Column) -> Column:
    """Prefix, all digits, and the last character if it is a letter and there are digits."""
    digits = F.regexp_replace(source_id, r"[^\p{Nd}]", "")
    tail = F.when((digits != "") & F.right(source_id, F.lit(1)).rlike(r"^\p{L}$"), F.right(source_id, F.lit(1))).otherwise("")
    return F.concat(F.lit(prefix), F.when(digits != "", digits).otherwise(source_id), tail)


def group_of(sample_id: Column) -> Column:
    """The first run of digits, or the id."""
    return F.coalesce(F.nullif(F.regexp_extract(sample_id, r"\p{Nd}+", 0), F.lit("")), sample_id)


def strip_markers(text: Column) -> Column:
    """Without the footnote marks that scanning fuses to words."""
    for pattern in FOOTNOTE_MARKERS:
        text = F.regexp_replace(text, pattern, "$1" if pattern.startswith("(") and not pattern.startswith("(?") else "")
    return flat(F.regexp_replace(text, f"{SPACE}+([.,;:?!])", "$1"))


def is_heading_line(text: Column, keywords: tuple[str, ...]) -> Column:
    t = strip(text)
    begins = F.lit(False)
    for k in keywords:
        begins = begins | F.lower(t).startswith(k)
    return (word_count(t) <= 5) & ~F.contains(t, F.lit("...")) & ~t.rlike(r"\d\s*\z") & begins


def damage(text: Column) -> Column:
    """How much a paragraph looks like a scanning accident."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    odd = F.length(F.regexp_replace(text, '[^"]', "")) % 2
    bad_end = F.when(text.rlike(f"[.!?][{PICK_CLOSERS}]?\\z"), 0).otherwise(5)
    bad_start = F.when(text.rlike('^["“A-Z]'), 0).otherwise(5)
    return (3 * n(STRAY_GLYPHS) + n(FUSED_DIGIT) + 2 * n("(?U)" + SHREDDED) + odd + bad_end + bad_start).cast("long")


def subject_of(name: Column) -> Column:
    subject = F.regexp_replace(F.regexp_replace(name, r"_\d+$", ""), "_", " ")
    for wrong, right in SUBJECT_SPELLINGS.items():
        subject = F.when(subject == wrong, F.lit(right)).otherwise(subject)
    return subject


def bar(share: Column, width: int = 20) -> Column:
    return F.repeat(F.lit("#"), F.bround(share * width).cast("int"))


def aiish(score: Column, threshold: Column) -> Column:
    top = threshold * 1.3
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (top - score) / top))
