"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Numbers and dates are found by pattern and validated; each is read as a row of digits of mixed radix (decimal
places, letters, octets, a day within its 400 years), which an eight-round keyed Feistel network permutes: in turn,
each half is shifted, place by place and modulo its radix, by a SHA-256 of key, kind, round and the other half. So
a pseudonym has its original's format and stays valid, different values have different pseudonyms, and equal values
have equal ones in every document; ``restore`` with the key goes back.

Kinds: payment cards (Luhn; the check digit follows), telephone numbers (North American ones, and ``+`` with 7 to 15
digits in any groups; the country's code stays, and so does a leading zero; North American areas and exchanges stay
in 2-9), IPv4 addresses (first octet stays in 1-223), calendar dates of the years 1000 to 9799 (Y-M-D, also before a
time of day, D.M.Y, D/M/Y and, where that is no date, M/D/Y), US social security numbers, and the local parts of
e-mail addresses.

Links across formats. Separators take no part in cards, telephone numbers and dates, so ``4111 1111 ...`` and
``41111111...``, ``(212) 555-0101``, ``212-555-0101`` and ``+1 212 555 0101``, or ``2024-05-06`` and ``6.5.2024`` are
one value. Dates that can only be M/D/Y are permuted among those, so that they can be read back, and link with each
other only. E-mail addresses link by their exact local part.

It is one projection: no shuffle, no Python. Texts without a digit or @ are passed on untouched.

Cases. Null text stays null, empty stays empty. Empty table: no rows. What fails validation stays as it is. Two values
of which one is within the other: the one that begins first counts; of those that begin together the kind that is
first in ``KINDS``. Long texts are handled whole; repeated rows give repeated results; extra columns pass through,
whatever their names, but those named n_<kind> are replaced. A date with a one-digit day or month is written without
leading zeros where its pseudonym has such too, so it may come back with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, quoted

ROUNDS = 8
DAYS, DAY_LOW = 146_097, 2_319  # days of 400 years; 63 * 2319
KINDS = ("email", "phone", "ip", "date", "ssn", "card")
_EDGE, _END = r"(?<![A-Za-z0-9_])(?<!\d[./-])", r"(?![A-Za-z0-9_]|[./-]\d)"
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"(?<![A-Za-z0-9])(?:\+\d(?:[ .-]?\(?\d|\)[ .-]?\d){6,14}|(?:1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[.-])?\d{3}[.-]\d{3}[.-]\d{4})(?![A-Za-z0-9])",
    "ip": _EDGE + r"\d{1,3}(?:\.\d{1,3}){3}" + _END,
    "date": _EDGE + r"(?:\d{4}-\d{2}-\d{2}(?=T\d\d:?\d\d)|(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})" + _END + ")",
    "ssn": _EDGE + r"\d{3}-\d{2}-\d{4}" + _END,
    "card": _EDGE + r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})" + _END,
}
#: Country calling codes of one and two digits; all others have three.
_CODES = r"^(?:[17]|20|27|3[0-4]|36|39|4[01]|4[3-9]|5[1-8]|6[0-6]|8[1246]|9[0-5]|98)"
_CUT, _ESCAPE = "\u0001", "\u0002"


def feistel(values: Column, radixes: Column, kind: Column | str, key: str, back: bool = False) -> Column:
    """A keyed permutation of arrays of ints, each place below its radix, for each kind and number of places.

    ``back``: the inverse.
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind
    n = F.size(values)
    half = F.floor(n / 2).cast("int")

    def turn(state: Column, k: Column) -> Column:
        left = (k % 2 == 0) & (n > 1)
        seen = F.when(n == 1, F.array().cast("array<int>")).when(left, F.slice(state, half + 1, n - half)).otherwise(F.slice(state, F.lit(1), half))
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, n.cast("string"), k.cast("string"), F.array_join(seen.cast("array<string>"), ",")).cast("binary"), 256)
        own = F.array(digest)  # bound once and looked up by each place

        def moved(v: Column, i: Column, d: Column) -> Column:
            step = F.conv(F.substring(d, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return F.pmod(v - step if back else v + step, F.get(radixes, i)).cast("int")

        shifted = F.transform(own, lambda d: F.transform(state, lambda v, i: F.when((n == 1) | ((i < half) == left), moved(v, i, d)).otherwise(v)))
        return F.get(shifted, F.lit(0))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, values, turn)


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_digit(body: Column) -> Column:
    """The check digit of a row of decimal digits, as text."""
    turned = F.split(F.reverse(body), "")
    doubled = F.transform(turned, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def is_card(text: Column) -> Column:
    d = _digits(text)
    return F.length(d).between(13, 19) & (F.substring(d, 1, 1) != "0") & (luhn_digit(F.left(d, F.length(d) - 1)) == F.right(d, F.lit(1)))


def _place(v: Column, r: Column | int, b: Column | int) -> Column:
    """Value and radix of a place, and the code or digit that value 0 stands for. Radix 1 stays."""
    return F.struct(v.cast("int").alias("v"), (F.lit(r) if isinstance(r, int) else r).alias("r"), (F.lit(b) if isinstance(b, int) else b).alias("b"))


def _turned(places: Column, kind: Column | str, key: str, back: bool) -> Column:
    """The codes or digits that the places' permuted values stand for."""
    return _once(places, lambda p: F.zip_with(p, feistel(F.transform(p, lambda x: x["v"]), F.transform(p, lambda x: x["r"]), kind, key, back), lambda x, v: x["b"] + v))


def _woven(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced in turn by those of an array; all else stays."""
    return _once(digits, lambda d: F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.get(d, F.length(_digits(F.left(text, i)))).cast("string")).otherwise(c)), ""))


def _email(text: Column, key: str, back: bool) -> Column:
    """Letters and digits of the local part permuted within their classes."""
    local = F.substring_index(text, "@", 1)

    def place(c: Column) -> Column:
        code = F.ascii(c)
        return (
            F.when(c.rlike("^[0-9]$"), _place(code - 48, 10, 48))
            .when(c.rlike("^[a-z]$"), _place(code - 97, 26, 97))
            .when(c.rlike("^[A-Z]$"), _place(code - 65, 26, 65))
            .otherwise(_place(F.lit(0), 1, code))
        )

    codes = _turned(F.transform(F.split(local, ""), place), "email", key, back)
    return F.concat(F.array_join(F.transform(codes, lambda c: F.char(c)), ""), F.substring(text, F.length(local) + 1, F.length(text)))


def _phone(text: Column, key: str, back: bool) -> Column:
    digits = _digits(text)
    code = F.when(F.startswith(text, F.lit("+")), F.coalesce(F.nullif(F.regexp_extract(digits, _CODES, 0), F.lit("")), F.left(digits, F.lit(3)))).otherwise(F.when(F.length(digits) == 11, F.lit("1")).otherwise(F.lit("")))
    own = F.substring(digits, F.length(code) + 1, F.length(digits))
    american = (F.length(own) == 10) & code.isin("", "1")

    def place(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return (
            F.when(american & i.isin(0, 3), F.when(d >= 2, _place(d - 2, 8, 2)).otherwise(_place(d, 2, 0)))
            .when(~american & (i == 0), F.when(d >= 1, _place(d - 1, 9, 1)).otherwise(_place(d, 1, 0)))
            .otherwise(_place(d, 10, 0))
        )

    new = _turned(F.transform(F.split(own, ""), place), F.concat(F.lit("phone"), F.when(american, F.lit("1")).otherwise(code)), key, back)
    ahead = F.when(F.length(code) > 0, F.split(code, "").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return _woven(text, F.concat(ahead, new))


def _card(text: Column, key: str, back: bool) -> Column:
    """All digits but the last permuted, the first staying in 1-9; the separators stay."""
    digits = _digits(text)
    body = F.split(F.left(digits, F.length(digits) - 1), "")
    new = _turned(F.transform(body, lambda c, i: F.when(i == 0, _place(c.cast("int") - 1, 9, 1)).otherwise(_place(c.cast("int"), 10, 0))), "card", key, back)
    return _woven(text, _once(new, lambda b: F.concat(b, F.array(luhn_digit(F.array_join(b.cast("array<string>"), "")).cast("int")))))


def _octets(text: Column) -> Column:
    return F.split(text, r"\.").try_cast("array<int>")


def _ip(text: Column, key: str, back: bool) -> Column:
    o = _octets(text)
    first = F.get(o, F.lit(0))
    usual = first.between(1, 223)
    value = F.transform(o, lambda x, i: F.when(i > 0, x).when(usual, x - 1).otherwise(F.greatest(x - 223, F.lit(0))))
    radix = F.transform(o, lambda x, i: F.when(i > 0, 256).when(usual, 223).otherwise(33))
    new = F.transform(feistel(value, radix, "ip", key, back), lambda v, i: F.when(i > 0, v).when(usual, v + 1).when(v == 0, 0).otherwise(v + 223))
    return F.array_join(new.cast("array<string>"), ".")


def _date_of(text: Column) -> Column:
    """Struct of the date (null if there is no such day) and the order of its parts: ymd, dmy, or mdy."""
    part = F.split(text, "[-/.]")
    x, y, z = (F.get(part, F.lit(i)) for i in range(3))

    def day(year: Column, month: Column, d: Column) -> Column:
        return F.when(year.try_cast("int").between(1000, 9799), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))

    def told(date: Column, order: str) -> Column:
        return F.struct(date.alias("date"), F.lit(order).alias("order"))

    return F.when(text.rlike(r"^\d{4}"), told(day(x, y, z), "ymd")).when(day(z, y, x).isNotNull(), told(day(z, y, x), "dmy")).when(F.contains(text, F.lit("/")), told(day(z, x, y), "mdy")).otherwise(told(F.lit(None).cast("date"), "dmy"))


def _date(text: Column, key: str, back: bool) -> Column:
    start = F.lit("1800-01-01").cast("date")

    def moved(date: Column) -> Column:
        day = F.datediff(date, start)
        at = F.pmod(day, F.lit(DAYS))
        new = feistel(F.array(F.floor(at / DAY_LOW).cast("int"), (at % DAY_LOW).cast("int")), F.array(F.lit(DAYS // DAY_LOW), F.lit(DAY_LOW)), "date", key, back)
        return _once(new, lambda v: F.date_add(start, (F.floor(day / DAYS) * DAYS + F.get(v, F.lit(0)) * DAY_LOW + F.get(v, F.lit(1))).cast("int")))

    # M/D/Y is read only where D/M/Y is no date: such dates are permuted on until they come to one of theirs again.
    again = lambda date: F.aggregate(F.sequence(F.lit(1), F.lit(99)), moved(date), lambda d, _: F.when(F.dayofmonth(d) > 12, d).otherwise(moved(d)))

    def render(x: Column, old: Column) -> Column:
        mark = F.regexp_extract(text, "[-/.]", 0)
        short = text.rlike(r"(?:^|[-/.])\d(?:[-/.]|$)")
        number = lambda n: F.when(short, n.cast("string")).otherwise(F.lpad(n.cast("string"), 2, "0"))
        y, m, d = F.lpad(F.year(x).cast("string"), 4, "0"), number(F.month(x)), number(F.dayofmonth(x))
        return F.when(old["order"] == "ymd", F.concat(y, mark, m, mark, d)).when(old["order"] == "dmy", F.concat(d, mark, m, mark, y)).otherwise(F.concat(m, mark, d, mark, y))

    return _once(_date_of(text), lambda old: _once(F.when(old["order"] == "mdy", again(old["date"])).otherwise(moved(old["date"])), lambda x: render(x, old)))


def _ssn(text: Column, key: str, back: bool) -> Column:
    part = F.split(text, "-").try_cast("array<int>")
    area = F.get(part, F.lit(0))
    value = F.array(F.when(area < 666, area - 1).otherwise(area - 2), F.get(part, F.lit(1)) - 1, F.get(part, F.lit(2)) - 1)
    new = feistel(value, F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key, back)
    return F.get(
        F.transform(F.array(new), lambda v: F.format_string("%03d-%02d-%04d", F.when(F.get(v, F.lit(0)) < 665, F.get(v, F.lit(0)) + 1).otherwise(F.get(v, F.lit(0)) + 2), F.get(v, F.lit(1)) + 1, F.get(v, F.lit(2)) + 1)),
        F.lit(0),
    )


def kind_of(text: Column) -> Column:
    """The kind of a matched value once validated, or null."""
    part = F.split(text, "-").try_cast("array<int>")
    area = F.get(part, F.lit(0))
    return (
        F.when(F.contains(text, F.lit("@")), F.when(F.substring_index(text, "@", 1).rlike("[A-Za-z0-9]"), F.lit("email")))
        .when(text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(_octets(text), lambda o: o <= 255), F.lit("ip")))
        .when(text.rlike(r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$"), F.when(_date_of(text)["date"].isNotNull(), F.lit("date")))
        .when(text.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when((area > 0) & (area < 900) & (area != 666) & (F.get(part, F.lit(1)) > 0) & (F.get(part, F.lit(2)) > 0), F.lit("ssn")))
        .when(text.rlike(r"^[+(]|^1[ .-]?\(|^(1[.-])?\d{3}[.-]\d{3}[.-]\d{4}$"), F.lit("phone"))
        .when(is_card(text), F.lit("card"))
    )


def pseudonym(text: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a value of a kind, or (``back``) the value of a pseudonym."""
    return (
        F.when(kind == "email", _email(text, key, back))
        .when(kind == "phone", _phone(text, key, back))
        .when(kind == "ip", _ip(text, key, back))
        .when(kind == "date", _date(text, key, back))
        .when(kind == "ssn", _ssn(text, key, back))
        .when(kind == "card", _card(text, key, back))
        .otherwise(text)
    )


def _replaced(docs: DataFrame, column: str, key: str, back: bool, counted: bool) -> DataFrame:
    if not key:
        raise ValueError("a key is needed")
    text = F.col(column)
    pattern = "|".join(f"(?:{_PATTERNS[k]})" for k in KINDS)
    safe = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "\u0003")), F.lit(_CUT), F.lit(_ESCAPE + "\u0004"))
    cut = F.split(F.regexp_replace(safe, pattern, _CUT + "$0" + _CUT), _CUT, -1)
    parts = F.when(text.rlike("[0-9@]"), F.transform(cut, lambda p, i: F.struct(p.alias("t"), F.when(i % 2 == 1, kind_of(p)).alias("k"))))
    name = free_name(docs, "parts")
    marked = docs.withColumn(name, parts)
    new = F.array_join(F.transform(name, lambda x: F.when(x["k"].isNull(), x["t"]).otherwise(pseudonym(x["t"], x["k"], key, back))), "")
    out = F.replace(F.replace(new, F.lit(_ESCAPE + "\u0004"), F.lit(_CUT)), F.lit(_ESCAPE + "\u0003"), F.lit(_ESCAPE))

    def times(kind: str) -> Column:
        found = F.size(F.filter(name, lambda x: x["k"] == kind))
        return F.when(F.col(name).isNull(), F.lit(0)).otherwise(found).cast("long").alias(f"n_{kind}")

    kept = [F.when(F.col(name).isNull(), text).otherwise(out).alias(c) if c == column else F.col(quoted(c)) for c in docs.columns]
    return marked.select(*kept, *[times(k) for k in KINDS if counted])


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with ``column`` pseudonymised and n_<kind>: how many values of each kind were replaced."""
    return _replaced(docs.drop(*[f"n_{k}" for k in KINDS]), column, key, False, True)


def restore(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with the values of ``column`` that ``pseudonymise`` replaced under ``key``."""
    return _replaced(docs, column, key, True, False)
