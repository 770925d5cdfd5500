"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

What looks personal is found by one pattern and validated: card numbers by their check digit, IPv4 addresses by their
range, dates by the calendar, phone numbers by their number of digits, social security numbers by their areas, e-mail
addresses by their form (at most 64 characters before the @ and 127 labels after it, as mail and name servers allow). Each
value is run through a keyed Feistel network over its own format: a digit stays a digit, a letter a letter of its case, a
card number keeps a right check digit, an address stays an address, a date stays a date between 1900 and 2099. The network
is a permutation, so equal values stay equal and different ones different, in all documents; with the key it can be undone.
Mail domains, calling codes and everything not validated stay as they are.

Values are equal if their digits are (cards, phone numbers, social security numbers, whatever marks stand between), if they
name the same day or the same four numbers (dates, IPv4 addresses), or if their characters before the @ are (e-mail).
A phone number with and without its calling code has the same pseudonym behind that code.

The plan holds keys derived from ``key`` for each kind, as literals, and so do the web UI and event logs; they undo
pseudonyms, though they do not give ``key`` away. ``spark.sql.redaction.string.regex`` hides them.

Defined results: null text stays null; empty text and text without such values are returned as they were. Letters of an
e-mail address outside A-Z become letters within it (these cannot be undone). Overlapping readings go to the leftmost; of
those that begin together, to the first of: e-mail, card, date, IPv4, social security, phone. Rows are independent:
repeated rows give repeated results, an empty table an empty one. Other columns pass through untouched, whatever their
names. Texts may be of any length; the work is linear in it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"
CARD = r"(?<![\d+.-])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-]|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\d)"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, CARD, DATE, IPV4, SSN, PHONE))
#: Cheap and never false: every value above has an @ or begins with six characters of this kind.
MAYBE = r"@|[\d+(][\d().\- /]{5}"
#: The calling codes of countries that have fewer than three digits.
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
FIRST_DAY, DAYS = "1900-01-01", 73049


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _derived(key: str, kind: str) -> str:
    """The key of one kind of value."""
    return hashlib.sha256(f"{key}|{kind}".encode()).hexdigest()


def _stream(key: str, label: Column, seed: Column, i: Column) -> Column:
    """A pseudo-random number below 16^7 for place ``i`` (from 1), out of the key and the other half."""
    block = F.sha2(F.concat_ws("|", F.lit(key), label.cast("string"), F.floor((i - 1) / 8).cast("string"), seed), 256)
    return F.conv(F.substring(block, F.pmod(i - 1, F.lit(8)) * 8 + 1, F.lit(7)), 16, 10).cast("long")


def _shift(c: Column, by: Column) -> Column:
    code = F.ascii(c)
    turn = lambda first, size: F.char(F.lit(first) + F.pmod(code - first + by, F.lit(size)))
    return (
        F.when(c.between("0", "9"), turn(48, 10))
        .when(c.between("A", "Z"), turn(65, 26))
        .otherwise(F.when(c.between("a", "z"), turn(97, 26)).otherwise(F.char(F.lit(97) + F.pmod(code + by, F.lit(26)))))
    )


def feistel(text: Column, key: str, kind: str) -> Column:
    """A permutation of strings that keeps each place's class: digit, capital or small letter."""
    own = _derived(key, kind)

    def moved(part: Column, seed: Column, r: Column) -> Column:
        one = lambda i: _shift(F.substring(part, i, F.lit(1)), _stream(own, r, seed, i))
        every = F.transform(F.sequence(F.lit(1), F.length(part)), one)
        return F.when(F.length(part) > 0, F.array_join(every, "")).otherwise("")

    def half_round(s: Column, r: Column) -> Column:
        cut = F.floor(F.length(s) / 2).cast("int")
        left, right = F.substring(s, F.lit(1), cut), F.substring(s, cut + 1, F.length(s))
        return F.when(r % 2 == 0, F.concat(moved(left, right, r), right)).otherwise(F.concat(left, moved(right, left, r)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), text, half_round)


def _fill(form: Column, keep: Column, core: Column, marks: str) -> Column:
    """``form`` with the characters of class ``marks`` behind the first ``keep`` characters taken from ``core``, in order."""
    return _let(core, lambda c: _filled(form, keep, c, marks))


def _filled(form: Column, keep: Column, core: Column, marks: str) -> Column:
    at = lambda i: F.length(F.regexp_replace(F.substring(form, keep + 1, i - keep), f"[^{marks}]", ""))
    one = lambda i: F.when((i > keep) & F.substring(form, i, F.lit(1)).rlike(f"[{marks}]"), F.substring(core, at(i), F.lit(1))).otherwise(F.substring(form, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the check-digit rule when one digit (the check digit) is still to follow."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _check_digit(digits: Column) -> Column:
    return F.pmod(F.lit(10) - luhn_sum(digits) % 10, F.lit(10)).cast("string")


def _head(digits: Column) -> Column:
    return F.substring(digits, F.lit(1), F.length(digits) - 1)


def is_card(s: Column) -> Column:
    d = _digits(s)
    return F.length(d).between(13, 19) & (_check_digit(_head(d)) == F.substring(d, F.length(d), F.lit(1))) & ~d.rlike(r"^(\d)\1*$")


def _card(s: Column, key: str) -> Column:
    return _fill(s, F.lit(0), _let(feistel(_head(_digits(s)), key, "card"), lambda head: F.concat(head, _check_digit(head))), r"\d")


def _phone(s: Column, key: str) -> Column:
    code = lambda d: F.when(s.startswith("+"), F.regexp_extract(d, CALLING, 0)).otherwise("")
    behind = lambda d, c: F.concat(c, feistel(F.substring(d, F.length(c) + 1, F.length(d)), key, "phone"))
    return _fill(s, F.lit(0), _let(_digits(s), lambda d: _let(code(d), lambda c: behind(d, c))), r"\d")


def _ssn(s: Column, key: str) -> Column:
    """Area 001-665 or 667-899, group and serial not all zero: permuted until all parts are valid.

    One step in eight ends in no such number, 64 in a row (once in 10^58) are an error.
    """
    step = lambda d, i: F.when((i > 0) & is_ssn(d), d).otherwise(feistel(d, key, "ssn"))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(64)), _digits(s), step)
    valid = lambda d: F.when(is_ssn(d), d).otherwise(F.raise_error(F.lit("no valid number found")))
    return _fill(s, F.lit(0), _let(found, valid), r"\d")


def is_ssn(s: Column) -> Column:
    d = _digits(s)
    return ~d.rlike(r"^(?:000|666|9)|^...00|0000$")


def _email(s: Column, key: str) -> Column:
    local = F.substring_index(s, "@", 1)
    core = feistel(F.regexp_replace(local, r"[^\p{L}\p{N}]", ""), key, "mail")
    return F.concat(_fill(local, F.lit(0), core, r"\p{L}\p{N}"), F.substring(s, F.length(local) + 1, F.length(s)))


def is_ipv4(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda o: o.cast("int").between(0, 255))


def _pair_rounds(pair: Column, key: str, kind: str, left: int, right: int) -> Column:
    """Feistel on a pair of numbers below ``left`` and ``right``."""
    own = _derived(key, kind)

    def step(p: Column, r: Column) -> Column:
        a = F.pmod(p["a"] + _stream(own, r, p["b"].cast("string"), F.lit(1)), F.lit(left))
        b = F.pmod(p["b"] + _stream(own, r, p["a"].cast("string"), F.lit(1)), F.lit(right))
        return F.when(r % 2 == 0, F.struct(a.alias("a"), p["b"].alias("b"))).otherwise(F.struct(p["a"].alias("a"), b.alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, step)


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))


def _ipv4(s: Column, key: str) -> Column:
    o = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
    out = F.transform(F.array(_pair_rounds(_pair(o[0] * 256 + o[1], o[2] * 256 + o[3]), key, "ip", 65536, 65536)), lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)]))
    return out[0]


def _day(s: Column) -> Column:
    """Days since 1900-01-01, or null for what is no date of these two centuries; dd/mm before mm/dd."""
    part = lambda *i: [F.substring(s, a, b) for a, b in i]
    iso = F.concat_ws("-", *part((1, 4), (6, 2), (9, 2)))
    dmy, mdy = F.concat_ws("-", *part((7, 4), (4, 2), (1, 2))), F.concat_ws("-", *part((7, 4), (1, 2), (4, 2)))
    day = F.when(s.contains("-"), F.try_to_date(iso)).otherwise(F.coalesce(F.try_to_date(dmy), F.try_to_date(mdy)))
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    return F.when(n.between(0, DAYS - 1), n)


def _date(s: Column, key: str) -> Column:
    """The day's number as a pair below 271 and 270, permuted again while the pair lies beyond the last day.

    Only ``271 * 270 - DAYS`` pairs do, so one step more than these always ends within.
    """

    def walk(p: Column, i: Column) -> Column:
        return F.when((i > 0) & (p["a"] * 270 + p["b"] < DAYS), p).otherwise(_pair_rounds(p, key, "date", 271, 270))

    n = _day(s)
    pair = F.aggregate(F.sequence(F.lit(0), F.lit(271 * 270 - DAYS)), _pair(F.floor(n / 270), n % 270), walk)
    return _let(pair, lambda out: _as_date(s, out))


def _as_date(s: Column, out: Column) -> Column:
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (out["a"] * 270 + out["b"]).cast("int"))
    american = ~s.contains("-") & F.try_to_date(F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2))).isNull()
    slash = F.when(american, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return F.when(s.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(s.contains("/"), slash).otherwise(F.when(american, F.date_format(day, "MM.dd.yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy")))


def pseudonym(s: Column, key: str) -> Column:
    """What stands for one found value; the value itself if it is not valid."""
    whole = lambda p: s.rlike(f"^(?:{p})$")
    return (
        F.when(s.contains("@"), _email(s, key))
        .when(whole(CARD), F.when(is_card(s), _card(s, key)).otherwise(s))
        .when(whole(DATE), F.when(_day(s).isNotNull(), _date(s, key)).otherwise(s))
        .when(whole(IPV4), F.when(is_ipv4(s), _ipv4(s, key)).otherwise(s))
        .when(whole(SSN), F.when(is_ssn(s), _ssn(s, key)).otherwise(s))
        .otherwise(F.when(F.length(_digits(s)).between(8, 15), _phone(s, key)).otherwise(s))
    )


def _line(line: Column, key: str) -> Column:
    found = F.transform(F.regexp_extract_all(line, F.lit(f"({ANY})"), F.lit(1)), lambda s: pseudonym(s, key))
    rest = lambda gaps: F.zip_with(found, F.slice(gaps, 2, F.size(gaps)), lambda s, g: F.concat(s, F.coalesce(g, F.lit(""))))
    return F.transform(F.array(F.split(line, ANY, -1)), lambda gaps: F.concat(gaps[0], F.array_join(rest(gaps), "")))[0]


def pseudonymize(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``column``; ``key`` must be kept secret.

    No value spans lines, so only lines that may hold one are searched in full.
    """
    text = F.col(f"`{column}`")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(MAYBE), _line(x, key)).otherwise(x))
    out = F.when(text.rlike(MAYBE), F.array_join(lines, "\n")).otherwise(text)
    return docs.select(*[out.alias(c) if c == column else F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """Whole documents with pseudonyms. The key of this query is a public test key."""
    return pseudonymize(docs, "test key")
