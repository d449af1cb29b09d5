"""Column building blocks: truthiness, numbers, labels and text normalisers.

All are native expressions, so they stay inside generated code and Catalyst can push and fold them.
"""

from __future__ import annotations

import functools
import html
import html.entities
import string
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, use) -> Column:
    """use(value) with the value computed once: an expression that names it many times would repeat it each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))


def number(c: Column) -> Column:
    """A double; null for what is no number, NaN included."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def norm(c: Column) -> Column:
    """Trimmed and upper-case; null is empty."""
    return F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def stance(score: Column, strong: float = 4, weak: float = 1, missing: str | None = "NEUTRAL") -> Column:
    """Five directional labels by symmetric cuts; NaN counts as neutral, null as `missing`."""
    s = F.nanvl(score.cast("double"), F.lit(0.0))
    out = (
        F.when(s >= strong, "HAWKISH").when(s >= weak, "NEUTRAL_HAWKISH").when(s <= -strong, "DOVISH").when(s <= -weak, "NEUTRAL_DOVISH").when(s.isNotNull(), "NEUTRAL")
    )
    return out if missing is None else F.coalesce(out, F.lit(missing))


def direction(score: Column, cut: float = 0.0) -> Column:
    """1, -1 or 0 by whether the score passes the cut on either side."""
    return F.when(score > 0 if not cut else score >= cut, 1).when(score < 0 if not cut else score <= -cut, -1).otherwise(0)


def label_direction(label: Column) -> Column:
    return F.when(label.isin("HAWKISH", "NEUTRAL_HAWKISH"), 1).when(label.isin("DOVISH", "NEUTRAL_DOVISH"), -1).when(label == "NEUTRAL", 0)


def rounded(c: Column, digits: int | None) -> Column:
    """c to so many digits, half to even by the number's binary value, which seldom is the half that it is written as.

    At a seeming half the product with the scale is redone in two exact parts, which tell on which side it is.
    """
    if digits is None:
        return c
    scale = 2.0 * 10**digits

    def fit(x: Column) -> Column:
        twice = x * scale
        high = x * 134217729.0 - (x * 134217729.0 - x)
        near = F.rint(twice)
        rest = (high * scale - near) + (x - high) * scale
        odd = (F.abs(twice - near) < 1e-3) & (F.abs(twice) < 2.0**50) & (F.pmod(near, F.lit(2.0)) == 1.0)
        return F.when(odd & (rest > 0), (near + 1) / scale).when(odd & (rest < 0), (near - 1) / scale).otherwise(F.bround(x, digits))

    return let(c.cast("double"), fit)


def any_of(text: Column, terms: Iterable[str]) -> Column:
    """Whether any term is a substring."""
    return reduce(lambda a, b: a | b, (text.contains(t) for t in dict.fromkeys(terms)), F.lit(False))


def pattern(regex: str) -> str:
    """A pattern with the flags under which `.`, classes and case work alike for all scripts."""
    return "(?iuUd)" + regex


def matches(text: Column, regex: str) -> Column:
    return text.rlike(pattern(regex))


# ---- text -----------------------------------------------------------------------------------------------------------
#: Mojibake of common marks and what they stand for.
MOJIBAKE = (("â€™", "’"), ("â€˜", "‘"), ("â€œ", "“"), ("â€\x9d", "”"), ("â€“", "–"), ("â€”", "—"), ("Â", ""))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Repaired marks, no-break spaces as spaces, single spaces, trimmed; null is empty."""
    c = F.coalesce(c, F.lit(""))
    for bad, good in MOJIBAKE:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return squeezed(F.replace(c, F.lit(" "), F.lit(" ")))


def plain_title(c: Column) -> Column:
    """Lower-case ASCII letters and digits in single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


#: Outlet names that normalised texts are freed of.
OUTLET_WORDS = ("reuters", "bloomberg", "cnbc", "wsj", "yonhap infomax")
OUTLETS = rf"\b({'|'.join(OUTLET_WORDS)})\b"
OUTLET_SUFFIX = r"\s*-\s*연합인포맥스\s*$"


#: What a normalised text is not made of.  Signs are listed one by one: the expression engine looks these up in a set of bits,
#: while it tries ranges in turn for each character, which takes some six times as long.
_NOT_PLAIN = f"[^{string.digits}{string.ascii_letters}가-힣]+"


def _where(test: str, pattern_: str, new: str):
    """A replacement that only texts that hold `test` go through."""
    return lambda c: F.when(c.contains(test), F.regexp_replace(c, pattern_, new)).otherwise(c)


def plain_event_text(c: Column) -> Column:
    """Lower-case letters and digits of two scripts without links and outlet names."""
    outlets = lambda x: F.when(any_of(x, OUTLET_WORDS), F.regexp_replace(x, OUTLETS, " ")).otherwise(x)
    steps = [_where("http", r"https?://\S+", " "), _where("연합인포맥스", OUTLET_SUFFIX, ""), outlets]
    c = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    for step in steps:
        c = let(c, step)
    return F.trim(F.regexp_replace(c, _NOT_PLAIN, " "))


_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
_CLOSED = _REFERENCE.replace(";?", ";")
#: Numbers of references that stand for other characters than their own.
_ODD = {n: html.unescape(f"&#{n};") for n in (0, 13, *range(0x80, 0xA0))}


@functools.cache
def _named() -> dict[str, str]:
    return {f"&{k}": v for k, v in html.entities.html5.items()}


def _referred(r: Column) -> Column:
    """What one character reference stands for; itself if nothing."""
    table = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    digits = F.regexp_extract(r, r"^&#[xX]?([0-9a-fA-F]+)", 1)
    code = F.when(r.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    by_number = F.when(code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd").otherwise(F.coalesce(F.element_at(table(_ODD), code.cast("int")), plain))
    return F.when(F.startswith(r, F.lit("&#")), by_number).otherwise(F.coalesce(F.element_at(table(_named()), r), r))


def decoded(c: Column, closed: bool = False) -> Column:
    """Character references, numbered and named, decoded once; `closed`: only those that end with their semicolon."""
    reference = _CLOSED if closed else _REFERENCE
    joined = F.zip_with(F.split(c, reference, -1), F.regexp_extract_all(c, F.lit(reference), F.lit(0)), lambda text, r: F.concat(text, F.when(r.isNull(), "").otherwise(_referred(r))))
    return F.when(c.contains("&"), F.array_join(joined, "")).otherwise(c)


def markup_free(c: Column, closed: bool = False) -> Column:
    """Character references decoded (`closed`: those with their semicolon) and tags replaced by spaces."""
    return squeezed(F.regexp_replace(let(F.coalesce(c, F.lit("")), lambda x: decoded(x, closed)), "<[^>]+>", " "))


def sentences(c: Column, least: int = 15) -> Column:
    """Sentences of at least `least` characters."""
    parts = F.split(squeezed(F.coalesce(c, F.lit(""))), r"(?<=[.!?。])\s+|(?<=[다요]\.)\s+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda s: F.length(s) >= least)


def words(c: Column, least: int = 2) -> Column:
    """Distinct tokens of a normalised text."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) >= least))


def alias_list(c: Column) -> Column:
    """`a|b|c` as trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda a: a != "")


def handle(c: Column) -> Column:
    """A handle without its leading marks; null if nothing is left."""
    return F.nullif(F.trim(F.ltrim(F.trim(c), F.lit("@"))), F.lit(""))


def shortened(c: Column, most: int = 320) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def lookup(c: Column, table: Mapping[str, str], default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), default)


#: What labels are shown as.
SHOWN_MOMENTUM = {"STRONG_HAWKISH_SHIFT": "▲▲ Strong Hawkish Shift", "HAWKISH_SHIFT": "▲ Hawkish Shift", "STABLE": "→ Stable", "DOVISH_SHIFT": "▼ Dovish Shift", "STRONG_DOVISH_SHIFT": "▼▼ Strong Dovish Shift", "INSUFFICIENT": "– Insufficient"}
SHOWN_STANCE = {"HAWKISH": "🔴 Hawkish", "NEUTRAL_HAWKISH": "🟥 Neutral Hawkish", "NEUTRAL": "⚪ Neutral", "NEUTRAL_DOVISH": "🟩 Neutral Dovish", "DOVISH": "🟢 Dovish", "INSUFFICIENT": "– Insufficient", "UNKNOWN": "– Unknown"}
SHOWN_CONFIDENCE = {"HIGH": "High", "MEDIUM": "Medium", "LOW": "Low", "INSUFFICIENT": "Insufficient"}


def shown(label: Column, table: Mapping[str, str]) -> Column:
    """A label as it is shown; one that is not known stays."""
    text = F.coalesce(label.cast("string"), F.lit(""))
    return lookup(F.upper(text), table, text)


def votes(c: Column) -> Column:
    """Whether a flag says yes: the number 1, or a word for it."""
    x = c.try_cast("double")
    return F.when(c.isNull(), False).when(x.isNotNull() & ~F.isnan(x), x.cast("int") == 1).otherwise(F.lower(F.trim(c)).isin("1", "true", "yes", "y"))


def shown_member(name: Column, year: Column) -> Column:
    """A name with the year that its vote ends in, or with the mark of a permanent one."""
    x = year.try_cast("double")
    text = F.when(x.isNotNull() & ~F.isnan(x), x.cast("int").cast("string")).otherwise(F.trim(year))
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(name, F.lit(" (~"), text, F.lit(")"))).otherwise(F.concat(name, F.lit(" (당연직)")))
