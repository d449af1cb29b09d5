"""Dates: named resolution policies, parsers of free text and URLs, and inference of the day spoken on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import first_filled, pattern

#: Columns in order of preference, and whether unreadable values are passed over.
POLICIES = {
    "event": (("actual_speech_date", "speech_date", "event_date", "published_at", "Date", "date"), True),
    "model": (("actual_speech_date", "speech_date", "event_date", "published_at", "date"), False),
    "recent": (("actual_speech_date", "speech_date", "event_date", "published_at"), True),
    "momentum": (("published_at", "date", "Date"), False),
    "current": (("actual_speech_date", "speech_date", "event_date", "published_at"), False),
    "effective": (("actual_speech_date", "published_at"), True),
    "export": (("published_at",), True),
    "news": (("published_at", "date"), True),
}
_MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "(" + "|".join(m if m == "may" else f"{m[:3]}(?:{m[3:]})?" + ("|sept" if m == "september" else "") for m in _MONTHS) + ")"


def iso_date(c: Column) -> Column:
    """The date that a text starts with, or null."""
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")


def resolved(policy: str, have: list[str]) -> Column:
    """The date of a row under a policy, over the columns that there are; an ISO string, or null."""
    names, checked = POLICIES[policy]
    cols = [F.col(n) for n in names if n in have]
    if not cols:
        return F.lit(None).cast("string")
    if checked:
        return F.coalesce(*(F.date_format(iso_date(c), "yyyy-MM-dd") for c in cols))
    return first_filled(*cols)


def try_date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd")


def month_number(name: Column) -> Column:
    three = F.lower(F.substring(name, 1, 3))
    return F.when(three != "", F.array_position(F.array(*(F.lit(m[:3]) for m in _MONTHS)), three))


def english_date(c: Column) -> Column:
    """Month D, YYYY; D Month YYYY; M/D/YYYY or YYYY-MM-DD, wherever they stand in a text: an ISO string or null."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=[A-Za-z]{3,4})\.", "")
    a, b = pattern(rf"\b{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})"), pattern(rf"\b(\d{{1,2}})\s+{_MONTH}\s+(\d{{4}})")

    def part(regex: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(s, regex, k), F.lit(""))

    found = F.coalesce(
        F.try_to_date(part(r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"),
        F.when(part(a, 2).isNotNull(), try_date(part(a, 3), month_number(part(a, 1)), part(a, 2))),
        F.when(part(b, 1).isNotNull(), try_date(part(b, 3), month_number(part(b, 2)), part(b, 1))),
        F.when(part(r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", 1).isNotNull(), try_date(*(part(r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", k) for k in (3, 1, 2)))),
    )
    return F.date_format(found, "yyyy-MM-dd")


def rss_date(c: Column) -> Column:
    """`Mon, 01 Jan 2024 10:00:00 GMT` or with an offset: a timestamp, UTC if no zone is named."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|UT|Z)\s*$", " +0000")
    s = F.when(F.trim(s).rlike(r"[+-]\d{4}$"), F.trim(s)).otherwise(F.concat(F.trim(s), F.lit(" +0000")))
    return F.coalesce(F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.trim(c)))


def url_stamp(c: Column) -> Column:
    """`20YYMMDD` and a letter before `.htm`."""
    d = F.regexp_extract(F.coalesce(c, F.lit("")), r"(20\d{6})[a-z]?\.htm", 1)
    return F.date_format(F.try_to_date(F.nullif(d, F.lit("")), "yyyyMMdd"), "yyyy-MM-dd")


def url_date(c: Column) -> Column:
    """The first valid eight-digit date of a URL, else the first valid six-digit one after a letter or dash."""
    u = F.coalesce(c, F.lit(""))
    eight = F.transform(F.regexp_extract_all(u, F.lit(r"(20\d{6})"), 1), lambda x: F.try_to_date(x, "yyyyMMdd"))
    six = F.transform(F.regexp_extract_all(u, F.lit(r"[A-Za-z_-](\d{6})(?!\d)"), 1), lambda x: F.try_to_date(F.concat(F.lit("20"), x), "yyyyMMdd"))
    return F.date_format(F.get(F.filter(F.concat(eight, six), lambda d: d.isNotNull()), F.lit(0)), "yyyy-MM-dd")


def year_of(date: Column, url: Column) -> Column:
    """The year of a date, else one that the URL names: a folder, a stamp, or any."""
    u = F.coalesce(url, F.lit(""))
    tiers = [F.nullif(F.regexp_extract(u, p, 1), F.lit("")) for p in (r"/(20\d{2})/", r"(20\d{2})\d{4}", r"(20\d{2})")]
    return F.coalesce(F.year(iso_date(date)), *(t.cast("int") for t in tiers))


def spoken_date(text: Column, published: Column) -> Column:
    """The day of the month that a text marks as local time, in the month that fits the day of publication.

    Null unless the day lies 0 to 7 days before publication; late days in the first five days of a month are the month
    before's.
    """
    pub = iso_date(published)
    day = F.nullif(F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), 1, 5000), r"(\d{1,2})일\s*\(?현지\s*시간", 1), F.lit("")).cast("int")
    month = F.when((F.dayofmonth(pub) <= 5) & (day >= 25), F.add_months(pub, -1)).otherwise(pub)
    said = try_date(F.year(month), F.month(month), day)
    gap = F.datediff(pub, said)
    return F.when(gap.between(0, 7), F.date_format(said, "yyyy-MM-dd"))


def wire_date(c: Column) -> Column:
    """The day that a mail-style date, YYYY.M.D (or with - or /) or Y년 M월 D일 names, as it is written: an ISO string."""
    t = F.trim(F.coalesce(c, F.lit("")))
    found = []
    for p, (y, m, d) in ((r"^(?:[A-Za-z]{3,9},\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\b", (3, 2, 1)), (r"(20\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})", (1, 2, 3)), (r"(20\d{2})년\s*(\d{1,2})월\s*(\d{1,2})일", (1, 2, 3))):
        part = lambda k, p=p: F.nullif(F.regexp_extract(t, p, k), F.lit(""))
        month = month_number(part(m)) if m == 2 and d == 1 else part(m)
        found.append(F.when(part(y).isNotNull(), try_date(part(y), month, part(d))))
    return F.date_format(F.coalesce(*found), "yyyy-MM-dd")


#: Names in file names and whose they are.
URL_SPEAKERS = {"powell": "Jerome Powell", "cook": "Lisa Cook", "jefferson": "Philip Jefferson", "barr": "Michael Barr", "bowman": "Michelle Bowman", "waller": "Christopher Waller", "warsh": "Kevin Warsh"}


def url_speaker(url: Column) -> Column:
    """Whose name a file name begins with, before its date; null for names that are not known."""
    slug = F.regexp_extract(F.lower(F.element_at(F.split(F.coalesce(url, F.lit("")), "/"), -1)), r"^([a-z]+)20\d{6}", 1)
    return F.element_at(F.create_map(*(F.lit(x) for kv in URL_SPEAKERS.items() for x in kv)), slug)


def page_speaker(text: Column) -> Column:
    """The first known speaker that a page names."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(low.contains(n.lower()), F.lit(n)) for n in URL_SPEAKERS.values()))
