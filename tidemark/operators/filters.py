"""Row predicates as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.columns import any_of, first_filled, let, norm, number

RANKS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
OFFICIAL = ("OFFICIAL", "FED_BOARD", "REGIONAL_FED")


def at_least(label: Column, minimum: str = "MEDIUM") -> Column:
    rank = F.coalesce(*(F.when(F.upper(label) == k, v) for k, v in RANKS.items()), F.lit(0))
    return rank >= RANKS.get(str(minimum).upper(), 2)


def rate_context(sentence: Column, context=L.RATE_CONTEXT, others=L.OTHER_RATES, strong=L.STRONG_RATE_CONTEXT) -> Column:
    """Whether a lower-case sentence speaks of policy rates."""
    return (~any_of(sentence, others) | any_of(sentence, strong)) & any_of(sentence, context)


def policy_context(title: Column, text: Column, topics: Column | None = None, terms=L.EVIDENCE_POLICY) -> Column:
    parts = [title, text] + ([F.array_join(topics, " ")] if topics is not None else [])
    return let(F.lower(F.concat_ws(" ", *parts)), lambda t: any_of(t, terms))


def direct_speech(text: Column, signs=L.EVIDENCE_SPEECH) -> Column:
    return let(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), lambda t: any_of(t, signs))


def _origin(coverage: Column, source: Column, source_type: Column) -> Column:
    return norm(first_filled(coverage, source_type, source))


def is_official(coverage: Column, source: Column, source_type: Column) -> Column:
    return _origin(coverage, source, source_type).isin("BOTH", *OFFICIAL)


def is_wire(coverage: Column, source: Column, source_type: Column) -> Column:
    return _origin(coverage, source, source_type).isin("BOTH", "INFOMAX")


def verified_wire_speech(wire: Column, member_en: Column, member_ko: Column, title: Column, text: Column, score: Column) -> Column:
    """A wire report of a member's own words on policy, with a score."""
    body = F.concat_ws(" ", title, text)
    member = (F.coalesce(member_en, F.lit("")) != "") | (F.coalesce(F.length(member_ko), F.lit(0)) > 0) & F.coalesce(body.contains(member_ko), F.lit(False))
    return wire & member & policy_context(title, text) & direct_speech(body) & number(score).isNotNull()


def strong_evidence(official: Column, verified: Column, relevance: Column, title: Column, text: Column, score: Column) -> Column:
    return number(score).isNotNull() & policy_context(title, text) & ((official & (norm(relevance) == "HIGH")) | verified)


def member_terms(name: Column) -> Column:
    """Full name, and the surname from four letters on."""
    last = F.element_at(F.split(F.lower(F.trim(name)), r"\s+"), -1)
    return F.array_distinct(F.array_compact(F.array(F.lower(F.trim(name)), F.when(F.length(last) >= 4, last))))


def mentions(text: Column, terms: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(terms, lambda t: lower.contains(t))


def news_relevant(title: Column, description: Column, terms=L.NEWS_POLICY, veto=L.NEWS_VETO) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    return let(text, lambda t: ~any_of(t, veto) & any_of(t, terms))


def near_term(text: Column, term: str | Column, need: list[list[str]], before: int = 250, after: int = 450) -> Column:
    """Whether some occurrence of a term has, in the window around it, one of each list of needed terms.

    Occurrences are found by splitting at the term, so windows may overlap; no Python is involved.
    """
    low, t = F.lower(F.coalesce(text, F.lit(""))), F.lower(term) if isinstance(term, Column) else F.lit(term.lower())
    n = F.length(t)
    parts = F.split(low, F.concat(F.lit(r"\Q"), t, F.lit(r"\E")), -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda a, p: a + F.length(p)) + (k - 1) * n)
    window = lambda s: F.substring(low, F.greatest(s - before, F.lit(0)) + 1, F.least(s, F.lit(before)) + n + after)
    hit = lambda s: reduce(lambda a, b: a & b, (any_of(window(s), [n.lower() for n in terms]) for terms in need))
    return F.when(F.size(parts) > 1, F.exists(starts, hit)).otherwise(False)


def direct_term_signal(title: Column, text: Column, term: Column, veto=L.WIRE_TITLE_VETO, verbs=L.WIRE_SPEECH_VERBS, policy=L.WIRE_POLICY) -> Column:
    """direct_member_signal() for one lower-case term that the row itself holds."""
    low = F.lower(F.coalesce(title, F.lit("")))
    quoted = F.contains(low, term) & any_of(F.coalesce(title, F.lit("")), L.QUOTES)
    return ~any_of(low, [v.lower() for v in veto]) & (quoted | near_term(text, term, [verbs, policy]))


def direct_member_signal(title: Column, text: Column, terms: list[str], veto=L.WIRE_TITLE_VETO, verbs=L.WIRE_SPEECH_VERBS, policy=L.WIRE_POLICY) -> Column:
    """Whether a report gives a member's own words: named in a quoting title, or near a speech verb and a policy term."""
    low, terms = F.lower(F.coalesce(title, F.lit(""))), [t for t in terms if t]
    quoted = any_of(low, [t.lower() for t in terms]) & any_of(F.coalesce(title, F.lit("")), L.QUOTES)
    near = reduce(lambda a, b: a | b, (near_term(text, t, [verbs, policy]) for t in terms), F.lit(False))
    return ~any_of(low, [v.lower() for v in veto]) & (quoted | near)


def same_site(url: Column, base: Column) -> Column:
    host = lambda u: F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    return host(url) == host(base)


def usable_link(href: Column, any_part: list[str]) -> Column:
    h = F.lower(F.trim(F.coalesce(href, F.lit(""))))
    return (h != "") & ~h.rlike(r"^(#|mailto:|javascript:|tel:)") & ~h.rlike(r"\.(pdf|jpe?g|png|gif|zip|xlsx?|docx?|mp[34])$") & any_of(h, [p.lower() for p in any_part])


def in_year(date_year: Column, year: int) -> Column:
    """Rows of an unknown year stay."""
    return date_year.isNull() | (date_year == year)


def grid(relevance: list[str] | None, stances: list[str] | None, speakers: list[str] | None, keyword: str | None, hidden: list[str] = ()) -> Column:
    """The serving filters; an empty choice means all."""
    out = F.lit(True)
    for column, chosen in (("relevance", relevance), ("stance", stances), ("speaker", speakers)):
        if chosen:
            out = out & F.col(column).isin(*chosen)
    if keyword:
        k = keyword.lower()
        out = out & (F.lower(F.coalesce("title", F.lit(""))).contains(k) | F.lower(F.coalesce("speaker", F.lit(""))).contains(k))
    return out & ~F.col("speaker").isin(*hidden) if hidden else out
