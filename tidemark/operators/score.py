"""Lexicon and rule scores of texts: phrases are found in one pass, and what they mean is native columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.columns import any_of, let, matches, plain_event_text, sentences, stance, words
from ..functions.phrases import Phrases
from .filters import rate_context


def relevance(df: DataFrame, policy=L.RELEVANCE_POLICY, mandate=L.RELEVANCE_MANDATE, macro=L.RELEVANCE_MACRO, low=L.RELEVANCE_LOW) -> DataFrame:
    """policy, mandate and macro scores, their total with penalties, a label, whether there is a body, and the matches."""
    groups = {"POLICY": policy, "DUAL_MANDATE": mandate, "MACRO": macro, "LOW_RELEVANCE": low}
    known = Phrases(*groups.values())
    body = F.lower(F.coalesce("text", F.lit("")))
    df = df.withColumn("_hits", known.hits(F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit("\n"), body)))
    t = F.col("_hits")
    df = df.withColumn("policy_score", known.weight(t, policy)).withColumn("mandate_score", known.weight(t, mandate)).withColumn("macro_score", known.weight(t, macro))
    p, m = F.col("policy_score"), F.col("mandate_score")
    total = F.greatest(p + m + F.col("macro_score") + known.weight(t, low), F.lit(0))
    label = F.when((p >= 6) | ((p >= 3) & (m >= 3)) | (F.col("relevance_score") >= 8), "HIGH").when(F.col("relevance_score") >= 4, "MEDIUM").otherwise("LOW")
    entry = lambda x, w, g: F.struct(F.lit(x).alias("phrase"), F.lit(w).cast("int").alias("weight"), F.lit(g).alias("category"))
    entries = [(x, entry(x, w, g)) for g, words_ in groups.items() for x, w in words_.items()]
    return (
        df.withColumn("relevance_score", total).withColumn("relevance", label).withColumn("has_body", F.length(F.trim(body)) >= 100)
        .withColumn("relevance_matches", known.found(t, entries)).drop("_hits")
    )


def topics(title: Column, text: Column, groups=L.TOPICS) -> Column:
    known = Phrases(*groups.values())
    hits = known.hits(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))))
    return let(hits, lambda h: known.labels(h, groups))


def fingerprint(title: Column, text: Column, groups=L.FINGERPRINTS, most: int | None = None) -> Column:
    """Sorted labels whose phrases a normalised text holds; `most`: only that many characters of it are looked at."""
    body = F.coalesce(text, F.lit(""))
    t = plain_event_text(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), body if most is None else F.substring(body, 1, most)))
    plain = {label: [_plain(p) for p in phrases if _plain(p)] for label, phrases in groups.items()}
    known = Phrases(*plain.values())
    return F.array_sort(let(known.hits(t), lambda hits: known.labels(hits, plain)))


def _plain(phrase: str) -> str:
    kept = "".join(c if (c.isascii() and c.isalnum()) or "가" <= c <= "힣" else " " for c in phrase.lower())
    return " ".join(kept.split())


def signature_text(title: Column, topic_list: Column, text: Column) -> Column:
    body = F.substring(plain_event_text(text), 1, 1000)
    return plain_event_text(F.concat_ws(" ", plain_event_text(title), F.array_join(F.transform(topic_list, plain_event_text), " "), body))


def event_key(member: Column, date: Column, prints: Column, signature: Column) -> Column:
    """member|date|digest of the fingerprints, or of the text where there are none."""
    what = F.when(F.size(prints) > 0, F.array_join(prints, "|")).otherwise(signature)
    return F.concat_ws("|", plain_event_text(member), F.coalesce(date, F.lit("unknown-date")), F.substring(F.sha1(what), 1, 12))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared tokens of two normalised texts by all of them; 0 if either has none."""
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def news_rules(text: Column, strong=L.NEWS_STRONG_DOVE, dove=L.NEWS_DOVE, hawk=L.NEWS_HAWK, muted=("supports hikes", "possible tightening")) -> Column:
    """struct(score, label, hawkish_score, dovish_score, hawk_hit, dove_hit) of a news text."""
    return let(F.trim(F.lower(F.coalesce(text, F.lit("")))), lambda t: _by_rules(t, [*strong, *dove], hawk, muted))


def _by_rules(t: Column, down: list, hawk: list, muted: tuple) -> Column:
    """Rules that match are filtered from literal arrays, the strongest is the least by (weight, place)."""

    def hits(rules: list, sign: int) -> Column:
        tests = (F.when(matches(t, p), F.struct(F.lit(-sign * w).alias("o"), F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(k).alias("k"))) for i, (p, w, k) in enumerate(rules))
        return F.array_compact(F.array(*tests))

    def outcome(lower: Column) -> Column:
        dw = F.coalesce(lower["w"], F.lit(0))
        upper = F.array_min(F.filter(hits(hawk, 1), lambda e: (dw > -4) | ~e["k"].isin(*muted)))
        return let(upper, lambda u: _news_result(dw, lower["k"], F.coalesce(u["w"], F.lit(0)), u["k"]))

    return let(F.array_min(hits(down, -1)), outcome)


def _news_result(dw: Column, dr: Column, hw: Column, hr: Column) -> Column:
    score = F.greatest(F.least(hw + dw, F.lit(5)), F.lit(-5))
    return F.struct(score.alias("score"), stance(score).alias("label"), F.greatest(score, F.lit(0)).alias("hawkish_score"), F.abs(F.least(score, F.lit(0))).alias("dovish_score"), hr.alias("hawk_hit"), dr.alias("dove_hit"))


# ---- sentences ------------------------------------------------------------------------------------------------------
#: What a sentence on disinflation must hold, for the signals that it gives.
_DISINFLATION = (
    ("disinflation", ["if we do not", "if i do not", "does not", "doesn't", "fails to", "do not see", "not see signs"], ["prepared to act", "prepared to raise", "raise rates", "tighten", "further tightening"], [], 4, "disinflation_failure_tightening"),
    ("disinflation", ["continuing", "continued", "resume", "resumed", "progress", "ongoing", "sustained"], [], ["not", "stall", "stalled", "fail"], -1, "disinflation_progress"),
    ("디스인플레이션", ["중단", "정체", "멈", "진전이 없", "진전 없"], [], [], 3, "ko_disinflation_stalled"),
    ("디스인플레이션", ["진전", "계속", "지속", "재개"], [], ["없", "중단", "정체", "멈"], -1, "ko_disinflation_progress"),
)


@dataclass(frozen=True)
class StanceRules:
    """What sentences are scored by: patterns and phrases of both directions, words of first-hand and of reported stance, and the
    rules on disinflation (word, one of, one of, none of, weight, name)."""

    hawk_conditions: list = field(default_factory=lambda: L.HAWK_CONDITIONS)
    dove_conditions: list = field(default_factory=lambda: L.DOVE_CONDITIONS)
    hawk_phrases: dict = field(default_factory=lambda: L.HAWK_PHRASES)
    dove_phrases: dict = field(default_factory=lambda: L.DOVE_PHRASES)
    hawk_phrases_ko: dict = field(default_factory=lambda: L.HAWK_PHRASES_KO)
    dove_phrases_ko: dict = field(default_factory=lambda: L.DOVE_PHRASES_KO)
    hawk_patterns: list = field(default_factory=lambda: L.HAWK_PATTERNS)
    dove_patterns: list = field(default_factory=lambda: L.DOVE_PATTERNS)
    hawk_patterns_ko: list = field(default_factory=lambda: L.HAWK_PATTERNS_KO)
    dove_patterns_ko: list = field(default_factory=lambda: L.DOVE_PATTERNS_KO)
    first_person: list = field(default_factory=lambda: L.FIRST_PERSON)
    reported: list = field(default_factory=lambda: L.REPORTED)
    disinflation: tuple = _DISINFLATION
    context: list = field(default_factory=lambda: L.RATE_CONTEXT)
    other_rates: list = field(default_factory=lambda: L.OTHER_RATES)
    strong_context: list = field(default_factory=lambda: L.STRONG_RATE_CONTEXT)


def _phrase_signals(s: Column, rates: Column, lexicon: dict[str, int], prefix: str = "") -> Column:
    """Signals of phrases present; those of the rate family only in a context of policy rates."""
    entry = lambda p, w: F.struct(F.lit(prefix + p).alias("k"), F.lit(w).alias("w"), F.lit(p).alias("p"), F.lit(any(x in p.lower() for x in L.RATE_FAMILY)).alias("r"))
    hits = F.filter(F.array(*(entry(p, w) for p, w in lexicon.items())), lambda e: s.contains(e["p"]) & (~e["r"] | rates))
    return F.transform(hits, lambda e: F.struct(e["k"].alias("k"), e["w"].alias("w")))


def _pattern_signals(s: Column, rates: Column, rules: list, gated: bool) -> Column:
    tests = ((matches(s, p) & (rates if gated and "rate" in p else F.lit(True)), w, k) for p, w, k in rules)
    return F.array_compact(F.array(*(F.when(t, F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"))) for t, w, k in tests)))


def _one(test: Column, name: str, weight: int) -> Column:
    return F.when(test, F.array(F.struct(F.lit(name).alias("k"), F.lit(weight).alias("w")))).otherwise(F.array().cast("array<struct<k:string,w:int>>"))


def _without(signals: Column, test: Column, parts: list[str]) -> Column:
    return F.when(test, F.filter(signals, lambda e: ~any_of(e["k"], parts))).otherwise(signals)


def sentence_scores(rows: DataFrame, sentence: str = "sentence", rules: StanceRules | None = None) -> DataFrame:
    """rows with hawk_score, dove_score, net_score, hawk_signals, dove_signals of each sentence.

    Steps are columns of their own, so that no expression grows beyond what one generated method may hold.
    """
    rules = rules or StanceRules()
    rows = rows.withColumn("_s", F.lower(F.coalesce(F.col(sentence), F.lit(""))))
    s = F.col("_s")
    rows = rows.withColumn("_r", rate_context(s, rules.context, rules.other_rates, rules.strong_context))
    r = F.col("_r")
    hawk = F.concat(_pattern_signals(s, r, rules.hawk_conditions, False), _phrase_signals(s, r, rules.hawk_phrases), _phrase_signals(s, r, rules.hawk_phrases_ko, "ko:"), _pattern_signals(s, r, rules.hawk_patterns, True), _pattern_signals(s, r, rules.hawk_patterns_ko, False))
    dove = F.concat(_pattern_signals(s, r, rules.dove_conditions, False), _phrase_signals(s, r, rules.dove_phrases), _phrase_signals(s, r, rules.dove_phrases_ko, "ko:"), _pattern_signals(s, r, rules.dove_patterns, True), _pattern_signals(s, r, rules.dove_patterns_ko, False))
    rows = rows.withColumn("_h", hawk).withColumn("_d", dove)
    # the first disinflation rule that applies
    rule = F.lit(None).cast("string")
    for word, first, second, none, _, name in reversed(rules.disinflation):
        test = s.contains(word) & any_of(s, first) & (any_of(s, second) if second else F.lit(True)) & (~any_of(s, none) if none else F.lit(True))
        rule = F.when(test, F.lit(name)).otherwise(rule)
    rows = rows.withColumn("_x", rule)
    for _, _, _, _, w, name in rules.disinflation:
        target = "_h" if w > 0 else "_d"
        rows = rows.withColumn(target, F.concat(F.col(target), _one(F.coalesce(F.col("_x") == name, F.lit(False)), name, w)))
    # negations take signals back, or turn them round
    no_hike = matches(s, r"금리\s*인상.{0,30}(필요하지\s*않|필요\s*없|불필요)")
    no_cut = matches(s, r"금리\s*인하.{0,30}(필요하지\s*않|필요\s*없|불필요)")
    prolongs = matches(s, r"금리\s*인하.{0,100}(인플레|인플레이션|물가).{0,100}(더\s*오래|지속).{0,80}(위험|높)")
    d = _without(F.col("_d"), matches(s, r"without having to.{0,20}(lower|cut|reduce).{0,15}rates?"), ["rate", "easing"])
    h = _without(F.col("_h"), matches(s, r"without having to.{0,20}(raise|increase).{0,15}rates?"), ["rate", "prepared_to_raise"])
    h = _without(h, no_hike, ["금리 인상", "rate_hike"])
    d = F.concat(d, _one(no_hike, "ko_rate_hike_not_needed", -5))
    d = _without(d, no_cut, ["금리 인하", "rate_cut"])
    h = F.concat(h, _one(no_cut, "ko_rate_cut_not_needed", 5))
    d = _without(d, prolongs, ["금리 인하", "rate_cut"])
    h = F.concat(h, _one(prolongs, "ko_cut_prolongs_inflation", 6))
    rows = rows.withColumn("_h", h).withColumn("_d", d)
    factor = F.when(any_of(s, rules.first_person), 1.35).when(any_of(s, rules.reported), 0.5).otherwise(1.0)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, e: a + e["w"])
    rows = rows.withColumn("hawk_score", F.least(F.bround(total(F.col("_h")) * factor).cast("int"), F.lit(6))).withColumn("dove_score", F.greatest(F.bround(total(F.col("_d")) * factor).cast("int"), F.lit(-6)))
    names = lambda c: F.transform(c, lambda e: e["k"])
    return rows.withColumn("net_score", F.col("hawk_score") + F.col("dove_score")).withColumn("hawk_signals", names(F.col("_h"))).withColumn("dove_signals", names(F.col("_d"))).drop("_s", "_r", "_h", "_d", "_x")


def article_stance(df: DataFrame, key: str = "seq", most: int = 8, clip: int = 20, rules: StanceRules | None = None) -> DataFrame:
    """Stance of articles by their title and sentences, one row each.

    Sentences are scored as rows, so a very long text spreads over the expression, not over a Python object.
    """
    text = F.coalesce("text", F.lit(""))
    whole = F.when(F.coalesce("title", F.lit("")) != "", F.array(F.col("title"))).otherwise(F.array().cast("array<string>"))
    rows = df.select(key, F.length(F.trim(text)).alias("_len"), F.posexplode_outer(F.concat(whole, sentences(text))).alias("pos", "sentence"))
    scored = sentence_scores(rows, rules=rules)
    used = (F.col("hawk_score") != 0) | (F.col("dove_score") != 0)
    item = F.struct((-F.abs("net_score")).alias("o"), F.col("pos").alias("p"), "sentence", "hawk_score", "dove_score", "net_score", "hawk_signals", "dove_signals")
    agg = scored.groupBy(key).agg(
        F.first("_len").alias("_len"), F.coalesce(F.sum(F.when(used, F.col("hawk_score"))), F.lit(0)).alias("hawkish_score"), F.coalesce(F.sum(F.when(used, F.col("dove_score"))), F.lit(0)).alias("dovish_score"),
        F.count_if(used).alias("match_count"), F.slice(F.array_sort(F.collect_list(F.when(used, item))), 1, most).alias("evidence"),
    )
    raw = F.col("hawkish_score") + F.col("dovish_score")
    score = F.greatest(F.least(raw, F.lit(clip)), F.lit(-clip))
    conf = F.when(F.col("_len") < 100, "LOW").when(F.col("match_count") >= 4, "HIGH").when(F.col("match_count") >= 1, "MEDIUM").otherwise("LOW")
    return agg.select(key, score.alias("score"), raw.alias("raw_score"), stance(score).alias("label"), conf.alias("confidence"), "hawkish_score", "dovish_score", "match_count", F.transform("evidence", lambda e: e.dropFields("o", "p")).alias("evidence"))


def quality_points(date: Column, speaker: Column, title: Column, text: Column, least: int = 500) -> Column:
    """How complete a scraped row is: 2 each for date, speaker and a long text, 1 for the title, 2 for any text."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.when(has(date), 2).otherwise(0) + F.when(has(speaker), 2).otherwise(0) + F.when(has(title), 1).otherwise(0) + F.when(has(text), 2).otherwise(0) + F.when(F.length(text) >= least, 2).otherwise(0)
