"""Hand-computed signals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import stance
from tidemark.operators import signals as S

DAY = dt.date(2024, 1, 31)


def rows(spark, scores, relevance="HIGH", source="OFFICIAL", preferred=None):
    """Newest first, one a day."""
    data = [(k, "m", DAY - dt.timedelta(days=k), s, relevance, source, (preferred or [False] * len(scores))[k]) for k, s in enumerate(scores)]
    return spark.createDataFrame(data, "seq long, member string, d date, score int, relevance string, source_type string, preferred boolean")


@pytest.mark.parametrize("scores,want", [([6, 4, 0, -2, 3], (2.5, "NEUTRAL_HAWKISH", "HIGH", 5)), ([4], (4.0, "NEUTRAL_HAWKISH", "LOW", 1)), ([], None), ([None, 5, 5], (5.0, "HAWKISH", "MEDIUM", 2)), ([1, 1, 1, 1, 1, 99], (1.0, "NEUTRAL", "HIGH", 5))])
def test_evidence_score(spark, scores, want):
    got = S.evidence_score(rows(spark, scores), F.lit(True)).collect()
    assert [tuple(r)[1:] for r in got] == ([want] if want else [])


@pytest.mark.parametrize("scores,want", [([5, 4, 3, 1, 0, -1], (4.0, "STRONG_HAWKISH_SHIFT", "HIGH")), ([5, 4, 3, 1, 9], (2.5, "HAWKISH_SHIFT", "LOW")), ([5, 4, 3], (None, "INSUFFICIENT", "INSUFFICIENT")), ([0] * 6, (0.0, "STABLE", "HIGH"))])
def test_momentum(spark, scores, want):
    r = S.momentum(rows(spark, scores)).first()
    assert (r.momentum_score, r.momentum_label, r.momentum_confidence) == want


def test_current_takes_places_before_nulls(spark):
    r = S.current_stance(rows(spark, [None, None, 4, 4, 4, -9])).first()
    assert (r.speech_score, r.speech_label, r.sample_count) == (4.0, "HAWKISH", 3)


def test_clusters_and_summary(spark):
    df = spark.createDataFrame([(1, "m", DAY, 3, True), (2, "m", DAY - dt.timedelta(days=1), -1, False), (3, "m", DAY - dt.timedelta(days=1), 2, True), (4, "m", None, 0, True)], "seq long, member string, d date, score int, preferred boolean")
    c = S.news_clusters(df)
    assert sorted((r.cluster_date, r.cluster_score) for r in c.collect()) == [("2024-01-30", 0.8), ("2024-01-31", 3.0)]
    s = S.cluster_summary(c).first()
    assert (s.news_score, s.news_label, s.cluster_confidence) == (2.0, "NEUTRAL_HAWKISH", "MEDIUM")


@pytest.mark.parametrize("speech,label,news,want", [(4.0, "HAWKISH", 2.0, (3.4, "NEUTRAL_HAWKISH", "CONFIRMED")), (-4.0, "DOVISH", 2.0, (-2.2, "NEUTRAL_DOVISH", "DIVERGENCE")), (1.0, "NEUTRAL_HAWKISH", None, (1.0, "NEUTRAL_HAWKISH", "NEWS_INSUFFICIENT")), (None, "UNKNOWN", 2.0, (0.6, "NEUTRAL", "UNKNOWN"))])
def test_consensus(spark, speech, label, news, want):
    a = spark.createDataFrame([("m", speech, label)], "member string, speech_score double, speech_label string")
    b = spark.createDataFrame([("m", news, "NEUTRAL_HAWKISH" if news else "INSUFFICIENT")], "member string, news_score double, news_label string")
    r = S.consensus(a, b).first()
    assert (r.consensus_score, r.consensus_label, r.cross_check) == want


@pytest.mark.parametrize("aux,news,want", [((1.5, 2), (2.0, 2, "MEDIUM"), (1.75, "NEUTRAL_HAWKISH", "HIGH")), (None, None, (None, "INSUFFICIENT", "INSUFFICIENT")), ((1.0, 1), None, (1.0, "NEUTRAL_HAWKISH", "LOW"))])
def test_recent(spark, aux, news, want):
    m = spark.createDataFrame([("m",)], "member string")
    a = spark.createDataFrame([("m", *aux)] if aux else [], "member string, aux_score double, aux_count long")
    n = spark.createDataFrame([("m", *news)] if news else [], "member string, news_score double, news_usable_count long, news_confidence string")
    r = S.recent_signal(m, a, n).first()
    assert (r.recent_score, r.recent_signal, r.recent_confidence) == want


@pytest.mark.parametrize("m,mc,r,rc,want", [(2.5, "HIGH", 1.75, "HIGH", (2.35, "NEUTRAL_HAWKISH", "HIGH", False)), (4.0, "HIGH", -3.0, "LOW", (3.3, "NEUTRAL_HAWKISH", "MEDIUM", True)), (None, None, 1.2, "LOW", (1.2, "NEUTRAL", "LOW", False)), (None, None, None, None, (None, "INSUFFICIENT", "INSUFFICIENT", False)), (float("nan"), "HIGH", 2.0, "HIGH", (2.0, "NEUTRAL_HAWKISH", "LOW", False))])
def test_final(spark, m, mc, r, rc, want):
    a = spark.createDataFrame([("m", m, mc)], "member string, model_score double, model_confidence string")
    b = spark.createDataFrame([("m", r, rc)], "member string, recent_score double, recent_confidence string")
    x = S.final_stance(a, b).first()
    assert (x.final_score, x.final_stance, x.final_confidence, x.signal_conflict) == want


def test_labels_at_cuts(spark):
    xs = [4.0, 3.99, 1.0, 0.99, -0.99, -1.0, -4.0, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stance(F.col("x"), missing="UNKNOWN")).collect()]
    assert got == ["HAWKISH", "NEUTRAL_HAWKISH", "NEUTRAL_HAWKISH", "NEUTRAL", "NEUTRAL", "NEUTRAL_DOVISH", "DOVISH", "NEUTRAL", "UNKNOWN"]


def test_auxiliary_excludes_evidence(spark):
    df = rows(spark, [2, 2, 6], relevance="MEDIUM")
    used = spark.createDataFrame([("m", 2)], "member string, seq long")
    r = S.auxiliary_speech(df, used, F.lit(DAY), 90).first()
    assert (r.aux_score, r.aux_count) == (2.0, 2)


def test_rounded_signals_equal_a_plain_model(spark):
    """Every step rounded as Python rounds, over the whole small table."""
    from tidemark.plans.views import utterances

    u = utterances(spark, "/root/testdata/sf0.001")
    rows = sorted(u.collect(), key=lambda r: r.seq)
    by = {}
    for r in sorted(rows, key=lambda r: r.d, reverse=True):
        by.setdefault(r.member, []).append(r)

    def mean(xs):
        return round(sum(xs) / len(xs), 2) if xs else None

    current = {r.member: r.speech_score for r in S.current_stance(u).collect()}
    moved = {r.member: r for r in S.momentum(u).collect()}
    model = {r.member: r.model_score for r in S.evidence_score(u, (F.col("relevance") == "HIGH") & F.col("source_type").isin("OFFICIAL", "INFOMAX")).collect()}
    for member, own in by.items():
        important = [r.score for r in own if r.relevance in ("HIGH", "MEDIUM")]
        assert current[member] == mean(important[:5])
        k = 3 if len(important) >= 6 else 2 if len(important) >= 4 else 0
        if k:
            a, b = mean(important[:k]), mean(important[k : 2 * k])
            assert (moved[member].recent_avg, moved[member].previous_avg, moved[member].momentum_score) == (a, b, round(a - b, 2))
        proof = [r.score for r in own if r.relevance == "HIGH" and r.source_type in ("OFFICIAL", "INFOMAX")][:5]
        weights = [1.0, 0.9, 0.8, 0.7, 0.6]
        want = sum(s * w for s, w in zip(proof, weights)) / sum(weights[: len(proof)]) if proof else None
        assert model[member] == pytest.approx(want, abs=0.0051) if proof else model[member] is None


def test_rounding_is_pythons(spark):
    from tidemark.functions.columns import rounded

    xs = [k / 200 for k in range(-801, 802, 2)] + [1.075, 2.675, 1.005, -1.005, 0.125, 2.5, None] + [k / 1000 for k in range(-995, 1000, 7)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", rounded(F.col("x"), 2).alias("y"), rounded(F.col("x"), 3).alias("z")).collect()
    assert all(r.y is None if r.x is None else (r.y == round(r.x, 2) and r.z == round(r.x, 3)) for r in got)
