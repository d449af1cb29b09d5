"""All signals in one pass against each signal by itself, an entity with most rows, and the plan."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile
from tidemark.operators import signals as S

DAY = dt.date(2024, 1, 31)
SCHEMA = "seq long, member string, d date, score double, relevance string, source_type string, preferred boolean"


def statements(seed, n=900):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        member = rng.choice(["hot", "hot", "hot", "a", "b", "c", None, f"few{rng.randrange(60)}"])
        day = rng.choice([None, *(DAY - dt.timedelta(days=rng.randrange(30)) for _ in range(9))])
        rows.append((k, member, day, rng.choice([None, float("nan"), -6.5, -2.0, 0.0, 0.125, 1.5, 4.0, 6.0]), rng.choice(["HIGH", "MEDIUM", "LOW", None]), rng.choice(["OFFICIAL", "NEWS", None]), rng.random() < 0.3))
    return rows


def singly(df, eligible, as_of, days):
    news = S.news_score(df.filter("source_type = 'NEWS'"))
    aux = S.auxiliary_speech(df, S.evidence(df, eligible), as_of, days)
    model = S.evidence_score(df, eligible)
    recent = S.recent_signal(S.members_of(df), aux, news)
    out = S.members_of(df)
    for other in (model, S.current_stance(df), S.momentum(df), news, recent.drop("aux_count", "news_usable_count"), S.final_stance(model, recent), aux):
        out = out.join(other, "member", "left")
    return out


def plain(r):
    return {k: "nan" if v != v else v for k, v in r.asDict().items()}


@pytest.mark.parametrize("shares", [1, 7])
def test_as_each_by_itself(spark, monkeypatch, shares):
    monkeypatch.setattr(profile, "PARTITIONS_A_SHARE", 4 / shares)
    df = spark.createDataFrame(statements(shares), SCHEMA).repartition(5)
    eligible, as_of = (F.col("relevance") == "HIGH") | (F.col("preferred") & (F.col("relevance") == "MEDIUM")), F.lit(DAY)
    got = profile.member_signals(df.filter("score is null or not isnan(score)"), eligible, F.col("source_type") == "NEWS", as_of, 10)
    want = {r.member: plain(r) for r in singly(df.filter("score is null or not isnan(score)"), eligible, as_of, 10).collect()}
    rows = got.collect()
    assert len(rows) == len(want) > 40
    for r in rows:
        one = plain(r)
        assert {k: one[k] for k in want[r.member] if k != "aux_count"} == {k: v for k, v in want[r.member].items() if k != "aux_count"}
        assert (one["aux_count"] or None) == want[r.member]["aux_count"]


def test_rows_keep_their_places_and_columns(spark):
    df = spark.createDataFrame(statements(5), SCHEMA)
    out = profile.attach_signals(df, F.col("relevance") == "HIGH", F.col("source_type") == "NEWS", F.lit(DAY), 10)
    assert out.columns[:7] == df.columns and out.count() == df.count()
    nobody = out.filter("member is null").first()
    assert (nobody.final_stance, nobody.news_count, nobody.final_score, nobody.recent_lookback_days) == ("INSUFFICIENT", 0, None, 10)
    assert profile.attach_signals(df.filter("false"), F.lit(True), F.lit(True), F.lit(DAY)).count() == 0


def test_one_scan_and_three_shuffles(spark, tmp_path):
    spark.createDataFrame(statements(6), SCHEMA).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = profile.attach_signals(spark.read.parquet(str(tmp_path / "t")), F.col("relevance") == "HIGH", F.col("source_type") == "NEWS", F.lit(DAY))
        out.collect()
        ran = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ran.count("FileScan") == 1 and ran.count("+- Exchange hashpartitioning") == 3 and ran.count("ReusedExchange") == 1
