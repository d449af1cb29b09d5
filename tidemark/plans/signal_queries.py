"""Signal queries over the statements view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import stance
from ..operators import signals as S
from ..operators.profile import member_signals
from .registry import query
from .views import AS_OF, U, stance_sql, utterances



def _as_of():
    return F.lit(AS_OF).cast("date")


def _eligible():
    return (F.col("relevance") == "HIGH") & F.col("source_type").isin("OFFICIAL", "INFOMAX")


_TOP = "row_number() OVER (PARTITION BY member ORDER BY d DESC, seq)"
_EVIDENCE = f"""ev AS (SELECT * FROM (SELECT *, {_TOP} AS rn FROM u WHERE relevance = 'HIGH' AND source_type IN ('OFFICIAL', 'INFOMAX')) t WHERE rn <= 5)"""
_MODEL = f"""{_EVIDENCE}, ms AS (SELECT member, sum(score * (11 - rn)) / CAST(sum(11 - rn) AS DOUBLE) AS model_score, count(*) AS evidence_count FROM ev GROUP BY member),
model AS (SELECT m.member, model_score, {stance_sql('model_score', 5, 2, 'INSUFFICIENT')} AS model_stance,
  CASE WHEN evidence_count >= 3 THEN 'HIGH' WHEN evidence_count = 2 THEN 'MEDIUM' WHEN evidence_count = 1 THEN 'LOW' ELSE 'INSUFFICIENT' END AS model_confidence,
  coalesce(evidence_count, 0) AS evidence_count FROM (SELECT DISTINCT member FROM u) m LEFT JOIN ms USING (member))"""
_NEWS = f"""nw AS (SELECT member, sum(score * w) FILTER (score <> 0) / CAST(sum(w) FILTER (score <> 0) AS DOUBLE) AS news_score, count(*) AS news_count,
  count(*) FILTER (score <> 0) AS news_usable_count, count(*) FILTER (score <> 0 AND preferred) AS p
  FROM (SELECT *, CASE WHEN preferred THEN 15 ELSE 10 END AS w FROM u WHERE source_type = 'NEWS') t GROUP BY member),
news AS (SELECT member, news_score, {stance_sql('news_score', missing='INSUFFICIENT')} AS news_label, news_count, news_usable_count,
  CASE WHEN news_usable_count >= 4 AND p >= 2 THEN 'HIGH' WHEN news_usable_count >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS news_confidence FROM nw)"""
_CURRENT = f"""cs AS (SELECT member, avg(score) AS speech_score, count(score) AS sample_count FROM (SELECT *, {_TOP} AS rn FROM u WHERE relevance IN ('HIGH', 'MEDIUM')) t WHERE rn <= 5 GROUP BY member),
cur AS (SELECT m.member, speech_score, {stance_sql('speech_score', missing='UNKNOWN')} AS speech_label, coalesce(sample_count, 0) AS sample_count FROM (SELECT DISTINCT member FROM u) m LEFT JOIN cs USING (member))"""
_CLUSTERS = f"""cl AS (SELECT member, CAST(d AS VARCHAR) AS cluster_date, sum(score * w) / CAST(sum(w) AS DOUBLE) AS cluster_score, count(*) AS article_count, count(*) FILTER (preferred) AS preferred_count
  FROM (SELECT *, CASE WHEN preferred THEN 15 ELSE 10 END AS w FROM u WHERE source_type = 'NEWS' AND score <> 0) t GROUP BY member, d)"""
_SUMMARY = f"""cw AS (SELECT *, CASE row_number() OVER (PARTITION BY member ORDER BY cluster_date DESC) WHEN 1 THEN 150 WHEN 2 THEN 125 ELSE 100 END * CASE WHEN preferred_count > 0 THEN 12 ELSE 10 END AS w FROM cl),
su AS (SELECT member, sum(cluster_score * w) / sum(w) AS news_score, count(*) AS cluster_count FROM cw GROUP BY member)"""
_RECENT = f"""ax AS (SELECT member, avg(score) AS aux_score, count(*) AS aux_count FROM (SELECT *, {_TOP} AS rn FROM u
  WHERE relevance IN ('MEDIUM', 'LOW') AND d >= DATE '{AS_OF}' - 7 AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.member = u.member AND ev.seq = u.seq)) t WHERE rn <= 5 GROUP BY member),
rj AS (SELECT m.member, aux_score, coalesce(aux_count, 0) AS aux_count, news_score, coalesce(news_usable_count, 0) AS news_usable_count, coalesce(news_confidence, 'LOW') AS nc
  FROM (SELECT DISTINCT member FROM u) m LEFT JOIN ax USING (member) LEFT JOIN news USING (member)),
rw AS (SELECT *, CASE WHEN aux_score IS NULL THEN 0 WHEN aux_count = 1 THEN 35 WHEN aux_count = 2 THEN 45 ELSE 55 END AS wa,
  CASE WHEN news_score IS NULL OR news_usable_count <= 0 THEN 0 WHEN nc = 'HIGH' THEN 60 WHEN nc = 'MEDIUM' THEN 45 ELSE 25 END AS wn FROM rj),
rs AS (SELECT *, CASE WHEN wa + wn > 0 THEN (coalesce(aux_score, 0) * wa + coalesce(news_score, 0) * wn) / (wa + wn) END AS recent_score FROM rw),
recent AS (SELECT member, recent_score, {stance_sql('recent_score', missing='INSUFFICIENT')} AS recent_signal,
  CASE WHEN aux_count + news_usable_count = 0 THEN 'INSUFFICIENT' WHEN aux_count >= 2 AND news_usable_count >= 2 THEN 'HIGH' WHEN aux_count + news_usable_count >= 3 THEN 'MEDIUM'
    WHEN nc = 'HIGH' AND news_usable_count >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS recent_confidence, aux_count, news_usable_count FROM rs)"""


@query("a3_evidence_score", f"WITH {U}, {_MODEL} SELECT * FROM model")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evidence_score(utterances(spark, sf_dir), _eligible(), digits=None)


@query("a4_evidence_confidence", f"WITH {U}, {_MODEL} SELECT model_confidence, count(*) AS members FROM model GROUP BY model_confidence")
def a4(spark, sf_dir):
    return S.evidence_score(utterances(spark, sf_dir), _eligible(), digits=None).groupBy("model_confidence").agg(F.count(F.lit(1)).alias("members"))


@query("a5_evidence_bundle", f"WITH {U}, {_MODEL}, lst AS (SELECT member, string_agg(CAST(seq AS VARCHAR) || ':' || CAST(score AS VARCHAR), ',' ORDER BY rn) AS evidence FROM ev GROUP BY member) SELECT model.*, evidence FROM model LEFT JOIN lst USING (member)")
def a5(spark, sf_dir):
    b = S.evidence_bundle(utterances(spark, sf_dir), _eligible(), ["seq", "score", "d"], digits=None)
    return b.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat(e["seq"].cast("string"), F.lit(":"), e["score"].cast("string"))), ","))


@query("p7_evidence_summary", f"""WITH {U}, {_EVIDENCE} SELECT member, CAST(rn - 1 AS INTEGER) AS place, seq AS event_id, d AS date, 'Title ' || seq AS title, CASE WHEN preferred THEN 'BOTH' ELSE source_type END AS source_coverage,
  relevance AS fomc_relevance, score AS hawk_dove_score, {stance_sql('score')} AS hawk_dove_label FROM ev""")
def p7(spark, sf_dir):
    u = utterances(spark, sf_dir).withColumns({
        "event_id": F.col("seq"), "date": F.col("d"), "title": F.concat(F.lit("Title "), F.col("seq").cast("string")), "source_coverage": F.when(F.col("preferred"), "BOTH").otherwise(F.col("source_type")),
        "fomc_relevance": F.col("relevance"), "hawk_dove_score": F.col("score"), "hawk_dove_label": stance(F.col("score")),
    })
    return S.evidence_summary(S.evidence_bundle(u, _eligible(), list(S.SUMMARY_FIELDS), digits=None))


@query("a14_news_defaults", f"""WITH {U}, {_NEWS} SELECT m.member, CASE WHEN m.member % 3 <> 0 THEN news_score END AS news_score, CASE WHEN m.member % 5 = 0 THEN 'INSUFFICIENT' ELSE coalesce(news_label, 'INSUFFICIENT') END AS news_label,
  coalesce(news_confidence, 'LOW') AS news_confidence, CASE WHEN m.member % 7 = 0 THEN 0 ELSE coalesce(news_usable_count, 0) END AS news_usable_count FROM (SELECT DISTINCT member FROM u) m LEFT JOIN news USING (member)""")
def a14(spark, sf_dir):
    u, m = utterances(spark, sf_dir), F.col("member")
    news = S.members_of(u).join(S.news_score(u.filter("source_type = 'NEWS'"), digits=None), "member", "left").select(
        "member", F.when(m % 3 == 0, "no number").otherwise(F.col("news_score").cast("string")).alias("news_score"), F.when(m % 5 == 0, "").otherwise(F.col("news_label")).alias("news_label"), "news_confidence", F.when(m % 7 == 0, None).otherwise(F.col("news_usable_count")).alias("news_usable_count"),
    )
    return S.normal_news(news)


@query("w1_top_n", f"WITH {U}, {_EVIDENCE} SELECT member, seq, d, score, CAST(rn AS INT) AS rn FROM ev")
def w1(spark, sf_dir):
    return S.evidence(utterances(spark, sf_dir), _eligible()).select("member", "seq", "d", "score", "rn")


@query("w2_rank_weights", f"WITH {U}, r AS (SELECT *, {_TOP} AS rn FROM u) SELECT member, seq, CASE WHEN rn <= 5 THEN CAST(11 - rn AS INT) ELSE 5 END AS tenths FROM r WHERE rn <= 8")
def w2(spark, sf_dir):
    return S.newest(utterances(spark, sf_dir), 8).select("member", "seq", S.rank_tenths(F.col("rn")).alias("tenths"))


@query("a2_current_stance", f"WITH {U}, {_CURRENT} SELECT * FROM cur")
def a2(spark, sf_dir):
    return S.current_stance(utterances(spark, sf_dir), digits=None)


@query("a6_momentum", f"""WITH {U}, e AS (SELECT *, {_TOP} AS rn, count(*) OVER (PARTITION BY member) AS n FROM u WHERE relevance IN ('HIGH', 'MEDIUM')),
k AS (SELECT member, max(n) AS n, CASE WHEN max(n) >= 6 THEN 3 WHEN max(n) >= 4 THEN 2 ELSE 0 END AS k FROM e GROUP BY member),
g AS (SELECT e.member, avg(score) FILTER (rn <= k) AS ra, avg(score) FILTER (rn > k AND rn <= 2 * k) AS pa FROM e JOIN k USING (member) GROUP BY e.member),
j AS (SELECT m.member, coalesce(k, 0) AS k, coalesce(n, 0) AS n, CASE WHEN k > 0 THEN ra END AS ra, CASE WHEN k > 0 THEN pa END AS pa FROM (SELECT DISTINCT member FROM u) m LEFT JOIN k USING (member) LEFT JOIN g USING (member))
SELECT member, ra - pa AS momentum_score, CASE WHEN ra - pa IS NULL THEN 'INSUFFICIENT' WHEN ra - pa >= 3 THEN 'STRONG_HAWKISH_SHIFT' WHEN ra - pa >= 1 THEN 'HAWKISH_SHIFT' WHEN ra - pa <= -3 THEN 'STRONG_DOVISH_SHIFT' WHEN ra - pa <= -1 THEN 'DOVISH_SHIFT' ELSE 'STABLE' END AS momentum_label,
  CASE k WHEN 3 THEN 'HIGH' WHEN 2 THEN 'LOW' ELSE 'INSUFFICIENT' END AS momentum_confidence, ra AS recent_avg, pa AS previous_avg, CAST(k AS BIGINT) AS recent_count, CAST(k AS BIGINT) AS previous_count, n AS important_count FROM j""")
def a6(spark, sf_dir):
    return S.momentum(utterances(spark, sf_dir), digits=None)


@query("a7_news_score", f"WITH {U}, {_NEWS} SELECT * FROM news")
def a7(spark, sf_dir):
    return S.news_score(_news(spark, sf_dir), digits=None)


def _news(spark, sf_dir):
    return utterances(spark, sf_dir).filter("source_type = 'NEWS'")


@query("a8_news_clusters", f"WITH {U}, {_CLUSTERS} SELECT member, cluster_date, cluster_score, {stance_sql('cluster_score', missing='UNKNOWN')} AS cluster_label, article_count, preferred_count FROM cl")
def a8(spark, sf_dir):
    return S.news_clusters(_news(spark, sf_dir), digits=None)


@query("a9_cluster_summary", f"WITH {U}, cl0 AS (SELECT member, d, sum(score * CASE WHEN preferred THEN 3 ELSE 2 END) AS s, count(*) FILTER (preferred) AS p FROM u WHERE source_type = 'NEWS' AND score <> 0 GROUP BY member, d), cw AS (SELECT *, CASE row_number() OVER (PARTITION BY member ORDER BY d DESC) WHEN 1 THEN 150 WHEN 2 THEN 125 ELSE 100 END * CASE WHEN p > 0 THEN 12 ELSE 10 END AS w FROM cl0), su AS (SELECT member, sum(s * w) / CAST(sum(w) AS DOUBLE) AS news_score, count(*) AS cluster_count FROM cw GROUP BY member) SELECT member, news_score, {stance_sql('news_score', missing='UNKNOWN')} AS news_label, cluster_count, CASE WHEN cluster_count >= 3 THEN 'HIGH' WHEN cluster_count = 2 THEN 'MEDIUM' ELSE 'LOW' END AS cluster_confidence FROM su")
def a9(spark, sf_dir):
    # whole-number cluster scores, so that sums do not depend on their order
    c = _news(spark, sf_dir).filter("score <> 0").groupBy("member", F.col("d").cast("string").alias("cluster_date")).agg(F.sum(F.col("score") * F.when(F.col("preferred"), 3).otherwise(2)).alias("cluster_score"), F.count_if(F.col("preferred")).alias("preferred_count"))
    return S.cluster_summary(c, digits=None)


@query("a10_consensus", f"""WITH {U}, {_CURRENT}, {_NEWS}, j AS (SELECT cur.*, news_score, news_label, CASE WHEN news_score IS NULL THEN coalesce(speech_score, 0.0) ELSE coalesce(speech_score, 0.0) * 0.7::DOUBLE + news_score * 0.3::DOUBLE END AS c,
  CASE WHEN speech_label IN ('HAWKISH', 'NEUTRAL_HAWKISH') THEN 1 WHEN speech_label IN ('DOVISH', 'NEUTRAL_DOVISH') THEN -1 WHEN speech_label = 'NEUTRAL' THEN 0 END AS x,
  CASE WHEN news_label IN ('HAWKISH', 'NEUTRAL_HAWKISH') THEN 1 WHEN news_label IN ('DOVISH', 'NEUTRAL_DOVISH') THEN -1 WHEN news_label = 'NEUTRAL' THEN 0 END AS y FROM cur LEFT JOIN news USING (member))
SELECT member, speech_score, news_score, c AS consensus_score, {stance_sql('c', missing='UNKNOWN')} AS consensus_label,
  CASE WHEN news_score IS NULL THEN 'NEWS_INSUFFICIENT' WHEN x IS NULL OR y IS NULL THEN 'UNKNOWN' WHEN x * y = -1 THEN 'DIVERGENCE' WHEN x = y THEN 'CONFIRMED' ELSE 'PARTIAL' END AS cross_check FROM j""")
def a10(spark, sf_dir):
    u = utterances(spark, sf_dir)
    return S.consensus(S.current_stance(u, digits=None), S.news_score(u.filter("source_type = 'NEWS'"), digits=None), digits=None)


def _aux(u):
    return S.auxiliary_speech(u, S.evidence(u, _eligible()), _as_of(), days=7, digits=None)


@query("a11_auxiliary_speech", f"WITH {U}, {_MODEL}, {_NEWS}, {_RECENT} SELECT * FROM ax")
def a11(spark, sf_dir):
    return _aux(utterances(spark, sf_dir))


def all_signals(u):
    """Every signal of every member, from one pass over the statements."""
    return member_signals(u, _eligible(), F.col("source_type") == "NEWS", _as_of(), days=7, digits=None)


def _recent(u):
    none = F.lit(0).cast("long")
    return all_signals(u).select("member", "recent_score", "recent_signal", "recent_confidence", "aux_count", F.coalesce("news_usable_count", none).alias("news_usable_count"))


@query("a12_recent_signal", f"WITH {U}, {_MODEL}, {_NEWS}, {_RECENT} SELECT * FROM recent")
def a12(spark, sf_dir):
    return _recent(utterances(spark, sf_dir))


@query("a13_recent_confidence", f"WITH {U}, {_MODEL}, {_NEWS}, {_RECENT} SELECT recent_confidence, count(*) AS members FROM recent GROUP BY 1")
def a13(spark, sf_dir):
    return _recent(utterances(spark, sf_dir)).groupBy("recent_confidence").agg(F.count(F.lit(1)).alias("members"))


_FINAL = f"""{_MODEL}, {_NEWS}, {_RECENT}, fj AS (SELECT member, model_score AS m, recent_score AS r, coalesce(model_confidence, '') AS mc, coalesce(recent_confidence, '') AS rc FROM model FULL JOIN recent USING (member)),
fw AS (SELECT *, (1 - CASE mc WHEN 'HIGH' THEN 0.8::DOUBLE WHEN 'MEDIUM' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END) * CASE rc WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.75::DOUBLE WHEN 'LOW' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS sh FROM fj),
fs AS (SELECT *, CASE WHEN m IS NOT NULL AND r IS NOT NULL THEN m * (1 - sh) + r * sh ELSE coalesce(m, r) END AS final_score,
  coalesce(m IS NOT NULL AND r IS NOT NULL AND sign(m) * sign(r) = -1 AND abs(m) >= 2 AND abs(r) >= 2, false) AS clash FROM fw),
final AS (SELECT member, final_score, {stance_sql('final_score', 5, 2, 'INSUFFICIENT')} AS final_stance,
  CASE WHEN m IS NULL AND r IS NULL THEN 'INSUFFICIENT' WHEN m IS NULL THEN 'LOW' WHEN r IS NULL THEN CASE WHEN mc IN ('HIGH', 'MEDIUM', 'LOW') THEN mc ELSE 'LOW' END
    WHEN clash THEN CASE mc WHEN 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END WHEN mc = 'HIGH' THEN 'HIGH' WHEN mc = 'MEDIUM' THEN CASE WHEN rc IN ('HIGH', 'MEDIUM') THEN 'MEDIUM' ELSE 'LOW' END
    WHEN rc = 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS final_confidence,
  CASE WHEN m IS NOT NULL AND r IS NOT NULL THEN 1 - sh WHEN m IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS model_weight,
  CASE WHEN m IS NOT NULL AND r IS NOT NULL THEN sh WHEN r IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recent_weight, clash AS signal_conflict,
  CASE WHEN m IS NULL AND r IS NULL THEN '{S.REASONS['none']}' WHEN m IS NULL THEN '{S.REASONS['recent']}' WHEN r IS NULL THEN '{S.REASONS['model']}' WHEN clash THEN '{S.REASONS['conflict']}' WHEN sign(m) * sign(r) = 1 THEN '{S.REASONS['agreed']}' ELSE '{S.REASONS['adjusted']}' END AS final_reason FROM fs)"""


def final(spark, sf_dir):
    return all_signals(utterances(spark, sf_dir)).select("member", "final_score", "final_stance", "final_confidence", "model_weight", "recent_weight", "signal_conflict", "final_reason")


query("a15_final_stance", f"WITH {U}, {_FINAL} SELECT * FROM final")(final)


@query("a16_final_confidence", f"WITH {U}, {_FINAL} SELECT final_confidence, signal_conflict, count(*) AS members FROM final GROUP BY 1, 2")
def a16(spark, sf_dir):
    return final(spark, sf_dir).groupBy("final_confidence", "signal_conflict").agg(F.count(F.lit(1)).alias("members"))


@query("a17_counters", f"WITH {U} SELECT c.relevance, count(u.seq) AS n FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW'), ('NONE')) c(relevance) LEFT JOIN u USING (relevance) GROUP BY 1")
def a17(spark, sf_dir):
    return S.counted(utterances(spark, sf_dir), "relevance", ["HIGH", "MEDIUM", "LOW", "NONE"])


@query("a18_cutoffs", f"WITH {U} SELECT member, max(d) - 14 AS cutoff FROM u GROUP BY member")
def a18(spark, sf_dir):
    return S.cutoffs(utterances(spark, sf_dir), 14)


@query("f13_look_back", f"WITH {U} SELECT seq, member, d FROM u WHERE d >= DATE '{AS_OF}' - 14")
def f13(spark, sf_dir):
    return utterances(spark, sf_dir).filter(F.col("d") >= F.date_sub(_as_of(), 14)).select("seq", "member", "d")


@query("f14_incremental_window", f"WITH {U}, c AS (SELECT member, max(d) - 7 AS cutoff FROM u WHERE seq % 2 = 0 GROUP BY member) SELECT u.seq, u.member FROM u LEFT JOIN c USING (member) WHERE seq % 2 = 1 AND (cutoff IS NULL OR d IS NULL OR d >= cutoff)")
def f14(spark, sf_dir):
    from ..streaming.incremental import inside_window

    u = utterances(spark, sf_dir)
    return inside_window(u.filter("seq % 2 = 1"), S.cutoffs(u.filter("seq % 2 = 0"), 7)).select("seq", "member")


@query("t4_running_evidence", f"WITH {U}, {_MODEL}, n AS (SELECT member, max(d) AS newest, count(*) AS taken FROM u GROUP BY member) SELECT model.*, newest, taken, CAST(0 AS BIGINT) AS late FROM model JOIN n USING (member)")
def t4(spark, sf_dir):
    """The statements as a stream that is taken in one go: what its state gives is what the batch plan gives."""
    from ..sources.tables import folder
    from ..streaming.incremental import stream_of
    from ..streaming.running import running_evidence

    u, out = utterances(spark, sf_dir), folder(spark, "running")
    u.write.parquet(f"{out}/in")
    results = running_evidence(stream_of(spark, f"{out}/in", u.schema), _eligible(), digits=None)
    run = results.writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.parquet(f"{out}/rows/batch={k}")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    rows = spark.read.schema(results.schema).parquet(f"{out}/rows")  # a member's last row has taken the most
    return rows.groupBy("member").agg(F.max_by(F.struct(*(c for c in results.columns if c != "member")), "taken").alias("x")).select("member", "x.*")


@query("f20_momentum_rows", f"WITH {U} SELECT seq, member, score FROM u WHERE relevance IN ('HIGH', 'MEDIUM') AND score IS NOT NULL")
def f20(spark, sf_dir):
    return utterances(spark, sf_dir).filter(F.col("relevance").isin(*S.IMPORTANT) & S.number(F.col("score")).isNotNull()).select("seq", "member", "score")


@query("f1_minimum_relevance", f"WITH {U} SELECT seq FROM u WHERE CASE relevance WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END >= 2")
def f1(spark, sf_dir):
    from ..operators.filters import at_least

    return utterances(spark, sf_dir).filter(at_least(F.col("relevance"), "MEDIUM")).select("seq")


@query("q2_kpis", f"WITH {U} SELECT count(*) AS n, count(*) FILTER (relevance = 'HIGH') AS high, count(*) FILTER (score >= 1) AS hawk_family, count(*) FILTER (score <= -1) AS dove_family, min(d) AS first_day, max(d) AS last_day FROM u")
def q2(spark, sf_dir):
    from .serve import kpis

    return kpis(utterances(spark, sf_dir))


@query("k3_member_summary", f"WITH {U}, l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY member ORDER BY d DESC NULLS LAST, seq) = 1), n AS (SELECT member, count(*) FILTER (relevance IN ('HIGH', 'MEDIUM')) AS important, count(*) AS total FROM u GROUP BY member) SELECT member, seq AS latest_seq, d AS latest_d, score AS latest_score, relevance AS latest_relevance, source_type AS latest_source_type, preferred AS latest_preferred, important, total, row_number() OVER (ORDER BY d DESC NULLS LAST, member) AS place FROM l JOIN n USING (member)")
def k3(spark, sf_dir):
    from pyspark.sql import Window as W

    from .serve import member_summary

    order = W.orderBy(F.col("latest_d").desc_nulls_last(), "member")  # one row a member
    return member_summary(utterances(spark, sf_dir)).withColumn("place", F.row_number().over(order).cast("long"))


@query("a20_first_filled", f"WITH {U} SELECT member, arg_min(score, seq) AS score FROM u WHERE score IS NOT NULL GROUP BY member")
def a20(spark, sf_dir):
    return utterances(spark, sf_dir).filter("score is not null").groupBy("member").agg(F.min_by("score", "seq").alias("score"))


@query("a21_first_event", f"WITH {U} SELECT member, seq, d, score FROM u QUALIFY row_number() OVER (PARTITION BY member ORDER BY seq) = 1")
def a21(spark, sf_dir):
    return S.first_per_key(utterances(spark, sf_dir), "member").select("member", "seq", "d", "score")


@query("q7_members", f"WITH {U} SELECT DISTINCT member FROM u")
def q7(spark, sf_dir):
    return S.members_of(utterances(spark, sf_dir)).orderBy("member")


@query("q4_drill_down", f"WITH {U} SELECT seq, d, score FROM u WHERE member = 1")
def q4(spark, sf_dir):
    return utterances(spark, sf_dir).filter("member = 1").orderBy(F.desc("d"), "seq").select("seq", "d", "score")


@query("l3_summary_order", f"WITH {U}, {_FINAL} SELECT member, final_score, row_number() OVER (ORDER BY final_score DESC NULLS LAST, model_score DESC NULLS LAST, member) AS place FROM final LEFT JOIN model USING (member)")
def l3(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = all_signals(utterances(spark, sf_dir))
    order = W.orderBy(F.col("final_score").desc_nulls_last(), F.col("model_score").desc_nulls_last(), "member")
    return rows.select("member", "final_score", F.row_number().over(order).cast("long").alias("place"))
