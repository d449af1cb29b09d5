"""Entity-level signals: recency-weighted evidence, momentum, news, consensus, recent signal and final stance.

Inputs are long tables keyed by `member` with a date `d`, an order column `seq` and a `score`.  Top-N selections are
row_number filters, which Spark cuts per task before the shuffle, so an entity with a third of all rows costs no more
than N rows a task; counts and sums are ordinary partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import direction, first_filled, label_direction, number, rounded, stance

#: Weights by rank of evidence, tens of thousandths apart from their tenths.
RANK_TENTHS = (10, 9, 8, 7, 6)
REST_TENTHS = 5
SPEECH_SHARE, NEWS_SHARE = 0.7, 0.3
IMPORTANT = ("HIGH", "MEDIUM")
#: Why a final stance is what it is.
REASONS = {
    "none": "No usable model or recent evidence.",
    "recent": "Model evidence insufficient; recent signal used as fallback.",
    "model": "No usable recent signal; model stance retained.",
    "conflict": "Model and recent signals conflict; model retained as anchor and confidence reduced.",
    "agreed": "Model and recent signals point in the same direction.",
    "adjusted": "Recent signal used as a limited adjustment to the model anchor.",
}


def newest(df: DataFrame, n: int, date: str = "d", rank: str = "rn", key: str = "member") -> DataFrame:
    """The n newest rows of each entity with their rank; ties keep the input's order."""
    w = W.partitionBy(key).orderBy(F.col(date).desc_nulls_last(), F.col("seq"))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def members_of(df: DataFrame) -> DataFrame:
    return df.select("member").filter("member is not null").distinct()


def current_stance(df: DataFrame, n: int = 5, digits: int | None = 2) -> DataFrame:
    """Mean score of the n newest important rows; rows without a score take a place among the n but no part."""
    top = newest(df.filter(F.col("relevance").isin(*IMPORTANT)), n)
    agg = top.groupBy("member").agg(F.avg("score").alias("raw"), F.count("score").cast("long").alias("sample_count"))
    return members_of(df).join(agg, "member", "left").select("member", *current_columns(F.col("raw"), F.col("sample_count"), digits))


def current_columns(raw: Column, n: Column, digits: int | None) -> list[Column]:
    score = rounded(raw, digits)
    return [score.alias("speech_score"), stance(score, missing="UNKNOWN").alias("speech_label"), F.coalesce(n, F.lit(0).cast("long")).alias("sample_count")]


def rank_tenths(rn: Column) -> Column:
    out = F.lit(REST_TENTHS)
    for k, w in reversed(list(enumerate(RANK_TENTHS, 1))):
        out = F.when(rn == k, w).otherwise(out)
    return out


def evidence_confidence(n: Column) -> Column:
    return F.when(n >= 3, "HIGH").when(n == 2, "MEDIUM").when(n == 1, "LOW").otherwise("INSUFFICIENT")


def evidence(df: DataFrame, eligible: Column, n: int = 5) -> DataFrame:
    """The rows that a model score rests on, with their ranks."""
    return newest(df.filter(eligible & F.col("score").isNotNull()), n)


def evidence_score(df: DataFrame, eligible: Column, n: int = 5, digits: int | None = 2) -> DataFrame:
    """Rank-weighted mean of the evidence, its label and its confidence."""
    top = evidence(df, eligible, n).withColumn("w", rank_tenths(F.col("rn")))
    agg = top.groupBy("member").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("raw"), F.count(F.lit(1)).cast("long").alias("evidence_count"))
    return members_of(df).join(agg, "member", "left").select("member", *model_columns(F.col("raw"), F.col("evidence_count"), digits))


def model_columns(raw: Column, n: Column, digits: int | None) -> list[Column]:
    score, n = rounded(raw, digits), F.coalesce(n, F.lit(0).cast("long"))
    return [score.alias("model_score"), stance(score, 5, 2, "INSUFFICIENT").alias("model_stance"), evidence_confidence(n).alias("model_confidence"), n.alias("evidence_count")]


def evidence_bundle(df: DataFrame, eligible: Column, fields: list[str], n: int = 5, digits: int | None = 2) -> DataFrame:
    """evidence_score() with the evidence itself as an array, newest first."""
    rows = evidence(df, eligible, n).groupBy("member").agg(F.array_sort(F.collect_list(F.struct("rn", *fields))).alias("evidence"))
    return evidence_score(df, eligible, n, digits).join(rows, "member", "left").withColumn("evidence", F.transform("evidence", lambda e: F.struct(*(e[f].alias(f) for f in fields))))


def momentum(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Mean of the newest k against the k before: k is 3 from six important scores on, 2 from four on."""
    rows = df.filter(F.col("relevance").isin(*IMPORTANT) & number(F.col("score")).isNotNull())
    n = rows.groupBy("member").agg(F.count(F.lit(1)).cast("long").alias("important_count"))
    mean = lambda lo, hi: F.avg(F.when(F.col("rn").between(lo, hi), F.col("score")))
    agg = newest(rows, 6).groupBy("member").agg(mean(1, 3).alias("a3"), mean(4, 6).alias("b3"), mean(1, 2).alias("a2"), mean(3, 4).alias("b2"))
    out = members_of(df).join(n, "member", "left").join(agg, "member", "left")
    return out.select("member", *momentum_columns(F.col("important_count"), *(F.col(c) for c in ("a3", "b3", "a2", "b2")), digits=digits))


def momentum_columns(n: Column, a3: Column, b3: Column, a2: Column, b2: Column, digits: int | None) -> list[Column]:
    c = F.coalesce(n, F.lit(0).cast("long"))
    k = F.when(c >= 6, 3).when(c >= 4, 2).otherwise(0)
    recent, previous = rounded(F.when(k == 3, a3).when(k == 2, a2), digits), rounded(F.when(k == 3, b3).when(k == 2, b2), digits)
    m = rounded(recent - previous, digits)
    label = F.when(m >= 3, "STRONG_HAWKISH_SHIFT").when(m >= 1, "HAWKISH_SHIFT").when(m <= -3, "STRONG_DOVISH_SHIFT").when(m <= -1, "DOVISH_SHIFT").when(m.isNotNull(), "STABLE").otherwise("INSUFFICIENT")
    return [
        m.alias("momentum_score"), label.alias("momentum_label"), F.when(k == 3, "HIGH").when(k == 2, "LOW").otherwise("INSUFFICIENT").alias("momentum_confidence"),
        recent.alias("recent_avg"), previous.alias("previous_avg"), k.cast("long").alias("recent_count"), k.cast("long").alias("previous_count"), c.alias("important_count"),
    ]


# ---- news -----------------------------------------------------------------------------------------------------------
def _preferred_tenths() -> Column:
    return F.when(F.col("preferred"), 15).otherwise(10)


def news_score(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Weighted mean of non-zero news scores per entity, preferred outlets half as much again."""
    used = (F.col("score") != 0) & F.col("score").isNotNull()
    w = _preferred_tenths()
    agg = df.groupBy("member").agg(
        (F.sum(F.when(used, F.col("score") * w)) / F.sum(F.when(used, w))).alias("raw"),
        F.count(F.lit(1)).cast("long").alias("news_count"), F.count_if(used).cast("long").alias("news_usable_count"), F.count_if(used & F.col("preferred")).alias("p"),
    )
    return agg.select("member", *news_columns(F.col("raw"), F.col("news_count"), F.col("news_usable_count"), F.col("p"), digits))


def news_columns(raw: Column, n: Column, usable: Column, preferred: Column, digits: int | None) -> list[Column]:
    score = rounded(raw, digits)
    sure = F.when((usable >= 4) & (preferred >= 2), "HIGH").when(usable >= 2, "MEDIUM").otherwise("LOW")
    return [score.alias("news_score"), stance(score, missing="INSUFFICIENT").alias("news_label"), n.alias("news_count"), usable.alias("news_usable_count"), sure.alias("news_confidence")]


def normal_news(df: DataFrame) -> DataFrame:
    """News results with what a signal takes where something is missing: a score that is a number, a label, a confidence and a
    count; other columns stay."""
    return df.withColumns({
        "news_score": number(F.col("news_score")), "news_label": F.coalesce(first_filled(F.col("news_label")), F.lit("INSUFFICIENT")), "news_confidence": F.coalesce(first_filled(F.col("news_confidence")), F.lit("LOW")),
        "news_usable_count": F.coalesce(F.col("news_usable_count").try_cast("double").cast("long"), F.lit(0).cast("long")),
    })


#: What an evidence summary tells of each row.
SUMMARY_FIELDS = ("event_id", "date", "title", "source_coverage", "fomc_relevance", "hawk_dove_score", "hawk_dove_label")


def evidence_summary(bundle: DataFrame, fields: tuple[str, ...] = SUMMARY_FIELDS) -> DataFrame:
    """The evidence of an evidence_bundle() as rows (member, place, fields), newest first."""
    return bundle.select("member", F.posexplode("evidence").alias("place", "e")).select("member", "place", *(F.col(f"e.{f}").alias(f) for f in fields))


def news_clusters(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Non-zero news scores of one entity and day as one weighted mean; undated rows share a day that sorts first."""
    w = _preferred_tenths()
    day = F.coalesce(F.nullif(F.col("d").cast("string"), F.lit("")), F.lit("UNKNOWN_DATE"))
    agg = df.filter("score is not null and score <> 0").groupBy("member", day.alias("cluster_date")).agg(
        (F.sum(F.col("score") * w) / F.sum(w)).alias("raw"), F.count(F.lit(1)).cast("long").alias("article_count"), F.count_if(F.col("preferred")).cast("long").alias("preferred_count")
    )
    agg = agg.withColumn("cluster_score", rounded(F.col("raw"), digits))
    return agg.select("member", "cluster_date", "cluster_score", stance(F.col("cluster_score"), missing="UNKNOWN").alias("cluster_label"), "article_count", "preferred_count")


def cluster_summary(clusters: DataFrame, digits: int | None = 2) -> DataFrame:
    """Recency-weighted mean of an entity's clusters (1.5, 1.25, then 1; a fifth more with a preferred outlet)."""
    rn = F.row_number().over(W.partitionBy("member").orderBy(F.col("cluster_date").desc()))
    w = F.when(rn == 1, 150).when(rn == 2, 125).otherwise(100) * F.when(F.col("preferred_count") > 0, 12).otherwise(10)
    agg = clusters.withColumn("w", w).groupBy("member").agg((F.sum(F.col("cluster_score") * F.col("w")) / F.sum("w")).alias("raw"), F.count(F.lit(1)).cast("long").alias("cluster_count"))
    c = F.col("cluster_count")
    agg = agg.withColumn("news_score", rounded(F.col("raw"), digits))
    return agg.select("member", "news_score", stance(F.col("news_score"), missing="UNKNOWN").alias("news_label"), "cluster_count", F.when(c >= 3, "HIGH").when(c == 2, "MEDIUM").otherwise("LOW").alias("cluster_confidence"))


def consensus(speech: DataFrame, news: DataFrame, digits: int | None = 2) -> DataFrame:
    """Speech and news blended 7 : 3, and whether they agree.  A missing speech score counts as 0 of unknown direction."""
    both = speech.join(news.select("member", F.col("news_score"), F.col("news_label")), "member", "left")
    s = F.coalesce("speech_score", F.lit(0.0))
    score = rounded(F.when(F.col("news_score").isNull(), s).otherwise(s * SPEECH_SHARE + F.col("news_score") * NEWS_SHARE), digits)
    a, b = label_direction(F.col("speech_label")), label_direction(F.col("news_label"))
    check = F.when(F.col("news_score").isNull(), "NEWS_INSUFFICIENT").when(a.isNull() | b.isNull(), "UNKNOWN").when(a * b == -1, "DIVERGENCE").when(a == b, "CONFIRMED").otherwise("PARTIAL")
    return both.select("member", "speech_score", "news_score", score.alias("consensus_score"), stance(score, missing="UNKNOWN").alias("consensus_label"), check.alias("cross_check"))


# ---- recent and final -----------------------------------------------------------------------------------------------
def auxiliary_speech(df: DataFrame, used: DataFrame, as_of: Column, days: int = 90, n: int = 5, digits: int | None = 2, identity: str = "seq") -> DataFrame:
    """Mean of the n newest less important rows of the look-back that are no evidence already."""
    rows = df.filter(F.col("relevance").isin("MEDIUM", "LOW") & F.col("score").isNotNull() & (F.col("d") >= F.date_sub(as_of, days)))
    rows = rows.join(used.select("member", identity), ["member", identity], "left_anti")
    agg = newest(rows, n).groupBy("member").agg(F.avg("score").alias("raw"), F.count(F.lit(1)).cast("long").alias("aux_count"))
    return agg.select("member", rounded(F.col("raw"), digits).alias("aux_score"), "aux_count")


def recent_signal(members: DataFrame, aux: DataFrame, news: DataFrame, digits: int | None = 2) -> DataFrame:
    """Auxiliary speech and news weighted by how much of each there is."""
    x = members.join(aux, "member", "left").join(news.select("member", "news_score", "news_usable_count", "news_confidence"), "member", "left")
    score, label, conf = recent_columns(F.col("aux_score"), F.col("aux_count"), F.col("news_score"), F.col("news_usable_count"), F.col("news_confidence"), digits)
    none = F.lit(0).cast("long")
    return x.select("member", score.alias("recent_score"), label.alias("recent_signal"), conf.alias("recent_confidence"), F.coalesce("aux_count", none).alias("aux_count"), F.coalesce("news_usable_count", none).alias("news_usable_count"))


def recent_columns(aux: Column, aux_count: Column, news: Column, usable: Column, sure: Column, digits: int | None) -> list[Column]:
    """The recent score, its label and its confidence."""
    a, u = F.coalesce(aux_count, F.lit(0).cast("long")), F.coalesce(usable, F.lit(0).cast("long"))
    sure = F.coalesce(sure, F.lit("LOW"))
    wa = F.when(aux.isNull() | (a <= 0), 0).when(a == 1, 35).when(a == 2, 45).otherwise(55)
    wn = F.when(news.isNull() | (u <= 0), 0).when(sure == "HIGH", 60).when(sure == "MEDIUM", 45).otherwise(25)
    total = wa + wn
    score = rounded(F.when(total > 0, (F.coalesce(aux, F.lit(0.0)) * wa + F.coalesce(news, F.lit(0.0)) * wn) / total), digits)
    conf = F.when(a + u == 0, "INSUFFICIENT").when((a >= 2) & (u >= 2), "HIGH").when(a + u >= 3, "MEDIUM").when((sure == "HIGH") & (u >= 2), "MEDIUM").otherwise("LOW")
    return [score, stance(score, missing="INSUFFICIENT"), conf]


def final_stance(model: DataFrame, recent: DataFrame, digits: int | None = 2) -> DataFrame:
    """The model score as anchor, moved by the recent signal as far as confidence allows."""
    x = model.select("member", "model_score", "model_confidence").join(recent.select("member", "recent_score", "recent_confidence"), "member", "full_outer")
    return x.select("member", *final_columns(F.col("model_score"), F.col("model_confidence"), F.col("recent_score"), F.col("recent_confidence"), digits))


def final_columns(model: Column, model_confidence: Column, recent: Column, recent_confidence: Column, digits: int | None) -> list[Column]:
    m, r = number(model), number(recent)
    mc, rc = F.coalesce(F.upper(model_confidence), F.lit("")), F.coalesce(F.upper(recent_confidence), F.lit(""))
    share = (1 - F.when(mc == "HIGH", 0.8).when(mc == "MEDIUM", 0.7).otherwise(0.6)) * F.when(rc == "HIGH", 1.0).when(rc == "MEDIUM", 0.75).when(rc == "LOW", 0.5).otherwise(0.0)
    both = m.isNotNull() & r.isNotNull()
    wr = F.when(both, share).when(r.isNotNull(), 1.0).otherwise(0.0)
    wm = F.when(both, 1 - share).when(m.isNotNull(), 1.0).otherwise(0.0)
    score = rounded(F.when(both, m * (1 - share) + r * share).otherwise(F.coalesce(m, r)), digits)
    clash = F.coalesce(both & (direction(m) * direction(r) == -1) & (F.abs(m) >= 2) & (F.abs(r) >= 2), F.lit(False))
    agreed = F.when(mc == "HIGH", "HIGH").when(mc == "MEDIUM", F.when(rc.isin("HIGH", "MEDIUM"), "MEDIUM").otherwise("LOW")).otherwise(F.when(rc == "HIGH", "MEDIUM").otherwise("LOW"))
    conf = (
        F.when(m.isNull() & r.isNull(), "INSUFFICIENT").when(m.isNull(), "LOW").when(r.isNull(), F.when(mc.isin("HIGH", "MEDIUM", "LOW"), mc).otherwise("LOW"))
        .when(clash, F.when(mc == "HIGH", "MEDIUM").otherwise("LOW")).otherwise(agreed)
    )
    why = (
        F.when(m.isNull() & r.isNull(), REASONS["none"]).when(m.isNull(), REASONS["recent"]).when(r.isNull(), REASONS["model"])
        .when(clash, REASONS["conflict"]).when(direction(m) * direction(r) == 1, REASONS["agreed"]).otherwise(REASONS["adjusted"])
    )
    return [score.alias("final_score"), stance(score, 5, 2, "INSUFFICIENT").alias("final_stance"), conf.alias("final_confidence"), rounded(wm, 3 if digits else None).alias("model_weight"), rounded(wr, 3 if digits else None).alias("recent_weight"), clash.alias("signal_conflict"), why.alias("final_reason")]


def counted(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Rows of each category, 0 included for those that do not occur."""
    dim = df.sparkSession.createDataFrame([(c,) for c in categories], f"{column} string")
    return dim.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cutoffs(df: DataFrame, days: int = 30) -> DataFrame:
    """Each entity's newest date less the allowed lateness."""
    return df.groupBy("member").agg(F.date_sub(F.max("d"), days).alias("cutoff"))


def best_per_key(df: DataFrame, key: str, quality: Column) -> DataFrame:
    """Of each key the best row, the first among equals; rows without a key all stay."""
    w = W.partitionBy(key).orderBy(quality.desc_nulls_last(), F.col("seq"))
    keyed = df.filter(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return keyed.unionByName(df.filter(F.col(key).isNull() | (F.col(key) == "")))


def first_per_key(df: DataFrame, key: str) -> DataFrame:
    """Each key's first row in input order."""
    w = W.partitionBy(key).orderBy("seq")
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def event_identity(event_id: Column, date: Column, title: Column) -> Column:
    """What an event is known by: its id, else its date and title."""
    return F.coalesce(F.nullif(F.trim(event_id.cast("string")), F.lit("")), F.concat_ws("|", F.coalesce(date.cast("string"), F.lit("")), F.coalesce(title, F.lit(""))))
