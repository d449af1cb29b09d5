"""All signals of an entity in one pass over its rows.

The signals rest on sums and on the newest few rows that meet some condition, each its own.  Rows are dealt out once by
entity and salt, so an entity with a third of all rows is many tasks' work.  In each share, rows of the same *kind* (which
conditions they meet) are ranked, and of each kind only as many stay as any signal can look at; a share then is one row of
sums and a short array.  An entity's shares meet as one row, its newest rows are picked from the joined array, and all
signals are expressions of that row.  Attaching the result to the rows takes their shares as they already lie, so the
whole costs one scan, the shuffle of the rows, and two of bounded rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import number, stance
from . import attach, signals

#: Shuffle partitions for each share that an entity's rows are dealt to.
PARTITIONS_A_SHARE = 4
#: Rows that momentum looks at.
MOMENTUM_ROWS = 6


def dealt(rows: DataFrame, identity: str = "seq") -> DataFrame:
    """Rows by entity and share; a share depends on the row alone.

    Both keys are never null (a missing member is an entity that holds null), so that Spark has no filter to add to one use
    of the shuffled rows and not to the other: they would be shuffled twice.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    share = F.coalesce(F.pmod(F.xxhash64(identity), F.lit(max(1, n // PARTITIONS_A_SHARE))).cast("int"), F.lit(0))
    return rows.withColumns({"entity": F.struct("member"), "share": share}).drop("member").repartition(n, "entity", "share")


def _mean(rows: str, lo: int, n: int) -> str:
    """Of the scores that are there among n rows; null for none."""
    there = f"filter(transform(slice({rows}, {lo}, {n}), r -> r.score), x -> x is not null)"
    return f"aggregate({there}, 0D, (a, x) -> a + x) / nullif(size({there}), 0)"


def shares(rows: DataFrame, eligible: Column, news: Column, as_of: Column, days: int, n: int, identity: str) -> DataFrame:
    """A row of sums and candidates for each entity and share."""
    important, scored = F.col("relevance").isin(*signals.IMPORTANT), F.col("score").isNotNull()
    conditions = {
        "evidence": eligible & scored, "important": important, "moving": important & number(F.col("score")).isNotNull(),
        "aux": F.col("relevance").isin("MEDIUM", "LOW") & scored & (F.col("d") >= F.date_sub(as_of, days)),
    }
    rows = rows.withColumns({f"is_{k}": F.coalesce(c, F.lit(False)) for k, c in conditions.items()})
    kinds = [f"is_{k}" for k in conditions]
    order = W.partitionBy("entity", "share", *kinds).orderBy(F.col("d").desc_nulls_last(), "seq")
    looked_at = max(2 * n, MOMENTUM_ROWS)  # auxiliary rows come after the evidence is taken out
    stays = (F.greatest(*(F.col(k).cast("int") for k in kinds)) == 1) & (F.row_number().over(order) <= looked_at)
    row = F.struct(F.col("d").isNull().alias("undated"), (-F.unix_date(F.col("d").cast("date"))).alias("age"), "seq", F.col(identity).alias("id"), "score", *kinds)
    rows = rows.withColumn("stays", stays)
    used = news & (F.col("score") != 0) & scored
    tenths = F.when(F.col("preferred"), 15).otherwise(10)
    return rows.groupBy("entity", "share").agg(
        F.collect_list(F.when(F.col("stays"), row)).alias("rows"),
        F.count_if("is_moving").alias("important_count"), F.count_if(news).alias("news_count"), F.count_if(used).alias("news_usable_count"),
        F.count_if(used & F.col("preferred")).alias("news_preferred"), F.sum(F.when(used, F.col("score") * tenths)).alias("news_sum"), F.sum(F.when(used, tenths)).alias("news_weight"),
    )


def member_signals(rows: DataFrame, eligible: Column, news: Column, as_of: Column, days: int = 90, n: int = 5, digits: int | None = 2, identity: str = "seq") -> DataFrame:
    """(member, all signals' columns) of every entity; news: which rows are news."""
    rows = dealt(rows.filter("member is not null"), identity)
    return _signals(rows, eligible, news, as_of, days, n, digits, identity).select(F.col("entity.member").alias("member"), "*").drop("entity", "shares")


def _signals(rows: DataFrame, eligible: Column, news: Column, as_of: Column, days: int, n: int, digits: int | None, identity: str) -> DataFrame:
    """(entity, its shares, all signals' columns) of rows that dealt() dealt out."""
    parts = shares(rows, eligible, news, as_of, days, n, identity)
    sums = ["important_count", "news_count", "news_usable_count", "news_preferred", "news_sum", "news_weight"]
    one = parts.groupBy("entity").agg(F.collect_list("share").alias("shares"), F.array_sort(F.flatten(F.collect_list("rows"))).alias("rows"), *(F.sum(c).alias(c) for c in sums))

    def of(kind: str, most: int) -> str:
        return f"slice(filter(rows, r -> r.is_{kind}), 1, {most}) AS {kind}"

    one = one.selectExpr("entity", "shares", "rows", *sums, of("evidence", n), of("important", n), of("moving", MOMENTUM_ROWS))
    one = one.selectExpr("*", f"slice(filter(rows, r -> r.is_aux and not array_contains(transform(evidence, e -> e.id), r.id)), 1, {n}) AS aux")
    tenths = f"CASE i {' '.join(f'WHEN {i} THEN {w}' for i, w in enumerate(signals.RANK_TENTHS))} ELSE {signals.REST_TENTHS} END"
    total = lambda x: f"aggregate(transform(evidence, (r, i) -> {x}), 0D, (a, x) -> a + x)"
    raw = one.selectExpr(
        "entity", "shares", f"{total(f'r.score * {tenths}')} / nullif({total(tenths)}, 0) AS model_raw", "cast(size(evidence) as long) AS evidence_count",
        f"{_mean('important', 1, n)} AS speech_raw", "cast(size(filter(important, r -> r.score is not null)) as long) AS sample_count",
        "important_count", f"{_mean('moving', 1, 3)} AS a3", f"{_mean('moving', 4, 3)} AS b3", f"{_mean('moving', 1, 2)} AS a2", f"{_mean('moving', 3, 2)} AS b2",
        f"{_mean('aux', 1, n)} AS aux_raw", "cast(size(aux) as long) AS aux_count",
        "news_sum / news_weight AS news_raw", "nullif(news_count, 0) AS news_count", "if(news_count > 0, news_usable_count, null) AS news_usable", "news_preferred",
    )
    known = raw.select(
        "entity", "shares", *signals.model_columns(F.col("model_raw"), F.col("evidence_count"), digits), *signals.current_columns(F.col("speech_raw"), F.col("sample_count"), digits),
        *signals.momentum_columns(F.col("important_count"), *(F.col(c) for c in ("a3", "b3", "a2", "b2")), digits=digits),
        signals.rounded(F.col("aux_raw"), digits).alias("aux_score"), "aux_count", "news_usable",
        *(F.when(F.col("news_count").isNotNull(), c).alias(k) for k, c in zip(("news_score", "news_label", "news_count", "news_usable_count", "news_confidence"), signals.news_columns(F.col("news_raw"), F.col("news_count"), F.col("news_usable"), F.col("news_preferred"), digits))),
    )
    known = known.withColumns({k: c for k, c in zip(("recent_score", "recent_signal", "recent_confidence"), signals.recent_columns(F.col("aux_score"), F.col("aux_count"), F.col("news_score"), F.col("news_usable"), F.col("news_confidence"), digits))})
    final = signals.final_columns(F.col("model_score"), F.col("model_confidence"), F.col("recent_score"), F.col("recent_confidence"), digits)
    return known.drop("news_usable").select("*", *final)


def attach_signals(rows: DataFrame, eligible: Column, news: Column, as_of: Column, days: int = 90, n: int = 5, digits: int | None = 2, identity: str = "seq") -> DataFrame:
    """Every row with all signals of its entity, and their defaults where there is none.

    Rows that hold no more columns than the signals need are shuffled once for both; others once as they are and once narrow.
    """
    columns, rows = rows.columns, dealt(rows, identity)
    found = _signals(rows, eligible, news, as_of, days, n, digits, identity)
    renamed = {
        "model_stance": "model_stance", "model_score": "model_score", "model_confidence": "model_confidence", "evidence_count": "model_evidence_count", "recent_signal": "recent_signal", "recent_score": "recent_signal_score",
        "recent_confidence": "recent_signal_confidence", "aux_score": "aux_speech_score", "aux_count": "aux_speech_count", "final_stance": "final_stance", "final_score": "final_score", "final_confidence": "final_confidence",
        "model_weight": "final_model_weight", "recent_weight": "final_recent_weight", "signal_conflict": "final_signal_conflict", "final_reason": "final_reason", "momentum_score": "momentum_score", "momentum_label": "momentum_label",
        "momentum_confidence": "momentum_confidence", "recent_avg": "momentum_recent_avg", "previous_avg": "momentum_previous_avg", "recent_count": "momentum_recent_count", "previous_count": "momentum_previous_count",
        "important_count": "momentum_total_important_count", "speech_score": "speech_current_score", "speech_label": "speech_current_label", "sample_count": "speech_sample_count", "news_score": "news_score", "news_label": "news_label",
        "news_count": "news_count", "news_usable_count": "news_usable_count", "news_confidence": "news_confidence",
    }
    more = {"aux_speech_label": stance(F.col("aux_score"), missing="INSUFFICIENT"), "recent_news_score": F.col("news_score"), "recent_news_label": F.col("news_label"), "recent_news_confidence": F.col("news_confidence"), "recent_news_usable_count": F.col("news_usable_count")}
    results = found.select("entity", F.explode(F.when(F.col("entity.member").isNotNull(), F.col("shares"))).alias("share"), *(F.col(a).alias(b) for a, b in renamed.items()), *(c.alias(k) for k, c in more.items()))
    out = rows.join(results, ["entity", "share"], "left").withColumn("member", F.col("entity.member"))
    out = out.select(*columns, *(c for c in out.columns if c not in {*columns, "entity", "share"}))
    return attach.filled(out, attach.EVENT_DEFAULTS).withColumn("recent_lookback_days", F.lit(days))
