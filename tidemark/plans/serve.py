"""Serving queries and exports over scored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L


def kpis(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relevance") == "HIGH").alias("high"), F.count_if(F.col("score") >= 1).alias("hawk_family"), F.count_if(F.col("score") <= -1).alias("dove_family"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


def member_summary(df: DataFrame) -> DataFrame:
    """One row per member: all columns of its latest row under `latest_`, how many rows are important and how many there are;
    the latest first, then by member."""
    order = F.struct(F.col("d").isNotNull(), "d", -F.col("seq"))
    fields = [c for c in df.columns if c != "member"]
    out = df.filter("member is not null").groupBy("member").agg(F.max_by(F.struct(*fields), order).alias("x"), F.count_if(F.col("relevance").isin("HIGH", "MEDIUM")).alias("important"), F.count(F.lit(1)).alias("total"))
    return out.select("member", *(F.col(f"x.{c}").alias(f"latest_{c}") for c in fields), "important", "total").orderBy(F.col("latest_d").desc_nulls_last(), "member")


def export_frame(df: DataFrame, columns: list[str] = L.EXPORT_COLUMNS, names: dict[str, str] = L.EXPORT_NAMES) -> DataFrame:
    """The fixed columns in order under display names: lists joined, structures as JSON, missing columns null; newest first."""

    def cell(c: str) -> Column:
        if c not in df.columns:
            return F.lit(None).cast("string")
        kind = df.schema[c].dataType.simpleString()
        if kind == "array<string>":
            return F.array_join(F.filter(F.col(c), lambda x: x.isNotNull()), " | ")
        if kind.startswith(("array", "struct", "map")):
            return F.to_json(F.col(c))
        if kind.startswith(("date", "timestamp")):
            return F.date_format(F.col(c), "yyyy-MM-dd")
        return F.col(c)

    out = df.select(*(cell(c).alias(c) for c in columns))
    if {"published_at", "member_name_en"} <= set(columns):
        out = out.orderBy(F.col("published_at").desc_nulls_last(), F.col("member_name_en").asc_nulls_last())
    return out.withColumnsRenamed({c: names.get(c, c) for c in columns})


def speaker_summary(events: DataFrame, results: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per entity: its results and its first event's attributes; best final and model scores first."""
    first = events.groupBy("member").agg(F.min_by(F.struct("seq", "d", "score", "relevance"), "seq").alias("f"))
    out = first.select("member", "f.*").join(attributes, "member", "left").join(results, "member", "left")
    return out.orderBy(F.col("final_score").desc_nulls_last(), F.col("model_score").desc_nulls_last(), "member")


def social_feed(posts: DataFrame, institutional: list[str]) -> DataFrame:
    """Latest post of each entity, entities without one included, personal or institutional."""
    latest = posts.groupBy("member").agg(F.max_by(F.struct("posted_at", "text", "url"), F.struct("posted_at", "url")).alias("p"))
    kind = F.when(F.col("member").isin(*institutional), "INSTITUTIONAL").otherwise("PERSONAL") if institutional else F.lit("PERSONAL")
    return latest.select("member", F.when(F.col("p.posted_at").isNull(), "NO_POST").otherwise("OK").alias("status"), "p.*", kind.alias("account")).orderBy(F.col("posted_at").desc_nulls_last(), "member")


def latest_posts(posts: DataFrame, roster: DataFrame) -> DataFrame:
    """The newest post of each member of the roster that is no reply, and how it went: OK, NO_POST, or ERROR where fetching failed."""
    own = ~F.coalesce("reply", F.lit(False)) & F.col("error").isNull()
    best = posts.groupBy("member").agg(F.max_by("seq", F.when(own, F.struct("posted_at", "seq"))).alias("seq"), F.max(F.when(own, F.col("posted_at"))).alias("posted_at"), F.first("error", ignorenulls=True).alias("error"))
    out = roster.select("member").join(best, "member", "left")
    status = F.when(F.col("error").isNotNull(), "ERROR").when(F.col("seq").isNull(), "NO_POST").otherwise("OK")
    return out.select("member", "seq", "posted_at", "error", status.alias("status"))
