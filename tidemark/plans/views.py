"""Views that give the driver tables the shape of the operators' inputs, in Spark and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored statements of entities."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("member"), F.col("ts").cast("date").alias("d"), (F.floor("value").cast("int") % 13 - 6).alias("score"),
        F.when(F.col("event_type").isin("purchase", "signup"), "HIGH").when(F.col("event_type") == "click", "MEDIUM").otherwise("LOW").alias("relevance"),
        F.when(k % 3 == 0, "OFFICIAL").when(k % 3 == 1, "INFOMAX").otherwise("NEWS").alias("source_type"), (k % 2 == 0).alias("preferred"),
    )


U = """u AS (
  SELECT event_id AS seq, user_id AS member, CAST(ts AS DATE) AS d, CAST(floor(value) AS INT) % 13 - 6 AS score,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'HIGH' WHEN event_type = 'click' THEN 'MEDIUM' ELSE 'LOW' END AS relevance,
    CASE CAST(json_extract_string(props, '$.k') AS INT) % 3 WHEN 0 THEN 'OFFICIAL' WHEN 1 THEN 'INFOMAX' ELSE 'NEWS' END AS source_type,
    CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 AS preferred
  FROM events)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles; whole texts, a title of at most 80 characters."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("seq"), F.col("source").alias("member_name_en"), F.substring("text", 1, 80).alias("title"), "text", "source", "lang",
        F.concat(F.lit("https://"), "source", F.lit(".example.org/a/"), (F.col("doc_id") % 700).cast("string")).alias("url"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")), "yyyy-MM-dd").alias("published_at"),
        F.when(F.col("doc_id") % 3 == 0, "OFFICIAL").when(F.col("doc_id") % 3 == 1, "INFOMAX").otherwise("NEWS").alias("source_type"),
    )


A = """a AS (
  SELECT doc_id AS seq, source AS member_name_en, substr(text, 1, 80) AS title, text, source, lang,
    'https://' || source || '.example.org/a/' || CAST(doc_id % 700 AS VARCHAR) AS url,
    strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INT), '%Y-%m-%d') AS published_at,
    CASE doc_id % 3 WHEN 0 THEN 'OFFICIAL' WHEN 1 THEN 'INFOMAX' ELSE 'NEWS' END AS source_type
  FROM documents)"""


def stance_sql(x: str, strong: float = 4, weak: float = 1, missing: str = "NEUTRAL") -> str:
    return f"CASE WHEN {x} IS NULL THEN '{missing}' WHEN {x} >= {strong} THEN 'HAWKISH' WHEN {x} >= {weak} THEN 'NEUTRAL_HAWKISH' WHEN {x} <= -{strong} THEN 'DOVISH' WHEN {x} <= -{weak} THEN 'NEUTRAL_DOVISH' ELSE 'NEUTRAL' END"
