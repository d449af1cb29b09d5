"""The corpus pipeline over `documents`: toxic and poor documents go, of near copies one stays, repeated passages are cut
out, and what is left is tokenised and packed.

Every stage takes what its predecessor kept and, but for the last, returns the columns of `documents`.  run() writes each
stage's rows below spark.checkpoint.dir before the next stage reads them, so a lost executor costs part of one stage.
Null and empty texts, missing and repeated ids and empty tables are treated as each stage's operator documents: of rows that
share an id and a text one stays, and a null text counts as empty.  Columns of documents beyond COLUMNS are dropped by the
first stage, so they cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import near_join, packing, quality, substrings, toxicity
from tidemark.llm._store import written
from tidemark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return toxicity.keep_clean(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.fit(docs, _labels(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.keep_one_each(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    kept = substrings.remove_repeats(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(kind)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select(*COLUMNS), tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near copies", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("packing", pack),
]

#: The trained filters cannot be put in SQL; tests/llm/test_pipeline.py holds every stage and run() against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
