"""File sources and sinks: rosters, envelopes of articles, exports; latest versions; tolerant reads."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBER = T.StructType([T.StructField(n, T.StringType()) for n in ("name_en", "name_ko", "role_en", "role_ko", "fed")] + [T.StructField(n, T.IntegerType()) for n in ("voter", "vote_year", "priority")] + [T.StructField(n, T.StringType()) for n in ("aliases", "x_handle")])
ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("published_at", "actual_speech_date", "title", "speaker_raw", "url", "source", "source_type", "text")])
ENVELOPE = T.StructType([T.StructField("cache_type", T.StringType()), T.StructField("updated_at", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("mode", T.StringType()), T.StructField("count", T.LongType()), T.StructField("articles", T.ArrayType(ARTICLE))])
#: Encodings in order of trial.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr")


def read_roster(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """A roster from CSV files with a header, each in the first encoding that reads it; `nan` and blanks are null.

    Columns are told by the header, whatever their order, or by their places where it names none of them; quoted fields may
    hold line breaks.
    """
    names = MEMBER.fieldNames()

    def rows(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for e in encodings:
                    try:
                        text = content.decode(e)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text = content.decode(encodings[0], "replace")
                table = csv.reader(io.StringIO(text, newline=""))
                head = [h.strip() for h in next(table, [])]
                place = [head.index(n) if n in head else None for n in names] if set(head) & set(names) else list(range(len(names)))
                own = [[r[p] if p is not None and p < len(r) else None for p in place] for r in table if any(x.strip() for x in r)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in own], pa.string()) for k in range(len(names))], names=names)

    df = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, ", ".join(f"{n} string" for n in names))
    clean = lambda c: F.when(~F.lower(F.trim(c)).isin("", "nan", "none"), F.trim(c))
    return df.select(*((clean(F.col(f.name)) if isinstance(f.dataType, T.StringType) else F.trim(f.name).try_cast("double").cast("int")).alias(f.name) for f in MEMBER))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_envelope(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Articles of a JSON envelope; with `tolerant`, a missing or unreadable file has none."""
    if tolerant and not exists(spark, path):
        return spark.createDataFrame([], ARTICLE)
    df = spark.read.json(path, schema=ENVELOPE, multiLine=True, mode="PERMISSIVE")
    return df.select(F.posexplode("articles").alias("seq", "a")).select("seq", "a.*")


def read_events(spark: SparkSession, path: str, event: str) -> DataFrame:
    """Events (of the schema given) of a JSON payload `{"events": [...]}`, in order; a missing or unreadable file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"seq int, {event}")
    df = spark.read.json(path, schema=f"events array<struct<{event}>>", multiLine=True, mode="PERMISSIVE")
    return df.select(F.posexplode("events").alias("seq", "e")).select("seq", "e.*")


def write_envelope(articles: DataFrame, path: str, kind: str, year: int, mode: str = "full") -> None:
    """Articles as lines of JSON below `path`/articles and one line about them below `path`/about."""
    articles.write.mode("overwrite").json(f"{path}/articles")
    n = articles.sparkSession.read.text(f"{path}/articles").count()
    about = articles.sparkSession.createDataFrame([(kind, year, mode, n)], "cache_type string, year int, mode string, count long")
    about.withColumn("updated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).coalesce(1).write.mode("overwrite").json(f"{path}/about")


def latest_file(spark: SparkSession, path: str, kind: str = "binaryFile") -> str | None:
    """The newest file of a folder by its modification time."""
    row = spark.read.format(kind).load(path).select("_metadata.file_path", "_metadata.file_modification_time").agg(F.max_by("file_path", "file_modification_time")).first()
    return row[0] if row else None


def read_export(spark: SparkSession, path: str, names: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """An export under internal names, with defaults for columns that are missing, dates and numbers typed where readable."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.withColumnsRenamed({v: k for k, v in names.items() if v in df.columns})
    for c, v in defaults.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(v))
    typed = {c: F.col(c).try_cast("double") for c in df.columns if c.endswith("_score")}
    if "published_at" in df.columns:
        typed["published_at"] = F.coalesce(F.try_to_timestamp("published_at"), F.try_to_date(F.substring("published_at", 1, 10)).cast("timestamp"))
    return df.withColumns(typed)


def write_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


POSTS = "member string, x_handle string, posted_at string, text string, url string, verified boolean, error string"


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, schema=POSTS, multiLine=True, escape='"')
    return df.withColumn("posted_at", F.try_to_timestamp("posted_at"))


def write_posts(df: DataFrame, path: str) -> None:
    df.orderBy(F.col("posted_at").desc_nulls_last(), F.col("member").asc_nulls_last()).write.mode("overwrite").csv(path, header=True, escape='"', encoding="UTF-8")


def union_sources(*sources: DataFrame) -> DataFrame:
    """Rows of all sources, those of earlier sources first in `seq` order; missing columns are null."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("_source_no", F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out.withColumn("seq", F.struct("_source_no", "seq")).drop("_source_no")
