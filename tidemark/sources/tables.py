"""Written intermediate tables: what is read more than once, or by a loop, is computed once and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; on one machine a temporary one is set where it is unset, on a
    cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "plan", batch: int | None = None) -> DataFrame:
    """df as a Parquet table in that folder, read again; `batch`: bytes of rows that go to Python at once while it is written."""
    path, key = folder(df.sparkSession, name), "spark.sql.execution.arrow.maxBytesPerBatch"
    if batch is None:
        df.write.parquet(path)
    else:
        before = df.sparkSession.conf.get(key)
        df.sparkSession.conf.set(key, str(batch))
        try:
            df.write.parquet(path)
        finally:
            df.sparkSession.conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
