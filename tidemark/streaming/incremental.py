"""Incremental and streaming forms: per-entity lateness, upsert sinks, tumbling, sliding and session windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import upsert


def inside_window(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Rows not older than their entity's cutoff; undated rows and entities without a cutoff stay."""
    return rows.join(cutoffs, "member", "left").filter(F.col("cutoff").isNull() | F.col("d").isNull() | (F.col("d") >= F.col("cutoff"))).drop("cutoff")


def stream_of(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def tumbling(events: DataFrame, key: str, time: str = "ts", size: str = "1 day", late: str = "2 days", value: Column | None = None) -> DataFrame:
    """Counts and sums per key and window; late rows are taken until the watermark."""
    v = value if value is not None else F.col("score")
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total")).select(key, F.col("window.start").alias("start"), "n", "total")


def sliding(events: DataFrame, key: str, time: str = "ts", size: str = "7 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size, step), key).agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), "mean", "n")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "1 day", late: str = "2 days") -> DataFrame:
    """Runs of rows of a key without a longer gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def exactly_once(events: DataFrame, identity: str, time: str = "ts", late: str = "2 days") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([identity])


#: Parts that a sink's table is dealt into by its rows' identity; a batch rewrites those that it touches.
SINK_PARTS = 64


class UpsertSink:
    """A foreachBatch function that merges each batch into a table below `target`.

    The table's parts have versions.  A batch writes new versions of the parts that it touches, and then the state (which
    version each part has) as version batch_id + 1; a batch whose state is complete is skipped, so a retry changes
    nothing.  A batch must find its predecessor's state: only a sink without any state starts from an empty table, all else
    is an error, and nothing is lost in silence.  Versions that only older states name are removed.
    """

    def __init__(self, target: str, key: Column, date: str = "published_at", parts: int = SINK_PARTS):
        self.target, self.key, self.date, self.parts = target.rstrip("/"), key, date, parts

    def _fs(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def _state_path(self, version: int) -> str:
        return f"{self.target}/state/version={version}"

    def state(self, spark: SparkSession, version: int) -> dict[int, int] | None:
        """Version of each part, a bounded number; None if the state is not complete."""
        fs, p = self._fs(spark, self._state_path(version) + "/_SUCCESS")
        return {r["part"]: r["at"] for r in spark.read.schema("part int, at long").parquet(self._state_path(version)).collect()} if fs.exists(p) else None

    def _versions(self, spark: SparkSession) -> list[int]:
        fs, p = self._fs(spark, f"{self.target}/state")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))

    def _parts(self, spark: SparkSession, state: dict[int, int], schema) -> DataFrame | None:
        paths = [f"{self.target}/rows/version={at}/_part={part}" for part, at in state.items()]
        return spark.read.schema(schema).parquet(*paths) if paths else None

    def table(self, spark: SparkSession, schema) -> DataFrame:
        """The table as of the last complete batch."""
        for version in reversed(self._versions(spark)):
            state = self.state(spark, version)
            if state is not None:
                found = self._parts(spark, state, schema)
                return found if found is not None else spark.createDataFrame([], schema)
        return spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, new = batch.sparkSession, batch_id + 1
        if self.state(spark, new) is not None:
            return
        before = self.state(spark, batch_id)
        if before is None:
            if any(self.state(spark, v) is not None for v in self._versions(spark)):
                raise RuntimeError(f"the state before batch {batch_id} is missing below {self.target}")
            before = {}
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        touched = [r[0] for r in batch.select(part.alias("p")).distinct().collect()]  # `parts` rows at most
        old = self._parts(spark, {p: before[p] for p in touched if p in before}, batch.schema)
        merged = upsert(old if old is not None else batch.limit(0), batch, self.key, self.date)
        merged.withColumn("_part", part).write.mode("overwrite").partitionBy("_part").parquet(f"{self.target}/rows/version={new}")
        after = {**before, **{p: new for p in touched}}
        spark.createDataFrame(list(after.items()), "part int, at long").coalesce(1).write.mode("overwrite").parquet(self._state_path(new))
        self._clean(spark, batch_id, before, after)

    def _clean(self, spark: SparkSession, batch_id: int, before: dict[int, int], after: dict[int, int]) -> None:
        older = self.state(spark, batch_id - 1) or {}
        for p, at in older.items():
            if at not in (before.get(p), after.get(p)):
                fs, path = self._fs(spark, f"{self.target}/rows/version={at}/_part={p}")
                fs.delete(path, True)
        fs, path = self._fs(spark, self._state_path(batch_id - 1))
        fs.delete(path, True)


def upsert_sink(target: str, key: Column, date: str = "published_at", parts: int = SINK_PARTS) -> UpsertSink:
    return UpsertSink(target, key, date, parts)
