"""What op9's tasks hold at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import _store


def test_blobs_go_to_python_in_small_batches(spark):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with _store.small_batches(spark, 2 << 20):
        got = [r.n for r in spark.range(0, 64, 1, 1).withColumn("x", F.repeat(F.lit("x"), 500_000)).mapInArrow(rows, "n long").collect()]
    assert sum(got) == 64 and max(got) <= 6 and spark.conf.get(key) == before
