"""Running evidence against the batch plan after every micro-batch, with late rows and a restart."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import signals as S
from tidemark.streaming import incremental as I
from tidemark.streaming.running import running_evidence

SCHEMA = "seq long, member string, d date, score double, relevance string"
DAY = dt.date(2024, 3, 1)


def batch(rng, k, start):
    rows = []
    for j in range(60):
        member = rng.choice(["hot", "hot", "hot", "a", None, *(["b"] if k else []), *(["c"] if k == 2 else [])])
        back = rng.choice([0, 1, 2, 5, 9, 20, 40])
        rows.append((start + j, member, rng.choice([None, *[DAY + dt.timedelta(days=4 * k - back)] * 9]), rng.choice([None, -3.0, 0.5, 2.0, 6.0]), rng.choice(["HIGH", "HIGH", "LOW"])))
    return rows


def test_running_evidence_equals_the_batch_plan(spark, tmp_path):
    rng, taken, late, results = random.Random(4), [], {}, {}
    high = F.col("relevance") == "HIGH"

    def keep(df, number):
        for r in df.collect():
            results[r.member] = r

    for k in range(4):
        rows = batch(rng, k, 100 * k)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # each run is a restart from the checkpoint that takes the one new file
        q = running_evidence(I.stream_of(spark, str(tmp_path / "in"), SCHEMA), high, lateness=7).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
        cut = {}
        for r in taken:
            if r[1] and r[2]:
                cut[r[1]] = max(cut.get(r[1], r[2]), r[2])
        for r in rows:
            if r[1] and r[2] and r[1] in cut and r[2] < cut[r[1]] - dt.timedelta(days=7):
                late[r[1]] = late.get(r[1], 0) + 1
            elif r[1]:
                taken.append(r)
        want = {r.member: tuple(r)[1:] for r in S.evidence_score(spark.createDataFrame(taken, SCHEMA), high).collect()}
        got = {m: (r.model_score, r.model_stance, r.model_confidence, r.evidence_count) for m, r in results.items()}
        assert got == want
        assert all(r.late == late.get(m, 0) and r.taken == sum(x[1] == m for x in taken) and r.newest == max((x[2] for x in taken if x[1] == m and x[2]), default=None) for m, r in results.items())
    assert sum(late.values()) > 10 and len(results) == 4
