"""Running signals of a stream: each member's cutoff and newest evidence as keyed state.

Of each micro-batch a member takes the rows that are not older than its cutoff, the newest day before the batch less the
allowed lateness, and keeps of what it takes the few newest scored rows that a model score rests on.  So the state of a
member has a fixed size however many rows it has had, and what comes out after a batch is what the batch plan gives on all
rows taken so far.  State lives in the checkpoint: a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import signals

_STATE = "newest date, days array<date>, seqs array<long>, scores array<double>, taken long, late long"


def running_evidence(rows: DataFrame, eligible: Column, lateness: int = 30, n: int = 5, digits: int | None = 2, idle_minutes: int | None = None) -> DataFrame:
    """(member, model_score, model_stance, model_confidence, evidence_count, newest, taken, late) of each member that a batch has
    rows of, in update mode.

    Undated rows and those of new members are always taken, and undated evidence comes after dated.  Rows without a member
    are left out.  With idle_minutes, a member without rows for so long is forgotten and would begin anew.
    """
    kind = rows.schema["member"].dataType.simpleString()
    slim = rows.filter("member is not null").select("member", "seq", F.col("d").cast("date").alias("d"), F.when(eligible, F.col("score").cast("double")).alias("score"))

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, days, seqs, scores, taken, late = state.get if state.exists else (None, [], [], [], 0, 0)
        top = list(zip(days, seqs, scores))
        cutoff = None if newest is None else newest - pd.Timedelta(days=lateness)
        for b in batches:
            for seq, d, score in zip(b["seq"].tolist(), b["d"].tolist(), b["score"].tolist()):
                d = None if d is None or pd.isna(d) else d
                if d is not None and cutoff is not None and d < cutoff:
                    late += 1
                    continue
                taken += 1
                newest = d if newest is None else newest if d is None else max(newest, d)
                if score is not None and not pd.isna(score):
                    top.append((d, int(seq), float(score)))
            top = sorted(top, key=lambda x: (x[0] is None, -x[0].toordinal() if x[0] else 0, x[1]))[:n]
        state.update((newest, [x[0] for x in top], [x[1] for x in top], [x[2] for x in top], taken, late))
        if idle_minutes is not None:
            state.setTimeoutDuration(idle_minutes * 60_000)
        weights = [signals.RANK_TENTHS[k] if k < len(signals.RANK_TENTHS) else signals.REST_TENTHS for k in range(len(top))]
        raw = sum(x[2] * w for x, w in zip(top, weights)) / sum(weights) if top else None
        yield pd.DataFrame({"member": [key[0]], "raw": [raw], "n": [len(top)], "newest": [newest], "taken": [taken], "late": [late]})

    timeout = GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    out = slim.groupBy("member").applyInPandasWithState(step, f"member {kind}, raw double, n long, newest date, taken long, late long", _STATE, "update", timeout)
    return out.select("member", *signals.model_columns(F.col("raw"), F.col("n"), digits), "newest", "taken", "late")
