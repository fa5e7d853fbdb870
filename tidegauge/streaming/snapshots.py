"""Counter snapshots of live subjects: running counts per subject, the change since its snapshot before, expiry by timer.

Events are first added up per subject and step (native, combined inside the tasks), so a subject with a third of the traffic reaches its
state as one row a step.  Steps arrive closed by the watermark; the state of a subject is one row, and a timer removes it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timer_state(spark: SparkSession):
    """Streams started inside keep their state where timers work; other streams of the session keep their own store."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def activity(events: DataFrame, key: str, kind: str, kinds: dict[str, str], ts: str, step: str = "1 minute", lag: str = "3 minutes") -> DataFrame:
    """Closed steps with activity: ``key, at, at_ms`` (end of the step) and one count per name of ``kinds`` (name -> value of ``kind``).

    Events without a subject or time, or of other kinds, do not count; a step without any counted event is no row."""
    counted = events.where(F.col(key).isNotNull() & F.col(kind).isin(*kinds.values())).withWatermark(ts, lag)
    steps = counted.groupBy(key, F.window(ts, step)).agg(*[F.count_if(F.col(kind) == v).alias(n) for n, v in kinds.items()])
    # window_time carries the watermark on
    return steps.select(key, F.window_time("window").alias("at"), F.unix_millis("window.end").alias("at_ms"), *kinds)


class _Snapshots(StatefulProcessor):
    """State: running counts, time of the last snapshot, the timer set.  A gap beyond the retention starts anew whether or not the timer
    has fired yet, so results do not depend on how steps fall into batches."""

    def __init__(self, key: str, names: list[str], retention_ms: int, step_ms: int):
        self.key, self.names, self.retention_ms, self.step_ms = key, names, retention_ms, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counts", ", ".join(f"c{i} long" for i in range(len(self.names))) + ", at_ms long, timer_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # at most one row a step since the last batch
        steps = pd.concat(list(rows)).sort_values("at_ms")
        held = self.state.get() if self.state.exists() else None
        counts, last, timer = ([0] * len(self.names), None, None) if held is None else (list(held[:-2]), held[-2], held[-1])
        out = []
        for at, *found in steps[["at_ms", *self.names]].itertuples(index=False, name=None):
            if last is not None and at - last > self.retention_ms:
                counts, last = [0] * len(self.names), None
            counts = [have + int(new) for have, new in zip(counts, found)]
            minutes = 0.0 if last is None else (at - last) / 60000.0
            out.append((key[0], int(at), last, *counts, *[int(new) for new in found], minutes))
            last = int(at)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = last + self.retention_ms + self.step_ms
        self.handle.registerTimer(timer)
        self.state.update((*counts, last, timer))
        columns = [self.key, "at_ms", "previous_ms", *self.names, *[f"delta_{n}" for n in self.names], "delta_minutes"]
        yield pd.DataFrame(out, columns=columns).astype({"previous_ms": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def snapshots(steps: DataFrame, key: str, names: list[str], retention_minutes: int, step_minutes: int = 1) -> DataFrame:
    """One snapshot per subject and step with activity: ``snapshot_id, key, snapshot_at, previous_at``, running counts, ``delta_*`` since the snapshot
    before and ``delta_minutes`` between the two (0 for a first one).

    A subject without activity for more than the retention is forgotten and starts from nothing.  Start the stream inside ``timer_state``."""
    kind = steps.schema[key].dataType.simpleString()
    numbers = ", ".join(f"{n} long" for n in [*names, *[f"delta_{n}" for n in names]])
    rows = steps.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Snapshots(key, names, retention_minutes * 60000, step_minutes * 60000),
        outputStructType=f"{key} {kind}, at_ms long, previous_ms long, {numbers}, delta_minutes double", outputMode="Append", timeMode="EventTime")
    at = F.timestamp_millis("at_ms")
    # the id is the same in every run
    name = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")), 256)
    return rows.select(
        F.concat(F.lit("snapshot:"), F.substring(name, 1, 16)).alias("snapshot_id"), key, at.alias("snapshot_at"), F.timestamp_millis("previous_ms").alias("previous_at"),
        *names, *[f"delta_{n}" for n in names], F.round("delta_minutes", 1).alias("delta_minutes"))
