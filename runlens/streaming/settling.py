"""Runs that have settled, as a stream: a run's shards are final once none has come for a while.

Shards arrive one by one, late, again, or never; how many a run has nobody says. Each arrival sets the run's timer to
SETTLING_MINUTES later, and the run is emitted when that passes without another one. A shard that comes after that re-opens
the run: it is emitted as ``reopened`` at once, for what was said of it no longer holds, and again as ``settled`` when it is
quiet once more. A delivery of a shard that is known takes its place and counts as an arrival.

State is kept by run: a row a shard, and when the last one came. It goes ``forget`` after the run was last emitted; what comes
later is a run of its own. Time is that of the deliveries (``received_at``), carried on by any delivery of any run; a
stream that is quiet altogether settles nothing, so ``clock`` rows (a received_at and no run) may be sent along.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.runs import SETTLING_MINUTES

SETTLED = """repository_id long, run_key string, status string, revision int, shard_count long, timed_shard_count long, machine_seconds double, duration_seconds double,
last_arrived_at timestamp, decomposable boolean, balanced_seconds double, excess_seconds double"""
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Settling(StatefulProcessor):
    def __init__(self, quiet: timedelta, forget: timedelta):
        self.quiet, self.forget = int(quiet.total_seconds() * 1000), int(forget.total_seconds() * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.shards = handle.getMapState("shards", "shard_key string", "seconds double, received long, seq string")
        self.run = handle.getValueState("run", "last long, timer long, settled boolean, revision int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, timer, settled, revision = self.run.get() if self.run.exists() else (0, 0, False, 0)
        reopened = settled
        for frame in rows:
            if key[1] is None:  # the clock
                return
            for r in frame.itertuples():
                received = int(r.received_at.timestamp() * 1000)
                seq = str(r.delivery_seq)
                held = self.shards.getValue((r.shard_key,)) if self.shards.containsKey((r.shard_key,)) else None
                if held is None or (held[1], held[2]) <= (received, seq):
                    self.shards.updateValue((r.shard_key,), (None if pd.isna(r.duration_seconds) else float(r.duration_seconds), received, seq))
                last = max(last, received)
        if timer:
            self.handle.deleteTimer(timer)
        timer = last + self.quiet
        self.handle.registerTimer(timer)
        self.run.update((last, timer, False, revision))
        if reopened:
            yield self._row(key, "reopened", revision, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if not self.run.exists():
            return
        last, timer, settled, revision = self.run.get()
        if expiredTimerInfo.getExpiryTimeInMs() != timer:
            return
        if settled:
            self.shards.clear()
            self.run.clear()
            return
        timer = last + self.quiet + self.forget
        self.handle.registerTimer(timer)
        self.run.update((last, timer, True, revision + 1))
        yield self._row(key, "settled", revision + 1, last)

    def _row(self, key, status: str, revision: int, last: int) -> pd.DataFrame:
        times = [value[0] for _, value in self.shards.iterator()]
        timed = [x for x in times if x is not None]
        whole = status == "settled" and len(times) > 1 and len(timed) == len(times)
        machine, longest = (sum(timed), max(timed)) if timed else (None, None)
        balanced = machine / len(times) if whole else None
        row = (key[0], key[1], status, revision, len(times), len(timed), machine, longest, pd.Timestamp(last, unit="ms"), whole, balanced, longest - balanced if whole else None)
        return pd.DataFrame([row], columns=[c.split()[0] for c in SETTLED.replace("\n", " ").split(", ")])

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers need; the session's own setting comes back after."""
    key, wanted = _PROVIDER
    was = spark.conf.get(key, None)
    spark.conf.set(key, wanted)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def settled_runs(shards: DataFrame, quiet: timedelta = timedelta(minutes=SETTLING_MINUTES), late: str = "1 minute", forget: timedelta = timedelta(days=7)) -> DataFrame:
    """The stream of SETTLED rows of a stream of shards (repository_id, run_key, shard_key, duration_seconds, received_at, delivery_seq).

    Deliveries up to ``late`` behind the newest one are taken. Start it inside ``rocks``.
    """
    rows = shards.select("repository_id", "run_key", "shard_key", F.col("duration_seconds").cast("double").alias("duration_seconds"), "received_at", F.col("delivery_seq").cast("string").alias("delivery_seq"))
    keyed = rows.withWatermark("received_at", late).groupBy("repository_id", "run_key")
    return keyed.transformWithStateInPandas(statefulProcessor=Settling(quiet, forget), outputStructType=SETTLED, outputMode="Update", timeMode="EventTime")
