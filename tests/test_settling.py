"""Settling as a stream, driven by the times of deliveries."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runlens.operators import runs
from runlens.streaming.settling import rocks, settled_runs

START = datetime(2024, 1, 1, 12)
COLUMNS = "repository_id long, run_key string, shard_key string, duration_seconds double, received_at timestamp, delivery_seq string"


@pytest.fixture
def settle(spark, tmp_path):
    """Feed batches of (run, shard, seconds, minute) one after the other, and read what came out after each."""
    source, out, n = tmp_path / "in", tmp_path / "out", [0]
    source.mkdir()

    def go(*shards):
        rows = [(1, f"={r}" if r else None, f"={s}", x, START + timedelta(minutes=m), f"{n[0]:04d}{k:02d}") for k, (r, s, x, m) in enumerate(shards)]
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(f"{source}")
        n[0] += 1
        with rocks(spark):
            stream = settled_runs(spark.readStream.schema(COLUMNS).parquet(str(source)))
            query = stream.writeStream.foreachBatch(lambda df, b: df.write.mode("append").parquet(str(out))).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination()
        found = spark.read.parquet(str(out)).orderBy("run_key", "last_arrived_at", "revision", "status").collect() if out.exists() else []
        return [(r["run_key"], r["status"], r["revision"], r["shard_count"], r["duration_seconds"]) for r in found]

    go.rows = lambda: spark.read.parquet(str(out))
    return go


def test_runs_settle_reopen_and_settle_again(spark, settle):
    assert settle(("a", 1, 10.0, 0), ("a", 2, 30.0, 1), ("b", 1, 5.0, 2)) == []
    assert settle(("a", 2, 20.0, 14)) == []  # a shard again: the timer of a goes on to minute 29, b settles at 17
    first = settle((None, 0, None, 25))
    assert first == [("=b", "settled", 1, 1, 5.0)]
    second = settle((None, 0, None, 40))
    assert [r for r in second if r[0] == "=a"] == [("=a", "settled", 1, 2, 20.0)]
    third = settle(("a", 3, None, 50))  # late: what was said of a no longer holds
    assert [r for r in third if r[0] == "=a"] == [("=a", "settled", 1, 2, 20.0), ("=a", "reopened", 1, 3, 20.0)]
    fourth = [r for r in settle((None, 0, None, 80)) if r[0] == "=a"]
    assert fourth == [("=a", "settled", 1, 2, 20.0), ("=a", "reopened", 1, 3, 20.0), ("=a", "settled", 2, 3, 20.0)]
    # the last word on each run is the batch decomposition's
    shards = [(1, 1, 1, 10.0, 0), (2, 1, 2, 20.0, 14), (3, 1, 3, None, 50), (4, 2, 1, 5.0, 2)]
    held = spark.createDataFrame([(i, run, 1, x, START + timedelta(minutes=m)) for i, run, _, x, m in shards], "id long, test_run_id long, total_specs_count int, duration_seconds double, created_at timestamp")
    held = held.withColumn("updated_at", F.col("created_at")).withColumn("annotated_specs_count", F.lit(0))
    table = spark.createDataFrame([(1, "=a", 20.0), (2, "=b", 5.0)], "id long, run_key string, duration_seconds double")
    want = {r["run_key"]: (r["decomposable"], r["balanced_seconds"]) for r in runs.wall_clock_decomposition(table, held, START + timedelta(minutes=80)).collect()}
    last = {}
    for r in settle.rows().orderBy("revision").filter("status = 'settled'").collect():
        last[r["run_key"]] = (r["decomposable"], r["balanced_seconds"])
    assert last == want
