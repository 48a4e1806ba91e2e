"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores. Each query is run whole
(its result goes to Spark's noop sink) twice: ``queries`` has the second, warm time, ``cold`` the first.
"""

from __future__ import annotations

import json
import os
import time

from runlens import catalogue
from runlens.plans.storage import drop_tables
from runlens.session import session

HEADLINE = [
    "directory_durations",
    "file_durations",
    "repeated_descriptions",
    "directory_growth",
    "directory_runtime_growth",
    "unstable_tests",
    "slowest_tests_window",
    "suite_trajectory",
    "run_deltas",
    "shard_distribution",
    "identity_sightings",
    "exact_digest_groups",
    "near_duplicate_pairs",
    "payload_validation",
    "dedup_first_wins",
    "upsert_latest_wins",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = session("bench", master=f"local[{cpus}]", shuffle_partitions=cpus, spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    cold, warm = {}, {}
    for times in (cold, warm):
        for name in HEADLINE:
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    out = {"metric": "headline queries, warm wall time", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "shuffle_partitions": cpus}
    drop_tables(spark)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
