from __future__ import annotations

import pytest
from oracle import assert_same

import __spark_entry__ as entry_points
from runlens.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_area_totals_are_the_runs(spark, sf_dir):
    areas = QUERIES["directory_durations"](spark, sf_dir).collect()
    coverage = QUERIES["run_coverage"](spark, sf_dir).first()
    assert sum(r["recorded_count"] for r in areas) == coverage["recorded_count"]
    assert sum(r["timed_count"] for r in areas) == coverage["timed_count"]


def test_no_cartesian_product_and_pushed_filters(spark, sf_dir):
    from runlens.operators import rollups

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnsRenamed({"user_id": "test_run_id", "event_type": "spec_file_path", "value": "duration_seconds"})
    plan = rollups.file_durations(events, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "EqualTo(user_id,3)" in plan and "props" not in plan.split("ReadSchema")[-1][:200]


RUN_QUERIES = ["directory_durations", "file_durations", "repeated_descriptions", "directory_growth", "directory_runtime_growth", "unstable_tests", "window_outcome_reporting", "slowest_tests_window", "run_coverage", "duration_labels"]


@pytest.mark.parametrize("name", RUN_QUERIES)
def test_questions_about_runs_read_their_days_only(spark, sf_dir, name):
    """Of the registered query: every scan of the events is told the range of days."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "events.parquet" in line]
    assert scans and all("GreaterThanOrEqual(ts," in line and "LessThan(ts," in line for line in scans), plan


def test_branch_window_is_the_whole_window(spark, sf_dir):
    from runlens import queries

    main = [r["id"] for r in spark.sql("SELECT id FROM range(1, 31) WHERE id % 15 <> 7 AND id % 6 <> 0 ORDER BY id").collect()]
    assert queries.branch_window(spark, sf_dir) == main and len(main) == 23
    assert QUERIES["window_outcome_reporting_branch_window"](spark, sf_dir).first()["runs_with_rows"] == 23
    rows = QUERIES["slowest_tests_window_branch_window"](spark, sf_dir).collect()
    assert max(r["run_count"] for r in rows) > len(queries.WINDOW)
