from __future__ import annotations

import pytest
from pyspark.sql import Row

from runlens.operators import growth, runs, stability

SCHEMA = "id long, test_run_id long, spec_file_path string, name string, duration_seconds double, outcome string, spec_identity_id long"


def observations(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def run(i, total=10, shards=2):
    return Row(id=i, total_specs_count=total, shard_count=shards)


ONE = [(1, "a/x.rb", "n", 1.0, "passed", 1)]
TWO = [(2, "a/x.rb", "n", 2.0, "passed", 1)]
UNTIMED = [(2, "a/x.rb", "n", None, "passed", 1)]


@pytest.mark.parametrize(
    ("latest", "previous", "rows", "state"),
    [
        (None, run(1), ONE, "no_latest_run"),
        (run(2), None, ONE, "no_previous_run"),
        (run(2, 0), run(1), ONE, "latest_unmeasured"),
        (run(2), run(1, None), ONE, "previous_unmeasured"),
        (run(2), run(1, shards=3), ONE, "assembled_differently"),
        (run(2), run(1), [], "neither_recorded"),
        (run(2), run(1), TWO, "previous_unrecorded"),
        (run(2), run(1), ONE, "latest_unrecorded"),
        (run(2), run(1), ONE + TWO, "comparable"),
    ],
)
def test_states(spark, latest, previous, rows, state):
    assert growth.compare_directories(observations(spark, rows), latest, previous).state == state


@pytest.mark.parametrize(
    ("rows", "state"),
    [
        ([(1, "a/x.rb", "n", None, None, 1)] + UNTIMED, "neither_timed"),
        ([(1, "a/x.rb", "n", None, None, 1)] + TWO, "previous_untimed"),
        (ONE + UNTIMED, "latest_untimed"),
        (ONE + TWO, "comparable"),
    ],
)
def test_runtime_states(spark, rows, state):
    assert growth.compare_directories(observations(spark, rows), run(2), run(1), runtime=True).state == state


def test_rows_tell_new_removed_unmoved_and_timing_gaps(spark):
    rows = [(1, "old/a.rb", "n", 1.0, None, 1), (1, "same/a.rb", "n", 1.0, None, 1), (1, "gap/a.rb", "n", None, None, 1)]
    rows += [(2, "new/a.rb", "n", 1.0, None, 1), (2, "same/a.rb", "n", 1.0, None, 1), (2, "gap/a.rb", "n", 2.0, None, 1)]
    df = observations(spark, rows)
    counts = {r["directory"]: r for r in growth.directory_growth(df, 2, 1).collect()}
    assert counts["new"]["is_new"] and counts["old"]["is_removed"] and not counts["same"]["moved"]
    seconds = {r["directory"]: r for r in growth.directory_runtime_growth(df, 2, 1).collect()}
    assert seconds["gap"]["timing_gap"] and seconds["gap"]["change"] is None and seconds["new"]["previous_seconds"] is None
    assert growth.compare_files(df, run(2), run(1), "same").rows.count() == 1


@pytest.mark.parametrize(
    ("window", "state"),
    [
        ([], "anchor_unmeasured"),
        ([run(1, 0)], "anchor_unmeasured"),
        ([run(1)], "no_earlier_run"),
        ([run(1, 0), run(2)], "no_measured_baseline"),
        ([run(1, shards=5), run(2)], "no_comparable_composition"),
        ([run(1), run(2)], "comparable"),
    ],
)
def test_window_states(spark, window, state):
    assert growth.compare_window(observations(spark, ONE + TWO), window).state == state


def test_window_states_of_rows(spark):
    w = [run(1), run(2)]
    assert growth.compare_window(observations(spark, []), w).state == "neither_recorded"
    assert growth.compare_window(observations(spark, TWO), w).state == "baseline_unrecorded"
    found = growth.compare_window(observations(spark, ONE), [run(9, 0), *w])
    assert found.state == "anchor_unrecorded" and found.context["skipped_unmeasured_count"] == 1 and found.context["runs_back"] == 1


def test_one_reporting_run_is_not_comparable(spark):
    rows = [(1, "a/x.rb", "n", 1.0, "failed", 1), (1, "a/x.rb", "n", 1.0, "passed", 1), (2, "a/x.rb", "n", 1.0, None, 1)]
    assert stability.unstable_tests(observations(spark, rows), [1, 2]).count() == 0
    rows += [(2, "a/x.rb", "n", 1.0, "passed", 1)]
    row = stability.unstable_tests(observations(spark, rows), [1, 2]).first()
    assert row["shared_description"] and row["failed_run_count"] == 1


def test_cap_discloses_its_population(spark):
    rows = [(1, "a/x.rb", f"n{i}", 1.0, "failed", 1) for i in range(5)]
    assert {r["candidate_count"] for r in stability.unstable_candidates(observations(spark, rows), [1], 4).collect()} == {5}


def test_window_order_decides_what_the_cap_drops(spark):
    rows = [(i, "a/x.rb", "n", 1.0, "passed", 1) for i in (1, 2, 3)]
    newest = stability.unstable_test_runs(observations(spark, rows), [3, 2, 1], "n", 2)
    oldest = stability.unstable_test_runs(observations(spark, rows), [1, 2, 3], "n", 2)
    assert [r["test_run_id"] for r in newest.collect()] == [3, 2] and [r["test_run_id"] for r in oldest.collect()] == [1, 2]


@pytest.mark.parametrize(("rows", "state"), [([], "unrecorded"), ([(1, "a", "n", 1.0, None, None)], "unresolved"), (ONE, "ranked")])
def test_slowest_tests_states(spark, rows, state):
    assert stability.rank_slowest_tests(observations(spark, rows), [1]).state == state
    assert stability.rank_slowest_tests(observations(spark, rows), []).state == "no_runs"


def test_blank_keys_find_no_run(spark, sf_dir):
    from runlens.sources import adapters

    df = adapters.runs(spark, sf_dir)
    assert runs.latest_run(df, branch=" ").count() == 0 and runs.latest_run(df, commit_sha="").count() == 0
    anchor = runs.run_anchor(df, "no such commit").first()
    assert anchor["source"] == "latest" and not anchor["resolved"]
