from __future__ import annotations

import json
from datetime import datetime

from runlens.operators.report import Tables, repository_report, to_json
from runlens.sources import adapters as A

KEYS = {
    "repository", "api_key", "history_window", "branches_window", "directory_growth_window", "directory_run_growth_window", "directory_runtime_growth_window", "directory_run_file_growth_window", "directory_runtime_file_growth_window",
    "delivery_health", "credential_health", "run_anchor", "latest_run", "history", "branches", "unstable_tests", "unstable_tests_window", "unstable_test_runs",
    "directory_growth", "directory_run_growth", "directory_runtime_growth", "directory_run_file_growth", "directory_runtime_file_growth",
}


def test_report(spark, sf_dir):
    tables = Tables(A.runs(spark, sf_dir), A.shards(spark, sf_dir), A.observations(spark, sf_dir))
    now = datetime(2024, 2, 1)
    plain = repository_report(tables, 1, now, branch=7, commit_sha=" ")
    assert set(plain) == KEYS and plain["unstable_tests"] is None and plain["run_anchor"]["source"] == "latest" and len(plain["history"]) == 10
    assert plain["latest_run"]["spec_file_examples"] is None
    full = repository_report(tables, 1, now, branch="main", commit_sha="sha029", spec_directory="spec/d1", spec_file="spec/d1/f1_spec.rb", unstable_test="example 7", unannotated_examples="1")
    assert full["run_anchor"]["id"] == 29 and len(full["history"]) == 23 and full["latest_run"]["unannotated_directories"]
    assert full["directory_run_growth"]["state"] == "assembled_differently"  # run 28 has three shards
    assert json.loads(to_json(full))["latest_run"]["run"]["created_at"] == "2024-01-29T00:00:00Z"
    nobody = repository_report(tables, 2, now)
    assert nobody["latest_run"] is None and nobody["directory_run_growth"]["state"] == "no_latest_run"
    assert plain["repository"] is None and plain["api_key"] is None and plain["history_window"]["branch_scope"] == "all_branches" and plain["history_window"]["returned"] == 10
    assert full["history_window"] == {"order": "ingested_at_desc,ingest_sequence_desc", "tie_break_served": False, "branch_scope": "single_branch", "branch": "main", "limit": 30, "returned": 23}
    assert full["directory_run_growth_window"]["state"] == "assembled_differently" and not full["directory_run_growth_window"]["comparable"] and full["directory_run_growth_window"]["anchor_commit_sha"] == "sha029"
    assert full["directory_run_file_growth_window"]["path"] == "spec/d1" and full["directory_growth_window"]["grouped"] and not plain["directory_growth_window"]["grouped"]
    assert full["branches_window"]["returned"] == len(full["branches"]) and not full["branches_window"]["walk_cut"]
    assert nobody["directory_run_growth_window"]["anchor_commit_sha"] is None


def test_report_names_its_repository_and_key(spark, sf_dir):
    rows = [(1, "ci", datetime(2024, 1, 2), None), (2, "other", None, None)]
    keys = spark.createDataFrame(rows, "repository_id long, name string, last_used_at timestamp, rotated_at timestamp")
    own = spark.createDataFrame([(1, "owner/app", "app", datetime(2023, 1, 1))], "id long, full_name string, name string, registered_at timestamp")
    found = repository_report(Tables(A.runs(spark, sf_dir), A.shards(spark, sf_dir), A.observations(spark, sf_dir), keys=keys, repositories=own), 1, datetime(2024, 2, 1), key="ci")
    assert found["repository"]["full_name"] == "owner/app"
    assert found["api_key"] == {"name": "ci", "last_used_at": datetime(2024, 1, 2), "rotated_at": None, "acceptance_reported_by": "delivery_health", "rotation_reported_by": "credential_health"}
