"""The whole analytics document of one repository as JSON: which blocks are served, and each from its question.

Every block is a small, capped result; they are collected one by one, and drill-ins that were not asked for run nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import growth, rollups, runs, stability, tenancy


def _asked(value: object) -> str | None:
    """A parameter counts only as a non-blank string."""
    return value if isinstance(value, str) and value.strip() else None


def _rows(df: DataFrame | None) -> list[dict] | None:
    return None if df is None else [r.asDict(recursive=True) for r in df.collect()]


def _one(df: DataFrame) -> dict | None:
    row = df.first()
    return None if row is None else row.asDict(recursive=True)


@dataclass
class Tables:
    runs: DataFrame
    shards: DataFrame
    observations: DataFrame
    rejections: DataFrame | None = None
    keys: DataFrame | None = None
    repositories: DataFrame | None = None  # id, full_name, name, registered_at


#: The orders that lists are served in, and how a comparison's ends are chosen.
ORDERS = {"history": "ingested_at_desc,ingest_sequence_desc", "change": "abs_change_desc,path_asc", "runtime": "abs_change_desc_nulls_last,path_asc", "branches": "run_count_desc,last_run_at_desc,name_asc"}
ENDPOINTS, BEFORE = "two_endpoints", "previous_run_on_branch"


def _scope(branch: str | None) -> dict:
    return {"branch_scope": "single_branch" if branch else "all_branches", "branch": branch}


def _run_growth_window(block: dict, order: str, anchor: Row | None, previous: Row | None) -> dict:
    """How a comparison with the run before came about."""
    ends = {"anchor_commit_sha": anchor and anchor["commit_sha"], "baseline_commit_sha": previous and previous["commit_sha"]}
    return {"order": order, "tie_break_served": True, "basis": BEFORE, "branch_scope": "single_branch", "branch": anchor and anchor["branch"], "state": block["state"], "comparable": block["state"] == "comparable", **ends}


def _growth_block(found: growth.Growth) -> dict:
    return {"state": found.state, "rows": _rows(found.rows), **found.context}


def repository_report(
    tables: Tables,
    repository_id: int,
    now: datetime,
    branch: object = None,
    commit_sha: object = None,
    spec_directory: object = None,
    spec_file: object = None,
    repeated_description: object = None,
    unstable_test: object = None,
    unannotated_examples: object = None,
    pinned: Sequence[str] = (),
    key: object = None,
) -> dict:
    """The report's blocks, and beside each list the window that it was made from; those that do not apply are None.

    ``key``: the name of the key that asks, one of ``tables.keys`` (name, last_used_at, rotated_at).
    """
    branch, commit_sha, directory, file, description, unstable, unannotated = map(_asked, (branch, commit_sha, spec_directory, spec_file, repeated_description, unstable_test, unannotated_examples))
    own = tables.runs.filter(F.col("repository_id") == repository_id)
    shards = tables.shards
    rows = tables.observations.filter(F.col("repository_id") == repository_id)
    anchor = runs.with_shards(runs.run_anchor(own, commit_sha), shards).first()
    window = runs.recent_runs(own, shards, branch)
    history_limit = 30 if branch else 10
    out: dict = {
        "repository": None if tables.repositories is None else _one(tables.repositories.filter(F.col("id") == repository_id).select("id", "full_name", "name", "registered_at")),
        "api_key": _key_block(tables.keys, repository_id, _asked(key)),
        "delivery_health": None if tables.rejections is None else _one(tenancy.delivery_health(tables.rejections.filter(F.col("repository_id") == repository_id), own)),
        "credential_health": None if tables.keys is None else _rows(tenancy.credential_health(tables.keys.filter(F.col("repository_id") == repository_id))),
        "run_anchor": None if anchor is None else {k: anchor[k] for k in ("id", "source", "resolved", "commit_sha", "branch")},
        "latest_run": None if anchor is None else _run_block(rows, own, shards, anchor, now, directory, file, description, unannotated),
        "history": _rows(window),
        "branches": _rows(runs.branch_histories(own, pinned)),
    }
    out["history_window"] = {"order": ORDERS["history"], "tie_break_served": False, **_scope(branch), "limit": history_limit, "returned": len(out["history"])}
    out["branches_window"] = {"order": ORDERS["branches"], "tie_break_served": False, "run_count_limit": 30, "walk_limit": 500, "walk_cut": len(out["branches"]) >= 500, "returned": len(out["branches"])}
    history = list(reversed(window.collect())) if branch else []
    ids = [r["id"] for r in history]
    out["unstable_tests"] = _rows(stability.unstable_tests(rows, ids)) if ids else None
    out["unstable_tests_window"] = _one(stability.window_outcome_reporting(rows, ids)) if ids else None
    out["unstable_test_runs"] = _rows(stability.unstable_test_runs(rows, list(reversed(ids)), unstable)) if ids and unstable else None
    out["directory_growth"] = _growth_block(growth.compare_window(rows, history)) if branch else None
    previous = _previous(own, shards, anchor)
    compare = growth.compare_directories
    out["directory_run_growth"] = _growth_block(compare(rows, anchor, previous))
    out["directory_runtime_growth"] = _growth_block(compare(rows, anchor, previous, runtime=True))
    for name, runtime in (("directory_run_file_growth", False), ("directory_runtime_file_growth", True)):
        out[name] = _growth_block(growth.compare_files(rows, anchor, previous, directory, runtime=runtime)) if directory else None
        whole = out["directory_runtime_growth" if runtime else "directory_run_growth"]
        own_window = _run_growth_window(whole, ORDERS["runtime" if runtime else "change"], anchor, previous)
        out["directory_runtime_growth_window" if runtime else "directory_run_growth_window"] = own_window
        out[f"{name}_window"] = {"path": directory, **{k: own_window[k] for k in ("order", "tie_break_served", "basis", "state", "comparable")}, "limit": growth.FILES}
    out["directory_growth_window"] = {"order": ORDERS["change"], "tie_break_served": True, "basis": ENDPOINTS, **_scope(branch), "grouped": out["directory_growth"] is not None}
    return out


def _key_block(keys: DataFrame | None, repository_id: int, name: str | None) -> dict | None:
    """The asking key, and which blocks tell whether it is accepted and rotated."""
    if keys is None or name is None:
        return None
    found = _one(keys.filter((F.col("repository_id") == repository_id) & (F.col("name") == name)).select("name", "last_used_at", "rotated_at"))
    return found and found | {"acceptance_reported_by": "delivery_health", "rotation_reported_by": "credential_health"}


def _previous(own: DataFrame, shards: DataFrame, anchor: Row | None) -> Row | None:
    if anchor is None:
        return None
    found = runs.previous_run_on_branch(own).filter(F.col("id") == anchor["id"]).first()
    if found is None or found["previous_run_id"] is None:
        return None
    return runs.with_shards(own.filter(F.col("id") == found["previous_run_id"]), shards).first()


def _run_block(rows: DataFrame, own: DataFrame, shards: DataFrame, anchor: Row, now: datetime, directory, file, description, unannotated) -> dict:
    at = anchor["id"]
    one = runs.annotated(own.filter(F.col("id") == at))
    coverage = _one(rollups.coverage(rows, at))
    recorded = bool(coverage and coverage["recorded_count"])
    block: dict = {"run": _one(one), "coverage": coverage, "shards": None}
    if (anchor["shard_count"] or 0) > 1:
        mine = shards.filter(F.col("test_run_id") == at)
        block["shards"] = {
            "decomposition": _one(runs.wall_clock_decomposition(own.filter(F.col("id") == at), mine, now)),
            "distribution": _one(runs.shard_distribution(mine)),
            "reports": _rows(runs.shard_reports(mine).orderBy("id_order")),
        }
    block["spec_files"] = _rows(rollups.file_durations(rows, at)) if recorded else None
    block["spec_directories"] = _rows(rollups.directory_durations(rows, at)) if recorded else None
    block["slowest_examples"] = _rows(rollups.slowest_examples(rows, at)) if recorded else None
    block["repeated_descriptions"] = _rows(rollups.repeated_descriptions(rows, at)) if recorded else None
    block["description_presence"] = _one(rollups.description_presence(rows, at)) if recorded else None
    block["spec_directory_files"] = _rows(rollups.files_in_directory(rows, at, directory)) if directory else None
    block["spec_file_examples"] = _rows(rollups.examples_in_file(rows, at, file)) if file else None
    block["repeated_description_examples"] = _rows(rollups.examples_with_description(rows, at, description)) if description else None
    block["unannotated_examples"] = _rows(rollups.unannotated_examples(rows, at, file, directory)) if unannotated else None
    block["unannotated_directories"] = _rows(rollups.unannotated_directories(rows, at)) if unannotated else None
    return block


def to_json(report: dict) -> str:
    """Times in ISO 8601, keys in order."""
    return json.dumps(report, sort_keys=True, default=lambda v: v.strftime("%Y-%m-%dT%H:%M:%SZ") if isinstance(v, datetime) else str(v))
