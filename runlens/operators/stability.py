"""Questions about a window of runs: which outcomes are unstable, in which runs, and which tests are slowest."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.primitives import row_count, topk, with_population
from .rollups import identity_presence

COMPARABLE_RUNS = 2


def in_window(observations: DataFrame, run_ids: Sequence[int]) -> DataFrame:
    """Rows of the window's runs; a window is short (30 runs), so the list is pushed to the scan."""
    return observations.filter(F.col("test_run_id").isin(list(run_ids)))


def window_outcome_reporting(observations: DataFrame, run_ids: Sequence[int]) -> DataFrame:
    """How many of the runs have rows, and how many report an outcome."""
    runs = in_window(observations, run_ids).groupBy("test_run_id").agg(F.count("outcome").alias("reported"))
    return runs.agg(row_count().alias("runs_with_rows"), F.count_if(F.col("reported") > 0).alias("runs_reporting_outcomes"))


def unstable_candidates(observations: DataFrame, run_ids: Sequence[int], limit: int = 200) -> DataFrame:
    """Failing descriptions, the least failing first, with the number of all of them."""
    failed = in_window(observations, run_ids).filter((F.col("outcome") == "failed") & F.col("name").isNotNull())
    groups = failed.groupBy("name").agg(row_count().alias("failures"))
    return topk(with_population(groups, {"candidate_count": row_count()}), [F.asc("failures"), F.asc("name")], limit)


def outcome_composition(observations: DataFrame, run_ids: Sequence[int], candidates: DataFrame) -> DataFrame:
    """What each candidate (at most the limit of them, so broadcast) did over the window."""
    rows = in_window(observations, run_ids).join(F.broadcast(candidates.select("name")), "name", "left_semi")
    failed = F.col("outcome") == "failed"
    return rows.groupBy("name").agg(
        row_count().alias("recorded_count"),
        F.count_distinct("test_run_id").alias("run_count"),
        F.count("outcome").alias("reported_outcome_count"),
        F.count_if(failed).alias("failed_count"),
        F.count_distinct(F.when(failed, F.col("test_run_id"))).alias("failed_run_count"),
        F.array_sort(F.collect_set("outcome")).alias("outcomes"),
        F.array_sort(F.collect_set("spec_file_path")).alias("file_paths"),
    )


def unstable_tests(observations: DataFrame, run_ids: Sequence[int], limit: int = 200) -> DataFrame:
    """Candidates that failed and did not only fail, with ``shared_description`` where some run has several such rows.

    No rows unless two runs of the window report outcomes.
    """
    found = outcome_composition(observations, run_ids, unstable_candidates(observations, run_ids, limit))
    return changed_outcomes(found, window_outcome_reporting(observations, run_ids))


def changed_outcomes(found: DataFrame, reporting: DataFrame) -> DataFrame:
    """Of compositions those that failed and did not only fail, if enough runs report outcomes."""
    gate = reporting.select((F.col("runs_reporting_outcomes") >= COMPARABLE_RUNS).alias("comparable"))
    changed = found.filter((F.col("failed_count") > 0) & (F.col("reported_outcome_count") > F.col("failed_count")))
    changed = changed.join(F.broadcast(gate)).filter("comparable").drop("comparable")
    changed = changed.withColumn("shared_description", F.col("recorded_count") > F.col("run_count"))
    return changed.orderBy(F.desc("failed_run_count"), F.desc("run_count"), F.asc("name"))


def unnamed_count(observations: DataFrame, run_ids: Sequence[int]) -> DataFrame:
    return in_window(observations, run_ids).agg(F.count_if(F.col("name").isNull()).alias("unnamed_count"))


def unstable_test_runs(observations: DataFrame, run_ids: Sequence[int], name: str, limit: int = 200) -> DataFrame:
    """One description's rows in the order of the window given: the cap drops what comes last in it."""
    rows = in_window(observations, run_ids).filter(F.col("name") == name)
    counted = with_population(rows, {"population_recorded_count": row_count(), "population_reported_outcome_count": F.count("outcome")})
    place = F.array_position(F.array(*(F.lit(int(r)).cast("long") for r in run_ids)), F.col("test_run_id").cast("long"))
    return topk(counted.withColumn("window_position", place.cast("long")), [F.asc("window_position"), F.asc("id")], limit)


def slowest_identity_candidates(observations: DataFrame, anchor: int, limit: int = 10) -> DataFrame:
    """Identities by their seconds in the anchor run."""
    rows = observations.filter((F.col("test_run_id") == anchor) & F.col("spec_identity_id").isNotNull())
    groups = rows.groupBy("spec_identity_id").agg(F.sum("duration_seconds").alias("anchor_seconds"), F.count("duration_seconds").alias("anchor_timed"))
    counted = with_population(groups, {"candidate_count": row_count(), "timed_count": F.sum("anchor_timed")})
    return topk(counted, [F.desc_nulls_last("anchor_seconds"), F.asc("spec_identity_id")], limit)


def slowest_tests(observations: DataFrame, run_ids: Sequence[int], limit: int = 10) -> DataFrame:
    """The anchor's slowest identities (the window's last run is the anchor), weighed over the whole window."""
    candidates = slowest_identity_candidates(observations, run_ids[-1], limit).select("spec_identity_id")
    rows = in_window(observations, run_ids).join(F.broadcast(candidates), "spec_identity_id", "left_semi")
    found = rows.groupBy("spec_identity_id").agg(
        F.sum("duration_seconds").alias("total_seconds"),
        row_count().alias("recorded_count"),
        F.count("duration_seconds").alias("timed_count"),
        F.count_distinct("test_run_id").alias("run_count"),
        F.max("duration_seconds").alias("slowest_seconds"),
        F.array_sort(F.collect_set("name")).alias("names"),
        F.array_sort(F.collect_set("spec_file_path")).alias("file_paths"),
    )
    return weighed(found)


def weighed(found: DataFrame) -> DataFrame:
    """Identities over a window, the slowest first, with what changed about them."""
    found = found.withColumns({"renamed": F.size("names") > 1, "moved": F.size("file_paths") > 1, "repeated_within_run": F.col("recorded_count") > F.col("run_count")})
    return found.orderBy(F.desc_nulls_last("total_seconds"), F.desc("recorded_count"), F.asc("spec_identity_id"))


@dataclass
class SlowestTests:
    state: str
    rows: DataFrame | None = None
    context: dict = field(default_factory=dict)


def rank_slowest_tests(observations: DataFrame, run_ids: Sequence[int], limit: int = 10) -> SlowestTests:
    """The ranking behind its state: no_runs, unrecorded, unresolved or ranked."""
    return ranking(run_ids, lambda anchor: identity_presence(observations, anchor), lambda: slowest_tests(observations, run_ids, limit))


def ranking(run_ids: Sequence[int], presence_of: Callable[[int], DataFrame], ranked: Callable[[], DataFrame]) -> SlowestTests:
    """The state of a ranking, from what its anchor (the last run) has."""
    if not run_ids:
        return SlowestTests("no_runs")
    presence = presence_of(run_ids[-1]).first().asDict()
    if not presence["recorded_count"]:
        return SlowestTests("unrecorded", None, presence)
    if presence["recorded_count"] == presence["unresolved_count"]:
        return SlowestTests("unresolved", None, presence)
    return SlowestTests("ranked", ranked(), presence)
