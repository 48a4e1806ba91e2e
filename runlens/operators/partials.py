"""Partial aggregates of runs, and the questions about a window of runs answered from them.

A run's examples are added up once: one row a run, one a (run, description, file, outcome), one a (run, identity, description,
file) and one a (run, area). All are plain sums, counts and maxima, so rows of any runs add up to the answer over
those runs, and a run that changes replaces its own rows only. Examples themselves are read by no question here.

Results have the columns and orders of the same questions over observations (``stability``, ``rollups``, ``growth``).
Nulls: an example without a description or identity counts in the run's row and has none in the others; a NULL outcome, file or
area is a value of its own; seconds that none of the examples report stay NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.expressions import area
from ..plans.primitives import row_count, topk, with_population
from . import growth, stability

#: What each table adds up by within a run.
WITHIN: dict[str, list[str]] = {
    "run_facts": [],
    "run_names": ["name", "spec_file_path", "outcome"],
    "run_identities": ["spec_identity_id", "name", "spec_file_path"],
    "run_areas": ["directory"],
}
#: Columns of observations that are added up.
READ = ["name", "spec_file_path", "outcome", "spec_identity_id", "duration_seconds"]


def measures(name: str) -> dict[str, Column]:
    recorded, timed = {"recorded_count": row_count()}, {"timed_count": F.count("duration_seconds"), "seconds": F.sum("duration_seconds")}
    if name == "run_facts":
        return recorded | {"named_count": F.count("name"), "resolved_count": F.count("spec_identity_id"), "reported_count": F.count("outcome")} | timed
    if name == "run_identities":
        return recorded | timed | {"slowest_seconds": F.max("duration_seconds")}
    return recorded if name == "run_names" else recorded | timed


def partial(observations: DataFrame, name: str, keys: Sequence[str] = ("test_run_id",)) -> DataFrame:
    """One of the tables of WITHIN, of all runs of ``observations``."""
    rows = observations
    if name == "run_names":
        rows = rows.filter(F.col("name").isNotNull())
    elif name == "run_identities":
        rows = rows.filter(F.col("spec_identity_id").isNotNull())
    elif name == "run_areas":
        rows = rows.withColumn("directory", area(F.col("spec_file_path")))
    return rows.groupBy(*keys, *WITHIN[name]).agg(*(c.alias(k) for k, c in measures(name).items()))


@dataclass
class Partials:
    """The four tables, with ``test_run_id``; of the runs of a window at least."""

    facts: DataFrame
    names: DataFrame
    identities: DataFrame
    areas: DataFrame

    @classmethod
    def of(cls, tables: Mapping[str, DataFrame]) -> Partials:
        return cls(*(tables[name] for name in WITHIN))


def window_outcome_reporting(of: Partials, run_ids: Sequence[int]) -> DataFrame:
    """How many of the runs have rows, and how many report an outcome."""
    return stability.in_window(of.facts, run_ids).agg(F.count_if(F.col("recorded_count") > 0).alias("runs_with_rows"), F.count_if(F.col("reported_count") > 0).alias("runs_reporting_outcomes"))


def unstable_candidates(of: Partials, run_ids: Sequence[int], limit: int = 200) -> DataFrame:
    """Failing descriptions, the least failing first, with the number of all of them."""
    failed = stability.in_window(of.names, run_ids).filter(F.col("outcome") == "failed")
    groups = failed.groupBy("name").agg(F.sum("recorded_count").alias("failures"))
    return topk(with_population(groups, {"candidate_count": row_count()}), [F.asc("failures"), F.asc("name")], limit)


def unstable_tests(of: Partials, run_ids: Sequence[int], limit: int = 200) -> DataFrame:
    """Descriptions that failed and did not only fail over the window, where two of its runs report outcomes."""
    candidates = unstable_candidates(of, run_ids, limit).select("name")
    rows = stability.in_window(of.names, run_ids).join(F.broadcast(candidates), "name", "left_semi")
    failed, n = F.col("outcome") == "failed", F.col("recorded_count")
    found = rows.groupBy("name").agg(
        F.sum(n).alias("recorded_count"),
        F.count_distinct("test_run_id").alias("run_count"),
        F.sum(F.when(F.col("outcome").isNotNull(), n).otherwise(0)).alias("reported_outcome_count"),
        F.sum(F.when(failed, n).otherwise(0)).alias("failed_count"),
        F.count_distinct(F.when(failed, F.col("test_run_id"))).alias("failed_run_count"),
        F.array_sort(F.collect_set("outcome")).alias("outcomes"),
        F.array_sort(F.collect_set("spec_file_path")).alias("file_paths"),
    )
    return stability.changed_outcomes(found, window_outcome_reporting(of, run_ids))


def unnamed_count(of: Partials, run_ids: Sequence[int]) -> DataFrame:
    return stability.in_window(of.facts, run_ids).agg(F.coalesce(F.sum(F.col("recorded_count") - F.col("named_count")), F.lit(0)).alias("unnamed_count"))


def runs_with_description(of: Partials, run_ids: Sequence[int], name: str) -> DataFrame:
    """The runs of the window that hold a description: a question about its rows need open no others."""
    return stability.in_window(of.names, run_ids).filter(F.col("name") == name).select("test_run_id").distinct()


def identity_presence(of: Partials, run_id: int) -> DataFrame:
    unresolved = F.col("recorded_count") - F.col("resolved_count")
    return stability.in_window(of.facts, [run_id]).agg(F.coalesce(F.sum("recorded_count"), F.lit(0)).alias("recorded_count"), F.coalesce(F.sum(unresolved), F.lit(0)).alias("unresolved_count"))


def slowest_identity_candidates(of: Partials, anchor: int, limit: int = 10) -> DataFrame:
    """Identities by their seconds in the anchor run."""
    groups = stability.in_window(of.identities, [anchor]).groupBy("spec_identity_id").agg(F.sum("seconds").alias("anchor_seconds"), F.sum("timed_count").alias("anchor_timed"))
    counted = with_population(groups, {"candidate_count": row_count(), "timed_count": F.sum("anchor_timed")})
    return topk(counted, [F.desc_nulls_last("anchor_seconds"), F.asc("spec_identity_id")], limit)


def slowest_tests(of: Partials, run_ids: Sequence[int], limit: int = 10) -> DataFrame:
    """The anchor's slowest identities (the window's last run is the anchor), weighed over the whole window."""
    candidates = slowest_identity_candidates(of, run_ids[-1], limit).select("spec_identity_id")
    rows = stability.in_window(of.identities, run_ids).join(F.broadcast(candidates), "spec_identity_id", "left_semi")
    found = rows.groupBy("spec_identity_id").agg(
        F.sum("seconds").alias("total_seconds"),
        F.sum("recorded_count").alias("recorded_count"),
        F.sum("timed_count").alias("timed_count"),
        F.count_distinct("test_run_id").alias("run_count"),
        F.max("slowest_seconds").alias("slowest_seconds"),
        F.array_sort(F.collect_set("name")).alias("names"),
        F.array_sort(F.collect_set("spec_file_path")).alias("file_paths"),
    )
    return stability.weighed(found)


def rank_slowest_tests(of: Partials, run_ids: Sequence[int], limit: int = 10) -> stability.SlowestTests:
    """The ranking behind its state: no_runs, unrecorded, unresolved or ranked."""
    return stability.ranking(run_ids, lambda anchor: identity_presence(of, anchor), lambda: slowest_tests(of, run_ids, limit))


def directory_growth(areas: DataFrame, latest: int, previous: int, limit: int = 10) -> DataFrame:
    """Areas whose number of rows moved most between two runs."""
    side = lambda run: F.coalesce(F.sum(F.when(F.col("test_run_id") == run, F.col("recorded_count"))), F.lit(0))
    groups = stability.in_window(areas, [latest, previous]).groupBy("directory").agg(side(previous).alias("previous_count"), side(latest).alias("latest_count"))
    return growth.ranked_counts(groups, "directory", limit)


def compare_window(of: Partials, runs: Sequence[Row], limit: int = 10) -> growth.Growth:
    """Area growth over a window of run rows, oldest first, behind its state."""
    return growth.compare_window(of.areas, runs, limit, directory_growth)
