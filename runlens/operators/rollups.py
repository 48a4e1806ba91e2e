"""Questions about one run's rows: slowest examples, file and area rollups, repeated descriptions, annotation coverage.

NULL is "not reported": sums of nothing stay NULL and sort last, and every capped list carries its whole population.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import area
from ..plans.primitives import of_run, row_count, topk, with_population


def timed_count() -> Column:
    return F.count("duration_seconds")


def slowest_examples(observations: DataFrame, run_id: int, limit: int = 10) -> DataFrame:
    rows = of_run(observations, run_id).filter(F.col("duration_seconds").isNotNull())
    return topk(rows, [F.desc("duration_seconds"), F.asc("id")], limit)


def coverage(observations: DataFrame, run_id: int) -> DataFrame:
    """recorded, timed, reported_outcome, failed, pending, and what is left: other and unreported."""
    counts = of_run(observations, run_id).agg(
        row_count().alias("recorded_count"),
        timed_count().alias("timed_count"),
        F.count("outcome").alias("reported_outcome_count"),
        F.count_if(F.col("outcome") == "failed").alias("failed_count"),
        F.count_if(F.col("outcome") == "pending").alias("pending_count"),
    )
    other = F.col("reported_outcome_count") - F.col("failed_count") - F.col("pending_count")
    return counts.withColumn("other_count", other).withColumn("unreported_count", F.col("recorded_count") - F.col("reported_outcome_count"))


def _rollup(rows: DataFrame, key: str, limit: int, *more, totals: bool = False) -> DataFrame:
    """Seconds, rows and timed rows by key, heaviest first, with the number of groups (and their total rows)."""
    groups = rows.groupBy(key).agg(F.sum("duration_seconds").alias("total_seconds"), row_count().alias("recorded_count"), timed_count().alias("timed_count"), *more)
    population = {"group_count": row_count()}
    if totals:
        population |= {"all_recorded_count": F.sum("recorded_count"), "all_timed_count": F.sum("timed_count")}
    return topk(with_population(groups, population), [F.desc_nulls_last("total_seconds"), F.asc_nulls_last(key)], limit)


def file_durations(observations: DataFrame, run_id: int, limit: int = 10) -> DataFrame:
    return _rollup(of_run(observations, run_id), "spec_file_path", limit)


def directory_durations(observations: DataFrame, run_id: int, limit: int = 10) -> DataFrame:
    """Areas by seconds, with their distinct descriptions."""
    rows = of_run(observations, run_id).withColumn("directory", area(F.col("spec_file_path")))
    return _rollup(rows, "directory", limit, F.count_distinct("name").alias("distinct_name_count"), F.count("name").alias("named_count"))


def files_in_directory(observations: DataFrame, run_id: int, directory: str, limit: int = 25) -> DataFrame:
    """The files of one area (its own, not those of areas below it), with the area's totals."""
    rows = of_run(observations, run_id).filter(area(F.col("spec_file_path")) == directory)
    return _rollup(rows, "spec_file_path", limit, totals=True)


def repeated_descriptions(observations: DataFrame, run_id: int, limit: int = 10) -> DataFrame:
    """Descriptions, compared byte for byte, that more than one row carries."""
    rows = of_run(observations, run_id).filter(F.col("name").isNotNull())
    groups = rows.groupBy("name").agg(
        F.sum("duration_seconds").alias("total_seconds"),
        row_count().alias("recorded_count"),
        timed_count().alias("timed_count"),
        F.array_sort(F.collect_set("spec_file_path")).alias("file_paths"),
    )
    counted = with_population(groups.filter("recorded_count > 1"), {"group_count": row_count(), "all_recorded_count": F.sum("recorded_count"), "all_timed_count": F.sum("timed_count")})
    return topk(counted, [F.desc_nulls_last("total_seconds"), F.asc("name")], limit)


def description_presence(observations: DataFrame, run_id: int) -> DataFrame:
    return of_run(observations, run_id).agg(row_count().alias("recorded_count"), F.count_if(F.col("name").isNull()).alias("unnamed_count"))


def identity_presence(observations: DataFrame, run_id: int) -> DataFrame:
    return of_run(observations, run_id).agg(row_count().alias("recorded_count"), F.count_if(F.col("spec_identity_id").isNull()).alias("unresolved_count"))


def _listing(rows: DataFrame, limit: int) -> DataFrame:
    counted = with_population(rows, {"population_recorded_count": row_count(), "population_timed_count": timed_count()})
    return topk(counted, [F.desc_nulls_last("duration_seconds"), F.asc("id")], limit)


def examples_in_file(observations: DataFrame, run_id: int, spec_file_path: str, limit: int = 50) -> DataFrame:
    return _listing(of_run(observations, run_id).filter(F.col("spec_file_path") == spec_file_path), limit)


def examples_with_description(observations: DataFrame, run_id: int, name: str, limit: int = 25) -> DataFrame:
    return _listing(of_run(observations, run_id).filter(F.col("name") == name), limit)


def unannotated_examples(observations: DataFrame, run_id: int, spec_file: str | None = None, directory: str | None = None, limit: int = 100) -> DataFrame:
    """Unannotated rows in source order; both narrowings may apply."""
    rows = of_run(observations, run_id).filter(F.col("status") == "unannotated")
    if spec_file:
        rows = rows.filter(F.col("spec_file_path") == spec_file)
    if directory:
        rows = rows.filter(area(F.col("spec_file_path")) == directory)
    counted = with_population(rows, {"unannotated_recorded_count": row_count()})
    return topk(counted, [F.asc_nulls_last("spec_file_path"), F.asc_nulls_last("line_number"), F.asc("id")], limit)


def unannotated_directories(observations: DataFrame, run_id: int, limit: int = 10) -> DataFrame:
    """Areas by unannotated rows, areas without any included."""
    rows = of_run(observations, run_id).withColumn("directory", area(F.col("spec_file_path")))
    groups = rows.groupBy("directory").agg(F.count_if(F.col("status") == "unannotated").alias("unannotated_count"), row_count().alias("recorded_count"))
    return topk(with_population(groups, {"group_count": row_count()}), [F.desc("unannotated_count"), F.asc("directory")], limit)
