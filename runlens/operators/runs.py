"""Questions about runs and shards: which run, what came before, trajectories, cohorts, branches, shard balance, deltas."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio, ratio_percent, seconds_per_test
from ..plans.primitives import at_or_before, latest_per_key, topk

SETTLING_MINUTES = 15
MATERIAL_SECONDS, MATERIAL_PERCENT = 1.0, 5.0


def _newest_first():
    return [F.desc("created_at"), F.desc("id")]


def _blank(value: str | None) -> bool:
    return value is None or not value.strip()


def latest_run(runs: DataFrame, branch: str | None = None, commit_sha: str | None = None) -> DataFrame:
    """The newest run, of a branch or for a commit where asked."""
    if branch is not None:
        runs = runs.filter(F.col("branch") == branch) if not _blank(branch) else runs.limit(0)
    if commit_sha is not None:
        runs = runs.filter(F.col("commit_sha") == commit_sha) if not _blank(commit_sha) else runs.limit(0)
    return topk(runs, _newest_first(), 1)


def latest_run_per_repository(runs: DataFrame) -> DataFrame:
    return latest_per_key(runs, ["repository_id"], ["created_at", "id"])


def previous_run_on_branch(runs: DataFrame) -> DataFrame:
    """Every run with the id of the newest run before it on its branch; a NULL or blank branch has none."""
    w = Window.partitionBy("repository_id", "branch").orderBy("created_at", "id")
    named = F.trim("branch") != ""
    return runs.withColumn("previous_run_id", F.when(named, F.lag("id").over(w)))


def shard_totals(shards: DataFrame) -> DataFrame:
    """By run: shard_count, timed_shard_count, machine_seconds (NULL of nothing) and last arrival."""
    return shards.groupBy("test_run_id").agg(
        F.count(F.lit(1)).alias("shard_count"),
        F.count("duration_seconds").alias("timed_shard_count"),
        F.sum("duration_seconds").alias("machine_seconds"),
        F.max("updated_at").alias("last_shard_arrived_at"),
    )


def with_shards(runs: DataFrame, shards: DataFrame) -> DataFrame:
    """Runs with their shard totals; a run without shards counts 0 and has no machine seconds."""
    totals = shard_totals(shards).withColumnRenamed("test_run_id", "id")
    out = runs.join(totals, "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("shard_count", "timed_shard_count")})


def recent_runs(runs: DataFrame, shards: DataFrame, branch: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first: 10 of all branches, 30 of one."""
    one = not _blank(branch)
    rows = runs.filter(F.col("branch") == branch) if one else runs
    newest = topk(rows, _newest_first(), limit or (30 if one else 10))
    return with_shards(newest, shards).orderBy(*_newest_first())


def suite_size_trajectory(runs: DataFrame, shards: DataFrame, anchor: Row | None, limit: int = 30) -> DataFrame:
    """The runs of the anchor's branch up to it, oldest first, with their shard counts."""
    if anchor is None or _blank(anchor["branch"]):
        return with_shards(runs.limit(0), shards)
    rows = runs.filter((F.col("repository_id") == anchor["repository_id"]) & (F.col("branch") == anchor["branch"]))
    rows = rows.filter(at_or_before(F.col("created_at"), F.col("id"), anchor["created_at"], anchor["id"]))
    return with_shards(topk(rows, _newest_first(), limit), shards).orderBy("created_at", "id")


def trajectory_cohort(trajectory: DataFrame) -> DataFrame:
    """Each run of a trajectory with its place in the chart and in the timing chart.

    ``size_state``: plotted (assembled like the modal cohort of measured runs), unmeasured, part_way (fewer shards) or
    other_composition. ``time_state``, of plotted runs: timed (as many timed shards as the modal cohort of clocked runs),
    untimed or timing_mismatch. The modal cohort is the largest, of equals the one seen last.
    """
    rows = trajectory.withColumn("position", F.struct("created_at", "id"))
    measured = F.coalesce(F.col("total_specs_count"), F.lit(0)) > 0

    def modal(df: DataFrame, key: str, name: str) -> DataFrame:
        cohorts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"))
        return cohorts.agg(F.max_by(key, F.struct("n", "last")).alias(name))

    rows = rows.join(F.broadcast(modal(rows.filter(measured), "shard_count", "cohort_shards")))
    alike = F.col("shard_count") == F.col("cohort_shards")
    part = (F.col("shard_count") > 0) & (F.col("shard_count") < F.col("cohort_shards"))
    size = F.when(~measured, "unmeasured").when(alike, "plotted").when(part, "part_way").otherwise("other_composition")
    rows = rows.withColumn("size_state", size)
    clocked = (F.col("size_state") == "plotted") & F.col("duration_seconds").isNotNull()
    rows = rows.join(F.broadcast(modal(rows.filter(clocked), "timed_shard_count", "cohort_timed")))
    time = F.when(F.col("size_state") != "plotted", None).when(F.col("duration_seconds").isNull(), "untimed")
    time = time.when(F.col("timed_shard_count") == F.col("cohort_timed"), "timed").otherwise("timing_mismatch")
    return rows.withColumn("time_state", time).drop("position").orderBy("created_at", "id")


def trajectory_summary(cohort: DataFrame) -> DataFrame:
    """Counts by state, least and most of what is plotted, and whether there is enough of it (two points)."""
    plotted, timed = F.col("size_state") == "plotted", F.col("time_state") == "timed"
    out = cohort.agg(
        F.count(F.lit(1)).alias("considered_count"),
        F.count_if(plotted).alias("plotted_count"),
        F.count_if(F.col("size_state") == "unmeasured").alias("unmeasured_count"),
        F.count_if(F.col("size_state") == "part_way").alias("part_way_count"),
        F.count_if(F.col("size_state") == "other_composition").alias("other_composition_count"),
        F.min(F.when(plotted, F.col("total_specs_count"))).alias("minimum"),
        F.max(F.when(plotted, F.col("total_specs_count"))).alias("maximum"),
        F.count_if(timed).alias("timed_count"),
        F.min(F.when(timed, F.col("duration_seconds"))).alias("runtime_minimum"),
        F.max(F.when(timed, F.col("duration_seconds"))).alias("runtime_maximum"),
    )
    return out.withColumns({"plottable": F.col("plotted_count") >= 2, "runtime_plottable": F.col("timed_count") >= 2, "flat": F.coalesce(F.col("minimum") == F.col("maximum"), F.lit(False))})


def branch_histories(runs: DataFrame, pinned: Sequence[str] = (), branches: int = 500, limit: int = 30) -> DataFrame:
    """The first branches by name, and the pinned ones: runs (counted up to the limit), whether there are more, last run."""
    named = runs.filter(F.col("branch").isNotNull())
    walked = topk(named.select("branch").distinct(), [F.asc("branch")], branches)
    if pinned:
        walked = walked.union(runs.sparkSession.createDataFrame([(p,) for p in pinned], "branch string")).distinct()
    tail = named.join(F.broadcast(walked), "branch", "left_semi").groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_run_at"))
    out = tail.select("branch", F.least("n", F.lit(limit)).alias("run_count"), (F.col("n") > limit).alias("capped"), "last_run_at")
    return out.orderBy(F.desc("run_count"), F.desc_nulls_last("last_run_at"), F.asc("branch"))


def annotated(runs: DataFrame) -> DataFrame:
    """Percentage (0.0 of nothing) and share (NULL of nothing) of annotated examples."""
    part, whole = F.col("annotated_specs_count"), F.col("total_specs_count")
    return runs.withColumns({"annotated_ratio": ratio_percent(part, whole), "annotated_fraction": ratio(part, whole)})


def wall_clock_decomposition(runs: DataFrame, shards: DataFrame, now: datetime) -> DataFrame:
    """How far a run's wall clock is from an even split over its shards, once all are timed and have settled."""
    rows = with_shards(runs, shards)
    whole = (F.col("shard_count") > 1) & (F.col("timed_shard_count") == F.col("shard_count"))
    settled = F.coalesce(F.col("last_shard_arrived_at") <= F.lit(now) - F.expr(f"INTERVAL {SETTLING_MINUTES} MINUTES"), F.lit(False))
    balanced = F.try_divide("machine_seconds", "shard_count")
    rows = rows.withColumns({"decomposable": whole & settled, "pending": whole & ~settled})
    rows = rows.withColumn("balanced_seconds", F.when(F.col("decomposable"), balanced))
    rows = rows.withColumn("excess_seconds", F.col("duration_seconds") - F.col("balanced_seconds"))
    percent = F.when(F.col("duration_seconds") > 0, F.round(F.col("excess_seconds") / F.col("duration_seconds") * 100, 1)).otherwise(0.0)
    rows = rows.withColumn("excess_percent", F.when(F.col("decomposable"), percent))
    material = (F.round("excess_seconds", 1) >= MATERIAL_SECONDS) & (F.col("excess_percent") >= MATERIAL_PERCENT)
    return rows.withColumn("excess_material", F.coalesce(material, F.lit(False)))


def shard_reports(shards: DataFrame) -> DataFrame:
    """Each shard's seconds, examples and seconds an example (NULL where either is missing), in both orders of a run."""
    rate = F.when(F.col("total_specs_count") > 0, F.col("duration_seconds") / F.col("total_specs_count"))
    by_time = Window.partitionBy("test_run_id").orderBy(F.desc_nulls_first("duration_seconds"), F.asc("id"))
    by_id = Window.partitionBy("test_run_id").orderBy("id")
    rows = shards.withColumn("seconds_per_spec", rate)
    rows = rows.withColumns({"duration_order": F.row_number().over(by_time), "id_order": F.row_number().over(by_id)})
    return rows.withColumn("seconds_per_spec_label", seconds_per_test(F.col("seconds_per_spec")))


def _spread(values) -> F.Column:
    mean = F.avg(values)
    return F.when(mean > 0, F.round((F.max(values) - F.min(values)) / mean * 100, 1))


def shard_distribution(shards: DataFrame) -> DataFrame:
    """By run: relative spreads of examples and of seconds an example (the latter only where every shard has one)."""
    rate = F.when(F.col("total_specs_count") > 0, F.col("duration_seconds") / F.col("total_specs_count"))
    rows = shards.withColumn("rate", rate).withColumn("specs", F.coalesce("total_specs_count", F.lit(0)))
    out = rows.groupBy("test_run_id").agg(
        F.count(F.lit(1)).alias("shard_count"),
        F.count_if(F.col("specs") == 0).alias("unsized_shard_count"),
        _spread(F.col("specs")).alias("spec_count_spread_percent"),
        F.when(F.count("rate") == F.count(F.lit(1)), _spread(F.col("rate"))).alias("seconds_per_spec_spread_percent"),
        F.when(F.count("rate") == F.count(F.lit(1)), F.min("rate")).alias("cheapest_seconds_per_spec"),
        F.when(F.count("rate") == F.count(F.lit(1)), F.max("rate")).alias("dearest_seconds_per_spec"),
    )
    material = lambda c: F.coalesce(F.col(c) >= MATERIAL_PERCENT, F.lit(False))
    return out.withColumns({"spec_count_spread_material": material("spec_count_spread_percent"), "seconds_per_spec_spread_material": material("seconds_per_spec_spread_percent")})


def run_deltas(runs: DataFrame, shards: DataFrame) -> DataFrame:
    """Each run against the one before it on its branch: size, wall clock and machine seconds, where comparable."""
    rows = with_shards(runs, shards)
    w = Window.partitionBy("repository_id", "branch").orderBy("created_at", "id")
    before = F.lag(F.struct("id", "total_specs_count", "duration_seconds", "machine_seconds", "shard_count", "timed_shard_count")).over(w)
    rows = rows.withColumn("previous", F.when(F.trim("branch") != "", before))
    was = lambda c: F.col(f"previous.{c}")
    alike = F.col("shard_count") == was("shard_count")
    timed_alike = alike & (F.col("timed_shard_count") == was("timed_shard_count"))
    sized = (F.col("total_specs_count") > 0) & (was("total_specs_count") > 0) & alike
    return rows.select(
        "id",
        was("id").alias("previous_run_id"),
        F.when(sized, F.col("total_specs_count") - was("total_specs_count")).alias("size_change"),
        F.when(timed_alike, F.col("duration_seconds") - was("duration_seconds")).alias("wall_clock_change"),
        F.when(timed_alike & (F.col("shard_count") > 1), F.col("machine_seconds") - was("machine_seconds")).alias("machine_seconds_change"),
    )


def run_anchor(runs: DataFrame, commit_sha: str | None = None) -> DataFrame:
    """The run a report is about: the newest for a commit if asked and found, else the newest; with how it was chosen."""
    latest = latest_run(runs)
    if _blank(commit_sha):
        return latest.withColumns({"source": F.lit("latest"), "resolved": F.lit(True)})
    asked = latest_run(runs, commit_sha=commit_sha).withColumns({"source": F.lit("commit_sha"), "resolved": F.lit(True)})
    fallback = latest.withColumns({"source": F.lit("latest"), "resolved": F.lit(False)})
    both = asked.withColumn("_order", F.lit(0)).unionByName(fallback.withColumn("_order", F.lit(1)))
    return topk(both, [F.asc("_order")], 1).drop("_order")
