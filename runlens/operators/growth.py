"""What changed between two runs, by area and by file, in examples and in seconds; and across a branch window.

Each comparison has a state, decided in a fixed order from a few scalars, before any row is shown.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.expressions import area
from ..plans.primitives import row_count, topk, two_point, with_population


def _flags(df: DataFrame) -> DataFrame:
    change = F.col("latest_count") - F.col("previous_count")
    return df.withColumns({"change": change, "moved": change != 0, "is_new": F.col("previous_count") == 0, "is_removed": F.col("latest_count") == 0})


#: Files of an area that are listed.
FILES = 30


def _count_growth(rows: DataFrame, key: str, latest: int, previous: int, limit: int) -> DataFrame:
    return ranked_counts(two_point(rows, key, previous, latest, {"count": F.lit(1)}), key, limit)


def ranked_counts(groups: DataFrame, key: str, limit: int) -> DataFrame:
    """Groups with previous_count and latest_count, those that moved most first."""
    counted = with_population(groups, {"group_count": row_count(), "previous_total": F.sum("previous_count"), "latest_total": F.sum("latest_count")})
    return topk(_flags(counted), [F.desc(F.abs("change")), F.asc_nulls_last(key)], limit)


def directory_growth(observations: DataFrame, latest: int, previous: int, limit: int = 10) -> DataFrame:
    """Areas whose number of rows moved most."""
    return _count_growth(observations.withColumn("directory", area(F.col("spec_file_path"))), "directory", latest, previous, limit)


def file_growth(observations: DataFrame, latest: int, previous: int, directory: str, limit: int = FILES) -> DataFrame:
    """The same for the files of one area."""
    return _count_growth(observations.filter(area(F.col("spec_file_path")) == directory), "spec_file_path", latest, previous, limit)


def _runtime_growth(rows: DataFrame, key: str, latest: int, previous: int, limit: int) -> DataFrame:
    groups = two_point(rows, key, previous, latest, {"seconds": F.col("duration_seconds"), "recorded_count": F.lit(1), "timed_count": F.col("duration_seconds")})
    totals = {f"{side}_{what}_total": F.sum(f"{side}_{what}_count") for what in ("recorded", "timed") for side in ("previous", "latest")}
    counted = with_population(groups, {"group_count": row_count()} | totals)
    both = F.col("previous_seconds").isNotNull() & F.col("latest_seconds").isNotNull()
    change = F.col("latest_seconds") - F.col("previous_seconds")
    new, gone = F.col("previous_recorded_count") == 0, F.col("latest_recorded_count") == 0
    counted = counted.withColumns({"change": change, "moved": both & (change != 0), "is_new": new, "is_removed": gone, "timing_gap": ~both & ~new & ~gone})
    counted = counted.withColumn("moved", F.coalesce("moved", F.lit(False)))
    return topk(counted, [F.desc_nulls_last(F.abs("change")), F.asc_nulls_last(key)], limit)


def directory_runtime_growth(observations: DataFrame, latest: int, previous: int, limit: int = 10) -> DataFrame:
    """Areas whose seconds moved most; a change needs seconds on both sides."""
    return _runtime_growth(observations.withColumn("directory", area(F.col("spec_file_path"))), "directory", latest, previous, limit)


def file_runtime_growth(observations: DataFrame, latest: int, previous: int, directory: str, limit: int = FILES) -> DataFrame:
    return _runtime_growth(observations.filter(area(F.col("spec_file_path")) == directory), "spec_file_path", latest, previous, limit)


def measured(run: Row | None) -> bool:
    return run is not None and (run["total_specs_count"] or 0) > 0


def run_state(latest: Row | None, previous: Row | None) -> str | None:
    """What two runs (rows with total_specs_count and shard_count) rule out before any row is read."""
    if latest is None:
        return "no_latest_run"
    if previous is None:
        return "no_previous_run"
    if not measured(latest):
        return "latest_unmeasured"
    if not measured(previous):
        return "previous_unmeasured"
    return None if latest["shard_count"] == previous["shard_count"] else "assembled_differently"


def _sides(what: str, previous: int, latest: int, earlier: str = "previous", later: str = "latest") -> str | None:
    if not previous and not latest:
        return f"neither_{what}"
    if not previous:
        return f"{earlier}_{what.replace('recorded', 'unrecorded').replace('timed', 'untimed')}"
    return None if latest else f"{later}_{what.replace('recorded', 'unrecorded').replace('timed', 'untimed')}"


@dataclass
class Growth:
    """A comparison's state, its rows where comparable, and what the state came from."""

    state: str
    rows: DataFrame | None = None
    context: dict = field(default_factory=dict)

    @property
    def comparable(self) -> bool:
        return self.state == "comparable"


def _kept(rows: DataFrame) -> tuple[DataFrame, Row | None]:
    """A capped list of rows, run once: as a frame of its own, and its first row."""
    found = rows.collect()
    return rows.sparkSession.createDataFrame(found, rows.schema), found[0] if found else None


def compare_directories(observations: DataFrame, latest: Row | None, previous: Row | None, limit: int = 10, runtime: bool = False) -> Growth:
    """Area growth between two run rows, in examples or in seconds, behind its state."""
    state = run_state(latest, previous)
    if state:
        return Growth(state)
    rows = (directory_runtime_growth if runtime else directory_growth)(observations, latest["id"], previous["id"], limit)
    rows, first = _kept(rows)
    at = lambda c: int(first[c] or 0) if first else 0
    if runtime:
        state = _sides("recorded", at("previous_recorded_total"), at("latest_recorded_total")) or _sides("timed", at("previous_timed_total"), at("latest_timed_total"))
    else:
        state = _sides("recorded", at("previous_total"), at("latest_total"))
    return Growth(state or "comparable", None if state else rows, {"group_count": at("group_count")})


def compare_files(observations: DataFrame, latest: Row | None, previous: Row | None, directory: str, limit: int = FILES, runtime: bool = False) -> Growth:
    """File growth inside one area; its state is that of the areas' comparison."""
    outer = compare_directories(observations, latest, previous, runtime=runtime)
    if not outer.comparable:
        return outer
    return Growth("comparable", (file_runtime_growth if runtime else file_growth)(observations, latest["id"], previous["id"], directory, limit))


def compare_window(observations: DataFrame, runs: Sequence[Row], limit: int = 10, grow: Callable[[DataFrame, int, int, int], DataFrame] = directory_growth) -> Growth:
    """Area growth over a window of run rows, oldest first: the newest run against the oldest measured one assembled like it.

    ``grow`` compares two runs over ``observations``, or over what it takes in their place.
    """
    anchor = runs[-1] if runs else None
    if not measured(anchor):
        return Growth("anchor_unmeasured")
    if len(runs) < 2:
        return Growth("no_earlier_run")
    unmeasured = mismatched = 0
    baseline = None
    for at, run in enumerate(runs[:-1]):
        if not measured(run):
            unmeasured += 1
        elif run["shard_count"] != anchor["shard_count"]:
            mismatched += 1
        else:
            baseline = at
            break
    context = {"skipped_unmeasured_count": unmeasured, "skipped_assembled_differently_count": mismatched}
    if baseline is None:
        return Growth("no_comparable_composition" if mismatched else "no_measured_baseline", None, context)
    context |= {"baseline_run_id": runs[baseline]["id"], "anchor_run_id": anchor["id"], "runs_back": len(runs) - 1 - baseline}
    rows = grow(observations, anchor["id"], runs[baseline]["id"], limit)
    rows, first = _kept(rows)
    at = lambda c: int(first[c] or 0) if first else 0
    state = _sides("recorded", at("previous_total"), at("latest_total"), "baseline", "anchor")
    return Growth(state or "comparable", None if state else rows, context)
