"""The catalogue over the local test tables: every question as a query, with the SQL that checks it beside it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as X
from .operators import clusters, growth, identity, ingest, retention, rollups, runs, stability, tenancy
from .plans.primitives import upsert
from .plans.storage import write_table
from .sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The adapter's branch rule puts these runs on ``main``; the window is the last six of them, oldest first.
MAIN = [d for d in range(1, 31) if d % 15 != 7 and d % 6 != 0]
WINDOW = MAIN[-6:]
RUN, LATEST, PREVIOUS = 30, 29, 27
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
WINDOW_SQL = ", ".join(map(str, WINDOW))

CTE = """
WITH obs AS (
  SELECT CAST(event_id AS BIGINT) AS id, CAST(1 AS BIGINT) AS repository_id,
         CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS test_run_id,
         CASE WHEN event_id % 100 <> 0 THEN CAST(user_id AS BIGINT) END AS spec_identity_id,
         'e' || CAST(event_id AS VARCHAR) AS example_id,
         CASE WHEN user_id % 25 = 24 THEN 'root_spec.rb'
              ELSE 'spec/d' || CAST(user_id % 5 AS VARCHAR) || '/f' || CAST(user_id % 25 AS VARCHAR) || '_spec.rb' END AS spec_file_path,
         CAST(user_id % 40 + 1 AS INTEGER) AS line_number,
         CASE WHEN event_id % 100 <> 0 THEN 'example ' || CAST(user_id AS VARCHAR) END AS name,
         CASE WHEN event_id % 50 <> 0 THEN CAST(value AS DOUBLE) END AS duration_seconds,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'passed' WHEN 'view' THEN 'passed' END AS outcome,
         CASE WHEN event_type = 'purchase' THEN 'annotated' ELSE 'unannotated' END AS status,
         CASE WHEN event_id % 400 = 0 THEN ts END AS embed_failed_at, ts AS created_at, user_id
  FROM events
), areas AS (
  SELECT *, CASE WHEN contains(spec_file_path, '/') THEN regexp_replace(spec_file_path, '/[^/]*$', '') ELSE '.' END AS directory FROM obs
), first_obs AS (
  SELECT * FROM areas QUALIFY row_number() OVER (PARTITION BY test_run_id, coalesce(spec_identity_id, -id) ORDER BY id) = 1
), shard_base AS (
  SELECT test_run_id, id % (CASE WHEN test_run_id % 7 = 0 THEN 3 ELSE 4 END) AS k, duration_seconds, status, created_at FROM obs
), shards AS (
  SELECT test_run_id * 10 + k AS id, test_run_id, k,
         CASE WHEN NOT (k = 0 AND test_run_id % 5 = 0) THEN sum(duration_seconds) END AS duration_seconds,
         CAST(count(*) AS INTEGER) AS total_specs_count, CAST(count(*) FILTER (WHERE status = 'annotated') AS INTEGER) AS annotated_specs_count,
         max(created_at) AS updated_at
  FROM shard_base GROUP BY test_run_id, k
), runs AS (
  SELECT s.test_run_id AS id, CAST(1 AS BIGINT) AS repository_id,
         CASE WHEN s.test_run_id % 15 = 7 THEN NULL WHEN s.test_run_id % 6 = 0 THEN 'feature/a' ELSE 'main' END AS branch,
         'sha' || lpad(CAST(s.test_run_id AS VARCHAR), 3, '0') AS commit_sha,
         TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(s.test_run_id - 1 AS INTEGER) AS created_at,
         max(s.duration_seconds) AS duration_seconds, CAST(sum(s.total_specs_count) AS INTEGER) AS total_specs_count,
         CAST(sum(s.annotated_specs_count) AS INTEGER) AS annotated_specs_count,
         count(*) AS shard_count, count(s.duration_seconds) AS timed_shard_count, sum(s.duration_seconds) AS machine_seconds,
         max(s.updated_at) AS last_shard_arrived_at
  FROM shards s GROUP BY s.test_run_id
)
"""


def query(sql: str | None = None, base: bool = True):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (CTE if base else "") + sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order; compare them to six digits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def text_lists(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


# ------------------------------------------------------------------ one run


@query(f"""SELECT directory, round(sum(duration_seconds), 6) AS total_seconds, count(*) AS recorded_count, count(duration_seconds) AS timed_count,
count(DISTINCT name) AS distinct_name_count, count(name) AS named_count, count(*) OVER () AS group_count
FROM areas WHERE test_run_id = {RUN} GROUP BY directory ORDER BY sum(duration_seconds) DESC NULLS LAST, directory LIMIT 10""")
def directory_durations(spark, sf_dir):
    return rounded(rollups.directory_durations(A.observations(spark, sf_dir, RUN), RUN), "total_seconds")


@query(f"""SELECT spec_file_path, round(sum(duration_seconds), 6) AS total_seconds, count(*) AS recorded_count, count(duration_seconds) AS timed_count,
count(*) OVER () AS group_count FROM obs WHERE test_run_id = {RUN} GROUP BY spec_file_path ORDER BY sum(duration_seconds) DESC NULLS LAST, spec_file_path LIMIT 10""")
def file_durations(spark, sf_dir):
    return rounded(rollups.file_durations(A.observations(spark, sf_dir, RUN), RUN), "total_seconds")


LISTING = "id, spec_file_path, name, duration_seconds, outcome"
LISTING_COLUMNS = ["id", "spec_file_path", "name", "duration_seconds", "outcome", "population_recorded_count", "population_timed_count"]


@query(f"""SELECT {LISTING}, count(*) OVER () AS population_recorded_count, count(duration_seconds) OVER () AS population_timed_count
FROM obs WHERE test_run_id = {RUN} AND spec_file_path = 'spec/d1/f1_spec.rb' ORDER BY duration_seconds DESC NULLS LAST, id LIMIT 50""")
def examples_in_file(spark, sf_dir):
    return rollups.examples_in_file(A.observations(spark, sf_dir, RUN), RUN, "spec/d1/f1_spec.rb").select(*LISTING_COLUMNS)


@query(f"""SELECT {LISTING}, count(*) OVER () AS population_recorded_count, count(duration_seconds) OVER () AS population_timed_count
FROM obs WHERE test_run_id = {RUN} AND name = 'example 7' ORDER BY duration_seconds DESC NULLS LAST, id LIMIT 25""")
def examples_with_description(spark, sf_dir):
    return rollups.examples_with_description(A.observations(spark, sf_dir, RUN), RUN, "example 7").select(*LISTING_COLUMNS)


@query(f"""SELECT spec_file_path, round(sum(duration_seconds), 6) AS total_seconds, count(*) AS recorded_count, count(duration_seconds) AS timed_count,
count(*) OVER () AS group_count, CAST(sum(count(*)) OVER () AS BIGINT) AS all_recorded_count, CAST(sum(count(duration_seconds)) OVER () AS BIGINT) AS all_timed_count
FROM areas WHERE test_run_id = {RUN} AND directory = 'spec/d1' GROUP BY spec_file_path ORDER BY sum(duration_seconds) DESC NULLS LAST, spec_file_path LIMIT 25""")
def files_in_directory(spark, sf_dir):
    return rounded(rollups.files_in_directory(A.observations(spark, sf_dir, RUN), RUN, "spec/d1"), "total_seconds")


@query(f"SELECT {LISTING} FROM obs WHERE test_run_id = {RUN} AND duration_seconds IS NOT NULL ORDER BY duration_seconds DESC, id LIMIT 10")
def slowest_examples(spark, sf_dir):
    return rollups.slowest_examples(A.observations(spark, sf_dir, RUN), RUN).select(*LISTING_COLUMNS[:5])


@query(f"""SELECT *, reported_outcome_count - failed_count - pending_count AS other_count, recorded_count - reported_outcome_count AS unreported_count FROM (
SELECT count(*) AS recorded_count, count(duration_seconds) AS timed_count, count(outcome) AS reported_outcome_count,
count(*) FILTER (WHERE outcome = 'failed') AS failed_count, count(*) FILTER (WHERE outcome = 'pending') AS pending_count FROM obs WHERE test_run_id = {RUN})""")
def run_coverage(spark, sf_dir):
    return rollups.coverage(A.observations(spark, sf_dir, RUN), RUN)


@query(f"""SELECT name, round(sum(duration_seconds), 6) AS total_seconds, count(*) AS recorded_count, count(duration_seconds) AS timed_count,
array_to_string(list_sort(list(DISTINCT spec_file_path)), ',') AS file_paths, count(*) OVER () AS group_count,
CAST(sum(count(*)) OVER () AS BIGINT) AS all_recorded_count, CAST(sum(count(duration_seconds)) OVER () AS BIGINT) AS all_timed_count
FROM obs WHERE test_run_id = {RUN} AND name IS NOT NULL GROUP BY name HAVING count(*) > 1 ORDER BY sum(duration_seconds) DESC NULLS LAST, name LIMIT 10""")
def repeated_descriptions(spark, sf_dir):
    return text_lists(rounded(rollups.repeated_descriptions(A.observations(spark, sf_dir, RUN), RUN), "total_seconds"), "file_paths")


@query(f"SELECT count(*) AS recorded_count, count(*) FILTER (WHERE name IS NULL) AS unnamed_count FROM obs WHERE test_run_id = {RUN}")
def description_presence(spark, sf_dir):
    return rollups.description_presence(A.observations(spark, sf_dir, RUN), RUN)


@query(f"SELECT count(*) AS recorded_count, count(*) FILTER (WHERE spec_identity_id IS NULL) AS unresolved_count FROM obs WHERE test_run_id = {RUN}")
def identity_presence(spark, sf_dir):
    return rollups.identity_presence(A.observations(spark, sf_dir, RUN), RUN)


@query(f"""SELECT id, spec_file_path, line_number, count(*) OVER () AS unannotated_recorded_count FROM areas
WHERE test_run_id = {RUN} AND status = 'unannotated' AND directory = 'spec/d2' ORDER BY spec_file_path, line_number, id LIMIT 100""")
def unannotated_examples(spark, sf_dir):
    return rollups.unannotated_examples(A.observations(spark, sf_dir, RUN), RUN, directory="spec/d2").select("id", "spec_file_path", "line_number", "unannotated_recorded_count")


@query(f"""SELECT directory, count(*) FILTER (WHERE status = 'unannotated') AS unannotated_count, count(*) AS recorded_count, count(*) OVER () AS group_count
FROM areas WHERE test_run_id = {RUN} GROUP BY directory ORDER BY unannotated_count DESC, directory LIMIT 10""")
def unannotated_directories(spark, sf_dir):
    return rollups.unannotated_directories(A.observations(spark, sf_dir, RUN), RUN)


# ------------------------------------------------------------------ two runs


def _count_growth_sql(key: str, where: str, limit: int, latest: int = LATEST, previous: int = PREVIOUS) -> str:
    return f"""SELECT *, latest_count - previous_count AS change, latest_count <> previous_count AS moved, previous_count = 0 AS is_new, latest_count = 0 AS is_removed FROM (
SELECT {key}, count(*) FILTER (WHERE test_run_id = {previous}) AS previous_count, count(*) FILTER (WHERE test_run_id = {latest}) AS latest_count,
count(*) OVER () AS group_count, CAST(sum(count(*) FILTER (WHERE test_run_id = {previous})) OVER () AS BIGINT) AS previous_total,
CAST(sum(count(*) FILTER (WHERE test_run_id = {latest})) OVER () AS BIGINT) AS latest_total
FROM areas WHERE test_run_id IN ({latest}, {previous}) {where} GROUP BY {key}) ORDER BY abs(latest_count - previous_count) DESC, {key} LIMIT {limit}"""


def _runtime_growth_sql(key: str, where: str, limit: int) -> str:
    side = lambda f, s, n: f"{f} FILTER (WHERE test_run_id = {n}) AS {s}"
    parts = [side(f, f"{p}_{m}", n) for m, f in (("seconds", "sum(duration_seconds)"), ("recorded_count", "count(*)"), ("timed_count", "count(duration_seconds)")) for p, n in (("previous", PREVIOUS), ("latest", LATEST))]
    totals = ", ".join(f"CAST(sum({s}_{m}_count) OVER () AS BIGINT) AS {s}_{m}_total" for m in ("recorded", "timed") for s in ("previous", "latest"))
    both = "previous_seconds IS NOT NULL AND latest_seconds IS NOT NULL"
    return f"""SELECT {key}, round(previous_seconds, 6) AS previous_seconds, round(latest_seconds, 6) AS latest_seconds, previous_recorded_count, latest_recorded_count,
previous_timed_count, latest_timed_count, count(*) OVER () AS group_count, {totals}, round(latest_seconds - previous_seconds, 6) AS change,
{both} AND latest_seconds <> previous_seconds AS moved, previous_recorded_count = 0 AS is_new, latest_recorded_count = 0 AS is_removed,
NOT ({both}) AND previous_recorded_count <> 0 AND latest_recorded_count <> 0 AS timing_gap
FROM (SELECT {key}, {", ".join(parts)} FROM areas WHERE test_run_id IN ({LATEST}, {PREVIOUS}) {where} GROUP BY {key})
ORDER BY abs(latest_seconds - previous_seconds) DESC NULLS LAST, {key} LIMIT {limit}"""


@query(_count_growth_sql("directory", "", 10))
def directory_growth(spark, sf_dir):
    return growth.directory_growth(A.observations(spark, sf_dir, LATEST, PREVIOUS), LATEST, PREVIOUS)


@query(_count_growth_sql("spec_file_path", "AND directory = 'spec/d1'", 30))
def file_growth(spark, sf_dir):
    return growth.file_growth(A.observations(spark, sf_dir, LATEST, PREVIOUS), LATEST, PREVIOUS, "spec/d1")


@query(_runtime_growth_sql("directory", "", 10))
def directory_runtime_growth(spark, sf_dir):
    return rounded(growth.directory_runtime_growth(A.observations(spark, sf_dir, LATEST, PREVIOUS), LATEST, PREVIOUS), "previous_seconds", "latest_seconds", "change")


@query(_runtime_growth_sql("spec_file_path", "AND directory = 'spec/d1'", 30))
def file_runtime_growth(spark, sf_dir):
    return rounded(growth.file_runtime_growth(A.observations(spark, sf_dir, LATEST, PREVIOUS), LATEST, PREVIOUS, "spec/d1"), "previous_seconds", "latest_seconds", "change")


#: The oldest run of the window with as many shards (four, as 7 does not divide it) as the newest is the baseline.
BASELINE = next(d for d in WINDOW if (d % 7 == 0) == (WINDOW[-1] % 7 == 0))


@query(_count_growth_sql("directory", "", 10, WINDOW[-1], BASELINE))
def directory_window_growth(spark, sf_dir, limit=len(WINDOW)):
    window = runs.suite_size_trajectory(A.runs(spark, sf_dir), A.shards(spark, sf_dir), runs.latest_run(A.runs(spark, sf_dir), branch="main").first(), limit).collect()
    return growth.compare_window(A.observations(spark, sf_dir, *(r["id"] for r in window)), window).rows


# ------------------------------------------------------------------ a window of runs


@query(f"SELECT count(*) AS runs_with_rows, count(*) FILTER (WHERE reported > 0) AS runs_reporting_outcomes FROM (SELECT count(outcome) AS reported FROM obs WHERE test_run_id IN ({WINDOW_SQL}) GROUP BY test_run_id)")
def window_outcome_reporting(spark, sf_dir, window=WINDOW):
    return stability.window_outcome_reporting(A.observations(spark, sf_dir, *window), window)


@query(f"""SELECT *, recorded_count > run_count AS shared_description FROM (
SELECT name, count(*) AS recorded_count, count(DISTINCT test_run_id) AS run_count, count(outcome) AS reported_outcome_count,
count(*) FILTER (WHERE outcome = 'failed') AS failed_count, count(DISTINCT test_run_id) FILTER (WHERE outcome = 'failed') AS failed_run_count,
array_to_string(list_sort(list(DISTINCT outcome) FILTER (WHERE outcome IS NOT NULL)), ',') AS outcomes, array_to_string(list_sort(list(DISTINCT spec_file_path)), ',') AS file_paths
FROM first_obs WHERE test_run_id IN ({WINDOW_SQL}) AND name IN (SELECT name FROM first_obs WHERE test_run_id IN ({WINDOW_SQL}) AND outcome = 'failed' AND name IS NOT NULL GROUP BY name ORDER BY count(*), name LIMIT 200)
GROUP BY name) WHERE failed_count > 0 AND reported_outcome_count > failed_count""")
def unstable_tests(spark, sf_dir, window=WINDOW):
    return text_lists(stability.unstable_tests(A.first_observations(spark, sf_dir, *window), window), "outcomes", "file_paths")


@query(f"""SELECT test_run_id, id, outcome, list_position([{WINDOW_SQL}], test_run_id) AS window_position, count(*) OVER () AS population_recorded_count,
count(outcome) OVER () AS population_reported_outcome_count FROM obs WHERE test_run_id IN ({WINDOW_SQL}) AND name = 'example 7' ORDER BY window_position, id LIMIT 200""")
def unstable_test_runs(spark, sf_dir, window=WINDOW):
    rows = stability.unstable_test_runs(A.observations(spark, sf_dir, *window), window, "example 7")
    return rows.select("test_run_id", "id", "outcome", F.col("window_position").cast("int").alias("window_position"), "population_recorded_count", "population_reported_outcome_count")


@query(f"""SELECT *, names LIKE '%,%' AS renamed, file_paths LIKE '%,%' AS moved, recorded_count > run_count AS repeated_within_run FROM (
SELECT spec_identity_id, round(sum(duration_seconds), 6) AS total_seconds, count(*) AS recorded_count, count(duration_seconds) AS timed_count,
count(DISTINCT test_run_id) AS run_count, max(duration_seconds) AS slowest_seconds, array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE name IS NOT NULL)), ',') AS names,
array_to_string(list_sort(list(DISTINCT spec_file_path)), ',') AS file_paths
FROM obs WHERE test_run_id IN ({WINDOW_SQL}) AND spec_identity_id IN (SELECT spec_identity_id FROM obs WHERE test_run_id = {WINDOW[-1]} AND spec_identity_id IS NOT NULL
GROUP BY spec_identity_id ORDER BY sum(duration_seconds) DESC NULLS LAST, spec_identity_id LIMIT 10) GROUP BY spec_identity_id)""")
def slowest_tests_window(spark, sf_dir, window=WINDOW):
    return text_lists(rounded(stability.slowest_tests(A.observations(spark, sf_dir, *window), window), "total_seconds"), "names", "file_paths")


# The same questions over the branch's whole window: its newest runs, 30 at most. The queries above keep to WINDOW.

MAIN_WINDOW = "(SELECT id, created_at FROM runs WHERE branch = 'main' ORDER BY created_at DESC, id DESC LIMIT 30)"
MAIN_LATEST = f"(SELECT max_by(id, (created_at, id)) FROM {MAIN_WINDOW})"
MAIN_BASELINE = f"""(SELECT min_by(w.id, (w.created_at, w.id)) FROM {MAIN_WINDOW} w JOIN runs r ON r.id = w.id
WHERE r.id <> {MAIN_LATEST} AND r.total_specs_count > 0 AND r.shard_count = (SELECT shard_count FROM runs WHERE id = {MAIN_LATEST}))"""


def branch_window(spark, sf_dir) -> list[int]:
    """The runs of the whole window, oldest first."""
    newest = runs.recent_runs(A.runs(spark, sf_dir), A.shards(spark, sf_dir), "main").select("id").collect()
    return [r["id"] for r in reversed(newest)]


def _over_branch_window(name: str) -> str:
    """The SQL of a query over WINDOW, with the whole window in its place."""
    sql = ORACLES[name].replace(f"[{WINDOW_SQL}]", f"(SELECT list(id ORDER BY created_at, id) FROM {MAIN_WINDOW})")
    sql = sql.replace(f"IN ({WINDOW_SQL})", f"IN (SELECT id FROM {MAIN_WINDOW})")
    return sql.replace(f"test_run_id = {WINDOW[-1]} ", f"test_run_id = {MAIN_LATEST} ")


@query(_count_growth_sql("directory", "", 10, MAIN_LATEST, MAIN_BASELINE))
def directory_window_growth_branch_window(spark, sf_dir):
    return directory_window_growth(spark, sf_dir, 30)


@query(_over_branch_window("window_outcome_reporting"), base=False)
def window_outcome_reporting_branch_window(spark, sf_dir):
    return window_outcome_reporting(spark, sf_dir, branch_window(spark, sf_dir))


@query(_over_branch_window("unstable_tests"), base=False)
def unstable_tests_branch_window(spark, sf_dir):
    return unstable_tests(spark, sf_dir, branch_window(spark, sf_dir))


@query(_over_branch_window("unstable_test_runs"), base=False)
def unstable_test_runs_branch_window(spark, sf_dir):
    return unstable_test_runs(spark, sf_dir, branch_window(spark, sf_dir))


@query(_over_branch_window("slowest_tests_window"), base=False)
def slowest_tests_window_branch_window(spark, sf_dir):
    return slowest_tests_window(spark, sf_dir, branch_window(spark, sf_dir))


# ------------------------------------------------------------------ runs and shards


@query("SELECT id, branch, commit_sha, total_specs_count FROM runs QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) = 1")
def latest_run_per_repository(spark, sf_dir):
    return runs.latest_run_per_repository(A.runs(spark, sf_dir)).select("id", "branch", "commit_sha", "total_specs_count")


@query("SELECT id, branch, CASE WHEN branch IS NOT NULL THEN lag(id) OVER (PARTITION BY branch ORDER BY created_at, id) END AS previous_run_id FROM runs")
def previous_run(spark, sf_dir):
    return runs.previous_run_on_branch(A.runs(spark, sf_dir)).select("id", "branch", "previous_run_id")


@query("SELECT id, commit_sha, total_specs_count, shard_count FROM runs WHERE branch = 'main' ORDER BY created_at DESC, id DESC LIMIT 30")
def recent_runs(spark, sf_dir):
    return runs.recent_runs(A.runs(spark, sf_dir), A.shards(spark, sf_dir), "main").select("id", "commit_sha", "total_specs_count", "shard_count")


@query("SELECT id, commit_sha, branch, 'commit_sha' AS source, TRUE AS resolved FROM runs WHERE commit_sha = 'sha017'")
def run_anchor(spark, sf_dir):
    return runs.run_anchor(A.runs(spark, sf_dir), "sha017").select("id", "commit_sha", "branch", "source", "resolved")


def _main_anchor(spark, sf_dir):
    return runs.latest_run(A.runs(spark, sf_dir), branch="main").first()


@query("SELECT id, total_specs_count, shard_count, timed_shard_count FROM runs WHERE branch = 'main' ORDER BY created_at DESC, id DESC LIMIT 30")
def suite_trajectory(spark, sf_dir):
    return runs.suite_size_trajectory(A.runs(spark, sf_dir), A.shards(spark, sf_dir), _main_anchor(spark, sf_dir)).select("id", "total_specs_count", "shard_count", "timed_shard_count")


COHORT_SQL = """, points AS (SELECT * FROM runs WHERE branch = 'main' ORDER BY created_at DESC, id DESC LIMIT 30),
size_cohort AS (SELECT shard_count FROM points WHERE total_specs_count > 0 GROUP BY shard_count ORDER BY count(*) DESC, max(id) DESC LIMIT 1),
sized AS (SELECT p.*, CASE WHEN coalesce(total_specs_count, 0) = 0 THEN 'unmeasured' WHEN p.shard_count = c.shard_count THEN 'plotted'
  WHEN p.shard_count > 0 AND p.shard_count < c.shard_count THEN 'part_way' ELSE 'other_composition' END AS size_state FROM points p, size_cohort c),
time_cohort AS (SELECT timed_shard_count FROM sized WHERE size_state = 'plotted' AND duration_seconds IS NOT NULL GROUP BY timed_shard_count ORDER BY count(*) DESC, max(id) DESC LIMIT 1),
cohort AS (SELECT s.*, CASE WHEN size_state <> 'plotted' THEN NULL WHEN duration_seconds IS NULL THEN 'untimed' WHEN s.timed_shard_count = t.timed_shard_count THEN 'timed' ELSE 'timing_mismatch' END AS time_state FROM sized s, time_cohort t)
"""


@query(COHORT_SQL + "SELECT id, size_state, time_state FROM cohort")
def trajectory_cohort(spark, sf_dir):
    points = runs.suite_size_trajectory(A.runs(spark, sf_dir), A.shards(spark, sf_dir), _main_anchor(spark, sf_dir))
    return runs.trajectory_cohort(points).select("id", "size_state", "time_state")


@query(COHORT_SQL + """SELECT *, plotted_count >= 2 AS plottable, timed_count >= 2 AS runtime_plottable, minimum = maximum AS flat FROM (
SELECT count(*) AS considered_count, count(*) FILTER (WHERE size_state = 'plotted') AS plotted_count, count(*) FILTER (WHERE size_state = 'unmeasured') AS unmeasured_count,
count(*) FILTER (WHERE size_state = 'part_way') AS part_way_count, count(*) FILTER (WHERE size_state = 'other_composition') AS other_composition_count,
min(total_specs_count) FILTER (WHERE size_state = 'plotted') AS minimum, max(total_specs_count) FILTER (WHERE size_state = 'plotted') AS maximum,
count(*) FILTER (WHERE time_state = 'timed') AS timed_count, round(min(duration_seconds) FILTER (WHERE time_state = 'timed'), 6) AS runtime_minimum,
round(max(duration_seconds) FILTER (WHERE time_state = 'timed'), 6) AS runtime_maximum FROM cohort)""")
def trajectory_summary(spark, sf_dir):
    points = runs.suite_size_trajectory(A.runs(spark, sf_dir), A.shards(spark, sf_dir), _main_anchor(spark, sf_dir))
    return rounded(runs.trajectory_summary(runs.trajectory_cohort(points)), "runtime_minimum", "runtime_maximum")


@query("SELECT branch, CAST(least(count(*), 10) AS BIGINT) AS run_count, count(*) > 10 AS capped, max(created_at) AS last_run_at FROM runs WHERE branch IS NOT NULL GROUP BY branch")
def branch_histories(spark, sf_dir):
    rows = runs.branch_histories(A.runs(spark, sf_dir), pinned=["main"], limit=10)
    return rows.withColumn("run_count", F.col("run_count").cast("long"))


@query("SELECT id AS test_run_id, shard_count, timed_shard_count, round(machine_seconds, 6) AS machine_seconds, last_shard_arrived_at FROM runs")
def shard_totals(spark, sf_dir):
    return rounded(runs.shard_totals(A.shards(spark, sf_dir)), "machine_seconds")


@query("""SELECT *, coalesce(round(excess_seconds, 1) >= 1.0 AND excess_percent >= 5.0, FALSE) AS excess_material FROM (
SELECT id, whole AND settled AS decomposable, whole AND NOT settled AS pending, round(CASE WHEN whole AND settled THEN machine_seconds / shard_count END, 6) AS balanced_seconds,
round(CASE WHEN whole AND settled THEN duration_seconds - machine_seconds / shard_count END, 6) AS excess_seconds,
CASE WHEN whole AND settled THEN CASE WHEN duration_seconds > 0 THEN round((duration_seconds - machine_seconds / shard_count) / duration_seconds * 100, 1) ELSE 0.0 END END AS excess_percent
FROM (SELECT *, shard_count > 1 AND timed_shard_count = shard_count AS whole, last_shard_arrived_at <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 15 MINUTE AS settled FROM runs))""")
def wall_clock_decomposition(spark, sf_dir):
    rows = runs.wall_clock_decomposition(A.runs(spark, sf_dir), A.shards(spark, sf_dir), NOW)
    return rounded(rows.select("id", "decomposable", "pending", "balanced_seconds", "excess_seconds", "excess_percent", "excess_material"), "balanced_seconds", "excess_seconds")


@query("""SELECT test_run_id, count(*) AS shard_count, count(*) FILTER (WHERE total_specs_count = 0) AS unsized_shard_count,
round((max(total_specs_count) - min(total_specs_count)) / avg(total_specs_count) * 100, 1) AS spec_count_spread_percent,
round(CASE WHEN count(rate) = count(*) THEN (max(rate) - min(rate)) / avg(rate) * 100 END, 1) AS seconds_per_spec_spread_percent,
round(CASE WHEN count(rate) = count(*) THEN min(rate) END, 6) AS cheapest_seconds_per_spec, round(CASE WHEN count(rate) = count(*) THEN max(rate) END, 6) AS dearest_seconds_per_spec,
round((max(total_specs_count) - min(total_specs_count)) / avg(total_specs_count) * 100, 1) >= 5 AS spec_count_spread_material,
coalesce(round(CASE WHEN count(rate) = count(*) THEN (max(rate) - min(rate)) / avg(rate) * 100 END, 1) >= 5, FALSE) AS seconds_per_spec_spread_material
FROM (SELECT *, CASE WHEN total_specs_count > 0 THEN duration_seconds / total_specs_count END AS rate FROM shards) GROUP BY test_run_id""")
def shard_distribution(spark, sf_dir):
    return rounded(runs.shard_distribution(A.shards(spark, sf_dir)), "cheapest_seconds_per_spec", "dearest_seconds_per_spec")


@query("""SELECT id, test_run_id, round(CASE WHEN total_specs_count > 0 THEN duration_seconds / total_specs_count END, 6) AS seconds_per_spec,
CAST(row_number() OVER (PARTITION BY test_run_id ORDER BY duration_seconds DESC NULLS FIRST, id) AS INTEGER) AS duration_order,
CAST(row_number() OVER (PARTITION BY test_run_id ORDER BY id) AS INTEGER) AS id_order FROM shards""")
def shard_reports(spark, sf_dir):
    return rounded(runs.shard_reports(A.shards(spark, sf_dir)).select("id", "test_run_id", "seconds_per_spec", "duration_order", "id_order"), "seconds_per_spec")


@query("SELECT id, round(annotated_specs_count / total_specs_count * 100, 1) AS annotated_ratio, round(annotated_specs_count / total_specs_count, 3) AS annotated_fraction FROM runs")
def annotated_ratio(spark, sf_dir):
    return runs.annotated(A.runs(spark, sf_dir)).select("id", "annotated_ratio", "annotated_fraction")


@query("""SELECT id, prev AS previous_run_id, CASE WHEN shard_count = psc AND total_specs_count > 0 AND ptotal > 0 THEN total_specs_count - ptotal END AS size_change,
round(CASE WHEN shard_count = psc AND timed_shard_count = ptsc THEN duration_seconds - pdur END, 6) AS wall_clock_change,
round(CASE WHEN shard_count = psc AND timed_shard_count = ptsc AND shard_count > 1 THEN machine_seconds - pmach END, 6) AS machine_seconds_change
FROM (SELECT *, lag(id) OVER w AS prev, lag(shard_count) OVER w AS psc, lag(timed_shard_count) OVER w AS ptsc, lag(total_specs_count) OVER w AS ptotal, lag(duration_seconds) OVER w AS pdur,
lag(machine_seconds) OVER w AS pmach FROM runs WHERE branch IS NOT NULL WINDOW w AS (PARTITION BY branch ORDER BY created_at, id))
UNION ALL SELECT id, NULL, NULL, NULL, NULL FROM runs WHERE branch IS NULL""")
def run_deltas(spark, sf_dir):
    return rounded(runs.run_deltas(A.runs(spark, sf_dir), A.shards(spark, sf_dir)), "wall_clock_change", "machine_seconds_change")


# ------------------------------------------------------------------ retention, retries, sightings


@query("SELECT branch, count(*) AS populated_runs FROM runs WHERE id IN (SELECT test_run_id FROM obs) GROUP BY branch HAVING count(*) > 3")
def quiet_bucket(spark, sf_dir):
    return retention.quiet_buckets(A.runs(spark, sf_dir), A.observations(spark, sf_dir), 3).select("branch", "populated_runs")


@query("SELECT id, branch, CAST(row_number() OVER (PARTITION BY branch ORDER BY created_at DESC, id DESC) AS INTEGER) AS age_rank FROM runs QUALIFY age_rank <= 4")
def retained_runs(spark, sf_dir):
    return retention.retained_runs(A.runs(spark, sf_dir), 4).select("id", "branch", "age_rank")


@query("SELECT count(*) AS kept_rows, count(DISTINCT test_run_id) AS kept_runs FROM obs WHERE test_run_id IN (SELECT id FROM runs QUALIFY row_number() OVER (PARTITION BY branch ORDER BY created_at DESC, id DESC) <= 4)")
def pruned_observations(spark, sf_dir):
    return retention.prune_observations(A.observations(spark, sf_dir), A.runs(spark, sf_dir), 4).agg(F.count(F.lit(1)).alias("kept_rows"), F.count_distinct("test_run_id").alias("kept_runs"))


@query("""SELECT count(*) FILTER (WHERE embed_failed_at >= t - INTERVAL 7 DAY) AS embed_failed_retrying, count(*) FILTER (WHERE embed_failed_at < t - INTERVAL 7 DAY) AS embed_failed_gave_up,
count(*) FILTER (WHERE embed_failed_at IS NULL AND created_at >= t - INTERVAL 7 DAY AND created_at <= t - INTERVAL 1 HOUR) AS never_attempted_retrying,
count(*) FILTER (WHERE embed_failed_at IS NULL AND created_at < t - INTERVAL 7 DAY) AS never_attempted_gave_up
FROM obs, (SELECT TIMESTAMP '2024-01-31 00:00:00' AS t) WHERE spec_identity_id IS NULL""")
def embed_backlog_bounds(spark, sf_dir):
    return identity.unresolved_bounds(A.observations(spark, sf_dir), NOW)


@query("""SELECT id FROM (SELECT *, CASE WHEN embed_failed_at IS NOT NULL THEN 0 ELSE 1 END AS p FROM obs, (SELECT TIMESTAMP '2024-01-31 00:00:00' AS t) WHERE spec_identity_id IS NULL AND
(embed_failed_at >= t - INTERVAL 7 DAY OR (embed_failed_at IS NULL AND created_at >= t - INTERVAL 7 DAY AND created_at <= t - INTERVAL 1 HOUR)))
ORDER BY p, CASE WHEN p = 0 THEN embed_failed_at END, created_at DESC, id LIMIT 20""")
def retry_backlog(spark, sf_dir):
    return identity.backlog(A.observations(spark, sf_dir), NOW, 20).select("id")


@query("""SELECT spec_identity_id, test_run_id AS last_seen_test_run_id, spec_file_path AS file_path, line_number FROM obs WHERE spec_identity_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY spec_identity_id ORDER BY test_run_id DESC, id DESC) = 1""")
def identity_sightings(spark, sf_dir):
    return identity.sightings(A.observations(spark, sf_dir), A.runs(spark, sf_dir))


@query("SELECT sha256(text) AS text_digest, count(*) AS text_count, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1", base=False)
def exact_digest_groups(spark, sf_dir):
    return identity.exact_digest_groups(A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


# ------------------------------------------------------------------ vectors

PAIRS_SQL = """WITH v AS (SELECT vec_id AS id, label % 2 AS source, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT id, source, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
edges AS (SELECT a.id AS id, b.id AS neighbour_id, list_dot_product(a.e, b.e) AS similarity FROM u a JOIN u b ON a.source = b.source AND a.id <> b.id
WHERE 1 - list_dot_product(a.e, b.e) <= 1 - 0.40 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.e, b.e) DESC, b.id) <= 10)
"""


@query(PAIRS_SQL + "SELECT CAST(id AS BIGINT) AS id, CAST(neighbour_id AS BIGINT) AS neighbour_id, round(similarity, 6) AS similarity FROM edges", base=False)
def near_duplicate_pairs(spark, sf_dir):
    return rounded(clusters.near_duplicate_pairs(A.identities(spark, sf_dir), similarity=0.40), "similarity")


@query(
    PAIRS_SQL.replace("WITH v AS", "WITH RECURSIVE v AS", 1)
    + f""", linked AS (SELECT id, neighbour_id FROM edges WHERE neighbour_id IN (SELECT id FROM edges)),
both_ways AS (SELECT id, neighbour_id FROM linked UNION SELECT neighbour_id, id FROM linked),
reach AS (SELECT DISTINCT id, id AS other FROM edges UNION SELECT r.id, b.neighbour_id FROM reach r JOIN both_ways b ON b.id = r.other),
labels AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
near AS (SELECT id, count(*) AS n, max(similarity) AS strongest, min(similarity) AS weakest FROM edges GROUP BY id),
weights AS (SELECT CAST(event_id % 500 AS BIGINT) AS id, count(*) AS examples, sum(CASE WHEN event_id % 50 <> 0 THEN value END) AS seconds, count(CASE WHEN event_id % 50 <> 0 THEN value END) AS timed
  FROM events WHERE event_id % 100 <> 0 AND datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 = {RUN} GROUP BY 1),
grouped AS (SELECT component, min(CASE source WHEN 0 THEN 'name' ELSE 'intent' END) AS signal_source, count(*) AS member_count, CAST(coalesce(sum(examples), 0) AS BIGINT) AS example_count,
  sum(seconds) AS total_seconds, CAST(coalesce(sum(timed), 0) AS BIGINT) AS timed_count, max(strongest) AS strongest_similarity, min(weakest) AS weakest_similarity,
  count(*) FILTER (WHERE n >= 10) AS saturated_member_count, min('vector ' || CAST(l.id AS VARCHAR)) AS least_text, 'spec/vector_spec.rb' AS files
  FROM labels l JOIN v USING (id) JOIN near USING (id) LEFT JOIN weights USING (id) GROUP BY component)
SELECT CAST(component AS BIGINT) AS component, * EXCLUDE (component) REPLACE (round(total_seconds, 6) AS total_seconds, round(strongest_similarity, 6) AS strongest_similarity, round(weakest_similarity, 6) AS weakest_similarity),
count(*) OVER () AS cluster_count, CAST(sum(member_count) OVER () AS BIGINT) AS clustered_identity_count
FROM grouped ORDER BY total_seconds DESC NULLS LAST, example_count DESC, least_text LIMIT 10""",
    base=False,
)
def near_duplicate_clusters(spark, sf_dir):
    found = clusters.near_duplicate_clusters(A.identities(spark, sf_dir), A.vector_observations(spark, sf_dir), RUN, similarity=0.40)
    return text_lists(rounded(found, "total_seconds", "strongest_similarity", "weakest_similarity"), "files")


@query("SELECT count(*) AS identity_count, count(*) FILTER (WHERE label % 2 = 1) AS intent_count, count(*) FILTER (WHERE label % 2 = 0) AS name_count FROM embeddings", base=False)
def clusterable_population(spark, sf_dir):
    return clusters.clusterable_population(A.identities(spark, sf_dir))


def _steps_sql() -> str:
    """The ladder over the two runs; alike, for the local embedder, are here just the texts of one lexical form."""
    form = "lower(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g'), '^ | $', '', 'g'))"
    return f""", named AS (
SELECT id, test_run_id, CAST(regexp_extract(name, '([0-9]+)', 1) AS INTEGER) % 5 AS fifth, 'checks ' || sha256(name)[1:8] || ' ' || sha256(name)[9:16] AS name FROM obs
), known AS (
SELECT text, {form.format("text")} AS form, row_number() OVER (ORDER BY first_row) AS id FROM (SELECT name AS text, min(id) AS first_row FROM named WHERE test_run_id = {RUN - 1} AND name IS NOT NULL GROUP BY name)
), later AS (
SELECT id, CASE WHEN fifth = 0 THEN upper(name[1]) || lower(name[2:]) || '!' ELSE name END AS name, CASE WHEN fifth = 1 THEN 'Case ' || sha256(name) || ' runs as before' END AS intent
FROM named WHERE test_run_id = {RUN} AND name IS NOT NULL
), texts AS (
SELECT coalesce(intent, name) AS text, {form.format("coalesce(intent, name)")} AS form, min(id) AS first_row, arg_min(name, id) AS name, bool_or(intent IS NOT NULL) AS from_intent FROM later GROUP BY 1, 2
), tried AS (
SELECT t.*, e.id AS exact, n.id AS near, CASE WHEN from_intent THEN u.id END AS named FROM texts t LEFT JOIN known e ON e.text = t.text
LEFT JOIN (SELECT form, min(id) AS id FROM known GROUP BY form) n ON n.form = t.form LEFT JOIN known u ON u.text = t.name
), found AS (
SELECT text, form, first_row, coalesce(exact, near, named) AS identity FROM tried
), fresh AS (
SELECT form, (SELECT coalesce(max(id), 0) FROM known) + row_number() OVER (ORDER BY min(first_row)) AS identity FROM found WHERE identity IS NULL GROUP BY form
)
SELECT o.id, CASE WHEN l.id IS NULL THEN o.name ELSE l.name END AS name, CAST(coalesce(f.identity, fresh.identity) AS BIGINT) AS spec_identity_id
FROM named o LEFT JOIN later l ON l.id = o.id LEFT JOIN found f ON f.text = coalesce(l.intent, l.name) LEFT JOIN fresh ON f.identity IS NULL AND fresh.form = f.form WHERE o.test_run_id = {RUN}"""


@query(_steps_sql())
def resolved_identities(spark, sf_dir):
    """One run resolved against the identities that the run before it gave, by the local embedder.

    Names are made so that no two are alike. In the later run one in five is spelt otherwise and one in five has gained an intent.
    """
    from .functions.vectors import lexical_embedder

    rows = A.observations(spark, sf_dir, RUN - 1, RUN).withColumn("spec_identity_id", F.lit(None).cast("long"))
    fifth, hashed = F.regexp_extract("name", r"([0-9]+)", 1).try_cast("int") % 5, F.sha2("name", 256)
    rows = rows.withColumns({"fifth": fifth, "name": F.concat(F.lit("checks "), F.substring(hashed, 1, 8), F.lit(" "), F.substring(hashed, 9, 8))})
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("intent_entity", "intent_action", "intent_behavior")})
    empty = spark.createDataFrame([], "id long, repository_id long, text string, text_digest string, signal_source string, embedding array<float>, file_path string, line_number int, last_seen_test_run_id long, last_seen_at timestamp")
    before = identity.resolve(rows.filter(F.col("test_run_id") == RUN - 1), empty, lexical_embedder(), {"id": RUN - 1, "created_at": NOW - timedelta(days=1)})
    known = write_table(before.identities, "identities")
    fifth = F.col("fifth")
    later = rows.filter(F.col("test_run_id") == RUN).withColumns(
        {
            "name": F.when(fifth == 0, F.concat(F.upper(F.substring("name", 1, 1)), F.substring("name", 2, 100), F.lit("!"))).otherwise(F.col("name")),
            "intent_entity": F.when(fifth == 1, F.concat(F.lit("Case "), F.sha2("name", 256))),
            "intent_action": F.when(fifth == 1, "runs"),
            "intent_behavior": F.when(fifth == 1, "as before"),
        }
    )
    linked = identity.resolve(later, known, lexical_embedder(), {"id": RUN, "created_at": NOW}).rows
    return linked.select("id", "name", "spec_identity_id")


# ------------------------------------------------------------------ ingest


@query("""SELECT 'unparseable' AS kind, 1 AS n UNION ALL SELECT 'accepted', count(*) FROM orders WHERE o_orderkey % 10 <> 0 AND o_totalprice >= 0 UNION ALL
SELECT 'rejected', count(*) FROM orders WHERE o_orderkey % 10 = 0 OR o_totalprice < 0""", base=False)
def payload_validation(spark, sf_dir):
    """Orders as deliveries: those with a key ending in 0 lack their commit."""
    o = A.table(spark, sf_dir, "orders")
    spec = F.struct(F.lit("spec/a_spec.rb").alias("file_path"), F.lit(1).alias("line_number"), F.lit("n").alias("name"), F.lit("unannotated").alias("status"))
    sha = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey").cast("string")).otherwise(" ")
    body = F.to_json(F.struct(sha.alias("commit_sha"), F.col("o_totalprice").cast("double").alias("duration_seconds"), F.array(spec).alias("specs")))
    bad = spark.createDataFrame([("{",)], "value string")
    bodies, cores = o.select(body.alias("value")), spark.sparkContext.defaultParallelism
    if bodies.rdd.getNumPartitions() < cores:  # checking is all work and little data: a small file is dealt out
        bodies = bodies.repartition(cores)
    checked = ingest.validate(bodies.unionByName(bad))
    kind = F.when(F.col("body").isNull(), "unparseable").when(F.size("errors") == 0, "accepted").otherwise("rejected")
    return checked.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) = 1", base=False)
def dedup_first_wins(spark, sf_dir):
    """Lines as examples of an order: the first line of each part stays."""
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_partkey").cast("string").alias("example_id"), F.col("l_linenumber").alias("position"))
    return ingest.dedup_payload(rows, ("l_orderkey",)).select("l_orderkey", "l_partkey", "l_linenumber")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""", base=False)
def upsert_latest_wins(spark, sf_dir):
    """Two batches of events, merged by user and type: the later one wins."""
    from .plans.primitives import latest_per_key

    e = A.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    middle = e.agg(F.expr("floor((min(event_id) + max(event_id)) / 2)")).first()[0]
    halves = [latest_per_key(e.filter(cond), ["user_id", "event_type"], ["event_id"]) for cond in (F.col("event_id") <= middle, F.col("event_id") > middle)]
    return upsert(halves[0], halves[1], ["user_id", "event_type"])


@query("SELECT id, name, text_source FROM (SELECT id, name, CASE WHEN name IS NOT NULL THEN 'name' END AS text_source FROM obs) WHERE text_source IS NOT NULL")
def signal_texts(spark, sf_dir):
    rows = A.observations(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("intent_entity", "intent_action", "intent_behavior")})
    return identity.signals(rows).select("id", F.col("text").alias("name"), F.col("signal_source").alias("text_source"))


@query("""SELECT o_custkey AS repository_id, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3""", base=False)
def rejection_retention(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("occurred_at"))
    return ingest.keep_rejections(o, 3).select("repository_id", "id")


@query("""SELECT o_custkey AS repository_id, CAST(least(count(*) FILTER (WHERE o_orderstatus = 'F'), 3) AS BIGINT) AS shown_count, count(*) FILTER (WHERE o_orderstatus = 'F') > 3 AS bounded,
max(o_orderdate) FILTER (WHERE o_orderstatus <> 'F') IS NULL OR max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') > max(o_orderdate) FILTER (WHERE o_orderstatus <> 'F') AS refusing
FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > 0""", base=False)
def refusing_health(spark, sf_dir):
    """Failed orders as rejections, others as runs."""
    o = A.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "repository_id")
    refused = o.filter("o_orderstatus = 'F'").withColumnRenamed("o_orderdate", "occurred_at")
    fine = o.filter("o_orderstatus <> 'F'").withColumnRenamed("o_orderdate", "created_at")
    rows = tenancy.delivery_health(refused, fine, 3)
    return rows.select("repository_id", F.col("shown_count").cast("long").alias("shown_count"), "bounded", "refusing")


# ------------------------------------------------------------------ tenancy

TENANCY_SQL = """WITH owners AS (SELECT c_nationkey AS n, min(c_custkey) AS owner FROM customer GROUP BY 1) """


@query(TENANCY_SQL + """SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN owner = 7 THEN 'owner' ELSE 'member' END AS role FROM nation JOIN owners ON n = n_nationkey
WHERE owner = 7 OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 7)""", base=False)
def accessible_repositories(spark, sf_dir):
    return tenancy.accessible_repositories(A.repositories(spark, sf_dir), A.memberships(spark, sf_dir), 7).select("id", "role")


@query(TENANCY_SQL + """SELECT CAST(c_nationkey AS BIGINT) AS repository_id, count(*) AS key_count FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1""", base=False)
def permission_counts(spark, sf_dir):
    """Members by repository who may manage its keys."""
    rows = A.memberships(spark, sf_dir).filter(F.array_contains("permissions", "manage_keys"))
    return rows.groupBy("repository_id").agg(F.count(F.lit(1)).alias("key_count"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS user_id, lower(replace(c_name, '#', '-')) AS handle FROM customer WHERE c_nationkey = 3""", base=False)
def repository_members(spark, sf_dir):
    m = A.memberships(spark, sf_dir)
    return tenancy.members(m, m.select("user_id", "handle"), 3).select("user_id", "handle")


@query("""SELECT r_name AS owner, count(*) AS repository_count, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS administered_count FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1 HAVING count(*) FILTER (WHERE n_nationkey % 2 = 0) > 0""", base=False)
def organizations(spark, sf_dir):
    n, r = A.table(spark, sf_dir, "nation"), A.table(spark, sf_dir, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("owner"), F.lit(True).alias("is_organization"), (F.col("n_nationkey") % 2 == 0).alias("is_admin"))
    return tenancy.organizations(rows)


@query("""SELECT id, CASE WHEN duration_seconds IS NULL THEN 'not reported' WHEN duration_seconds >= 60 THEN 'long' WHEN duration_seconds > 0 AND duration_seconds < 0.01 THEN '< 0.01s'
ELSE printf('%.2fs', duration_seconds) END AS label FROM obs WHERE test_run_id = 30 AND abs(duration_seconds * 100 - floor(duration_seconds * 100) - 0.5) > 0.001 OR test_run_id = 30 AND duration_seconds IS NULL""")
def duration_labels(spark, sf_dir):
    """Labels of one run's rows, but those on the edge between two hundredths."""
    rows = A.observations(spark, sf_dir, RUN).filter(F.col("test_run_id") == RUN)
    d = F.col("duration_seconds")
    rows = rows.filter(d.isNull() | (F.abs(d * 100 - F.floor(d * 100) - 0.5) > 0.001))
    return rows.select("id", F.when(d >= 60, "long").otherwise(X.humanized_duration(d)).alias("label"))


@query()
def duration_labels_of_all_rows(spark, sf_dir):
    """The label of every row of one run; Python's own format checks it, as SQL has none for hours and minutes."""
    rows = A.observations(spark, sf_dir, RUN).filter(F.col("test_run_id") == RUN)
    return rows.select("id", X.humanized_duration(F.col("duration_seconds")).alias("label"))
