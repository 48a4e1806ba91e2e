"""Partial aggregates: the same answers as over observations, kept up by deliveries, redeliveries, resolution and retention."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_ingest import accepted_bodies, body, deliver, spec

from runlens.functions.vectors import lexical_embedder
from runlens.operators import growth, partials, rollups, stability
from runlens.sources import adapters as A
from runlens.streaming.ingest import add_deliveries, expire_runs, read_partials, refresh_partials, resolve_runs, rows_with_description, start_ingest
from runlens.streaming.store import Tables

RUN = ["repository_id", "run_key"]


def seen(df):
    order = sorted(df.columns)
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in order)) for r in df.select(*order).collect()]


def same(a, b):
    assert seen(a) == seen(b)


WINDOWS = [[29], [25, 26, 27, 28, 29], [2, 9, 16], [99], [3, 99]]


@pytest.fixture(scope="module")
def observed(spark, sf_dir):
    rows = A.observations(spark, sf_dir).persist()
    yield rows, partials.Partials.of({name: partials.partial(rows, name).persist() for name in partials.WITHIN})


@pytest.mark.parametrize("window", WINDOWS)
def test_questions_are_answered_as_over_observations(observed, window):
    rows, of = observed
    for name in ("window_outcome_reporting", "unstable_candidates", "unstable_tests", "unnamed_count", "slowest_tests"):
        same(getattr(partials, name)(of, window), getattr(stability, name)(rows, window))
    same(partials.slowest_identity_candidates(of, window[-1]), stability.slowest_identity_candidates(rows, window[-1]))
    same(partials.identity_presence(of, window[-1]), rollups.identity_presence(rows, window[-1]))
    same(partials.directory_growth(of.areas, window[-1], window[0]), growth.directory_growth(rows, window[-1], window[0]))


def test_states_are_those_over_observations(observed):
    rows, of = observed
    for window in ([], [99], [29]):
        a, b = partials.rank_slowest_tests(of, window), stability.rank_slowest_tests(rows, window)
        assert (a.state, a.context) == (b.state, b.context)
    run = lambda n, total=1, shards=4: Row(id=n, total_specs_count=total, shard_count=shards)
    for window in ([], [run(29)], [run(27, 0), run(28, 1, 3), run(29)], [run(26), run(28, 0), run(29)], [run(98), run(99)]):
        a, b = partials.compare_window(of, window), growth.compare_window(rows, window)
        assert (a.state, a.context) == (b.state, b.context)
        assert (a.rows is None) == (b.rows is None)
        if a.rows is not None:
            same(a.rows, b.rows)


def test_nulls_ties_and_nothing(spark):
    kind = "test_run_id long, name string, spec_file_path string, outcome string, spec_identity_id long, duration_seconds double, id long"
    data = [(1, None, None, None, None, None, 1), (1, "a", None, "failed", 7, None, 2), (1, "a", "root.rb", None, 7, 1.0, 3), (2, "a", "root.rb", "passed", 7, 1.0, 4), (2, "b", "root.rb", "failed", 8, 1.0, 5), (1, "b", "root.rb", "passed", 8, 2.0, 6)]
    for rows in (spark.createDataFrame(data, kind), spark.createDataFrame([], kind)):
        of = partials.Partials.of({name: partials.partial(rows, name) for name in partials.WITHIN})
        for name in ("window_outcome_reporting", "unstable_candidates", "unstable_tests", "unnamed_count", "slowest_tests"):
            same(getattr(partials, name)(of, [1, 2]), getattr(stability, name)(rows, [1, 2]))
        same(partials.directory_growth(of.areas, 2, 1), growth.directory_growth(rows, 2, 1))


def bodies_of(rng, n):
    """Deliveries of few runs and shards, so that shards come again and examples move between them."""
    one = lambda: spec(**({"id": str(rng.randrange(9))} if rng.random() < 0.8 else {}), name=f"n{rng.randrange(6)}", spec_file_path=f"spec/d{rng.randrange(3)}/a_spec.rb", duration=rng.choice([None, 0.5, 2]), outcome=rng.choice([None, "passed", "failed"]))
    return [body(ci_run_id=f"r{rng.randrange(5)}", shard_id=f"s{rng.randrange(3)}", specs=[one() for _ in range(rng.randrange(6))]) for _ in range(n)]


def kept_as_derived(tables):
    """What is kept equals what the examples add up to now, apart from totals of runs that have none left."""
    rows = tables.read("observations")
    for name in partials.WITHIN:
        held, fresh = tables.read(name), partials.partial(rows, name, RUN)
        if name == "run_facts":
            held = held.filter("recorded_count > 0")
        assert sorted(map(str, seen(held.select(*fresh.columns)) if held else [])) == sorted(map(str, seen(fresh))), name


def test_kept_partials_follow_deliveries_resolution_and_retention(spark, tmp_path):
    rng, tables = random.Random(11), Tables(spark, str(tmp_path / "out"), fanout=2)
    assert not refresh_partials(tables)
    for n in range(5):
        good, refused = accepted_bodies(spark, n, bodies_of(rng, 3))
        add_deliveries(tables, good, refused, n, str(n))
        if n == 1:
            resolve_runs(tables, good, lexical_embedder())
        if n == 2:  # merged before it was followed: the runs are found nevertheless
            tables.compact()
        if n == 3:
            assert expire_runs(tables, kept=2)
        assert refresh_partials(tables) and not refresh_partials(tables)
        kept_as_derived(tables)
        if n == 3:
            assert tables.read("run_facts").filter("recorded_count = 0 and seconds is null").count()
    assert tables.compact()
    kept_as_derived(tables)
    assert not refresh_partials(tables)


def test_a_refresh_writes_the_runs_that_changed_and_a_window_opens_its_own(spark, tmp_path, monkeypatch):
    from runlens.streaming import store

    monkeypatch.setattr(store, "FILE_BYTES", 4000)
    tables = Tables(spark, str(tmp_path / "out"), fanout=2)
    for n in range(2):
        specs = [spec(id=str(n), name="flips", outcome=("passed", "failed")[n])]
        add_deliveries(tables, *accepted_bodies(spark, n, [body(ci_run_id=f"r{k}", shard_id=f"s{n}", specs=specs if k < 40 else [spec(id=str(n), name="other")]) for k in range(60)]))
    refresh_partials(tables)
    tables.compact()
    add_deliveries(tables, *accepted_bodies(spark, 3, [body(ci_run_id="r7", shard_id="s0", specs=[])]))
    assert refresh_partials(tables)
    assert tables.current()["segments"]["run_facts"][-1]["rows"] == 1 and tables.current()["segments"]["run_names"][-1]["rows"] == 1
    ids = {r["run_key"]: r["id"] for r in tables.read("runs").collect()}
    window = [ids["=r7"], ids["=r9"], ids["=r50"]]
    of = read_partials(tables, window)
    (found,) = partials.unstable_tests(of, window).collect()
    assert (found["name"], found["run_count"], found["failed_run_count"], found["recorded_count"], found["reported_outcome_count"]) == ("flips", 2, 2, 3, 3)
    assert "observations" not in " ".join(of.names.inputFiles() + of.facts.inputFiles() + of.identities.inputFiles() + of.areas.inputFiles())
    listed = stability.unstable_test_runs(rows_with_description(tables, window, "flips"), window, "flips").collect()
    assert [(r["test_run_id"], r["outcome"]) for r in listed] == [(ids["=r7"], "failed"), (ids["=r9"], "passed"), (ids["=r9"], "failed")]
    opened = rows_with_description(tables, window, "flips").select("spec_file_path").inputFiles()
    assert 0 < sum("observations" in f for f in opened) < sum("observations" in f for f in tables.read("observations").inputFiles())
    assert rows_with_description(tables, window, "never") is None
    assert partials.window_outcome_reporting(read_partials(tables, [10**9]), [10**9]).first()["runs_with_rows"] == 0


def test_a_delivery_during_a_refresh_is_followed_by_the_next(spark, tmp_path, monkeypatch):
    """Another writer delivers, and another refresh runs, between a refresh's reading and its version: nothing is lost or counted twice."""
    tables = Tables(spark, str(tmp_path / "out"))
    add_deliveries(tables, *accepted_bodies(spark, 0, [body(ci_run_id="r1", specs=[spec(id="1"), spec(id="2")])]))
    other, publish, done = Tables(spark, tables.root), Tables._publish, []

    def late(self, made):
        if self is tables and not done:
            done.append(True)
            add_deliveries(other, *accepted_bodies(spark, 1, [body(ci_run_id="r1", shard_id="s2", specs=[spec(id="3")])]))
            assert refresh_partials(other)
        return publish(self, made)

    monkeypatch.setattr(Tables, "_publish", late)
    refresh_partials(tables)
    refresh_partials(tables)
    kept_as_derived(tables)
    assert tables.read("run_facts").select("recorded_count").collect() == [Row(recorded_count=3)]


def test_streams_keep_their_partials(spark, tmp_path):
    deliver(tmp_path / "in", "a.json", body(specs=[spec(id="1"), spec(id="2")]), at=datetime(2024, 1, 1).timestamp())
    start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    tables = Tables(spark, str(tmp_path / "out"))
    kept_as_derived(tables)
    assert tables.read("run_areas").select("directory", "recorded_count").filter(F.col("directory") == "spec").first()["recorded_count"] == 2
