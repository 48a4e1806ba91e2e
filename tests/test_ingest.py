from __future__ import annotations

import gzip
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runlens.functions.vectors import lexical_embedder
from runlens.functions.json import with_json
from runlens.operators import ingest, nearest, retention
from runlens.plans.storage import write_table
from runlens.sources.bodies import CORRUPT, NOT_JSON, TOO_LARGE, inflate, inflates
from runlens.streaming.ingest import add_deliveries, expire_runs, read_deliveries, resolve_runs, run_view, start_ingest, upsert_batch, windowed_events
from runlens.streaming.store import Tables

INTENT = {"entity": "Invoice", "action": "finalize", "behavior": "marks the invoice as paid", "layer": "unit"}


def spec(**more):
    return {"file_path": "spec/a_spec.rb", "line_number": 3, "name": "does it", "status": "unannotated", "intent": None} | more


def body(**more):
    return {"commit_sha": "abc", "branch": "main", "ci_run_id": "r1", "shard_id": "s1", "duration_seconds": 2.5, "specs": [spec()]} | more


def errors(spark, value):
    text = value if isinstance(value, str) else json.dumps(value)
    return ingest.validate(spark.createDataFrame([(text,)], "value string")).first()["errors"]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (body(), []),
        ("{", [NOT_JSON]),
        ("[1]", ["the request body must be a JSON object"]),
        (body(commit_sha=" "), ["commit_sha is required and must be a non-empty string"]),
        (body(branch=5, shard_id=[1]), ["branch must be a string when present", "shard_id must be a string when present"]),
        (body(duration_seconds=-1), ["duration_seconds must be a non-negative number when present"]),
        (body(specs=None), ["specs is required and must be an array"]),
        (body(specs=[3]), ["specs[0]: must be a JSON object"]),
        (body(specs=[spec(line_number=1.5)]), ["specs[0] spec/a_spec.rb:1.5: line_number is required and must be a positive integer"]),
        (body(specs=[spec(), spec(file_path="")]), ["specs[1] :3: file_path is required and must be a non-empty string"]),
        (body(specs=[spec(status="x")]), ["specs[0] spec/a_spec.rb:3: status must be one of annotated, unannotated"]),
        (body(specs=[spec(status="annotated")]), ['specs[0] spec/a_spec.rb:3: intent is required when status is "annotated"']),
        (body(specs=[spec(intent=INTENT)]), ['specs[0] spec/a_spec.rb:3: intent must be null when status is "unannotated"']),
        (body(specs=[spec(status="annotated", intent=INTENT, name=None)]), []),
        (body(specs=[spec(name=None)]), ["specs[0] spec/a_spec.rb:3: name is required when the spec carries no intent"]),
        (body(specs=[spec(name=" ")]), ["specs[0] spec/a_spec.rb:3: name must be a non-empty string when present"]),
        (body(specs=[spec(duration="1")]), ["specs[0] spec/a_spec.rb:3: duration must be a non-negative number when present"]),
    ],
)
def test_validation(spark, value, expected):
    assert errors(spark, value) == expected


@pytest.mark.parametrize(
    ("change", "word"),
    [({"entity": "I"}, "/entity"), ({"behavior": "works"}, "/behavior"), ({"layer": "acceptance"}, "/layer"), ({"severity": "high"}, "/severity")],
)
def test_intent_contract(spark, change, word):
    found = errors(spark, body(specs=[spec(status="annotated", intent=INTENT | change)]))
    assert len(found) == 1 and word in found[0]


def test_intent_reports_everything(spark):
    found = errors(spark, body(specs=[spec(status="annotated", intent={})]))
    assert all(k in found[0] for k in ("entity", "action", "behavior", "layer"))
    assert len(errors(spark, body(specs=[spec(status="annotated", intent=INTENT | {"entity": "I", "behavior": "works"})]))) == 2
    assert errors(spark, body(specs=[spec(status="annotated", intent="x")]))[0].endswith("must be a JSON object")


ODD = ["x", "", " ", 3, 0, -1, 1.5, 3.0, 1e300, True, None, [], ["x"], {}, {"a": 1}, "annotated", "3", INTENT, INTENT | {"preconditions": None}, INTENT | {"preconditions": []}, INTENT | {"severity": 1}, INTENT | {"layer": 3}, INTENT | {"action": 5}]


def test_one_reading_finds_no_errors_where_the_checks_find_none(spark, monkeypatch):
    """Every odd value at every place: the errors are those of the checks field by field, and deliveries without any pass by the short way."""
    values = [body(**{k: v}) for k in ("commit_sha", "branch", "ci_run_id", "shard_id", "duration_seconds", "specs", "_json") for v in ODD]
    values += [body(specs=[spec(), spec(**more, **{k: v})]) for k in ("file_path", "line_number", "status", "name", "intent", "duration") for v in ODD for more in ({}, {"status": "annotated", "intent": INTENT}) if k not in more]
    texts = [(n, json.dumps(v)) for n, v in enumerate([*values, 3, [1], "x", None, {}])] + [(-1, "{"), (-2, "{} {}"), (-3, None)]
    df = spark.createDataFrame(texts, "n int, value string")
    found = {r["n"]: r["errors"] for r in ingest.validate(df).select("n", "errors").collect()}
    whole = {r["n"]: r["_plain"] for r in with_json(df, "body", F.col("value")).select("n", ingest._plain(F.try_variant_get("body", "$", ingest.WHOLE)).alias("_plain")).collect()}
    assert whole == {n: not e for n, e in found.items()}
    monkeypatch.setattr(ingest, "_plain", lambda whole: F.lit(False))
    assert {r["n"]: r["errors"] for r in ingest.validate(df).select("n", "errors").collect()} == found
    assert 30 < sum(not e for e in found.values()) < len(found) - 100


def test_a_body_is_read_once(spark):
    """Filters on what was made of a body don't have it parsed again."""
    df = spark.createDataFrame([], "repository_id long, delivery_seq long, received_at timestamp, value string")
    good = ingest.accepted(ingest.validate(df))
    for rows in (ingest.run_rows(good), ingest.shard_rows(good), ingest.observation_rows(good)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def deliveries(spark, *bodies):
    rows = [(1, i, datetime(2024, 1, 1, 0, i), json.dumps(b)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "repository_id long, delivery_seq long, received_at timestamp, value string")
    return ingest.accepted(ingest.validate(df))


def test_first_of_equal_ids_wins_and_null_ids_stay(spark):
    specs = [spec(id="1", name="first"), spec(id="1", name="second"), spec(name="x"), spec(name="x")]
    rows = ingest.observation_rows(deliveries(spark, body(specs=specs))).collect()
    assert sorted((r["example_id"] or "", r["name"]) for r in rows) == [("", "x"), ("", "x"), ("1", "first")]


def test_redelivery_replaces_and_a_moved_example_keeps_its_link(spark):
    first = ingest.observation_rows(deliveries(spark, body(specs=[spec(id="1"), spec(id="2")])))
    linked = ingest.merge_observations(first.limit(0), first).withColumn("spec_identity_id", F.lit(7).cast("long"))
    again = ingest.observation_rows(deliveries(spark, body(), body(specs=[spec(id="1", name="renamed")])).filter("delivery_seq = 1"))
    rows = ingest.merge_observations(linked, again).collect()
    assert [(r["example_id"], r["name"], r["spec_identity_id"]) for r in rows] == [("1", "renamed", None)]
    moved = ingest.observation_rows(deliveries(spark, body(), body(shard_id="s2", specs=[spec(id="2", name="moved")])).filter("delivery_seq = 1"))
    rows = sorted(ingest.merge_observations(linked, moved).collect(), key=lambda r: r["example_id"])
    assert [(r["example_id"], r["shard_key"], r["name"], r["spec_identity_id"]) for r in rows] == [("1", "=s1", "does it", 7), ("2", "=s2", "moved", 7)]


def test_an_empty_redelivery_takes_its_shards_rows_away(spark):
    rows = deliveries(spark, body(specs=[spec(id="1")]), body(shard_id="s2", specs=[spec(id="2")]), body(specs=[]))
    early, late = rows.filter("delivery_seq < 2"), rows.filter("delivery_seq = 2")
    first = ingest.merge_observations(ingest.observation_rows(rows).limit(0), ingest.observation_rows(early), early)
    assert sorted(r["example_id"] for r in first.collect()) == ["1", "2"]
    assert [r["example_id"] for r in ingest.merge_observations(first, ingest.observation_rows(late), late).collect()] == ["2"]
    whole = ingest.merge_observations(first.limit(0), ingest.observation_rows(rows), rows)
    assert [r["example_id"] for r in whole.collect()] == ["2"]


def test_examples_are_made_of_the_last_delivery_of_a_shard_only(spark, tmp_path, monkeypatch):
    """Both for a batch and for stored queries, which keep no bodies."""
    from runlens.queries_ingest import DELIVERED

    good = deliveries(spark, body(specs=[spec(id="1")]), body(shard_id="s2", specs=[spec(id="2")]), body(specs=[spec(id="3")])).select(*DELIVERED)
    made, whole = [], ingest.observation_rows
    monkeypatch.setattr(ingest, "observation_rows", lambda rows: made.append(rows) or whole(rows))
    none = spark.createDataFrame([], "repository_id long, occurred_at timestamp, details array<string>, total_reasons_count int, user_agent string, id long")
    add_deliveries(tables := Tables(spark, str(tmp_path / "tables")), good, none)
    assert [sorted(r["delivery_seq"] for r in rows.collect()) for rows in made] == [[1, 2]]
    assert sorted(r["example_id"] for r in tables.read("observations").collect()) == ["2", "3"]


def test_anonymous_deliveries_are_runs_of_their_own(spark):
    rows = deliveries(spark, body(ci_run_id=None), body(ci_run_id=""))
    assert ingest.run_rows(rows).count() == 2


def test_totals_derive_from_the_last_of_each_shard(spark):
    rows = deliveries(spark, body(), body(shard_id="s2", duration_seconds=4.0, specs=[spec(), spec()]), body(specs=[spec(), spec(), spec()]))
    total = ingest.derived_totals(ingest.shard_rows(rows), ("run_key",)).first()
    assert (total["total_specs_count"], total["duration_seconds"]) == (5, 4.0)


def test_rejections_are_bounded(spark):
    bad = body(specs=[spec(file_path="")] * 25)
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), json.dumps(bad), "x" * 400)], "repository_id long, occurred_at timestamp, value string, user_agent string")
    row = ingest.rejections(ingest.validate(df)).first()
    assert len(row["details"]) == 20 and row["total_reasons_count"] == 25 and len(row["user_agent"]) == 300


def deliver(folder, name, value, repository=1, at=None):
    own = folder / f"repository_id={repository}"
    own.mkdir(parents=True, exist_ok=True)
    raw = value if isinstance(value, str) else json.dumps(value)
    path = own / name
    path.write_bytes(gzip.compress(raw.encode()) if name.endswith(".gz") else raw.encode())
    if at is not None:
        os.utime(path, (at, at))


def state(tables):
    """All tables' rows, in any order."""
    found = {}
    for name in Tables.NAMES:
        df = tables.read(name)
        found[name] = sorted(map(str, df.collect())) if df is not None else []
    return found


def test_stream_is_idempotent(spark, tmp_path):
    source, root, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    deliver(source, "0001.json", body(specs=[spec(id="1"), spec(id="2")]))
    deliver(source, "0002.json.gz", body(shard_id="s2", specs=[spec(id="3")]))
    deliver(source, "no digits.json", "{")

    def go():
        q = start_ingest(spark, str(source), str(root), str(checkpoint))
        q.awaitTermination()
        tables = Tables(spark, str(root))
        return sorted(r["example_id"] for r in tables.read("observations").collect()), run_view(tables).first()["total_specs_count"], tables.read("rejections").count()

    assert go() == (["1", "2", "3"], 3, 1)
    deliver(source, "0004.json", body(specs=[spec(id="1"), spec(id="2")]))
    assert go() == (["1", "2", "3"], 3, 1)  # the shard replaced itself
    assert go() == (["1", "2", "3"], 3, 1)  # nothing new


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    source = tmp_path / "in"
    deliver(source, "a.json", body(specs=[spec(id="1"), spec(id="2")]))
    deliver(source, "b.json", "{", repository=2)
    batch = read_deliveries(spark, str(source), streaming=False)
    tables = Tables(spark, str(tmp_path / "out"))
    upsert_batch(tables, batch, 0)
    once, version = state(tables), tables.current()
    upsert_batch(tables, batch, 0)
    assert state(tables) == once and tables.current() == version
    # another batch under the same number, as after a checkpoint was deleted, is merged
    deliver(tmp_path / "in2", "c.json", body(ci_run_id="r2", specs=[spec(id="9")]))
    upsert_batch(tables, read_deliveries(spark, str(tmp_path / "in2"), streaming=False), 0)
    assert {r["example_id"] for r in tables.read("observations").collect()} == {"1", "2", "9"}


def test_a_crash_before_the_mark_leaves_what_was(spark, tmp_path, monkeypatch):
    tables = Tables(spark, str(tmp_path / "out"))
    deliver(tmp_path / "in", "a.json", body(specs=[spec(id="1")]))
    upsert_batch(tables, read_deliveries(spark, str(tmp_path / "in"), streaming=False), 0)
    before = state(tables)
    deliver(tmp_path / "in2", "b.json", body(specs=[spec(id="1"), spec(id="2")]))
    batch = read_deliveries(spark, str(tmp_path / "in2"), streaming=False)
    with monkeypatch.context() as m:
        m.setattr(Tables, "_publish", lambda self, made: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            upsert_batch(tables, batch, 1)
    assert state(tables) == before
    upsert_batch(tables, batch, 1)
    after = state(tables)
    assert len(after["observations"]) == 2
    upsert_batch(tables, batch, 1)
    assert state(tables) == after


def test_bodies_that_cannot_be_read_are_refused_and_stop_nothing(spark, tmp_path):
    """Each outcome of a gzip or plain body, streamed: what is refused is a rejection, and all others are ingested."""
    source, most = tmp_path / "in", 100_000
    own = source / "repository_id=1"
    own.mkdir(parents=True)
    text = lambda k, **more: json.dumps(body(ci_run_id=f"r{k}", specs=[spec(id=str(k))]) | more).encode()
    packed = gzip.compress(text(3))
    files = {
        "01-good.json": text(1),
        "02-no-gzip.json.gz": b"this is no gzip",
        "03-two-members.json.gz": packed + gzip.compress(text(99)),
        "04-trailing.json.gz": gzip.compress(text(4)) + b"trailing garbage",
        "05-cut.json.gz": packed[:-20],
        "06-no-trailer.json.gz": packed[:-8],
        "07-bad-crc.json.gz": packed[:-8] + bytes(8),
        "09-bomb.json.gz": gzip.compress(b"x" * 50_000_000),
        "10-prose.json": text(10) + b" and then prose",
        "11-repeated.json": b'{"branch":1,"branch":"main",' + text(11)[1:],
        "12-latin.json": b'{"a":"\xe9"}',
        "13-long.json": text(13) + b" " * most,
        "14-very-long.json": b"y" * (2 * most),
        "15-very-long.json.gz": os.urandom(2 * most),
        "16-at-the-limit.json.gz": gzip.compress(text(16).ljust(most)),
        "17-over-the-limit.json.gz": gzip.compress(text(17).ljust(most + 1)),
    }
    for k, (name, raw) in enumerate(files.items()):
        (own / name).write_bytes(raw)
        os.utime(own / name, (1_700_000_000 + k, 1_700_000_000 + k))
    tables = Tables(spark, str(tmp_path / "out"))
    start_ingest(spark, str(source), tables.root, str(tmp_path / "check"), max_bytes=most).awaitTermination()
    assert {r["example_id"] for r in tables.read("observations").collect()} == {"1", "3", "4", "11", "16"}
    reasons = [r["details"] for r in tables.read("rejections").orderBy("occurred_at").collect()]
    too_much = inflates(most)
    assert reasons == [[x] for x in (CORRUPT, CORRUPT, CORRUPT, CORRUPT, too_much, NOT_JSON, NOT_JSON, TOO_LARGE, TOO_LARGE, too_much, too_much)]
    assert inflates(64 << 20) == "The gzipped request body inflates to more than 64 MiB."


def test_a_bomb_is_left_at_the_limit():
    import tracemalloc

    bomb = gzip.compress(b"0" * 200_000_000)
    tracemalloc.start()
    assert inflate(bomb, 1 << 20) == (None, inflates(1 << 20)) and inflate(b"") == (None, CORRUPT)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_json_is_the_whole_text(spark):
    good = ['{"a":1}', ' {"a":1}\n', "[1]", '"x"', "null", '{"a":{"b":1,"b":2}}', '{"a":1,"a":2}', "-1.5e3"]
    bad = ['{"a":1} x', '{"a":1}]', '{"a":1}} x', "1,2", '{"a":1},"v":2', "1] [", '"a":1', "}", '"a"} , {"b":2}', "{'a':1}", '{"a":"\t"}', '{"a":1,}', "", " ", "nul", '{"a":NaN}', '{"a":1}\x00', "1}", "{", "]", '1],"v":[2', None]
    df = with_json(spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, t string"), "v", F.col("t"))
    found = {r["i"]: r["v"] for r in df.select("i", F.to_json("v").alias("v")).collect()}
    assert [found[i] for i in range(len(good))] == ['{"a":1}', '{"a":1}', "[1]", '"x"', "null", '{"a":{"b":2}}', '{"a":2}', "-1500.0"]
    assert [found[len(good) + i] for i in range(len(bad))] == [None] * len(bad)
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def accepted_bodies(spark, n, bodies):
    """Bodies known to be right as (accepted deliveries, no rejections) of hour n, without the plan of all checks."""
    rows = [(1, f"{n:04d} {k:04d}", datetime(2024, 1, 1, n), json.dumps(b)) for k, b in enumerate(bodies)]
    df = with_json(spark.createDataFrame(rows, "repository_id long, delivery_seq string, received_at timestamp, value string"), "body", F.col("value"))
    good = ingest.accepted(df.withColumn("errors", F.array().cast("array<string>"))).persist()
    return good, spark.createDataFrame([], "repository_id long, occurred_at timestamp, details array<string>, total_reasons_count int, user_agent string, id long")


def size_of(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    """Twenty batches of 20 runs each, onto a store that grows: each adds about as many bytes as the first."""
    tables, written = Tables(spark, str(tmp_path / "out")), []
    for n in range(20):
        bodies = [body(ci_run_id=f"r{k % 90}", shard_id=f"s{n}", specs=[spec(id=f"{n}-{k}-{i}") for i in range(5)]) for k in range(n * 20, n * 20 + 20)]
        good, refused = accepted_bodies(spark, n, bodies)
        before = set((tmp_path / "out").rglob("*.parquet"))
        add_deliveries(tables, good, refused, n, str(n))
        written.append(sum(p.stat().st_size for p in set((tmp_path / "out").rglob("*.parquet")) - before))
    assert max(written) < 1.5 * min(written)
    once, held = state(tables), size_of(tmp_path / "out")
    assert len(once["observations"]) == 20 * 20 * 5
    assert [len(own) for own in tables.current()["segments"].values()] == [20, 20, 20]
    assert tables.compact() >= 3
    segments = tables.current()["segments"]
    assert all(len(own) < tables.fanout for own in segments.values()) and state(tables) == once
    assert sum(s["bytes"] for own in segments.values() for s in own) < held
    assert tables.compact() == 0


def random_bodies(rng, n):
    return [body(ci_run_id=f"r{rng.randrange(4)}", shard_id=f"s{rng.randrange(3)}", specs=[spec(**({"id": str(rng.randrange(12))} if rng.random() < 0.8 else {}), name=f"n{rng.randrange(100)}") for _ in range(rng.randrange(5))]) for _ in range(n)]


def test_reads_equal_the_merge_of_all_batches(spark, tmp_path):
    """Random deliveries, redeliveries and moved examples: reading merges to what applying one batch after the other gives, compacted or not."""
    import random

    rng, tables = random.Random(3), Tables(spark, str(tmp_path / "out"), fanout=2)
    runs = shards = observations = None
    for n in range(6):
        good, refused = accepted_bodies(spark, n, random_bodies(rng, 4))
        new = ingest.with_state(ingest.observation_rows(good))
        observations = write_table(ingest.merge_observations(observations if observations is not None else new.limit(0), new, good), "observations")
        runs = write_table(ingest.merge_runs(runs if runs is not None else ingest.run_rows(good).limit(0), ingest.run_rows(good)), "runs")
        shards = write_table(ingest.merge_shards(shards if shards is not None else ingest.shard_rows(good).limit(0), ingest.shard_rows(good)), "shards")
        add_deliveries(tables, good, refused, n, str(n))
        if n % 3 == 2:
            tables.compact()
        assert sorted(map(str, tables.read("observations").select(*observations.columns).collect())) == sorted(map(str, observations.collect()))
        assert sorted(map(str, tables.read("shards").collect())) == sorted(map(str, shards.collect()))
        held = tables.read("runs")
        assert sorted(map(str, held.select(*runs.columns).collect())) == sorted(map(str, runs.collect()))
        assert held.select("id").distinct().count() == held.count()


def test_a_read_for_some_runs_opens_their_files_only(spark, tmp_path, monkeypatch):
    from runlens.streaming import store

    monkeypatch.setattr(store, "FILE_BYTES", 4000)
    tables = Tables(spark, str(tmp_path / "out"), fanout=2)
    for n in range(2):
        add_deliveries(tables, *accepted_bodies(spark, n, [body(ci_run_id=f"r{k}", shard_id=f"s{n}", specs=[spec(id=str(n))]) for k in range(60)]))
    tables.compact()
    (segment,) = tables.current()["segments"]["observations"]
    wanted = tables.hashes("runs", spark.createDataFrame([(1, "=r7")], "repository_id long, run_key string"))
    files = tables.raw("observations").inputFiles()
    assert len(files) >= 4 and len(tables._files(segment, wanted)) == 1
    assert {r["run_key"] for r in tables.read("observations", wanted).collect()} == {"=r7"} and tables.read("observations", wanted).count() == 2
    assert tables.read("observations", {2**63 - 1}) is None


def test_runs_beyond_the_kept_ones_expire_without_rewriting(spark, tmp_path):
    """A 61st run takes away exactly the first run's rows; no file of examples changes, and merging segments leaves the rows out."""
    tables = Tables(spark, str(tmp_path / "out"), fanout=2)
    bodies = [body(ci_run_id=f"r{k}", specs=[spec(id="1"), spec(id="2")]) for k in range(60)] + [body(ci_run_id=f"b{k}", branch=None, specs=[spec(id="1")]) for k in range(60)]
    add_deliveries(tables, *accepted_bodies(spark, 0, bodies))
    assert expire_runs(tables) == 0
    add_deliveries(tables, *accepted_bodies(spark, 1, [body(ci_run_id="r60", specs=[spec(id="1")])]))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("observations/*.parquet")}
    before, held = files(), tables.read("observations").count()
    assert expire_runs(tables) == 1 and files() == before
    runs = lambda: {r["run_key"] for r in tables.read("observations").collect()}
    assert tables.read("observations").count() == held - 2
    assert runs() == {f"=r{k}" for k in range(1, 61)} | {f"=b{k}" for k in range(60)}
    assert expire_runs(tables, kept=50, most=5) == 5  # a step at a time, the oldest first
    assert runs() >= {f"=r{k}" for k in range(6, 61)}
    while expire_runs(tables, kept=50, most=5):
        pass
    left = {f"=r{k}" for k in range(11, 61)} | {f"=b{k}" for k in range(10, 60)}
    assert runs() == left and tables.read("runs").count() == 121
    tables.compact(["observations"])
    assert {r["run_key"] for r in tables.raw("observations").collect()} == left == runs()
    add_deliveries(tables, *accepted_bodies(spark, 2, [body(ci_run_id="r0", shard_id="s9", specs=[spec(id="9")])]))
    assert {r["example_id"] for r in tables.read("observations").filter("run_key = '=r0'").collect()} == {"9"}


def test_two_writers_lose_nothing(spark, tmp_path):
    """Another writer commits between a batch's reading and its publishing: a batch of other runs is published over it, one of the same run is made again."""
    made = lambda name, n, *bodies: [deliver(tmp_path / name, f"{n}{k}.json", b, at=1_700_000_000 + n) for k, b in enumerate(bodies)] and read_deliveries(spark, str(tmp_path / name), streaming=False)
    tables, other = Tables(spark, str(tmp_path / "out")), Tables(spark, str(tmp_path / "out"))
    upsert_batch(tables, made("a", 1, body(ci_run_id="r1", specs=[spec(id="1"), spec(id="2")])), 0)
    for n, run in ((2, "r1"), (3, "r5")):
        asked = []
        publish = tables._publish

        def late(version, n=n, run=run, publish=publish, asked=asked):
            asked.append(version["version"])
            if len(asked) == 1:
                upsert_batch(other, made(f"x{n}", n, body(ci_run_id=run, shard_id="s2", specs=[spec(id="1", name=f"moved {n}")])), 100 + n)
            return publish(version)

        tables._publish = late
        upsert_batch(tables, made(f"y{n}", n + 10, body(ci_run_id="r1", shard_id=f"s{n + 1}", specs=[spec(id=f"own{n}")])), n)
        tables._publish = publish
        assert len(asked) == 2 and asked[1] == asked[0] + 1
    rows = {(r["run_key"], r["example_id"]): r["shard_key"] for r in tables.read("observations").collect()}
    assert rows == {("=r1", "1"): "=s2", ("=r1", "2"): "=s1", ("=r1", "own2"): "=s3", ("=r1", "own3"): "=s4", ("=r5", "1"): "=s2"}
    assert sorted(r["id"] for r in tables.read("runs").collect()) == [1, 2]


def test_the_last_delivery_by_time_wins(spark, tmp_path):
    deliver(tmp_path / "in", "z.json", body(commit_sha="first", specs=[spec(id="1", name="first")]), at=1_700_000_000)
    deliver(tmp_path / "in", "b.json", body(commit_sha="second", specs=[spec(id="1", name="second")]), at=1_700_000_100)
    deliver(tmp_path / "in", "c.json", body(commit_sha="third", specs=[spec(id="1", name="third")]), at=1_700_000_100)
    tables = Tables(spark, str(tmp_path / "out"))
    upsert_batch(tables, read_deliveries(spark, str(tmp_path / "in"), streaming=False), 0)
    assert [r["name"] for r in tables.read("observations").collect()] == ["third"]
    assert [r["commit_sha"] for r in tables.read("runs").collect()] == ["first"]


def test_batches_resolve_to_identities(spark, tmp_path):
    source, tables = tmp_path / "in", Tables(spark, str(tmp_path / "out"))
    deliver(source, "a.json", body(specs=[spec(id="1", name="pays"), spec(id="2", name="renders the footer"), spec(id="3", name="Pays!")]), at=1_700_000_000)
    deliver(source, "b.json", body(specs=[spec(id="1", name="pays")]), repository=2, at=1_700_000_001)
    q = start_ingest(spark, str(source), tables.root, str(tmp_path / "check"), embed=lexical_embedder())
    q.awaitTermination()
    ids = lambda: {(r["repository_id"], r["run_key"], r["example_id"]): r["spec_identity_id"] for r in tables.read("observations").collect()}
    first = ids()
    assert first[(1, "=r1", "1")] == first[(1, "=r1", "3")] != first[(1, "=r1", "2")] and len(set(first.values())) == 3
    batch = read_deliveries(spark, str(source), streaming=False)
    once = state(tables)
    upsert_batch(tables, batch, 0, lexical_embedder())
    assert state(tables) == once
    runs = {r["run_key"]: r["id"] for r in tables.read("runs").filter("repository_id = 1").collect()}
    seen = {r["text"]: (r["last_seen_test_run_id"], r["last_seen_at"].timestamp()) for r in tables.read("identities").filter("repository_id = 1").collect()}
    assert seen == {"pays": (runs["=r1"], 1_700_000_000), "renders the footer": (runs["=r1"], 1_700_000_000)}
    deliver(source, "c.json", body(ci_run_id="r2", specs=[spec(id="7", name="renders the footer"), spec(id="8", name="sends a mail")]))
    start_ingest(spark, str(source), tables.root, str(tmp_path / "check"), embed=lexical_embedder()).awaitTermination()
    later = ids()
    assert later[(1, "=r2", "7")] == first[(1, "=r1", "2")] and later[(1, "=r2", "8")] == 4
    assert {k: v for k, v in later.items() if k in first} == first and tables.read("identities").count() == 4
    runs = {r["run_key"]: r["id"] for r in tables.read("runs").filter("repository_id = 1").collect()}
    assert {r["text"]: r["last_seen_test_run_id"] for r in tables.read("identities").filter("repository_id = 1").collect()} == {"pays": runs["=r1"], "renders the footer": runs["=r2"], "sends a mail": runs["=r2"]}
    assert tables.read("cache").count() == 4  # a text of two repositories, or of two batches, is embedded once


def test_an_index_kept_by_batches_finds_and_follows_identities(spark, tmp_path):
    """The second batch is resolved by the stored index, which then holds the identities that came and the one whose spelling moved."""
    from runlens.streaming.ingest import index_centres, reindex

    names = [["pays", "renders the footer", "sends a mail"], ["Pays!", "a new one", "renders the footer"]]
    tables = Tables(spark, str(tmp_path / "out"))
    for n, own in enumerate(names):
        good, refused = accepted_bodies(spark, n, [body(ci_run_id=f"r{n}", specs=[spec(id=str(k), name=x) for k, x in enumerate(own)])])
        add_deliveries(tables, good, refused)
        resolve_runs(tables, good, lexical_embedder(), now=datetime(2024, 1, 2, n))
        if n == 0:
            assert reindex(tables, least=2) and not reindex(tables, least=2)
    linked = {(r["run_key"], r["name"]): r["spec_identity_id"] for r in tables.read("observations").collect()}
    assert linked["=r1", "Pays!"] == linked["=r0", "pays"] and linked["=r1", "renders the footer"] == linked["=r0", "renders the footer"]
    assert linked["=r1", "a new one"] == 4 and {r["text"] for r in tables.read("identities").collect()} == {"Pays!", "renders the footer", "sends a mail", "a new one"}
    at = tables.current()
    held = nearest.entries(tables.read("identities"), index_centres(tables, at))
    kept = tables.read("cells").filter("not gone")
    assert sorted(map(str, kept.select(*held.columns).collect())) == sorted(map(str, held.collect())) and len(at["segments"]["cells"]) >= 2


def test_a_sweep_tries_the_failed_rows_of_earlier_runs(spark, tmp_path):
    from datetime import timedelta

    made = lambda name, at, *bodies: [deliver(tmp_path / name, f"{k}.json", b, at=at + k) for k, b in enumerate(bodies)] and read_deliveries(spark, str(tmp_path / name), streaming=False)
    now = datetime.now()
    at, tables = int(now.timestamp()) - 7200, Tables(spark, str(tmp_path / "out"))
    broken = lambda text: F.lit(None).cast("array<float>")
    upsert_batch(tables, made("a", at, body(ci_run_id="r1", specs=[spec(id="1", name="pays"), spec(id="2", name="renders")]), body(ci_run_id="r2", specs=[spec(id="3", name="pays")])), 0, broken)
    rows = tables.read("observations")
    assert {(r["spec_identity_id"], r["embed_failure_count"]) for r in rows.collect()} == {(None, 1)}
    from runlens.streaming.ingest import sweep

    sweep(tables, 1, broken, now=now, budget=2)
    assert sorted(r["embed_failure_count"] for r in tables.read("observations").collect()) == [1, 2, 2]
    sweep(tables, 1, lexical_embedder(), now=now + timedelta(days=8))  # given up after a week
    assert tables.read("identities") is None
    sweep(tables, 1, lexical_embedder(), now=now)
    linked = {r["example_id"]: r["spec_identity_id"] for r in tables.read("observations").collect()}
    assert linked["1"] == linked["3"] != linked["2"] and None not in linked.values()
    runs = {r["run_key"]: r["id"] for r in tables.read("runs").collect()}
    assert {r["text"]: r["last_seen_test_run_id"] for r in tables.read("identities").collect()} == {"pays": runs["=r2"], "renders": runs["=r1"]}
    version = tables.current()["version"]
    sweep(tables, 1, lexical_embedder(), now=now)
    assert tables.current()["version"] == version  # nothing left to try


def test_windowed_events(spark, sf_dir):
    from runlens.sources import adapters

    rows = windowed_events(adapters.observations(spark, sf_dir), "1 day")
    assert rows.agg(F.sum("n")).first()[0] == 1000


def test_retention_edges(spark):
    rows = [(i, 1, b, datetime(2024, 1, 1)) for b in ("main", None) for i in range(61 if b else 60)]
    df = spark.createDataFrame(rows, "id long, repository_id long, branch string, created_at timestamp")
    kept = retention.retained_runs(df).groupBy("branch").agg(F.count(F.lit(1)), F.min("id")).collect()
    assert {(r[0], r[1], r[2]) for r in kept} == {("main", 60, 1), (None, 60, 0)}
    cache = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2023, 12, 31),)], "updated_at timestamp")
    now = datetime(2024, 3, 31)
    assert retention.live_cache(cache, now).count() == 1 and retention.expired_cache(cache, now).count() == 1
