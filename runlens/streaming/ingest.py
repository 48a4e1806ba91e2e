"""Ingest as a stream: JSON deliveries (plain or gzip) arrive as files; each micro-batch adds its rows to tables that are merged when read.

A batch writes what it delivers and nothing else (``store``); a body that can't be read is a rejection like any other
and stops nothing. A version remembers the batch and a fingerprint of its deliveries: the same batch run again after it
became current changes nothing, and one that failed before left nothing that a reader sees.

With an embedder, the unresolved rows of each batch's runs are then resolved to identities, in a version of its own, which
holds the rows and identities that changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.providers import Provider
from ..operators import clusters, identity, ingest, nearest, partials, retention
from ..plans.primitives import numbered
from ..sources.bodies import MAX_BYTES, read_bodies
from .store import Change, Tables, row_key

#: Compressed text that a task reads at once.
ARROW_BYTES = "64m"
IDENTITIES = "id long, repository_id long, text string, text_digest string, signal_source string, embedding array<float>, file_path string, line_number int, last_seen_test_run_id long, last_seen_at timestamp"
CACHE = "provider_fingerprint string, text_digest string, embedding array<float>, created_at timestamp, updated_at timestamp"
RUN = ["repository_id", "run_key"]
#: What makes vectors: an expression, or a provider, asked in waves and cached under its own fingerprint.
Embedder = Callable[[Column], Column] | Provider


def read_deliveries(spark: SparkSession, folder: str, streaming: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files as deliveries: value, fault (why a body can't be read), repository_id (from the path), received_at, delivery_seq.

    Deliveries are in the order of their files' times, and of names within one time.
    """
    rows = read_bodies(spark, folder, streaming, max_bytes)
    name = F.element_at(F.split("path", "/"), -1)
    seq = F.concat(F.lpad(F.unix_micros("received_at").cast("string"), 20, "0"), F.lit(" "), name)
    return rows.withColumns({"delivery_seq": seq, "occurred_at": F.col("received_at"), "user_agent": F.lit(None).cast("string")})


def check_deliveries(batch: DataFrame) -> DataFrame:
    """The batch validated; a body with a ``fault`` is refused for that alone."""
    checked = ingest.validate(batch)
    if "fault" in batch.columns:
        checked = checked.withColumn("errors", F.when(F.col("fault").isNotNull(), F.array("fault")).otherwise(F.col("errors")))
    return checked


def _fingerprint(batch: DataFrame) -> str:
    """A digest of a batch's deliveries, whatever their order."""
    found = batch.agg(F.count(F.lit(1)), F.sum(F.xxhash64("repository_id", "delivery_seq", "value").cast("decimal(38,0)"))).first()
    return f"{found[0]}:{found[1]}"


def _stamped(df: DataFrame, version: int) -> DataFrame:
    return df.withColumns({"_delivered": F.lit(version).cast("long"), "_changed": F.lit(version).cast("long")})


def _run_rows(tables: Tables, good: DataFrame, base: dict, hashes: set[int] | None) -> tuple[DataFrame, int]:
    """The runs of a batch with their ids, and the highest id: new runs are numbered in the order of their deliveries."""
    rows, top = ingest.run_rows(good), base["tops"].get("run", 0)
    known = tables.read("runs", hashes, base)
    old = known.select(*RUN, "id") if known is not None else rows.select(*RUN, F.lit(0).cast("long").alias("id")).limit(0)
    new, order = rows.join(old, RUN, "left_anti"), ["delivery_seq", *RUN]
    if hashes is None:
        new = numbered(new, order, "rank")
    else:  # at most HASHES rows
        new = new.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    made = new.withColumn("id", F.lit(top).cast("long") + F.col("rank")).drop("rank")
    highest = made.agg(F.coalesce(F.max("id"), F.lit(top))).first()[0]
    return made.unionByName(rows.join(old, RUN)), highest


def upsert_batch(tables: Tables, batch: DataFrame, batch_id: int, embed: Embedder | None = None, provider: str = "local") -> None:
    """Validate one micro-batch, add its rows and, with an embedder, resolve its runs' rows."""
    now, mark = tables.current(), _fingerprint(batch)
    done = now["fingerprint"] or ""
    if now["batch"] == batch_id and done in (mark, f"{mark} resolved"):
        if embed is not None and done == mark:  # added, but stopped before its rows were resolved
            resolve_runs(tables, ingest.accepted(check_deliveries(batch)), embed, provider, (batch_id, f"{mark} resolved"))
        return
    checked = check_deliveries(batch).persist()
    try:
        good = ingest.accepted(checked)
        refused = ingest.rejections(checked).withColumn("id", F.xxhash64("repository_id", "occurred_at", "details"))
        add_deliveries(tables, good, refused, batch_id, mark)
        if embed is not None:
            resolve_runs(tables, good, embed, provider, (batch_id, f"{mark} resolved"))
    finally:
        checked.unpersist()


def add_deliveries(tables: Tables, good: DataFrame, refused: DataFrame, batch_id: int | None = None, mark: str | None = None) -> None:
    """Add accepted deliveries and rejections: one segment a table, of their own rows."""
    hashes = tables.hashes("runs", good)

    def add(base: dict) -> Change:
        version, change = base["version"] + 1, Change(runs=hashes, batch=batch_id, fingerprint=mark)
        made: dict[str, Callable[[], DataFrame]] = {"rejections": lambda: ingest.keep_rejections(refused.dropDuplicates(["id"]))}

        def runs() -> DataFrame:
            rows, change.tops["run"] = _run_rows(tables, good, base, hashes)
            return rows

        def observations() -> DataFrame:
            new, old = ingest.with_state(ingest.observation_rows(ingest.newest_of_shards(good))), tables.read("observations", hashes, base)
            return ingest.arriving(old if old is not None else new.limit(0), new, good).withColumn("_row", row_key())

        if hashes is None or hashes:
            made |= {"runs": runs, "shards": lambda: ingest.shard_rows(good), "observations": observations}
        with ThreadPoolExecutor(len(made)) as pool:  # the tables' jobs do not wait for each other
            found = dict(zip(made, pool.map(lambda name: tables.write(name, _stamped(made[name](), version), version), made), strict=True))
        change.added = {name: s for name, s in found.items() if s}
        return change

    tables.commit(add)


def resolve_runs(tables: Tables, good: DataFrame, embed: Embedder, provider: str = "local", mark: tuple[int, str] | None = None, now: datetime | None = None) -> None:
    """Resolve what is unresolved in the runs of ``good`` against the identities of their repositories."""
    keys = good.select(*RUN).distinct()
    hashes = tables.hashes("runs", keys)
    pick = lambda base: tables.merged("observations", base, hashes)
    _resolve(tables, lambda base: rows.join(keys, RUN, "left_semi") if (rows := pick(base)) is not None else None, hashes, embed, provider, mark, now)


def sweep(tables: Tables, repository_id: int, embed: Embedder, provider: str = "local", now: datetime | None = None, budget: int = identity.SWEEP) -> None:
    """Try the backlog of a repository again, whatever run its rows are of: failed rows first, within a week and the budget."""
    at = now or datetime.now(timezone.utc)

    def pick(base: dict) -> DataFrame | None:
        rows = tables.merged("observations", base)
        if rows is None:
            return None
        rows = rows.filter(F.col("repository_id") == repository_id).withColumn("id", _order())
        return identity.backlog(rows, at, budget).drop("priority", "id")

    _resolve(tables, pick, None, embed, provider, None, at)


def _order() -> Column:
    """Rows are in the order of their deliveries and of their places in them."""
    return F.struct("delivery_seq", "position", "shard_key")


def _resolve(tables: Tables, pick: Callable[[dict], DataFrame | None], hashes: set[int] | None, embed, provider: str, mark: tuple[int, str] | None, now: datetime | None) -> None:
    """Resolve the rows that ``pick`` gives of a version, and add those rows and identities that changed."""
    at = now or datetime.now(timezone.utc)

    def make(base: dict) -> Change | None:
        held = pick(base)
        if held is None:
            return None
        version = base["version"] + 1
        runs = tables.read("runs", hashes, base).select(*RUN, F.col("id").alias("run_id"), F.col("received_at").alias("run_at"))
        before = F.struct("spec_identity_id", "embed_failed_at", "embed_failure_count")
        rows = ingest.with_state(held).withColumns({"id": _order(), "_before": before}).join(runs, RUN)
        owners = tables.hashes("identities", held)
        known = tables.read("identities", owners, base)
        known = known if known is not None else tables.spark.createDataFrame([], IDENTITIES)
        cached = tables.read("cache", None, base)
        owner = embed.fingerprint if isinstance(embed, Provider) else provider
        cache = identity.Cache(cached if cached is not None else tables.spark.createDataFrame([], CACHE), owner, at)
        centres = index_centres(tables, base)
        found = identity.resolve(rows, known, embed, None, cache=cache, top=base["tops"].get("identity", 0), nearest=None if centres is None else _by_index(tables, base, centres))
        change = Change(runs=hashes, batch=mark and mark[0], fingerprint=mark and mark[1])
        moved = found.rows.filter(~before.eqNullSafe(F.col("_before"))).select(*held.columns).drop("_hash")
        change.added["observations"] = tables.write("observations", moved.withColumn("_changed", F.lit(version).cast("long")), version)
        whole = F.struct(*(F.col(c) for c in known.columns if c != "id"))
        past = known.select("id", whole.alias("_past"))
        fresh = found.identities.select(*known.columns).join(past, "id", "left").filter(~whole.eqNullSafe(F.col("_past")))
        change.added["identities"] = tables.write("identities", _stamped(fresh.drop("_past"), version), version)
        if centres is not None:
            change.added["cells"] = tables.write("cells", _stamped(_moved_entries(fresh, centres), version), version)
        entry = ["provider_fingerprint", "text_digest", "created_at"]
        change.added["cache"] = tables.write("cache", _stamped(found.cache.join(cache.entries.select(*entry), entry, "left_anti"), version), version)
        change.added = {name: s for name, s in change.added.items() if s}
        if "identities" in change.added:
            top = tables.spark.read.parquet(change.added["identities"]["path"]).agg(F.max("id")).first()[0]
            change.tops["identity"] = max(top, base["tops"].get("identity", 0))
        return change if change.added or mark else None

    tables.commit(make)


# ------------------------------------------------------------------ retention

#: Runs that one step takes away, so that a long neglected branch is drained a step at a time.
EXPIRED_A_STEP = 500


def expire_runs(tables: Tables, kept: int = retention.RUNS_KEPT, most: int = EXPIRED_A_STEP) -> int:
    """Take away the rows of runs beyond the newest ``kept`` of their branch, at most ``most`` runs, the newest of them last; gives how many.

    Runs and shards stay. A run that expires is one small row: its examples are dead from then on, no file is rewritten, and
    the next merge of segments leaves them out. A delivery to an expired run brings that delivery's rows, until the next step.
    """
    done = []

    def make(base: dict) -> Change | None:
        done.clear()
        runs, held = tables.read("runs", None, base), tables.merged("observations", base)
        if runs is None or held is None:
            return None
        ranked = retention.ranked_runs(runs.withColumn("created_at", F.col("received_at"))).filter(F.col("age_rank") > kept)
        over = ranked.join(held.select(*RUN).distinct(), RUN, "left_semi").orderBy(F.desc("age_rank"), "id").limit(most)
        version = base["version"] + 1
        segment = tables.write("expired", _stamped(over.select(*RUN), version), version)
        if segment is None:
            return None
        done.append(segment["rows"])
        return Change({"expired": segment})

    tables.commit(make)
    return done[0] if done else 0


def expire_cache(tables: Tables, now: datetime, days: int = retention.CACHE_DAYS) -> bool:
    """Write the embedding cache anew without entries that no one used within the days; whether any was left out."""

    def make(base: dict) -> Change | None:
        held = tables.merged("cache", base)
        if held is None or retention.expired_cache(held, now, days).isEmpty():
            return None
        version, past = base["version"] + 1, [s["path"] for s in base["segments"]["cache"]]
        return Change({"cache": tables.write("cache", retention.live_cache(held, now, days).drop("_hash"), version)}, {"cache": past}, set())

    before = tables.current()["version"]
    return tables.commit(make)["version"] != before


# ------------------------------------------------------------------ partial aggregates of runs

#: What changes a run's examples.
FOLLOWED = ("observations", "shards", "expired")


def refresh_partials(tables: Tables) -> bool:
    """Add up again the runs that changed since this was last done; whether there were any.

    Reads the segments that came since, for the names of their runs, and these runs' examples: about what ingest read and wrote. A run's new
    totals bury what was added up of it before, so nothing is rewritten; a run without examples left has totals of zero.
    """

    def make(base: dict) -> Change | None:
        mark, version = base["facts"].get("windows"), base["version"] + 1
        since = {name: [s["path"] for s in base["segments"].get(name, []) if mark is None or s.get("at", 0) > mark] for name in FOLLOWED}
        found = [tables.raw(name, base, paths=paths).select(*RUN) for name, paths in since.items() if paths]
        if not found:
            return None
        stale = reduce(DataFrame.unionByName, found).distinct()
        hashes = tables.hashes("runs", stale)
        rows = tables.merged("observations", base, hashes)
        if rows is not None:
            rows = ingest.with_state(rows).join(stale, RUN, "left_semi").select(*RUN, *partials.READ)
            rows = rows.persist() if hashes is not None else rows  # four tables of few runs; of more, each reads for itself

        def table(name: str) -> DataFrame | None:
            made = partials.partial(rows, name, RUN) if rows is not None else None
            if name != "run_facts":
                return made
            zero = {c: 0 for c in ("recorded_count", "named_count", "resolved_count", "reported_count", "timed_count")}
            if made is None:
                return stale.withColumns({c: F.lit(0).cast("long") for c in zero} | {"seconds": F.lit(None).cast("double")})
            return stale.join(made, RUN, "left").fillna(zero)

        try:
            made = {name: df for name in partials.WITHIN if (df := table(name)) is not None}
            with ThreadPoolExecutor(len(made)) as pool:
                written = dict(zip(made, pool.map(lambda name: tables.write(name, _stamped(made[name], version), version), made), strict=True))
        finally:
            if rows is not None:
                rows.unpersist()
        return Change({name: s for name, s in written.items() if s}, runs=set(), facts={"windows": base["version"]})

    before = tables.current()["facts"].get("windows")
    return tables.commit(make)["facts"].get("windows") != before


def read_partials(tables: Tables, run_ids: Sequence[int], at: dict | None = None) -> partials.Partials:
    """The partial aggregates of a window's runs (``id`` in runs), as of the last ``refresh_partials``; files of other runs stay closed."""
    at, found = at or tables.current(), {}
    runs = _runs_of(tables, run_ids, at)
    hashes = tables.hashes("runs", runs)
    for name, within in partials.WITHIN.items():
        held = tables.read(name, hashes, at)
        if held is None:
            kinds = {"spec_identity_id": "bigint", "seconds": "double", "slowest_seconds": "double"}
            columns = [*within, *partials.measures(name)]
            held = tables.spark.createDataFrame([], ", ".join(["repository_id bigint, run_key string", *(f"{c} {kinds.get(c, 'bigint' if c.endswith('_count') else 'string')}" for c in columns)]))
        found[name] = held.join(F.broadcast(runs), RUN).drop(*RUN)
    return partials.Partials.of(found)


def _runs_of(tables: Tables, run_ids: Sequence[int], at: dict) -> DataFrame:
    """The keys of some runs, with ``test_run_id``: as many rows as ids."""
    return tables.read("runs", None, at).filter(F.col("id").isin(list(run_ids))).select(*RUN, F.col("id").alias("test_run_id"))


def rows_with_description(tables: Tables, run_ids: Sequence[int], name: str, at: dict | None = None) -> DataFrame | None:
    """The examples of a description in a window, for ``stability.unstable_test_runs``: only runs that hold it by their aggregates are opened.

    None if no run does.
    """
    at = at or tables.current()
    holding = [r["test_run_id"] for r in partials.runs_with_description(read_partials(tables, run_ids, at), run_ids, name).collect()]  # at most the window
    if not holding:
        return None
    runs = _runs_of(tables, holding, at)
    rows = tables.read("observations", tables.hashes("runs", runs), at)
    return None if rows is None else rows.filter(F.col("name") == name).join(F.broadcast(runs), RUN).withColumn("id", _order())


# ------------------------------------------------------------------ the index of identities

#: Identities from which on they are indexed, and how often the number must grow for new centres.
INDEXED_FROM, REGROWN = 2000, 4
#: Vectors that centres are learned from, and the most of them.
SAMPLE, CELLS = 8000, 4096


def index_centres(tables: Tables, at: dict) -> np.ndarray | None:
    path = at["facts"].get("centres")
    if not path:
        return None
    return np.array([r["v"] for r in tables.spark.read.parquet(path).orderBy("cell").collect()])  # at most CELLS rows


def _by_index(tables: Tables, base: dict, centres: np.ndarray) -> Callable[[DataFrame, DataFrame, float], DataFrame]:
    """The search of ``nearest`` over the stored index: only files that may hold an asked cell are opened."""

    def find(texts: DataFrame, identities: DataFrame, similarity: float) -> DataFrame:
        whole = tables.read("cells", None, base).filter("not gone")
        bounds = nearest.cell_bounds(whole, len(centres))
        asked = nearest.asked_cells(texts, centres, similarity, bounds).select("repository_id", "cell")
        held = tables.read("cells", tables.hashes("cells", asked), base)
        return nearest.matches(texts, held.filter("not gone") if held is not None else whole.limit(0), centres, similarity, bounds)

    return find


def _moved_entries(fresh: DataFrame, centres: np.ndarray) -> DataFrame:
    """Index rows of identities that are new or whose vector moved: their new places, and their old ones as gone."""
    moved = fresh.filter(~F.col("embedding").eqNullSafe(F.col("_past.embedding")))
    new = nearest.entries(moved, centres).withColumn("gone", F.lit(False))
    old = nearest.entries(moved.select("repository_id", "id", F.col("_past.embedding").alias("embedding")), centres).withColumn("gone", F.lit(True))
    return new.unionByName(old.join(new.select("repository_id", "cell", "id"), ["repository_id", "cell", "id"], "left_anti").select(*new.columns))


def reindex(tables: Tables, least: int = INDEXED_FROM) -> bool:
    """Learn centres and index all identities, where there are ``least`` of them and REGROWN times as many as when that was last done."""

    def make(base: dict) -> Change | None:
        known, version = tables.read("identities", None, base), base["version"] + 1
        total = known.count() if known is not None else 0
        if total < least or total < REGROWN * base["facts"].get("indexed", 0):
            return None
        centres = clusters.cell_centres(known, min(CELLS, max(1, int(5 * total**0.5))), SAMPLE)
        path = f"{tables.root}/data/{version}-centres-{uuid.uuid4().hex}"
        tables.spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "cell int, v array<double>").coalesce(1).write.parquet(path)
        segment = tables.write("cells", _stamped(nearest.entries(known, centres).withColumn("gone", F.lit(False)), version), version)
        past = [s["path"] for s in base["segments"].get("cells", [])]
        return Change({"cells": segment}, {"cells": past}, set(), facts={"centres": path, "indexed": total}, alone=True)

    before = tables.current()["version"]
    return tables.commit(make)["version"] != before


def run_view(tables: Tables) -> DataFrame:
    """Runs with totals derived from their shards."""
    return tables.read("runs").join(ingest.derived_totals(tables.read("shards"), ("repository_id", "run_key")), ["repository_id", "run_key"], "left")


def start_ingest(
    spark: SparkSession, folder: str, root: str, checkpoint: str, embed: Embedder | None = None, max_bytes: int = MAX_BYTES, compact: bool = True, provider: str = "local", **trigger
) -> StreamingQuery:
    """Start the stream (by default over what is there now, then stop).

    After each batch runs beyond the kept ones expire, the runs that changed are added up again, and segments that are due are merged.
    """
    tables = Tables(spark, root)

    def take(batch: DataFrame, number: int) -> None:
        upsert_batch(tables, batch, number, embed, provider)
        if embed is not None:
            reindex(tables)
        expire_runs(tables)
        refresh_partials(tables)
        if compact:
            tables.compact()

    key, was = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.set(key, ARROW_BYTES)  # the stream keeps the settings that it starts with
    try:
        rows = read_deliveries(spark, folder, max_bytes=max_bytes)
        return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(take).start()
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def windowed_events(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "15 minutes") -> DataFrame:
    """Counts and seconds by event-time window and outcome, closed after ``late``."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", window, slide or window), "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_seconds").alias("seconds"))
