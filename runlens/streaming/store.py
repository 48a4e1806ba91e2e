"""Tables that are merged when they are read: a writer adds what is new and rewrites nothing.

A table is a list of segments, oldest first. A batch adds one segment a table with its own rows only, sorted by the hash of
their run (or repository); rows of a later segment take the place of those with the same key in earlier ones. An example
row names the version that delivered it, a shard's row the version that last replaced the shard: older examples of
that shard are dead, so the shard's row is the tombstone of all of them. Reading merges segments by key (``MERGES``).
Every segment lists its files with their least and greatest hash, so a read for some runs opens the files that may hold them.

Every segment also names the version that it appeared in, so what is derived from a table (the partial aggregates of
runs) follows it by looking at the segments that came since. Segments of like size are merged into one by ``compact``, a step of its own: a row is rewritten about once each time that the table
grows by FANOUT. Dead and superseded rows are dropped there.

A version file names all segments and becomes current by one rename, so readers see all of a change or nothing of it.
Writers don't wait for each other: who finds the version made by another writer looks whether that one changed runs that
it has read, publishes its segments over the new version if not, and starts again if so.
"""

from __future__ import annotations

import json
import math
import threading
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..operators.partials import WITHIN
from ..plans.primitives import keep_newest, latest_per_key
from ..plans.storage import delete, file_system

FANOUT = 4
#: Segments up to this size count as one tier; files of merged segments are about FILE_BYTES long.
LEAST_BYTES, FILE_BYTES = 1 << 20, 128 << 20
#: Runs whose hashes are sent to a read; of more, all files are opened and the rows met by a join.
HASHES = 4096
ATTEMPTS = 20

#: What each table is sorted and pruned by, and the key of its rows.
KEYS = {"runs": ["repository_id", "run_key"], "shards": ["repository_id", "run_key"], "observations": ["repository_id", "run_key"], "rejections": ["repository_id"], "identities": ["repository_id"], "cache": ["text_digest"], "cells": ["repository_id", "cell"], "expired": ["repository_id", "run_key"], **{name: ["repository_id", "run_key"] for name in WITHIN}}
NAMES = tuple(KEYS)
#: Columns that the store adds: the versions that delivered a row and last changed it, the key of an example, the hash.
OWN = ["_delivered", "_changed", "_row", "_hash"]
_local = defaultdict(threading.Lock)  # writers of one process


def key_hash(name: str) -> Column:
    return F.xxhash64(*KEYS[name])


def row_key() -> Column:
    """An example's id within its run; a row without one is itself."""
    own = F.concat_ws("\u0000", "shard_key", F.col("delivery_seq").cast("string"), F.col("position").cast("string"))
    return F.when(F.col("example_id").isNotNull(), F.concat(F.lit("="), F.col("example_id"))).otherwise(F.concat(F.lit("#"), own))


def merge_runs(rows: DataFrame) -> DataFrame:
    """The first delivery of a run made it."""
    return latest_per_key(rows, KEYS["runs"], ["delivery_seq"], newest=False)


def merge_shards(rows: DataFrame) -> DataFrame:
    """The last delivery of a shard says what it is; its newest version is kept, as it buries older examples."""
    rest = [c for c in rows.columns if c not in ingest.SHARD_KEYS]
    found = rows.groupBy(*ingest.SHARD_KEYS).agg(F.max_by(F.struct(*rest), F.struct("delivery_seq", "_delivered")).alias("row"), F.max("_delivered").alias("_newest"))
    return found.select(*ingest.SHARD_KEYS, *(F.col("_newest" if c == "_delivered" else f"row.{c}").alias(c) for c in rest)).select(*rows.columns)


def merge_expired(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS["expired"]).agg(F.max("_delivered").alias("_delivered"), F.max("_changed").alias("_changed"), F.first("_hash").alias("_hash")).select(*rows.columns)


def merge_examples(rows: DataFrame, shards: DataFrame, expired: DataFrame | None = None) -> DataFrame:
    """The newest row of each example, unless its shard was replaced or its run expired since."""
    if expired is not None:
        over = expired.select(*KEYS["expired"], F.col("_delivered").alias("_over"))
        rows = rows.join(over, KEYS["expired"], "left").filter(F.coalesce(F.col("_delivered") > F.col("_over"), F.lit(True))).select(*rows.columns)
    newest = latest_per_key(rows, [*KEYS["observations"], "_row"], ["_delivered", "_changed"])
    buried = shards.select(*ingest.SHARD_KEYS, F.col("_delivered").alias("_replaced"))
    return newest.join(buried, ingest.SHARD_KEYS, "left").filter(F.coalesce(F.col("_delivered") >= F.col("_replaced"), F.lit(True))).select(*rows.columns)


def merge_rejections(rows: DataFrame) -> DataFrame:
    return keep_newest(rows.dropDuplicates(["id"]), ["repository_id"], [F.desc("occurred_at"), F.desc("id")], ingest.REJECTIONS_KEPT)


def merge_identities(rows: DataFrame) -> DataFrame:
    return latest_per_key(rows, ["id"], ["_delivered", "_changed"])


def merge_cache(rows: DataFrame) -> DataFrame:
    return latest_per_key(rows, ["provider_fingerprint", "text_digest"], ["_delivered", "_changed"])


def merge_cells(rows: DataFrame) -> DataFrame:
    """The newest entry of an identity in a cell; one that is ``gone`` stays, as older segments may hold what it took away."""
    return latest_per_key(rows, ["repository_id", "cell", "id"], ["_delivered", "_changed"])


def merge_facts(rows: DataFrame) -> DataFrame:
    """A run's totals as last added up; the version that did buries all that earlier ones added up of the run."""
    return latest_per_key(rows, KEYS["run_facts"], ["_delivered"])


def merge_partials(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """What was added up of a run together with its totals."""
    return rows.join(facts.select(*KEYS["run_facts"], "_delivered"), [*KEYS["run_facts"], "_delivered"], "left_semi").select(*rows.columns)


MERGES: dict[str, Callable[..., DataFrame]] = {"runs": merge_runs, "shards": merge_shards, "observations": merge_examples, "rejections": merge_rejections, "identities": merge_identities, "cache": merge_cache, "cells": merge_cells, "expired": merge_expired, "run_facts": merge_facts}


def _listing(path: str) -> str:
    """Where a segment's files are listed, with the rows and hashes of each."""
    return f"{path}.files"


@dataclass
class Change:
    """Segments to add, or to put in place of others; ``runs``: hashes of what was read to make it (None: of everything)."""

    added: dict[str, dict | None] = field(default_factory=dict)
    replaced: dict[str, list[str]] = field(default_factory=dict)
    runs: set[int] | None = None
    tops: dict[str, int] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)
    alone: bool = False  # whether any other change since makes this one void
    batch: int | None = None
    fingerprint: str | None = None


class Tables:
    """runs, shards, observations, rejections, identities, their index of cells, the embedding cache, the list of expired runs and the partial aggregates of runs under ``root``."""

    NAMES = NAMES

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout

    # ------------------------------------------------------------------ versions

    def _text(self, path: str) -> str:
        return self.spark.read.option("wholetext", "true").text(path).first()[0]

    def numbers(self) -> list[int]:
        fs, p = file_system(self.spark, f"{self.root}/_versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def current(self) -> dict:
        """The newest version: its number, the last batch and its fingerprint, segments by table, and the highest ids given."""
        found = self.numbers()
        if not found:
            return {"version": 0, "batch": None, "fingerprint": None, "segments": {}, "tops": {}, "facts": {}}
        return json.loads(self._text(f"{self.root}/_versions/{found[-1]}"))

    def _publish(self, made: dict) -> bool:
        """Whether the version file appeared, by one rename and never in place of another's."""
        fs, temp = file_system(self.spark, f"{self.root}/_versions/.{uuid.uuid4().hex}")
        _, final = file_system(self.spark, f"{self.root}/_versions/{made['version']}")
        out = fs.create(temp, True)
        try:
            out.write(bytearray(json.dumps(made).encode()))
        finally:
            out.close()
        with _local[self.root]:  # a local file system renames over files that are there
            if not fs.exists(final) and fs.rename(temp, final):
                return True
        fs.delete(temp, False)
        return False

    def _drop_unused(self, made: dict) -> None:
        """Delete what only versions before the last one used; readers of the last one may still be at work."""
        past = [n for n in self.numbers() if n < made["version"] - 1]
        if not past:
            return
        kept = [made, *(json.loads(self._text(f"{self.root}/_versions/{made['version'] - 1}")) for _ in range(made["version"] - 1 in self.numbers()))]
        used = {s["path"] for v in kept for own in v["segments"].values() for s in own} | {v["facts"].get("centres") for v in kept}
        for n in past:
            old = json.loads(self._text(f"{self.root}/_versions/{n}"))
            for path in ({s["path"] for own in old["segments"].values() for s in own} | ({old["facts"].get("centres")} - {None})) - used:
                self._delete(path)
            delete(self.spark, f"{self.root}/_versions/{n}")

    def commit(self, make: Callable[[dict], Change | None]) -> dict:
        """Make a change of the newest version current; ``make`` is asked again where another writer changed what it read."""
        for _ in range(ATTEMPTS):
            base = self.current()
            change = make(base)
            if change is None:
                return base
            while True:
                made = self._over(base, change)
                if self._publish(made):
                    self._drop_unused(made)
                    return made
                now = self.current()
                if self._clash(base, now, change):
                    for segment in filter(None, change.added.values()):
                        self._delete(segment["path"])
                    break
                base = now
        raise RuntimeError(f"{self.root}: other writers were first {ATTEMPTS} times")

    def _over(self, base: dict, change: Change) -> dict:
        segments = {name: list(own) for name, own in base["segments"].items()}
        for name, segment in change.added.items():
            past = [s.get("at", 0) for s in base["segments"].get(name, []) if s["path"] in change.replaced.get(name, [])]
            segment = segment and segment | {"at": max(past, default=base["version"] + 1)}
            gone, own = change.replaced.get(name, []), segments.get(name, [])
            at = next((i for i, s in enumerate(own) if s["path"] in gone), len(own))
            segments[name] = [*own[:at], *([segment] if segment else []), *(s for s in own[at:] if s["path"] not in gone)]
        mark = (change.batch, change.fingerprint) if change.batch is not None else (base["batch"], base["fingerprint"])
        tops = base["tops"] | {k: max(v, base["tops"].get(k, 0)) for k, v in change.tops.items()}
        return {"version": base["version"] + 1, "batch": mark[0], "fingerprint": mark[1], "segments": segments, "tops": tops, "facts": base["facts"] | change.facts}

    def _clash(self, base: dict, now: dict, change: Change) -> bool:
        """Whether versions after ``base`` changed what the change was made from, or took what it replaces."""
        for name, paths in change.replaced.items():
            if not set(paths) <= {s["path"] for s in now["segments"].get(name, [])}:
                return True
        moved = {k for k in now["facts"] | base["facts"] if now["facts"].get(k) != base["facts"].get(k)}
        if change.alone or ("windows" in moved and "windows" in change.facts) or (moved - {"windows"} and "cells" in change.added):
            return True
        if change.replaced:  # a merged segment stands for the same rows
            return False
        if any(now["tops"].get(k, 0) != base["tops"].get(k, 0) for k in change.tops):
            return True
        for name in ("runs", "shards", "observations"):
            known = {s["path"] for s in base["segments"].get(name, [])}
            for segment in now["segments"].get(name, []):
                if segment["path"] not in known and not segment.get("merged"):
                    if change.runs is None or self._files(segment, change.runs):
                        return True
        return False

    # ------------------------------------------------------------------ segments

    def _delete(self, path: str) -> None:
        delete(self.spark, path)
        delete(self.spark, _listing(path))

    def write(self, name: str, df: DataFrame, version: int, files: int | None = None) -> dict | None:
        """A segment of ``df``; None if that is empty."""
        path = f"{self.root}/data/{version}-{uuid.uuid4().hex}/{name}"
        rows = df.withColumn("_hash", key_hash(name))
        order = ["_hash", *(["_row"] if "_row" in df.columns else [])]
        rows = rows.repartitionByRange(files, *order) if files else rows.hint("rebalance")
        rows.sortWithinPartitions(*order).write.parquet(path)
        fs, p = file_system(self.spark, path)
        listed = {s.getPath().getName(): s.getLen() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")}
        if not listed:
            return None
        bounds = self.spark.read.parquet(path).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
        found = [[r["file"], r["lo"], r["hi"], r["n"]] for r in bounds.agg(F.min("_hash").alias("lo"), F.max("_hash").alias("hi"), F.count(F.lit(1)).alias("n")).collect()]
        if not found:
            self._delete(path)
            return None
        out = fs.create(file_system(self.spark, _listing(path))[1], True)
        try:
            out.write(bytearray(json.dumps(found).encode()))
        finally:
            out.close()
        return {"path": path, "bytes": sum(listed.values()), "rows": sum(f[3] for f in found)}

    def _files(self, segment: dict, hashes: Iterable[int]) -> list[str]:
        """The files of a segment that may hold rows of these hashes."""
        wanted, out = sorted(hashes), []
        for name, lo, hi, _ in json.loads(self._text(_listing(segment["path"]))):
            at = bisect_left(wanted, lo)
            if at < len(wanted) and wanted[at] <= hi:
                out.append(f"{segment['path']}/{name}")
        return out

    def raw(self, name: str, at: dict | None = None, hashes: set[int] | None = None, paths: list[str] | None = None) -> DataFrame | None:
        """The rows of a table's segments, not merged: of some segments, or of the files that may hold some hashes, where asked."""
        segments = [s for s in (at or self.current())["segments"].get(name, []) if paths is None or s["path"] in paths]
        files = [s["path"] for s in segments] if hashes is None else [f for s in segments for f in self._files(s, hashes)]
        if not files:
            return None
        rows = self.spark.read.parquet(*files)
        return rows if hashes is None else rows.filter(F.col("_hash").isin(sorted(hashes)))

    def merged(self, name: str, at: dict | None = None, hashes: set[int] | None = None, paths: list[str] | None = None) -> DataFrame | None:
        """A table's rows with the store's own columns; None if there are no files."""
        at = at or self.current()
        rows = self.raw(name, at, hashes, paths)
        if rows is None:
            return None
        if name == "observations":
            expired = self.raw("expired", at, hashes)
            return merge_examples(rows, merge_shards(self.raw("shards", at, hashes)), expired and merge_expired(expired))
        if name in WITHIN and name not in MERGES:
            return merge_partials(rows, merge_facts(self.raw("run_facts", at, hashes)))
        return MERGES[name](rows)

    def read(self, name: str, hashes: set[int] | None = None, at: dict | None = None) -> DataFrame | None:
        """A table as of the newest version, or of ``at``; of the runs (or repositories) with these hashes only, where given."""
        found = self.merged(name, at, hashes)
        return found.drop(*OWN) if found is not None else None

    def hashes(self, name: str, rows: DataFrame) -> set[int] | None:
        """The hashes of the keys in ``rows``; None if there are more than HASHES."""
        found = rows.select(key_hash(name).alias("h")).distinct().limit(HASHES + 1).collect()
        return {r["h"] for r in found} if len(found) <= HASHES else None

    # ------------------------------------------------------------------ compaction

    def _tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / LEAST_BYTES, self.fanout)))

    def due(self, segments: list[dict]) -> list[dict]:
        """The first neighbours, at least FANOUT of one tier or less, that should be one segment; the lowest tier first."""
        tiers = [self._tier(s["bytes"]) for s in segments]
        for tier in sorted(set(tiers)):
            group: list[dict] = []
            for s, t in zip(segments, tiers, strict=True):
                if t <= tier:
                    group.append(s)
                elif len(group) >= self.fanout:
                    break
                else:
                    group = []
            if len(group) >= self.fanout:
                return group
        return []

    def merge(self, name: str) -> bool:
        """Merge one group of a table's segments, if one is due."""
        found = []

        def make(base: dict) -> Change | None:
            group = self.due(base["segments"].get(name, []))
            found[:] = group
            if not group:
                return None
            paths, size = [s["path"] for s in group], sum(s["bytes"] for s in group)
            rows = self.merged(name, base, paths=paths).drop("_hash")
            segment = self.write(name, rows, base["version"] + 1, max(1, math.ceil(size / FILE_BYTES)))
            return Change({name: segment and segment | {"merged": True}}, {name: paths}, set())

        self.commit(make)
        return bool(found)

    def compact(self, names: Iterable[str] = NAMES) -> int:
        """Merge segments of like size until none are due; gives the number of merges. Writers go on meanwhile."""
        return sum(1 for name in names for _ in iter(lambda n=name: self.merge(n), False))
