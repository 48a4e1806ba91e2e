"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens: its documents, ids by the tokenizer and an end id each, laid end to end. In each
window of ``window * capacity`` tokens every queue is credited its target share of the window and served the whole tokens
of its credit; the rest, its deficit, is carried to the next window. So a window holds each source's share to within one
token, whichever partitions the tokens lie in. Where a queue runs dry, the others share its credit by their own weights.
Documents are cut where a window's credit or a sequence ends, and nowhere else.

Targets are by default the sources' shares of all tokens, by which all queues end together. The windows, laid end to end,
are cut into sequences of ``capacity`` tokens; what is left after the last full one goes to sequences of falling
powers of two, so nothing is padded.

Nothing runs from window to window: what a queue was served up to a window is a formula of its total and its weight, and a
document's place in its queue is a prefix sum. A task tokenizes its part and keeps the running total of each source
in it; the totals by (source, part), a few rows a part, are added up by Spark; a second pass over the written
tokens cuts each document by the formula. Tokens are never shuffled. Queues are the QUEUES - 1 sources with most tokens,
and one queue of all other sources (in order of parts), so tasks are sent a table of QUEUES rows at most.

Cases: a null or empty text is the end id alone; a null source is a source; an empty table gives no rows; rows that
repeat a doc_id or a text are packed each on their own; a null doc_id stays null; named targets of zero or below, and sources
without one where targets are given, are served after all others; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_batches, write_table
from .tokens import encoder, with_end
from .words import chunks

QUEUES = 4096
#: Rows of (source, part) totals that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
#: A piece: tokens ``start`` to ``start + length`` of its document, at ``offset`` of a sequence, served in ``window``.
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long"


def _tokens(batches, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Each document's ids, with its part and the tokens of its source that lie before it there."""
    enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), {}
    for batch in batches:
        keys, sources = batch.column("doc_id"), batch.column("source")
        for i, j, data, offsets in chunks(batch.column("text")):
            ids, bounds = with_end(*enc.encode(data, offsets), end_id)
            sizes, own = np.diff(bounds), sources.slice(i, j - i)
            first = []
            for source, n in zip(own.to_pylist(), sizes.tolist(), strict=True):
                first.append(before.get(source, 0))
                before[source] = first[-1] + n
            cut = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [keys.slice(i, j - i), own, pa.array([part] * len(cut), pa.int64()), pa.array(first, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cut, pa.binary())],
                ["doc_id", "source", "part", "before", "n", "ids"],
            )


class Schedule:
    """What each queue was served up to any window.

    Time runs so that a queue of weight w is served w tokens a unit until it is dry; a window ends when ``size`` tokens
    more were served in all. Queues without weight come after the others, all at one pace.
    """

    def __init__(self, totals: list[int], weights: list[float], size: int):
        self.totals, self.size = np.array(totals, np.int64), size
        self.total = int(self.totals.sum())
        self.windows = -(-self.total // size)
        weight = np.array(weights, np.float64)
        self.named = weight > 0
        self.phases = [self._phase(self.named, weight), self._phase(~self.named, np.ones(len(totals)))]
        self.first = int(self.totals[self.named].sum())
        self.at = lru_cache(maxsize=256)(self._at)

    def _phase(self, own: np.ndarray, weight: np.ndarray):
        """Queues in the order in which they run dry: their ends, and the tokens served in all by then."""
        which = np.flatnonzero(own & (self.totals > 0))
        if not len(which):
            return which, weight[:0], weight[:0], weight[:0], weight[:0]
        w = weight[which] / weight[which].max()
        end = self.totals[which] / w
        order = np.argsort(end, kind="stable")
        which, w, end = which[order], w[order], end[order]
        rest = np.cumsum(w[::-1])[::-1]  # the weight of the queues that are not dry before each end
        served = np.cumsum(rest * np.diff(end, prepend=0.0))
        return which, w, end, rest, served

    def _at(self, k: int) -> np.ndarray:
        """Tokens served of each queue before window k."""
        out, goal = np.zeros(len(self.totals), np.int64), min(k * self.size, self.total)
        if goal >= self.total:
            return self.totals
        for (which, w, end, rest, served), lo in zip(self.phases, (0, self.first), strict=True):
            left = goal - lo
            if not len(which) or left <= 0:
                continue
            i = int(np.searchsorted(served, left))
            if i == len(which) or left >= int(self.totals[which].sum()):
                out[which] = self.totals[which]
                continue
            time = end[i] - (served[i] - left) / rest[i]
            out[which] = np.where(end <= time, self.totals[which], np.minimum(np.floor(w * max(time, 0.0)).astype(np.int64), self.totals[which]))
        return out

    def window_of(self, queue: int, place: int) -> int:
        """The window in which a queue's token is served."""
        lo, hi = 0, max(self.windows - 1, 0)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.at(mid + 1)[queue] > place:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def runs(self, queue: int, place: int, n: int, window: int | None = None) -> Iterator[tuple[int, int, int]]:
        """(window, tokens, place among all tokens) of ``n`` tokens of a queue from ``place`` on; ``window``: a first guess."""
        k = self.window_of(queue, place) if window is None or not self.at(window)[queue] <= place < self.at(window + 1)[queue] else window
        while n:
            now, then = self.at(k), self.at(k + 1)
            take = min(int(then[queue]) - place, n)
            if take > 0:
                yield k, take, int(now.sum() + (then - now)[:queue].sum()) + place - int(now[queue])
                place, n = place + take, n - take
            k += 1


def bounds(total: int, capacity: int) -> list[int]:
    """Where sequences begin after the last full one: at falling powers of two of the rest; ``total`` ends the list."""
    at, out = total - total % capacity, []
    for bit in range(capacity.bit_length(), -1, -1):
        if (total % capacity) >> bit & 1:
            out.append(at)
            at += 1 << bit
    return [*out, total]


def _cut(batches, schedule: Schedule, capacity: int, width: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    full, ends = schedule.total // capacity, bounds(schedule.total, capacity)
    guess: dict[int, int] = {}
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64()] * 8 + [pa.binary()] * with_ids
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "queue", "place", "n", "ids"))
        rows: list[tuple] = []
        for doc_id, queue, place, n, ids in zip(*columns, strict=True):
            start, wide = 0, np.frombuffer(ids, f"<u{width}").astype("<u4")
            for window, size, at in schedule.runs(queue, place, n, guess.get(queue)):
                guess[queue] = window
                while size:
                    if at < full * capacity:
                        sequence, offset = divmod(at, capacity)
                        room = capacity - offset
                    else:
                        tail = int(np.searchsorted(ends, at, "right")) - 1
                        sequence, offset, room = full + tail, at - ends[tail], ends[tail + 1] - at
                    take = min(room, size)
                    part = wide[start : start + take].tobytes()
                    rows.append((doc_id, start, take, zlib.crc32(part), n, sequence, offset, window) + (part,) * with_ids)
                    start, at, size = start + take, at + take, size - take
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _prefix(totals: DataFrame) -> DataFrame:
    """``place`` of each (queue, part, source): the queue's tokens before it; by parts first, then within a part."""
    parts = totals.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")
    within = F.sum("n").over(Window.partitionBy("queue", "part").orderBy("source")) - F.col("n")
    return totals.withColumn("within", within).join(parts.select("queue", "part", before.alias("earlier")), ["queue", "part"]).select("source", "part", "queue", (F.col("earlier") + F.col("within")).alias("base"))


def mix_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, window: int = 64, targets: Mapping[str | None, float] | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text, source) by sources: the columns of PIECES; ``with_ids`` adds the ids (u32, little-endian) as ``ids``.

    ``window``: sequences of a window. ``targets``: the sources' weights, by default their tokens.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    held = write_table(in_batches(rows, keep_words=True).mapInArrow(lambda it: _tokens(it, tokenizer, end_id), "doc_id long, source string, part long, before long, n long, ids binary"), "tokens")
    totals = write_table(held.groupBy("source", "part").agg(F.sum("n").alias("n")), "totals")
    by_source = totals.groupBy("source").agg(F.sum("n").alias("n"))
    if targets is None:
        by_source = by_source.withColumn("weight", F.col("n").cast("double"))
    else:
        if len(targets) >= QUEUES:
            raise ValueError(f"at most {QUEUES - 1} sources can have a target")
        named = spark.createDataFrame([(k, max(0.0, float(v))) for k, v in targets.items()], "name string, weight double")
        by_source = by_source.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    top = by_source.orderBy((F.col("weight") > 0).desc(), F.desc("n"), "source").limit(QUEUES - 1).collect()
    total = by_source.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], PIECES + (", ids binary" if with_ids else ""))
    sizes, weights = [r["n"] for r in top], [r["weight"] for r in top]
    queues = spark.createDataFrame([(r["source"], i) for i, r in enumerate(top)], "name string, queue int")
    if total > sum(sizes):  # all other sources are one queue
        sizes.append(total - sum(sizes))
        weights.append(float(sizes[-1]) if targets is None else 0.0)
    numbered = totals.join(F.broadcast(queues), F.col("source").eqNullSafe(F.col("name")), "left").select("source", "part", "n", F.coalesce("queue", F.lit(len(top))).alias("queue"))
    places = write_table(_prefix(numbered).withColumnsRenamed({"source": "name", "part": "piece"}), "places")
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    ready = held.join(places, F.col("source").eqNullSafe(F.col("name")) & (F.col("part") == F.col("piece"))).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("place"), "n", "ids")
    handle = spark.sparkContext.broadcast((sizes, weights))
    width, size = encoder(tokenizer).width, capacity * window

    def run(batches):
        return _cut(batches, Schedule(*handle.value, size), capacity, width, with_ids)

    return in_batches(ready).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))
