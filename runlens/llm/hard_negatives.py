"""Hard negatives by distributed radix selection over integer scores.

Vectors become integers, so a score (inner product) is an exact integer. For an anchor and one of its positives the
negatives wanted are the best ``k`` rows of other labels in a window of scores below the positive's. No list of
candidates is kept anywhere: each pass deals the window's range into BUCKETS parts, every task counts its own rows a
part, Spark adds the counts, and the part that holds the kth row becomes the next pass's range; once a range is a single
score, the vec_ids of the rows with that score are refined in the same way. At most ``k`` parts of a window leave a
task: what lies below a task's own kth row can't hold the kth of all. A last pass gathers the qualifying rows, at most
``k`` distinct ones a window. The anchors' positives are found by the same selection.

Anchors are taken in blocks of ANCHORS (a few MB, the only thing that tasks are sent): a block meets all rows, in
as many passes as digits are needed, and its result is appended to a table. So neither the driver nor a task holds more
than a block's windows, whatever the number of rows, copies or ties.

Cases: rows with a null vec_id, label or vector, or with a component that is null or not finite, take no part; shorter
vectors count as filled up with zeros, and an empty vector scores zero; rows that repeat a vec_id each take part,
as anchors too; equal scores are ordered by vec_id, and rows equal in both are alike and counted; an anchor without positives, and a
window without rows (as below a negative score), gives no rows; an empty table gives none; other columns are
ignored, whatever their names. Scores that might pass 2^56 are refused with a ValueError before any work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.primitives import numbered
from ..plans.storage import fresh_path
from .shared import in_batches, write_table

ANCHORS = 2048
BUCKETS = 512
#: Windows whose scores are compared at once, and codes of rows that are held before they are counted.
AT_ONCE, HELD = 256, 1 << 21
#: The largest score: 100 times it fits a long.
MOST = 1 << 56

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def finite(vector: Column) -> Column:
    """Whether no component is null, NaN or infinite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and the vector in integers, floor(scale * x), of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    large = float(MOST)  # beyond it a score is refused anyway
    return rows.withColumn("vector", F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(-large), F.least(F.lit(large), v * scale))))).drop("embedding")


@dataclass
class Windows:
    """What is known of each window: rows with scores above ``high`` up to ``top`` are in, those from ``low`` to ``high`` are in question."""

    anchor: np.ndarray  # its place in the block
    low: np.ndarray
    high: np.ndarray
    top: np.ndarray
    need: np.ndarray  # rows wanted of those in question
    by_id: np.ndarray  # low == high, and vec_ids from ``first`` to ``last`` are in question; smaller ones are in
    first: np.ndarray
    last: np.ndarray
    open: np.ndarray  # whether more rows may be in question than are wanted

    @classmethod
    def of(cls, anchor: list[int], low: list[int], high: list[int], k: int, ids: tuple[int, int]) -> Windows:
        n = len(anchor)
        column = lambda x: np.array(x, np.int64)
        one = lambda x: np.full(n, x, np.int64)
        return cls(column(anchor), column(low), column(high), column(high), one(k), np.zeros(n, bool), one(ids[0]), one(ids[1]), column(high) >= column(low))

    def take(self, which: np.ndarray) -> Windows:
        return Windows(*(getattr(self, f.name)[which] for f in fields(self)))

    def widths(self) -> np.ndarray:
        """Scores or vec_ids of a bucket; unsigned, as vec_ids may span all longs."""
        span = np.where(self.by_id, _apart(self.last, self.first), _apart(self.high, self.low))
        return span // np.uint64(BUCKETS) + np.uint64(1)

    def narrow(self, w: int, width: int, found: list[tuple[int, int, int]]) -> None:
        """Go to the bucket of the last row wanted; ``found``: (bucket, rows, rows before it), best first."""
        hit = next((x for x in found if x[2] + x[1] >= self.need[w]), None)
        if hit is None:  # fewer rows than wanted: all are in
            self.open[w] = False
            return
        bucket, n, before = hit
        self.need[w] -= before
        at, size = bucket * width, width - 1
        if self.by_id[w]:
            self.first[w], self.last[w] = int(self.first[w]) + at, min(int(self.last[w]), int(self.first[w]) + at + size)
        else:
            self.high[w], self.low[w] = int(self.high[w]) - at, max(int(self.low[w]), int(self.high[w]) - at - size)
        if n <= self.need[w] or (self.by_id[w] and self.first[w] == self.last[w]):
            self.open[w] = False
        elif self.low[w] == self.high[w]:
            self.by_id[w] = True


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b of longs with a >= b."""
    return a.view(np.uint64) - b.view(np.uint64)


@dataclass
class Block:
    """Anchors of one block."""

    vectors: np.ndarray
    labels: np.ndarray
    uids: np.ndarray
    exact: bool  # whether doubles hold every score


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of ``dims`` longs, filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _pairs(batches, block: Block, windows: Windows, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, scores, vec_ids, which is of the window's label sense) of some windows and rows, as matrices."""
    dims = block.vectors.shape[1]
    held = block.vectors.astype(np.float64) if block.exact else block.vectors
    for batch in batches:
        rows = matrix(batch.column("vector"), dims)
        scores = (held @ (rows.astype(np.float64) if block.exact else rows).T).astype(np.int64)
        ids, labels, uids = (batch.column(c).to_numpy() for c in ("vec_id", "label", "uid"))
        for lo in range(0, len(windows.anchor), AT_ONCE):
            which = np.arange(lo, min(lo + AT_ONCE, len(windows.anchor)))
            a = windows.anchor[which]
            fits = block.labels[a][:, None] == labels
            fits = fits & (block.uids[a][:, None] != uids) if same else ~fits
            yield which, scores[a], ids, fits


def _count(batches, handle, same: bool) -> Iterator[pa.RecordBatch]:
    """window, bucket, n: this task's rows a bucket, as far as they may hold a row wanted."""
    block, windows = handle.value
    widths, total, codes, held = windows.widths(), np.zeros(len(windows.anchor) * BUCKETS, np.int64), [], 0

    def flush() -> None:
        nonlocal held
        if codes:
            where, n = np.unique(np.concatenate(codes), return_counts=True)
            total[where] += n
            codes.clear()
            held = 0

    for which, s, ids, fits in _pairs(batches, block, windows, same):
        w, r = np.nonzero(fits & (s >= windows.low[which][:, None]) & (s <= windows.high[which][:, None]))
        at, got = which[w], ids[r]
        own = ~windows.by_id[at] | ((got >= windows.first[at]) & (got <= windows.last[at]))
        at, got, score = at[own], got[own], s[w[own], r[own]]
        step = np.where(windows.by_id[at], _apart(got, windows.first[at]), _apart(windows.high[at], score))
        codes.append(at * BUCKETS + (step // widths[at]).astype(np.int64))
        held += len(at)
        if held > HELD:
            flush()
    flush()
    table = total.reshape(-1, BUCKETS)
    before = np.cumsum(table, axis=1) - table
    w, b = np.nonzero((table > 0) & (before < windows.need[:, None]))
    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(b), pa.array(table[w, b])], ["window", "bucket", "n"])


def _gather(batches, handle, same: bool) -> Iterator[pa.RecordBatch]:
    """window, score, vec_id of the rows that are in."""
    block, windows = handle.value
    for which, s, ids, fits in _pairs(batches, block, windows, same):
        w, r = np.nonzero(fits & (s >= windows.low[which][:, None]) & (s <= windows.top[which][:, None]))
        at, got, score = which[w], ids[r], s[w, r]
        own = (score > windows.high[at]) | ~windows.by_id[at] | (got <= windows.last[at])
        yield pa.RecordBatch.from_arrays([pa.array(at[own]), pa.array(score[own]), pa.array(got[own])], ["window", "score", "vec_id"])


def select(rows: DataFrame, block: Block, windows: Windows, same: bool) -> DataFrame:
    """window, score, vec_id, n: the best rows of each window, found digit by digit; ``n`` rows are alike."""
    sc = rows.sparkSession.sparkContext
    while windows.open.any():
        still = np.flatnonzero(windows.open)
        asked = windows.take(still)
        handle = sc.broadcast((block, asked))
        counts = in_batches(rows).mapInArrow(lambda it, h=handle: _count(it, h, same), "window long, bucket long, n long")
        counts = counts.groupBy("window", "bucket").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("window").orderBy("bucket")) - F.col("n")
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r in counts.withColumn("before", before).filter(F.col("before") < int(asked.need.max())).collect():
            found.setdefault(r["window"], []).append((r["bucket"], r["n"], r["before"]))
        handle.destroy()
        widths = asked.widths()
        for k, w in enumerate(still.tolist()):
            windows.narrow(w, int(widths[k]), sorted(found.get(k, [])))
    handle = sc.broadcast((block, windows))
    got = in_batches(rows).mapInArrow(lambda it: _gather(it, handle, same), "window long, score long, vec_id long")
    return got.groupBy("window", "score", "vec_id").agg(F.count(F.lit(1)).alias("n"))


def _positives(found: DataFrame, positives: int) -> list[tuple[int, int, int]]:
    """(anchor's place, positive's vec_id, score) of a block, at most ``positives`` an anchor."""
    out, have = [], {}
    for r in sorted(found.collect(), key=lambda r: (r["window"], -r["score"], r["vec_id"])):
        a = r["window"]
        for _ in range(min(r["n"], positives - have.get(a, 0))):
            out.append((a, r["vec_id"], r["score"]))
            have[a] = have.get(a, 0) + 1
    return out


def mine(vectors: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, k: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """The best ``k`` rows of other labels for every anchor and each of its best ``positives`` rows of its own label.

    ``vectors``: vec_id, embedding, label; ``anchors``: a condition on vec_id and label. Wanted are scores from ``least``
    to ``most`` percent of the positive's. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    rows = write_table(quantised(vectors, scale).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    size = F.array_max(F.transform("vector", F.abs))
    seen = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.coalesce(F.max(size), F.lit(0)), F.min("vec_id"), F.max("vec_id")).first()
    empty = spark.createDataFrame([], RESULT)
    if not seen[0]:
        return empty
    dims, largest, ids = seen[1], seen[2], (seen[3], seen[4])
    if dims * largest**2 > MOST:
        raise ValueError(f"scores of vectors with components up to {largest} might pass {MOST}: choose a smaller scale")
    norm = math.isqrt(rows.agg(F.max(F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x * x))).first()[0]) + 1
    queries = write_table(numbered(rows.filter(anchors), ["vec_id", "uid"], "number"), "anchors")
    out = fresh_path(spark, "negatives")
    total, wrote = queries.count(), False
    for at in range(0, total, ANCHORS):
        own = queries.filter((F.col("number") > at) & (F.col("number") <= at + ANCHORS)).toArrow().sort_by("number").combine_chunks()
        held = matrix(own.column("vector").combine_chunks(), dims)
        block = Block(held, own.column("label").to_numpy(), own.column("uid").to_numpy(), dims * largest**2 < 1 << 53)
        reach = [math.isqrt(int(x)) * norm + norm for x in (held * held).sum(axis=1)]  # no score is larger
        found = _positives(select(rows, block, Windows.of(list(range(len(held))), [-x for x in reach], reach, positives, ids), True), positives)
        if not found:
            continue
        windows = Windows.of([f[0] for f in found], [-(-least * f[2] // 100) for f in found], [most * f[2] // 100 for f in found], k, ids)
        names = own.column("vec_id").to_pylist()
        about = spark.createDataFrame([(w, names[a], p, s) for w, (a, p, s) in enumerate(found)], "window long, anchor_id long, positive_id long, positive_score long")
        best = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
        ranked = select(rows, block, windows, False).withColumn("upto", F.sum("n").over(best)).withColumn("after", F.col("upto") - F.col("n"))
        ranked = ranked.filter(F.col("after") < k).withColumn("rank", F.explode(F.sequence((F.col("after") + 1).cast("int"), F.least("upto", F.lit(k)).cast("int"))))
        ranked = ranked.join(F.broadcast(about), "window")
        ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        wrote = True
    return spark.read.schema(RESULT).parquet(out) if wrote else empty


#: The same by comparing every anchor with every row: vectors and conditions as the query gives them.
ORACLE = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
    CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM good a JOIN good r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
