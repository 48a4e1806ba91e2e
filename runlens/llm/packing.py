"""Best-fit packing by exact-complement hashing over a histogram of lengths.

Pieces of at most ``capacity`` ids are packed into as few sequences as the method can. All planning happens on
the histogram of lengths, at most ``capacity`` counts whatever the corpus: for each length, longest first, the
plan looks up the gap it leaves among single lengths, then among sums of pairs, then of triples, and consumes a
combination as often as the counts still allow; what no combination fills exactly is placed by best fit,
longest first. Each step uses up a length or a class of sequences, so the plan has a few thousand steps.
Pieces find their places by rank within their length; ranks are counted in bounded blocks, so a length that a
third of all pieces share is spread over many tasks.

Cases: a null or empty text is the end id alone; an empty table gives no rows; rows that repeat a doc_id or a
text are packed each on their own; a null doc_id stays null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_batches, write_table
from .tokens import encoder, with_end
from .words import chunks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of a length that are ranked in one task.
RANK_BLOCK = 50_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the first takes what whole pieces leave over."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(batches, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(tokenizer)
    for batch in batches:
        keys = batch.column("doc_id").to_pylist()
        for i, _, data, offsets in chunks(batch.column("text")):
            ids, bounds = with_end(*enc.encode(data, offsets), end_id)
            ids = ids.astype("<u4")
            rows = []
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                for p, (start, size) in enumerate(cut(b - a, capacity)):
                    part = ids[a + start : a + start + size].tobytes()
                    rows.append((keys[i + k], p, start, size, zlib.crc32(part)) + ((part,) if with_ids else ()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, ``end_id`` added, into pieces; ``with_ids`` adds the ids (u32, little-endian) as ``ids``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(rows, keep_words=True).mapInArrow(lambda it: _pieces(it, tokenizer, capacity, end_id, with_ids), PIECES + (", ids binary" if with_ids else ""))


class Plan:
    """Steps (length, first rank, copies in a sequence, first sequence, sequences, offset) that place every rank of every length."""

    def __init__(self, counts: dict[int, int], capacity: int, depth: int = 3):
        self.capacity, self.depth = capacity, depth  # depth: 1 fills gaps with single lengths, 2 also pairs, 3 also triples
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.rank = np.zeros(capacity + 1, np.int64)
        self.steps: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.exact = self._fill_exactly()
        self._fit_best()

    def _place(self, length: int, copies: int, first: int, n: int, offset: int) -> None:
        self.steps.append((length, int(self.rank[length]), copies, first, n, offset))
        self.rank[length] += copies * n
        self.left[length] -= copies * n

    def _use(self, parts: list[int]) -> bool:
        """Take a combination as often as the counts allow."""
        need: dict[int, int] = {}
        for x in parts:
            need[x] = need.get(x, 0) + 1
        n = int(min(self.left[x] // k for x, k in need.items()))
        if n <= 0:
            return False
        at = 0
        for x, k in need.items():
            self._place(x, k, self.sequences, n, at)
            at += x * k
        self.sequences += n
        return True

    def _pairs(self, total: int, least: int = 1) -> np.ndarray:
        """The smaller parts a <= total - a of the available pairs with this sum, largest first."""
        a = np.arange(total // 2, least - 1, -1)
        return a[(self.left[a] > 0) & (self.left[total - a] > 0)]

    def _fill_exactly(self) -> int:
        for length in range(self.capacity, 0, -1):
            gap = self.capacity - length
            if not gap:
                while self.left[length] and self._use([length]):
                    pass
            elif self.left[length]:
                self._use([length, gap])
                for a in self._pairs(gap) if self.depth > 1 else ():
                    if not self.left[length]:
                        break
                    self._use([length, int(a), int(gap - a)])
                if self.depth > 2 and self.left[length]:
                    self._triples(length, gap)
        return self.sequences

    def _triples(self, length: int, gap: int) -> None:
        """Third parts c whose rest is an available pair sum, by the index of pair sums."""
        have = np.flatnonzero(self.left[: gap + 1] > 0)
        sums = np.zeros(gap + 1, bool)  # the index of pair sums
        for a in have:
            both = have[have <= gap - a] + a
            sums[both] = True
        for c in have[::-1]:
            if not self.left[length]:
                return
            if c < gap and sums[gap - c] and self.left[c]:
                for a in self._pairs(int(gap - c)):
                    if not (self.left[length] and self.left[c]):
                        break
                    self._use([length, int(c), int(a), int(gap - c - a)])

    def _fit_best(self) -> None:
        classes: dict[int, list[tuple[int, int]]] = {}  # free room -> runs (first sequence, sequences)
        room = np.zeros(self.capacity + 1, bool)

        def put(free: int, first: int, n: int) -> None:
            if free and n:
                classes.setdefault(free, []).append((first, n))
                room[free] = True

        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                fits = np.flatnonzero(room[length:])
                if len(fits):
                    free = int(fits[0]) + length
                    first, n = classes[free].pop()
                    if not classes[free]:
                        room[free] = False
                else:
                    free, first = self.capacity, self.sequences
                    n = max(int(self.left[length]) // (free // length), 1)
                    self.sequences += n
                copies = free // length
                have = int(self.left[length])
                if have >= copies:
                    m = min(n, have // copies)
                else:
                    copies, m = have, 1
                self._place(length, copies, first, m, self.capacity - free)
                put(free - copies * length, first, m)
                put(free, first + m, n - m)

    def arrays(self) -> np.ndarray:
        """The steps by (length, first rank), one column each."""
        return np.array(sorted(self.steps) or np.zeros((0, 6)), np.int64).reshape(-1, 6)


def best_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Exact combinations can spend short pieces that best fit would need later: of the three depths, the plan with fewest sequences."""
    return min((Plan(counts, capacity, depth) for depth in (3, 2, 1)), key=lambda p: p.sequences)


def _assign(batches, steps: np.ndarray, stride: int) -> Iterator[pa.RecordBatch]:
    lengths, ranks, copies, first, _, offset = steps.T
    order = lengths * stride + ranks
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        k = np.searchsorted(order, length * stride + rank, "right") - 1
        within = rank - ranks[k]
        batch = batch.drop_columns(["rank"])
        yield batch.append_column("sequence_id", pa.array(first[k] + within // copies[k])).append_column("offset", pa.array(offset[k] + within % copies[k] * length))


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``; all other columns stay.

    Only the histogram of lengths, at most ``capacity`` rows, reaches the driver; the plan that goes back is as small.
    """
    taken = {"uid", "block", "rank", "before", "in_block", "sequence_id", "offset"} & set(pieces.columns)
    if taken:
        raise ValueError(f"rename these columns first: {sorted(taken)}")
    held = write_table(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in held.groupBy("length").count().collect()}
    total = sum(counts.values())
    plan = best_plan(counts, capacity)
    blocks = max(1, -(-max(counts.values(), default=0) // RANK_BLOCK)) * 4
    rows = held.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    sizes = rows.groupBy("length", "block").agg(F.count("*").alias("in_block"))
    by_length = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "block", F.coalesce(F.sum("in_block").over(by_length), F.lit(0)).alias("before"))
    ranked = rows.withColumn("in_block", F.row_number().over(Window.partitionBy("length", "block").orderBy("uid")))
    ranked = ranked.join(sizes, ["length", "block"]).withColumn("rank", F.col("before") + F.col("in_block") - 1)
    ranked = ranked.select(*pieces.columns, F.col("rank").cast("long").alias("rank"))
    steps, stride = plan.arrays(), total + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return in_batches(ranked).mapInArrow(lambda it: _assign(it, steps, stride), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces_of(docs, tokenizer, capacity, end_id, with_ids), capacity)
