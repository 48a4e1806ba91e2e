"""Benchmark decontamination by Wu-Manber search over words.

A window is 10 consecutive words of a benchmark item; an item of fewer words, but not none, is one window. The
windows of one width form one search. Its shift table, over blocks of two words, says how far the end of a window
can move when the block there ends: a block that no window contains lets it jump nearly a whole window. Where the
shift is zero, the bucket of windows that end in this block gives the test strings, and those whose hash agrees
are compared word by word. Texts are searched many at a time, each in stretches of STRETCH window ends.

The benchmark is broadcast, so its size is checked: up to BLOCK_BYTES of text (some three million windows, about
40 bytes each) it is one search, whose tables a worker builds once for all its tasks. Beyond that it is searched in
blocks of about that size, one pass over the documents each, the hits of earlier passes carried along in a written table.

Cases: null or wordless texts and items have no windows (counts 0, the digest of no items); repeated items or
equal windows of several items count for each item id once; an item id may be of any type and is taken as a
string (null as empty); rows that repeat a doc_id each get their row; an empty table gives no rows, an empty
benchmark no hits; other columns are ignored, whatever their names. Whole texts are searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, write_table
from .words import U, Words, alnum_words, chunks, mix

WINDOW = 10
STRETCH = 512
BLOCK_BYTES = 16 << 20

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items string"
Item = tuple[str, str]


class Search:
    """The Wu-Manber tables of windows of one width: the word hashes of each, one a row."""

    def __init__(self, width: int, hashes: np.ndarray):
        self.width, self.block = width, min(2, width)
        bits = max(10, int(len(hashes) * width * 8).bit_length())
        self.mask = U((1 << min(bits, 24)) - 1)
        self.shift = np.full(int(self.mask) + 1, min(width - self.block + 1, 255), np.uint8)
        for q in range(self.block, width + 1):
            blocks = self._blocks(hashes, np.full(len(hashes), q - 1))
            np.minimum.at(self.shift, (blocks & self.mask).astype(np.int64), np.uint8(min(width - q, 255)))
        order = np.argsort(blocks, kind="stable")  # buckets of windows by the block they end in
        self.suffix, self.number = blocks[order], order.astype(np.int32)
        self.whole = _rolled(hashes, np.full(len(hashes), width - 1), width)[order]

    def _blocks(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hash of the block that ends at word ``at`` (of each row, if hashes has rows)."""
        rows = (np.arange(len(at)),) if hashes.ndim > 1 else ()
        last = hashes[(*rows, at)]
        return last if self.block == 1 else mix(hashes[(*rows, at - 1)] * U(3) + last)

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Window ends with shift zero."""
        begin, stop = first[:-1] + self.width - 1, first[1:]
        n = np.maximum(-(-(stop - begin) // STRETCH), 0)
        lane = np.repeat(np.arange(len(n)), n)
        at = begin[lane] + (np.arange(len(lane)) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        limit = np.minimum(at + STRETCH, stop[lane])
        out = []
        while len(at):
            step = self.shift[(self._blocks(hashes, at) & self.mask).astype(np.int64)]
            zero = step == 0
            out.append(at[zero])
            at = at + np.maximum(step, 1)
            go = at < limit
            at, limit = at[go], limit[go]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def matches(self, words: Words, hashes: np.ndarray, text_of: Callable[[int], bytes]) -> Iterator[tuple[int, int]]:
        """(last word, window number) of every occurrence; ``text_of`` a window is compared."""
        ends = self.candidates(hashes, words.first)
        if not len(ends):
            return
        blocks, whole = self._blocks(hashes, ends), _rolled(hashes, ends, self.width)
        place, over = np.searchsorted(self.suffix, blocks), np.searchsorted(self.suffix, blocks, "right")
        while len(place):  # the next test string of each bucket
            go = place < over
            ends, whole, place, over = ends[go], whole[go], place[go], over[go]
            same = self.whole[place] == whole
            for e, k in zip(ends[same].tolist(), self.number[place[same]].tolist(), strict=True):
                if words.text(e - self.width + 1, e + 1) == text_of(k):
                    yield e, k
            place = place + 1


def _rolled(hashes: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(ends), U)
    rows = (np.arange(len(ends)),) if hashes.ndim > 1 else ()
    for k in range(width):
        out = mix(out * U(3) + hashes[(*rows, ends - width + 1 + k)])
    return out


class Benchmark:
    """The searches of a block of items, by window width, and whose windows they are."""

    def __init__(self, items: list[Item]):
        self.ids = [i for i, _ in items]
        raw = [t.encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        self.words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets, alnum_words())
        hashes, counts, first = self.words.hashes(), self.words.counts(), self.words.first
        exact: dict[bytes, int] = {}  # equal words have equal numbers
        numbers = np.array([exact.setdefault(self.words.text(k, k + 1), len(exact)) for k in range(len(self.words))], np.int32)
        self.searches = []
        for width in np.unique(np.minimum(counts, WINDOW)).tolist():
            if not width:
                continue
            own = np.flatnonzero(np.minimum(counts, WINDOW) == width)
            n = counts[own] - width + 1
            begin = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item = np.repeat(own, n)
            _, lead, group = np.unique(np.lib.stride_tricks.sliding_window_view(numbers, width)[begin], axis=0, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([group.ravel(), item], axis=1), axis=0)
            owners = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(lead) + 1))
            search = Search(width, np.lib.stride_tricks.sliding_window_view(hashes, width)[begin[lead]])
            self.searches.append((search, begin[lead], owners))

    def find(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """The mask of hit words and the ids of found items of each text."""
        hit = np.zeros(len(words) + 1, np.int32)
        found: list[set[str]] = [set() for _ in range(len(words.first) - 1)]
        hashes = words.hashes()
        for search, begin, (item, bounds) in self.searches:
            seen = set()
            for end, k in search.matches(words, hashes, lambda k, begin=begin, width=search.width: self.words.text(begin[k], begin[k] + width)):
                hit[end - search.width + 1] += 1
                hit[end + 1] -= 1
                text = int(np.searchsorted(words.first, end, "right")) - 1
                if (text, k) not in seen:
                    seen.add((text, k))
                    found[text].update(self.ids[i] for i in item[bounds[k] : bounds[k + 1]].tolist())
        return np.cumsum(hit[:-1]) > 0, found


_held: tuple[list[Item], Benchmark] | None = None


def _tables(items: list[Item]) -> Benchmark:
    """The tables of a broadcast block, kept by the worker for its next tasks."""
    global _held
    if _held is None or _held[0] is not items:
        _held = (items, Benchmark(items))
    return _held[1]


def _scan(batches, handle, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    bench = _tables(handle.value)
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column("text")):
            words = Words(data, offsets, alnum_words())
            hit, found = bench.find(words)
            part = batch.slice(i, j - i)
            if not first:
                for k, (bits, items) in enumerate(zip(part.column("hits").to_pylist(), part.column("found").to_pylist(), strict=True)):
                    a, b = words.first[k : k + 2]
                    hit[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
                    found[k].update(items)
            yield _result(part, words, hit, found) if last else _state(part, words, hit, found)


def _state(part: pa.RecordBatch, words: Words, hit: np.ndarray, found: list[set[str]]) -> pa.RecordBatch:
    bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    columns = [part.column("doc_id"), part.column("text"), pa.array(bits, pa.binary()), pa.array(map(sorted, found), pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "hits", "found"])


def _result(part: pa.RecordBatch, words: Words, hit: np.ndarray, found: list[set[str]]) -> pa.RecordBatch:
    upto = np.concatenate([[0], np.cumsum(hit)])
    n_hit = upto[words.first[1:]] - upto[words.first[:-1]]
    items = [",".join(sorted(f)) for f in found]
    columns = [
        part.column("doc_id").cast(pa.int64()),
        pa.array(words.counts().astype(np.int64)),
        pa.array(n_hit.astype(np.int64)),
        pa.array([len(f) for f in found], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in items], pa.string()),
        pa.array(n_hit > 0),
        pa.array(items, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[Item]]:
    """The items (item_id, text) in blocks of about ``block_bytes`` of text, one block at a time on the driver."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted((r["item_id"], r["text"]) for r in part.collect())


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items (ids, comma-joined) of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    for k, (items, last) in enumerate(_peek(blocks_of(benchmark, block_bytes))):
        handle = spark.sparkContext.broadcast(items)
        first = k == 0
        rows = in_batches(rows).mapInArrow(lambda it, h=handle, f=first, z=last: _scan(it, h, f, z), RESULT if last else f"doc_id {kind}, text string, hits binary, found array<string>")
        if not last:
            rows = write_table(rows, "decontamination")
    return rows


def _peek(blocks: Iterator[list[Item]]) -> Iterator[tuple[list[Item], bool]]:
    """Each block, and whether it is the last."""
    held = next(blocks)
    for block in blocks:
        yield held, False
        held = block
    yield held, True


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a hit word, with all their columns."""

    def run(batches, handle):
        bench = _tables(handle.value)
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, alnum_words())
                _, found = bench.find(words)
                yield batch.slice(i, j - i).filter(pa.array([not f for f in found], pa.bool_()))

    rows = docs
    for items, last in _peek(blocks_of(benchmark, block_bytes)):
        handle = docs.sparkSession.sparkContext.broadcast(items)
        rows = in_batches(rows).mapInArrow(lambda it, h=handle: run(it, h), docs.schema)
        if not last:
            rows = write_table(rows, "clean")
    return rows
