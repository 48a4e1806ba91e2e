"""N-gram Jaccard join by a token-group matrix, exact over all documents.

A document's set holds the 64-bit hashes of its distinct five-word shingles (for a pair of sets of a thousand
shingles the chance that a clash changes their overlap is about 1e-13). Documents link when
100 * |A and B| >= 80 * |A or B|.

1. *Classes*: documents with one set (by a 128-bit digest of the sorted set) are represented by the smallest doc_id.
2. *Groups*: representatives whose sketches (three, each of two minima under hash orders) agree are compared with the
   smallest of them; verified links give clusters. A cluster and the documents that were found alike but not linked are
   a family of similar documents, cut into groups of about GROUP. A document that resembles none is a group of its own.
3. *Matrix columns*: any global order of tokens gives an exact prefix filter; this one puts tokens of one document
   first and those that more than ``LIGHT`` documents have last, so passages that many documents share stay out of
   prefixes. The matrix keeps, for each token in some prefix, the groups that have it; two groups meet where they share
   such a token, have documents of different clusters, their sizes allow a link, and so do the tokens before it: at the
   first token that two documents share, all before it are in one of them only, and linked documents of a and b tokens
   have at most (a + b) / 9 such. Tokens of one document are counted but not sent, and a pair that has met at the token
   before is not given again.
4. *Bound*: each group's token union is kept as a bitmap, beside those of its documents. Every document of one group is
   a query against the other's union: its tokens that the bitmap lacks are surely missing there, which bounds the
   overlap with any document behind it.
5. *Open*: only pairs of groups in which each has a document whose bound reaches the threshold are opened: their
   documents' texts are fetched and compared exactly, unless their clusters are already known to be joined. Components
   of all verified links give the result.

Links within one class or cluster need no further pairs: component ids lose nothing by leaving them out.

Cases: null, empty or wordless texts have no shingles and link with nothing (component_id is their doc_id); rows
that repeat a doc_id count as one document with several texts, whose links they share (a table with such rows is
first written under numbers of its own, and the components of one doc_id are united at the end); rows with a null
doc_id get a null component_id and link with nothing; an empty table gives no rows; other columns are ignored,
whatever their names. Whole texts are read. Broadcasts: at most HEAVY_MOST token hashes, and filters of ids and of
tokens of at most FILTER_BITS bits each. Where the tokens of several documents are too many for theirs, it holds those of
over 2, 4, 8 or 16 documents, and the tokens below are sent: costs change, results do not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import free_names, in_batches, lookup, write_table
from .words import U, Words, chunks, mix, space_words, windows

SHINGLE = 5
SKETCHES = 3
GROUP = 64
#: Per cent of the union from which two documents, if not linked, are similar enough to share a group.
KIN = 60
LIGHT = 32
HEAVY_MOST = 1 << 21
FILTER_BITS = 1 << 27
BUCKET_TOKENS = 1_000_000
#: Tasks that buckets are dealt to at most; beyond that each task has several buckets, one after the other.
BUCKET_TASKS = 20_000
#: Tokens that a task holds before it counts them and deals out the counts.
COMBINE = 1 << 21
CHUNK_PARTNERS = 64


# ------------------------------------------------------------------ sets


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): text i of a chunk has the ascending distinct hashes ``tokens[bounds[i]:bounds[i+1]]``."""
    words = Words(data, offsets, space_words())
    hashes, counts = words.hashes(), words.counts()
    long = counts >= SHINGLE
    made = np.where(long, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(made)])
    tokens = np.zeros(bounds[-1], U)
    rolled = windows(hashes, SHINGLE)
    if long.any():
        to = np.repeat(bounds[:-1][long], made[long]) + _ranges(made[long])
        tokens[to] = rolled[np.repeat(words.first[:-1][long], made[long]) + _ranges(made[long])]
    for i in np.flatnonzero(~long & (counts > 0)).tolist():
        a, n = words.first[i], counts[i]
        tokens[bounds[i]] = mix(windows(hashes[a : a + n], int(n)) + U(n))[0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        tokens[a:b].sort()
    keep = np.ones(len(tokens), bool)
    keep[1:] = tokens[1:] != tokens[:-1]
    keep[bounds[:-1][made > 0]] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    return tokens[keep], upto[bounds]


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each of the sizes, end to end."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """The fewest common shingles of a set of n with any set that it links with."""
    return (4 * n + 4) // 5


def sizes_allow(a, b):
    return (5 * a >= 4 * b) & (5 * b >= 4 * a)


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two ascending sets."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common, len(a) + len(b) - common


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not sizes_allow(len(a), len(b)) or not len(a):
        return False
    common, union = overlap(a, b)
    return 100 * common >= 80 * union


def _batches(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column("text")):
            yield batch.slice(i, j - i), *shingle_sets(data, offsets)


# ------------------------------------------------------------------ classes

SETS = "doc_id long, n long, digest binary, " + ", ".join(f"k{j} long" for j in range(SKETCHES))


def _summarise(batches) -> Iterator[pa.RecordBatch]:
    for part, tokens, bounds in _batches(batches):
        n = np.diff(bounds)
        some = np.flatnonzero(n > 0)
        keys = []
        for j in range(SKETCHES):
            key = np.zeros(len(n), U)
            for k in (2 * j, 2 * j + 1):
                salted = mix(tokens ^ U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                if len(some):
                    key[some] = mix(key[some] * U(3) + np.minimum.reduceat(salted, bounds[some]))
            keys.append(pa.array(key.view(np.int64)))
        digests = [hashlib.blake2b(tokens[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(digests, pa.binary()), *keys], ["doc_id", "n", "digest", *(f"k{j}" for j in range(SKETCHES))])


# ------------------------------------------------------------------ buckets of tokens


def _planes(a: np.ndarray) -> bytes:
    """Bytes by significance, so that compression removes the high ones."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    kind_ = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind_.itemsize, -1).T).view(kind_).ravel()


def _deal(columns: list[np.ndarray], bucket: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row a bucket: the bucket's entries of each column as byte planes."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    edges = np.concatenate([[0], cut, [len(order)]])
    parts = [[_planes(c[order[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)] for c in columns]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[order[edges[:-1]]].astype(np.int64)), *(pa.array(p, pa.binary()) for p in parts)], ["bucket", *names])


def _whole_buckets(batches, kinds: dict[str, str], fold: Callable | None = None) -> Iterator[list[np.ndarray]]:
    """The entries of each bucket, from rows sorted by bucket; with ``fold``, entries are folded as they come."""
    at, held, pending = None, {k: [] for k in kinds}, 0
    for batch in batches:
        for bucket, *blobs in zip(batch.column("bucket").to_pylist(), *(batch.column(k).to_pylist() for k in kinds), strict=True):
            if bucket != at and at is not None:
                yield [np.concatenate(held[k]) for k in kinds]
                held, pending = {k: [] for k in kinds}, 0
            at = bucket
            for (name, kind), blob in zip(kinds.items(), blobs, strict=True):
                held[name].append(_unplanes(blob, kind))
            pending += len(held[name][-1])
            if fold and pending > COMBINE:
                held = {k: [v] for k, v in zip(kinds, fold(*(np.concatenate(held[k]) for k in kinds)), strict=True)}
                pending = 0
    if at is not None:
        yield [np.concatenate(held[k]) for k in kinds]


def _by_bucket(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(min(n, BUCKET_TASKS), "bucket").sortWithinPartitions("bucket")


def _tokens_to_count(batches, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Tokens with their counts in this task: a token that many documents have is sent once for COMBINE tokens."""
    held, n = [], 0

    def counted() -> Iterator[pa.RecordBatch]:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        yield from _deal([tokens, counts.astype("<u4")], (mix(tokens) % U(n_buckets)).astype(np.int64), ["tokens", "counts"])

    for _, tokens, _ in _batches(batches):
        held.append(tokens)
        n += len(tokens)
        if n > COMBINE:
            yield from counted()
            held, n = [], 0
    if held:
        yield from counted()


def _summed(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(tokens)
    tokens = tokens[order]
    head = np.flatnonzero(np.concatenate([[len(tokens) > 0], tokens[1:] != tokens[:-1]])[: len(tokens)])
    return tokens[head], np.add.reduceat(counts[order].astype("<u4"), head) if len(head) else counts


#: Documents that a token of each step has at most; a token of the first has one.
STEPS = (1, 2, 4, 8, 16, LIGHT)


def _count(batches) -> Iterator[pa.RecordBatch]:
    """Rows (token, n) of heavy tokens; of the others that several documents have, a row (their number, n at most, tokens) a step."""
    names = ["token", "n", "held", "light"]
    for tokens, counts in _whole_buckets(batches, {"tokens": "<u8", "counts": "<u4"}, _summed):
        found, n = _summed(tokens, counts)
        heavy = n > LIGHT
        yield pa.RecordBatch.from_arrays([pa.array(found[heavy].view(np.int64)), pa.array(n[heavy].astype(np.int64)), pa.nulls(int(heavy.sum()), pa.int64()), pa.nulls(int(heavy.sum()), pa.binary())], names)
        steps = [(most, found[(n > least) & (n <= most)]) for least, most in zip(STEPS[:-1], STEPS[1:], strict=True)]
        steps = [(most, some) for most, some in steps if len(some)]
        columns = [pa.nulls(len(steps), pa.int64()), pa.array([most for most, _ in steps], pa.int64()), pa.array([len(some) for _, some in steps], pa.int64()), pa.array([some.tobytes() for _, some in steps], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names)


def _in_one(batches) -> Iterator[pa.RecordBatch]:
    """The tokens of a task as one value."""
    held = [batch.column(0).to_numpy(zero_copy_only=False) for batch in batches]
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([np.zeros(0, np.int64), *held]).tobytes()], pa.binary())], ["tokens"])


def count_tokens(docs: DataFrame, ids: DataFrame, column: str, parts: int) -> DataFrame:
    """The tokens that several of the documents (probably) among the ids have, as ``_count`` gives them."""
    mask = _shared_filter(ids, column)  # in the same map: a map after a map takes a second worker for each core, and workers stay
    dealt = in_batches(docs).mapInArrow(lambda it: _tokens_to_count(_marked(it, mask), 3 * parts), "bucket long, tokens binary, counts binary")
    return write_table(in_batches(_by_bucket(dealt, parts)).mapInArrow(_count, "token long, n long, held long, light binary"), "tokens")


def heavy_tokens(counted: DataFrame) -> np.ndarray:
    """The tokens that over LIGHT documents have; over more, if those are above HEAVY_MOST."""
    counts, least = counted.filter("token is not null"), LIGHT
    if counts.count() > HEAVY_MOST:  # 1/HEAVY_MOST steps of the counts' distribution; a tie drops all its tokens
        sizes = counts.select(F.ceil(F.log2("n") * 16).alias("step")).groupBy("step").count().orderBy(F.desc("step")).collect()
        total = 0
        for step, n in sizes:
            total += n
            if total > HEAVY_MOST:
                break
            least = 2 ** ((step - 1) / 16)
    got = in_batches(counts.filter(F.col("n") > least).select("token")).mapInArrow(_in_one, "tokens binary").collect()
    return np.sort(np.concatenate([np.zeros(0, U), *(np.frombuffer(r[0], U) for r in got)]))


def shared_tokens(counted: DataFrame) -> tuple[np.ndarray, int]:
    """A packed bit set of the hashed tokens that more than so many documents have: than one, or than the next of STEPS that FILTER_BITS allow."""
    sizes = dict(counted.groupBy(F.when(F.col("token").isNull(), F.col("n")).otherwise(2 * LIGHT)).agg(F.sum(F.coalesce("held", F.lit(1)))).collect())
    over = {least: sum(k for n, k in sizes.items() if n > least) for least in STEPS[:-1]}
    least = next((least for least, k in over.items() if 4 * k <= FILTER_BITS), STEPS[-2])

    def tokens(batch: pa.RecordBatch) -> np.ndarray:
        light = [np.frombuffer(b, np.int64) for b in batch.column("light").drop_null().to_pylist()]
        return np.concatenate([batch.column("token").drop_null().to_numpy(zero_copy_only=False), *light])

    rows = counted.filter((F.col("token").isNotNull()) | (F.col("n") > least)).select("token", "light")
    return np.packbits(_bit_set(rows, over[least], tokens)), least


# ------------------------------------------------------------------ texts of some documents


def _positions(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U)) & U(bits - 1)).astype(np.int64)


def _bit_set(rows: DataFrame, n: int, ids: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """A bit set, of at most FILTER_BITS, of the n hashed ids of the rows; united segment by segment before it reaches the driver."""
    bits = min(max(1 << 16, 1 << int(16 * n + 1).bit_length()), FILTER_BITS)

    def mark(batches):
        mask = np.zeros(bits, bool)
        for batch in batches:
            mask[_positions(ids(batch), bits)] = True
        parts = mask.reshape(-1, 1 << 16)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array([np.packbits(parts[k]).tobytes() for k in some], pa.binary())], ["bucket", "bits"])

    def unite(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column("bucket").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                b = np.frombuffer(b, np.uint8)
                out[k] = out[k] | b if k in out else b
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([b.tobytes() for b in out.values()], pa.binary())], ["bucket", "bits"])

    marked = in_batches(rows).mapInArrow(mark, "bucket long, bits binary")
    found = in_batches(marked.repartition(min(bits >> 16, 64), "bucket")).mapInArrow(unite, "bucket long, bits binary").collect()
    mask = np.zeros((bits >> 16, 1 << 13), np.uint8)
    for k, b in found:
        mask[k] = np.frombuffer(b, np.uint8)
    return np.unpackbits(mask.ravel())


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """The bit set of the ids."""
    return _bit_set(ids.select(F.col(column).cast("long")), ids.count(), lambda batch: batch.column(0).to_numpy(zero_copy_only=False))


def _marked(batches, mask_handle, wanted: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows whose doc_id the bit set holds (or, unless ``wanted``, does not hold; a null one never)."""
    packed, bits = mask_handle.value
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        at = _positions(ids.fill_null(0).to_numpy(zero_copy_only=False), bits)
        held = (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(held == wanted))


def _shared_filter(ids: DataFrame, column: str):
    mask = id_filter(ids, column)
    return ids.sparkSession.sparkContext.broadcast((np.packbits(mask), len(mask)))


def split_by_ids(docs: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: the rows whose doc_id may be among the ids (all that are, and few others), and the rest."""
    handle = _shared_filter(ids, column)
    return in_batches(docs).mapInArrow(lambda it: _marked(it, handle), docs.schema), in_batches(docs).mapInArrow(lambda it: _marked(it, handle, False), docs.schema)


def without_ids(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is not among the ids: found by a bounded bit filter, settled by a join.

    Most rows pass the filter untouched; only those that it may hold are shuffled to meet the exact list.
    """
    (name,) = free_names(docs, "dropped")
    own = write_table(ids.select(F.col(column).alias(name)).distinct(), "dropped")
    maybe, clear = split_by_ids(docs, own, name)
    return clear.union(maybe.join(own, F.col("doc_id") == F.col(name), "left_anti"))


def texts_of(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """(doc_id, text) of the documents that are probably among the ids: all that are, and few others."""
    return split_by_ids(docs, ids, column)[0]


# ------------------------------------------------------------------ comparing


LINKS = "a long, b long, linked boolean"


def _compare(batches, kin: bool) -> Iterator[pa.RecordBatch]:
    """Rows by (anchor, chunk), anchors' documents first: links between documents of clusters not yet joined here.

    What is known to be one cluster, by earlier links or by those found in this chunk, is not compared again. With
    ``kin``, pairs that do not link but share KIN per cent are given too, as not linked.
    """
    at, anchors, joined = None, [], {}

    def root(c: int) -> int:
        while joined.get(c, c) != c:
            c = joined[c]
        return c

    for batch in batches:
        keys = list(zip(batch.column("anchor").to_pylist(), batch.column("chunk").to_pylist(), strict=True))
        roles, docs, clusters = (batch.column(c).to_pylist() for c in ("role", "doc_id", "cluster"))
        out: list[tuple[int, int, bool]] = []
        for i, _, data, offsets in chunks(batch.column("text")):
            tokens, bounds = shingle_sets(data, offsets)
            for k in range(len(bounds) - 1):
                own, doc, cluster = tokens[bounds[k] : bounds[k + 1]], docs[i + k], clusters[i + k]
                if keys[i + k] != at:
                    at, anchors, joined = keys[i + k], [], {}
                if roles[i + k] == 0:
                    anchors.append((doc, cluster, own.copy()))
                    continue
                mine = root(cluster)
                for other, theirs, set_ in anchors:
                    other_root = root(theirs)
                    if other_root == mine or not (kin or sizes_allow(len(own), len(set_))):
                        continue
                    common, union = overlap(own, set_)
                    if 100 * common >= 80 * union:
                        out.append((doc, other, True))
                        joined[max(mine, other_root)] = mine = min(mine, other_root)
                    elif kin and 100 * common >= KIN * union:
                        out.append((doc, other, False))
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "linked"])


def verify(docs: DataFrame, anchors: DataFrame, partners: DataFrame, kin: bool = False) -> DataFrame:
    """Verified links (a, b, linked) between the documents of each anchor and its partners, both (anchor, doc, cluster).

    Links are found until the clusters they join are one. An anchor's partners are cut into chunks of about
    CHUNK_PARTNERS; each chunk gets the anchor's documents.
    """
    partners = write_table(partners, "partners")
    sizes = partners.groupBy("anchor").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / CHUNK_PARTNERS).cast("int").alias("chunks"))
    sizes = write_table(sizes, "anchor-sizes")
    right = lookup(partners, sizes, "anchor", "rows", partners.count()).select("anchor", F.pmod(F.xxhash64("doc"), "chunks").cast("int").alias("chunk"), "doc", "cluster", F.lit(1).alias("role"))
    left = anchors.join(sizes, "anchor").select("anchor", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "doc", "cluster", F.lit(0).alias("role"))
    places = write_table(left.unionByName(right), "opened")
    rows = texts_of(docs, places, "doc").join(places, F.col("doc_id") == F.col("doc"))
    dealt = rows.select("anchor", "chunk", "role", "doc_id", "cluster", "text").repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk", "role", "doc_id")
    return write_table(in_batches(dealt).mapInArrow(lambda it: _compare(it, kin), LINKS), "links")


# ------------------------------------------------------------------ matrix and bound

def bitmap(tokens: np.ndarray) -> bytes:
    """The set's bitmap of at least two bits a token, a power of two."""
    size = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    mask = np.zeros(size, bool)
    mask[(mix(tokens) & U(size - 1)).astype(np.int64)] = True
    return np.packbits(mask).tobytes()


def fold(a: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (packed) folded to ``size`` bytes: the bit of a token moves to its place modulo the size."""
    return a if len(a) == size else np.bitwise_or.reduce(a.reshape(-1, size), axis=0)


def misses(a: np.ndarray, b: np.ndarray) -> int:
    """At least so many tokens behind bitmap ``a`` are not behind ``b``."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, size) & ~fold(b, size)).sum())


def _prefixes(batches, handle) -> Iterator[pa.RecordBatch]:
    """The tokens of each prefix that other documents may have, and their places in the order of the document's tokens."""
    heavy, shared, least = handle.value
    for part, tokens, bounds in _batches(batches):
        at = _positions(tokens, 8 * len(shared))
        level = shared[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1  # the order: by level, then by hash
        if len(heavy):
            level[heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens] = 2
        prefix, places = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = b - a
            take = n - least_overlap(n) + 1 if n > 3 else 0
            first = np.argsort(level[a:b], kind="stable")[:take]
            place = np.flatnonzero(level[a:b][first]) if least == 1 else np.arange(take)
            prefix.append(tokens[a:b][first[place]].tobytes())
            places.append(place.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(prefix, pa.binary()), pa.array(places, pa.binary())], ["doc_id", "prefix", "places"])


ENTRIES = {"tokens": "<u8", "before": "<u8", "gid": "<i8", "below": "<i8", "n": "<i8", "excess": "<i8"}


def _entries(batches, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Each token of a prefix with the one before it, if any, and by how much nine times its place exceeds the document's size."""
    for batch in batches:
        blobs = batch.column("prefix").to_pylist()
        size = np.array([len(b) // 8 for b in blobs])
        tokens = np.frombuffer(b"".join(blobs), U)
        before = np.concatenate([np.zeros(1, U), tokens[:-1]])
        before[np.cumsum(size) - size] = 0
        gid, cluster, n = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64), size) for c in ("gid", "cluster", "n"))
        excess = 9 * np.frombuffer(b"".join(batch.column("places").to_pylist()), "<i8") - n
        yield from _deal([tokens, before, gid, gid - cluster, n, excess], (mix(tokens) % U(n_buckets)).astype(np.int64), list(ENTRIES))


def _meet(batches) -> Iterator[pa.RecordBatch]:
    """Pairs of groups, a group with itself included, that share a prefix token and may hold a link between two clusters.

    Two documents may link if at their first common token their excesses add up to zero at most. Where all documents of
    both groups that have a token had one and the same before it, the groups met there: with no fewer documents and
    lower places.
    """
    for tokens, before, gid, below, n, excess in _whole_buckets(batches, ENTRIES):
        order = np.lexsort((gid, tokens))
        tokens, before, gid, cluster, n, excess = tokens[order], before[order], gid[order], (gid - below)[order], n[order], excess[order]
        new = np.ones(len(tokens), bool)  # one entry a token and group, with the ranges of its sizes and clusters
        new[1:] = (tokens[1:] != tokens[:-1]) | (gid[1:] != gid[:-1])
        head = np.flatnonzero(new)
        if not len(head):
            continue
        least, most = np.minimum.reduceat(n, head), np.maximum.reduceat(n, head)
        low, high = np.minimum.reduceat(cluster, head), np.maximum.reduceat(cluster, head)
        first, last = np.minimum.reduceat(before, head), np.maximum.reduceat(before, head)
        before, excess = np.where(first == last, first, U(0)), np.minimum.reduceat(excess, head)
        tokens, gid = tokens[head], gid[head]
        mixed = np.unique(gid[(low != high) & (excess <= 0) & (before == 0)])
        found: list[np.ndarray] = [np.stack([mixed, mixed], axis=1)]
        # only entries that may link with the token's least excess, their own included
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        may = excess + np.repeat(np.minimum.reduceat(excess, starts), np.diff(np.append(starts, len(tokens)))) <= 0
        order = np.flatnonzero(may)
        order = order[np.lexsort((high[order], low[order], tokens[order]))]
        tokens, before, gid, least, most, low, high, excess = (x[order] for x in (tokens, before, gid, least, most, low, high, excess))
        edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]])) if len(tokens) else np.zeros(1, np.int64)
        size = np.diff(edge)
        # where the run of groups of one and the same cluster ends: within it no two groups need to meet
        alike = (tokens[1:] == tokens[:-1]) & (low[1:] == low[:-1]) & (high[1:] == high[:-1]) & (low[1:] == high[1:])
        start = np.flatnonzero(np.concatenate([[True], ~alike])) if len(tokens) else np.zeros(0, np.int64)
        run_end = np.repeat(np.append(start[1:], len(tokens)), np.diff(np.append(start, len(tokens)))) if len(tokens) else start
        held = 0
        for a, m in zip(edge[:-1][size > 1].tolist(), size[size > 1].tolist(), strict=True):
            for lo in range(a, a + m - 1, 1024):
                hi = min(lo + 1024, a + m - 1)
                if run_end[lo] >= a + m:
                    break
                rows, others = np.arange(lo, hi), np.arange(run_end[lo] if run_end[lo] >= hi else lo + 1, a + m)
                ok = others[None] > rows[:, None]
                ok &= (low[rows][:, None] != high[others][None]) | (high[rows][:, None] != low[others][None])
                ok &= (5 * most[rows][:, None] >= 4 * least[others][None]) & (5 * most[others][None] >= 4 * least[rows][:, None])
                ok &= excess[rows][:, None] + excess[others][None] <= 0
                ok &= (before[rows][:, None] != before[others][None]) | (before[rows] == 0)[:, None]
                i, j = np.nonzero(ok)
                if len(i):
                    pair = np.stack([gid[rows[i]], gid[others[j]]], axis=1)
                    pair.sort(axis=1)
                    found.append(pair)
                    held += len(i)
            if held > 1_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = len(found[0])
                if held > 500_000:
                    yield _pairs(found)
                    found, held = [], 0
        if found:
            yield _pairs([np.unique(np.concatenate(found), axis=0)])


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[0][:, k])) for k in (0, 1)], ["g", "h"])


def _bitmaps(batches, mask_handle) -> Iterator[pa.RecordBatch]:
    for part, tokens, bounds in _batches(_marked(batches, mask_handle)):
        bits = [bitmap(tokens[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bits, pa.binary())], ["doc_id", "bits"])


UNIONS = "gid long, bits binary, members array<struct<n long, bits binary>>"


def _unite(batches) -> Iterator[pa.RecordBatch]:
    """The union bitmap of each group and the bitmaps of its documents, from rows sorted by group."""
    at, union, members = None, None, []
    out: list[tuple] = []
    for batch in batches:
        for gid, n, bits in zip(batch.column("gid").to_pylist(), batch.column("n").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            own = np.frombuffer(bits, np.uint8)
            if gid != at:
                if at is not None:
                    out.append((at, union.tobytes(), members))
                at, union, members = gid, own, []
            else:
                size = max(len(own), len(union))
                # a smaller bitmap is repeated: the token's place is one of those it then marks
                union = np.tile(union, size // len(union)) | np.tile(own, size // len(own))
            members.append({"n": n, "bits": bits})
        if len(out) > 500:
            yield _unions(out)
            out = []
    if at is not None:
        out.append((at, union.tobytes(), members))
    if out:
        yield _unions(out)


def _unions(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.struct([("n", pa.int64()), ("bits", pa.binary())]))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["gid", "bits", "members"])


def _bound(batches) -> Iterator[pa.RecordBatch]:
    """The pairs of groups of which the first has a document that reaches its bound in the union of the second.

    A document of n tokens may miss at most n - least_overlap(n) of them in the other's union.
    """
    for batch in batches:
        members, unions = batch.column("members"), batch.column("bits").to_pylist()
        sizes, bits = members.flatten().field("n").to_pylist(), members.flatten().field("bits")
        upto = np.concatenate([[0], np.cumsum([len(m) for m in members])]).tolist()
        keep = []
        for a, b, union in zip(upto[:-1], upto[1:], unions, strict=True):
            other = np.frombuffer(union, np.uint8)
            keep.append(any(misses(np.frombuffer(bits[k].as_py(), np.uint8), other) <= sizes[k] - least_overlap(sizes[k]) for k in range(a, b)))
        yield batch.select(["g", "h"]).filter(pa.array(keep, pa.bool_()))


# ------------------------------------------------------------------ the join


def _sketch_pairs(nodes: DataFrame) -> DataFrame:
    """(anchor, doc): each document with the smallest of those that agree with it in a sketch."""
    keys = F.explode(F.array(*(F.xxhash64(F.lit(j), f"k{j}") for j in range(SKETCHES)))).alias("key")
    rows = nodes.select("doc", keys)
    leaders = rows.groupBy("key").agg(F.min("doc").alias("anchor"), F.count("*").alias("rows")).filter("rows > 1")
    pairs = lookup(rows, write_table(leaders, "leaders"), "key", "rows", SKETCHES * nodes.count())
    return write_table(pairs.filter("doc <> anchor").select("anchor", "doc").distinct(), "sketch-pairs")


def _groups(nodes: DataFrame, star: DataFrame) -> DataFrame:
    """(doc, n, cluster, gid): clusters of verified similar documents, and groups of about GROUP of similar documents.

    A group is a part of a family: a cluster with the documents outside it that are kin to a document in it. So
    documents just under the threshold share groups with those they resemble.
    """
    clusters = write_table(components(star.filter("linked")), "clusters")
    cluster = F.coalesce("component", "doc").alias("cluster")
    placed = nodes.join(clusters.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "n", cluster)
    placed = write_table(placed, "placed")
    kin = star.filter("not linked").groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("anchor"))
    kin = kin.join(placed.select(F.col("doc").alias("anchor"), F.col("cluster").alias("family")), "anchor").select("doc", "family")
    inner = clusters.select(F.col("component").alias("cluster")).distinct().withColumn("clustered", F.lit(True))
    rows = placed.join(kin, "doc", "left").join(inner, "cluster", "left")
    rows = rows.withColumn("family", F.when(F.col("clustered"), F.col("cluster")).otherwise(F.coalesce("family", "cluster")))
    rows = write_table(rows.select("doc", "n", "cluster", "family"), "families")
    sizes = write_table(rows.groupBy("family").agg(F.count("*").alias("docs")), "family-sizes")
    parts = lookup(rows, sizes, "family", "docs", rows.count()).withColumn("part", F.pmod(F.xxhash64("doc"), F.ceil(F.col("docs") / GROUP)))
    parts = write_table(parts, "parts")
    ids = parts.filter("docs > 1").groupBy("family", "part").agg(F.min("doc").alias("gid"))
    many = parts.filter("docs > 1").join(ids, ["family", "part"]).select("doc", "n", "cluster", "gid")
    alone = parts.filter("docs = 1").select("doc", "n", "cluster", F.col("doc").alias("gid"))
    return write_table(many.unionByName(alone), "groups")


def _qualifying(rows: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of groups (g, h) of which each has a document that reaches its bound in the other's union."""
    wanted = pairs.select(F.col("g").alias("gid")).unionByName(pairs.select(F.col("h").alias("gid"))).distinct()
    own = write_table(members.join(wanted, "gid").select("gid", "doc", "n"), "matrix-members")
    mask = _shared_filter(own, "doc")
    bits = in_batches(rows).mapInArrow(lambda it: _bitmaps(it, mask), "doc_id long, bits binary")
    dealt = bits.join(own, F.col("doc_id") == F.col("doc")).select("gid", "n", "bits")
    unions = write_table(in_batches(dealt.repartition("gid").sortWithinPartitions("gid")).mapInArrow(_unite, UNIONS), "unions")
    for asks, answers in (("g", "h"), ("h", "g")):
        sides = pairs.join(unions.select(F.col("gid").alias(asks), "members"), asks).join(unions.select(F.col("gid").alias(answers), "bits"), answers)
        pairs = write_table(in_batches(sides).mapInArrow(_bound, "g long, h long"), "qualifying")
    return pairs


def _sets(rows: DataFrame) -> DataFrame:
    return write_table(in_batches(rows).mapInArrow(_summarise, SETS), "sets")


def _repeated(sets: DataFrame) -> bool:
    """Whether some doc_id has several rows."""
    return not sets.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty()


def _labelled(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of rows whose doc_ids are distinct, but for null ones."""
    linkable = sets.filter("n > 0 and doc_id is not null")
    keys = [f"k{j}" for j in range(SKETCHES)]
    classes = write_table(linkable.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.count("*").alias("rows"), *(F.min(c).alias(c) for c in ("n", *keys))), "classes")
    tokens, total = classes.agg(F.coalesce(F.sum(F.col("n") * F.col("rows")), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    parts = max(12, int(tokens) // BUCKET_TOKENS)
    nodes = classes.filter("n > 3").select("doc", "n", *keys)

    near = _sketch_pairs(nodes)
    leaders = near.select("anchor", F.col("anchor").alias("doc"), F.col("anchor").alias("cluster")).distinct()
    star = verify(rows, leaders, near.withColumn("cluster", F.col("doc")), kin=True)
    members = _groups(nodes, star)

    counted = count_tokens(rows, nodes, "doc", parts)
    order = rows.sparkSession.sparkContext.broadcast((heavy_tokens(counted), *shared_tokens(counted)))
    prefixes = in_batches(rows).mapInArrow(lambda it: _prefixes(it, order), "doc_id long, prefix binary, places binary").filter(F.octet_length("prefix") > 0)
    columns = prefixes.join(members.hint("merge"), F.col("doc_id") == F.col("doc")).select("gid", "cluster", "n", "prefix", "places")  # a broadcast would put two maps in one stage
    entries = in_batches(columns).mapInArrow(lambda it: _entries(it, 3 * parts), "bucket long, " + ", ".join(f"{c} binary" for c in ENTRIES))
    pairs = write_table(in_batches(_by_bucket(entries, parts)).mapInArrow(_meet, "g long, h long").distinct(), "candidates")
    opened = _qualifying(rows, members, pairs)
    docs_of = members.select("gid", "doc", "cluster")
    anchors = docs_of.join(opened.select(F.col("g").alias("gid")).distinct(), "gid").select(F.col("gid").alias("anchor"), "doc", "cluster")
    partners = opened.join(docs_of, F.col("h") == F.col("gid")).select(F.col("g").alias("anchor"), "doc", "cluster")
    links = star.unionByName(verify(rows, anchors, partners))

    found = components(links.filter("linked"))
    ids = classes.select("digest", "doc", "rows").join(found, F.col("doc") == F.col("node"), "left")
    ids = write_table(ids.select("digest", "rows", F.coalesce("component", "doc").alias("component_id")), "component-ids")
    out = lookup(linkable.select("doc_id", "n", "digest"), ids, "digest", "rows", total).select("doc_id", "n", "component_id")
    alone = sets.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _numbered(docs: DataFrame, number: str) -> DataFrame:
    """``docs`` with a number for each row, written so that the numbers hold."""
    return write_table(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")


def _united(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The components ``found`` of numbered rows, those that share a doc_id united and named by their least doc_id."""
    held = found.select(F.col("doc_id").alias("number"), "n_shingles", "component_id").join(docs.select("number", "doc_id"), "number")
    held = write_table(held.select("doc_id", "n_shingles", F.col("component_id").alias("part")), "parts-of-rows")
    total = held.count()
    leads = write_table(held.groupBy("doc_id").agg(F.min("part").alias("lead"), F.count("*").alias("rows")), "leads")
    joined = write_table(components(lookup(held.select("doc_id", "part").distinct(), leads, "doc_id", "rows", total).select(F.col("part").alias("a"), F.col("lead").alias("b"))), "united")
    sizes = held.groupBy("part").agg(F.count("*").alias("rows"))
    labels = write_table(sizes.join(joined, F.col("part") == F.col("node"), "left").select("part", "rows", F.coalesce("component", "part").alias("label")), "labels")
    rows = write_table(lookup(held, labels, "part", "rows", total).select("doc_id", "n_shingles", "label"), "labelled")
    names = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    return lookup(rows, write_table(names, "names"), "label", "rows", total).select("doc_id", "n_shingles", "component_id")


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = _sets(rows)
    if not _repeated(sets):
        return _labelled(rows, sets)
    named = _numbered(rows.filter("doc_id is not null"), "number")
    own = named.select(F.col("number").alias("doc_id"), "text")
    nameless = sets.filter("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return _united(_labelled(own, _sets(own)), named).unionByName(nameless)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those linked with another that stays; of linked rows the one with the smallest doc_id stays.

    Rows are judged one by one, also where they repeat a doc_id; of rows that repeat the smallest doc_id any one
    stays. Rows with a null doc_id link with nothing, so they stay. All columns stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = _sets(rows)
    if not _repeated(sets):
        return without_ids(docs, _labelled(rows, sets).filter("component_id <> doc_id"), "doc_id")
    number, linked = free_names(docs, "number", "linked_number")
    held = _numbered(docs, number)
    own = held.filter("doc_id is not null").select(F.col(number).alias("doc_id"), "text")
    found = _labelled(own, _sets(own)).select(F.col("doc_id").alias("number"), "component_id")
    found = write_table(found.join(held.select(F.col(number).alias("number"), F.col("doc_id").cast("long").alias("doc_id")), "number"), "rows-of-components")
    stay = found.groupBy("component_id").agg(F.min_by("number", F.struct("doc_id", "number")).alias("number"))
    gone = write_table(found.join(stay.select("number"), "number", "left_anti").select(F.col("number").alias(linked)), "linked-rows")
    return held.join(gone, F.col(number) == F.col(linked), "left_anti").drop(number)
