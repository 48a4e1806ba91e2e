"""Hard negatives, clusters and mixture packing against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from oracle import assert_same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runlens.llm import clustering, hard_negatives, mixing, registry

PATH = public_tokenizers.path(registry.TOKENIZER)
VECTORS = "vec_id long, embedding array<float>, label int, score double, uid int, key string, cluster string"
NAN, INF = float("nan"), float("inf")
ODD = [
    (None, [0.5] * 4, 1), (100, None, 1), (101, [0.5] * 4, None), (102, [NAN, 0.1, 0.1, 0.1], 1), (103, [INF, 0.1, 0.1, 0.1], 1), (104, [0.1, None, 0.1, 0.1], 1),
    (200, [0.9, 0.2, 0.1, 0.0], 1), (200, [0.8, 0.2, 0.1, 0.0], 1), (105, [], 2), (106, [0.5], 2), (300, [-0.5, -0.5, -0.5, -0.5], 7), (-100, [0.4, 0.4, 0.4, 0.4], 1), (2**62, [0.4] * 4, 2),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1, "k", "c") for r in rows], VECTORS)


def brute_negatives(rows, scale=256, positives=5, k=10):
    fine = [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for place, (a, v, y) in enumerate(fine):
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=False)), i, z) for at, (i, w, z) in enumerate(fine) if at != place]
        scored.sort()
        for ps, p, _ in [s for s in scored if s[2] == y][:positives]:
            found = [(i, -s) for s, i, z in scored if z != y and 30 * -ps <= 100 * -s <= 90 * -ps][:k]
            out += [(a, p, r + 1, i, -ps, s) for r, (i, s) in enumerate(found)]
    return Counter(out)


def negatives(df, **more):
    return Counter(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **more).collect())


def test_negatives_match_sql(spark, sf_dir):
    assert_same(registry.op11_hard_negatives(spark, sf_dir), sf_dir, hard_negatives.ORACLE)


@pytest.mark.parametrize("block", [2048, 16])
def test_negatives_with_ties_copies_and_odd_rows(spark, monkeypatch, block):
    """Half of the rows are one vector, so that a score's ties go far beyond k and are settled by vec_ids."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", block)
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.1, 0.2, 0.3]) for _ in range(4)], rng.randrange(3)) for i in range(150)]
    rows += [(1000 + 7 * i, [0.25, 0.25, 0.25, 0.125], i % 2) for i in range(300)] + [(900, [0.3] * 4, 1)] * 30 + [(901, [0.2] * 4, 0)] * 30 + ODD
    rng.shuffle(rows)
    assert negatives(table(spark, rows).repartition(5)) == brute_negatives(rows)


def test_negatives_of_nothing_and_of_one_label(spark):
    assert not negatives(table(spark, ODD).limit(0)) and not negatives(table(spark, [ODD[0], ODD[1]]))
    assert negatives(table(spark, ODD)) == brute_negatives(ODD)
    with pytest.raises(ValueError, match="smaller scale"):
        negatives(table(spark, [(100, [3e30, 1.0], 1), (101, [3e30, 1.0], 1)]))
    large = [(100, [3e4, 1e3], 1), (101, [2e4, 5e3], 1), (102, [1e4, 1e3], 2)]  # beyond what doubles hold
    assert negatives(table(spark, large), scale=4096) == brute_negatives(large, scale=4096)


def brute_clusters(rows, k=8, rounds=10, dims=4, scale=1024, seed="3"):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), np.array(v, "<i2").tobytes(), v) for i, v in kept if i is not None)[:k]
    centers = [list(v) for _, _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centers)), key=lambda c: (far(v, centers[c]), c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)].append(v)
        for c, vs in own.items():
            centers[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, c := nearest(v), far(v, centers[c])) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), marks[c]) for i, c, d in found)


def clusters(df, **more):
    return Counter(tuple(r) for r in clustering.cluster(df, dims=4, **more).collect())


def test_clusters_match_sql(spark, sf_dir):
    assert_same(registry.op12_centroid_clusters(spark, sf_dir), sf_dir, clustering.oracle())


def test_clusters_with_copies_and_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], 0) for i in range(200)] + [(1000 + i, [0.5, -0.5, 0.25, 0.0], 1) for i in range(150)] + ODD + [(7, [0.1] * 4, 1)] * 5
    rng.shuffle(rows)
    assert clusters(table(spark, rows).repartition(5)) == brute_clusters(rows)
    assert clusters(table(spark, rows[:5]), k=8) == brute_clusters(rows[:5])
    assert not clusters(table(spark, rows).limit(0))
    for same in ([(i, [0.5] * 4, 1) for i in range(20)], [(5, [0.5] * 4, 1)]):  # empty clusters keep their centroids
        assert clusters(table(spark, same)) == brute_clusters(same)
    with pytest.raises(ValueError, match="smaller scale"):
        clusters(table(spark, [(1, [1e30] * 4, 1)]))


def test_packed_vectors_are_canonical():
    rows = np.array([[0, 1], [-(2**15), 2**15 - 1], [2**15, 0], [-(2**31), 5], [2**31, 0], [-(2**62), 2**62]], np.int64)
    packed = clustering.pack(rows)
    assert [len(p) // 2 for p in packed] == [2, 2, 4, 4, 8, 8]
    assert (clustering.unpack(pa.array(packed, pa.binary()), 2) == rows).all()


def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check_mixed(rows, texts, capacity):
    """Every id in one piece, sequences gapless, none padded; gives the tokens of each source and window."""
    ref, by_doc, by_sequence = reference(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = Counter((i, tuple(ref(t))) for i, t in texts)
    for (i, ids), copies in wanted.items():
        crcs, at = Counter(), 0
        for r in by_doc[i, len(ids)]:
            crcs[r["start"], r["length"], r["ids_crc32"]] += 1
        if copies == 1 and sum(n for (j, x), n in wanted.items() if j == i and len(x) == len(ids)) == 1:
            for start, length, crc in sorted(crcs):
                assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                at += length
            assert at == len(ids)
    total = sum(len(ids) * n for (_, ids), n in wanted.items())
    assert sum(r["length"] for r in rows) == total
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        sizes.append(at)
    assert all(s == capacity or s & (s - 1) == 0 and s < capacity for s in sizes)
    assert sizes.count(capacity) == total // capacity
    return total


def test_mixture_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix_documents(docs, PATH, window=8).join(docs.select("doc_id", "source"), "doc_id").collect()
    total = check_mixed(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 1024)
    sources, windows = Counter(), defaultdict(Counter)
    for r in rows:
        sources[r["source"]] += r["length"]
        windows[r["window"]][r["source"]] += r["length"]
    assert len(windows) == -(-total // (8 * 1024))
    for k, held in windows.items():
        if k < len(windows) - 1:  # the last window is what is left
            for s, n in sources.items():
                assert abs(held[s] - n * 8 * 1024 / total) <= 1 + 1e-6, (k, s)
    for r in rows:  # a window's tokens lie in its own sequences, but for the rounding of its sources' credits
        first, last = r["window"] * 8, r["window"] * 8 + 8
        assert first - 1 <= r["sequence_id"] <= last + 10


def round_robin(totals, weights, size):
    """Deficit round-robin, one window after another, in exact fractions."""
    left, deficit, out = list(totals), [Fraction(0)] * len(totals), []
    while any(left):
        named = [i for i in range(len(totals)) if left[i] and weights[i] > 0] or [i for i in range(len(totals)) if left[i]]
        credit, served = Fraction(min(size, sum(left))), [0] * len(totals)
        while credit > 0 and named:
            whole = sum(Fraction(weights[i]) if weights[i] > 0 else Fraction(1) for i in named)
            time = min([credit / whole, *((left[i] - served[i] - deficit[i]) / (Fraction(weights[i]) if weights[i] > 0 else 1) for i in named)])
            for i in named:
                deficit[i] += time * (Fraction(weights[i]) if weights[i] > 0 else 1)
                served[i] += int(deficit[i])
                deficit[i] -= int(deficit[i])
            credit -= time * whole
            done = [i for i in named if served[i] >= left[i]]
            named = [i for i in named if i not in done]
            if not named:
                named = [i for i in range(len(totals)) if left[i] > served[i]]
                if credit > 0 and all(weights[i] <= 0 for i in named):
                    continue
                break
        left = [a - b for a, b in zip(left, served, strict=True)]
        out.append(served)
        if len(out) > 10_000:
            raise AssertionError("no end")
    return out


@pytest.mark.parametrize(("totals", "weights", "size"), [([500, 300, 200], [500.0, 300.0, 200.0], 100), ([1000, 50, 400], [1.0, 1.0, 2.0], 64), ([70, 0, 5], [70.0, 0.0, 5.0], 8), ([300, 200], [1.0, 0.0], 50), ([3], [3.0], 8), ([1, 1, 1], [1.0, 1.0, 1.0], 2)])
def test_schedule_is_deficit_round_robin(totals, weights, size):
    schedule = mixing.Schedule(totals, weights, size)
    upto = np.zeros(len(totals), np.int64)
    for k, served in enumerate(round_robin(totals, weights, size)):
        upto += served
        if k + 1 < schedule.windows:
            assert np.abs(schedule.at(k + 1) - upto).max() <= 1, k
    assert schedule.at(schedule.windows).tolist() == totals
    places = []
    for q, n in enumerate(totals):
        for whole in (n, 7):  # in one go, and in parts
            got = [at + i for lo in range(0, n, whole or 1) for _, take, at in schedule.runs(q, lo, min(whole, n - lo)) for i in range(take)]
            assert got == sorted(set(got)) and len(got) == n
        places += got
    assert sorted(places) == list(range(sum(totals)))


def test_targets_hold_until_a_source_is_dry(spark):
    rows = [(i, f"w{i} " * 40, "a" if i % 4 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix_documents(df, PATH, capacity=64, window=4, targets={"a": 1, "b": 1}).join(df.select("doc_id", "source"), "doc_id").collect()
    check_mixed(got, [(r[0], r[1]) for r in rows], 64)
    windows = defaultdict(Counter)
    for r in got:
        windows[r["window"]][r["source"]] += r["length"]
    b = sum(w["b"] for w in windows.values())
    for k in range(b // 128):
        assert abs(windows[k]["a"] - 128) <= 1 and abs(windows[k]["b"] - 128) <= 1
    late = mixing.mix_documents(df, PATH, capacity=64, window=4, targets={"b": 1}).join(df.select("doc_id", "source"), "doc_id")
    assert late.filter("source = 'b'").agg(F.max("window")).first()[0] == -(-b // 256) - 1


@pytest.mark.parametrize("queues", [4096, 3])
def test_mixture_edge_cases(spark, edge_docs, no_docs, monkeypatch, queues):
    monkeypatch.setattr(mixing, "QUEUES", queues)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1 << 18 if queues > 3 else 0)
    docs = edge_docs.unionByName(edge_docs.withColumn("source", F.concat(F.lit("x"), (F.col("doc_id") % 4).cast("string"))).withColumn("doc_id", F.col("doc_id") + 100)).repartition(3)
    check_mixed(mixing.mix_documents(docs, PATH, capacity=64, window=3).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 64)
    assert mixing.mix_documents(no_docs, PATH).count() == 0
    ids = mixing.mix_documents(edge_docs.filter("text is null"), PATH, with_ids=True).collect()
    assert [(r["doc_id"], bytes(r["ids"])) for r in sorted(ids)] == [(0, bytes(4)), (12, bytes(4))]
