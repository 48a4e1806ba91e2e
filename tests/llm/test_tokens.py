"""Token ids, record files and packing: exact round trips."""

from __future__ import annotations

import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from runlens.llm import packing, registry, token_records, tokens
from runlens.llm.tokens import encoder, with_end
from runlens.llm.words import chunks, span_hashes

PATH = public_tokenizers.path(registry.TOKENIZER)
ODD = ["", "  a  b\n\n c ", " x", "x ", "<|endoftext|> a", "a\x1c b \x85 c", "don't  it's\t\n x\r\n y", None, "a b c 　d e　 f", "x — y z  é", " ", "\n", "a" * 500, "é è ê " * 50]


def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_librarys(spark, sf_dir):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    ref, at = reference(), 0
    for _, _, data, offsets in chunks(pa.array(texts)):
        ids, bounds = encoder(PATH).encode(data, offsets)
        ended, ends = with_end(ids, bounds)
        for k in range(len(bounds) - 1):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == ref(texts[at]), texts[at]
            assert ended[ends[k] : ends[k + 1]].tolist() == ref(texts[at]) + [0]
            at += 1
    assert at == len(texts)


def thue_morse(steps, a="a", b="b"):
    text = a
    for _ in range(steps):
        text += text.translate(str.maketrans(a + b, b + a))
    return text


def encoded(enc, texts):
    for _, _, data, offsets in chunks(pa.array(texts)):
        ids, bounds = enc.encode(data, offsets)
        yield from (ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def test_repetitive_words_keep_their_own_ids():
    texts = [f"{w} and {w}" for n in (3, 5, 6, 7, 12) for w in (thue_morse(n), thue_morse(n, "b", "a"))]
    texts += ["x" * n for n in range(1, 80)] + ["\0" * n for n in range(1, 20)] + ["a" * 63 + "b", "a" * 64 + "b", "a" * 65]
    assert list(encoded(tokens.WordEncoder(PATH), texts)) == list(map(reference(), texts))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    assert len(set(span_hashes(data, ends - [len(t) for t in texts], ends))) == len(texts)


@pytest.mark.parametrize("kinds", [1, 3])
def test_clashing_hashes_change_no_ids(monkeypatch, kinds):
    monkeypatch.setattr(tokens, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(kinds))
    texts = ODD + [f"w{i % 7} some{i % 11} words é{i % 5}" * (i % 4) for i in range(300)]
    assert list(encoded(tokens.WordEncoder(PATH), texts)) == list(map(reference(), texts))


def test_a_spoilt_record_is_found():
    record = token_records.frame(b"payload")
    assert token_records.read_record(io.BytesIO(record)) == b"payload" and token_records.read_record(io.BytesIO(b"")) is None
    for i in range(len(record)):
        bad = bytearray(record)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            token_records.read_record(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        token_records.read_record(io.BytesIO(record[:-1]))


def test_records_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ref, start = reference(), 0
    got = {r["doc_id"]: r for r in registry.op6_token_records(spark, sf_dir).collect()}
    for row in docs.orderBy("doc_id").collect():
        ids = ref(row["text"]) + [0]
        own = got[row["doc_id"]]
        assert (own["start"], own["n_tokens"], own["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == docs.count()


def test_shuffled_reads_by_the_index(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = token_records.write_records(docs, PATH, f"file://{tmp_path}/r", partitions=3)
    assert files.count() <= 3
    plain, mixed = token_records.read_records(files).collect(), token_records.read_records(files, shuffle_seed=5).collect()
    assert sorted(plain) == sorted(mixed)


def test_leftovers_of_lost_attempts_go(spark, tmp_path):
    folder = tmp_path / "r"
    folder.mkdir()
    (folder / ".ids-000000-99").write_bytes(b"cut short")
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    files = token_records.write_records(df, PATH, f"file://{folder}", partitions=1)
    assert sorted(p.name for p in folder.iterdir()) == ["ids-000000.idx", "ids-000000.rec"]
    assert token_records.read_records(files).count() == 2


def test_edge_cases(edge_docs, no_docs):
    rows = token_records.token_records(edge_docs, PATH).collect()
    assert len(rows) == edge_docs.count()
    order = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [sum(x["n_tokens"] for x in order[:i]) for i in range(len(order))]
    assert order[0]["doc_id"] is None
    assert token_records.token_records(no_docs, PATH).count() == 0
    assert packing.pack_documents(no_docs, PATH).count() == 0
    check_packed(packing.pack_documents(edge_docs, PATH, 64).collect(), 64)


def check_packed(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_places_every_piece(spark, sf_dir):
    rows = registry.op2_best_fit_packing(spark, sf_dir).collect()
    n = check_packed(rows, 2048)
    assert n <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1
    ref = reference()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(pieces) == len(rows)
    for doc_id, text in texts.items():
        ids = np.array(ref(text) + [0], "<u4")
        for p, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            r = pieces.pop((doc_id, p))
            assert (r["start"], r["length"], r["ids_crc32"]) == (start, length, zlib.crc32(ids[start : start + length].tobytes()))
    assert not pieces


@pytest.mark.parametrize(
    ("counts", "sequences"),
    [({}, 0), ({1: 1}, 1), ({10: 7}, 7), ({4: 3, 6: 3}, 3), ({5: 6, 3: 2, 2: 2}, 4), ({2: 1, 3: 1, 5: 1}, 1), ({4: 1, 3: 1, 2: 1, 1: 1}, 1), ({6: 5}, 5), ({1: 25}, 3)],
)
def test_small_plans(counts, sequences):
    assert packing.best_plan(counts, 10).sequences == sequences


def test_plans_at_random_are_whole_and_near_the_bound():
    rng = np.random.default_rng(2)
    for _ in range(5):
        lengths = np.clip(rng.lognormal(4, 1, 5000).astype(int), 1, 512)
        counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True), strict=True)}
        plan = packing.best_plan(counts, 512)
        assert not plan.left.any() and sum(s[2] * s[4] for s in plan.steps) == 5000
        assert plan.sequences <= 1.01 * lengths.sum() / 512 + 1
    assert len(packing.best_plan({k: 10**9 for k in range(1, 2049)}, 2048).steps) < 10_000


def fewest(lengths, capacity):
    """The fewest sequences, by trying every open one for each piece, longest first."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values():
            place(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_small_plans_are_near_the_fewest():
    rng = np.random.default_rng(9)
    over = 0
    for _ in range(300):
        lengths = sorted(rng.integers(1, 21, rng.integers(1, 10)).tolist(), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        found, best = packing.best_plan(counts, 20).sequences, fewest(lengths, 20)
        assert best <= found <= best + 1, lengths
        over += found - best
    assert over <= 10
