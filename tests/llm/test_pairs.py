"""Exact dedup, near duplicates and components against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from conftest import ascii_lower
from oracle import assert_same

from runlens.llm import components, exact_dedup, jaccard, registry


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", ascii_lower(text))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


class Union:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    union, index = Union(), defaultdict(list)
    for i, own in sets.items():
        common = defaultdict(int)
        for s in own:
            for j in index[s]:
                common[j] += 1
            index[s].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                union.join(i, j)
    return {i: (len(s), union.root(i)) for i, s in sets.items()}


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(df).collect()}
    assert got == brute_components(rows)
    return got


def brute_with_repeats(rows):
    """(sorted n_shingles and component of each doc_id) where rows of one doc_id are one document."""
    parts = brute_components(list(enumerate(t for _, t in rows)))
    union = Union()
    for k, (i, _) in enumerate(rows):
        union.join(("row", parts[k][1]), ("doc", i))
    least = defaultdict(list)
    for i, _ in rows:
        least[union.root(("doc", i))].append(i)
    return sorted((i, parts[k][0], min(least[union.root(("doc", i))])) for k, (i, _) in enumerate(rows))


def test_repeated_ids_share_their_links(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    long = lambda: " ".join(f"l{rng.random()}" for _ in range(400))
    rows = [(0, a), (5, a), (5, b), (9, b), (7, c), (7, ""), (7, None), (8, ""), (8, "x")]
    for i in range(100, 160, 2):
        short = [f"s{rng.random()}" for _ in range(100)]
        rows += [(i, " ".join(short)), (i, long()), (i + 1, " ".join([*short[:-1], "other"]))]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, a), (None, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(df).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute_with_repeats(rows)
    assert sorted(r for r in got if r[0] is None) == [(None, 0, None), (None, 36, None)]
    assert {i: c for i, _, c in got if i in (0, 5, 9)} == {0: 0, 5: 0, 9: 0}


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a, 1), (9, a + " more", 2), (5, b, 3), (5, b, 4), (None, a, 5), (1, c, 6), (2, "", 7), (2, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row0 long")
    kept = sorted(r["_row0"] for r in jaccard.one_of_each(df).collect())
    assert kept in ([1, 3, 5, 6, 7, 8], [1, 4, 5, 6, 7, 8])
    assert jaccard.one_of_each(df).columns == df.columns and jaccard.one_of_each(df.limit(0)).count() == 0
    alone = df.filter("_row0 in (1, 2, 6)")
    assert sorted(r["_row0"] for r in jaccard.one_of_each(alone).collect()) == [1, 6]


def test_one_row_of_equal_texts_stays(spark):
    rows = [(5, "copy", 1), (9, "Copy", 2), (5, "unique text", 3), (9, "copy", 4), (None, "COPY", 5), (None, "x", 6), (None, "X", 7), (3, None, 8), (2, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long")
    kept = sorted(r["a.b"] for r in exact_dedup.keep_one(df).collect())
    assert kept in ([2, 3, 6, 7, 8], [3, 4, 6, 7, 8])
    assert exact_dedup.keep_one(df).schema == df.schema and exact_dedup.keep_one(df.limit(0)).count() == 0
    assert not re.search("Python|Arrow|Pandas", exact_dedup.keep_one(df)._jdf.queryExecution().toString())


CLASHING = ["number", "NUMBER", "linked_number", "dropped", "_dropped", "copy_key", "Copy_Of", "tied_rows", "_copy_id", "_copy_digest", "_row", "rows", "text_sha256", "component_id", "digest", "kept", "n", "hot", "salt", "norm", "part"]


@pytest.mark.parametrize(("names", "repeated"), [(CLASHING[:1] + CLASHING[2:], True), (CLASHING[1:], False)])
def test_stages_keep_columns_of_clashing_names(spark, sf_dir, names, repeated):
    """Every stage of the pipeline on a table whose columns have the names that operators use for their own."""
    import corpus_pipeline

    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (9, a + " more"), (6, b), (7, b), (None, a), (2, ""), (3, None)] + [(6, b), (5, a)] * repeated
    df = spark.createDataFrame([(i, t, "en", "s", 1, *range(k, k + len(names))) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` long" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, sf_dir)
        assert got.columns == df.columns, name
        plain = stage(spark, df.select("doc_id", "text", "lang", "source", "n_chars"), sf_dir)
        assert sorted(map(str, (r[:5] for r in map(tuple, got.collect())))) == sorted(map(str, map(tuple, plain.collect()))), name
        for r in got.collect():
            assert list(r)[5:] == list(range(r[5], r[5] + len(names)))
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count() >= len(rows)


def test_many_groups_of_similar_documents_match_brute_force(spark):
    """Several clusters of one passage, each more than a group, so that groups of several documents meet."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for own in range(4):
        tail = [f"t{own}_{i}" for i in range(22 + own)]
        for _ in range(90):
            words = passage + tail
            words[rng.randrange(60)] = f"x{rng.random()}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def family(rng, n, edits):
    """Copies of one text with a few words changed, so that similarities lie on both sides of the threshold."""
    base = [f"b{i}" for i in range(150)]
    out = []
    for _ in range(n):
        words = base[:]
        for at in rng.sample(range(150), rng.randint(0, edits)):
            words[at] = f"x{rng.random()}"
        out.append(" ".join(words))
    return out


def test_near_copies_match_brute_force(spark):
    rng = random.Random(4)
    texts = family(rng, 220, 6) + [" ".join(f"u{rng.random()}" for _ in range(30)) for _ in range(50)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"v{rng.random()}" for _ in range(rng.randint(1, 60))) for _ in range(120)]
    texts += ["", None, "one", "One", "one two three four", "one two three four five six seven eight", "one two three four five six seven eight nine"]
    rng.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def just_below(n):
    """Copies of one text that each have five words of their own, a tenth of them with a near copy: similar, but only those link."""
    rng, base = random.Random(21), [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(n):
        words = base[:]
        for at in range(rng.randint(5, 9), 150, 30):
            words[at + rng.randint(0, 20)] = f"x{rng.random()}"
        texts.append(" ".join(words))
    return texts + [t + " more" for t in texts[::10]]


def test_family_just_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    counts, write = {}, jaccard.write_table

    def counted(df, label):
        out = write(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "write_table", counted)
    for n in (120, 240):
        texts = just_below(n)
        got = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert len({c for _, c in got.values()}) == n
        assert counts["candidates"] <= len(texts)


@pytest.mark.parametrize("steps", [(4, 8, 16, 32), (16, 32)])
def test_rare_tokens_beyond_the_filter_lose_no_link(spark, monkeypatch, steps):
    """The filter of shared tokens holds only those of over 4 or 16 documents, as where FILTER_BITS allow no more."""
    monkeypatch.setattr(jaccard, "STEPS", steps)
    rng = random.Random(5)
    texts = family(rng, 90, 6) + [t for own in range(12) for t in family(random.Random(own), 3, 3 + own % 3)] + just_below(40)
    rng.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def maps_in_a_stage(plan):
    """The most Python maps on a path of a plan between two exchanges."""
    most, path = 0, []
    for line in plan.splitlines():
        node = re.match(r"[ :|+*()\d-]*", line).end()
        while path and path[-1][0] >= node:
            path.pop()
        maps = path[-1][1] if path else 0
        maps = 0 if "Exchange" in line[node:].split(" ")[0] else maps + line[node:].startswith("MapInArrow")
        path.append((node, maps))
        most = max(most, maps)
    return most


def test_no_stage_runs_a_map_after_a_map(spark, sf_dir, monkeypatch):
    """Each map of a stage takes a Python worker of its own a core; workers outlive the stage with what they hold."""
    plans, write = [], jaccard.write_table

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(jaccard, "write_table", noted)
    kept = jaccard.one_of_each(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plans.append(("kept", kept._jdf.queryExecution().executedPlan().toString()))
    assert {"tokens", "candidates", "sets"} <= {label for label, _ in plans}
    assert {label: n for label, plan in plans if (n := maps_in_a_stage(plan)) > 1} == {}


def test_pair_is_given_where_it_first_meets():
    import numpy as np
    import pyarrow as pa

    tokens = np.sort(np.random.default_rng(3).integers(1, 1 << 63, 200, np.uint64))
    place = np.arange(200, dtype="<i8")
    own = [(1, tokens[:150], place[:150]), (2, tokens[50:150], place[50:150]), (3, tokens[149:150], place[149:150])]
    columns = [pa.array([g for g, _, _ in own]), pa.array([g for g, _, _ in own]), pa.array([900, 900, 900])]
    batch = pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k].tobytes() for x in own], pa.binary()) for k in (1, 2))], ["gid", "cluster", "n", "prefix", "places"])
    dealt = sorted((r for b in jaccard._entries([batch], 64) for r in b.to_pylist()), key=lambda r: r["bucket"])
    met = [(r["g"], r["h"]) for b in jaccard._meet([pa.RecordBatch.from_pylist(dealt)]) for r in b.to_pylist()]
    assert met == [(1, 2)]  # at 49 tokens after the first they have met already; with 3 the places before the only token are too many


def test_documents_match_brute_force(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_threshold_is_inclusive(spark):
    a = " ".join(f"w{i}" for i in range(13))  # 9 shingles
    b = a.rsplit(" ", 1)[0]  # 8 of them: 8/9
    c = " ".join(f"w{i}" for i in range(8))  # 4 shingles; with 5 more words' worth: 4/5
    d = " ".join(f"w{i}" for i in range(9))
    got = check(spark.createDataFrame(list(enumerate([a, b, c, d])), "doc_id long, text string"))
    assert got[1][1] == 0 and got[3][1] == 2


def test_near_copies_edge_cases(spark, edge_docs, no_docs):
    rows = jaccard.link_documents(edge_docs).collect()
    assert len(rows) == edge_docs.count() and jaccard.link_documents(no_docs).count() == 0
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert found[(None, 1)] is None and found[(0, 0)] == 0 and found[(5, 1)] == 4 and found[(9, 997)] == 8 and found[(7, 2)] == 6


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components(spark, one_task):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(1, k) for k in range(2, 60)] + [(5, 5)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df, one_task=one_task).collect()}
    nodes = {x for e in edges for x in e}
    assert {x: got.get(x, x) for x in nodes} == {x: union.root(x) for x in nodes}
    assert components.components(df.limit(0), one_task=one_task).count() == 0


def test_bitmaps_bound():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        missing = len(np.setdiff1d(a, b))
        assert jaccard.misses(*(np.frombuffer(jaccard.bitmap(x), np.uint8) for x in (a, b))) <= missing


def test_exact_dedup_matches_sql(spark, sf_dir):
    assert_same(registry.op8_exact_dedup(spark, sf_dir), sf_dir, registry.ORACLES["op8_exact_dedup"])


def test_exact_dedup_edge_cases(edge_docs, no_docs):
    rows = exact_dedup.find_copies(edge_docs).collect()
    assert len(rows) == edge_docs.count() and exact_dedup.find_copies(no_docs).count() == 0
    found = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert found[0]["keep_id"] == found[1]["keep_id"] == 12 and found[12]["kept"] and found[12]["group_size"] == 3  # null is empty
    assert found[4]["keep_id"] == 5 and found[4]["group_size"] == 3 and found[9]["kept"] and not found[8]["kept"]
    assert all(r["kept"] for r in rows if r["doc_id"] == 3)


def test_exact_dedup_is_native(spark, sf_dir):
    plan = exact_dedup.find_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_only_ascii_letters_fold(spark):
    df = spark.createDataFrame([(1, "Ä b"), (2, "ä b"), (3, "Ä B")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.find_copies(df).collect()} == {1: 3, 2: 2, 3: 3}
