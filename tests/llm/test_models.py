"""Language identification, decontamination, tool calls and the pipeline."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import ascii_lower
from oracle import assert_same
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import decontaminate, language_id, registry, tool_calls

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(ascii_lower(text))


def brute_contamination(docs, items):
    found: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for s in range(len(w) - size + 1) if size else ():
            found.setdefault(tuple(w[s : s + size]), set()).add(str(item))
    sizes = {len(k) for k in found}
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                own = found.get(tuple(w[s : s + size]))
                if own:
                    hit.update(range(s, s + size))
                    ids |= own
        yield doc_id, (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))


def contamination(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


def test_decontamination_matches_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert contamination(registry.op4_decontamination(spark, sf_dir)) == dict(brute_contamination(docs, items))


@pytest.mark.parametrize("block_bytes", [1 << 20, 90])
def test_decontamination_on_noise(spark, block_bytes):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "é", "D", "x1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 9, 10, 11, 14])))) for i in range(6)] + [(7, None), (7, "a b")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) + (", " + (rng.choice(items)[1] or "") + " zz" if rng.random() < 0.6 else "")) for i in range(80)] + [(90, None), (91, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = dict(brute_contamination(docs, items))
    assert contamination(decontaminate.find_contamination(d, b, block_bytes)) == expected
    clean = {r["doc_id"] for r in decontaminate.keep_clean(d, b, block_bytes).collect()}
    assert clean == {i for i, r in expected.items() if not r[4]}


def test_decontamination_edge_cases(spark, edge_docs, no_docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.find_contamination(edge_docs, bench).count() == edge_docs.count()
    assert decontaminate.find_contamination(no_docs, bench).count() == 0
    assert decontaminate.find_contamination(edge_docs, bench.limit(0)).filter("contaminated").count() == 0


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = registry.op3_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_language_never_learns_from_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(language_id._fold(docs) == 1, F.lit("xx")).otherwise(F.col("lang")))
    spoilt = spoilt.withColumn("text", F.when(language_id._fold(docs) == 1, F.lit("zz")).otherwise(F.col("text")))
    a, b = language_id.train_on(docs), language_id.train_on(spoilt)
    assert a.langs == b.langs and (a.embeddings == b.embeddings).all() and (a.weights == b.weights).all()


def test_language_edge_cases(spark, edge_docs, no_docs):
    rows = {r["doc_id"]: r for r in language_id.identify(edge_docs.filter("doc_id is not null")).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == rows[2]["lang_pred"] == "und" and rows[0]["score"] == 0 and rows[0]["rejected"]
    assert rows[20]["lang_pred"] in ("en", "fr")
    assert language_id.identify(no_docs).count() == 0
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}
    odd = [(i, "日本語" if i % 2 else "abc def", "ja" if i % 2 else "en") for i in range(24)] + [(100, "12 34 !", "en")]
    found = language_id.identify(spark.createDataFrame(odd, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {100}


def test_long_texts_score_like_their_slices(monkeypatch, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train_on(docs)
    before = {r["doc_id"]: r["score"] for r in language_id.identify(docs, model).collect()}
    import numpy as np
    import pyarrow as pa

    from runlens.llm.words import chunks

    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    monkeypatch.setattr(language_id, "SLICE", 257)
    scores = np.concatenate([language_id.predict_chunk(model, model.tables(), d, o)[1] for _, _, d, o in chunks(pa.array(texts))])
    assert np.allclose(scores, [before[i] for i in sorted(before)])


def test_tool_calls_match_sql(spark, sf_dir):
    assert_same(registry.op5_tool_calls(spark, sf_dir), sf_dir, registry.ORACLES["op5_tool_calls"])


def test_calls_and_results_match_sql(spark, sf_dir):
    assert_same(registry.tool_calls_of_orders(spark, sf_dir), sf_dir, registry.ORACLES["tool_calls_of_orders"])


SCHEMAS = {"add": {"required": ["a", "b"], "properties": {"a": "integer", "b": "number", "note": "string"}}}


def test_many_labels_stay_within_the_budget(spark, monkeypatch):
    """Three hundred labels on a small budget: fewer subwords a row, every label learned; labels beyond it are refused."""
    assert language_id.features_of(4, 800) == language_id.FEATURES and language_id.features_of(40_000, 8) < 200
    with pytest.raises(ValueError, match="do not fit"):
        language_id.features_of(200_000, 8)
    rows = [(k * 10 + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in range(30)), f"l{k:03d}") for k in range(300) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 300 * 2 * 53 * language_id.FEATURE_BYTES * 80)
    got = language_id.sample_features(df, 800, 16_000)
    assert len({lang for lang, _, _ in got}) == 300 and max(len(b) for _, b, _ in got) <= 80
    whole = language_id.Model(["a", "b", "c"], np.ones((language_id.BUCKETS, language_id.DIM)), np.arange(language_id.DIM * 3).reshape(-1, 3) / 50, np.zeros(3))
    data, offsets = np.frombuffer(b"some words here" * 9, np.uint8), np.arange(0, 136, 15)
    once = language_id.predict_chunk(whole, whole.tables(), data, offsets)
    monkeypatch.setattr(language_id, "HELD", 4)
    again = language_id.predict_chunk(whole, whole.tables(), data, offsets)
    assert once[0] == again[0] and (once[1] == again[1]).all() and (once[2] == again[2]).all()


def test_arguments_must_be_objects_and_texts_whole_json(spark):
    given = ['"{not json"', "[1,2]", '"5"', '"[1]"', "null", '{"a":1,"a":2}', '"{\\"a\\":1,\\"a\\":3}"', "{}", '"{} and prose"']
    texts = ['{"tool_calls":[{"id":"%d","name":"free","arguments":%s}]}' % (k, x) for k, x in enumerate(given)]
    texts += ['{"tool_call_id":"1","content":"c"} and then prose', '{"tool_call_id":"2","content":"c"}}', '{"tool_calls":[{"id":"none","name":"free"}]}']
    rows = [("c", k, "assistant", t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {r["turn"]: r for r in tool_calls.link_calls(df, {"free": {"properties": {"a": "integer"}}}).collect()}
    assert [got[k]["errors"] for k in range(len(given))] == ["arguments are no object"] * 5 + ["", "", "", "arguments are no object"]
    assert [json.loads(got[k]["json"])["arguments"] for k in range(len(given))] == ["{not json", [1, 2], 5, [1], None, {"a": 2}, {"a": 3}, {}, "{} and prose"]
    assert got[9]["kind"] == got[10]["kind"] == "message" and json.loads(got[9]["json"])["content"] == texts[9]
    assert got[11]["valid"] and got[11]["kind"] == "call"


def test_links_are_hash_joins_of_hash_aggregates(spark, sf_dir):
    """Past the size that is broadcast, the plan that ran joins by hash."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.op5_tool_calls(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "SortAggregate" not in plan and "Python" not in plan


def test_tool_calls_are_linked_checked_and_canonical(spark, edge_docs):
    call = lambda *calls: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), c, strict=True)) for c in calls]})
    rows = [
        (1, 0, "system", None),
        (1, 1, "user", "add"),
        (1, 2, "assistant", call(("x", "add", {"b": 2.5, "a": 1}), ("y", "add", '{"a": "no", "zz": 1}'), ("z", "sub", {}))),
        (1, 3, "tool", json.dumps({"tool_call_id": "y", "content": "3"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "nobody", "content": {"k": [1]}})),
        (2, 0, "tool", json.dumps({"tool_call_id": "x", "content": "other conversation"})),
        (3, 1, "tool", json.dumps({"tool_call_id": "late", "content": "before its call"})),
        (3, 2, "assistant", call(("late", "add", {"a": 1, "b": 2}))),
        (None, 0, "user", ""),
        (4, 0, "user", "{not json"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, link string")
    got = {(r["conv_id"], r["turn"], r["seq"]): r for r in tool_calls.link_calls(df, SCHEMAS).collect()}
    assert len(got) == 12
    x, y, z = (got[(1, 2, i)] for i in range(3))
    assert x["valid"] and x["linked_turn"] is None and json.loads(x["json"])["arguments"] == {"a": 1, "b": 2.5}
    assert '"arguments":{"a":1,"b":2.5}' in x["json"]
    assert y["errors"] == "b is missing; a is no integer; zz is not allowed" and y["linked_turn"] == 3
    assert z["errors"] == "unknown tool sub"
    assert got[(1, 3, 0)]["linked_turn"] == 2 and not got[(1, 4, 0)]["valid"] and got[(2, 0, 0)]["linked_turn"] is None
    late = got[(3, 1, 0)]
    assert (late["order_turn"], late["order_rank"]) > (got[(3, 2, 0)]["order_turn"], got[(3, 2, 0)]["order_rank"])
    assert got[(4, 0, 0)]["kind"] == got[(None, 0, 0)]["kind"] == "message"
    assert tool_calls.link_calls(df.limit(0), SCHEMAS).count() == 0


def test_repeated_identifiers_do_not_multiply(spark):
    rows = [(1, t, r, "x") for t, r in ((0, "user"), (0, "user"), (1, "assistant"), (1, "assistant"), (1, "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert tool_calls.link_calls(df, tool_calls.MESSAGE_SCHEMAS, implicit=True).count() == 5


def test_pipeline_matches_its_stages_by_brute_force(spark, sf_dir):
    from test_pairs import brute_components

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in language_id.identify(docs).filter("not rejected").collect()}
    assert len(kept) >= 0.98 * len(rows)
    last = {}
    for i in sorted(kept):
        last[ascii_lower(rows[i])] = i
    kept = sorted(last.values())
    groups = brute_components([(i, rows[i]) for i in kept])
    kept = [i for i in kept if groups[i][1] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {i for i, r in brute_contamination([(i, rows[i]) for i in kept], items) if not r[4]}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == clean
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), sf_dir).schema == docs.schema, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_sample_without_null_ids_and_bounded_by_label(spark):
    texts = {"aa": "kala mina tori", "bb": "sepu warg dolin", "cc": "xiro quath belm"}
    rows = [(None, f"{texts['aa']} null{i % 26}", "nn") for i in range(300)]
    rows += [(7, f"{texts['aa']} {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}", "aa") for i in range(600)]  # one doc_id, not held out, of many texts
    rows += [(7, texts["bb"], "bb")] * 400  # copies of one row
    rows += [(i, f"{texts['cc']} {i}", "cc") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found = Counter(lang for lang, _, _ in language_id.sample_features(docs, 20, 1000))
    assert set(found) == {"aa", "bb", "cc"} and found["bb"] == 1
    assert 5 <= found["aa"] <= 40 and 5 <= found["cc"] <= 40


def test_every_label_is_learned_however_many_there_are(spark):
    rng = random.Random(2)
    words = {f"l{n:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for n in range(400)}
    rows = [(n * 100 + k, " ".join(rng.choices(own, k=6)), lang) for n, (lang, own) in enumerate(words.items()) for k in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = Counter(lang for lang, _, _ in language_id.sample_features(docs, 800, 2000))
    assert set(found) == set(words) and max(found.values()) <= 2 * language_id.LEAST


def brute_language(model, text):
    """(language, score) by plain sums over every subword of a text."""
    low = ascii_lower(text)
    total, n = [0.0] * language_id.DIM, 0
    for word in re.findall(rb"[a-z\x80-\xff]+", low.encode()):
        marked = b"\0" + word + b"\0"
        for size in language_id.SIZES:
            for at in range(len(marked) - size + 1):
                code = 0
                for x in marked[at : at + size]:
                    code = (code * 0x01000193 + x + size) % (1 << 32)
                bucket = code * 0x9E3779B1 % (1 << 32) >> 17
                n += 1
                total = [t + float(e) for t, e in zip(total, model.embeddings[bucket], strict=True)]
    if not any(c.isalpha() for c in low):
        return "und", 0.0
    mean = [t / max(n, 1) for t in total]
    z = [(sum(m * float(w) for m, w in zip(mean, model.weights[:, k], strict=True)) + float(model.bias[k])) / model.temperature for k in range(len(model.langs))]
    e = [math.exp(x - max(z)) for x in z]
    best = max(range(len(e)), key=e.__getitem__)
    return model.langs[best], e[best] / sum(e)


def test_predictions_match_plain_sums(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train_on(docs)
    texts = [(r["doc_id"], r["text"]) for r in docs.filter("length(text) < 1500").orderBy("doc_id").limit(60).collect()]
    texts += [(-1, "ab é çç xyz"), (-2, "12 3"), (-3, ""), (-4, "a"), (-5, "ABC abc! Abc")]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")), model).collect()}
    for i, text in texts:
        lang, score = brute_language(model, text)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-5, text


def test_identifiers_of_two_conversations_never_meet(spark):
    call, result = json.dumps({"tool_calls": [{"id": "2#3", "name": "add", "arguments": {"a": 1, "b": 2}}], "content": "let me add"}), json.dumps({"tool_call_id": "3", "content": "3"})
    rows = [("1", 0, "assistant", call), ("1#2", 1, "tool", result), ("4", 0, "assistant", '{"tool_calls":[],"content":"done"}'), ("4", 1, "assistant", '{"tool_calls":5}')]
    got = {(r["conv_id"], r["turn"]): r for r in tool_calls.link_calls(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"), SCHEMAS).collect()}
    assert got[("1", 0)]["linked_turn"] is None and got[("1#2", 1)]["linked_turn"] is None and not got[("1#2", 1)]["valid"]
    assert json.loads(got[("1", 0)]["json"])["content"] == "let me add"
    assert got[("4", 0)]["kind"] == "message" and json.loads(got[("4", 0)]["json"])["content"] == "done"
    assert json.loads(got[("4", 1)]["json"])["content"] == '{"tool_calls":5}'
