"""Secrets, personal data and licenses against plain regular expressions."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest
from conftest import ascii_lower

from runlens.llm import licenses, pii, registry, secrets
from runlens.llm.words import chunks


def joined(spans, order):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order.index(s[0]))))


def brute_pii(text):
    out = []
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def brute_secrets(text):
    key = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    out = [("assign", m.start(), m.end()) for m in re.finditer(rf"({key})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or "") if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]


def noise(alphabet, n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_pii_on_noise():
    for text in noise(["1", "2", ".", "@", "a", "+", "-", " ", "(", "4", "é", "0", "192", "168.0.", "x@y.z", "4111 1111", " 1111-1111"], 8000, 50, 3):
        assert sorted(s for s in pii.find_spans(text) if s[0] in pii.BASE) == sorted(brute_pii(text)), text


@pytest.mark.parametrize("n", [5_000, 300_000])
def test_long_runs_are_scanned_in_linear_time(n):
    dots = ".".join(["1"] * n)
    texts = ["0" * n + ".1.1.1", "1" * n + ".1.1.1", "1." + "1" * n, "1.1.1." + "0" * n + "255", "4" * n, "4 " * n, "+1" + "(" * n, "+" + "1" * n]
    texts += ["a" * n + "@", "@" * n, "a@" * n, "ssn" + " " * n, "http://" + "a:" * n, "ssn " * n, "-" * n + "1.2", "eyJ" * n]
    for text in texts:
        assert sorted(s for s in pii.find_spans(text) if s[0] in pii.BASE) == ([("ip", 0, n + 6)] if text[0] == "0" else [("ip", 0, n + 9)] if text.endswith("0255") else []), text[:20]
    assert len(pii.find_spans(dots)) == n // 4
    for _, _, data, offsets in chunks(pa.array(texts + [dots])):
        secrets.index().spans(data, offsets)


def test_recall_of_all_spans(spark, sf_dir):
    """Every document that plain expressions find personal data in has a span of that kind at that place."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r["doc_id"]: set(r["spans"].split(",")) for r in registry.op10_pii(spark, sf_dir).collect()}
    wanted = {(i, f"{k}:{a}:{b}") for i, t in texts.items() for k, a, b in brute_pii(t)}
    assert wanted and all(span in found[i] for i, span in wanted)


def test_secrets_on_noise():
    texts = noise(["ToKen", "pass", "word", "wd", "api", "_", "key", "'", '"', " ", "=", ":", "abc", "AKIA", "ABCDEFGH", "0123456789", "ghp_", "secret", "ſecret", "é"], 8000, 20, 1)
    found = []
    for _, _, data, offsets in chunks(pa.array(texts)):
        found += secrets.index().spans(data, offsets)
    for text, spans in zip(texts, found, strict=True):
        assert sorted(s for s in spans if s[0] in secrets.BASE) == sorted(brute_secrets(text)), text
        every = {(k, m.start(), m.end()) for k, (p, least) in secrets.RULES.items() for m in re.finditer(p, text) if len(m[m.re.groups]) >= least}
        assert set(spans) == every


@pytest.mark.parametrize("kind", [k for k in secrets.RULES if k != "hex"])
def test_rules_have_mandatory_trigrams(kind):
    assert secrets.trigram_query(secrets.RULES[kind][0])


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_license(text):
    words = WORD.findall(ascii_lower(text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_hundreds_of_rules_in_order():
    rules = licenses.rules()
    assert len(rules) > 300 and [(r.section, r.place) for r in rules] == sorted((r.section, r.place) for r in rules)
    assert len({r.pattern.pattern for r in rules}) == len(rules)


def sample_match(rng, nodes):
    """A string that a parse tree matches, drawn at random."""
    out = ""
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "ANY":
            out += rng.choice("ab .")
        elif name == "IN":
            kind, value = rng.choice([x for x in arg if str(x[0]) != "NEGATE"])
            out += chr(value if str(kind) == "LITERAL" else rng.randint(*value))
        elif name == "SUBPATTERN":
            out += sample_match(rng, arg[3])
        elif name == "BRANCH":
            out += sample_match(rng, rng.choice(arg[1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample_match(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
        elif name != "ASSERT_NOT":
            raise AssertionError(name)
    return out


def test_every_rule_is_tried_where_it_matches():
    rng, tried = random.Random(4), licenses.prefilter().tried
    for rule in licenses.rules():
        met = 0
        for _ in range(60):
            text = sample_match(rng, secrets.parser.parse(rule.pattern.pattern))
            if rule.pattern.search(text):
                met += 1
                assert rule.place in {r.place for r in tried(text)}, text
                wrapped = licenses.folded(text.replace(" ", "\n * ").encode()).decode()
                assert "  " in text or "*" in text or rule.place in {r.place for r in tried(wrapped)}, text
        assert met, rule.pattern.pattern


def test_matches_of_rules_resolve_alike_with_every_rule_tried():
    rng, rules = random.Random(6), licenses.rules()
    glue = [" ", "\n", ". ", "\n# ", "; or the ", " under the ", " licensed under the ", " license: ", "2", "v3"]
    for _ in range(300):
        low = "".join(sample_match(rng, secrets.parser.parse(rng.choice(rules).pattern.pattern)) + rng.choice(glue) for _ in range(rng.randint(1, 4))).encode()
        assert [(a, b, r.label) for a, b, r in licenses.detect(low)] == all_rules(licenses.folded(low), rules), low


def score(weights):
    rest = 1.0
    for w in weights:
        rest *= 1 - w
    return 1 - rest


def test_labels_and_scores_match_every_rule_tried(spark, sf_dir):
    rules = licenses.rules()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for i, row in by_id(registry.op9_license_scan(spark, sf_dir)).items():
        low = licenses.folded(ascii_lower(texts[i]).encode())
        weights = {x: licenses.BASE_WEIGHT for x in brute_license(texts[i])[4].split(",") if x}
        for _, _, r in kept_of(low, rules):
            weights[r.label] = max(weights.get(r.label, 0), r.weight)
        assert row["labels"] == ",".join(sorted(weights)) and abs(row["score"] - score(weights.values())) < 1e-8


def test_contained_detections_are_suppressed():
    found = licenses.detect(b"licensed under the apache license, version 2.0")
    assert [r.label for _, _, r in found] == ["apache-2"]


def kept_of(low, rules):
    """Detections by trying every rule: the earliest section, then the longest, then the earliest place and rule."""
    text = low.decode("utf-8", "replace")
    found = [(m.start(), m.end(), r) for r in rules for m in r.pattern.finditer(text)]
    kept = []
    for a, b, r in sorted(found, key=lambda d: (d[2].section, d[0] - d[1], d[0], d[2].place)):
        if not any(x <= a and b <= y for x, y, _ in kept):
            kept.append((a, b, r))
    return kept


def all_rules(low, rules):
    return [(a, b, r.label) for a, b, r in kept_of(low, rules)]


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("released under the gpl license", "gpl"),
        ("under the terms of the lgpl", "lgpl"),
        ("under the terms of the mpl 2.0", "mpl-2"),
        ("under the conditions of the expat license", "mit"),
        ("under the terms of creative commons attribution 4.0", "cc-by-4"),
        ("a creative commons attribution-sharealike license", "cc-by-sa"),
        ("distributed under the terms of the gplv3", "gpl-3"),
        ("under the terms of the mpl 2.0", "mpl-2"),
        ("mozilla public license 2.0", "mpl-2"),
        ("placed in the public domain", "public-domain"),
        ("permission is hereby granted, free of charge,\nto any person obtaining a copy", "mit"),
        ("the apache license, version 2.0", "apache-2"),
        ("released under the bsd 3-clause license", "bsd-3-clause"),
    ],
)
def test_abbreviations_need_no_other_word(text, label):
    assert label in [r.label for _, _, r in licenses.detect(text.encode())]


@pytest.mark.parametrize("gap", ["\n", "\r\n", "  ", "\n\n", " \t\n * ", "\n# ", "\n// ", "\n  ;; ", " *\n * ", " */\n/* ", "\n-- ", "\n *\n * ", "\n# # ", "\n> ", "\n//", "\n*", "\ndnl "])
def test_wrapped_notices_are_found(gap):
    for text, label in [
        ("permission to use, copy, modify, and distribute this software for any purpose", "isc"),
        ("licensed under the gnu lesser general public license, version 2.1", "lgpl-2.1"),
        ("redistribution and use in source and binary forms", "bsd"),
        ("released into the public domain", "public-domain"),
        ("neither the name of acme inc nor the names of its contributors", "bsd-3-clause"),
        ("this program is free software; you can redistribute it", "gpl"),
        ("all rights reserved", "proprietary"),
    ]:
        plain = [r.label for _, _, r in licenses.detect(text.encode())]
        wrapped = [r.label for _, _, r in licenses.detect(text.replace(" ", gap).encode())]
        assert label in plain and plain == wrapped, text
    assert [r.label for _, _, r in licenses.detect(b"neither the name of \n  nor the names of its contributors")] == ["bsd-3-clause"]


def test_keywords_lose_no_detection():
    names = ["gpl", "lgpl", "agpl", "gfdl", "gnu", "general public license", "affero general public licence", "mpl", "mozilla public license", "epl", "eupl", "cddl", "cpl", "afl", "osl", "zpl", "ms-pl", "ms-rl", "odbl", "upl", "sspl", "expat", "mit", "psf", "python", "cc-by-sa", "cc by", "cc-by-nc-nd", "creative commons attribution", "sharealike", "freebsd", "apache software license", "openrail-m", "zlib"]
    forms = ["under the terms of the ", "under conditions of ", "licensed under ", "license: ", " license", " licence", "spdx-license-identifier: ", " 2", " v3.0", ", version 2.1", " ", " ", "-only", "x", "this program is free software; you can redistribute it", "all rights reserved", "copyright (c) 2020"]
    rules = licenses.rules()
    for text in noise(names + forms, 400, 8, 3):
        low = text.encode()
        assert [(a, b, r.label) for a, b, r in licenses.detect(low)] == all_rules(licenses.folded(low), rules), text


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_queries_match_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for name, brute, base in (("op7_secret_scan", brute_secrets, secrets.BASE), ("op10_pii", brute_pii, pii.BASE)):
        rows = by_id(registry.QUERIES[name](spark, sf_dir))
        assert rows.keys() == texts.keys()
        for i, row in rows.items():
            spans = brute(texts[i])
            assert row["base_sha256"] == hashlib.sha256(joined(spans, base).encode()).hexdigest()
            assert [row[f"n_{k}"] for k in base] == [sum(s[0] == k for s in spans) for k in base]
            assert all(f"{k}:{a}:{b}" in row["spans"].split(",") for k, a, b in spans)
    rows = by_id(registry.QUERIES["op9_license_scan"](spark, sf_dir))
    for i, row in rows.items():
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == brute_license(texts[i])
        assert set(row["base_labels"].split(",")) - {""} <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1


@pytest.mark.parametrize("scan", [secrets.scan_secrets, pii.scan_personal_data, licenses.scan_licenses])
def test_edge_cases(scan, edge_docs, no_docs):
    rows = scan(edge_docs).collect()
    assert len(rows) == edge_docs.count() and scan(no_docs).count() == 0
    assert sum(r["doc_id"] is None for r in rows) == 1


def test_code_points_not_bytes(spark):
    df = spark.createDataFrame([(1, "ä€𝄞 a@b.de")], "doc_id long, text string")
    assert pii.scan_personal_data(df).first()["spans"] == "email:4:10"
    assert pii.redact(df).first()["text"] == "ä€𝄞 <email>"
