from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from runlens import queries
from runlens.functions import expressions as X
from runlens.functions import vectors as V
from runlens.sources import adapters as A


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"x {schema}").select(column).collect()]


def test_area(spark):
    assert values(spark, X.area(F.col("x")), ["a.rb", "/a.rb", "a/b/c.rb", None], "string") == [".", "", "a/b", "."]


def test_presence_keeps_the_text(spark):
    assert values(spark, X.presence(F.col("x")), [" a ", " \t\n", "", None], "string") == [" a ", None, None, None]


def test_signal(spark):
    rows = [("Invoice", "finalize", "marks it paid", "n"), ("Invoice", " ", "x", " named "), (None, None, None, "\n"), (None, "a", "b", None)]
    df = spark.createDataFrame(rows, "e string, a string, b string, n string")
    got = [r[0] for r in df.select(X.signal(*map(F.col, "eabn"))).collect()]
    assert [g and tuple(g) for g in got] == [("Invoice finalize marks it paid", "intent"), ("named", "name"), None, None]


@pytest.mark.parametrize(("seconds", "label"), [(None, "not reported"), (0.0, "0.00s"), (0.004, "< 0.01s"), (1.5, "1.50s"), (60.0, "1m"), (3600.0, "1h 0m"), (3725.0, "1h 2m 5s")])
def test_humanized_duration(spark, seconds, label):
    assert values(spark, X.humanized_duration(F.col("x")), [seconds], "double") == [label]


def duration_label(x):
    """The reference's label, with Ruby's Float#round and C's format."""
    if x is None or x < 60:
        return "not reported" if x is None else "< 0.01s" if 0 < x < 0.01 else f"{x:.2f}s"
    tenths = math.floor(x * 10) + (x * 10 % 1 >= 0.5)
    tenths += (tenths + 0.5) / 10 <= x
    whole = math.floor(tenths / 10 + 0.5)
    h, m, s = whole // 3600, whole % 3600 // 60, whole % 60
    return " ".join([f"{h}h"] * (h > 0) + [f"{m}m"] * (m > 0 or h > 0) + [f"{s}s"] * (s > 0))


def test_durations_round_as_c_does(spark):
    rng = random.Random(1)
    some = [k / 1000 for k in range(0, 60000, 5)] + [k / 8 for k in range(0, 600)] + [rng.uniform(0, 60) for _ in range(2000)]
    some += [rng.choice([rng.randrange(60000, 8000000) / 1000, rng.randrange(1200, 100000) / 20]) for _ in range(3000)] + [-1.005, -0.125, 59.995, 59.996, 60.45, 3599.96, 7199.5]
    assert values(spark, X.humanized_duration(F.col("x")), some, "double") == [duration_label(x) for x in some]


def test_every_row_of_the_run_has_its_label(spark, sf_dir):
    rows = A.observations(spark, sf_dir).filter(F.col("test_run_id") == queries.RUN).select("id", "duration_seconds").collect()
    got = {r["id"]: r["label"] for r in queries.QUERIES["duration_labels_of_all_rows"](spark, sf_dir).collect()}
    assert got == {r["id"]: duration_label(r["duration_seconds"]) for r in rows}
    assert "long" not in got.values() and any("m" in label for label in got.values())


def test_seconds_per_test(spark):
    assert values(spark, X.seconds_per_test(F.col("x")), [2.25, 0.0123, 0.00001, None], "double") == ["2.3s/test", "12.3ms/test", "under 0.1ms/test", None]


def test_changes_and_counts(spark):
    assert values(spark, X.signed_change(F.col("x")), [0, 1234, -5], "long") == ["±0", "+1,234", "−5"]
    assert values(spark, X.counted(F.col("x"), "example"), [1, 2000], "long") == ["1 example", "2,000 examples"]


def test_names(spark):
    assert values(spark, X.full_name(F.col("x")), [" https://github.com/a/b.git ", "a/b/", " "], "string") == ["a/b", "a/b", None]
    assert values(spark, X.full_name_valid(F.col("x")), ["a/b", "a", "-a/b"], "string") == [True, False, False]
    df = spark.createDataFrame([("a/b", "s p/ä.rb", 3, "x/y")], "n string, p string, l int, r string")
    assert df.select(X.blob_url(F.col("n"), F.col("p"), F.col("l"), F.col("r"))).first()[0] == "https://github.com/a/b/blob/x/y/s%20p/%C3%A4.rb#L3"


def test_ratios_guard_zero(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(X.ratio_percent(F.col("a"), F.col("b"))).collect()] == [33.3, 0.0, 0.0]
    assert [r[0] for r in df.select(X.ratio(F.col("a"), F.col("b"))).collect()] == [0.333, None, None]


def test_truncated(spark):
    assert values(spark, X.truncated(F.col("x"), 5), ["abcde", "abcdef", None], "string") == ["abcde", "ab...", None]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in df.select(V.normalised(F.col("v"))).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] is None
    assert [r[0] for r in df.select(V.valid(F.col("v"), 2)).collect()] == [True, True]
    a, b = V.lexical_vector("voids an unpaid invoice"), V.lexical_vector("Voids an unpaid invoice!")
    assert a @ b == pytest.approx(1) and abs(a @ V.lexical_vector("renders the footer")) < 0.5
