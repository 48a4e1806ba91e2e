"""The catalogue's questions about single values: texts, numbers and vectors over the local test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import expressions as X
from .functions import vectors as V
from .queries import query, rounded
from .sources import adapters as A


@query(
    r"""WITH raw AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' https://github.com/Acme/' || replace(c_name, '#', '.') || '.git ' WHEN 1 THEN 'acme/' || c_name WHEN 2 THEN 'acme/x_' || CAST(c_custkey AS VARCHAR) || '/' ELSE '  ' END AS value FROM customer),
named AS (SELECT c_custkey, nullif(regexp_replace(regexp_replace(regexp_replace(trim(value), '^https://github\.com/', ''), '\.git$', ''), '/$', ''), '') AS full_name FROM raw)
SELECT c_custkey, full_name, regexp_full_match(full_name, '[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?/[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?') AS valid, split_part(full_name, '/', -1) AS last_segment,
'https://github.com/' || full_name || '/blob/main%20line/spec/f%20' || CAST(c_custkey % 10 AS VARCHAR) || '~%2A%2B_spec.rb#L' || CAST(c_custkey AS VARCHAR) AS url FROM named""",
    base=False,
)
def repository_names(spark, sf_dir):
    """Addresses as full names, whether those are valid, and links to a line of a file."""
    c, key = A.table(spark, sf_dir, "customer"), F.col("c_custkey")
    value = (
        F.when(key % 4 == 0, F.concat(F.lit(" https://github.com/Acme/"), F.regexp_replace("c_name", "#", "."), F.lit(".git ")))
        .when(key % 4 == 1, F.concat(F.lit("acme/"), F.col("c_name")))
        .when(key % 4 == 2, F.concat(F.lit("acme/x_"), key.cast("string"), F.lit("/")))
        .otherwise("  ")
    )
    name = X.full_name(value)
    path = F.concat(F.lit("spec/f "), (key % 10).cast("string"), F.lit("~*+_spec.rb"))
    return c.select("c_custkey", name.alias("full_name"), X.full_name_valid(name).alias("valid"), X.last_segment(name).alias("last_segment"), X.blob_url(name, path, key, F.lit("main line")).alias("url"))


@query(
    """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity,
CAST(l_linenumber AS VARCHAR) || ' of ' || CAST(l_partkey AS VARCHAR) AS coverage, format('{:,}', l_partkey) || CASE WHEN l_partkey = 1 THEN ' example' ELSE ' examples' END AS counted,
CASE WHEN change = 0 THEN '±0' WHEN change < 0 THEN '−' || format('{:,}', -change) ELSE '+' || format('{:,}', change) END AS change,
CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'N' THEN 'success' ELSE 'neutral' END AS tone,
CASE WHEN length(words) > 12 THEN words[1:9] || '...' ELSE words END AS short, CASE WHEN l_partkey = 0 THEN 0.0 ELSE round(l_linenumber / l_partkey * 100, 1) END AS percent,
CASE WHEN l_partkey <> 0 THEN round(l_linenumber / l_partkey, 3) END AS share, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS shipped,
CASE WHEN l_linenumber = 7 THEN 15.0 ELSE 30 - (l_quantity - 1) / 49 * 30 END AS y, least(greatest(l_extendedprice * 100 / 50000, 0), 100) AS width
FROM (SELECT *, l_partkey - l_suppkey * 20 AS change, l_returnflag || ' part ' || CAST(l_partkey AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN ' again' ELSE '' END AS words FROM lineitem)""",
    base=False,
)
def value_labels(spark, sf_dir):
    """Lines as figures: coverage, counts, signed changes, tones, shortened texts, ratios, times, places in a chart."""
    rows = A.table(spark, sf_dir, "lineitem")
    change = F.col("l_partkey") - F.col("l_suppkey") * 20
    words = F.concat(F.col("l_returnflag"), F.lit(" part "), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " again").otherwise(""))
    outcome = F.when(F.col("l_returnflag") == "A", "failed").when(F.col("l_returnflag") == "N", "passed")
    flat = F.col("l_linenumber") == 7
    out = rows.select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        "l_quantity",
        X.coverage_label(F.col("l_linenumber"), F.col("l_partkey")).alias("coverage"),
        X.counted(F.col("l_partkey"), "example").alias("counted"),
        X.signed_change(change).alias("change"),
        X.outcome_tone(outcome).alias("tone"),
        X.truncated(words, 12).alias("short"),
        X.ratio_percent(F.col("l_linenumber"), F.col("l_partkey")).alias("percent"),
        X.ratio(F.col("l_linenumber"), F.col("l_partkey")).alias("share"),
        X.iso_time(F.col("l_shipdate")).alias("shipped"),
        X.scaled(F.col("l_quantity"), F.when(flat, 5.0).otherwise(1.0), F.when(flat, 5.0).otherwise(50.0), 30.0).alias("y"),
        X.clamped_percent(F.col("l_extendedprice"), F.lit(50000.0)).alias("width"),
    )
    return out


@query("""SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value >= 1 THEN printf('%.1f', round(value, 1)) || 's/test' WHEN round(value * 1000, 1) > 0 THEN printf('%.1f', round(value * 1000, 1)) || 'ms/test' ELSE 'under 0.1ms/test' END AS rate,
CASE WHEN value < 60 THEN NULL ELSE concat_ws(' ', CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || 'h' END, CASE WHEN s >= 60 THEN CAST(s % 3600 // 60 AS VARCHAR) || 'm' END, CASE WHEN s % 60 > 0 THEN CAST(s % 60 AS VARCHAR) || 's' END) END AS long_label
FROM (SELECT event_id, value, CAST(floor(round(value, 1) + 0.5) AS BIGINT) AS s FROM (SELECT event_id, value * 40 AS value FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, value / 100000 FROM events WHERE event_id % 3 = 0))""", base=False)  # fmt: skip
def duration_rates(spark, sf_dir):
    """Seconds a test, and hours, minutes and seconds, of stretched and shrunk values."""
    e = A.table(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 3 != 0, F.col("value") * 40).otherwise(F.col("value") / 100000)
    rows = e.select("event_id", v.alias("v"))
    return rows.select("event_id", X.seconds_per_test(F.col("v")).alias("rate"), F.when(F.col("v") >= 60, X.humanized_seconds(F.col("v"))).alias("long_label"))


@query("""SELECT c_custkey, handle, NOT contains(handle, '--') AND NOT contains(handle, '#') AS valid, 'customer ' || CASE WHEN c_custkey % 2 = 0 THEN substr(c_name, 10) ELSE substr(c_name, 10) || ' ñandú 7' END AS form
FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN lower(c_name) WHEN 1 THEN lower(replace(c_name, '#', '-')) ELSE lower(replace(c_name, '#', '--')) END AS handle FROM customer)""", base=False)  # fmt: skip
def handles_and_forms(spark, sf_dir):
    """Names as handles, whether those are valid, and the lexical form of a text."""
    c, key = A.table(spark, sf_dir, "customer"), F.col("c_custkey")
    value = F.when(key % 3 == 0, F.col("c_name")).when(key % 3 == 1, F.regexp_replace("c_name", "#", "-")).otherwise(F.regexp_replace("c_name", "#", "--"))
    found = X.handle(F.concat(F.lit(" "), value, F.lit(" ")))
    text = F.concat(F.lit("--"), F.col("c_name"), F.when(key % 2 == 0, "!").otherwise("  Ñandú, (7)"))
    return c.select("c_custkey", found.alias("handle"), X.handle_valid(found).alias("valid"), X.lexical(text).alias("form"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Order ' || event_type || ' runs for user ' || CAST(user_id AS VARCHAR) WHEN event_id % 7 <> 0 THEN 'test ' || CAST(user_id AS VARCHAR) END AS text,
CASE WHEN event_id % 5 = 0 THEN 'intent' WHEN event_id % 7 <> 0 THEN 'name' END AS source FROM events""", base=False)  # fmt: skip
def signals_of_both_sources(spark, sf_dir):
    """The text that stands for a test: of its intent where that is whole, else of its name, else none."""
    e, n = A.table(spark, sf_dir, "events"), F.col("event_id")
    entity, action = F.when(n % 5 == 0, " Order ").when(n % 2 == 0, " "), F.col("event_type")
    behavior = F.when(n % 5 == 0, F.concat(F.lit("runs for user "), F.col("user_id").cast("string"))).otherwise("x")
    name = F.when(n % 7 == 0, "  ").otherwise(F.concat(F.lit("test "), F.col("user_id").cast("string"), F.lit(" ")))
    found = e.select("event_id", X.signal(entity, action, behavior, name).alias("s"))
    return found.select("event_id", F.col("s.text").alias("text"), F.col("s.source").alias("source"))


@query("""SELECT vec_id, round(list_dot_product(e, e), 6) AS square, len(e) = 64 AND vec_id % 10 <> 0 AS valid, round(list_dot_product(e, list_reverse(e)) / list_dot_product(e, e), 6) AS mirrored
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""", base=False)  # fmt: skip
def vector_values(spark, sf_dir):
    """Products of vectors, and whether a provider's vector is whole; one in ten here holds a number that is not finite."""
    e = A.table(spark, sf_dir, "embeddings")
    spoilt = F.when(F.col("vec_id") % 20 == 0, float("nan")).when(F.col("vec_id") % 10 == 0, float("inf"))
    held = F.transform("embedding", lambda x, i: F.when((i == 3) & spoilt.isNotNull(), spoilt.cast("float")).otherwise(x))
    unit = V.normalised(F.col("embedding"))
    rows = e.select("vec_id", V.dot(F.col("embedding"), F.col("embedding")).alias("square"), V.valid(held, 64).alias("valid"), V.dot(unit, F.reverse(unit)).alias("mirrored"))
    return rounded(rows, "square", "mirrored")
