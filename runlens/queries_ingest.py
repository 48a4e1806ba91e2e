"""The catalogue's questions about deliveries, keys, members and caches, over the local test tables, with their SQL."""

from __future__ import annotations

import gzip
from datetime import timedelta

import pandas as pd
from pyspark.sql import functions as F

from .functions.providers import Provider, by_index, embed_texts
from .operators import clusters, identity, ingest, nearest, partials, retention, runs, tenancy
from .plans.storage import fresh_path, write_table
from .queries import NOW, ORACLES, branch_window, query, rounded, text_lists
from .sources import adapters as A
from .sources.bodies import CORRUPT, FILES, NOT_JSON, inflates, texts_of
from .streaming.ingest import add_deliveries, check_deliveries, refresh_partials
from .streaming.store import Tables

#: Orders as deliveries and their lines as examples: the adapter's rules in SQL.
DELIVERIES_SQL = """WITH d AS (
  SELECT o_custkey % 7 AS repository_id, '=r' || CAST(o_custkey AS VARCHAR) AS run_key, '=s' || CAST(o_orderkey % 3 AS VARCHAR) AS shard_key, o_orderkey AS delivery_seq,
         'c' || CAST(o_orderkey AS VARCHAR) AS commit_sha, o_totalprice AS duration_seconds, o_orderdate AS received_at
  FROM orders
), lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS position FROM lineitem
), specs AS (
  SELECT d.*, position, CASE WHEN l_linenumber <> 7 THEN CAST(l_partkey % 50 AS VARCHAR) END AS example_id, 'spec/f' || CAST(l_suppkey % 5 AS VARCHAR) || '_spec.rb' AS spec_file_path,
         l_linenumber AS line_number, 'part ' || CAST(l_partkey % 50 AS VARCHAR) AS name, l_quantity AS seconds, CASE WHEN l_linenumber = 1 THEN 'annotated' ELSE 'unannotated' END AS status
  FROM d JOIN lines ON l_orderkey = delivery_seq
), shards AS (
  SELECT repository_id, run_key, shard_key, arg_max(duration_seconds, delivery_seq) AS duration_seconds, max(delivery_seq) AS delivery_seq FROM d GROUP BY ALL
), sized AS (
  SELECT s.*, count(l.position) AS total_specs_count, count(l.position) FILTER (WHERE l_linenumber = 1) AS annotated_specs_count
  FROM shards s LEFT JOIN lines l ON l_orderkey = delivery_seq GROUP BY ALL
)
"""


def delivery_query(sql: str):
    return query(DELIVERIES_SQL + sql, base=False)


@delivery_query("SELECT repository_id, run_key, arg_min(commit_sha, delivery_seq) AS commit_sha, min(delivery_seq) AS delivery_seq FROM d GROUP BY ALL")
def ingest_runs(spark, sf_dir):
    """Runs found or created: what the first delivery of each said."""
    return ingest.run_rows(A.deliveries(spark, sf_dir)).select("repository_id", "run_key", "commit_sha", "delivery_seq")


@delivery_query("SELECT repository_id, run_key, shard_key, duration_seconds, CAST(total_specs_count AS INTEGER) AS total_specs_count, CAST(annotated_specs_count AS INTEGER) AS annotated_specs_count, delivery_seq FROM sized")
def ingest_shards(spark, sf_dir):
    """Shards upserted: the last delivery of each."""
    rows = ingest.shard_rows(A.deliveries(spark, sf_dir))
    return rows.select("repository_id", "run_key", "shard_key", "duration_seconds", "total_specs_count", "annotated_specs_count", "delivery_seq")


@delivery_query("""SELECT repository_id, run_key, CAST(sum(total_specs_count) AS INTEGER) AS total_specs_count, CAST(sum(annotated_specs_count) AS INTEGER) AS annotated_specs_count,
max(duration_seconds) AS duration_seconds FROM sized GROUP BY ALL""")
def ingest_run_totals(spark, sf_dir):
    """Run totals derived from the shards."""
    return ingest.derived_totals(ingest.shard_rows(A.deliveries(spark, sf_dir)), ("repository_id", "run_key"))


#: Of an accepted delivery, what ingest reads: not the text, nor the body that it was parsed into.
DELIVERED = [*ingest.SHARD_KEYS, "ci_run_id", "shard_id", "commit_sha", "branch", "duration_seconds", "specs", "total_specs_count", "annotated_specs_count", "received_at", "delivery_seq"]
OBSERVED = ["repository_id", "run_key", "shard_key", "delivery_seq", "position", "example_id", "spec_file_path", "line_number", "name", "status", "created_at"]


@delivery_query("""SELECT repository_id, run_key, shard_key, delivery_seq, CAST(position AS INTEGER) AS position, example_id, spec_file_path, line_number, name, status, received_at AS created_at, seconds AS duration_seconds
FROM specs QUALIFY row_number() OVER (PARTITION BY delivery_seq, coalesce(example_id, '#' || CAST(position AS VARCHAR)) ORDER BY position) = 1""")
def ingest_observations(spark, sf_dir):
    """Rows built from payloads: of equal ids in one payload the first."""
    return ingest.observation_rows(A.deliveries(spark, sf_dir)).select(*OBSERVED, "duration_seconds")


BATCH = """(SELECT s.* FROM specs s JOIN (SELECT repository_id, run_key, shard_key, max(delivery_seq) AS delivery_seq FROM d WHERE {0} GROUP BY ALL) USING (repository_id, run_key, shard_key, delivery_seq)
QUALIFY row_number() OVER (PARTITION BY delivery_seq, coalesce(example_id, '#' || CAST(position AS VARCHAR)) ORDER BY position) = 1)"""
ONE_EACH = """SELECT * FROM {0} b WHERE example_id IS NULL UNION ALL
(SELECT * FROM {0} b WHERE example_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repository_id, run_key, example_id ORDER BY delivery_seq DESC) = 1)"""
EARLY, LATE = (f"delivery_seq {op} (SELECT max(delivery_seq) // 2 FROM d)" for op in ("<=", ">"))


@delivery_query(
    f""", one AS ({ONE_EACH.format(BATCH.format(EARLY))}), two AS ({ONE_EACH.format(BATCH.format(LATE))}),
again AS (SELECT DISTINCT repository_id, run_key, shard_key FROM d WHERE {LATE}),
rest AS (SELECT * FROM one ANTI JOIN again USING (repository_id, run_key, shard_key))
SELECT repository_id, run_key, shard_key, delivery_seq, CAST(position AS INTEGER) AS position, example_id, spec_file_path, line_number, name, status, received_at AS created_at FROM rest
WHERE example_id IS NULL OR (repository_id, run_key, example_id) NOT IN (SELECT (repository_id, run_key, example_id) FROM two WHERE example_id IS NOT NULL)
UNION ALL
SELECT t.repository_id, t.run_key, t.shard_key, t.delivery_seq, CAST(t.position AS INTEGER), t.example_id, t.spec_file_path, t.line_number, t.name, t.status, coalesce(r.received_at, t.received_at)
FROM two t LEFT JOIN rest r ON t.example_id IS NOT NULL AND r.repository_id = t.repository_id AND r.run_key = t.run_key AND r.example_id = t.example_id"""
)
def ingest_two_batches(spark, sf_dir):
    """Two batches merged: redelivered shards are replaced, late shards added, a moved example keeps when it was first recorded."""
    sent = write_table(A.deliveries(spark, sf_dir).select(*DELIVERED), "sent")  # each body is looked into once
    middle = sent.agg(F.floor(F.max("delivery_seq") / 2)).first()[0]
    early, late = (sent.filter(c) for c in (F.col("delivery_seq") <= middle, F.col("delivery_seq") > middle))
    rows = [ingest.observation_rows(ingest.newest_of_shards(part)) for part in (early, late)]
    first = write_table(ingest.merge_observations(rows[0].limit(0), rows[0], early), "first")  # read by both sides of the second merge
    return ingest.merge_observations(first, rows[1], late).select(*OBSERVED)


@query(
    """SELECT repository_id, occurred_at, array_to_string(errors, '; ') AS details, CAST(len(errors) AS INTEGER) AS total_reasons_count,
CASE WHEN 280 + o_orderkey % 40 > 300 THEN repeat('x', 297) || '...' ELSE repeat('x', CAST(280 + o_orderkey % 40 AS INTEGER)) END AS user_agent
FROM (SELECT o_orderkey, o_custkey AS repository_id, o_orderdate AS occurred_at, list_filter([
  CASE WHEN o_orderkey % 10 = 0 THEN 'commit_sha is required and must be a non-empty string' END,
  CASE WHEN o_orderkey % 4 = 0 THEN 'branch must be a string when present' END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'duration_seconds must be a non-negative number when present' END,
  CASE WHEN o_orderkey % 13 = 0 THEN 'specs is required and must be an array'
       WHEN o_orderkey % 3 = 0 THEN 'specs[0] spec/a_spec.rb:' || CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '1.5' END || ': line_number is required and must be a positive integer' END
], lambda x: x IS NOT NULL) AS errors FROM orders) WHERE len(errors) > 0""",
    base=False,
)
def ingest_rejections(spark, sf_dir):
    """Orders as deliveries with faults: what each is refused for, in order."""
    o, key = A.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    line = F.when(key % 3 != 0, "3").when(key % 2 == 0, "0").otherwise("1.5")
    body = F.concat(
        F.lit('{"commit_sha":'), F.when(key % 10 == 0, '" "').otherwise(F.concat(F.lit('"c'), key.cast("string"), F.lit('"'))),
        F.lit(',"branch":'), F.when(key % 4 == 0, "7").otherwise('"main"'),
        F.lit(',"duration_seconds":'), F.when(key % 11 == 0, "-1").otherwise("2.5"),
        F.lit(',"specs":'), F.when(key % 13 == 0, "{}").otherwise(F.concat(F.lit('[{"file_path":"spec/a_spec.rb","name":"n","status":"unannotated","line_number":'), line, F.lit("}]"))), F.lit("}"),
    )
    rows = o.select(F.col("o_custkey").alias("repository_id"), F.col("o_orderdate").alias("occurred_at"), body.alias("value"), F.expr("repeat('x', int(280 + o_orderkey % 40))").alias("user_agent"))
    found = ingest.rejections(ingest.validate(rows))
    return found.withColumn("details", F.array_join("details", "; "))


@query(
    """SELECT c_custkey, array_to_string(list_filter([
  CASE WHEN c_custkey % 5 = 0 THEN 'object at root is missing required properties: ' || CASE WHEN c_custkey % 2 = 0 THEN 'action' ELSE 'action, layer' END END,
  CASE WHEN c_custkey % 3 = 0 THEN 'string length at `/entity` is less than: 2' END,
  CASE WHEN c_custkey % 7 = 0 THEN 'value at `/behavior` is not a string' WHEN c_custkey % 4 = 0 THEN 'string length at `/behavior` is less than: 15' END,
  CASE WHEN c_custkey % 10 <> 5 AND c_mktsegment = 'BUILDING' THEN 'value at `/layer` is not one of the layers' END,
  CASE WHEN c_custkey % 11 = 0 THEN 'object property at `/severity` is a disallowed additional property' END
], lambda x: x IS NOT NULL), '; ') AS errors FROM customer""",
    base=False,
)
def intent_contract(spark, sf_dir):
    """Customers as annotations with faults: every violation of the contract."""
    c, key = A.table(spark, sf_dir, "customer"), F.col("c_custkey")
    intent = F.concat(
        F.lit('{"entity":'), F.when(key % 3 == 0, '"I"').otherwise('"Invoice"'), F.when(key % 5 != 0, ',"action":"finalize"').otherwise(""),
        F.lit(',"behavior":'), F.when(key % 7 == 0, "5").when(key % 4 == 0, '"too short"').otherwise('"marks the invoice as paid"'),
        F.when(key % 10 == 5, "").when(F.col("c_mktsegment") == "BUILDING", ',"layer":"acceptance"').otherwise(',"layer":"unit"'),
        F.when(key % 11 == 0, ',"severity":"high"').otherwise(""), F.lit("}"),
    )
    rows = c.select("c_custkey", F.try_parse_json(intent).alias("intent"))
    return rows.select("c_custkey", F.array_join(ingest.intent_errors(F.col("intent")), "; ").alias("errors"))


# ------------------------------------------------------------------ caches, identities, clusters

CACHE_SQL = """WITH texts AS (SELECT DISTINCT p_name AS text, sha256(p_name) AS text_digest, length(p_name) AS n FROM part),
held AS (SELECT text_digest, n, CASE n % 3 WHEN 0 THEN 0 WHEN 1 THEN 90 ELSE 91 END AS age FROM texts WHERE n % 4 <> 0)
"""


def _cache(spark, sf_dir):
    """Part names as texts; entries of three ages for most of them, under one fingerprint, and others under another."""
    texts = A.table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).distinct().withColumn("text_digest", F.sha2("text", 256))
    n = F.length("text")
    age = F.when(n % 3 == 0, 0).when(n % 3 == 1, 90).otherwise(91)
    at = F.lit(NOW) - F.make_interval(days=age)
    held = texts.filter(n % 4 != 0).select(F.lit("p").alias("provider_fingerprint"), "text_digest", F.array((-n).cast("float")).alias("embedding"), at.alias("created_at"), at.alias("updated_at"))
    return texts, held.unionByName(held.withColumn("provider_fingerprint", F.lit("q")))


@query(CACHE_SQL + "SELECT t.text, CASE WHEN age <= 90 THEN -t.n ELSE t.n END AS first_number FROM texts t LEFT JOIN held USING (text_digest)", base=False)
def embeddings_through_cache(spark, sf_dir):
    """Live entries of the provider are read, only the rest is embedded."""
    texts, cache = _cache(spark, sf_dir)
    found, _ = identity.cached_vectors(texts, cache, "p", NOW, lambda text: F.array(F.length(text).cast("float")))
    return found.select("text", F.col("embedding")[0].cast("long").alias("first_number"))


@query(CACHE_SQL + """SELECT 'q' AS provider_fingerprint, count(*) AS n, count(*) FILTER (WHERE age = 0) AS fresh FROM held
UNION ALL SELECT 'p', count(*), count(*) FILTER (WHERE age IS NULL OR age <> 90) FROM texts LEFT JOIN held USING (text_digest)""", base=False)  # fmt: skip
def embedding_cache_after(spark, sf_dir):
    """The cache afterwards: what was embedded is written anew, all else stays."""
    texts, cache = _cache(spark, sf_dir)
    _, after = identity.cached_vectors(texts, cache, "p", NOW, lambda text: F.array(F.length(text).cast("float")))
    return after.groupBy("provider_fingerprint").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("updated_at") == F.lit(NOW)).alias("fresh"))


def _lengths(texts):
    """Vectors of a text's length, out of order as a service may send them."""
    answers = [{"index": k, "embedding": [float(len(t)), 0.0]} for k, t in enumerate(texts)]
    return by_index(reversed(answers))


def _down(texts):
    raise ConnectionError("down")


@query("SELECT p_name AS text, CAST(length(p_name) AS BIGINT) AS first_number, TRUE AS refused_by_the_other FROM (SELECT DISTINCT p_name FROM part)", base=False)
def embeddings_by_provider(spark, sf_dir):
    """All part names asked of a provider that answers, and of one that is down: each text has its own vector, and the error of the other."""
    texts = _cache(spark, sf_dir)[0]
    good, bad = (embed_texts(texts, Provider(name, f, width=2)) for name, f in (("lengths", _lengths), ("down", _down)))
    both = good.filter("error is null").join(bad.filter("embedding is null and error is not null").select("text_digest", "error").withColumnRenamed("error", "other"), "text_digest")
    return both.select("text", F.col("embedding")[0].cast("long").alias("first_number"), F.col("other").isin("down", "not asked: down").alias("refused_by_the_other"))


@query(CACHE_SQL + "SELECT 2 * count(*) FILTER (WHERE age <= 90) AS live, 2 * count(*) FILTER (WHERE age > 90) AS expired FROM held", base=False)
def cache_expiry(spark, sf_dir):
    """Entries used within 90 days, the day itself included, are live."""
    _, cache = _cache(spark, sf_dir)
    counts = [f(cache, NOW).agg(F.count(F.lit(1)).alias(name)) for f, name in ((retention.live_cache, "live"), (retention.expired_cache, "expired"))]
    return counts[0].join(counts[1])


@query(
    """WITH u AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e FROM embeddings)
SELECT 't' || CAST(t.id AS VARCHAR) AS text_digest, CAST(k.id AS BIGINT) AS identity_id, round(list_dot_product(t.e, k.e), 6) AS similarity FROM u t, u k
WHERE t.id % 20 = 0 AND k.id % 20 <> 0 AND list_dot_product(t.e, k.e) >= 0.3 QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY list_dot_product(t.e, k.e) DESC, k.id) = 1""",
    base=False,
)
def nearest_committed(spark, sf_dir):
    """Every twentieth vector as a new text, against all others as identities."""
    known = A.identities(spark, sf_dir)
    texts = known.filter("id % 20 = 0").withColumn("text_digest", F.concat(F.lit("t"), F.col("id").cast("string")))
    found = identity.nearest_committed(texts, known.filter("id % 20 <> 0"), 0.3)
    return rounded(found.drop("repository_id"), "similarity")


@query(ORACLES["near_duplicate_pairs"], base=False)
def near_duplicate_pairs_by_rings(spark, sf_dir):
    """The nearest neighbours of each vector, comparing only what the cells leave possible."""
    return rounded(clusters.near_duplicate_pairs_by_rings(A.identities(spark, sf_dir), similarity=0.40), "similarity")


@query(ORACLES["nearest_committed"], base=False)
def nearest_by_cells(spark, sf_dir):
    """The same by an index of cells, searched where a match may lie."""
    known = A.identities(spark, sf_dir)
    texts = known.filter("id % 20 = 0").withColumn("text_digest", F.concat(F.lit("t"), F.col("id").cast("string")))
    known = known.filter("id % 20 <> 0")
    centres = clusters.cell_centres(known, 64, 4000)
    index = write_table(nearest.entries(known, centres), "index")
    found = nearest.matches(texts, index, centres, 0.3)
    return rounded(found.drop("repository_id"), "similarity")


#: A number for an order that doesn't grow with it, so that a component's least number lies anywhere in it.
MIXED = "({0} * 48271) % 2147483647"


@query(
    f"""WITH e AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_partkey % 3 = 0), g AS (SELECT k, k - row_number() OVER (ORDER BY k) AS island FROM e),
n AS (SELECT island, k FROM g UNION SELECT island, k + 1 FROM g) SELECT {MIXED.format("k")} AS id, min({MIXED.format("k")}) OVER (PARTITION BY island) AS component FROM n""",
    base=False,
)
def component_nodes(spark, sf_dir):
    """Orders linked with the next one by a line of every third part: chains, whose components SQL finds as islands."""
    first = A.table(spark, sf_dir, "lineitem").filter("l_partkey % 3 = 0").select(F.col("l_orderkey").cast("long").alias("k")).distinct()
    edges = first.select(F.expr(MIXED.format("k")).alias("id"), F.expr(MIXED.format("(k + 1)")).alias("neighbour_id"))
    return clusters.connected_components(edges.unionByName(edges.select(F.col("neighbour_id").alias("id"), F.col("id").alias("neighbour_id"))))


@query(
    f"""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 2 THEN '{CORRUPT}' WHEN 4 THEN '{CORRUPT}' WHEN 5 THEN '{inflates(1 << 20)}' WHEN 6 THEN '{NOT_JSON}' END AS reason,
CASE WHEN o_orderkey % 8 IN (0, 1, 3, 7) THEN 'c' || CAST(o_custkey AS VARCHAR) END AS commit_sha FROM orders""",
    base=False,
)
def body_outcomes(spark, sf_dir):
    """Orders as files of bodies: plain, gzip, no gzip, two members, cut short, a bomb, prose after the JSON, a repeated key."""
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    files = o.mapInPandas(_body_files, FILES)
    checked = check_deliveries(texts_of(files, 1 << 20))
    reason = F.when(F.size("errors") > 0, F.col("errors")[0])
    sha = F.when(F.size("errors") == 0, F.try_variant_get("body", "$.commit_sha", "string"))
    return checked.select(F.col("repository_id").alias("o_orderkey"), reason.alias("reason"), sha.alias("commit_sha"))


def _body_files(frames):
    bomb = gzip.compress(bytes(2 << 20))
    for frame in frames:
        rows = []
        for key, customer in zip(frame["o_orderkey"].tolist(), frame["customer"], strict=True):
            text = f'{{"commit_sha":"c{customer}","specs":[]}}'.encode()
            packed, kind = gzip.compress(text), key % 8
            raw = [text, packed, text, packed + packed, packed[:-9], bomb, text + b" and prose", b'{"commit_sha":"first",' + text[1:]][kind]
            rows.append((f"{key}.json{'.gz' if 1 <= kind <= 5 else ''}", pd.Timestamp(0, tz="UTC"), len(raw), raw, key))
        yield pd.DataFrame(rows, columns=["path", "modificationTime", "length", "content", "repository_id"])


@query(ORACLES["ingest_two_batches"], base=False)
def stored_two_batches(spark, sf_dir):
    """The same two batches added to stored tables, merged when read."""
    return _stored(spark, sf_dir, 2).select(*OBSERVED)


@query(ORACLES["ingest_two_batches"], base=False)
def stored_and_compacted(spark, sf_dir):
    """Once more, with the segments of both batches merged into one before they are read."""
    return _stored(spark, sf_dir, 2, compact=True).select(*OBSERVED)


def _stored(spark, sf_dir, fanout, compact=False):
    return _stored_tables(spark, sf_dir, fanout, compact).read("observations")


def _stored_tables(spark, sf_dir, fanout, compact=False, follow=False):
    sent = write_table(A.deliveries(spark, sf_dir).select(*DELIVERED), "sent")
    middle = sent.agg(F.floor(F.max("delivery_seq") / 2)).first()[0]
    none = spark.createDataFrame([], "repository_id long, occurred_at timestamp, details array<string>, total_reasons_count int, user_agent string, id long")
    tables = Tables(spark, fresh_path(spark, "stored"), fanout)
    for part in (sent.filter(F.col("delivery_seq") <= middle), sent.filter(F.col("delivery_seq") > middle)):
        add_deliveries(tables, part, none)
        if follow:
            refresh_partials(tables)
    if compact:
        tables.compact()
    return tables


def _added_up(name: str) -> str:
    """The examples after both batches, added up within their runs."""
    by = {"run_facts": [], "run_names": ["name", "spec_file_path"], "run_areas": ["regexp_replace(spec_file_path, '/[^/]*$', '') AS directory"]}[name]
    named = ", CAST(count(name) AS BIGINT) AS named_count" if name == "run_facts" else ""
    return f"SELECT {', '.join(['repository_id', 'run_key', *by])}, count(*) AS recorded_count{named} FROM ({ORACLES['ingest_two_batches']}) GROUP BY ALL"


@query(_added_up("run_facts"), base=False)
def stored_run_facts(spark, sf_dir):
    """Totals of runs, kept up batch by batch: a run of both batches is added up anew by the second."""
    facts = _stored_tables(spark, sf_dir, 2, follow=True).read("run_facts")
    return facts.filter("recorded_count > 0").select("repository_id", "run_key", "recorded_count", "named_count")


@query(_added_up("run_names"), base=False)
def stored_run_names(spark, sf_dir):
    """Descriptions of runs by file, kept up batch by batch and merged."""
    return _stored_tables(spark, sf_dir, 2, compact=True, follow=True).read("run_names").select("repository_id", "run_key", "name", "spec_file_path", "recorded_count")


@query(_added_up("run_areas"), base=False)
def stored_run_areas(spark, sf_dir):
    """Areas of runs, kept up batch by batch."""
    return _stored_tables(spark, sf_dir, 2, follow=True).read("run_areas").select("repository_id", "run_key", "directory", "recorded_count")


def _partials(spark, sf_dir, rows):
    """All runs added up once, and written; the questions read these tables only."""
    return partials.Partials.of({name: write_table(partials.partial(rows, name), name) for name in partials.WITHIN})


@query(ORACLES["window_outcome_reporting_branch_window"], base=False)
def window_outcome_reporting_from_partials(spark, sf_dir):
    return partials.window_outcome_reporting(_partials(spark, sf_dir, A.observations(spark, sf_dir)), branch_window(spark, sf_dir))


@query(ORACLES["unstable_tests_branch_window"], base=False)
def unstable_tests_from_partials(spark, sf_dir):
    """The branch's whole window, from what its runs were added up to."""
    found = partials.unstable_tests(_partials(spark, sf_dir, A.first_observations(spark, sf_dir)), branch_window(spark, sf_dir))
    return text_lists(found, "outcomes", "file_paths")


@query(ORACLES["slowest_tests_window_branch_window"], base=False)
def slowest_tests_from_partials(spark, sf_dir):
    found = partials.slowest_tests(_partials(spark, sf_dir, A.observations(spark, sf_dir)), branch_window(spark, sf_dir))
    return text_lists(rounded(found, "total_seconds"), "names", "file_paths")


@query(ORACLES["directory_window_growth_branch_window"], base=False)
def directory_growth_from_partials(spark, sf_dir):
    """The newest run of the branch against the oldest like it, by areas."""
    window = runs.suite_size_trajectory(A.runs(spark, sf_dir), A.shards(spark, sf_dir), runs.latest_run(A.runs(spark, sf_dir), branch="main").first(), 30).collect()
    return partials.compare_window(_partials(spark, sf_dir, A.observations(spark, sf_dir)), window).rows


# ------------------------------------------------------------------ tenancy


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN FALSE WHEN c_custkey % 4 = 0 THEN TRUE ELSE c_nationkey <= 12 END AS rotated_and_unused FROM customer""", base=False)
def credential_health(spark, sf_dir):
    """Customers as keys: one in three never rotated, one in four never used, the rest used on the day of their nation's number."""
    c, key = A.table(spark, sf_dir, "customer"), F.col("c_custkey")
    start = F.lit(NOW - timedelta(days=60))
    keys = c.select(
        "c_custkey",
        F.when(key % 3 != 0, start + F.make_interval(days=F.lit(12))).alias("rotated_at"),
        F.when(key % 4 != 0, start + F.make_interval(days=F.col("c_nationkey"))).alias("last_used_at"),
    )
    return tenancy.credential_health(keys).select("c_custkey", "rotated_and_unused")


@query("""WITH users AS (SELECT 'user-' || CAST(c_custkey % 40 AS VARCHAR) AS handle, c_custkey AS user_id, c_custkey % 40 >= 30 OR c_custkey % 7 = 0 AS archived FROM customer WHERE c_custkey < 60),
asked AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN ' USER-' || CAST(s_suppkey % 45 AS VARCHAR) || ' ' WHEN 1 THEN 'user-' || CAST(s_suppkey % 45 AS VARCHAR) WHEN 2 THEN 'bad--' || CAST(s_suppkey AS VARCHAR) ELSE 'nobody' END AS asked FROM supplier),
matched AS (SELECT a.*, trim(lower(asked)) AS norm, count(u.handle) FILTER (WHERE NOT archived) AS active, count(u.handle) FILTER (WHERE archived) AS gone, min(user_id) FILTER (WHERE NOT archived) AS one
  FROM asked a LEFT JOIN users u ON u.handle = trim(lower(asked)) GROUP BY ALL),
judged AS (SELECT *, CASE WHEN norm LIKE '%--%' THEN 'malformed' WHEN active > 1 THEN 'ambiguous' WHEN active = 1 THEN 'found' WHEN gone > 0 THEN 'archived' ELSE 'not_found' END AS status FROM matched)
SELECT s_suppkey, status, CASE WHEN status = 'found' THEN one END AS user_id, CASE WHEN status = 'malformed' THEN 0 WHEN status = 'archived' THEN gone ELSE active END AS match_count FROM judged""", base=False)  # fmt: skip
def handle_resolution(spark, sf_dir):
    """Suppliers ask for handles, of which customers hold some: found, ambiguous, archived, unknown or malformed."""
    c, s = A.table(spark, sf_dir, "customer").filter("c_custkey < 60"), A.table(spark, sf_dir, "supplier")
    key, n = F.col("c_custkey"), F.col("s_suppkey")
    gone = (key % 40 >= 30) | (key % 7 == 0)
    users = c.select(F.concat(F.lit("user-"), (key % 40).cast("string")).alias("handle"), key.alias("user_id"), F.when(gone, F.lit(NOW)).alias("archived_at"))
    place = (n % 45).cast("string")
    asked = F.when(n % 4 == 0, F.concat(F.lit(" USER-"), place, F.lit(" "))).when(n % 4 == 1, F.concat(F.lit("user-"), place)).when(n % 4 == 2, F.concat(F.lit("bad--"), n.cast("string"))).otherwise("nobody")
    asked = s.select("s_suppkey", asked.alias("asked"))
    found = tenancy.resolve_handles(asked.select("asked").distinct(), users)
    return asked.join(found, "asked").select("s_suppkey", "status", "user_id", "match_count")


@query("SELECT o_custkey AS user_id, count(*) AS key_count FROM orders WHERE o_orderkey % 25 = 3 GROUP BY 1", base=False)
def keys_minted(spark, sf_dir):
    """Orders as keys: those of one repository by who minted them."""
    keys = A.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 25).alias("repository_id"), F.col("o_custkey").alias("user_id"))
    return tenancy.keys_minted_by(keys, 3)


@query("""SELECT CAST(n AS BIGINT) AS repository_id, CASE WHEN s THEN 'manage_keys,view' ELSE 'view' END AS permissions FROM (SELECT c_nationkey AS n, bool_or(c_mktsegment = 'BUILDING') AS s FROM customer WHERE c_custkey % 10 = 3 GROUP BY 1)""", base=False)
def shared_permissions(spark, sf_dir):
    """What one user, here one in ten customers as one, may do in each repository."""
    m = A.memberships(spark, sf_dir).withColumn("user_id", F.col("user_id") % 10)
    return tenancy.shared_permissions(m, 3).withColumn("permissions", F.array_join("permissions", ","))


@query("""WITH owners AS (SELECT c_nationkey AS n, min(c_custkey) AS owner FROM customer GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation LEFT JOIN owners ON n = n_nationkey WHERE owner = 7 OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 7 AND c_mktsegment = 'BUILDING')""", base=False)  # fmt: skip
def capable_repositories(spark, sf_dir):
    """Where a user may manage keys: as owner, or by a permission."""
    return tenancy.capabilities(A.repositories(spark, sf_dir), A.memberships(spark, sf_dir), 7, "manage_keys").select("id")


REGISTRATION_SQL = """WITH asked AS (
  SELECT c_custkey AS position, 'https://github.com/Owner' || CAST(c_custkey % 9 AS VARCHAR) || CASE WHEN c_custkey % 6 = 5 THEN '/bad name' ELSE '/repo-' || CAST(c_custkey % 20 AS VARCHAR) END AS raw FROM customer WHERE c_custkey % 8 <> 7
), clean AS (SELECT position, replace(raw, 'https://github.com/', '') AS full_name FROM asked),
firsts AS (SELECT lower(full_name) AS key, min(position) AS position, arg_min(full_name, position) AS full_name FROM clean GROUP BY 1),
listing AS (SELECT 'owner' || CAST(s_suppkey % 9 AS VARCHAR) || '/REPO-' || CAST(s_suppkey % 20 AS VARCHAR) AS full_name, s_suppkey % 3 = 0 AS is_admin FROM supplier),
best AS (SELECT lower(full_name) AS key, bool_or(is_admin) AS is_admin FROM listing GROUP BY 1),
taken AS (SELECT DISTINCT 'owner' || CAST(n_nationkey % 9 AS VARCHAR) || '/repo-' || CAST(n_nationkey % 20 AS VARCHAR) AS key FROM nation WHERE n_nationkey % 2 = 0),
outcomes AS (SELECT position, full_name, CASE WHEN t.key IS NOT NULL THEN 'already_registered' WHEN full_name LIKE '%bad name' THEN 'invalid' WHEN is_admin THEN 'registered' WHEN is_admin IS NOT NULL THEN 'not_administered' ELSE 'not_in_installation' END AS status
  FROM firsts f LEFT JOIN best USING (key) LEFT JOIN taken t ON t.key = f.key)
"""


def _outcomes(spark, sf_dir):
    c, s, n = (A.table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    key = F.col("c_custkey")
    path = F.when(key % 6 == 5, "/bad name").otherwise(F.concat(F.lit("/repo-"), (key % 20).cast("string")))
    raw = F.when(key % 8 == 7, " ").otherwise(F.concat(F.lit("https://github.com/Owner"), (key % 9).cast("string"), path))
    name = lambda k, word: F.concat(F.lit("owner"), (F.col(k) % 9).cast("string"), F.lit(f"/{word}-"), (F.col(k) % 20).cast("string")).alias("full_name")
    listing = s.select(name("s_suppkey", "REPO"), (F.col("s_suppkey") % 3 == 0).alias("is_admin"))
    return tenancy.bulk_registration(c.select(key.alias("position"), raw.alias("full_name")), n.filter("n_nationkey % 2 = 0").select(name("n_nationkey", "repo")), listing)


@query(REGISTRATION_SQL + "SELECT position, full_name, status FROM outcomes", base=False)
def registrations(spark, sf_dir):
    """What becomes of every asked name."""
    return _outcomes(spark, sf_dir)


@query(
    REGISTRATION_SQL
    + f"SELECT CAST(list_position({tenancy.SKIP_ORDER}, status) AS INTEGER) AS place, status, count(*) AS n, string_agg(full_name, ',' ORDER BY position) AS full_names FROM outcomes WHERE status <> 'registered' GROUP BY ALL",
    base=False,
)
def skipped_registrations(spark, sf_dir):
    """The names that were not registered, by reason."""
    return tenancy.skipped_groups(_outcomes(spark, sf_dir)).withColumn("full_names", F.array_join("full_names", ","))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 AND o_custkey % 5 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey END AS user_id FROM orders", base=False)
def authenticated_users(spark, sf_dir):
    """Orders present tokens of their customers: one in six a blank one; one customer in five is archived."""
    o, c = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "customer")
    token = lambda k: F.concat(F.lit("token-"), F.col(k).cast("string"))
    tokens = o.select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, " ").otherwise(token("o_custkey")).alias("token"))
    users = c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 5 == 0, F.lit(NOW)).alias("archived_at"))
    keys = c.select(F.col("c_custkey").alias("user_id"), F.sha2(token("c_custkey"), 256).alias("token_digest"))
    return tenancy.authenticated(tokens, keys, users).select("o_orderkey", "user_id")


@query("SELECT branch, count(*) AS populated_runs FROM runs WHERE id IN (SELECT test_run_id FROM obs) AND branch IS DISTINCT FROM 'feature/a' GROUP BY branch HAVING count(*) > 3 ORDER BY branch NULLS LAST LIMIT 1")
def next_quiet_bucket(spark, sf_dir):
    """The first branch to prune other than the one just written."""
    return retention.next_quiet_bucket(A.runs(spark, sf_dir), A.observations(spark, sf_dir), 1, "feature/a", 3).select("branch", "populated_runs")
