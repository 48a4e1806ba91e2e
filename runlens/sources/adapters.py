"""Runs, shards, observations, identities and tenancy tables made from the local test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.primitives import latest_per_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, *runs: int) -> DataFrame:
    """Every event as an example: a day is a run, a user a test, the event type an outcome.

    ``runs``: those asked about; the days from the first to the last of them are a range of ``ts``, which reaches the scan.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    if runs:
        day_of = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n - 1).cast("timestamp")
        e = e.filter((F.col("ts") >= day_of(min(runs))) & (F.col("ts") < day_of(max(runs) + 1)))
    day = (F.datediff(F.to_date("ts"), F.lit("2024-01-01")) + 1).cast("long")
    user, event = F.col("user_id"), F.col("event_id")
    path = F.when(user % 25 == 24, "root_spec.rb").otherwise(F.concat(F.lit("spec/d"), (user % 5).cast("string"), F.lit("/f"), (user % 25).cast("string"), F.lit("_spec.rb")))
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").when(F.col("event_type").isin("purchase", "view"), "passed")
    return e.select(
        event.cast("long").alias("id"),
        F.lit(1).cast("long").alias("repository_id"),
        day.alias("test_run_id"),
        (event % F.when(day % 7 == 0, 3).otherwise(4)).cast("long").alias("test_run_shard_id"),
        F.when(event % 100 != 0, user.cast("long")).alias("spec_identity_id"),
        F.concat(F.lit("e"), event.cast("string")).alias("example_id"),
        path.alias("spec_file_path"),
        path.alias("file_path"),
        (user % 40 + 1).cast("int").alias("line_number"),
        F.when(event % 100 != 0, F.concat(F.lit("example "), user.cast("string"))).alias("name"),
        F.when(event % 50 != 0, F.col("value").cast("double")).alias("duration_seconds"),
        outcome.alias("outcome"),
        F.when(F.col("event_type") == "purchase", "annotated").otherwise("unannotated").alias("status"),
        F.when(event % 400 == 0, F.col("ts")).alias("embed_failed_at"),
        F.when(event % 400 == 0, F.lit(1)).otherwise(F.lit(0)).alias("embed_failure_count"),
        F.col("ts").alias("created_at"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted deliveries: every order is one, its customer the run, its lines the examples in a fixed order."""
    from ..operators import ingest

    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    each = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("lines")
    rows = o.join(lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(each), "o_orderkey", "left")
    spec = lambda x: F.struct(
        F.when(x["l_linenumber"] != 7, (x["l_partkey"] % 50).cast("string")).alias("id"),
        F.concat(F.lit("spec/f"), (x["l_suppkey"] % 5).cast("string"), F.lit("_spec.rb")).alias("file_path"),
        x["l_linenumber"].alias("line_number"),
        F.concat(F.lit("part "), (x["l_partkey"] % 50).cast("string")).alias("name"),
        x["l_quantity"].alias("duration"),
        F.when(x["l_linenumber"] == 1, "annotated").otherwise("unannotated").alias("status"),
        F.when(x["l_linenumber"] == 1, F.struct(F.lit("Part").alias("entity"), F.lit("ships").alias("action"), F.lit("is sent to its buyer").alias("behavior"), F.lit("unit").alias("layer"))).alias("intent"),
    )
    none = F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint,l_quantity:double>>")
    body = F.struct(
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("commit_sha"),
        F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("ci_run_id"),
        F.concat(F.lit("s"), (F.col("o_orderkey") % 3).cast("string")).alias("shard_id"),
        F.col("o_totalprice").alias("duration_seconds"),
        F.transform(F.coalesce("lines", none), spec).alias("specs"),
    )
    sent = rows.select((F.col("o_custkey") % 7).alias("repository_id"), F.col("o_orderkey").alias("delivery_seq"), F.col("o_orderdate").alias("received_at"), F.to_json(body).alias("value"))
    return ingest.accepted(ingest.validate(sent))


def first_observations(spark: SparkSession, sf_dir: str, *runs: int) -> DataFrame:
    """The first row of each run and test, so that descriptions are unique within a run."""
    rows = observations(spark, sf_dir, *runs).withColumn("user", F.coalesce("spec_identity_id", -F.col("id")))
    return latest_per_key(rows, ["test_run_id", "user"], ["id"], newest=False).drop("user")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a run: seconds are missing for the first shard of every fifth run."""
    o = observations(spark, sf_dir)
    out = o.groupBy("test_run_id", "test_run_shard_id").agg(
        F.sum("duration_seconds").alias("seconds"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "annotated").alias("annotated"), F.max("created_at").alias("updated_at")
    )
    untimed = (F.col("test_run_shard_id") == 0) & (F.col("test_run_id") % 5 == 0)
    return out.select(
        (F.col("test_run_id") * 10 + F.col("test_run_shard_id")).alias("id"),
        "test_run_id",
        F.col("test_run_shard_id").cast("string").alias("shard_id"),
        F.when(~untimed, F.col("seconds")).alias("duration_seconds"),
        F.col("total").cast("int").alias("total_specs_count"),
        F.col("annotated").cast("int").alias("annotated_specs_count"),
        "updated_at",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run a day; totals derive from its shards, never accumulate."""
    from ..operators.ingest import derived_totals

    day = F.col("test_run_id")
    branch = F.when(day % 15 == 7, None).when(day % 6 == 0, "feature/a").otherwise("main")
    return derived_totals(shards(spark, sf_dir)).select(
        day.alias("id"),
        F.lit(1).cast("long").alias("repository_id"),
        branch.alias("branch"),
        F.concat(F.lit("sha"), F.lpad(day.cast("string"), 3, "0")).alias("commit_sha"),
        F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, int(test_run_id) - 1)").alias("created_at"),
        "duration_seconds",
        "total_specs_count",
        "annotated_specs_count",
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as an identity; its label's parity tells whether an intent or a name gave its text."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("long").alias("id"),
        F.lit(1).cast("long").alias("repository_id"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"),
        F.when(F.col("label") % 2 == 0, "name").otherwise("intent").alias("signal_source"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.lit("spec/vector_spec.rb").alias("file_path"),
        F.lit(1).alias("line_number"),
    )


def vector_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations, linked to the vectors' identities."""
    return observations(spark, sf_dir).withColumn("spec_identity_id", F.when(F.col("id") % 100 != 0, F.col("id") % 500))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as repositories and customers as users: members by nation, with permissions by segment."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_nationkey").cast("long").alias("repository_id"),
        F.col("c_custkey").cast("long").alias("user_id"),
        F.lower(F.regexp_replace("c_name", "#", "-")).alias("handle"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("manage_keys"), F.lit("view"))).otherwise(F.array(F.lit("view"))).alias("permissions"),
    )


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    owners = memberships(spark, sf_dir).groupBy("repository_id").agg(F.min("user_id").alias("user_id"))
    names = n.select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("/"), F.lower("n_name")).alias("github_full_name"))
    return names.join(owners, F.col("id") == F.col("repository_id"), "left").select("id", "github_full_name", "user_id")
