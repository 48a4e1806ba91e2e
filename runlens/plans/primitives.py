"""Relational primitives: population counts, top-k with total orders, two-point comparisons, latest per key, as-of."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import write_table


def row_count() -> Column:
    return F.count(F.lit(1))


def of_run(observations: DataFrame, run_id: int) -> DataFrame:
    """One run's rows; the filter reaches the scan."""
    return observations.filter(F.col("test_run_id") == run_id)


def with_population(df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """Each row with totals over all rows, taken before any limit.

    The totals come from one partial aggregation and a one-row broadcast join, so no row moves to a single task.
    """
    totals = df.agg(*(c.alias(k) for k, c in counts.items()))
    return df.join(F.broadcast(totals))


def topk(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of a total order (TakeOrderedAndProject: no global sort)."""
    return df.orderBy(*order).limit(k)


def two_point(df: DataFrame, key: str, a: int, b: int, measures: Mapping[str, Column]) -> DataFrame:
    """Compare two runs by one conditional aggregation: each measure as previous_<m> (run a) and latest_<m> (run b).

    A measure is a column to count non-null values of, or (as an aggregate name prefix ``sum:``) to sum; sums of nothing stay NULL.
    """
    out = []
    for name, column in measures.items():
        fold = F.sum if name.endswith("seconds") else F.count
        for side, run in (("previous", a), ("latest", b)):
            out.append(fold(F.when(F.col("test_run_id") == run, column)).alias(f"{side}_{name}"))
    return df.filter(F.col("test_run_id").isin(a, b)).groupBy(key).agg(*out)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], newest: bool = True) -> DataFrame:
    """One whole row a key: the last (or first) by the ordering columns, by an aggregation rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if newest else F.min_by
    found = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("row"))
    return found.select(*keys, *(F.col("row")[c].alias(c) for c in rest)).select(*df.columns)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Each row with its place, from 1, in a total order: by ranges of it, so no task numbers more than its range.

    Only the number of rows of each range, one a partition, reaches the driver.
    """
    held = write_table(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = held.groupBy("_range").count().orderBy("_range").collect()
    before, at = [], 0
    for part, n in counts:
        before.append((part, at))
        at += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_range int, _before long"))
    w = Window.partitionBy("_range").orderBy(*order)
    return held.join(offsets, "_range").withColumn(name, F.col("_before") + F.row_number().over(w)).drop("_range", "_before")


def at_or_before(created: Column, ident: Column, at: object, row_id: int) -> Column:
    """(created_at, id) <= (at, row_id), compared as a row."""
    return (created < F.lit(at)) | ((created == F.lit(at)) & (ident <= row_id))


def before(created: Column, ident: Column, at: object, row_id: int) -> Column:
    return (created < F.lit(at)) | ((created == F.lit(at)) & (ident < row_id))


def keep_newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key; a NULL key is a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def upsert(existing: DataFrame, delivered: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``delivered`` over ``existing`` by key: all columns of the new row, but those in ``keep`` of the old one where there is one."""
    old = existing.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in keep), F.lit(True).alias("_had"))
    merged = delivered.join(old, list(keys), "left")
    columns = [F.when(F.col("_had"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in delivered.columns]
    return existing.join(delivered.select(*keys), list(keys), "left_anti").unionByName(merged.select(*columns))
