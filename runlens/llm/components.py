"""Connected components: every node of an edge list is labelled with the smallest id that it can reach.

Up to ONE_TASK distinct edges, a bound of 16 MB, are united in one task. Beyond it, large-star and small-star steps
alternate, each over written tables. A step groups edges by node
with a partial aggregation (the smallest neighbour) and joins it back, nodes with very many edges by broadcast; no
component meets one task or the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, lookup, write_table

ONE_TASK = 1 << 20


def _unite(batches) -> Iterator[pa.RecordBatch]:
    """Union-find over all rows, which the caller has counted."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
            parent.setdefault(u, a)
    nodes = np.array(sorted(parent), np.int64)
    roots = np.array([root(int(x)) for x in nodes], np.int64)
    keep = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["node", "component"])


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour and the number of edges of each node."""
    return write_table(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = write_table(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    joined = lookup(both, _least(both), "u", "edges", both.count()).filter("v > u")
    return joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = lookup(edges, least, "u", "edges", edges.count()).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 64, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b) that is not its component's smallest id.

    Self-loops, repeated edges and either direction are fine; an empty table gives no rows.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    held, mark = write_table(ordered, "edges"), None
    if held.count() <= one_task:
        return in_batches(held.coalesce(1)).mapInArrow(_unite, "node long, component long")
    for _ in range(max_rounds):
        state = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            return held.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(state)
        wide = write_table(_large_star(held).filter("u <> v").distinct(), "large-star")
        held = write_table(_small_star(wide).filter("u <> v").distinct(), "small-star")
    raise RuntimeError("components did not settle")
