"""Centroid clustering of quantised vectors by weighted deduplication.

Vectors become integers and are packed into canonical bytes; equal ones become one row with a multiplicity, by a
hash aggregation that combines within each task first. Lloyd's rounds run over the distinct vectors only: a
task adds up, for each centroid, multiplicity times vector in exact integers, Spark adds the tasks' sums, and the
driver sees no more than k sums a round. So the centroids do not depend on how rows are dealt. At last the
distinct vectors' assignments are joined back to the rows; vectors with very many copies meet a broadcast of their few assignments.

Starts: the k kept vectors with the smallest sha256 of ``seed:vec_id``, in that order (of rows that repeat a
vec_id, the smaller bytes come first). Ties of distance go to the smaller number; an empty cluster keeps its centroid.

Cases: vectors that are null or not of ``dims`` components, or have one that is null or not finite, are left out;
a null vec_id stays null, takes part, but is no start; rows that repeat a vec_id each take part and get their row;
fewer kept rows with a vec_id than k give as many centroids, none of them no rows; an empty table gives no rows; other columns are ignored, whatever
their names. Components that might take a squared distance past 2^62 are refused with a ValueError before any round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hard_negatives import finite
from .shared import in_batches, lookup, write_table

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
#: The widths of a packed component, in the order in which they are tried.
WIDTHS = ("<i2", "<i4", "<i8")


def pack(rows: np.ndarray) -> list[bytes]:
    """Each row of longs as bytes, with the least width that holds it: equal rows, and no others, have equal bytes."""
    size = np.maximum(rows, ~rows).max(axis=1)
    level = (size >> 15 > 0).astype(int) + (size >> 31 > 0)
    return [row.astype(WIDTHS[k]).tobytes() for row, k in zip(rows, level.tolist(), strict=True)]


def unpack(packed: pa.Array, dims: int) -> np.ndarray:
    """The rows of longs again."""
    sizes = pc.binary_length(packed).to_numpy(zero_copy_only=False)
    out, raw = np.zeros((len(packed), dims), np.int64), packed.to_pylist()
    for width in WIDTHS:
        own = np.flatnonzero(sizes == dims * np.dtype(width).itemsize)
        if len(own):
            out[own] = np.frombuffer(b"".join(raw[i] for i in own.tolist()), width).reshape(len(own), dims)
    return out


def _packed(batches, dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch.column("vector").flatten().to_numpy().reshape(-1, dims)
        keys = pack(flat) if len(flat) else []
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary())], ["vec_id", "key"])


def quantised(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and the packed integers floor(scale * x) of the vectors that are kept."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter((F.size("embedding") == dims) & finite(F.col("embedding")))
    large = float(1 << 62)  # beyond it a distance is refused anyway
    rows = rows.select("vec_id", F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(-large), F.least(F.lit(large), v * scale)))).alias("vector"))
    return in_batches(rows).mapInArrow(lambda it: _packed(it, dims), "vec_id long, key binary")


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row, in exact integers."""
    best = np.full(len(rows), np.iinfo(np.int64).max)
    number = np.zeros(len(rows), np.int64)
    for k, c in enumerate(centroids):
        d = rows - c
        d = np.einsum("ij,ij->i", d, d)
        nearer = d < best
        best[nearer], number[nearer] = d[nearer], k
    return number, best


def _sums(batches, handle, dims: int) -> Iterator[pa.RecordBatch]:
    """This task's exact sums: cluster, rows, and the vectors' sums in decimal, which no number of rows overflows."""
    centroids = handle.value
    n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), object)
    for batch in batches:
        rows, weight = unpack(batch.column("key"), dims), batch.column("n").to_numpy()
        number, _ = nearest(rows, centroids)
        small = len(rows) == 0 or int(np.abs(rows).max()) * int(weight.sum()) < 1 << 62
        for k in np.unique(number).tolist():
            own = number == k
            n[k] += weight[own].sum()
            part = (weight[own, None] * rows[own]).sum(axis=0) if small else (weight[own, None].astype(object) * rows[own].astype(object)).sum(axis=0)
            total[k] += part.astype(object)
    used = np.flatnonzero(n)
    sums = [[str(x) for x in total[k]] for k in used]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(sums, pa.list_(pa.string()))], ["cluster", "n", "sums"])


def _assigned(batches, handle, dims: int) -> Iterator[pa.RecordBatch]:
    centroids = handle.value
    for batch in batches:
        number, distance = nearest(unpack(batch.column("key"), dims), centroids)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(number, pa.int32()), pa.array(distance)], ["key", "n", "cluster", "distance"])


def starts(rows: DataFrame, k: int, seed: str) -> list[bytes]:
    """The packed vectors of the k rows with the smallest hashes."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.filter("vec_id is not null").select(mark.alias("mark"), "key").orderBy("mark", "key").limit(k)
    return [bytes(r["key"]) for r in first.collect()]


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int, dims: int) -> np.ndarray:
    """The centroids after ``rounds``; only their sums reach the driver."""
    sc = distinct.sparkSession.sparkContext
    for _ in range(rounds):
        handle = sc.broadcast(centroids)
        sums = in_batches(distinct).mapInArrow(lambda it, h=handle: _sums(it, h, dims), "cluster int, n long, sums array<string>")
        each = sums.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
        each = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("sum"))
        moved = centroids.copy()
        for r in each.collect():  # k * dims sums
            moved[r["cluster"], r["at"]] = int(r["sum"]) // r["n"]
        handle.destroy()
        if (moved == centroids).all():  # a fixed point: later rounds change nothing
            break
        centroids = moved
    return centroids


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = write_table(quantised(vectors, dims, scale), "quantised")
    distinct = write_table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "distinct")
    found = starts(rows, k, seed)
    if not found:
        return spark.createDataFrame([], RESULT)
    _refuse_large(distinct, dims)
    centroids = lloyd(distinct, unpack(pa.array(found, pa.binary()), dims), rounds, dims)
    handle = spark.sparkContext.broadcast(centroids)
    assigned = write_table(in_batches(distinct).mapInArrow(lambda it: _assigned(it, handle, dims), "key binary, n long, cluster int, distance long"), "assigned")
    inertia = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("n") * F.col("distance").cast("decimal(38,0)"))).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(c, inertia[c], sum(inertia.values()), marks[c]) for c in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = lookup(rows, assigned, "key", "n", rows.count())
    return joined.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _refuse_large(distinct: DataFrame, dims: int) -> None:
    def largest(batches):
        for batch in batches:
            rows = unpack(batch.column("key"), dims)
            yield pa.RecordBatch.from_arrays([pa.array([int(np.maximum(rows, ~rows).max()) if rows.size else 0])], ["most"])

    most = in_batches(distinct.select("key")).mapInArrow(largest, "most long").agg(F.max("most")).first()[0] or 0
    if dims * (2 * most + 1) ** 2 >= 1 << 62:
        raise ValueError(f"squared distances of vectors with components up to {most} might pass 2^62: choose a smaller scale")


def oracle(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """The same in SQL over every row, without multiplicities: a step for each round."""
    steps = [
        f"""good AS MATERIALIZED (
  SELECT vec_id, unnest(range({dims})) AS pos, unnest(list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""first AS (SELECT vec_id, row_number() OVER (ORDER BY mark) - 1 AS cluster
  FROM (SELECT DISTINCT vec_id, sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS mark FROM good) ORDER BY mark LIMIT {k})""",
        "c0 AS MATERIALIZED (SELECT cluster, pos, x FROM first JOIN good USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT g.vec_id, c.cluster, CAST(sum((g.x - c.x) * (g.x - c.x)) AS BIGINT) AS distance FROM good g JOIN c{r} c USING (pos) GROUP BY 1, 2)""")
        steps.append(f"""a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN good USING (vec_id) GROUP BY 1, 2)""")
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT cluster, pos, COALESCE((s - ((s % n) + n) % n) // n, x) AS x FROM c{r} LEFT JOIN m{r} USING (cluster, pos))""")
    return f"""
WITH {", ".join(steps)},
marks AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN marks USING (cluster)
"""
