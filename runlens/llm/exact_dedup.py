"""Exact dedup by skew-safe combining, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z (a null text counts as empty). Whole normalised texts, not
only their digests, are grouping keys at every stage:

1. local: the partial aggregation before each exchange leaves one row a text and task;
2. salted: rows of one digest, salt and text are merged. Digests that over 1/HOT_SHARE of all rows share (under
   HOT_SHARE of them, so they are broadcast) are dealt to SALTS salts by input partition; such a text meets SALTS
   tasks, each with at most one row an input task. All other digests have one salt, so are done here;
3. global: the at most SALTS winners of a hot text are combined.

Every row then finds its group by digest. Digests that more than one text share (none are known for SHA-256)
are told apart by joining on the text itself.

Cases: an empty table gives no rows; rows that repeat a doc_id and a text all carry the same result; a group
whose doc_ids are all null keeps every row of it, since none can be named (keep_id null, kept true); ties
cannot occur otherwise, as the largest doc_id stays; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import HOT_SHARE, free_names, lookup, write_table

SALTS = 16


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does just that where all characters are ASCII, and is faster."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _digested(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("norm"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("norm"), 256)))


def _combine(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def find_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = _digested(docs)
    members = write_table(rows.select("doc_id", "digest"), "copy-members")
    sizes = members.groupBy("digest").agg(F.count("*").alias("rows"))
    total = members.count()
    hot = sizes.filter(F.col("rows") > max(total // HOT_SHARE, 1)).select("digest", F.lit(True).alias("hot"))
    dealt = rows.withColumn("part", F.spark_partition_id()).join(F.broadcast(hot), "digest", "left")
    salt = F.when(F.col("hot"), F.pmod("part", F.lit(SALTS)))
    merged = _combine(dealt.select("digest", "norm", salt.alias("salt"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")), "digest", "salt", "norm")
    merged = merged.withColumn("hot_norm", F.when(F.col("salt").isNotNull(), F.col("norm")))
    # a hot text has one row here; the rows of a digest without salt are different texts already, and are counted
    winners = merged.groupBy("digest", "hot_norm").agg(F.count("*").alias("rows"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    texts = F.sum(F.when(F.col("hot_norm").isNull(), F.col("rows")).otherwise(F.lit(1)))
    groups = winners.groupBy("digest").agg(texts.alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    groups = write_table(groups, "copy-groups")
    if groups.filter("texts > 1").isEmpty():
        found = lookup(members, groups.drop("texts"), "digest", "n", total)
    else:  # some digest stands for several texts: its rows are told apart by text
        shared = groups.filter("texts > 1").select("digest")
        found = lookup(members.join(shared, "digest", "left_anti"), groups.filter("texts = 1").drop("texts"), "digest", "n", total)
        apart = rows.join(shared, "digest", "left_semi")
        by_text = apart.select("digest", "norm", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
        found = found.unionByName(apart.join(_combine(by_text, "digest", "norm"), ["digest", "norm"]).drop("norm"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


#: Rows named for removal that are broadcast at most, at some 250 bytes each; more meet the documents by a shuffle.
BROADCAST_ROWS = 1 << 19


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts one row, with the largest doc_id.

    Rows are judged one by one, also where they repeat a doc_id; of equal texts under one doc_id any one stays. A group
    whose doc_ids are all null keeps every row of it.
    """
    key, copy, rows = free_names(docs, "copy_key", "copy_of", "tied_rows")
    found = find_copies(docs).withColumn(copy, _row_key(F.col("doc_id"), F.unhex("text_sha256")))
    found = write_table(found.select(copy, "kept", "group_size", F.col("keep_id").isNotNull().alias("named")), "copies")
    gone = found.filter("not kept").select(copy).distinct()
    if found.filter("not kept").count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    kept = docs.withColumn(key, _row_key(F.col("doc_id"), digest)).join(gone, F.col(key) == F.col(copy), "left_anti")
    ties = found.filter("kept and group_size > 1 and named").groupBy(F.col(copy).alias(key)).agg(F.count("*").alias(rows))
    ties = write_table(ties.filter(F.col(rows) > 1), "tied-copies")
    if ties.isEmpty():
        return kept.drop(key)
    # rows of one doc_id and text that stay: each task leaves one of them before they meet
    marked = lookup(kept, ties, key, rows, found.count(), "left")
    tied = marked.filter(F.col(rows).isNotNull()).dropDuplicates([key])
    return marked.filter(F.col(rows).isNull()).union(tied).drop(key, rows)


def _row_key(doc_id: Column, digest: Column) -> Column:
    """What rows of one doc_id and text share: the digest, and the id where there is one."""
    return F.concat(digest, F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
