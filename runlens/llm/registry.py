"""The queries of this subpackage, one an operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontaminate, exact_dedup, hard_negatives, jaccard, language_id, licenses, mixing, packing, pii, secrets, token_records, tool_calls

TOKENIZER = "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(_documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"), tool_calls.MESSAGE_SCHEMAS, implicit=True)


def tool_calls_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over calls and results, which ``conversations`` has none of: they are made from the orders."""
    messages = tool_calls.calls_of_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return tool_calls.link_calls(messages, tool_calls.ORDER_SCHEMAS)


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_records(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_personal_data(_documents(spark, sf_dir))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are every hundredth vec_id; of every seventh the label is moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(_embeddings(spark, sf_dir).withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_embeddings(spark, sf_dir))


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_tool_calls": op5_tool_calls,
    "op6_token_records": op6_token_records,
    "op7_secret_scan": op7_secret_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_pii": op10_pii,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_mixture_packing": op13_mixture_packing,
    "tool_calls_of_orders": tool_calls_of_orders,
}

ORACLES: dict[str, str] = {
    "op5_tool_calls": tool_calls.ORACLE,
    "tool_calls_of_orders": tool_calls.ORDERS_ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_centroid_clusters": clustering.oracle(),
}
