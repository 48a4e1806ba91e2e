"""Whole texts as JSON: nothing before or after the value, and of a repeated key the last value."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_REPEATED = "spark.sql.variant.allowDuplicateKeys"


def whole_json(text: Column) -> Column:
    """The text as a VARIANT; NULL where it is not one JSON value from end to end.

    Spark's parsers stop after the first value. So the text is read twice, as the only entry of a list and as the only field
    of an object: what ends the one early (a closing bracket) is an error in the other.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(alone, F.try_variant_get(held, "$.v", "variant"))


@contextmanager
def repeated_keys(spark: SparkSession) -> Iterator[None]:
    """Frames made inside read objects that repeat a key, and keep its last value; the session's setting comes back after."""
    was = spark.conf.get(_REPEATED, None)
    spark.conf.set(_REPEATED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_REPEATED) if was is None else spark.conf.set(_REPEATED, was)


def with_json(df: DataFrame, name: str, text: Column) -> DataFrame:
    """``df`` with the column ``name``: ``whole_json`` of a text, repeated keys allowed.

    Whether they are is settled where the column is resolved, which is here, not where it is computed.
    """
    with repeated_keys(df.sparkSession):
        return df.withColumn(name, whole_json(text))
