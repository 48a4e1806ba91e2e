"""A session with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "runlens", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session time zone UTC and adaptive execution on; master and shuffle partitions only where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings).getOrCreate()
