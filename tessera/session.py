"""SparkSession factory with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and pushdown on. Extra settings go by name, with _ for a dot."""
    builder = SparkSession.builder.appName("tessera")
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.parquet.aggregatePushdown": "true",
        # Texts are long: small batches keep the Python workers small.
        "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
    }
    for k, v in (fixed | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
