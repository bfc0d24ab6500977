"""One SQL text for both engines: table names stand in braces."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.catalog import load

Query = Callable[[SparkSession, str], DataFrame]


def names_in(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def plain(sql: str) -> str:
    """The text with bare table names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def query(sql: str) -> Query:
    """The Spark query of a text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in names_in(sql)})

    return run
