"""Relational shapes that are more than one call: joins that materialise late, arg-max with ties, dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import storage
from tessera.sources.columnar import tasks_for

#: Rows up to which a side counts as small.
SMALL = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if `rows`, a proven bound of its rows, is small; else as it is, for a shuffle join."""
    return F.broadcast(df) if rows <= SMALL else df


def skip(df: DataFrame, is_filtered: Column) -> DataFrame:
    """Rows for which is_filtered does not hold: true means skip, null does not."""
    return df.where(~F.coalesce(is_filtered, F.lit(False)))


def late_lookup(top: DataFrame, bound: int, dimension: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """Adds columns of a dimension to a result of at most `bound` rows: the dimension is read once and never shuffled."""
    return dimension.select(on, *columns).join(small(top, bound), on)


def arg_max(df: DataFrame, value: str) -> DataFrame:
    """All rows with the greatest value, ties included. The maximum goes to every task, so nothing is sorted."""
    most = df.agg(F.max(value).alias("_most"))
    return df.join(F.broadcast(most), F.col(value) == F.col("_most")).drop("_most")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order, without sorting the rest."""
    return df.orderBy(*order).limit(n)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(column, code) of the distinct values, numbered from 0 in their order. Equal to the merged dictionary of several inputs' values.

    Only distinct values are numbered, in partitions by range: a count of each partition gives the first code of the next.
    """
    spark = df.sparkSession
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    # Written once, with the partition that each value is in: counts and numbers are of the same partitions, however they are read.
    path = storage.scratch(spark, "dictionary")
    ranged = values.repartitionByRange(F.col(column)).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    ordered = spark.read.schema(ranged.schema).parquet(path)
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min(column).alias("_low"))
    # A row for each partition.
    first = parts.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_first")
    line = Window.partitionBy("_part").orderBy(column)
    return ordered.join(F.broadcast(first), "_part").select(column, (F.col("_first") + F.row_number().over(line) - 1).cast("long").alias("code"))


def encode(df: DataFrame, column: str, codes: DataFrame, name: str = "code") -> DataFrame:
    """df with the code of a column; values that the dictionary lacks, and null, give null."""
    return df.join(codes.withColumnRenamed("code", name), column, "left")


def decode(df: DataFrame, column: str, codes: DataFrame, name: str = "code") -> DataFrame:
    """The opposite of encode()."""
    return df.join(codes.select(F.col("code").alias(name), F.col(column)), name, "left")


def missing_keys(facts: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """Distinct keys of facts that the dimension lacks; none if the foreign key holds."""
    return facts.select(F.col(key).alias(dimension_key)).where(F.col(dimension_key).isNotNull()).distinct().join(dimension, dimension_key, "left_anti")


def merge_sorted(inputs: Sequence[DataFrame], partitions: int, *keys: str) -> DataFrame:
    """The rows of several inputs as one, in order within and across partitions, which are more if the rows need more tasks."""
    out = inputs[0]
    for x in inputs[1:]:
        out = out.unionByName(x)
    return out.repartitionByRange(max(partitions, tasks_for(out)), *keys).sortWithinPartitions(*keys)


def least_used(nodes: DataFrame, used: DataFrame, key: str, n: int = 1) -> DataFrame:
    """The n nodes with the fewest uses, then by key: (key, uses)."""
    counts = used.groupBy(key).agg(F.count("*").alias("uses"))
    return nodes.select(key).join(counts, key, "left").select(key, F.coalesce("uses", F.lit(0)).alias("uses")).orderBy("uses", key).limit(n)
