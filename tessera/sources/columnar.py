"""Columnar tables: layouts in Parquet, their statistics, and keyed reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import Layout

#: Bytes of rows that one task sorts, about.
TASK_BYTES = 128 << 20

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def tasks_for(df: DataFrame) -> int:
    """Tasks that the rows of df need, at TASK_BYTES each: one pass adds up what a sort holds of them, 8 bytes a field and the lengths of the others."""
    long = [F.octet_length(F.col(f"`{f.name}`") if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`").cast("string")) for f in df.schema if not isinstance(f.dataType, _FIXED)]
    lengths = sum((F.coalesce(x, F.lit(0)).cast("long") + 8 for x in long), F.lit(0).cast("long"))
    # The record's own head, null bits and its place in the sorted array.
    row = lengths + 8 * (len(df.columns) + 5)
    return max(1, -(-(df.agg(F.sum(row)).first()[0] or 0) // TASK_BYTES))


def arranged(df: DataFrame, layout: Layout) -> DataFrame:
    """df dealt and sorted as the layout says. Ranges serve pruning, and are more than the layout's if its rows need more tasks; buckets serve joins."""
    if layout.partition_key and layout.bucketed:
        df = df.repartition(layout.partitions, layout.partition_key)
    elif layout.partition_key:
        df = df.repartitionByRange(max(layout.partitions, tasks_for(df)), layout.partition_key)
    return df.sortWithinPartitions(layout.sort_key) if layout.sort_key else df


def write(df: DataFrame, path: str, layout: Layout, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Writes df under path in a layout. Codec and dictionary pages follow the layout; footers keep the ranges of each row group."""
    writer = arranged(df, layout).write.mode(mode).option("compression", layout.codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, layout: Layout) -> None:
    """Saves a bucketed, sorted table: joins of two such tables on the key need no shuffle."""
    writer = df.repartition(layout.partitions, layout.partition_key).write.mode("overwrite").option("compression", layout.codec).option("path", path)
    writer.bucketBy(layout.partitions, layout.partition_key).sortBy(layout.sort_key or layout.partition_key).saveAsTable(table)


def lookup(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    """The rows with given keys; on a sorted layout, row groups and pages without them are skipped."""
    return spark.read.parquet(path).where(F.col(key).isin(values))


def at_rows(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """n rows of a sorted layout under path from its row `start` on, by position: its files follow each other by name. A row for each file
    goes to the driver; only files that hold some of the rows are read, and columns as far as they are selected."""
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    rows = spark.read.parquet(path)
    wanted, first = F.lit(False), 0
    for name, held in sorted(map(tuple, rows.groupBy(file.alias("file")).agg(F.count("*").alias("held")).collect())):
        if first < start + n and first + held > start:
            wanted = wanted | ((file == name) & (row >= start - first) & (row < start + n - first))
        first += held
    return rows.where(wanted).select(*rows.columns)


def zone_map(df: DataFrame, key: str) -> DataFrame:
    """(block, least, greatest, rows) of each partition, as a reader of sorted blocks would skip by."""
    return df.select(F.spark_partition_id().alias("block"), F.col(key).alias("k")).groupBy("block").agg(F.min("k").alias("least"), F.max("k").alias("greatest"), F.count("*").alias("rows"))


def runs(df: DataFrame, value: str, *order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(value, start, length) of the runs of equal values in an order; with `within`, of each group by itself.

    start counts rows from 0. Without `within` the whole order is one sequence, so give groups for large tables.
    """
    line = Window.partitionBy(*within).orderBy(*order)
    change = ~F.col(value).eqNullSafe(F.lag(value).over(line)) | (F.row_number().over(line) == 1)
    marked = df.select("*", F.row_number().over(line).alias("_at"), change.cast("int").alias("_new"))
    marked = marked.withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*within, "_run").agg(F.first(value, ignorenulls=False).alias(value), (F.min("_at") - 1).alias("start"), F.count("*").alias("length"))
    return out.drop("_run")


def column_statistics(df: DataFrame, column: str, *order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """One row: tuples, bytes of the values as text, distinct values, runs in an order, least and greatest value, and the sum of the values' CRC32, which does not
    depend on their order."""
    line = Window.partitionBy(*within).orderBy(*order)
    new = (~F.col(column).eqNullSafe(F.lag(column).over(line)) | (F.row_number().over(line) == 1)).cast("long")
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    code: Column = F.crc32(text.cast("binary"))
    rows = df.select(F.col(column).alias("v"), new.alias("n"), code.alias("c"), F.octet_length(text).cast("long").alias("b"))
    return rows.agg(F.count("*").alias("tuples"), F.sum("b").alias("bytes"), F.count_distinct("v").alias("distinct"), F.sum("n").alias("runs"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.sum("c").alias("checksum"))
