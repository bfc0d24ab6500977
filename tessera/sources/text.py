"""Delimited text: typed scans, samples and per-column files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = {"TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint"}


def parsed(value: Column, kind: str, date_format: str = "yyyy-MM-dd", time_format: str = "HH:mm:ss", timestamp_format: str = "yyyy-MM-dd HH:mm:ss.SSS") -> Column:
    """A text field as a type of the catalog; empty is null, and what cannot be read is an error."""
    value = F.when(value != "", value)
    kind = kind.upper()
    if kind in _INTEGERS:
        return value.cast(_INTEGERS[kind])
    if kind == "BOOLEAN":
        return F.lower(value) == "true"
    if kind in ("FLOAT", "DOUBLE"):
        return value.cast(kind.lower())
    if kind == "DATE":
        return F.to_date(value, date_format)
    if kind == "TIMESTAMP":
        return F.to_timestamp_ntz(value, F.lit(timestamp_format))
    if kind == "TIME":
        at = F.to_timestamp_ntz(F.concat(F.lit("1970-01-01 "), value), F.lit(f"yyyy-MM-dd {time_format}"))
        return ((F.hour(at) * 60 + F.minute(at)) * 60 + F.second(at)).cast("long") * 1000
    if kind == "VARBINARY":
        return F.unbase64(value)
    if kind == "VARCHAR":
        return value
    raise ValueError(f"unknown type {kind}")


def scan(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str], types: Sequence[str | None], delimiter: str = "|", charset: str = "UTF-8", **formats: str) -> DataFrame:
    """Reads delimited lines of one or more files, plain or compressed.

    A column whose type is None is skipped unparsed, and so is all behind the last column named. Blank lines are skipped, an extra
    delimiter at the end of a line is allowed, and a line with fewer fields than columns is an error.
    """
    reader = spark.read.option("encoding", charset) if charset.upper() != "UTF-8" else spark.read
    lines = reader.text([paths] if isinstance(paths, str) else list(paths)) if charset.upper() == "UTF-8" else reader.schema("value string").option("sep", "\u0001").option("quote", "").csv([paths] if isinstance(paths, str) else list(paths))
    # A carriage return before the line feed is not part of the line.
    lines = lines.select(F.regexp_replace("value", "\r$", "").alias("value")).where(F.trim("value") != "")
    fields = F.split("value", f"\\Q{delimiter}\\E")
    rows = lines.select(fields.alias("f"))
    checked = F.when(F.size("f") >= len(names), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), F.concat_ws(delimiter, "f"))))
    return rows.select(checked.alias("f")).select(*(parsed(F.col("f")[k], kind, **formats).alias(name) for k, (name, kind) in enumerate(zip(names, types, strict=True)) if kind is not None))


def sample(df: DataFrame, n: int, seed: int = 12345) -> DataFrame:
    """n rows, each as likely as any other, the same for the same seed and input."""
    return df.orderBy(F.rand(seed)).limit(n)


def rows(spark: SparkSession, data: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A source of rows held in memory."""
    return spark.createDataFrame(data, schema)


def split_columns(df: DataFrame, path: str) -> None:
    """Writes each column to a folder of text files of its own, one line a row."""
    for name in df.columns:
        df.select(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def write_delimited(df: DataFrame, path: str, delimiter: str = "|", trailing: bool = False, files: int | None = None, compression: str = "none") -> None:
    """Writes rows as delimited lines, in `files` files if that is given; null is an empty field."""
    line = F.concat_ws(delimiter, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    out = df.select((F.concat(line, F.lit(delimiter)) if trailing else line).alias("value"))
    (out.coalesce(files) if files else out).write.mode("overwrite").option("compression", compression).text(path)
