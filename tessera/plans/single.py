"""A query for each operator by itself, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import storage
from tessera.catalog import Layout, load
from tessera.functions import scalars
from tessera.models import recovery
from tessera.operators import ranges as R
from tessera.operators import placement, relational
from tessera.operators.ingest import Store
from tessera.plans import layouts
from tessera.plans.shared import Query, plain, query
from tessera.sources import columnar, text

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _both(name: str, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query(sql), plain(sql)


def _spark(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _crc32(text: str) -> str:
    """CRC32 of an ASCII text in DuckDB, bit by bit."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_concat([CAST(ascii(substring({text}, i, 1)) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce(list_concat([4294967295], {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


# Scans and sinks.


@_spark("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag, CAST(CAST(l_shipdate AS DATE) AS STRING) AS l_shipdate FROM lineitem")
def s01_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem written as delimited text, with an extra delimiter at the end, and scanned again with types."""
    path = storage.scratch(spark, "text")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", F.col("l_shipdate").cast("date").alias("l_shipdate"))
    text.write_delimited(lines, path, trailing=True, compression="gzip")
    return text.scan(spark, path, lines.columns, ["BIGINT", "BIGINT", "INTEGER", "DOUBLE", "VARCHAR", "DATE"]).withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@_spark("SELECT l_orderkey, l_returnflag FROM lineitem")
def s02_partial_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only some columns are parsed; what is behind the last one is ignored."""
    path = storage.scratch(spark, "text")
    text.write_delimited(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus"), path)
    return text.scan(spark, path, ["l_orderkey", "l_partkey", "l_returnflag"], ["BIGINT", None, "VARCHAR"])


@_spark("SELECT CAST(least(100, count(*)) AS BIGINT) AS n, CAST(least(100, count(*)) AS BIGINT) AS n_known FROM orders")
def s03_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 100 rows, all of which are in the table, none twice."""
    orders = load(spark, sf_dir, "orders")
    some = text.sample(orders, 100)
    return some.join(orders.select("o_orderkey"), "o_orderkey", "left_semi").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_known"))


@_spark("SELECT l_orderkey, l_extendedprice FROM lineitem")
def s04_column_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")


@_spark("SELECT l_quantity FROM lineitem")
def s05_whole_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_quantity")


@_spark("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100")
def s06_seek_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 rows from the hundredth on of a sorted column file."""
    path = storage.scratch(spark, "sorted")
    columnar.write(load(spark, sf_dir, "part"), path, Layout("by_part", "p_partkey", 1, sort_key="p_partkey"))
    return columnar.at_rows(spark, path, 100, 50).select("p_partkey", "p_name")


@_spark("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (1, 77, 500)")
def s07_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed read of a sorted layout."""
    path = storage.scratch(spark, "sorted")
    columnar.write(load(spark, sf_dir, "lineitem"), path, Layout("by_order", "l_orderkey", 4, sort_key="l_orderkey"))
    return columnar.lookup(spark, path, "l_orderkey", [1, 77, 500]).select("l_orderkey", "l_linenumber", "l_quantity")


_both("s08_dictionary_filter", "SELECT p_partkey, p_brand, p_type FROM {part} WHERE p_brand = 'Brand#3' AND p_type = 'ECONOMY'")
_both("s09_range_search", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice >= 100000 AND o_totalprice <= 150000")


@_spark(
    """
WITH m AS (SELECT c_nationkey, c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k,
  CASE WHEN c_mktsegment = lag(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) THEN 0 ELSE 1 END AS new FROM customer),
r AS (SELECT *, sum(new) OVER (PARTITION BY c_nationkey ORDER BY k) AS run FROM m)
SELECT c_nationkey, any_value(c_mktsegment) AS c_mktsegment, CAST(min(k) - 1 AS BIGINT) AS start, count(*) AS length FROM r GROUP BY c_nationkey, run"""
)
def s10_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal values, within groups."""
    out = columnar.runs(load(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", within=("c_nationkey",))
    return out.select("c_nationkey", "c_mktsegment", F.col("start").cast("long").alias("start"), "length")


def _sink(codec: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = storage.scratch(spark, "sink")
        columnar.write(load(spark, sf_dir, "part"), path, Layout("p", "p_partkey", 4, sort_key="p_partkey", codec=codec))
        return spark.read.parquet(path)

    return run


for _codec in ("none", "snappy", "gzip", "zstd"):
    QUERIES[f"s11_sink_{_codec}"], ORACLE_SQL[f"s11_sink_{_codec}"] = _sink(_codec), "SELECT * FROM part"


@_spark("SELECT * FROM (VALUES (1, 'one', '2001-02-03', CAST(1.5 AS DOUBLE)), (2, NULL, NULL, NULL), (2, NULL, NULL, NULL)) t(k, s, d, x)")
def s15_row_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows held in memory, with nulls and a repeated one."""
    from datetime import date

    held = text.rows(spark, [(1, "one", date(2001, 2, 3), 1.5), (2, None, None, None), (2, None, None, None)], "k int, s string, d date, x double")
    return held.withColumn("d", F.col("d").cast("string"))


@_spark("SELECT c_custkey, c_name FROM customer")
def s16_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files, plain and compressed, read as one."""
    paths = [storage.scratch(spark, "text") for _ in range(3)]
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    for k, (path, codec) in enumerate(zip(paths, ("none", "gzip", "bzip2"), strict=True)):
        text.write_delimited(rows.where(F.col("c_custkey") % 3 == k), path, compression=codec, files=2)
    return text.scan(spark, paths, ["c_custkey", "c_name"], ["BIGINT", "VARCHAR"])


@_spark("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS overlaps, CAST(max(o_orderkey) AS BIGINT) AS greatest FROM orders")
def s18_zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a ranged layout: they hold all rows, and no two overlap."""
    zones = columnar.zone_map(columnar.arranged(load(spark, sf_dir, "orders"), Layout("o", "o_orderkey", 6, sort_key="o_orderkey")), "o_orderkey")
    before = F.max("greatest").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1))
    return zones.withColumn("before", before).agg(F.sum("rows").alias("n_rows"), F.sum(F.when(F.col("before") >= F.col("least"), 1).otherwise(0)).cast("long").alias("overlaps"), F.max("greatest").cast("long").alias("greatest"))


@_spark("SELECT r_name AS value FROM region")
def s23_column_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.scratch(spark, "columns")
    text.split_columns(load(spark, sf_dir, "region"), path)
    return spark.read.text(f"{path}/r_name")


# Projection and filters.

_both("p01_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM {lineitem}")
_both("p02_filter", "SELECT l_orderkey, l_quantity FROM {lineitem} WHERE l_quantity > 45 AND l_returnflag = 'N'")


@_spark("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000)")
def p03_skip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.skip(load(spark, sf_dir, "orders"), (F.col("o_orderstatus") == "F") | (F.col("o_totalprice") < 50000)).select("o_orderkey")


_both("p04_date_bound", "SELECT count(*) AS n FROM {lineitem} WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' DAY")
_both("p05_date_interval", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q FROM {lineitem} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '3' MONTH")
_both("p07_relative_filter", "SELECT l_partkey, count(*) AS n FROM {lineitem} l WHERE l_quantity < (SELECT 0.2 * avg(l_quantity) FROM {lineitem} m WHERE m.l_partkey = l.l_partkey) GROUP BY l_partkey")
_both("p08_having", "SELECT l_orderkey, round(sum(l_quantity), 2) AS q FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 250")
_both("p09_conjunction", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_shipdate BETWEEN DATE '1996-02-10' AND DATE '1996-02-16' AND l_discount BETWEEN 0.049 AND 0.071 AND l_quantity BETWEEN 26 AND 30")


@_spark("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def p11_range_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").where(R.Range(100, 200).column(F.col("o_orderkey"))).select("o_orderkey")


_both("p12_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE 'small%' OR p_type LIKE '%MO' OR (p_name LIKE '%o%l%' AND p_name NOT LIKE '%bolt%')")
_both("p13_in_lists", "SELECT p_partkey FROM {part} WHERE p_size IN (1, 2, 3) AND p_brand NOT IN ('Brand#1', 'Brand#2') AND p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49)")
_both("p14_or_of_ands", "SELECT count(*) AS n FROM {lineitem}, {part} WHERE (p_partkey = l_partkey AND p_size < 5 AND l_quantity < 10) OR (p_partkey = l_partkey AND p_size > 45 AND l_quantity > 40)")
_both("p15_column_comparison", "SELECT count(*) AS n FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate + INTERVAL '30' DAY AND o_orderdate < l_shipdate")
_both("p16_single_table", "SELECT s_name, s_acctbal FROM {supplier} WHERE s_acctbal > 1000")

# Joins.


def _bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bucketed layouts, written once and chosen by the catalog: a merge join without an exchange."""
    orders, lines = layouts.read(spark, sf_dir, "orders", join_keys=("o_orderkey",)), layouts.read(spark, sf_dir, "lineitem", join_keys=("l_orderkey",))
    return orders.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


_ORDER_SUMS = "SELECT o_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"
QUERIES["j01_copartitioned_join"], ORACLE_SQL["j01_copartitioned_join"] = _bucketed_join, _ORDER_SUMS


@_spark(_ORDER_SUMS)
def j02_repartition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    joined = load(spark, sf_dir, "orders").select("o_orderkey").join(lines.hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@_spark(_ORDER_SUMS + " HAVING sum(l_quantity) > 200")
def j03_join_after_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q")).where("q > 200")
    return load(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n", "q")


@_spark("SELECT o_orderkey, o_totalprice, c_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) JOIN customer ON o_custkey = c_custkey")
def j04_late_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = relational.top(load(spark, sf_dir, "orders"), 50, F.desc("o_totalprice"), F.col("o_orderkey")).withColumnRenamed("o_custkey", "c_custkey")
    return relational.late_lookup(best, 50, load(spark, sf_dir, "customer"), "c_custkey", ["c_name"]).select("o_orderkey", "o_totalprice", "c_name")


@_spark("SELECT l_shipdate, l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < DATE '1997-01-01' UNION ALL SELECT l_shipdate, l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= DATE '1997-01-01'")
def j06_merge_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    cut = F.lit("1997-01-01").cast("date")
    return relational.merge_sorted([lines.where(F.col("l_shipdate") < cut), lines.where(F.col("l_shipdate") >= cut)], 8, "l_shipdate", "l_orderkey")


_both("j08_semi_join", "SELECT o_orderkey FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_quantity >= 49)")


@_spark("SELECT count(*) AS n_missing FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))")
def j09_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.missing_keys(load(spark, sf_dir, "lineitem"), "l_orderkey", load(spark, sf_dir, "orders"), "o_orderkey").agg(F.count("*").alias("n_missing"))


_both("j12_multiway_join", "SELECT n_name, count(*) AS n FROM {customer}, {orders}, {lineitem}, {nation}, {region} WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY n_name")
_both("j13_self_join", "SELECT n1.n_name AS a, n2.n_name AS b FROM {nation} n1 JOIN {nation} n2 ON n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey")
_both("j14_outer_join", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
_both("j15_exists", "SELECT o_orderkey FROM {orders} WHERE EXISTS (SELECT * FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '90' DAY)")
_both("j15_not_exists", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT * FROM {orders} WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01')")



@_spark("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def j11_pervasive_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that every node has: it goes to the tasks that read the other side."""
    nations = layouts.read(spark, sf_dir, "nation", join_keys=("n_nationkey",))
    return load(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


# Aggregations.

_both("a03_hash_aggregate", "SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} GROUP BY l_suppkey")


@_spark("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))")
def a05_arg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.arg_max(load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "n")


_both("a07_global_sum", "SELECT round(sum(l_extendedprice), 2) AS total FROM {lineitem}")
_both("a12_count_by_key", "SELECT l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey")
_both("a13_distinct", "SELECT DISTINCT l_suppkey FROM {lineitem}")
_both("a14_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM {lineitem} GROUP BY l_returnflag")
_both("a15_min_max", "SELECT min(o_totalprice) AS least, max(o_totalprice) AS greatest, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM {orders}")


@_spark(
    f"""
SELECT count(*) AS tuples, CAST(sum(length(c_mktsegment)) AS BIGINT) AS bytes, count(DISTINCT c_mktsegment) AS n_distinct, CAST(sum(new) AS BIGINT) AS runs, min(c_mktsegment) AS least, max(c_mktsegment) AS greatest, CAST(sum(crc) AS BIGINT) AS checksum FROM (
  SELECT c_mktsegment, {_crc32("c_mktsegment")} AS crc, CASE WHEN c_mktsegment = lag(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) THEN 0 ELSE 1 END AS new FROM customer)"""
)
def a16_column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = columnar.column_statistics(load(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", within=("c_nationkey",))
    return out.select("tuples", "bytes", F.col("distinct").alias("n_distinct"), "runs", "least", "greatest", "checksum")


_both(
    "a17_statistics",
    "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS deviation, min(c_acctbal) AS least, max(c_acctbal) AS greatest, round(avg(log10(c_acctbal + 2000)), 6) AS log_mean, round(stddev_samp(log10(c_acctbal + 2000)), 6) AS log_deviation FROM {customer} GROUP BY c_mktsegment",
)
_both("a19_conditional_sums", "SELECT l_linestatus, CAST(sum(CASE WHEN l_quantity < 10 THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS high FROM {lineitem} GROUP BY l_linestatus")
_both("a20_two_levels", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) c GROUP BY n")
_both("a21_having_scalar", "SELECT l_suppkey, round(sum(l_quantity), 2) AS q FROM {lineitem} GROUP BY l_suppkey HAVING sum(l_quantity) > (SELECT 1.02 * sum(l_quantity) / count(DISTINCT l_suppkey) FROM {lineitem})")
_both("a22_correlated_min", "SELECT l_partkey, l_suppkey, l_extendedprice FROM {lineitem} l WHERE l_extendedprice = (SELECT min(l_extendedprice) FROM {lineitem} m WHERE m.l_partkey = l.l_partkey)")

# Windows as rewrites, sorting and sets.

_both("w01_window_average", "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM (SELECT l_extendedprice, l_quantity, avg(l_quantity) OVER (PARTITION BY l_partkey) AS mean FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE p_brand = 'Brand#3') w WHERE l_quantity < 0.2 * mean")
_both("o05_order_by", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
_both("o06_top_k", "SELECT o_orderkey, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_orderdate FROM {orders} ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100")
_both("o09_limit", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 20")


@_spark("SELECT n_nationkey AS s_nationkey, count(s_suppkey) AS uses FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal < 2000 GROUP BY n_nationkey ORDER BY uses, n_nationkey LIMIT 12")
def o10_least_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations with the fewest poor suppliers, those without one first."""
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    return relational.least_used(nations, load(spark, sf_dir, "supplier").where("s_acctbal < 2000"), "s_nationkey", 12)


@_spark("SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT p_brand AS v FROM part UNION SELECT p_type FROM part)")
def u02_dictionary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    return relational.dictionary(part.select(F.col("p_brand").alias("v")).union(part.select("p_type")), "v")


# Scalar functions.

_both("f04_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate - INTERVAL '90' DAY AS DATE) AS STRING) AS before, CAST(CAST(o_orderdate + INTERVAL '3' MONTH AS DATE) AS STRING) AS after, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y FROM {orders}")


@_spark("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS n FROM orders")
def f04_date_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = load(spark, sf_dir, "orders").select("o_orderkey", scalars.date_number(F.col("o_orderdate")).alias("n"))
    return out.select("o_orderkey", scalars.number_date(F.col("n")).cast("string").alias("d"), "n")


@_spark("SELECT p_partkey, p_name AS back FROM part")
def f05_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.unbase64(F.base64(F.col("p_name").cast("binary"))).cast("string").alias("back"))


@_spark(f"SELECT n_nationkey, {_crc32('n_name')} AS crc FROM nation")
def f06_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", F.crc32(F.col("n_name").cast("binary")).alias("crc"))


@_spark("SELECT a.n_nationkey AS x, b.n_nationkey AS y, CASE WHEN left(a.n_name, 8) = left(b.n_name, 8) THEN CASE WHEN a.n_name = left(b.n_name, length(a.n_name)) THEN a.n_name WHEN b.n_name = left(a.n_name, length(b.n_name)) THEN b.n_name ELSE left(a.n_name, 8) END ELSE left(a.n_name, 7) END AS prefix FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_nationkey <= 12")
def f07_common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations, of which there are 25 at every scale: a nested loop is fine."""
    a, b = load(spark, sf_dir, "nation").alias("a"), load(spark, sf_dir, "nation").alias("b")
    pairs = a.join(b, (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_nationkey") <= 12))
    return pairs.select(F.col("a.n_nationkey").alias("x"), F.col("b.n_nationkey").alias("y"), scalars.common_prefix(F.col("a.n_name"), F.col("b.n_name")).alias("prefix"))


@_spark("SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def f08_dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    codes = relational.dictionary(part, "p_brand")
    coded = relational.encode(part, "p_brand", codes).drop("p_brand")
    return relational.decode(coded, "p_brand", codes).select("p_partkey", "p_brand", "code")


@_spark("SELECT c_custkey, c_custkey AS plain, c_custkey % 1000 AS hex, CAST(-1 AS BIGINT) AS bad FROM customer")
def f02_parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in tens and sixteens, and one that is none, read back."""
    key = F.col("c_custkey")
    texts = load(spark, sf_dir, "customer").select(key, key.cast("string").alias("a"), F.hex(key % 1000).alias("b"), F.concat(F.lit("x."), key.cast("string")).alias("c"))
    return texts.select("c_custkey", scalars.integer_of(F.col("a")).alias("plain"), scalars.integer_of(F.col("b"), 16).alias("hex"), F.coalesce(scalars.integer_of(F.col("c")), F.lit(-1)).cast("long").alias("bad"))


@_spark("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, CAST(((hour(o_orderdate) * 60 + minute(o_orderdate)) * 60 + second(o_orderdate)) * 1000 AS BIGINT) AS t FROM orders")
def f03_parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and times of day by their text patterns."""
    texts = load(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.date_format("o_orderdate", "HH:mm:ss").alias("t"))
    return texts.select("o_orderkey", text.parsed(F.col("d"), "DATE").cast("string").alias("d"), text.parsed(F.col("t"), "TIME").alias("t"))


@_spark("SELECT CAST(k AS BIGINT) AS k, round(1 - exp(-k / 1000.0), 9) AS p, round(-1000.0 * ln(1 - k / 500.0), 6) AS draw FROM range(1, 500) t(k)")
def f10_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure probabilities, and draws of the exponential distribution from even quantiles."""
    k = F.col("id")
    return spark.range(1, 500).select(k.alias("k"), F.round(scalars.failure_probability(k, F.lit(1000.0)), 9).alias("p"), F.round(scalars.exponential(1000.0, k / 500.0), 6).alias("draw"))


_both("f12_substring", "SELECT c_custkey, substring(c_mktsegment FROM 1 FOR 3) AS s FROM {customer}")
_both("f13_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM {part}")

# Ranges and batches.

_WIDTH = """
WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders),
s AS (SELECT DISTINCT lo + ((hi - lo) * k) // 8 AS start FROM b, range(8) t(k))
SELECT CAST(x AS BIGINT) AS range_id, count(*) AS n, min(o_orderkey) AS least, max(o_orderkey) AS greatest
FROM (SELECT o_orderkey, (SELECT count(*) FROM s WHERE s.start <= o_orderkey) AS x FROM orders) GROUP BY x"""


@_spark(_WIDTH)
def m01_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of equal width, and the rows of each."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey")
    dealt = R.deal(orders, "o_orderkey", R.design(orders, "o_orderkey", 8))
    return dealt.groupBy(F.col("range_id").cast("long").alias("range_id")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("greatest"))


@_spark(
    """
WITH b AS (SELECT min(p_name) AS lo, max(p_name) AS hi FROM part),
p AS (SELECT *, (SELECT max(i) FROM range(0, 50) t(i) WHERE left(lo, i) = left(hi, i)) AS k FROM b),
c AS (SELECT DISTINCT left(hi, CAST(k AS INTEGER)) || chr(CAST(unicode(substring(lo, CAST(k + 1 AS INTEGER), 1)) + (unicode(substring(hi, CAST(k + 1 AS INTEGER), 1)) - unicode(substring(lo, CAST(k + 1 AS INTEGER), 1))) * j // 7 AS INTEGER)) AS cut FROM p, range(7) t(j))
SELECT range_id, count(*) AS n, min(p_name) AS least, max(p_name) AS greatest FROM (SELECT p_name, CAST((SELECT count(*) FROM c WHERE cut <= p_name) AS INTEGER) AS range_id FROM part) GROUP BY range_id"""
)
def m02_string_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a string key, cut by the first character in which its extremes differ."""
    part = load(spark, sf_dir, "part").select("p_name")
    ids = R.range_id(F.col("p_name"), R.design(part, "p_name", 7)).alias("range_id")
    return part.groupBy(ids).agg(F.count("*").alias("n"), F.min("p_name").alias("least"), F.max("p_name").alias("greatest"))


@_spark("SELECT CASE WHEN p_name < 'g' THEN 0 WHEN p_name < 'p' THEN 1 ELSE 2 END AS range_id, count(*) AS n FROM part GROUP BY 1")
def m03_assign_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range numbers of string keys."""
    cuts = [R.Range(None, "g"), R.Range("g", "p"), R.Range("p", None)]
    return load(spark, sf_dir, "part").groupBy(R.range_id(F.col("p_name"), cuts).alias("range_id")).agg(F.count("*").alias("n"))


@_spark("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS astray FROM lineitem")
def m08_repartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt by ranges of one key and again by another's: all are there, each in its range's partition."""
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    for key in ("l_partkey", "l_suppkey"):
        lines = R.deal(lines, key, R.design(lines, key, 6)).withColumn("_at", F.spark_partition_id())
    return lines.agg(F.count("*").alias("n_rows"), F.sum(F.when(F.col("range_id") != F.col("_at"), 1).otherwise(0)).cast("long").alias("astray"))


@_spark("SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 2 = 1) GROUP BY o_orderstatus")
def u01_union_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return orders.where("o_orderkey % 2 = 0").unionByName(orders.where("o_orderkey % 2 = 1")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


BY_PART = Layout("by_part", "l_partkey", 4, sort_key="l_partkey")
BY_SUPPLIER = Layout("by_supplier", "l_suppkey", 4, sort_key="l_shipdate", codec="gzip")
BY_PART_DATE = Layout("by_part_date", "l_partkey", 4, sort_key="l_shipdate")


def _store(spark: SparkSession, sf_dir: str, layouts: list[Layout]) -> Store:
    """lineitem in two batches, by ship date."""
    lines, cut = load(spark, sf_dir, "lineitem"), F.lit("1998-01-01").cast("date")
    store = Store(spark, storage.scratch(spark, "store"), list(layouts))
    store.add(lines.where(F.col("l_shipdate") < cut))
    store.add(lines.where(F.col("l_shipdate") >= cut))
    return store


@_spark("SELECT * FROM lineitem")
def m06_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches in two layouts; the union of the batches, from the second layout, is the table."""
    store = _store(spark, sf_dir, [BY_PART, BY_SUPPLIER])
    return store.read(BY_SUPPLIER)


@_spark("SELECT * FROM lineitem")
def m07_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third layout with other ranges and order, made from the first."""
    store = _store(spark, sf_dir, [BY_PART])
    store.rewrite(BY_PART, BY_SUPPLIER)
    return store.read(BY_SUPPLIER)


@_spark("SELECT * FROM lineitem")
def m11_merge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, [BY_PART])
    store.merge([0, 1])
    return store.read(BY_PART)


def _rebuilt(spark: SparkSession, sf_dir: str, other: Layout) -> DataFrame:
    store = _store(spark, sf_dir, [BY_PART, other])
    for part in (1, 2):
        storage.delete(spark, store.path(BY_PART, 0, part))
    store.rebuild(BY_PART, 0, other)
    return store.read(BY_PART)


@_spark("SELECT * FROM lineitem")
def m12_rebuild_same_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost ranges written again from a layout with the same ranges."""
    return _rebuilt(spark, sf_dir, BY_PART_DATE)


@_spark("SELECT * FROM lineitem")
def m13_rebuild_other_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost ranges written again from a layout with another key."""
    return _rebuilt(spark, sf_dir, BY_SUPPLIER)


@_spark(
    """
WITH racks AS (SELECT n_name AS rack, row_number() OVER (ORDER BY n_name) - 1 AS k FROM nation),
groups AS (SELECT r_name AS grp, row_number() OVER (ORDER BY r_name) - 1 AS k, count(*) OVER () AS n FROM region)
SELECT rack, grp FROM racks JOIN groups ON racks.k % groups.n = groups.k"""
)
def m16_place_racks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as racks and regions as groups: each rack goes to the group that has the fewest."""
    racks = [r[0] for r in load(spark, sf_dir, "nation").select("n_name").orderBy("n_name").collect()]
    groups = [r[0] for r in load(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()]
    return spark.createDataFrame(list(placement.assign_racks(racks, groups).items()), "rack string, grp string")


@_spark("SELECT CAST(s AS STRING) AS scheme, CAST(r AS BIGINT) AS range_id, 'node' || CAST((s * 12 + r) % 5 AS STRING) AS node FROM range(2) a(s), range(12) b(r)")
def m16_place_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 ranges in two layouts on five nodes: the load is even, and no node holds a range twice."""
    placed = placement.place(12, ["0", "1"], [f"node{k}" for k in range(5)])
    return spark.createDataFrame([(s, r, n) for (s, r), n in placed.items()], "scheme string, range_id long, node string")


# Models.


@_spark("SELECT CAST(k AS BIGINT) AS copies, round(CASE WHEN k <= 0 THEN 6.0 ELSE least(180.0 / k, 6.0) END, 6) AS network, round(1 / (1 / CASE WHEN k <= 0 THEN 6.0 ELSE least(180.0 / k, 6.0) END + 1 / 12.0), 6) AS rate FROM range(0, 200) t(k)")
def r05_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of each of k copies that share a backbone, with and without a disk behind."""
    network = scalars.network_rate(F.lit(180.0), F.lit(6.0), F.col("id"))
    return spark.range(200).select(F.col("id").alias("copies"), F.round(network, 6).alias("network"), F.round(scalars.harmonic(network, F.lit(12.0)), 6).alias("rate"))


_POLICIES = [[(3, 60)], [(2, 30), (1, 30)], [(1, 20), (1, 20), (1, 20)]]
_CLUSTERS = [(60, 40), (30, 40), (60, 20)]
_R01 = f"""
WITH RECURSIVE plan(racks, per_rack, policy, member, schemes, held) AS (
  VALUES {", ".join(f"({r}, {n}, {p}, {k}, {s}, {h})" for r, n in _CLUSTERS for p, groups in enumerate(_POLICIES) for k, (s, h) in enumerate(groups))}
), fixed AS (
  SELECT *, sum(schemes) OVER (PARTITION BY racks, per_rack, policy) * 420.0 AS gb, 4.3 * 30 * 24 * 60 AS mn, 10.2 * 365 * 24 * 60 AS mr, 60.0 * 24 * 365 AS horizon FROM plan
), cases AS (
  SELECT DISTINCT racks, per_rack, policy, gb, mn, mr FROM fixed
), rounds(racks, per_rack, policy, gb, mn, mr, k, node, rack) AS (
  SELECT racks, per_rack, policy, gb, mn, mr, 0, gb * (1 / least(180.0 / 1, 6.0) + 1 / 12.0), gb * (1 / least(180.0 / per_rack, 6.0) + 1 / 12.0) FROM cases
  UNION ALL
  SELECT racks, per_rack, policy, gb, mn, mr, k + 1, gb * (1 / least(180.0 / floor(1 + f + 0.5), 6.0) + 1 / 12.0), gb * (1 / least(180.0 / floor(per_rack + f + 0.5), 6.0) + 1 / 12.0)
  FROM (SELECT *, racks * per_rack * (node / (mn + node) + rack / (mr + rack)) AS f FROM rounds) WHERE k < 19
), rates AS (
  SELECT f.*, node, rack, held / schemes * (per_rack / f.mn * pow(1 - exp(-node * (1 / f.mn + 1 / f.mr)), schemes - 1) + 1 / f.mr * pow(1 - exp(-rack / f.mr), schemes - 1)) AS rate,
    420.0 * racks * per_rack / 40 / (0.6 * held * per_rack) AS deal
  FROM fixed f JOIN (SELECT * FROM rounds WHERE k = 19) USING (racks, per_rack, policy)
), lost AS (
  SELECT racks, per_rack, policy, node, rack, rate * horizon * coalesce((SELECT product(1 - exp(-o.deal * o.rate)) FROM rates o
    WHERE o.racks = r.racks AND o.per_rack = r.per_rack AND o.policy = r.policy AND o.member <> r.member), 1) AS n FROM rates r
)
SELECT CAST(racks AS BIGINT) AS racks, CAST(per_rack AS BIGINT) AS nodes_per_rack, CAST(policy AS BIGINT) AS policy, round(node, 6) AS node_minutes, round(rack, 6) AS rack_minutes, round(log10(sum(n) * 40), 6) AS log10_losses
FROM lost GROUP BY racks, per_rack, policy, node, rack"""


@_spark(_R01)
def r01_recoverability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected losses within a year, for some policies and cluster sizes; 4 tables of 10 fractures."""
    policies = [[recovery.Group(*g) for g in groups] for groups in _POLICIES]
    clusters = [recovery.Cluster(racks=r, nodes_per_rack=n) for r, n in _CLUSTERS]
    out = recovery.expected_losses(recovery.plans(spark, clusters, policies), 60.0 * 24 * 365, tables=4, fractures=10)
    return out.select("racks", "nodes_per_rack", "policy", F.round("node_minutes", 6).alias("node_minutes"), F.round("rack_minutes", 6).alias("rack_minutes"), F.round(F.log10("losses"), 6).alias("log10_losses"))


_TINY = recovery.Cluster(racks=6, nodes_per_rack=4, gb_per_node=20.0, mttf_node=3_000.0, mttf_rack=20_000.0)


def r02_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of nodes and racks for some seeds, a task for each."""
    seeds = spark.createDataFrame([(k,) for k in range(8)], "seed long").repartition(8)

    def run(frames):
        import pandas as pd

        for frame in frames:
            for seed in frame["seed"]:
                found = recovery.schedule(_TINY, 100_000.0, int(seed))
                yield pd.DataFrame({"seed": int(seed), "minutes": [t for t, _, _ in found], "kind": [k for _, k, _ in found], "which": [n for _, _, n in found]})

    return seeds.mapInPandas(run, "seed long, minutes double, kind string, which long")


def r03_block_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated time to a loss of a replicated block store, for two and three copies."""
    policies = {f"{k} copies": {"replication": k, "per_node": 40} for k in (1, 2, 3)}
    return recovery.summary(recovery.run_simulations(spark, recovery.simulate_blocks, range(12), policies, _TINY, 100_000.0))


def r04_fractured_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a fractured store, for some policies."""
    G = recovery.Group
    policies = {
        "one group of two": {"policy": recovery.Policy((G(2, 3),), fracture_gb=30.0)},
        "two groups of one": {"policy": recovery.Policy((G(1, 3), G(1, 3)), fracture_gb=30.0)},
        "coupled nodes": {"policy": recovery.Policy((G(2, 3),), fracture_gb=30.0, node_coupling=True)},
    }
    return recovery.summary(recovery.run_simulations(spark, recovery.simulate_fractures, range(12), policies, _TINY, 100_000.0))


QUERIES |= {"r02_schedule": r02_schedule, "r03_block_store": r03_block_store, "r04_fractured_store": r04_fractured_store}
