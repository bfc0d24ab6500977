"""A small star-schema workload over order lines, derived from lineitem and orders; money is in cents and rates in percent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import load
from tessera.functions.scalars import date_number
from tessera.plans.shared import Query


def lineorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    percent = F.round(F.col("l_discount") * 100).cast("int")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("lo_orderkey"),
        F.col("l_linenumber").alias("lo_linenumber"),
        F.col("o_custkey").alias("lo_custkey"),
        F.col("l_partkey").alias("lo_partkey"),
        F.col("l_suppkey").alias("lo_suppkey"),
        date_number(F.col("o_orderdate")).alias("lo_orderdate"),
        F.col("l_quantity").cast("int").alias("lo_quantity"),
        cents.alias("lo_extendedprice"),
        percent.alias("lo_discount"),
    )


_LINEORDER = """lineorder AS (
  SELECT l_orderkey AS lo_orderkey, l_partkey AS lo_partkey, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS lo_orderdate,
    CAST(l_quantity AS INTEGER) AS lo_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS lo_extendedprice, CAST(round(l_discount * 100) AS INTEGER) AS lo_discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


#: Selling seasons by their months, and holidays as month and day.
SEASONS = {"Christmas": (11, 12), "Summer": (5, 8), "Winter": (1, 3), "Spring": (4, 4), "Fall": (9, 10)}
HOLIDAYS = ("12-24", "01-01", "02-20", "04-20", "05-20", "07-20", "08-20", "09-20", "10-20", "11-20")


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date dimension: every day from the first order's year to the last one's; weeks begin on Sunday."""
    ends = load(spark, sf_dir, "orders").agg(F.trunc(F.min("o_orderdate"), "year").alias("a"), F.date_sub(F.add_months(F.trunc(F.max("o_orderdate"), "year"), 12), 1).alias("b"))
    d = F.col("d")
    season = F.coalesce(*(F.when(F.month(d).between(a, b), name) for name, (a, b) in SEASONS.items()))
    flag = lambda x: x.cast("int").cast("string")
    return ends.select(F.explode(F.sequence("a", "b")).alias("d")).select(
        date_number(d).alias("d_datekey"),
        F.date_format(d, "MMMM d, yyyy").alias("d_date"),
        F.date_format(d, "EEEE").alias("d_dayofweek"),
        F.date_format(d, "MMMM").alias("d_month"),
        F.year(d).alias("d_year"),
        (F.year(d) * 100 + F.month(d)).alias("d_yearmonthnum"),
        F.date_format(d, "MMMyyyy").alias("d_yearmonth"),
        F.dayofweek(d).alias("d_daynuminweek"),
        F.dayofmonth(d).alias("d_daynuminmonth"),
        F.dayofyear(d).alias("d_daynuminyear"),
        F.month(d).alias("d_monthnuminyear"),
        F.expr("CAST(dayofyear(d) div 7 + 1 AS INT)").alias("d_weeknuminyear"),
        season.alias("d_sellingseason"),
        F.length(season).alias("d_seasonlength"),
        flag(F.dayofweek(d) == 7).alias("d_lastdayinweekfl"),
        flag(F.last_day(d) == d).alias("d_lastdayinmonthfl"),
        flag(F.date_format(d, "MM-dd").isin(*HOLIDAYS)).alias("d_holidayfl"),
        flag(F.dayofweek(d).between(2, 6)).alias("d_weekdayfl"),
    )


_DATES = f"""dates AS (
  SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS d_datekey, strftime(d, '%B %-d, %Y') AS d_date, dayname(d) AS d_dayofweek, monthname(d) AS d_month, CAST(year(d) AS INTEGER) AS d_year,
    CAST(year(d) * 100 + month(d) AS INTEGER) AS d_yearmonthnum, strftime(d, '%b%Y') AS d_yearmonth, CAST(dayofweek(d) + 1 AS INTEGER) AS d_daynuminweek, CAST(day(d) AS INTEGER) AS d_daynuminmonth,
    CAST(dayofyear(d) AS INTEGER) AS d_daynuminyear, CAST(month(d) AS INTEGER) AS d_monthnuminyear, CAST(dayofyear(d) // 7 + 1 AS INTEGER) AS d_weeknuminyear, season AS d_sellingseason, CAST(length(season) AS INTEGER) AS d_seasonlength,
    CAST(CAST(dayofweek(d) = 6 AS INTEGER) AS STRING) AS d_lastdayinweekfl, CAST(CAST(last_day(d) = d AS INTEGER) AS STRING) AS d_lastdayinmonthfl,
    CAST(CAST(strftime(d, '%m-%d') IN {HOLIDAYS} AS INTEGER) AS STRING) AS d_holidayfl, CAST(CAST(dayofweek(d) BETWEEN 1 AND 5 AS INTEGER) AS STRING) AS d_weekdayfl
  FROM (SELECT d, CASE {" ".join(f"WHEN month(d) BETWEEN {a} AND {b} THEN '{name}'" for name, (a, b) in SEASONS.items())} END AS season
    FROM (SELECT CAST(unnest(generate_series(date_trunc('year', min(o_orderdate)), date_trunc('year', max(o_orderdate)) + INTERVAL '1' YEAR - INTERVAL '1' DAY, INTERVAL '1' DAY)) AS DATE) AS d FROM orders)))"""


def _people(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Customers or suppliers with their nation, region and city, one of ten of each nation."""
    p = table[0]
    places = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = load(spark, sf_dir, table).join(places, F.col(f"{p}_nationkey") == F.col("n_nationkey"))
    key = F.col(f"{p}_custkey" if p == "c" else f"{p}_suppkey")
    city = F.concat(F.rpad(F.substring("n_name", 1, 9), 9, " "), (key % 10).cast("string"))
    return rows.select(key, f"{p}_name", city.alias(f"{p}_city"), F.col("n_name").alias(f"{p}_nation"), F.col("r_name").alias(f"{p}_region"), *(["c_mktsegment"] if p == "c" else []))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir, "customer")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir, "supplier")


def region_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by year and nations of customer and supplier in one region, over the whole star; which dimensions are broadcast is decided by their sizes."""
    facts = lineorder(spark, sf_dir).select("lo_custkey", "lo_suppkey", "lo_orderdate", "lo_extendedprice")
    buyers, sellers = customers(spark, sf_dir).where("c_region = 'ASIA'"), suppliers(spark, sf_dir).where("s_region = 'ASIA'")
    days = dates(spark, sf_dir).select("d_datekey", "d_year").where("d_year BETWEEN 1996 AND 1998")
    star = facts.join(buyers, F.col("lo_custkey") == F.col("c_custkey")).join(sellers, F.col("lo_suppkey") == F.col("s_suppkey")).join(days, F.col("lo_orderdate") == F.col("d_datekey"))
    return star.groupBy("c_nation", "s_nation", "d_year").agg(F.sum("lo_extendedprice").alias("revenue"))


def group_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineorder(spark, sf_dir).groupBy("lo_orderdate").agg(F.sum("lo_extendedprice").alias("total"))


def group_by_date_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over input in ranges of the date, sorted: the group-by needs no further shuffle."""
    ranged = lineorder(spark, sf_dir).select("lo_orderdate", "lo_extendedprice").repartitionByRange("lo_orderdate").sortWithinPartitions("lo_orderdate")
    return ranged.groupBy("lo_orderdate").agg(F.sum("lo_extendedprice").alias("total"))


def filtered_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = lineorder(spark, sf_dir).where("lo_orderdate BETWEEN 19960101 AND 19960331 AND lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 30")
    return few.agg(F.sum(F.col("lo_extendedprice") * F.col("lo_discount")).alias("revenue"))


def part_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact table against a dimension; which side is broadcast, if any, is decided by its measured size."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    return lineorder(spark, sf_dir).join(parts, F.col("lo_partkey") == F.col("p_partkey")).agg(F.sum(F.col("p_size") * F.col("lo_extendedprice")).alias("total"))


QUERIES: dict[str, Query] = {"ssb_group_by_date": group_by_date, "ssb_group_by_date_sorted": group_by_date_sorted, "ssb_filtered_sum": filtered_sum, "ssb_part_join": part_join, "ssb_dates": dates, "ssb_customers": customers, "ssb_suppliers": suppliers, "ssb_region_years": region_years}
_PEOPLE = "SELECT {key}, {p}_name, rpad(substring(n_name, 1, 9), 9, ' ') || CAST({key} % 10 AS STRING) AS {p}_city, n_name AS {p}_nation, r_name AS {p}_region{more} FROM {table} JOIN nation ON {p}_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_CUSTOMERS = _PEOPLE.format(key="c_custkey", p="c", table="customer", more=", c_mktsegment")
_SUPPLIERS = _PEOPLE.format(key="s_suppkey", p="s", table="supplier", more="")
_GROUP = f"WITH {_LINEORDER} SELECT lo_orderdate, CAST(sum(lo_extendedprice) AS BIGINT) AS total FROM lineorder GROUP BY lo_orderdate"
ORACLE_SQL = {
    "ssb_group_by_date": _GROUP,
    "ssb_group_by_date_sorted": _GROUP,
    "ssb_filtered_sum": f"WITH {_LINEORDER} SELECT CAST(sum(lo_extendedprice * lo_discount) AS BIGINT) AS revenue FROM lineorder WHERE lo_orderdate BETWEEN 19960101 AND 19960331 AND lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 30",
    "ssb_part_join": f"WITH {_LINEORDER} SELECT CAST(sum(p_size * lo_extendedprice) AS BIGINT) AS total FROM lineorder JOIN part ON lo_partkey = p_partkey",
    "ssb_dates": f"WITH {_DATES} SELECT * FROM dates",
    "ssb_customers": _CUSTOMERS,
    "ssb_suppliers": _SUPPLIERS,
    "ssb_region_years": f"""WITH {_DATES}, lo AS (SELECT o_custkey, l_suppkey, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS k, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT c_nation, s_nation, d_year, CAST(sum(price) AS BIGINT) AS revenue FROM lo JOIN ({_CUSTOMERS}) ON o_custkey = c_custkey JOIN ({_SUPPLIERS}) ON l_suppkey = s_suppkey JOIN dates ON k = d_datekey
WHERE c_region = 'ASIA' AND s_region = 'ASIA' AND d_year BETWEEN 1996 AND 1998 GROUP BY c_nation, s_nation, d_year""",
}
