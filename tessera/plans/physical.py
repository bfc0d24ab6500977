"""Several physical plans of one query: each variant must give the rows of the query's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import load
from tessera.functions.scalars import discounted
from tessera.operators.relational import arg_max, late_lookup, top
from tessera.plans import layouts, tpch
from tessera.plans.shared import Query

LIMIT = 100


def _volume() -> Column:
    return discounted(F.col("l_extendedprice"), F.col("l_discount"))


def _q01(lines: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice")
    return (
        lines.where(F.col("l_shipdate") <= F.date_sub(F.lit("1998-12-01").cast("date"), 90))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(price), 2).alias("sum_base_price"),
            F.round(F.sum(_volume()), 2).alias("sum_disc_price"),
            F.round(F.sum(discounted(price, F.col("l_discount"), F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg(price), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def q01_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums where the rows are read."""
    return _q01(load(spark, sf_dir, "lineitem"))


def q01_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers by hand: states of each ship month, then their sum; the month states are what a rollup would keep."""
    lines = load(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.date_sub(F.lit("1998-12-01").cast("date"), 90))
    price = F.col("l_extendedprice")
    states = lines.groupBy("l_returnflag", "l_linestatus", F.trunc("l_shipdate", "month").alias("month")).agg(
        F.sum("l_quantity").alias("q"), F.sum(price).alias("p"), F.sum(_volume()).alias("d"), F.sum(discounted(price, F.col("l_discount"), F.col("l_tax"))).alias("c"), F.sum("l_discount").alias("i"), F.count("*").alias("n")
    )
    out = states.groupBy("l_returnflag", "l_linestatus").agg(*(F.sum(c).alias(c) for c in "qpdcin"))
    cols = [F.round("q", 2).alias("sum_qty"), F.round("p", 2).alias("sum_base_price"), F.round("d", 2).alias("sum_disc_price"), F.round("c", 2).alias("sum_charge")]
    cols += [F.round(F.col("q") / F.col("n"), 4).alias("avg_qty"), F.round(F.col("p") / F.col("n"), 4).alias("avg_price"), F.round(F.col("i") / F.col("n"), 6).alias("avg_disc"), F.col("n").alias("count_order")]
    return out.select("l_returnflag", "l_linestatus", *cols).orderBy("l_returnflag", "l_linestatus")


def _revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("1996-01-01").cast("date")
    # The condition on the key is what a join adds: with it, every use of the sums has the same plan, and they are made once.
    lines = load(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= start) & (F.col("l_shipdate") < F.add_months(start, 3)) & F.col("l_suppkey").isNotNull())
    return lines.groupBy("l_suppkey").agg(F.round(F.sum(_volume()), 2).alias("total_revenue"))


def _with_supplier(spark: SparkSession, sf_dir: str, best: DataFrame) -> DataFrame:
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return suppliers.join(best.withColumnRenamed("l_suppkey", "s_suppkey"), "s_suppkey").select("s_suppkey", "s_name", "total_revenue").orderBy("s_suppkey")


def q15_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximum goes to every task; the winners then look up their names."""
    return _with_supplier(spark, sf_dir, arg_max(_revenue(spark, sf_dir), "total_revenue"))


def q15_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names join first, as with a dimension that every node has."""
    total = _revenue(spark, sf_dir).withColumnRenamed("l_suppkey", "s_suppkey")
    named = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(total, "s_suppkey")
    return arg_max(named, "total_revenue").select("s_suppkey", "s_name", "total_revenue").orderBy("s_suppkey")


def q15_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within salted groups, then over the groups' winners, so that no task ranks all suppliers."""
    total = _revenue(spark, sf_dir).withColumn("salt", F.pmod(F.hash("l_suppkey"), F.lit(64)))
    best = total.withColumn("r", F.rank().over(Window.partitionBy("salt").orderBy(F.desc("total_revenue")))).where("r = 1")
    most = best.withColumn("r", F.rank().over(Window.orderBy(F.desc("total_revenue")))).where("r = 1")
    return _with_supplier(spark, sf_dir, most.select("l_suppkey", "total_revenue"))


def _chosen(parts: DataFrame) -> DataFrame:
    return parts.where((F.col("p_brand") == "Brand#3") & (F.col("p_type") == "MEDIUM")).select(F.col("p_partkey").alias("l_partkey"))


def _lines17(lines: DataFrame) -> DataFrame:
    return lines.select("l_partkey", "l_quantity", "l_extendedprice")


def _yearly(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.sum("l_extendedprice") / 7.0, 2).alias("avg_yearly"))


def q17_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge join of layouts that are dealt and sorted by the part key, then the average of each key in the same task: no exchange but for the sum."""
    lines, parts = layouts.read(spark, sf_dir, "lineitem", join_keys=("l_partkey",)), layouts.read(spark, sf_dir, "part", join_keys=("p_partkey",))
    joined = _lines17(lines).join(_chosen(parts).hint("merge"), "l_partkey")
    mean = F.avg("l_quantity").over(Window.partitionBy("l_partkey"))
    return _yearly(joined.withColumn("mean", mean).where(F.col("l_quantity") < 0.2 * F.col("mean")))


def q17_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of the chosen parts first, then the lines again against them: two scans, and no window over lines."""
    parts = _chosen(load(spark, sf_dir, "part"))
    lines = _lines17(load(spark, sf_dir, "lineitem"))
    mean = lines.join(parts, "l_partkey", "left_semi").groupBy("l_partkey").agg((0.2 * F.avg("l_quantity")).alias("least"))
    return _yearly(lines.join(mean, "l_partkey").where(F.col("l_quantity") < F.col("least")))


def _q18(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    best = top(ranked, LIMIT, F.desc("o_totalprice"), F.col("o_orderdate"), F.col("o_orderkey"))
    named = late_lookup(best.withColumnRenamed("o_custkey", "c_custkey"), LIMIT, load(spark, sf_dir, "customer"), "c_custkey", ["c_name"])
    out = named.select("c_name", "c_custkey", "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"), "o_totalprice", "sum_qty")
    return out.orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")


def q18_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities per order first, then orders, the first 100, and their customers' names last."""
    sums = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty")).where("sum_qty > 300")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return _q18(spark, sf_dir, orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey")))


def q18_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts by order key joined and grouped where they lie: no exchange before the first 100 are taken."""
    orders = layouts.read(spark, sf_dir, "orders", join_keys=("o_orderkey",)).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    lines = layouts.read(spark, sf_dir, "lineitem", join_keys=("l_orderkey",)).select("l_orderkey", "l_quantity")
    joined = orders.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    sums = joined.groupBy("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty")).where("sum_qty > 300")
    return _q18(spark, sf_dir, sums)


QUERIES: dict[str, Query] = {f.__name__: f for f in (q01_a, q01_b, q15_a, q15_b, q15_c, q17_a, q17_b, q18_a, q18_b)}
ORACLE_SQL = {k: tpch.ORACLE_SQL[k.split("_")[0]] for k in QUERIES}
