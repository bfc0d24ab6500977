"""The 22 decision-support queries and five variants, in the form that the data folder's tables allow.

There is no partsupp, and several columns are missing, so stand-ins are used: part type for the container, return flag for
the ship mode, and pairs of part and supplier that occur in lineitem for partsupp. Every ORDER BY that a LIMIT follows is total.
"""

from __future__ import annotations

from tessera.plans.shared import Query, plain, query

#: Supply of a part by a supplier, from what was sold.
_PS = "SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, round(min(l_extendedprice / l_quantity), 4) AS ps_supplycost, sum(l_quantity) AS ps_availqty FROM {lineitem} GROUP BY l_partkey, l_suppkey"

SQL = {
    "q01": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM {lineitem} WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' DAY
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "q02": f"""
WITH ps AS ({_PS})
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand
FROM {{part}}, {{supplier}}, ps, {{nation}}, {{region}}
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND p_type LIKE '%MO'
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND ps_supplycost = (SELECT min(ps_supplycost) FROM ps, {{supplier}}, {{nation}}, {{region}}
    WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "q03": """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_orderdate
FROM {customer}, {orders}, {lineitem}
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q04": """
SELECT o_orderpriority, count(*) AS order_count FROM {orders}
WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-07-01' + INTERVAL '3' MONTH
  AND EXISTS (SELECT * FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY)
GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "q05": """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {customer}, {orders}, {lineitem}, {supplier}, {nation}, {region}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL '2' YEAR
GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "q06": """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem}
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 - 0.000001 AND 0.07 + 0.000001 AND l_quantity < 24""",
    "q07": """
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(YEAR FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
  FROM {supplier}, {lineitem}, {orders}, {customer}, {nation} n1, {nation} n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))) shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "q08": """
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
  FROM {part}, {supplier}, {lineitem}, {orders}, {customer}, {nation} n1, {nation} n2, {region}
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
    AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') all_nations
GROUP BY o_year ORDER BY o_year""",
    "q09": """
SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) - 0.5 * p_retailprice * l_quantity AS amount
  FROM {part}, {supplier}, {lineitem}, {orders}, {nation}
  WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%bolt%') profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "q10": """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
FROM {customer}, {orders}, {lineitem}, {nation}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-01-01' + INTERVAL '3' MONTH
  AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q11": """
WITH v AS (SELECT l_partkey, sum(p_retailprice * l_quantity) AS value FROM {lineitem}, {part}, {supplier}, {nation}
  WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_4' GROUP BY l_partkey)
SELECT l_partkey AS ps_partkey, round(value, 2) AS value FROM v WHERE value > (SELECT sum(value) * 0.002 FROM v) ORDER BY value DESC, ps_partkey""",
    "q12": """
SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM {orders}, {lineitem}
WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
GROUP BY l_returnflag ORDER BY l_returnflag""",
    "q13": """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT OUTER JOIN {orders}
    ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' AND o_orderdate < DATE '1995-03-01' GROUP BY c_custkey) c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "q14": """
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM {lineitem}, {part} WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-09-01' + INTERVAL '1' MONTH""",
    "q15": """
WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM {lineitem}
  WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '3' MONTH GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM {supplier}, revenue
WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "q16": """
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM {lineitem}, {part}
WHERE p_partkey = l_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND l_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "q17": """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem}, {part}
WHERE p_partkey = l_partkey AND p_brand = 'Brand#3' AND p_type = 'MEDIUM'
  AND l_quantity < (SELECT 0.2 * avg(l2.l_quantity) FROM {lineitem} l2 WHERE l2.l_partkey = p_partkey)""",
    "q18": """
SELECT c_name, c_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty
FROM {customer}, {orders}, {lineitem}
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 300) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "q19": """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem}, {part}
WHERE (p_partkey = l_partkey AND p_brand = 'Brand#1' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 5)
   OR (p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 10)
   OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 15)""",
    "q20": """
SELECT s_suppkey, s_name FROM {supplier}, {nation}
WHERE s_suppkey IN (SELECT l_suppkey FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS available FROM {lineitem} WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY l_partkey, l_suppkey) ps
    WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_name LIKE 'small%')
      AND available > (SELECT 0.5 * sum(l.l_quantity) FROM {lineitem} l WHERE l.l_partkey = ps.l_partkey AND l.l_suppkey = ps.l_suppkey AND l.l_shipdate >= DATE '1995-01-01' AND l.l_shipdate < DATE '1997-01-01'))
  AND s_nationkey = n_nationkey AND n_regionkey = 1 ORDER BY s_suppkey""",
    "q21": """
SELECT s_name, count(*) AS numwait FROM {supplier}, {lineitem} l1, {orders}, {nation}
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
  AND EXISTS (SELECT * FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT * FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
  AND s_nationkey = n_nationkey GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "q22": """
SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
  SELECT substring(c_mktsegment FROM 1 FOR 2) AS cntrycode, c_acctbal FROM {customer}
  WHERE substring(c_mktsegment FROM 1 FOR 2) IN ('MA', 'BU', 'AU') AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0.00)
    AND NOT EXISTS (SELECT * FROM {orders} WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01')) custsale
GROUP BY cntrycode ORDER BY cntrycode""",
}

#: Variants in another dialect: DECODE for CASE, a view for a derived table. Their rows are those of the query named.
VARIANTS = {
    "q08_decode": ("q08", SQL["q08"].replace("CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END", "decode(nation, 'NATION_3', volume, 0)")),
    "q12_decode": (
        "q12",
        """
SELECT l_returnflag, CAST(sum(decode(o_orderpriority, '1-URGENT', 1, '2-HIGH', 1, 0)) AS BIGINT) AS high_line_count,
  CAST(sum(decode(o_orderpriority, '1-URGENT', 0, '2-HIGH', 0, 1)) AS BIGINT) AS low_line_count
FROM {orders}, {lineitem}
WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
GROUP BY l_returnflag ORDER BY l_returnflag""",
    ),
    "q13_view": (
        "q13",
        """
WITH orders_per_cust (custkey, ordercount) AS (
  SELECT c_custkey, count(o_orderkey) FROM {customer} LEFT OUTER JOIN {orders}
    ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' AND o_orderdate < DATE '1995-03-01' GROUP BY c_custkey)
SELECT ordercount AS c_count, count(*) AS custdist FROM orders_per_cust GROUP BY ordercount ORDER BY custdist DESC, c_count DESC""",
    ),
    "q14_decode": ("q14", SQL["q14"].replace("CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END", "decode(substring(p_type, 1, 5), 'PROMO', l_extendedprice * (1 - l_discount), 0)")),
    "q15_with": ("q15", SQL["q15"].replace("FROM {supplier}, revenue\nWHERE s_suppkey = supplier_no AND", "FROM {supplier} JOIN revenue ON s_suppkey = supplier_no\nWHERE")),
}

QUERIES: dict[str, Query] = {k: query(v) for k, v in SQL.items()} | {k: query(v) for k, (_, v) in VARIANTS.items()}
ORACLE_SQL = {k: plain(v) for k, v in SQL.items()} | {k: plain(SQL[same]) for k, (same, _) in VARIANTS.items()}
