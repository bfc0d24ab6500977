import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import jobs
from tessera.plans import registry, substitution, tpch
from tessera.plans.shared import names_in, plain

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.5f}"
    return re.sub(r"(\d{4}-\d\d-\d\d) 00:00:00$", r"\1", str(x))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(cell(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    want = db.execute(registry.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_text_for_both_engines():
    assert names_in("SELECT * FROM {a}, {b} x") == ["a", "b"] and plain("SELECT * FROM {a}") == "SELECT * FROM a"


def test_filters_and_columns_reach_the_scan(spark):
    plan = jobs.plan(registry.QUERIES["q06"](spark, SF))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(l_shipdate", plan) and "l_returnflag" not in plan and "l_orderkey" not in plan


@pytest.mark.parametrize("name", sorted(tpch.SQL))
def test_substitution_is_seeded(db, name):
    texts = [substitution.text(name, seed) for seed in range(30)]
    assert texts == [substitution.text(name, seed) for seed in range(30)] and len(set(texts)) > 1
    for sql in set(texts):
        db.execute(f"EXPLAIN {plain(sql)}")
        assert "\0" not in sql and names_in(sql) == names_in(tpch.SQL[name])
