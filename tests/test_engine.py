import math
import random
import shutil
from datetime import date, datetime
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera import jobs, storage
from tessera.catalog import Catalog, Layout, schema_of
from tessera.functions import scalars
from tessera.models import recovery as rec
from tessera.operators import placement, ranges, relational
from tessera.operators.ingest import Store
from tessera.plans import layouts, registry
from tessera.sources import columnar, text
from tessera.streaming.batches import ingest_arrivals


def test_schema_rules():
    assert [f.dataType.simpleString() for f in schema_of(["a", "b"], ["BIGINT", "varchar"])] == ["bigint", "string"]
    for names, types in ([[""], ["BIGINT"]], [["a", "A"], ["BIGINT"] * 2], [["__EPOCH"], ["BIGINT"]], [["a"], ["INVALID"]], [["a"], []], [[], []]):
        with pytest.raises(ValueError):
            schema_of(names, types)


def test_catalog():
    c = Catalog()
    c.create_database("db")
    c.create_table("db", "orders", ["o_orderkey", "o_custkey"], ["BIGINT", "INTEGER"])
    c.create_table("db", "lines", ["l_orderkey", "l_shipdate"], ["BIGINT", "DATE"], key_index=0)
    assert c.table("db", "orders").key == "__epoch" and c.table("db", "lines").key == "l_orderkey"
    c.add_layout("db", "orders", Layout("o", "o_orderkey", 16, bucketed=True))
    assert c.add_layout("db", "lines", Layout("l", "l_orderkey", 4, linked_to="orders")).partitions == 16
    c.add_layout("db", "lines", Layout("d", "l_shipdate", 4, sort_key="l_shipdate"))
    assert c.choose_layout("db", "lines", join_keys=["l_orderkey"]).name == "l"
    assert c.choose_layout("db", "lines", filter_keys=["l_shipdate"]).name == "d"
    with pytest.raises(KeyError):
        c.table("db", "ORDERS")
    c.add_column("db", "orders", "note", "VARCHAR")
    c.drop_column("db", "orders", "note")
    with pytest.raises(ValueError):
        c.drop_column("db", "lines", "l_orderkey")
    c.drop_table("db", "orders")
    with pytest.raises(KeyError):
        c.table("db", "orders")
    with pytest.raises(ValueError):
        c.create_database("db")


def test_text_of_all_types(spark, tmp_path):
    lines = ["true|-5|300|-70000|12345678901234567|1.5|2.5E-3|2001-02-03|01:02:03|2001-02-03 04:05:06.789|text|aGk=|", "", "FALSE|1|||0|-1|7|1999-12-31|23:59:59|1999-12-31 23:59:59.001||"]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    kinds = ["BOOLEAN", "TINYINT", "SMALLINT", "INTEGER", "BIGINT", "FLOAT", "DOUBLE", "DATE", "TIME", "TIMESTAMP", "VARCHAR"]
    names = [k.lower() for k in kinds]
    got = text.scan(spark, str(tmp_path / "a.txt"), names, kinds).orderBy("tinyint").collect()
    assert tuple(got[0]) == (True, -5, 300, -70000, 12345678901234567, 1.5, 0.0025, date(2001, 2, 3), 3723000, datetime(2001, 2, 3, 4, 5, 6, 789000), "text")
    assert tuple(got[1]) == (False, 1, None, None, 0, -1.0, 7.0, date(1999, 12, 31), 86399000, datetime(1999, 12, 31, 23, 59, 59, 1000), None)
    assert text.scan(spark, [str(tmp_path / "a.txt")], names[:2], [None, "TINYINT"]).columns == ["tinyint"]
    (tmp_path / "b.txt").write_text("1|2\n3\n")
    with pytest.raises(Exception, match="too few fields"):
        text.scan(spark, str(tmp_path / "b.txt"), ["a", "b"], ["BIGINT", "BIGINT"]).collect()
    (tmp_path / "c.txt").write_text("x\n")
    with pytest.raises(Exception):
        text.scan(spark, str(tmp_path / "c.txt"), ["a"], ["BIGINT"]).collect()
    (tmp_path / "d.txt").write_bytes("é,1\r\n".encode("latin-1"))
    assert tuple(text.scan(spark, str(tmp_path / "d.txt"), ["a", "b"], ["VARCHAR", "INTEGER"], delimiter=",", charset="ISO-8859-1").first()) == ("é", 1)


def test_sample_is_stable(spark):
    df = spark.range(1000).repartition(3, "id")
    a, b = ([r.id for r in text.sample(df, 50).collect()] for _ in range(2))
    assert a == b and len(set(a)) == 50


def test_equal_width_ranges():
    R = ranges.Range
    got = ranges.equal_width(1, 36, 100)
    assert got[0] == R(None, 1) and got[-1] == R(35, None) and len(got) == 36 and got[1] == R(1, 2)
    assert ranges.equal_width(1, 36, 1) == [R()] and ranges.equal_width(None, None, 5) == [R()]
    assert len(ranges.equal_width(-5.0, 5.0, 4)) == 5
    assert [r.start for r in ranges.equal_width("abca", "abcz", 5)][1:] == ["abca", "abcf", "abck", "abcp", "abcu"]
    assert ranges.disjoint(got) and not ranges.disjoint([R(None, 5), R(4, None)])
    assert R(3, 5).contains(3) and not R(3, 5).contains(5)


@pytest.mark.parametrize("values", [[5, 1, 9, 9, 3, None], ["pa", "pz", "pk", None, "q"], [1.5, -2.0, 7.25]])
def test_ranges_hold_their_rows(spark, values):
    df = spark.createDataFrame([(v,) for v in values], f"k {({int: 'long', str: 'string', float: 'double'})[type(values[0])]}")
    r = ranges.design(df, "k", 3)
    got = ranges.deal(df, "k", r).collect()
    assert sorted(map(str, (x.k for x in got))) == sorted(map(str, values))
    assert all(x.k is None and x.range_id == 0 or r[x.range_id].contains(x.k) for x in got)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_store_life(spark, tmp_path):
    rng = random.Random(1)
    data = [(i, rng.randrange(50), rng.choice("abcd"), rng.random()) for i in range(400)]
    df = spark.createDataFrame(data, "k long, p int, s string, x double")
    a, b, c = Layout("a", "p", 4, sort_key="p"), Layout("b", "p", 4, sort_key="k", codec="gzip"), Layout("c", "k", 3, sort_key="s")
    store = Store(spark, str(tmp_path / "t"), [a, b, c])
    assert [store.add(df.where("k < 150")), store.add(df.where("k >= 150 AND k < 300")), store.add(df.where("k >= 300"))] == [0, 1, 2]
    for layout in (a, b, c):
        assert rows_of(store.read(layout)) == rows_of(df)
    assert store.batches == {0: 150, 1: 150, 2: 100}
    assert store.merge([0, 1]) == 3 and store.batches == {2: 100, 3: 300} and rows_of(store.read(c)) == rows_of(df)
    with pytest.raises(ValueError):
        store.merge([3])
    for source in (b, c):
        storage.delete(spark, store.path(a, 3, 1))
        storage.delete(spark, store.path(a, 3, 2))
        assert store.lost(a, 3) == [1, 2] and rows_of(store.read(a)) != rows_of(df)
        assert store.rebuild(a, 3, source) == [1, 2] and rows_of(store.read(a)) == rows_of(df)
        assert store.rebuild(a, 3) == []
    d = Layout("d", None, 1, sort_key="s")
    store.rewrite(a, d)
    assert rows_of(store.read(d)) == rows_of(df)
    assert store.compact_log() > 0 and all(s == "done" for *_, s in store.log)
    assert storage.is_directory(spark, store.path(a)) and storage.length(spark, store.path(a)) > 0


def test_arrivals_become_batches_once(spark, tmp_path):
    df = spark.range(20).selectExpr("id AS k", "CAST(id % 3 AS INT) AS p")
    df.where("k < 10").coalesce(1).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "t"), [Layout("a", "p", 2, sort_key="k")])
    assert ingest_arrivals(store, str(tmp_path / "in"), df.schema, str(tmp_path / "c")) == [0]
    assert ingest_arrivals(store, str(tmp_path / "in"), df.schema, str(tmp_path / "c")) == []
    df.where("k >= 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert ingest_arrivals(store, str(tmp_path / "in"), df.schema, str(tmp_path / "c")) == [1]
    assert rows_of(store.read()) == rows_of(df)


def test_relational(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 7.0), (4, None)], "k int, v double")
    assert sorted(r.k for r in relational.arg_max(df, "v").collect()) == [2, 3]
    assert [r.k for r in relational.skip(df, F.col("v") > 6).orderBy("k").collect()] == [1, 4]
    words = spark.createDataFrame([(w,) for w in ["b", "a", None, "c", "a"]], "w string")
    codes = relational.dictionary(words, "w")
    assert sorted(map(tuple, codes.collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows_of(relational.decode(relational.encode(words, "w", codes).drop("w"), "w", codes).select("w")) == rows_of(words)
    many = spark.range(5000).selectExpr("lpad(id, 6, '0') AS w")
    assert relational.dictionary(many, "w").where("CAST(w AS LONG) <> code").count() == 0
    assert [r.k for r in relational.missing_keys(df, "k", df.where("k < 3"), "k").orderBy("k").collect()] == [3, 4]
    merged = relational.merge_sorted([df.where("k % 2 = 0"), df.where("k % 2 = 1")], 2, "k").collect()
    assert [r.k for r in merged] == [1, 2, 3, 4]


def test_bucketed_join_has_no_exchange(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS k", "id * 2 AS v")
    for name in ("t1", "t2"):
        columnar.write_bucketed(df, name, str(tmp_path / name), Layout("x", "k", 4, bucketed=True))
    joined = spark.table("t1").join(spark.table("t2").hint("merge"), "k")
    assert joined.count() == 100 and "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    for name in ("t1", "t2"):
        spark.sql(f"DROP TABLE {name}")


def test_scalars(spark):
    row = spark.createDataFrame([("ff", "-7z", 20010203, "abcd", "abXd")], "a string, b string, d int, s string, t string").select(
        scalars.integer_of(F.col("a"), 16), scalars.integer_of(F.col("b"), 36), scalars.integer_of(F.lit("1.5")), scalars.number_date(F.col("d")), scalars.common_prefix(F.col("s"), F.col("t")), scalars.common_prefix(F.lit(""), F.col("t")), scalars.exponential(10.0, F.lit(0.5)), scalars.failure_probability(F.lit(1.0), F.lit(2.0))
    ).first()
    assert tuple(row)[:6] == (255, -(7 * 36 + 35), None, date(2001, 2, 3), "ab", "")
    assert row[6] == pytest.approx(10 * math.log(2)) and row[7] == pytest.approx(1 - math.exp(-0.5))


def test_placement():
    assert placement.assign_racks(["r1", "r2", "r3", "r4"], ["g", "h"]) == {"r1": "g", "r2": "h", "r3": "g", "r4": "h"}
    assert placement.assign_racks(["r1", "r2"], ["g", "h"], {"h": "x"}, {"r1": "x"}) == {"r1": "h", "r2": "g"}
    got = placement.place(4, ["a", "b"], ["n1", "n2", "n3"])
    assert all(got["a", r] != got["b", r] for r in range(4))
    beside = {("x", r): f"m{r}" for r in range(4)}
    assert all(placement.place(4, ["a"], ["n1"], beside=beside)["a", r] == f"m{r}" for r in range(4))


def test_expected_losses(spark):
    c = rec.Cluster()
    year = 60.0 * 24 * 365

    def losses(policies, **kwargs):
        rows = rec.expected_losses(rec.plans(spark, [c], policies), year, **kwargs).collect()
        return [r.losses for r in sorted(rows, key=lambda r: r.policy)], sorted(rows, key=lambda r: r.policy)

    # One layout: any failure of its nodes or racks, for every table.
    (one, two, three), rows = losses([[rec.Group(k, 60)] for k in (1, 2, 3)], tables=4)
    assert one == pytest.approx(4 * (year / c.mttf_node * 2400 + year / c.mttf_rack * 60))
    assert one > two > three > 0
    for k, r in enumerate(rows, 1):
        assert r.node_minutes >= 420 * k / c.copy(1) and r.rack_minutes >= r.node_minutes
        # The times are a fixed point.
        failing = c.nodes * (r.node_minutes / (c.mttf_node + r.node_minutes) + r.rack_minutes / (c.mttf_rack + r.rack_minutes))
        assert r.node_minutes == pytest.approx(420 * k / c.copy(math.floor(1 + failing + 0.5)))
    # Smaller fractures are dealt sooner, so fewer are lost meanwhile.
    (few,), _ = losses([[rec.Group(2, 30), rec.Group(1, 30)]], tables=4, fractures=1)
    (many,), _ = losses([[rec.Group(2, 30), rec.Group(1, 30)]], tables=4, fractures=1000)
    assert 0 < many < few * 1000


def test_schedule_and_simulations(spark):
    c = rec.Cluster(racks=4, nodes_per_rack=3, gb_per_node=10, mttf_node=500.0, mttf_rack=5000.0)
    events = rec.schedule(c, 20_000, 1)
    assert events == sorted(events) == rec.schedule(c, 20_000, 1) != rec.schedule(c, 20_000, 2)
    assert sum(k == "node" for _, k, _ in events) == pytest.approx(12 * 20_000 / 500, rel=0.25)
    blocks = rec.place_blocks(c, 3, 1.0, True, per_node=50)
    assert (blocks[:, 0] // 3 == blocks[:, 1] // 3).all() and (blocks[:, 0] != blocks[:, 1]).all() and (blocks[:, 2] // 3 != blocks[:, 0] // 3).all()
    spread = rec.place_blocks(c, 3, 1.0, False, per_node=50) // 3
    assert all(len(set(r)) == 3 for r in spread.tolist())
    first = next(t for t, _, _ in events)
    assert rec.simulate_blocks(c, 20_000, 1, replication=1, per_node=20) == first
    times = {k: [rec.simulate_blocks(c, 20_000, s, replication=k, per_node=20) for s in range(6)] for k in (1, 3)}
    assert np.median(times[3]) > np.median(times[1])
    lone = rec.Policy((rec.Group(1, 2),), fractures=1, fracture_gb=12)
    both = rec.Policy((rec.Group(2, 2), rec.Group(1, 2)), fractures=1, fracture_gb=12)
    a, b = ([rec.simulate_fractures(c, 20_000, s, p) for s in range(6)] for p in (lone, both))
    assert np.median(b) > np.median(a)
    out = rec.run_simulations(spark, rec.simulate_blocks, range(4), {"x": {"replication": 1, "per_node": 5}, "never": {"replication": 1, "per_node": 5}}, c, 20_000.0)
    assert rec.summary(out).where("runs = 4 AND losses = 4 AND deviation > 0").count() == 2
    none = rec.run_simulations(spark, rec.simulate_blocks, range(2), {"x": {"per_node": 5}}, rec.Cluster(racks=2, nodes_per_rack=2, mttf_node=1e12, mttf_rack=1e12), 10.0)
    assert rec.summary(none).first().losses == 0


def test_a_new_session_opens_the_catalog_and_its_stores(spark, tmp_path):
    root = str(tmp_path / "root")
    df = spark.createDataFrame([(i, i % 7, date(2001, 1, 1 + i % 28), f"s{i}") for i in range(90)], "k long, p int, d date, s string")
    c = Catalog(spark, root)
    c.create_database("db")
    c.create_table("db", "t", ["k", "p", "d", "s"], ["BIGINT", "INTEGER", "DATE", "VARCHAR"], key_index=0)
    for layout in (Layout("a", "d", 3, sort_key="k"), Layout("b", "p", 4, bucketed=True), Layout("c", "s", 2)):
        c.add_layout("db", "t", layout)
    assert [c.store("db", "t").add(df.where(x)) for x in ("k < 30", "k >= 30 AND k < 60", "k >= 60")] == [0, 1, 2]
    # Another session on the same folder knows all of it.
    other = spark.newSession()
    again = Catalog(other, root)
    assert again.table("db", "t") == c.table("db", "t") and again.choose_layout("db", "t", join_keys=["p"]).name == "b"
    store = again.store("db", "t")
    assert store.batches == {0: 30, 1: 30, 2: 30} and store.spans[1] == (30, 59) and store.ranges == c.store("db", "t").ranges
    for keys in ({"join_keys": ["p"]}, {"filter_keys": ["k"]}, {"filter_keys": ["s"]}):
        assert rows_of(again.read("db", "t", **keys)) == rows_of(df)
    assert store.merge([0, 2]) == 3 and store.spans[3] == (0, 89)
    layout = store.layouts[0]
    storage.delete(other, store.path(layout, 3, 1))
    assert Store.open(other, store.root).rebuild(layout, 3) == [1]
    bucketed = store.layouts[1]
    for name in storage.names(other, store.path(bucketed, 3)):
        if "_00002.c000" in name:
            storage.delete(other, f"{store.path(bucketed, 3)}/{name}")
    store = Store.open(other, store.root)
    assert store.lost(bucketed, 3) == [2] and store.rebuild(bucketed, 3) == [2] and store.lost(bucketed, 3) == []
    assert rows_of(Catalog(spark, root).read("db", "t", join_keys=["p"])) == rows_of(df)
    again.drop_table("db", "t")
    with pytest.raises(KeyError):
        Catalog(spark, root).table("db", "t")


def test_batches_whose_keys_overlap_are_refused(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS k", "CAST(id % 3 AS INT) AS p")
    store = Store(spark, str(tmp_path / "t"), [Layout("a", "p", 2)], key="k")
    store.add(df.where("k < 50"))
    for bad in ("k >= 49", "k > 10 AND k < 20", "k IN (0, 99)"):
        with pytest.raises(ValueError, match="overlap"):
            store.add(df.where(bad))
    assert store.add(df.where("k < 0")) == 1 and store.add(df.where("k >= 50")) == 2
    assert rows_of(Store.open(spark, store.root).read()) == rows_of(df)


def test_what_was_cut_off_does_not_count(spark, tmp_path, monkeypatch):
    df = spark.range(40).selectExpr("id AS k", "CAST(id % 3 AS INT) AS p")
    store = Store(spark, str(tmp_path / "t"), [Layout("a", "p", 2)])
    store.add(df.where("k < 10"))
    store.add(df.where("k >= 10 AND k < 20"))

    def stop(*_):
        raise OSError("cut off")

    for job in (lambda s: s.add(df.where("k >= 20")), lambda s: s.merge([0, 1])):
        broken = Store.open(spark, store.root)
        monkeypatch.setattr(broken, "_commit", stop)
        with pytest.raises(OSError):
            job(broken)
        after = Store.open(spark, store.root)
        assert after.batches == {0: 10, 1: 10} and rows_of(after.read()) == rows_of(df.where("k < 20"))
    after = Store.open(spark, store.root)
    assert after.vacuum() == ["a/batch=2"] and after.add(df.where("k >= 20")) == 2 and rows_of(after.read()) == rows_of(df)
    # A state that was cut off while it was written does not count either, and two writers cannot both go on.
    with pytest.raises(RuntimeError, match="another writer"):
        store.add(df)
    journal = storage.Journal(spark, str(tmp_path / "j"))
    assert journal.latest() == (0, None) and journal.commit(0, {"a": 1}) == 1
    (tmp_path / "j" / "000000000002.json").write_text('{"a": 2')
    assert journal.latest() == (2, {"a": 1}) and journal.commit(2, {"a": 3}) == 3 and journal.latest() == (3, {"a": 3})


def test_a_stream_batch_that_comes_again_is_not_taken(spark, tmp_path):
    df = spark.range(20).selectExpr("id AS k", "CAST(id % 3 AS INT) AS p")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    root, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    assert ingest_arrivals(Store(spark, root, [Layout("a", "p", 2)]), str(tmp_path / "in"), df.schema, checkpoint) == [0]
    # The stream forgets that it is done with its batch, as if Spark had stopped before it could note that.
    for name in (tmp_path / "c" / "commits").iterdir():
        name.unlink()
    store = Store.open(spark.newSession(), root)
    assert ingest_arrivals(store, str(tmp_path / "in"), df.schema, checkpoint) == [] and rows_of(store.read()) == rows_of(df)


@pytest.mark.parametrize("name", ["q17_a", "q18_b", "j01_copartitioned_join"])
def test_queries_read_layouts_without_an_exchange(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("SelectedBucketsCount") + plan.count("Bucketed: true") >= 2


def test_pushdown_of_more_queries(spark):
    plans = {k: jobs.plan(registry.QUERIES[k](spark, "/root/testdata/sf0.001")) for k in ("q01", "q03", "q14", "s07_key_lookup")}
    assert "LessThanOrEqual(l_shipdate" in plans["q01"] and "l_orderkey" not in plans["q01"]
    assert "GreaterThan(l_shipdate" in plans["q03"] and "LessThan(o_orderdate" in plans["q03"]
    assert "GreaterThanOrEqual(l_shipdate" in plans["q14"] and "In(l_orderkey, " in plans["s07_key_lookup"]
    # The aggregate that stands in the plan twice runs once.
    twice = registry.QUERIES["q15_a"](spark, "/root/testdata/sf0.001")
    twice.collect()
    assert "ReusedExchange" in twice._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("group,page", [(1 << 20, 1 << 20), (1 << 28, 1 << 13)])
def test_sorted_layouts_skip_row_groups_and_pages(spark, tmp_path, group, page):
    path = str(tmp_path / "sorted")
    df = spark.range(200_000).selectExpr("id AS k", "repeat(cast(hash(id) as string), 8) AS s")
    sizes = {"parquet.block.size": group, "parquet.page.size": page, "parquet.enable.dictionary": "false"}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    try:
        columnar.write(df, path, Layout("x", "k", 1, sort_key="k"))
    finally:
        for key in sizes:
            spark.conf.unset(key)
    meta = pq.ParquetFile(str(next(Path(path).glob("*.parquet")))).metadata
    assert (meta.num_row_groups > 3) == (group < 1 << 28) and meta.row_group(0).column(0).has_column_index
    found = columnar.lookup(spark, path, "k", [5])
    assert found.count() == 1
    found.collect()
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    # The scan gives out the rows of one row group, or of some pages, and no others.
    assert leaf.metrics().apply("numOutputRows").value() < 200_000 / 3


def test_other_file_systems(spark, tmp_path):
    """Everything goes through Hadoop's file systems: here by a mount table, under which local paths mean nothing."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tests.link./t", f"file://{tmp_path}")
    df = spark.range(30).selectExpr("id AS k", "CAST(id % 3 AS INT) AS p")
    root = "viewfs://tests/t/store"
    store = Store(spark, root, [Layout("a", "p", 2), Layout("b", "p", 2, bucketed=True)])
    store.add(df.where("k < 10"))
    store.add(df.where("k >= 10"))
    assert rows_of(Store.open(spark, root).read()) == rows_of(df) == rows_of(Store.open(spark, root).read(store.layouts[1]))
    assert store.merge([0, 1]) == 2 and storage.exists(spark, f"{root}/a/batch=2") and not storage.exists(spark, f"{root}/a/batch=0")
    text.write_delimited(df, "viewfs://tests/t/text")
    assert rows_of(text.scan(spark, "viewfs://tests/t/text", ["k", "p"], ["BIGINT", "INTEGER"])) == rows_of(df)
    assert storage.length(spark, "viewfs://tests/t/text") > 0 and storage.names(spark, "viewfs://tests/t/none") == []


def test_schedule_against_the_definition():
    """Each node and rack fails after exponential times, again and again; all failures of all of them, in order."""
    c = rec.Cluster(racks=3, nodes_per_rack=2, mttf_node=300.0, mttf_rack=900.0)
    rng = np.random.default_rng(9)
    want = []
    for kind, units, mean in (("node", 6, 300.0), ("rack", 3, 900.0)):
        for k in range(units):
            t = 0.0
            while True:
                t += -mean * math.log(1 - rng.random())
                if t >= 5000:
                    break
                want.append((t, kind, k))
    got = rec.schedule(c, 5000, 9)
    assert [(k, n) for _, k, n in got] == [(k, n) for _, k, n in sorted(want)] and np.allclose([t for t, *_ in got], sorted(t for t, *_ in want))


def plain_blocks(c, horizon, seed, replication, per_node):
    """simulate_blocks() with a set of nodes for each block, and nothing kept from event to event but what is left to copy."""
    blocks = [set(map(int, b)) for b in rec.place_blocks(c, replication, 1 / 16, True, per_node=per_node)]
    left, now = {}, 0.0
    for t, kind, which in rec.schedule(c, horizon, seed):
        while left:
            rate = c.network(len(left))
            step = max(0.0, (min(left.values()) - 0.5) / rate)
            part = min(step, t - now)
            left = {n: x - rate * part for n, x in left.items()}
            now += part
            if part < step:
                break
            left = {n: x for n, x in left.items() if x > 0.5 + 1e-9}
        now = t
        for n in [which] if kind == "node" else range(which * c.nodes_per_rack, (which + 1) * c.nodes_per_rack):
            left[n] = c.gb_per_node
            if any(b <= set(left) for b in blocks):
                return t
    return math.inf


@pytest.mark.parametrize("replication", [1, 2, 3])
def test_block_store_against_brute_force(replication):
    c = rec.Cluster(racks=4, nodes_per_rack=3, gb_per_node=30, mttf_node=900.0, mttf_rack=6000.0)
    got = [rec.simulate_blocks(c, 6_000, s, replication=replication, per_node=6) for s in range(25)]
    assert got == pytest.approx([plain_blocks(c, 6_000, s, replication, 6) for s in range(25)]) and len(set(got)) > 5


def test_fractured_store_in_the_limits():
    """Without recovery data are lost when every copy's node has failed; with instant recovery, when one event takes all copies of all groups."""
    slow = dict(disk=1e-9, backbone=1e-9, local_network=1e-9, local_repartition=1e-9)
    fast = dict(disk=1e12, backbone=1e12, local_network=1e12, local_repartition=1e12)
    one = rec.Policy((rec.Group(2, 2),), fractures=1, fracture_gb=8)
    for seed in range(12):
        c = rec.Cluster(racks=2, nodes_per_rack=3, mttf_node=700.0, mttf_rack=4000.0, **slow)
        # Where the parts lie: drawn as the simulation draws them.
        rng = np.random.default_rng(123456)
        nodes = (rng.permutation(2)[:, None] * 3 + np.arange(3)).ravel()
        first = nodes[rng.integers(0, 6, 8)]
        second = np.sort(nodes)[(np.searchsorted(np.sort(nodes), first) + rng.integers(1, 6, 8)) % 6]
        down, lost, at_once = set(), math.inf, math.inf
        for t, kind, which in rec.schedule(c, 5_000, seed):
            now = {which} if kind == "node" else {which * 3, which * 3 + 1, which * 3 + 2}
            down |= now
            if lost == math.inf and any({a, b} <= down for a, b in zip(first.tolist(), second.tolist(), strict=True)):
                lost = t
            if at_once == math.inf and any({a, b} <= now for a, b in zip(first.tolist(), second.tolist(), strict=True)):
                at_once = t
        assert rec.simulate_fractures(c, 5_000, seed, one) == lost
        assert rec.simulate_fractures(rec.Cluster(racks=2, nodes_per_rack=3, mttf_node=700.0, mttf_rack=4000.0, **fast), 5_000, seed, one) == at_once


def copied(tmp_path, *tables):
    """A data folder of its own: what is written for it is written anew."""
    for t in tables:
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
    return str(tmp_path)


def test_only_the_layouts_that_are_asked_for_are_written(spark, tmp_path):
    sf = copied(tmp_path, "lineitem", "orders")
    for keys, names in (((), ["l_orderkey"]), (("l_orderkey",), ["l_orderkey"]), (("l_partkey",), ["l_orderkey", "l_partkey"]), (("l_orderkey",), ["l_orderkey", "l_partkey"])):
        got = layouts.read(spark, sf, "lineitem", join_keys=keys)
        assert rows_of(got) == rows_of(spark.read.parquet(f"{sf}/lineitem.parquet"))
        held = Catalog(spark, f"{storage.shared_root(spark)}/layouts-{layouts._short(sf, layouts.buckets(spark, sf))}")
        (table,) = held.databases[layouts.DATABASE].values()
        store = Store.open(spark, f"{held.root}/{layouts.DATABASE}/{table.name}")
        assert [x.name for x in store.layouts] == names and sorted(n for n in storage.names(spark, store.root) if n[0] != "_") == names


def test_buckets_grow_with_the_table(spark, tmp_path, monkeypatch):
    sf = copied(tmp_path, "lineitem", "orders", "customer", "part")
    assert layouts.buckets(spark, sf) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = rows_of(registry.QUERIES["q18_a"](spark, sf)), rows_of(registry.QUERIES["q17_b"](spark, sf))
    monkeypatch.setattr(columnar, "TASK_BYTES", 64_000)
    n = layouts.buckets(spark, sf)
    assert n == columnar.tasks_for(spark.read.parquet(f"{sf}/lineitem.parquet")) > 8
    for name, rows in zip(("q18_b", "q17_a"), want, strict=True):
        got = registry.QUERIES[name](spark, sf)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert rows_of(got) == rows and "Exchange hashpartitioning" not in plan and f"SelectedBucketsCount: {n} out of {n}" in plan


def test_sorted_layouts_have_the_tasks_that_their_rows_need(spark, tmp_path, monkeypatch):
    df = spark.range(3000).selectExpr("(id * 7) % 3000 AS k", "repeat('x', 20) AS s").repartition(3)
    monkeypatch.setattr(columnar, "TASK_BYTES", 20_000)
    path = str(tmp_path / "sorted")
    columnar.write(df, path, Layout("x", "k", 2, sort_key="k"))
    files = sorted(Path(path).glob("*.parquet"))
    assert len(files) == columnar.tasks_for(df) > 10 and max(pq.ParquetFile(str(f)).metadata.num_rows for f in files) < 600
    held = [pq.read_table(str(f))["k"].to_pylist() for f in files]
    assert [k for x in held for k in x] == list(range(3000))
    for start, n in ((0, 1), (0, 3000), (len(held[0]) - 1, 2), (1000, 700), (2990, 50), (3000, 5), (7, 0)):
        assert [r.k for r in columnar.at_rows(spark, path, start, n).orderBy("k").collect()] == list(range(start, min(start + n, 3000)))
    assert rows_of(columnar.lookup(spark, path, "k", [1, 77, 2999, 5000])) == rows_of(df.where("k IN (1, 77, 2999)"))
    merged = relational.merge_sorted([df.where("k % 2 = 0"), df.where("k % 2 = 1")], 2, "k")
    assert merged.rdd.getNumPartitions() == len(files) and [r.k for r in merged.collect()] == list(range(3000))


def test_sizes_of_rows_of_all_types(spark):
    df = spark.sql("SELECT id, CAST(NULL AS STRING) AS n, CAST(repeat('a', 1000) AS BINARY) AS b, array(id, 2) AS a, map('k', id) AS m, named_struct('x', id) AS `s.t`, DATE '2001-01-01' AS d FROM range(200000)")
    assert columnar.tasks_for(df) == 2 and columnar.tasks_for(df.limit(5)) == 1 and columnar.tasks_for(df.where("id < 0")) == 1


def test_stores_deal_ranges_to_the_tasks_that_their_rows_need(spark, tmp_path, monkeypatch):
    # Nearly all rows are in one range, and most of them have one value of the sort key, or none.
    data = [(i, 1000 if i % 50 == 0 else i % 3, None if i % 5 == 0 else i % 7 // 6, f"s{i}") for i in range(4000)]
    df = spark.createDataFrame(data, "k long, p int, d int, s string").repartition(3)
    a, b, c, d = Layout("a", "p", 4, sort_key="d"), Layout("b", "p", 4, sort_key="s", codec="gzip"), Layout("c", "k", 3, sort_key="d"), Layout("d", None, sort_key="k")
    monkeypatch.setattr(columnar, "TASK_BYTES", 20_000)

    def check(store, layout, batch, rows):
        folders = sorted(Path(store.path(layout, batch)).glob("range_id=*")) or [Path(store.path(layout, batch))]
        most = 0
        for folder in folders:
            files = [pq.read_table(str(f), partitioning=None) for f in sorted(folder.glob("*.parquet"))]
            most = max([most, *(f.num_rows for f in files)])
            order = [(x is not None, x) for f in files for x in f[layout.sort_key].to_pylist()]
            # Nulls first, as Spark sorts.
            assert layout.partition_key is None or order == sorted(order, key=lambda x: (x[0], x[1] or type(x[1])()) if x[0] else (False,))
        assert most < rows / 4

    store = Store(spark, str(tmp_path / "t"), [a, b, c])
    assert [store.add(df.where("k < 2000")), store.add(df.where("k >= 2000"))] == [0, 1]
    for layout in (a, b, c):
        assert rows_of(store.read(layout)) == rows_of(df)
        for batch in (0, 1):
            check(store, layout, batch, 2000)
    other = Layout("e", "k", 5, sort_key="s")
    store.rewrite(a, other)
    store.rewrite(a, d)
    check(store, other, 0, 2000)
    assert store.merge([0, 1]) == 2
    for layout in (a, b, c, other, d):
        assert rows_of(store.read(layout)) == rows_of(df)
    for layout in (a, b, c, other):
        check(store, layout, 2, 4000)
    for source in (b, c):
        storage.delete(spark, store.path(a, 2, 1))
        assert store.lost(a, 2) == [1] and store.rebuild(a, 2, source) == [1] and rows_of(store.read(a)) == rows_of(df)
        check(store, a, 2, 4000)
    storage.delete(spark, store.path(d, 2, 0))
    assert store.rebuild(d, 2) == [0] and rows_of(store.read(d)) == rows_of(df)


@pytest.mark.parametrize("name", ["m11_merge_batches", "m06_import", "m07_rewrite", "m12_rebuild_same_ranges", "m13_rebuild_other_ranges"])
def test_no_task_writes_a_whole_range_of_a_large_table(spark, name, monkeypatch):
    monkeypatch.setattr(columnar, "TASK_BYTES", 32_000)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows_of(got) == rows_of(lines)
    assert got.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 2 * lines.count() / columnar.tasks_for(lines)
