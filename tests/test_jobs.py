import time

import pytest

from tessera import jobs


def test_life_of_a_job(spark):
    df = jobs.compile_sql(spark, "SELECT id FROM {t} WHERE id < 3", t=spark.range(10))
    assert "Filter" in jobs.plan(df, "simple") and "Physical Plan" in jobs.plan(df)
    job = jobs.submit(df, "few")
    assert sorted(r.id for r in job.result(60)) == [0, 1, 2] and job.done and job.progress() == 1.0
    assert job.text() == "running\ndone" and job.text(0, 3) == "run"
    with pytest.raises(Exception):
        jobs.compile_sql(spark, "SELECT nothing FROM {t}", t=spark.range(1))
    with pytest.raises(ValueError):
        jobs.plan(df, "other")
    jobs.clear_caches(spark)


def test_failure_and_cancellation(spark):
    bad = jobs.submit(spark.sql("SELECT raise_error('broken') FROM range(3)"), "bad")
    with pytest.raises(RuntimeError):
        bad.result(60)
    slow = jobs.submit(spark.range(10**12).selectExpr("sum(id % 7 * (id % 5))"), "slow")
    with pytest.raises(TimeoutError):
        slow.result(1)
    assert 0 <= slow.progress() < 1
    slow.cancel()
    for _ in range(100):
        if slow.done:
            break
        time.sleep(0.1)
    assert slow.done and slow.cancelled and slow.failed


def test_hints(spark):
    a, b = spark.range(10), spark.range(10)
    for name, node in (("merge", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin"), ("shuffle_hash", "ShuffledHashJoin")):
        assert node in jobs.plan(a.join(jobs.optimise(b, {name: []}), "id"))
    assert jobs.optimise(a, {"repartition": [3]}).rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        jobs.optimise(a, {"nonsense": []})


def test_caches_are_dropped(spark):
    df = spark.range(10).selectExpr("id AS cached_id").cache()
    df.count()
    assert "InMemoryTableScan" in jobs.plan(spark.range(10).selectExpr("id AS cached_id"))
    jobs.clear_caches(spark)
    assert "InMemoryTableScan" not in jobs.plan(spark.range(10).selectExpr("id AS cached_id"))
