"""The bucketed store against a dictionary, its plans and what it reads."""

import pytest
from pyspark.sql import functions as F

from modwarden.sources.buckets import BucketedStore

SCHEMA = "key string, action string, ts bigint, seq bigint"


@pytest.fixture
def rows(spark):
    return spark.range(400).selectExpr("concat('k', id) AS key", "'flag' AS action", "id AS ts", "id AS seq")


def parts(path, batch):
    return sorted((path / "rows" / f"batch={batch}").glob("part-*.parquet"))


def test_newest_row_per_key_over_batches_and_replays(spark, tmp_path, rows):
    store = BucketedStore(spark, str(tmp_path), SCHEMA, buckets=8)
    assert store.read().count() == 0 and store.lookup(rows.select("key"), ["action"]).filter("action is not null").count() == 0
    newer = rows.filter("seq % 2 = 0").withColumns({"ts": F.col("ts") + 5, "action": F.lit("block")})
    store.upsert(rows, "w-0")
    store.upsert(newer, "w-1")
    store.upsert(newer.filter("seq < 200"), "w-1")
    want = {f"k{i}": ("block", i + 5) if i % 2 == 0 and i < 200 else ("flag", i) for i in range(400)}
    assert {r.key: (r.action, r.ts) for r in store.read().collect()} == want
    assert store.live() == ["w-0", "w-1"] and len(parts(tmp_path, "w-1")) == 8
    # Another session object finds what is there.
    again = BucketedStore(spark, str(tmp_path), SCHEMA, buckets=8)
    assert {r.key: (r.action, r.ts) for r in again.read().collect()} == want
    for name in ("7", "base-1", "a/b", "x'y"):
        with pytest.raises(ValueError, match="name a batch"):
            store.upsert(rows, name)


def test_lookup_reads_only_buckets_that_may_hold_its_keys(spark, tmp_path, rows):
    store = BucketedStore(spark, str(tmp_path), SCHEMA, buckets=16)
    store.upsert(rows, "w-0")
    asked = spark.createDataFrame([("k3", "flag"), ("k4", "block"), ("absent-1", "flag"), (None, "flag")], "key string, wanted string")
    needed = set(store._needed(asked, store.live()))
    buckets = {r.key: r.b for r in asked.select("key", store.bucket("key").alias("b")).collect()}
    assert {buckets["k3"], buckets["k4"]} <= needed and len(needed) <= 3
    # Files of all other buckets are spoilt: they are not opened.
    for f in parts(tmp_path, "w-0"):
        if int(f.name.rsplit("_", 1)[1][:5]) not in needed:
            f.write_bytes(b"spoilt")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    out = store.lookup(asked, ["action", "ts"])
    assert sorted((str(r.key), r.action, r.ts) for r in out.collect()) == [("None", None, None), ("absent-1", None, None), ("k3", "flag", 3), ("k4", "flag", 4)]


def test_store_side_has_no_exchange(spark, tmp_path, rows):
    store = BucketedStore(spark, str(tmp_path), SCHEMA, buckets=8)
    store.upsert(rows, "w-0")
    store.upsert(rows.withColumn("ts", F.col("ts") + 1), "w-1")
    many = spark.range(5000).selectExpr("concat('k', id) AS key")
    plan = store.lookup(many, ["action"])._jdf.queryExecution().executedPlan().toString()
    # One exchange: the requests move.
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    assert "Exchange" not in store.read()._jdf.queryExecution().executedPlan().toString()


def test_filters_miss_no_key(spark, tmp_path, rows):
    store = BucketedStore(spark, str(tmp_path), SCHEMA, buckets=4)
    store.upsert(rows, "w-0")
    keys = rows.select("key").withColumn("b", store.bucket("key"))
    for r in keys.sample(0.1, seed=1).collect():
        assert store._needed(spark.createDataFrame([(r.key,)], "key string"), ["w-0"]) == [r.b]
    absent = spark.range(10_000, 10_300).selectExpr("concat('q', id) AS key").withColumn("b", store.bucket("key"))
    alone = [store._needed(spark.createDataFrame([(r.key,)], "key string"), ["w-0"]) for r in absent.limit(25).collect()]
    assert sum(map(len, alone)) <= 2


def test_compaction_deletes_after_the_grace_period(spark, tmp_path, rows):
    store = BucketedStore(spark, str(tmp_path), SCHEMA, buckets=4)
    store.upsert(rows, "w-0")
    store.upsert(rows.withColumn("ts", F.col("ts") + 1), "w-1")
    before = sorted(map(tuple, store.read().collect()))
    listed = store._rows(store.live())
    base = store.compact()
    assert store.live() == [base] and (tmp_path / "rows" / "batch=w-0").exists() and listed.count() == 800
    store.upsert(rows.limit(3).withColumn("ts", F.lit(900).cast("bigint")), "w-2")
    assert store.live() == [base, "w-2"]
    store.forget(0)
    assert not (tmp_path / "rows" / "batch=w-0").exists() and not (tmp_path / "_filters" / "w-1").exists() and store.live() == [base, "w-2"]
    now = {r.key: r.ts for r in store.read().collect()}
    assert len(now) == 400 and sum(t == 900 for t in now.values()) == 3
    assert sorted(k for k, *_ in before) == sorted(now)
