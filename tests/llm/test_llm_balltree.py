"""Ball-tree search against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from modwarden.llm import balltree

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5):
    whole = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {r for r in whole if r[0] is not None and r[0] % 50 == 0}:
        met = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0, j) for j, v in whole if j != i and len(v) == len(q)), key=lambda t: t[:3])
        out += [(i, n, t[3], -t[0]) for n, t in enumerate(met[:k], 1)]
    return sorted(out, key=str)


def some_rows():
    rnd, hot = random.Random(2), [0.5] * 6
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(6)]) for i in range(500)] + [(i, hot) for i in range(500, 800)]
    odd = [(1, None), (2000, None), (2001, []), (2050, []), (2100, [float("nan")] * 6), (2150, [None] * 6), (2200, [float("inf")] * 6)]
    odd += [(None, hot), (None, [1.0] * 6), (50, rows[50][1]), (100, hot), (3000, [9.0] * 3), (3001, [1.0] * 3), (4000, [1.0])]
    return rows + odd


@pytest.mark.parametrize(("shard_rows", "k"), [(16_384, 5), (150, 5), (60, 3)])
def test_equal_to_all_products(spark, shard_rows, k):
    df = spark.createDataFrame(some_rows(), SCHEMA)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = balltree.top_k(df, F.col("vec_id") % 50 == 0, k=k, shard_rows=shard_rows, leaf=10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k)


def test_empty_table_and_few_candidates(spark):
    df = spark.createDataFrame([(50, [1.0]), (1, [2.0])], SCHEMA).withColumn("score", F.lit("x")).withColumn("shard", F.lit(1))
    assert [tuple(r) for r in balltree.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 1, 256 * 512)]
    assert balltree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert balltree.top_k(df.filter("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components(spark):
    big = [2.0**22, 2.0**22]
    df = spark.createDataFrame([(50, big), (1, big), (2, [2.0**22, -(2.0**22)])], SCHEMA)
    assert [tuple(r) for r in balltree.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 1, 2**61), (50, 2, 2, 0)]
    with pytest.raises(Exception, match="beyond"):
        balltree.top_k(spark.createDataFrame([(1, [1e30])], SCHEMA), F.col("vec_id") % 50 == 0)


def test_bounds_prune_and_hold():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 3, (400, 8)) for c in (-200, 0, 200)]).astype(np.int64)
    tree = balltree.BallTree(np.arange(len(x)), x, leaf=20)
    for (a, b), mid, radius in zip(tree.span, tree.centre, tree.radius, strict=True):
        assert (np.sqrt(((tree.points[a:b] - mid) ** 2).sum(axis=1)) <= radius + 1e-9).all()
    opened = []
    products = tree.products
    tree.products = lambda q, a, b, long: opened.append(len(q) * (b - a)) or products(q, a, b, long)
    q = x[::60]
    score, ids = tree.search(np.full(len(q), -1), q, np.full((len(q), 3), balltree._LEAST), np.full((len(q), 3), balltree._LAST))
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), (len(q), len(x))), -(q @ x.T)), axis=1)[:, :3]
    assert (np.sort(ids, axis=1) == np.sort(order, axis=1)).all() and (score == np.take_along_axis(q @ x.T, order, 1)).all()
    assert sum(opened) < len(q) * len(x) / 2
