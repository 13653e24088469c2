import random

import pytest
from pyspark.sql import functions as F

from modwarden.operators import evaluate as ev
from modwarden.profiles import ThresholdPolicy


def frame(spark, rows):
    return spark.createDataFrame(rows, "s double, y int")


def pr(rows, t):
    tp = sum(s >= t and y == 1 for s, y in rows)
    n = sum(s >= t for s, _ in rows)
    pos = sum(y for _, y in rows)
    p, r = (tp / n if n else 0.0), (tp / pos if pos else 0.0)
    return n, tp, p, r, (2 * tp / (n + pos) if n + pos and tp else 0.0)


def pick(rows, p_min=.8, least=25):
    grid = [i / 100 for i in range(5, 96)]
    best, thr = 0, .5
    for t in grid:
        f1 = pr(rows, t)[4]
        if f1 > best:
            best, thr = f1, t
    block, precision = .9, 0.0
    for t in reversed(grid):
        n, _, p, _, _ = pr(rows, t)
        if p >= p_min and n >= least:
            block = t
            break
        if precision == 0.0 and n >= least:
            block, precision = t, p
    return thr, block


def cases():
    rng = random.Random(9)
    mixed = [(rng.random(), int(rng.random() < .3)) for _ in range(400)]
    return {
        "mixed": mixed,
        "separable": [(.5 * y + rng.random() * .5, y) for y in (rng.randint(0, 1) for _ in range(300))],
        "no_positive": [(rng.random(), 0) for _ in range(100)],
        "no_coverage": [(rng.random(), 1) for _ in range(10)],
        "equal_scores": [(.3, i % 2) for i in range(60)],
        "on_the_grid": [(i % 101 / 100, int(i % 7 == 0)) for i in range(500)],
        "negatives_on_top": [(.9, 0)] * 30 + [(.4, 1)] * 30,
    }


@pytest.mark.parametrize("name", list(cases()))
def test_sweep_and_pick_equal_brute_force(spark, name):
    rows = cases()[name]
    sweep = ev.threshold_sweep(frame(spark, rows), "s", "y")
    got = sorted(tuple(r) for r in sweep.collect())
    assert len(got) == 91
    for t, n, tp, p, r, f1, _ in got:
        assert (n, tp) == pr(rows, t)[:2] and abs(f1 - pr(rows, t)[4]) < 1e-12
    row = ev.pick_thresholds(sweep).first()
    assert (row.flag_threshold, row.block_threshold) == pick(rows)


def test_block_precision_is_a_parameter(spark):
    rows = cases()["separable"]
    policy = ThresholdPolicy(block_precision=.85, default_block=.95)
    got = ev.pick_thresholds(ev.threshold_sweep(frame(spark, rows), "s", "y", policy), policy=policy).first()
    assert got.block_threshold == pick(rows, .85)[1]


def test_metrics_gate_and_empty(spark):
    m = ev.confusion_metrics(frame(spark, [(.95, 1), (.6, 1), (.6, 0), (.1, 0), (.2, 1)]), "s", "y", .5, .9)
    r = ev.acceptance_gate(m).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 1, 1, 1) and r.precision == r.recall == r.f1 == .666667
    assert r.block_recall == .333333 and r.passed is False
    empty = ev.confusion_metrics(frame(spark, []), "s", "y", .5, .9).first()
    assert empty.precision == empty.recall == empty.f1 == 0.0


def test_gate_compares_exact_ratios(spark):
    m = spark.createDataFrame([(6_999_997, 3_000_003, 0, 0), (7, 3, 0, 3), (0, 0, 5, 0)], "tp long, fp long, tn long, fn long")
    assert [r.passed for r in ev.acceptance_gate(m).collect()] == [False, True, False]


def test_compare_versions_keeps_one_sided_rows(spark):
    a = spark.createDataFrame([(1, .5), (2, .25)], "k int, score double")
    b = spark.createDataFrame([(2, .5), (3, .1)], "k int, score double")
    d = ev.drift_summary(ev.compare_versions(a, b, "k")).first()
    assert (d.rows, d.one_sided, d.max_drift, d.beyond_tolerance) == (3, 2, .25, 1)


def test_probe(spark):
    df = spark.createDataFrame([("flag", "toxic"), ("clean", "toxic"), ("flag", "clean"), ("flag", "mild"), ("block", "mild")], "a string, e string")
    assert {r.e: (r["rows"], r.met) for r in ev.probe_expectations(df, "a", "e").collect()} == {
        "toxic": (2, 1), "clean": (1, 0), "mild": (2, 1)}
    assert df.filter(F.col("a") == "x").count() == 0
