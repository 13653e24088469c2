"""Predictions against labels: metrics, gates, threshold search, model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modwarden.profiles import GatePolicy, ThresholdPolicy


def ratio(a: Column, b: Column) -> Column:
    """Quotient, 0 when undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _prf(tp: Column, predicted: Column, positives: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, predicted), ratio(tp, positives)
    # 2pr/(p+r) written on counts, so it is one division.
    return p, r, ratio(2 * tp, predicted + positives)


def join_predictions(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return predictions.join(labels, key)


def confusion_metrics(df: DataFrame, score: str, label: str, flag: float, block: float) -> DataFrame:
    """Counts, precision, recall, F1 at the flag cut-off, and recall of the block tier."""
    pred, gold = F.col(score) >= flag, F.col(label) == 1
    c = df.agg(
        F.count_if(pred & gold).alias("tp"),
        F.count_if(pred & ~gold).alias("fp"),
        F.count_if(~pred & ~gold).alias("tn"),
        F.count_if(~pred & gold).alias("fn"),
        F.count_if((F.col(score) >= block) & gold).alias("block_tp"),
    )
    p, r, f1 = _prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return c.select(
        "tp", "fp", "tn", "fn",
        F.round(p, 6).alias("precision"),
        F.round(r, 6).alias("recall"),
        F.round(f1, 6).alias("f1"),
        F.round(ratio(F.col("block_tp"), F.col("tp") + F.col("fn")), 6).alias("block_recall"),
    )


def acceptance_gate(metrics: DataFrame, policy: GatePolicy = GatePolicy()) -> DataFrame:
    """Whether the counts reach the policy; the rounded columns are for reports only."""
    precision, recall = (ratio(F.col("tp"), F.col("tp") + F.col(x)) for x in ("fp", "fn"))
    return metrics.withColumn("passed", (precision >= policy.precision) & (recall >= policy.recall))


def threshold_sweep(df: DataFrame, score: str, label: str, policy: ThresholdPolicy = ThresholdPolicy()) -> DataFrame:
    """Precision, recall, F1 and number predicted at every grid threshold ``i / 100``.

    Scores are counted into grid cells first (one pass, map-side combined, at most 92 rows out);
    the sweep is a running sum over those cells, never scores times thresholds.
    """
    lo, hi = policy.grid_from, policy.grid_to
    s = F.col(score).cast("double")
    cell = F.floor(s * 100)
    # The cell is the last grid point not above the score, whatever the product rounded to.
    cell = F.when((cell + 1) / 100.0 <= s, cell + 1).when(cell / 100.0 > s, cell - 1).otherwise(cell)
    cell = F.greatest(F.lit(lo - 1), F.least(F.lit(hi), cell)).cast("int")
    counted = (
        df.filter(s.isNotNull())
        .groupBy(cell.alias("cell"))
        .agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"), F.max(s).alias("top"))
    )
    spark = df.sparkSession
    grid = spark.range(lo - 1, hi + 1).select(
        F.col("id").cast("int").alias("cell"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"),
        F.lit(None).cast("double").alias("top"),
    )
    cells = counted.unionByName(grid).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("top").alias("top"))
    down = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = cells.select(
        "cell",
        F.sum("n").over(down).alias("n_pred"),
        F.sum("pos").over(down).alias("tp"),
        F.sum("pos").over(everything).alias("positives"),
        F.max("top").over(everything).alias("max_score"),
    ).filter(F.col("cell") >= lo)
    p, r, f1 = _prf(F.col("tp"), F.col("n_pred"), F.col("positives"))
    return run.select(
        (F.col("cell") / 100.0).alias("threshold"), "n_pred", "tp",
        p.alias("precision"), r.alias("recall"), f1.alias("f1"), "max_score",
    )


def pick_thresholds(sweep: DataFrame, policy: ThresholdPolicy = ThresholdPolicy()) -> DataFrame:
    """One report row: flag and block thresholds with their metrics, and the highest score seen.

    Flag: best F1, lowest threshold on ties, a default when all are 0. Block: scanning downwards,
    the first with enough precision and coverage; else the first with coverage and any precision,
    or the last one with coverage when all precisions are 0; else a default.
    """
    row = F.struct("threshold", "precision", "recall", "f1")
    covered = F.col("n_pred") >= policy.block_min_predicted
    good = covered & (F.col("precision") >= policy.block_precision)
    any_precision = covered & (F.col("precision") > 0)
    best = sweep.agg(
        F.max_by(F.when(F.col("f1") > 0, row), F.struct(F.when(F.col("f1") > 0, F.col("f1")), -F.col("threshold"))).alias("flag"),
        F.max(F.when(good, row)).alias("good"),
        F.max(F.when(any_precision, row)).alias("fallback"),
        F.min(F.when(covered, row)).alias("covered"),
        F.round(F.max("max_score"), 3).alias("max_score"),
    )
    empty = F.struct(*[F.lit(0.0).alias(n) for n in ("precision", "recall", "f1")])
    block = F.coalesce("good", "fallback", "covered")
    return best.select(
        F.coalesce("flag.threshold", F.lit(policy.default_flag)).alias("flag_threshold"),
        *[F.round(F.coalesce(F.col("flag")[n], empty[n]), 4).alias(f"flag_{n}") for n in ("precision", "recall", "f1")],
        F.coalesce(block["threshold"], F.lit(policy.default_block)).alias("block_threshold"),
        *[F.round(F.coalesce(block[n], empty[n]), 4).alias(f"block_{n}") for n in ("precision", "recall", "f1")],
        "max_score",
    )


def compare_versions(a: DataFrame, b: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Two builds side by side on the same inputs; a row missing on one side stays visible."""
    left, right = a.select(key, F.col(score).alias("score_a")), b.select(key, F.col(score).alias("score_b"))
    return left.join(right, key, "full_outer").withColumn("drift", F.abs(F.col("score_a") - F.col("score_b")))


def drift_summary(compared: DataFrame, tolerance: float = 0.05) -> DataFrame:
    return compared.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("drift").isNull()).alias("one_sided"),
        F.round(F.max("drift"), 6).alias("max_drift"),
        F.round(F.avg("drift"), 6).alias("mean_drift"),
        F.count_if(F.col("drift") > tolerance).alias("beyond_tolerance"),
    )


def expectation_met(action: Column, expect: Column) -> Column:
    """Toxic must not come out clean, clean must, and a mild risk must not block."""
    return F.when(expect == "toxic", action != "clean").when(expect == "clean", action == "clean").otherwise(
        action != "block"
    )


def probe_expectations(df: DataFrame, action: str, expect: str) -> DataFrame:
    met = expectation_met(F.col(action), F.col(expect))
    return df.groupBy(expect).agg(F.count("*").alias("rows"), F.count_if(met).alias("met"))
