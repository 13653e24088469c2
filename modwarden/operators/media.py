"""Windows, images, OCR reads and animated frames: from scores to one decision each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modwarden.functions import scores as sc
from modwarden.functions import text as tx
from modwarden.profiles import MediaPolicy, OcrPolicy, ScorePolicy


def max_window_score(
    windows: DataFrame, key: str, policy: ScorePolicy = ScorePolicy(), evidence_chars: int = 240,
    ix: str = "ix", score: str = "score", text: str = "text",
) -> DataFrame:
    """Per unit the score that decides, the window it came from, and the action.

    The reported window is the first one at or above the block cut-off, else the highest one, the
    first on ties. Both are conditional aggregates, combined before the shuffle. A row without ``ix``
    stands for a unit without windows, which is clean with score 0.
    """
    s = F.col(score)
    row = F.struct(F.col(ix).alias("ix"), s.alias("score"), F.substring(text, 1, evidence_chars).alias("window"))
    out = windows.groupBy(key).agg(
        F.min_by(row, F.when(s >= policy.block, F.col(ix))).alias("first_block"),
        F.max_by(row, F.struct(s, -F.col(ix))).alias("top"),
        F.count(ix).cast("int").alias("n"),
    )
    hit = F.coalesce("first_block", "top")
    return out.select(
        key,
        F.coalesce(hit["score"], F.lit(0.0)).alias("score"),
        hit["ix"].alias("window_ix"),
        hit["window"].alias("window"),
        F.when(F.col("first_block").isNotNull(), F.col("first_block.ix") + 1).otherwise(F.col("n")).alias("windows"),
        sc.text_action(F.coalesce(hit["score"], F.lit(0.0)), policy).alias("action"),
        sc.text_tier(F.coalesce(hit["score"], F.lit(0.0)), policy).alias("tier"),
    )


def ocr_text_verdict(
    df: DataFrame, lexicon_action: str, score: str, text: str, policy: ScorePolicy = ScorePolicy(0.70, 0.35)
) -> DataFrame:
    """Verdict on text read off an image: lexicon then model; first block wins, else the last flag."""
    lex, model = F.col(lexicon_action), sc.text_action(score, policy)
    readable = F.length(tx.strip(text)) > 3
    source = (
        F.when(lex == "block", "lexicon-ocr")
        .when(model == "block", "ocr-text")
        .when(model == "flag", "ocr-text")
        .when(lex == "flag", "lexicon-ocr")
    )
    action = F.when(source == "lexicon-ocr", lex).when(source == "ocr-text", model).otherwise("clean")
    return (
        df.withColumn("ocr_action", F.when(readable, action).otherwise("clean"))
        .withColumn("ocr_source", F.when(readable, source))
        .withColumn(
            "ocr_reason",
            F.when(~readable, "no-ocr-text").when(F.col("ocr_action") == "clean", "ocr-text-clean"),
        )
    )


def image_rollup(images: DataFrame, key: str, ix: str, action: str, payload: Sequence[str]) -> DataFrame:
    """Strongest image of a post: the last block, else the first flag."""
    a = F.col(action)
    row = F.struct(a.alias("action"), F.col(ix).alias("ix"), *payload)
    out = images.groupBy(key).agg(
        F.max_by(row, F.when(a == "block", F.col(ix))).alias("_block"),
        F.min_by(row, F.when(a == "flag", F.col(ix))).alias("_flag"),
        F.count("*").alias("images"),
    )
    hit = F.coalesce("_block", "_flag")
    return out.select(
        key,
        F.coalesce(hit["action"], F.lit("clean")).alias("action"),
        hit["ix"].alias("image_ix"),
        *[hit[p].alias(p) for p in payload],
        "images",
    )


def best_ocr_candidate(
    passes: DataFrame, key: str, pass_ix: str, text: str, conf: str, policy: OcrPolicy = OcrPolicy()
) -> DataFrame:
    """Best read over the pass ladder: passes stop at the first good score.

    Every pass before the first good one scored less than it, so that pass is the best of the ones
    that ran; with no good one the highest score wins, the earlier on ties.
    """
    scored = passes.withColumn("_score", tx.ocr_candidate_score(text, conf))
    s, ix = F.col("_score"), F.col(pass_ix)
    row = F.struct(ix.alias("ix"), s.alias("score"), F.col(conf).alias("conf"), tx.squeeze(text).alias("text"))
    out = scored.groupBy(key).agg(
        F.min_by(row, F.when(s >= policy.stop_score, ix)).alias("_good"),
        F.max_by(row, F.when(s.isNotNull(), F.struct(s, -ix))).alias("_top"),
    )
    hit = F.coalesce("_good", "_top")
    usable = hit.isNotNull() & (hit["conf"] >= policy.min_confidence)
    return out.select(
        key,
        F.when(usable, hit["ix"]).alias("pass_ix"),
        F.when(usable, hit["score"]).alias("score"),
        F.when(usable, hit["conf"]).alias("conf"),
        F.when(usable, hit["text"]).otherwise("").alias("text"),
    )


def confirm_video(
    findings: DataFrame, scan: str = "scan_id", frame: str = "frame_ix", kind: str = "kind",
    source: str = "source", action: str = "action",
) -> DataFrame:
    """Video image findings need two distinct frames; OCR findings and animations act at once."""
    rank = sc.action_rank(action)
    needs_two = (F.col(kind) == "video") & (F.col(source) == "image")
    per_frame = (
        findings.filter(rank > 0)
        .groupBy(scan, frame, needs_two.alias("_two"))
        .agg(F.max(rank).alias("_rank"))
    )
    per_scan = per_frame.groupBy(scan).agg(
        F.count_if("_two").alias("image_frames"),
        F.max(F.when(F.col("_two"), F.col("_rank"))).alias("_image"),
        F.max(F.when(~F.col("_two"), F.col("_rank"))).alias("_now"),
    )
    confirmed = F.when(F.col("image_frames") >= 2, F.col("_image")).otherwise(0)
    rank_out = F.greatest(F.coalesce("_now", F.lit(0)), F.coalesce(confirmed, F.lit(0)))
    return per_scan.select(scan, "image_frames", sc.rank_action(rank_out).alias("action"))


def sample_frame_indexes(count: Column | str) -> Column:
    """First, one-third and two-thirds frame of an animation; none for a still."""
    n = tx._col(count)
    picks = F.array(F.lit(0), F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int"))
    return F.when(n >= 2, F.array_distinct(picks)).otherwise(F.array().cast("array<int>"))


def sample_video_frames(
    frames: DataFrame, scan: str, at: str, duration: str | None = None, policy: MediaPolicy = MediaPolicy()
) -> DataFrame:
    """First frame at or after each offset, inside the capture window that opens at the first frame."""
    src = frames
    if duration:
        src = src.filter((F.col(duration) > 0) & (F.col(duration) <= policy.video_limit_s))
    start = src.groupBy(scan).agg(F.min(at).alias("_start"))
    elapsed = F.col(at) - F.col("_start")
    bucket = F.lit(None).cast("int")
    for i, offset in enumerate(policy.frame_offsets):
        bucket = F.when(elapsed >= offset, i).otherwise(bucket)
    return (
        src.join(start, scan)
        .filter(elapsed <= policy.frame_window_s)
        .groupBy(scan, bucket.alias("bucket"))
        .agg(F.min(at).alias(at))
    )


def otsu_threshold(values: DataFrame, group: str, value: str) -> DataFrame:
    """Per group the threshold of an 8-bit column that maximises the variance between two classes.

    The 256-bin histogram is a map-side combined count; the scan runs over at most 256 rows a group.
    """
    bins = values.groupBy(group, F.col(value).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    below = Window.partitionBy(group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    mass = F.col("n") * F.col("bin")
    stats = bins.select(
        group,
        "bin",
        F.sum("n").over(below).cast("double").alias("wb"),
        F.sum(mass).over(below).cast("double").alias("sb"),
        F.sum("n").over(whole).cast("double").alias("nt"),
        F.sum(mass).over(whole).cast("double").alias("st"),
    )
    wf = F.col("nt") - F.col("wb")
    gap = F.try_divide(F.col("sb"), F.col("wb")) - F.try_divide(F.col("st") - F.col("sb"), wf)
    between = F.when(wf > 0, F.col("wb") * wf * gap * gap)
    return stats.groupBy(group).agg(
        F.coalesce(F.max_by("bin", F.when(between > 0, F.struct(between, -F.col("bin")))), F.lit(127)).alias("threshold")
    )


def media_status(
    image_incomplete: Column, ocr_status: Column, image_attempts: Column, ocr_attempts: Column,
    policy: MediaPolicy = MediaPolicy(), invalid_image: Column | None = None,
) -> Column:
    """State of a media pass, and what is to be retried while its allowance lasts."""
    pending = ocr_status.isin("timed-out", "deferred")
    ocr_failed = ocr_status == "error"
    retriable = ocr_failed if invalid_image is None else ocr_failed & ~invalid_image
    return F.struct(
        F.when(pending, "pending").when(image_incomplete | ocr_failed, "error").otherwise("complete").alias("state"),
        F.when(ocr_status == "timed-out", "ocr-in-flight")
        .when(ocr_status == "deferred", "capacity-full")
        .when(retriable & (ocr_attempts <= policy.ocr_retries), "ocr-error")
        .when(image_incomplete & (image_attempts <= policy.image_retries), "image-fetch")
        .alias("retry"),
    )
