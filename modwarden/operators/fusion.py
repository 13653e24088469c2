"""From part results to explainable verdicts, and their later refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modwarden import fixed_values as fv
from modwarden.functions import scores as sc
from modwarden.functions.text import let

REASON_TYPE = "struct<source:string,action:string,image_key:string,image_url:string>"


def _filled(c: Column) -> Column:
    """Null in place of an empty string."""
    return F.when(c != "", c)


def part(source: str, action: Column, detail: Column | None = None) -> Column:
    """One tier's result, ready for :func:`fuse`."""
    return F.struct(
        F.lit(source).alias("source"), action.alias("action"),
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
    )


def fuse(*parts: Column) -> Column:
    """OR rule over the parts of one row: strongest action, and every non-clean part as a reason."""

    def fused(listed: Column) -> Column:
        rank = F.array_max(F.transform(listed, lambda p: sc.action_rank(p["action"])))
        reasons = F.filter(listed, lambda p: p["action"].isin("flag", "block"))
        return let(rank, lambda r: F.struct(sc.rank_action(r).alias("action"), reasons.alias("reasons")))

    return let(F.array(*parts), fused)


def fuse_rows(parts: DataFrame, key: str, order: str, source: str = "source", action: str = "action") -> DataFrame:
    """OR rule over parts that lie in separate rows; a unit has one part per source and image."""
    rank = sc.action_rank(action)
    reason = F.struct(F.col(order), F.col(source).alias("source"), F.col(action).alias("action"))
    out = parts.groupBy(key).agg(
        F.max(rank).alias("_rank"), F.array_sort(F.collect_list(F.when(rank > 0, reason))).alias("_reasons")
    )
    return out.select(
        key,
        sc.rank_action(F.col("_rank")).alias("action"),
        F.transform("_reasons", lambda r: F.struct(r["source"].alias("source"), r["action"].alias("action"))).alias("reasons"),
    )


def strongest_reasons(
    reasons: DataFrame, key: str, order: str, source: str = "source", action: str = "action", image: str = "image_key", url: str | None = None
) -> DataFrame:
    """One reason per source and image: the newest, unless that would replace a block by less.

    An image is known by its key, or by its address where it has none and ``url`` names the column of addresses.
    """
    row = F.struct(F.col(action).alias("action"), F.col(order).alias("seen"))
    is_block = (F.col(action) == "block").cast("int")
    by = [F.coalesce(F.col(image), F.lit("")).alias(image)]
    if url:
        by.append(F.when(_filled(F.col(image)).isNull(), F.coalesce(F.col(url), F.lit(""))).otherwise("").alias(url))
    return (
        reasons.filter(F.col(action).isin("flag", "block"))
        .groupBy(key, source, *by)
        .agg(F.max_by(row, F.struct(is_block, F.col(order))).alias("_r"), F.min(order).alias("first_seen"))
        .select(key, source, image, *([url] if url else []), "_r.action", "_r.seen", "first_seen")
    )


def refine_verdict(base: DataFrame, additions: DataFrame, key: str, order: str) -> DataFrame:
    """Merge new media findings into stored verdicts; keys with no finding are left out.

    ``base`` and ``additions`` are reason rows; the base action also counts when it has no reasons.
    """
    touched = additions.filter(F.col("action").isin("flag", "block")).select(key).distinct()
    merged = strongest_reasons(
        base.unionByName(additions).join(touched, key, "left_semi"), key, order
    )
    return merged.groupBy(key).agg(
        sc.rank_action(F.max(sc.action_rank("action"))).alias("action"),
        F.count("*").alias("reasons"),
        F.count_if(F.col("action") == "block").alias("block_reasons"),
    )


def reconcile_media(reasons: Column, current_keys: Column, current_urls: Column | None = None) -> Column:
    """Reasons that still hold: text findings, and media findings on images the unit still shows.

    A finding without a source key, null or empty, is looked up by its ``image_url`` among the current addresses.
    """
    def holds(r: Column) -> Column:
        shown = F.array_contains(current_keys, _filled(r["image_key"]))
        if current_urls is not None:
            shown = F.when(_filled(r["image_key"]).isNotNull(), shown).otherwise(F.array_contains(current_urls, _filled(r["image_url"])))
        return ~F.coalesce(r["source"].isin(*fv.MEDIA_SOURCES), F.lit(False)) | F.coalesce(shown, F.lit(False))

    return F.filter(reasons, holds)


def reasons_action(reasons: Column) -> Column:
    return (
        F.when(F.exists(reasons, lambda r: r["action"] == "block"), "block")
        .when(F.exists(reasons, lambda r: r["action"] == "flag"), "flag")
        .otherwise("clean")
    )


def reconcile_verdicts(
    verdicts: DataFrame, reasons: str, current_keys: str, now: Column, ts: str = "ts", current_urls: str | None = None
) -> DataFrame:
    """Recomputes action and time where a finding was dropped; other rows pass unchanged."""
    urls = F.col(current_urls) if current_urls else None
    kept = verdicts.withColumn("_kept", reconcile_media(F.col(reasons), F.col(current_keys), urls))
    changed = F.size("_kept") != F.size(reasons)
    return (
        kept.withColumn("action", F.when(changed, reasons_action(F.col("_kept"))).otherwise(F.col("action")))
        .withColumn(ts, F.when(changed, now).otherwise(F.col(ts)))
        .withColumn(reasons, F.col("_kept"))
        .drop("_kept")
    )
