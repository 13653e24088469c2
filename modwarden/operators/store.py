"""The keyed verdict store: newest row per key, cache look-ups, statistics, bounds, admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modwarden.functions import scores as sc
from modwarden.operators.ranking import top_n_per_group


def last_write_wins(log: DataFrame, key: str, order: Sequence[str], version: str | None = None) -> DataFrame:
    """Newest row per key, as an aggregate: a key written a billion times is combined map-side."""
    cols = log.columns
    if version is not None:
        log = log.filter(F.col("policy_version") == version)
    newest = log.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    return newest.select(*[F.col("_row")[c].alias(c) for c in cols])


def merge_store(current: DataFrame, updates: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Batch upsert: the store after the updates; equal to replaying both logs."""
    return last_write_wins(current.unionByName(updates), key, order)


def cache_lookup(requests: DataFrame, store: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Stored verdict where key, policy version and settings policy all match; null means a miss."""
    known = store.select(*keys, *payload)
    return requests.join(known, list(keys), "left")


def cache_misses(requests: DataFrame, store: DataFrame, keys: Sequence[str]) -> DataFrame:
    return requests.join(store.select(*keys), list(keys), "left_anti")


def session_stats(store: DataFrame, action: str = "action") -> DataFrame:
    a = F.col(action)
    return store.agg(
        F.count_if(a == "block").alias("blocked"),
        F.count_if(a == "flag").alias("flagged"),
        F.count_if(a == "clean").alias("clean"),
        F.count("*").alias("total"),
    )


def stats_by_source(store: DataFrame, reasons: str = "reasons") -> DataFrame:
    """Reasons per source and action over the store.

    The outer explode keeps Catalyst from adding a size filter, which would compute derived reasons
    once more below the generator.
    """
    return (
        store.select(F.explode_outer(reasons).alias("r"))
        .filter("r is not null")
        .groupBy(F.col("r.source").alias("source"), F.col("r.action").alias("action"))
        .agg(F.count("*").alias("n"))
    )


def recent_verdicts(store: DataFrame, n: int, ts: str = "ts", key: str = "key") -> DataFrame:
    """Latest ``n`` rows; a missing time counts as 0. Runs as a per-task top-n."""
    return store.orderBy(F.coalesce(F.col(ts), F.lit(0)).desc(), F.col(key)).limit(n)


def keep_newest(store: DataFrame, partition: Sequence[str], ts: str, tie: str, n: int) -> DataFrame:
    """Bounded cache: the ``n`` most recent rows of each partition."""
    return top_n_per_group(store, partition, [F.desc(ts), F.desc(tie)], n, tie).drop("rank")


def admit(requests: DataFrame, cycle: str, key: str, priority: str, arrival: str, capacity: int) -> DataFrame:
    """Per cycle the work let in: duplicate keys share one slot at their best priority; the rest waits."""
    slots = requests.groupBy(cycle, key).agg(
        F.max(priority).alias("priority"), F.min(arrival).alias("arrival"), F.count("*").alias("requests")
    )
    taken = top_n_per_group(slots, [cycle], [F.desc("priority"), F.asc("arrival")], capacity, key)
    return slots.join(taken.select(cycle, key, "rank"), [cycle, key], "left").withColumn(
        "admitted", F.col("rank").isNotNull()
    )


def bound_queue(waiting: DataFrame, key: str, arrival: str, n: int) -> DataFrame:
    """Bounded retry queue: the ``n`` newest entries stay, and each older one is reported as dropped."""
    kept = top_n_per_group(waiting.withColumn("_queue", F.lit(0)), ["_queue"], [F.desc(arrival), F.desc(key)], n, key)
    marked = kept.select(key, F.lit(False).alias("_dropped"))
    return waiting.join(marked, key, "left").select("*", F.coalesce("_dropped", F.lit(True)).alias("dropped")).drop("_dropped")


def cacheable(images: DataFrame, action: str, *reasons: str) -> DataFrame:
    return images.filter(sc.is_cacheable(action, *[F.col(r) for r in reasons]))
