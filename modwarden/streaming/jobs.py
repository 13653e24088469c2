"""Live moderation as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from modwarden import fixed_values as fv
from modwarden.functions import scores as sc
from modwarden.operators.lexicon import INLINE_LIMIT, compile_automata, compile_lexicon, match_by_automaton, match_by_join, match_inline
from modwarden.session import shared_dir
from modwarden.sources.sinks import VerdictStore
from modwarden.streaming.waits import keyed_state


FILES_PER_BATCH = 64
BROADCAST_ROWS = 10_000


def read_stream(spark: SparkSession, path: str, schema, max_files: int = FILES_PER_BATCH) -> DataFrame:
    """Parquet files as a stream. ``max_files`` bounds a micro-batch, and with it what any one key
    can bring into a step of keyed state."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_to_table(
    stream: DataFrame, purpose: str, mode: str = "append", per_batch: Callable[[DataFrame], DataFrame] | None = None, timers: bool = False
) -> DataFrame:
    """Runs a stream over all data that is there and returns what it wrote.

    ``per_batch`` is a batch job over each micro-batch, for steps that a stream cannot express; ``timers`` says that the
    stream holds keyed state with timers.

    Append results go through the exactly-once file sink. Update and complete results are written
    one folder per micro-batch, overwritten on a replay, with the batch number as a column; nothing
    passes through the driver.
    """
    spark = stream.sparkSession
    root = shared_dir(spark, purpose)
    out, state = f"{root}/out", f"{root}/state"
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    schema = stream.schema
    if mode == "append" and not per_batch:
        writer = writer.outputMode("append").format("parquet")
        with keyed_state(spark) if timers else nullcontext():
            query = writer.start(out)
    else:
        if per_batch:
            schema = per_batch(spark.createDataFrame([], stream.schema)).schema

        def save(batch: DataFrame, batch_id: int) -> None:
            (per_batch(batch) if per_batch else batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

        query = writer.outputMode(mode).foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.schema(schema if mode == "append" and not per_batch else StructType([*schema.fields, StructField("batch_id", LongType())])).parquet(out)


def stream_lexicon_verdicts(
    units: DataFrame, id_col: str, text: str, lexicon: DataFrame, columns: Sequence[str], purpose: str, limit: int = INLINE_LIMIT
) -> DataFrame:
    """Provisional verdict of each arriving unit, as a table of the given expressions.

    A small lexicon is a literal or a set of automata and the job one stateless pass; with a larger one every
    micro-batch is joined to it. All give the same rows.
    """
    compiled = compile_lexicon(lexicon, limit)
    if compiled:
        return run_to_table(match_inline(units, text, compiled).selectExpr(*columns), purpose)
    automata = compile_automata(lexicon)
    if automata:
        return run_to_table(match_by_automaton(units, text, automata).selectExpr(*columns), purpose)
    out = run_to_table(units, purpose, per_batch=lambda batch: match_by_join(batch, id_col, text, lexicon).selectExpr(*columns))
    return out.drop("batch_id")


def stream_dedupe(events: DataFrame, ts: str, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """A key with the same media is let through once while its watermark lasts; changed media passes."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_stats(verdicts: DataFrame, *by: str) -> DataFrame:
    """Live counts; run in complete mode."""
    return verdicts.groupBy(*by).count()


def stream_verdict_state(findings: DataFrame, key: str, order: str, image: str = "image_key") -> DataFrame:
    """Two-phase verdict per unit, source and image: the strongest finding so far, newest among equals.

    Merging is a maximum over (is block, order), so Spark's own incremental aggregation keeps the
    state: partial results are combined before the shuffle and a unit with very many findings costs
    one row per task. Run in update mode; each output row is an upgrade.
    """
    is_block = (F.col("action") == "block").cast("int")
    return (
        findings.filter(F.col("action").isin("flag", "block"))
        .groupBy(key, "source", F.coalesce(F.col(image), F.lit("")).alias(image))
        .agg(F.max(F.struct(is_block.alias("b"), F.col(order).alias("seen"), "action")).alias("m"))
        .select(key, "source", image, "m.seen", "m.action")
    )


def latest_verdicts(updates: DataFrame, key: str, image: str = "image_key", shown: DataFrame | None = None) -> DataFrame:
    """Current verdict per unit from the update log of :func:`stream_verdict_state`.

    With ``shown`` (key, image) media findings count only on images that their unit still shows.
    """
    newest = updates.groupBy(key, "source", image).agg(F.max_by(F.struct("action", "seen"), "batch_id").alias("r"))
    if shown is not None:
        media = F.col("source").isin(*fv.MEDIA_SOURCES)
        still = newest.filter(media).join(shown.select(key, image).distinct(), [key, image], "left_semi")
        newest = newest.filter(~media).unionByName(still)
    return newest.groupBy(key).agg(
        sc.rank_action(F.max(sc.action_rank(F.col("r.action")))).alias("action"),
        F.count("*").alias("reasons"),
        F.count_if(F.col("r.action") == "block").alias("block_reasons"),
    )


def stream_upsert(stream: DataFrame, path: str, order: Sequence[str], key: str = "key", every: str | None = None) -> DataFrame:
    """Coalesced keyed writes. The sink is idempotent: replaying a batch changes nothing.

    ``every`` sets a processing-time trigger for a live job; without it the job drains what is there.
    """
    spark = stream.sparkSession
    store = VerdictStore(spark, f"{path}/store", key, order)
    # The writer's name lives and dies with its checkpoint, so a job that starts afresh overwrites nothing.
    writer_id = store.writer(f"{path}/state")
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(
        lambda batch, batch_id: store.upsert(batch, f"{writer_id}-{batch_id}")
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    query = writer.start()
    if every:
        return query
    query.awaitTermination()
    return store.read()


def with_settings(events: DataFrame, settings: DataFrame, policy: str = "settings_policy") -> DataFrame:
    """Marks results made under other settings than the current row of the settings table.

    ``settings`` has one row per scope; a changed policy invalidates and asks for a rescan. A table
    counted to be small is broadcast, as a stream has few scopes and any of them can be hot; a
    larger one is left to Catalyst.
    """
    current = settings.select("scope", F.col(policy).alias("current_policy"))
    if current.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        current = F.broadcast(current)
    return events.join(current, "scope", "left").withColumn("rescan", ~F.col(policy).eqNullSafe(F.col("current_policy")))


def stored_verdicts(slots: DataFrame, store: DataFrame, key: str = "unit_key", action: str = "action") -> DataFrame:
    """Slot changes with the verdict to show: a key that is known takes its stored one, a new one waits as ``pending``."""
    known = store.select(F.col(key), F.col(action).alias("shown"))
    return slots.join(known, key, "left").withColumn("shown", F.coalesce("shown", F.lit("pending")))


def late_media_batch(texts: DataFrame, media: DataFrame, key: str, wait_ms: int) -> DataFrame:
    """Batch form of the bounded wait for one text per key: in time, late or never."""
    first = media.groupBy(key).agg(F.min("ts_ms").alias("media_ms"))
    gap: Column = F.col("media_ms") - F.col("ts_ms")
    return texts.join(first, key, "left").withColumn(
        "outcome",
        F.when(gap <= wait_ms, "published-with-media").when(gap > wait_ms, "late-upgrade").otherwise("published-without-media"),
    )
