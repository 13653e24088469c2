"""Outputs: splits, keyed verdict tables, feedback logs, threshold reports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modwarden.operators.store import last_write_wins
from modwarden.session import scratch
from modwarden.sources.readers import feedback_columns


def write_splits(df: DataFrame, path: str, columns: Sequence[str], split: str = "split", fmt: str = "parquet") -> None:
    """One folder per split."""
    out = df.select(split, *columns).write.mode("overwrite").partitionBy(split)
    if fmt == "csv":
        out.option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    else:
        out.parquet(path)


class VerdictStore:
    """Keyed verdict table: an append-only log of writes, read as its newest row per key.

    A write costs what it brings and no more. Each batch is one folder, overwritten when the batch
    is replayed, so a lost executor or a restarted job leaves the same state. Batch names hold the
    name of their writer, and a plain number is refused, so two jobs never share one. :meth:`compact`
    folds what it has listed into a base of its own; batches that are written meanwhile stay in the
    log, and a compaction that breaks off counts for nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "key", order: Sequence[str] = ("ts", "seq")):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, list(order)

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _done(self) -> list[str]:
        """Names of the batches and bases that are written whole."""
        fs, pattern = self._fs(f"{self.path}/batch=*/_SUCCESS")
        return sorted(str(s.getPath().getParent().getName()).removeprefix("batch=") for s in fs.globStatus(pattern) or [])

    def writer(self, checkpoint: str) -> str:
        """The name that a stream with this checkpoint keeps for its batches: made once, stored beside it."""
        fs, folder = self._fs(f"{checkpoint}/writer")
        found = fs.listStatus(folder) if fs.exists(folder) else []
        if not found:
            name = uuid.uuid4().hex
            fs.create(self._fs(f"{checkpoint}/writer/{name}")[1]).close()
            return name
        return found[0].getPath().getName()

    def upsert(self, rows: DataFrame, batch: str | None = None) -> None:
        """Adds rows as one batch; a name given again replaces the rows it brought before."""
        if isinstance(batch, int) or (batch is not None and (batch.isdecimal() or batch.startswith("base"))):
            raise ValueError("name a batch by its writer and number, as two writers count alike")
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch or uuid.uuid4().hex}")

    def _live(self) -> list[str]:
        """Batches that count: those that no whole base has folded in, and the bases that no other base has."""
        done, folded = self._done(), set()
        for name in done:
            if name.startswith("base-"):
                # What a base holds is listed beside its rows.
                folded |= {r[0] for r in self.spark.read.text(f"{self.path}/_folded/{name}").collect()}
        return [n for n in done if n not in folded]

    def log(self) -> DataFrame:
        names = self._live()
        return self.spark.read.parquet(*(f"{self.path}/batch={n}" for n in names))

    def read(self) -> DataFrame:
        return last_write_wins(self.log(), self.key, self.order)

    def compact(self) -> None:
        """Folds the batches that are there into one. A batch replayed later keeps its place: the newest row of a key wins."""
        names, base = self._live(), f"base-{uuid.uuid4().hex}"
        rows = last_write_wins(self.spark.read.parquet(*(f"{self.path}/batch={n}" for n in names)), self.key, self.order)
        # The list first: a base counts once it is whole, and then its list is there.
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.text(f"{self.path}/_folded/{base}")
        rows.write.parquet(f"{self.path}/batch={base}")


def write_named(df: DataFrame, root: str, files: Mapping[str, tuple[Column, Column]]) -> str:
    """Small files with names of their own, one per row and entry: ``{file name: (folder, content)}``.

    Spark names the files it writes itself, so tasks write these through ``pyarrow.fs``, each under a temporary
    name first; a repeated task writes the same files again.
    """
    names = list(files)
    picked = df.select(*[c.alias(f"{part}{i}") for i, n in enumerate(names) for part, c in (("at", files[n][0]), ("body", files[n][1].cast("binary")))])

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        n = 0
        for batch in batches:
            for i, name in enumerate(names):
                for at, body in zip(batch.column(f"at{i}").to_pylist(), batch.column(f"body{i}").to_pylist(), strict=True):
                    folder, part = f"{base}/{at}", uuid.uuid4().hex
                    fs.create_dir(folder, recursive=True)
                    with fs.open_output_stream(f"{folder}/.{part}") as out:
                        out.write(body or b"")
                    fs.move(f"{folder}/.{part}", f"{folder}/{name}")
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    picked.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return root


def write_eval_set(df: DataFrame, path: str, order: str, text: str = "text", label: str = "label", per_record: int = 1000) -> None:
    """An evaluation set in the order of a unique column, in records of so many sentences, one JSON line each.

    Rows are dealt by ranges of the order; each record names the place of its first sentence, so no task holds them all.
    """
    with scratch(df.sparkSession) as held:
        dealt = df.select(F.col(order).alias("_o"), F.col(text).alias("text"), F.col(label).cast("int").alias("label")).repartitionByRange("_o")
        rows = held(dealt.withColumn("_part", F.spark_partition_id()), "eval-set")
        sizes = rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_o").alias("first"))
        # A row per partition, so one window over all of them is small.
        before = sizes.select("_part", (F.sum("n").over(Window.orderBy("first")) - F.col("n")).alias("before"))
        ix = F.col("before") + F.row_number().over(Window.partitionBy("_part").orderBy("_o")) - 1
        placed = rows.join(F.broadcast(before), "_part").withColumn("ix", ix)
        records = placed.groupBy((F.col("ix") - F.col("ix") % per_record).alias("offset")).agg(F.array_sort(F.collect_list(F.struct("ix", "text", "label"))).alias("s"))
        records.select("offset", F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["label"].alias("label"))).alias("sentences")).write.json(path)


def append_feedback(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_feedback_csv(df: DataFrame, path: str) -> None:
    """Fixed column order, every value quoted, quotes doubled, nothing for null."""
    df.select(*feedback_columns(df)).write.mode("overwrite").csv(
        path, header=True, quoteAll=True, quote='"', escape='"', emptyValue=""
    )


def export_feedback_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_threshold_report(report: DataFrame, path: str) -> None:
    """The one report row as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def stamp(df: DataFrame, version: str, ts) -> DataFrame:
    """Policy version and time on rows about to be stored."""
    return df.withColumn("policy_version", F.lit(version)).withColumn("ts", ts)
