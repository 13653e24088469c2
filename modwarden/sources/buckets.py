"""A verdict store in hash buckets, with a Bloom filter of the keys of each bucket of each batch.

The store is an external bucketed table: a key's rows lie in one bucket in every batch, so the newest row per key and a
join by key read the store as it lies, with no exchange on its side. A look-up first asks the filters which buckets can
hold one of its keys, and reads the files of those only.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modwarden.session import discard

BITS_A_KEY, PROBES = 12, 8
_FILTERS = "bucket int, batch string, n bigint, bits binary"


def _probes(h: np.ndarray, size: int) -> np.ndarray:
    """The places of each key's hash in a filter of ``size`` bits, a row per probe."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h & np.uint64(0xFFFFFFFF)) + np.arange(PROBES, dtype=np.uint64)[:, None] * step) % np.uint64(size)


def _filter_of(key: tuple, table: pa.Table) -> pa.Table:
    """The filter of one bucket of one batch, whose distinct keys' hashes come as a group."""
    h = table.column("h").to_numpy()
    bits = np.zeros(max(64, BITS_A_KEY * len(h)) // 8 * 8, bool)
    bits[_probes(h, len(bits)).ravel()] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "batch": [key[1].as_py()], "n": pa.array([len(h)], pa.int64()), "bits": pa.array([packed], pa.binary())})


def _wanted(key: tuple, asked: pa.Table, filters: pa.Table) -> pa.Table:
    """The bucket, if any of the keys that are asked for may be in one of its filters."""
    h = asked.column("h").to_numpy()
    for raw in filters.column("bits"):
        bits = np.unpackbits(np.frombuffer(raw.as_buffer(), np.uint8), bitorder="little").astype(bool)
        if len(h) and bits[_probes(h, len(bits))].all(axis=0).any():
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32())})
    return pa.table({"bucket": pa.array([], pa.int32())})


class BucketedStore:
    """Keyed verdicts: batches are added under names of their own, a batch given again replaces the rows it brought.

    ``schema`` is the table's, with ``key`` among its columns. A batch counts once its rows and filters are written. Writers
    that share the store name their batches apart. :meth:`compact` folds the batches that are there into one; those it
    folded are deleted after a time in which readers that had listed them may still finish.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key", order: Sequence[str] = ("ts", "seq"), buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, list(order), buckets
        self.table = f"store_{hashlib.md5(f'{self.path}|{schema}|{buckets}'.encode()).hexdigest()}"
        fs, at = self._fs(f"{self.path}/rows")
        fs.mkdirs(at)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({schema}, batch string) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{self.path}/rows'"
        )
        self.columns = [c for c in spark.table(self.table).columns if c != "batch"]

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _mark(self, kind: str, name: str, text: str = "") -> None:
        fs, at = self._fs(f"{self.path}/_{kind}/{name}")
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _marks(self, kind: str) -> dict[str, int]:
        """Names of marks and when they were made."""
        fs, at = self._fs(f"{self.path}/_{kind}")
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(at)} if fs.exists(at) else {}

    def _folded(self) -> dict[str, str]:
        """Batches that a whole base has folded in, with that base."""
        done, out = self._marks("done"), {}
        for base in self._marks("folded"):
            if base in done:
                for row in self.spark.read.text(f"{self.path}/_folded/{base}").collect():
                    out[row[0]] = base
        return out

    def live(self) -> list[str]:
        folded = self._folded()
        return sorted(n for n in self._marks("done") if n not in folded)

    def bucket(self, key: Column | str) -> Column:
        """The bucket of a key, as the table's files are numbered."""
        return F.pmod(F.hash(key), F.lit(self.buckets))

    def upsert(self, rows: DataFrame, batch: str | None = None) -> None:
        name = batch or uuid.uuid4().hex
        if not name.replace("-", "").isalnum() or name.isdecimal() or (batch and name.startswith("base")):
            raise ValueError("name a batch by its writer and number, in letters, digits and dashes")
        self._add(rows, name)

    def _add(self, rows: DataFrame, name: str, how: str = "OVERWRITE") -> None:
        # One file per bucket: rows are dealt as the table deals them.
        placed = rows.select(*self.columns).repartition(self.buckets, self.key)
        self.spark.sql(f"INSERT {how} TABLE {self.table} PARTITION (batch = '{name}') SELECT * FROM {{placed}}", placed=placed)
        keys = self.spark.table(self.table).filter(F.col("batch") == name).select(F.col(self.key).alias("k")).distinct()
        hashed = keys.select(self.bucket("k").alias("bucket"), F.lit(name).alias("batch"), F.xxhash64("k").alias("h"))
        hashed.groupBy("bucket", "batch").applyInArrow(_filter_of, _FILTERS).write.mode("overwrite").parquet(f"{self.path}/_filters/{name}")
        self._mark("done", name)

    def _rows(self, names: Sequence[str], buckets: Sequence[int] | None = None) -> DataFrame:
        self.spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")
        rows = self.spark.table(self.table).filter(F.col("batch").isin(list(names)))
        if buckets is not None:
            # Files carry their bucket in their names; this is decided before any of them is opened.
            rows = rows.filter(F.col("_metadata.file_name").rlike("_(" + "|".join(f"{b:05d}" for b in buckets) + r")(\.|$)") if buckets else F.lit(False))
        return rows.drop("batch")

    def newest(self, rows: DataFrame) -> DataFrame:
        """The newest row per key; the rows of a key are together already."""
        others = [c for c in self.columns if c != self.key]
        found = rows.groupBy(self.key).agg(F.max_by(F.struct(*others), F.struct(*self.order)).alias("_r"))
        return found.select(self.key, *[F.col("_r")[c].alias(c) for c in others]).select(*self.columns)

    def read(self) -> DataFrame:
        return self.newest(self._rows(self.live()))

    def _needed(self, requests: DataFrame, names: Sequence[str]) -> list[int]:
        """Buckets that may hold a requested key; as many at most as there are buckets."""
        asked = requests.select(F.col(self.key).alias("k")).distinct().select(self.bucket("k").alias("bucket"), F.xxhash64("k").alias("h"))
        if not names:
            return []
        filters = self.spark.read.schema(_FILTERS).parquet(*(f"{self.path}/_filters/{n}" for n in names))
        found = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_wanted, "bucket int")
        return sorted(r.bucket for r in found.collect())

    def lookup(self, requests: DataFrame, payload: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
        """``requests`` with the stored ``payload`` of their keys, null on a miss and where a column of ``same`` differs.

        The requests move to the buckets; the store does not move.
        """
        names = self.live()
        stored = self.newest(self._rows(names, self._needed(requests, names)))
        known = stored.select(self.key, *[F.col(c).alias(f"_s_{c}") for c in same], *[F.col(c).alias(f"_p_{c}") for c in payload])
        out = requests.join(known.hint("merge"), self.key, "left")
        match = F.lit(True)
        for c in same:
            match &= F.col(c) == F.col(f"_s_{c}")
        return out.select(*requests.columns, *[F.when(match, F.col(f"_p_{c}")).alias(c) for c in payload])

    def compact(self, grace_s: float = 24 * 3600) -> str:
        """Folds what is there into one base, and deletes what a base has folded in longer than ``grace_s`` ago."""
        names, base = self.live(), f"base-{uuid.uuid4().hex}"
        self._mark("folded", base, "\n".join(names))
        # A base has a name of its own, so there is nothing to replace; one that breaks off never counts.
        self._add(self.newest(self._rows(names)), base, "INTO")
        self.forget(grace_s)
        return base

    def forget(self, grace_s: float) -> None:
        done, folded = self._marks("done"), self._folded()
        for name, base in folded.items():
            if name in done and done[base] <= time.time() * 1000 - grace_s * 1000:
                # The mark goes last, so a broken deletion is taken up again.
                self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (batch='{name}')")
                discard(self.spark, f"{self.path}/rows/batch={name}")
                discard(self.spark, f"{self.path}/_filters/{name}")
                discard(self.spark, f"{self.path}/_done/{name}")

