"""A linear text classifier trained in epochs, with early stopping and a table of runs.

Texts are hashed once into weighted features. In an epoch every task takes gradient steps over its rows from the weights
of the epoch before, and the changes are averaged by rows: one job an epoch, and no more leaves the tasks than one number
a feature. After each epoch the validation rows are judged; the best epoch by F1 is kept, and training ends when it has
not been beaten for ``patience`` epochs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modwarden.functions.automaton import cuts, text_bytes, utf8
from modwarden.functions.hashed import murmur3
from modwarden.operators.learning import FoldedModel
from modwarden.session import scratch

FEATURES = 1 << 16
# Features of rows that a step holds together.
AT_ONCE = 1 << 18
RUN_SCHEMA = "epoch int, loss double, tp bigint, fp bigint, tn bigint, fn bigint, precision double, recall double, f1 double, best boolean"


@dataclass(frozen=True)
class EpochPolicy:
    """How training goes on: at most ``epochs``, ended by ``patience`` epochs without a better F1."""

    epochs: int = 8
    patience: int = 1
    rate: float = 2.0
    decay: float = 1e-6
    batch: int = 32
    features: int = FEATURES
    cutoff: float = 0.5


def words_of(text: Column | str) -> Column:
    """A text as its words in lower case, single spaces between them."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"[^\p{L}]+", " ")


def _hashed(features: int):
    """Label, and the distinct features of each text with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, end - at) for b in batches for at, end in cuts(text_bytes(b.column("t")))):
            data, offsets = utf8(batch.column("t"))
            word = data != 32
            before, after = np.append(True, ~word[:-1])[: len(word)], np.append(~word[1:], True)[: len(word)]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            before[inner], after[inner - 1] = True, True
            starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
            feature = murmur3(data, starts, ends) % features
            row = np.searchsorted(offsets, starts, side="right") - 1
            both, n = np.unique(row * features + feature, return_counts=True)
            bounds = np.searchsorted(both, np.arange(batch.num_rows + 1) * features).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in ((both % features).astype(np.int32), n.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *lists], ["label", "ix", "n"])

    return run


def hashed_texts(df: DataFrame, text: str, label: str, features: int = FEATURES) -> DataFrame:
    """``(label, ix, n)``; a null label counts as 0."""
    picked = df.select(F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("label"), words_of(text).alias("t"))
    return picked.mapInArrow(_hashed(features), "label int, ix array<int>, n array<float>")


def inverse_frequencies(hashed: DataFrame, features: int = FEATURES) -> np.ndarray:
    """``log((rows + 1) / (rows with it + 1))`` per feature; one row a feature at most reaches the driver."""
    rows = hashed.count()
    found = hashed.select(F.explode("ix").alias("ix")).groupBy("ix").agg(F.count("*").alias("n")).toArrow()
    df = np.zeros(features)
    df[found.column("ix").to_numpy()] = found.column("n").to_numpy()
    return np.log((rows + 1) / (df + 1))


def _parts(batch: pa.RecordBatch, together: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, so many features at a time at most; ``together`` rows in a row from its start stay in one part."""
    offsets = batch.column("ix").offsets.to_numpy()
    first = np.append(np.arange(0, batch.num_rows, together), batch.num_rows)
    for a, b in cuts(np.diff(offsets[first]), AT_ONCE):
        yield batch.slice(first[a], first[b] - first[a])


def _rows(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and of each feature met its row, number and weight; a text's weights have length one."""
    ix, n = batch.column("ix"), batch.column("n").flatten().to_numpy().astype(np.float64)
    row = np.repeat(np.arange(batch.num_rows), np.diff(ix.offsets.to_numpy()))
    ix = ix.flatten().to_numpy()
    x = n * idf[ix]
    length = np.sqrt(np.bincount(row, x * x, batch.num_rows))
    return batch.column("label").to_numpy(), row, ix, x / np.maximum(length, 1e-12)[row]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _epoch(hashed: DataFrame, weights: np.ndarray, intercept: float, idf: np.ndarray, policy: EpochPolicy) -> tuple[np.ndarray, float]:
    """The weights after one pass; they start where they were, in every task."""
    shared = hashed.sparkSession.sparkContext.broadcast((weights, intercept, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, b0, idf = shared.value
        w, b, rows = before.copy(), b0, 0
        for batch in batches:
            rows += batch.num_rows
            for y, row, ix, x in (_rows(p, idf) for p in _parts(batch, policy.batch)):
                cut = np.searchsorted(row, np.arange(0, len(y) + policy.batch, policy.batch))
                for k in range(-(-len(y) // policy.batch)):
                    at, end = k * policy.batch, min(len(y), (k + 1) * policy.batch)
                    r, i, v = row[cut[k] : cut[k + 1]] - at, ix[cut[k] : cut[k + 1]], x[cut[k] : cut[k + 1]]
                    off = _sigmoid(np.bincount(r, w[i] * v, end - at) + b) - y[at:end]
                    step = policy.rate / (end - at)
                    np.subtract.at(w, i, step * off[r] * v)
                    b -= step * off.sum()
            w *= 1 - policy.decay * batch.num_rows
        changed = np.flatnonzero(w != before)
        # Two numbers beside the features: the intercept's change, and the rows.
        out = np.append(changed, [len(w), len(w) + 1])
        yield pa.RecordBatch.from_arrays([pa.array(out.astype(np.int32)), pa.array(np.append((w - before)[changed] * rows, [(b - b0) * rows, rows]))], ["ix", "change"])

    found = hashed.mapInArrow(run, "ix int, change double").groupBy("ix").agg(F.sum("change").alias("change")).toArrow()
    change = np.zeros(len(weights) + 2)
    change[found.column("ix").to_numpy()] = found.column("change").to_numpy()
    rows = max(1.0, change[-1])
    shared.destroy()
    return weights + change[:-2] / rows, intercept + change[-2] / rows


def _judged(hashed: DataFrame, weights: np.ndarray, intercept: float, idf: np.ndarray, cutoff: float) -> dict:
    """Log loss and counts over all rows."""
    shared = hashed.sparkSession.sparkContext.broadcast((weights, intercept, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, idf = shared.value
        for y, row, ix, x in (_rows(p, idf) for batch in batches for p in _parts(batch)):
            p = _sigmoid(np.bincount(row, w[ix] * x, len(y)) + b)
            loss = -np.where(y == 1, np.log(p), np.log(1 - p)).sum()
            hit = p >= cutoff
            counts = [(hit & (y == 1)).sum(), (hit & (y != 1)).sum(), (~hit & (y != 1)).sum(), (~hit & (y == 1)).sum()]
            yield pa.RecordBatch.from_arrays([pa.array([float(loss)]), *(pa.array([int(c)]) for c in counts)], ["loss", "tp", "fp", "tn", "fn"])

    sums = hashed.mapInArrow(run, "loss double, tp bigint, fp bigint, tn bigint, fn bigint").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("loss", "tp", "fp", "tn", "fn")))
    r = sums.first().asDict()
    shared.destroy()
    n = r["tp"] + r["fp"] + r["tn"] + r["fn"]
    over = lambda a, b: a / b if b else 0.0
    r["loss"] = over(r["loss"], n)
    r["precision"], r["recall"] = over(r["tp"], r["tp"] + r["fp"]), over(r["tp"], r["tp"] + r["fn"])
    r["f1"] = over(2 * r["tp"], 2 * r["tp"] + r["fp"] + r["fn"])
    return r


@dataclass(frozen=True)
class EpochModel:
    """Weights of the best epoch; :meth:`scores` judges texts as training did."""

    weights: np.ndarray
    intercept: float
    idf: np.ndarray

    def folded(self) -> FoldedModel:
        """For scorers that do not normalise the length of a text's vector."""
        return FoldedModel(self.weights * self.idf, self.intercept)

    def scores(self, df: DataFrame, text: str, label: str) -> DataFrame:
        """``(label, score)`` of each row."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for y, row, ix, x in (_rows(p, m.idf) for batch in batches for p in _parts(batch)):
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(_sigmoid(np.bincount(row, m.weights[ix] * x, len(y)) + m.intercept))], ["label", "score"])

        return hashed_texts(df, text, label, len(self.weights)).mapInArrow(run, "label int, score double")


def train_epochs(train: DataFrame, val: DataFrame, text: str = "text", label: str = "label", policy: EpochPolicy = EpochPolicy()) -> tuple[EpochModel, DataFrame]:
    """The best model, and a row per epoch that was run: loss, counts, precision, recall, F1, whether it is the best.

    An empty validation set has an F1 of 0 throughout, so the first epoch is kept.
    """
    spark = train.sparkSession
    with scratch(spark) as held:
        rows, judged = (held(hashed_texts(x, text, label, policy.features), "hashed") for x in (train, val))
        idf = inverse_frequencies(rows, policy.features)
        weights, intercept, log, best, since = np.zeros(policy.features), 0.0, [], None, 0
        for epoch in range(1, policy.epochs + 1):
            weights, intercept = _epoch(rows, weights, intercept, idf, policy)
            found = _judged(judged, weights, intercept, idf, policy.cutoff) | {"epoch": epoch}
            log.append(found)
            if best is None or found["f1"] > best[0]["f1"]:
                best, since = (found, EpochModel(weights, intercept, idf)), 0
            else:
                since += 1
                if since >= policy.patience:
                    break
    names = [f.split()[0] for f in RUN_SCHEMA.split(", ")]
    runs = [tuple((r | {"best": r is best[0]})[c] for c in names) for r in log]
    return best[1], spark.createDataFrame(runs, RUN_SCHEMA)


def append_run(runs: DataFrame, path: str, name: str) -> None:
    """Adds the rows of a run to a table of runs. A run that is added again, by a job started anew, replaces itself."""
    runs.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={name}")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{RUN_SCHEMA}, run string").parquet(path)
