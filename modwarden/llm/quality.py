"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a row of numeric features, computed over whole Arrow slices. Fitting takes a bounded sample
of labelled texts (``sample`` rows, by hash of the text), cuts each feature into quantile bins and boosts
shallow trees in cycles, one feature after the other, on the logistic loss. A tree over bins is a step function,
so its sum over all rounds is a lookup table per feature. Pairs of features that still explain residuals get
tables over a coarser grid in the same way. A score is the sum of table entries: bin numbers by binary search,
one addition per table.

Defined results: null and empty texts have the features of an empty text and get its score; rows without a label
are not learned from, labels of one id are combined by their maximum; with one class or none the score is its
share (0 without labels); equal texts get equal results; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from modwarden.llm import arrays as ar

SAMPLE = 12_000
BINS, PAIR_BINS = 48, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, PAIRS = 120, 60, 0.15, 3, 8
_SLICE = 1 << 20

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".", "comma": b",;:",
    "bang": b"!?", "bar": b"|", "symbol": b"#$%&*+<=>@^_~\\/", "quote": b"\"'()[]{}`-", "line": b"\n\r", "blank": b" \t",
}
FEATURES = (
    "log_bytes", "log_words", "word_length", *_CLASSES, "high", "distinct_words", "same_as_before", "top_word", "long_words", "words_per_line",
    "distinct_lines", "distinct_pairs", "capital_words", "symbol_ends",
)


def features(text: pa.Array) -> np.ndarray:
    """A row of :data:`FEATURES` per text."""
    data, offsets = ar.utf8(text)
    size = np.diff(offsets)
    starts, ends, first = ar.words(data, offsets)
    n = np.diff(first)
    per_byte, per_word = np.maximum(size, 1), np.maximum(n, 1)
    cols = {"log_bytes": np.log1p(size), "log_words": np.log1p(n), "word_length": ar.group_sums(ends - starts, first) / per_word}
    for name, members in _CLASSES.items():
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        cols[name] = ar.group_sums(table[data], offsets) / per_byte
    cols["high"] = ar.group_sums((data >= 128).astype(np.uint8), offsets) / per_byte
    hashed = ar.word_hashes(data, starts, ends, _ROLLING)
    row = np.repeat(np.arange(len(n)), n)
    cols["distinct_words"], cols["top_word"] = _distinct(row, hashed, n)
    inside = row[1:] == row[:-1]
    same = np.append(False, (hashed[1:] == hashed[:-1]) & inside)[: len(row)]
    cols["same_as_before"] = ar.group_sums(same.astype(np.uint8), first) / per_word
    pair = np.append(ar.mix(hashed[:-1] + hashed[1:] * np.uint64(3)), np.uint64(0))[: len(row)]
    cols["distinct_pairs"], _ = _distinct(row, np.where(np.append(inside, False)[: len(row)], pair, hashed), n)
    cols["long_words"] = ar.group_sums((ends - starts > 20).astype(np.uint8), first) / per_word
    upper, symbol = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    upper[list(_CLASSES["upper"])] = 1
    symbol[list(_CLASSES["symbol"] + _CLASSES["bang"])] = 1
    tail = np.minimum(starts + 1, ends - 1)
    cols["capital_words"] = ar.group_sums(upper[data[starts]] & upper[data[tail]], first) / per_word
    cols["symbol_ends"] = ar.group_sums(symbol[data[ends - 1]], first) / per_word
    # Lines: spans between line breaks that hold a byte.
    broken = data == 10
    line_id = np.cumsum(broken) + np.repeat(np.arange(len(size)), size)
    line = line_id[starts]
    head = np.flatnonzero(np.append(True, line[1:] != line[:-1])[: len(line)])
    line_row = row[head]
    lines = np.bincount(line_row, minlength=len(n))
    line_hash = np.add.reduceat(ar.mix(hashed + (np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))).astype(np.uint64)), head) if len(head) else np.zeros(0, np.uint64)
    cols["distinct_lines"], _ = _distinct(line_row, line_hash, lines)
    cols["words_per_line"] = np.log1p(n / np.maximum(lines, 1))
    return np.stack([cols[f] for f in FEATURES], 1).astype(np.float64)


_ROLLING = ar.Rolling()


def _distinct(row: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the share of distinct keys, and the share of the most frequent one."""
    out, top = np.ones(len(n)), np.zeros(len(n))
    if not len(row):
        return out, top
    # The row number leads, 40 bits of the hash follow.
    code = np.sort((row.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
    head = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    count = np.diff(np.append(head, len(code)))
    of = (code[head] >> np.uint64(40)).astype(np.int64)
    some = n > 0
    out[some] = np.bincount(of, minlength=len(n))[some] / n[some]
    np.maximum.at(top, of, count)
    top[some] /= n[some]
    return out, top


@dataclass
class Model:
    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edge, x[:, j], "right")]
        for a, b, ea, eb, table in self.pairs:
            total += table[np.searchsorted(ea, x[:, a], "right"), np.searchsorted(eb, x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A step function over bins with at most ``leaves`` steps, from gradient and curvature sums per bin."""
    cuts = [0, len(g)]
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    while len(cuts) - 1 < leaves:
        best, at = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = np.arange(a + 1, b)
            if not len(k):
                continue
            left, right = _gain(cg[k] - cg[a], ch[k] - ch[a]), _gain(cg[b] - cg[k], ch[b] - ch[k])
            gain = left + right - _gain(cg[b] - cg[a], ch[b] - ch[a])
            if gain.max() > best:
                best, at = gain.max(), int(k[gain.argmax()])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Four leaves over a grid: the best cut of the rows, then the best cut of the columns in each part."""
    best, cut = -1.0, 1
    for k in range(1, len(g)):
        gain = sum(_gain(p.sum(), q.sum()) for p, q in ((g[:k], h[:k]), (g[k:], h[k:])))
        if gain > best:
            best, cut = gain, k
    return np.concatenate([np.tile(_tree(g[a:b].sum(0), h[a:b].sum(0), 2), (b - a, 1)) for a, b in ((0, cut), (cut, len(g))) if b > a])


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on the logistic loss: single features first, then the pairs that explain most of what is left."""
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), start)

    def slope():
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slope()
            step = RATE * _tree(*(np.bincount(b, weights=v, minlength=len(tables[j])) for v in (g, h)), LEAVES)
            tables[j] += step
            total += step[b]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]

    def grid(a, b, v):
        n = len(coarse[b]) + 1
        return np.bincount(cells[a] * n + cells[b], weights=v, minlength=(len(coarse[a]) + 1) * n).reshape(-1, n)

    g, h = slope()
    ranked = sorted(((-float(_gain(grid(a, b, g), grid(a, b, h)).sum()), a, b) for a in range(len(cells)) for b in range(a + 1, len(cells)) if len(coarse[a]) and len(coarse[b])))
    chosen = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in chosen:
            g, h = slope()
            step = RATE * _grid_tree(grid(a, b, g), grid(a, b, h))
            table += step
            total += step[cells[a], cells[b]]
    return Model(start, edges, tables, [(a, b, coarse[a], coarse[b], t) for a, b, t in chosen])


def with_features(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns and an array of features."""
    out = StructType([*docs.select(*keep).schema.fields, *_parse_datatype_string("_f array<double>")])
    schema = to_arrow_schema(out)

    def run(batches):
        for batch in ar.slices(batches, "_qt", _SLICE):
            x = features(batch.column("_qt"))
            arr = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(schema.field("_f").type)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(schema.field(c).type) for c in keep), arr], schema=schema)

    return docs.select(*keep, F.col(text_col).cast("string").alias("_qt")).mapInArrow(run, out)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | float:
    """A model of a bounded sample of labelled texts, or the share of ones where there is one class at most."""
    picks = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
        .agg((F.max(label_col) > 0).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    # At most ``sample`` short rows, so they are sent to every task and the texts stay where they are.
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picks), "_id")
    rows = with_features(joined, "_text", ["_id", "_y"]).toArrow()
    if not rows.num_rows:
        return 0.0
    order = np.argsort(rows.column("_id").to_numpy(), kind="stable")[:sample]
    y = rows.column("_y").to_numpy().astype(float)[order]
    if y.min() == y.max():
        return float(y[0])
    x = rows.column("_f").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))[order]
    return boost(x, y)


def predict(docs: DataFrame, model: Model | float, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows with ``score`` and ``predicted``; columns of the input that bear one of these names are replaced."""
    added = _parse_datatype_string("score double, predicted int")
    kept = docs.drop(*added.names)
    out = StructType([*kept.schema.fields, *added])
    schema = to_arrow_schema(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in ar.slices(batches, "_qc_text", _SLICE):
            x = features(batch.column("_qc_text"))
            score = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            cols = {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return kept.withColumn("_qc_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, out)
