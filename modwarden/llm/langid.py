"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased, every run of other characters is one boundary. Spark counts the n-grams of every
training text; the driver keeps the ``max_grams`` most frequent of each language (which bounds the model) and
turns them into Kneser-Ney probabilities. A model is one array of sorted n-gram hashes per order, with a row of
log probabilities per hash (a column per language), and one of sorted context hashes with back-off weights.
The language of the lowest cross-entropy per symbol wins. A logistic curve on the margin to the second best,
fitted on texts that were not counted, turns it into a probability; below a threshold a text can be rejected.

Defined results: a text that is null or has no letter is ``und`` with score 0; equal texts get equal results;
rows without a language are not learned from; with no training text at all every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modwarden.llm import arrays as ar

ORDER = 4
MAX_GRAMS = 150_000
CALIBRATION_ROWS = 4_000
FRAGMENTS = (6, 12, 24)
UNKNOWN = "und"
SLICE = 2 << 20
_CUT = 1_500_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    # No code point above this one is a letter.
    low = np.array([chr(c).isalpha() for c in range(0x40000)])
    return np.append(low, np.zeros(0x110000 - len(low), bool))


def symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each after ``order - 1`` boundaries, with the first place and the letters of each text.

    Boundaries are zero; the last entry of the places is the total.
    """
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low))
    letter = _letters()[points]
    row = np.repeat(np.arange(len(low)), size)
    # A boundary stays only after a letter of the same text.
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])
    count = np.bincount(row[keep], minlength=len(low))
    n_letters = np.bincount(row[letter], minlength=len(low))
    pad = order - 1
    first = np.append(0, np.cumsum(count + pad))
    out = np.zeros(first[-1], np.uint32)
    _, place = ar.spread(count)
    out[np.repeat(first[:-1] + pad, count) + place] = np.where(letter, points, 0)[keep]
    return out, first, n_letters


def gram_sums(sym: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order from 1: the polynomial sum of the n-gram that ends at each place (wrong for the first ones)."""
    wide = sym.astype(np.uint64) + np.uint64(1)
    total, out = np.zeros(len(sym), np.uint64), []
    for k in range(order):
        part = np.zeros(len(sym), np.uint64)
        part[k:] = wide[: len(sym) - k] if k else wide
        total = total + part * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
        out.append(total)
    return out


def gram_hash(sums: np.ndarray, order: int) -> np.ndarray:
    return ar.mix(sums + np.uint64(order - 1))


def _counts(order: int):
    """Per task and language: each n-gram with its count; flushed when many are held."""

    def run(batches):
        held: dict[str, list] = {}

        def merge(parts):
            code, gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, at, inverse = np.unique(code, return_index=True, return_inverse=True)
            return keys, gram[at], np.bincount(inverse, weights=n, minlength=len(keys)).astype(np.int64)

        def emit():
            for lang, parts in held.items():
                _, gram, n = merge(parts)
                for a in range(0, len(n), 100_000):
                    g = gram[a : a + 100_000]
                    text = np.ascontiguousarray(g).tobytes().decode("utf-32-le", "surrogatepass")
                    names = pa.array([text[i : i + order] for i in range(0, len(text), order)], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), names, pa.array(n[a : a + 100_000])], ["lang", "gram", "n"])
            held.clear()

        for batch in ar.slices(batches, "text", SLICE):
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                sym, first, _ = symbols([t for t, x in zip(texts, langs, strict=True) if x == lang], order)
                row, place = ar.spread(np.diff(first) - (order - 1))
                ends = first[row] + order - 1 + place
                keys, at, n = np.unique(gram_hash(gram_sums(sym, order)[-1][ends], order), return_index=True, return_counts=True)
                gram = sym[ends[at][:, None] - np.arange(order - 1, -1, -1)]
                held.setdefault(lang, []).append((keys, gram, n))
                if len(held[lang]) > 12:
                    held[lang] = [merge(held[lang])]
            if sum(len(p[0]) for ps in held.values() for p in ps) > _CUT:
                yield from emit()
        yield from emit()

    return run


@dataclass
class Model:
    """Sorted hashes with a row of values per hash; ``log_prob[k]`` and ``back_off[k]`` belong to order ``k + 1``."""

    langs: list[str]
    order: int
    log_prob: list[tuple[np.ndarray, np.ndarray]]
    back_off: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    curve: tuple[float, float, float] = (0.0, 1.0, 0.0)


def _gram_array(grams: list[str], order: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, order)


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """The hash of each row as an n-gram; equal to :func:`gram_hash` of its length."""
    k = rows.shape[1]
    return gram_hash(gram_sums(rows.reshape(-1), k)[-1].reshape(-1, k)[:, -1], k) if k else np.zeros(len(rows), np.uint64)


def build(langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    """Kneser-Ney models from one table of top-order n-grams (rows of code points) and counts per language."""
    n_langs = len(langs)
    log_prob, back_off = [], []
    vocabulary = len(np.unique(np.concatenate([g.reshape(-1) for g, _ in tables]))) + 1
    # Grams and counts of each order: the top order counts texts, lower ones count distinct left neighbours.
    levels = [[None] * n_langs for _ in range(order)]
    for j, (gram, n) in enumerate(tables):
        for k in range(order, 0, -1):
            levels[k - 1][j] = (gram, n)
            gram, n = np.unique(gram[:, 1:], axis=0, return_counts=True) if k > 1 else (gram, n)
    floor = np.full(n_langs, 1.0 / vocabulary)
    lower_keys, lower_p = None, None
    for k in range(1, order + 1):
        rows = np.unique(np.concatenate([levels[k - 1][j][0] for j in range(n_langs)]), axis=0)
        contexts = np.unique(np.concatenate([levels[k - 1][j][0][:, :-1] for j in range(n_langs)]), axis=0) if k > 1 else np.zeros((1, 0), np.uint32)
        keys, context_keys = _hash_rows(rows), _hash_rows(contexts)
        order_of, context_order = np.argsort(keys), np.argsort(context_keys)
        keys, rows, context_keys = keys[order_of], rows[order_of], context_keys[context_order]
        context_of = np.searchsorted(context_keys, _hash_rows(rows[:, :-1])) if k > 1 else np.zeros(len(rows), int)
        if k == 1:
            below = np.broadcast_to(floor, (len(rows), n_langs))
        else:
            # Every suffix of a gram is a gram of the order below, in the same language's table.
            below = lower_p[np.searchsorted(lower_keys, _hash_rows(rows[:, 1:]))]
        p, gammas = np.zeros((len(rows), n_langs)), np.ones((len(context_keys), n_langs))
        for j in range(n_langs):
            gram, n = levels[k - 1][j]
            at = np.searchsorted(keys, _hash_rows(gram))
            c = context_of[at]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total = np.bincount(c, weights=n, minlength=len(context_keys))
            kinds = np.bincount(c, minlength=len(context_keys))
            seen = total > 0
            gammas[seen, j] = discount * kinds[seen] / total[seen]
            own = np.zeros(len(rows))
            own[at] = np.maximum(n - discount, 0) / total[c]
            p[:, j] = own + gammas[context_of, j] * below[:, j]
        log_prob.append((keys, np.log(p).astype(np.float32)))
        back_off.append((context_keys, np.log(gammas).astype(np.float32)))
        lower_keys, lower_p = keys, p
    return Model(langs, order, log_prob, back_off, np.log(floor).astype(np.float32))


class Finder:
    """Places of hashes in a sorted hash array, by their leading bits and a short walk."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.bits = max(1, min(22, int(len(keys)).bit_length()))
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.searchsorted(keys, edges).astype(np.int32)

    def __call__(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[(want >> np.uint64(64 - self.bits)).astype(np.int64)]
        got = self.keys[at]
        open_ = np.flatnonzero(got < want)
        while len(open_):
            at[open_] += 1
            got[open_] = self.keys[at[open_]]
            open_ = open_[(got[open_] < want[open_]) & (at[open_] < len(self.keys) - 1)]
        return at, (got == want) & (at < len(self.keys) - 1)


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.grams = [Finder(k) for k, _ in model.log_prob]
        self.contexts = [Finder(k) for k, _ in model.back_off]
        # A row more, for hashes behind the last one.
        self.top = np.concatenate([model.log_prob[-1][1], np.zeros((1, len(model.langs)), np.float32)])

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol in every language, the symbols and the letters of each text."""
        m = self.m
        sym, first, letters = symbols(texts, m.order)
        sums_of = gram_sums(sym, m.order)
        row, place = ar.spread(np.diff(first) - (m.order - 1))
        ends = first[row] + m.order - 1 + place
        # Most n-grams are found in the top order; only the rest goes down.
        at, hit = self.grams[-1](gram_hash(sums_of[-1][ends], m.order))
        total = self.top[at]
        left = np.flatnonzero(~hit)
        total[left] = 0
        for k in range(m.order, 0, -1):
            if k < m.order:
                at, hit = self.grams[k - 1](gram_hash(sums_of[k - 1][ends[left]], k))
                total[left[hit]] += m.log_prob[k - 1][1][at[hit]]
                left = left[~hit]
            if not len(left):
                break
            if k > 1:
                at, hit = self.contexts[k - 1](gram_hash(sums_of[k - 2][ends[left] - 1], k - 1))
                total[left[hit]] += m.back_off[k - 1][1][at[hit]]
            else:
                # An unseen symbol: the weight of the empty context and the uniform share.
                total[left] += m.back_off[0][1][0] + m.floor
        n = np.diff(first) - (m.order - 1)
        sums = ar.group_sums(total.astype(np.float64), np.append(0, np.cumsum(n)))
        return -sums / np.maximum(n, 1)[:, None], n, letters


def _shape(entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language and the logarithm of its lead in nats over the whole text."""
    best = entropy.argmin(1)
    ranked = np.sort(entropy, axis=1)
    lead = (ranked[:, 1] - ranked[:, 0]) * n if entropy.shape[1] > 1 else np.full(len(n), 1e3)
    return best, np.log1p(np.maximum(lead, 0))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Intercept and slope of P(y) on x, by Newton steps with a weak prior (the third number is the mean of x)."""
    mean = float(x.mean())
    d = np.stack([np.ones(len(x)), x - mean], 1)
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-d @ w))
        h = d.T @ (d * (p * (1 - p))[:, None]) + np.eye(2) * 0.1
        w = w + np.linalg.solve(h, d.T @ (y - p) - 0.1 * w)
    return float(w[0]), float(w[1]), mean


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, max_grams: int = MAX_GRAMS, calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """A model of all training texts but a twentieth, by hash of the text, of which at most ``calibration_rows`` calibrate."""
    rows = train.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "text"), F.lit(20))
    counted = rows.filter(part != 0).mapInArrow(_counts(order), "lang string, gram string, n bigint")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The most frequent of each language: cut within slices of the grams first, so no task ranks a whole language.
    slice_ = F.pmod(F.xxhash64("gram"), F.lit(64)).alias("_s")
    near = totals.select("*", slice_).withColumn("_r", F.row_number().over(_by("lang", "_s"))).filter(F.col("_r") <= max_grams)
    top = near.withColumn("_r", F.row_number().over(_by("lang"))).filter(F.col("_r") <= max_grams).select("lang", "gram", "n").toArrow()
    if not top.num_rows:
        return None
    langs = sorted(set(top.column("lang").to_pylist()))
    tables = []
    for lang in langs:
        own = top.filter(pc.equal(top.column("lang"), lang))
        gram = _gram_array(own.column("gram").to_pylist(), order)
        by = np.lexsort(gram.T[::-1])
        tables.append((gram[by], own.column("n").to_numpy()[by]))
    model = build(langs, tables, order)
    held = rows.filter(part == 0).orderBy(F.xxhash64("text"), "lang").limit(calibration_rows)
    # Short pieces of these texts stand for texts that are hard to tell; whole ones hardly ever are.
    middle = (F.length("text") / 2).cast("int")
    held = held.select("lang", F.explode(F.array("text", *(F.substr("text", middle, F.lit(n)) for n in FRAGMENTS))).alias("text"))
    scored = predict(held.withColumnRenamed("lang", "truth"), model, "text").filter(F.col("lang_pred") != UNKNOWN).select("truth", "lang_pred", "lead").toArrow()
    if scored.num_rows:
        right = pc.equal(scored.column("truth"), scored.column("lang_pred")).to_numpy(zero_copy_only=False).astype(float)
        model.curve = _logistic(scored.column("lead").to_numpy(), right)
    return model


def _by(*cols):
    from pyspark.sql import Window

    return Window.partitionBy(*cols).orderBy(F.desc("n"), "gram")


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", reject_below: float = 0.0) -> DataFrame:
    """The rows with ``lang_pred``, ``score`` (0 to 1), ``entropy`` per symbol, ``lead`` and ``rejected``.

    A text whose score is below ``reject_below`` is predicted ``und`` and marked. The text column is dropped from
    what Python returns only by name; other columns pass through.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string("lang_pred string, score double, entropy double, lead double, rejected boolean")
    kept = docs.drop(*added.names)
    out = StructType([*(f for f in kept.schema if f.name != text_col), *added])
    schema = to_arrow_schema(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        scorer = Scorer(model) if model else None
        for batch in ar.slices(batches, "_li_text", SLICE):
            texts = pc.fill_null(batch.column("_li_text"), "").to_pylist()
            if model:
                entropy, n, letters = scorer.entropies(texts)
                best, lead = _shape(entropy, n)
                a, b, mean = model.curve
                score = np.where(letters > 0, 1 / (1 + np.exp(-(a + b * (lead - mean)))), 0.0)
                least = entropy[np.arange(len(best)), best]
            else:
                best = letters = np.zeros(len(texts), int)
                score = least = lead = np.zeros(len(texts))
            no = letters == 0
            rejected = (score < reject_below) & ~no
            names = [UNKNOWN if x else model.langs[i] for x, i in zip((no | rejected).tolist(), best.tolist(), strict=True)]
            cols = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "entropy": pa.array(least), "lead": pa.array(lead), "rejected": pa.array(rejected)}
            yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return kept.withColumn("_li_text", F.col(text_col).cast("string")).drop(text_col).mapInArrow(run, out)
