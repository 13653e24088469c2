"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Fitting takes a bounded sample of labelled texts (``sample`` per label, by hash of the text), counts in Spark
which words and word beginnings tell the labels apart, and keeps ``max_terms`` of them. Their document
frequencies come from all documents. Sample texts with one vector make one example with a count per label.
The index holds, per term, postings in example order, and the largest weight of each block of examples; a
query opens blocks in order of their upper bound until none can hold a nearer example, so the neighbours are
exact. Votes weigh with similarity; an isotonic curve over leave-one-out votes, weighted to the label shares of
all labelled rows, makes them probabilities.

Defined results: null, empty and term-free texts have no neighbours and get the calibrated share of such texts;
ties in similarity go to the smaller example number, and equal texts get equal results; labels of one id are
combined by their maximum and null labels are left out; without labels every score is 0; other columns pass
through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from modwarden.llm import arrays as ar

SAMPLE = 3_000
MAX_TERMS = 3_000
NEIGHBOURS = 15
BLOCK = 64
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> set[str]:
    """Whole words (``=word``) and beginnings of longer words, in lower case."""
    words = set(_WORD.findall(text.lower()))
    out = {f"={w}" for w in words}
    for n in PREFIXES:
        out.update(w[:n] for w in words if len(w) > n)
    return out


class TermCounter:
    """How often each term of a fixed list occurs in a text, by one automaton over the text."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[tuple[int, bool]]] = {}
        for i, t in enumerate(terms):
            by.setdefault(t.lstrip("="), []).append((i, t[0] == "="))
        for t, what in by.items():
            self.automaton.add_word(t, (len(t), what))
        if by:
            self.automaton.make_automaton()
        self.empty = not by

    def __call__(self, text: str) -> Counter:
        found: Counter = Counter()
        if self.empty:
            return found
        low = text.lower()
        letter = lambda c: c.isalpha()
        for last, (n, what) in self.automaton.iter(low):
            if last >= n and letter(low[last - n]):
                continue
            more = last + 1 < len(low) and letter(low[last + 1])
            for i, whole in what:
                if whole != more:
                    found[i] += 1
        return found


@dataclass
class Index:
    """Examples as vectors, their postings by term and block, and the largest weight of each block."""

    terms: list[str]
    idf: np.ndarray
    label_counts: np.ndarray  # per example: clean and toxic sample texts with this vector
    ids: np.ndarray  # per example: the smallest id among them
    start: np.ndarray  # (term, block) -> first posting
    example: np.ndarray
    weight: np.ndarray
    block_max: np.ndarray
    rate: float = 0.0  # toxic share among all labelled rows
    curve: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))
    blank: float = 0.0

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        w = (1 + np.log(np.array([counts[t] for t in terms.tolist()], float))) * self.idf[terms] if len(terms) else np.zeros(0)
        return terms, w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the ``k`` nearest examples, nearest first, exactly."""
        bound = w @ self.block_max[terms]
        order = np.argsort(-bound, kind="stable")
        blocks = self.block_max.shape[1]
        best, best_sim = np.zeros(0, np.int64), np.zeros(0)
        at = 0
        while at < len(order):
            group = order[at : at + 8]
            # Past the k-th similarity no block can hold a nearer example; ties must still be looked at.
            if bound[group[0]] <= 0 or (len(best) == k and bound[group[0]] < best_sim[-1] - 1e-12):
                break
            cell = (terms[:, None] * blocks + group).reshape(-1)
            n = self.start[cell + 1] - self.start[cell]
            which, place = ar.spread(n)
            post = self.start[cell][which] + place
            hit, inverse = np.unique(self.example[post], return_inverse=True)
            sim = np.bincount(inverse, weights=np.repeat(w, len(group))[which] * self.weight[post], minlength=len(hit))
            best, best_sim = np.concatenate([best, hit]), np.concatenate([best_sim, sim])
            top = np.lexsort((best, -np.round(best_sim, 12)))[:k]
            best, best_sim = best[top], best_sim[top]
            at += 8
        return best, best_sim

    def vote(self, best: np.ndarray, sim: np.ndarray, without: tuple[int, int] | None = None) -> float:
        """Toxic share of the neighbours' texts, weighed by similarity; ``without`` takes one (example, label) out."""
        counts = self.label_counts[best].astype(float)
        if without is not None and len(at := np.flatnonzero(best == without[0])):
            counts[at[0], without[1]] -= 1
        # A near example outweighs a far one, and many equal texts count less than their number.
        share = counts[:, 1] / np.maximum(counts.sum(1), 1e-9)
        w = sim**4 * np.log1p(counts.sum(1))
        return float((w * share).sum() / w.sum()) if w.sum() > 0 else self.rate

    def score(self, raw: float) -> float:
        return float(np.interp(raw, *self.curve))


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing curve nearest to the points (pool adjacent violators), as knots of an interpolation."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([c * b, c, c * a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 2] / p[:, 1], p[:, 0] / p[:, 1]


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """Texts of at most ``sample`` ids of each label, and the labelled rows there are of each."""
    one = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    picks = None
    for label in (0, 1):
        some = one.filter(F.col("label") == label).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        picks = some if picks is None else picks.unionByName(some)
    # At most twice ``sample`` short rows, so they are sent to every task and the texts stay where they are.
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    joined = text.join(F.broadcast(picks), "_id")
    return joined.groupBy(F.xxhash64("text").alias("_h"), "label").agg(F.min_by("text", "_id").alias("text"), F.min("_id").alias("_id")).select("_id", "text", "label"), counts


def _sample_terms(batches):
    for batch in ar.slices(batches, "text"):
        by = (Counter(), Counter())
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            by[label].update(terms_of(text))
        names = list(by[0] | by[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in by)], ["term", "clean", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, max_terms: int = MAX_TERMS, all_docs: DataFrame | None = None) -> Index | None:
    """An index of a bounded sample of the labelled ``docs``; ``all_docs`` (or ``docs``) give document frequencies."""
    texts, counts = _sampled(docs, labels, sample, id_col, text_col, label_col)
    if not counts.get(1) or not counts.get(0):
        return None
    texts = texts.persist()
    try:
        size = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
        if len(size) < 2:
            return None
        # Log-odds of a term, shrunk by its standard error: sure differences rank first.
        t, c = (F.col("toxic") + 0.5) / (size[1] + 1), (F.col("clean") + 0.5) / (size[0] + 1)
        odds = F.log(t / c)
        sure = odds - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        least = max(3, size[1] // 300)
        chosen = (
            texts.mapInArrow(_sample_terms, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
            .filter((F.col("toxic") >= least) & (sure > 0.5)).orderBy(F.desc(sure), "term").limit(max_terms).select("term").collect()
        )
        terms = sorted(r["term"] for r in chosen)
        rows = texts.mapInArrow(_vectors(terms), "_id bigint, label int, terms array<int>, counts array<int>").toArrow().to_pylist()
    finally:
        texts.unpersist()
    n, df = _frequencies(all_docs if all_docs is not None else docs, text_col, terms)
    return _index(terms, np.log((n + 1) / (df + 1)) + 1, rows, counts[1] / (counts[0] + counts[1]))


def _vectors(terms: list[str]):
    """Only texts with a term need their vector; the others come as empty lists."""

    def run(batches):
        count = TermCounter(terms)
        for batch in ar.slices(batches, "text"):
            found = [count(t) for t in batch.column("text").to_pylist()]
            ts = [sorted(c) for c in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(ts, pa.list_(pa.int32())), pa.array([[c[t] for t in x] for c, x in zip(found, ts, strict=True)], pa.list_(pa.int32()))],
                ["_id", "label", "terms", "counts"],
            )

    return run


def _frequencies(docs: DataFrame, text_col: str, terms: list[str]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term, over all documents: a partial sum per task."""

    def run(batches):
        count, n, total = TermCounter(terms), 0, Counter()
        for batch in ar.slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            n += len(texts)
            for t in texts:
                total.update(count(t).keys())
        yield pa.RecordBatch.from_arrays([pa.array([-1, *total], pa.int32()), pa.array([n, *total.values()], pa.int64())], ["term", "n"])

    df = np.zeros(len(terms) + 1)
    for r in docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    return int(df[-1]), df[:-1]


def _index(terms: list[str], idf: np.ndarray, rows: list[dict], rate: float) -> Index:
    index = Index(terms, idf, *(np.zeros(0) for _ in range(6)), rate=rate)
    groups: dict[tuple, list] = {}
    blank = [0, 0]
    rows = sorted(rows, key=lambda r: r["_id"])
    for r in rows:
        if r["terms"]:
            groups.setdefault((tuple(r["terms"]), tuple(r["counts"])), []).append(r)
        else:
            blank[r["label"]] += 1
    # Examples that share their rarest term are neighbours, so that blocks differ and bounds are sharp.
    keys = sorted(groups, key=lambda k: (-max(idf[t] for t in k[0]), k))
    index.ids = np.array([groups[k][0]["_id"] for k in keys], np.int64)
    index.label_counts = np.array([[sum(r["label"] == y for r in groups[k]) for y in (0, 1)] for k in keys], np.int64).reshape(-1, 2)
    vectors = [index.vector(Counter(dict(zip(*k, strict=True)))) for k in keys]
    blocks = max(1, math.ceil(len(keys) / BLOCK))
    term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
    weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
    example = np.repeat(np.arange(len(keys)), [len(v[0]) for v in vectors]) if vectors else np.zeros(0, np.int64)
    cell = term * blocks + example // BLOCK
    order = np.lexsort((example, cell))
    index.example, index.weight = example[order], weight[order]
    index.start = np.searchsorted(cell[order], np.arange(len(terms) * blocks + 1))
    index.block_max = np.zeros(len(terms) * blocks)
    np.maximum.at(index.block_max, cell, weight)
    index.block_max = index.block_max.reshape(len(terms), blocks)
    # Leave-one-out votes of every sample text, weighted back to the label shares of all labelled rows.
    n = np.array([sum(r["label"] == y for r in rows) for y in (0, 1)], float)
    share = np.array([1 - rate, rate]) / np.maximum(n, 1)
    x, y, w = [], [], []
    for e, v in enumerate(vectors):
        best, sim = index.nearest(*v, NEIGHBOURS)
        for label in (0, 1):
            if index.label_counts[e, label]:
                x.append(index.vote(best, sim, (e, label)))
                y.append(label)
                w.append(share[label] * index.label_counts[e, label])
    if x:
        index.curve = _isotonic(np.array(x), np.array(y, float), np.array(w))
    index.blank = float(share[1] * blank[1] / max(1e-12, share[0] * blank[0] + share[1] * blank[1])) if sum(blank) else 0.0
    return index


def predict(docs: DataFrame, index: Index | None, text_col: str = "text", threshold: float = 0.3, k: int = NEIGHBOURS) -> DataFrame:
    """The rows with ``score``, ``predicted``, the terms met and the nearest examples (id, similarity, toxic share).

    Columns of the input that bear one of these names are replaced.
    """
    added = _parse_datatype_string("score double, predicted int, terms array<string>, evidence array<struct<id:bigint,similarity:double,toxic_share:double>>")
    kept = docs.drop(*added.names)
    out = StructType([*kept.schema.fields, *added])
    schema = to_arrow_schema(out)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        count = TermCounter(index.terms if index else [])
        known: dict[tuple, tuple] = {}

        def judge(found):
            if not index:
                return 0.0, []
            if not found:
                return index.blank, []
            best, sim = index.nearest(*index.vector(found), k)
            c = index.label_counts[best]
            near = [{"id": i, "similarity": s, "toxic_share": t} for i, s, t in zip(index.ids[best].tolist(), sim.round(9).tolist(), (c[:, 1] / c.sum(1)).tolist(), strict=True)]
            return index.score(index.vote(best, sim)), near

        for batch in ar.slices(batches, "_tx_text"):
            score, terms, evidence = [], [], []
            for text in batch.column("_tx_text").to_pylist():
                found = count(text)
                key = tuple(sorted(found.items()))
                if key not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[key] = judge(found)
                s, near = known[key]
                score.append(s)
                terms.append([index.terms[i] for i, _ in key] if index else [])
                evidence.append(near)
            cols = {"score": score, "predicted": [int(s >= threshold) for s in score], "terms": terms, "evidence": evidence}
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return kept.withColumn("_tx_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, out)
