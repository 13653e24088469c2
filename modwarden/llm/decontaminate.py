"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are lower-cased runs of digits, letters and other characters beyond ASCII punctuation. An item is the multiset of its word shingles; its
fingerprint is their SimHash. In a document every window of as many words as an item has is fingerprinted from
running bit counts, looked up in the blocks of the items of that size, and kept if within ``radius`` bits: with
``radius + 1`` blocks two such fingerprints agree in one block at least, so no window in the radius is missed.
What remains is decided by the exact weighted Jaccard similarity of the shingles. Windows that share fewer
shingles with all items than the similarity needs cannot reach it and are not fingerprinted.

Items come in blocks of ``item_block``, each sent to every task with that bound on its number; the documents are
read once per block of items.

Defined results: null texts and items count as empty; an item of fewer words than a shingle is one shingle of
all its words; an item without words matches nothing; items with one text are one item with the smallest id;
null item ids are left out; repeated documents get equal results; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from modwarden.llm import arrays as ar
from modwarden.llm.simhash import majority

SHINGLE, SIMILARITY = 5, 0.8
RADIUS = 21
ITEM_BLOCK, ITEM_BYTES = 5_000, 4 << 20
# Runs of digits, letters and everything beyond ASCII but its signs and the general punctuation.
_WORD = re.compile("[0-9a-z\u00c0-\u1fff\u2080-\U0010ffff]+")
_PIECE = 1 << 15
_SIGN = np.ones(256, bool)
_SIGN[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = False
_SIGN[128:] = False
_BYTES, _WORDS = ar.Rolling(), ar.Rolling(0xD6E8FEB86659FD93)


def _between_words(data: np.ndarray) -> np.ndarray:
    """Which bytes of lower-cased UTF-8 stand between words, as the pattern has it."""
    out = _SIGN[data]
    # U+0080-U+00BF are two bytes that begin with C2, U+2000-U+207F three that begin with E2 80 or E2 81.
    at = np.flatnonzero(data == 0xC2)
    out[at] = out[at + 1] = True
    at = np.flatnonzero(data == 0xE2)
    at = at[(data[at + 1] & 0xFE) == 0x80]
    out[at] = out[at + 1] = out[at + 2] = True
    return out


def shingle_hashes(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts in order, repeats included, and the first of each text (plus the total).

    A text of fewer words is one shingle.
    """
    data, offsets = ar.utf8(pa.array([t.lower() for t in texts], pa.string()))
    starts, ends, first = ar.words(data, offsets, _between_words(data))
    hashed = ar.word_hashes(data, starts, ends, _BYTES)
    n = np.diff(first)
    counts = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    row, at = ar.spread(counts)
    at += first[:-1][row]
    return ar.mix(_WORDS.spans(hashed, at, at + np.minimum(size, n[row]))), np.append(0, np.cumsum(counts))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if shared else 0.0


def _votes(h: np.ndarray) -> np.ndarray:
    """Running bit counts: row i has, for each of 64 bits, how many of the first i hashes have it set."""
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
    out = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


class Items:
    """Fingerprints of one block of items by size, cut into blocks of bits, and their shingles."""

    def __init__(self, rows: list[tuple[int, str]], radius: int = RADIUS):
        self.radius, seen = radius, {}
        rows = sorted(rows)
        hashed, first = shingle_hashes([t for _, t in rows])
        for (i, _), a, b in zip(rows, first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b > a:
                seen.setdefault(hashed[a:b].tobytes(), (i, hashed[a:b]))
        self.ids = [i for i, _ in seen.values()]
        self.shingles = [Counter(h.tolist()) for _, h in seen.values()]
        self.known = np.unique(np.concatenate([h for _, h in seen.values()])) if seen else np.zeros(0, np.uint64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, (_, h) in enumerate(seen.values()):
            fp = majority(_votes(h)[-1:], np.array([len(h)]))[0]
            self.by_size.setdefault(len(h), []).append((fp, n))
        self.by_size = {k: (np.array([f for f, _ in v], np.uint64), np.array([n for _, n in v])) for k, v in self.by_size.items()}
        # radius + 1 blocks of nearly equal width cover the 64 bits.
        edges = np.linspace(0, 64, min(64, radius + 1) + 1).round().astype(int).tolist()
        self.blocks = [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        self.tables = {}
        for k, (fps, _) in self.by_size.items():
            self.tables[k] = [self._table(fps, lo, mask) for lo, mask in self.blocks]

    @staticmethod
    def _table(fps, lo, mask):
        """For each value of a block of bits: which items have it, as a bit set."""
        sets = np.zeros((mask + 1, (len(fps) + 63) // 64), np.uint64)
        value = ((fps >> np.uint64(lo)) & np.uint64(mask)).astype(np.int64)
        np.bitwise_or.at(sets, (value, np.arange(len(fps)) // 64), np.uint64(1) << (np.arange(len(fps)) % 64).astype(np.uint64))
        return sets

    def near(self, size: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius: candidates share a block, complete distances decide."""
        own, number = self.by_size[size]
        hit = np.zeros((len(fps), (len(own) + 63) // 64), np.uint64)
        for (lo, mask), table in zip(self.blocks, self.tables[size], strict=True):
            hit |= table[((fps >> np.uint64(lo)) & np.uint64(mask)).astype(np.int64)]
        window, item = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little")[:, : len(own)])
        close = np.bitwise_count(fps[window] ^ own[item]) <= self.radius
        return window[close], number[item[close]]

    def found_in(self, text: str, least: float = SIMILARITY) -> dict[int, float]:
        """Items with a window of the text at or above the similarity, with the best one."""
        return self.found([text], least)[0]

    def found(self, texts: list[str], least: float = SIMILARITY) -> list[dict[int, float]]:
        """The same for many texts: hashed together, and only those that share a shingle are looked into."""
        h, first = shingle_hashes(texts)
        out: list[dict[int, float]] = [{} for _ in texts]
        if not len(h) or not len(self.known):
            return out
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        shared = self.known[at] == h
        for i in np.flatnonzero(ar.group_sums(shared, first)).tolist():
            a, b = first[i], first[i + 1]
            out[i] = self._search(h[a:b], shared[a:b], least)
        return out

    def _search(self, h: np.ndarray, shared: np.ndarray, least: float) -> dict[int, float]:
        best: dict[int, float] = {}
        before = np.append(0, np.cumsum(shared))
        for size in self.by_size:
            if size > len(h):
                continue
            # A window at the similarity shares at least this many shingles with one item.
            need = max(1, int(np.ceil(least * size - 1e-9)))
            starts = np.flatnonzero(before[size:] - before[:-size] >= need)
            for a in range(0, len(starts), _PIECE):
                self._windows(h, starts[a : a + _PIECE], size, least, best)
        if len(h) == 1 or len(h) < max(self.by_size):
            self._whole(h, least, best)
        return best

    def _windows(self, h, starts, size, least, best):
        lo = int(starts[0])
        votes = _votes(h[lo : int(starts[-1]) + size])
        fps = majority(votes[starts - lo + size] - votes[starts - lo], np.full(len(starts), size))
        for w, n in zip(*(x.tolist() for x in self.near(size, fps)), strict=True):
            s = similarity(Counter(h[starts[w] : starts[w] + size].tolist()), self.shingles[n])
            if s >= least:
                best[self.ids[n]] = max(s, best.get(self.ids[n], 0.0))

    def _whole(self, h, least, best):
        """A text shorter than an item is its only window for it."""
        fp = majority(_votes(h)[-1:], np.array([len(h)]))
        own = Counter(h.tolist())
        for size in self.by_size:
            if size > len(h) >= least * size:
                for n in self.near(size, fp)[1].tolist():
                    s = similarity(own, self.shingles[n])
                    if s >= least:
                        best[self.ids[n]] = max(s, best.get(self.ids[n], 0.0))


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = ITEM_BLOCK, limit: int = ITEM_BYTES):
    """Blocks of at most ``block`` items and about ``limit`` bytes, fetched one at a time."""
    items = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("size")).first()
    # Twice the needed number, as a hash fills its parts unevenly.
    parts = 1 if total["n"] <= block and total["size"] <= limit else 2 * int(max(-(-total["n"] // block), -(-total["size"] // limit)))
    for p in range(parts):
        yield [(r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == p).collect()]


ADDED = "contaminated boolean, items array<struct<item_id:bigint,similarity:double>>"


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", item_id: str = "item_id", least: float = SIMILARITY, radius: int = RADIUS, block: int = ITEM_BLOCK) -> DataFrame:
    """The rows with ``contaminated`` and the ``items`` found in them, most similar first.

    Columns of the input that bear one of these names are replaced.
    """
    added = _parse_datatype_string(ADDED)
    kept = docs.drop(*added.names)
    out = kept.withColumn("items", F.array().cast(added["items"].dataType))
    for rows in item_blocks(benchmark, item_id, item_text, block):
        if rows:
            out = _search(out, text_col, rows, least, radius)
    order = F.expr("array_sort(items, (a, b) -> CASE WHEN a.similarity > b.similarity THEN -1 WHEN a.similarity < b.similarity THEN 1 WHEN a.item_id < b.item_id THEN -1 WHEN a.item_id > b.item_id THEN 1 ELSE 0 END)")
    return out.select(*kept.columns, (F.size("items") > 0).alias("contaminated"), order.alias("items"))


def _search(docs: DataFrame, text_col: str, rows: list[tuple[int, str]], least: float, radius: int) -> DataFrame:
    """Adds what one block of items finds to ``items``; the blocks follow each other in one pass over the rows."""
    schema = to_arrow_schema(StructType(docs.schema.fields))
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        items = Items(shared.value, radius)
        for batch in ar.slices(batches, "_dc_text", 2 << 20):
            texts = pc.fill_null(batch.column("_dc_text"), "").to_pylist()
            got = []
            for best, have in zip(items.found(texts, least), batch.column("items").to_pylist(), strict=True):
                got.append([*have, *({"item_id": i, "similarity": s} for i, s in best.items())])
            yield pa.RecordBatch.from_arrays([pa.array(got, f.type) if f.name == "items" else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return docs.withColumn("_dc_text", F.col(text_col).cast("string")).mapInArrow(run, docs.schema)
