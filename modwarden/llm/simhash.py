"""SimHash near-duplicates by multi-index hashing.

Fingerprints are taken once per document and linked once per value, so copies cost one row. A fingerprint of
64 bits has two segments of 32; of two fingerprints within 3 bits one segment differs in at most one bit. Each
value is listed in the table of its segments and looks up every key of the Hamming ball of radius one around
them; complete distances then decide. A task keeps of the links it finds only a spanning forest, so a group of
n near copies leaves fewer than n links, and components follow in rounds of joins.

Defined results: null and blank texts have fingerprint zero, linked like any other; a null id is carried, and is
never a component id unless all ids of the component are null; repeated rows get equal results; extra columns
are not read (``near_duplicates``) or pass through (``keep_first``).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modwarden.llm import arrays as ar
from modwarden.llm.components import components
from modwarden.session import materialize

SHINGLE, SEED, RADIUS, SEGMENT = 3, 42, 3, 32
_PAIRS = 1 << 21
_HOT = 1 << 20


def bit_votes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the hashes ``first[i]:first[i+1]`` have each of 64 bits set."""
    counts = np.diff(first)
    # Bytes of a 64-bit lane count up to 255 rows at once; longer runs are cut and added up afterwards.
    pieces = -(-counts // 255)
    run, place = ar.spread(pieces)
    cut = first[:-1][run] + 255 * place
    votes = np.zeros((len(cut), 64), np.int64)
    if len(cut):
        ones = np.uint64(0x0101010101010101)
        for k in range(8):
            lane = np.add.reduceat((h >> np.uint64(k)) & ones, cut)
            votes[:, k::8] = lane.view(np.uint8).reshape(len(cut), 8)
    return ar.group_sums(votes, np.append(0, np.cumsum(pieces)))


def majority(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 64-bit value whose bits are set in over half of the votes."""
    return np.packbits(2 * votes > counts[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(text: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """SimHash of the word shingles of each text, repeats included, A-Z taken as a-z."""
    data, offsets = ar.utf8(text)
    raw = data.tobytes()
    lines = [b" ".join(raw[a:b].lower().split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    buf = b"\n".join(lines)
    ends_of = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
    starts, ends, first = ar.words(np.frombuffer(buf, np.uint8), np.append(0, ends_of).clip(max=len(buf)))
    n = np.diff(first)
    counts = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    row, at = ar.spread(counts)
    at += first[:-1][row]
    last = at + np.minimum(shingle, n[row]) - 1
    pieces = map(buf.__getitem__, map(slice, starts[at].tolist(), ends[last].tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(at))
    return majority(bit_votes(h, np.append(0, np.cumsum(counts))), counts)


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``; the 64 bits are held in a signed long."""

    def run(batches):
        for batch in ar.slices(batches, "_t"):
            fp = fingerprints(batch.column("_t"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("_t"))
    return picked.mapInArrow(run, "doc_id bigint, fp bigint")


def _probes(fp: Column) -> Column:
    """Keys of one value: its two segments (``exact``), and all segments at one bit from them."""
    mask = F.lit((1 << SEGMENT) - 1).cast("bigint")
    low, high = fp.bitwiseAND(mask), F.shiftrightunsigned(fp, SEGMENT)
    second = F.lit(1 << SEGMENT).cast("bigint")
    flips = [0, *(1 << i for i in range(SEGMENT))]
    keys = [(low.bitwiseXOR(F.lit(x).cast("bigint")), x) for x in flips]
    keys += [(high.bitwiseXOR(F.lit(x).cast("bigint")).bitwiseOR(second), x) for x in flips]
    return F.explode(F.array(*[F.struct(k.alias("key"), F.lit(x == 0).alias("exact")) for k, x in keys]))


def _verified(fps, left, right):
    far = np.bitwise_count(fps[left] ^ fps[right])
    near = far <= RADIUS
    return left[near], right[near]


def linked(keys: np.ndarray, exact: np.ndarray, node: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Labels of the nodes after all links between table entries and probes with one key.

    Work goes in blocks of bounded size. A key with very many pairs is refined first: the other segment differs
    in at most 3 bits, so one of its four bytes is equal.
    """
    root = np.arange(len(fps))

    def join(key, exact, node):
        nonlocal root
        order = np.argsort(key, kind="stable")
        key, exact, node = key[order], exact[order], node[order]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        group = np.cumsum(np.append(False, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        table = np.flatnonzero(exact)
        have = np.bincount(group[table], minlength=len(cut))
        begin = np.cumsum(have) - have
        # Each row meets the table entries of its key.
        width = have[group]
        pairs = np.cumsum(width)
        at = 0
        while at < len(key):
            base = pairs[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(pairs, base + _PAIRS, "right")))
            row, place = ar.spread(width[at:end])
            a, b = node[at + row], node[table[begin[group[at + row]] + place]]
            a, b = _verified(fps, *(x[root[a] != root[b]] for x in (a, b)))
            if len(a):
                root = ar.labels(len(fps), np.concatenate([np.arange(len(fps)), a]), np.concatenate([root, b]))
            at = end

    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    entries = np.bincount(group, weights=exact, minlength=len(size))
    hot = (entries * size > _HOT)[group]
    join(keys[~hot], exact[~hot], node[~hot])
    if hot.any():
        k, e, nd = keys[hot], exact[hot], node[hot]
        other = np.where(k >> SEGMENT, fps[nd] & np.uint64(0xFFFFFFFF), fps[nd] >> np.uint64(SEGMENT))
        for i in range(4):
            byte = ((other >> np.uint64(8 * i)) & np.uint64(255)).astype(np.int64)
            join(k * 256 + byte, e, nd)
    return root


def _forest(batches):
    held = [(b.column("key").to_numpy(), b.column("exact").to_numpy(zero_copy_only=False), b.column("fp").to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    key, exact, fp = (np.concatenate(x) for x in zip(*held, strict=True))
    values, node = np.unique(fp, return_inverse=True)
    root = linked(key, exact, node, values.view(np.uint64))
    own = np.flatnonzero(root != np.arange(len(root)))
    for at in range(0, len(own), 50_000):
        some = own[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(values[some]), pa.array(values[root[some]])], ["a", "b"])


def links(values: DataFrame) -> DataFrame:
    """A spanning set of the links between distinct fingerprints: same components, fewer links than values per task."""
    rows = values.select("fp", _probes(F.col("fp")).alias("p")).select("fp", "p.key", "p.exact")
    return rows.repartition("key").mapInArrow(_forest, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; the component is the smallest id reachable over links."""
    marked = materialize(with_fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    values = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(links(values.select("fp")))
    classes = values.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = classes.select("fp", "component").join(least, "component").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def hex64(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The documents with the smallest id of each component; all columns stay."""
    kept = near_duplicates(docs, id_col, text_col, shingle).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return docs.join(kept.select(F.col("doc_id").alias("_sh_id")).distinct(), F.col(id_col).cast("bigint").eqNullSafe(F.col("_sh_id")), "left_semi")
