"""Near copies by SimHash links that are verified exactly, and a prefix filter for the pairs beyond their radius.

A text is the set of its shingles, hashed to 64 bits; texts with one set are one value. SimHash fingerprints are linked
by multi-index hashing (``simhash``); each value meets the first one of its fingerprint's component, and their exact
Jaccard similarity decides. SimHash cannot tell all pairs at the similarity, so the prefix filter looks for links
between values that are still apart.

In an order that all texts share, two sets at the similarity have a common shingle among their first ``n - ceil(least * n) + 1`` (prefix
filter), so no pair is missed. Shingles that are common in some of the texts come last in that order; this
decides how many candidates there are, never which pairs are found. Shingles that only one text has among its first
leave at once; the others meet again with a parity sketch of each set: one bit per place, flipped by every shingle that
falls there. The bits in which two sketches differ are no more than the shingles in which the sets do, so a pair beyond
what the similarity allows is no candidate, and whole sets decide on the rest.

Small groups of one shingle compare all their members. Large ones compare each member with one that most of their
groups share and with the next in size; after the components of these links, only members of different components
are compared, each with its nearest first, round by round. A group of n near copies so costs a multiple of n, not of its
square.

Defined results: words are runs between ASCII spaces with A-Z taken as a-z; a text of fewer words than a shingle is
one shingle of all its words; texts without words are copies of each other; a null id is kept if all ids of its
component are null; repeated rows get equal results; all columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modwarden.llm import arrays as ar
from modwarden.llm import simhash
from modwarden.llm.components import components
from modwarden.session import materialize, scratch

SHINGLE, SIMILARITY = 5, 0.8
SMALL = 4
# Places a member in the sketches that all values have, and in those of values in large groups of several components.
SKETCHED, WIDE = 0.75, 8
# Texts that are looked at for common shingles, and how many of those are sent to the tasks.
ORDERED_BY, COMMON = 10_000, 500_000
_PAIRS, _BYTES_AT_ONCE = 1 << 18, 8 << 20
SLICE = 1 << 19
_EPS = 1e-9
_BYTES, _WORDS = ar.Rolling(), ar.Rolling(0xD6E8FEB86659FD93)


def shingle_sets(text: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = ar.utf8(text)
    data = np.frombuffer(data.tobytes().lower(), np.uint8)
    starts, ends, first = ar.words(data, offsets)
    hashed = ar.word_hashes(data, starts, ends, _BYTES)
    n = np.diff(first)
    counts = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    row, at = ar.spread(counts)
    at += first[:-1][row]
    flat = ar.mix(_WORDS.spans(hashed, at, at + np.minimum(shingle, n[row])))
    cut = np.append(0, np.cumsum(counts)).tolist()
    return [np.unique(flat[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def value_of(s: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    return int(ar.mix(np.array([ar.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def prefix_length(n: int, least: float) -> int:
    return n - math.ceil(least * n - _EPS) + 1 if n else 0


def prefix(s: np.ndarray, seen: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set: those not seen often by hash, then the others by how often they are seen."""
    p = prefix_length(len(s), least)
    rare = s[seen == 0]
    if len(rare) >= p:
        return rare[:p]
    often = seen > 0
    rest = s[often][np.argsort(seen[often], kind="stable")]
    return np.concatenate([rare, rest[: p - len(rare)]])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("_t"))


def common_shingles(docs: DataFrame, shingle: int, looked_at: int = ORDERED_BY, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles in several of the texts that are looked at, and in how many of these they are."""
    every = max(1, docs.count() // looked_at)
    some = docs.select("_t").filter(F.pmod(F.xxhash64("_t"), F.lit(every)) == 0).distinct()

    def run(batches):
        for batch in ar.slices(batches, "_t", SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(batch.column("_t"), shingle)).view(np.int64))], ["h"])

    counted = some.mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    found = counted.orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def sketch(s: np.ndarray, a_member: float = SKETCHED) -> np.ndarray:
    """Parity bits of a set, packed: a power of two of at least 64 places, and at least so many a member."""
    bits = 64
    while bits < a_member * len(s):
        bits *= 2
    return np.packbits(np.bincount((ar.mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


class Sketches:
    """Packed sketches of several sizes in one matrix per size; differing bits are counted at the smaller of two sizes."""

    def __init__(self, raw: list[bytes]):
        size = np.array([len(x) for x in raw], np.int64)
        self.of = np.zeros(len(raw), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        self.size = size
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            self.rows[n] = np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.uint64).reshape(len(at), -1)
            self.of[at] = np.arange(len(at))

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        key = self.size[a] * (1 << 32) + self.size[b]
        for k in np.unique(key).tolist():
            all_ = np.flatnonzero(key == k)
            at_once = max(1, _BYTES_AT_ONCE // max(k >> 32, k & 0xFFFFFFFF))
            for pick in (all_[i : i + at_once] for i in range(0, len(all_), at_once)):
                x, y = self.rows[k >> 32][self.of[a[pick]]], self.rows[k & 0xFFFFFFFF][self.of[b[pick]]]
                while x.shape[1] != y.shape[1]:
                    # Places fold by their lower bits.
                    if x.shape[1] > y.shape[1]:
                        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                    else:
                        y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                out[pick] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out


def _with_prefix(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int, least: float) -> DataFrame:
    """``(doc_id, sim, fp, n, sketch, prefix)``: each text's SimHash, number and size of its set, its parity bits and its first shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        keys, often = shared.value
        keys, often = np.append(keys, np.uint64(2**64 - 1)), np.append(often, 0)
        for batch in ar.slices(batches, "_t", SLICE):
            sets = shingle_sets(batch.column("_t"), shingle)
            flat = np.concatenate(sets)
            at = np.searchsorted(keys[:-1], flat)
            seen = np.where(keys[at] == flat, often[at], 0)
            cut = np.append(0, np.cumsum([len(s) for s in sets])).tolist()
            first = [prefix(s, seen[a:b], least).tobytes() for s, a, b in zip(sets, cut[:-1], cut[1:], strict=True)]
            cols = [
                batch.column("doc_id"), pa.array(simhash.fingerprints(batch.column("_t")).view(np.int64)),
                pa.array([value_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([sketch(s).tobytes() for s in sets], pa.binary()), pa.array(first, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sim", "fp", "n", "sketch", "prefix"])

    return docs.mapInArrow(run, "doc_id bigint, sim bigint, fp bigint, n int, sketch binary, prefix binary")


def _entries(batches):
    """A row per shingle of a prefix; copies within a batch give theirs once."""
    for batch in batches:
        _, at = np.unique(batch.column("fp").to_numpy(), return_index=True)
        for piece in ar.slices([batch.take(pa.array(at))], "prefix", 2 << 20):
            raw = piece.column("prefix").to_pylist()
            row = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(piece.column("fp").to_numpy()[row])], ["h", "fp"])


def _held(batches, *names):
    held = [b.select(names) for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _met(batches):
    """The entries of shingles that several values have."""
    held = _held(batches, "h", "fp")
    if held is None:
        return
    h, fp = (held.column(c).to_numpy() for c in ("h", "fp"))
    order = np.lexsort((fp, h))
    h, fp = h[order], fp[order]
    new = np.append(True, (h[1:] != h[:-1]) | (fp[1:] != fp[:-1]))
    h, fp = h[new], fp[new]
    same = h[1:] == h[:-1]
    keep = np.append(False, same) | np.append(same, False)
    yield from pa.Table.from_arrays([pa.array(h[keep]), pa.array(fp[keep])], ["h", "fp"]).to_batches(max_chunksize=100_000)


def _pairs(fp, a, b):
    """Distinct pairs of numbers, the smaller one first."""
    x, y = np.minimum(fp[a], fp[b]), np.maximum(fp[a], fp[b])
    if not len(x):
        return x, y
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    return x[new], y[new]


def _blocks(low: np.ndarray):
    """Blocks of (row, earlier row) for the earlier rows from ``low[row]`` on; of bounded size unless one row has more."""
    width = np.arange(len(low)) - low
    ends, at = np.cumsum(width), 0
    while at < len(low):
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + _PAIRS, "right")))
        row, k = ar.spread(width[at:end])
        yield row + at, low[at:end][row] + k
        at = end


class _Groups:
    """Rows of a partition by shingle, size and value: the members of a group lie together."""

    def __init__(self, held: pa.Table, least: float):
        h, fp, n = (held.column(c).to_numpy() for c in ("h", "fp", "n"))
        order = np.lexsort((fp, n, h))
        self.h, self.fp, self.n = h[order], fp[order], n[order].astype(np.int64)
        self.order, self.least = order, least
        values, self.value = np.unique(self.fp, return_inverse=True)
        first = np.zeros(len(values), np.int64)
        first[self.value] = order
        self.sketches = Sketches(held.column("sketch").take(pa.array(first)).to_pylist())
        new = np.append(True, self.h[1:] != self.h[:-1])
        self.group = np.cumsum(new) - 1
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(h)))

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that sizes and sketches let reach the similarity, and the bits in which their sketches differ."""
        ok = np.minimum(self.n[a], self.n[b]) >= self.least * np.maximum(self.n[a], self.n[b]) - _EPS
        a, b = a[ok], b[ok]
        apart = (1 - self.least) / (1 + self.least) * (self.n[a] + self.n[b])
        bits = self.sketches.differing(self.value[a], self.value[b])
        ok = bits <= apart + _EPS
        return a[ok], b[ok], bits[ok]

    def low(self) -> np.ndarray:
        """For each row the first row of its group that is not too small for it."""
        out = np.empty(len(self.n), np.int64)
        for s, size in zip(self.start.tolist(), self.size.tolist(), strict=True):
            n = self.n[s : s + size]
            out[s : s + size] = s + np.searchsorted(n, np.ceil(self.least * n - _EPS))
        return np.minimum(out, np.arange(len(out)))


_FIRST = "a bigint, b bigint, h bigint"


def _first(least: float):
    """Pairs to verify, and the members of large groups (``h`` is set, ``a`` is the member)."""

    def out(a, b, h):
        cols = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (a, b, h)]
        yield from pa.Table.from_arrays(cols, ["a", "b", "h"]).to_batches(max_chunksize=100_000)

    def run(batches):
        held = _held(batches, "h", "fp", "n", "sketch")
        if held is None:
            return
        g = _Groups(held, least)
        size = g.size[g.group]
        place = np.arange(len(g.h)) - g.start[g.group]
        few = np.flatnonzero(size <= SMALL)
        # Rows of a group lie together, so places in it count back to its rows here, too.
        row, back = ar.spread(place[few])
        tries = [(few[row], few[row - 1 - back])]
        many = np.flatnonzero((size > SMALL) & (place > 0))
        # The smallest value of a group is that of most groups with the same members.
        lead = np.array([s + int(g.fp[s : s + n].argmin()) for s, n in zip(g.start.tolist(), g.size.tolist(), strict=True)], np.int64)
        tries += [(many, many - 1)]
        large = np.flatnonzero(size > SMALL)
        leader = lead[g.group[large]]
        tries += [(large[leader != large], leader[leader != large])]
        found = [g.near(a[i : i + _PAIRS], b[i : i + _PAIRS])[:2] for a, b in tries for i in range(0, len(a), _PAIRS)]
        if found:
            yield from out(*_pairs(g.fp, *(np.concatenate(x) for x in zip(*found, strict=True))), None)
        yield from out(g.fp[large], None, g.h[large])

    return run


def _second(least: float, nearest: bool):
    """Pairs of members of large groups whose components differ: all of them, or each member with the nearest such one.

    A row tells its shingle, so that members without such a pair need not be looked at again.
    """

    def out(h, a, b):
        yield from pa.Table.from_arrays([pa.array(x) for x in (h, a, b)], ["h", "a", "b"]).to_batches(max_chunksize=100_000)

    def run(batches):
        held = _held(batches, "h", "fp", "n", "sketch", "component")
        if held is None:
            return
        g = _Groups(held, least)
        label = held.column("component").to_numpy()[g.order]
        none = np.iinfo(np.int64).max
        best = np.full(len(label), none)
        for row, other in _blocks(g.low()):
            apart = label[row] != label[other]
            a, b, bits = g.near(row[apart], other[apart])
            if nearest:
                np.minimum.at(best, a, bits * len(label) + b)
                np.minimum.at(best, b, bits * len(label) + a)
                continue
            yield from out(g.h[a], g.fp[a], g.fp[b])
        a = np.flatnonzero(best != none)
        yield from out(g.h[a], g.fp[a], g.fp[best[a] % len(label)])

    return run


def _sets(docs: DataFrame, needed: DataFrame, firsts: DataFrame, shingle: int, form=np.ndarray.tobytes) -> DataFrame:
    """``(fp, s)``: the whole set of each needed value in a form of bytes, from one of its texts."""
    ids = firsts.join(needed, "fp", "left_semi").select(F.col("first_id").alias("_id")).distinct()

    def run(batches):
        for batch in ar.slices(batches, "_t", SLICE):
            sets = shingle_sets(batch.column("_t"), shingle)
            yield pa.RecordBatch.from_arrays([pa.array([value_of(s) for s in sets], pa.int64()), pa.array(map(form, sets), pa.binary())], ["fp", "s"])

    some = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("_t")
    # Rows may share an id, so some texts are of other values than those looked for.
    return some.mapInArrow(run, "fp bigint, s binary").join(needed, "fp", "left_semi").groupBy("fp").agg(F.first("s").alias("s"))


def _in_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose whole sets are at the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for s, t in zip(batch.column("s"), batch.column("t"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= least * (len(x) + len(y) - shared) - _EPS)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("fp").alias("a"), "s"), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a bigint, b bigint")


def simhash_pairs(marked: DataFrame) -> DataFrame:
    """Pairs of values to verify: each with the smallest one of the component of its SimHash, at most one a value and fingerprint."""
    of = marked.select("sim", "fp").distinct()
    found = components(simhash.links(of.select(F.col("sim").alias("fp")).distinct()))
    groups = of.join(found.withColumnRenamed("node", "sim"), "sim", "left").select("fp", F.coalesce("component", "sim").alias("component"))
    lead = groups.groupBy("component").agg(F.min("fp").alias("lead"))
    return groups.join(lead, "component").filter("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b")).distinct()


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs that no links connect yet."""
    at = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    return pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").filter("coalesce(_a, a) <> coalesce(_b, b)").select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; the component is the smallest id reachable over similar pairs."""
    texts = _texts(docs, id_col, text_col)
    with scratch(docs.sparkSession) as held:
        marked = held(_with_prefix(texts, common_shingles(texts, shingle), shingle, least), "prefixes")
        values = held(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "values")
        firsts, about = values.select("fp", "first_id"), values.select("fp", "n", "sketch")
        close = held(simhash_pairs(marked), "simhash-pairs")
        linked = held(_verified(close, _sets(texts, _in_pairs(close), firsts, shingle), least), "simhash-links")
        known = components(linked)
        met = held(marked.select("fp", "prefix").mapInArrow(_entries, "h bigint, fp bigint").repartition("h").mapInArrow(_met, "h bigint, fp bigint"), "shared-shingles")
        tried = held(met.join(about, "fp").repartition("h").mapInArrow(_first(least), _FIRST), "candidates")
        pairs = held(_apart(tried.filter("h is null").select("a", "b").distinct(), known), "apart")
        links = linked.unionByName(held(_verified(pairs, _sets(texts, _in_pairs(pairs), firsts, shingle), least), "links"))
        members = tried.filter("h is not null").select("h", F.col("a").alias("fp"))
        found, sketches, nearest = components(links), about, True
        while True:
            # Large groups that are not one component yet. Members meet the nearest one of another component, which leaves
            # at most half of the components in each round; when no such pair is a link, all other pairs are tried.
            now = members.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
            mixed = now.groupBy("h").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("h")
            open_ = now.join(mixed, "h", "left_semi").join(sketches, "fp")
            near = held(open_.repartition("h").mapInArrow(_second(least, nearest), "h bigint, a bigint, b bigint"), "nearest")
            if nearest:
                members = near.select("h", F.col("a").alias("fp"))
            more = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            new = held(_verified(more, _sets(texts, _in_pairs(more), firsts, shingle), least), "more-links")
            if new.isEmpty():
                if not nearest or near.isEmpty():
                    break
                nearest = False
            else:
                links = links.unionByName(new)
                found = components(links)
                if not nearest:
                    break
            if sketches is about:
                # Only members that may have a link at all stay, and they are few enough for wide sketches.
                parity = lambda s: sketch(s, WIDE).tobytes()
                wide = _sets(texts, near.select(F.col("a").alias("fp")).distinct(), firsts, shingle, parity)
                sketches = held(wide.withColumnRenamed("s", "sketch").join(about.drop("sketch"), "fp"), "wide-sketches")
        classes = firsts.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        smallest = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
        of = classes.select("fp", "component").join(smallest, "component").select("fp", "component_id")
        return materialize(marked.select("doc_id", "fp").join(of, "fp").select("doc_id", "fp", "component_id"), "near-copies")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The documents with the smallest id of each component; all columns stay."""
    kept = near_copies(docs, id_col, text_col, shingle, least).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return docs.join(kept.select(F.col("doc_id").alias("_nc_id")).distinct(), F.col(id_col).cast("bigint").eqNullSafe(F.col("_nc_id")), "left_semi")
