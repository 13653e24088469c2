"""Substring dedup and SimHash near-dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from modwarden.llm import arrays as ar
from modwarden.llm import simhash, substrings
from modwarden.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_removal(rows, window):
    """Per row: the kept words; a word goes if a window over it also starts under a smaller id."""
    starts = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            starts[key] = min(starts.get(key, 2**64), 2**63 - 1 if i is None else i)
    out = []
    for i, t in rows:
        w, own = WORD.findall(t or ""), 2**63 - 1 if i is None else i
        gone = set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] < own:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def random_docs(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["é", "ß x", " ", "a\x1fb"]
    shared = [" ".join(r.choices(vocab, k=r.randint(3, 30))) for _ in range(5)]
    rows = []
    for i in range(n):
        t = r.choice([" ", "\n", "\t", "  \r"]).join(r.choice(shared) if r.random() < 0.4 else " ".join(r.choices(vocab, k=r.randint(0, 15))) for _ in range(r.randint(0, 4)))
        rows.append((i * 7 % n, t))
    return [*rows, rows[0], rows[3], (None, rows[1][1]), (1000, None), (1001, ""), (1002, " \n"), (rows[2][0], rows[5][1]), (1003, "long " * 5000)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removal_equals_brute_force(spark, seed):
    rows = random_docs(seed)
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, id string, n_words int").repartition(5)
    got = substrings.remove_repeats(df, window=6, buckets=3)
    assert got.columns == ["doc_id", "text", "id", "n_words", "n_removed", "kept_text", "removed"][:3] + ["n_words", "n_removed", "kept_text", "removed"]
    found = sorted(map(str, ((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect())))
    assert found == sorted(map(str, brute_removal(rows, 6)))


def test_removed_intervals_are_maximal(spark):
    a = " ".join(f"a{i}" for i in range(30))
    rows = [(1, a), (2, f"x y {a} z {a}"), (3, "only mine")]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=10).collect()}
    assert [tuple(x) for x in got[2].removed] == [(2, 32), (33, 63)] and got[2].kept_text == "x y z"
    assert got[1].removed == [] and got[3].n_removed == 0


def test_small_flushes_change_nothing(spark, monkeypatch):
    rows = random_docs(9)
    batch_rows = [r for r in rows if r[0] is not None]
    import pyarrow as pa

    monkeypatch.setattr(substrings, "FLUSH", 40)
    batch = pa.RecordBatch.from_pydict({"_sd_id": [r[0] for r in batch_rows], "_sd_tag": [0] * len(batch_rows), "_sd_text": [r[1] for r in batch_rows]})
    out = [b for b in substrings._sender(6, 2)(iter([batch.slice(i, 7) for i in range(0, len(batch_rows), 7)]))]
    groups = {}
    for b in out:
        for k, p in zip(b.column("bucket").to_pylist(), b.column("payload").to_pylist(), strict=True):
            groups.setdefault(k, []).append((k, p))
    second = {}
    for k, ps in groups.items():
        t = substrings._bucket(2)(pa.Table.from_pydict({"bucket": pa.array([k] * len(ps), pa.int64()), "payload": pa.array([p for _, p in ps], pa.binary())}))
        for kk, p in zip(t.column("bucket").to_pylist(), t.column("payload").to_pylist(), strict=True):
            second.setdefault(kk, []).append(p)
    flagged = {}
    for kk, ps in second.items():
        t = substrings._per_document(pa.Table.from_pydict({"bucket": pa.array([kk] * len(ps), pa.int64()), "payload": pa.array(ps, pa.binary())}))
        for i, s in zip(t.column("id").to_pylist(), t.column("starts").to_pylist(), strict=True):
            flagged[i] = sorted(set(s))
    want = {}
    first = {}
    for i, t in batch_rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 5):
            first[tuple(w[k : k + 6])] = min(first.get(tuple(w[k : k + 6]), 10**9), i)
    for i, t in batch_rows:
        w = WORD.findall(t or "")
        ks = [k for k in range(len(w) - 5) if first[tuple(w[k : k + 6])] < i]
        if ks:
            want[i] = sorted(set(want.get(i, [])) | set(ks))
    assert flagged == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert substrings.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0


def test_words_equal_the_pattern():
    import pyarrow as pa

    texts = ["", None, "a", " a\tb\x0bc\x0c\rd\n", "é ü x", "  ", "x" * 100, "a\x1cb"]
    data, offsets = ar.utf8(pa.array(texts))
    starts, ends, first = ar.words(data, offsets)
    raw = data.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]


def brute_fingerprint(text, size=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    sh = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def roots(values, linked):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(4)
    base = [" ".join(r.choices("alpha beta Gamma delta ÉCLAIR".split(), k=k)) for k in (1, 2, 3, 40, 300, 700)]
    rows = []
    for i in range(120):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = f"v{r.randint(0, 3)}"
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    rows += [(500, None), (501, ""), (502, "  "), rows[0], (None, rows[1][1]), (None, "quite alone here now")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, fp int").repartition(4)
    fps = [brute_fingerprint(t) for _, t in rows]
    root = roots(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(least.get(root[f], 10**9), i)
    want = sorted(str((i, f"{f:016x}", least.get(root[f]))) for (i, _), f in zip(rows, fps, strict=True))
    out = simhash.near_duplicates(df).select("doc_id", simhash.hex64("fp").alias("h"), "component_id").collect()
    assert sorted(str((x.doc_id, x.h, x.component_id)) for x in out) == want
    kept = sorted(x.doc_id for x in simhash.keep_first(df.filter("doc_id is not null")).collect())
    assert sorted(set(kept)) == sorted({least[root[f]] for (i, _), f in zip(rows, fps, strict=True) if i is not None})


@pytest.mark.parametrize("hot", [1 << 20, 3])
def test_links_lose_nothing(spark, monkeypatch, hot):
    """Every pair within three bits is connected, also where keys are refined by bytes."""
    monkeypatch.setattr(simhash, "_HOT", hot)
    monkeypatch.setattr(simhash, "_PAIRS", 50)
    r = np.random.default_rng(5)
    seeds = r.integers(0, 2**63, 12, dtype=np.uint64)
    values = []
    for s in seeds.tolist():
        for _ in range(12):
            v = s
            for b in r.integers(0, 64, r.integers(0, 5)).tolist():
                v ^= 1 << b
            values.append(v & (2**64 - 1))
    fps = np.unique(np.array(values, np.uint64))
    keys, exact, node = [], [], []
    for n, v in enumerate(fps.tolist()):
        for seg, tag in ((v & 0xFFFFFFFF, 0), (v >> 32, 1 << 32)):
            for i in range(33):
                keys.append((seg ^ (1 << (i - 1) if i else 0)) | tag)
                exact.append(i == 0)
                node.append(n)
    # Keys meet in parts, as tasks see them; their labels are joined up afterwards.
    keys, exact, node = np.array(keys, np.int64), np.array(exact), np.array(node)
    a, b = [], []
    for part in range(3):
        own = keys % 3 == part
        root = simhash.linked(keys[own], exact[own], node[own], fps)
        a.append(np.arange(len(fps)))
        b.append(root)
    got = ar.labels(len(fps), np.concatenate(a), np.concatenate(b))
    want = roots(list(range(len(fps))), lambda x, y: (int(fps[x]) ^ int(fps[y])).bit_count() <= 3)
    assert got.tolist() == [want[i] for i in range(len(fps))]


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 330)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    assert got == roots(nodes, lambda a, b: (a, b) in pairs)


def test_plan_has_no_cross_join(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = simhash.near_duplicates(df)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_hashes_are_what_spark_hashes(spark):
    text = "one two three"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(text.encode(), seed=42)
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_texts_of_one_id_are_told_apart_by_whole_hashes(spark):
    """A short text whose hash ends in the same 16 bits as that of a long one with its id loses nothing."""
    import xxhash

    passage = " ".join(f"p{i}" for i in range(60))
    tail = xxhash.xxh64_intdigest(passage, 42) & 0xFFFF
    short = next(w for w in (f"w{i}" for i in range(2_000_000)) if xxhash.xxh64_intdigest(w, 42) & 0xFFFF == tail)
    df = spark.createDataFrame([(1, passage), (5, passage), (5, short)], "doc_id long, text string")
    rows = {(r.doc_id, r.n_words): (r.n_removed, r.kept_text) for r in substrings.remove_repeats(df).collect()}
    assert rows == {(1, 60): (0, passage), (5, 60): (60, ""), (5, 1): (0, short)}
