"""Near copies against brute-force Jaccard similarity of word shingles."""

import random
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from modwarden.llm import nearcopies

DATA = next((str(p) for p in (Path("/root/testdata/sf0.01"),) if p.is_dir()), None)


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_kept(rows, least=0.8):
    """Smallest ids of the components over all pairs at the similarity."""
    sets = {i: shingles(t) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, b in enumerate(ids):
        for a in ids[:k]:
            x, y = sets[a], sets[b]
            if x == y or min(len(x), len(y)) >= least * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i for i in ids if root[i] == i}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("small", [2, 16])
def test_near_copies_of_all_kinds(spark, monkeypatch, small):
    monkeypatch.setattr(nearcopies, "SMALL", small)
    rng = random.Random(small)
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    line = [f"l{i}" for i in range(40)]
    for g in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 150))]
        # Edits leave similarities on both sides of the bound; a common line makes groups of unlike texts.
        texts += [" ".join(edited(rng, base, rng.randrange(0, 5)) + (line if g % 2 else [])) for _ in range(6)]
    hot = [f"h{i}" for i in range(80)]
    texts += [" ".join(edited(rng, hot, k % 4)) for k in range(60)] + [" ".join(hot)] * 20
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(7)
    kept = {r.doc_id for r in nearcopies.keep_first(df).collect()}
    assert kept == brute_kept(rows)
    assert len(kept) < len(rows) - 60


def test_pair_far_in_simhash_is_found(spark):
    """One word in 60 changed keeps a similarity of 0.8 and more, but not 3 of 64 bits."""
    rng = random.Random(3)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(edited(rng, base, 1)))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.keep_one_of_near_copies(spark, df, DATA)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == brute_kept(rows) == set(range(0, 80, 2))


def test_simhash_links_come_first_and_are_verified(spark, monkeypatch):
    """Copies within the radius are linked by SimHash, so the prefix filter tries no pair of them; alike fingerprints of unlike texts are not linked."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(3000)]
    near = [" ".join(base), *(" ".join(w if i != k else "x" for i, w in enumerate(base)) for k in (7, 900, 2100))]
    # The repeated line decides the fingerprint, the words after it the set.
    alike = [" ".join(["same old line again here"] * 3000 + [f"{c}{i}" for i in range(40)]) for c in "ab"]
    far = [f"z{rng.randrange(10**6)}" for _ in range(60)]
    rows = list(enumerate([*near, *alike, " ".join(far), " ".join(edited(rng, far, 1))]))
    assert len({nearcopies.simhash.fingerprints(pa.array([t])).item() for t in alike}) == 1
    steps, plain = [], nearcopies._verified

    def verified(pairs, *rest):
        out = plain(pairs, *rest)
        steps.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(nearcopies, "_verified", verified)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, df, DATA).collect()}
    assert kept == brute_kept(rows) == {0, 4, 5, 6}
    # Three near copies and the alike text meet a first one by SimHash; only the far pair is left for the prefix filter.
    assert steps[0] == (4, 3) and steps[1] == (1, 1)


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "q r s t u v"), (4, "A b c d e f"), (2, "z")], "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in nearcopies.near_copies(df).collect()}
    assert found == {(None, 4), (None, None), (4, 4), (2, 2)}


@pytest.mark.skipif(DATA is None, reason="no test data")
def test_stage_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, DATA).collect()} == brute_kept(rows)
