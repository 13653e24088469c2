"""Language models, toxicity neighbours, the additive quality model and decontamination."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from modwarden.llm import decontaminate, langid, quality, toxicity

# ------------------------------------------------------------------------------- language models


def padded(text, order):
    out, last = [], 0
    for c in text.lower():
        s = ord(c) if c.isalpha() else 0
        if s or last:
            out.append(s)
        last = s
    return [0] * (order - 1) + out


def brute_log_prob(texts, order):
    """Interpolated Kneser-Ney of one language, with dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = padded(t, order)
        for i in range(order - 1, len(s)):
            counts[order][tuple(s[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    discount, total, kinds = {}, defaultdict(int), defaultdict(int)
    for k in range(1, order + 1):
        ones, twos = (sum(v == n for v in counts[k].values()) for n in (1, 2))
        discount[k] = ones / (ones + 2 * twos) if ones and twos else 0.5
        for g, n in counts[k].items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1

    def p(g, floor):
        k = len(g)
        if not k:
            return floor
        below = p(g[1:], floor)
        if not total[g[:-1]]:
            return below
        return max(counts[k][g] - discount[k], 0) / total[g[:-1]] * (counts[k][g] > 0) + discount[k] * kinds[g[:-1]] / total[g[:-1]] * below

    return p


def langs(seed=1, n=40):
    r = random.Random(seed)
    make = {"aa": ["ba", "na", "to", "ri"], "bb": ["sch", "ung", "ein", "ß"], "cc": ["é", "eau", "tion", "que"]}
    return [(lang, "".join(r.choice(p) + r.choice(["", "", " ", ", "]) for _ in range(r.randint(1, 40)))) for lang, p in make.items() for _ in range(n)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_probabilities_equal_a_plain_kneser_ney(order):
    data = langs()
    names = sorted({x for x, _ in data})
    tables = []
    for name in names:
        c = Counter()
        for _, t in (d for d in data if d[0] == name):
            s = padded(t, order)
            for i in range(order - 1, len(s)):
                c[tuple(s[i - order + 1 : i + 1])] += 1
        grams = sorted(c)
        tables.append((np.array(grams, np.uint32), np.array([c[g] for g in grams])))
    model = langid.build(names, tables, order)
    asked = ["banana tori", "schein que", "zzz unseen", "a", "é", "123", "", "Na-na 5 toß"]
    entropy, n, letters = langid.Scorer(model).entropies(asked)
    vocabulary = len({s for g, _ in tables for s in g.reshape(-1).tolist()}) + 1
    for j, name in enumerate(names):
        p = brute_log_prob([t for x, t in data if x == name], order)
        for i, t in enumerate(asked):
            s = padded(t, order)
            want = [-math.log(p(tuple(s[k - order + 1 : k + 1]), 1 / vocabulary)) for k in range(order - 1, len(s))]
            assert n[i] == len(want) and letters[i] == sum(c.isalpha() for c in t)
            assert entropy[i, j] == pytest.approx(sum(want) / max(1, len(want)), rel=1e-4, abs=1e-6)


def test_finder_finds():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    asked = np.concatenate([keys, keys + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
    at, hit = langid.Finder(keys)(asked)
    known = set(keys.tolist())
    assert hit.tolist() == [k in known for k in asked.tolist()] and (keys[at[hit]] == asked[hit]).all()


def test_languages(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(langs(2, 120))]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 345 !", "cc"), (903, "ba" * 20000, None), (904, "x", None), (None, "banana", "aa")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double").repartition(4)
    model = langid.fit(df, max_grams=500)
    assert max(len(k) for k, _ in model.log_prob) <= 3 * 500
    out = {r.doc_id: r for r in langid.predict(df, model).collect()}
    right = sum(out[i].lang_pred == lang for i, _, lang in rows) / len(rows)
    assert right > 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert out[903].lang_pred == "aa" and all(0 <= r.score <= 1 for r in out.values())
    strict = {r.doc_id: r for r in langid.predict(df, model, reject_below=1.1).collect()}
    assert all(r.lang_pred == "und" for r in strict.values()) and strict[903].rejected and not strict[900].rejected
    assert langid.fit(df.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


# ------------------------------------------------------------------------------------- toxicity


def toxic_rows(n=240, seed=3):
    r = random.Random(seed)
    plain = ["tree", "river", "stone", "cloud", "green", "walk", "house", "bird"]
    bad = ["scumbag", "scumlord", "idiotic", "trashy"]
    rows = []
    for i in range(n):
        y = i % 4 == 0
        w = r.choices(plain, k=r.randint(5, 30)) + (r.choices(bad, k=r.randint(1, 4)) if y else [])
        r.shuffle(w)
        rows.append((i, " ".join(w), int(y)))
    return rows


def test_neighbours_are_exact():
    r = random.Random(6)
    rows = [{"_id": i, "label": r.randint(0, 1), "terms": sorted(r.sample(range(40), k)), "counts": [r.randint(1, 3) for _ in range(k)]} for i, k in enumerate(r.choices(range(0, 7), k=700))]
    index = toxicity._index([f"t{i}" for i in range(40)], np.linspace(1, 4, 40), rows, 0.2)
    dense = np.zeros((len(index.ids), 40))
    blocks = index.block_max.shape[1]
    for cell in range(40 * blocks):
        for p in range(index.start[cell], index.start[cell + 1]):
            dense[index.example[p], cell // blocks] = index.weight[p]
    assert blocks > 3 and np.allclose((dense**2).sum(1), 1)
    for _ in range(200):
        terms = r.sample(range(40), r.randint(1, 6))
        t, w = index.vector(Counter({x: r.randint(1, 3) for x in terms}))
        q = np.zeros(40)
        q[t] = w
        sim = dense @ q
        best, got = index.nearest(t, w, 7)
        assert np.allclose(got, -np.sort(-sim)[: len(got)], atol=1e-9)
        assert len(best) == min(7, (sim > 0).sum()) and np.allclose(sim[best], got, atol=1e-9)


def test_isotonic_is_monotone_and_keeps_the_mean():
    r = np.random.default_rng(1)
    x, w = r.random(200), r.random(200) + 0.1
    y = (r.random(200) < x).astype(float)
    kx, ky = toxicity._isotonic(x, y, w)
    assert (np.diff(ky) >= 0).all() and (np.diff(kx) >= 0).all()
    # Pools are the nearest monotone fit: their weighted mean is the data's.
    assert abs(np.average(y, weights=w) - np.average(np.interp(x, kx, ky), weights=w)) < 0.1


def test_toxicity(spark):
    rows = toxic_rows()
    odd = [(900, None), (901, ""), (902, "scumfoo tree"), (903, "river " * 30000 + "idiotic"), (None, "tree"), rows[0][:2]]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(i, t, 1) for i, t in odd], "doc_id long, text string, terms int").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels, sample=100)
    assert any(t.startswith("scum") for t in index.terms) and abs(index.rate - 0.25) < 0.01
    out = toxicity.predict(docs, index).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    assert sum(by[i].predicted == y for i, _, y in rows) / len(rows) > 0.97
    assert by[900].score == by[901].score and by[900].predicted == 0 and by[902].predicted == 1 and by[903].predicted == 1
    assert by[902].evidence and by[902].terms and all(0 <= r.score <= 1 for r in out)
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.predict(docs, None).collect()} == {0.0}
    assert toxicity.predict(docs.limit(0), index).count() == 0


# -------------------------------------------------------------------------------------- quality


def test_features_of_plain_cases():
    col = lambda f: quality.FEATURES.index(f)
    x = quality.features(pa.array(["", None, "Aa bb bb.\ncc|d\ncc|d", "  ", "é é é"]))
    assert x.shape == (5, len(quality.FEATURES)) and np.isfinite(x).all()
    assert (x[0] == x[1]).all()
    t = "Aa bb bb.\ncc|d\ncc|d"
    assert x[2, col("log_words")] == pytest.approx(math.log1p(5)) and x[2, col("bar")] == pytest.approx(2 / len(t))
    assert x[2, col("distinct_words")] == pytest.approx(4 / 5) and x[2, col("top_word")] == pytest.approx(2 / 5)
    assert x[2, col("distinct_lines")] == pytest.approx(2 / 3) and x[2, col("same_as_before")] == pytest.approx(1 / 5)
    assert x[4, col("same_as_before")] == pytest.approx(2 / 3)
    # A text's features do not depend on its neighbours in the batch.
    assert (quality.features(pa.array([t]))[0] == x[2]).all()


def test_additive_model_learns_single_and_paired_effects():
    r = np.random.default_rng(2)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x, y)
    z = r.random((1000, 3))
    assert ((model.score(z) > 0.5) == ((z[:, 0] > 0.6) ^ (z[:, 1] > 0.5))).mean() > 0.9
    y = (x[:, 2] > 0.3).astype(float)
    assert ((quality.boost(x, y).score(z) > 0.5) == (z[:, 2] > 0.3)).mean() > 0.98


def test_quality(spark):
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choices("abcdefg", k=r.randint(2, 8))) for _ in range(r.randint(20, 60))) + "."
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! "), int(i % 3 > 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(900, None, 1.0), (901, "", 1.0), (None, "x", None), (0, rows[0][1], 1.0)], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.predict(docs, model).collect()
    by = {x.doc_id: x for x in out}
    assert len(out) == 244 and by[900].score == by[901].score
    assert sum(by[i].predicted == y for i, _, y in rows) == len(rows)
    assert quality.fit(docs, labels.limit(0)) == 0.0 and quality.fit(docs, labels.filter("quality = 1")) == 1.0
    assert {x.score for x in quality.predict(docs, 0.0).collect()} == {0.0}
    assert quality.predict(docs.limit(0), model).count() == 0


# ------------------------------------------------------------------------------ decontamination


def brute_matches(text, items, least):
    h = [tuple(x) for x in [decontaminate._WORD.findall(text.lower())]][0]
    sh = [h[i : i + 5] for i in range(len(h) - 4)] or ([h] if h else [])
    found = {}
    for i, t in items:
        w = tuple(decontaminate._WORD.findall(t.lower()))
        own = Counter([w[k : k + 5] for k in range(len(w) - 4)] or ([w] if w else []))
        size = sum(own.values())
        if not size or not sh:
            continue
        spans = [sh[k : k + size] for k in range(len(sh) - size + 1)] or ([sh] if len(sh) < size else [])
        best = max((decontaminate.similarity(Counter(s), own) for s in spans), default=0)
        if best >= least:
            found[i] = best
    return found


def contaminated_docs(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Élan", "x_y", "don't"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([2, 6, 15, 30, 50])))) for i in range(25)] + [(90, ""), (91, None), (None, "lost item here")]
    items.append((95, items[3][1]))
    docs = []
    for i in range(80):
        body = r.choices(vocab, k=r.randint(0, 80))
        if r.random() < 0.6:
            w = (r.choice(items[:25])[1]).split()
            if r.random() < 0.5:
                w[r.randrange(len(w))] = "changed"
            at = r.randint(0, len(body))
            body[at:at] = w
        docs.append((i, r.choice([" ", "\n", " - "]).join(body)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_equal_brute_force(spark, seed):
    docs, items = contaminated_docs(seed)
    docs += [(200, None), (201, ""), docs[0], (None, docs[1][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, items int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    # An item's text counts once, under its smallest id.
    least_id = {}
    for i, t in items:
        if i is not None and t:
            least_id[t] = min(least_id.get(t, 10**9), i)
    own = [(i, t) for t, i in least_id.items()]
    got = decontaminate.find(df, bench, radius=64).collect()
    for row in got:
        want = brute_matches(row.text or "", own, 0.8)
        assert {x["item_id"]: round(x["similarity"], 9) for x in row["items"]} == {k: round(v, 9) for k, v in want.items()}
        assert row.contaminated == bool(want)
    # The production radius, and items in several blocks, find the same here.
    key = lambda rows: sorted(str((x.doc_id, x["items"])) for x in rows)
    assert key(decontaminate.find(df, bench).collect()) == key(got)
    assert key(decontaminate.find(df, bench, block=7).collect()) == key(got)
    assert decontaminate.find(df.limit(0), bench).count() == 0
    assert not any(x.contaminated for x in decontaminate.find(df, bench.limit(0)).collect())


def test_blocks_miss_nothing_within_the_radius():
    r = random.Random(3)
    items = decontaminate.Items([(i, " ".join(r.choices([f"w{k}" for k in range(50)], k=20))) for i in range(70)], radius=9)
    (size,) = items.by_size
    own, number = items.by_size[size]
    fps = []
    for _ in range(500):
        v = int(own[r.randrange(len(own))])
        for b in r.sample(range(64), r.randint(0, 14)):
            v ^= 1 << b
        fps.append(v)
    window, item = items.near(size, np.array(fps, np.uint64))
    want = {(i, int(number[j])) for i, f in enumerate(fps) for j in range(len(own)) if (f ^ int(own[j])).bit_count() <= 9}
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == want
