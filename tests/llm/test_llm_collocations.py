"""Collocations against plain counting, with slices of few rows so that runs and beginnings cross them."""

import random
import re
from collections import Counter

import pytest

from modwarden.llm import collocations as co

SCHEMA = "lang string, text string"


def brute(rows, widest, least, percent, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, widest + 1) for i in range(len(w) - m + 1))
    phrases = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {
        (lang, w[i:j]) for (lang, w), a in phrases.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1)
        if j - i < len(w) and 100 * a >= percent * phrases[lang, w[i:j]]
    }
    by_lang = {}
    for (lang, w), a in phrases.items():
        if (lang, w) not in gone:
            score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((x, i, p.decode(), -a, l, r, n[x], -s) for x, v in by_lang.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1))


def some_rows(seed=3):
    rnd = random.Random(seed)
    words, gaps = ["a", "b", "C", "é", "漢x", "of", "the", "\x01q", "a\x01", "a-b", "zz", "\x00"], [" ", " ", " ", "\t", "  ", ". ", "\n", ",", " the of "]
    text = lambda: "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randrange(60)))
    odd = [(None, None), ("fr", ""), ("en", " . "), ("en", "hot pair " * 3000), ("de", "Hot pair hot pair"), ("", "no lang " * 12)]
    return [(rnd.choice(["en", "de", None, "en", "e"]), text()) for _ in range(250)] + odd


@pytest.mark.parametrize(("widest", "least", "slice_rows", "percent"), [(3, 10, 1 << 20, 50), (3, 10, 100, 50), (3, 10, 10, 80), (4, 3, 50, 50), (2, 1, 1000, 50)])
def test_equal_to_plain_counting(spark, widest, least, slice_rows, percent):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = co.collocations(df, max_words=widest, min_count=least, inside_percent=percent, slice_rows=slice_rows)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, widest, least, percent)


def test_chunks_add_up(spark, monkeypatch):
    rows = some_rows(5)
    monkeypatch.setattr(co, "CHUNK", 400)
    got = co.collocations(spark.createDataFrame(rows, SCHEMA).coalesce(2), slice_rows=200, top=7)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 10, 50, 7)


def test_products_past_64_bits(spark):
    # Counts stand in for texts: a product of 10**12 by 10**12 times a million.
    df = spark.createDataFrame([("en", 0, "", 3 * 10**12), ("en", 1, "a ", 10**12 + 1), ("en", 1, "b ", 10**12 + 3), ("en", 2, "a b ", 10**12)], "lang string, m int, phrase string, f bigint")
    real = co.phrase_counts
    co.phrase_counts = lambda *a: df
    try:
        row = co.collocations(spark.createDataFrame([("en", "a b")], SCHEMA)).first()
    finally:
        co.phrase_counts = real
    assert tuple(row) == ("en", 1, "a b", 10**12, 10**12 + 1, 10**12 + 3, 3 * 10**12, 10**6 * 10**24 // ((10**12 + 1) * (10**12 + 3)))


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([("en", "x y. " * 20, 1, 2, "z")], "lang string, text string, a int, slice int, phrase string")
    assert [tuple(r) for r in co.collocations(df).collect()] == [("en", 1, "x y", 20, 20, 20, 40, 1_000_000)]
    assert co.collocations(df.limit(0)).count() == 0
