import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modwarden import fixed_values as fv
from modwarden.functions import text as tx
from modwarden.functions import windows as wn
from modwarden.functions.automaton import cuts, text_bytes
from modwarden.functions.windows import slice_windows, window_lists, window_text
from modwarden.profiles import WindowPolicy


def one(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.select("i", column("t").alias("o")).orderBy("i").collect()]


def model_norm(text):
    t = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.category(c).startswith("M"))
    t = re.sub(r"[^a-zऀ-ॿ\s]", " ", t)
    return re.sub(r"\s+", " ", re.sub(r"(.)\1{2,}", r"\1\1", t))


def test_normalize_for_match_equals_model(spark):
    texts = ["Chuuutiye!!", "ÉCOLE naïve", "a1b2  c\n\nd", "काफ़ी अच्छा", " --x-- ", "", "coool aaa", "Ångström ǅ", "a b"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("aabbcéÉ 1!\nकि") for _ in range(60)) for _ in range(40)]
    assert one(spark, texts, tx.normalize_for_match) == [model_norm(t) for t in texts]


def test_dedupe_form_and_repeats(spark):
    assert one(spark, ["  A  b\t\nC ", "x y"], tx.normalize_for_dedupe) == ["a b c", "x y"]
    assert one(spark, ["raandii", "abc"], tx.collapse_repeats) == ["randi", "abc"]
    assert one(spark, ["Hi, you1 two"], tx.tokenize) == [["hi", "you", "two"]]


@pytest.mark.parametrize(
    "text, accepted",
    [
        ("LOOK AT YOURSELF", True), ("look out for signs", True), ("I LUV U", True), ("", False), ("|||", False),
        ("MKLT", False), ("....,,,;;;;", False), ("a", False), ("no", False), ("1234 5678 9012", False),
        ("MKMKMK MKMKMK MKMKMK", False), ("ee nn rt", False), ("TEE nee ee ee TEE nn", False), ("WW NN ee lt nee", False),
    ],
)
def test_plausibility(spark, text, accepted):
    assert (one(spark, [text], tx.plausibility)[0] > 0) == accepted


def test_plausibility_order_and_runs(spark):
    a, b, c, d = one(spark, ["look out for signs", "ee nn rt", "GO HOME NOW", "aaaa bbbb eeee oooo"], tx.plausibility)
    assert a > b and c > 0 and d == 0


def test_ocr_score_needs_plausibility(spark):
    score = lambda c: tx.ocr_candidate_score(c, F.lit(50.0))
    good, bad = one(spark, ["look out for signs", "|||"], score)
    assert bad is None and abs(good - 0.9875 * 0.7) < 1e-9


def test_romanize(spark):
    assert one(spark, ["नमस्ते Hello", "plain", "ड़"], tx.romanize_devanagari) == ["namaste Hello", "plain", "ra"]


def sentences(n):
    return " ".join(f"This is sentence number {i} of the text." for i in range(n))


def test_windows_invariants():
    assert len(slice_windows("short")) == 1 and slice_windows("  ") == [] and slice_windows(None) == []
    long = sentences(250) + " FINAL WORDS"
    w = slice_windows(long)
    assert len(w) == 6 and w[0]["start"] == 0 and w[-1]["end"] == len(long) and w[-1]["text"].endswith("FINAL WORDS")
    whole = slice_windows(long, WindowPolicy(max_windows=None))
    assert whole[-1]["end"] == len(long)
    for a, b in zip(whole, whole[1:]):
        assert b["start"] <= a["end"] and b["start"] > a["start"]
    assert all(len(x["text"]) <= 294 for x in w + whole)


def test_window_moves_back_to_sentence_end():
    text = "x" * 200 + '. "' + "y" * 400
    assert slice_windows(text)[0]["end"] == 202
    assert slice_windows("x" * 200 + '." ' + "y" * 400)[0]["end"] == 203


@pytest.mark.parametrize("mark", "\x1c\x1f\x85")
def test_separators_end_no_sentence(mark):
    assert slice_windows("x" * 200 + "." + mark + "y" * 400)[0]["end"] == 294


def test_texts_without_a_window_are_known_before_the_cut(spark):
    texts = [None, "", *wn._JS_SPACE, wn._JS_SPACE, "a", " a ", "\n.\n", "\x00", "\x85", "\x1c", "👍", " " * 400, " " * 400 + "a"]
    assert one(spark, texts, wn.holds_window) == [bool(slice_windows(t)) for t in texts]


def test_window_column(spark):
    texts = [sentences(n) for n in (1, 12, 300)]
    got = one(spark, texts, window_text)
    assert [[dict(w.asDict()) for w in g] for g in got] == [slice_windows(t) for t in texts]


def test_windows_are_cut_a_bounded_number_of_bytes_at_a_time(spark, monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " ", *("x. " * rng.randint(1, 900) for _ in range(60))]
    column = pa.array(texts, pa.string())
    parts = list(cuts(text_bytes(column), 4000))
    assert [a for a, _ in parts] == [0, *(b for _, b in parts[:-1])] and parts[-1][1] == len(texts) > len(parts) > 10
    assert all(b == a + 1 or text_bytes(column)[a:b].sum() <= 4000 for a, b in parts)
    policy = WindowPolicy(max_windows=None)
    want = [slice_windows(t, policy) for t in texts]
    found = [window_lists(column.slice(a, b - a), policy) for a, b in parts]
    assert pa.concat_arrays(found).to_pylist() == want
    # Batches of any size come back row by row.
    monkeypatch.setattr(wn, "cuts", lambda size: cuts(size, 4000))
    assert [[w.asDict() for w in r] for r in one(spark, texts, lambda c: window_text(c, policy))] == want


def test_romanisation_passes_once_for_each_ending(spark):
    """Every sign of the tables, alone and after a consonant, and a plan of few passes."""
    table = dict(fv.DEVANAGARI_CONSONANTS + fv.DEVANAGARI_VOWELS + fv.DEVANAGARI_SIGNS + fv.DEVANAGARI_OTHER)
    signs = {k for k, _ in fv.DEVANAGARI_SIGNS} | {"्"}
    consonants = {k for k, _ in fv.DEVANAGARI_CONSONANTS}

    def plain(t):
        return "".join(table.get(c, "" if c == "्" else c) + ("a" if c in consonants and t[i + 1 : i + 2] not in signs else "") for i, c in enumerate(t))

    rng = random.Random(6)
    texts = [*table, *(f"क{k}" for k in table), *("".join(rng.choice([*table, "्", " ", "a", "h", "."]) for _ in range(40)) for _ in range(60))]
    texts = [t for t in texts if re.search("[ऀ-ॿ]", t)]
    assert one(spark, texts, tx.romanize_devanagari) == [plain(t) for t in texts]
    df = spark.createDataFrame([("क",)], "t string").select(tx.romanize_devanagari("t").alias("o"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") - plan.count("regexp_replace(") == 0 and plan.count("regexp_replace(") <= 8
