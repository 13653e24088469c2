import random

import pytest
from pyspark.sql import functions as F

from modwarden.operators import lexicon as lx
from tests.test_text import model_norm

ROWS = [
    ("badword", "token", "en", 5, "block"), ("rude", "token", "en", 3, "flag"), ("both", "token", "en", 3, "flag"),
    ("both", "token", "xx", 5, "block"), ("gali", "token", "xx", 5, "block"), ("gaali", "token", "xx", 2, "flag"),
    ("tame", "token", "xx", 1, "mild"), ("go away", "phrase", "en", 5, "block"), ("shh", "phrase", "en", 2, "flag"),
    ("two words", "token", "xx", 5, "block"), ("rud", "token", "en", 5, "block"),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(ROWS, lx.LEXICON_SCHEMA)


def model(text):
    """The matching rule, list by list and variant by variant."""
    import re

    lists = [{}, {}]
    for term, kind, lang, _, tier in ROWS:
        if kind == "token" and tier != "mild":
            lists[0 if lang == "en" else 1].setdefault(tier, set()).add(term)
    t = model_norm(text)
    hits = []
    for tok in re.findall(r"[a-zऀ-ॿ]+", t):
        variants = [tok, re.sub(r"(.)\1+", r"\1", tok)]
        tier = term = None
        for tiers in lists:
            if tier:
                break
            for v in variants:
                if v in tiers.get("block", ()):
                    tier, term = "block", v
                    break
                if not tier and v in tiers.get("flag", ()):
                    tier, term = "flag", v
        if tier:
            hits.append((term, tier))
    for tier in ("block", "flag"):
        hits += [(r[0], tier) for r in sorted(ROWS) if r[1] == "phrase" and r[4] == tier and r[0] in t]
    action = "block" if any(h[1] == "block" for h in hits) else "flag" if hits else "none"
    return action, hits


def texts():
    rng = random.Random(5)
    words = ["badword", "BADWORD", "baadword", "rude", "rudee", "ruude", "both", "booth", "gaali", "gali", "gaaali", "tame",
             "go away", "goaway", "shhhh", "wishhh", "two words", "fine", "é", "classbadword", "rud", "ruud"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(150)] + ["", "!!!"]


def test_inline_equals_model(spark, lexicon):
    ts = texts()
    df = spark.createDataFrame(list(enumerate(ts)), "id int, text string")
    rows = lx.lexicon_verdicts(df, "id", "text", lexicon).orderBy("id").collect()
    got = [(r.lexicon_action, [(h.term, h.tier) for h in r.hits]) for r in rows]
    assert got == [model(t) for t in ts]


def test_join_equals_inline(spark, lexicon):
    df = spark.createDataFrame(list(enumerate(texts())), "id int, text string")

    def flat(d):
        return sorted((r.id, r.lexicon_action, sorted((h.term, h.tier) for h in r.hits)) for r in d.collect())

    assert flat(lx.match_by_join(df, "id", "text", lexicon)) == flat(lx.lexicon_verdicts(df, "id", "text", lexicon))


def test_paths_agree_on_short_terms_and_nulls(spark):
    rows = [("q", "phrase", "demo", 5, "block"), ("nd", "phrase", "demo", 3, "flag"), ("xyz", "phrase", "demo", 3, "flag"), ("z", "token", "demo", 5, "block"), ("र", "phrase", "demo", 5, "block")]
    lexicon = spark.createDataFrame(rows, lx.LEXICON_SCHEMA)
    df = spark.createDataFrame(list(enumerate(["a quick end", "z", "and so", "xyzzy", "", None, "र र", "plain"])), "id int, text string")

    def flat(d):
        return sorted((r.id, r.lexicon_action, sorted((h.term, h.tier) for h in r.hits)) for r in d.collect())

    inline, joined = flat(lx.lexicon_verdicts(df, "id", "text", lexicon)), flat(lx.lexicon_verdicts(df, "id", "text", lexicon, limit=0))
    assert inline == joined
    assert [x[1] for x in inline] == ["block", "block", "flag", "flag", "none", "none", "block", "none"]


def test_size_decides_the_path(spark, lexicon):
    assert lx.compile_lexicon(lexicon, limit=3) is None
    df = spark.createDataFrame([(1, "you badword")], "id int, text string")
    assert lx.lexicon_verdicts(df, "id", "text", lexicon, limit=3).first().lexicon_action == "block"


def test_default_lexicon_counts(spark):
    rows = {(r.kind, r.tier): r.terms for r in lx.lexicon_profile(lx.default_lexicon(spark)).collect()}
    assert rows[("phrase", "block")] == 10 and rows[("phrase", "flag")] == 5 and rows[("token", "flag")] == 19


@pytest.mark.parametrize("text, action", [
    ("damn that is annoying", "flag"), ("shut up already", "flag"), ("you are vermin", "block"),
    ("nobody would even miss you", "block"), ("this movie is stupid but the songs were okay", "none"),
    ("classic assessment of grapes", "none"), ("", "none"),
])
def test_default_lexicon_cases(spark, text, action):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert lx.lexicon_verdicts(df, "id", "text", lx.default_lexicon(spark)).first().lexicon_action == action


def test_contains_paths_agree(spark):
    df = spark.createDataFrame([(1, "An Abc def"), (2, "ab"), (3, "xabcx"), (4, "de f")], "id int, text string")
    terms = spark.createDataFrame([("abc",), ("c d",), ("",)][:2], "term string")
    joined = sorted(r.id for r in lx.rows_with_terms(df, "id", "text", terms, 3).collect())
    inline = sorted(r.id for r in df.filter(lx.contains_term(F.lower("text"), terms)).collect())
    assert joined == inline == [1, 3]


def flat(d):
    return sorted((r.id, r.lexicon_action, [(h.term, h.tier) for h in r.hits]) for r in d.collect())


def test_automaton_equals_inline(spark, lexicon, monkeypatch):
    """Order of hits included; blocks of a few bytes give the same as one."""
    df = spark.createDataFrame([*enumerate(texts()), (-1, None)], "id int, text string")
    inline = flat(lx.lexicon_verdicts(df, "id", "text", lexicon))
    for size in (lx.BLOCK_BYTES, 9):
        monkeypatch.setattr(lx, "BLOCK_BYTES", size)
        automata = lx.compile_automata(lexicon)
        assert len(automata.phrases) == (1 if size > 9 else 2)
        assert flat(lx.match_by_automaton(df, "text", automata)) == inline
    assert lx.compile_automata(lexicon, limit=20) is None
    plan = lx.match_by_automaton(df, "text", automata)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan


def test_automaton_of_many_terms_equals_inline(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    rows = [(word(rng.randint(1, 50)), rng.choice(["phrase", "token"]), rng.choice(["en", "xx"]), 5, rng.choice(["block", "flag", "mild"])) for _ in range(900)]
    rows = [r for r in rows if r[0].strip() and (r[1] == "token" or "  " not in r[0])]
    lexicon = spark.createDataFrame(rows, lx.LEXICON_SCHEMA)
    df = spark.createDataFrame([(i, word(rng.randint(0, 2000)) + rng.choice(rows)[0]) for i in range(60)], "id int, text string")
    monkeypatch.setattr(lx, "BATCH", 5000)
    assert flat(lx.lexicon_verdicts(df, "id", "text", lexicon, limit=0)) == flat(lx.lexicon_verdicts(df, "id", "text", lexicon))


@pytest.mark.parametrize("seed", range(8))
def test_automaton_finds_all(seed):
    import pyarrow as pa

    from modwarden.functions import automaton as am

    rng = random.Random(seed)
    letters = rng.choice(["ab", "abc ", "aéर ", "abcdefghij "])
    terms = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([3, 9, 50])))) for _ in range(rng.choice([1, 5, 300]))})
    rows = ["".join(rng.choice(letters + "z") for _ in range(rng.choice([0, 3, 60, 900, 3000]))) for _ in range(20)] + [None]
    data, offsets = am.utf8(pa.array(rows))
    row, at, term = am.Automaton(terms).find(data, offsets)
    want = []
    for i, text in enumerate(rows):
        raw = (text or "").encode()
        for k, t in enumerate(terms):
            p = raw.find(t.encode())
            while p >= 0:
                want.append((i, p, k))
                p = raw.find(t.encode(), p + 1)
    assert sorted(zip(row.tolist(), (at - offsets[row]).tolist(), term.tolist(), strict=True)) == sorted(want)


def test_hundred_thousand_terms(spark):
    rng = random.Random(4)
    terms = {"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 30))) for _ in range(100_000)}
    lexicon = spark.createDataFrame([(t, "phrase" if len(t) % 2 else "token", "xx", 5, "block") for t in terms], lx.LEXICON_SCHEMA)
    some = rng.sample(sorted(terms), 40)
    df = spark.createDataFrame([(i, f"zz {t} zz") for i, t in enumerate(some)] + [(99, "zz q")], "id int, text string")
    rows = {r.id: {h.term for h in r.hits} for r in lx.lexicon_verdicts(df, "id", "text", lexicon).collect()}
    from tests.test_text import model_norm

    assert all((t in rows[i]) == (model_norm(t) == t) for i, t in enumerate(some)) and rows[99] == set()


def test_long_list_by_automaton(spark):
    df = spark.createDataFrame([(1, "An Abc def"), (2, "ab"), (3, "xabcx"), (4, None)], "id int, text string")
    terms = spark.createDataFrame([("abc",), ("c d",), ("",), ("abc",)], "term string")
    hit = lx.contains_term(F.lower("text"), terms, limit=1)
    assert [(r.id, r.h) for r in df.select("id", hit.alias("h")).orderBy("id").collect()] == [(1, True), (2, False), (3, True), (4, None)]
    assert lx.holds_term(F.col("text"), terms, limit=3) is None
