import math
import random
from collections import Counter

from pyspark.sql import functions as F

from modwarden.functions import text as tx
from modwarden.operators import corpus as cp
from modwarden.operators.ranking import hashed_order, rank_by_hash, top_n_per_group


def corpus(spark, n=900, hot=300, seed=1):
    """A third of the rows are copies of one text."""
    rng = random.Random(seed)
    rows = [(i, "Hot  TEXT" if i % 3 == 0 else f"text {rng.randint(0, 200)}", int(rng.random() < .2), rng.choice("ab")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, text string, label int, lang string")


def norm(t):
    return " ".join(t.lower().split())


def test_dedupe_keeps_the_first(spark):
    rows, df = corpus(spark)
    first = {}
    for r in rows:
        first.setdefault(norm(r[1]), r[0])
    assert sorted(r.id for r in cp.dedupe_keep_first(df, "text", "id").collect()) == sorted(first.values())


def test_leakage_and_overlap(spark):
    rows, df = corpus(spark)
    train, held = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    seen = {norm(r[1]) for r in rows if r[0] % 2 == 0}
    want = sorted(r[0] for r in rows if r[0] % 2 == 1 and norm(r[1]) not in seen)
    assert sorted(r.id for r in cp.remove_leakage(held, train).collect()) == want
    other = {norm(r[1]) for r in rows if r[0] % 2 == 1}
    assert cp.split_overlap(train, held).first().overlap == len(seen & other)


def test_leakage_keeps_duplicate_rows(spark):
    held = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "text string")
    train = spark.createDataFrame([("B",)], "text string")
    assert [r.text for r in cp.remove_leakage(held, train).collect()] == ["a", "a"]


def test_rank_is_a_row_number(spark):
    rows, df = corpus(spark, 500)
    ranked = rank_by_hash(df.withColumn("o", hashed_order(7, "id")), ["lang"], "o").collect()
    for lang in "ab":
        group = sorted((r for r in ranked if r.lang == lang), key=lambda r: r.o)
        assert [r["rank"] for r in group] == list(range(1, len(group) + 1))
        assert {r.group_size for r in group} == {len(group)}


def test_rank_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id long, g string").withColumn("o", hashed_order(1, "id"))
    assert Counter(r.g for r in rank_by_hash(df, ["g"], "o").collect()) == {None: 2, "x": 1}


def test_top_n_in_a_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("g"))
    out = top_n_per_group(df, ["g"], [F.desc("id")], 1500, "id").collect()
    hot = sorted((r.id for r in out if r.g == "hot"), reverse=True)
    assert hot == sorted((i for i in range(5000) if i % 3 < 2), reverse=True)[:1500]
    assert sorted(r["rank"] for r in out if r.g == "hot") == list(range(1, 1501))


def test_split_sizes_and_no_shared_rows(spark):
    rows, df = corpus(spark)
    split = cp.stratified_split(df, "label", "id").collect()
    assert len(split) == len(rows)
    for label in (0, 1):
        n = sum(r[2] == label for r in rows)
        count = Counter(r.split for r in split if r.label == label)
        assert count["val"] == math.floor(n * .1) and count["test"] == math.floor(n * .2) - math.floor(n * .1)


def test_subsample_quotas_round_half_to_even(spark):
    rows = [(i, "a" if i < 50 else "b" if i < 95 else "c") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = Counter(r.g for r in cp.stratified_subsample(df, ["g"], "id", 10).collect())
    assert got == {"a": 5, "b": 4, "c": 1}  # 4.5 rounds to 4, 0.5 to 0 and then to the minimum of 1
    assert cp.subsample(df, "id", 7).count() == 7


def test_shuffle_is_a_permutation(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    pos = [r.position for r in cp.seeded_shuffle(df, "k").orderBy("k").collect()]
    assert sorted(pos) == list(range(1, 1001)) and pos != sorted(pos)
    assert pos == [r.position for r in cp.seeded_shuffle(df, "k").orderBy("k").collect()]


def test_copies(spark):
    df = spark.createDataFrame([("train", 1, "t"), ("train", 0, "t"), ("train", 1, "x"), ("val", 1, "t")], "split string, y int, l string")
    y, t = F.col("y") == 1, F.col("l") == "t"

    def counts(c):
        return [r["count"] for r in cp.oversample(df, c).groupBy("split", "y", "l").count().orderBy("split", F.desc("y"), "l").collect()]

    assert counts(cp.copies_v1(t)) == [2, 1, 2, 1]
    assert counts(cp.copies_v2(y, t)) == [3, 2, 2, 1]
    assert counts(cp.copies_v4(t, y)) == [8, 2, 4, 1]


def test_unknown_flags_and_no_copies_keep_the_row(spark):
    df = spark.createDataFrame([(1, "train", 1, None), (2, "train", None, "t"), (3, None, 1, "t"), (4, "val", None, None)], "id int, split string, y int, l string")
    y, t = F.col("y") == 1, F.col("l") == "t"
    for copies, want in ((cp.copies_v2(y, t), [2, 2, 1, 1]), (F.lit(0), [1, 1, 1, 1]), (F.lit(None), [1, 1, 1, 1]), (F.lit(-3), [1, 1, 1, 1])):
        assert [r["count"] for r in cp.oversample(df, copies).groupBy("id").count().orderBy("id").collect()] == want


def test_merged_corpus_has_unique_texts(spark):
    rows = [(1, "Une phrase sans accent", "fr"), (2, "Déjà vu encore", "fr"), (3, "deja vu encore", "en"), (4, "x", "fr")] + [(i, f"row number {i}", "en") for i in range(5, 60)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    merged = cp.union_corpora({"a": (df, {}), "b": (df, {})}, ["id", "text", "lang"], "id")
    grown = cp.augment_union(merged, F.col("lang") == "fr", tx.fold_accents(F.lower("text")), "text", "plain", id_col="id")
    assert grown.select("id").distinct().count() == grown.count()
    out = cp.prepare_merged(grown.withColumn("label", F.lit(0)), "id", F.lit(2)).collect()
    text = {r.id: norm(r.text) for r in grown.collect()}
    first = [r for r in out if r.copy == 1]
    assert len({text[r.id] for r in first}) == len(first) == len({t for t in text.values() if len(t) >= 3})
    assert not {text[r.id] for r in out if r.split == "train"} & {text[r.id] for r in out if r.split != "train"}


def test_ranks_take_one_shuffle(spark):
    """The rank window reuses the shuffle of its join; nulls in the group are a group."""
    from modwarden.operators.ranking import hashed_order, rank_by_hash

    rows = [(i, None if i % 3 == 0 else i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, g int").withColumn("_o", hashed_order(42, "k"))
    out = rank_by_hash(df, ["g"], "_o").collect()
    for g in (None, 1, 2):
        own = sorted((r["_o"], r["rank"]) for r in out if r.g == g)
        assert [x[1] for x in own] == list(range(1, 31)) and {r.group_size for r in out if r.g == g} == {30}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rank_by_hash(df, ["g"], "_o")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One for the rows, one for the slice counts, one for their running sums, one to bring those back.
    assert plan.count("Exchange hashpartitioning") <= 4


def test_audit_and_prepare_leave_no_leak(spark):
    rows, df = corpus(spark)
    terms = spark.createDataFrame([("text 7",)], "term string")
    audited = cp.contradiction_audit(df, "id", terms)
    want = [r[0] for r in rows if not (r[2] == 0 and "text 7" in norm(r[1]))]
    assert sorted(r.id for r in audited.collect()) == want
    assert sorted(r.id for r in cp.contradiction_audit(df, "id", terms, limit=0).collect()) == want
    out = cp.prepare_corpus(df, "id", terms, cp.copies_v2(F.col("label") == 1, F.col("lang") == "a")).collect()
    text = {r[0]: norm(r[1]) for r in rows}
    by = {s: {text[r.id] for r in out if r.split == s} for s in ("train", "val", "test")}
    assert not by["train"] & (by["val"] | by["test"])
    assert all(r.copy == 1 for r in out if r.split != "train")
    assert max(Counter(r.id for r in out).values()) == 3


def test_union_and_augment(spark):
    a = spark.createDataFrame([("x", 1)], "text string, labels int")
    b = spark.createDataFrame([("y", 0)], "text string, label int")
    u = cp.union_corpora({"a": (a, {"label": "labels"}), "b": (b, {})}, ["text", "label"])
    assert sorted(map(tuple, u.collect())) == [("x", 1, "a"), ("y", 0, "b")]
    rows = spark.createDataFrame([("नमक", 1, "hi"), ("salt", 0, "en")], "text string, label int, lang string")
    grown = cp.augment_union(rows, tx.has_devanagari("text"), tx.romanize_devanagari("text"), "text", "translit")
    assert ("namaka", 1, "translit") in [tuple(r) for r in grown.collect()] and grown.count() == 3


def test_profile_rolls_up(spark):
    _, df = corpus(spark, 90)
    rows = cp.corpus_profile(df, ["lang"], "label").collect()
    assert next(r.rows for r in rows if r.lang is None) == sum(r.rows for r in rows if r.lang is not None)
