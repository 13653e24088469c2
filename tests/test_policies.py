import random

import pytest
from pyspark.sql import functions as F

from modwarden.functions import scores as sc

NSFW = [
    (dict(drawings=.02, hentai=.01, neutral=.95, porn=.01, sexy=.01), "clean"),
    (dict(drawings=.01, hentai=.01, neutral=.55, porn=.02, sexy=.42), "clean"),
    (dict(drawings=.88, hentai=.04, neutral=.06, porn=.01, sexy=.01), "clean"),
    (dict(drawings=.01, hentai=.02, neutral=.10, porn=.04, sexy=.83), "clean"),
    (dict(drawings=.01, hentai=.02, neutral=.30, porn=.55, sexy=.12), "flag"),
    (dict(drawings=.10, hentai=.52, neutral=.30, porn=.05, sexy=.03), "flag"),
    (dict(drawings=.01, hentai=.02, neutral=.08, porn=.04, sexy=.90), "flag"),
    (dict(drawings=.01, hentai=.02, neutral=.05, porn=.88, sexy=.04), "block"),
    (dict(drawings=.05, hentai=.91, neutral=.02, porn=.01, sexy=.01), "block"),
    (dict(neutral=1.0), "clean"),
]
VIOLENCE = [
    ((.05, .04, .03), "clean"), ((.08, .96, .01), "clean"), ((.74, .10, .02), "flag"), ((.91, .20, .03), "block"),
    ((.52, .52, .01), "flag"), ((.74, .72, .01), "block"), ((.12, .05, .93), "flag"), ((None, None, None), "clean"),
    ((float("nan"), .2, 7.0), "flag"),
]
RANK = {"clean": 0, "flag": 1, "block": 2}


def test_nsfw_cases(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(NSFW)], "i int, s map<string,double>")
    got = [r.a for r in df.select("i", sc.nsfw_action("s").alias("a")).orderBy("i").collect()]
    assert got == [w for _, w in NSFW]


def test_violence_cases(spark):
    df = spark.createDataFrame([(i, *s) for i, (s, _) in enumerate(VIOLENCE)], "i int, v double, s double, w double")
    got = [r.a for r in df.select("i", sc.violence_action("v", "s", "w").alias("a")).orderBy("i").collect()]
    assert got == [w for _, w in VIOLENCE]


def test_actions_rise_with_scores(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random(), rng.random(), rng.random() * .2) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, v double, s double, w double, d double")
    up = lambda c: F.least(F.lit(1.0), F.col(c) + F.col("d"))
    out = df.select(
        sc.violence_action("v", "s", "w").alias("a"), sc.violence_action(up("v"), up("s"), up("w")).alias("b"),
        sc.text_action("v").alias("c"), sc.text_action(up("v")).alias("e"),
    ).collect()
    assert all(RANK[r.a] <= RANK[r.b] and RANK[r.c] <= RANK[r.e] for r in out)


def test_canonical_labels(spark):
    preds = [("Drawing", .01), ("Hentai", .03), ("Neutral", float("nan")), (" Porn ", .9), ("porn", .2), ("Sexy", 3.0), ("x", 1.0)]
    df = spark.createDataFrame([(preds,), (None,)], "p array<struct<label:string,score:double>>")
    a, b = [r.s for r in df.select(sc.canonical_labels("p").alias("s")).collect()]
    assert a == dict(drawings=.01, hentai=.03, neutral=0.0, porn=.9, sexy=1.0)
    assert b == dict.fromkeys(("drawings", "hentai", "neutral", "porn", "sexy"), 0.0)


def test_sigmoid_edges(spark):
    df = spark.createDataFrame([(0.0,), (800.0,), (-800.0,), (float("nan"),), (None,), (float("inf"),)], "x double")
    assert [r.s for r in df.select(sc.sigmoid("x").alias("s")).collect()] == [0.5, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_strongest_prefers_first_on_ties_and_marks_failures(spark):
    df = spark.createDataFrame(
        [("flag", "flag", None), ("clean", "block", None), ("clean", "clean", "classify-failed: x"), ("clean", "clean", None)],
        "n string, v string, r string",
    )
    rows = [r.s for r in df.select(sc.strongest_image("n", "v", F.col("r")).alias("s")).collect()]
    assert [(r.action, r.detector, r.reason) for r in rows] == [
        ("flag", "nsfw", None), ("block", "violence-gore", None), ("clean", "nsfw", "classify-failed"), ("clean", "nsfw", None)]


@pytest.mark.parametrize("action, reason, keep", [
    ("clean", None, True), ("block", "fine", True), ("clean", "image-error:x", False), ("clean", "violence not-run", False),
    (None, None, False), ("error", None, False),
])
def test_cacheable(spark, action, reason, keep):
    df = spark.createDataFrame([(action, reason)], "a string, r string")
    assert df.select(sc.is_cacheable("a", F.col("r")).alias("k")).first().k is keep


def test_labels_and_settings(spark):
    df = spark.createDataFrame([({"toxic": .2, "not-toxic": .9, "Hate": .4},), ({"clean": 1.0},)], "m map<string,double>")
    assert [r.s for r in df.select(sc.toxic_label_score("m").alias("s")).collect()] == [.4, None]
    s = spark.createDataFrame([("false", None, "yes")], "i string, o string, l string").select(
        sc.settings_policy(*[sc.normalize_setting(c) for c in "iol"]).alias("p"))
    assert s.first().p == "0:1:1"
