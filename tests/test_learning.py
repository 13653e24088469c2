"""The folded model against the pipeline it was folded from."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from modwarden.functions import windows as wn
from modwarden.functions.automaton import cuts, utf8
from modwarden.functions.hashed import murmur3
from modwarden.operators import learning as ml

WORDS = ["Straße", "É", "good", "BAD", "x", "abcdefghijklmnop", "漢字", "don't", "a1b", "𐐀word", "toolong" * 9, "ab", "abc", "abcd", "abcde"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(WORDS) + rng.choice(["", ".", "!!", " "]) for _ in range(rng.randrange(0, 300))) for _ in range(120)]
    return spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)] + [(900, None, 0), (901, "", 1), (902, "...", 0)], "id int, text string, label int")


@pytest.fixture(scope="module")
def model(rows):
    return ml.build_pipeline(0.01, features=1 << 10).fit(rows.filter("text is not null"))


def test_hashes_are_those_of_the_transformer(spark):
    import pyarrow as pa

    tf = HashingTF(numFeatures=1 << 16)
    data, offsets = utf8(pa.array(WORDS))
    got = murmur3(data, offsets[:-1], offsets[1:]) % (1 << 16)
    assert got.tolist() == [tf.indexOf(w) for w in WORDS]
    assert len(murmur3(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_scores_equal_the_pipeline(spark, rows, model):
    windows = rows.select("id", F.explode(wn.window_text("text", ml.WHOLE)).alias("w")).select("id", "w.ix", F.col("w.text").alias("text"))
    want = {(r.id, r.ix): r.score for r in ml.predict(model, windows).collect()}
    score = ml.folded_scorer(spark, ml.fold(model))
    found = rows.select("id", score(F.transform(wn.window_text("text", ml.WHOLE), lambda w: w["text"])).alias("s")).collect()
    got = {(r.id, i): s for r in found for i, s in enumerate(r.s or [])}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_documents_stay_in_their_rows(spark, rows, model):
    out = ml.score_documents(model, rows, "id", "text")
    plan = out._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    by_id = {r.id: r for r in out.collect()}
    assert len(by_id) == rows.count()
    assert all((by_id[i].score, by_id[i].action, by_id[i].windows) == (0.0, "clean", 0) for i in (900, 901))


def test_epochs_learn_stop_and_keep_the_best(spark, tmp_path):
    from modwarden.operators import epochs as ep

    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(" ".join(rng.choice(words) for _ in range(8)) + (" vile vile" if i % 3 == 0 and i % 41 else ""), int(i % 3 == 0)) for i in range(900)]
    train = spark.createDataFrame(rows[:700] + [(None, 0), ("", 0), ("...", None)], "text string, label int").repartition(3)
    val = spark.createDataFrame(rows[700:], "text string, label int")
    model, runs = ep.train_epochs(train, val, policy=ep.EpochPolicy(epochs=12, patience=3, rate=4.0, features=1 << 12))
    log = sorted(runs.collect())
    best = [r for r in log if r.best]
    assert len(best) == 1 and best[0].f1 == max(r.f1 for r in log) > 0.9, log
    assert [r.epoch for r in log] == list(range(1, len(log) + 1)) and (len(log) == 12 or len(log) == best[0].epoch + 3)
    assert all(r.tp + r.fp + r.tn + r.fn == 200 for r in log) and log[-1].loss < log[0].loss
    # The stored predictions of the kept model give the best epoch's counts.
    scores = model.scores(val, "text", "label").collect()
    assert sum(s.score >= 0.5 and s.label == 1 for s in scores) == best[0].tp and sum(s.score >= 0.5 and s.label == 0 for s in scores) == best[0].fp
    for _ in range(2):
        ep.append_run(runs, str(tmp_path), "r1")
    ep.append_run(runs.limit(1), str(tmp_path), "r2")
    assert ep.read_runs(spark, str(tmp_path)).count() == len(log) + 1


def test_an_epoch_in_one_task_is_plain_gradient_descent(spark):
    from modwarden.operators import epochs as ep

    rows = [("a b b", 1), ("b c", 0), ("a", 1), ("", 0)]
    df = spark.createDataFrame(rows, "text string, label int").coalesce(1)
    policy = ep.EpochPolicy(batch=2, decay=0.0, rate=0.5, features=64)
    hashed = ep.hashed_texts(df, "text", "label", 64)
    idf = ep.inverse_frequencies(hashed, 64)
    got, b = ep._epoch(hashed, np.zeros(64), 0.0, idf, policy)
    at = dict(zip("abc", (HashingTF(numFeatures=64).indexOf(w) for w in "abc"), strict=True))
    w, c = np.zeros(64), 0.0
    for batch in (rows[:2], rows[2:]):
        off, xs = [], []
        for text, y in batch:
            x = np.zeros(64)
            for t in text.split():
                x[at[t]] += idf[at[t]]
            x /= max(1e-12, np.sqrt((x * x).sum()))
            xs.append(x)
            off.append(1 / (1 + np.exp(-(w @ x + c))) - y)
        w, c = w - 0.25 * sum(o * x for o, x in zip(off, xs, strict=True)), c - 0.25 * sum(off)
    assert np.allclose(got, w) and np.isclose(b, c)


def test_folded_scores_come_in_pieces(spark, monkeypatch):
    weights = np.random.default_rng(1).normal(size=1 << 10)
    score = ml.folded_scorer(spark, ml.FoldedModel(weights, 0.1))
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else [f"Word{j} and {i}" * (j + 1) for j in range(i % 5)]) for i in range(80)], "id int, t array<string>").coalesce(1)
    whole = {r.id: r.s for r in rows.select("id", score(F.col("t")).alias("s")).collect()}
    monkeypatch.setattr(ml, "cuts", lambda size: cuts(size, 50))
    again = {r.id: r.s for r in rows.select("id", ml.folded_scorer(spark, ml.FoldedModel(weights, 0.1))(F.col("t")).alias("s")).collect()}
    assert again.keys() == whole.keys() and all(np.allclose(again[i], whole[i], atol=1e-12) and len(whole[i]) == (i % 5 if i % 7 else 0) for i in whole)


def test_training_holds_a_bounded_number_of_features(monkeypatch):
    from modwarden.operators import epochs as ep

    rng = np.random.default_rng(2)
    lists = [sorted(rng.choice(900, rng.integers(0, 40), replace=False).tolist()) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([i % 2 for i in range(300)], pa.int32()), pa.array(lists, pa.list_(pa.int32())), pa.array([[1.0 + i for i, _ in enumerate(x)] for x in lists], pa.list_(pa.float32()))], ["label", "ix", "n"])
    idf = rng.random(1000)
    whole = ep._rows(batch, idf)
    assert [p.num_rows for p in ep._parts(batch, 32)] == [300]
    monkeypatch.setattr(ep, "AT_ONCE", 1500)
    parts = list(ep._parts(batch, 32))
    # Mini-batches stay whole, and each row has the weights it had.
    assert len(parts) > 3 and all(p.num_rows % 32 == 0 for p in parts[:-1]) and sum(p.num_rows for p in parts) == 300
    found = [ep._rows(p, idf) for p in parts]
    assert all((np.concatenate([f[k] for f in found]) == whole[k]).all() for k in (0, 2, 3))
    # Texts are hashed a bounded number of bytes at a time, into the same lists.
    texts = pa.RecordBatch.from_arrays([pa.array([0] * 90, pa.int32()), pa.array(["word and more words " * (i % 9) for i in range(90)])], ["label", "t"])
    once = pa.Table.from_batches(list(ep._hashed(64)([texts]))).to_pylist()
    monkeypatch.setattr(ep, "cuts", lambda size: cuts(size, 300))
    again = list(ep._hashed(64)([texts]))
    assert len(again) > 10 and pa.Table.from_batches(again).to_pylist() == once
