import random

from pyspark.sql import functions as F

from modwarden.operators import fusion as fu
from modwarden.operators import media as md


def test_window_that_decides(spark):
    rows = [("early", 0, .2, "a"), ("early", 1, .91, "b"), ("early", 2, .99, "c"), ("tie", 0, .6, "x"), ("tie", 1, .6, "y"),
            ("low", 0, .1, "z" * 300)]
    out = {r.k: r for r in md.max_window_score(spark.createDataFrame(rows, "k string, ix int, score double, text string"), "k").collect()}
    assert (out["early"].window, out["early"].windows, out["early"].action, out["early"].tier) == ("b", 2, "block", "hate")
    assert (out["tie"].window, out["tie"].windows, out["tie"].action) == ("x", 2, "flag")
    assert out["low"].action == "clean" and len(out["low"].window) == 240


def test_ocr_text_verdict(spark):
    rows = [("block", .1, "some text"), ("flag", .5, "some text"), ("none", .75, "some text"), ("flag", .1, "some text"),
            ("block", .9, " ab "), ("none", .1, "some text")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, lex string, s double, t string")
    got = [(r.ocr_action, r.ocr_source) for r in md.ocr_text_verdict(df, "lex", "s", "t").orderBy("i").collect()]
    assert got == [("block", "lexicon-ocr"), ("flag", "ocr-text"), ("block", "ocr-text"), ("flag", "lexicon-ocr"),
                   ("clean", None), ("clean", None)]


def test_image_rollup(spark):
    rows = [(1, 0, "block", "a"), (1, 1, "flag", "b"), (1, 2, "block", "c"), (2, 0, "clean", "a"), (2, 1, "flag", "b"),
            (2, 2, "flag", "c"), (3, 0, "clean", "a")]
    df = spark.createDataFrame(rows, "p int, ix int, action string, url string")
    out = {r.p: (r.action, r.image_ix, r.url) for r in md.image_rollup(df, "p", "ix", "action", ["url"]).collect()}
    assert out == {1: ("block", 2, "c"), 2: ("flag", 1, "b"), 3: ("clean", None, None)}


def test_best_ocr_candidate(spark):
    text = "look out for signs"
    rows = [("stop", 0, "|||", 90.), ("stop", 1, text, 30.), ("stop", 2, text, 99.), ("low", 0, text, 10.), ("none", 0, "|||", 90.)]
    df = spark.createDataFrame(rows, "k string, ix int, t string, c double")
    out = {r.k: (r.pass_ix, r.text) for r in md.best_ocr_candidate(df, "k", "ix", "t", "c").collect()}
    assert out == {"stop": (1, text), "low": (None, ""), "none": (None, "")}


def test_confirm_video(spark):
    rows = [("one", 0, "video", "image", "block"), ("two", 0, "video", "image", "flag"), ("two", 1, "video", "image", "block"),
            ("same", 1, "video", "image", "flag"), ("same", 1, "video", "image", "block"), ("ocr", 0, "video", "ocr-text", "flag"),
            ("gif", 0, "gif", "image", "block"), ("flags", 0, "video", "image", "flag"), ("flags", 2, "video", "image", "flag")]
    df = spark.createDataFrame(rows, "scan_id string, frame_ix int, kind string, source string, action string")
    assert {r.scan_id: r.action for r in md.confirm_video(df).collect()} == {
        "one": "clean", "two": "block", "same": "clean", "ocr": "flag", "gif": "block", "flags": "flag"}


def test_frames(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (20,)], "n int")
    assert [r.f for r in df.select(md.sample_frame_indexes("n").alias("f")).collect()] == [[], [0, 1], [0, 1, 2], [0, 6, 13]]
    frames = spark.createDataFrame([("a", t) for t in (10., 10.2, 10.6, 10.9, 11.3, 12.9)] + [("b", 1.)], "s string, t double")
    got = sorted((r.s, r.bucket, r.t) for r in md.sample_video_frames(frames, "s", "t").collect())
    assert got == [("a", 0, 10.), ("a", 1, 10.6), ("a", 2, 11.3), ("b", 0, 1.)]


def otsu(values):
    hist = [values.count(t) for t in range(256)]
    total, n, sb, wb, best, thr = sum(values), len(values), 0, 0, 0, 127
    for t in range(256):
        wb += hist[t]
        if not wb:
            continue
        if not n - wb:
            break
        sb += t * hist[t]
        v = wb * (n - wb) * (sb / wb - (total - sb) / (n - wb)) ** 2
        if v > best:
            best, thr = v, t
    return thr


def test_otsu(spark):
    rng = random.Random(4)
    groups = {"two": [rng.choice((30, 200)) + rng.randint(-9, 9) for _ in range(200)], "flat": [7] * 20,
              "noise": [rng.randint(0, 255) for _ in range(300)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v int")
    assert {r.g: r.threshold for r in md.otsu_threshold(df, "g", "v").collect()} == {g: otsu(v) for g, v in groups.items()}


def test_media_status(spark):
    rows = [(False, "clean", 0, 0), (True, "clean", 2, 0), (True, "clean", 3, 0), (False, "error", 0, 1), (True, "error", 1, 2),
            (True, "timed-out", 0, 0), (False, "deferred", 0, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, inc boolean, ocr string, ia int, oa int")
    s = df.select("i", md.media_status(*[F.col(c) for c in ("inc", "ocr", "ia", "oa")]).alias("s")).orderBy("i").collect()
    assert [(r.s.state, r.s.retry) for r in s] == [
        ("complete", None), ("error", "image-fetch"), ("error", None), ("error", "ocr-error"), ("error", "image-fetch"),
        ("pending", "ocr-in-flight"), ("pending", "capacity-full")]


def merge(reasons):
    """One by one, as findings arrive."""
    out = {}
    for key, source, image, action, seq in sorted(reasons, key=lambda r: r[4]):
        if action == "clean":
            continue
        at = (key, source, image or "")
        if at not in out or out[at][0] != "block" or action == "block":
            out[at] = (action, seq)
    return out


def test_refinement_equals_arrival_order_merge(spark):
    rng = random.Random(8)
    rows = [(f"k{rng.randint(0, 2)}", rng.choice(("image", "ocr-text", "text")), rng.choice((None, "i1", "i2")),
             rng.choice(("clean", "flag", "block")), i) for i in range(200)]
    want = merge(rows)
    for _ in range(2):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "key string, source string, image_key string, action string, seq long")
        got = {(r.key, r.source, r.image_key): (r.action, r.seen) for r in fu.strongest_reasons(df, "key", "seq").collect()}
        assert got == want


def test_refine_leaves_untouched_keys_out(spark):
    schema = "key string, source string, image_key string, action string, seq long"
    base = spark.createDataFrame([("a", "text", None, "flag", 1), ("b", "text", None, "block", 1)], schema)
    add = spark.createDataFrame([("a", "image", "i", "block", 2), ("b", "image", "i", "clean", 2)], schema)
    assert [(r.key, r.action, r.reasons) for r in fu.refine_verdict(base, add, "key", "seq").collect()] == [("a", "block", 2)]


def test_reconcile(spark):
    schema = f"key string, action string, reasons array<{fu.REASON_TYPE}>, shown array<string>, ts long"
    rows = [("a", "block", [("image", "block", "gone", "u"), ("text", "flag", None, None)], ["new"], 5),
            ("b", "block", [("image", "block", "new", None)], ["new"], 5), ("c", "flag", [("ocr-text", "flag", "gone", None)], [], 5)]
    out = fu.reconcile_verdicts(spark.createDataFrame(rows, schema), "reasons", "shown", F.lit(9)).orderBy("key").collect()
    assert [(r.action, len(r.reasons), r.ts) for r in out] == [("flag", 1, 9), ("block", 1, 5), ("clean", 0, 9)]


def test_reconcile_by_address(spark):
    """An address counts only where there is no key, and only among the current addresses."""
    schema = f"key string, action string, reasons array<{fu.REASON_TYPE}>, shown array<string>, urls array<string>, ts long"
    cases = [(None, "u1", True), ("", "u1", True), ("", "u9", False), ("k1", "u9", True), ("k9", "u1", False), (None, None, False), ("", "", False)]
    rows = [(str(i), "flag", [("image", "flag", key, url)], ["k1", ""], ["u1", ""], 5) for i, (key, url, _) in enumerate(cases)]
    out = fu.reconcile_verdicts(spark.createDataFrame(rows, schema), "reasons", "shown", F.lit(9), current_urls="urls").collect()
    assert {r.key: (r.action, len(r.reasons), r.ts) for r in out} == {str(i): ("flag", 1, 5) if kept else ("clean", 0, 9) for i, (*_, kept) in enumerate(cases)}


def test_reasons_by_address(spark):
    schema = "key string, source string, image_key string, image_url string, action string, seq long"
    rows = [("a", "image", "k", "u1", "block", 1), ("a", "image", "k", "u2", "flag", 2), ("a", "image", None, "u1", "flag", 3), ("a", "image", "", "u1", "flag", 4), ("a", "image", None, None, "flag", 5)]
    out = fu.strongest_reasons(spark.createDataFrame(rows, schema), "key", "seq", url="image_url").collect()
    assert sorted((r.image_key, r.image_url, r.action, r.seen) for r in out) == [("", "", "flag", 5), ("", "u1", "flag", 4), ("k", "", "block", 1)]


def test_fuse(spark):
    df = spark.createDataFrame([("flag", "block"), ("clean", "clean"), ("clean", "flag")], "a string, b string")
    out = [r.v for r in df.select(fu.fuse(fu.part("lexicon", F.col("a")), fu.part("text", F.col("b"))).alias("v")).collect()]
    assert [(v.action, [x.source for x in v.reasons]) for v in out] == [
        ("block", ["lexicon", "text"]), ("clean", []), ("flag", ["text"])]
