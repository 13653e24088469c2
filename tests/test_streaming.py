import random

from pyspark.sql import functions as F

from modwarden.operators import fusion as fu
from modwarden.profiles import MediaPolicy
from modwarden.streaming import jobs as sj
from modwarden.streaming import keyed as ky
from modwarden.streaming import waits as wt

SCHEMA = "unit_key string, seq long, kind string, fp string, action string"


def files(spark, rows, schema, path, n=4):
    """Rows in file order, one micro-batch each."""
    step = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * step:(i + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{path}/p{i}")
    return sj.read_stream(spark, f"{path}/*", spark.createDataFrame([], schema).schema, 1)


def lifecycle(rows):
    rank = {"clean": 0, "flag": 1, "block": 2}
    state, out = {}, []
    for key, seq, kind, fp, action in sorted(rows, key=lambda r: r[1]):
        s = state.setdefault(key, {"fp": None, "image": 0, "ocr": 0, "action": "clean"})
        if kind == "request":
            outcome = "duplicate" if s["fp"] == fp else "accepted"
            if outcome == "accepted":
                s.update(fp=fp, image=0, ocr=0)
        elif fp != s["fp"]:
            outcome = "stale"
        elif kind.endswith("failed"):
            tier = kind.split("-")[0]
            s[tier] += 1
            outcome = "retry" if s[tier] <= {"image": 2, "ocr": 1}[tier] else "given-up"
        elif rank[action] > rank[s["action"]]:
            s["action"], outcome = action, "upgrade"
        else:
            outcome = "kept"
        out.append((key, seq, outcome, s["action"]))
    return sorted(out)


def test_media_lifecycle_over_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"u{rng.randint(0, 3)}", i, rng.choice(("request", "image", "ocr", "image-failed", "ocr-failed")),
             rng.choice(("f1", "f2")), rng.choice(("clean", "flag", "block"))) for i in range(240)]
    out = sj.run_to_table(ky.stream_media_lifecycle(files(spark, rows, SCHEMA, str(tmp_path))), "t", timers=True)
    assert sorted((r.unit_key, r.seq, r.outcome, r.action) for r in out.collect()) == lifecycle(rows)


def test_verdict_state_equals_batch_merge(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"k{rng.randint(0, 5)}", rng.choice(("image", "text")), None, rng.choice(("clean", "flag", "block")), i) for i in range(200)]
    schema = "key string, source string, image_key string, action string, seq long"
    stream = files(spark, rows, schema, str(tmp_path))
    updates = sj.run_to_table(sj.stream_verdict_state(stream, "key", "seq"), "t", "update")
    live = sorted(tuple(r) for r in sj.latest_verdicts(updates, "key").collect())
    batch = fu.refine_verdict(spark.createDataFrame([], schema), spark.createDataFrame(rows, schema), "key", "seq")
    assert live == sorted(tuple(r) for r in batch.select("key", "action", "reasons", "block_reasons").collect())


def test_late_media_is_kept(spark, tmp_path):
    t = 1_700_000_000_000
    rows = [("a", "text", t), ("a", "media", t + 4000), ("b", "text", t), ("b", "media", t + 9000), ("c", "text", t),
            ("z", "media", t + 60000)]
    want = [
        ("a", 4000, "published-with-media"), ("b", 6000, "published-without-media"), ("b", 9000, "late-upgrade"),
        ("c", 6000, "published-without-media")]
    for i, (order, n) in enumerate(((rows, 2), (rows[::-1], 6), (rows[3:] + rows[:3], 5))):
        stream = files(spark, order, WAIT_SCHEMA, str(tmp_path / str(i)), n)
        out = wt.settled_media(sj.run_to_table(wt.stream_late_media(stream, MediaPolicy()), "t", timers=True))
        assert sorted((r.unit_key, r.at_ms - t, r.outcome) for r in out.collect()) == want


WAIT_SCHEMA = "unit_key string, kind string, ts_ms long"


class Handle:
    """State of one key in memory, with the calls that a step makes."""

    def __init__(self):
        self.timers = set()

    def getListState(self, name, schema, ttlDurationMs=None):  # noqa: N802
        return Listed()

    def getValueState(self, name, schema, ttlDurationMs=None):  # noqa: N802
        return Valued()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class Listed:
    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def appendValue(self, row):  # noqa: N802
        self.rows.append(row)

    def clear(self):
        self.rows = []


class Valued:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs  # noqa: N815


def waited(chunks, wait_ms=50, now=0):
    """All rows that a unit writes over chunks of its events, and its step for what follows."""
    import pandas as pd

    step = wt.BoundedWait(wait_ms, 10**9)
    step.init(Handle())
    rows = []
    for i, chunk in enumerate(chunks):
        frame = pd.DataFrame(chunk, columns=["kind", "ts_ms"])
        parts = iter([frame[:1], frame[1:]] if len(chunk) > 1 else [frame])
        for out in step.handleInputRows(("u",), parts, Clock(now + i)):
            rows += list(out.itertuples(index=False))
    return rows, step


def newest(rows, over):
    last = {(r.event_ms, r.is_text, r.nth): r for r in sorted(rows, key=lambda r: r.revision)}
    due = [(r.at_ms, r.outcome if r.outcome != wt.WAITING else wt.WITHOUT if r.at_ms < over else None) for r in last.values()]
    return sorted(x for x in due if x[1])


def plain_wait(events, wait_ms, over):
    """The rule, event by event."""
    rows, text, published = [], None, False
    for ts, kind in sorted((ts, kind != "text") for kind, ts in events) + [(over, None)]:
        if text is not None and not published and ts > text + wait_ms:
            rows.append((text + wait_ms, wt.WITHOUT))
            published = True
        if kind is False:
            text, published = ts, False
        elif kind and text is not None:
            rows.append((ts, wt.LATE if published else wt.WITH))
            published = True
    return sorted(rows)


def test_bounded_wait_is_the_same_for_any_cut():
    """Random cuts and orders, equal times and repeated events included, held against the rule."""
    rng = random.Random(11)
    for trial in range(150):
        events = [(rng.choice(("text", "media")), rng.randrange(400 if trial % 3 else 12)) for _ in range(14)]
        over = max(300, *(ts for _, ts in events))
        shuffled = rng.sample(events, len(events))
        cuts = sorted(rng.sample(range(1, 14), 5))
        for order in ([events], [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, 14], strict=True)], [[e] for e in shuffled]):
            rows, _ = waited(order)
            assert newest(rows, over) == plain_wait(events, 50, over)


def test_units_of_a_bucket_wait_in_one_step():
    """All units of a bucket, null among them, against the rule; calls to the state do not grow with the units."""
    import pandas as pd

    for n in (5, 200):
        rng = random.Random(n)
        units = [None, *(f"u{i}" for i in range(n - 1))]
        events = [(u, rng.choice(("text", "media")), rng.randrange(300)) for u in units for _ in range(8)]
        rng.shuffle(events)
        step, rows = wt.BoundedWait(50, 10**9), []
        step.init(Handle())
        counted = []
        for state in (step.events, step.over, step.timer):
            for name in ("get", "exists", "update", "appendValue", "clear"):
                if hasattr(state, name):
                    setattr(state, name, lambda *a, name=name, call=getattr(state, name): (counted.append(name), call(*a))[1])
        for i in range(0, len(events), n):
            frame = pd.DataFrame(events[i : i + n], columns=["unit_key", "kind", "ts_ms"])
            for out in step.handleInputRows((7,), iter([frame]), Clock(1000 + i)):
                rows += list(out.itertuples(index=False))
        assert len(step.handle.timers) <= 1 and len(counted) <= 8 * 6
        for u in units:
            mine = [r for r in rows if r.unit_key == u or (u is None and pd.isna(r.unit_key))]
            assert newest(mine, 10**6) == plain_wait([e[1:] for e in events if e[0] == u], 50, 10**6)
        # The timer ends the open waits that are due first, each once, until none is open.
        fired = []
        while step.handle.timers:
            at = step.handle.timers.pop()
            fired += [(r.unit_key, r.outcome) for f in step.handleExpiredTimer((7,), Clock(at), Clock(at)) for r in f.itertuples(index=False)]
        last = {u: max((ts, kind == "media") for v, kind, ts in events if v == u) for u in units}
        assert sorted(map(str, (u for u, _ in fired))) == sorted(str(u) for u, (_, media) in last.items() if not media)
        assert all(o == wt.WITHOUT for _, o in fired)


def test_bounded_wait_writes_each_event_a_bounded_number_of_times():
    """In time order a text is written twice at most, media once, whatever the number of micro-batches."""
    rng = random.Random(2)
    events = sorted(((rng.choice(("text", "media")), t) for t in rng.sample(range(20_000), 600)), key=lambda e: e[1])
    rows, _ = waited([events[i : i + 2] for i in range(0, 600, 2)])
    written = {}
    for r in rows:
        written.setdefault((r.event_ms, r.is_text), []).append(r.outcome)
    assert len(rows) < 1200 and all(len(v) <= (2 if is_text else 1) for (_, is_text), v in written.items())


def test_open_wait_has_one_timer():
    rows, step = waited([[("text", 100)], [("text", 120)]], now=1000)
    assert [(r.event_ms, r.outcome) for r in rows] == [(100, wt.WAITING), (100, None), (120, wt.WAITING)]
    (at,) = step.handle.timers
    out = [r for f in step.handleExpiredTimer(("u",), Clock(at), Clock(at)) for r in f.itertuples(index=False)]
    assert [(r.event_ms, r.at_ms, r.outcome) for r in out] == [(120, 170, wt.WITHOUT)]
    assert [r for f in step.handleExpiredTimer(("u",), Clock(at), Clock(at)) for r in f.itertuples(index=False)] == []
    # Media that was in time but came late takes that back.
    import pandas as pd

    late = pd.concat(list(step.handleInputRows(("u",), iter([pd.DataFrame({"kind": ["media"], "ts_ms": [150]})]), Clock(2000))))
    assert [(r.event_ms, r.outcome) for r in late.itertuples()] == [(120, None), (150, wt.WITH)]


def test_wait_ends_by_itself_and_state_by_its_ttl(spark, tmp_path):
    """A live stream: no event follows, the timer ends the wait; after the time to live the text is forgotten."""
    import time

    def put(name, *rows):
        spark.createDataFrame(rows, WAIT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def rows():
        return sorted((r.unit_key, r.outcome) for r in spark.read.schema(wt.OUT).parquet(f"{tmp_path}/out").collect() if r.outcome != wt.WAITING)

    def until(done, seconds=60):
        end = time.time() + seconds
        while time.time() < end and not done():
            time.sleep(0.3)
        assert done(), rows()

    put("a", ("u", "text", 1000), ("v", "text", 1000), ("v", "media", 1100))
    stream = sj.read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], WAIT_SCHEMA).schema, 1)
    with wt.keyed_state(spark, live=True):
        query = (
            wt.stream_late_media(stream, MediaPolicy(ocr_wait_ms=400), keep_ms=6000)
            .writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start(f"{tmp_path}/out", format="parquet")
        )
    try:
        until(lambda: rows() == [("u", wt.WITHOUT), ("v", wt.WITH)])
        time.sleep(8)
        put("b", ("u", "media", 5000), ("w", "media", 5000), ("x", "text", 5000))
        until(lambda: ("x", wt.WITHOUT) in rows())
        assert rows() == [("u", wt.WITHOUT), ("v", wt.WITH), ("x", wt.WITHOUT)]
    finally:
        query.stop()
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_large_lexicons_stream(spark, tmp_path):
    from modwarden.operators import lexicon as lx

    rows = [(1, "you badword"), (2, "nothing here"), (3, None), (4, "BADWORD z")]
    terms = [("badword", "token", "en", 5, "block"), ("z", "token", "en", 3, "flag")] + [(f"filler{i}", "token", "en", 3, "flag") for i in range(1100)]
    lexicon = spark.createDataFrame(terms, lx.LEXICON_SCHEMA)
    got = []
    for i, limit in enumerate((2000, lx.INLINE_LIMIT)):
        stream = files(spark, rows, "id int, text string", str(tmp_path / str(i)), 4)
        out = sj.stream_lexicon_verdicts(stream, "id", "text", lexicon, ["id", "size(hits) AS n", "lexicon_action"], "t", limit)
        got.append(sorted(map(tuple, out.collect())))
    assert got[0] == got[1] == [(1, 1, "block"), (2, 0, "none"), (3, 0, "none"), (4, 2, "block")]


def test_returning_keys_and_images_no_longer_shown(spark):
    slots = spark.createDataFrame([("s", 1, "a", "first"), ("s", 2, "b", "recycled")], "slot string, seq long, unit_key string, outcome string")
    store = spark.createDataFrame([("a", "block")], "unit_key string, action string")
    assert {r.unit_key: r.shown for r in sj.stored_verdicts(slots, store).collect()} == {"a": "block", "b": "pending"}
    updates = spark.createDataFrame(
        [("k", "image", "i1", 1, "block", 0), ("k", "image", "i2", 2, "flag", 0), ("k", "text", "", 3, "flag", 1)],
        "key string, source string, image_key string, seen long, action string, batch_id long",
    )
    shown = spark.createDataFrame([("k", "i2")], "key string, image_key string")
    assert tuple(sj.latest_verdicts(updates, "key").first()) == ("k", "block", 3, 1)
    assert tuple(sj.latest_verdicts(updates, "key", shown=shown).first()) == ("k", "flag", 2, 0)


def test_recycled_slots(spark, tmp_path):
    rows = [("s", i, k) for i, k in enumerate(["x", "x", "y", "x", "x", "z"])]
    out = sj.run_to_table(ky.stream_recycled_units(files(spark, rows, "slot string, seq long, unit_key string", str(tmp_path), 3)), "t", timers=True)
    assert [r.outcome for r in out.orderBy("seq").collect()] == ["first", "same", "recycled", "recycled", "same", "recycled"]


def test_dedupe_passes_changed_media(spark, tmp_path):
    rows = [("a", "f1", 1), ("a", "f1", 2), ("a", "f2", 3), ("b", "f1", 4), ("a", "f1", 5)]
    stream = files(spark, rows, "unit_key string, media_fp string, s long", str(tmp_path), 5)
    out = sj.run_to_table(sj.stream_dedupe(stream.withColumn("at", F.timestamp_seconds("s")), "at", ["unit_key", "media_fp"]), "t")
    assert sorted((r.unit_key, r.media_fp) for r in out.collect()) == [("a", "f1"), ("a", "f2"), ("b", "f1")]


def test_upsert_and_stats_over_batches(spark, tmp_path):
    rows = [(f"k{i % 3}", i, ("clean", "flag", "block")[i % 4 % 3]) for i in range(40)]
    schema = "key string, seq long, action string"
    stream = files(spark, rows, schema, str(tmp_path / "in"))
    got = {r.key: r.seq for r in sj.stream_upsert(stream, str(tmp_path / "out"), ["seq"]).collect()}
    assert got == {"k0": 39, "k1": 37, "k2": 38}
    counts = sj.run_to_table(sj.stream_stats(stream, "action"), "t", "complete")
    last = {r.action: r["count"] for r in counts.groupBy("action").agg(F.max_by("count", "batch_id").alias("count")).collect()}
    assert last == {"clean": 20, "flag": 10, "block": 10}


def test_settings_change_asks_for_rescan(spark, tmp_path):
    rows = [("a", "all", "1:1:1"), ("b", "all", "1:0:1")]
    stream = files(spark, rows, "key string, scope string, settings_policy string", str(tmp_path), 1)
    settings = spark.createDataFrame([("all", "1:0:1")], "scope string, settings_policy string")
    out = sj.run_to_table(sj.with_settings(stream, settings).select("key", "rescan"), "t")
    assert {r.key: r.rescan for r in out.collect()} == {"a": True, "b": False}


def cut(rows, rng):
    import pandas as pd

    at = sorted(rng.sample(range(1, len(rows)), 6))
    return [pd.DataFrame(rows[a:b], columns=[f.split()[0] for f in SCHEMA.split(", ")]) for a, b in zip([0, *at], [*at, len(rows)], strict=True)]


def test_lifecycle_steps_equal_the_rule_for_any_chunks():
    """Shuffled chunks of a few rows in memory, the rest through the state list."""
    rng = random.Random(12)
    for trial in range(60):
        rows = [("u", i, rng.choice(("request", "image", "ocr", "image-failed", "ocr-failed")), rng.choice(("f1", "f2", None)), rng.choice(("clean", "flag", "block")))
                for i in range(60)]
        batches, got = (rows[:25], rows[25:]), []
        step = ky.MediaLifecycle(MediaPolicy(), most=rng.choice((5, 1000)))
        step.init(Handle())
        for batch in batches:
            for out in step.handleInputRows(("u",), iter(cut(rng.sample(batch, len(batch)), rng)), None):
                got += [(r.unit_key, r.seq, r.outcome, r.action) for r in out.itertuples()]
        assert [g[1] for g in got] == list(range(60))
        assert got == lifecycle([(k, s, kind, "none" if fp is None else fp, a) for k, s, kind, fp, a in rows]), trial


def test_hot_key_keeps_bounded_memory(monkeypatch):
    """A million rows of one key in chunks: few are held at any time, and they come in order."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(ky, "ENTRY", 5_000)
    order = np.random.default_rng(0).permutation(1_000_000)
    order[::3] = 500_000  # a third of the rows at one place
    spill, largest = Listed(), 0
    chunks = (pd.DataFrame({"seq": order[a : a + 10_000]}) for a in range(0, len(order), 10_000))
    seen = []
    for part in ky.in_order(chunks, "seq", spill, most=50_000):
        largest = max(largest, len(part))
        seen.append(part["seq"].to_numpy())
    assert (np.concatenate(seen) == np.sort(order)).all() and largest < 100_000 and not spill.rows


def test_cut_streams_have_more_files_for_more_splits(spark, tmp_path, monkeypatch):
    from modwarden.plans import stream_queries as sq

    monkeypatch.setattr(sq, "shared_dir", lambda _, purpose: f"{tmp_path}/{purpose}-{len(list(tmp_path.iterdir()))}")
    monkeypatch.setattr(sq.rd, "read_table", lambda s, d, n: s.read.option("mergeSchema", "false").parquet(f"{d}/{n}.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    seen = set()
    for splits, files in ((1, 4), (11, 12)):
        spark.range(5000).repartition(splits).write.mode("overwrite").parquet(f"{tmp_path}/t{splits}/n.parquet")
        stream = sq.cut_stream(spark, f"{tmp_path}/t{splits}", "n", 4, "id")
        (cut,) = set(tmp_path.glob("cut-n-*")) - seen
        seen.add(cut)
        assert len(list(cut.glob("part-*"))) == files
        out = sj.run_to_table(stream, "cut-test", per_batch=lambda b: b)
        assert sorted(r.id for r in out.select("id").collect()) == list(range(5000))
        assert out.select("batch_id").distinct().count() == 4
    spark.conf.unset("spark.sql.files.openCostInBytes")
