import hashlib
import json

import pytest
from pyspark.sql import functions as F

from modwarden.functions import identity as idn
from modwarden.operators import store as st
from modwarden.sources import readers as rd
from modwarden.sources import sinks as sk


def log(spark):
    reason = [("text", "block")]
    rows = [("a", 300, 1, "block", reason), ("b", 100, 2, "flag", [("image", "flag")]), ("c", 200, 3, "clean", []), ("d", 400, 4, "clean", [])]
    return spark.createDataFrame(rows, "key string, ts long, seq long, action string, reasons array<struct<source:string,action:string>>")


def test_recent_and_stats(spark):
    df = log(spark)
    assert [r.key for r in st.recent_verdicts(df, 3).collect()] == ["d", "a", "c"]
    assert tuple(st.session_stats(df).first()) == (1, 1, 2, 4)
    assert sorted(map(tuple, st.stats_by_source(df).collect())) == [("image", "flag", 1), ("text", "block", 1)]


def test_store_upserts_replays_and_compacts(spark, tmp_path):
    store = sk.VerdictStore(spark, str(tmp_path / "s"))
    rows = log(spark).drop("reasons")
    newer = rows.filter("key = 'a'").withColumn("ts", F.lit(900).cast("long")).withColumn("action", F.lit("clean"))
    older = rows.filter("key = 'a'").withColumn("ts", F.lit(1).cast("long"))
    store.upsert(rows, "w-0")
    store.upsert(newer, "w-1")
    store.upsert(newer, "w-1")
    store.compact()
    store.upsert(older, "w-2")
    got = {r.key: (r.ts, r.action) for r in store.read().collect()}
    assert got["a"] == (900, "clean") and len(got) == 4 and store.log().count() == 5
    store.compact()
    assert store.log().count() == 4
    for name in (0, "7", "base-x"):
        with pytest.raises(ValueError, match="name a batch"):
            store.upsert(rows, name)


def test_a_batch_written_during_compaction_stays(spark, tmp_path):
    store = sk.VerdictStore(spark, str(tmp_path / "s"), "key", ["ts"])
    store.upsert(spark.createDataFrame([("a", 1)], "key string, ts long"), "w-0")
    names = store._live()
    store.upsert(spark.createDataFrame([("b", 2)], "key string, ts long"), "w-1")
    store._live, live = (lambda: names), store._live
    store.compact()
    store._live = live
    assert sorted(r.key for r in store.read().collect()) == ["a", "b"]


def test_two_streams_share_a_store(spark, tmp_path):
    """Batch numbers of two jobs, or of a job that starts afresh, never overwrite each other."""
    from modwarden.streaming import jobs as sj

    for i, key in enumerate(("k1", "k2")):
        spark.createDataFrame([(key, i)], "key string, seq long").write.parquet(str(tmp_path / f"in{i}"))
        stream = sj.read_stream(spark, str(tmp_path / f"in{i}"), "key string, seq long")
        store = sk.VerdictStore(spark, str(tmp_path / "out/store"), "key", ["seq"])
        writer = store.writer(str(tmp_path / f"state{i}"))
        assert writer == store.writer(str(tmp_path / f"state{i}"))
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / f"state{i}")).trigger(availableNow=True).foreachBatch(
            lambda batch, n, writer=writer: store.upsert(batch, f"{writer}-{n}")
        ).start()
        query.awaitTermination()
    assert sorted(r.key for r in store.read().collect()) == ["k1", "k2"]


def test_no_shared_folder_on_a_cluster():
    from modwarden.session import shared_dir

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Cluster, "x")
    Cluster.conf.get = staticmethod(lambda key, default=None: {"spark.checkpoint.dir": "hdfs:///shared/"}.get(key, default))
    assert shared_dir(Cluster, "x").startswith("hdfs:///shared/x-")


def test_cache_needs_both_policies(spark):
    stored = spark.createDataFrame([("a", "v2", "1:1:1", "block"), ("b", "v1", "1:1:1", "flag")], "key string, pv string, sp string, action string")
    req = spark.createDataFrame([("a", "v2", "1:1:1"), ("a", "v2", "1:0:1"), ("b", "v2", "1:1:1")], "key string, pv string, sp string")
    keys = ["key", "pv", "sp"]
    assert [r.action for r in st.cache_lookup(req, stored, keys, ["action"]).orderBy(*keys).collect()] == [None, "block", None]
    assert st.cache_misses(req, stored, keys).count() == 2


def test_admission(spark):
    rows = [(1, "a", 1, 0), (1, "b", 5, 1), (1, "a", 9, 2), (1, "c", 5, 3), (2, "z", 0, 0)]
    df = spark.createDataFrame(rows, "cycle int, key string, p int, at int")
    out = {(r.cycle, r.key): (r.admitted, r.priority, r.requests) for r in st.admit(df, "cycle", "key", "p", "at", 2).collect()}
    assert out == {(1, "a"): (True, 9, 2), (1, "b"): (True, 5, 1), (1, "c"): (False, 5, 1), (2, "z"): (True, 0, 1)}


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label,lang\n"multi\nline, ""q""",1,en\n,0,en\nplain,,fr\nok,0,fr\n', encoding="utf-8")
    out = rd.read_labelled_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in out] == [('multi\nline, "q"', 1, "en"), ("ok", 0, "fr")]


def test_severity_lexicon(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes(" BadWord ,x,5\ncaf\xe9,y,2\nmildy,z,1\nnone,z,n/a\nbadword,x,4\n,x,3\nboth,x,4\nboth,x,2x\n".encode("latin1"))
    out = sorted((r.term, r.tier) for r in rd.read_severity_lexicon(spark, str(tmp_path / "l.csv")).collect())
    assert out == [("badword", "block"), ("both", "block"), ("both", "flag"), ("café", "flag"), ("mildy", "mild")]


def test_thread_corpus(spark, tmp_path):
    def thread(archive, split, topic, name, data, labels):
        p = tmp_path / archive / "data" / split / topic / name
        p.mkdir(parents=True)
        (p / "data.json").write_text(data if isinstance(data, str) else json.dumps(data))
        if labels is not None:
            (p / "labels.json").write_text(json.dumps(labels))

    first = {"tweet_id": 1, "tweet": "root", "comments": [{"tweet_id": "2", "tweet": "c2"}, {"tweet_id": "3", "tweet": "c3"}]}
    thread("x", "train", "t1", "a", first, {"1": "HOF", "2": "NONE"})
    thread("x", "train", "t2", "b", {"tweet_id": "2", "tweet": "again", "comments": []}, {"2": "HOF"})
    thread("x", "train", "t2", "c", "{broken", {"9": "HOF"})
    thread("x", "train", "t2", "d", {"tweet_id": "7", "tweet": "no labels"}, None)
    out = sorted(tuple(r) for r in rd.read_thread_corpus(spark, str(tmp_path)).collect())
    assert out == [("1", "root", 1, "t1", "train"), ("2", "c2", 0, "t1", "train")]


def test_eval_set_in_ranges(spark, tmp_path):
    rows = spark.range(1000, 3050).select(F.col("id"), F.concat(F.lit("t\n"), "id").alias("text"), (F.col("id") % 2).alias("label"))
    path = str(tmp_path / "e")
    sk.write_eval_set(rows.orderBy(F.rand(1)), path, "id", per_record=100)
    assert spark.read.text(path).count() == 21
    back = rd.read_eval_set(spark, path, multi_line=False)
    assert sorted(map(tuple, back.collect())) == [(i, f"t\n{1000 + i}", i % 2) for i in range(2050)]
    sk.write_eval_set(rows.limit(0), str(tmp_path / "none"), "id")
    assert rd.read_eval_set(spark, str(tmp_path / "none"), multi_line=False).count() == 0


def test_eval_set(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"note": "x", "sentences": [{"text": "a", "label": 1}, {"text": "b", "label": 0}]}))
    assert [tuple(r) for r in rd.read_eval_set(spark, str(tmp_path / "e.json")).collect()] == [(0, "a", 1), (1, "b", 0)]


def test_images(spark, tmp_path):
    heads = {"a": b"\x89PNG\r\n", "b": b"\xff\xd8\xff\xe0", "c": b"GIF89a", "d": b"BM..", "e": b"RIFF\0\0\0\0WEBP", "f": b"<html>"}
    for n, h in heads.items():
        (tmp_path / n).write_bytes(h)
    out = {r.path[-1]: (r.format, r.reason) for r in rd.read_images_validated(spark, str(tmp_path)).collect()}
    assert [out[k][0] for k in "abcde"] == ["png", "jpeg", "gif", "bmp", "webp"]
    assert out["f"][1] == "unrecognised-image-bytes"
    blobs = [(bytearray(b"GIF8"), 11 << 20, None), (bytearray(b"GIF8"), 4, "text/html"), (bytearray(), 0, None)]
    df = spark.createDataFrame(blobs, "c binary, n long, m string")
    reasons = [r.v.reason for r in df.select(rd.validate_image("c", "n", F.col("m")).alias("v")).collect()]
    assert reasons == ["too-large (11534336 > 10485760)", "non-image MIME: text/html", "empty-blob (0 bytes)"]


def test_feedback_export(spark, tmp_path):
    rows = [(1, "k", "block", None, "generic", 'he said "x"'), (2, "k", "flag", "clean", "x", None)]
    df = spark.createDataFrame(rows, "ts long, key string, verdictAction string, expectedAction string, siteId string, comment string")
    sk.append_feedback(df, str(tmp_path / "log"))
    sk.append_feedback(df.filter("ts = 2"), str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 3
    sk.export_feedback_csv(df.coalesce(1), str(tmp_path / "csv"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert lines[1:] == ['"1","k","block","","generic","he said ""x"""', '"2","k","flag","clean","x",""']
    sk.export_feedback_json(df, str(tmp_path / "json"))
    assert '"comment":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "json")).collect())


def test_write_splits_csv(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 1, "train"), ("c", 0, "val")], "text string, label int, split string")
    sk.write_splits(df, str(tmp_path / "o"), ["text", "label"], fmt="csv")
    assert [tuple(r) for r in rd.read_labelled_csv(spark, str(tmp_path / "o" / "split=train"), "text string, label int").collect()] == [("a\nb", 1)]


def test_hosts_and_keys(spark):
    hosts = ["www.News.BBC.co.uk", "a.b.example.com", "localhost", "x.com", "m.x.com", "old.reddit.com", "notreddit.com"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string")
    rows = df.select("i", idn.host_key("h").alias("k"), idn.site_route("h").alias("s"), idn.is_core_host("h").alias("c")).orderBy("i").collect()
    assert [r.k for r in rows] == ["bbc.co.uk", "example.com", "localhost", "x.com", "x.com", "reddit.com", "notreddit.com"]
    assert [r.s for r in rows] == ["generic", "generic", "generic", "twitter", "twitter", "reddit", "generic"]
    assert [r.c for r in rows] == [False, False, False, True, True, True, True]


def test_fingerprints(spark):
    rows = [([("u1", None), ("u2", None)],), ([("u2", None), ("u1", None)],), ([("u1", "xx"), ("u2", None)],),
            ([("u1", None), ("u2", None), ("u3", None), ("u4", None)],), ([("u1", None), ("u2", None), ("u3", None)],)]
    df = spark.createDataFrame(rows, "i array<struct<url:string,data:string>>")
    keys = F.transform("i", lambda x: idn.source_key(x["url"], x["data"]))
    a, b, c, d, e = [r.f for r in df.select(idn.media_fingerprint(keys).alias("f")).collect()]
    assert a == b != c and len({a, c, d, e}) == 4
    d, e = [r.f for r in df.select(idn.media_fingerprint(keys, 3).alias("f")).collect()][3:]
    assert d == e


def test_gif_and_video(spark):
    df = spark.createDataFrame([("a.gif?x", 60.), ("data:image/gif;base64,x", 61.), ("a.gifv", float("inf")), (None, float("nan")), ("b.GIF", 0.)], "u string, d double")
    rows = df.select(idn.is_gif("u").alias("g"), idn.is_short_video("d").alias("v")).collect()
    assert [r.g for r in rows] == [True, True, False, False, True] and [r.v for r in rows] == [True, False, False, False, False]


def test_long_conversation_is_written_as_bounded_threads(spark, tmp_path, monkeypatch):
    from modwarden.plans import stream_queries as sq
    from modwarden.plans.registry import QUERIES

    monkeypatch.setattr(sq, "shared_dir", lambda spark, purpose: f"file://{tmp_path}/{purpose}")
    rows = [(7, t, f"text {t}") for t in range(2_501)] + [(8, 0, "short")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/in/conversations.parquet")
    out = {r.id: r.split for r in QUERIES["read_thread_corpus"](spark, f"{tmp_path}/in").collect()}
    digests = [hashlib.md5(f"{c}:{t}".encode()).hexdigest() for c, t, _ in rows]
    assert out.keys() == {x for x in digests if x[0] < "d"} and set(out.values()) == {"train"}
    sizes = sorted(1 + len(json.loads(p.read_text())["comments"]) for p in (tmp_path / "threads").rglob("data.json"))
    assert sizes == [1, 501, 1000, 1000]
