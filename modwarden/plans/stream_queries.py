"""Streaming, source, sink and learning queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modwarden.functions import scores as sc
from modwarden.functions import windows as wn
from modwarden.operators import corpus as cp
from modwarden.operators import epochs as ep
from modwarden.operators import evaluate as ev
from modwarden.operators import learning as ml
from modwarden.operators import lexicon as lx
from modwarden.operators import store as st
from modwarden.plans import sql as q
from modwarden.plans.corpus_queries import LABELLED, _SPLIT, _SWEEP, labelled, scored, split_rows
from modwarden.plans.registry import ORACLES, query
from modwarden.plans.store_queries import _LWW, shape_events, verdict_log
from modwarden.plans.text_queries import _WALK_ALL, documents, lexicon, short_terms
from modwarden.profiles import MediaPolicy
from modwarden.session import materialize, shared_dir
from modwarden.sources import readers as rd
from modwarden.sources import sinks as sk
from modwarden.streaming import jobs as sj
from modwarden.streaming import keyed as ky
from modwarden.streaming import waits as wt


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of files; the pattern takes a folder of parts and a single file alike."""
    root = f"{d.rstrip('/')}/{name}.parque"
    return sj.read_stream(spark, f"{root}[t]", spark.read.parquet(f"{root}t").schema)


def verdict_stream(spark, d):
    return shape_events(stream_of(spark, d, "events"))


@query("stream_lexicon_verdicts", f"{q.VERDICTS} SELECT doc_id, hits, lexicon_action FROM lex_verdicts")
def _(spark, d):
    units = stream_of(spark, d, "documents").select("doc_id", "text")
    return sj.stream_lexicon_verdicts(units, "doc_id", "text", lexicon(spark), _LEXICON_OUT, "stream-lexicon")


_LEXICON_OUT = ("doc_id", "CAST(size(hits) AS BIGINT) AS hits", "lexicon_action")


def cut_stream(spark, d, name, parts, order):
    """A table as a stream of ``parts`` micro-batches of files, dealt out by hash, so that no file follows the order of the rows.

    A batch has as many files as the table has input splits for it, so tasks do not grow with the table.
    """
    path = shared_dir(spark, f"cut-{name}")
    rows = rd.read_table(spark, d, name)
    files = -(-rows.rdd.getNumPartitions() // parts)
    rows.repartition(parts * files, F.xxhash64(order)).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("stream_lexicon_verdicts_large", ORACLES["lexicon_verdict_by_join"])
def _(spark, d):
    """More terms than a literal holds: every word of the pages' addresses is a mild term, which never matches."""
    mild = rd.read_table(spark, d, "pages").select(F.explode(F.split(F.lower("url"), "[^a-z0-9]+")).alias("term")).distinct()
    terms = short_terms(spark).unionByName(mild.select("term", F.lit("token").alias("kind"), F.lit("demo").alias("lang"), F.lit(1).alias("severity"), F.lit("mild").alias("tier")))
    units = cut_stream(spark, d, "documents", 4, "doc_id").select("doc_id", "text")
    return sj.stream_lexicon_verdicts(units, "doc_id", "text", terms, _LEXICON_OUT, "stream-lexicon", limit=10)


@query("stream_dedupe", f"WITH {q.EV} SELECT DISTINCT key, image_key FROM ev")
def _(spark, d):
    events = verdict_stream(spark, d).withColumn("at", F.timestamp_micros("ts_us"))
    out = sj.stream_dedupe(events.select("key", "image_key", "at"), "at", ["key", "image_key"], "60 days")
    return sj.run_to_table(out, "stream-dedupe").select("key", "image_key")


@query(
    "stream_verdict_state",
    f"""WITH {q.EV}, per AS (SELECT key, source, image_key, max({q.rank_of('action')}) AS r FROM ev WHERE action <> 'clean' GROUP BY key, source, image_key)
    SELECT key, {q.name_of('max(r)')} AS action, count(*) AS reasons, count(*) FILTER (r = 2) AS block_reasons FROM per GROUP BY key""",
)
def _(spark, d):
    return sj.latest_verdicts(verdict_updates(shape_events(cut_stream(spark, d, "events", 3, "event_id"))), "key")


def verdict_updates(findings):
    return sj.run_to_table(sj.stream_verdict_state(findings, "key", "seq"), "stream-state", "update")


@query(
    "stream_verdict_reconciled",
    f"""WITH {q.EV}, shown AS (SELECT DISTINCT key, image_key FROM ev WHERE k >= 50),
    per AS (SELECT key, source, image_key, max({q.rank_of('action')}) AS r FROM ev WHERE action <> 'clean' GROUP BY key, source, image_key),
    held AS (SELECT per.* FROM per LEFT JOIN shown s ON s.key = per.key AND s.image_key = per.image_key WHERE source NOT IN ('image', 'ocr-text', 'lexicon-ocr') OR s.key IS NOT NULL)
    SELECT key, {q.name_of('max(r)')} AS action, count(*) AS reasons, count(*) FILTER (r = 2) AS block_reasons FROM held GROUP BY key""",
)
def _(spark, d):
    """Findings on images that a unit no longer shows do not count."""
    shown = verdict_log(spark, d).filter("k >= 50").select("key", "image_key")
    return sj.latest_verdicts(verdict_updates(verdict_stream(spark, d)), "key", shown=shown)


_KIND = """CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'image' WHEN 'purchase' THEN 'ocr' WHEN 'error' THEN 'image-failed' ELSE 'ocr-failed' END"""


@query(
    "stream_media_lifecycle",
    f"""WITH {q.EV}, m AS (SELECT key AS unit_key, seq, {_KIND} AS kind, 'f' || (k // 50) || '|' || settings_policy AS fp, action FROM ev),
    p AS (SELECT *, last_value(CASE WHEN kind = 'request' THEN fp END IGNORE NULLS) OVER (PARTITION BY unit_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM m),
    o AS (SELECT *, kind = 'request' AND fp IS DISTINCT FROM cur AS accepted, kind <> 'request' AND fp IS DISTINCT FROM cur AS stale FROM p),
    g AS (SELECT *, count(*) FILTER (accepted) OVER (PARTITION BY unit_key ORDER BY seq) AS gen,
      max(CASE WHEN kind IN ('image', 'ocr') AND NOT stale THEN {q.rank_of('action')} ELSE 0 END) OVER (PARTITION BY unit_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_r FROM o),
    a AS (SELECT *, count(*) FILTER (kind LIKE '%-failed' AND NOT stale) OVER (PARTITION BY unit_key, gen, kind ORDER BY seq) AS n FROM g)
    SELECT unit_key, seq, kind, CASE WHEN kind = 'request' THEN CASE WHEN accepted THEN 'accepted' ELSE 'duplicate' END WHEN stale THEN 'stale'
      WHEN kind = 'image-failed' THEN CASE WHEN n <= 2 THEN 'retry' ELSE 'given-up' END WHEN kind = 'ocr-failed' THEN CASE WHEN n <= 1 THEN 'retry' ELSE 'given-up' END
      WHEN {q.rank_of('action')} > coalesce(before_r, 0) THEN 'upgrade' ELSE 'kept' END AS outcome,
      CAST(CASE WHEN kind LIKE '%-failed' AND NOT stale THEN n ELSE 0 END AS BIGINT) AS attempt FROM a""",
)
def _(spark, d):
    e = verdict_stream(spark, d)
    t = F.col("event_type")
    kind = (
        F.when(t == "view", "request").when(t == "click", "image").when(t == "purchase", "ocr")
        .when(t == "error", "image-failed").otherwise("ocr-failed")
    )
    fp = F.concat(F.lit("f"), F.floor(F.col("k") / 50).cast("string"))
    media = e.select(F.col("key").alias("unit_key"), "seq", kind.alias("kind"), ky.media_identity(fp, F.col("settings_policy")).alias("fp"), "action")
    out = sj.run_to_table(ky.stream_media_lifecycle(media), "stream-media", timers=True)
    return out.select("unit_key", "seq", "kind", "outcome", F.col("attempt").cast("long").alias("attempt"))


# A text and its media stand closer together here than the events do: the wait is six hours.
_WAIT = 6 * 3600 * 1000


_LATE = (
    f"""WITH {q.EV}, m AS (SELECT key AS unit_key, ts_us // 1000 AS ts_ms, CASE WHEN event_type IN ('view', 'click') THEN 'text' ELSE 'media' END AS kind FROM ev),
    t AS (SELECT *, count(*) FILTER (kind = 'text') OVER (PARTITION BY unit_key ORDER BY ts_ms) AS g FROM m),
    x AS (SELECT unit_key, g, min(ts_ms) AS t0, lead(min(ts_ms)) OVER (PARTITION BY unit_key ORDER BY g) AS next_text FROM t WHERE kind = 'text' GROUP BY unit_key, g),
    f AS (SELECT x.*, (SELECT min(ts_ms) FROM t WHERE t.unit_key = x.unit_key AND t.g = x.g AND t.kind = 'media') AS first_media, (SELECT max(ts_ms) FROM m) AS wm FROM x),
    pub AS (SELECT unit_key, t0 + {_WAIT} AS at_ms, 'published-without-media' AS outcome FROM f WHERE coalesce(first_media, t0 + {_WAIT} + 1) > t0 + {_WAIT} AND (first_media IS NOT NULL OR next_text > t0 + {_WAIT} OR (next_text IS NULL AND wm > t0 + {_WAIT}))),
    med AS (SELECT t.unit_key, t.ts_ms AS at_ms, CASE WHEN t.ts_ms = f.first_media AND t.ts_ms <= t0 + {_WAIT} THEN 'published-with-media' ELSE 'late-upgrade' END AS outcome FROM t JOIN f USING (unit_key, g) WHERE t.kind = 'media')
    SELECT * FROM pub UNION ALL SELECT * FROM med"""
)


def late_media(e):
    kind = F.when(F.col("event_type").isin("view", "click"), "text").otherwise("media")
    media = e.select(F.col("key").alias("unit_key"), F.floor(F.col("ts_us") / 1000).alias("ts_ms"), kind.alias("kind"))
    return wt.settled_media(sj.run_to_table(wt.stream_late_media(media, MediaPolicy(ocr_wait_ms=_WAIT)), "stream-late", timers=True))


@query("stream_late_media", _LATE)
def _(spark, d):
    return late_media(verdict_stream(spark, d))


@query("stream_late_media_many_batches", _LATE)
def _(spark, d):
    return late_media(shape_events(cut_stream(spark, d, "events", 8, "event_id")))


@query("stream_upsert", f"WITH {_LWW} SELECT key, seq, action FROM cur")
def _(spark, d):
    rows = verdict_stream(spark, d).filter("policy_version = 'v2'").select("key", "ts_us", "seq", "action")
    return sj.stream_upsert(rows, shared_dir(spark, "stream-upsert"), ["ts_us", "seq"]).select("key", "seq", "action")


@query("stream_stats", f"WITH {q.EV} SELECT action, source, count(*) AS n FROM ev GROUP BY action, source")
def _(spark, d):
    out = sj.run_to_table(sj.stream_stats(verdict_stream(spark, d), "action", "source"), "stream-stats", "complete")
    return out.groupBy("action", "source").agg(F.max_by("count", "batch_id").alias("n"))


@query(
    "stream_recycled_units",
    f"""WITH {q.EV}, l AS (SELECT key AS slot, seq, image_key AS unit_key, lag(image_key) OVER (PARTITION BY key ORDER BY seq) AS prev FROM ev)
    SELECT slot, seq, unit_key, CASE WHEN prev IS NULL THEN 'first' WHEN prev = unit_key THEN 'same' ELSE 'recycled' END AS outcome FROM l""",
)
def _(spark, d):
    e = verdict_stream(spark, d).select(F.col("key").alias("slot"), "seq", F.col("image_key").alias("unit_key"))
    return sj.run_to_table(ky.stream_recycled_units(e), "stream-recycled", timers=True)


@query(
    "stream_recycled_verdicts",
    f"""WITH {q.EV}, v AS (SELECT image_key, arg_max(action, seq) AS action FROM ev WHERE action <> 'clean' GROUP BY image_key),
    l AS (SELECT key AS slot, seq, image_key AS unit_key, lag(image_key) OVER (PARTITION BY key ORDER BY seq) AS prev FROM ev)
    SELECT slot, seq, unit_key, coalesce(v.action, 'pending') AS shown FROM l LEFT JOIN v ON v.image_key = unit_key WHERE prev IS DISTINCT FROM unit_key""",
)
def _(spark, d):
    """A key that comes back to a slot takes its stored verdict at once; only findings are stored, so clean keys wait."""
    e = verdict_stream(spark, d).select(F.col("key").alias("slot"), "seq", F.col("image_key").alias("unit_key"))
    moved = sj.run_to_table(ky.stream_recycled_units(e), "stream-recycled", timers=True).filter("outcome <> 'same'")
    store = st.last_write_wins(verdict_log(spark, d).filter("action <> 'clean'").select(F.col("image_key").alias("unit_key"), "seq", "action"), "unit_key", ["seq"])
    return sj.stored_verdicts(moved, store).select("slot", "seq", "unit_key", "shown")


@query(
    "stream_settings_change",
    f"""WITH {q.EV}, now AS (SELECT event_type AS scope, arg_max(settings_policy, seq) AS current_policy FROM ev GROUP BY event_type)
    SELECT seq, settings_policy IS DISTINCT FROM current_policy AS rescan FROM ev JOIN now ON scope = event_type""",
)
def _(spark, d):
    settings = verdict_log(spark, d).groupBy(F.col("event_type").alias("scope")).agg(
        F.max_by("settings_policy", "seq").alias("settings_policy")
    )
    e = verdict_stream(spark, d).select("seq", F.col("event_type").alias("scope"), "settings_policy")
    return sj.run_to_table(sj.with_settings(e, settings).select("seq", "rescan"), "stream-settings")


@query(
    "late_media_batch",
    f"""WITH {q.EV}, t AS (SELECT key, min(ts_us // 1000) AS ts_ms FROM ev WHERE event_type = 'view' GROUP BY key), m AS (SELECT key, min(ts_us // 1000) AS media_ms FROM ev WHERE event_type = 'purchase' GROUP BY key)
    SELECT t.key, CASE WHEN media_ms - ts_ms <= {_WAIT} THEN 'published-with-media' WHEN media_ms - ts_ms > {_WAIT} THEN 'late-upgrade' ELSE 'published-without-media' END AS outcome FROM t LEFT JOIN m USING (key)""",
)
def _(spark, d):
    log = verdict_log(spark, d).select("key", "event_type", F.floor(F.col("ts_us") / 1000).alias("ts_ms"))
    texts = log.filter("event_type = 'view'").groupBy("key").agg(F.min("ts_ms").alias("ts_ms"))
    return sj.late_media_batch(texts, log.filter("event_type = 'purchase'"), "key", _WAIT).select("key", "outcome")


# ------------------------------------------------------------------------------ sources and sinks


@query("read_labelled_csv", f"WITH {LABELLED} SELECT md5(text) AS text_md5, label, lang FROM labelled WHERE label IS NOT NULL")
def _(spark, d):
    path = shared_dir(spark, "labelled-csv")
    docs = documents(spark, d, "doc_id", "text", "lang").join(
        rd.read_table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id", "left"
    )
    docs.select("text", "label", "lang").write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    return rd.read_labelled_csv(spark, path).select(F.md5("text").alias("text_md5"), "label", "lang")


@query(
    "read_severity_lexicon",
    """WITH w AS (SELECT DISTINCT unnest(string_split(lower(source || ' ' || lang), ' ')) AS term FROM documents),
    s AS (SELECT term, CASE WHEN length(term) % 4 = 0 THEN NULL ELSE ascii(substr(term, -1, 1)) % 7 END AS severity FROM w)
    SELECT term, severity, CASE WHEN severity >= 4 THEN 'block' WHEN severity >= 2 THEN 'flag' ELSE 'mild' END AS tier FROM s WHERE severity IS NOT NULL""",
)
def _(spark, d):
    path = shared_dir(spark, "severity-csv")
    words = rd.read_table(spark, d, "documents").select(
        F.explode(F.split(F.lower(F.concat_ws(" ", "source", "lang")), " ")).alias("w")
    ).distinct()
    sev = F.when(F.length("w") % 4 == 0, "unknown").otherwise((F.ascii(F.substring("w", -1, 1)) % 7).cast("string"))
    words.select(F.concat(F.lit(" "), F.upper("w")).alias("t"), F.lit("gloss"), sev).write.csv(
        path, encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False
    )
    return rd.read_severity_lexicon(spark, path).select("term", "severity", "tier")


@query(
    "attach_thread_labels",
    """WITH p AS (SELECT conv_id, turn, md5(text) AS id, text FROM conversations),
    k AS (SELECT *, CASE WHEN substr(id, 1, 1) < '6' THEN 'HOF' WHEN substr(id, 1, 1) < 'd' THEN 'NONE' END AS mark, row_number() OVER (PARTITION BY id ORDER BY conv_id, turn) AS rn FROM p)
    SELECT id, conv_id, turn, CASE WHEN mark = 'HOF' THEN 1 ELSE 0 END AS label FROM k WHERE mark IS NOT NULL AND rn = 1""",
)
def _(spark, d):
    posts = rd.read_table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("id"))
    first = F.substring("id", 1, 1)
    labels = posts.select("id", F.when(first < "6", "HOF").when(first < "d", "NONE").alias("mark")).filter(
        "mark is not null"
    ).distinct()
    return rd.attach_thread_labels(posts, labels, [], ["conv_id", "turn"]).select("id", "conv_id", "turn", "label")


@query(
    "write_splits",
    f"WITH {LABELLED}, {_SPLIT.format(src='labelled')} SELECT split, label, count(*) AS rows FROM split GROUP BY split, label",
)
def _(spark, d):
    path = shared_dir(spark, "splits")
    sk.write_splits(split_rows(spark, d), path, ["doc_id", "label"])
    return spark.read.parquet(path).groupBy("split", "label").agg(F.count("*").alias("rows"))


_HEADS = ("89504E470D0A1A0A", "FFD8FFE0", "4749463839", "424D", "524946460000000057454250", "3C68746D6C", "")


@query(
    "validate_images",
    f"""WITH {q.EV}, v AS (SELECT k % 7 AS h FROM ev) SELECT CASE h WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' WHEN 4 THEN 'webp' END AS format,
    CASE h WHEN 5 THEN 'unrecognised-image-bytes' WHEN 6 THEN 'empty-blob (0 bytes)' END AS reason, count(*) AS n FROM v GROUP BY 1, 2""",
)
def _(spark, d):
    head = F.lit(None).cast("string")
    for i, h in enumerate(_HEADS):
        head = F.when(F.col("k") % 7 == i, h).otherwise(head)
    body = F.when(F.col("k") % 7 == 6, "").otherwise(F.concat(head, F.md5(F.col("seq").cast("string"))))
    blobs = verdict_log(spark, d).select(F.unhex(body).alias("content"))
    out = blobs.select(rd.validate_image("content", F.length("content")).alias("v"))
    return out.groupBy(F.col("v.format").alias("format"), F.col("v.reason").alias("reason")).agg(F.count("*").alias("n"))


@query("write_verdicts", f"WITH {_LWW} SELECT key, seq, action, policy_version FROM cur")
def _(spark, d):
    store = sk.VerdictStore(spark, shared_dir(spark, "verdict-store"), "key", ["ts", "seq"])
    log = verdict_log(spark, d).filter("policy_version = 'v2'").select("key", "seq", "action", F.col("ts_us").alias("ts"))
    rows = sk.stamp(log, "v2", F.col("ts"))
    # Two writes, out of order: the later rows first.
    store.upsert(rows.filter("seq % 2 = 1"))
    store.compact()
    store.upsert(rows.filter("seq % 2 = 0"))
    return store.read().select("key", "seq", "action", "policy_version")


@query(
    "export_feedback",
    f"""WITH {q.EV}, f AS (SELECT ts_us, key, action, CASE WHEN k % 3 = 0 THEN NULL ELSE 'clean' END AS expected, event_type, 'said "no", k=' || k AS comment FROM ev)
    SELECT '"' || ts_us || '","' || key || '","' || action || '","' || coalesce(expected, '') || '","' || event_type || '","' || replace(comment, '"', '""') || '"' AS line FROM f""",
)
def _(spark, d):
    path = shared_dir(spark, "feedback")
    log = verdict_log(spark, d)
    rows = log.select(
        F.col("ts_us").alias("ts"), "key", F.col("action").alias("verdictAction"),
        F.when(F.col("k") % 3 != 0, "clean").alias("expectedAction"), F.col("event_type").alias("siteId"),
        F.concat(F.lit('said "no", k='), F.col("k").cast("string")).alias("comment"),
    )
    sk.append_feedback(rows, f"{path}/log")
    sk.export_feedback_csv(spark.read.parquet(f"{path}/log"), f"{path}/csv")
    lines = spark.read.text(f"{path}/csv").withColumnRenamed("value", "line")
    return lines.filter(~F.col("line").startswith('"ts",') & ~F.col("line").startswith("ts,"))


@query("threshold_report", f"WITH {_SWEEP} SELECT coalesce((SELECT threshold FROM sweep WHERE f1 > 0 ORDER BY f1 DESC, threshold LIMIT 1), 0.5) AS flag_threshold")
def _(spark, d):
    path = shared_dir(spark, "thresholds")
    sk.write_threshold_report(ev.pick_thresholds(ev.threshold_sweep(scored(spark, d), "score", "toxic")), path)
    return spark.read.json(path).select("flag_threshold")


@query("export_feedback_json", f"WITH {q.EV} SELECT CAST(ts_us AS VARCHAR) AS ts, key, action AS \"verdictAction\", CASE WHEN k % 3 <> 0 THEN 'clean' END AS \"expectedAction\" FROM ev")
def _(spark, d):
    path = shared_dir(spark, "feedback-json")
    log = verdict_log(spark, d)
    sk.export_feedback_json(log.select(
        F.col("ts_us").cast("string").alias("ts"), "key", F.col("action").alias("verdictAction"), F.when(F.col("k") % 3 != 0, "clean").alias("expectedAction")
    ), path)
    return spark.read.schema("ts string, key string, verdictAction string, expectedAction string").json(path)


#: Posts in one thread file; a longer conversation is several threads.
THREAD_POSTS = 1_000


@query(
    "read_thread_corpus",
    """WITH p AS (SELECT conv_id, turn, md5(conv_id || ':' || turn) AS id, text, CASE WHEN conv_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, 't' || conv_id % 4 AS topic FROM conversations),
    k AS (SELECT *, CASE WHEN substr(id, 1, 1) < '6' THEN 'HOF' WHEN substr(id, 1, 1) < 'd' THEN 'NONE' END AS mark FROM p)
    SELECT id, md5(text) AS text_md5, CASE WHEN mark = 'HOF' THEN 1 ELSE 0 END AS label, topic, split FROM k WHERE mark IS NOT NULL""",
)
def _(spark, d):
    """Every conversation written as thread folders of two JSON files and bounded length, then read as a corpus."""
    root = shared_dir(spark, "threads")
    posts = rd.read_table(spark, d, "conversations").select(
        "conv_id", "turn", F.md5(F.concat_ws(":", "conv_id", "turn")).alias("tweet_id"), F.col("text").alias("tweet"),
        F.floor(F.col("turn") / THREAD_POSTS).alias("block"),
        F.when(F.col("conv_id") % 3 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("t"), F.col("conv_id") % 4).alias("topic"),
    )
    first = F.substring("tweet_id", 1, 1)
    mark = F.when(first < "6", "HOF").when(first < "d", "NONE")
    thread = posts.groupBy("split", "topic", "conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("turn", "tweet_id", "tweet"))).alias("p"),
        F.map_from_entries(F.collect_list(F.when(mark.isNotNull(), F.struct(F.col("tweet_id"), mark.alias("mark"))))).alias("m"),
    )
    data = F.struct(F.col("p")[0]["tweet_id"].alias("tweet_id"), F.col("p")[0]["tweet"].alias("tweet"), F.transform(F.slice("p", 2, F.size("p")), lambda x: F.struct(x["tweet_id"].alias("tweet_id"), x["tweet"].alias("tweet"))).alias("comments"))
    where = F.concat_ws("/", F.lit("a/data"), "split", "topic", F.concat_ws("-", "conv_id", "block"))
    return rd.read_thread_corpus(spark, sk.write_named(thread, root, {"data.json": (where, F.to_json(data)), "labels.json": (where, F.to_json("m"))})).select(
        "id", F.md5("text").alias("text_md5"), "label", "topic", "split"
    )


@query("read_eval_set", "SELECT row_number() OVER (ORDER BY item_id) - 1 AS ix, md5(text) AS text_md5, CAST(item_id % 2 AS INTEGER) AS label FROM benchmark")
def _(spark, d):
    """The benchmark as nested records of sentences, written and read by many tasks."""
    root = shared_dir(spark, "eval-set")
    rows = rd.read_table(spark, d, "benchmark").select("item_id", "text", (F.col("item_id") % 2).cast("int").alias("label"))
    sk.write_eval_set(rows, root, "item_id", per_record=100)
    return rd.read_eval_set(spark, root, multi_line=False).select("ix", F.md5("text").alias("text_md5"), "label")


@query(
    "read_images_validated",
    """SELECT CASE WHEN page_id % 3 = 0 THEN 'png' WHEN page_id % 3 = 1 THEN 'gif' END AS format, CASE WHEN page_id % 3 = 2 THEN 'unrecognised-image-bytes' END AS reason,
    count(*) AS n, CAST(sum(8 + octet_length(encode(url))) AS BIGINT) AS bytes FROM pages GROUP BY 1, 2""",
)
def _(spark, d):
    """A file per page, an image head and the address as its body, read as binary files."""
    root = shared_dir(spark, "images")
    n = F.col("page_id") % 3
    head = F.when(n == 0, "89504E470D0A1A0A").when(n == 1, "4749463839610000").otherwise("3C68746D6C3E0A0A")
    files = rd.read_table(spark, d, "pages").select("page_id", F.concat(F.unhex(head), F.encode("url", "UTF-8")).alias("body"))
    where = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    out = rd.read_images_validated(spark, sk.write_named(files, root, {"image": (where, F.col("body"))}))
    return out.groupBy("format", "reason").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


# ------------------------------------------------------------------------------ learning


def _load_proxy():
    """A model in Python behind the scorer interface."""
    import hashlib

    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: int(hashlib.md5(t.encode()).hexdigest()[:7], 16) / 268435455.0)

    return score


@query("pluggable_scorer", f"SELECT doc_id, round({q.proxy('text')}, 6) AS score FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.round(ml.scorer_column(_load_proxy, "text"), 6).alias("score"))


@query("score_distinct_texts", f"SELECT doc_id, round({q.proxy('text')}, 6) AS score FROM documents")
def _(spark, d):
    out = ml.score_distinct(documents(spark, d), "text", lambda t: ml.scorer_column(_load_proxy, t))
    return out.select("doc_id", F.round("score", 6).alias("score"))


def _load_image_model():
    import numpy as np

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].to_numpy()).astype("float64")[:, :3] * 10
        p = 1 / (1 + np.exp(-x))
        return pd.DataFrame({"vec_id": pdf["vec_id"], "violence": p[:, 0], "sensitive": p[:, 1], "weapon": p[:, 2]})

    return score


@query(
    "pluggable_image_scorer",
    "SELECT vec_id, " + ", ".join(f"round(1 / (1 + exp(-embedding[{i + 1}]::DOUBLE * 10)), 6) AS {n}" for i, n in enumerate(("violence", "sensitive", "weapon"))) + " FROM embeddings",
)
def _(spark, d):
    e = rd.read_table(spark, d, "embeddings").select("vec_id", "embedding")
    out = ml.score_images(e, _load_image_model, "vec_id long, violence double, sensitive double, weapon double")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("violence", "sensitive", "weapon")])


def training_split(spark, d):
    rows = materialize(cp.stratified_split(labelled(spark, d), "label", "doc_id"), "training")
    train = cp.oversample(rows.filter("split = 'train'"), cp.copies_v2(F.col("label") == 1, F.lit(False)))
    return train.select("text", "label"), rows.filter("split = 'val'").select("doc_id", "text", "label")


@query("train_classifier")
def _(spark, d):
    train, val = training_split(spark, d)
    _, runs = ml.train_classifier(train, val)
    return runs.select("reg", "tp", "fp", "tn", "fn", "precision", "recall", "f1")


@query(
    "train_classifier_totals",
    f"""WITH {LABELLED}, {_SPLIT.format(src="labelled")}, v AS (SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM split WHERE split = 'val')
    SELECT reg, positives, negatives, true AS consistent FROM v, (VALUES (0.01::DOUBLE), (0.1::DOUBLE)) r(reg)""",
)
def _(spark, d):
    """Every run of the grid judges the whole validation split, and its metrics follow from its counts."""
    train, val = training_split(spark, d)
    _, runs = ml.train_classifier(train, val)
    p, r = ev.ratio(F.col("tp"), F.col("tp") + F.col("fp")), ev.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    same = (F.abs(F.col("precision") - p) < 1e-6) & (F.abs(F.col("recall") - r) < 1e-6)
    return runs.select("reg", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"), same.alias("consistent"))


@query("train_epochs")
def _(spark, d):
    train, val = training_split(spark, d)
    _, runs = ep.train_epochs(train, val)
    return runs


@query(
    "train_epochs_runs",
    f"""WITH {LABELLED}, {_SPLIT.format(src="labelled")}, v AS (SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM split WHERE split = 'val')
    SELECT run, positives, negatives, 1::BIGINT AS best_epochs, true AS consistent FROM v, (VALUES ('a'), ('b')) r(run)""",
)
def _(spark, d):
    """A table of two runs, one of them added twice: every epoch judges all validation rows, its figures follow from its
    counts, the stored predictions of the best model give those counts again, and one epoch of a run is the best."""
    train, val = training_split(spark, d)
    path = shared_dir(spark, "runs")
    for name, policy in (("a", ep.EpochPolicy(epochs=3)), ("b", ep.EpochPolicy(epochs=2, rate=0.5))):
        model, runs = ep.train_epochs(train, val, policy=policy)
        stored = materialize(model.scores(val, "text", "label"), "predictions")
        hit, gold = F.col("score") >= policy.cutoff, F.col("label") == 1
        again = stored.agg(F.count_if(hit & gold).alias("tp2"), F.count_if(hit & ~gold).alias("fp2"), F.count_if(~hit & gold).alias("fn2")).first()
        runs = runs.withColumns({c: F.lit(again[c]) for c in ("tp2", "fp2", "fn2")})
        runs = runs.withColumn("same", ~F.col("best") | ((F.col("tp") == F.col("tp2")) & (F.col("fp") == F.col("fp2")) & (F.col("fn") == F.col("fn2"))))
        ep.append_run(runs, path, name)
    ep.append_run(runs, path, "b")
    rows = spark.read.parquet(path).withColumn("run", F.col("run").cast("string"))
    p, r = ev.ratio(F.col("tp"), F.col("tp") + F.col("fp")), ev.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    right = F.col("same") & (F.abs(F.col("precision") - p) < 1e-6) & (F.abs(F.col("recall") - r) < 1e-6) & (F.col("loss") > 0)
    top = rows.groupBy("run").agg(F.max("f1").alias("top"))
    return (
        rows.join(top, "run").groupBy("run", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"))
        .agg(F.count_if("best").alias("best_epochs"), (F.bool_and(right) & F.bool_and(~F.col("best") | (F.col("f1") == F.col("top")))).alias("consistent"))
    )


@query(
    "score_documents_coverage",
    f"WITH RECURSIVE {_WALK_ALL} SELECT doc_id, count(ix) AS n_windows, true AS decided FROM documents LEFT JOIN windows USING (doc_id) GROUP BY doc_id",
)
def _(spark, d):
    """Every document gets a verdict on one of the windows of its whole text."""
    train, _ = training_split(spark, d)
    docs = documents(spark, d)
    out = ml.score_documents(ml.build_pipeline(0.1).fit(train), docs, "doc_id", "text")
    counted = docs.select("doc_id", F.size(wn.window_text("text", ml.WHOLE)).cast("long").alias("n_windows")).join(out, "doc_id", "left")
    inside = F.col("action").isin("clean", "flag", "block") & ((F.col("n_windows") == 0) | (F.col("window_ix") < F.col("n_windows"))) & (F.col("windows") <= F.col("n_windows"))
    return counted.select("doc_id", "n_windows", F.coalesce(inside, F.lit(False)).alias("decided"))


@query("score_documents")
def _(spark, d):
    train, _ = training_split(spark, d)
    model = ml.build_pipeline(0.1).fit(train)
    out = ml.score_documents(model, documents(spark, d), "doc_id", "text")
    return out.select("doc_id", "action", "tier", "window_ix", "windows")


@query("merge_store", f"WITH {_LWW} SELECT key, seq, action FROM cur")
def _(spark, d):
    early = F.col("event_type") == "view"
    log = verdict_log(spark, d).filter("policy_version = 'v2'")
    cols = ["key", "ts_us", "seq", "action"]
    current = st.last_write_wins(log.filter(early).select(*cols), "key", ["ts_us", "seq"])
    return st.merge_store(current, log.filter(~early).select(*cols), "key", ["ts_us", "seq"]).select("key", "seq", "action")
