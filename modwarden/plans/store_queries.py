"""Verdict log, store, refinement, media-decision and identity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modwarden.functions import identity as idn
from modwarden.functions import scores as sc
from modwarden.operators import fusion as fu
from modwarden.operators import learning as ml
from modwarden.operators import media as md
from modwarden.operators import store as st
from modwarden.plans import sql as q
from modwarden.plans.registry import query
from modwarden.plans.text_queries import plausibility_sql
from modwarden.session import shared_dir
from modwarden.sources.buckets import BucketedStore
from modwarden.sources.readers import read_table


def micros(ts: str = "ts"):
    """Microseconds since the epoch of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def shape_events(events: DataFrame) -> DataFrame:
    """Events read as verdicts: who, what action, from which source, on which image."""
    k = F.get_json_object("props", "$.k").cast("long")
    value = F.col("value")
    return events.select(
        F.col("event_id").alias("seq"), micros().alias("ts_us"), "user_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), "event_type", "value", k.alias("k"),
        F.when(value >= 100, "block").when(value >= 50, "flag").otherwise("clean").alias("action"),
        F.when(F.col("event_type") == "error", "lexicon").when(F.col("event_type") == "signup", "text")
        .when(F.col("event_type") == "purchase", "image").when(F.col("event_type") == "view", "ocr-text")
        .otherwise("lexicon-ocr").alias("source"),
        F.concat(F.lit("img"), F.floor(k / 10).cast("string")).alias("image_key"),
        F.when(k >= 90, "v1").otherwise("v2").alias("policy_version"),
        F.when(k < 20, "1:0:1").otherwise("1:1:1").alias("settings_policy"),
    )


def verdict_log(spark: SparkSession, d: str) -> DataFrame:
    return shape_events(read_table(spark, d, "events"))


def current(spark, d):
    cols = ["key", "ts_us", "seq", "action", "source", "image_key", "policy_version", "settings_policy"]
    return st.last_write_wins(verdict_log(spark, d).select(*cols), "key", ["ts_us", "seq"], "v2")


_LWW = f"""{q.EV}, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us DESC, seq DESC) AS rn FROM ev WHERE policy_version = 'v2') WHERE rn = 1)"""


@query("last_write_wins", f"WITH {_LWW} SELECT key, seq, ts_us, action, settings_policy FROM cur")
def _(spark, d):
    return current(spark, d).select("key", "seq", "ts_us", "action", "settings_policy")


@query("session_stats", f"""WITH {_LWW} SELECT count(*) FILTER (action = 'block') AS blocked, count(*) FILTER (action = 'flag') AS flagged,
    count(*) FILTER (action = 'clean') AS clean, count(*) AS total FROM cur""")
def _(spark, d):
    return st.session_stats(current(spark, d))


@query("stats_by_source", f"WITH {_LWW} SELECT source, action, count(*) AS n FROM cur WHERE action <> 'clean' GROUP BY source, action")
def _(spark, d):
    reason = F.array(F.struct("source", "action"))
    rows = current(spark, d).withColumn("reasons", F.when(F.col("action") != "clean", reason).otherwise(F.slice(reason, 1, 0)))
    return st.stats_by_source(rows)


@query("recent_verdicts", f"WITH {_LWW} SELECT key, ts_us, action FROM cur ORDER BY coalesce(ts_us, 0) DESC, key LIMIT 20")
def _(spark, d):
    return st.recent_verdicts(current(spark, d), 20, "ts_us").select("key", "ts_us", "action")


@query(
    "keep_newest_n",
    f"WITH {q.EV} SELECT event_type, seq FROM (SELECT event_type, seq, row_number() OVER (PARTITION BY event_type ORDER BY ts_us DESC, seq DESC) AS rn FROM ev) WHERE rn <= 250",
)
def _(spark, d):
    log = verdict_log(spark, d).select("event_type", "ts_us", "seq")
    return st.keep_newest(log, ["event_type"], "ts_us", "seq", 250).select("event_type", "seq")


@query(
    "priority_admission",
    f"""WITH {q.EV}, slots AS (SELECT event_type AS cycle, 'u' || user_id AS key, max(k) AS priority, min(seq) AS arrival, count(*) AS requests FROM ev GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY priority DESC, arrival) AS rn FROM slots)
    SELECT cycle, key, priority, arrival, requests, rn <= 12 AS admitted FROM r""",
)
def _(spark, d):
    log = verdict_log(spark, d).select(F.col("event_type").alias("cycle"), "key", "k", "seq")
    return st.admit(log, "cycle", "key", "k", "seq", 12).select("cycle", "key", "priority", "arrival", "requests", "admitted")


@query(
    "bounded_retry_queue",
    f"""WITH {q.EV}, w AS (SELECT key, max(seq) AS arrival FROM ev WHERE event_type = 'error' GROUP BY key)
    SELECT key, arrival, row_number() OVER (ORDER BY arrival DESC, key DESC) > 30 AS dropped FROM w""",
)
def _(spark, d):
    failed = verdict_log(spark, d).filter("event_type = 'error'").groupBy("key").agg(F.max("seq").alias("arrival"))
    return st.bound_queue(failed, "key", "arrival", 30)


_KEYS = ["key", "policy_version", "settings_policy"]
_STORE = f"""{_LWW}, req AS (SELECT DISTINCT key, policy_version, settings_policy FROM ev)"""


def _requests(spark, d):
    return verdict_log(spark, d).select(*_KEYS).distinct()


@query(
    "verdict_cache_lookup",
    f"""WITH {_STORE} SELECT req.key, req.policy_version, req.settings_policy, cur.action AS cached_action FROM req
    LEFT JOIN cur ON cur.key = req.key AND cur.policy_version = req.policy_version AND cur.settings_policy = req.settings_policy""",
)
def _(spark, d):
    stored = current(spark, d).withColumnRenamed("action", "cached_action")
    return st.cache_lookup(_requests(spark, d), stored, _KEYS, ["cached_action"])


@query(
    "bucketed_store_lookup",
    f"""WITH {_STORE} SELECT req.*, CASE WHEN cur.policy_version = req.policy_version AND cur.settings_policy = req.settings_policy THEN cur.action END AS cached_action
    FROM req LEFT JOIN cur USING (key)""",
)
def _(spark, d):
    """Two batches, folded into one, a third after it: the filters say which buckets are read, and the store stays where it lies."""
    log = verdict_log(spark, d).filter("policy_version = 'v2'").select("key", "policy_version", "settings_policy", F.col("action").alias("cached_action"), "ts_us", "seq")
    schema = "key string, policy_version string, settings_policy string, cached_action string, ts_us bigint, seq bigint"
    store = BucketedStore(spark, shared_dir(spark, "bucketed-store"), schema, "key", ["ts_us", "seq"], buckets=16)
    store.upsert(log.filter("cached_action = 'clean'"), "w-0")
    store.upsert(log.filter("cached_action = 'flag'"), "w-1")
    store.compact(0)
    store.upsert(log.filter("cached_action = 'block'"), "w-2")
    return store.lookup(_requests(spark, d), ["cached_action"], ["policy_version", "settings_policy"])


@query(
    "verdict_cache_misses",
    f"""WITH {_STORE} SELECT req.* FROM req WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.key = req.key AND cur.policy_version = req.policy_version AND cur.settings_policy = req.settings_policy)""",
)
def _(spark, d):
    return st.cache_misses(_requests(spark, d), current(spark, d), _KEYS)


_IMAGES = f"""{q.EV}, im AS (SELECT image_key, policy_version, seq, ts_us, action, CASE WHEN k % 7 = 0 THEN 'image-error: timeout' WHEN k % 7 = 1 THEN 'classify-failed' END AS reason FROM ev),
ok AS (SELECT * FROM im WHERE reason IS NULL),
icur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_key ORDER BY ts_us DESC, seq DESC) AS rn FROM ok WHERE policy_version = 'v2') WHERE rn = 1)"""


def image_log(spark, d):
    reason = F.when(F.col("k") % 7 == 0, "image-error: timeout").when(F.col("k") % 7 == 1, "classify-failed")
    return verdict_log(spark, d).select("image_key", "policy_version", "seq", "ts_us", "action", reason.alias("reason"))


@query(
    "image_cache_lookup",
    f"""WITH {_IMAGES} SELECT r.image_key, r.policy_version, icur.action AS cached_action, icur.action IS NULL AS miss FROM (SELECT DISTINCT image_key, policy_version FROM im) r
    LEFT JOIN icur ON icur.image_key = r.image_key AND icur.policy_version = r.policy_version""",
)
def _(spark, d):
    log = image_log(spark, d)
    stored = st.last_write_wins(st.cacheable(log, "action", "reason"), "image_key", ["ts_us", "seq"], "v2")
    out = st.cache_lookup(
        log.select("image_key", "policy_version").distinct(), stored.withColumnRenamed("action", "cached_action"),
        ["image_key", "policy_version"], ["cached_action"],
    )
    return out.withColumn("miss", F.col("cached_action").isNull())


@query(
    "is_cacheable_verdict",
    f"WITH {_IMAGES} SELECT coalesce(reason, 'none') AS why, reason IS NULL AS cacheable, count(*) AS n FROM im GROUP BY 1, 2",
)
def _(spark, d):
    log = image_log(spark, d)
    return log.groupBy(
        F.coalesce("reason", F.lit("none")).alias("why"), sc.is_cacheable("action", F.col("reason")).alias("cacheable")
    ).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------ fusion over the log


_MERGE = f"""{q.EV}, rs AS (SELECT key, source, CASE WHEN source IN ('image','ocr-text','lexicon-ocr') THEN image_key ELSE '' END AS image_key, action, seq FROM ev WHERE action <> 'clean'),
best AS (SELECT *, row_number() OVER (PARTITION BY key, source, image_key ORDER BY (action = 'block')::INT DESC, seq DESC) AS rn FROM rs)"""


def reason_rows(spark, d):
    media = F.col("source").isin("image", "ocr-text", "lexicon-ocr")
    return verdict_log(spark, d).select("key", "source", F.when(media, F.col("image_key")).alias("image_key"), "action", "seq")


@query("strongest_reasons", f"WITH {_MERGE} SELECT key, source, image_key, action, seq AS seen FROM best WHERE rn = 1")
def _(spark, d):
    return fu.strongest_reasons(reason_rows(spark, d), "key", "seq").select("key", "source", "image_key", "action", "seen")


_MEDIA_ROW = "source IN ('image','ocr-text','lexicon-ocr')"


@query(
    "refine_verdict",
    f"""WITH {_MERGE}, touched AS (SELECT DISTINCT key FROM rs WHERE {_MEDIA_ROW})
    SELECT key, {q.name_of('max(' + q.rank_of('action') + ')')} AS action, count(*) AS reasons, count(*) FILTER (action = 'block') AS block_reasons
    FROM best WHERE rn = 1 AND key IN (SELECT key FROM touched) GROUP BY key""",
)
def _(spark, d):
    rows = reason_rows(spark, d)
    media = F.col("source").isin("image", "ocr-text", "lexicon-ocr")
    return fu.refine_verdict(rows.filter(~media), rows.filter(media), "key", "seq")


@query(
    "reconcile_media",
    f"""WITH {_MERGE}, st AS (SELECT * FROM best WHERE rn = 1), keep AS (SELECT *, NOT ({_MEDIA_ROW}) OR image_key IN ('img1', 'img2', 'img3') AS ok FROM st)
    SELECT key, {q.name_of('coalesce(max(CASE WHEN ok THEN ' + q.rank_of('action') + ' END), 0)')} AS action, count(*) FILTER (ok) AS reasons,
    max(seq) AS newest, bool_or(NOT ok) AS changed FROM keep GROUP BY key""",
)
def _(spark, d):
    # One reason per source and image is left per key, so the list of a key is short.
    rows = fu.strongest_reasons(reason_rows(spark, d), "key", "seq")
    stored = rows.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("source", "action", "image_key"))).alias("reasons"),
        sc.rank_action(F.max(sc.action_rank("action"))).alias("action"), F.max("seen").alias("newest"),
    ).withColumn("shown", F.array(*[F.lit(f"img{i}") for i in (1, 2, 3)])).withColumn("ts", F.lit(0))
    out = fu.reconcile_verdicts(stored, "reasons", "shown", F.lit(1))
    return out.select(
        "key", "action", F.size("reasons").cast("long").alias("reasons"), "newest", (F.col("ts") == 1).alias("changed")
    )


_ADDRESSED = f"""{q.EV}, rs AS (SELECT key, source, CASE WHEN source = 'image' THEN image_key ELSE '' END AS image_key,
  CASE WHEN source IN ('ocr-text', 'lexicon-ocr') THEN 'https://media.example/' || image_key ELSE '' END AS image_url, action, seq FROM ev WHERE action <> 'clean'),
best AS (SELECT *, row_number() OVER (PARTITION BY key, source, image_key, image_url ORDER BY (action = 'block')::INT DESC, seq DESC) AS rn FROM rs)"""


@query(
    "reconcile_by_address",
    f"""WITH {_ADDRESSED}, st AS (SELECT * FROM best WHERE rn = 1),
    keep AS (SELECT *, CASE WHEN source NOT IN ('image', 'ocr-text', 'lexicon-ocr') THEN true WHEN image_key <> '' THEN image_key IN ('img1', 'img2', 'img3')
      ELSE image_url IN ('https://media.example/img2', 'https://media.example/img5') END AS ok FROM st)
    SELECT key, {q.name_of('coalesce(max(CASE WHEN ok THEN ' + q.rank_of('action') + ' END), 0)')} AS action, count(*) FILTER (ok) AS reasons,
    count(*) FILTER (ok AND image_url <> '') AS by_address, bool_or(NOT ok) AS changed FROM keep GROUP BY key""",
)
def _(spark, d):
    """Text read off images names its image by address only; findings on images carry their keys."""
    source, key = F.col("source"), F.col("image_key")
    log = verdict_log(spark, d).select(
        "key", "source", F.when(source == "image", key).alias("image_key"),
        F.when(source.isin("ocr-text", "lexicon-ocr"), F.concat(F.lit("https://media.example/"), key)).alias("image_url"), "action", "seq",
    )
    stored = fu.strongest_reasons(log, "key", "seq", url="image_url").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("source", "action", "image_key", "image_url"))).alias("reasons"),
        sc.rank_action(F.max(sc.action_rank("action"))).alias("action"),
    ).withColumns({
        "shown": F.array(*[F.lit(f"img{i}") for i in (1, 2, 3)]), "urls": F.array(*[F.lit(f"https://media.example/img{i}") for i in (2, 5)]), "ts": F.lit(0),
    })
    out = fu.reconcile_verdicts(stored, "reasons", "shown", F.lit(1), current_urls="urls")
    by_address = F.size(F.filter("reasons", lambda r: r["image_url"] != ""))
    return out.select("key", "action", F.size("reasons").cast("long").alias("reasons"), by_address.cast("long").alias("by_address"), (F.col("ts") == 1).alias("changed"))


# ------------------------------------------------------------------------------ media decisions

VIOLENCE_LABELS = ("violence", "sensitive", "weapon", "l4", "l5", "l6", "l7", "l8")


def images(spark, d):
    """Image score vectors: eight detector logits and five class scores per image."""
    e = read_table(spark, d, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    names = ("Drawing", "HENTAI ", "neutral", "Porn", "sexy", "unknown")
    predictions = F.array(*[
        F.struct(F.lit(n).alias("label"), (F.element_at(x, 9 + i) * 5).alias("score")) for i, n in enumerate(names)
    ])
    return e.select(
        "vec_id", "label", sc.logits_to_scores(F.transform(F.slice(x, 1, 8), lambda v: v * 10), VIOLENCE_LABELS).alias("violence"),
        sc.canonical_labels(predictions).alias("nsfw"),
    )


def _sig(i: int) -> str:
    x = f"(embedding[{i}]::DOUBLE * 10)"
    return f"(CASE WHEN {x} >= 0 THEN 1 / (1 + exp(-abs({x}))) ELSE exp(-abs({x})) / (1 + exp(-abs({x}))) END)"


def _cls(i: int) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, embedding[{i}]::DOUBLE * 5))"


_IMG = f"""img AS (SELECT vec_id, label, {_sig(1)} AS violence, {_sig(2)} AS sensitive, {_sig(3)} AS weapon, {_sig(8)} AS l8,
  {_cls(9)} AS drawings, {_cls(10)} AS hentai, {_cls(11)} AS neutral, {_cls(12)} AS porn, {_cls(13)} AS sexy FROM embeddings),
acts AS (SELECT *, sqrt(violence * sensitive) AS gore,
  CASE WHEN greatest(porn, hentai) >= 0.7 THEN 'block' WHEN greatest(porn, hentai) >= 0.5 OR sexy >= 0.85 THEN 'flag' ELSE 'clean' END AS nsfw_action,
  CASE WHEN violence >= 0.82 OR sqrt(violence * sensitive) >= 0.7 THEN 'block'
    WHEN violence >= 0.7 OR sqrt(violence * sensitive) >= 0.5 OR weapon >= 0.88 THEN 'flag' ELSE 'clean' END AS violence_action FROM img),
strong AS (SELECT *, CASE WHEN {q.rank_of('violence_action')} > {q.rank_of('nsfw_action')} THEN violence_action ELSE nsfw_action END AS action,
  CASE WHEN {q.rank_of('violence_action')} > {q.rank_of('nsfw_action')} THEN 'violence-gore' ELSE 'nsfw' END AS detector FROM acts)"""


@query(
    "logits_to_scores",
    f"WITH {_IMG} SELECT vec_id, round(violence, 6) AS violence, round(sensitive, 6) AS sensitive, round(weapon, 6) AS weapon, round(l8, 6) AS l8 FROM img",
)
def _(spark, d):
    v = F.col("violence")
    return images(spark, d).select("vec_id", *[F.round(v[n], 6).alias(n) for n in ("violence", "sensitive", "weapon", "l8")])


@query(
    "canonical_labels",
    f"WITH {_IMG} SELECT vec_id, round(drawings, 6) AS drawings, round(hentai, 6) AS hentai, round(neutral, 6) AS neutral, round(porn, 6) AS porn, round(sexy, 6) AS sexy FROM img",
)
def _(spark, d):
    s = F.col("nsfw")
    return images(spark, d).select("vec_id", *[F.round(s[n], 6).alias(n) for n in ("drawings", "hentai", "neutral", "porn", "sexy")])


@query("nsfw_policy", f"WITH {_IMG} SELECT vec_id, nsfw_action FROM acts")
def _(spark, d):
    return images(spark, d).select("vec_id", sc.nsfw_action("nsfw").alias("nsfw_action"))


@query("violence_policy", f"WITH {_IMG} SELECT vec_id, round(gore, 6) AS gore, violence_action FROM acts")
def _(spark, d):
    v = F.col("violence")
    return images(spark, d).select(
        "vec_id", F.round(sc.gore_score(v["violence"], v["sensitive"]), 6).alias("gore"),
        sc.violence_action(v["violence"], v["sensitive"], v["weapon"]).alias("violence_action"),
    )


@query("strongest_image_decision", f"WITH {_IMG} SELECT vec_id, action, detector FROM strong")
def _(spark, d):
    return ml.image_decisions(images(spark, d), "nsfw", "violence").select("vec_id", "image.action", "image.detector")


@query(
    "image_rollup",
    f"""WITH {_IMG}, post AS (SELECT *, vec_id // 3 AS post, vec_id % 3 AS ix FROM strong),
    p AS (SELECT post, max(CASE WHEN action = 'block' THEN ix END) AS b, min(CASE WHEN action = 'flag' THEN ix END) AS f, count(*) AS images FROM post GROUP BY post)
    SELECT p.post, coalesce(s.action, 'clean') AS action, s.ix AS image_ix, s.detector, p.images FROM p LEFT JOIN post s ON s.post = p.post AND s.ix = coalesce(p.b, p.f)""",
)
def _(spark, d):
    s = ml.image_decisions(images(spark, d), "nsfw", "violence").select(
        F.floor(F.col("vec_id") / 3).alias("post"), (F.col("vec_id") % 3).alias("ix"), "image.action", "image.detector"
    )
    return md.image_rollup(s, "post", "ix", "action", ["detector"])


@query(
    "confirm_video",
    f"""WITH {q.EV}, f AS (SELECT key || ':' || (k // 25) AS scan_id, k % 25 // 5 AS frame_ix, CASE WHEN k // 25 < 3 THEN 'video' ELSE 'gif' END AS kind, source, {q.rank_of('action')} AS r FROM ev WHERE source IN ('image', 'ocr-text') AND action <> 'clean'),
    pf AS (SELECT scan_id, frame_ix, kind = 'video' AND source = 'image' AS two, max(r) AS r FROM f GROUP BY 1, 2, 3),
    ps AS (SELECT scan_id, count(*) FILTER (two) AS image_frames, max(CASE WHEN two THEN r END) AS im, max(CASE WHEN NOT two THEN r END) AS now_r FROM pf GROUP BY scan_id)
    SELECT scan_id, image_frames, {q.name_of('greatest(coalesce(now_r, 0), CASE WHEN image_frames >= 2 THEN im ELSE 0 END)')} AS action FROM ps""",
)
def _(spark, d):
    scan = F.floor(F.col("k") / 25)
    f = verdict_log(spark, d).filter(F.col("source").isin("image", "ocr-text")).select(
        F.concat("key", F.lit(":"), scan.cast("string")).alias("scan_id"), F.floor((F.col("k") % 25) / 5).alias("frame_ix"),
        F.when(scan < 3, "video").otherwise("gif").alias("kind"), "source", "action",
    )
    return md.confirm_video(f)


@query(
    "sample_frames",
    f"WITH {q.EV} SELECT k, count(*) AS n, CASE WHEN k >= 2 THEN array_to_string(list_sort(list_distinct([0, k // 3, 2 * k // 3])), ',') ELSE '' END AS frames FROM ev GROUP BY k",
)
def _(spark, d):
    per = verdict_log(spark, d).groupBy("k").agg(F.count("*").alias("n"))
    return per.withColumn("frames", F.array_join(F.array_sort(md.sample_frame_indexes("k")), ","))


@query(
    "sample_video_frames",
    f"""WITH {q.EV}, f AS (SELECT key AS scan_id, value / 100 AS at_s, k::DOUBLE AS duration FROM ev WHERE k > 0 AND k <= 60),
    s AS (SELECT *, at_s - min(at_s) OVER (PARTITION BY scan_id) AS el FROM f)
    SELECT scan_id, CAST(CASE WHEN el >= 1 THEN 2 WHEN el >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS bucket, min(at_s) AS at_s FROM s WHERE el <= 2.5 GROUP BY 1, 2""",
)
def _(spark, d):
    f = verdict_log(spark, d).select(
        F.col("key").alias("scan_id"), (F.col("value") / 100).alias("at_s"), F.col("k").cast("double").alias("duration")
    )
    return md.sample_video_frames(f, "scan_id", "at_s", "duration").withColumn("bucket", F.col("bucket").cast("long"))


@query(
    "otsu_threshold",
    f"""WITH {q.EV}, v AS (SELECT event_type, CAST(least(255, floor(value)) AS BIGINT) AS g FROM ev), h AS (SELECT event_type, g, count(*) AS n FROM v GROUP BY 1, 2),
    c AS (SELECT event_type, g, CAST(sum(n) OVER w AS DOUBLE) AS wb, CAST(sum(n * g) OVER w AS DOUBLE) AS sb, CAST(sum(n) OVER a AS DOUBLE) AS nt, CAST(sum(n * g) OVER a AS DOUBLE) AS st FROM h
      WINDOW w AS (PARTITION BY event_type ORDER BY g ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY event_type)),
    b AS (SELECT event_type, g, wb * (nt - wb) * (sb / wb - (st - sb) / (nt - wb)) * (sb / wb - (st - sb) / (nt - wb)) AS v FROM c WHERE nt > wb)
    SELECT event_type, g AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, g) AS rn FROM b WHERE v > 0) WHERE rn = 1""",
)
def _(spark, d):
    v = verdict_log(spark, d).select("event_type", F.least(F.lit(255), F.floor("value")).alias("gray"))
    return md.otsu_threshold(v, "event_type", "gray")


_OCR_STATUS = "CASE WHEN k % 5 = 0 THEN 'error' WHEN k % 5 = 1 THEN 'timed-out' WHEN k % 5 = 2 THEN 'deferred' ELSE 'clean' END"


@query(
    "media_status",
    f"""WITH {q.EV}, m AS (SELECT event_type = 'error' AS incomplete, {_OCR_STATUS} AS ocr, k // 25 AS ia, k // 40 AS oa FROM ev),
    s AS (SELECT CASE WHEN ocr IN ('timed-out', 'deferred') THEN 'pending' WHEN incomplete OR ocr = 'error' THEN 'error' ELSE 'complete' END AS state,
      CASE WHEN ocr = 'timed-out' THEN 'ocr-in-flight' WHEN ocr = 'deferred' THEN 'capacity-full' WHEN ocr = 'error' AND oa <= 1 THEN 'ocr-error' WHEN incomplete AND ia <= 2 THEN 'image-fetch' END AS retry FROM m)
    SELECT state, retry, count(*) AS n FROM s GROUP BY state, retry""",
)
def _(spark, d):
    k = F.col("k")
    ocr = F.when(k % 5 == 0, "error").when(k % 5 == 1, "timed-out").when(k % 5 == 2, "deferred").otherwise("clean")
    s = verdict_log(spark, d).select(
        md.media_status(F.col("event_type") == "error", ocr, F.floor(k / 25), F.floor(k / 40)).alias("s")
    )
    return s.groupBy(F.col("s.state").alias("state"), F.col("s.retry").alias("retry")).agg(F.count("*").alias("n"))


_FINGERPRINT = f"""WITH {q.EV}, m AS (SELECT seq, ['https://cdn.test/' || image_key || '.jpg|d:' || length(props2) || ':' || md5(props2), 'https://cdn.test/u' || user_id || '.png', 'https://cdn.test/' || event_type || '.gif', 'https://cdn.test/extra.jpg'] AS keys
      FROM (SELECT *, 'k=' || k AS props2 FROM ev))
    SELECT seq, sha256(to_json(list_sort(keys[1:3]))::VARCHAR) AS media_fp FROM m"""


def image_source_keys():
    data = F.concat(F.lit("k="), F.col("k").cast("string"))
    cdn = F.lit("https://cdn.test/")
    keys = F.array(
        idn.source_key(F.concat(cdn, "image_key", F.lit(".jpg")), data),
        idn.source_key(F.concat(cdn, "key", F.lit(".png")), F.lit(None).cast("string")),
        idn.source_key(F.concat(cdn, "event_type", F.lit(".gif")), F.lit("")),
        F.concat(cdn, F.lit("extra.jpg")),
    )
    return keys


@query("media_fingerprint", _FINGERPRINT)
def _(spark, d):
    return verdict_log(spark, d).select("seq", idn.media_fingerprint(image_source_keys(), 3).alias("media_fp"))


@query("media_fingerprint_whole", _FINGERPRINT.replace("keys[1:3]", "keys"))
def _(spark, d):
    return verdict_log(spark, d).select("seq", idn.media_fingerprint(image_source_keys()).alias("media_fp"))


@query(
    "animated_filter",
    f"""WITH {q.EV}, a AS (SELECT 'https://cdn.test/' || image_key || CASE WHEN k % 3 = 0 THEN '.GIF?x=1' WHEN k % 3 = 1 THEN '.gifv' ELSE '.mp4' END AS u, value AS dur FROM ev)
    SELECT regexp_matches(u, '(?i)\\.gif(?:[?#]|$)') AS gif, dur > 0 AND dur <= 60 AS short_video, count(*) AS n FROM a GROUP BY 1, 2""",
)
def _(spark, d):
    k = F.col("k")
    ext = F.when(k % 3 == 0, ".GIF?x=1").when(k % 3 == 1, ".gifv").otherwise(".mp4")
    a = verdict_log(spark, d).select(F.concat(F.lit("https://cdn.test/"), "image_key", ext).alias("u"), "value")
    return a.groupBy(idn.is_gif("u").alias("gif"), idn.is_short_video("value").alias("short_video")).agg(F.count("*").alias("n"))


@query(
    "best_ocr_candidate",
    "WITH " + plausibility_sql(
        "conversations", "conv_id, turn", f", {q.proxy('text')} * 100 AS conf"
    ) + """, sc AS (SELECT conv_id, turn, conf, CASE WHEN p > 0 THEN p * (0.4::DOUBLE + 0.6::DOUBLE * greatest(0, least(1, conf / 100))) END AS s FROM plaus),
    g AS (SELECT conv_id, min(CASE WHEN s >= 0.4 THEN turn END) AS good FROM sc GROUP BY conv_id),
    r AS (SELECT sc.*, good, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC NULLS LAST, turn) AS rn FROM sc JOIN g USING (conv_id) WHERE good IS NULL OR turn <= good)
    SELECT conv_id, CASE WHEN s IS NOT NULL AND conf >= 25 THEN turn END AS pass_ix, round(CASE WHEN s IS NOT NULL AND conf >= 25 THEN s END, 6) AS score FROM r WHERE rn = 1""",
)
def _(spark, d):
    turns = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    passes = turns.withColumn("conf", sc.proxy_score("text") * 100)
    return md.best_ocr_candidate(passes, "conv_id", "turn", "text", "conf").select(
        "conv_id", "pass_ix", F.round("score", 6).alias("score")
    )


@query(
    "normalize_settings",
    f"""WITH {q.EV}, s AS (SELECT CASE WHEN k % 4 = 0 THEN 'false' WHEN k % 4 = 1 THEN 'true' WHEN k % 4 = 2 THEN 'maybe' END AS i, CASE WHEN event_type = 'view' THEN 'false' ELSE NULL END AS o FROM ev)
    SELECT (CASE WHEN i = 'false' THEN '0' ELSE '1' END) || ':' || (CASE WHEN o = 'false' THEN '0' ELSE '1' END) || ':1' AS settings_policy, count(*) AS n FROM s GROUP BY 1""",
)
def _(spark, d):
    k = F.col("k")
    i = F.when(k % 4 == 0, "false").when(k % 4 == 1, "true").when(k % 4 == 2, "maybe")
    o = F.when(F.col("event_type") == "view", "false")
    s = verdict_log(spark, d).select(
        sc.settings_policy(sc.normalize_setting(i), sc.normalize_setting(o), sc.normalize_setting(F.lit(None).cast("string"))).alias("settings_policy")
    )
    return s.groupBy("settings_policy").agg(F.count("*").alias("n"))


@query(
    "time_and_json",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%-I:%M:%S %p') AS clock, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS json FROM events",
)
def _(spark, d):
    e = read_table(spark, d, "events").select("event_id", "ts", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", "p.k", F.date_format("ts", "h:mm:ss a").alias("clock"), F.to_json("p").alias("json"))
