"""Corpus preparation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modwarden.functions import scores as sc
from modwarden.functions import text as tx
from modwarden.operators import corpus as cp
from modwarden.operators import evaluate as ev
from modwarden.plans import sql as q
from modwarden.plans.registry import query
from modwarden.plans.text_queries import documents
from modwarden.sources.readers import read_table

HARD_TERMS = ("scum", "idiot", "trash", "disgusting", "edonble", "auxment")


def labelled(spark, d):
    """Documents with a gold label."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    labels = read_table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    return docs.join(labels, "doc_id")


LABELLED = "labelled AS (SELECT d.doc_id, d.text, d.lang, d.source, l.toxic AS label FROM documents d JOIN labels l USING (doc_id))"


def held_out(digest: str = "doc_id"):
    """Half of the rows, by hash of the id."""
    return F.md5(F.col(digest).cast("string")) >= "8"


_HELD = "md5(doc_id::VARCHAR) >= '8'"
_DIGEST = f"md5({q.dedupe('text')})"


@query(
    "dedupe_keep_first",
    f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_DIGEST} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
)
def _(spark, d):
    return cp.dedupe_keep_first(documents(spark, d), "text", "doc_id").select("doc_id")


@query(
    "leakage_removal",
    f"SELECT doc_id FROM documents WHERE {_HELD} AND {_DIGEST} NOT IN (SELECT {_DIGEST} FROM documents WHERE NOT ({_HELD}))",
)
def _(spark, d):
    docs = documents(spark, d)
    return cp.remove_leakage(docs.filter(held_out()), docs.filter(~held_out())).select("doc_id")


@query(
    "benchmark_leakage_removal",
    f"SELECT doc_id FROM documents WHERE {_DIGEST} NOT IN (SELECT {_DIGEST} FROM benchmark)",
)
def _(spark, d):
    return cp.remove_leakage(documents(spark, d), read_table(spark, d, "benchmark")).select("doc_id")


@query(
    "split_overlap",
    f"SELECT count(*) AS overlap FROM (SELECT {_DIGEST} AS g FROM documents WHERE {_HELD} INTERSECT SELECT {_DIGEST} FROM documents WHERE NOT ({_HELD}))",
)
def _(spark, d):
    docs = documents(spark, d)
    return cp.split_overlap(docs.filter(held_out()), docs.filter(~held_out()))


_BAD = " OR ".join(f"contains({q.dedupe('text')}, '{t}')" for t in HARD_TERMS)


def hard_terms(spark):
    return spark.createDataFrame([(t,) for t in HARD_TERMS], "term string")


@query("contradiction_audit", f"WITH {LABELLED} SELECT doc_id, label FROM labelled WHERE NOT (label = 0 AND ({_BAD}))")
def _(spark, d):
    return cp.contradiction_audit(labelled(spark, d), "doc_id", hard_terms(spark)).select("doc_id", "label")


@query("contradiction_audit_by_join", f"WITH {LABELLED} SELECT doc_id, label FROM labelled WHERE NOT (label = 0 AND ({_BAD}))")
def _(spark, d):
    return cp.contradiction_audit(labelled(spark, d), "doc_id", hard_terms(spark), limit=0).select("doc_id", "label")


@query("contradictions", f"WITH {LABELLED} SELECT doc_id, lang FROM labelled WHERE label = 0 AND ({_BAD})")
def _(spark, d):
    return cp.contradictions(labelled(spark, d), "doc_id", hard_terms(spark)).select("doc_id", "lang")


_SPLIT = """ordered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id)) AS rn, count(*) OVER (PARTITION BY label) AS n FROM {src}),
split AS (SELECT *, CASE WHEN rn <= floor(n * 0.10::DOUBLE) THEN 'val' WHEN rn <= floor(n * 0.20::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM ordered)"""


@query("stratified_split", f"WITH {LABELLED}, {_SPLIT.format(src='labelled')} SELECT doc_id, label, split FROM split")
def _(spark, d):
    rows = labelled(spark, d).select("doc_id", "label")
    return cp.stratified_split(rows, "label", "doc_id").select("doc_id", "label", "split")


@query(
    "stratified_subsample",
    f"""WITH {LABELLED}, o AS (SELECT doc_id, label, lang, row_number() OVER (PARTITION BY label, lang ORDER BY md5('42:' || doc_id)) AS rn,
    count(*) OVER (PARTITION BY label, lang) AS n, count(*) OVER () AS t FROM labelled)
    SELECT doc_id, label, lang FROM o WHERE rn <= greatest(1, round_even(200.0::DOUBLE * n / t, 0))""",
)
def _(spark, d):
    rows = labelled(spark, d).select("doc_id", "label", "lang")
    return cp.stratified_subsample(rows, ["label", "lang"], "doc_id", 200)


@query("subsample_n", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id) LIMIT 150")
def _(spark, d):
    return cp.subsample(read_table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 150)


@query("seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS position FROM documents")
def _(spark, d):
    return cp.seeded_shuffle(read_table(spark, d, "documents").select("doc_id"), "doc_id")


_UNION = """corpus AS (SELECT doc_id AS id, text, lang, 'documents' AS origin FROM documents
  UNION ALL SELECT conv_id * 1000 + turn, text, role, 'conversations' FROM conversations
  UNION ALL SELECT item_id, text, 'bench', 'benchmark' FROM benchmark)"""


def corpus_sources(spark, d):
    turns = read_table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return {
        "documents": (read_table(spark, d, "documents"), {"id": "doc_id"}),
        "conversations": (turns, {"lang": "role"}),
        "benchmark": (read_table(spark, d, "benchmark").withColumn("lang", F.lit("bench")), {"id": "item_id"}),
    }


def corpus_union(spark, d):
    return cp.union_corpora(corpus_sources(spark, d), ["id", "text", "lang"])


@query(
    "union_corpora",
    f"WITH {_UNION} SELECT origin, lang, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM corpus GROUP BY origin, lang",
)
def _(spark, d):
    return corpus_union(spark, d).groupBy("origin", "lang").agg(
        F.count("*").alias("rows"), F.sum(F.length("text")).cast("long").alias("chars")
    )


_ACCENTS = "strip_accents(lower(text))"


@query(
    "prepare_corpus_v4",
    f"""WITH {_UNION}, grown AS (SELECT origin || '/' || id AS id, text, lang, origin FROM corpus
      UNION ALL SELECT origin || '/' || id || '/plain', {_ACCENTS}, 'plain', origin FROM corpus WHERE lang IN ('fr', 'user')),
    n AS (SELECT *, {q.dedupe('text')} AS g, CASE WHEN md5(id) < '4' THEN 1 ELSE 0 END AS label FROM grown),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY md5(g) ORDER BY id) AS first FROM n WHERE length(g) >= 3) WHERE first = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id)) AS rn, count(*) OVER (PARTITION BY label) AS n FROM u),
    s AS (SELECT *, CASE WHEN rn <= floor(n * 0.10::DOUBLE) THEN 'val' WHEN rn <= floor(n * 0.20::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM o),
    c AS (SELECT *, CASE WHEN split = 'train' THEN (CASE WHEN origin = 'conversations' THEN 4 ELSE 1 END) * (CASE WHEN label = 1 THEN 2 ELSE 1 END) ELSE 1 END AS copies FROM s)
    SELECT id, lang, origin, label, split, CAST(unnest(range(1, copies + 1)) AS BIGINT) AS copy FROM c""",
)
def _(spark, d):
    """Three sources and the accent-free copies of two kinds of rows; threads four times, toxic rows twice."""
    merged = cp.union_corpora(corpus_sources(spark, d), ["id", "text", "lang"], "id")
    grown = cp.augment_union(merged, F.col("lang").isin("fr", "user"), tx.fold_accents(F.lower("text")), "text", "plain", id_col="id")
    labels = F.when(F.md5("id") < "4", 1).otherwise(0)
    copies = cp.copies_v4(F.col("origin") == "conversations", F.col("label") == 1)
    out = cp.prepare_merged(grown.withColumn("label", labels), "id", copies)
    return out.select("id", "lang", "origin", "label", "split", F.col("copy").cast("long").alias("copy"))


def split_rows(spark, d):
    return cp.stratified_split(labelled(spark, d).select("doc_id", "label", "lang", "source"), "label", "doc_id")


_OVER = """WITH {lab}, {split}, r AS (SELECT split, label, CASE WHEN split = 'train' THEN {copies} ELSE 1 END AS c FROM split)
SELECT split, label, CAST(sum(c) AS BIGINT) AS rows FROM r GROUP BY split, label"""


def _oversampled(copies_sql):
    return _OVER.format(lab=LABELLED, split=_SPLIT.format(src="labelled"), copies=copies_sql)


def _copies(df, copies):
    return cp.oversample(df, copies).groupBy("split", "label").agg(F.count("*").alias("rows"))


@query("oversample_v1", _oversampled("CASE WHEN lang = 'es' THEN 2 ELSE 1 END"))
def _(spark, d):
    return _copies(split_rows(spark, d), cp.copies_v1(F.col("lang") == "es"))


@query("oversample_v2", _oversampled("1 + (label = 1)::INT + (lang = 'es')::INT"))
def _(spark, d):
    return _copies(split_rows(spark, d), cp.copies_v2(F.col("label") == 1, F.col("lang") == "es"))


@query("oversample_v4", _oversampled("(CASE WHEN lang = 'es' THEN 4 ELSE 1 END) * (CASE WHEN label = 1 THEN 2 ELSE 1 END)"))
def _(spark, d):
    return _copies(split_rows(spark, d), cp.copies_v4(F.col("lang") == "es", F.col("label") == 1))


@query(
    "augment_union",
    f"""WITH {LABELLED}, grown AS (SELECT doc_id, lang, label, text FROM labelled UNION ALL
    SELECT doc_id, 'fr-plain', label, strip_accents(lower(text)) FROM labelled WHERE lang = 'fr')
    SELECT doc_id, lang, label, md5(text) AS text_md5 FROM grown""",
)
def _(spark, d):
    rows = labelled(spark, d).select("doc_id", "lang", "label", "text")
    grown = cp.augment_union(rows, F.col("lang") == "fr", tx.fold_accents(F.lower("text")), "text", "fr-plain")
    return grown.select("doc_id", "lang", "label", F.md5("text").alias("text_md5"))


@query("distinct_terms", "SELECT DISTINCT lower(trim(source)) AS term, lang FROM documents")
def _(spark, d):
    return cp.distinct_terms(read_table(spark, d, "documents"), "source", "lang")


@query(
    "corpus_profile",
    f"""WITH {LABELLED} SELECT lang, source, count(*) AS rows, round(avg(label), 6) AS toxic_share,
    count(*) FILTER (regexp_matches(text, '[ऀ-ॿ]')) AS devanagari, count(*) FILTER (regexp_matches(text, '[a-zA-Z]')) AS latin,
    count(*) FILTER (regexp_matches(text, '[ऀ-ॿ]') AND regexp_matches(text, '[a-zA-Z]')) AS both_scripts
    FROM labelled GROUP BY ROLLUP (lang, source)""",
)
def _(spark, d):
    return cp.corpus_profile(labelled(spark, d), ["lang", "source"], "label")


@query("topic_profile", f"WITH {LABELLED} SELECT source, count(*) AS rows, round(avg(label), 3) AS mean_label FROM labelled GROUP BY source")
def _(spark, d):
    return cp.topic_profile(labelled(spark, d), "source", "label")


@query(
    "prepare_corpus",
    f"""WITH {LABELLED}, long_enough AS (SELECT *, {_DIGEST} AS g FROM labelled WHERE length({q.dedupe('text')}) >= 3),
    deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) AS first_rn FROM long_enough) WHERE first_rn = 1),
    audited AS (SELECT doc_id, text, lang, source, label, g FROM deduped WHERE NOT (label = 0 AND ({_BAD}))),
    {_SPLIT.format(src='audited')},
    clean AS (SELECT * FROM split WHERE split = 'train' OR g NOT IN (SELECT g FROM split WHERE split = 'train')),
    grown AS (SELECT split, label, CASE WHEN split = 'train' THEN 1 + (label = 1)::INT + (lang = 'es')::INT ELSE 1 END AS c FROM clean)
    SELECT split, label, CAST(sum(c) AS BIGINT) AS rows FROM grown GROUP BY split, label""",
)
def _(spark, d):
    rows = cp.prepare_corpus(
        labelled(spark, d), "doc_id", hard_terms(spark), cp.copies_v2(F.col("label") == 1, F.col("lang") == "es")
    )
    return rows.groupBy("split", "label").agg(F.count("*").alias("rows"))


# ----------------------------------------------------------------------------------- evaluation


def scored(spark, d):
    """Predictions with gold labels; texts are dropped before the join."""
    predictions = documents(spark, d).select("doc_id", sc.proxy_score("text").alias("score"))
    return ev.join_predictions(predictions, read_table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")


@query("join_predictions", f"WITH {q.SCORED} SELECT doc_id, toxic, round(score, 6) AS score FROM scored")
def _(spark, d):
    return scored(spark, d).select("doc_id", "toxic", F.round("score", 6).alias("score"))


_CM = f"""{q.SCORED}, cm AS (SELECT count(*) FILTER (score >= 0.5 AND toxic = 1) AS tp, count(*) FILTER (score >= 0.5 AND toxic = 0) AS fp,
  count(*) FILTER (score < 0.5 AND toxic = 0) AS tn, count(*) FILTER (score < 0.5 AND toxic = 1) AS fn,
  count(*) FILTER (score >= 0.9 AND toxic = 1) AS btp FROM scored),
metrics AS (SELECT tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round(coalesce(btp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS block_recall FROM cm)"""


@query("confusion_metrics", f"WITH {_CM} SELECT * FROM metrics")
def _(spark, d):
    return ev.confusion_metrics(scored(spark, d), "score", "toxic", 0.5, 0.9)


@query("acceptance_gate", f"WITH {_CM} SELECT *, precision >= 0.7 AND recall >= 0.7 AS passed FROM metrics")
def _(spark, d):
    return ev.acceptance_gate(ev.confusion_metrics(scored(spark, d), "score", "toxic", 0.5, 0.9))


_SWEEP = f"""{q.SCORED}, grid AS (SELECT i / 100.0::DOUBLE AS t FROM range(5, 96) r(i)),
counts AS (SELECT t, count(*) FILTER (score >= t) AS n_pred, count(*) FILTER (score >= t AND toxic = 1) AS tp, count(*) FILTER (toxic = 1) AS pos FROM grid, scored GROUP BY t),
sweep AS (SELECT t AS threshold, n_pred, tp, coalesce(tp / nullif(n_pred, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(pos, 0)::DOUBLE, 0) AS recall,
  coalesce(2 * tp / nullif(n_pred + pos, 0)::DOUBLE, 0) AS f1 FROM counts)"""


@query(
    "threshold_sweep",
    f"WITH {_SWEEP} SELECT threshold, n_pred, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sweep",
)
def _(spark, d):
    s = ev.threshold_sweep(scored(spark, d), "score", "toxic")
    return s.select("threshold", "n_pred", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "pick_thresholds",
    f"""WITH {_SWEEP},
    flag AS (SELECT * FROM sweep WHERE f1 > 0 ORDER BY f1 DESC, threshold LIMIT 1),
    good AS (SELECT *, 1 AS pr FROM sweep WHERE precision >= 0.8 AND n_pred >= 25 ORDER BY threshold DESC LIMIT 1),
    fb AS (SELECT *, 2 AS pr FROM sweep WHERE precision > 0 AND n_pred >= 25 ORDER BY threshold DESC LIMIT 1),
    cov AS (SELECT *, 3 AS pr FROM sweep WHERE n_pred >= 25 ORDER BY threshold LIMIT 1),
    block AS (SELECT * FROM (SELECT * FROM good UNION ALL SELECT * FROM fb UNION ALL SELECT * FROM cov) ORDER BY pr LIMIT 1)
    SELECT coalesce((SELECT threshold FROM flag), 0.5) AS flag_threshold, round(coalesce((SELECT precision FROM flag), 0), 4) AS flag_precision,
    round(coalesce((SELECT recall FROM flag), 0), 4) AS flag_recall, round(coalesce((SELECT f1 FROM flag), 0), 4) AS flag_f1,
    coalesce((SELECT threshold FROM block), 0.9) AS block_threshold, round(coalesce((SELECT precision FROM block), 0), 4) AS block_precision,
    round(coalesce((SELECT recall FROM block), 0), 4) AS block_recall, round(coalesce((SELECT f1 FROM block), 0), 4) AS block_f1,
    (SELECT round(max(score), 3) FROM scored) AS max_score""",
)
def _(spark, d):
    return ev.pick_thresholds(ev.threshold_sweep(scored(spark, d), "score", "toxic"))


_TWO = f"""a AS (SELECT doc_id, {q.proxy('text')} AS score_a FROM documents WHERE lang <> 'de'),
b AS (SELECT doc_id, {q.proxy("text || lang")} AS score_b FROM documents WHERE lang <> 'fr'),
both_sides AS (SELECT doc_id, score_a, score_b, abs(score_a - score_b) AS drift FROM a FULL JOIN b USING (doc_id))"""


def _versions(spark, d):
    docs = documents(spark, d, "doc_id", "text", "lang")
    a = docs.filter("lang <> 'de'").select("doc_id", sc.proxy_score("text").alias("score"))
    b = docs.filter("lang <> 'fr'").select("doc_id", sc.proxy_score(F.concat("text", "lang")).alias("score"))
    return ev.compare_versions(a, b, "doc_id")


@query(
    "compare_model_versions",
    f"WITH {_TWO} SELECT doc_id, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b, round(drift, 6) AS drift FROM both_sides",
)
def _(spark, d):
    return _versions(spark, d).select("doc_id", *[F.round(c, 6).alias(c) for c in ("score_a", "score_b", "drift")])


@query(
    "model_drift_summary",
    f"""WITH {_TWO} SELECT count(*) AS rows, count(*) FILTER (drift IS NULL) AS one_sided, round(max(drift), 6) AS max_drift,
    round(avg(drift), 6) AS mean_drift, count(*) FILTER (drift > 0.05) AS beyond_tolerance FROM both_sides""",
)
def _(spark, d):
    return ev.drift_summary(_versions(spark, d))


@query(
    "probe_expectations",
    f"""WITH {q.SCORED}, p AS (SELECT {q.action_of('score', 0.9, 0.5)} AS action, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'clean' ELSE 'mild' END AS expect
      FROM scored JOIN (SELECT doc_id, quality FROM labels) USING (doc_id))
    SELECT expect, count(*) AS rows, count(*) FILTER (CASE expect WHEN 'toxic' THEN action <> 'clean' WHEN 'clean' THEN action = 'clean' ELSE action <> 'block' END) AS met FROM p GROUP BY expect""",
)
def _(spark, d):
    p = scored(spark, d).join(read_table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    expect = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("mild")
    probe = p.select(sc.text_action("score").alias("action"), expect.alias("expect"))
    return ev.probe_expectations(probe, "action", "expect")


_LABEL_SCORES = f"{q.proxy('text')} AS a, {q.proxy('lang || text')} AS b, {q.proxy('source || text')} AS c"


@query(
    "label_binarize",
    f"""WITH s AS (SELECT doc_id, {_LABEL_SCORES} FROM documents)
    SELECT doc_id, round(greatest(a, c), 6) AS toxic_score, CASE WHEN a >= 0.7 OR b >= 0.55 THEN 1 ELSE 0 END AS grouped,
    CASE WHEN a >= 0.5 THEN 1 ELSE 0 END AS marked FROM s""",
)
def _(spark, d):
    from modwarden.sources.readers import binarize_mark

    s = documents(spark, d, "doc_id", "text", "lang", "source").select(
        "doc_id", sc.proxy_score("text").alias("a"),
        sc.proxy_score(F.concat("lang", "text")).alias("b"), sc.proxy_score(F.concat("source", "text")).alias("c"),
    )
    named = F.create_map(F.lit("Toxic"), "a", F.lit("not_toxic"), "b", F.lit("hate speech"), "c", F.lit("other"), F.lit(1.0))
    groups = F.create_map(F.lit("threat"), "a", F.lit("insult"), "b", F.lit("neutral"), "c")
    return s.select(
        "doc_id",
        F.round(sc.toxic_label_score(named), 6).alias("toxic_score"),
        sc.grouped_label_binarize(groups).alias("grouped"),
        binarize_mark(F.when(F.col("a") >= 0.5, "HOF").otherwise("NONE")).alias("marked"),
    )
