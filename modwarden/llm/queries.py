"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

import public_tokenizers

from modwarden.llm import balltree, chats, collocations, decontaminate, infill, langid, pieces, quality, simhash, substrings, toxicity, warc, webp
from modwarden.sources.readers import read_table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op4_substring_dedup")
def op4(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_simhash_near_dedup")
def op9(spark, d):
    found = simhash.near_duplicates(read_table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex64("fp").alias("fingerprint"), "component_id")


@query("op5_sentencepiece")
def op5(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_webp_media")
def op10(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return webp.to_media(docs, with_media=False).drop("text")


def fold(modulus: int, rest: int, id_col: str = "doc_id"):
    """Whether a row is held out, by the checksum of its id as text."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)) == rest


@query("op3_language_id")
def op3(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold(4, 2), F.lit(False)))
    model = langid.fit(docs.filter("not held_out"))
    found = langid.predict(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "entropy")


@query("op1_toxicity")
def op1(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(fold(4, 2), F.lit(False)))
    learned = docs.filter("not held_out")
    labels = read_table(spark, d, "labels").filter(~F.coalesce(fold(4, 2), F.lit(False)))
    index = toxicity.fit(learned, labels, all_docs=docs)
    return toxicity.predict(docs, index).drop("text")


_CHATS = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS l FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM c)),
kept AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, any_value(n) AS n_turns FROM c ANTI JOIN p USING (l) GROUP BY l),
r AS (SELECT conv_id, pos // 256 AS segment, any_value(n_turns) AS n_turns, any_value(copies) AS copies,
             string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
      FROM t JOIN kept USING (conv_id) GROUP BY ALL)
SELECT conv_id, segment, n_turns, copies, length(rendered) AS n_chars, sha256(rendered) AS rendered_sha256 FROM r
"""


@query("op2_chat_formatting", _CHATS)
def op2(spark, d):
    found = chats.format_chats(read_table(spark, d, "conversations"))
    return found.select("conv_id", "segment", "n_turns", "copies", F.length("rendered").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


_PAGES = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""


@query("op6_warc", _PAGES)
def op6(spark, d):
    found = warc.round_trip(read_table(spark, d, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_decontamination")
def op7(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return decontaminate.find(docs, read_table(spark, d, "benchmark")).drop("text")


@query("op8_quality")
def op8(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(fold(5, 0), F.lit(False)))
    labels = read_table(spark, d, "labels").filter(~F.coalesce(fold(5, 0), F.lit(False)))
    model = quality.fit(docs.filter("not held_out"), labels)
    return quality.predict(docs, model).drop("text")


_NEAREST = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND len(q.e) = len(c.e) AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op11_exact_top_k", _NEAREST)
def op11(spark, d):
    return balltree.top_k(read_table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


_PHRASES = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, m, unnest([ws[i : i + m - 1] for i in range(1, len(ws) - m + 2)]) AS w
      FROM p, (VALUES (1), (2), (3)) AS k(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, w, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, w, f AS a FROM f WHERE m > 1 AND f >= 10),
held AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([w[1:2], w[2:3]]) AS part FROM c WHERE m = 3) GROUP BY ALL),
cuts AS (SELECT c.*, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
         FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
         JOIN f x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1 : c.m]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
kept AS (SELECT best.lang, array_to_string(w, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN held ON held.lang = best.lang AND held.part = best.w
         WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", _PHRASES)
def op12(spark, d):
    found = collocations.collocations(read_table(spark, d, "documents"))
    return found.withColumn("rank", F.col("rank").cast("bigint"))


_INFILL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                  sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS h1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, array_to_string(u[1 : least(h1, h2)], '') AS p, array_to_string(u[least(h1, h2) + 1 : greatest(h1, h2)], '') AS m,
             array_to_string(u[greatest(h1, h2) + 1 : n], '') AS s,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""


@query("op13_fill_in_middle", _INFILL)
def op13(spark, d):
    found = infill.transform(read_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "infill.*")
    whole = infill.restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256")
    )
