"""Page, host and identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modwarden import fixed_values as fv
from modwarden.functions import html as hm
from modwarden.functions import identity as idn
from modwarden.operators import pages as pg
from modwarden.plans import sql as q
from modwarden.plans.registry import query
from modwarden.profiles import PartPolicy
from modwarden.sources.readers import read_pages, read_table

WHOLE = PartPolicy.whole()


def pages(spark, d):
    return read_pages(spark, d)


def parts(spark, d, policy=WHOLE):
    return pg.part_rows(pages(spark, d), policy)


@query("extract_parts", f"WITH {q.PARTS} SELECT page_id, ix, tag, md5(text) AS text_md5 FROM parts")
def _(spark, d):
    return parts(spark, d).select("page_id", F.col("ix").cast("long").alias("ix"), "tag", F.md5("text").alias("text_md5"))


@query(
    "extract_parts_limited",
    f"""WITH {q.PARTS} SELECT page_id, ix, tag, md5(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '…' ELSE text END) AS text_md5 FROM parts WHERE ix < 60""",
)
def _(spark, d):
    rows = parts(spark, d, PartPolicy())
    return rows.select("page_id", F.col("ix").cast("long").alias("ix"), "tag", F.md5("text").alias("text_md5"))


_JOINED = f"{q.PARTS}, joined AS (SELECT page_id, any_value(url) AS url, string_agg(text, chr(10) ORDER BY ix) AS text, count(*) AS parts FROM parts GROUP BY page_id)"


@query("join_parts", f"WITH {_JOINED} SELECT page_id, parts, md5(text) AS text_md5 FROM joined")
def _(spark, d):
    return pg.join_part_rows(parts(spark, d), "page_id").select("page_id", "parts", F.md5("text").alias("text_md5"))


@query(
    "dominant_part",
    f"WITH {q.PARTS} SELECT page_id, ix, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(text) DESC, ix) AS rn FROM parts) WHERE rn = 1",
)
def _(spark, d):
    best = pg.dominant_part(parts(spark, d), "page_id")
    return best.select("page_id", F.col("ix").cast("long").alias("ix"), F.md5("text").alias("text_md5"))


@query(
    "split_long_unit",
    f"""WITH {_JOINED}, kids AS (SELECT page_id, text, count(*) OVER (PARTITION BY page_id) AS n FROM parts WHERE length(text) >= 140),
    u AS (SELECT k.page_id, k.text FROM kids k JOIN joined j USING (page_id) WHERE length(j.text) > 700 AND k.n >= 2
      UNION ALL SELECT j.page_id, j.text FROM joined j WHERE NOT (length(j.text) > 700 AND (SELECT count(*) FROM kids k WHERE k.page_id = j.page_id) >= 2))
    SELECT page_id, md5(text) AS text_md5 FROM u""",
)
def _(spark, d):
    units = pages(spark, d).select("page_id", hm.extract_parts("html", WHOLE).alias("p"))
    children = F.transform("p", lambda p: p["text"])
    out = units.select("page_id", pg.split_long_unit(pg.join_parts(F.col("p"), None), children).alias("units"))
    rows = out.select("page_id", F.explode_outer("units").alias("text"))
    return rows.filter("text <> ''").select("page_id", F.md5("text").alias("text_md5"))


_IMGS = "regexp_extract_all(html, '(?i)<img\\b[^>]*?\\bsrc\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)"


@query(
    "content_key",
    f"""WITH {q.SITED}, {_JOINED}, keyed AS (SELECT s.page_id, s.host, s.site_id, coalesce(j.text, '') AS text,
      CASE WHEN regexp_matches(s.url, '/p/|/status/|\\?v=|/comments/') AND length(s.url) < 200 THEN 'href:' || s.url ELSE '' END AS sid
      FROM sited s LEFT JOIN joined j USING (page_id))
    SELECT page_id, host, site_id, sha256(site_id || ':' || sid || ':' || text || '::' || length(text)) AS unit_key FROM keyed""",
)
def _(spark, d):
    return pg.page_units(pages(spark, d), WHOLE).select("page_id", "host", "site_id", "unit_key")


# Pages placed on the routed sites by the length of their address.
_SITES = """v AS (SELECT page_id, CASE length(url) % 6 WHEN 0 THEN 'https://x.com/u/status/' || page_id || '?s=1' WHEN 1 THEN 'https://www.instagram.com/reel/r' || page_id || '/'
  WHEN 2 THEN 'https://m.youtube.com/watch?a=1&v=v_' || page_id WHEN 3 THEN 'https://old.reddit.com/r/a/comments/c' || page_id || '/t?x=1'
  WHEN 4 THEN 'https://www.shop' || page_id % 5 || '.co.uk/p/' || page_id ELSE url END AS url FROM pages)"""


def sited(spark, d):
    p = pages(spark, d).select("page_id", "url")
    n, pid = F.length("url") % 6, F.col("page_id").cast("string")
    url = (
        F.when(n == 0, F.concat(F.lit("https://x.com/u/status/"), pid, F.lit("?s=1")))
        .when(n == 1, F.concat(F.lit("https://www.instagram.com/reel/r"), pid, F.lit("/")))
        .when(n == 2, F.concat(F.lit("https://m.youtube.com/watch?a=1&v=v_"), pid))
        .when(n == 3, F.concat(F.lit("https://old.reddit.com/r/a/comments/c"), pid, F.lit("/t?x=1")))
        .when(n == 4, F.concat(F.lit("https://www.shop"), (F.col("page_id") % 5).cast("string"), F.lit(".co.uk/p/"), pid))
        .otherwise(F.col("url"))
    )
    out = p.select("page_id", url.alias("url"))
    return out.withColumn("host", idn.url_host("url")).withColumn("site_id", idn.site_route("host"))


_SITED2 = f"{_SITES}, {q.SITED.replace('FROM pages', 'FROM v').replace('html, ', '')}"


@query("site_route", f"WITH {_SITED2} SELECT host, site_id, count(*) AS n FROM sited GROUP BY host, site_id")
def _(spark, d):
    return sited(spark, d).groupBy("host", "site_id").agg(F.count("*").alias("n"))


@query(
    "site_stable_id",
    f"""WITH {_SITED2} SELECT page_id, CASE site_id WHEN 'twitter' THEN regexp_extract(url, 'status/(\\d+)', 1) WHEN 'instagram' THEN regexp_extract(url, '/(?:p|reel)/[^/?#]+', 0)
    WHEN 'youtube' THEN regexp_extract(url, '[?&]v=([\\w-]+)', 1) WHEN 'reddit' THEN regexp_extract(url, '^(?:[a-z]+://[^/]+)?(/[^?#]*comments/[^?#]+)', 1) ELSE '' END AS stable_id FROM sited""",
)
def _(spark, d):
    return sited(spark, d).select("page_id", idn.site_stable_id("site_id", "url").alias("stable_id"))


@query(
    "site_rules",
    f"""WITH {_SITED2} SELECT page_id, CASE site_id WHEN 'twitter' THEN regexp_extract(url, 'status/(\\d+)', 1) WHEN 'instagram' THEN regexp_extract(url, '/(?:p|reel)/[^/?#]+', 0)
    WHEN 'youtube' THEN regexp_extract(url, '[?&]v=([\\w-]+)', 1) WHEN 'reddit' THEN regexp_extract(url, '^(?:[a-z]+://[^/]+)?(/[^?#]*comments/[^?#]+)', 1) ELSE '' END AS stable_id,
    CASE WHEN site_id = 'generic' THEN 24 ELSE 4 END AS min_chars, site_id IN ('instagram', 'youtube') AS no_split, CASE WHEN site_id = 'youtube' THEN 1 ELSE 3 END AS max_images FROM sited""",
)
def _(spark, d):
    return pg.apply_site_rules(sited(spark, d), "site_id", "url").select("page_id", "stable_id", "min_chars", "no_split", "max_images")


@query("host_key", f"WITH {_SITED2} SELECT {q.host_key('host')} AS host_key, count(*) AS n FROM sited GROUP BY 1")
def _(spark, d):
    return sited(spark, d).groupBy(idn.host_key("host").alias("host_key")).agg(F.count("*").alias("n"))


PAUSED = ("reddit.com", "tiontion.example.com", "www.ththhe.example.com", "example.org", "shop1.co.uk", "uk")
_PAUSED = ", ".join(f"('{p}')" for p in PAUSED)


@query(
    "paused_host_filter",
    f"""WITH {_SITED2}, paused(entry) AS (VALUES {_PAUSED}), k AS (SELECT page_id, host, {q.host_key('host')} AS hk FROM sited)
    SELECT page_id, host FROM k WHERE NOT EXISTS (SELECT 1 FROM paused WHERE entry = hk OR entry = host OR ends_with(hk, '.' || entry))""",
)
def _(spark, d):
    paused = spark.createDataFrame([(p,) for p in PAUSED], "entry string")
    return pg.paused_host_filter(sited(spark, d), "host", paused).select("page_id", "host")


@query(
    "paused_host_filter_by_join",
    f"""WITH {_SITED2}, paused(entry) AS (VALUES {_PAUSED}), k AS (SELECT page_id, host, {q.host_key('host')} AS hk FROM sited)
    SELECT page_id, host FROM k WHERE NOT EXISTS (SELECT 1 FROM paused WHERE entry = hk OR entry = host OR ends_with(hk, '.' || entry))""",
)
def _(spark, d):
    paused = spark.createDataFrame([(p,) for p in PAUSED], "entry string")
    return pg.paused_host_filter(sited(spark, d), "host", paused, limit=0).select("page_id", "host")


@query(
    "scope_filter",
    f"WITH {_SITED2} SELECT site_id, count(*) AS n FROM sited WHERE regexp_matches(host, 'instagram\\.|twitter\\.|reddit\\.|youtube\\.|googlevideo\\.|(^|\\.)x\\.com$') GROUP BY site_id",
)
def _(spark, d):
    return pg.scope_filter(sited(spark, d), "host", "core").groupBy("site_id").agg(F.count("*").alias("n"))


@query(
    "admit_unit",
    f"WITH {_SITED2}, {q.PARTS} SELECT p.page_id, p.ix FROM parts p JOIN sited s USING (page_id) WHERE length(p.text) >= CASE WHEN s.site_id = 'generic' THEN 24 ELSE 4 END",
)
def _(spark, d):
    units = parts(spark, d).join(sited(spark, d).select("page_id", "site_id"), "page_id")
    return pg.admit_units(units, "site_id", "text").select("page_id", F.col("ix").cast("long").alias("ix"))


@query(
    "furniture_filter",
    f"""WITH {q.PARTS}, m AS (SELECT page_id, ix, CASE ix % 5 WHEN 0 THEN 'Like' WHEN 1 THEN '3h' WHEN 2 THEN 'View all 12 comments' ELSE text END AS text,
      CASE ix % 7 WHEN 3 THEN 'main-sidebar' WHEN 4 THEN 'innovative menu' ELSE 'body ' || tag END AS cls FROM parts)
    SELECT page_id, ix FROM m WHERE NOT regexp_matches(trim(text), '(?i)^(?:like|likes|reply|replies|follow|following|more|see translation|edited|view(?: all)?(?: \\d+)? comments?|\\d+[smhdwy])$')
    AND NOT regexp_matches(cls, '(?i)(^|[\\s_\\-])({"|".join(fv.FURNITURE_WORDS)})([\\s_\\-]|$)')""",
)
def _(spark, d):
    ix = F.col("ix").cast("long")
    m = parts(spark, d).select(
        "page_id", ix.alias("ix"),
        F.when(ix % 5 == 0, "Like").when(ix % 5 == 1, "3h").when(ix % 5 == 2, "View all 12 comments").otherwise(F.col("text")).alias("text"),
        F.when(ix % 7 == 3, "main-sidebar").when(ix % 7 == 4, "innovative menu").otherwise(F.concat(F.lit("body "), "tag")).alias("cls"),
    )
    return pg.furniture_filter(m, "text", "cls").select("page_id", "ix")


@query(
    "image_url_filter",
    """WITH u AS (SELECT page_id, [url || '/a.jpg', 'data:image/png;base64,x', url || '/logo.png', 'blob:' || url, url || '/a.jpg', 'HTTPS://cdn.test/' || page_id || '.jpg', url || '/photo-avatar.png', url || '/b.webp', url || '/c.jpg'] AS us FROM pages),
    x AS (SELECT page_id, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM u),
    f AS (SELECT page_id, u, min(i) AS i FROM x WHERE regexp_matches(u, '(?i)^https?:') AND NOT regexp_matches(u, '(?i)(^|[/_.\\-])(logo|icon|avatar|sprite|emoji|spacer|pixel|blank|placeholder|gravatar|favicon|badge|btn|button|banner-?ad|pixel-?1x1|transparent|spinner|loader|placeholder-?image)([/_.\\-]|$)') GROUP BY page_id, u),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rn FROM f)
    SELECT page_id, string_agg(u, ' ' ORDER BY i) AS images FROM r WHERE rn <= 3 GROUP BY page_id""",
)
def _(spark, d):
    url = F.col("url")
    pid = F.col("page_id").cast("string")
    urls = F.array(
        F.concat(url, F.lit("/a.jpg")), F.lit("data:image/png;base64,x"), F.concat(url, F.lit("/logo.png")),
        F.concat(F.lit("blob:"), url), F.concat(url, F.lit("/a.jpg")), F.concat(F.lit("HTTPS://cdn.test/"), pid, F.lit(".jpg")),
        F.concat(url, F.lit("/photo-avatar.png")), F.concat(url, F.lit("/b.webp")), F.concat(url, F.lit("/c.jpg")),
    )
    return pages(spark, d).select("page_id", F.array_join(idn.filter_image_urls(urls), " ").alias("images"))


# ------------------------------------------------------------------------------ unit detection

_SHAPE = "CASE WHEN length(text) < 20 THEN 0 WHEN length(text) < 60 THEN 1 WHEN length(text) < 300 THEN 2 WHEN length(text) < 1200 THEN 3 ELSE 2 END"


@query(
    "nested_dedupe",
    """WITH u AS (SELECT doc_id // 15 AS page_id, doc_id % 15 + 1 AS node, md5(doc_id::VARCHAR) AS rank FROM documents),
    l AS (SELECT page_id, node, rank, unnest([node // 2, node // 4, node // 8]) AS a FROM u)
    SELECT page_id, node FROM u WHERE NOT EXISTS (SELECT 1 FROM l JOIN u up ON up.page_id = l.page_id AND up.node = l.a WHERE l.page_id = u.page_id AND l.node = u.node AND up.rank < l.rank)""",
)
def _(spark, d):
    # Fifteen elements a page as a binary tree: the children of ``k`` are ``2k`` and ``2k + 1``. Their numbers in the order
    # of a page, and the last number inside each:
    order = (0, 1, 8, 2, 5, 9, 12, 3, 4, 6, 7, 10, 11, 13, 14)
    last = (14, 7, 14, 4, 7, 11, 14, 3, 4, 6, 7, 10, 11, 13, 14)
    heap = (F.col("doc_id") % 15).cast("int")
    u = read_table(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 15).alias("page_id"), *(F.array(*map(F.lit, x))[heap].alias(n) for x, n in ((order, "node"), (last, "last"))),
        (F.col("doc_id") % 15 + 1).alias("heap"), F.md5(F.col("doc_id").cast("string")).alias("rank"),
    )
    return pg.drop_nested(u).select("page_id", F.col("heap").alias("node"))


@query(
    "repeated_group_units",
    f"""WITH {q.PARTS}, p AS (SELECT page_id, tag, text, length(text) AS n, {_SHAPE} AS shape FROM parts WHERE tag = 'p' AND length(text) >= 24),
    g AS (SELECT page_id, count(*) AS members, CAST(sum(n) AS BIGINT) AS chars, min(md5(text)) AS least_md5 FROM p GROUP BY page_id HAVING count(*) >= 2 AND count(DISTINCT shape) <= 2 AND avg(n) <= 4000)
    SELECT page_id, 'p|||' AS sig, members, chars, round(members * least(chars / members::DOUBLE, 600), 6) AS score, least_md5 FROM g""",
)
def _(spark, d):
    nodes = pg.node_table(pages(spark, d))
    units = pg.unit_texts(pg.repeated_group_units(nodes), nodes)
    return units.groupBy("page_id", "sig").agg(
        F.count("*").alias("members"), F.sum("text_len").cast("long").alias("chars"),
        F.round(F.max("group_score"), 6).alias("score"), F.min(F.md5("text")).alias("least_md5"),
    )


@query(
    "semantic_units",
    f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<article\\b.*?</article>')) AS h FROM pages),
    t AS (SELECT page_id, h, {q.squeeze(q.decode("regexp_replace(h, '<[^>]*>', '', 'g')"))} AS text FROM a)
    SELECT page_id, 'article' AS tag, count(*) AS units FROM t WHERE length(text) >= 24 OR contains(h, '<img') GROUP BY page_id""",
)
def _(spark, d):
    return pg.semantic_units(pg.node_table(pages(spark, d))).groupBy("page_id", "tag").agg(F.count("*").alias("units"))


def _raw(tag: str) -> str:
    text = q.decode(f"regexp_replace(regexp_extract(html, '(?is)<{tag}\\b.*?(?:</{tag}>|$)', 0), '<[^>]*>|<!--.*?-->', '', 'g')")
    return f"replace(replace({text}, '&copy;', '©'), '&middot;', '·')"


def _container(tag: str) -> str:
    return q.squeeze(_raw(tag))


@query(
    "section_units",
    f"""WITH t AS (SELECT page_id, length({_container('article')}) AS a, length({_container('body')}) AS b, length({_raw('article')}) AS ra, length({_raw('body')}) AS rb FROM pages)
    SELECT page_id, CASE WHEN ra >= 24 THEN 'article' ELSE 'body' END AS tag, CASE WHEN ra >= 24 THEN a ELSE b END AS text_len FROM t WHERE ra > 400 OR rb > 400""",
)
def _(spark, d):
    return pg.section_units(pg.node_table(pages(spark, d))).select("page_id", "tag", F.col("text_len").cast("long").alias("text_len"))


_UNITS = f"""WITH a AS (SELECT page_id, regexp_extract(html, '(?is)<article>(.*?)</article>', 1) AS h FROM pages),
    s AS (SELECT page_id, unnest(string_split_regex(h, '</?(?:p|h1)>')) AS seg, generate_subscripts(string_split_regex(h, '</?(?:p|h1)>'), 1) AS pos FROM a),
    t AS (SELECT page_id, pos, {q.squeeze(q.decode("regexp_replace(seg, '<[^>]*>', '', 'g')"))} AS text FROM s),
    b AS (SELECT * FROM t WHERE length(text) >= 12),
    u AS (SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS text, count(*) FILTER (length(text) >= 140) AS big FROM b GROUP BY page_id),
    k AS (SELECT page_id, length(text) > 700 AND big >= 2 AS cut, text FROM u)
    SELECT page_id, false AS was_split, text FROM k WHERE NOT cut AND length(text) >= 24
    UNION ALL SELECT b.page_id, true, b.text FROM b JOIN k USING (page_id) WHERE cut AND length(b.text) >= 140"""


@query(
    "page_units_detected",
    f"WITH units AS ({_UNITS}) SELECT page_id, was_split, sha256('generic:' || CASE WHEN regexp_matches(url, '/p/|/status/|\\?v=|/comments/') AND length(url) < 200 THEN 'href:' || url ELSE '' END "
    "|| ':' || text || '::' || length(text)) AS unit_key, md5(text) AS text_md5 FROM units JOIN pages USING (page_id)",
)
def _(spark, d):
    units = pg.detected_units(pages(spark, d).select("page_id", "url", "html"))
    return units.select("page_id", "was_split", "unit_key", F.md5("text").alias("text_md5"))


@query(
    "unit_parts",
    f"""WITH a AS (SELECT page_id, regexp_extract(html, '(?is)<article>(.*?)</article>', 1) AS h FROM pages),
    s AS (SELECT page_id, unnest(string_split_regex(h, '</?(?:p|h1)>')) AS seg, generate_subscripts(string_split_regex(h, '</?(?:p|h1)>'), 1) AS pos FROM a),
    t AS (SELECT page_id, pos, {q.squeeze(q.decode("regexp_replace(seg, '<[^>]*>', '', 'g')"))} AS text FROM s)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS ix, length(text) AS chars, md5(text) AS text_md5 FROM t WHERE length(text) >= 12""",
)
def _(spark, d):
    """Every part of every article, in the order of the page."""
    nodes = pg.node_table(pages(spark, d))
    parts = pg.unit_parts(nodes.filter("tag = 'article'").select("page_id", "node"), nodes)
    part = parts.select("page_id", F.posexplode("parts").alias("ix", "p"))
    return part.select("page_id", (F.col("ix") + 1).alias("ix"), F.length("p.text").cast("long").alias("chars"), F.md5("p.text").alias("text_md5"))


@query(
    "detect_units",
    f"""WITH t AS (SELECT page_id, {_container('article')} AS a, {_container('body')} AS b, {_raw('body')} AS rb FROM pages)
    SELECT page_id, CASE WHEN length(a) >= 24 THEN 'semantic' ELSE 'section' END AS tier, CASE WHEN length(a) >= 24 THEN 'article' ELSE 'body' END AS tag,
    md5(CASE WHEN length(a) >= 24 THEN a ELSE b END) AS text_md5 FROM t WHERE length(a) >= 24 OR length(rb) > 400""",
)
def _(spark, d):
    nodes = pg.node_table(pages(spark, d))
    return pg.unit_texts(pg.detect_units(nodes), nodes).select("page_id", "tier", "tag", F.md5("text").alias("text_md5"))
