"""Pieces of check SQL shared by several queries (DuckDB has no backreferences)."""

from __future__ import annotations

import string

from modwarden import fixed_values as fv
from modwarden.operators.lexicon import default_lexicon_rows

LETTERS = string.ascii_lowercase


def collapse(expr: str, least: int, keep: int) -> str:
    for ch in LETTERS:
        expr = f"regexp_replace({expr}, '{ch}{{{least},}}', '{ch * keep}', 'g')"
    return expr


def norm(expr: str) -> str:
    return collapse(f"regexp_replace(strip_accents(lower({expr})), '[^a-zऀ-ॿ]+', ' ', 'g')", 3, 2)


def single(expr: str) -> str:
    return collapse(expr, 2, 1)


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def dedupe(expr: str) -> str:
    return squeeze(f"lower({expr})")


def proxy(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 7))::BIGINT / 268435455.0::DOUBLE)"


def action_of(expr: str, block: float, flag: float) -> str:
    return f"CASE WHEN {expr} >= {block} THEN 'block' WHEN {expr} >= {flag} THEN 'flag' ELSE 'clean' END"


def rank_of(expr: str) -> str:
    return f"CASE {expr} WHEN 'block' THEN 2 WHEN 'flag' THEN 1 ELSE 0 END"


def name_of(expr: str) -> str:
    return f"CASE {expr} WHEN 2 THEN 'block' WHEN 1 THEN 'flag' ELSE 'clean' END"


# Words of the test texts that the default lexicon leaves to the model, as a second list.
DEMO_ROWS = [
    ("stupid", "token", "demo", 2, "flag"),
    ("idiot", "token", "demo", 4, "block"),
    ("moron", "token", "demo", 2, "flag"),
    ("scum", "token", "demo", 2, "flag"),
    ("disgusting", "token", "demo", 5, "block"),
    ("pathetic", "phrase", "demo", 2, "flag"),
    ("worthless", "phrase", "demo", 4, "block"),
    ("of the", "phrase", "demo", 2, "flag"),
    ("trash", "token", "demo", 1, "mild"),
]
LEXICON_ROWS = default_lexicon_rows() + DEMO_ROWS
LEXICON_VALUES = ", ".join(f"('{t}','{k}','{g}',{s},'{r}')" for t, k, g, s, r in LEXICON_ROWS)
LEXICON = f"lexicon(term, kind, lang, severity, tier) AS (VALUES {LEXICON_VALUES})"
CODES = (
    "codes AS (SELECT term, kind, min(CASE WHEN lang = 'en' THEN 0 ELSE 2 END + CASE WHEN tier = 'block' THEN 0 "
    "ELSE 1 END) AS code FROM lexicon WHERE tier IN ('block','flag') GROUP BY term, kind)"
)
TOKEN_HITS = f"""
normed AS MATERIALIZED (SELECT doc_id, {norm('text')} AS norm FROM documents),
paired AS (SELECT doc_id, unnest(string_split(trim(norm), ' ')) AS w, unnest(string_split(trim({single('norm')}), ' ')) AS v FROM normed),
token_codes AS (SELECT term, code FROM codes WHERE kind = 'token'),
keyed AS (SELECT doc_id, w, v, coalesce(a.code * 2, 99) AS k1, coalesce(b.code * 2 + 1, 99) AS k2
  FROM paired LEFT JOIN token_codes a ON a.term = w LEFT JOIN token_codes b ON b.term = v
  WHERE a.code IS NOT NULL OR b.code IS NOT NULL),
token_hits AS (SELECT doc_id, CASE WHEN k1 <= k2 THEN w ELSE v END AS term,
  CASE WHEN (least(k1, k2) // 2) % 2 = 0 THEN 'block' ELSE 'flag' END AS tier FROM keyed)"""
PHRASE_HITS = """
phrase_hits AS (SELECT doc_id, term, CASE WHEN code % 2 = 0 THEN 'block' ELSE 'flag' END AS tier
  FROM normed JOIN codes ON codes.kind = 'phrase' AND contains(norm, codes.term))"""
HITS = f"WITH {LEXICON}, {CODES}, {TOKEN_HITS}, {PHRASE_HITS}"
VERDICTS = f"""{HITS},
all_hits AS (SELECT * FROM token_hits UNION ALL SELECT * FROM phrase_hits),
per_doc AS (SELECT doc_id, count(*) AS hits, max(CASE WHEN tier = 'block' THEN 2 ELSE 1 END) AS r FROM all_hits GROUP BY doc_id),
lex_verdicts AS (SELECT d.doc_id, d.text, coalesce(hits, 0) AS hits,
  CASE coalesce(r, 0) WHEN 2 THEN 'block' WHEN 1 THEN 'flag' ELSE 'none' END AS lexicon_action
  FROM documents d LEFT JOIN per_doc USING (doc_id))"""

# A verdict log, derived from the event stream.
EV = """
ev AS (SELECT event_id AS seq, epoch_us(ts) AS ts_us, user_id, 'u' || user_id AS key, event_type, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE WHEN value >= 100 THEN 'block' WHEN value >= 50 THEN 'flag' ELSE 'clean' END AS action,
  CASE event_type WHEN 'error' THEN 'lexicon' WHEN 'signup' THEN 'text' WHEN 'purchase' THEN 'image'
    WHEN 'view' THEN 'ocr-text' ELSE 'lexicon-ocr' END AS source,
  'img' || (CAST(json_extract_string(props, '$.k') AS BIGINT) // 10) AS image_key,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90 THEN 'v1' ELSE 'v2' END AS policy_version,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 20 THEN '1:0:1' ELSE '1:1:1' END AS settings_policy
  FROM events)"""
SCORED = f"scored AS (SELECT d.doc_id, l.toxic, {proxy('d.text')} AS score FROM documents d JOIN labels l USING (doc_id))"

HOST = "lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), ''))"
SUFFIXES = ", ".join(f"'{s}'" for s in fv.TWO_LABEL_SUFFIXES)


def host_key(h: str) -> str:
    parts = f"list_filter(string_split(regexp_replace(lower({h}), '^www\\.', ''), '.'), lambda x: x <> '')"
    return (
        f"CASE WHEN len({parts}) <= 2 THEN regexp_replace(lower({h}), '^www\\.', '') "
        f"WHEN array_to_string({parts}[-2:], '.') IN ({SUFFIXES}) THEN array_to_string({parts}[-3:], '.') "
        f"ELSE array_to_string({parts}[-2:], '.') END"
    )


SITED = f"""
sited AS (SELECT page_id, url, html, {HOST} AS host,
  CASE WHEN contains({HOST}, 'instagram') THEN 'instagram'
    WHEN contains({HOST}, 'twitter') OR {HOST} = 'x.com' OR ends_with({HOST}, '.x.com') THEN 'twitter'
    WHEN {HOST} = 'reddit.com' OR ends_with({HOST}, '.reddit.com') THEN 'reddit'
    WHEN contains({HOST}, 'youtube') THEN 'youtube' ELSE 'generic' END AS site_id FROM pages)"""


def drop_chrome(expr: str) -> str:
    from modwarden.functions.html import PAIRED_CHROME

    expr = f"regexp_replace({expr}, '(?is)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", *[t for t in PAIRED_CHROME if t not in ("script", "style")]):
        expr = f"regexp_replace({expr}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    return expr


def decode(expr: str) -> str:
    for name, ch in (("&nbsp;?", " "), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "''"), ("&apos;", "''"), ("&amp;?", "&")):
        expr = f"regexp_replace({expr}, '{name}', '{ch}', 'g')"
    return expr


BOUNDARY = r"(?i)</?(?:article|section|main|footer|header)\b[^>]*>|</(?:body|ul|ol|dl|table)\s*>"


def _chain(tags: tuple[str, ...], source: str, suffix: str) -> str:
    names = "|".join(tags)
    return f"""
marked{suffix} AS MATERIALIZED (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace({drop_chrome('html')},
    '(?i)<({names})\\b[^>]*>', chr(2) || chr(1) || '\\1' || chr(3), 'g'), '(?i)</({names})\\s*>', chr(2), 'g'),
    '{BOUNDARY}', chr(2), 'g') AS m FROM {source}),
segs{suffix} AS (SELECT page_id, url, unnest(string_split(m, chr(2))) AS s, generate_subscripts(string_split(m, chr(2)), 1) AS pos FROM marked{suffix}),
blocks{suffix} AS (SELECT page_id, url, pos, lower(substr(s, 2, strpos(s, chr(3)) - 2)) AS tag,
    {squeeze(decode("regexp_replace(substr(s, strpos(s, chr(3)) + 1), '<[^>]*>', '', 'g')"))} AS text
  FROM segs{suffix} WHERE starts_with(s, chr(1))),
parts{suffix} AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS ix, tag, text FROM blocks{suffix} WHERE length(text) >= 12)"""


PARTS = (
    _chain(fv.BLOCK_TAGS, "pages", "1") + ","
    + _chain(fv.FALLBACK_TAGS, "(SELECT * FROM pages WHERE page_id NOT IN (SELECT page_id FROM parts1))", "2")
    + ",\nparts AS (SELECT * FROM parts1 UNION ALL SELECT * FROM parts2)"
)

# Windows of at most six, over trimmed texts.
_END = "[.!?…][\"''\\)\\]]?\\s|\\n+"


def window_end(t: str, start: str) -> str:
    tail = f"substr({t}, {start} + 162, 133)"
    last = f"regexp_extract_all({tail}, '{_END}')[-1]"
    return (
        f"CASE WHEN {start} + 294 >= length({t}) THEN length({t}) "
        f"WHEN {last} IS NULL THEN {start} + 294 "
        f"ELSE {start} + 161 + length({tail}) - strpos(reverse({tail}), reverse({last})) + 1 END"
    )


WINDOWS = f"""
texts AS MATERIALIZED (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
sized AS (SELECT doc_id, t, length(t) AS n, ceil((length(t) - 294) / 221.0) + 1 AS needed FROM texts WHERE length(t) > 0),
walk(doc_id, t, n, ix, s, e) AS (
  SELECT doc_id, t, n, 0, 0, CASE WHEN n <= 294 THEN n ELSE {window_end('t', '0')} END FROM sized WHERE needed <= 6 OR n <= 294
  UNION ALL
  SELECT doc_id, t, n, ix + 1, s2, {window_end('t', 's2')} FROM (SELECT *, greatest(s + 1, e - 73) AS s2 FROM walk WHERE e < n AND ix < 5)),
even AS (SELECT doc_id, t, n, i AS ix, CAST(floor(i * ((n - 294) / 5.0::DOUBLE) + 0.5) AS BIGINT) AS s FROM sized, range(6) r(i) WHERE needed > 6 AND n > 294),
spans AS (SELECT doc_id, t, ix, s, e FROM walk UNION ALL SELECT doc_id, t, ix, s, {window_end('t', 's')} AS e FROM even),
cuts AS (SELECT doc_id, s AS start_at, e AS end_at, regexp_replace(substr(t, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS text, ix FROM spans),
windows AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS ix, start_at, end_at, text FROM cuts WHERE text <> '')"""
