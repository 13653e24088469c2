"""Keys, hosts, routes and media identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from modwarden import fixed_values as fv
from modwarden.functions.text import _col
from modwarden.profiles import SITE_RULES, SiteRule


def url_host(url: Column | str) -> Column:
    """Lower-case host without port; null for a string that is no URL."""
    return F.lower(F.nullif(F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def host_key(host: Column | str) -> Column:
    """Registrable domain: the last two labels, three under a two-label suffix."""
    h = F.regexp_replace(F.lower(F.coalesce(_col(host), F.lit(""))), r"^www\.", "")
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    n = F.size(labels)
    last_two = F.array_join(F.slice(labels, -2, 2), ".")
    last_three = F.array_join(F.slice(labels, -3, 3), ".")
    return (
        F.when(n <= 2, h)
        .when(last_two.isin(*fv.TWO_LABEL_SUFFIXES), last_three)
        .otherwise(last_two)
    )


def pause_candidates(host: Column | str) -> Column:
    """Every entry of a pause list that would pause this host: host, key, parents of the key."""
    host = _col(host)
    key = host_key(host)
    labels = F.split(key, r"\.")
    parents = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i < F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i + 1, F.greatest(F.size(labels) - i, F.lit(0))), "."),
    )
    return F.array_distinct(F.concat(F.array(host, key), parents))


def site_route(host: Column | str) -> Column:
    """Host to site id."""
    h = _col(host)
    return (
        F.when(h.contains("instagram"), "instagram")
        .when(h.contains("twitter") | (h == "x.com") | h.endswith(".x.com"), "twitter")
        .when((h == "reddit.com") | h.endswith(".reddit.com"), "reddit")
        .when(h.contains("youtube"), "youtube")
        .otherwise("generic")
    )


def is_core_host(host: Column | str) -> Column:
    h = _col(host)
    return h.rlike(fv.CORE_HOST_PATTERN) | h.isin("x.com", "reddit.com", "youtube.com", "instagram.com")


def site_stable_id(site: Column | str, url: Column | str, rules: Sequence[SiteRule] = SITE_RULES) -> Column:
    """Immutable id of a post as its URL shows it, by the rule of its site; empty when there is none."""
    site, url = _col(site), _col(url)
    out = F.lit("")
    for rule in rules:
        out = F.when(site == rule.site, F.regexp_extract(url, rule.id_pattern, rule.id_group)).otherwise(out)
    return out


def generic_stable_id(href: Column | str) -> Column:
    """Permalink of a generic unit when it has one of the known shapes and is short."""
    h = _col(href)
    known = h.rlike(r"/p/|/status/|\?v=|/comments/") & (F.length(h) < 200)
    return F.when(known, F.concat(F.lit("href:"), h)).otherwise("")


def content_key(prefix: Column | str, stable_id: Column, text: Column, image_urls: Column | None = None) -> Column:
    """Identity from content: independent of where the unit stands on its page."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    urls = F.lit("") if image_urls is None else F.array_join(image_urls, ",")
    text = F.coalesce(text, F.lit(""))
    return F.sha2(
        F.concat_ws(":", prefix, F.coalesce(stable_id, F.lit("")), text, urls, F.length(text).cast("string")), 256
    )


def source_key(url: Column | str, data: Column | str) -> Column:
    """Identity of one image: its URL, and a digest of its bytes where they were captured."""
    url, data = _col(url), _col(data)
    base = F.coalesce(url, F.lit(""))
    return F.when(F.coalesce(data, F.lit("")) == "", base).otherwise(
        F.concat(base, F.lit("|d:"), F.length(data).cast("string"), F.lit(":"), F.md5(data))
    )


def media_fingerprint(source_keys: Column | str, cap: int | None = None) -> Column:
    """Identity of an image set, in any order; ``cap`` looks at the first keys only, as the product does."""
    keys = _col(source_keys)
    return F.sha2(F.to_json(F.array_sort(F.slice(keys, 1, cap) if cap else keys)), 256)


def filter_image_urls(urls: Column | str, cap: int | None = 3) -> Column:
    """Web image addresses worth a look: http(s), no furniture names, distinct, first few."""
    name = r"(^|[/_.\-])(" + "|".join(fv.IMAGE_NAME_WORDS) + r")([/_.\-]|$)"
    kept = F.array_distinct(
        F.filter(_col(urls), lambda u: u.rlike("(?i)^https?:") & ~u.rlike("(?i)" + name))
    )
    return F.slice(kept, 1, cap) if cap else kept


def is_furniture(class_or_id: Column | str) -> Column:
    words = "|".join(fv.FURNITURE_WORDS)
    return F.coalesce(_col(class_or_id), F.lit("")).rlike(rf"(?i)(^|[\s_\-])({words})([\s_\-]|$)")


def is_ui_label(text: Column | str) -> Column:
    return F.trim(_col(text)).rlike("(?i)" + fv.UI_LABEL_PATTERN)


def is_gif(url: Column | str) -> Column:
    u = F.coalesce(_col(url), F.lit(""))
    return u.rlike(r"(?i)^data:image/gif;base64,") | u.rlike(r"(?i)\.gif(?:[?#]|$)")


def is_short_video(duration: Column | str, limit: float = 60.0) -> Column:
    d = _col(duration)
    return F.coalesce((d > 0) & (d <= limit) & ~F.isnan(d), F.lit(False))
