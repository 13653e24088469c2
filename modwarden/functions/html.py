"""Page markup: native part extraction, and the small tokenizer behind the node table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from modwarden import fixed_values as fv
from modwarden.functions.text import _col, let, squeeze
from modwarden.profiles import PartPolicy

VOID_TAGS = frozenset(
    ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
)
PAIRED_CHROME = tuple(t for t in fv.CHROME_TAGS if t not in VOID_TAGS)
OPEN, CLOSE, NAME_END = "\x01", "\x02", "\x03"
# Where a block ends even when its own end tag is missing.
BOUNDARY = r"(?i)</?(?:article|section|main|footer|header)\b[^>]*>|</(?:body|ul|ol|dl|table)\s*>"


def drop_chrome(html: Column | str) -> Column:
    """Markup without comments and without elements that are never content."""
    out = F.regexp_replace(_col(html), r"(?is)<!--.*?-->", "")
    for group in (("script", "style"), tuple(t for t in PAIRED_CHROME if t not in ("script", "style"))):
        out = F.regexp_replace(out, rf"(?is)<({'|'.join(group)})\b[^>]*>.*?</\1\s*>", "")
    return out


def decode_entities(c: Column) -> Column:
    """The common entities; the old ones also without their semicolon, as browsers read them."""
    for name, ch in (("&nbsp;?", " "), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'"), ("&apos;", "'"), ("&amp;?", "&")):
        c = F.regexp_replace(c, name, ch)
    return c


def _blocks(markup: Column, tags: tuple[str, ...]) -> Column:
    """Text of each block in page order as ``array<struct<tag,text>>``."""
    names = "|".join(tags)
    marked = F.regexp_replace(markup, rf"(?i)<({names})\b[^>]*>", f"{CLOSE}{OPEN}$1{NAME_END}")
    marked = F.regexp_replace(F.regexp_replace(marked, rf"(?i)</({names})\s*>", CLOSE), BOUNDARY, CLOSE)
    segments = F.filter(F.split(marked, CLOSE), lambda s: s.startswith(OPEN))
    return F.transform(
        segments,
        lambda s: F.struct(
            F.lower(F.regexp_extract(s, f"^{OPEN}([^{NAME_END}]*){NAME_END}", 1)).alias("tag"),
            squeeze(
                decode_entities(F.regexp_replace(F.regexp_replace(s, f"^{OPEN}[^{NAME_END}]*{NAME_END}", ""), "<[^>]*>", ""))
            ).alias("text"),
        ),
    )


def extract_parts(html: Column | str, policy: PartPolicy = PartPolicy()) -> Column:
    """Ordered text parts of a page: ``array<struct<ix,tag,text>>``.

    A block ends where the next one starts or its container ends, so unclosed paragraphs part as a
    browser parts them and the text of nested blocks belongs to the innermost one. Pages with no block at all fall back to
    plain containers.
    """

    def limited(blocks: Column) -> Column:
        kept = F.filter(blocks, lambda b: F.length(b["text"]) >= policy.min_chars)
        if policy.max_parts:
            kept = F.slice(kept, 1, policy.max_parts)

        def cut(b: Column) -> Column:
            if not policy.max_chars:
                return b["text"]
            return F.when(
                F.length(b["text"]) > policy.max_chars, F.concat(F.substring(b["text"], 1, policy.max_chars), F.lit("…"))
            ).otherwise(b["text"])

        return F.transform(
            kept, lambda b, i: F.struct(i.alias("ix"), b["tag"].alias("tag"), cut(b).alias("text"))
        )

    def of(markup: Column) -> Column:
        return let(
            limited(_blocks(markup, fv.BLOCK_TAGS)),
            lambda parts: F.when(F.size(parts) > 0, parts).otherwise(limited(_blocks(markup, fv.FALLBACK_TAGS))),
        )

    return let(drop_chrome(html), of)


def image_urls(html: Column | str) -> Column:
    """``src`` of every image element in page order."""
    return F.regexp_extract_all(_col(html), F.lit(r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']"""), F.lit(1))


NODE_SCHEMA = (
    "page_id long, node int, last int, parent int, tag string, attrs map<string,string>, "
    "start int, end int, text_len int, children int, child_ix int, visit int, chrome boolean, has_img boolean, "
    "part_text string, page_text string"
)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
KEPT_ATTRS = frozenset(("class", "id", "role", "data-testid", "data-test-id", "aria-label", "data-pagelet", "source", "src"))
NODES_AT_ONCE = 20_000
# Start tags that end an open paragraph, and the elements a paragraph is looked for through.
ENDS_PARAGRAPH = frozenset((
    "p", "div", "ul", "ol", "dl", "table", "section", "article", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5",
    "h6", "form", "nav", "aside", "footer", "header", "main", "figure", "address", "hr", "fieldset",
))
INLINE_TAGS = frozenset((
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "kbd", "mark", "q", "s", "small", "span",
    "strong", "sub", "sup", "u",
))
CLOSED_BY = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr",)),
    "td": frozenset(("td", "th", "tr")),
    "th": frozenset(("td", "th", "tr")),
    "option": frozenset(("option",)),
}


_FURNITURE = re.compile(rf"(?:^|[\s_\-])(?:{'|'.join(fv.FURNITURE_WORDS)})(?:[\s_\-]|$)", re.IGNORECASE)
# Tags as most are written: a name and attributes in double quotes without entities.
_PLAIN_START, _PLAIN_END = re.compile('<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&<>]*")*)>'), re.compile("</([a-z][a-z0-9]*)>")
# What follows these may be read in another way, which is left to the standard parser.
_RAW_TEXT_TAGS = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"))
_PLAIN_ATTR = re.compile(' ([a-z-]+)="([^"]*)"')
# White space by code point, as far as there is any.
_SPACES = np.array([chr(c).isspace() for c in range(0x3002)], bool)
_CHROME_TAGS, _CHROME_ROLES = frozenset(fv.CHROME_TAGS), frozenset(fv.CHROME_ROLES)
_BLOCKS, _FALLBACKS = frozenset(fv.BLOCK_TAGS), frozenset(fv.FALLBACK_TAGS)


class _Tree(HTMLParser):
    """Elements with their place in the tree and their span in the page's text, as one list per property.

    Elements are numbered as they start, and ``last`` is the last number inside one: ``b`` stands in ``a`` if
    ``a < b <= last[a]``.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.last, self.start, self.end = [], [], [], [], [], []
        self.kids, self.child_ix, self.img, self.chrome, self.own = [], [], [], [], []
        self.open: list[int] = []
        self.text: list[str] = []
        self.size = 0

    def updatepos(self, i, j):
        """Lines are not counted."""
        return j

    def parse_starttag(self, i):
        plain = _PLAIN_START.match(self.rawdata, i)
        if not plain or plain[1] in _RAW_TEXT_TAGS:
            return super().parse_starttag(i)
        self.lasttag = plain[1]
        self.handle_starttag(plain[1], _PLAIN_ATTR.findall(plain[2]) if plain[2] else ())
        return plain.end()

    def parse_endtag(self, i):
        plain = None if self.cdata_elem else _PLAIN_END.match(self.rawdata, i)
        if not plain:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._close_paragraph()
        while self.open and tag in CLOSED_BY.get(self.tag[self.open[-1]], ()):
            self._close()
        parent, node = self.open[-1] if self.open else -1, len(self.tag)
        kept = {k: v or "" for k, v in attrs if k in KEPT_ATTRS} if attrs else {}
        self.tag.append(tag)
        self.attrs.append(kept)
        self.parent.append(parent)
        self.last.append(node)
        self.start.append(self.size)
        self.end.append(self.size)
        self.img.append(tag == "img")
        self.own.append(None)
        self.child_ix.append(len(self.kids[parent]) if parent >= 0 else 0)
        self.chrome.append(
            (parent >= 0 and self.chrome[parent]) or tag in _CHROME_TAGS
            or (len(kept) > 0 and (kept.get("role") in _CHROME_ROLES or any(_FURNITURE.search(kept[k]) for k in ("id", "class") if k in kept)))
        )
        self.kids.append([])
        if parent >= 0:
            self.kids[parent].append(node)
            if tag == "img":
                self.img[parent] = True
        if tag not in VOID_TAGS:
            self.open.append(node)

    def handle_endtag(self, tag):
        if self.open and self.tag[self.open[-1]] == tag:
            self._close()
        elif any(self.tag[i] == tag for i in self.open):
            while self.tag[self.open[-1]] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        self.text.append(data)
        self.size += len(data)
        if self.open and (self.tag[self.open[-1]] in _BLOCKS or self.tag[self.open[-1]] in _FALLBACKS):
            # Only the text that stands directly in an element counts as its own.
            self.own[self.open[-1]] = (self.own[self.open[-1]] or []) + [data]

    def _close_paragraph(self):
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.tag[self.open[depth]]
            if name == "p":
                while len(self.open) > depth:
                    self._close()
                return
            if name not in INLINE_TAGS:
                return

    def _close(self):
        node = self.open.pop()
        self.end[node], self.last[node] = self.size, len(self.tag) - 1

    def finish(self):
        self.close()
        while self.open:
            self._close()

    def visits(self) -> list[int]:
        """Place of each element when the last child is visited first."""
        order, stack = [-1] * len(self.tag), [0] if self.tag else []
        n = 0
        while stack:
            i = stack.pop()
            order[i] = n
            n += 1
            stack.extend(self.kids[i])
        return [v if v >= 0 else len(order) + i for i, v in enumerate(order)]


def page_tree(html: str) -> tuple[_Tree, str]:
    tree = _Tree()
    tree.feed(html or "")
    tree.finish()
    return tree, "".join(tree.text)


def _squeezed_lengths(text: str, starts: list[int], ends: list[int]) -> list[int]:
    """Length of each span once its whitespace runs are single and its ends are trimmed."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = ~_SPACES[np.minimum(points, len(_SPACES) - 1)]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    chars, words = np.append(0, np.cumsum(solid)), np.append(0, np.cumsum(first))
    a, b = np.array(starts, np.int64), np.array(ends, np.int64)
    at = np.minimum(a, max(len(text) - 1, 0))
    inside = (b > a) & (solid[at] & ~first[at] if len(text) else False)
    return (chars[b] - chars[a] + np.maximum(0, words[b] - words[a] + inside - 1)).tolist()


def _part_text(tree: _Tree, i: int, text: str, least: int) -> str | None:
    """Text of an element as a part: what stands directly in it, or all of it when that is short."""
    if tree.tag[i] not in _BLOCKS and tree.tag[i] not in _FALLBACKS:
        return None
    own = " ".join("".join(tree.own[i] or ()).split())
    if len(own) >= least:
        return own
    whole = " ".join(text[tree.start[i] : tree.end[i]].split()) if tree.tag[i] in _BLOCKS else ""
    return max(own, whole, key=len)


def node_batches(batches: Iterator[pa.RecordBatch], least: int = PartPolicy().min_chars) -> Iterator[pa.RecordBatch]:
    """Node table of each page, in bounded pieces; the text of a page is carried once, on its first node."""
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split(" ") for f in NODE_SCHEMA.split(", "))])
    held: list[list] = [[] for _ in schema]

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema, strict=True)], schema=schema)
        for c in held:
            c.clear()
        return out

    for batch in batches:
        for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html"), strict=True):
            tree, text = page_tree(html.as_py())
            n = len(tree.tag)
            lengths, visits = _squeezed_lengths(text, tree.start, tree.end), tree.visits()
            for a in range(0, n, NODES_AT_ONCE):
                b = min(n, a + NODES_AT_ONCE)
                columns = (
                    [page_id] * (b - a), range(a, b), tree.last[a:b], tree.parent[a:b], tree.tag[a:b], [list(x.items()) for x in tree.attrs[a:b]], tree.start[a:b],
                    tree.end[a:b], lengths[a:b], [len(k) for k in tree.kids[a:b]], tree.child_ix[a:b], visits[a:b], tree.chrome[a:b], tree.img[a:b],
                    [_part_text(tree, i, text, least) for i in range(a, b)], [text if i == 0 else None for i in range(a, b)],
                )
                for c, more in zip(held, columns, strict=True):
                    c.extend(more)
                if len(held[0]) >= NODES_AT_ONCE:
                    yield told()
    if held[0]:
        yield told()
