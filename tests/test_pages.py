from random import Random

from pyspark.sql import functions as F

from modwarden.functions import html as hm
from modwarden.operators import pages as pg
from modwarden.profiles import PartPolicy

FORUM = """<html><body><nav><ul><li>Home page of the forum</li><li>Another long menu entry</li></ul></nav>
<main><div class="thing item-1"><p>First post of the thread, long enough to count.</p></div>
<div class="thing item-2"><p>Second post of the thread, long enough to count.</p></div>
<div class="thing item-3"><p>Third post of the thread, long enough to count.<script>var t="</p>";</script></div>
<ul class="comments"><li class="comment">Comment one is a sentence with words.</li><li class="comment">Comment two is a sentence with words.</li></ul></main>
<aside class="sidebar"><p>Advertising that nobody asked for at all.</p></aside>
<footer><p>Footer text of the forum page here.</p></footer></body></html>"""


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")


def test_parts(spark):
    rows = pg.part_rows(pages(spark, FORUM)).orderBy("ix").collect()
    texts = [r.text for r in rows]
    assert texts[0].startswith("First post") and len(texts) == 6 and texts[-1].startswith("Footer")
    assert [r.tag for r in rows][:4] == ["p", "p", "p", "li"] and not any("Advert" in t or "menu" in t for t in texts)


def test_parts_limits_fallback_and_entities(spark):
    long = "<p>" + "word " * 500 + "</p>" + "<li>an entry of the list</li>" * 70
    bare = "<div>Bare text of a modern &amp; simple site<br>here</div><div>short</div>"
    out = pages(spark, long, bare)
    limited = pg.part_rows(out, PartPolicy()).collect()
    assert sum(r.page_id == 0 for r in limited) == 60
    assert max(len(r.text) for r in limited) == 2001
    whole = pg.part_rows(out, PartPolicy.whole()).collect()
    assert sum(r.page_id == 0 for r in whole) == 71 and max(len(r.text) for r in whole) == 2499
    assert [r.text for r in whole if r.page_id == 1] == ["Bare text of a modern & simple sitehere"]


def test_node_spans_and_squeezed_lengths():
    tree, text = hm.page_tree("<div> a  b<p>c <b>d</p>\n<p>e</div><img src=x>tail")
    spans = list(zip(tree.start, tree.end, strict=True))
    got = {t: text[a:b] for t, (a, b) in zip(tree.tag, spans, strict=True) if t in ("div", "b")}
    assert got["div"] == " a  bc d\ne" and got["b"] == "d"
    assert hm._squeezed_lengths(text, tree.start, tree.end) == [len(" ".join(text[a:b].split())) for a, b in spans]
    assert len({p for t, p in zip(tree.tag, tree.parent, strict=True) if t == "p"}) == 1
    assert hm._squeezed_lengths("", [0], [0]) == [0]


def test_unclosed_inline_does_not_nest_paragraphs():
    tree, _ = hm.page_tree("<article><p><b>one<br><p>two</p><p>three</p></article>")
    assert [p for t, p in zip(tree.tag, tree.parent, strict=True) if t == "p"] == [0, 0, 0]


def test_many_siblings_are_parsed_in_pieces():
    import time

    import pyarrow as pa

    html = "<ul>" + "<li>entry of a very long list</li>" * 50_000 + "</ul>"
    start = time.perf_counter()
    frames = list(hm.node_batches(iter([pa.RecordBatch.from_pydict({"page_id": [1], "html": [html]})])))
    assert time.perf_counter() - start < 20
    assert max(map(len, frames)) <= hm.NODES_AT_ONCE and sum(map(len, frames)) == 50_001
    last = frames[-1].slice(frames[-1].num_rows - 1).to_pylist()[0]
    assert (last["child_ix"], last["text_len"], last["part_text"]) == (49_999, 25, "entry of a very long list")


POST = """<html><body><div class="sidebar"><p>A paragraph of the side bar</p></div><div role="navigation"><p>Where to go from here</p></div>
<article><header><p>Byline of the article</p></header><aside><p>outer aside text here</p><aside>inner</aside>still the outer aside here</aside>
<blockquote><p>A quoted paragraph of text</p></blockquote><p>{long}</p><p>{long}<img src="https://cdn.test/photo.jpg"></p>
<div class="ad-slot"><p>Buy this thing right now</p></div><img src="https://cdn.test/logo.png"><img src="https://cdn.test/a.jpg"></article>
<div class="gallery-item"><img src="https://cdn.test/g.jpg"></div></body></html>"""


def test_parts_of_units_leave_chrome_out(spark):
    nodes = pg.node_table(pages(spark, POST.format(long="word " * 40)))
    article = nodes.filter("tag = 'article'").select("page_id", "node")
    (row,) = pg.unit_parts(article, nodes).collect()
    assert [(p.tag, p.text[:12]) for p in row.parts] == [("p", "Byline of th"), ("blockquote", "A quoted par"), ("p", "word word wo"), ("p", "word word wo")]
    assert [p.ix for p in row.parts] == [0, 1, 2, 3]
    (row,) = pg.unit_images(article, nodes).collect()
    assert [u.rsplit("/", 1)[1] for u in row.images] == ["photo.jpg", "logo.png", "a.jpg"]
    short = pg.unit_parts(article, nodes, PartPolicy(max_chars=20, max_parts=3)).first().parts
    assert len(short) == 3 and short[2].text == "word word word word …"


def test_detected_units_are_split_admitted_and_keyed(spark):
    whole, long = POST.format(long="two words"), POST.format(long="many words " * 40)
    rows = [(0, "https://a.test/x", whole), (1, "https://a.test/x", long), (2, "https://www.instagram.com/p/abc/", long), (3, "https://a.test/y", "<p>hi</p>"), (4, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    units = pg.detected_units(df).collect()
    of = {i: [u for u in units if u.page_id == i] for i in range(5)}
    assert not of[3] and not of[4]
    # One article and the gallery beside it; images filtered, text without the chrome.
    assert sorted((u.tier, len(u.images)) for u in of[0]) == [("media", 1), ("semantic", 2)]
    assert all("Buy" not in u.text and "aside" not in u.text for u in units)
    # A long one becomes its big children, each with its own images, unless the site forbids it.
    split = [u for u in of[1] if u.was_split]
    assert sorted(u.images for u in split) == [[], ["https://cdn.test/photo.jpg"]] and all(len(u.text) >= 140 for u in split)
    assert len(of[2]) == 2 and not any(u.was_split for u in of[2])
    assert len({u.unit_key for u in of[1]}) == len(of[1])


def test_detection_tiers(spark):
    plain = "<html><body><main>" + "".join(f"<div class='row r{i}'>Entry number {i} with some more words in it.</div>" for i in range(4)) + "</main></body></html>"
    story = "<html><body><main>" + "<h2>Title</h2>" + "<span>Long text of an article. </span>" * 30 + "</main></body></html>"
    nodes = pg.node_table(pages(spark, FORUM, plain, story))
    found = pg.unit_texts(pg.detect_units(nodes), nodes).collect()
    forum = sorted((r.tier, r.tag) for r in found if r.page_id == 0)
    assert forum.count(("semantic", "li")) == 2 and forum.count(("group", "div")) == 3
    assert [r.tier for r in found if r.page_id == 1] == ["group"] * 4
    assert [(r.tier, r.tag) for r in found if r.page_id == 2] in ([("section", "main")], [("group", "span")] * 30)
    assert all("Advertising" not in r.text and "menu entry" not in r.text for r in found)
    assert all(len(r.text) == r.text_len for r in found)


def accept_one_by_one(units):
    kept = set()
    for node, path, _ in sorted(units, key=lambda u: u[2]):
        if not kept & set(path):
            kept.add(node)
    return kept


def test_nested_units_equal_greedy(spark):
    import random

    rng = random.Random(2)
    for _ in range(3):
        parent = {n: rng.randint(0, n - 1) for n in range(1, 40)}
        number, last = {}, {}

        def walk(n, parent=parent, number=number, last=last):
            number[n] = len(number)
            for kid in (k for k, p in parent.items() if p == n):
                walk(kid)
            last[n] = len(number) - 1

        def path(n, parent=parent):
            return path(parent[n]) + [parent[n]] if n else []

        walk(0)
        units = [(n, path(n), r) for n, r in zip(rng.sample(range(1, 40), 25), range(25))]
        df = spark.createDataFrame([(page, number[n], last[n], r, n) for page in (0, 1) for n, _, r in units], "page_id long, node int, last int, rank int, own int")
        found = pg.drop_nested(df.repartition(3)).collect()
        for page in (0, 1):
            assert {r.own for r in found if r.page_id == page} == accept_one_by_one(units)


def test_elements_inside_each_unit(spark):
    """The sweep against ancestors walked one by one, units inside units and units that are elements themselves."""
    html = "<div><p>a<b>b</b></p><div><p>c</p><img src=x></div></div><p>d</p>" * 3
    tree, _ = hm.page_tree(html)
    rows = [(page, n, tree.last[n], tree.tag[n]) for page in (1, 2) for n in range(len(tree.tag))]
    nodes = spark.createDataFrame(rows, "page_id long, node int, last int, tag string")
    units = nodes.filter("tag = 'div' or tag = 'img'")
    for itself in (False, True):
        got = sorted((r.page_id, r._unit, r.node, r.tag) for r in pg._inside(units, nodes, "tag", itself=itself).collect())
        want = []
        for page, n, _, tag in rows:
            up, seen = tree.parent[n], [n] if itself else []
            while up >= 0:
                seen.append(up)
                up = tree.parent[up]
            want += [(page, u, n, tag) for u in seen if tree.tag[u] in ("div", "img")]
        assert got == sorted(want)


def test_join_split_dominant(spark):
    parts = spark.createDataFrame([(1, 0, "aaa"), (1, 1, "bbbb"), (1, 2, "cccc"), (2, 0, "x")], "k int, ix int, text string")
    assert {r.k: r.text for r in pg.join_part_rows(parts, "k").collect()} == {1: "aaa\nbbbb\ncccc", 2: "x"}
    assert {r.k: r.text for r in pg.dominant_part(parts, "k").collect()} == {1: "bbbb", 2: "x"}
    df = spark.createDataFrame([("t" * 701, ["a" * 140, "b" * 139, "c" * 200]), ("t" * 700, ["a" * 140] * 3), ("t" * 900, ["a" * 140])], "t string, c array<string>")
    out = [[len(x) for x in r.u] for r in df.select(pg.split_long_unit(F.col("t"), F.col("c")).alias("u")).collect()]
    assert out == [[140, 200], [700], [900]]


def test_paused_hosts_both_ways(spark):
    hosts = ["a.example.com", "example.org", "b.shop.co.uk", "free.net", None]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    paused = spark.createDataFrame([("example.com",), ("example.org",), ("co.uk",)], "p string")
    for limit in (0, 10):
        left = pg.paused_host_filter(df, "host", paused, limit).collect()
        assert sorted(str(r.host) for r in left) == ["None", "free.net"]


def test_admit_and_furniture(spark):
    df = spark.createDataFrame([("generic", "short", []), ("generic", "short", ["i"]), ("x", "shrt", []), ("x", "abc", [])], "s string, t string, i array<string>")
    assert pg.admit_units(df, "s", "t", "i").count() == 2
    parts = spark.createDataFrame([("Like", ""), ("3h", ""), ("text of a post", "ad-slot"), ("text of a post", "innovative")], "text string, cls string")
    assert pg.furniture_filter(parts, "text", "cls").count() == 1


def test_plain_tags_are_read_as_the_standard_parser_reads_them(monkeypatch):
    """Most tags take a short way past the standard parser; the tree is the same for whatever markup."""
    pieces = ["<p>", "</p>", "<div class=\"a b\">", "<div id='x'>", "</div >", "<DIV>", "<br/>", "<p/>", "<img src=\"u&amp;v\">", "<li class=\"\">", "</li>", "<a href=\"/x\" class=\"nav\">",
              "</a>", "<script>", "</script>", "<style>p{}", "</style>", "<title>", "</title>", "<textarea>", "<!-- c -->", "<!doctype html>", "<?x?>", "</>", "<", "&lt;", "&", " t　x ", "<b x>",
              "<td role=\"menu\" role=\"cell\">", "<p", "</p", "<h1 class=\"<\">", "<x-y a=\"1\">", "</x-y>", "<p class=\"a\"id=\"b\">", "word\n"]
    rng = Random(4)
    markup = ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(1500)]
    calls = []

    def trees():
        return [(vars(t)["tag"], t.attrs, t.parent, t.last, t.start, t.end, t.kids, t.child_ix, t.img, t.chrome, t.own, text) for t, text in map(hm.page_tree, markup)]

    short = trees()
    slow = hm.HTMLParser.parse_starttag
    monkeypatch.setattr(hm.HTMLParser, "parse_starttag", lambda self, i: calls.append(i) or slow(self, i))
    hm.page_tree("<p>a</p><div class=\"b\">c</div>" * 50)
    assert not calls
    for name in ("parse_starttag", "parse_endtag", "updatepos"):
        monkeypatch.delattr(hm._Tree, name)
    assert trees() == short and calls


def test_outermost_parts_of_units(spark):
    """Only blocks that stand in no other block of a unit leave the sweep, and containers likewise; chrome does not, the unit itself does."""
    html = "<div>aaaaaaaaaaaaaa<ul><li>bbbbbbbbbbbbbb<p>cccccccccccccc</p></li></ul><nav><p>dddddddddddddd</p></nav><span>eeeeeeeeeeeeee</span></div><p>ffffffffffffff</p><div>gggggggggggggg</div>"
    nodes = pg.node_table(pages(spark, html))
    units = nodes.filter("tag in ('div', 'p', 'ul')")
    rows = [r.asDict() for r in nodes.collect()]
    text = {r["node"]: r for r in rows if len(r["part_text"] or "") >= 12}
    want = []
    for u in (r for r in rows if r["tag"] in ("div", "p", "ul")):
        if u["node"] in text:
            want.append((u["node"], u["node"], 2))
        for kind, tags in enumerate((hm.fv.BLOCK_TAGS, hm.fv.FALLBACK_TAGS)):
            end = -1
            for n in sorted(text):
                if u["node"] < n <= u["last"] and text[n]["tag"] in tags and not text[n]["chrome"] and n > end:
                    want.append((u["node"], n, kind))
                    end = text[n]["last"]
    texts = nodes.filter("length(part_text) >= 12")
    assert sorted((r._unit, r.node, r.kind) for r in pg._outermost(units, texts).collect()) == sorted(want)
    assert len(want) > 6


def test_unit_detection_looks_for_containers_once(spark):
    """Containers and their sections are one join, so the elements are read once for each."""
    nodes = pg.node_table(pages(spark, POST.format(long="word " * 40)))
    plan = pg.section_units(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2
