"""Pages, archives, vectors and the pipeline: brute force, round trips, and odd rows."""

import collections
import hashlib
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenledger.llm import ann, decontaminate, html_text, queries, warc
from lumenledger.llm.oracle import ORACLES


def plain(v):
    return None if isinstance(v, float) and v != v else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    found = c.sql(ORACLES[name])
    want = sorted((tuple(dict(zip(found.columns, r))[k] for k in cols) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[k] for k in cols) for r in df.collect()), key=repr) == want


# ---- archives


def archive(payloads, compress):
    out = []
    for i, p in enumerate(payloads):
        r = warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>", "WARC-Block-Digest": "sha256:" + hashlib.sha256(p).hexdigest()}, p)
        out.append(warc.gzip_member(r) if compress else r)
    return out


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    payloads = [b"", b"a" * 300, b"WARC/1.1 is not a record here\r\n\r\n", bytes(range(256)) * 40, b"end"]
    parts = archive(payloads, compress)
    whole = b"".join(parts)
    got = warc.salvage(whole)
    assert [r.block for r in got.records] == payloads and not got.gaps
    # any single damaged byte loses at most its own record, and the gap is where the damage is
    rng = np.random.default_rng(0)
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    for at in rng.integers(0, len(whole), 60).tolist():
        bad = bytearray(whole)
        bad[at] ^= 0x5A
        hurt = int(np.searchsorted(edges, at, side="right")) - 1
        got = warc.salvage(bytes(bad))
        blocks = [r.block for r in got.records]
        assert [b for i, b in enumerate(payloads) if i != hurt] == [b for b in blocks if b != payloads[hurt]] or len(blocks) == len(payloads)
        assert sum(g.length for g in got.gaps) <= edges[hurt + 1] - edges[hurt]
    # junk before, between and after; a cut at the end
    got = warc.salvage(b"junk" + parts[1] + b"\x1f\x8b\x08junk" + parts[3] + parts[4][:-7])
    assert [r.block for r in got.records] == [payloads[1], payloads[3]]
    assert [(g.offset, g.length) for g in got.gaps] == [(0, 4), (4 + len(parts[1]), 7), (11 + len(parts[1]) + len(parts[3]), len(parts[4]) - 7)]
    assert warc.salvage(b"").records == [] and len(warc.salvage(b"nothing here").gaps) == 1


@pytest.mark.parametrize("compress", [True, False])
def test_archives_round_trip(spark, tmp_path, compress):
    long = "x" * 150
    rows = [(3, "u3", long), (1, "u1\r\nX: y", long), (2, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "é\x1f\x8b\x08\r\n\r\nWARC/1.1\r\n" * 40), (None, "u", long), (1, "again", long), (8, "u", "y" * 100_000)]
    rows.append((9, "u", "".join(map(chr, np.random.default_rng(1).integers(0, 0xD7FF, 20_000))) + "".join(map(chr, range(256)))))  # all bytes in the archive
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, _id string, _digest string")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path, compress)
    back = warc.read_archives(spark, path).collect()
    assert not compress or set(b"".join(f.read_bytes() for f in (tmp_path / "warc").rglob("part-*"))) == set(range(256))
    assert not [r for r in back if r["record_type"] == "gap"]
    want = collections.Counter()
    for i, _, html in rows:
        p = (html or "").encode()
        revisit = html == long and i != 1
        want[i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None, b"" if revisit else p] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["block"])) for r in back) == want
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none", compress)
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("piece", [b"WARC/1.1\r\nx", b"WARC/1.1\r\na:b", b"WARC/1.1\r\na: b\r\n", b"WARC/1.1\r\n\r\n", b"WARC/1.1\r\nContent-Length: 5\r\n", b"WARC/1.1\r\nContent-Length: 5\r\n\r\n", b"WARC/1.1"])
@pytest.mark.parametrize("end", [b"", b"\r\n\r\n"])
def test_salvage_takes_linear_time(piece, end):
    """Megabytes of damaged bytes full of version lines, before and after good records."""
    good = warc.record_bytes({"WARC-Type": "response", "WARC-Block-Digest": f"sha256:{hashlib.sha256(b'block').hexdigest()}"}, b"block")
    damaged = piece * (3_000_000 // len(piece)) + end
    began = time.perf_counter()
    got = warc.salvage(good + damaged + good)
    assert time.perf_counter() - began < 12
    assert [r.block for r in got.records][:1] == [b"block"] and got.records[-1].block == b"block"


def test_heads_that_share_an_end_are_judged_alike():
    """What is remembered of a failed head never hides a good record: against a reader that remembers nothing."""
    rng = np.random.default_rng(11)
    good = [warc.record_bytes({"WARC-Type": "response", "A": "b"}, bytes(rng.integers(65, 70, n, dtype=np.uint8))) for n in (0, 5, 40)]
    bits = [*good, b"WARC/1.1\r\n", b"WARC/1.1\r\nA: b\r\n", b"\r\n\r\n", b"Content-Length: 5\r\n", b"Content-Length: 5\r\n\r\nabcde\r\n\r\n", b"x\r\n", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"WARC/", b"\xff: 1\r\n"]

    def slow(data):
        out, at = [], 0
        while at < len(data):
            try:
                record, at = warc._Plain(data).record(at)
                out.append((record.offset, record.block))
            except warc._Bad:
                at += 1
        return out

    for _ in range(400):
        data = b"".join(bits[i] for i in rng.integers(0, len(bits), int(rng.integers(1, 12))))
        assert [(r.offset, r.block) for r in warc.salvage(data).records] == slow(data), data


def test_archives_are_cut_by_bytes(spark, tmp_path):
    sizes = [10, 200_000, 5, 5, 5, 60_000, 60_000, 60_000, 1, 1, 300_000, 20]
    rows = [(i, "u", chr(97 + i) * n) for i, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/warc", compress=False, archive_bytes=150_000)
    files = sorted(p.stat().st_size for p in (tmp_path / "warc").rglob("part-*"))
    assert len(files) >= 5 and [n for n in files if n > 150_000] == [n for n in files if n > 190_000] and len([n for n in files if n > 150_000]) == 2
    back = {r["page_id"]: bytes(r["block"]).decode() for r in warc.read_archives(spark, f"file://{tmp_path}/warc").collect()}
    assert back == {i: html for i, _, html in rows}


# ---- pages


def test_an_article_narrows_a_region():
    page = "<html><body><div class='x'>teaser of the day</div><h2>before</h2><article><h1>T</h1><p>one</p></article><div class='y'>more</div></body></html>"
    path = {node.sig: path for path, _, node in html_text.elements(html_text.blocks(page)[0])}
    assert html_text.main_text(page, region=path["body"]) == "T one"
    assert html_text.main_text(page, region=path["article"]) == "before T one"
    assert html_text.main_text(page.replace("article", "section"), region=path["body"]) == "teaser of the day before T one more"
    assert html_text.main_text(page, region=12345) == "T one"


def test_text_of_odd_pages():
    text = html_text.main_text
    assert text(None) == "" and text("") == "" and text("plain &amp; simple") == "plain & simple"
    assert text("<p>a<b>b</b> c<br>d<p>e</p>") == "ab c d e"
    assert text("<nav>menu</nav><article><h1>T</h1><p>one\n  two</p><script>x</p></script><aside>s</aside><div class='comments'>c</div></article><footer>f</footer>") == "T one two"
    assert text("<body><header>h</header><div class='content'>main <span>text</span></div><div id='cookie-notice'>n</div><form>q<input></form></body>") == "main text"
    assert text("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>") == "a b 1 2"
    assert text("<p>x &lt;b&gt; &#233; &nbsp; y</p><!-- no --><style>p{}</style>") == "x <b> é y"
    assert text("<article>unclosed <b>bold<p>next") == "unclosed bold next"
    assert text("<a title='x > y'>link</a> <p class=\"ad\">buy</p><!-- never closed") == "link"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert text(deep) == "deep"
    assert text("<div class='adventure'>kept</div><p class='header-image'>kept too</p>") == "kept kept too"


def simple_tree_matching(a, b):
    """Pairs of nodes (tag, children) of a largest matching of two trees that keeps parents and order."""
    if a[0] != b[0]:
        return []
    n, m = len(a[1]), len(b[1])
    best = [[[] for _ in range(m + 1)] for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            both = simple_tree_matching(a[1][i - 1], b[1][j - 1])
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + both, key=len)
    return [(a, b), *best[n][m]]


def test_paths_align_as_simple_tree_matching():
    rng = np.random.default_rng(4)

    def tree(depth):
        tags = [t for t in "abcd" if rng.random() < 0.6] if depth else []
        return ("div", [(t, tree(depth - 1)[1]) for t in tags])

    def page(t):
        return f"<div class='{t[0]}'>{t[0]}" + "".join(page(k) for k in t[1]) + "</div>"

    def size(t):
        return 1 + sum(size(k) for k in t[1])

    for _ in range(200):
        one, two = tree(3), tree(3)
        paths = [{p for p, parent, _ in html_text.elements(html_text.blocks(page(t))[0]) if parent >= 0} for t in (one, two)]
        assert [len(p) for p in paths] == [size(one), size(two)]
        assert len(paths[0] & paths[1]) == len(simple_tree_matching(one, two))


def test_varying_slots_of_the_region_are_content(spark):
    """Hosts without article elements or telling names: menus, adverts and teasers vary on every page."""
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    layouts = [
        ("<html><body><table><tr><td>{menu}</td></tr></table><div class='x1'>{ad}</div><h2>{title}</h2><p>{lead}</p><div class='x2'>{body}</div><div class='x3'>{teaser}</div><div>Imprint</div></body></html>", "{title} {lead} {text}"),
        ("<body><div id='a'><div id='b'>{menu}</div><div id='c'><h1>{title}</h1>{body}</div><div id='d'>{teaser}<p>{ad}</p></div></div><p>All rights reserved</p></body>", "{title} {text}"),
    ]
    for h, (layout, want) in enumerate(layouts):
        rows, texts = [], []
        for i in range(6):
            parts = [prose(int(rng.integers(20, 60))) for _ in range(3)]
            body = "".join(f"<p>{x}</p>" for x in parts[:2]) + f"<ul><li>{parts[2]}</li></ul>"
            fill = {"menu": "".join(f"<a href='/{k}'>{prose(1)}</a> " for k in range(6)), "ad": prose(6), "title": prose(4), "lead": prose(8), "body": body, "teaser": f"<a href='/t'>{prose(5)}</a>", "text": " ".join(parts)}
            rows.append((i, f"http://h{h}.example/{i}", layout.format(**fill)))
            texts.append(want.format(**fill))
        got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert [r["text"] for r in sorted(got, key=lambda r: r["page_id"])] == texts


@pytest.mark.parametrize("piece", ["<a x ", "<!", "</a ", "<svg>", "<!--", "<b>", "<div>", "<p>x", "</section>", "<a '", "<div><b>x"])
def test_parsing_takes_linear_time(piece):
    def seconds(n):
        began = time.perf_counter()
        html_text.main_text(piece * n + ">" + "</i>" * 100)
        html_text.main_text("<i>" * 100 + piece * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(20_000) < 8 * max(seconds(5000), 0.02)  # four times as much; a square would take sixteen


def test_constant_nodes_become_template(spark):
    page = "<html><body><div class='strap'>Daily News of the Town</div><h2>{0}</h2><div class='story'><p>{1}</p><p>{2}</p></div><div class='tail'>All rights reserved</div></body></html>"
    rows = [(i, "http://Town.example/a", page.format(f"Title {i}", f"First {i}", f"Second {i}")) for i in range(6)]
    rows += [(10, "http://other.example/", page.format("T", "a", "b")), (11, None, None), (12, "", ""), (None, "http://town.example/x", page.format("N", "n", "m")), (3, "http://town.example/a", rows[3][2])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, _host string")
    got = collections.defaultdict(list)
    for r in html_text.extract(pages).collect():
        got[r["page_id"]].append((r["text"], r["n_chars"]))
        assert r["n_chars"] == len(r["text"])
    assert got[2] == [("Title 2 First 2 Second 2", 24)] and len(got[3]) == 2 and got[None] == [("N n m", 5)]
    assert got[10][0][0] == "Daily News of the Town T a b All rights reserved" and got[11] == got[12] == [("", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def host_texts(spark, htmls):
    """The texts of pages of one host, ids in the order given."""
    rows = [(i, "http://a.example/x", h) for i, h in enumerate(htmls)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_template_comes_from_all_pages(spark):
    page = "<body><div class='strap'>Daily News</div><h2>Title {0}</h2><div class='story'><p>Text {0}</p></div><div class='tail'>All rights reserved</div></body>"
    want = [f"Title {i} Text {i}" for i in range(5)]
    for odd in (None, "", "<body><p>Error 404</p></body>", "<body><table><tr><td>other layout</table></body>"):
        assert host_texts(spark, [odd, *(page.format(i) for i in range(5))])[1:] == want, odd


def test_template_of_long_and_deep_pages(spark):
    page = "<body><div class='strap'>Daily News</div><h2>Title {0}</h2><div class='story'>{1}</div>{2}<div class='tail'>All rights reserved</div>{3}</body>"
    long = [page.format(i, "".join(f"<p>Text {i} {k}</p>" for k in range(5000)), "", "") for i in range(4)]
    assert host_texts(spark, long) == [" ".join([f"Title {i}", *(f"Text {i} {k}" for k in range(5000))]) for i in range(4)]
    deep = [page.format(i, f"<p>Text {i}</p>", "<div class='x'>" * 2000, "</div>" * 2000) for i in range(4)]
    assert host_texts(spark, deep) == [f"Title {i} Text {i}" for i in range(4)]


def test_names_do_not_drop_what_holds_the_article():
    text = html_text.main_text
    article = "<article><h1>T</h1><p>one</p></article>"
    for name in ("content-sidebar-wrap", "has-sidebar", "no-ads", "menu-open"):
        assert text(f"<body><div class='{name}'>{article}<div class='sidebar'>s</div></div></body>") == "T one", name
        assert text(f"<body><div id='{name}'><h1>T</h1><div>one</div></div><div class='ad'>buy</div></body>") == "T one", name
        assert text(f"<body><nav>menu</nav><div id='{name}'><div>only text</div></div></body>") == "only text", name
    assert text("<body><article class='related-story'><h1 class='banner-title'>T</h1><p>one</p></article></body>") == "T one"
    assert text(f"<body><form id='aspnetForm'><nav>n</nav>{article}<div class='share-bar'>share</div></form></body>") == "T one"
    assert text("<body><form><input><div>whole page in a form</div></form></body>") == "whole page in a form"
    assert text("<article><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p><noscript><p>plain</p></noscript><object data='a'>o</object></article>") == "If x=1 then plain o"
    assert text("<body><noscript>switch it on</noscript><p>text</p></body>") == "text"
    # what holds no article still goes
    assert text(f"<body><div class='site-banner'>b</div>{article}<form>search</form></body>") == "T one"
    assert text("<body><div class='top-banner'>b</div><p>a text of some length</p><form>search</form></body>") == "a text of some length"


def test_only_exact_attributes_tell():
    text = html_text.main_text
    article = lambda inner: f"<body><nav>Home</nav><article><h1>T</h1>{inner}<p>end</p></article><footer>f</footer></body>"
    kept = [
        ('<div style="overflow:hidden"><p>one</p></div>', "one"), ('<p title="hidden gems">one</p>', "one"), ('<p data-id="ad">one</p>', "one"), ('<p data-role="menu">one</p>', "one"),
        ("<div onclick=\"this.hidden=true\">one</div>", "one"), ('<p>see <a href="/x?id=menu">the link</a> there</p>', "see the link there"), ('<p>see <a href="/hidden/x">it</a></p>', "see it"),
        ('<h2 id="related">Related work</h2>', "Related work"), ('<p id="notice">one</p>', "one"), ('<p class="notice">one</p>', "one"), ("<p class=x id=y title='a > b' hidden-note>one</p>", "one"),
        ('<p title=a"b data-x=hidden>one</p>', "one"), ("<p class = 'lead' >one</p>", "one"),
    ]
    for inner, want in kept:
        assert text(article(inner)) == f"T {want} end", inner
        assert text("<body>" + inner.replace("notice", "lead").replace("related", "work") + "</body>") == want, inner
    for inner in ("<p hidden>x</p>", "<p HIDDEN=''>x</p>", "<p aria-hidden='true'>x</p>", "<p class='lead ad'>x</p>", "<div id=ad>x</div>", "<div role=menu>x</div>", "<div class='comments'><p>x</p></div>", "<h2 class='advertisement'>x</h2>"):
        assert text(article(inner)) == "T end", inner
    assert html_text.attributes('<p class="a" CLASS="b" id=c/d hidden>', "p") == {"class": "a", "id": "c/d", "hidden": ""}


def test_names_of_what_holds_the_content_do_not_count():
    text = html_text.main_text
    long = "<p>" + "word " * 30 + "</p>"
    said = " ".join(["word"] * 30)
    for page in ('<article class="post notice">{}</article>', '<div class="widget"><article>{}</article></div>', '<div class="comments"><main>{}</main></div>', '<section id="related"><div class="promo"><article>{}</article></div></section>'):
        assert text(f"<body><nav>n</nav>{page.format(long)}<div class='widget'>w</div></body>") == said, page
    assert text(f"<body><div id='banner'><h1>Title</h1></div>{long}</body>") == f"Title {said}"
    # what readers wrote isn't content, in articles or not
    for comment in ('<div class="comments"><article id="c1">mine</article></div>', '<section><article class="comment">mine</article></section>', '<div id="replies"><p>mine</p></div>'):
        assert text(f"<body><article>{long}</article>{comment}</body>") == said, comment
        assert text(f"<body><div><h1>T</h1>{long}</div>{comment}</body>") == f"T {said}", comment


def test_siblings_of_one_signature_are_matched_one_by_one(spark):
    """A constant paragraph among varying ones of the same tag and no class, at any place and in any number of siblings."""
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    rows, want = [], []
    for i in range(8):
        varying = [prose(30) for _ in range(2 + i % 3)]
        lines = ["Read this first please", *varying, "All rights are reserved by us"]
        lines.insert(2, "Follow us everywhere")
        rows.append((i, f"http://one.example/{i}", "<body><div><div>" + "".join(f"<p>{x}</p>" for x in lines) + "</div></div></body>"))
        want.append(" ".join(varying))
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in sorted(got, key=lambda r: r["page_id"])] == want
    # as a largest matching of the trees of two pages pairs them, with elements of equal text as the leaves that match
    leaf = lambda html: ("body", [(x, []) for x in re.findall("<p>(.*?)</p>", html)])
    paired = [a[0] for a, _ in simple_tree_matching(leaf(rows[0][2]), leaf(rows[1][2]))[1:]]
    assert paired == ["Read this first please", "Follow us everywhere", "All rights are reserved by us"]


def test_copies_do_not_make_an_article_a_template(spark):
    page = "<body><div class='strap'>Daily News</div><div class='date'>{2} May</div><div class='offer'>Buy {2}</div><h2>{0}</h2><div class='story'><p>{1}</p><p>more of {0}</p></div></body>"
    copies = [page.format("Storm over town", "Rain fell all night.", i) for i in range(30)]
    assert host_texts(spark, copies[:3]) == [f"Daily News {i} May Buy {i} Storm over town Rain fell all night. more of Storm over town" for i in range(3)]
    others = [page.format(f"Title {i}", f"Text of page {i}.", 40 + i) for i in range(3)]
    got = host_texts(spark, copies + others)
    # stories too short for a region of their own: what varies stays
    assert got[0] == "0 May Buy 0 Storm over town Rain fell all night. more of Storm over town" and got[30] == "40 May Buy 40 Title 0 Text of page 0. more of Title 0"
    long = page.replace("more of {0}", "{0}, and on and on it went with no end in sight, until the river rose and the bridge was closed to all")
    got = host_texts(spark, [long.format(f"Title {i}", f"Text of page {i}, which is longer than what lies around it by far.", 40 + i) for i in range(4)])
    assert got[0] == "Title 0 Text of page 0, which is longer than what lies around it by far. Title 0, and on and on it went with no end in sight, until the river rose and the bridge was closed to all"
    inside = "<body><p>strap</p><article><h1>Recipe of the day</h1><p>Take {0} eggs</p><p class='end'>Serve hot</p></article></body>"
    assert host_texts(spark, [inside.format(i) for i in range(5)]) == [f"Recipe of the day Take {i} eggs Serve hot" for i in range(5)]


def test_articles_come_out_whole(spark, sf):
    rows = html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    import html as std
    import re

    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(std.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())


# ---- vectors


def test_nearest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [-0.0, -1.0]), (40, [1.0, 0.0]), (40, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, _x string")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert got == {
        0: [(1, 1, 2.0), (2, 2, 2.0), (3, 40, 1.0), (4, 3, 0.0), (5, 20, 0.0)],
        20: [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0), (4, 40, 0.0), (5, 3, -1.0)],
        40: [(1, 1, 2.0), (2, 2, 2.0), (3, 0, 1.0), (4, 3, 0.0), (5, 20, 0.0)],
    }
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 3"), F.lit(True)).count() == 0


def test_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    copies = rows.where("vec_id = 40").select(F.explode(F.sequence(F.lit(10_000).cast("long"), F.lit(10_060).cast("long"))).alias("vec_id"), "embedding", "label")
    rows = rows.unionByName(copies)
    got = collections.defaultdict(dict)
    for r in ann.nearest(rows, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    ids, x = zip(*((r["vec_id"], r["embedding"]) for r in rows.collect()))
    ids, x = np.array(ids), np.array(x, np.float64)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want = set(ids[np.lexsort((ids, -np.round(s, 12)))[:20]].tolist())
        found = got[int(ids[q])]
        assert sorted(found) == list(range(1, 21)) and int(ids[q]) not in {v for v, _ in found.values()}
        assert all(abs(score - x[q] @ x[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, score in found.values())
        hits, total = hits + len(want & {v for v, _ in found.values()}), total + 20
    assert hits / total > 0.92  # learned for 0.95 of a sample


def test_pigeonhole_probing_finds_every_code_within_a_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (3000, ann.TABLES)).astype(np.uint16)
    reach = rng.integers(0, 3, ann.TABLES)
    radius = int((reach + 1).sum()) - 1
    asked = codes[:40].copy()
    for row in asked:  # as far from the code as is promised
        for bit in rng.choice(16 * ann.TABLES, radius, replace=False):
            row[bit // 16] ^= np.uint16(1 << (bit % 16))
    block = ann.Block(codes)
    found = block.probed(asked, reach)
    assert all(found[i, i] for i in range(len(asked)))
    substrings = (np.bitwise_count(codes[None] ^ asked[:, None]) <= reach).any(axis=2)
    assert (found == substrings).all() and found.mean() < 0.2
    apart = np.bitwise_count(codes ^ asked[0]).sum(axis=1)
    assert block.near(asked[0], np.arange(3000), radius).tolist() == np.flatnonzero(apart <= radius).tolist()
    assert sorted(ann.masks(2).tolist()) == [v for v in range(1 << 16) if v.bit_count() <= 2]


# ---- the pipeline


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = corpus_pipeline.materialise(stage(spark, kept, sf), name)
        assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert set(after) <= set(before) and len(after) > 0.6 * len(before)
        if name == "line_dedup":
            assert set(after) == set(before) and after != before
            assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())
        else:
            assert all(after[d] == before[d] for d in after)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.with_leaks(kept, bench).where("size(leaks) > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(after)
    whole = corpus_pipeline.run(spark, sf)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(*cols).collect())) == sorted(map(tuple, packed.select(*cols).collect()))


def test_stages_take_odd_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (None, "good words here", None, None, 3)], docs.schema)
    rows = docs.limit(30).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows.limit(0), sf).count()
        out = stage(spark, rows, sf).collect()
        assert len(out) > 20, name
        # a row without an id is a document of its own: it stays if its text does
        if name != "quality":
            texts = sorted(str(r["text"]) for r in out if r["doc_id"] is None) if name != "pack" else [r["piece"] for r in out if r["doc_id"] is None]
            assert texts == {"line_dedup": ["", "good words here"], "pack": [0, 0]}.get(name, ["None", "good words here"]), name
            if name != "pack":
                assert sum(r["doc_id"] == 1 and r["text"] == "" for r in out) == (1 if name == "near_dedup" else 2), name
