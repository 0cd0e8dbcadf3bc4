"""Main text by the site style tree: given pages against a plain reading, planted hosts against counts in Python, odd markup."""

import html
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tideflow.llm import html_blocks, registry, style_tree

SF = "/root/testdata/sf0.001"
CLASH = "text n_chars host rid sig texts judged nodes contents parents paths styles kinds gone facts".split()


def article(page):
    """Reading of a page whose article holds nothing but headings and paragraphs."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    lines = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(x for x in lines if x)


def test_given_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = registry.queries()["op11_html_text"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        want = article(pages[r["page_id"]]["html"])
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


def texts(page):
    return [b.text for b in html_blocks.parse(page)[1] if b.state != html_blocks.DROPPED]


@pytest.mark.parametrize("page, want", [
    ("", []), ("no markup  at\nall", ["no markup at all"]), ("<p>one<p>two<br>lines<p>", ["one", "two lines"]), ("<p>a &lt;b&gt; &amp;amp; &#233;&nbsp;&eacute</p>", ["a <b> &amp; é é"]),
    ("<p>a < b and 3 <4</p>", ["a < b and 3 <4"]), ("<p>cut off <b", ["cut off"]), ("<p>x<!-- <p>no</p> -->y</p><!-- open <p>z", ["xy"]), ("<script>var a='</p><p>no'</script><p>yes</p><script>if (a<b) {", ["yes"]),
    ("<style>p{}</style><title>t</title><textarea>no</textarea><p>yes", ["yes"]), ("<p>a<button>Share</button>b <span class='ad'>buy</span>c</p>", ["ab c"]), ("<p title='a > b' data-x=\"<p>\">text</p>", ["text"]),
    ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", ["one", "two", "a", "b", "c"]), ("<nav>menu</nav><header>top</header><p>text</p><footer>end</footer><aside>side</aside><form>f<input></form>", ["text"]),
    ("<div class='cookie-notice'>ok?</div><div id='sidebar'>s</div><div role='navigation'>n</div><div class='post-content'>text</div><section id='comments'><p>me too</section>", ["text"]),
    ("<div class='has-sidebar page'><article class='post'><header><h1>Title</h1><p>by me</header><p>body<div class='share'>tweet</div><section class='comments'><article class='comment'>first!</article></section></article></div><div>outside</div>", ["Title", "body"]),
    ("<body class='menu-open'><main><p>text</p></main><aside><article>teaser</article></aside></body>", ["text"]), ("<div hidden>a</div><div style='color:red; display : none'>b</div><p>c</p>", ["c"]),
    ("<div><a href=x>one</a> <a href=y>two</a></div><p>see <a href=z>this</a> page</p>", ["see this page"]), ("<b>un<p>closed</b> text</p></div></p>", ["un", "closed text"]), ("&lt;p&gt;<P CLASS=x>UP</P>", ["<p>", "UP"]),
])
def test_markup(page, want):
    assert texts(page) == want


def test_long_odd_pages_take_linear_time():
    import time

    for page in ("<" * 200_000, "<p" * 100_000, "<div>" * 50_000 + "x" + "</div>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, '<a href="' * 30_000, "<!--" * 50_000, "<p>x" * 50_000, "&amp" * 100_000):
        t = time.time()
        html_blocks.parse(page)
        assert time.time() - t < 10


def planted():
    """Hosts without articles: menus and notices repeat, texts do not; one host's pages are mostly copies; one host has two pages only."""
    rows = []
    for h, n in (("big.example", 120), ("small.example", 6), ("two.example", 2)):
        for i in range(n):
            menu = "".join(f"<span>Item {k}</span> " for k in range(5))
            body = "".join(f"<p>{h} page {chr(97 + i % 26)}{'x' * (i // 26)} says line {chr(97 + k)} here</p>" for k in range(4))
            rows.append((f"http://{h}/{i}", f"<html><body><div class='x1'>{menu}</div><div class='c'><div class='t'>Updated {i} times</div>{body}</div><div class='x2'><p>All rights kept {2000 + i}</p></div></body></html>"))
    rows += [(f"https://WWW.Copy.example:8080/{i}", "<body><div>one and the same text</div></body>") for i in range(60)]
    rows += [(f"https://art.example/{i}", f"<body><article><p>The same words on all pages.</p><div>Read our other pages</div><p>Word {chr(97 + i)}</p></article></body>") for i in range(20)]
    rows += [(None, "<p>no url</p>"), ("not a url", "<p>odd</p>"), ("http://big.example/none", None), ("http://big.example/empty", ""), ("http://u@big.example/0", rows[0][1]), (rows[0][0], rows[0][1])]
    return [(None if i % 50 == 49 else i, u, p) for i, (u, p) in enumerate(rows)]


def brute(rows):
    host = lambda u: (m[1].lower() if (m := re.match(r"[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", u or "")) else None)
    pages = [(i, u, host(u), style_tree.page_blocks(p or "")) for i, u, p in rows]
    once = {(h, b[0]): b for _, _, h, b in pages if h and b[6]}
    m, df, styles = Counter(), Counter(), defaultdict(Counter)
    for (h, _), (_, _, judged, nodes, contents, parents, paths, looks, kinds) in once.items():
        m.update({(h, p) for p in paths})
        df.update({(h, paths[n], c) for n, c in zip(nodes, contents) if n >= 0})
        for p, s in set(zip(paths, looks)):
            styles[h, p][s] += 1
    out = Counter()
    for i, u, h, (_, lines, judged, nodes, contents, parents, paths, looks, kinds) in pages:
        facts = {}
        for p in paths:
            if h and m[h, p] >= 3:
                total = sum(styles[h, p].values())
                facts[p, None] = -sum(c / total * math.log(c / total) for c in styles[h, p].values()) / math.log(m[h, p])
        for n, c in zip(nodes, contents):
            if n >= 0 and h and df[h, paths[n], c] >= 3:
                facts[paths[n], c] = 1 - math.log(df[h, paths[n], c]) / math.log(m[h, paths[n]])
        gone = style_tree.dropped_blocks(judged, nodes, contents, parents, paths, kinds, [len(x) for x in lines], facts) if any(k[1] is not None for k in facts) else [False] * len(lines)
        text = "\n".join(x for x, g in zip(lines, gone) if not g)
        out[i, u, text, len(text)] += 1
    return out


def test_planted_hosts(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7).withColumns({c: F.lit("clash") for c in CLASH})
    got = Counter(tuple(r) for r in style_tree.main_text(df).select("page_id", "url", "text", "n_chars").collect())
    assert got == brute(rows)
    by_url = {u: t for _, u, t, _ in got}
    for h, n in (("big.example", 120), ("small.example", 6)):
        for i in range(1, n):
            lines = by_url[f"http://{h}/{i}"].split("\n")
            assert len(lines) == 4 and all("says line" in x for x in lines)
    assert "All rights kept 2000" in by_url["http://two.example/0"]  # two pages prove nothing
    assert all(t == "one and the same text" for u, t in by_url.items() if u and "Copy" in u)
    assert all("The same words" in t and "Word" in t and "other pages" not in t for u, t in by_url.items() if u and "art." in u)
    assert by_url["http://big.example/none"] == by_url["http://big.example/empty"] == "" and by_url[None] == "no url" and by_url["not a url"] == "odd"


def test_no_pages_and_text_ids(spark):
    assert style_tree.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    got = style_tree.main_text(spark.createDataFrame([("k", "http://x/", "<p>t")], "page_id string, url string, html string")).collect()
    assert [tuple(r) for r in got] == [("k", "http://x/", "t", 1)]
