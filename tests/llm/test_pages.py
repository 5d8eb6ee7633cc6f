"""Operators on pages against brute force on small fixtures."""

import html as markup
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tenderloom.llm import urlrules, wrappers
from tenderloom.llm.common import table

SCHEMA = "page_id long, url string, html string"

NEWS = (
    "<!DOCTYPE html><html lang=en><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body class='no-sidebar'>"
    "<header><a href=/>Site</a></header><nav><ul>{menu}</ul></nav><div class='cookie-notice'>We use cookies</div><main>"
    "<article><header><h1>{title}</h1></header>{body}<aside>Related</aside><form><label>Mail</label></form></article>"
    "<section id=comments><article>nice!</article></section></main><div class=sidebar>side</div><footer>&copy; site</footer></body></html>"
)
PLAIN = "<html><body><div class=menu>m</div><div id=content><h2>{title}</h2>{body}</div><div class='ad'>buy</div></body></html>"
BARE = "<body><nav>n<p>{title}<p>{body}"


def pages():
    rows = []
    for i in range(12):
        body = "".join(f"<p>Par {k} of {i} &amp; <b>bo</b>ld&nbsp;\n text<br>more</p>" for k in range(i % 4 + 1))
        menu = "".join(f"<li><a href='/{k}'>item {k}</a>" for k in range(i % 3 + 1))
        rows.append((i, f"https://news.example/{i}", NEWS.format(menu=menu, title=f"Title {i}", body=body)))
        rows.append((100 + i, f"http://Plain.example/{i}?q", PLAIN.format(title=f"Title {i}", body=body)))
    want = {}
    for i in range(12):
        text = [f"Title {i}", *(f"Par {k} of {i} & bold text more" for k in range(i % 4 + 1))]
        want[i] = want[100 + i] = "\n".join(text)
    rows += [(200, None, NEWS.format(menu="", title="x", body="<p>y")), (201, "https://news.example/n", None), (202, "https://news.example/e", ""), (203, "nothing", "just < text & 1&lt;2")]
    want |= {200: "x\ny", 201: "", 202: "", 203: "just < text & 1<2"}
    rows += [rows[0], rows[0]]
    long = "<p>" + "word " * 100_000 + "</p>"
    rows.append((204, "https://news.example/long", NEWS.format(menu="", title="L", body=long * 3)))
    want[204] = "\n".join(["L"] + [("word " * 100_000).strip()] * 3)
    return rows, want


@pytest.mark.parametrize("chunk", [2, 200])
def test_extraction(spark, chunk):
    rows, want = pages()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit(1)).withColumn("container", F.lit("c")).withColumn("stream", F.lit(2))
    got = wrappers.extract_pages(df.repartition(3), chunk).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)
    assert Counter(r.page_id for r in got)[0] == 3
    assert wrappers.extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_pages(spark, sf):
    """Against the article element cut out by hand."""
    rows = table(spark, sf, "pages").collect()
    got = {r.page_id: r.text for r in wrappers.extract_pages(table(spark, sf, "pages")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(markup.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_wrapper_of_a_host(spark):
    rows, _ = pages()
    hosted = spark.createDataFrame(rows, SCHEMA).withColumn("host", urlrules.host_of(F.col("url")))
    found = {r.host: r for r in wrappers.infer_wrappers(hosted, chunk=3).collect()}
    assert found["news.example"].container == "article" and found["plain.example"].container == "content"
    assert found["plain.example"].n_pages == 12 and "(<p>#<b>#</b>#<br>#</p>)*" in found["plain.example"].wrapper


def test_alignment():
    # One page's items: an extra element is optional, repeats are one group, texts are slots.
    one, two = (wrappers.skeleton(x) for x in ("<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>a</li></ul><h2>t</h2><p>y</p><p>z</p>"))
    assert wrappers.shown(one) == "<ul>(<li>#</li>)+</ul><p>#</p>"
    assert wrappers.shown(wrappers.aligned(one, two)) == "<ul>(<li>#</li>)+</ul>(<h2>#</h2>)?(<p>#</p>)+"
    assert wrappers.unpacked(wrappers.packed(one)) == one


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>a<p>b<div>c</div>d", "a\nb\nc\nd"),
        ("<nav>menu<article>text</article></nav>", "text"),
        ("<article>a<script>if (a < b) '<p>'</script>b<!-- c --></article>", "ab"),
        ("<article>a<script>open", "a"),
        ("<article><p title='>'>x &lt;b&gt; &#233;&eacute;</p></article>after", "x <b> éé"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
        ("<article>a<div class='comments'>no</div><DIV CLASS=ads>no</DIV>b</article>", "a\nb"),
        ("<article><ul><li>one<li>two</ul></article><aside>no", "one\ntwo"),
        ("<article><p>x</b></p></div>y</article>", "x\ny"),
        ("", ""),
    ],
)
def test_broken_markup(page, text):
    assert wrappers.extracted(page, "article") == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>a</p><p class='notice'>Buy now</p><p class=advert>AD</p><p>b</article>", "a\nb"),
        ("<article><p>a <span class=share>Share this</span>b</p><ul class='menu'><li>x<li>y</ul><p>c</article>", "a b\nc"),
        ("<article><p>a<h2>3 Comments</h2><ol class='commentlist'><li>nice<li>bad</ol><p>b</article>", "a\nb"),
        ("<article><h2>Comments</h2><p>on a law</p><ul class=comments><li>nice</ul>b</article>", "Comments\non a law\nb"),
        ("<article><h2>Related work</h2><div class='related-work'><p>a</p></div></article>", "Related work\na"),
        ("<article><p>a</p><div class='related-posts'><p>no</p></div><div id='share_buttons'>no</div></article>", "a"),
        ("<article class='has-sidebar'><p class='no-ads'>a</p></article>", "a"),
        ("<article><h1 class=header>a</h1><table><tr><th class=header>b</table></article>", "a\nb"),
        ("<article><pre>x <span class='comment'># y</span></pre></article>", "x # y"),
        ("<article><p>a <label>mail</label></p><p class=ad>no<p>b</article>", "a\nb"),
        ("<article><a class=ad href=x><div>no</div></a><b class=promo>no</b><p>a</article>", "a"),
    ],
)
def test_marks_on_any_element(page, text):
    assert wrappers.extracted(page, "article") == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><div><button>menu</div><article>text</article>", "text"),
        ("<body><div><select><option>a<option>b</div><article>text</article>", "text"),
        ("<body><button>menu<article>text</article>", "text"),
        ("<article>a<svg class='i'/>b<svg/><p>c</article>", "ab\nc"),
        ("<article>a<svg class=i/><title>t</title>no<p>b</article>", "a\nb"),
        ("<article><p>a<noscript><p>no</p></noscript></p>b<p><object data='x'>no</p>c</article>", "a\nb\nc"),
        ("<article>a<button><p>no</button>b <template><article>no</article></template></article>", "a\nb"),
        ("<article>" + "İ" * 12 + "<script>if (a</b)</SCRIPT >x<p>yy</p></article>", "İ" * 12 + "x\nyy"),
        ("<article>a<script>'</scripts>'</script>b</article>", "ab"),
    ],
)
def test_rest_of_a_page_stays(page, text):
    assert wrappers.extracted(page, "article") == text


@pytest.mark.parametrize("mark", ["class='site has-sidebar'", "class=header-fixed", "id='search-page'"])
@pytest.mark.parametrize("body", ["<nav>m</nav><article><p>One</p><p>two words</p></article>", "<header>Site</header><p>One<p>two words<div class=sidebar>s</div><footer>f</footer>"])
def test_a_mark_on_the_frame_of_a_page(mark, body):
    assert wrappers.article(f"<html><body><div {mark}>{body}</div></body></html>", "body") == "One\ntwo words"


def test_a_page_of_boilerplate_is_empty():
    assert wrappers.article("<body><nav>menu</nav><div class=cookie-notice>We use cookies</div><div class=sidebar><p>side</p></div></body>", "article") == ""


# --- url rules


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), re.split(r"[?#]", rest[cut:])[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [
    "http://example.com/en/a", "https://www.example.com/en/", "http://WWW.Example.COM/EN/", "http://a.b.www.example.com/en/x?y#z", "http://example.com", "http://com/", "http://net/fr/",
    "http://x.net/fr/a", "http://x.net/fr", "http://net.example.org/es/", "ftp://example.com?en", "example.com/en/", None, "", "://", "http:///en/", "http://notexample.com/en/", "http://example.com:80/en/",
    "http://com.example/en/", "a://b://example.com/en/", "http://example-x.com/en/", "http://x.example.com/en", "http://münchen.net/es/ü", "http://net/es/ü\n?x", "http://.com/x", "http://example.com./en/",
]


@pytest.mark.parametrize("sizes", [(1, 1), (40, 3)])
def test_url_rules(spark, monkeypatch, sizes):
    repeats, rows_a_range = sizes
    monkeypatch.setattr(urlrules, "ROWS_A_RANGE", rows_a_range)
    rules = [*urlrules.RULES, ("net", "/es/ü", "allow"), ("b.www.example.com", "/", "block"), ("www.example.com", "/en/", "allow"), ("example.com", "/", "block")]
    rows = [(i, u, "x") for i, u in enumerate(URLS * repeats)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("range", F.lit(1)).withColumn("verdict", F.lit("?"))
    got = urlrules.filter_urls(df.repartition(3), spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = Counter((i, *brute_verdict(u, rules)) for i, u, _ in rows)
    assert Counter(map(tuple, got.collect())) == want
    assert urlrules.filter_urls(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_url_rules_odd_rules(spark):
    rules = spark.createDataFrame([("example.com", "/", "block"), ("example.com", "/", "allow"), (None, "/", "block"), ("com", None, "block"), ("", "/", "block"), ("EXAMPLE.org", "/a", "block")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://example.com/"), (None, "http://example.org/a"), (3, "http://x/"), (1, "http://example.com/")], "page_id long, url string")
    got = Counter((r.page_id, r.rule, r.verdict) for r in urlrules.filter_urls(df, rules).collect())
    assert got == Counter({(1, "example.com/", "block"): 2, (None, "example.org/a", "block"): 1, (3, None, "allow"): 1})
    none = rules.limit(0)
    assert {r.verdict for r in urlrules.filter_urls(df, none, otherwise="block").collect()} == {"block"}
