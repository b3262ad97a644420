"""URL rules and main-text extraction."""

import random
from collections import Counter

import pytest

from pointlake.llm import html, url_filter
from pointlake.llm.queries import URL_RULES

RULES = [*URL_RULES, ("a.b.com", "", "block"), ("b.com", "/x/y", "allow"), ("b.com", "/x", "block"), ("", "/only", "block"), ("co", "/é", "block")]


def judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, verdict


def test_rules_equal_plain_matching(spark):
    rng = random.Random(2)
    hosts = ["example.org", "www.example.org", "xexample.org", "example.com", "A.b.COM", "q.a.b.com", "b.com", "com", "org", "co", "x.co", "", "a..com", "example-x.org", "example.org."]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?q", "/fr/a#b", "/de/", "/x", "/x/y", "/x/z", "/only/1", "?q=/es/", "#/es/", "/é/1"]
    urls = [f"{s}://{rng.choice(hosts)}{rng.choice(paths)}" for s in ("http", "https") for _ in range(150)] + [None, "", "no url", "x://", "a://b://c/es/"]
    urls += ["https://example.org/es/1"] * 50
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)] + [(None, None, None, None)], "page_id int, url string, rule string, row string")
    rules = spark.createDataFrame([*RULES, ("com", "/fr/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    got = Counter(tuple(r) for r in url_filter.filter_urls(pages.repartition(5), rules).collect())
    assert got == Counter((i, *judge(u, RULES)) for i, u in [*enumerate(urls), (None, None)])


def test_conflicting_and_missing_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.org/")], "page_id long, url string")
    both = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block")], "host string, path string, verdict string")
    assert [tuple(r)[3:] for r in url_filter.filter_urls(pages, both).orderBy("page_id").collect()] == [("com/", "block"), (None, "allow")]
    assert {r.verdict for r in url_filter.filter_urls(pages, both.where("false"), default="block").collect()} == {"block"}
    assert url_filter.filter_urls(pages.where("false"), both).collect() == []


ARTICLE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<article class="post"><h1>Head %d</h1><p>First <b>bold</b> &amp;
 text<br>line</p><!-- gone --><script>var x="<p>no</p>";</script><div class="ad">Buy</div><ul><li>one<li>two</ul>
<form><input>Sign up</form><section class="comments"><p>Reader says</p></section><footer>Tags</footer></article>
<aside>Side</aside><div id="cookie-notice">Cookies</div><footer>&copy; 2020</footer></body></html>"""
PLAIN = "<div><a href=1>Home</a> <a href=2>About</a></div><div><h1>Title %d</h1><p>Body %d</p></div><div>Copyright nobody</div>"


def test_extraction_by_elements_and_by_wrapper(spark):
    rows = [(i, f"http://a.org/{i}", ARTICLE % i) for i in range(3)] + [(10 + i, f"http://b.org/{i}", PLAIN % (i, i)) for i in range(5)]
    rows += [(20, None, None), (21, "x", ""), (None, "http://c.org", "<p>a < b<p>x &lt;i&gt; &#233;&nbsp;y"), (22, "http://d.org", "<div>" * 5000 + "deep"), (10, "http://b.org/0", PLAIN % (0, 0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "'h' AS host", "1 AS wrapper").repartition(3)
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in html.extract_text(df).collect())
    want = [(i, f"http://a.org/{i}", f"Head {i}\nFirst bold & text line\none\ntwo") for i in range(3)]
    want += [(10 + i, f"http://b.org/{i}", f"Title {i}\nBody {i}") for i in range(5)] + [(10, "http://b.org/0", "Title 0\nBody 0")]
    want += [(20, None, ""), (21, "x", ""), (None, "http://c.org", "a < b\nx <i> é y"), (22, "http://d.org", "deep")]
    assert got == Counter((*w, len(w[2])) for w in want)
    assert html.extract_text(df.where("false")).collect() == []


def test_wrapper_is_union_free_with_optional_and_repeated_groups():
    pages = ["<ul><li>a</ul><p>x</p>", "<ul><li>a<li>b</ul><h2>n</h2><p>y</p><p>z</p>", "<h2>q</h2><p>w</p><h2>q</h2><p>w</p>"]
    wrapper = None
    for page in pages:
        tree = html.bare(html.read_page(page)[0])
        wrapper = html.merge(wrapper, tree) if wrapper else tree
    text = html.expression(wrapper)
    assert "(<li>#text</li>)+" in text and "<ul:li>" in text and "|" not in text
    assert "(<h2>#text</h2>)*" in text and "(<p>#text</p>)+" in text


def test_real_pages_keep_the_article_only(spark, sf):
    import html as entities
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract_text(pages).collect():
        article = source[r.page_id].split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_hostile_markup_ends():
    for page in ('<a "' * 2000, "<!--" * 1000, "<script>" * 500, '<p class="' + "x" * 10_000, "</p>" * 5000, "<table><tr><td>" * 300 + "x"):
        html.page_text(page, None)


@pytest.mark.parametrize("depth", [10, 150, 210, 260])
def test_menus_and_footers_at_any_depth(depth):
    page = "<div>" * depth + "<nav><ul><li><a href=x>menu</a></li></ul></nav><p>the text</p><footer><p>imprint</p></footer>" + "</div>" * depth
    assert html.page_text(f"<article><p>one</p>{page}<p>two</p></article>", None) == "one\nthe text\ntwo"


def test_containers_with_long_labels_stay_apart():
    long = "x" * 60
    trees = [html.read_page(f"<body><div><p class='{long}{c}'>a</p></div></body>")[0] for c in "ab"]
    assert html.expression(trees[0]) != html.expression(trees[1])
