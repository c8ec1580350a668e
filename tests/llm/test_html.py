"""The style tree and the page text against cases, known articles and a brute-force entropy."""

import collections
import math
import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogspark.llm import html_extract
from catalogspark.llm.html_extract import Page, extract, main_text, style_tree

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div class="layout with-sidebar"><p>a b c</p></div>', "a b c"),
        ('<div class="content no-ads">x y</div>', "x y"),
        ('<article><div class="post-header"><h1>Title</h1></div><p>text</p></article>', "Title\ntext"),
        ('<p>a <b class="promo">x</b> y</p>', "a x y"),
        ('<div style="' + "a:b;" * 600 + '" class="nav">menu</div><p>text</p>', "text"),
        ("<div>" * 310 + '<div class="nav">menu</div>a long text', "a long text"),
        ('<p title="unclosed>text', "text"),
        ('<div class="nav"/>menu</div><p>text</p>', "text"),
        ("<a href=x/>one two</a><p>text of more words</p>", "one two\ntext of more words"),
        ('<form id="aspnet"><div class="sidebar-wrapper"><p>a long text of many words</p></div></form>', "a long text of many words"),
        ('<div class="story"><p>a story of some words</p></div><div class="comments">' + "<p>c1 c2 c3 c4</p>" * 9 + "</div>", "a story of some words"),
        ("<head><title>x</title><p>body without a tag", "body without a tag"),
        ("<p>x<svg><title/><path/></svg>y</p>", "xy"),
        ("<p>a < b and 3<4</p>", "a < b and 3<4"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ('<div class="ad">buy</div><section>only text</section>', "only text"),
        ("<nav>x</nav><footer>y</footer>", ""),
        ("<article>teaser</article><div>" + "the text itself " * 40 + "</div>", ("teaser\n" + "the text itself " * 40).strip()),
    ],
)
def test_cases(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "part", ['<a "', "<b>", "<div>x", "</b>", "<b><div>", "<", '<a b="', "<!--", "<!", "<script>", "<li>x", "</ ", "<a =", "<a b='x\"", "<p><b>"]
)
def test_time_is_linear(part):
    page = part * ((1 << 18) // len(part))
    began = time.time()
    main_text(page)
    html_extract._features(page)
    assert time.time() - began < 15  # quadratic work would take minutes


def article(html):
    """The article of a test page by plain substitutions."""
    inner = re.sub(r"<!--.*?-->", "", re.search(r"<article[^>]*>(.*?)</article>", html, re.S)[1], flags=re.S)
    inner = re.sub(r"</?(?:p|h1|ul|li|div|section)\b[^>]*>", "\0", inner)
    blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", b)))).strip() for b in inner.split("\0")]
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("cuts", [True, False])
def test_every_page_has_its_article(spark, cuts):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = extract(pages, cuts=cuts).collect()
    assert len(got) == len(html)
    for r in got:
        assert r.text == (article(html[r.page_id]) if html[r.page_id] else "") and r.n_chars == len(r.text)


def neutral(rng, k):
    """A page whose tags and classes say nothing: only repeats on the site tell its parts apart."""
    words = " ".join(f"w{x}" for x in rng.integers(0, 9999, 30))
    return (
        f'<body><div class="qa">Our site has been here since {k % 2 + 1999}</div><div class="qb"><div class="qc"><h1>Title {k}</h1><p>{words}</p></div>'
        f'<div class="qd"><p>Stay with us, follow us on all channels and write to us whenever you like to, we read all of it.</p></div></div></body>'
    ), f"Title {k}\n{words}"


def test_only_the_tree_tells(spark):
    rng = np.random.default_rng(7)
    made = [neutral(rng, k) for k in range(40)]
    df = spark.createDataFrame([(k, f"http://n.org/{k}", h) for k, (h, _) in enumerate(made)], SCHEMA)
    assert {r.page_id: r.text for r in extract(df).collect()} == {k: text for k, (_, text) in enumerate(made)}
    assert all("Stay with us" in r.text for r in extract(df, cuts=False).collect())
    few = df.where("page_id < 2")  # two pages tell too little
    assert all("Stay with us" in r.text for r in extract(few).collect())


def brute_tree(pages):
    """(host, style): (pages, importance) from lists of what each style node holds, by the definitions."""
    held = collections.defaultdict(list)
    for host, html in pages:
        page, spans = Page(html), []
        open_at, pieces = {}, []
        link = [False] * len(page.tags)
        for k in range(1, len(page.tags)):
            link[k] = link[page.parents[k]] or page.tags[k] == "a"
        at = []
        for e in page.events:
            if isinstance(e, str):
                text = " ".join(e.split())
                if text and not any(page.tags[k] in html_extract._SILENT for k in at):
                    pieces.append((text, len(text) * link[at[-1]]))
            elif e >= 0:
                at.append(e)
                open_at[e] = len(pieces)
            else:
                at.pop()
                spans.append((~e, open_at[~e], len(pieces)))
        own = collections.defaultdict(lambda: ([], []))
        for k, a, b in sorted(spans):
            if k == 0 or (page.tags[k] not in html_extract._PROSE or page.tags[k] == "h1" or page.named[k]):
                own[page.keys[k] if k else 0][0].append(tuple(page.tags[c] for c in range(len(page.tags)) if page.parents[c] == k) if k else ())
                own[page.keys[k] if k else 0][1].extend(pieces[a:b])
        for style, (layout, texts) in own.items():
            if texts or not style:
                held[host, style].append((tuple(layout), tuple(t for t, _ in texts), sum(len(t) for t, _ in texts), sum(n for _, n in texts)))

    def entropy(values):
        n = len(values)
        return 1.0 if n < 2 else -sum(c / n * math.log(c / n) for c in collections.Counter(values).values()) / math.log(n)

    out = {}
    for (host, style), seen in held.items():
        if style:
            whole = entropy([s[1] for s in held[host, 0]])
            content = min(1.0, entropy([s[1] for s in seen]) / whole) if whole > 0.05 else 1.0
            e = 0.8 * content + 0.2 * min(content, entropy([s[0] for s in seen]))
            n, doubt = len(seen), html_extract.DOUBT
            out[host, style] = (n, ((n - 1) * e + doubt) / (n - 1 + doubt) * (1 - min(1, sum(s[3] for s in seen) / max(1, sum(s[2] for s in seen)))))
    return out


def test_importance_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    pages = [("a", neutral(rng, k)[0]) for k in range(12)] + [("b", f"<div id='m'><a href='/'>home</a> x</div><section>{k % 3}</section><p class='q'>{k}</p>") for k in range(7)]
    pages += [(r["host"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(60).selectExpr("substring(url, 8, 5) AS host", "html").collect()]
    got = {(r.host, r.style): (r.pages, r.importance) for r in style_tree(spark.createDataFrame(pages, "host string, html string")).collect()}
    want = brute_tree(pages)
    assert got.keys() == want.keys()
    for key, (n, value) in want.items():
        assert got[key][0] == n and abs(got[key][1] - value) < 1e-9


def test_a_large_host_is_dealt_to_several_tasks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    made = [neutral(rng, k) for k in range(60)]
    df = spark.createDataFrame([(k, f"http://{'big' if k < 50 else 'small'}.org/{k}", h) for k, (h, _) in enumerate(made)], SCHEMA)
    monkeypatch.setattr(html_extract, "HOST_ROWS", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.page_id: r.text for r in extract(df.withColumns({"part": F.lit(1), "styles": F.lit(2), "parts": F.lit(3)})).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(got[k] == text for k, (_, text) in enumerate(made[:50]))
    assert len(got) == 60 and not any("Stay with us" in text for text in got.values())


def _site(spark, make, n=20):
    df = spark.createDataFrame([(k, f"http://site.org/{k}", make(k)) for k in range(n)], SCHEMA)
    return {r.page_id: r.text for r in extract(df).collect()}


def _words(k: int, n: int = 25) -> str:
    return " ".join(f"w{x}" for x in np.random.default_rng(k).integers(0, 99999, n))


@pytest.mark.parametrize("mark", ['id="related-work"', 'class="discussion"', 'class="cookie-recipe"', 'class="search-results"', 'class="notice"'])
def test_sections_of_an_article_are_kept_whatever_they_are_called(spark, mark):
    """Their text differs from page to page; a block of the same class words that repeats goes."""
    make = lambda k: f"<body><article><h1>T{k}</h1><p>{_words(k)}</p><section {mark}><p>{_words(1000 + k)}</p></section><div class='related'><p>Read more of our best stories</p></div></article></body>"
    assert _site(spark, make) == {k: f"T{k}\n{_words(k)}\n{_words(1000 + k)}" for k in range(20)}


@pytest.mark.parametrize("around", ["{}", "<div class='page'>{}</div>"])
def test_a_headline_and_lead_before_the_article(spark, around):
    make = lambda k: "<body><header><h1>The Site</h1></header>" + around.format(f"<h1>Headline {k}</h1><p class='lead'>Lead {_words(k, 5)}</p><article><p>{_words(100 + k)}</p></article>") + "</body>"
    assert _site(spark, make) == {k: f"Headline {k}\nLead {_words(k, 5)}\n{_words(100 + k)}" for k in range(20)}


def test_a_title_of_the_site_is_no_headline(spark):
    make = lambda k: f"<body><div><h1>The Site</h1></div><article><p>{_words(k)}</p></article></body>"
    assert _site(spark, make) == {k: _words(k) for k in range(20)}
    own = lambda k: f"<body><div><h1>Section {k}</h1></div><article><h1>Own</h1><p>{_words(k)}</p></article></body>"
    assert _site(spark, own, 3) == {k: f"Own\n{_words(k)}" for k in range(3)}


@pytest.mark.parametrize("inside", [True, False])
def test_comments_never_come_back(spark, inside):
    post, said = "<p>A short post.</p>", "".join(f"<div class='comment'><p>{_words(k, 40)}</p></div>" for k in range(60))
    comments = f"<div class='comment-list'>{said}</div>"
    html = f"<body><article>{post}{comments}</article></body>" if inside else f"<body><div class='post'>{post}</div>{comments}</body>"
    assert main_text(html) == "A short post."
    assert set(_site(spark, lambda k: html.replace("short", f"short {k}"), 6).values()) == {f"A short {k} post." for k in range(6)}


def test_formulas_and_objects_within_a_sentence():
    html = "<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> then <object data='a'>the picture</object> shows <svg><text>no</text></svg>it.</p></article>"
    assert main_text(html) == "If x=2 then the picture shows it."
