import html
import re

from latticeflow.llm import html_extract, queries
from latticeflow.llm.common import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script><style>p{}</style></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div><aside>Side</aside>
<article class="post"><header><h1>Real &amp; title</h1></header><p>One <b>bold</b>word<br>two&nbsp;three<p>Tail &lt;x&gt; &copy; &#233;
<form><input value="q">Search</form><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><div id="comments"><article class="comment"><p>I think</p></article></div>
<blockquote>Quote<!-- <p>hidden</p> --></blockquote><div hidden>gone</div><div class="share-buttons">Share</div></article><footer>&copy; f</footer></body></html>"""


def text(source):
    kept, blocks, _ = html_extract.parse(source)
    return "\n\n".join(blocks if kept is None else kept)


def test_article_without_the_rest():
    assert text(PAGE) == "Real & title\n\nOne boldword two three\n\nTail <x> © é\n\na\n\nb\n\n1 2\n\nQuote"


def test_pages_cut_short_and_malformed():
    assert text("<article><p><b>One.<br><p>Two &am") == "One.\n\nTwo &am"
    assert text("<div class=ad>x<article><p>In</p>") == "In"
    assert text("<article><p>a < b and c > d</p><p title='x>y'>e</p") == "a < b and c > d\n\ne"
    assert text("<article><p>a<scr") == "a"
    assert text("<main><p>m</p><section class=related-posts>r</section></main>") == "m"
    assert text("<article>x<script>y") == "x"
    assert text("</p></div>") == text(None) == text("") == text("<article></article>") == ""
    assert text("<article>" + "<div>" * 3000 + "deep") == "deep"


def test_query_keeps_every_article(spark, data):
    pages = {r["page_id"]: r for r in table(spark, data, "pages").collect()}
    got = queries.op6_html_extraction(spark, data).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == text(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
        assert r["text"]


def covered_by_hand(streams, run):
    """Places of runs that two different pages of a host share."""
    seen = {}
    for page, tokens in streams.items():
        for i in range(len(tokens) - run + 1):
            seen.setdefault(tuple(tokens[i : i + run]), set()).add(page)
    return {p: [i for i in range(len(t) - run + 1) if len(seen[tuple(t[i : i + run])]) > 1] for p, t in streams.items()}


def test_repeated_runs_go_on_pages_without_an_article(spark):
    foot = "all rights are reserved by the people who wrote this site in spring"
    rows = [(i, f"http://a.org/{i}", f"<div>start {i} own words number {i * 7}</div><div>{foot}</div><p>{i} end</p>") for i in range(6)]
    rows += [(10, "http://b.org/", f"<div>{foot}</div>"), (11, None, None), (12, "http://a.org/0", rows[0][2]), (None, "http://c.org", "<p>only one</p>"), (13, "http://a.org/x", "<nav>n</nav>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["id"]: r["text"] for r in html_extract.extract(pages).collect()}
    streams = {i: html_extract.parse(h)[1] for i, _, h in rows[:6]}
    where = covered_by_hand({i: " ".join(b).split() for i, b in streams.items()}, html_extract.RUN)
    for i in range(6):
        assert got[i] == html_extract._unique_runs(streams[i], where[i]) == f"start {i} own words number {i * 7}\n\n{i} end"
    assert got[12] == got[0] and got[10] == foot and got[11] == got[13] == "" and got[None] == "only one"
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_what_is_not_main_text_goes():
    around = lambda inner: f"<body><nav>n</nav>{inner}<article><p>Real text.</p></article><footer>f</footer></body>"
    for inner in (
        '<div class="related"><article><p>Other</p></article></div>',
        '<article class="advert sponsored"><p>Buy</p></article>',
        "<nav><article><p>Teaser</p></article></nav>",
        '<div id="comments"><article><p>I think</p></article></div>',
        '<div class="newsletter-signup box"><p>Join</p></div>',
        '<section class="related-posts"><article><h2>More</h2></article><article><p>More</p></article></section>',
    ):
        assert text(around(inner)) == "Real text."
    assert text("<body><nav><article><p>Only a teaser</p></article></nav><main><p>Main.</p></main></body>") == "Main."


def test_names_that_are_about_something_stay():
    for name in ('class="form-of-government"', 'class="legal-history"', 'id="search-methods"', 'id="related-work"', 'class="notice-of-award"', 'class="comment-on-method"'):
        assert text(f"<article><p>One</p><section {name}><p>Two</p></section></article>") == "One\n\nTwo"
    for name in ('class="share-buttons"', 'class="cookie-notice"', 'id="relatedPosts"', 'class="x comment-list"', 'class="ad-slot-1"', 'class="post-comments"'):
        assert text(f"<article><p>One</p><section {name}><p>Two</p></section></article>") == "One"


def test_inline_elements_do_not_split_a_paragraph():
    assert text("<article><p>Before <button>Click</button>after it.</p></article>") == "Before after it."
    assert text('<article><p>Word<span class="share-buttons">x</span>, next</p></article>') == "Word, next"


def article_by_hand(source):
    """The main text of the given pages, whose articles hold headings, paragraphs and
    line breaks only, with end tags of paragraphs left out here and there."""
    inner = source.split("<article>", 1)[1].split("</article>", 1)[0]
    inner = re.sub(r"<!--.*?(-->|$)|<(script|style|form|aside|nav|footer)\b.*?</\2>", "", inner, flags=re.S)
    blocks = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|section|blockquote|table|tr|pre)\b[^>]*>", inner)
    words = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(br|td|th)\b[^>]*>", " ", b))).split()) for b in blocks]
    return "\n\n".join(w for w in words if w)


def test_all_pages_against_another_reading(spark):
    at = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in table(spark, at, "pages").collect()}
    got = {r["page_id"]: r["text"] for r in queries.op6_html_extraction(spark, at).collect()}
    assert got == {i: article_by_hand(h) for i, h in pages.items()}
