"""Wrapper inference and main text of pages."""

import html as entities
import re

from helpers import PAGES
from tarmaq.llm import wrappers
from tarmaq.llm.queries import QUERIES


def texts(spark, pages, extra=()):
    frame = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], PAGES)
    if extra:
        frame = frame.selectExpr("*", *extra)
    return {r.page_id: r.text for r in wrappers.extract(frame).collect()}


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    out = QUERIES["op6_main_text"](spark, folder).collect()
    assert len(out) == len(pages)
    for r in out:
        page = pages[r.page_id].html
        article = page[page.index("<article>") + 9:page.index("</article>")]
        blocks = [" ".join(entities.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1)>|<br>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_pages_with_an_article(spark):
    page = ("<html><head><title>T</title></head><body><div class=cookie-notice>We use cookies<p>OK</div><header>Site</header>"
            "<nav><a href=x>Home</a></nav><div class='ad'>Buy<article id=post-1><h1>Head &amp; more</h1><p>One <b>bold</b>\n word"
            "<span class='ad'>Ad!</span>s.<p>Two&nbsp;x &lt;y&gt; &amp;amp;<script>var a='</p>';</script><aside>Side</aside><!-- c -->"
            "<ul><li>i1<li>i2</ul><div class='social-share'>Share</div><form>Mail</form><div id='comments'><p>Great!</div></article>"
            "<footer>Bye</footer></body></html>")
    want = "Head & more\nOne bold words.\nTwo x <y> &amp;\ni1\ni2"
    assert texts(spark, [("http://a/1", page), ("http://a/1", page), ("http://b/2?q=1", page + "<p>tail")]) == {0: want, 1: want, 2: want}


def test_pages_without_an_article_follow_the_host(spark):
    def page(k):
        return (f"<body><div class=top>Our site</div><div class=menu><a>m{k}</a></div><div class=box><h2>Title {k}</h2>"
                + "".join(f"<p>Paragraph {k} {j} with words that differ</p>" for j in range(k % 3 + 1))
                + f"<p>Always the same</p></div><div>Visitors: {k}</div></body>")
    out = texts(spark, [(f"https://user@Host.example:80/{k}", page(k)) for k in range(6)])
    for k in range(6):
        want = [f"Title {k}", *(f"Paragraph {k} {j} with words that differ" for j in range(k % 3 + 1)), "Always the same"]
        assert out[k].split("\n") == want


def test_copies_of_a_page_are_one_page(spark):
    def page(k, more=""):
        return f"<body><h1>Title of {k * 37}</h1>{more}<p>First words {k}</p><p>Second words {k}</p><h6>Our house</h6></body>"
    quote = "<blockquote>A real quotation</blockquote>"
    pages = [("http://h/1", page(1, quote))] * 9 + [(f"http://h/{k}", page(k)) for k in range(2, 5)]
    out = texts(spark, pages)
    assert all(out[k].split("\n") == ["Title of 37", "A real quotation", "First words 1", "Second words 1"] for k in range(9))
    assert out[9].split("\n") == ["Title of 74", "First words 2", "Second words 2"]


def test_blocks_beside_the_body_stay(spark):
    names = ["River", "Mountain", "Forest", "Desert"]
    def page(k):
        return (f"<body><div class=top>Our site</div><div class=title><h1>The {names[k]}</h1></div>"
                f"<div class=intro>About the {names[k]}</div><div class=body>"
                + "".join(f"<p>A long paragraph on the {names[k]}, which is number {j} of many</p>" for j in range(6))
                + f"</div><ul class=x>{''.join(f'<li><a href=y>See {n}{k}</a>' for n in names[:k + 1])}</ul></body>")
    out = texts(spark, [(f"http://h/{k}", page(k)) for k in range(4)])
    for k, name in enumerate(names):
        found = out[k].split("\n")
        assert found[:2] == [f"The {name}", f"About the {name}"] and len([x for x in found if "paragraph" in x]) == 6
        assert "Our site" not in found
    outer = [page(k).replace("<div class=title>", "<div class=page><div class=title>").replace("<ul", "</div><ul")
             for k in range(4)]
    out = texts(spark, [(f"http://h/{k}", outer[k]) for k in range(4)])
    assert all(out[k].split("\n")[:2] == [f"The {n}", f"About the {n}"] and "See" not in out[k] for k, n in enumerate(names))


def test_the_hosts_words_in_an_article_go(spark):
    def page(k):
        return (f"<body><article><h1>Title of {k * 37}</h1><div class=x9q>Get our letter every week</div><p>First words {k}</p>"
                f"<p>Second words {k}</p><div class=q7>{'Only here' if k == 2 else f'Written by {k}'}</div></article></body>")
    out = texts(spark, [(f"http://h/{k}", page(k)) for k in range(5)] + [("http://few/1", page(1)), ("http://few/2", page(2))])
    for k in range(5):
        assert out[k].split("\n") == [f"Title of {k * 37}", f"First words {k}", f"Second words {k}",
                                      "Only here" if k == 2 else f"Written by {k}"]
    assert "Get our letter every week" in out[5] and "Get our letter every week" in out[6]


def test_names_of_other_use_are_kept_in_an_article(spark):
    page = ("<body><article><p>Area {k} is <math><mi>r</mi><mo>=</mo><mn>2</mn></math> here.</p><video src=x>fallback {k}</video>"
            "<p class='search-results'>Results {k}</p><p id='skip-list'>A skip list {k}</p><h2 class='related-work'>Related {k}</h2>"
            "<div class='share-box'>Share {k}</div><p class=ad>Buy {k}</p><div class='comment-list'><p>Fine! {k}</div></article>")
    out = texts(spark, [(f"http://h/{k}", page.replace("{k}", f"{k} word" * (k + 1))) for k in range(4)] + [("http://one/", page)])
    for k, text in out.items():
        own = f"{k} word" * (k + 1) if k < 4 else "{k}"
        assert text.split("\n") == [f"Area {own} is r=2 here.", f"fallback {own}", f"Results {own}", f"A skip list {own}", f"Related {own}"]


def test_a_hint_goes_if_the_wrapper_agrees(spark):
    """One class on three hosts: words of the host, a list of links, and a part of the article."""
    def page(host, k):
        inner = {"own": "Read our related work every week", "links": f"<a href=x>Work {k}</a> <a href=y>More {k}</a>",
                 "text": f"Others measured {k} before"}[host]
        return (f"http://{host}/{k}", f"<body><article><h1>Title {'x' * k}</h1><div class=related-work>{inner}</div>"
                f"<p>Words {'y' * k}</p></article></body>")
    pages = [page(host, k) for host in ("own", "links", "text") for k in range(5)]
    out = texts(spark, pages)
    for i, (url, _) in enumerate(pages):
        k, text = i % 5, out[i].split("\n")
        body = [f"Title {'x' * k}".strip(), f"Words {'y' * k}".strip()]
        assert text == ([body[0], f"Others measured {k} before", body[1]] if "//text" in url else body)


def test_odd_pages(spark):
    pages = [("http://x/", None), ("http://x/", ""), (None, "plain words"), ("no host", "<p>a<p>b"), (None, "<div><article>"),
             ("http://y/", "a < b & c &copy; &#x41; <notatag"), ("http://z/", "<p>" * 3000 + "deep"),
             ("http://l/", "<article>" + "<p>long text </p>" * 20000 + "</article>"), ("http://x/", "<!-- never closed <p>x")]
    out = texts(spark, pages, ("1 AS host", "'w' AS wrapper", "2 AS text"))
    assert [out[k] for k in range(7)] == ["", "", "plain words", "a\nb", "", "a < b & c © A <notatag", "deep"]
    assert out[7].count("long text") == 20000 and out[8] == ""
    assert wrappers.extract(spark.createDataFrame([], PAGES)).count() == 0


def expression(wrapper):
    """A wrapper's items as text."""
    body = "".join(f"{expression(w)}{'*' if many and not low else '+' if many else '' if low else '?'}"
                   for low, many, w in wrapper["c"])
    text = "#" if wrapper["t"] is None else "." if wrapper["t"] else ""
    return f"({body})" if wrapper["l"].startswith("(") else f"{wrapper['l']}[{text}{body}]" if body or text else wrapper["l"]


def wrapper(*pages):
    whole = None
    for page in pages:
        own = wrappers.wrapper_of(wrappers.parse(page))
        whole = own if whole is None else wrappers.merge(whole, own)
    return expression(whole)


def test_alignment_makes_options_repetitions_and_slots():
    assert wrapper("<h1>A</h1><p>x</p>", "<h1>A</h1><p>y</p>") == "page[h1[.]p[#]]"
    assert wrapper("<h1>A</h1><p>x</p>", "<p>x</p>") == "page[h1[.]?p[.]]"
    assert wrapper("<ul><li>1<li>2</ul>", "<ul><li>3</ul>") == "page[ul[li[#]+]]"
    assert wrapper("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl>") == "page[dl[(dt[#]dd[#])+]]"
    assert wrapper("<dl><dt>a<dd>b</dl>", "<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "page[dl[(dt[#]dd[#])+]]"
    assert wrapper("<div class=x5>1</div><hr>", "<div class=x6>1</div>") == "page[div x0[.]hr?]"
