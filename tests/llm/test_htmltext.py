import html
import math
import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from shadowset.llm import htmltext
from shadowset.llm.htmltext import extract, main_text

ARTICLE = "<p>First para with <b>bold</b> words &amp; more text, long enough to matter.</p><p>Second one&nbsp;goes on\n and   on,<br>broken here, with a <a href='/x'>link</a>.</p>"
TEXT = "First para with bold words & more text, long enough to matter. Second one goes on and on, broken here, with a link."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{ARTICLE}</article><footer>foot</footer></body></html>",
        f"<body><header>Site</header><div class='ad'>Buy</div><main><article>{ARTICLE}<div class='ad-slot'>Buy more</div><form><input>Name</form></article></main><aside>side side side</aside>",
        f"<div id='cookie-notice'>We use cookies, lots of cookies, please accept them all.</div><div class='page has-sidebar'><div class='post'>{ARTICLE}</div><div class='sidebar'><p>other</p></div></div>",
        f"<body><div><div class='menu'><a href=a>a</a><a href=b>b</a></div><div><section>{ARTICLE}</section></div></div><div id=comments><p>I think this is a very long reader comment, longer than all.</p></div>",
        f"<!-- <p>no</p> --><script>var t='<p>no</p>'</script><style>p{{}}</style><article>{ARTICLE}<section class='comments'>me too</section></article>",
        f"<body><article>{ARTICLE.replace('</p>', '')}</article><div hidden>no</div><div style='display: none'>no</div>",
        f"<body><form id='page'><nav>x</nav><main>{ARTICLE}<form><label>Your name</label><input></form></main></form>",
    ],
)
def test_article_without_furniture(page):
    assert main_text(page) == TEXT


def test_long_sections_are_kept():
    sections = "".join(f"<section><h2>Part {i}</h2>" + "<p>some words in a paragraph of text</p>" * i + "</section>" for i in range(1, 9))
    got = main_text(f"<body><article>{sections}</article></body>")
    assert got.count("some words") == 36 and "Part 1 some" in got and "Part 8 some" in got


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<script>x") == main_text("<!-- x") == ""
    assert main_text("just text, 1 < 2 & 3") == "just text, 1 < 2 & 3"
    assert main_text("<p title='a > b'>x &lt;b&gt; &#x41; &bogus;</p>") == "x <b> A &bogus;"
    assert main_text("<div>" * 30000 + "deep") == "deep"
    start = time.time()
    assert len(main_text("<article>" + "<p>word <i>word</i> " * 40000 + "</article>").split()) == 80000
    assert main_text("<p " + "<a \"" * 3000)is not None and time.time() - start < 20


def wanted(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"</?(?:p|h1|br)>", "\n", re.sub(r"</?b>", "", inner))
    return " ".join(html.unescape(inner).split())


def test_on_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    got = extract(pages).collect()
    assert {r.page_id: r.text for r in got} == {r.page_id: wanted(r.html) for r in rows} and all(r.n_chars == len(r.text) for r in got)
    for r in rows:  # the names of article and main decide nothing
        assert main_text(re.sub("</?article>", "", r.html)) == main_text(re.sub("<(/?)article>", r"<\1div>", r.html)) == wanted(r.html)


def test_density_decides_where_nothing_is_named(spark, monkeypatch):
    """With menus and articles both plain blocks, density tells them apart; a constant in its place does not."""
    bare = lambda page: re.sub(r'<div class="ad">.*?</div>|<footer>.*?</footer>', "", re.sub("<(/?)(?:article|nav)>", r"<\1div>", page))
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert all(main_text(bare(r.html)) == wanted(r.html) for r in rows)
    monkeypatch.setattr(htmltext, "density", lambda *counts: 1.0)
    assert not any(main_text(bare(r.html)) == wanted(r.html) for r in rows)


@pytest.mark.parametrize("name", ["notice-of-rights", "social-history related-studies", "comments", "ad", "sidebar-thoughts"])
def test_marks_never_empty_a_page(name):
    assert main_text(f"<body><nav><a href=x>Home</a></nav><div class='{name}'>{ARTICLE}</div></body>") == TEXT
    kept = main_text(f"<body><div class='{name}'>{ARTICLE * 30}</div><p>(c) them</p></body>")
    assert TEXT in kept or name in ("comments", "ad")


@pytest.mark.parametrize("name", ["share-prices", "notice-of-rights", "social-history", "menu-of-the-day", "advert-free-reading", "sharing-economy"])
@pytest.mark.parametrize("page", ["<body><h1>Head</h1><div class='{}'>{}</div>", "<body><div class='wrap'><h1>Head</h1><div id='{}'>{}</div></div>", "<body><div class='{}'><h1>Head</h1>{}</div>", "<body><div id=main class='{}'><div><h1>Head</h1>{}</div></div>", "<body><div><h1>Head</h1><section class='{}'>{}</section></div><footer>foot</footer>", "<body><article><h1>Head</h1>{1}<section class='{0}'>{1}</section></article>"])
def test_one_word_among_others_loses_no_text(name, page):
    for times in (1, 4):
        copies = max(1, page.count("{1}")) * times
        assert main_text(page.format(name, ARTICLE * times)) == " ".join(["Head", *[TEXT] * copies])


def test_long_comments_and_lowered_blocks_stay_out():
    comments = "<p>I think this is a long reader comment, and a rather silly one at that.</p>" * 50
    assert main_text(f"<body><div>{ARTICLE}</div><div class='user-comments'>{comments}</div><div class='promo for-you'>{ARTICLE}</div></body>") == TEXT


def test_time_in_proportion_to_the_page():
    for part, tail in (("<a ", ""), ("<div>", "</p>"), ('<a "', ""), ('<a b="', ">"), ("<p><button>" + "<i>" * 9, "<hr>"), ("<b>", "</i>"), ("<td><tr>", ""), ("< ", "")):
        page = part * (1_000_000 // len(part) // 2) + tail * (1_000_000 // max(1, len(tail)) // 2 if tail else 0)
        start = time.time()
        main_text(page)
        assert time.time() - start < 4, part


class Plain(HTMLParser):
    """A page of well-formed blocks as nested lists: [tag, children]."""

    def __init__(self, page):
        super().__init__()
        self.at = [["#root", []]]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.at[-1][1].append(node := [tag, []])
        self.at.append(node)

    def handle_endtag(self, tag):
        self.at.pop()

    def handle_data(self, data):
        self.at[-1][1].append(data)


def plain_main_text(page):
    """The extraction by its definition, counting anew at every node."""

    def texts(x, link=False):
        if isinstance(x, str):
            yield sum(map(len, x.split())), link
        else:
            for c in x[1]:
                yield from texts(c, link or x[0] == "a")

    def below(x):
        return [n for c in x[1] if not isinstance(c, str) for n in (c, *below(c))]

    inside_links = set()

    def mark(x, link):
        for c in x[1]:
            if not isinstance(c, str):
                if link or c[0] == "a":
                    inside_links.add(id(c))
                mark(c, link or c[0] == "a")

    root = Plain(page).at[0]
    mark(root, False)
    body = root[1][0]

    def counts(x):
        all_, link = 0, 0
        for n, is_link in texts(x, id(x) in inside_links and x[0] != "a"):
            all_, link = all_ + n, link + n * is_link
        return all_, len(below(x)), link, sum(n[0] == "a" for n in below(x))

    c, _, lc, _ = counts(body)
    share = lc / c if c else 0

    def dense(x):
        c, t, lc, lt = counts(x)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        ratio = math.log(max(c / max(1, lc) * max(1, t) / max(1, lt), 1.0))
        return c / max(1, t) * ratio / (max(math.log(base), 1e-3) if base > 1.001 else 1.0)

    order = [root, *below(root)]
    if not c:
        return ""
    able = [x for x in order if x[0] not in htmltext.INLINE and counts(x)[0]]
    sums = {id(x): sum(dense(y) for y in x[1] if not isinstance(y, str)) for x in order}
    best = max(able, key=lambda x: sums[id(x)])
    if not sums[id(best)]:
        best = max(able, key=dense)
    up = {id(y): x for x in order for y in x[1] if not isinstance(y, str)}
    path = [best]
    while path[-1] is not body and path[-1] is not root:
        path.append(up[id(path[-1])])
    least = min(map(dense, path)) / 2
    out = []

    def say(x, whole):
        for y in x[1]:
            block = isinstance(y, str) or y[0] in htmltext.INLINE
            if not block:
                out.append(" ")
            if isinstance(y, str):
                out.append(y)
            elif whole or any(y is z for z in path):
                say(y, whole or y is best)
            else:
                c, _, lc, _ = counts(y)
                alike = y[0] in htmltext.PROSE or y[0] in htmltext.INLINE or y[0] == next(z for z in path if up.get(id(z)) is x)[0]
                if c > 2 * lc and alike or dense(y) >= least > 0:
                    say(y, True)
            if not block:
                out.append(" ")

    if best is root:
        say(root, True)
    else:
        say(up[id(path[-1])] if path[-1] is not root else root, False)
    return " ".join("".join(out).split())


def test_same_as_plain_version():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))

    def text(n):
        return " ".join(word() for _ in range(rnd.randint(1, n)))

    def block(depth):
        kind = rnd.random()
        if depth > 4 or kind < 0.35:
            return f"<p>{text(30)}{'<a>' + text(3) + '</a>' if rnd.random() < 0.3 else ''} {'<b>' + text(4) + '</b>' if rnd.random() < 0.3 else ''}</p>"
        if kind < 0.5:
            return "<ul>" + "".join(f"<li><a>{text(3)}</a></li>" for _ in range(rnd.randint(1, 9))) + "</ul>"
        tag = rnd.choice(["div", "section", "details", "center"])
        return f"<{tag}>" + "".join(block(depth + 1) for _ in range(rnd.randint(0, 5))) + (text(6) if rnd.random() < 0.2 else "") + f"</{tag}>"

    got = 0
    for _ in range(400):
        page = "<body>" + "".join(block(0) for _ in range(rnd.randint(1, 5))) + "</body>"
        assert main_text(page) == plain_main_text(page), page
        got += bool(main_text(page))
    assert got > 300


def test_nulls_and_names(spark):
    d = spark.createDataFrame([(1, None, None, 3), (None, "u", "<p>t</p>", 4), (1, None, "", 5)], "page_id long, url string, html string, n_chars int")
    assert sorted(map(str, map(tuple, extract(d).collect()))) == sorted(map(str, [(1, None, "", 0), (None, "u", "t", 1), (1, None, "", 0)]))
    assert extract(d.limit(0)).count() == 0
    again = spark.createDataFrame([(7, "u", "<p>same</p>")] * 3, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    assert list(map(tuple, extract(again).collect())) == [(7, "u", "same", 4)] * 3
