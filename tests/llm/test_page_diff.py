import random
import re
from functools import lru_cache
from html import escape

import pytest
from helpers import SF, parquet_rows, prose, rows_of

from censusloom.llm import page_diff as P

PAGES = "page_id bigint, url string, html string"


def test_given_articles(spark):
    """The articles of the given pages, cut out by plain patterns."""
    from html import unescape

    expected = []
    for ident, url, page in parquet_rows("pages", "page_id, url, html"):
        article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        blocks = [unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1)>", article)]
        text = "\n\n".join(" ".join(b.split()) for b in blocks if b.split())
        expected.append((ident, url, text, len(text)))
    found = P.main_texts(spark.read.parquet(f"{SF}/pages.parquet"))
    assert rows_of(found, "page_id", "url", "text", "n_chars") == sorted(expected, key=repr)


# ---- alignment


def longest(a, b):
    @lru_cache(None)
    def go(i, j):
        if i == len(a) or j == len(b):
            return 0
        return max(go(i + 1, j), go(i, j + 1), 1 + go(i + 1, j + 1) if a[i] == b[j] else 0)

    return go(0, 0)


@pytest.mark.parametrize("seed", range(40))
def test_alignment_is_longest(seed):
    draw = random.Random(seed)
    a, b = (draw.choices(range(draw.randint(1, 6)), k=draw.randint(0, 30)) for _ in range(2))
    pairs = P.common_lines(a, b)
    assert len(pairs) == longest(tuple(a), tuple(b))
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_alignment_of_long_repetitive_pages():
    a = [1, 2, 1, 1, 3] * 4_000
    assert len(P.common_lines(a, a[7:] + [9])) == len(a) - 7
    assert len(P.common_lines([1] * 20_000, [2, 1] * 10_000)) == 10_000


# ---- blocks


def texts(page, *kinds):
    return [t for t, _, k in P.blocks_of(page) if not kinds or k in kinds]


def test_markup_that_names_what_goes():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><div id="cookie-notice">Cookies!</div>
    <main class="has-sidebar"><article><header><h1>Title</h1></header><p>One <b>bold</b>&nbsp;&amp; two<br>three
    <p>four <span class="ad">buy</span> five<script>var x = "</p><p>no";</script><form><p>mail</p></form>
    <!-- <p>hidden --><aside>side</aside><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>
    <section id=comments><article class=comment><p>first!</p></article></section></main>
    <div class="sideBar"><p>side</p></div><footer>foot</footer></body></html>"""
    assert texts(page, P.MAIN, P.INNER) == ["Title", "One bold & two three", "four", "five", "a", "b", "c", "d"]
    assert not texts(page, P.OPEN)


def test_broken_markup():
    assert texts("a < b &lt; c <3 & d &amp") == ["a < b < c <3 & d &"]
    assert texts("<p>x<p>y</div></p><b>z") == ["x", "y", "z"]
    assert texts("<p>x<script>never closed <p>y") == ["x"]
    assert texts("<p>x<!-- never closed <p>y") == ["x"]
    assert texts("<p>x</p><p class='a") == ["x"]
    assert texts('<p title="a>b">x</p>') == ["x"]
    assert texts('<p title="y>z') == ["z"]  # a quote that nothing closes ends with its tag
    assert texts("") == [] and texts(" \n ") == [] and texts("plain") == ["plain"]
    assert texts("<SCRIPT>a</Script ><P>x") == ["x"]


def test_long_pages_take_linear_time():
    assert len(texts("<p>a</p>" * 100_000)) == 100_000
    assert texts("<a '" * 50_001 + ">x") == ["x"]
    assert len(texts("<div>" * 3_000 + "x")) == 1


def test_addresses():
    assert P.address("http://A.example.com/x/1.html?q=1#f") == ("a.example.com", "/x/1?q=1")
    assert P.address("http://a.example.com/x/1/") == ("a.example.com", "/x/1")
    assert P.address(None) == ("", "") and P.address("") == ("", "") and P.address("not a url") == ("", "not a url")


# ---- differencing


def site(host, n, *, article="div", seed=0):
    """Pages without any telling markup: menu, notice and footer are shared, the rest is not."""
    pages = []
    for i in range(n):
        body = [prose(seed * 1000 + i * 10 + k, 12).replace("\n", " ").strip() for k in range(5)]
        if i % 4 == 0:
            body.append("A passage that some pages of the site repeat.")
        content = "".join(f"<p>{escape(b)}</p>" for b in body)
        page = (
            f'<body><div class="top"><span>Home</span> <span>News {host}</span></div><div class="box">We use cookies on {host}.</div>'
            f"<{article}>{content}</{article}><div class='end'>All rights: {host}</div></body>"
        )
        pages.append((f"http://{host}/{seed}/{i:05d}", page, "\n\n".join(" ".join(b.split()) for b in body)))
    return pages


def run(spark, rows):
    return P.main_texts(spark.createDataFrame(rows, PAGES).repartition(3))


def test_differencing_removes_what_neighbours_share(spark):
    pages = site("a.org", 30) + site("b.org", 9, seed=2)
    found = run(spark, [(i, u, h) for i, (u, h, _) in enumerate(pages)]).collect()
    texts_found = {r["page_id"]: r["text"] for r in found}
    for i, (_, _, text) in enumerate(pages):
        expected = text.removesuffix("\n\nA passage that some pages of the site repeat.")
        assert texts_found[i].startswith(expected) and "cookies" not in texts_found[i] and "rights" not in texts_found[i]


def test_a_marked_article_keeps_repeated_passages(spark):
    pages = site("a.org", 30, article="article")
    found = run(spark, [(i, u, h) for i, (u, h, _) in enumerate(pages)])
    assert rows_of(found, "page_id", "text") == sorted(((i, t) for i, (_, _, t) in enumerate(pages)), key=repr)


def test_copies_at_the_next_address_are_no_template(spark):
    pages = site("a.org", 12)
    rows = [(i, u, h) for i, (u, h, _) in enumerate(pages)] + [(100 + i, u + "?page=2", h) for i, (u, h, _) in enumerate(pages)]
    found = {r["page_id"]: r["text"] for r in run(spark, rows).collect()}
    for i, (_, _, text) in enumerate(pages):
        assert found[i] == found[100 + i] and found[i].startswith(text.split("\n\nA passage")[0])


def test_a_place_voted_elsewhere_goes_on_a_host_with_one_page(spark):
    pages = site("a.org", 30) + site("single.org", 1, seed=3)
    found = run(spark, [(i, u, h) for i, (u, h, _) in enumerate(pages)]).where("page_id = 30").first()
    assert found["text"].startswith(pages[30][2].split("\n\nA passage")[0]) and "cookies" not in found["text"]


def test_runs_meet_at_their_ends(spark, monkeypatch):
    """The result does not depend on how positions are cut into runs, nor on a hot host's size."""
    pages = site("a.org", 40) + site("b.org", 10, seed=1)
    rows = [(i, u, h) for i, (u, h, _) in enumerate(pages)]
    expected = rows_of(run(spark, rows), "page_id", "text")
    source = spark.createDataFrame(rows, PAGES).selectExpr("*", "md5(concat(url, decode(unhex('00'), 'UTF-8'), html)) AS ident")
    columns = ("host", "ident", "partners", "shared")
    whole = rows_of(P.shared_lines(source), *columns)
    monkeypatch.setattr(P, "RUN", 7)
    assert rows_of(P.shared_lines(source), *columns) == whole
    assert rows_of(run(spark, rows), "page_id", "text") == expected


def test_odd_rows(spark):
    long_page = "<article>" + "".join(f"<p>line {i}</p>" for i in range(20_000)) + "</article>"
    rows = [
        (1, None, None), (2, None, "<p>x</p>"), (None, "http://a.org/1", "<p>x</p>"), (None, None, None), (3, "", ""),
        (4, "http://a.org/1", "<article><p>x</p></article>"), (4, "http://a.org/1", "<article><p>x</p></article>"),
        (5, "http://a.org/2", long_page), (5, "http://a.org/3", "<nav>n</nav>"), (6, "::", "<p>é 中 文</p>"),
    ]
    found = rows_of(run(spark, rows), "page_id", "url", "n_chars")
    text = "\n\n".join(f"line {i}" for i in range(20_000))
    assert found == sorted(
        [(1, None, 0), (2, None, 1), (None, "http://a.org/1", 1), (None, None, 0), (3, "", 0), (4, "http://a.org/1", 1),
         (4, "http://a.org/1", 1), (5, "http://a.org/2", len(text)), (5, "http://a.org/3", 0), (6, "::", 5)],
        key=repr,
    )


def test_clashing_columns_and_empty_table(spark):
    names = ("host", "path", "ident", "places", "kinds", "texts", "run", "own", "position", "template", "gone")
    wide = spark.createDataFrame([(1, "http://a.org/1", "<p>x</p>")], PAGES).selectExpr("*", *[f"'y' AS {n}" for n in names])
    assert rows_of(P.main_texts(wide), "page_id", "text") == [(1, "x")]
    assert P.main_texts(spark.createDataFrame([], PAGES)).collect() == []
