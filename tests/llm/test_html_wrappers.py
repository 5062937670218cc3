from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from affinity.llm import html_wrappers as op

PAGES = "page_id long, url string, html string"
HEAD = "<html><head><title>T</title><style>p{x:1}</style><script>var a='</p><article>no';</script></head><body>"
MENU = "<nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
FOOT = "<aside class=sidebar>side</aside><form><p>Search</p></form><footer>&copy; 2024</footer></body></html>"


def article(n):
    blocks = "".join(f"<p>Para {i} &amp; <b>bold</b>\n  text<br>line" for i in range(n))
    return f"<article><h1>Title &lt;{n}&gt;</h1>{blocks}<div class='ad'>Buy!</div></article>"


def plain(n):
    return "\n\n".join([f"Title <{n}>", *(f"Para {i} & bold text line" for i in range(n))])


def extracted(spark, rows):
    pages = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("x") for c in ("host", "row", "text", "content", "stream")})
    return {r["page_id"]: r["text"] for r in op.extract(pages).select("row.page_id", "text").collect()}


def test_article_is_taken_whole_and_alone(spark):
    rows = [(n, f"https://h{n % 2}.example.com/{n}", HEAD + MENU + article(n) + FOOT) for n in range(1, 8)]
    rows.append((20, "https://h1.example.com/c", HEAD + article(2) + "<section id=comments><article>me too</article></section>" + FOOT))
    assert extracted(spark, rows) == {n: plain(n) for n in range(1, 8)} | {20: plain(2)}


def test_without_article_the_container_with_most_text(spark):
    body = "".join(f"<p>Sentence {i} of the long story that the page tells.</p>" for i in range(5))
    page = HEAD + "<div id=top><p>Short teaser</p></div><div class='story'><h2>Head</h2>" + body + "</div><div class='related'><p>More to read elsewhere on this site, much more of it.</p></div>" + FOOT
    got = extracted(spark, [(1, "http://x.org/1", page), (2, "http://x.org/2", page)])
    expected = "\n\n".join(["Head", *(f"Sentence {i} of the long story that the page tells." for i in range(5))])
    assert got == {1: expected, 2: expected}


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "no url", ""), (3, "http://a.b/", "just text &eacute; &#x4e2d;"), (4, "http://a.b/", "<p>cut off &amp in the <b"),
        (5, "http://a.b/", "<p>one<p>two</div></p>"), (5, "http://a.b/", "<p>one<p>two</div></p>"), (6, "http://a.b/", "a < b <!-- x --> c <![CDATA[z]]>"),
        (7, "http://a.b/", "<article><p>" + "long " * 50_000 + "</p></article>"), (8, "http://a.b/", "<" * 3000 + "\"'>'"),
    ]
    got = extracted(spark, rows)
    assert got[1] == got[2] == "" and got[3] == "just text é 中" and got[4] == "cut off & in the"
    assert got[5] == "one\n\ntwo" and got[6].startswith("a < b") and len(got[7]) == 50_000 * 5 - 1
    assert op.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_wrapper_has_slots_repeats_and_options(spark):
    rows = [(1, HEAD + MENU + article(1) + FOOT), (2, HEAD + MENU + article(4) + FOOT), (3, HEAD + article(3) + FOOT)]
    pages = spark.createDataFrame([("h", page) for _, page in rows], "host string, html string")
    row = op.wrappers(pages).collect()
    assert len(row) == 1 and row[0]["content"] == "article"
    wrapper = row[0]["wrapper"]
    assert "(<li>#</li>)+" in wrapper and "(<p>#</p>)+" in wrapper and ")?" in wrapper


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("abc", "abc", "<a><b><c>"),
        ("ac", "abc", "<a>(<b>)?<c>"),
        ("abd", "acd", "<a>(<b>)?(<c>)?<d>"),
    ],
)
def test_alignment(a, b, expected):
    assert op.expression(op.align([(x, 0) for x in a], [(x, 0) for x in b])) == expected


def test_single_against_repeated_group():
    once = [(x, 0) for x in ("p", "#", "/p")]
    often = [(x, 0) for x in op.fold(["p", "#", "/p"] * 3)]
    assert op.expression(op.align(once, often)) == "(<p>#</p>)+" == op.expression(op.align(often, once))
