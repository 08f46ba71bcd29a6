import html as H
import re
import time

import pytest

from placewright.llm.html_text import extract, extract_pages, op8_html_text

SF = "/root/testdata/sf0.01"


def test_pages_of_the_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op8_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        want = " ".join(H.unescape(re.sub(r"<[^<>]*(>|$)", lambda m: "" if re.match(r"</?b>", m[0]) else " ", body)).split())
        assert r.text == want, r.page_id
        assert r.n_chars == len(want) and r.url == pages[r.page_id].url


def article_of(page: str) -> str:
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    return " ".join(H.unescape(re.sub(r"<[^<>]*(>|$)", lambda m: "" if re.match(r"</?b>", m[0]) else " ", body)).split())


@pytest.mark.parametrize("mark", ["div", ""])
def test_pages_without_article_and_class_names(spark, mark):
    """The clusters alone find the region: article elements become plain ones or go, classes go."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()
    right = []
    for r in rows:
        plain = re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)article>", rf"<\1{mark}>" if mark else "", r.html))
        want = article_of(r.html)
        right.append((len(want), extract(plain) == want))
    assert sum(ok for _, ok in right) > 0.95 * len(right)
    # only articles of a few short lines cannot be told from an unmarked advert
    assert all(ok for n, ok in right if n > 2000)


def test_two_regions_of_unmarked_text():
    text = "A long paragraph that says a good deal about its subject, sentence after sentence, to the end. " * 3
    page = f"<body><div>advert line</div><div><h1>T</h1><div><p>{text}</p></div><p>x</p><div><p>{text}</p></div></div><div><a href=/a>{text}</a></div></body>"
    assert extract(page) == " ".join(f"T {text} x {text}".split())


def test_plain_pages_without_an_article_element():
    text = "A long paragraph of the article that says a good deal about its subject, sentence after sentence. " * 3
    page = f"""<html><head><title>T</title></head><body><div id="top-nav"><a href=/>Home</a><a href=/n>News</a></div>
    <div><a href=/1>one</a></div><div><a href=/2>two</a></div>
    <div><p>{text}</p><p>Short.</p><p>{text}</p></div>
    <div class="comments"><p>{text}</p></div><aside>{text}</aside><form>Name <input></form><div class="cookie-notice">We use cookies {text}</div>
    <script>if (a<b) document.write("<p>x</p>")</script></body></html>"""
    assert extract(page) == " ".join(f"{text} Short. {text}".split())


def test_markup_corner_cases():
    assert extract(None) == extract("") == extract("<p>") == ""
    assert extract("<article><p>a&amp;b &lt;x&gt;<br>c&nbsp;&nbsp;d<b>e</b>f<td>g") == "a&b <x> c def g"
    assert extract("<article><header>no</header><p>yes &am") == "yes &am"
    assert extract("<article><p>yes</p><p cla") == "yes"
    assert extract("<nav><a>x</a><article>in</article>") == "in"
    assert extract("<article>t<article class=comment>no</article><div class='reader-comments'><p>no</p></div> u</article>") == "t u"
    assert extract("plain text only") == "plain text only"
    assert extract("<article>" + "<p>word word</p>" * 20000) == " ".join(["word word"] * 20000)


def test_broken_declarations():
    assert [extract(s) for s in ("<![foo[bar]]>x", "<!-->x", "<!--->x", "<!DOCTYPE [>x", "<![CDATA[x]]>y", "x<!-- no end <p>y", "<!x>y", "<a href=/>menu</a>")] == ["x", "x", "x", "x", "y", "x", "y", ""]


def test_deep_nesting_takes_linear_time():
    for s in ("<b>", "<div>", "<p><b>", "<b></i>", "<td><tr>", "<article>", "<a "):
        t = time.time()
        extract(s * 100_000 + "word>")
        assert time.time() - t < 30, s


def test_broken_page_in_a_job(spark):
    df = spark.createDataFrame([(1, "u", "<![foo[bar]]><article>a</article>"), (2, "u", "<!-->" * 9 + "<p>b</p>")], "page_id long, url string, html string")
    assert sorted(r.text for r in extract_pages(df).collect()) == ["a", "b"]


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "u", "", 2), (1, "u", "<article>a</article>", 3), (1, "u", "<article>a</article>", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in extract_pages(df).collect()) == [("", 0), ("", 0), ("a", 1), ("a", 1)]
    assert extract_pages(df.limit(0)).count() == 0
