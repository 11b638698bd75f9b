from __future__ import annotations

import time

import pytest
from pyspark.sql import types as T

from turnwise.llm import html_paths as H
from turnwise.llm.common import prepare

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType()), T.StructField("text", T.StringType())])


@pytest.fixture
def texts(spark):
    prepare(spark)

    def run(rows):
        found = H.main_texts(spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES).repartition(2), "test")
        assert found.columns == ["id", "url", "text"]
        return sorted((r.id if r.id is not None else -1, r.text) for r in found.collect())

    return run


def alone(html):
    return H.extract(H.parse(html), [])


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><h1>T</h1><p><b>One.<br><p>Two\n\t &amp; three</p></article>", "T\n\nOne.\n\nTwo & three"),
        ("<nav>m</nav><header>h</header><article><p>a</p><form>f<p>g</p></form><aside>s</aside></article><footer>f</footer>", "a"),
        ("<div class='cookie-notice'>c</div><div id=content class=with-sidebar><header><h2>H</h2></header><p>a</p><div class='adSlot ad-1'>x</div></div><div class=sidebar>s</div>", "H\n\na"),
        ("<main><p>a<ul><li>b<li>c</ul><section class=comments><p>no</p></section></main>", "a\n\nb\n\nc"),
        ("<p>a &lt;b&gt; &#233;&#x4E2D; &copy &bogus;", "a <b> é中 © &bogus;"),
        ("<article><p>x<script>var a='</p>';</script>y<style>p{}</style><!-- <p>c --> z</p></article>", "xy z"),
        ("<article><pre>a  b\n c</pre><table><tr><td>1<td>2<tr><td>3</table></article>", "a b c\n\n1\n\n2\n\n3"),
        ("<article><p>a<i>b</i>c <a href=x>d</a></p></article></div></p></html>", "abc d"),
        ("plain text", "plain text"), ("", ""), ("<nav>only</nav>", ""), ("<", "<"), ("a < b", "a < b"), ("<!-- open", ""), ("<script>open", ""), ("<article><p title='x>y'>q", "q"),
    ],
)
def test_text_of_a_page(html, text):
    assert alone(html) == text


def test_host_consensus_overrules_a_page(texts):
    usual = "<body><div class=story-{0}><p>{1}</p></div><div class=box><p>{2}</p></div></body>"
    rows = [(i, "http://h.com/", usual.format(i, "main text of the page " * 5, "box")) for i in range(9)]
    rows.append((9, "http://H.com/x", usual.format(9, "short", "a box with far more text than the story has " * 3)))
    got = dict(texts(rows))
    assert got[0] == ("main text of the page " * 5).strip() and got[9] == "short"


def test_odd_rows(texts):
    rows = [(1, None, None), (2, "http://a/", ""), (2, "http://a/", ""), (3, "x", "<article><p>" + "long " * 50_000), (None, "http://a/", "<article>t</article>"), (4, None, "<p>\x00")]
    assert texts(rows) == [(-1, "t"), (1, ""), (2, ""), (2, ""), (3, ("long " * 50_000).strip()), (4, "\x00")]
    assert texts([]) == []


def test_deep_pages_take_no_quadratic_time():
    deep = "<div>x" * 20_000 + "</ul>" * 20_000
    assert len(H.extract(H.parse(deep), ["html>body", "div"]).split()) == 20_000


def test_registered_pages(spark):
    """Pages of the driver tables: heading and paragraphs of their one article."""
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.id: r.text for r in H.main_texts(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), "test").collect()}
    for r in rows:
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = (" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", article))
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def test_a_host_of_two_layouts(texts):
    intro, main = "short intro", "main text of the page " * 9
    one = f"<body><div class=content><p>{main}</p></div></body>"
    two = f"<body><div class=content><p>{intro}</p></div><article><p>{main}</p></article></body>"
    rows = [(i, "http://h.com/", one if i % 10 < 7 else two) for i in range(60)]
    # A layout of one page only, too rare to win.
    rows.append((60, "http://h.com/", f"<body><div class=content><p>{intro}</p></div><section class=rare><p>{main}</p></section></body>"))
    assert {text for _, text in texts(rows)} == {main.strip()}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p>a <svg width=1 />b</p><p>c</article>", "a b\n\nc"), ("<article><p>a <math/>b <svg/>c<svg><text>no</text></svg>d</article>", "a b cd"),
        ("<article><p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p></article>", "if x=1 then"),
        ("<body><div class='fixed-header content'><p>text of the page</p></div><div class=sidebar>s</div></body>", "text of the page"),
        ("<div class=nav-open><div class=nav>m</div><h1>T</h1><p>text</p><div class=comments><article>no comment</article></div></div>", "T\n\ntext"),
        ("<article><h1>T</h1><p class=byline>by me</p><p>a</p><div class=related>r</div><p class=copyright>c</p><div class=share-note>s</div></article>", "T\n\nby me\n\na\n\nr\n\nc\n\ns"),
        ("<div><p>long enough text</p><p>and <span class=ad>buy</span>more</p></div><div class=comments>comments that are far longer than the page's text</div>", "long enough text\n\nand more"),
    ],
)
def test_no_text_is_lost_in_parsing(html, text):
    assert alone(html) == text


@pytest.mark.parametrize(("page", "want"), [
    ("<article><p>one</p><svg><path d='x'><p>two</p></article>", "one\n\ntwo"),
    ("<article><p>one</p><svg><path d='x'><p>two</p><svg><g/></svg><p>three</p></article>", "one\n\ntwo\n\nthree"),
    ("<article><p>one</p><svg><svg><text>no</text></svg><text>no</text></svg><p>two</p></article>", "one\n\ntwo"),
    ("<article><p>one</p><iframe src=x><p>two</p></article>", "one\n\ntwo"),
    ("<article><p>one <iframe src=x>two</article>", "one"),
    ("<article><p>one</p><template><div>no</div><template>no</template>no</template><p>two</p></article>", "one\n\ntwo"),
    ("<article><p>one</p><textarea>no<p>two</p></article>", "one\n\ntwo"),
    ("<title>no<body><article><p>one</p></article>", "one"),
    ("<article><p>one</p><script>x < y</article>", "one"),
    ("<article><p>one <![CDATA[ x > y ]]> two</p></article>", "one y ]]> two"),
])
def test_elements_that_are_not_closed_keep_the_rest(page, want):
    assert H.extract(H.parse(page), []) == want


@pytest.mark.parametrize("make", [
    lambda n: "<b>" * n + "<p>x" * n, lambda n: "<p><div>" + "<b>" * n + "<p>x" * n, lambda n: "<b><div>" + "<i>" * n + "</b>x" * n, lambda n: "<b>" * n + "x<hr>" * n,
    lambda n: "<svg>" * n + "<p>x", lambda n: "<textarea>" * n + "x", lambda n: "<div>" * n + "x", lambda n: "<ul>" + "<li><b>x" * n, lambda n: "<template><p>x" * n,
])
def test_parsing_takes_time_in_proportion(make):
    H.parse(make(100)).paths()
    start = time.perf_counter()
    H.extract(H.parse(make(20_000)), ["html>body"])
    assert time.perf_counter() - start < 4


def test_deep_paths_are_told_apart():
    deep = "<div class='level'>" * 600
    one, other = (H.parse(f"{deep}<div class='{c}'>text</div>").paths()[-1] for c in ("a", "b"))
    assert one != other and len(one) <= H.PATH_CHARS
