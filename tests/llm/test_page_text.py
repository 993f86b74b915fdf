"""HTML extraction: the articles of the given pages, other layouts, broken markup, hard rows."""

import html
import re
import time

import pytest

from riskloom.llm.page_text import blocks, extract, page_texts, read_page

LONG = "The house on the hill was built by the men of the town, and it is still there for all that have eyes to see it in the light of day."
MORE = "It was in the spring that the river rose, and they had to move the boats to the other side of the bridge for the night, which was cold."


def text(page):
    return read_page(page).text


def test_articles_of_the_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in page_texts(rows).collect()}
    assert len(got) == rows.count()
    for r in rows.collect():
        inside = re.sub(r"</?b>|<br>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        want = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id].text == "\n".join(x for x in want if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><a href=/>Home</a><a href=/b>Blog</a></nav><main><h1>Old house</h1><p>{LONG}</p><p>Yes.</p><p>{MORE}</p></main><footer>© 2020</footer>",
        f"<div id=header>The Daily News of the town</div><div class=content><h1>Old house</h1><p>{LONG}<p>Yes.<p>{MORE}</div><div class='side-bar sidebar'>{LONG}</div>",
        f"<header><h1>The News</h1></header><h1>Old house</h1><p>{LONG}</p><p>Yes.</p><p>{MORE}</p><div class='cookie-notice'>{LONG}</div>",
        f"<article><header><h1>Old house</h1></header><p>{LONG}</p><div class=advertisement>Buy it now</div><p>Yes.</p><p>{MORE}</p><footer>More of it</footer></article><section id=comments><h2>Comments</h2><p>{MORE}</p></section>",
        f"<article><h1>Old house</h1><p>{LONG}</p><p>Yes.</p><p>{MORE}</p></article><section><h3>3 comments</h3><p>{MORE}</p></section>",
        f"<div class=post><h1>Old house</h1><p>{LONG}</p><p>Yes.</p><p>{MORE}</p><section><h3>3 comments</h3><p>{MORE}</p></section></div>",
        f"<ARTICLE><H1>Old house</H1><!-- <p>no --><SCRIPT>if (a</b) '<p>'</SCRIPT><P>{LONG}<P>Yes.<P>{MORE}<form><label>Name</label><input></form>",
        f"<body class='has-sidebar no-comments'><div itemprop=articleBody><h1>Old house</h1><p>{LONG}</p><p>Yes.</p><p>{MORE}</p></div><ul><li><a href=1>{LONG}</a></li></ul>",
    ],
)
def test_layouts(page):
    assert text(page) == f"Old house\n{LONG}\nYes.\n{MORE}"


def test_ambiguous_blocks_take_the_label_of_the_nearest_decided():
    filler = "<p>Short one.</p>"
    page = f"<p>{LONG}{MORE}</p>{filler}<p>{LONG}{MORE}</p>{filler * 2}<ul><li><a href=a>Link to what is far away</a></li></ul>{filler}"
    assert [b.label for b in read_page(page).blocks] == ["good", "good", "good", "good", "bad", "bad", "bad"]


def test_references_spaces_and_breaks():
    assert text("<article><p>a &amp; b&lt;c&gt;\n\t&nbsp; d &#233;&eacute &x</p></article>") == "a & b<c> d éé &x"
    assert text("<article><p>one<br>two<br/><br>three</p><div>four<b>five</b></div>six</article>") == "one two\nthree\nfourfive\nsix"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<!--", "<script>", "<p", "</", "<nav>a</nav>", "a < b", "<a href='", "<article></article></article></p>"])
def test_odd_pages(page):
    assert text(page) == ""


def test_stray_and_unclosed_tags():
    assert text("</div></p><article><b>One<p><i>Two</article>Three") == "One\nTwo"
    assert text("<nav><ul><li>Menu<article><p>One</article>") == "One"
    assert text("<article>x<button>go<p>One</p></article>") == "xgo\nOne"
    assert text("<article><p>a < b and 1<2</p></article>") == "a < b and 1<2"


@pytest.mark.parametrize("part", ["<div>", "<p>a", "<b", "<!--", "<a href=\"", "</p>", "<button>", "&amp", "<br>", "x ", "<div class='", "=\"", "<svg>", "&lt;"])
def test_long_pages_take_linear_time(part):
    began = time.time()
    read_page("<article>" + part * 200_000)
    assert time.time() - began < 10


def test_hard_rows(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = spark.createDataFrame([(1, "u", page, "a"), (1, "u", page, "a"), (None, None, None, None), (3, None, "", "b")], "page_id long, url string, html string, text string")
    assert sorted(page_texts(rows).collect(), key=str) == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (3, None, "", 0)], key=str)
    assert page_texts(rows.limit(0)).count() == 0
    more = rows.withColumns({"label": rows.url, "n_chars": rows.url, "place": rows.url, "markup": rows.url})
    assert page_texts(more).count() == 4
    kept = extract(more, ["page_id", "label", "markup"]).collect()
    assert {r.label for r in kept} == {"u", None}
    assert [(r.place, r.kind, r.label) for r in blocks(more.where("page_id = 1").limit(1)).collect()] == [(0, "p", "good")]
