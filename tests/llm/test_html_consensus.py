import html
import random
import re

import pytest
from common import prose
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorframe.llm import html_consensus as hc
from sensorframe.llm.queries import QUERIES


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], "page_id long, url string, html string, host string, votes long, path string")


def test_given_pages_match_their_articles(spark):
    got = {r.page_id: r for r in QUERIES["op10_html_consensus"](spark, SF).collect()}
    source = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(source)
    for p in source:
        body = re.search("<article>(.*)</article>", p.html, re.S)[1]
        parts = (html.unescape(re.sub("<[^>]*>", " ", x)) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body))
        expected = "\n".join(" ".join(x.split()) for x in parts if x.strip())
        r = got[p.page_id]
        assert (r.text, r.n_chars, r.url) == (expected, len(expected), p.url)


@pytest.mark.parametrize(("source", "text"), [
    ("<body><main><article><header><h1>T</h1><p>by</p></header><p>a&nbsp;b &lt;c&gt;<p>d <a href=x>e</a><ul><li>f<li>g</ul></article></main>", "T\na b <c>\nd e\nf\ng"),
    ("<article><p>long text here</p><section class='comments'><p>reader says</p></section><aside>x</aside><div id=cookieNotice>y</div></article>", "long text here"),
    ("<article><p>one &amp;amp; two<br>three</p><script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p>four</article>", "one &amp; two three\nfour"),
    ("<article><p>a < b and 1<2 <b>bold</b>x</p><form><p>search</p></form><table><tr><td>c<td>d</table>", "a < b and 1<2 boldx\nc\nd"),
    ("<div><nav>n</nav><p>plain page</p></div>", "plain page"), ("just text", "just text"), ("", ""), ("<p>", ""), ("<!-- never closed", ""),
    ("<body><div class='header'><h1>Site</h1>x</div><main><h1>Title</h1><div class='content'><p>the text of it</p></div></main>", "Title\nthe text of it"),
    ("<body><h1><a href=/>Site</a></h1><div class='content'><p>the text of it</p></div>", "the text of it"),
    ("<article><div class='entry-header'><h1>T</h1><span>by</span></div><p>body text</p></article>", "T\nbody text"),
    ("<div class='content with-sidebar'><article class='post tags-x'><p>the text</p><article class='comment'><p>I say</p></article></article></div>", "the text"),
    ("<article><p title='a>b'>t</p><p x=\"unclosed>u</p></article>", "t\nu"),
])
def test_small_pages(source, text):
    assert hc.main_text(hc.parse(source), []) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='x1'>", "</div>", "<article>", "</article>", "<", ">", "&amp;", "a", " ", "<!--", "-->", "<script>",
                                 "</script>", "<b", "'", '"', "<li>", "<td>", "</", "<br/>", "\n"]), max_size=25).map("".join))
def test_any_input_parses(source):
    page = hc.parse(source)
    assert all(t == " ".join(t.split()) and t for _, t, _ in page.blocks)
    hc.main_text(page, [hc.path_key("/article")])
    assert sum(hc.votes(page).values()) <= 1002


def test_consensus_beats_a_page_with_a_longer_other_part(spark):
    """On one page of a host the related texts are longer than the article; the host's path decides."""
    def page(article, other):
        return f"<body><div class='box3'><p>{article}</p></div><div class='else{len(other)}'><p>{other}</p></div></body>"

    rows = [(i, "http://h.org/x", page(prose(60, i), "few words")) for i in range(5)]
    rows += [(5, "http://h.org/y", page("short article", prose(90))), (6, "http://other.org/", page("short", prose(90, 5)))]
    got = {r.page_id: r.text for r in hc.extract(pages(spark, rows)).collect()}
    assert got[5] == "short article" and got[0] == " ".join(prose(60).split())
    assert got[6] == " ".join(prose(90, 5).split())


def test_awkward_rows(spark):
    long = "<article>" + "".join(f"<p>paragraph {k}</p>" for k in range(30_000)) + "</article>"
    rows = [(1, None, None), (2, "http://a.org", ""), (None, "x", "<p>a</p>"), (3, None, "<p>b</p>"), (3, None, "<p>b</p>"), (4, "http://a.org/", long),
            (5, "http://a.org/", "<div>" * 3000 + "deep"), (6, "http://a.org", "<nav>menu</nav>")]
    got = sorted(((r.page_id, r.text, r.n_chars) for r in hc.extract(pages(spark, rows)).collect()), key=repr)
    text = "\n".join(f"paragraph {k}" for k in range(30_000))
    assert got == sorted([(1, "", 0), (2, "", 0), (None, "a", 1), (3, "b", 1), (3, "b", 1), (4, text, len(text)), (5, "deep", 4), (6, "", 0)], key=repr)
    assert hc.extract(pages(spark, []).limit(0)).count() == 0


def test_rare_paths_of_a_host_are_left_out(spark):
    rng = random.Random(0)
    rows = [(i, "http://h.org", f"<div class='a'><p>{prose(50, i)}</p></div>") for i in range(60)]
    rows += [(100 + i, "http://h.org", f"<div class='odd-{'abcdefgh'[i]}'><p>{prose(50, rng.randrange(99))}</p></div>") for i in range(2)]
    got = {r.host: r.paths for r in hc.host_paths(pages(spark, rows)).collect()}
    assert got["h.org"] == [hc.path_key("/div.a")]
