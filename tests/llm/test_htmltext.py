"""Main text of hand-made pages, of broken markup, and of the test table's pages."""

import re
import time
from html import unescape

import pytest

from stagewise.llm import htmltext
from stagewise.llm.htmltext import main_text
from stagewise.llm.queries import op12_html

A = ("The harbour was quiet in the early morning and the boats were still at their moorings, "
     "which is not what the visitors had expected of it.")
B = ("Nobody knew who had ordered the crates, but they were there, and there was no one to "
     "ask about them on a Sunday.")
SHORT = "It rained."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_parts_of_a_page():
    got = main_text(page(f"""
      <header><h2>Daily</h2><p>{A}</p></header>
      <nav><ul><li><a href="/a">Home</a><li><a href="/b">World</a></ul></nav>
      <aside><p>{B}</p></aside>
      <article><h1>A quiet &amp; strange day</h1><p>{A}</p><p>{SHORT}</p>
        <script>var x = "<p>{B}</p>";</script><style>p {{ }}</style>
        <div class="ad-slot">{B}</div><form><p>{B}</p></form><p>{B}</p>
        <noscript>Please enable scripts and all of it.</noscript>
        <section id="comments"><h3>2 comments</h3><p>{A}</p></section>
      </article>
      <div class="cookie-notice">{A}</div><footer><p>{B}</p></footer>"""))
    assert got == "\n\n".join(["A quiet & strange day", A, SHORT, B])


def test_density_rules_without_any_hint():
    links = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(8))
    got = main_text(page(f"""<div><ul>{links}</ul></div><div><h1>Harbour</h1><p>{A}</p>
      <p>{SHORT}</p><p>{B}</p></div><div><a href="/x">Imprint</a> <a href="/y">Contact</a></div>
      <div><ul>{links}</ul></div>"""))
    assert got == "\n\n".join(["Harbour", A, SHORT, B])


def test_short_blocks_take_the_nearest_label():
    found = [htmltext._Block("x", 0, 0, htmltext._Place("", False, False, False), h, False)
             for h in (False, False, False, False, True, False)]
    for i, label in ((0, 1), (3, 0), (5, 1)):
        found[i].label = label
    htmltext._second_pass(found)
    assert [b.label for b in found] == [1, 1, 0, 0, 1, 1]


def test_references_and_white_space():
    got = main_text(page(f"<article><p>{A} caf&eacute; &#x4e2d;&nbsp;&lt;b&gt;\n\t x<br>y"
                         "<b>bold</b>ly</p></article>"))
    assert got == f"{A} café 中 <b> x yboldly"


def test_comments_after_a_heading_only():
    got = main_text(page(f"<article><p>{A}</p><h2>Comments</h2><div><p>{B}</p></div></article>"))
    assert got == A
    assert main_text(page(f"<article><p>{A}</p><p>Comments</p><p>{B}</p></article>")) \
        == "\n\n".join([A, "Comments", B])


def test_container_named_like_a_sidebar_around_an_article():
    got = main_text(page(f'<div class="has-sidebar"><main><p>{A}</p></main></div>'))
    assert got == A
    got = main_text(page(f'<div class="widget"><article><p>{A}</p></article></div>'))
    assert got == A


def test_hints_on_paragraphs_and_spans():
    got = main_text(page(f'<article><p class="byline">By {A}<p>{B} <span class="share">Share this'
                         f"</span><ul><li class=promo>{A}<li>{A}</ul></article>"))
    assert got == "\n\n".join([B, A])


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("plain < 3 & more", "plain < 3 & more"),
    ("a<b", "a<b"), (f"<article><p>{A}<p>{B}", f"{A}\n\n{B}"),
    (f"<article><p>{A}</p><!-- open", A), (f"<article><p>{A}</p><script>x", A),
    (f"<article><p title='a > b'>{A}</p></article>", A),
    (f"<article><p title='it\">{A}</p></article>", A),
    (f"</nav></div><article><p>{A}</b></i></article></div>", A),
    (f"<ARTICLE><P>{A}</P></ARTICLE><NAV>{B}</NAV>", A),
    (f"<nav><p>{B}<article><p>x</article>", ""),
])
def test_odd_pages(html, want):
    assert main_text(html or "") == want


@pytest.mark.parametrize("piece", [
    "<", "<a", '<a "', "<div>", "<p><b>", "</div>", "<!--", "<script>", "x ", "<a href='>", "<br>",
    "<span class=ad>", "&amp", "<li><a href=x>y", "<h2>Comments</h2>"])
def test_very_long_pages_take_linear_time(piece):
    begin = time.process_time()
    main_text(piece * (400_000 // len(piece)) + ">")
    assert time.process_time() - begin < 10


def test_table_with_nulls_repeats_and_more_columns(spark):
    html = page(f"<article><p>{A}</p></article>")
    rows = [(1, "u", html, "x"), (1, "u", html, "x"), (None, None, html, "x"), (2, "v", None, "x"),
            (3, "w", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in htmltext.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", A, len(A)), (1, "u", A, len(A)), (None, None, A, len(A)),
                          (2, "v", "", 0), (3, "w", "", 0)], key=repr)
    assert htmltext.extract(df.where("page_id = 0")).collect() == []


def test_query_on_the_test_table(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in op12_html(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*)</article>", p.html, re.S).group(1)
        parts = (re.sub("<[^>]*>", "", x.replace("<br>", " "))
                 for x in re.split(r"</?(?:p|h1)>", inner))
        parts = (" ".join(unescape(x).split()) for x in parts)
        want = "\n\n".join(x for x in parts if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (want, len(want))
