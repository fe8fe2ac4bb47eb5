"""Main text extraction on the given pages and on pages of other make."""

import html
import re

import numpy as np
import pytest

from fleetlens.llm import html_text, queries

SF = "/root/testdata/sf0.01"
PROSE = "The storm came over the hills at night and nobody in the village slept before the morning. " * 3


def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op3_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html or "", re.S)
        plain = " ".join(html.unescape(re.sub(r"</?(?:p|br|h1)>", "\n", re.sub(r"</?b>", "", article.group(1)))).split()) if article else ""
        assert r.text == plain and r.n_chars == len(plain) and r.url == pages[r.page_id].url


def _page(body):
    return f"<html><head><title>Title</title><script>var a = '<p>no</p>';</script><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("body", [
    f"<header><h1>Site</h1></header><nav><a href=/>Home</a> <a href=/x>News</a></nav><main><h1>Storm</h1><p>{PROSE}</main><footer>(c) all rights</footer>",
    f"<div class='site-header'>Site name</div><div id=content><h1>Storm</h1><p>{PROSE}</p></div><div id=comments><p>First! {PROSE}</p></div>",
    f"<article><header><h1>Storm</h1></header><p>{PROSE}<aside>Related stories {PROSE}</aside><section class='comments'><p>Nice {PROSE}</p></section></article>",
    f"<article><h1>Storm</h1><p>{PROSE}</p><form><label>Mail</label><input><button>Send</button></form></article><div class='cookie-notice'>We use cookies {PROSE}</div>",
    f"<ul><li><a href=1>One link</a><li><a href=2>Another link</a></ul><p>Storm<p>{PROSE}</p><table><tr><td><a href=3>Third</a></td></tr></table>",
    f"<div role=navigation>Menu {PROSE}</div><article><h1>Storm</h1><!-- <p>no</p> --><p>{PROSE}</p><div class='ad'>Buy {PROSE}</div></article>",
    f"<article><h1>Storm</h1><p>{PROSE}</p><p class='advert'>Buy {PROSE}<p id=cookieNotice>We use {PROSE}</article><article class='comment'>First {PROSE}</article>",
    f"<main><h1>Storm</h1><ul><li class=ad>Buy<li>{PROSE}</ul><div class='newsletterSignup'>Join {PROSE}</div><article class='comment-1 comment'>Hi</article></main>",
])
def test_other_pages(body):
    assert html_text.main_text(_page(body)) == f"Storm {PROSE.strip()}"


def test_markup_details():
    t = html_text.main_text
    assert t("<article>a &amp; b&nbsp;c &lt;p&gt; 3 < 4 caf&eacute;<br>d<b>e</b>f</article>") == "a & b c <p> 3 < 4 café def"
    assert t("<article><p title='a > b'>x</p><p>y\n\t z</article>") == "x y z"
    assert t("<article>kept<!-- open <p>lost</article>") == "kept"
    assert t("<article>kept<script>lost</article>") == "kept"
    assert t("<article>kept<div>too") == "kept too"
    assert [t(x) for x in (None, "", "<", "<a", "</", "<!--", "   ")][:2] == ["", ""]
    assert t("plain words only") == "plain words only"


@pytest.mark.parametrize("body", [
    f'<article><h1>Storm <svg class="icon"/></h1><p>{PROSE}</p></article>',
    f'<article><h1>Storm <svg class="icon"/></h1><p>{PROSE}</p></article><footer><svg><title>Up</title><path d="M0"/></svg></footer>',
    f'<article><h1><svg viewBox="0 0 1 1"><title/><style/><g><svg><text>no</text></svg><text>no</text></g></svg>Storm</h1><math display="block" /><p>{PROSE}</p></article>',
    f'<article><h1><a href=x><svg><path d="M0"></a>Storm</h1><svg><g><p>{PROSE}</p><svg><![CDATA[ </svg> no ]]></svg></article>',
    f'<article><h1>Storm</h1><p>{PROSE}</p><div><object data=x>no</div><div><template><p>no</p></div></article>',
    f'<article><h1>Storm</h1><p class=ad>Buy <svg><path d="M0"/></svg> now</p><p>{PROSE}<select><option>no<option>no</article>no',
])
def test_svg_and_unclosed_elements_without_text(body):
    assert html_text.main_text(_page(body)) == f"Storm {PROSE.strip()}"


@pytest.mark.parametrize("body", [
    *(f"<div class='{c}'><article><h1>Storm</h1><p>{PROSE}</p></article></div>" for c in (
        "has-sidebar", "content no-sidebar", "layout-nav", "hidden-print", "sidebar", "overlay", "main-nav")),
    *(f"<div id={i}><main><h1>Storm</h1><div class=widget><article><p>{PROSE}</p></article></div></main></div>" for i in ("menu", "comments")),
    f"<div class='content no-sidebar'><h1>Storm</h1><p>{PROSE}</p></div><div class='ad-slot-2'>Buy {PROSE}</div><p class='menu-navbar'>Buy {PROSE}",
    f"<article><h1 id=storm>Storm</h1><p>{PROSE}</p></article><div class=related-posts><article>Other {PROSE[:80]}</article></div>",
    f"<div id=content><h1>Storm</h1><p>{PROSE}</p></div><div id=comments><article>First {PROSE[:80]}</article></div>",
    f"<article class=has-comments><h1>Storm</h1><p>{PROSE}</p><div class=comments-section><article>First {PROSE * 2}</article></div></article>",
])
def test_names_of_wrappers(body):
    assert html_text.main_text(_page(body)) == f"Storm {PROSE.strip()}"


@pytest.mark.parametrize("body", [
    f"<main><article><h1>Storm</h1><p>{PROSE}</p></article><section class='comments'><article>First {PROSE * 3}</article></section></main>",
    f"<main><h1>Storm</h1><p>{PROSE}</p><div id=comments><article>First {PROSE * 3}</article><article>Second {PROSE}</article></div></main>",
    f"<article><h1>Storm</h1><p>{PROSE}</p></article><div class='widget'><div class='reader-comments'><article>First {PROSE * 3}</article></div></div>",
    f"<article><h1>Storm</h1><p>{PROSE}</p></article><ol class=commentlist><li><article>First {PROSE * 3}</article></ol>",
    f"<div id=content><h1>Storm</h1><p>{PROSE}</p></div><div id=comments><article>First {PROSE * 3}</article></div>",
    f"<div class=comments><div class=sidebar><article>First {PROSE * 3}</article></div></div><article><h1>Storm</h1><p>{PROSE}</p></article>",
])
def test_reader_comments_stay_out_whatever_their_length(body):
    assert html_text.main_text(_page(body)) == f"Storm {PROSE.strip()}"


def test_page_of_comments_only_is_empty():
    assert html_text.main_text(_page(f"<div id=comments><article>First {PROSE}</article></div>")) == ""


@pytest.mark.parametrize("part, text", [
    ("<section id='related-work'><h2>Related work</h2><p>x</section>", "Related work x"),
    ("<h2 id='discussion'>Discussion</h2><p>x", "Discussion x"),
    ("<section id='discussion'><h2>Discussion</h2><p>x</section>", "Discussion x"),
    ("<div id='data-sharing'><p>x</div>", "x"),
    ("<div class='section' id='sharing'><p>x</div>", "x"),
    ("<h3 id='comments'>Comments</h3><p id='advertising'>x", "Comments x"),
    ("<div id='comments'><p>x</div><section id='cookie-notice'>x</section>", ""),
])
def test_generated_ids(part, text):
    assert html_text.main_text(_page(f"<article><p>{PROSE}</p>{part}</article>")) == f"{PROSE}{text}".strip()


@pytest.mark.parametrize("body", [
    "<p>{intro}</p><div class=ad><p>Buy<p>this<p>now</div><p>{text}</p>",
    "<p>{intro}</p><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>Mail</a></ul><p>{text}</p>",
])
def test_short_parts_without_article(body):
    page = _page("<div>" + body.format(intro=PROSE[:90], text=PROSE * 8) + "</div>")
    assert html_text.main_text(page) == f"{PROSE[:90].strip()} {PROSE * 8}".strip()


def test_linked_lines_without_article():
    page = _page(f"<ul><li><a href=0>Menu</a></ul><h1><a href=1>Storm</a></h1><p>{PROSE}<h2><a href=2>Night</a></h2><p>{PROSE}"
                 f"<ul><li><a href=3>Entry</a><li>{PROSE}</ul><p><a href=4>All of the storm</a></p><ul><li><a href=5>Menu</a></ul>")
    assert html_text.main_text(page) == f"Storm {PROSE}Night {PROSE}Entry {PROSE}All of the storm"


_LINKS = "<ul>" + "".join(f"<li><a href={i}> Other   story {i} </a>" for i in range(3)) + "</ul>"


@pytest.mark.parametrize("body, text", [
    # runs of WINDOW or more linked lines without telling names: a table of contents, a menu between parts, other stories at the end
    (f"<article><h1>Storm</h1>{_LINKS}<p>{PROSE}</p></article>", f"Storm {PROSE}"),
    (f"<article><p>{PROSE}</p>{_LINKS}<h2>Night</h2><p>{PROSE}</p></article>", f"{PROSE}Night {PROSE}"),
    (f"<article><h1>Storm</h1><p>{PROSE}</p><h3>Read also</h3>{_LINKS}</article>", f"Storm {PROSE}"),
    (f"<main>{_LINKS}<h1>Storm</h1><p>{PROSE}</p>{_LINKS}{_LINKS}</main>", f"Storm {PROSE}"),
    (f"<article><h1>Storm</h1><p class=ad>Buy</p>{_LINKS}<p>{PROSE}</p></article>", f"Storm {PROSE}"),
    # shorter runs, and linked lines with words of their own, are the article's
    (f"<article><h1><a href=0>Storm</a></h1><p><a href=1>By K.</a></p><p>{PROSE}</p><ul><li><a href=2>Source</a><li><a href=3>Map</a></ul></article>",
     f"Storm By K. {PROSE}Source Map"),
    (f"<article><p>{PROSE}</p><ul><li><a href=1>One</a> source<li><a href=2>Two</a> more<li><a href=3>Three</a>.</ul></article>", f"{PROSE}One source Two more Three."),
    (f"<article><p>{PROSE}</p><ul><li><a href=1>One</a><li>own<li><a href=2>Two</a></ul><p><a href=3>Three</a></article>", f"{PROSE}One own Two Three"),
    (f"<article><h1>Storm</h1>{_LINKS}</article>", "Storm"),
    # a link that is never closed counts in its first line only
    (f"<article><h1>Storm</h1><p><a href=0>By K.<p>{PROSE}<p>Second<p>Third</article>", f"Storm By K. {PROSE}Second Third"),
    (f"<article><h1>Storm</h1><p><a href=0>By K.<p>{PROSE}<p>Second<p>Third", f"Storm By K. {PROSE}Second Third"),
    (f"<article><h1>Storm</h1><p><a href=0>By K.<p>One<p>Two<p>{PROSE}<p>Third <a href=1>Map</a></article>", f"Storm By K. One Two {PROSE}Third Map"),
    (f"<article>{_LINKS}</article>", "Other story 0 Other story 1 Other story 2"),
])
def test_distribution_decides_inside_an_article(body, text):
    assert html_text.main_text(_page(body)) == text.strip()


def test_distribution_finds_surges_and_dives():
    lengths = np.array([0, 5, 0, 0, 0, 0, 90, 80, 0, 70, 0, 0, 0, 3, 0, 0, 0, 200])
    assert html_text.between_surges_and_dives(lengths, 20) == [(6, 9), (17, 17)]
    assert html_text.between_surges_and_dives(lengths, 0) == [(1, 1), (6, 9), (13, 13), (17, 17)]
    assert html_text.between_surges_and_dives(np.zeros(4, int), 0) == []


def test_long_and_broken_pages():
    for unit in ("<", "<p>", "<div>", "</div>", "<a ", "&", "<a href=\"", "<!", "x ", "<b>y", "<p>text</p>"):
        html_text.main_text("<article>" + unit * 30_000)


def test_odd_rows(spark):
    rows = [(1, "u", None, "clash"), (1, "u", None, "clash"), (None, None, "<article>x</article>", "clash"), (2, "", "", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out, name = html_text.extracted(df)
    assert name != "text" and sorted(r[name] for r in out.collect()) == ["", "", "", "x"]
    assert html_text.extracted(df.limit(0))[0].count() == 0
