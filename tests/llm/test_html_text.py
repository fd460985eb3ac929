import html
import re

import pytest

from sparkevo.llm import html_text as H
from sparkevo.llm import queries as q
from sparkevo.llm.html_text import extract_pages, main_text

LONG = "This is a long paragraph of the main text, and it has many of the words that are in a language for readers. "


def plain(page):
    """Blocks of the article of the given tables' pages, whose markup is regular."""
    article = re.search("<article>(.*)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub("<[^>]+>", " ", p)).split()) for p in re.split("</?p>|</?h1>", article))
    return "\n\n".join(p for p in parts if p)


def test_pages(spark, sf):
    got = {r.page_id: r for r in q.op9_html_text(spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert got[p.page_id].text == plain(p.html)
        assert got[p.page_id].n_chars == len(plain(p.html)) and got[p.page_id].url == p.url


def test_without_article():
    page = f"""<html><head><title>x</title><script>var a = "<p>" > 1;</script></head><body><header>{LONG}</header>
    <div id="main-menu"><a href=1>One</a> <a href=2>Two</a></div><h2>Title &amp; more</h2><div>{LONG}<br>two &lt;b&gt;</div><p>Short.
    <p><i>{LONG}</i></p><aside>{LONG}</aside><div class="reader comments"><p>{LONG}</p></div>
    <p><a href=a>all of this block stands in a link and nothing else</a></p><form>{LONG}<input></form>
    <div style="display: none">{LONG}</div><footer>{LONG}</footer></body>"""
    body = LONG.strip()
    assert main_text(page).split("\n\n") == ["Title & more", f"{body} two <b>", "Short.", body]


def test_inside_article():
    page = f"""<body><div class=x>{LONG}</div><main><header><h1>Head</h1></header><p>no stop wordz zzz qqq kkk www rrr ttt ppp sss ddd fff ggg hhh jjj lll
    <div class="share-bar">share this</div><section id="comments"><p>{LONG}</section><p>{LONG}</p><ul><li>item one<li>item two</ul></main>{LONG}"""
    got = main_text(page).split("\n\n")
    assert got[0] == "Head" and got[1].startswith("no stop") and got[2:] == [LONG.strip(), "item one", "item two"]


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "with-comments", "page-with-ads", "sidebar"])
def test_layout_class_around_an_article(name):
    assert main_text(f'<body><div class="{name}"><article class="post has-comments"><p>{LONG}</p></article></div>') == LONG.strip()


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "with-comments", "page-with-ads"])
def test_layout_class_without_article(name):
    assert main_text(f'<body><div class="{name}"><p>{LONG}</p></div>') == LONG.strip()


@pytest.mark.parametrize("attribute", ['title="hidden gems"', 'aria-hidden="false"', 'data-id="share-3"', 'data-x="a hidden class=ads"'])
def test_attributes_by_name(attribute):
    assert main_text(f"<body><p {attribute}>{LONG}</p>") == LONG.strip()
    assert main_text(f'<body><p>{LONG}<a href="/hidden-falls" {attribute}>falls</a></p>') == f"{LONG}falls"


@pytest.mark.parametrize("attribute", ["hidden", 'hidden=""', "class='reader comments'", 'class="x share-bar"', 'id="main-menu"', "class=ad", 'role="navigation"'])
def test_left_out(attribute):
    assert main_text(f"<body><div {attribute}><p>{LONG}</p></div><p>{LONG}</p>") == LONG.strip()


def test_articles_of_comments():
    page = f'<main><p>{LONG}</p><section id="comments"><article><p>{LONG}</p></article></section></main>'
    assert main_text(page) == LONG.strip()


NO_STOPS = "zzz qqq kkk www rrr ttt ppp sss ddd fff ggg hhh jjj lll xxx ccc vvv bbb nnn mmm zzz qqq kkk"
#: No article, no hints: what stays is decided by the densities (long blocks) and by neighbours (short ones).
BARE = f"""<body><div class="x1"><a href=a>One of the links that are here</a> <a href=b>and another one</a></div><div class="x2">Special offer today</div>
<div class="x3"><h1>Title</h1><p>Short lead.</p><p>{LONG}</p><div>{NO_STOPS}</div><p>{LONG}</p><p>Tail.</p></div>
<div class="x4"><h3>More pages</h3><ul><li><a href=1>first</a></li><li><a href=2>second</a></li></ul></div><div class="x5">{NO_STOPS}</div></body>"""
BARE_TEXT = ["Title", "Short lead.", LONG.strip(), LONG.strip(), "Tail."]


def test_densities_and_neighbours_decide():
    assert main_text(BARE).split("\n\n") == BARE_TEXT


def test_each_pass_is_needed(monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(H, "first_pass", lambda block, in_section, known=True: 0)
        assert main_text(BARE).split("\n\n") != BARE_TEXT
    with monkeypatch.context() as m:
        m.setattr(H, "second_pass", lambda found, labels, in_section: labels)
        assert main_text(BARE).split("\n\n") == [LONG.strip()] * 2


@pytest.mark.parametrize("tag", ['a title="5" tall" href=x', 'a href=x title=\'it"s\' "', "a href=x data-a=a>b"])
def test_stray_quotes(tag):
    page = f'<body><p class="a"">{LONG}<{tag}>k</a> end of it.</p><p class=b x"hidden>{LONG}</p>'
    got = main_text(page)
    assert got == f"{LONG}{'b>' if tag.endswith('b') else ''}k end of it.\n\n{LONG.strip()}" and "<" not in got


def test_teaser_beside_the_text():
    page = f'<body><div><p>{LONG}</p><p>{LONG}</p></div><article class="teaser"><a href=x>Read the next of them</a></article></body>'
    assert main_text(page) == f"{LONG.strip()}\n\n{LONG.strip()}"


def test_several_articles():
    page = f"<body><p>{LONG}</p><article><h2>A</h2><p>{LONG}</p></article><div>{LONG}</div><article><h2>B</h2><p>{LONG}x</p></article></body>"
    assert main_text(page).split("\n\n") == ["A", LONG.strip(), "B", f"{LONG}x"]


def test_block_links():
    page = f'<body><p>{LONG}</p><a href="x"><div>{LONG}</div></a><p><a href=y>{LONG}</p><p>{LONG}y</p><a name=z><div>{LONG}z</div></a></body>'
    assert main_text(page).split("\n\n") == [LONG.strip(), f"{LONG}y", f"{LONG}z"]


def test_headings_go_with_the_text_under_them():
    page = f"""<article><h1>T</h1><div class="share-bar">share</div><h2>S</h2><p>{LONG}</p><h2>Read on</h2><ul><li><a href=1>first</a><li><a href=2>second</a></ul>
    <h2>Comments</h2><div class="comments"><p>{LONG}</p></div></article>"""
    assert main_text(page).split("\n\n") == ["T", "S", LONG.strip()]


def test_pages_without_evidence_are_kept():
    assert main_text("<p>Hello world.</p>") == "Hello world." and main_text("Hello") == "Hello"
    assert main_text("<svg/><p>Hello</p><!--><p>you</p>") == "Hello\n\nyou"


def test_odd(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p", "x"), (3, "u", "<<>></p></div>" + "<div>" * 3000 + LONG, "x"), (3, "u", "<p>" + LONG * 3000 + "</p>", "x"), (4, "u", '<a href="unclosed>' + LONG, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract_pages(pages).collect()
    assert len(got) == 6 and [r.text for r in got][:2] == ["", ""]
    assert got[3].text == "<<>>\n\n" + LONG.strip() and got[4].n_chars == len(LONG) * 3000 - 1
    assert extract_pages(pages.filter("false")).count() == 0


@pytest.mark.parametrize("unit", ["<svg ", "<a ", '<b x="', "</svg ", '<b x=">" ', "<div>", "</p>", "<!--x", "<script>", "<b x='\"", "<", "</", "<!", "<span class=ad>", "&amp", '<p class="' + "promo_" * 20 + '!">'])
def test_hostile_pages_take_linear_time(unit):
    import time

    began = time.process_time()
    for tail in ("", ">", '">', "</svg><p>x</p>"):
        main_text("<p>start " + unit * (1_000_000 // len(unit)) + tail)
    assert time.process_time() - began < 40


def test_elements_deep_and_many():
    import time

    began = time.process_time()
    for page in ("<div>" * 100_000 + "</p>" * 100_000, "<b hidden>x<div>" + "<span hidden>" * 50_000 + "</b>" * 50_000, "<div class=ad>" * 50_000 + "<article>" * 50_000 + LONG):
        main_text(page)
    assert time.process_time() - began < 30


def test_hints_inside_an_article_are_priors():
    page = f'<article><p>{LONG}</p><section class="related work"><h2>Related work</h2><p>{LONG}a</p></section><section id="skip"><p>{LONG}b</p></section><div class="related"><ul><li><a href=1>first</a></li></ul><div>Short</div></div></article>'
    assert main_text(page).split("\n\n") == [LONG.strip(), "Related work", f"{LONG}a", f"{LONG}b"]
    assert main_text(f'<div><p>{LONG}</p></div><div class="related"><p>{LONG}</p></div>') == LONG.strip()


JAPANESE = "これは本文の長い段落であり、読者のために多くの言葉を含んでいます。そして、この文章はもう少し続いて、十分な長さになります。さらに文を足して、七十字をこえるようにしてあります。"


@pytest.mark.parametrize("wrap", ["{}", "<article>{}</article>", "<div>{}</div>"])
def test_scripts_without_stop_words(wrap):
    body = wrap.format(f"<h1>題名</h1><p>{JAPANESE}</p><p>短い。</p><p>{JAPANESE}</p>")
    page = f'<body><div><a href=1>一</a> <a href=2>二</a></div>{body}<div class=foot>© 2024 会社</div><div class="x">Copyright 2024 X</div></body>'
    assert main_text(page).split("\n\n") == ["題名", JAPANESE, "短い。", JAPANESE]
