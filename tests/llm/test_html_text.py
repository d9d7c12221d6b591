import html
import re

import pytest

from photocat.llm import html_text
from photocat.llm.html_text import blocks_of, extract, main_text

TEXT = "The quick answer to all of this is that the people of the town were not in the house when it fell."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain text of the page", "plain text of the page"),
        (f"<nav><a>Home</a></nav><p>{TEXT}</p><footer>(c) all of the rights</footer>", TEXT),
        (f"<article><h1>A &amp; B</h1><p>x\n\t y &eacute;&#x20;z</p></article><p>{TEXT}</p>", "A & B\nx y é z"),
        (f"<p>{TEXT}<br>more of it</p><p>short one</p>", f"{TEXT} more of it\nshort one"),
        (f"<p>{TEXT}<br><br>the next of it and the last</p>", f"{TEXT}\nthe next of it and the last"),
        (f"<p>{TEXT}<script>var p = '</p>';</script> on</p><style>p {{}}</style>", f"{TEXT} on"),
        (f"<article><p>{TEXT}</p><section id='comments'><p>{TEXT}</p></section></article>", TEXT),
        (f"<div class='cookie-notice'>{TEXT}</div><main><p>{TEXT}</p></main>", TEXT),
        (f"<header><p>{TEXT}</p></header><p>{TEXT}</p><aside>{TEXT}</aside><form>{TEXT}</form>", TEXT),
        (f"<div class='ad'><article><p>{TEXT}</p></article>", TEXT),
        (f"<p>{TEXT}</p><ul><li><a href=x>of the one</a><li><a href=y>of the two</a></ul>", TEXT),
        (f"<p>{TEXT}<p>{TEXT}", f"{TEXT}\n{TEXT}"),
        ("<div hidden>secret of the page</div><p>shown to the people</p>", "shown to the people"),
        (f"<p>{TEXT} 1 < 2 & 3 > 2</p>", f"{TEXT} 1 < 2 & 3 > 2"),
        ("<!-- <p>no</p> --><p title='a>b'>the rest of it</p><b", "the rest of it"),
        ("<script>never closed <p>of the text</p>", ""),
        (f"<ARTICLE><P>{TEXT}</P></ARTICLE>", TEXT),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_link_density_and_neighbours():
    links = "<p>" + "".join(f"<a href=/{i}>of the {i}</a> " for i in range(30)) + "</p>"
    page = f"<p>{TEXT}</p><p>Ab</p><p>Cd</p>{links}<p>{TEXT}</p>"
    assert main_text(page) == f"{TEXT}\nAb\n{TEXT}"


def test_long_page_is_linear():
    page = "<div>" + "<p>the one of them and <b>more</b>" * 50_000
    assert len(blocks_of(page)) == 50_000
    assert main_text("<" * 20_000) == ""


def test_rows(spark):
    rows = [(1, "u", "<p>of the one</p>", "x"), (1, "u", "<p>of the one</p>", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, _kept string")
    out = extract(df)
    assert out.columns == [*df.columns, "main_text"]
    assert sorted(r.main_text for r in out.collect()) == ["", "of the one", "of the one"]
    assert extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    """Against a plain reading of the given pages, whose articles hold h1, p, b and br only."""
    from llm_support import SF

    for r in extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        inner = re.sub("</?b>", "", re.sub("<br>", " ", re.sub("</?(?:p|h1)>", "\n", inner)))
        lines = (" ".join(html.unescape(x).split()) for x in inner.split("\n"))
        assert r.main_text == "\n".join(x for x in lines if x)


CARD = "<article><h3>Of the other</h3><p>The teaser of another page that is not the text of this one at all.</p></article>"


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<html><head><title>t</title><meta a=b><body><p>{TEXT}</p>", TEXT),
        (f"<head><title>t</title><link rel=x><p>{TEXT}</p>", TEXT),
        (f"<head><style>p {{}}</style>{TEXT}", TEXT),
        (f"<div><p>{TEXT}</p></div><aside>{CARD}{CARD}</aside>", TEXT),
        (f"<div><p>{TEXT}</p></div><div class='related'><div>{CARD}</div>{CARD}</div>", TEXT),
        (f"<article><p>{TEXT}</p></article><aside>{CARD}</aside>", TEXT),
        # What is not closed is no region, and cards are all that a page may have.
        (f"<div><div class='ad'><article><p>{TEXT}</p></article></div><p>{TEXT} Outside.</p>", TEXT),
        (f"<aside><article><p>{TEXT}</p></article></aside>", TEXT),
        (f"<aside>{CARD}<main><p>{TEXT}</p></main></aside>", TEXT),
    ],
)
def test_open_heads_and_cards(page, text):
    assert main_text(page) == text


RUSSIAN = "Жители города собрались на площади и долго ждали вестей от тех кто ушёл за реку " * 6
JAPANESE = "町の人々は広場に集まり川の向こうへ行った者たちの知らせを長いあいだ待っていた" * 8
POLISH = "Mieszkańcy miasta czekali długo na wieści zza rzeki. Nikt jednak nie wrócił przed zmierzchem. " * 4
CLOUD = "Lamps Chairs Tables Shelves Sofas Beds Carpets Mirrors Curtains Pillows Blankets Candles " * 4


@pytest.mark.parametrize("text", [RUSSIAN, JAPANESE, POLISH, RUSSIAN[:60], JAPANESE[:30], JAPANESE[:100]])
def test_languages_without_stop_words(text):
    text = text.strip()
    assert main_text(f"<div><p>{text}</p></div>") == text
    assert main_text(f"<nav>x</nav><article><h1>A</h1><p>{text}</p></article><p>{TEXT}</p>") == f"A\n{text}"


@pytest.mark.parametrize(
    "name", ["ad-container", "cookie-text", "sidebar-content", "adsbygoogle", "main-nav", "story-ads", "postComments"]
)
def test_marked_regions_have_no_exemption(name):
    assert main_text(f"<div class='x {name}'><p>{TEXT}</p></div><p>{TEXT} Main.</p>") == f"{TEXT} Main."
    page = f"<article><p>{TEXT}</p><div class='{name}'>{TEXT}</div></article>"
    assert main_text(page) == TEXT


@pytest.mark.parametrize("name", ["has-sidebar", "page-with-sidebar", "no-ads", "comments-enabled", "shadow", "adapter"])
def test_names_about_other_regions(name):
    assert main_text(f"<div class='{name}'><p>{TEXT}</p></div>") == TEXT


def test_teasers_beside_the_story():
    story = "".join(f"<p>{TEXT} {i} of it, as the rest of them was in the end.</p>" for i in range(12))
    text = main_text(f"<div>{story}</div><article><h3>Other</h3><p>{TEXT}</p></article>")
    assert text.count("\n") == 11 and "Other" not in text
    assert main_text(f"<article>{story}</article><p>{TEXT}</p>").count("\n") == 11


def test_every_density_decides(monkeypatch):
    links = "<p>" + "".join(f"<a href=/{i}>of the {i}</a> " for i in range(30)) + "</p>"
    page = f"<p>{TEXT}</p><p>Ab</p><p>{TEXT}</p><p>{CLOUD}</p>{links}<p>Cd</p>"
    assert main_text(page) == f"{TEXT}\nAb\n{TEXT}"
    monkeypatch.setattr(html_text, "MAX_LINK_DENSITY", 1.0)
    assert "of the 7" in main_text(page)
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "_stop_density", lambda text: 1.0)
    assert "Lamps" in main_text(page)
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "_inherited", lambda *_: False)
    assert main_text(page) == f"{TEXT}\n{TEXT}"


def test_ambiguous_blocks_in_articles():
    """Next to link lists of an article, a list of names goes with them; next to its text it stays."""
    links = "<p>" + "".join(f"<a href=/{i}>of the {i}</a> " for i in range(30)) + "</p>"
    page = f"<article><p>{TEXT}</p><p>{CLOUD}</p><p>{TEXT}</p>{links}<p>{CLOUD}</p>{links}</article>"
    assert main_text(page) == f"{TEXT}\n{CLOUD.strip()}\n{TEXT}"
