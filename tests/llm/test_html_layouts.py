"""Page extraction on pages written by hand: what stands in [[ and ]] is the article's text, block by block."""

import re

import pytest

from tapewright.llm import crf, html_text, queries

ONE = "The river rose by two metres during the night and flooded the lower streets."
TWO = "Nobody was hurt, but the old bridge will stay closed until the end of the month."
THREE = "Engineers began to look at the damage in the morning, and the town council will meet on Friday."
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact</a></li></ul></nav>"
MENU = '<div class="menu"><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sports</a></div>'
FOOT = "<footer>&copy; 2024 All rights reserved. <a href=/p>Privacy policy</a></footer>"
FOOT_DIV = '<div id="footer"><p>&copy; 2024 All rights reserved.</p><p><a href=/t>Terms of use</a></p></div>'
COOKIE = '<div class="cookie-notice"><p>We use cookies to improve this site.</p><button>Accept all</button></div>'
AD = '<div class="ad">Save 50% today on all garden chairs.</div>'
SIDE = "<aside><h3>Most read</h3><ul><li><a href=/1>Ten ways to cook rice</a></li><li><a href=/2>Where to swim</a></li></ul></aside>"
FORM = '<form><label>Your email</label><input name=q><button>Subscribe to our newsletter</button></form>'
COMMENTS = '<div class="comments"><h3>3 comments</h3><p>I disagree.</p><p>Great article! I saw the same thing happen last year in our street.</p></div>'
SHARE = '<div class="share"><a href=/f>Share</a> <a href=/t>Tweet</a></div>'
BODY = f"<h1>[[Flood in the town]]</h1><p>[[{ONE}]]</p><p>[[{TWO}]]</p><p>[[{THREE}]]</p>"
PLAIN = f"<p>[[{ONE}]]</p><p>[[{TWO}]]</p>"

WRAPPERS = {
    "article": ("<article>", "</article>"), "main": ("<main>", "</main>"), "section": ("<section>", "</section>"),
    "odd section": ('<section class="x1">', "</section>"), "div": ("<div>", "</div>"), "odd div": ('<div class="q7z">', "</div>"),
    "named div": ('<div class="article">', "</div>"), "content": ('<div id="content">', "</div>"), "nested": ("<div><div><div>", "</div></div></div>"),
    "cell": ("<table><tr><td>", "</td></tr></table>"), "none": ("", ""), "unclosed": ("<div><div>", ""),
}
AROUND = {
    "nothing": ("", ""), "nav and footer": (NAV, FOOT), "menu and box": (MENU + COOKIE, FOOT_DIV), "advert and sidebar": (NAV + AD, SIDE + FOOT),
    "form and comments": (MENU, FORM + COMMENTS + FOOT),
}
PAGES = {f"{w}, {a}": f"{before}{start}{BODY}{end}{after}" for w, (start, end) in WRAPPERS.items() for a, (before, after) in AROUND.items()}
PAGES |= {
    "one paragraph": f"<p>[[{ONE}]]</p>",
    "bare text": f"[[{ONE}]]",
    "hidden": f"<article><p>[[{ONE}]]</p><div hidden>Some words that do not show.</div><p style=\"display:none\">Other words of no use.</p><p>[[{TWO}]]</p></article>",
    "aria-hidden": f"<article>{PLAIN}<div aria-hidden=\"true\"><p>Words for nobody, and some more of them.</p></div></article>",
    "unclosed video": f"<article><p>[[{ONE}]]</p><video src=a><p>[[{TWO}]]</p></article>{FOOT}",
    "video in a box": f"<article><div><video src=a>No video here.</video></div>{PLAIN}</article>",
    "unclosed svg": f"<article><p>[[{ONE}]]</p><svg width=1><p>[[{TWO}]]</p></article>",
    "unclosed template": f"<article>{PLAIN}<template><p>[[{THREE}]]</p></article>",
    "nested template": f"<article>{PLAIN}<template>a<template>b</template>c</template><p>[[{THREE}]]</p></article>",
    "noscript": f"<article>{PLAIN}<noscript><p>Please enable scripts.</p></noscript></article>",
    "audio, canvas": f"<article><p>[[{ONE}]]</p><audio>No sound.</audio><canvas>No picture.</canvas><p>[[{TWO}]]</p></article>",
    "layout table": f"<table><tr><td><a href=/>Menu</a></td><td>{PLAIN}</td></tr></table>",
    "share inside": f"<article>{PLAIN}{SHARE}<p>[[{THREE}]]</p></article>{FOOT}",
    "advert inside": f"<div><p>[[{ONE}]]</p>{AD}<p>[[{TWO}]]</p></div>",
    "comments inside": f"<article>{PLAIN}{COMMENTS}</article>",
    "sidebar inside": f"<article><p>[[{ONE}]]</p>{SIDE}<p>[[{TWO}]]</p></article>",
    "list": f"<article><p>[[{ONE}]]</p><ul><li>[[{TWO}]]</li><li>[[{THREE}]]</li></ul></article>{FOOT}",
    "quote": f"<article><p>[[{ONE}]]</p><blockquote>[[{TWO}]]</blockquote></article>{FOOT}",
    "cue words": f"<article><p>[[{ONE}]]</p><p>[[The council asked people to share boats, sign a list and reply by Friday, as rights of way are not reserved in a flood, and a comment by the mayor is due.]]</p><p>[[{TWO}]]</p></article>{FOOT}",
}


def cut(page: str) -> tuple[str, str]:
    """The page without its marks, and the text that they enclose."""
    return re.sub(r"\[\[|\]\]", "", page), "\n\n".join(re.findall(r"\[\[(.*?)\]\]", page, re.S))


@pytest.fixture(scope="module")
def field():
    return crf.train(*html_text.labelled_pages([]))


@pytest.fixture(scope="module")
def known(field):
    return {n for n in field.index if n[:2] in ("t:", "c:")}


@pytest.mark.parametrize("name", PAGES)
def test_layout(name, field, known):
    page, truth = cut(PAGES[name])
    assert html_text.main_text(page, field, known) == truth


RENAMED = {"section": ('<section class="x1">', "</section>"), "div": ("<div>", "</div>"), "class": ('<div class="article">', "</div>"), "none": ("", ""),
           "cell": ("<table><tr><td>", "</td></tr></table>")}


def test_no_block_is_lost_without_the_article_tag(spark):
    """Pages of the table give the same text whatever element their article stands in."""
    pages = queries.pages(spark, "/root/testdata/sf0.01")
    own = html_text.trained(pages)
    names = {n for n in own.index if n[:2] in ("t:", "c:")}
    for row in pages.collect():
        truth = html_text.main_text(row.html, own, names)
        for start, end in RENAMED.values():
            assert html_text.main_text(row.html.replace("<article>", start).replace("</article>", end), own, names) == truth
