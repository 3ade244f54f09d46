"""HTML extraction (operator 7): a linear-chain conditional random field over the leaf blocks of a page.

A page becomes the sequence of its leaf blocks (``dom``). Features of a block are the tags and class words of all
elements above it, its tag, length, links, signs and place, and how much of the page's text stands in the same element;
the field labels each block as article or furniture and Viterbi gives the best sequence. Article blocks in page order
are the text. What does not show (``hidden``, ``display:none``, ``aria-hidden``) is furniture.

The field is trained on labelled pages: a bounded sample of the pages whose markup itself marks the article, once as
they are and once with that mark taken away, and pages of known layout, filled with sentences of the sample, in which
menus, adverts, notices, forms, sidebars, comments and footers stand around and inside articles of many kinds of
markup, or of none.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices, strings
from .crf import Crf, train
from .dom import Block, blocks_of

#: Pages of the sample that the field is trained on, at most; the layouts are a fixed number of further pages.
SAMPLE_PAGES = 120
LAYOUT_PAGES = 500
#: Sentences of the sample that fill the layouts: how many, and of how many characters.
FILLING, FILLING_LENGTH = 2000, range(3, 300)
SEED = 7

#: Class words and elements of furniture and of articles in layouts.
FURNITURE = {
    "nav": ["menu", "nav", "navigation", "navbar", "breadcrumb", "topbar", "toc", "pagination", "pager", "skip", "tab"],
    "aside": ["sidebar", "aside", "related", "widget", "recommend", "popular", "trending", "more", "teaser", "rail"],
    "header": ["header", "masthead", "banner", "branding", "logo", "topbar"],
    "footer": ["footer", "copyright", "legal", "colophon", "bottom", "credit", "imprint"],
    "form": ["form", "search", "login", "newsletter", "subscribe", "signup", "contact"],
    "notice": ["cookie", "consent", "notice", "gdpr", "popup", "modal", "alert", "overlay", "disclaimer", "paywall", "banner"],
    "ad": ["ad", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adbox", "adsense", "banner"],
    "comment": ["comment", "discussion", "disqus", "reply", "respond", "thread", "reader", "feedback"],
    "share": ["share", "social", "follow", "tool", "button", "tag", "meta", "author", "byline"],
}
ARTICLE_NAMES = ["article", "content", "post", "entry", "story", "main", "body", "text", "page", "article-body", "post-content", "entry-content"]
PHRASES = {
    "nav": ["Home", "About", "Contact", "News", "Sports", "Next", "Previous", "Menu", "Skip to content", "Archive"],
    "aside": ["Related articles", "Most read", "You may also like", "Popular", "Recommended", "Read more"],
    "header": ["Daily News", "The Journal", "My Site", "Log in", "Search"],
    "footer": ["© 2024 All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Powered by"],
    "form": ["Subscribe to our newsletter", "Your email", "Send", "Search", "Password", "Sign up"],
    "notice": ["We use cookies to improve this site.", "Accept all", "This site uses cookies.", "Please enable scripts.", "Sign in to read more."],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Save 50% today", "Limited offer"],
    "comment": ["Great article!", "Reply", "3 comments", "Leave a comment", "I disagree.", "Thanks for this."],
    "share": ["Share", "Tweet", "Print", "Follow us", "By"],
}
SIGNS = {"©": "copy", "@": "at", "|": "bar", "»": "arrow", "›": "arrow", "$": "money", "%": "cent"}
CUES = set("cookie cookies subscribe newsletter comments comment reply login sign copyright rights reserved privacy advertisement sponsored share menu related".split())


def some_or_many(share: float) -> str:
    return "many" if share > 0.05 else "some"


def features(block: Block, at: int, count: int, title: str, seen_heading: bool, around: tuple[float, float]) -> list[str]:
    """``around``: shares of the page's unlinked text in the element around the block and the one around that."""
    text = block.text
    words = text.split(" ")
    n = len(text)
    out = [*block.above, f"b:{block.tag}", "bias"]
    out.append("n:" + ("1" if n < 12 else "2" if n < 40 else "3" if n < 100 else "4" if n < 250 else "5"))
    share = block.linked / n
    out.append("l:" + ("0" if not block.linked else "1" if share < 0.3 else "2" if share < 0.8 else "3"))
    out.append("end:" + ("." if text[-1] in ".!?…\"”»" else ":" if text[-1] in ":;," else "-"))
    out += [f"s:{v}:{some_or_many(text.count(k) / n)}" for k, v in SIGNS.items() if k in text]
    cues = [w for w in (w.strip(".,:!?()").lower() for w in words) if w in CUES]
    out += [f"w:{w}:{some_or_many(cues.count(w) / len(words))}" for w in set(cues)]
    out += [f"{name}:{'0' if s < 0.02 else '1' if s < 0.1 else '2' if s < 0.3 else '3' if s < 0.6 else '4'}" for name, s in zip(("in", "in2"), around, strict=True)]
    out.append("after heading" if seen_heading else "before heading")
    if at == 0:
        out.append("first")
    if at == count - 1:
        out.append("last")
    if title and (text == title or (n > 20 and text.startswith(title))):
        out.append("title")
    return out


def sequence_of(blocks: list[Block], title: str) -> list[list[str]]:
    out, heading = [], False
    own, above = Counter(), Counter()
    for block in blocks:
        plain = 0 if "t:(hidden)" in block.above else len(block.text) - block.linked
        own[block.parents[0]] += plain
        above[block.parents[1]] += plain
    total = max(1, sum(own.values()))
    for at, block in enumerate(blocks):
        heading = heading or block.tag == "h1"
        out.append(features(block, at, len(blocks), title, heading, (own[block.parents[0]] / total, above[block.parents[1]] / total)))
    return out


# --- labelled pages ---------------------------------------------------------------------

OUTSIDE = {"t:nav", "t:aside", "t:footer", "t:form", "t:header", "t:button", "t:select", "t:menu", "t:(hidden)", "c:ad", "c:comment", "c:sidebar", "c:notice", "c:cookie"}


def without_mark(html: str, to: str) -> str:
    """The page with its article or main element renamed; a name of none is left out."""
    return re.sub(r"<(/?)(?:article|main)\b[^>]*>", lambda m: f"<{m[1]}{to}>" if to else "", html, flags=re.I)


def marked(html: str) -> tuple[list[list[str]], list[int], list[str]] | None:
    """Sequence and labels of a page with one article or main element, and its article texts; else None."""
    low = html.lower()
    tag = next((t for t in ("article", "main") if low.count(f"<{t}") == 1), None)
    if tag is None:
        return None
    blocks, title = blocks_of(html)
    labels = [int(f"t:{tag}" in b.above and not b.above & OUTSIDE) for b in blocks]
    return sequence_of(blocks, title), labels, [b.text for b, y in zip(blocks, labels, strict=True) if y]


class Layouts:
    """Pages of known layout, filled with given sentences."""

    def __init__(self, sentences: list[str], seed: int = SEED):
        self.rng = random.Random(seed)
        self.sentences = sentences or ["Some words of a text that goes on for a while, and then it ends.", "A short one.", "More of it follows here."]

    def say(self, least: int, most: int) -> str:
        return " ".join(self.rng.choice(self.sentences) for _ in range(self.rng.randint(least, most)))

    def escaped(self, text: str) -> str:
        return text.replace("&", "&amp;").replace("<", "&lt;")

    def furniture(self, kind: str, inside: bool = False) -> tuple[str, list[int]]:
        rng = self.rng
        tag = kind if kind in ("nav", "aside", "header", "footer", "form") and rng.random() < 0.6 else rng.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        name = rng.choice(FURNITURE[kind])
        named = tag not in ("nav", "aside", "footer", "form") or (tag == "header" and inside) or rng.random() < 0.5
        open_ = f"<{tag} {rng.choice(['class', 'class', 'id'])}=\"{name}{rng.choice(['', '', '-box', 's', ' wide'])}\">" if named else f"<{tag}>"
        parts, labels = [], []
        for _ in range(rng.randint(1, 6)):
            long = kind in ("comment", "aside", "ad", "notice", "footer") and rng.random() < 0.5
            text = self.escaped(self.say(1, 3) if long else rng.choice([*PHRASES[kind], self.say(1, 1)[:30]]))
            if kind == "form" and rng.random() < 0.5:
                text = rng.choice([f"<label>{text}</label><input name=q>", f"<button>{text}</button>", f"<select><option>{text}</select>"])
            if kind in ("nav", "aside", "share", "footer", "header") and rng.random() < 0.7:
                text = f'<a href="/x">{text}</a>'
            part = f"<li>{text}</li>" if kind == "nav" and rng.random() < 0.7 else f"<{(t := rng.choice(['p', 'div', 'h3' if kind != 'nav' else 'span', 'p']))}>{text}</{t}>"
            parts.append(part)
        html = f"{open_}{''.join(parts)}</{tag}>"
        labels = [0] * len(blocks_of(html)[0])
        return html, labels

    def unshown(self) -> tuple[str, list[int]]:
        """Text that does not show, marked by nothing else."""
        tag = self.rng.choice(["p", "p", "div"])
        mark = self.rng.choice(["hidden", 'style="display:none"', "style='color:red; display: none'", 'aria-hidden="true"'])
        return f"<{tag} {mark}>{self.escaped(self.say(1, 3))}</{tag}>", [0]

    def article(self) -> tuple[str, list[int]]:
        """An article in an element of its own, named, unnamed or named at random, or in the page's body, a cell or a box."""
        rng = self.rng
        tag = rng.choice(["article", "article", "main", "div", "div", "section", "td", ""])
        named = rng.random()
        open_ = f"<{tag}>" if named < (0.6 if tag in ("article", "main") else 0.4) else f'<{tag} class="x{rng.randint(1, 99)}">' if named < 0.6 else f'<{tag} class="{rng.choice(ARTICLE_NAMES)}">'
        close = f"</{tag}>"
        if not tag:
            open_ = close = ""
        elif tag == "td":
            open_, close = f"<table><tr>{open_}", f"{close}</tr></table>"
        elif rng.random() < 0.2:
            open_, close = f"<div>{open_}", f"{close}</div>"
        parts, labels = [open_], []
        title = self.escaped(self.say(1, 1)[:70])
        if rng.random() < 0.8:
            head = f"<h1>{title}</h1>"
            parts.append(f"<header>{head}</header>" if rng.random() < 0.15 else head)
            labels.append(1)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 30])):
            roll = rng.random()
            if roll < 0.04:
                html, own = self.unshown()
                parts.append(html)
                labels += own
            elif roll < 0.13:
                part = rng.choice([lambda: f"<h2>{self.say(1, 1)[:50]}</h2>", lambda: f"<ul><li>{self.say(1, 2)}</li></ul>", lambda: f"<blockquote>{self.say(1, 2)}</blockquote>",
                                   lambda: f"<pre>{self.say(1, 2)}</pre>", lambda: f"<table><tr><td>{self.say(1, 1)}</td></tr></table>", lambda: f"<figure><figcaption>{self.say(1, 1)}</figcaption></figure>"])()
                parts.append(part)
                labels.append(1)
            elif roll < 0.26:
                html, own = self.furniture(rng.choice(["ad", "share", "aside", "form", "notice"]), True)
                parts.append(html)
                labels += own
            else:
                text = self.escaped(self.say(1, 4)) if roll < 0.87 else self.escaped(self.say(1, 1)).split(" ")[0] + "."
                parts.append(rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br></p>", f'<p><a href="/y">{text[:9]}</a> {text[9:]}.</p>', f"<div>{text}</div>"]))
                labels.append(1)
        if rng.random() < 0.25:
            html, own = self.furniture("comment", True)
            parts.append(html)
            labels += own
        return "".join(parts) + close, labels

    def page(self) -> tuple[str, list[int]]:
        rng = self.rng
        much = rng.choice([0.0, 0.3, 0.5, 0.6])  # no furniture at all in a quarter of the pages
        before = [k for k in ("notice", "header", "nav", "nav", "ad", "share") if rng.random() < much]
        after = [k for k in ("share", "aside", "comment", "form", "ad", "footer", "notice") if rng.random() < much]
        rng.shuffle(before)
        parts = [self.furniture(k) for k in before] + [self.article()] + [self.furniture(k) for k in after]
        html = f"<!DOCTYPE html><html><head><title>{self.say(1, 1)[:50]}</title></head><body>" + "".join(h for h, _ in parts)
        return html + rng.choice(["</body></html>", ""]), [y for _, labels in parts for y in labels]


def labelled_pages(sample: list[str], layouts: int = LAYOUT_PAGES, seed: int = SEED) -> tuple[list, list]:
    """Sequences and labels for training."""
    sequences, labels, texts = [], [], []
    for at, html in enumerate(sample):
        found = marked(html)
        if found:
            sequences.append(found[0])
            labels.append(found[1])
            texts += found[2]
            blocks, title = blocks_of(without_mark(html, ("div", "section", "")[at % 3]))
            if len(blocks) == len(found[1]):  # without the element, neighbouring texts may be one block
                sequences.append(sequence_of(blocks, title))
                labels.append(found[1])
    pieces = sorted({s.strip() + "." for t in texts for s in t.split(".") if len(s) in FILLING_LENGTH})
    made = Layouts(random.Random(seed).sample(pieces, min(len(pieces), FILLING)), seed)
    for _ in range(layouts):
        html, own = made.page()
        blocks, title = blocks_of(html)
        if len(blocks) == len(own):  # a text may have been empty
            sequences.append(sequence_of(blocks, title))
            labels.append(own)
    return sequences, labels


def trained(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE_PAGES) -> Crf:
    """The field, trained on layouts and on at most ``sample`` rows of ``pages``: those with the least hashes of their keys."""
    keys = [r[0] for r in pages.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(sample).collect()]
    rows = pages.where(F.col(key).isin(keys)).select(key, html).orderBy(F.xxhash64(key), key, html).limit(sample).collect() if keys else []
    return train(*labelled_pages([r[1] or "" for r in rows]))


def main_text(html: str, field: Crf, known: set[str]) -> str:
    blocks, title = blocks_of(html, known)
    labels = field.decode(sequence_of(blocks, title))
    return "\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame, field: Crf, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """Per row: the columns ``keep``, ``text``, the article of the whole page, and ``n_chars``, its code points.

    Null and empty pages, and pages without an article, give an empty text. Repeated rows and null keys give a row each.
    Columns besides ``keep`` are not read. A table without rows gives none.
    """
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    known = {n for n in field.index if n[:2] in ("t:", "c:")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_html"):
                out = [main_text(t, field, known) for t in strings(texts)]
                columns = [part.column(i) for i in range(len(keep))]
                yield pa.record_batch([*columns, pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], schema.names)

    return pages.select(*keep, F.col(html).cast("string").alias("_html")).mapInArrow(run, schema)
