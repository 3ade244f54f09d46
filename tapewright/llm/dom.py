"""Leaf blocks of HTML pages: the text between block-level tags, with the tags and names it stands under."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Element names of the HTML standard by their role here.
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th
thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
TO_THE_END = set("script style title textarea".split())  # without a closing tag they take the rest of the page
#: Elements whose content does not show where their own feature works; they may be nested, and end with the element they stand in.
UNSHOWN = set("noscript template svg audio video canvas".split())
#: An opening tag ends an open element of the first kind, unless one of the second kind is opened inside it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|\Z)(?!\s*=\s*["']?until-found)|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*?display\s*:\s*none|'[^']*?display\s*:\s*none|display:none))""", re.I)


def name_parts(attributes: str) -> set[str]:
    """Words of class, id and role: ``ad-banner`` and ``adBanner`` give ad and banner; a plural s goes."""
    out = set()
    for m in NAMES.finditer(attributes):
        for part in PARTS.findall(unescape(m[1] or m[2] or m[3] or "")):
            word = part.lower()
            out.add(word[:-1] if len(word) > 3 and word.endswith("s") else word)
    return out


@dataclass(slots=True)
class Block:
    text: str
    tag: str  # nearest block element
    above: frozenset  # "t:" tags and "c:" names of all elements it stands in; "t:(hidden)" below one that does not show
    linked: int  # characters inside links
    parents: tuple[int, int] = (0, 0)  # numbers of the element around the block and of the one around that


class _Frame:
    __slots__ = ("above", "block", "number", "tag", "up")

    def __init__(self, tag, above, block, number, up):
        self.tag, self.above, self.block, self.number, self.up = tag, above, block, number, up


def blocks_of(html: str, known: set[str] | None = None) -> tuple[list[Block], str]:
    """Leaf blocks of a page in order, empty ones left out, and its title. ``known``: names that are told apart."""
    stack = [_Frame("", frozenset(), "", 0, None)]
    open_: dict[str, int] = {}
    out: list[Block] = []
    pieces: list[str] = []
    linked = [0]
    title = ""
    number, unshown = 0, 0
    closes: dict[str, int] = {}  # where the next closing tag of an element is, the page's length if there is none

    def closed_at(tag: str, at: int) -> int:
        if closes.get(tag, -1) < at:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            closes[tag] = end.start() if end else len(html)
        return closes[tag]

    def flush():
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                own = stack[-1]  # of inline elements: the block element around them
                while own.up and own.tag not in BLOCK:
                    own = own.up
                up = own.up
                while up and up.up and up.tag not in BLOCK:
                    up = up.up
                around = (up or own).number, ((up or own).up or up or own).number
                out.append(Block(text, stack[-1].block, stack[-1].above, linked[0], around))
            pieces.clear()
            linked[0] = 0

    def pop_to(at: int):
        nonlocal unshown
        for frame in stack[at:]:
            open_[frame.tag] -= 1
            unshown -= frame.tag in UNSHOWN
        del stack[at:]

    def nearest(tags: set[str], stops: set[str]) -> int:
        if any(open_.get(t) for t in tags):
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag in tags:
                    return at
                if stack[at].tag in stops:
                    break
        return 0

    at, size = 0, len(html)
    while at < size:
        token = TOKEN.search(html, at)
        upto = token.start() if token else size
        if upto > at and not unshown:
            text = html[at:upto]
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            if open_.get("a"):
                linked[0] += len(text)
        if not token:
            break
        at = token.end()
        name = token[2] or token[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), bool(token[1] or token[4]), token[3] or token[6] or ""
        if tag in RAW and not closing:
            end = closed_at(tag, at)
            if tag == "title" and not title:
                title = " ".join(unescape(html[at:end]).split())
            if end < size and not attributes.rstrip().endswith("/") or tag in TO_THE_END:
                at = end
            continue
        if tag in UNSHOWN and not closing:
            if closed_at(tag, at) < size and not attributes.rstrip().endswith("/"):
                stack.append(_Frame(tag, stack[-1].above, stack[-1].block, stack[-1].number, stack[-1]))
                open_[tag] = open_.get(tag, 0) + 1
                unshown += 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        block = tag in BLOCK
        if block:
            flush()
        if closing:
            if open_.get(tag):
                stops = set() if block or tag in UNSHOWN else BLOCK
                place = nearest({tag}, stops)
                if place:
                    pop_to(place)
            continue
        if block and open_.get("p"):
            place = nearest({"p"}, {"button", "table"})
            if place:
                pop_to(place)
        if tag in ENDS:
            place = nearest(*ENDS[tag])
            if place:
                pop_to(place)
        if tag in VOID:
            continue
        names = {f"c:{n}" for n in name_parts(attributes)} if "=" in attributes else set()
        names.add(f"t:{tag}")
        if attributes and HIDDEN.search(attributes):
            names.add("t:(hidden)")
        if known is not None:
            names &= known
        above = stack[-1].above
        number += 1
        stack.append(_Frame(tag, above if names <= above else above | names, tag if block else stack[-1].block, number, stack[-1]))
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    return out, title
