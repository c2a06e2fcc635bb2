"""Leaf text blocks of an HTML page with the features of their place."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Comments, declarations and raw text with its element.
UNREAD = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I
)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
BETWEEN = re.compile(r"[\s/]*")
NAME = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
READ = frozenset("class id role aria-label type".split())
#: Elements without text of the page, up to their end tag. Where it is missing, the tag is one like any other.
SKIPPED = re.compile(r"<(noscript|template|svg|iframe|object|select)(?=[\s/>])([^>]*)>", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul option button label".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag that ends an open one of the same list.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_IN_P = BLOCKS - {"button", "label"}

# fixed values: words of class, id and role that say what a part of a page is for
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip",
    "head": "header masthead banner branding logo tagline hero",
    "foot": "footer copyright colophon legal bottom",
    "side": "sidebar aside rail widget widgets complementary related recommended trending popular teaser more",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe paywall signup dialog",
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion promoted banner-ad dfp outbrain taboola",
    "form": "form search login contact poll survey",
    "comment": "comment comments reply replies respond discussion disqus feedback reviews",
    "share": "share social sharing follow like tags meta byline",
    "main": "article content main post story entry body text prose",
}
CUE_OF = {word: cue for cue, words in CUES.items() for word in words.split()}
NOT_WORD = re.compile(r"[^a-z]+")
BLANKS = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    features: list[str] = field(default_factory=list)


def _cues(attributes: dict[str, str]) -> tuple[str, ...]:
    found: dict[str, None] = {}
    for name, value in attributes.items():
        if name not in READ:
            continue
        for word in NOT_WORD.split(value.lower()):
            cue = CUE_OF.get(word) or CUE_OF.get(word.rstrip("s"))
            if cue:
                found[cue] = None
    return tuple(found)


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[int, dict[str, str]]:
    """Where the tag ends whose attributes start at ``at`` (-1: nowhere), and its attributes, the first of each name.

    A quote opens a value only right behind the equals sign; elsewhere it is a character of a name or a bare value.
    A value whose quote is not closed on the page (``last`` has the last place of either quote) is a bare value.
    """
    found: dict[str, str] = {}
    while True:
        at = BETWEEN.match(page, at).end()
        if at >= len(page):
            return -1, found
        if page[at] == ">":
            return at + 1, found
        name = NAME.match(page, at)
        at, value = name.end(), ""
        if equals := EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            if at < last.get(quote, -1):
                end = page.find(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                bare = BARE.match(page, at)
                value, at = bare[0].lstrip("\"'"), bare.end()
        found.setdefault(name[0].lower(), entities.unescape(value))


def _tokens(page: str) -> Iterator[tuple[str | None, bool, str, dict[str, str]]]:
    """(text, closing, tag, attributes): texts, with no tag, and tags, with no text. One pass over the page."""
    at, unclosed, last_end = 0, set(), page.rfind(">")
    last = {quote: page.rfind(quote) for quote in "\"'"}
    while at < len(page):
        start = page.find("<", at)
        if start != at:
            start = len(page) if start < 0 else start
            yield page[at:start], False, "", {}
            at = start
            continue
        if at > last_end:  # no tag can end from here on
            yield page[at:], False, "", {}
            return
        if m := SKIPPED.match(page, at):
            tag = m[1].lower()
            if tag == "svg" and m[2].endswith("/"):
                at = m.end()
                continue
            end = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, m.end())
            if end:
                at = end.end()
                continue
            unclosed.add(tag)  # no end tag from here on
        if m := UNREAD.match(page, at):
            at = m.end()
        elif m := TAG.match(page, at):
            at, attributes = _attributes(page, m.end(), last)
            if at < 0:
                return
            yield None, bool(m[1]), m[2].lower(), attributes
        else:
            yield "<", False, "", {}
            at += 1


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order, each with its features. Script, style and the head have no text."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0  # characters inside links
    links = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = BLANKS.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, _features(text, stack, linked / max(1, sum(map(len, parts))))))
            parts, linked = [], 0

    def pop_to(index: int) -> None:
        nonlocal links
        for tag, _ in stack[index:]:
            links -= tag == "a"
        del stack[index:]

    for text, closing, tag, attributes in _tokens(page or ""):
        if text is not None:
            parts.append(text)
            if links:
                linked += len(text)
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
        elif tag in VOID:
            if tag == "br":
                parts.append(" ")
        else:
            ended = ENDS.get(tag, ())
            # an inline tag ends nothing, however deep it stands
            for i in range(len(stack) - 1, -1, -1) if ended or tag in NOT_IN_P else ():
                name = stack[i][0]
                if name in ended or (name == "p" and tag in NOT_IN_P):
                    pop_to(i)
                    break
                if name in BLOCKS:
                    break
            links += tag == "a"
            stack.append((tag, _cues(attributes)))
    flush()
    for i, b in enumerate(out):
        if i == 0:
            b.features.append("first")
        if i == len(out) - 1:
            b.features.append("last")
    return out


def _features(text: str, stack: list[tuple[str, tuple[str, ...]]], linked: float) -> list[str]:
    names = {"bias"}
    leaf = ""
    for tag, cues in stack:
        if tag in BLOCKS:
            names.add(f"in:{tag}")
            leaf = tag
        names.update(f"cue:{c}" for c in cues)
    n = text.count(" ") + 1
    names.add(f"leaf:{leaf}")
    names.add(f"words:{min(6, n.bit_length())}")
    names.add(f"linked:{0 if linked < 0.2 else 1 if linked < 0.6 else 2}")
    names.add("stop" if text[-1] in ".!?…»”\"'" else "no stop")
    if "©" in text or "All rights reserved" in text:
        names.add("copyright")
    if leaf in ("p", "blockquote", "pre", "td", "li", "div", "section", "article", "main", "body"):
        names.add(f"words:{min(6, n.bit_length())}:{'linked' if linked >= 0.6 else 'plain'}")
    return sorted(names)
