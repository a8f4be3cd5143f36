"""Main text of web pages by the maximum-scoring contiguous region.

A page is a row of pieces: tags, and stretches of text between them. A piece has a score, a tag
mostly below zero and a stretch of text its number of words times the weight of its class: a long or
short block, a link or a heading, within an article or beside it. The weights are the log odds of
being main text, counted on labelled pages.

An element whose tag or name tells of a group (navigation, adverts, comments, notices, forms and so on)
scores its own words by the weights of that group, which differ for long blocks, short ones and
links, and with an article around the element or within it. Below zero it is left out as a whole;
else it is a wrapper like any other, whose words belong to the element around it. So no name decides by
itself: a menu of paragraphs may be a recipe, and comments stay comments.

One scan over the pieces finds the contiguous region with the largest sum, an element that is left
out counting as a tag. What stands in the same element beside it and scores above zero belongs to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from graincart.llm.common import in_pandas

# Elements by what they do.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "math", "canvas", "audio", "video", "title", "head"}
MAIN = {"article", "main"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: The groups that elements may belong to, by their tags and by words in their class, id or role.
TAGS = {"nav": "nav", "menu": "nav", "footer": "foot", "header": "top", "aside": "side", "form": "form", "button": "control", "select": "control", "textarea": "control", "dialog": "notice", "head": "head", "title": "head"}
GROUPS = {
    "comments": ("comment", "comments", "disqus", "replies", "reply", "respond"),
    "advert": ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "promo", "promotion", "sponsor", "sponsored", "teaser"),
    "nav": ("breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "pager", "pagination", "skip", "toolbar", "topbar"),
    "share": ("share", "sharing", "social"),
    "related": ("related",),
    "notice": ("alert", "alertdialog", "consent", "cookie", "cookies", "gdpr", "modal", "notice", "overlay", "popup"),
    "side": ("complementary", "sidebar", "widget", "widgets"),
    "top": ("header", "masthead"),
    "foot": ("contentinfo", "footer"),
    "signup": ("newsletter", "search", "subscribe"),
}
GROUP_OF = {word: group for group, words in GROUPS.items() for word in words}
#: What a class says about the page rather than about its element, and what may stand behind or before a name.
ABOUT_PAGE = {"has", "hide", "is", "no", "not", "show", "with", "without"}
BEHIND = {"area", "bar", "block", "body", "bottom", "box", "buttons", "container", "form", "inner", "item", "items", "left", "link", "links", "list", "main", "post", "posts", "primary", "right", "secondary", "section", "slot", "thread", "top", "wrap", "wrapper"}
BEFORE = {"blog", "global", "main", "page", "post", "primary", "site", "top"}
#: Words outside links from which a block is a long one.
LONG = 12

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[\"'>]")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)


class Piece(NamedTuple):
    """A tag, or text: its kind, words, text, block, the element whose text it is and the group element it stands in (-1: none)."""

    kind: str
    words: int
    text: str
    block: int
    element: int
    group: int = -1


class Group(NamedTuple):
    """An element of a group: which, the group element around it (-1: none), and whether it stands in an article."""

    name: str
    around: int
    inside: bool


def _tag_end(html: str, at: int) -> int:
    """The place of the > that ends the tag; where a quote never closes, that of the next one; -1 if there is none."""
    stop = _STOP.search(html, at)
    while stop and stop.group() != ">":
        close = html.find(stop.group(), stop.end())
        if close < 0:
            return html.find(">", at)
        stop = _STOP.search(html, close + 1)
    return stop.start() if stop else html.find(">", at)


def _known(word: str) -> str | None:
    """The group of a word, or of the name that it is joined from, as commentlist or siteheader."""
    if word in GROUP_OF:
        return GROUP_OF[word]
    for name, group in GROUP_OF.items():
        if len(name) > 3 and (word.startswith(name) and word[len(name) :] in BEHIND or word.endswith(name) and word[: -len(name)] in BEFORE):
            return group
    return None


def groups_of(attributes: str) -> set[str]:
    """The groups that a whole class, id or role names, that it ends in, or that it begins with before a word of BEHIND."""
    out = set()
    for m in _NAMES.finditer(attributes):
        for name in (m.group(1) or m.group(2) or m.group(3) or "").lower().split():
            parts = [x for x in _WORD.findall(name) if not x.isdigit()]
            if not parts or parts[0] in ABOUT_PAGE:
                continue
            found = [_known(x) for x in parts]
            if found[-1]:
                out.add(found[-1])
            out.update(g for g, behind in zip(found, parts[1:], strict=False) if g and behind in BEHIND)
    return out


def pieces(html: str) -> tuple[list[Piece], list[Group], bool]:
    """The tags and texts of a page, its group elements in the order in which they open, and whether an article stands in none of them."""
    out: list[Piece] = []
    groups: list[Group] = []
    # name, group element or -1, whether an article; and the element whose text stands there
    stack: list[tuple[str, int, bool]] = []
    places: list[int] = [-1]
    block, at, size = 0, 0, len(html)
    links = heads = 0
    free = False
    lower = html.lower()
    one_main = bool(re.search(r"<(?:article|main)[\s>]", lower))

    def group_now() -> int:
        return next((g for _, g, _ in reversed(stack) if g >= 0), -1)

    def text(raw: str) -> None:
        if not raw or raw.isspace():
            if raw and out and out[-1].block == block and out[-1].text:
                out.append(Piece("space", 0, " ", block, -1, out[-1].group))
            return
        raw = unescape(raw)
        place = "link" if links else "head" if heads else "text"
        where = "main" if any(m for *_, m in stack) else "beside" if one_main else ""
        out.append(Piece(f"{place}-{where}" if where else place, len(raw.split()), raw, block, places[-1], group_now()))

    def close() -> str:
        name, *_ = stack.pop()
        places.pop()
        return name

    while at < size:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        if start > at:
            text(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            at = size if end < 0 else end + 1
            continue
        tag = _TAG.match(html, start)
        if tag is None:
            text("<")
            at = start + 1
            continue
        end = _tag_end(html, tag.end())
        at = end + 1 if end >= 0 else size
        closes, name, rest = bool(tag.group(1)), tag.group(2).lower(), html[tag.end() : at - 1 if end >= 0 else size]
        if name in RAW and not closes and not rest.endswith("/") and name not in ("head", "title"):
            end = lower.find(f"</{name}", at)
            if end < 0:
                break
            at = (html.find(">", end) + 1) or size
            continue
        if name not in INLINE:
            block += 1
        kind = f"/{name}" if closes else name
        out.append(Piece(f"<{kind}" if name not in INLINE else "<inline", 0, "", block, -1, group_now()))
        if name in VOID:
            if name == "br":
                out.append(Piece("space", 0, " ", block, -1, group_now()))
            continue
        if closes:
            if any(x[0] == name for x in stack):
                while stack:
                    gone = close()
                    links -= gone == "a"
                    heads -= _heading(gone)
                    if gone == name:
                        break
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            close()
        if rest.endswith("/"):
            continue
        inside = any(m for *_, m in stack)
        named = groups_of(rest) if rest and name not in ("body", "html", "main") else set()
        if name in MAIN:
            named &= {"comments", "advert", "related"}
        if inside:
            # an article's own header is part of it
            named -= {"top"}
        if rest and _HIDDEN.search(rest):
            named = {"hidden"}
        if not named and name in TAGS and not (name == "header" and inside):
            named = {TAGS[name]}
        # what may stay open must not swallow the rest of the page
        if (name in INLINE and name != "a" or name == "p") and not named:
            continue
        if name == "a":
            if links:
                continue
            links += 1
        heads += _heading(name)
        group = -1
        for g in sorted(named):
            groups.append(Group(g, group if group >= 0 else group_now(), inside))
            group = len(groups) - 1
        free = free or name in MAIN and not named and group_now() < 0
        stack.append((name, group, name in MAIN and "comments" not in named))
        inner = name in INLINE or _heading(name)
        places.append(places[-1] if inner else -1 if name in ("html", "body") else start)
    return out, groups, free


def _heading(name: str) -> bool:
    return len(name) == 2 and name[0] == "h" and name[1].isdigit()


def _kinds(found: list[Piece]) -> list[str]:
    """The class of each piece: plain texts and links are of long or of short blocks, by the words beside links."""
    words = Counter()
    for p in found:
        if p.kind.startswith("text"):
            words[p.block] += p.words
    long_ = {b for b, n in words.items() if n >= LONG}
    out = []
    for p in found:
        name, mark, where = p.kind.partition("-")
        if name == "text":
            name = "long" if p.block in long_ else "short"
        elif name == "link" and p.block in long_:
            name = "inlink"
        out.append(f"{name}{mark}{where}")
    return out


def _in_group(group: Group, kind: str, free: bool) -> str:
    """The class of words in a group: with an article around the element, within it or neither, and with a free article elsewhere or none."""
    name, _, where = kind.partition("-")
    place = "in" if group.inside else "out" if where == "main" else ""
    return f"{group.name}/{place if group.inside or not free else f'{place}beside'}/{name}"


def left_out(found: list[Piece], groups: list[Group], free: bool, kinds: list[str], weights: dict[str, float]) -> list[bool]:
    """Which group elements score below zero, or stand in one that does; the words of the others count for the element around them."""
    words: list[Counter] = [Counter() for _ in groups]
    for p, kind in zip(found, kinds, strict=True):
        if p.group >= 0 and p.words:
            words[p.group][kind] += p.words
    out = [False] * len(groups)
    for i in reversed(range(len(groups))):
        score = sum(n * _group_weight(weights, _in_group(groups[i], kind, free)) for kind, n in words[i].items())
        out[i] = score <= 0
        if not out[i] and groups[i].around >= 0:
            words[groups[i].around].update(words[i])
    for i, g in enumerate(groups):
        out[i] = out[i] or g.around >= 0 and out[g.around]
    return out


def _group_weight(weights: dict[str, float], kind: str) -> float:
    name, _, place = kind.split("/")
    return weights.get(kind, weights.get(f"{name}//{place}", -1.0))


def _scored(html: str, weights: dict[str, float]) -> list[Piece]:
    """The pieces of a page with their classes; what is left out is of the class of its group and has no words."""
    found, groups, free = pieces(html)
    kinds = _kinds(found)
    out = left_out(found, groups, free, kinds, weights)
    scored = []
    for p, kind in zip(found, kinds, strict=True):
        gone = p.group >= 0 and out[p.group]
        scored.append(p._replace(kind=f"aside:{groups[p.group].name}" if gone and p.text.strip() else kind, words=0 if gone else p.words))
    return scored


def weights_from(labelled: Iterable[str]) -> dict[str, float]:
    """Log odds of each class of pieces to be main text, from labelled pages.

    Words of the main text are written ``main`` there and all others ``other``. The weights of groups
    come first: a group's words by their class. With these it is known what is left out, and the other
    classes are counted: a text by its words; a tag, or what is left out, as main text if main text
    stands on both sides of it.
    """
    pages = list(labelled)
    inside, outside = Counter(), Counter()
    for html in pages:
        found, groups, free = pieces(html)
        for p, kind in zip(found, _kinds(found), strict=True):
            if p.group >= 0 and p.words:
                (inside if "main" in p.text else outside)[_in_group(groups[p.group], kind, free)] += p.words
    out = _log_odds(inside, outside)
    inside, outside = Counter(), Counter()
    for html in pages:
        found = _scored(html, out)
        mains = [i for i, p in enumerate(found) if p.words and "main" in p.text]
        for i, p in enumerate(found):
            within = bool(mains) and mains[0] < i < mains[-1]
            is_main = "main" in p.text if p.words else within
            (inside if is_main else outside)[p.kind] += p.words or 1
            if p.kind.startswith("aside:"):
                (inside if is_main else outside)["aside"] += 1
    # tags mark a border of the region: the larger part of their weight would be that of the words near them
    return out | {k: (min(w, -0.1) / 2 if k[0] == "<" else min(w, -0.1) if k.startswith("aside") else w) for k, w in _log_odds(inside, outside).items() if k != "space"}


def _log_odds(inside: Counter, outside: Counter) -> dict[str, float]:
    total_in, total_out = sum(inside.values()), sum(outside.values())
    return {k: math.log((inside[k] + 0.5) / (total_in + 1)) - math.log((outside[k] + 0.5) / (total_out + 1)) for k in inside.keys() | outside.keys()}


def labelled_pages() -> list[str]:
    """Pages of common layouts whose main text is known; the words stand for any words."""
    line = lambda n, w="main": " ".join([w] * n)
    other = lambda n: line(n, "other")
    links = lambda n: "".join(f'<li><a href="/{i}">{other(2)}</a></li>' for i in range(n))
    bodies = [
        "".join(f"<p>{line(n)}</p>" for n in (30, 55, 12)),
        f"<h1>{line(7)}</h1>" + "".join(f"<p>{line(n)} <a href='/x'>{line(2)}</a> {line(9)}</p>" for n in (25, 8, 40, 60)),
        f"<h2>{line(4)}</h2><p>{line(35)}</p><ul><li>{line(9)}</li><li>{line(11)}</li></ul><h2>{line(4)}</h2><p>{line(45)}</p><blockquote>{line(20)}</blockquote>",
        f"<p>{line(3)}</p>",
        f"<h1>{line(5)}</h1><p>{line(40)}</p><div class='ad'>{other(9)}</div><p>{line(30)}</p><div class='share'><a href='/s'>{other(1)}</a></div>",
        f"<h1>{line(6)}</h1><p>{line(28)}</p><table><tr><th>{line(1)}</th><th>{line(2)}</th></tr><tr><td>{line(3)}</td><td>{line(4)}</td></tr></table><pre>{line(12)}</pre><p>{line(22)}</p>",
        f"<h1>{line(8)}</h1><figure><img src='x'><figcaption>{line(6)}</figcaption></figure><p>{line(50)}</p><form class='newsletter'><p>{other(8)}</p><input></form><p>{line(33)}</p>",
        f"<div><p>{line(26)}</p></div><div><p>{line(31)}</p><div class='related'><ul>{links(3)}</ul></div></div><div><p>{line(18)}</p></div>",
    ]
    heads = [
        f"<nav><ul>{links(6)}</ul></nav><div class='ad'>{other(12)}</div>",
        f"<header><a href='/'>{other(2)}</a><ul>{links(8)}</ul></header><div class='cookie-notice'>{other(20)}</div>",
        f"<div><a href='/'>{other(1)}</a> <a href='/b'>{other(1)}</a> <a href='/c'>{other(1)}</a></div><form><input><button>{other(1)}</button></form>",
        f"<div id='masthead' class='site-header'><h1><a href='/'>{other(3)}</a></h1><p>{other(6)}</p></div><div class='breadcrumb'><a href='/'>{other(1)}</a> / <a href='/b'>{other(1)}</a></div>",
    ]
    ends = [
        f"<footer>&copy; {other(8)}</footer>",
        f"<div class='comments'><h3>{other(2)}</h3><p>{other(15)}</p><p>{other(30)}</p></div><footer>{other(6)}<ul>{links(4)}</ul></footer>",
        f"<aside><h3>{other(2)}</h3><ul>{links(5)}</ul><p>{other(10)}</p></aside><div><a href='/p'>{other(2)}</a> &middot; {other(3)}</div>",
        f"<div class='sidebar'><div class='widget'><h3>{other(1)}</h3><ul>{links(7)}</ul></div><div class='widget'><p>{other(14)}</p></div></div><div id='footer'><p>{other(11)}</p></div>",
    ]
    wraps = [("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<div class='content has-sidebar'><div>", "</div></div>")]
    out = []
    page = lambda inner: f"<html><head><title>{other(6)}</title><script>x</script></head><body>{inner}</body></html>"
    for i, body in enumerate(bodies):
        for j, (head, end) in enumerate((h, e) for h in heads for e in ends):
            left, right = wraps[(i + j + j // 4) % len(wraps)]
            inner = f"{head}{left}{body}{right}{end}"
            out.append(page(f"<form id='page'>{inner}</form>" if (i + j) % 11 == 5 else inner))
    # elements that are named as asides and hold the article, around an <article> or without one, or a long part of it
    wrappers = ["class='social'", "id='share'", "class='share-box'", "class='menu'", "class='sidebar'", "class='widget'", "class='header'", "class='toolbar'", "role='complementary'"]
    for i, name in enumerate(wrappers):
        body, head, end = bodies[i % 3], heads[i % 4], ends[(i + 1) % 4]
        out.append(page(f"{head}<div {name}>{body}</div>{end}"))
        out.append(page(f"{head}<div {name}><article>{body}</article></div>{end}"))
        out.append(page(f"{head}<article><div {name}>{body}</div></article>{end}"))
        out.append(page(f"{head}<article>{body}<section {name}><p>{line(34)}</p><p>{line(21)}</p></section><p>{line(15)}</p></article>{end}"))
    for tag in ("nav", "aside", "form"):
        out.append(page(f"<{tag}><div>{bodies[1]}</div></{tag}><div id='footer'><p>{other(11)}</p></div>"))
    # the same names beside an article: teasers, some of them articles of their own
    for i, name in enumerate([*wrappers, "class='related-posts'", "id='ad-slot'", "class='widget-area'", "class='site-footer'", "class='popup'", "class='comment-list'"]):
        body, head, end = bodies[i % 3], heads[i % 4], ends[(i + 2) % 4]
        for left, right in (("<article>", "</article>"), ("<main>", "</main>")):
            out.append(page(f"{head}{left}{body}{right}<div {name}><article><h3>{other(4)}</h3><p>{other(24)}</p></article></div>{end}"))
            out.append(page(f"{head}{left}{body}{right}<div {name}><p>{other(19)}</p><p>{other(31)}</p></div>{end}"))
            out.append(page(f"<div {name}><p>{other(16)}</p></div>{left}{body}{right}{end}"))
    for tag in ("nav", "aside", "form", "dialog", "footer"):
        out.append(page(f"<{tag}><article>{bodies[1]}</article></{tag}>{ends[0]}"))
    # pages that are a form to fill in, and articles with one below
    fields = lambda n: "".join(f"<div><label>{other(1 + i % 4)}</label><input></div><p>{other(2 + i % 5)}</p>" for i in range(n))
    for i in range(12):
        out.append(page(f"{heads[i % 4]}<form>{fields(4 + i)}<button>{other(1)}</button></form>{ends[i % 4]}"))
        out.append(page(f"{heads[i % 4]}{wraps[i % 4][0]}{bodies[1 + i % 3]}{wraps[i % 4][1]}<form>{fields(3 + i)}</form>{ends[i % 4]}"))
    # rows of buttons, by every name and place
    for i in range(24):
        name = ["class='share'", "class='social-links'", "id='sharing'", "class='toolbar'", "class='widget'", "class='menu'"][i % 6]
        row = f"<div {name}>{other(1 + i % 3)} " + " ".join(f"<a href='/{k}'>{other(1)}</a>" for k in range(2 + i % 5)) + "</div>"
        left, right = wraps[i % 4]
        inner = f"{left}{row}{bodies[i % 3]}{row}{right}" if i % 2 else f"{row}{left}{bodies[i % 3]}{right}{row}"
        out.append(page(f"{heads[i % 4]}{inner}{ends[i % 4]}"))
    # asides with long texts: comments however they are marked, notices, adverts, teasers, sign-ups, footers, hidden parts
    talk = [
        f"<ol id='commentlist'><li><p>{other(40)}</p></li><li><p>{other(9)}</p><p>{other(55)}</p></li></ol>",
        f"<section class='comments'><article class='comment'><header>{other(3)}</header><p>{other(33)}</p></article><article class='comment'><p>{other(48)}</p></article></section>",
        f"<div id='disqus_thread'><p>{other(28)}</p></div><div id='respond'><form><p>{other(14)}</p><textarea></textarea></form></div>",
    ]
    asides = [
        f"<div class='cookie-consent'><p>{other(38)}</p><button>{other(2)}</button></div>", f"<div id='gdpr'><p>{other(60)}</p></div>", f"<div class='alert'><p>{other(16)}</p></div>", f"<div class='modal'><h2>{other(3)}</h2><p>{other(22)}</p></div>",
        f"<div class='advert'><p>{other(30)}</p></div>", f"<aside class='promo'><h4>{other(4)}</h4><p>{other(24)}</p></aside>", f"<div class='sponsored'><p>{other(45)}</p></div>",
        f"<div class='related'><h3>{other(2)}</h3><div><a href='/a'>{other(6)}</a><p>{other(18)}</p></div><div><a href='/b'>{other(7)}</a><p>{other(20)}</p></div></div>",
        f"<form class='newsletter'><p>{other(20)}</p><input></form>", f"<div class='subscribe'><p>{other(26)}</p></div>", f"<div class='search'><p>{other(13)}</p></div>",
        f"<div hidden><p>{other(30)}</p></div>", f"<div style='display:none'><p>{other(44)}</p></div>",
        f"<form><p>{other(5)}</p><label>{other(2)}</label><select><option>{other(3)}</option></select></form>", f"<div class='share'>{other(2)} <a href='/s'>{other(1)}</a> <a href='/t'>{other(1)}</a></div>",
        f"<nav><a href='/p'>{other(3)}</a> {other(1)} <a href='/n'>{other(3)}</a></nav>", f"<div class='sidebar'><h3>{other(2)}</h3><p>{other(8)}</p></div>", f"<dialog><p>{other(6)}</p><button>{other(1)}</button></dialog>",
    ]
    for i, (aside, body) in enumerate((a, b) for a in talk * 3 + asides for b in (bodies[1], bodies[2])):
        head, long_end = heads[i % 4], f"<footer><p>{other(40)}</p><p>{other(17)}</p></footer>"
        left, right = wraps[i % len(wraps)]
        out.append(page(f"{head}{left}{body}{aside}{right}{long_end}"))
        out.append(page(f"{head}{left}{body}{right}{aside}{long_end}"))
        half = body.rindex("<p>")
        out.append(page(f"{head}{left}{body[:half]}{aside}{body[half:]}{right}{long_end}"))
    return out


def _weight(weights: dict[str, float], kind: str) -> float:
    return weights.get(kind, weights.get("aside", -1.0) if kind.startswith("aside:") else -0.1 if kind[0] == "<" else 0.0)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Where the contiguous scores with the largest sum begin and end; of equal sums the first region. (0, 0) if none is above zero."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def _with_home(found: list[Piece], scores: list[float], span: tuple[int, int]) -> tuple[int, int]:
    """The region, grown to all texts above zero of the element that holds most of its words, as behind a long list of links."""
    held = Counter()
    for p in found[slice(*span)]:
        held[p.element] += p.words
    home = max(held, key=held.get, default=-1)
    more = [i for i, p in enumerate(found) if p.element == home and p.words and scores[i] > 0] if home >= 0 else []
    return (min(span[0], *more), max(span[1], more[-1] + 1)) if more else span


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, joined by newlines; empty if no region has a positive score."""
    found = _scored(html, weights) if html else []
    scores = [_weight(weights, p.kind) * (p.words or 1) for p in found]
    blocks: dict[int, list[str]] = {}
    for p in found[slice(*_with_home(found, scores, best_region(scores)))]:
        if p.text and not p.kind.startswith("aside:"):
            blocks.setdefault(p.block, []).append(p.text)
    lines = [" ".join("".join(x).split()) for x in blocks.values()]
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html).

    A null or empty page, or one without main text, has the text '' of 0 characters. Repeated rows
    have equal results, and pages of any length are read whole. Of regions that tie the first one
    stands. An empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    weights = weights_from(labelled_pages()) if weights is None else weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["page_id", "url"]].copy()
            out["text"] = pd.Series([main_text(h, weights) for h in batch["html"]], index=out.index, dtype=object)
            out["n_chars"] = out["text"].map(len).astype("int64")
            yield out

    return in_pandas(pages.select("page_id", "url", "html"), run, "page_id", "url string, text string, n_chars long")
