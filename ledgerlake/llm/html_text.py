"""Main text of web pages by line-block distribution.

Markup is stripped to one line a block element. A line weighs as much as its text less
twice the text of its links; a line in a menu, footer, sidebar, notice, advert, form,
script or comment section weighs nothing. Weights are summed over windows of BLOCK lines:
the text starts at the surge (a window that reaches SURGE) and ends at the dive (windows
have fallen to zero). A line of a marked article weighs SURGE more, so that it is kept
however short it is, and where an article is marked the lines outside weigh nothing.
Where none is marked, windows alone find the text; then the innermost container that
holds nearly all of it gives back what windows leave out: short last paragraphs, and
paragraphs full of links, but not lists of links.

What marks a line as boilerplate is weak evidence. An element that is named like a
sidebar, a header or a form, and holds over half of the page's text, is its layout. Names
of adverts, notices and comments hold for any element, others only for containers and for
elements that have no further name. A marked article counts inside such elements if there
is none outside of them.

Defined cases: null or empty html gives an empty text; truncated tags are dropped as
browsers do, truncated references stay as they are; unclosed paragraphs, items and cells
end where browsers end them; a repeated row is extracted as often as it comes; further
columns are ignored. Null ids and urls are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm.common import map_texts, table

BLOCK = 3
SURGE = 86
#: Comments, raw-text elements with what is in them, tags; a tag that the end of the page cuts off goes too.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|object|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is no part of an article; a form may be a page's layout.
BOILERPLATE = frozenset("nav footer aside button dialog menu head search label input".split())
#: Elements that end a sibling of theirs that is still open.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that hold lines together; others are lines or groups of lines.
CONTAINERS = frozenset("article main section div td center fieldset form details".split())
#: Words in class, id or role: of what is never part of an article, and of what may also be a layout or a style.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription comment comments disqus respond replies popup modal breadcrumb breadcrumbs pagination pager".split())
WEAK = frozenset("nav navbar navigation menu sidebar side aside footer foot header head masthead topbar notice notices signup login share sharing social related recommended reply form search widget toolbar copyright legal complementary contentinfo".split())
HEADERS = frozenset("header head masthead".split())
#: "has-sidebar" says that there is one elsewhere.
ELSEWHERE = frozenset("has with no without".split())
TOKEN = re.compile(r"[^\W_]+")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
#: White space of HTML and of Unicode, non-breaking included.
SPACE = re.compile(r"\s+")


class State(NamedTuple):
    """What the open elements say of the text in them."""

    strong: bool = False
    weak: tuple[int, ...] = ()
    form: bool = False
    article: bool = False
    outer: bool = False  #: the article stands in an element that is marked as boilerplate
    path: tuple[int, ...] = ()
    link: bool = False
    mute: bool = False  #: inline boilerplate, whose text is left out of its line


class Line(NamedTuple):
    text: str
    linked: int
    state: State


def marks(names: list[str], leaf: bool, article: bool) -> tuple[bool, bool]:
    """Whether class, id and role name what is never part of an article, and what may not be."""
    strong, weak, plain = False, False, False
    for name in names:
        for part in name.lower().split():
            tokens = TOKEN.findall(part)
            if ELSEWHERE.intersection(tokens):
                continue
            strong |= not STRONG.isdisjoint(tokens)
            named = not WEAK.isdisjoint(tokens) and not (article and not HEADERS.isdisjoint(tokens))
            weak |= named
            plain |= not named
    return strong, weak and not (leaf and plain)


def lines_of(page: str) -> list[Line]:
    """The blocks of a page in order."""
    out: list[Line] = []
    stack: list[tuple[str, State]] = []  # open elements: name, and what held before
    state, number = State(), 0
    parts: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal parts, linked
        if parts:
            if text := SPACE.sub(" ", "".join(parts)).strip():
                out.append(Line(text, min(linked, len(text)), state))
            parts, linked = [], 0

    def close(depth: int) -> None:
        nonlocal state
        state = stack[depth][1]
        del stack[depth:]

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not state.mute:
            text = html.unescape(piece) if "&" in piece else piece
            parts.append(text)
            linked += len(text) if state.link else 0

    at = 0
    for m in MARKUP.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1] and m[1].lower() in ("title", "select", "textarea"):
                end()
            continue
        name = name.lower()
        block = name in BLOCKS
        if block:
            end()
        elif name == "br":
            parts.append(" ")
        if m[2]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
            continue
        if name in VOID or m[4].rstrip().endswith("/"):
            continue
        if block:  # ends an open paragraph and what is inline in it, or an open sibling
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in BLOCKS:
                    break
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in SIBLINGS.get(name, ()):
                    close(depth)
                    if name != "tr":
                        break
                elif stack[depth][0] in BLOCKS:
                    break
        attributes = m[4]
        names = [x or y or z for x, y, z in ATTRIBUTE.findall(attributes)] if attributes else []
        is_article = name in ("article", "main") or bool(names and MAIN.search(attributes))
        strong, weak = marks(names, name not in CONTAINERS and name not in ("ul", "ol", "dl", "table", "header"), state.article) if names and name not in ("html", "body") else (False, False)
        strong |= name in BOILERPLATE
        weak |= name == "header" and not state.article
        if not (block or strong or name == "a"):
            continue  # an inline element without meaning here; unclosed ones would only fill the stack
        stack.append((name, state))
        number += 1
        if not block:
            state = state._replace(mute=state.mute or strong, link=state.link or name == "a")
        elif is_article and not strong and not state.article:
            state = State(article=True, outer=state.strong or bool(state.weak) or state.form, path=state.path)
        elif strong or weak or name == "form":
            state = state._replace(strong=state.strong or strong, weak=(*state.weak, number) if weak else state.weak, form=state.form or name == "form")
        if name in CONTAINERS:
            state = state._replace(path=(*state.path, number))
    add(page[at:])
    end()
    return out


def boilerplate(lines: list[Line]) -> np.ndarray:
    """Which lines are marked as no part of an article, by elements that are not the page's layout."""
    held: Counter[int] = Counter()
    total = formed = 0
    for text, _, s in lines:
        if not s.strong:
            total += len(text)
            formed += len(text) if s.form else 0
            for w in s.weak:
                held[w] += len(text)
    layout = {w for w, n in held.items() if 2 * n > total}
    return np.array([s.strong or not layout.issuperset(s.weak) or (s.form and 2 * formed <= total) for _, _, s in lines], bool)


def between(weights: np.ndarray, threshold: int, strict: bool = False) -> np.ndarray:
    """Which lines lie between a surge and its dive and have weight; unless strict, a page that never reaches the threshold keeps what lies around its largest window."""
    n = len(weights)
    if not n or not weights.any():
        return np.zeros(n, bool)
    total = np.concatenate([[0], np.cumsum(weights)])
    block = total[np.minimum(np.arange(n) + BLOCK, n)] - total[:n]
    threshold = threshold if strict else min(threshold, int(block.max()))
    keep, i = np.zeros(n, bool), 0
    while i < n:
        if block[i] >= threshold:
            j = i
            while j < n and block[j] > 0:
                j += 1
            keep[i:j] = True
            i = j
        i += 1
    return keep & (weights > 0)


def given_back(lines: list[Line], keep: np.ndarray, weights: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The lines of the text's own container, with those that windows have left out, and others only where windows find them without it."""
    held: Counter[tuple[int, ...]] = Counter()
    for i in np.flatnonzero(keep).tolist():
        for depth in range(len(lines[i].state.path) + 1):
            held[lines[i].state.path[:depth]] += int(weights[i])
    most = 0.9 * int(weights[keep].sum())
    home = max((p for p, n in held.items() if n >= most), key=len)
    all_links = np.array([10 * x.linked >= 9 * len(x.text) for x in lines], bool)
    beside = np.r_[False, all_links[:-1]] | np.r_[all_links[1:], False]
    own = np.array([x.state.path[: len(home)] == home if home else not x.state.path for x in lines], bool)
    back = own & ~bad & ~(all_links & beside)
    if not home:
        return keep | back
    apart = weights * ~own
    return keep & (own | between(apart, SURGE, True)) | back


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    if not lines:
        return ""
    bad = boilerplate(lines)
    inside = np.array([x.state.article for x in lines], bool) & ~bad
    proper = inside & np.array([not x.state.outer for x in lines], bool)
    inside = proper if proper.any() else inside
    if inside.any():
        weights = np.array([len(x.text) + SURGE for x in lines], np.int64) * inside
        keep = between(weights, SURGE)
    else:
        weights = np.array([max(0, len(x.text) - 2 * x.linked) for x in lines], np.int64) * ~bad
        keep = between(weights, SURGE)
        if keep.any():
            keep = given_back(lines, keep, weights, bad)
    return "\n".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""

    def run(texts: list[str]) -> dict[str, list]:
        out = [main_text(x) for x in texts]
        return {"text": out, "n_chars": [len(x) for x in out]}

    return map_texts(pages, ["page_id", "url"], "html", run, "text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
