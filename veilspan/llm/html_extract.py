"""Main text of web pages by line-block distribution.

A page's mark-up is stripped into lines, one for each block-level element. A line's length is that of its text without
the text of links; between lines of different containers stand blank lines, one for each container that closes or opens
(a container that holds one line only is that line's own wrapping and counts for none). The lengths are summed over sliding
windows of ``WINDOW`` lines, which end before a line without length. Where such a sum surges the main text begins, where the lengths dive to nothing, and no surge
follows within a window, it ends, and the lines between are kept, links and all.

What mark-up says by its own vocabulary comes before that: scripts, forms, menus, footers and their like give no lines, nor does
what is outside ``article`` and ``main`` on a page that has text in one of them. Short labels in bare containers (a menu
without links) have no length, unless the page is no longer than that. Names that authors give (class, id) are doubts: lines under a
name that is common for notices or comments go where the page has text of its own beside them (its largest window a quarter
of theirs at least), and stay where they are what the page has to say.

Defined cases: null or empty html gives an empty text; unclosed or cut-off mark-up and lost quotes are read as far as
they go; pages without any length give an empty text; nothing is cut to a length; other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

WINDOW = 3
#: A surge needs a window of this share of the page's largest, but no more than so many characters.
SURGE_SHARE, SURGE = 0.4, 100
#: A line in a bare container that is shorter, and doesn't end like a sentence, is a label.
LABEL = 28
#: Lines under doubtful names go if the others' largest window is this share of theirs, or more.
DOUBT = 0.25
#: Containers nested deeper are part of the one they stand in.
DEPTH = 64

# a quoted value ends where a blank, a slash or the end of the tag follows: a lost quote swallows no text
_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]{0,65536}\"(?=[\s/>]|\Z)|'[^']{0,65536}'(?=[\s/>]|\Z))*+(?:>|\Z)"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>{_ATTRIBUTES}|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S
)
_RAW = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes")}
_SKIP = frozenset("nav footer aside form head dialog button select datalist menu object canvas".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINER = frozenset("article body center details div dl fieldset footer form header hgroup html main menu nav ol section table ul aside dialog".split())
_BARE = frozenset("body center div section main article".split())
_BLOCK = _CONTAINER | frozenset(
    "address blockquote caption dd dir dt figcaption figure h1 h2 h3 h4 h5 h6 hr legend li option p pre summary tbody td tfoot th thead tr".split()
)
_HEADING = frozenset("h1 h2 h3 h4".split())
_MAIN = frozenset(("article", "main"))
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_DOUBTFUL = re.compile(r"\b(?:ads?|advert\w*|sponsor\w*|promo|banner|cookies?|consent|notices?|popup|sidebar|comments?|respond|newsletter|share|related|breadcrumbs?|pagination)\b", re.I)
_SENTENCE = re.compile(r"[.!?…。！？:;,\"'”’»)\]]$")
_SPACE = re.compile(r"\s+")


@dataclass
class Line:
    text: str
    length: int  # without links' text
    label: bool  # short and in a bare container
    silent: bool  # mark-up says that it is no text
    doubtful: bool  # it stands under a name for notices, comments and their like
    heading: bool
    inside: bool  # of article or main
    path: tuple[int, ...]  # its containers


def lines(page: str) -> list[Line]:
    """The page's lines in order, without blank ones."""
    out: list[Line] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, int, bool, bool]] = []  # name, container (-1: none), without text, doubtful
    open_: Counter[str] = Counter()
    path: tuple[int, ...] = ()
    containers = silent = doubtful = links = inside = 0

    def flush() -> None:
        nonlocal linked
        line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if line:
            own = next((n for n, *_ in reversed(stack) if n in _BLOCK), "body")
            free = max(0, len(line) - linked)
            label = own in _BARE and len(line) < LABEL and not _SENTENCE.search(line)
            out.append(Line(line, 0 if silent else free, label, silent > 0, doubtful > 0, own in _HEADING, inside > 0, path))
        text.clear()
        linked = 0

    def put(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if links:
            linked += len(_SPACE.sub(" ", html.unescape(piece)).strip())

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:].removesuffix("]]>").replace("&", "&amp;").replace("<", "&lt;"))
            continue
        if name in _RAW and not m["end"]:
            at = _RAW[name].search(page, at).end()
            continue
        if name in _BLOCK:
            flush()
        elif name == "br":
            put(" ")
        if name in _VOID:
            continue
        if not m["end"]:
            rest = m["rest"].rstrip(">")
            if rest.endswith("/") and name not in _BLOCK:
                continue
            if name == "p" and stack and stack[-1][0] == "p":
                open_[stack.pop()[0]] -= 1
            mute = name in _SKIP or (name == "header" and not inside)
            doubt = False
            if rest.strip():
                mute = mute or bool(_HIDDEN.search(rest))
                for kind, *values in _NAMED.findall(rest):
                    value = "".join(values)
                    if kind.lower() == "role":
                        mute = mute or value.lower() in _ROLES
                    elif name not in ("html", "body", "main", "article"):
                        doubt = doubt or bool(_DOUBTFUL.search(value.replace("_", "-")))
            box = -1
            if name in _CONTAINER and len(path) < DEPTH:
                containers += 1
                box = containers
                path = (*path, box)
            stack.append((name, box, mute, doubt))
            open_[name] += 1
            silent, doubtful, links, inside = silent + mute, doubtful + doubt, links + (name == "a"), inside + (name in _MAIN)
        elif open_[name] > 0:
            while True:
                n, box, mute, doubt = stack.pop()
                open_[n] -= 1
                silent, doubtful, links, inside = silent - mute, doubtful - doubt, links - (n == "a"), inside - (n in _MAIN)
                if box >= 0:
                    path = path[:-1]
                if n == name:
                    break
    flush()
    return out


def _gaps(rows: list[Line]) -> list[int]:
    """Containers that close and open between each line and the next, those of one line alone aside."""
    held = Counter(c for r in rows for c in r.path)
    paths = [tuple(c for c in r.path if held[c] > 1) for r in rows]
    out = []
    for a, b in zip(paths, paths[1:]):
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        out.append(len(a) + len(b) - 2 * same)
    return out


def _spread(rows: list[Line]) -> tuple[list[int | None], list[int], list[int]]:
    """Lines' numbers with None for each blank line, lengths, and sums over windows, which end before a line without length."""
    places: list[int | None] = []
    for k, gap in enumerate([*_gaps(rows), 0] if rows else []):
        places += [k, *[None] * min(gap, WINDOW)]
    lengths = [0 if k is None else rows[k].length for k in places]
    sums = []
    for i in range(len(lengths)):
        stop = next((k for k in range(i, min(i + WINDOW, len(lengths))) if not lengths[k]), i + WINDOW)
        sums.append(sum(lengths[i:stop]))
    return places, lengths, sums


def main_text(page: str | None) -> str:
    """Lines between surge and dive, joined by two line feeds."""
    if not page:
        return ""
    rows = [r for r in lines(page) if not r.silent]
    if any(r.inside and r.length for r in rows):
        rows = [r for r in rows if r.inside]
    places, lengths, sums = _spread(rows)
    largest = {kind: max((n for n, k in zip(sums, places, strict=True) if k is not None and rows[k].doubtful == kind), default=0) for kind in (False, True)}
    if largest[True] and largest[False] >= DOUBT * largest[True]:
        rows = [r for r in rows if not r.doubtful]
        places, lengths, sums = _spread(rows)
    if max(sums, default=0) >= SURGE:
        for r in rows:
            r.length = 0 if r.label else r.length
        places, lengths, sums = _spread(rows)
    top = max(sums, default=0)
    if not top:
        return ""
    need = min(SURGE, SURGE_SHARE * top)
    keep = [False] * len(places)
    i = 0
    while i < len(places):
        if sums[i] >= need:
            start = end = i  # the surge, with the lines of any length right before it
            while start and lengths[start - 1] and not keep[start - 1]:
                start -= 1
            back = start - 1  # and the headings over it, whatever container they stand in
            while back >= 0 and not keep[back] and (places[back] is None or rows[places[back]].heading):
                start = back if places[back] is not None else start
                back -= 1
            while end < len(places) and (lengths[end] or any(x >= need for x in sums[end + 1 : end + WINDOW])):
                end += 1  # the dive: no length here, and no surge within a window
            keep[start:end] = [True] * (end - start)
            i = end
        i += 1
    return "\n\n".join(rows[k].text for k, kept in zip(places, keep, strict=True) if kept and k is not None)


def extractor():
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p if isinstance(p, str) else None) for p in pages], dtype=object)

    return extract


def extract(pages: DataFrame, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with one more column, the main text."""
    text_batches(pages.sparkSession)
    return pages.withColumn(out, extractor()(F.col(html_col)))
