"""Pages as trees of blocks.

Inline markup is folded into the block around it. Broken pages are read the way browsers
do: unknown end tags are skipped, a new paragraph ends the one before.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

# Elements by kind, as the public HTML standard lists them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title textarea noscript template iframe svg object select button form nav".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main math menu nav noscript object"
    " ol option p pre script section select style summary svg table tbody td template textarea tfoot th thead title tr ul".split()
)
ENDS_P = BLOCKS - frozenset("button caption head html body option td th tr tbody thead tfoot title script style template".split())
# What a start tag ends: its own kind of neighbour, up to the list or table around it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
P_STOPS = frozenset("button caption html body table td th template".split())

TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)"
    r"|<[!?][^<>]*+>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<rest>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+[^<>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACES = re.compile(r"\s+")
#: Like browsers, elements nested deeper than this count as children of the one at this depth.
DEPTH = 512


@dataclass
class Block:
    tag: str
    parent: int
    names: str = ""
    marked: bool = False
    linked: int = 0
    #: Characters of its own text, without what is in blocks inside it.
    own: int = 0


def parse(page: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """The blocks of a page, parents first, and its pieces of text in order, each with its block."""
    blocks = [Block("#page", -1)]
    stack: list[tuple[str, int]] = [("#page", 0)]
    runs: list[tuple[int, str]] = []
    at, links = 0, 0
    open_: Counter[str] = Counter()

    def text(raw: str) -> None:
        if raw:
            clear = unescape(raw)
            runs.append((stack[-1][1], clear))
            if links:
                blocks[stack[-1][1]].linked += len(clear.strip())

    def leave(to: int) -> None:
        nonlocal links
        links -= sum(name == "a" for name, _ in stack[to:])
        open_.subtract(name for name, _ in stack[to:])
        if any(name in BLOCKS for name, _ in stack[to:]):
            runs.append((stack[to - 1][1], ""))
        del stack[to:]

    while True:
        m = TOKEN.search(page, at)
        text(page[at : m.start()] if m else page[at:])
        if not m:
            return blocks, runs
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if not open_[name]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if name not in ("html", "body"):
                        leave(i)
                    break
                if stack[i][0] in ("td", "th", "table") and name not in BLOCKS:
                    break
            continue
        if name == "br":
            runs.append((stack[-1][1], " "))
            continue
        if name in ENDS_P and open_["p"]:
            close(stack, {"p"}, P_STOPS, leave)
        if name in ENDS:
            close(stack, *ENDS[name], leave)
        block = stack[-1][1]
        if name in BLOCKS:
            block = len(blocks)
            found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m["rest"])} if m["rest"].strip() else {}
            names = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop"))
            blocks.append(Block(name, stack[-1][1], names.lower(), "data-content" in found))
            runs.append((block, ""))
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            tail = page.find(">", at)
            at = tail + 1 if end and tail >= 0 else len(page)
            continue
        if name not in VOID and not (m["rest"].endswith("/") and name not in BLOCKS) and len(stack) < DEPTH:
            stack.append((name, block))
            open_[name] += 1
            links += name == "a"


def close(stack, names, stops, leave) -> None:
    """Leave the innermost open element of these names, unless a stop lies before it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in names:
            leave(i)
            if not any(s[0] in names for s in stack):
                return
        elif stack[i][0] in stops:
            return


def block_texts(runs: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Texts between block boundaries, white space made single spaces; empty ones left out."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    current = -1

    def flush() -> None:
        joined = SPACES.sub(" ", "".join(parts)).strip()
        if joined:
            out.append((current, joined))
        parts.clear()

    for block, raw in runs:
        if not raw or block != current:
            flush()
            current = block
        parts.append(raw)
    flush()
    return out
