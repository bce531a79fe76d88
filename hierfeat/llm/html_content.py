"""Main text of web pages by a tree-structured graphical model.

Every block of a page is a node that is content or not. Node potentials come from what a block
looks like, edge potentials from the states of parent and child. One sum-product pass from the
leaves up and one from the root down give each block its marginal; text of blocks that are more
likely content than not is kept. Potentials are counted on labelled pages.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hierfeat.llm.html_tree import HIDDEN, Block, block_texts, parse
from hierfeat.llm.shared import made_once
from hierfeat.llm.words import pieces

#: Pages of the table that the potentials are learned from, at most, by hash of the id.
TAUGHT = 2_000
#: Names in class, id and role attributes are hashed into so many features.
NAME_BUCKETS = 512
SMOOTHING = 0.5
#: Features of a block overlap, so each counts for a part of its evidence only.
SHARE = 0.5
#: No single feature speaks louder than this (log odds).
LOUDEST = 3.0

# Words in class, id and role attributes of web pages.
BOILER_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline-share comment comments consent cookie"
    " cookies copyright disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter"
    " notice pagination paywall popup promo promotion recommended related reply replies respond share sharing sidebar signup"
    " skip social sponsor sponsored subscribe subscription tags toolbar topbar widget contentinfo complementary search".split()
)
CONTENT_NAMES = frozenset(
    "article articlebody body-text content entry entry-content main main-content post post-body post-content story story-body text"
    " blogposting newsarticle".split()
)
BOILER_TAGS = frozenset("aside footer menu dialog".split()) | HIDDEN
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names that begin so tell of a page's parts or subjects, not of the block: has-sidebar, category-social.
ABOUT = frozenset("has no with without not category tag".split())

# Labelled pages of common layouts: blocks with data-content are content, with all in them that is not boilerplate.
PROSE = "The council met on Tuesday, and after a long debate it agreed on the plan. Work is to begin in spring, the mayor said."
EXAMPLES = tuple(
    layout.replace("[prose]", PROSE)
    for layout in (
        "<html><head><title>x</title></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>News</a></li><li>"
        "<a href=/b>Sport</a></li></ul></nav><main data-content><h1>Plan agreed</h1><p>[prose]</p><p>[prose]</p><blockquote>"
        "[prose]</blockquote><ul><li>[prose]</li></ul></main><aside><h2>Related</h2><p>[prose]</p></aside><footer><p>Copyright"
        " 2024</p></footer></body></html>",
        "<body><div id=header><div class=logo><a href=/>Site</a></div></div><div class=menu><a href=/a>One</a> <a href=/b>Two"
        "</a></div><div id=content data-content><h2>Plan agreed</h2><div><p>[prose]</p><p>[prose]</p></div><div class=share>"
        "<a href=/s>Share</a></div><p>[prose]</p></div><div id=sidebar><div class=widget><p>[prose]</p></div></div><div"
        " id=footer>All rights reserved</div></body>",
        "<body><div class=cookie-notice><p>We use cookies to improve this page. [prose]</p><button>OK</button></div><div"
        " class=wrapper><div class=post data-content><header><h1>Plan agreed</h1></header><p>[prose]</p><table><tr><td>"
        "Spring</td><td>Begin</td></tr></table><p>[prose]</p></div><div id=comments class=comments><h3>2 comments</h3><div"
        " class=comment><p>[prose]</p></div><div class=comment><p>[prose]</p></div><form><p>Leave a reply</p></form></div>"
        "</div></body>",
        "<body><article data-content><h1>Plan agreed</h1><div class=ad>Buy now! [prose]</div><p>[prose]</p><p>[prose]</p>"
        "<section><h2>Next</h2><p>[prose]</p></section><section class=comments><p>[prose]</p></section></article><div class=promo>"
        "<p>[prose]</p></div><footer>About us</footer></body>",
        "<body><table><tr><td class=navigation><a href=/a>Home</a><a href=/b>Archive</a></td><td class=text data-content>"
        "<p>[prose]</p><p>[prose]</p></td></tr></table></body>",
    )
)


def name_kinds(block: Block, boiler: frozenset[str] = BOILER_NAMES) -> tuple[bool, bool, list[str]]:
    words = block.names.split()
    parts = {p for w in words for p in (w, *re.split(r"[-_]", w))}
    return bool(parts & boiler), bool(parts & CONTENT_NAMES), words


def closed(block: Block) -> bool:
    """Whether a block says of itself that it is boilerplate, by its tag or a name.

    Names of a whole page often list its parts, and the header of an article belongs to it. A content
    name wins over a single bad part, an article tag over one inside a longer name. What holds here
    is not content yet: the messages decide. Forms are judged in ``shut_off``, by what they hold.
    """
    if block.tag in BOILER_TAGS and block.tag != "form":
        return True
    if not block.names or block.tag in ("#page", "html", "body", "main"):
        return False
    words = block.names.split()
    told = [re.split(r"[-_]", w) for w in words]
    bad = {p for w, parts in zip(words, told) if parts[0] not in ABOUT for p in (w, *parts)} & BOILER_NAMES
    if CONTENT_NAMES.intersection(words):
        return len(bad) > 1
    if block.tag == "article":
        return len(bad) > 1 or not bad.isdisjoint(words)
    return bool(bad) and not (name_kinds(block)[1] and bad == {"header"})


def features(blocks: list[Block], own: list[int], linked: list[int], marks: list[int]) -> list[list[str]]:
    """What a block looks like: its tag, its names, the size and kind of its own text."""
    out = []
    for i, b in enumerate(blocks):
        bad, good, words = name_kinds(b) if b.names else (False, False, [])
        size = min(int(math.log2(own[i] + 1)), 9)
        share = linked[i] / own[i] if own[i] else 0
        found = [
            f"tag {b.tag}",
            f"own {size} {min(int(4 * share), 3)}",
            f"marks {size > 0} {min(marks[i], 3)}",
            f"known {bad} {good}",
        ]
        found += [f"name {zlib.crc32(w.encode('utf-8', 'surrogatepass')) % NAME_BUCKETS}" for w in words]
        out.append(found)
    return out


def described(page: str) -> tuple[list[Block], list[tuple[int, str]], list[list[str]]]:
    blocks, runs = parse(page)
    texts = block_texts(runs)
    marks = [0] * len(blocks)
    for i, text in texts:
        blocks[i].own += len(text)
        marks[i] += sum(map(text.count, ",.;:!?"))
    return blocks, texts, features(blocks, [b.own for b in blocks], [b.linked for b in blocks], marks)


def labels(blocks: list[Block]) -> list[int]:
    """States of the blocks of a labelled page: what is in a content block, but not boilerplate."""
    state, shut = [0] * len(blocks), shut_off(blocks)
    for i, b in enumerate(blocks[1:], 1):
        if shut[i]:
            state[i] = 0
        elif b.marked or b.tag in CONTENT_TAGS:
            state[i] = 1
        else:
            state[i] = state[b.parent]
    return state


def shut_off(blocks: list[Block]) -> list[bool]:
    """Blocks that are boilerplate by their own word or that of a block around them.

    A name never shuts what holds an article, a main element, a content name or a main heading and half of the page's
    text: such a block is the wrapper of the page. Where names would leave nothing but headings and links, they shut
    nothing. What is not shut by its name here still has it as a feature, and the messages decide. A form is
    shut unless it holds one of these: some pages are one form.
    """
    by_tag = [b.tag in BOILER_TAGS and b.tag != "form" for b in blocks]
    shut, full = [closed(b) for b in blocks], [False] * len(blocks)
    by_tag[:1], shut[:1] = [False], [False]
    size = [b.own for b in blocks]
    for i in range(len(blocks) - 1, 0, -1):
        size[blocks[i].parent] += size[i]
    for i in range(len(blocks) - 1, 0, -1):
        b = blocks[i]
        if full[i] and not by_tag[i] and 2 * size[i] >= size[0]:
            shut[i] = False
        own = b.tag in CONTENT_TAGS or b.tag == "h1" or b.marked or not CONTENT_NAMES.isdisjoint(b.names.split())
        if not shut[i] and (own or full[i]):
            full[b.parent] = True
    forms = [b.tag == "form" and not full[i] for i, b in enumerate(blocks)]

    def spread(own: list[bool]) -> list[bool]:
        found = [False] * len(blocks)
        for i, b in enumerate(blocks[1:], 1):
            found[i] = found[b.parent] or own[i] or forms[i]
        return found

    named, tagged = spread(shut), spread(by_tag)

    def paragraphs(off: list[bool]) -> bool:
        return any(b.own > b.linked and b.tag not in HEADINGS and not o for b, o in zip(blocks, off))

    return named if paragraphs(named) or not paragraphs(tagged) else tagged


def evidence(page: str) -> Counter:
    """Counts of features by state and of state pairs of parent and child; none without a labelled block."""
    blocks, _, found = described(page)
    state = labels(blocks)
    counts: Counter = Counter()
    if not any(state):
        return counts
    for b, s, names, off in zip(blocks, state, found, shut_off(blocks)):
        if off:
            continue
        counts[f"state {s}"] += 1
        counts.update(f"{name}|{s}" for name in names)
        if b.parent >= 0:
            counts[f"edge {state[b.parent]} {s}"] += 1
    return counts


class TreeModel:
    """Potentials and inference."""

    def __init__(self, counts: dict[str, float]):
        total = [counts.get("state 0", 0) + SMOOTHING, counts.get("state 1", 0) + SMOOTHING]
        names = {k.rpartition("|")[0] for k in counts if "|" in k}
        self.node = {}
        for n in names:
            one = (counts.get(f"{n}|1", 0) + SMOOTHING) / (total[1] + 2 * SMOOTHING)
            zero = (counts.get(f"{n}|0", 0) + SMOOTHING) / (total[0] + 2 * SMOOTHING)
            self.node[n] = SHARE * max(-LOUDEST, min(LOUDEST, math.log(one) - math.log(zero)))
        self.edge = []
        for parent in (0, 1):
            pair = [counts.get(f"edge {parent} {child}", 0) + SMOOTHING for child in (0, 1)]
            self.edge.append([x / sum(pair) for x in pair])

    def marginals(self, blocks: list[Block], found: list[list[str]]) -> list[float]:
        """Probability of content for each block, by messages up and then down the tree.

        Blocks that are boilerplate by their own word are known and say nothing about the others.
        """
        n, (e0, e1), shut = len(blocks), self.edge, shut_off(blocks)
        belief = []
        for names in found:
            odds = sum(self.node.get(x, 0.0) for x in names)
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
            belief.append((1 - p, p))
        # Upward: what each subtree says about its root, and about the parent of it.
        message = [(0.5, 0.5)] * n
        for i in range(n - 1, 0, -1):
            if shut[i]:
                continue
            c0, c1 = belief[i]
            up0, up1 = e0[0] * c0 + e0[1] * c1, e1[0] * c0 + e1[1] * c1
            message[i] = up0, up1 = up0 / (up0 + up1), up1 / (up0 + up1)
            p0, p1 = belief[blocks[i].parent]
            p0, p1 = max(p0 * up0, 1e-200), max(p1 * up1, 1e-200)
            belief[blocks[i].parent] = (p0 / (p0 + p1), p1 / (p0 + p1))
        # Downward: what all the rest says about each block.
        for i in range(1, n):
            if shut[i]:
                belief[i] = (1.0, 0.0)
                continue
            p0, p1 = belief[blocks[i].parent]
            q0, q1 = p0 / message[i][0], p1 / message[i][1]
            down0, down1 = q0 * e0[0] + q1 * e1[0], q0 * e0[1] + q1 * e1[1]
            b0, b1 = max(belief[i][0] * down0, 1e-200), max(belief[i][1] * down1, 1e-200)
            belief[i] = (b0 / (b0 + b1), b1 / (b0 + b1))
        return [b[1] for b in belief]

    def main_text(self, page: str) -> str:
        blocks, texts, found = described(page)
        likely = self.marginals(blocks, found)
        return "\n".join(text for i, text in texts if likely[i] > 0.5)


def fit(pages: DataFrame, key: str = "page_id", html: str = "html") -> dict[str, float]:
    """Count the evidence of labelled pages: the examples, and pages that mark their article.

    A page is labelled by its own ``article`` or ``main`` element. At most ``TAUGHT`` pages, by hash of
    the key, are read. The counts are of a bounded number of features.
    """
    chosen = pages.select(F.col(key).alias("_key")).filter("_key IS NOT NULL").distinct()
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key").limit(TAUGHT)
    some = pages.join(F.broadcast(chosen), F.col(key) == F.col("_key"), "left_semi").select(F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                counts.update(evidence(page or ""))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["name", "n"]
        )

    found = some.mapInArrow(run, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n")).collect()
    return with_examples({r["name"]: r["n"] for r in found})


def with_examples(counts: dict[str, float]) -> dict[str, float]:
    """Add the examples, weighted to count as much as all pages of the table."""
    taught: Counter = Counter()
    for page in EXAMPLES:
        taught.update(evidence(page))

    def blocks(c: dict[str, float]) -> float:
        return c.get("state 0", 0) + c.get("state 1", 0)

    weight = max(5.0, blocks(counts) / blocks(taught))
    return {k: counts.get(k, 0) + weight * taught.get(k, 0) for k in {*counts, *taught}}


def text_column(counts: dict[str, float], html: Column, spark: SparkSession) -> Column:
    shipped = spark.sparkContext.broadcast((counts,))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = made_once(shipped, TreeModel)
        for batch in batches:
            yield pa.array([own.main_text(page) for piece in pieces(batch) for page in piece.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(html)


def main_texts(
    pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",), counts: dict | None = None
) -> DataFrame:
    """The main text of every page, from its whole markup.

    One row per row of ``pages``: the key, the columns of ``keep``, ``text`` and ``n_chars``. Character
    references are decoded, white space inside a block becomes one space, blocks are joined by one
    line feed in page order. A null or empty page, and one without content, has an empty text. Rows
    that repeat come out as often as they go in; an empty table gives an empty one.
    """
    model = counts if counts is not None else fit(pages, key, html)
    found = pages.select(key, *keep, text_column(model, F.col(html), pages.sparkSession).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
