import html
import itertools
import re
from collections import Counter

import pytest

from hierfeat.llm import html_content as H
from hierfeat.llm.html_tree import block_texts, parse

PAGES = "/root/testdata/sf0.01/pages.parquet"


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(PAGES)
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    found = H.main_texts(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    for r in found.collect():
        article = source[r["page_id"]].split("<article>")[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


LAYOUTS = {
    '<html><body><div class="top-header"><a href="/">Home</a></div><div class="container"><div class="main-column"><h1>A title</h1>'
    "<p>First paragraph of the story, with a <a href=x>link</a> in it.</p><div class='newsletter-signup'><p>Subscribe, it is free.</p>"
    "</div><ul><li>Item one of the list.</li><li>Item two</li></ul></div><div class='right-sidebar'><a href=a>Story</a><p>A teaser,"
    " fairly long, that goes on.</p></div></div><div class='reader-comments'><p>I think this is a great article, thanks.</p></div>"
    "<div class='site-footer'>Copyright</div></body></html>": "A title\nFirst paragraph of the story, with a link in it.\nItem one of"
    " the list.\nItem two",
    "<article><header><h1>Title</h1></header><p>Para one is here.</p><aside>pull</aside><form><input><p>Sign up</p></form><p>Para"
    " two.<script>x('<p>no</p>')</script></p><section id=comments><article class=comment><p>Nice read, really.</p></article>"
    "</section><footer>By X</footer></article>": "Title\nPara one is here.\nPara two.",
    "<p>Just a paragraph, nothing else, but with text.<p>And another one &amp; also   text.": "Just a paragraph, nothing else, but"
    " with text.\nAnd another one & also text.",
    "<html><body class='has-sidebar'><nav>a</nav><main><h1>T</h1><p>x<br>y</p><div class=comments-area><div><p>Long comment text,"
    " with words, and more words.</p></div></div></main></body></html>": "T\nx y",
    "": "",
    "<div><nav>only a menu</nav></div>": "",
}


@pytest.mark.parametrize("taught", [False, True])
@pytest.mark.parametrize("page", LAYOUTS)
def test_other_layouts(spark, page, taught):
    counts = taught_counts(spark) if taught else H.with_examples({})
    assert H.TreeModel(counts).main_text(page) == LAYOUTS[page]


def taught_counts(spark, kept={}):  # noqa: B006
    if not kept:
        kept["counts"] = H.fit(spark.read.parquet(PAGES))
    return kept["counts"]


def test_messages_give_the_exact_marginals():
    model = H.TreeModel(H.with_examples({}))
    page = "<div><p>One, two.</p><section><p>Three.</p><ul><li>x</li></ul></section></div>"
    blocks, _, found = H.described(page)
    node = [sum(model.node.get(x, 0.0) for x in names) for names in found]
    weights = Counter()
    for states in itertools.product((0, 1), repeat=len(blocks)):
        p = 1.0
        for i, (b, s) in enumerate(zip(blocks, states)):
            p *= 2.718281828459045 ** (node[i] * s)
            if b.parent >= 0:
                p *= model.edge[states[b.parent]][s]
        for i, s in enumerate(states):
            weights[i, s] += p
    for i, likely in enumerate(model.marginals(blocks, found)):
        assert likely == pytest.approx(weights[i, 1] / (weights[i, 0] + weights[i, 1]))


def test_broken_and_deep_pages():
    deep = "<div>" * 20_000 + "<p>in, deep.</p>" + "</div>" * 20_000
    assert [t for _, t in block_texts(parse(deep)[1])] == ["in, deep."]
    odd = "<p title='a>b'>x</p><p title='unclosed>y</p><!-- no end <p>z"
    assert [t for _, t in block_texts(parse(odd)[1])] == ["x", "y"]
    for page in ("<" * 50_000, "<a " * 50_000, "<!--" * 20_000, "<p '" * 20_000, "</div>" * 50_000):
        parse(page)


def test_awkward_table(spark):
    rows = [(1, "u", None, 3), (1, "u", None, 3), (2, None, "<p>Text, more &lt;b&gt; text.</p>", 4), (None, "v", "", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    found = H.main_texts(df).collect()
    assert Counter(map(tuple, found)) == Counter(
        [(1, "u", "", 0), (1, "u", "", 0), (2, None, "Text, more <b> text.", 20), (None, "v", "", 0)]
    )
    assert H.main_texts(df.limit(0)).count() == 0


STORY = "<h1>A title</h1><p>The council met on Tuesday, and after a long debate it agreed.</p><p>Work begins in spring, it said.</p>"


@pytest.mark.parametrize("taught", [False, True])
@pytest.mark.parametrize(
    "page",
    [
        '<body><div class="content has-sidebar">[]</div><div class=sidebar><p>A teaser, fairly long.</p></div></body>',
        '<body><div class="main-content no-sidebar">[]</div></body>',
        '<body><article class="post category-social tag-search">[]</article><form><p>Sign up, it is free.</p></form></body>',
        '<body><form id=aspnetForm><div class=menu><a href=a>x</a></div><div id=content>[]</div></form></body>',
        "<body><form id=f>[]</form></body>",
        '<body><div class="page sidebar-right"><article>[]</article><div class=sidebar><p>A teaser, fairly long.</p></div></div></body>',
        '<body><div class="search-page"><main>[]</main></div></body>',
        '<body><div class="site ad-enabled"><nav><a href=a>x</a></nav><div class="entry-content">[]</div></div></body>',
        '<body><div class="form-group"><div class="content">[]</div></div></body>',
        '<body><div class="story-tags-box"><article>[]</article></div></body>',
        '<body><div class="wrapper menu-open"><div class="ad-free notice-on"><article>[]</article></div></div><footer>Us</footer></body>',
    ],
)
def test_a_bad_part_of_a_name_does_not_lose_the_article(spark, page, taught):
    counts = taught_counts(spark) if taught else H.with_examples({})
    want = "A title\nThe council met on Tuesday, and after a long debate it agreed.\nWork begins in spring, it said."
    assert H.TreeModel(counts).main_text(page.replace("[]", STORY)) == want


@pytest.mark.parametrize("taught", [False, True])
def test_names_never_take_the_last_paragraph(spark, taught):
    model = H.TreeModel(taught_counts(spark) if taught else H.with_examples({}))
    notice = STORY.replace("</h1>", "</h1><section class=notice>", 1) + "</section>"
    assert model.main_text(f"<body><nav>a</nav><main>{notice}</main></body>") == "\n".join(
        ["A title", "The council met on Tuesday, and after a long debate it agreed.", "Work begins in spring, it said."]
    )
    # Beside other paragraphs a notice is one, and so are teasers that are articles in a sidebar.
    beside = STORY + "<section class=notice><p>We use cookies, and more of them than you may want.</p></section>"
    side = "<div class=sidebar><article><p>A teaser of another story, fairly long.</p></article></div>"
    assert model.main_text(f"<body><main>{beside}</main>{side}</body>").endswith("Work begins in spring, it said.")


@pytest.mark.parametrize("taught", [False, True])
def test_formulas_are_text(spark, taught):
    model = H.TreeModel(taught_counts(spark) if taught else H.with_examples({}))
    page = f"<article>{STORY}<p>The sum of both, <math><mi>a</mi><mo>+</mo><mi>b</mi></math>, is said to be larger than one.</p></article>"
    assert "a+b" in model.main_text(page).replace(" ", "").replace("\n", "")


def test_pages_of_the_table_without_the_article_element(spark):
    """Containers of any other name: the text must not hang on the element that marks it."""
    pages = spark.read.parquet(PAGES).limit(200).collect()
    model, right = H.TreeModel(taught_counts(spark)), 0
    for r in pages:
        want = model.main_text(r["html"])
        plain = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        right += model.main_text(plain) == want
    assert right >= 0.95 * len(pages)
