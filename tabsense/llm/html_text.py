"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks.  Each block is described by its word count and link density
and those of the blocks before and after it, and by where it stands (inside the article, inside a page
part that isn't the article, inside something named like an advert or a comment).  A decision tree,
trained on a small labelled table of blocks, tells main text from the rest.

The labelled table has two parts: a few page layouts whose tags and names tell the parts of a page, with
block lengths set by a rule (``LABELLED_LENGTHS`` for each), and drawn pages, ``LABELLED_PAGES`` of them
with such tags and as many of bare ``div`` elements without any telling tag or name, where only the word
counts and link densities of a block and its neighbours (and headings and list items) tell main text.  The tree is small and goes to the
tasks by value; pages are read, cut and classified in one pass without a shuffle.

Defined cases: a null or empty page has an empty text; repeated pages give equal texts; an empty table
gives no rows; pages of any length are read whole; broken markup is read leniently (an unclosed element
ends with its parent, an unclosed comment or script with the page); other columns pass through untouched,
but a column named like the result is replaced by it.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, types as T

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "in_article", "page_has_article", "in_other_part", "named_other", "heading", "list_item")
#: Word counts of the labelled blocks, number of drawn pages of either kind, and the depth of the tree.
LABELLED_LENGTHS, LABELLED_PAGES, TREE_DEPTH = (1, 2, 4, 7, 12, 20, 35, 60, 110, 250), 240, 10

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(?P<raw>script|style|noscript|template|title|svg|iframe|object|select|textarea|button|canvas|math|video|audio)"""
    r"""\b(?:[^"'<>]|"[^"]*"|'[^']*')*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-z][\w:-]*)(?P<attrs>(?:[^"'<>]|"[^"<]*"|'[^'<]*')*)>"""
    r"""|<[!?/a-z][^<>]*(?:>|\Z)""", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed words: elements that bound blocks, page parts beside the article, and names of such parts.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
OTHER_PARTS = frozenset("aside dialog footer form header menu nav".split())
ARTICLE_PARTS = frozenset(("article", "main"))
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment "
    "comments complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus footer "
    "gdpr hidden login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pagination "
    "popup promo promoted promotion recommended related replies reply respond responses search share sharing sidebar "
    "sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: tuple[int, int, int, int, int]  # in_article, in_other_part, named_other, heading, list_item
    marked: bool = False


def _named_other(attrs: str) -> bool:
    for m in _ATTR.finditer(attrs):
        if m[1].lower() == "hidden":
            return True
        value = m[2] or m[3] or m[4] or ""
        if any(w.lower() in OTHER_NAMES for w in _NAME.findall(value)):
            return True
    return False


def text_blocks(page: str, marker: str | None = None) -> list[Block]:
    """The page's text blocks in order; blocks inside an element with attribute ``marker`` are marked."""
    blocks: list[Block] = []
    pieces: list[str] = []
    linked_pieces: list[str] = []
    opened: list[tuple[str, tuple[int, int, int, int, int], bool]] = [("", (0, 0, 0, 0, 0), False)]
    in_link = 0

    def flush() -> None:
        if not pieces:
            return
        words = "".join(pieces).split()
        if words:
            linked = sum(len(p.split()) for p in linked_pieces)
            blocks.append(Block(" ".join(words), len(words), min(linked, len(words)), opened[-1][1], opened[-1][2]))
        pieces.clear()
        linked_pieces.clear()

    def say(raw: str) -> None:
        if raw:
            piece = html.unescape(raw) if "&" in raw else raw
            pieces.append(piece)
            if in_link:
                linked_pieces.append(piece)

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if m["end"] else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            if m["end"]:
                for k in range(len(opened) - 1, 0, -1):
                    if opened[k][0] == tag:
                        del opened[k:]
                        in_link = 0
                        break
            elif tag not in _VOID:
                if tag in ("p", "li") and opened[-1][0] == tag:  # these close themselves
                    opened.pop()
                (article, other, named, _, item), mark = opened[-1][1], opened[-1][2]
                if tag in ARTICLE_PARTS:
                    article = 1
                if tag in OTHER_PARTS and not (tag == "header" and article):
                    other = 1
                attrs = m["attrs"]
                if attrs and not attrs.isspace():
                    if tag not in ("html", "body", "main") and _named_other(attrs):
                        named = 1
                    mark = mark or (marker is not None and marker in attrs)
                heading = int(len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
                opened.append((tag, (article, other, named, heading, int(item or tag == "li")), mark))
    say(page[at:])
    flush()
    return blocks


def block_features(blocks: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` for each block of a page."""
    words = np.array([b.words for b in blocks], np.float64)
    density = np.array([b.linked / b.words for b in blocks])
    place = np.array([b.place for b in blocks], np.float64)
    before, after = np.r_[0.0, words[:-1]], np.r_[words[1:], 0.0]
    return np.column_stack([words, density, before, np.r_[0.0, density[:-1]], after, np.r_[density[1:], 0.0], place[:, 0],
                            np.full(len(blocks), place[:, 0].max()), place[:, 1], place[:, 2], place[:, 3], place[:, 4]])


#: Layouts of labelled pages: {n} stands for n words, [n] for n linked words; main text is marked.
_LAYOUTS = (
    '<nav><ul><li>[1]</li><li>[2]</li><li>[{a}]</li></ul></nav><div class="ad">{{a}}</div><article data-main><h1>{{b}}</h1>'
    '<p>{{a}}</p><p>{{b}}</p><p>{{c}}</p></article><footer>{{b}}</footer>',
    '<header><p>{{a}}</p><a>[2]</a></header><main><div data-main><h2>{{a}}</h2><p>{{b}}</p><ul><li>{{c}}</li><li>{{a}}</li></ul>'
    '<p>{{a}} [{b}]</p></div></main><aside><h3>{{a}}</h3><p>{{b}}</p><p>[{a}]</p></aside><footer><p>{{c}}</p></footer>',
    '<div id="menu"><p>[2]</p><p>[{a}]</p></div><div class="cookie-notice"><p>{{b}}</p></div><article><header data-main><h1>{{a}}</h1>'
    '</header><section data-main><p>{{c}}</p><blockquote>{{a}}</blockquote></section><section class="comments"><h3>{{a}}</h3>'
    '<p>{{b}}</p><p>{{c}}</p></section></article><form><p>{{a}}</p><p>{{b}}</p></form>',
    '<article data-main><p>{{a}}</p><p>{{b}}</p><table><tr><td>{{c}}</td><td>{{a}}</td></tr></table></article>'
    '<article class="comment"><p>{{b}}</p></article><section id="related"><p>[{a}]</p><p>{{c}}</p></section><p>{{a}}</p><p>[{b}]</p>',
    '<p>[3]</p><p>[{a}]</p><div data-main><p>{{d}}</p><p>{{d}} [2]</p><p>{{e}}</p><p>{{d}} [3]</p></div><p>{3} [1]</p><p>[4]</p>'
    '<p>{4}</p>',
    '<article data-main><p>{{a}}</p></article><article><aside><p>{{c}}</p></aside><div class="ads"><p>{{b}}</p></div>'
    '<footer><p>{{a}}</p></footer></article><dialog><p>{{b}}</p></dialog><div><p>{{c}}</p><p>[{a}]</p></div>',
)


def drawn_page(rng: random.Random, tagged: bool = False) -> str:
    """Menu, notice, main text (marked), further links, form and footer, in drawn lengths.

    The parts are bare ``div`` elements or, if ``tagged``, named by their tags; then no length tells them apart.
    """
    def said(low: int, high: int) -> str:
        return "word " * rng.randint(low, high)

    def linked(low: int, high: int) -> str:
        return "<a href='/'>" + "link " * rng.randint(low, high) + "</a>"

    def paragraph() -> str:
        size = rng.choice(((1, 12), (8, 40), (20, 60), (30, 100), (60, 250)))
        return said(*size) + (linked(1, 3) + said(3, 15) if rng.random() < 0.1 else "")

    item = rng.choice(("li", "div", "p"))
    top = "".join(f"<{item}>{linked(1, 4)}</{item}>" for _ in range(rng.randint(0, 9)))
    if rng.random() < 0.6:
        top += f"<div>{said(3, 16)}</div>"
    main = f"<h1>{said(3, 14)}</h1>" if rng.random() < 0.8 else ""
    for k in range(rng.randint(3, 22)):
        kind = rng.random()
        if kind < 0.06 and k:
            main += f"<h2>{said(2, 8)}</h2>"
        elif kind < 0.12:
            main += "<ul>" + "".join(f"<li>{said(3, 30)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        main += f"<p>{paragraph()}</p>"
    end = ""
    if rng.random() < 0.5:
        end += "".join(f"<{item}>{linked(2, 12)}</{item}>" for _ in range(rng.randint(2, 8)))
    if rng.random() < 0.3:
        end += "".join(f"<div>{said(1, 3)}</div>" for _ in range(rng.randint(2, 4)))
    if rng.random() < 0.8:
        end += f"<div>{said(3, 16)}{linked(1, 4) if rng.random() < 0.5 else ''}</div>"
    if not tagged:
        return f"<div>{top}</div><div data-main>{main}</div><div>{end}</div>"
    short = "".join(f"<p>{said(1, 6)}</p>" for _ in range(rng.randint(0, 6)))
    long = "".join(f"<p>{paragraph()}</p>" for _ in range(rng.randint(0, 6)))
    menu, part = rng.choice(("nav", "header")), rng.choice(("article", "main"))
    beside = rng.choice(("<aside>", "<form>", "<div class='ad'>", "<div class='comments'>", "<div>"))
    return (f"<{menu}>{top}</{menu}><div>{long if rng.random() < 0.3 else ''}</div><{part} data-main>{main}{short}</{part}>"
            f"{beside}{long}</{re.match('<(\\w+)', beside)[1]}><footer>{end}</footer>")


def labelled_blocks(pages: int = LABELLED_PAGES, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features of blocks, and 1 for main text."""
    lengths = LABELLED_LENGTHS
    drawn = []
    for layout in _LAYOUTS:
        for k in range(len(lengths)):
            size = {"a": lengths[k], "b": lengths[(3 * k + 1) % len(lengths)], "c": lengths[(7 * k + 2) % len(lengths)],
                    "d": lengths[5 + k % 5], "e": lengths[4 + k % 6]}
            page = layout
            for name, n in size.items():
                page = page.replace("{{" + name + "}}", "{" + str(n) + "}").replace("{" + name + "}", str(n))
            page = re.sub(r"\[(\d+)\]", lambda m: "<a href='/'>" + "link " * int(m[1]) + "</a>", page)
            drawn.append(re.sub(r"\{(\d+)\}", lambda m: "word " * int(m[1]), page))
    rng = random.Random(seed)
    drawn += [drawn_page(rng, tagged) for _ in range(pages) for tagged in (False, True)]
    cut = [text_blocks(page, "data-main") for page in drawn]
    return np.concatenate([block_features(c) for c in cut]), np.array([float(b.marked) for c in cut for b in c])


@dataclass
class Tree:
    """A decision tree in arrays: split feature and threshold, children, and the leaf's verdict."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    verdict: np.ndarray

    def keeps(self, features: np.ndarray) -> np.ndarray:
        at = np.zeros(len(features), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.verdict[at]
            node = at[inner]
            right = features[inner, self.feature[node]] > self.threshold[node]
            at[inner] = self.child[node, right.astype(np.int64)]


def train_tree(spark: SparkSession, depth: int = TREE_DEPTH) -> Tree:
    """Fit the tree on the labelled table."""
    x, y = labelled_blocks()
    table = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)],
                                  ", ".join(f"{f} double" for f in (*FEATURES, "label"))).coalesce(1)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(rows)
    nodes: list[tuple[int, float, int, int, bool]] = []

    def copy(node) -> int:
        here = len(nodes)
        nodes.append((-1, 0.0, 0, 0, node.prediction() > 0.5))
        if node.subtreeDepth() > 0:
            split = node.split()
            left, right = copy(node.leftChild()), copy(node.rightChild())
            nodes[here] = (split.featureIndex(), split.threshold(), left, right, False)
        return here

    copy(model._call_java("rootNode"))
    return Tree(np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes]),
                np.array([n[2:4] for n in nodes]), np.array([n[4] for n in nodes]))


def main_text(page: str, tree: Tree) -> str:
    blocks = text_blocks(page)
    if not blocks:
        return ""
    return "\n".join(b.text for b, kept in zip(blocks, tree.keeps(block_features(blocks))) if kept)


def extract_text(pages: DataFrame, tree: Tree | None = None, source: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without the column ``source`` but with a column ``name``: the main text of each page."""
    tree = tree or train_tree(pages.sparkSession)
    place = pages.columns.index(source)
    keep = [k for k in range(len(pages.columns)) if k != place and pages.columns[k] != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) if p else "" for p in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())],
                                             [*(batch.schema.names[k] for k in keep), name])

    return pages.mapInArrow(run, T.StructType([*(pages.schema.fields[k] for k in keep), T.StructField(name, T.StringType())]))
