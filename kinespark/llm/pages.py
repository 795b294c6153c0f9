"""HTML extraction by wrapper induction.

For each host up to PARTNERS pages with different contents are exemplars (those of the smallest content hashes). A
page's tree is aligned with each exemplar's by simple tree matching. Nodes whose text is the same in more than half of
the alignments are template; the others are slots, which vary. The content root is the page's `article` or `main`
element (the one with most slot text), or else the deepest element that holds most of the slot text. Below it,
navigation, footers, sidebars, forms, adverts, notices and reader comments are left out by element and role; a class or id
counts as a role if each of its words is the name of one or a word for a place or container (`comment-list`, but not
`share-price`). All other text below an `article` or `main` stays, whether constant or not. Where the root had to be
found, constant containers in it are template, too; constant paragraphs and headings among slots stay.

Exemplars that a copy of the page may be among can't turn its article into template: a block is template only in more
than half of at least two alignments. A page without partners keeps all blocks of its content root.

Defined results: a null or empty page gives an empty text; a null or odd url has the host ''; repeated rows each get
their result, and copies of a page are one exemplar; `br` is white space; of roots with equal slot text the outer one is
taken, of equal alignments one that leaves out the later node (ties); pages of any length and depth are read whole; an
empty table gives an empty result; other columns, of whatever names, are ignored.

Scale: the exemplars of a host are chosen among hashes of its distinct pages, and copies of one are combined within each
task before the exchange, so that a host with a third of all pages sends few texts; they are written, and pages meet them
by a join on the host that Spark can split. Aligning two lists of siblings costs their product in time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .dom import BLOCKS, Node, align, parse, tidy

PARTNERS = 5
#: Elements that aren't main text, names of such roles, and words for places and containers; fixed values.
DROPPED = frozenset("nav aside form button select option input footer dialog menu svg canvas audio video object embed head script style template iframe".split())
ROLES = frozenset("ad ads advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments respond disqus replies reply related recommended recommendations share sharing social toolbar pagination pager search skip contentinfo complementary".split())
PLACES = frozenset("site page main top bottom left right side upper lower inner outer header head body bar box block list item items area section container wrapper wrap content links link buttons button form posts post reader readers user users thread unit slot zone panel group row col column primary secondary global fixed sticky".split())
#: Blocks of running text.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption address".split())


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


_known: dict = {}


def _named_out(names: str) -> bool:
    if len(_known) > 10_000:
        _known.clear()
    if names not in _known:
        words = [[w.rstrip("0123456789") for w in name.replace("_", "-").split("-")] for name in names.split()]
        _known[names] = any(ROLES.intersection(w) and ROLES.union(PLACES, [""]).issuperset(w) for w in words)
    return _known[names]


def _left_out(node: Node, inside: bool) -> bool:
    if node.hidden or node.tag in DROPPED or node.tag == "header" and not inside:
        return True
    return bool(node.names) and _named_out(node.names)


def _constant(node: Node, partners: int) -> bool:
    return partners >= 2 and 2 * node.constant > partners


def _slots(node: Node, partners: int, sizes: dict) -> int:
    """The characters of slot text below each node that isn't left out."""
    total, constant = 0, _constant(node, partners)
    for child in node.children:
        if isinstance(child, str):
            total += 0 if constant else len(child.strip())
        elif not _left_out(child, False):
            total += _slots(child, partners, sizes)
    sizes[id(node)] = total
    return total


def _roots(page: Node, partners: int) -> tuple[list[Node], bool]:
    """The content roots, and whether the page itself names them: an article comes with those beside it that have slots."""
    sizes: dict = {}
    _slots(page, partners, sizes)
    best, stack = None, [page]
    while stack:
        x = stack.pop()
        for child in x.elements():
            if id(child) in sizes:
                stack.append(child)
                if (child.tag in ("article", "main") or "main" in child.names.split()) and (best is None or sizes[id(child)] > sizes[id(best)]):
                    best = child
    if best is not None and (sizes[id(best)] or best.children):
        beside = [c for c in best.parent.elements() if c.tag == "article" and (c is best or sizes.get(id(c)))]
        return (beside if best.tag == "article" else [best]), True
    node = page
    while True:
        most = max((c for c in node.elements() if c.tag in BLOCKS and id(c) in sizes), key=lambda c: sizes[id(c)], default=None)
        if most is None or most.tag in ("p", "li", "h1", "h2", "h3") or sizes[id(most)] <= 0.6 * sizes[id(node)]:
            return [node], False
        node = most


def _blocks(root: Node, named: bool, partners: int) -> list[str]:
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        if parts and (text := tidy("".join(parts))):
            out.append(text)
        parts.clear()

    # An explicit stack: real pages nest deeply.
    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            parts.append(x)
        elif x is not root and _left_out(x, True):
            parts.append(" ")
        elif x.tag == "br":
            parts.append(" ")
        elif x.tag in BLOCKS:
            if x is not root and not named and _constant(x, partners) and not (x.tag in FLOW and any(c.tag in FLOW and not _constant(c, partners) for c in x.parent.elements())):
                close()
                continue
            close()
            stack.append(None)
            stack.extend(reversed(x.children))
        else:
            stack.extend(reversed(x.children))
    close()
    return out


def extract(page: str | None, partners: list[Node] = ()) -> str:
    """The main text of a page, given its host's exemplars as trees."""
    if not page:
        return ""
    # Trees are walked by recursion, which real pages' nesting would exceed.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
    tree = parse(page)
    used = 0
    for partner in partners:
        if partner.key != tree.key:
            align(tree, partner)
            used += 1
    roots, named = _roots(tree, used)
    return "\n".join(x for root in roots for x in _blocks(root, named, used))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees: dict = {}
    for batch in batches:
        texts = []
        for page, others in zip(batch.column("html").to_pylist(), batch.column("_others").to_pylist()):
            if len(trees) > 256:
                trees.clear()
            for other in others or ():
                if other not in trees:
                    trees[other] = parse(other)
            texts.append(extract(page, [trees[x] for x in others or ()]))
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])


def exemplars(pages: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """(_host, _others): up to `partners` pages of different contents for each host."""
    df = pages.filter("html != ''").select(host(F.col("url")).alias("_host"), F.xxhash64("html").alias("_mark"), "html")
    marks = df.select("_host", "_mark").distinct()
    marks = marks.withColumn("_k", F.row_number().over(Window.partitionBy("_host").orderBy("_mark"))).filter(F.col("_k") <= partners)
    # Written first: Spark then knows its size when it plans the join.
    few = df.join(cut(marks.drop("_k"), "exemplar-marks"), ["_host", "_mark"], "left_semi")
    few = few.groupBy("_host", "_mark").agg(F.first("html").alias("html"))
    return few.groupBy("_host").agg(F.sort_array(F.collect_list("html")).alias("_others"))


def main_text(pages: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    left = pages.select("page_id", "url", "html", host(F.col("url")).alias("_host"))
    # Written first: a join of two plain shuffles is one that Spark can split where a host is large.
    both = left.join(cut(exemplars(pages, partners), "exemplars"), "_host", "left").select("page_id", "url", "html", "_others")
    return both.mapInArrow(_run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
