"""A small HTML parser: a page's elements as a tree, its texts as their leaves."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

#: Kinds of elements; fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul xmp".split())
#: Cells of a table of sums that is kept at once.
TABLE = 4_000_000
#: An element that opens closes those still open, up to the barrier.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)", re.S)
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([A-Za-z_:][-\w:.]*)")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAMED = re.compile("class|id|role|label|hidden|style", re.I)


class Node:
    """An element: tag, names (its id, class and role in lower case) and children, which are Nodes and strings."""

    __slots__ = ("tag", "names", "children", "parent", "hidden", "key", "shape", "count", "kids", "constant")

    def __init__(self, tag: str, names: str = "", parent: Node | None = None, hidden: bool = False):
        self.tag, self.names, self.children, self.parent, self.hidden = tag, names, [], parent, hidden
        self.key, self.shape, self.count, self.kids, self.constant = 0, 0, 1, [], 0

    def elements(self) -> list[Node]:
        return self.kids


def _tag_end(page: str, at: int, ended: dict[str, int]) -> int:
    """Past the `>` of a tag that goes on at `at`, outside of quotes; -1 if there is none. A quote that is never closed
    is a character like others; `ended` holds from where on a page has no more quotes of a kind."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        at = m.end()
        close = -1 if ended.get(m[0], at) < at else page.find(m[0], at)
        if close < 0:
            ended[m[0]] = min(ended.get(m[0], at), m.start())
        else:
            at = close + 1
    return -1


class _Open:
    """The open elements from the page down, and where those of each tag and all blocks stand among them."""

    def __init__(self, root: Node):
        self.path, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.path))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.path))
        self.path.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at a place and those within."""
        while len(self.path) > place:
            node = self.path.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()

    def outermost(self, tags: set[str], barrier: set[str]) -> int | None:
        """The place of the outermost element of `tags` within the innermost of `barrier`."""
        floor = max((x[-1] for t in barrier if (x := self.at.get(t))), default=0)
        found = [x[k] for t in tags if (x := self.at.get(t)) and (k := bisect_right(x, floor)) < len(x)]
        return min(found, default=None)


def parse(page: str) -> Node:
    """The tree of a page, in time linear in its length. Missing end tags are supplied as browsers do; raw elements keep no text.

    A node's key stands for all text below it, its shape for the elements: equal keys, equal texts.
    """
    root = Node("#page")
    every, held, ended = [root], _Open(root), {}
    at, size = 0, len(page)
    last = page.rfind(">")  # no tag ends beyond
    while at < size:
        node = held.path[-1]
        m = _TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        end = -1 if m is None else m.end() if m[2] is None else _tag_end(page, m.end(), ended)
        if end < 0:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = end
        tag = m[2]
        if tag is None:
            continue
        tag, rest = tag.lower(), page[m.end() : end - 1]
        if m[1]:
            if places := held.at.get(tag):
                held.cut(places[-1])
            elif tag == "p":
                node.children.append(Node("p", parent=node))
            continue
        if tag in BLOCKS and tag != "html" and tag != "body" and held.blocks and held.path[held.blocks[-1]].tag == "p":
            # A block ends an open paragraph, with the inline elements left open in it.
            held.cut(held.blocks[-1])
        if tag in CLOSES and (place := held.outermost(*CLOSES[tag])) is not None:
            held.cut(place)
        node = held.path[-1]
        names, hidden = "", False
        if rest and _NAMED.search(rest):
            for a in _ATTRIBUTE.finditer(rest):
                key = (a[1] or a[5]).lower()
                value = next((v for v in a.groups()[1:4] if v is not None), "")
                if key in ("class", "id", "role", "aria-label"):
                    names += " " + value.lower()
                elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    hidden = True
        if tag in RAW:
            close = _ENDS[tag].search(page, at)
            child = Node(tag, names, node, tag != "xmp")
            if tag == "xmp":  # shown as it stands
                child.children.append((page[at : close.start()] if close else page[at:]).replace("&", "&amp;"))
            at = close.end() if close else size
            node.children.append(child)
            every.append(child)
            continue
        child = Node(tag, names, node, hidden)
        node.children.append(child)
        every.append(child)
        if tag not in VOID and not rest.rstrip().endswith("/"):
            held.push(child)
    for x in reversed(every):  # children come after their parents
        x.kids = [c for c in x.children if isinstance(c, Node)]
        x.key = hash(tuple([c if isinstance(c, str) else c.key for c in x.children if isinstance(c, str) or not c.hidden]))
        x.shape, x.count = hash((x.tag, x.names, *[c.shape for c in x.kids])), 1 + sum([c.count for c in x.kids])
    return root


def tidy(text: str) -> str:
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def _best_rows(weights: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of the table of best sums: entry j of row i is that of xs[:i] and ys[:j]."""
    row = np.zeros(len(ys) + 1, "i8")
    yield row
    for x in xs:
        later = row.copy()
        np.maximum(row[1:], row[:-1] + weights[x][ys], out=later[1:])
        row = np.maximum.accumulate(later)
        yield row


def matched(weights: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (i, j), rising in both, of which the sum of weights[xs[i], ys[j]] is largest. Tables above TABLE cells are
    halved along xs until each part fits, which takes twice the time and keeps memory bounded."""
    n, m = len(xs), len(ys)
    if not n or not m:
        return []
    if n > 1 and n * m > TABLE:
        half = n // 2
        for head in _best_rows(weights, xs[:half], ys):
            pass
        for tail in _best_rows(weights, xs[half:][::-1], ys[::-1]):
            pass
        at = int(np.argmax(head + tail[::-1]))
        return matched(weights, xs[:half], ys[:at]) + [(i + half, j + at) for i, j in matched(weights, xs[half:], ys[at:])]
    best = np.stack(list(_best_rows(weights, xs, ys)))
    i, j, out = n, m, []
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(a: Node, b: Node) -> int:
    """Simple tree matching of two trees: the number of nodes matched. Each matched node of `a` whose whole text is
    that of its partner gets constant += 1.

    Children match in order, by dynamic programming over the sizes of their own matches. Pairs of one shape at the head
    of both lists match first: no other match of either is larger, so nothing is lost.
    """
    if a.tag != b.tag or a.names != b.names:
        return 0
    memo: dict = {}

    def size(x: Node, y: Node) -> int:
        if x.tag != y.tag or x.names != y.names:
            return 0
        if x.shape == y.shape:
            return x.count
        key = (x.shape, y.shape)
        if key not in memo:
            memo[key] = 1 + pair(x.elements(), y.elements())[0]
        return memo[key]

    def pair(xs: list[Node], ys: list[Node]) -> tuple[int, list]:
        k, out = 0, []
        total = 0
        while k < len(xs) and k < len(ys) and xs[k].shape == ys[k].shape:
            out.append((xs[k], ys[k]))
            total += xs[k].count
            k += 1
        tail, i, j = [], len(xs), len(ys)
        while i > k and j > k and xs[i - 1].shape == ys[j - 1].shape:
            i, j = i - 1, j - 1
            tail.append((xs[i], ys[j]))
            total += xs[i].count
        out += tail[::-1]
        xs, ys = xs[k:i], ys[k:j]
        if not xs or not ys:
            return total, out
        if len(xs) * len(ys) <= 64:  # the same table, without the cost of arrays
            n, m = len(xs), len(ys)
            best = [[0] * (m + 1)]
            for x in xs:
                up, row = best[-1], [0]
                for k, y in enumerate(ys):
                    row.append(max(up[k + 1], row[k], up[k] + size(x, y)))
                best.append(row)
            i, j, found = n, m, []
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((xs[i], ys[j]))
            return total + best[n][m], out + found[::-1]
        # Nodes of one shape weigh the same: one weight for each pair of shapes.
        left, right = {x.shape: x for x in xs}, {y.shape: y for y in ys}
        weights = np.array([[size(x, y) for y in right.values()] for x in left.values()], "i8")
        rows, columns = ({s: k for k, s in enumerate(side)} for side in (left, right))
        i, j = np.array([rows[x.shape] for x in xs]), np.array([columns[y.shape] for y in ys])
        found = matched(weights, i, j)
        return total + sum(int(weights[i[p], j[q]]) for p, q in found), out + [(xs[p], ys[q]) for p, q in found]

    total, stack = 0, [(a, b)]
    while stack:
        x, y = stack.pop()
        total += 1
        if x.key == y.key:
            x.constant += 1
        stack.extend(pair(x.elements(), y.elements())[1])
    return total
