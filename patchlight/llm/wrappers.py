"""The template of a host's pages, learned by aligning their trees.

Two trees are aligned by simple tree matching: nodes match if their labels do, and of two matched nodes the children are matched in
order, so that as many nodes as possible correspond. A wrapper is the tree of all pages aligned so far; its nodes say on how many pages they were,
how much text they held, how much of it in links, and whether the text was always the same. Nodes that are the same on all pages, and those
whose part is that of a menu, a footer, an advert and so on, are template; those that vary are slots, and the slots of the page's main part are content.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

#: What is constant within the main part needs so many pages at least, as a chance of one in a thousand that a block on 70 % of pages is on all.
SURE_PAGES = 20
#: A region without an article or main part drops blocks with over this share of their text in links.
MOST_LINKED = 0.5
DROPPED = frozenset(("frame", "side", "notice", "ad", "comments", "hidden"))


@dataclass
class Node:
    """A node of a page's tree or of a wrapper, with sums over pages; ``low`` and ``high`` bound hashes of the text it held."""

    label: str
    part: str
    pages: int = 0
    chars: int = 0
    links: int = 0
    texts: int = 0
    low: int = 0
    high: int = 0
    children: list[Node] = field(default_factory=list)

    def add(self, other: Node) -> None:
        """Adds the other's sums, not its children."""
        if other.texts:
            self.low, self.high = (min(self.low, other.low), max(self.high, other.high)) if self.texts else (other.low, other.high)
        self.pages, self.chars, self.links, self.texts = self.pages + other.pages, self.chars + other.chars, self.links + other.links, self.texts + other.texts

    def walk(self) -> Iterator[Node]:
        """All nodes, each before its children."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))


def dumped(root: Node) -> str:
    """Nodes in the order of ``walk`` with the number of their children, so that no depth is too much."""
    return json.dumps([[n.label, n.part, n.pages, n.chars, n.links, n.texts, n.low, n.high, len(n.children)] for n in root.walk()], ensure_ascii=False)


def loaded(text: str) -> Node:
    rows = json.loads(text)
    root = Node(*rows[0][:8])
    open_ = [(root, rows[0][8])]
    for row in rows[1:]:
        while not open_[-1][1]:
            open_.pop()
        parent, left = open_.pop()
        open_.append((parent, left - 1))
        node = Node(*row[:8])
        parent.children.append(node)
        open_.append((node, row[8]))
    return root


def built(labels: list[str], parts: list[str], parents: list[int]) -> tuple[Node, list[Node]]:
    """A page's tree, and its nodes in the order given."""
    nodes = [Node(label, part) for label, part in zip(labels, parts, strict=True)]
    for node, parent in zip(nodes[1:], parents[1:], strict=True):
        nodes[parent].children.append(node)
    return nodes[0], nodes


def _same(a: Node, b: Node) -> bool:
    return a.label == b.label and a.part == b.part


def _table(a: list[Node], b: list[Node], seen: dict) -> list[list[int]]:
    """The most nodes that correspond between the first i of ``a`` and the first j of ``b``."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            best = max(row[j], last[j + 1])
            if _same(x, y):
                best = max(best, last[j] + matched(x, y, seen))
            row.append(best)
        rows.append(row)
    return rows


def matched(a: Node, b: Node, seen: dict) -> int:
    """Simple tree matching of two nodes of one label: how many of their nodes correspond."""
    key = id(a), id(b)
    if key not in seen:
        seen[key] = 1 + (_table(a.children, b.children, seen)[-1][-1] if a.children and b.children else 0)
    return seen[key]


def pairs(a: list[Node], b: list[Node], seen: dict) -> Iterator[tuple[Node | None, Node | None]]:
    """The alignment of two lists of siblings, in order; None where one has no counterpart."""
    if len(a) == len(b) and all(map(_same, a, b)):
        yield from zip(a, b, strict=True)
        return
    rows, i, j, out = _table(a, b, seen), len(a), len(b), []
    while i or j:
        if i and j and _same(a[i - 1], b[j - 1]) and rows[i][j] == rows[i - 1][j - 1] + matched(a[i - 1], b[j - 1], seen):
            out.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif j and (not i or rows[i][j] == rows[i][j - 1]):
            out.append((None, b[j - 1]))
            j -= 1
        else:
            out.append((a[i - 1], None))
            i -= 1
    yield from reversed(out)


def merge(wrapper: Node, other: Node) -> Node:
    """Aligns another tree with the wrapper, which takes its sums and the nodes that it lacks; none leaves it, so each page's tree stays within it."""
    seen: dict = {}
    stack = [(wrapper, other)]
    while stack:
        mine, theirs = stack.pop()
        mine.add(theirs)
        if not theirs.children:
            continue
        children = []
        for x, y in pairs(mine.children, theirs.children, seen):
            children.append(x or y)
            if x and y:
                stack.append((x, y))
        mine.children = children
    return wrapper


def aligned(wrapper: Node, tree: Node) -> dict[int, Node]:
    """For the nodes of a page's tree, by ``id``, those of the wrapper that correspond."""
    seen: dict = {}
    out, stack = {id(tree): wrapper}, [(wrapper, tree)]
    while stack:
        mine, theirs = stack.pop()
        for x, y in pairs(mine.children, theirs.children, seen) if theirs.children else ():
            if x and y:
                out[id(y)] = x
                stack.append((x, y))
    return out


def _below(root: Node) -> dict[int, tuple[int, int, bool, bool]]:
    """By ``id`` of each node: characters and linked ones in all under it, whether it holds a heading, and whether an article or main part."""
    out: dict[int, tuple[int, int, bool, bool]] = {}
    for node in reversed(list(root.walk())):
        under = [out[id(c)] for c in node.children]
        heading = node.label.split(".")[0].split("#")[0] in ("h1", "h2") or any(u[2] for u in under)
        out[id(node)] = node.chars + sum(u[0] for u in under), node.links + sum(u[1] for u in under), heading, node.part in ("main", "article") or any(u[3] for u in under)
    return out


def template(wrapper: Node, differ: bool) -> dict[int, bool]:
    """By ``id`` of a wrapper's node: whether it is template. ``differ`` says whether the wrapper has seen pages of different content."""
    below, out = _below(wrapper), {}
    whole = below[id(wrapper)][0]
    stack = [(wrapper, False, False)]
    while stack:
        node, dropped, within = stack.pop()
        chars, _, heading, holds = below[id(node)]
        if not dropped and node.part in DROPPED:
            # What holds the page's main part, or an article's own heading, is no frame, whatever its name is.
            spared = node.part != "hidden" and holds and 2 * chars > whole or node.part == "frame" and node.label.startswith(("header", "div")) and within and heading
            dropped = not spared
        if not dropped and differ and node.texts >= 2 and node.low == node.high and not node.children:
            small = 2 * node.chars < whole and not within
            dropped = small or node.texts >= SURE_PAGES
        out[id(node)] = dropped
        within = within or node.part in ("main", "article")
        stack.extend((c, dropped, within) for c in node.children)
    return out


def _above(node: Node, parent: dict[int, Node]) -> Iterator[Node]:
    while id(node) in parent:
        node = parent[id(node)]
        yield node


def content(wrapper: Node, is_template: dict[int, bool], tree: Node, nodes: list[Node]) -> list[bool]:
    """For each of a page's nodes whether its text is content: slots of the wrapper, which has all of them, within the page's main part."""
    of, below = aligned(wrapper, tree), _below(wrapper)
    parent = {id(c): n for n in nodes for c in n.children}
    dropped = {id(n): is_template[id(of[id(n)])] for n in nodes}
    open_ = [n for n in nodes if not dropped[id(n)]]

    def weight(n: Node) -> float:
        met = of[id(n)]
        return below[id(met)][0] / max(met.pages, 1)

    def inside(roots: list[Node]) -> set[int]:
        return {id(x) for r in roots for x in r.walk()}

    chosen: set[int] = set()
    for part in ("article", "main", "content"):
        of_part = [n for n in open_ if n.part == part]
        most = max(map(weight, of_part), default=0.0)
        if roots := [n for n in of_part if 4 * weight(n) >= most]:
            chosen = inside(roots)
            titles = [n for n in open_ if n.label.split(".")[0].split("#")[0] == "h1"]
            if part != "main" and not any(id(n) in chosen for n in titles):
                # The title may stand just before the article, in what holds both.
                above = {id(a) for r in roots for a in _above(r, parent)}
                chosen |= {id(n) for n in titles if id(parent[id(n)]) in above and (part == "content" or parent[id(n)].part == "main")}
            break
    else:
        menus = [n for n in open_ if parent.get(id(n)) is not None and n.label != "body" and below[id(of[id(n)])][1] > MOST_LINKED * below[id(of[id(n)])][0]]
        chosen = {id(n) for n in nodes} - inside(menus)
    return [id(n) in chosen and not dropped[id(n)] for n in nodes]
