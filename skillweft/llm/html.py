"""Main text of web pages by wrapper induction.

Every page is parsed once, to a tree of its elements and to pieces of text in page order. The trees of a host's pages, with runs
of alike siblings folded, are aligned by simple tree matching and merged to one tree, the wrapper. A text that stands in a
wrapper node on most of the host's different pages is template. The texts of other nodes vary, and the wrapper decides
where they are content: it is followed down from its root as long as one container holds nearly all varying text. Tags and
class words are priors: they name what is no text of an article, and the marked article where there is one.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweft.llm.common import arrow_map, batch, runs, staged

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template title head nav footer aside form button select option textarea input iframe object embed svg canvas audio video dialog menu noframes noembed xmp map math datalist fieldset label legend".split())
CLOSES = {
    "p": frozenset({"p"}),
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}),
}
SCOPES = frozenset("ul ol dl table body html article main section div td th blockquote nav aside form header footer".split())
#: Elements that only hold others; content may be sought inside them.
CONTAINERS = frozenset("html body div section article main center table tbody tr td form".split())
#: Words of a class, id or role that say what an element outside an article is for.
NOT_CONTENT = frozenset("ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars widget widgets related recommended recommendations share sharing social comment comments commentlist reply replies disqus respond footer masthead toolbar search searchbox paywall skip dialog contentinfo complementary disclaimer".split())
#: Of these, words that inside an article name what is never part of it; others may be its sections, and the wrapper decides.
NEVER_ARTICLE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored cookie cookies gdpr newsletter signup nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar sidebars comments disqus masthead paywall contentinfo".split())
#: Of these, words of readers' comments, wherever they stand.
COMMENTS = frozenset("comment comments commentlist reply replies disqus respond".split())
#: Of these, words of elements that list other articles than the page's own.
LISTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion widget widgets related recommended recommendations comment comments commentlist reply replies disqus respond".split())
#: Classes of an element's state or layout say what it has, not what it is.
_STATE = re.compile(r"(?:has|no|with|without)[-_]")
NAMED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
HEADINGS = frozenset("h1 h2".split())

_OPEN = re.compile(r"<(?:!--|[a-zA-Z/!?])")
_STOP = re.compile(r"[>\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Numbers of posts in class names don't make elements different.
_DIGITS = re.compile(r"\d{3,}")

#: Slots are told apart down to this depth; what lies deeper belongs to the slot there, and no text is lost.
LEVELS = 100
#: The share of a part's text from which a container stands for it, and of the page's from which a marked article does.
MOST, MARKED = 0.8, 0.2


class Node:
    """An element with its children; text stands among them as strings.

    ``gone``: never text. ``inner``, ``outer``, ``listed``: its names say so inside an article, outside, or name a list.
    """

    __slots__ = ("children", "gone", "inner", "label", "listed", "outer", "own", "slot", "tag")

    def __init__(self, tag: str, label: str, gone: bool = False) -> None:
        self.tag, self.label, self.gone, self.children, self.slot, self.own = tag, label, gone, [], -1, 0
        self.inner = self.outer = self.listed = False


def _element(tag: str, source: str) -> Node:
    node = Node(tag, tag, tag in DROPPED)
    node.outer = tag == "header"
    if " " in source or "\n" in source or "\t" in source:
        for m in _ATTRIBUTE.finditer(source, len(tag) + 1):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                low = value.lower().split()
                if name != "id":
                    node.label += "." + " ".join(_DIGITS.sub("0", x) for x in low)
                if tag in ("html", "body", "article", "main") or name == "id" and tag in NAMED:
                    continue
                found = {w for x in low if not _STATE.match(x) for w in _PART.findall(x)}
                if not found.isdisjoint(NOT_CONTENT):
                    node.outer = True
                    node.listed |= not found.isdisjoint(LISTS)
                    node.inner |= not COMMENTS.isdisjoint(found) or not (NEVER_ARTICLE.isdisjoint(low) if name == "id" else NEVER_ARTICLE.isdisjoint(found))
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
                node.gone = True
            elif name == "itemprop" and value.lower() == "articlebody":
                node.label += "@articlebody"
    return node


def parse(source: str) -> Node:
    """The element tree of a page, however badly it is closed. Quotes that are never closed are no quotes."""
    root, at, n = Node("#", "#"), 0, len(source)
    stack, open_, forms = [root], Counter(), False
    last = {q: source.rfind(q) for q in "\"'"}

    def cut(k: int) -> None:
        for node in stack[k:]:
            open_[node.tag] -= 1
        del stack[k:]

    while at < n:
        m = _OPEN.search(source, at)
        text = source[at : m.start() if m else n]
        if text:
            stack[-1].children.append(_html.unescape(text) if "&" in text else text)
        if not m:
            break
        begin, kind = m.start(), m[0][1]
        if kind in "!?":
            mark = "-->" if len(m[0]) == 4 else ">"
            end = source.find(mark, m.end())
            at = n if end < 0 else end + len(mark)
            continue
        i = begin + 1
        while (stop := _STOP.search(source, i)) and stop[0] != ">":
            i, quote = stop.end(), stop[0]
            j = i - 2
            while j > begin and source[j].isspace():
                j -= 1
            if source[j] == "=" and last[quote] >= i:
                i = source.find(quote, i) + 1
        at = stop.end() if stop else n
        token, closing = source[begin:at], kind == "/"
        name = _NAME.match(token, 1 + closing)
        if not name:
            continue
        tag = name[0].lower()
        if closing:
            if open_[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                cut(k)
            elif tag in ("br", "p"):
                stack[-1].children.append(Node(tag, tag))
            continue
        if tag not in INLINE and tag not in VOID or tag == "hr":
            ends = CLOSES.get(tag, CLOSES["p"])
            k = len(stack) - 1 if any(open_[e] > 0 for e in ends) else 0
            while k > 0 and stack[k].tag not in SCOPES | ends:
                k -= 1
            while k > 0 and stack[k].tag in ends:
                cut(k)
                if tag not in ("tr", "td", "th", "dt", "dd", "li"):
                    break
                k -= 1
                while k > 0 and stack[k].tag not in SCOPES | ends:
                    k -= 1
        node = _element(tag, token)
        stack[-1].children.append(node)
        if tag in VOID or token.endswith("/>"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
            stop_at = end.start() if end else n
            node.children.append(source[at:stop_at] if tag not in ("textarea", "title") else _html.unescape(source[at:stop_at]))
            at = source.find(">", stop_at) + 1 if end else n
            at = at or n
            continue
        stack.append(node)
        open_[tag] += 1
        forms |= tag == "form"
    if forms:
        _open_forms(root)
    return root


def _open_forms(root: Node) -> None:
    """A form that holds a marked article or half of the page's text is a container like any other; its controls are still none."""
    order, stack = [], [(root, -1)]
    while stack:
        node, above = stack.pop()
        stack += [(c, len(order)) for c in node.children if isinstance(c, Node) and (c.tag == "form" or not c.gone)]
        order.append((node, above))
    chars, marks = [sum(len(c.strip()) for c in n.children if isinstance(c, str)) for n, _ in order], [n.tag in ("article", "main") or "@articlebody" in n.label for n, _ in order]
    for i in range(len(order) - 1, 0, -1):
        above = order[i][1]
        chars[above] += chars[i]
        marks[above] |= marks[i]
    for (node, _), n, marked in zip(order, chars, marks, strict=True):
        if node.tag == "form" and n and (marked or 2 * n >= chars[0]):
            node.gone = False


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _inline(node: Node) -> bool:
    return node.tag in INLINE and not (node.gone or node.outer or node.inner)


def fold(root: Node) -> tuple[list[str], list[int]]:
    """Labels and depths, in pre-order, of the tree in which alike siblings are one node.

    Sets the ``slot`` of each element to its number there and ``own`` to the digest of its own text; inline elements belong to
    what they stand in.
    """
    labels, depths = [], []
    stack = [([root], 0)]
    while stack:
        nodes, depth = stack.pop()
        mine = len(labels)
        labels.append(nodes[0].label)
        depths.append(depth)
        below: dict[str, list[Node]] = {}
        at = 0
        while at < len(nodes):  # at the last level what lies below joins these nodes
            node = nodes[at]
            at += 1
            node.slot = mine
            held, own = [node], []
            for x in held:
                for c in x.children:
                    if isinstance(c, str):
                        own.append(c)
                    elif _inline(c):
                        c.slot = mine
                        held.append(c)
                    elif depth + 1 < LEVELS:
                        below.setdefault(c.label, []).append(c)
                    else:
                        nodes.append(c)
            node.own = digest(" ".join(" ".join(own).split()))
            for x in held:
                x.own = node.own
        stack += [(group, depth + 1) for group in reversed(below.values())]
    return labels, depths


def sizes(depths: list[int]) -> np.ndarray:
    """Nodes of each subtree."""
    n, out, open_ = len(depths), np.ones(len(depths), np.int64), []
    for i, d in enumerate([*depths, -1]):
        while open_ and depths[open_[-1]] >= d:
            k = open_.pop()
            out[k] = i - k
        if i < n:
            open_.append(i)
    return out


class Pieces:
    """Texts of a page in order with, for each, its slot, its element's own text and the deepest slot above it with a name."""

    def __init__(self, root: Node) -> None:
        self.text: list[str] = []
        self.slot: list[int] = []
        self.own: list[int] = []
        self.inner: list[int] = []
        self.outer: list[int] = []
        self.listed: list[int] = []
        held: list[str] = []
        place = (0, 0, -1, -1, -1)

        def flush() -> None:
            text = "".join(held)
            held.clear()
            if text:
                flat = " ".join(text.split())
                self.text.append((" " if text[0].isspace() else "") + flat + (" " if text[-1].isspace() and flat else ""))
                for to, v in zip((self.slot, self.own, self.inner, self.outer, self.listed), place, strict=True):
                    to.append(v)

        stack = [(root, place, iter(root.children), False)]
        while stack:
            node, above, children, block = stack[-1]
            for c in children:
                if isinstance(c, str):
                    held.append(c)
                elif c.gone or c.tag in ("br", "hr"):
                    held.append(" ")
                else:
                    if not _inline(c):
                        flush()
                        if c.tag not in INLINE:
                            held.append(" ")
                        place = (c.slot, c.own, c.slot if c.inner else above[2], c.slot if c.outer else above[3], c.slot if c.listed else above[4])
                    stack.append((c, place, iter(c.children), c.tag not in INLINE))
                    break
            else:
                stack.pop()
                if not _inline(node):
                    if block:
                        held.append(" ")
                    flush()
                    if stack:
                        place = stack[-1][1]
        flush()

    def kept(self, first: list[int], size: list[int], inside: bool) -> list[bool]:
        """Which pieces are text of the regions that begin at slots ``first`` and have ``size`` slots."""
        if len(self.text) > 64:
            slot, names = np.array(self.slot), np.array(self.inner if inside else self.outer)
            out = np.zeros(len(slot), bool)
            for a, n in zip(first, size, strict=True):
                out |= (slot >= a) & (slot < a + n) & (names <= a)
            return out.tolist()
        names = self.inner if inside else self.outer
        return [any(a <= s < a + n and k <= a for a, n in zip(first, size, strict=True)) for s, k in zip(self.slot, names, strict=True)]


def region(labels: list[str], size: np.ndarray, plain: np.ndarray, marked: np.ndarray, own: np.ndarray) -> tuple[list[int], bool]:
    """Slots where the content of a tree begins, and whether names count there as inside an article.

    ``plain``: text in each subtree that no name takes away; ``marked``: the same where only names below the node itself
    count; ``own``: text of each node itself. A marked article with a fair share of the text is the content. Else the tree is
    followed down while one container holds nearly all text and no heading stands beside it.
    """
    tags = [x.split(".", 1)[0].split("@", 1)[0] for x in labels]
    for marks in (lambda i: tags[i] == "article", lambda i: "@articlebody" in labels[i], lambda i: tags[i] == "main"):
        found, end = [], 0
        for i in range(len(labels)):
            if i >= end and marks(i) and marked[i] > 0:
                found.append(i)
                end = i + int(size[i])
        found = [i for i in found if plain[i] > 0] or found  # where all stand below a name, that name says nothing
        if len(found) > 1:  # teasers of others: the page's own has the most text, and maybe parts that are like it and beside it
            above = _parents(size)
            top = max(found, key=lambda i: marked[i])
            found = [i for i in found if above[i] == above[top] and labels[i] == labels[top]]
        held = float(sum(marked[i] for i in found))
        if found and held >= MARKED * (held + max(0.0, float(plain[0]) - float(sum(plain[i] for i in found)))):
            return found, True
    at = 0
    while True:
        children = [i for i in _children(at, size) if plain[i] > 0]
        best = max(children, key=lambda i: plain[i], default=None)
        if best is None or tags[best] not in CONTAINERS or plain[best] < MOST * plain[at] or own[best] >= 0.5 * plain[best] or any(tags[i] in HEADINGS for i in children):
            return [at], tags[at] not in ("#", "html", "body")
        at = best


def _parents(size: np.ndarray) -> list[int]:
    out, open_ = [], []
    for i, n in enumerate(size.tolist()):
        while open_ and i >= open_[-1][1]:
            open_.pop()
        out.append(open_[-1][0] if open_ else -1)
        open_.append((i, i + n))
    return out


def _children(at: int, size: np.ndarray) -> list[int]:
    out, i, end = [], at + 1, at + int(size[at])
    while i < end:
        out.append(i)
        i += int(size[i])
    return out


def _subtrees(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.arange(len(values))
    return ends[at + size] - ends[at]


def _weights(pieces: Pieces, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``plain`` and ``marked`` of each subtree and ``own`` of each node of a page."""
    n = len(size)
    chars = np.array([len(t.strip()) for t in pieces.text], float)
    slot, outer, inner, listed = (np.array(x, np.int64) for x in (pieces.slot, pieces.outer, pieces.inner, pieces.listed))
    free = outer < 0
    if not chars[free].sum():  # a page of nothing else
        listed = np.full(len(slot), -1)
    own = np.bincount(slot[free], chars[free], n) if len(slot) else np.zeros(n)
    marked = np.zeros(n)
    for s, c, i, l in zip(slot.tolist(), chars.tolist(), inner.tolist(), listed.tolist(), strict=True):
        # counts for each node above it from its own slot up to the name that takes it away; not at all where a list holds it
        if l < 0:
            marked[s] += c
            if i >= 0:
                marked[i] -= c
    return _subtrees(own, size), _subtrees(marked, size), own


def read_page(source: str | None) -> tuple[list[str], list[int], Pieces, list[bool]]:
    """Tree, pieces and which of them the page alone shows as content."""
    root = parse(source or "")
    labels, depths = fold(root)
    size, pieces = sizes(depths), Pieces(root)
    first, inside = region(labels, size, *_weights(pieces, size))
    return labels, depths, pieces, pieces.kept(first, [int(size[i]) for i in first], inside)


def joined(texts: list[str], kept: list[bool]) -> str:
    return " ".join("".join(t if k else " " for t, k in zip(texts, kept, strict=True)).split())


def extract(source: str | None) -> str:
    """Main text of a page on its own, without what other pages of its host show."""
    _, _, pieces, kept = read_page(source)
    return joined(pieces.text, kept)


# trees as nested tuples of a label and children


def nested(labels: list[str], depths: list[int]) -> tuple:
    path: list[tuple] = []
    for label, depth in zip(labels, depths, strict=True):
        node = (label, [])
        del path[depth:]
        if path:
            path[-1][1].append(node)
        path.append(node)
    return path[0]


def flat(tree: tuple) -> tuple[list[str], list[int]]:
    labels, depths, stack = [], [], [(tree, 0)]
    while stack:
        (label, children), depth = stack.pop()
        labels.append(label)
        depths.append(depth)
        stack += [(c, depth + 1) for c in reversed(children)]
    return labels, depths


class Matching:
    """Simple tree matching of two trees; each pair of nodes is matched once."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], int] = {}

    def weight(self, a: tuple, b: tuple) -> int:
        """Nodes in the largest order-keeping matching of two trees with equal roots."""
        if a[0] != b[0]:
            return 0
        if (found := self.known.get((id(a), id(b)))) is None:
            found = self.known[id(a), id(b)] = self._table(a, b)[0][-1][-1] + 1
        return found

    def _table(self, a: tuple, b: tuple) -> tuple[list[list[int]], list[list[int]]]:
        w = [[self.weight(x, y) for y in b[1]] for x in a[1]]
        m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i in range(len(a[1])):
            for j in range(len(b[1])):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + w[i][j])
        return m, w

    def paired(self, a: tuple, b: tuple) -> list[tuple[int, int]]:
        """Which children of two matched nodes are aligned."""
        m, w = self._table(a, b)
        out, i, j = [], len(a[1]), len(b[1])
        while i and j:
            if w[i - 1][j - 1] and m[i][j] == m[i - 1][j - 1] + w[i - 1][j - 1]:
                out.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out[::-1]


def match(a: tuple, b: tuple) -> int:
    return Matching().weight(a, b)


def merge(a: tuple, b: tuple, by: Matching | None = None) -> tuple:
    """A tree that holds both: aligned nodes once, others in order."""
    by = by or Matching()
    children, i, j = [], 0, 0
    for p, q in [*by.paired(a, b), (len(a[1]), len(b[1]))]:
        children += [*a[1][i:p], *b[1][j:q]]
        if p < len(a[1]):
            children.append(merge(a[1][p], b[1][q], by))
        i, j = p + 1, q + 1
    return (a[0], children)


def numbers(wrapper: tuple, tree: tuple) -> list[int]:
    """The wrapper's pre-order number for each node of ``tree`` in pre-order (-1: none)."""
    by, out = Matching(), []
    size: dict[int, int] = {}

    def nodes(t: tuple) -> int:
        if id(t) not in size:
            size[id(t)] = 1 + sum(map(nodes, t[1]))
        return size[id(t)]

    def visit(w: tuple, t: tuple, first: int) -> None:
        out.append(first)
        starts, at = [], first + 1
        for c in w[1]:
            starts.append(at)
            at += nodes(c)
        to = {q: p for p, q in by.paired(w, t)}
        for q, c in enumerate(t[1]):
            if q in to:
                visit(w[1][to[q]], c, starts[to[q]])
            else:
                out.extend([-1] * nodes(c))

    visit(wrapper, tree, 0)
    return out


def _dumps(tree: tuple) -> str:
    return json.dumps(flat(tree), separators=(",", ":"))


def _loads(tree: str) -> tuple:
    return nested(*json.loads(tree))


# Spark

_INTS = pa.list_(pa.int32())
_SLOT = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.int64()), ("plain", pa.int64()), ("marked", pa.int64())]))
_PAGE = {"page_id": pa.int64(), "url": pa.string(), "host": pa.string(), "shape": pa.int64(), "tree": pa.string(), "page": pa.int64(), "slots": _SLOT, "texts": pa.list_(pa.string()), "slot": _INTS, "own": pa.list_(pa.int64()), "inner": _INTS, "outer": _INTS, "kept": pa.list_(pa.bool_())}
PAGE_SCHEMA = "page_id long, url string, host string, shape long, tree string, page long, slots array<struct<slot:int,text:long,plain:long,marked:long>>, texts array<string>, slot array<int>, own array<long>, inner array<int>, outer array<int>, kept array<boolean>"


#: Stands for no text where a name takes away what is below its slot.
NO_TEXT = 0


def _slots(pieces: Pieces) -> list[dict]:
    """Own texts of a page by slot, and their characters: see ``region`` for ``plain`` and ``marked``.

    Of names only those that are never an article's take text away here: about the others the wrapper decides.
    """
    found: dict[tuple[int, int], list[int]] = {}
    free = [o < 0 for o in pieces.outer]
    whole = not any(f and t.strip() for f, t in zip(free, pieces.text, strict=True))
    for t, s, own, i, o, l in zip(pieces.text, pieces.slot, pieces.own, pieces.inner, pieces.outer, pieces.listed, strict=True):
        n = len(t.strip())
        entry = found.setdefault((s, own), [0, 0])
        if i < 0:
            entry[0] += n
        if whole or l < 0:
            entry[1] += n
            if i >= 0:
                found.setdefault((i, NO_TEXT), [0, 0])[1] -= n
    return [{"slot": s, "text": x, "plain": p, "marked": m} for (s, x), (p, m) in found.items()]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page; a task gives the tree with the first page of a shape only."""
    seen: set[tuple[str, int]] = set()
    for b in batches:
        rows = []
        for page_id, url, host, source in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "host", "html")), strict=True):
            labels, depths, p, kept = read_page(source)
            tree = json.dumps((labels, depths), separators=(",", ":"))
            key = (host, digest(tree))
            rows.append((page_id, url, *key, None if key in seen else tree, digest(joined(p.text, kept)) if source else None, _slots(p), p.text, p.slot, p.own, p.inner, p.outer, kept))
            if len(seen) > 100_000:
                seen.clear()
            seen.add(key)
        if rows:
            yield batch(dict(zip(_PAGE, map(list, zip(*rows, strict=True)), strict=True)), _PAGE)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tree for each run of ``run``, merged from its trees."""
    for rows in runs(batches, "run"):
        trees = sorted(set(rows.column("tree").to_pylist()), key=lambda t: (len(t), t))
        whole = _loads(trees[0])
        for t in trees[1:]:
            whole = merge(whole, _loads(t))
        yield batch({"host": rows.column("host")[:1].combine_chunks(), "tree": [_dumps(whole)]}, {"host": pa.string(), "tree": pa.string()})


def _plain(label: str) -> str:
    """A label without its classes."""
    return label.split(".", 1)[0].split("@", 1)[0] + ("@articlebody" if "@articlebody" in label else "")


def relabelled(trees: DataFrame, work: str, share: float = 0.01) -> DataFrame:
    """``trees`` whose labels that fewer than ``share`` of the host's different pages have, or only one, are tags without classes.

    Classes that a page makes up would never align, and the wrapper would grow with the pages. So a host has at most ``1 / share`` times as many labels as a page has.
    """
    weight = F.greatest("pages", F.lit(1))
    labels = trees.select("host", weight.alias("w"), F.explode(F.array_distinct(F.from_json("tree", "array<array<string>>")[0])).alias("label"))
    found = labels.groupBy("host", "label").agg(F.sum("w").alias("n"))
    whole = trees.groupBy("host").agg(F.sum(weight).alias("of"))
    common = found.join(whole, "host").where((F.col("n") > 1) & (F.col("n") >= share * F.col("of"))).groupBy("host").agg(F.collect_set("label").alias("common"))
    common = staged(common, f"{work}/labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tree, known in zip(b.column("tree").to_pylist(), b.column("common").to_pylist(), strict=True):
                labels, depths = json.loads(tree)
                held = set(known or ())
                out.append(json.dumps(([x if x in held else _plain(x) for x in labels], depths), separators=(",", ":")))
            yield batch({"host": b.column("host"), "shape": b.column("shape"), "tree": out, "pages": b.column("pages")}, {"host": pa.string(), "shape": pa.int64(), "tree": pa.string(), "pages": pa.int64()})

    return staged(arrow_map(trees.join(common, "host", "left").select("host", "shape", "tree", "pages", "common"), run, "host string, shape long, tree string, pages long"), f"{work}/relabelled")


def wrappers(trees: DataFrame, work: str, fan_in: int = 32) -> DataFrame:
    """``host, wrapper``: the trees ``host, tree`` of each host merged to one, about ``fan_in`` at a time, until one is left."""
    held, k = staged(trees.select("host", "tree"), f"{work}/merge0"), 0
    while True:
        counts = held.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return held.withColumnRenamed("tree", "wrapper")
        k += 1
        parts = F.ceil(F.col("n") / fan_in)
        dealt = held.join(counts, "host").withColumn("run", F.xxhash64("host", F.pmod(F.xxhash64("tree", F.lit(k)), parts), F.lit(k))).select("host", "tree", "run")
        held = staged(arrow_map(dealt.repartition("run").sortWithinPartitions("run"), _merged, "host string, tree string"), f"{work}/merge{k}")


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"host": pa.string(), "shape": pa.int64(), "nodes": _INTS, "sizes": _INTS}
    for b in batches:
        nodes, size = [], []
        for w, t in zip(b.column("wrapper").to_pylist(), b.column("tree").to_pylist(), strict=True):
            nodes.append(numbers(_loads(w), _loads(t)))
            size.append(sizes(json.loads(t)[1]).astype(np.int32))
        yield batch({"host": b.column("host"), "shape": b.column("shape"), "nodes": nodes, "sizes": size}, types)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content nodes of each wrapper by the varying text in its nodes."""
    types = {"host": pa.string(), "content": _INTS, "inside": pa.bool_()}
    for b in batches:
        content, inner = [], []
        for wrapper, varying in zip(b.column("wrapper").to_pylist(), b.column("varying").to_pylist(), strict=True):
            labels, depths = json.loads(wrapper)
            size, own, marked = sizes(depths), np.zeros(len(labels)), np.zeros(len(labels))
            for x in varying:
                own[x["node"]], marked[x["node"]] = x["plain"], x["marked"]
            first, inside = region(labels, size, _subtrees(own, size), _subtrees(marked, size), own)
            content.append(first)
            inner.append(inside)
        yield batch({"host": b.column("host"), "content": content, "inside": inner}, types)


def templates(every: DataFrame, work: str, share: float = 0.6, least: int = 5) -> DataFrame:
    """``host, shape, first, size, inside, constants``: for each shape of a host with ``least`` different pages where its content
    begins, how many slots it has there, and the ``(slot, text)`` that are constant.

    A text is constant in a wrapper node if at least ``share`` of the host's different pages that have the node have that text
    there, and at least ``least`` of them. Pages with the same main text count as one, so copies of an article don't make it a
    template; the shapes of all of them are aligned, so that a constant text is found on every copy.
    """
    held = every.where("page is not null")
    counted = held.groupBy("host", "page").agg(F.min(F.struct("shape", "slots")).alias("p")).select("host", "p.shape", F.lit(None).cast("string").alias("tree"), "p.slots", F.lit(1).alias("counted"))
    shapes = held.select("host", "shape", "tree", "slots", F.lit(0).alias("counted")).unionByName(counted)
    trees = staged(shapes.groupBy("host", "shape").agg(F.min("tree").alias("tree"), F.sum("counted").alias("pages")), f"{work}/trees")
    enough = staged(trees.groupBy("host").agg(F.sum("pages").alias("n")).where(F.col("n") >= least).select("host"), f"{work}/hosts")
    trees = relabelled(trees.join(enough, "host", "left_semi"), work)
    whole = wrappers(trees.select("host", "tree").distinct(), work)
    aligned = staged(arrow_map(trees.join(whole, "host").select("host", "shape", "tree", "wrapper"), _aligned, "host string, shape long, nodes array<int>, sizes array<int>"), f"{work}/aligned")
    counts = shapes.select("host", "shape", "counted", F.explode("slots").alias("s")).groupBy("host", "shape", F.col("s.slot").alias("slot"), F.col("s.text").alias("text")).agg(F.sum("counted").alias("n"), F.sum(F.col("counted") * F.col("s.plain")).alias("plain"), F.sum(F.col("counted") * F.col("s.marked")).alias("marked"))
    placed = staged(counts.join(aligned.select("host", "shape", "nodes"), ["host", "shape"]).withColumn("node", F.get("nodes", "slot")).drop("nodes").where("node >= 0"), f"{work}/placed")
    has = aligned.join(trees.select("host", "shape", "pages"), ["host", "shape"]).select("host", "pages", F.explode("nodes").alias("node")).where("node >= 0").groupBy("host", "node").agg(F.sum("pages").alias("pages"))
    texts = placed.groupBy("host", "node", "text").agg(F.sum("n").alias("n"), F.sum("plain").alias("plain"), F.sum("marked").alias("marked")).join(has, ["host", "node"])
    texts = staged(texts.withColumn("constant", (F.col("text") != NO_TEXT) & (F.col("n") >= least) & (F.col("n") >= share * F.col("pages"))), f"{work}/texts")
    varying = texts.groupBy("host", "node").agg(F.sum(F.when(~F.col("constant"), F.col("plain")).otherwise(0)).alias("plain"), F.sum(F.when(~F.col("constant"), F.col("marked")).otherwise(0)).alias("marked"))
    varying = varying.groupBy("host").agg(F.collect_list(F.struct("node", "plain", "marked")).alias("varying"))  # as long as the wrapper
    content = staged(arrow_map(whole.join(varying, "host"), _regions, "host string, content array<int>, inside boolean"), f"{work}/content")
    constants = placed.join(texts.where("constant").select("host", "node", "text"), ["host", "node", "text"], "left_semi").groupBy("host", "shape").agg(F.collect_list(F.struct("slot", "text")).alias("constants"))
    first = F.filter(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.array_contains("content", F.get("nodes", i)))
    return (
        aligned.join(content, "host")
        .withColumn("first", first)
        .withColumn("size", F.transform("first", lambda i: F.get("sizes", i)))
        .join(constants, ["host", "shape"], "left")
        .select("host", "shape", "first", "size", "inside", "constants")
    )


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string()}
    for b in batches:
        out = []
        for r in b.drop_columns(["page_id", "url"]).to_pylist():
            p = Pieces.__new__(Pieces)
            p.text, p.slot, p.inner, p.outer = r["texts"], r["slot"], r["inner"], r["outer"]
            kept = r["kept"]
            if r["first"]:
                by_host = p.kept(r["first"], r["size"], r["inside"])
                if any(k and t.strip() for k, t in zip(by_host, p.text, strict=True)):
                    kept = by_host
            if r["constants"]:
                constant = {(x["slot"], x["text"]) for x in r["constants"]}
                kept = [k and (s, o) not in constant for k, s, o in zip(kept, p.slot, r["own"], strict=True)]
            out.append(joined(p.text, kept))
        yield batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": out}, types)


#: Templates are broadcast if they have at most this many entries together, some 20 bytes each.
BROADCAST_ENTRIES = 1_000_000


def main_text(pages: DataFrame, work: str) -> DataFrame:
    """``page_id, url, text`` of every row: the main text of the whole page, empty for null or empty html.

    Pages without a host are one host. On a host with five different pages or more the wrapper tells where the content is and
    what is template; on others, and where a page has nothing there, the page's own tree tells. Rows with null or
    repeated ids are pages of their own; other columns are ignored. Every page is parsed once. The templates have a row for each
    shape of a host; if they are counted to be small they are broadcast, or else AQE splits the pages of a shape.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    every = staged(arrow_map(rows, _pages, PAGE_SCHEMA), f"{work}/pages")
    found = staged(templates(every, work), f"{work}/templates")
    entries = found.agg(F.sum(4 + 2 * F.size("first") + F.coalesce(F.size("constants"), F.lit(0)))).first()[0] or 0
    held = every.select("page_id", "url", "host", "shape", "texts", "slot", "own", "inner", "outer", "kept")
    return arrow_map(held.join(F.broadcast(found) if entries <= BROADCAST_ENTRIES else found, ["host", "shape"], "left").drop("host", "shape"), _select, "page_id long, url string, text string")
