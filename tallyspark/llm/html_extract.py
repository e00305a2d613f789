"""Main text of web pages by wrapper induction over the pages of a host.

A page becomes a tree of block elements; runs of like siblings are one node, and so are like siblings beyond
``LIKE`` under one parent. Simple tree matching aligns the page with its host's wrapper, the tree of all nodes seen so
far with their counts: matched nodes add up, unmatched ones join the wrapper. A node whose text is the same on all
pages is template, one whose text varies is a slot. Paragraphs and headings are told apart one by one: a node keeps the
texts of those right below it that all of its pages have, wherever they stand among the others. Each task folds its
pages into a wrapper per host and wrappers merge by the same alignment, so every page counts and no host's pages meet in
one task. A wrapper of more than ``MOST_NODES`` nodes forgets the rarest, whose pages then speak for themselves.

Extraction aligns each page with the finished wrapper. Slots weigh as much as their text without links on the host's
average page, template weighs nothing. The main region is found from the root down: as long as one element holds more
than half of the weight, it is entered. Tags break ties: of the elements entered an ``article``, else a ``main``, is
taken, and articles that hold most of a region are the region. If a region has no heading, the varying ``h1`` before it
counts. Within the region go elements that are no main text by their tag (navigation, forms, ...), by a name that their
weight doesn't contradict, because they are mostly links, or because they are template: boxes that two pages or more have alike, and constant
paragraphs and headings if at least ``WITNESSES`` pages and most pages of the host have their place (two or three
articles may quote the same paragraph). What is constant stays where it is longer than the other text, for the pages may
be copies of one article. If an article's constant text outweighs all slots, the pages are copies too, and it counts as a slot.

Null HTML and URLs count as empty: an empty text; a page without a host is judged alone. Pages of a broken markup keep
what can be read, in time proportional to their length. Repeated rows are extracted each; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, materialize, slices

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Of a page with an unclosed quote: a tag ends at the next bracket.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:\s|^)hidden(?:\s|=|$|/)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_words = lambda s: frozenset(s.split())
INLINE = _words("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label img picture source")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title iframe xmp noembed noframes")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
BREAKS = frozenset(("br", "hr"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
#: Elements that are text one by one, those whose own text is, and those that are never folded into a run.
SINGLE = HEADINGS | {"p"}
HOLDERS = _words("article main body html #")
APART = _words("article main div section")
#: Elements that a main region can't be, and those that may be a list of links.
PARTS = SINGLE | _words("ul ol dl li dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption")
LISTS = _words("ul ol dl div section table")
#: Elements that are never main text; the second ones stand within a line.
ASIDE_TAGS = _words("nav footer aside form head button dialog menu input fieldset noscript template select")
ASIDE_INLINE = _words("svg math object canvas")
#: Words of names that tell reader comments, other asides, and what is an aside if it is mostly links.
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply|disqus)(?:$|[\s_-])", re.I)
_ASIDES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|footer|sidebar|advert\w*|ads?|adbox|banner|promo|promoted|sponsor\w*|cookies?|notice|consent|gdpr|popup|modal|overlay|newsletter|subscribe|share|sharing|breadcrumbs?|pagination|pager|login|signup|toolbar|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
_LINKED = re.compile(r"(?:^|[\s_-])(?:search|social|related|recommended|widget)(?:$|[\s_-])", re.I)
NONE, IF_LINKED, BY_NAME, ALWAYS = range(4)
#: Like siblings under one parent that have nodes of their own.
LIKE = 8
#: Pages that must have a paragraph before it is template.
WITNESSES = 5
#: Shares of links in the text: of any list, and of an element whose name hints at links.
LINK_SHARE, HINTED_SHARE = 0.8, 0.3
#: Nodes of a wrapper, and of all wrappers that a task holds before it sends them on.
MOST_NODES, HELD_NODES = 4096, 1 << 18
#: Page shapes remembered for a host; others are aligned each time.
SHAPES = 4096
#: JSON bytes of all wrappers up to which they travel with the tasks; more are joined by host.
CARRIED_BYTES = 2 << 20


def tokens(source: str):
    """(text before it, closes, tag, attributes) of every tag; the last text has no tag."""
    at = last = 0
    find, pattern = source.find, _TAG
    while (lt := find("<", at)) >= 0:
        mark = source[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            if source.startswith("<!--", lt):
                end = find("-->", lt + 4)
                end = len(source) if end < 0 else end + 3
            else:
                end = find("]]>" if source.startswith("<![CDATA[", lt) else ">", lt)
                if end < 0:
                    break
                end += 3 if source[end] == "]" else 1
            yield source[last:lt], "", "", ""
            at = last = end
            continue
        m = pattern.match(source, lt)
        if m is None:
            if mark.isalpha() or mark == "/":
                if find(">", lt) < 0:
                    break
                if pattern is _TAG and (mark.isalpha() or source[lt + 2 : lt + 3].isalpha()):
                    pattern = _PLAIN_TAG
                    continue
            at = lt + 1
            continue
        tag = m[2].lower()
        at = m.end()
        yield source[last:lt], m[1], tag, m[3]
        if tag in RAW and not m[1]:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else len(source)
        last = at
    yield source[last:], "", "", ""


def _aside(tag: str, names: list[str], attrs: str) -> int:
    if tag in ASIDE_TAGS or tag in ASIDE_INLINE or attrs and _HIDDEN.search(attrs):
        return ALWAYS
    if not names or tag in ("html", "body", "main") or tag in HEADINGS:
        return NONE
    if any(map(_COMMENTS.search, names)):
        return ALWAYS
    if tag != "article":
        if any(map(_ASIDES.search, names)):
            return BY_NAME
        if any(map(_LINKED.search, names)):
            return IF_LINKED
    return NONE


class Page:
    """nodes: (parent, key, aside) in page order, a parent before its children. flow: (node, text, linked) in page order."""

    __slots__ = ("nodes", "flow")

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str, int]] = [(-1, "#", NONE)]
        self.flow: list[tuple[int, str, bool]] = []
        stack: list[tuple[str, int]] = [("#", 0)]  # tag and node of the open blocks
        open_tags: dict[str, int] = {}
        last: dict[int, str] = {}  # key of the last child of a node
        like: dict[tuple[int, str], list[int]] = {}  # how many children of a key a node has, and the last of them
        link = 0  # depth of the stack where a link was opened
        flow, nodes = self.flow, self.nodes

        def pop(size: int) -> None:
            nonlocal link
            for tag, _ in stack[size:]:
                open_tags[tag] -= 1
            del stack[size:]
            if link > size:
                link = 0

        for text, closes, tag, attrs in tokens(source):
            if text:
                flow.append((stack[-1][1], entities.unescape(text) if "&" in text else text, link > 0))
            if not tag:
                continue
            if closes:
                if tag == "a":
                    link = 0
                elif tag not in INLINE:
                    if open_tags.get(tag):
                        size = len(stack) - 1
                        while stack[size][0] != tag:
                            size -= 1
                        pop(size)
                    flow.append((stack[-1][1], " ", False))
                continue
            if tag in INLINE:
                if tag == "a":
                    link = len(stack)
                continue
            if tag in RAW:
                continue
            if tag not in ASIDE_INLINE:
                flow.append((stack[-1][1], " ", False))
            if tag in BREAKS or tag in VOID and tag != "input":
                continue
            shut = CLOSES.get(tag, ())
            while stack[-1][0] == "p" or stack[-1][0] in shut:
                pop(len(stack) - 1)
                flow.append((stack[-1][1], "", False))
            parent = stack[-1][1]
            names = [v.strip("\"'") for _, v in _NAMES.findall(attrs)] if attrs else []
            key = f"{tag}.{names[0]}" if names else tag
            seen = like.setdefault((parent, key), [0, 0])
            if last.get(parent) == key and tag not in APART or seen[0] >= LIKE:
                node = seen[1]
            else:
                nodes.append((parent, key, _aside(tag, names, attrs)))
                node = len(nodes) - 1
                seen[0] += 1
                seen[1] = node
            last[parent] = key
            if tag not in VOID and not attrs.endswith("/"):
                stack.append((tag, node))
                open_tags[tag] = open_tags.get(tag, 0) + 1

    def texts(self) -> list[tuple[str, int]]:
        """Each node's own text, without its children's, and the length of its links."""
        parts: list[list[str]] = [[] for _ in self.nodes]
        linked = [0] * len(self.nodes)
        for node, text, link in self.flow:
            parts[node].append(text)
            if link:
                linked[node] += len(text)
        return [(" ".join("".join(p).split()), n) for p, n in zip(parts, linked, strict=True)]

    def blocks(self) -> list[tuple[int, int, int, int, int]]:
        """Stretches of flow within one element: place, first, end, mark and length of the text.

        The place is the node that holds the stretch among its paragraphs, headings and own text; -1 where a stretch is no
        text of its own (cells, items, boxes: they are judged as nodes).
        """
        out, flow, first = [], self.flow, 0
        for end in range(1, len(flow) + 1):
            node = flow[first][0]
            if end < len(flow) and flow[end][0] == node:
                continue
            text = " ".join("".join([t for _, t, _ in flow[first:end]]).split())
            if text:
                tag = self.nodes[node][1].partition(".")[0]
                place = self.nodes[node][0] if tag in SINGLE else node if tag in HOLDERS else -1
                out.append((place, first, end, len(text) << 32 | zlib.crc32(text.encode("utf-8", "surrogatepass")), len(text)))
            first = end
        return out


class Node:
    """A wrapper's node. pages, chars, linked: how many pages have it, the length of its own text and of the links in it on all of them;
    mark: the text's checksum (None: it varies, 0: no text); aside: what its tag and names tell; common: the marks of blocks that all
    pages have; shape: equal for equal trees of keys."""

    __slots__ = ("key", "pages", "mark", "chars", "linked", "aside", "children", "common", "shape")

    def __init__(self, key: str, pages: int = 1, mark: int | None = 0, chars: int = 0, linked: int = 0, aside: int = NONE, common: set | None = None):
        self.key, self.pages, self.mark, self.chars, self.linked, self.aside = key, pages, mark, chars, linked, aside
        self.children: list[Node] = []
        self.common, self.shape = common or set(), -1

    def below(self) -> list[Node]:
        """The node and all below it, a parent before its children."""
        out = [self]
        for node in out:
            out += node.children
        return out

    def dump(self) -> str:
        nodes = self.below()
        number = {id(n): i for i, n in enumerate(nodes)}
        parent = {number[id(c)]: i for i, n in enumerate(nodes) for c in n.children}
        return json.dumps([[parent.get(i, -1), n.key, n.pages, n.mark, n.chars, n.linked, n.aside, sorted(n.common)] for i, n in enumerate(nodes)])

    @classmethod
    def load(cls, text: str) -> Node:
        nodes: list[Node] = []
        for parent, *told, common in json.loads(text):
            nodes.append(cls(*told, set(common)))
            if parent >= 0:
                nodes[parent].children.append(nodes[-1])
        return nodes[0]


def tree_of(page: Page) -> list[Node]:
    """A tree of the page's nodes, in page order; the root comes first."""
    made = [Node(key, 1, zlib.crc32(t.encode("utf-8", "surrogatepass")) if t else 0, len(t), min(n, len(t)), aside) for (_, key, aside), (t, n) in zip(page.nodes, page.texts(), strict=True)]
    for (parent, _, _), node in zip(page.nodes[1:], made[1:], strict=True):
        made[parent].children.append(node)
    for place, _, _, mark, _ in page.blocks():
        if place >= 0:
            made[place].common.add(mark)
    return made


def _shaped(root: Node, table: dict) -> int:
    """Numbers the trees of keys below a root, equal ones alike; returns how many nodes there are."""
    nodes = root.below()
    for node in reversed(nodes):
        node.shape = table.setdefault((node.key, *[c.shape for c in node.children]), len(table))
    return len(nodes)


def _like(xs: list[Node], ys: list[Node]) -> list[tuple[int, int]]:
    """Places of equal keys, by the first ascending, then the second descending."""
    at: dict[str, list[int]] = {}
    for j in range(len(ys) - 1, -1, -1):
        at.setdefault(ys[j].key, []).append(j)
    return [(i, j) for i, x in enumerate(xs) for j in at.get(x.key, ())]


def best(xs: list[Node], ys: list[Node], known: dict) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest pairing in order of like nodes: its weight and its places. A tree of running maxima over ys keeps it near linear."""
    top: list[tuple[int, int]] = [(0, -1)] * (len(ys) + 1)  # (weight, entry)
    entries: list[tuple[int, int, int]] = []
    for i, j in _like(xs, ys):
        heaviest, k = (0, -1), j
        while k:
            if top[k][0] > heaviest[0]:
                heaviest = top[k]
            k &= k - 1
        entries.append((i, j, heaviest[1]))
        found, k = (heaviest[0] + known[xs[i].shape, ys[j].shape], len(entries) - 1), j + 1
        while k < len(top):
            if found[0] > top[k][0]:
                top[k] = found
            k += k & -k
    weight, k = 0, len(ys)
    entry = -1
    while k:
        if top[k][0] > weight:
            weight, entry = top[k]
        k &= k - 1
    out = []
    while entry >= 0:
        i, j, entry = entries[entry]
        out.append((i, j))
    return weight, out[::-1]


def match(a: Node, b: Node, known: dict) -> int:
    """Simple tree matching: how many nodes can be paired in order, roots paired; 0 if the roots differ. known: by the shapes of two nodes."""
    if a.key != b.key:
        return 0
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        if (x.shape, y.shape) in known:
            stack.pop()
            continue
        todo = [(x.children[i], y.children[j]) for i, j in _like(x.children, y.children)]
        todo = [t for t in todo if (t[0].shape, t[1].shape) not in known]
        if todo:
            stack += todo
        else:
            known[x.shape, y.shape] = 1 + best(x.children, y.children, known)[0]
            stack.pop()
    return known[a.shape, b.shape]


def aligned(a: Node, b: Node) -> dict[int, Node]:
    """The nodes of ``a`` that simple tree matching pairs with those of ``b``, by id of the latter."""
    table: dict = {}
    _shaped(a, table)
    _shaped(b, table)
    known: dict = {}
    met: dict[int, Node] = {}
    if not match(a, b, known):
        return met
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        met[id(y)] = x
        stack += [(x.children[i], y.children[j]) for i, j in best(x.children, y.children, known)[1]]
    return met


def merge(into: Node, other: Node) -> dict[int, Node]:
    """Adds a page's tree or another wrapper; returns the wrapper's node for each of other's, by id."""
    table: dict = {}
    size = _shaped(into, table) + _shaped(other, table)
    known: dict = {}
    match(into, other, known)
    met: dict[int, Node] = {}
    stack = [(into, other)]
    while stack:
        x, y = stack.pop()
        met[id(y)] = x
        merged, at, before = [], 0, 0
        for i, j in best(x.children, y.children, known)[1]:
            merged += x.children[at:i] + y.children[before:j]
            merged.append(x.children[i])
            stack.append((x.children[i], y.children[j]))
            for new in y.children[before:j]:
                met |= {id(n): n for n in new.below()}
            at, before = i + 1, j + 1
        for new in y.children[before:]:
            met |= {id(n): n for n in new.below()}
        x.children = merged + x.children[at:] + y.children[before:]
        x.pages, x.chars, x.linked = x.pages + y.pages, x.chars + y.chars, x.linked + y.linked
        if x.mark != y.mark:
            x.mark = None
        x.common &= y.common
    if size > MOST_NODES:
        prune(into)
    return met


def prune(root: Node) -> None:
    """Forgets the rarest nodes of a large wrapper, but none that more than half of the pages have."""
    nodes = root.below()
    if len(nodes) <= MOST_NODES:
        return
    least = min(sorted((n.pages for n in nodes), reverse=True)[MOST_NODES // 2], root.pages // 2)
    for node in nodes:
        node.children = [c for c in node.children if c.pages > least]


class Induction:
    """A wrapper for each host of a task. Pages of a shape seen before need no alignment."""

    def __init__(self):
        self.roots: dict[str, Node] = {}
        self.shapes: dict[tuple, list[Node]] = {}
        self.size = 0

    def add(self, host: str, page: Page) -> None:
        shape = (host, tuple(n[:2] for n in page.nodes))
        made = tree_of(page)
        root = self.roots.get(host)
        if shape in self.shapes:
            for node, new in zip(self.shapes[shape], made, strict=True):
                node.pages, node.chars, node.linked = node.pages + 1, node.chars + new.chars, node.linked + new.linked
                if node.mark != new.mark:
                    node.mark = None
                if node.common:
                    node.common &= new.common
            return
        self.size += len(made)
        if root is None:
            self.roots[host] = made[0]
            self.shapes[shape] = made
        else:
            met = merge(root, made[0])
            if len(self.shapes) < SHAPES:
                self.shapes[shape] = [met[id(n)] for n in made]


def _below(parents: list[int], roots: set[int]) -> list[bool]:
    """Which nodes are of the subtrees of some."""
    out = [False] * len(parents)
    for i, parent in enumerate(parents):
        out[i] = i in roots or parent >= 0 and out[parent]
    return out


def _sums(parents: list[int], weights: list) -> list:
    out = list(weights)
    for i in range(len(parents) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


class Weights:
    """What a wrapper tells of its nodes, by id: weight, the text of the slots below it on a page that has it; slot, whether it counts
    as one; aside, whether it is in a part that is no main text; links and text, how long they are below it."""

    __slots__ = ("weight", "slot", "aside", "links", "text", "pages", "settled")

    def __init__(self, root: Node):
        nodes = root.below()
        number = {id(n): i for i, n in enumerate(nodes)}
        parents = [-1] * len(nodes)
        for i, n in enumerate(nodes):
            for c in n.children:
                parents[number[id(c)]] = i
        tags = [n.key.partition(".")[0] for n in nodes]
        plain, varies = [n.chars - n.linked for n in nodes], [n.pages == 1 or n.mark is None for n in nodes]
        never = _below(parents, {i for i, n in enumerate(nodes) if n.aside == ALWAYS})
        told = _below(parents, {i for i, t in enumerate(tags) if t in ("article", "main")})
        fixed = sum(p for p, v, t, n in zip(plain, varies, told, never, strict=True) if t and not v and not n)
        slots = sum(p for p, v, n in zip(plain, varies, never, strict=True) if v and not n)
        copies = fixed > slots  # the pages are copies of an article
        slot = [v or copies and t or not slots and not copies for v, t in zip(varies, told, strict=True)]
        weigh = lambda aside: [t / n.pages for t, n in zip(_sums(parents, [p if c and not a else 0 for p, c, a in zip(plain, slot, aside, strict=True)]), nodes, strict=True)]
        # a name is believed unless the element holds more than half of the weight and no article or main element stands beside it
        weight = weigh(never)
        sure = _sums(parents, [int(t in ("article", "main") and not n) for t, n in zip(tags, never, strict=True)])
        light = [2 * weight[i] <= weight[0] or sure[0] > sure[i] for i in range(len(nodes))]
        named = {i for i, t in enumerate(tags) if light[i] and (nodes[i].aside == BY_NAME or t == "header" and not told[i])}
        aside = [a or b for a, b in zip(never, _below(parents, named), strict=True)]
        by_id = lambda values: {id(n): v for n, v in zip(nodes, values, strict=True)}
        self.weight, self.slot, self.aside = by_id(weigh(aside)), by_id(slot), by_id(aside)
        self.links, self.text = by_id(_sums(parents, [n.linked for n in nodes])), by_id(_sums(parents, [n.chars for n in nodes]))
        self.pages, self.settled = root.pages, any(n.mark is None for n in nodes)


class Choice:
    """What of a page is main text: inside, by node, and common, the marks of constant paragraphs by place."""

    __slots__ = ("inside", "common")

    def __init__(self, page: Page, wrapper: Node | None, weights: Weights | None = None):
        made, parents = tree_of(page), [parent for parent, _, _ in page.nodes]
        tags = [key.partition(".")[0] for _, key, _ in page.nodes]
        lone = Weights(made[0])
        if wrapper is None:
            wrapper, weights, own = made[0], lone, made
        else:
            weights = weights or Weights(wrapper)
            met = aligned(wrapper, made[0])
            own = [met.get(id(n), n) for n in made]
        of = lambda name: [getattr(weights, name).get(id(w), getattr(lone, name).get(id(w))) for w in own]
        weight, slot, links, texts = of("weight"), of("slot"), of("links"), of("text")
        aside = _below(parents, {i for i, a in enumerate(of("aside")) if a})
        region = {self._region(tags, parents, aside, weight)}
        inside = self._within(parents, tags, aside, weight, region)
        for i, tag in enumerate(tags):
            inside[i] = inside[i] and (i in region or inside[parents[i]])
            share = HINTED_SHARE if own[i].aside == IF_LINKED else LINK_SHARE if tag in LISTS else 1
            if inside[i] and i not in region and links[i] > share * texts[i]:
                inside[i] = False
        boxes = [i for i, w in enumerate(own) if inside[i] and w.mark and w.pages > 1 and not slot[i] and tags[i] not in SINGLE and tags[i] not in HOLDERS]
        if sum((own[i].chars - own[i].linked) / own[i].pages for i in boxes) <= sum(weight[i] for i in region):
            for i in boxes:
                inside[i] = False
        self.common = {i: w.common for i, w in enumerate(own) if weights.settled and w.common and w.pages >= WITNESSES and 2 * w.pages > weights.pages}
        if not any(stays and tag in HEADINGS for stays, tag in zip(inside, tags, strict=True)) and not any(tags[i] == "article" for i in region):
            titles = [i for i in range(min(region)) if tags[i] == "h1" and slot[i] and own[i].chars and not aside[i]]
            if titles:
                inside[titles[-1]] = True
        self.inside = inside

    @staticmethod
    def _region(tags, parents, aside, weight) -> int:
        """The node whose subtree is the main region."""
        children: dict[int, list[int]] = {}
        for i, parent in enumerate(parents):
            children.setdefault(parent, []).append(i)
        chain = [0]
        while True:
            inner = [i for i in children.get(chain[-1], ()) if not aside[i] and tags[i] not in PARTS]
            heavy = max(inner, key=lambda i: weight[i], default=None)
            if heavy is None or 2 * weight[heavy] <= weight[chain[-1]]:
                break
            chain.append(heavy)
        return next((i for tag in ("article", "main") for i in chain if tags[i] == tag), chain[-1])

    @staticmethod
    def _within(parents, tags, aside, weight, region: set[int]) -> list[bool]:
        """Which nodes are in the region and no aside. Articles that hold most of a region are put in its place."""
        below = _below(parents, region)
        (at,) = region
        if tags[at] != "article":
            articles = {i for i, t in enumerate(tags) if t == "article" and below[i] and not aside[i]}
            covered = _below(parents, articles)
            outer = {i for i in articles if not covered[parents[i]]}
            if outer and 2 * sum(weight[i] for i in outer) > weight[at]:
                region.clear()
                region |= outer
                below = _below(parents, outer)
        return [b and not a for b, a in zip(below, aside, strict=True)]


def extract(page: Page, wrapper: Node | None, weights: Weights | None = None, shapes: dict | None = None) -> str:
    """The main text of a page, given its host's wrapper and its weights. shapes: choices for pages of the wrapper's shapes."""
    shape = tuple(page.nodes)
    choice = shapes.get(shape) if shapes is not None else None
    if choice is None:
        choice = Choice(page, wrapper, weights)
        if shapes is not None and wrapper is not None and len(shapes) < SHAPES:
            shapes[shape] = choice
    inside, common, nodes = choice.inside, choice.common, page.nodes
    parts = [text if inside[node] else "" if nodes[node][1].partition(".")[0] in ASIDE_INLINE else " " for node, text, _ in page.flow]
    if common:
        blocks = [(first, end, n, mark in common.get(place, ())) for place, first, end, mark, n in page.blocks() if inside[page.flow[first][0]]]
        constant = sum(n for _, _, n, same in blocks if same)
        if constant and 2 * constant <= sum(n for _, _, n, _ in blocks):
            for first, end, _, same in blocks:
                if same:
                    parts[first:end] = [" "] * (end - first)
    return " ".join("".join(parts).split())


HOST = r"(?s)\A.*?://([^/?#]*)"
_WRAPPERS = "host string, salt int, wrapper string"
SALTS = 64


def _induce(batches):
    context = TaskContext.get()
    salt = context.partitionId() % SALTS if context else 0
    folded = Induction()

    def made():
        roots = folded.roots
        return pa.RecordBatch.from_pydict({"host": pa.array(list(roots), pa.string()), "salt": pa.array([salt] * len(roots), pa.int32()), "wrapper": pa.array([r.dump() for r in roots.values()], pa.string())})

    for batch in slices(batches):
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            folded.add(host, Page(source))
        if folded.size > HELD_NODES:
            yield made()
            folded = Induction()
    if folded.roots:
        yield made()


def _merged(batches):
    """Rows in order of host to one wrapper for each."""
    host = root = None
    for batch in slices(batches, 64):
        for name, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            other = Node.load(text)
            if name == host:
                merge(root, other)
                continue
            if root is not None:
                yield pa.RecordBatch.from_pydict({"host": [host], "salt": pa.array([0], pa.int32()), "wrapper": [root.dump()]})
            host, root = name, other
    if root is not None:
        yield pa.RecordBatch.from_pydict({"host": [host], "salt": pa.array([0], pa.int32()), "wrapper": [root.dump()]})


def _prepared(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def induce(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON of its nodes): a row for each host, from all of its pages. A host's wrappers merge in two steps, one at a time."""
    folded = _prepared(pages).where("host <> ''").select("host", "html").mapInArrow(_induce, _WRAPPERS)
    for keys in (["host", "salt"], ["host"]):
        folded = folded.repartition(*keys).sortWithinPartitions(*keys, "wrapper").mapInArrow(_merged, _WRAPPERS)
    return folded.select("host", "wrapper")


def main_text(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    wrappers = materialize(induce(pages) if wrappers is None else wrappers, "wrappers")
    total = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    rows, carried = _prepared(pages), None
    if total <= CARRIED_BYTES:
        carried = {r["host"]: r["wrapper"] for r in wrappers.collect()}
        discard(wrappers)
        rows = rows.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        rows = rows.join(wrappers, "host", "left")

    def run(batches):
        loaded: dict[str, tuple] = {}
        for batch in slices(batches):
            texts = []
            for host, source, given in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if host not in loaded:
                    if len(loaded) >= 256:
                        loaded.clear()
                    text = given if carried is None else carried.get(host)
                    root = Node.load(text) if text else None
                    loaded[host] = (root, Weights(root) if root else None, {})
                texts.append(extract(Page(source), *loaded[host]))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return rows.select("page_id", "url", "host", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
