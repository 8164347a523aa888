"""A forgiving HTML parser that builds a tree with text, enough for judging and printing its parts."""

from __future__ import annotations

import html
import re

START = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"(?<![^\s=/\"'])([^\s=/\"']++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
TOKEN = re.compile(r"[a-z]+")
DEEPEST = 512  # elements nested deeper become siblings, as in browsers
JUDGED = ("class", "id", "role", "itemprop", "aria-label")

# Element names of the HTML standard by how they are parsed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style textarea title iframe noembed noframes noscript template select option button svg math object canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl menu table".split())
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


class Node:
    __slots__ = ("items", "judge", "parent", "tag", "tokens")

    def __init__(self, tag: str, tokens: list[str], parent: Node | None, judge: str | None = None):
        self.tag, self.tokens, self.parent, self.judge = tag, tokens, parent, judge
        self.items: list[Node | str] = []


class Tags:
    """The tags of a page in order: (start, end, whether it closes, name or None, attributes), in linear time."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def after(self, pos: int) -> tuple[int, int, bool, str | None, str] | None:
        page = self.page
        m = START.search(page, pos)
        if m is None:
            return None
        if m[2] is None and page.startswith("<!--", m.start()):
            end = page.find("-->", m.start() + 4)
            return m.start(), len(page) if end < 0 else end + 3, False, None, ""
        if m[2] is not None and self.quotes:
            close = QUOTED.match(page, m.end())
            if close is not None:
                return m.start(), close.end(), bool(m[1]), m[2].lower(), page[m.end() : close.end() - 1]
            self.quotes = False  # a quote that never ends: from here on quotes don't count
        end = page.find(">", m.end())
        if end < 0:
            return None  # nothing ends any more
        return m.start(), end + 1, bool(m[1]), m[2] and m[2].lower(), page[m.end() : end]


class Builder:
    """The tree while it grows, with counts of open elements, so that no search goes further than DEEPEST."""

    def __init__(self) -> None:
        self.root = self.top = Node("html", [], None)
        self.open: dict[str, int] = {}
        self.deeper: dict[str, int] = {}  # those nested too deep to be opened
        self.depth = 0

    def push(self, node: Node) -> None:
        if self.depth < DEEPEST:
            self.top = node
            self.depth += 1
            self.open[node.tag] = self.open.get(node.tag, 0) + 1
        else:
            self.deeper[node.tag] = self.deeper.get(node.tag, 0) + 1

    def pop_to(self, node: Node) -> None:
        """Close all down to this one, itself included."""
        while True:
            last = self.top
            self.open[last.tag] -= 1
            self.depth -= 1
            self.top = last.parent
            if last is node:
                return

    def end(self, name: str) -> None:
        if self.deeper.get(name):
            self.deeper[name] -= 1
            return
        if not self.open.get(name):
            return
        node = self.top
        while node.tag != name:
            if name in INLINE and node.tag not in INLINE:
                return
            node = node.parent
        self.pop_to(node)

    def make_room(self, name: str) -> None:
        """Close what a start tag of this name ends."""
        if name in CLOSES_P and self.open.get("p"):
            node = self.top
            while node.tag in INLINE:
                node = node.parent
            if node.tag == "p":
                self.pop_to(node)
        ended = SIBLINGS.get(name, ())
        if any(self.open.get(t) for t in ended):
            node, stop = self.top, None
            while node is not self.root and node.tag not in LISTS:
                if node.tag in ended:
                    stop = node
                node = node.parent
            if stop is not None:
                self.pop_to(stop)


def parse(page: str) -> Node:
    """The tree of a page under a root named html; text is unescaped, hidden elements are left out."""
    tree, tags = Builder(), Tags(page)
    root = tree.root
    hidden: list[str] = []
    at, n = 0, len(page)

    def text(piece: str) -> None:
        if piece and not hidden:
            tree.top.items.append(html.unescape(piece) if "&" in piece else piece)

    while (tag := tags.after(at)) is not None:
        start, end, closes, name, rest = tag
        text(page[at:start])
        at = end
        if name is None:
            continue
        if name in ("html", "body"):
            if not closes and rest:
                root.tokens += _tokens(rest)
            if name == "body":
                hidden.clear()  # an unclosed head
        elif closes:
            if not hidden:
                tree.end(name)
            elif name in hidden:
                while hidden.pop() != name:
                    pass
        elif name in RAW:
            stop = RAW_END[name].search(page, at)
            at = stop.end() if stop else n
        elif hidden or name in HIDDEN:
            if name in HIDDEN and name not in VOID and not rest.endswith("/") and len(hidden) < DEEPEST:
                hidden.append(name)
        else:
            tree.make_room(name)
            tokens = _tokens(rest) if rest else []
            judge = dict((a[0], a[1]) for a in ATTRIBUTE.findall(rest)).get("data-judge") if "data-judge" in rest else None
            node = Node(name, tokens, tree.top, judge)
            tree.top.items.append(node)
            if name not in VOID and not (rest.endswith("/") and name not in CLOSES_P):
                tree.push(node)
    last = page[at:]
    if (cut := re.search(r"<[a-zA-Z!/?]", last)) is not None and ">" not in last[cut.start() :]:
        last = last[: cut.start()]
    text(last)
    return root


def _tokens(raw: str) -> list[str]:
    out: list[str] = []
    for name, a, b, c in ATTRIBUTE.findall(raw):
        if name.lower() in JUDGED:
            out += TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())
    return out
