"""Main text of web pages by boosted trees over the nodes of the page and hierarchical decoding.

Every block-level node is described by its own and its ancestors' tags and attribute tokens, its
depth and place among its siblings, and the density of text, links, paragraphs and controls in its
subtree. Boosted trees give each node the probability of lying in the main text. Nodes aren't
judged alone: decoding looks for the best labelling of the whole tree in which a main part may hold
boilerplate but boilerplate holds no main part, and a change of label between parent and child has
its price, so that ancestors and descendants never contradict each other.

There are no labelled pages; the trees are trained on pages made here from a grammar of layouts
(wrappers, menus, adverts, notices, side columns, comments, forms, articles of every length) and on plain
pages: text, lines, paragraphs or table cells right in the body. Where the trees find no main part on
a page that holds prose, everything outside of menus, notices and the like is its main text.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tree import INLINE, Node, parse
from .trees import Boosted, boost

# Attribute tokens that pages commonly give to the parts of a layout.
GOOD = frozenset("article articlebody body content entry hentry main post story text page blog news paragraph prose readable".split())
BAD = frozenset("ad ads adv advert advertisement advertising banner bar bottom breadcrumb breadcrumbs btn button category combx comment comments community consent cookie copyright disclaimer disqus dock extra feedback foot footer footnote form gdpr head header hidden legal login masthead menu meta modal nav navbar navigation newsletter notice overlay pager pagination paywall popup privacy promo promoted recommend recommended related replies reply respond rss search share sharing shop side sidebar signup sitemap skip social sponsor sponsored subscribe tags teaser toolbar top tracking trending widget".split())
STRUCTURE = ("article", "main", "section", "div", "p", "nav", "aside", "footer", "header", "form", "ul", "li", "table", "td", "blockquote", "pre", "figure", "dl")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_TAGS = frozenset("nav aside footer header form menu dialog fieldset address".split())
CONTROLS = frozenset("input label output meter progress".split())
MAKES_BLOCK = re.compile(r"\s+")
TRAIN_PAGES, PLAIN_PAGES = 700, 150
PROSE = 80  # letters of a block that is read as prose where the trees find no main part
SWITCH = 2.0  # price of boilerplate inside a main part
START = 3.0  # price of a main part
SEED = 6
N_FEATURES = len(STRUCTURE) + 22


def describe(root: Node) -> tuple[list[Node], list[int], np.ndarray]:
    """Block-level nodes in document order, the index of each one's block-level parent, their features."""
    nodes: list[Node] = []
    parents: list[int] = []
    stats: list[list[float]] = []  # text, linked text, marks, paragraphs, paragraph text, items, controls, nodes, words
    depth: list[int] = []
    stack: list[tuple[Node, int, bool, int]] = [(root, -1, False, 0)]
    own: list[list[float]] = []
    while stack:
        node, parent, linked, level = stack.pop()
        block = node.tag not in INLINE
        if block:
            nodes.append(node)
            parents.append(parent)
            depth.append(level)
            own.append([0.0] * 9)
            parent = len(nodes) - 1
            level += 1
        s = own[parent]
        s[7] += 1
        s[6] += node.tag in CONTROLS
        linked |= node.tag == "a"
        for item in node.items:
            if isinstance(item, str):
                size = len(item) - (item.isspace() and len(item))
                s[0] += size
                s[8] += item.count(" ")
                if linked:
                    s[1] += size
                s[2] += item.count(",") + item.count(".")
        for item in reversed(node.items):
            if not isinstance(item, str):
                stack.append((item, parent, linked, level))
    n = len(nodes)
    stats = [list(s) for s in own]
    for k in range(n):
        if nodes[k].tag == "p":
            stats[k][3] += 1
            stats[k][4] += own[k][0]
        elif nodes[k].tag == "li":
            stats[k][5] += 1
    for k in range(n - 1, 0, -1):
        p = stats[parents[k]]
        for f, v in enumerate(stats[k]):
            p[f] += v
    children = [0] * n
    place = [0] * n
    same: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        place[k] = children[parents[k]]
        children[parents[k]] += 1
        key = (parents[k], nodes[k].tag)
        same[key] = same.get(key, 0) + 1
    x = np.zeros((n, N_FEATURES), np.float32)
    total = max(stats[0][0], 1)
    good, bad, bad_tag, in_main = [0] * n, [0] * n, [0] * n, [0] * n
    base = len(STRUCTURE)
    kinds = {t: i for i, t in enumerate(STRUCTURE)}
    for k, node in enumerate(nodes):
        p = parents[k]
        t, linked, marks, paragraphs, p_text, items, controls, count, words = stats[k]
        g = sum(w in GOOD for w in node.tokens)
        b = sum(w in BAD for w in node.tokens)
        up = p >= 0
        good[k] = (good[p] if up else 0) + (g > 0 and b == 0)
        bad[k] = (bad[p] if up else 0) + (b > 0)
        bad_tag[k] = (bad_tag[p] if up else 0) + (node.tag in BAD_TAGS)
        in_main[k] = (in_main[p] if up else 0) + (node.tag in ("article", "main"))
        row = x[k]
        if node.tag in kinds:
            row[kinds[node.tag]] = 1
        siblings = children[p] if up else 1
        row[base:] = (
            node.tag in HEADINGS, math.log1p(t), linked / max(t, 1), t / max(count, 1), marks / max(t, 1) * 50, math.log1p(paragraphs), p_text / max(t, 1), items / max(count, 1), controls, t / total,
            depth[k], siblings, place[k] / max(siblings, 1), same.get((p, node.tag), 0) / max(siblings, 1), g, b, good[k], bad[k], bad_tag[k], in_main[k],
            t / max(stats[p][0], 1) if up else 1, math.log1p(own[k][0]),
        )
    return nodes, parents, x


def decode(parents: list[int], probability: np.ndarray, weight: np.ndarray) -> list[bool]:
    """The best labelling of the tree: outside, main, or boilerplate, by node whether it is main."""
    n = len(parents)
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    yes, no = (np.log(p) * weight).tolist(), (np.log1p(-p) * weight).tolist()
    main, junk, outside = yes[:], no[:], no[:]
    for k in range(n - 1, 0, -1):
        up = parents[k]
        main[up] += max(main[k], junk[k] - SWITCH)
        junk[up] += junk[k]
        outside[up] += max(outside[k], main[k] - START)
    label = [0] * n  # 0 outside, 1 main, 2 boilerplate
    label[0] = 1 if main[0] - START > outside[0] else 0
    for k in range(1, n):
        up = label[parents[k]]
        if up == 2:
            label[k] = 2
        elif up == 1:
            label[k] = 1 if main[k] >= junk[k] - SWITCH else 2
        else:
            label[k] = 1 if main[k] - START > outside[k] else 0
    return [v == 1 for v in label]


def print_blocks(nodes: list[Node], chosen: list[bool]) -> str:
    """Text of the chosen nodes: a block per run of text between block-level borders."""
    if not any(chosen):
        return ""
    keep = {id(node): c for node, c in zip(nodes, chosen, strict=True)}
    blocks: list[str] = []
    piece: list[str] = []

    def border() -> None:
        if piece:
            block = MAKES_BLOCK.sub(" ", "".join(piece)).strip()
            if block:
                blocks.append(block)
            piece.clear()

    stack: list[tuple[Node | str | None, bool]] = [(nodes[0], False)]
    while stack:
        item, on = stack.pop()
        if item is None:
            border()
        elif isinstance(item, str):
            if on:
                piece.append(item)
        else:
            if item.tag in INLINE:
                if item.tag == "br" and on:
                    piece.append(" ")
            else:
                border()
                on = keep[id(item)]
                stack.append((None, on))
            stack.extend((child, on) for child in reversed(item.items))
    border()
    return "\n\n".join(blocks)


def extract(page: str, model: Boosted) -> str:
    return extract_many([page], model)[0]


def extract_many(pages: list[str], model: Boosted) -> list[str]:
    described = [describe(parse(p)) for p in pages]
    if not described:
        return []
    p = model.probability(np.vstack([x for _, _, x in described]))
    out, at = [], 0
    for nodes, parents, x in described:
        mine = p[at : at + len(nodes)]
        at += len(nodes)
        text = print_blocks(nodes, decode(parents, mine, 1 + x[:, len(STRUCTURE) + 1]))
        out.append(text or print_blocks(nodes, prose(nodes, parents)))
    return out


def prose(nodes: list[Node], parents: list[int]) -> list[bool]:
    """Where no main part was found: the nodes outside of menus, notices and the like, if any text in them stands
    for prose, that is, has PROSE letters or more between two borders of which less than half are links."""
    chosen: list[bool] = []
    found = False
    for node, up in zip(nodes, parents, strict=True):
        around = node.tag in BAD_TAGS or node.tag in CONTROLS or any(w in BAD for w in node.tokens)
        chosen.append(not around and (up < 0 or chosen[up]))
        if chosen[-1]:
            text, linked = _run(node)
            found |= text >= PROSE and 2 * linked < text
    return chosen if found else [False] * len(nodes)


def _run(node: Node) -> tuple[int, int]:
    """Letters right in a block, inline elements included, and those of them in links."""
    text = linked = 0
    stack: list[tuple[Node | str, bool]] = [(item, False) for item in node.items]
    while stack:
        item, link = stack.pop()
        if isinstance(item, str):
            size = sum(map(str.isalnum, item))
            text += size
            linked += size * link
        elif item.tag in INLINE:
            stack.extend((x, link or item.tag == "a") for x in item.items)
    return text, linked


class Grammar:
    """Pages of many layouts whose nodes carry data-judge = 1 in the main text and 0 elsewhere."""

    def __init__(self, seed: int = SEED):
        self.r = random.Random(seed)
        self.vocabulary = ["".join(self.r.choice("bcdfglmnprst") + self.r.choice("aeiou") for _ in range(self.r.randint(1, 4))) for _ in range(800)]

    def words(self, low: int, high: int) -> str:
        r = self.r
        n = int(math.exp(r.uniform(math.log(low), math.log(high))))
        out, style = [], r.random()
        while len(out) < n:
            size = min(r.randint(3, 18), n - len(out))
            some = [r.choice(self.vocabulary) for _ in range(size)]
            some[0] = some[0].capitalize()
            if style < 0.05:
                some = [w.upper() + "!!" for w in some]
            elif style < 0.1:
                some = [w + r.choice(["***", "$$$", "%%%"]) for w in some]
            elif size > 6 and r.random() < 0.5:
                some[3] += ","
            some[-1] += "."
            out += some
        return " ".join(out)

    def tag(self, name: str, inside: str, main: int, names: str = "", close: bool = True) -> str:
        r = self.r
        attribute = ""
        if names and r.random() < 0.8:
            pick = r.choice(names.split())
            if r.random() < 0.3:
                pick += r.choice(["-wrap", "-box", "_inner", " clearfix", " col", "-1"])
            attribute = f' {r.choice(["class", "class", "id"])}="{pick}"'
        return f'<{name}{attribute} data-judge="{main}">{inside}' + (f"</{name}>" if close else "")

    def links(self, low: int, high: int, separate: str = "") -> str:
        return separate.join(self.tag("li" if not separate else "span", f'<a href="/{self.r.choice(self.vocabulary)}">{self.words(1, 4)[:-1]}</a>', 0) for _ in range(self.r.randint(low, high)))

    def junk(self) -> str:
        r = self.r
        kind = r.randint(0, 9)
        if kind == 0:
            return self.tag(r.choice(["nav", "nav", "div"]), self.tag("ul", self.links(3, 12), 0, "menu nav list"), 0, "menu nav navbar navigation breadcrumb toc")
        if kind in (1, 2):
            inside = self.words(3, 40) if r.random() < 0.6 else self.tag("p", self.words(3, 40), 0) * r.randint(1, 2)
            return self.tag(r.choice(["div", "div", "aside", "section"]), inside, 0, "ad ads advert banner sponsored promo advertisement promoted")
        if kind == 3:
            return self.tag(r.choice(["div", "section"]), self.tag("p", self.words(5, 40), 0) + '<input data-judge="0"/>', 0, "cookie notice consent newsletter gdpr popup subscribe")
        if kind == 4:
            boxes = "".join(self.tag(r.choice(["div", "section"]), self.tag("h3", self.words(1, 4), 0) + self.tag("ul", self.links(2, 8), 0) + self.tag("p", self.words(4, 30), 0) * r.randint(0, 1), 0, "widget related recommended trending") for _ in range(r.randint(1, 4)))
            return self.tag(r.choice(["aside", "aside", "div"]), boxes, 0, "sidebar side related widget")
        if kind == 5:
            said = "".join(self.tag(r.choice(["div", "li", "article"]), self.tag("b", self.words(1, 2), 0) + self.tag("p", self.words(3, 90), 0) * r.randint(1, 2), 0, "comment reply") for _ in range(r.randint(1, 6)))
            return self.tag(r.choice(["div", "section", "ol"]), (self.tag("h3", self.words(1, 3), 0) if r.random() < 0.6 else "") + said, 0, "comments replies disqus respond")
        if kind == 6:
            return self.tag("form", f'<label>{self.words(1, 4)}</label><input data-judge="0"/><button>{self.words(1, 2)}</button>' + (self.tag("p", self.words(4, 25), 0) if r.random() < 0.5 else ""), 0, "search login signup form")
        if kind == 7:
            return self.tag("div", self.links(3, 6, " | "), 0, "share social tags pager pagination")
        if kind == 8:
            return self.tag(r.choice(["header", "div"]), (self.tag("h1", self.words(1, 4), 0) if r.random() < 0.4 else self.tag("div", self.words(1, 5), 0, "logo masthead")) + (self.tag("p", self.words(2, 10), 0) if r.random() < 0.5 else ""), 0, "header masthead top head")
        return self.tag(r.choice(["footer", "footer", "div"]), "&copy; " + self.words(2, 30) + (self.tag("p", self.words(3, 25), 0) if r.random() < 0.5 else "") + (self.tag("ul", self.links(2, 6), 0) if r.random() < 0.4 else ""), 0, "footer foot copyright bottom legal")

    def article(self) -> str:
        r = self.r
        close = r.random() < 0.7
        parts = [self.tag("h1", self.words(2, 14)[:60], 1)] if r.random() < 0.85 else []
        same = self.words(4, 120)
        repeat = r.random() < 0.08
        for _ in range(int(math.exp(r.uniform(0, 3.4)))):
            k = r.random()
            text = same if repeat else self.words(1, 160)
            if r.random() < 0.15:
                text = f"<b>{text}" + ("</b>" if r.random() < 0.5 else "<br>")
            if r.random() < 0.1:
                text += f' <a href="/x">{self.words(1, 5)}</a>'
            if k < 0.8:
                parts.append(self.tag("p", text, 1, close=close))
            elif k < 0.87:
                parts.append(self.tag("h2", self.words(1, 8), 1))
            elif k < 0.91:
                parts.append(self.tag("ul", "".join(self.tag("li", self.words(2, 25), 1) for _ in range(r.randint(2, 6))), 1))
            elif k < 0.94:
                parts.append(self.tag("blockquote", self.tag("p", text, 1), 1))
            elif k < 0.97:
                parts.append(self.tag("div", self.words(8, 80), 1))
            else:
                parts.append(self.tag("pre", self.words(4, 40), 1))
        if r.random() < 0.35:
            for _ in range(r.randint(1, 3)):
                parts.insert(r.randint(0, len(parts)), self.junk())
        name, names = r.choice([("article", ""), ("article", "post entry article"), ("main", "content main"), ("div", "content article post entry story main"), ("section", "content post article"), ("div", "")])
        body = self.tag(name, "".join(parts), 1, names)
        if r.random() < 0.2:
            body = self.tag(r.choice(["main", "div", "section"]), body, 1, "content main page")
        return body

    def page(self) -> str:
        r = self.r
        before = [self.junk() for _ in range(r.randint(0, 4))]
        after = [self.junk() for _ in range(r.randint(0, 4))]
        body = self.article() if r.random() < 0.97 else ""
        k = r.randint(0, len(after))
        inside = "".join(before[1:] + [body] + after[:k])
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            inside = self.tag("div", inside, 0, "wrapper container page row site outer")
        return f"<html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>{''.join(before[:1])}{inside}{''.join(after[k:])}</body></html>"

    def plain(self) -> tuple[str, str]:
        """A page without an article of its own: text, lines, paragraphs or table cells right in the body or in plain
        boxes, with little around them; and the judgement of the body."""
        r = self.r
        kind = r.randint(0, 5)
        texts = [self.words(6, 160) for _ in range(r.randint(2, 12))]
        lines = r.choice(["<br>", "<br><br>", "<br/>\n<br/>"]).join(texts)
        paragraphs = "".join(self.tag("p", t, 1, close=r.random() < 0.8) for t in texts)
        heading = self.tag(r.choice(["h1", "h2"]), self.words(2, 10)[:60], 1) if r.random() < 0.5 else ""
        if kind == 0:
            inside = heading + (lines if r.random() < 0.7 else " ".join(texts))
        elif kind in (1, 2):
            inside = heading + paragraphs
        elif kind == 3:
            inside = self.tag("div", heading + lines, 1)
        elif kind == 4:
            cells = "".join(self.tag("tr", self.tag("td", t if r.random() < 0.5 else self.tag("p", t, 1), 1), 1) for t in texts)
            inside = heading + self.tag("table", cells, 1)
        else:
            inside = heading + paragraphs
            for _ in range(r.randint(3, 40)):
                inside = self.tag("div", inside, 1)
        junk = [self.junk() if r.random() < 0.4 else "" for _ in range(2)]
        return f"<html><body>{junk[0]}{inside}{junk[1]}</body></html>", "1" if kind < 3 else "0"


@functools.cache
def trained(pages: int = TRAIN_PAGES, plain: int = PLAIN_PAGES) -> Boosted:
    grammar, other = Grammar(), Grammar(SEED + 1)
    xs, ys = [], []
    for page, body in [*((grammar.page(), "0") for _ in range(pages)), *(other.plain() for _ in range(plain))]:
        nodes, _, x = describe(parse(page))
        nodes[0].judge = body
        xs.append(x)
        ys += [float(node.judge == "1") for node in nodes]
    return boost(np.vstack(xs).astype(np.float64), np.array(ys))


def main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """Main text of each row of ``pages`` (page_id, url, html; other columns are ignored).

    Returns page_id, url, text, n_chars. Null html counts as empty; a page without a main part gives
    an empty text. Broken markup is read as browsers do in the common cases; elements nested more than
    512 deep (html_tree.DEEPEST) count as siblings, with all their text. Rows are treated one by
    one, so repeated rows and null ids need no rule; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # sixty small trees

    def run(batches):
        for batch in batches:
            got = []
            rows = batch["html"].tolist()
            for k in range(0, len(rows), 100):
                got += extract_many(rows[k : k + 100], shared.value)
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": got, "n_chars": [len(t) for t in got]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
