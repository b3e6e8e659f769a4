"""Main text of web pages: paragraphs give points to the containers above them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from emberline.llm.common import let_go, octets, slices

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")

#: Elements without content, with raw text, and those that stand in a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text, and those that do.
DROPPED = RAW | frozenset("head nav footer aside form button select option input dialog menu object audio video canvas".split())
MAIN = frozenset(("article", "main"))
#: Words in class, id or role that name reader comments, what else surely surrounds the main text, and what mostly does.
REMARKS = frozenset("comment comments commentlist disqus reply replies respond response responses talkback".split())
SURE = frozenset("nav navigation navbar menu submenu sidebar aside footer masthead banner cookie cookies consent gdpr ad ads adv "
                 "advert adverts advertisement advertising adsense breadcrumb breadcrumbs pagination pager complementary "
                 "contentinfo newsletter".split())
MOSTLY = frozenset("notice notices alert sponsor sponsored promo promotion share sharing social related recommended subscribe "
                   "subscription signup login popup modal overlay widget form search searchbox toolbar dialog skip hidden "
                   "paywall".split())
#: Words beside them that change nothing, those that turn a name into a remark on the layout, and names of the text itself.
NEUTRAL = frozenset("site page main global top bottom left right upper lower primary secondary list item items box block container "
                    "wrapper wrap area bar link links button buttons posts stories section group slot unit inner outer row "
                    "holder panel title".split())
LAYOUT = frozenset("no not has with without is enabled disabled free".split())
TEXT = frozenset("content article post entry hentry story main text".split())
#: The share of a page's points from which a marked element is no surrounding, by kind of its mark (comments: never).
MOST = {"sure": 0.8, "mostly": 0.5}
#: What a name that only contains such a word leaves of an element's points.
DOUBT = 0.7
#: Elements that belong to a text they stand beside.
FLOW = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 table ul ol dl figure".split())
#: Opening one of the first closes an open one of the second, up to the third.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
          "tbody": (("thead", "tbody", "tr"), ("table",)), "option": (("option",), ("select",))}
SCOPE = frozenset("body article main section div td th table li blockquote aside nav header footer form ul ol dl button object".split())
SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")


#: Elements nested deeper than this count as text of the one above, as in browsers.
DEEPEST = 256


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "mark", "points", "chars", "linked", "texts", "depth")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, mark: str | None = None):
        self.tag, self.parent, self.dropped, self.mark = tag, parent, dropped, mark
        self.children: list[Node | str | None] = []
        self.points, self.chars, self.linked, self.texts = 0.0, 0, 0, 0
        self.depth = parent.depth + 1 if parent is not None else 0
        if parent is not None:
            parent.children.append(self)


def _hidden(rest: str) -> bool:
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _mark(rest: str) -> str | None:
    """What an element's names say: "remarks", "sure", "mostly", "doubt" or nothing.

    A name counts in full if each of its words is a marking or a neutral one (sidebar, site-footer); beside a
    name of the text itself only if it is a single word. Names on the layout (no-sidebar, has-comments) say nothing.
    """
    found, doubt = set(), False
    names = [n for name, *values in ATTRIBUTE.findall(rest) if name.lower() in ("class", "id", "role")
             for n in html.unescape("".join(values)).split()]
    is_text = any(n.lower() in TEXT for n in names)
    for n in names:
        words = [w.lower() for w in SPLIT.split(n) if w]
        kinds = {"remarks" if w in REMARKS else "sure" if w in SURE else "mostly"
                 for w in words if w in REMARKS or w in SURE or w in MOSTLY}
        if not kinds or any(w in LAYOUT for w in words):
            continue
        whole = all(w in REMARKS or w in SURE or w in MOSTLY or w in NEUTRAL for w in words)
        if whole and (len(words) == 1 or not is_text):
            found |= kinds
        else:
            doubt = True
    return next((k for k in ("remarks", "sure", "mostly") if k in found), "doubt" if doubt else None)


def parse(page: str) -> Node:
    """The tree of a page. Left-out end tags are supplied; stray ones are passed over; nothing is fatal."""
    root = Node("body", None)
    at, node, n = 0, root, len(page)
    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            cut = n
        if cut > at:
            node.children.append(html.unescape(page[at:cut]))
            at = cut
            continue
        m = TOKEN.match(page, at)
        if m is None:
            node.children.append("<")
            at += 1
            continue
        at = m.end()
        if m["cdata"] is not None:
            node.children.append(m["cdata"])
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            walk = node
            while walk is not None and walk.tag != tag and not (tag in INLINE and walk.tag in SCOPE):
                walk = walk.parent
            if walk is not None and walk.tag == tag and walk is not root:
                node = walk.parent
            continue
        rest = m["rest"] if m["rest"] is not None else m["rest2"] or ""
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                node.children.append(None)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if not rest.endswith("/") or tag not in ("svg", "math"):
                at = end.end() if end else n
            if tag not in ("svg", "math"):
                node.children.append(None)
            continue
        if tag not in INLINE:
            names, stop = CLOSES.get(tag, (("p",), SCOPE))
            for closing, bound in ((names, stop), (("p",), SCOPE)):
                walk = node
                while walk is not None and walk.tag not in closing and walk.tag not in bound:
                    walk = walk.parent
                if walk is not None and walk.tag in closing and walk is not root:
                    node = walk.parent
            if node.tag == "head" and tag not in ("base", "link", "meta"):
                node = node.parent
        inside = node
        while inside is not None and inside.tag not in MAIN:
            inside = inside.parent
        mark = _mark(rest) if rest.strip(" /") else None
        if tag in MAIN and mark not in ("remarks", "sure"):
            mark = None
        dropped = node.dropped or tag in DROPPED or (tag == "header" and inside is None) or _hidden(rest)
        if node.depth >= DEEPEST:
            dropped = dropped or mark in ("remarks", *MOST)
        if node.depth < DEEPEST or dropped > node.dropped:
            node = Node(tag, node, dropped, mark)
        elif tag not in INLINE:
            node.children.append(None)
    return root


def _own_runs(node: Node) -> list[tuple[str, int]]:
    """Texts of the blocks directly in a node, with their characters inside links."""
    runs: list[tuple[list[str], list[int]]] = [([], [0])]

    def walk(x: Node, link: bool) -> None:
        for c in x.children:
            if c is None:
                runs[-1][0].append(" ")
            elif isinstance(c, str):
                runs[-1][0].append(c)
                if link:
                    runs[-1][1][0] += len("".join(c.split()))
            elif c.dropped:
                continue
            elif c.tag in INLINE:
                walk(c, link or c.tag == "a")
            else:
                runs.append(([], [0]))

    walk(node, False)
    out = [(" ".join("".join(parts).split()), linked[0]) for parts, linked in runs]
    return [(t, k) for t, k in out if t]


def blocks(node: Node, out: list[str]) -> None:
    """Texts of a node's blocks in page order."""
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    def walk(x: Node) -> None:
        for c in x.children:
            if c is None:
                close()
            elif isinstance(c, str):
                run.append(c)
            elif not c.dropped:
                if c.tag not in INLINE:
                    close()
                walk(c)
                if c.tag not in INLINE:
                    close()

    walk(node)
    close()


def _all(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    return out


def _worth(text: str, linked: int) -> float:
    """Points of a block: one, one for each comma and up to three for its length, less its share inside links."""
    size = len(text.replace(" ", ""))
    return (1 + sum(text.count(c) for c in ",،、，") + min(len(text) / 100, 3)) * (1 - min(1, linked / max(size, 1)))


def settle(root: Node) -> None:
    """Drops the marked elements that do not hold most of the points of the page.

    Reader comments go whatever they hold, and do not count as points of the page. Where an article or
    main element with text stands outside a marked one, the mark decides.
    """
    nodes = _all(root)
    for x in nodes:
        x.dropped = x.dropped or x.mark == "remarks" or (x.parent is not None and x.parent.dropped)
    if not any(x.mark in MOST and not x.dropped for x in nodes):
        return
    points: dict[Node, float] = dict.fromkeys(nodes, 0.0)
    main: dict[Node, float] = dict.fromkeys(nodes, 0.0)
    for x in nodes:
        if not x.dropped and x.tag not in INLINE:
            points[x] = sum(_worth(t, k) for t, k in _own_runs(x))
    for x in reversed(nodes):
        main[x] = points[x] if x.tag in MAIN and x.mark not in MOST else main[x]
        if x.parent is not None:
            points[x.parent] += points[x]
            main[x.parent] += main[x]
    for x in nodes:
        if x.parent is not None and x.parent.dropped:
            x.dropped = True
        elif x.mark in MOST and not x.dropped:
            x.dropped = points[x] < MOST[x.mark] * points[root] or main[root] > main[x]
            inside = x.parent
            while x.dropped is False and inside is not None:
                if inside.tag in MAIN:                     # part of an article: the mark decides
                    x.dropped = True
                inside = inside.parent


def score(root: Node) -> list[Node]:
    """Gives every container its points and returns the containers that got some.

    The container of a block gets its whole worth, the next above half, then a third, and so on; a
    container whose name casts doubt keeps a part of its points.
    """
    nodes = [x for x in _all(root) if not x.dropped and x.tag not in INLINE]
    scored: dict[Node, None] = {}
    for x in nodes:
        for text, linked in _own_runs(x):
            size = len(text.replace(" ", ""))
            worth = _worth(text, linked)
            holder = x.parent if x.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "dd", "dt") and x.parent else x
            if x.tag in ("li", "td", "dd", "dt") and holder.parent:
                holder = holder.parent
            up, share = holder, 1
            while up is not None and share <= 4:
                if up.tag not in INLINE:
                    scored[up] = None
                    up.points += worth / share
                    share += 1
                up = up.parent
            up = x
            while up is not None:
                up.chars += size
                up.linked += linked
                up.texts += 1
                up = up.parent
    for x in scored:
        x.points *= (1 - x.linked / max(x.chars, 1)) * (DOUBT if x.mark == "doubt" else 1)
    return list(scored)


def main_text(page: str) -> str:
    """The text of the best container and of those siblings that belong to it; '' if there is none."""
    root = parse(page)
    settle(root)
    scored = score(root)
    if not scored:
        return ""
    best = max(scored, key=lambda x: x.points)
    above = best
    while above is not None and above.tag not in MAIN:
        above = above.parent
    if above is not None:
        best = above
    kept: list[Node] = [best]
    if best.parent is not None:
        limit = max(5.0, best.points / 5)
        kept = []
        for c in best.parent.children:
            if not isinstance(c, Node) or c.dropped:
                continue
            density = c.linked / max(c.chars, 1)
            same = c.tag == best.tag and best.tag in MAIN
            text = c.tag in FLOW and best.tag not in MAIN and density < 0.3
            if c is best or text or same or (c.points >= limit and density < 0.5):
                kept.append(c)
    out: list[str] = []
    for c in kept:
        blocks(c, out)
    return " ".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of pages, from the whole html, without a shuffle.

    A null or empty page, and one without main text, has the empty text. Broken and cut-off markup
    is read as far as it goes. Repeated rows come back as often as given.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in let_go(batches):
            for part in slices(batch, 2):
                texts = [main_text(p.decode("utf-8", "replace")) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    return pages.select(id_col, url_col, octets(html_col).alias("h")).mapInArrow(
        run, ", ".join([*kinds, "text string, n_chars long"]))
