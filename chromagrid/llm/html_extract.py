"""Main text of web pages by tree scoring.

A page is parsed to a tree, tolerant of missing and misplaced end tags.  Elements that are no
article by kind (menus, headers, footers, asides, forms, scripts and the like) or by what their
class, id or role says are left out.  Every paragraph earns points for its length and its
commas; they go to its parent whole, to the next ancestor by half, to the one above by a third,
and so on; an element's points are discounted by the share of its text that lies in links.
The best container is kept, widened to the article it lies in, with those of its siblings (or, for
an article, those of the other articles) that score a fifth of its points or more, and the paragraphs and headings beside them.
Of what is kept, elements left out by kind or name go; outside of an <article> or <main> also lists, tables
and boxes that are links by 60 % or more.  Within one, a doubtful name (DOUBT) needs that many links as a second
sign, paragraphs go by a plain name (OUT) only, and of a <header> the headings stay.

White space of any kind within a block becomes one blank; blocks and line breaks are joined by one
blank.  A null or empty page, or one without text outside of what is left out, gives an empty text.
Repeated rows give equal texts; url and further columns are passed through, but for one of the output's name, which it replaces.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is no markup.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROP = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "map", "datalist", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: A start tag of the key ends an open element of the values, up to the fence below.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
FENCE = {"ul", "ol", "dl", "table", "select", "body", "html"}
WHOLE = {"html", "body", "article", "main"}
#: Names that say an element is no article.
OUT = re.compile(r"(?<![a-z])(?:ad|ads|adv|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|menubar|sidebar|aside|footer|masthead|topbar|breadcrumbs?|crumbs|pagination|pager|comments?|commentlist|disqus|cookies?|consent|gdpr|notice|notices|notification|popup|modal|overlay|subscribe|subscription|newsletter|social|replies|respond|login|signup|copyright|contentinfo|hidden)(?![a-z])")
#: Names that say so outside of an article; within one it takes links as a second sign.
DOUBT = re.compile(r"(?<![a-z])(?:share|sharing|search|tags|legal|disclaimer|header|discussion|related|recommend\w*|widget|toolbar|rail|foot|alert|complementary)(?![a-z])")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
GOOD = re.compile(r"(?<![a-z])(?:article|content|entry|post|story|main|body|text|prose)(?![a-z])")
POINTS = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 3.0, "td": 2.0, "blockquote": 2.0}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd", "div", "section", "article", "main", "body"}


class Node:
    __slots__ = ("tag", "parent", "kids", "good", "out", "doubt", "within", "own", "size", "linked", "score")

    def __init__(self, tag: str, parent: Node | None, good: bool = False, out: bool = False, doubt: bool = False):
        self.tag, self.parent, self.good = tag, parent, good
        #: Lies in an article, or is one.
        self.within = tag in ("article", "main") or (parent is not None and parent.within)
        self.out, self.doubt = out or doubt and not self.within, doubt
        self.kids: list[Node | str] = []
        self.own: list[str] = []
        self.size = self.linked = 0
        self.score = 0.0


@functools.lru_cache(1 << 12)
def judged(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """(speaks for an article, speaks against, may speak against)."""
    if not attrs.strip():
        return False, False, False
    got: dict[str, str] = {}
    for k, a, b, c in ATTR.findall(attrs):
        got.setdefault(k.lower(), a or b or c)
    if "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", "").lower()):
        return False, True, False
    names = re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(got.get(k, "") for k in ("class", "id", "role"))).lower()
    good = bool(GOOD.search(names))
    return good, bool(OUT.search(names)) and tag not in WHOLE, bool(DOUBT.search(names)) and tag not in WHOLE


def tree(page: str) -> Node:
    root = node = Node("html", None)
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            node.kids.append(page[at:])
            break
        if m.start() > at:
            node.kids.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            if m[0].startswith("<![CDATA["):
                node.kids.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                if tag in INLINE and up.tag not in INLINE:
                    up = root
                    break
                up = up.parent
            if up is not root and up.tag == tag:
                node = up.parent
            elif tag in ("p", "br"):
                node.kids.append(Node("br", node))
            continue
        if tag in ("html", "body") and node is root or tag == "html":
            if tag == "body":
                node = Node("body", root, *judged(tag, m[3])[:2])
                root.kids.append(node)
            continue
        if tag not in INLINE:
            # a block ends an open paragraph and the inline elements within it
            up = node
            while up is not root and up.tag in INLINE:
                up = up.parent
            if up.tag == "p" and tag not in VOID:
                node = up.parent
            elif up.tag in HEADINGS and tag in HEADINGS:
                node = up.parent
        if tag in ENDS:
            up = node
            while up is not root and up.tag not in FENCE:
                if up.tag in ENDS[tag]:
                    node = up.parent
                up = up.parent
        good, out, doubt = judged(tag, m[3])
        new = Node(tag, node, good, out or tag in DROP and not (tag == "header" and node.within), doubt and tag != "p")
        node.kids.append(new)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            node = new
    return root


def measured(root: Node) -> list[Node]:
    """Elements in page order that aren't left out; sizes, links and own text are filled in."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [k for k in reversed(x.kids) if isinstance(k, Node) and not k.out]
    for x in reversed(order):
        for k in x.kids:
            if isinstance(k, str):
                text = k if "&" not in k else html.unescape(k)
                length = len(" ".join(text.split()))
                x.size += length
                x.own.append(text)
            elif not k.out:
                x.size += k.size
                x.linked += k.size if k.tag == "a" else k.linked
                if k.tag in INLINE:
                    x.own += k.own
    return order


def density(x: Node) -> float:
    return x.linked / x.size if x.size else 0.0


def best(order: list[Node]) -> Node | None:
    for x in order:
        x.score = POINTS.get(x.tag, 0.0) + (15.0 if x.good else 0.0)
    scored = set()
    for x in order:
        if x.tag not in PARAGRAPHS:
            continue
        text = " ".join("".join(x.own).split())
        if len(text) < 20:
            continue
        points = 1 + sum(text.count(c) for c in ",，、،") + min(len(text) / 100, 5.0)
        up = x if x.tag not in ("p", "pre", "li", "dd", "td", "blockquote") else x.parent
        far = 1
        while up is not None:
            up.score += points / far
            scored.add(id(up))
            up, far = up.parent, far + 1
    top = [x for x in order if id(x) in scored]
    return max(top, key=lambda x: x.score * (1 - density(x)), default=None)


def points(x: Node) -> float:
    """What paragraphs have given to an element, discounted by its links."""
    return (x.score - POINTS.get(x.tag, 0.0) - (15.0 if x.good else 0.0)) * (1 - density(x))


def article_of(x: Node | None) -> Node | None:
    """The nearest <article> or <main> around an element (itself, too) that isn't links by half."""
    while x is not None and not (x.tag in ("article", "main") and density(x) < 0.5):
        x = x.parent
    return x


def inside(x: Node, y: Node) -> bool:
    while x is not None and x is not y:
        x = x.parent
    return x is y


def kept(top: Node, order: list[Node]) -> list[Node]:
    """The best container, widened to the article it lies in, and its worthy siblings, in page order."""
    article = article_of(top)
    top = article or top
    least = 0.2 * points(top)
    worthy = lambda x: x is top or density(x) < 0.3 and points(x) >= least
    if article is not None:
        every: list[Node] = []
        for x in order:  # outer ones come first
            if x.tag == top.tag and x.size and worthy(x) and not any(inside(x, y) for y in every):
                every.append(x)
        if len(every) > 1:
            return every
    if top.parent is None:
        return [top]
    out = []
    for x in top.parent.kids:
        if isinstance(x, Node) and (x is top or not x.out and x.size):
            beside = x.tag in HEADINGS | {"p", "pre", "blockquote"} and density(x) < 0.5
            if beside or x is top or x.tag not in INLINE and worthy(x):
                out.append(x)
    return out


def text_of(nodes: list[Node]) -> str:
    out: list[str] = []
    #: (element or text, whether it lies in the header of an article and no heading)
    stack: list[tuple[Node | str, bool]] = [(x, False) for x in reversed(nodes)]
    while stack:
        x, head = stack.pop()
        if isinstance(x, str):
            if not head:
                out.append(x if "&" not in x else html.unescape(x))
            continue
        # lists of links are menus outside of an article; within one only by name
        menu = x.doubt if x.within else x.tag in ("ul", "ol", "table", "div", "section")
        if x.out or menu and x.size and density(x) >= 0.6 and x not in nodes:
            continue
        head = (head or x.tag == "header") and x.tag not in HEADINGS
        gap = x.tag not in INLINE
        if gap:
            out.append(" ")
            stack.append((" ", False))
        stack += [(k, head) for k in reversed(x.kids)]
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    order = measured(tree(page))
    top = best(order)
    if top is None:
        body = next((x for x in order if x.tag == "body"), order[0])
        return text_of([body])
    return text_of(kept(top, order))


def extracted(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html."""
    others = [c for c in pages.columns if c not in (html_col, out_col)]
    at = len(others)
    schema = T.StructType([*(pages.schema[c] for c in others), T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            texts = [main_text(x) for x in b.column(at).to_pylist()]
            yield pa.record_batch([*(b.column(i) for i in range(at)), pa.array(texts, pa.string())], names=[*others, out_col])

    return mapped(pages.select(*others, F.col(html_col).cast("string").alias(html_col)), run, schema)
