"""Main text of web pages by composite text density (Sun, Song and Liao 2011).

For every DOM node: C characters, LC of them in links, T tags, LT of them links, below it. Its density is
    C / T * log_b(C / LC * T / LT),   b = ln(C / (C - LC) * LC + LCb / Cb * C + e),
with LCb / Cb the link share of the body, so that text in many tags or in links weighs little. A node's density sum adds
up the densities of its block children; the node with the largest sum holds the content. The smallest density on its path to the
body is the page's threshold: other nodes of the body, or of the <main> around the text, whose density reaches it, such as
a long heading beside the text or a second article, contribute their own largest-sum subtree too.

An article in parts has its largest sum in one part. So the content grows upwards: as long as the parent is not the body, and
what else it holds has few links and no more text than the content so far, the parent is the content. An <article> or <main>
is never left that way.

Nodes that are never content by their tag, role, class or id go before: menus, page headers and footers, sidebars,
notices, adverts, forms, reader comments, scripts and styles. A class or id counts only as a whole, and not on a node that
holds most of the page's text outside links. Inside an article (<main> on pages without one) only adverts' and reader
comments' names do; a node of another such name goes there only if its links say so too. An attribute's quote that is not
closed before white space, / or > ends at the tag's first >.

Null, empty and tag-less pages: an empty page has an empty text; plain text without any tag is its own text. Broken
markup never fails: end tags are implied as browsers imply them. Repeated rows are read each by itself; empty tables give
empty results; other columns pass through, but for the names text and n_chars.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slim

#: Fixed values of HTML: elements without content, raw text elements, block elements, implied ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption li dd dt tbody td tfoot th thead tr option optgroup legend".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: Never content, by tag, role, or the words of a class or id.
DROP_TAGS = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe object embed svg canvas audio video dialog menu search noembed noframes fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion alert disclaimer rail cookie cookies consent gdpr notice notices notification popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer masthead comment comments commentlist discussion disqus guestbook reactions remark remarks replies reply respond responses talkback feedback opinion opinions share sharing social newsletter subscribe subscription signup login search related recommended recommendations pagination pager toolbar skip".split()
)
#: Words beside those that leave a class or id what it is: names of boxes and places.
BOX_WORDS = frozenset("area articles bar block bottom box btn button buttons center col column container fixed form global group holder inline inner items left link links list main mobile outer page panel posts reader readers region right section site slot sticky stories top unit user users visitor visitors wrap wrapper zone".split())
HEADER_WORDS = frozenset("header topbar".split())
#: Readers' words: beside an article they are not content, however long.
READER_WORDS = frozenset("comment comments commentlist discussion disqus guestbook reactions remark remarks replies reply respond responses talkback feedback opinion opinions".split())
#: Names that say enough inside an article: adverts, and lists of readers' comments.
SURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored comment comments commentlist discussion disqus guestbook".split())
LINKED = 3  # a third of a node's text in links tells furniture from text
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+(?=>)|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "named", "chars", "link_chars", "tags", "link_tags", "density", "total", "best")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, named: frozenset[str] = frozenset()):
        self.tag, self.parent, self.drop, self.named = tag, parent, drop, named
        self.items: list[Node | str] = []
        self.density = self.total = 0.0


def unwanted(tag: str, attributes: str, node: Node) -> bool:
    if tag in DROP_TAGS:
        return True
    if tag == "header":  # an article's own header holds its title
        up: Node | None = node
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        if up is None:
            return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name == "role" and value.lower() in DROP_ROLES:
            return True
    return False


def named(tag: str, attributes: str, node: Node) -> frozenset[str]:
    """The words by which a class or the id says that this is no content. A class or id counts as a whole: each of its
    words must be such a word or name a box, so that has-sidebar or search-result says nothing."""
    found: set[str] = set()
    if attributes and tag not in ("html", "body", "article", "main"):
        for m in _ATTRIBUTE.finditer(attributes):
            if m[1].lower() in ("class", "id"):
                for token in (m[2] or m[3] or m[4] or "").split():
                    words = set(_NAME.findall(_CAMEL.sub(" ", token).lower()))
                    said = words - BOX_WORDS
                    if said and (said <= DROP_WORDS or said <= DROP_WORDS | HEADER_WORDS and not any(n.tag in ("article", "main") for n in _up(node))):
                        found |= said
    return frozenset(found)


def parse(source: str) -> Node:
    root = Node("#root", None)
    at, node, i = root, root, 0

    def text(raw: str) -> None:
        if raw:
            at.items.append(entities.unescape(raw) if "&" in raw else raw)

    while (m := _TOKEN.search(source, i)) is not None:
        text(source[i : m.start()])
        i = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = at
            stop = BLOCK if tag not in BLOCK else ()
            while node is not root and node.tag != tag and not (stop and node.tag in ("td", "th", "table", "article", "body")):
                node = node.parent
            if node is not root and node.tag == tag:
                at = node.parent
            continue
        if tag in CLOSES_P:
            node = at
            while node is not root and node.tag != "p" and (node.tag not in BLOCK):
                node = node.parent
            if node.tag == "p":
                at = node.parent
        if tag in IMPLIED:
            node, ends = at, None
            while node is not root and node.tag not in SCOPE.get(tag, ()):
                if node.tag in IMPLIED[tag]:
                    ends = node
                node = node.parent
            if ends is not None:
                at = ends.parent
        if tag in ("html", "body") and any(n.tag == tag for n in _up(at)):
            continue
        child = Node(tag, at, unwanted(tag, m[3], at), named(tag, m[3], at))
        at.items.append(child)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(source, i)
            child.items.append(source[i : end.start()])
            child.drop, i = True, end.end()
        elif tag not in VOID and not m[3].endswith("/"):
            at = child
        elif m[3].endswith("/") and tag not in VOID:
            at = child if tag in BLOCK or tag in ("a", "b", "i", "em", "strong", "span") else at  # HTML ignores the slash
    text(source[i:])
    return root


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _post(root: Node) -> list[Node]:
    """All nodes, children before parents, without recursion."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(x for x in n.items if isinstance(x, Node))
    return out[::-1]


def _size(s: str) -> int:
    return len(s) if s.isspace() is False and "  " not in s and "\n" not in s else len(" ".join(s.split()))


def drop_named(root: Node) -> None:
    """Drops the nodes whose class or id says that they are no content, but for those with most of the page's text outside
    links: they hold the content. Readers' words stay only on pages without an article of their own."""
    order = _post(root)
    if not any(n.named for n in order):
        return
    free: dict[int, int] = {}  # characters outside links, whether dropped or not
    linked: dict[int, int] = {}  # and inside
    own: dict[int, int] = {}  # those of them in an article that isn't dropped
    for n in order:
        c = a = k = 0
        if n.tag not in ("script", "style", "head", "title"):
            for x in n.items:
                c += _size(x) if isinstance(x, str) else free[id(x)]
                a += 0 if isinstance(x, str) else own[id(x)]
                k += 0 if isinstance(x, str) else linked[id(x)]
        if n.tag == "a":
            c, a, k = 0, 0, c + k
        linked[id(n)] = k
        free[id(n)], own[id(n)] = c, 0 if n.drop else c if n.tag in ("article", "main") else a
    within = ("article",) if any(n.tag == "article" for n in order) else ("main",)
    for n in order:
        if n.named:
            inside = any(up.tag in within for up in _up(n.parent))
            if inside and not n.named & SURE_WORDS and not LINKED * linked[id(n)] > free[id(n)] + linked[id(n)]:
                continue
            beside = own[id(root)] > (free[id(n)] if any(up.tag in ("article", "main") for up in _up(n)) else own[id(n)])
            n.drop = n.drop or 2 * free[id(n)] <= free[id(root)] or bool(n.named & READER_WORDS) and beside


def measure(root: Node) -> None:
    """C, LC, T, LT of every node; dropped subtrees count only for the body's link share."""
    order = _post(root)
    body_chars = body_links = 0
    for n in order:
        n.chars = n.link_chars = n.tags = n.link_tags = 0
        for x in n.items:
            if isinstance(x, str):
                n.chars += _size(x)
            elif not x.drop:
                n.chars, n.link_chars, n.tags, n.link_tags = n.chars + x.chars, n.link_chars + x.link_chars, n.tags + 1 + x.tags, n.link_tags + x.link_tags + (x.tag == "a")
            if isinstance(x, Node) and x.drop and x.tag not in ("script", "style", "head", "title"):
                body_chars, body_links = body_chars + x.chars, body_links + x.link_chars
        if n.tag == "a":
            n.link_chars = n.chars
    body_chars, body_links = body_chars + root.chars, body_links + root.link_chars
    share = body_links / body_chars if body_chars else 0.0
    for n in order:
        c, t = n.chars, max(1, n.tags)
        if c:
            inner = c / max(1, c - n.link_chars) * n.link_chars + share * c + math.e
            base = math.log(max(1.1, math.log(inner)))
            n.density = max(0.0, c / t * math.log(max(1.0, c / max(1, n.link_chars) * (t / max(1, n.link_tags)))) / base)
        n.total, n.best = 0.0, n
        for x in n.items:
            if isinstance(x, Node) and not x.drop:
                n.total += x.density if x.tag in BLOCK else 0.0  # inline marks are part of their block
                if x.best.total > n.best.total:
                    n.best = x.best
        if not n.total:
            n.total = n.density * 1e-9  # a leaf: only chosen where nothing has children
        if n.best.total <= n.total:
            n.best = n


def grown(node: Node) -> Node:
    """The content around a part of it, see above."""
    while node.tag not in ("article", "main", "body", "html", "#root"):
        up = node.parent
        others, links = up.chars - node.chars, up.link_chars - node.link_chars
        if up.tag in ("body", "html", "#root") or LINKED * links > others or others - links > node.chars:
            break
        node = up
    return node


def contents(root: Node, grow: bool = True) -> list[Node]:
    """The content nodes, in page order."""
    body = next((n for n in reversed(_post(root)) if n.tag == "body"), root)
    best = body.best
    path = [n for n in _up(best)]
    path = path[: path.index(body) + 1]
    threshold = min(n.density for n in path)
    scope = next((n for n in path if n.tag == "main"), body)
    marked: set[int] = set()
    stack = [scope]
    while stack:
        n = stack.pop()
        if n.drop:
            continue
        if n.density >= threshold:
            marked.add(id(n.best))
        elif scope is not body and n.tag in ("h1", "h2") and not n.link_tags:
            marked.add(id(n))
        stack.extend(x for x in n.items if isinstance(x, Node))
    if grow:
        marked.add(id(grown(best)))
    out, stack = [], [scope]
    while stack:
        n = stack.pop()
        if n.drop:
            continue
        if id(n) in marked:
            out.append(n)
        else:
            stack.extend(x for x in reversed(n.items) if isinstance(x, Node))
    return out


def blocks(node: Node) -> list[str]:
    """The text of each block below node, in page order, white space made one space, empty blocks left out."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            s = " ".join("".join(line).split())
            line.clear()
            if s:
                out.append(s)

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif x.drop:
            continue
        elif x.tag == "br":
            line.append(" ")
        else:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(x.items))
    end()
    return out


def main_text(source: str | None, grow: bool = True) -> str:
    if not source or not source.strip():
        return ""
    root = parse(source)
    drop_named(root)
    measure(root)
    return "\n".join(b for n in contents(root, grow) for b in blocks(n))


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """df with its html column replaced by text and n_chars."""
    rest = df.drop(*({"text", "n_chars"} - {html}))
    keep = [f for f in rest.schema.fields if f.name != html]
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    @slim
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(x) for x in pdf[html]]
            yield pdf.drop(columns=html).assign(text=texts, n_chars=[len(x) for x in texts])

    return rest.mapInPandas(run, schema)
