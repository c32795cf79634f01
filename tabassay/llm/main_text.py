"""Main text of web pages by composite text density.

Every node of a page's tree gets its characters, tags, link characters and link tags.
Its composite density is characters per tag, adjusted by how much of it is links. The
node with the largest sum of child densities holds the article; the least density on
the path from it to the body is the threshold, and nodes off the path that reach it are
main text too. ``main`` and ``article`` only fence the choice: the outermost one around the
densest node, or the one inside it that outweighs what stands beside it, is taken whole, and
so is every other one that reaches the threshold, or stands beside it and is not mostly
links. Without one, the densest node, the nodes at or above the threshold and the headings right before
the path are taken.

Menus, page headers, footers, sidebars, forms and hidden parts are told by element, role
or attribute and never count. Adverts, notices and reader comments are told by class and
id; other names, such as ``related``, count for a node of low density or many links alone.
No name counts for a node around the densest one, or as far as it would leave no text.

Defined results: null or empty html and a page without text give an empty text;
character references are decoded as HTML5 does, unknown ones stay as they are; white
space inside a block is one space; blocks are joined by a line feed; repeated rows are
read each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm.tables import small_batches

# Elements by their role in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details",
    "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NOISE_TAGS = {
    "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "head",
    "object", "canvas", "audio", "video", "datalist", "fieldset", "search", "math",
}
NOISE_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar",
    "toolbar", "alert", "alertdialog", "dialog", "note", "status",
}
#: Names of what readers or advertisers put on a page, and of what asks for a click.
STRONG_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor",
    "sponsored", "cookie", "cookies", "consent", "gdpr", "newsletter", "subscribe", "signup",
    "popup", "modal", "overlay", "comment", "comments", "commentlist", "reply", "replies",
    "respond", "disqus", "login", "sidebar", "sidenav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "footer", "masthead", "topbar", "menu", "nav",
}
#: Names that text of the article may bear as well.
WEAK_NAMES = {
    "promo", "promotion", "banner", "notice", "notices", "notification", "alert", "disclaimer",
    "subscription", "share", "sharing", "social", "related", "recommended", "recommendations",
    "widget", "toolbar", "pagination", "pager", "skip", "header",
}
#: Words of a name that say what a page has, or lacks, rather than what a node is.
SAID_OF = {"no", "not", "has", "have", "with", "without", "is", "hide", "show", "off", "on"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
FENCES = {"main", "article"}
#: An open element that the start of one of these closes.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"}, "p": BLOCKS - {"option", "caption", "legend"},
}
SCOPES = {"table", "ul", "ol", "dl", "td", "th", "html", "body", "article", "section", "div"}
#: Least logarithm of the base that link characters give, so that a page without links works.
LEAST_LOG = 0.5

TAG = re.compile(
    r"<!--(?P<note>.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*)>""",
    re.S,
)
RAW_ENDS = {tag: re.compile(rf"</{tag}[^>]*>", re.I) for tag in RAW}
LOOSE = re.compile(r"</?[a-zA-Z][^>]*(?:>|\Z)")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MARKED = re.compile(r"class|id|role|style", re.I)
NAMES = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """One element: its place in the tree and, later, its counts."""

    __slots__ = (
        "tag", "parent", "children", "noise", "named", "parts", "chars", "tags", "links", "density",
    )

    def __init__(self, tag: str, parent: Node | None, noise: bool, named: int = 0):
        self.tag, self.parent, self.noise, self.named = tag, parent, noise, named
        self.children: list[Node] = []
        self.parts: list[Node | str] = []  # texts and elements in page order
        self.chars = self.tags = self.links = 0
        self.density = 0.0


def _judged(tag: str, rest: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is surely noise, and how strongly its names say so (0 to 2)."""
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return True, 0
    if tag in ("html", "body") or not MARKED.search(rest):
        return False, 0
    named = 0
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "style" and HIDDEN.search(value)):
            return True, 0
        if name == "aria-hidden" and value.lower() == "true":
            return True, 0
        if name == "role" and value.lower() in NOISE_ROLES:
            return True, 0
        if name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in NAMES.findall(CAMEL.sub(" ", token))]
                if SAID_OF.intersection(words):
                    continue
                # What a node is stands at either end of its name: ad-box, user-comments.
                ends = {words[0], words[-1]} if words else set()
                if ends & STRONG_NAMES:
                    named = 2
                elif ends & WEAK_NAMES:
                    named = max(named, 1)
    return False, named


def parse(html: str) -> Node:
    """The tree of a page; elements left open end where HTML ends them."""
    root = node = Node("html", None, False)
    at = articles = 0
    open_: Counter[str] = Counter()  # so that no stray end tag climbs to the root

    def text(raw: str) -> None:
        if raw:
            node.parts.append(unescape(raw) if "&" in raw else raw)

    def leave(to: Node) -> None:
        nonlocal node, articles
        last = to.parent
        while node is not last:
            articles -= node.tag in FENCES
            open_[node.tag] -= 1
            node = node.parent

    while True:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            return root
        found = TAG.match(html, start) or LOOSE.match(html, start)
        if not found:
            text(html[at : start + 1])
            at = start + 1
            continue
        text(html[at:start])
        at = found.end()
        if found.re is LOOSE or not found["name"]:
            continue
        tag = found["name"].lower()
        if found["end"]:
            if open_[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up)
            continue
        if tag in ("html", "body") and (node is not root or tag == "html"):
            continue
        if tag in RAW:
            close = RAW_ENDS[tag].search(html, at)
            at = close.end() if close else len(html)
            continue
        up = node if any(open_[t] and tag in closing for t, closing in CLOSED_BY.items()) else root
        while up is not root:
            if tag in CLOSED_BY.get(up.tag, ()):
                leave(up)
                break
            if up.tag in SCOPES:
                break
            up = up.parent
        noise, named = _judged(tag, found["rest"], articles > 0)
        made = Node(tag, node, node.noise or noise, named)
        node.children.append(made)
        node.parts.append(made)
        if tag not in VOID:
            node = made
            open_[tag] += 1
            articles += tag in FENCES


def _in_order(root: Node) -> list[Node]:
    """Nodes that are not noise, parents first, without those of strong names."""
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        out.append(node)
        waiting.extend(c for c in reversed(node.children) if not c.noise and c.named < 2)
    return out


def measure(root: Node) -> list[Node]:
    """Counts and composite densities of all nodes that are not noise."""
    nodes = _in_order(root)
    for node in nodes:
        node.chars = node.tags = node.links = 0
        node.density = 0.0
    link_tags = dict.fromkeys(map(id, nodes), 0)
    for node in reversed(nodes):
        for part in node.parts:
            if part.__class__ is str and not part.isspace():
                node.chars += len(part)
        if node.tag == "a":
            node.links, link_tags[id(node)] = node.chars, link_tags[id(node)] + 1
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.tags += node.tags + 1
            node.parent.links += node.links
            link_tags[id(node.parent)] += link_tags[id(node)]
    share = root.links / max(root.chars, 1)
    for node in nodes:
        if not node.chars:
            continue
        chars, tags, links = node.chars, max(node.tags, 1), node.links
        base = log(chars / max(chars - links, 1) * links + share * chars + e)
        ratio = chars / max(links, 1) * tags / max(link_tags[id(node)], 1)
        node.density = chars / tags * log(max(ratio, 1.0) + 1) / max(log(base), LEAST_LOG)
    return nodes


def _upwards(node: Node) -> list[Node]:
    """The node and all around it, up to the root."""
    path = [node]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    return path


def _below(node: Node) -> list[Node]:
    """Measured nodes inside this one."""
    return _in_order(node)[1:]


def _believed(root: Node) -> list[Node]:
    """Measured nodes, with strong names forgotten as far as they leave no text."""
    while True:
        nodes = measure(root)
        if root.chars:
            return nodes
        named = [c for n in nodes for c in n.children if not c.noise and c.named == 2]
        if not named:
            return nodes
        for node in named:
            node.named = 0


def contents(root: Node) -> list[Node]:
    """The nodes whose text is the main text, in page order; marks what is noise in them."""
    nodes = _believed(root)
    if not root.chars:
        return []
    sums = {id(n): sum(c.density for c in n.children if not c.noise and c.named < 2) for n in nodes}
    best = max(nodes, key=lambda n: (sums[id(n)], n.density))
    if not sums[id(best)]:
        best = max(nodes, key=lambda n: n.density)
    path = _upwards(best)
    inner = [n for n in _below(best) if n.tag in FENCES]
    if inner and not any(n.tag in FENCES for n in path):
        # A fence inside is the article where it outweighs what stands beside it.
        inside = max(inner, key=lambda n: sums[id(n)] or n.density)
        between = _upwards(inside)[: -len(path) + 1 or None]
        beside = sum(sums[id(n)] for n in between[1:]) - sum(n.density for n in between[:-1])
        if (sums[id(inside)] or inside.density) >= beside:
            path = _upwards(inside)
            best = inside
    on_path = set(map(id, path))
    threshold = min(n.density for n in path)
    for node in nodes:
        weak = node.named and (node.density < threshold or 2 * node.links >= node.chars)
        node.noise = node.noise or bool(weak and id(node) not in on_path)
        for child in node.children:
            child.noise = child.noise or child.named == 2
    fence = next((n for n in reversed(path) if n.tag in FENCES), None)
    if fence is not None:
        beside = {
            id(n) for n in nodes
            if n.tag in FENCES and (
                n.density >= threshold
                or (n.parent is fence.parent and n.tag == fence.tag and 2 * n.links < n.chars)
            )
        }
        return _outermost(root, lambda n: n is fence or id(n) in beside)
    chosen = {id(best)}
    for node in path[1:]:
        before = True
        for child in node.children:
            before = before and id(child) not in on_path
            heading = before and child.tag in HEADINGS
            if id(child) not in on_path and (heading or child.density >= threshold):
                chosen.add(id(child))
    return _outermost(root, lambda n: id(n) in chosen and n.chars > 0)


def _outermost(root: Node, wanted: Callable[[Node], bool]) -> list[Node]:
    """The wanted nodes without noise that lie in no other one, in page order."""
    chosen, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if wanted(node):
            chosen.append(node)
        else:
            waiting.extend(c for c in reversed(node.children) if not c.noise)
    return chosen


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node``, without noise."""
    out: list[str] = []
    open_: list[str] = []

    def end() -> None:
        line = " ".join("".join(open_).split())
        open_.clear()
        if line:
            out.append(line)

    waiting: list[Node | str | None] = [node]
    while waiting:
        part = waiting.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            open_.append(part)
        elif part.noise:
            if part.tag in BLOCKS:
                end()
        elif part.tag == "br":
            open_.append(" ")
        elif part.tag in BLOCKS:
            end()
            waiting.append(None)
            waiting.extend(reversed(part.parts))
        else:
            waiting.extend(reversed(part.parts))
    end()
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    return "\n".join(line for node in contents(parse(html)) for line in blocks(node))


def _texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract_main_text(
    pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html"
) -> DataFrame:
    """The ``keep`` columns and ``text``, the main text, of every page."""
    small_batches(pages.sparkSession)
    return pages.select(*keep, F.pandas_udf(_texts, "string")(html_col).alias("text"))
