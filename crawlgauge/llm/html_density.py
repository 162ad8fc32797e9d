"""Main text of web pages by composite text density.

Each page becomes a small tree of elements. What is never article text is left out first: scripts, forms, navigation,
page headers and footers, elements whose class, id or role name menus, adverts, notices, sidebars or comments, and,
outside articles, lists of links. Names of a layout (with-sidebar) do not count, and a class or id never takes most of
the page's unlinked characters: see _named. Every remaining element gets a density: its characters per tag, lowered by how much of them is linked. The element
whose children have the largest sum of densities is the core of the article. The least density on the path from the
body to the core is the threshold for growing it: its parent is taken instead, again and again, without those parts
beside it that fail the threshold (_grow). A core in a main element gives the main element, one in an article the article
and the articles beside it that reach the threshold. All other blocks of the chosen subtree are kept, whatever their length.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by two line
feeds. Defined cases: null or empty html, and pages without text, give the empty text; html without a body is read as
one; unclosed and stray tags are repaired as browsers do for paragraphs, lists and tables; equal sums take the earlier
element; equal pages give equal texts.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements by role in the HTML standard, and words that name what surrounds an article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
_UNSEEN = frozenset(
    "script style noscript template head title form nav footer aside button select option textarea input label svg "
    "iframe object canvas audio video map dialog menu math".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar "
    "sidenav comment comments commentlist disqus replies reply respond cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup popup modal overlay share sharing social related recommended "
    "recommendations breadcrumb breadcrumbs menu menus nav navbar navigation pagination pager footer copyright widget "
    "widgets toolbar masthead topbar login search alert alerts disclaimer".split()
)
_COMMENT_WORDS = frozenset("comment comments reply replies respond ad ads advert advertisement promo sponsored".split())
_HEADER_WORDS = frozenset("header head top".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words by which a name says what a layout has or allows, and words for a box around something.
_LAYOUT_WORDS = frozenset("with without has have no enabled disabled open closed free layout columns supports".split())
_BOX_WORDS = frozenset("wrap wrapper wrapping container inner outer area list box block section holder site page".split())

# What an opening tag closes, and what stops the search for it.
_CLOSES = {
    **dict.fromkeys(_BLOCK - {"html", "body"}, (frozenset(["p"]), frozenset(["table", "td", "th", "button", "object"]))),
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["table", "tr"])),
}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    """An element: children are elements or texts."""

    __slots__ = ("tag", "attrs", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        closes, stops = _CLOSES.get(tag, (frozenset(), frozenset()))
        if closes:
            self._close_first(closes, stops)
        node = Node(tag, {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "style")}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def _close_first(self, closes: frozenset[str], stops: frozenset[str]) -> None:
        """Close the outermost element of ``closes`` that no element of ``stops`` shields."""
        found = None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in stops:
                break
            if tag in closes:
                found = i
            elif tag in _BLOCK:
                break
        if found is not None:
            del self.open[found:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            # An inline end tag does not close blocks.
            if self.open[i].tag in _BLOCK and tag not in _BLOCK:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _names(node: Node) -> list[frozenset[str]]:
    """The words of every class and of the id."""
    found = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".split()
    return [frozenset(w.lower() for w in _WORDS.findall(name)) for name in found]


def _contains(node: Node, tags: tuple[str, ...]) -> bool:
    todo = node.elements()
    while todo:
        one = todo.pop()
        if one.tag in tags:
            return True
        todo += one.elements()
    return False


def _surrounds(node: Node, in_article: bool) -> bool:
    """Whether an element is not part of any article."""
    if node.tag in _UNSEEN or "hidden" in node.attrs or "display:none" in node.attrs.get("style", "").replace(" ", ""):
        return True
    if node.tag == "header" and not in_article:
        return not _contains(node, ("article", "main"))
    if node.attrs.get("role", "").lower() in _ROLES:
        return not _contains(node, ("article", "main"))
    return False


# How sure a name is: none, a word of a longer name, a whole name, a whole name of comments or adverts.
_UNNAMED, _PARTLY, _WHOLLY, _COMMENTS = range(4)


def _holders(root: Node, tags: frozenset[str]) -> set[Node]:
    """Elements that hold one of the given tags."""
    out: set[Node] = set()
    for node in _post_order(root):
        if any(c.tag in tags or c in out for c in node.elements()):
            out.add(node)
    return out


def _standing(node: Node, in_article: bool, holds_article: bool) -> int:
    """How surely the class or id of an element names what surrounds articles."""
    if not node.attrs or node.tag == "main":
        return _UNNAMED
    words, out = _COMMENT_WORDS if node.tag == "article" else _AROUND, _UNNAMED
    names = _names(node)
    for name in names:
        rest = name - words - _BOX_WORDS
        if not name & words or name & _LAYOUT_WORDS or (rest and name & {"wrap", "wrapper", "container"}):
            continue
        out = max(out, _PARTLY if rest else _COMMENTS if name <= _COMMENT_WORDS | _BOX_WORDS else _WHOLLY)
    every = frozenset().union(*names)
    if not in_article and node.tag != "article" and every <= _HEADER_WORDS | {"site", "page"} and every & _HEADER_WORDS:
        out = max(out, _WHOLLY)
    return _UNNAMED if holds_article and node.tag != "article" else out


def _prune(root: Node) -> None:
    """Remove the elements that surround articles."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _surrounds(c, inside)]
        todo += [(c, inside or c.tag in ("article", "main")) for c in node.elements()]
    named = _named(root)
    for node in _post_order(root) if named else ():
        node.children = [c for c in node.children if isinstance(c, str) or c not in named]


def _named(root: Node) -> set[Node]:
    """Elements to remove by their names.

    No element that holds more than half of the page's unlinked characters is removed, those of comments aside. If
    names that hold such a word among others would take more than half together, none of them counts.
    """
    holders = _holders(root, frozenset(["article", "main"]))
    standing, todo = {}, [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node is not root and (found := _standing(node, inside, node in holders)):
            standing[node] = found
        todo += [(c, inside or c.tag in ("article", "main")) for c in node.elements()]
    if not standing:
        return set()
    free: dict[Node, int] = {}  # unlinked characters outside comments
    for node in _post_order(root):
        own = sum(len(_SPACE.sub(" ", c).strip(" ")) if isinstance(c, str) else free[c] for c in node.children)
        free[node] = 0 if node.tag == "a" or standing.get(node) == _COMMENTS else own
    most = {n for n in standing if standing[n] != _COMMENTS and 2 * free[n] > free[root]}
    if not free[root]:
        # Beside comments there are only links.
        return {n for n in standing if standing[n] != _COMMENTS}
    taken, todo = 0, [root]
    while todo:
        node = todo.pop()
        if standing.get(node) == _PARTLY:
            taken += free[node]
        elif standing.get(node, _UNNAMED) == _UNNAMED or node in most:
            todo += node.elements()
    if 2 * taken > free[root]:
        most |= {n for n in standing if standing[n] == _PARTLY}
    return set(standing) - most


def _post_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += node.elements()
    return out[::-1]


def _measure(root: Node) -> list[Node]:
    """Counts and densities of all elements, children before parents."""
    nodes = _post_order(root)
    for node in nodes:
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(_SPACE.sub(" ", child).strip(" "))
            else:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    whole = root.link_chars / max(1, root.chars)
    for node in nodes:
        node.density = _density(node, whole)
        node.total = sum(c.density for c in node.elements())
    return nodes


def _drop_link_lists(root: Node) -> None:
    """Remove lists of links outside articles: several links and little else."""
    todo = [root]
    while todo:
        node = todo.pop()
        own = [c for c in node.elements() if c.tag not in ("article", "main")]
        lists = [c for c in own if c.tag in _BLOCK and c.link_tags > 1 and 3 * c.link_chars >= 2 * c.chars]
        if lists:
            node.children = [c for c in node.children if c not in lists]
        todo += [c for c in own if c not in lists]


def _density(node: Node, whole: float) -> float:
    """Characters per tag, lowered by the share of linked characters and tags."""
    plain = node.chars / max(1, node.tags)
    if not node.link_chars:
        return plain
    free = max(1, node.chars - node.link_chars)
    base = math.log(node.chars / free * node.link_chars + whole * node.chars + math.e)
    share = node.chars / node.link_chars * max(1, node.tags) / max(1, node.link_tags)
    return plain * max(0.0, math.log(share)) / max(1.0, math.log(base) + 1)


def _path(node: Node) -> list[Node]:
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def select(root: Node) -> Node:
    """The subtree that holds the article."""
    _measure(root)
    _drop_link_lists(root)
    for node in _post_order(root):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
    nodes = [n for n in reversed(_measure(root)) if n.tag in _BLOCK and n.chars]
    if not nodes:
        return root
    core = max(nodes, key=lambda n: n.total if n.elements() else n.density)
    path = _path(core)
    threshold = min((n.density for n in path[:-1]), default=core.density)
    outer = next((n for n in reversed(path) if n.tag in ("article", "main")), None)
    if outer is not None and outer.tag == "main":
        return outer
    return _grow(outer or core, threshold, outer is not None, root.link_chars / max(1, root.chars))


def _grow(core: Node, threshold: float, articles: bool, whole: float) -> Node:
    """The root without the parts beside the path to the core that do not belong to the article.

    Up to the first level with a part that does not belong, all parts stay. From there on a part has to reach the
    threshold; unlinked parts between two that stay, and headings right before one, stay with them. An article only takes
    other articles, or elements that hold some.
    """
    top = core
    while top.parent is not None:
        top = top.parent
    holders = _holders(top, _BLOCK)
    strict = articles
    while (parent := core.parent) is not None:
        parts = _parts(parent, holders)
        shapes = [p[0] if len(p) == 1 and isinstance(p[0], Node) else _run(p, whole) for p in parts]
        loose = any(isinstance(c, str) and c.strip() for c in parent.children) and parent.parent is not None
        held = [core in p for p in parts]
        strict = strict or loose or not all(h or not s.chars or _belongs(s, threshold) for h, s in zip(held, shapes, strict=True))
        if strict:
            stays = [h or (s.chars > 0 and s.density >= threshold) for h, s in zip(held, shapes, strict=True)]
            if articles:
                hold = [h or s.tag == "article" or _contains(s, ("article",)) for h, s in zip(held, shapes, strict=True)]
                stays = [k and h for k, h in zip(stays, hold, strict=True)]
            else:
                first, last = stays.index(True), len(stays) - stays[::-1].index(True)
                stays = [k or (first < i < last and 2 * shapes[i].link_chars < shapes[i].chars) for i, k in enumerate(stays)]
                before_one = False
                for i in range(len(stays) - 1, -1, -1):
                    heading = shapes[i].tag in _HEADINGS and 2 * shapes[i].link_chars < shapes[i].chars
                    stays[i] = stays[i] or (heading and before_one)
                    before_one = stays[i] if shapes[i].chars else before_one
            parent.children = [c for k, p in zip(stays, parts, strict=True) if k for c in p]
        core = parent
    return core


def _parts(node: Node, holders: set[Node]) -> list[list[Node | str]]:
    """Children of an element: each block by itself, and runs of texts and inline elements."""
    out: list[list[Node | str]] = []
    inline = False
    for child in node.children:
        block = isinstance(child, Node) and (child.tag in _BLOCK or child in holders)
        if block or not inline:
            out.append([])
        out[-1].append(child)
        inline = not block
    return out


def _run(children: list[Node | str], whole: float) -> Node:
    """A run of texts and measured inline elements as one paragraph."""
    run = Node("p", {}, None)
    for child in children:
        if isinstance(child, str):
            run.chars += len(_SPACE.sub(" ", child).strip(" "))
        else:
            run.chars += child.chars
            run.tags += child.tags + 1
            run.link_chars += child.link_chars
            run.link_tags += child.link_tags
    run.density = _density(run, whole)
    return run


def _belongs(node: Node, threshold: float) -> bool:
    """Headings, unlinked text and whatever is as dense as the path to the core."""
    return node.density >= threshold or 2 * node.link_chars < node.chars


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below an element, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip(" ")
        if text:
            out.append(text)
        run.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        one = todo.pop()
        if one is None:
            flush()
        elif isinstance(one, str):
            run.append(one)
        elif one.tag == "br":
            run.append(" ")
        else:
            if one.tag in _BLOCK:
                flush()
                todo.append(None)
            todo += reversed(one.children)
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article of one page."""
    if not html:
        return ""
    root = parse(html)
    _prune(root)
    return "\n\n".join(blocks(select(root)))


def extract(html: Column) -> Column:
    """The article of every page of an html column."""

    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(page) for page in pages.to_pylist()], pa.string())

    return texts(html)
