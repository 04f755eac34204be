"""Main text of raw web pages by tree scoring.

A page becomes a tree (unclosed and misnested tags included). Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments go by their tag, role, class or id. Every paragraph of
the rest has points for its length and commas, less its share of link text; it passes them to its parent, half of
them to the next ancestor, a quarter to the one after, and so on. An element's points count by the share of its text
that is no link. The best container is kept, with those siblings that have a fair share of points or are plain text
beside it, and what is mostly links inside goes. All of it is one pass over the page, without recursion.

The text is one line for every block, in page order: character references decoded, white space (line breaks and
no-break spaces included) turned into one space, trimmed; lines are joined by one line feed.

Odd input: NULL and empty pages, and pages without text, give an empty text. A page that is plain text is its own article. A page
that is cut off is read as far as it goes. Repeated rows each give a row; an empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ticklens.llm.common import chunks

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
PARAGRAPHS = frozenset("p pre li dd dt blockquote figcaption caption h1 h2 h3 h4 h5 h6 td th address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element of the key's kind ends open ones of these kinds, but none beyond the fences.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr"}, {"table"}),
    "a": ({"a"}, {"td", "th", "table", "li"}),
}
CELLS = frozenset({"table", "td", "th", "caption"})

# What is never part of an article, by tag, role, and words of classes and ids.
DROPPED = frozenset(
    "script style noscript template iframe svg canvas object embed applet form input button select textarea label"
    " fieldset legend option datalist nav menu dialog footer aside audio video map head title xmp noembed noframes"
    " frameset".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split()
)
STRONG = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising sponsor sponsored sponsors breadcrumb"
    " breadcrumbs comment comments commentlist disqus replies respond cookie cookies consent gdpr footer footnav"
    " menu menus nav navbar navigation newsletter pagination pager responses sidebar sidebars sidenav sitenav topnav"
    " skiplink outbrain taboola".split()
)
#: These words are also used for whole layouts, so what holds most of the page is not dropped for them.
WEAK = frozenset(
    "alert aside banner header hidden login masthead modal notice notices notification overlay popup promo promos"
    " promotion recommended recommendations related share sharing signin signup social subscribe subscription"
    " toolbar topbar widget widgets".split()
)
#: These are told as parts of longer names too (`leftsidebar`, `commentsection`).
TELLING = tuple("sidebar footer comments commentlist cookie advert newsletter navbar breadcrumb sponsor".split())
#: `has-sidebar` and the like speak of something else.
ABOUT_OTHERS = frozenset("has with no without enabled".split())
#: `article-header` is the head of the article, not of the page.
OWN_HEAD = frozenset("article entry post story content".split())

_ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+)?+)?+"""
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE}|=)*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_COMMAS = re.compile("[,،、，]")

LEAST_PARAGRAPH = 25
SIBLING_SHARE = 0.2
MENU_LINKS = 3
MENU_DENSITY = 0.66


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "gone", "size", "linked", "links", "points", "score", "block")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Node | str] = []
        self.gone = False
        #: Characters of text, of them in links, and the number of links.
        self.size = self.linked = self.links = 0
        #: Points of the paragraph that the element is, and of all that it has been passed.
        self.points = self.score = 0.0
        #: Whether there is a block element inside.
        self.block = False

    @property
    def density(self) -> float:
        return self.linked / self.size if self.size else 0.0


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root of the page's tree, and all nodes in page order."""
    root = Node("#root", {}, None)
    nodes, stack = [root], [root]
    #: How many elements of each kind are open.
    open_tags: dict[str, int] = {}

    def close(depth: int) -> None:
        for node in stack[depth:]:
            open_tags[node.tag] -= 1
        del stack[depth:]

    def close_open(tags, fences) -> None:
        """End the outermost open element of these kinds that lies inside the fences."""
        if not any(open_tags.get(tag) for tag in tags):
            return
        target = None
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                target = depth
            elif stack[depth].tag in fences:
                break
        if target is not None:
            close(target)

    def end(tag: str) -> None:
        if not open_tags.get(tag):
            return
        for depth in range(len(stack) - 1, 0, -1):
            other = stack[depth].tag
            if other == tag:
                close(depth)
                return
            # A stray end inside a cell ends nothing outside; an inline one ends no block.
            if other in CELLS and tag not in CELLS and tag not in ("tr", "tbody", "thead", "tfoot"):
                return
            if tag in INLINE and other not in INLINE:
                return

    at = 0
    while at < len(page):
        found = _MARKUP.search(page, at)
        upto = found.start() if found else len(page)
        if upto > at:
            stack[-1].parts.append(html.unescape(page[at:upto]))
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            end(tag)
            continue
        if tag not in INLINE:
            close_open({"p"}, CELLS)
        if tag in ENDED_BY:
            close_open(*ENDED_BY[tag])
        attrs = {}
        for m in _NAMED.finditer(found[3]):
            value = next((v for v in m.groups()[1:] if v is not None), "")
            attrs.setdefault(m[1].lower(), html.unescape(value))
        node = Node(tag, attrs, stack[-1])
        stack[-1].parts.append(node)
        nodes.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            over = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            at = over.end() if over else len(page)
            continue
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    return root, nodes


def _words(node: Node) -> set[str]:
    names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    found = set()
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(name)} | {name.lower()}
        if not words & ABOUT_OTHERS and not ("header" in words and words & OWN_HEAD):
            found |= words | {w for w in TELLING if w in name.lower()}
    return found


def _unwanted(node: Node) -> str:
    """`always`, `strong`, `weak` (not if it holds most of a page that marks no article) or nothing."""
    style = node.attrs.get("style", "").replace(" ", "").lower()
    if "hidden" in node.attrs or "display:none" in style or "visibility:hidden" in style:
        return "always"
    if node.attrs.get("aria-hidden", "").lower() == "true":
        return "weak"
    if node.tag in ("body", "html", "main", "#root"):
        return ""
    if node.tag == "form":
        return "weak"  # some pages are a form as a whole
    if node.tag in DROPPED:
        return "always"
    words = _words(node)
    if words & STRONG or any(w in words for w in TELLING):
        return "strong"
    if node.attrs.get("role", "").lower() in ROLES or words & WEAK:
        return "weak"
    if node.tag == "header":
        own = node.parent
        while own is not None and own.tag not in ("article", "main"):
            own = own.parent
        return "" if own is not None and own.tag == "article" else "weak"
    return ""


def _mark_unwanted(nodes: list[Node]) -> None:
    """Mark what goes, with all that is inside. An element that holds the article itself stays."""
    size = {}
    holds: set[int] = set()
    kind = {}
    for node in reversed(nodes):  # children before parents
        key = id(node)
        kind[key] = _unwanted(node)
        if kind[key] == "always":
            size[key] = 0
            continue
        size[key] = sum(
            size[id(p)] if isinstance(p, Node) else len("".join(p.split())) for p in node.parts
        )
        if (node.tag in ("main", "article") and not kind[key]) or key in holds:
            holds.add(key)
            if node.parent is not None:
                holds.add(id(node.parent))
    whole, marked = size[id(nodes[0])], id(nodes[0]) in holds
    for node in nodes:
        key = id(node)
        if node.parent is not None and node.parent.gone:
            node.gone = True
        elif kind[key] == "always":
            node.gone = True
        elif kind[key]:
            most = kind[key] == "weak" and 2 * size[key] > whole and not marked
            node.gone = key not in holds and not most


def _measure(nodes: list[Node], least: int) -> None:
    """Sizes, links, points and scores of all nodes that stay."""
    in_link: set[int] = set()
    for node in nodes:
        if node.tag == "a" or (node.parent is not None and id(node.parent) in in_link):
            in_link.add(id(node))
    for node in reversed(nodes):
        if node.gone:
            continue
        node.size = node.linked = node.links = commas = 0
        node.score = node.points = 0.0
        node.block = False
        run = [0, 0, 0]  # characters, of them in links, commas of the inline text since the last block
        inside = []

        def paragraph(run=run, inside=inside) -> None:
            if run[0] >= least:
                points = 1 + run[2] + min(run[0] / 100, 3)
                inside.append(points * (1 - run[1] / run[0]))
            run[:] = 0, 0, 0

        for part in node.parts:
            if isinstance(part, str):
                size, commas = len("".join(part.split())), len(_COMMAS.findall(part))
                run[0] += size
                run[1] += size if id(node) in in_link else 0
                run[2] += commas
                node.size += size
                node.linked += size if id(node) in in_link else 0
            elif not part.gone:
                node.size += part.size
                node.linked += part.linked
                node.links += part.links + (part.tag == "a")
                if part.tag in INLINE and not part.block:
                    run[0] += part.size
                    run[1] += part.linked
                    run[2] += part.points  # an inline element keeps its commas here
                else:
                    paragraph()
                    node.block = True
                    node.score += part.points + part.score / 2
        if node.tag in INLINE and not node.block:
            node.points = run[2]
            continue
        leaf = not node.block
        paragraph()
        if leaf and node.tag in PARAGRAPHS:
            node.points = sum(inside)
        else:
            node.score += sum(inside)


def _inside(node: Node, tags: set[str]) -> Node | None:
    """The node or its nearest ancestor of one of these kinds."""
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


def _best(nodes: list[Node]) -> Node | None:
    best, value = None, 0.0
    for node in nodes:  # parents first, so they win ties
        if not node.gone and node.tag not in INLINE and (node.score or node.points):
            own = (node.score or node.points / 2) * (1 - node.density)
            if own > value * (1 + 1e-9):
                best, value = node, own
    if best is None:
        return None
    article = _inside(best, {"article"})
    if article is not None:
        return article
    main = _inside(best, {"main"})
    return main if main is not None and best.size < 0.8 * main.size else best


def _kept(best: Node) -> list[Node | str]:
    """The best container and those of its siblings that belong to it, in page order."""
    if best.parent is None or best.tag in ("body", "main", "html"):
        return [best]
    wanted = SIBLING_SHARE * best.score * (1 - best.density)
    names = best.attrs.get("class")
    kept: list[Node | str] = []
    for part in best.parent.parts:
        if part is best:
            kept.append(part)
        elif isinstance(part, Node) and not part.gone and part.tag not in INLINE:
            if best.tag == "article" and part.tag != "article":
                continue  # an article is marked as a whole
            own = part.score * (1 - part.density)
            alike = part.tag == best.tag and part.attrs.get("class") == names and part.density < 0.5
            alike &= bool(names) or best.tag == "section"
            plain = part.tag in PARAGRAPHS and part.density < 0.5
            if (own >= wanted and own > 0) or alike or plain:
                kept.append(part)
    return kept


def _is_menu(node: Node) -> bool:
    return (
        node.links >= MENU_LINKS
        and node.density > MENU_DENSITY
        and node.tag not in PARAGRAPHS
        and node.tag not in INLINE
    )


def _lines(top: list[Node | str]) -> list[str]:
    lines: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = " ".join("".join(run).split())
        if line:
            lines.append(line)
        run.clear()

    # What is still to do, last first; None ends a block.
    todo: list[Node | str | None] = top[::-1]
    chosen = {id(t) for t in top}
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            run.append(part)
        elif part.gone or (_is_menu(part) and id(part) not in chosen):
            continue
        elif part.tag in ("br", "wbr", "img"):
            run.append("" if part.tag == "wbr" else " ")
        else:
            if part.tag not in INLINE:
                flush()
                todo.append(None)
            todo.extend(reversed(part.parts))
    flush()
    return lines


def main_text(page: str | None) -> str:
    """The text of the article of a page."""
    root, nodes = parse(page or "")
    _mark_unwanted(nodes)
    for least in (LEAST_PARAGRAPH, 1):
        _measure(nodes, least)
        best = _best(nodes)
        if best is not None:
            return "\n".join(_lines(_kept(best)))
    return ""


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages` (page_id, url, html)."""
    fields = {f.name: f.dataType.simpleString() for f in pages.select("page_id", "url").schema}

    def rows(batches):
        for batch in batches:
            for first, part in chunks(batch.column(2)):
                texts = [main_text(page) for page in part.to_pylist()]
                columns = [batch.column(i).slice(first, len(part)) for i in (0, 1)]
                columns += [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        rows, f"page_id {fields['page_id']}, url {fields['url']}, text string, n_chars bigint"
    )
