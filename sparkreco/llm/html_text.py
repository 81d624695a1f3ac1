"""Main text of web pages by tree scoring.

A page becomes a tree. Parts that are never the article (menus, headers and footers of the page, sidebars, notices, adverts,
forms, scripts, styles, comments of readers) are cut off by element, role and class names. Each block with text of its own
passes points for its length and its commas to its ancestors, less with each level up, discounted by the share of its text that
stands in links. The container with the most points is kept; if it lies in an article or main element, that whole element is, however
long, and elsewhere its parent is if what that adds is poor in links. Siblings that score well beside it are kept too, and outside of
article and main elements all that are poor in links, however short; the blocks are joined in page order.

Defined cases: null, empty or text-free html gives an empty text; broken markup is repaired as browsers do in outline (implied
ends of paragraphs, items and cells; unmatched end tags are ignored; an unclosed comment, script or tag runs to the end); a
null or repeated page_id is carried along; nothing is cut for length; other columns than the id and those to keep are left out, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A quote opens a value only right behind an equals sign; elsewhere in a tag it is a character like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?", re.S)
_NAME_PARTS = re.compile(r"[a-z]+")

# fixed values: elements of HTML, and names that sites use for what isn't the article
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noframes", "xmp", "template", "svg", "math", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CUT = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "fieldset", "label", "datalist", "map"}
CUT_OUTSIDE_ARTICLE = {"header"}
CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
CUT_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "adbox", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "aside", "footer", "masthead", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "pagination", "pager", "paging", "skip", "toolbar", "copyright"}
#: Names that mark the article itself, and what is around it; "content-sidebar-wrap" is no sidebar, nor is what has or lacks one.
KEPT_NAMES, AROUND_NAMES, HAVING_NAMES = {"article", "content", "main", "entry", "post", "story", "body"}, {"wrap", "wrapper", "layout"}, {"with", "has", "no", "without"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
#: What a start tag ends, and what it doesn't reach beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: What an end tag or an implied end of a paragraph doesn't reach beyond.
SCOPES = {"table", "td", "th", "caption", "html", "object", "button"}
FAVOURED = {"article": 25.0, "main": 15.0}
#: Points for one block: 1, each comma, each 100 characters; a level up halves them, the next ones get a third and less, up to so many levels.
LEVELS = 12
CHARS_A_POINT, SIBLING_SHARE = 100.0, 0.2
#: Of a block that is poor in links, at most this share stands in links.
LINK_POOR = 1 / 3


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "points", "chars", "linked", "in_article")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.children: list[Node | str] = []
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)


def _is_cut(tag: str, attributes: str, parent: Node) -> bool:
    if tag in CUT or (tag in CUT_OUTSIDE_ARTICLE and not parent.in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    seen = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in seen:  # of attributes with one name the first counts
            continue
        seen.add(name)
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name == "role" and value in CUT_ROLES:
            return True
        if name in ("class", "id", "itemprop"):
            for word in value.split():
                parts = set(_NAME_PARTS.findall(word))
                if parts & CUT_NAMES and not parts & HAVING_NAMES and not (parts & KEPT_NAMES and parts & AROUND_NAMES):
                    return True
    return False


def parse(page: str) -> Node:
    root = Node("html", None)
    stack = [root]
    is_open: Counter = Counter()  # how many elements of each tag are on the stack: what isn't open is not looked for
    at, end = 0, len(page)

    def close(k: int) -> None:
        for node in stack[k:]:
            is_open[node.tag] -= 1
        del stack[k:]

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if is_open[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in SCOPES and tag not in ("table", "body", "html", "article", "main", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1) if is_open["p"] else ():
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        if tag in IMPLIED:
            ended, limit = IMPLIED[tag]
            lowest = 0
            for k in range(len(stack) - 1, 0, -1) if any(is_open[t] for t in ended) else ():
                if stack[k].tag in limit:
                    break
                if stack[k].tag in ended:
                    lowest = k
            if lowest:
                close(lowest)
        if tag in ("html", "body") and (tag == "html" or is_open["body"]):
            continue
        if tag == "body":
            close(1)
        parent = stack[-1]
        if tag in RAW and not m[0].endswith("/>"):
            ended = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = ended.end() if ended else end
            continue
        if tag in VOID:
            if tag not in INLINE:
                parent.children.append(Node(tag, parent))
            continue
        node = Node(tag, parent, parent.cut or _is_cut(tag, m[3], parent))
        parent.children.append(node)
        if not m[0].endswith("/>") or tag not in ("svg", "path"):
            stack.append(node)
            is_open[tag] += 1
    return root


def _walk(root: Node) -> tuple[list[list], list[Node]]:
    """The blocks in page order, as [container, text, linked characters], and all nodes, parents first. Blocks keep no inline markup."""
    blocks: list[list] = []
    nodes: list[Node] = []
    open_block: list | None = None
    todo: list[tuple] = [(root, root, False)]
    while todo:
        node, block, in_link = todo.pop()
        if isinstance(node, str):
            if open_block is None or open_block[0] is not block:
                open_block = [block, [], 0]
                blocks.append(open_block)
            open_block[1].append(node)
            if in_link:
                open_block[2] += len(node.strip())
            continue
        if node is None or node.tag in VOID:
            open_block = None
            continue
        if node.cut:
            if node.tag not in INLINE:
                open_block = None
            continue
        inline = node.tag in INLINE
        nodes.append(node)
        if not inline:
            open_block = None
            block = node
            todo.append((None, None, False))
        link = in_link or node.tag == "a"
        todo.extend((c, block, link) for c in reversed(node.children))
    return [[b, " ".join("".join(t).split()), linked] for b, t, linked in blocks], nodes


def _below(nodes: list[Node], tops: set[int]) -> set[int]:
    """The ids of these nodes and of all below them."""
    found = set(tops)
    for node in nodes:  # parents come first
        if id(node.parent) in found:
            found.add(id(node))
    return found


def _whole(best: Node, blocks: list[list], nodes: list[Node]) -> Node:
    """The nearest article or main element around the best container; outside of these its parent, if that adds nothing rich in links."""
    node = best
    while node is not None:
        if node.tag in ("article", "main"):
            return node
        node = node.parent
    outer = best.parent
    if outer is None or outer.tag in ("body", "html"):
        return best
    around, inside = _below(nodes, {id(outer)}), _below(nodes, {id(best)})
    added = [(t, linked) for b, t, linked in blocks if id(b) in around and id(b) not in inside]
    return outer if all(linked <= LINK_POOR * len(t) for t, linked in added) else best


def main_text(page: str | None) -> str:
    """The article's text: blocks joined by one blank."""
    if not page:
        return ""
    blocks, nodes = _walk(parse(page))
    blocks = [b for b in blocks if b[1]]
    if not blocks:
        return ""
    for block, text, linked in blocks:
        size = len(text)
        points = (1 + text.count(",") + text.count("،") + text.count("、") + size / CHARS_A_POINT) * max(0.0, 1 - linked / size)
        block.chars += size
        block.linked += linked
        # the block's own element counts as its container only if it holds more than text
        node = block.parent if block.parent is not None and block.tag not in ("div", "article", "main", "section", "body", "html", "td") else block
        level = 0
        while node is not None and level < LEVELS:
            node.points += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            node, level = node.parent, level + 1
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for node in nodes:
        if node.chars:
            node.points = (node.points + FAVOURED.get(node.tag, 0.0)) * (1 - node.linked / node.chars)
    best = _whole(max((n for n in nodes if n.tag not in INLINE), key=lambda n: n.points), blocks, nodes)
    kept = {id(best)}
    if best.parent is not None:
        least = max(1.0, SIBLING_SHARE * best.points)
        beside = {id(c): c for c in best.parent.children if isinstance(c, Node) and not c.cut and c is not best}
        own = {k: c.points for k, c in beside.items()}
        for b, t, linked in blocks:
            if id(b) in beside and not b.points:
                own[id(b)] += (1 + t.count(",") + len(t) / CHARS_A_POINT) * (1 - linked / len(t))
        kept |= {k for k, points in own.items() if points >= least}
        if not best.in_article:  # no element says where the article ends: a title, a lead or closing words may be short
            kept |= {k for k, c in beside.items() if c.chars and c.linked <= LINK_POOR * c.chars}
    inside = _below(nodes, kept)
    loose = None if best.in_article else best.parent
    return " ".join(text for block, text, linked in blocks if id(block) in inside or block is loose and linked <= LINK_POOR * len(text))


def extract_main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id_col, *keep, text string), a row for each row of df."""
    carried = [id_col, *keep]
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py()) for x in b.column(len(carried))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], texts], [*carried, "text"])

    src = df.select(*carried, F.col(html_col).cast("string").alias("__html"))
    return src.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in carried) + ", text string")
