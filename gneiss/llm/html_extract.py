"""HTML main text by composite text density.

A page becomes a tree (start tags that imply end tags, void elements, raw text of scripts and styles,
unclosed ends of cut-off pages). Elements that hold no article by their kind go first: scripts, styles, menus,
footers, sidebars, dialogs, forms. So do those whose role, or a whole word of whose class or id, says that they are
a page's header, notices, adverts or reader comments (see ``clean``), however large they are. Over the
rest each node has C characters, T tags, and LC, LT of them in links;

    density = C / T * log base ln(C / notLC * LC + LCb / Cb * C + e) of (C / LC * T / LT)

where b is the body, and zero counts stand as 1 (composite text density; Sun, Song and Liao, 2011). A
node's density sum adds those of its children. The subtree of the largest sum wins, and the smallest
density on its path to the body is the threshold.

The winner grows to the element around it as long as what that adds isn't made of links for the most part and
is a third as dense as the threshold; inside an ``article`` or ``main``, or where paragraphs and the like are all
that is added, the first will do. It stops growing at an ``article`` or ``main``. Elsewhere on the page, each node that reaches the threshold gives its subtree of the largest sum.
Articles beside a winning article and headings above the winner count as its parts.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined in page order by one space. Nothing is capped. Work is linear in a page's length.

Defined results: null or empty html gives an empty text; a page without mark-up is one block; repeated
rows have a row each; an empty table gives no row; null ids and other columns come back as they are. No shuffle:
one pass over the pages.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from html import unescape

from pyspark.sql import DataFrame

from gneiss.llm.common import derived

#: Elements of the HTML standard by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "tbody": ("thead tbody tfoot tr td th", "table"), "thead": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

#: Elements that are content by themselves; others are when what they hold is.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())

#: Elements that hold no article text, wherever they stand.
NEVER = frozenset("script style head title noscript template iframe object embed applet svg math canvas audio video select button textarea input datalist dialog nav menu aside footer noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id that say what a node is for, and words that may stand beside them.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored sponsors promo promoted promotion promotions "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sitenav topnav subnav "
    "footer foot colophon copyright sidebar sidebars aside rail "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay paywall disclaimer "
    "newsletter subscribe subscription signup login signin register searchform searchbox "
    "comment comments commentlist respond reply replies disqus "
    "share sharing social related recommended recommendations teaser widget widgets toolbar skiplink".split()
)
BESIDE = frozenset(
    "site page main content wrapper wrap container box block bar area list section item items holder inner outer top bottom left right primary secondary "
    "global local mobile desktop fixed sticky unit slot panel post posts article articles user users reader readers link links button buttons icon icons "
    "title heading text body form msg message policy center row col column group footer header small large wide js the and in on of by".split()
)
#: Of these: what always goes, and what inside an article goes only if its density says so too.
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
STRONG_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored sponsors promo promoted promotion promotions "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay paywall disclaimer "
    "newsletter subscribe subscription signup login signin register".split()
)
SOFT_WORDS = frozenset("related recommended recommendations teaser widget widgets".split())
STRONG_ROLES = frozenset("dialog alertdialog alert".split())
NONE, SOFT, WEAK, STRONG = range(4)
#: What a page's header is called; where an article's begins is called so too, but with other words.
TITLED, TITLED_BESIDE = frozenset("header masthead topbar".split()), frozenset("site global top main wrapper container inner bar outer".split())
SAFE = frozenset("html body main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNITS = frozenset("article main".split())

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*?)(/?)(>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Node:
    __slots__ = ("attributes", "chars", "children", "density", "link_chars", "link_tags", "name", "parent", "sum", "tags", "top", "unit")

    def __init__(self, name: str, parent: Node | None, attributes: str = ""):
        self.name, self.parent, self.attributes = name, parent, attributes
        self.children: list[Node | str] = []


class Open:
    """The open elements, and by name how deep they lie: no tag has to walk up the tree."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.depths: dict[str, list[int]] = {}
        self.inline = [1]  # at each depth: where the run of inline elements that ends there begins

    def push(self, node: Node) -> None:
        depth = len(self.stack)
        self.stack.append(node)
        self.depths.setdefault(node.name, []).append(depth)
        self.inline.append(min(self.inline[-1], depth) if node.name in INLINE else depth + 1)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.depths[self.stack.pop().name].pop()
            self.inline.pop()

    def deepest(self, names: frozenset[str]) -> int:
        return max((d[-1] for n in names if (d := self.depths.get(n))), default=0)

    def close(self, name: str) -> None:
        """An end tag; one that matches nothing open, or only beyond a table or article, is left out."""
        at = self.depths.get(name)
        if at and (name in ENDS_ALL or self.deepest(BARRIERS) <= at[-1]):
            self.cut(at[-1])

    def begin(self, name: str) -> None:
        """Leave the open paragraph, heading, list item, row or cell that a start tag ends."""
        if name in PARAGRAPH_ENDS:
            under = self.inline[-1] - 1
            if self.stack[under].name == "p":
                self.cut(under)
            elif name in HEADINGS and self.stack[-1].name in HEADINGS:
                self.cut(len(self.stack) - 1)
        if name in CLOSES:
            ends, within = CLOSES[name]
            least = self.deepest(within)
            found = [d[i] for n in ends if (d := self.depths.get(n)) and (i := bisect_right(d, least)) < len(d)]
            if found:
                self.cut(min(found))


BARRIERS = frozenset("table article main body html".split())
ENDS_ALL = BARRIERS | {"div", "section"}


def parse(html: str) -> Node:
    """The tree under a root of name ``#root``. Texts are raw: references are decoded later."""
    root = Node("#root", None)
    opened = Open(root)
    at, end = 0, len(html)
    while at < end:
        here = opened.stack[-1]
        m = TOKEN.search(html, at)
        if not m:
            here.children.append(html[at:])
            break
        if m.start() > at:
            here.children.append(html[at : m.start()])
        at = m.end()
        if m[1] is not None:
            here.children.append(m[1].replace("&", "&amp;"))
        if not m[3] or not m[6]:  # no tag, or a tag that the page's end cuts off
            continue
        name = m[3].lower()
        if m[2]:
            opened.close(name)
            continue
        opened.begin(name)
        here = opened.stack[-1]
        node = Node(name, here, m[4])
        here.children.append(node)
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            node.children.append(html[at : stop.start() if stop else end])
            at = stop.end() if stop else end
        elif name not in VOID and not (m[5] and (opened.depths.get("svg") or opened.depths.get("math"))):
            opened.push(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(node.attributes)}


def says(said: str, words: frozenset[str], beside: frozenset[str]) -> bool:
    """Whether one of the words of a class or id, as a whole, is of ``words``: all its parts are, but for some of ``beside``."""
    for token in said.split():
        parts = [p.lower() for p in WORDS.findall(token)]
        if any(p in words for p in parts) and all(p in words or p in beside for p in parts):
            return True
    return False


def hinted(node: Node, in_article: bool) -> int:
    """How strongly a node says that it holds no article: NONE, SOFT, WEAK or STRONG."""
    name = node.name
    if name in SAFE or name == "#root":
        return NONE
    if name == "header":
        return NONE if in_article else WEAK
    if not node.attributes:
        return NONE
    got = attributes(node)
    role = got.get("role", "").lower() if name != "form" else ""
    if role in ROLES:
        return STRONG if role in STRONG_ROLES else WEAK
    said = got.get("class", "")
    if name not in TEXTS and name not in INLINE:  # headings and the like have ids after what they say
        said += " " + got.get("id", "")
    if name == "article":
        return STRONG if says(said, COMMENT_WORDS, BESIDE) else NONE
    if says(said, STRONG_WORDS, BESIDE):
        return STRONG
    if says(said, NOISE - SOFT_WORDS, BESIDE) or (not in_article and says(said, TITLED, TITLED_BESIDE)):
        return WEAK
    return SOFT if says(said, NOISE, BESIDE) else NONE


def in_order(root: Node) -> list[Node]:
    """All nodes, parents before their children."""
    nodes = [root]
    for n in nodes:
        nodes.extend(c for c in n.children if isinstance(c, Node))
    return nodes


def counted(root: Node) -> None:
    """Characters and tags of all nodes, and of their links, as they stand; whether an article or main is inside."""
    for n in reversed(in_order(root)):
        n.chars, n.tags, n.link_chars, n.link_tags, n.unit = 0, 1, 0, 0, n.name in UNITS
        if n.name in NEVER:
            n.unit, n.tags = False, 0
            continue
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(SPACE.sub(" ", c).strip())
            else:
                n.chars, n.tags, n.link_chars, n.unit = n.chars + c.chars, n.tags + c.tags, n.link_chars + c.link_chars, n.unit or c.unit
        if n.name == "a":
            n.link_chars = n.chars


def agrees(node: Node, parent: Node) -> bool:
    """Whether a node's density says so too: a third of its text is links, or it is thin against what is beside it."""
    chars, tags = parent.chars - node.chars, parent.tags - node.tags
    return 3 * node.link_chars > node.chars or 3 * node.chars * max(1, tags) < chars * max(1, node.tags)


def goes(node: Node, parent: Node, in_article: bool) -> int:
    """How strongly a node is to go. A form around an article or main is the page's, not the reader's."""
    if node.name in NEVER:
        return STRONG
    if node.name == "form" and not node.unit:
        return WEAK
    hint = hinted(node, in_article)
    return NONE if hint == SOFT and in_article and not agrees(node, parent) else hint


def clean(root: Node) -> None:
    """Take out what is no article by its kind, whatever its size.

    What says it is comments, an advert or a notice always goes, with the articles in it. Other hints give way only where all else is
    empty: a page whose articles all lie inside such nodes keeps these, and one without any other text keeps them all.
    """
    counted(root)
    free_unit = held_unit = free_text = False
    stack = [(root, False, False)]
    while stack:  # what would be left, and what hints hold
        node, in_article, held = stack.pop()
        in_article = in_article or node.name in UNITS
        free_unit, held_unit = free_unit or (node.name in UNITS and not held), held_unit or (node.name in UNITS and held)
        for c in node.children:
            if isinstance(c, str):
                free_text = free_text or (not held and bool(c.strip()))
            else:
                hint = goes(c, node, in_article)
                if hint != STRONG:
                    stack.append((c, in_article, held or hint != NONE))
    stack2 = [(root, False)]
    while stack2:
        node, in_article = stack2.pop()
        in_article = in_article or node.name in UNITS
        kept: list[Node | str] = []
        for c in node.children:
            if isinstance(c, str):
                kept.append(c)
                continue
            hint = goes(c, node, in_article)
            stays = hint == NONE or (hint != STRONG and not free_unit and (c.unit if held_unit else not free_text))
            if stays:
                kept.append(c)
                stack2.append((c, in_article))
            elif c.name not in INLINE:
                kept.append(Node("#gap", node))  # the texts at either side are blocks of their own
        node.children = kept


def measure(root: Node, body: Node) -> list[Node]:
    """Counts, densities and density sums of all nodes, which are returned parents first."""
    nodes = in_order(root)
    for n in reversed(nodes):
        n.chars, n.tags, n.link_chars, n.link_tags = sum(len(SPACE.sub(" ", c).strip()) for c in n.children if isinstance(c, str)), int(n.name != "#gap"), 0, 0
        for c in n.children:
            if isinstance(c, Node):
                n.chars += c.chars
                n.tags += c.tags
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags
        if n.name == "a":
            n.link_chars, n.link_tags = n.chars, n.tags
    share = body.link_chars / max(1, body.chars)
    for n in nodes:
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, share)
    for n in reversed(nodes):
        n.sum = sum(c.density for c in n.children if isinstance(c, Node))
        n.top = n  # the node of the largest density sum in the subtree, the first of equals
        for c in n.children:
            if isinstance(c, Node) and c.top.sum > n.top.sum:
                n.top = c.top
    return nodes


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; ``share``: of the body's characters, those in links."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    return chars / max(1, tags) * max(0.0, math.log(max(1e-9, chars / max(1, link_chars) * max(1, tags) / max(1, link_tags))) / math.log(max(base, 1.0001)))


def grown(node: Node, body: Node, least: float) -> Node:
    """The winner with what is around it, as long as that is text rather than links, and not thin where no article or main says it belongs."""
    around, inside = node.parent, False
    while around and around is not body and not inside:
        inside, around = around.name in UNITS, around.parent
    share = body.link_chars / max(1, body.chars)
    while node.name not in UNITS and node is not body and node.parent and node.parent is not body:
        p = node.parent
        rest = p.chars - node.chars, p.tags - node.tags, p.link_chars - node.link_chars, p.link_tags - node.link_tags
        beside = all(c is node or c.name in TEXTS or c.name == "#gap" for c in p.children if isinstance(c, Node))
        if rest[0] and (2 * rest[2] > rest[0] or not (inside or beside or 3 * density(*rest, share) >= least)):
            break
        node = p
    return node


def content(body: Node) -> list[Node]:
    """The subtrees that are content, in page order, none inside another."""
    top = body.top
    if top.sum <= 0:
        return [body]
    path, node = [top], top
    while node is not body and node.parent:
        node = node.parent
        path.append(node)
    least = min(n.density for n in path)
    winner = grown(top, body, least)
    marked, above = [winner], {id(n) for n in path}
    if winner is not body and winner.parent:
        if winner.name == "article":  # articles side by side are one page's text
            marked += [c for c in winner.parent.children if isinstance(c, Node) and c.name == "article" and 2 * c.link_chars <= c.chars]
        else:
            marked += [c for n in path[path.index(winner) + 1 :] for c in n.children if isinstance(c, Node) and c.name in HEADINGS and 2 * c.link_chars <= c.chars]
    stack = [body]
    while stack:
        n = stack.pop()
        if n is winner:
            continue
        if id(n) not in above and n.density >= least and n.chars and (n.top.sum > 0 or n.name in TEXTS):
            marked.append(n.top)
            if n.top is n:
                continue
        stack.extend(c for c in n.children if isinstance(c, Node))
    return _outermost(body, marked)


def blocks(nodes: list[Node]) -> list[str]:
    """The blocks of subtrees in page order. Elements that aren't inline, and line breaks, part blocks."""
    out: list[str] = []
    now: list[str] = []

    def part() -> None:
        text = SPACE.sub(" ", unescape("".join(now))).strip()
        if text:
            out.append(text)
        now.clear()

    for node in nodes:
        part()
        stack: list[Node | str | None] = [node]
        while stack:
            n = stack.pop()
            if n is None:
                part()
            elif isinstance(n, str):
                now.append(n)
            elif n.name in INLINE:
                stack.extend(reversed(n.children))
            else:
                part()
                stack.append(None)
                stack.extend(reversed(n.children))
    part()
    return out


def _outermost(top: Node, nodes: list[Node]) -> list[Node]:
    """``nodes`` in page order, without those inside others."""
    wanted = set(map(id, nodes))
    out, stack = [], [top]
    while stack:
        n = stack.pop()
        if id(n) in wanted:
            out.append(n)
        else:
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    clean(root)
    body, stack = root, [root]
    while stack:
        n = stack.pop()
        if n.name == "body":
            body = n
            break
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    measure(root, body)
    return " ".join(blocks(content(body)))


def extract(pages: DataFrame, keep: list[str] | None = None, html: str = "html") -> DataFrame:
    """Columns ``keep`` (page_id and url), text and n_chars."""

    def made(pages: list) -> list[list]:
        texts = [main_text(h) for h in pages]
        return [texts, [len(t) for t in texts]]

    return derived(pages, ["page_id", "url"] if keep is None else keep, html, {"text": "string", "n_chars": "long"}, lambda: made, 100)
