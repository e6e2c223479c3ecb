"""Main text of web pages by composite text density.

A page is parsed into a tree.  Every node's composite density is its characters for each tag,
adjusted by how much of it stands in links; a node's sum is that of its children's densities.
The node with the largest sum is the content.  The thinnest node on its path to the body gives
the threshold: along the path, siblings below it go where they are mostly links or, at the body,
much thinner; an ``article`` or ``main`` on the path bounds the content instead.  Elements and
names that are no content by their own statement (menus, footers, forms, adverts, comments, ...)
don't count; names that may mean either way decide only where densities don't: they cut what
doesn't hold the densest node.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import table

#: After a name, attributes in the standard's states: a value in quotes, or up to white space.
_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>|[!?/][^>]*+>)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed plaintext".split())
#: Elements that never hold main text.
CUT_TAGS = frozenset("script style noscript iframe template svg canvas object audio video head title nav footer aside form button select textarea input label fieldset dialog menu menuitem datalist noframes noembed map".split())
#: Roles, and words of class names and ids, that mark what surrounds an article.
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav aside masthead footer "
    "comment comments commentlist disqus respond replies cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login paywall".split()
)
#: Words that mark it only where the densest node lies elsewhere, and words that speak for an article beside them.
MAYBE_WORDS = frozenset(
    "promo promotion rail header foot reply notice notices notification alert share sharing social related recommended widget widgets form search toolbar pagination pager skip banner copyright tags toc".split()
)
CONTENT_WORDS = frozenset("post story entry article content body text".split())
#: Words of class names that say whether something is there.
ABOUT = frozenset("has have with no without is".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An element's start ends an open one of the second kind, unless one of the third stands between.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, set()),
}
#: An end tag doesn't reach beyond these.
_WALLS = frozenset("table td th article main section nav aside footer header form body".split())
_INNER = frozenset("section article main nav aside footer header form div body table".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


#: What is certainly no content, what may be none, and all else.
SURE, MAYBE, NOT = 2, 1, 0


class Node:
    __slots__ = ("tag", "parent", "kids", "cut", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, cut: int):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _cut_of(tag: str, attrs: str) -> int:
    if tag in CUT_TAGS:
        return SURE
    if not attrs or tag in ("html", "body", "article", "main"):
        return NOT
    out = NOT
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in CUT_ROLES or name == "style" and re.search(r"display\s*:\s*none", value):
            return SURE
        if name in ("class", "id"):
            for one in value.split():  # has-sidebar and the like speak of what is elsewhere
                words = {w.lower() for part in re.split(r"[^A-Za-z0-9]+", one) if part for w in {part, *_WORDS.findall(part)}}
                if ABOUT & words:
                    continue
                if CUT_WORDS & words:
                    return SURE
                if MAYBE_WORDS & words and not CONTENT_WORDS & words:
                    out = MAYBE
    return out


class _Open:
    """The open elements; where each kind of them stands is known without walking up."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # other than paragraphs
        self.walls: list[int] = []

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.where.setdefault(node.tag, []).append(at)
        if node.tag in BLOCKS and node.tag != "p":
            self.blocks.append(at)
        if node.tag in _WALLS:
            self.walls.append(at)
        self.stack.append(node)

    def last(self, tag: str) -> int:
        at = self.where.get(tag)
        return at[-1] if at else 0

    def cut_to(self, at: int) -> None:
        """Closes all from the place ``at`` on."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.where[node.tag].pop()
            for kind in (self.blocks, self.walls):
                if kind and kind[-1] == len(self.stack):
                    kind.pop()

    def end(self, name: str) -> None:
        at = self.last(name)
        if at and name != "body" and (name in _INNER or not self.walls or self.walls[-1] <= at):
            self.cut_to(at)

    def start(self, name: str) -> None:
        """Closes what the start of an element ends."""
        if name in _ENDS_P:
            at = self.last("p")
            if at and (not self.blocks or self.blocks[-1] < at):
                self.cut_to(at)
        if name in _IMPLIED:
            ends, walls = _IMPLIED[name]
            wall = max((self.last(w) for w in walls), default=0)
            firsts = []
            for tag in ends:
                places = self.where.get(tag, ())
                k = bisect.bisect_right(places, wall)
                firsts += places[k : k + 1]
            if firsts:
                self.cut_to(min(firsts))


def parse(page: str) -> Node:
    """The page's tree, by the rules for omitted end tags; never fails, in time linear in the page."""
    root = Node("html", None, NOT)
    open_ = _Open(root)
    at, n = 0, len(page)
    last = page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            open_.top.kids.append(page[at:])
            break
        m = _TAG.match(page, lt)
        if not m:  # a bare "<", or a tag that the page's end cuts off
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] in "/!") and lt > last:
                open_.top.kids.append(page[at:lt])
                break
            open_.top.kids.append(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            open_.top.kids.append(page[at:lt])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name == "p" or name == "br":
                open_.top.kids.append(Node("br", open_.top, NOT))
            open_.end(name)
            continue
        if name == "html":
            continue
        open_.start(name)
        node = Node(name, open_.top, _cut_of(name, m["attrs"]))
        open_.top.kids.append(node)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            node.kids.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif name not in VOID:
            open_.push(node)
    return root


def _settle(root: Node) -> list[Node]:
    """Decides what is certainly cut, and gives the nodes that are left, parents before children."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    holds: set[int] = set()  # nodes around an article, and headers with a heading: no words in a class cut those
    for node in order:
        if node.tag in ("article", "main", "body"):
            up = node.parent
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    left, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.tag == "header":
            own = any(isinstance(k, Node) and re.fullmatch("h[1-6]|hgroup", k.tag) for k in node.kids)
            node.cut = NOT if inside and own else SURE
        if node.cut and node.tag not in CUT_TAGS and id(node) in holds:
            node.cut = NOT
        if node.cut == SURE:
            continue
        left.append(node)
        inside = inside or node.tag in ("article", "main")
        stack.extend((k, inside) for k in reversed(node.kids) if isinstance(k, Node))
    return left


def _densities(nodes: list[Node], counts: int) -> None:
    """Densities and sums of all nodes, where nodes of a ``cut`` above ``counts`` have no text."""
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = 0.0
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len("".join(k.split()))
            elif k.cut <= counts:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    whole = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - lc) * lc + whole * c + math.e)
            node.density = max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(max(base, 1.0 + 1e-9)) if base > 1.0 else c / t * math.log(max(1.0, c / max(1, lc) * t / lt)))
        node.sum = sum(k.density for k in node.kids if isinstance(k, Node) and k.cut <= counts)


def _path(node: Node) -> list[Node]:
    """The node, its parent, and so on to the root."""
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def _densest(nodes: list[Node]) -> Node:
    """The node with the largest sum, the first of equals; within what may be no content only where it is three times the largest elsewhere."""
    _densities(nodes, NOT)
    doubtful: set[int] = set()
    for node in nodes:  # parents first
        if node.cut == MAYBE or id(node.parent) in doubtful:
            doubtful.add(id(node))
    best = max((x for x in nodes if id(x) not in doubtful), key=lambda x: x.sum)
    if doubtful:
        most = best.sum
        _densities(nodes, MAYBE)
        other = max((x for x in nodes if id(x) in doubtful), key=lambda x: x.sum)
        if other.sum > 3 * most:
            return other
        _densities(nodes, NOT)
    return best


_RIGHTS = re.compile(r"\s*(?:©|&copy;|\(c\)|copyright\b)", re.I)


def _thin(node: Node, threshold: float, at_body: bool, apart: bool) -> bool:
    """Whether a sibling of the path falls to the threshold; ``apart`` says that the densest node isn't the body itself."""
    if node.tag not in BLOCKS or node.density >= threshold:
        return False
    first = next((k for k in node.kids if isinstance(k, str) and k.strip()), "")
    return node.link_chars * 2 > node.chars or at_body and (apart and node.density * 4 < threshold or bool(_RIGHTS.match(first)))


def main_text(page: str | None) -> str:
    """The page's main text: white space as one blank within and between blocks, none at the ends."""
    if not page:
        return ""
    nodes = _settle(parse(page))
    best = _densest(nodes)
    path = _path(best)
    on = {id(x) for x in path}
    top = next((x for x in path if x.tag in ("article", "main")), None)
    drop: set[int] = set()
    if top is None:
        top = path[-1]
        within = [x for x in path if x.tag not in ("html", "body")]
        # Of a page whose body itself is the densest node the mean of its blocks takes the path's place.
        blocks = [k.density for k in best.kids if isinstance(k, Node) and k.cut != SURE and k.tag in BLOCKS and k.chars]
        threshold = min((x.density for x in within), default=sum(blocks) / max(1, len(blocks)))
        for x in path if not within else path[1:]:
            drop |= {id(k) for k in x.kids if isinstance(k, Node) and id(k) not in on and k.cut != SURE and _thin(k, threshold, x.tag in ("html", "body") and best.sum > 0, bool(within))}
    out: list[str] = []
    stack: list[Node | str] = [top]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(html.unescape(k))
        elif (not k.cut or k.cut == MAYBE and id(k) in on) and id(k) not in drop:
            if k.tag in BLOCKS:
                out.append("\n")
                stack.append("\n")
            stack.extend(reversed(k.kids))
    return " ".join("".join(out).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html).

    Null and empty pages have the empty text; a null url stays null; repeated rows give repeated
    results; other columns are ignored.  Pages are taken whole, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
