"""Main text of web pages by tree scoring.

The html is read into a small tree of block elements, without those that a tag, a role or a name marks as boilerplate. A name made of boilerplate words alone
(comments, cookie-notice) always marks it, as long as other text is left; one that has other words too (has-sidebar) only where it does not hold most of the
page. Each paragraph-like block passes points for its length and its commas to its parent and half of them to its grandparent; a container's points are
discounted by its link density and moved by what its tag, class and id say. The article is the container with the most points, or the element that
holds it and all that score near it; every block of it is kept but lists of links.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import give_back, id_or_none, none_again

# fixed values: element names of the html standard, by role
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("script style noscript template title head iframe object svg math form button select textarea nav footer aside menu dialog xmp noembed noframes audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre td th li dd dt blockquote h1 h2 h3 h4 h5 h6 div section article figcaption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an open element of the first kind ends when a tag of the second opens
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}}
#: the elements that a tag may end
ENDED = {name: tuple(x for x, by in ENDS.items() if name in by) for name in {n for by in ENDS.values() for n in by}}
PROSE = frozenset("p pre blockquote figcaption dt dd".split())
BESIDE_TAGS = PROSE | HEADINGS | frozenset("ul ol dl table section figure".split())
NOT_WRAPPERS = frozenset("td th tr tbody table ul ol dl".split())
NO_PARAGRAPH = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "legend"}

# fixed values: words of class names and ids, of boilerplate, and such that may stand beside them
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adsense banner sponsor sponsored promo promos promotion promotions outbrain taboola cookie cookies consent "
    "gdpr notice popup modal newsletter subscribe subscription signup login paywall comment comments commentlist disqus respond replies reply discussion menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar side aside widget related recommended recommendations trending popular share sharing social footer foot masthead header topbar toolbar "
    "pagination pager pagenav skip legal copyright disclaimer search tags hidden".split()
)
BESIDE = frozenset("list box section area wrapper wrap container block panel holder inner outer unit slot thread feed bar form stories posts articles links media site page more link sr only visually".split())
WORDS = re.compile(r"[a-z]+")
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|articles?-?body|post|post-?body|entry|entry-?content|content|main|main-?content|story|story-?body|body|text|blog|page|hentry)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?<![a-z0-9])header(?![a-z0-9])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|$))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|</[^a-zA-Z>][^>]*>|</>", re.S)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>|$(?![\s\S])", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "about", "role", "hidden", "score", "links", "length", "doubtful")

    def __init__(self, tag: str, parent: Node | None, about: str = "", role: str = "", hidden: bool = False):
        self.tag, self.parent, self.about, self.role, self.hidden = tag, parent, about, role, hidden
        self.children: list[Node | tuple[str, bool]] = []  # nodes, and (text, in a link)
        self.score, self.links, self.length = 0.0, 0, 0
        self.doubtful = False  # kept below a name of boilerplate


def parse(page: str) -> Node:
    """The block elements of a page with the text between them. Unclosed tags end where the standard lets them; inline tags only mark links.

    The open elements are counted by name, so tags that end nothing cost no walk up a deep page."""
    root = node = Node("html", None)
    links, at, n = 0, 0, len(page)
    opened: Counter[str] = Counter()

    def leave(upto: Node) -> Node:
        """Ends all open elements below `upto`."""
        inner = node
        while inner is not upto:
            opened[inner.tag] -= 1
            inner = inner.parent
        return upto

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            node.children.append((page[at:], links > 0))
            break
        if lt > at:
            node.children.append((page[at:lt], links > 0))
        m = TOKEN.match(page, lt)
        if m is None:
            if page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] == "/":  # a tag cut off by the end of the page
                if page.find(">", lt) < 0:
                    break
            node.children.append(("<", links > 0))
            at = lt + 1
            continue
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                links = max(0, links - 1)
            elif name == "br":
                node.children.append((" ", links > 0))
            elif opened[name]:
                up = node
                while up.tag != name:
                    up = up.parent
                node, links = leave(up.parent), 0
            continue
        if name == "a":
            links = 1
        elif name in RAW_END:
            at = RAW_END[name].search(page, at).end()
        elif name in VOID:
            node.children.append((" ", links > 0))
        elif name in BLOCK or name in DROP:
            about, role, hidden = "", "", False
            if m.group(3):
                found = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(m.group(3))}
                about, role = f"{found.get('class', '')} {found.get('id', '')}".strip(), found.get("role", "").lower()
                hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
            if name in NO_PARAGRAPH and opened["p"]:
                up = node
                while up is not root and up.tag not in BLOCK:
                    up = up.parent
                if up.tag == "p":
                    node = leave(up.parent)
            if any(opened[x] for x in ENDED.get(name, ())):
                up = last = node
                while up is not root and up.tag not in SCOPES.get(name, {"table"}):
                    if name in ENDS.get(up.tag, ()):
                        last = up.parent
                        if up.tag == name:
                            break
                    up = up.parent
                node = leave(last)
            if name in ("html", "body"):
                continue
            child = Node(name, node, about, role, hidden)
            node.children.append(child)
            if not m.group(3).rstrip().endswith("/") or name not in ("svg", "math"):
                node = child
                opened[name] += 1
    return root


def _named(node: Node, in_article: bool) -> str:
    """What a class and id say: "plain" where a name is boilerplate words alone, "mixed" where it has others too, "" where none is of boilerplate or another
    name says content. In an article a header by class is like the header tag."""
    about = HEADER.sub(" ", node.about) if in_article else node.about
    found = ""
    for name in about.lower().split():
        words = WORDS.findall(name)
        if any(w in BOILERPLATE for w in words):
            if found != "plain":
                found = "plain" if all(w in BOILERPLATE or w in BESIDE for w in words) else "mixed"
        elif LIKELY.search(name):
            return ""
    return found


def _boilerplate(node: Node, in_article: bool, most: bool, spare: bool) -> bool:
    """Whether a node goes with all it holds; `most` says that it holds over half of the page's paragraph points, `spare` that nothing is left without the
    names of plain boilerplate."""
    if node.hidden or node.tag in DROP and node.tag != "form" or node.role in ROLES and not (most and node.tag == node.role == "form"):
        return True
    if node.tag == "form" and not most:
        return True
    if node.tag == "header":
        return not in_article
    if node.tag == "main":
        return False
    named = _named(node, in_article)
    if named == "plain" and not spare:
        return True
    return bool(named) and not most and node.tag != "article"


def _points(node: Node) -> int:
    """Points of a paragraph-like block for its own text."""
    text = _own(node).strip()
    if node.tag not in PARAGRAPH and node.parent is not None or len(text) < 25 or node.parent is None:
        return 0
    return 1 + text.count(",") + text.count("，") + min(len(text) // 100, 3)


def _prune(root: Node) -> None:
    order, stack = [], [(root, False, False)]
    plain = set()  # nodes below a name of plain boilerplate
    while stack:
        node, inside, under = stack.pop()
        order.append(node)
        if under:
            plain.add(id(node))
        inside = inside or node.tag in ("article", "main")
        for c in node.children:
            if isinstance(c, Node) and not (c.hidden or c.tag in DROP and c.tag != "form" or c.role in ROLES - {"form"}):
                stack.append((c, inside, under or c.tag != "main" and _named(c, inside) == "plain"))
    own = {id(x): _points(x) for x in order}
    spare = not any(points and key not in plain for key, points in own.items())
    below = {key: points if spare or key not in plain else 0 for key, points in own.items()}
    named = {id(x): int(x.tag in ("article", "main")) for x in order}
    for node in reversed(order):
        if node.parent is not None:
            below[id(node.parent)] += below[id(node)]
            named[id(node.parent)] += named[id(node)]
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        kept = []
        for child in node.children:
            if isinstance(child, Node):
                # a long advertisement beside a short article is not the article
                most = 2 * below.get(id(child), 0) > below[id(root)] and (inside or named[id(child)] == named[id(root)])
                if _boilerplate(child, inside, most, spare):
                    continue
                child.doubtful = node.doubtful or child.tag not in ("article", "main") and bool(_named(child, inside))
                stack.append((child, inside or child.tag in ("article", "main")))
            kept.append(child)
        node.children = kept


def _measure(root: Node) -> list[Node]:
    """Lengths of text and of link text below each node; nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    for node in reversed(order):
        for child in node.children:
            if isinstance(child, Node):
                node.length += child.length
                node.links += child.links
            else:
                size = len(child[0].strip())
                node.length += size
                node.links += size if child[1] else 0
    return order


def _density(node: Node) -> float:
    return node.links / node.length if node.length else 0.0


def _own(node: Node) -> str:
    return "".join(c[0] for c in node.children if not isinstance(c, Node))


def _score(order: list[Node]) -> list[Node]:
    """Points per container, link density taken off; the candidates."""
    found: dict[int, Node] = {}
    for node in order:
        points = _points(node)
        if not points:
            continue
        for up, share in ((node.parent, 1.0), (node.parent.parent, 0.5)):
            if up is not None:
                found[id(up)] = up
                up.score += points * share
    for node in found.values():
        base = {"article": 30, "main": 20, "section": 3, "div": 3, "blockquote": 3, "td": 3, "pre": 3}.get(node.tag, -3 if node.tag in ("ul", "ol", "dl", "li", "th") else 0)
        node.score += base + (15 if node.about and LIKELY.search(node.about) else 0) - (25 if node.doubtful else 0)
        node.score *= 1 - _density(node)
    return list(found.values())


def _blocks(nodes: list[Node | tuple[str, bool]]) -> list[str]:
    """Texts of the blocks in page order, character references decoded and white space turned to one space."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = SPACE.sub(" ", html.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, Node):
            close()
            stack.append(None)
            stack += reversed(x.children)
        else:
            line.append(x[0])
    close()
    return out


def main_text(page: str | None) -> str:
    """The article of a page as one line of text, empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    order = _measure(root)
    candidates = _score(order)
    if not candidates:
        named = [x for x in order if x.tag in ("article", "main")]
        return " ".join(_blocks(named or [root])) if root.length else ""
    place = {id(x): i for i, x in enumerate(order)}
    best = max(candidates, key=lambda x: (x.score, -place[id(x)]))
    limit = max(10.0, best.score * 0.2)
    # one article or main element around the best container is the whole of it
    above = _upwards(best)
    whole = [x for x in above if x.tag == "article"][-1:] or [x for x in above if x.tag == "main"][-1:]
    if whole:
        top = whole[0]
        if top.tag == "article" and top.parent is not None and any(isinstance(c, Node) and c is not top and c.tag in ("p", "article") for c in top.parent.children):
            return " ".join(_blocks([c for c in top.parent.children if c is top or isinstance(c, Node) and _beside(c, best, limit)]))
        return " ".join(_blocks([top]))
    # else the element around all containers that score near it
    holds = {id(x) for x in above}
    held = Counter(id(x) for x in candidates if x is best or x.score >= limit and id(x) not in holds)
    near = held.total()
    for x in reversed(order):
        if x.parent is not None and held[id(x)]:
            held[id(x.parent)] += held[id(x)]
    top = next(x for x in above if held[id(x)] == near)
    # a wrapper around the best container has the rest of its article
    while top.parent is not None and top.parent.parent is not None and top.parent.tag not in NOT_WRAPPERS and (top is best or not top.parent.about):
        top = top.parent
    inner = [c for c in top.children if c is best or not isinstance(c, Node) or not _links(c)]
    if top is root:
        return " ".join(_blocks([c for c in inner if top is best or isinstance(c, Node) and (held[id(c)] or _beside(c, best, limit))]))
    if top.parent is not root:
        return " ".join(_blocks(inner))
    chosen: list[Node | tuple[str, bool]] = []
    for c in root.children:
        chosen += inner if c is top else [c] if isinstance(c, Node) and _beside(c, best, limit) else []
    return " ".join(_blocks(chosen))


def _upwards(node: Node) -> list[Node]:
    """The node and all that hold it, up to the page."""
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def _links(node: Node) -> bool:
    """A block that is mostly links, such as a list of other pages; a paragraph or heading that is a link is text."""
    return node.tag not in PROSE and node.tag not in HEADINGS and node.length > 0 and _density(node) > 0.5


def _beside(node: Node, best: Node, limit: float) -> bool:
    """Whether a block beside the best container, with nothing around them but the page, belongs to its article: one that scores near it, prose, headings, and
    lists, tables and sections of few links."""
    alike = best.score * 0.2 if node.about and node.about == best.about else 0.0
    if node.score + alike >= limit:
        return True
    return node.tag in BESIDE_TAGS and node.length > 0 and _density(node) < 0.25


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page. Null or empty html gives empty text; null ids and urls, repeated rows and ties stay as they
    are; other columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})
        give_back()

    rows = pages.select(id_or_none("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long").withColumn("page_id", none_again("page_id"))
