"""Main text of web pages by composite text density.

A page becomes a tree. For every node the characters C, the tags T, and the link
characters and link tags LC and LT below it are counted, and its density is

    C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LCbody / Cbody * C + e))

with 1 for every zero divisor, so links weigh against a node. The subtree whose
children's densities have the greatest sum is the text; the least density on its
path to the body is the threshold that other subtrees beside that path must reach
to belong to it too. Elements that are page furniture by their tag, role, class
or id (fixed lists below) are cut out first and count nowhere; within an article,
words that name sections of a text too need links, a form or a second word. An
article or main element around the chosen subtree stands for it whole; one beside
it must reach the threshold like any other subtree.

Null or empty html, or a page without text, gives an empty text. Repeated rows
are separate rows. Pages of any length and depth are parsed whole, without
recursion. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import map_arrow, renamed

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

# HTML's elements by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section "
    "summary table tbody td tfoot th thead title tr ul xmp".split()
)
CLOSES_P = BLOCK - set("body caption html legend option optgroup tbody td tfoot th thead title tr".split())
#: A start tag ends open elements of these, up to the barrier.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}

# What is furniture by tag, by role, and by a word of class or id.
FURNITURE = set(
    "aside audio button canvas dialog embed footer form head iframe input menu nav noembed noframes noscript object script search select style svg "
    "template textarea title video".split()
)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = set(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs byline combx comment commentlist comments consent "
    "cookie cookies copyright discussion disclaimer disqus dropdown feedback footer foot gdpr hidden header login masthead menu modal nav "
    "navbar navigation navigator newsletter notice notices notification overlay pager pagination paywall popup privacy promo promoted promotion "
    "recommendations recommended related remark replies reply respond response responses reviews share sharing shoutbox sidebar sidenav signup "
    "skip social sponsor sponsored sponsors subscribe subscription toc toolbar topbar widget widgets".split()
)
#: With these words beside it, or within an article, "header" is the text's own; with the others the element only lies beside furniture.
OWN = set("article body content entry post story text".split())
BESIDE = set("has no with without".split())
#: Of WORDS, those that name sections of a text too: within an article they need links, a form or a word of LISTED.
AMBIGUOUS = set(
    "copyright discussion disclaimer feedback menu navigation notice notices privacy promotion recommendations recommended related response "
    "responses reviews share sharing social".split()
)
LISTED = set("articles bar block box buttons cards container content form icons items links list news posts stories thread widget".split())
#: Round an article these mark furniture too.
PLAIN = set("ad ads advert advertisement advertising promo promoted recommendations recommended related sidebar sponsored sponsors widget widgets".split())
CONTENT = ("article", "main")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "words", "cut", "content", "C", "T", "LC", "LT", "density", "total", "link")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.words: set[str] = set()
        self.cut = False
        self.content: list[Node | str] = []
        self.C = self.T = self.LC = self.LT = 0
        self.density = self.total = 0.0
        self.link = tag == "a" or bool(parent and parent.link)


def _marks(node: Node, attributes: str) -> None:
    """Reads what tells furniture from an element's attributes."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            node.words.update(x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value))
        elif name == "role":
            node.cut |= value.strip().lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            node.cut = True
        elif name == "style":
            node.cut |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))


def parse(page: str) -> list[Node]:
    """The page's elements in document order; the first is the root."""
    root = Node("html", None)
    nodes, stack = [root], [root]
    body: Node | None = None
    at = 0
    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].content.append(text)
        if not m:
            return nodes
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag not in ("html", "body"):
                        del stack[i:]
                    break
            else:
                if tag == "br":
                    stack[-1].content.append(" ")
            continue
        if tag == "html" or tag == "body" and body is not None:
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK or stack[i].tag in ("button", "object"):
                    break
        if tag in ENDS:
            ends, barrier = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in barrier:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    if tag != "tr":
                        break
        node = Node(tag, stack[-1])
        body = node if tag == "body" else body
        if m[3].strip("/ \t\r\n\f"):
            _marks(node, m[3])
        stack[-1].content.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            node.content.append(page[at : end.start() if end else len(page)])
            at = page.find(">", end.end() - 1) + 1 if end else len(page)
            at = at or len(page)
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCK - VOID:
            stack.append(node)


def _compound(n: Node) -> bool:
    """Whether a class or id names furniture by two words, such as related-posts or comment-list."""
    return bool(n.words & AMBIGUOUS and n.words & LISTED)


def _linked(n: Node) -> bool:
    """Whether more than half of a subtree's characters are in links, or it holds a form."""
    chars = links = 0
    todo = [n]
    while todo:
        x = todo.pop()
        if x.tag == "form":
            return True
        if x.tag in RAW:
            continue
        own = sum(len("".join(html.unescape(c).split())) for c in x.content if isinstance(c, str))
        chars, links = chars + own, links + own * x.link
        todo.extend(c for c in x.content if isinstance(c, Node))
    return 2 * links > chars or not chars


def _cut(nodes: list[Node]) -> None:
    """Marks furniture and everything in it."""
    holds: set[int] = set()  # elements around an article or main element are furniture only by what is plain (FURNITURE, roles, hiding, PLAIN words)
    inside: set[int] = set()
    for n in nodes:
        if n.tag in CONTENT:
            p = n.parent
            while p and id(p) not in holds:
                holds.add(id(p))
                p = p.parent
        if n.tag in CONTENT or n.parent and id(n.parent) in inside:
            inside.add(id(n))
    for n in nodes:
        if n.parent and n.parent.cut:
            n.cut = True
            continue
        if n.tag in ("html", "body"):
            n.cut = False
        elif id(n) in holds:
            n.cut |= n.tag in ("aside", "nav", "footer") or n.tag != "main" and not n.words & BESIDE and (bool(n.words & PLAIN) or _compound(n))
        elif n.tag in FURNITURE or n.tag == "header" and id(n) not in inside:
            n.cut = True
        elif (words := n.words & WORDS) and not (n.tag == "main" or n.tag in HEADINGS or n.tag == "header" or n.words & BESIDE):
            if id(n) in inside and words <= AMBIGUOUS:
                n.cut |= _compound(n) or _linked(n)
            else:
                n.cut |= words != {"header"} or not (id(n) in inside or n.words & OWN)


def _log(x: float) -> float:
    return math.log(x) if x > 1 else 0.0


def _measure(nodes: list[Node], body: Node) -> None:
    """Counts and densities; children come after their parents, so one pass from the end adds them up."""
    page_c = page_l = 0
    own: dict[int, int] = {}
    for n in nodes:
        if n.tag in RAW:
            continue
        chars = sum(len("".join(html.unescape(x).split())) for x in n.content if isinstance(x, str))
        page_c += chars
        page_l += chars * n.link
        if not n.cut:
            own[id(n)] = n.C = chars
            n.LC = chars * n.link
    for n in reversed(nodes):
        if not n.cut and n.parent:
            p = n.parent
            p.C, p.LC = p.C + n.C, p.LC + n.LC
            p.T, p.LT = p.T + n.T + 1, p.LT + n.LT + n.link
    ratio = page_l / page_c if page_c else 0.0
    for n in nodes:
        if n.cut or not n.C:
            continue
        weight = _log(_log(n.C / ((n.C - n.LC) or 1) * n.LC + ratio * n.C + math.e))
        adjusted = _log(n.C / (n.LC or 1) * (n.T or 1) / (n.LT or 1))
        n.density = n.C / (n.T or 1) * (adjusted / weight if weight else 1.0)
    for n in nodes:
        if not n.cut:
            n.total += own.get(id(n), 0)  # text of its own counts like a child without tags
            if n.parent:
                n.parent.total += n.density


def _menu(n: Node) -> bool:
    """A block that is all links is a menu wherever it stands."""
    return n.tag in BLOCK and n.tag != "p" and n.LT >= 3 and n.LC > 0.8 * n.C


def choose(nodes: list[Node]) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    _cut(nodes)
    _measure(nodes, body)
    best = max((n for n in nodes if not n.cut), key=lambda n: n.total, default=body)
    path = [best]
    while path[-1] is not body and path[-1].parent:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    for tag in CONTENT:
        if around := [n for n in path if n.tag == tag]:
            return [around[-1]]
    chosen = {id(best): best}
    onpath = {id(n) for n in path}
    for n in nodes:
        if n.parent and id(n.parent) in onpath and id(n.parent) != id(best) and id(n) not in onpath and not n.cut:
            if n.C and (n.density >= threshold and not _menu(n) or _headings_only(n)):
                chosen[id(n)] = n
    return [n for n in nodes if id(n) in chosen]


def _headings_only(n: Node) -> bool:
    """Whether all text of a subtree is in first or second headings."""
    todo = [n]
    while todo:
        x = todo.pop()
        if x.tag in ("h1", "h2") or x.cut:
            continue
        if any(isinstance(c, str) and c.strip() for c in x.content):
            return False
        todo.extend(c for c in x.content if isinstance(c, Node))
    return True


def _within(n: Node, tops: list[Node]) -> bool:
    p = n.parent
    while p:
        if any(p is t for t in tops):
            return True
        p = p.parent
    return False


def blocks(top: Node) -> list[str]:
    """The texts of a subtree's blocks, white space made one space."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if text := " ".join(html.unescape("".join(now)).split()):
            out.append(text)
        now.clear()

    todo: list[Node | str | None] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.cut or x is not top and _menu(x):
            now.append(" ")
        elif x.tag == "br":
            now.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.content))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(b for top in choose(parse(page)) for b in blocks(top))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    own = renamed(pages, **{page_id: "page_id", url: "url", page: "html"})
    return map_arrow(own, rows, "page_id long, url string, text string, n_chars long")
