"""Main text of web pages by composite text density.

A tolerant parser builds a tree from the markup. What a browser does not show (scripts, styles,
form controls, hidden parts) is left out. Every other node gets a composite density: characters
per tag, times a logarithm that falls with the share of linked characters and linked tags. The node
with the largest sum of its children's densities is the content; the least density on its path
to the body is the threshold that other subtrees must reach to be content too.

Marks weigh on the densities, they do not decide. All characters of a strongly marked element (a
menu, footer or sidebar by its kind or role, or a class name made of nothing but words such as
``ad`` or ``cookie-notice``) count as linked, and half of those of a weakly marked one (a form, or a
class name with such a word among others). A mark is void where the element holds most of the
text of its article or page (over 90 % if strong, half if weak), so a wrapper with an unlucky name
loses nothing. Inside the content, strongly marked elements go, weakly marked ones go if their
density is below the threshold, and so do rows of two links or more without other text.

If the largest sum is that of a paragraph or of less, the element around it is the content; a content
node inside an ``article`` (or ``main``) stands for the whole of it, so that headings and short
paragraphs stay. An ``h1`` that is not marked is always content.

Text: character references are decoded, white space in a block becomes one space, blocks are
trimmed and joined by newlines in page order. Null and empty pages give the empty text;
markup that is cut off or badly nested is closed as browsers would in the common cases.
Repeated rows get equal results. The columns of the input stay; the result is one column.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, frugal

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: What closes an open paragraph.
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "tbody", "thead", "tfoot", "tr"}
#: Elements that the start of one of the same group closes, and where the search for them ends.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("html table caption td th button object template marquee".split())
#: What is never shown as text.
DROPPED = frozenset(
    "head script style noscript template title button select option optgroup datalist input textarea iframe "
    "frame frameset object embed applet canvas svg math audio video map link meta xmp noembed noframes".split()
)
#: Elements that are no part of an article by their kind; ``header`` is one outside of article and main.
APART = frozenset("nav footer aside dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar alert dialog alertdialog form".split())
#: Words of class names and ids that mark what is no article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense sponsor sponsored sponsors promo "
    "promotion banner nav navbar navigation topnav sidenav menu submenu breadcrumb breadcrumbs sidebar aside footer colophon "
    "comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login social share sharing related recommended recommendations widget widgets "
    "pagination pager toolbar masthead".split()
)
#: Words that say nothing beside a mark: ``ad-box`` is an advert, ``social-science`` is not.
FILLERS = frozenset("area bar block box container content group inner list main notice outer panel section site top unit wrap wrapper".split())
#: Marks only outside of article and main.
PAGE_MARKS = frozenset("header topbar".split())
NEVER = frozenset("html body main".split())
#: Elements whose ids are made from their text, to link to them.
ANCHORS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd a span figure table tr td".split())
#: What can be the content as a whole.
HOLDERS = frozenset("body article main section div td th center form fieldset details figure".split())
WEAK, STRONG = 1, 2
#: Shares of the text of an element's article or page above which a mark on it is void.
VOID_SHARE = {WEAK: 0.5, STRONG: 0.9}

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NO_MARK = re.compile(r"\b(?:with|has|no|without)[-_]\w+", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "kids", "dropped", "mark", "scope", "own", "chars", "tags", "links", "linked", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids, self.dropped, self.mark = tag, parent, [], False, 0
        #: the article, main or page that the node is in
        self.scope = self if parent is None else parent if parent.tag in ("article", "main") else parent.scope
        self.own = self.chars = self.tags = self.links = 0
        self.linked = self.link_chars = self.link_tags = self.density = self.sum = 0.0


def _named(value: str, in_article: bool) -> int:
    """The mark of a class or id attribute."""
    mark = 0
    for token in _NO_MARK.sub("", value).split():
        parts = {x for x in _SPLIT.split(_CAMEL.sub("-", token).lower()) if x}
        words = parts & MARKS if in_article else parts & (MARKS | PAGE_MARKS)
        if words:
            mark = max(mark, STRONG if parts - words <= FILLERS else WEAK)
    return mark


def _marked(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is never shown, and its mark."""
    if tag in DROPPED:
        return True, 0
    mark = STRONG if tag in APART or (tag == "header" and not in_article) else WEAK if tag == "form" else 0
    for m in _ATTRIBUTE.finditer(attributes) if attributes and tag not in NEVER else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, 0
        if name == "style" and "display:none" in value.lower().replace(" ", ""):
            return True, 0
        if name == "role" and value.lower() in ROLES:
            mark = STRONG
        elif name == "class" or (name == "id" and tag not in ANCHORS):
            mark = max(mark, _named(value, in_article))
    return False, mark


def parse(html: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order."""
    root = Node("body", None)
    nodes, now, at = [root], root, 0
    opened: dict[str, int] = {}  # open elements by tag, so that no search climbs for what isn't open

    def close(upto: Node) -> Node:
        n = now
        while True:
            opened[n.tag] -= 1
            if n is upto:
                return upto.parent
            n = n.parent

    while True:
        m = _TAG.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            now.kids.append(text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ends, attributes = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if ends:
            if tag == "br":
                now.kids.append(" ")
                continue
            if not opened.get(tag):
                continue
            n = now
            while n is not root and n.tag != tag and not (n.tag in ("table", "td", "th") and tag not in BLOCK | {"td", "th"}):
                n = n.parent
            if n is not root and n.tag == tag:
                now = close(n)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and opened.get("p"):
            n = now
            while n is not root and n.tag != "p" and n.tag not in SCOPE:
                n = n.parent
            if n is not root and n.tag == "p":
                now = close(n)
        if tag in SIBLINGS and any(opened.get(t) for t in SIBLINGS[tag][0]):
            same, until = SIBLINGS[tag]
            n, last = now, None
            while n is not root and n.tag not in until:
                if n.tag in same:
                    last = n
                n = n.parent
            if last is not None:
                now = close(last)
        node = Node(tag, now)
        node.dropped, node.mark = _marked(tag, attributes or "", node.scope is not root)
        node.dropped |= now.dropped
        now.kids.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not (attributes or "").endswith("/"):
            now = node
            opened[tag] = opened.get(tag, 0) + 1
    return root, nodes


def measure(nodes: list[Node]) -> None:
    """Densities and sums of all nodes that are shown (page order: parents come first); marks that are void are taken off."""
    shown = [n for n in nodes if not n.dropped]
    for n in reversed(shown):
        n.own = sum(len(k.strip()) for k in n.kids if type(k) is str)
        n.chars += n.own
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.tags += n.tags + 1
            n.parent.links += n.links + (n.tag == "a")
    for n in shown:
        if n.mark and n.chars > VOID_SHARE[n.mark] * n.scope.chars:
            n.mark = 0
        n.linked = max(n.parent.linked if n.parent is not None else 0.0, 1.0 if n.tag == "a" or n.mark == STRONG else 0.5 if n.mark == WEAK else 0.0)
    for n in reversed(shown):
        n.link_chars += n.linked * n.own
        if n.parent is not None:
            n.parent.link_chars += n.link_chars
            n.parent.link_tags += n.link_tags + n.linked
    whole = nodes[0]
    linked = whole.link_chars / max(1, whole.chars)
    for n in shown:
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, linked)
        if n.parent is not None:
            n.parent.sum += n.density


def density(chars: int, tags: int, link_chars: float, link_tags: float, linked: float) -> float:
    """Composite density of a node; ``linked`` is the share of linked characters of the page."""
    if not chars:
        return 0.0
    tags = max(1, tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + linked * chars + math.e)
    plain = chars / max(1, link_chars) * tags / min(tags, max(1, link_tags))
    return chars / tags * math.log(plain) / max(1.0, math.log(base)) if plain > 1 else 0.0


def content(root: Node, nodes: list[Node]) -> tuple[list[Node], float]:
    """The subtrees that are the page's article, and the threshold."""
    measure(nodes)
    live = [n for n in nodes if not n.dropped and n.chars]
    if not live:
        return [], 0.0
    best = max(live, key=lambda n: n.sum)
    while best.tag not in HOLDERS:
        best = best.parent
    path, n = [], best
    while n is not None:
        path.append(n)
        n = n.parent
    if best is root:
        return [root], min(n.density for n in live if n.parent in (None, root))
    threshold = min(n.density for n in path[:-1])
    best = next((n for kind in ("article", "main") for n in path if n.tag == kind), best)
    chosen, held = [], set(map(id, path[path.index(best) :]))
    away = set()  # inside of what is strongly marked
    for n in live:
        if n.mark == STRONG or id(n.parent) in away:
            away.add(id(n))
        elif n is best:
            chosen.append(n)
        elif id(n) not in held and id(n.parent) in held and n.parent is not best and n.density >= threshold > 0:
            chosen.append(n)
        elif n.tag == "h1" and id(n) not in held and not _under(n, chosen):
            chosen.append(n)
    return [n for n in chosen if not _under(n.parent, chosen)], threshold


def aside(n: Node, threshold: float) -> bool:
    """Whether a node inside the content is no part of it."""
    if n.mark:
        return n.mark == STRONG or n.density < threshold
    return n.tag in BLOCK and n.links > 1 and 5 * n.link_chars >= 4 * n.chars


def _under(n: Node | None, tops: list[Node]) -> bool:
    while n is not None:
        if n in tops:
            return True
        n = n.parent
    return False


def blocks(top: Node, threshold: float = 0.0) -> Iterator[str]:
    """Texts of the blocks below a node, in page order."""
    line: list[str] = []
    stack: list = [top]
    while stack:
        k = stack.pop()
        if k is None:
            yield "".join(line)
            line.clear()
        elif type(k) is str:
            line.append(unescape(k) if "&" in k else k)
        elif not k.dropped and not aside(k, threshold):
            block = k.tag in BLOCK
            if block:
                yield "".join(line)
                line.clear()
            elif k.tag in ("br", "td", "th"):
                line.append(" ")
            if block:
                stack.append(None)
            stack += reversed(k.kids)
    yield "".join(line)


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    root, nodes = parse(html)
    out = []
    tops, threshold = content(root, nodes)
    for top in tops:
        for b in blocks(top, threshold):
            b = " ".join(b.split())
            if b:
                out.append(b)
    return "\n".join(out)


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df with the main text of each whole page as the column ``out`` (an existing one is replaced)."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("string")
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([extract(p) for p in pages.to_pylist()], pa.string())

    return df.withColumn(out, run(F.col(html)))
