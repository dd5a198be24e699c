"""Main text of HTML pages by tree scoring.

A page becomes a light tree without scripts, styles, form controls, drawings and hidden parts. Each paragraph has points,
for itself, its length and its commas, discounted by the share of its characters within links. What its element, role
or name marks as no part of an article (menus, headers and footers of the page, sidebars, notices, adverts, forms, reader
comments) goes, but never on such a mark alone: a part that holds most of the page's points stays, unless another part
looks like the article, or its name is that of reader comments and no headline is in it. The paragraphs left
pass their points to their parent, half of them to the next ancestor and less further up. The best container is kept
(widened to the article or main element around it), with those of its siblings that score well or read like text, and
the headline beside it; lists of short links inside go, lists of references stay.

Defined results: a null or empty page, and one without text, gives an empty text. Cut tags and open elements are taken
as far as they reach; unknown character references stay as written. Texts are whole whatever their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, text_bytes

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
FOREIGN = frozenset("svg math".split())
CONTROLS = frozenset("button dialog head label object select svg".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
MARKED = frozenset("aside fieldset footer form menu nav".split())
PARAGRAPH = frozenset("p pre blockquote td li dd h2 h3 h4 h5 h6 figcaption".split())
CLOSES_P = BLOCK - frozenset("br body html head option tbody td tfoot th thead tr caption".split())
#: An element that one of the same set ends, unless one of the second set stands between.
SIBLINGS = [(frozenset(a.split()), frozenset(b.split())) for a, b in (("li", "ul ol menu dir"), ("dt dd", "dl"), ("option", "select"), ("td th", "tr table"), ("tr", "table tbody thead tfoot"), ("tbody thead tfoot", "table"))]
#: Parts of class and id names that mark what is no part of an article, and those before them that say otherwise.
UNWANTED = frozenset("ad ads adbox adslot advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promos promoted promotion recommended related replies reply respond rss share sharing shoutbox sidebar skip social sponsor sponsored subscribe subscription tags toolbar widget".split())
UNLESS = frozenset("has with no without".split())
#: Names of reader comments; what makes a header that of an article; names and headings of reference lists.
READERS = frozenset("comment comments disqus replies reply respond".split())
HEADED = frozenset("article content entry post story".split())
REFERENCES = frozenset("bibliography citation citations endnotes footnote footnotes notes reference references sources".split())
WANTED = frozenset("article body content entry main page post story text".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

P, P_WALLS = frozenset("p".split()), frozenset("td th button body".split())
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|([^>]*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("chars", "commas", "headed", "hidden", "kids", "linked", "marked", "mass", "names", "points", "score", "tag", "up")

    def __init__(self, tag: str, up: Node | None):
        self.tag, self.up, self.kids = tag, up, []
        #: hidden: never part of the text; marked: no part of an article by its name; points: as a paragraph; mass: of all paragraphs inside; headed: with a headline.
        self.names, self.hidden, self.marked, self.headed = (), False, False, tag == "h1"
        self.score, self.points, self.mass, self.chars, self.linked, self.commas = 0.0, 0.0, 0.0, 0, 0, 0


def _mark(node: Node, attributes: str) -> None:
    node.hidden = node.tag in CONTROLS or node.tag in RAW
    node.marked = node.tag in MARKED or node.tag == "header" and not _inside(node, "article") and not _inside(node, "main")
    if not attributes.strip():
        return
    a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    node.names = tuple(x.lower() for x in _NAME.findall(f"{a.get('class', '')} {a.get('id', '')}"))
    if node.tag in ("html", "body", "main", "article"):
        return
    style = a.get("style", "").replace(" ", "").lower()
    node.hidden |= "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    node.marked |= a.get("role", "").lower() in ROLES
    headed = any(x in HEADED for x in node.names)
    node.marked |= any(x in UNWANTED and not (i and node.names[i - 1] in UNLESS) and not (x == "header" and headed) for i, x in enumerate(node.names))


def _inside(node: Node, tag: str) -> bool:
    while node := node.up:
        if node.tag == tag:
            return True
    return False


def parse(page: str) -> Node:
    """The tree; kids are nodes and texts as written. Hidden subtrees are left out."""
    root = Node("#root", None)
    at, here, n = 0, root, len(page)
    lower, open_ = None, Counter()

    def close(to: Node, last: Node) -> Node:
        while last is not to.up:
            open_[last.tag] -= 1
            last = last.up
        return last

    def ended(ends: frozenset[str], walls: frozenset[str]) -> Node:
        """Where the parser stands once the nearest open element of `ends` is closed, if none of `walls` is nearer."""
        if not any(open_[t] for t in ends):
            return here
        x = here
        while x.up and x.tag not in ends and x.tag not in walls:
            x = x.up
        return close(x, here) if x.tag in ends else here

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            here.kids.append(page[at:])
            break
        if m.start() > at:
            here.kids.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3] if m[3] is not None else m[4]
        if m[1]:
            if open_[tag]:
                here = ended(frozenset((tag,)), frozenset())
            elif tag == "p":
                here.kids.append(Node("br", here))
            continue
        if tag in CLOSES_P:
            here = ended(P, P_WALLS)
        for ends, walls in SIBLINGS:
            if tag in ends:
                here = ended(ends, walls)
        node = Node(tag, here)
        _mark(node, attributes)
        if not node.hidden:
            here.kids.append(node)
        elif tag in BLOCK:
            here.kids.append(Node("br", here))
        if tag in VOID or attributes.endswith("/") and (tag not in BLOCK and tag not in RAW or any(open_[t] for t in FOREIGN)):
            continue
        if tag in RAW:
            lower = lower or page.translate(_ASCII_LOWER)
            end = lower.find(f"</{tag}", at)
            close_at = page.find(">", end) if end >= 0 else -1
            at = close_at + 1 if close_at >= 0 else n
            continue
        open_[tag] += 1
        here = node
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, parents before their kids, in page order."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return out


def text_of(nodes: list[Node]) -> str:
    """Blocks of these subtrees in page order: white space made one space, ends trimmed, joined by one space."""
    parts: list[str] = []
    for root in nodes:
        stack: list = [root]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
                continue
            if x.tag in BLOCK:
                parts.append("\n")
                stack.append("\n")
            stack += reversed(x.kids)
        parts.append("\n")
    return " ".join(html.unescape("".join(parts)).split())


def _weigh(nodes: list[Node]) -> None:
    """Characters, those of them within links, commas and points, from the leaves up."""
    for x in nodes:
        x.chars, x.linked, x.commas, x.mass, x.headed = 0, 0, 0, 0.0, x.tag == "h1"
    for x in reversed(nodes):
        own = [k for k in x.kids if isinstance(k, str)]
        loose = x.tag in ("div", "section", "article", "main") and any(len(k.strip()) >= 25 for k in own)
        x.chars += sum(len(k.strip()) for k in own)
        commas = sum(k.count(",") for k in own)
        x.commas += commas
        x.linked = x.chars if x.tag == "a" else x.linked
        fine = x.chars >= 25 and (x.tag in PARAGRAPH or loose)
        x.points = (1 + (x.commas if x.tag in PARAGRAPH else commas) + min(x.chars // 100, 3)) * (1 - x.linked / x.chars) if fine else 0.0
        x.mass += x.points
        if x.up:
            x.up.chars += x.chars
            x.up.linked += x.linked
            x.up.commas += x.commas
            x.up.mass += x.mass
            x.up.headed |= x.headed


def _pruned(root: Node) -> list[Node]:
    """The nodes once marked parts that are not the article have gone; weighed."""
    nodes = _walk(root)
    _weigh(nodes)
    if not any(x.marked for x in nodes):
        return nodes

    def within(x: Node | None, outer: Node) -> bool:
        while x and x is not outer:
            x = x.up
        return x is outer

    marked = [x for x in nodes if x.marked]
    mains = [m for m in nodes if m.mass > 0.1 * root.mass and (m.tag in ("article", "main") or not m.marked and HEADED.intersection(m.names))]

    def holds(x: Node) -> bool:
        """Whether a marked part is the article all the same: most points are there, and nothing outside looks like one."""
        if x.mass <= 0.5 * root.mass or READERS.intersection(x.names) and not x.headed:
            return False
        rivals = [m for m in mains if not within(m, x) and not within(x, m)]
        return all(any(not within(x, u) and within(m, u) for u in marked) for m in rivals)

    for x in marked:
        x.hidden |= not holds(x)
    for x in nodes:
        if any(isinstance(k, Node) and k.hidden for k in x.kids):
            x.kids = [k if isinstance(k, str) or not k.hidden else Node("br", x) if k.tag in BLOCK else "" for k in x.kids]
    nodes = _walk(root)
    _weigh(nodes)
    return nodes


def _listed(x: Node) -> bool:
    """Whether this is a list of short links, as menus are, and not one of references."""
    if x.tag not in ("ul", "ol", "dl", "div", "section", "table") or x.linked <= 0.5 * x.chars:
        return False
    links = sum(y.tag == "a" for y in _walk(x))
    return not REFERENCES.intersection(x.names) and not (x.tag == "ol" or x.linked >= 30 * links) and links > 1


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = _pruned(root)
    scored: list[Node] = []
    for x in nodes:
        points = x.points
        if not points:
            continue
        loose = x.tag not in PARAGRAPH
        up, level = (x if loose else x.up), 0
        while up and up.up and level < 5:
            if not up.score:
                up.score = 5.0 if up.tag in ("article", "main") else 3.0 if up.tag in ("div", "section") else -3.0 if up.tag in ("ul", "ol", "li", "dl", "table", "td") else 0.0
                up.score += 5.0 * any(n in WANTED for n in up.names)
                scored.append(up)
            up.score += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            up, level = up.up, level + 1
    scored = [x for x in scored if x.tag not in ("html", "#root")]
    best = max(scored, key=lambda x: x.score * (1 - x.linked / max(1, x.chars)), default=None)
    if best is None:
        best = next((x for tag in ("article", "main", "body") for x in nodes if x.tag == tag and x.chars), root)
    around = best
    while around.up and best.tag not in ("article", "main"):
        around = around.up
        if around.tag in ("article", "main"):
            best = around
            break
    kept = [best]
    if best.tag not in ("article", "main", "body") and best.up:
        floor = max(10.0, best.score * 0.2)
        kept = []
        for x in best.up.kids:
            if not isinstance(x, Node):
                continue
            density = x.linked / max(1, x.chars)
            if x is best or x.score >= floor or x.tag in ("h1", "h2") and density < 0.5 or x.tag in ("p", "blockquote", "pre") and (x.chars > 80 and density < 0.25 or 0 < x.chars <= 80 and not x.linked and any(isinstance(k, str) and re.search(r"[.!?](\s|$)", k) for k in x.kids)):
                kept.append(x)
    elif best.up and not best.headed:  # the headline beside it
        kids = best.up.kids
        kept = [x for x in kids[: kids.index(best)] if isinstance(x, Node) and x.tag == "h1" and x.linked < 0.5 * x.chars] + kept
    for top in kept:  # link lists within
        for x in _walk(top):
            if x is not top and _listed(x):
                x.kids = []
    return text_of(kept)


def extract_pages(pages: DataFrame, markup: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, then text and n_chars (code points) of each row's main text."""
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            column = batch.column("__markup")
            _, offsets = text_bytes(column)
            for low, high in row_chunks(offsets, 8 << 20):
                out = [extract(x) for x in column.slice(low, high - low).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, high - low) for c in keep), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=schema.names)

    return pages.select(*keep, F.col(markup).alias("__markup")).mapInArrow(run, schema)
