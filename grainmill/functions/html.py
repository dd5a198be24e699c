"""Parsed pages for extraction: a flat, pre-ordered table of elements, with selectors and paths over it.

An element is a row: tag, attributes, parent, the row after its last descendant, and its part of the page's text runs.
So a subtree is a range of rows, and the first match within one is the first row of the range that fits.
"""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LINES = frozenset("p div br li tr section article header footer h1 h2 h3 h4 h5 h6 blockquote pre ul ol table figure figcaption main aside nav".split())
UNREAD = frozenset("script style noscript template".split())
#: An open element that the start of one of these ends, up to the nearest of the walls.
ENDED = {
    "p": (frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), frozenset("td th body".split())),
    "li": (frozenset(("li",)), frozenset(("ul", "ol"))),
    "td": (frozenset(("td", "th", "tr")), frozenset(("table",))),
    "th": (frozenset(("td", "th", "tr")), frozenset(("table",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
#: Where an element has its value besides its text.
VALUES = {"time": "datetime", "a": "href", "link": "href", "area": "href", "img": "src", "source": "src", "iframe": "src", "embed": "src", "audio": "src", "video": "src", "script": "src", "input": "value", "data": "value", "abbr": "title"}


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: int
    end: int = 0
    runs: tuple[int, int] = (0, 0)
    order: int = field(default=0)


class Page(HTMLParser):
    def __init__(self, url: str, markup: str):
        super().__init__(convert_charrefs=True)
        self.url, self.rows, self.runs, self._open = url, [Element("#root", {}, -1)], [], [0]
        self.feed(markup)
        self.close()
        while self._open:
            self._close()

    def _close(self) -> None:
        row = self._open.pop()
        x = self.rows[row]
        x.end, x.runs = len(self.rows), (x.runs[0], len(self.runs))
        if x.tag in LINES:
            self.runs.append((x.parent, "\n"))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            open_ = self.rows[self._open[depth]].tag
            by, walls = ENDED.get(open_, ((), ()))
            if tag in by:
                while len(self._open) > depth:
                    self._close()
                break
            if any(open_ in ENDED[t][1] for t in ENDED if tag in ENDED[t][0]):
                break
        held: dict[str, str] = {}
        for k, v in attrs:
            held.setdefault(k.lower(), (v or "").strip())
        self.rows.append(Element(tag, held, self._open[-1], runs=(len(self.runs), 0)))
        self._open.append(len(self.rows) - 1)
        if tag in VOID:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            if self.rows[self._open[depth]].tag == tag:
                while len(self._open) > depth:
                    self._close()
                return

    def handle_data(self, data: str) -> None:
        self.runs.append((self._open[-1], data))

    # reading

    def text(self, row: int = 0) -> str:
        first, last = self.rows[row].runs
        return "".join(t for own, t in self.runs[first:last] if not self._unread(own, row))

    def _unread(self, own: int, top: int) -> bool:
        while own > top:
            if self.rows[own].tag in UNREAD:
                return True
            own = self.rows[own].parent
        return self.rows[top].tag in UNREAD

    def raw(self, row: int) -> str:
        first, last = self.rows[row].runs
        return "".join(t for own, t in self.runs[first:last] if own == row)

    def value(self, row: int) -> str:
        x = self.rows[row]
        if x.tag == "meta":
            return x.attributes.get("content", "")
        return x.attributes.get(VALUES.get(x.tag, ""), "") or x.attributes.get("content", "") or self.text(row).strip()

    def describe(self, row: int) -> str:
        x = self.rows[row]
        for key in ("itemprop", "property", "name", "rel", "class", "id", "datetime", "type"):
            if v := x.attributes.get(key):
                return f"<{x.tag} {key}={v if len(v) <= 40 else v[:40] + '...'}>"
        return f"<{x.tag}>"

    def range(self, row: int) -> range:
        return range(row + (row == 0), self.rows[row].end)

    def first(self, row: int, test) -> int | None:
        return next((i for i in self.range(row) if test(i)), None)

    @functools.cached_property
    def maps(self) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
        """What the page says of itself: meta (the last of a name counts), linked data, microdata (the first counts)."""
        meta: dict[str, str] = {}
        linked: dict[str, str] = {}
        micro: dict[str, str] = {}
        for i, x in enumerate(self.rows):
            a = x.attributes
            if x.tag == "meta" and a.get("content"):
                meta.update({a[k].lower(): a["content"] for k in ("property", "name", "itemprop", "http-equiv") if a.get(k)})
            elif x.tag == "link" and a.get("rel") and a.get("href"):
                meta["link:" + a["rel"].lower()] = a["href"]
            elif x.tag == "script" and a.get("type", "").lower() == "application/ld+json":
                try:
                    linked_values(json.loads(self.raw(i).strip()), linked)
                except ValueError:
                    pass
            if a.get("itemprop"):
                micro.setdefault(a["itemprop"].lower(), self.value(i))
        return meta, linked, micro

    def hrefs(self) -> list[str]:
        return [x.attributes["href"] for x in self.rows if x.tag == "a" and x.attributes.get("href")]


#: An ampersand that begins no character reference with its semicolon, and what stands for it while a page is parsed: no text holds a lone surrogate.
_BARE = re.compile(r"&(?!#?[a-zA-Z0-9]+;)")
_STOOD = "\udc26"


class Closed(Page):
    """A page whose character references count only with their semicolon: one cut short stands as it is written, where HTML would still know `&amp`."""

    def __init__(self, url: str, markup: str):
        super().__init__(url, _BARE.sub(_STOOD, markup))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag.replace(_STOOD, "&"), [(k.replace(_STOOD, "&"), v and v.replace(_STOOD, "&")) for k, v in attrs])

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag.replace(_STOOD, "&"))

    def handle_data(self, data: str) -> None:
        super().handle_data(data.replace(_STOOD, "&"))


def linked_values(data, into: dict[str, str]) -> None:
    """Scalars of linked data by name and by dotted path, the shallowest and first of a name counting; lists stay at their level."""
    level = [("", data)]
    while level:
        deeper = []
        for name, x in level:
            if isinstance(x, list):
                level += [(name, y) for y in x]
            elif isinstance(x, dict):
                deeper += [(f"{name}.{k}".lstrip(".").lower(), x[k]) for k in sorted(x)]
            elif x is not None and name:
                text = ("true" if x else "false") if isinstance(x, bool) else repr(x) if isinstance(x, float) and not x.is_integer() else str(int(x)) if isinstance(x, float) else str(x)
                if text.strip():
                    into.setdefault(name, text)
        level = deeper


# Selectors: groups of compound parts, joined by descendant, child, next and later sibling combinators.
_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:(not)\(|:(first-child|last-child|only-child|empty|first-of-type|last-of-type)(?!\()|:(nth-child|nth-of-type)\(\s*([^)]*?)\s*\)""")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"(?:([+-]?\d*)n)?\s*([+-]?\s*\d+)?")


def _nth(text: str) -> tuple[int, int] | None:
    """a and b of an+b."""
    text = {"odd": "2n+1", "even": "2n"}.get(text.lower(), text.lower())
    m = _NTH.fullmatch(text)
    if not text or not m:
        return None
    step = 0 if "n" not in text else int((m[1] or "") + "1") if m[1] in (None, "", "+", "-") else int(m[1])
    return step, int((m[2] or "0").replace(" ", ""))


def _compound(text: str, at: int, whole: str) -> tuple[list, int]:
    """The tests of a compound part that begins here, and where it ends."""
    tests = []
    while m := _SIMPLE.match(text, at):
        tag, id_, cls, attr, op, v1, v2, v3, negated, kind, nth, places = m.groups()
        at = m.end()
        if negated:
            inner, at = _compound(text, at, whole)
            if not inner or text[at : at + 1] != ")":
                raise ValueError(f"no selector: {whole!r}")
            at += 1
            tests.append(("not", inner, None))
        elif nth:
            if (place := _nth(places)) is None:
                raise ValueError(f"no selector: {whole!r}")
            tests.append((nth, *place))
        elif attr:
            tests.append(("attribute", attr.lower(), (op, v1 if v1 is not None else v2 if v2 is not None else v3)))
        else:
            tests.append(("tag", tag.lower(), None) if tag else ("id", id_, None) if id_ else ("class", cls, None) if cls else (kind, None, None))
    return tests, at


@functools.cache
def selector(text: str):
    """Compiled: a list of alternatives, each (combinator, tests) from the last part to the first. ValueError if it isn't one."""
    groups, at = [], len(text) - len(text.lstrip())
    while True:
        parts, joint = [], " "
        while True:
            tests, end = _compound(text, at, text)
            if not tests:
                raise ValueError(f"no selector: {text!r}")
            parts.append((joint, tests))
            at = end
            rest = text[at:].lstrip()
            if not rest or rest[0] == ",":
                break
            m = _COMBINATOR.match(text, at)
            if not m:
                raise ValueError(f"no selector: {text!r}")
            joint, at = m[1] or " ", m.end()
        groups.append(parts[::-1])
        if not rest:
            return groups
        at = len(text) - len(rest[1:].lstrip())


def _kin(page: Page, row: int) -> list[int]:
    """The element and its siblings, in order."""
    parent = page.rows[row].parent
    out, i = [], max(parent, 0) + (parent >= 0)
    while i < page.rows[max(parent, 0)].end:
        out.append(i)
        i = page.rows[i].end
    return out


def _test(page: Page, row: int, kind: str, a, b) -> bool:
    x = page.rows[row]
    if kind == "tag":
        return a in ("*", x.tag)
    if kind == "id":
        return x.attributes.get("id") == a
    if kind == "class":
        return a in x.attributes.get("class", "").split()
    if kind == "not":
        return not all(_test(page, row, *t) for t in a)
    if kind == "attribute":
        have, (op, want) = x.attributes.get(a), b
        if have is None or not op:
            return have is not None
        return {"=": have == want, "~=": want in have.split(), "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have, "|=": have == want or have.startswith(want + "-")}[op]
    if kind == "empty":
        return x.end == row + 1 and x.runs[0] == x.runs[1]
    kin = _kin(page, row)
    if kind.endswith("of-type"):
        kin = [i for i in kin if page.rows[i].tag == x.tag]
    place = kin.index(row) + 1
    if kind.startswith("nth"):
        return (place - b) % abs(a) == 0 and (place - b) // a >= 0 if a else place == b
    return kind.startswith("first") and place == 1 or kind.startswith("last") and place == len(kin) or kind == "only-child" and len(kin) == 1


def _fits(page: Page, row: int, parts) -> bool:
    joint, tests = parts[0]
    if page.rows[row].tag == "#root" or not all(_test(page, row, *t) for t in tests):
        return False
    if len(parts) == 1:
        return True
    if joint in "+~":
        kin = _kin(page, row)
        before = kin[: kin.index(row)]
        return any(_fits(page, i, parts[1:]) for i in (before[-1:] if joint == "+" else before))
    above = page.rows[row].parent
    while above >= 0:
        if _fits(page, above, parts[1:]):
            return True
        if joint == ">":
            return False
        above = page.rows[above].parent
    return False


def selects(page: Page, row: int, compiled) -> bool:
    return any(_fits(page, row, parts) for parts in compiled)


def css_first(page: Page, within: int, text: str) -> int | None:
    compiled = selector(text)
    return page.first(within, lambda i: selects(page, i, compiled))


# Paths: steps along axes with predicates; what a path gives are nodes (row, None), attributes and texts (row, value).
_LEXEME = re.compile(r"""\s*(?:(//|\.\.|::|!=|<=|>=|[/.@()\[\],|=<>*])|"([^"]*)"|'([^']*)'|(\d+(?:\.\d+)?)|([A-Za-z_][\w.-]*(?::(?!:)[A-Za-z_][\w.-]*)?))""")
AXES = ("ancestor", "ancestor-or-self", "attribute", "child", "descendant", "descendant-or-self", "following-sibling", "parent", "preceding-sibling", "self")
FUNCTIONS = {"position": (0, 0), "last": (0, 0), "contains": (2, 2), "starts-with": (2, 2), "normalize-space": (0, 1), "string": (0, 1), "string-length": (0, 1), "not": (1, 1), "count": (1, 1)}


class _Paths:
    """Reads a path into nested tuples."""

    def __init__(self, text: str):
        self.text, self.at, self.tokens = text, 0, []
        end = 0
        while text[end:].strip():
            m = _LEXEME.match(text, end)
            if not m:
                raise self.wrong()
            kind = next(i for i, x in enumerate(m.groups()) if x is not None)
            self.tokens.append(("sign text text number name".split()[kind], m[kind + 1]))
            end = m.end()

    def wrong(self) -> ValueError:
        return ValueError(f"no path: {self.text!r}")

    def sees(self, *values: str, ahead: int = 0) -> bool:
        return self.at + ahead < len(self.tokens) and self.tokens[self.at + ahead][0] in ("sign", "name") and self.tokens[self.at + ahead][1] in values

    def take(self, *values: str) -> str | None:
        if not self.sees(*values):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, value: str) -> None:
        if not self.take(value):
            raise self.wrong()

    def whole(self):
        paths = [self.path()]
        while self.take("|"):
            paths.append(self.path())
        if self.at < len(self.tokens):
            raise self.wrong()
        return paths

    def path(self):
        first = self.take("/", "//")
        steps = [("descendant-or-self", "node()", ())] if first == "//" else []
        if first == "/" and self.at == len(self.tokens):
            return True, steps
        steps.append(self.step())
        while by := self.take("/", "//"):
            steps += [("descendant-or-self", "node()", ())] * (by == "//") + [self.step()]
        return bool(first), steps

    def step(self):
        if self.take("."):
            return "self", "node()", ()
        if self.take(".."):
            return "parent", "node()", ()
        axis = "child"
        if self.take("@"):
            axis = "attribute"
        elif self.sees("::", ahead=1):
            axis = self.tokens[self.at][1]
            self.at += 2
            if axis not in AXES:
                raise self.wrong()
        if self.take("*"):
            test = "*"
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            test = self.tokens[self.at][1].lower()
            self.at += 1
            if self.take("("):
                self.need(")")
                if test not in ("text", "node"):
                    raise self.wrong()
                test += "()"
        else:
            raise self.wrong()
        tests = []
        while self.take("["):
            tests.append(self.either())
            self.need("]")
        return axis, test, tuple(tests)

    def either(self):
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.compared()
        while self.take("and"):
            left = ("and", left, self.compared())
        return left

    def compared(self):
        left = self.single()
        sign = self.take("=", "!=", "<", ">", "<=", ">=")
        return (sign, left, self.single()) if sign else left

    def single(self):
        if self.at == len(self.tokens):
            raise self.wrong()
        kind, value = self.tokens[self.at]
        if kind in ("text", "number"):
            self.at += 1
            return kind, value if kind == "text" else float(value)
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        if kind == "name" and self.sees("(", ahead=1) and value not in ("text", "node"):
            self.at += 2
            given = []
            while not self.take(")"):
                if given:
                    self.need(",")
                given.append(self.either())
            if value not in FUNCTIONS or not FUNCTIONS[value][0] <= len(given) <= FUNCTIONS[value][1]:
                raise self.wrong()
            return "call", value, given
        return "path", self.path()


@functools.cache
def path(text: str):
    """A path, compiled. ValueError if it isn't one."""
    return _Paths(text).whole()


def _text_of(page: Page, node) -> str:
    return page.text(node[0]) if node[1] is None else node[1]


def _along(page: Page, row: int, axis: str):
    """The elements along an axis, nearest first where it leads back."""
    above = lambda r: page.rows[r].parent
    if axis in ("child", "descendant", "descendant-or-self"):
        if axis == "descendant-or-self":
            yield row
        i, end = row + 1, page.rows[row].end
        while i < end:
            yield i
            i = page.rows[i].end if axis == "child" else i + 1
    elif axis in ("self", "parent"):
        if (r := row if axis == "self" else above(row)) >= 0:
            yield r
    elif axis.startswith("ancestor"):
        r = row if axis == "ancestor-or-self" else above(row)
        while r >= 0:
            yield r
            r = above(r)
    elif row:
        kin = _kin(page, row)
        at = kin.index(row)
        yield from kin[at + 1 :] if axis == "following-sibling" else kin[:at][::-1]


def _step(page: Page, nodes: list, axis: str, test: str, tests: tuple) -> list:
    out, seen = [], set()
    for row, value in nodes:
        if value is not None:
            found = [(row, value)] if axis == "self" else []
        elif axis == "attribute":
            a = page.rows[row].attributes
            found = [(row, v) for v in (a.values() if test == "*" else [a[test]] if test in a else [])]
        elif test == "text()":
            found = [(r, t) for r in ([row] if axis == "child" else _along(page, row, axis)) if (t := page.raw(r))]
        else:
            found = [(r, None) for r in _along(page, row, axis) if test == "node()" or r > 0 and test in ("*", page.rows[r].tag)]
        for t in tests:
            found = [x for i, x in enumerate(found) if _holds(_value_of(page, t, x, i + 1, len(found)), i + 1)]
        for x in found:
            if x not in seen:
                seen.add(x)
                out.append(x)
    return out


def _holds(value, place: int) -> bool:
    return value == place if isinstance(value, float) else bool(value)


def _value_of(page: Page, e, node, place: int, last: int):
    """A node list, a text, a number or a truth value."""
    kind = e[0]
    inner = lambda x: _value_of(page, x, node, place, last)
    text = lambda v: v if isinstance(v, str) else (_text_of(page, v[0]) if v else "") if isinstance(v, list) else f"{v:g}" if isinstance(v, float) else str(v).lower()
    if kind in ("text", "number"):
        return e[1]
    if kind == "path":
        return _nodes(page, [(0, None)] if e[1][0] else [node], e[1][1])
    if kind in ("or", "and"):
        return any(map(bool, (inner(e[1]), inner(e[2])))) if kind == "or" else bool(inner(e[1])) and bool(inner(e[2]))
    if kind == "call":
        name, given = e[1], [inner(x) for x in e[2]]
        if name in ("position", "last"):
            return float(place if name == "position" else last)
        if name == "not":
            return not given[0]
        if name == "count":
            return float(len(given[0])) if isinstance(given[0], list) else 0.0
        own = [text(x) for x in given] or [_text_of(page, node)]
        if name in ("contains", "starts-with"):
            return own[1] in own[0] if name == "contains" else own[0].startswith(own[1])
        return " ".join(own[0].split()) if name == "normalize-space" else float(len(own[0])) if name == "string-length" else own[0]
    sides = [inner(e[1]), inner(e[2])]
    each = [[_text_of(page, x) for x in v] if isinstance(v, list) else [v] for v in sides]
    return any(_compares(kind, a, b) for a in each[0] for b in each[1])


def _compares(sign: str, a, b) -> bool:
    if sign in ("=", "!=") and not isinstance(a, float) and not isinstance(b, float):
        return (a == b) == (sign == "=")
    try:
        a, b = float(a), float(b)
    except ValueError:
        return sign == "!="
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[sign]


def _nodes(page: Page, nodes: list, steps: list) -> list:
    for axis, test, tests in steps:
        nodes = _step(page, nodes, axis, test, tests)
    return nodes


def xpath_first(page: Page, within: int, text: str) -> tuple[int, str | None] | None:
    """The first match's row, and its value where the path ends at an attribute or text."""
    found = [x for top, steps in path(text) for x in _nodes(page, [(0 if top else within, None)], steps) if x != (0, None)]
    return min(found, key=lambda x: x[0]) if found else None
