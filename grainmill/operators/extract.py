"""Declared shapes out of HTML: one Arrow function finds all properties' raw values; all after it is columns.

A property is looked for by its selectors, its paths, its patterns over the page's text, and then by what pages say of
themselves (meta, linked data, microdata), well-known elements, and class or id names. The first that matches counts,
even if it matched an element without a value.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..functions import text as T
from ..functions.batches import by_row
from ..plans.job import Item, Property

FOUND = "array<struct<item:string,raw:map<string,string>,how:map<string,string>,where:map<string,string>,missing:array<string>>>"
WELL_KNOWN = [(("title", "headline"), ("h1", "title")), (("published", "date", "pubdate"), ("time",)), (("body", "content", "articlebody"), ("article", "main"))]


def _forms(name: str) -> set[str]:
    name = name.strip().lower()
    return {name, re.sub("[_: -]", "", name), re.sub("[-: ]", "_", name), re.sub("[_: ]", "-", name)} - {""}


def _names(p: Property) -> set[str]:
    return set().union(*[_forms(n) for n in (p.name, *p.aliases)])


def _answers(names: set[str], said: str) -> bool:
    said = said.strip().lower()
    last = re.split("[:.]", said)[-1]
    return bool((_forms(said) | _forms(last)) & names)


class Found:
    """One property's value, and those nested in it by dotted name."""

    __slots__ = ("how", "inner", "missing", "outside", "raw", "where")

    def __init__(self, raw: str, how: str, where: str):
        self.raw, self.how, self.where, self.inner, self.missing, self.outside = raw, how, where, {}, [], False


def _value(page: html.Page, p: Property, raw: str, how: str, where: str, row: int | None) -> Found | None:
    out = Found(raw.strip(), how, where)
    for nested in p.properties:
        inner = find(page, nested, row or 0)
        if inner is None:
            if nested.required:
                out.missing.append(f"{p.name}.{nested.name}")
            continue
        if row is None or inner.outside:
            inner.how, inner.where, inner.outside = "semantics", f"{inner.where} (outside {p.name})", False
        out.inner[nested.name] = inner
    return out if out.raw or out.inner else None


def _known_element(page: html.Page, names: set[str], within: int) -> int | None:
    tags = next((t for said, t in WELL_KNOWN if any(_answers(names, s) for s in said)), None)
    if tags is None:
        return None
    first = lambda row, tag: page.first(row, lambda i: page.rows[i].tag == tag)
    for box in ("article", "main"):
        if (inside := first(within, box)) is not None:
            for tag in tags:
                if tag != box and (row := first(inside, tag)) is not None and row != inside:
                    return row
    return next((row for tag in tags if (row := first(within, tag)) is not None), None)


def _named_element(page: html.Page, names: set[str], within: int) -> int | None:
    return page.first(within, lambda i: any(_answers(names, t) for k in ("id", "class") for t in page.rows[i].attributes.get(k, "").split()))


def find(page: html.Page, p: Property, within: int = 0) -> Found | None:
    at = lambda row, how: _value(page, p, page.value(row), how, page.describe(row), row)
    for s in p.css:
        if (row := html.css_first(page, within, s)) is not None:
            return at(row, "css")
    for s in p.xpath:
        if (hit := html.xpath_first(page, within, s)) is not None:
            return at(hit[0], "xpath") if hit[1] is None else _value(page, p, hit[1], "xpath", page.describe(hit[0]), hit[0])
    if p.regex:
        text = page.text()
        for s in p.regex:
            if m := re.search(s, text):
                return _value(page, p, (m[1] or "") if m.re.groups else m[0], "regex", "page text", None)
    names, scoped = _names(p), within != 0

    def by_element() -> Found | None | bool:
        for look in (_known_element, _named_element):
            if (row := look(page, names, within)) is not None:
                return at(row, "semantics")
        return False

    if scoped and (got := by_element()) is not False:
        return got
    for held, before, after in zip(page.maps, ("<meta ", "json-ld ", "<itemprop "), (">", "", ">"), strict=True):
        for said in sorted(held):
            if _answers(names, said):
                if got := _value(page, p, held[said], "semantics", f"{before}{said}{after}", None):
                    got.outside = scoped
                return got
    if not scoped and (got := by_element()) is not False:
        return got
    if p.properties and not (p.css or p.xpath or p.regex):
        return _value(page, p, "", "semantics", "", None)
    return None


def read_item(page: html.Page, item: Item) -> dict | None:
    raw: dict[str, str] = {}
    how: dict[str, str] = {}
    where: dict[str, str] = {}
    missing: list[str] = []
    own = {p.name for p in item.properties}
    far = [Property(r.name, properties=r.properties) for r in item.relations if r.properties and r.name not in own]
    for p in (*item.properties, *far):
        got = find(page, p)
        if got is None:
            if p.required:
                missing.append(p.name)
            continue
        missing += got.missing
        for name, x in ((p.name, got), *((f"{p.name}.{k}", v) for k, v in got.inner.items())):  # one level of nesting, as records have
            raw[name], how[name], where[name] = x.raw, x.how, x.where
    return {"item": item.name, "raw": raw, "how": how, "where": where, "missing": missing} if raw else None


def check(items: tuple[Item, ...]) -> None:
    """Compiles every locator; one that can't be is an error before any page is read."""
    for item in items:
        todo = [*item.properties, *(p for r in item.relations for p in r.properties)]
        while todo:
            p = todo.pop()
            [html.selector(s) for s in p.css], [html.path(s) for s in p.xpath], [re.compile(s) for s in p.regex]
            todo += p.properties


def reader(items: tuple[Item, ...], with_text: bool = True, closed: bool = False):
    """An Arrow-backed function of (url, markup) with found items, links and, if asked for, the page's text; closed: character references count only with their semicolon."""
    check(items)
    parse = html.Closed if closed else html.Page

    def read(url: str | None, markup: str | None) -> dict:
        page = parse(url or "", markup or "")
        found = [{k: list(v.items()) if isinstance(v, dict) else v for k, v in x.items()} for i in items if (x := read_item(page, i))]
        return {"items": found, "links": list(dict.fromkeys(page.hrefs())), "text": page.text() if with_text else None}

    return by_row(read, f"struct<items:{FOUND},links:array<string>,text:string>")


def read_pages(pages: DataFrame, items: tuple[Item, ...], url: str = "url", markup: str = "html", with_text: bool = False, closed: bool = False) -> DataFrame:
    """pages with `found` (items), `links` (absolute, distinct, in order) and `page_text` (null unless asked for)."""
    out = pages.withColumn("__read", reader(items, with_text, closed)(F.col(url), F.col(markup)))
    links = F.array_distinct(F.filter(F.transform("__read.links", lambda h: urls.absolute(F.col(url), h)), lambda x: x != ""))
    return out.withColumn("found", F.col("__read.items")).withColumn("links", links).withColumn("page_text", F.col("__read.text")).drop("__read")


def records(read: DataFrame, items: tuple[Item, ...], spec: str = "") -> DataFrame:
    """Records of read pages (url, found, fetched, seq): raw values transformed as their properties ask."""
    rows = read.select("url", "fetched", "seq", F.explode("found").alias("x"))
    rows = rows.select(F.col("x.item").alias("item"), "url", F.lit(spec).alias("spec"), "fetched", F.col("x.raw").alias("values"), F.col("x.how").alias("how"), F.col("x.where").alias("where"), F.col("x.missing").alias("missing"), "seq")
    asked = [(i.name, n, p) for i in items for top in i.properties for n, p in [(top.name, top), *((f"{top.name}.{q.name}", q) for q in top.properties)] if p.transforms]

    def changed(k: Column, v: Column) -> Column:
        out = v
        for item, name, p in asked:
            new = v
            for t in p.transforms:
                new = urls.absolute(F.col("url"), new) if t == "absurl" else T.TRANSFORMS[t](new)
            out = F.when((F.col("item") == item) & (k == name), new).otherwise(out)
        return out

    return rows.withColumn("values", F.transform_values("values", changed)) if asked else rows


def fill_rates(read: DataFrame, items: tuple[Item, ...]) -> DataFrame:
    """item, property, pages, found, by_css, by_xpath, by_regex, by_semantics, empty, missing, rate; every declared property has a row."""
    declared = [(i.name, n) for i in items for top in i.properties for n in [top.name, *(f"{top.name}.{q.name}" for q in top.properties)]]
    names = F.array(*[F.struct(F.lit(i).alias("item"), F.lit(n).alias("property")) for i, n in declared]).cast("array<struct<item:string,property:string>>")
    shape = F.broadcast(read.sparkSession.range(1).select(F.inline(names)))  # as many rows as a job declares; no Python workers for them
    pages = read.agg(F.count("*").alias("pages"))
    got = read.select(F.explode("found").alias("x"))
    values = got.select(F.col("x.item").alias("item"), F.explode(F.map_entries("x.raw")).alias("e"), "x.how").select("item", F.col("e.key").alias("property"), F.col("e.value").alias("v"), F.col("how")[F.col("e.key")].alias("by"))
    counts = values.groupBy("item", "property").agg(F.count_if(F.col("v") != "").alias("found"), *[F.count_if((F.col("by") == b) & (F.col("v") != "")).alias(f"by_{b}") for b in ("css", "xpath", "regex", "semantics")], F.count_if(F.col("v") == "").alias("empty"))
    out = shape.join(counts, ["item", "property"], "left").crossJoin(pages).na.fill(0)
    return out.withColumn("missing", F.col("pages") - F.col("found") - F.col("empty")).withColumn("rate", F.try_divide(F.col("found").cast("double"), F.col("pages")))


def overall(rates: DataFrame) -> DataFrame:
    return rates.agg(F.try_divide(F.sum("found").cast("double"), F.sum("pages")).alias("rate"))


_PLAIN = re.compile(r"^[A-Za-z_-][A-Za-z0-9_-]*$")
KINDS = {"attribute": 5, "id": 4, "class": 3, "descendant": 2, "tag": 1}


def selectors_for(page: html.Page, row: int) -> list[tuple[str, int]]:
    """Selectors that an element suggests, with their worth: by attribute, id, class, parent and tag."""
    x = page.rows[row]
    plain = lambda names: [c for c in names if _PLAIN.match(c)]
    classes = plain(x.attributes.get("class", "").split())
    out = [(f'{x.tag}[{k}="{x.attributes[k]}"]', KINDS["attribute"]) for k in ("itemprop", "property", "name") if x.attributes.get(k) and '"' not in x.attributes[k]]
    out += [(f"#{i}", KINDS["id"]) for i in plain([x.attributes.get("id", "")])]
    out += [(s, KINDS["class"]) for c in classes for s in (f".{c}", f"{x.tag}.{c}")]
    if x.parent > 0:
        above = page.rows[x.parent].attributes
        heads = [f".{c}" for c in plain(above.get("class", "").split())]
        out += [(f"{h} {t}", KINDS["descendant"]) for h in heads for t in (x.tag, *(f".{c}" for c in classes[:1]))]
        out += [(f"#{i} {x.tag}", KINDS["descendant"]) for i in plain([above.get("id", "")])]
    return [*out, (x.tag, KINDS["tag"])]


def induce(pages: DataFrame, items: tuple[Item, ...], least: float = 0.6, url: str = "url", markup: str = "html") -> DataFrame:
    """item, property, selector, support, pages: for each property the selector that gives its value (an example, or what extraction finds) on the most pages, if on `least` of all; more telling, deeper, shorter ones first among equals."""
    check(items)

    def candidates(url: str | None, markup: str | None) -> list[dict]:
        page, rows = html.Page(url or "", markup or ""), []
        text = " ".join(page.text().split())
        for item in items:
            for p in item.properties:
                want = next((e for e in p.examples if e in text), None)
                if want is None:
                    got = find(page, p)
                    want = got.raw if got else ""
                if not want:
                    continue
                seen: dict[str, tuple[int, int]] = {}
                for i in page.range(0):
                    if page.value(i) == want:
                        depth, up = 0, i
                        while up > 0:
                            depth, up = depth + 1, page.rows[up].parent
                        for s, worth in selectors_for(page, i):
                            seen[s] = max(seen.get(s, (0, 0)), (worth, depth))
                for s, (worth, depth) in seen.items():
                    row = html.css_first(page, 0, s)
                    if row is not None and page.value(row) == want:
                        rows.append({"item": item.name, "property": p.name, "selector": s, "worth": worth, "depth": depth})
        return rows

    total = pages.count()
    found = by_row(candidates, "array<struct<item:string,property:string,selector:string,worth:int,depth:int>>")
    rows = pages.select(F.explode(found(F.col(url), F.col(markup))).alias("c")).select("c.*")
    counts = rows.groupBy("item", "property", "selector").agg(F.count("*").alias("support"), F.max("worth").alias("worth"), F.max("depth").alias("depth")).where(F.col("support") >= least * total)
    spaces = F.length("selector") - F.length(F.replace("selector", F.lit(" "), F.lit("")))
    best = counts.groupBy("item", "property").agg(F.min_by(F.struct("selector", "support"), F.struct(-F.col("support"), -F.col("worth"), -F.col("depth"), spaces, F.length("selector"), F.col("selector"))).alias("b"))
    return best.select("item", "property", "b.selector", "b.support", F.lit(total).cast("long").alias("pages"))


def learned(items: tuple[Item, ...], found, replace: bool = False, least: int = 1) -> tuple[Item, ...]:
    """The items with learned selectors (rows of item, property, selector, support) written into them, marked as learned. Selectors that someone has written stay, unless they are to be replaced; those that were learned before give way."""
    by = {(r["item"], r["property"]): r["selector"] for r in found if r["support"] >= least}

    def written(item: Item, p: Property) -> Property:
        new = by.get((item.name, p.name))
        keep = new is None or p.css and not (replace or p.learned)
        return p if keep else dataclasses.replace(p, css=(new,), learned=True)

    return tuple(dataclasses.replace(i, properties=tuple(written(i, p) for p in i.properties)) for i in items)
