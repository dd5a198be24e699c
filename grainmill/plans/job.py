"""Job documents: the shapes to extract, the crawl's bounds, the steps of its pipeline; checked whole, compared, fingerprinted."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, fields
from typing import Any

TYPES = ("str", "int", "float", "bool", "date", "url", "object", "list", "entity")
TRANSFORMS = ("text", "trim", "lower", "upper", "normalise_space", "absurl", "datetime")
SELF = ("url", "host", "domain", "path", "fetched_at")
POLICIES = ("priority", "breadth", "depth", "random")
STEPS = ("clean", "validate", "dedupe", "rank", "entities")
DEFAULTS = {"max_depth": 5, "max_body": 32 << 20, "max_redirects": 10, "policy": "priority", "rate": 0.0}


@dataclass(frozen=True)
class Property:
    name: str
    type: str = "str"
    required: bool = False
    tag: bool = False
    entity: str = ""
    aliases: tuple[str, ...] = ()
    css: tuple[str, ...] = ()
    xpath: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()
    transforms: tuple[str, ...] = ()
    examples: tuple[str, ...] = ()
    description: str = ""
    properties: tuple[Property, ...] = ()
    learned: bool = False  # whether css was induced from pages

    def leaves(self, above: str = "") -> list[tuple[str, Property]]:
        name = f"{above}{self.name}"
        return [x for p in self.properties for x in p.leaves(f"{name}.")] if self.properties else [(name, self)]


@dataclass(frozen=True)
class Relation:
    name: str
    kind: str
    source: str = ""  # self.*, or a property
    topics: tuple[str, ...] = ()
    properties: tuple[Property, ...] = ()


@dataclass(frozen=True)
class Item:
    name: str
    of: str = ""
    time: str = ""
    properties: tuple[Property, ...] = ()
    relations: tuple[Relation, ...] = ()

    def names(self) -> list[str]:
        """The columns of the shape: leaf names, sorted; a property with nested ones is none."""
        return sorted(n for p in self.properties for n, _ in p.leaves())

    def tags(self) -> list[str]:
        """What identifies a thing measured: `of`, relations, and tag or entity properties."""
        marked = {n for p in self.properties if p.tag or p.type == "entity" for n, _ in p.leaves()}
        return sorted(({"of"} if self.of else set()) | {r.name for r in self.relations} | marked)

    def fields(self) -> list[str]:
        return sorted(set(self.names()) - set(self.tags()))


@dataclass(frozen=True)
class Step:
    kind: str
    name: str
    after: tuple[str, ...] = ()
    options: tuple[tuple[str, Any], ...] = ()

    @property
    def address(self) -> str:
        return f"{self.kind}.{self.name}"


@dataclass(frozen=True)
class Stage:
    """A middleware of the scheduler, downloader or spider; lower orders come first, equal ones as they are listed."""

    at: str
    name: str
    order: int = 500
    options: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Exporter:
    kind: str
    name: str
    path: str = ""
    items: tuple[str, ...] = ()
    options: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Job:
    name: str
    start: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    included: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    items: tuple[Item, ...] = ()
    steps: tuple[Step, ...] = ()
    max_depth: int = DEFAULTS["max_depth"]
    max_body: int = DEFAULTS["max_body"]
    max_redirects: int = DEFAULTS["max_redirects"]
    policy: str = DEFAULTS["policy"]
    rate: float = DEFAULTS["rate"]
    agent: str = "grainmill"
    robots: bool = True
    truncate: bool = False
    max_pages: int = 0
    max_seconds: float = 0.0
    wave: int = 100_000
    stages: tuple[Stage, ...] = ()
    exporters: tuple[Exporter, ...] = ()


_PARTS = {(Job, "items"): Item, (Job, "steps"): Step, (Job, "stages"): Stage, (Job, "exporters"): Exporter, (Item, "properties"): Property, (Item, "relations"): Relation, (Property, "properties"): Property, (Relation, "properties"): Property}


def build(kind: type, spec: dict, at: str = "") -> Any:
    """A job (or part of one) from plain data; unknown fields are refused."""
    known = {f.name for f in fields(kind)}
    if odd := sorted(set(spec) - known):
        raise ValueError(f"{at or kind.__name__.lower()}: unknown fields {', '.join(odd)}")
    made = {}
    for key, value in spec.items():
        part = _PARTS.get((kind, key))
        if part:
            value = tuple(build(part, x, f"{at}{kind.__name__.lower()} {spec.get('name', '?')}: {key[:-1]}") for x in value)
        elif isinstance(value, dict):
            value = tuple(sorted(value.items()))
        elif isinstance(value, list):
            value = tuple(value)
        made[key] = value
    return kind(**made)


def parse(text: str) -> Job:
    return build(Job, json.loads(text))


def printed(job: Job) -> str:
    """The job as a document that `parse` reads; what has its default is left out."""

    def plain(x: Any) -> Any:
        if hasattr(x, "__dataclass_fields__"):
            return {f.name: {k: plain(v) for k, v in value} if f.name == "options" else plain(value) for f in fields(x) if (value := getattr(x, f.name)) != f.default and value != ()}
        return [plain(y) for y in x] if isinstance(x, (tuple, list)) else x

    return json.dumps(plain(job), indent=2, ensure_ascii=False)


def topics(text: str) -> dict[str, dict[str, tuple[str, ...]]]:
    """A labels document: for each topic its terms, and the URLs that are about it and not. All that is wrong is told at once."""
    wrong, out = [], {}
    for name, spec in json.loads(text).items():
        if "@" not in name:
            wrong.append(f"topic {name!r} has no @")
        if odd := sorted(set(spec) - {"terms", "about", "not"}):
            wrong.append(f"{name}: unknown fields {', '.join(odd)}")
        held = {k: tuple(spec.get(k, ())) for k in ("terms", "about", "not")}
        if both := sorted(set(held["about"]) & set(held["not"])):
            wrong.append(f"{name}: both about and not: {', '.join(both)}")
        out[name] = held
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def validate(job: Job) -> list[str]:
    """All that is wrong with a job, not only the first."""
    wrong: list[str] = []

    def properties(props: tuple[Property, ...], at: str) -> None:
        for name in {p.name for p in props if [q.name for q in props].count(p.name) > 1}:
            wrong.append(f"{at}: two properties are named {name}")
        for p in props:
            here = f"{at}.{p.name}"
            if p.type not in TYPES:
                wrong.append(f"{here}: no type {p.type!r}")
            if p.type == "entity" and not p.entity:
                wrong.append(f"{here}: an entity needs its kind")
            for t in p.transforms:
                if t not in TRANSFORMS:
                    wrong.append(f"{here}: no transform {t!r}")
            for r in p.regex:
                try:
                    re.compile(r)
                except re.error as e:
                    wrong.append(f"{here}: pattern {r!r}: {e}")
            properties(p.properties, here)

    if not job.name:
        wrong.append("a job needs a name")
    if job.policy not in POLICIES:
        wrong.append(f"no policy {job.policy!r}")
    for p in (*job.included, *job.excluded):
        if "[" in p or "]" in p:
            wrong.append(f"scope pattern {p!r} has brackets")
    for url in job.start:
        host = re.sub(r"^[a-z]+://|[:/?#].*$", "", url.lower())
        if job.domains and not any(host == d or host.endswith("." + d) for d in (x.lower().removeprefix("*.") for x in job.domains)):
            wrong.append(f"start {url} is out of scope")
    for item in job.items:
        properties(item.properties, item.name)
        dates = [n for p in item.properties for n, x in p.leaves() if x.type == "date"]
        if item.time and item.time not in dates:
            wrong.append(f"{item.name}: time names {item.time!r}, which is no date")
        for r in item.relations:
            if r.source.startswith("self.") and r.source[5:] not in SELF:
                wrong.append(f"{item.name}: no {r.source}")
            for t in r.topics:
                if "@" not in t:
                    wrong.append(f"{item.name}.{r.name}: topic {t!r} has no @")
    for s in job.steps:
        if s.kind not in STEPS:
            wrong.append(f"step {s.address}: no kind {s.kind!r}")
    try:
        waves(job.steps)
    except ValueError as e:
        wrong.append(str(e))
    return wrong


def waves(steps: tuple[Step, ...]) -> list[list[Step]]:
    """Steps by the length of the longest path before them; within a wave by address."""
    by = {s.address: s for s in steps}
    if len(by) < len(steps):
        raise ValueError("two steps have one address")
    if missing := sorted({a for s in steps for a in s.after} - set(by)):
        raise ValueError(f"steps after others that aren't there: {', '.join(missing)}")
    level: dict[str, int] = {}
    left = set(by)
    while left:
        free = [a for a in left if all(b in level for b in by[a].after)]
        if not free:
            raise ValueError(f"steps wait for each other: {', '.join(sorted(left))}")
        for a in free:
            level[a] = 1 + max((level[b] for b in by[a].after), default=-1)
        left -= set(free)
    return [[by[a] for a in sorted(level) if level[a] == n] for n in range(max(level.values(), default=-1) + 1)]


def width(steps: tuple[Step, ...]) -> int:
    return max((len(w) for w in waves(steps)), default=0)


def _print_property(p: Property) -> str:
    inner = ";".join(_print_property(x) for x in sorted(p.properties, key=lambda x: x.name))
    return "|".join([p.name, p.type, p.entity, str(p.required), str(p.tag), *(",".join(x) for x in (p.aliases, p.regex, p.transforms, p.xpath, p.css)), f"({inner})"])


def fingerprint(job: Job) -> str:
    """What extraction depends on, as 16 bytes of hex; descriptions and examples don't count, nor does the order of items and properties."""
    lines = []
    for item in sorted(job.items, key=lambda i: i.name):
        props = ";".join(_print_property(p) for p in sorted(item.properties, key=lambda p: p.name))
        relations = ";".join(f"{r.name}|{r.kind}|{r.source}|{','.join(r.topics)}" for r in sorted(item.relations, key=lambda r: r.name))
        lines.append(f"{item.name}=object|{item.of}|{item.time}|{props}|{relations}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:32]


@dataclass(frozen=True)
class Change:
    at: str
    effect: str  # scope, schedule, fetch, stages, extract, pipeline, export
    added: tuple = field(default=())
    removed: tuple = field(default=())


_EFFECTS = {"start": "schedule", "domains": "scope", "included": "scope", "excluded": "scope", "max_depth": "scope", "policy": "schedule", "rate": "schedule", "max_body": "fetch", "max_redirects": "fetch", "agent": "fetch", "robots": "fetch", "truncate": "fetch", "max_pages": "schedule", "max_seconds": "schedule", "wave": "schedule", "stages": "stages", "steps": "pipeline", "exporters": "export"}


def diff(old: Job, new: Job) -> list[Change]:
    """What differs between two jobs and which stage it touches."""
    out = []
    for name, effect in _EFFECTS.items():
        a, b = getattr(old, name), getattr(new, name)
        if a != b:
            if isinstance(a, tuple):
                out.append(Change(name, effect, tuple(x for x in b if x not in a), tuple(x for x in a if x not in b)))
            else:
                out.append(Change(name, effect, (b,), (a,)))
    before, after = {i.name: i for i in old.items}, {i.name: i for i in new.items}
    for name in sorted(set(before) | set(after)):
        if before.get(name) != after.get(name):
            out.append(Change(f"items.{name}", "extract", tuple(x for x in [after.get(name)] if x), tuple(x for x in [before.get(name)] if x)))
    return out


def review(old: Job, new: Job) -> list[str]:
    """Why a running job may not become this one: its name and what its frontier was built by stay, and the new job must be valid."""
    wrong = [f"{k}: a running job keeps its own ({getattr(old, k)!r}, not {getattr(new, k)!r})" for k in ("name", "policy") if getattr(old, k) != getattr(new, k)]
    dupes = lambda job: [s.options for s in job.stages if (s.at, s.name) == ("scheduler", "dupefilter")]
    if dupes(old) != dupes(new):
        wrong.append("stages: what makes two URLs one can't change while a frontier holds them")
    return wrong + validate(new)


class Registry:
    """Named factories: registering a name twice is an error, and all missing ones are told at once."""

    def __init__(self, kind: str):
        self.kind, self._made = kind, {}

    def register(self, name: str, factory: Any) -> None:
        if name in self._made:
            raise ValueError(f"{self.kind} {name!r} is there already")
        self._made[name] = factory

    def names(self) -> list[str]:
        return sorted(self._made)

    def build(self, names: list[str]) -> list[Any]:
        if missing := [n for n in names if n not in self._made]:
            raise ValueError(f"no {self.kind} {', '.join(missing)}; there are {', '.join(self.names())}")
        return [self._made[n] for n in names]

    def one(self, name: str) -> Any:
        return self.build([name])[0]
