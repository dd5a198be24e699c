"""The crawl in waves: a lease meets pages, responses give items and links, links re-enter the frontier.

Fetching is a join of a wave with a table of pages by canonical URL (any table: a cache, an archive, a mock site), behind
the robots gate, the cache and the redirects. A wave is one batch: what it finds, changes and answers is appended below
the crawl's path and counts once the wave is committed, so a crawl that was cut off goes on from its last whole wave.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.stores import CacheStore, WaveTable
from ..sources.tables import settle
from . import frontier, robots
from .scope import Scope, allows

BODY_CAP = 32 << 20
FINISHED, BUDGET_SPENT, TIME_UP, STOPPED, STALLED = "finished", "budget spent", "time up", "stopped", "stalled"


def cut(text: Column, cap: int) -> Column:
    """The longest beginning of a text of at most `cap` bytes."""
    whole = text.cast("binary")
    first = lambda n: F.try_validate_utf8(F.substring(whole, 1, max(0, n)).cast("string"))
    return F.coalesce(*[first(cap - k) for k in range(4)], F.make_valid_utf8(F.substring(whole, 1, cap).cast("string")))


def fetch(wave: DataFrame, pages: DataFrame, cap: int = BODY_CAP, truncate: bool = False, url: str = "url") -> DataFrame:
    """The wave with status and body of its pages (status null: not there); bodies of more bytes than the cap fail, or are cut."""
    got = pages.select(F.col("url").alias("__u"), "status", "body")
    out = wave.join(got, F.col(url) == F.col("__u"), "left").drop("__u")
    over = F.octet_length("body") > cap
    if truncate:
        return out.withColumn("body", F.when(over, cut(F.col("body"), cap)).otherwise(F.col("body"))).withColumn("failed", F.lit(None).cast("string"))
    return out.withColumn("failed", F.when(over, "body too large")).withColumn("body", F.when(~F.coalesce(over, F.lit(False)), F.col("body")))


def cached(requests: DataFrame, cache: DataFrame, now: Column, ttl: float = 0.0, statuses: tuple[int, ...] = (200,)) -> DataFrame:
    """Adds `hit` and the cached body: an entry counts if body and meta are there, its status is listed and it is no older than ttl seconds (0: any age). cache: key, body, status, stored."""
    rows = cache.select(F.col("key").alias("__k"), F.col("body").alias("cached_body"), F.col("status").alias("__s"), "stored")
    out = requests.join(rows, urls.cache_key(F.col("url")) == F.col("__k"), "left")
    fresh = F.lit(True) if ttl <= 0 else (F.unix_micros(now) - F.unix_micros("stored")) <= int(ttl * 1e6)
    return out.withColumn("hit", F.coalesce(F.col("cached_body").isNotNull() & F.col("__s").isin(*statuses) & fresh, F.lit(False))).drop("__k", "__s", "stored")


def follow(requests: DataFrame, edges: DataFrame, scope: Scope, most: int = 10, guard: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Resolves redirects. requests: url; edges: url, status, location. Adds final_url, hops and outcome: ok, out of scope, too many redirects (a circle is one), missing, or what the guard says of a hop. guard: adds `verdict` (null: go on) to rows of url."""
    hop = edges.select(F.col("url").alias("__u"), F.col("status").alias("__s"), "location")
    names = requests.columns
    open_, done = requests.withColumn("final_url", F.col("url")).withColumn("hops", F.lit(0)).withColumn("__seen", F.array("url")), None
    for _ in range(most + 1):
        rows = open_.withColumn("verdict", F.lit(None).cast("string"))
        if guard:
            said = guard(open_.select(F.col("final_url").alias("url")).distinct()).select(F.col("url").alias("__g"), "verdict")
            rows = open_.join(said, F.col("final_url") == F.col("__g"), "left")
        rows = rows.join(hop, F.col("final_url") == F.col("__u"), "left").withColumn("__to", urls.resolve(F.col("final_url"), F.col("location")))
        moved = F.col("__s").isin(301, 302, 303, 307, 308) & (F.coalesce("location", F.lit("")) != "")
        circle = F.coalesce(F.array_contains("__seen", F.col("__to")), F.lit(False))
        outcome = F.coalesce("verdict", F.when(F.col("__s").isNull(), "missing").when(~moved, "ok").when((F.col("hops") >= most) | circle, "too many redirects").when(~F.coalesce(allows(scope, F.col("__to")), F.lit(False)), "out of scope"))
        rows = settle(rows.select(*names, "final_url", "__to", "hops", "__seen", outcome.alias("outcome")))
        ended = rows.where("outcome is not null").select(*names, "final_url", "hops", "outcome")
        done = ended if done is None else done.unionByName(ended)
        open_ = rows.where("outcome is null").select(*names, F.col("__to").alias("final_url"), (F.col("hops") + 1).alias("hops"), F.concat("__seen", F.array("__to")).alias("__seen"))
        if open_.isEmpty():
            break
    return done


def discovered(pages: DataFrame, links: str = "links", options: urls.UrlOptions = urls.UrlOptions()) -> DataFrame:
    """url, depth, seq and links of pages -> requests for the links: canonical url, host, hash, depth + 1, parent; each link of a page once, those that can't be fetched are left out."""
    rows = pages.select(F.col("url").alias("parent"), "depth", "seq", F.posexplode(links).alias("place", "href"))
    rows = rows.withColumn("url", urls.resolve(F.col("parent"), F.col("href"), options)).where("url is not null")
    rows = rows.groupBy("parent", "url").agg(F.min("depth").alias("depth"), F.min("seq").alias("seq"), F.min("place").alias("place"))
    return rows.select("url", urls.host(F.col("url")).alias("host"), urls.url_hash(F.col("url")).alias("hash"), (F.col("depth") + 1).alias("depth"), "parent", "seq", "place")


#: What a fetcher gives: a row for each page that answered.
PAGE = "url string, status int, body string, location string"


def by_host(fetch_one: Callable[[str], tuple[int, str, str | None] | None], tasks: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A live source of pages from a function of a URL (status, body, location; None or an error: no answer). A host's URLs go to one task, one after the other."""

    def run(batches):
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    answer = fetch_one(url)
                except Exception:  # noqa: BLE001  a fetch that fails is a page that isn't there; it is tried again
                    answer = None
                if answer is not None:
                    rows.append((url, *answer))
            yield pd.DataFrame(rows, columns=["url", "status", "body", "location"])

    def source(requests: DataFrame) -> DataFrame:
        rows = requests.select("url", urls.host(F.col("url")).alias("host"))
        rows = rows.repartition(tasks, "host") if tasks else rows.repartition("host")
        return rows.select("url").mapInPandas(run, PAGE)

    return source


def answered(requests: DataFrame, source: Callable[[DataFrame], DataFrame], scope: Scope, most: int, guard: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The pages that a live source gives for these requests and for what they are redirected to."""
    got, asked = None, requests.select("url").distinct()
    for _ in range(most + 1):
        if guard:
            asked = guard(asked).where("verdict is null").select("url")
        new = settle(source(asked))
        got = new if got is None else got.unionByName(new)
        to = new.where(F.col("status").isin(301, 302, 303, 307, 308)).select(urls.resolve(F.col("url"), F.col("location")).alias("url")).where(F.col("url").isNotNull() & allows(scope, F.col("url")))
        asked = settle(to.distinct().join(got.select("url"), "url", "left_anti"))
        if asked.isEmpty():
            break
    return got


def accepted(status: Column, allow: tuple[int, ...] = (), allow_all: bool = False) -> Column:
    """Whether a response is read: 2xx, the statuses allowed besides, or any."""
    if allow_all:
        return status.isNotNull()
    return F.coalesce(status.between(200, 299) | (status.isin(*allow) if allow else F.lit(False)), F.lit(False))


@dataclass(frozen=True)
class Site:
    """What is fetched from: pages (url, status, body; location where there are redirects) or a live source of them, robots files (origin, status, body), a cache."""

    pages: DataFrame | Callable[[DataFrame], DataFrame]
    robots: DataFrame | None = None
    cache: CacheStore | None = None


@dataclass(frozen=True)
class CrawlPlan:
    """links and reads are chains of DataFrame -> DataFrame: over found requests (url, parent, score, ...) before they are queued, and over fetched pages; what they leave out is dropped."""

    job: str = "job"
    scope: Scope = field(default_factory=Scope)
    options: urls.UrlOptions = field(default_factory=urls.UrlOptions)
    max_depth: int = 5
    max_pages: int = 0  # 0: no limit
    max_seconds: float = 0.0  # 0: no limit
    wave: int = 1000
    policy: str = "priority"
    rate: float = 0.0
    hold: float = 300.0
    agent: str = "grainmill"
    max_redirects: int = 10
    body_cap: int = BODY_CAP
    truncate: bool = False
    allow: tuple[int, ...] = ()
    allow_all: bool = False
    cache_ttl: float = 0.0
    cache_statuses: tuple[int, ...] = (200,)
    score: Callable[[Column], Column] = field(default=lambda url: F.lit(0.5))
    links: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    reads: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    #: Seconds since the epoch; by default a clock that a wave moves on by a second, and that is put forward where all hosts cool.
    clock: Callable[[], float] | None = None
    compact_after: int = 32


@dataclass(frozen=True)
class Crawl:
    """A crawl's end: its responses (outcome: fetched, dropped or failed), its frontier, and why it ended."""

    answers: DataFrame
    frontier: DataFrame
    ending: str


_OUT = ("job", "hash", "url", "host", "depth", "score", "attempts")
_ANSWER = "job string, hash string, url string, host string, depth int, score double, attempts int, final_url string, status int, body string, cached boolean, outcome string, why string"


def visit(leased: DataFrame, site: Site, plan: CrawlPlan, now: Column) -> DataFrame:
    """Fetches a wave: cache, robots, redirects, body, status. Adds final_url, status, body, cached, outcome and why."""
    rows = leased.select(*_OUT)
    guard = None
    if site.robots is not None:
        def guard(asked: DataFrame) -> DataFrame:
            return robots.gate(asked, site.robots, plan.agent).withColumn("verdict", F.when(F.col("robots") != "allowed", F.concat(F.lit("robots: "), F.col("robots"))))
    if site.cache is not None:
        rows = settle(cached(rows, site.cache.entries(), now, plan.cache_ttl, plan.cache_statuses))
    else:
        rows = rows.withColumn("cached_body", F.lit(None).cast("string")).withColumn("hit", F.lit(False))
    asked = rows.where("not hit").drop("cached_body", "hit")
    pages = answered(asked, site.pages, plan.scope, plan.max_redirects, guard) if callable(site.pages) else site.pages
    moves = "location" in pages.columns
    if moves or guard:
        edges = pages if moves else pages.withColumn("location", F.lit(None).cast("string"))
        asked = follow(asked, edges, plan.scope, plan.max_redirects, guard)
    else:
        asked = asked.withColumn("final_url", F.col("url")).withColumn("outcome", F.lit("ok"))
    fetched = fetch(asked, pages, plan.body_cap, plan.truncate, "final_url")
    why = F.when(F.col("outcome") != "ok", F.col("outcome")).when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("status").isNull(), "missing")
    lost = F.col("why").isin("missing", "too many redirects", "body too large")
    fetched = fetched.withColumn("why", why).withColumn("cached", F.lit(False))
    held = rows.where("hit").withColumn("final_url", F.col("url")).withColumn("status", F.lit(200)).withColumn("body", F.col("cached_body")).withColumn("cached", F.lit(True)).withColumn("why", F.lit(None).cast("string"))
    names = [*_OUT, "final_url", F.col("status").cast("int").alias("status"), "body", "cached", "why"]
    out = fetched.select(*names).unionByName(held.select(*names))
    out = out.withColumn("why", F.when(F.col("why").isNull() & ~accepted(F.col("status"), plan.allow, plan.allow_all), F.concat(F.lit("status "), F.col("status"))).otherwise(F.col("why")))
    return out.withColumn("outcome", F.when(lost, "failed").when(F.col("why").isNotNull(), "dropped").otherwise("fetched"))


def crawl(start: DataFrame, site: Site, read_links: Callable[[DataFrame], DataFrame], plan: CrawlPlan, path: str | None = None, stop: Callable[[], bool] = lambda: False) -> Crawl:
    """Crawls from `start` (url) until an ending. read_links adds the column links (and what else is wanted) to rows of url, final_url, body.

    path: where the crawl is kept; one that is there goes on. stop: asked before each wave."""
    spark = start.sparkSession
    table = WaveTable(spark, path)
    if site.robots is not None and "rules" not in site.robots.columns:
        site = replace(site, robots=settle(robots.prepared(site.robots, plan.agent)))
    begun = plan.clock() if plan.clock else 1_700_000_000.0

    def place(rows: DataFrame, at: Column) -> DataFrame:
        rows = rows.withColumn("job", F.lit(plan.job)).withColumn("score", plan.score(F.col("url")).cast("double")).withColumn("discovered", at)
        for link in plan.links:
            rows = link(rows)
        return rows.where((F.col("depth") <= (plan.max_depth or 5)) & allows(plan.scope, F.col("url")))

    if not table.last():
        seeds = start.select(urls.normalise(F.col("url"), plan.options).alias("url")).where("url is not null").distinct()
        seeds = seeds.select("url", urls.host(F.col("url")).alias("host"), urls.url_hash(F.col("url")).alias("hash"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
        table.write("found", 1, place(seeds, F.timestamp_seconds(F.lit(begun))).select(*table.FOUND))
        table.commit(1)
    moment = begun + table.last()
    while True:
        number = table.last() + 1
        moment = plan.clock() if plan.clock else moment + 1
        now = F.timestamp_micros(F.lit(int(moment * 1e6)))
        todo, hosts = table.urls(), table.hosts()
        answers = table.answers(_ANSWER)
        spent = answers.where("outcome = 'fetched'").count() if plan.max_pages else 0
        end = STOPPED if stop() else TIME_UP if plan.max_seconds and moment - begun >= plan.max_seconds else BUDGET_SPENT if plan.max_pages and spent >= plan.max_pages else None
        if end:
            return Crawl(answers, todo, end)
        most = min(plan.wave, plan.max_pages - spent) if plan.max_pages else plan.wave
        leased = settle(frontier.lease(todo, hosts, now, most, plan.policy, plan.rate).withColumn("attempts", F.col("attempts") + 1))
        if leased.isEmpty():
            due = frontier.next_due(todo, hosts, now)
            if due is None:
                return Crawl(answers, todo, FINISHED if todo.where("status = 'waiting'").isEmpty() else STALLED)
            if plan.clock:
                time.sleep(min(60.0, max(0.0, due - plan.clock())))
            else:
                moment = max(moment, due - 1)
            continue
        seen = settle(visit(leased, site, plan, now))
        pages = seen.where("outcome = 'fetched'")
        for step in plan.reads:
            pages = step(pages)
        pages = settle(read_links(pages))
        left = seen.join(pages.select("hash"), "hash", "left_anti")
        left = left.withColumn("why", F.when(F.col("outcome") == "fetched", "not read").otherwise(F.col("why"))).withColumn("outcome", F.when(F.col("outcome") == "fetched", "dropped").otherwise(F.col("outcome")))
        table.write("answers", number, pages.unionByName(left, allowMissingColumns=True))
        found = discovered(pages.select(F.col("final_url").alias("url"), "depth", "links", F.xxhash64("hash").alias("seq")), options=plan.options)
        table.write("found", number, frontier.add(todo, place(found, now), ("job", "hash")).select(*table.FOUND))
        # a failed fetch is free again at once, and given up after its last attempt; all else is done
        held = leased.select("job", "hash", "attempts").withColumn("status", F.lit("waiting")).withColumn("ready_at", frontier.later(now, F.lit(plan.hold)))
        reports = seen.select("job", "hash", F.col("attempts").alias("attempt"), (F.col("outcome") != "failed").alias("ok"))
        table.write("changed", number, frontier.report(held, reports))
        if site.robots is not None:
            table.write("hosts", number, frontier.pace(frontier.cooled(leased, now), robots.delays(site.robots, leased), now))
        elif plan.rate > 0:
            table.write("hosts", number, frontier.cooled(leased, now))
        if site.cache is not None:
            site.cache.put(seen.where("not cached and body is not null").select("url", "body", "status", now.alias("stored")).where(F.col("status").isin(*plan.cache_statuses)))
        table.commit(number)
        if number % plan.compact_after == 0:
            table.compact(number)


def statistics(done: Crawl) -> DataFrame:
    """Counters of a crawl: fetched (and of these from the cache), dropped, failed fetches, urls queued, waiting and abandoned."""
    n = lambda test, name: F.count_if(test).alias(name)
    a = done.answers.agg(n(F.col("outcome") == "fetched", "fetched"), n((F.col("outcome") == "fetched") & F.col("cached"), "cached"), n(F.col("outcome") == "dropped", "dropped"), n(F.col("outcome") == "failed", "failed"))
    return a.crossJoin(done.frontier.agg(F.count("*").alias("queued"), n(F.col("status") == "waiting", "waiting"), n(F.col("status") == "abandoned", "abandoned")))
