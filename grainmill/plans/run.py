"""Running a job document: its stages, steps and sinks are looked up by name, and all that is missing is told at once.

Stages are wrapped around a crawl's plan in their order; steps are table functions, run in waves once the crawl has
ended; sinks get their items' records. Further ones can be registered beside those here.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import classify, crawl, entities, extract
from ..operators import records as R
from ..operators.scope import Scope
from ..sources import charsets, stores, tables
from .job import Exporter, Item, Job, Registry, Stage, Step, fingerprint, validate, waves

STEPS, EXPORTERS, CLASSIFIERS, BACKENDS = Registry("step"), Registry("exporter"), Registry("classifier"), Registry("backend")
STAGES = {at: Registry(f"{at} stage") for at in ("scheduler", "downloader", "spider")}

Wrapped = tuple[crawl.CrawlPlan, crawl.Site]


class Secret:
    """A value that is looked up where it is used and is never shown."""

    def __init__(self, name: str, resolve: Callable[[str], str | None] = os.environ.get):
        self.name, self._resolve = name, resolve

    def value(self) -> str:
        if (found := self._resolve(self.name)) is None:
            raise ValueError(f"no secret {self.name!r}")
        return found

    def __repr__(self) -> str:
        return f"Secret({self.name!r})"


def options(of: Stage | Step | Exporter, known: tuple[str, ...], where: str) -> dict[str, Any]:
    """Options as a dict; unknown ones are refused, and {"secret": name} is looked up."""
    given = dict(of.options)
    if odd := sorted(set(given) - set(known)):
        raise ValueError(f"{where}: unknown options {', '.join(odd)}")
    return {k: Secret(v["secret"]).value() if isinstance(v, dict) and set(v) == {"secret"} else v for k, v in given.items()}


# classifiers: (spark, options) -> Scorer


def _terms(spark: SparkSession, o: dict) -> classify.Scorer:
    return classify.by_terms(classify.Terms(tuple(o["terms"]), tuple(dict(o.get("weights") or {}).items())))


def _bayes(spark: SparkSession, o: dict) -> classify.Scorer:
    return classify.by_bayes(classify.ModelStore(spark, o["store"]).get(o["model"]))


for _name, _factory in (("terms", _terms), ("bayes", _bayes)):
    CLASSIFIERS.register(_name, _factory)
for _name, _factory in (("cache", stores.CacheStore), ("events", stores.EventStore), ("entities", stores.EntityStore)):
    BACKENDS.register(_name, _factory)
_TOPIC = ("classifier", "terms", "weights", "store", "model", "least", "weight")

# stages: (spark, stage) -> a function of plan and site


def _dupefilter(spark: SparkSession, s: Stage) -> Callable[[crawl.CrawlPlan, crawl.Site], Wrapped]:
    o = options(s, ("strip_query", "sort_query", "strip_slash", "lower_path"), "dupefilter")
    made = urls.UrlOptions(**{k: tuple(v) if isinstance(v, (list, tuple)) else v for k, v in o.items()})
    return lambda plan, site: (replace(plan, options=made), site)


def _topic_links(spark: SparkSession, s: Stage) -> Callable[[crawl.CrawlPlan, crawl.Site], Wrapped]:
    o = options(s, _TOPIC, "topic")
    score = CLASSIFIERS.one(o.get("classifier", "terms"))(spark, o)
    step = lambda rows: classify.link_threshold(rows, score, o.get("least", 0.0), o.get("weight", 1.0))
    return lambda plan, site: (replace(plan, links=(*plan.links, step)), site)


def _topic_pages(spark: SparkSession, s: Stage) -> Callable[[crawl.CrawlPlan, crawl.Site], Wrapped]:
    o = options(s, _TOPIC, "topic")
    score = CLASSIFIERS.one(o.get("classifier", "terms"))(spark, o)
    step = lambda rows: classify.page_threshold(rows, score, o.get("least", 0.0))
    return lambda plan, site: (replace(plan, reads=(*plan.reads, step)), site)


def _cache(spark: SparkSession, s: Stage) -> Callable[[crawl.CrawlPlan, crawl.Site], Wrapped]:
    o = options(s, ("path", "ttl", "statuses"), "cache")
    store = BACKENDS.one("cache")(spark, o.get("path"))
    return lambda plan, site: (replace(plan, cache_ttl=o.get("ttl", 0.0), cache_statuses=tuple(o.get("statuses", (200,)))), replace(site, cache=store))


def _httperror(spark: SparkSession, s: Stage) -> Callable[[crawl.CrawlPlan, crawl.Site], Wrapped]:
    o = options(s, ("allow", "allow_all"), "httperror")
    return lambda plan, site: (replace(plan, allow=tuple(o.get("allow", ())), allow_all=bool(o.get("allow_all"))), site)


for _at, _name, _factory in (("scheduler", "dupefilter", _dupefilter), ("scheduler", "topic", _topic_links), ("downloader", "cache", _cache), ("spider", "httperror", _httperror), ("spider", "topic", _topic_pages)):
    STAGES[_at].register(_name, _factory)

# steps: (job, item or None, step) -> a function of records


def _clean(job: Job, item: Item | None, s: Step) -> Callable[[DataFrame], DataFrame]:
    o = options(s, ("drop", "drop_empty"), s.address)
    return lambda rows: R.clean(rows, s.name, _names(job), tuple(o.get("drop", ())), bool(o.get("drop_empty")))


def _validate(job: Job, item: Item | None, s: Step) -> Callable[[DataFrame], DataFrame]:
    o = options(s, ("require", "fail"), s.address)
    required = tuple(dict.fromkeys([*(p.name for p in (item.properties if item else ()) if p.required), *o.get("require", ())]))
    return lambda rows: R.validate(rows, required, s.name, _names(job), bool(o.get("fail")))


def _dedupe(job: Job, item: Item | None, s: Step) -> Callable[[DataFrame], DataFrame]:
    o = options(s, ("by",), s.address)
    by = tuple(o.get("by", ())) or (tuple(item.tags()) if item else ())
    return lambda rows: R.dedupe(rows, by, s.name, _names(job))


def _rank(job: Job, item: Item | None, s: Step) -> Callable[[DataFrame], DataFrame]:
    o = options(s, ("by", "descending", "limit"), s.address)
    if o.get("limit", 0) < 0:
        raise ValueError(f"{s.address}: a limit of {o['limit']}")
    by = o.get("by") or (item.time if item else "") or "url"
    # the order is kept in seq, as tables have none of their own
    return lambda rows: R.rank(rows, by, bool(o.get("descending")), o.get("limit") or None, s.name, _names(job)).withColumn("seq", F.monotonically_increasing_id())


def _entities(job: Job, item: Item | None, s: Step) -> Callable[[DataFrame], DataFrame]:
    """Asserts what the item's records say in the entity store at `path`; the records pass."""
    o = options(s, ("path",), s.address)
    if item is None:
        raise ValueError(f"{s.address}: no item of this name")

    def step(rows: DataFrame) -> DataFrame:
        rows = tables.settle(rows)
        props = [(p.name, p.entity) for p in item.properties if p.type == "entity"]
        ends = [(r.name, r.kind, R.self_source(r.source[5:], F.col("url"), F.col("fetched")) if r.source.startswith("self.") else R.value(r.source)) for r in item.relations]
        topics = tuple(dict.fromkeys(t for r in item.relations for t in r.topics))
        mine = rows.where(F.col("item") == item.name).withColumn("job", F.lit(job.name))
        if props or ends:
            BACKENDS.one("entities")(rows.sparkSession, o.get("path")).assert_(entities.from_records(mine, props, ends, topics))
        return rows

    return step


for _name, _factory in (("clean", _clean), ("validate", _validate), ("dedupe", _dedupe), ("rank", _rank), ("entities", _entities)):
    STEPS.register(_name, _factory)


def _names(job: Job) -> tuple[str, ...]:
    return tuple(i.name for i in job.items)


def pipeline(job: Job, records: DataFrame) -> DataFrame:
    """The job's steps over records, wave by wave; the first record of an item and URL counts, and no step may make two of one."""
    made = STEPS.build([s.kind for s in job.steps])
    items = {i.name: i for i in job.items}
    run = {s.address: f(job, items.get(s.name), s) for s, f in zip(job.steps, made, strict=True)}
    records = R.collapse_identity(records)
    for wave in waves(job.steps):
        outputs = [run[s.address](records) for s in wave]
        records = R.require_unique(tables.settle(outputs[0] if len(outputs) == 1 else R.merge_wave(records, outputs)))
    return records


# exporters: (job, exporter) -> write(records, path)


def _tabular(job: Job, e: Exporter) -> tuple[str, ...]:
    return tuple(sorted({n for i in job.items if not e.items or i.name in e.items for n in i.names()}))


def _parquet(job: Job, e: Exporter) -> Callable[[DataFrame, str], None]:
    return functools.partial(tables.write_parquet, names=_tabular(job, e), **options(e, ("compression", "row_group"), e.name))


def _upsert(job: Job, e: Exporter) -> Callable[[DataFrame, str], None]:
    """A keyed table in numbered versions; readers take the last whole one."""

    def write(rows: DataFrame, path: str) -> None:
        at = stores.Files(rows.sparkSession, path)
        done = at.numbers("versions")
        before = rows.sparkSession.read.parquet(f"{path}/versions/wave={done[-1]}") if done else None
        R.upsert(before, rows.select("item", "url", "spec", "fetched", "values", "seq")).write.mode("overwrite").parquet(f"{path}/versions/wave={(done[-1] if done else 0) + 1}")

    return write


def _messages(job: Job, e: Exporter) -> Callable[[DataFrame, str], None]:
    o = options(e, ("subject", "of"), e.name)
    items = {i.name: i for i in job.items}

    def write(rows: DataFrame, path: str) -> None:
        out = None
        for name in e.items or tuple(items):
            i = items[name]
            m = R.measurements(rows.where(F.col("item") == name), F.lit(i.of or name), tuple(i.tags()), tuple(i.fields()), i.time or None)
            m = tables.messages(m, o["subject"], o.get("of"))
            out = m if out is None else out.unionByName(m)
        out.write.mode("overwrite").json(path)

    return write


EXPORTERS.register("json", lambda job, e: tables.write_json_array)
EXPORTERS.register("jsonl", lambda job, e: tables.write_json_lines)
EXPORTERS.register("csv", lambda job, e: functools.partial(tables.write_csv, layout=tables.Layout(_tabular(job, e))))
for _name, _factory in (("parquet", _parquet), ("table", _upsert), ("messages", _messages)):
    EXPORTERS.register(_name, _factory)


@dataclass(frozen=True)
class Result:
    crawl: crawl.Crawl
    records: DataFrame
    failed: dict[str, Exception]

    def statistics(self) -> DataFrame:
        return crawl.statistics(self.crawl).crossJoin(self.records.agg(F.count("*").alias("records")))


def plan_of(spark: SparkSession, job: Job, site: crawl.Site) -> Wrapped:
    """The crawl that a job asks for, its stages wrapped around it in order."""
    if wrong := validate(job):
        raise ValueError("; ".join(wrong))
    if odd := sorted({s.at for s in job.stages} - set(STAGES)):
        raise ValueError(f"no stage {', '.join(odd)}; there are {', '.join(STAGES)}")
    plan = crawl.CrawlPlan(
        job=job.name, scope=Scope(job.domains, job.included, job.excluded), max_depth=job.max_depth, max_pages=job.max_pages, max_seconds=job.max_seconds, wave=job.wave, policy=job.policy,
        rate=job.rate, agent=job.agent, max_redirects=job.max_redirects, body_cap=job.max_body, truncate=job.truncate,
    )
    site = site if job.robots else replace(site, robots=None)
    for at, registry in STAGES.items():
        chain = sorted((s for s in job.stages if s.at == at), key=lambda s: s.order)
        for s, factory in zip(chain, registry.build([s.name for s in chain]), strict=True):
            plan, site = factory(spark, s)(plan, site)
    return plan, site


def run(spark: SparkSession, job: Job, site: crawl.Site, path: str | None = None, stop: Callable[[], bool] = lambda: False) -> Result:
    """Crawls the job's site, reads its items, runs its steps and writes its sinks, once at the end."""
    plan, site = plan_of(spark, job, site)
    EXPORTERS.build([e.kind for e in job.exporters])
    STEPS.build([s.kind for s in job.steps])
    start = spark.createDataFrame([(u,) for u in job.start], "url string")
    read = lambda rows: extract.read_pages(rows, job.items, url="final_url", markup="body").drop("page_text")
    done = crawl.crawl(start, site, read, plan, path, stop)
    if "found" in done.answers.columns:
        pages = done.answers.where("outcome = 'fetched'").withColumn("fetched", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("wave")))
        found = extract.records(pages.select(F.col("final_url").alias("url"), "fetched", F.xxhash64("wave", "hash").alias("seq"), "found"), job.items, fingerprint(job))
    else:
        found = extract.records(extract.read_pages(spark.createDataFrame([], "url string, html string, fetched timestamp, seq long"), job.items), job.items, fingerprint(job))
    records = tables.settle(pipeline(job, found.select("item", "url", "spec", "fetched", "values", "seq")))
    sinks = {e.name: tables.Sink(e.path, EXPORTERS.one(e.kind)(job, e), e.items) for e in job.exporters}
    return Result(done, records, tables.export(records, sinks))


def decoded(pages: DataFrame, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """Pages whose binary bodies become text."""
    return pages.withColumn(body, charsets.decode(F.col(body), F.col(content_type)))

