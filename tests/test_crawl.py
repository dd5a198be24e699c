"""Crawls of a small mock site from job documents: robots, redirects, cache, retries, endings, resuming, steps and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from grainmill.operators import classify, crawl
from grainmill.operators.scope import Scope
from grainmill.plans import job as J
from grainmill.plans import run as run_
from grainmill.sources import stores

PAGES = [
    ("http://a.example.com/", 200, '<a href="/one">1</a> <a href="/two">2</a> <a href="/private/x">x</a> <a href="http://other.org/">o</a>', None),
    ("http://a.example.com/one", 200, '<article><h1>One</h1></article> <a href="/moved">m</a> <a href="/gone">g</a> <a href="/away">w</a> <a href="/loop">l</a>', None),
    ("http://a.example.com/two", 200, '<article><h1>Two</h1></article> <a href="/one?utm_source=x">1</a> <a href="/missing">?</a> <a href="/three">3</a>', None),
    ("http://a.example.com/moved", 301, "", "/three"),
    ("http://a.example.com/three", 200, "<article><h1>Three</h1></article>", None),
    ("http://a.example.com/gone", 404, "no", None),
    ("http://a.example.com/away", 302, "", "http://other.org/"),
    ("http://a.example.com/loop", 302, "", "/loop"),
    ("http://a.example.com/private/x", 200, "secret", None),
]
JOB = {
    "name": "mock", "start": ["http://a.example.com/"], "domains": ["example.com"], "policy": "breadth",
    "items": [{"name": "article", "properties": [{"name": "title", "required": True, "css": ["article h1"], "tag": True}]}],
    "steps": [{"kind": "clean", "name": "article"}, {"kind": "dedupe", "name": "article", "after": ["clean.article"]}, {"kind": "rank", "name": "article", "after": ["dedupe.article"], "options": {"by": "title"}}],
    "stages": [{"at": "scheduler", "name": "dupefilter", "options": {"strip_query": ["utm_source"]}}],
}


@pytest.fixture(scope="module")
def site(spark):
    pages = spark.createDataFrame(PAGES, "url string, status int, body string, location string")
    robots = spark.createDataFrame([("http://a.example.com", 200, "User-agent: *\nDisallow: /private/\n")], "origin string, status int, body string")
    return crawl.Site(pages, robots)


def why(done):
    return {(r["url"].removeprefix("http://a.example.com"), r["outcome"], r["why"]) for r in done.answers.collect()}


def test_a_job_is_run(spark, site, tmp_path):
    spec = {**JOB, "exporters": [{"kind": "json", "name": "all", "path": str(tmp_path / "json")}, {"kind": "csv", "name": "table", "path": str(tmp_path / "csv"), "items": ["article"]}, {"kind": "parquet", "name": "bad", "path": str(tmp_path / "p"), "options": {"compression": "no"}}]}
    got = run_.run(spark, J.build(J.Job, spec), site)
    assert got.crawl.ending == "finished" and list(got.failed) == ["bad"]
    assert why(got.crawl) == {
        ("/", "fetched", None), ("/one", "fetched", None), ("/two", "fetched", None), ("/three", "fetched", None), ("/moved", "fetched", None), ("/private/x", "dropped", "robots: denied"),
        ("/gone", "dropped", "status 404"), ("/away", "dropped", "out of scope"), ("/loop", "failed", "too many redirects"), ("/missing", "failed", "missing"),
    }
    assert got.statistics().first().asDict() == {"fetched": 5, "cached": 0, "dropped": 3, "failed": 6, "queued": 10, "waiting": 0, "abandoned": 2, "records": 3}
    rows = json.loads("".join(p.read_text() for p in (tmp_path / "json").glob("part-*")))
    assert [r["values"]["title"] for r in rows] == ["One", "Three", "Two"]
    lines = [x for p in (tmp_path / "csv").glob("part-*.csv") for x in p.read_text().splitlines()]
    assert lines[0] == "url,fetched,title" and len({*lines}) == 4


def test_hosts_are_paced(spark, site):
    robots = spark.createDataFrame([("http://a.example.com", 200, "User-agent: *\nCrawl-delay: 50")], "origin string, status int, body string")
    links = lambda rows: rows.withColumn("links", F.when(F.col("depth") == 0, F.array(F.lit("/three"))).otherwise(F.array().cast("array<string>")))
    start = spark.createDataFrame([(PAGES[1][0],), (PAGES[2][0],)], "url string")
    done = crawl.crawl(start, crawl.Site(site.pages, robots), links, crawl.CrawlPlan(scope=Scope(domains=("example.com",)), rate=5.0))
    assert done.ending == "finished" and sorted(r["wave"] for r in done.answers.collect()) == [2, 3, 4]


SMALL = {**JOB, "robots": False, "steps": [], "max_depth": 1}


@pytest.fixture(scope="module")
def small(spark, site):
    """Four pages that are all there but for one."""
    return crawl.Site(site.pages.where("url in ('http://a.example.com/', 'http://a.example.com/one', 'http://a.example.com/two', 'http://a.example.com/private/x')").drop("location"))


def test_endings_and_resuming(spark, small, tmp_path):
    path = str(tmp_path / "crawl")
    got = run_.run(spark, J.build(J.Job, {**SMALL, "max_pages": 1}), small, path)
    assert got.crawl.ending == "budget spent" and got.crawl.answers.where("outcome = 'fetched'").count() == 1
    assert run_.run(spark, J.build(J.Job, {**SMALL, "max_seconds": 1.0}), small, path).crawl.ending == "time up"
    assert run_.run(spark, J.build(J.Job, SMALL), small, path, lambda: True).crawl.ending == "stopped"
    table = stores.WaveTable(spark, path)
    table.compact(table.last())
    end = run_.run(spark, J.build(J.Job, SMALL), small, path)
    assert end.crawl.ending == "finished" and end.crawl.answers.where("outcome = 'fetched'").count() == 4
    assert end.crawl.answers.where("url = 'http://a.example.com/'").count() == 1 and end.records.count() == 2


def test_cache_topics_and_statuses(spark, small, tmp_path):
    path = str(tmp_path / "cache")
    spec = {**SMALL, "stages": [*JOB["stages"], {"at": "downloader", "name": "cache", "options": {"path": path}}, {"at": "spider", "name": "httperror", "options": {"allow": [404]}}, {"at": "spider", "name": "topic", "options": {"terms": ["href", "article"], "least": 0.1}}]}
    held = [("http://a.example.com/one", 200, "<p>cached <a href=/x>article</a>", "2024-01-01")]
    cache = stores.CacheStore(spark, path)
    cache.put(spark.createDataFrame(held, "url string, status int, body string, stored string").withColumn("stored", F.to_timestamp("stored")))
    got = run_.run(spark, J.build(J.Job, spec), small)
    assert {(r["url"][20:], r["outcome"], r["cached"], r["why"]) for r in got.crawl.answers.collect()} == {("/", "fetched", False, None), ("/one", "fetched", True, None), ("/two", "fetched", False, None), ("/private/x", "dropped", False, "not read")}
    assert {r["url"][20:] for r in cache.entries().collect()} == {"/", "/one", "/two", "/private/x"}
    key = cache.keys().first()["key"]
    assert cache.has(key) and cache.get([key]).first()["status"] == 200
    cache.delete([key, "0" * 64], F.lit("2100-01-01").cast("timestamp"))
    assert not cache.has(key) and cache.keys().count() == 3


def test_classifiers_by_name(spark, tmp_path):
    model = classify.train(spark.createDataFrame([(1, "red fox", True), (2, "blue whale", False)], "doc_id long, text string, about boolean"))
    classify.ModelStore(spark, str(tmp_path / "models")).put("m", model)
    score = run_.CLASSIFIERS.one("bayes")(spark, {"store": str(tmp_path / "models"), "model": "m"})
    assert {r["text"]: r["s"] > 0.5 for r in score(spark.createDataFrame([("a fox",), ("a whale",), ("a fox",)], "text string"), F.col("text"), "s").collect()} == {"a fox": True, "a whale": False}
    assert classify.link_threshold(spark.createDataFrame([("http://x/red/fox", 0.2), ("http://x/none", 0.9)], "url string, score double"), classify.by_terms(classify.Terms(("fox",))), 0.1, 0.9).count() == 1


def test_a_live_source(spark, site):
    table = {u: (s, b, to) for u, s, b, to in PAGES}
    asked = spark.createDataFrame([("http://a.example.com/moved",), ("http://a.example.com/away",), ("http://a.example.com/missing",)], "url string")
    source = crawl.by_host(lambda url: table[url], 2)
    got = crawl.answered(asked, source, Scope(domains=("example.com",)), 10, None)
    assert {r["url"][20:] for r in got.collect()} == {"/moved", "/three", "/away"}
    leased = asked.selectExpr("'j' job", "md5(url) hash", "url", "'a.example.com' host", "0 depth", "0.5 score", "1 attempts")
    seen = crawl.visit(leased, crawl.Site(source), crawl.CrawlPlan(scope=Scope(domains=("example.com",))), F.current_timestamp())
    assert {(r["url"][20:], r["outcome"], r["why"], r["final_url"][20:]) for r in seen.collect()} == {("/moved", "fetched", None, "/three"), ("/away", "dropped", "out of scope", "/away"), ("/missing", "failed", "missing", "/missing")}


def test_what_is_missing_is_told_at_once(spark, site):
    with pytest.raises(ValueError, match="no spider stage a, b"):
        run_.plan_of(spark, J.build(J.Job, {**JOB, "stages": [{"at": "spider", "name": n} for n in "ab"]}), site)
    with pytest.raises(ValueError, match="unknown options odd"):
        run_.plan_of(spark, J.build(J.Job, {**JOB, "stages": [{"at": "spider", "name": "httperror", "options": {"odd": 1}}]}), site)
    assert "hidden" not in repr(run_.Secret("hidden-name", lambda n: "hidden")).replace("hidden-name", "")
    with pytest.raises(ValueError, match="no secret"):
        run_.Secret("nope").value()
    old = J.build(J.Job, JOB)
    assert J.review(old, J.build(J.Job, {**JOB, "max_depth": 2})) == [] and len(J.review(old, J.build(J.Job, {**JOB, "stages": [], "policy": "depth"}))) == 2


def test_entities_step_fills_the_store(spark, tmp_path):
    spec = {"name": "mock", "items": [{"name": "article", "properties": [{"name": "title", "type": "entity", "entity": "Work"}], "relations": [{"name": "site", "kind": "host", "source": "self.host", "topics": ["a@b"]}]}], "steps": [{"kind": "entities", "name": "article", "options": {"path": str(tmp_path / "graph")}}]}
    rows = spark.createDataFrame([("article", f"http://a.example.com/{i}", "v", {"title": t}, i) for i, t in enumerate(["One", "Two", "Three"])], "item string, url string, spec string, values map<string,string>, seq long").withColumn("fetched", F.lit("2024-01-01").cast("timestamp"))
    assert run_.pipeline(J.build(J.Job, spec), rows).count() == 3
    graph = stores.EntityStore(spark, str(tmp_path / "graph"))
    assert {r["name"] for r in graph.kind("work").collect()} == {"One", "Two", "Three"}
    assert graph.find("WORK", " one ").first()["name"] == "One" and graph.related().count() == 3
    graph.retract("mock")
    assert graph.nodes().count() == 0


def test_event_store(spark, tmp_path):
    store = stores.EventStore(spark, str(tmp_path / "log"))
    make = lambda *rows: spark.createDataFrame([(n, {"t": t}, {"v": v}, job, "u", "s", 1) for n, t, v, job in rows], "name string, tags map<string,string>, fields map<string,string>, job string, url string, spec string, seq long").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    assert store.events().count() == 0
    store.put(make(("a", "1", "old", "j1"), ("b", "1", "x", "j2")))
    store.put(make(("a", "1", "new", "j1")))
    rows = {r["name"]: r for r in store.events().collect()}
    assert rows["a"]["fields"] == {"v": "new"} and store.get(rows["a"]["id"]).count() == 1
    store.delete([rows["a"]["id"], "none"])
    assert [r["name"] for r in store.query(job="j2").collect()] == ["b"] and store.series().count() == 1
    store.retract("j2")
    store.put(make(("b", "2", "y", "j2")))
    assert [r["tags"] for r in store.events().collect()] == [{"t": "2"}]
