import gc
import json
import random
import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.functions import batches, html, urls
from grainmill.operators import classify, crawl, entities, extract, frontier, robots
from grainmill.operators import records
from grainmill.operators import records as R
from grainmill.operators.scope import Scope, allows
from grainmill.plans import job as J
from grainmill.plans.job import Item, Property
from grainmill.sources import charsets, tables


def test_urls(spark):
    cases = [
        ("HTTP://Example.COM:80/a/../b#x", "http://example.com/b"), ("https://u:p@example.com:443", "https://example.com/"), ("ftp://example.com/", None), ("/relative", None), ("", None), (None, None),
        ("http://example.com/für x", "http://example.com/f%C3%BCr%20x"), ("http://example.com/?utm_source=a&b=1&&c=2", "http://example.com/?b=1&c=2"), ("http://example.com/a/./b/", "http://example.com/a/b/"), ("http:///x", None),
    ]
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string").select("i", urls.normalise(F.col("u"), urls.UrlOptions(strip_query=urls.TRACKING)).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [w for _, w in cases]


def test_resolution(spark):
    base = "http://example.com/a/b?q=1"
    cases = [("c", "http://example.com/a/c"), ("/d", "http://example.com/d"), ("../e", "http://example.com/e"), ("//other.org/x", "http://other.org/x"), ("?z", "http://example.com/a/b?z"), ("#f", ""), ("mailto:x@y", ""), ("https://x.org/#f", "https://x.org/")]
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string").select("i", urls.absolute(F.lit(base), F.col("h")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [w for _, w in cases]


def test_scope(spark):
    with pytest.raises(ValueError):
        Scope(included=("a[b]",))
    scope = Scope(domains=("*.example.com",), excluded=("*/private/*",))
    rows = spark.createDataFrame([("http://example.com/a",), ("http://a.example.com:8080/b",), ("http://badexample.com/",), ("http://example.com/private/x",)], "u string")
    assert [r[0] for r in rows.select(allows(scope, F.col("u"))).collect()] == [True, True, False, False]


def test_leases_equal_successive_ones(spark):
    """The batch rule against handing out one URL after another at one instant."""
    rng = random.Random(3)
    hosts = {f"h{i}": rng.choice([0.0, 0.0, 5.0]) for i in range(6)}
    rows = [("j", f"{i:03d}", f"u{i}", rng.choice(sorted(hosts)), rng.randrange(3), rng.random(), i, "waiting", None, 0) for i in range(40)]
    urls_ = spark.createDataFrame(rows, "job string, hash string, url string, host string, depth int, score double, discovered long, status string, ready_at timestamp, attempts int")
    table = spark.createDataFrame([(h, None, d) for h, d in hosts.items()], "host string, next_at timestamp, delay double")
    for policy, key in (("priority", lambda r: (-r[5], r[6], r[1])), ("breadth", lambda r: (r[4], r[6], r[1])), ("depth", lambda r: (-r[4], -r[6], [-ord(c) for c in r[1]]))):
        left, cooling, want = sorted(rows, key=key), set(), []
        while len(want) < 15 and (r := next((r for r in left if r[3] not in cooling), None)):
            want.append(r[1])
            left.remove(r)
            if hosts[r[3]] > 0:
                cooling.add(r[3])
        got = [r["hash"] for r in frontier.lease(urls_, table, F.timestamp_seconds(F.lit(100)), 15, policy).collect()]
        assert got == want, policy


def test_robots(spark):
    body = "User-agent: grain\nUser-agent: x\nDisallow: /a\nAllow: /a/b\n\nUser-agent: *\nDisallow: /\n\nuser-agent: grain\nDisallow: /*.pdf$\n"
    files = spark.createDataFrame([("http://s", 200, body), ("http://t", 404, None), ("http://u", 500, None)], "origin string, status int, body string")
    asked = ["http://s/", "http://s/a", "http://s/a/b", "http://s/x.pdf", "http://s/x.pdf?y", "http://t/a", "http://u/a", "http://v/a"]
    got = {r["url"]: r["robots"] for r in robots.gate(spark.createDataFrame([(u,) for u in asked], "url string"), files, "grainmill/2").collect()}
    assert got == dict(zip(asked, ["allowed", "denied", "allowed", "denied", "allowed", "allowed", "unreadable", "unreadable"], strict=True))


PAGE = """<html lang=en><head><title>Head</title><meta property="og:title" content="Meta title"><script type="application/ld+json">{"@graph": [{"author": {"name": "Ann"}, "price": 100.0}]}</script></head>
<body><nav><a href="/x">x</a><a href="#y">y</a></nav><article class="story"><h1>One <b>two</h1><div class="by" itemprop="author"><span class="name">Bo</span></div><p class=lead>First<p>Second <time datetime="2024-02-03">3 Feb</time></article></body></html>"""


def test_locators():
    page = html.Page("http://example.com/", PAGE)
    at = lambda s: page.value(html.css_first(page, 0, s))
    assert at("article h1") == "One two" and at("p.lead") == "First" and at("article > p:nth-child(4)").startswith("Second") and at("time") == "2024-02-03"
    assert html.xpath_first(page, 0, "//html/@lang")[1] == "en"
    assert html.css_first(page, 0, "aside") is None
    with pytest.raises(ValueError):
        html.selector("a[")
    assert page.maps[1]["@graph.price"] == "100"


def test_extraction(spark):
    item = J.Item("article", properties=(J.Property("title", aliases=("og:title",)), J.Property("author", properties=(J.Property("name", css=(".name",), required=True), J.Property("profile", required=True))), J.Property("published", transforms=("datetime",)), J.Property("none", css=("aside",), required=True)))
    page = spark.createDataFrame([("http://example.com/", PAGE, 1), ("http://example.com/2", None, 2)], "url string, html string, seq int").withColumn("fetched", F.timestamp_seconds(F.lit(0)))
    read = extract.read_pages(page, (item,))
    first = extract.records(read, (item,)).where("seq = 1").first()
    assert first["values"]["title"] == "Meta title" and first["values"]["author.name"] == "Bo" and first["values"]["published"] == "2024-02-03T00:00:00Z"
    assert "none" in first["missing"] and "author.profile" in first["missing"]
    assert read.where("seq = 1").first()["links"] == ["http://example.com/x"]


def test_jobs():
    spec = {"name": "j", "start": ["http://example.com/"], "domains": ["example.org"], "items": [{"name": "a", "time": "when", "properties": [{"name": "t", "type": "thing", "regex": ["("]}]}], "steps": [{"kind": "clean", "name": "c"}, {"kind": "rank", "name": "r", "after": ["clean.c"]}]}
    job = J.parse(json.dumps(spec))
    wrong = J.validate(job)
    assert len(wrong) == 4
    assert [[s.name for s in w] for w in J.waves(job.steps)] == [["c"], ["r"]]
    with pytest.raises(ValueError):
        J.parse('{"name": "j", "odd": 1}')
    with pytest.raises(ValueError):
        J.waves((J.Step("clean", "a", ("rank.b",)), J.Step("rank", "b", ("clean.a",))))
    other = J.build(J.Job, spec | {"domains": ["example.com"], "max_depth": 2})
    assert [c.at for c in J.diff(job, other)] == ["domains", "max_depth"] and J.fingerprint(job) == J.fingerprint(other)


def test_rank_puts_numbers_first(spark):
    rows = spark.createDataFrame([("a", f"u{i}", "s", {"v": v}, i) for i, v in enumerate(["9", "10", "1a", "2", "b", ""])], "item string, url string, spec string, values map<string,string>, seq int").withColumn("fetched", F.timestamp_seconds(F.lit(0)))
    assert [r["values"]["v"] for r in R.rank(rows, "v").collect()] == ["2", "9", "10", "", "1a", "b"]
    assert [r["values"]["v"] for r in R.rank(rows, "v", descending=True, limit=2).collect()] == ["b", "1a"]


def test_merges_stay_one_deep(spark):
    facts = spark.createDataFrame([("person", n, i) for i, n in enumerate(["A. Lee", "Ann Lee", "Ann B. Lee x"])], "kind string, name string, seq int").selectExpr("*", "cast(null as string) obj_kind", "cast(null as string) obj_name", "timestamp'2024-01-01' at")
    nodes = entities.entities(facts)
    ids = {r["name"]: r["id"] for r in nodes.collect()}
    none = spark.createDataFrame([], "alias string, canonical string, rule string, job string, url string, spec string, at timestamp")
    merge = lambda known, a, b: entities.merge(nodes, known, spark.createDataFrame([(ids[a], ids[b])], "loser string, keeper string").selectExpr("*", "'manual' rule", "'j' job", "'' url", "'' spec", "timestamp'2024-01-01' at"), manual=True)
    known = merge(merge(none, "A. Lee", "Ann Lee"), "Ann Lee", "Ann B. Lee x")
    assert {r["alias"]: r["canonical"] for r in known.collect()} == {ids["A. Lee"]: ids["Ann B. Lee x"], ids["Ann Lee"]: ids["Ann B. Lee x"]}
    assert [r["from_name"] for r in entities.candidates(nodes, none).collect()] == ["A. Lee"]


def test_models_are_written_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "good fine text", True), (2, "bad poor text", False)], "doc_id int, text string, about boolean")
    store = classify.ModelStore(spark, str(tmp_path))
    model = classify.train(docs)
    assert store.put("topic", model) == 1 and store.put("topic", model) == 2 and store.names() == ["topic"]
    back = {r["doc_id"]: r["score"] for r in store.get("topic@1").score(docs, "doc_id", "text").collect()}
    assert back[1] > 0.5 > back[2]
    with pytest.raises(ValueError):
        classify.train(docs.where("about"))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "u1", "s", {"x": "1\n2"}, 1), ("a", "u2", "s", {"y": "z"}, 2)], "item string, url string, spec string, values map<string,string>, seq int").withColumn("fetched", F.timestamp_seconds(F.lit(0)))
    tables.write_csv(rows, str(tmp_path / "csv"), tables.Layout(("x", "y")))
    assert sorted(r["x"] or "" for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["", "1 2"]
    tables.write_json_array(rows, str(tmp_path / "json"))
    assert len(json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "json")).collect()))) == 2
    tables.write_parquet(rows, str(tmp_path / "pq"), ("x",), "zstd")
    assert spark.read.parquet(str(tmp_path / "pq")).columns == ["url", "fetched", "spec", "x"]
    with pytest.raises(ValueError):
        tables.Layout(("url",))
    failed = tables.export(rows, {"bad": tables.Sink("x", lambda df, path: 1 / 0), "good": tables.Sink("y", lambda df, path: df.count(), ("a",))})
    assert list(failed) == ["bad"]


def test_crawl_without_a_limit(spark):
    start = spark.range(303).selectExpr("concat('http://a.example.com/', id) as url")
    pages = start.selectExpr("url", "200 as status", "url as body")
    links = lambda rows: rows.withColumn("links", F.when(F.col("depth") < 1, F.array(F.concat("url", F.lit("/x")))).otherwise(F.array().cast("array<string>")))
    pages = pages.unionByName(pages.selectExpr("concat(url, '/x') as url", "status", "body"))
    done = crawl.crawl(start, crawl.Site(pages), links, crawl.CrawlPlan(scope=Scope(domains=("example.com",)), wave=400))
    assert done.ending == "finished" and crawl.statistics(done).first().asDict() == {"fetched": 606, "cached": 0, "dropped": 0, "failed": 0, "queued": 606, "waiting": 0, "abandoned": 0}


def test_bodies_are_cut_by_bytes(spark):
    pages = spark.createDataFrame([("u", 200, "aé日本"), ("v", 200, "abc")], "url string, status int, body string")
    for cap, want in ((8, "aé日"), (9, "aé日本"), (2, "a"), (3, "aé"), (0, "")):
        got = crawl.fetch(spark.createDataFrame([("u",)], "url string"), pages, cap, truncate=True).first()["body"]
        assert got == (want if cap != 8 else "aé日") and len(got.encode()) <= cap
    assert crawl.fetch(spark.createDataFrame([("u",)], "url string"), pages, 3).first()["failed"] == "body too large"


@pytest.mark.parametrize(
    ("body", "kind", "want"),
    [
        (b"\x93caf\xe9\x94", "text/html; charset=ISO-8859-1", "“café”"), (b"\x93x\x81", "", "“x\x81"), ("привет".encode("cp1251"), "text/html; charset=windows-1251", "привет"),
        (b'<meta charset="shift_jis">' + "日本".encode("cp932"), "text/html", '<meta charset="shift_jis">日本'), (b"<meta http-equiv=x content='text/html; charset=euc-kr'>" + "한국".encode("euc_kr"), "", "<meta http-equiv=x content='text/html; charset=euc-kr'>한국"),
        ("é日".encode("utf-16-le"), "text/html; charset=utf-16le", "é日"), (b"\xfe\xff" + "é".encode("utf-16-be") + b"\x00", "", "é\ufffd"), (b"\xef\xbb\xbfa\xc3\xa9", "text/html; charset=koi8-r", "aé"),
        (b"ok \xff", "text/html; charset=utf-8", "ok \ufffd"), (b"plain", "text/html; charset=no-such", "plain"), ("汉字".encode("gb18030"), "text/html; charset=gb2312", "汉字"), (b"x", "text/html; charset=rot13", "x"), (None, None, ""), (b"", "text/html", ""),
    ],
)
def test_charsets(spark, body, kind, want):
    row = spark.createDataFrame([(bytearray(body) if body is not None else None, kind)], "body binary, kind string")
    assert row.select(charsets.decode(F.col("body"), F.col("kind")).alias("t")).first()["t"] == want


def test_leases_cool_hosts_and_reports_end_them(spark):
    now = F.timestamp_seconds(F.lit(1000))
    urls_ = spark.createDataFrame([("j", h, f"http://{host}/{h}", host, 0, 0.5, "waiting", 0) for h, host in (("1", "a"), ("2", "a"), ("3", "b"))], "job string, hash string, url string, host string, depth int, score double, status string, attempts int").withColumn("discovered", now).withColumn("ready_at", F.lit(None).cast("timestamp"))
    hosts = spark.createDataFrame([("a", None, 5.0)], "host string, next_at timestamp, delay double")
    leased = frontier.lease(urls_, hosts, now, 10)
    assert {r["hash"] for r in leased.collect()} == {"1", "3"}
    out, cool = frontier.after_lease(urls_, hosts, leased, now, 60.0)
    assert {(r["hash"], r["attempts"], r["ready_at"] is not None) for r in out.collect()} == {("1", 1, True), ("2", 0, False), ("3", 1, True)}
    assert {r["host"]: r["next_at"] is not None for r in cool.collect()} == {"a": True}
    assert frontier.lease(out, cool, now, 10).count() == 0 and frontier.next_due(out, cool, now) == 1005.0
    paced = frontier.pace(cool, spark.createDataFrame([("a", -1.0), ("c", 9.0)], "host string, delay double"), now)
    assert {r["host"]: r["delay"] for r in paced.collect()} == {"a": 0.0, "c": 9.0}
    assert frontier.lease(urls_, hosts.limit(0), now, 2, "random").count() == 2


def test_small_parts(spark, tmp_path):
    rows = spark.createDataFrame([("i", "u", 1), ("i", "u", 2)], "item string, url string, seq long")
    with pytest.raises(ValueError, match="two records"):
        records.require_unique(rows)
    assert records.require_unique(rows.limit(1)).count() == 1
    aliases = spark.createDataFrame([("a", "c"), ("b", "c")], "alias string, canonical string")
    assert entities.unmerge(aliases, spark.createDataFrame([("a",)], "id string")).count() == 1
    edges = spark.createDataFrame([("a", "x", "k", "", 2), ("c", "a", "k", "", 1)], "source string, target string, kind string, topic string, position int")
    assert [(r["c_source"], r["c_target"]) for r in entities.relations_of(edges, aliases, spark.createDataFrame([("c",)], "id string")).collect()] == [("c", "c"), ("c", "x")]
    with pytest.raises(Exception, match="reserved"):
        entities.checked(spark.createDataFrame([("Topic",)], "name string")).collect()
    assert extract.overall(spark.createDataFrame([(1, 4), (3, 4)], "found long, pages long")).first()["rate"] == 0.5
    tables.write_json_lines(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    tables.write_json_array(rows.limit(0), str(tmp_path / "none"))
    assert "".join(p.read_text() for p in (tmp_path / "none").glob("part-*")).split() == ["[", "]"]
    tables.write_json_array(rows, str(tmp_path / "two"))
    assert [r["url"] for r in json.loads("".join(p.read_text() for p in (tmp_path / "two").glob("part-*")))] == ["u", "u"]
    assert tables.job_files(spark, str(tmp_path / "lines")).count() >= 1
    with pytest.raises(ValueError, match="several sinks"):
        tables.export(rows, {"a": tables.Sink("/x/", tables.write_json_lines), "b": tables.Sink("/x", tables.write_json_lines)})


def test_selectors_with_siblings_and_negation():
    page = html.Page("u", "<ul><li class=a>1</li><li>2</li><li class=b>3</li><li>4</li></ul><p></p><p>x</p>")
    at = lambda s: (lambda r: None if r is None else page.text(r))(html.css_first(page, 0, s))
    assert [at(s) for s in ("li + li", ".a ~ .b", ".b + li", "li:not(.a)", "li:not(.a):not(:nth-child(2))", "li:nth-child(2n+2)", "li:nth-child(even)", "p:not(:empty)", "p:last-of-type", "li:first-of-type", "p + p", ".b ~ .a")] == ["2", "3", "4", "2", "3", "2", "2", "x", "x", "1", "x", None]
    for bad in ("li +", "+ li", "li:not(", "li:odd(1)"):
        with pytest.raises(ValueError):
            html.selector(bad)


def test_induction_by_brute_force(spark):
    pages = [(f"http://x/{i}", f'<div id="box"><h2 class="head">{t}</h2><p class="t">{t if i % 3 else "other"}</p><span>{t if i < 2 else ""}</span></div>') for i, t in enumerate(["One", "Two", "Three", "Four", "Five"])]
    item = Item("a", properties=(Property("title", css=("h2",)), Property("none", css=("h5",))))
    got = extract.induce(spark.createDataFrame(pages, "url string, html string"), (item,)).collect()
    # of all selectors that give the title on at least three of five pages, h2's own class and box lead; by worth, depth, spaces, length
    support = {}
    for u, m in pages:
        page = html.Page(u, m)
        want = page.text(html.css_first(page, 0, "h2"))
        for s in {s for r in range(1, len(page.rows)) if page.value(r) == want for s, _ in extract.selectors_for(page, r)}:
            row = html.css_first(page, 0, s)
            support[s] = support.get(s, 0) + (page.value(row) == want)
    most = max(support.values())
    best = sorted((s for s, n in support.items() if n == most), key=lambda s: (-max(w for u, m in pages for p in [html.Page(u, m)] for r in range(1, len(p.rows)) for x, w in extract.selectors_for(p, r) if x == s), s.count(" "), len(s), s))[0]
    assert [(r["property"], r["selector"], r["support"], r["pages"]) for r in got] == [("title", best, most, 5)]
    learned = extract.learned((item,), got)
    assert learned[0].properties[0].css == ("h2",) and extract.learned((item,), got, replace=True)[0].properties[0].css == (best,)


def test_job_documents_come_back():
    job = J.build(J.Job, {"name": "j", "start": ["http://a/"], "items": [{"name": "i", "properties": [{"name": "p", "css": ["a"], "properties": [{"name": "q"}]}]}], "steps": [{"kind": "rank", "name": "i", "options": {"limit": 3}}], "stages": [{"at": "spider", "name": "httperror", "options": {"allow": [404]}}]})
    assert J.parse(J.printed(job)) == job
    assert J.topics('{"a@b": {"terms": ["x"], "about": ["u"]}}') == {"a@b": {"terms": ("x",), "about": ("u",), "not": ()}}
    with pytest.raises(ValueError, match="no @; ab: both about and not: u"):
        J.topics('{"ab": {"about": ["u"], "not": ["u"]}}')


def test_paths():
    page = html.Page("u", "<div id=a><p class='x y'>One <b>two</b></p><p>Three</p><ul><li>1</li><li data-n=7>2</li></ul></div><div><p>Last</p></div>")
    at = lambda s: (lambda r: None if r is None else " ".join((page.text(r[0]) if r[1] is None else r[1]).split()))(html.xpath_first(page, 0, s))
    want = {
        "//p": "One two", "//p[2]": "Three", "//div[2]/p": "Last", "//p/b": "two", "//li/@data-n": "7", "//p[@class]/text()": "One", "//p[contains(@class, 'y')]": "One two", "//li[last()]": "2", "//p[text()='Three']": "Three",
        "//li[@data-n > 6 and not(@id)]": "2", "//b/..": "One two", "//b/ancestor::div/@id": "a", "//p[starts-with(., 'La') or false]": "Last", "//ul/li[position()=2]/preceding-sibling::li": "1", "//p[normalize-space()='Three']": "Three",
        "//div[count(p)=1]//p": "Last", "//h1 | //ul/li[1]": "1", "/div[@id='a']/p[2]": "Three", "//p[string-length(.) = 4]": "Last", "//*[@data-n]": "2", "//nothing": None, "//div[p='Three']/@id": "a",
    }
    assert {s: at(s) for s in want} == want
    for bad in ("//p[", "//p]", "p[foo()]", "//p/odd::x", "", "//p[contains(@a)]"):
        with pytest.raises(ValueError):
            html.path(bad)


def test_a_page_goes_when_it_is_read():
    page = html.Page("u", PAGE)
    assert html.css_first(page, 0, "article > h1 + div .name") is not None
    gone = weakref.ref(page)
    gc.disable()
    try:
        del page
        assert gone() is None
    finally:
        gc.enable()


def test_rows_are_handed_on_before_the_batch_is_read(spark):
    done = []
    f = batches.by_row(lambda a, b: done.append(a) or {"x": a, "m": [(b, a)] if b else None}, "struct<x:string,m:map<string,string>>")
    chunks = f.func(iter([(pa.array(["a"] * 1000), pa.array([None, "k"] * 500))]))
    assert len(next(chunks)) == len(done) == batches.ROWS and sum(map(len, chunks)) == 1000 - batches.ROWS
    large = f.func(iter([(pa.array(["a" * batches.SIZE] * 3), pa.array(["k"] * 3))]))
    assert [len(c) for c in large] == [1, 1, 1] and next(large, None) is None


def test_pages_are_parsed_once(spark):
    item = Item("page", properties=(Property("title", css=("h1",), transforms=("text",)),))
    pages = spark.createDataFrame([(1, "http://example.com/", PAGE, 0), (2, None, None, 0)], "seq long, url string, html string, at int").withColumn("fetched", F.timestamp_seconds("at"))
    read = extract.read_pages(pages, (item,))
    for rows in (extract.records(read, (item,)), extract.fill_rates(read, (item,)), crawl.discovered(read.withColumn("depth", F.lit(0)))):
        assert rows._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1
    assert [(r["property"], r["pages"], r["found"]) for r in extract.fill_rates(read, (item,)).collect()] == [("title", 2, 1)]
    assert extract.fill_rates(read, ()).collect() == []


def test_other_charsets_are_decoded_by_row(spark):
    texts = [None if i % 7 == 0 else f"é{i}ж" if i % 2 else f"é{i}" for i in range(300)]
    rows = [(i, t and t.encode("cp1251" if i % 2 else "cp1252", "replace"), f"text/html; charset=windows-{1251 if i % 2 else 1252}") for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, body binary, kind string").select("i", charsets.decode(F.col("body"), F.col("kind")).alias("text"))
    assert "_other(" not in got._jdf.queryExecution().sparkPlan().toString() and ", 251" in got._jdf.queryExecution().sparkPlan().toString()  # Arrow columns, an iterator
    assert [r["text"] for r in got.orderBy("i").collect()] == [(t or "").replace("é", "?") if i % 2 else t or "" for i, t in enumerate(texts)]


def test_terms_are_counted_where_they_are(spark):
    rows = [(1, "Bb aa AA c cc9 bb aa"), (2, ""), (3, None), (4, "zz"), (1, "aa dd"), (None, "aa"), (None, "aa aa")]
    docs = spark.createDataFrame(rows, "k int, t string")
    want = {(1, "aa", 4), (1, "bb", 2), (1, "cc9", 1), (1, "dd", 1), (4, "zz", 1), (None, "aa", 3)}
    got = [tuple(r) for r in classify.term_counts(docs, "k", "t").collect()]
    assert set(got) == want and len(got) == len(want)
    assert sorted(r["k"] or 0 for r in classify.term_lists(docs, "k", "t").collect()) == [0, 1, 4]
    alone = classify.term_counts(docs.where("k > 1"), "k", "t")
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString() and [tuple(r) for r in alone.collect()] == [(4, "zz", 1)]


def test_large_models_score_as_small_ones(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.randrange(40))), i % 3 == 0) for i in range(90)] + [(90, "xx yy", False), (91, "", True), (92, None, False), (93, "w59", True)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, about boolean")
    model = classify.train(docs)
    small = {r["doc_id"]: r["score"] for r in model.score(docs, "doc_id", "text").collect()}
    for most in (1, 7, 40):
        monkeypatch.setattr(classify, "BROADCAST_TERMS", most)
        scored = model.score(docs, "doc_id", "text")
        assert {r["doc_id"]: r["score"] for r in scored.collect()} == pytest.approx(small, abs=1e-12) and len(small) == len(rows)
        plan = scored._jdf.queryExecution().optimizedPlan().toString()  # tokens of frequent terms are summed up before any shuffle, all in one pass
        assert plan.count("regexp_extract_all") == 1
