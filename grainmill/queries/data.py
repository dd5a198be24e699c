"""Queries over documents, labels and events: text, classification, record steps, the event log; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, events
from ..operators import records as R
from ..sources import tables
from .web import read

TOPIC = classify.Terms(("the", "with", "pour", "der", "for the", "of the"), (("with", 2.0), ("of the", 3.0)))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.concat(F.lit("  "), F.col("source"), F.lit(" \t x ")), F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("empty"), F.when(F.col("doc_id") % 3 == 0, "full").otherwise("  "))
    return read(spark, sf_dir, "documents").select(F.lit("doc").alias("item"), F.concat(F.lit("doc:"), (F.col("doc_id") % 700).cast("string")).alias("url"), F.lit("v1").alias("spec"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")).alias("fetched"), values.alias("values"), F.col("doc_id").alias("seq"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("about"))
    return labels.join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    fields = F.map_filter(F.create_map(F.lit("value"), F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")), F.lit("k"), F.get_json_object("props", "$.k")), lambda k, v: v.isNotNull())
    return e.select(F.col("event_type").alias("name"), F.create_map(F.lit("user"), (F.col("user_id") % 5).cast("string")).alias("tags"), fields.alias("fields"), F.date_trunc("day", "ts").alias("at"), F.concat(F.lit("j"), (F.col("user_id") % 3).cast("string")).alias("job"), F.concat(F.lit("e:"), F.col("event_id").cast("string")).alias("url"), F.lit("v1").alias("spec"), F.col("event_id").alias("seq"))


def collapse_space(spark, sf_dir):
    padded = F.concat(F.lit(" \t\n"), F.col("text"), F.lit("  \n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse(padded).cast("binary")).alias("digest"))


def parse_dates(spark, sf_dir):
    at = F.col("o_orderdate")
    shapes = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy", "d MMMM yyyy", "MMM d, yyyy", "yyyyMMdd"]
    text = F.element_at(F.array(*[F.date_format(at, s) for s in shapes]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.parse_date(text).alias("parsed"))


def tokenize(spark, sf_dir):
    tokens = T.tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("tokens"), F.md5(F.array_join(tokens, " ").cast("binary")).alias("digest"))


def term_counts(spark, sf_dir):
    """Each document's terms with their counts, as their number, their sum and a digest of them all."""
    counts = F.col("counts")
    digest = F.md5(F.array_join(F.sort_array(F.transform(counts, lambda x: F.concat(x["term"], F.lit("="), x["n"]))), ",").cast("binary"))
    tokens = F.aggregate(counts, F.lit(0).cast("long"), lambda n, x: n + x["n"])
    return classify.term_lists(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.size(counts).cast("long").alias("terms"), tokens.alias("tokens"), digest.alias("digest"))


def terms_score(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(TOPIC.score(F.col("text"), spark), 6).alias("score"))


def page_topic_filter(spark, sf_dir):
    return classify.page_threshold(read(spark, sf_dir, "documents"), classify.by_terms(TOPIC), 0.5, "text").select("doc_id", "topic_score")


def propose_labels(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return classify.propose_labels(docs, TOPIC).groupBy("label").agg(F.count("*").alias("docs"))


def label_join(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("doc_id % 10 <> 3").select("doc_id", "lang")
    return classify.labelled(read(spark, sf_dir, "labels"), docs, "doc_id").groupBy("quality", "lang").agg(F.count("*").alias("labels"), F.count_if("skipped").alias("skipped"))


def bayes_train(spark, sf_dir):
    return classify.bayes_statistics(_labelled(spark, sf_dir), "text", "about")


def bayes_fit(spark, sf_dir):
    m = classify.train(_labelled(spark, sf_dir))
    return spark.range(1).select(F.round(F.lit(m.prior), 6).alias("prior"), F.round(F.lit(m.midpoint), 6).alias("midpoint"), F.round(F.lit(m.scale), 5).alias("scale"), F.lit(m.examples).cast("long").alias("examples"))


def bayes_score(spark, sf_dir):
    model = classify.train(_labelled(spark, sf_dir))
    return model.score(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.round("score", 5).alias("score"))


def bayes_top_terms(spark, sf_dir):
    model = classify.train(_labelled(spark, sf_dir))
    return model.top(20).select("term", F.round("weight", 6).alias("weight"))


def clean_records(spark, sf_dir):
    rows = R.clean(_records(spark, sf_dir), "doc", ("doc",), drop=("lang",), drop_empty=True)
    return rows.select("seq", F.col("values")["source"].alias("source"), F.array_join(F.array_sort(F.map_keys("values")), ",").alias("names"))


def validate_records(spark, sf_dir):
    return R.validate(_records(spark, sf_dir), ("lang", "empty"), "doc", ("doc",)).select("seq", "url")


def dedupe_records(spark, sf_dir):
    return R.dedupe(_records(spark, sf_dir), ("lang", "n_chars"), "doc", ("doc",)).select("seq", F.col("values")["lang"].alias("lang"))


def collapse_identity(spark, sf_dir):
    return R.collapse_identity(_records(spark, sf_dir)).select("seq", "url")


def rank_topk(spark, sf_dir):
    return R.rank(_records(spark, sf_dir), "n_chars", descending=True, limit=50).select("seq", F.col("values")["n_chars"].alias("n_chars"))


def wave_merge(spark, sf_dir):
    rows = R.collapse_identity(_records(spark, sf_dir))
    cleaned = R.clean(rows.where("seq % 4 <> 1"), drop=("lang",))
    valid = R.validate(rows, ("empty",)).unionByName(rows.where("seq % 50 = 0").withColumn("url", F.concat("url", F.lit("+"))))
    added = rows.where("seq % 50 = 0").withColumn("url", F.concat("url", F.lit("+")))
    out = R.merge_wave(rows, [cleaned.unionByName(added.limit(0)), valid])
    return out.select("url", "seq", F.array_join(F.array_sort(F.map_keys("values")), ",").alias("names"))


def measurements(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("values", F.map_from_entries(F.concat(F.map_entries("tags"), F.map_entries("fields"), F.array(F.struct(F.lit("seen").alias("key"), F.when(F.col("seq") % 2 == 0, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise("soon").alias("value")))))).withColumn("fetched", F.timestamp_seconds(F.lit(1_704_067_200)))
    m = R.measurements(e, F.col("name"), ("user",), ("value", "k"), "seen")
    return m.select("seq", "name", F.col("tags")["user"].alias("user"), F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("fields"), T.rfc3339(F.col("time")).alias("time"))


def measurement_subject(spark, sf_dir):
    m = _events(spark, sf_dir).select("name", F.create_map(F.lit("user"), F.concat(F.lit("u."), F.col("tags")["user"], F.lit(" *"))).alias("tags"), "fields", F.col("at").alias("time"))
    return tables.messages(m, "grain", "user").groupBy("key").agg(F.count("*").alias("messages"))


def event_id(spark, sf_dir):
    return events.with_id(_events(spark, sf_dir)).select("seq", "id")


def event_upsert(spark, sf_dir):
    return events.upsert(_events(spark, sf_dir)).select("id", "name", "job", "url", F.col("fields")["value"].alias("value"), F.col("fields")["k"].alias("k"))


def event_query(spark, sf_dir):
    since, until = F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-10").cast("timestamp")
    return events.query(events.with_id(_events(spark, sf_dir)), "click", None, since, until, {"user": "2"}, 100).select("seq", "id", T.rfc3339(F.col("at")).alias("at"))


def event_series(spark, sf_dir):
    return events.series(events.upsert(_events(spark, sf_dir))).select("name", "count", T.rfc3339(F.col("first")).alias("first"), T.rfc3339(F.col("last")).alias("last"))


def event_retract(spark, sf_dir):
    return events.retract(_events(spark, sf_dir), "j1").groupBy("job").agg(F.count("*").alias("events"))


def event_windows(spark, sf_dir):
    rows = _events(spark, sf_dir).join(read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts"), "seq").withColumn("at", F.col("ts"))
    return events.windows(rows, "6 hours").select("name", T.rfc3339(F.col("start")).alias("start"), "count")


def upsert_records(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("values", F.map_filter("values", lambda k, v: k == "lang")).withColumn("url", F.concat(F.lit("doc:"), (F.col("seq") % 100).cast("string")))
    table = R.upsert(None, rows.where("seq < 500"))
    return R.upsert(table, rows.where("seq >= 400")).select("key", "url", T.rfc3339(F.col("fetched")).alias("fetched"))


def layout_csv(spark, sf_dir):
    return tables.Layout(("lang", "n_chars", "absent")).select(_records(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    collapse_space, parse_dates, tokenize, term_counts, terms_score, page_topic_filter, propose_labels, label_join, bayes_train, bayes_fit, bayes_score, bayes_top_terms,
    clean_records, validate_records, dedupe_records, collapse_identity, rank_topk, wave_merge, measurements, measurement_subject,
    event_id, event_upsert, event_query, event_series, event_retract, event_windows, upsert_records, layout_csv,
)}

_T = "t as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+'), lambda x: length(x) > 1) as k, text from documents)"
_N = "case when {n} > 0 then 1 - exp(-{n}::double) else 0 end"
_ONE = "len(list_filter(k, lambda x: x = '{t}'))"
_TWO = "len(list_filter(range(1, greatest(len(k), 1)), lambda i: k[i] = '{a}' and k[i + 1] = '{b}'))"
_SCORE = "s as (select doc_id, text, (" + " + ".join([f"{w} * {_N.format(n=_ONE.format(t=t))}" for t, w in (("the", 1.0), ("with", 2.0), ("pour", 1.0), ("der", 1.0))] + [f"{w} * {_N.format(n=_TWO.format(a=a, b=b))}" for a, b, w in (("for", "the", 1.0), ("of", "the", 3.0))]) + ") / 9.0 as score from t)"
_L = _T + """,
lab as (select l.doc_id, l.quality = 1 as about, k from labels l join t using (doc_id)),
st as (select term, count(*) filter (where about) as about, count(*) filter (where not about) as against from (select about, unnest(k) as term from lab) group by term),
n as (select count(*) filter (where about) as a, count(*) filter (where not about) as b, count(*) as e from lab),
o as (select term, ln(((about + 1) / ((sum(about) over ()) + (count(*) over ()))::double) / ((against + 1) / ((sum(against) over ()) + (count(*) over ()))::double)) as odds from st),
c as (select doc_id, term, count(*) as n from (select doc_id, unnest(k) as term from t) group by doc_id, term),
ev as (select doc_id, ln((select a::double / b from n)) + sum(odds * (1 - exp(-c.n::double))) / sqrt(count(*)) as ev from c join o using (term) group by doc_id),
mm as (select avg(case when about then coalesce(ev, 0) end) as ma, avg(case when not about then coalesce(ev, 0) end) as mb from lab left join ev using (doc_id)),
f as (select (ma + mb) / 2 as midpoint, case when ma > mb then 4 / (ma - mb) else 1 end as scale from mm)"""
_E = """e as (
  select event_id as seq, event_type as name, (user_id % 5)::varchar as usr, case when event_id % 2 = 0 then value::varchar end as value, json_extract_string(props, '$.k') as k,
         date_trunc('day', ts) as w, 'j' || (user_id % 3) as job, 'e:' || event_id as url from events),
i as (select *, substr(sha256(name || chr(0) || 'user=' || usr || chr(0) || (epoch_us(w) * 1000)::varchar), 1, 24) as id from e)"""
_Z = "'%Y-%m-%dT%H:%M:%SZ'"

ORACLES = {
    "collapse_space": r"select doc_id, md5(trim(regexp_replace(text, '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'))) as digest from documents",
    "parse_dates": f"select o_orderkey, case when o_orderkey % 7 < 2 then strftime(o_orderdate, {_Z}) else strftime(o_orderdate::date, {_Z}) end as parsed from orders",
    "tokenize": f"with {_T} select doc_id, len(k)::bigint as tokens, md5(array_to_string(k, ' ')) as digest from t",
    "term_counts": f"with {_T}, c as (select doc_id, term || '=' || count(*) as x, count(*) as n from (select doc_id, unnest(k) as term from t) group by doc_id, term) select doc_id, count(*) as terms, sum(n)::bigint as tokens, md5(string_agg(x, ',' order by x)) as digest from c group by doc_id",
    "terms_score": f"with {_T}, {_SCORE} select doc_id, round(score, 6) as score from s",
    "page_topic_filter": f"with {_T}, {_SCORE} select doc_id, printf('%.3f', score) as topic_score from s where score >= 0.5",
    "propose_labels": f"with {_T}, {_SCORE} select case when score >= 0.35 then 'about' else 'not' end as label, count(*) as docs from s where doc_id not in (select doc_id from labels) group by 1",
    "label_join": "select quality, lang, count(*) as labels, count(*) filter (where lang is null) as skipped from labels left join (select doc_id, lang from documents where doc_id % 10 <> 3) using (doc_id) group by 1, 2",
    "bayes_train": f"with {_L} select term, about, against from st",
    "bayes_fit": f"with {_L} select round(ln(a::double / b), 6) as prior, round(midpoint, 6) as midpoint, round(scale, 5) as scale, e as examples from n, f",
    "bayes_score": f"with {_L} select doc_id, round(case when trim(text) = '' then 0 else 1 / (1 + exp(-(coalesce(ev, midpoint) - midpoint) * scale)) end, 5) as score from t left join ev using (doc_id), f",
    "bayes_top_terms": f"with {_L} select term, round(odds, 6) as weight from o order by odds desc, term limit 20",
    "clean_records": "select doc_id as seq, source || ' x' as source, case when doc_id % 3 = 0 then 'empty,n_chars,source' else 'n_chars,source' end as names from documents",
    "validate_records": "select doc_id as seq, 'doc:' || (doc_id % 700) as url from documents where doc_id % 3 = 0 and trim(coalesce(lang, '')) <> ''",
    "dedupe_records": "select min(doc_id) as seq, lang from documents group by lang, n_chars",
    "collapse_identity": "select min(doc_id) as seq, 'doc:' || (doc_id % 700) as url from documents group by doc_id % 700",
    "rank_topk": "select doc_id as seq, n_chars::varchar as n_chars from documents order by documents.n_chars desc, doc_id limit 50",
    "wave_merge": """with r as (select min(doc_id) as seq, 'doc:' || (doc_id % 700) as url from documents group by doc_id % 700)
select url, seq, 'empty,n_chars,source' as names from r where seq % 4 <> 1 and seq % 3 = 0
union all select url || '+' as url, seq, 'empty,lang,n_chars,source' as names from r where seq % 50 = 0""",
    "measurements": f"with {_E} select seq, name, usr as user, case when value is null then 'k' else 'k,value' end as fields, case when seq % 2 = 0 then strftime(w, {_Z}) else '2024-01-01T00:00:00Z' end as time from e",
    "measurement_subject": f"with {_E} select 'grain.u_' || usr || '__' as key, count(*) as messages from e group by 1",
    "event_id": f"with {_E} select seq, id from i",
    "event_upsert": f"with {_E} select id, arg_min(name, seq) as name, arg_min(job, seq) as job, arg_min(url, seq) as url, arg_max(value, seq) filter (where value is not null) as value, arg_max(k, seq) filter (where k is not null) as k from i group by id",
    "event_query": f"with {_E} select seq, id, strftime(w, {_Z}) as \"at\" from i where name = 'click' and usr = '2' and w >= timestamp '2024-01-03' and w < timestamp '2024-01-10' order by w desc, id limit 100",
    "event_series": f"with {_E} select name, count(distinct id) as count, strftime(min(w), {_Z}) as first, strftime(max(w), {_Z}) as last from i group by name",
    "event_retract": f"with {_E} select job, count(*) as events from e where job <> 'j1' group by job",
    "event_windows": f"select event_type as name, strftime(time_bucket(interval 6 hours, ts, timestamp '1970-01-01'), {_Z}) as start, count(*) as count from events group by 1, 2",
    "upsert_records": f"""with r as (select doc_id as seq, 'doc:' || (doc_id % 100) as url, lang from documents)
select substr(sha256('doc' || chr(0) || url || chr(0) || 'lang' || chr(0) || lang), 1, 32) as key, url, strftime(timestamp '2024-01-01' + to_seconds(max(seq)), {_Z}) as fetched from r group by url, lang""",
    "layout_csv": f"select 'doc:' || (doc_id % 700) as url, strftime(timestamp '2024-01-01' + to_seconds(doc_id), {_Z}) as fetched, '' as absent, lang, n_chars::varchar as n_chars from documents",
}
