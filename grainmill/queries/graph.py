"""Queries over the entity graph of customers, suppliers, nations and orders; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entities as G
from .web import read

_NONE = "cast(null as string)"


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers live in nations (one assertion an order, topics by priority), suppliers are named."""
    nation = read(spark, sf_dir, "nation")
    lives = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    edge = lives.select(F.lit("Person").alias("kind"), F.when(F.col("o_orderkey") % 2 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("name"), F.lit("place").alias("obj_kind"), F.col("n_name").alias("obj_name"), F.lit("lives_in").alias("edge"), F.when(F.col("o_orderkey") % 3 == 0, "life@home").otherwise("").alias("topic"), (F.col("o_orderkey") % 5).cast("int").alias("position"), F.col("c_mktsegment").alias("job"), F.concat(F.lit("o:"), F.col("o_orderkey")).alias("url"), F.lit("v1").alias("spec"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))
    sup = read(spark, sf_dir, "supplier").select(F.lit("company").alias("kind"), F.col("s_name").alias("name"), *[F.expr(_NONE).alias(c) for c in ("obj_kind", "obj_name", "edge", "topic")], F.lit(None).cast("int").alias("position"), F.lit("SUPPLY").alias("job"), F.concat(F.lit("s:"), F.col("s_suppkey")).alias("url"), F.lit("v1").alias("spec"), F.lit("2024-01-01").cast("timestamp").alias("at"), (-F.col("s_suppkey") - 1).alias("seq"))
    return edge.unionByName(sup)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth customer is another spelling of the one before."""
    c = read(spark, sf_dir, "customer").where("c_custkey % 10 = 0 and c_custkey > 1")
    name = lambda k: F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    ident = lambda n: T.entity_id(F.lit("person"), n)
    return c.select(ident(F.col("c_name")).alias("alias"), ident(name(F.col("c_custkey") - 1)).alias("canonical"), F.lit("manual").alias("rule"), F.lit("MERGE").alias("job"), F.lit("m:").alias("url"), F.lit("v1").alias("spec"), F.lit("2024-01-01").cast("timestamp").alias("at"))


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments, and topics by balance."""
    c = read(spark, sf_dir, "customer")
    base = c.select(T.entity_id(F.lit("person"), F.col("c_name")).alias("subject"), "c_mktsegment", "c_acctbal", F.col("c_nationkey").alias("position"), F.lit("job").alias("job"), F.lit("u").alias("url"), F.lit("v1").alias("spec"), F.lit("2024-01-01").cast("timestamp").alias("at"), F.col("c_custkey").alias("seq"))
    seg = base.withColumn("name", F.lit("segment")).withColumn("value", F.col("c_mktsegment")).drop("c_mktsegment", "c_acctbal")
    tags = G.tag(base.where("c_acctbal > 5000").withColumn("topic", F.lit("rich@money")).drop("c_mktsegment", "c_acctbal"))
    return seg.unionByName(tags)


def _views(spark, sf_dir):
    facts, known = assertions(spark, sf_dir), aliases(spark, sf_dir)
    nodes = G.entities(facts)
    return facts, nodes, known.join(nodes.select(F.col("id").alias("alias")), "alias", "left_semi").join(nodes.select(F.col("id").alias("canonical")), "canonical", "left_semi")


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def entity_id(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", T.entity_id(F.lit(" Person "), F.concat(F.lit(" "), F.col("c_name"), F.lit("  x"))).alias("id"))


def assert_entities(spark, sf_dir):
    return G.entities(assertions(spark, sf_dir)).select("id", "kind", "name", _day("first"), _day("last"), "assertions")


def assert_relations(spark, sf_dir):
    return G.relations(assertions(spark, sf_dir)).select("id", "kind", "topic", F.col("position").cast("long").alias("position"), _day("first"), _day("last"), "assertions")


def entity_resolved(spark, sf_dir):
    _, nodes, known = _views(spark, sf_dir)
    return G.resolved(nodes, known)


def entity_get(spark, sf_dir):
    _, nodes, known = _views(spark, sf_dir)
    return G.canonical(nodes, known).select("id", "kind", "name", _day("first"), _day("last"), "assertions")


def entities_of_kind(spark, sf_dir):
    _, nodes, known = _views(spark, sf_dir)
    return G.of_kind(nodes, known, "Place").select("id", "name", "assertions")


def entity_kinds(spark, sf_dir):
    _, nodes, known = _views(spark, sf_dir)
    return G.kinds(nodes, known)


def relation_kinds(spark, sf_dir):
    facts, nodes, known = _views(spark, sf_dir)
    return G.relation_kinds(G.relations(facts), nodes, known)


def related_entities(spark, sf_dir):
    facts, nodes, known = _views(spark, sf_dir)
    return G.related(G.relations(facts), nodes, known).select("source", "id", "name", _day("first"), "assertions", F.col("position").cast("long").alias("position"))


def entity_properties(spark, sf_dir):
    _, nodes, known = _views(spark, sf_dir)
    return G.properties_of(properties(spark, sf_dir), known).select("subject", "name", "value", F.col("position").cast("long").alias("position"), "assertions")


def entity_topics(spark, sf_dir):
    return G.topics(properties(spark, sf_dir))


def about_topic(spark, sf_dir):
    _, nodes, known = _views(spark, sf_dir)
    return G.about(properties(spark, sf_dir), nodes, known, "rich@money").select("id", "name", "assertions")


def provenance_of(spark, sf_dir):
    facts, nodes, known = _views(spark, sf_dir)
    ids = nodes.where("name = 'Customer#000000019' or lower(name) = 'customer#000000019'").select("id")
    return G.provenances(facts, nodes, known, ids).select("seq", "job", "url")


def retract_job(spark, sf_dir):
    facts, _, known = _views(spark, sf_dir)
    facts, _, _ = G.retract(facts, properties(spark, sf_dir), known, "BUILDING")
    return G.entities(facts).groupBy("kind").agg(F.count("*").alias("entities"), F.sum("assertions").alias("assertions"))


def entity_aliases(spark, sf_dir):
    _, nodes, known = _views(spark, sf_dir)
    return G.spellings(nodes, known).select("canonical", "id", "kind", "rule")


def merge_candidates(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    people = c.select(F.lit("person").alias("kind"), F.when(k % 3 == 0, F.concat(F.lit("A. Name"), (k / 3).cast("long").cast("string"))).otherwise(F.concat(F.lit("Ann"), (k % 3).cast("string"), F.lit(" Name"), F.floor(k / 2).cast("string"))).alias("name"), k.alias("seq"), F.lit("2024-01-01").cast("timestamp").alias("at"), *[F.expr(_NONE).alias(x) for x in ("obj_kind", "obj_name")])
    none = spark.createDataFrame([], "alias string, canonical string")
    return G.candidates(G.entities(people), none).select("from_name", "to_name", "rule")


QUERIES = {f.__name__: f for f in (
    entity_id, assert_entities, assert_relations, entity_resolved, entity_get, entities_of_kind, entity_kinds, relation_kinds, related_entities,
    entity_properties, entity_topics, about_topic, provenance_of, retract_job, entity_aliases, merge_candidates,
)}

_ID = "substr(sha256({k} || chr(0) || lower({n})), 1, 24)"
_A = f"""a as (
  select 'person' as kind, case when o_orderkey % 2 = 0 then lower(c_name) else c_name end as name, n_name as obj, case when o_orderkey % 3 = 0 then 'life@home' else '' end as topic, (o_orderkey % 5)::int as position,
         c_mktsegment as job, 'o:' || o_orderkey as url, o_orderdate as w, o_orderkey as seq
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  union all select 'company', s_name, null, null, null, 'SUPPLY', 's:' || s_suppkey, timestamp '2024-01-01', -s_suppkey - 1 from supplier),
x as (select kind, name, w, seq, 0 as side, job from a union all select 'place', obj, w, seq, 1, job from a where obj is not null),
e as (select {_ID.format(k='kind', n='name')} as id, arg_min(kind, seq * 2 + side) as kind, arg_min(name, seq * 2 + side) as name, min(w) as first, max(w) as last, count(*) as assertions from x group by 1),
r0 as (select {_ID.format(k="'person'", n='name')} as source, {_ID.format(k="'place'", n='obj')} as target, 'lives_in' as kind, topic, min(position) as position, min(w) as first, max(w) as last, count(*) as assertions from a where obj is not null group by 1, 2, 3, 4),
al0 as (select {_ID.format(k="'person'", n='c_name')} as alias, {_ID.format(k="'person'", n="'Customer#' || lpad((c_custkey - 1)::varchar, 9, '0')")} as canonical from customer where c_custkey % 10 = 0 and c_custkey > 1),
al as (select * from al0 where alias in (select id from e) and canonical in (select id from e)),
rs as (select id, coalesce(canonical, id) as canonical from e left join al on alias = id),
p as (
  select {_ID.format(k="'person'", n='c_name')} as subject, 'segment' as name, c_mktsegment as value, c_nationkey as position from customer
  union all select {_ID.format(k="'person'", n='c_name')}, 'topic', 'rich@money', 0 from customer where c_acctbal > 5000)"""
_D = "strftime({c}, '%Y-%m-%d') as {c}"
_FL = f"{_D.format(c='first')}, {_D.format(c='last')}"

ORACLES = {
    "entity_id": f"select c_custkey, {_ID.format(k=chr(39) + 'person' + chr(39), n='c_name || ' + chr(39) + ' x' + chr(39))} as id from customer",
    "assert_entities": f"with {_A} select id, kind, name, {_FL}, assertions from e",
    "assert_relations": f"with {_A} select substr(sha256(source || chr(0) || target || chr(0) || kind || chr(0) || topic), 1, 24) as id, kind, topic, position::bigint as position, {_FL}, assertions from r0",
    "entity_resolved": f"with {_A} select id, canonical from rs",
    "entity_get": f"with {_A}, g as (select canonical, min(first) as first, max(last) as last, sum(assertions)::bigint as assertions from e join rs using (id) group by 1) select canonical as id, kind, name, strftime(g.first, '%Y-%m-%d') as first, strftime(g.last, '%Y-%m-%d') as last, g.assertions from g join e on e.id = canonical",
    "entities_of_kind": f"with {_A} select id, name, assertions from e where kind = 'place'",
    "entity_kinds": f"with {_A} select kind, count(distinct canonical) as entities from e join rs using (id) group by 1",
    "relation_kinds": f"with {_A} select r0.kind, count(distinct s.canonical || ':' || t.canonical) as pairs, count(*) as edges from r0 join rs s on s.id = source join rs t on t.id = target group by 1",
    "related_entities": f"with {_A}, h as (select s.canonical as source, t.canonical as target, sum(assertions)::bigint as assertions, min(position)::bigint as position from r0 join rs s on s.id = source join rs t on t.id = target group by 1, 2) select h.source, e.id, e.name, {_D.format(c='first')}, h.assertions, position from h join e on e.id = target",
    "entity_properties": f"with {_A} select coalesce(canonical, subject) as subject, name, value, min(position)::bigint as position, count(*) as assertions from p left join al on alias = subject group by 1, 2, 3",
    "entity_topics": f"with {_A} select value as topic, count(*) as assertions from p where name = 'topic' group by 1",
    "about_topic": f"with {_A} select e.id, e.name, count(*) as assertions from p join rs on rs.id = subject join e on e.id = rs.canonical where p.name = 'topic' group by 1, 2",
    "provenance_of": f"with {_A}, fam as (select id from rs where canonical = {_ID.format(k=chr(39) + 'person' + chr(39), n=chr(39) + 'customer#000000019' + chr(39))}) select seq, job, url from a where {_ID.format(k='kind', n='name')} in (select id from fam)",
    "retract_job": f"with {_A} select kind, count(*) as entities, sum(n)::bigint as assertions from (select kind, lower(name) as name, count(*) as n from x where job <> 'BUILDING' group by 1, 2) group by kind",
    "entity_aliases": f"with {_A} select al.canonical, alias as id, kind, 'manual' as rule from al join e on e.id = alias",
    "merge_candidates": """with c as (select distinct case when c_custkey % 3 = 0 then 'A. Name' || (c_custkey // 3) else 'Ann' || (c_custkey % 3) || ' Name' || (c_custkey // 2) end as name, c_custkey % 3 = 0 as initial from customer),
f as (select string_split(name, ' ')[2] as surname, min(name) as to_name from c where not initial group by 1 having count(*) = 1)
select c.name as from_name, to_name, 'initial' as rule from c join f on string_split(c.name, ' ')[2] = surname where initial""",
}
