"""The entity graph: append-only assertions with provenance; entities, edges and properties are views over them.

assertions: kind, name (of the subject), obj_kind, obj_name, edge, topic, position (edges only), job, url, spec, at, seq.
properties: subject, name, value, position, job, url, spec, at, seq. aliases: alias, canonical, rule, job, url, spec, at;
chains of aliases are never longer than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T



def with_ids(assertions: DataFrame) -> DataFrame:
    """Adds subject and object ids; object is null for a bare assertion."""
    return assertions.withColumn("subject", T.entity_id(F.col("kind"), F.col("name"))).withColumn("object", F.when(F.col("obj_name").isNotNull(), T.entity_id(F.col("obj_kind"), F.col("obj_name"))))


def entities(assertions: DataFrame) -> DataFrame:
    """id, kind, name (as first spelled), first, last, assertions. Both ends of an edge are asserted by it."""
    subject = assertions.select("kind", "name", "at", "seq", F.lit(0).alias("side"))
    ends = assertions.where("obj_name is not null").select(F.col("obj_kind").alias("kind"), F.col("obj_name").alias("name"), "at", "seq", F.lit(1).alias("side"))
    rows = subject.unionByName(ends).withColumn("id", T.entity_id(F.col("kind"), F.col("name")))
    first = lambda c: F.min_by(c, F.struct("seq", "side"))
    return rows.groupBy("id").agg(first(F.lower(F.trim("kind"))).alias("kind"), first("name").alias("name"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("assertions"))


def relations(assertions: DataFrame) -> DataFrame:
    """id, source, target, kind, topic, position, first, last, assertions."""
    rows = with_ids(assertions).where("object is not null")
    topic = F.coalesce("topic", F.lit(""))
    grouped = rows.groupBy(F.col("subject").alias("source"), F.col("object").alias("target"), F.col("edge").alias("kind"), topic.alias("topic"))
    out = grouped.agg(F.min("position").alias("position"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("assertions"))
    return out.withColumn("id", T.relation_id(F.col("source"), F.col("target"), F.col("kind"), F.col("topic")))


def resolved(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, canonical of every entity."""
    return nodes.select("id").join(aliases.select(F.col("alias").alias("id"), "canonical"), "id", "left").withColumn("canonical", F.coalesce("canonical", "id"))


def canonical(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with their merged spellings rolled up: id, kind, name of the canonical one; first, last, assertions of all."""
    rolled = nodes.join(resolved(nodes, aliases), "id").groupBy("canonical").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("assertions").alias("assertions"))
    return rolled.join(nodes.select(F.col("id").alias("canonical"), "kind", "name"), "canonical").select(F.col("canonical").alias("id"), "kind", "name", "first", "last", "assertions")


def of_kind(nodes: DataFrame, aliases: DataFrame, kind: str) -> DataFrame:
    return canonical(nodes, aliases).where(F.col("kind") == kind.strip().lower()).orderBy(F.col("assertions").desc(), "name")


def kinds(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """kind, entities (canonical ones); most first."""
    rows = nodes.join(resolved(nodes, aliases), "id")
    return rows.groupBy("kind").agg(F.countDistinct("canonical").alias("entities")).orderBy(F.col("entities").desc(), "kind")


def relation_kinds(edges: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """kind, pairs (distinct canonical ends), edges; ordered by edges."""
    rows = _canonical_edges(edges, aliases)
    return rows.groupBy("kind").agg(F.countDistinct("c_source", "c_target").alias("pairs"), F.count("*").alias("edges")).orderBy(F.col("edges").desc(), "kind")


#: Aliases that are told to all tasks; more are met by shuffles.
BROADCAST_ALIASES = 500_000


def _canonical_edges(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with the canonical ids of their ends. Only merged spellings are looked up, so an entity with very many edges costs no more than another."""
    to = aliases.select(F.col("alias").alias("__id"), F.col("canonical").alias("__c"))
    few = aliases.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES
    for end in ("source", "target"):
        edges = edges.join(F.broadcast(to) if few else to, F.col(end) == F.col("__id"), "left").withColumn(f"c_{end}", F.coalesce("__c", end)).drop("__id", "__c")
    return edges


def relations_of(edges: DataFrame, aliases: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges that leave these canonical entities or any spelling of them, ordered by position, kind and topic."""
    return _canonical_edges(edges, aliases).join(ids.select(F.col("id").alias("c_source")).distinct(), "c_source", "left_semi").orderBy("position", "kind", "topic")


def related(edges: DataFrame, nodes: DataFrame, aliases: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One hop through merges: source (canonical), and the entities its edges lead to: id, kind, name, first, last (the canonical row's own), assertions (of the edges), position; ids: column id, the canonical sources asked for (all by default)."""
    rows = _canonical_edges(edges, aliases)
    if ids is not None:
        rows = rows.join(ids.select(F.col("id").alias("c_source")).distinct(), "c_source", "left_semi")
    hop = rows.groupBy("c_source", "c_target").agg(F.sum("assertions").alias("assertions"), F.min("position").alias("position"))
    return hop.join(nodes.select(F.col("id").alias("c_target"), "kind", "name", "first", "last"), "c_target").select(F.col("c_source").alias("source"), F.col("c_target").alias("id"), "kind", "name", "first", "last", "assertions", "position")


def describe(properties: DataFrame, aliases: DataFrame) -> DataFrame:
    """Properties with their subject made canonical as they are written (`checked` refuses the name that is reserved to tags)."""
    known = properties.join(aliases.select(F.col("alias").alias("subject"), "canonical"), "subject", "left")
    return known.withColumn("subject", F.coalesce("canonical", "subject")).drop("canonical")


def checked(properties: DataFrame) -> DataFrame:
    """Properties as anyone may write them: one named topic ends the job."""
    name = F.when(F.lower(F.trim("name")) == "topic", F.raise_error(F.lit("the property name topic is reserved to tags")).cast("string")).otherwise(F.col("name"))
    return properties.withColumn("name", name)


def tag(tags: DataFrame) -> DataFrame:
    """subject, topic, ... as properties named topic; topics without @ end the job."""
    checked = F.when(F.col("topic").contains("@"), F.col("topic")).otherwise(F.raise_error(F.concat(F.lit("not a topic: "), F.col("topic"))).cast("string"))
    return tags.withColumn("name", F.lit("topic")).withColumn("value", checked).withColumn("position", F.lit(0)).drop("topic")


def properties_of(properties: DataFrame, aliases: DataFrame) -> DataFrame:
    """subject (canonical), name, value, position, first, last, assertions."""
    rows = describe(properties, aliases)
    return rows.groupBy("subject", "name", "value").agg(F.min("position").alias("position"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("assertions"))


def topics(properties: DataFrame) -> DataFrame:
    """topic, assertions; most first."""
    return properties.where("name = 'topic'").groupBy(F.col("value").alias("topic")).agg(F.count("*").alias("assertions")).orderBy(F.col("assertions").desc(), "topic")


def about(properties: DataFrame, nodes: DataFrame, aliases: DataFrame, topic: str) -> DataFrame:
    """Entities tagged with a topic: id, kind, name, first, last (the canonical row's), assertions (of the tag)."""
    rows = properties.where((F.col("name") == "topic") & (F.col("value") == topic)).groupBy("subject").agg(F.count("*").alias("n"))
    rows = rows.join(resolved(nodes, aliases).withColumnRenamed("id", "subject"), "subject").groupBy("canonical").agg(F.sum("n").alias("n"))
    return rows.join(nodes.select(F.col("id").alias("canonical"), "kind", "name", "first", "last"), "canonical").select(F.col("canonical").alias("id"), "kind", "name", "first", "last", F.col("n").alias("assertions")).orderBy(F.col("assertions").desc(), "name")


def provenances(assertions: DataFrame, nodes: DataFrame, aliases: DataFrame, ids: DataFrame) -> DataFrame:
    """Who said what of these entities (canonical ids) or any spelling of them: each assertion once, the latest first."""
    family = resolved(nodes, aliases).join(ids.select(F.col("id").alias("canonical")).distinct(), "canonical", "left_semi").select("id")
    rows = with_ids(assertions)
    ends = rows.select("seq", F.explode(F.filter(F.array("subject", "object"), lambda x: x.isNotNull())).alias("id"))
    return rows.join(ends.join(family, "id", "left_semi").select("seq").distinct(), "seq", "left_semi").select("job", "url", "spec", "at", "seq").orderBy(F.col("at").desc(), "seq")


def candidates(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Proposed merges: a name with an initial, and the one full name of its kind with that surname and letter."""
    known = canonical(nodes, aliases).withColumn("n", T.parse_name(F.col("name"))).where("n is not null").select("id", "kind", "name", "n.surname", "n.letter", "n.initial")
    full = known.where("not initial").groupBy("kind", "surname", "letter").agg(F.count("*").alias("fulls"), F.min_by("id", "id").alias("to"), F.min_by("name", "id").alias("to_name")).where("fulls = 1")
    return known.where("initial").join(full, ["kind", "surname", "letter"]).select(F.col("id").alias("from"), "to", "kind", F.col("name").alias("from_name"), "to_name", F.lit("initial").alias("rule"))


def candidates_for(nodes: DataFrame, aliases: DataFrame, ids: DataFrame) -> DataFrame:
    """The proposals that touch these canonical entities: those asked for with an initial find their full name, those with a full name the initials that can only be theirs."""
    asked = ids.select("id").distinct()
    found = candidates(nodes, aliases)
    return found.join(asked.withColumnRenamed("id", "from"), "from", "left_semi").unionByName(found.join(asked.withColumnRenamed("id", "to"), "to", "left_semi").select(*found.columns)).distinct()


def merge(nodes: DataFrame, aliases: DataFrame, merges: DataFrame, manual: bool = False) -> DataFrame:
    """aliases with these merges (loser, keeper, rule, job, url, spec, at) applied at once, one level deep.

    Only entities of one kind merge, losers and keepers by their canonical ids; one that is canonical for both is no
    merge. Merges that are not manual are checked against `candidates` again. Of several keepers the smallest wins; a
    loser that is itself a keeper elsewhere passes its spellings on.
    """
    to = resolved(nodes, aliases).join(nodes.select("id", "kind"), "id")
    rows = merges.join(to.select(F.col("id").alias("loser"), F.col("canonical").alias("l"), F.col("kind").alias("lk")), "loser").join(to.select(F.col("id").alias("keeper"), F.col("canonical").alias("k"), F.col("kind").alias("kk")), "keeper").where("lk = kk and l <> k")
    if not manual:
        rows = rows.join(candidates(nodes, aliases).select(F.col("from").alias("l"), F.col("to").alias("k")), ["l", "k"], "left_semi")
    new = rows.groupBy("l").agg(F.min_by(F.struct("k", "rule", "job", "url", "spec", "at"), "k").alias("m")).select(F.col("l").alias("alias"), F.col("m.k").alias("canonical"), "m.rule", "m.job", "m.url", "m.spec", "m.at")
    new = new.join(new.select(F.col("alias").alias("canonical"), F.col("canonical").alias("further")), "canonical", "left").withColumn("canonical", F.coalesce("further", "canonical")).drop("further").where("alias <> canonical")
    old = aliases.join(new.select(F.col("alias").alias("canonical"), F.col("canonical").alias("now")), "canonical", "left").withColumn("canonical", F.coalesce("now", "canonical")).drop("now")
    return old.unionByName(new.select(*old.columns))


def unmerge(aliases: DataFrame, ids: DataFrame) -> DataFrame:
    return aliases.join(ids.select(F.col("id").alias("alias")), "alias", "left_anti")


def spellings(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """canonical, id, kind, name, rule of every merged spelling."""
    return aliases.join(nodes.select(F.col("id").alias("alias"), "kind", "name"), "alias").select("canonical", F.col("alias").alias("id"), "kind", "name", "rule")


def retract(assertions: DataFrame, properties: DataFrame, aliases: DataFrame, job: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The facts without those of a job; views over them are recounted, entities that nobody asserts any more are gone, and properties of those too."""
    if not job:
        raise ValueError("retracting needs a job")
    facts = assertions.where(F.col("job") != job)
    left = entities(facts).select(F.col("id"))
    props = properties.where(F.col("job") != job)
    props = props.join(left.select(F.col("id").alias("subject")), "subject", "left_semi").unionByName(props.where(F.col("subject").startswith("kind:")))
    return facts, props, aliases.where(F.col("job") != job)


def from_records(records: DataFrame, entity_properties: list[tuple[str, str]], relations_from: list[tuple[str, str, Column]], topics_of: tuple[str, ...] = ()) -> DataFrame:
    """Assertions of records. entity_properties: (property, kind), in order; relations_from: (name, kind, the far end's name).

    Each relation's end and each entity-typed property is asserted; an edge goes from each relation's end to each
    property's entity, named by the property, one for each topic (or one without)."""
    from .records import value

    at = [*[F.col(c) for c in ("job", "url", "spec", "seq")], F.col("fetched").alias("at")]
    props = [(i, p, k, value(p)) for i, (p, k) in enumerate(entity_properties)]
    said = F.struct
    null = F.lit(None).cast("string")
    rows = []
    for _, kind, end in relations_from:
        rows.append(said(F.lit(kind).alias("kind"), end.alias("name"), null.alias("obj_kind"), null.alias("obj_name"), null.alias("edge"), null.alias("topic"), F.lit(None).cast("int").alias("position")))
    for _, _, kind, name in props:
        rows.append(said(F.lit(kind).alias("kind"), name.alias("name"), null.alias("obj_kind"), null.alias("obj_name"), null.alias("edge"), null.alias("topic"), F.lit(None).cast("int").alias("position")))
    for _, kind, end in relations_from:
        for i, p, k, name in props:
            for topic in topics_of or ("",):
                rows.append(said(F.lit(kind).alias("kind"), end.alias("name"), F.lit(k).alias("obj_kind"), name.alias("obj_name"), F.lit(p).alias("edge"), F.lit(topic).alias("topic"), F.lit(i).alias("position")))
    out = records.select(F.explode(F.array(*rows)).alias("a"), *at).select("a.*", "job", "url", "spec", "at", "seq")
    return out.where(~T.blank(F.col("name")) & (F.col("obj_kind").isNull() | ~T.blank(F.col("obj_name"))))
