"""Records and the steps of a record pipeline.

A record is item, url, spec, fetched, values (map of strings) and seq, which orders records that arrived. A step takes
and gives such a table; it touches the records of its item, or all where its name is no declared item.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from .frontier import first_of

OWN = ("url", "spec", "item", "fetched")


def value(column: str) -> Column:
    """A record's column by name: its own, or one of its values; missing ones are empty."""
    if column == "fetched":
        return T.rfc3339(F.col("fetched"))
    return F.coalesce(F.col(column) if column in OWN else F.col("values").getItem(column), F.lit(""))


def _mine(item: str | None, declared: tuple[str, ...]) -> Column:
    return F.col("item") == item if item in declared else F.lit(True)


def clean(records: DataFrame, item: str | None = None, declared: tuple[str, ...] = (), drop: tuple[str, ...] = (), drop_empty: bool = False) -> DataFrame:
    """Drops the named values, makes white space one space, and drops empty values if asked."""
    kept = F.map_filter("values", lambda k, v: ~k.isin(*drop)) if drop else F.col("values")
    kept = F.transform_values(kept, lambda k, v: T.collapse(v))
    if drop_empty:
        kept = F.map_filter(kept, lambda k, v: F.coalesce(v, F.lit("")) != "")
    return records.withColumn("values", F.when(_mine(item, declared), kept).otherwise(F.col("values")))


def complete(required: tuple[str, ...]) -> Column:
    return functools.reduce(operator.and_, [~T.blank(value(c)) for c in required], F.lit(True))


def validate(records: DataFrame, required: tuple[str, ...], item: str | None = None, declared: tuple[str, ...] = (), fail: bool = False) -> DataFrame:
    """Keeps records that have all required values; with fail, one that has not ends the job."""
    fine = ~_mine(item, declared) | complete(required)
    if fail:
        return records.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("record without a required value: "), F.col("url"))).cast("boolean")))
    return records.where(fine)


def dedupe(records: DataFrame, by: tuple[str, ...] = (), item: str | None = None, declared: tuple[str, ...] = ()) -> DataFrame:
    """The first record of each key: the values of `by`, else the URL. Other items' records pass."""
    mine = _mine(item, declared)
    key = F.array(*[value(c) for c in by]) if by else F.array(value("url"))
    return first_of(records.withColumn("__key", F.when(mine, key).otherwise(F.array(F.col("seq").cast("string"), F.lit("other")))).withColumn("__mine", mine), ["__mine", "__key"], F.col("seq")).drop("__key", "__mine")


def collapse_identity(records: DataFrame) -> DataFrame:
    """The first record of each item and URL."""
    return first_of(records, ["item", "url"], F.col("seq"))


def require_unique(records: DataFrame) -> DataFrame:
    """Ends the job if two records share item and URL."""
    twice = records.groupBy("item", "url").count().where("count > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError(f"two records are {twice.first()['item']} at {twice.first()['url']}")
    return records


def rank(records: DataFrame, by: str = "url", descending: bool = False, limit: int | None = None, item: str | None = None, declared: tuple[str, ...] = ()) -> DataFrame:
    """Orders records by a value: numbers first by size, then text bytewise, ties as they came; seq is the new order. limit keeps the first so many; other items' records follow."""
    v, mine = value(by), _mine(item, declared)
    keys = [T.number(v).desc_nulls_first(), v.desc()] if descending else [T.number(v).asc_nulls_last(), v.asc()]
    own = records.where(mine).orderBy(*keys, "seq")
    own = own.limit(limit) if limit else own
    rest = records.where(~F.coalesce(mine, F.lit(False)))
    place = F.struct(*[F.lit(0)], F.when(T.number(v).isNull(), 1).otherwise(0))
    out = own.withColumn("__at", place).unionByName(rest.withColumn("__at", F.struct(F.lit(1), F.lit(0))))
    return out.orderBy("__at.col1", *keys, "seq").drop("__at")


def merge_wave(before: DataFrame, outputs: list[DataFrame]) -> DataFrame:
    """What a wave of steps leaves: a record that every step kept, as the first step that changed it has it, and what any step added (the first one's version)."""
    same = lambda a, b: a.eqNullSafe(b)
    shape = lambda p: F.struct("spec", "fetched", F.array_sort(F.map_entries("values")).alias("sorted"), "values", "seq").alias(p)
    merged = before.select("item", "url", shape("old"))
    for i, out in enumerate(outputs):
        merged = merged.join(out.select("item", "url", shape(f"v{i}")), ["item", "url"], "full")
    olds = [F.col(f"v{i}") for i in range(len(outputs))]
    kept = functools.reduce(operator.and_, [v.isNotNull() for v in olds])
    changed = [F.when(~same(v["sorted"], F.col("old.sorted")) | ~same(v["spec"], F.col("old.spec")), v) for v in olds]
    new = F.when(F.col("old").isNull(), F.coalesce(*olds)).otherwise(F.when(kept, F.coalesce(*changed, F.col("old"))))
    return merged.withColumn("new", new).where("new is not null").select("item", "url", "new.spec", "new.fetched", "new.values", F.coalesce("old.seq", "new.seq").alias("seq"))


def measurements(records: DataFrame, name: Column, tags: tuple[str, ...], fields: tuple[str, ...], time: str | None = None) -> DataFrame:
    """Records as measurements: the shape's tags and fields that have a value, at the time that `time` names or when fetched."""
    pick = lambda names: F.map_filter("values", lambda k, v: k.isin(*names) & (F.coalesce(v, F.lit("")) != ""))
    at = F.coalesce(F.try_to_timestamp(F.col("values").getItem(time), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.col("fetched")) if time else F.col("fetched")
    return records.select(name.alias("name"), pick(tags).alias("tags"), pick(fields).alias("fields"), at.alias("time"), "url", "spec", "seq")


def self_source(name: str, url: Column, fetched: Column) -> Column:
    """What a relation's `self.*` stands for."""
    sources = {"url": url, "host": urls.host(url), "domain": urls.domain(urls.host(url)), "path": urls.path_of(url), "fetched_at": T.rfc3339(fetched)}
    if name not in sources:
        raise ValueError(f"no self.{name}; there are {', '.join(sources)}")
    return sources[name]


def upsert(table: DataFrame | None, records: DataFrame) -> DataFrame:
    """A keyed table with these records: an equal record again only refreshes fetched and spec."""
    rows = records.withColumn("key", T.record_key(F.col("item"), F.col("url"), F.col("values")))
    rows = rows if table is None else table.unionByName(rows)
    return rows.groupBy("key").agg(*[F.min_by(c, "seq").alias(c) for c in ("item", "url", "values")], F.max_by("fetched", "seq").alias("fetched"), F.max_by("spec", "seq").alias("spec"), F.max("seq").alias("seq"))
