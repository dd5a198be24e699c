"""The event log: tagged measurements at event time. name, tags, fields (maps), at, job, url, spec, seq (arrival)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DEFAULT_LIMIT = 1000


def with_id(events: DataFrame) -> DataFrame:
    return events.withColumn("id", T.event_id(F.col("name"), F.col("tags"), F.col("at")))


def upsert(events: DataFrame) -> DataFrame:
    """One row for each name, tags and time: fields merged, the last to arrive winning each; job, url and spec of the first."""
    rows = with_id(events)
    fields = rows.select("id", "seq", F.explode("fields").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    fields = fields.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields"))
    first = rows.groupBy("id").agg(*[F.min_by(c, "seq").alias(c) for c in ("name", "tags", "at", "job", "url", "spec")], F.min("seq").alias("seq"))
    return first.join(fields, "id", "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))


def query(events: DataFrame, name: str | None = None, job: str | None = None, since: Column | None = None, until: Column | None = None, match: dict[str, str] | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest first: of this name and job, at `since` or later, before `until`, with these tags (a missing one is empty); then the limit."""
    out = events
    for test in (F.col("name") == name if name else None, F.col("job") == job if job else None, F.col("at") >= since if since is not None else None, F.col("at") < until if until is not None else None, *[F.coalesce(F.col("tags").getItem(k), F.lit("")) == v for k, v in (match or {}).items()]):
        out = out if test is None else out.where(test)
    return out.orderBy(F.col("at").desc(), "id").limit(limit)


def series(events: DataFrame) -> DataFrame:
    """name, count, first, last; the most frequent first."""
    return events.groupBy("name").agg(F.count("*").alias("count"), F.min("at").alias("first"), F.max("at").alias("last")).orderBy(F.col("count").desc(), "name")


def retract(events: DataFrame, job: str) -> DataFrame:
    if not job:
        raise ValueError("retracting needs a job")
    return events.where(~F.col("job").eqNullSafe(job))


def delete(events: DataFrame, ids: list[str]) -> DataFrame:
    """Without these events; ids that aren't there are fine."""
    return events.where(~F.col("id").isin(ids)) if ids else events


def windows(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and values by name and event-time window; late: how long windows stay open on a stream."""
    rows = events.withWatermark("at", late) if late else events
    return rows.groupBy("name", F.window("at", width).alias("w")).agg(F.count("*").alias("count")).select("name", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")
