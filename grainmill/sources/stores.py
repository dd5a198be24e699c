"""Tables that grow below a path: a crawl's waves, a page cache, the event log, the entity graph.

Everything is appended and merged when it is read, so writers never rewrite what others read; `compact` folds what has
gathered. Paths may be of any file system that Spark has (local, HDFS, object stores).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..operators import entities, events
from .tables import shared_top


class Files:
    """A path on any of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark = spark
        self.path = (path or f"{shared_top(spark)}/grainmill-{uuid.uuid4().hex}").rstrip("/")

    def _at(self, below: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        p, fs = self._at(below)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def whole(self, below: str) -> bool:
        """Whether a table was written to its end."""
        p, fs = self._at(f"{below}/_SUCCESS")
        return fs.exists(p)

    def remove(self, below: str) -> None:
        p, fs = self._at(below)
        fs.delete(p, True)

    def numbers(self, kind: str) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in self.names(kind) if n.startswith("wave=") and self.whole(f"{kind}/{n}"))


class WaveTable(Files):
    """A crawl's frontier and answers: each wave's rows in folders of their own, which count once the wave is committed."""

    FOUND = ("job", "hash", "url", "host", "depth", "score", "discovered", "parent")
    _FOUND = "job string, hash string, url string, host string, depth int, score double, discovered timestamp, parent string"
    _CHANGED = "job string, hash string, attempts int, status string, ready_at timestamp"
    _HOSTS = "host string, next_at timestamp, delay double"

    def write(self, kind: str, wave: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/wave={wave}")

    def commit(self, wave: int) -> None:
        """A mark that is there or not: what the wave has written counts from now on."""
        p, fs = self._at(f"waves/wave={wave}/_SUCCESS")
        fs.create(p, True).close()

    def last(self) -> int:
        return max(self.numbers("waves"), default=0)

    def _rows(self, kind: str, schema: str | None, after: int = 0) -> DataFrame:
        known = [w for w in self.numbers(kind) if after < w <= self.last()]
        if not known:
            return self.spark.createDataFrame([], f"{schema}, wave int")
        reader = self.spark.read.option("basePath", f"{self.path}/{kind}")
        if kind == "answers":
            return reader.option("mergeSchema", True).parquet(*[f"{self.path}/{kind}/wave={w}" for w in known])
        return reader.schema(f"{schema}, wave int").parquet(*[f"{self.path}/{kind}/wave={w}" for w in known])

    def urls(self) -> DataFrame:
        """The frontier: every URL with its latest state."""
        base = max((w for w in self.numbers("base") if w <= self.last()), default=0)
        found = self._rows("found", self._FOUND, base).drop("wave")
        changed = self._rows("changed", self._CHANGED, base).groupBy("job", "hash").agg(F.max_by(F.struct("status", "ready_at", "attempts"), "wave").alias("now"))
        fresh = found.withColumn("status", F.lit("waiting")).withColumn("ready_at", F.lit(None).cast("timestamp")).withColumn("attempts", F.lit(0))
        rows = fresh if not base else self.spark.read.parquet(f"{self.path}/base/wave={base}").unionByName(fresh)
        rows = rows.join(changed, ["job", "hash"], "left")
        return rows.select(*self.FOUND, *[F.when(F.col("now").isNull(), F.col(c)).otherwise(F.col(f"now.{c}")).alias(c) for c in ("status", "ready_at", "attempts")])

    def hosts(self) -> DataFrame:
        return self._rows("hosts", self._HOSTS).groupBy("host").agg(F.max("next_at").alias("next_at"), F.max_by("delay", "wave").alias("delay"))

    def answers(self, schema: str) -> DataFrame:
        return self._rows("answers", schema)

    def compact(self, wave: int) -> None:
        """The frontier as of this wave in one table; older ones aren't read any more."""
        self.write("base", wave, self.urls())


class CacheStore(Files):
    """A page cache: key, url, body, status, stored, in folders by the key's first byte; an entry put again replaces the older one."""

    _SCHEMA = "key string, url string, body string, status int, stored timestamp, gone boolean, prefix string"

    def put(self, pages: DataFrame) -> None:
        """pages: url, body, status, stored."""
        key = urls.cache_key(F.col("url"))
        rows = pages.select(key.alias("key"), "url", "body", F.col("status").cast("int").alias("status"), "stored", F.lit(False).alias("gone"), F.substring(key, 1, 2).alias("prefix"))
        rows.write.mode("append").partitionBy("prefix").parquet(self.path)

    def entries(self) -> DataFrame:
        if not self.names():
            return self.spark.createDataFrame([], self._SCHEMA).drop("gone")
        rows = self.spark.read.schema(self._SCHEMA).parquet(self.path)
        newest = rows.groupBy("prefix", "key").agg(F.max_by(F.struct("url", "body", "status", "stored", "gone"), F.struct("stored", "gone")).alias("x"))
        return newest.where("not x.gone").select("key", "x.url", "x.body", "x.status", "x.stored", "prefix")

    def get(self, keys: list[str]) -> DataFrame:
        return self.entries().where(F.col("key").isin(*keys) & F.col("prefix").isin(*{k[:2] for k in keys}))

    def has(self, key: str) -> bool:
        return not self.get([key]).isEmpty()

    def keys(self) -> DataFrame:
        return self.entries().select("key").orderBy("key")

    def delete(self, keys: list[str], at) -> None:
        """at: when (a timestamp column); entries stored later stand. Keys that aren't there are fine."""
        gone = self.spark.createDataFrame([(k,) for k in keys], "key string").select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("int").alias("status"), at.alias("stored"), F.lit(True).alias("gone"), F.substring("key", 1, 2).alias("prefix"))
        gone.write.mode("append").partitionBy("prefix").parquet(self.path)


class Facts(Files):
    """Append-only tables in numbered batches. What is struck out is a fact too: it hides matching rows of earlier batches."""

    def _next(self) -> int:
        return max((n for kind in self.names() for n in self.numbers(kind)), default=0) + 1

    def _add(self, kind: str, rows: DataFrame) -> None:
        rows.write.mode("errorifexists").parquet(f"{self.path}/{kind}/wave={self._next()}")

    def _all(self, kind: str, schema: str) -> DataFrame:
        if not (known := self.numbers(kind)):
            return self.spark.createDataFrame([], f"{schema}, wave int")
        return self.spark.read.schema(f"{schema}, wave int").option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/wave={w}" for w in known])

    def _left(self, kind: str, schema: str) -> DataFrame:
        """Facts whose jobs have not been retracted since."""
        gone = self._all("retracted", "job string").groupBy(F.col("job").alias("__job")).agg(F.max("wave").alias("__gone"))
        rows = self._all(kind, schema).join(F.broadcast(gone), F.col("job") == F.col("__job"), "left")  # a row for each retracted job
        return rows.where(F.col("__gone").isNull() | (F.col("wave") > F.col("__gone"))).drop("__job", "__gone")

    def retract(self, job: str) -> None:
        if not job:
            raise ValueError("retracting needs a job")
        self._add("retracted", self.spark.createDataFrame([(job,)], "job string"))


class EventStore(Facts):
    """The event log as a table: facts are appended, read merged by name, tags and time."""

    _SCHEMA = "name string, tags map<string,string>, fields map<string,string>, at timestamp, job string, url string, spec string, seq long"

    def put(self, rows: DataFrame) -> None:
        self._add("facts", rows.select(*[x.split()[0] for x in self._SCHEMA.split(", ")]))

    def events(self) -> DataFrame:
        rows = events.with_id(self._left("facts", self._SCHEMA))
        gone = self._all("deleted", "id string").groupBy("id").agg(F.max("wave").alias("__gone"))
        rows = rows.join(gone, "id", "left").where(F.col("__gone").isNull() | (F.col("wave") > F.col("__gone")))
        # a later batch arrived later, whatever its own numbers say
        return events.upsert(rows.withColumn("seq", F.struct("wave", "seq")).drop("id", "wave", "__gone")).withColumn("seq", F.col("seq.seq"))

    def get(self, event_id: str) -> DataFrame:
        return self.events().where(F.col("id") == event_id)

    def query(self, **asked) -> DataFrame:
        return events.query(self.events(), **asked)

    def delete(self, ids: list[str]) -> None:
        """Ids that aren't there are fine."""
        self._add("deleted", self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def series(self) -> DataFrame:
        return events.series(self.events())


class EntityStore(Facts):
    """The entity graph as tables: assertions, properties and aliases are appended; entities, edges and merges are views."""

    _SAID = "kind string, name string, obj_kind string, obj_name string, edge string, topic string, position int, job string, url string, spec string, at timestamp, seq long"
    _PROPERTY = "subject string, name string, value string, position int, job string, url string, spec string, at timestamp, seq long"
    _ALIAS = "alias string, canonical string, rule string, job string, url string, spec string, at timestamp"

    def _columns(self, schema: str) -> list[str]:
        return [x.split()[0] for x in schema.split(", ")]

    def assert_(self, rows: DataFrame) -> None:
        """Entities and relations; who says so (job and url) must be there."""
        said = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), F.raise_error(F.lit(f"an assertion without {c}")).cast("string")).otherwise(F.col(c)).alias(c)
        names = self._columns(self._SAID)
        self._add("assertions", rows.select(*[said(c) if c in ("job", "url") else F.coalesce(F.col(c), F.current_timestamp()).alias(c) if c == "at" else F.col(c) for c in names]))

    def describe(self, rows: DataFrame) -> None:
        self._add("properties", entities.describe(entities.checked(rows), self.aliases()).select(*self._columns(self._PROPERTY)))

    def tag(self, rows: DataFrame) -> None:
        self._add("properties", entities.describe(entities.tag(rows), self.aliases()).select(*self._columns(self._PROPERTY)))

    def merge(self, merges: DataFrame, manual: bool = False) -> None:
        """Aliases are replaced as a whole: the last batch counts."""
        now = entities.merge(self.nodes(), self.aliases(), merges, manual)
        self._add("aliases", now.select(*self._columns(self._ALIAS)))

    def unmerge(self, ids: DataFrame) -> None:
        self._add("aliases", entities.unmerge(self.aliases(), ids).select(*self._columns(self._ALIAS)))

    def assertions(self) -> DataFrame:
        return self._left("assertions", self._SAID).drop("wave")

    def nodes(self) -> DataFrame:
        return entities.entities(self.assertions())

    def edges(self) -> DataFrame:
        return entities.relations(self.assertions())

    def properties(self) -> DataFrame:
        """Of entities that someone still asserts, and of kinds."""
        rows = self._left("properties", self._PROPERTY).drop("wave")
        return rows.join(self.nodes().select(F.col("id").alias("subject")), "subject", "left_semi").unionByName(rows.where(F.col("subject").startswith("kind:")))

    def aliases(self) -> DataFrame:
        last = max(self.numbers("aliases"), default=0)
        return self._left("aliases", self._ALIAS).where(F.col("wave") == last).drop("wave")

    def find(self, kind: str, name: str | Column) -> DataFrame:
        """The canonical entity that goes by this name, in any spelling."""
        at = T.entity_id(F.lit(kind), name if isinstance(name, Column) else F.lit(name))
        own = entities.resolved(self.nodes(), self.aliases()).where(F.col("id") == at).select(F.col("canonical").alias("id"))
        return entities.canonical(self.nodes(), self.aliases()).join(own, "id", "left_semi")

    def kind(self, kind: str) -> DataFrame:
        return entities.of_kind(self.nodes(), self.aliases(), kind)

    def related(self, ids: DataFrame | None = None) -> DataFrame:
        return entities.related(self.edges(), self.nodes(), self.aliases(), ids)
