"""Sources and sinks: corpora and caches as tables, files in every layout, settled frames."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls

#: Codecs that a Parquet sink takes, and those of them that need a library besides Spark.
CODECS = ("uncompressed", "snappy", "gzip", "zstd", "lz4_raw", "brotli")
RESERVED = ("url", "fetched", "spec")


def shared_top(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). A temporary one where that is unset and all runs on this machine, as in tests; on a cluster it must be set."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not (sc.master or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="grainmill-"))
        top = sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(top)
    return top


def settle(df: DataFrame) -> DataFrame:
    """Computes df once: written to the cluster's shared folder and read back, so lineage is cut and a lost executor costs nothing. The folder goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_top(spark)}/grainmill-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def corpus(metas: DataFrame, bodies: DataFrame, limit: int | None = None) -> DataFrame:
    """Cached pages by URL: metas (key, url) with their bodies (key, body); entries that lack either are left out."""
    out = metas.select("key", "url").join(bodies.select("key", "body"), "key").orderBy("url")
    return out.limit(limit) if limit else out


def bodies_only(bodies: DataFrame, limit: int | None = None) -> DataFrame:
    """Bodies as pages that are named by their keys, without looking at metas."""
    out = bodies.where("body is not null").select(F.col("key").alias("url"), "body")
    return out.orderBy("url").limit(limit) if limit else out


def cache_entries(pages: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """key, prefix (to partition by), url, body of a page cache."""
    key = urls.cache_key(F.col(url))
    return pages.select(key.alias("key"), F.substring(key, 1, 2).alias("prefix"), F.col(url).alias("url"), F.col(body).alias("body"))


@dataclass(frozen=True)
class Layout:
    """The columns of a tabular sink: its own first, then an item's leaf names in order."""

    names: tuple[str, ...]
    own: tuple[str, ...] = ("url", "fetched")

    def __post_init__(self):
        if clash := sorted(set(self.names) & set(RESERVED)):
            raise ValueError(f"properties named as a sink's own columns: {', '.join(clash)}")

    def select(self, records: DataFrame) -> DataFrame:
        own = [T.rfc3339(F.col(c)).alias(c) if c == "fetched" else F.col(c) for c in self.own]
        return records.select(*own, *[F.coalesce(F.col("values").getItem(n), F.lit("")).alias(n) for n in sorted(self.names)])


def write_json_lines(records: DataFrame, path: str) -> None:
    records.write.json(path)


def write_json_array(records: DataFrame, path: str) -> None:
    """One file with one array, for consumers that need it: a single task writes it, rows in seq order if there is one."""
    rows = records.select(F.to_json(F.struct(*[c for c in records.columns if c != "seq"])).alias("value"), *(["seq"] if "seq" in records.columns else []))
    rows = rows.orderBy("seq") if "seq" in records.columns else rows
    # the bracket and the first row open the array, each further row brings its comma: only whether a row is the first matters
    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    numbered = settle(numbered)
    first = numbered.agg(F.min("n").alias("n")).first()["n"]
    lines = numbered.select("n", F.concat(F.when(F.col("n") == first, "[\n  ").otherwise(",\n  "), F.col("value")).alias("value"))
    end = records.sparkSession.range(1).select(F.lit((1 << 63) - 1).alias("n"), F.lit("[\n]" if first is None else "\n]").alias("value"))
    lines.unionByName(end).repartition(1).sortWithinPartitions("n").select("value").write.option("lineSep", "\n").text(path)


def write_csv(records: DataFrame, path: str, layout: Layout) -> None:
    """With a header; line breaks within cells become spaces."""
    flat = layout.select(records)
    flat.select(*[F.regexp_replace(F.col(f"`{c}`"), r"[\r\n]+", " ").alias(c) for c in flat.columns]).write.option("header", True).option("emptyValue", "").csv(path)


def write_parquet(records: DataFrame, path: str, names: tuple[str, ...], compression: str = "snappy", row_group: int = 128 << 20) -> None:
    """row_group: bytes of a row group. brotli needs its codec on the class path."""
    if compression not in CODECS:
        raise ValueError(f"no codec {compression!r}; there are {', '.join(CODECS)}")
    Layout(names, ("url", "fetched", "spec")).select(records).write.option("compression", compression).option("parquet.block.size", row_group).parquet(path)


def messages(measured: DataFrame, subject: str, of: str | None = None) -> DataFrame:
    """Measurements as messages: key (the subject, with the tag `of` as a last token) and value (JSON)."""
    token = T.subject_token(F.coalesce(F.col("tags").getItem(of), F.lit(""))) if of else F.lit("")
    key = F.when(token != "", F.concat(F.lit(subject + "."), token)).otherwise(F.lit(subject))
    return measured.select(key.alias("key"), F.to_json(F.struct("name", "tags", "fields", T.rfc3339(F.col("time")).alias("time"))).alias("value"))


@dataclass(frozen=True)
class Sink:
    """Where the records of these items (all, if none are named) go: write(records, path)."""

    path: str
    write: callable
    items: tuple[str, ...] = field(default=())


def export(records: DataFrame, sinks: dict[str, Sink]) -> dict[str, Exception]:
    """Writes each sink its items' records; one that fails stops no other. Returns the failures by name. Records are computed once; two sinks may not claim one path."""
    paths = [s.path.rstrip("/") for s in sinks.values()]
    if twice := sorted({p for p in paths if paths.count(p) > 1}):
        raise ValueError(f"several sinks write to {', '.join(twice)}")
    failed: dict[str, Exception] = {}
    records = settle(records) if len(sinks) > 1 else records
    for name, sink in sinks.items():
        try:
            sink.write(records.where(F.col("item").isin(*sink.items)) if sink.items else records, sink.path)
        except Exception as e:  # noqa: BLE001
            failed[name] = e
    return failed


def job_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Job documents below a path (JSON, one a file) as name and text; as a stream, new ones as they come."""
    reader = spark.readStream if stream else spark.read
    return reader.option("wholetext", True).text(path).withColumn("name", F.col("_metadata.file_name"))
