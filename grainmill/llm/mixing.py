"""Mixing sources to target weights with hash-threshold histograms; DataFrame operations only.

Each source's words are summed by buckets of a hash of the document id. Going up the buckets, the threshold below which
documents get one more copy lies in one bucket; only that bucket's documents are split again, by the next bits of the
hash, until a single hash value is left. Then each document is kept or repeated by comparing its hash with its source's
threshold: no sort and no document-wide window. Thresholds nest: a larger target takes all that a smaller one took.

Defined results: a null text has size 0; null sources form one source, last in order; rows with equal ids share their
hash and so their fate; a source of size 0 takes nothing. The last undecided hash value is taken if that comes nearer
to the target (a half: not taken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stage

#: Bits of the hash, and of a level of the histogram.
BITS, LEVEL = 60, 12


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text, so that any engine finds the same documents; a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds `rank` from 0 in this order: ranges of rows are ordered apart, and offset by the counts of the ranges before."""
    rows = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftrightunsigned("__mid", 33).cast("int")).withColumn("__at", F.col("__mid").bitwiseAND((1 << 33) - 1))
    counts = sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, total = [], 0
    for part, n in counts:
        before += [F.lit(part), F.lit(total)]
        total += n
    return rows.withColumn("rank", (F.create_map(*before)[F.col("__part")] if before else F.lit(0)) + F.col("__at")).drop("__mid", "__part", "__at")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """source, source_size -> target: `share` of all sizes by weights in source order, none above `repeats` times its size, the excess shared anew."""
    rows = stage(ranked(sizes, F.col("source").asc_nulls_last()).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))))
    cap = F.col("source_size") * repeats
    level, left = None, None
    while True:  # each round closes at least one more source; a round is one aggregate over the sources
        closed = F.lit(False) if level is None else cap <= level * F.col("weight")
        r = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(closed, cap).otherwise(0.0)).alias("taken"), F.sum(F.when(closed, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(F.when(closed, 1).otherwise(0)).alias("n")).first()
        if not r["all"] or not r["open"] or r["n"] == left:
            break
        left, level = r["n"], (share * r["all"] - r["taken"]) / r["open"]
    return rows.select("source", "source_size", F.least(cap, F.lit(float(level or 0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies (0, 1 or 2), taken for every row; carry: further input columns to return as they are."""
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), id_hash(F.col(doc_id)).alias("h")))
    aims = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats))
    aims = aims.withColumn("base", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")).withColumn("need", F.col("target") - F.col("base") * F.col("source_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    # open: sources whose threshold lies in the bucket `prefix` (of `bits` bits) and still lack `need`
    open_ = aims.select("source", F.lit(0).cast("long").alias("prefix"), "need")
    inside, done = rows.select("source", "size", "h"), None
    for bits in range(LEVEL, BITS + 1, LEVEL):
        w = Window.partitionBy("source").orderBy("bucket")
        sums = inside.groupBy("source", F.shiftright("h", BITS - bits).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        level = sums.join(open_.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("upto", F.sum("n").over(w))
        level = level.where(F.col("upto") > F.col("need")).withColumn("k", F.row_number().over(w)).where("k = 1").withColumn("short", F.col("need") - (F.col("upto") - F.col("n")))
        level = stage(level.select("source", "bucket", "short", "n", "low", "high"))
        last = (F.col("low") == F.col("high")) | F.lit(bits == BITS)
        ended = level.where(last).select("source", F.when(F.col("short") * 2 > F.col("n"), F.col("high") + 1).otherwise(F.col("low")).alias("below"))
        done = ended if done is None else done.unionByName(ended)
        on = level.where(~last).select(F.col("source").alias("s"), F.col("bucket").alias("prefix"), F.col("short").alias("need"))
        if on.isEmpty():
            break
        open_ = on.withColumnRenamed("s", "source")
        inside = stage(inside.join(on.drop("need"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", BITS - bits) == F.col("prefix"))).select("source", "size", "h"))
    # a source whose need exceeds all it has (by rounding) has no row in done: all its documents lie below
    plan = stage(aims.join(done.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "base", F.coalesce("below", F.when(F.col("need") > 0, F.lit(1 << BITS)).otherwise(F.lit(0))).alias("below")))
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("__source"), id_hash(F.col(doc_id)).alias("__h"), words_in(F.col(text)).alias("size"), *[F.col(c).alias(f"__c_{c}") for c in carry]) if carry else rows.select("doc_id", F.col("source").alias("__source"), F.col("h").alias("__h"), "size")
    out = out.join(plan, F.col("__source").eqNullSafe(F.col("s")), "left").withColumn("copies", F.col("base") + F.when(F.col("__h") < F.col("below"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"__c_{c}").alias(c) for c in carry if c != "doc_id"])
