"""Threshold-scaled document fingerprints.

A sketch holds every hash of a text's five-word shingles below a fixed fraction of the hash space, or all hashes of a
text that has at most `WHOLE` or none below (then one lies above, which marks it as whole), so the sketch of a union is the union of sketches (`merge`), and what part of a short document lies in a very
long one can be told from the two sketches (`containment`): a sketch grows with its text and is compared at the
scale that both cover; a whole sketch with no hash below the fraction is not comparable with one that is not whole.

Defined results: texts without words have an empty sketch; texts of fewer than five words are one shingle; the
containment of two empty sketches is 1, of one empty sketch 0. Words are taken in lower case (A-Z).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_shingles, hashed_words, row_chunks, text_bytes

#: One hash in so many is kept.
SCALE = 8
#: Texts of at most so many distinct shingles keep all.
WHOLE = 64


def _below(hashes: np.ndarray, scale: int) -> np.ndarray:
    return hashes[hashes <= np.uint64((1 << 64) // scale - 1)]


def sketches(column: pa.Array, scale: int = SCALE, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes below 2^64 / scale of each text, all of a text with few."""
    data, offsets = text_bytes(column)
    out: list[np.ndarray] = []
    limit = np.uint64((1 << 64) // scale - 1)
    for low, high in row_chunks(offsets):
        words, _, _, rows = hashed_words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        hashes, begin = hashed_shingles(words, rows, size)
        kept = np.flatnonzero(hashes <= limit)
        cut = np.searchsorted(kept, begin)
        kept = hashes[kept]
        for i in range(high - low):
            own = kept[cut[i] : cut[i + 1]]
            if len(own) <= WHOLE and begin[i + 1] > begin[i]:
                every = np.unique(hashes[begin[i] : begin[i + 1]])
                own = every if len(every) <= WHOLE or not len(own) else own
            out.append(np.unique(own))
    return out


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a, b)
    parts = [x for x in (a, b) if len(x)]
    low = _below(both, scale)
    if all(len(_below(x, scale)) < len(x) for x in parts) and (len(both) <= WHOLE or not len(low)):
        return both
    return low


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float | None:
    """What part of the smaller sketch lies in the other; None if they cover no common scale."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = _below(a, scale), _below(b, scale)
    if len(low[0]) == len(a) or len(low[1]) == len(b):  # not both are known to be whole
        a, b = low
        if not len(a) or not len(b):
            return None
    both = np.sort(np.concatenate([a, b]))
    return int((both[1:] == both[:-1]).sum()) / min(len(a), len(b))


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), scale: int = SCALE, size: int = 5) -> DataFrame:
    """The columns `keep` and the fingerprint of each row's text."""
    keep = tuple(c for c in keep if c != "fingerprint")
    schema = docs.select(*keep).schema.add("fingerprint", "string")

    def run(batches):
        for batch in batches:
            found = [as_text(s) for s in sketches(batch.column("__text"), scale, size)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string())], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def with_next(docs: DataFrame, f: Callable, schema: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """f(ids, texts) over runs of rows by descending id, each but the last followed by its next; the smallest id is followed by the largest.

    f takes n + 1 ids and texts and returns a record batch of n rows. Ranges of ids go to tasks of their own, and the
    first row of each range also to the range before: one shuffle, no window over all rows. Null ids come last; rows
    of equal id are ordered by a hash of their text.
    """
    spark = docs.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.bitwise_not(F.col(doc_id).cast("long")).cast("double"), F.lit(float("inf"))).alias("near"), F.struct(F.col(doc_id).isNull().alias("void"), F.bitwise_not(F.col(doc_id).cast("long")).alias("down")).alias("place"))
    cuts = sorted({x for x in rows.select("near").where(F.col("near") < float("inf")).approxQuantile("near", [i / ranges for i in range(1, ranges)], 0.2 / ranges)})
    if cuts:
        rows = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="near", outputCol="range").transform(rows).withColumn("range", F.col("range").cast("int"))
    else:
        rows = rows.withColumn("range", F.lit(0))
    # ranges are cut by ids as doubles, which may take neighbouring long ids for equal but never out of order; within a range the ids themselves decide
    first = sorted((r["range"], r["top"]) for r in rows.groupBy("range").agg(F.min("place").alias("top")).collect())  # a row for each range
    lent = spark.createDataFrame([(r, top, first[i - 1][0]) for i, (r, top) in enumerate(first)], "r int, top struct<void: boolean, down: long>, lender int")
    rows = rows.join(F.broadcast(lent), F.col("range") == F.col("r"))
    own, loan = F.struct(F.col("range").alias("to"), F.lit(False).alias("lent")), F.struct(F.col("lender").alias("to"), F.lit(True).alias("lent"))
    rows = rows.withColumn("h", F.xxhash64("text")).select("id", "text", "place", "h", F.explode(F.when(F.col("place") == F.col("top"), F.array(own, loan)).otherwise(F.array(own))).alias("x"))
    rows = rows.select("x.to", "x.lent", "id", "text", "place", "h").repartitionById(ranges, "to").sortWithinPartitions("to", "lent", "place", "h")

    def run(batches):
        held, closed = None, None  # the last own row of the range so far; the range whose lent row has come
        for batch in batches:
            to, lent, n, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.num_rows, 0
            while at < n:
                end = at
                if to[at] == closed:
                    at += 1
                    continue
                while end < n and to[end] == to[at] and not lent[end]:
                    end += 1
                last = end < n and to[end] == to[at]
                ids, texts = (batch.column(i).slice(at, end - at + last).to_pylist() for i in (2, 3))
                if held is not None and held[0] == to[at]:
                    ids, texts = [held[1], *ids], [held[2], *texts]
                if len(ids) > 1:
                    yield f(ids, texts)
                held, closed = (None, to[at]) if last else ((to[at], ids[-1], texts[-1]), closed)
                at = end + last

    return rows.select("to", "lent", "id", "text").mapInArrow(run, schema)
