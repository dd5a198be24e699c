"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised once, map-side, and cut into pieces of at most `length` tokens (only documents that are longer
than that; the first piece takes the remainder). Which pieces share a sequence depends on their lengths alone, so the
plan is made on the driver from the counts of the 1..length lengths, bounded whatever the corpus: a sequence is filled
greedily with the longest pieces that fit, then its smallest piece gives way to two others that fill the widened gap
more tightly; the pattern is repeated as often as the counts allow. Pieces find their places by their rank among those
of their length, which is a running number within a task plus the counts of the tasks before: no sort, and a length
that a third of all pieces share is as good as any other.

Defined results: a null or empty text is a piece with the end id alone; repeated rows are packed each; an empty table
gives no row.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_chunks, stage, text_bytes


@functools.cache
def _encoder(ranks: str, vocabulary: str):
    """The text's ids as numpy numbers. The rank file holds the same vocabulary and gives the same ids several times faster; what it refuses goes to the first library."""
    import tiktoken
    from tokenizers import Tokenizer

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": 50256})
    slow = Tokenizer.from_file(vocabulary)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # noqa: BLE001  its regex engine gives up on extreme runs of white space
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 1024, end_id: int = 2, ranks: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with the task (`part`) that made it and its number (`nth`) there among those of its length."""
    ranks, vocabulary = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("part", "integer").add("nth", "long")

    def cut(batches):
        encode, seen, part = _encoder(ranks, vocabulary), [0] * (length + 1), TaskContext.get().partitionId()
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for low, high in row_chunks(offsets, 8 << 20):
                row, at, start, size, crc, nth = [], [], [], [], [], []
                for i, t in enumerate(batch.column(1).slice(low, high - low).to_pylist()):
                    ids = np.append(encode(t), end_id).astype("<u4") if t else np.array([end_id], "<u4")
                    n = len(ids)
                    whole = memoryview(ids.tobytes())
                    first = (n - 1) % length + 1
                    for k in range(-(-n // length)):
                        a, b = (0, first) if k == 0 else (first + (k - 1) * length, first + k * length)
                        row.append(low + i)
                        at.append(k)
                        start.append(a)
                        size.append(b - a)
                        crc.append(zlib.crc32(whole[4 * a : 4 * b]))
                        nth.append(seen[b - a])
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc)), pa.array(np.full(len(row), part), pa.int32()), pa.array(nth, pa.int64())], names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (piece length, first rank, rank after the last, pieces a sequence, first sequence, offset) for so many pieces of each length."""
    left = [counts.get(n, 0) for n in range(length + 1)]
    below = [0] * (length + 1)  # the longest length on hand that is at most so long

    def refresh() -> None:
        best = 0
        for n in range(1, length + 1):
            best = n if left[n] else best
            below[n] = best

    def fits(gap: int, used: dict[int, int]) -> int:
        n = below[gap] if gap > 0 else 0
        while n and left[n] <= used.get(n, 0):
            n = below[n - 1]
        return n

    refresh()
    taken, sequence, slots = [0] * (length + 1), 0, []
    while below[length]:
        used: dict[int, int] = {}
        gap = length
        while n := fits(gap, used):
            used[n] = used.get(n, 0) + 1
            gap -= n
        least = min(used)
        if gap and len(used) + max(used.values()) > 2:
            room, best = gap + least, (least, 0, 0)
            rest = {k: v - (k == least) for k, v in used.items()}
            a = fits(room - 1, rest)
            while a and 2 * a > best[0]:
                b = fits(min(a, room - a), rest | {a: rest.get(a, 0) + 1})
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                a = fits(a - 1, rest) if a > 1 and best[0] < room else 0
            if best[1]:
                used = {k: v for k, v in rest.items() if v}
                for n in best[1:]:
                    used[n] = used.get(n, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            slots.append((n, taken[n], taken[n] + times * k, k, sequence, offset))
            offset += n * k
            taken[n] += times * k
            left[n] -= times * k
        sequence += times
        refresh()
    return slots


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 1024, end_id: int = 2, **files: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = stage(pieces(docs, text, doc_id, length, end_id, **files))
    by_task = cut.groupBy(F.col("part").alias("p"), F.col("length").alias("l")).agg(F.count("*").alias("n"))
    counts = {r["l"]: r["n"] for r in by_task.groupBy("l").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    before = by_task.select("p", "l", (F.sum("n").over(Window.partitionBy("l").orderBy("p")) - F.col("n")).alias("before"))
    made = plan(counts, length)
    slots = cut.sparkSession.createDataFrame(made, "slot_length long, low long, high long, each long, first long, place long")
    if len(made) <= 1 << 16:  # a few for each length, so many only where sequences are very long
        slots = F.broadcast(slots)
    placed = cut.join(before, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).withColumn("rank", F.col("nth") + F.col("before"))
    placed = placed.join(slots, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = F.col("rank") - F.col("low")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(at / F.col("each")).cast("long")).alias("sequence_id"), (F.col("place") + at % F.col("each") * F.col("length")).cast("long").alias("offset"))
