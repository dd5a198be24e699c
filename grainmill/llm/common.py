"""Helpers shared by the training-data operators: staging, row chunks and hashed words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared folder (on this machine alone, as in tests, a temporary one where that is unset); gone when the driver ends."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not (sc.master or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="grainmill-")
        sc.setCheckpointDir(top)
        top = sc.getCheckpointDir()
    path = f"{top}/grainmill-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def modest(spark: SparkSession) -> None:
    """Arrow batches of 16 MB at most, unless the session says otherwise than by default: both the JVM and a worker hold one."""
    if spark.conf.get(_BATCH) in ("67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH, "16m")


def stage(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut there, and a lost executor costs no recomputation."""
    modest(df.sparkSession)
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = 4 << 20):
    """Row ranges of about `most` bytes each; a longer row stands alone."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    _POWER = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(65535, _BASE, np.uint64))])
_VALUE_LOWER = _VALUE[_LOWER]


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, separators: bytes = b" \t\n\v\f\r"):
    """All words of the rows: 64-bit hashes, their byte spans, and where each row's words begin (rows + 1 numbers).

    A word's hash is a polynomial in its bytes modulo 2^64, then mixed. All work is whole-array; pieces are
    cut at white space, so the working memory does not grow with a text.
    """
    value = _VALUE_LOWER if lower else _VALUE
    space = np.zeros(256, bool)
    space[list(separators)] = True
    hashes, starts, ends = [], [], []
    low, n = 0, len(data)
    while low < n:
        high = min(n, low + (1 << 20))
        while high < n:  # to the next white space, so that no word is cut
            gap = np.flatnonzero(space[data[high : high + 65536]])
            if len(gap):
                high += int(gap[0]) + 1
                break
            high = min(n, high + 65536)
        part = data[low:high]
        word = ~space[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        cuts = offsets[np.searchsorted(offsets, low, "left") : np.searchsorted(offsets, high, "left")] - low
        first[cuts] = word[cuts]
        begin = np.flatnonzero(first)
        if len(begin):
            last = word.copy()
            last[:-1] &= ~word[1:] | first[1:]
            end = np.flatnonzero(last) + 1
            place = np.arange(len(part))
            place[begin[0] :] -= np.repeat(begin, np.diff(np.append(begin, len(part))))
            with np.errstate(over="ignore"):
                terms = np.where(word, value[part], np.uint64(0)) * _POWER[place & 0xFFFF]
                if len(place) > 65536 and (far := place >> 16).any():
                    top = int(far.max())
                    terms *= np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(top, _POWER[65535] * _BASE, np.uint64))])[far]
                hashes.append(mix(np.add.reduceat(terms, begin)))
            starts.append(begin + low)
            ends.append(end + low)
        low = high
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    starts = join(starts, np.int64)
    return join(hashes, np.uint64), starts, join(ends, np.int64), np.searchsorted(starts, offsets, "left")


def hashed_shingles(words: np.ndarray, rows: np.ndarray, size: int):
    """Hashes of `size` successive words of each row, and where each row's begin; a shorter row gives its whole sequence as one, an empty one none."""
    count = np.diff(rows)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(count)), made)
    at = rows[:-1][row] + np.arange(begin[-1]) - begin[:-1][row]
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            inside = k < count[row]
            out = (out + np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))], np.uint64(0)) if len(words) else out) * _BASE + np.uint64(k + 1)
        return mix(out), begin
