"""Token counts by a two-tier map-side lookup, for sentencepiece models whose pieces never reach past a space.

No piece of such a model holds a space mark after another character (checked when the model is loaded), so the pieces
of a text are those of its pre-tokens: each run of spaces with the characters up to the next space. Their lengths add
up to the text's count exactly. Tier one is a compact table of the frequent pre-tokens, 64-bit hash -> length, sorted
arrays of a fixed number of entries, broadcast; a whole batch is looked up in numpy. Tier two is a cache in each
Python worker, bounded in entries, that encodes what the table misses. Pre-tokens are never shuffled. The table is
chosen from a bounded random sample of rows; it decides only how fast a length is found, never what it is.

Defined results: null and empty texts have no tokens; special strings in a text are ordinary text, as is the library's
default.
"""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, row_chunks, text_bytes

#: The mark that stands for a space in pieces, and is itself taken as one.
MARK = "▁"
CACHE = 400_000


@functools.cache
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size())):
        raise ValueError(f"pieces of {path} reach past a space")
    return model


class _Lengths(dict):
    """Length of a pre-token, given without its first space; forgets all at CACHE entries."""

    def __init__(self, model):
        self.encode = model.encode

    def __missing__(self, key: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[key] = len(self.encode(key)) if key else 1
        return n


@functools.cache
def _lengths(path: str) -> _Lengths:
    return _Lengths(_model(path))


def _pre_tokens(data: np.ndarray, offsets: np.ndarray):
    """Hashes, byte spans and row bounds of the pre-tokens (without the first space), and which of them start with further spaces or are spaces alone."""
    hashes, starts, ends, rows = hashed_words(data, offsets, lower=False, separators=b" ")
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    left = np.append(0, ends[:-1]) if len(ends) else ends
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
    left[first] = offsets[:-1][row[first]]
    odd = starts - left > 1
    odd[first] = starts[first] > left[first]
    return hashes, starts, ends, left, odd, row, first


def _counts(column: pa.Array, lengths: _Lengths, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    data, offsets = text_bytes(column)
    if (data == 0xE2).any() and any(MARK in (t or "") for t in column.to_pylist()):
        data, offsets = text_bytes(pa.array([(t or "").replace(MARK, " ") for t in column.to_pylist()], pa.large_string()))
    hashes, starts, ends, left, odd, row, first = _pre_tokens(data, offsets)
    total = np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    if len(hashes):
        keys, values = table
        at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
        hit = (keys[at] == hashes) & ~odd if len(keys) else np.zeros(len(hashes), bool)
        n = np.zeros(len(hashes), np.int64)
        n[hit] = values[at[hit]]
        begin = np.where(odd, left + 1, starts)
        begin[first] = left[first]
        miss = np.flatnonzero(~hit)
        n[miss] = [lengths[raw[a:b].decode()] for a, b in zip(begin[miss].tolist(), ends[miss].tolist(), strict=True)]
        total += np.bincount(row, weights=n, minlength=len(total)).astype(np.int64)
    # spaces after the last word, or a text of spaces alone
    last = offsets[:-1].copy()
    if len(row):
        np.maximum.at(last, row, ends)
    for i in np.flatnonzero(offsets[1:] > last):
        total[i] += lengths[" " * int(offsets[i + 1] - last[i] - (last[i] > offsets[i]))]
    return total


def frequent(docs: DataFrame, text: str, model: str, entries: int, sample_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The table: of a random sample of about `sample_docs` rows, the `entries` most frequent pre-tokens with their lengths."""
    most = max(1024, entries // 4)

    def heads(batches):
        lengths, n, words = _lengths(model), {}, {}
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for low, high in row_chunks(offsets):
                part = data[offsets[low] : offsets[high]]
                hashes, starts, ends, _, odd, _, _ = _pre_tokens(part, offsets[low : high + 1] - offsets[low])
                keys, at, times = np.unique(hashes[~odd], return_index=True, return_counts=True)
                starts, ends, raw = starts[~odd], ends[~odd], part.tobytes()
                for k, i, c in zip(keys.tolist(), at.tolist(), times.tolist(), strict=True):
                    n[k] = n.get(k, 0) + c
                    words.setdefault(k, raw[starts[i] : ends[i]])
                if len(n) > 16 * most:
                    n = dict(sorted(n.items(), key=lambda x: -x[1])[: 8 * most])
                    words = {k: words[k] for k in n}
        top = [k for k in sorted(n, key=lambda k: (-n[k], k))[:most] if MARK.encode() not in words[k]]
        yield pa.record_batch([pa.array(np.array(top, np.uint64).view(np.int64)), pa.array([n[k] for k in top], pa.int64()), pa.array([min(65535, lengths[words[k].decode()]) for k in top], pa.int32())], ["h", "n", "length"])

    share = min(1.0, sample_docs / max(1, docs.count()))
    found = docs.select(F.col(text).alias("t")).sample(share, 1).mapInArrow(heads, "h long, n long, length int").where("length < 65535")
    top = found.groupBy("h").agg(F.sum("n").alias("n"), F.first("length").alias("length")).orderBy(F.col("n").desc(), "h").limit(entries).toArrow()
    keys, lengths = top.column(0).to_numpy().view(np.uint64), top.column(2).to_numpy().astype(np.uint16)
    order = np.argsort(keys)
    return keys[order], lengths[order]


def count_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str | None = None, entries: int = 65_536, sample_docs: int = 4_096) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, path, entries, sample_docs))
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema.add("n_bytes", "long").add("n_tokens", "long")

    def count(batches):
        lengths = _lengths(path)
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            n = [_counts(batch.column(1).slice(low, high - low), lengths, table.value) for low, high in row_chunks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, schema)
