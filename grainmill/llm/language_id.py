"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fit: a bounded sample of labelled texts is counted into hashed n-gram buckets per language; the matrix of smoothed
log probabilities (buckets x languages) is a few MB whatever the corpus, and is broadcast. Scoring: every whole text
becomes bucket numbers in numpy, their matrix rows are summed by text, and the class posterior is the score.

Defined results: a null text, an empty one and one without a letter are `und` with score 0, as are all where no
language was learned. Ties go to the smallest language name. Labels that are null teach nothing. Repeated rows count
as often as they stand there.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import modest, row_chunks, text_bytes

ORDERS = (1, 2, 3)
#: Languages of a model at most: its matrix takes 128 KiB for each.
MOST = 2048


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def hashed_grams(texts: list[str], bits: int):
    """Bucket numbers of the character n-grams of each text, where each text's begin, and whether it has a letter. Runs of other characters count as one space."""
    low = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[bounds[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[bounds]
    points = np.where(letter, points, 32)[keep].astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    out, rows, h = [], [], np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for k in ORDERS:
            n = len(points) - k + 1
            if n <= 0:
                break
            h = h[:n] * np.uint64(0x100000001B3) + points[k - 1 :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            whole = row[:n] == row[k - 1 :]
            x = h[whole]
            out.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64))
            rows.append(row[:n][whole])
    has = np.bincount(row, weights=points != 32, minlength=len(texts)) > 0
    return out, rows, has


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    log_prob: np.ndarray  # (buckets, labels), float32
    prior: np.ndarray
    bits: int


def fit(docs: DataFrame, text: str = "text", label: str = "lang", bits: int = 15, sample_docs: int = 20_000, alpha: float = 0.1) -> LanguageModel:
    """Learns from about `sample_docs` texts of each label at most, chosen by a hash of the text and the other columns.

    Only the sample is bounded; the class priors come from all labelled rows. What reaches the driver is at most
    2^bits counts a label."""
    modest(docs.sparkSession)
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("l"), F.col(text).alias("t"), F.xxhash64(*docs.columns).alias("h"))
    totals = sorted((r["l"], r["n"]) for r in docs.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n")).collect())
    labels = tuple(k for k, _ in totals)
    if len(labels) > MOST:
        raise ValueError(f"{len(labels)} labels; the matrix that is broadcast holds {MOST} at most")
    if not labels:
        return LanguageModel((), np.zeros((1 << bits, 0), np.float32), np.zeros(0), bits)
    share = F.create_map(*[F.lit(x) for k, n in totals for x in (k, min(1.0, sample_docs / n))])
    place = {k: i for i, k in enumerate(labels)}

    def count(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            names, column = batch.column(0).to_pylist(), batch.column(1)
            _, offsets = text_bytes(column)
            for low, high in row_chunks(offsets, 1 << 18):
                grams, rows, _ = hashed_grams(column.slice(low, high - low).to_pylist(), bits)
                of = np.array([place[x] for x in names[low:high]])
                for g, r in zip(grams, rows, strict=True):
                    for k in np.unique(of):
                        seen[k] = seen.get(k, 0) + np.bincount(g[of[r] == k], minlength=1 << bits)
        for k, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["l", "b", "n"])

    counts = np.zeros((1 << bits, len(labels)))
    sample = rows.where((F.col("h").bitwiseAND(0xFFFFFF) / float(1 << 24)) < share[F.col("l")]).select("l", "t")
    rows = sample.mapInArrow(count, "l int, b int, n long").groupBy("b", "l").agg(F.sum("n").alias("n")).toArrow()
    counts[rows.column(0).to_numpy(), rows.column(1).to_numpy()] = rows.column(2).to_numpy()
    smooth = np.log(counts + alpha) - np.log(counts.sum(0) + alpha * (1 << bits))
    n = np.array([n for _, n in totals], float)
    return LanguageModel(labels, smooth.astype(np.float32), np.log(n / n.sum()), bits)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds lang_pred and score to each row; keep: the input columns to return (all by default). Input columns of these two names give way."""
    keep = tuple(c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    spread = docs.sparkSession.sparkContext.broadcast((model.labels, model.log_prob, model.prior, model.bits))
    chunk = max(1 << 14, (1 << 20) // max(4, len(model.labels)))

    def score(batches):
        labels, log_prob, prior, bits = spread.value
        for batch in batches:
            column, pred, sure = batch.column("__text"), [], []
            _, offsets = text_bytes(column)
            for low, high in row_chunks(offsets, chunk):
                texts = [t or "" for t in column.slice(low, high - low).to_pylist()]
                grams, rows, has = hashed_grams(texts, bits)
                total = np.tile(prior, (len(texts), 1))
                for g, r in zip(grams if labels else (), rows, strict=False):
                    if len(g):
                        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                        total[r[first]] += np.add.reduceat(log_prob[g], first, axis=0, dtype=np.float64)
                if labels:
                    best = total.argmax(1)
                    top = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for i in range(len(texts)):
                    known = bool(labels) and bool(has[i])
                    pred.append(labels[best[i]] if known else "und")
                    sure.append(float(top[i]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(score, schema)
