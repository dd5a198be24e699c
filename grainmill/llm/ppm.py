"""Language-model scores by prediction by partial matching over bytes, and a unigram base beside them.

Pretrained model: the counts of the symbols that follow each byte context of up to `ORDER` bytes, learned from all
training texts; all of them count, however rare. A symbol is coded in the longest known context; a context that does
not hold it escapes to the next shorter one, where the symbols of the longer are excluded; last comes a uniform choice
among the symbols never seen. Escapes are estimated from the symbols a context has seen once. A context
starts with its text and runs across tokens, between which there is one space.

A symbol's code length depends on its event alone, which is its longest context and itself. The distinct events of all
texts are a table with their counts. Events whose contexts end with the same `SPLIT` bytes share all longer contexts:
they are coded together, from their own counts and those of the contexts below `SPLIT` bytes, which each task has.

Adaptive part: where the `BACK` tokens before a token stood earlier in the same text, the token that followed them last
is predicted first, with a probability that adapts to how often such predictions held in this text; if it fails, the
token is coded as above.

Learning: each task counts its events and tokens (63-bit hashes) in sorted arrays of a bounded size before anything is
shuffled. Scoring: the code lengths of common events and the counts of frequent tokens are tables of bounded size,
broadcast and looked up in numpy; a text's other events and tokens meet theirs in joins. The tables' sizes decide only
speed. No text is shuffled, and long texts are worked through in windows.

Defined results: a null or empty text is one end token; words are taken in lower case (A-Z); without training texts the
model is empty and symbols are uniform, the base has c = N = V = 0. Repeated rows are rows of their own.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _LOWER, _VALUE, mix, row_chunks, stage, text_bytes

#: Longest context in bytes (6 at most: a context and a symbol share a long), and the symbols that end a token and a text.
ORDER, SPACE, END = 6, 0x20, 0x0A
#: Weight of a context's single symbols in its escapes, and what is added to them; successes and failures that adaptive predictions start with.
SINGLE, NEW, HELD, FAILED = 0.7, 0.2, 4.0, 0.25
BACK = 3
#: Events are dealt out by so many bytes at the end of their contexts, and coded so many at a time.
SPLIT, GROUP = 3, 1 << 18
#: Bytes of texts that are worked on at a time, and distinct keys that a task holds before it passes them on.
WINDOW, HOLD = 1 << 20, 1 << 21

_PLAIN = _LOWER.copy()
_PLAIN[[9, 10, 11, 12, 13]] = SPACE
_MASK = (1 << (8 * np.arange(ORDER + 1))) - 1


class Texts:
    """Some rows as one run of symbols: each text is a space, its lower-case words with a space after each, and END."""

    def __init__(self, part: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        first = offsets[:-1] + 3 * np.arange(rows)
        last = offsets[1:] + 3 * np.arange(rows) + 1
        raw, given = np.empty(len(part) + 3 * rows, np.uint8), np.ones(len(part) + 3 * rows, bool)
        given[first] = given[last] = given[last + 1] = False
        raw[given] = _PLAIN[part]
        raw[first] = raw[last] = SPACE
        raw[last + 1] = END
        keep = raw != SPACE
        keep[1:] |= keep[:-1].copy()  # a space that follows something else
        keep[:1] = True
        self.text = raw[keep]
        self.begin = np.append(0, np.flatnonzero(self.text == END) + 1)
        spaces = np.flatnonzero(self.text == SPACE)
        opening = np.searchsorted(spaces, self.begin[:-1])
        closing = np.ones(len(spaces), bool)
        closing[opening] = False
        self.ends, self.starts = spaces[closing], spaces[np.flatnonzero(closing) - 1] + 1
        #: Number of each row's first word.
        self.rows = np.append(opening - np.arange(rows), len(self.ends))

    def windows(self):
        """Bounds of runs of about `WINDOW` symbols."""
        return [(a, min(a + WINDOW, len(self.text))) for a in range(0, len(self.text), WINDOW)]

    def events(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The events (deepest entries) of the symbols low to high - 1, and which of them are coded: all but texts' first spaces."""
        back = max(0, low - ORDER)
        e = self.text[back:high].astype(np.int64)
        for k in (1, 2, 4):  # the last 2, 4 and 8 symbols in a long, the last lowest
            e[k:] |= e[:-k].copy() << (8 * k)
        e = (e[low - back :] & ((1 << 8 * (ORDER + 1)) - 1)) | (ORDER << 56)
        coded = np.ones(high - low, bool)
        for k in range(ORDER):
            at = self.begin[:-1] + k
            at = at[(at < self.begin[1:]) & (at >= low) & (at < high)] - low
            if k:
                e[at] = (e[at] & ((1 << 8 * (k + 1)) - 1)) | (k << 56)
            else:
                coded[at] = False
        return e, coded

    def row_of(self, low: int, high: int) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(np.clip(self.begin, low, high)))

    def words(self) -> np.ndarray:
        """A hash of each word, below 0: a polynomial in its bytes, then mixed."""
        out, low, n = [], 0, len(self.starts)
        while low < n:
            high = max(low + 1, int(np.searchsorted(self.ends, self.starts[low] + WINDOW, "right")))
            a, b = int(self.starts[low]), int(self.ends[high - 1])
            first, last = self.starts[low:high] - a, self.ends[low:high] - a
            with np.errstate(over="ignore"):
                power, inverse = _powers(max(WINDOW, b - a))
                upto = np.zeros(b - a + 1, np.uint64)
                np.cumsum(_VALUE[self.text[a:b]] * power[: b - a], out=upto[1:])
                out.append(mix((upto[last] - upto[first]) * inverse[first]))
            low = high
        return (np.concatenate(out) if out else np.zeros(0, np.uint64)).view(np.int64) | np.iinfo(np.int64).min


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.append(np.uint64(1), np.multiply.accumulate(np.full(n - 1, x, np.uint64))) for x in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))))


def texts_of(column: pa.Array):
    """Runs of rows: first row, row after the last, their symbols."""
    data, offsets = text_bytes(column)
    for low, high in row_chunks(offsets, 2 * WINDOW):
        yield low, high, Texts(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])


class Tally:
    """Counts of longs in sorted arrays of a bounded size."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, weight: int) -> None:
        keys, n = np.unique(keys, return_counts=True)
        self.parts.append((keys, (n * weight).astype(np.int32)))

    def full(self) -> bool:
        if sum(len(k) for k, _ in self.parts) > HOLD + HOLD // 2:
            self.parts = [self.given()]
        return len(self.parts) == 1 and len(self.parts[0][0]) > HOLD

    def given(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys and counts; none is left."""
        keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in self.parts)])
        n = np.concatenate([np.zeros(0, np.int32), *(n for _, n in self.parts)])
        self.parts = []
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        del order
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[first], np.add.reduceat(n, first, dtype=np.int32) if len(keys) else n


def counts(docs: DataFrame) -> DataFrame:
    """text, train (boolean) -> key, n: every distinct event of all texts, and the hash of every distinct word (below 0), with its count in those for training."""

    def run(batches):
        tally = Tally()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in tally.given()], names=["key", "n"])
        for batch in batches:
            train = pc.fill_null(batch.column(1), False)
            for own, weight in ((train, 1), (pc.invert(train), 0)):
                for _, _, texts in texts_of(batch.column(0).filter(own)):
                    for low, high in texts.windows():
                        event, coded = texts.events(low, high)
                        tally.add(event[coded], weight)
                        if tally.full():
                            yield give()
                    tally.add(texts.words(), weight)
        yield give()

    # tasks have added up what they could: what they give is dealt out before Spark adds it up
    return docs.select("text", "train").mapInArrow(run, "key long, n int").repartition("key").groupBy("key").agg(F.sum("n").alias("n"))


def _entry(order, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Order (one, or one for each), context and symbol in a long."""
    return (order << 56) | ((context & _MASK[order]) << 8) | symbol


def entries(event: np.ndarray, n: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of order low to high - 1 that these events with counts above 0 make, and their counts."""
    event, n = event[n > 0], n[n > 0]
    made = []
    for order in range(low, high):
        deep = event >> 56 >= order
        keys, back = np.unique(_entry(order, event[deep] >> 8, event[deep] & 255), return_inverse=True)
        made.append((keys, np.bincount(back, weights=n[deep], minlength=len(keys)).astype(np.int64)))
    return np.concatenate([k for k, _ in made]), np.concatenate([c for _, c in made])


class Trie:
    """Sorted entries with counts; contexts with their total, distinct symbols, and the share of the next shorter context's total that these symbols hold."""

    def __init__(self, entry: np.ndarray, n: np.ndarray, context: np.ndarray, escapes: np.ndarray):
        """context, escapes: the weight of escapes in each context (contexts that are not given have `NEW`)."""
        order = np.argsort(entry)
        self.entry, self.n = entry[order], n[order]
        self.context, first = np.unique(self.entry >> 8, return_index=True)
        depth, symbol, held = self.entry >> 56, self.entry & 255, (self.entry >> 8) & ((1 << 48) - 1)
        up = ((depth - 1) << 56) | ((held & ((np.int64(1) << (8 * np.maximum(depth - 1, 0))) - 1)) << 8) | symbol
        at = self._find(self.entry, up)
        above = np.where((depth > 0) & (at >= 0), self.n[at] if len(self.n) else 0, 0)
        total = lambda x: np.add.reduceat(x, first) if len(first) else x
        self.total, self.excluded, self.distinct = total(self.n), total(above), np.diff(np.append(first, len(self.entry)))
        self.escape = np.full(len(self.context), NEW)
        at = self._find(self.context, context)
        self.escape[at[at >= 0]] += escapes[at >= 0]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted keys, -1 where there is none."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def log10(self, symbol: np.ndarray, context: np.ndarray, length: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability in its context."""
        out, open_ = np.zeros(len(symbol)), np.arange(len(symbol))
        longer = np.full(len(symbol), -1)  # the next longer context, where it is known
        for order in range(ORDER, -1, -1):
            take = open_[length[open_] >= order]
            if not len(take):
                continue
            entry = _entry(order, context[take], symbol[take])
            at = self._find(self.context, entry >> 8)
            known = at >= 0
            take, entry, at = take[known], entry[known], at[known]
            over = longer[take]
            total = self.total[at] - np.where(over >= 0, self.excluded[over], 0)
            distinct = self.distinct[at] - np.where(over >= 0, self.distinct[over], 0)
            longer[take] = at
            new = distinct > 0  # else the longer context has excluded all
            take, entry, total, escape = take[new], entry[new], total[new], self.escape[at[new]]
            hit = self._find(self.entry, entry)
            out[take] += np.log10(np.where(hit >= 0, self.n[hit] if len(self.n) else 0, escape) / (total + escape))
            open_ = np.setdiff1d(open_, take[hit >= 0], assume_unique=True)
        root = self._find(self.context, np.zeros(1, np.int64))[0]
        out[open_] -= math.log10(max(1, 256 - (self.distinct[root] if root >= 0 else 0)))
        return out


def trie_of(entry: np.ndarray, n: np.ndarray) -> Trie:
    """The trie of whole contexts; escapes by their single symbols."""
    context, back = np.unique(entry[n == 1] >> 8, return_counts=True)
    return Trie(entry, n, context, SINGLE * back)


def event_codes(events: DataFrame) -> DataFrame:
    """key (an event), n -> key, n, code: the log10 of each event's probability, from all entries."""
    spark = events.sparkSession
    # entries of contexts below SPLIT bytes, 256^SPLIT at most whatever the input: the deepest of each event here, the others from these
    depth = F.least(F.shiftright("key", 56), F.lit(SPLIT - 1))
    low = F.element_at(F.array(*[F.lit((1 << 8 * (k + 1)) - 1) for k in range(SPLIT)]).cast("array<long>"), (depth + 1).cast("int"))
    rows = events.where("n > 0").groupBy((depth * (1 << 56)).bitwiseOR(F.col("key").bitwiseAND(low)).alias("entry")).agg(F.sum("n").alias("n")).toArrow()
    short = spark.sparkContext.broadcast(entries(rows.column(0).to_numpy(), rows.column(1).to_numpy(), 0, SPLIT))

    def coded(event, n):
        entry, count = entries(event, n, SPLIT, ORDER + 1)
        trie = trie_of(np.append(short.value[0], entry), np.append(short.value[1], count))
        code = trie.log10(event & 255, (event >> 8) & _MASK[ORDER], event >> 56)
        return pa.record_batch([pa.array(event), pa.array(n), pa.array(code)], ["key", "n", "code"])

    def run(batches):
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy() for i in range(3)]))
            size += batch.num_rows
            if size < GROUP:
                continue
            rows = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last group may go on
            if cut:
                yield coded(*rows[1:, :cut])
            held, size = [rows[:, cut:]], rows.shape[1] - cut
        if size:
            yield coded(*np.concatenate(held, axis=1)[1:])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), events.count() // GROUP)
    rows = events.select(F.expr(f"shiftright(key, 8) & {(1 << 8 * SPLIT) - 1}L").alias("g"), "key", "n").repartition(parts, "g").sortWithinPartitions("g")
    return rows.mapInArrow(run, "key long, n long, code double")


class Lookup:
    """Places of longs in a table of distinct longs, -1 where there is none: one slot for each hash, and what finds its slot taken in a next, smaller table."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, []
        left = np.arange(len(keys))
        while len(left):
            shift = np.uint64(64 - max(4, int(3 * len(left)).bit_length()))
            slot = np.zeros(1 << int(64 - shift), np.int32)
            at = self._hash(keys[left], shift, len(self.levels))
            slot[at] = left
            self.levels.append((shift, slot))
            left = left[slot[at] != left]

    @staticmethod
    def _hash(x: np.ndarray, shift: np.uint64, level: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (x.view(np.uint64) * (np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * level) * np.uint64(0xD6E8FEB86659FD93))) >> shift

    def find(self, wanted: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(wanted), -1), None
        for level, (shift, slot) in enumerate(self.levels):
            x = wanted if open_ is None else wanted[open_]
            at = slot[self._hash(x, shift, level)].astype(np.int64)
            hit = self.keys[at] == x
            if open_ is None:
                out = np.where(hit, at, -1)
                open_ = np.flatnonzero(~hit)
            else:
                out[open_[hit]] = at[hit]
                open_ = open_[~hit]
        return out


def most_frequent(rows: DataFrame, most: int) -> pa.Table:
    """Rows of the greatest n, about `most` at most, those of the greatest first."""
    size = rows.count()
    least = -1 if size <= most else rows.approxQuantile("n", [1 - 0.95 * most / size], 0.04 * most / size)[0]
    return rows.where(F.col("n") > least).toArrow().sort_by([("n", "descending")])


def predicted(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words the adaptive part gets right, and the log10 its predictions cost each text."""
    count = np.diff(rows)
    row = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(np.arange(len(words)) - np.repeat(rows[:-1], count) >= BACK)
    key = row[at].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, BACK + 1):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + words[at - k].view(np.uint64))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    now, before = at[order[same + 1]], at[order[same]]
    held = words[now] == words[before]
    now, held = now[place := np.argsort(now)], held[place]
    own = row[now]
    first = np.searchsorted(own, own)
    tried, good = np.arange(len(now)) - first, np.append(0, np.cumsum(held))
    good = good[:-1] - good[first]
    cost = np.log10(np.where(held, good + HELD, tried - good + FAILED) / (tried + HELD + FAILED))
    right = np.zeros(len(words), bool)
    right[now[held]] = True
    return right, np.bincount(own, weights=cost, minlength=len(count)).astype(float)


def score(docs: DataFrame, frequent: int = 1 << 18, common: int = 1 << 21) -> DataFrame:
    """doc_id, text, train -> doc_id, train, n_tokens, n_known, train_tokens, base_score, score. frequent, common: the tokens and events that are broadcast."""
    spark = docs.sparkSession
    found = stage(counts(docs))
    words, events = found.where("key < 0"), found.where("key >= 0")
    sums = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    texts = docs.where("train").count()
    tokens, kinds = (sums["n"] or 0) + texts, sums["v"] + (texts > 0)
    base = lambda c: np.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1)))
    top = most_frequent(words, frequent)
    n = top.column(1).to_numpy()
    table = spark.sparkContext.broadcast((Lookup(top.column(0).to_numpy()), n > 0, base(n.astype(float))))
    codes = stage(event_codes(events))
    top = most_frequent(codes, common)
    coded = spark.sparkContext.broadcast((Lookup(top.column(0).to_numpy()), top.column(2).to_numpy()))
    end = np.array([texts > 0, base(np.array([float(texts)]))[0]], float)
    full = docs.select("doc_id", "train", *[F.lit(0).cast(t).alias(c) for c, t in (("uid", "long"), ("n_tokens", "long"), ("k", "double"), ("b", "double"), ("s", "double"))], *[F.array().cast("array<long>").alias(c) for c in ("h", "n", "e")]).schema

    def each_text(batches):
        lookup, *values = table.value
        symbols, code = coded.value
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low, high, texts in texts_of(batch.column(2)):
                size, rows, words = high - low, texts.rows, texts.words()
                row = np.repeat(np.arange(size), np.diff(rows))
                at = lookup.find(words)
                hit = at >= 0
                right, cost = predicted(words, rows)
                sums = [np.bincount(row[hit], weights=v[at[hit]], minlength=size) + e for v, e in zip(values, end, strict=True)]
                skip = np.zeros(len(texts.text) + 1, np.int8)
                skip[texts.starts[right]] += 1
                skip[texts.ends[right] + 1] -= 1
                skip = np.cumsum(skip, dtype=np.int8).view(bool)
                rare, whose = [], []
                for a, b in texts.windows():
                    event, take = texts.events(a, b)
                    take &= ~skip[a:b]
                    event, own = event[take], texts.row_of(a, b)[take]
                    at = symbols.find(event)
                    there = at >= 0
                    cost += np.bincount(own[there], weights=code[at[there]], minlength=size)
                    rare.append(event[~there])
                    whose.append(own[~there])
                r, w = row[~hit], words[~hit]
                order = np.lexsort((w, r))
                r, w = r[order], w[order]
                first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (w[1:] != w[:-1]))) if len(r) else r
                times = np.diff(np.append(first, len(r)))
                cuts = lambda x: pa.array(np.searchsorted(x, np.arange(size + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts(x), pa.array(v)) for x, v in ((r[first], w[first]), (r[first], times.astype(np.int64)), (np.concatenate(whose), np.concatenate(rare)))]
                part = batch.slice(low, size)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(uid + np.arange(size)), pa.array(np.diff(rows) + 1), *(pa.array(x) for x in (*sums, cost)), *lists], names=full.names)
                uid += size

    rows = stage(docs.select("doc_id", "train", "text").mapInArrow(each_text, full))
    worth = F.log10((F.col("n") + 0.1) / (tokens + 0.1 * (kinds + 1)))
    based = words.select(F.col("key").alias("h"), (F.col("n") > 0).alias("known"), worth.alias("base"))
    rest = rows.select("uid", F.explode(F.arrays_zip("h", "n")).alias("x")).select("uid", "x.h", "x.n")
    rest = rest.join(based, "h").groupBy("uid").agg(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("k2"), F.sum(F.col("base") * F.col("n")).alias("b2"))
    rare = rows.select("uid", F.explode("e").alias("key")).join(codes.select("key", "code"), "key").groupBy("uid").agg(F.sum("code").alias("s2"))
    more = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return rows.join(rest, "uid", "left").join(rare, "uid", "left").select("doc_id", "train", "n_tokens", more("k", "k2").cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), more("b", "b2").alias("base_score"), more("s", "s2").alias("score"))
