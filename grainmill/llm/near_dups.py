"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

Each document's signature has `COORDS` minimum hashes of its shingle set. A pair at or above the similarity matches in
at least T coordinates but for one case in a million (T from the binomial tail), so it shares a posting list among the
COORDS - T + 1 rarest coordinate-value pairs of either: only those (the prefix) are posted, and values that a single
document has need no list. Collisions of a pair are counted on the packed signatures in the first list that both
prefixes share, and skipped in all others; pairs below T go, as do those whose sets must differ in too many shingles
(their odd sketches, a parity bit for each hash bucket, differ in no more bits than the sets in shingles). The rest is
confirmed on the full shingle sets.

Equal sets are one class from the start. Lists are worked through in rounds: in each, the next documents of a list
(about 2, then sixteen times as many each further time; in one order for all lists) meet those documents of the
list that no confirmed links join to them yet. So a group of thousands of near copies costs a star or two, not all its
pairs, and still no link that would join two components is lost: pairs that are skipped are joined already. A list lies
in blocks of about `BLOCK` documents, which go to tasks of their own, and so do the pairs of a block and the documents
it meets: no list is one task's work. Documents beyond the first `ROWWISE` of a list meet it a block at a time, in
arrays: near copies of one text that are too far from each other are never joined, so all their pairs are counted.
Components are found with alternating stars (a bounded number of links by union in one task).

Defined results: texts without words (null, empty, white space) have an empty set and are linked with nothing; shorter
texts than a shingle are one shingle; repeated rows are linked like any equal sets; the component id is the smallest
non-null id, null if all are null; rows with equal ids and texts have equal results.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

from .common import hashed_shingles, hashed_words, row_chunks, stage, text_bytes

COORDS, LANES, LANE_BITS = 64, 4, 15
_WORDS = COORDS // LANES
#: Up to so many links are joined in one task, and so many wanted documents are told to all tasks; more go by shuffles.
SMALL = 200_000
#: Documents in a block of a posting list.
BLOCK = 1024
#: So many documents of a list meet the others by a join of rows, the rest by arrays.
ROWWISE = 32
#: Bits of an odd sketch.
ODD = 1024
_ONES = sum(((1 << (LANE_BITS - 1)) - 1) << (LANE_BITS * i) for i in range(LANES))
_TOPS = sum(1 << (LANE_BITS * i + LANE_BITS - 1) for i in range(LANES))
_RNG = np.random.default_rng(20240)
_MUL = _RNG.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def least_matches(similarity: float, miss: float = 1e-6) -> int:
    """The largest T that a pair of this similarity falls short of with a probability of at most `miss`."""
    below = 0.0
    for t in range(COORDS + 1):
        below += math.comb(COORDS, t) * similarity**t * (1 - similarity) ** (COORDS - t)
        if below > miss:
            return t
    return COORDS


def _row_sets(column: pa.Array, size: int):
    """For each chunk of rows: first row, sorted distinct shingle hashes of all rows, and where each row's begin."""
    data, offsets = text_bytes(column)
    for low, high in row_chunks(offsets, 1 << 20):
        words, _, _, rows = hashed_words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        shingles, begin = hashed_shingles(words, rows, size)
        parts = [np.unique(shingles[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        yield low, np.concatenate(parts) if parts else shingles, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, th, n_shingles, key (of the set; null if empty), tokens (a hash of each coordinate and its value), packed (the signature in lanes)."""
    schema = docs.select("doc_id", "th").schema.add("n_shingles", "long").add("key", "binary").add("tokens", ArrayType(LongType())).add("packed", ArrayType(LongType())).add("odd", ArrayType(LongType()))

    def run(batches):
        for batch in batches:
            for low, sets, begin in _row_sets(batch.column(2), size):
                n = np.diff(begin)
                full = np.flatnonzero(n)
                values = np.zeros((len(n), COORDS), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(COORDS):
                        h = sets * _MUL[k] + _ADD[k]
                        h ^= h >> np.uint64(32)
                        if len(full):
                            values[full, k] = np.minimum.reduceat(h * _MUL[k - 1], begin[:-1][full])
                    tokens = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(COORDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                lanes = (tokens >> np.uint64(65 - LANE_BITS)).astype(np.int64).reshape(len(n), _WORDS, LANES) << (LANE_BITS * np.arange(LANES))
                packed = lanes.sum(2)
                # parity of the shingles in each of ODD buckets, some rows at a time
                odd = np.zeros((len(n), ODD // 64), np.int64)
                bucket = (sets >> np.uint64(20)).astype(np.int64) & (ODD - 1)
                for at in range(0, len(n), 1024):
                    rows = n[at : at + 1024]
                    own = np.repeat(np.arange(len(rows)), rows) * ODD + bucket[begin[at] : begin[at + len(rows)]]
                    odd[at : at + 1024] = np.packbits(np.bincount(own, minlength=len(rows) * ODD).reshape(len(rows), ODD) & 1, axis=1).view(np.int64)
                raw = sets.tobytes()
                key = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                part = batch.slice(low, len(n))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(key, pa.binary()), lists(tokens.view(np.int64)), lists(packed), lists(odd)], names=schema.names)

    return docs.select("doc_id", "th", "text").mapInArrow(run, schema)


def _matches(a: str, b: str) -> Column:
    """In how many coordinates two packed signatures agree."""
    lane = lambda i: F.bit_count((F.col(a)[i].bitwiseXOR(F.col(b)[i]) + F.lit(_ONES)).bitwiseAND(F.lit(_TOPS)))
    differ = lane(0)
    for i in range(1, _WORDS):
        differ = differ + lane(i)
    return F.lit(COORDS) - differ


def _differ(a: str, b: str) -> Column:
    """In how many shingles two sets differ at least."""
    out = F.lit(0)
    for i in range(ODD // 64):
        out = out + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return out


def _meeting(least: int, num: int, den: int):
    """A function of a block of a list and of the hubs it meets: pairs (a, b) that may be alike enough, each in the first list that both share."""
    lanes = lambda table, name: np.ascontiguousarray(table.column(name).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), -1).T)
    halves = lambda table, name: np.frombuffer(b"".join(table.column(name).to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
    count = lambda x: np.bitwise_count(x).sum(0, dtype=np.int64)

    def run(now: pa.Table, hubs: pa.Table) -> pa.Table:
        a, b = [], []
        if len(now) and len(hubs):
            now = now.sort_by([("hash", "ascending"), ("key", "ascending")])
            token, n, place, keys = now.column("token")[0].as_py(), now.column("n").to_numpy(), now.column("hash").to_numpy(), now.column("key").to_pylist()
            odd, packed, root, prefix = lanes(now, "odd"), lanes(now, "packed"), halves(now, "root"), now.column("prefix")
            h_odd, h_packed, h_root = lanes(hubs, "h_odd"), lanes(hubs, "h_packed"), halves(hubs, "h_root")
            for i, (key, h_n, h_place) in enumerate(zip(*(hubs.column(f"h_{c}").to_pylist() for c in ("key", "n", "hash")), strict=True)):
                low = int(np.searchsorted(place, h_place))
                while low < len(place) and place[low] == h_place and keys[low] <= key:
                    low += 1
                m = n[low:]
                fits = (m * den >= h_n * num) & (h_n * den >= m * num) & (root[low:] != h_root[i]).any(1)
                at = np.flatnonzero(fits & (count(odd[:, low:] ^ h_odd[:, i, None]) * (den + num) <= (m + h_n) * (den - num))) + low
                if len(at):
                    at = at[COORDS - count((packed[:, at] ^ h_packed[:, i, None]) + np.uint64(_ONES) & np.uint64(_TOPS)) >= least]
                    own = set(hubs.column("h_prefix")[i].as_py())
                    found = [keys[j] for j in at.tolist() if min(own.intersection(prefix[j].as_py())) == token]
                    a += [key] * len(found)
                    b += found
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _joined(batches):
    """Union by smaller root, for a bounded number of links."""
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            up.setdefault(low, low)
            up[high] = low
    nodes = [x for x in up if root(x) != x]
    for i in range(0, len(nodes), 10_000):
        part = nodes[i : i + 10_000]
        yield pa.record_batch([pa.array(part, pa.binary()), pa.array([root(x) for x in part], pa.binary())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) for the nodes of these edges (a, b), by alternating large and small stars, or in one task if there are few."""
    fingerprint = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    edges = stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = fingerprint(edges)
    if before[0] <= SMALL:
        return edges.coalesce(1).mapInArrow(_joined, "node binary, root binary")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        after = fingerprint(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are alike enough."""
    left, right = sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), sets.select(F.col("key").alias("b"), F.col("set").alias("sb"))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(den * same >= num * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a binary, b binary")


def linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, component_id, first_th for each row; (component_id, first_th) are the doc_id and th of the one row that stands for the component."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    signed = stage(signatures(rows, size))
    least = least_matches(num / den)
    prefix = COORDS - least + 1
    head = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "th"))
    classes = stage(signed.where("key is not null").groupBy("key").agg(head.alias("head"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.first("packed").alias("packed"), F.first("odd").alias("odd")))
    # posting lists of the prefixes
    tokens = classes.select("key", F.explode("tokens").alias("token"))
    shared = stage(tokens.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1"))
    posts = tokens.join(shared, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("found"))  # COORDS at most
    posts = posts.withColumn("prefix", F.expr(f"transform(slice(found, 1, greatest(0, {prefix} - ({COORDS} - size(found)))), x -> x.token)")).where("size(prefix) > 0")
    posted = stage(posts.select("key", "prefix").join(classes.select("key", "n", "packed", "odd"), "key"))
    # a list is ordered by a hash of the key; a document's place in it is as far on as its hash is among all hashes
    posts = posted.select("key", F.explode("prefix").alias("token"))
    sizes = posts.groupBy("token").agg(F.count("*").alias("of")).where("of > 1")
    lists = posts.join(sizes, "token").join(posted, "key").withColumn("hash", F.xxhash64("key"))
    lists = lists.withColumn("at", F.least(F.col("of") - 1, F.floor((F.col("hash") / float(1 << 64) + 0.5) * F.col("of")))).withColumn("block", F.floor(F.col("at") / BLOCK).cast("int"))
    lists = stage(lists)
    # the documents that may need confirming, and their sets
    wanted = lists.select("key").distinct().join(classes.select("key", "head.doc_id", "head.th"), "key").select("key", F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"))
    wanted = stage(wanted)
    wanted = F.broadcast(wanted) if wanted.count() <= SMALL else wanted

    def full(batches):
        for batch in batches:
            for low, sets, begin in _row_sets(batch.column(1), size):
                raw = sets.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(begin) - 1), pa.array([raw[8 * a : 8 * b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())], names=["key", "set"])

    chosen = rows.join(wanted, (F.col("th") == F.col("w_th")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("key", "text")
    sets = stage(chosen.mapInArrow(full, "key binary, set binary").groupBy("key").agg(F.first("set").alias("set")))
    # rounds
    longest = lists.agg(F.max("of").alias("n")).first()["n"] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = lambda rows: F.broadcast(rows) if rows.count() <= SMALL else rows
    links, roots, low, high = None, None, 0, 2
    while low < longest:
        now = lists.where(F.col("of") > low)
        if roots is not None:
            now = stage(now.join(told(roots), F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node"))
            mixed = stage(now.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token"))
            now = now.join(told(mixed), "token", "left_semi")
        else:
            now = now.withColumn("root", F.col("key"))
        # a document meets its own block of the list and all after it, block by block
        hubs = now.where((F.col("at") >= low) & (F.col("at") < high)).withColumn("to", F.explode(F.sequence("block", F.floor((F.col("of") - 1) / BLOCK).cast("int"))))
        ahead = F.explode(F.sequence(F.lit(low // BLOCK), F.least(F.col("block"), F.lit((high - 1) // BLOCK)))) if high > BLOCK else F.lit(0)
        now = now.where(F.col("block") >= low // BLOCK).withColumn("of_block", ahead)
        hubs = hubs.select("to", F.col("block").alias("h_block"), *[F.col(c).alias(f"h_{c}") for c in ("token", "key", "n", "packed", "odd", "prefix", "root", "hash")])
        now, hubs = now.repartition(tasks, "token", "block", "of_block"), hubs.repartition(tasks, "h_token", "to", "h_block")
        alike = (F.col("n") * den >= F.col("h_n") * num) & (F.col("h_n") * den >= F.col("n") * num) & (_differ("odd", "h_odd") * (den + num) <= (F.col("n") + F.col("h_n")) * (den - num)) & (_matches("packed", "h_packed") >= least)
        first = F.array_min(F.array_intersect("prefix", "h_prefix")) == F.col("token")
        after = (F.col("hash") > F.col("h_hash")) | (F.col("hash") == F.col("h_hash")) & (F.col("key") > F.col("h_key"))
        here = (F.col("token") == F.col("h_token")) & (F.col("block") == F.col("to")) & (F.col("of_block") == F.col("h_block")) & after & (F.col("root") != F.col("h_root"))
        if low < ROWWISE:
            met = now.join(hubs, here & alike & first).select(F.col("h_key").alias("a"), F.col("key").alias("b"))
        else:
            now = now.select("token", "block", "of_block", "key", "n", "packed", "odd", "prefix", "root", "hash")
            met = now.groupBy("token", "block", "of_block").cogroup(hubs.groupBy("h_token", "to", "h_block")).applyInArrow(_meeting(least, num, den), "a binary, b binary")
        good = stage(_confirmed(met, sets, num, den))
        if not good.isEmpty():
            links = good if roots is None else good.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = stage(components(links))
        low, high = high, 16 * high
    # results
    named = classes.select("key", "head")
    if roots is not None:
        named = named.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
        least_head = named.groupBy("root").agg(F.min("head").alias("top"))
        named = named.join(least_head, "root").select(F.col("key").alias("c_key"), "top")
    else:
        named = named.select(F.col("key").alias("c_key"), F.col("head").alias("top"))
    own = F.col("key").isNull()
    return signed.join(stage(named), F.col("key") == F.col("c_key"), "left").select("doc_id", "th", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"), F.when(own, F.col("th")).otherwise(F.col("top.th")).alias("first_th"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without all but one of each component; texts without words all stay."""
    marks = linked(docs, text, doc_id, size, num, den).where("n_shingles > 0").select("component_id", "first_th").distinct()
    names = docs.columns
    same = F.xxhash64(F.col(text))
    wordless = F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    rows = docs.where(~wordless).select(F.struct(*names).alias("row"), F.col(doc_id).alias("i"), same.alias("h"))
    kept = rows.join(marks, (F.col("h") == F.col("first_th")) & F.col("i").eqNullSafe(F.col("component_id")))
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("h", "i").orderBy("h"))).where("nth = 1")
    return kept.select("row.*").unionByName(docs.where(wordless))
