"""Languages, packing and the pipeline against brute force; empty tables, nulls, repeated rows and clashing column names everywhere."""

import collections
import importlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.llm import ann, html_extract, language_id, mixing, near_dups, packing, ppm, queries, token_counts, warc

RNG = random.Random(8)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("h", "key", "row", "length", "part", "rank", "piece", "uid", "k", "n", "th", "id", "v", "dim", "q", "score", "sha", "first", "nth", "body", "place", "range", "to", "lent", "copies", "size", "taken", "component_id", "lang_pred", "n_tokens", "__text", "__h", "s")
VOCABULARY = {"en": "the and with that from have this they water stone window", "de": "der und mit das von haben dieser sie wasser stein fenster", "fr": "le et avec que de avoir ce ils eau pierre fenêtre"}


def prose(lang: str, n: int) -> str:
    return " ".join(RNG.choice(VOCABULARY[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    made = []
    for i in range(90):
        lang = RNG.choice([*VOCABULARY])
        made.append((i, prose(lang, RNG.randrange(6, 80)), lang if RNG.random() < 0.9 else None, RNG.choice(["a", "b", None])))
    made += [(100, made[3][1], "en", "a"), (101, made[4][1] + " the end", "en", "b"), (102, None, "en", "a"), (103, "", None, None), (104, "12 34 !", "de", "a"), (105, "x" * 30_000, None, "b"), (None, prose("en", 30), "en", "a"), made[5], made[5]]
    return [(i, t, la, s, len(t or "")) for i, t, la, s in made]


def clashing(df):
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clashing(spark.createDataFrame(rows, SCHEMA))


# languages


def buckets(text: str, bits: int) -> list[int]:
    s = re.sub(r"[^\W\d_]|(.)", lambda m: m[0] if not m[1] else "\0", f" {text.lower()} ", flags=re.S)
    s = "".join(c if c.isalpha() else "\0" for c in s)
    s = re.sub("\0+", " ", s)
    out, mask = [], (1 << 64) - 1
    for i in range(len(s)):
        h = 0
        for k in (1, 2, 3):
            if i + k > len(s):
                break
            h = (h * 0x100000001B3 + ord(s[i + k - 1]) * 0x9E3779B97F4A7C15 + k) & mask
            out.append(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> (64 - bits))
    return out


def bayes(train, bits=15, alpha=0.1):
    """A function of a text with the language and its posterior."""
    counts, seen = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in train:
        if lang is not None:
            seen[lang] += 1
            counts[lang].update(buckets(text, bits) if text is not None else [])
    labels = sorted(seen)

    def tell(text):
        if text is None or not any(c.isalpha() for c in text) or not labels:
            return "und", 0.0
        own = collections.Counter(buckets(text, bits))
        total = [math.log(seen[la] / sum(seen.values())) + sum(n * (math.log(counts[la][b] + alpha) - math.log(sum(counts[la].values()) + alpha * (1 << bits))) for b, n in own.items()) for la in labels]
        best = max(range(len(labels)), key=lambda i: total[i])
        return labels[best], 1 / sum(math.exp(x - total[best]) for x in total)

    return tell


def test_languages_by_brute_force(docs, rows):
    train = docs.where("doc_id % 3 <> 0")
    tell = bayes([(t, la) for i, t, la, *_ in rows if i is not None and i % 3])
    got = language_id.identify(docs, language_id.fit(train), keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        pred, score = tell(r["text"])
        assert r["lang_pred"] == pred and r["score"] == pytest.approx(score, abs=1e-3)
    right = [(r["lang_pred"] == la) for r, la in zip(sorted((r for r in got if r["doc_id"] is not None and r["doc_id"] < 90), key=lambda r: (r["doc_id"], r["text"])), [la for i, t, la, *_ in sorted((x for x in rows if x[0] is not None and x[0] < 90), key=lambda x: (x[0], x[1]))], strict=True) if la]
    assert sum(right) >= 0.95 * len(right)


def test_language_ties_go_to_the_smallest_name(spark):
    twice = spark.createDataFrame([(1, "abc", "z"), (2, "abc", "a"), (2, "abc", "a"), (1, "abc", "z")], "doc_id long, text string, lang string")
    got = language_id.identify(twice, language_id.fit(twice)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("a", 0.5)} and len(got) == 4
    with pytest.raises(ValueError, match="labels"):
        language_id.fit(spark.range(language_id.MOST + 1).selectExpr("id as doc_id", "'x' as text", "cast(id as string) as lang"))


# packing


def test_ids_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing._encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    pool = [*range(32, 127), 9, 10, 13, 0xA0, 0xE9, 0x2019, 0x3042, 0x4E00, 0x1F600, 0x301, 0x200B, 0xFEFF, 0x85, 0x2028, 0x10FFFF, 0x0627, 0x1D7D8]
    special = ["<|endoftext|>", "'s", "'LL", "   ", "\n\n", "1234567", " \t "]
    for n in range(3000):
        text = "".join(RNG.choice(special) if RNG.random() < 0.1 else chr(RNG.choice(pool) if RNG.random() < 0.8 else RNG.choice([*range(1, 0xD800), *range(0xE000, 0x11000)])) for _ in range(RNG.randrange(40 if n % 2 else 12)))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


# odd tables


@pytest.mark.parametrize("f", [token_counts.count_tokens, near_dups.linked, packing.pack, mixing.mix], ids=["tokens", "near", "packing", "mixing"])
def test_clashing_columns(docs, rows, f):
    got = f(docs)
    if f is packing.pack:
        assert got.select("doc_id").distinct().count() == len({r[0] for r in rows})
    else:
        assert got.count() == len(rows)


def test_clashing_columns_of_scores_and_searches(spark, docs, rows):
    assert ppm.score(docs.withColumn("train", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)))).count() == len(rows)
    vectors = clashing(spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(60)], "vec_id long, embedding array<float>"))
    assert ann.search(vectors, F.col("id") % 50 == 0).count() == 10


def test_odd_pages(spark, tmp_path):
    pages = clashing(spark.createDataFrame([(1, "u", "<p>One text, to be read.</p>"), (1, "u", "<p>One text, to be read.</p>"), (2, None, "<p>" + "word, " * 200_000), (None, "u", None)], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("__markup", F.lit(1)))
    got = html_extract.extract_pages(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 21), (1, 21), (2, 6 * 200_000 - 1)]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
    warc.write(pages.drop("text"), str(tmp_path / "w"))
    assert warc.captures(spark, str(tmp_path / "w"), payload=False).count() == 4


# the pipeline


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text) -> set:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_pipeline_by_brute_force(spark, docs, rows):
    p = importlib.import_module("corpus_pipeline")
    names = docs.columns
    crc = lambda i: __import__("zlib").crc32(("" if i is None else str(i)).encode())
    tell = bayes([(t, la) for i, t, la, *_ in rows if crc(i) % 5])
    one = p.languages(spark, docs, "")
    assert one.columns == names
    left = [r for r in rows if tell(r[1])[0] != "und" and tell(r[1])[1] > 0.5]
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["source"]) for r in one.collect()))) == sorted(map(repr, ((r[0], r[1], r[3]) for r in left)))
    two = p.near_duplicates(spark, one, "")
    assert two.columns == names
    groups = []
    for r in left:
        s = shingles(r[1])
        near = [g for g in groups if s and any(5 * len(s & t) >= 4 * len(s | t) for _, t in g)]
        groups = [g for g in groups if g not in near] + [[(r, s), *(x for g in near for x in g)]]
    kept = [min((r for r, _ in g), key=lambda r: (r[0] is None, r[0] or 0)) for g in groups]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in two.collect()))) == sorted(map(repr, ((r[0], r[1]) for r in kept)))
    three = p.mixed(spark, two, "")
    assert three.columns == names
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([r[0] for r in kept], pa.int64()), "text": pa.array([r[1] for r in kept]), "source": pa.array([r[3] for r in kept])}))
    want = collections.Counter({i: n for i, n in c.execute(f"select doc_id, copies from ({queries.ORACLES['op10_mixing']})").fetchall()})
    assert collections.Counter(r["doc_id"] for r in three.collect()) == +want
    four = p.packed(spark, three, "").collect()
    held = collections.defaultdict(list)
    for r in four:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 1024 for x in held.values())
    assert collections.Counter(r["doc_id"] for r in four if r["piece"] == 0) == +want


def test_pipeline_of_nothing(spark, docs):
    p = importlib.import_module("corpus_pipeline")
    none = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, "").count() == 0
    assert p.languages(spark, docs.where("text is null or text = ''"), "").count() == 0
    assert np.array_equal(sorted(x for x, _ in p.STAGES), sorted(["languages", "near duplicates", "mixing", "packing"]))
