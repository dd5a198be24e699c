"""Operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import collections
import gzip
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.llm import ann, common, fingerprints, html_extract, language_id, mixing, near_dups, packing, ppm, queries, token_counts, warc

RNG = random.Random(5)
WORDS = ["the", "Of", "and", "Überfluß", "naïve", "x1", "日本", "end."]
ODD = [None, "", " ", "\t\n", "one", "One two", "a" * 70_000, "word " * 30_000, "same text here as there", "same text here as there", "▁ a  b ", "<s> <|endoftext|> x", "  lead", "trail  "]


def texts(n: int = 40) -> list:
    return ODD + [" ".join(RNG.choice(WORDS) + str(RNG.randrange(40)) for _ in range(RNG.randrange(1, 60))) for _ in range(n)]


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k: int) -> set:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, RNG.choice(["en", "de", None]), RNG.choice(["s1", "s2", "S", None])) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, lang string, source string").withColumn("score", F.lit(1)).withColumn("n", F.lit("clash"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_hashed_words_are_the_words():
    t = texts()
    data, offsets = common.text_bytes(pa.array(t, pa.string()))
    hashes, starts, ends, rows = common.hashed_words(data, offsets)
    want = [words(x) for x in t]
    assert np.diff(rows).tolist() == [len(w) for w in want]
    by = collections.defaultdict(set)
    for w, h in zip([w for x in want for w in x], hashes.tolist(), strict=True):
        by[w].add(h)
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


def test_fingerprints(docs, none):
    t = texts()
    found = fingerprints.sketches(pa.array(t, pa.large_string()))
    for a in range(0, len(t), 5):
        for b in range(0, len(t), 7):
            if shingles(t[a], 5) == shingles(t[b], 5):
                assert found[a].tolist() == found[b].tolist()
    longer = " ".join(f"w{i}" for i in range(4000))
    part = " ".join(f"w{i}" for i in range(1000, 2000))
    x, y = fingerprints.sketches(pa.array([longer, part]))
    assert fingerprints.containment(x, y) > 0.95 and fingerprints.from_text(fingerprints.as_text(x)).tolist() == x.tolist()
    assert fingerprints.merge(x, y).tolist() == np.union1d(x, y).tolist()
    assert fingerprints.containment(x[:0], x[:0]) == 1 and fingerprints.containment(x, x[:0]) == 0
    assert fingerprints.fingerprint(docs).count() == docs.count() and fingerprints.fingerprint(none).count() == 0

    def pairs(ids, texts):
        return pa.record_batch([pa.array(ids[:-1], pa.int64()), pa.array(ids[1:], pa.int64())], ["a", "b"])

    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["a"]: r["b"] for r in fingerprints.with_next(rows, pairs, "a long, b long").collect()}
    ids = sorted((r["doc_id"] for r in rows.collect()), reverse=True)
    assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))
    assert fingerprints.with_next(none, pairs, "a long, b long").count() == 0
    assert fingerprints.with_next(docs, pairs, "a long, b long").count() == docs.count()


def write_documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_fingerprint_query_by_brute_force(spark, tmp_path):
    base = [" ".join(f"w{RNG.randrange(300)}" for _ in range(RNG.choice([3, 9, 40, 70, 400]))) for _ in range(40)]
    made = [*ODD, *base, base[3] + " " + base[4], " ".join(base)]
    ids = [*range(20), *((1 << 60) + i for i in range(len(made) - 24)), -5, -(1 << 62), (1 << 63) - 1, -(1 << 63)]
    RNG.shuffle(ids)
    path = write_documents(spark, tmp_path, [(i, t, None, None) for i, t in zip(ids, made, strict=True)])
    got = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, path).collect()}
    by = dict(zip(ids, [t or "" for t in made], strict=True))
    order = sorted(ids, reverse=True)

    def hashes(text):
        return {int(fingerprints.sketches(pa.array([" ".join(x)]), 1)[0][0]) for x in shingles(text, 5)}

    def sketch(text):
        every = hashes(text)
        low = {h for h in every if h <= (1 << 64) // fingerprints.SCALE - 1}
        return every if len(every) <= fingerprints.WHOLE or not low else low

    def likeness(a, b):
        if not a or not b:
            return float(a == b)
        low = lambda x: {h for h in x if h <= (1 << 64) // fingerprints.SCALE - 1}
        if low(a) == a or low(b) == b:
            a, b = low(a), low(b)
        return len(a & b) / min(len(a), len(b)) if a and b else 0.0

    text = lambda x: "".join(f"{h:016x}" for h in sorted(x))
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        t, n = by[i], by[after]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got.pop(i)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == text(sketch(t)) and r["edited_fingerprint"] == text(sketch(edited))
        assert (r["near_edited"], r["near_next"]) == (likeness(sketch(t), sketch(edited)), likeness(sketch(t), sketch(n)))
    assert not got


def test_a_short_text_is_found_in_a_long_one():
    long = [f"w{i}" for i in range(3009)]
    parts = [" ".join(long[9 * i : 9 * i + 9]) for i in range(334)]
    whole, *each = fingerprints.sketches(pa.array([" ".join(long), *parts]))
    near = [fingerprints.containment(whole, x) for x in each]
    assert {x for x in near if x is not None} == {1.0} and sum(x is not None for x in near) > 100


def test_warc_round_trip(spark, tmp_path):
    long = "x" * 150
    pages = [(1, "http://a/b c\r\nX: y", long), (2, "http://a/2", long), (3, None, None), (4, "http://a/4", "short\r\n\r\nWARC/1.1\r\n"), (5, "http://a/5", "short"), (5, "http://a/5", "short"), (0, "http://a/0", "é" * 90)]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r["metadata"]["page_id"]: r for r in warc.captures(spark, str(tmp_path / "w")).collect()}
    assert warc.captures(spark, str(tmp_path / "w")).count() == len(pages)
    for i, _, body in pages:
        r, raw = got[str(i)], (body or "").encode()
        at = r["original"] or r["capture"]
        assert (at["payload_bytes"], at["payload_sha256"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert r["capture"]["record_type"] == ("revisit" if i == 2 else "response") and len(r["requests"]) == 1
        if i != 2:
            assert bytes(r["capture"]["payload"]) == raw
    assert got["2"]["original"]["metadata"]["page_id"] == "1"


def test_warc_reads_broken_archives():
    good = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    for size in (1, 7, 1000):
        read = lambda data: [b for _, _, b in warc.parse(data[i : i + size] for i in range(0, len(data), size))]  # noqa: B023, E731
        assert read(good + b"WARC/1.0\r\nContent-Length: x\r\n\r\n" + good) == [b"ok", b"ok"]
        assert read(good + b"WARC/1.0\r\nContent-Length: 99\r\n\r\nab\r\n\r\n" + good) == [b"ok", b"ok"]
        assert read(b"") == read(b"x" * 50) == []
        assert [p for p, _, _ in warc.parse([good, good])] == [0, len(good) - 4]
    members = gzip.compress(good) + gzip.compress(good * 3)
    assert [b for _, _, b in warc.parse(warc.inflated(members, 5))] == [b"ok"] * 4
    assert [b for _, _, b in warc.parse(warc.inflated(members[:-30]))][:1] == [b"ok"]


def test_warc_assembly(spark):
    def record(name, kind, *to):
        return (name, kind, list(to), None, "u", "d", None, None, None, 1, "s", {"f": name or ""} if kind == "metadata" else {}, "a", next(count), b"x")

    count = itertools.count()
    found = [record("c1", "response"), record("c2", "resource", "r9"), record("r1", "request", "a-missing", "c1"), record("r2", "request", "c1", "c2"), record("m1", "metadata", "r1"), record("r9", "request")]
    found += [record(f"x{i}", "other", f"x{i + 1}") for i in range(6)] + [record("x6", "other", "c2"), record("y1", "request", "y2"), record("y2", "other", "y1"), record("lost", "metadata", "no-such")]
    found += [record(None, "request"), record(None, "request"), record("t", None, "c1"), record(None, None, "c2"), record("c1", "response")]
    got = warc.assemble(spark.createDataFrame(found, warc.RECORD)).collect()
    rows = [(r["capture_id"], r["capture"] is not None, [x["record_id"] for x in r["requests"]], [x["record_id"] for x in r["others"]], (r["metadata"] or {}).get("f")) for r in got]
    one = ("c1", True, ["r1", "r2"], ["m1", "t"], "m1")
    assert sorted(map(repr, rows)) == sorted(map(repr, [
        one, one, ("c2", True, ["r2", "r9"], [None, *(f"x{i}" for i in range(7))], None),
        ("y1", False, [], ["y2"], None), ("y2", False, ["y1"], [], None), ("no-such", False, [], ["lost"], "lost"),
        ("a|16", False, [None], [], None), ("a|17", False, [None], [], None),
    ]))
    assert warc.assemble(spark.createDataFrame([], warc.RECORD)).count() == 0


def test_warc_odd_pages(spark, tmp_path):
    schema = "page_id long, url string, html string, body string, key string"
    pages = [(None, "http://a/", "p" * 120, "", ""), (None, None, None, "", ""), (3, "http://a/3", "p" * 120, "", ""), (4, "http://a/4", "é" * 3_000_000, "", "")]
    warc.write(spark.createDataFrame(pages, schema), str(tmp_path / "w"))
    got = warc.captures(spark, str(tmp_path / "w")).collect()
    assert sorted((r["metadata"]["page_id"], r["capture"]["record_type"], (r["original"] or r["capture"])["payload_bytes"]) for r in got) == [("", "response", 0), ("", "revisit", 120), ("3", "response", 120), ("4", "response", 6_000_000)]
    warc.write(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert warc.captures(spark, str(tmp_path / "none")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(300)] + [(300, None), (301, [0.0] * 24), (302, [float("nan")] * 24), (303, [None] * 24), (None, [1.0] * 24), (304, []), (305, [1.0, 2.0]), (306, rng.normal(size=24).tolist())]
    rows[7] = (7, rows[50][1])
    got = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v and len(v) == 24 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    hits = 0
    for q in [i for i in fine if i % 50 == 0]:
        cos = {i: float(fine[q] @ v / np.linalg.norm(fine[q]) / np.linalg.norm(v)) for i, v in fine.items() if i != q}
        want = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        assert len(got[q]) == 5 and all(abs(s - cos[i]) < 1e-12 for i, s in got[q])
        hits += len({i for i, _ in got[q]} & set(want))
    assert hits >= 0.9 * 5 * len(got)
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).count() == 0


ARTICLE = "".join(f"<p>Paragraph {i}, with some words, and more of them &amp; an end.</p>" for i in range(5))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain  text &lt;b&gt;", "plain text <b>"),
        (f"<body><nav><a href=/>Menu</a></nav><header>Site</header><div class='ad'>Buy</div><article><h1>T</h1>{ARTICLE}<div class=comments><p>Nice, I think, so nice, really nice.</p></div></article><aside>Side</aside><form>F</form><footer>End</footer>", None),
        (f"<div id=sidebar><p>{'Side text, many commas, here, there. ' * 20}</p></div><div class=content><h2>T</h2>{ARTICLE}<script>var x = '</p>';</script></div><div class=cookie-notice>We use cookies</div>", None),
        (f"<div class='has-sidebar'><div><h1>T</h1>{ARTICLE}", None),
    ],
)
def test_main_text(page, want):
    got = html_extract.extract(page)
    if want is None:
        assert re.sub("^T ", "", got) == " ".join(f"Paragraph {i}, with some words, and more of them & an end." for i in range(5))
    else:
        assert got == want


def test_main_text_is_linear_in_depth(spark):
    assert html_extract.extract("<div>" * 20_000 + "deep text, that is here, in full, to be read" + "</div>" * 20_000).startswith("deep text")
    pages = spark.createDataFrame([(1, "u", "<p>x"), (2, None, None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()} == {1: "x", 2: ""}


def test_token_counts(docs, none):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in docs.collect())
    for entries in (4, 65_536):
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, entries=entries).collect()) == want
    assert token_counts.count_tokens(none).count() == 0


def test_ppm(docs, none):
    rows = docs.select("doc_id", "text", (F.col("doc_id") % 4 != 0).alias("t")).withColumn("train", F.coalesce("t", F.lit(False)))
    plain = [(r["text"], r["train"]) for r in rows.collect()]
    counts = collections.Counter(w for t, train in plain if train for w in [*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), "\n"]), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), "\n"]), 6)) for t, _ in plain)
    for frequent in (10, 1 << 18):
        got = ppm.score(rows, frequent=frequent).collect()
        assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert ppm.score(none.withColumn("train", F.lit(True))).count() == 0


def ppm_entries(plain):
    """Counts of (context, symbol) for all contexts of up to ORDER bytes, from the texts for training."""
    out = collections.defaultdict(collections.Counter)
    for t, train in plain:
        s = ppm_symbols(t)
        for i in range(1, len(s) if train else 0):
            for k in range(min(i, ppm.ORDER) + 1):
                out[s[i - k : i]][s[i]] += 1
    return out


def ppm_symbols(t) -> bytes:
    return " ".join(["", *words(t), ""]).encode() + b"\n" if words(t) else b" \n"


def ppm_coded(trie, context: bytes, symbol: int) -> float:
    """log10 of a symbol's probability: escapes by single symbols, exclusion of what longer contexts hold."""
    out, gone = 0.0, set()
    for k in range(min(len(context), ppm.ORDER), -1, -1):
        held = trie.get(context[len(context) - k :])
        if held is None:
            continue
        open_ = {s: n for s, n in held.items() if s not in gone}
        if open_:
            escape = ppm.NEW + ppm.SINGLE * sum(n == 1 for n in held.values())
            total = sum(open_.values()) + escape
            if symbol in open_:
                return out + math.log10(open_[symbol] / total)
            out += math.log10(escape / total)
        gone = set(held)
    return out - math.log10(max(1, 256 - len(gone)))


def ppm_brute(plain):
    """Scores by a trie of dictionaries, symbol by symbol, and the prediction of repeats, token by token."""
    trie, out = ppm_entries(plain), []
    for t, _ in plain:
        s, w, total, at = ppm_symbols(t), words(t), 0.0, 1
        last, tried, good = {}, 0, 0
        for i, word in enumerate([*(x.encode() + b" " for x in w), b"\n"]):
            key, right = tuple(w[i - ppm.BACK : i]) if ppm.BACK <= i < len(w) else None, False
            if key in last and key:
                right = last[key] == w[i]
                total += math.log10((good + ppm.HELD if right else tried - good + ppm.FAILED) / (tried + ppm.HELD + ppm.FAILED))
                tried, good = tried + 1, good + right
            if key:
                last[key] = w[i]
            if not right:
                total += sum(ppm_coded(trie, s[max(0, j - ppm.ORDER) : j], s[j]) for j in range(at, at + len(word)))
            at += len(word)
        out.append(total)
    return out


def test_ppm_probabilities_sum_to_one():
    trie = ppm_entries([("abc abd b abcabc", True)])
    event = np.array([ppm._entry(len(c), np.array([sum(x << (8 * i) for i, x in enumerate(c[::-1]))]), np.array([s]))[0] for c in trie for s in trie[c]])
    n = np.array([x for c in trie.values() for x in c.values()])
    made = ppm.trie_of(event, n)
    for text in (b" ", b" a", b" ab", b" zz"):
        context = sum(x << (8 * i) for i, x in enumerate(text[::-1]))
        got = made.log10(np.arange(256), np.full(256, context), np.full(256, len(text)))
        assert abs((10**got).sum() - 1) < 1e-9
        assert got == pytest.approx([ppm_coded(trie, text, s) for s in range(256)])


def test_ppm_is_the_brute_force_model(spark):
    rng = random.Random(3)
    plain = [(t, i % 3 != 0) for i, t in enumerate(ODD)] + [(" ".join(f"{rng.choice(WORDS)}{rng.randrange(9 if i % 2 else 900)}" for _ in range(50)), i % 4 != 0) for i in range(50)]
    rows = spark.createDataFrame([(i, t, train) for i, (t, train) in enumerate(plain)], "doc_id long, text string, train boolean")
    want = ppm_brute(plain)
    for common in (5, 200, 1 << 21):
        assert [r["score"] for r in ppm.score(rows, common=common).orderBy("doc_id").collect()] == pytest.approx(want, rel=1e-9)


def test_ppm_windows_and_tallies_change_nothing(monkeypatch):
    column = pa.array(texts())
    whole = [(t.events(0, len(t.text)), t.words()) for _, _, t in ppm.texts_of(column)]
    monkeypatch.setattr(ppm, "WINDOW", 50)
    small = [([t.events(a, b) for a, b in t.windows()], t.words()) for _, _, t in ppm.texts_of(column)]
    assert np.concatenate([e[c] for (e, c), _ in whole]).tolist() == np.concatenate([e[c] for x, _ in small for e, c in x]).tolist()
    assert np.concatenate([c for (_, c), _ in whole]).tolist() == np.concatenate([c for x, _ in small for _, c in x]).tolist()
    assert np.concatenate([w for _, w in whole]).tolist() == np.concatenate([w for _, w in small]).tolist()
    spelled = [w for t in column.to_pylist() for w in words(t)]
    got = np.concatenate([w for _, w in whole]).tolist()
    assert len(got) == len(spelled) and len(set(got)) == len(set(spelled)) == len(set(zip(got, spelled, strict=True)))
    tally = ppm.Tally()
    for part in ([3, 1, 3], [2, 3], []):
        tally.add(np.array(part, np.int64), 1)
    tally.add(np.array([9], np.int64), 0)
    assert [x.tolist() for x in tally.given()] == [[1, 2, 3, 9], [1, 1, 3, 0]]
    keys = np.random.default_rng(1).integers(-(1 << 60), 1 << 60, 5000)
    found = ppm.Lookup(keys).find(np.concatenate([keys[::-1], keys + 1]))
    assert found.tolist() == [*range(4999, -1, -1), *[-1] * 5000]


def test_ppm_word_order_counts(spark):
    plain = [("red fox runs far away", True)] * 20 + [("red fox runs far away", False), ("far red away runs fox", False)]
    rows = spark.createDataFrame([(i, t, train) for i, (t, train) in enumerate(plain)], "doc_id long, text string, train boolean")
    *_, known, mixed = [r["score"] for r in ppm.score(rows).orderBy("doc_id").collect()]
    assert known > mixed + 1


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, monkeypatch, size, num):
    monkeypatch.setattr(near_dups, "BLOCK", 1024 if size == 3 else 3)
    base = [[f"w{RNG.randrange(500)}" for _ in range(RNG.randrange(3, 120))] for _ in range(25)]
    rows = list(ODD)
    for b in base:
        for _ in range(RNG.randrange(1, 9)):
            c = list(b)
            for _ in range(RNG.randrange(4)):
                c[RNG.randrange(len(c))] = f"w{RNG.randrange(500)}"
            rows.append(" ".join(c))
    rows += rows[-3:]
    ids = list(range(len(rows)))
    RNG.shuffle(ids)
    sets, up = {i: shingles(t, size) for i, t in zip(ids, rows, strict=True)}, {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    docs = spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("row", F.lit(2))
    got = near_dups.linked(docs, size=size, num=num).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {i: (root(i), len(sets[i])) for i in ids}
    kept = near_dups.one_of_each(docs, size=size, num=num)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in ids if root(i) == i or not sets[i])
    assert near_dups.linked(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "rowwise"), [(1024, 32), (16, 2)])
def test_near_copies_too_far_apart(spark, monkeypatch, block, rowwise):
    """A crowd of near copies of one text, few of them linked: every pair in its long lists has to be looked at."""
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(near_dups, "ROWWISE", rowwise)
    rng, base, rows = random.Random(7), [f"w{i}" for i in range(200)], []
    # three of 198 shingles go for each other word: two documents are linked if they have five of those at most
    for i in range(2500 if block == 1024 else 150):
        c = list(base)
        for k in rng.sample(range(4, 200, 4), 2 if i % 10 == 3 else 7 + i % 3):
            c[k] = f"x{i}.{k}"
        rows.append((i, " ".join(c)))
    if len(rows) == 150:
        sets = [shingles(t, 3) for _, t in rows]
        assert all((100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])) == (i % 10 == j % 10 == 3) for i in range(150) for j in range(i))
    docs, began = spark.createDataFrame(rows, "doc_id long, text string"), time.time()
    got = {r["doc_id"]: r["component_id"] for r in near_dups.linked(docs, size=3, num=85).collect()}
    assert got == {i: 3 if i % 10 == 3 else i for i, _ in rows}
    assert time.time() - began < 90


def test_components_without_the_small_case(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "SMALL", -1)
    edges = [(f"{a:03d}".encode(), f"{a + 7:03d}".encode()) for a in range(60)]
    got = {bytes(r["node"]): bytes(r["root"]) for r in near_dups.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {f"{a:03d}".encode(): f"{a % 7:03d}".encode() for a in range(7, 67)}


def test_language_id(spark, docs, none):
    rows = [(i, " ".join(RNG.choice(["the", "and", "with", "that"] if i % 2 else ["der", "und", "mit", "das"]) for _ in range(20)), "en" if i % 2 else "de") for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(train)
    asked = spark.createDataFrame([(1, "with the that", 7), (2, "und das mit", 7), (3, None, 7), (4, "12 !? 34", 7), (5, "", 7), (6, "the " * 300_000, 7)], "doc_id long, text string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(asked, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"] and got[3][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(asked, language_id.fit(none)).collect()} == {"und"}


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, length=64).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 64
    want = collections.Counter()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want.update((r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len(by) <= 1.1 * sum(n * k for (_, _, _, n, _), k in want.items()) / 64 + 1
    assert packing.pack(none).count() == 0


def test_plan_fills_sequences():
    counts = {n: RNG.randrange(50) for n in range(1, 65)}
    slots, taken, room = packing.plan(counts, 64), collections.Counter(), collections.Counter()
    for n, low, high, each, first, _ in slots:
        taken[n] += high - low
        for r in range(high - low):
            room[first + r // each] += n
    assert taken == +collections.Counter(counts) and max(room.values()) <= 64
    assert len(room) <= 1.04 * max(sum(n * k for n, k in counts.items()) / 64, sum(k for n, k in counts.items() if n > 32)) + 1


def test_mixing(spark, docs, none):
    rows = [(i, " ".join(["w"] * RNG.randrange(0, 30)), RNG.choice(["a", "B", "c", None])) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, target, left = dict(zip(order, (5, 2, 1, 5), strict=True)), {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in target]
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = collections.Counter()
    by = {i: s for i, _, s in rows}
    for r in got:
        assert abs(r["target"] - target[by[r["doc_id"]]]) < 1e-6 and r["taken"] in (0, r["size"], 2 * r["size"]) and r["source_size"] == sizes[by[r["doc_id"]]]
        taken[by[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 15 for s in sizes)
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(none).count() == 0


@pytest.mark.parametrize("icon", ["<svg class='i' />", "<math/>", "<svg><svg><path d='M0'/></svg><text>no</text></svg>", "<svg><style/><title/></svg>", "<select><option>no</select>", "<object><object>no</object>no</object>"])
def test_main_text_around_icons(icon):
    text = "A sentence of the article, long enough to count, with its commas."
    page = f"<body><article><p>{text}</p>{icon}<p>{text}</p></article></body>"
    assert html_extract.extract(page) == f"{text} {text}"


def test_short_text_within_a_long_one():
    long = [f"v{i}" for i in range(3000)]
    short = [" ".join(long[i : i + n]) for i in range(0, 2000, 40) for n in (5, 10, 14, 20)]
    whole, *found = fingerprints.sketches(pa.array([" ".join(long), *short]))
    got = [fingerprints.containment(x, whole) for x in found]
    assert set(got) == {1.0, None} and got.count(1.0) > len(got) / 2
    assert all(fingerprints.merge(x, whole).tolist() == whole.tolist() for x in found)
    half, = fingerprints.sketches(pa.array([" ".join(long[:8] + ["x"] * 2)]))
    full, = fingerprints.sketches(pa.array([" ".join(long[:10])]))
    assert fingerprints.containment(half, full) == 4 / 6
