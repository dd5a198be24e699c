"""Topic classification: term lists and naive Bayes, trained and scored as joins and aggregates over tokens."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..sources.tables import settle


def term_lists(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, counts (term, n): each key's tokens with their counts, keys without tokens left out. They are counted within the row; only texts that share a key are shuffled."""
    own = lambda rows: rows.where(T.has_tokens(F.col(text))).select(key, T.counted(T.tokens(F.col(text))).alias("counts"))
    shared = settle(docs.groupBy(key).agg(F.count("*").alias("texts")).where("texts > 1").select(F.col(key).alias("__shared")))
    if shared.isEmpty():
        return own(docs)
    same = docs[key].eqNullSafe(shared["__shared"])
    each = own(docs.join(shared, same, "left_semi")).select(key, F.inline_outer("counts"))
    together = each.groupBy(key, "term").agg(F.sum("n").alias("n")).groupBy(key).agg(F.collect_list(F.struct("term", "n")).alias("counts"))
    return own(docs.join(shared, same, "left_anti")).unionByName(together)


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, n: each token of each text with its count."""
    return term_lists(docs, key, text).select(key, F.inline_outer("counts"))  # no list is empty, and a plan infers no filter that counts again


def _occurrences(joined: Column, words: list[str]) -> Column:
    """How often these words follow each other in tokens joined by spaces (with one at either end), overlaps counted: places from where they can be read on."""
    return F.coalesce(F.regexp_count(joined, F.lit(f"(?<= )(?={' '.join(words)} )")), F.lit(0))


@dataclass(frozen=True)
class Terms:
    """A weighted list of words and phrases; weights default to 1. A word counts once at its highest weight, a phrase as often as it is listed."""

    terms: tuple[str, ...]
    weights: tuple[tuple[str, float], ...] = ()

    def parts(self, spark: SparkSession) -> tuple[dict[str, float], list[tuple[list[str], float]]]:
        import regex

        given, single, phrases = dict(self.weights), {}, []
        for term in self.terms:
            weight = given.get(term, 1.0) if given.get(term, 1.0) > 0 else 1.0
            tokens = [t for t in regex.findall(r"[\p{L}\p{Nd}]+", term.lower()) if len(t) > 1]
            if len(tokens) == 1:
                single[tokens[0]] = max(weight, single.get(tokens[0], 0.0))
            elif tokens:
                phrases.append((tokens, weight))
        return single, phrases

    def score(self, text: Column, spark: SparkSession) -> Column:
        single, phrases = self.parts(spark)
        total = sum(single.values()) + sum(w for _, w in phrases)
        if not total:
            return F.lit(0.0)

        # a blank text has no tokens; the joined tokens are one expression, which generated code computes once
        joined = F.concat(F.lit(" "), F.array_join(T.tokens(text), " "), F.lit(" "))
        out = F.lit(0.0)
        for words, weight in [*(([t], w) for t, w in single.items()), *phrases]:
            out = out + weight * T.saturate(_occurrences(joined, words))
        return T.clamp(out / total)


def bayes_statistics(docs: DataFrame, text: str, about: str) -> DataFrame:
    """term, about, against: how often each term stands in either class."""
    terms = docs.select(F.col(about).alias("__about"), F.explode(T.tokens(F.col(text))).alias("term"))
    return terms.groupBy("term").agg(F.count_if(F.col("__about")).alias("about"), F.count_if(~F.col("__about")).alias("against"))


#: Terms that are broadcast to score with: of larger models the most frequent, about as many.
BROADCAST_TERMS = 500_000


@dataclass(frozen=True)
class Bayes:
    """A trained classifier: log odds by term as a table (term, odds, share of all tokens), and its scalars."""

    odds: DataFrame
    prior: float
    midpoint: float = 0.0
    scale: float = 1.0
    examples: int = 0
    terms: int | None = None

    def evidence(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """key, evidence (null where no term is known)."""
        counts, odds = term_counts(docs, key, text), self.odds.select("term", "odds")
        terms = self.odds.count() if self.terms is None else self.terms
        total, known = F.sum(F.col("odds") * T.saturate(F.col("n"))).alias("total"), F.count("odds").alias("known")
        if terms <= BROADCAST_TERMS:
            sums = counts.join(F.broadcast(odds), "term").groupBy(key).agg(total, known)
        else:
            # what the terms at hand give is summed up at once; only the others, few by their number, meet the rest of the model
            least = self.odds.agg(F.percentile_approx("share", 1 - BROADCAST_TERMS / terms, 100_000)).first()[0]
            pairs = counts.join(F.broadcast(self.odds.where(F.col("share") > least).select("term", "odds")), "term", "left")
            parts = pairs.groupBy(key, F.when(F.col("odds").isNull(), F.col("term")).alias("rare")).agg(total, known, F.max("n").alias("n"))
            # a sum meets no term: a space with its key is none, and keeps the sums in as many places as there are keys
            place = F.coalesce("rare", F.concat(F.lit(" "), F.coalesce(F.col(key).cast("string"), F.lit(""))))
            parts = parts.withColumn("term", place).join(self.odds.where(F.col("share") <= least).select("term", "odds"), "term", "left")
            rare = F.col("odds") * T.saturate(F.col("n"))
            sums = parts.groupBy(key).agg((F.coalesce(F.sum("total"), F.lit(0.0)) + F.coalesce(F.sum(rare), F.lit(0.0))).alias("total"), (F.sum("known") + F.count("odds")).alias("known"))
        return sums.where("known > 0").select(key, (F.lit(self.prior) + F.col("total") / F.sqrt("known")).alias("evidence"))

    def score(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """key, score: one row for each of docs (keys are unique); blank texts have 0, texts without known terms 0.5."""
        found = docs.select(key, T.blank(F.col(text)).alias("__blank")).join(self.evidence(docs, key, text), key, "left")
        value = T.clamp(T.sigmoid((F.coalesce("evidence", F.lit(self.midpoint)) - self.midpoint) * self.scale))
        return found.select(key, F.when(F.col("__blank"), 0.0).otherwise(value).alias("score"))

    def top(self, n: int, against: bool = False) -> DataFrame:
        weight = -F.col("odds") if against else F.col("odds")
        return self.odds.select("term", weight.alias("weight")).orderBy(F.col("weight").desc(), "term").limit(n)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", about: str = "about") -> Bayes:
    """Naive Bayes with add-one smoothing; the midpoint lies between the classes' mean evidence."""
    n = docs.agg(F.count_if(F.col(about)).alias("a"), F.count_if(~F.col(about)).alias("b")).first()
    if not n["a"] or not n["b"]:
        raise ValueError(f"{n['a']} examples of the subject and {n['b']} of anything else: both are needed")
    stats = settle(bayes_statistics(docs, text, about))
    total = stats.agg(F.sum("about").alias("a"), F.sum("against").alias("b"), F.count("*").alias("v")).first()
    size, tokens = float(total["v"]), float((total["a"] or 0) + (total["b"] or 0)) or 1.0
    odds = settle(stats.select("term", F.log(((F.col("about") + 1) / (total["a"] + size)) / ((F.col("against") + 1) / (total["b"] + size))).alias("odds"), ((F.col("about") + F.col("against")) / tokens).alias("share")))
    model = Bayes(odds, math.log(n["a"] / n["b"]), examples=n["a"] + n["b"], terms=total["v"])
    mean = model.evidence(docs, key, text).join(docs.select(key, F.col(about).alias("__about")), key, "right").groupBy("__about").agg(F.avg(F.coalesce("evidence", F.lit(0.0))).alias("m")).collect()
    means = {r["__about"]: r["m"] for r in mean}
    gap = means[True] - means[False]
    return Bayes(odds, model.prior, (means[True] + means[False]) / 2, 4 / gap if gap > 0 else 1.0, model.examples, model.terms)


def labelled(labels: DataFrame, corpus: DataFrame, key: str = "url") -> DataFrame:
    """Labels with what the corpus has under their key; `skipped` marks those that it lacks."""
    return labels.join(corpus.withColumn("__there", F.lit(True)), key, "left").withColumn("skipped", F.col("__there").isNull()).drop("__there")


def link_text(url: Column) -> Column:
    """What a URL says: its decoded path and its query."""
    path = urls.path_of(url)
    return F.concat(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), F.lit(" "), urls.query_of(url))


def propose_labels(docs: DataFrame, terms: Terms, text: str = "text", least: float = 0.35) -> DataFrame:
    """Adds topic_score and label: about where the term list scores at least `least`, else not."""
    score = terms.score(F.col(text), docs.sparkSession)
    return docs.withColumn("topic_score", score).withColumn("label", F.when(F.col("topic_score") >= least, "about").otherwise("not"))


class ModelStore:
    """Models by name and version below a path; a version is written once. Each is a table of log odds beside a JSON of scalars."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _dirs(self, path: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def names(self) -> list[str]:
        return self._dirs(self.path)

    def latest(self, name: str) -> int:
        return max((int(v) for v in self._dirs(f"{self.path}/{name}") if v.isdigit()), default=0)

    def put(self, name: str, model: Bayes) -> int:
        version = self.latest(name) + 1
        at = f"{self.path}/{name}/{version}"
        scalars = json.dumps({"prior": model.prior, "midpoint": model.midpoint, "scale": model.scale, "examples": model.examples, "terms": model.terms})
        model.odds.write.mode("errorifexists").parquet(f"{at}/odds")
        self.spark.range(1).select(F.lit(scalars).alias("value")).write.mode("errorifexists").text(f"{at}/scalars")
        return version

    def get(self, reference: str) -> Bayes:
        """By `name` (the latest) or `name@version`."""
        name, _, version = reference.partition("@")
        version = version.removeprefix("v") or str(self.latest(name))
        at = f"{self.path}/{name}/{version}"
        return Bayes(self.spark.read.parquet(f"{at}/odds"), **json.loads(self.spark.read.text(f"{at}/scalars").first()[0]))

    def delete(self, name: str, version: int) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{version}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Adds a column with the score of a text to rows: (rows, text, name of the column).
Scorer = Callable[[DataFrame, Column, str], DataFrame]


def by_terms(terms: Terms) -> Scorer:
    return lambda rows, text, name: rows.withColumn(name, terms.score(text, rows.sparkSession))


def by_bayes(model: Bayes) -> Scorer:
    """Rows with one text share its score."""

    def add(rows: DataFrame, text: Column, name: str) -> DataFrame:
        rows = rows.withColumn("__h", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).withColumn("__text", text)
        found = model.score(rows.select("__h", "__text").dropDuplicates(["__h"]), "__h", "__text").withColumnRenamed("score", name)
        return rows.drop("__text").join(found, "__h").drop("__h")

    return add


def link_threshold(requests: DataFrame, score: Scorer, least: float, weight: float = 1.0) -> DataFrame:
    """Drops requests (url, parent, score) whose link text scores below `least`; the others' score is the greater of their own and the weighted one."""
    text = link_text(F.col("url"))
    if "parent" in requests.columns:
        text = F.concat_ws(" ", text, F.when(F.col("parent").isNotNull(), link_text(F.col("parent"))))
    rows = score(requests, text, "__topic").where(F.col("__topic") >= least)
    return rows.withColumn("score", F.greatest("score", F.col("__topic") * weight)).drop("__topic")


def page_threshold(pages: DataFrame, score: Scorer, least: float, text: str = "body") -> DataFrame:
    """Drops pages whose whole text scores below `least`; the others get topic_score, with three decimals."""
    rows = score(pages, F.col(text), "__topic").where(F.col("__topic") >= least)
    return rows.withColumn("topic_score", F.format_string("%.3f", F.col("__topic"))).drop("__topic")
