"""A corpus pipeline over `documents`: language identification, near-duplicate removal, source mixing, packing.

Each stage is written to the shared folder and read again as the next one's documents. Languages: a text goes if no
language can be told (no letter) or none is likelier than all others together. Near duplicates: five-word shingles,
similarity 0.8; one document of each component stays. Mixing: a document the mix repeats is two rows. Packing: all that
is left, in sequences of 1024 tokens.

Defined results: null and empty texts go in the first stage; rows that repeat id and text are one row after the second;
a null id is an id like any other, last where ids are ordered; a null source is a source of its own; an empty table gives
an empty one in every stage. Columns beside those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import language_id, mixing, near_dups, packing
from grainmill.llm.common import read, remainder, stage


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang"))
    names = docs.columns
    marked = language_id.identify(docs.select(F.struct(*names).alias("row"), "text"), model, keep=("row",))
    return marked.where((F.col("lang_pred") != "und") & (F.col("score") > 0.5)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    rows = docs.select("doc_id", "text", "source", F.struct(*names).alias("row"))
    return mixing.mix(rows, carry=("row",)).where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("languages", languages), ("near duplicates", near_duplicates), ("mixing", mixed), ("packing", packed)]

#: Tokens and language models can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
