"""The queries opN_<name> over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fingerprints, html_extract, language_id, mixing, near_dups, packing, ppm, token_counts, warc
from .common import read, remainder, shared_dir


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness is containment; 0 where two sketches cover no common scale, so nothing in them is shared."""

    def compare(ids: list, texts: list) -> pa.RecordBatch:
        n = len(ids) - 1
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts[:-1], texts[1:], strict=True)]
        own, other = fingerprints.sketches(pa.array(texts, pa.large_string())), fingerprints.sketches(pa.array(edited, pa.large_string()))
        return pa.record_batch(
            {
                "doc_id": pa.array(ids[:n], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                "fingerprint": pa.array([fingerprints.as_text(s) for s in own[:n]], pa.string()),
                "edited_fingerprint": pa.array([fingerprints.as_text(s) for s in other], pa.string()),
                "near_edited": pa.array([fingerprints.containment(a, b) or 0.0 for a, b in zip(own, other, strict=False)], pa.float64()),
                "near_next": pa.array([fingerprints.containment(a, b) or 0.0 for a, b in zip(own[:-1], own[1:], strict=True)], pa.float64()),
            }
        )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return fingerprints.with_next(read(spark, sf_dir, "documents"), compare, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    pages = read(spark, sf_dir, "pages")
    warc.write(pages, path)
    page = lambda fields: fields["page_id"].try_cast("long")
    at = lambda name: F.coalesce(F.col(f"original.{name}"), F.col(f"capture.{name}"))
    return warc.captures(spark, path, payload=False).select(
        page(F.col("metadata")).alias("page_id"),
        at("payload_bytes").alias("payload_bytes"),
        at("payload_sha256").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        page(F.col("original.metadata")).alias("refers_to"),
    )


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op6_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 10) != 0).alias("train"))
    return ppm.score(docs).withColumn("held_out", ~F.col("train")).drop("train")


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.linked(read(spark, sf_dir, "documents"), size=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    model = language_id.fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return language_id.identify(docs, model, keep=("doc_id", "held_out"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_warc": op2_warc,
    "op3_nearest": op3_nearest,
    "op4_main_text": op4_main_text,
    "op5_token_counts": op5_token_counts,
    "op6_ppm_scores": op6_ppm_scores,
    "op7_near_dups": op7_near_dups,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
}

ORACLES = {
    "op2_warc": """
with p as (
  select page_id, coalesce(html, '') as html from pages),
d as (
  select page_id, octet_length(encode(html))::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first from d)
select page_id, payload_bytes, payload_digest,
       case when page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from first then first end as refers_to
from f
""",
    "op3_nearest": """
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as score
  from (select distinct vec_id, e from v where vec_id % 50 = 0) q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
""",
    "op10_mixing": """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by encode(source) nulls last) - 1 as i from d group by source),
w as (
  select *, (case i % 3 when 0 then 5 when 1 then 2 else 1 end)::double as weight, 2.0::double * source_size as cap from s),
o as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, i rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by cap / weight, i rows between current row and unbounded following) as level,
         row_number() over (order by cap / weight, i) as k
  from w),
l as (select coalesce((select level from o where level <= cap / weight order by k limit 1), 1e300) as level),
t as (
  select source, source_size, least(cap, l.level * weight) as target,
         case when source_size = 0 then 0 else floor(least(cap, l.level * weight) / source_size)::bigint end as base
  from w, l),
n as (select *, target - base * source_size as need from t),
g as (select source, h, sum(size) as n from d group by source, h),
c as (select *, sum(n) over (partition by source order by h) as upto from g),
b as (
  select c.source, case when (need - (upto - n)) * 2 > n then h + 1 else h end as below,
         row_number() over (partition by c.source order by h) as k
  from c join n on c.source is not distinct from n.source where upto > need)
select d.doc_id, d.size, n.source_size, n.target,
       (n.base + case when d.h < coalesce(b.below, case when need > 0 then 1::bigint << 60 else 0 end) then 1 else 0 end) * d.size as taken,
       n.base + case when d.h < coalesce(b.below, case when need > 0 then 1::bigint << 60 else 0 end) then 1 else 0 end as copies
from d join n on d.source is not distinct from n.source
left join b on d.source is not distinct from b.source and b.k = 1
""",
}
