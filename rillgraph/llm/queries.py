"""The queries of this subpackage, for ``__spark_entry__``; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, exact_dedup, fingerprints, langid, licenses, line_dedup, packing, simhash, toxicity, warc


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).drop("text")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.digests(warc.read_archive(spark, path, common.saved, with_payload=False))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, n_matches, licences and rules in text order, start and end of each match."""
    found = licenses.scan(common.documents(spark, sf_dir).select("doc_id", "text"))
    m = F.col("matches")
    return found.select("doc_id", F.size(m).cast("long").alias("n_matches"), F.array_join(m.licence, ";").alias("licences"), F.array_join(m.rule, ";").alias("rules"), F.array_join(F.transform(m, lambda x: F.concat_ws("-", x.start, x.end)), ";").alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", common.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.array_join(F.transform("evidence", lambda x: x.doc_id.cast("string")), ",").alias("evidence"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", common.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup.mark_duplicates(docs, carry_text=False)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(common.documents(spark, sf_dir).select("doc_id", "text"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, n_tokens, bucket, bucket_length, shard, batch and padding."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    counted = packing.with_token_count(common.documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")
    return packing.pack(common.saved(counted, "token-counts"), F.col("n_tokens"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_dropped, and the numbers of the dropped lines."""
    found = line_dedup.duplicate_lines(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"))


QUERIES = {"op1_bpe": op1_bpe, "op2_warc": op2_warc, "op3_licenses": op3_licenses, "op4_toxicity": op4_toxicity, "op5_langid": op5_langid, "op6_exact_dedup": op6_exact_dedup, "op7_fingerprints": op7_fingerprints, "op8_simhash": op8_simhash, "op9_packing": op9_packing, "op10_line_dedup": op10_line_dedup}

OP2_SQL = """
with p as (select page_id, coalesce(html, '') html, sha256(coalesce(html, '')) payload_digest, octet_length(encode(coalesce(html, ''))) payload_bytes from pages),
f as (select payload_digest, min(page_id) first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes::bigint payload_bytes, p.payload_digest,
       case when page_id > first then 'revisit' else 'response' end record_type,
       case when page_id > first then first end refers_to, null::varchar problem
from p left join f using (payload_digest)
"""

OP6_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') norm from documents)
select doc_id, max(doc_id) over (partition by norm) keep_id, count(*) over (partition by norm) group_size,
       row_number() over (partition by norm order by doc_id desc nulls last) = 1 kept, sha256(norm) text_sha256
from d
"""

ORACLES = {"op2_warc": OP2_SQL, "op6_exact_dedup": OP6_SQL}
