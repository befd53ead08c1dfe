"""The registered queries of this subpackage: thin functions that apply an
operator, with its production parameters, to its whole table and derive the
columns of the query's contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (binary, conversations, embed_dedup, hard_negatives, mixing, packing, pseudo_lm, quality, secret_scan, simhash, token_counts,
               url_filter, warc)
from .common import read


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every embedding, whatever its label."""
    found = embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url.  Pages have no labels of their own, so the
    quality label of the document with a page's number is taken as the page's."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("label"))
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url").join(labels, "page_id", "left"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the schedule's slot that
    first takes some of them."""
    taken = mixing.mix(read(spark, sf_dir, "documents")).taken()
    return taken.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back, from the merged
    index.  The pages have no capture time, so page n is taken as captured n
    seconds after a fixed day."""
    pages = read(spark, sf_dir, "pages").withColumn("captured", F.timestamp_seconds(F.col("page_id") + 1_700_000_000))
    found = warc.merged_index(warc.capture_runs(warc.write(pages)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution divergence of every document from its language."""
    return quality.judge(read(spark, sf_dir, "documents"))


def op6_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all."""
    return pseudo_lm.pseudo_likelihood(read(spark, sf_dir, "documents"))


def op7_pack_along_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 4096 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), with_ids=False)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential spans of every document: base patterns and linked parts."""
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secret_scan.BASE_KINDS),
                        F.sha2(secret_scan.span_list(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.span_list(F.col("spans")).alias("spans"))


def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as framed records and read back."""
    return binary.read_back(binary.write(read(spark, sf_dir, "documents")))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near copies of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; every seventh is moved to the
    next label first, so that near vectors of other labels exist."""
    number = F.col("vec_id")
    moved = F.when(number % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mine(rows, number % 100 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, damaged first."""
    rows = read(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), rows.select("conv_id"))


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_mix_sources": op3_mix_sources,
    "op4_warc_index": op4_warc_index,
    "op5_quality_rules": op5_quality_rules,
    "op6_masked_pseudo_likelihood": op6_masked_pseudo_likelihood,
    "op7_pack_along_curve": op7_pack_along_curve,
    "op8_secret_scan": op8_secret_scan,
    "op9_binary_records": op9_binary_records,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": embed_dedup.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op4_warc_index": warc.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
