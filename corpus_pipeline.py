"""Corpus pipeline: five stages over the ``documents`` table, each written as
Parquet and reread as the next one's input.

1. quality rules: documents that the rules reject go;
2. SimHash near-dedup: of each group of near copies the one with the smallest
   id stays;
3. secret scans: every credential found is masked in the text;
4. mixing: documents are taken, cut or repeated until each source has its
   target share of the words;
5. packing: what remains is packed into token sequences; the result has one
   row per piece of a document.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from ratecraft.llm import mixing, packing, quality, secret_scan, simhash
from ratecraft.llm.common import read, table
from ratecraft.session import recorded_scratch, remove


_left: list[str] = []


def stage(work):
    """A stage's scratch tables must live until its result is written, and then
    only take up disk: the next stage deletes them when it starts."""
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            remove(_left.pop())
        with recorded_scratch(_left):
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that keep the quality rules, unchanged."""
    return quality.good_documents(docs)


@stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, unchanged."""
    return simhash.one_of_each_group(docs)


@stage
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the credentials in their texts masked."""
    return secret_scan.masked(docs)


@stage
def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: documents once, twice, or cut at a source's quota."""
    return mixing.mixed_documents(docs)


@stage
def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in token sequences, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources", mixing_sources),
    ("packing", packing_sequences),
]

# No SQL: masking and packing need positions of matches and a tokenizer, and
# XXH64 fingerprints have no function there; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
