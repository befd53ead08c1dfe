"""Registered queries of the subpackage: oracles, contract columns, pipeline."""

import corpus_pipeline
import pytest

from oracle_compare import compare, duck
from ratecraft.llm import mixing, packing, quality, secret_scan, simhash
from ratecraft.llm.common import read
from ratecraft.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    2: {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    3: {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    4: {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    5: {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
        "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    6: {"doc_id": "bigint", "log_likelihood": "double"},
    7: {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint",
        "offset": "bigint"},
    8: {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    9: {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    10: {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    11: {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    12: {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    13: {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint",
         "audit": "string", "repaired_sha256": "string"},
}


@pytest.mark.parametrize("name", QUERIES)
def test_contract_columns_and_rows(spark, name):
    found = QUERIES[name](spark, SF)
    kinds = dict(found.dtypes)
    want = COLUMNS[int(name[2:].split("_")[0])]
    assert {c: kinds.get(c) for c in want} == want
    number = int(name[2:].split("_")[0])
    of = read(spark, SF, {1: "embeddings", 2: "pages", 4: "pages", 12: "embeddings", 13: "conversations"}.get(number, "documents"))
    if number == 12:
        of = of.where("vec_id % 100 = 0")
    if number == 13:
        of = of.select("conv_id").distinct()
    assert found.select(found.columns[0]).distinct().count() == of.count()


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_its_sql(spark, name):
    result = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES[name])
    assert result["ok"], result


def test_pipeline_matches_its_parts(spark):
    """run() against the operators' plain results, put together in Python."""
    docs = read(spark, SF, "documents")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    texts = {r.doc_id: r for r in docs.collect() if r.doc_id in kept}
    prints = {r.doc_id: r.fp for r in simhash.fingerprints(docs).collect() if r.doc_id in kept}
    ids = sorted(kept)
    group = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if b < a and ((prints[a] ^ prints[b]) % 2**64).bit_count() <= 4:
                group = {k: min(group[a], group[b]) if v in (group[a], group[b]) else v for k, v in group.items()}
    rows = []
    for i in ids:
        if group[i] == i:
            spans = secret_scan.find(texts[i].text)[1]
            text = secret_scan.mask(texts[i].text, spans) if spans else texts[i].text
            rows.append((i, text, texts[i].lang, texts[i].source, len(text)))
    left = spark.createDataFrame(rows, docs.schema)
    want = packing.pack(mixing.mixed_documents(left), with_ids=False).groupBy("doc_id").sum("length").collect()
    got = corpus_pipeline.run(spark, SF)
    assert "ids" in got.columns
    assert dict(got.groupBy("doc_id").sum("length").collect()) == dict(want)
    lengths = sorted((r.sequence_id, r[1]) for r in got.groupBy("sequence_id").sum("length").collect())
    assert [n for n, _ in lengths] == list(range(len(lengths))) and all(n == 4096 for _, n in lengths[:-1])
