"""Nulls, empty and very long texts, repeated rows, ties, empty tables and
columns with clashing names: every operator on documents, and every stage."""

import corpus_pipeline
import pytest

from llm_fixtures import EXTRA
from ratecraft.llm import binary, mixing, packing, pseudo_lm, quality, secret_scan, simhash
from ratecraft.llm.common import WORD_PATTERN
import re

N_EDGE = 15
PER_ROW = {
    "quality": quality.judge,
    "simhash": simhash.near_duplicates,
    "secrets": secret_scan.scan,
    "mixing": lambda d: mixing.mix(d).taken(),
    "binary": lambda d: binary.read_back(binary.write(d)),
    "pseudo_lm": lambda d: pseudo_lm.pseudo_likelihood(d, rounds=1),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_document(edge_docs, no_docs, name):
    rows = PER_ROW[name](edge_docs).collect()
    assert len(rows) == N_EDGE
    assert sorted((r.doc_id for r in rows if r.doc_id is not None)) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 10, 2**60 + 1]
    assert PER_ROW[name](no_docs).count() == 0


def words(text):
    return re.findall(WORD_PATTERN, text or "")


def test_defined_results_of_texts_without_words(edge_docs):
    of = lambda rows: {r.doc_id: r for r in rows if r.doc_id in (1, 2, 3)}
    for r in of(quality.judge(edge_docs).collect()).values():
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.base_failed, r.kept, r.class_distance) == (0, 0, 0, True, False, None)
    prints = of(simhash.near_duplicates(edge_docs).collect())
    assert {r.fp for r in prints.values()} == {0} and {r.component_id for r in prints.values()} == {1}
    assert all(r.base == [] and r.spans == [] for r in of(secret_scan.scan(edge_docs).collect()).values())
    assert all((r.size, r.taken) == (0, 0) for r in of(mixing.mix(edge_docs).taken().collect()).values())
    scored = of(pseudo_lm.pseudo_likelihood(edge_docs, rounds=1).collect())
    assert all((r.n_words, r.log_likelihood, r.mean_log_probability) == (0, 0.0, None) for r in scored.values())
    records = of(binary.read_back(binary.write(edge_docs)).collect())
    assert records[1].n_tokens == records[2].n_tokens == 1


def test_null_id_is_largest_and_repeated_rows_share_a_group(edge_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    copies = [r for r in rows if r.component_id == 6]
    assert sorted(r.doc_id or 0 for r in copies) == [0, 6, 7, 8]
    assert len([r for r in rows if r.doc_id == 9 and r.component_id == 9]) == 3
    kept = simhash.one_of_each_group(edge_docs)
    assert kept.columns == edge_docs.columns
    assert kept.count() == len({r.fp if r.component_id is None else r.component_id for r in rows}) + 1  # the short text of 9 is its own


def test_packing_covers_every_document(edge_docs, no_docs):
    pieces = packing.pack(edge_docs).collect()
    long = [p for p in pieces if p.doc_id == 5]
    assert sum(p.length for p in long) == long[0].doc_tokens > 3 * packing.CAPACITY
    assert sum(p.length for p in pieces if p.doc_id is None) == sum({p.doc_tokens for p in pieces if p.doc_id is None})
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(spark, edge_docs, no_docs, name, stage):
    out = stage(spark, edge_docs, "")
    assert out.columns == edge_docs.columns
    assert [f.dataType for f in out.schema] == [f.dataType for f in edge_docs.schema]
    assert all(r[c] == f"own {c}" for r in out.collect() for c in EXTRA)
    assert stage(spark, no_docs, "").count() == 0
    assert stage(spark, no_docs, "").columns == no_docs.columns


def test_documents_without_the_optional_column(edge_docs):
    plain = edge_docs.select("doc_id", "text", "source")
    assert secret_scan.masked(plain).columns == ["doc_id", "text", "source"]
    assert mixing.mixed_documents(plain).columns == ["doc_id", "text", "source"]
