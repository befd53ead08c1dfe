"""Token counts against the library on whole texts."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from llm_fixtures import EXTRA
from ratecraft.llm import token_counts
from ratecraft.llm.token_counts import PIECE_BPE, Lengths, frequent, kept, pre_tokens, token_counts as counts

PARTS = ["a", "b", "the", "é", "日本", "  ", " ", "\n", "\t", "\r", ".", ",", "!", "▁", "<s>", "</s>", "<0x0A>", "<unk>", "　", "\x00", "1", "Ω",
         "ß", "é", "_", "-", "'s", "\xa0", "​", "𝒳", "அ", "word", "ing", "\x1f"]


@pytest.fixture(scope="module")
def whole():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    return lambda texts: [len(model.encode(t)) if t else 0 for t in texts]


def test_pre_tokens_hold_the_whole_text():
    draw = random.Random(1)
    for _ in range(2000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(1, 12)))
        assert "".join(" " + p for p in pre_tokens(text)) == " " + text.replace("▁", " ")
    assert pre_tokens(" a  b ") == [" a", " b", ""]


def test_lengths_are_those_of_whole_texts(whole, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED_UNITS", 50)  # most units leave the cache again
    draw = random.Random(2)
    texts = [None, "", " ", "\n", "\n\n", " \n ", "a."] + ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30))) for _ in range(6000)]
    own = Lengths(PIECE_BPE, {"the": 1})
    assert own.cuts_spaces and own.cuts_lines and own.cuts_marks
    for k in range(0, len(texts), 1000):
        assert own.count(texts[k:k + 1000]) == whole(texts[k:k + 1000])
    assert len(own.cache) <= 52


def test_a_vocabulary_that_joins_white_space_is_given_whole_texts(whole, monkeypatch):
    own = Lengths(PIECE_BPE)
    texts = ["a b\nc.", "x  y", None, ""]
    for flag in ("cuts_marks", "cuts_lines", "cuts_spaces"):
        monkeypatch.setattr(own, flag, False)
        assert own.count(texts) == whole(texts)


def test_every_document(spark, some_docs, edge_docs, no_docs, whole):
    for docs in (some_docs, edge_docs):
        rows = docs.select("doc_id", "text").collect()
        n = whole([r.text for r in rows])
        want = sorted(((r.doc_id, len((r.text or "").encode()), t, t > 100) for r, t in zip(rows, n, strict=True)), key=str)
        got = counts(docs, limit=100, entries=20)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert counts(no_docs).count() == 0 and set(EXTRA) <= set(edge_docs.columns)


def test_frequent_pre_tokens_come_from_all_texts(spark):
    docs = spark.range(0, 4000, 1, 40).select(F.concat_ws(" ", F.lit("hot"), F.concat(F.lit("rare"), F.col("id").cast("string")), F.lit("warm"),
                                                          F.lit("long" * 10)).alias("text"))
    assert set(frequent(docs, 8)) == {"hot", "warm"}
    assert kept(token_counts.Counter(a=9, b=5, c=2), 2) == {"a": 7, "b": 3}
