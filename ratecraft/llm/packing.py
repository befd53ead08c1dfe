"""Packing documents into token sequences along a space-filling curve.

Each document's distinct token ids are hashed, with signs, into a vector; the
unit vector is projected to four dimensions; their 12-bit cells have a place
on a Hilbert curve.  Documents are sorted by that place over the whole table
(by ranges), their ids laid end to end, and the line is cut every ``capacity``
ids: neighbours on the curve share sequences, and only the last sequence of
all is not full.

Defined results: a null or empty text has the end id only and the zero
vector's place; repeated rows are documents of their own; a document longer
than a sequence goes on in the next ones; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tokens
from .common import beside, running_totals, table

CAPACITY = 4096
BUCKETS = 256
DIMENSIONS = 4
BITS = 12
SEED = 7


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (one per row, each of its
    coordinates under ``2**bits``)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:  # undo the turns of the sub-cubes, from the largest
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = high
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


class Projector:
    """Hashed vectors of id arrays, projected."""

    def __init__(self, vocabulary: int) -> None:
        draw = np.random.default_rng(SEED)
        self.bucket = draw.integers(0, BUCKETS, vocabulary)
        self.sign = draw.choice([-1.0, 1.0], vocabulary)
        self.axes = draw.standard_normal((BUCKETS, DIMENSIONS))
        self.vocabulary = vocabulary

    def vector(self, ids: np.ndarray) -> np.ndarray:
        seen = np.zeros(self.vocabulary, bool)
        seen[ids] = True
        kinds = np.flatnonzero(seen)
        return np.bincount(self.bucket[kinds], weights=self.sign[kinds], minlength=BUCKETS)

    def keys(self, arrays: list[np.ndarray]) -> np.ndarray:
        v = np.array([self.vector(a[:-1]) for a in arrays]).reshape(-1, BUCKETS)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        flat = (v / np.where(size > 0, size, 1)) @ self.axes
        return hilbert_key(np.clip((flat + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


@functools.cache
def projector(vocabulary: int) -> Projector:
    return Projector(vocabulary)


def tokenized(docs: DataFrame, path: str = tokens.WORD_BPE, keeps_space: bool = False) -> DataFrame:
    """``row, doc_id, n, place, ids``: number of ids, place on the curve, and
    the ids, little-endian in the vocabulary's width."""

    def encode(texts):
        encoder = tokens.encoder(path, keeps_space)
        project = projector(encoder.tokenizer.get_vocab_size())
        n, place, ids = [], [], []
        for part in tokens.in_parts(texts):
            arrays = encoder.encode(texts[part])
            n += map(len, arrays)
            place += project.keys(arrays).tolist()
            ids += [a.tobytes() for a in arrays]
        return n, place, ids

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return beside(numbered, ["row", "doc_id"], ["text"], "n long, place long, ids binary", encode)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, path: str = tokens.WORD_BPE, keeps_space: bool = False,
         with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset`` and, if asked for, ``ids`` (32 bits each,
    little-endian).  ``docs`` has ``doc_id, text``."""
    cut = table(tokenized(docs, path, keeps_space), "token-ids")
    line = running_totals(cut.select("row", "place", "n"), ["place", "row"], ["n"], "curve").select(
        "row", F.col("before_n").alias("at"))
    width = tokens.encoder(path, keeps_space).dtype

    def pieces(batches):
        for b in batches:
            out, of = [], []
            for k, (n, at, raw) in enumerate(zip(*[b.column(c).to_pylist() for c in ("n", "at", "ids")], strict=True)):
                ids = np.frombuffer(raw, width).astype("<u4")
                start = 0
                while start < n:
                    length = min(n - start, capacity - (at + start) % capacity)
                    own = ids[start:start + length].tobytes()
                    out.append((start, length, zlib.crc32(own), n, *divmod(at + start, capacity), *([own] if with_ids else [])))
                    of.append(k)
                    start += length
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of, pa.int64())),
                                              *[pa.array(x, t) for x, t in zip(columns, kinds, strict=True)]], names=names)

    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(PIECE + ", ids binary" * with_ids).fields])
    names, kinds = schema.names, [pa.int64()] * 6 + [pa.binary()] * with_ids
    return cut.select("row", "doc_id", "n", "ids").join(line, "row").mapInArrow(pieces, schema)


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sequences(pieces: DataFrame, *, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """``sequence_id, length, ids``: the packed sequences of pieces with ids.
    All are ``capacity`` long but the last, which is padded to it unless its
    length is a power of two."""
    joined = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))),
                                 lambda p: p["ids"]), "").alias("hex"))
    full = (F.col("length") == capacity) | (F.bit_count("length") == 1)
    pad = F.when(full, F.lit(0)).otherwise(capacity - F.col("length")).cast("int")
    one = int(pad_id).to_bytes(4, "little").hex().upper()
    return joined.select("sequence_id", "length", F.unhex(F.concat("hex", F.repeat(F.lit(one), pad))).alias("ids"))
