"""Length-delimited binary records of token ids, with an offset index.

A shard is one file of frames in the TFRecord framing::

    u64  length of the payload           u32  masked CRC-32C of these 8 bytes
    payload                              u32  masked CRC-32C of the payload

(little-endian; a CRC is masked by rotating it right by 15 bits and adding a
constant).  A payload is one flag byte (1: the document has an id), the id as
i64, and the token ids, as u16 if the vocabulary fits, else u32.  Beside each
shard lies its index, for reads in any order: per record ``u64 offset of its
frame, u32 length of the payload, u32 number of ids``.

Documents are range-partitioned and sorted by id, so shards in order, and
records in them, are in ascending order of the ids (null first; of equal ids
by a hash of their texts).  Each task writes its shard under a name of its own
attempt and moves it into place.  A manifest table lists the shards.

Defined results: a null or empty text has the end id only; repeated rows are
records of their own; an empty table gives no shard; other columns are
ignored.  A frame whose checksum is wrong stops the read with an error.
"""

from __future__ import annotations

import struct
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import open_store
from . import tokens
from .common import new_folder, running_totals, ship, table

# Fixed values of the format.
CRC32C_POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
INDEX_ENTRY = "<QII"
CHUNK = 1024
# Segments that keep their white space are more varied; a task holds little else.
CACHED_SEGMENTS = 800_000


def _after_zeros(value: np.ndarray, words: int, tables) -> np.ndarray:
    for _ in range(words):
        value = tables[0][value & 0xFFFF] ^ tables[1][value >> 16]
    return value


def _linear_table(of_bit) -> np.ndarray:
    """All 65536 values of a map that is linear over bits, from its 16 images."""
    out = np.zeros(1, np.uint32)
    for image in of_bit:
        out = np.concatenate((out, out ^ image))
    return out


def _tables():
    """Maps of the low and the high half of a register to the register four
    zero bytes later, and the same for ``CHUNK`` zero bytes."""
    bits = []
    for k in range(32):
        r = 1 << k
        for _ in range(32):
            r = r >> 1 ^ (CRC32C_POLYNOMIAL if r & 1 else 0)
        bits.append(np.uint32(r))
    word = (_linear_table(bits[:16]), _linear_table(bits[16:]))
    far = _after_zeros(np.array([1 << k for k in range(32)], np.uint32), CHUNK // 4, word)
    return word, (_linear_table(far[:16]), _linear_table(far[16:]))


_WORD, _FAR = _tables()


def crc32c(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of each message (of 4 bytes at least), all at once: messages are
    padded in front to whole chunks, every chunk is a lane, and the lanes'
    registers are joined message by message.  Leading zeros don't count when a
    register starts at zero; the usual start is the same as inverting the
    message's first four bytes."""
    if not messages:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(m) for m in messages])
    chunks = -(-sizes // CHUNK)
    last = np.cumsum(chunks)
    buffer = np.zeros(int(last[-1]) * CHUNK, np.uint8)
    for m, end in zip(messages, (last * CHUNK).tolist(), strict=True):
        buffer[end - len(m):end] = np.frombuffer(m, np.uint8)
        buffer[end - len(m):end - len(m) + 4] ^= 0xFF
    lanes = np.ascontiguousarray(buffer.view("<u4").reshape(-1, CHUNK // 4).T)
    r = np.zeros(lanes.shape[1], np.uint32)
    for row in lanes:
        r ^= row
        r = _WORD[0][r & 0xFFFF] ^ _WORD[1][r >> 16]
    first, out = last - chunks, np.zeros(len(messages), np.uint32)
    order = np.argsort(-chunks, kind="stable")
    for k in range(int(chunks.max())):
        live = order[:int(np.searchsorted(-chunks[order], -k))]
        out[live] = _FAR[0][out[live] & 0xFFFF] ^ _FAR[1][out[live] >> 16] ^ r[first[live] + k]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> 15 | crc << 17) + np.uint32(MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, bodies = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [b"".join((n, h.tobytes(), p, b.tobytes())) for n, h, p, b in zip(lengths, heads, payloads, bodies, strict=True)]


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    return struct.pack("<Bq", doc_id is not None, doc_id or 0) + ids.tobytes()


MANIFEST = "shard long, path string, index_path string, records long, ids long, bytes long, width long"


def write(docs: DataFrame, folder: str | None = None, *, path: str = tokens.BYTE_BPE, keeps_space: bool = True) -> DataFrame:
    """Write ``doc_id, text`` as shards below ``folder`` (default: a new folder
    of the shared store); returns the manifest."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "records")

    def shard(batches):
        encoder = tokens.encoder(path, keeps_space, CACHED_SEGMENTS)
        fs, base = open_store(folder)
        number = TaskContext.get().partitionId()
        name, own = f"{base}/shard-{number:06d}", f".{time.time_ns()}"
        at, records, n_ids, index = 0, 0, 0, []
        with fs.open_output_stream(f"{name}.rec{own}") as out:
            for b in batches:
                doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                for part in tokens.in_parts(texts):
                    arrays = encoder.encode(texts[part])
                    payloads = [payload(i, a) for i, a in zip(doc_ids[part], arrays, strict=True)]
                    for frame, p, a in zip(frames(payloads), payloads, arrays, strict=True):
                        out.write(frame)
                        index.append(struct.pack(INDEX_ENTRY, at, len(p), len(a)))
                        at += len(frame)
                        n_ids += len(a)
                    records += len(payloads)
        if not records:
            fs.delete_file(f"{name}.rec{own}")
            return
        with fs.open_output_stream(f"{name}.idx{own}") as out:
            out.write(b"".join(index))
        for kind in ("rec", "idx"):
            fs.move(f"{name}.{kind}{own}", f"{name}.{kind}")
        made = (number, f"{folder}/shard-{number:06d}.rec", f"{folder}/shard-{number:06d}.idx", records, n_ids, at, encoder.dtype.itemsize)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in made], names=[c.split()[0] for c in MANIFEST.split(", ")])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return table(ordered.mapInArrow(shard, MANIFEST), "shards")


def parse(raw: bytes, count: int, where: str) -> list[bytes]:
    """The payloads of ``count`` whole frames, with their checksums tested."""
    at, lengths, heads, payloads, bodies = 0, [], [], [], []
    for _ in range(count):
        lengths.append(raw[at:at + 8])
        n = struct.unpack_from("<Q", raw, at)[0]
        heads.append(raw[at + 8:at + 12])
        payloads.append(raw[at + 12:at + 12 + n])
        bodies.append(raw[at + 12 + n:at + 16 + n])
        at += 16 + n
    for messages, sums in ((lengths, heads), (payloads, bodies)):
        if not np.array_equal(masked(crc32c(messages)), np.frombuffer(b"".join(sums), "<u4")):
            raise ValueError(f"checksum of a record in {where} is wrong")
    return payloads


def records(fs, path: str, index_path: str, chosen=None, at_once: int = 4 << 20):
    """Lists of payloads of a shard, in order; or of the records whose numbers
    are ``chosen``, in that order."""
    with fs.open_input_stream(index_path) as f:
        index = np.frombuffer(f.read(), np.dtype([("at", "<u8"), ("size", "<u4"), ("ids", "<u4")]))
    with fs.open_input_file(path) as f:
        if chosen is not None:
            for k in chosen:
                f.seek(int(index["at"][k]))
                yield parse(f.read(int(index["size"][k]) + 16), 1, path)
            return
        ends = index["at"].astype(np.int64) + index["size"] + 16
        k = 0
        while k < len(index):
            stop = max(k + 1, int(np.searchsorted(ends, int(index["at"][k]) + at_once)))
            yield parse(f.read(int(ends[stop - 1]) - int(index["at"][k])), stop - k, path)
            k = stop


RESULT = ["doc_id", "start", "n_tokens", "ids_crc32"]


def read_back(manifest: DataFrame) -> DataFrame:
    """Per record, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    ship(manifest.sparkSession)
    placed = running_totals(manifest, ["shard"], ["ids"], "shard-places")

    def rows(batches):
        for shard in (x for b in batches for x in b.to_pylist()):
            fs, path = open_store(shard["path"])
            start = shard["before_ids"]
            for payloads in records(fs, path, open_store(shard["index_path"])[1]):
                out = []
                for p in payloads:
                    known, doc_id = struct.unpack_from("<Bq", p)
                    ids = np.frombuffer(p, f"<u{shard['width']}", offset=9).astype("<u4")
                    out.append((doc_id if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=RESULT)

    # one row a shard: deal them out so that each task reads about one
    dealt = placed.repartition(max(1, manifest.count()))
    return dealt.mapInArrow(rows, ", ".join(f"{c} long" for c in RESULT))
