"""WARC archives with revisit records, and their merged capture index.

``write`` makes one gzipped archive (one member per record) of each partition
of pages.  Of the pages with equal payloads of ``min_bytes`` or more, the one
with the largest id is written as a response and all others as revisits of it.

``capture_runs`` reads archives back, each in one task and record by record,
tests the payload digests, and gives one run of captures per archive, sorted
by URL key and timestamp.  ``merged_index`` merges the runs into capture
histories in one global order: the runs are cut into key ranges (by URL key,
timestamp and page, so that a host with a third of all captures is cut too),
and a task merges the slices of its range by a loser tree, whose inner nodes
hold the losers of the matches between the runs.  ``part`` and ``seq`` give the
global order.

Defined results: a null payload is an empty one; a null url has the empty key;
a null page id is smaller than all others; rows that repeat the largest page id
of a payload are all responses; an empty table gives an empty index; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import open_store
from .common import new_folder, ship, table

MIN_BYTES = 0
GZIP_LEVEL = 4
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("urlkey string, captured string, page_id long, url string, record_type string, payload_bytes long, "
            "payload_digest string, refers_to long, path string, offset long, length long, run long, pos long")


def url_key(url: str | None) -> str:
    """Sort key of a url: host labels reversed, then path and query."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return (url or "").lower()
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host = rest[:end].rpartition("@")[2].partition(":")[0].lower()
    return ",".join(reversed(host.split("."))) + ")" + (rest[end:].partition("#")[0] or "/")


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, captured: str, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """One WARC record; header values are kept on one line."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block += b"" if is_revisit else payload
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
              ("WARC-Date", captured), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if is_revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
        fields += [("X-Refers-To-Page-ID", refers_to)] if refers_to is not None else []
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def with_origins(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, captured, payload, sha1, copies, origin``: how many pages
    have the payload, and the largest id of them (null for a single page)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "captured", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    shared = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1")
              .agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("origin")).where("copies > 1"))
    # both sides come to the join straight from a shuffle, so a payload that a
    # third of the pages share is split by adaptive execution
    return rows.join(table(shared, "shared-payloads"), "sha1", "left")


def write(pages: DataFrame, folder: str | None = None, *, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``page_id, url, captured (timestamp), html`` as archives below
    ``folder`` (default: a new folder of the shared store); returns
    ``run, path, records, bytes`` per archive."""
    ship(pages.sparkSession)
    folder = folder or new_folder(pages.sparkSession, "archives")

    def archive(batches):
        fs, base = open_store(folder)
        number = TaskContext.get().partitionId()
        name = f"{base}/part-{number:06d}.warc.gz"
        own, n, size = f"{name}.{time.time_ns()}", 0, 0
        with fs.open_output_stream(own, compression=None) as out:
            for r in (x for b in batches for x in b.to_pylist()):
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                member = gzip_member(record(r["page_id"], r["url"], r["captured"], r["payload"].encode(), digest, r["origin"],
                                            r["copies"] > 1 and r["page_id"] != r["origin"]))
                out.write(member)
                n, size = n + 1, size + len(member)
        if not n:
            fs.delete_file(own)
            return
        fs.move(own, name)
        made = {"run": number, "path": f"{folder}/part-{number:06d}.warc.gz", "records": n, "bytes": size}
        yield pa.RecordBatch.from_pylist([made])

    rows = with_origins(pages, min_bytes).select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        "payload", "sha1", F.coalesce("copies", F.lit(1)).alias("copies"), F.col("origin").cast("long").alias("origin"))
    return table(rows.mapInArrow(archive, "run long, path string, records long, bytes long"), "archives")


def gzip_member(raw: bytes) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(stream, at_once: int = 1 << 20):
    """``(offset, length, record)`` of each gzip member of a stream."""
    at, raw = 0, stream.read(at_once)
    while raw:
        z, out, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not raw:
                raise ValueError(f"archive ends inside the record at {at}")
            out.append(z.decompress(raw))
            used += len(raw) - len(z.unused_data)
            raw = z.unused_data or stream.read(at_once)
        yield at, used, b"".join(out)
        at += used


def parse(raw: bytes) -> dict:
    """What the index has of a record; the digest of a response is tested."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(field["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    if field["WARC-Type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {field['WARC-Record-ID']} does not fit its digest")
    page, refers = (int(field[k]) if k in field else None for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
    url = field.get("WARC-Target-URI")
    return {"urlkey": url_key(url), "captured": field["WARC-Date"], "page_id": page, "url": url,
            "record_type": field["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": refers}


KEY = ["urlkey", "captured", "page_id", "offset"]


def order_key(r: dict) -> tuple:
    return r["urlkey"], r["captured"], r["page_id"] is not None, r["page_id"] or 0, r["offset"]


def capture_runs(archives: DataFrame) -> DataFrame:
    """One sorted run of captures per archive of ``run, path``."""
    ship(archives.sparkSession)
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(CAPTURES).fields])

    def index(batches):
        for archive in (x for b in batches for x in b.to_pylist()):
            fs, place = open_store(archive["path"])
            with fs.open_input_stream(place, compression=None) as f:
                found = [parse(raw) | archive | {"offset": at, "length": n} for at, n, raw in members(f)]
            found.sort(key=order_key)
            yield pa.RecordBatch.from_pylist([r | {"pos": k} for k, r in enumerate(found)], schema=schema)

    dealt = archives.select("run", "path").repartition(max(1, archives.count()))
    return table(dealt.mapInArrow(index, CAPTURES), "capture-runs")


class LoserTree:
    """Merge of k sorted lists of keys.  Leaf k + i stands for list i; an inner
    node holds the loser of its match, and ``winner`` the list with the
    smallest head.  Equal heads go by the number of the list."""

    def __init__(self, lists: list[list]) -> None:
        self.lists, self.at = lists, [0] * len(lists)
        self.k = len(lists)
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        over_a, over_b = self.at[a] >= len(self.lists[a]), self.at[b] >= len(self.lists[b])
        if over_a or over_b:
            return over_b and (not over_a or a < b)
        x, y = self.lists[a][self.at[a]], self.lists[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        """``(list, position)`` in merged order."""
        for _ in range(sum(map(len, self.lists))):
            w = self.winner
            yield w, self.at[w]
            self.at[w] += 1
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def merged_index(runs: DataFrame) -> DataFrame:
    """All captures of the runs, with ``part`` and ``seq``: their global order."""

    def merge(batches):
        every = pa.Table.from_batches(batches, schema) if (batches := list(batches)) else None
        if every is None or not every.num_rows:
            return
        keys = list(map(order_key, every.select(KEY).to_pylist()))
        run = every.column("run").to_numpy()
        cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
        tree = LoserTree([keys[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        out = every.take(pa.array([cuts[w] + k for w, k in tree], pa.int64()))
        part = np.full(len(run), TaskContext.get().partitionId())
        yield from out.append_column("part", pa.array(part)).append_column("seq", pa.array(np.arange(len(run)))).to_batches()

    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(CAPTURES).fields])
    # a range's slice of a run comes in the run's own order
    cut = runs.repartitionByRange("urlkey", "captured", "page_id", "offset").sortWithinPartitions("run", "pos")
    return cut.mapInArrow(merge, CAPTURES + ", part long, seq long")


ORACLE = """
with coded as (
  select page_id, coalesce(html, '') payload,
         cast(cast(from_hex(sha1(coalesce(html, ''))) as bit) as varchar) bits
  from pages),
digested as (
  select page_id, octet_length(encode(payload)) payload_bytes,
         list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + cast(list_sum(list_transform(range(0, 5), lambda j: cast(substr(bits, 5 * k + j + 1, 1) as int) * (16 >> j))) as bigint), 1)),
           'string_agg', '') payload_digest
  from coded)
select page_id, cast(payload_bytes as bigint) payload_bytes, payload_digest,
       case when page_id = max(page_id) over same then 'response' else 'revisit' end record_type,
       case when page_id = max(page_id) over same then null else max(page_id) over same end refers_to
from digested window same as (partition by payload_digest)
"""
