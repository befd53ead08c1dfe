"""Conversation repair against a search over all edits, at several chunk sizes."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from ratecraft.llm import conversations
from ratecraft.llm.common import read

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def naive_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Dijkstra over (rows done, roles so far as a state of the pattern), by cost, then letters."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, k, state, lines = heapq.heappop(heap)
        if k == len(rows) and state in ("", "a"):
            assert PATTERN.fullmatch("".join(line[0] for line in lines))
            return cost, letters, lines
        if (k, state) in done:
            continue
        done.add((k, state))
        for c in "ua":
            if (state, c) in step:
                heapq.heappush(heap, (cost + 5, letters + "I", k, step[state, c], (*lines, f"{name[c]}:")))
        if k == len(rows):
            continue
        role, text, fault = rows[k]
        heapq.heappush(heap, (cost + 2, letters + "D", k + 1, state, lines))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 * (fault == "truncated")
        if role and (state, role[0]) in step:
            heapq.heappush(heap, (cost + more, letters + "K", k + 1, step[state, role[0]], (*lines, f"{role}:{text}")))
        for c in "ua":
            if (state, c) in step:
                heapq.heappush(heap, (cost + 1 + more, letters + "R", k + 1, step[state, c], (*lines, f"{name[c]}:{text}")))


def naive(rows, ids):
    out = {}
    for conv in set(ids):
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(r[2].encode()).hexdigest()))
        seen, judged = set(), []
        for _, role, text in own:
            shown = VISIBLE.findall(text)
            judged.append((role, text, "blank" if not shown else "duplicate" if (role, text) in seen
                           else None if shown[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        faults = [f for _, _, f in judged]
        roles = [r[:1] for _, r, _ in own]
        cost, letters, lines = cheapest(judged)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, letters,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(got) == len(rows)
    return got


def random_rows(seed, conversations_, longest):
    draw = random.Random(seed)
    texts = ["Yes.", "no", "", " \n", "Why?", "Well!  ", "a.b", "\x0b", "é。", "end. "]
    return [(c, t if draw.random() < 0.9 else None, draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]),
             draw.choice([draw.choice(texts), f"{draw.randint(0, 9)} words.", f"cut {draw.randint(0, 9)}"]) if draw.random() < 0.95 else None)
            for c in range(conversations_) for t in range(draw.randint(1, longest))]


@pytest.mark.parametrize("chunk_rows, partitions", [(512, 1), (3, 4), (1, 7)])
def test_matches_brute_force(spark, chunk_rows, partitions):
    rows = random_rows(chunk_rows, 60, 14) + [(None, 3, "user", "Hi."), (None, None, "user", "Hi."), (10**15, 5, "system", "Rules.")]
    rows += [(999, t, "user", "same.") for t in range(40)] + [(999, 7, "user", "same.")] * 5 + [(998, None, "assistant", f"{k}.") for k in range(30)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = found(conversations.repair(df, chunk_rows=chunk_rows))
        hurt = found(conversations.repair(conversations.damaged(df), df.select("conv_id"), chunk_rows=chunk_rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ids = [r[0] for r in rows]
    assert got == naive(rows, ids)
    assert hurt == naive(naive_damage(rows), ids)


def test_query_matches_brute_force(spark):
    from ratecraft.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = naive(naive_damage(rows), [r[0] for r in rows])
    got = found(QUERIES["op13_conversation_repair"](spark, sf))
    assert got == want
    assert len({v[6] for v in got.values()}) > 3


def test_conversation_without_rows_and_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    ids = spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert found(conversations.repair(none, ids)) == {1: empty, None: empty}
    assert conversations.repair(none).count() == 0


def test_very_long_texts_repeated_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, k, ["user", "assistant"][k % 2], f"{k} " + "long text " * 200_000 + ".") for k in range(6)] + [(1, 6, "user", "x.")] * 3
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("own").alias(c) for c in ("conv", "slice", "chunk", "mark", "row", "kind", "rows", "is_null")])
    assert found(conversations.repair(df, chunk_bytes=1 << 20)) == naive(rows, [1])
    assert found(conversations.repair(df)) == naive(rows, [1])
