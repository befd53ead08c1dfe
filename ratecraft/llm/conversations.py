"""Repair of conversation structure at least cost.

A conversation is its rows by turn (nulls first; within a turn by role, text).  Its role
initials should read ``(s?(ua)+)?``.  Every row is kept, given another role or deleted, and
empty rows may be inserted anywhere; the cheapest edits win, and of equally cheap ones those
whose initials (D, I, K, R) are least as a string.

Edits are a shortest path through a small graph: its nodes are a place between rows and one of
four states (start, after a system, a user or an assistant row).  A path's weight is one
integer: the cost in the high digits, and below them one fixed-width digit per edit letter, from
the first letter down, zeros after the last.  The least integer is the cheapest path with the
least letters, found from the end backwards; putting an edit in front moves the digits down.

Rows are sorted over the whole table by ranges, so a conversation of any length is spread over
tasks.  One that lies inside a range, with at most ``CHUNK_ROWS`` rows and ``CHUNK_BYTES`` of
text, is done there.  All others are cut into chunks.  A chunk's item holds, for every state
before and after it, the least cost and its letters; letters of one state before are never the
start of one another (each path ends with the last row's edit), so their order among at most
four is all that a level above needs.  Chunks are joined to one item per range, these (one row
per conversation and range) to the conversation, by the same integer minimum, and the states
chosen are handed down again.  Only the last digest reads a conversation in order in one task,
batch by batch, because SHA-256 has no other form.

Defined results: null roles and texts count as one space; rows with null ``conv_id`` are one
conversation; repeated rows stay rows of their own (the second is a duplicate); a conversation
without rows has zeros, no letters and the hash of nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import ship, table

CHUNK_ROWS = 512
CHUNK_BYTES = 8 << 20
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
# Digits in the order of the letters; 0 ends them.
CODE = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = str.maketrans("1234", "DIKR")
DIGIT = 3
SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# The state that a role initial leads to, by state; what is missing is not allowed.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
# The state after an empty row is inserted, and its role.
INSERTED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
CLEAN, BLANK, DUPLICATE, CUT_OFF = range(4)
LEGAL = {"su", "ua", "au"}


def edits(initial: str, fault: int) -> list[list[tuple[int, str, int]]]:
    """Per state before a row: ``(cost, letters, state after)`` of every way to insert before
    the row (two rows at most: three never pay) and then edit it."""
    more = TRUNCATED if fault == CUT_OFF else 0
    ways = []
    for state in STATES:
        own, at = [], state
        for n in range(3):
            put, cost = "I" * n, n * INSERT
            own.append((cost + DELETE, put + "D", at))
            if fault not in (BLANK, DUPLICATE):
                if initial in NEXT[at]:
                    own.append((cost + more, put + "K", NEXT[at][initial]))
                own.append((cost + REROLE + more, put + "R", INSERTED[at]))
            at = INSERTED[at]
        ways.append(own)
    return ways


_EDITS = {(i, f): edits(i, f) for i in ("s", "u", "a", "") for f in range(4)}


def row_edits(role: str, fault: int):
    return _EDITS[role[:1] if role[:1] in ("s", "u", "a") else "", fault]


# What may follow the last row: nothing, or rows that finish the pattern.
ENDS = {START: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}


def least(steps: list, ends: dict[int, tuple[int, str]], room: int) -> list[int | None]:
    """Weight of the cheapest path from each state before the first step to an end.
    ``steps``: per step the ways of every state; ``room``: digits for the letters."""
    width = room * DIGIT
    low = (1 << width) - 1

    def before(cost: int, letters: str, weight: int) -> int:
        digits = weight & low
        for c in reversed(letters):
            digits = digits >> DIGIT | CODE[c] << (width - DIGIT)
        return (weight >> width) + cost << width | digits

    at = [before(*ends[s], 0) if s in ends else None for s in STATES]
    for ways in reversed(steps):
        at = [min((before(cost, letters, at[after]) for cost, letters, after in ways[s] if at[after] is not None), default=None)
              for s in STATES]
    return at


def decoded(weight: int, room: int) -> tuple[int, str]:
    width = room * DIGIT
    digits = oct(weight & ((1 << width) - 1))[2:].zfill(room)
    return weight >> width, digits.rstrip("0").translate(LETTERS)


def matrix(steps: list) -> list[list[tuple[int, str] | None]]:
    """Least cost and letters of the paths through ``steps`` by state before and after."""
    room = 3 * len(steps) + 1
    columns = [least(steps, {after: (0, "")}, room) for after in STATES]
    return [[None if columns[a][s] is None else decoded(columns[a][s], room) for a in STATES] for s in STATES]


def replay(rows: list[tuple[str, str]], state: int, letters: str) -> tuple[list[str], int]:
    """The repaired rows as ``role:text``, and the state after them."""
    out, k = [], 0
    for c in letters:
        if c == "I":
            state = INSERTED[state]
            out.append(f"{ROLES[state]}:")
            continue
        role, text = rows[k]
        k += 1
        if c == "D":
            continue
        state = NEXT[state][role[:1]] if c == "K" else INSERTED[state]
        out.append(f"{role if c == 'K' else ROLES[state]}:{text}")
    return out, state


# --- items of several rows: costs and the order of the letters, by state before and after

def item(found: list[list[tuple[int, str] | None]]) -> tuple[list[int], list[int]]:
    """Flat costs and ranks (-1: no path) of a matrix."""
    costs, ranks = [], []
    for row in found:
        order = sorted({x[1] for x in row if x is not None})
        costs += [-1 if x is None else x[0] for x in row]
        ranks += [-1 if x is None else order.index(x[1]) for x in row]
    return costs, ranks


# A rank's letter: four ranks, the same four digits.
RANKS = "DIKR"


def item_ways(costs, ranks):
    """An item's ways, as those of a row."""
    return [[(int(costs[4 * s + a]), RANKS[int(ranks[4 * s + a])], a) for a in STATES if costs[4 * s + a] >= 0] for s in STATES]


def chosen(steps: list, state: int, letters: str) -> list[tuple[int, int]]:
    """State before and after each step of a path whose letters are ranks."""
    out = []
    for ways, c in zip(steps, letters, strict=True):
        after = next(a for _, letter, a in ways[state] if letter == c)
        out.append((state, after))
        state = after
    return out


COUNTS = ("blank", "duplicate", "truncated", "illegal", "distinct")


class Tally:
    """Counts of consecutive rows that can be added up in order."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_role = self.last_role = self.first_turn = self.last_turn = None

    def add(self, counts: dict, first_role, last_role, first_turn, last_turn) -> None:
        for c in COUNTS:
            self.counts[c] += int(counts[c])
        if self.last_role is not None and first_role is not None:
            self.counts["illegal"] += self.last_role + first_role not in LEGAL
        if first_turn is not None and first_turn == self.last_turn:
            self.counts["distinct"] -= 1
        if first_role is not None:
            self.first_role, self.last_role = first_role if self.first_role is None else self.first_role, last_role
        if first_turn is not None:
            self.first_turn, self.last_turn = first_turn if self.first_turn is None else self.first_turn, last_turn

    def row(self, role: str, turn: int | None, fault: int) -> None:
        counts = {"blank": fault == BLANK, "duplicate": fault == DUPLICATE, "truncated": fault == CUT_OFF, "illegal": 0,
                  "distinct": turn is not None}
        self.add(counts, role[:1], role[:1], turn, turn)

    def result(self) -> dict:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.counts["distinct"]
        return {"gaps": gaps, **{c: self.counts[c] for c in COUNTS[:-1]}}

    def fields(self) -> dict:
        return {**self.counts, "first_role": self.first_role, "last_role": self.last_role,
                "first_turn": self.first_turn, "last_turn": self.last_turn}


def _optional(value):
    return None if value is None or value != value else value


def added(rows: list[dict]) -> Tally:
    out = Tally()
    for r in rows:
        turns = [None if (t := _optional(r[c])) is None else int(t) for c in ("first_turn", "last_turn")]
        out.add(r, _optional(r["first_role"]), _optional(r["last_role"]), *turns)
    return out


KEY = ["conv", "is_null"]
PLACE = [*KEY, "slice", "chunk"]
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
DIGEST = "audit string, repaired_sha256 string"
TALLY = ", ".join(f"{c} long" for c in COUNTS) + ", first_role string, last_role string, first_turn long, last_turn long"
ITEM = f"{TALLY}, costs array<long>, ranks array<int>"
KEYS = "conv long, is_null boolean, slice int, chunk int"
CHUNK = "turns array<long>, roles array<string>, texts array<string>, faults array<int>"


def fault_of(text: str) -> int:
    left = text.strip(SPACES)
    return BLANK if not left else CLEAN if left[-1] in ".!?" else CUT_OFF


def finished(rows: list[tuple]) -> dict:
    """The result of a whole conversation: ``(turn, role, text, fault)`` in order."""
    tally = Tally()
    for turn, role, _, fault in rows:
        tally.row(role, turn, fault)
    room = 3 * len(rows) + 3
    cost, letters = decoded(least([row_edits(r[1], r[3]) for r in rows], ENDS, room)[START], room)
    lines, _ = replay([(r[1], r[2]) for r in rows], START, letters)
    return {**tally.result(), "cost": cost, "audit": letters, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def joined(rows: list[dict]) -> dict:
    """The item of consecutive items."""
    costs, ranks = item(matrix([item_ways(r["costs"], r["ranks"]) for r in rows]))
    return {**added(rows).fields(), "costs": costs, "ranks": ranks}


def batches_of(ddl: str):
    """A function that makes Arrow batches of dicts, and nulls of what they lack."""
    schema = StructType.fromDDL(ddl)
    fields = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

    def make(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in fields], names=[c for c, _ in fields])

    return make


def first_pass(ordered: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Results of the conversations that lie inside a range, and chunks of the others (the first
    and the last one of each range may go on in the next, and so count as others)."""
    schema = f"{KEYS}, {CHUNK}, {RESULT}, {DIGEST}"
    batch = batches_of(schema)
    columns = ["conv", "is_null", "mark", "turn", "role", "text"]

    def rows(batches):
        for b in batches:
            yield from zip(*[b.column(c).to_pylist() for c in columns], strict=True)

    def cut(group, key):
        """Chunks of a conversation's rows; a conversation without rows has an empty one."""
        chunk, size, seen, k = [], 0, set(), 0
        for _, _, mark, turn, role, text in group:
            if not mark:
                continue
            if len(chunk) >= chunk_rows or size >= chunk_bytes:
                yield {**key, "chunk": k, "rows": chunk, "size": size}
                chunk, size, k = [], 0, k + 1
            digest = hashlib.md5(f"{role}:{text}".encode() + len(role).to_bytes(4, "little")).digest()
            fault = fault_of(text)
            chunk.append((turn, role, text, DUPLICATE if fault != BLANK and digest in seen else fault))
            seen.add(digest)
            size += len(text) + 64
        yield {**key, "chunk": k, "rows": chunk, "size": size}

    def listed(chunk: dict) -> dict:
        turns, roles, texts, faults = map(list, zip(*chunk["rows"], strict=True)) if chunk["rows"] else ([], [], [], [])
        return {**chunk, "turns": turns, "roles": roles, "texts": texts, "faults": faults}

    def passed(batches):
        number = TaskContext.get().partitionId()
        out, size = [], 0
        first, waiting = True, None  # waiting: a short conversation, the last one so far
        for (conv, is_null), group in groupby(rows(batches), key=lambda r: r[:2]):
            if waiting is not None:
                out.append({**waiting, **finished(waiting["rows"])})
            waiting, longer = None, False
            chunks = cut(group, {"conv": conv, "is_null": is_null, "slice": number})
            held = next(chunks)
            for chunk in chunks:
                out.append(listed(held))
                size += held["size"]
                held, longer = chunk, True
                if size >= chunk_bytes:
                    yield batch(out)
                    out, size = [], 0
            if first or longer:
                out.append(listed(held))
                size += held["size"]
            else:
                waiting = held
            first = False
            if size >= chunk_bytes or len(out) >= 4096:
                yield batch(out)
                out, size = [], 0
        if waiting is not None:
            out.append(listed(waiting))
        if out:
            yield batch(out)

    return ordered.select(*columns).mapInArrow(passed, schema)


def settled(chunks: DataFrame) -> DataFrame:
    """Chunks with the duplicates of earlier ranges and chunks marked, and their items."""
    same = F.md5(F.concat_ws(":", F.length("line.roles").cast("string"), "line.roles", "line.texts")).alias("same")
    lines = chunks.select(*PLACE, F.posexplode(F.arrays_zip("roles", "texts", "faults")).alias("pos", "line")).where(
        F.col("line.faults") != BLANK).select(*PLACE, "pos", same)
    place = F.struct("slice", "chunk", "pos")
    firsts = lines.groupBy(*KEY, "same").agg(F.min(place).alias("first"))
    later = lines.join(firsts, [*KEY, "same"]).where(place > F.col("first")).groupBy(*PLACE).agg(F.collect_list("pos").alias("later"))
    schema = f"{KEYS}, roles array<string>, texts array<string>, {ITEM}, letters array<string>"
    batch = batches_of(schema)

    def judged(batches):
        for b in batches:
            for r in b.to_pylist():
                faults = list(r["faults"])
                for k in r["later"] or []:
                    faults[k] = DUPLICATE
                tally = Tally()
                for row in zip(r["roles"], r["turns"], faults, strict=True):
                    tally.row(*row)
                found = matrix([row_edits(role, fault) for role, fault in zip(r["roles"], faults, strict=True)])
                costs, ranks = item(found)
                yield batch([{**r, **tally.fields(), "costs": costs, "ranks": ranks,
                              "letters": [None if x is None else x[1] for row in found for x in row]}])

    return table(chunks.join(later, PLACE, "left").select(*PLACE, "turns", "roles", "texts", "faults", "later").mapInArrow(judged, schema), "chunk-items")


def records(rows: pd.DataFrame, order: list[str]) -> list[dict]:
    return rows.sort_values(order).to_dict("records")


def of_chunks(chunks: DataFrame) -> DataFrame:
    """Results of the conversations that are cut into chunks."""
    slim = chunks.drop("roles", "texts", "letters")
    names = _names(ITEM)

    def range_item(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip([*KEY, "slice"], key, strict=True)), **joined(records(rows, ["chunk"]))}])

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items = records(rows, ["slice"])
        steps = [item_ways(r["costs"], r["ranks"]) for r in items]
        room = len(steps) + 3
        cost, letters = decoded(least(steps, ENDS, room)[START], room)
        path = chosen(steps, START, letters[:len(steps)])
        result = {**dict(zip(KEY, key, strict=True)), **added(items).result(), "cost": cost}
        return pd.DataFrame([{**result, "slice": r["slice"], "before": s, "after": t} for r, (s, t) in zip(items, path, strict=True)])

    def inside(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items = records(rows, ["chunk"])
        steps = [item_ways(r["costs"], r["ranks"]) for r in items]
        room = len(steps) + 1
        _, letters = decoded(least(steps, {int(items[0]["after"]): (0, "")}, room)[int(items[0]["before"])], room)
        path = chosen(steps, int(items[0]["before"]), letters)
        return pd.DataFrame([{**{c: r[c] for c in PLACE}, "before": s, "after": t} for r, (s, t) in zip(items, path, strict=True)])

    ranges = slim.groupBy(*KEY, "slice").applyInPandas(range_item, f"conv long, is_null boolean, slice int, {ITEM}")
    # one row per conversation and range
    solved = table(ranges.groupBy(*KEY).applyInPandas(whole, f"conv long, is_null boolean, {RESULT}, slice int, before int, after int"), "ranges")
    given = slim.select(*PLACE, "costs", "ranks").join(solved.select(*KEY, "slice", "before", "after"), [*KEY, "slice"])
    states = given.groupBy(*KEY, "slice").applyInPandas(inside, f"{KEYS}, before int, after int")
    written = chunks.select(*PLACE, "roles", "texts", "letters").join(states, PLACE)
    columns = [*KEY, "roles", "texts", "letters", "before", "after"]
    schema = f"conv long, is_null boolean, {DIGEST}"
    batch = batches_of(schema)

    def read(batches):
        for b in batches:
            yield from zip(*[b.column(c).to_pylist() for c in columns], strict=True)

    def digest(batches):
        for (conv, is_null), group in groupby(read(batches), key=lambda r: r[:2]):
            sha, audit, state, any_ = hashlib.sha256(), [], START, False
            for _, _, roles, texts, letters, before, after in group:
                own = letters[4 * before + after]
                lines, state = replay(list(zip(roles, texts, strict=True)), before, own)
                audit.append(own)
                for line in lines:
                    sha.update(b"\n" * any_ + line.encode())
                    any_ = True
            lines, _ = replay([], state, ENDS[state][1])
            for line in lines:
                sha.update(b"\n" * any_ + line.encode())
            yield batch([{"conv": conv, "is_null": is_null, "audit": "".join(audit) + ENDS[state][1], "repaired_sha256": sha.hexdigest()}])

    texts = written.repartition(*KEY).sortWithinPartitions(*PLACE).select(*columns).mapInArrow(digest, schema)
    return solved.select(*KEY, *_names(RESULT)).distinct().join(texts, KEY)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` with faults put in by a checksum of their place."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    own = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return own.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def repair(rows: DataFrame, ids: DataFrame | None = None, *, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` per
    conversation of ``rows`` (``conv_id, turn, role, text``) and of ``ids`` (``conv_id``)."""
    ship(rows.sparkSession)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    key = [F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("is_null")]
    own = rows.select(*key, F.lit(1).alias("mark"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"),
                      F.monotonically_increasing_id().alias("row"))
    # every conversation has a mark in front, so that one without rows is not lost
    nothing = [F.lit(0).alias("mark"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("row")]
    marks = (rows if ids is None else ids).select(*key).distinct().select("*", *nothing)
    order = [*KEY, "mark", F.col("turn").asc_nulls_first(), "role", F.left("text", F.lit(32)), F.md5("text"), "row"]
    ordered = own.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order)
    passed = table(first_pass(ordered, chunk_rows, chunk_bytes), "conversations")
    done = passed.where("repaired_sha256 is not null").select(*KEY, *_names(RESULT), *_names(DIGEST))
    others = of_chunks(settled(passed.where("repaired_sha256 is null").select(*PLACE, *_names(CHUNK))))
    return done.unionByName(others).select(F.when(~F.col("is_null"), F.col("conv")).alias("conv_id"), *_names(RESULT), *_names(DIGEST))
