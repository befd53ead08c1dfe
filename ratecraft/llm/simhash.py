"""SimHash near-duplicates: 64-bit fingerprints linked by BK-trees.

A document's fingerprint has a bit set if more than half of its shingles'
hashes (XXH64, seed 42) have it set.  Documents of one fingerprint form one
class.  Classes that differ in at most ``radius`` bits are found in shards:
cut into ``radius + 1`` bands, two such fingerprints agree in at least one
band, so each fingerprint goes to one shard per band (the band's number and
bits).  A shard with more than ``max_shard`` fingerprints is cut again, up to
``max_depth`` times in all, by bands of the bits that are still free, which
loses no link either.
In each shard a BK-tree takes the fingerprints one after another: a child
hangs on its parent by their integer Hamming distance, and a search follows
only edges within ``radius`` of its own distance to the node.  A tree lives in
the task of its shard; sending all trees everywhere would mean to collect
every fingerprint in the driver.  Links between fingerprints that a shard has
already connected are left out, so a shard of n gives less than n links.

Defined results: a null or empty text has no shingle and the fingerprint zero,
which is linked like any other; a null id counts as the largest; repeated rows
are members of the same class; an empty table gives an empty result; other
columns are ignored unless asked for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, sheltered, table
from .graph import components, follow

SHINGLE = 4
RADIUS = 4
SEED = 42
MAX_SHARD = 4096
BITS = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number; A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-shingle] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        bits = np.unpackbits(np.array(hashes[i:i + 65_536], np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (default ``doc_id``) and ``fp``, the fingerprint
    as a signed long."""

    def prints(texts):
        return [np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)]

    return beside(docs, keep or ["doc_id"], ["text"], "fp long", prints)


class BKTree:
    """Nodes 0, 1, ... of one tree: values and, per node, children by distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Nodes within ``radius`` of ``value``."""
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            node = stack.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            stack.extend(child for edge, child in children[node].items() if -radius <= edge - d <= radius)
        return found

    def add(self, value: int) -> int:
        """Hang a new value into the tree; returns its node."""
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        node = 0
        while node != new:
            node = self.children[node].setdefault((self.values[node] ^ value).bit_count(), new)
        return new


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links between the distinct ``values`` that connect exactly what all
    links within ``radius`` connect."""
    tree, out = BKTree(), []
    root: list[int] = []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for v in values:
        near = tree.near(v, radius)
        new = tree.add(v)
        root.append(new)
        for node in near:
            a = top(node)
            if a != top(new):
                out.append((tree.values[node], v))
                root[a] = top(new)
    return out


def bands(width: int, n: int) -> list[tuple[int, int]]:
    """``n`` (start, length) parts of ``width`` bits."""
    cuts = [width * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def cuts(depth: int, n: int) -> list[dict[int, list[int]]]:
    """Per level: masks of the bits that a shard fixes -> the masks of the
    ``n`` parts into which its other bits are cut."""
    levels, fixed = [], [0]
    for _ in range(depth):
        level = {}
        for mask in fixed:
            free = [k for k in range(BITS) if not mask >> k & 1]
            level[mask] = [sum(1 << k for k in free[a:a + size]) for a, size in bands(len(free), n)]
        levels.append(level)
        fixed = sorted({mask | part for mask, parts in level.items() for part in parts})
    return levels


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _cut(rows: DataFrame, level: dict[int, list[int]]) -> DataFrame:
    """Send each fingerprint of a shard to one narrower shard per part of the
    bits that the shard leaves free.  A shard is named by a hash; two that
    share a name are merely searched together."""
    out = []
    for fixed, parts in level.items():
        own = rows if len(level) == 1 else rows.where(F.col("fixed") == F.lit(signed(fixed)))
        masks = F.array(*[F.struct(F.lit(signed(p)).alias("part"), F.lit(signed(fixed | p)).alias("fixed")) for p in parts])
        cut = own.select("fp", "shard", F.explode(masks).alias("m"))
        out.append(cut.select("fp", F.xxhash64("shard", "m.part", F.col("fp").bitwiseAND(F.col("m.part"))).alias("shard"),
                              F.col("m.fixed").alias("fixed")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def links(classes: DataFrame, *, radius: int = RADIUS, max_shard: int = MAX_SHARD, max_depth: int = 3) -> DataFrame:
    """``a, b``: links between the distinct fingerprints in ``fp`` that connect
    exactly the classes within ``radius`` of each other."""
    levels = cuts(max_depth, radius + 1)
    start = classes.select("fp", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("fixed"))
    shards, ready = table(_cut(start, levels[0]), "shards"), []
    for level in levels[1:]:
        big = table(shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_shard)
                    .select("shard"), "big-shards")
        if big.isEmpty():
            break
        ready.append(shards.join(big, "shard", "left_anti"))
        shards = table(_cut(shards.join(big, "shard", "left_semi"), level), "shards")
    rows = shards
    for more in ready:
        rows = rows.unionByName(more)
    bundles = max(8, classes.count() * (radius + 1) // 20_000)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard", "fp"])
        shard, values = pdf["shard"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        ends = np.concatenate((np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]))
        out, a = [], 0
        for b in ends.tolist():
            if b - a > 1:
                out += shard_links(values[a:b].tolist(), radius)
            a = b
        both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    # most shards are small, so they travel in bundles, each shard whole
    bundle = F.pmod(F.col("shard"), F.lit(bundles))
    return rows.select("fp", "shard", bundle.alias("bundle")).groupBy("bundle").applyInPandas(search, "a long, b long")


def class_components(prints: DataFrame, **options) -> DataFrame:
    """``fp, root, component_id``: for each distinct fingerprint the group that
    links connect it to, and the smallest id of that group's documents."""
    classes = table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes, **options))
    rooted = table(follow(classes.withColumn("root", F.col("fp")), "root", roots), "rooted-classes")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return table(rooted.join(least, "root").select("fp", "root", "component_id"), "class-components")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, **options) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``, the
    smallest id that links reach (null if all of these are null)."""
    prints = table(fingerprints(docs, shingle=shingle), "fingerprints")
    return prints.join(class_components(prints, **options), "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, *, shingle: int = SHINGLE, **options) -> DataFrame:
    """The rows of ``docs``, their columns unchanged, of which each group of
    near copies keeps the one with the smallest id (any one of equal ids)."""
    rows, back = sheltered(docs, "doc_id", "text")
    rows = table(fingerprints(rows.withColumn("row", F.monotonically_increasing_id()), shingle=shingle,
                              keep=[*rows.columns, "row"]), "fingerprinted")
    prints = rows.select("row", "doc_id", "fp")
    first = prints.join(class_components(prints, **options), "fp").groupBy("root").agg(
        F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    return back(rows.join(first.select("row"), "row", "left_semi"))
