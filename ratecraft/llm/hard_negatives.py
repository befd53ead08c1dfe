"""Hard negatives for embedding training, by Fagin's threshold algorithm.

Vectors become integers, ``floor(scale * x)``; a row's score for an anchor is
their inner product, exact in integers.  Higher scores come first, ties by
smaller ``vec_id``.  An anchor's positives are its best other rows of its label;
every positive opens a window of scores, from ``low`` percent of the positive's
score up to it, and its hard negatives are the best rows of other labels in it.

Rows are dealt by hash into blocks and anchors into parts; every part meets
every block once (a stated set of queries against all rows) and a task returns
at most ``k`` rows per window, which are merged per window.  In a block every
dimension has its list of rows sorted by that component.  For an anchor the lists
are read from the end that its component's sign makes best, a stretch of all
lists at a time; rows met for the first time are scored at random access.  No row
still unseen can exceed the threshold, the anchor's product with the values last
read.  The search ends once that lies strictly below each window's kth score - or
below the window's lower end, while it has fewer than k rows.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part; shorter vectors are filled up with zeros; components are
held within ``2 ** 28`` for up to 64 dimensions (less beyond), so that scores fit
64 bits.  A row with a null id takes part, after equal scores of all ids; it is no
anchor where the ``anchor`` condition is null.  Repeated rows are rows of their
own, also beside their own copy.  A window below zero is empty.  An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, table

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW_PERCENT = 80
# Bounds of one task's share: rows of a block, anchors of a part.
BLOCK_ROWS = 32_768
PART_ANCHORS = 4_096
# A block is not made smaller than this to give every core work.
LEAST_BLOCK = 1_024
# Rows read of every list before the threshold is looked at; doubled each time.
FIRST_STRETCH = 16


class Lists:
    """Sorted lists of a block's rows, one a dimension.  ``vectors``: integers,
    in the order that settles ties."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(vectors, self.order, axis=0)
        self.largest = int(np.abs(vectors).max(initial=0))
        self.exact = vectors.astype(np.float64)

    def scorer(self, anchor: np.ndarray):
        """Products in doubles where these are exact, else in 64-bit integers."""
        if self.largest * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 2 ** 53:
            a = anchor.astype(np.float64)
            return lambda rows: (self.exact[rows] @ a).astype(np.int64)
        return lambda rows: self.vectors[rows] @ anchor

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int):
        """Best ``k`` allowed rows of each window ``(low, high)``, as lists of
        ``(row, score)``, and the number of rows scored."""
        n, scored = len(self.vectors), self.scorer(anchor)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        open_ = [w for w, (low, high) in enumerate(windows) if low <= high]
        up = anchor >= 0
        seen = np.zeros(n, bool)
        done, stretch = 0, FIRST_STRETCH
        while open_ and done < n:
            to = min(n, done + stretch)
            met = np.zeros(n, bool)
            met[self.order[n - to:n - done, up]] = True
            met[self.order[done:to, ~up]] = True
            met &= ~seen
            seen |= met
            rows = np.flatnonzero(met & allowed)
            scores = scored(rows)
            threshold = int(np.where(up, self.values[n - to], self.values[to - 1]).astype(object) @ anchor.astype(object)) if len(anchor) else 0
            still = []
            for w in open_:
                low, high = windows[w]
                inside = (scores >= low) & (scores <= high)
                best[w] = first(np.concatenate((best[w][0], rows[inside])), np.concatenate((best[w][1], scores[inside])), k)
                if threshold >= (int(best[w][1][-1]) if len(best[w][1]) == k else low):
                    still.append(w)
            open_, done, stretch = still, to, stretch * 2
        return best, int(seen.sum())


def first(rows: np.ndarray, scores: np.ndarray, k: int):
    """The ``k`` best of rows: by falling score, then by place in the block."""
    if len(rows) > k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        rows, scores = rows[near], scores[near]
    order = np.lexsort((rows, -scores))[:k]
    return rows[order], scores[order]


FOUND = "anchor long, window int, row long, vec_id long, score long"


def best_rows(rows: DataFrame, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """Best ``k`` rows of each window of each anchor, among those of the anchor's
    label or of all others: ``anchor, window, row, vec_id, score, rank``.

    ``rows``: ``row, vec_id, label, vector``; ``anchors``: the same with ``windows``,
    an array of ``(low, high)``."""
    spark = rows.sparkSession
    n, n_anchors = rows.count(), anchors.count()
    size = min(BLOCK_ROWS, max(LEAST_BLOCK, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    blocks, parts = max(1, -(-n // size)), max(1, -(-n_anchors // PART_ANCHORS))
    deal = lambda number, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(number))
    every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)).cast("array<long>"))
    left = rows.select("*", deal(blocks, 1).alias("block")).select("*", every(parts).alias("part"))
    right = anchors.select("*", deal(parts, 2).alias("part")).select("*", every(blocks).alias("block"))

    def meet(block: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(part):
            block = block.sort_values(["vec_id", "row"], na_position="last", kind="stable", ignore_index=True)
            lists = Lists(np.array(block["vector"].to_list(), np.int64).reshape(len(block), -1))
            labels, own = pd.factorize(pd.concat([block["label"], part["label"]], ignore_index=True))[0], block["row"].to_numpy()
            for k_, (row, vector, windows) in enumerate(zip(part["row"], part["vector"], part["windows"], strict=True)):
                alike = labels[:len(block)] == labels[len(block) + k_]
                allowed = (alike if same_label else ~alike) & (own != row)
                best, _ = lists.search(np.asarray(vector, np.int64), allowed, [(w["low"], w["high"]) for w in windows], k)
                out += [pd.DataFrame({"anchor": row, "window": w, "row": own[r], "vec_id": block["vec_id"].to_numpy()[r], "score": s})
                        for w, (r, s) in enumerate(best) if len(r)]
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})

    ship(spark)
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(meet, FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def prepared(rows: DataFrame, scale: int, anchor: Column) -> DataFrame:
    """``row, vec_id, label, vector, is_anchor`` of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    valid = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    numbered = table(valid.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding",
                                  F.coalesce(anchor, F.lit(False)).alias("is_anchor")), "vectors")
    size = numbered.agg(F.max(F.size("embedding"))).first()[0] or 0
    bound = 1 << ((62 - max(6, math.ceil(math.log2(max(1, size))))) // 2)
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(bound)), F.lit(-bound)).cast("int"))
    return numbered.select("row", "vec_id", "label", "is_anchor", F.concat(whole, F.array_repeat(F.lit(0), F.lit(size) - F.size("embedding"))).alias("vector"))


def mine(rows: DataFrame, anchor: Column, *, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low_percent: int = LOW_PERCENT) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` for the rows of ``vec_id, label, embedding`` where ``anchor``
    holds."""
    ship(rows.sparkSession)
    every = table(prepared(rows, scale, anchor), "integers")
    plain = every.select("row", "vec_id", "label", "vector")
    anchors = every.where("is_anchor").select("row", "vec_id", "label", "vector")
    whole = F.array(F.struct(F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high")))
    near = table(best_rows(plain, anchors.withColumn("windows", whole), positives, same_label=True), "positives")
    # few per anchor: their scores in order of rank
    listed = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("near"))
    low = lambda s: F.ceil((s * low_percent).cast("decimal(38,0)") / 100).cast("long")
    windows = F.transform("near", lambda p: F.struct(low(p["score"]).alias("low"), p["score"].alias("high")))
    asked = table(anchors.join(listed, anchors["row"] == listed["anchor"]).select("row", anchors["vec_id"], "label", "vector", windows.alias("windows")), "asked")
    hard = best_rows(plain, asked, negatives, same_label=False).select(
        "anchor", (F.col("window") + 1).alias("of"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    opened = near.select("anchor", F.col("rank").alias("of"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return hard.join(opened, ["anchor", "of"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH plain AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM plain a JOIN plain b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""
