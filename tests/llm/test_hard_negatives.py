"""Hard negatives against brute force, beyond the query's SQL."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratecraft.llm import hard_negatives
from ratecraft.llm.hard_negatives import Lists, mine

SCHEMA = "vec_id long, label int, embedding array<float>"


def naive(rows, k=5):
    own = [(v, label, [math.floor(256 * x) for x in e]) for v, label, e in rows
           if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (anchor, label, x) in enumerate(own):
        if anchor is None or anchor % 10:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), v, b == label) for j, (v, b, y) in enumerate(own) if j != a]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for ps, pv, _ in [s for s in scored if s[2]][:k]:
            hard = [s for s in scored if not s[2] and 80 * ps <= 100 * s[0] <= 100 * ps][:k]
            out += [(anchor, pv, r + 1, nv, ps, ns) for r, (ns, nv, _) in enumerate(hard)]
    return sorted(out, key=str)


def vectors(seed, n, d, spread=0.2):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    return [(v, draw.randint(0, 3), [float(np.float32(c + draw.gauss(0, spread))) for c in centres[draw.randint(0, 3)]]) for v in range(n)]


def found(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize("block, part", [(32_768, 4_096), (16, 3)])
def test_matches_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "PART_ANCHORS", part)
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", 1)
    rows = vectors(1, 150, 6) + [(v, v % 4, [0.5] * 6) for v in range(150, 190)]  # many ties
    rows += [(200, None, [1.0] * 6), (210, 1, None), (220, 1, [float("nan")] * 6), (230, 1, [None] + [1.0] * 5), (240, 2, [float("inf")] + [0.0] * 5),
             (250, 1, [0.0] * 6), (260, 2, [1.0, 1.0]), (270, 3, []), (280, 1, [-1.0] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("own").alias(c) for c in ("row", "vector", "anchor", "windows", "block", "is_anchor")])
    assert found(mine(df.repartition(3), F.col("vec_id") % 10 == 0)) == naive(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, 1, [1.0, 0.0]), (10, 1, [1.0, 0.0]), (10, 1, [1.0, 0.0]), (3, 2, [0.9, 0.0]), (None, 2, [0.9, 0.0])]
    got = found(mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0))
    assert got == naive(rows) and len(got) == 8
    assert mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


def test_very_large_components_are_held(spark):
    rows = [(10, 1, [3e38, 1.0]), (1, 1, [3e38, 0.0]), (2, 2, [2e38, 0.0])]
    held = 1 << 28
    got = found(mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0))
    assert got == [(10, 1, 1, 2, held * held, held * held)]


def test_search_ends_before_all_rows_are_scored():
    draw = np.random.default_rng(3)
    many = np.floor(256 * draw.exponential(0.05, (20_000, 4))).astype(np.int64) * draw.choice([-1, 1], (20_000, 4))
    lists = Lists(many)
    anchor = np.array([200, -30, 90, 0])
    scores = many @ anchor
    best, scored = lists.search(anchor, np.ones(len(many), bool), [(-(1 << 62), 1 << 62)], 5)
    order = sorted(range(len(many)), key=lambda r: (-scores[r], r))[:5]
    assert best[0][0].tolist() == order and best[0][1].tolist() == scores[order].tolist()
    assert scored < len(many) / 4
    top = int(scores[order[0]])
    window = (int(0.3 * top), int(0.4 * top))
    best, _ = lists.search(anchor, np.ones(len(many), bool), [window, (5, 4)], 5)
    inside = sorted((r for r in range(len(many)) if window[0] <= scores[r] <= window[1]), key=lambda r: (-scores[r], r))[:5]
    assert best[0][0].tolist() == inside and len(best[1][0]) == 0
