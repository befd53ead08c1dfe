"""Validation boundaries, scoring edge cases and NDCG against NumPy."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratecraft.operators import evaluate, score, validate
from ratecraft.sources.requests import parse_requests


def place(pid="p1", price=10.0, rating=4.0, dur=60, **kw):
    d = {"place_id": pid, "place_category": "C", "place_city": "X", "place_price": price,
         "place_average_rating": rating, "place_visit_duration_minutes": dur}
    d.update(kw)
    return d


def req(age=30, places=None, user=True):
    body = {"places": places if places is not None else [place()]}
    if user:
        body["user"] = {"user_age": age}
    return json.dumps(body)


CASES = [
    (1, req(17), "user_age"), (2, req(18), None), (3, req(100), None), (4, req(101), "user_age"),
    (5, req(places=[place(price=-1.0)]), "places"), (6, req(places=[place(rating=0.9)]), "places"),
    (7, req(places=[place(rating=5.1)]), "places"), (8, req(places=[place(dur=29)]), "places"),
    (9, req(places=[]), "place_count"), (10, req(places=[place(f"p{i}") for i in range(51)]),
                                         "place_count"),
    (11, req(places=[place(f"p{i}") for i in range(50)]), None), (12, '{"user": {"user_age": 30}',
                                                                   "malformed"),
    (13, req(user=False), "missing_user"), (14, req(places=[place(price=0.0)]), None),
]


def test_request_validation(spark):
    df = spark.createDataFrame([(i, b) for i, b, _ in CASES], "request_id long, body string")
    st = {r["request_id"]: r["reason"] for r in
          validate.request_status(parse_requests(df)).collect()}
    for i, _, want in CASES:
        assert st[i] == want, (i, st[i], want)


def _ranked(spark, preds):
    rows = [(1, pos, f"p{pos}", p) for pos, p in enumerate(preds)]
    df = spark.createDataFrame(rows, "request_id long, pos int, place_id string, prediction double")
    return score.rank_places(score.score_columns(df))


def test_clip_confidence_rounding_and_ties(spark):
    r = _ranked(spark, [0.2, 6.0, 4.004, 4.0, 3.5]).orderBy("recommendation_rank").collect()
    assert [x["place_id"] for x in r] == ["p1", "p2", "p3", "p4", "p0"]   # 4.00 tie keeps order
    assert r[0]["predicted_rating"] == 5.0 and r[-1]["predicted_rating"] == 1.0
    assert math.isclose(r[-1]["confidence_raw"], 0.8 + 0.2 * (1 - 2.5 / 1.5))
    assert r[3]["confidence_score"] == 1.0                                  # 3.5 -> 1.0
    x = _ranked(spark, [2.675]).first()
    assert x["predicted_rating"] == float(np.round(2.675, 2))               # NumPy rounding


def test_topk_summary_and_diversity(spark):
    r = _ranked(spark, [4.31, 4.32, 2.0])
    s = score.recommend_summary(r, 2).first()
    assert s["total_places_evaluated"] == 3 and s["top_k_requested"] == 2
    assert s["average_predicted_rating"] == round((4.32 + 4.31) / 2, 2)
    assert score.recommend_summary(r, 0).first()["average_predicted_rating"] == 0.0
    assert score.recommend_top_k(r, 0).count() == 0
    with pytest.raises(ValueError):
        score.recommend_top_k(r, -1)
    one = _ranked(spark, [3.0])
    assert score.diversity(one).first()["diversity"] == 0.5
    d = score.diversity(r).first()["diversity"]
    assert math.isclose(d, min(1.0, np.std([4.31, 4.32, 2.0]) / 2))


def test_average_is_rounded_by_its_exact_value(spark):
    """Python's round, for means of two to five hundredths (ties included)."""
    rnd = random.Random(4)
    means = [sum(rnd.randint(100, 500) / 100 for _ in range(n)) / n for n in (2, 3, 4, 5) for _ in range(800)]
    means += [1.005, 1.115, 2.675, 4.315, 1.0, 5.0, 0.0, 2.5, 1.125, 1.375]
    df = spark.createDataFrame([(m,) for m in means], "x double").select("x", score.exact_round(F.col("x")).alias("y"))
    for r in df.collect():
        assert r["y"] == round(r["x"], 2), r


def test_recommend_response_echoes_the_user(spark):
    r = _ranked(spark, [4.0, 3.0]).withColumn("user", F.expr(
        "named_struct('user_age', 30, 'preferred_category', 'C', 'preferred_city', null, 'budget_range', 'low')"))
    body = json.loads(score.recommend_response(r, "m", 1).first()["response"])
    assert body["user_preferences"] == {"user_age": 30, "preferred_category": "C", "budget_range": "low"}
    assert [p["place_id"] for p in body["top_recommendations"]] == ["p0"] and body["model_used"] == "m"
    assert body["recommendation_summary"] == {"total_places_evaluated": 2, "top_k_requested": 1, "average_predicted_rating": 4.0}
    none = json.loads(score.recommend_response(r, "m", 0).first()["response"])
    assert none["top_recommendations"] == []


def test_ndcg_of_equal_scores(spark):
    """All rows in one tie group: every position has the average gain."""
    df = spark.range(1000).select(F.when(F.col("id") % 4 == 0, 5.0).otherwise(1.0).alias("label"), F.lit(2.0).alias("prediction"))
    assert math.isclose(evaluate.ndcg_at_k(df).first()[0], 0.25)


def _ndcg_numpy(y, s, k=10):
    """Tie-averaged NDCG@k of one ranking (independent NumPy version)."""
    g = (np.asarray(y) >= 4.0).astype(float)
    s = np.asarray(s, dtype=float)
    if len(g) <= 1:
        return 0.0
    disc = 1.0 / np.log2(np.arange(len(g)) + 2)
    disc[k:] = 0.0
    cum = np.cumsum(disc)
    uniq, inv, cnt = np.unique(-s, return_inverse=True, return_counts=True)
    avg = np.zeros(len(cnt))
    np.add.at(avg, inv, g)
    avg /= cnt
    ends = np.cumsum(cnt) - 1
    sums = np.diff(np.concatenate([[0.0], cum[ends]]))
    dcg = float((avg * sums).sum())
    ideal = float((np.sort(g)[::-1] * disc).sum())
    return 0.0 if ideal == 0 else dcg / ideal


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ndcg_matches_numpy(spark, seed):
    rnd = random.Random(seed)
    n = 60
    y = [float(rnd.randint(1, 5)) for _ in range(n)]
    s = [round(rnd.uniform(1, 5), 1) for _ in range(n)]   # many ties
    df = spark.createDataFrame(list(zip(y, s)), "label double, prediction double")
    got = evaluate.ndcg_at_k(df).first()[0]
    assert math.isclose(got, _ndcg_numpy(y, s), rel_tol=1e-12, abs_tol=1e-12)


def test_ndcg_nothing_relevant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "label double, prediction double")
    assert evaluate.ndcg_at_k(df).first()[0] == 0.0


def test_binary_and_regression_metrics(spark):
    df = spark.createDataFrame([(4.0, 4.0), (2.0, 4.0), (5.0, 1.0), (1.0, 1.0)],
                               "label double, prediction double")
    b = evaluate.binary_metrics(df).first()
    assert b["precision"] == 0.5 and b["recall"] == 0.5 and b["f1_score"] == 0.5
    m = evaluate.regression_metrics(df).first()
    assert math.isclose(m["mse"], (0 + 4 + 16 + 0) / 4)
    ys = np.array([4.0, 2.0, 5.0, 1.0])
    assert math.isclose(m["r2"], 1 - 20 / ((ys - ys.mean()) ** 2).sum())
    none = spark.createDataFrame([(1.0, 1.0)], "label double, prediction double")
    z = evaluate.binary_metrics(none).first()
    assert z["precision"] == 0.0 and z["recall"] == 0.0 and z["f1_score"] == 0.0


def test_serving_features_defaults_and_stats_struct(spark):
    """Fixed defaults; a stats struct overrides field by field, a missing
    place_mean falls back to the place's rating and place_std to 0.5."""
    from ratecraft.operators.features import feature_columns, serving_features
    from ratecraft.schema import SERVING_STATS
    rows = spark.createDataFrame(
        [(1, 30, 100.0, 4.2, 60, {"global_mean": 3.0, "user_mean": 4.0}),
         (2, 40, 0.0, 3.0, 45, None)],
        "request_id long, user_age int, place_price double, place_average_rating double, "
        f"place_visit_duration_minutes int, stats {SERVING_STATS.simpleString()}")
    d = {r["request_id"]: r for r in
         serving_features(rows).select("request_id", *feature_columns()).collect()}
    assert d[1]["user_mean"] == 3.5 and d[1]["place_count"] == 50.0
    assert math.isclose(d[1]["price_ratio"], 100.0 / (100.0 * 1.1))
    assert d[2]["rating_price_ratio"] == 3.0 and d[2]["price_ratio"] == 1.0
    s = {r["request_id"]: r for r in
         serving_features(rows, "stats").select("request_id", *feature_columns()).collect()}
    assert s[1]["user_mean"] == 4.0 and s[1]["global_mean"] == 3.0
    assert s[1]["place_mean"] == 4.2 and s[1]["place_std"] == 0.5
    assert math.isclose(s[1]["user_place_deviation"], abs(4.0 - 4.2))
    assert s[2]["place_mean"] == 3.0 and s[2]["user_mean"] == 3.5   # null struct -> fallbacks


def test_parse_flags_malformed_and_counts(spark):
    from ratecraft.sources.requests import parse_summary
    df = spark.createDataFrame([(1, req()), (2, '{"user": '), (3, '{"x": 1}'), (4, "[1, 2]")],
                               "request_id long, body string")
    s = parse_summary(parse_requests(df)).first()
    assert s["n_requests"] == 4 and s["n_malformed"] == 2 and s["n_places"] == 1
