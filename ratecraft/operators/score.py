"""Clip, confidence, rounding, per-request ranking and top-K.

Ranking windows are partitioned by request; a valid request holds at most
50 places (O8), so every window partition and every per-request list is
bounded by that cap whatever the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (CONFIDENCE_BASE, CONFIDENCE_CENTER, CONFIDENCE_HALF_RANGE,
                         CONFIDENCE_SPAN, CONFIDENCE_DIGITS, DEFAULT_TOP_K,
                         RATING_DIGITS, RATING_MAX, RATING_MIN, SINGLE_PLACE_DIVERSITY)
from ..functions import half_even

REQ = "request_id"


def clip_rating(p: Column) -> Column:
    """O44 max(1, min(5, p))."""
    return F.greatest(F.lit(RATING_MIN), F.least(F.lit(RATING_MAX), p))


def confidence(clipped: Column) -> Column:
    """O45 0.8 + 0.2 * (1 - |p - 3.5| / 1.5) on the unrounded clipped value."""
    return F.lit(CONFIDENCE_BASE) + F.lit(CONFIDENCE_SPAN) * (
        F.lit(1.0) - F.abs(clipped - F.lit(CONFIDENCE_CENTER)) / F.lit(CONFIDENCE_HALF_RANGE))


def score_columns(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """``confidence_raw`` (histogram input), ``predicted_rating``
    (2 digits) and ``confidence_score`` (3 digits), NumPy half-even."""
    clipped = clip_rating(F.col(prediction))
    conf = confidence(clipped)
    return df.withColumns({
        "confidence_raw": conf,
        "predicted_rating": half_even(clipped, RATING_DIGITS),
        "confidence_score": half_even(conf, CONFIDENCE_DIGITS)})


def rank_places(scored: DataFrame, request: str = REQ) -> DataFrame:
    """O47 rank 1..n per request: rounded rating descending, ties keep the
    input order (``pos``), as a stable sort does."""
    w = Window.partitionBy(request).orderBy(F.col("predicted_rating").desc(), F.col("pos"))
    return scored.withColumn("recommendation_rank", F.row_number().over(w))


def top_recommendation(ranked: DataFrame) -> DataFrame:
    """O48 best place of each request (rank 1)."""
    return ranked.where(F.col("recommendation_rank") == 1)


def recommend_top_k(ranked: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """O49 first min(k, n) ranked places; k = 0 gives none, k < 0 is rejected.

    ``rank <= k`` over the rank window lets Spark plan a window group limit.
    """
    if k < 0:
        raise ValueError("top_k must be >= 0")
    return ranked.where(F.col("recommendation_rank") <= k)


def exact_round(x: Column) -> Column:
    """Round 0 <= x < 8 to 2 digits by the exact value of the double (half to
    even), as Python's ``round`` does: ``x * 2**52`` is a whole number, so
    hundredths and remainder are integers."""
    whole = (x * F.lit(float(1 << 52))).cast("long") * F.lit(100)
    q, r = F.shiftright(whole, 52), F.pmod(whole, F.lit(1 << 52))
    up = (r > F.lit(1 << 51)) | ((r == F.lit(1 << 51)) & (F.pmod(q, F.lit(2)) == 1))
    return (q + F.when(up, 1).otherwise(0)) / F.lit(100.0)


def recommend_summary(ranked: DataFrame, k: int = DEFAULT_TOP_K,
                      request: str = REQ) -> DataFrame:
    """O50 per request: places evaluated, k requested, mean of the top-k
    rounded ratings (2 digits by the exact value, 0.0 if none).

    The top-k ratings (at most k) are summed in rank order, the order the
    original adds them in, so the result does not depend on partitioning.
    """
    if k < 0:
        raise ValueError("top_k must be >= 0")
    top = F.collect_list(F.when(F.col("recommendation_rank") <= k, F.struct(
        "recommendation_rank", "predicted_rating")))
    agg = ranked.groupBy(request).agg(F.count(F.lit(1)).alias("total_places_evaluated"),
                                      F.array_sort(top).alias("_top"))
    total = F.aggregate(F.col("_top"), F.lit(0.0), lambda acc, x: acc + x["predicted_rating"])
    n = F.size("_top")
    avg = F.when(n > 0, exact_round(total / n)).otherwise(F.lit(0.0))
    return agg.select(request, "total_places_evaluated",
                      F.lit(k).alias("top_k_requested"),
                      avg.alias("average_predicted_rating"))


def diversity(scored: DataFrame, request: str = REQ) -> DataFrame:
    """O52 min(1, population std of rounded ratings / 2); 0.5 for one place.

    The ratings are whole hundredths, so the variance is computed in integers
    (n * sum of squares - square of the sum): the result does not depend on
    the order in which partitions are added."""
    cents = F.rint(F.col("predicted_rating") * 100).cast("long")
    agg = scored.groupBy(request).agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("s"),
                                      F.sum(cents * cents).alias("q"))
    std = F.sqrt((F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double")) / (F.col("n") * F.lit(200.0))
    return agg.select(request, F.when(F.col("n") > 1, F.least(F.lit(1.0), std))
                      .otherwise(F.lit(SINGLE_PLACE_DIVERSITY)).alias("diversity"))


def recommend_response(ranked: DataFrame, model_name: Column | str, k: int = DEFAULT_TOP_K,
                       scored_at: Column | None = None, request: str = REQ) -> DataFrame:
    """The top-k response per request as JSON text: the user's preferences
    echoed, the first ``k`` places, and O50's summary.

    ``ranked`` carries the request's ``user`` struct; the list holds at most
    ``k`` entries."""
    pred = F.struct("recommendation_rank", "place_id", "predicted_rating", "confidence_score")
    ts = scored_at if scored_at is not None else F.current_timestamp()
    model = F.lit(model_name) if isinstance(model_name, str) else model_name
    top = (recommend_top_k(ranked, k).groupBy(request)
           .agg(F.array_sort(F.collect_list(pred)).alias("_p")))
    users = ranked.where(F.col("recommendation_rank") == 1).select(request, "user")
    agg = (recommend_summary(ranked, k, request).join(users, request)
           .join(top, request, "left"))
    body = F.struct(F.col("user").alias("user_preferences"),
                    F.coalesce("_p", F.array().cast(top.schema["_p"].dataType)).alias("top_recommendations"),
                    model.alias("model_used"), ts.alias("timestamp"),
                    F.struct("total_places_evaluated", "top_k_requested",
                             "average_predicted_rating").alias("recommendation_summary"))
    return agg.select(request, F.to_json(body).alias("response"))


def request_response(ranked: DataFrame, model_name: Column | str,
                     scored_at: Column | None = None, request: str = REQ) -> DataFrame:
    """O51 nested response per request as JSON text.

    The per-request list holds at most 50 entries (validated requests)."""
    pred = F.struct("recommendation_rank", "place_id", "predicted_rating", "confidence_score")
    ts = scored_at if scored_at is not None else F.current_timestamp()
    model = F.lit(model_name) if isinstance(model_name, str) else model_name
    agg = ranked.groupBy(request).agg(F.array_sort(F.collect_list(pred)).alias("_p"))
    preds = F.transform("_p", lambda x: F.struct(
        x["place_id"].alias("place_id"), x["predicted_rating"].alias("predicted_rating"),
        x["confidence_score"].alias("confidence_score"),
        x["recommendation_rank"].alias("recommendation_rank")))
    body = F.struct(preds.alias("predictions"), model.alias("model_used"),
                    ts.alias("prediction_timestamp"),
                    F.size("_p").alias("total_places_evaluated"),
                    preds[0].alias("top_recommendation"))
    return agg.select(request, F.to_json(body).alias("response"))
