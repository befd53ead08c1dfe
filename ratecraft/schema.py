"""Explicit schemas for every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

from .constants import FEATURE_NAMES

# Rating table (training input).  Keys may be long or string; the reader
# keeps the source type of the keys and casts the measures.
RATING_MEASURES = {
    "place_category": T.StringType(),
    "place_city": T.StringType(),
    "place_price": T.DoubleType(),
    "place_average_rating": T.DoubleType(),
    "place_visit_duration_minutes": T.IntegerType(),
    "user_age": T.IntegerType(),
    "user_rating": T.DoubleType(),
}
RATING_KEYS = ["user_id", "place_id"]

USER = T.StructType([
    T.StructField("user_age", T.IntegerType()),
    T.StructField("preferred_category", T.StringType()),
    T.StructField("preferred_city", T.StringType()),
    T.StructField("budget_range", T.StringType()),
])

PLACE = T.StructType([
    T.StructField("place_id", T.StringType()),
    T.StructField("place_category", T.StringType()),
    T.StructField("place_city", T.StringType()),
    T.StructField("place_price", T.DoubleType()),
    T.StructField("place_average_rating", T.DoubleType()),
    T.StructField("place_visit_duration_minutes", T.IntegerType()),
    T.StructField("place_description", T.StringType()),
])

REQUEST = T.StructType([
    T.StructField("user", USER),
    T.StructField("places", T.ArrayType(PLACE)),
])

# Optional statistics a caller may pass with a request (serving features).
SERVING_STATS = T.StructType([
    T.StructField(n, T.DoubleType()) for n in (
        "global_mean", "global_std", "category_mean", "city_mean",
        "user_mean", "user_std", "place_mean", "place_std")
])

REQUEST_LOG = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("method", T.StringType()),
    T.StructField("handler", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("duration_s", T.DoubleType()),
])

METRIC_SAMPLE = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
])

RUN_METRICS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

RUN_PARAMS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

MODEL_VERSIONS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("alias", T.StringType()),
    T.StructField("run_id", T.StringType()),
])

FEATURES = T.StructType([T.StructField(n, T.DoubleType()) for n in FEATURE_NAMES])

# Responses as they are read back from their JSON texts.
PREDICTION = ("struct<place_id string, predicted_rating double, confidence_score double, "
              "recommendation_rank int>")
PREDICT_RESPONSE = (f"predictions array<{PREDICTION}>, model_used string, prediction_timestamp timestamp, "
                    f"total_places_evaluated int, top_recommendation {PREDICTION}")
RECOMMEND_RESPONSE = (
    "user_preferences struct<user_age int, preferred_category string, preferred_city string, "
    f"budget_range string>, top_recommendations array<{PREDICTION}>, model_used string, timestamp timestamp, "
    "recommendation_summary struct<total_places_evaluated bigint, top_k_requested int, "
    "average_predicted_rating double>")
