"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables through the adaptors in
``sources.fixtures`` and runs the library's operators on them.  Doubles
are rounded to 6 digits (the oracle comparison precision).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import round_doubles
from ..operators import features, joins, stats
from ..operators.split import TRAIN_FLAG, with_split
from ..sources.fixtures import ROW_KEY
from . import catalog
from ..operators import score, validate
from ..sources.requests import parse_requests, parse_summary
from ..schema import PREDICT_RESPONSE, RECOMMEND_RESPONSE
from ..session import scratch_path
from ..streaming import jobs
from ..streaming.store import Versions
from . import serving
from .feature_matrix import feature_matrix, joined_rows
from .materialize import materialize

Q = dict


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating rows with the O10 split flag."""
    return with_split(catalog.ratings(spark, sf_dir))


# ----------------------------------------------------- sources / split ----
def q_scan_ratings(spark, sf_dir):
    """O1: the rating table read from its folder by the rating reader
    (declared columns and types, row key kept)."""
    from ..sources.ratings import read_ratings
    catalog.ratings(spark, sf_dir)                      # written once per session
    path = catalog.input_path(spark, sf_dir, "ratings")
    return round_doubles(read_ratings(spark, path, fmt="parquet", keep=tuple(ROW_KEY)))


def q_train_test_split(spark, sf_dir):
    """Rows per side of the 80/20 split."""
    return (_rows(spark, sf_dir).groupBy(TRAIN_FLAG)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_distinct("user_id").alias("n_users")))


def q_train_test_split_exact(spark, sf_dir):
    """Exactly 20 % of the rows (rounded up) as test rows, by the smallest
    row hashes; rows, users and a checksum of the keys per side."""
    from ..operators.split import exact_split
    rows = exact_split(catalog.ratings(spark, sf_dir), key_cols=ROW_KEY)
    return rows.groupBy(TRAIN_FLAG).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"),
                                        F.sum(F.col("l_orderkey") * 7 + F.col("l_partkey")).alias("key_sum"))


# ------------------------------------------------------------- stats ------
def q_user_stats(spark, sf_dir):
    return round_doubles(stats.user_stats(_rows(spark, sf_dir)))


def q_place_stats(spark, sf_dir):
    return round_doubles(stats.place_stats(_rows(spark, sf_dir)))


def q_category_stats(spark, sf_dir):
    return round_doubles(stats.category_stats(_rows(spark, sf_dir)))


def q_city_stats(spark, sf_dir):
    return round_doubles(stats.city_stats(_rows(spark, sf_dir)))


def q_global_stats(spark, sf_dir):
    return round_doubles(stats.global_table(_rows(spark, sf_dir)))


def q_user_category_pref(spark, sf_dir):
    return round_doubles(stats.user_category_pref(_rows(spark, sf_dir)))


def q_user_city_pref(spark, sf_dir):
    return round_doubles(stats.user_city_pref(_rows(spark, sf_dir)))


def q_user_price_stats(spark, sf_dir):
    return round_doubles(stats.user_price_stats(_rows(spark, sf_dir)))


def q_preference_pivot(spark, sf_dir):
    return round_doubles(stats.preference_pivot(_rows(spark, sf_dir), PIVOT_CATEGORIES))


# The matrix has a column for each of these categories.
PIVOT_CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


# ------------------------------------------------------------- joins ------
def _globals(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Rating rows alone, and with the one-row global statistics."""
    rows = _rows(spark, sf_dir)
    return rows, joins.with_globals(rows, stats.global_table(rows))


def _with_users(spark, sf_dir) -> DataFrame:
    rows, x = _globals(spark, sf_dir)
    return joins.join_user_stats(x, stats.user_table(rows), salt_cols=ROW_KEY)


def _with_places(spark, sf_dir) -> DataFrame:
    rows, x = _globals(spark, sf_dir)
    return joins.join_place_stats(x, stats.place_table(rows), salt_cols=ROW_KEY)


def _pick(df: DataFrame, *cols) -> DataFrame:
    return round_doubles(df.select(*ROW_KEY, *cols))


def q_join_user_stats(spark, sf_dir):
    return _pick(_with_users(spark, sf_dir), "user_mean", "user_std", "user_count", "user_range")


def q_join_place_stats(spark, sf_dir):
    return _pick(_with_places(spark, sf_dir), "place_mean", "place_std", "place_count")


def q_join_category_city(spark, sf_dir):
    rows, x = _globals(spark, sf_dir)
    x = joins.join_category_city(
        x, stats.level_table(rows, "place_category", "uc", "category_mean", "category_count"),
        stats.level_table(rows, "place_city", "ucy", "city_mean", "city_count"), salt_cols=ROW_KEY)
    return _pick(x, "category_mean", "city_mean")


def q_join_preferences(spark, sf_dir):
    rows, x = _globals(spark, sf_dir)
    profiles = joins.user_profiles(
        stats.user_table(rows),
        stats.preference_table(stats.pair_table(rows, "place_category", "uc"), "place_category", "uc",
                               "user_category_pref"),
        stats.preference_table(stats.pair_table(rows, "place_city", "ucy"), "place_city", "ucy",
                               "user_city_pref"))
    x = joins.join_preferences(x, profiles, salt_cols=ROW_KEY)
    return _pick(x, "user_category_pref", "user_city_pref")


def q_join_user_price(spark, sf_dir):
    return _pick(_with_users(spark, sf_dir), "user_avg_price")


def q_cold_start_rows(spark, sf_dir):
    return joins.cold_start_rows(joined_rows(catalog.ratings(spark, sf_dir), key_cols=ROW_KEY))


# ------------------------------------------------------------ scalars -----
def q_place_popularity(spark, sf_dir):
    x = _with_places(spark, sf_dir)
    return _pick(x, features.place_popularity(F.col("place_count")).alias("place_popularity"))


def q_price_ratio(spark, sf_dir):
    x = _with_users(spark, sf_dir)
    return _pick(x, features.price_ratio(F.col("place_price"), F.col("user_avg_price")).alias("price_ratio"))


def q_user_place_deviation(spark, sf_dir):
    rows, x = _globals(spark, sf_dir)
    x = joins.join_user_stats(x, stats.user_table(rows), salt_cols=ROW_KEY)
    x = joins.join_place_stats(x, stats.place_table(rows), salt_cols=ROW_KEY)
    return _pick(x, features.user_place_deviation(F.col("user_mean"), F.col("place_mean"))
                 .alias("user_place_deviation"))


def q_rating_price_ratio(spark, sf_dir):
    return _pick(catalog.ratings(spark, sf_dir), features.rating_price_ratio(
        F.col("place_average_rating"), F.col("place_price")).alias("rating_price_ratio"))


def q_feature_matrix(spark, sf_dir):
    """O31 flagship."""
    return feature_matrix(catalog.ratings(spark, sf_dir), key_cols=ROW_KEY)


# ----------------------------------------------------------- requests -----
def _parsed(spark, sf_dir):
    return parse_requests(catalog.requests(spark, sf_dir))


def _wellformed(spark, sf_dir):
    return _parsed(spark, sf_dir).where(~F.col("malformed"))


def q_parse_requests(spark, sf_dir):
    """O2: counts of requests, malformed texts and places."""
    return parse_summary(_parsed(spark, sf_dir))


def q_validate_users(spark, sf_dir):
    """User check of every well-formed request."""
    p = _wellformed(spark, sf_dir)
    return p.select("request_id", F.col("user.user_age").alias("user_age"),
                    validate.user_valid(F.col("user")).alias("user_valid"))


def q_validate_places(spark, sf_dir):
    """Violated rules per place (empty string = valid)."""
    p = _wellformed(spark, sf_dir)
    x = p.select("request_id", F.posexplode("places").alias("pos", "place"))
    v = validate.place_violations(F.col("place"))
    return x.select("request_id", "pos", (F.size(v) == 0).alias("place_valid"),
                    F.array_join(v, ",").alias("violations"))


def q_validate_requests(spark, sf_dir):
    """All-or-nothing request validity with the first failing reason."""
    return validate.request_status(_parsed(spark, sf_dir)).select(
        "request_id", "n_places", "valid", "reason")


def q_default_fill(spark, sf_dir):
    """Optional fields after defaults."""
    p = validate.fill_defaults(_wellformed(spark, sf_dir))
    x = validate.explode_places(p.select("request_id", "user", "places"))
    return x.select("request_id", "pos", "place_description")


def q_explode_places(spark, sf_dir):
    """One row per (request, place) with list position."""
    x = validate.explode_places(_wellformed(spark, sf_dir).select("request_id", "user", "places"))
    return round_doubles(x.select("request_id", "pos", "user_age", "place_id", "place_category",
                                  "place_city", "place_price", "place_average_rating",
                                  "place_visit_duration_minutes"))


def _request_rows(spark, sf_dir):
    return serving.request_rows(catalog.requests(spark, sf_dir))


def _features_out(df: DataFrame) -> DataFrame:
    from ..operators.features import feature_columns
    return round_doubles(df.select("request_id", "pos", *feature_columns()))


def q_serving_features(spark, sf_dir):
    """Request features with the fixed defaults."""
    return _features_out(serving.default_features(_request_rows(spark, sf_dir)))


def _enriched(spark, sf_dir):
    """Request rows with training statistics.  The statistics tables and the
    parsed request rows are checkpointed once per session and shared by the
    scoring queries."""
    tables = catalog.shared(spark, sf_dir, "serving_tables", lambda: serving.serving_tables(
        catalog.ratings(spark, sf_dir), key_cols=ROW_KEY))
    rows = catalog.shared(spark, sf_dir, "request_rows", lambda: serving.request_rows(
        catalog.requests(spark, sf_dir), checkpoint=True))
    return serving.enriched_features(rows, tables)


def q_serving_features_enriched(spark, sf_dir):
    """Request features from the training statistics."""
    return _features_out(_enriched(spark, sf_dir))


def _scored(spark, sf_dir):
    """Valid requests scored with the closed-form predictor and ranked."""
    return serving.scored(_enriched(spark, sf_dir), serving.bias_predictor)


def q_clip_rating(spark, sf_dir):
    s = serving.bias_predictor(_enriched(spark, sf_dir))
    return round_doubles(s.select("request_id", "pos", "prediction",
                                  score.clip_rating(F.col("prediction")).alias("clipped")))


def q_confidence(spark, sf_dir):
    return round_doubles(_scored(spark, sf_dir).select("request_id", "pos", "confidence_raw"))


def q_round_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("request_id", "pos", "predicted_rating",
                                         "confidence_score")


def q_rank_places(spark, sf_dir):
    return _scored(spark, sf_dir).select("request_id", "pos", "place_id", "predicted_rating",
                                         "confidence_score", "recommendation_rank")


def q_top_recommendation(spark, sf_dir):
    return score.top_recommendation(_scored(spark, sf_dir)).select(
        "request_id", "place_id", "predicted_rating", "confidence_score")


def q_recommend_top_k(spark, sf_dir):
    return score.recommend_top_k(_scored(spark, sf_dir), 5).select(
        "request_id", "recommendation_rank", "place_id", "predicted_rating")


def q_recommend_summary(spark, sf_dir):
    return score.recommend_summary(_scored(spark, sf_dir), 5)


def q_diversity(spark, sf_dir):
    return round_doubles(score.diversity(_scored(spark, sf_dir)))


def _places_text(predictions) -> F.Column:
    """``rank:place:hundredths`` of a response's predictions, in their order."""
    return F.array_join(F.transform(predictions, lambda p: F.concat_ws(
        ":", p["recommendation_rank"].cast("string"), p["place_id"],
        F.rint(p["predicted_rating"] * 100).cast("long").cast("string"))), ",")


def _flat_response(responses: DataFrame) -> DataFrame:
    """The fields of O51's JSON texts, parsed back."""
    r = responses.select("request_id", F.from_json("response", PREDICT_RESPONSE).alias("r"))
    return r.select("request_id", "r.model_used", "r.total_places_evaluated",
                    F.col("r.top_recommendation.place_id").alias("top_place_id"),
                    F.col("r.prediction_timestamp").isNotNull().alias("has_timestamp"),
                    _places_text(F.col("r.predictions")).alias("places"))


def q_request_response(spark, sf_dir):
    """One JSON response per valid request, its fields parsed back."""
    return _flat_response(score.request_response(_scored(spark, sf_dir), "bias-baseline"))


def q_recommend_response(spark, sf_dir):
    """The top-k response with the user's preferences and the summary (O49,
    O50) as JSON, its fields parsed back."""
    texts = score.recommend_response(_scored(spark, sf_dir), "bias-baseline")
    r = texts.select("request_id", F.from_json("response", RECOMMEND_RESPONSE).alias("r"))
    return r.select("request_id", "r.user_preferences.user_age", "r.user_preferences.preferred_category",
                    "r.user_preferences.preferred_city", "r.user_preferences.budget_range", "r.model_used",
                    "r.recommendation_summary.*", F.col("r.timestamp").isNotNull().alias("has_timestamp"),
                    _places_text(F.col("r.top_recommendations")).alias("places"))


# --------------------------------------------------- train / evaluate -----
def _matrix(spark, sf_dir):
    """Unrounded feature matrix (training input)."""
    return catalog.derived(spark, sf_dir, "matrix", lambda s, d: feature_matrix(
        catalog.ratings(s, d), key_cols=ROW_KEY, digits=None))


def _test_bias(spark, sf_dir):
    """Test rows scored by the closed-form predictor (oracle-checkable)."""
    m = _matrix(spark, sf_dir).where(~F.col(TRAIN_FLAG))
    return m.withColumn("prediction", F.col("place_rating") + F.col("user_mean")
                        - F.col("global_mean"))


def q_standard_scale(spark, sf_dir):
    """Features scaled with train mean / population std."""
    from ..operators.features import apply_scaler, fit_scaler
    m = _matrix(spark, sf_dir)
    sc = fit_scaler(m.where(F.col(TRAIN_FLAG)))
    return round_doubles(apply_scaler(m, sc).drop("label", TRAIN_FLAG))


def q_regression_metrics(spark, sf_dir):
    from ..operators.evaluate import regression_metrics
    return round_doubles(regression_metrics(_test_bias(spark, sf_dir)))


def q_binary_metrics(spark, sf_dir):
    from ..operators.evaluate import binary_metrics
    return round_doubles(binary_metrics(_test_bias(spark, sf_dir)))


def q_ndcg_at_k(spark, sf_dir):
    from ..operators.evaluate import ndcg_at_k
    return round_doubles(ndcg_at_k(_test_bias(spark, sf_dir)))


def q_baseline_predict(spark, sf_dir):
    """No model -> every test row gets the training global mean."""
    from ..operators.train import baseline_predict
    m = _matrix(spark, sf_dir)
    g = stats.global_table(with_split(catalog.ratings(spark, sf_dir)))
    return round_doubles(baseline_predict(m.where(~F.col(TRAIN_FLAG)).select(*ROW_KEY), g))


def _model_path(spark, sf_dir) -> str:
    """The model with the original's parameters, fitted once and saved."""
    from ..operators.train import save_model, train_gbt
    return catalog.model_path(spark, sf_dir, "gbt", lambda: save_model(
        train_gbt(_matrix(spark, sf_dir).where(F.col(TRAIN_FLAG))), scratch_path(spark, "model")))


def _model(spark, sf_dir):
    from ..operators.train import load_model
    return load_model(_model_path(spark, sf_dir))


def q_train_gbt(spark, sf_dir):
    """O35 (rows only): one row per fitted tree."""
    from ..operators.train import trees_of
    gbt = trees_of(_model(spark, sf_dir))
    rows = [(i, float(w), t.numNodes, t.depth)
            for i, (t, w) in enumerate(zip(gbt.trees, gbt.treeWeights))]
    return spark.createDataFrame(rows, "tree int, weight double, num_nodes int, depth int")


def _test_rows(spark, sf_dir):
    """Every test row, spread over tasks to be scored by the fitted model."""
    from ..operators.train import spread
    test = _matrix(spark, sf_dir).where(~F.col(TRAIN_FLAG))
    return spread(test, test.count())


def q_predict_batch(spark, sf_dir):
    """O36 (rows only): model predictions for every test row."""
    from ..operators.train import predict_batch
    return round_doubles(predict_batch(_model(spark, sf_dir), _test_rows(spark, sf_dir), ROW_KEY))


def q_model_metrics(spark, sf_dir):
    """O37-O39 on the fitted model's test predictions (rows only)."""
    from ..operators.evaluate import binary_metrics, ndcg_at_k, regression_metrics
    from ..operators.train import predict_batch
    p = materialize(predict_batch(_model(spark, sf_dir), _test_rows(spark, sf_dir), ROW_KEY + ["label"]), name="predictions")
    # three one-row aggregates side by side
    return round_doubles(regression_metrics(p).crossJoin(binary_metrics(p))
                         .crossJoin(ndcg_at_k(p)))


def q_model_rank_places(spark, sf_dir):
    """O36 + O44-O47 (rows only): valid requests scored by the fitted
    boosted-tree pipeline instead of the closed-form predictor."""
    ranked = serving.scored(_enriched(spark, sf_dir), serving.model_predictor(_model(spark, sf_dir)))
    return ranked.select("request_id", "pos", "place_id", "predicted_rating",
                         "confidence_score", "recommendation_rank")


def q_feature_importance(spark, sf_dir):
    """O40 (rows only)."""
    from ..operators.train import feature_importance
    return round_doubles(feature_importance(spark, _model(spark, sf_dir)))


def q_save_load_model(spark, sf_dir):
    """The model saved to the shared folder and loaded back; test rows on
    which the copy differs from the original."""
    from ..operators.train import load_model, predict_batch, save_model
    model = _model(spark, sf_dir)
    copy = load_model(save_model(model, scratch_path(spark, "model-copy")))
    test = _test_rows(spark, sf_dir)
    own = predict_batch(model, test, [*test.columns]).withColumnRenamed("prediction", "original")
    both = copy.transform(own)
    return both.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(~F.col("prediction").eqNullSafe(F.col("original"))).alias("n_different"))


# ------------------------------------------------------------ metrics -----
MODEL_LABELS = {"model_name": "bias-baseline", "model_stage": "Production"}


def q_recommendations_total(spark, sf_dir):
    """O53 places scored per model label set."""
    from ..operators.metrics import recommendations_total
    return recommendations_total(_scored(spark, sf_dir), MODEL_LABELS)


def q_gauge_last(spark, sf_dir):
    """O54 last duration gauge value per handler (ties on ts: sequence)."""
    from ..operators.metrics import gauge_last
    return round_doubles(gauge_last(catalog.gauge_samples(spark, sf_dir), ["handler"],
                                    order=["ts", "seq"]))


def q_model_gauge_last(spark, sf_dir):
    """O54 on the diversity gauge per model and stage: every request sets it,
    the last request's value stays."""
    from ..operators.metrics import gauge_last
    scored = _scored(spark, sf_dir)
    sets = score.diversity(scored).join(scored.where("recommendation_rank = 1").select("request_id", "ts"), "request_id")
    samples = sets.select(*[F.lit(v).alias(k) for k, v in MODEL_LABELS.items()], "ts", "request_id",
                          F.col("diversity").alias("value"))
    return round_doubles(gauge_last(samples, list(MODEL_LABELS), order=["ts", "request_id"]))


def q_model_rmse_gauge(spark, sf_dir):
    """O54 on the RMSE gauge per model and stage: every request sets it to the
    RMSE of the model that serves; the last request's value stays."""
    from ..operators.evaluate import resolve_model
    from ..operators.metrics import gauge_last
    from ..operators.runs import register_versions
    m = materialize(_run_metrics(spark, sf_dir), name="run-metrics")
    serves = resolve_model(register_versions(m, MODEL_NAME), m, MODEL_NAME).select("model_name", "model_stage", "rmse")
    requests = _scored(spark, sf_dir).where("recommendation_rank = 1").select("request_id", "ts")
    samples = requests.crossJoin(F.broadcast(serves))                 # one row
    return round_doubles(gauge_last(samples, list(MODEL_LABELS), "rmse", order=["ts", "request_id"]))


def q_confidence_histogram(spark, sf_dir):
    """O55 cumulative confidence buckets, sum and count per model labels."""
    from ..operators.metrics import histogram
    s = _scored(spark, sf_dir).select(
        *[F.lit(v).alias(k) for k, v in MODEL_LABELS.items()], "confidence_raw")
    return round_doubles(histogram(s, "confidence_raw", list(MODEL_LABELS)))


def q_request_rate(spark, sf_dir):
    """O56 requests/s over 5-minute windows (1-minute steps) by method, status."""
    from ..operators.metrics import request_rate
    return round_doubles(request_rate(catalog.request_log(spark, sf_dir)))


def q_counter_rate(spark, sf_dir):
    """O57 reset-aware rate of the sampled request counter per handler."""
    from ..operators.metrics import counter_rate
    samples = catalog.derived(spark, sf_dir, "counter-samples", catalog.counter_samples)
    return round_doubles(counter_rate(samples, ["handler"]))


def q_recommendation_rate(spark, sf_dir):
    """O57 on the counter of scored places per model and stage, as it stands
    after each request time."""
    from ..operators.metrics import counter_rate, running_total
    labels = list(MODEL_LABELS)
    per_time = _scored(spark, sf_dir).select(*[F.lit(v).alias(k) for k, v in MODEL_LABELS.items()], "ts").groupBy(
        *labels, "ts").agg(F.count(F.lit(1)).alias("n"))
    return round_doubles(counter_rate(running_total(per_time, labels), labels))


def q_endpoint_rates(spark, sf_dir):
    """O58 requests/s of each dashboard endpoint."""
    from ..constants import DASHBOARD_HANDLERS
    from ..operators.metrics import endpoint_rates
    return round_doubles(endpoint_rates(catalog.request_log(spark, sf_dir), DASHBOARD_HANDLERS))


def q_bucket_rates(spark, sf_dir):
    """O59 confidence bucket rates per window (request time = order date)."""
    from ..constants import CONFIDENCE_BUCKETS
    from ..operators.metrics import bucket_rates
    return round_doubles(bucket_rates(_scored(spark, sf_dir), "confidence_raw",
                                      CONFIDENCE_BUCKETS))


def q_latency_quantile(spark, sf_dir):
    """O60 p95 request duration per handler and window from the buckets."""
    from ..constants import LATENCY_BUCKETS
    from ..operators.metrics import latency_quantile
    return round_doubles(latency_quantile(catalog.request_log(spark, sf_dir), LATENCY_BUCKETS))


def q_threshold_status(spark, sf_dir):
    """O61 dashboard colour of each request's diversity gauge."""
    from ..constants import DIVERSITY_BANDS
    from ..operators.metrics import threshold_status
    d = score.diversity(_scored(spark, sf_dir))
    return round_doubles(d.withColumn("status", threshold_status(F.col("diversity"),
                                                                 DIVERSITY_BANDS)))


def q_excluded_handlers(spark, sf_dir):
    """O62 requests per (handler, status) after the exclusion rules: neither
    the scraped path itself nor paths that are no route."""
    from ..constants import DASHBOARD_HANDLERS, EXCLUDED_HANDLERS
    from ..operators.metrics import excluded_handlers
    log = excluded_handlers(catalog.request_log(spark, sf_dir), routes=DASHBOARD_HANDLERS + EXCLUDED_HANDLERS)
    return log.groupBy("handler", "status").agg(F.count(F.lit(1)).alias("n_requests"))


def q_in_progress(spark, sf_dir):
    """O63 open requests per handler at every 10-second tick where it changes."""
    from ..operators.metrics import in_progress
    return in_progress(catalog.request_log(spark, sf_dir))


def q_relabel(spark, sf_dir):
    """O64 pod relabelling of every scrape target's labels."""
    from ..constants import POD_RELABEL_RULES
    from ..operators.metrics import labels_text, relabel
    out = relabel(catalog.target_labels(spark, sf_dir), POD_RELABEL_RULES)
    return out.select("event_id", labels_text(F.col("labels")).alias("labels"))


def q_sample_at_interval(spark, sf_dir):
    """O65 gauge value per handler at every 10-second scrape tick from its first
    to its last event; a tick without an event repeats the value before."""
    from ..operators.metrics import sample_at_interval
    return round_doubles(sample_at_interval(catalog.gauge_samples(spark, sf_dir), ["handler"],
                                            order=["ts", "seq"]))


def q_retention(spark, sf_dir):
    """O66 samples kept per handler by the 200 h retention and the 30 min
    dashboard range."""
    from ..constants import DASHBOARD_RANGE, RETENTION
    from ..operators.metrics import retained_counts
    return retained_counts(catalog.gauge_samples(spark, sf_dir),
                           {"retention": RETENTION, "dashboard": DASHBOARD_RANGE}, ["handler"])


def q_retention_by_day(spark, sf_dir):
    """O66 as deletion: gauge samples stored by day; the days that 20 hours
    before the newest sample have passed are deleted, the rest is read with a
    filter on the day."""
    from ..operators import samples as store
    path = scratch_path(spark, "samples-by-day")
    store.append_samples(catalog.gauge_samples(spark, sf_dir), path)
    store.drop_expired(spark, path, "20 hours")
    kept = store.read_retained(spark, path, "20 hours")
    return kept.groupBy("handler").agg(F.count(F.lit(1)).alias("n_samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def q_load_summary(spark, sf_dir):
    """O67 load-test style summary of the request log."""
    from ..operators.metrics import load_summary
    return load_summary(catalog.request_log(spark, sf_dir))


# ---------------------------------------------------------- streaming -----
# Streams read this many files, with rows in no order, one per micro-batch.
STREAM_FILES = 3


def q_stream_metrics(spark, sf_dir):
    """Request rates from a file stream of the request log, whose files
    come in no time order, one per micro-batch."""
    land = jobs.landing_folder(catalog.request_log(spark, sf_dir), "log-landing", STREAM_FILES)
    out, ck = scratch_path(spark, "stream-metrics"), scratch_path(spark, "stream-metrics-ck")
    res = jobs.stream_rates(jobs.file_stream(spark, land, max_files=1), out, ck)
    return round_doubles(res.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "method", "status", "rate"))


def q_stream_gauge_last(spark, sf_dir):
    """O54 over a stream: newest duration gauge per handler from files in no
    time order."""
    land = jobs.landing_folder(catalog.gauge_samples(spark, sf_dir), "gauge-landing", STREAM_FILES)
    out, ck = scratch_path(spark, "stream-gauges"), scratch_path(spark, "stream-gauges-ck")
    return round_doubles(jobs.stream_gauges(jobs.file_stream(spark, land, max_files=1), out, ck, ["handler"], order=["ts", "seq"]))


def _scored_stream(spark, sf_dir) -> DataFrame:
    """File stream of scored rows with the model's labels."""
    rows = _scored(spark, sf_dir).select(*[F.lit(v).alias(k) for k, v in MODEL_LABELS.items()], "confidence_raw")
    return jobs.file_stream(spark, jobs.landing_folder(rows, "scored-landing"))


def q_stream_recommendations_total(spark, sf_dir):
    """O53 as running totals over a stream of scored rows."""
    out, ck = scratch_path(spark, "stream-totals"), scratch_path(spark, "stream-totals-ck")
    jobs.stream_totals(_scored_stream(spark, sf_dir).groupBy(*MODEL_LABELS).agg(
        F.count(F.lit(1)).alias("recommendations_total")), out, ck)
    return Versions(spark, out).newest()


def q_stream_confidence_histogram(spark, sf_dir):
    """O55 as running buckets over a stream of scored rows."""
    from ..operators.metrics import histogram
    out, ck = scratch_path(spark, "stream-buckets"), scratch_path(spark, "stream-buckets-ck")
    jobs.stream_totals(histogram(_scored_stream(spark, sf_dir), "confidence_raw", list(MODEL_LABELS)), out, ck)
    return round_doubles(Versions(spark, out).newest())


def _published_tables(spark, sf_dir) -> str:
    """Folder with a published snapshot of the statistics."""
    def publish():
        path = scratch_path(spark, "statistics-versions")
        serving.publish_tables(spark, path, serving.serving_tables(catalog.ratings(spark, sf_dir), key_cols=ROW_KEY))
        return path
    return catalog.shared(spark, sf_dir, "published_tables", publish)


def _request_stream(spark, sf_dir, predictor):
    """File stream of the requests, and a function that scores a micro-batch of
    it; ``predictor()`` and the newest published statistics are taken at the
    start of each micro-batch."""
    path = _published_tables(spark, sf_dir)
    land = jobs.landing_folder(catalog.requests(spark, sf_dir), "request-landing")

    def score_batch(batch):
        rows = serving.request_rows(batch, checkpoint=True)
        return serving.scored(serving.enriched_features(rows, serving.newest_tables(spark, path)), predictor())

    return jobs.file_stream(spark, land), score_batch


def _stream_scored(spark, sf_dir, predictor) -> DataFrame:
    """O68 over a file stream of the requests."""
    stream, score_batch = _request_stream(spark, sf_dir, predictor)
    out, ck = scratch_path(spark, "stream-score"), scratch_path(spark, "stream-score-ck")
    jobs.stream_score(stream, lambda batch: score_batch(batch).select(
        "request_id", "pos", "place_id", "predicted_rating", "confidence_score", "recommendation_rank"), out, ck)
    return spark.read.parquet(out).drop("batch_id")


def q_stream_score(spark, sf_dir):
    """A file stream of JSON requests scored batch by batch with the
    batch plan (statistics joins, closed-form predictor, rank)."""
    return _stream_scored(spark, sf_dir, lambda: serving.bias_predictor)


def q_stream_model_score(spark, sf_dir):
    """O68 (rows only): each micro-batch scored by the model that the registry
    names when the batch starts."""
    from ..operators import registry as reg
    registry = scratch_path(spark, "registry")
    reg.register_model(spark, registry, MODEL_NAME, 1, _model_path(spark, sf_dir))
    reg.set_alias(spark, registry, MODEL_NAME, 1)
    return _stream_scored(spark, sf_dir, lambda: reg.load_serving(
        spark, registry, MODEL_NAME, serving.model_predictor, serving.baseline_predictor).predictor)


def q_stream_response_sink(spark, sf_dir):
    """O5 over a stream: nested JSON responses of each micro-batch as JSON files
    under its batch id, read back and parsed."""
    stream, score_batch = _request_stream(spark, sf_dir, lambda: serving.bias_predictor)
    out, ck = scratch_path(spark, "stream-responses"), scratch_path(spark, "stream-responses-ck")
    jobs.stream_responses(stream, lambda batch: score.request_response(score_batch(batch), "bias-baseline"), out, ck)
    return _flat_response(spark.read.schema("request_id long, response string").json(out))


def q_serve_with_fallback(spark, sf_dir):
    """O42 / O43 at run time: test rows scored by what the registry leads to -
    the alias' model, the latest where the alias' files are gone, the baseline
    where all files are gone and where there is no registry."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    from ..operators import registry as reg
    from ..operators.train import save_model
    test = _matrix(spark, sf_dir).where(~F.col(TRAIN_FLAG))
    path = scratch_path(spark, "registry")

    def saved(formula):
        return save_model(PipelineModel([SQLTransformer(statement=f"SELECT *, {formula} AS prediction FROM __THIS__")]), scratch_path(spark, "model"))

    gone = scratch_path(spark, "no-model")
    reg.register_model(spark, path, MODEL_NAME, 1, saved("place_rating + user_mean - global_mean"), "bias")
    reg.register_model(spark, path, MODEL_NAME, 2, gone, "lost")
    reg.register_model(spark, path, MODEL_NAME, 3, saved("place_mean"), "place_mean")
    reg.register_model(spark, path, "lost-model", 1, gone, "lost")
    for name, version, alias in ((MODEL_NAME, 3, "production"), (MODEL_NAME, 1, "production"), (MODEL_NAME, 2, "canary"), ("lost-model", 1, "production")):
        reg.set_alias(spark, path, name, version, alias)
    out = None
    for case, registry, name, alias in (("alias", path, MODEL_NAME, "production"), ("latest", path, MODEL_NAME, "canary"),
                                        ("unknown alias", path, MODEL_NAME, "staging"), ("broken", path, "lost-model", "production"),
                                        ("no registry", gone, MODEL_NAME, "production")):
        s = reg.load_serving(spark, registry, name, lambda model: model.transform, serving.baseline_predictor, alias)
        part = s.predictor(test).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("prediction").alias("mean_prediction")).select(
            F.lit(case).alias("case_name"), F.lit(s.name).alias("model_name"), F.lit(s.version).alias("model_version"),
            F.lit(s.stage).alias("model_stage"), F.lit(s.run_id).alias("run_id"), "n_rows", "mean_prediction")
        out = part if out is None else out.unionByName(part)
    return round_doubles(out)


def q_response_sink(spark, sf_dir):
    """JSON responses written as JSON files, read back and parsed."""
    path = scratch_path(spark, "responses")
    score.request_response(_scored(spark, sf_dir), "bias-baseline").write.json(path)
    return _flat_response(spark.read.schema("request_id long, response string").json(path))


# --------------------------------------------------------------- runs -----
MODEL_NAME = "rating-gb"


def _run_predictors():
    """Closed-form predictors, one run each, evaluated on the test split."""
    return {"global_mean": "global_mean", "user_mean": "user_mean", "place_mean": "place_mean",
            "bias": "place_rating + user_mean - global_mean"}


def _run_metrics(spark, sf_dir):
    from ..operators.runs import run_metrics_table
    test = _matrix(spark, sf_dir).where(~F.col(TRAIN_FLAG))
    return run_metrics_table(test, _run_predictors())


def q_run_metrics_sink(spark, sf_dir):
    """O3: run metrics and parameters appended (partitioned by run), read back."""
    from ..operators.runs import run_params_table, write_runs
    base = scratch_path(spark, "runs")
    test = _matrix(spark, sf_dir).where(~F.col(TRAIN_FLAG))
    write_runs(_run_metrics(spark, sf_dir), f"{base}/metrics")
    write_runs(run_params_table(test, _run_predictors()), f"{base}/params")
    metrics = round_doubles(spark.read.parquet(f"{base}/metrics")).select(
        F.col("run_id").cast("string").alias("run_id"), F.lit("metric").alias("kind"), "key", "value",
        F.lit(None).cast("string").alias("text"))
    params = spark.read.parquet(f"{base}/params").select(
        F.col("run_id").cast("string").alias("run_id"), F.lit("param").alias("kind"), "key",
        F.lit(None).cast("double").alias("value"), F.col("value").alias("text"))
    return metrics.unionByName(params)


def q_training_run(spark, sf_dir):
    """O3 (rows only): the fitted model's run - parameters, test metrics,
    importances and tags - appended to the run tables and read back."""
    from ..operators.runs import training_run, write_runs
    from ..operators.train import feature_importance, predict_batch
    model = _model(spark, sf_dir)
    scored = materialize(predict_batch(model, _test_rows(spark, sf_dir), ["label"]), name="predictions")
    path = scratch_path(spark, "training-run")
    write_runs(training_run(scored, feature_importance(spark, model), "gbt", tags={"model_type": "gbt"}), path)
    return round_doubles(spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string")))


def q_compare_runs(spark, sf_dir):
    """Runs side by side, best rmse first."""
    from ..operators.evaluate import compare_runs
    return round_doubles(compare_runs(_run_metrics(spark, sf_dir),
                                      ["rmse", "mae", "mse", "ndcg_10", "f1_score"]))


def q_resolve_model(spark, sf_dir):
    """Serving model for alias present / alias absent / no versions."""
    from ..operators.evaluate import resolve_model
    from ..operators.runs import register_versions
    m = materialize(_run_metrics(spark, sf_dir), name="run-metrics")
    versions = register_versions(m, MODEL_NAME)
    cases = [(MODEL_NAME, "production"), (MODEL_NAME, "staging"), ("missing-model", "production")]
    out = None
    for name, alias in cases:
        part = resolve_model(versions, m, name, alias).withColumn("requested_alias",
                                                                   F.lit(alias))
        out = part if out is None else out.unionByName(part)
    return round_doubles(out)


QUERIES = Q(
    scan_ratings=q_scan_ratings,
    train_test_split=q_train_test_split,
    train_test_split_exact=q_train_test_split_exact,
    user_stats=q_user_stats,
    place_stats=q_place_stats,
    category_stats=q_category_stats,
    city_stats=q_city_stats,
    global_stats=q_global_stats,
    user_category_pref=q_user_category_pref,
    user_city_pref=q_user_city_pref,
    user_price_stats=q_user_price_stats,
    preference_pivot=q_preference_pivot,
    join_user_stats=q_join_user_stats,
    join_place_stats=q_join_place_stats,
    join_category_city=q_join_category_city,
    join_preferences=q_join_preferences,
    join_user_price=q_join_user_price,
    cold_start_rows=q_cold_start_rows,
    place_popularity=q_place_popularity,
    price_ratio=q_price_ratio,
    user_place_deviation=q_user_place_deviation,
    rating_price_ratio=q_rating_price_ratio,
    feature_matrix=q_feature_matrix,
    parse_requests=q_parse_requests,
    validate_users=q_validate_users,
    validate_places=q_validate_places,
    validate_requests=q_validate_requests,
    default_fill=q_default_fill,
    explode_places=q_explode_places,
    serving_features=q_serving_features,
    serving_features_enriched=q_serving_features_enriched,
    clip_rating=q_clip_rating,
    confidence=q_confidence,
    round_scores=q_round_scores,
    rank_places=q_rank_places,
    top_recommendation=q_top_recommendation,
    recommend_top_k=q_recommend_top_k,
    recommend_summary=q_recommend_summary,
    diversity=q_diversity,
    request_response=q_request_response,
    recommend_response=q_recommend_response,
    standard_scale=q_standard_scale,
    regression_metrics=q_regression_metrics,
    binary_metrics=q_binary_metrics,
    ndcg_at_k=q_ndcg_at_k,
    baseline_predict=q_baseline_predict,
    train_gbt=q_train_gbt,
    predict_batch=q_predict_batch,
    model_metrics=q_model_metrics,
    model_rank_places=q_model_rank_places,
    feature_importance=q_feature_importance,
    save_load_model=q_save_load_model,
    recommendations_total=q_recommendations_total,
    gauge_last=q_gauge_last,
    model_gauge_last=q_model_gauge_last,
    model_rmse_gauge=q_model_rmse_gauge,
    confidence_histogram=q_confidence_histogram,
    request_rate=q_request_rate,
    counter_rate=q_counter_rate,
    recommendation_rate=q_recommendation_rate,
    endpoint_rates=q_endpoint_rates,
    bucket_rates=q_bucket_rates,
    latency_quantile=q_latency_quantile,
    threshold_status=q_threshold_status,
    excluded_handlers=q_excluded_handlers,
    in_progress=q_in_progress,
    relabel=q_relabel,
    sample_at_interval=q_sample_at_interval,
    retention=q_retention,
    retention_by_day=q_retention_by_day,
    load_summary=q_load_summary,
    stream_metrics=q_stream_metrics,
    stream_recommendations_total=q_stream_recommendations_total,
    stream_confidence_histogram=q_stream_confidence_histogram,
    stream_score=q_stream_score,
    stream_model_score=q_stream_model_score,
    stream_gauge_last=q_stream_gauge_last,
    stream_response_sink=q_stream_response_sink,
    serve_with_fallback=q_serve_with_fallback,
    response_sink=q_response_sink,
    run_metrics_sink=q_run_metrics_sink,
    training_run=q_training_run,
    compare_runs=q_compare_runs,
    resolve_model=q_resolve_model,
)
