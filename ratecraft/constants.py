"""Fixed values.

These numbers, names and lists must equal the ones the original service
uses, or results differ.  They are stated once, here, in their natural order.
"""

# --- fixed values: feature vector, in model input order (22 entries) -------
FEATURE_NAMES = [
    "user_mean", "user_std", "user_count", "user_range",
    "place_mean", "place_std", "place_count", "place_popularity",
    "category_mean", "city_mean", "user_category_pref", "user_city_pref",
    "place_price", "user_avg_price", "price_ratio",
    "place_rating", "place_duration", "user_age",
    "user_place_deviation", "rating_price_ratio",
    "global_mean", "global_std",
]

# --- fixed values: training split and model --------------------------------
TRAIN_PERCENT = 80            # 80 / 20 split
SPLIT_SEED = 42
GBT_PARAMS = {"n_trees": 200, "max_depth": 8, "learning_rate": 0.1,
              "subsample": 0.8, "seed": 42}

# --- fixed values: evaluation ---------------------------------------------
RELEVANT_RATING = 4.0         # NDCG gain: rating >= 4.0
NDCG_K = 10
BINARY_THRESHOLD = 3.5        # precision / recall on both sides
FALLBACK_METRICS = {"rmse": 0.85, "mae": 0.65, "r2_score": 0.78}
TOP_FEATURES = 5

# --- fixed values: request validation --------------------------------------
MIN_AGE, MAX_AGE = 18, 100
MIN_PRICE = 0.0
MIN_PLACE_RATING, MAX_PLACE_RATING = 1.0, 5.0
MIN_DURATION = 30
MIN_PLACES, MAX_PLACES = 1, 50

# --- fixed values: serving feature defaults --------------------------------
SERVING_DEFAULTS = {
    "global_mean": 3.5, "global_std": 1.0,
    "category_mean": 3.5, "city_mean": 3.5,
    "user_mean": 3.5, "user_std": 1.0,
    "place_mean": 3.5, "place_std": 1.0,
}
SERVING_USER_COUNT = 10
SERVING_USER_RANGE = 4.0
SERVING_PLACE_COUNT = 50
SERVING_PLACE_STD_NO_STATS = 0.5   # used when a stats struct lacks place_std
SERVING_PRICE_MARKUP = 1.1         # user_avg_price = 1.1 * price

# --- fixed values: scoring -------------------------------------------------
RATING_MIN, RATING_MAX = 1.0, 5.0
CONFIDENCE_BASE, CONFIDENCE_SPAN = 0.8, 0.2
CONFIDENCE_CENTER, CONFIDENCE_HALF_RANGE = 3.5, 1.5
RATING_DIGITS, CONFIDENCE_DIGITS = 2, 3
DEFAULT_TOP_K = 5
SINGLE_PLACE_DIVERSITY = 0.5

# --- fixed values: metrics -------------------------------------------------
CONFIDENCE_BUCKETS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
RATE_WINDOW = "5 minutes"
RATE_WINDOW_SECONDS = 300
SCRAPE_INTERVAL = "10 seconds"
DEFAULT_SCRAPE_INTERVAL = "15 seconds"
DASHBOARD_RANGE = "30 minutes"
RETENTION = "200 hours"
QUANTILE = 0.95
EXCLUDED_HANDLERS = ["/metrics"]
DASHBOARD_HANDLERS = ["/predict", "/recommend", "/health"]
RMSE_BANDS = [(None, "green"), (0.5, "yellow"), (1.0, "red")]
DIVERSITY_BANDS = [(None, "red"), (0.3, "yellow"), (0.7, "green")]

# --- fixed values: pod relabelling rules of the scrape configuration --------
POD_RELABEL_RULES = [
    {"action": "keep", "source_labels": ["__meta_kubernetes_pod_label_app"],
     "regex": "fastapi-app"},
    {"action": "keep", "source_labels": ["__meta_kubernetes_pod_annotation_prometheus_io_scrape"],
     "regex": "true"},
    {"action": "replace", "source_labels": ["__meta_kubernetes_pod_annotation_prometheus_io_path"],
     "target_label": "__metrics_path__", "regex": "(.+)"},
    {"action": "replace",
     "source_labels": ["__address__", "__meta_kubernetes_pod_annotation_prometheus_io_port"],
     "regex": r"([^:]+)(?::\d+)?;(\d+)", "replacement": "$1:$2", "target_label": "__address__"},
    {"action": "labelmap", "regex": "__meta_kubernetes_pod_label_(.+)"},
    {"action": "replace", "source_labels": ["__meta_kubernetes_namespace"],
     "target_label": "kubernetes_namespace"},
    {"action": "replace", "source_labels": ["__meta_kubernetes_pod_name"],
     "target_label": "kubernetes_pod_name"},
]

# --- ours: latency buckets (seconds) for the request-log fixture ------------
LATENCY_BUCKETS = [50.0, 100.0, 200.0, 300.0, 400.0, 500.0]
