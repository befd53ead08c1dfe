"""O27-O30 scalar features, O32/O33 serving features, O34 scaler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (FEATURE_NAMES, SERVING_DEFAULTS, SERVING_PLACE_COUNT,
                         SERVING_PLACE_STD_NO_STATS, SERVING_PRICE_MARKUP,
                         SERVING_USER_COUNT, SERVING_USER_RANGE)
from ..functions import safe_ratio


def place_popularity(place_count: Column) -> Column:
    """O27 log1p(place_count)."""
    return F.log1p(place_count)


def price_ratio(price: Column, user_avg_price: Column) -> Column:
    """O28 price / user_avg_price if user_avg_price > 0 else 1.0."""
    return safe_ratio(price, user_avg_price, 1.0)


def user_place_deviation(user_mean: Column, place_mean: Column) -> Column:
    """O29 |user_mean - place_mean|."""
    return F.abs(user_mean - place_mean)


def rating_price_ratio(rating: Column, price: Column) -> Column:
    """O30 rating / log1p(price) if price > 0 else rating."""
    return F.when(price > 0, rating / F.log1p(price)).otherwise(rating)


def add_scalar_features(df: DataFrame) -> DataFrame:
    """O27-O30 plus the renamed context columns of the feature vector."""
    return df.withColumns({
        "place_popularity": place_popularity(F.col("place_count")),
        "price_ratio": price_ratio(F.col("place_price"), F.col("user_avg_price")),
        "place_rating": F.col("place_average_rating"),
        "place_duration": F.col("place_visit_duration_minutes").cast("double"),
        "user_age_f": F.col("user_age").cast("double"),
        "user_place_deviation": user_place_deviation(F.col("user_mean"), F.col("place_mean")),
        "rating_price_ratio": rating_price_ratio(F.col("place_average_rating"),
                                                 F.col("place_price")),
    })


def feature_columns() -> list[Column]:
    """The 22 features in model order, all double."""
    out = []
    for n in FEATURE_NAMES:
        src = "user_age_f" if n == "user_age" else n
        out.append(F.col(src).cast("double").alias(n))
    return out


# ------------------------------------------------------------- serving ----
def serving_features(places: DataFrame, stats_col: str | None = None) -> DataFrame:
    """Request-side feature vector per exploded (request, place) row.

    ``places`` carries ``user_age`` and the place fields.  Without a stats
    struct the fixed defaults apply; a stats struct (``stats_col``, schema
    ``SERVING_STATS``) overrides them field by field - a missing
    ``place_mean`` falls back to the place's average rating and a missing
    ``place_std`` to 0.5, as in the original.
    """
    d = SERVING_DEFAULTS
    price = F.col("place_price")
    rating = F.col("place_average_rating")

    if stats_col is None:
        def stat(name: str, default):
            return F.lit(float(default))
        place_mean, place_std = F.lit(d["place_mean"]), F.lit(d["place_std"])
    else:
        def stat(name: str, default):
            v = F.col(stats_col)[name]
            return F.coalesce(v, F.lit(float(default)))
        place_mean = F.coalesce(F.col(stats_col)["place_mean"], rating)
        place_std = F.coalesce(F.col(stats_col)["place_std"], F.lit(SERVING_PLACE_STD_NO_STATS))

    user_mean = stat("user_mean", d["user_mean"])
    category_mean = stat("category_mean", d["category_mean"])
    city_mean = stat("city_mean", d["city_mean"])
    user_avg_price = price * F.lit(SERVING_PRICE_MARKUP)
    cols = {
        "user_mean": user_mean,
        "user_std": stat("user_std", d["user_std"]),
        "user_count": F.lit(float(SERVING_USER_COUNT)),
        "user_range": F.lit(float(SERVING_USER_RANGE)),
        "place_mean": place_mean,
        "place_std": place_std,
        "place_count": F.lit(float(SERVING_PLACE_COUNT)),
        "place_popularity": F.log1p(F.lit(float(SERVING_PLACE_COUNT))),
        "category_mean": category_mean,
        "city_mean": city_mean,
        "user_category_pref": category_mean,
        "user_city_pref": city_mean,
        "user_avg_price": user_avg_price,
        "price_ratio": price_ratio(price, user_avg_price),
        "place_rating": rating,
        "place_duration": F.col("place_visit_duration_minutes").cast("double"),
        "user_age_f": F.col("user_age").cast("double"),
        "user_place_deviation": user_place_deviation(user_mean, place_mean),
        "rating_price_ratio": rating_price_ratio(rating, price),
        "global_mean": stat("global_mean", d["global_mean"]),
        "global_std": stat("global_std", d["global_std"]),
    }
    return places.withColumns(cols)


# -------------------------------------------------------------- scaler ----
def fit_scaler(train: DataFrame, cols: list[str] = FEATURE_NAMES) -> DataFrame:
    """O34 fit: one-row table of mean and *population* std per column
    (one aggregate pass) and the row count for the constant-column test."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mu"), F.var_pop(c).alias(f"{c}__var")]
    return train.agg(*aggs)


# fixed value: float64 machine epsilon, used by the constant-column test
EPS = 2.220446049250313e-16


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: list[str] = FEATURE_NAMES) -> DataFrame:
    """O34 transform: (x - mean) / std.  A column counts as constant - divisor
    1 - when var <= n*eps*var + (n*mean*eps)^2, the rounding-error bound the
    original scaler uses.  The one-row scaler is broadcast (exactly one row)."""
    j = df.crossJoin(F.broadcast(scaler))
    n = F.col("__n")
    out = {}
    for c in cols:
        mu, var = F.col(f"{c}__mu"), F.col(f"{c}__var")
        bound = n * F.lit(EPS) * var + (n * mu * F.lit(EPS)) * (n * mu * F.lit(EPS))
        div = F.when(var <= bound, F.lit(1.0)).otherwise(F.sqrt(var))
        out[c] = (F.col(c) - mu) / div
    helpers = ["__n"] + [f"{c}__{s}" for c in cols for s in ("mu", "var")]
    keep = [F.col(c) for c in df.columns if c not in out]
    return j.select(*keep, *[v.alias(k) for k, v in out.items()]).drop(*helpers)
