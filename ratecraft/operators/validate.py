"""Request validation, defaults and explosion.

Validation is all-or-nothing per request, as in the original API: a
request is scored only when it parsed, its user is valid, it has 1..50
places and every place is valid.  All checks are array/struct expressions
on the nested row - no explode and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (MAX_AGE, MAX_PLACE_RATING, MAX_PLACES, MIN_AGE,
                         MIN_DURATION, MIN_PLACE_RATING, MIN_PLACES, MIN_PRICE)

REQUIRED_PLACE_FIELDS = ["place_id", "place_category", "place_city", "place_price",
                         "place_average_rating", "place_visit_duration_minutes"]


def user_valid(user: Column) -> Column:
    """User present and age in [18, 100]; a null age fails."""
    age = user["user_age"]
    return F.coalesce(user.isNotNull() & age.between(MIN_AGE, MAX_AGE), F.lit(False))


def place_violations(p: Column) -> Column:
    """Array of violated rule names for one place struct (empty = valid)."""
    missing = None
    for f in REQUIRED_PLACE_FIELDS:
        m = p[f].isNull()
        missing = m if missing is None else (missing | m)
    rules = [
        F.when(missing, F.lit("missing_field")),
        F.when(p["place_price"] < MIN_PRICE, F.lit("price_negative")),
        F.when(~p["place_average_rating"].between(MIN_PLACE_RATING, MAX_PLACE_RATING),
               F.lit("rating_out_of_range")),
        F.when(p["place_visit_duration_minutes"] < MIN_DURATION, F.lit("duration_too_short")),
    ]
    return F.array_compact(F.array(*rules))


def place_valid(p: Column) -> Column:
    return F.size(place_violations(p)) == 0


def request_status(parsed: DataFrame) -> DataFrame:
    """Add ``n_places``, ``valid`` and the first failing ``reason``."""
    n = F.coalesce(F.size("places"), F.lit(0))
    places_ok = F.coalesce(F.forall("places", place_valid), F.lit(True))
    reason = (F.when(F.col("malformed"), F.lit("malformed"))
              .when(F.col("user").isNull(), F.lit("missing_user"))
              .when(~user_valid(F.col("user")), F.lit("user_age"))
              .when(F.col("places").isNull(), F.lit("missing_places"))
              .when(~n.between(MIN_PLACES, MAX_PLACES), F.lit("place_count"))
              .when(~places_ok, F.lit("places")))
    return parsed.withColumns({"n_places": n, "reason": reason,
                               "valid": reason.isNull()})


def valid_requests(parsed: DataFrame) -> DataFrame:
    return request_status(parsed).where("valid").drop("reason", "valid")


def fill_defaults(parsed: DataFrame) -> DataFrame:
    """Optional user strings stay null; ``place_description`` -> ""."""
    return parsed.withColumn("places", F.transform(
        "places", lambda p: p.withField(
            "place_description", F.coalesce(p["place_description"], F.lit("")))))


def explode_places(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per (request, place) with its list position ``pos``.

    Flattens the user age and the place fields next to ``keep`` columns
    (default: all others, with the ``user`` struct, which responses echo).
    """
    keep = keep if keep is not None else [c for c in parsed.columns if c != "places"]
    x = parsed.select(*keep, F.col("user.user_age").alias("user_age"),
                      F.posexplode("places").alias("pos", "place"))
    return x.select(*keep, "user_age", "pos", "place.*")
