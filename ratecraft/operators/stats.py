"""Rating statistics over the training rows.

Statistics read the *whole* rating table and use conditional aggregates
(``avg(when(is_train, rating))``), so one pass yields both the training
statistics and the total row count per key (``*_rows``) that the
skew-aware joins need.  ``grouped_statistics`` computes every per-key table
in a single grouping-sets pass and ``pair_statistics`` the pairs (used by the
feature matrix); the per-key functions below give the same tables one key at a
time.  Partial (map-side) aggregation runs before the shuffle - for pairs where
a user is hot - so a key holding a third of the rows costs one partial row per
task, not a third of the data in one task.

Semantics follow the original pandas code:
* null keys are dropped before grouping;
* a key is *present* when it has at least one training row;
* mean/std/min/max of a present key with only null ratings become 0;
* std is the sample std, 0 for a single rating;
* category and city statistics include rows with a null user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .split import TRAIN_FLAG

RATING = "user_rating"
PRICE = "place_price"


def _train(c: str) -> Column:
    return F.when(F.col(TRAIN_FLAG), F.col(c))


def _z(c: Column) -> Column:
    """pandas ``fillna(0)``."""
    return F.coalesce(c, F.lit(0.0))


def user_table(rows: DataFrame) -> DataFrame:
    """Per user (O12 + O19 in one pass): rating and price statistics.

    Columns: user_id, u_rows, u_present, user_mean, user_std, user_count,
    user_min, user_max, user_range, user_avg_price, user_price_std.
    """
    r, p = _train(RATING), _train(PRICE)
    agg = (rows.where(F.col("user_id").isNotNull())
           .groupBy("user_id")
           .agg(F.count(F.lit(1)).alias("u_rows"),
                F.count_if(F.col(TRAIN_FLAG)).alias("u_train"),
                F.avg(r).alias("m"), F.stddev_samp(r).alias("s"),
                F.count(r).alias("c"), F.min(r).alias("lo"), F.max(r).alias("hi"),
                F.avg(p).alias("pm"), F.stddev_samp(p).alias("ps")))
    return agg.select(
        "user_id", "u_rows", (F.col("u_train") > 0).alias("u_present"),
        _z(F.col("m")).alias("user_mean"), _z(F.col("s")).alias("user_std"),
        F.col("c").cast("double").alias("user_count"),
        _z(F.col("lo")).alias("user_min"), _z(F.col("hi")).alias("user_max"),
        (_z(F.col("hi")) - _z(F.col("lo"))).alias("user_range"),
        _z(F.col("pm")).alias("user_avg_price"), _z(F.col("ps")).alias("user_price_std"))


def place_table(rows: DataFrame) -> DataFrame:
    """Per place (O13): place_id, p_rows, p_present, place_mean, place_std,
    place_count, place_min, place_max."""
    r = _train(RATING)
    agg = (rows.where(F.col("place_id").isNotNull())
           .groupBy("place_id")
           .agg(F.count(F.lit(1)).alias("p_rows"),
                F.count_if(F.col(TRAIN_FLAG)).alias("p_train"),
                F.avg(r).alias("m"), F.stddev_samp(r).alias("s"),
                F.count(r).alias("c"), F.min(r).alias("lo"), F.max(r).alias("hi")))
    return agg.select(
        "place_id", "p_rows", (F.col("p_train") > 0).alias("p_present"),
        _z(F.col("m")).alias("place_mean"), _z(F.col("s")).alias("place_std"),
        F.col("c").cast("double").alias("place_count"),
        _z(F.col("lo")).alias("place_min"), _z(F.col("hi")).alias("place_max"))


def pair_table(rows: DataFrame, other: str, prefix: str) -> DataFrame:
    """Per (user_id, ``other``) incl. null keys: rows, training rows, rating
    sum and count: the source of the preference lookups."""
    r = _train(RATING)
    return (rows.groupBy("user_id", other)
            .agg(F.count(F.lit(1)).alias(f"{prefix}_rows"),
                 F.count_if(F.col(TRAIN_FLAG)).alias(f"{prefix}_train"),
                 F.sum(r).alias(f"{prefix}_sum"),
                 F.count(r).alias(f"{prefix}_cnt")))


def preference_table(pairs: DataFrame, other: str, prefix: str, out: str) -> DataFrame:
    """O17/O18 lookup table: present pair -> mean rating (null if all its
    ratings are null); absent pairs are filled by the join with the global
    mean.  Null keys are dropped."""
    cnt = F.col(f"{prefix}_cnt")
    return (pairs.where(F.col("user_id").isNotNull() & F.col(other).isNotNull())
            .select("user_id", other, f"{prefix}_rows",
                    (F.col(f"{prefix}_train") > 0).alias(f"{prefix}_present"),
                    F.when(cnt > 0, F.col(f"{prefix}_sum") / cnt).alias(out)))


def level_table(rows: DataFrame, key: str, prefix: str, mean_out: str,
                count_out: str) -> DataFrame:
    """Per category (or city) mean and count, grouped directly: one
    partial row per key and task is all that is shuffled.  Absent and
    all-null keys follow pandas."""
    r = _train(RATING)
    agg = (rows.where(F.col(key).isNotNull())
           .groupBy(key)
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(TRAIN_FLAG)).alias("t"),
                F.sum(r).alias("s"), F.count(r).alias("c")))
    present = F.col("t") > 0
    return agg.select(
        key, F.col("n").alias(f"{prefix}_all"), present.alias(f"{prefix}_present"),
        _z(F.when(F.col("c") > 0, F.col("s") / F.col("c"))).alias(mean_out),
        F.col("c").cast("double").alias(count_out))


def global_table(rows: DataFrame) -> DataFrame:
    """One row, global mean and sample std of training ratings
    (no fill: undefined stays null)."""
    r = _train(RATING)
    return rows.agg(F.avg(r).alias("global_mean"), F.stddev_samp(r).alias("global_std"))


# ------------------------------------------------ one-pass statistics -----
KEYS = ["user_id", "place_id", "place_category", "place_city"]
# grouping_id bits follow KEYS: a 1 bit means the key is rolled up.
GID_USER, GID_PLACE, GID_USER_CAT, GID_USER_CITY, GID_ALL = 0b0111, 0b1011, 0b0101, 0b0110, 0b1111
GID_CAT, GID_CITY = 0b1101, 0b1110


def grouped_statistics(rows: DataFrame) -> DataFrame:
    """Every statistic per user, place, category, city and of all rows in ONE
    pass: ``GROUPING SETS`` with the union of the aggregates.  Spark expands each
    row once per set inside the task and aggregates partially before the single
    shuffle.  Pairs are apart (``pair_statistics``): there are nearly as many of
    them as rows, and they need few of the aggregates."""
    r, p = _train(RATING), _train(PRICE)
    sets = [["user_id"], ["place_id"], ["place_category"], ["place_city"], []]
    return (rows.groupingSets(sets, *KEYS)
            .agg(F.grouping_id().alias("gid"),
                 F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col(TRAIN_FLAG)).alias("n_train"),
                 F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.count(r).alias("c"),
                 F.sum(r).alias("sm"), F.min(r).alias("lo"), F.max(r).alias("hi"),
                 F.avg(p).alias("pm"), F.stddev_samp(p).alias("ps")))


# Rating rows per task of ``pair_statistics``: its hash tables fit a task's memory.
PAIR_ROWS = 500_000


def pair_statistics(rows: DataFrame, n_rows: int, hot: bool) -> DataFrame:
    """Rows, training rows, rating sum and count per (user, category) and (user,
    city), by ``gid``; rows without a user are left out.

    Aggregating before the shuffle saves next to nothing here and takes hash
    tables as large as a task's input, so what is shuffled is one narrow row per
    rating, by user, and both kinds of pairs are added up where it arrives.  With
    ``hot`` users, whose rows one task should not take, the pairs are aggregated
    partially first."""
    kind = {c: rows.schema[c].dataType for c in ("place_category", "place_city")}
    own = rows.where(F.col("user_id").isNotNull()).select("user_id", *kind, TRAIN_FLAG, _train(RATING).alias("_r"))
    if not hot:
        own = own.repartition(max(1, -(-n_rows // PAIR_ROWS)), "user_id")
    none = {c: F.lit(None).cast(t).alias(c) for c, t in kind.items()}
    pairs = F.array(F.struct(F.lit(GID_USER_CAT).alias("gid"), F.col("place_category"), none["place_city"]),
                    F.struct(F.lit(GID_USER_CITY).alias("gid"), none["place_category"], F.col("place_city")))
    return (own.select("user_id", TRAIN_FLAG, "_r", F.inline(pairs)).groupBy("user_id", "gid", *kind)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(TRAIN_FLAG)).alias("n_train"),
                 F.sum("_r").alias("sm"), F.count("_r").alias("c")))


def split_statistics(g: DataFrame, p: DataFrame) -> dict[str, DataFrame]:
    """Per-set tables with the column names of the single-key functions, from
    ``grouped_statistics`` and ``pair_statistics``."""
    gid = F.col("gid")
    users = g.where((gid == GID_USER) & F.col("user_id").isNotNull()).select(
        "user_id", F.col("n_rows").alias("u_rows"), (F.col("n_train") > 0).alias("u_present"),
        _z(F.col("m")).alias("user_mean"), _z(F.col("s")).alias("user_std"),
        F.col("c").cast("double").alias("user_count"),
        _z(F.col("lo")).alias("user_min"), _z(F.col("hi")).alias("user_max"),
        (_z(F.col("hi")) - _z(F.col("lo"))).alias("user_range"),
        _z(F.col("pm")).alias("user_avg_price"), _z(F.col("ps")).alias("user_price_std"))
    places = g.where((gid == GID_PLACE) & F.col("place_id").isNotNull()).select(
        "place_id", F.col("n_rows").alias("p_rows"), (F.col("n_train") > 0).alias("p_present"),
        _z(F.col("m")).alias("place_mean"), _z(F.col("s")).alias("place_std"),
        F.col("c").cast("double").alias("place_count"),
        _z(F.col("lo")).alias("place_min"), _z(F.col("hi")).alias("place_max"))

    def pairs(g_id, other, prefix):
        return p.where(gid == g_id).select(
            "user_id", other, F.col("n_rows").alias(f"{prefix}_rows"),
            F.col("n_train").alias(f"{prefix}_train"), F.col("sm").alias(f"{prefix}_sum"),
            F.col("c").alias(f"{prefix}_cnt"))
    glob = g.where(gid == GID_ALL).select(F.col("m").alias("global_mean"),
                                          F.col("s").alias("global_std"))

    def level(g_id, key, prefix, mean_out, count_out):
        return g.where((gid == g_id) & F.col(key).isNotNull()).select(
            key, F.col("n_rows").alias(f"{prefix}_all"),
            (F.col("n_train") > 0).alias(f"{prefix}_present"),
            _z(F.col("m")).alias(mean_out), F.col("c").cast("double").alias(count_out))
    return {"users": users, "places": places,
            "categories": level(GID_CAT, "place_category", "uc", "category_mean",
                                "category_count"),
            "cities": level(GID_CITY, "place_city", "ucy", "city_mean", "city_count"),
            "uc_pairs": pairs(GID_USER_CAT, "place_category", "uc"),
            "uy_pairs": pairs(GID_USER_CITY, "place_city", "ucy"), "glob": glob}


def set_facts(g: DataFrame) -> dict[int, tuple[int, int]]:
    """Per grouping set: (number of keys, rows of the largest key).  One
    small job; at most one row per set reaches the driver.  The join plan
    takes every skew and broadcast decision from these numbers."""
    rows = (g.groupBy("gid").agg(F.count(F.lit(1)).alias("n_keys"),
                                 F.max("n_rows").alias("max_rows")).collect())
    return {int(r["gid"]): (int(r["n_keys"]), int(r["max_rows"] or 0)) for r in rows}


# -------------------------------------------------------- query forms -----
def user_stats(rows: DataFrame) -> DataFrame:
    """O12 user_stats (present users only)."""
    return (user_table(rows).where("u_present")
            .select("user_id", "user_mean", "user_std", "user_count", "user_min", "user_max"))


def place_stats(rows: DataFrame) -> DataFrame:
    """O13 place_stats."""
    return (place_table(rows).where("p_present")
            .select("place_id", "place_mean", "place_std", "place_count", "place_min", "place_max"))


def category_stats(rows: DataFrame) -> DataFrame:
    """O14 category_stats."""
    t = level_table(rows, "place_category", "uc", "category_mean", "category_count")
    return t.where("uc_present").drop("uc_present", "uc_all")


def city_stats(rows: DataFrame) -> DataFrame:
    """O15 city_stats."""
    t = level_table(rows, "place_city", "ucy", "city_mean", "city_count")
    return t.where("ucy_present").drop("ucy_present", "ucy_all")


def user_category_pref(rows: DataFrame) -> DataFrame:
    """O17 present (user, category) pairs with their mean rating."""
    t = preference_table(pair_table(rows, "place_category", "uc"), "place_category", "uc",
                         "user_category_pref")
    return t.where("uc_present").select("user_id", "place_category", "user_category_pref")


def user_city_pref(rows: DataFrame) -> DataFrame:
    """O18 present (user, city) pairs with their mean rating."""
    t = preference_table(pair_table(rows, "place_city", "ucy"), "place_city", "ucy",
                         "user_city_pref")
    return t.where("ucy_present").select("user_id", "place_city", "user_city_pref")


def user_price_stats(rows: DataFrame) -> DataFrame:
    """O19 per user mean and sample std of price (nulls -> 0)."""
    return (user_table(rows).where("u_present")
            .select("user_id", "user_avg_price", "user_price_std"))


def preference_pivot(rows: DataFrame, categories: list[str]) -> DataFrame:
    """O20 wide user x category matrix with a column for each of the caller's
    ``categories``; absent pairs take the global mean, a present pair whose
    ratings are all null stays null.  (The long form of the same matrix, for
    any number of categories, is ``user_category_pref``.)  A category that has no
    column ends the job: its ratings would be lost without a word.
    """
    known = F.col("place_category").isin(categories)
    pairs = preference_table(pair_table(rows, "place_category", "uc"),
                             "place_category", "uc", "pref").where("uc_present").withColumn(
        "place_category", F.when(known, F.col("place_category")).otherwise(F.raise_error(
            F.concat(F.lit("preference_pivot has no column for category "), "place_category"))))
    # marker keeps "present but null" apart from "absent"
    wide = (pairs.groupBy("user_id").pivot("place_category", categories)
            .agg(F.first(F.struct(F.col("pref").alias("v")), ignorenulls=False)))
    g = global_table(rows)
    out = wide.crossJoin(F.broadcast(g))
    cols = [F.when(F.col(f"`{c}`").isNull(), F.col("global_mean"))
            .otherwise(F.col(f"`{c}`.v")).alias(c) for c in categories]
    return out.select("user_id", *cols)
