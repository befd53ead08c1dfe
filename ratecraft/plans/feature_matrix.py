"""O31 feature_matrix: the 22-feature training / test matrix in one plan.

Plan shape (see ``explain``):

* ONE grouping-sets pass over the rating rows computes the statistics per
  user (O12+O19), place (O13), category (O14), city (O15) and global (O16),
  partially aggregated before its single shuffle; the (user, category) and
  (user, city) pairs (O17/O18) come from one shuffle of narrow rows by user.
  Both are written once as Parquet in the shared checkpoint folder,
  partitioned by grouping set.
* one small job reads per set the number of keys and the rows of the
  largest key; these decide salting (hot keys) and broadcasting (small
  category / city tables) for the joins below, with no job per join.
* the rating rows then meet the users once and the places once (O21-O25):
  a user's row carries the statistics and two maps with the category and
  city preferences - as long as there are few enough categories and cities to
  bound a map; beyond it the preferences are two joins on (user, category) and
  (user, city).  All are shuffle joins with salted hot and null keys;
  category / city are checked broadcasts (salted joins beyond the bound),
  the globals a one-row broadcast.
* scalar features (O27-O30) are plain column expressions in the same
  whole-stage-codegen stage as the last join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FEATURE_NAMES
from ..functions import round_doubles
from ..operators import features, joins, stats
from ..operators.split import TRAIN_FLAG, with_split
from ..plans.skew import MAX_BROADCAST_ROWS, ROWS_PER_TASK
from .materialize import materialize


class StatTables(NamedTuple):
    users: DataFrame
    places: DataFrame
    categories: DataFrame
    cities: DataFrame
    user_cat: DataFrame
    user_city: DataFrame
    glob: DataFrame
    facts: dict | None = None      # grouping id -> (keys, rows of largest key)


def stat_tables(rows: DataFrame, checkpoint: bool = True, rows_per_task: int = ROWS_PER_TASK) -> StatTables:
    """Every statistic of O12-O19 from rating rows carrying ``is_train``.

    One grouping-sets pass computes the per-key aggregates, a second pass those
    of pairs; with ``checkpoint`` the two tables (aggregates, far smaller than
    the ratings) are written to the shared checkpoint folder, so the joins that
    follow plan and recover from a short lineage."""
    g = materialize(stats.grouped_statistics(rows), checkpoint, "statistics",
                    partition_by=["gid"])
    facts = stats.set_facts(g)
    p = materialize(stats.pair_statistics(rows, facts.get(stats.GID_ALL, (0, 0))[1],
                                          facts.get(stats.GID_USER, (0, 0))[1] > rows_per_task),
                    checkpoint, "pair-statistics", partition_by=["gid"])
    t = stats.split_statistics(g, p)
    uc, uy = t["uc_pairs"], t["uy_pairs"]
    return StatTables(
        users=t["users"],
        places=t["places"],
        categories=t["categories"],
        cities=t["cities"],
        user_cat=stats.preference_table(uc, "place_category", "uc", "user_category_pref"),
        user_city=stats.preference_table(uy, "place_city", "ucy", "user_city_pref"),
        glob=t["glob"],
        facts={**facts, **stats.set_facts(p)},
    )


def attach_stats(target: DataFrame, t: StatTables, *, salt_cols: list[str] | None,
                 count_big: bool = False, rows_per_task: int = ROWS_PER_TASK,
                 max_map_entries: int | None = None) -> DataFrame:
    """O21-O25 + O27-O30 on any rows with the rating columns.

    ``count_big`` makes the skew split count ``target`` rows per key (use it
    when ``target`` is not the table the statistics came from).  Whether a
    join needs salting and whether category / city tables are broadcast is
    decided from per-set key counts measured once (``facts``), not by a job
    per join.
    """
    facts = t.facts or {}
    counts = None
    if count_big:
        # categories and cities that are broadcast need no counts
        salted = [k for k, gid in (("category", stats.GID_CAT), ("city", stats.GID_CITY))
                  if facts.get(gid, (MAX_BROADCAST_ROWS + 1, 0))[0] > MAX_BROADCAST_ROWS]
        counts, facts_big = joins.key_counts(target, ("user", "place", *salted))
        hot_facts = facts_big
    else:
        hot_facts = facts

    def hot(gid):
        f = hot_facts.get(gid)
        return None if f is None else f[1] > rows_per_task

    def keys(gid):
        f = facts.get(gid)
        return None if f is None else f[0]

    kw = dict(salt_cols=salt_cols, count_from=counts, rows_per_task=rows_per_task)
    # a user's maps are bounded by the measured number of categories and cities
    bound = joins.MAX_MAP_ENTRIES if max_map_entries is None else max_map_entries
    as_maps = facts and max(keys(stats.GID_CAT) or 0, keys(stats.GID_CITY) or 0) <= bound
    # places first and categories last, so that the rows shuffled are narrow
    x = joins.with_globals(target, t.glob)
    x = joins.join_place_stats(x, t.places, has_hot=hot(stats.GID_PLACE), **kw)
    if as_maps:
        profiles = joins.user_profiles(t.users, t.user_cat, t.user_city)
        x = joins.join_user_profiles(x, profiles, has_hot=hot(stats.GID_USER), **kw)
    else:
        x = joins.join_user_stats(x, t.users, has_hot=hot(stats.GID_USER), **kw)
        x = joins.join_preference_pairs(
            x, t.user_cat, t.user_city, salt_cols=salt_cols, counted=not count_big, rows_per_task=rows_per_task,
            has_hot=(None, None) if count_big else (hot(stats.GID_USER_CAT), hot(stats.GID_USER_CITY)))
    x = joins.join_category_city(x, t.categories, t.cities,
                                 known_rows=(keys(stats.GID_CAT), keys(stats.GID_CITY)), **kw)
    return features.add_scalar_features(x)


def joined_rows(ratings: DataFrame, *, key_cols: list[str], bucket_col: str = "split_bucket",
                rows_per_task: int = ROWS_PER_TASK, max_map_entries: int | None = None) -> DataFrame:
    """Rating rows with every statistic joined (defaults applied), plus the
    ``*_present`` flags that tell which lookups fell back."""
    rows = with_split(ratings, bucket_col=bucket_col, key_cols=key_cols)
    return attach_stats(rows, stat_tables(rows, rows_per_task=rows_per_task), salt_cols=key_cols,
                        rows_per_task=rows_per_task, max_map_entries=max_map_entries)


def feature_matrix(ratings: DataFrame, *, key_cols: list[str], label: str = "user_rating",
                   bucket_col: str = "split_bucket", digits: int | None = 6,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Row key, ``is_train``, the 22 features in model order, and the label.

    ``digits`` rounds doubles for comparison with other engines; pass
    ``None`` to keep full precision (training does).
    """
    x = joined_rows(ratings, key_cols=key_cols, bucket_col=bucket_col,
                    rows_per_task=rows_per_task)
    out = x.select(*key_cols, F.col(TRAIN_FLAG), *features.feature_columns(),
                   F.col(label).cast("double").alias("label"))
    return round_doubles(out, digits) if digits is not None else out


__all__ = ["feature_matrix", "joined_rows", "stat_tables", "attach_stats", "FEATURE_NAMES"]
