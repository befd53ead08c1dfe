"""Left equi-joins of rating rows with statistics, with defaults.

The original looks statistics up row by row (``.loc[key] if key in index
else default``).  Here the lookups are left joins.  Everything kept per user -
statistics and preferences - is one row with two maps, so the rows meet the
users once; users and places go through ``salted_join`` so a hot key is
spread over several tasks; the small category / city tables are broadcast
after a row-count check.  Rows must already carry ``global_mean`` and
``global_std`` (one-row cross join, see ``with_globals``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from ..plans.skew import ROWS_PER_TASK, bounded_broadcast, salted_join


def GM():
    return F.col("global_mean")


def GS():
    return F.col("global_std")


def with_globals(rows: DataFrame, glob: DataFrame) -> DataFrame:
    """Attach the one-row global statistics (a broadcast of exactly one row)."""
    return rows.crossJoin(F.broadcast(glob))


def _counts(count_from: dict | None, kind: str):
    """Per-key row counts of the joined rows (``key_counts``), or None to use
    the counts stored in the statistics table."""
    return None if count_from is None else count_from[kind]


def key_counts(rows: DataFrame, kinds: tuple[str, ...] = ("user", "place", "category", "city"),
               ) -> tuple[dict[str, DataFrame], dict[int, tuple[int, int]]]:
    """Rows per user, place, category and city of ``rows`` - or of those
    ``kinds`` alone - in ONE grouping-sets pass (partial aggregation before one
    shuffle); used to find hot keys when ``rows`` is not the statistics' source.
    Also returns per-set (keys, rows of the largest key) from one small job."""
    from .stats import GID_CAT, GID_CITY, GID_PLACE, GID_USER, KEYS
    pick = {"user": (GID_USER, "user_id"), "place": (GID_PLACE, "place_id"),
            "category": (GID_CAT, "place_category"), "city": (GID_CITY, "place_city")}
    pick = {k: pick[k] for k in kinds}
    g = materialize(rows.groupingSets([[col] for _, col in pick.values()], *KEYS)
                    .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("__rows")),
                    name="key-counts", partition_by=["gid"])
    facts = {int(r["gid"]): (int(r["n"]), int(r["mx"] or 0)) for r in
             g.groupBy("gid").agg(F.count(F.lit(1)).alias("n"),
                                  F.max("__rows").alias("mx")).collect()}
    return ({k: g.where(F.col("gid") == gid).select(col, "__rows")
             for k, (gid, col) in pick.items()}, facts)


def _present(flag: str, value, default):
    return F.when(F.col(flag), value).otherwise(default)


def _finish(j: DataFrame, new: dict, drop: list[str]) -> DataFrame:
    """One projection: replace/add ``new`` columns, drop helpers."""
    keep = [F.col(f"`{c}`") for c in j.columns if c not in new and c not in drop]
    return j.select(*keep, *[v.alias(k) for k, v in new.items()])


USER_VALUES = {"_um": "user_mean", "_us": "user_std", "_uc": "user_count",
               "_ur": "user_range", "_uap": "user_avg_price"}


def _user_columns() -> dict:
    return {
        "u_present": F.coalesce(F.col("u_present"), F.lit(False)),
        "user_mean": _present("u_present", F.col("_um"), GM()),
        "user_std": _present("u_present", F.col("_us"), GS()),
        "user_count": _present("u_present", F.col("_uc"), F.lit(0.0)),
        "user_range": _present("u_present", F.col("_ur"), F.lit(0.0)),
        "user_avg_price": _present("u_present", F.col("_uap"), F.col("place_price")),
    }


def _preference_columns() -> dict:
    """Entries of the two preference maps: an absent pair takes the global
    mean, a present pair with only null ratings stays null."""
    out = {}
    for flag, value, entries, key in (("uc_present", "user_category_pref", "_ucm", "place_category"),
                                      ("ucy_present", "user_city_pref", "_uym", "place_city")):
        entry = F.try_element_at(F.col(entries), F.col(key))
        out[flag] = entry.isNotNull()
        out[value] = F.when(entry.isNotNull(), entry["v"]).otherwise(GM())
    return out


def user_profiles(users: DataFrame, user_cat: DataFrame, user_city: DataFrame) -> DataFrame:
    """One row per user: the user's statistics and two maps, category ->
    preference and city -> preference, of the pairs that have training rows.
    A map has at most as many entries as there are categories (cities); its
    values are structs, so that a present pair without a mean is kept."""
    def entries(pairs, key, prefix, value, name):
        return (pairs.where(F.col(f"{prefix}_present")).groupBy("user_id")
                .agg(F.map_from_entries(F.collect_list(F.struct(
                    key, F.struct(F.col(value).alias("v"))))).alias(name)))
    return (users.join(entries(user_cat, "place_category", "uc", "user_category_pref", "_ucm"),
                       "user_id", "left")
            .join(entries(user_city, "place_city", "ucy", "user_city_pref", "_uym"),
                  "user_id", "left"))


def _join_user(rows: DataFrame, users: DataFrame, cols: list, new: dict, *, salt_cols, count_from,
               has_hot, rows_per_task) -> DataFrame:
    u = users.select("user_id", "u_rows", *cols)
    j = salted_join(rows, u, ["user_id"],
                    rows_col="__rows" if count_from is not None else "u_rows",
                    counts=_counts(count_from, "user"), has_hot=has_hot,
                    salt_cols=salt_cols, rows_per_task=rows_per_task)
    return _finish(j, new, [c for c in j.columns if c.startswith("_")] + ["u_rows"])


def _user_inputs() -> list:
    return ["u_present", *[F.col(c).alias(a) for a, c in USER_VALUES.items()]]


def join_user_stats(rows: DataFrame, users: DataFrame, *, salt_cols=None, count_from=None,
                    has_hot: bool | None = None,
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """O21 + O25: user_mean/std (default global), count/range (default 0),
    user_avg_price (default this row's price); keeps flag ``u_present``."""
    return _join_user(rows, users, _user_inputs(), _user_columns(), salt_cols=salt_cols,
                      count_from=count_from, has_hot=has_hot, rows_per_task=rows_per_task)


def join_preferences(rows: DataFrame, profiles: DataFrame, *, salt_cols=None, count_from=None,
                     has_hot: bool | None = None,
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """User-category and user-city preference from ``user_profiles``, by
    one join on the user."""
    return _join_user(rows, profiles, ["_ucm", "_uym"], _preference_columns(), salt_cols=salt_cols,
                      count_from=count_from, has_hot=has_hot, rows_per_task=rows_per_task)


# Categories (cities) up to which a user's preferences are one map in the user's
# row: the map cannot have more entries than there are categories.
MAX_MAP_ENTRIES = 10_000


def join_preference_pairs(rows: DataFrame, user_cat: DataFrame, user_city: DataFrame, *, salt_cols=None,
                          has_hot: tuple[bool | None, bool | None] = (None, None), counted: bool = False,
                          rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """O24 without maps: two joins on (user, category) and (user, city), for any
    number of categories or cities.  Pairs with many rows and null keys are
    salted.  ``counted``: the tables' own row counts are those of ``rows``."""
    for pairs, key, prefix, value, hot in ((user_cat, "place_category", "uc", "user_category_pref", has_hot[0]),
                                           (user_city, "place_city", "ucy", "user_city_pref", has_hot[1])):
        own = pairs.select("user_id", key, f"{prefix}_rows", F.col(f"{prefix}_present").alias("_there"), F.col(value).alias("_value"))
        j = salted_join(rows, own, ["user_id", key], rows_col=f"{prefix}_rows" if counted else None, has_hot=hot,
                        salt_cols=salt_cols, rows_per_task=rows_per_task)
        there = F.coalesce("_there", F.lit(False))
        rows = _finish(j, {f"{prefix}_present": there, value: F.when(there, F.col("_value")).otherwise(GM())},
                       ["_there", "_value", f"{prefix}_rows"])
    return rows


def join_user_profiles(rows: DataFrame, profiles: DataFrame, *, salt_cols=None, count_from=None,
                       has_hot: bool | None = None,
                       rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """O21 + O24 + O25 in one join on the user."""
    return _join_user(rows, profiles, [*_user_inputs(), "_ucm", "_uym"],
                      {**_user_columns(), **_preference_columns()}, salt_cols=salt_cols,
                      count_from=count_from, has_hot=has_hot, rows_per_task=rows_per_task)


def join_place_stats(rows: DataFrame, places: DataFrame, *, salt_cols=None, count_from=None,
                     has_hot: bool | None = None,
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """place_mean/std (default global), place_count (default 0)."""
    p = places.select("place_id", "p_rows", "p_present",
                      F.col("place_mean").alias("_pm"), F.col("place_std").alias("_ps"),
                      F.col("place_count").alias("_pc"))
    j = salted_join(rows, p, ["place_id"], rows_col="__rows" if count_from is not None else "p_rows",
                    counts=_counts(count_from, "place"), has_hot=has_hot,
                    salt_cols=salt_cols, rows_per_task=rows_per_task)
    return _finish(j, {
        "p_present": F.coalesce(F.col("p_present"), F.lit(False)),
        "place_mean": _present("p_present", F.col("_pm"), GM()),
        "place_std": _present("p_present", F.col("_ps"), GS()),
        "place_count": _present("p_present", F.col("_pc"), F.lit(0.0)),
    }, ["_pm", "_ps", "_pc", "p_rows"])


def join_category_city(rows: DataFrame, categories: DataFrame, cities: DataFrame,
                       known_rows: tuple[int | None, int | None] = (None, None), *, salt_cols=None,
                       count_from=None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """category_mean / city_mean, default global mean.  Each table is
    broadcast up to a checked row count and joined with salted hot keys
    beyond it."""
    j = rows
    for table, key, flag, mean, prefix, kind, known in (
            (categories, "place_category", "c_present", "category_mean", "uc", "category", known_rows[0]),
            (cities, "place_city", "y_present", "city_mean", "ucy", "city", known_rows[1])):
        small = table.select(key, f"{prefix}_all", F.col(f"{prefix}_present").alias(flag),
                             F.col(mean).alias(f"_{mean}"))
        hinted = bounded_broadcast(small, known_rows=known)
        if hinted is not None:
            j = j.join(hinted, key, "left")
        else:
            j = salted_join(j, small, [key],
                            rows_col="__rows" if count_from is not None else f"{prefix}_all",
                            counts=_counts(count_from, kind), salt_cols=salt_cols,
                            rows_per_task=rows_per_task)
        j = j.drop(f"{prefix}_all")
    return _finish(j, {
        "c_present": F.coalesce(F.col("c_present"), F.lit(False)),
        "y_present": F.coalesce(F.col("y_present"), F.lit(False)),
        "category_mean": _present("c_present", F.col("_category_mean"), GM()),
        "city_mean": _present("y_present", F.col("_city_mean"), GM()),
    }, ["_category_mean", "_city_mean"])


COLD_KINDS = [("user", "u_present"), ("place", "p_present"), ("category", "c_present"),
              ("city", "y_present"), ("user_category", "uc_present"),
              ("user_city", "ucy_present")]


def cold_start_rows(joined: DataFrame) -> DataFrame:
    """Test rows that took the fallback path, counted by kind.

    One aggregate over the joined rows (no extra join), then ``stack``
    turns the single row into one row per kind."""
    test = joined.where(~F.col("is_train"))
    aggs = [F.count_if(~F.col(flag)).alias(kind) for kind, flag in COLD_KINDS]
    aggs.append(F.count(F.lit(1)).alias("all_test"))
    wide = test.agg(*aggs)
    kinds = COLD_KINDS + [("all_test", None)]
    stack = "stack({n}, {pairs}) as (kind, n_rows)".format(
        n=len(kinds), pairs=", ".join(f"'{k}', {k}" for k, _ in kinds))
    return wide.selectExpr(stack)
