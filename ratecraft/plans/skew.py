"""Joins that stay balanced when one key holds a large share of the rows.

``salted_join`` joins a large table to a per-key table (one row per key)
whose ``rows_col`` holds how many rows of the large table carry that key -
which is exactly what the engine's statistics tables record.  Keys whose
row count exceeds a threshold are *hot*: their rows are spread over
``ceil(rows / threshold)`` salt values (a deterministic hash of the row, so
a re-run task computes the same salt), and the per-key row is replicated once
per salt value.  Every large-side row still meets exactly one copy, so the
result is the plain join's result.

Rows with a null key match nothing, so their salt is free: it is a hash of
the row over ``NULL_SALTS`` values, which deals them over all tasks.

The hot-key list ``(key, n_salt)`` has at most (rows / threshold) entries.
It is written once, counted, and broadcast only up to ``MAX_BROADCAST_ROWS``;
a longer list is joined by shuffle.  When no key is hot - known from row
counts the caller already measured (``has_hot``), or found out by one
``limit(1)`` job - only the null keys are salted.

``bounded_broadcast`` gives a broadcast hint to a table of a checked row
count, and ``None`` beyond the bound: the caller then takes ``salted_join``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import materialize

# Rows one task should handle per key before a key counts as hot.
ROWS_PER_TASK = 1_000_000
# Row bound for broadcasting hot-key lists and small statistics tables.
MAX_BROADCAST_ROWS = 200_000
# Values over which rows with a null key are dealt.
NULL_SALTS = 1 << 20

_SALT = "__salt"
_NSALT = "__nsalt"


def hot_keys(small: DataFrame, on: list[str], rows_col: str, *,
             rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(key..., __nsalt)`` for every key with more than ``rows_per_task``
    rows; there are at most (all rows / ``rows_per_task``) of them."""
    return (small.where(F.col(rows_col) > F.lit(rows_per_task))
            .select(*on, F.ceil(F.col(rows_col) / F.lit(rows_per_task)).cast("int").alias(_NSALT)))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], *, rows_col: str | None,
                salt_cols: list[str] | None = None, how: str = "left",
                counts: DataFrame | None = None, has_hot: bool | None = None,
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Equi-join ``big`` with ``small`` (unique on ``on``), splitting hot keys.

    ``rows_col`` names the column counting ``big`` rows per key - in
    ``counts`` (keys + ``rows_col``) when given, else in ``small``.  With
    ``rows_col=None`` the counts come from a partial aggregate of ``big``.
    ``salt_cols`` are deterministic columns of ``big`` that vary within a
    key (a row key); default all columns of ``big``.  ``has_hot`` passes a
    known answer to "is any key hot?" (from row counts already at hand);
    ``None`` asks Spark with one bounded job.
    """
    if how not in ("left", "inner"):
        raise ValueError("salted_join supports left and inner joins")
    if how == "inner":
        for c in on:
            big = big.where(F.col(c).isNotNull())
    if rows_col is None:
        counted = big.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))
        hot = hot_keys(counted, on, "__rows", rows_per_task=rows_per_task)
    else:
        hot = hot_keys(counts if counts is not None else small, on, rows_col,
                       rows_per_task=rows_per_task)
    for c in on:
        hot = hot.where(F.col(c).isNotNull())
    row_hash = F.xxhash64(*(salt_cols or big.columns))
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    null_salt = F.pmod(row_hash, F.lit(NULL_SALTS)).cast("int")
    if has_hot is False or (has_hot is None and not hot.limit(1).collect()):
        # always 0, but computed from the key on both sides: a constant would
        # be folded into the condition, and the rows shuffled by the key alone
        key_salt = F.pmod(F.xxhash64(*on), F.lit(1)).cast("int")
        big_s = big.withColumn(_SALT, F.when(no_key, null_salt).otherwise(key_salt))
        return big_s.join(small.withColumn(_SALT, key_salt), on + [_SALT], how).drop(_SALT)
    hot = materialize(hot, name="hot-keys")
    if hot.count() <= MAX_BROADCAST_ROWS:
        hot = F.broadcast(hot)
    salt = (F.when(no_key, null_salt).when(F.col(_NSALT).isNull(), F.lit(0))
            .otherwise(F.pmod(row_hash, F.col(_NSALT)).cast("int")))
    big_s = big.join(hot, on, "left").select(*big.columns, salt.alias(_SALT))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_NSALT), F.lit(1)) - 1))
    small_s = small.join(hot, on, "left").select(*small.columns, copies.alias(_SALT))
    return big_s.join(small_s, on + [_SALT], how).drop(_SALT)


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                      known_rows: int | None = None) -> DataFrame | None:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else
    ``None``.  ``known_rows`` is a row count already measured (an upper
    bound); without it the check runs one bounded job."""
    n = df.limit(max_rows + 1).count() if known_rows is None else known_rows
    return F.broadcast(df) if n <= max_rows else None
