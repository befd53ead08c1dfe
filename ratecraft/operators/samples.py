"""O66 as storage: metric samples by day, expiry by deleting whole days.

Samples lie in one folder per UTC day.  Expiry deletes the folders of days that
ended before the horizon, which touches no other file; what is left of the day
that the horizon falls into is filtered by time when read.  Reads filter on the
day column too, so that Spark lists and scans the days of the range only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import folder_names, remove

DAY = "day"


def append_samples(samples: DataFrame, path: str, ts: str = "ts") -> None:
    """Add samples; every task writes the days it meets, so rows are dealt by
    day and a hash first and a day becomes a few files, not one per task."""
    by_day = samples.withColumn(DAY, F.to_date(ts))
    salt = F.pmod(F.xxhash64(*samples.columns), F.lit(FILES_PER_DAY))
    by_day.repartition(DAY, salt).write.mode("append").partitionBy(DAY).parquet(path)


# Tasks that share the rows of one day.
FILES_PER_DAY = 4


def stored_days(spark: SparkSession, path: str) -> list[str]:
    """Days that have a folder, ascending (ISO dates)."""
    return sorted(n.partition("=")[2] for n in folder_names(spark, path) if n.startswith(f"{DAY}="))


def horizon(spark: SparkSession, path: str, keep: str, ts: str = "ts"):
    """``keep`` before the newest sample, found in the newest day's files only."""
    days = [d for d in stored_days(spark, path) if d[:1].isdigit()]
    if not days:
        return None
    newest = spark.read.parquet(path).where(F.col(DAY) == F.lit(days[-1]).cast("date")).agg(F.max(ts).alias("newest"))
    return newest.select(F.col("newest") - F.expr(f"INTERVAL {keep}")).first()[0]


def drop_expired(spark: SparkSession, path: str, keep: str, ts: str = "ts") -> list[str]:
    """Delete the days that ended before the horizon; returns them."""
    start = horizon(spark, path, keep, ts)
    gone = [] if start is None else [d for d in stored_days(spark, path) if d < start.date().isoformat()]
    for day in gone:
        remove(f"{path.rstrip('/')}/{DAY}={day}")
    return gone


def read_range(spark: SparkSession, path: str, start, end=None, ts: str = "ts") -> DataFrame:
    """Samples from ``start`` on (to ``end``, itself excluded), scanning their
    days only."""
    found = spark.read.parquet(path).where((F.col(DAY) >= F.lit(start.date())) & (F.col(ts) >= F.lit(start)))
    if end is not None:
        found = found.where((F.col(DAY) <= F.lit(end.date())) & (F.col(ts) < F.lit(end)))
    return found.drop(DAY)


def read_retained(spark: SparkSession, path: str, keep: str, ts: str = "ts") -> DataFrame:
    """Samples no older than ``keep`` before the newest one."""
    start = horizon(spark, path, keep, ts)
    if start is None:
        raise ValueError(f"no samples are stored below {path}")
    return read_range(spark, path, start, ts=ts)
