"""O1 scan_ratings: read a rating table and keep the declared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RATING_KEYS, RATING_MEASURES


def conform_ratings(df: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Select the rating columns with their declared types.

    ``keep`` lists extra columns (row keys, split bucket) carried along
    untouched.  Key columns keep their source type (long or string).
    """
    missing = [c for c in RATING_KEYS + list(RATING_MEASURES) if c not in df.columns]
    if missing:
        raise ValueError(f"rating table lacks columns: {missing}")
    cols = [F.col(c) for c in keep]
    cols += [F.col(k) for k in RATING_KEYS]
    cols += [F.col(c).cast(t).alias(c) for c, t in RATING_MEASURES.items()]
    return df.select(*cols)


JDBC_SPLIT = ["partitionColumn", "lowerBound", "upperBound", "numPartitions"]


def read_ratings(spark: SparkSession, source: str | None, *, fmt: str = "parquet",
                 options: dict | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Load the rating table from ``source``; fail if it is not configured.

    ``fmt="jdbc"`` reads a database table through Spark's JDBC source; its
    ``options`` must hold ``partitionColumn``/``lowerBound``/``upperBound``/
    ``numPartitions``, which split the read over executors.
    Column pruning and filters are pushed to the source by Catalyst.
    """
    if not source:
        raise ValueError("missing rating source configuration")
    options = options or {}
    if fmt == "jdbc":
        missing = [k for k in JDBC_SPLIT if k not in options]
        if missing:
            raise ValueError(f"a JDBC read needs {missing}: without them one task reads the table")
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        df = reader.option("dbtable", source).load()
    else:
        df = reader.load(source)
    return conform_ratings(df, keep)
