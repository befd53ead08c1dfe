"""O42 / O43 at run time: a persisted model registry, and loading with a fall-back.

The registry is a table to which rows are only appended: one row registers a
version (``path`` set), one moves an alias (``alias`` set).  Each append is one
file that Spark's commit makes visible at once, so an alias changes in a single
step and a reader meets either the old or the new one.  The row with the highest
``seq`` decides.

``load_serving`` tries the alias' version, then the highest version, then answers
with the baseline: a missing registry, an unknown alias and a version whose files
are gone or broken all leave a predictor to serve with.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import has_file
from .train import load_model

log = logging.getLogger(__name__)

SCHEMA = "seq long, name string, version int, alias string, run_id string, path string"
ALIAS = "production"
# How the baseline names itself.
BASELINE = ("baseline-fallback-model", "1.0", "Production", "fallback")


class Serving(NamedTuple):
    """What serves, and how it names itself."""

    predictor: Callable[[DataFrame], DataFrame]
    name: str
    version: str
    stage: str
    run_id: str


def _read(spark: SparkSession, registry: str) -> DataFrame:
    if not has_file(spark, registry):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(registry)


def _append(spark: SparkSession, registry: str, **row) -> None:
    last = _read(spark, registry).agg(F.max("seq")).first()[0]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    values = {**row, "seq": 0 if last is None else last + 1}
    spark.createDataFrame([tuple(values.get(c) for c in names)], SCHEMA).coalesce(1).write.mode("append").parquet(registry)


def register_model(spark: SparkSession, registry: str, name: str, version: int, path: str, run_id: str | None = None) -> None:
    """Add a saved model as a version of ``name``."""
    _append(spark, registry, name=name, version=version, path=path, run_id=run_id)


def set_alias(spark: SparkSession, registry: str, name: str, version: int, alias: str = ALIAS) -> None:
    """Let ``alias`` stand for ``version`` from now on."""
    _append(spark, registry, name=name, version=version, alias=alias)


def candidates(spark: SparkSession, registry: str, name: str, alias: str = ALIAS) -> list[tuple]:
    """``(stage, version, run_id, path)`` of the alias' version, then of the
    highest one.  Two rows at most reach the driver."""
    rows = _read(spark, registry).where(F.col("name") == name)
    models = rows.where(F.col("path").isNotNull()).groupBy("version").agg(F.max_by(F.struct("run_id", "path"), "seq").alias("m"))
    aliased = rows.where((F.col("alias") == alias) & F.col("path").isNull()).agg(F.max_by("version", "seq").alias("version"))
    by_alias = aliased.join(models, "version").select(F.lit(0).alias("k"), F.lit(alias).alias("stage"), "version", "m.*")
    latest = models.agg(F.max_by(F.struct("version", "m.run_id", "m.path"), "version").alias("l")).where("l is not null").select(
        F.lit(1).alias("k"), F.lit("latest").alias("stage"), "l.*")
    return [tuple(r)[1:] for r in by_alias.unionByName(latest).orderBy("k").collect()]


def load_serving(spark: SparkSession, registry: str, name: str, as_predictor: Callable, baseline: Callable,
                 alias: str = ALIAS) -> Serving:
    """The predictor that serves now.  ``as_predictor`` wraps a loaded model;
    ``baseline`` is the predictor without one."""
    for stage, version, run_id, path in candidates(spark, registry, name, alias):
        try:
            return Serving(as_predictor(load_model(path)), name, str(version), stage, run_id or "unknown")
        except Exception as error:  # whatever is wrong with its files, the next one must answer
            log.warning("model %s version %s (%s) cannot be loaded: %s", name, version, stage, error)
    return Serving(baseline, *BASELINE)
