"""Batch scoring of recommendation requests (the /predict and /recommend path).

``parse -> validate -> explode -> features -> predict -> score -> rank``.
Features come either from the fixed serving defaults (O32, what the
original API does) or from the training statistics (O33, what it states as
its intent) through the same joins the training matrix uses, so serving and
training share one feature definition.

The prediction is a column produced by a callable ``predictor(df) -> df``:
a fitted Spark ML model (``model_predictor``) or the closed-form
``bias_predictor`` that the SQL oracles can reproduce.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, score, validate
from ..operators.split import with_split
from ..sources.requests import parse_requests
from ..streaming.store import Versions
from .feature_matrix import StatTables, attach_stats, stat_tables
from .materialize import materialize

Predictor = Callable[[DataFrame], DataFrame]
REQUEST_KEY = ["request_id", "pos"]


def request_rows(requests: DataFrame, text_col: str = "body",
                 checkpoint: bool = False) -> DataFrame:
    """Valid requests only, defaults filled, one row per (request, place).

    ``checkpoint`` writes the parsed rows once (they feed several joins)."""
    parsed = parse_requests(requests, text_col)
    ok = validate.fill_defaults(validate.valid_requests(parsed))
    return materialize(validate.explode_places(ok.drop("malformed", "n_places")), checkpoint)


def default_features(rows: DataFrame, stats_col: str | None = None) -> DataFrame:
    """O32 request-side features with the fixed defaults."""
    return features.serving_features(rows, stats_col)


def serving_tables(ratings: DataFrame, *, key_cols: list[str],
                   bucket_col: str = "split_bucket") -> StatTables:
    """Training statistics keyed the way requests name things (string ids)."""
    t = stat_tables(with_split(ratings, bucket_col=bucket_col, key_cols=key_cols))
    return t._replace(places=t.places.withColumn("place_id", F.col("place_id").cast("string")))


def enriched_features(rows: DataFrame, tables: StatTables) -> DataFrame:
    """O33 request features from the training statistics (absent keys take
    the training defaults).  Hot keys are found by counting request rows."""
    return attach_stats(rows, tables, salt_cols=REQUEST_KEY, count_big=True)


def baseline_predictor(df: DataFrame) -> DataFrame:
    """O43 without a model: the training global mean, which the features hold."""
    return df.withColumn("prediction", F.col("global_mean"))


# ---- statistics that change while a stream runs -----------------------------
def publish_tables(spark: SparkSession, path: str, tables: StatTables, version: int | None = None) -> int:
    """Write a snapshot of the statistics as the next version below ``path``.
    The index is written last and counts only when it is complete, so a reader
    gets all tables of one version or all of the one before."""
    index = Versions(spark, f"{path}/index")
    if version is None:
        version = max(index.complete(), default=-1) + 1
    base = f"{path}/tables/version={version:012d}"
    for name in StatTables._fields[:-1]:
        getattr(tables, name).write.mode("overwrite").parquet(f"{base}/{name}")
    facts = [(gid, n, most) for gid, (n, most) in (tables.facts or {}).items()]
    index.publish(spark.createDataFrame(facts, "gid int, n_keys long, max_rows long"), version)
    return version


def newest_tables(spark: SparkSession, path: str) -> StatTables:
    """The newest complete snapshot."""
    versions = Versions(spark, f"{path}/index").complete()
    if not versions:
        raise ValueError(f"no statistics are published below {path}")
    base = f"{path}/tables/version={versions[-1]:012d}"
    facts = {r["gid"]: (r["n_keys"], r["max_rows"]) for r in
             spark.read.parquet(Versions(spark, f"{path}/index").folder(versions[-1])).collect()}   # a row per grouping set
    return StatTables(*[spark.read.parquet(f"{base}/{name}") for name in StatTables._fields[:-1]], facts or None)


def bias_predictor(df: DataFrame) -> DataFrame:
    """Closed-form predictor: the place's rating shifted by how far the
    user's mean rating lies from the global mean.  Oracle-checkable
    stand-in for a fitted model; it can leave [1, 5], so clipping runs."""
    return df.withColumn("prediction", F.col("place_rating") + F.col("user_mean")
                         - F.col("global_mean"))


def model_predictor(model) -> Predictor:
    """Wrap a fitted ``PipelineModel`` (assembler + scaler + trees): the
    22 feature columns are laid out under their model names, then the
    model adds ``prediction``."""
    from ..constants import FEATURE_NAMES

    def run(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in FEATURE_NAMES and c != "prediction"]
        x = df.select(*rest, *features.feature_columns())
        return model.transform(x).select(*x.columns, "prediction")
    return run


def scored(rows_with_features: DataFrame, predictor: Predictor) -> DataFrame:
    """O44-O47 on predicted rows: clip, confidence, rounding, rank."""
    return score.rank_places(score.score_columns(predictor(rows_with_features)))
