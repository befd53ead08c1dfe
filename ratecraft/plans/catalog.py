"""Shared inputs for the registered queries.

The rating rows and request texts shaped from the test tables are the
engine's input tables.  They are written once per (application, folder) as
Parquet into the shared checkpoint location and every query scans them
like a production table (column pruning, filter pushdown), instead of
re-running the adaptor joins for each reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import recorded_scratch, remove, scratch_path
from ..sources import fixtures
from .materialize import COMPRESSION

_TABLES: dict[tuple[str, str, str], tuple[DataFrame, str]] = {}
_MODELS: dict[tuple[str, str, str], str] = {}
_FITTED: set[tuple[str, str, str]] = set()


def _key(spark: SparkSession, sf_dir: str, name: str):
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)


_INPUTS: dict[tuple[str, str, str], DataFrame] = {}
_INPUT_PATHS: dict[tuple[str, str, str], str] = {}


def derived(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table, written once per session (deleted by ``clear``)."""
    k = _key(spark, sf_dir, name)
    if k not in _TABLES:
        path = scratch_path(spark, name)
        build(spark, sf_dir).write.options(**COMPRESSION).parquet(path)
        _TABLES[k] = spark.read.parquet(path), path
    return _TABLES[k][0]


def input_table(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """An input table written once as Parquet in the shared folder and
    scanned by every query (kept by ``clear``)."""
    k = _key(spark, sf_dir, name)
    df = _INPUTS.get(k)
    if df is None:
        path = scratch_path(spark, f"input-{name}")
        build(spark, sf_dir).write.options(**COMPRESSION).parquet(path)
        df = spark.read.parquet(path)
        _INPUTS[k], _INPUT_PATHS[k] = df, path
    return df


def input_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder of an input table written by ``input_table``."""
    return _INPUT_PATHS[_key(spark, sf_dir, name)]


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return input_table(spark, sf_dir, "ratings", fixtures.tpch_ratings)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return input_table(spark, sf_dir, "requests", fixtures.tpch_requests)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.request_log(spark, sf_dir)


def gauge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.gauge_samples(spark, sf_dir)


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.counter_samples(spark, sf_dir)


def target_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.target_labels(spark, sf_dir)


_OBJECTS: dict[tuple[str, str, str], tuple[object, list[str]]] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build):
    """Any derived object (checkpointed tables, tuples of tables) built once
    per (application, folder, name)."""
    k = _key(spark, sf_dir, name)
    if k not in _OBJECTS:
        made: list[str] = []
        with recorded_scratch(made):
            _OBJECTS[k] = build(), made
    return _OBJECTS[k][0]


def clear(inputs: bool = False) -> None:
    """Forget every derived object and delete its files (the benchmark times
    each query cold); ``inputs=True`` does so with the input tables too.  Models
    given by ``set_model_path`` are forgotten, their files are the caller's."""
    gone = [path for _, path in _TABLES.values()] + [p for _, made in _OBJECTS.values() for p in made]
    gone += [path for k, path in _MODELS.items() if k in _FITTED]
    if inputs:
        gone += _INPUT_PATHS.values()
        _INPUTS.clear()
        _INPUT_PATHS.clear()
    for path in gone:
        remove(path)
    _TABLES.clear()
    _OBJECTS.clear()
    _MODELS.clear()
    _FITTED.clear()


def model_path(spark: SparkSession, sf_dir: str, name: str, fit) -> str:
    """Folder of a fitted and saved model; fitted once per session."""
    k = _key(spark, sf_dir, name)
    if k not in _MODELS:
        _MODELS[k] = fit()
        _FITTED.add(k)
    return _MODELS[k]


def set_model_path(spark: SparkSession, sf_dir: str, name: str, path: str) -> None:
    """Let the queries use a model that is saved already."""
    _MODELS[_key(spark, sf_dir, name)] = path
