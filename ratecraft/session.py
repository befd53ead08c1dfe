"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

# Settings every job relies on: UTC timestamps, AQE (runtime coalescing and
# skew splitting), no web UI.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "ratecraft", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults.  What is not asked
    for - master, shuffle partitions, memory - stays as the cluster has it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` (or an already set checkpoint dir) from the
    session.  When neither is set, a fresh temporary folder is taken on a
    local master; on a cluster, whose machines would not see it, that is an
    error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {sc.master} share")
        configured = tempfile.mkdtemp(prefix="ratecraft-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/ratecraft/{name}-{uuid.uuid4().hex[:12]}"
    for scope in _SCOPES:
        scope.append(path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def recorded_scratch(made: list[str]):
    """Add the paths of the scratch tables made inside the block to ``made``."""
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES[:] = [s for s in _SCOPES if s is not made]


@contextmanager
def scratch_scope():
    """Delete the scratch tables made inside the block when it ends."""
    made: list[str] = []
    try:
        with recorded_scratch(made):
            yield
    finally:
        for path in made:
            remove(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application,
    unless their PYTHONPATH has it already."""
    root, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    name = Path(__file__).resolve().parent.name
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{name}", "zip", root, name))
    _SHIPPED.add(app)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path behind a folder of the shared store, for files that
    tasks write themselves (``file:``, ``hdfs:``, ``s3:``, ``s3a:``, ``gs:``,
    ``abfss:`` or a plain path)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("dbfs:"):  # mounted on every machine of such a cluster
        return pafs.LocalFileSystem(), "/dbfs/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"{STORE_NAMES.get(scheme, scheme)}://{rest}")


# Spark's names of stores that the Arrow file systems know by another one.
STORE_NAMES = {"s3a": "s3", "s3n": "s3"}


def _hadoop(uri: str, spark: SparkSession | None = None):
    """Spark's own file system and path of a folder: any store that Spark reads."""
    spark = spark or SparkSession.active()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def folder_names(spark: SparkSession, uri: str) -> list[str]:
    """Names of the folders directly in a folder (none, if it is not there)."""
    fs, path = _hadoop(uri, spark)
    return [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []


def has_file(spark: SparkSession, uri: str) -> bool:
    fs, path = _hadoop(uri, spark)
    return fs.exists(path)


def remove(uri: str) -> None:
    """Delete a scratch folder, if it is there."""
    fs, path = _hadoop(uri)
    if fs.exists(path):
        fs.delete(path, True)
