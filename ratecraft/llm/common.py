"""Helpers that several operators share: tables in the shared folder, running
totals over a global order, and new columns made batch by batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..plans.materialize import materialize
from ..session import open_store, scratch_path, ship

# A word is a run of characters other than these six (space, \t \n \v \f \r);
# bytes.split() without arguments cuts UTF-8 at exactly them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read back: the
    lineage is cut, and a lost executor costs a re-read of files."""
    ship(df.sparkSession)
    return materialize(df, name=name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sheltered(docs: DataFrame, *used: str):
    """``docs`` with all columns but the ``used`` ones renamed out of the way
    of an operator's own names, and a function that takes any result with
    these columns back to exactly the columns of ``docs``."""
    names = [c if c in used else f"_column_{k}" for k, c in enumerate(docs.columns)]
    back = list(zip(names, docs.columns, strict=True))
    return docs.toDF(*names), lambda df: df.select(*[F.col(n).alias(c) for n, c in back])


def beside(docs: DataFrame, keep: list[str], inputs: list[str], fields: str, compute) -> DataFrame:
    """The columns in ``keep``, untouched, beside new ones: ``compute`` gets the
    ``inputs`` of a batch as lists (null: None) and gives the ``fields``."""
    ship(docs.sparkSession)
    new = StructType.fromDDL(fields)
    schema = StructType([*docs.select(*keep).schema.fields, *new.fields])
    types = [to_arrow_type(f.dataType) for f in new.fields]
    names = [*keep, *new.names]

    def rows(batches):
        for b in batches:
            made = compute(*[b.column(c).to_pylist() for c in inputs])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], *[pa.array(x, t) for x, t in zip(made, types, strict=True)]], names=names)

    return docs.select(*keep, *[c for c in inputs if c not in keep]).mapInArrow(rows, schema)


def running_totals(df: DataFrame, order_by: list[str], values: list[str], name: str) -> DataFrame:
    """Add ``before_<v>``: the sum of ``v`` over all rows that precede this one
    in the order of ``order_by`` (nulls first), over the whole table.

    Rows are range-partitioned, so no task sees more than a slice; the slices'
    sums are one row per partition, and only those meet in a single window.
    ``order_by`` should end in a tie-breaking column: rows that agree in all
    of its columns stay in one slice and get their totals in any order.
    """
    cut = table(df.repartitionByRange(*order_by).withColumn("_slice", F.spark_partition_id()), name)
    every = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_slice").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    starts = sums.select("_slice", *[F.coalesce(F.sum(f"_sum_{v}").over(every), F.lit(0)).alias(f"_from_{v}")
                                     for v in values])
    own = Window.partitionBy("_slice").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(starts, "_slice").select(
        *df.columns,
        *[(F.col(f"_from_{v}") + F.coalesce(F.sum(v).over(own), F.lit(0))).alias(f"before_{v}") for v in values])


def new_folder(spark: SparkSession, name: str) -> str:
    """An empty folder of the shared store for files that tasks write."""
    uri = scratch_path(spark, name)
    fs, path = open_store(uri)
    fs.create_dir(path, recursive=True)
    return uri

