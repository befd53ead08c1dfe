"""O2 parse_requests: JSON request texts -> nested request struct.

Works on batch and streaming DataFrames alike (``from_json`` is a plain
column expression).  A text that is not valid JSON, or whose values do not
fit the declared types, is kept with ``malformed = true`` instead of
failing the job; the whole text is kept only in that case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import REQUEST

CORRUPT = "_corrupt_record"


def parse_requests(df: DataFrame, text_col: str = "body") -> DataFrame:
    """Replace ``text_col`` by ``user``, ``places`` and ``malformed``."""
    schema = T.StructType(REQUEST.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(text_col), schema,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    keep = [c for c in df.columns if c != text_col]
    # out of an array of one, so that filters on the parsed fields are not pushed
    # below it: each of their mentions of a field would parse the text again
    return (df.select(*keep, F.explode(F.array(parsed)).alias("_r"))
            .select(*keep,
                    F.col("_r.user").alias("user"),
                    F.col("_r.places").alias("places"),
                    (F.col(f"_r.{CORRUPT}").isNotNull() | F.col("_r").isNull())
                    .alias("malformed")))


def parse_summary(parsed: DataFrame) -> DataFrame:
    """Counts: requests, malformed texts, places in well-formed requests."""
    ok = ~F.col("malformed")
    return parsed.agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if(F.col("malformed")).alias("n_malformed"),
        F.sum(F.when(ok, F.coalesce(F.size("places"), F.lit(0))).otherwise(0))
        .cast("long").alias("n_places"))
