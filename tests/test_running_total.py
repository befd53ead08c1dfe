"""The running total of a counter over times of many days."""

import re

from pyspark.sql import functions as F

from ratecraft.operators import metrics
from ratecraft.plans import queries


def test_running_total_crosses_days(spark):
    rows = spark.range(500).select(F.lit("m").alias("name"), F.timestamp_seconds(F.col("id") * 1000 + 86_000).alias("ts"), (F.col("id") % 7).alias("n"))
    got = [r["value"] for r in metrics.running_total(rows, ["name"]).orderBy("ts").collect()]
    assert got == [float(sum(k % 7 for k in range(i + 1))) for i in range(500)]


def test_no_window_of_recommendation_rate_holds_all_times(spark, monkeypatch):
    scored = spark.range(3000).select(F.timestamp_seconds("id").alias("ts"))
    monkeypatch.setattr(queries, "_scored", lambda *_: scored)
    plan = queries.q_recommendation_rate(spark, "")._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan)
    assert specs and all("__day" in s for s in specs), specs
