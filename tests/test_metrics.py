"""Metric operators on hand-computed micro tables."""

import datetime as dt
import math

from pyspark.sql import functions as F

from ratecraft.operators import metrics

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _log(spark, rows):
    return spark.createDataFrame(
        [(T0 + dt.timedelta(seconds=s), "POST", h, st, d) for s, h, st, d in rows],
        "ts timestamp, method string, handler string, status int, duration_s double")


def test_histogram_cumulative(spark):
    df = spark.createDataFrame([(0.15,), (0.75,), (0.95,), (1.0,)], "c double")
    h = {r["le"]: r["bucket_count"] for r in
         metrics.histogram(df.withColumn("g", F.lit(1)), "c", ["g"]).collect()}
    assert h["0.1"] == 0 and h["0.2"] == 1 and h["0.8"] == 2 and h["1.0"] == 4 and h["+Inf"] == 4
    counts = [h[k] for k in ["0.1", "0.2", "0.3", "0.4", "0.5", "0.6", "0.7", "0.8", "0.9",
                             "1.0", "+Inf"]]
    assert counts == sorted(counts)


def test_bucket_quantile_interpolates(spark):
    bounds = [1.0, 2.0, 4.0]
    df = spark.createDataFrame([([2, 6, 10, 10],), ([0, 0, 0, 5],), ([0, 0, 0, 0],)],
                               "cum array<bigint>")
    q = [r[0] for r in df.select(metrics.bucket_quantile(F.col("cum"), bounds, 0.5)).collect()]
    assert math.isclose(q[0], 1.0 + (2.0 - 1.0) * (5 - 2) / (6 - 2))
    assert q[1] == 4.0            # rank in +Inf bucket -> highest finite bound
    assert q[2] is None


def test_counter_rate_handles_reset(spark):
    s = spark.createDataFrame(
        [("h", T0 + dt.timedelta(seconds=10 * i), v) for i, v in enumerate([5.0, 8.0, 2.0, 4.0])],
        "handler string, ts timestamp, value double")
    inc = [r["increase"] for r in metrics.counter_increases(s, ["handler"]).orderBy("ts").collect()]
    assert inc == [None, 3.0, 2.0, 2.0]


def test_in_progress_ticks(spark):
    log = _log(spark, [(1, "h", 200, 25.0), (5, "h", 200, 3.0), (12, "h", 200, 1.0)])
    got = {r["tick"]: r["in_progress"] for r in metrics.in_progress(log).collect()}
    # request 1 open over (1, 26): ticks 10, 20 ; request 2 (5, 8): no tick inside
    assert got[T0 + dt.timedelta(seconds=10)] == 1
    assert got[T0 + dt.timedelta(seconds=20)] == 1
    assert got[T0 + dt.timedelta(seconds=30)] == 0


def test_request_rate_windows(spark):
    log = _log(spark, [(0, "h", 200, 1.0), (30, "h", 200, 1.0), (90, "h", 500, 1.0)])
    r = metrics.request_rate(log)
    first = r.where((F.col("window_start") == T0) & (F.col("status") == 200)).first()
    assert math.isclose(first["rate"], 2 / 300)
    assert r.where(F.col("status") == 500).count() == 5     # one event, five sliding windows


def test_load_summary_and_empty(spark):
    log = _log(spark, [(0, "h", 200, 1.0), (1, "h", 500, 1.0), (9, "h", 200, 1.0)])
    s = metrics.load_summary(log).first()
    assert s["total_requests"] == 3 and s["failed_requests"] == 1
    assert s["success_rate"] == 66.66 and s["duration_s"] == 9 and s["requests_per_second"] == 0
    empty = metrics.load_summary(log.where("false")).first()
    assert empty["success_rate"] == 0.0 and empty["total_requests"] == 0


def test_threshold_status_bands(spark):
    from ratecraft.constants import DIVERSITY_BANDS, RMSE_BANDS
    df = spark.createDataFrame([(0.1,), (0.3,), (0.69,), (0.7,), (1.2,)], "v double")
    d = [r[0] for r in df.select(metrics.threshold_status(F.col("v"), DIVERSITY_BANDS)).collect()]
    assert d == ["red", "yellow", "yellow", "green", "green"]
    r = [x[0] for x in df.select(metrics.threshold_status(F.col("v"), RMSE_BANDS)).collect()]
    assert r == ["green", "green", "yellow", "yellow", "red"]


def test_relabel_rules(spark):
    from ratecraft.constants import POD_RELABEL_RULES
    lab = {"__address__": "10.0.0.1:8000", "__meta_kubernetes_namespace": "ns",
           "__meta_kubernetes_pod_name": "pod-1", "__meta_kubernetes_pod_label_app": "fastapi-app",
           "__meta_kubernetes_pod_annotation_prometheus_io_scrape": "true",
           "__meta_kubernetes_pod_annotation_prometheus_io_port": "9100"}
    drop = dict(lab, __meta_kubernetes_pod_label_app="other")
    df = spark.createDataFrame([(1, lab), (2, drop)], "id int, labels map<string,string>")
    out = metrics.relabel(df, POD_RELABEL_RULES).collect()
    assert len(out) == 1
    assert out[0]["labels"] == {"app": "fastapi-app", "kubernetes_namespace": "ns",
                                "kubernetes_pod_name": "pod-1"}
