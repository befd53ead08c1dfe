"""Streams: bounded micro-batches, the end mark, cleanup and model reload."""

import os

from pyspark.sql import functions as F

from ratecraft import session
from ratecraft.operators import metrics
from ratecraft.plans.materialize import materialize
from ratecraft.session import scratch_path
from ratecraft.streaming import jobs
from ratecraft.streaming.store import Parts, Versions


def test_end_mark_closes_every_window(spark):
    log = spark.createDataFrame([("2024-01-01 10:00:30",), ("2024-01-01 10:07:00",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("ts"), F.lit("GET").alias("method"), F.lit(200).alias("status"))
    land = jobs.landing_folder(log, "t-log")
    jobs.end_log(spark, land)
    out = scratch_path(spark, "t-out")
    jobs.run_available(jobs.stream_request_rates(jobs.file_stream(spark, land)), out, scratch_path(spark, "t-ck"))
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 10 and {r["method"] for r in rows} == {"GET"}


def test_backlog_is_worked_off_in_batches_that_leave_nothing_behind(spark):
    land = scratch_path(spark, "t-requests")
    spark.range(40).repartition(8).write.parquet(land)
    made = []

    def score_batch(batch):
        made.append(materialize(batch, name="t-part").inputFiles()[0])
        return batch

    out = scratch_path(spark, "t-scored")
    jobs.stream_score(jobs.file_stream(spark, land, max_files=2), score_batch, out, scratch_path(spark, "t-ck"))
    assert len(made) >= 4
    got = spark.read.parquet(out)
    assert got.count() == 40 and got.select("batch_id").distinct().count() == len(made)
    assert not any(os.path.exists(path.removeprefix("file://").removeprefix("file:")) for path in made)


def _log(spark, n=3000):
    """A day of requests."""
    return spark.range(n).select(
        F.timestamp_seconds(1_700_000_000 + (F.col("id") * 7919 % n) * 29).alias("ts"),
        F.when(F.col("id") % 3 == 0, "GET").otherwise("POST").alias("method"), (200 + F.col("id") % 2).cast("int").alias("status"))


def _as_set(df):
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_unordered_files_lose_no_row_and_late_ones_are_counted(spark):
    log = _log(spark)
    land = jobs.landing_folder(log, "t-log", 5)
    out, ck = scratch_path(spark, "t-steps"), scratch_path(spark, "t-ck")
    parts = jobs.stream_steps(jobs.file_stream(spark, land, max_files=1), out, ck)
    assert len(parts.parts.complete()) == 5
    got = metrics.step_rates(parts.read(), ["method", "status"])
    assert _as_set(got) == _as_set(metrics.request_rate(log))
    # files hold rows of the whole day, so nearly all rows of later batches are late
    late = jobs.late_rows(parts).agg(F.sum("n_late")).first()[0]
    assert 0.7 * 3000 < late < 0.8 * 3000
    ordered = scratch_path(spark, "t-ordered")
    log.coalesce(1).sortWithinPartitions("ts").write.parquet(ordered)
    in_order = jobs.stream_steps(jobs.file_stream(spark, ordered), scratch_path(spark, "t-steps"), scratch_path(spark, "t-ck"))
    assert jobs.late_rows(in_order).count() == 0


def test_parts_are_compacted_and_replays_change_nothing(spark):
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    parts = Parts(spark, scratch_path(spark, "t-parts"), merge, compact_every=3)
    assert parts.read() is None
    rows = lambda n: spark.range(4).select((F.col("id") % 2).alias("k"), F.lit(n).alias("n"))
    for n in range(8):
        parts.add(rows(n), n)
        parts.add(rows(n), n)                    # replayed
        if n > 3:
            parts.add(rows(100), 1)              # replayed after its base was made
        assert {r["k"]: r["n"] for r in parts.read().collect()} == {0: n * (n + 1), 1: n * (n + 1)}
    assert parts.bases.complete()[-1] == 5 and min(parts.parts.complete()) >= 3


def test_a_version_counts_when_it_is_complete(spark):
    versions = Versions(spark, scratch_path(spark, "t-versions"))
    assert versions.newest() is None
    for n in range(4):
        assert versions.publish(spark.range(n)) == n
    assert versions.complete() == [2, 3] and versions.newest().count() == 3
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(versions.folder(4))
    os.path.exists(f"{versions.folder(4)}/_SUCCESS") and os.remove(f"{versions.folder(4)}/_SUCCESS")
    assert versions.complete() == [2, 3]         # a writer that died before its commit


def test_running_totals_switch_versions(spark):
    land = scratch_path(spark, "t-scored")
    spark.range(40).select((F.col("id") % 2).alias("k")).repartition(4).write.parquet(land)
    out = scratch_path(spark, "t-totals")
    stream = jobs.file_stream(spark, land, max_files=1).groupBy("k").count()
    jobs.stream_totals(stream, out, scratch_path(spark, "t-ck"))
    assert {r["k"]: r["count"] for r in Versions(spark, out).newest().collect()} == {0: 20, 1: 20}


def test_gauges_take_the_newest_value_whatever_the_order(spark):
    samples = spark.range(600).select(
        (F.col("id") % 4).alias("handler"), F.timestamp_seconds(F.floor(F.col("id") * 7919 % 600 / 8)).alias("ts"), F.col("id").alias("seq"),
        F.when(F.col("id") % 5 > 0, F.col("id") / 7).alias("value"))
    land = jobs.landing_folder(samples, "t-gauges", 4)
    got = jobs.stream_gauges(jobs.file_stream(spark, land, max_files=1), scratch_path(spark, "t-out"), scratch_path(spark, "t-ck"),
                             ["handler"], order=["ts", "seq"])
    assert _as_set(got) == _as_set(metrics.gauge_last(samples, ["handler"], order=["ts", "seq"]))


def test_each_batch_takes_the_statistics_in_force(spark):
    from ratecraft.plans import serving
    from ratecraft.plans.feature_matrix import StatTables
    path, land = scratch_path(spark, "t-statistics"), scratch_path(spark, "t-requests")
    names = StatTables._fields[:-1]
    tables = lambda v: StatTables(*[spark.range(v, v + 1) for _ in names], {7: (v, v)})
    serving.publish_tables(spark, path, tables(1))
    spark.range(6).repartition(3).write.parquet(land)
    taken = []

    def score_batch(batch):
        now = serving.newest_tables(spark, path)
        taken.append(now.glob.first()["id"])
        assert now.facts == {7: (taken[-1], taken[-1])}
        serving.publish_tables(spark, path, tables(taken[-1] + 1))     # new statistics while the stream runs
        return batch.withColumn("v", F.lit(taken[-1]))

    out = scratch_path(spark, "t-scored")
    jobs.stream_score(jobs.file_stream(spark, land, max_files=1), score_batch, out, scratch_path(spark, "t-ck"))
    assert taken == [1, 2, 3]
    assert {r["v"] for r in spark.read.parquet(out).collect()} == {1, 2, 3}


def test_responses_of_a_replayed_batch_replace_themselves(spark):
    land, out, ck = (scratch_path(spark, n) for n in ("t-requests", "t-responses", "t-ck"))
    spark.range(20).repartition(4).write.parquet(land)
    respond = lambda df: df.select("id", F.to_json(F.struct("id", F.array("id").alias("places"))).alias("response"))
    read = lambda: spark.read.schema("id long, response string").json(out)
    jobs.stream_responses(jobs.file_stream(spark, land, max_files=1), respond, out, ck)
    first = _as_set(read())
    jobs.stream_responses(jobs.file_stream(spark, land, max_files=1), respond, out, ck)     # nothing new
    assert _as_set(read()) == first and len(first) == 20
    last = max(int(f) for f in os.listdir(f"{ck.removeprefix('file:')}/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):     # the driver died before the last batch was committed
        os.path.exists(f"{ck.removeprefix('file:')}/commits/{name}") and os.remove(f"{ck.removeprefix('file:')}/commits/{name}")
    jobs.stream_responses(jobs.file_stream(spark, land, max_files=1), respond, out, ck)
    assert _as_set(read()) == first


def test_a_cluster_without_a_shared_folder_is_an_error():
    import pytest

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
