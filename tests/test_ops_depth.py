"""Exact split, preferences beyond a map, samples at every tick, samples by day,
the booster's mean start, and the catalog's files."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ratecraft import session
from ratecraft.operators import samples as store
from ratecraft.operators import split, stats
from ratecraft.operators.evaluate import regression_metrics
from ratecraft.operators.metrics import sample_at_interval
from ratecraft.operators.train import load_model, save_model, train_gbt, trees_of
from ratecraft.session import scratch_path

SF = "/root/testdata/sf0.001"


# ---- O10
@pytest.mark.parametrize("n, percent, test_rows", [(1000, 20, 200), (1003, 20, 201), (7, 20, 2), (1, 20, 1), (5, 0, 0), (5, 100, 5)])
def test_exact_share_whatever_the_partitioning(spark, n, percent, test_rows):
    sides = set()
    for parts in (1, 5, 13):
        df = split.exact_split(spark.range(n).repartition(parts), key_cols=["id"], test_percent=percent)
        rows = df.where(~F.col("is_train")).collect()
        assert len(rows) == test_rows and df.count() == n
        sides.add(frozenset(r["id"] for r in rows))
    assert len(sides) == 1
    if 1 < n and 0 < percent < 100:
        import hashlib
        order = sorted(range(n), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        assert sides.pop() == frozenset(order[:test_rows])


def test_exact_share_with_equal_keys(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.lit(None).cast("string").alias("nothing"))
    got = split.exact_split(df.repartition(4), key_cols=["k", "nothing"])
    assert got.where(~F.col("is_train")).count() == 200 and got.columns == ["k", "nothing", "is_train"]
    same = split.exact_split(df.select(F.lit(1).alias("k")), key_cols=["k"])
    assert same.where(~F.col("is_train")).count() == 200
    assert split.exact_split(df.limit(0), key_cols=["k"]).count() == 0


# ---- O24 / O31 / O33
def test_preferences_beyond_a_map_are_the_same(spark):
    from ratecraft.plans.feature_matrix import joined_rows
    from ratecraft.sources.fixtures import ROW_KEY, tpch_ratings
    ratings = tpch_ratings(spark, SF)
    no_user = ratings.limit(50).withColumn("user_id", F.lit(None).cast("long")).withColumn("l_linenumber", F.col("l_linenumber") + 100)
    no_city = ratings.limit(50).withColumn("place_city", F.lit(None).cast("string")).withColumn("l_linenumber", F.col("l_linenumber") + 200)
    rows = ratings.unionByName(no_user).unionByName(no_city).cache()
    cols = [*ROW_KEY, "user_mean", "user_count", "user_category_pref", "user_city_pref", "uc_present", "ucy_present", "u_present"]
    maps = joined_rows(rows, key_cols=ROW_KEY)
    pairs = joined_rows(rows, key_cols=ROW_KEY, max_map_entries=3)
    hot = joined_rows(rows, key_cols=ROW_KEY, max_map_entries=3, rows_per_task=2)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "map_from_entries" in plan(maps).lower() or "mapfromentries" in plan(maps).lower()
    for other in (pairs, hot):
        assert "from_entries" not in plan(other).lower() and "fromentries" not in plan(other).lower()
        a, b = maps.select(*cols), other.select(*cols)
        assert a.count() == b.count() and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_serving_preferences_beyond_a_map_are_the_same(spark):
    from ratecraft.plans import serving
    from ratecraft.plans.feature_matrix import attach_stats
    from ratecraft.sources.fixtures import ROW_KEY, tpch_ratings, tpch_requests
    tables = serving.serving_tables(tpch_ratings(spark, SF), key_cols=ROW_KEY)
    rows = serving.request_rows(tpch_requests(spark, SF)).cache()
    cols = ["request_id", "pos", "user_mean", "user_category_pref", "user_city_pref"]
    one = lambda **kw: attach_stats(rows, tables, salt_cols=["request_id", "pos"], count_big=True, **kw).select(*cols)
    a, b = one(), one(max_map_entries=0, rows_per_task=2)
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_a_category_without_a_column_is_an_error(spark):
    rows = spark.createDataFrame([(1, "A", 4.0, True), (1, "B", 2.0, True), (2, None, 3.0, True)],
                                 "user_id long, place_category string, user_rating double, is_train boolean")
    assert stats.preference_pivot(rows, ["A", "B"]).count() == 1
    with pytest.raises(Exception, match="no column for category B"):
        stats.preference_pivot(rows, ["A"]).collect()


# ---- O65
def test_every_tick_between_first_and_last_sample_has_a_value(spark):
    start = datetime(2024, 1, 1, 23, 59, 0)
    rows = [("a", 0, 1.0), ("a", 5, 2.0), ("a", 45, None), ("a", 3 * 86400, 3.0), (None, 70, 5.0), (None, 100, 6.0), ("b", 0, None), ("b", 20, 4.0)]
    df = spark.createDataFrame([(h, start + timedelta(seconds=s), v) for h, s, v in rows], "handler string, ts timestamp_ntz, value double")
    got = {(r["handler"], r["tick"]): r["value"] for r in sample_at_interval(df, ["handler"]).collect()}
    want = {}
    for h in ("a", None, "b"):
        own = [(s, v) for x, s, v in rows if x == h]
        first, last = own[0][0] // 10, own[-1][0] // 10
        for k in range(first, last + 1):
            known = [v for s, v in own if s // 10 <= k and v is not None]
            want[h, start + timedelta(seconds=10 * (k + 1))] = known[-1] if known else None
    assert got == want and len(got) > 3 * 8640
    some = sample_at_interval(df, ["handler"], carry=False)
    assert some.count() == 7 and sample_at_interval(df.limit(0), ["handler"]).count() == 0


# ---- O66
def test_expired_days_are_deleted_and_scans_are_pruned(spark):
    path = scratch_path(spark, "t-samples")
    with pytest.raises(ValueError):
        store.read_retained(spark, path, "1 hour")
    df = spark.range(0, 6 * 24).select((F.col("id") % 3).alias("handler"), (F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(hours="id")).cast(
        "timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("value"))
    store.append_samples(df.where("value < 100"), path)
    store.append_samples(df.where("value >= 100"), path)
    assert len(store.stored_days(spark, path)) == 6
    kept = store.read_retained(spark, path, "30 hours")
    assert sorted(r["value"] for r in kept.collect()) == [float(k) for k in range(113, 144)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-05" in plan
    assert store.drop_expired(spark, path, "30 hours") == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
    assert store.stored_days(spark, path) == ["2024-01-05", "2024-01-06"] and store.drop_expired(spark, path, "30 hours") == []
    assert sorted(r["value"] for r in store.read_retained(spark, path, "30 hours").collect()) == [float(k) for k in range(113, 144)]


# ---- O35
def test_booster_starts_from_the_mean_and_beats_it(spark):
    from ratecraft.constants import FEATURE_NAMES
    n = 400
    x = {c: F.sin(F.col("id") * (k + 1)) for k, c in enumerate(FEATURE_NAMES)}
    df = spark.range(n).select(*[v.alias(c) for c, v in x.items()], (F.lit(100.0) + 3 * x["user_mean"] + (x["place_mean"] > 0).cast("double")).alias("label"))
    model = train_gbt(df, n_trees=12, max_depth=4)
    scored = model.transform(df).select("label", "prediction")
    of = lambda rows: regression_metrics(rows).first()
    mean = df.select("label").withColumn("prediction", F.lit(df.agg(F.avg("label")).first()[0]))
    assert of(scored)["rmse"] < 0.5 * of(mean)["rmse"] and of(scored)["r2"] > 0.75
    assert trees_of(model).getNumTrees == 12
    copy = load_model(save_model(model, scratch_path(spark, "t-model")))
    assert copy.transform(df).select("prediction").collect() == scored.select("prediction").collect()
    # labels that are all the same: the mean start alone is right
    same = df.withColumn("label", F.lit(3.25))
    got = of(train_gbt(same, n_trees=2, max_depth=2).transform(same))
    assert (got["rmse"], got["r2"]) == (0.0, 1.0)
    assert of(same.withColumn("prediction", F.lit(3.0)))["r2"] == 0.0


# ---- session and catalog
def test_session_leaves_what_is_not_asked_for(monkeypatch):
    asked = {}

    class Builder:
        def __getattr__(self, name):
            return lambda *a: asked.setdefault(name, []).append(a) or self

        def getOrCreate(self):
            raise StopIteration

    monkeypatch.setattr(session, "SparkSession", type("S", (), {"builder": Builder()}))
    with pytest.raises(StopIteration):
        session.get_session()
    assert "master" not in asked
    assert not {"spark.sql.shuffle.partitions", "spark.driver.memory"} & {a[0] for a in asked["config"]}


def test_names_of_stores(monkeypatch):
    seen = []
    class Fs:
        @staticmethod
        def from_uri(uri):
            seen.append(uri)
            return None, uri

    monkeypatch.setattr(session.pafs, "FileSystem", Fs)
    for uri in ("s3a://bucket/x", "s3://bucket/x", "hdfs://host/x"):
        session.open_store(uri)
    assert seen == ["s3://bucket/x", "s3://bucket/x", "hdfs://host/x"]
    assert session.open_store("dbfs:/tmp/x")[1] == "/dbfs/tmp/x" and session.open_store("file:///tmp/x")[1] == "/tmp/x"


def test_clear_deletes_the_files(spark):
    from ratecraft.plans import catalog
    made = []

    def build():
        made.append(scratch_path(spark, "t-shared"))
        spark.range(3).write.parquet(made[0])
        return made[0]

    catalog.shared(spark, "t-dir", "t-object", build)
    catalog.model_path(spark, "t-dir", "t-model", lambda: made[0])
    path = made[0].removeprefix("file://").removeprefix("file:")
    assert os.path.exists(path)
    objects, tables, models = dict(catalog._OBJECTS), dict(catalog._TABLES), dict(catalog._MODELS)
    key = next(k for k in objects if k[2] == "t-object")
    try:
        for store_, name in ((catalog._OBJECTS, "t-object"), (catalog._MODELS, "t-model")):
            for k in [k for k in store_ if k[2] != name]:
                del store_[k]
        catalog._TABLES.clear()
        catalog.clear()
        assert not os.path.exists(path) and key not in catalog._OBJECTS
    finally:
        catalog._OBJECTS.update({k: v for k, v in objects.items() if k[2] != "t-object"})
        catalog._TABLES.update(tables)
        catalog._MODELS.update({k: v for k, v in models.items() if k[2] != "t-model"})


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    """Rows that lie in one partition: the fit would be one task per level."""
    from ratecraft.operators import train
    got = []

    class Recorder:
        def fit(self, rows):
            got.extend(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
            raise StopIteration

    monkeypatch.setattr(train, "gbt_pipeline", lambda **_: Recorder())
    rows = spark.range(40_000).select((F.col("id") % 7).alias("x"), (F.col("id") % 5).cast("double").alias("label")).coalesce(1)
    try:
        train.train_gbt(rows, features=["x"])
    except StopIteration:
        pass
    assert sum(got) == 40_000 and len(got) == 4 and max(got) <= 1.05 * min(got)


def test_scored_rows_are_spread(spark, monkeypatch):
    """Test rows that lie in one small file: one task would run all trees on all rows."""
    from ratecraft.plans import queries
    one = spark.range(40_000).select("id", (F.col("id") % 4 == 0).alias("is_train")).coalesce(1)
    monkeypatch.setattr(queries, "_matrix", lambda *_: one)
    rows = queries._test_rows(spark, "none")
    got = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(got) == 30_000 and len(got) == 3 and max(got) <= 1.05 * min(got)
    assert rows.where("is_train").count() == 0


def test_spread_gives_every_core_the_same_number_of_tasks(spark, monkeypatch):
    """Five tasks on four cores: each level of each tree would wait for one task."""
    from ratecraft.operators import train
    monkeypatch.setattr(train, "MOST_ROWS", 6_000)
    monkeypatch.setattr(train, "LEAST_ROWS", 1_000)
    cores = spark.sparkContext.defaultParallelism
    for n in (6_000 * cores + 1, 30_000, 6_000 * cores, 100):
        got = [r["count"] for r in train.spread(spark.range(n).coalesce(1), n).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(got) == n and max(got) <= 6_000
        assert len(got) % cores == 0 if n >= 1_000 * cores else len(got) == 1
