"""Salted joins: hot keys are split across salts and results equal a plain join."""

from pyspark.sql import functions as F

from ratecraft.plans import skew


def _big(spark):
    # key 1 holds most rows (hot), keys 2..5 few, one null key
    rows = [(i, 1) for i in range(60)] + [(100 + i, 2 + i % 4) for i in range(12)] + [(999, None)]
    return spark.createDataFrame(rows, "rid long, k long")


def test_every_hot_key_is_listed(spark):
    big = _big(spark)
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = skew.hot_keys(counts, ["k"], "n", rows_per_task=2).collect()
    assert {r["k"]: r["__nsalt"] for r in hot} == {1: 30, 2: 2, 3: 2, 4: 2, 5: 2}


def test_hot_list_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_BROADCAST_ROWS", 0)
    big = _big(spark)
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    got = skew.salted_join(big, small, ["k"], rows_col=None, salt_cols=["rid"], rows_per_task=5)
    want = big.join(small, "k", "left")
    assert sorted(map(str, got.select("rid", "k", "v").collect())) == sorted(
        map(str, want.select("rid", "k", "v").collect()))


def test_null_keys_are_dealt_to_all_tasks(spark):
    """80 % null keys, adaptive execution off: no partition above twice the mean."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(20_000).select(F.col("id").alias("rid"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("k"))
        small = spark.range(0, 20_000, 10).select(F.col("id").alias("k"), F.lit("x").alias("v"))
        joined = skew.salted_join(big, small, ["k"], rows_col=None, salt_cols=["rid"])
        joined = joined.withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("part").count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) <= 2 * 20_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
        plain = big.join(small, "k", "left").select("rid", "k", "v")
        assert joined.select("rid", "k", "v").exceptAll(plain).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_salted_join_equals_plain_join(spark):
    big = _big(spark)
    small = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k long, v string")
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    small_c = small.join(counts, "k", "left")
    salted = skew.salted_join(big, small_c, ["k"], rows_col="rows", salt_cols=["rid"],
                              rows_per_task=5).select("rid", "k", "v")
    plain = big.join(small, "k", "left").select("rid", "k", "v")
    assert sorted(salted.collect()) == sorted(plain.collect())
    # counting the big side itself gives the same answer
    salted2 = skew.salted_join(big, small, ["k"], rows_col=None, salt_cols=["rid"],
                               rows_per_task=5).select("rid", "k", "v")
    assert sorted(salted2.collect()) == sorted(plain.collect())


def test_salt_spreads_hot_key(spark):
    big = _big(spark)
    small = spark.createDataFrame([(1, "a")], "k long, v string")
    hot = skew.hot_keys(big.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "n",
                        rows_per_task=5)
    salted = big.join(F.broadcast(hot), ["k"], "left").select(
        F.pmod(F.xxhash64("rid"), F.col("__nsalt")).alias("s")).where(F.col("s").isNotNull())
    assert salted.distinct().count() > 4
    assert small.count() == 1


def test_feature_matrix_with_hot_keys_matches_default(spark):
    from ratecraft.plans.feature_matrix import feature_matrix
    from ratecraft.sources.fixtures import ROW_KEY, tpch_ratings
    r = tpch_ratings(spark, "/root/testdata/sf0.001").cache()
    a = feature_matrix(r, key_cols=ROW_KEY)
    b = feature_matrix(r, key_cols=ROW_KEY, rows_per_task=3)   # most keys hot
    assert a.count() == b.count() == r.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert "__nsalt" in b._jdf.queryExecution().analyzed().toString()


def test_bounded_broadcast(spark):
    df = spark.range(10)
    assert skew.bounded_broadcast(df, max_rows=20).count() == 10
    assert skew.bounded_broadcast(df, max_rows=5) is None


def test_category_join_beyond_the_bound_is_salted(spark):
    from ratecraft.operators import joins, stats
    from ratecraft.operators.split import with_split
    from ratecraft.sources.fixtures import ROW_KEY, tpch_ratings
    rows = with_split(tpch_ratings(spark, "/root/testdata/sf0.001"))
    x = joins.with_globals(rows, stats.global_table(rows))
    tables = (stats.level_table(rows, "place_category", "uc", "category_mean", "category_count"),
              stats.level_table(rows, "place_city", "ucy", "city_mean", "city_count"))
    cols = [*ROW_KEY, "category_mean", "city_mean"]
    small = joins.join_category_city(x, *tables, salt_cols=ROW_KEY).select(*cols)
    large = joins.join_category_city(x, *tables, known_rows=(10**9, 10**9), salt_cols=ROW_KEY,
                                     rows_per_task=100).select(*cols)
    assert "__salt" in large._jdf.queryExecution().analyzed().toString()
    assert small.exceptAll(large).count() == large.exceptAll(small).count() == 0


def test_serving_join_with_hot_request_keys_matches_default(spark):
    """Serving path: hot keys counted on the request rows (key_counts)."""
    from ratecraft.plans import serving
    from ratecraft.plans.feature_matrix import attach_stats
    from ratecraft.sources.fixtures import ROW_KEY, tpch_ratings, tpch_requests
    sf = "/root/testdata/sf0.001"
    tables = serving.serving_tables(tpch_ratings(spark, sf), key_cols=ROW_KEY)
    rows = serving.request_rows(tpch_requests(spark, sf)).cache()
    cols = ["request_id", "pos", "user_mean", "place_mean", "category_mean",
            "user_category_pref", "user_city_pref", "user_avg_price"]
    a = attach_stats(rows, tables, salt_cols=["request_id", "pos"], count_big=True).select(*cols)
    b = attach_stats(rows, tables, salt_cols=["request_id", "pos"], count_big=True,
                     rows_per_task=2).select(*cols)
    assert a.count() == b.count() == rows.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert "__nsalt" in b._jdf.queryExecution().analyzed().toString()      # hot keys split
    assert "__nsalt" not in a._jdf.queryExecution().analyzed().toString()  # only null keys dealt


def test_pairs_shuffle_narrow_rows_or_partial_sums_of_hot_users(spark, monkeypatch):
    """Without hot users one narrow row per rating is shuffled and no partial
    sums; both ways give what one grouping gives."""
    from ratecraft.operators import stats
    from ratecraft.operators.split import with_split
    from ratecraft.sources.fixtures import tpch_ratings
    monkeypatch.setattr(stats, "PAIR_ROWS", 1000)
    rows = with_split(tpch_ratings(spark, "/root/testdata/sf0.001")).withColumn(
        "user_id", F.when(F.col("user_id") % 9 != 0, F.col("user_id"))).withColumn(
        "place_category", F.when(F.col("place_id") % 7 != 0, F.col("place_category")))
    cold, hot = (stats.pair_statistics(rows, rows.count(), h) for h in (False, True))
    plan = cold._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [user_id" in plan and "RepartitionBy" not in hot._jdf.queryExecution().optimizedPlan().toString()
    assert cold.exceptAll(hot).count() == hot.exceptAll(cold).count() == 0
    for other, gid in (("place_category", stats.GID_USER_CAT), ("place_city", stats.GID_USER_CITY)):
        got = cold.where(F.col("gid") == gid).select("user_id", other, "n_rows", "n_train", "sm", "c")
        want = stats.pair_table(rows, other, "x").where("user_id is not null")
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    # what is shuffled for a rating holds no aggregate: one exchange by the user alone
    shuffles = [x for x in cold._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(user_id" in x]
    assert len(shuffles) == 1 and "gid" not in shuffles[0]
