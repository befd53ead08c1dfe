"""Physical-plan shape of the flagship at "large table" settings.

Broadcasting by size estimate is switched off (as when tables are large)
and AQE is off so the static plan is inspected: the statistics are one
Expand + one shuffle, the rating scan is column-pruned, per-key joins are
sort-merge joins, category / city keep their checked broadcast.
"""

import re

import pytest

from ratecraft.operators import stats
from ratecraft.operators.split import with_split
from ratecraft.plans.feature_matrix import attach_stats, stat_tables
from ratecraft.plans.materialize import materialize
from ratecraft.sources.fixtures import ROW_KEY, tpch_ratings


@pytest.fixture()
def large_settings(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def salted_shuffles(plan: str) -> int:
    """Exchanges of the rows' joins: each has the rows on one side."""
    return len(re.findall(r"Exchange hashpartitioning\([^)]*__salt", plan))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_statistics_are_one_pass(large_settings):
    spark = large_settings
    rows = with_split(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
                      .selectExpr("l_orderkey as user_id", "l_partkey as place_id",
                                  "l_returnflag as place_category", "l_linestatus as place_city",
                                  "l_extendedprice as place_price", "l_quantity as user_rating",
                                  "l_linenumber as split_bucket"))
    p = _plan(stats.grouped_statistics(rows))
    assert p.count("Expand") == 1
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1
    assert p.count("FileScan parquet") == 1


def test_feature_matrix_join_plan(large_settings):
    spark = large_settings
    src = tpch_ratings(spark, "/root/testdata/sf0.001")
    path = spark.sparkContext.getCheckpointDir() + "/plan-test-ratings"
    src.write.mode("overwrite").parquet(path)
    rows = with_split(spark.read.parquet(path))
    t = stat_tables(rows)
    p = _plan(attach_stats(rows, t, salt_cols=ROW_KEY))
    # the rows meet users and places once each; the two other sort-merge joins
    # put a user's maps into the user's row
    assert p.count("SortMergeJoin") == 4
    assert salted_shuffles(p) == 2 * 2
    # category and city: checked broadcast; globals: one-row broadcast
    assert p.count("BroadcastHashJoin") == 2
    assert p.count("BroadcastNestedLoopJoin") == 1
    # the rating scan reads only the columns the features need
    reads = [l.split("ReadSchema:", 1)[1]
             for l in p.split("\n") if "FileScan parquet" in l and "ReadSchema:" in l]
    rating_scans = [r for r in reads if "l_orderkey" in r]
    assert rating_scans, p
    for r in rating_scans:                       # column pruning reached the scan
        assert "place_description" not in r and "l_quantity" not in r
    # every statistics scan reads one grouping set only (partition pruning)
    assert p.count("PartitionFilters: [isnotnull(gid") >= 4


def test_own_join_plans_are_small(large_settings):
    from ratecraft.plans.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    assert "Join" not in _plan(QUERIES["rating_price_ratio"](large_settings, sf))
    assert _plan(QUERIES["join_user_stats"](large_settings, sf)).count("SortMergeJoin") == 1
    assert _plan(QUERIES["join_category_city"](large_settings, sf)).count("SortMergeJoin") == 0


def test_category_statistics_shuffle_keys_only(large_settings):
    rows = with_split(large_settings.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
                      .selectExpr("l_orderkey as user_id", "l_returnflag as place_category",
                                  "l_quantity as user_rating", "l_linenumber as split_bucket"))
    p = _plan(stats.category_stats(rows))
    assert len(re.findall(r"Exchange hashpartitioning\(place_category", p)) == p.count("Exchange") == 1
    assert "l_orderkey" not in p


def test_sliding_windows_expand_steps_not_rows(large_settings):
    from ratecraft.constants import LATENCY_BUCKETS
    from ratecraft.operators import metrics
    from ratecraft.sources.fixtures import request_log
    log = request_log(large_settings, "/root/testdata/sf0.001")
    for df in (metrics.request_rate(log), metrics.latency_quantile(log, LATENCY_BUCKETS)):
        p = _plan(df)
        assert p.count("Expand") == 1 and p.index("Expand") < p.rindex("Exchange")   # a shuffle below it


def test_a_request_text_is_parsed_once(spark):
    """Validation filters on many parsed fields; pushed down, each parsed the text."""
    from ratecraft.plans import serving
    from ratecraft.sources.fixtures import tpch_requests
    texts = materialize(tpch_requests(spark, "/root/testdata/sf0.001"))
    plan = serving.request_rows(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, '{"places": []}')], "request_id long, body string")
    from ratecraft.sources.requests import parse_requests
    got = {r.request_id: (r.malformed, r.places) for r in parse_requests(odd).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (True, None), 4: (False, [])}


def test_request_lines_are_shuffled_flat(spark):
    from ratecraft.sources.fixtures import tpch_requests
    plan = tpch_requests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan


def test_requests_are_gathered_by_tasks_of_a_fixed_number_of_lines(spark, monkeypatch):
    """Tasks of a fixed number of shuffled bytes collected and sorted more lists
    than their memory holds.  Orders without lines and null names stay."""
    import json

    from pyspark.sql import functions as F

    from ratecraft.sources import fixtures
    few = materialize(fixtures.tpch_requests(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(fixtures, "REQUEST_LINES", 400, raising=False)
    df = fixtures.tpch_requests(spark, "/root/testdata/sf0.001")
    lines = fixtures.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for key in ("l_orderkey", "o_orderkey"):     # both sides alike, so that nothing is shuffled again
        deal = re.search(rf"RepartitionByExpression \[{key}#\d+L?\], (\d+)", plan)
        assert deal and int(deal[1]) == -(-lines // 400)
    assert df.exceptAll(few).count() == few.exceptAll(df).count() == 0
    texts = [r.body for r in few.where(F.col("body").endswith("]}")).limit(50).collect()]
    assert all(set(json.loads(t)) == {"user", "places"} and "},,{" not in t for t in texts)


def test_only_tables_too_large_to_broadcast_have_their_keys_counted(spark, monkeypatch):
    from ratecraft.operators import joins
    from ratecraft.plans import feature_matrix as fm, serving
    from ratecraft.sources.fixtures import tpch_requests
    seen, real = [], joins.key_counts
    monkeypatch.setattr(joins, "key_counts", lambda rows, *kinds: seen.append(kinds) or real(rows, *kinds))
    t = stat_tables(with_split(tpch_ratings(spark, "/root/testdata/sf0.001"), key_cols=ROW_KEY))
    t = t._replace(places=t.places.withColumn("place_id", t.places.place_id.cast("string")))
    rows = materialize(serving.request_rows(tpch_requests(spark, "/root/testdata/sf0.001")))
    attach = lambda: attach_stats(rows, t, salt_cols=["request_id", "pos"], count_big=True).select("request_id", "pos", "city_mean", "category_mean")
    small = attach()
    assert seen.pop() == (("user", "place"),)
    for module in (fm, joins):
        monkeypatch.setattr(module, "MAX_BROADCAST_ROWS" if module is fm else "bounded_broadcast", 1 if module is fm else lambda *a, **k: None)
    large = attach()
    assert seen.pop() == (("user", "place", "category", "city"),)
    assert small.exceptAll(large).count() == large.exceptAll(small).count() == 0
