"""Adaptors from the driver's TPC-H-like test tables to the engine's inputs.

The test tables hold no ratings, requests or request logs, so these
functions only *shape* rows of those schemas out of the given tables; they
do none of the operators' work.  Each has an SQL twin (``*_SQL``) that the
DuckDB oracles embed, so both engines see identical input rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]

ROW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- ratings --
RATINGS_SQL = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber,
       o_custkey user_id, l_partkey place_id, p_type place_category, n_name place_city,
       p_retailprice place_price,
       1.0e0 + (p_partkey % 41)/10.0e0 place_average_rating,
       cast(30 + p_size*5 as integer) place_visit_duration_minutes,
       cast(18 + o_custkey % 83 as integer) user_age,
       1.0e0 + (o_custkey*7 + p_partkey*3 + cast(l_quantity as bigint)) % 5 user_rating,
       ((l_orderkey % 100)*61 + l_linenumber*3) % 100 split_bucket
from lineitem join orders on l_orderkey = o_orderkey
              join part   on l_partkey = p_partkey
              join nation on n_nationkey = p_partkey % 25
"""


def tpch_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating rows (F1) derived from lineitem/orders/part/nation.

    Row key: ``(l_orderkey, l_partkey, l_suppkey, l_linenumber)``.
    ``split_bucket`` in 0..99 is the deterministic split column (O10).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", "p_type", "p_retailprice", "p_size")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    pk = F.col("p_partkey")
    ck = F.col("o_custkey")
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(p, F.col("l_partkey") == pk)
        .join(n, F.col("n_nationkey") == pk % 25)
        .select(
            *ROW_KEY,
            ck.alias("user_id"),
            F.col("l_partkey").alias("place_id"),
            F.col("p_type").alias("place_category"),
            F.col("n_name").alias("place_city"),
            F.col("p_retailprice").alias("place_price"),
            (F.lit(1.0) + (pk % 41) / F.lit(10.0)).alias("place_average_rating"),
            (F.lit(30) + F.col("p_size") * 5).cast("int").alias("place_visit_duration_minutes"),
            (F.lit(18) + ck % 83).cast("int").alias("user_age"),
            (F.lit(1.0) + (ck * 7 + pk * 3 + F.col("l_quantity").cast("bigint")) % 5)
            .cast("double").alias("user_rating"),
            ((F.col("l_orderkey") % 100 * 61 + F.col("l_linenumber") * 3) % 100)
            .alias("split_bucket"),
        )
    )


# --------------------------------------------------------------- requests --
# One request per order; its places are the order's line items in row-key
# order.  Value ranges are stretched past the validation limits so that both
# outcomes of O6-O8 occur; a share of the JSON texts is cut short so that
# the malformed path of O2 runs too.
REQUEST_PLACES_SQL = """
select o_orderkey request_id, o_custkey user_id, o_orderdate ts,
       cast(16 + o_custkey % 87 as integer) user_age,
       (o_orderstatus = 'P' and o_orderpriority = '1-URGENT') cut_short,
       row_number() over (partition by o_orderkey
                          order by l_partkey, l_suppkey, l_linenumber) - 1 pos,
       cast(l_partkey as varchar) place_id, p_type place_category, n_name place_city,
       p_retailprice - 905.0e0 place_price,
       0.6e0 + (p_partkey % 48)/10.0e0 place_average_rating,
       cast(20 + p_size*5 as integer) place_visit_duration_minutes,
       case when p_partkey % 7 = 0 then null else p_name end place_description
from orders join lineitem on l_orderkey = o_orderkey
            join part     on l_partkey = p_partkey
            join nation   on n_nationkey = p_partkey % 25
"""

# Orders without line items become requests with an empty place list.
REQUEST_HEADERS_SQL = """
select o_orderkey request_id, o_custkey user_id, o_orderdate ts,
       cast(16 + o_custkey % 87 as integer) user_age,
       o_orderstatus preferred_category, o_orderpriority budget_range,
       (o_orderstatus = 'P' and o_orderpriority = '1-URGENT') cut_short
from orders
"""


# Line items per task that gathers them into requests, and the fewest tasks of a
# small table (if there are as many cores).
REQUEST_LINES, REQUEST_TASKS = 250_000, 8


def tpch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON request texts (F2): ``request_id, user_id, ts, body``."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", "p_type", "p_retailprice", "p_size", "p_name")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # A request carries its whole place list, so the order's line items are
    # gathered into one array per order: the length of one request text.
    # Requests over the API's 50-place limit are rejected by validation
    # before any scoring work.  What is shuffled are flat rows of the columns
    # that a place is made of; its JSON text is made where they arrive, still
    # flat, and the order's list joins texts.  Both sides of the join are dealt
    # over tasks of a fixed number of lines: in tasks of a fixed number of bytes
    # as shuffled, the lists being collected and sorted outgrow a task's memory.
    tasks = max(-(-li.count() // REQUEST_LINES), min(spark.sparkContext.defaultParallelism, REQUEST_TASKS))
    made_of = ["l_partkey", "l_suppkey", "l_linenumber", "p_type", "n_name", "p_retailprice", "p_size", "p_name"]
    pk = F.col("l_partkey")
    place = F.struct(
        pk.cast("string").alias("place_id"),
        F.col("p_type").alias("place_category"),
        F.col("n_name").alias("place_city"),
        (F.col("p_retailprice") - F.lit(905.0)).alias("place_price"),
        (F.lit(0.6) + (pk % 48) / F.lit(10.0)).alias("place_average_rating"),
        (F.lit(20) + F.col("p_size") * 5).cast("int").alias("place_visit_duration_minutes"),
        F.col("p_name").alias("place_description"))
    in_order = F.struct("l_partkey", "l_suppkey", "l_linenumber", F.to_json(place).alias("place"))
    lines = (
        li.join(p.withColumn("p_name", F.when(F.col("p_partkey") % 7 != 0, F.col("p_name"))),
                F.col("l_partkey") == F.col("p_partkey"))
        .join(n, F.col("n_nationkey") == F.col("p_partkey") % 25)
        .select("l_orderkey", *made_of).repartition(tasks, "l_orderkey")
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(in_order)).alias("lines"))
        .select("l_orderkey", F.array_join(F.col("lines.place"), ",").alias("places"))
    )
    req = o.repartition(tasks, "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    user = F.struct((F.lit(16) + F.col("o_custkey") % 87).cast("int").alias("user_age"),
                    F.col("o_orderstatus").alias("preferred_category"),
                    F.col("o_orderpriority").alias("budget_range"))
    cut = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    body = F.when(F.col("_cut"), F.expr("substring(body_full, 1, length(body_full) - 1)")) \
        .otherwise(F.col("body_full"))
    return (req.select(F.col("o_orderkey").alias("request_id"),
                       F.col("o_custkey").alias("user_id"),
                       F.col("o_orderdate").alias("ts"),
                       F.concat(F.lit('{"user":'), F.to_json(user), F.lit(',"places":['),
                                F.coalesce("places", F.lit("")), F.lit("]}")).alias("body_full"),
                       cut.alias("_cut"))
            .select("request_id", "user_id", "ts", body.alias("body")))


# ------------------------------------------------------------ request log --
# Event types stand for paths: the three routes, the excluded one and one that
# is no route.
EVENT_PATHS = {"view": "/predict", "click": "/recommend", "purchase": "/health",
               "signup": "/metrics", "error": "/wp-login.php"}
_PATH_CASE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_PATHS.items()) + " end"

REQUEST_LOG_SQL = f"""
select event_id, ts, 'POST' method, {_PATH_CASE} handler,
       case when event_type = 'error' then 500 else 200 end status,
       value duration_s
from events
"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP request log rows (F4) from ``events``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts",
        F.lit("POST").alias("method"),
        F.expr(_PATH_CASE).alias("handler"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).cast("int").alias("status"),
        F.col("value").alias("duration_s"),
    )


# ---------------------------------------------------------- metric samples --
# Gauge samples: every request sets a duration gauge for its handler.
GAUGE_SAMPLES_SQL = """
select event_id seq, 'request_duration_seconds' metric, event_type handler, ts, value
from events
"""


def gauge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"),
                    F.lit("request_duration_seconds").alias("metric"),
                    F.col("event_type").alias("handler"), "ts", "value")


# Counter samples: a per-handler request counter, as a scrape every 10 s
# would read it; the serving process restarts at midnight, so the counter
# starts from zero every day (resets).  Only ticks with requests appear.
COUNTER_SAMPLES_SQL = """
select 'http_requests_total' metric, handler, ts,
       cast(sum(n) over (partition by handler, cast(ts - interval 1 microsecond as date)
                         order by ts rows between unbounded preceding and current row)
            as double) value
from (select event_type handler,
             time_bucket(interval 10 second, ts) + interval 10 second ts, count(*) n
      from events group by 1, 2)
"""


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ticks = (e.groupBy(F.col("event_type").alias("handler"),
                       F.window("ts", "10 seconds").end.alias("ts"))
             .agg(F.count(F.lit(1)).alias("n")))
    day = F.to_date(F.col("ts") - F.expr("INTERVAL 1 MICROSECOND"))
    from pyspark.sql import Window
    w = (Window.partitionBy("handler", day).orderBy("ts")
         .rowsBetween(Window.unboundedPreceding, 0))
    return ticks.select(F.lit("http_requests_total").alias("metric"), "handler", "ts",
                        F.sum("n").over(w).cast("double").alias("value"))


# Scrape targets: pod discovery labels for each event's source pod.  Fixed
# values: the label names that the relabelling rules (constants.py) refer to.
TARGET_LABELS_SQL = """
select event_id,
  map {'__address__': concat('10.0.', user_id % 7, '.', user_id % 11, ':8000'),
       '__meta_kubernetes_namespace': 'ml-deployment',
       '__meta_kubernetes_pod_name': concat('fastapi-app-', user_id % 5),
       '__meta_kubernetes_pod_label_app':
          case when event_type = 'signup' then 'worker' else 'fastapi-app' end,
       '__meta_kubernetes_pod_label_tier': 'api',
       '__meta_kubernetes_pod_annotation_prometheus_io_scrape':
          case when event_type = 'error' then 'false' else 'true' end,
       '__meta_kubernetes_pod_annotation_prometheus_io_path': '/metrics',
       '__meta_kubernetes_pod_annotation_prometheus_io_port': '9100',
       'handler': event_type} labels
from events
"""


def target_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    lab = F.create_map(
        F.lit("__address__"), F.concat(F.lit("10.0."), (u % 7).cast("string"), F.lit("."),
                                       (u % 11).cast("string"), F.lit(":8000")),
        F.lit("__meta_kubernetes_namespace"), F.lit("ml-deployment"),
        F.lit("__meta_kubernetes_pod_name"), F.concat(F.lit("fastapi-app-"),
                                                      (u % 5).cast("string")),
        F.lit("__meta_kubernetes_pod_label_app"),
        F.when(F.col("event_type") == "signup", "worker").otherwise("fastapi-app"),
        F.lit("__meta_kubernetes_pod_label_tier"), F.lit("api"),
        F.lit("__meta_kubernetes_pod_annotation_prometheus_io_scrape"),
        F.when(F.col("event_type") == "error", "false").otherwise("true"),
        F.lit("__meta_kubernetes_pod_annotation_prometheus_io_path"), F.lit("/metrics"),
        F.lit("__meta_kubernetes_pod_annotation_prometheus_io_port"), F.lit("9100"),
        F.lit("handler"), F.col("event_type"))
    return e.select("event_id", lab.alias("labels"))
