"""Service and model metrics over event tables (batch or stream).

The original keeps in-process counters, gauges and histograms that a
scraper samples every 10-15 s and dashboards query with rates and
quantiles.  Here the same numbers are aggregations over the events
themselves (request log, scored predictions) or over metric samples.
Every aggregate is algebraic (counts, sums, max_by), so Spark combines
partially before each shuffle and a hot series costs one partial row per
task.  Windows that need an order (counter resets, in-progress running
sums) run over per-tick aggregates, whose size is bounded by time range /
tick, never by raw row counts.

Window convention: sliding windows are ``[start, end)``; a per-second rate
is ``count / window_seconds`` (no extrapolation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (CONFIDENCE_BUCKETS, EXCLUDED_HANDLERS, QUANTILE, RATE_WINDOW,
                         RATE_WINDOW_SECONDS, SCRAPE_INTERVAL)


DAY_US = 86_400 * 1_000_000


def _le_label(b: float) -> str:
    return "+Inf" if b == float("inf") else repr(float(b))


# --------------------------------------------------------------- counters --
def recommendations_total(scored: DataFrame, labels: dict[str, str]) -> DataFrame:
    """O53 places scored per (model_name, model_stage) label set."""
    cols = [F.lit(v).alias(k) for k, v in labels.items()]
    return scored.groupBy(*cols).agg(F.count(F.lit(1)).alias("recommendations_total"))


def gauge_last(samples: DataFrame, series: list[str], value: str = "value",
               order: list[str] = ("ts",)) -> DataFrame:
    """O54 last non-null value per series (a gauge's current value).

    ``order`` ranks samples in time; add a sequence column to break equal
    timestamps.  ``max_by`` is partially aggregated, so long series are no
    problem."""
    key = F.struct(*[F.col(c) for c in order])
    return (samples.where(F.col(value).isNotNull())
            .groupBy(*series)
            .agg(F.max_by(F.col(value), key).alias("last_value"),
                 F.max(key)[order[0]].alias("last_ts")))


def histogram(df: DataFrame, value: str, by: list[str],
              buckets: list[float] = CONFIDENCE_BUCKETS) -> DataFrame:
    """O55 cumulative buckets ``le`` (+Inf), sum and count per group.

    One aggregate computes every bucket count; ``stack`` then emits one row
    per bucket."""
    bounds = list(buckets) + [float("inf")]
    aggs = []
    for i, b in enumerate(bounds):
        cond = F.col(value) <= F.lit(b) if b != float("inf") else F.col(value).isNotNull()
        aggs.append(F.count_if(cond).alias(f"b{i}"))
    aggs += [F.sum(value).alias("hist_sum"), F.count(value).alias("hist_count")]
    wide = df.groupBy(*by).agg(*aggs)
    stack = "stack({n}, {pairs}) as (le, bucket_count)".format(
        n=len(bounds), pairs=", ".join(f"'{_le_label(b)}', b{i}" for i, b in enumerate(bounds)))
    return wide.selectExpr(*[f"`{k}`" for k in by], stack, "hist_sum", "hist_count")


# ------------------------------------------------------------------ rates --
def per_step(df: DataFrame, ts: str, slide: str, by, *aggs: Column) -> DataFrame:
    """Aggregates per ``slide``-long step (``step`` is its start).  Windows that
    start on steps and last whole steps add these up, so the copies that
    sliding windows make are copies of these few rows, not of the raw ones."""
    return (df.groupBy(F.window(ts, slide).alias("w"), *by).agg(*aggs)
            .withColumn("step", F.col("w.start")).drop("w"))


def request_rate(log: DataFrame, by: list[str] = ("method", "status"),
                 width: str = RATE_WINDOW, slide: str = "1 minute",
                 seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """O56 requests per second in sliding windows, per ``by`` group."""
    if log.isStreaming:                  # one stateful aggregation
        return step_rates(log.withColumn("n", F.lit(1)), by, "ts", width, slide, seconds)
    return step_rates(per_step(log, "ts", slide, by, F.count(F.lit(1)).alias("n")), by, "step", width, slide, seconds)


def step_rates(counts: DataFrame, by: list[str], ts: str = "step", width: str = RATE_WINDOW, slide: str = "1 minute",
               seconds: int = RATE_WINDOW_SECONDS, n: str = "n") -> DataFrame:
    """Sums of ``n`` per second in sliding windows, per ``by`` group."""
    return (counts.groupBy(F.window(ts, width, slide).alias("w"), *by)
            .agg((F.sum(n) / F.lit(float(seconds))).alias("rate"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "rate"))


def endpoint_rates(log: DataFrame, handlers: list[str] | None = None, **kw) -> DataFrame:
    """O58 per-handler rates (optionally only ``handlers``)."""
    src = log if handlers is None else log.where(F.col("handler").isin(handlers))
    return request_rate(src, by=["handler"], **kw)


def counter_increases(samples: DataFrame, series: list[str], ts: str = "ts",
                      value: str = "value") -> DataFrame:
    """Increase of a sampled counter since its previous sample; a drop is a
    reset, so the new value is the increase.  The first sample of a series
    has no increase (unknown start).

    The previous sample is found inside (series, day) windows; the first
    sample of a day takes the last value of the series' previous sampled
    day from a window over one row per day, so no window partition holds
    more than one day of samples (or one row per day)."""
    day = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(DAY_US))
    x = samples.withColumn("__day", day)
    w = Window.partitionBy(*series, "__day").orderBy(ts)
    x = x.withColumn("__prev", F.lag(value).over(w))
    last = (x.groupBy(*series, "__day").agg(F.max_by(F.col(value), F.col(ts)).alias("__last")))
    wd = Window.partitionBy(*series).orderBy("__day")
    last = last.select(*series, "__day", F.lag("__last").over(wd).alias("__prev_day"))
    x = (x.join(last, [*series, "__day"])
         .withColumn("__prev", F.coalesce(F.col("__prev"), F.col("__prev_day"))))
    prev = F.col("__prev")
    inc = (F.when(prev.isNull(), F.lit(None).cast("double"))
           .when(F.col(value) >= prev, F.col(value) - prev)
           .otherwise(F.col(value)))
    return x.withColumn("increase", inc).drop("__day", "__prev", "__prev_day")


def running_total(per_time: DataFrame, series: list[str], n: str = "n") -> DataFrame:
    """``series``, ``ts`` and ``value``: the sum of ``n`` up to each time of one
    row per series and time.  Two-level, as in ``in_progress``."""
    x = per_time.withColumn("__day", F.date_trunc("day", "ts"))
    by_day = Window.partitionBy(*series).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = x.groupBy(*series, "__day").agg(F.sum(n).alias("__n")).select(
        *series, "__day", F.coalesce(F.sum("__n").over(by_day), F.lit(0)).alias("__offset"))
    own = Window.partitionBy(*series, "__day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return x.join(offsets, [*series, "__day"]).select(
        *series, "ts", (F.col("__offset") + F.sum(n).over(own)).cast("double").alias("value"))


def counter_rate(samples: DataFrame, series: list[str], width: str = RATE_WINDOW,
                 slide: str = "1 minute", seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """O57 per-second rate of a sampled counter, reset-aware, in sliding
    windows: sum of increases of samples inside the window / seconds."""
    inc = counter_increases(samples, series).where(F.col("increase").isNotNull())
    steps = per_step(inc, "ts", slide, series, F.sum("increase").alias("n"))
    return step_rates(steps, series, "step", width, slide, seconds)


def bucket_rates(df: DataFrame, value: str, buckets: list[float], ts: str = "ts",
                 by: list[str] = (), width: str = RATE_WINDOW, slide: str = "1 minute",
                 seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """O59 per-second rate of each cumulative bucket ``le`` per window: bucket
    counts per step, added up per window."""
    steps = histogram(df.withColumn("step", F.window(ts, slide)["start"]), value, ["step", *by], buckets)
    return (steps.groupBy(F.window("step", width, slide).alias("w"), *by, "le")
            .agg((F.sum("bucket_count") / F.lit(float(seconds))).alias("rate"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *by, "le", "rate"))


def bucket_quantile(cum: Column, bounds: list[float], q: float) -> Column:
    """Quantile from cumulative bucket counts (array column, last = +Inf):
    first bucket whose count reaches ``q * total``, linear inside it; the
    +Inf bucket answers with the highest finite bound; no data -> null."""
    finite = [float(b) for b in bounds]
    upper = F.array(*[F.lit(b) for b in finite])
    lower = F.array(*[F.lit(0.0)] + [F.lit(b) for b in finite[:-1]])
    total = F.element_at(cum, -1)
    rank = F.lit(q) * total
    idx = F.array_position(F.transform(cum, lambda c: c >= rank), True).cast("int")  # 1-based
    n_fin = len(finite)
    below = F.when(idx > 1, F.element_at(cum, F.greatest(idx - 1, F.lit(1)))).otherwise(F.lit(0))
    in_b = F.element_at(cum, F.greatest(idx, F.lit(1))) - below
    lo = F.element_at(lower, F.least(idx, F.lit(n_fin)))
    hi = F.element_at(upper, F.least(idx, F.lit(n_fin)))
    interp = lo + (hi - lo) * ((rank - below) / in_b)
    return (F.when((total.isNull()) | (total == 0), F.lit(None).cast("double"))
            .when(idx > n_fin, F.lit(finite[-1]))
            .otherwise(interp))


def latency_quantile(log: DataFrame, bounds: list[float], q: float = QUANTILE,
                     by: list[str] = ("handler",), width: str = RATE_WINDOW,
                     slide: str = "1 minute") -> DataFrame:
    """O60 ``histogram_quantile(q, sum(rate(bucket[5m])) by (le))`` per
    group and window.  Rates share the 1/seconds factor, so the quantile is
    computed from counts; one aggregate per step yields all cumulative counts,
    a second adds them up per window."""
    all_b = [float(b) for b in bounds] + [float("inf")]
    aggs = [(F.count_if(F.col("duration_s") <= F.lit(b)) if b != float("inf")
             else F.count(F.lit(1))).alias(f"b{i}") for i, b in enumerate(all_b)]
    g = (per_step(log, "ts", slide, by, *aggs).groupBy(F.window("step", width, slide).alias("w"), *by)
         .agg(F.array(*[F.sum(f"b{i}") for i in range(len(all_b))]).alias("cum")))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *by, bucket_quantile(F.col("cum"), bounds, q).alias(f"p{int(q * 100)}"))


# --------------------------------------------------------- status / misc --
def threshold_status(value: Column, bands: list[tuple[float | None, str]]) -> Column:
    """O61 dashboard colour: the last band whose start the value reaches
    (the first band has no start).  The exact value is compared."""
    out = F.lit(bands[0][1])
    for start, colour in bands[1:]:
        out = F.when(value >= F.lit(start), F.lit(colour)).otherwise(out)
    return F.when(value.isNull(), F.lit(None)).otherwise(out)


def excluded_handlers(log: DataFrame, excluded: list[str] = EXCLUDED_HANDLERS,
                      routes: list[str] | None = None) -> DataFrame:
    """O62 drop excluded handlers and, when ``routes`` is given, requests to
    paths that match no route (untemplated); status codes stay exact."""
    out = log.where(~F.col("handler").isin(excluded))
    if routes is not None:
        out = out.where(F.col("handler").isin(routes))
    return out


def in_progress(log: DataFrame, tick_seconds: int = 10, by: list[str] = ("handler",)) -> DataFrame:
    """O63 requests open at each tick instant T: start <= T < end.

    Each request adds +1 at the first tick >= start and -1 at the first tick
    >= end; deltas are summed per tick (partial aggregation), then a running
    sum over the ticks of each group gives the gauge at every tick where it
    changes.  The running sum is taken per day and offset by the earlier
    days' totals, so window partitions stay bounded by ticks per day."""
    ts_type = dict(log.dtypes)["ts"]
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    end = start + (F.col("duration_s") * F.lit(1e6)).cast("long")
    tick = F.lit(tick_seconds * 1_000_000)

    def ceil_tick(us: Column) -> Column:
        return (F.ceil(us / tick) * tick).cast("long")
    deltas = log.select(*by, F.explode(F.array(
        F.struct(ceil_tick(start).alias("t"), F.lit(1).alias("d")),
        F.struct(ceil_tick(end).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    per_tick = (deltas.groupBy(*by, F.col("e.t").alias("t"))
                .agg(F.sum("e.d").alias("delta"))
                .withColumn("day", F.floor(F.col("t") / F.lit(DAY_US))))
    # two-level prefix sum: running sum inside each (group, day) plus the
    # total of all earlier days, so no window holds more than one day of
    # ticks (or one row per day).
    day_tot = per_tick.groupBy(*by, "day").agg(F.sum("delta").alias("dsum"))
    w_days = (Window.partitionBy(*by).orderBy("day")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = day_tot.select(*by, "day", F.coalesce(F.sum("dsum").over(w_days),
                                                     F.lit(0)).alias("offset"))
    w_ticks = (Window.partitionBy(*by, "day").orderBy("t")
               .rowsBetween(Window.unboundedPreceding, 0))
    tick_ts = F.timestamp_micros("t").cast(ts_type)
    return (per_tick.join(offsets, [*by, "day"])
            .select(*by, tick_ts.alias("tick"),
                    (F.col("offset") + F.sum("delta").over(w_ticks)).alias("in_progress")))


def relabel(samples: DataFrame, rules: list[dict], labels: str = "labels") -> DataFrame:
    """O64 apply relabel rules (keep / replace / labelmap) to a label map,
    then drop labels starting with ``__``.

    Rule fields: ``action``, ``source_labels``, ``regex`` (fully anchored),
    ``separator`` (";"), ``target_label``, ``replacement`` ("$1")."""
    df = samples
    lab = F.col(labels)
    for r in rules:
        action = r.get("action", "replace")
        regex = f"^(?:{r.get('regex', '(.*)')})$"
        sep = r.get("separator", ";")
        repl = r.get("replacement", "$1")
        if action in ("keep", "drop", "replace"):
            src = F.concat_ws(sep, *[F.coalesce(lab[s], F.lit(""))
                                     for s in r.get("source_labels", [])])
        if action == "keep":
            df = df.where(src.rlike(regex))
        elif action == "drop":
            df = df.where(~src.rlike(regex))
        elif action == "replace":
            new = F.regexp_replace(src, regex, repl)
            df = df.withColumn(labels, F.when(
                src.rlike(regex),
                F.map_concat(F.map_filter(lab, lambda k, v: k != F.lit(r["target_label"])),
                             F.create_map(F.lit(r["target_label"]), new)))
                .otherwise(lab))
        elif action == "labelmap":
            pat = regex
            mapped = F.transform_keys(
                F.map_filter(lab, lambda k, v: k.rlike(pat)),
                lambda k, v: F.regexp_replace(k, pat, repl))
            keep_old = F.map_filter(lab, lambda k, v: ~F.map_contains_key(mapped, k))
            df = df.withColumn(labels, F.map_concat(keep_old, mapped))
        else:
            raise ValueError(f"unsupported relabel action {action}")
        lab = F.col(labels)
    return df.withColumn(labels, F.map_filter(F.col(labels), lambda k, v: ~k.startswith("__")))


def labels_text(labels: Column) -> Column:
    """Stable text form of a label map: ``k=v`` pairs sorted by key."""
    return F.array_join(F.array_sort(F.transform(
        F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


def sample_at_interval(samples: DataFrame, series: list[str], interval: str = SCRAPE_INTERVAL,
                       value: str = "value", order: list[str] = ("ts",), carry: bool = True) -> DataFrame:
    """O65 value of each series at every scrape tick from its first to its last
    sample: the last one of the tick, else the one before (``carry=False``: only
    ticks with samples).

    Ticks are laid out and filled per (series, day); a day begins with the last
    value of the days before it, from a window over one row per day, so no window
    holds more than a day of ticks.  A null sample repeats the value before."""
    key = F.struct(*[F.col(c) for c in order])
    found = (samples.groupBy(F.window("ts", interval).alias("w"), *series)
             .agg(F.max_by(F.col(value), key).alias("value"))
             .select(*series, F.col("w.end").alias("tick"), "value"))
    if not carry:
        return found
    step = F.expr(f"INTERVAL {interval}")
    found = found.withColumn("__day", F.to_date("tick"))
    spans = found.groupBy(*series).agg(F.min("tick").alias("__first"), F.max("tick").alias("__last"))
    # a row per series and day, with or without samples
    days = spans.select(*series, "__first", "__last", F.explode(F.sequence(F.to_date("__first"), F.to_date("__last"))).alias("__day"))
    last = found.groupBy(*series, "__day").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("tick"))).alias("__value"))
    before = Window.partitionBy(*series).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    opened = _same_keys(days, last, [*series, "__day"]).withColumn("__from", F.last("__value", ignorenulls=True).over(before))
    kind = dict(found.dtypes)["tick"]
    midnight = F.col("__day").cast("timestamp_ntz")
    ticks = opened.select(*series, "__day", "__from", F.explode(F.sequence(
        F.greatest("__first", midnight.cast(kind)),
        F.least("__last", (midnight + F.expr("INTERVAL 1 DAY") - step).cast(kind)), step)).alias("tick"))
    laid = _same_keys(ticks, found.drop("__day"), [*series, "tick"])
    so_far = Window.partitionBy(*series, "__day").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return laid.select(*series, "tick", F.coalesce(F.last("value", ignorenulls=True).over(so_far), F.col("__from")).alias("value"))


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys (a series without a label) are alike."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    alike = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys]
    return left.join(other, alike, "left").drop(*[f"__r_{c}" for c in keys])


def retention(samples: DataFrame, keep: str) -> DataFrame:
    """O66 rows no older than ``keep`` before the newest timestamp (the
    newest timestamp is a one-row aggregate, broadcast)."""
    return (with_newest(samples).where(F.col("ts") >= F.col("__newest") - F.expr(f"INTERVAL {keep}"))
            .drop("__newest"))


def with_newest(samples: DataFrame) -> DataFrame:
    return samples.crossJoin(F.broadcast(samples.agg(F.max("ts").alias("__newest"))))   # one row


def retained_counts(samples: DataFrame, horizons: dict[str, str], by: list[str]) -> DataFrame:
    """O66 how many samples of each group every horizon keeps, from one pass
    with a conditional count per horizon (groups without any are left out)."""
    wide = with_newest(samples).groupBy(*by).agg(*[
        F.count_if(F.col("ts") >= F.col("__newest") - F.expr(f"INTERVAL {keep}")).alias(name)
        for name, keep in horizons.items()])
    stack = "stack({n}, {pairs}) as (scope, n_samples)".format(
        n=len(horizons), pairs=", ".join(f"'{k}', `{k}`" for k in horizons))
    return wide.selectExpr(*by, stack).where("n_samples > 0")


def load_summary(log: DataFrame) -> DataFrame:
    """O67 load-test summary: totals, success % truncated to 2 decimals (0
    when there were no requests) and integer requests per second over the
    run's duration (elapsed + 1 second, integer division)."""
    a = log.agg(F.count(F.lit(1)).alias("total_requests"),
                F.count_if(F.col("status") == 200).alias("successful_requests"),
                F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    micros = F.unix_micros(F.col("t1").cast("timestamp")) - \
        F.unix_micros(F.col("t0").cast("timestamp"))
    elapsed = F.coalesce((micros / F.lit(1_000_000)).cast("long"), F.lit(0).cast("long"))
    total = F.col("total_requests")
    a = a.withColumn("duration_s", elapsed)
    return a.select(
        "total_requests", "successful_requests",
        (total - F.col("successful_requests")).alias("failed_requests"),
        F.when(total > 0, F.expr("(successful_requests * 10000) div total_requests")
               / F.lit(100.0)).otherwise(F.lit(0.0)).alias("success_rate"),
        "duration_s",
        F.expr("total_requests div (duration_s + 1)").alias("requests_per_second"))
