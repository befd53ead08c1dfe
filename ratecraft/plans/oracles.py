"""DuckDB SQL twins of the registered queries (the correctness oracles).

Written independently of the Spark code, straight from the semantics of
the original: statistics over training rows, pandas-style defaults.
Doubles are rounded to 6 digits, as in the Spark queries.
"""

from __future__ import annotations

from ..constants import FEATURE_NAMES
from ..sources.fixtures import RATINGS_SQL

R6 = "round({0}, 6)"


def r6(expr: str, alias: str | None = None) -> str:
    out = f"round({expr}, 6)"
    return f"{out} as {alias}" if alias else out


# rows of the rating table with the split flag, and the training rows
BASE = f"""
r as ({RATINGS_SQL}),
x as (select *, split_bucket < 80 as is_train from r),
t as (select * from x where is_train)
"""

STATS = BASE + """,
g as (select avg(user_rating) global_mean, stddev_samp(user_rating) global_std from t),
u as (select user_id, coalesce(avg(user_rating), 0) um,
             coalesce(stddev_samp(user_rating), 0) us,
             cast(count(user_rating) as double) uc,
             coalesce(min(user_rating), 0) umin, coalesce(max(user_rating), 0) umax,
             coalesce(avg(place_price), 0) uap, coalesce(stddev_samp(place_price), 0) ups
      from t where user_id is not null group by user_id),
p as (select place_id, coalesce(avg(user_rating), 0) pm,
             coalesce(stddev_samp(user_rating), 0) ps,
             cast(count(user_rating) as double) pc,
             coalesce(min(user_rating), 0) pmin, coalesce(max(user_rating), 0) pmax
      from t where place_id is not null group by place_id),
c as (select place_category, coalesce(avg(user_rating), 0) cm,
             cast(count(user_rating) as double) cc
      from t where place_category is not null group by place_category),
y as (select place_city, coalesce(avg(user_rating), 0) ym,
             cast(count(user_rating) as double) yc
      from t where place_city is not null group by place_city),
ucp as (select user_id, place_category, avg(user_rating) v from t
        where user_id is not null and place_category is not null group by 1, 2),
uyp as (select user_id, place_city, avg(user_rating) v from t
        where user_id is not null and place_city is not null group by 1, 2)
"""

def join_block(target: str, out: str, place_key: str = "p.place_id") -> str:
    """CTEs ``{out}0``/``{out}``: ``target`` rows with every statistic joined
    (pandas defaults) and the scalar features."""
    return f"""
{out}0 as (
  select x.*, g.global_mean, g.global_std,
    case when u.user_id is not null then u.um else g.global_mean end user_mean,
    case when u.user_id is not null then u.us else g.global_std end user_std,
    case when u.user_id is not null then u.uc else 0.0e0 end user_count,
    case when u.user_id is not null then u.umax - u.umin else 0.0e0 end user_range,
    case when p.place_id is not null then p.pm else g.global_mean end place_mean,
    case when p.place_id is not null then p.ps else g.global_std end place_std,
    case when p.place_id is not null then p.pc else 0.0e0 end place_count,
    case when c.place_category is not null then c.cm else g.global_mean end category_mean,
    case when y.place_city is not null then y.ym else g.global_mean end city_mean,
    case when ucp.user_id is not null then ucp.v else g.global_mean end user_category_pref,
    case when uyp.user_id is not null then uyp.v else g.global_mean end user_city_pref,
    case when u.user_id is not null then u.uap else x.place_price end user_avg_price,
    u.user_id is null u_cold, p.place_id is null p_cold, c.place_category is null c_cold,
    y.place_city is null y_cold, ucp.user_id is null uc_cold, uyp.user_id is null uy_cold
  from {target} x cross join g
  left join u on x.user_id = u.user_id
  left join p on x.place_id = {place_key}
  left join c on x.place_category = c.place_category
  left join y on x.place_city = y.place_city
  left join ucp on x.user_id = ucp.user_id and x.place_category = ucp.place_category
  left join uyp on x.user_id = uyp.user_id and x.place_city = uyp.place_city),
{out} as (
  select *,
    ln(1 + place_count) place_popularity,
    case when user_avg_price > 0 then place_price / user_avg_price else 1.0e0 end price_ratio,
    place_average_rating place_rating,
    cast(place_visit_duration_minutes as double) place_duration,
    abs(user_mean - place_mean) user_place_deviation,
    case when place_price > 0 then place_average_rating / ln(1 + place_price)
         else place_average_rating end rating_price_ratio
  from {out}0)
"""


JOINED = STATS + "," + join_block("x", "j")

KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _with(ctes: str, body: str) -> str:
    return f"with {ctes}\n{body}"


def _pick(cols: list[str]) -> str:
    return _with(JOINED, f"select {KEY}, " + ", ".join(r6(c, c) for c in cols) + " from j")


def _feature_sql() -> str:
    cols = []
    for n in FEATURE_NAMES:
        src = "cast(user_age as double)" if n == "user_age" else n
        cols.append(r6(src, n))
    return _with(JOINED, f"select {KEY}, is_train, " + ", ".join(cols)
                 + ", round(user_rating, 6) as label from j")


ORACLES = {
    "scan_ratings": _with(BASE, f"""
        select {KEY}, user_id, place_id, place_category, place_city,
               round(place_price, 6) place_price,
               round(place_average_rating, 6) place_average_rating,
               place_visit_duration_minutes, user_age, round(user_rating, 6) user_rating
        from r"""),
    "train_test_split": _with(BASE, """
        select is_train, count(*) n_rows, count(distinct user_id) n_users
        from x group by is_train"""),
    "train_test_split_exact": _with(BASE, """
        select rn > (select cast(ceil(count(*) * 20 / 100.0) as bigint) from r) is_train, count(*) n_rows,
               count(distinct user_id) n_users, cast(sum(l_orderkey * 7 + l_partkey) as bigint) key_sum
        from (select *, row_number() over (order by md5(concat_ws(':', '42', l_orderkey, l_partkey, l_suppkey, l_linenumber))) rn from r)
        group by 1"""),
    "user_stats": _with(STATS, """
        select user_id, round(um, 6) user_mean, round(us, 6) user_std, uc user_count,
               round(umin, 6) user_min, round(umax, 6) user_max from u"""),
    "place_stats": _with(STATS, """
        select place_id, round(pm, 6) place_mean, round(ps, 6) place_std, pc place_count,
               round(pmin, 6) place_min, round(pmax, 6) place_max from p"""),
    "category_stats": _with(STATS, """
        select place_category, round(cm, 6) category_mean, cc category_count from c"""),
    "city_stats": _with(STATS, """
        select place_city, round(ym, 6) city_mean, yc city_count from y"""),
    "global_stats": _with(STATS, """
        select round(global_mean, 6) global_mean, round(global_std, 6) global_std from g"""),
    "user_category_pref": _with(STATS, """
        select user_id, place_category, round(v, 6) user_category_pref from ucp"""),
    "user_city_pref": _with(STATS, """
        select user_id, place_city, round(v, 6) user_city_pref from uyp"""),
    "user_price_stats": _with(STATS, """
        select user_id, round(uap, 6) user_avg_price, round(ups, 6) user_price_std from u"""),
    "join_user_stats": _pick(["user_mean", "user_std", "user_count", "user_range"]),
    "join_place_stats": _pick(["place_mean", "place_std", "place_count"]),
    "join_category_city": _pick(["category_mean", "city_mean"]),
    "join_preferences": _pick(["user_category_pref", "user_city_pref"]),
    "join_user_price": _pick(["user_avg_price"]),
    "cold_start_rows": _with(JOINED + ", tt as (select * from j where not is_train)", """
        select kind, n_rows from (
          select 'user' kind, cast(count_if(u_cold) as bigint) n_rows from tt union all
          select 'place', cast(count_if(p_cold) as bigint) from tt union all
          select 'category', cast(count_if(c_cold) as bigint) from tt union all
          select 'city', cast(count_if(y_cold) as bigint) from tt union all
          select 'user_category', cast(count_if(uc_cold) as bigint) from tt union all
          select 'user_city', cast(count_if(uy_cold) as bigint) from tt union all
          select 'all_test', count(*) from tt)"""),
    "place_popularity": _pick(["place_popularity"]),
    "price_ratio": _pick(["price_ratio"]),
    "user_place_deviation": _pick(["user_place_deviation"]),
    "rating_price_ratio": _pick(["rating_price_ratio"]),
    "feature_matrix": _feature_sql(),
}


# ------------------------------------------------------------ requests ----
from ..sources.fixtures import REQUEST_HEADERS_SQL, REQUEST_PLACES_SQL  # noqa: E402

REQ = f"""
rq as ({REQUEST_HEADERS_SQL}),
rp as ({REQUEST_PLACES_SQL}),
rpv as (select *, concat_ws(',',
          case when place_id is null or place_category is null or place_city is null
                 or place_price is null or place_average_rating is null
                 or place_visit_duration_minutes is null then 'missing_field' end,
          case when place_price < 0 then 'price_negative' end,
          case when not (place_average_rating between 1.0e0 and 5.0e0)
               then 'rating_out_of_range' end,
          case when place_visit_duration_minutes < 30 then 'duration_too_short' end) violations
        from rp where not cut_short),
ra as (select request_id, count(*) n, bool_and(violations = '') ok from rpv group by request_id),
rv as (select rq.request_id, rq.user_id, rq.user_age, rq.cut_short,
         cast(case when rq.cut_short then 0 else coalesce(ra.n, 0) end as integer) n_places,
         case when rq.cut_short then 'malformed'
              when rq.user_age is null or not (rq.user_age between 18 and 100) then 'user_age'
              when coalesce(ra.n, 0) < 1 or coalesce(ra.n, 0) > 50 then 'place_count'
              when not ra.ok then 'places' end reason
       from rq left join ra on ra.request_id = rq.request_id),
vp as (select rpv.* from rpv join rv on rv.request_id = rpv.request_id where rv.reason is null)
"""

DEFAULT_FEATURES = """
select request_id, cast(pos as integer) pos,
  3.5e0 user_mean, 1.0e0 user_std, 10.0e0 user_count, 4.0e0 user_range,
  3.5e0 place_mean, 1.0e0 place_std, 50.0e0 place_count, round(ln(51.0e0), 6) place_popularity,
  3.5e0 category_mean, 3.5e0 city_mean, 3.5e0 user_category_pref, 3.5e0 user_city_pref,
  round(place_price, 6) place_price, round(place_price * 1.1e0, 6) user_avg_price,
  round(case when place_price * 1.1e0 > 0 then place_price / (place_price * 1.1e0)
             else 1.0e0 end, 6) price_ratio,
  round(place_average_rating, 6) place_rating,
  cast(place_visit_duration_minutes as double) place_duration,
  cast(user_age as double) user_age, 0.0e0 user_place_deviation,
  round(case when place_price > 0 then place_average_rating / ln(1 + place_price)
             else place_average_rating end, 6) rating_price_ratio,
  3.5e0 global_mean, 1.0e0 global_std
from vp
"""

# enriched request features, predictor, scores and ranks
SCORED = STATS + "," + REQ + "," + join_block("vp", "e", "cast(p.place_id as varchar)") + """,
s0 as (select *, place_rating + user_mean - global_mean prediction from e),
s1 as (select *, greatest(1.0e0, least(5.0e0, prediction)) clipped from s0),
s2 as (select *, 0.8e0 + 0.2e0 * (1.0e0 - abs(clipped - 3.5e0) / 1.5e0) confidence_raw from s1),
s3 as (select *, cast(round_even(clipped * 100.0e0, 0) as double) / 100.0e0 predicted_rating,
              cast(round_even(confidence_raw * 1000.0e0, 0) as double) / 1000.0e0
                confidence_score from s2),
rk as (select *, cast(row_number() over (partition by request_id
                 order by predicted_rating desc, pos) as integer) recommendation_rank from s3),
-- mean of the top 5, rounded to hundredths by the double's exact value, half to even
sm0 as (select request_id, count(*) total_places_evaluated,
          list_reduce(list(predicted_rating order by recommendation_rank)
                      filter (where recommendation_rank <= 5), lambda a, b: a + b)
          / count(*) filter (where recommendation_rank <= 5) av
        from rk group by request_id),
sm1 as (select *, cast(av * 4503599627370496.0e0 as bigint) * 100 w from sm0),
sm as (select request_id, total_places_evaluated,
         ((w // 4503599627370496) + case
            when w % 4503599627370496 > 2251799813685248 then 1
            when w % 4503599627370496 = 2251799813685248 and (w // 4503599627370496) % 2 = 1 then 1
            else 0 end) / 100.0e0 average_predicted_rating
       from sm1),
-- population std of hundredths, in whole numbers
dv0 as (select request_id, count(*) n, cast(sum(cast(round(predicted_rating * 100) as bigint)) as bigint) s,
          cast(sum(cast(round(predicted_rating * 100) as bigint) * cast(round(predicted_rating * 100) as bigint)) as bigint) q
        from rk group by request_id),
dv as (select request_id, case when n > 1 then least(1.0e0, sqrt(cast(n * q - s * s as double)) / (n * 200.0e0))
                               else 0.5e0 end d from dv0),
tx as (select request_id, string_agg(recommendation_rank || ':' || place_id || ':'
                || cast(round(predicted_rating * 100) as bigint), ',' order by recommendation_rank) places,
              string_agg(recommendation_rank || ':' || place_id || ':'
                || cast(round(predicted_rating * 100) as bigint), ',' order by recommendation_rank)
                filter (where recommendation_rank <= 5) top_places,
              arg_min(place_id, recommendation_rank) top_place_id, cast(count(*) as integer) n
       from rk group by request_id)
"""


def _enriched_sql() -> str:
    cols = []
    for n in FEATURE_NAMES:
        src = "cast(user_age as double)" if n == "user_age" else n
        cols.append(r6(src, n))
    return _with(SCORED, "select request_id, cast(pos as integer) pos, " + ", ".join(cols)
                 + " from e")


ORACLES.update({
    "parse_requests": _with(REQ, """
        select count(*) n_requests, cast(count_if(cut_short) as bigint) n_malformed,
               (select count(*) from rpv) n_places from rq"""),
    "validate_users": _with(REQ, """
        select request_id, user_age,
               coalesce(user_age between 18 and 100, false) user_valid
        from rq where not cut_short"""),
    "validate_places": _with(REQ, """
        select request_id, cast(pos as integer) pos, violations = '' place_valid, violations
        from rpv"""),
    "validate_requests": _with(REQ, """
        select request_id, n_places, reason is null valid, reason from rv"""),
    "default_fill": _with(REQ, """
        select request_id, cast(pos as integer) pos,
               coalesce(place_description, '') place_description from rpv"""),
    "explode_places": _with(REQ, """
        select request_id, cast(pos as integer) pos, user_age, place_id, place_category,
               place_city, round(place_price, 6) place_price,
               round(place_average_rating, 6) place_average_rating,
               place_visit_duration_minutes from rpv"""),
    "serving_features": _with(REQ, DEFAULT_FEATURES),
    "serving_features_enriched": _enriched_sql(),
    "clip_rating": _with(SCORED, """
        select request_id, cast(pos as integer) pos, round(prediction, 6) prediction,
               round(clipped, 6) clipped from rk"""),
    "confidence": _with(SCORED, """
        select request_id, cast(pos as integer) pos, round(confidence_raw, 6) confidence_raw
        from rk"""),
    "round_scores": _with(SCORED, """
        select request_id, cast(pos as integer) pos, predicted_rating, confidence_score
        from rk"""),
    "rank_places": _with(SCORED, """
        select request_id, cast(pos as integer) pos, place_id, predicted_rating,
               confidence_score, recommendation_rank from rk"""),
    "top_recommendation": _with(SCORED, """
        select request_id, place_id, predicted_rating, confidence_score
        from rk where recommendation_rank = 1"""),
    "recommend_top_k": _with(SCORED, """
        select request_id, recommendation_rank, place_id, predicted_rating
        from rk where recommendation_rank <= 5"""),
    "recommend_summary": _with(SCORED, """
        select request_id, total_places_evaluated, 5 top_k_requested, average_predicted_rating
        from sm"""),
    "diversity": _with(SCORED, "select request_id, round(d, 6) diversity from dv"),
    "request_response": _with(SCORED, """
        select request_id, 'bias-baseline' model_used, n total_places_evaluated, top_place_id,
               true has_timestamp, places from tx"""),
    "recommend_response": _with(SCORED, """
        select sm.request_id, user_age, preferred_category, cast(null as varchar) preferred_city,
               budget_range, 'bias-baseline' model_used, total_places_evaluated, 5 top_k_requested,
               average_predicted_rating, true has_timestamp, top_places places
        from sm join rq on rq.request_id = sm.request_id join tx on tx.request_id = sm.request_id"""),
})
ORACLES["response_sink"] = ORACLES["request_response"]

# One column per category; an absent pair takes the global mean, a
# present pair whose ratings are all null stays null.
_CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
ORACLES["preference_pivot"] = _with(STATS, "select user_id, " + ", ".join(
    f"""round(case when count_if(place_category = '{c}') > 0
               then avg(case when place_category = '{c}' then user_rating end)
               else (select global_mean from g) end, 6) as "{c}\""""
    for c in _CATEGORIES) + """
  from t where user_id is not null and exists (
    select 1 from t t2 where t2.user_id = t.user_id and t2.place_category is not null)
  group by user_id""")


# ------------------------------------------------------ train / evaluate ---
TB = JOINED + """,
tb as (select user_rating y, place_rating + user_mean - global_mean p
       from j where not is_train)
"""


def _scale_sql() -> str:
    feats = []
    for n in FEATURE_NAMES:
        feats.append("cast(user_age as double)" if n == "user_age" else n)
    fit = ", ".join(f"avg({e}) m{i}, var_pop({e}) v{i}" for i, e in enumerate(feats))
    eps = "2.220446049250313e-16"
    cols = []
    for i, (n, e) in enumerate(zip(FEATURE_NAMES, feats)):
        bound = f"(cnt * {eps} * v{i} + (cnt * m{i} * {eps}) * (cnt * m{i} * {eps}))"
        cols.append(f"round(({e} - m{i}) / case when v{i} <= {bound} then 1.0e0 "
                    f"else sqrt(v{i}) end, 6) + 0.0e0 as {n}")
    return _with(JOINED + f", sc as (select count(*) cnt, {fit} from j where is_train)",
                 f"select {KEY}, " + ", ".join(cols) + " from j cross join sc")


ORACLES.update({
    "standard_scale": _scale_sql(),
    "regression_metrics": _with(TB, """
        select round(avg((y - p) * (y - p)), 6) mse, round(avg(abs(y - p)), 6) mae,
               round(sqrt(avg((y - p) * (y - p))), 6) rmse,
               round(case when var_pop(y) * count(*) > 0
                     then 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))
                     when sum((y - p) * (y - p)) = 0 then 1 when count(*) > 0 then 0 end, 6) r2
        from tb"""),
    "binary_metrics": _with(TB + """,
        cm as (select count_if(y >= 3.5 and p >= 3.5) tp, count_if(y < 3.5 and p >= 3.5) fp,
                      count_if(y >= 3.5 and p < 3.5) fn from tb),
        pr as (select case when tp + fp > 0 then cast(tp as double) / (tp + fp) else 0.0e0 end pre,
                      case when tp + fn > 0 then cast(tp as double) / (tp + fn) else 0.0e0 end rec
               from cm)""", """
        select round(pre, 6) "precision", round(rec, 6) recall,
               round(case when pre + rec > 0 then 2.0e0 * pre * rec / (pre + rec)
                     else 0.0e0 end, 6) f1_score from pr"""),
    "ndcg_at_k": _with(TB + """,
        rl as (select p s, case when y >= 4.0e0 then 1 else 0 end rel from tb),
        gr as (select s, count(*) n, sum(rel) g from rl group by s order by s desc limit 10),
        ps as (select *, coalesce(sum(n) over (order by s desc
                 rows between unbounded preceding and 1 preceding), 0) st from gr),
        dc as (select sum(cast(g as double) / n * coalesce(list_sum(list_transform(
                 range(cast(st as bigint), cast(least(st + n, 10) as bigint)), lambda i: 1.0e0 / log2(i + 2))), 0.0e0)) dcg
               from ps),
        tt as (select sum(rel) n_rel, count(*) n_rows from rl),
        id as (select n_rows, coalesce(list_sum(list_transform(
                 range(0, cast(least(n_rel, 10) as bigint)), lambda i: 1.0e0 / log2(i + 2))), 0.0e0) idcg
               from tt)""", """
        select round(case when idcg > 0 and n_rows > 1 then coalesce(dcg, 0.0e0) / idcg
                     else 0.0e0 end, 6) ndcg_10
        from id cross join dc"""),
    "baseline_predict": _with(JOINED, f"""
        select {KEY}, round(global_mean, 6) prediction from j where not is_train"""),
})


# -------------------------------------------------------------- metrics ---
from ..sources.fixtures import (COUNTER_SAMPLES_SQL, GAUGE_SAMPLES_SQL,  # noqa: E402
                                REQUEST_LOG_SQL)

LOG = f"lg as ({REQUEST_LOG_SQL})"
# sliding 5-minute windows, 1-minute steps: every row in 5 windows [start, start+5m)
SLIDE = """sw as (select *, time_bucket(interval 1 minute, ts) - k * interval 1 minute ws
            from {src}, range(0, 5) t(k))"""
CONF_BUCKETS = "(values ('0.1', 0.1e0), ('0.2', 0.2e0), ('0.3', 0.3e0), ('0.4', 0.4e0), " \
               "('0.5', 0.5e0), ('0.6', 0.6e0), ('0.7', 0.7e0), ('0.8', 0.8e0), " \
               "('0.9', 0.9e0), ('1.0', 1.0e0), ('+Inf', cast('inf' as double))) b(le, bound)"

ORACLES.update({
    "recommendations_total": _with(SCORED, """
        select 'bias-baseline' model_name, 'Production' model_stage,
               count(*) recommendations_total from rk"""),
    "gauge_last": f"""
        with gs as ({GAUGE_SAMPLES_SQL}),
        o as (select *, row_number() over (partition by handler order by ts desc, seq desc) rn
              from gs where value is not null)
        select handler, round(value, 6) last_value, ts last_ts from o where rn = 1""",
    "confidence_histogram": _with(SCORED + f""",
        hs as (select sum(confidence_raw) hist_sum, count(confidence_raw) hist_count from rk),
        hb as (select le, cast(count_if(confidence_raw <= bound) as bigint) bucket_count
               from rk, {CONF_BUCKETS} group by le)""", """
        select 'bias-baseline' model_name, 'Production' model_stage, le, bucket_count,
               round(hist_sum, 6) hist_sum, hist_count from hb, hs"""),
    "request_rate": f"""
        with {LOG}, {SLIDE.format(src='lg')}
        select ws window_start, ws + interval 5 minute window_end, method, status,
               round(count(*) / 300.0e0, 6) rate
        from sw group by ws, method, status""",
    "counter_rate": f"""
        with cs as ({COUNTER_SAMPLES_SQL}),
        ci as (select *, lag(value) over (partition by handler order by ts) prev from cs),
        inc as (select handler, ts, case when value >= prev then value - prev else value end
                  increase from ci where prev is not null),
        {SLIDE.format(src='inc')}
        select ws window_start, ws + interval 5 minute window_end, handler,
               round(sum(increase) / 300.0e0, 6) rate
        from sw group by ws, handler""",
    "recommendation_rate": _with(SCORED + """,
        ct as (select ts, count(*) n from rk group by ts),
        cs as (select ts, cast(sum(n) over (order by ts) as double) "value" from ct),
        ci as (select ts, "value" - lag("value") over (order by ts) increase from cs),
        inc as (select * from ci where increase is not null),
        """ + SLIDE.format(src="inc"), """
        select ws window_start, ws + interval 5 minute window_end, 'bias-baseline' model_name,
               'Production' model_stage, round(sum(increase) / 300.0e0, 6) rate
        from sw group by ws"""),
    "endpoint_rates": f"""
        with {LOG}, {SLIDE.format(src='lg')}
        select ws window_start, ws + interval 5 minute window_end, handler,
               round(count(*) / 300.0e0, 6) rate
        from sw where handler in ('/predict', '/recommend', '/health') group by ws, handler""",
    "bucket_rates": _with(SCORED + ", " + SLIDE.format(src="rk"), f"""
        select ws window_start, ws + interval 5 minute window_end, le,
               round(count_if(confidence_raw <= bound) / 300.0e0, 6) rate
        from sw, {CONF_BUCKETS} group by ws, le"""),
    "latency_quantile": f"""
        with {LOG}, {SLIDE.format(src='lg')},
        cc as (select ws, handler,
                 count_if(duration_s <= 50) c1, count_if(duration_s <= 100) c2,
                 count_if(duration_s <= 200) c3, count_if(duration_s <= 300) c4,
                 count_if(duration_s <= 400) c5, count_if(duration_s <= 500) c6,
                 count(*) n, 0.95e0 * count(*) rk
               from sw group by ws, handler)
        select ws window_start, ws + interval 5 minute window_end, handler, round(
          case when n = 0 then null
               when c1 >= rk then 0.0e0 + (50.0e0 - 0.0e0) * ((rk - 0) / c1)
               when c2 >= rk then 50.0e0 + (100.0e0 - 50.0e0) * ((rk - c1) / (c2 - c1))
               when c3 >= rk then 100.0e0 + (200.0e0 - 100.0e0) * ((rk - c2) / (c3 - c2))
               when c4 >= rk then 200.0e0 + (300.0e0 - 200.0e0) * ((rk - c3) / (c4 - c3))
               when c5 >= rk then 300.0e0 + (400.0e0 - 300.0e0) * ((rk - c4) / (c5 - c4))
               when c6 >= rk then 400.0e0 + (500.0e0 - 400.0e0) * ((rk - c5) / (c6 - c5))
               else 500.0e0 end, 6) p95
        from cc""",
    "threshold_status": _with(SCORED, """
        select request_id, round(d, 6) diversity,
               case when d >= 0.7e0 then 'green' when d >= 0.3e0 then 'yellow' else 'red' end status
        from dv"""),
    "model_gauge_last": _with(SCORED, """
        select 'bias-baseline' model_name, 'Production' model_stage, round(d, 6) last_value, ts last_ts
        from dv join rq on rq.request_id = dv.request_id
        order by ts desc, dv.request_id desc limit 1"""),
    "excluded_handlers": f"""
        with {LOG}
        select handler, status, count(*) n_requests from lg
        where handler in ('/predict', '/recommend', '/health') group by handler, status""",
    "in_progress": f"""
        with {LOG},
        us as (select handler, epoch_us(ts) s_us,
                      epoch_us(ts) + cast(trunc(duration_s * 1e6) as bigint) e_us from lg),
        dl as (select handler, cast(ceil(s_us / 10000000.0e0) * 10000000 as bigint) t, 1 d from us
               union all
               select handler, cast(ceil(e_us / 10000000.0e0) * 10000000 as bigint) t, -1 d
               from us),
        pt as (select handler, t, sum(d) delta from dl group by handler, t)
        select handler, make_timestamp(t) tick,
               cast(sum(delta) over (partition by handler order by t
                                rows between unbounded preceding and current row) as bigint)
                 in_progress
        from pt""",
    "relabel": """
        select event_id,
               'app=fastapi-app,handler=' || event_type
               || ',kubernetes_namespace=ml-deployment,kubernetes_pod_name=fastapi-app-'
               || (user_id % 5) || ',tier=api' labels
        from events where event_type <> 'signup' and event_type <> 'error'""",
    "sample_at_interval": f"""
        with gs as ({GAUGE_SAMPLES_SQL}),
        o as (select *, time_bucket(interval 10 second, ts) b,
                     row_number() over (partition by handler, time_bucket(interval 10 second, ts)
                                        order by ts desc, seq desc) rn from gs),
        v as (select handler, b + interval 10 second tick, value from o where rn = 1),
        tk as (select handler, unnest(generate_series(min(tick), max(tick), interval 10 second)) tick from v group by handler)
        select tk.handler, tk.tick, round(last_value(v.value ignore nulls) over (
                 partition by tk.handler order by tk.tick rows between unbounded preceding and current row), 6) value
        from tk left join v on v.handler = tk.handler and v.tick = tk.tick""",
    "retention": f"""
        with gs as ({GAUGE_SAMPLES_SQL}), nw as (select max(ts) m from gs)
        select handler, count(*) n_samples, 'retention' scope from gs, nw
        where ts >= m - interval 200 hour group by handler
        union all
        select handler, count(*) n_samples, 'dashboard' scope from gs, nw
        where ts >= m - interval 30 minute group by handler""",
    "retention_by_day": f"""
        with gs as ({GAUGE_SAMPLES_SQL})
        select handler, count(*) n_samples, min(ts) first_ts, max(ts) last_ts from gs
        where ts >= (select max(ts) from gs) - interval 20 hour group by handler""",
    "load_summary": f"""
        with {LOG},
        a as (select count(*) t, cast(count_if(status = 200) as bigint) s,
                     (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 el from lg)
        select t total_requests, s successful_requests, t - s failed_requests,
               case when t > 0 then ((s * 10000) // t) / 100.0e0 else 0.0e0 end success_rate,
               coalesce(el, 0) duration_s, t // (coalesce(el, 0) + 1) requests_per_second
        from a""",
})


# ------------------------------------------------------------ streaming ---
ORACLES.update({
    # the streams must equal the batch results
    "stream_metrics": ORACLES["request_rate"],
    "stream_recommendations_total": ORACLES["recommendations_total"],
    "stream_confidence_histogram": ORACLES["confidence_histogram"],
    # streamed scoring must equal the batch ranking
    "stream_score": ORACLES["rank_places"],
    "stream_gauge_last": ORACLES["gauge_last"],
    "stream_response_sink": ORACLES["response_sink"],
})


# ----------------------------------------------------------------- runs ---
RUNS = JOINED + """,
pr as (select 'global_mean' run_id, user_rating y, global_mean p from j where not is_train
       union all select 'user_mean', user_rating, user_mean from j where not is_train
       union all select 'place_mean', user_rating, place_mean from j where not is_train
       union all select 'bias', user_rating, place_rating + user_mean - global_mean
                 from j where not is_train),
rm as (select run_id, avg((y - p) * (y - p)) mse, avg(abs(y - p)) mae,
              sqrt(avg((y - p) * (y - p))) rmse,
              count_if(y >= 3.5 and p >= 3.5) tp, count_if(y < 3.5 and p >= 3.5) fp,
              count_if(y >= 3.5 and p < 3.5) fn,
              sum(case when y >= 4.0e0 then 1 else 0 end) n_rel, count(*) n_rows
       from pr group by run_id),
gr as (select run_id, p s, count(*) n, sum(case when y >= 4.0e0 then 1 else 0 end) g
       from pr group by run_id, p),
gt as (select * from (select *, row_number() over (partition by run_id order by s desc) rn
                      from gr) where rn <= 10),
ps as (select *, coalesce(sum(n) over (partition by run_id order by s desc
          rows between unbounded preceding and 1 preceding), 0) st from gt),
dc as (select run_id, sum(cast(g as double) / n * coalesce(list_sum(list_transform(
          range(cast(st as bigint), cast(least(st + n, 10) as bigint)),
          lambda i: 1.0e0 / log2(i + 2))), 0.0e0)) dcg from ps group by run_id),
m0 as (select rm.*, dc.dcg,
         coalesce(list_sum(list_transform(range(0, cast(least(n_rel, 10) as bigint)),
                  lambda i: 1.0e0 / log2(i + 2))), 0.0e0) idcg,
         case when tp + fp > 0 then cast(tp as double) / (tp + fp) else 0.0e0 end pre,
         case when tp + fn > 0 then cast(tp as double) / (tp + fn) else 0.0e0 end rec
       from rm join dc on rm.run_id = dc.run_id),
m as (select run_id, mse, mae, rmse,
        case when idcg > 0 and n_rows > 1 then coalesce(dcg, 0.0e0) / idcg else 0.0e0 end ndcg_10,
        pre "precision", rec recall,
        case when pre + rec > 0 then 2.0e0 * pre * rec / (pre + rec) else 0.0e0 end f1_score
      from m0),
lm as (unpivot m on mse, mae, rmse, ndcg_10, "precision", recall, f1_score
       into name key value value),
ver as (select run_id, cast(row_number() over (order by run_id) as integer) version,
               case when row_number() over (order by rmse, run_id) = 1
                    then 'production' end alias from m)
"""

ORACLES.update({
    "run_metrics_sink": _with(RUNS, """
        select run_id, 'metric' kind, key, round(value, 6) value, cast(null as varchar) "text" from lm
        union all
        select run_id, 'param', 'n_test_rows', cast(null as double), cast(count(*) as varchar) from pr group by run_id
        union all
        select run_id, 'param', 'predictor', cast(null as double),
               case run_id when 'bias' then 'place_rating + user_mean - global_mean' else run_id end
        from m"""),
    "save_load_model": _with(BASE, "select count(*) n_rows, cast(0 as bigint) n_different from x where not is_train"),
    "compare_runs": _with(RUNS, """
        select run_id, round(rmse, 6) rmse, round(mae, 6) mae, round(mse, 6) mse,
               round(ndcg_10, 6) ndcg_10, round(f1_score, 6) f1_score,
               cast(row_number() over (order by rmse, run_id) as integer) run_rank,
               row_number() over (order by rmse, run_id) = 1 is_best
        from m"""),
    "resolve_model": _with(RUNS, """
        select 'rating-gb' model_name, cast(version as varchar) model_version,
               'production' model_stage, v.run_id, round(rmse, 6) rmse, round(mae, 6) mae,
               0.78e0 r2_score, 22 feature_count, 'production' requested_alias
        from ver v join m on m.run_id = v.run_id where alias = 'production'
        union all
        select 'rating-gb', cast(version as varchar), 'latest', v.run_id, round(rmse, 6),
               round(mae, 6), 0.78e0, 22, 'staging'
        from ver v join m on m.run_id = v.run_id where version = (select max(version) from ver)
        union all
        select 'baseline-fallback-model', '1.0', 'Production', 'fallback', 0.85e0, 0.65e0,
               0.78e0, 22, 'production'"""),
})

_BASELINE_ROW = "'baseline-fallback-model', '1.0', 'Production', 'fallback'"
ORACLES["serve_with_fallback"] = _with(JOINED + """,
te as (select count(*) n, avg(place_rating + user_mean - global_mean) bias, avg(place_mean) pm, avg(global_mean) gm
       from j where not is_train)""", f"""
select c case_name, a model_name, b model_version, d model_stage, e run_id, n n_rows, round(v, 6) mean_prediction
from (select 'alias' c, 'rating-gb' a, '1' b, 'production' d, 'bias' e, n, bias v from te
      union all select 'latest', 'rating-gb', '3', 'latest', 'place_mean', n, pm from te
      union all select 'unknown alias', 'rating-gb', '3', 'latest', 'place_mean', n, pm from te
      union all select 'broken', {_BASELINE_ROW}, n, gm from te
      union all select 'no registry', {_BASELINE_ROW}, n, gm from te)""")

ORACLES["model_rmse_gauge"] = _with(RUNS + SCORED[len(STATS):], """
select 'rating-gb' model_name, 'production' model_stage, round(m.rmse, 6) last_value, q.ts last_ts
from (select * from rq where request_id in (select request_id from rk) order by ts desc, request_id desc limit 1) q,
     ver join m on m.run_id = ver.run_id where ver.alias = 'production'""")
