"""Queries over panels: ingest, lags, forecasts, metrics, folds, hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.calendar import calendar_columns
from gridloom.operators import forecast as fc
from gridloom.operators import global_forecast as gf
from gridloom.operators import hierarchy as hi
from gridloom.operators import kernels
from gridloom.operators import metrics as me
from gridloom.operators.lags import LagSpec, direct_targets, lag_features, next_step, recency_weights
from gridloom.operators.panel import as_of, collapse_duplicates, diagnostics, fill_gaps, known_future, regularity, temporal_blocks
from gridloom.plans.base import DAILY, ORDER_DAYS, SUPPLIER_WEEKS, daily, order_days, query, rounded, supplier_months, table


@query(f"with {DAILY} select series_id, ts, round(y, 6) as y, n from daily")
def daily_panel(spark, sf_dir):
    return rounded(daily(spark, sf_dir))


@query("""select event_type as series_id, date_trunc('hour', ts)::timestamp as ts, round(sum((abs(value) + 1) * value) / sum(abs(value) + 1), 6) as y,
round(sum((abs(value) + 1) * user_id) / sum(abs(value) + 1), 6) as user_id, round(sum(abs(value) + 1), 6) as w from events group by all""")
def weighted_collapse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("series_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"), F.col("value").alias("y"), F.col("user_id").cast("double").alias("user_id"), (F.abs("value") + 1).alias("w"))
    return rounded(collapse_duplicates(rows, "w", ["user_id"]))


@query(f"""with {ORDER_DAYS}, spine as (select series_id, unnest(generate_series(min(ts), max(ts), interval 1 day)) as ts from order_days group by series_id)
select s.series_id, s.ts, round(coalesce(o.y, 0), 4) as y from spine s left join order_days o on o.series_id = s.series_id and o.ts = s.ts""")
def gap_fill(spark, sf_dir):
    return rounded(fill_gaps(order_days(spark, sf_dir).select("series_id", "ts", "y")), 4)


@query(f"""with {ORDER_DAYS}, g as (select series_id, epoch(ts) - epoch(lag(ts) over (partition by series_id order by ts)) as gap from order_days)
select series_id, count(*) as n, count(*) filter (gap = 0) as duplicates, count(*) filter (gap <> 0 and gap <> 86400) as irregular from g group by series_id""")
def panel_regularity(spark, sf_dir):
    return regularity(order_days(spark, sf_dir), "D")


@query(f"""with {SUPPLIER_WEEKS}, z as (select *, sum((y <> 0)::int) over (partition by series_id order by ts) as nz from weeks),
runs as (select series_id, nz, sum((y = 0)::int) as run from z group by all), top as (select series_id, max(run) as longest_zero_run from runs group by series_id)
select w.series_id, count(*) as n, min(y) as min_y, max(y) as max_y, round(avg(y), 6) as mean_y, sum((y = 0)::int) as zero_count, round(sum((y = 0)::int) / count(*), 6) as zero_fraction,
round(case when sum((y <> 0)::int) > 0 then count(*) / sum((y <> 0)::int) end, 6) as mean_interval, any_value(longest_zero_run) as longest_zero_run from weeks w join top using (series_id) group by w.series_id""")
def panel_diagnostics(spark, sf_dir):
    return rounded(diagnostics(supplier_months(spark, sf_dir)))


@query(f"""with {DAILY}, e as (select event_type as series_id, ts, value from events)
select d.series_id, d.ts, round(e.value, 6) as value from daily d asof left join e on d.series_id = e.series_id and d.ts > e.ts""")
def as_of_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "value")
    return rounded(as_of(daily(spark, sf_dir).select("series_id", "ts"), e, "value").select("series_id", "ts", "value"))


@query(f"""with {DAILY}, f as (select series_id, ts + interval 30 day as ts, case when extract(day from ts) % 2 = 0 then y end as c from daily),
a as (select series_id, ts, y as c, false as f from daily union all select series_id, ts, c, true from f)
select series_id, ts, round(c, 6) as c from (select series_id, ts, f, last_value(c ignore nulls) over (partition by series_id order by ts) as c from a) where f""")
def known_future_join(spark, sf_dir):
    d = daily(spark, sf_dir)
    future = d.select("series_id", (F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.when(F.dayofmonth("ts") % 2 == 0, F.col("y")).alias("c"))
    return rounded(known_future(d.withColumnRenamed("y", "c"), future, ["c"]))


_LAGS = LagSpec(lags=(1, 2, 7), roll_mean=(3, 7), roll_std=(7,), roll_min=(3,), roll_max=(3,), partial_mean=(14,), ewm_percent=(30,), deltas=(1, 7), trends=(3,), calendar=("day_of_week", "day_of_month_sin", "is_month_end"), phase=5)


@query(f"""with {DAILY}, x as (select series_id, ts, y, row_number() over o - 1 as pos, lag(y, 1) over o as l1, lag(y, 2) over o as l2, lag(y, 3) over o as l3, lag(y, 7) over o as l7, lag(y, 8) over o as l8,
 avg(y) over (o rows between 3 preceding and 1 preceding) as m3, avg(y) over (o rows between 7 preceding and 1 preceding) as m7, stddev_pop(y) over (o rows between 7 preceding and 1 preceding) as s7,
 min(y) over (o rows between 3 preceding and 1 preceding) as n3, max(y) over (o rows between 3 preceding and 1 preceding) as x3, avg(y) over (o rows between 14 preceding and 1 preceding) as p14,
 list(y) over (o rows between unbounded preceding and 1 preceding) as h from daily window o as (partition by series_id order by ts))
select series_id, ts, round(y, 6) as y, round(l1, 6) as target_lag_1, round(l2, 6) as target_lag_2, round(l7, 6) as target_lag_7, round(m3, 6) as target_roll_mean_3, round(m7, 6) as target_roll_mean_7, round(s7, 6) as target_roll_std_7,
 round(n3, 6) as target_roll_min_3, round(x3, 6) as target_roll_max_3, round(p14, 6) as target_partial_roll_mean_14, round(list_reduce(h, lambda a, v: 0.3 * v + 0.7 * a), 6) as target_ewm_alpha_030,
 round(l1 - l2, 6) as target_delta_lag_1, round(l1 - l8, 6) as target_delta_lag_7, round((l1 - l3) / 2, 6) as target_roll_trend_3, (isodow(ts) - 1)::double as calendar_day_of_week,
 round(sin((extract(day from ts) - 1) * 2 * pi() / 31), 6) as calendar_day_of_month_sin, (extract(day from ts) >= extract(day from last_day(ts)) - 2)::int::double as calendar_is_month_end, pos::double as position, (pos % 5)::double as phase_5
from x where l8 is not null""")
def lag_feature_table(spark, sf_dir):
    return rounded(lag_features(daily(spark, sf_dir).select("series_id", "ts", "y"), _LAGS))


@query(f"""with {DAILY}, h as (select series_id, max(ts) + interval 1 day as ts, arg_max(y, ts) as l1, avg(y) filter (r <= 3) as m3 from (select *, row_number() over (partition by series_id order by ts desc) as r from daily) group by series_id)
select series_id, ts, round(l1, 6) as target_lag_1, round(m3, 6) as target_roll_mean_3 from h""")
def next_step_features(spark, sf_dir):
    d = daily(spark, sf_dir).select("series_id", "ts", "y")
    future = d.groupBy("series_id").agg((F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    return rounded(next_step(d, LagSpec(lags=(1,), roll_mean=(3,)), future))


@query(f"""with {DAILY}, w as (select series_id, ts, power(2, -(row_number() over (partition by series_id order by ts desc) - 1) / 10.0::double) as raw from daily)
select series_id, ts, round(raw / (select avg(raw) from w), 6) as weight from w""")
def recency_weight_table(spark, sf_dir):
    return rounded(recency_weights(daily(spark, sf_dir).select("series_id", "ts"), 10.0))


@query(f"""with {DAILY}, x as (select series_id, ts, lag(y) over o as l1, y as s1, lead(y) over o as s2, lead(y, 2) over o as s3 from daily window o as (partition by series_id order by ts))
select series_id, ts, round(l1, 6) as target_lag_1, u.step, round(u.label, 6) as label from (select series_id, ts, l1, unnest([{{step: 1, label: s1}}, {{step: 2, label: s2}}, {{step: 3, label: s3}}]) as u from x where l1 is not null) where u.label is not null""")
def direct_training_rows(spark, sf_dir):
    rows = lag_features(daily(spark, sf_dir).select("series_id", "ts", "y"), LagSpec(lags=(1,)))
    return rounded(direct_targets(rows, 3).drop("y"))


@query("""with d as (select distinct date_trunc('day', o_orderdate)::timestamp as ts from orders)
select ts, isodow(ts)::int - 1 as day_of_week, extract(month from ts)::int as month, extract(day from ts)::int as day_of_month, extract(doy from ts)::int as day_of_year, extract(hour from ts)::int as hour,
round(sin((isodow(ts) - 1) * 2 * pi() / 7), 6) as day_of_week_sin, round(cos((isodow(ts) - 1) * 2 * pi() / 7), 6) as day_of_week_cos, round(sin((extract(month from ts) - 1) * 2 * pi() / 12), 6) as month_sin, round(cos((extract(month from ts) - 1) * 2 * pi() / 12), 6) as month_cos,
round(sin((extract(day from ts) - 1) * 2 * pi() / 31), 6) as day_of_month_sin, round(cos((extract(day from ts) - 1) * 2 * pi() / 31), 6) as day_of_month_cos, (isodow(ts) >= 6)::int::double as is_weekend, (extract(day from ts) <= 3)::int::double as is_month_start,
(extract(day from ts) between 14 and 16)::int::double as is_month_middle, (extract(day from ts) >= extract(day from last_day(ts)) - 2)::int::double as is_month_end from d""")
def calendar_table(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz").alias("ts")).distinct()
    return rounded(d.withColumns(calendar_columns(F.col("ts"))))


_HIST = "hist as (select series_id, count(*) as n, max(ts) as last_ts, list(y order by ts) as y from daily group by series_id), steps as (select unnest(generate_series(1, 7))::int as s)"


@query(f"""with {DAILY}, {_HIST}, f as (
select series_id, last_ts, s, 'naive' as model, y[-1] as mean from hist, steps union all
select series_id, last_ts, s, 'seasonal_naive', y[n - least(7, n) + 1 + (s - 1) % least(7, n)] from hist, steps union all
select series_id, last_ts, s, 'window_average', list_avg(y[n - least(5, n) + 1 :]) from hist, steps union all
select series_id, last_ts, s, 'drift', y[-1] + s * (y[-1] - y[1]) / (n - 1) from hist, steps union all
select series_id, last_ts, s, 'seasonal_window_average', list_avg(list_transform(generate_series(1, 3), lambda k: y[n - k * 7 + 1 + (s - 1) % 7])) from hist, steps)
select series_id, last_ts + to_days(s) as ts, s as horizon, model, round(mean, 6) as mean from f""")
def baseline_forecasts(spark, sf_dir):
    hist = fc.histories(daily(spark, sf_dir))
    models = {"naive": fc.naive, "seasonal_naive": fc.seasonal_naive(7), "window_average": fc.window_average(5), "drift": fc.drift, "seasonal_window_average": fc.seasonal_window_average(7, 3)}
    return rounded(reduce(DataFrame.unionByName, (fc.predictions(hist, f, 7, m) for m, f in models.items())))


@query(f"""with {DAILY}, d as (select series_id, ts, y, row_number() over (partition by series_id order by ts) - 1 as i, count(*) over (partition by series_id) as n from daily),
pat as (select series_id, i % 7 as k, avg(y) as m from d group by all), p as (select series_id, k, m - avg(m) over (partition by series_id) as s from pat),
a as (select d.series_id, d.ts, d.i, d.n, y - s as v from d join p on p.series_id = d.series_id and p.k = d.i % 7),
h as (select series_id, max(ts) as last_ts, any_value(n) as n, list_reduce(list(v order by ts), lambda x, v: 0.3 * v + 0.7 * x) as level, regr_slope(v, i) as slope from a group by series_id)
select h.series_id, last_ts + to_days(s.s) as ts, s.s as horizon, 'theta' as model, round(level + 0.5 * slope * s.s + p.s, 6) as mean from h, (select unnest(generate_series(1, 7))::int as s) s join p on p.series_id = h.series_id and p.k = (h.n + s.s - 1) % 7""")
def theta_forecasts(spark, sf_dir):
    return rounded(fc.theta_forecast(daily(spark, sf_dir), 7, season=7))


@query(f"""with recursive {DAILY}, d as (select series_id, ts, y, row_number() over (partition by series_id order by ts) - 1 as i, count(*) over (partition by series_id) as n from daily),
pat as (select series_id, i % 7 as k, avg(y) as m from d group by all), p as (select series_id, k, m - avg(m) over (partition by series_id) as s from pat),
a as (select d.series_id, d.ts, d.i, d.n, y - s as v from d join p on p.series_id = d.series_id and p.k = d.i % 7),
h as (select series_id, max(ts) as last_ts, any_value(n) as n, regr_slope(v, i) as slope, avg(v) - regr_slope(v, i) * (any_value(n) - 1) / 2 as mid from a group by series_id),
e as (select series_id, alpha, i, v as level, 0.0::double as sse from a, (values (0.1::double), (0.3), (0.5), (0.8)) g(alpha) where i = 0 union all
select e.series_id, alpha, a.i, alpha * v + (1 - alpha) * level, sse + (v - 0.5 * (level + mid + slope * a.i)) ** 2 from e join a on a.series_id = e.series_id and a.i = e.i + 1 join h on h.series_id = e.series_id),
best as (select alpha from e join h using (series_id) where i = n - 1 group by alpha order by sum(sse) / sum(n - 1), alpha limit 1)
select h.series_id, last_ts + to_days(s.s) as ts, s.s as horizon, 'optimized_theta' as model, round(level + (1 - 1 / 1.5::double) * slope * s.s + p.s, 6) as mean
from h join e on e.series_id = h.series_id and e.i = h.n - 1 join best on best.alpha = e.alpha, (select unnest(generate_series(1, 7))::int as s) s join p on p.series_id = h.series_id and p.k = (h.n + s.s - 1) % 7""")
def optimized_theta_forecasts(spark, sf_dir):
    return rounded(fc.optimized_theta(daily(spark, sf_dir), 7, season=7))


def _ets_sql(src: str, grid: str, x: str = "") -> str:
    """CTEs up to ``ets{x}``: states by series, step and grid point (alpha, beta, gamma, phi) of the weekly recursion over ``src``."""
    return f"""grid{x} as ({grid}), ed{x} as (select series_id, ts, y, row_number() over (partition by series_id order by ts) - 1 as i, count(*) over (partition by series_id) as n from {src}),
ep{x} as (select series_id, k, m - avg(m) over (partition by series_id) as m from (select series_id, i % 7 as k, avg(y) as m from ed{x} group by all)), es{x} as (select series_id, list(m order by k) as p from ep{x} group by 1),
et{x} as (select a.series_id, sum((b.y - a.y) / 7) / 7 as t from ed{x} a join ed{x} b on b.series_id = a.series_id and b.i = a.i + 7 where a.i < 7 group by 1),
ets{x} as (select ed{x}.series_id, alpha, beta, gamma, phi, i, n, ts, y - p[1] as level, t as trend, p as s, 0.0::double as sse from ed{x} join es{x} using (series_id) join et{x} using (series_id), grid{x} where i = 0 union all
select series_id, alpha, beta, gamma, phi, i, n, ts, lv, beta * (lv - level) + (1 - beta) * phi * trend, list_transform(s, lambda x, j: case when j = i % 7 + 1 then gamma * (v - lv) + (1 - gamma) * x else x end), sse + (v - fit) ** 2
from (select d.series_id, alpha, beta, gamma, phi, d.i, d.n, d.ts, level, trend, s, sse, d.y as v, level + phi * trend + s[d.i % 7 + 1] as fit, alpha * (d.y - s[d.i % 7 + 1]) + (1 - alpha) * (level + phi * trend) as lv from ets{x} e join ed{x} d on d.series_id = e.series_id and d.i = e.i + 1))"""


@query(f"""with recursive {DAILY}, d as (select series_id, ts, y, row_number() over (partition by series_id order by ts) as i, count(*) over (partition by series_id) as n, lead(y) over (partition by series_id order by ts) - y as step from daily),
e as (select series_id, i, n, ts, y as level, step as trend from d where i = 1 union all
select d.series_id, d.i, d.n, d.ts, 0.3 * d.y + 0.7 * (e.level + 0.9 * e.trend), 0.1 * (0.3 * d.y + 0.7 * (e.level + 0.9 * e.trend) - e.level) + 0.9 * 0.9 * e.trend from e join d on d.series_id = e.series_id and d.i = e.i + 1)
select series_id, ts + to_days(s) as ts, s as horizon, 'ets' as model, round(level + 0.9 * (1 - power(0.9, s)) / (1 - 0.9) * trend, 5) as mean from e, (select unnest(generate_series(1, 7))::int as s) where i = n""")
def damped_trend_forecasts(spark, sf_dir):
    return rounded(fc.ets_forecast(daily(spark, sf_dir), 7, alpha=0.3, beta=0.1, phi=0.9), 5)


_ETS_POINT = "select 0.3::double as alpha, 0.1::double as beta, 0.1::double as gamma, 1.0::double as phi"
_WEEK = "(select unnest(generate_series(1, 7))::int as s)"


@query(f"""with recursive {DAILY}, {_ets_sql("daily", _ETS_POINT)} select series_id, ts + to_days(w.s) as ts, w.s as horizon, 'ets' as model, round(level + w.s * trend + ets.s[(n + w.s - 1) % 7 + 1], 6) as mean from ets, {_WEEK} w where i = n - 1""")
def seasonal_ets_forecasts(spark, sf_dir):
    return rounded(fc.ets_forecast(daily(spark, sf_dir), 7, season=7))


@query(f"""with recursive {DAILY}, {_ets_sql("daily", "select alpha, beta, 0.1::double as gamma, 1.0::double as phi from (values (0.2::double), (0.5)) a(alpha), (values (0.0::double), (0.1)) b(beta)")},
best as (select alpha, beta from ets where i = n - 1 group by all order by sum(sse) / sum(n - 1), alpha, beta limit 1)
select series_id, ts + to_days(w.s) as ts, w.s as horizon, 'auto_ets' as model, round(level + w.s * trend + ets.s[(n + w.s - 1) % 7 + 1], 6) as mean from ets join best using (alpha, beta), {_WEEK} w where i = n - 1""")
def auto_ets_forecasts(spark, sf_dir):
    return rounded(fc.auto_ets(daily(spark, sf_dir), 7, season=7, alphas=(0.2, 0.5), betas=(0.0, 0.1), gammas=(0.1,), phis=(1.0,)))


_CROSTON = """d as (select *, row_number() over (partition by series_id order by ts) as i, count(*) over (partition by series_id) as n from weeks),
c as (select series_id, i, n, case when y > 0 then y end as d, case when y > 0 then 1.0::double else 0.0::double end as g, case when y > 0 then 0 else 1 end as e, 0.2 * (y > 0)::int::double as p from d where i = 1 union all
select d.series_id, d.i, d.n, case when d.y > 0 then (case when c.d is null then d.y else c.d + 0.2 * (d.y - c.d) end) else c.d end, case when d.y > 0 then (case when c.d is null then c.e + 1 else c.g + 0.2 * (c.e + 1 - c.g) end) else c.g end,
case when d.y > 0 then 0 else c.e + 1 end, c.p + 0.2 * ((d.y > 0)::int - c.p) from c join d on d.series_id = c.series_id and d.i = c.i + 1)"""


@query(f"with recursive {SUPPLIER_WEEKS}, {_CROSTON} select series_id, round(d / g, 6) as croston, round(d / g * 0.9, 6) as sba from c where i = n")
def intermittent_levels(spark, sf_dir):
    h = fc.histories(supplier_months(spark, sf_dir))
    return rounded(h.select("series_id", fc.croston_level(F.col("y"), 0.2).alias("croston"), fc.sba_level(F.col("y"), 0.2).alias("sba")))


@query(f"""with recursive {SUPPLIER_WEEKS}, d as (select *, row_number() over (partition by series_id order by ts) as i, count(*) over (partition by series_id) as n, first_value(y) over (partition by series_id order by (y > 0)::int desc, ts) as f from weeks),
c as (select series_id, i, n, case when y > 0 then f + 0.2 * (y - f) else f end as d, 0.2 * (y > 0)::int::double as p from d where i = 1 union all
select d.series_id, d.i, d.n, case when d.y > 0 then c.d + 0.2 * (d.y - c.d) else c.d end, c.p + 0.2 * ((d.y > 0)::int - c.p) from c join d on d.series_id = c.series_id and d.i = c.i + 1)
select series_id, round(d * p, 6) as tsb from c where i = n""")
def tsb_levels(spark, sf_dir):
    return rounded(fc.histories(supplier_months(spark, sf_dir)).select("series_id", fc.tsb_level(F.col("y"), 0.2, 0.2).alias("tsb")))


@query(f"""with recursive {SUPPLIER_WEEKS}, d as (select *, row_number() over (partition by series_id order by ts) as i, count(*) over (partition by series_id) as n from weeks),
part as (select series_id, 'all' as part, i, n as m, y from d union all select series_id, 'train', i, greatest(n - 8, 1), y from d where i <= greatest(n - 8, 1)),
src as (select series_id, part, 'row' as kind, i, m, y, first_value(y) over (partition by series_id, part order by (y > 0)::int desc, i) as f from part union all
select series_id, part, 'block', b + 1, (any_value(m) + 6) // 7, sum(y), 0 from (select *, (i - 1) // 7 as b from part) group by series_id, part, b),
c as (select series_id, part, kind, i, m, case when y > 0 then y end as d, (y > 0)::int::double as g, (y <= 0)::int as e, f + 0.2 * (y > 0)::int * (y - f) as t, 0.2 * (y > 0)::int::double as p from src where i = 1 union all
select s.series_id, s.part, s.kind, s.i, s.m, case when s.y > 0 then (case when c.d is null then s.y else c.d + 0.2 * (s.y - c.d) end) else c.d end, case when s.y > 0 then (case when c.d is null then c.e + 1 else c.g + 0.2 * (c.e + 1 - c.g) end) else c.g end,
case when s.y > 0 then 0 else c.e + 1 end, c.t + 0.2 * (s.y > 0)::int * (s.y - c.t), c.p + 0.2 * ((s.y > 0)::int - c.p) from c join src s on s.series_id = c.series_id and s.part = c.part and s.kind = c.kind and s.i = c.i + 1),
l as (select series_id, part, u.k, u.method, u.level from (select series_id, part, unnest(case when kind = 'row' then [{{k: 0, method: 'croston', level: d / nullif(g, 0)}}, {{k: 1, method: 'sba', level: d / nullif(g, 0) * 0.9}}, {{k: 2, method: 'tsb', level: t * p}}] else [{{k: 3, method: 'adida', level: d / nullif(g, 0) / 7}}] end) as u from c where i = m)),
tail as (select series_id, i, y from d where i > greatest(n - 8, 1)),
w as (select l.series_id, k, method, coalesce(round(case when coalesce(sum(abs(y)), 0) > 0 then sum(abs(y - level)) / sum(abs(y)) else 0 end, 9), 'infinity'::double) as loss from l left join tail on tail.series_id = l.series_id where part = 'train' group by all),
b as (select * from w qualify row_number() over (partition by series_id order by loss, k) = 1), z as (select series_id, max(y) = 0 and min(y) = 0 as empty from d group by 1)
select b.series_id, case when empty then 'zero' else b.method end as method, round(case when empty then 0 else loss end, 6) as loss, round(case when empty then 0 else greatest(coalesce(level, 0), 0) end, 6) as level
from b join l on l.series_id = b.series_id and l.k = b.k and l.part = 'all' join z on z.series_id = b.series_id""")
def intermittent_selection(spark, sf_dir):
    return rounded(fc.intermittent_selector(supplier_months(spark, sf_dir), 8))


@query(f"""with recursive {DAILY}, d as (select series_id, ts, y, row_number() over (partition by series_id order by ts) as i, count(*) over (partition by series_id) as n from daily),
k as (select series_id, i, n, ts, y as level, 1.0::double as var from d where i = 1 union all
select d.series_id, d.i, d.n, d.ts, k.level + (k.var + 0.1) / (k.var + 1.1) * (d.y - k.level), (1 - (k.var + 0.1) / (k.var + 1.1)) * (k.var + 0.1) from k join d on d.series_id = k.series_id and d.i = k.i + 1)
select series_id, ts + to_days(s) as ts, s as horizon, 'kalman_level' as model, round(level, 5) as mean, round(var + s * 0.1 + 1, 5) as variance, round(level - 1.959963984540054 * sqrt(var + s * 0.1 + 1), 5) as lower, round(level + 1.959963984540054 * sqrt(var + s * 0.1 + 1), 5) as upper
from k, (select unnest(generate_series(1, 7))::int as s) where i = n""")
def kalman_forecasts(spark, sf_dir):
    return rounded(fc.kalman_level_forecast(daily(spark, sf_dir), 7), 5)


@query(f"""with recursive {DAILY}, d as (select series_id, ts, y, row_number() over (partition by series_id order by ts) as i, count(*) over (partition by series_id) as n, lead(y) over (partition by series_id order by ts) - y as step from daily),
k as (select series_id, i, n, ts, y as level, step as trend, 1.0::double as p00, 0.0::double as p01, 0.0::double as p10, 1.0::double as p11 from d where i = 1 union all
select series_id, i, n, ts, pl + a / (a + 1) * e, trend + c / (a + 1) * e, (1 - a / (a + 1)) * a, (1 - a / (a + 1)) * b, c - c / (a + 1) * a, q - c / (a + 1) * b
from (select d.series_id, d.i, d.n, d.ts, k.trend, k.level + k.trend as pl, d.y - (k.level + k.trend) as e, p00 + p01 + p10 + p11 + 0.1 as a, p01 + p11 as b, p10 + p11 as c, p11 + 0.01 as q from k join d on d.series_id = k.series_id and d.i = k.i + 1)),
f as (select series_id, ts + to_days(s) as ts, s, level + s * trend as mean, greatest(p00 + s * (p01 + p10) + s * s * p11 + s * 0.1 + s * s * 0.01, 0) + 1 as v from k, (select unnest(generate_series(1, 7))::int as s) where i = n)
select series_id, ts, s as horizon, 'kalman_trend' as model, round(mean, 4) as mean, round(v, 4) as variance, round(mean - 1.959963984540054 * sqrt(v), 4) as lower, round(mean + 1.959963984540054 * sqrt(v), 4) as upper from f""")
def kalman_trend_forecasts(spark, sf_dir):
    return rounded(fc.kalman_trend_forecast(daily(spark, sf_dir), 7), 4)


@query(f"""with recursive {DAILY}, d as (select series_id, y, row_number() over (partition by series_id order by ts) as i, count(*) over (partition by series_id) as n from daily),
k as (select series_id, i, n, y as level, 1.0::double as var, 0.0::double as prior from d where i = 1 union all
select d.series_id, d.i, d.n, k.level + (k.var + 0.1) / (k.var + 1.1) * (d.y - k.level), (1 - (k.var + 0.1) / (k.var + 1.1)) * (k.var + 0.1), k.var + 0.1 from k join d on d.series_id = k.series_id and d.i = k.i + 1),
b as (select series_id, i, level, prior from k where i = n union all select k.series_id, k.i, k.level + k.var / b.prior * (b.level - k.level), k.prior from b join k on k.series_id = b.series_id and k.i = b.i - 1)
select series_id, (i - 1)::int as step, round(level, 6) as level from b""")
def kalman_smoothed_levels(spark, sf_dir):
    hist = fc.histories(daily(spark, sf_dir)).select("series_id", F.posexplode(fc.kalman_smoothed(F.col("y"), 0.1, 1.0)).alias("step", "level"))
    return rounded(hist)


@query(f"""with recursive {DAILY}, d as (select series_id, ts, y, row_number() over (partition by series_id order by ts) as i, count(*) over (partition by series_id) as n from daily),
g as (select * from (values (0, 0.01::double, 1.0::double), (1, 0.1, 1.0), (2, 1.0, 1.0), (3, 1.0, 0.1)) t(g, q, r)),
k as (select series_id, g, q, r, i, n, ts, y as level, r as var from d, g where i = 1 union all
select d.series_id, g, q, r, d.i, d.n, d.ts, k.level + (k.var + q) / (k.var + q + r) * (d.y - k.level), (1 - (k.var + q) / (k.var + q + r)) * (k.var + q) from k join d on d.series_id = k.series_id and d.i = k.i + 1),
best as (select k.g from k join d on d.series_id = k.series_id and d.i > k.i where k.i = greatest(k.n - 7, 1) group by k.g order by sum((d.y - k.level) ** 2), k.g limit 1),
f as (select series_id, ts + to_days(s) as ts, s as horizon, level as mean, var + s * q + r as v from k join best using (g), (select unnest(generate_series(1, 7))::int as s) where i = n)
select series_id, ts, horizon, 'kalman_level' as model, round(mean, 6) as mean, round(v, 6) as variance, round(mean - 1.959963984540054 * sqrt(v), 6) as lower, round(mean + 1.959963984540054 * sqrt(v), 6) as upper from f""")
def auto_kalman_forecasts(spark, sf_dir):
    return rounded(fc.auto_kalman(daily(spark, sf_dir), 7))


@query(f"""with {DAILY}, d as (select *, row_number() over o - 1 as i, avg(y) over (o rows between 7 preceding and 7 following) as trend from daily window o as (partition by series_id order by ts)),
p as (select series_id, i % 7 as k, avg(y - trend) as m from d group by all), q as (select series_id, k, m - avg(m) over (partition by series_id) as s from p)
select d.series_id, d.i as step, round(y, 6) as y, round(trend, 6) as trend, round(s, 6) as seasonal, round(y - trend - s, 6) as remainder from d join q on q.series_id = d.series_id and q.k = d.i % 7""")
def season_trend_parts(spark, sf_dir):
    d = fc.decompose(daily(spark, sf_dir), [7])
    rows = d.select("series_id", F.posexplode(F.arrays_zip("y", "trend", F.col("seasonal_7").alias("seasonal"), "remainder")).alias("step", "p"))
    return rounded(rows.select("series_id", F.col("step").cast("long").alias("step"), "p.*"))


@query(f"""with {DAILY}, d as (select series_id, y, row_number() over o - 1 as i, avg(y) over (o rows between 10 preceding and 10 following) as trend from daily window o as (partition by series_id order by ts)),
p as (select series_id, i % 7 as k, avg(y - trend) as m from d group by all), a as (select series_id, k, m - avg(m) over (partition by series_id) as s from p), e as (select d.*, a.s as s7 from d join a on a.series_id = d.series_id and a.k = d.i % 7),
q as (select series_id, i % 10 as k, avg(y - trend - s7) as m from e group by all), b as (select series_id, k, m - avg(m) over (partition by series_id) as s from q)
select e.series_id, e.i::int as step, round(y, 6) as y, round(trend, 6) as trend, round(s7, 6) as seasonal_7, round(b.s, 6) as seasonal_10, round(y - trend - s7 - b.s, 6) as remainder from e join b on b.series_id = e.series_id and b.k = e.i % 10""")
def multi_season_parts(spark, sf_dir):
    d = fc.decompose(daily(spark, sf_dir), [7, 10])
    return rounded(d.select("series_id", F.posexplode(F.arrays_zip("y", "trend", "seasonal_7", "seasonal_10", "remainder")).alias("step", "p")).select("series_id", "step", "p.*"))


@query(f"""with {DAILY}, d as (select series_id, ts, y, row_number() over o - 1 as i, count(*) over (partition by series_id) as n, avg(y) over (o rows between 7 preceding and 7 following) as trend from daily window o as (partition by series_id order by ts)),
p as (select series_id, i % 7 as k, avg(y - trend) as m from d group by all), q as (select series_id, k, m - avg(m) over (partition by series_id) as s from p),
h as (select series_id, any_value(n) as n, max(ts) as last_ts, max(trend) filter (i = n - 1) as t1, max(trend) filter (i = n - 4) as t0 from d group by series_id)
select h.series_id, last_ts + to_days(s.s) as ts, s.s as horizon, 'stl' as model, round(t1 + s.s * (t1 - t0) / 3 + q.s, 6) as mean from h, (select unnest(generate_series(1, 7))::int as s) s join q on q.series_id = h.series_id and q.k = (h.n + s.s - 1) % 7""")
def decomposed_forecasts(spark, sf_dir):
    return rounded(fc.decomposed_forecast(daily(spark, sf_dir), 7, 7))


_BACKTEST = f"""{DAILY}, t as (select *, row_number() over (partition by series_id order by ts desc) as back from daily), tr as (select * from t where back > 7), te as (select * from t where back <= 7),
hist as (select series_id, count(*) as n, max(ts) as last_ts, list(y order by ts) as h from tr group by series_id),
s as (select te.series_id, te.ts, te.y, hist.h[hist.n - 7 + 1 + (8 - back - 1) % 7] as mean from te join hist using (series_id))"""


def _scored(spark, sf_dir):
    train, test = fc.split_tail(daily(spark, sf_dir), 7)
    made = fc.predictions(fc.histories(train), fc.seasonal_naive(7), 7, "seasonal_naive")
    return train, me.align(made, test)


@query(f"""with {_BACKTEST} select series_id, count(*) as n, round(avg(abs(mean - y)), 6) as mae, round(sqrt(avg((mean - y) ** 2)), 6) as rmse, round(sqrt(avg((mean - y) ** 2)) / greatest(avg(abs(y)), 1e-12), 6) as nrmse,
round(sum(abs(mean - y)) / sum(abs(y)), 6) as wape, round(avg(case when abs(mean) + abs(y) > 0 then 2 * abs(mean - y) / (abs(mean) + abs(y)) end), 6) as smape, round(avg(mean - y), 6) as bias from s group by series_id""")
def point_metrics(spark, sf_dir):
    return rounded(me.point_metrics(_scored(spark, sf_dir)[1], ["series_id"]))


@query(f"""with {_BACKTEST}, v as (select series_id, abs(mean - lag(mean) over (partition by series_id order by ts)) as d from s) select series_id, round(coalesce(avg(d), 0), 6) as volatility from v group by series_id""")
def prediction_volatility(spark, sf_dir):
    return rounded(me.volatility(_scored(spark, sf_dir)[1], ["ts"], ["series_id"]))


@query(f"""with {DAILY}, d as (select series_id, y - lag(y, 7) over (partition by series_id order by ts) as d from daily) select series_id, round(avg(abs(d)), 6) as mase_scale, round(avg(d * d), 4) as rmsse_scale from d group by series_id""")
def seasonal_scales(spark, sf_dir):
    d = daily(spark, sf_dir)
    return me.seasonal_scale(d, 7, ["series_id"]).select("series_id", F.round("scale", 6).alias("mase_scale")).join(me.seasonal_scale(d, 7, ["series_id"], True).select("series_id", F.round("scale", 4).alias("rmsse_scale")), "series_id")


@query(f"""with {_BACKTEST}, sc as (select series_id, avg(d * d) as scale from (select series_id, y - lag(y, 1) over (partition by series_id order by ts) as d from tr) group by series_id), w as (select series_id, sum(n) as weight from daily group by series_id),
r as (select s.series_id, sqrt(avg((mean - y) ** 2) / any_value(scale)) as rmsse from s join sc using (series_id) group by s.series_id)
select series_id, round(rmsse, 6) as rmsse, round(weight / sum(weight) over (), 6) as weight, round(rmsse * weight / sum(weight) over (), 6) as contribution from r join w using (series_id)""")
def weighted_rmsse(spark, sf_dir):
    train, scored = _scored(spark, sf_dir)
    weights = daily(spark, sf_dir).groupBy("series_id").agg(F.sum("n").cast("double").alias("weight"))
    return rounded(me.wrmsse(scored, train, weights))


@query(f"""with {_BACKTEST} select series_id, round(avg(greatest(0.9 * (y - mean), -0.1 * (y - mean))), 6) as pinball from s group by series_id""")
def pinball_by_series(spark, sf_dir):
    return rounded(me.pinball_loss(_scored(spark, sf_dir)[1], 0.9, ["series_id"]))


@query(f"""with {_BACKTEST}, r as (select abs(y - mean) as r, row_number() over (order by abs(y - mean)) as k, count(*) over () as n from s), q as (select r from r where k = least(ceil((n + 1) * 0.9)::int, n))
select series_id, round(avg((y between mean - q.r and mean + q.r)::int), 6) as coverage, round(avg(2 * q.r), 6) as width from s, q group by series_id""")
def conformal_coverage(spark, sf_dir):
    scored = _scored(spark, sf_dir)[1]
    return rounded(me.interval_metrics(me.with_intervals(scored, me.conformal_quantile(scored, 0.1)), ["series_id"]))


@query(f"""with {_BACKTEST}, n as (select count(*) as n, max(0) as z from s), o as (select *, (ts::date - (select min(ts) from s)::date) + 1 as horizon from s),
w as (select *, avg(abs(mean - y)) over (order by horizon, series_id, ts rows between ceil(0.3 * n)::int - 1 preceding and current row) as mae, sqrt(avg((mean - y) ** 2) over (order by horizon, series_id, ts rows between ceil(0.3 * n)::int - 1 preceding and current row)) as rmse from o, n)
select horizon::int as horizon, round(arg_max(mae, (series_id, ts)), 6) as mae, round(arg_max(rmse, (series_id, ts)), 6) as rmse from w group by horizon""".replace("rows between ceil(0.3 * n)::int - 1 preceding", "rows between 10 preceding"))
def horizon_metrics(spark, sf_dir):
    scored = _scored(spark, sf_dir)[1]
    first = F.min("ts").over(Window.partitionBy(F.lit(0)))
    return rounded(me.horizon_rollup(scored.withColumn("horizon", F.datediff("ts", first) + 1), 0.3))


@query(f"""with {DAILY}, days as (select ts, row_number() over (order by ts) - 1 as t from (select distinct ts from daily)), p as (select d.*, t from daily d join days using (ts)),
f as (select unnest([{{fold: 0, e: 16}}, {{fold: 1, e: 20}}, {{fold: 2, e: 23}}]) as f), ff as (select f.fold as fold, f.e as e from f), mx as (select max(t) + 1 as n from days),
ends as (select row_number() over (order by e) - 1 as fold, e from (select unnest(generate_series(9, n - 7, 7)) as e from mx)),
tr as (select fold, e, series_id, list(y order by t) as h, count(*) as n from p join ends on t < e group by all),
s as (select tr.fold, p.series_id, p.y, h[tr.n - 7 + 1 + (p.t - e) % 7] as mean from tr join p on p.series_id = tr.series_id and p.t >= e and p.t < e + 7)
select fold::int as fold, round(avg(abs(mean - y)), 6) as mae, round(sqrt(avg((mean - y) ** 2)), 6) as rmse, round(sum(abs(mean - y)) / sum(abs(y)), 6) as wape from s group by fold""")
def rolling_origin_backtest(spark, sf_dir):
    d = daily(spark, sf_dir).select("series_id", "ts", "y")
    folds = fc.rolling_origins(d, 7, 7, 9)
    return rounded(fc.backtest(d, folds, lambda p: fc.predictions(fc.histories(p), fc.seasonal_naive(7), 7, "seasonal_naive")))


def _bank_sql(src: str, x: str) -> str:
    """CTEs up to ``bank{x}``: the predictions of every model of the bank over the panel ``src``, a week ahead."""
    return f"""bh{x} as (select series_id, count(*) as n, max(ts) as last_ts, list(y order by ts) as y from {src} group by 1), bw{x} as (select unnest(generate_series(1, 7))::int as s),
bt{x} as (select series_id, regr_slope(y, i) as slope from (select *, row_number() over (partition by series_id order by ts) as i from {src}) group by 1), {_ets_sql(src, _ETS_POINT, x)},
bk{x} as (select series_id, i, y as level, 1.0::double as var from ed{x} where i = 0 union all
select d.series_id, d.i, k.level + (k.var + 0.1) / (k.var + 1.1) * (d.y - k.level), (1 - (k.var + 0.1) / (k.var + 1.1)) * (k.var + 0.1) from bk{x} k join ed{x} d on d.series_id = k.series_id and d.i = k.i + 1),
bf{x} as (select series_id, last_ts, s, 'naive' as model, y[-1] as mean from bh{x}, bw{x} union all
select series_id, last_ts, s, 'drift', y[-1] + s * (y[-1] - y[1]) / greatest(n - 1, 1) from bh{x}, bw{x} union all
select series_id, last_ts, s, 'seasonal_naive', y[n - least(7, n) + 1 + (s - 1) % least(7, n)] from bh{x}, bw{x} union all
select series_id, last_ts, s, 'window_average', list_avg(y[n - least(7, n) + 1 :]) from bh{x}, bw{x} union all
select series_id, last_ts, s, 'seasonal_window_average', list_avg(list_transform(generate_series(1, greatest(least(3, n // least(7, n)), 1)), lambda k: y[n - k * least(7, n) + 1 + (s - 1) % least(7, n)])) from bh{x}, bw{x} union all
select series_id, last_ts, s, 'mean', list_avg(y) from bh{x}, bw{x} union all
select series_id, last_ts, s, 'theta', list_reduce(y, lambda a, v: 0.3 * v + 0.7 * a) + 0.5 * slope * s from bh{x} join bt{x} using (series_id), bw{x} union all
select h.series_id, last_ts, w.s, 'ets', level + w.s * trend + e.s[(h.n + w.s - 1) % 7 + 1] from bh{x} h join ets{x} e on e.series_id = h.series_id and e.i = h.n - 1, bw{x} w union all
select h.series_id, last_ts, w.s, 'kalman_level', level from bh{x} h join bk{x} k on k.series_id = h.series_id and k.i = h.n - 1, bw{x} w),
bank{x} as (select series_id, last_ts + to_days(s) as ts, s as horizon, model, mean from bf{x})"""


_TAIL = f"""{DAILY}, back as (select series_id, ts, y, row_number() over (partition by series_id order by ts desc) as b from daily), tr as (select series_id, ts, y from back where b > 7), te as (select series_id, ts, y from back where b <= 7), {_bank_sql("tr", "1")}"""
_SERIES_SCORES = "scores as (select series_id, model, sum(abs(mean - y)) / sum(abs(y)) as wape from bank1 join te using (series_id, ts) group by all)"


@query(f"""with recursive {_TAIL} select model, round(sum(abs(mean - y)) / sum(abs(y)), 6) as wape, round(sqrt(avg((mean - y) ** 2)), 6) as rmse from bank1 join te using (series_id, ts) group by model""")
def bank_tail_scores(spark, sf_dir):
    return rounded(fc.bank_scores(daily(spark, sf_dir), 7, 7))


@query(f"""with recursive {_TAIL}, {_bank_sql("daily", "2")}, {_SERIES_SCORES}, best as (select series_id, model from scores where not isnan(wape) qualify row_number() over (partition by series_id order by wape, model) = 1)
select series_id, model, ts, horizon, round(mean, 6) as mean from bank2 join best using (series_id, model)""")
def best_of_bank_forecasts(spark, sf_dir):
    return rounded(fc.best_of_bank(daily(spark, sf_dir), 7, 7))


@query(f"""with recursive {_TAIL}, {_bank_sql("daily", "2")}, {_SERIES_SCORES}, r as (select *, row_number() over (partition by series_id order by wape, model) as rank from scores where not isnan(wape)),
h as (select series_id, min(wape) filter (rank = 2) is not null and min(wape) <= min(wape) filter (rank = 2) * 0.95 as hard from r group by 1),
w as (select series_id, model, case when hard then (rank = 1)::int::double when rank <= 3 then 1 / greatest(wape, 1e-6) else 0 end as weight from r join h using (series_id))
select series_id, ts, horizon, round(sum(weight * mean) / sum(weight), 6) as mean, 'ensemble' as model from bank2 join w using (series_id, model) where weight > 0 group by series_id, ts, horizon""")
def gated_ensemble(spark, sf_dir):
    d = daily(spark, sf_dir)
    scores = fc.bank_scores(d, 7, 7, by=("series_id", "model"))
    return rounded(fc.weighted_ensemble(fc.bank(d, 7, 7), fc.gate_weights(scores, top_k=3, hard_gain=0.05), ("series_id", "model")))


@query(f"""with {_BACKTEST} select series_id, round(sum(y - mean) / (count(*) + 5), 6) as correction from s group by series_id""")
def shrunk_residuals(spark, sf_dir):
    return rounded(fc.residual_corrections(_scored(spark, sf_dir)[1], ["series_id"], 5.0))


@query(f"""with {DAILY}, b as (select *, (row_number() over (partition by series_id order by ts) - 1) // 5 as block from daily) select series_id, block::bigint as block, min(ts) as ts, round(sum(y), 6) as y from b group by all""")
def temporal_block_sums(spark, sf_dir):
    return rounded(temporal_blocks(daily(spark, sf_dir), 5))


@query(f"""with recursive {DAILY}, z as (select series_id, ts, y, y - lag(y) over (partition by series_id order by ts) as z from daily), x as (select *, lag(z) over (partition by series_id order by ts) as x1, lag(z, 2) over (partition by series_id order by ts) as x2 from z),
m as (select series_id, avg(z) as mz, avg(x1) as m1, avg(x2) as m2, covar_pop(x1, x1) as s11, covar_pop(x2, x2) as s22, covar_pop(x1, x2) as s12, covar_pop(z, x1) as c1, covar_pop(z, x2) as c2 from x where x2 is not null group by 1),
b as (select series_id, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) as b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) as b2, mz, m1, m2 from m),
f as (select series_id, arg_max(ts, ts) as ts, 0 as s, arg_max(z, ts) as z, arg_max(x1, ts) as before, arg_max(y, ts) as level from x group by 1 union all
select series_id, ts, s + 1, n, z, level + n from (select f.*, mz - b1 * m1 - b2 * m2 + b1 * z + b2 * before as n from f join b using (series_id) where s < 7))
select series_id, ts + to_days(s) as ts, s as horizon, 'arima' as model, round(level, 3) as mean from f where s > 0""")
def arima_forecasts(spark, sf_dir):
    return rounded(kernels.arima_forecast(daily(spark, sf_dir), 7), 3)


@query()
def auto_arima_forecasts(spark, sf_dir):
    return rounded(kernels.auto_arima_forecast(daily(spark, sf_dir), 7))


@query()
def piecewise_forecasts(spark, sf_dir):
    return rounded(kernels.piecewise_forecast(daily(spark, sf_dir), 7))


@query()
def network_forecasts(spark, sf_dir):
    return rounded(kernels.window_network(daily(spark, sf_dir), 7))


@query()
def reference_paths(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("position", F.unix_date(F.to_date("ts")).cast("double"))
    mean = d.agg(F.avg("y")).first()[0]
    rows = d.select("series_id", "position", F.col("y").alias("target"))
    ref = [(float(i), mean * (0.5 + 0.1 * i)) for i in range(11)]
    return rounded(reduce(DataFrame.unionByName, (kernels.axis_paths(rows, ref, m, kernels.PathSpec(scale=mean / 10) if m in ("viterbi", "posterior") else kernels.AxisSpec(signal_noise=(mean / 10) ** 2), axis0=5.0).withColumn("method", F.lit(m)) for m in ("viterbi", "posterior", "ekf", "ukf", "smoother"))))


_TREE = "tree as (select 'c' || c.c_custkey as node, 'n' || c.c_nationkey as parent from customer c union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'r' || r_regionkey, 'all' from region)"


def _tree(spark, sf_dir) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("child"), key("n", "c_nationkey").alias("parent"))
    n = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
    return c.union(n).union(table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("child"), F.lit("all").alias("parent")))


@query(f"""with recursive {_TREE}, up as (select node as ancestor, node from tree union all select t.parent, u.node from up u join tree t on t.node = u.ancestor),
b as (select 'c' || o_custkey as node, o_orderstatus as ts, sum(o_totalprice) as mean from orders group by all)
select up.ancestor as node, b.ts, round(sum(b.mean), 2) as mean from b join up on up.node = b.node group by all""")
def hierarchy_bottom_up(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    bottom = o.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), F.col("o_orderstatus").alias("ts")).agg(F.sum("o_totalprice").alias("mean"))
    return rounded(hi.bottom_up(bottom, hi.closure(_tree(spark, sf_dir))), 2)


@query("""with t as (select c_nationkey as g, 'c' || c_custkey as node, greatest(c_acctbal, 0) as w from customer), n as (select c_nationkey as g, sum(o_totalprice) as total from orders join customer on c_custkey = o_custkey group by all)
select t.g, t.node, round(total * (case when sum(w) over (partition by t.g) > 0 then w / sum(w) over (partition by t.g) else 1 / count(*) over (partition by t.g) end), 4) as mean from t join n on n.g = t.g""")
def hierarchy_top_down(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    total = table(spark, sf_dir, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("g")).agg(F.sum("o_totalprice").alias("mean"))
    history = c.select(F.col("c_nationkey").alias("g"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_acctbal").alias("weight"))
    return rounded(hi.top_down(total, history, group=["g"]).select("g", "node", "mean"), 4)


@query(f"""with {DAILY} select series_id, ts, round(y * 1000 / sum(y) over (partition by ts), 6) as mean from daily""")
def proportional_totals(spark, sf_dir):
    d = daily(spark, sf_dir).select("series_id", "ts", F.col("y").alias("mean"), F.lit(1000.0).alias("target"))
    return rounded(hi.proportional_total(d, "target").drop("target"))


@query("""select coalesce(nullif(concat_ws('+', case when grouping(o_orderpriority) = 0 then 'o_orderpriority' end, case when grouping(o_orderstatus) = 0 then 'o_orderstatus' end), ''), 'total') as level,
coalesce(concat_ws('+', o_orderpriority, o_orderstatus), '') as member, ts, round(sum(y), 2) as y from (select o_orderpriority, o_orderstatus, extract(year from o_orderdate)::int as ts, o_totalprice as y from orders)
group by grouping sets ((o_orderstatus, ts), (o_orderpriority, ts), (o_orderpriority, o_orderstatus, ts), (ts))""")
def level_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("ts"), F.col("o_totalprice").alias("y"))
    return rounded(hi.level_totals(rows, [["o_orderstatus"], ["o_orderpriority"], ["o_orderpriority", "o_orderstatus"], []]), 2)


def _reconciled_sql(nation: float, region: float, total: float) -> str:
    """The projection of a three-level tree, level by level, with a variance for each level."""
    return f"""with n as (select 'n' || n_nationkey as node, 'r' || n_regionkey as parent, n_nationkey * 37 % 101 + 0.5::double as y, {nation}::double as w from nation),
c as (select parent, sum(y) as m, sum(w) as v from n group by 1), r0 as (select 'r' || r_regionkey as node, r_regionkey * 53 % 211 + 100.0::double as y, {region}::double as w, m, v from region left join c on parent = 'r' || r_regionkey),
r as (select node, m, v, case when v is null then y else (y / w + m / v) / (1 / w + 1 / v) end as mr, case when v is null then w else 1 / (1 / w + 1 / v) end as vr from r0),
a as (select (1234.5::double / {total} + sum(mr) / sum(vr)) / (1 / {total}::double + 1 / sum(vr)) as f, sum(mr) as m, sum(vr) as v from r), rf as (select node, mr + vr / a.v * (a.f - a.m) as f, r.m, r.v from r, a)
select 1 as ts, node, round(f, 4) as mean from (select 'all' as node, f from a union all select node, f from rf union all select n.node, y + w / rf.v * (rf.f - rf.m) from n join rf on rf.node = n.parent)"""


def _regions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The closure of nations, regions and the world, and a base forecast of each node."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = n.select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent")).union(r.select(key("r", "r_regionkey"), F.lit("all")))
    base = n.select(key("n", "n_nationkey").alias("node"), (F.col("n_nationkey") * 37 % 101 + 0.5).cast("double").alias("mean"))
    base = base.union(r.select(key("r", "r_regionkey"), (F.col("r_regionkey") * 53 % 211 + 100).cast("double"))).union(spark.range(1).select(F.lit("all"), F.lit(1234.5)))
    return hi.closure(edges), base.withColumn("ts", F.lit(1))


@query(_reconciled_sql(1, 1, 1))
def least_squares_reconciliation(spark, sf_dir):
    tree, base = _regions(spark, sf_dir)
    return rounded(hi.reconcile(base, tree), 4)


@query(_reconciled_sql(1, 2.5, 4))
def weighted_reconciliation(spark, sf_dir):
    tree, base = _regions(spark, sf_dir)
    variances = base.select("node", F.when(F.col("node") == "all", 4.0).when(F.col("node").startswith("r"), 2.5).otherwise(1.0).alias("variance"))
    return rounded(hi.reconcile(base, tree, variances), 4)


@query()
def recursive_boost_forecasts(spark, sf_dir):
    return rounded(gf.lag_boost_forecast(daily(spark, sf_dir), 7, gf.LagSpec(lags=(1, 2, 7), roll_mean=(3,), roll_std=(7,), ewm_percent=(30,), deltas=(1,), trends=(3,), calendar=("day_of_week", "day_of_month_sin"))))


@query()
def seasonal_delta_forecasts(spark, sf_dir):
    return rounded(gf.lag_boost_forecast(daily(spark, sf_dir), 7, mode="seasonal_delta"))


@query()
def direct_boost_forecasts(spark, sf_dir):
    return rounded(gf.direct_boost_forecast(daily(spark, sf_dir), 3))


@query()
def quantile_forecasts(spark, sf_dir):
    made = gf.quantile_boost_forecast(daily(spark, sf_dir), 2, boost=gf.BoostSpec(rounds=3, rate=0.3, depth=2, min_leaf=5, bins=8))
    return made.withColumn("quantiles", F.transform("quantiles", lambda v: F.round(v, 6)))


@query(f"""with {DAILY}, b as (select *, row_number() over (partition by series_id order by ts desc) as back from daily), tr as (select series_id, avg(y) as mean from b where back between 8 and 14 group by 1),
s0 as (select series_id, ts, y, (8 - back)::int as horizon, (date_diff('day', date '1970-01-01', ts::date) % 7)::int as phase, mean from b join tr using (series_id) where back <= 7),
c1 as (select horizon, sum(y - mean) / (count(*) + 10) as c from s0 group by 1), t1 as (select s0.*, c from s0 join c1 using (horizon)), k1 as (select (avg((y - mean - c) ** 2) <= avg((y - mean) ** 2))::int as k from t1),
s1 as (select series_id, ts, y, horizon, phase, mean + k * c as mean from t1, k1),
c2 as (select phase, sum(y - mean) / (count(*) + 10) as c from s1 group by 1), t2 as (select s1.*, c from s1 join c2 using (phase)), k2 as (select (avg((y - mean - c) ** 2) <= avg((y - mean) ** 2))::int as k from t2),
s2 as (select series_id, ts, y, horizon, phase, mean + k * c as mean from t2, k2),
c3 as (select series_id, sum(y - mean) / (count(*) + 10) as c from s2 group by 1), t3 as (select s2.*, c from s2 join c3 using (series_id)), k3 as (select (avg((y - mean - c) ** 2) <= avg((y - mean) ** 2))::int as k from t3),
f as (select series_id, max(ts) as last_ts, avg(y) filter (back <= 7) as mean from b group by 1), g as (select series_id, last_ts + to_days(s) as ts, s as horizon, mean, (date_diff('day', date '1970-01-01', (last_ts + to_days(s))::date) % 7)::int as phase from f, (select unnest(generate_series(1, 7))::int as s))
select g.series_id, g.ts, g.horizon, 'corrected' as model, round(g.mean + k1.k * coalesce(c1.c, 0) + k2.k * coalesce(c2.c, 0) + k3.k * coalesce(c3.c, 0), 6) as mean from g left join c1 on c1.horizon = g.horizon left join c2 on c2.phase = g.phase left join c3 on c3.series_id = g.series_id, k1, k2, k3""")
def corrected_forecasts(spark, sf_dir):
    return rounded(gf.corrected_forecast(daily(spark, sf_dir), 7, lambda p, h: fc.predictions(fc.histories(p), fc.window_average(7), h, "w")))


@query()
def hybrid_forecasts(spark, sf_dir):
    return rounded(gf.hybrid_forecast(daily(spark, sf_dir), 7))


@query()
def auto_forecasts(spark, sf_dir):
    return rounded(gf.auto_forecast(daily(spark, sf_dir).select("series_id", "ts", "y"), 5, boost=gf.BoostSpec(rounds=4, rate=0.5, depth=2, min_leaf=5, bins=16)))


@query("""with h as (select n_nationkey::varchar as name, date '2024-01-10' + n_nationkey as day from nation), o as (select unnest([-1, 0, 1, 2])::int as o) select name, o as "offset", (day + o)::date as day from h, o""")
def holiday_table(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.date_add(F.lit("2024-01-10").cast("date"), F.col("n_nationkey")).alias("day"))
    return gf.holiday_windows(n, 1, 2)


@query(f"""with {DAILY}, s as (select series_id, avg(y) as m, greatest(stddev_pop(y), 1e-6) as s from daily group by 1) select series_id, ts, round((y - m) / s, 6) as y from daily join s using (series_id)""")
def standardised_panel(spark, sf_dir):
    return rounded(gf.scaled(daily(spark, sf_dir).select("series_id", "ts", "y"))[0])
