"""Queries over tables: scores, encoders, predicates and splits, ranking, space, graphs, scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import geo_ids, predicates as pr
from gridloom.operators import boost as bo
from gridloom.operators import encoders as en
from gridloom.operators import folds as fo
from gridloom.operators import graph as gr
from gridloom.operators import kernels
from gridloom.operators import metrics as me
from gridloom.operators import ranking as ra
from gridloom.operators import spatial as sp
from gridloom.plans.base import DAILY, LABELLED, PART_EDGES, POINTS, daily, part_edges, query, rounded, scored_labels, supplier_points, table

# --- scores ----------------------------------------------------------------------------------------------------------


@query(f"""with {LABELLED}, a as (select y, (rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double) as r from labelled),
p as (select y, score, sum(y) over (order by score desc, id rows unbounded preceding) / row_number() over (order by score desc, id) as pr from labelled), c as (select least(floor(p * 10), 9) as bin, count(*) as n, avg(p) as mp, avg(y) as sh from labelled group by 1),
k as (select greatest(least(p, 1 - 1e-15), 1e-15) as a, greatest(least(1 - p, 1 - 1e-15), 1e-15) as b, y, p from labelled)
select round((select (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2) / (count(*) filter (y = 1) * count(*) filter (y = 0)) from a), 6) as auc,
round((select sum(pr) filter (y = 1) / sum(y) from p), 6) as average_precision, round((select sum(n * abs(sh - mp)) / sum(n) from c), 6) as ece, round((select avg((p - y) ** 2) from k), 6) as brier, round((select avg(-ln(case when y = 1 then a else b end / (a + b))) from k), 6) as log_loss""")
def classification_metrics(spark, sf_dir):
    rows = scored_labels(spark, sf_dir)
    parts = [me.roc_auc(rows), me.average_precision(rows), me.ece(rows), me.brier(rows), me.log_loss(rows)]
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return rounded(out.drop("_k"))


@query(f"""with {LABELLED}, c as (select lang, score as s, count(*) filter (y = 1) as p, count(*) filter (y = 0) as n from labelled group by all), b as (select *, coalesce(sum(n) over (partition by lang order by s rows between unbounded preceding and 1 preceding), 0) as below from c)
select lang, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) as auc from b group by lang having sum(p) > 0 and sum(n) > 0""")
def auc_by_language(spark, sf_dir):
    return rounded(me.roc_auc(scored_labels(spark, sf_dir), ["lang"]).where(F.col("auc").isNotNull()))


@query(f"""with {LABELLED} select least(floor(p * 10), 9)::int as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as share from labelled group by 1""")
def calibration_table(spark, sf_dir):
    return rounded(me.calibration_bins(scored_labels(spark, sf_dir)))


_RANKED = """g as (select o_custkey as q, o_orderkey as id, o_totalprice as score, case o_orderstatus when 'F' then 2 when 'P' then 1 else 0 end as y from orders),
r as (select *, row_number() over (partition by q order by score desc, id) as pos, row_number() over (partition by q order by y desc, id) as ideal from g)"""


def _ranked(spark, sf_dir):
    y = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), y.alias("y"))


@query(f"""with {_RANKED} select q, round(case when sum(case when ideal <= 5 then (2 ** y - 1) / log2(ideal + 1) else 0 end) > 0 then sum(case when pos <= 5 then (2 ** y - 1) / log2(pos + 1) else 0 end) / sum(case when ideal <= 5 then (2 ** y - 1) / log2(ideal + 1) else 0 end) else 0 end, 6) as ndcg from r group by q""")
def ndcg_by_customer(spark, sf_dir):
    return rounded(me.ndcg(_ranked(spark, sf_dir), "q", "y", "score", "id", 5))


@query(f"""with {_RANKED}, h as (select *, (y > 0)::int as b, sum((y > 0)::int) over (partition by q order by pos) as hits from r)
select q, round(coalesce(sum(hits / pos) filter (b = 1) / nullif(sum(b), 0), 0), 6) as average_precision, round(coalesce(1 / min(pos) filter (b = 1), 0), 6) as reciprocal_rank,
round(case when sum(b) > 0 then coalesce(sum(b) filter (pos <= 3), 0) / nullif(sum(b), 0) end, 6) as recall_at_k, case when sum(b) > 0 then (coalesce(sum(b) filter (pos <= 3), 0) > 0)::int::double end as hit_at_k from h group by q""")
def rank_hits_by_customer(spark, sf_dir):
    return rounded(me.rank_hits(_ranked(spark, sf_dir), "q", "y", "score", "id", 3))


@query("""with e as (select extract(hour from ts) as h, event_type as sample, avg(value) as mean from events group by all), s as (select sample, stddev_pop(mean) as s from e group by sample) select round(avg(s), 6) as jitter from s""")
def jitter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(me.jitter_volatility(e.groupBy(F.hour("ts").alias("h"), F.col("event_type").alias("sample")).agg(F.avg("value").alias("mean"))))


@query("""with q as (select event_type, [quantile_cont(value, 0.5), avg(value), quantile_cont(value, 0.9)] as q from events group by all) select event_type, round(q[1], 6) as a, round(greatest(q[1], q[2]), 6) as b, round(greatest(q[1], q[2], q[3]), 6) as c from q""")
def repaired_quantiles(spark, sf_dir):
    q = table(spark, sf_dir, "events").groupBy("event_type").agg(F.array(F.percentile("value", 0.5), F.avg("value"), F.percentile("value", 0.9)).alias("q"))
    fixed = q.withColumn("f", me.non_crossing(F.col("q")))
    return rounded(fixed.select("event_type", F.get("f", F.lit(0)).alias("a"), F.get("f", F.lit(1)).alias("b"), F.get("f", F.lit(2)).alias("c")))


@query("""with p as (select c_custkey as id, c_nationkey % 4 as o, (c_custkey % 7 + 1)::double as a, (c_custkey % 5 + 1)::double as b, (c_custkey % 3 + 1)::double as c, (c_custkey % 2 + 1)::double as d from customer),
n as (select id, o, a / (a + b + c + d) as p1, (a + b) / (a + b + c + d) as p2, (a + b + c) / (a + b + c + d) as p3 from p)
select id, round(((p1 - (o < 1)::int) ** 2 + (p2 - (o < 2)::int) ** 2 + (p3 - (o < 3)::int) ** 2) / 3, 6) as rps from n""")
def rank_probability_scores(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = [(F.col("c_custkey") % k + 1).cast("double") for k in (7, 5, 3, 2)]
    total = raw[0] + raw[1] + raw[2] + raw[3]
    return rounded(c.select(F.col("c_custkey").alias("id"), me.rank_probability_score(F.array(*(v / total for v in raw)), F.col("c_nationkey") % 4).alias("rps")))


@query(f"""with {LABELLED} select lang, count(*) as n, round(sqrt(avg((p - y) ** 2)), 6) as rmse, round(avg(abs(p - y)), 6) as mae from labelled group by lang""")
def errors_by_group(spark, sf_dir):
    return rounded(me.group_errors(scored_labels(spark, sf_dir).withColumn("mean", F.col("p")), "lang"))


# --- ranking and portfolios --------------------------------------------------------------------------------------------

_ASSETS = """a as (select extract(month from ts)::int as m, user_id as id, avg(value) as score, max(value) / 100 as ret from events group by all)"""


def _assets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.month("ts").alias("m"), F.col("user_id").alias("id")).agg(F.avg("value").alias("score"), (F.max("value") / 100).alias("ret"))


@query(f"""with {_ASSETS} select m, id, floor((row_number() over (partition by m order by score, id) - 1) * 5 / count(*) over (partition by m))::int as bucket from a""")
def rank_bucket_table(spark, sf_dir):
    return ra.rank_buckets(_assets(spark, sf_dir), "score", 5, "id", ["m"]).select("m", "id", "bucket")


@query(f"""with {_ASSETS}, b as (select floor((row_number() over (order by score, id) - 1) * 5 / count(*) over ())::int as p, floor((row_number() over (order by ret, id) - 1) * 5 / count(*) over ())::int as c from a)
select count(*) as n, round(avg((p = c)::int), 6) as exact, round(avg((abs(p - c) <= 1)::int), 6) as within_one, round(avg((p = c)::int) filter (p in (0, 4)), 6) as extreme from b""")
def rank_hit_rates(spark, sf_dir):
    return rounded(ra.hit_rates(_buckets(spark, sf_dir), 5))


def _buckets(spark, sf_dir):
    rows = ra.rank_buckets(_assets(spark, sf_dir), "score", 5, "id", out="predicted")
    return ra.rank_buckets(rows, "ret", 5, "id", out="actual")


@query(f"""with {_ASSETS}, b as (select floor((row_number() over (order by score, id) - 1) * 5 / count(*) over ())::int as p, floor((row_number() over (order by ret, id) - 1) * 5 / count(*) over ())::int as c from a), n as (select count(*) as n from b),
s as (select p, c from (select unnest(generate_series(0, 4))::int as p), (select unnest(generate_series(0, 4))::int as c)), k as (select s.p, s.c, count(b.p) + 1 as k from s left join b on b.p = s.p and b.c = s.c group by all)
select p as predicted, c as actual, round(n / (n + 100) * k / sum(k) over (partition by p) + (1 - n / (n + 100)) / 5, 6) as probability from k, n""")
def rank_calibration(spark, sf_dir):
    return rounded(ra.calibrated_probabilities(_buckets(spark, sf_dir), 5))


@query(f"""with {_ASSETS}, k as (select *, greatest(count(*) over (partition by m) // 5, 1) as k, row_number() over (partition by m order by score, id) as lo, row_number() over (partition by m order by score desc, id) as hi from a),
w as (select m, ret, case when hi <= k then 0.5::double / k when lo <= k then -0.5::double / k else 0 end as w from k)
select m, count(*) filter (w > 0) as longs, count(*) filter (w < 0) as shorts, round(sum(abs(w)), 6) as gross, round(sum(w), 6) as net, round(coalesce(sum(w * ret) filter (w > 0), 0), 6) as long_return, round(coalesce(sum(w * ret) filter (w < 0), 0), 6) as short_return, round(sum(w * ret), 6) as net_return from w group by m""")
def extreme_portfolio(spark, sf_dir):
    out = ra.portfolio_summary(ra.extreme_decisions(_assets(spark, sf_dir), "score", "id", ["m"]), ["m"])
    return rounded(out).withColumn("net", F.col("net") + 0.0)


# --- encoders --------------------------------------------------------------------------------------------------------


@query("""with m as (select avg(o_totalprice) as mu from orders) select o_orderpriority, round((sum(o_totalprice) + 10 * any_value(mu)) / (count(*) + 10), 4) as encoded from orders, m group by o_orderpriority""")
def smoothed_target_mean(spark, sf_dir):
    return rounded(en.target_mean(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), 4)


@query("""with m as (select avg(c_acctbal) as mu from customer) select c_custkey, round((sum(c_acctbal) over (partition by c_mktsegment) - c_acctbal + 10 * mu) / (count(*) over (partition by c_mktsegment) - 1 + 10), 4) as encoded from customer, m""")
def leave_one_out_mean(spark, sf_dir):
    return rounded(en.leave_one_out(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal").select("c_custkey", "encoded"), 4)


@query("""with t as (select c_nationkey, n_regionkey, c_acctbal from customer join nation on n_nationkey = c_nationkey where c_nationkey < 15), m as (select avg(c_acctbal) as mu from t),
a as (select c_nationkey, (sum(c_acctbal) + 10 * any_value(mu)) / (count(*) + 10) as e from t, m group by 1), b as (select n_regionkey, (sum(c_acctbal) + 10 * any_value(mu)) / (count(*) + 10) as e from t, m group by 1)
select n.n_nationkey as c_nationkey, round(coalesce(a.e, b.e, (select mu from m)), 4) as encoded from nation n left join a on a.c_nationkey = n.n_nationkey left join b on b.n_regionkey = n.n_regionkey""")
def context_mean(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    train = table(spark, sf_dir, "customer").where(F.col("c_nationkey") < 15).join(nation, "c_nationkey")
    return rounded(en.context_target_mean(nation, train, ["c_nationkey", "n_regionkey"], "c_acctbal").select("c_nationkey", "encoded"), 4)


@query("""select o_orderkey, (o_orderstatus in ('F'))::int::double as "o_orderstatus_in_F", (o_orderstatus in ('O'))::int::double as "o_orderstatus_in_O", (o_orderstatus in ('P'))::int::double as "o_orderstatus_in_P",
coalesce(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) - 1, -1)::double as priority_code from orders""")
def category_indicators(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", *(c.alias(f"o_orderstatus_{k}") for k, c in en.subset_indicators(F.col("o_orderstatus"), ["F", "O", "P"]).items()), en.ordinal(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).alias("priority_code"))
    return rows


@query("""select c_mktsegment, count(*) * 1.0::double as n, round((select count(*) from customer) / ((select count(distinct c_mktsegment) from customer) * count(*)), 6) as weight from customer group by 1""")
def class_weight_table(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return rounded(en.class_weights(c, "c_mktsegment").join(c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).cast("double").alias("n")), "c_mktsegment"))


@query("""with f as (select o_custkey, min(o_orderkey) as o from orders group by 1) select o_custkey, row_number() over (order by o, o_custkey) - 1 as code from f""")
def id_dictionary(spark, sf_dir):
    return en.dictionary(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", F.col("code").cast("long").alias("code"))


@query("""with s as (select l_orderkey, list_sort(list_distinct(list(l_partkey))) as ids from lineitem group by 1) select l_orderkey, len(ids)::int as n, ids[1] as first_id, list_has_any(ids, [1, 5, 9, 40, 77]) as meets from s""")
def id_sets(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(geo_ids.sorted_ids(F.collect_list("l_partkey")).alias("ids"))
    return s.select("l_orderkey", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first_id"), pr.set_left(F.col("ids"), [1, 5, 9, 40, 77]).alias("meets"))


# --- predicates, splits, trees -------------------------------------------------------------------------------------------


@query("""with l as (select l_orderkey, l_linenumber, l_quantity as x, l_extendedprice / 1000 as y, l_partkey as p from lineitem)
select l_orderkey, l_linenumber, x <= 25 as axis, x - y <= 3 as diagonal, sqrt((x - 25) ** 2 + (y - 30) ** 2) <= 12 as radial, (x % 12 >= 9 or x % 12 <= 2) as periodic, p in (1, 5, 9) as dense,
round(least(least(abs(x % 12 - 9), 12 - abs(x % 12 - 9)), least(abs(x % 12 - 2), 12 - abs(x % 12 - 2))) * (case when x % 12 >= 9 or x % 12 <= 2 then -1 else 1 end), 6) as gap,
round(case when abs(x - 25) >= 10 then (x <= 25)::int else 0.5 * (1 - (x - 25) ** 2 / 100) ** 2 + (1 - (1 - (x - 25) ** 2 / 100) ** 2) * (x <= 25)::int end, 6) as soft from l""")
def row_predicates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    return rounded(li.select(
        "l_orderkey", "l_linenumber", pr.axis_left(x, 25).alias("axis"), pr.diagonal_left(x, y, (1, -1), 3).alias("diagonal"), pr.radial_left(x, y, (25, 30), 12).alias("radial"), pr.periodic_left(x, 12, 9, 2).alias("periodic"),
        pr.dense_id_left(F.col("l_partkey").cast("double"), [1, 5, 9]).alias("dense"), pr.periodic_distance(x, 12, 9, 2).alias("gap"), pr.soft_left(pr.axis_distance(x, 25), 10, "bisquare").alias("soft"),
    ))


@query("""with t as (select count(*) as n, sum(l_extendedprice / 1000) as s from lineitem), v as (select l_quantity as v, count(*) as n, sum(l_extendedprice / 1000) as s from lineitem group by 1),
r as (select (v + lead(v) over (order by v)) / 2 as threshold, sum(n) over (order by v) as n_left, sum(s) over (order by v) as s_left from v)
select threshold, n_left, round(s_left ** 2 / n_left + (s - s_left) ** 2 / (n - n_left) - s ** 2 / n, 2) as gain from r, t where threshold is not null""")
def exact_split_gains(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice") / 1000)
    return rounded(bo.axis_split_gains(li, "l_quantity", "p"), 2)


@query("""with o as (select o_orderkey, o_totalprice / 1000 as y from orders), s as (select distinct l_orderkey, l_suppkey as id from lineitem), t as (select count(*) as n, sum(y) as s from o where o_orderkey in (select l_orderkey from s)),
e as (select id, count(*) as n, sum(y) as s from s join o on o_orderkey = l_orderkey group by id) select e.id, e.n, round(e.s ** 2 / e.n + (t.s - e.s) ** 2 / nullif(t.n - e.n, 0) - t.s ** 2 / t.n, 2) as gain from e, t""")
def set_split_table(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids"))
    rows = table(spark, sf_dir, "orders").join(sets, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("y", F.col("o_totalprice") / 1000)
    return rounded(bo.set_split_gains(rows, "ids", "y"), 2)


@query("""with b as (select case when l_quantity > 40 then 5 when l_quantity > 30 then 4 when l_quantity > 20 then 3 when l_quantity > 10 then 2 else 1 end as bin, l_discount as y from lineitem)
select 1 as node, 0 as feature, bin::smallint as bin, count(*) as n, round(count(*)::double, 6) as w, round(sum(y), 4) as wy, round(sum(y * y), 4) as wyy from b group by bin""")
def split_histograms(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("_node"), F.lit(1.0).alias("_w"), F.col("l_discount").alias("_g"), bo.bin_column(F.col("l_quantity"), [10.0, 20.0, 30.0, 40.0]).alias("_b0"))
    return rounded(bo.node_histograms(rows, ["l_quantity"]), 4)


@query("""with v as (select l_returnflag, l_extendedprice as v, sum(l_quantity) as w from lineitem group by all), c as (select *, sum(w) over (partition by l_returnflag order by v) as c, sum(w) over (partition by l_returnflag) as t from v)
select l_returnflag, min(v) as quantile from c where c >= 0.75 * t group by 1""")
def weighted_quantiles(spark, sf_dir):
    return bo.weighted_quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 0.75, ["l_returnflag"])


@query("""with x as (select l_orderkey, l_linenumber, l_linenumber::double as y, l_discount * 10 as m from lineitem)
select l_orderkey, l_linenumber, round(exp(m) - y * m, 6) as value, round(exp(m) - y, 6) as gradient, round(exp(m), 6) as curvature, round(-y * exp(-0.5 * m) + exp(0.5 * m), 6) as tweedie_gradient, round((exp(m) - y) / (1 + exp(m)), 6) as nb_gradient, round(1 / (1 + exp(-m)) - 1, 6) as hurdle_gradient from x""")
def count_objectives(spark, sf_dir):
    y, m = F.col("l_linenumber").cast("double"), F.col("l_discount") * 10
    o = bo.objectives()
    v, g, h = o["poisson"](y, m)
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("value"), g.alias("gradient"), h.alias("curvature"), o["tweedie"](y, m)[1].alias("tweedie_gradient"), o["negative_binomial"](y, m)[1].alias("nb_gradient"), o["hurdle"](y, m)[1].alias("hurdle_gradient")))


@query(f"""with {_RANKED}, p as (select a.q, a.id as i, b.id as j, 1 / (1 + exp((a.score - b.score) / 100000)) as rho from g a join g b on a.q = b.q and a.y > b.y), u as (select i as id, rho as g, rho * (1 - rho) as h from p union all select j, -rho, rho * (1 - rho) from p)
select id, round(sum(g), 6) as grad, round(sum(h), 6) as hess from u group by id""")
def pairwise_gradients(spark, sf_dir):
    rows = _ranked(spark, sf_dir).withColumn("m", F.col("score") / 100000)
    return rounded(bo.pair_gradients(rows, "q", "y", "m", "id"))


def _boost_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("line"), (F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_returnflag") == "R").cast("double").alias("returned"), "l_returnflag")


_BOOST = bo.BoostSpec(rounds=5, rate=0.3, depth=3, bins=16)


@query()
def boosted_regression(spark, sf_dir):
    rows = _boost_rows(spark, sf_dir)
    model = bo.fit(rows, ["l_quantity", "l_discount", "l_tax", "line"], "price", _BOOST)
    return rounded(model.transform(rows).select("l_orderkey", "l_linenumber", "prediction"), 4)


@query()
def boosted_probabilities(spark, sf_dir):
    rows = _boost_rows(spark, sf_dir)
    model = bo.fit(rows, ["l_quantity", "l_discount", "price"], "returned", bo.BoostSpec(rounds=3, rate=0.3, depth=2, bins=8, loss="logistic"))
    return rounded(model.transform(rows).select("l_orderkey", "l_linenumber", "prediction"), 4)


@query()
def boosted_classes(spark, sf_dir):
    rows = _boost_rows(spark, sf_dir)
    model = bo.fit_classes(rows, ["l_quantity", "price"], "l_returnflag", bo.BoostSpec(rounds=2, rate=0.3, depth=2, bins=8))
    return model.transform(rows).select("l_orderkey", "l_linenumber", "prediction")


@query()
def boosted_ranking(spark, sf_dir):
    rows = _ranked(spark, sf_dir).withColumn("price", F.col("score") / 100000).withColumn("key", (F.col("id") % 97).cast("double"))
    model = bo.fit_ranker(rows, ["price", "key"], "y", "q", "id", bo.BoostSpec(rounds=2, depth=2, bins=8, min_leaf=5))
    return rounded(model.transform(rows).select("id", "prediction"))


# --- space -----------------------------------------------------------------------------------------------------------


@query(f"""with {POINTS}, m as (select avg(value) as m from points), z as (select id, x, y, value - m as z from points, m), p as (select 1 / greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 1e-12) as w, a.z as za, b.z as zb from z a join z b on a.id < b.id)
select round((select count(*) from z) / (2 * sum(w)) * 2 * sum(w * za * zb) / (select sum(z * z) from z), 6) as morans_i from p""")
def spatial_autocorrelation(spark, sf_dir):
    return rounded(me.morans_i(supplier_points(spark, sf_dir)))


@query(f"""with {POINTS}, m as (select avg(value) as m from points), z as (select id, x, y, value - m as z from points, m), p as (select a.z as za, b.z as zb from z a join z b on a.id < b.id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2)
select round((select count(*) from z) / (2 * count(*)) * 2 * sum(za * zb) / (select sum(z * z) from z), 6) as morans_i from p""")
def radius_autocorrelation(spark, sf_dir):
    return rounded(me.morans_i(supplier_points(spark, sf_dir), radius=2.0))


@query(f"""with {POINTS}, p as (select sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d, 0.5 * (a.value - b.value) ** 2 as g from points a join points b on a.id < b.id), q as (select d, g, least(floor(d / (4.0 / 8)), 7)::int as bin from p where d <= 4)
select bin, round(bin * 0.5, 6) as lag_min, round((bin + 1) * 0.5, 6) as lag_max, round(avg(d), 6) as mean_distance, round(avg(g), 2) as semivariance, count(*) as pairs from q group by bin""")
def variogram(spark, sf_dir):
    v = sp.empirical_variogram(supplier_points(spark, sf_dir), 8, 4.0)
    return rounded(v).withColumn("semivariance", F.round("semivariance", 2))


_ZONES = "zones as (select * from (values (0, 'west', 1.5::double, 0, 4, 0, 20), (1, 'mid', 1.0::double, 4, 7, 0, 20), (2, 'east', 0.5::double, 7, 10, 0, 6)) z(ord, id, priority, x0, x1, y0, y1))"


def _zones(spark):
    boxes = [(0, "west", 1.5, 0, 4, 0, 20), (1, "mid", 1.0, 4, 7, 0, 20), (2, "east", 0.5, 7, 10, 0, 6)]
    each = []
    for o, name, p, x0, x1, y0, y1 in boxes:
        ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))))
        each.append(F.struct(F.lit(o).alias("ord"), F.lit(name).alias("id"), F.lit(p).alias("priority"), ring.alias("ring")))
    return spark.range(1).select(F.explode(F.array(*each)).alias("z")).select("z.*")


@query(f"""with {POINTS}, {_ZONES}, h as (select p.id, arg_min(z.id, z.ord) as zone_id, arg_min(z.priority, z.ord) as priority from points p join zones z on p.x between z.x0 and z.x1 and p.y between z.y0 and z.y1 group by p.id),
s as (select p.id, h.zone_id, round(0.7 * p.value / 1000 * coalesce(h.priority, 1) + 0.3 * p.x * coalesce(h.priority, 1), 8) as boost_score from points p left join h using (id)) select id, zone_id, boost_score, row_number() over (order by boost_score desc, id)::int as rank from s""")
def zone_overlay(spark, sf_dir):
    p = supplier_points(spark, sf_dir)
    out = sp.overlay(p.withColumn("v", F.col("value") / 1000).withColumn("xx", F.col("x")), _zones(spark), {"v": 0.7, "xx": 0.3}, places=12)
    w = Window.orderBy(F.col("boost_score").desc(), "id")
    return out.withColumn("boost_score", F.round("boost_score", 8)).withColumn("rank", F.row_number().over(w))


@query()
def kriged_values(spark, sf_dir):
    p = supplier_points(spark, sf_dir)
    targets = p.select("id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    return rounded(sp.krige(p, targets, rng=3.0, nugget=10.0, sill=1e6, neighbours=8, radius=4.0), 3)


@query()
def kriging_residuals(spark, sf_dir):
    return rounded(sp.leave_one_out(supplier_points(spark, sf_dir), 3.0, nugget=10.0, sill=1e6, neighbours=8), 3)


@query(f"""with {POINTS}, f as (select *, (id % 3)::int as fold from points) select id, fold from f a where fold <> 1 and not exists (select 1 from f b where b.fold = 1 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.9)""")
def buffered_training_rows(spark, sf_dir):
    p = supplier_points(spark, sf_dir).withColumn("fold", (F.col("id") % 3).cast("int"))
    return fo.buffered_training(p, 1, 0.9).select("id", "fold")


def _balance_sql(groups: str, folds: int) -> str:
    """CTEs up to ``deal`` (g, fold) for ``groups`` (g, n): largest first into the smallest fold."""
    return f"""o as (select g, n, row_number() over (order by n desc, g) as i from {groups}),
load as (select i, g, 0 as fold, [n, {", ".join(["0"] * (folds - 1))}]::bigint[] as l from o where i = 1 union all
select o.i, o.g, list_position(l, list_min(l)) - 1, list_transform(l, lambda x, j: case when j = list_position(l, list_min(l)) then x + o.n else x end) from load join o on o.i = load.i + 1),
deal as (select g, fold from load)"""


@query(f"""with recursive {POINTS}, e as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from points),
b as (select id, (least(floor((x - x0) / greatest(x1 - x0, 1e-12) * 5), 4) * 5 + least(floor((y - y0) / greatest(y1 - y0, 1e-12) * 5), 4))::bigint as block from points, e),
n as (select block as g, count(*) as n from b group by 1), {_balance_sql("n", 4)} select id, block, fold::int as fold from b join deal on g = block""")
def spatial_block_folds(spark, sf_dir):
    return fo.spatial_blocks(supplier_points(spark, sf_dir), 4).select("id", "block", "fold")


@query(f"""with recursive n as (select c_nationkey as g, count(*) as n from customer group by 1), {_balance_sql("n", 5)} select c_custkey, c_nationkey, fold::int as fold from customer join deal on g = c_nationkey""")
def grouped_fold_table(spark, sf_dir):
    return fo.grouped_folds(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 5)


@query(f"""with {DAILY}, t as (select ts, ntile(4) over (order by ts) - 1 as fold from (select distinct ts from daily)) select series_id, ts, fold::int as fold from daily join t using (ts)""")
def temporal_fold_table(spark, sf_dir):
    return fo.temporal_folds(daily(spark, sf_dir).select("series_id", "ts"), 4).select("series_id", "ts", "fold")


@query(f"""with {DAILY}, t as (select ts, row_number() over (order by ts desc) as b, count(*) over () as n from (select distinct ts from daily)) select series_id, ts, case when b <= greatest(1, round(t.n * 0.2)) then 'test' else 'train' end as part from daily join t using (ts)""")
def out_of_time_parts(spark, sf_dir):
    return fo.out_of_time(daily(spark, sf_dir).select("series_id", "ts"), 0.2).select("series_id", "ts", "part")


@query("""select s_suppkey as id, round(2 * 6371000 * asin(sqrt(sin(radians(s_suppkey % 10) / 2) ** 2 + cos(radians(s_suppkey % 10)) * cos(0) * sin(radians(s_suppkey // 10) / 2) ** 2)), 3) as metres,
round(exp(-0.5 * (s_suppkey % 10 / 4.0) ** 2), 6) as gaussian, round(case when s_suppkey % 10 >= 4 then 0 else (1 - (s_suppkey % 10 / 4.0) ** 2) ** 2 end, 6) as bisquare, round(exp(-(s_suppkey % 10) / 4.0::double), 6) as exponential, round_even(s_suppkey / 2, 0) as half_even from supplier""")
def distance_functions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a, b = (F.col("s_suppkey") % 10).cast("double"), F.floor(F.col("s_suppkey") / 10).cast("double")
    return s.select(F.col("s_suppkey").alias("id"), F.round(pr.haversine_m(F.lit(0.0), F.lit(0.0), a, b), 3).alias("metres"), *(F.round(pr.distance_kernel(a, 4.0, k), 6).alias(k) for k in ("gaussian", "bisquare", "exponential")), pr.half_even(F.col("s_suppkey") / 2, 0).alias("half_even"))


@query("""select c_custkey, c_custkey::decimal(20, 0) as from_digits, case when regexp_full_match(c_custkey::varchar, '[0-9]+') then ('0x' || c_custkey::varchar)::bigint::decimal(20, 0) end as from_hex, c_custkey as zone from customer""")
def id_parsing(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    t = F.col("c_custkey").cast("string")
    return c.select("c_custkey", geo_ids.cell_id(t).alias("from_digits"), geo_ids.cell_id(F.concat(F.lit("0x"), t)).alias("from_hex"), geo_ids.zone_number(F.concat(t, F.lit("-1234"))).alias("zone"))


@query("""select c_custkey, (((c_custkey * 4096) >> 6) | (5::bigint << 56))::bigint as parent from customer""")
def synthetic_parents(spark, sf_dir):
    p = geo_ids.synthetic_parent(F.col("c_custkey") * 4096, 7, 5)
    return table(spark, sf_dir, "customer").select("c_custkey", p.bitwiseAND(F.lit((1 << 63) - 1)).alias("parent"))


# --- graphs ----------------------------------------------------------------------------------------------------------


@query(f"""with {PART_EDGES}, o as (select src as node, count(*) as od, sum(weight) as ow, avg(ts) as ot, max(weight) as om from edges group by 1), i as (select dst as node, count(*) as d, sum(weight) as w, avg(ts) as t, max(weight) as m from edges group by 1)
select coalesce(o.node, i.node) as node, coalesce(od, 0) as out_degree, coalesce(ow, 0) as out_weight, round(ot, 2) as out_time, coalesce(d, 0) as in_degree, coalesce(w, 0) as in_weight, round(t, 2) as in_time, (coalesce(od, 0) - coalesce(d, 0)) / (coalesce(od, 0) + coalesce(d, 0)) as degree_imbalance,
round((coalesce(ow, 0) - coalesce(w, 0)) / (coalesce(ow, 0) + coalesce(w, 0)), 2) as asymmetry, round(coalesce(om / nullif(ow, 0), 0), 2) as out_affinity, round(coalesce(m / nullif(w, 0), 0), 2) as in_affinity, round(coalesce(ot - t, 0), 2) as temporal_drift from o full join i on o.node = i.node""")
def directional_node_features(spark, sf_dir):
    return rounded(gr.directional_features(part_edges(spark, sf_dir)), 2)


@query("""with e as (select distinct c_nationkey as src, s_nationkey as dst from customer join supplier on c_custkey % 100 = s_suppkey % 100) select src, dst from e union all select dst, src from e where src <> dst""")
def mirrored_edges(spark, sf_dir):
    return gr.undirected(_nation_edges(spark, sf_dir))


def _nation_edges(spark, sf_dir):
    """Nations of customers and suppliers alike in key mod 100, over whole tables.

    Both sides are reduced to (nation, remainder) first, so the join doesn't grow with the tables.
    """
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 100).alias("k")).distinct()
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("dst"), (F.col("s_suppkey") % 100).alias("k")).distinct()
    return c.join(s, "k").select("src", "dst").distinct()


@query("""with e as (select distinct c_nationkey as src, s_nationkey as dst from customer join supplier on c_custkey % 100 = s_suppkey % 100), p as (select src::varchar as s, dst::varchar as d, 'pair:' || src || ':' || dst as m from e)
select distinct s as src, m as dst, 'a' as rel from p union all select distinct m, d, 'b' from p""")
def pair_node_edges(spark, sf_dir):
    return gr.pair_nodes(_nation_edges(spark, sf_dir), "a", "b")


@query("""with o as (select o_orderkey, o_custkey from orders), a as (select o_custkey as src, l_suppkey as mid from o join lineitem on l_orderkey = o_orderkey), b as (select s_suppkey as mid, s_nationkey as dst from supplier) select src, mid, dst, count(*) as n from a join b using (mid) group by all""")
def two_hop_paths(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("buys").alias("rel"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst"), F.lit("in").alias("rel"))
    return gr.two_hop(a.union(b), "buys", "in").select("src", "mid", F.col("dst").cast("int").alias("dst"), "n")


@query("""with w as (select l_orderkey, list(l_partkey order by l_linenumber, l_partkey) as path from lineitem group by 1), p as (select unnest(generate_series(1, len(path))) as i, path from w), q as (select path[i] as centre, path[j] as context from (select path, i, unnest(generate_series(greatest(i - 2, 1), least(i + 2, len(path)))) as j from p) where i <> j)
select centre, context, count(*) as n from q group by all""")
def walk_contexts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    paths = rows.select(F.transform("p", lambda s: s["l_partkey"]).alias("path"))
    return gr.context_pairs(paths, 2).groupBy("centre", "context").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {PART_EDGES}, o as (select src as node, sum(weight) as w from edges group by 1), n as (select src as node from edges union select dst from edges) select node, round(greatest(coalesce(w, 0), 1) ** 0.75, 4) as weight from n left join o using (node)""")
def noise_distribution(spark, sf_dir):
    return rounded(gr.noise_weights(part_edges(spark, sf_dir)), 4)


_LINKS = "links as (select vec_id as src, (vec_id * 7 + 3) % (select count(*) from embeddings) as dst from embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _n_vectors(spark, sf_dir):
    """The modulus of targets, so that any vector can be one."""
    return max(table(spark, sf_dir, "embeddings").count(), 1)


def _links(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 3) % _n_vectors(spark, sf_dir)).alias("dst"))


@query(f"""with {_LINKS} select src, dst, round(1 / (1 + exp(-list_inner_product(a.embedding::double[], b.embedding::double[]))), 6) as score from links join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst""")
def link_score_table(spark, sf_dir):
    return rounded(gr.link_scores(_links(spark, sf_dir), _vectors(spark, sf_dir)))


@query(f"""with {_LINKS}, m as (select src as id, list_transform(embedding, lambda x: x::double) as m from links join embeddings on vec_id = dst), f as (select e.vec_id as id, e.embedding::double[] as x, m.m from embeddings e join m on m.id = e.vec_id)
select id, round(greatest(x[1] + 0.5 * m[1] - 0.25 * m[2] + 0.1, 0), 6) as a, round(greatest(-x[2] + m[3], 0), 6) as b from f""")
def aggregation_layer(spark, sf_dir):
    own, near = [[0.0] * 64 for _ in range(2)], [[0.0] * 64 for _ in range(2)]
    own[0][0], near[0][0], near[0][1], own[1][1], near[1][2] = 1.0, 0.5, -0.25, -1.0, 1.0
    out = gr.sage_layer(_links(spark, sf_dir).select(F.col("src").alias("node"), F.col("dst").alias("id")), _vectors(spark, sf_dir), own, near, [0.1, 0.0])
    return rounded(out.select("id", F.get("vec", F.lit(0)).alias("a"), F.get("vec", F.lit(1)).alias("b")))


@query("""select e.vec_id as id, round(list_cosine_similarity(e.embedding::double[], f.embedding::double[]), 6) as cosine from embeddings e join embeddings f on f.vec_id = (e.vec_id + 1) % (select count(*) from embeddings)""")
def cosine_table(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    other = v.select(F.col("id").alias("j"), F.col("vec").alias("w"))
    return rounded(v.join(other, (F.col("id") + 1) % _n_vectors(spark, sf_dir) == F.col("j")).select("id", pr.cosine(F.col("vec"), F.col("w")).alias("cosine")))


@query()
def negative_samples(spark, sf_dir):
    e = _nation_edges(spark, sf_dir)
    return gr.negative_edges(e, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")), 2)


@query()
def biased_walks(spark, sf_dir):
    e = gr.undirected(part_edges(spark, sf_dir).select("src", "dst", "weight"))
    return gr.walks(e, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")), 5, p=0.5, q=2.0)


@query()
def time_respecting_walks(spark, sf_dir):
    e = part_edges(spark, sf_dir).select("src", (F.col("dst") - 1_000_000).alias("dst"), "ts")
    return gr.temporal_walks(e, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")), 4)


@query()
def id_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return kernels.embedding_table(rows, "c_nationkey", "c_acctbal", 4).select("id", F.transform("vec", lambda v: F.round(v, 6)).alias("vec"))


@query()
def skip_gram_vectors(spark, sf_dir):
    e = _nation_edges(spark, sf_dir).withColumn("weight", F.lit(1.0))
    pairs = gr.context_pairs(gr.walks(gr.undirected(e), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")), 6, per_node=4), 2)
    return kernels.skip_gram(pairs, gr.noise_weights(e), dim=4, epochs=2).select("id", F.transform("vec", lambda v: F.round(v, 4)).alias("vec"))
