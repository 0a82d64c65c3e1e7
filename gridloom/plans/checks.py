"""Queries over exact boosted trees, files written and read again, neighbours, ids and guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geo_ids as ids
from gridloom.functions import predicates as pr
from gridloom.operators import boost as bo
from gridloom.operators import folds as fo
from gridloom.operators import forecast as fc
from gridloom.operators import global_forecast as gf
from gridloom.operators import graph as gr
from gridloom.operators import metrics as me
from gridloom.operators import spatial as sp
from gridloom.plans.base import DAILY, POINTS, daily, query, rounded, supplier_points, table
from gridloom.session import scratch
from gridloom.sources import files, ingest

# --- boosted trees with exact splits ----------------------------------------------------------------------------------


def _trees_sql(rounds: int, depth: int, rate: float, least: int = 20, y: str = "l_extendedprice / 1000", logistic: bool = False) -> str:
    """CTEs up to ``m{rounds}``: rows with their margin ``m`` and each tree's part ``c1``, ``c2``, ..., level by level: sums of
    gradients ``g`` and curvatures ``h`` by node, feature and value, the cut of the largest gain, the rows' next nodes."""
    p = "1 / (1 + exp(-m))"
    g, h = (f"y - {p}", f"greatest({p} * (1 - {p}), 1e-12)") if logistic else ("y - m", "1.0::double")
    first = "ln(avg(y) over () / (1 - avg(y) over ()))" if logistic else "avg(y) over ()"
    out = [f"base as (select l_orderkey, l_linenumber, l_quantity::double as f0, l_discount::double as f1, l_tax::double as f2, {y} as y from lineitem)", f"m0 as (select *, {first} as m from base)"]
    for r in range(1, rounds + 1):
        out.append(f"n{r}_0 as (select *, {g} as g, {h} as h, 1 as node from m{r - 1})")
        for d in range(depth):
            cells = " union all ".join(f"select node, {j} as j, f{j} as v, count(*) as n, sum(g) as s, sum(h) as w from n{r}_{d} group by node, f{j}" for j in range(3))
            up = ", ".join(f"sum({c}) over w as {c}, sum({c}) over (partition by node, j) as {c}{c}" for c in "nsw")
            out += [
                f"v{r}_{d} as ({cells})",
                f"k{r}_{d} as (select node, j, (v + lead(v) over w) / 2 as t, {up} from v{r}_{d} window w as (partition by node, j order by v))",
                f"g{r}_{d} as (select *, s * s / w + (ss - s) ** 2 / (ww - w) - ss * ss / ww as gain from k{r}_{d} where t is not null and n >= {least} and nn - n >= {least})",
                f"b{r}_{d} as (select * from g{r}_{d} where gain > 1e-8 qualify row_number() over (partition by node order by gain desc, j, t) = 1)",
                f"n{r}_{d + 1} as (select a.* exclude (node), case when b.j is null then a.node else 2 * a.node + ((case b.j when 0 then f0 when 1 then f1 else f2 end) > b.t)::int end as node from n{r}_{d} a left join b{r}_{d} b on b.node = a.node)",
            ]
        out.append(f"m{r} as (select * exclude (node, m, leaf, g, h), {rate} * leaf as c{r}, m + {rate} * leaf as m from (select *, sum(g) over (partition by node) / sum(h) over (partition by node) as leaf from n{r}_{depth}))")
    return ", ".join(out)


_LEAVES = ["l_quantity", "l_discount", "l_tax"]


def _lines(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in _LEAVES), (F.col("l_extendedprice") / 1000).alias("y"), "l_returnflag")


def _exact(spark, sf_dir) -> tuple[DataFrame, bo.BoostModel]:
    rows = _lines(spark, sf_dir)
    return rows, bo.fit(rows, _LEAVES, "y", bo.BoostSpec(rounds=2, rate=0.5, depth=2, min_leaf=20, splitter="exact"))


@query(f"with {_trees_sql(2, 2, 0.5)} select l_orderkey, l_linenumber, round(m, 4) as prediction from m2")
def exact_boosted_trees(spark, sf_dir):
    rows, model = _exact(spark, sf_dir)
    return rounded(model.transform(rows).select("l_orderkey", "l_linenumber", "prediction"), 4)


@query(f"with {_trees_sql(2, 2, 0.5)} select l_orderkey, l_linenumber, round((select avg(y) from base), 4) as init, round(c1, 4) as first, round(c2, 4) as second from m2")
def tree_contributions(spark, sf_dir):
    rows, model = _exact(spark, sf_dir)
    parts = rows.withColumn("c", model.contributions())
    return rounded(parts.select("l_orderkey", "l_linenumber", *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("init", "first", "second")))), 4)


@query(f"with {_trees_sql(2, 2, 0.5)} select l_orderkey, l_linenumber, round(m, 4) as prediction from m2")
def model_text_round_trip(spark, sf_dir):
    rows, model = _exact(spark, sf_dir)
    path = scratch(spark, "model")
    spark.range(1).select(F.lit(model.to_json()).alias("value")).coalesce(1).write.text(path)
    again = bo.BoostModel.from_json(spark.read.option("wholetext", True).text(path).first()["value"])
    return rounded(again.transform(rows).select("l_orderkey", "l_linenumber", "prediction"), 4)


def _part_sql(j: int) -> str:
    return " + ".join(f"case when (select j from b{r}_0) = {j} then c{r} - avg(c{r}) over () else 0 end" for r in (1, 2, 3))


@query(f"""with {_trees_sql(3, 1, 0.5)} select l_orderkey, l_linenumber, round({_part_sql(0)}, 4) as l_quantity, round({_part_sql(1)}, 4) as l_discount, round({_part_sql(2)}, 4) as l_tax, round((select avg(m) from m3), 4) as base from m3""")
def shapley_values(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    parts = bo.fit(rows, _LEAVES, "y", bo.BoostSpec(rounds=3, rate=0.5, depth=1, min_leaf=20, splitter="exact")).shapley()
    return rounded(rows.select("l_orderkey", "l_linenumber", *(parts.get(c, F.lit(0.0)).alias(c) for c in (*_LEAVES, "base"))), 4)


@query(f"""with {_trees_sql(1, 2, 0.5)}, root as (select * from b1_0), low as (select node, n as nl, s as sl, nn - n as nr, ss - s as sr, j, t from b1_1)
select 0 as tree, 1 as node, ['l_quantity', 'l_discount', 'l_tax'][j + 1] as feature, round(t, 6) as threshold, nn::bigint as n from root union all
select 0, node, ['l_quantity', 'l_discount', 'l_tax'][j + 1], round(t, 6), (nl + nr)::bigint from low""")
def split_nodes(spark, sf_dir):
    nodes = _exact(spark, sf_dir)[1].node_table(spark)
    return rounded(nodes.where((F.col("tree") == 0) & F.col("feature").isNotNull()).select("tree", "node", "feature", "threshold", "n"))


@query("""with b as (select l_orderkey, l_linenumber, l_quantity as q, l_extendedprice / 1000 as y from lineitem), f as (select regr_slope(y, q) as a, regr_intercept(y, q) as c from b)
select l_orderkey, l_linenumber, round(a * q + c, 4) as prediction from b, f""")
def linear_leaf_fit(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    model = bo.fit(rows, ["l_quantity"], "y", bo.BoostSpec(rounds=1, rate=1.0, depth=1, min_leaf=1_000_000_000, linear=("l_quantity",), ridge=0.0))
    return rounded(model.transform(rows).select("l_orderkey", "l_linenumber", "prediction"), 4)


@query(f"""with {_trees_sql(1, 1, 1.0, y="l_quantity + l_tax")}, up as (select l_orderkey, l_linenumber, m from m1) select l_orderkey, l_linenumber, round(m, 4) as rising, round((select avg(-y) from base), 4) as blocked from up""")
def monotone_fits(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("y", F.col("l_quantity") + F.col("l_tax")).withColumn("z", -F.col("y"))
    spec = bo.BoostSpec(rounds=1, rate=1.0, depth=1, min_leaf=20, splitter="exact", monotone=(("l_quantity", 1),))
    rising, blocked = bo.fit(rows, _LEAVES, "y", spec), bo.fit(rows, ["l_quantity"], "z", spec)
    return rounded(blocked.transform(rising.transform(rows, "rising"), "blocked").select("l_orderkey", "l_linenumber", "rising", "blocked"), 4)


_RETURNED = "(l_returnflag = 'R')::int::double"


@query(f"with {_trees_sql(3, 2, 0.5, y=_RETURNED, logistic=True)} select l_orderkey, l_linenumber, round(1 / (1 + exp(-m)), 6) as probability from m3")
def exact_boosted_classifier(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("hit", (F.col("l_returnflag") == "R").cast("double"))
    model = bo.fit(rows, _LEAVES, "hit", bo.BoostSpec(rounds=3, rate=0.5, depth=2, min_leaf=20, splitter="exact", loss="logistic"))
    return rounded(model.transform(rows, "probability").select("l_orderkey", "l_linenumber", "probability"))


def _class_sql(k: str) -> str:
    return _trees_sql(1, 1, 0.5, y=f"(l_returnflag = '{k}')::int::double")


@query(f"""with a as (with {_class_sql("A")} select distinct f0, f1, f2, avg(y) over () as p, c1 from m1), n as (with {_class_sql("N")} select distinct f0, f1, f2, avg(y) over () as p, c1 from m1), r as (with {_class_sql("R")} select distinct f0, f1, f2, avg(y) over () as p, c1 from m1),
s as (select f0, f1, f2, exp(ln(a.p) + a.c1 / (a.p * (1 - a.p))) as a, exp(ln(n.p) + n.c1 / (n.p * (1 - n.p))) as n, exp(ln(r.p) + r.c1 / (r.p * (1 - r.p))) as r from a join n using (f0, f1, f2) join r using (f0, f1, f2))
select l_orderkey, l_linenumber, round(a / (a + n + r), 6) as a, round(n / (a + n + r), 6) as n, round(r / (a + n + r), 6) as r from lineitem join s on f0 = l_quantity and f1 = l_discount and f2 = l_tax""")
def exact_boosted_classes(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    model = bo.fit_classes(rows, _LEAVES, "l_returnflag", bo.BoostSpec(rounds=1, rate=0.5, depth=1, min_leaf=20, splitter="exact", min_gain=0.0))
    made = model.transform(rows)
    return rounded(made.select("l_orderkey", "l_linenumber", *(F.get("probabilities", F.lit(i)).alias(c) for i, c in enumerate("anr"))))


# --- files written and read again -------------------------------------------------------------------------------------


@query("select s_suppkey::double as s_suppkey, s_acctbal from supplier")
def numeric_csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").write.option("header", True).csv(path)
    return files.read_numeric_csv(spark, path, ["s_suppkey", "s_acctbal"], "s_acctbal")


@query(f"with {DAILY} select series_id, ts, round(y, 4) as y from daily")
def series_csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    daily(spark, sf_dir).select("series_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("day"), "y").write.option("header", True).csv(path)
    return rounded(files.read_series_csv(spark, path, "day", "y", "series_id"), 4)


@query(f"with {DAILY} select series_id, 'daily' as kind, (row_number() over (partition by series_id order by ts) - 1)::int as step, round(y, 4) as y from daily")
def series_text_round_trip(spark, sf_dir):
    path = scratch(spark, "tsf")
    hist = fc.histories(daily(spark, sf_dir))
    line = F.concat_ws(":", "series_id", F.lit("daily"), F.array_join(F.transform("y", lambda v: v.cast("string")), ","))
    spark.createDataFrame([("# written by a query",), ("@data",)], "value string").union(hist.select(line)).write.text(path)
    return rounded(files.read_tsf(spark, path).select("series_id", F.get("attributes", F.lit(0)).alias("kind"), "step", "y"), 4)


@query(f"with {POINTS} select 's' || id as id, x, y, round(value, 4) as value from points")
def geojson_points_round_trip(spark, sf_dir):
    path = scratch(spark, "geojson")
    shape = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    each = F.struct(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.create_map(F.lit("value"), F.col("value").cast("string")).alias("properties"), shape.alias("geometry"))
    supplier_points(spark, sf_dir).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(each).alias("features"))).alias("value")).write.text(path)
    return rounded(files.geo_points(files.read_geojson(spark, path), ["value"]), 4)


@query("""select 'n' || n_nationkey as id, (n_nationkey % 4 + 1)::double as priority, (n_nationkey % 5 * 10)::double as x0, (n_nationkey // 5 * 10)::double as y0, 5 as corners from nation""")
def geojson_zones_round_trip(spark, sf_dir):
    path = scratch(spark, "geojson")
    n = table(spark, sf_dir, "nation")
    x, y = (F.col("n_nationkey") % 5 * 10).cast("double"), (F.floor(F.col("n_nationkey") / 5) * 10).cast("double")
    ring = F.array(*(F.array(x + a, y + b) for a, b in ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))))
    each = F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.create_map(F.lit("priority"), (F.col("n_nationkey") % 4 + 1).cast("string")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    n.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(each).alias("features"))).alias("value")).write.text(path)
    zones = sp.boxed(files.geo_zones(files.read_geojson(spark, path)))
    return zones.select("id", "priority", "x0", "y0", F.size("ring").alias("corners"))


@query("""with s as (select o_orderpriority as item_id, o_orderstatus as store_id, extract(month from o_orderdate)::int as m, count(*) as n from orders where extract(month from o_orderdate) <= 4 group by all), k as (select distinct o_orderpriority as item_id, o_orderstatus as store_id from orders)
select k.item_id, k.store_id, make_date(2026, m.m, 1)::timestamp as ts, coalesce(s.n, 0)::double as y, (m.m + 1) // 2 + length(k.item_id) / 10.0::double as price from k, (select unnest([1, 2, 3, 4]) as m) m left join s on s.item_id = k.item_id and s.store_id = k.store_id and s.m = m.m""")
def wide_sales_panel(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    wide = o.groupBy(F.col("o_orderpriority").alias("item_id"), F.col("o_orderstatus").alias("store_id")).agg(*(F.count_if(F.month("o_orderdate") == m).alias(f"d_{m}") for m in range(1, 5)))
    calendar = spark.range(1, 5).select(F.concat(F.lit("d_"), F.col("id").cast("string")).alias("d"), F.make_date(F.lit(2026), F.col("id").cast("int"), F.lit(1)).cast("timestamp_ntz").alias("date"), F.floor((F.col("id") + 1) / 2).alias("week"))
    prices = wide.select("item_id", "store_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("week")).withColumn("price", F.col("week") + F.length("item_id") / 10.0)
    return files.sales_panel(wide, calendar, prices)


@query(f"""with {DAILY}, d as (select series_id as symbol, ts, y, lag(y) over (partition by series_id order by ts) as before from daily) select symbol, ts, round(y / before - 1, 6) as y from d where before is not null""")
def return_series(spark, sf_dir):
    prices = daily(spark, sf_dir).select(F.col("series_id").alias("symbol"), "ts", F.col("y").alias("price"))
    return rounded(files.return_panel(prices))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 5 and 30 and l_discount between 0.02 and 0.06")
def clean_line_items(spark, sf_dir):
    return files.clean_ranges(table(spark, sf_dir, "lineitem"), {"l_quantity": (5, 30), "l_discount": (0.02, 0.06)}).select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"""with {DAILY}, h as (select series_id, max(ts) as last_ts, arg_max(y, ts) as y from daily group by 1) select kind, series_id, last_ts + to_days(s) as ts, s as horizon, 'naive' as model, round(y, 4) as mean
from h, (select unnest([1, 2, 3])::int as s), (select unnest(['parquet', 'json', 'csv']) as kind)""")
def forecast_round_trips(spark, sf_dir):
    made = fc.predictions(fc.histories(daily(spark, sf_dir)), fc.naive, 3, "naive")
    out = []
    for kind in ("parquet", "json", "csv"):
        path = scratch(spark, "forecast")
        files.write_forecast(made, path, {"note": "round trip"}, kind)
        out.append(files.read_forecast(spark, path)[0].withColumn("kind", F.lit(kind)))
    return rounded(reduce(DataFrame.unionByName, out), 4)


@query("select vec_id as id, len(embedding)::int as dim, round(embedding[1]::double, 6) as first, round(list_sum(embedding::double[]), 4) as total from embeddings")
def embedding_table_round_trip(spark, sf_dir):
    path = scratch(spark, "embeddings")
    files.write_embeddings(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec")), path)
    rows = files.read_embeddings(spark, path)[0]
    return rounded(rounded(rows.select("id", F.size("vec").alias("dim"), F.get("vec", F.lit(0)).alias("first"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))))


# --- features, neighbours, guards -------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, 3 as width, round(l_quantity + l_discount + l_tax, 6) as total from lineitem")
def dense_features(spark, sf_dir):
    rows = files.feature_matrix(table(spark, sf_dir, "lineitem"), _LEAVES)
    return rounded(rows.select("l_orderkey", "l_linenumber", F.size("features").alias("width"), F.aggregate("features", F.lit(0.0), lambda a, v: a + v).alias("total")))


@query("select s_suppkey, abs(s_acctbal) as weight from supplier")
def checked_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.abs("s_acctbal").cast("double").alias("w"))
    return ingest.check_weights(rows, "w").select("s_suppkey", "weight")


@query("""with e as (select vec_id as id, embedding::double[] as v from embeddings), p as (select a.id, a.v as a, b.v as b from e a join e b on b.id = a.id + 1)
select id, 4 * len(a)::int as width, round(a[1], 6) as source, round(b[1], 6) as target, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 4) as gap, round(list_inner_product(a, b), 4) as product from p""")
def pair_expansion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    both = e.join(e.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id").withColumn("f", pr.pair_features(F.col("a"), F.col("b")))
    n = F.size("a")
    total = lambda start: F.aggregate(F.slice("f", start, n), F.lit(0.0), lambda s, v: s + v)
    made = both.select("id", F.size("f").alias("width"), F.get("f", F.lit(0)).alias("source"), F.get("f", n).alias("target"), F.round(total(2 * n + 1), 4).alias("gap"), F.round(total(3 * n + 1), 4).alias("product"))
    return rounded(made)


@query("""with e as (select vec_id as id, embedding::double[] as v from embeddings where vec_id % 3 = 0), m as (select avg(v[1]) as m from e)
select c_custkey as id, round(coalesce(e.v[1], p.v[1], m), 6) as first from customer c left join e on e.id = c_custkey left join e p on p.id = c_custkey - c_custkey % 3, m""")
def embedding_fallbacks(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 3 == 0).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    parents = rows.select("id", (F.col("id") - F.col("id") % 3).alias("parent"), F.lit(0).alias("ord"))
    return rounded(gr.embedding_lookup(rows, t, "mean", parents).select("id", F.get("vec", F.lit(0)).alias("first")))


@query(f"""with {POINTS} select id, p_id, round(d, 6) as d, r::int as r from (select a.id, b.id as p_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d, row_number() over (partition by a.id order by sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) as r from points a join points b on a.id <> b.id) where r <= 4""")
def nearest_suppliers(spark, sf_dir):
    points = supplier_points(spark, sf_dir)
    p = points.select(F.col("id").alias("p_id"), F.col("x").alias("p_x"), F.col("y").alias("p_y"), "value")
    return rounded(sp.nearest(p, points, 4, True).select("id", "p_id", "d", "r"))


@query(f"""with {POINTS}, p as (select a.id, 2 * 6371000 * asin(sqrt(least(1, sin(radians(b.y - a.y) / 2) ** 2 + cos(radians(a.y)) * cos(radians(b.y)) * sin(radians(b.x - a.x) / 2) ** 2))) as d from points a join points b on a.id <> b.id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3),
r as (select id, d, row_number() over (partition by id order by d) as r from p) select points.id, round(greatest(coalesce(max(d), 1), 1), 2) as bandwidth from points left join r on r.id = points.id and r <= 3 group by points.id""")
def third_neighbour_bandwidth(spark, sf_dir):
    return rounded(sp.neighbour_bandwidth(supplier_points(spark, sf_dir), 3, 3.0), 2)


@query(f"""with {POINTS} select a.id, b.id as i2, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) as d from points a join points b on a.id < b.id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2""")
def near_supplier_pairs(spark, sf_dir):
    pairs = me.near_pairs(supplier_points(spark, sf_dir), 2.0)
    return rounded(pairs.select("id", "i2", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")).alias("d")))


_PARTS = "f as (select o_orderkey, o_custkey as g, o_orderkey % 3 as fold, case when o_orderkey % 2 = 0 then 'train' else 'valid' end as part, o_orderdate::timestamp as ts from orders)"


def _parts(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, F.col("o_custkey").alias("g"), (k % 3).alias("fold"), F.when(k % 2 == 0, "train").otherwise("valid").alias("part"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))


@query(f"with {_PARTS} select fold, g from f group by all having count(distinct part) > 1")
def leaking_customers(spark, sf_dir):
    return fo.leaking_groups(_parts(spark, sf_dir), "g")


@query(f"with {_PARTS} select fold from f group by fold having max(ts) filter (part = 'train') >= min(ts) filter (part = 'valid')")
def leaking_times(spark, sf_dir):
    return fo.time_leaks(_parts(spark, sf_dir))


@query(f"""with {DAILY}, n as (select count(distinct ts) as n from daily), e as (select unnest(generate_series(10, (select n from n) - 5, 3))::int as e), k as (select e, row_number() over (order by e desc) as back from e)
select (row_number() over (order by e) - 1)::int as fold, greatest(0, e - 8)::int as train_from, e as train_to, e + 5 as valid_to from k where back <= 3""")
def last_folds(spark, sf_dir):
    return fc.rolling_origins(daily(spark, sf_dir), 5, 3, 10, max_train=8, n_splits=3)


@query("select s_suppkey, array_to_string(list_sort(list_distinct([s_suppkey::bigint, s_nationkey::bigint, (s_suppkey // 4)::bigint])), ',') as cells from supplier")
def supplier_id_sets(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    cells = ids.cell_set(F.col("s_suppkey").cast("long"), [F.col("s_nationkey").cast("long"), F.floor(F.col("s_suppkey") / 4).cast("long")])
    return s.select("s_suppkey", F.array_join(F.transform(cells, lambda c: c.cast("string")), ",").alias("cells"))


@query(f"with {POINTS} select id, ((floor(x / 2.5)::bigint + 1073741824) << 31) | (floor(y / 2.5)::bigint + 1073741824) as cell from points")
def grid_cells(spark, sf_dir):
    return supplier_points(spark, sf_dir).select("id", ids.grid_cell(F.col("x"), F.col("y"), 2.5).alias("cell"))


@query(f"""with {DAILY}, t as (select *, row_number() over (partition by series_id order by ts desc) as b from daily), h as (select series_id, arg_max(y, ts) as last, list(y order by ts) as y from t where b > 7 group by 1),
s as (select t.series_id, t.y, h.last as naive, h.y[-7 + (8 - b) - 1] as season from t join h using (series_id) where b <= 7),
m as (select avg(case when abs(season) + abs(y) > 0 then 2 * abs(season - y) / (abs(season) + abs(y)) end) as a, avg(case when abs(naive) + abs(y) > 0 then 2 * abs(naive - y) / (abs(naive) + abs(y)) end) as b, avg(abs(season - y)) as c, avg(abs(naive - y)) as d from s)
select round(a, 6) as smape, round(c, 6) as mase, round(a / greatest(b, 1e-12), 6) as relative_smape, round(c / greatest(d, 1e-12), 6) as relative_mase, round((a / greatest(b, 1e-12) + c / greatest(d, 1e-12)) / 2, 6) as owa from m""")
def competition_scores(spark, sf_dir):
    train, test = fc.split_tail(daily(spark, sf_dir), 7)
    hist = fc.histories(train)
    season, naive = (me.point_metrics(me.align(fc.predictions(hist, f, 7, n), test)).first() for f, n in ((fc.seasonal_naive(7), "season"), (fc.naive, "naive")))
    got = me.m_competition(season["smape"], season["mae"], naive["smape"], naive["mae"])
    return rounded(spark.createDataFrame([tuple(float(v) for v in got.values())], ", ".join(f"{k} double" for k in got)))


# --- ingest, registry, settings, maps ---------------------------------------------------------------------------------


@query("select kind, n_nationkey::double as n_nationkey, n_regionkey::double as n_regionkey from nation, (select unnest(['arrow', 'pandas', 'columns', 'rows']) as kind)")
def ingested_frames(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(*(F.col(c).cast("double").alias(c) for c in ("n_nationkey", "n_regionkey")))
    held = rows.toPandas()  # a table of fixed size, as other libraries hold it
    made = {"arrow": rows.toArrow(), "pandas": held, "columns": {c: held[c].tolist() for c in held}, "rows": held.to_numpy()}
    return reduce(DataFrame.unionByName, (ingest.to_frame(spark, v, list(held.columns)).withColumn("kind", F.lit(k)) for k, v in made.items()))


@query(f"""with {DAILY}, h as (select series_id, max(ts) as last_ts, arg_max(y, ts) as y, avg(y) filter (r <= 7) as m from (select *, row_number() over (partition by series_id order by ts desc) as r from daily) group by 1)
select name, series_id, last_ts + to_days(s) as ts, s as horizon, round(case name when 'naive' then y else m end, 6) as mean from h, (select unnest([1, 2, 3, 4])::int as s), (select unnest(['naive', 'window_average']) as name)""")
def configured_forecasts(spark, sf_dir):
    """The models of a settings text, by their names in the registry."""
    config = files.ForecastConfig.parse('{"horizon": 4, "models": ["naive", "window_average"], "note": "kept"}')
    panel = daily(spark, sf_dir).select("series_id", "ts", "y")
    made = [gf.forecaster(name)(panel, config.horizon).select(F.lit(name).alias("name"), "series_id", "ts", "horizon", "mean") for name in config.models]
    return rounded(reduce(DataFrame.unionByName, made))


@query("""select o_orderpriority, 0.1::double as q, round(quantile_cont(o_totalprice, 0.1), 4) as value from orders group by 1 union all
select o_orderpriority, 0.5, round(quantile_cont(o_totalprice, 0.5), 4) from orders group by 1 union all select o_orderpriority, 0.95, round(quantile_cont(o_totalprice, 0.95), 4) from orders group by 1""")
def interpolated_quantiles(spark, sf_dir):
    levels = (0.1, 0.5, 0.95)
    each = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.percentile("o_totalprice", F.array(*map(F.lit, levels))).alias("v"))
    pairs = F.arrays_zip(F.array(*map(F.lit, levels)).alias("q"), F.col("v").alias("value"))
    return rounded(each.select("o_orderpriority", F.explode(pairs).alias("x")).select("o_orderpriority", F.col("x.q").alias("q"), F.round("x.value", 4).alias("value")))


@query(f"""with {DAILY} select series_id, count(*)::int as days, round(max(y), 4) as top, round(sum(y) / sum(sum(y)) over (), 6) as share from daily group by 1""")
def value_maps(spark, sf_dir):
    """By series a map from day to value, and the series' weights normalised to one."""
    maps = daily(spark, sf_dir).groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("ts", "y"))).alias("m"))
    sums = maps.withColumn("total", F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, v: a + v))
    whole = sums.agg(F.sum("total")).first()[0]
    return rounded(sums.select("series_id", F.size("m").alias("days"), F.round(F.array_max(F.map_values("m")), 4).alias("top"), (F.col("total") / F.lit(whole)).alias("share")))


@query("select 1 as place, 'supplier' as source, 'ships' as relation, 'order' as target union all select 2, 'part', 'of', 'order'")
def metapath_faults(spark, sf_dir):
    """The steps of a path that a schema of node types lacks, or that don't go on from the step before."""
    schema = [("customer", "places", "order"), ("order", "holds", "part"), ("part", "of", "order")]
    path = [("customer", "places", "order"), ("supplier", "ships", "order"), ("part", "of", "order"), ("order", "holds", "part")]
    rows = [(path.index(step), *step) for step in gr.invalid_metapath_steps(path, schema)]
    return spark.createDataFrame(rows, "place int, source string, relation string, target string")
