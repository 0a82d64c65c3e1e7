"""Small cases with answers worked out by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo_ids
from gridloom.functions import predicates as pr
from gridloom.operators import boost as bo
from gridloom.operators import encoders as en
from gridloom.operators import folds as fo
from gridloom.operators import forecast as fc
from gridloom.operators import graph as gr
from gridloom.operators import hierarchy as hi
from gridloom.operators import kernels as ke
from gridloom.operators import metrics as me
from gridloom.operators import ranking as ra
from gridloom.operators import spatial as sp
from gridloom.operators.lags import LagSpec, lag_features, supported
from gridloom.operators.panel import PanelSpec, fill_gaps, infer_frequency, make_panel
from gridloom.sources import files


def panel(spark, **series):
    rows = [(k, f"2026-01-{i + 1:02d}", float(v)) for k, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, t string, y double").select("series_id", F.to_timestamp_ntz("t", F.lit("yyyy-MM-dd")).alias("ts"), "y")


def means(df, series="a"):
    return [r["mean"] for r in df.where(F.col("series_id") == series).orderBy("horizon").collect()]


def test_baselines(spark):
    h = fc.histories(panel(spark, a=[10, 12, 14, 16, 18, 20]))
    run = lambda f, n: means(fc.predictions(h, f, n, "m"))
    assert run(fc.naive, 3) == [20, 20, 20]
    assert run(fc.seasonal_naive(3), 5) == [16, 18, 20, 16, 18]
    assert run(fc.window_average(3), 2) == [18, 18]
    assert run(fc.seasonal_window_average(3, 2), 5) == [13, 15, 17, 13, 15]
    with pytest.raises(ValueError, match="horizon"):
        fc.predictions(h, fc.naive, 0, "m")


def test_linear_and_constant_series(spark):
    line, flat = panel(spark, a=[10, 12, 14, 16]), panel(spark, a=[42] * 5)
    assert means(fc.ets_forecast(line, 2, alpha=1, beta=1)) == [18, 20]
    assert means(fc.theta_forecast(flat, 3, 2.0, 0.4)) == pytest.approx([42] * 3)
    assert fc.optimized_theta(flat, 2, (2.0, 1.0), (0.8, 0.2)).count() == 2
    assert ke.fit_arima(np.array([10.0, 12, 14, 16]), 0, 1, 0).forecast(2) == pytest.approx([18, 20])
    assert ke.fit_arima(np.array([1.0, 4, 9, 16, 25]), 0, 2, 0).forecast(2) == pytest.approx([36, 49])
    assert means(ke.auto_arima_forecast(line, 2, 0, 1, 0)) == pytest.approx([18, 20])


def test_kalman(spark):
    p = panel(spark, a=[10, 12, 14, 16], b=[40, 38, 36, 34])
    up, down = means(fc.kalman_trend_forecast(p, 2, 10, 10, 1e-6)), means(fc.kalman_trend_forecast(p, 2, 10, 10, 1e-6), "b")
    assert up == pytest.approx([18, 20], abs=1e-3) and down == pytest.approx([32, 30], abs=1e-3)
    # a smoother by hand on three values
    y, q, r = [1.0, 3.0, 2.0], 0.5, 1.0
    m, v, prior = [y[0]], [r], []
    for x in y[1:]:
        prior.append(v[-1] + q)
        k = prior[-1] / (prior[-1] + r)
        m.append(m[-1] + k * (x - m[-1]))
        v.append((1 - k) * prior[-1])
    s = [m[-1]]
    for i in (1, 0):
        s.insert(0, m[i] + v[i] / prior[i] * (s[0] - m[i]))
    got = fc.histories(panel(spark, a=y)).select(fc.kalman_smoothed(F.col("y"), q, r).alias("s")).first()["s"]
    assert got == pytest.approx(s)


def test_intermittent(spark):
    y = [0, 0, 4, 0, 2, 0, 0, 3]
    d, g, e = 4.0, 3.0, 0
    for v in y[3:]:
        e += 1
        if v:
            d, g, e = d + 0.2 * (v - d), g + 0.2 * (e - g), 0
    h = fc.histories(panel(spark, a=y, z=[0] * 8))
    got = {r["series_id"]: r for r in h.select("series_id", fc.croston_level(F.col("y"), 0.2).alias("c"), fc.adida_level(F.col("y"), 0.2, 4).alias("x")).collect()}
    assert got["a"]["c"] == pytest.approx(d / g) and got["z"]["c"] is None
    assert got["a"]["x"] == pytest.approx((4 + 0.2 * (5 - 4)) / (1 + 0.2 * (1 - 1)) / 4)
    chosen = {r["series_id"]: r for r in fc.intermittent_selector(panel(spark, a=y, z=[0] * 8), 2).collect()}
    assert chosen["z"]["method"] == "zero" and chosen["z"]["level"] == 0 and chosen["a"]["level"] > 0


def test_decomposition_recomposes(spark):
    y = [10 + i + (3 if i % 3 == 0 else -1) for i in range(14)]
    r = fc.decompose(panel(spark, a=y), [3]).first()
    assert np.allclose(np.array(r["trend"]) + r["seasonal_3"] + r["remainder"], y)
    assert sum(r["seasonal_3"][:3]) == pytest.approx(0)


def test_lags_do_not_leak(spark):
    p = panel(spark, A=[10, 20, 30], B=[100, 200, 300])
    rows = {(r["series_id"], r["ts"].day): r for r in lag_features(p, LagSpec(lags=(1, 2), roll_mean=(2,), roll_max=(2,)), drop=False).collect()}
    r = rows["A", 3]
    assert (r["target_lag_1"], r["target_lag_2"], r["target_roll_mean_2"], r["target_roll_max_2"]) == (20, 10, 15, 20)
    assert rows["B", 1]["target_lag_1"] is None and rows["A", 2]["target_roll_mean_2"] is None
    assert supported(p, LagSpec(lags=(1, 5), roll_mean=(7,))) == LagSpec(lags=(1,))
    assert supported(p, LagSpec(lags=(5,))).lags == (1,)


def test_panel_checks(spark):
    raw = spark.createDataFrame([("x", "2026-01-01", 1.0, 2.0), ("x", "2026-01-01", 4.0, 1.0), ("x", "2026-01-03T00:00:00Z", 5.0, 1.0)], "s string, t string, v double, w double")
    p = make_panel(raw, PanelSpec("t", "v", "s", weight="w"))
    rows = {r["ts"].day: (r["y"], r["w"]) for r in p.data.collect()}
    assert rows == {1: (2.0, 3.0), 3: (5.0, 1.0)}
    assert infer_frequency(p.data) is None and infer_frequency(fill_gaps(p.data)) == "D"
    with pytest.raises(ValueError, match="columns"):
        make_panel(raw, PanelSpec("nope", "v"))
    with pytest.raises(Exception, match="finite target"):
        make_panel(raw.withColumn("v", F.lit(float("nan"))), PanelSpec("t", "v", "s")).data.collect()


def test_wrmsse(spark):
    train = panel(spark, a=[10, 12, 14, 16], b=[20, 21, 23, 26])
    scored = spark.createDataFrame([("a", 18.0, 17.0), ("a", 20.0, 23.0), ("b", 30.0, 32.0), ("b", 34.0, 31.0)], "series_id string, y double, mean double")
    weights = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "series_id string, weight double")
    rows = me.wrmsse(scored, train, weights).collect()
    assert sum(r["contribution"] for r in rows) == pytest.approx(1.1387538887346516)
    assert {r["series_id"]: r["scale"] for r in me.seasonal_scale(train, 1, ["series_id"], True).collect()} == pytest.approx({"a": 4.0, "b": 14 / 3})


def test_probabilistic_helpers(spark):
    row = spark.range(1).select(me.non_crossing(F.array(*map(F.lit, (12.0, 10.0, 13.0)))).alias("q"), me.rank_probability_score(F.array(*map(F.lit, (0.2, 0.3, 0.5))), F.lit(2)).alias("r")).first()
    assert row["q"] == [12, 12, 13] and row["r"] == pytest.approx(0.145)
    df = spark.createDataFrame([(10.0, 11.0), (20.0, 18.0)], "y double, mean double")
    assert me.pinball_loss(df, 0.5).first()[0] == pytest.approx(0.75)
    assert me.conformal_quantile(df, 0.5) == 2.0
    assert me.m_competition(2, 3, 4, 3)["owa"] == pytest.approx(0.75)


def test_alignment_errors(spark):
    f = spark.createDataFrame([("a", 1, 1.0)], "series_id string, ts int, mean double")
    a = spark.createDataFrame([("a", 2, 1.0)], "series_id string, ts int, y double")
    with pytest.raises(Exception, match="keys differ"):
        me.align(f, a).collect()


def test_overlay_golden(spark, tmp_path):
    def feature(name, kind, coordinates, **properties):
        return {"type": "Feature", "id": name, "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}

    zones = [feature("zone-a", "Polygon", [[[0, 0], [25, 0], [25, 20], [0, 20], [0, 0]]], priority=1.25), feature("zone-b", "Polygon", [[[0, 20], [25, 20], [25, 40], [0, 40], [0, 20]]], priority=0.85)]
    sites = [("site-alpha", [10, 10], 1.0, 0.82, 0.74), ("site-bravo", [20, 10], 0.7, 0.55, 0.91), ("site-charlie", [10, 30], 0.4, 0.22, 0.36)]
    points = [feature(n, "Point", xy, base_score=b, traffic_index=t, population_index=p) for n, xy, b, t, p in sites]
    for name, each in (("z", zones), ("p", points)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"type": "FeatureCollection", "features": each}))
    weights = {"base_score": 0.5, "traffic_index": 0.3, "population_index": 0.2}
    p = files.geo_points(files.read_geojson(spark, str(tmp_path / "p.json")), list(weights))
    z = files.geo_zones(files.read_geojson(spark, str(tmp_path / "z.json")))
    got = [(r["id"], r["zone_id"], r["boost_score"], r["rank"]) for r in sp.overlay(p, z, weights).orderBy("rank").collect()]
    assert got == [("site-alpha", "zone-a", 1.1175, 1), ("site-bravo", "zone-a", 0.87125, 2), ("site-charlie", "zone-b", 0.2873, 3)]
    edge = p.limit(1).withColumn("x", F.lit(5.0)).withColumn("y", F.lit(20.0))
    assert sp.locate(edge, z).first()["z_id"] == sp.locate(edge, z, cell=7.0).first()["z_id"] == "zone-a"
    with pytest.raises(Exception, match="no zone"):
        sp.overlay(p.withColumn("x", F.lit(99.0)), z, weights, strict=True).collect()


def test_kriging(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 1.0, 0.0, 7.0), (3, 2.0, 1.0, 4.0), (4, 0.0, 2.0, 6.0)], "id long, x double, y double, value double")
    got = {r["id"]: r for r in sp.krige(pts, pts, 1.5, nugget=1e-12, radius=5.0).collect()}
    assert [got[i]["mean"] for i in (1, 2, 3, 4)] == pytest.approx([5, 7, 4, 6], abs=1e-6) and got[1]["variance"] < 1e-6
    plane = pts.withColumn("value", 1 + 2 * F.col("x") - F.col("y"))
    assert sp.krige(plane, pts.withColumn("x", F.col("x") + 0.3), 1.5, linear=True).orderBy("id").first()["mean"] == pytest.approx(1.6, abs=1e-6)
    bins = sp.empirical_variogram(pts, 3)
    assert sum(r["pairs"] for r in bins.collect()) == 6 and sp.fit_variogram(bins)["sse"] >= 0
    assert sp.leave_one_out(pts, 1.5).count() == 4


def test_axis_paths():
    axis, signal = np.arange(5.0), np.array([0.0, 1, 4, 9, 16])
    target = np.array([0.0, 1, np.nan, 9, 16])
    states, _ = ke.viterbi_path(target, axis, signal, ke.PathSpec(scale=0.5, step_penalty=0.1))
    assert states.tolist() == [0, 1, 2, 3, 4]
    assert np.abs(ke.posterior_axis(target, axis, signal, ke.PathSpec(scale=0.1, step_penalty=0.1)) - axis).max() < 0.3
    spec = ke.AxisSpec(signal_noise=0.01, axis_noise=0.01)
    filtered = ke.extended_kalman(target, 0.0, 1.0, axis, signal, spec)
    assert np.abs(filtered[0][:, 0] - axis).max() < 0.5 and np.abs(ke.smooth_axis(*filtered)[:, 0] - axis).max() < 0.5
    assert np.abs(ke.unscented_kalman(target, 0.0, 1.0, axis, signal, spec)[:, 0] - axis).max() < 1.0


def test_piecewise():
    dates = np.datetime64("2026-01-05") + np.arange(70).astype("timedelta64[D]")
    y = 10 + 0.5 * np.arange(70) + 3 * np.sin(2 * np.pi * np.arange(70) / 7)
    spec = ke.PiecewiseSpec(changepoints=2, change_penalty=10.0, season_penalty=1e-6)
    model = ke.fit_piecewise(dates.astype("datetime64[s]"), y, spec)
    ahead = (dates[-1] + np.arange(1, 8).astype("timedelta64[D]")).astype("datetime64[s]")
    parts = ke.piecewise_parts(model, ahead, spec)
    want = 10 + 0.5 * np.arange(70, 77) + 3 * np.sin(2 * np.pi * np.arange(70, 77) / 7)
    assert np.abs(parts["mean"] - want).max() < 0.05 and np.allclose(parts["trend"] + parts["weekly"], parts["mean"])


def test_blend(spark):
    rows = spark.createDataFrame([(1.0, 3.0, 2.0), (2.0, 6.0, 4.0), (4.0, 2.0, 3.0)], "a double, b double, y double")
    w = ke.fit_blend(rows, ["a", "b"], "y", 3000)
    assert w["a"] == pytest.approx(0.5, abs=0.02) and sum(w.values()) == pytest.approx(1)


def test_reconciliation(spark):
    tree = hi.closure(spark.createDataFrame([("a", "t"), ("b", "t")], "child string, parent string"))
    base = spark.createDataFrame([("t", 1, 10.0), ("a", 1, 4.0), ("b", 1, 3.0)], "node string, ts int, mean double")
    got = {r["node"]: r["mean"] for r in hi.reconcile(base, tree).collect()}
    assert got == pytest.approx({"t": 9.0, "a": 5.0, "b": 4.0}) and got["t"] == pytest.approx(got["a"] + got["b"])
    total = spark.createDataFrame([(1, 12.0)], "ts int, mean double")
    share = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", -2.0)], "node string, weight double")
    assert {r["node"]: r["mean"] for r in hi.top_down(total, share).collect()} == {"a": 3.0, "b": 9.0, "c": 0.0}


def test_encoders(spark):
    assert en.subsets(["a", "b", "c"]) == [("a",), ("b",), ("c",)]
    assert en.subsets(["a", "b", "c", "d"]) == [("a",), ("b",), ("c",), ("d",), ("a", "b"), ("a", "c"), ("a", "d")]
    rows = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 8.0), (None, 4.0)], "c string, y double")
    got = {r["c"]: r["encoded"] for r in en.target_mean(rows, "c", "y", smoothing=2).collect()}
    assert got["x"] == pytest.approx((4 + 2 * 4) / 4)
    assert en.encode(rows, rows, "c", "y").columns == ["c", "y", "c_is_x", "c_is_y"]


def test_predicates(spark):
    df = spark.createDataFrame([(11.0,), (1.0,), (5.0,), (float("nan"),), (None,)], "v double")
    rows = df.select(pr.periodic_left(F.col("v"), 12, 10, 2, True).alias("p"), pr.axis_left(F.col("v"), 5).alias("a"), pr.soft_left(F.col("v") - 5, 10, "linear").alias("s")).collect()
    assert [r["p"] for r in rows] == [True, True, False, True, True] and [r["a"] for r in rows] == [False, True, True, False, False]
    assert rows[2]["s"] == 0.5
    assert spark.range(1).select(geo_ids.cell_id(F.lit("ff")).alias("x")).first()["x"] == 255


def test_boosting(spark):
    rows = spark.createDataFrame([(float(i), float(i % 3), 10.0 if i < 50 else -10.0, 1.0 if i < 50 else 0.0, i // 10) for i in range(100)], "x double, z double, y double, b double, q int").withColumn("id", F.monotonically_increasing_id())
    spec = bo.BoostSpec(rounds=8, rate=0.5, depth=2, min_leaf=5)
    model = bo.fit(rows, ["x", "z"], "y", spec)
    err = model.transform(rows).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert err < 0.2 and "x <= 49.5" in model.dump() or "x <=" in model.dump()
    again = bo.BoostModel.from_json(model.to_json())
    assert again.transform(rows).agg(F.sum("prediction")).first()[0] == model.transform(rows).agg(F.sum("prediction")).first()[0]
    total = rows.select(F.abs(F.aggregate(model.contributions(), F.lit(0.0), lambda a, v: a + v) - model.margin()).alias("d")).agg(F.max("d")).first()[0]
    assert total < 1e-9 and model.node_table(spark).count() >= len(model.trees)
    for loss in ("l1", "huber", "quantile", "poisson", "log_l2"):
        data = rows.withColumn("y", F.abs("y") + F.col("z")) if loss in ("poisson", "log_l2") else rows
        assert bo.fit(data, ["x", "z"], "y", bo.BoostSpec(rounds=2, depth=1, min_leaf=5, loss=loss)).transform(data).count() == 100
    p = bo.fit(rows, ["x"], "b", bo.BoostSpec(rounds=8, rate=0.5, depth=1, min_leaf=5, bins=128, loss="logistic")).transform(rows)
    assert p.where((F.col("prediction") > 0.5) != (F.col("b") == 1)).count() == 0
    classes = bo.fit_classes(rows.withColumn("c", F.when(F.col("x") < 50, "lo").otherwise("hi")), ["x"], "c", bo.BoostSpec(rounds=3, depth=1, min_leaf=5, bins=128)).transform(rows)
    assert classes.where((F.col("prediction") == "lo") != (F.col("x") < 50)).count() == 0
    ranker = bo.fit_ranker(rows.withColumn("rel", F.col("z")), ["z", "x"], "rel", "q", "id", bo.BoostSpec(rounds=3, depth=2, min_leaf=5))
    assert me.ndcg(ranker.transform(rows), "q", "z", "prediction", "id").agg(F.avg("ndcg")).first()[0] > 0.95


def test_graph(spark):
    edges = spark.createDataFrame([(0, 1, "in", 1.0, 1.0), (1, 2, "to", 1.0, 2.0), (2, 0, "in", 1.0, 3.0), (0, 0, "in", 1.0, 0.5)], "src long, dst long, rel string, weight double, ts double")
    assert gr.undirected(edges).count() == 7
    starts = spark.createDataFrame([(0,)], "node long")
    assert gr.metapath_walks(edges.where("src <> dst"), starts, ["in", "to"], 3).first()["path"] == [0, 1, 2]
    times = gr.temporal_walks(edges, starts, 5).first()["times"]
    assert times == sorted(set(times))
    walk = gr.walks(edges.where("src <> dst"), starts, 4).first()["path"]
    assert walk == [0, 1, 2, 0]
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "node long")
    got = gr.negative_edges(edges, nodes, 2)
    assert got.join(edges.select("src", F.col("dst").alias("negative")), ["src", "negative"]).count() == 0
    assert gr.invalid_metapath_steps([("a", "r", "b"), ("c", "s", "d")], [("a", "r", "b"), ("c", "s", "d")]) == [("c", "s", "d")]
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<double>")
    rows = spark.createDataFrame([(1,), (9,), (8,)], "id long")
    near = spark.createDataFrame([(9, 1), (9, 2)], "id long, neighbour long")
    assert {r["id"]: r["vec"] for r in gr.embedding_lookup(rows, table, neighbours=near, dim=2).collect()} == {1: [1, 0], 9: [0.5, 0.5], 8: [0, 0]}


def test_negatives_of_dense_sources(spark):
    nodes = spark.createDataFrame([(i * 3,) for i in range(25)], "node long")
    degree = {0: 23, 3: 24, 6: 25, 9: 1, 12: 12}
    links = {s: {(s * 5 + i * 7) % 25 * 3 for i in range(d)} for s, d in degree.items()}
    edges = spark.createDataFrame([(s, t) for s, ts in links.items() for t in ts] + [(9, 1000)], "src long, dst long")
    got = {}
    for r in gr.negative_edges(edges, nodes, 2).collect():
        got.setdefault((r["src"], r["dst"]), []).append(r["negative"])
    assert all(len(set(v)) == len(v) and not set(v) & links[s] and all(x % 3 == 0 and x < 75 for x in v) for (s, _), v in got.items())
    assert {k: len(v) for k, v in got.items()} == {(s, t): min(2, 25 - degree[s]) for s, ts in (links | {9: links[9] | {1000}}).items() for t in ts if degree[s] < 25}
    assert {x for (s, _), v in got.items() if s == 12 for x in v} <= {n * 3 for n in range(25)} - links[12]


def test_folds(spark):
    p = spark.createDataFrame([(i, float(i % 10), float(i // 10), i % 7) for i in range(100)], "id long, x double, y double, g int")
    by = fo.grouped_folds(p, "g", 3)
    assert by.select("g", "fold").distinct().count() == 7 and by.groupBy("fold").count().agg(F.max("count") - F.min("count")).first()[0] <= 20
    blocks = fo.spatial_blocks(p, 3, (4, 4))
    assert blocks.select("block", "fold").distinct().count() == 16
    near = fo.buffered_training(blocks, 0, 1.0)
    test = blocks.where("fold = 0").select(F.col("x").alias("a"), F.col("y").alias("b"))
    assert near.join(test, F.hypot(F.col("x") - F.col("a"), F.col("y") - F.col("b")) <= 1.0).count() == 0
    leak = spark.createDataFrame([(0, "a", "train"), (0, "a", "valid"), (0, "b", "train")], "fold int, g string, part string")
    assert [r["g"] for r in fo.leaking_groups(leak, "g").collect()] == ["a"]
    assert fo.environmental_folds(p, ["x", "y"], 2).select("fold").distinct().count() == 2


def greedy(sizes, folds):
    load, out = [0] * folds, []
    for n in sizes:
        f = min(range(folds), key=lambda i: (load[i], i))
        load[f] += n
        out.append(f)
    return out


def test_dealt_folds_are_greedy():
    rng = np.random.default_rng(3)
    for trial in range(400):
        folds, kinds = int(rng.integers(1, 7)), int(rng.integers(1, 7))
        counts = sorted({int(s): int(rng.integers(1, 60)) for s in rng.integers(1, [4, 40, 900][trial % 3], kinds)}.items(), reverse=True)
        got = [order[k % len(order)] for _, a, b, order in fo._deal(counts, folds) for k in range(b - a)]
        assert got == greedy([s for s, n in counts for _ in range(n)], folds)
        assert len(fo._deal(counts, folds)) <= folds * len(counts)


def test_folds_of_many_groups(spark):
    n = 100_001  # the greedy balance ended at 100,000 groups; one group here holds a third of all rows
    rows = spark.range(n).select(F.col("id").alias("g")).union(spark.range(n // 2).select(F.lit(77).cast("long").alias("g")))
    rows = rows.union(spark.createDataFrame([(None,), (None,), (5,)], "g long"))
    got = fo.grouped_folds(rows, "g", 5)
    table = {r["g"]: r["fold"] for r in got.select("g", "fold").distinct().collect()}
    size = {g: 1 for g in range(n)} | {77: 1 + n // 2, 5: 2, None: 2}
    order = sorted(size, key=lambda g: (-size[g], g is not None, g or 0))
    assert table == dict(zip(order, greedy([size[g] for g in order], 5), strict=True)) and got.count() == rows.count()
    assert fo.grouped_folds(rows.limit(0), "g", 5).count() == 0


def test_portfolio(spark):
    rows = spark.createDataFrame([(f"s{i}", float(i), 0.01 * i) for i in range(10)], "id string, score double, ret double")
    d = {r["id"]: r["weight"] for r in ra.extreme_decisions(rows, "score", "id").collect()}
    assert d["s9"] == d["s8"] == 0.25 and d["s0"] == d["s1"] == -0.25 and d["s5"] == 0
    s = ra.portfolio_summary(ra.extreme_decisions(rows, "score", "id")).first()
    assert s["gross"] == 1 and s["net_return"] == pytest.approx(0.25 * (0.17 - 0.01))


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    assert files.read_numeric_csv(spark, str(tmp_path / "a.csv"), ["x", "y"], "y").agg(F.sum("y")).first()[0] == 6
    (tmp_path / "b.csv").write_text("x,y\n1,oops\n")
    with pytest.raises(Exception):
        files.read_numeric_csv(spark, str(tmp_path / "b.csv"), ["x", "y"], "y").collect()
    (tmp_path / "c.tsf").write_text("# note\n@relation r\n@data\nT1:1990-01-01:1.5,2,?\nT2:1990-01-01:7\n")
    assert sorted((r["series_id"], r["step"], r["y"]) for r in files.read_tsf(spark, str(tmp_path / "c.tsf")).collect() if r["y"] is not None) == [("T1", 0, 1.5), ("T1", 1, 2.0), ("T2", 0, 7.0)]
    made = fc.predictions(fc.histories(panel(spark, a=[1, 2])), fc.naive, 2, "naive")
    for kind in ("parquet", "json", "csv"):
        files.write_forecast(made, str(tmp_path / f"f-{kind}"), {"note": 1}, kind)
        df, manifest = files.read_forecast(spark, str(tmp_path / f"f-{kind}"))
        assert manifest["rows"] == 2 and means(df) == [2, 2]
    with pytest.raises(ValueError, match="climb"):
        files.write_forecast(made, f"{tmp_path}/../x", {})
    files.write_embeddings(spark.createDataFrame([(1, [0.5])], "id long, vec array<double>"), str(tmp_path / "e"))
    assert files.read_embeddings(spark, str(tmp_path / "e"))[0].count() == 1
    assert files.ForecastConfig.parse("horizon = 7\nmodels = ['naive']\nnote = 'x'").extra == {"note": "x"}
    sales = spark.createDataFrame([("i", "s", 1, 2)], "item_id string, store_id string, d_1 int, d_2 int")
    calendar = spark.createDataFrame([("d_1", "2026-01-01", 1), ("d_2", "2026-01-02", 1)], "d string, date string, week int")
    prices = spark.createDataFrame([("i", "s", 1, 9.5)], "item_id string, store_id string, week int, price double")
    assert files.sales_panel(sales, calendar, prices).agg(F.sum("y"), F.sum("price")).first()[:] == (3.0, 19.0)
    quotes = spark.createDataFrame([("a", "2026-01-01", 10.0), ("a", "2026-01-03", 11.0)], "symbol string, d string, price double").select("symbol", F.to_date("d").alias("ts"), "price")
    assert [round(r["y"], 6) for r in files.return_panel(quotes).orderBy("ts").collect()] == [0.0, 0.1]


def test_scalars(spark):
    r = spark.range(1).select(pr.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"), pr.half_even(F.lit(2.5), 0).alias("h"), pr.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c"), geo_ids.zone_number(F.lit("00501-1234")).alias("z")).first()
    assert r["d"] == pytest.approx(6_371_000 * math.pi / 180) and r["h"] == 2 and r["c"] == 0 and r["z"] == 501
    assert pr.inverse_normal(0.975) == pytest.approx(1.959963984540054)


def test_boost_options(spark):
    rows = spark.createDataFrame([(float(i % 20), float(i // 20), float(i % 7), [i % 3, 10 + i % 5]) for i in range(400)], "x double, y double, h double, ids array<int>")
    rows = rows.withColumn("ids", F.col("ids").cast("array<bigint>")).withColumn("t", F.when(F.hypot(F.col("x") - 10, F.col("y") - 10) < 5, 10.0).otherwise(0.0))
    derived = bo.SplitFeatures.learn(rows, [("x", "y")], {"h": 7.0}, ["ids"], target="t")
    wide = derived.add(rows)
    model = bo.fit(wide, derived.names, "t", bo.BoostSpec(rounds=3, rate=1.0, depth=2, min_leaf=5))
    plain = bo.fit(rows, ["x", "y"], "t", bo.BoostSpec(rounds=3, rate=1.0, depth=2, min_leaf=5))
    loss = lambda m, d: m.transform(d).agg(F.avg(F.pow(F.col("prediction") - F.col("t"), 2))).first()[0]
    assert loss(model, wide) < 0.7 * loss(plain, rows)
    line = rows.withColumn("t", 3 * F.col("x") + 1)
    linear = bo.fit(line, ["y"], "t", bo.BoostSpec(rounds=1, rate=1.0, depth=1, min_leaf=5, linear=("x",), ridge=0.0))
    assert loss(linear, line) < 1e-12
    wave = rows.withColumn("t", F.sin(F.col("x")))
    up = bo.fit(wave, ["x"], "t", bo.BoostSpec(rounds=5, rate=0.5, depth=3, min_leaf=5, monotone=(("x", 1),)))
    p = [r["prediction"] for r in up.transform(spark.range(20).select(F.col("id").cast("double").alias("x"))).orderBy("x").collect()]
    assert all(b >= a - 1e-12 for a, b in zip(p, p[1:], strict=False))


def test_global_forecasts(spark):
    from gridloom.operators import global_forecast as gf

    p = panel(spark, a=[1.0, 2, 3, 4] * 7, b=[10.0, 20, 30, 40] * 7)
    spec, boost = gf.LagSpec(lags=(1, 4)), gf.BoostSpec(rounds=4, rate=1.0, depth=3, min_leaf=2, bins=16)
    made = gf.lag_boost_forecast(p, 4, spec, boost, mode="seasonal_delta", season=4)
    assert means(made) == pytest.approx([1, 2, 3, 4]) and means(made, "b") == pytest.approx([10, 20, 30, 40])
    model = bo.fit(gf.training_rows(p, spec), spec.names(), "label", boost)
    one = gf.recursive_predictions(p, model, spec, 1)
    from gridloom.operators.lags import next_step

    future = p.groupBy("series_id").agg((F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    want = {r["series_id"]: r["m"] for r in next_step(p, spec, future).withColumn("m", model.margin()).collect()}
    assert {r["series_id"]: r["mean"] for r in one.collect()} == pytest.approx(want)
    assert gf.choose_candidate({"a": 1.0, "b": float("nan"), "c": 0.999}, "a") == "a" and gf.choose_candidate({"a": 1.0, "c": 0.5}, "a") == "c"
    with pytest.raises(ValueError, match="registered"):
        gf.register("naive", lambda p, h: p)
    assert gf.forecaster("theta")(p, 2).count() == 4
    z, stats = gf.scaled(p)
    assert gf.unscaled(fc.predictions(fc.histories(z), fc.naive, 1, "n"), stats).where("series_id = 'b'").first()["mean"] == pytest.approx(40)
    places = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0)], "series_id string, x double, y double")
    assert means(gf.kriged_levels(p, places, 2, 1.0)) == pytest.approx([4, 4], abs=1e-4)


def test_ingest(spark):
    import duckdb
    import pandas as pd

    from gridloom.sources import ingest

    for values in (pd.DataFrame({"a": [1.0, 2.0]}), {"a": [1.0, 2.0]}, duckdb.sql("select unnest([1.0::double, 2.0]) as a"), np.array([[1.0], [2.0]])):
        df = ingest.to_frame(spark, values, ["a"])
        assert df.columns == ["a"] and df.agg(F.sum("a")).first()[0] == 3
    with pytest.raises(ValueError, match="unique"):
        ingest.FeatureSchema(("a", "a"), ("numeric", "numeric")).check()
    with pytest.raises(ValueError, match="periods"):
        ingest.FeatureSchema(("a",), ("periodic",)).check()
    with pytest.raises(Exception, match="negative"):
        ingest.check_weights(spark.createDataFrame([(-1.0,)], "w double"), "w").collect()


def test_command_line(spark, tmp_path, capsys):
    from gridloom.__main__ import main

    (tmp_path / "d.csv").write_text("x,y\n" + "\n".join(f"{i},{2 * (i > 20)}" for i in range(60)))
    m = str(tmp_path / "model")
    assert main(["train", "--model", m, "--data", str(tmp_path / "d.csv"), "--target", "y", "--rounds", "2", "--rate", "1"]) == 0
    assert main(["evaluate", "--model", m, "--data", str(tmp_path / "d.csv"), "--target", "y"]) == 0
    assert json.loads(capsys.readouterr().out)["rmse"] < 0.3
    main(["inspect", "--model", m])
    assert "x <=" in capsys.readouterr().out
    (tmp_path / "p.csv").write_text("t,v\n" + "\n".join(f"2026-01-{i + 1:02d},{i % 7}" for i in range(28)))
    (tmp_path / "c.toml").write_text("horizon = 7\nmodels = ['seasonal_naive', 'naive']\nfolds = 1\n")
    common = ["--data", str(tmp_path / "p.csv"), "--timestamp", "t", "--target", "v", "--config", str(tmp_path / "c.toml")]
    main(["backtest", *common])
    assert json.loads(capsys.readouterr().out.splitlines()[0])["mae"] == 0
    main(["forecast", *common, "--out", str(tmp_path / "out")])
    assert files.read_forecast(spark, str(tmp_path / "out"))[0].count() == 14


def test_layer_training(spark):
    rng = np.random.default_rng(0)
    x, m = rng.normal(size=(6, 3)), rng.normal(size=(6, 3))
    own, near, bias = rng.normal(size=(2, 3)), rng.normal(size=(2, 3)), rng.normal(size=2)
    args = (x[:3], m[:3], x[3:], m[3:], np.array([1.0, 0.0, 1.0]))
    loss = lambda o: ke.layer_step(o, near, bias, *args, 0.0)[3]
    grad = own - ke.layer_step(own, near, bias, *args, 1.0)[0]
    for i, j in ((0, 0), (1, 2)):
        step = np.zeros_like(own)
        step[i, j] = 1e-6
        assert grad[i, j] == pytest.approx((loss(own + step) - loss(own - step)) / 2e-6, abs=1e-6)
    nodes = spark.createDataFrame([(i, [1.0 if i < 5 else 0.0, 0.0 if i < 5 else 1.0, 0.1 * i]) for i in range(10)], "id long, vec array<double>")
    near_pairs = spark.createDataFrame([(i, j) for i in range(10) for j in range(10) if i != j and (i < 5) == (j < 5)], "src long, dst long")
    far_pairs = spark.createDataFrame([(i, j) for i in range(5) for j in range(5, 10)], "src long, dst long")
    links = near_pairs.select(F.col("src").alias("node"), F.col("dst").alias("id"))
    own, near, bias, losses = ke.train_layer(links, nodes, near_pairs, far_pairs, dim=8, epochs=6, parts=2)
    out = gr.sage_layer(links, nodes, own, near, bias)
    auc = me.roc_auc(gr.link_scores(near_pairs.withColumn("y", F.lit(1)).union(far_pairs.withColumn("y", F.lit(0))), out))
    assert losses[-1] < losses[0] and auc.first()[0] > 0.9
