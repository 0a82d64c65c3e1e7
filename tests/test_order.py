"""Places, running sums and nearest points against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import boost as bo
from gridloom.operators import kernels as ke
from gridloom.operators import metrics as me
from gridloom.operators import ranking as ra
from gridloom.operators import spatial as sp
from gridloom.operators.order import placed, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, int(v), float(w)) for i, (v, w) in enumerate(zip(rng.integers(0, 40, 500), rng.random(500), strict=True))]
    return data, spark.createDataFrame(data, "id int, v int, w double").repartition(7).cache()


def test_places_and_sums(rows):
    data, df = rows
    order = sorted(data, key=lambda r: (-r[1], r[0]))
    got = {r["id"]: r for r in running(placed(df, [F.col("v").desc(), "id"]), [F.col("v").desc(), "id"], {"total": F.col("w"), "k": F.lit(1)}).collect()}
    total = 0.0
    for k, (i, _, w) in enumerate(order, 1):
        total += w
        assert got[i]["place"] == got[i]["k"] == k and got[i]["total"] == pytest.approx(total)
    assert placed(df.limit(0), ["id"]).count() == running(df.limit(0), ["id"], {"k": F.lit(1)}).count() == 0


def test_without_groups_as_with_one(rows):
    """Each operator gives over a whole table what it gives for a single group."""
    _, df = rows
    one = df.withColumn("g", F.lit(1)).withColumn("y", (F.col("v") % 3 == 0).cast("int")).withColumn("mean", F.col("w"))
    pairs = [
        (me.volatility(one, ["v", "id"]), me.volatility(one, ["v", "id"], ["g"])), (me.roc_auc(one, score="v"), me.roc_auc(one, ["g"], score="v")),
        (me.average_precision(one, score="v"), me.average_precision(one, ["g"], score="v")), (bo.weighted_quantile(one, "v", "w", 0.3), bo.weighted_quantile(one, "v", "w", 0.3, ["g"])),
        (ra.rank_buckets(one, "v", 7, "id").select("id", "bucket"), ra.rank_buckets(one, "v", 7, "id", ["g"]).select("id", "bucket")),
        (ra.extreme_decisions(one, "v", "id").select("id", "weight"), ra.extreme_decisions(one, "v", "id", ["g"]).select("id", "weight")),
    ]
    for whole, grouped in pairs:
        a, b = (sorted(tuple(r) for r in d.drop("g").collect()) for d in (whole, grouped))
        assert np.array(a) == pytest.approx(np.array(b))


def test_horizon_rollup_by_loops(spark):
    rng = np.random.default_rng(3)
    data = [(f"s{i % 9}", i // 9 % 4 + 1, i, float(rng.normal()), float(rng.normal())) for i in range(200)]
    got = {r["horizon"]: (r["mae"], r["rmse"]) for r in me.horizon_rollup(spark.createDataFrame(data, "series_id string, horizon int, ts int, y double, mean double"), 0.2).collect()}
    order = sorted(data, key=lambda r: (r[1], r[0], r[2]))
    for h in (1, 2, 3, 4):
        end = max(k for k, r in enumerate(order) if r[1] == h)
        e = np.array([r[4] - r[3] for r in order[max(end - 39, 0) : end + 1]])
        assert got[h] == pytest.approx((np.abs(e).mean(), np.sqrt((e**2).mean())))


@pytest.mark.parametrize("kind", ["even", "crowded", "line", "few", "one place"])
def test_nearest_points_by_loops(spark, kind):
    rng = np.random.default_rng(5)
    xy = {"even": rng.random((150, 2)) * 100, "crowded": np.vstack([rng.random((140, 2)) * 1e-3, rng.random((10, 2)) * 1e4]), "line": np.column_stack([np.arange(60.0), np.zeros(60)]), "few": rng.random((3, 2)), "one place": np.zeros((20, 2))}[kind]
    points = spark.createDataFrame([(i, float(x), float(y), float(i)) for i, (x, y) in enumerate(xy)], "id int, x double, y double, value double")
    p = points.select(F.col("id").alias("p_id"), F.col("x").alias("p_x"), F.col("y").alias("p_y"), "value")
    for apart in (False, True):
        got = {}
        for r in sp.nearest(p, points, 5, apart).collect():
            got.setdefault(r["id"], {})[r["r"]] = r["p_id"]
        for i, a in enumerate(xy):
            d = [(float(np.hypot(*(a - b))), j) for j, b in enumerate(xy) if not (apart and i == j)]
            assert [got[i][k + 1] for k in range(min(5, len(d)))] == [j for _, j in sorted(d)[:5]]
    assert sp.nearest(p.limit(0), points, 5).count() == sp.nearest(p, points.limit(0), 5).count() == 0


def test_left_out_residuals(spark):
    rng = np.random.default_rng(9)
    xy = rng.random((25, 2)) * 10
    v = xy[:, 0] * 2 - xy[:, 1]
    points = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(xy, v, strict=True))], "id int, x double, y double, value double")
    for radius in (None, 4.0):
        got = {r["id"]: r for r in sp.leave_one_out(points, 3.0, neighbours=6, radius=radius).collect()}
        for i in range(25):
            near = sorted((float(np.hypot(*(xy[i] - xy[j]))), j) for j in range(25) if j != i and (radius is None or np.hypot(*(xy[i] - xy[j])) <= radius))[:6]
            if near:
                js = [j for _, j in near]
                mean, var = sp.solve_kriging(xy[js], v[js], xy[i], 3.0, 1e-9, 1.0, "exponential", False)
                assert (got[i]["mean"], got[i]["variance"], got[i]["residual"]) == pytest.approx((mean, var, v[i] - mean), abs=1e-8)


def test_zones_in_metres(spark):
    """Without a cell size, zones of any extent lie in a few grid cells."""
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    zones = spark.createDataFrame([(f"z{i}", i, ring(i * 2e6, 0.0, 1e6)) for i in range(5)], "id string, ord int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(i, i * 2e6 + 5e5, 5e5) for i in range(5)], "id int, x double, y double")
    before, sp.MAX_ZONES = sp.MAX_ZONES, 2
    try:
        assert {r["id"]: r["z_id"] for r in sp.locate(points, zones).collect()} == {i: f"z{i}" for i in range(5)}
    finally:
        sp.MAX_ZONES = before


def test_embedding_rounds_and_network_parts(spark):
    rows = spark.createDataFrame([(i % 9, float(i % 9) * 2 + i % 4) for i in range(900)], "k int, y double")
    one, many = (ke.embedding_table(rows, "k", "y", 3, rounds=n).orderBy("id").collect() for n in (1, 20))
    # each id is one number times the head, so the head's direction settles at once, however many rounds are asked for
    assert [r["id"] for r in many] == list(range(9)) and np.array([r["vec"] for r in one]) == pytest.approx(np.array([r["vec"] for r in many]))
    days = spark.range(80).select(F.expr("timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("ts"), (10 + F.col("id") % 4).cast("double").alias("y"))
    panel = days.withColumn("series_id", F.lit("a"))
    whole, parts = (sorted((r["horizon"], r["mean"]) for r in ke.window_network(panel, 4, part_windows=n).collect()) for n in (1000, 20))
    assert len(whole) == len(parts) == 4 and all(abs(a[1] - b[1]) < 3 for a, b in zip(whole, parts, strict=True)) and all(8 < m < 15 for _, m in parts)


def test_written_piecewise_models_forecast_alike(spark, tmp_path):
    days = spark.range(60).select(F.expr("timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("ts"), (10 + F.col("id") % 7 + F.col("id") / 5).cast("double").alias("y"))
    panel = days.withColumn("series_id", F.lit("a")).unionByName(days.withColumn("series_id", F.lit("b")).withColumn("y", 50 - F.col("y")))
    for spec in (ke.PiecewiseSpec(), ke.PiecewiseSpec(changepoints=3, huber=1.0, growth="logistic", cap=90.0)):
        path = str(tmp_path / f"models{spec.changepoints}")
        ke.piecewise_models(panel, spec).write.parquet(path)
        again = ke.piecewise_from_models(spark.read.parquet(path), 5)
        key = ["series_id", "horizon"]
        a, b = (sorted(map(tuple, d.drop("model").select(*key, "ts", "mean", "trend", "weekly", "lower", "upper").collect())) for d in (again, ke.piecewise_forecast(panel, 5, spec)))
        assert len(a) == 10 and all(x[:3] == y[:3] and x[3:] == pytest.approx(y[3:]) for x, y in zip(a, b, strict=True))
    with pytest.raises(ValueError, match="version"):
        ke.piecewise_of_text('{"version": 2}')
