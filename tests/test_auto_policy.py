"""Which candidates the automatic forecaster tries, what it weighs them by, and what it gives."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import global_forecast as gf
from gridloom.operators.boost import BoostSpec

SMALL = {"boost": BoostSpec(rounds=2, rate=0.5, depth=2, min_leaf=2, bins=8), "lags": gf.LagSpec(lags=(1, 2), roll_mean=(2,))}


def panel(spark, **series):
    rows = [(k, i, float(v)) for k, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, i int, y double").select("series_id", F.expr("timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, i)").alias("ts"), "y")


def tried(fit):
    return {r["model"] for r in fit.scores.select("model").distinct().collect()}


def test_trend_gets_a_guarded_hybrid(spark):
    fit = gf.auto_fit(panel(spark, a=[10 + d for d in range(1, 31)]), 2, gf.AutoSpec(validation=2, objective="rmse", **SMALL))
    rows = fit.forecast.orderBy("horizon").collect()
    assert [r["horizon"] for r in rows] == [1, 2] and all(r["mean"] >= 0 for r in rows) and fit.nonnegative
    assert 7 in fit.lags.lags and {"lag_boost", "recency_weighted_lag", "log1p_lag", "naive", "drift"} <= tried(fit)
    w = {r["model"]: r["weight"] for r in fit.weights.collect()}
    assert sum(w.values()) == pytest.approx(1.0) and set(w) <= tried(fit)
    assert {r["horizon"] for r in fit.step_weights.collect()} == {1, 2}
    whole = fit.scores.where("series_id is null and horizon is null")
    assert whole.count() >= len(w) and fit.scores.where("horizon = 1").count() == whole.count()
    # a straight line: drift is exact, so it weighs alone, and the forecast goes on with it
    assert w == {"drift": 1.0} and [r["mean"] for r in rows] == pytest.approx([41.0, 42.0])


def test_candidates_follow_the_targets(spark):
    names = lambda *y: set(gf.auto_candidates(panel(spark, a=y[0]), gf.AutoSpec(**SMALL))[0])
    assert "log1p_lag" not in names([d - 10 for d in range(18)]) and "log1p_lag" in names(range(18))
    assert "intermittent" in names([0, 0, 3, 0] * 6) and "intermittent" not in names([0, 2, 3, 4] * 6) and "intermittent" not in names([0, 0, -3, 0] * 6)
    negative = gf.auto_fit(panel(spark, a=[d - 10 for d in range(18)]), 2, gf.AutoSpec(season=2, **SMALL))
    assert not negative.nonnegative and "log1p_lag" not in tried(negative)


def test_sparse_demand_is_scored_and_stays_positive(spark):
    fit = gf.auto_fit(panel(spark, a=[0, 0, 5, 0, 0, 0, 4, 0] * 4), 3, gf.AutoSpec(**SMALL))
    assert fit.scores.where("model = 'intermittent'").count() > 0 and fit.forecast.where("mean < 0").count() == 0


def test_series_weights_need_support(spark):
    two = panel(spark, one=[10 + d for d in range(28)], two=[5, 6, 7, 8, 9, 10, 11] * 4)
    enough = gf.auto_fit(two, 2, gf.AutoSpec(origins=2, validation=2, objective="rmse", **SMALL))
    best = {r["series_id"]: r["model"] for r in enough.series_weights.orderBy("weight").collect()}
    assert set(best) == {"one", "two"} and best["one"] == "drift" and enough.forecast.count() == 4
    got = {(r["series_id"], r["horizon"]): r["mean"] for r in enough.forecast.collect()}
    assert got["one", 1] == pytest.approx(38.0) and got["two", 1] == pytest.approx(5.0, abs=0.5)
    thin = gf.auto_fit(two, 2, gf.AutoSpec(origins=1, validation=2, objective="rmse", **SMALL))
    assert thin.series_weights.count() == 0 and thin.scores.where("series_id is not null").count() > 0 and thin.forecast.count() == 4


def test_unsupported_lags_are_pruned(spark):
    fit = gf.auto_fit(panel(spark, a=[float(d % 3) for d in range(12)]), 2, gf.AutoSpec(season=2, validation=2, lags=gf.LagSpec(lags=(28,)), boost=SMALL["boost"]))
    assert fit.lags.lags == (2,) and fit.scores.where("model = 'lag_boost'").count() > 0


def test_settings_are_checked():
    for bad in ({"objective": "no"}, {"origins": 0}, {"season": 0}, {"validation": 0}):
        with pytest.raises(ValueError, match=r"\w"):
            gf.AutoSpec(**bad)
