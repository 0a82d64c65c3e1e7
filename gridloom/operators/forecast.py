"""Forecasters as expressions: each series is one row with its history as an array, recursions are folds over it.

``histories`` turns a panel into that form with one shuffle; from there every model is a projection (no further shuffle, no
Python), and ``predictions`` explodes the steps. Grids are arrays of structs that are scored in the same row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.calendar import advance

ZERO = 0.0


def histories(panel: DataFrame) -> DataFrame:
    """series_id, n, last_ts and y (array by time)."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "y")))
    return panel.groupBy("series_id").agg(rows.alias("h")).select("series_id", F.size("h").alias("n"), F.element_at("h", -1)["ts"].alias("last_ts"), F.transform("h", lambda r: r["y"]).alias("y"))


def predictions(hist: DataFrame, mean: Callable[[Column], Column], horizon: int, model: str, frequency: str = "D") -> DataFrame:
    """series_id, ts, horizon, model, mean: ``mean`` takes the step (from 1)."""
    if horizon < 1:
        raise ValueError("a horizon of one step or more is needed")
    steps = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda s: F.struct(s.alias("horizon"), mean(s).cast("double").alias("mean")))
    rows = hist.select("series_id", "last_ts", F.explode(steps).alias("s"))
    return rows.select("series_id", advance(F.col("last_ts"), frequency, F.col("s.horizon")).alias("ts"), "s.horizon", F.lit(model).alias("model"), "s.mean")


def at(array: Column | str, index: Column) -> Column:
    """Element by index from 0; null outside."""
    return F.get(F.col(array) if isinstance(array, str) else array, index.cast("int"))


def mean_of(array: Column) -> Column:
    return F.aggregate(array, F.lit(ZERO), lambda a, v: a + v) / F.size(array)


def naive(step: Column) -> Column:
    return F.element_at("y", -1)


def seasonal_naive(season: int) -> Callable[[Column], Column]:
    """The value a season back; the season is at most the history."""
    m = F.least(F.lit(season), F.col("n"))
    return lambda s: at("y", F.col("n") - m + F.pmod(s - 1, m))


def window_average(window: int) -> Callable[[Column], Column]:
    w = F.least(F.lit(window), F.col("n"))
    return lambda s: mean_of(F.slice("y", F.col("n") - w + 1, w))


def seasonal_window_average(season: int, cycles: int) -> Callable[[Column], Column]:
    """Mean of the step's phase over the last cycles (at most those the history holds, one at least)."""
    m = F.least(F.lit(season), F.col("n"))
    c = F.greatest(F.least(F.lit(cycles), F.floor(F.col("n") / m)), F.lit(1)).cast("int")
    return lambda s: mean_of(F.transform(F.sequence(F.lit(1), c), lambda k: at("y", F.col("n") - k * m + F.pmod(s - 1, m))))


def drift(step: Column) -> Column:
    y, n = F.col("y"), F.col("n")
    return F.element_at(y, -1) + F.when(n > 1, step * (F.element_at(y, -1) - F.get(y, F.lit(0))) / F.greatest(n - 1, F.lit(1))).otherwise(ZERO)


def slope(y: Column) -> Column:
    """Least-squares slope over positions 0, 1, ...; 0 for one value."""
    n = F.size(y)
    mid, mean = (n - 1) / 2.0, mean_of(y)
    num = F.aggregate(F.transform(y, lambda v, i: (i - mid) * (v - mean)), F.lit(ZERO), lambda a, v: a + v)
    den = n * (n.cast("double") * n - 1) / 12.0
    return F.when(den > 0, num / F.nullif(den, F.lit(0.0))).otherwise(ZERO)


def ses_level(y: Column, alpha: Column | float) -> Column:
    """Exponential smoothing, seeded by the first value."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.aggregate(y, F.get(y, F.lit(0)), lambda s, v: a * v + (1 - a) * s)


def season_pattern(y: Column, season: int, multiplicative: bool = False) -> Column:
    """Means by phase, centred to 0 (or scaled to a mean of 1)."""
    means = F.transform(F.sequence(F.lit(0), F.lit(season - 1)), lambda k: mean_of(F.filter(y, lambda v, i: F.pmod(i, F.lit(season)) == k)))
    if not multiplicative:
        centre = mean_of(means)
        return F.transform(means, lambda v: v - centre)
    ratio = F.transform(means, lambda v: v / mean_of(y))
    return F.transform(ratio, lambda v: v / mean_of(ratio))


def with_season(hist: DataFrame, season: int | None, multiplicative: bool = False) -> DataFrame:
    """Adds ``adj`` (the deseasonalised history) and ``pattern``; no season unless every series has two cycles."""
    short = season is None or season < 2 or (hist.agg(F.min("n")).first()[0] or 0) < 2 * season
    if short:
        return hist.withColumn("adj", F.col("y")).withColumn("pattern", F.array(F.lit(1.0 if multiplicative else 0.0)))
    rows = hist.withColumn("pattern", season_pattern(F.col("y"), season, multiplicative))
    p = lambda i: at("pattern", F.pmod(i, F.lit(season)))
    return rows.withColumn("adj", F.transform("y", lambda v, i: v / p(i) if multiplicative else v - p(i)))


def theta_forecast(panel: DataFrame, horizon: int, theta: float = 2.0, alpha: float = 0.3, season: int | None = None, multiplicative: bool = False, frequency: str = "D", model: str = "theta") -> DataFrame:
    """Smoothed level plus (1 - 1 / theta) of the trend a step, with the season put back."""
    hist = with_season(histories(panel), season, multiplicative)
    hist = hist.withColumn("level", ses_level(F.col("adj"), alpha)).withColumn("slope", slope(F.col("adj")))
    phase = lambda s: at("pattern", F.pmod(F.col("n") + s - 1, F.size("pattern")))
    base = lambda s: F.col("level") + (1 - 1 / theta) * F.col("slope") * s
    return predictions(hist, lambda s: base(s) * phase(s) if multiplicative else base(s) + phase(s), horizon, model, frequency)


def theta_mse(panel: DataFrame, alphas: Sequence[float], season: int | None = None) -> DataFrame:
    """Pooled mean squared one-step residual (all but the first row) by alpha; it doesn't depend on theta."""
    hist = with_season(histories(panel), season).withColumn("slope", slope(F.col("adj"))).withColumn("mid", mean_of(F.col("adj")) - F.col("slope") * (F.col("n") - 1) / 2)
    grid = hist.withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in alphas))))
    start = F.struct(F.get("adj", F.lit(0)).alias("level"), F.lit(ZERO).alias("sse"), F.lit(0).alias("i"))

    def step(a: Column, v: Column) -> Column:
        fit = 0.5 * (a["level"] + F.col("mid") + F.col("slope") * a["i"])
        return F.struct((F.col("alpha") * v + (1 - F.col("alpha")) * a["level"]).alias("level"), (a["sse"] + F.when(a["i"] > 0, (v - fit) * (v - fit)).otherwise(ZERO)).alias("sse"), (a["i"] + 1).alias("i"))

    scored = grid.withColumn("s", F.aggregate("adj", start, step))
    return scored.groupBy("alpha").agg((F.sum("s.sse") / F.sum(F.col("n") - 1)).alias("mse"))


def optimized_theta(panel: DataFrame, horizon: int, thetas: Sequence[float] = (1.5, 2.0, 3.0), alphas: Sequence[float] = (0.1, 0.3, 0.5, 0.8), season: int | None = None, frequency: str = "D") -> DataFrame:
    """The grid's smallest pooled error; ties to the smaller theta, then alpha (the error is the same for all thetas)."""
    alpha = theta_mse(panel, alphas, season).agg(F.min_by("alpha", F.struct("mse", "alpha"))).first()[0]
    return theta_forecast(panel, horizon, min(thetas), alpha, season, frequency=frequency, model="optimized_theta")


def damped(phi: Column, step: Column) -> Column:
    return F.when(F.abs(phi - 1) <= 2.3e-16, step.cast("double")).otherwise(phi * (1 - F.pow(phi, step)) / F.nullif(1 - phi, F.lit(0.0)))


def ets_state(hist: DataFrame, season: int | None, seasonal: bool = True) -> DataFrame:
    """Runs the level / damped trend / additive season recursion of each row's ``alpha, beta, gamma, phi``; adds ``state``
    (level, trend, season array, sse of one-step residuals, count)."""
    use = season if season and season > 1 and (hist.agg(F.min("n")).first()[0] or 0) >= 2 * season else None
    pattern = season_pattern(F.col("y"), use) if use else F.array(F.lit(0.0))
    hist = hist.withColumn("pattern", pattern)
    m = use or 1
    y, p, n = F.col("y"), F.col("pattern"), F.col("n")
    seasonal_trend = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: (at(y, i + m) - at(y, i)) / m), F.lit(ZERO), lambda a, v: a + v) / m
    first = F.when(n > m, seasonal_trend) if use else F.when(n > 1, at(y, F.lit(1)) - at(y, F.lit(0)))
    start = F.struct((at(y, F.lit(0)) - at(p, F.lit(0))).alias("level"), F.coalesce(first, F.lit(ZERO)).alias("trend"), p.alias("s"), F.lit(ZERO).alias("sse"), F.lit(1).alias("i"))

    def step(a: Column, v: Column) -> Column:
        k = F.pmod(a["i"], F.lit(m))
        s = at(a["s"], k)
        base = a["level"] + F.col("phi") * a["trend"]
        fit = base + s
        level = F.col("alpha") * (v - s) + (1 - F.col("alpha")) * base
        trend = F.col("beta") * (level - a["level"]) + (1 - F.col("beta")) * F.col("phi") * a["trend"]
        moved = F.transform(a["s"], lambda x, j: F.when(j == k, F.col("gamma") * (v - level) + (1 - F.col("gamma")) * x).otherwise(x)) if use else a["s"]
        return F.struct(level.alias("level"), trend.alias("trend"), moved.alias("s"), (a["sse"] + (v - fit) * (v - fit)).alias("sse"), (a["i"] + 1).alias("i"))

    return hist.withColumn("state", F.aggregate(F.slice("y", 2, 1_000_000_000), start, step))


def ets_forecast(panel: DataFrame, horizon: int, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1, phi: float = 1.0, season: int | None = None, frequency: str = "D", model: str = "ets") -> DataFrame:
    hist = histories(panel)
    for name, value in (("alpha", alpha), ("beta", beta), ("gamma", gamma), ("phi", phi)):
        hist = hist.withColumn(name, F.lit(float(value)))
    hist = ets_state(hist, season)
    phase = lambda s: at("state.s", F.pmod(F.col("n") + s - 1, F.size("state.s")))
    return predictions(hist, lambda s: F.col("state.level") + damped(F.col("phi"), s) * F.col("state.trend") + phase(s), horizon, model, frequency)


def ets_grid(panel: DataFrame, grid: Sequence[tuple[float, float, float, float]], season: int | None = None) -> DataFrame:
    """Pooled one-step mean squared error of each (alpha, beta, gamma, phi)."""
    points = F.array(*(F.struct(*(F.lit(float(v)).alias(k) for v, k in zip(g, ("alpha", "beta", "gamma", "phi"), strict=True))) for g in grid))
    hist = histories(panel).withColumn("g", F.explode(points)).select("*", "g.*").drop("g")
    return ets_state(hist, season).groupBy("alpha", "beta", "gamma", "phi").agg(F.coalesce(F.sum("state.sse") / F.nullif(F.sum(F.col("n") - 1), F.lit(0)), F.lit(ZERO)).alias("mse"))


def auto_ets(panel: DataFrame, horizon: int, season: int | None = None, alphas: Sequence[float] = (0.2, 0.5, 0.8), betas: Sequence[float] = (0.0, 0.1, 0.3), gammas: Sequence[float] = (0.1, 0.3), phis: Sequence[float] = (0.9, 1.0), frequency: str = "D") -> DataFrame:
    """The grid's smallest error; ties by alpha, beta, phi, gamma."""
    grid = [(a, b, g, p) for a in alphas for b in betas for p in phis for g in (gammas if season else (0.0,))]
    best = ets_grid(panel, grid, season).orderBy("mse", "alpha", "beta", "phi", "gamma").first()
    return ets_forecast(panel, horizon, best["alpha"], best["beta"], best["gamma"], best["phi"], season, frequency, "auto_ets")


# --- intermittent demand ---------------------------------------------------------------------------------------------


def croston_level(y: Column, alpha: float) -> Column:
    """Smoothed demand over smoothed interval; null without any demand."""
    start = F.struct(F.lit(None).cast("double").alias("d"), F.lit(ZERO).alias("g"), F.lit(0).alias("e"))

    def step(a: Column, v: Column) -> Column:
        e = a["e"] + 1
        first = a["d"].isNull()
        d = F.when(v > 0, F.when(first, v).otherwise(a["d"] + alpha * (v - a["d"]))).otherwise(a["d"])
        g = F.when(v > 0, F.when(first, e.cast("double")).otherwise(a["g"] + alpha * (e - a["g"]))).otherwise(a["g"])
        return F.struct(d.alias("d"), g.alias("g"), F.when(v > 0, 0).otherwise(e).alias("e"))

    s = F.aggregate(y, start, step)
    return s["d"] / F.nullif(s["g"], F.lit(0.0))


def sba_level(y: Column, alpha: float) -> Column:
    return croston_level(y, alpha) * (1 - alpha / 2)


def tsb_level(y: Column, alpha: float, beta: float) -> Column:
    """Smoothed probability of demand times smoothed demand."""
    first = F.get(F.filter(y, lambda v: v > 0), F.lit(0))
    start = F.struct(first.alias("d"), F.lit(ZERO).alias("p"))
    s = F.aggregate(y, start, lambda a, v: F.struct(F.when(v > 0, a["d"] + alpha * (v - a["d"])).otherwise(a["d"]).alias("d"), (a["p"] + beta * (F.when(v > 0, 1.0).otherwise(0.0) - a["p"])).alias("p")))
    return s["d"] * s["p"]


def adida_level(y: Column, alpha: float, bucket: int) -> Column:
    """Croston over sums of blocks, per row of a block."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(y) / bucket).cast("int") - 1), lambda k: F.aggregate(F.slice(y, k * bucket + 1, F.lit(bucket)), F.lit(ZERO), lambda a, v: a + v))
    return croston_level(blocks, alpha) / bucket


#: in the order that decides ties
INTERMITTENT: dict[str, Callable[[Column, float, float, int], Column]] = {
    "croston": lambda y, a, b, k: croston_level(y, a), "sba": lambda y, a, b, k: sba_level(y, a),
    "tsb": lambda y, a, b, k: tsb_level(y, a, b), "adida": lambda y, a, b, k: adida_level(y, a, k),
}


def intermittent_forecast(panel: DataFrame, horizon: int, method: str, alpha: float = 0.2, beta: float = 0.2, bucket: int = 7, frequency: str = "D") -> DataFrame:
    """A flat forecast at the method's level; a negative target is an error, a series without demand forecasts 0."""
    hist = histories(panel).withColumn("y", F.when(F.exists("y", lambda v: v < 0), F.raise_error(F.lit("negative demand")).cast("array<double>")).otherwise(F.col("y")))
    level = F.lit(ZERO) if method == "zero" else F.greatest(F.coalesce(INTERMITTENT[method](F.col("y"), alpha, beta, bucket), F.lit(ZERO)), F.lit(ZERO))
    return predictions(hist.withColumn("level", level), lambda s: F.col("level"), horizon, method, frequency)


def wape_of(actual: Column, level: Column) -> Column:
    err = F.aggregate(actual, F.lit(ZERO), lambda a, v: a + F.abs(v - level))
    total = F.aggregate(actual, F.lit(ZERO), lambda a, v: a + F.abs(v))
    return F.when(total > 0, err / F.nullif(total, F.lit(0.0))).otherwise(ZERO)


def intermittent_selector(panel: DataFrame, holdout: int, alpha: float = 0.2, beta: float = 0.2, bucket: int = 7) -> DataFrame:
    """By series: the method of smallest holdout WAPE (ties to 9 digits: croston, sba, tsb, adida), its loss, its level on all rows."""
    hist = histories(panel)
    train, test = F.slice("y", 1, F.greatest(F.col("n") - holdout, F.lit(1))), F.slice("y", F.greatest(F.col("n") - holdout, F.lit(1)) + 1, F.lit(holdout))
    tried = [F.struct(F.coalesce(F.round(wape_of(test, f(train, alpha, beta, bucket)), 9), F.lit(float("inf"))).alias("loss"), F.lit(i).alias("i"), F.lit(name).alias("method"), F.greatest(F.coalesce(f(F.col("y"), alpha, beta, bucket), F.lit(ZERO)), F.lit(ZERO)).alias("level")) for i, (name, f) in enumerate(INTERMITTENT.items())]
    best = F.array_min(F.array(*tried))
    empty = F.forall("y", lambda v: v == 0)
    return hist.withColumn("b", best).select(
        "series_id", F.when(empty, "zero").otherwise(F.col("b.method")).alias("method"), F.when(empty, ZERO).otherwise(F.col("b.loss")).alias("loss"), F.when(empty, ZERO).otherwise(F.col("b.level")).alias("level")
    )


# --- state space -----------------------------------------------------------------------------------------------------


def kalman_level(y: Column, q: Column | float, r: Column | float) -> Column:
    """Local level filter: struct of level, variance, log-likelihood and squared innovations after the last value."""
    q, r = (v if isinstance(v, Column) else F.lit(float(v)) for v in (q, r))
    start = F.struct(F.get(y, F.lit(0)).alias("level"), r.alias("var"), F.lit(ZERO).alias("ll"), F.lit(ZERO).alias("sse"))

    def step(a: Column, v: Column) -> Column:
        prior, e = a["var"] + q, v - a["level"]
        s = prior + r
        k = prior / s
        return F.struct((a["level"] + k * e).alias("level"), ((1 - k) * prior).alias("var"), (a["ll"] - 0.5 * (math.log(2 * math.pi) + F.ln(s) + e * e / s)).alias("ll"), (a["sse"] + e * e).alias("sse"))

    return F.aggregate(F.slice(y, 2, 1_000_000_000), start, step)


def kalman_smoothed(y: Column, q: float, r: float) -> Column:
    """Smoothed levels by position: a forward pass that keeps its states, then a backward one."""
    start = F.array(F.struct(F.get(y, F.lit(0)).alias("level"), F.lit(float(r)).alias("var"), F.lit(ZERO).alias("prior")))

    def step(a: Column, v: Column) -> Column:
        last = F.element_at(a, -1)
        prior = last["var"] + q
        k = prior / (prior + r)
        return F.concat(a, F.array(F.struct((last["level"] + k * (v - last["level"])).alias("level"), ((1 - k) * prior).alias("var"), prior.alias("prior"))))

    states = F.aggregate(F.slice(y, 2, 1_000_000_000), start, step)
    # behind state i comes prior level = level i, prior variance = prior of i + 1
    back = F.reverse(F.transform(states, lambda s, i: F.struct(s["level"].alias("level"), s["var"].alias("var"), F.coalesce(F.get(states, i + 1)["prior"], F.lit(ZERO)).alias("next"))))
    first = F.array(F.get(back, F.lit(0))["level"])
    return F.reverse(F.aggregate(F.slice(back, 2, 1_000_000_000), first, lambda a, s: F.concat(a, F.array(s["level"] + F.when(s["next"] > 0, s["var"] / F.nullif(s["next"], F.lit(0.0))).otherwise(ZERO) * (F.element_at(a, -1) - s["level"])))))


def kalman_trend(y: Column, q_level: Column | float, q_trend: Column | float, r: Column | float) -> Column:
    """Local linear trend filter: struct of level, trend, their variances and covariance, and the log-likelihood."""
    noise_level, noise_trend, noise = (v if isinstance(v, Column) else F.lit(float(v)) for v in (q_level, q_trend, r))
    first = F.get(y, F.lit(0))
    start = F.struct(first.alias("level"), F.coalesce(F.get(y, F.lit(1)) - first, F.lit(ZERO)).alias("trend"), noise.alias("var_level"), F.lit(ZERO).alias("cov"), noise.alias("var_trend"), F.lit(ZERO).alias("ll"))

    def step(a: Column, v: Column) -> Column:
        var_level = a["var_level"] + 2 * a["cov"] + a["var_trend"] + noise_level
        cov, var_trend = a["cov"] + a["var_trend"], a["var_trend"] + noise_trend
        miss, spread = v - a["level"] - a["trend"], var_level + noise
        gain, pull = var_level / spread, cov / spread
        return F.struct(
            (a["level"] + a["trend"] + gain * miss).alias("level"), (a["trend"] + pull * miss).alias("trend"), ((1 - gain) * var_level).alias("var_level"), ((1 - gain) * cov).alias("cov"),
            (var_trend - pull * cov).alias("var_trend"), (a["ll"] - 0.5 * (math.log(2 * math.pi) + F.ln(spread) + miss * miss / spread)).alias("ll"),
        )

    return F.aggregate(F.slice(y, 2, 1_000_000_000), start, step)


def kalman_level_forecast(panel: DataFrame, horizon: int, q: float = 0.1, r: float = 1.0, z: float = 1.959963984540054, frequency: str = "D") -> DataFrame:
    """Flat means with variance final + step * q + r, and z-intervals."""
    hist = histories(panel).withColumn("s", kalman_level(F.col("y"), q, r))
    rows = predictions(hist, lambda s: F.col("s.level"), horizon, "kalman_level", frequency).join(hist.select("series_id", "s.var"), "series_id")
    var = F.col("var") + F.col("horizon") * q + r
    return rows.withColumn("variance", var).withColumn("lower", F.col("mean") - z * F.sqrt(var)).withColumn("upper", F.col("mean") + z * F.sqrt(var)).drop("var")


def kalman_trend_forecast(panel: DataFrame, horizon: int, q_level: float = 0.1, q_trend: float = 0.01, r: float = 1.0, z: float = 1.959963984540054, frequency: str = "D") -> DataFrame:
    hist = histories(panel).withColumn("s", kalman_trend(F.col("y"), q_level, q_trend, r))
    rows = predictions(hist, lambda s: F.col("s.level") + s * F.col("s.trend"), horizon, "kalman_trend", frequency).join(hist.select("series_id", "s"), "series_id")
    h = F.col("horizon")
    var = F.greatest(F.col("s.var_level") + 2 * h * F.col("s.cov") + h * h * F.col("s.var_trend") + h * q_level + h * h * q_trend, F.lit(ZERO)) + r
    return rows.withColumn("variance", var).withColumn("lower", F.col("mean") - z * F.sqrt(var)).withColumn("upper", F.col("mean") + z * F.sqrt(var)).drop("s")


def auto_kalman(panel: DataFrame, horizon: int, grid: Sequence[tuple[float, float]] = ((0.01, 1.0), (0.1, 1.0), (1.0, 1.0), (1.0, 0.1)), holdout: int = 7, frequency: str = "D") -> DataFrame:
    """Local level model with the (q, r) of smallest pooled holdout error; ties in the grid's order."""
    points = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), F.lit(float(r)).alias("r")) for i, (q, r) in enumerate(grid)))
    hist = histories(panel).withColumn("g", F.explode(points)).select("*", "g.*")
    cut = F.greatest(F.col("n") - holdout, F.lit(1))
    level = kalman_level(F.slice("y", 1, cut), F.col("q"), F.col("r"))["level"]
    err = hist.withColumn("level", level).withColumn("sse", F.aggregate(F.slice("y", cut + 1, F.lit(holdout)), F.lit(ZERO), lambda a, v: a + (v - F.col("level")) * (v - F.col("level"))))
    best = err.groupBy("i", "q", "r").agg(F.sum("sse").alias("sse")).orderBy("sse", "i").first()
    return kalman_level_forecast(panel, horizon, best["q"], best["r"], frequency=frequency)


# --- decomposition ---------------------------------------------------------------------------------------------------


def trend_window(window: int, n: Column) -> Column:
    """An odd window of at least 3 that the history holds; the whole history if it has one or two rows."""
    w = F.least(F.greatest(F.lit(window), F.lit(3)), n)
    return F.when(n <= 2, F.greatest(n, F.lit(1))).otherwise(F.when(w % 2 == 0, F.greatest(w - 1, F.lit(3))).otherwise(w))


def decompose(panel: DataFrame, seasons: Sequence[int], window: int | None = None) -> DataFrame:
    """series_id, n, y, trend (centred mean, cut at the ends), one ``seasonal_m`` array a season (shortest first), remainder.

    Recomposition is exact: remainder = y - trend - all seasonal parts.
    """
    seasons = sorted(set(seasons))
    hist = histories(panel)
    radius = F.floor(trend_window(window or 2 * max(seasons) + 1, F.col("n")) / 2).cast("int")
    hist = hist.withColumn("_r", radius)
    trend = F.transform("y", lambda v, i: mean_of(F.slice("y", F.greatest(i - F.col("_r"), F.lit(0)) + 1, F.least(i + F.col("_r") + 1, F.col("n")) - F.greatest(i - F.col("_r"), F.lit(0)))))
    hist = hist.withColumn("trend", trend).withColumn("remainder", F.zip_with("y", "trend", lambda a, b: a - b))
    for m in seasons:
        hist = hist.withColumn("_p", _phases(F.col("remainder"), m)).withColumn("_m", F.lit(m)).withColumn(f"seasonal_{m}", F.transform("y", lambda v, i: at("_p", F.pmod(i, F.col("_m")))))
        hist = hist.withColumn("remainder", F.zip_with("remainder", f"seasonal_{m}", lambda a, b: a - b))
    return hist.drop("_r", "_p", "_m")


def _phases(y: Column, season: int) -> Column:
    means = F.transform(F.sequence(F.lit(0), F.lit(season - 1)), lambda k: F.coalesce(mean_of(F.filter(y, lambda v, i: F.pmod(i, F.lit(season)) == k)), F.lit(ZERO)))
    return F.transform(means, lambda v: v - mean_of(means))


def decomposed_forecast(panel: DataFrame, horizon: int, season: int, frequency: str = "D") -> DataFrame:
    """Trend carried on by its mean slope over the last four points, plus the season; the remainder forecasts 0."""
    hist = decompose(panel, [season])
    k = F.least(F.col("n") - 1, F.lit(3))
    step_up = F.when(k > 0, (F.element_at("trend", -1) - at("trend", F.col("n") - 1 - k)) / F.greatest(k, F.lit(1))).otherwise(ZERO)
    phase = lambda s: at("_pattern", F.pmod(F.col("n") + s - 1, F.lit(season)))
    hist = hist.withColumn("_pattern", F.transform(F.sequence(F.lit(0), F.lit(season - 1)), lambda i: F.coalesce(at(f"seasonal_{season}", i), F.lit(ZERO))))
    return predictions(hist, lambda s: F.element_at("trend", -1) + s * step_up + phase(s), horizon, "stl", frequency)


# --- banks, ensembles, backtests -------------------------------------------------------------------------------------


def bank(panel: DataFrame, horizon: int, season: int, frequency: str = "D") -> DataFrame:
    """All closed-form forecasters over one panel: the union of their predictions."""
    hist = histories(panel)
    each = {
        "naive": naive, "drift": drift, "seasonal_naive": seasonal_naive(season), "window_average": window_average(season),
        "seasonal_window_average": seasonal_window_average(season, 3), "mean": window_average(1_000_000),
    }
    parts = [predictions(hist, f, horizon, name, frequency) for name, f in each.items()]
    parts += [theta_forecast(panel, horizon, frequency=frequency), ets_forecast(panel, horizon, season=season, frequency=frequency), kalman_level_forecast(panel, horizon, frequency=frequency).select(parts[0].columns)]
    return reduce(DataFrame.unionByName, parts)


def split_tail(panel: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """The panel without, and the panel of, the last rows of each series."""
    back = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("ts").desc()))
    marked = panel.withColumn("_b", back)
    return marked.where(F.col("_b") > rows).drop("_b"), marked.where(F.col("_b") <= rows).drop("_b")


def bank_scores(panel: DataFrame, horizon: int, season: int, frequency: str = "D", by: Sequence[str] = ("model",)) -> DataFrame:
    """WAPE and RMSE of each model of the bank on the tail."""
    train, test = split_tail(panel, horizon)
    scored = bank(train, horizon, season, frequency).join(test.select("series_id", "ts", "y"), ["series_id", "ts"])
    e = F.col("mean") - F.col("y")
    return scored.groupBy(*by).agg((F.sum(F.abs(e)) / F.sum(F.abs("y"))).alias("wape"), F.sqrt(F.avg(e * e)).alias("rmse"))


def best_of_bank(panel: DataFrame, horizon: int, season: int, frequency: str = "D") -> DataFrame:
    """Each series' best model on the tail, applied to the whole history; ties by name."""
    scores = bank_scores(panel, horizon, season, frequency, ("series_id", "model")).where(~F.isnan("wape"))
    best = scores.groupBy("series_id").agg(F.min_by("model", F.struct("wape", "model")).alias("model"))
    return bank(panel, horizon, season, frequency).join(best, ["series_id", "model"])


def gate_weights(scores: DataFrame, metric: str = "wape", floor: float = 1e-6, top_k: int | None = None, hard_gain: float | None = None, baseline: str | None = None, baseline_gain: float = 0.0) -> DataFrame:
    """Weights of experts by (series_id, model) losses: a baseline that nobody beats by ``baseline_gain`` wins alone, so does
    a winner that is ``hard_gain`` better than the second; else the best k weigh 1 / max(loss, floor), normalised."""
    order = Window.partitionBy("series_id").orderBy(metric, "model")
    part = Window.partitionBy("series_id")
    rows = scores.where(F.col(metric).isNotNull() & ~F.isnan(metric)).withColumn("rank", F.row_number().over(order))
    best = F.min(metric).over(part)
    second = F.min(F.when(F.col("rank") == 2, F.col(metric))).over(part)
    base = F.max(F.when(F.col("model") == (baseline or ""), F.col(metric))).over(part)
    keeps = base.isNotNull() & (best > base * (1 - baseline_gain))
    hard = F.lit(False) if hard_gain is None else second.isNotNull() & (best <= second * (1 - hard_gain))
    chosen = F.when(keeps, F.col("model") == (baseline or "")).when(hard, F.col("rank") == 1).otherwise(F.lit(True) if top_k is None else F.col("rank") <= top_k)
    raw = F.when(chosen, F.when(F.coalesce(keeps, F.lit(False)) | F.coalesce(hard, F.lit(False)), 1.0).otherwise(1 / F.greatest(F.col(metric), F.lit(floor)))).otherwise(ZERO)
    rows = rows.withColumn("_w", raw)
    return rows.withColumn("weight", F.col("_w") / F.sum("_w").over(part)).where(F.col("_w") > 0).select("series_id", "model", "weight")


def weighted_ensemble(members: DataFrame, weights: DataFrame, on: Sequence[str] = ("model",), model: str = "ensemble") -> DataFrame:
    """Weighted means of member predictions by key; weights are normalised over the members that a key has."""
    rows = members.join(weights, list(on))
    return rows.groupBy("series_id", "ts", "horizon").agg((F.sum(F.col("weight") * F.col("mean")) / F.sum("weight")).alias("mean")).withColumn("model", F.lit(model))


def residual_corrections(residuals: DataFrame, keys: Sequence[str], strength: float) -> DataFrame:
    """Mean residual (y - mean) of each key, shrunk by n / (n + strength)."""
    r = F.col("y") - F.col("mean")
    return residuals.groupBy(*keys).agg((F.sum(r) / (F.count(F.lit(1)) + strength)).alias("correction"))


def rolling_origins(panel: DataFrame, horizon: int, step: int, min_train: int, max_train: int | None = None, n_splits: int | None = None) -> DataFrame:
    """Folds over the panel's distinct timestamps: fold, and the timestamps' numbers where training starts, where it ends
    (exclusive) and where validation ends (exclusive)."""
    n = panel.select("ts").distinct().count()
    ends = list(range(min_train, n - horizon + 1, step))
    ends = ends[-n_splits:] if n_splits else ends
    rows = [(i, max(0, e - max_train) if max_train else 0, e, e + horizon) for i, e in enumerate(ends)]
    each = F.array(*(F.struct(F.lit(i).alias("fold"), F.lit(a).alias("train_from"), F.lit(b).alias("train_to"), F.lit(c).alias("valid_to")) for i, a, b, c in rows)) if rows else None
    empty = panel.sparkSession.range(0).select(*(F.col("id").cast("int").alias(c) for c in ("fold", "train_from", "train_to", "valid_to")))
    return panel.sparkSession.range(1).select(F.explode(each).alias("f")).select("f.*") if rows else empty


def fold_rows(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Panel rows replicated to the folds that use them, with ``part`` train or valid; timestamps get their dense number by
    a join with the distinct ones (a calendar, small beside the panel)."""
    days = panel.select("ts").distinct().withColumn("t", F.row_number().over(Window.orderBy("ts")) - 1)
    # folds: a row an origin
    rows = panel.join(days, "ts").join(F.broadcast(folds), (F.col("t") >= F.col("train_from")) & (F.col("t") < F.col("valid_to")))
    return rows.withColumn("part", F.when(F.col("t") < F.col("train_to"), "train").otherwise("valid"))


def backtest(panel: DataFrame, folds: DataFrame, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Fold metrics of a forecaster in one job: series of a fold are series ``fold|series`` of one panel.

    ``model`` maps a panel to predictions; the run's metric is the plain mean of the folds' metrics.
    """
    rows = fold_rows(panel, folds).withColumn("series_id", F.concat_ws("|", F.col("fold").cast("string"), "series_id"))
    made = model(rows.where(F.col("part") == "train").select("series_id", "ts", "y"))
    scored = made.join(rows.where(F.col("part") == "valid").select("series_id", "ts", "y"), ["series_id", "ts"])
    e = F.col("mean") - F.col("y")
    by = F.split_part("series_id", F.lit("|"), F.lit(1)).cast("int").alias("fold")
    return scored.groupBy(by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.sum(F.abs(e)) / F.sum(F.abs("y"))).alias("wape"))
