"""Forecasters that learn one boosted model over all series, and the orchestration around them.

Training rows come from the window features (one shuffle); fitting is the booster's level-wise aggregation. Recursive
prediction keeps one row a series (its last values) and steps a batch of series through the horizon in numpy with the model
as arrays, so the horizon costs no shuffles and no growing plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.calendar import STEPS, advance
from gridloom.operators import forecast as fc
from gridloom.operators.boost import BoostModel, BoostSpec, Node, fit
from gridloom.operators.lags import LagSpec, direct_targets, lag_features, next_step, recency_weights, supported
from gridloom.operators.metrics import non_crossing
from gridloom.operators.spatial import krige
from gridloom.session import staged

Forecaster = Callable[[DataFrame, int], DataFrame]
FORECAST = "series_id string, ts timestamp_ntz, horizon int, model string, mean double"


def tree_values(node: Node, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    """A tree's values for columns of features."""
    if node.feature is None:
        return np.full(n, node.value) + sum((np.nan_to_num(x[f]) * c for f, c in node.slopes.items()), 0.0)
    if node.kind != "axis" or node.fuzzy:
        raise ValueError("recursive steps know hard threshold splits")
    v = x[node.feature]
    left = np.where(np.isfinite(v), v <= node.threshold, node.missing_left)
    return np.where(left, tree_values(node.left, x, n), tree_values(node.right, x, n))


def margin_of(model: BoostModel, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    total = np.full(n, model.init)
    for t in model.trees:
        total += model.rate * tree_values(t, x, n)
    return total


def calendar_values(names: Sequence[str], ts: np.ndarray) -> dict[str, np.ndarray]:
    """The calendar features of ``functions.calendar`` for numpy timestamps."""
    d = pd.DatetimeIndex(ts)
    base = {"day_of_week": (d.dayofweek, 7, 0), "month": (d.month, 12, 1), "day_of_month": (d.day, 31, 1), "day_of_year": (d.dayofyear, 366, 1), "hour": (d.hour, 24, 0)}
    out = {}
    for name in names:
        if name.endswith(("_sin", "_cos")):
            v, period, first = base[name[:-4]]
            out[name] = getattr(np, name[-3:])(2 * np.pi * (np.asarray(v, float) - first) / period)
        elif name in base:
            out[name] = np.asarray(base[name][0], float)
        else:
            out[name] = {
                "is_weekend": d.dayofweek >= 5, "is_month_start": d.day <= 3, "is_month_middle": (d.day >= 14) & (d.day <= 16), "is_month_end": d.day >= d.days_in_month - 2,
            }[name].astype(float)
    return out


def tail_features(spec: LagSpec, tails: np.ndarray, ts: np.ndarray, ewm: dict[int, np.ndarray]) -> dict[str, np.ndarray]:
    """The lag features of a coming row for a batch of series with equally long tails (NaN before their start)."""
    last = lambda k: tails[:, -k] if k <= tails.shape[1] else np.full(len(tails), np.nan)
    out = {f"target_lag_{k}": last(k) for k in spec.lags}
    for kind, f in (("mean", np.mean), ("std", np.std), ("min", np.min), ("max", np.max)):
        out |= {f"target_roll_{kind}_{w}": f(tails[:, -w:], axis=1) for w in getattr(spec, f"roll_{kind}")}
    with np.errstate(all="ignore"):
        out |= {f"target_partial_roll_mean_{w}": np.nanmean(tails[:, -w:], axis=1) for w in spec.partial_mean}
    out |= {f"target_ewm_alpha_{a:03d}": ewm[a] for a in spec.ewm_percent}
    out |= {f"target_delta_lag_{k}": last(1) - last(k + 1) for k in spec.deltas}
    out |= {f"target_roll_trend_{w}": (last(1) - last(w)) / (w - 1) if w > 1 else np.zeros(len(tails)) for w in spec.trends}
    return out | {f"calendar_{c}": v for c, v in calendar_values(spec.calendar, ts).items()}


def _base(mode: str, season: int, tails: np.ndarray) -> np.ndarray:
    return np.zeros(len(tails)) if mode == "level" else tails[:, -1] if mode == "delta" else tails[:, -season]


def recursive_predictions(panel: DataFrame, model: BoostModel, spec: LagSpec, horizon: int, mode: str = "level", season: int = 7, frequency: str = "D", name: str = "lag_boost") -> DataFrame:
    """Steps every series through the horizon; each step is held within a margin of the series' range."""
    if spec.covariates or spec.indicators or spec.interactions or spec.phase:
        raise ValueError("recursive steps know lag, window and calendar features")
    need = max(spec.longest(), max(spec.partial_mean, default=1), season + 1)
    hist = fc.histories(panel).select(
        "series_id", "last_ts", F.slice("y", F.greatest(F.col("n") - need + 1, F.lit(1)), F.lit(need)).alias("tail"), F.array_min("y").alias("lo"), F.array_max("y").alias("hi"),
        *(_ewm(a).alias(f"e{a}") for a in spec.ewm_percent),
    )
    step = np.timedelta64(STEPS[frequency], "s")

    def run(batches):
        for pdf in batches:
            tails = np.full((len(pdf), need), np.nan)
            for i, t in enumerate(pdf["tail"]):
                tails[i, need - len(t) :] = t
            lo, hi = pdf["lo"].to_numpy(float), pdf["hi"].to_numpy(float)
            slack = np.maximum(np.maximum(3 * (hi - lo), 0.25 * np.maximum(np.abs(lo), np.abs(hi))), 1.0)
            ewm = {a: pdf[f"e{a}"].to_numpy(float) for a in spec.ewm_percent}
            ts, out = pdf["last_ts"].to_numpy("datetime64[us]"), []
            for h in range(1, horizon + 1):
                ts = ts + step
                x = tail_features(spec, tails, ts, ewm)
                y = np.clip(margin_of(model, x, len(pdf)) + np.nan_to_num(_base(mode, season, tails)), lo - slack, hi + slack)
                tails = np.column_stack([tails[:, 1:], y])
                ewm = {a: a / 100 * y + (1 - a / 100) * e for a, e in ewm.items()}
                out.append(pd.DataFrame({"series_id": pdf["series_id"], "ts": ts, "horizon": np.int32(h), "model": name, "mean": y}))
            yield pd.concat(out, ignore_index=True)

    return hist.mapInPandas(run, FORECAST)


def _ewm(percent: int):
    a = percent / 100
    return F.aggregate(F.slice("y", 2, 1_000_000_000), F.get("y", F.lit(0)), lambda s, v: F.lit(a) * v + F.lit(1 - a) * s)


def training_rows(panel: DataFrame, spec: LagSpec, mode: str = "level", season: int = 7) -> DataFrame:
    """Features with ``label``: the level, its change, or its change over a season."""
    rows = lag_features(panel, replace(spec, lags=tuple(dict.fromkeys([*spec.lags, *([1] if mode == "delta" else [season] if mode == "seasonal_delta" else [])]))))
    base = F.lit(0.0) if mode == "level" else F.col("target_lag_1") if mode == "delta" else F.col(f"target_lag_{season}")
    return rows.withColumn("label", F.col("y") - base)


def lag_boost_forecast(panel: DataFrame, horizon: int, spec: LagSpec = LagSpec(lags=(1, 2, 7), roll_mean=(7,), calendar=("day_of_week",)), boost: BoostSpec = BoostSpec(rounds=10, rate=0.3, depth=3, min_leaf=5, bins=16), mode: str = "level", season: int = 7, frequency: str = "D", name: str = "lag_boost") -> DataFrame:
    model = fit(training_rows(panel, spec, mode, season), spec.names(), "label", boost)
    return recursive_predictions(panel, model, spec, horizon, mode, season, frequency, name)


def direct_boost_forecast(panel: DataFrame, horizon: int, spec: LagSpec = LagSpec(lags=(1, 2, 7), roll_mean=(7,)), boost: BoostSpec = BoostSpec(rounds=8, rate=0.3, depth=3, min_leaf=5, bins=16), frequency: str = "D", name: str = "direct_boost", level: float | None = None) -> DataFrame:
    """One model a step on the features at the origin; with ``level`` the models predict that quantile."""
    rows = direct_targets(lag_features(panel, spec), horizon)
    how = boost if level is None else replace(boost, loss="quantile", alpha=level)
    models = [fit(rows.where(F.col("step") == h), spec.names(), "label", how) for h in range(1, horizon + 1)]
    ends = panel.groupBy("series_id").agg(F.max("ts").alias("last_ts"))
    future = ends.select("series_id", (F.col("last_ts") + F.expr(f"interval {STEPS[frequency]} seconds")).alias("ts"))
    x = next_step(panel, spec, future)
    steps = F.array(*(F.struct(F.lit(h).alias("horizon"), m.margin().alias("mean")) for h, m in enumerate(models, 1)))
    out = x.select("series_id", "ts", F.explode(steps).alias("s"))
    return out.select("series_id", advance(F.col("ts"), frequency, F.col("s.horizon") - 1).alias("ts"), "s.horizon", F.lit(name).alias("model"), "s.mean")


def quantile_boost_forecast(panel: DataFrame, horizon: int, levels: Sequence[float] = (0.1, 0.5, 0.9), **settings) -> DataFrame:
    """Quantiles by step as an array, made non-crossing."""
    parts = None
    for i, q in enumerate(sorted(levels)):
        one = direct_boost_forecast(panel, horizon, level=q, **settings).select("series_id", "ts", "horizon", F.col("mean").alias(f"q{i}"))
        parts = one if parts is None else parts.join(one, ["series_id", "ts", "horizon"])
    return parts.select("series_id", "ts", "horizon", non_crossing(F.array(*(f"q{i}" for i in range(len(levels))))).alias("quantiles"))


def rectified_forecast(panel: DataFrame, horizon: int, spec: LagSpec = LagSpec(lags=(1, 2, 7)), boost: BoostSpec = BoostSpec(rounds=6, rate=0.3, depth=2, min_leaf=5, bins=16), frequency: str = "D") -> DataFrame:
    """A recursive forecast plus the mean of what it missed by step on a held-out tail."""
    train, test = fc.split_tail(panel, horizon)
    missed = lag_boost_forecast(train, horizon, spec, boost, frequency=frequency).join(test.select("series_id", "ts", "y"), ["series_id", "ts"])
    fix = fc.residual_corrections(missed, ["horizon"], 5.0)
    made = lag_boost_forecast(panel, horizon, spec, boost, frequency=frequency, name="rectified")
    # fix: a row a step of the horizon
    return made.join(F.broadcast(fix), "horizon", "left").select("series_id", "ts", "horizon", "model", (F.col("mean") + F.coalesce("correction", F.lit(0.0))).alias("mean"))


def corrected_forecast(panel: DataFrame, horizon: int, base: Callable[[DataFrame, int], DataFrame], season: int = 7, strength: float = 10.0) -> DataFrame:
    """A base forecast plus shrunken residual means by step, then by phase and by series on what is left; each layer stays
    only if the tail's squared error doesn't get worse."""
    train, test = fc.split_tail(panel, horizon)
    seen = base(train, horizon).join(test.select("series_id", "ts", "y"), ["series_id", "ts"]).withColumn("phase", F.pmod(F.unix_date(F.to_date("ts")), F.lit(season)))
    made = base(panel, horizon).withColumn("phase", F.pmod(F.unix_date(F.to_date("ts")), F.lit(season)))
    seen = seen.persist()
    loss = lambda d: d.agg(F.avg(F.pow(F.col("y") - F.col("mean"), 2))).first()[0] or 0.0
    best = loss(seen)
    for keys in (["horizon"], ["phase"], ["series_id"]):
        fix = fc.residual_corrections(seen, keys, strength)
        add = lambda d, fix=fix, keys=keys: d.join(fix, keys, "left").withColumn("mean", F.col("mean") + F.coalesce("correction", F.lit(0.0))).drop("correction")
        tried = add(seen)
        if (now := loss(tried)) <= best:
            best, seen, made = now, tried, add(made)
    return made.drop("phase").withColumn("model", F.lit("corrected")).select("series_id", "ts", "horizon", "model", "mean")


def hybrid_forecast(panel: DataFrame, horizon: int, season: int = 7, frequency: str = "D") -> DataFrame:
    """Trend and season carried on, the remainder forecast by the global booster."""
    parts = fc.decompose(panel, [season])
    rows = parts.select("series_id", F.posexplode("remainder").alias("i", "r"))
    number = panel.select("series_id", "ts", (F.row_number().over(Window.partitionBy("series_id").orderBy("ts")) - 1).alias("i"))
    rest = number.join(rows, ["series_id", "i"]).select("series_id", "ts", F.col("r").alias("y"))
    boosted = lag_boost_forecast(rest, horizon, season=season, frequency=frequency).select("series_id", "horizon", F.col("mean").alias("extra"))
    smooth = fc.decomposed_forecast(panel, horizon, season, frequency)
    return smooth.join(boosted, ["series_id", "horizon"]).select("series_id", "ts", "horizon", F.lit("stl_boost").alias("model"), (F.col("mean") + F.col("extra")).alias("mean"))


def scaled(panel: DataFrame, floor: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """The panel with each series standardised (deviation floored), and the (series_id, mean, scale) to undo it."""
    stats = panel.groupBy("series_id").agg(F.avg("y").alias("m"), F.greatest(F.coalesce(F.stddev_pop("y"), F.lit(0.0)), F.lit(floor)).alias("s"))
    return panel.join(stats, "series_id").withColumn("y", (F.col("y") - F.col("m")) / F.col("s")).drop("m", "s"), stats


def unscaled(made: DataFrame, stats: DataFrame) -> DataFrame:
    return made.join(stats, "series_id").withColumn("mean", F.col("mean") * F.col("s") + F.col("m")).drop("m", "s")


def log_forecast(panel: DataFrame, horizon: int, model: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """A forecaster on log1p of the target, taken back."""
    return model(panel.withColumn("y", F.log1p("y")), horizon).withColumn("mean", F.expm1("mean"))


def kriged_levels(panel: DataFrame, places: DataFrame, horizon: int, rng: float, frequency: str = "D", **settings) -> DataFrame:
    """Each located series' last value, kriged over (series_id, x, y), flat over the horizon."""
    last = fc.histories(panel).select(F.col("series_id").alias("id"), F.element_at("y", -1).alias("value"))
    at = places.withColumnRenamed("series_id", "id")
    level = krige(at.join(last, "id"), at, rng, **settings).select(F.col("id").alias("series_id"), F.col("mean").alias("level"))
    hist = fc.histories(panel).join(level, "series_id")
    return fc.predictions(hist, lambda s: F.col("level"), horizon, "kriging", frequency)


def holiday_windows(holidays: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """(name, offset, day) of every day around each holiday (name, day)."""
    return holidays.select("name", "day", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).select("name", "offset", F.date_add("day", F.col("offset")).alias("day"))


@dataclass(frozen=True)
class AutoSpec:
    """How candidates are tried and weighed. ``objective`` is wape, mae or rmse over ``origins`` trailing windows of
    ``validation`` steps (None: the horizon). A series has weights of its own from ``series_points`` scored rows a model on, a
    step from ``step_points``; else the next wider weights hold."""

    season: int = 7
    origins: int = 2
    validation: int | None = None
    objective: str = "wape"
    lags: LagSpec = LagSpec(lags=(1, 2, 7), roll_mean=(7,), calendar=("day_of_week",))
    boost: BoostSpec = BoostSpec(rounds=10, rate=0.3, depth=3, min_leaf=5, bins=16)
    baseline: str = "seasonal_naive"
    displacement: float = 0.03
    hard: float = 0.05
    top_k: int = 3
    series_points: int = 4
    step_points: int = 2
    zero_share: float = 0.3
    half_life: float = 10.0

    def __post_init__(self):
        if self.objective not in ("wape", "mae", "rmse"):
            raise ValueError(f"unknown objective {self.objective}")
        if self.origins < 1 or self.season < 1 or (self.validation is not None and self.validation < 1):
            raise ValueError("origins, season and validation must be positive")


@dataclass(frozen=True)
class AutoForecast:
    """``forecast``; ``scores`` by model, and by series or step where those columns aren't null; the three tables of weights; the
    lags that the history supports; whether negative forecasts are cut to 0."""

    forecast: DataFrame
    scores: DataFrame
    weights: DataFrame
    step_weights: DataFrame
    series_weights: DataFrame
    lags: LagSpec
    nonnegative: bool


def auto_candidates(panel: DataFrame, spec: AutoSpec, frequency: str = "D") -> tuple[dict[str, Forecaster], LagSpec, bool]:
    """The forecasters worth trying on a panel, the lags its shortest series supports, and whether no target is negative.

    Always the bank, the booster over lags (with the season's lag where it is supported) and the same with recent rows weighing
    more; on log1p where no target is negative; intermittent demand where a share of targets is 0.
    """
    stats = panel.agg(F.min("y").alias("low"), F.avg((F.col("y") == 0).cast("double")).alias("zeros")).first()
    nonnegative = stats["low"] is not None and stats["low"] >= 0
    lags = supported(panel, replace(spec.lags, lags=tuple(dict.fromkeys([*spec.lags.lags, spec.season]))))

    def boosted(p: DataFrame, h: int) -> DataFrame:
        return lag_boost_forecast(p, h, lags, spec.boost, season=spec.season, frequency=frequency)

    def recent(p: DataFrame, h: int) -> DataFrame:
        rows = recency_weights(training_rows(p, lags, "level", spec.season), spec.half_life)
        model = fit(rows, lags.names(), "label", spec.boost, "weight")
        return recursive_predictions(p, model, lags, h, "level", spec.season, frequency, "recency_weighted_lag")

    out: dict[str, Forecaster] = {"bank": lambda p, h: fc.bank(p, h, spec.season, frequency), "lag_boost": boosted, "recency_weighted_lag": recent}
    if nonnegative:
        out["log1p_lag"] = lambda p, h: log_forecast(p, h, boosted).withColumn("model", F.lit("log1p_lag"))
        if (stats["zeros"] or 0.0) >= spec.zero_share:
            out["intermittent"] = lambda p, h: fc.intermittent_forecast(p, h, "croston", frequency=frequency).withColumn("model", F.lit("intermittent"))
    return out, lags, nonnegative


def auto_fit(panel: DataFrame, horizon: int, spec: AutoSpec = AutoSpec(), frequency: str = "D") -> AutoForecast:
    """Candidates are scored on trailing origins in one replicated panel, weighed, and their forecasts combined.

    A baseline that nobody beats by ``displacement`` wins, so does a candidate that is ``hard`` better than the next; else the
    best ``top_k`` share by their inverse loss. Weights are found over all rows, by step and by series.
    """
    rows = panel.select("series_id", "ts", F.col("y").cast("double").alias("y"))
    nonnegative = (rows.agg(F.min("y")).first()[0] or 0.0) >= 0
    window, n = spec.validation or horizon, rows.select("ts").distinct().count()
    folds = fc.rolling_origins(rows, window, window, max(min(2 * spec.season, n - window), n - spec.origins * window), n_splits=spec.origins)
    tried = fc.fold_rows(rows, folds).withColumn("series_id", F.concat_ws("|", F.col("fold").cast("string"), "series_id"))
    train, valid = (tried.where(F.col("part") == part).select("series_id", "ts", "y") for part in ("train", "valid"))
    candidates, lags, _ = auto_candidates(train, spec, frequency)  # what the validation's shorter history supports
    every = lambda p, h: reduce(DataFrame.unionByName, (f(p, h) for f in candidates.values()))
    floor = F.lit(0.0) if nonnegative else F.lit(float("-inf"))
    held = lambda d: d.withColumn("mean", F.greatest("mean", floor))
    scored = staged(held(every(train, window)).join(valid, ["series_id", "ts"]).withColumn("series_id", F.expr("substr(series_id, instr(series_id, '|') + 1)")), "scored")
    e = F.abs(F.col("mean") - F.col("y"))
    loss = {"wape": F.sum(e) / F.greatest(F.sum(F.abs("y")), F.lit(1e-12)), "mae": F.avg(e), "rmse": F.sqrt(F.avg(e * e))}[spec.objective]

    def by(*keys: str) -> DataFrame:
        return scored.groupBy(*keys, "model").agg(loss.alias("loss"), F.count(F.lit(1)).alias("points"))

    def gated(scores: DataFrame, key: Column) -> DataFrame:
        return fc.gate_weights(scores.select(key.alias("series_id"), "model", "loss"), "loss", top_k=spec.top_k, hard_gain=spec.hard, baseline=spec.baseline, baseline_gain=spec.displacement)

    whole, steps, series = by(), by("horizon"), by("series_id")
    weights = staged(gated(whole, F.lit("*")).select("model", F.col("weight").alias("w")), "weights")
    step_weights = staged(gated(steps.where(F.col("points") >= spec.step_points), F.col("horizon").cast("string")).select(F.col("series_id").cast("int").alias("horizon"), "model", F.col("weight").alias("wh")), "weights")
    series_weights = staged(gated(series.where(F.col("points") >= spec.series_points), F.col("series_id")).select("series_id", "model", F.col("weight").alias("ws")), "weights")
    none = lambda kind: F.lit(None).cast(kind)
    scores = whole.select(none("string").alias("series_id"), none("int").alias("horizon"), "model", "loss", "points")
    scores = scores.union(steps.select(none("string"), "horizon", "model", "loss", "points")).union(series.select("series_id", none("int"), "model", "loss", "points"))
    members = held(every(rows, horizon)).join(weights, "model", "left").join(step_weights, ["horizon", "model"], "left").join(series_weights, ["series_id", "model"], "left")
    members = members.join(step_weights.select("horizon", F.lit(True).alias("_h")).distinct(), "horizon", "left").join(series_weights.select("series_id", F.lit(True).alias("_s")).distinct(), "series_id", "left")
    weight = F.when(F.col("_s"), F.col("ws")).when(F.col("_h"), F.col("wh")).otherwise(F.col("w"))
    made = members.withColumn("weight", F.coalesce(weight, F.lit(0.0))).groupBy("series_id", "ts", "horizon").agg((F.sum(F.col("weight") * F.col("mean")) / F.sum("weight")).alias("mean"))
    return AutoForecast(made.withColumn("model", F.lit("auto")), scores, weights.withColumnRenamed("w", "weight"), step_weights.withColumnRenamed("wh", "weight"), series_weights.withColumnRenamed("ws", "weight"), lags, nonnegative)


def auto_forecast(panel: DataFrame, horizon: int, season: int = 7, origins: int = 2, frequency: str = "D", **settings) -> DataFrame:
    """The forecast of ``auto_fit``."""
    return auto_fit(panel, horizon, AutoSpec(season=season, origins=origins, **settings), frequency).forecast


def choose_candidate(scores: dict[str, float], current: str, min_gain: float = 0.01) -> str:
    """The lowest finite score if it beats the current one by a relative gain, else the current one; ties by name."""
    finite = {k: v for k, v in scores.items() if np.isfinite(v)}
    if not finite:
        return current
    best = min(finite, key=lambda k: (finite[k], k))
    return best if current not in finite or finite[best] < finite[current] * (1 - min_gain) else current


_MODELS: dict[str, Forecaster] = {}


def register(name: str, model: Forecaster, replace_old: bool = False) -> None:
    if name in _MODELS and not replace_old:
        raise ValueError(f"{name} is registered already")
    _MODELS[name] = model


def forecaster(name: str) -> Forecaster:
    if name not in _MODELS:
        raise KeyError(f"unknown model {name}; there are {sorted(_MODELS)}")
    return _MODELS[name]


def _of_history(make: Callable[[], Callable]) -> Forecaster:
    return lambda p, h: fc.predictions(fc.histories(p), make(), h, "history")


for _name, _model in {
    "naive": _of_history(lambda: fc.naive), "seasonal_naive": _of_history(lambda: fc.seasonal_naive(7)), "window_average": _of_history(lambda: fc.window_average(7)), "drift": _of_history(lambda: fc.drift),
    "theta": lambda p, h: fc.theta_forecast(p, h), "ets": lambda p, h: fc.ets_forecast(p, h), "kalman": lambda p, h: fc.kalman_level_forecast(p, h).select("series_id", "ts", "horizon", "model", "mean"),
    "croston": lambda p, h: fc.intermittent_forecast(p, h, "croston"), "tsb": lambda p, h: fc.intermittent_forecast(p, h, "tsb"), "lag_boost": lambda p, h: lag_boost_forecast(p, h),
}.items():
    register(_name, _model)
