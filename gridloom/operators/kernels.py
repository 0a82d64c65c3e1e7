"""Models that need a solve or an iterative fit: grouped Python kernels, one series (or bounded group) at a time.

Each kernel is a plain numpy function, tested by itself, and a thin ``applyInPandas`` around it. A group is one series, whose
rows are its time steps.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.calendar import STEPS

FORECAST = "series_id string, ts timestamp_ntz, horizon int, model string, mean double"


def per_series(panel: DataFrame, horizon: int, model: str, predict: Callable[[np.ndarray, int], np.ndarray], frequency: str = "D") -> DataFrame:
    """Predictions of a function of (history, horizon) for every series."""
    step = np.timedelta64(STEPS[frequency], "s")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        mean = predict(pdf["y"].to_numpy(float), horizon)
        last = pdf["ts"].to_numpy("datetime64[us]")[-1]
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "ts": [last + (k + 1) * step for k in range(horizon)], "horizon": np.arange(1, horizon + 1, dtype="int32"), "model": model, "mean": mean})

    return panel.select("series_id", "ts", "y").groupBy("series_id").applyInPandas(run, FORECAST)


# --- ARIMA -----------------------------------------------------------------------------------------------------------


@dataclass
class Arima:
    intercept: float
    ar: np.ndarray
    ma: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    tails: list[float]

    @property
    def mse(self) -> float:
        r = self.residuals[max(len(self.ar), len(self.ma)) :]
        return float((r**2).mean()) if len(r) else 0.0

    def stable(self) -> bool:
        """Whether all roots of the autoregression lie inside the unit circle, but for rounding."""
        if not len(self.ar):
            return True
        companion = np.eye(len(self.ar), k=-1)
        companion[0] = self.ar
        return bool(np.abs(np.linalg.eigvals(companion)).max() < 1 + 1e-9)

    def forecast(self, horizon: int) -> np.ndarray:
        z, e, tails, out = list(self.values), list(self.residuals), list(self.tails), []
        for _ in range(horizon):
            nxt = self.intercept + sum(c * z[-i - 1] for i, c in enumerate(self.ar)) + sum(c * e[-i - 1] for i, c in enumerate(self.ma))
            z.append(nxt)
            e.append(0.0)
            for k in reversed(range(len(tails))):  # undo the differences from the innermost outwards
                nxt = tails[k] = tails[k] + nxt
            out.append(nxt)
        return np.array(out)


def fit_arima(y: np.ndarray, p: int, d: int, q: int) -> Arima:
    """Least squares on lagged values and, in six passes, lagged residuals; orders shrink to what the history supports."""
    if max(p, q) > 8 or d > 2:
        raise ValueError("orders up to 8 and two differences are supported")
    d = min(d, len(y) - 1)
    z, tails = y, []
    for _ in range(d):
        tails.append(float(z[-1]))
        z = np.diff(z)
    most = max(len(z) - 1, 0)
    p, q = min(p, most), min(q, most)
    start, e = max(p, q), np.zeros(len(z))
    coef = np.zeros(p + q + 1)
    coef[0] = z.mean()
    for _ in range(6 if q else 1):
        x = np.column_stack([np.ones(len(z) - start), *(z[start - i - 1 : len(z) - i - 1] for i in range(p)), *(e[start - i - 1 : len(z) - i - 1] for i in range(q))])
        if p + q:
            coef = np.linalg.solve(x.T @ x + 1e-8 * np.eye(p + q + 1), x.T @ z[start:])
        e = np.concatenate([np.zeros(start), z[start:] - x @ coef])
    return Arima(float(coef[0]), coef[1 : p + 1], coef[p + 1 :], z, e, tails)


def arima_forecast(panel: DataFrame, horizon: int, p: int = 2, d: int = 1, q: int = 0, frequency: str = "D") -> DataFrame:
    return per_series(panel, horizon, "arima", lambda y, h: fit_arima(y, p, d, q).forecast(h), frequency)


def auto_arima_forecast(panel: DataFrame, horizon: int, max_p: int = 3, max_d: int = 1, max_q: int = 2, frequency: str = "D") -> DataFrame:
    """Each series' order of smallest in-sample error among stable ones; ties to smaller orders."""

    def best(y: np.ndarray, h: int) -> np.ndarray:
        fits = [(fit_arima(y, p, d, q), (p, d, q)) for d in range(max_d + 1) for p in range(max_p + 1) for q in range(max_q + 1)]
        fits = [f for f in fits if f[0].stable()] or fits[:1]
        return min(fits, key=lambda f: (f[0].mse, f[1]))[0].forecast(h)

    return per_series(panel, horizon, "auto_arima", best, frequency)


# --- piecewise linear trend with seasons -----------------------------------------------------------------------------


@dataclass(frozen=True)
class PiecewiseSpec:
    changepoints: int = 12
    change_range: float = 0.8
    weekly: int = 3
    yearly: int = 0
    change_penalty: float = 1.0
    season_penalty: float = 0.1
    growth: str = "linear"
    cap: float | None = None
    huber: float | None = None
    events: tuple[tuple[str, int, int], ...] = ()


def piecewise_design(days: np.ndarray, spec: PiecewiseSpec, knots: np.ndarray, dates: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Columns and their component names: intercept, slope, hinges at the knots, Fourier terms, event flags."""
    cols, names = [np.ones(len(days))], ["trend"]
    if spec.growth != "flat":
        cols.append(days)
        names.append("trend")
        for k in knots:
            cols.append(np.maximum(days - k, 0.0))
            names.append("trend")
    t = (dates - np.datetime64("1970-01-05")) / np.timedelta64(1, "D")
    for label, period, order in (("weekly", 7.0, spec.weekly), ("yearly", 365.25, spec.yearly)):
        for k in range(1, order + 1):
            cols += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
            names += [label, label]
    for day, before, after in spec.events:
        gap = (dates.astype("datetime64[D]") - np.datetime64(day)) / np.timedelta64(1, "D")
        cols.append(((gap >= -before) & (gap <= after)).astype(float))
        names.append(f"event_{day}")
    return np.column_stack(cols), names


def fit_piecewise(dates: np.ndarray, y: np.ndarray, spec: PiecewiseSpec) -> dict:
    """Ridge on the design (the intercept free), reweighted for a Huber loss; logistic growth works on the logit scale."""
    days = (dates - dates[0]) / np.timedelta64(1, "D")
    span = days[-1] * spec.change_range
    n = min(spec.changepoints, max(len(days) - 2, 0))
    knots = np.linspace(0, span, n + 2)[1:-1] if n and span > 0 and spec.growth != "flat" else np.empty(0)
    target = y
    if spec.growth == "logistic":
        cap = spec.cap or float(y.max()) * 1.1 + 1e-9
        share = np.clip(y / cap, 1e-6, 1 - 1e-6)
        target = np.log(share / (1 - share))
    x, names = piecewise_design(days, spec, knots, dates)
    scale = max(float(np.abs(target).max()), 1e-12)
    size = np.maximum(np.abs(x).max(0), 1e-12)
    penalty = np.array([0.0, 0.0][: 1 + (spec.growth != "flat")] + [spec.change_penalty] * len(knots) + [spec.season_penalty] * (x.shape[1] - 1 - (spec.growth != "flat") - len(knots)))
    z, w = x / size, np.ones(len(target))
    for _ in range(8 if spec.huber else 1):
        beta = np.linalg.solve(z.T @ (w[:, None] * z) + np.diag(penalty + 1e-8), z.T @ (w * target / scale))
        r = np.abs(target / scale - z @ beta)
        w = np.minimum(1.0, spec.huber / np.maximum(r, 1e-12)) if spec.huber else w
    beta = beta * scale / size
    return {"beta": beta, "knots": knots, "first": dates[0], "sigma": float((target - x @ beta).std()), "names": names, "cap": spec.cap or float(y.max()) * 1.1 + 1e-9}


def piecewise_parts(model: dict, dates: np.ndarray, spec: PiecewiseSpec) -> dict[str, np.ndarray]:
    """The additive components at some dates, and their sum ``mean`` on the target's scale."""
    days = (dates - model["first"]) / np.timedelta64(1, "D")
    x, names = piecewise_design(days, spec, model["knots"], dates)
    out: dict[str, np.ndarray] = {}
    for j, name in enumerate(names):
        out[name] = out.get(name, 0.0) + x[:, j] * model["beta"][j]
    total = sum(out.values())
    out["mean"] = model["cap"] / (1 + np.exp(-total)) if spec.growth == "logistic" else total
    return out


def piecewise_text(model: dict, spec: PiecewiseSpec) -> str:
    """A fitted model with its settings as JSON."""
    plain = {k: v.tolist() if isinstance(v, np.ndarray) else str(v.astype("datetime64[s]")) if isinstance(v, np.datetime64) else v for k, v in model.items()}
    return json.dumps({"version": 1, "spec": asdict(spec), "model": plain})


def piecewise_of_text(text: str) -> tuple[dict, PiecewiseSpec]:
    d = json.loads(text)
    if d.get("version") != 1:
        raise ValueError("unknown model version")
    spec, model = d["spec"], d["model"]
    model |= {"beta": np.array(model["beta"], float), "knots": np.array(model["knots"], float), "first": np.datetime64(model["first"], "s")}
    return model, PiecewiseSpec(**{**spec, "events": tuple(map(tuple, spec["events"]))})


def _piecewise_rows(series: str, model: dict, spec: PiecewiseSpec, last: np.datetime64, horizon: int, z: float, frequency: str) -> pd.DataFrame:
    ahead = last + np.timedelta64(STEPS[frequency], "s") * np.arange(1, horizon + 1)
    parts = piecewise_parts(model, ahead, spec)
    zero = np.zeros(horizon)
    return pd.DataFrame({
        "series_id": series, "ts": ahead.astype("datetime64[us]"), "horizon": np.arange(1, horizon + 1, dtype="int32"), "model": "piecewise", "mean": parts["mean"],
        "trend": parts["trend"], "weekly": parts.get("weekly", zero), "yearly": parts.get("yearly", zero), "lower": parts["mean"] - z * model["sigma"], "upper": parts["mean"] + z * model["sigma"],
    })


_PIECEWISE = FORECAST + ", trend double, weekly double, yearly double, lower double, upper double"


def piecewise_forecast(panel: DataFrame, horizon: int, spec: PiecewiseSpec = PiecewiseSpec(), z: float = 1.959963984540054, frequency: str = "D") -> DataFrame:
    """Predictions with trend, weekly and yearly components and normal intervals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        dates, y = pdf["ts"].to_numpy("datetime64[s]"), pdf["y"].to_numpy(float)
        return _piecewise_rows(pdf["series_id"].iloc[0], fit_piecewise(dates, y, spec), spec, dates[-1], horizon, z, frequency)

    return panel.select("series_id", "ts", "y").groupBy("series_id").applyInPandas(run, _PIECEWISE)


def piecewise_models(panel: DataFrame, spec: PiecewiseSpec = PiecewiseSpec()) -> DataFrame:
    """(series_id, last_ts, text): each series' fitted model as JSON, to be written as any table is."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        model = fit_piecewise(pdf["ts"].to_numpy("datetime64[s]"), pdf["y"].to_numpy(float), spec)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "last_ts": [pdf["ts"].iloc[-1]], "text": [piecewise_text(model, spec)]})

    return panel.select("series_id", "ts", "y").groupBy("series_id").applyInPandas(run, "series_id string, last_ts timestamp_ntz, text string")


def piecewise_from_models(models: DataFrame, horizon: int, z: float = 1.959963984540054, frequency: str = "D") -> DataFrame:
    """What ``piecewise_forecast`` gives, from written models."""

    def run(batches):
        for pdf in batches:
            for series, last, text in zip(pdf["series_id"], pdf["last_ts"].to_numpy("datetime64[s]"), pdf["text"], strict=True):
                yield _piecewise_rows(series, *piecewise_of_text(text), last, horizon, z, frequency)

    return models.select("series_id", "last_ts", "text").mapInPandas(run, _PIECEWISE)


# --- sequences over a reference axis -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class AxisSpec:
    axis_variance: float = 1.0
    rate_variance: float = 1.0
    axis_noise: float = 0.01
    rate_noise: float = 0.001
    signal_noise: float = 1.0


def extended_kalman(target: np.ndarray, axis0: float, rate0: float, ref_axis: np.ndarray, ref_signal: np.ndarray, spec: AxisSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(filtered states, covariances, predicted states, predicted covariances) of (axis, rate) with the signal's
    interpolation as observation; a missing target (NaN) is predicted through."""
    m, p = np.array([axis0, rate0]), np.diag([spec.axis_variance, spec.rate_variance])
    move, noise = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([spec.axis_noise, spec.rate_noise])
    eps = max(float(np.ptp(ref_axis)), 1e-9) * 1e-4
    fm, fp, pm, pp = [], [], [], []
    for i, z in enumerate(target):
        if i:
            m, p = move @ m, move @ p @ move.T + noise
        pm.append(m)
        pp.append(p)
        if np.isfinite(z):
            see = lambda a: np.interp(a, ref_axis, ref_signal)
            h = np.array([(see(m[0] + eps) - see(m[0] - eps)) / (2 * eps), 0.0])
            gain = p @ h / (h @ p @ h + spec.signal_noise)
            m, p = m + gain * (z - see(m[0])), p - np.outer(gain, h @ p)
        fm.append(m)
        fp.append(p)
    return tuple(map(np.array, (fm, fp, pm, pp)))


def unscented_kalman(target: np.ndarray, axis0: float, rate0: float, ref_axis: np.ndarray, ref_signal: np.ndarray, spec: AxisSpec, alpha: float = 1.0, kappa: float = 1.0) -> np.ndarray:
    """Filtered states by sigma points."""
    m, p = np.array([axis0, rate0]), np.diag([spec.axis_variance, spec.rate_variance])
    move, noise = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([spec.axis_noise, spec.rate_noise])
    lam = alpha**2 * (2 + kappa) - 2
    w = np.array([lam / (2 + lam), *[0.5 / (2 + lam)] * 4])
    out = []
    for i, z in enumerate(target):
        if i:
            m, p = move @ m, move @ p @ move.T + noise
        if np.isfinite(z):
            root = np.linalg.cholesky((2 + lam) * (p + 1e-12 * np.eye(2)))
            points = np.vstack([m, m + root.T, m - root.T])
            seen = np.interp(points[:, 0], ref_axis, ref_signal)
            mean = w @ seen
            s = w @ (seen - mean) ** 2 + spec.signal_noise
            gain = ((w * (seen - mean)) @ (points - m)) / s
            m, p = m + gain * (z - mean), p - np.outer(gain, gain) * s
        out.append(m)
    return np.array(out)


def smooth_axis(fm: np.ndarray, fp: np.ndarray, pm: np.ndarray, pp: np.ndarray) -> np.ndarray:
    """Backward pass over the filter's states."""
    move, out = np.array([[1.0, 1.0], [0.0, 1.0]]), fm.copy()
    for i in range(len(fm) - 2, -1, -1):
        out[i] = fm[i] + fp[i] @ move.T @ np.linalg.pinv(pp[i + 1]) @ (out[i + 1] - pm[i + 1])
    return out


@dataclass(frozen=True)
class PathSpec:
    scale: float = 1.0
    freedom: float = 4.0
    step_penalty: float = 1.0
    bend_penalty: float = 0.0
    start_axis: float | None = None
    start_penalty: float = 0.0


def path_costs(target: np.ndarray, ref_axis: np.ndarray, ref_signal: np.ndarray, spec: PathSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(emission by step and state, squared axis step by state pair, start cost); a missing target costs nothing."""
    r = (target[:, None] - ref_signal[None]) / spec.scale
    emission = np.where(np.isfinite(r), 0.5 * (spec.freedom + 1) * np.log1p(np.square(r) / spec.freedom), 0.0)
    step = spec.step_penalty * np.square(ref_axis[None] - ref_axis[:, None])
    start = np.zeros(len(ref_axis)) if spec.start_axis is None else spec.start_penalty * np.square(ref_axis - spec.start_axis)
    return emission, step, start


def viterbi_path(target: np.ndarray, ref_axis: np.ndarray, ref_signal: np.ndarray, spec: PathSpec = PathSpec()) -> tuple[np.ndarray, float]:
    """States of the cheapest path and its cost; the bend penalty looks at the step into the best predecessor."""
    emission, step, start = path_costs(target, ref_axis, ref_signal, spec)
    cost, back = emission[0] + start, []
    came = None
    for e in emission[1:]:
        total = cost[:, None] + step
        if spec.bend_penalty and came is not None:
            before = (ref_axis - ref_axis[came])[:, None]
            total = total + spec.bend_penalty * np.square(ref_axis[None] - ref_axis[:, None] - before)
        came = total.argmin(0)
        cost = total[came, np.arange(len(ref_axis))] + e
        back.append(came)
    states = [int(cost.argmin())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return np.array(states[::-1]), float(cost.min())


def posterior_axis(target: np.ndarray, ref_axis: np.ndarray, ref_signal: np.ndarray, spec: PathSpec = PathSpec()) -> np.ndarray:
    """Expected axis at each step by a forward and a backward pass in logs."""
    emission, step, start = path_costs(target, ref_axis, ref_signal, spec)
    lse = lambda m, axis: m.max(axis) + np.log(np.exp(m - m.max(axis, keepdims=True)).sum(axis))
    ahead, behind = [-(emission[0] + start)], [np.zeros(len(ref_axis))]
    for e in emission[1:]:
        ahead.append(lse(ahead[-1][:, None] - step, 0) - e)
    for e in emission[:0:-1]:
        behind.append(lse(behind[-1][None] - e[None] - step, 1))
    log = np.array(ahead) + np.array(behind[::-1])
    p = np.exp(log - log.max(1, keepdims=True))
    return (p * ref_axis).sum(1) / p.sum(1)


def axis_paths(rows: DataFrame, reference: Sequence[tuple[float, float]], method: str = "viterbi", spec: PathSpec | AxisSpec | None = None, axis0: float = 0.0, rate0: float = 0.0) -> DataFrame:
    """(series_id, position, axis) of each series (series_id, position, target) along a reference signal.

    Methods: viterbi, posterior, ekf, ukf, smoother.
    """
    ref = np.array(sorted(reference), float)
    a, s = ref[:, 0], ref[:, 1]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        z = pdf["target"].to_numpy(float)
        if method == "viterbi":
            axis = a[viterbi_path(z, a, s, spec or PathSpec())[0]]
        elif method == "posterior":
            axis = posterior_axis(z, a, s, spec or PathSpec())
        elif method == "ukf":
            axis = unscented_kalman(z, axis0, rate0, a, s, spec or AxisSpec())[:, 0]
        else:
            states = extended_kalman(z, axis0, rate0, a, s, spec or AxisSpec())
            axis = (smooth_axis(*states) if method == "smoother" else states[0])[:, 0]
        return pd.DataFrame({"series_id": pdf["series_id"], "position": pdf["position"].astype(float), "axis": axis})

    return rows.select("series_id", F.col("position").cast("double").alias("position"), F.col("target").cast("double").alias("target")).groupBy("series_id").applyInPandas(run, "series_id string, position double, axis double")


def fit_blend(rows: DataFrame, candidates: Sequence[str], target: str, rounds: int = 500, rate: float = 0.5) -> dict[str, float]:
    """Convex weights of candidate columns of least squared error, by exponentiated gradient on the second moments.

    Only the (k + 1)² moments leave the executors.
    """
    cols = [*candidates, target]
    row = rows.agg(*(F.avg(F.col(a) * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j)).first()
    k = len(candidates)
    m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
    w = np.full(k, 1 / k)
    scale = max(np.abs(m).max(), 1e-12)
    for _ in range(rounds):
        w = w * np.exp(-rate * (m[:k, :k] @ w - m[:k, k]) / scale)
        w /= w.sum()
    return dict(zip(candidates, w.tolist(), strict=True))


# --- embeddings ------------------------------------------------------------------------------------------------------


def embedding_table(rows: DataFrame, ids: str, target: str, dim: int = 4, prior: float = 10.0, rounds: int = 20, ridge: float = 0.1, seed: int = 3) -> DataFrame:
    """(id, vec): vectors whose product with a shared head explains the target beyond its mean, clipped to [-1, 1].

    Each id is its count and mean, so ids are one narrow aggregated table; a round updates all vectors as an expression and
    the head from dim² sums, which are all that the driver sees.
    """
    mu = rows.agg(F.avg(target)).first()[0] or 0.0
    table = rows.groupBy(F.col(ids).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("m"))
    table = table.select("id", "n", ((F.col("m") - F.lit(mu)) * F.col("n") / (F.col("n") + prior)).alias("r"))
    rng = np.random.default_rng(seed)
    head = rng.normal(0, 1, dim)
    head /= np.linalg.norm(head)
    top = table.agg(F.max(F.abs("r"))).first()[0] or 1.0
    vec = lambda h: F.array(*(F.greatest(F.least(F.col("r") / F.lit(top) * float(c) / float(h @ h + ridge / dim), F.lit(1.0)), F.lit(-1.0)) for c in h))
    for _ in range(rounds):
        v = table.withColumn("v", vec(head))
        sums = v.agg(*(F.sum(F.col("n") * F.get("v", F.lit(i)) * F.get("v", F.lit(j))).alias(f"a{i}_{j}") for i in range(dim) for j in range(dim)), *(F.sum(F.col("n") * F.get("v", F.lit(i)) * F.col("r") / F.lit(top)).alias(f"b{i}") for i in range(dim))).first()
        a = np.array([[sums[f"a{i}_{j}"] or 0.0 for j in range(dim)] for i in range(dim)])
        b = np.array([sums[f"b{i}"] or 0.0 for i in range(dim)])
        new = np.linalg.solve(a + ridge * np.eye(dim), b)
        if not np.isfinite(new).all() or np.linalg.norm(new) < 1e-9:
            break
        before, head = head, new / np.linalg.norm(new)
        if np.abs(head - before).max() < 1e-12:  # it no longer moves
            break
    return table.select("id", vec(head).alias("vec"))


def skip_gram(pairs: DataFrame, noise: DataFrame, dim: int = 8, epochs: int = 3, rate: float = 0.05, negatives: int = 3, parts: int = 8, seed: int = 5, max_nodes: int = 200_000) -> DataFrame:
    """(id, vec) by skip-gram with negative samples: parts train from shared starts, their vectors are averaged each epoch.

    The node table is broadcast to the kernels if it is counted to hold at most ``max_nodes``; larger graphs are to be cut
    into partitions first (the call says so).
    """
    if noise.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError("cut the graph into partitions of at most max_nodes nodes")
    table = noise.orderBy("node").collect()
    place = {r["node"]: i for i, r in enumerate(table)}
    p = np.array([r["weight"] for r in table], float)
    p /= p.sum()
    rng = np.random.default_rng(seed)
    inner, outer = rng.normal(0, 0.5 / dim, (len(table), dim)), np.zeros((len(table), dim))
    dealt = pairs.select("centre", "context", F.pmod(F.xxhash64("centre"), F.lit(parts)).cast("int").alias("part")).persist()
    sc = pairs.sparkSession.sparkContext

    def trainer(epoch: int, sent):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            place, p, inner, outer = sent.value
            inner, outer = inner.copy(), outer.copy()
            r = np.random.default_rng((seed, epoch, int(pdf["part"].iloc[0])))
            pdf = pdf.sort_values(["centre", "context"])
            c, o = pdf["centre"].map(place).to_numpy(), pdf["context"].map(place).to_numpy()
            order = r.permutation(len(c))
            for block in np.array_split(order, max(1, len(order) // 256)):
                for target, sign in [(o[block], 1.0)] + [(r.choice(len(p), len(block), p=p), 0.0) for _ in range(negatives)]:
                    a, b = inner[c[block]], outer[target]
                    g = rate * (sign - 1 / (1 + np.exp(-(a * b).sum(1))))[:, None]
                    np.add.at(inner, c[block], g * b)
                    np.add.at(outer, target, g * a)
            return pd.DataFrame({"i": np.arange(len(inner)), "a": list(inner), "b": list(outer)})

        return run

    for epoch in range(epochs):
        got = dealt.groupBy("part").applyInPandas(trainer(epoch, sc.broadcast((place, p, inner, outer))), "i long, a array<double>, b array<double>")
        mean = lambda c: F.array(*(F.avg(F.get(c, F.lit(j))) for j in range(dim)))
        rows = got.groupBy("i").agg(mean("a").alias("a"), mean("b").alias("b")).orderBy("i").collect()
        if rows:
            inner, outer = np.array([x["a"] for x in rows]), np.array([x["b"] for x in rows])
    dealt.unpersist()
    kind = noise.schema["node"].dataType.simpleString()
    return pairs.sparkSession.createDataFrame([(r["node"], v.tolist()) for r, v in zip(table, inner, strict=True)], f"id {kind}, vec array<double>")


# --- small network ---------------------------------------------------------------------------------------------------


#: Windows that one part of the network's training holds; more windows make more parts.
PART_WINDOWS = 50_000


def window_network(panel: DataFrame, horizon: int, window: int = 7, hidden: int = 16, epochs: int = 200, rate: float = 0.01, pool: int = 1, rounds: int = 4, part_windows: int = PART_WINDOWS, seed: int = 13, frequency: str = "D", model: str = "nbeats") -> DataFrame:
    """One hidden-layer network on scaled windows (input pooled by ``pool``), applied recursively to each series' tail.

    All windows are learned from: they are dealt to parts of about ``part_windows``, each part descends from the shared weights
    for its share of the epochs, and the weights are averaged by the parts' rows, ``rounds`` times. One part is plain descent.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("series_id").orderBy("ts").rowsBetween(-window, -1)
    stats = panel.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
    mean, scale = stats["m"] or 0.0, max(stats["s"] or 0.0, 1e-9)
    rows = panel.withColumn("x", F.collect_list("y").over(order)).where(F.size("x") == window)
    parts = max(1, math.ceil(rows.count() / part_windows))
    dealt = rows.select("series_id", "ts", "x", "y", F.pmod(F.xxhash64("series_id", "ts"), F.lit(parts)).cast("int").alias("part")).persist()
    pooled = lambda x: x.reshape(len(x), -1, pool).mean(2) if pool > 1 and x.shape[1] % pool == 0 else x
    rng = np.random.default_rng(seed)
    width = window // pool if pool > 1 and window % pool == 0 else window
    shapes = [(width, hidden), (hidden,), (hidden,), (1,)]
    flat = np.concatenate([rng.normal(0, 1 / math.sqrt(width), width * hidden), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), [0.0]])

    def unpacked(v: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([math.prod(s) for s in shapes])
        return [p.reshape(s) for p, s in zip(np.split(v, ends[:-1]), shapes, strict=True)]

    def trainer(start: np.ndarray, steps: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["series_id", "ts"])
            x, y = pooled((np.array(pdf["x"].tolist(), float) - mean) / scale), (pdf["y"].to_numpy(float) - mean) / scale
            w1, b1, w2, b2 = unpacked(start.copy())
            for _ in range(steps):
                a = np.maximum(x @ w1 + b1, 0)
                e = (a @ w2 + b2 - y) / len(y)
                back = np.outer(e, w2) * (a > 0)
                w2, b2 = w2 - rate * len(y) ** 0.5 * (a.T @ e), b2 - rate * len(y) ** 0.5 * e.sum()
                w1, b1 = w1 - rate * len(y) ** 0.5 * (x.T @ back), b1 - rate * len(y) ** 0.5 * back.sum(0)
            return pd.DataFrame({"n": [len(y)], "w": [np.concatenate([w1.ravel(), b1, w2, b2]).tolist()]})

        return run

    rounds = 1 if parts == 1 else rounds
    for _ in range(rounds):
        got = dealt.groupBy("part").applyInPandas(trainer(flat, max(epochs // rounds, 1)), "n long, w array<double>")
        each = got.select("n", F.posexplode("w").alias("i", "v")).groupBy("i").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v")).orderBy("i").collect()
        if each:
            flat = np.array([r["v"] for r in each])
    dealt.unpersist()
    w1, b1, w2, b2 = unpacked(flat)

    def ahead(y: np.ndarray, h: int) -> np.ndarray:
        hist = [float(y[0])] * max(window - len(y), 0) + list(y)
        for _ in range(h):
            x = pooled((np.array(hist[-window:])[None] - mean) / scale)
            hist.append(float((np.maximum(x @ w1 + b1, 0) @ w2 + b2)[0] * scale + mean))
        return np.array(hist[-h:])

    return per_series(panel, horizon, model, ahead, frequency)


# --- aggregation layers ----------------------------------------------------------------------------------------------


def layer_step(own: np.ndarray, near: np.ndarray, bias: np.ndarray, xu: np.ndarray, mu: np.ndarray, xv: np.ndarray, mv: np.ndarray, y: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One descent step of the link loss -log sigmoid(± z_u · z_v), z = relu(own x + near m + bias); the weights and the loss."""
    au, av = xu @ own.T + mu @ near.T + bias, xv @ own.T + mv @ near.T + bias
    zu, zv = np.maximum(au, 0), np.maximum(av, 0)
    s = 1 / (1 + np.exp(-np.clip((zu * zv).sum(1), -30, 30)))
    loss = float(-np.mean(np.where(y == 1, np.log(s + 1e-15), np.log(1 - s + 1e-15))))
    g = ((s - y) / len(y))[:, None]
    du, dv = g * zv * (au > 0), g * zu * (av > 0)
    return own - rate * (du.T @ xu + dv.T @ xv), near - rate * (du.T @ mu + dv.T @ mv), bias - rate * (du + dv).sum(0), loss


def train_layer(links: DataFrame, features: DataFrame, positives: DataFrame, negatives: DataFrame, dim: int = 8, epochs: int = 5, rate: float = 0.5, parts: int = 8, steps: int = 20, seed: int = 1) -> tuple[list, list, list, list[float]]:
    """(own, near, bias, losses) of one mean-aggregation layer by link prediction over (src, dst) pairs.

    Neighbour means are a distributed aggregation; each epoch, parts of the pairs take descent steps from shared weights, and
    the weights are averaged, so what travels is a few small matrices a part.
    """
    from gridloom.operators.graph import mean_neighbours

    means = mean_neighbours(links, features).select(F.col("node").alias("id"), F.col("vec").alias("m"))
    zero = F.transform("vec", lambda v: F.lit(0.0))
    known = features.join(means, "id", "left").select("id", F.transform("vec", lambda v: v.cast("double")).alias("x"), F.coalesce("m", zero).alias("m"))
    pairs = positives.select("src", "dst", F.lit(1.0).alias("y")).union(negatives.select("src", "dst", F.lit(0.0)))
    u, v = known.select(F.col("id").alias("src"), F.col("x").alias("xu"), F.col("m").alias("mu")), known.select(F.col("id").alias("dst"), F.col("x").alias("xv"), F.col("m").alias("mv"))
    rows = pairs.join(u, "src").join(v, "dst").withColumn("part", F.pmod(F.xxhash64("src", "dst"), F.lit(parts)).cast("int")).persist()
    width = rows.select(F.size("xu")).first()
    width = width[0] if width else 1
    rng = np.random.default_rng(seed)
    own, near, bias, losses = rng.normal(0, width**-0.5, (dim, width)), rng.normal(0, width**-0.5, (dim, width)), np.zeros(dim), []

    def trainer(weights):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b, c = weights
            pdf = pdf.sort_values(["src", "dst"])
            data = [np.array(pdf[k].tolist(), float) for k in ("xu", "mu", "xv", "mv")]
            y, loss = pdf["y"].to_numpy(float), 0.0
            for _ in range(steps):
                a, b, c, loss = layer_step(a, b, c, *data, y, rate)
            return pd.DataFrame({"n": [float(len(y))], "loss": [loss], "w": [np.concatenate([a.ravel(), b.ravel(), c]).tolist()]})

        return run

    for _ in range(epochs):
        got = rows.groupBy("part").applyInPandas(trainer((own, near, bias)), "n double, loss double, w array<double>").collect()  # a row a part
        if not got:
            break
        n = np.array([r["n"] for r in got])
        w = (np.array([r["w"] for r in got]) * n[:, None]).sum(0) / n.sum()
        own, near, bias = w[: dim * width].reshape(dim, width), w[dim * width : 2 * dim * width].reshape(dim, width), w[2 * dim * width :]
        losses.append(float((np.array([r["loss"] for r in got]) * n).sum() / n.sum()))
    rows.unpersist()
    return own.tolist(), near.tolist(), bias.tolist(), losses
