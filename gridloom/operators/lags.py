"""Lag features: strictly prior windows over each series, built in one window pass.

Every feature of a row reads rows before it only. A full window that lacks history makes the row drop out (``drop=True``);
partial means take what there is. All windows share one partitioning and order, so the plan has one shuffle and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.calendar import calendar_columns


@dataclass(frozen=True)
class LagSpec:
    lags: tuple[int, ...] = (1,)
    roll_mean: tuple[int, ...] = ()
    roll_std: tuple[int, ...] = ()
    roll_min: tuple[int, ...] = ()
    roll_max: tuple[int, ...] = ()
    partial_mean: tuple[int, ...] = ()
    ewm_percent: tuple[int, ...] = ()
    deltas: tuple[int, ...] = ()
    trends: tuple[int, ...] = ()
    calendar: tuple[str, ...] = ()
    covariates: tuple[str, ...] = ()
    indicators: tuple[tuple[str, float], ...] = ()
    interactions: tuple[tuple[str, str], ...] = ()
    phase: int = 0

    def names(self) -> list[str]:
        """Feature names in their fixed order."""
        out = [f"target_lag_{k}" for k in self.lags]
        for kind in ("mean", "std", "min", "max"):
            out += [f"target_roll_{kind}_{w}" for w in getattr(self, f"roll_{kind}")]
        out += [f"target_partial_roll_mean_{w}" for w in self.partial_mean] + [f"target_ewm_alpha_{a:03d}" for a in self.ewm_percent]
        out += [f"target_delta_lag_{k}" for k in self.deltas] + [f"target_roll_trend_{w}" for w in self.trends]
        out += [f"calendar_{c}" for c in self.calendar] + (["position", f"phase_{self.phase}"] if self.phase else [])
        out += [f"covariate_{c}" for c in self.covariates] + [f"covariate_{c}_is_{v:g}" for c, v in self.indicators]
        return out + [f"covariate_{c}_x_{k}" for c, k in self.interactions]

    def longest(self) -> int:
        return max([*self.lags, *self.roll_mean, *self.roll_std, *self.roll_min, *self.roll_max, *self.trends, *(d + 1 for d in self.deltas), 1])

    def fitted_to(self, shortest: int) -> LagSpec:
        """Only lags and windows that a history of ``shortest`` rows can fill; lag 1 if none is left."""
        fit = lambda xs: tuple(x for x in xs if x <= shortest - 1)
        changed = {n: fit(getattr(self, n)) for n in ("lags", "roll_mean", "roll_std", "roll_min", "roll_max", "partial_mean", "deltas", "trends")}
        if not any(changed.values()):
            changed["lags"] = (1,)
        return LagSpec(**{**self.__dict__, **changed})


def _full(value: Column, w: int, order, kind) -> Column:
    frame = order.rowsBetween(-w, -1)
    return F.when(F.count(F.lit(1)).over(frame) == w, kind(value).over(frame))


def ewm_prior(y: Column, alpha: float, order) -> Column:
    """Exponential mean of the prior rows, seeded by the first; null for the first row."""
    prior = F.collect_list(y).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(F.size(prior) > 0, F.aggregate(F.slice(prior, 2, 1_000_000_000), F.get(prior, F.lit(0)), lambda a, v: F.lit(alpha) * v + F.lit(1 - alpha) * a))


def lag_features(panel: DataFrame, spec: LagSpec, drop: bool = True) -> DataFrame:
    """series_id, ts, y and the features of ``spec.names()``."""
    order = Window.partitionBy("series_id").orderBy("ts")
    y, cal = F.col("y"), calendar_columns(F.col("ts"))
    cov = lambda c: F.coalesce(F.col(c), F.lag(c).over(order))
    out: list[Column] = [F.lag(y, k).over(order) for k in spec.lags]
    for kind, sizes in ((F.avg, spec.roll_mean), (F.stddev_pop, spec.roll_std), (F.min, spec.roll_min), (F.max, spec.roll_max)):
        out += [_full(y, w, order, kind) for w in sizes]
    out += [F.avg(y).over(order.rowsBetween(-w, -1)) for w in spec.partial_mean]
    out += [ewm_prior(y, a / 100, order) for a in spec.ewm_percent]
    out += [F.lag(y, 1).over(order) - F.lag(y, k + 1).over(order) for k in spec.deltas]
    out += [(F.lag(y, 1).over(order) - F.lag(y, w).over(order)) / (w - 1) if w > 1 else F.lit(0.0) for w in spec.trends]
    out += [cal[c] for c in spec.calendar]
    position = F.row_number().over(order) - 1
    out += [position, F.pmod(position, F.lit(spec.phase))] if spec.phase else []
    out += [cov(c) for c in spec.covariates] + [F.when(F.abs(cov(c) - v) <= 1e-12, 1.0).otherwise(0.0) for c, v in spec.indicators]
    out += [cov(c) * cal[k] for c, k in spec.interactions]
    names = spec.names()
    rows = panel.select("series_id", "ts", "y", *(c.cast("double").alias(n) for c, n in zip(out, names, strict=True)))
    return rows.dropna(subset=names) if drop else rows


def next_step(panel: DataFrame, spec: LagSpec, future: DataFrame) -> DataFrame:
    """Features of one coming row a series (series_id, ts and covariates): the whole history is prior to it."""
    rows = panel.withColumn("_new", F.lit(False)).unionByName(future.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    flagged = lag_features(rows, spec, drop=False).join(future.select("series_id", "ts"), ["series_id", "ts"], "left_semi")
    return flagged.drop("y").dropna(subset=spec.names())


def supported(panel: DataFrame, spec: LagSpec) -> LagSpec:
    """The spec shrunk to the panel's shortest series."""
    shortest = panel.groupBy("series_id").count().agg(F.min("count")).first()[0] or 1
    return spec.fitted_to(shortest)


def recency_weights(rows: DataFrame, half_life: float) -> DataFrame:
    """2^(-age / half_life) by rows from the series' end, scaled to a mean of 1 over the panel."""
    age = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("ts").desc())) - 1
    raw = rows.withColumn("raw", F.pow(F.lit(2.0), -age / half_life))
    mean = raw.agg(F.avg("raw")).first()[0]
    return raw.withColumn("weight", F.col("raw") / F.lit(mean)).drop("raw")


def direct_targets(features: DataFrame, horizon: int) -> DataFrame:
    """One row a (series, origin, step) with the target that many rows after the origin's features: training data of direct models."""
    order = Window.partitionBy("series_id").orderBy("ts")
    wide = features.select("*", *(F.lead("y", h - 1).over(order).alias(f"_y{h}") for h in range(1, horizon + 1)))
    each = F.array(*(F.struct(F.lit(h).alias("step"), F.col(f"_y{h}").alias("label")) for h in range(1, horizon + 1)))
    return wide.withColumn("_t", F.explode(each)).select(*features.columns, "_t.step", "_t.label").where(F.col("label").isNotNull())
