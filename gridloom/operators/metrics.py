"""Evaluation metrics as aggregations: point, scaled, probabilistic, calibration, ranking and spatial.

Each takes a DataFrame with named columns and optional grouping columns and returns one row a group, so a metric over a
thousand series is one job. Divisions are guarded as documented at each function.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.order import placed, running

FLOOR = 1e-12


def _g(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by)


def align(forecast: DataFrame, actual: DataFrame, keys: Sequence[str] = ("series_id", "ts")) -> DataFrame:
    """Forecasts (``mean``) with actuals (``y``) by key; a key on one side only, or twice on a side, is an error."""
    one = lambda d, v: d.groupBy(*keys).agg(F.first(v).alias(v), F.count(F.lit(1)).alias(f"n_{v}"))
    both = one(forecast, "mean").join(one(actual, "y"), list(keys), "full")
    bad = F.coalesce(F.col("n_mean"), F.lit(0)) != 1
    bad = bad | (F.coalesce(F.col("n_y"), F.lit(0)) != 1)
    return both.where(F.when(bad, F.raise_error(F.lit("forecast and actual keys differ"))).otherwise(True)).drop("n_mean", "n_y")


def point_metrics(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "mean") -> DataFrame:
    """mae, rmse, nrmse (by mean |y|, floored), wape (0 if the actuals are all 0), smape (rows with a denominator), bias (p - y)."""
    e, a = F.col(p) - F.col(y), F.abs(y)
    both = F.abs(p) + a
    rmse = F.sqrt(F.avg(e * e))
    smape = F.coalesce(F.avg(F.when(both > 0, 2 * F.abs(e) / both)), F.lit(0.0))
    return _g(df, by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), rmse.alias("rmse"), (rmse / F.greatest(F.avg(a), F.lit(FLOOR))).alias("nrmse"),
        F.when(F.sum(a) == 0, 0.0).otherwise(F.sum(F.abs(e)) / F.nullif(F.sum(a), F.lit(0.0))).alias("wape"), smape.alias("smape"), F.avg(e).alias("bias"),
    )


def volatility(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), p: str = "mean") -> DataFrame:
    """Mean absolute first difference of consecutive predictions; 0 for fewer than two. Without groups the rows are ordered by a
    range sort, and each meets the one before by its place."""
    if not by:
        at = placed(df.select(*order, F.col(p).alias("_p")), order, "_k").select("_k", "_p")
        steps = at.join(at.select((F.col("_k") + 1).alias("_k"), F.col("_p").alias("_q")), "_k")
        return steps.agg(F.coalesce(F.avg(F.abs(F.col("_p") - F.col("_q"))), F.lit(0.0)).alias("volatility"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return _g(df.withColumn("_d", F.abs(F.col(p) - F.lag(p).over(w))), by).agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("volatility"))


def seasonal_scale(train: DataFrame, season: int, by: Sequence[str] = (), squared: bool = False) -> DataFrame:
    """Mean absolute (or squared) seasonal difference, pooled over the series of a group; a zero scale is null."""
    d = F.col("y") - F.lag("y", season).over(Window.partitionBy("series_id").orderBy("ts"))
    scale = F.avg(F.col("_d") * F.col("_d") if squared else F.abs("_d"))
    return _g(train.withColumn("_d", d), by).agg(F.when(scale > 0, scale).alias("scale"))


def wrmsse(scored: DataFrame, train: DataFrame, weights: DataFrame, season: int = 1) -> DataFrame:
    """By series: sqrt(mse / scale), normalised weight, contribution. The score is the sum of contributions."""
    e = F.col("mean") - F.col("y")
    mse = scored.groupBy("series_id").agg(F.avg(e * e).alias("mse"))
    total = weights.agg(F.sum(F.greatest(F.col("weight"), F.lit(0.0)))).first()[0] or 0.0
    n = weights.count() if not total else 0
    w = (F.greatest(F.col("weight"), F.lit(0.0)) / total) if total else F.lit(1.0 / max(n, 1))
    rows = mse.join(seasonal_scale(train, season, ["series_id"], squared=True), "series_id").join(weights, "series_id")
    rows = rows.select("series_id", F.sqrt(F.col("mse") / F.col("scale")).alias("rmsse"), w.alias("weight"))
    return rows.withColumn("contribution", F.col("rmsse") * F.col("weight"))


def equal_level_wrmsse(levels: dict[str, tuple[DataFrame, DataFrame, DataFrame]], season: int = 1) -> float:
    """The mean over levels (name: scored, train, weights) of each level's weighted score."""
    scores = [wrmsse(*parts, season=season).agg(F.sum("contribution")).first()[0] for parts in levels.values()]
    return sum(scores) / len(scores)


def m_competition(smape: float, mase: float, base_smape: float, base_mase: float) -> dict[str, float]:
    """Ratios to the baseline (floored) and their mean, the overall weighted average."""
    a, b = smape / max(base_smape, FLOOR), mase / max(base_mase, FLOOR)
    return {"smape": smape, "mase": mase, "relative_smape": a, "relative_mase": b, "owa": (a + b) / 2}


def pinball(y: Column, q: Column, level: float) -> Column:
    r = y - q
    return F.greatest(level * r, (level - 1) * r)


def pinball_loss(df: DataFrame, level: float, by: Sequence[str] = (), y: str = "y", q: str = "mean") -> DataFrame:
    return _g(df, by).agg(F.avg(pinball(F.col(y), F.col(q), level)).alias("pinball"))


def interval_metrics(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Weighted share of y inside [lower, upper] and the mean width; lower > upper is an error."""
    w = F.col(weight) if weight else F.lit(1.0)
    inside = F.when(F.col("lower") > F.col("upper"), F.raise_error(F.lit("lower above upper")).cast("double")).otherwise(F.col("y").between(F.col("lower"), F.col("upper")).cast("double"))
    return _g(df, by).agg((F.sum(w * inside) / F.sum(w)).alias("coverage"), (F.sum(w * (F.col("upper") - F.col("lower"))) / F.sum(w)).alias("width"))


def rank_probability_score(probabilities: Column, observed: Column) -> Column:
    """Mean squared error of cumulative probabilities over the K - 1 cuts; ``observed`` counts from 0."""
    k = F.size(probabilities)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct((a["c"] + F.element_at(probabilities, i)).alias("c"), (a["s"] + F.pow(a["c"] + F.element_at(probabilities, i) - (observed < i).cast("double"), 2)).alias("s")),
    )
    return total["s"] / F.greatest(k - 1, F.lit(1))


def log_loss(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", eps: float = 1e-15) -> DataFrame:
    """Binary log-loss; probabilities clipped, then the pair normalised to 1."""
    a = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    b = F.least(F.greatest(1 - F.col(p), F.lit(eps)), F.lit(1 - eps))
    return _g(df, by).agg(F.avg(-F.ln(F.when(F.col(y) == 1, a).otherwise(b) / (a + b))).alias("log_loss"))


def brier(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    return _g(df, by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def calibration_bins(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Equal-width bins of the probability, the last closed on the right: count, mean probability, share of positives."""
    return df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("share"))


def ece(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Expected calibration error."""
    return calibration_bins(df, bins, y, p).agg((F.sum(F.col("n") * F.abs(F.col("share") - F.col("mean_p"))) / F.sum("n")).alias("ece"))


def score_counts(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    """Positives and negatives at each distinct score: all that ranking areas need, and small after partial aggregation."""
    return df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score", one_class: float | None = None) -> DataFrame:
    """Area under the ROC curve, half credit for ties; ``one_class`` (or null) where a class is missing."""
    counts = score_counts(df, by, y, score)
    if by:
        w = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        c = counts.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    else:
        c = running(counts, ["s"], {"_upto": F.col("n")}).withColumn("below", F.col("_upto") - F.col("n"))
    won = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    return _g(c, by).agg(F.when((F.sum("p") > 0) & (F.sum("n") > 0), won / (F.sum("p") * F.sum("n"))).otherwise(F.lit(one_class).cast("double")).alias("auc"))


def average_precision(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score", tie: str = "id") -> DataFrame:
    """Sum of recall steps times precision, rows ordered by falling score, ties by ``tie``."""
    if by:
        part = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
        hits = F.sum(F.col(y).cast("long")).over(part.rowsBetween(Window.unboundedPreceding, 0))
        rows = df.withColumn("_p", hits / F.row_number().over(part))
    else:
        upto = running(df.select(y, score, tie), [F.col(score).desc(), tie], {"_hits": F.col(y).cast("long"), "_rows": F.lit(1)})
        rows = upto.withColumn("_p", F.col("_hits") / F.col("_rows"))
    return _g(rows, by).agg((F.sum(F.when(F.col(y) == 1, F.col("_p"))) / F.sum(F.col(y).cast("long"))).alias("average_precision"))


def ranked(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), tie)))


def ndcg(df: DataFrame, group: str, y: str, score: str, tie: str, k: int | None = None) -> DataFrame:
    """By group: DCG over ideal DCG with gain 2^max(y, 0) - 1 and discount 1 / log2(position + 1); 0 if the ideal is 0."""
    gain = F.pow(F.lit(2.0), F.greatest(F.col(y), F.lit(0))) - 1
    ideal = F.row_number().over(Window.partitionBy(group).orderBy(F.col(y).desc(), tie))
    rows = ranked(df, group, score, tie).withColumn("_ideal", ideal).withColumn("_gain", gain)
    at = lambda pos: F.sum(F.when(F.lit(True) if k is None else F.col(pos) <= k, F.col("_gain") / F.log2(F.col(pos) + 1)).otherwise(0.0))
    return rows.groupBy(group).agg(F.when(at("_ideal") > 0, at("position") / F.nullif(at("_ideal"), F.lit(0.0))).otherwise(0.0).alias("ndcg"))


def rank_hits(df: DataFrame, group: str, y: str, score: str, tie: str, k: int) -> DataFrame:
    """By group: average precision, reciprocal rank (both 0 without positives), recall@k and hit@k (null without)."""
    rows = ranked(df, group, score, tie).withColumn("_y", (F.col(y) > 0).cast("int"))
    rows = rows.withColumn("_hits", F.sum("_y").over(Window.partitionBy(group).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)))
    n, top = F.sum("_y"), F.sum(F.when(F.col("position") <= k, F.col("_y")).otherwise(0))
    return rows.groupBy(group).agg(
        F.coalesce(F.sum(F.when(F.col("_y") == 1, F.col("_hits") / F.col("position"))) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("average_precision"),
        F.coalesce(1 / F.min(F.when(F.col("_y") == 1, F.col("position"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(n > 0, top / F.nullif(n, F.lit(0))).alias("recall_at_k"), F.when(n > 0, (top > 0).cast("double")).alias("hit_at_k"),
    )


def conformal_quantile(df: DataFrame, alpha: float, y: str = "y", p: str = "mean") -> float:
    """The ceil((n + 1)(1 - alpha))-th smallest absolute residual, at most the n-th; no interpolation."""
    r = df.select(F.abs(F.col(y) - F.col(p)).alias("r"), F.xxhash64(*df.columns).alias("t"))
    n = r.count()
    k = min(max(math.ceil((n + 1) * (1 - alpha)), 1), n)
    # the k-th smallest, from distinct values with running counts: ties need no order, and equal values are one row
    counts = r.groupBy("r").count()
    return float(running(counts, ["r"], {"c": F.col("count")}).where(F.col("c") >= k).agg(F.min("r")).first()[0])


def with_intervals(df: DataFrame, q: float, p: str = "mean") -> DataFrame:
    return df.withColumn("lower", F.col(p) - q).withColumn("upper", F.col(p) + q)


def non_crossing(quantiles: Column) -> Column:
    """An array of quantile values by rising level, each at least the one before."""
    return F.transform(quantiles, lambda x, i: F.array_max(F.slice(quantiles, 1, i + 1)))


def jitter_volatility(df: DataFrame, by: str = "sample", p: str = "mean") -> DataFrame:
    """Mean over samples of the population deviation of repeated predictions."""
    return df.groupBy(by).agg(F.stddev_pop(p).alias("s")).agg(F.avg("s").alias("jitter"))


def jitter_from_baseline(df: DataFrame, p: str = "mean", baseline: str = "baseline") -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(p) - F.col(baseline), 2))).alias("jitter"))


def spatial_cv_gap(random_score: float, spatial_score: float) -> float:
    return random_score - spatial_score


def morans_i(points: DataFrame, value: str = "value", radius: float | None = None) -> DataFrame:
    """Moran's I of (id, x, y, value); inverse-distance weights, or 1 within a radius.

    With a radius, pairs come from an equi-join on grid cells of that side (each point meets 9 cells), so near points alone
    are paired. Without one the weights are all pairs by definition.
    """
    stats = points.agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"), F.var_pop(value).alias("v")).first()
    z = points.select("id", "x", "y", (F.col(value) - F.lit(stats["m"])).alias("z"))
    if radius is None:
        other = z.select(F.col("id").alias("i2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
        pairs = z.join(other, F.col("id") < F.col("i2"))
        w = 1 / F.greatest(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")), F.lit(FLOOR))
    else:
        pairs = near_pairs(z, radius, ["z"])
        w = F.lit(1.0)
    s = pairs.agg(F.sum(w).alias("w"), F.sum(w * F.col("z") * F.col("z2")).alias("c"))
    return s.select((F.lit(float(stats["n"])) / (2 * F.col("w")) * (2 * F.col("c")) / F.lit((stats["v"] or 0.0) * stats["n"])).alias("morans_i"))


def near_pairs(points: DataFrame, radius: float, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs id < i2 at most ``radius`` apart, by an equi-join on grid cells; columns of the second point end in 2."""
    cell = lambda c: F.floor(F.col(c) / radius)
    left = points.select("id", "x", "y", *keep, cell("x").alias("cx"), cell("y").alias("cy"))
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    right = points.select(F.col("id").alias("i2"), F.col("x").alias("x2"), F.col("y").alias("y2"), *(F.col(k).alias(f"{k}2") for k in keep), cell("x").alias("rx"), cell("y").alias("ry"))
    right = right.withColumn("o", F.explode(offsets)).withColumn("cx", F.col("rx") + F.col("o.dx")).withColumn("cy", F.col("ry") + F.col("o.dy")).drop("o", "rx", "ry")
    return left.join(right, ["cx", "cy"]).where((F.col("id") < F.col("i2")) & (F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= radius)).drop("cx", "cy")


def group_errors(df: DataFrame, group: str, y: str = "y", p: str = "mean") -> DataFrame:
    e = F.col(p) - F.col(y)
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def horizon_rollup(df: DataFrame, window: float = 0.1, horizon: str = "horizon") -> DataFrame:
    """Metrics by horizon over a rolling share of rows ordered by horizon: means of the last ceil(window * n) rows, at each
    horizon's last row."""
    n = df.count()
    size = max(1, math.ceil(window * n))
    e = F.col("mean") - F.col("y")
    upto = running(df.select(horizon, "series_id", "ts", "mean", "y"), [horizon, "series_id", "ts"], {"_k": F.lit(1), "_a": F.abs(e), "_s": e * e})
    ends = upto.groupBy(horizon).agg(F.max(F.struct("_k", "_a", "_s")).alias("_end"))  # sums up to each horizon's last row
    starts = upto.select(F.col("_k").alias("_from"), F.col("_a").alias("_a0"), F.col("_s").alias("_s0"))
    both = ends.withColumn("_from", F.col("_end._k") - size).join(starts, "_from", "left")
    held = F.least(F.col("_end._k"), F.lit(size))
    less = lambda c: (F.col(f"_end.{c}") - F.coalesce(F.col(f"{c}0"), F.lit(0.0))) / held
    return both.select(horizon, less("_a").alias("mae"), F.sqrt(F.greatest(less("_s"), F.lit(0.0))).alias("rmse"))
