"""Ranks, portfolios and their probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.metrics import rank_probability_score
from gridloom.operators.order import placed


def rank_buckets(rows: DataFrame, value: str, buckets: int, tie: str, by: Sequence[str] = (), out: str = "bucket") -> DataFrame:
    """floor((place from 0) * buckets / n) by rising value."""
    if not by:
        n = rows.count()
        return placed(rows, [value, tie], "_k").withColumn(out, F.floor((F.col("_k") - 1) * buckets / n).cast("int")).drop("_k")
    part = Window.partitionBy(*by)
    place = F.row_number().over(part.orderBy(value, tie)) - 1
    return rows.withColumn(out, F.floor(place * buckets / F.count(F.lit(1)).over(part)).cast("int"))


def hit_rates(rows: DataFrame, buckets: int, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Shares of exact hits, of hits within one bucket, and of predicted extremes that are right."""
    a, p = F.col(actual), F.col(predicted)
    extreme = (p == 0) | (p == buckets - 1)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((a == p).cast("double")).alias("exact"), F.avg((F.abs(a - p) <= 1).cast("double")).alias("within_one"), F.avg(F.when(extreme, (a == p).cast("double"))).alias("extreme"))


def calibrated_probabilities(rows: DataFrame, buckets: int, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(predicted, actual, probability): counts plus one of a confusion table, normalised by row, then drawn to the uniform by
    support / (support + 20 buckets), where support is the number of rows."""
    n = rows.count()
    spine = rows.sparkSession.range(buckets * buckets).select(F.floor(F.col("id") / buckets).cast("int").alias(predicted), (F.col("id") % buckets).cast("int").alias(actual))
    counts = rows.groupBy(predicted, actual).agg(F.count(F.lit(1)).alias("_n"))
    c = F.coalesce("_n", F.lit(0)) + 1
    raw = c / F.sum(c).over(Window.partitionBy(predicted))
    keep = n / (n + 20 * buckets)
    return spine.join(counts, [predicted, actual], "left").withColumn("probability", keep * raw + (1 - keep) / buckets).drop("_n")


def extreme_decisions(rows: DataFrame, score: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Long the top fifth, short the bottom fifth (one at least), half a unit a side; ``weight`` is 0 for the rest."""
    if not by:
        n = rows.count()
        k = max(n // 5, 1)
        ends = placed(placed(rows, [score, tie], "_low"), [F.col(score).desc(), tie], "_high")
        return ends.withColumn("weight", F.when(F.col("_high") <= k, 0.5 / k).when(F.col("_low") <= k, -0.5 / k).otherwise(0.0)).drop("_low", "_high")
    part = Window.partitionBy(*by)
    k = F.greatest(F.floor(F.count(F.lit(1)).over(part) / 5), F.lit(1))
    low, high = F.row_number().over(part.orderBy(score, tie)), F.row_number().over(part.orderBy(F.col(score).desc(), tie))
    return rows.withColumn("weight", F.when(high <= k, 0.5 / k).when(low <= k, -0.5 / k).otherwise(0.0))


def portfolio_summary(rows: DataFrame, by: Sequence[str] = (), weight: str = "weight", ret: str = "ret") -> DataFrame:
    w, r = F.col(weight), F.col(ret)
    part = lambda c: F.coalesce(F.sum(F.when(c, w * r)), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count_if(w > 0).alias("longs"), F.count_if(w < 0).alias("shorts"), F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"),
        part(w > 0).alias("long_return"), part(w < 0).alias("short_return"), F.sum(w * r).alias("net_return"),
    )


def decision_loss(scored: DataFrame, probabilities: Column, observed: Column, penalty: float = 1.0, weight: str = "weight", ret: str = "ret") -> DataFrame:
    """- net return + penalty * mean rank probability score."""
    return scored.withColumn("_rps", rank_probability_score(probabilities, observed)).agg((-F.sum(F.col(weight) * F.col(ret)) + penalty * F.avg("_rps")).alias("decision_loss"))
