"""Categorical encoders and id dictionaries."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.order import placed


def target_mean(train: DataFrame, column: str, target: str, weight: str | None = None, smoothing: float = 10.0) -> DataFrame:
    """(Σ w y + s μ) / (Σ w + s) of each category; μ is the weighted mean of all rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    mu = train.agg(F.sum(w * F.col(target)) / F.sum(w)).first()[0]
    return train.groupBy(column).agg(((F.sum(w * F.col(target)) + smoothing * F.lit(mu)) / (F.sum(w) + smoothing)).alias("encoded"))


def leave_one_out(train: DataFrame, column: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """The same without the row itself; partial sums by category joined back, so a hot category is split, not gathered."""
    mu = train.agg(F.avg(target)).first()[0]
    sums = train.groupBy(column).agg(F.sum(target).alias("_s"), F.count(F.lit(1)).alias("_n"))
    joined = train.join(sums, train[column].eqNullSafe(sums[column]), "left").drop(sums[column])
    return joined.withColumn("encoded", (F.col("_s") - F.col(target) + smoothing * F.lit(mu)) / (F.col("_n") - 1 + smoothing)).drop("_s", "_n")


def apply_mapping(rows: DataFrame, mapping: DataFrame, column: str, fallback: float, out: str = "encoded") -> DataFrame:
    """Encoded values by a left join; unknown categories get the fallback."""
    return rows.join(mapping, column, "left").withColumn(out, F.coalesce(out, F.lit(fallback)))


def context_target_mean(rows: DataFrame, train: DataFrame, levels: Sequence[str], target: str, smoothing: float = 10.0) -> DataFrame:
    """Target mean of the finest level that training has seen, else the next coarser one, else the overall mean."""
    mu = train.agg(F.avg(target)).first()[0]
    out = rows
    for level in levels:
        out = out.join(target_mean(train, level, target, smoothing=smoothing).withColumnRenamed("encoded", f"_{level}"), level, "left")
    return out.withColumn("encoded", F.coalesce(*(F.col(f"_{level}") for level in levels), F.lit(mu))).drop(*(f"_{level}" for level in levels))


def one_hot(column: Column, categories: Sequence[str]) -> dict[str, Column]:
    """0/1 by category; unknown ones are all 0."""
    return {f"is_{c}": F.coalesce((column == c).cast("double"), F.lit(0.0)) for c in categories}


def subsets(categories: Sequence[str]) -> list[tuple[str, ...]]:
    """Proper subsets of at most half the categories (three or four of them), one of each complementary pair."""
    ordered = sorted(categories)
    if not 3 <= len(ordered) <= 4:
        return [(c,) for c in ordered]
    out = []
    for size in range(1, len(ordered) // 2 + 1):
        for chosen in combinations(ordered, size):
            rest = tuple(c for c in ordered if c not in chosen)
            if 2 * size < len(ordered) or chosen < rest:
                out.append(chosen)
    return out


def subset_indicators(column: Column, categories: Sequence[str]) -> dict[str, Column]:
    return {"in_" + "_".join(s): F.coalesce(column.isin(*s).cast("double"), F.lit(0.0)) for s in subsets(categories)}


def ordinal(column: Column, categories: Sequence[str]) -> Column:
    """Place in the sorted categories from 0; -1 if unknown."""
    return F.coalesce((F.array_position(F.array(*map(F.lit, sorted(categories))), column) - 1).cast("double"), F.lit(-1.0))


def categories_of(train: DataFrame, column: str, limit: int) -> list[str] | None:
    """The sorted categories if there are at most ``limit`` (a parameter, so the list is bounded), else None."""
    found = [r[0] for r in train.where(F.col(column).isNotNull()).select(column).distinct().limit(limit + 1).collect()]
    return sorted(found) if len(found) <= limit else None


def encode(rows: DataFrame, train: DataFrame, column: str, target: str, low: int = 16, smoothing: float = 10.0) -> DataFrame:
    """Indicators for few categories (subset indicators for three or four), a target mean for many."""
    cats = categories_of(train, column, low)
    if cats is None:
        mapping = target_mean(train, column, target, smoothing=smoothing).withColumnRenamed("encoded", f"{column}_mean")
        return apply_mapping(rows, mapping, column, train.agg(F.avg(target)).first()[0], f"{column}_mean")
    indicators = subset_indicators(F.col(column), cats) if 3 <= len(cats) <= 4 else one_hot(F.col(column), cats)
    return rows.withColumns({f"{column}_{k}": v for k, v in indicators.items()})


def dictionary(rows: DataFrame, column: str, order: str) -> DataFrame:
    """(column, code): codes from 0 by the first place (smallest ``order``) of each value."""
    first = rows.groupBy(column).agg(F.min(order).alias("_o"))
    return placed(first, ["_o", column], "_k").select(column, (F.col("_k") - 1).alias("code"))


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """n / (classes * count) of each label."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    return counts.select(label, (F.lit(float(total[0])) / (total[1] * F.col("_n"))).alias("weight"))
