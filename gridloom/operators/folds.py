"""Cross-validation folds: spatial blocks and buffers, groups, time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.order import placed


def _deal(counts: Sequence[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first, behind, order) for (size, number of groups) by falling size: the groups of these places, counted over all
    sizes, go to the folds of ``order`` in turn.

    Groups of one size fill the smallest folds in rounds, the same folds in the same order until the next fold is as small, so
    a size has at most ``folds`` entries however many groups it has.
    """
    load, at, out = [0] * folds, 0, []
    for size, n in counts:
        end = at + n
        while at < end:
            by = sorted(range(folds), key=lambda i: (load[i], i))
            low = by[0]
            order = [i for i in by if (load[i], i) < (load[low] + size, low)]
            left = end - at
            if len(order) < folds:
                i = by[len(order)]
                far = load[i] - load[low]
                rounds = far // size - (far % size == 0 and i < low)
                left = min(left, rounds * len(order))
            for k, i in enumerate(order):
                load[i] += size * (left // len(order) + (k < left % len(order)))
            out.append((size, at, at + left, order))
            at += left
    return out


def balanced(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """``fold`` by group: largest group first into the smallest fold (ties: the group's value, the fold's number).

    Only the number of groups of each size goes to the driver (distinct sizes, at most the root of twice the rows). A group's
    place comes from a range sort and the numbers of groups in the parts before, so no task holds all groups.
    """
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    ordered = placed(sizes, [F.col("n").desc(), F.col("_g")], "_place").withColumn("_place", F.col("_place") - 1)
    counts = [(r["n"], r["c"]) for r in ordered.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("n").desc()).collect()]
    dealt = rows.sparkSession.createDataFrame(_deal(counts, folds), "n long, _first long, _behind long, _order array<int>")
    here = (ordered["n"] == dealt["n"]) & (F.col("_place") >= F.col("_first")) & (F.col("_place") < F.col("_behind"))
    turn = F.get("_order", F.pmod(F.col("_place") - F.col("_first"), F.size("_order")).cast("int"))
    # a row for each distinct size and round of folds: at most ``folds`` times the root of twice the rows
    table = ordered.join(F.broadcast(dealt), here).select("_g", turn.alias("fold"))
    return rows.join(table, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def grouped_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    return balanced(rows, group, folds)


def spatial_blocks(rows: DataFrame, folds: int = 5, shape: tuple[int, int] = (5, 5), x: str = "x", y: str = "y") -> DataFrame:
    """``block`` of an equal-width grid over the points' extent, and its balanced ``fold``."""
    e = rows.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    cell = lambda c, lo, hi, k: F.least(F.floor((F.col(c) - lo) / max(hi - lo, 1e-12) * k), F.lit(k - 1)) if lo is not None else F.lit(0)
    block = cell(x, e["x0"], e["x1"], shape[0]) * shape[1] + cell(y, e["y0"], e["y1"], shape[1])
    return balanced(rows.withColumn("block", block.cast("long")), "block", folds)


def buffered_training(rows: DataFrame, fold: int, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Training rows of a fold: those of other folds that are more than ``radius`` from every row of the fold.

    An anti join over grid cells of that side: each test row stands in its 9 neighbouring cells, so a training row meets
    near test rows only. Distinct test positions are enough.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    train = rows.where(F.col("fold") != fold).withColumn("_cx", cell(x)).withColumn("_cy", cell(y))
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    test = rows.where(F.col("fold") == fold).select(F.col(x).alias("_tx"), F.col(y).alias("_ty"), cell(x).alias("_tcx"), cell(y).alias("_tcy")).distinct().withColumn("o", F.explode(offsets))
    test = test.select("_tx", "_ty", (F.col("_tcx") + F.col("o.a")).alias("_kx"), (F.col("_tcy") + F.col("o.b")).alias("_ky"))
    near = (F.col("_cx") == F.col("_kx")) & (F.col("_cy") == F.col("_ky")) & (F.hypot(F.col(x) - F.col("_tx"), F.col(y) - F.col("_ty")) <= radius)
    return train.join(test, near, "left_anti").drop("_cx", "_cy")


def temporal_folds(rows: DataFrame, folds: int = 5, time: str = "ts") -> DataFrame:
    """Contiguous folds over the distinct times; the first folds take the remainder."""
    times = rows.select(time).distinct().withColumn("fold", F.ntile(folds).over(Window.orderBy(time)) - 1)
    return rows.join(times, time)


def temporal_training(rows: DataFrame, fold: int, gap: int = 0, time: str = "ts") -> DataFrame:
    """Rows outside the fold whose time's number is more than ``gap`` from the fold's ends."""
    t = rows.select(time, "fold").distinct().withColumn("_t", F.row_number().over(Window.orderBy(time)))
    e = t.where(F.col("fold") == fold).agg(F.min("_t"), F.max("_t")).first()
    keep = t.where((F.col("_t") < e[0] - gap) | (F.col("_t") > e[1] + gap)).select(time)
    return rows.join(keep, time, "left_semi")


def out_of_time(rows: DataFrame, share: float, time: str = "ts") -> DataFrame:
    """``part``: test for the last share of distinct times (one at least), train for the rest."""
    times = rows.select(time).distinct()
    n = times.count()
    back = F.row_number().over(Window.orderBy(F.col(time).desc()))
    return rows.join(times.withColumn("part", F.when(back <= max(1, round(n * share)), "test").otherwise("train")), time)


def environmental_folds(rows: DataFrame, features: Sequence[str], folds: int = 5) -> DataFrame:
    """Chunks along the feature of the widest standardised range, cut at quantiles of it."""
    stats = rows.agg(*(((F.max(f) - F.min(f)) / F.nullif(F.stddev_pop(f), F.lit(0.0))).alias(f) for f in features)).first()
    axis = max(features, key=lambda f: (stats[f] or 0.0))
    cuts = rows.approxQuantile(axis, [i / folds for i in range(1, folds)], 0.0005) if folds > 1 else []
    fold = F.lit(0)
    for c in cuts:
        fold = fold + (F.col(axis) > c).cast("int")
    return rows.withColumn("fold", fold)


def leaking_groups(folds: DataFrame, group: str) -> DataFrame:
    """(fold, group) that stand in both parts of a fold; must be empty."""
    return folds.groupBy("fold", group).agg(F.count_distinct("part").alias("parts")).where(F.col("parts") > 1).select("fold", group)


def time_leaks(folds: DataFrame) -> DataFrame:
    """Folds whose training reaches into or past their validation; must be empty."""
    ends = folds.groupBy("fold").agg(F.max(F.when(F.col("part") == "train", F.col("ts"))).alias("a"), F.min(F.when(F.col("part") == "valid", F.col("ts"))).alias("b"))
    return ends.where(F.col("a") >= F.col("b")).select("fold")
