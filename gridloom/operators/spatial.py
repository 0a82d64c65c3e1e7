"""Zones, overlays, variograms and kriging."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.predicates import distance_kernel, half_even, haversine_m
from gridloom.operators.metrics import near_pairs
from gridloom.operators.order import placed
from gridloom.session import staged

EDGE = 1e-9
#: Zones that a broadcast may hold; more meet the points by grid cells.
MAX_ZONES = 20_000


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of structs x, y; closed or not); points within 1e-9 of an edge are inside."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, F.pmod(i + 1, n).cast("int")).alias("b")))

    def on_edge(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        cross = (x - e["a"]["x"]) * dy - (y - e["a"]["y"]) * dx
        inside = (x >= F.least(e["a"]["x"], e["b"]["x"]) - EDGE) & (x <= F.greatest(e["a"]["x"], e["b"]["x"]) + EDGE) & (y >= F.least(e["a"]["y"], e["b"]["y"]) - EDGE) & (y <= F.greatest(e["a"]["y"], e["b"]["y"]) + EDGE)
        return (F.abs(cross) <= EDGE) & inside

    def crosses(e: Column) -> Column:
        up = (e["a"]["y"] > y) != (e["b"]["y"] > y)
        at = e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / F.when(up, e["b"]["y"] - e["a"]["y"]).otherwise(F.lit(1.0))
        return up & (x < at)

    return F.exists(edges, on_edge) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def boxed(zones: DataFrame) -> DataFrame:
    """Zones with the extent of their ring."""
    side = lambda c, f: f(F.transform("ring", lambda p: p[c]))
    return zones.withColumn("x0", side("x", F.array_min)).withColumn("x1", side("x", F.array_max)).withColumn("y0", side("y", F.array_min)).withColumn("y1", side("y", F.array_max))


def locate(points: DataFrame, zones: DataFrame, cell: float | None = None) -> DataFrame:
    """Each point (id, x, y, ...) with the first zone (smallest ``ord``) whose ring holds it; zone columns null if none does.

    Few zones (counted) are broadcast and tested by their boxes first. Otherwise zones are spread over the grid cells their
    boxes touch, and points meet them by an equi-join on the cell.
    """
    z = boxed(zones).select(*(F.col(c).alias(f"z_{c}") for c in (*zones.columns, "x0", "x1", "y0", "y1")))
    hit = F.col("x").between(F.col("z_x0") - EDGE, F.col("z_x1") + EDGE) & F.col("y").between(F.col("z_y0") - EDGE, F.col("z_y1") + EDGE) & in_ring(F.col("x"), F.col("y"), F.col("z_ring"))
    if z.limit(MAX_ZONES + 1).count() <= MAX_ZONES and cell is None:
        found = points.join(F.broadcast(z), hit)
    else:
        # by default a cell has the side of an average zone, so a zone lies in a few cells whatever its units are
        size = cell or z.agg(F.avg(F.greatest(F.col("z_x1") - F.col("z_x0"), F.col("z_y1") - F.col("z_y0")))).first()[0] or 1.0
        span = lambda a, b: F.sequence(F.floor((F.col(a) - EDGE) / size), F.floor((F.col(b) + EDGE) / size))
        spread = z.withColumn("z_cx", F.explode(span("z_x0", "z_x1"))).withColumn("z_cy", F.explode(span("z_y0", "z_y1")))
        found = points.join(spread, (F.floor(F.col("x") / size) == F.col("z_cx")) & (F.floor(F.col("y") / size) == F.col("z_cy")) & hit).drop("z_cx", "z_cy")
    keep = [f"z_{c}" for c in zones.columns if c != "ring"]
    first = found.groupBy("id").agg(F.min_by(F.struct(*keep), "z_ord").alias("z"))
    return points.join(first, "id", "left").select(*points.columns, *(F.col(f"z.{k}").alias(k) for k in keep))


def overlay(points: DataFrame, zones: DataFrame, weights: dict[str, float], priority: bool = True, origin: tuple[float, float] | None = None, kernel: str = "none", bandwidth: float | None = None, boost: float = 1.0, places: int = 6, strict: bool = False) -> DataFrame:
    """id, zone_id, boost_score, rank: weighted properties (missing: 0) times the zone's priority times 1 + boost * kernel of
    the distance from ``origin`` (lat y, lon x); half-even places; ranked by falling score, ties by id."""
    rows = locate(points, zones)
    if strict:
        rows = rows.where(F.when(F.col("z_id").isNull(), F.raise_error(F.lit("a point lies in no zone")).cast("boolean")).otherwise(True))
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    if priority:
        score = score * F.coalesce("z_priority", F.lit(1.0))
    if origin is not None and kernel != "none":
        metres = haversine_m(F.lit(origin[1]), F.lit(origin[0]), F.col("y"), F.col("x"))
        score = score * (1 + boost * distance_kernel(metres, bandwidth or 1.0, kernel))
    rows = rows.withColumn("boost_score", half_even(score, places))
    return rows.select("id", F.col("z_id").alias("zone_id"), "boost_score").transform(lambda d: placed(d, [F.col("boost_score").desc(), "id"], "rank"))


def neighbour_bandwidth(points: DataFrame, k: int = 3, cell: float | None = None) -> DataFrame:
    """Distance in metres to the k-th nearest other point (fewer: the last), 1 at least; points as x lon, y lat."""
    if cell is not None:
        pairs = near_pairs(points, cell)
    else:
        other = points.select(F.col("id").alias("i2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        pairs = points.select("id", "x", "y").join(other, F.col("id") < F.col("i2"))
    d = pairs.withColumn("d", haversine_m(F.col("y"), F.col("x"), F.col("y2"), F.col("x2")))
    both = d.select("id", "d").union(d.select(F.col("i2").alias("id"), "d"))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d"))).where(F.col("r") <= k)
    return points.select("id").join(ranked.groupBy("id").agg(F.max("d").alias("d")), "id", "left").select("id", F.greatest(F.coalesce("d", F.lit(1.0)), F.lit(1.0)).alias("bandwidth"))


def variogram_pairs(points: DataFrame, max_lag: float | None = None) -> DataFrame:
    """(d, g): distance and half squared difference of all pairs, or of those within a lag by grid cells."""
    if max_lag is not None:
        pairs = near_pairs(points, max_lag, ["value"])
    else:
        other = points.select(F.col("id").alias("i2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("value").alias("value2"))
        pairs = points.join(other, F.col("id") < F.col("i2"))
    return pairs.select(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")).alias("d"), (0.5 * F.pow(F.col("value") - F.col("value2"), 2)).alias("g"))


def empirical_variogram(points: DataFrame, bins: int, max_lag: float | None = None) -> DataFrame:
    """bin, lag_min, lag_max, mean_distance, semivariance, pairs over equal-width distance bins; empty bins are left out."""
    pairs = variogram_pairs(points, max_lag)
    top = max_lag if max_lag is not None else pairs.agg(F.max("d")).first()[0]
    width = top / bins
    b = F.least(F.floor(F.col("d") / width), F.lit(bins - 1)).cast("int")
    out = pairs.groupBy(b.alias("bin")).agg(F.avg("d").alias("mean_distance"), F.avg("g").alias("semivariance"), F.count(F.lit(1)).alias("pairs"))
    return out.select("bin", (F.col("bin") * width).alias("lag_min"), ((F.col("bin") + 1) * width).alias("lag_max"), "mean_distance", "semivariance", "pairs")


def correlation(distance, rng: float, model: str):
    """Of numpy arrays or columns."""
    r = distance / rng
    if isinstance(r, Column):
        return {"exponential": F.exp(-r), "gaussian": F.exp(-r * r), "spherical": F.when(r >= 1, 0.0).otherwise(1 - 1.5 * r + 0.5 * r * r * r), "linear": F.greatest(1 - r, F.lit(0.0))}[model]
    return {"exponential": lambda: np.exp(-r), "gaussian": lambda: np.exp(-r * r), "spherical": lambda: np.where(r >= 1, 0.0, 1 - 1.5 * r + 0.5 * r**3), "linear": lambda: np.maximum(1 - r, 0.0)}[model]()


def fit_variogram(bins: DataFrame, models: Sequence[str] = ("exponential", "gaussian", "spherical", "linear")) -> dict:
    """Smallest pair-weighted squared error over a grid of model, range, nugget and sill taken from the bins; ties by order."""
    rows = bins.orderBy("bin").collect()
    d, g, n = (np.array([r[c] for r in rows], float) for c in ("mean_distance", "semivariance", "pairs"))
    best = None
    for model in models:
        for rng in d.max() * np.array([0.25, 0.5, 1.0, 1.5, 2.0]):
            for nugget in max(g[0], 0.0) * np.array([0.0, 0.25, 0.5]):
                for sill in max(g.max(), 1e-300) * np.array([0.5, 1.0, 1.5, 2.0]):
                    sse = float((n * (g - nugget - sill * (1 - correlation(d, rng, model))) ** 2).sum())
                    if best is None or sse < best["sse"]:
                        best = {"model": model, "range": float(rng), "nugget": float(nugget), "sill": float(sill), "sse": sse}
    return best


def solve_kriging(xy: np.ndarray, value: np.ndarray, target: np.ndarray, rng: float, nugget: float, sill: float, model: str, linear: bool) -> tuple[float, float]:
    """(mean, variance) at one target, with a constant or linear drift."""
    basis = lambda p: np.column_stack([np.ones(len(p)), p]) if linear else np.ones((len(p), 1))
    n, b = len(xy), basis(xy)
    dist = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    k = np.zeros((n + b.shape[1],) * 2)
    k[:n, :n] = sill * correlation(dist, rng, model) + nugget * np.eye(n)
    k[:n, n:], k[n:, :n] = b, b.T
    rhs = np.concatenate([sill * correlation(np.hypot(xy[:, 0] - target[0], xy[:, 1] - target[1]), rng, model), basis(target[None])[0]])
    w = np.linalg.lstsq(k, rhs, rcond=None)[0]
    return float(w[:n] @ value), float(max(sill + nugget - w @ rhs, 0.0))


def _met(points: DataFrame, targets: DataFrame, radius: float, apart: bool) -> DataFrame:
    """Targets (id, x, y) with the points (p_id, p_x, p_y, value) within ``radius`` and their distance d, by grid cells of that
    side; ``apart`` leaves out the point of the target's own id."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    spread = points.withColumn("o", F.explode(offsets)).withColumn("kx", cell("p_x") + F.col("o.a")).withColumn("ky", cell("p_y") + F.col("o.b")).drop("o")
    met = targets.select("id", "x", "y", cell("x").alias("kx"), cell("y").alias("ky")).join(spread, ["kx", "ky"]).drop("kx", "ky")
    met = met.withColumn("d", F.hypot(F.col("x") - F.col("p_x"), F.col("y") - F.col("p_y"))).where(F.col("d") <= radius)
    return met.where(F.col("id") != F.col("p_id")) if apart else met


#: Points of a cell, as a multiple of the neighbours asked for, with which the search of nearest points may begin.
CROWD = 8


def nearest(points: DataFrame, targets: DataFrame, k: int, apart: bool = False) -> DataFrame:
    """The k nearest points (p_id, p_x, p_y, value) of each target (id, x, y), with distance d and place r; ties by p_id.

    The search begins with a radius at which no grid cell holds many points, and doubles it for the targets that have met
    fewer than k. So dense places are done early, sparse ones late, and no step pairs a target with much more than it needs
    (points at one and the same place excepted).
    """
    e = points.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}{c}") for c in ("p_x", "p_y") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    f = targets.agg(*(f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    keep = ["id", "x", "y", "p_id", "p_x", "p_y", "value", "d", "r"]
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "p_id"))
    if not e["n"] or f["lox"] is None:
        return _met(points, targets, 1.0, apart).withColumn("r", place).select(keep).limit(0)
    reach = 1.01 * np.hypot(max(e["hip_x"], f["hix"]) - min(e["lop_x"], f["lox"]), max(e["hip_y"], f["hiy"]) - min(e["lop_y"], f["loy"])) or 1.0
    radius = reach / max(np.sqrt(e["n"]), 1.0)
    places = points.select("p_x", "p_y").distinct()
    while radius > reach * 1e-9:
        crowd = places.groupBy(F.floor(F.col("p_x") / radius), F.floor(F.col("p_y") / radius)).count().agg(F.max("count")).first()[0]
        if crowd <= CROWD * k:
            break
        radius /= 2
    done, left = [], targets.select("id", "x", "y")
    while True:
        last = radius >= reach
        near = staged(_met(points, left, radius, apart).withColumn("r", place).where(F.col("r") <= k).select(keep), "nearest")
        if last:
            done.append(near)
            break
        full = near.where(F.col("r") == k).select("id")
        done.append(near.join(full, "id", "left_semi").select(keep))
        left = staged(left.join(full, "id", "left_anti"), "waiting")
        if left.isEmpty():
            break
        radius = min(2 * radius, reach)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def krige(points: DataFrame, targets: DataFrame, rng: float, nugget: float = 1e-9, sill: float = 1.0, model: str = "exponential", neighbours: int = 16, radius: float | None = None, linear: bool = False, min_neighbours: int = 1) -> DataFrame:
    """id, mean, variance, used at each target from its nearest points (ties by point id).

    Neighbours come from equi-joins on grid cells: of a radius, or of radii that grow until a target has enough of them. A
    target's system is one small solve, bounded by ``neighbours``. Targets with fewer than ``min_neighbours`` come back null.
    """
    packed = _packed(_neighbours(points, targets, neighbours, radius, False), ["id", "x", "y"])

    def run(batches):
        for pdf in batches:
            out = []
            for x, y, rows in zip(pdf["x"], pdf["y"], pdf["near"], strict=True):
                v = np.array([r["value"] for r in rows], float)
                out.append((*_solved(rows, x, y, rng, nugget, sill, model, linear), len(v)) if len(v) >= min_neighbours else (None, None, len(v)))
            pdf = pdf[["id"]].copy()
            pdf["mean"], pdf["variance"], pdf["used"] = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [])
            yield pdf

    kind = targets.schema["id"].dataType.simpleString()
    solved = packed.mapInPandas(run, f"id {kind}, mean double, variance double, used long")
    return targets.select("id").join(solved, "id", "left")


def _neighbours(points: DataFrame, targets: DataFrame, k: int, radius: float | None, apart: bool) -> DataFrame:
    p = points.select(F.col("id").alias("p_id"), F.col("x").alias("p_x"), F.col("y").alias("p_y"), F.col("value").cast("double").alias("value"))
    if radius is None:
        return nearest(p, targets, k, apart)
    met = _met(p, targets, radius, apart)
    return met.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d", "p_id"))).where(F.col("r") <= k)


def _packed(near: DataFrame, keys: Sequence[str]) -> DataFrame:
    return near.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("r", "p_x", "p_y", "value"))).alias("near"))


def _solved(rows, x: float, y: float, *how) -> tuple[float, float]:
    return solve_kriging(np.array([(r["p_x"], r["p_y"]) for r in rows], float), np.array([r["value"] for r in rows], float), np.array([x, y], float), *how)


def leave_one_out(points: DataFrame, rng: float, neighbours: int = 16, radius: float | None = None, nugget: float = 1e-9, sill: float = 1.0, model: str = "exponential", linear: bool = False) -> DataFrame:
    """id, value, mean, variance, residual of each point from its neighbours without itself, found as ``krige`` finds them.

    A point without any neighbour is left out.
    """
    near = _packed(_neighbours(points, points, neighbours, radius, True), ["id", "x", "y"])
    packed = near.join(points.select("id", F.col("value").cast("double").alias("value")), "id")

    def run(batches):
        for pdf in batches:
            got = [_solved(n, x, y, rng, nugget, sill, model, linear) for x, y, n in zip(pdf["x"], pdf["y"], pdf["near"], strict=True)]
            pdf = pdf[["id", "value"]].copy()
            pdf["mean"], pdf["variance"] = [g[0] for g in got], [g[1] for g in got]
            pdf["residual"] = pdf["value"] - pdf["mean"]
            yield pdf

    kind = points.schema["id"].dataType.simpleString()
    return packed.mapInPandas(run, f"id {kind}, value double, mean double, variance double, residual double")
