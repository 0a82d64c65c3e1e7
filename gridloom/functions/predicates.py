"""Row predicates, their signed distances, and soft branch weights, as Catalyst expressions.

Every predicate sends a row left (true) or right. Distances are negative or zero on the left side. Null and NaN follow
``missing_left``. All are plain expressions, so filters on them stay inside whole-stage codegen and the scan stays pruned.
"""

from __future__ import annotations


from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the three directions that half-plane predicates use
DIAGONALS = ((1.0, 1.0), (1.0, -1.0), (-1.0, 1.0))
KERNELS = ("linear", "gaussian", "exponential", "bisquare", "epanechnikov", "tricube")


def finite(value: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def _routed(value: Column, test: Column, missing_left: bool) -> Column:
    return F.when(finite(value), test).otherwise(F.lit(missing_left))


def axis_left(value: Column, threshold: float, missing_left: bool = False) -> Column:
    return _routed(value, value <= threshold, missing_left)


def axis_distance(value: Column, threshold: float) -> Column:
    return value - threshold


def diagonal_distance(x: Column, y: Column, normal: tuple[float, float], threshold: float) -> Column:
    return x * normal[0] + y * normal[1] - threshold


def diagonal_left(x: Column, y: Column, normal: tuple[float, float], threshold: float, missing_left: bool = False) -> Column:
    return _routed(x + y, diagonal_distance(x, y, normal, threshold) <= 0, missing_left)


def radial_distance(x: Column, y: Column, centre: tuple[float, float], radius: float) -> Column:
    return F.hypot(x - centre[0], y - centre[1]) - radius


def radial_left(x: Column, y: Column, centre: tuple[float, float], radius: float, missing_left: bool = False) -> Column:
    return _routed(x + y, radial_distance(x, y, centre, radius) <= 0, missing_left)


def wrap(value: Column, period: float) -> Column:
    """The value modulo the period, in [0, period)."""
    return F.pmod(value, F.lit(float(period)))


def periodic_left(value: Column, period: float, start: float, end: float, missing_left: bool = False) -> Column:
    """Inside the closed interval modulo the period; an interval with start > end goes around."""
    v, a, b = wrap(value, period), start % period, end % period
    return _routed(value, (v >= a) & (v <= b) if a <= b else (v >= a) | (v <= b), missing_left)


def circular_gap(value: Column, point: float, period: float) -> Column:
    d = F.abs(wrap(value, period) - point % period)
    return F.least(d, period - d)


def periodic_distance(value: Column, period: float, start: float, end: float) -> Column:
    """Distance to the nearer boundary, negative inside."""
    near = F.least(circular_gap(value, start, period), circular_gap(value, end, period))
    return F.when(periodic_left(value, period, start, end), -near).otherwise(near)


def set_left(ids: Column, members: Sequence[int]) -> Column:
    """The row's id list meets the predicate's."""
    return F.coalesce(F.arrays_overlap(ids, F.array(*(F.lit(m).cast("bigint") for m in members))), F.lit(False))


def dense_id_left(value: Column, members: Sequence[int]) -> Column:
    """A non-negative whole number taken as a set of one id."""
    whole = finite(value) & (value >= 0) & (value == F.floor(value))
    return F.when(whole, value.cast("bigint").isin(*members)).otherwise(F.lit(False))


def kernel_blend(distance: Column, bandwidth: float, kernel: str) -> Column:
    """How soft a branch is at a distance: 1 at the boundary, 0 from the bandwidth on."""
    u = F.abs(distance) / bandwidth
    shape = {
        "linear": 1 - u, "gaussian": F.exp(-0.5 * (2.5 * u) * (2.5 * u)), "exponential": F.exp(-3.0 * u), "bisquare": (1 - u * u) * (1 - u * u),
        "epanechnikov": 1 - u * u, "tricube": (1 - u * u * u) * (1 - u * u * u) * (1 - u * u * u),
    }[kernel]
    return F.when(u >= 1, 0.0).otherwise(shape)


def soft_left(distance: Column, bandwidth: float, kernel: str = "linear") -> Column:
    """Left mass: one half at the boundary, blending into the hard branch at the bandwidth; the right mass is the rest."""
    hard = F.when(distance <= 0, 1.0).otherwise(0.0)
    if bandwidth <= 0:
        return hard
    b = kernel_blend(distance, bandwidth, kernel)
    return 0.5 * b + (1 - b) * hard


def sigmoid(x: Column) -> Column:
    """Logistic function that doesn't overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softmax(scores: Column) -> Column:
    """Of an array of scores."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, s: a + s)
    return F.transform(e, lambda s: s / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(0.0)


def pair_features(a: Column, b: Column) -> Column:
    """source, target, absolute difference, product: one array."""
    d = lambda v: F.transform(v, lambda x: x.cast("double"))
    return F.concat(d(a), d(b), F.zip_with(d(a), d(b), lambda x, y: F.abs(x - y)), F.zip_with(d(a), d(b), lambda x, y: x * y))


def inverse_normal(p: float) -> float:
    """Quantile of the standard normal distribution, on the driver."""
    from statistics import NormalDist

    if not 0 < p < 1:
        raise ValueError("a probability strictly between 0 and 1 is needed")
    return NormalDist().inv_cdf(p)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere of 6,371,000 m."""
    h = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * 6_371_000.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def distance_kernel(metres: Column, bandwidth: Column | float, kernel: str) -> Column:
    """none (0), gaussian, bisquare or exponential weight of a distance."""
    u = metres / bandwidth
    return {"none": F.lit(0.0), "gaussian": F.exp(-0.5 * u * u), "exponential": F.exp(-u), "bisquare": F.when(u >= 1, 0.0).otherwise(F.pow(1 - u * u, 2))}[kernel]


def half_even(value: Column, places: int) -> Column:
    return F.bround(value, places)


def unit_draw(seed: int, *keys: Column) -> Column:
    """A uniform number in [0, 1) from a seed and keys; the same in every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def log_target(y: Column) -> Column:
    return F.log1p(y)


def log_target_back(z: Column) -> Column:
    return F.expm1(z)


