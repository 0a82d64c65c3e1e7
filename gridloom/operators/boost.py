"""Gradient boosting over DataFrames: binned features, level-wise trees, models that are Catalyst expressions.

A tree level is one aggregation: rows carry the number of their node, and (node, feature, bin) sums of weight, gradient target
and counts are partial before the shuffle, so its size is nodes * features * bins whatever the number of rows. Of two sibling
nodes only the smaller one is aggregated, the other is their parent less it. Split choice happens on those sums. The margin is
a cached column that is written anew every few rounds, so a tree costs the same however many came before it. Prediction is a
sum of nested CASE columns inside whole-stage codegen.

Besides thresholds a node may split by a half-plane (thresholds along fixed directions), a disc (around centres that come from
the node's own rows), an interval of a period (any run of bins) or an id set (any id of the node's rows). With a ``fuzzy``
bandwidth rows near a boundary go to both sides with fractional weights, in training as in prediction.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.predicates import (
    DIAGONALS, KERNELS, axis_distance, axis_left, circular_gap, diagonal_distance, diagonal_left, finite, periodic_distance, periodic_left, radial_distance, radial_left, set_left, sigmoid, soft_left, softmax, wrap,
)
from gridloom.operators.order import running

#: fixed value: by how much, as a share of the gain, a half-plane or disc must beat another kind of split
SPATIAL_MARGIN = 0.1
LOSSES = ("l2", "log_l2", "l1", "huber", "quantile", "logistic", "poisson")


@dataclass(frozen=True)
class BoostSpec:
    """``splitter`` histogram: at most ``bins`` cuts a feature, at quantiles; exact: every middle between two distinct values.

    ``diagonal`` and ``radial`` name pairs of columns, ``periodic`` columns with their period, ``sets`` columns of id lists.
    ``missing`` values go left at every split but those by id sets, or to the side of the larger gain (best). ``refresh`` is the
    number of rounds between two writings of the margin column.
    """

    rounds: int = 20
    rate: float = 0.1
    depth: int = 3
    min_leaf: int = 20
    min_gain: float = 1e-8
    l2: float = 0.0
    bins: int = 32
    loss: str = "l2"
    alpha: float = 0.5
    huber: float = 1.0
    monotone: tuple[tuple[str, int], ...] = ()
    linear: tuple[str, ...] = ()
    ridge: float = 1.0
    splitter: str = "histogram"
    diagonal: tuple[tuple[str, str], ...] = ()
    radial: tuple[tuple[str, str], ...] = ()
    periodic: tuple[tuple[str, float], ...] = ()
    sets: tuple[str, ...] = ()
    fuzzy: float = 0.0
    kernel: str = "linear"
    missing: str = "left"
    refresh: int = 4

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        real = lambda v: isinstance(v, (int, float)) and math.isfinite(v)
        need(self.rounds >= 1, "at least one round is needed")
        need(real(self.rate) and self.rate > 0, "the rate must be a positive number")
        need(0 <= self.depth <= 20, "a depth between 0 and 20 is needed")
        need(self.min_leaf >= 1, "a leaf needs a row or more")
        need(real(self.min_gain) and self.min_gain >= 0, "the least gain must be a number of 0 or more")
        need(real(self.l2) and self.l2 >= 0 and real(self.ridge) and self.ridge >= 0, "penalties must be numbers of 0 or more")
        need(2 <= self.bins <= 4096, "between 2 and 4,096 bins are needed")
        need(self.loss in LOSSES, f"unknown loss {self.loss}")
        need(0 < self.alpha < 1, "a quantile strictly between 0 and 1 is needed")
        need(real(self.huber) and self.huber > 0, "the Huber delta must be positive")
        need(self.splitter in ("histogram", "exact"), f"unknown splitter {self.splitter}")
        need(real(self.fuzzy) and self.fuzzy >= 0, "the bandwidth must be a number of 0 or more")
        need(self.kernel in KERNELS, f"unknown kernel {self.kernel}")
        need(self.missing in ("left", "best"), f"missing values go left or to the best side, not {self.missing}")
        need(all(w in (-1, 0, 1) for _, w in self.monotone), "a monotone direction is -1, 0 or 1")
        need(not (any(w for _, w in self.monotone) and (self.diagonal or self.radial or self.periodic or self.sets)), "monotone constraints go with threshold splits only")
        need(all(real(p) and p > 0 for _, p in self.periodic), "periods must be positive")
        need(self.refresh >= 1, "the margin is written every round at most")


@dataclass
class Node:
    """A leaf, or a split. ``kind`` tells how ``params`` and ``threshold`` are read: axis (feature <= threshold), diagonal
    (x, y, a, b), radial (x, y, centre), periodic (feature, period, start, end), set (feature, ids)."""

    value: float = 0.0
    feature: str | None = None
    threshold: float = 0.0
    missing_left: bool = False
    gain: float = 0.0
    n: int = 0
    left: Node | None = None
    right: Node | None = None
    low: float = -math.inf
    high: float = math.inf
    slopes: dict[str, float] = field(default_factory=dict)
    kind: str = "axis"
    params: list = field(default_factory=list)
    fuzzy: float = 0.0
    kernel: str = "linear"

    def test(self) -> Column:
        """Whether a row goes left."""
        p, miss = self.params, self.missing_left
        if self.kind == "diagonal":
            return diagonal_left(F.col(p[0]), F.col(p[1]), (p[2], p[3]), self.threshold, miss)
        if self.kind == "radial":
            return radial_left(F.col(p[0]), F.col(p[1]), (p[2], p[3]), self.threshold, miss)
        if self.kind == "periodic":
            return periodic_left(F.col(p[0]), p[1], p[2], p[3], miss)
        if self.kind == "set":
            return set_left(F.col(p[0]), p[1])
        return axis_left(F.col(self.feature), self.threshold, miss)

    def share(self) -> Column:
        """The left share of a row: 0 or 1, and between them near a soft boundary; a missing value goes one way whole."""
        p, hard = self.params, F.when(self.test(), 1.0).otherwise(0.0)
        if not self.fuzzy or self.kind == "set":
            return hard
        known, distance = {
            "axis": lambda: (F.col(self.feature), axis_distance(F.col(self.feature), self.threshold)),
            "diagonal": lambda: (F.col(p[0]) + F.col(p[1]), diagonal_distance(F.col(p[0]), F.col(p[1]), (p[2], p[3]), self.threshold)),
            "radial": lambda: (F.col(p[0]) + F.col(p[1]), radial_distance(F.col(p[0]), F.col(p[1]), (p[2], p[3]), self.threshold)),
            "periodic": lambda: (F.col(p[0]), periodic_distance(F.col(p[0]), p[1], p[2], p[3])),
        }[self.kind]()
        return F.when(finite(known), soft_left(distance, self.fuzzy, self.kernel)).otherwise(hard)

    def column(self) -> Column:
        if self.feature is None:
            out = F.lit(self.value)
            for f, c in self.slopes.items():
                out = out + F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) * c
            return out
        if self.fuzzy and self.kind != "set":
            share = self.share()
            return share * self.left.column() + (1 - share) * self.right.column()
        return F.when(self.test(), self.left.column()).otherwise(self.right.column())

    def text(self, indent: str = "") -> str:
        if self.feature is None:
            return f"{indent}leaf {self.value:.6g} (n={self.n})\n"
        told = {
            "axis": f"{self.feature} <= {self.threshold:.6g}", "diagonal": f"{self.feature} <= {self.threshold:.6g}", "radial": f"{self.feature} <= {self.threshold:.6g}",
            "periodic": self.feature, "set": self.feature,
        }[self.kind]
        return f"{indent}{told} (gain={self.gain:.6g}, missing {'left' if self.missing_left else 'right'})\n" + self.left.text(indent + "  ") + self.right.text(indent + "  ")

    def rows(self, tree: int, at: int = 1) -> list[tuple]:
        """(tree, node, feature, threshold, missing_left, value, n); children of node i are 2 i and 2 i + 1."""
        own = (tree, at, self.feature, self.threshold, self.missing_left, self.value, self.n)
        return [own] if self.feature is None else [own, *self.left.rows(tree, 2 * at), *self.right.rows(tree, 2 * at + 1)]

    def key(self) -> str:
        """The column, or columns, that the split looks at."""
        return self.feature if self.kind == "axis" else ",".join(self.params[:2]) if self.kind in ("diagonal", "radial") else self.params[0]

    def leaf_paths(self, path: tuple = ()) -> list[tuple[Node, tuple]]:
        """Leaves with the splits above them: (key, share of the row that goes on, share of the training rows that did)."""
        if self.feature is None:
            return [(self, path)]
        share, cover = self.share(), self.left.n / max(self.left.n + self.right.n, 1)
        return self.left.leaf_paths((*path, (self.key(), share, cover))) + self.right.leaf_paths((*path, (self.key(), 1 - share, 1 - cover)))

    def leaves(self, at: int = 1) -> list[tuple[int, Node]]:
        return [(at, self)] if self.feature is None else [*self.left.leaves(2 * at), *self.right.leaves(2 * at + 1)]


@dataclass
class BoostModel:
    features: list[str]
    init: float
    rate: float
    trees: list[Node] = field(default_factory=list)
    loss: str = "l2"

    def margin(self) -> Column:
        total = F.lit(self.init)
        for t in self.trees:
            total = total + self.rate * t.column()
        return total

    def prediction(self) -> Column:
        return {"log_l2": F.expm1, "logistic": sigmoid, "poisson": F.exp}.get(self.loss, lambda c: c)(self.margin())

    def contributions(self) -> Column:
        """[init, first tree, second tree, ...] of a row; they add up to the margin."""
        return F.array(F.lit(self.init), *(self.rate * t.column() for t in self.trees))

    def shapley(self, most: int = 6) -> dict[str, Column]:
        """Exact Shapley values of the margin by column, and ``base``; they add up to the margin.

        Unknown columns send a row both ways by the shares of the training rows. In a leaf's part of the margin only the columns
        on its path play, so the sum runs over subsets of those: at most ``most`` columns a path (more are an error).
        """
        out: dict[str, Column] = {"base": F.lit(self.init)}
        for tree in self.trees:
            for leaf, path in tree.leaf_paths():
                if leaf.slopes:
                    raise ValueError("Shapley values are for constant leaves")
                known: dict[str, Column] = {}
                cover: dict[str, float] = {}
                for key, share, part in path:
                    known[key], cover[key] = known[key] * share if key in known else share, cover.get(key, 1.0) * part
                keys, worth = list(known), self.rate * leaf.value
                if len(keys) > most:
                    raise ValueError(f"a path looks at more than {most} columns")
                out["base"] = out["base"] + worth * math.prod(cover.values())
                for j in keys:
                    rest, total = [k for k in keys if k != j], F.lit(0.0)
                    for size in range(len(rest) + 1):
                        order = math.factorial(size) * math.factorial(len(rest) - size) / math.factorial(len(keys))
                        for played in combinations(rest, size):
                            term = F.lit(order * worth * math.prod(cover[k] for k in rest if k not in played))
                            for k in played:
                                term = term * known[k]
                            total = total + term
                    out[j] = out.get(j, F.lit(0.0)) + total * (known[j] - cover[j])
        return out

    def transform(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        return rows.withColumn(out, self.prediction())

    def dump(self) -> str:
        return "".join(f"tree {i}\n{t.text('  ')}" for i, t in enumerate(self.trees))

    def node_table(self, spark) -> DataFrame:
        rows = [r for i, t in enumerate(self.trees) for r in t.rows(i)]
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, missing_left boolean, value double, n long")

    def to_json(self) -> str:
        return json.dumps({"version": 1, "features": self.features, "init": self.init, "rate": self.rate, "loss": self.loss, "trees": [asdict(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> BoostModel:
        d = json.loads(text)
        if d.get("version") != 1:
            raise ValueError("unknown model version")

        def node(x: dict | None) -> Node | None:
            return None if x is None else Node(**{**x, "left": node(x["left"]), "right": node(x["right"])})  # JSON's Infinity reads back as such

        return BoostModel(d["features"], d["init"], d["rate"], [node(t) for t in d["trees"]], d["loss"])


# --- bins ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Axis:
    """One binned candidate column: its kind, name, parameters, and the cuts between its bins (ordered)."""

    kind: str
    name: str
    params: tuple = ()
    edges: tuple[float, ...] = ()

    def value(self) -> Column:
        p = self.params
        if self.kind == "diagonal":
            return F.col(p[0]) * p[2] + F.col(p[1]) * p[3]
        if not self.name:  # stands for all rows where no binned column is looked at
            return F.lit(0.0)
        return wrap(F.col(p[0]), p[1]) if self.kind == "periodic" else F.col(self.name).cast("double")


#: Distinct values of a feature that the exact splitter takes at most; more are an error, never cut.
EXACT_VALUES = 4000


def _quantile_cuts(values: list[float], bins: int) -> list[float]:
    v = sorted(set(values))
    if len(v) > bins:
        v = sorted({v[round(k * (len(v) - 1) / bins)] for k in range(bins + 1)})
    return [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Cut points: middles between adjacent distinct quantiles, so few distinct values are all kept apart; one job for all
    features, and at most ``bins`` numbers a feature."""
    columns = {f: F.col(f).cast("double") for f in features}
    return _edges(rows, columns, bins)


def _edges(rows: DataFrame, columns: dict[str, Column], bins: int, exact: bool = False) -> dict[str, list[float]]:
    if not columns:
        return {}
    held = [F.when(finite(c), c) for c in columns.values()]
    if exact:
        row = rows.agg(*(F.approx_count_distinct(c).alias(f"e{i}") for i, c in enumerate(held))).first()
        if wide := [f for i, f in enumerate(columns) if row[f"e{i}"] > 0.9 * EXACT_VALUES]:
            raise ValueError(f"too many distinct values for exact splits: {wide}")
        row = rows.agg(*(F.sort_array(F.collect_set(c)).alias(f"e{i}") for i, c in enumerate(held))).first()
        return {f: _quantile_cuts(row[f"e{i}"] or [], 1 << 30) for i, f in enumerate(columns)}
    levels = [i / (4 * bins) for i in range(4 * bins + 1)]
    row = rows.agg(*(F.percentile_approx(c, levels, 10_000).alias(f"e{i}") for i, c in enumerate(held))).first()
    return {f: _quantile_cuts(row[f"e{i}"] or [], bins) for i, f in enumerate(columns)}


def bin_column(value: Column, edges: Sequence[float]) -> Column:
    """0 for missing, else 1 + number of edges below the value: a binary search as nested cases, which stays in generated code."""

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1)
        middle = (low + high) // 2
        return F.when(value > edges[middle], below(middle + 1, high)).otherwise(below(low, middle))

    return F.when(finite(value), below(0, len(edges))).otherwise(0).cast("short")


def candidate_axes(rows: DataFrame, features: Sequence[str], spec: BoostSpec) -> list[Axis]:
    """The binned columns that a fit looks at, with their cuts; two jobs at most."""
    axes = [Axis("axis", f) for f in features]
    axes += [Axis("diagonal", f"{a:g}*{x} + {b:g}*{y}", (x, y, a, b)) for x, y in spec.diagonal for a, b in DIAGONALS]
    axes += [Axis("periodic", f, (f, float(period))) for f, period in spec.periodic]
    axes = axes or [Axis("axis", "")]
    edges = _edges(rows, {str(i): a.value() for i, a in enumerate(axes)}, spec.bins, spec.splitter == "exact")
    return [Axis(a.kind, a.name, a.params, tuple(edges[str(i)])) for i, a in enumerate(axes)]


# --- growing ---------------------------------------------------------------------------------------------------------

_ZERO = (0.0, 0.0, 0.0, 0.0)


def _loss(s: np.ndarray, l2: float) -> np.ndarray:
    """Sum of squared distances to the best constant, up to what splits can't change."""
    w = s[..., 1] + l2
    return np.where(w > 0, -s[..., 2] ** 2 / np.where(w > 0, w, 1.0), 0.0)


def _leaf(s, l2: float) -> float:
    return float(s[2] / (s[1] + l2)) if s[1] + l2 > 0 else 0.0


def axis_candidate(axis: Axis, cells: np.ndarray, spec: BoostSpec) -> tuple | None:
    """The split of largest gain on one axis: (gain, axis, threshold or interval, missing_left, left sums, right sums).

    ``cells`` holds (n, w, wy, wyy) by bin, bin 0 for missing values. Equal gains go to the first cut or narrowest interval.
    """
    whole, missing, body = cells.sum(0), cells[0], cells[1:]
    run = np.vstack([np.zeros(4), np.cumsum(body, 0)])
    if axis.kind == "periodic":
        m = len(axis.edges) + 1
        cuts = [(a, b) for a in range(m) for b in range(a + 1, m + 1) if b - a < m]
        inside = np.array([run[b] - run[a] for a, b in cuts]).reshape(-1, 4)
    else:
        cuts, inside = list(axis.edges), run[1 : len(axis.edges) + 1]
    if not len(cuts):
        return None
    best = None
    for to_left in (True, False) if missing[0] and spec.missing == "best" else (True,):
        left = inside + missing if to_left else inside
        right = whole - left
        gain = _loss(whole, spec.l2) - _loss(left, spec.l2) - _loss(right, spec.l2)
        ok = (left[:, 0] >= spec.min_leaf) & (right[:, 0] >= spec.min_leaf)
        if way := dict(spec.monotone).get(axis.name, 0) if axis.kind == "axis" else 0:
            mean = lambda s: s[:, 2] / np.maximum(s[:, 1] + spec.l2, 1e-300)
            ok &= way * (mean(right) - mean(left)) >= 0
        gain = np.where(ok, gain, -np.inf)
        i = int(gain.argmax())
        if axis.kind == "periodic" and np.isfinite(gain[i]):  # of equal gains the narrowest interval
            same = np.flatnonzero(gain >= gain[i] - 1e-12)
            i = int(min(same, key=lambda x: (np.subtract(*_interval(axis, cuts[x])[::-1]), x)))
        if gain[i] > spec.min_gain and (best is None or gain[i] > best[0] + 1e-12):
            best = (float(gain[i]), axis, cuts[i], to_left, left[i], right[i])
    return best


def _interval(axis: Axis, cut: tuple[int, int]) -> tuple[float, float]:
    """Start and end, both inside, of a run of bins."""
    a, b = cut
    start = 0.0 if a == 0 else float(np.nextafter(axis.edges[a - 1], np.inf))
    return start, float(axis.edges[b - 1]) if b <= len(axis.edges) else float(np.nextafter(axis.params[1], 0))


def _by_node(values: dict[int, float]) -> Column:
    """A number by the row's node, as a map in the plan (nodes of one level)."""
    return F.element_at(F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, float(v)))), F.col("_node"))


#: Distances to a centre are cut into so many rings.
RINGS = 128


def _discs(routed: DataFrame, nodes: dict[int, Node], extents: dict, spec: BoostSpec) -> dict[int, list[tuple[Axis, np.ndarray]]]:
    """Candidate discs by node: centres are the means of the node's rows, of those above and of those below its mean target."""
    out: dict[int, list] = {}
    mine = routed.where(F.col("_node").isin(*nodes)).withColumn("_up", F.col("_g") > _by_node({k: v.value for k, v in nodes.items()}))
    for x, y in spec.radial:
        here = mine.where(finite(F.col(x) + F.col(y)))
        sides = {0: F.lit(True), 1: F.col("_up"), 2: ~F.col("_up")}
        got = here.groupBy("_node").agg(*(F.avg(F.when(c, F.col(v))).alias(f"{v}{i}") for i, c in sides.items() for v in (x, y))).collect()
        centres = {r["_node"]: [(r[f"{x}{i}"], r[f"{y}{i}"]) for i in sides] for r in got}
        if not centres:
            continue
        reach = extents[x, y] or 1.0
        edges = tuple(reach * (i + 1) / RINGS for i in range(RINGS))
        rings = []
        for i in sides:
            d = F.hypot(F.col(x) - _by_node({k: c[i][0] if c[i][0] is not None else math.nan for k, c in centres.items()}), F.col(y) - _by_node({k: c[i][1] if c[i][1] is not None else math.nan for k, c in centres.items()}))
            rings.append(F.when(finite(d), F.greatest(F.ceil(d / reach * RINGS), F.lit(1))).otherwise(0).cast("int"))
        cells = F.array(*(F.struct(F.lit(i).alias("axis"), r.alias("bin")) for i, r in enumerate(rings)))
        for r in cell_sums(mine.withColumn("_cells", cells)).collect():
            disc = out.setdefault(r["_node"], [])
            if not disc:
                disc += [(Axis("radial", f"distance of ({x}, {y}) to ({c[0] or 0:.6g}, {c[1] or 0:.6g})", (x, y, *c), edges), np.zeros((RINGS + 2, 4))) for c in centres.get(r["_node"], [(None, None)] * 3)]
            disc[r["axis"]][1][min(r["bin"], RINGS + 1)] += (r["n"], r["w"], r["wy"], r["wyy"])
    return {k: [d for d in v if d[0].params[2] is not None] for k, v in out.items()}


def _id_candidates(routed: DataFrame, nodes: dict[int, Node], totals: dict[int, np.ndarray], spec: BoostSpec) -> list[tuple[int, tuple]]:
    """Each node's best id of each set column: (node, candidate). All ids of the node's rows are weighed; one row a node returns."""
    found = []
    for f in spec.sets:
        each = routed.where(F.col("_node").isin(*nodes)).select("_node", "_w", "_g", F.explode(F.array_distinct(F.col(f))).alias("id"))
        sums = each.groupBy("_node", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_g")).alias("wy"), F.sum(F.col("_w") * F.col("_g") * F.col("_g")).alias("wyy"))
        n, w, wy = (_by_node({k: t[i] for k, t in totals.items() if k in nodes}) for i in range(3))
        drop = lambda a, b: F.when(b + spec.l2 > 0, a * a / F.nullif(b + spec.l2, F.lit(0.0))).otherwise(0.0)
        gain = drop(F.col("wy"), F.col("w")) + drop(wy - F.col("wy"), w - F.col("w")) - drop(wy, w)
        fit_in = sums.where((F.col("n") >= spec.min_leaf) & (n - F.col("n") >= spec.min_leaf)).withColumn("gain", gain).where(F.col("gain") > spec.min_gain)
        for r in fit_in.groupBy("_node").agg(F.max(F.struct("gain", (-F.col("id")).alias("o"), "n", "w", "wy", "wyy")).alias("b")).collect():
            left = np.array([r["b"][c] for c in ("n", "w", "wy", "wyy")], float)
            found.append((r["_node"], (r["b"]["gain"], Axis("set", f, (f, [-r["b"]["o"]])), None, False, left, totals[r["_node"]] - left)))
    return found


def cell_sums(rows: DataFrame) -> DataFrame:
    """(_node, axis, bin): n, Σw, Σwy, Σwy² of rows whose ``_cells`` are unfolded in the row; one aggregation."""
    unfolded = rows.select("_node", "_w", "_g", F.explode("_cells").alias("c"))
    return unfolded.groupBy("_node", "c.axis", "c.bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_g")).alias("wy"), F.sum(F.col("_w") * F.col("_g") * F.col("_g")).alias("wyy"))


def node_histograms(rows: DataFrame, features: Sequence[str], node: str = "_node") -> DataFrame:
    """(node, feature, bin) with n, w, wy, wyy: the sums of rows binned as ``_b0``, ``_b1``, ... (features by their number)."""
    cells = F.array(*(F.struct(F.lit(i).alias("axis"), F.col(f"_b{i}").alias("bin")) for i in range(len(features))))
    return cell_sums(rows.withColumn("_node", F.col(node)).withColumn("_cells", cells)).withColumnsRenamed({"_node": "node", "axis": "feature"})


def leaf_weights(node: Node, at: int = 1, weight: Column | None = None) -> list[tuple[int, Column]]:
    """The leaves that a row may reach, with its share of each."""
    weight = F.lit(1.0) if weight is None else weight
    if node.feature is None:
        return [(at, weight)]
    share = node.share()
    return leaf_weights(node.left, 2 * at, weight * share) + leaf_weights(node.right, 2 * at + 1, weight * (1 - share))


def node_number(node: Node, at: int = 1) -> Column:
    """The number of the leaf that a row reaches; the larger side's where a boundary is soft."""
    if node.feature is None:
        return F.lit(at)
    return F.when(node.test(), node_number(node.left, 2 * at)).otherwise(node_number(node.right, 2 * at + 1))


def routed_rows(rows: DataFrame, roots: Sequence[Node | None], spec: BoostSpec, depth: int) -> DataFrame:
    """Rows with ``_node``, ``_w`` and ``_g`` for each tree k (arrays ``_ws`` and ``_gs``); nodes of tree k are numbered from
    k * 2^(depth + 1). A soft boundary sends a row to several nodes, with its weight shared out."""
    each = []
    for k, root in enumerate(roots):
        first = k << (depth + 1)
        if root is None or root.feature is None:
            places = [(F.lit(first + 1), F.lit(1.0))]
        elif spec.fuzzy:
            places = [(F.lit(first + at), share) for at, share in leaf_weights(root)]
        else:
            places = [(F.lit(first) + node_number(root), F.lit(1.0))]
        each += [F.struct(node.cast("int").alias("node"), (F.get("_ws", F.lit(k)) * share).alias("w"), F.get("_gs", F.lit(k)).alias("g")) for node, share in places]
    if len(each) == 1:
        flat = rows.withColumn("_r", each[0])
    else:
        flat = rows.withColumn("_r", F.explode(F.array(*each)))
        flat = flat.where(F.col("_r.w") > 0) if spec.fuzzy else flat
    return flat.withColumns({"_node": F.col("_r.node"), "_w": F.col("_r.w"), "_g": F.col("_r.g")}).drop("_r")


def grow(rows: DataFrame, axes: Sequence[Axis], spec: BoostSpec, trees: int = 1, extents: dict | None = None) -> list[Node]:
    """Trees on binned rows with targets ``_gs`` and weights ``_ws``, side by side; a job a level, and only sums leave the executors."""
    depth = max(spec.depth, 1)
    first = [k << (depth + 1) for k in range(trees)]
    roots: list[Node | None] = [None] * trees
    hists: dict[int, list[np.ndarray]] = {}
    cells = F.array(*(F.struct(F.lit(i).alias("axis"), F.col(f"_b{i}").cast("int").alias("bin")) for i in range(len(axes))))
    halves = not spec.fuzzy  # with soft boundaries a row may be in both siblings

    def aggregate(routed: DataFrame, nodes: Sequence[int] | None) -> dict[int, list[np.ndarray]]:
        out: dict[int, list[np.ndarray]] = {}
        mine = routed if nodes is None else routed.where(F.col("_node").isin(*nodes))
        for r in cell_sums(mine.withColumn("_cells", cells)).collect():
            mine_ = out.setdefault(r["_node"], [np.zeros((len(a.edges) + 2, 4)) for a in axes])
            mine_[r["axis"]][r["bin"]] += (r["n"], r["w"], r["wy"], r["wyy"])
        return out

    frontier: dict[int, Node] = {}
    for level in range(depth):
        routed = routed_rows(rows, roots, spec, depth)
        if not level:
            hists = aggregate(routed, None)
            for k in range(trees):
                whole = hists[first[k] + 1][0].sum(0) if first[k] + 1 in hists else np.zeros(4)
                roots[k] = Node(_leaf(whole, spec.l2), n=int(whole[0]))
                frontier[first[k] + 1] = roots[k]
            if not spec.depth:
                break
        open_nodes = {k: v for k, v in frontier.items() if v.n >= 2 * spec.min_leaf}
        if not open_nodes:
            break
        if level:
            wanted, derived = [], []
            for k in sorted({k & ~1 for k in open_nodes}):
                if not halves or k not in frontier or k + 1 not in frontier:
                    wanted += [x for x in (k, k + 1) if x in open_nodes]
                    continue
                small = k if frontier[k].n <= frontier[k + 1].n else k + 1
                wanted.append(small)
                derived.append((small ^ 1, small))
            parents, hists = hists, aggregate(routed, wanted)
            none = [np.zeros((len(a.edges) + 2, 4)) for a in axes]
            for other, small in derived:
                code = (other - first[_tree_of(other, depth)]) // 2 + first[_tree_of(other, depth)]
                hists[other] = [p - c for p, c in zip(parents[code], hists.get(small, none), strict=True)]
        totals = {k: hists[k][0].sum(0) if k in hists else np.zeros(4) for k in open_nodes}
        best: dict[int, tuple] = {}

        def offer(k: int, c: tuple | None) -> None:
            old = best.get(k)  # noqa: B023
            if c is None:
                return
            spatial = lambda x: x[1].kind in ("diagonal", "radial")
            if old is None or c[0] > old[0] + (SPATIAL_MARGIN * max(abs(old[0]), 1e-12) if spatial(c) and not spatial(old) else 1e-12):
                best[k] = c  # noqa: B023

        for k in open_nodes:
            for a, cell in zip(axes, hists.get(k, ()), strict=False):
                offer(k, axis_candidate(a, cell, spec))
        if spec.radial:
            for k, discs in _discs(routed, open_nodes, extents or {}, spec).items():
                for a, cell in discs:
                    offer(k, axis_candidate(a, cell, spec))
        for k, c in _id_candidates(routed, open_nodes, totals, spec) if spec.sets else ():
            offer(k, c)
        if not best:
            break
        frontier = {}
        for k, (gain, axis, cut, miss, a, b) in best.items():
            node = open_nodes[k]
            node.feature, node.missing_left, node.gain, node.kind, node.fuzzy, node.kernel = axis.name, miss, gain, axis.kind, spec.fuzzy, spec.kernel
            node.params = list(axis.params)
            if axis.kind == "periodic":
                node.params = [*axis.params, *_interval(axis, cut)]
                node.feature = f"{axis.name} mod {axis.params[1]:g} in [{node.params[2]:.6g}, {node.params[3]:.6g}]"
            elif axis.kind == "set":
                node.feature = f"{axis.name} has {axis.params[1]}"
            else:
                node.threshold = float(cut)
            held = lambda v: min(max(v, node.low), node.high)  # noqa: B023, E731
            node.left, node.right = (Node(held(_leaf(s, spec.l2)), n=int(round(s[0])), low=node.low, high=node.high) for s in (a, b))
            if way := dict(spec.monotone).get(axis.name, 0) if axis.kind == "axis" else 0:  # what lies below must stay on its side of the middle
                middle = (node.left.value + node.right.value) / 2
                lower, upper = (node.left, node.right) if way > 0 else (node.right, node.left)
                lower.high, upper.low = min(lower.high, middle), max(upper.low, middle)
            base = first[_tree_of(k, depth)]
            frontier |= {base + 2 * (k - base): node.left, base + 2 * (k - base) + 1: node.right}
        if spec.fuzzy:  # what reaches the children is known once rows are shared out: their values come from the sums
            _soft_values(rows, roots, spec, depth)
    if spec.linear:
        for k, root in enumerate(roots):
            linear_leaves(rows, root, spec, k)
    return roots


def _tree_of(code: int, depth: int) -> int:
    return code >> (depth + 1)


def _soft_values(rows: DataFrame, roots: Sequence[Node], spec: BoostSpec, depth: int) -> None:
    """Counts and values of leaves from rows with fractional weights."""
    got = {r["_node"]: r for r in routed_rows(rows, roots, spec, depth).groupBy("_node").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_g")).alias("wy")).collect()}
    for k, root in enumerate(roots):
        for at, leaf in root.leaves():
            if (r := got.get((k << (depth + 1)) + at)) is not None:
                leaf.n, leaf.value = r["n"], min(max(_leaf((r["n"], r["w"], r["wy"]), spec.l2), leaf.low), leaf.high)


def linear_leaves(rows: DataFrame, root: Node, spec: BoostSpec, k: int = 0) -> None:
    """Ridge fits in the leaves: their normal equations are sums by leaf, (features + 1)² numbers each; a leaf whose system
    is singular stays constant."""
    depth = max(spec.depth, 1)
    routed = routed_rows(rows.withColumns({"_ws": F.array(F.get("_ws", F.lit(k))), "_gs": F.array(F.get("_gs", F.lit(k)))}), [root], spec, depth)
    cols = [F.lit(1.0), *(F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in spec.linear), F.col("_g")]
    m = len(cols)
    sums = [F.sum(F.col("_w") * cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]
    got = {r["_node"]: r for r in routed.groupBy("_node").agg(*sums).collect()}
    for at, leaf in root.leaves():
        if at in got:
            a = np.array([[got[at][f"s{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], float)
            try:
                c = np.linalg.solve(a[:-1, :-1] + spec.ridge * np.diag([0.0] + [1.0] * len(spec.linear)), a[:-1, -1])
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(c).all():
                leaf.value, leaf.slopes = float(c[0]), dict(zip(spec.linear, map(float, c[1:]), strict=True))


def leaf_quantiles(rows: DataFrame, root: Node, target: Column, level: float) -> None:
    """Leaf values as quantiles of the target: order statistics by an approximate sketch of 1 in 10,000."""
    got = {r["k"]: r["v"] for r in rows.groupBy(node_number(root).alias("k")).agg(F.percentile_approx(target, level, 10_000).alias("v")).collect()}
    for at, leaf in root.leaves():
        leaf.value = float(got.get(at) or 0.0)


# --- fitting ---------------------------------------------------------------------------------------------------------


def pseudo_target(spec: BoostSpec, y: Column, margin: Column) -> tuple[Column, Column]:
    """(target, curvature) of the next tree."""
    r = y - margin
    if spec.loss in ("l2", "log_l2"):
        return r, F.lit(1.0)
    if spec.loss == "l1":
        return F.signum(r), F.lit(1.0)
    if spec.loss == "huber":
        return F.greatest(F.least(r, F.lit(spec.huber)), F.lit(-spec.huber)), F.lit(1.0)
    if spec.loss == "quantile":
        return F.when(r >= 0, spec.alpha).otherwise(spec.alpha - 1), F.lit(1.0)
    if spec.loss == "logistic":
        p = sigmoid(margin)
        h = F.greatest(p * (1 - p), F.lit(1e-12))
        return (y - p) / h, h
    mu = F.exp(F.least(margin, F.lit(30.0)))  # poisson
    return (y - mu) / mu, mu


class _Margins:
    """Binned rows with the margins of one or more models as a cached column ``_m``, written anew every ``refresh`` rounds.

    A lost executor recomputes its cached part from the one before, and that in the end from the source.
    """

    def __init__(self, base: DataFrame, inits: Sequence[float], spec: BoostSpec):
        self.rows, self.spec, self.late = base.withColumn("_m", F.array(*map(F.lit, inits))).persist(), spec, [[] for _ in inits]

    def margin(self, k: int) -> Column:
        total = F.get("_m", F.lit(k))
        for t in self.late[k]:
            total = total + self.spec.rate * t.column()
        return total

    def add(self, trees: Sequence[Node]) -> None:
        for late, t in zip(self.late, trees, strict=True):
            late.append(t)
        if len(self.late[0]) >= self.spec.refresh:
            new = self.rows.withColumn("_m", F.array(*(self.margin(k) for k in range(len(self.late))))).persist()
            new.count()
            self.rows.unpersist()
            self.rows, self.late = new, [[] for _ in self.late]


def _prepared(rows: DataFrame, features: Sequence[str], spec: BoostSpec, keep: dict[str, Column]) -> tuple[DataFrame, list[Axis], dict]:
    """Rows with the columns that trees read, their bins and ``keep``; the axes; the extents of the pairs that discs look at."""
    axes = candidate_axes(rows, features, spec)
    pairs = [c for xy in (*spec.diagonal, *spec.radial) for c in xy]
    raw = dict.fromkeys([*features, *spec.linear, *pairs, *(f for f, _ in spec.periodic), *spec.sets])
    extents = {}
    if spec.radial:
        ends = rows.agg(*(f(F.when(finite(F.col(c)), F.col(c))).alias(f"{n}_{c}") for c in dict.fromkeys(c for xy in spec.radial for c in xy) for n, f in (("lo", F.min), ("hi", F.max)))).first()
        extents = {(x, y): math.hypot((ends[f"hi_{x}"] or 0) - (ends[f"lo_{x}"] or 0), (ends[f"hi_{y}"] or 0) - (ends[f"lo_{y}"] or 0)) for x, y in spec.radial}
    bins = {f"_b{i}": bin_column(a.value(), a.edges) for i, a in enumerate(axes)}
    return rows.select(*raw, *(c.alias(n) for n, c in (keep | bins).items())), axes, extents


def fit(rows: DataFrame, features: Sequence[str], label: str, spec: BoostSpec = BoostSpec(), weight: str | None = None) -> BoostModel:
    """Fit a regressor (or, with loss ``logistic``, a binary classifier)."""
    features = list(features)
    y = F.log1p(F.col(label)) if spec.loss == "log_l2" else F.col(label).cast("double")
    base, axes, extents = _prepared(rows, features, spec, {"_y": y, "_w0": F.col(weight).cast("double") if weight else F.lit(1.0)})
    mean = base.agg(F.sum(F.col("_w0") * F.col("_y")) / F.sum("_w0")).first()[0] or 0.0
    if spec.loss in ("l1", "quantile"):
        mean = base.approxQuantile("_y", [0.5 if spec.loss == "l1" else spec.alpha], 0.0001)[0]
    if spec.loss == "logistic":
        mean = math.log(min(max(mean, 1e-9), 1 - 1e-9) / (1 - min(max(mean, 1e-9), 1 - 1e-9)))
    if spec.loss == "poisson":
        mean = math.log(max(mean, 1e-9))
    model, state = BoostModel(features, float(mean), spec.rate, [], spec.loss), _Margins(base, [float(mean)], spec)
    for _ in range(spec.rounds):
        g, h = pseudo_target(spec, F.col("_y"), state.margin(0))
        tree = grow(state.rows.withColumns({"_gs": F.array(g), "_ws": F.array(F.col("_w0") * h)}), axes, spec, 1, extents)[0]
        if spec.loss in ("l1", "quantile"):
            leaf_quantiles(state.rows, tree, F.col("_y") - state.margin(0), 0.5 if spec.loss == "l1" else spec.alpha)
        if tree.feature is None and abs(tree.value) < 1e-12:
            break
        model.trees.append(tree)
        state.add([tree])
    state.rows.unpersist()
    return model


@dataclass(frozen=True)
class SplitFeatures:
    """Derived columns that turn half-plane, radial, periodic and set predicates into threshold splits of another learner.

    A half-plane is a threshold on its normal's projection, a disc one on the distance to a centre, an interval of a period
    one on the distance to its middle, and a set split one on a 0/1 column. Centres and ids come from the training rows: the
    ``middles`` and ``ids`` (the most frequent ones; None: all) are a stated choice. ``fit`` itself looks for such splits in
    each node's rows, without these columns.
    """

    columns: tuple[tuple[str, str, tuple], ...] = ()

    @staticmethod
    def learn(rows: DataFrame, spatial: Sequence[tuple[str, str]] = (), periodic: dict[str, float] | None = None, sets: Sequence[str] = (), target: str | None = None, middles: int = 8, ids: int | None = None) -> SplitFeatures:
        out: list[tuple[str, str, tuple]] = []
        for x, y in spatial:
            out += [(f"{x}_{y}_diagonal{i}", "diagonal", (x, y, *n)) for i, n in enumerate(DIAGONALS)]
            centres = [rows.agg(F.avg(x), F.avg(y)).first()]
            if target is not None:
                mean = rows.agg(F.avg(target)).first()[0]
                centres += [rows.where(c).agg(F.avg(x), F.avg(y)).first() for c in (F.col(target) > mean, F.col(target) <= mean)]
            out += [(f"{x}_{y}_radius{i}", "radial", (x, y, c[0], c[1])) for i, c in enumerate(centres) if c[0] is not None]
        for f, period in (periodic or {}).items():
            out += [(f"{f}_arc{i}", "periodic", (f, period, period * i / middles)) for i in range(middles)]
        for f in sets:
            known = rows.select(F.explode(F.array_distinct(f)).alias("id")).groupBy("id").count().orderBy(F.col("count").desc(), "id")
            out += [(f"{f}_has_{r['id']}", "set", (f, r["id"])) for r in (known if ids is None else known.limit(ids)).collect()]
        return SplitFeatures(tuple(out))

    @property
    def names(self) -> list[str]:
        return [n for n, _, _ in self.columns]

    def add(self, rows: DataFrame) -> DataFrame:
        made = {}
        for name, kind, a in self.columns:
            if kind == "diagonal":
                made[name] = F.col(a[0]) * a[2] + F.col(a[1]) * a[3]
            elif kind == "radial":
                made[name] = F.hypot(F.col(a[0]) - a[2], F.col(a[1]) - a[3])
            elif kind == "periodic":
                made[name] = circular_gap(wrap(F.col(a[0]), a[1]), a[2], a[1])
            else:
                made[name] = set_left(F.col(a[0]), [a[1]]).cast("double")
        return rows.withColumns(made) if made else rows


@dataclass
class MulticlassModel:
    classes: list
    models: list[BoostModel]

    def to_json(self) -> str:
        return json.dumps({"version": 1, "classes": self.classes, "models": [json.loads(m.to_json()) for m in self.models]})

    @staticmethod
    def from_json(text: str) -> MulticlassModel:
        d = json.loads(text)
        return MulticlassModel(d["classes"], [BoostModel.from_json(json.dumps(m)) for m in d["models"]])

    def probabilities(self) -> Column:
        return softmax(F.array(*(m.margin() for m in self.models)))

    def transform(self, rows: DataFrame) -> DataFrame:
        p = rows.withColumn("probabilities", self.probabilities())
        return p.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes)), F.array_position("probabilities", F.array_max("probabilities")).cast("int")))


def fit_classes(rows: DataFrame, features: Sequence[str], label: str, spec: BoostSpec = BoostSpec(), limit: int = 50) -> MulticlassModel:
    """One tree a class and round on softmax gradients (Newton targets); the trees of a round grow side by side in the same
    jobs. More than ``limit`` classes are an error."""
    features = list(features)
    classes = sorted(r[0] for r in rows.select(label).distinct().limit(limit + 1).collect())
    if len(classes) > limit:
        raise ValueError("too many classes")
    base, axes, extents = _prepared(rows, features, spec, {"_y": F.col(label)})
    counts = {r["_y"]: r["count"] for r in base.groupBy("_y").count().collect()}
    models = [BoostModel(features, math.log(counts[c] / sum(counts.values())), spec.rate, [], "raw") for c in classes]
    state = _Margins(base, [m.init for m in models], spec)
    for _ in range(spec.rounds):
        p = softmax(F.array(*(state.margin(k) for k in range(len(classes)))))
        h = F.transform("_p", lambda x: F.greatest(x * (1 - x), F.lit(1e-12)))
        hit = F.transform(F.array(*map(F.lit, classes)), lambda c: (F.col("_y") == c).cast("double"))
        told = state.rows.withColumn("_p", p).withColumn("_ws", h)
        told = told.withColumn("_gs", F.zip_with(F.zip_with(hit, "_p", lambda a, b: a - b), "_ws", lambda a, b: a / b))
        trees = grow(told, axes, spec, len(classes), extents)
        for m, t in zip(models, trees, strict=True):
            m.trees.append(t)
        state.add(trees)
    state.rows.unpersist()
    return MulticlassModel(classes, models)


def pair_gradients(rows: DataFrame, group: str, label: str, margin: str, tie: str, ndcg: bool = False) -> DataFrame:
    """(tie, grad, hess) of pairwise logistic loss within groups, weighted by |ΔNDCG| if asked; pairs are those of a group
    with different labels (an equi-join on the group; groups are result lists)."""
    a = rows.select(F.col(group).alias("_q"), F.col(tie).alias("_i"), F.col(label).alias("_a"), F.col(margin).alias("_s"), *(["_rank", "_ideal"] if ndcg else []))
    b = a.select("_q", F.col("_i").alias("_j"), F.col("_a").alias("_b"), F.col("_s").alias("_t"), *([F.col("_rank").alias("_rank2")] if ndcg else []))
    pairs = a.join(b, "_q").where(F.col("_a") > F.col("_b"))
    rho = sigmoid(F.col("_t") - F.col("_s"))
    gain = lambda c: F.pow(F.lit(2.0), F.col(c)) - 1
    w = F.abs((gain("_a") - gain("_b")) * (1 / F.log2(F.col("_rank") + 1) - 1 / F.log2(F.col("_rank2") + 1))) / F.greatest("_ideal", F.lit(1e-12)) if ndcg else F.lit(1.0)
    pairs = pairs.withColumn("_g", rho * w).withColumn("_h", rho * (1 - rho) * w)
    up = pairs.select(F.col("_i").alias(tie), F.col("_g").alias("g"), F.col("_h").alias("h"))
    down = pairs.select(F.col("_j").alias(tie), (-F.col("_g")).alias("g"), F.col("_h").alias("h"))
    return up.union(down).groupBy(tie).agg(F.sum("g").alias("grad"), F.sum("h").alias("hess"))


def fit_ranker(rows: DataFrame, features: Sequence[str], label: str, group: str, tie: str, spec: BoostSpec = BoostSpec(rounds=10, min_leaf=5), ndcg: bool = False) -> BoostModel:
    """Pairwise ranking by Newton targets grad / hess with weight hess; with ``ndcg`` pairs weigh what swapping them changes."""
    features = list(features)
    base, axes, extents = _prepared(rows, features, spec, {"_tie": F.col(tie), "_group": F.col(group), "_label": F.col(label).cast("double")})
    model, state = BoostModel(features, 0.0, spec.rate, [], "raw"), _Margins(base, [0.0], spec)
    for _ in range(spec.rounds):
        scored = state.rows.withColumn("_score", state.margin(0))
        grads = pair_gradients(with_ranks(scored, "_group", "_label", "_score", "_tie") if ndcg else scored, "_group", "_label", "_score", "_tie", ndcg)
        h = F.greatest("hess", F.lit(1e-12))
        told = state.rows.join(grads, "_tie").withColumns({"_ws": F.array(h), "_gs": F.array(F.col("grad") / h)})
        trees = grow(told, axes, spec, 1, extents)
        model.trees += trees
        state.add(trees)
    state.rows.unpersist()
    return model


def with_ranks(rows: DataFrame, group: str, label: str, score: str, tie: str) -> DataFrame:
    """Adds ``_rank`` (by falling score, then tie) and ``_ideal`` (the group's best DCG)."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    ideal = rows.withColumn("_i", F.row_number().over(w.orderBy(F.col(label).desc(), tie)))
    gain = (F.pow(F.lit(2.0), F.col(label)) - 1) / F.log2(F.col("_i") + 1)
    return ideal.withColumn("_ideal", F.sum(gain).over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.col(score).desc(), tie))).drop("_i")


def set_split_gains(rows: DataFrame, ids: str, target: str) -> DataFrame:
    """(id, n, gain): splitting rows by whether their id set holds the id; the rest is the whole minus the rows with it."""
    t = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("s"), F.sum(F.col(target) * F.col(target)).alias("q")).first()
    each = rows.select(F.explode(F.array_distinct(ids)).alias("id"), F.col(target).alias("y")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    rest_n, rest_s = F.lit(t["n"]) - F.col("n"), F.lit(t["s"]) - F.col("s")
    gain = F.col("s") * F.col("s") / F.col("n") + F.when(rest_n > 0, rest_s * rest_s / F.nullif(rest_n, F.lit(0))).otherwise(0.0) - F.lit(t["s"] * t["s"] / t["n"])
    return each.select("id", "n", gain.alias("gain"))


def axis_split_gains(rows: DataFrame, feature: str, target: str) -> DataFrame:
    """(threshold, n_left, gain): exact splits at middles between adjacent distinct values, from running sums by value."""
    v = rows.where(finite(F.col(feature))).groupBy(F.col(feature).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("s"))
    upto = running(v, ["v"], {"k": F.lit(1), "n_left": F.col("n"), "s_left": F.col("s")})
    following = upto.select((F.col("k") - 1).alias("k"), F.col("v").alias("next"))
    t = v.agg(F.sum("n"), F.sum("s")).first()
    n, s = t[0] or 0, t[1] or 0.0
    left = F.col("s_left") * F.col("s_left") / F.col("n_left")
    right = F.pow(F.lit(s) - F.col("s_left"), 2) / F.nullif(F.lit(n) - F.col("n_left"), F.lit(0))
    return upto.join(following, "k").select(((F.col("v") + F.col("next")) / 2).alias("threshold"), "n_left", (left + right - F.lit(s * s / max(n, 1))).alias("gain"))


def weighted_quantile(rows: DataFrame, value: str, weight: str, level: float, by: Sequence[str] = ()) -> DataFrame:
    """The first value whose cumulative weight reaches the level's share; non-finite values and weights <= 0 are left out."""
    from pyspark.sql import Window

    v = rows.where(finite(F.col(value)) & (F.col(weight) > 0)).groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    if not by:
        total = v.agg(F.sum("w")).first()[0] or 0
        return running(v, ["v"], {"c": F.col("w")}).where(F.col("c") >= level * F.lit(total)).agg(F.min("v").alias("quantile"))
    part = Window.partitionBy(*by)
    v = v.withColumn("c", F.sum("w").over(part.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("t", F.sum("w").over(part))
    return v.where(F.col("c") >= level * F.col("t")).groupBy(*by).agg(F.min("v").alias("quantile"))


Objective = Callable[[Column, Column], tuple[Column, Column, Column]]


def objectives(power: float = 1.5, dispersion: float = 1.0) -> dict[str, Objective]:
    """(value, gradient, curvature) of count losses by label and log-scale margin."""

    def poisson(y: Column, m: Column):
        mu = F.exp(m)
        return mu - y * m, mu - y, mu

    def tweedie(y: Column, m: Column):
        a, b = F.exp((1 - power) * m), F.exp((2 - power) * m)
        return -y * a / (1 - power) + b / (2 - power), -y * a + b, -y * (1 - power) * a + (2 - power) * b

    def negative_binomial(y: Column, m: Column):
        mu, k = F.exp(m), dispersion
        return (y + 1 / k) * F.ln(1 + k * mu) - y * m, (mu - y) / (1 + k * mu), mu * (1 + k * y) / F.pow(1 + k * mu, 2)

    def hurdle(y: Column, m: Column):
        p, hit = sigmoid(m), (y > 0).cast("double")
        return -(hit * F.ln(F.greatest(p, F.lit(1e-15))) + (1 - hit) * F.ln(F.greatest(1 - p, F.lit(1e-15)))), p - hit, p * (1 - p)

    return {"poisson": poisson, "tweedie": tweedie, "negative_binomial": negative_binomial, "hurdle": hurdle}
