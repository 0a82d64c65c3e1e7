"""Hierarchies against dense linear algebra, and trees deeper than any fixed bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import hierarchy as hi


def test_closure_of_any_depth(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(20)], "child string, parent string")
    tree = hi.closure(chain)
    assert tree.count() == 21 * 22 // 2
    bottom = spark.createDataFrame([("0", 1, 5.0)], "node string, ts int, mean double")
    got = {r["node"]: r["mean"] for r in hi.bottom_up(bottom, tree).collect()}
    assert got == {str(i): 5.0 for i in range(21)}
    for ring in ([("a", "b"), ("b", "c"), ("c", "a")], [("x", "a"), ("a", "b"), ("b", "a")], [("a", "a")]):
        with pytest.raises(ValueError, match="cycle"):
            hi.closure(spark.createDataFrame(ring, "child string, parent string"))
    assert hi.closure(chain.limit(0)).count() == 0


EDGES = [("a", "r"), ("b", "r"), ("a1", "a"), ("a2", "a"), ("a3", "a"), ("b1", "b"), ("a21", "a2"), ("a22", "a2"), ("c", "r")]
NODES = sorted({x for e in EDGES for x in e})
BOTTOM = [n for n in NODES if n not in {p for _, p in EDGES}]


def summing():
    parent = dict(EDGES)
    s = np.zeros((len(NODES), len(BOTTOM)))
    for j, n in enumerate(BOTTOM):
        while n:
            s[NODES.index(n), j] = 1
            n = parent.get(n)
    return s


def projected(y, w):
    s, inverse = summing(), np.linalg.inv(w)
    return s @ np.linalg.inv(s.T @ inverse @ s) @ s.T @ inverse @ y


def test_reconciliation_against_linear_algebra(spark):
    rng = np.random.default_rng(2)
    tree = hi.closure(spark.createDataFrame(EDGES, "child string, parent string"))
    y = {t: rng.normal(10, 5, len(NODES)) for t in (1, 2)}
    base = spark.createDataFrame([(n, t, float(v)) for t in y for n, v in zip(NODES, y[t], strict=True)], "node string, ts int, mean double")
    weights = dict(zip(NODES, (rng.random(len(NODES)) + 0.2).tolist(), strict=True))
    got = {(r["node"], r["ts"]): r["mean"] for r in hi.reconcile(base, tree, weights).collect()}
    for t in y:
        assert [got[n, t] for n in NODES] == pytest.approx(projected(y[t], np.diag([weights[n] for n in NODES])).tolist())
    plain = {(r["node"], r["ts"]): r["mean"] for r in hi.reconcile(base.where("node <> 'a2' or ts <> 2"), tree).collect()}
    y[2][NODES.index("a2")] = 0.0
    for t in y:
        assert [plain[n, t] for n in NODES] == pytest.approx(projected(y[t], np.eye(len(NODES))).tolist())
    with pytest.raises(ValueError, match="one parent"):
        hi.reconcile(base, hi.closure(spark.createDataFrame([*EDGES, ("a1", "b")], "child string, parent string")))


@pytest.mark.parametrize("shrink", [0.0, 0.3, 1.0])
def test_minimum_trace(spark, shrink):
    rng = np.random.default_rng(7)
    tree = hi.closure(spark.createDataFrame(EDGES, "child string, parent string"))
    e = rng.normal(0, 1, (40, len(NODES))) @ rng.normal(0, 1, (len(NODES), len(NODES)))
    residuals = spark.createDataFrame([(n, t, float(e[t, i])) for t in range(40) for i, n in enumerate(NODES)], "node string, ts int, residual double")
    cov = np.cov(e.T)
    w = (1 - shrink) * cov + shrink * np.diag(np.diag(cov))
    assert hi.shrunk_covariance(residuals, NODES, shrink) == pytest.approx(w)
    y = rng.normal(10, 5, len(NODES))
    base = spark.createDataFrame([(n, 1, float(v)) for n, v in zip(NODES, y, strict=True)], "node string, ts int, mean double")
    got = {r["node"]: r["mean"] for r in hi.min_trace(base, tree, residuals, shrink).collect()}
    assert [got[n] for n in NODES] == pytest.approx(projected(y, w).tolist())
    with pytest.raises(ValueError, match="residuals"):
        hi.min_trace(base, tree, residuals.where("node <> 'a' or ts > 0"), shrink)
    with pytest.raises(ValueError, match="shrinkage"):
        hi.shrunk_covariance(residuals, NODES, 1.5)


def test_shrunk_variances(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0), ("b", 4.0)], "node string, residual double")
    assert {r["node"]: r["variance"] for r in hi.shrunk_variances(rows, 0.5).collect()} == {"a": 1.75, "b": 3.25}


def test_top_down_without_a_group(spark):
    total = spark.createDataFrame([(1, 10.0), (2, 20.0)], "ts int, mean double")
    history = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", -5.0)], "node string, weight double")
    got = {(r["node"], r["ts"]): r["mean"] for r in hi.top_down(total, history).collect()}
    assert got == {("a", 1): 7.5, ("b", 1): 2.5, ("c", 1): 0.0, ("a", 2): 15.0, ("b", 2): 5.0, ("c", 2): 0.0}
    even = hi.top_down(total, history.withColumn("weight", F.lit(0.0)))
    assert [r["mean"] for r in even.where("ts = 1").collect()] == pytest.approx([10 / 3] * 3)
