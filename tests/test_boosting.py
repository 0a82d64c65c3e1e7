"""The booster's known answers, its trees against brute force, and its settings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import boost as bo

STUMP = {"rounds": 1, "rate": 1.0, "depth": 1, "min_leaf": 1, "min_gain": 0.0}


def predictions(model, rows):
    return [r["prediction"] for r in model.transform(rows).orderBy("i").collect()]


def table(spark, columns, y):
    rows = [(i, *map(float, v), float(t)) for i, (*v, t) in enumerate(zip(*columns.values(), y, strict=True))]
    return spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} double" for c in columns) + ", y double")


def test_native_geometry(spark):
    """Each kind of split solves its own fixture with one stump."""
    rows = table(spark, {"a": [-2, -1, 1, 2], "b": [-1, -1, 1, 1]}, [-10, -10, 10, 10])
    assert predictions(bo.fit(rows, [], "y", bo.BoostSpec(**STUMP, diagonal=(("a", "b"),))), rows) == [-10, -10, 10, 10]
    rows = table(spark, {"a": [0, 0.5, 3, -3], "b": [0, 0.5, 3, -3]}, [8, 8, -8, -8])
    model = bo.fit(rows, [], "y", bo.BoostSpec(**STUMP, radial=(("a", "b"),)))
    assert predictions(model, rows) == [8, 8, -8, -8] and model.trees[0].kind == "radial"
    rows = table(spark, {"h": [23, 0.5, 11, 12]}, [6, 6, -6, -6])
    model = bo.fit(rows, [], "y", bo.BoostSpec(**STUMP, periodic=(("h", 24.0),)))
    assert predictions(model, rows) == [6, 6, -6, -6] and model.trees[0].kind == "periodic"
    shifted = rows.withColumn("h", F.col("h") + 48)
    assert predictions(model, shifted) == [6, 6, -6, -6]
    sets = spark.createDataFrame([(0, [10, 20], 7.0), (1, [20, 30], 7.0), (2, [40], -2.0), (3, [], -2.0)], "i int, ids array<bigint>, y double")
    model = bo.fit(sets, [], "y", bo.BoostSpec(**STUMP, sets=("ids",)))
    assert predictions(model, sets) == [7, 7, -2, -2] and model.trees[0].params == ["ids", [20]]
    again = bo.BoostModel.from_json(model.to_json())
    assert predictions(again, sets) == [7, 7, -2, -2] and "ids has" in again.dump()
    with pytest.raises(Exception, match="ids"):
        again.transform(rows).collect()


def test_every_id_is_weighed(spark):
    """The id that splits is the rarest of fifty."""
    rows = spark.createDataFrame([(i, [i % 49, 100 + i % 7, *([777] if i % 40 == 3 else [])], 5.0 if i % 40 == 3 else 0.0) for i in range(400)], "i int, ids array<bigint>, y double")
    model = bo.fit(rows, [], "y", bo.BoostSpec(rounds=1, rate=1.0, depth=1, min_leaf=5, sets=("ids",)))
    assert model.trees[0].params == ["ids", [777]]
    assert len(bo.SplitFeatures.learn(rows, sets=["ids"]).names) == 57


def test_soft_boundaries(spark):
    x = table(spark, {"x": [0, 1, 2, 3]}, [0, 0, 10, 10])
    model = bo.fit(x, ["x"], "y", bo.BoostSpec(**STUMP, fuzzy=1.0))
    middle = spark.createDataFrame([(0, 1.5)], "i int, x double")
    assert predictions(model, middle) == pytest.approx([5.0])
    wide = bo.fit(x, ["x"], "y", bo.BoostSpec(**STUMP, fuzzy=2.0))
    left, right = (wide.init + leaf.value for leaf in (wide.trees[0].left, wide.trees[0].right))
    assert 0 < left < 5 < right < 10 and wide.trees[0].left.n == 4
    # by hand: distance d to 1.5, left share (1 - |d| / 2) / 2 + |d| / 2 where d <= 0
    share = [0.5 * (1 - abs(v - 1.5) / 2) + (abs(v - 1.5) / 2 if v <= 1.5 else 0) for v in range(4)]
    assert left == pytest.approx(sum(s * t for s, t in zip(share, [0, 0, 10, 10], strict=True)) / sum(share))
    for kernel in ("gaussian", "exponential", "bisquare", "epanechnikov", "tricube"):
        soft = bo.fit(x, ["x"], "y", bo.BoostSpec(rounds=3, rate=0.5, depth=2, min_leaf=1, fuzzy=1.5, kernel=kernel))
        got = predictions(soft, x)
        assert got == sorted(got) and predictions(bo.BoostModel.from_json(soft.to_json()), x) == pytest.approx(got)


def test_linear_leaf_known_answer(spark):
    x = table(spark, {"x": [0, 1, 2, 3]}, [3, 5, 7, 9])
    model = bo.fit(x, ["x"], "y", bo.BoostSpec(rounds=1, rate=0.5, depth=1, min_leaf=3, linear=("x",), ridge=0.0))
    assert predictions(model, x) == pytest.approx([4.5, 5.5, 6.5, 7.5])


def test_monotone_blocks_a_falling_fit(spark):
    for y, rises in (([10, 10, 0, 0], False), ([0, 0, 10, 10], True)):
        x = table(spark, {"x": [0, 1, 2, 3]}, y)
        got = predictions(bo.fit(x, ["x"], "y", bo.BoostSpec(**STUMP, monotone=(("x", 1),))), x)
        assert got == sorted(got) and (got[3] > got[0]) == rises


def brute_tree(x, y, depth, least):
    """Values by row of a tree on exact splits: features in their order, the first cut of the largest gain."""
    sse = lambda v: float(((v - v.mean()) ** 2).sum()) if len(v) else 0.0
    best = (1e-8, None)
    if depth and len(y) >= 2 * least:
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            for cut in (v[1:] + v[:-1]) / 2:
                left = x[:, j] <= cut
                if min(left.sum(), (~left).sum()) >= least and (gain := sse(y) - sse(y[left]) - sse(y[~left])) > best[0] + 1e-12:
                    best = gain, left
    out = np.full(len(y), y.mean())
    if best[1] is not None:
        out[best[1]] = brute_tree(x[best[1]], y[best[1]], depth - 1, least)
        out[~best[1]] = brute_tree(x[~best[1]], y[~best[1]], depth - 1, least)
    return out


def test_trees_brute(spark):
    """Exact splits, siblings by subtraction and the cached margin against loops over rows, over more rounds than a refresh."""
    rng = np.random.default_rng(4)
    x = np.round(rng.random((300, 3)) * 20, 1)
    y = np.round(np.sin(x[:, 0]) * 5 + (x[:, 1] > 12) * x[:, 2] + rng.normal(0, 0.3, 300), 3)
    rows = table(spark, {f"x{j}": x[:, j] for j in range(3)}, y)
    model = bo.fit(rows, ["x0", "x1", "x2"], "y", bo.BoostSpec(rounds=6, rate=0.4, depth=4, min_leaf=7, splitter="exact", refresh=2))
    want = np.full(300, y.mean())
    for _ in range(6):
        want = want + 0.4 * brute_tree(x, y - want, 4, 7)
    assert predictions(model, rows) == pytest.approx(want.tolist(), abs=1e-6)


def test_a_tree_costs_the_same_later(spark):
    """The plan of the margin holds the trees of a few rounds only, however many came before."""
    rows = table(spark, {"x": np.arange(60)}, np.arange(60) % 7)
    base, axes, _ = bo._prepared(rows, ["x"], bo.BoostSpec(min_leaf=2), {"_y": F.col("y"), "_w0": F.lit(1.0)})
    spec = bo.BoostSpec(min_leaf=2, depth=2, refresh=3)
    state, sizes = bo._Margins(base, [3.0], spec), []
    for _ in range(10):
        g, h = bo.pseudo_target(spec, F.col("_y"), state.margin(0))
        state.add(bo.grow(state.rows.withColumns({"_gs": F.array(g), "_ws": F.array(h)}), axes, spec))
        sizes.append(state.margin(0)._jc.toString().count("CASE"))
    state.rows.unpersist()
    assert sizes[2::3] == [0, 0, 0] and max(sizes) <= 2 * 2 * 3  # two trees of three splits, each with a case for missing values


def test_classes_grow_side_by_side(spark):
    """Softmax trees of a round equal trees grown one by one on the same targets."""
    rng = np.random.default_rng(1)
    x = np.round(rng.random(200) * 10, 1)
    c = np.where(x < 3, "a", np.where(x < 6, "b", "c"))
    rows = spark.createDataFrame([(i, float(v), str(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))], "i int, x double, c string")
    model = bo.fit_classes(rows, ["x"], "c", bo.BoostSpec(rounds=4, rate=0.5, depth=2, min_leaf=5, refresh=2, splitter="exact"))
    out = model.transform(rows)
    assert out.where("prediction <> c").count() == 0 and out.where("abs(aggregate(probabilities, 0d, (a, v) -> a + v) - 1) > 1e-9").count() == 0
    share = {k: float((c == k).mean()) for k in "abc"}
    p = np.tile([share[k] for k in "abc"], (200, 1))
    for k, name in enumerate("abc"):
        h = p[:, k] * (1 - p[:, k])
        g = ((c == name) - p[:, k]) / h
        first = model.models[k].trees[0]
        left = x <= first.threshold
        assert first.gain == pytest.approx(float((h * g).sum() ** 2 / h.sum() * -1 + sum((h[m] * g[m]).sum() ** 2 / h[m].sum() for m in (left, ~left))))


def test_ranking_by_ndcg(spark):
    rows = spark.createDataFrame([(i, i // 8, float((i * 5) % 8), float((i * 5) % 8 // 3)) for i in range(64)], "id int, q int, x double, rel double")
    from gridloom.operators import metrics as me

    for ndcg in (False, True):
        model = bo.fit_ranker(rows, ["x"], "rel", "q", "id", bo.BoostSpec(rounds=4, rate=0.5, depth=2, min_leaf=3), ndcg)
        assert me.ndcg(model.transform(rows), "q", "rel", "prediction", "id").agg(F.avg("ndcg")).first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize("bad", [{"rounds": 0}, {"rate": 0.0}, {"rate": math.nan}, {"depth": -1}, {"min_leaf": 0}, {"min_gain": -1.0}, {"l2": -0.1}, {"bins": 1}, {"loss": "no"}, {"alpha": 1.0}, {"huber": 0.0}, {"splitter": "no"}, {"fuzzy": -1.0}, {"kernel": "no"}, {"monotone": (("x", 2),)}, {"monotone": (("x", 1),), "diagonal": (("x", "y"),)}, {"periodic": (("h", 0.0),)}, {"missing": "no"}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError, match=r"\w"):
        bo.BoostSpec(**bad)


def test_exact_splits_are_never_cut_short(spark):
    wide = spark.range(9000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    with pytest.raises(ValueError, match="distinct"):
        bo.fit(wide, ["x"], "y", bo.BoostSpec(rounds=1, splitter="exact"))


def test_odd_rows(spark):
    """Missing values go to the better side; all missing, one row and equal targets give a constant."""
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else float("nan") if i % 5 == 1 else float(i), 9.0 if i % 5 < 2 or i >= 50 else 0.0) for i in range(100)], "i int, x double, y double")
    for sign in (1, -1):  # the side with the large values is the right one, then the left one
        model = bo.fit(rows.withColumn("x", F.col("x") * sign), ["x"], "y", bo.BoostSpec(**STUMP, splitter="exact", missing="best"))
        assert model.trees[0].missing_left == (sign < 0)
        assert model.transform(rows.withColumn("x", F.col("x") * sign)).where("abs(prediction - y) > 1e-9").count() == 0
    for few in (rows.where("i % 5 = 0"), rows.where("i = 7"), rows.withColumn("y", F.lit(2.0))):
        assert bo.fit(few, ["x"], "y", bo.BoostSpec(rounds=2)).transform(few).select("prediction").distinct().count() == 1


def test_shapley_values_by_all_orders(spark):
    """Each column's value is its mean gain over all orders in which columns become known."""
    from itertools import permutations

    rng = np.random.default_rng(8)
    x = np.round(rng.random((120, 3)) * 10, 1)
    y = x[:, 0] * (x[:, 1] > 5) + np.where(x[:, 2] < 3, 4.0, 0.0)
    rows = table(spark, {f"x{j}": x[:, j] for j in range(3)}, y)
    model = bo.fit(rows, ["x0", "x1", "x2"], "y", bo.BoostSpec(rounds=2, rate=0.7, depth=3, min_leaf=5, splitter="exact"))
    parts = model.shapley()
    got = rows.select("i", model.margin().alias("m"), *(parts.get(c, F.lit(0.0)).alias(c) for c in ("base", "x0", "x1", "x2"))).orderBy("i").collect()

    def worth(node, row, known):
        if node.feature is None:
            return node.value
        if node.feature in known:
            return worth(node.left if row[node.feature] <= node.threshold else node.right, row, known)
        a, b = node.left.n, node.right.n
        return (a * worth(node.left, row, known) + b * worth(node.right, row, known)) / (a + b)

    for i in range(0, 120, 7):
        row = {f"x{j}": x[i, j] for j in range(3)}
        value = lambda known: model.init + sum(0.7 * worth(t, row, known) for t in model.trees)  # noqa: B023, E731
        want = dict.fromkeys(row, 0.0)
        for order in permutations(row):
            for k, name in enumerate(order):
                want[name] += (value(set(order[: k + 1])) - value(set(order[:k]))) / 6
        assert {c: got[i][c] for c in row} == pytest.approx(want) and got[i]["base"] == pytest.approx(value(set()))
        assert got[i]["base"] + sum(got[i][c] for c in row) == pytest.approx(got[i]["m"])
    soft = bo.fit(rows, ["x0", "x1"], "y", bo.BoostSpec(rounds=2, rate=0.7, depth=2, min_leaf=5, fuzzy=1.0))
    total = sum(soft.shapley().values(), F.lit(0.0))
    assert rows.where(F.abs(total - soft.margin()) > 1e-9).count() == 0
    with pytest.raises(ValueError, match="more than 1"):
        model.shapley(1)


def test_dense_table_known_answer(spark):
    """Five trees of depth two over six rows, to the last digits."""
    rows = table(spark, {"f0": [0.10, 0.15, 0.20, 0.75, 0.80, 0.85], "f1": [0.05, 0.07, 0.10, 0.70, 0.74, 0.79], "f2": [0.90, 0.85, 0.80, 0.25, 0.20, 0.15], "f3": [0.88, 0.80, 0.72, 0.20, 0.15, 0.12], "f4": [10, 50, 120, 220, 300, 340]}, [140, 145, 155, 250, 265, 275])
    model = bo.fit(rows, [f"f{j}" for j in range(5)], "y", bo.BoostSpec(rounds=5, rate=0.25, depth=2, min_leaf=1, splitter="exact"))
    assert model.init == 205.0 and model.trees[0].feature == "f0" and model.trees[0].missing_left
    assert predictions(model, rows) == pytest.approx([156.1846923828125, 159.17205810546875, 166.17156982421875, 240.3466796875, 251.19140625, 256.93359375], abs=1e-9)
    # a missing value goes left at every split
    assert predictions(model, rows.withColumn("f0", F.lit(None).cast("double")).limit(1)) == pytest.approx([156.1846923828125], abs=1e-9)


def test_spatial_splits_need_a_margin(spark):
    """A disc that is little better than a threshold isn't taken, one that is much better is."""
    ring = [(x / 2, y / 2, 1.0 if x * x + y * y < 40 else 0.0) for x in range(-8, 9) for y in range(-8, 9)]
    rows = table(spark, {"a": [r[0] for r in ring], "b": [r[1] for r in ring]}, [r[2] for r in ring])
    spec = bo.BoostSpec(**{**STUMP, "min_leaf": 5}, radial=(("a", "b"),))
    assert bo.fit(rows, ["a", "b"], "y", spec).trees[0].kind == "radial"
    flat = rows.withColumn("y", (F.col("a") > 0.2).cast("double"))
    assert bo.fit(flat, ["a", "b"], "y", bo.BoostSpec(**STUMP, diagonal=(("a", "b"),), radial=(("a", "b"),))).trees[0].kind == "axis"
