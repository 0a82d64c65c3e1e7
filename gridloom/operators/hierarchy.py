"""Hierarchies of series: roll-ups and reconciliation."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import staged


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, node, depth) of a parent/child table, each node its own ancestor at depth 0; rounds of joins, by depth.

    Each round is staged, so a hierarchy of any depth costs a join a level; a cycle is an error.
    """
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).where(F.col("node").isNotNull()).distinct()
    out = level = staged(nodes.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth")), "closure")
    up = staged(edges.where(F.col("parent").isNotNull()).select(F.col("child").alias("ancestor"), "parent").distinct(), "parents")
    depth = 0
    while True:
        depth += 1
        level = staged(level.join(up, "ancestor").select(F.col("parent").alias("ancestor"), "node", F.lit(depth).alias("depth")).distinct(), "closure")
        found = level.agg(F.count(F.lit(1)), F.sum((F.col("ancestor") == F.col("node")).cast("int"))).first()
        if not found[0]:
            return out
        if found[1]:
            raise ValueError("the hierarchy has a cycle")
        out = out.union(level)


def bottom_up(bottom: DataFrame, tree: DataFrame, value: str = "mean", keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Every node as the sum of the bottom nodes below it. ``bottom``: node, keys, value; ``tree``: a closure."""
    return bottom.join(tree, "node").groupBy(F.col("ancestor").alias("node"), *keys).agg(F.sum(value).alias(value))


def top_down(total: DataFrame, history: DataFrame, value: str = "mean", group: Sequence[str] = ()) -> DataFrame:
    """A total dealt to bottom nodes by their share of positive history; evenly if there is none.

    ``total``: group, keys, value; ``history``: group, node, weight. Grouping columns make it a middle-out step.
    """
    w = F.greatest(F.col("weight"), F.lit(0.0))
    sums = [F.sum(w).alias("_all"), F.count(F.lit(1)).alias("_count")]
    if group:
        beside = history.join(history.groupBy(*group).agg(*sums), list(group))
    else:
        row = history.agg(*sums).first()
        beside = history.withColumns({"_all": F.lit(row["_all"]), "_count": F.lit(row["_count"])})
    shares = beside.withColumn("share", F.when(F.col("_all") > 0, w / F.nullif(F.col("_all"), F.lit(0.0))).otherwise(1.0 / F.col("_count"))).drop("weight", "_all", "_count")
    joined = total.join(shares, list(group)) if group else total.crossJoin(shares)  # every total to every member: the result itself
    return joined.withColumn(value, F.col(value) * F.col("share")).drop("share")


def middle_out(middle: DataFrame, history: DataFrame, tree: DataFrame, value: str = "mean", keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Middle forecasts (middle, keys, value) dealt to their bottom nodes, then summed up the tree."""
    return bottom_up(top_down(middle, history, value, ["middle"]).select("node", *keys, value), tree, value, keys)


def proportional_total(members: DataFrame, target: str, value: str = "mean", keys: Sequence[str] = ("ts",), gamma: float = 1.0) -> DataFrame:
    """Members scaled by (target / sum) ^ gamma within each key; unchanged where the sum is not positive."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return members.withColumn(value, F.when(total > 0, F.col(value) * F.pow(F.col(target) / F.nullif(total, F.lit(0.0)), F.lit(gamma))).otherwise(F.col(value)))


def _variance_table(spark, variances: DataFrame | dict[str, float] | None) -> DataFrame:
    if isinstance(variances, DataFrame):
        return variances.select("node", F.col("variance").cast("double"))
    return spark.createDataFrame([(k, float(v)) for k, v in (variances or {}).items()], "node string, variance double")


def reconcile(base: DataFrame, tree: DataFrame, variances: DataFrame | dict[str, float] | None = None, keys: Sequence[str] = ("ts",), value: str = "mean") -> DataFrame:
    """Generalised least-squares projection of base forecasts onto coherent ones; ``variances`` by node (equal: OLS).

    ``tree`` is the closure of a hierarchy in which each node has one parent at most. There the projection is two passes over
    the levels: upwards each node's forecast is weighed against the sum of its children by their variances, downwards what is
    left of a parent's value is dealt to its children by theirs. Each level is a join and a sum, so neither nodes nor keys
    are gathered anywhere. A node without a base forecast at a key counts as 0 there; a null or negative variance as 1e-12.
    """
    spark = base.sparkSession
    edges = staged(tree.where(F.col("depth") == 1).select(F.col("ancestor").alias("parent"), "node"), "edges")
    if not edges.groupBy("node").count().where(F.col("count") > 1).isEmpty():
        raise ValueError("each node must have one parent at most")
    level = staged(tree.groupBy("node").agg(F.max("depth").alias("level")), "node-levels")
    deepest = level.agg(F.max("level")).first()[0] or 0
    weights = _variance_table(spark, variances)
    nodes = level.join(weights, "node", "left").withColumn("variance", F.greatest(F.coalesce("variance", F.lit(1.0)), F.lit(1e-12))).join(edges, "node", "left")
    own = nodes.crossJoin(base.select(*keys).distinct()).join(base.select("node", *keys, F.col(value).cast("double").alias("_y")), ["node", *keys], "left").withColumn("_y", F.coalesce("_y", F.lit(0.0)))
    own = staged(own, "own")
    up: dict[int, DataFrame] = {}
    below = None
    for d in range(deepest, -1, -1):
        here = own.where(F.col("level") == d)
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("node"), *keys).agg(F.sum("m").alias("_m"), F.sum("v").alias("_v"))
            here = here.join(sums, ["node", *keys], "left")
        else:
            here = here.withColumns({"_m": F.lit(None).cast("double"), "_v": F.lit(None).cast("double")})
        total = 1 / F.col("variance") + 1 / F.col("_v")
        m = F.when(F.col("_v").isNull(), F.col("_y")).otherwise((F.col("_y") / F.col("variance") + F.col("_m") / F.col("_v")) / total)
        v = F.when(F.col("_v").isNull(), F.col("variance")).otherwise(1 / total)
        up[d] = below = staged(here.withColumns({"m": m, "v": v}).select("node", *keys, "parent", "m", "v", "_m", "_v"), "upwards")
    done = above = up[0].select("node", *keys, F.col("m").alias(value), "_m", "_v")
    for d in range(1, deepest + 1):
        parents = above.select(F.col("node").alias("parent"), *keys, F.col(value).alias("_f"), F.col("_m").alias("_pm"), F.col("_v").alias("_pv"))
        lower = up[d].join(parents, ["parent", *keys]).withColumn(value, F.col("m") + F.col("v") / F.col("_pv") * (F.col("_f") - F.col("_pm")))
        above = staged(lower.select("node", *keys, value, "_m", "_v"), "downwards")
        done = done.union(above)
    return done.select("node", *keys, value)


def shrunk_variances(residuals: DataFrame, shrink: float = 0.5) -> DataFrame:
    """(node, variance): residual variance by node, drawn to the mean variance."""
    each = residuals.groupBy("node").agg(F.coalesce(F.var_pop("residual"), F.lit(0.0)).alias("v"))
    mean = each.agg(F.avg("v")).first()[0] or 0.0
    return each.select("node", ((1 - shrink) * F.col("v") + shrink * mean).alias("variance"))


#: Nodes of a hierarchy whose full covariance is used: its matrix has their square of entries, on the driver and in each task.
COVARIANCE_NODES = 2000


def shrunk_covariance(residuals: DataFrame, nodes: Sequence[str], shrink: float = 0.5, keys: Sequence[str] = ("ts",)) -> np.ndarray:
    """Covariance of the nodes' residuals (n - 1 in the denominator), drawn to its diagonal; the diagonal is 1e-12 at least.

    ``residuals``: node, keys, residual, with the same keys for all nodes. Products of pairs at a key are summed over the keys
    before anything leaves the executors.
    """
    if not 0 <= shrink <= 1:
        raise ValueError("a shrinkage between 0 and 1 is needed")
    means = residuals.groupBy("node").agg(F.avg("residual").alias("_mean"), F.count("residual").alias("_n"))
    table = {r["node"]: r["_n"] for r in means.collect()}
    if set(table) != set(nodes) or len(set(table.values())) > 1 or min(table.values(), default=0) < 2:
        raise ValueError("residuals of the same two or more keys are needed for every node")
    centred = residuals.join(means, "node").select("node", *keys, (F.col("residual") - F.col("_mean")).alias("_c"))
    other = centred.select(F.col("node").alias("_other"), *keys, F.col("_c").alias("_d"))
    sums = centred.join(other, list(keys)).where(F.col("node") <= F.col("_other")).groupBy("node", "_other").agg(F.sum(F.col("_c") * F.col("_d")).alias("s"))
    place, n = {x: i for i, x in enumerate(nodes)}, next(iter(table.values()))
    out = np.zeros((len(nodes), len(nodes)))
    for r in sums.collect():
        i, j = place[r["node"]], place[r["_other"]]
        out[i, j] = out[j, i] = r["s"] / (n - 1) * (1.0 if i == j else 1 - shrink)
    np.fill_diagonal(out, np.maximum(np.diag(out), 1e-12))
    return out


def min_trace(base: DataFrame, tree: DataFrame, residuals: DataFrame, shrink: float = 0.5, keys: Sequence[str] = ("ts",), value: str = "mean") -> DataFrame:
    """Minimum-trace reconciliation: the projection of base forecasts by the full shrunk covariance of all nodes' residuals.

    ``tree`` is a closure of at most COVARIANCE_NODES nodes (more are an error); any shape without cycles will do. Each key is
    one product with the projection, which is found once.
    """
    if tree.select("ancestor").distinct().count() > COVARIANCE_NODES:
        raise ValueError(f"a full covariance is for hierarchies of {COVARIANCE_NODES} nodes at most")
    pairs = tree.select("ancestor", "node").distinct().collect()
    parents = {p["ancestor"] for p in pairs if p["ancestor"] != p["node"]}
    nodes = sorted({p["ancestor"] for p in pairs})
    below = {n: i for i, n in enumerate(x for x in nodes if x not in parents)}
    place = {n: i for i, n in enumerate(nodes)}
    s = np.zeros((len(nodes), len(below)))
    for p in pairs:
        if p["node"] in below:
            s[place[p["ancestor"]], below[p["node"]]] = 1
    weighed = np.linalg.solve(shrunk_covariance(residuals, nodes, shrink, keys), s)
    project = s @ np.linalg.solve(s.T @ weighed, weighed.T)

    def run(pdf):
        pdf = pdf.set_index("node").reindex(nodes)
        out = pdf.reset_index().rename(columns={"index": "node"})
        out[value] = project @ pdf[value].fillna(0.0).to_numpy()
        for k in keys:
            out[k] = pdf[k].dropna().iloc[0]
        return out[["node", *keys, value]]

    narrow = base.select("node", *keys, F.col(value).cast("double").alias(value))
    return narrow.groupBy(*keys).applyInPandas(run, narrow.schema)


def level_totals(rows: DataFrame, levels: Sequence[Sequence[str]], value: str = "y", keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Sums at several levels at once: ``level`` (columns, joined by +, or total), ``member``, keys, value; one grouping-sets
    aggregation, so the rows are read and shuffled once."""
    columns = sorted({c for level in levels for c in level})
    sets = ", ".join("(" + ", ".join([*level, *keys]) + ")" for level in levels)
    view = rows.select(*columns, *keys, value)
    name = f"levels_{uuid.uuid4().hex}"
    view.createOrReplaceTempView(name)
    mask = ", ".join(f"grouping({c}) as g_{c}" for c in columns)
    sums = rows.sparkSession.sql(f"select {', '.join([*columns, *keys])}, sum({value}) as {value}, {mask} from {name} group by {', '.join([*columns, *keys])} grouping sets ({sets})")
    kept = [F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in columns]
    member = [F.when(F.col(f"g_{c}") == 0, F.col(c).cast("string")) for c in columns]
    return sums.select(F.coalesce(F.nullif(F.concat_ws("+", *kept), F.lit("")), F.lit("total")).alias("level"), F.concat_ws("+", *member).alias("member"), *keys, value)
