"""Graphs as (src, dst, rel, weight, ts) edges: normalisation, features, walks, samples, paths, aggregation layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.predicates import cosine, dot, sigmoid, unit_draw
from gridloom.operators.order import placed


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse; self loops once."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.where(F.col("src") != F.col("dst")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return edges.select("src", "dst", *rest).unionByName(back)


def node_codes(edges: DataFrame, order: str) -> DataFrame:
    """(node, code) by first appearance in ``order``, source before target; codes from 0."""
    seen = edges.select(F.col("src").alias("node"), F.struct(F.col(order), F.lit(0)).alias("at")).union(edges.select("dst", F.struct(F.col(order), F.lit(1))))
    first = seen.groupBy("node").agg(F.min("at").alias("at"))
    return placed(first, ["at", "node"], "_k").select("node", (F.col("_k") - 1).alias("code"))


def encode_edges(edges: DataFrame, codes: DataFrame) -> DataFrame:
    src, dst = codes.select(F.col("node").alias("src"), F.col("code").alias("src_code")), codes.select(F.col("node").alias("dst"), F.col("code").alias("dst_code"))
    return edges.join(src, "src").join(dst, "dst")


def pair_nodes(edges: DataFrame, to_pair: str, from_pair: str, prefix: str = "pair") -> DataFrame:
    """Source -> pair and pair -> target edges of every edge, the pair node named ``prefix:src:dst``."""
    s, d = F.col("src").cast("string"), F.col("dst").cast("string")
    pair = F.concat_ws(":", F.lit(prefix), s, d)
    each = F.array(F.struct(s.alias("src"), pair.alias("dst"), F.lit(to_pair).alias("rel")), F.struct(pair.alias("src"), d.alias("dst"), F.lit(from_pair).alias("rel")))
    return edges.select(F.explode(each).alias("e")).select("e.*").distinct()


def invalid_metapath_steps(path: Sequence[tuple[str, str, str]], schema: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Steps (source type, relation, target type) that the schema lacks, or that don't continue the one before."""
    known = set(schema)
    return [s for i, s in enumerate(path) if s not in known or (i and path[i - 1][2] != s[0])]


def directional_features(edges: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """By node: weighted and plain degrees, shares, asymmetry, drift of time, and cosine to mean neighbours.

    ``edges``: src, dst, weight, ts (seconds, may be null). ``embeddings``: id, vec.
    """
    w, t = F.col("weight"), F.col("ts")
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"), F.sum(w).alias("out_weight"), F.avg(t).alias("out_time"), F.max(w).alias("_omax"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"), F.sum(w).alias("in_weight"), F.avg(t).alias("in_time"), F.max(w).alias("_imax"))
    rows = out.join(into, "node", "full").na.fill(0, ["out_degree", "in_degree"]).na.fill(0.0, ["out_weight", "in_weight"])
    total = F.col("out_weight") + F.col("in_weight")
    rows = rows.withColumn("degree_imbalance", (F.col("out_degree") - F.col("in_degree")) / F.nullif(F.col("out_degree") + F.col("in_degree"), F.lit(0)))
    rows = rows.withColumn("asymmetry", F.when(total > 0, (F.col("out_weight") - F.col("in_weight")) / F.nullif(total, F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("out_affinity", F.coalesce(F.col("_omax") / F.nullif(F.col("out_weight"), F.lit(0.0)), F.lit(0.0))).withColumn("in_affinity", F.coalesce(F.col("_imax") / F.nullif(F.col("in_weight"), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("temporal_drift", F.coalesce(F.col("out_time") - F.col("in_time"), F.lit(0.0))).drop("_omax", "_imax")
    if embeddings is None:
        return rows
    own = embeddings.select(F.col("id").alias("node"), F.col("vec").alias("_v"))
    rows = rows.join(own, "node", "left")
    for side, here, there in (("out", "src", "dst"), ("in", "dst", "src")):
        near = mean_neighbours(edges.select(F.col(here).alias("node"), F.col(there).alias("id")), embeddings).withColumnRenamed("vec", f"_{side}")
        rows = rows.join(near, "node", "left").withColumn(f"{side}_similarity", F.coalesce(cosine(F.col("_v"), F.col(f"_{side}")), F.lit(0.0))).drop(f"_{side}")
    return rows.drop("_v")


def mean_neighbours(links: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(node, vec): element-wise mean of linked vectors. Elements are summed by partial aggregation, so a hub isn't gathered."""
    each = links.join(embeddings.select("id", F.posexplode("vec").alias("i", "x")), "id")
    sums = each.groupBy("node", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return sums.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))


def sage_layer(links: DataFrame, features: DataFrame, own: Sequence[Sequence[float]], near: Sequence[Sequence[float]], bias: Sequence[float]) -> DataFrame:
    """One mean-aggregation layer: relu(own · x + near · mean of neighbours + bias); nodes without neighbours use zeros."""
    agg = mean_neighbours(links, features).select(F.col("node").alias("id"), F.col("vec").alias("_m"))
    rows = features.join(agg, "id", "left")
    zero = F.transform("vec", lambda v: F.lit(0.0))
    row = lambda weights: F.array(*map(F.lit, map(float, weights)))
    x, m = F.col("vec"), F.coalesce("_m", zero)
    out = [F.greatest(dot(x, row(a)) + dot(m, row(b)) + float(c), F.lit(0.0)) for a, b, c in zip(own, near, bias, strict=True)]
    return rows.select("id", F.array(*out).alias("vec"))


def typed_layer(links: DataFrame, features: DataFrame, own: Sequence[Sequence[float]], near: dict[str, Sequence[Sequence[float]]], bias: Sequence[float]) -> DataFrame:
    """One layer over typed links (node, id, rel): relu(own · x + Σ over relations of weights · mean of that relation + bias)."""
    rows = features
    for i, rel in enumerate(near):
        agg = mean_neighbours(links.where(F.col("rel") == rel).select("node", "id"), features).select(F.col("node").alias("id"), F.col("vec").alias(f"_m{i}"))
        rows = rows.join(agg, "id", "left")
    zero = F.transform("vec", lambda v: F.lit(0.0))
    row = lambda weights: F.array(*map(F.lit, map(float, weights)))
    out = []
    for k, c in enumerate(bias):
        total = dot(F.col("vec"), row(own[k])) + float(c)
        for i, weights in enumerate(near.values()):
            total = total + dot(F.coalesce(f"_m{i}", zero), row(weights[k]))
        out.append(F.greatest(total, F.lit(0.0)))
    return rows.select("id", F.array(*out).alias("vec"))


def sampled_links(links: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """At most ``most`` links a node, by a seeded hash (a sampling operator)."""
    order = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64(F.lit(seed), "node", "id"), "id"))
    return links.withColumn("_r", order).where(F.col("_r") <= most).drop("_r")


def link_scores(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """sigmoid(source · target) of each pair."""
    a, b = embeddings.select(F.col("id").alias("src"), F.col("vec").alias("_a")), embeddings.select(F.col("id").alias("dst"), F.col("vec").alias("_b"))
    return pairs.join(a, "src").join(b, "dst").withColumn("score", sigmoid(dot(F.col("_a"), F.col("_b")))).drop("_a", "_b")


def negative_edges(edges: DataFrame, nodes: DataFrame, per_edge: int = 1, seed: int = 7, oversample: int = 4) -> DataFrame:
    """(src, dst, negative): seeded targets that the source has no edge to, ``per_edge`` an edge or all there are.

    Candidates are drawn per edge from the numbered nodes and those that are edges are dropped by an anti join, so the
    node set is never crossed with the edges. Edges that are left with too few draw ranks among the source's unlinked nodes
    instead. A source that is linked to all nodes yields none.
    """
    numbered = placed(nodes.select("node").distinct(), ["node"], "k").withColumn("k", F.col("k") - 1)
    n = numbered.count()
    e = edges.select("src", "dst").distinct()
    tries = e.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(per_edge * oversample - 1))))
    tries = tries.withColumn("k", F.floor(unit_draw(seed, F.col("src"), F.col("dst"), F.col("try")) * n).cast("long"))
    drawn = tries.join(numbered, "k").select("src", "dst", "try", F.col("node").alias("negative"))
    free = drawn.join(e.select("src", F.col("dst").alias("negative")), ["src", "negative"], "left_anti").dropDuplicates(["src", "dst", "negative"])
    kept = F.row_number().over(Window.partitionBy("src", "dst").orderBy("try"))
    found = free.withColumn("_r", kept).where(F.col("_r") <= per_edge).select("src", "dst", "negative")
    linked = e.join(numbered.select(F.col("node").alias("dst"), "k"), "dst").select("src", F.col("k").cast("long").alias("k"))
    room = linked.groupBy("src").agg((F.lit(n) - F.count(F.lit(1))).alias("_room"))
    got = found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_got"))
    short = e.join(got, ["src", "dst"], "left").join(room, "src", "left").withColumn("_room", F.coalesce("_room", F.lit(n))).withColumn("_want", F.least("_room", F.lit(per_edge)))
    short = short.where(F.coalesce("_got", F.lit(0)) < F.col("_want")).select("src", "dst", "_room", "_want")
    # one rank in each of as many equal parts of the unlinked nodes, turned by a draw of the edge: distinct, and any can be met
    ranks = short.withColumn("_j", F.explode(F.sequence(F.lit(0), (F.col("_want") - 1).cast("int"))))
    low, high = F.floor(F.col("_j") * F.col("_room") / F.col("_want")), F.floor((F.col("_j") + 1) * F.col("_room") / F.col("_want"))
    at = low + F.floor(unit_draw(seed + 1, F.col("src"), F.col("dst"), F.col("_j")) * (high - low)) + F.floor(unit_draw(seed + 2, F.col("src"), F.col("dst")) * F.col("_room"))
    ranks = ranks.select("src", "dst", F.pmod(at, F.col("_room")).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_behind"))
    # the unlinked node of a rank has that code plus the number of linked codes before it
    place = F.row_number().over(Window.partitionBy("src").orderBy("k"))
    steps = linked.join(short.select("src").distinct(), "src", "left_semi").withColumn("_behind", place)
    steps = steps.select("src", F.lit(None).cast(e.schema["dst"].dataType).alias("dst"), (F.col("k") - F.col("_behind") + 1).alias("_at"), F.lit(0).alias("_kind"), "_behind")
    so_far = Window.partitionBy("src").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = steps.unionByName(ranks).withColumn("k", F.col("_at") + F.max("_behind").over(so_far)).where(F.col("_kind") == 1)
    filled = filled.join(numbered, "k").select("src", "dst", F.col("node").alias("negative"))
    return found.join(short, ["src", "dst"], "left_anti").unionByName(filled)


def walks(edges: DataFrame, starts: DataFrame, length: int, per_node: int = 1, p: float = 1.0, q: float = 1.0, seed: int = 11) -> DataFrame:
    """(start, walk, path): seeded second-order walks; weights are scaled by 1/p to go back, 1/q to leave the neighbourhood.

    Each step is one join of walkers with edges and one argmin over -ln(u) / weight (an exponential race, which draws in
    proportion to the weights), so walkers never meet in one task.
    """
    e = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    state = starts.select(F.col("node").alias("start")).distinct().withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))))
    state = state.withColumn("path", F.array("start"))
    near = e.select(F.col("src").alias("_prev"), F.col("dst").alias("_next"), F.lit(True).alias("_known"))
    for i in range(1, length):
        here = state.withColumn("src", F.element_at("path", -1)).withColumn("_prev", F.when(F.size("path") > 1, F.element_at("path", -2)))
        moves = here.join(e, "src").withColumnRenamed("dst", "_next")
        moves = moves.join(near, ["_prev", "_next"], "left") if i > 1 and (p != 1 or q != 1) else moves.withColumn("_known", F.lit(None).cast("boolean"))
        bias = F.when(F.col("_prev").isNull(), 1.0).when(F.col("_next") == F.col("_prev"), 1.0 / p).when(F.col("_known"), 1.0).otherwise(1.0 / q)
        race = -F.ln(F.greatest(unit_draw(seed, F.col("start"), F.col("walk"), F.lit(i), F.col("_next")), F.lit(1e-300))) / (F.col("weight") * bias)
        step = moves.groupBy("start", "walk").agg(F.min_by("_next", race).alias("_to"))
        state = state.join(step, ["start", "walk"], "left").select("start", "walk", F.when(F.col("_to").isNull() | (F.size("path") < i), F.col("path")).otherwise(F.concat("path", F.array("_to"))).alias("path"))
    return state


def metapath_walks(edges: DataFrame, starts: DataFrame, relations: Sequence[str], length: int, seed: int = 11) -> DataFrame:
    """(start, path): walks that follow the relations in turn, seeded uniform choice; a walk ends where no edge continues."""
    state = starts.select(F.col("node").alias("start")).distinct().withColumn("path", F.array("start"))
    for i in range(1, length):
        rel = relations[(i - 1) % len(relations)]
        here = state.where(F.size("path") == i).withColumn("src", F.element_at("path", -1))
        moves = here.join(edges.where(F.col("rel") == rel).select("src", "dst").distinct(), "src")
        step = moves.groupBy("start").agg(F.min_by("dst", F.xxhash64(F.lit(seed), "start", F.lit(i), "dst")).alias("_to"))
        state = state.join(step, "start", "left").select("start", F.when(F.col("_to").isNull(), F.col("path")).otherwise(F.concat("path", F.array("_to"))).alias("path"))
    return state


def temporal_walks(edges: DataFrame, starts: DataFrame, length: int, min_gap: float = 0.0, seed: int = 11) -> DataFrame:
    """(start, path, times): walks over edges of strictly rising time, by more than ``min_gap``."""
    state = starts.select(F.col("node").alias("start")).distinct().withColumn("path", F.array("start")).withColumn("times", F.array().cast("array<double>"))
    for i in range(1, length):
        here = state.where(F.size("path") == i).withColumn("src", F.element_at("path", -1)).withColumn("_t", F.when(F.size("times") > 0, F.element_at("times", -1)))
        moves = here.join(edges.select("src", "dst", F.col("ts").cast("double").alias("t")), "src").where(F.col("_t").isNull() | (F.col("t") > F.col("_t") + min_gap))
        step = moves.groupBy("start").agg(F.min_by(F.struct("dst", "t"), F.xxhash64(F.lit(seed), "start", F.lit(i), "dst", "t")).alias("_to"))
        stay = F.col("_to").isNull()
        state = state.join(step, "start", "left").select("start", F.when(stay, F.col("path")).otherwise(F.concat("path", F.array("_to.dst"))).alias("path"), F.when(stay, F.col("times")).otherwise(F.concat("times", F.array("_to.t"))).alias("times"))
    return state


def context_pairs(paths: DataFrame, window: int) -> DataFrame:
    """(centre, context): all pairs of a walk's nodes at most ``window`` places apart; an array expression, no join."""
    pairs = F.flatten(F.transform("path", lambda a, i: F.transform(F.filter(F.transform("path", lambda b, j: F.struct(b.alias("context"), j.alias("j"))), lambda s: (s["j"] != i) & (F.abs(s["j"] - i) <= window)), lambda s: F.struct(a.alias("centre"), s["context"].alias("context")))))
    return paths.select(F.explode(pairs).alias("x")).select("x.*")


def noise_weights(edges: DataFrame, power: float = 0.75) -> DataFrame:
    """(node, weight): max(weighted out-degree, 1) ^ power, the distribution of negative samples."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("w"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.join(out, "node", "left").select("node", F.pow(F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(1.0)), F.lit(power)).alias("weight"))


def two_hop(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(src, mid, dst, n): paths over a relation and then another, counted."""
    a = edges.where(F.col("rel") == first).select("src", F.col("dst").alias("mid"))
    b = edges.where(F.col("rel") == second).select(F.col("src").alias("mid"), "dst")
    return a.join(b, "mid").groupBy("src", "mid", "dst").agg(F.count(F.lit(1)).alias("n"))


def embedding_lookup(rows: DataFrame, table: DataFrame, fallback: str = "zero", parents: DataFrame | None = None, neighbours: DataFrame | None = None, dim: int = 0) -> DataFrame:
    """``vec`` for each row's id: its own, else the mean of its known neighbours, else its first known parent's, else zeros or the
    table's mean."""
    t = table.select("id", F.col("vec").alias("_own"))
    out = rows.join(t, "id", "left")
    options = [F.col("_own")]
    if neighbours is not None:
        near = mean_neighbours(neighbours.select(F.col("id").alias("node"), F.col("neighbour").alias("id")), table).select(F.col("node").alias("id"), F.col("vec").alias("_near"))
        out, options = out.join(near, "id", "left"), [*options, F.col("_near")]
    if parents is not None:
        p = parents.join(table.select(F.col("id").alias("parent"), F.col("vec").alias("_pv")), "parent")
        best = p.groupBy("id").agg(F.min_by("_pv", "ord").alias("_parent"))
        out, options = out.join(best, "id", "left"), [*options, F.col("_parent")]
    if fallback == "mean":
        mean = table.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").collect()
        last = F.array(*(F.lit(float(r["x"])) for r in mean))
    else:
        last = F.array(*(F.lit(0.0) for _ in range(dim))) if dim else F.array().cast("array<double>")
    wide = [F.transform(o, lambda v: v.cast("double")) for o in options]
    return out.withColumn("vec", F.coalesce(*wide, last)).drop("_own", "_near", "_parent")
