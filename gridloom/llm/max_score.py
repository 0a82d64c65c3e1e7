"""Exact top-k by inner product with MaxScore over integer vectors.

A vector's dimensions are the terms, its integer components the impacts, and a shard's column of a dimension is the posting
list of that term. For a query, each term adds between a lower and an upper bound of the shard; with contributions counted
from their lower bounds, the terms of least reach whose bounds together can't lift a row above the k-th best score so far are
non-essential. Essential postings are traversed for a run of rows at a time; only rows that may still compete have the other
terms probed, in groups of falling reach, and leave as soon as they can't. A shard is read once for a group of query blocks,
which are streamed past it; each pair gives k rows a query, and the shards' lists are merged by score, then id.

Defined results. Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Empty
vectors and missing components count as zeros. Repeated ids: each row is a candidate (and a query) of its own; a query's own
row alone is left out. Scores beyond a long are held at its ends. Fewer candidates than k: all. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._shared import map_arrow, stage

SHARD_ROWS, QUERY_ROWS, RUN_ROWS, PROBE = 16_384, 256, 2048, 8
#: Query blocks that one copy of a shard serves.
QUERY_GROUP = 64


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``_row``, ``_id`` and ``_v``: floor(scale * x) of every component as long; rows that take part only."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("_v"))


def _packed(rows_each: int):
    """Rows of a partition in blocks: ids, row numbers and the matrix as bytes of the smallest integers that hold it."""

    def block(ids, rows, vectors):
        width = max((len(v) for v in vectors), default=0)
        m = np.zeros((len(vectors), width), np.int64)
        for i, v in enumerate(vectors):
            m[i, : len(v)] = v
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not m.size or (np.iinfo(t).min <= m.min() and m.max() <= np.iinfo(t).max))
        return pa.RecordBatch.from_pydict({"ids": [np.array(ids, np.int64).tobytes()], "rows": [np.array(rows, np.int64).tobytes()], "m": [m.astype(kind).tobytes()], "width": [width], "kind": [np.dtype(kind).itemsize]}, pa.schema([("ids", pa.binary()), ("rows", pa.binary()), ("m", pa.binary()), ("width", pa.int32()), ("kind", pa.int32())]))

    def run(batches):
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for into, name in zip(held, ("_id", "_row", "_v"), strict=True):
                into.extend(batch.column(name).to_pylist())
            while len(held[0]) >= rows_each:
                yield block(*(h[:rows_each] for h in held))
                for h in held:
                    del h[:rows_each]
        if held[0]:
            yield block(*held)

    return run


def _blocks(rows: DataFrame, rows_each: int, name: str) -> DataFrame:
    """Staged blocks, numbered from 0: the few rows of (file order) numbers make no task hold the blocks themselves."""
    packed = stage(map_arrow(rows, _packed(rows_each), "ids binary, rows binary, m binary, width int, kind int").withColumn("at", F.monotonically_increasing_id()), name)
    number = packed.select(F.col("at").alias("_at"), (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("number"))
    return packed.join(number, F.col("at") == F.col("_at")).drop("at", "_at")


def _matrix(m: bytes, width: int, kind: int, n: int) -> np.ndarray:
    return np.frombuffer(m, {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[kind]).reshape(n, width)


def _exact_type(*matrices: np.ndarray):
    """The fastest number type in which every partial inner product, and the difference of two, is exact."""
    top = [max((abs(int(m.min())), abs(int(m.max()))), default=0) if m.size else 0 for m in matrices]
    reach = top[0] * top[1] * max(m.shape[1] for m in matrices)
    return np.float32 if reach < 2**23 else np.float64 if reach < 2**52 else object


def search_shard(query: np.ndarray, own: int, postings: np.ndarray, high: np.ndarray, low: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the k best rows of a shard for one query; ``postings`` has a row for each term."""
    a, b = query * high, query * low
    most, least = np.maximum(a, b), np.minimum(a, b)
    reach = most - least
    order = np.argsort(reach, kind="stable")  # least reach first
    lifted = np.cumsum(reach[order])
    floor = least.sum()
    best_at, best = np.empty(0, np.int64), np.empty(0, query.dtype)
    for start in range(0, len(ids), RUN_ROWS):
        stop = min(start + RUN_ROWS, len(ids))
        bar = best[-1] if len(best) == k else None
        cut = 0 if bar is None else int(np.searchsorted(lifted, bar - floor))  # terms before the cut can't reach the bar
        need, spare = order[cut:], order[:cut][::-1]
        score = query[need] @ postings[need, start:stop]
        at = np.arange(start, stop)
        rest = most[spare].sum()
        if bar is not None:
            live = score + rest >= bar
            at, score = at[live], score[live]
            for g in range(0, len(spare), PROBE):
                if not len(at):
                    break
                terms = spare[g : g + PROBE]
                score = score + query[terms] @ postings[np.ix_(terms, at)]
                rest = rest - most[terms].sum()
                live = score + rest >= bar
                at, score = at[live], score[live]
        other = rows[at] != own
        at, score = np.concatenate([best_at, at[other]]), np.concatenate([best, score[other]])
        if len(at) > k:  # those at the k-th score all stay in view, so that ids decide
            edge = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= edge], score[score >= edge]
        ranked = np.lexsort((rows[at], ids[at], -score))[:k] if score.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (-score[i], ids[at[i]], rows[at[i]]))[:k], np.int64)
        best_at, best = at[ranked], score[ranked]
    return best_at, best


class _Shard:
    """A shard that a task holds: ids, row numbers, and its posting lists by number type."""

    def __init__(self, x: dict):
        self.ids, self.rows = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["rows"], np.int64)
        self.matrix = _matrix(x["m"], x["width"], x["kind"], len(self.ids))
        self.held: dict[tuple, tuple] = {}

    def postings(self, width: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if (width, kind) not in self.held:
            lists = np.ascontiguousarray(self.matrix[:, :width].T).astype(kind)
            none = np.empty(0, kind)
            self.held = {(width, kind): (lists, lists.max(1) if width else none, lists.min(1) if width else none)}
        return self.held[width, kind]


def _searched(k: int):
    def run(batches):
        shard = None
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                if x["q_number"] < 0:  # a shard comes before the query blocks that are to meet it
                    shard = _Shard(x)
                    continue
                q_ids, q_rows = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["rows"], np.int64)
                q = _matrix(x["m"], x["width"], x["kind"], len(q_ids))
                width = min(shard.matrix.shape[1], q.shape[1])
                q = q[:, :width]
                kind = _exact_type(shard.matrix[:, :width], q) if width else np.float32
                postings, high, low = shard.postings(width, kind)
                q = q.astype(kind)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for j in range(len(q_ids)):
                    at, score = search_shard(q[j], q_rows[j], postings, high, low, shard.ids, shard.rows, k)
                    score = [min(max(int(s), -(2**63)), 2**63 - 1) for s in score] if kind is object else score.astype(np.int64).tolist()
                    for into, values in zip(out, ([int(q_rows[j])] * len(at), [int(q_ids[j])] * len(at), shard.ids[at].tolist(), score), strict=True):
                        into.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["q_row", "query_id", "vec_id", "score"])

    return run


def max_score_search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k best rows of each query, ties to the smaller id.

    ``is_query`` is a condition on ``_id``. A unit of work is a shard and the query blocks of one group, streamed past it; blocks
    hold at most QUERY_ROWS and SHARD_ROWS vectors and a task holds one shard, so its memory doesn't grow with the data. A group
    is smaller than QUERY_GROUP only where there would be fewer units than tasks.
    """
    rows = stage(quantised(vectors, scale, id_col, vector_col), "vectors")
    shards = stage(_blocks(rows.coalesce(max(1, -(-rows.count() // (4 * SHARD_ROWS)))), SHARD_ROWS, "shards"), "shards")
    found = rows.where(is_query)
    queries = stage(_blocks(found.coalesce(max(1, -(-found.count() // (4 * QUERY_ROWS)))), QUERY_ROWS, "queries"), "queries")
    n, m = queries.count(), shards.count()
    spark = rows.sparkSession
    tasks = max(1, min(n * m, 4 * spark.sparkContext.defaultParallelism))
    size = max(1, min(QUERY_GROUP, n * m // tasks))
    groups = -(-n // size)
    block = ["ids", "rows", "m", "width", "kind"]
    copies = spark.range(m * groups).select(F.floor(F.col("id") / max(groups, 1)).alias("number"), (F.col("id") % max(groups, 1)).alias("group"), F.lit(-1).cast("long").alias("q_number"))
    meets = spark.range(n * m).select(F.floor(F.col("id") / max(n, 1)).alias("shard"), (F.col("id") % max(n, 1)).alias("number"))
    meets = meets.join(queries, "number").select(F.col("shard").alias("number"), F.floor(F.col("number") / size).alias("group"), F.col("number").alias("q_number"), *block)
    units = copies.join(shards, "number").select("number", "group", "q_number", *block).unionByName(meets)
    pairs = units.repartition(tasks, "number", "group").sortWithinPartitions("number", "group", "q_number")
    lists = map_arrow(pairs, _searched(k), "q_row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
