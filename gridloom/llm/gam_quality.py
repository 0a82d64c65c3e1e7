"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees.

Each feature is cut into at most ``bins`` bins. The rounds go through the features in turn; for each, a tree of at most three
leaves over the bins is fitted to the log-loss gradients and added, scaled, to the feature's lookup table. Pairs of features
are then ranked by how much of the remaining gradient a four-quadrant tree explains, and the best few get two-way tables in
the same way. A score is the sigmoid of a sum of table entries: one vectorised addition of looked-up bins for each table.

Only texts yield features. The sample of labelled rows is bounded by ``max_rows`` (a documented parameter); everything else
covers all rows.

Defined results. Null or empty text: the features of an empty text, and so a score like any other. Label null: the row is not
learned from. No labels at all: every score is 1.0, so nothing is rejected without evidence. One class only: the smoothed
share. Repeated rows: each is returned, with one score. Null doc_id: not held out, scored. Empty table: empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm._shared import BROADCAST_ROWS, map_arrow, text_slices

FEATURES = (
    "log_words", "word_length", "longest_word", "upper", "digits", "symbols", "exclamations", "ends", "commas", "other_marks",
    "high_bytes", "blanks", "distinct_words", "distinct_pairs", "top_word", "repeated_lines", "log_lines", "line_length", "ended_lines", "entropy",
)


def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([
    _members(bytes(range(65, 91))), _members(b"0123456789"), _members(b"#*$%&|<>{}[]=\\~^_@"), _members(b"!"), _members(b".?"), _members(b",;:"),
    _members(b"\"'()/-+`"), _members(bytes(range(0x80, 0x100))), _members(b" \t\n\r\v\f"),
]).T


def features(text: bytes | None) -> list[float]:
    """The feature values of one UTF-8 text."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = (counts @ _CLASSES) / n
    p = counts[counts > 0] / n
    words = text.split()
    k = len(words)
    if not k:
        return [0.0] * 11 + [1.0] + [0.0] * (len(FEATURES) - 12)
    often = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) / (k - 1) if k > 1 else 1.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in (b".", b"?", b"!") for x in lines) / len(lines)
    return [
        np.log1p(k), n / k, max(map(len, often)), *share[:8].tolist(), share[8], len(often) / k, pairs, max(often.values()) / k,
        1 - len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(n / len(lines)), ended, float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class GamModel:
    """Bin edges, one-way tables and two-way tables; a few thousand numbers, whatever the size of the data."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    constant: float | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Values by bin of a tree with up to three leaves over bins with gradient sums g, curvature sums h and counts n."""
    leaves = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None)
        for a, b in leaves:
            if b - a < 2:
                continue
            gl, hl, nl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], np.cumsum(n[a:b])[:-1]
            gs, hs, ns = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
            gain = np.where((nl >= least) & (ns - nl >= least), _gain(gl, hl) + _gain(gs - gl, hs - hl) - _gain(gs, hs), 0)
            if gain.max() > best[0]:
                best = (gain.max(), (a, a + 1 + int(gain.argmax()), b))
        if best[1] is None:
            break
        a, m, b = best[1]
        leaves.remove((a, b))
        leaves += [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each feature over a grid: its gain, and its values by cell."""
    sums = [np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h, n)]

    def four(c: np.ndarray) -> list[np.ndarray]:
        inner, rows, cols, all_ = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [inner, rows - inner, cols - inner, all_ - rows - cols + inner]

    gq, hq, nq = map(four, sums)
    gain = sum(_gain(a, b) for a, b in zip(gq, hq, strict=True)) - _gain(g.sum(), h.sum())
    gain = np.where(np.min(nq, 0) >= least, gain, 0)
    if not gain.size or gain.max() <= 1e-9:
        return 0.0, np.zeros_like(g)
    a, b = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    for k, (rows, cols) in enumerate(((slice(0, a + 1), slice(0, b + 1)), (slice(0, a + 1), slice(b + 1, None)), (slice(a + 1, None), slice(0, b + 1)), (slice(a + 1, None), slice(b + 1, None)))):
        out[rows, cols] = gq[k][a, b] / (hq[k][a, b] + 1.0)
    return float(gain.max()), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pairs: int = 8, rate: float = 0.1, least: int = 10) -> GamModel:
    """Learn the model from feature rows and 0/1 labels; the same rows in any order give the same tables."""
    if not len(y):
        return GamModel(constant=1.0)
    if y.min() == y.max():
        return GamModel(constant=float((y.sum() + 1) / (len(y) + 2)))
    model = GamModel(float(np.log(y.mean() / (1 - y.mean()))))
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    width = [len(e) + 1 for e in model.edges]
    total = np.full(len(y), model.intercept)
    model.tables = [np.zeros(w) for w in width]
    count = [np.bincount(b[:, j], minlength=w) for j, w in enumerate(width)]
    for _ in range(rounds):
        for j, w in enumerate(width):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b[:, j], y - p, w), np.bincount(b[:, j], p * (1 - p), w), count[j], least)
            model.tables[j] += step
            total += step[b[:, j]]
    p = 1 / (1 + np.exp(-total))

    def grid(i: int, j: int, p: np.ndarray) -> list[np.ndarray]:
        cell, shape = b[:, i] * width[j] + b[:, j], (width[i], width[j])
        return [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p), np.ones(len(y)))]

    ranked = sorted(((-_quadrants(*grid(i, j, p), least)[0], i, j) for i, j in combinations(range(len(width)), 2)))
    model.pairs = [(i, j) for gain, i, j in ranked[:pairs] if gain < 0]
    model.grids = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    for _ in range(rounds // 3):
        for k, (i, j) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            step = rate * _quadrants(*grid(i, j, p), least)[1]
            model.grids[k] += step
            total += step[b[:, i], b[:, j]]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featured(batches):
    for rows, texts in text_slices(batches, "_text"):
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(map(features, texts.to_pylist()), pa.list_(pa.float64()))], ["_id", "_label", "_features"])


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_rows`` labelled rows that aren't held out, chosen by a hash of the id.

    The share to take comes from a count, so ids outside it never reach a join; the chosen ids (at most max_rows, checked
    against the broadcast bound) are broadcast to the documents, and only those texts become features.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_lid"), F.col(label_col).cast("int").alias("_label")).where(F.col("_lid").isNotNull() & F.col("_label").isin(0, 1)).where(~held_out("_lid"))
    n = known.count()
    share = min(1.0, 0.95 * max_rows / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64("_lid", F.lit(9)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else known
    chosen = chosen.groupBy("_lid").agg(F.max("_label").alias("_label"))
    text = docs.select(F.col(id_col).cast("long").alias("_lid"), F.col(text_col).alias("_text"))
    few = F.broadcast(chosen) if max_rows <= BROADCAST_ROWS else chosen
    rows = map_arrow(text.join(few, "_lid").select(F.col("_lid").alias("_id"), "_label", "_text"), _featured, "_id long, _label int, _features array<double>")
    # a document may stand in the table many times: one row for each id, so that the bound holds
    got = rows.groupBy("_id", "_label").agg(F.min("_features").alias("_features")).toArrow().to_pandas()
    got = got.sort_values("_id").head(max_rows)
    x = np.array(got["_features"].tolist(), float).reshape(len(got), len(FEATURES))
    return x, got["_label"].to_numpy(float)


def score_quality(docs: DataFrame, model: GamModel, text_col: str = "text", out: str = "score", keep_from: float | None = None) -> DataFrame:
    """``docs`` with a score column, in one pass without a shuffle; with ``keep_from``, only rows that reach it.

    The input's columns come back as they are; a column that is called ``out`` already is replaced.
    """
    names = [c for c in docs.columns if c != out]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = names.index(text_col)
    flat = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    schema = T.StructType([*flat.schema.fields, T.StructField("_score", T.DoubleType())])

    def run(batches):
        for rows, texts in text_slices(batches, f"c{place}"):
            x = np.array([features(t) for t in texts.to_pylist()], float).reshape(rows.num_rows, len(FEATURES))
            got = pa.RecordBatch.from_arrays([*rows.columns, pa.array(sent.value.score(x))], [*rows.schema.names, "_score"])
            yield got if keep_from is None else got.filter(pa.compute.greater_equal(got.column(got.num_columns - 1), keep_from))

    scored = map_arrow(flat, run, schema)
    return scored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("_score").alias(out))


def quality_model(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> GamModel:
    """Learn from the documents' labelled rows that aren't held out."""
    return fit(*training_sample(docs, labels, max_rows=max_rows))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document."""
    model = quality_model(docs, labels, max_rows)
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
