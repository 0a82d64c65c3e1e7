"""Substring dedup by sliding sentence spans: hash every run of consecutive sentences, join them globally, cut repeated ones.

A sentence ends at ``.``, ``!`` or ``?`` before a blank, or at a line's end; a piece of fewer than ``PIECE_WORDS`` words (an
abbreviation, a list mark, a heading of a word) belongs to the sentence that follows it. The words of a sentence, joined by
single blanks, are what is compared. Every run of ``span`` consecutive sentences is hashed to 128 bits, whatever its number of
words, so that a repeated passage of ``span`` or more sentences that are whole in both places is covered from its first to its
last. A passage whose ends are glued to the text around it has fewer whole sentences than that; so every shorter run, down to a
single sentence, is hashed too where it holds ``long_words`` words (None: only runs of ``span`` sentences are). The first place
of a run, by doc_id and position, stays; sentences that any other place covers are cut.

Defined results. Null text: null comes back, no sentences. Empty text: empty, no sentences. Null doc_id: comes after all
others in the order. Rows that repeat both doc_id and text are one document and get the same result, each. Repeats inside a
document count like any other. Empty table: empty result. Other columns come back as they are.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm._shared import map_arrow, stage, text_key, text_slices, unstage

#: Sentences of a run, words from which on a shorter run counts as well, and words of the shortest sentence of its own.
SPAN, LONG_WORDS, PIECE_WORDS = 3, 20, 3
_BREAK = re.compile(rb"(?<=[.!?])[ \t\r\v\f]+|[ \t\r\v\f]*\n\s*")


def sentences(text: bytes | None) -> list[bytes]:
    """The text in pieces, each a sentence with the blanks behind it; joined they give the text again."""
    if not text:
        return []
    cuts = [m.end() for m in _BREAK.finditer(text)]
    out, start = [], 0
    for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
        if len(text[a:b].split(None, PIECE_WORDS - 1)) >= PIECE_WORDS:
            out.append(text[start:b])
            start = b
    return [*out, text[start:]] if start < len(text) else out


def runs(text: bytes | None, span: int = SPAN, long_words: int | None = LONG_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, the one behind the last, and two hash words (a row each) of every run of a text."""
    words = [p.split() for p in sentences(text)]
    total = np.cumsum([0, *map(len, words)])
    spans = [(i, i + span) for i in range(len(words) - span + 1)]
    for k in range(1, span if long_words is not None else 1):
        spans += [(i, i + k) for i in np.flatnonzero(total[k:] - total[:-k] >= long_words).tolist()]
    if not spans:
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty((0, 2), np.int64)
    one = [blake2b(b" ".join(w), digest_size=16).digest() for w in words]
    code = b"".join([blake2b(b"".join(one[s:e]), digest_size=16).digest() for s, e in spans])
    s, e = np.array(spans, np.int32).T
    return s, e, np.frombuffer(code, np.int64).reshape(-1, 2)


def _hashed(span: int, long_words: int | None):
    def run(batches):
        for rows, texts in text_slices(batches, "_text"):
            parts = [runs(t, span, long_words) for t in texts.to_pylist()]
            offsets = pa.array(np.cumsum([0, *(len(p[0]) for p in parts)]), pa.int32())
            columns = [np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), *np.concatenate([p[2] for p in parts]).T.copy()]
            spans = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["s", "e", "h", "g"])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.ListArray.from_arrays(offsets, spans)], ["_id", "_key", "_spans"])

    return run


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``_id``, ``_key`` (128 bits of the text) and ``cut`` (numbers of sentences) for documents that lose any.

    Run hashes are counted with partial sums; only the runs whose 64 first bits repeat go on to the exact step, by a shuffle
    that adaptive execution can split at a hot run. The plan is the same at every size.
    """
    keyed = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), text_key(text_col).alias("_key"), F.col(text_col).alias("_text"))
    hashed = stage(map_arrow(keyed, _hashed(span, long_words), "_id long, _key binary, _spans array<struct<s:int,e:int,h:long,g:long>>").withColumn("_row", F.monotonically_increasing_id()), "spans")
    often = stage(hashed.select(F.explode("_spans.h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("h"), "often")
    each = hashed.select("_row", F.explode("_spans").alias("x")).select("_row", "x.*")
    repeated = stage(each.join(often, ["h"], "left_semi"), "repeated")
    rows = stage(hashed.select("_row", "_id", "_key"), "rows")
    unstage(hashed, often)
    place = F.struct(F.col("_id").isNull().alias("x"), "_id", "_key", "s")
    placed = stage(repeated.join(rows, "_row").select("h", "g", "e", "_id", "_key", "s"), "placed")
    unstage(repeated, rows)
    first = placed.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last"))
    first = stage(first.select("h", "g", "first"), "first")  # so that both sides of the join are dealt anew, and a hot run's rows are split
    later = placed.join(first, ["h", "g"]).where(place != F.col("first"))
    return later.groupBy("_id", "_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("s", F.col("e") - 1))))).alias("cut"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, long_words: int | None = LONG_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with repeated sentences cut from the text, and ``n_sentences`` and ``n_removed``."""
    cut = stage(repeated_sentences(docs, id_col, text_col, span, long_words), "cut")
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    place = names.index(text_col)
    flat = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col(f"`{id_col}`").cast("long").alias("_mine"), text_key(F.col(f"`{text_col}`")).alias("_mykey"))
    on = flat["_mine"].eqNullSafe(cut["_id"]) & (flat["_mykey"] == cut["_key"])
    joined = flat.join(cut, on, "left").drop("_mine", "_mykey", "_id", "_key")
    schema = T.StructType([*joined.schema.fields[:-1], T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches):
        for rows, texts in text_slices(batches, f"c{place}"):
            out, total, gone = [], [], []
            for text, drop in zip(texts.to_pylist(), rows.column(rows.num_columns - 1).to_pylist(), strict=True):
                pieces = sentences(text)
                drop = set(drop or ())
                out.append(text if not drop else b"".join([p for i, p in enumerate(pieces) if i not in drop]))
                total.append(len(pieces))
                gone.append(len(drop))
            columns = rows.columns[:-1]
            columns[place] = pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(rows.column(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*rows.schema.names[:-1], "n_sentences", "n_removed"])

    return map_arrow(joined, run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "n_sentences", "n_removed")
