"""Helpers the text operators share: staged tables in the cluster's folder, size-checked joins, Arrow slices, hashing."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import reachable

#: Rows of a side that may be broadcast: narrow rows (ids and a few numbers), so at most some 30 MB.
BROADCAST_ROWS = 400_000
#: Rows of an Arrow batch: some 3 MB of ordinary documents, so that a batch with long texts, and its copies in the JVM and in
#: Python, stay small too. Spark's own default is ten times as many.
BATCH_ROWS = 1000
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: Bytes of text that one slice of an Arrow batch holds; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where ``spark.checkpoint.dir`` is unset: a folder under /tmp if all runs in
    this process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/gridloom-{spark.sparkContext.applicationId}"


def _path_of(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration())


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, computes it once, survives lost executors.

    The folder of the application is deleted when the driver ends; ``unstage`` deletes a table earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if getattr(spark.sparkContext, "_gridloom_folder", None) != shared_dir(spark):
        at, files = _path_of(spark, shared_dir(spark))
        files.deleteOnExit(at)
        spark.sparkContext._gridloom_folder = shared_dir(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that only later staged ones were made from, to free the shared folder early."""
    for table in tables:
        at, files = _path_of(table.sparkSession, table.staged_path)
        files.delete(at, True)


def _returned(run: Callable) -> Callable:
    """``run``, giving memory that is free again back to the system when a partition ends: workers live on between stages."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the driver's copy lies, if it isn't installed for them.

    A session that still has Spark's default number of rows in an Arrow batch gets BATCH_ROWS: plans read the setting when they
    run, so it must stay. A session with another number keeps it.
    """
    reachable(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(_returned(run), schema)


def sized_join(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str) -> DataFrame:
    """Join a wide table with a staged narrow one: by broadcast when it is counted to be small, else by shuffle.

    Small is at most BROADCAST_ROWS rows of a few fixed-size values.
    """
    return left.join(F.broadcast(right) if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else right, on, how)


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named c0, c1, ..., so that no name clashes with helper columns, and the new names."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def unshielded(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``shielded`` under their own names."""
    return df.select(*(F.col(n).alias(c) for c, n in names.items()))


def text_key(text: Column | str) -> Column:
    """128 bits that stand for a text; null for a null text."""
    return F.unhex(F.md5(F.col(text) if isinstance(text, str) else text))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut batches so that a slice holds about SLICE_BYTES of text; gives the slice and its texts as binary."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset))
        block = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a), texts.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


with np.errstate(over="ignore"):
    #: A random word for each byte value, and the powers that weigh a byte's place in its word.
    _BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    _POWER = np.cumprod(np.full(1 << 16, 0xD6E8FEB86659FD93, _U))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the number of the text each stands in."""
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    if off[-1] == off[0]:
        return np.empty(0, _U), np.empty(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, off[-1] - off[0], off[0])
    off = off - off[0]
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = off[off < len(data)]
    first[edges] = solid[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, _U), np.empty(0, np.int64)
    letters = np.flatnonzero(solid)
    begins = np.searchsorted(letters, starts)
    sizes = np.diff(np.r_[begins, len(letters)])
    place = np.arange(len(letters)) - np.repeat(begins, sizes)
    value = _BYTE[data[letters]] * _POWER[place & 0xFFFF]
    return mix64(np.add.reduceat(value, begins) + sizes.astype(_U)), np.searchsorted(off, starts, "right") - 1
