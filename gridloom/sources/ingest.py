"""Frames of other libraries as DataFrames, and the schema of features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_frame(spark: SparkSession, values: Any, names: Sequence[str] | None = None) -> DataFrame:
    """A Spark frame as it is; Arrow tables, relations and frames that can become one; pandas; mappings of columns; 2-D rows."""
    import pandas as pd
    import pyarrow as pa

    if isinstance(values, DataFrame):
        return values
    for method in ("to_arrow_table", "to_arrow", "fetch_arrow_table"):
        if not isinstance(values, pa.Table | pd.DataFrame) and callable(getattr(values, method, None)):
            values = getattr(values, method)()
            break
    if isinstance(values, pa.RecordBatchReader):
        values = values.read_all()
    if isinstance(values, pa.Table | pd.DataFrame):
        return spark.createDataFrame(values)
    if isinstance(values, dict):
        return spark.createDataFrame(pa.table({k: pa.array(list(v)) for k, v in values.items()}))
    if hasattr(values, "to_numpy"):
        values = values.to_numpy()
    rows = [[float(x) for x in r] for r in values]
    width = len(rows[0]) if rows else len(names or ())
    if any(len(r) != width for r in rows):
        raise ValueError("rows differ in length")
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in (names or [f"f{i}" for i in range(width)])))


KINDS = ("numeric", "categorical", "ordinal", "periodic", "spatial", "set")


@dataclass(frozen=True)
class FeatureSchema:
    """Names and kinds of features; periods of the periodic ones."""

    names: tuple[str, ...]
    kinds: tuple[str, ...]
    periods: tuple[tuple[str, float], ...] = ()

    def check(self, frame: DataFrame | None = None) -> FeatureSchema:
        if len(self.names) != len(self.kinds) or len(set(self.names)) != len(self.names) or any(not n.strip() for n in self.names):
            raise ValueError("features need unique, non-blank names and a kind each")
        if bad := [k for k in self.kinds if k not in KINDS]:
            raise ValueError(f"unknown kinds: {bad}")
        periods = dict(self.periods)
        if bad := [n for n, k in zip(self.names, self.kinds, strict=True) if k == "periodic" and periods.get(n, 0) <= 0]:
            raise ValueError(f"periods must be above zero: {bad}")
        if frame is not None and (gone := [n for n in self.names if n not in frame.columns]):
            raise ValueError(f"columns not in the frame: {gone}")
        return self


def check_weights(rows: DataFrame, weight: str | None) -> DataFrame:
    """The rows with ``weight`` (1 where no column is named); negative or non-finite weights are an error."""
    if weight is None:
        return rows.withColumn("weight", F.lit(1.0))
    w = F.col(weight).cast("double")
    bad = w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))
    return rows.withColumn("weight", F.when(bad, F.raise_error(F.lit("weights must be finite and not negative")).cast("double")).otherwise(w))
