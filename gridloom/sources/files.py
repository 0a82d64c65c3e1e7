"""Readers and writers: delimited text, GeoJSON, wide and colon-separated series files, forecasts, models, embeddings."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.calendar import parse_timestamp
from gridloom.functions.predicates import finite


def read_numeric_csv(spark: SparkSession, path: str, columns: Sequence[str], target: str) -> DataFrame:
    """A delimited file with header whose columns all parse as numbers; a bad or blank cell fails the read."""
    if target not in columns:
        raise ValueError(f"no target column {target}")
    raw = spark.read.option("header", True).option("mode", "FAILFAST").schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return raw.select(*(F.when(F.trim(c) == "", F.raise_error(F.lit(f"blank cell in {c}")).cast("double")).otherwise(F.col(c).cast("double")).alias(c) for c in columns))


def read_series_csv(spark: SparkSession, path: str, timestamp: str, target: str, series: str | None = None) -> DataFrame:
    """series_id, ts, y of a delimited file."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select((F.col(series) if series else F.lit("__single__")).alias("series_id"), parse_timestamp(F.col(timestamp)).alias("ts"), F.col(target).cast("double").alias("y"))


def read_geojson(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """id, ord (order in the file), properties, kind and coordinates (variant) of each feature; ``geometry`` is the key that
    holds a feature's shape."""
    shape = f"struct<features:array<struct<id:string,properties:map<string,string>,`{geometry}`:struct<type:string,coordinates:variant>>>>"
    text = spark.read.option("wholetext", True).text(path)
    each = text.select(F.posexplode(F.from_json("value", shape)["features"]).alias("ord", "f"))
    return each.select("f.id", "ord", "f.properties", F.col("f")[geometry]["type"].alias("kind"), F.col("f")[geometry]["coordinates"].alias("coordinates"))


def geo_points(features: DataFrame, numbers: Sequence[str] = ()) -> DataFrame:
    """id, x, y and the named properties as doubles, of point features."""
    xy = F.try_variant_get("coordinates", "$", "array<double>")
    return features.where(F.col("kind") == "Point").select("id", F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y"), *(F.col("properties")[n].cast("double").alias(n) for n in numbers))


def geo_zones(features: DataFrame) -> DataFrame:
    """id, ord, priority (1 by default) and the outer ring of polygon features."""
    ring = F.transform(F.get(F.try_variant_get("coordinates", "$", "array<array<array<double>>>"), F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return features.where(F.col("kind") == "Polygon").select("id", "ord", F.coalesce(F.col("properties")["priority"].cast("double"), F.lit(1.0)).alias("priority"), ring.alias("ring"))


def read_tsf(spark: SparkSession, path: str) -> DataFrame:
    """series_id, attributes, step (from 0) and y of a colon-separated series file; directives start with # or @."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").rlike(r"^\s*[#@]"))
    parts = F.split("value", ":")
    n = F.size(parts)
    rows = lines.select(F.get(parts, F.lit(0)).alias("series_id"), F.slice(parts, 2, F.greatest(n - 2, F.lit(0))).alias("attributes"), F.posexplode(F.split(F.element_at(parts, -1), ",")).alias("step", "v"))
    return rows.select("series_id", "attributes", "step", F.expr("try_cast(trim(v) as double)").alias("y"))


def unpivot_days(sales: DataFrame, keys: Sequence[str], prefix: str = "d_") -> DataFrame:
    """Wide day columns to rows: keys, d, y."""
    days = [c for c in sales.columns if c.startswith(prefix)]
    return sales.unpivot(list(keys), days, "d", "y")


def sales_panel(sales: DataFrame, calendar: DataFrame, prices: DataFrame, keys: Sequence[str] = ("item_id", "store_id")) -> DataFrame:
    """Unpivoted sales with the calendar's date and week and the week's price: three equi-joins."""
    long = unpivot_days(sales, keys).join(calendar.select("d", "date", "week"), "d")
    return long.join(prices, [*keys, "week"], "left").select(*keys, F.col("date").alias("ts"), F.col("y").cast("double").alias("y"), "price")


def top_groups_panel(trips: DataFrame, group: Sequence[str], ts: str, top: int) -> DataFrame:
    """Daily counts of the most frequent groups over the full calendar, 0 where there are none (a top-k report)."""
    day = F.to_date(ts)
    sizes = trips.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *group).limit(top).drop("n")
    rows = trips.join(F.broadcast(sizes), list(group))  # ``top`` rows
    counts = rows.groupBy(*group, day.alias("ts")).agg(F.count(F.lit(1)).alias("y"))
    ends = rows.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    spine = sizes.join(ends).select(*group, F.explode(F.sequence("a", "b")).alias("ts"))
    return spine.join(counts, [*group, "ts"], "left").select(*group, "ts", F.coalesce("y", F.lit(0)).alias("y"))


def return_panel(prices: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Daily returns over each symbol's calendar days, prices carried forward over gaps; the first day drops out."""
    span = prices.groupBy(symbol).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    spine = span.select(symbol, F.explode(F.sequence("a", "b")).alias("ts"))
    w = Window.partitionBy(symbol).orderBy("ts")
    filled = spine.join(prices, [symbol, "ts"], "left").withColumn("price", F.last("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn("y", F.col("price") / F.lag("price").over(w) - 1).where(F.col("y").isNotNull()).select(symbol, "ts", "y")


def clean_ranges(rows: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows whose columns lie in closed ranges; plain comparisons, which reach the scan."""
    out = rows
    for c, (lo, hi) in ranges.items():
        out = out.where((F.col(c) >= lo) & (F.col(c) <= hi))
    return out


def seeded_sample(rows: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows without replacement by a hash of the keys: the same in any partitioning (a sampling operator)."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def write_forecast(forecast: DataFrame, path: str, manifest: dict, kind: str = "parquet") -> None:
    """A folder with ``forecast`` in the kind's format and ``manifest`` as one JSON line; counts and models go into it."""
    if kind not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown kind {kind}")
    if ".." in PurePosixPath(path).parts:
        raise ValueError("a path must not climb")
    row = forecast.agg(F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set("model")).alias("models")).first()
    writer = forecast.write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else getattr(writer, kind))(f"{path}/forecast")
    text = json.dumps({"version": 1, "kind": kind, "rows": row["rows"], "models": row["models"], **manifest}, sort_keys=True)
    forecast.sparkSession.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_forecast(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The forecast and its manifest; a row count that differs is an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    schema = "series_id string, ts timestamp_ntz, horizon int, model string, mean double"
    reader = spark.read
    where = f"{path}/forecast"
    df = reader.parquet(where) if manifest["kind"] == "parquet" else reader.schema(schema).json(where) if manifest["kind"] == "json" else reader.schema(schema).option("header", True).csv(where)
    if df.count() != manifest["rows"]:
        raise ValueError("forecast and manifest disagree")
    return df, manifest


def write_embeddings(table: DataFrame, path: str, fallback: str = "zero") -> None:
    """id and vec as parquet with a checksum of the rows."""
    check = table.agg(F.sum(F.xxhash64("id", "vec").cast("decimal(38,0)"))).first()[0]
    table.write.mode("overwrite").parquet(f"{path}/table")
    table.sparkSession.range(1).select(F.lit(json.dumps({"fallback": fallback, "checksum": str(check)})).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_embeddings(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    table = spark.read.parquet(f"{path}/table")
    if str(table.agg(F.sum(F.xxhash64("id", "vec").cast("decimal(38,0)"))).first()[0]) != meta["checksum"]:
        raise ValueError("the embedding table doesn't match its checksum")
    return table, meta


@dataclass(frozen=True)
class ForecastConfig:
    """Models and folds of a forecasting run, from TOML or JSON text."""

    horizon: int
    frequency: str = "D"
    season: int = 7
    models: tuple[str, ...] = ("seasonal_naive",)
    folds: int = 3
    step: int = 7
    min_train: int = 14
    reconciliation: str | None = None
    extra: dict = field(default_factory=dict)

    @staticmethod
    def parse(text: str) -> ForecastConfig:
        raw = json.loads(text) if text.lstrip().startswith("{") else tomllib.loads(text)
        known = {k: tuple(v) if k == "models" else v for k, v in raw.items() if k in ForecastConfig.__dataclass_fields__}
        config = ForecastConfig(**known, extra={k: v for k, v in raw.items() if k not in ForecastConfig.__dataclass_fields__})
        if config.horizon < 1 or config.folds < 1 or config.step < 1:
            raise ValueError("horizon, folds and step must be positive")
        return config


def feature_matrix(rows: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """The columns as one dense array of doubles."""
    return rows.withColumn(out, F.array(*(F.col(c).cast("double") for c in columns)))


def finite_numbers(column: Column) -> Column:
    """The column as a double; anything that isn't a finite number is an error."""
    v = column.cast("double")
    return F.when(finite(v), v).otherwise(F.raise_error(F.lit("not a finite number")).cast("double"))
