"""Regular panels (series_id, ts, y) from event tables: roles, duplicates, gaps, frequency, diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.calendar import STEPS, parse_timestamp
from gridloom.functions.predicates import finite

SERIES = ("series_id", "ts")


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of a panel."""

    timestamp: str
    target: str
    series: str | None = None
    frequency: str | None = None
    weight: str | None = None
    static: tuple[str, ...] = ()
    known_future: tuple[str, ...] = ()
    historical: tuple[str, ...] = ()
    single_series: str = "__single__"

    @property
    def covariates(self) -> tuple[str, ...]:
        return (*self.static, *self.known_future, *self.historical)


@dataclass(frozen=True)
class Panel:
    """A validated panel and its spec; ``data`` has series_id, ts, y, the covariates and, if there are any, the weight."""

    data: DataFrame
    spec: PanelSpec = field(repr=False)


def make_panel(frame: DataFrame, spec: PanelSpec, check: bool = True) -> Panel:
    """Roles to canonical names, text timestamps parsed, duplicates collapsed by weight; with ``check`` bad rows are an error."""
    missing = [c for c in (spec.timestamp, spec.target, spec.series, spec.weight, *spec.covariates) if c and c not in frame.columns]
    if missing:
        raise ValueError(f"columns not in the frame: {missing}")
    kind = dict(frame.dtypes)[spec.timestamp]
    ts = parse_timestamp(F.col(spec.timestamp)) if kind == "string" else F.col(spec.timestamp).cast("timestamp_ntz")
    series = F.col(spec.series).cast("string") if spec.series else F.lit(spec.single_series)
    rows = frame.select(series.alias("series_id"), ts.alias("ts"), F.col(spec.target).cast("double").alias("y"), *spec.covariates, *([spec.weight] if spec.weight else []))
    if check:
        good = F.col("series_id").isNotNull() & F.col("ts").isNotNull() & finite(F.col("y"))
        rows = rows.where(F.when(good, True).otherwise(F.raise_error(F.lit("a panel row needs a series, a timestamp and a finite target"))))
    if spec.weight:
        rows = collapse_duplicates(rows, spec.weight, spec.covariates)
    return Panel(rows, spec)


def collapse_duplicates(rows: DataFrame, weight: str, covariates: Sequence[str] = ()) -> DataFrame:
    """One row a (series, ts): weighted means of target and covariates, the weights summed. Weights must be positive."""
    w = F.col(weight).cast("double")
    mean = lambda c: (F.sum(w * F.col(c)) / F.sum(w)).alias(c)
    good = F.when(finite(w) & (w > 0), True).otherwise(F.raise_error(F.lit("weights must be finite and above zero")))
    return rows.where(good).groupBy(*SERIES).agg(mean("y"), *map(mean, covariates), F.sum(w).alias(weight))


def bucketed(events: DataFrame, ts: str, series: str, value: Column, frequency: str = "D") -> DataFrame:
    """Events summed into a panel by steps of the frequency (weeks from Monday)."""
    unit = {"H": "hour", "D": "day", "W": "week"}[frequency]
    step = F.date_trunc(unit, F.col(ts).cast("timestamp")).cast("timestamp_ntz")
    return events.groupBy(F.col(series).cast("string").alias("series_id"), step.alias("ts")).agg(F.sum(value).alias("y"), F.count(F.lit(1)).alias("n"))


def fill_gaps(panel: DataFrame, frequency: str = "D", value: float = 0.0, whole_span: bool = False) -> DataFrame:
    """Every step between a series' first and last row (or the panel's), missing targets set to ``value``."""
    span = panel.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    if whole_span:
        ends = panel.agg(F.min("ts"), F.max("ts")).first()
        span = span.withColumn("a", F.lit(ends[0])).withColumn("b", F.lit(ends[1]))
    step = F.expr(f"interval {STEPS[frequency]} seconds")
    spine = span.select("series_id", F.explode(F.sequence(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"), step)).alias("ts")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rest = [c for c in panel.columns if c not in (*SERIES, "y")]
    return spine.join(panel, list(SERIES), "left").select(*SERIES, F.coalesce("y", F.lit(value)).alias("y"), *rest)


def step_gaps(panel: DataFrame) -> DataFrame:
    """Seconds from each row to the one before in its series."""
    before = F.lag("ts").over(Window.partitionBy("series_id").orderBy("ts"))
    return panel.withColumn("gap_s", F.col("ts").cast("timestamp").cast("long") - before.cast("timestamp").cast("long"))


def regularity(panel: DataFrame, frequency: str) -> DataFrame:
    """By series: rows, duplicates (gap 0) and irregular steps."""
    gap = F.col("gap_s")
    return step_gaps(panel).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(gap == 0).alias("duplicates"), F.count_if((gap != 0) & (gap != STEPS[frequency])).alias("irregular"))


def infer_frequency(panel: DataFrame) -> str | None:
    """The frequency whose step is every gap of the panel; None if there is none."""
    row = step_gaps(panel).agg(F.min("gap_s"), F.max("gap_s")).first()
    return next((f for f, s in STEPS.items() if row[0] == row[1] == s), None)


def diagnostics(panel: DataFrame) -> DataFrame:
    """By series: size, range, mean, zeros, mean interval between non-zeros and the longest run of zeros.

    Runs are islands of equal (row number - row number among zeros); two windows over one partitioning, so one shuffle.
    """
    order = Window.partitionBy("series_id").orderBy("ts")
    zero = (F.col("y") == 0).cast("int")
    rows = panel.withColumn("_z", zero).withColumn("_nz", F.sum(1 - F.col("_z")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("series_id", "_nz")
    rows = rows.withColumn("_run", F.sum("_z").over(run))
    n, zeros = F.count(F.lit(1)), F.sum("_z")
    return rows.groupBy("series_id").agg(
        n.alias("n"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.avg("y").alias("mean_y"), zeros.alias("zero_count"), (zeros / n).alias("zero_fraction"),
        F.when(n > zeros, n / (n - zeros)).alias("mean_interval"), F.max("_run").alias("longest_zero_run"),
    )


def temporal_blocks(panel: DataFrame, size: int) -> DataFrame:
    """Sums over blocks of ``size`` consecutive rows of each series; a length that isn't a multiple is an error."""
    order = Window.partitionBy("series_id").orderBy("ts")
    rows = panel.withColumn("block", F.floor((F.row_number().over(order) - 1) / size))
    out = rows.groupBy("series_id", "block").agg(F.min("ts").alias("ts"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.when(F.col("_n") == size, True).otherwise(F.raise_error(F.lit("a series' length isn't a multiple of the block")))).drop("_n")


def known_future(panel: DataFrame, future: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Future rows (series_id, ts) with their given covariates, the last known value of the series where one is missing."""
    past = panel.select(*SERIES, *covariates, F.lit(False).alias("_f"))
    rows = past.unionByName(future.select(*SERIES, *covariates, F.lit(True).alias("_f")))
    before = Window.partitionBy("series_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.select(*SERIES, "_f", *(F.last(c, ignorenulls=True).over(before).alias(c) for c in covariates))
    return filled.where("_f").drop("_f")


def as_of(left: DataFrame, right: DataFrame, value: str, strict: bool = True) -> DataFrame:
    """Each left row (series_id, ts) with the last ``value`` of the right rows before it (or at it, if not strict).

    One union and one window: linear in the rows, without a range join.
    """
    both = left.withColumn("_v", F.lit(None).cast("double")).withColumn("_side", F.lit(0 if strict else 1)).unionByName(right.select(*SERIES, F.col(value).cast("double").alias("_v"), F.lit(1 if strict else 0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy("series_id").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where(F.col("_side") == (0 if strict else 1)).drop("_v", "_side")
