"""What the registered queries share: tables, derived panels, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.panel import bucketed, fill_gaps
from gridloom.session import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL if there is any."""

    def put(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reachable(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """All double columns rounded, for comparison with another engine's sums."""
    return df.select(*(F.round(F.col(c), n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular panel: events by type and day."""
    return bucketed(table(spark, sf_dir, "events"), "ts", "event_type", F.col("value"))


DAILY = "daily as (select event_type as series_id, date_trunc('day', ts)::timestamp as ts, sum(value) as y, count(*) as n from events group by all)"


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with gaps: orders by priority and day."""
    return bucketed(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority", F.col("o_totalprice"))


ORDER_DAYS = "order_days as (select o_orderpriority as series_id, date_trunc('day', o_orderdate)::timestamp as ts, sum(o_totalprice) as y, count(*) as n from orders group by all)"


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intermittent weekly demand: returned quantity by supplier, weeks without any as 0."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return fill_gaps(bucketed(rows, "l_shipdate", "l_suppkey", F.col("l_quantity"), "W").select("series_id", "ts", "y"), "W")


SUPPLIER_WEEKS = """w0 as (select l_suppkey::varchar as series_id, date_trunc('week', l_shipdate)::timestamp as ts, sum(l_quantity) as y from lineitem where l_returnflag = 'R' group by all),
weeks as (select s.series_id, s.ts, coalesce(w0.y, 0) as y from (select series_id, unnest(generate_series(min(ts), max(ts), interval 7 day)) as ts from w0 group by series_id) s left join w0 on w0.series_id = s.series_id and w0.ts = s.ts)"""


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers on a derived grid: x = key mod 10, y = key div 10."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10).cast("double").alias("x"), F.floor(F.col("s_suppkey") / 10).cast("double").alias("y"), F.col("s_acctbal").alias("value"))


POINTS = "points as (select s_suppkey as id, (s_suppkey % 10)::double as x, (s_suppkey // 10)::double as y, s_acctbal as value from supplier)"


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary labels with a score and a probability from the text's length."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), "lang", F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("score"), (F.col("n_chars") / (F.col("n_chars") + 500.0)).alias("p"))


LABELLED = "labelled as (select l.doc_id as id, d.lang, l.quality as y, d.n_chars::double as score, d.n_chars / (d.n_chars + 500.0::double) as p from labels l join documents d on d.doc_id = l.doc_id)"


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed weighted edges supplier -> part (part numbers behind the suppliers')."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).agg(F.sum("l_quantity").alias("weight"), F.unix_micros(F.min("l_shipdate").cast("timestamp")).cast("double").alias("t")).select("src", "dst", "weight", (F.col("t") / 1e6).alias("ts"))


PART_EDGES = "edges as (select l_suppkey as src, l_partkey + 1000000 as dst, sum(l_quantity) as weight, epoch(min(l_shipdate)) as ts from lineitem group by all)"
