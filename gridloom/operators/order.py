"""Places and running sums over a whole table, without a window that holds it.

Rows are dealt by ranges of the order and sorted in their part; a row's place is its place in the part plus the rows of the
parts before, and sums alike. The table of parts has a row a partition, whatever the number of rows, so it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import staged


def running(rows: DataFrame, by: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums of all rows up to and including each, in the order ``by`` (which must tell all rows apart)."""
    flat = rows.select("*", *(c.alias(f"_own_{n}") for n, c in sums.items()))
    parts = staged(flat.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "running")
    parts = parts.withColumn("_part", F.shiftright("_at", 33))
    here = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    totals = parts.groupBy("_part").agg(*(F.sum(f"_own_{n}").alias(n) for n in sums))
    before = totals.select("_part", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums))
    summed = parts.withColumns({f"_here_{n}": F.sum(f"_own_{n}").over(here) for n in sums}).join(F.broadcast(before), "_part")
    return summed.select(*rows.columns, *((F.col(f"_before_{n}") + F.col(f"_here_{n}")).alias(n) for n in sums))


def placed(rows: DataFrame, by: Sequence[Column | str], out: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in the order ``by``."""
    parts = staged(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "placed")
    parts = parts.withColumn("_part", F.shiftright("_at", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    before = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    found = parts.join(F.broadcast(before), "_part")
    return found.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(out))
