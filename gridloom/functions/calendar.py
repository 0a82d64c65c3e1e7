"""Timestamps: parsing, steps, and calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: accepted timestamp forms, tried in order
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")
#: fixed values: seconds of each frequency
STEPS = {"H": 3600, "D": 86400, "W": 604800}


def parse_timestamp(text: Column) -> Column:
    """Naive forms as they are, a date at midnight, RFC 3339 moved to UTC; null if none fits."""
    naive = [F.try_to_timestamp(text, F.lit(f)) for f in FORMATS]
    zoned = F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))
    return F.coalesce(*naive, zoned).cast("timestamp_ntz")


def advance(ts: Column, frequency: str, steps: Column | int) -> Column:
    """ts + steps * frequency."""
    n = steps if isinstance(steps, Column) else F.lit(steps)
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * STEPS[frequency]).cast("decimal(18,6)"))


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Features by name; weekday counts from Monday as 0, cyclic ones count month and day from 0."""
    month, day, dow = F.month(ts), F.dayofmonth(ts), F.weekday(ts)
    out = {"day_of_week": dow, "month": month, "day_of_month": day, "day_of_year": F.dayofyear(ts), "hour": F.hour(ts)}
    for name, value, period in (("day_of_week", dow, 7), ("month", month - 1, 12), ("day_of_month", day - 1, 31)):
        out[f"{name}_sin"] = F.sin(value * (2 * math.pi / period))
        out[f"{name}_cos"] = F.cos(value * (2 * math.pi / period))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    out |= {"is_weekend": flag(dow >= 5), "is_month_start": flag(day <= 3), "is_month_middle": flag((day >= 14) & (day <= 16)), "is_month_end": flag(day >= F.dayofmonth(F.last_day(ts)) - 2)}
    return out
