"""Small column helpers: Monday weeks, UTC days, hour boundaries, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monday(ts_or_date: Column) -> Column:
    """Monday of the (UTC) week, as DATE."""
    return F.to_date(F.date_trunc("week", ts_or_date))


def weeks_between(later_monday: Column, earlier_monday: Column) -> Column:
    """Whole weeks between two Mondays (exact: a multiple of 7 days)."""
    return (F.datediff(later_monday, earlier_monday) / 7).cast("int")


def hour_boundaries(start: Column, end: Column) -> Column:
    """Hour boundaries crossed from ``start`` to ``end`` (00:59 -> 01:01 is 1)."""
    return F.timestamp_diff("HOUR", F.date_trunc("HOUR", start), F.date_trunc("HOUR", end))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL when den = 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct_half_even(num: Column, den: Column) -> Column:
    """round(100 * num / den) with ties to even; 0 when den = 0."""
    return F.when(den == 0, F.lit(0)).otherwise(F.bround(F.lit(100.0) * num / den, 0).cast("int"))


def minus_seconds(ts: Column, seconds: int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) - int(seconds) * 1_000_000)


def floor_div(col: Column, width: int) -> Column:
    """Exact integer floor(col / width) for a bigint column (also below zero)."""
    w = F.lit(int(width)).cast("long")
    return ((col - F.pmod(col, w)) / w).cast("long")


def sorted_small(df: DataFrame, *order) -> DataFrame:
    """Total order for a result whose size is bounded by a parameter (days in
    a window, cohort weeks, depth buckets): one partition and a local sort,
    instead of a sampled range-partitioning shuffle."""
    return df.coalesce(1).sortWithinPartitions(*order)
