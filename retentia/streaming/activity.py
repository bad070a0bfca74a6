"""Recent activity as a streaming mart: the E14 card at every minute.

The batch card reads the last hour each time it is polled. The stream keeps
sliding windows of 15 minutes, a new one each minute, in two levels of state:
events per (window, user), then users and events per window. A row is written
once the watermark passes the window's end and holds what the card said at
that minute. The hour's events are the sum of four rows a quarter of an hour
apart, so there is no state for the longer window.

Scale: an event counts in 15 windows, but tasks combine their events by
(window, user) before the shuffle, so the anonymous user, however large, sends
one row a task and window. State spans ``delay`` + 15 minutes.

Defined cases: events without time are dropped; without user they count as the
user ''; copies of an event count once; events behind the watermark do not
count; minutes without events in the quarter have no row and read as zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import ts_lit

QUARTERS = 4  # of the hour that the card also reports


def activity_windows(ev: DataFrame, delay: str = "2 minutes", key: tuple[str, ...] = ("ts", "event_name", "event_id")) -> DataFrame:
    """Streaming event facts (ts, u and ``key``) → minute, day, events_15m, users_15m, in append mode."""
    once = ev.where("ts IS NOT NULL").withColumn("u", F.coalesce("u", F.lit(""))).withWatermark("ts", delay).dropDuplicates(list(key))
    per_user = once.groupBy(F.window("ts", "15 minutes", "1 minute").alias("w"), "u").agg(F.count(F.lit(1)).alias("n"))
    windows = per_user.groupBy("w").agg(F.sum("n").alias("events_15m"), F.count(F.lit(1)).alias("users_15m"))
    return windows.select(F.col("w.end").alias("minute"), F.to_date("w.end").alias("day"), "events_15m", "users_15m")


def activity(mart: DataFrame) -> DataFrame:
    """minute, events_15m, events_60m, users_15m up to the newest minute of the mart; minutes of a silent hour are absent."""
    later = F.expr(f"transform(sequence(0, {QUARTERS - 1}), i -> struct(i, minute + make_dt_interval(0, 0, 15 * i) AS at))")
    rows = mart.select(F.explode(later).alias("q"), "events_15m", "users_15m")
    newest = mart.agg(F.max("minute").alias("m")).scalar()
    now = lambda c: F.sum(F.when(F.col("q.i") == 0, F.col(c)).otherwise(0)).alias(c)
    return (
        rows.where(F.col("q.at") <= newest)
        .groupBy(F.col("q.at").alias("minute"))
        .agg(now("events_15m"), F.sum("events_15m").alias("events_60m"), now("users_15m"))
    )


def activity_at(mart: DataFrame, as_of) -> DataFrame:
    """The card at the whole minute of ``as_of``, from at most four rows; zeros where there are none."""
    at = F.date_trunc("MINUTE", ts_lit(as_of))
    quarter = lambda i: at - F.expr(f"make_dt_interval(0, 0, {15 * i})")
    rows = mart.where(F.col("minute").isin(*[quarter(i) for i in range(QUARTERS)]) & F.col("day").between(F.to_date(quarter(QUARTERS - 1)), F.to_date(at)))
    now = lambda c: F.coalesce(F.sum(F.when(F.col("minute") == at, F.col(c))), F.lit(0)).alias(c)
    return rows.agg(now("events_15m"), F.coalesce(F.sum("events_15m"), F.lit(0)).alias("events_60m"), now("users_15m"))
