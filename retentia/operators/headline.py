"""The three headline numbers over the sessions table. Each carries its sample
size ``n`` and a ``trusted`` flag (n ≥ the small-sample threshold)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import ts_lit
from ..functions.timefn import minus_seconds, ratio
from ..model import ENGAGED_MIN_USER_TURNS, SECOND_MESSAGE_DAYS, SMALL_SAMPLE_THRESHOLD

_DAY = 86400


def _trusted(n: str, threshold: int):
    return (F.col(n) >= threshold).alias("trusted")


def engaged_sessions_today(
    sessions: DataFrame,
    as_of=None,
    min_turns: int = ENGAGED_MIN_USER_TURNS,
    threshold: int = SMALL_SAMPLE_THRESHOLD,
) -> DataFrame:
    """Engaged sessions that started on the UTC calendar day of ``as_of``."""
    day = F.date_trunc("day", ts_lit(as_of))
    out = sessions.where(
        (F.col("user_turns") >= min_turns)
        & (F.col("started_at") >= day)
        & (F.col("started_at") < minus_seconds(day, -_DAY))
    ).agg(F.count(F.lit(1)).alias("count"))
    return out.select("count", F.col("count").alias("n"), _trusted("count", threshold))


def second_message_rate(
    sessions: DataFrame,
    as_of=None,
    days: int = SECOND_MESSAGE_DAYS,
    threshold: int = SMALL_SAMPLE_THRESHOLD,
) -> DataFrame:
    """Of first sittings (session_index = 1) started in the last ``days`` days
    (no upper bound), the share with at least two user messages. Counted per
    conversation."""
    out = sessions.where(
        (F.col("session_index") == 1) & (F.col("started_at") >= minus_seconds(ts_lit(as_of), days * _DAY))
    ).agg(
        F.count_if(F.col("user_turns") >= 2).alias("numerator"),
        F.count(F.lit(1)).alias("n"),
    )
    return out.select(ratio(F.col("numerator"), F.col("n")).alias("rate"), "numerator", "n", _trusted("n", threshold))


def w1_return_rate(
    sessions: DataFrame,
    as_of=None,
    min_turns: int = ENGAGED_MIN_USER_TURNS,
    threshold: int = SMALL_SAMPLE_THRESHOLD,
) -> DataFrame:
    """Of users whose first engaged session is 7–21 days before ``as_of``, the
    share with another engaged session in (first, first + 7 days]."""
    now = ts_lit(as_of)
    engaged = sessions.where(F.col("user_turns") >= min_turns).select("user_id", "started_at")
    cohort = (
        engaged.groupBy("user_id")
        .agg(F.min("started_at").alias("first_at"))
        .where((F.col("first_at") < minus_seconds(now, 7 * _DAY)) & (F.col("first_at") >= minus_seconds(now, 21 * _DAY)))
    )
    # Session rows stay on the left: an inner join lets AQE split a user with
    # a huge share of the sessions (a semi join could only split the cohort
    # side). The cohort has one row per user, so no row is multiplied, and the
    # distinct is combined map-side.
    c = cohort.withColumnRenamed("user_id", "_u")
    returned = (
        engaged.join(
            c,
            (engaged.user_id == c._u)
            & (engaged.started_at > c.first_at)
            & (engaged.started_at <= minus_seconds(c.first_at, -7 * _DAY)),
        )
        .select("user_id")
        .distinct()
    )
    # one pass over both sets instead of two scalar subqueries
    counts = cohort.select(F.lit(1).alias("c"), F.lit(0).alias("r")).unionByName(
        returned.select(F.lit(0).alias("c"), F.lit(1).alias("r"))
    ).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("returned"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    return counts.select(
        ratio(F.col("returned"), F.col("n")).alias("rate"),
        F.col("returned").cast("long").alias("returned"),
        F.col("n").cast("long").alias("n"),
        _trusted("n", threshold),
    )
