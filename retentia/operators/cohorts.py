"""Weekly cohort retention, over sessions (A) and over raw events (B), and the
grids the dashboards draw from them.

Long form: (cohort_week, cohort_size, week_offset, active_users), ordered by
cohort_week desc, week_offset asc.

One aggregate per user gives the first time and the active weeks as bits of a
few longs (map-side combined by ``bit_or``). Users that share a cohort and a
mask are then counted together, so what follows is as small as the number of
different masks: bits are read off and counted, with no join of users to their
activity and no second pass over the input.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import ts_lit
from ..functions.timefn import minus_seconds, monday, pct_half_even, sorted_small, weeks_between
from ..model import (
    ENGAGED_MIN_USER_TURNS,
    EVENT_COHORT_WEEKS,
    GRID_MAX_COLUMN,
    SESSION_COHORT_WEEKS,
    SMALL_SAMPLE_THRESHOLD,
)


#: Weeks that one long holds, and weeks past today that are still counted (clocks run ahead).
WORD = 64
AHEAD_WEEKS = 52


def _words(as_of, weeks: int) -> int:
    """Longs for the weeks from the oldest cohort to ``AHEAD_WEEKS`` from today."""
    if as_of is None:
        behind = 0
    elif isinstance(as_of, Column):
        behind = 10 * 53
    else:
        day = as_of if isinstance(as_of, dt.date) else dt.datetime.fromisoformat(str(as_of))
        behind = max(0, (dt.date.today() - (day.date() if isinstance(day, dt.datetime) else day)).days // 7 + 1)
    return -(-(weeks + 1 + behind + AHEAD_WEEKS) // WORD)


def cohort_table(rows: DataFrame, user: str, day: Column, first: Column, floor: Column, words: int) -> DataFrame:
    """Cells of the cohorts whose week is ``floor`` (a Monday) or later.

    A user's cohort is the week of the least ``first``, activity any ``day``.
    Weeks count from the floor; a user whose first lies before it is in no cohort.
    """
    week = F.floor(F.datediff(day, floor) / 7).cast("int")
    masks = [F.expr(f"bit_or(CASE WHEN _week div {WORD} = {w} AND _week >= 0 THEN shiftleft(1L, cast(_week % {WORD} AS int)) ELSE 0L END) AS _m{w}") for w in range(words)]
    users = rows.select(F.col(user).alias("_user"), first.alias("_first"), week.alias("_week")).groupBy("_user").agg(F.min("_first").alias("_first"), *masks)
    cohort = F.floor(F.datediff(monday(F.col("_first")), floor) / 7).cast("int")
    groups = users.select(cohort.alias("_cohort"), *[f"_m{w}" for w in range(words)]).where("_cohort >= 0")
    groups = groups.groupBy(*groups.columns).agg(F.count(F.lit(1)).alias("_n"))
    active = F.expr("concat(" + ", ".join(
        f"filter(transform(sequence(0, {WORD - 1}), b -> CASE WHEN shiftright(_m{w}, b) & 1 = 1 THEN b + {w * WORD} END), b -> b >= _cohort)" for w in range(words)) + ")")
    cells = groups.select("_cohort", "_n", F.explode(active).alias("_week")).groupBy("_cohort", (F.col("_week") - F.col("_cohort")).alias("week_offset")).agg(
        F.sum("_n").alias("active_users"))
    # Every user is active in the week of the first time, so offset 0 is the cohort's size. At most (weeks + 1) cohorts.
    size = F.max(F.when(F.col("week_offset") == 0, F.col("active_users"))).over(Window.partitionBy("_cohort"))
    return sorted_small(
        cells.select(F.date_add(floor, F.col("_cohort") * 7).alias("cohort_week"), size.alias("cohort_size"), "week_offset", "active_users"),
        F.col("cohort_week").desc(),
        F.col("week_offset").asc_nulls_last(),
    )


def cohort_retention(
    sessions: DataFrame,
    as_of=None,
    weeks: int = SESSION_COHORT_WEEKS,
    min_turns: int = ENGAGED_MIN_USER_TURNS,
) -> DataFrame:
    """Cohort = Monday of a user's first engaged session, kept when that first
    session is on/after the Monday of (as_of − weeks); activity = any session."""
    floor = monday(minus_seconds(ts_lit(as_of), weeks * 7 * 86400))
    engaged = F.when(F.col("user_turns") >= min_turns, F.col("started_at"))
    return cohort_table(sessions, "user_id", F.to_date("started_at"), engaged, floor, _words(as_of, weeks))


def event_retention(events: DataFrame, as_of=None, weeks: int = EVENT_COHORT_WEEKS) -> DataFrame:
    """Cohort = Monday of a user's first event date, kept when ≥ Monday(as_of) − weeks."""
    floor = F.date_sub(monday(ts_lit(as_of)), weeks * 7)
    return cohort_table(events, "u", F.to_date("ts"), F.col("ts"), floor, _words(as_of, weeks))


def _grid(long: DataFrame, max_col_of, cell_for_missing, as_of, threshold: int) -> DataFrame:
    """Pivot to fixed columns n0..n8 / w0..w8. The pivot has one row per
    cohort (at most weeks_back + 1 rows), so the grid-wide column limit is a
    window over that bounded set rather than a second pass over the input."""
    offsets = list(range(GRID_MAX_COLUMN + 1))
    current = monday(ts_lit(as_of))
    wide = (
        long.groupBy("cohort_week", "cohort_size")
        .pivot("week_offset", offsets)
        .agg(F.max("active_users"))
        .withColumn("_age", weeks_between(current, F.col("cohort_week")))
        .withColumn("_max_off", F.greatest(*[F.when(F.col(str(k)).isNotNull(), F.lit(k)) for k in offsets], F.lit(0)))
    )
    everything = Window.partitionBy()
    max_col = F.least(F.lit(GRID_MAX_COLUMN), F.max(max_col_of).over(everything))
    wide = wide.withColumn("_max_col", max_col)
    cols = []
    for k in offsets:
        users_out = cell_for_missing(F.col(str(k)), k, F.col("_age"))
        shown = F.lit(k) <= F.col("_max_col")
        cols.append(F.when(shown, users_out).cast("long").alias(f"n{k}"))
        cols.append(F.when(shown, pct_half_even(users_out, F.col("cohort_size"))).alias(f"w{k}"))
    return wide.select(
        "cohort_week",
        "cohort_size",
        (F.col("cohort_size") >= threshold).alias("trusted"),
        *cols,
    ).sortWithinPartitions(F.col("cohort_week").desc())  # already one partition (window above)


def session_grid(long: DataFrame, as_of=None, threshold: int = SMALL_SAMPLE_THRESHOLD) -> DataFrame:
    """Pivot of :func:`cohort_retention`: columns w0..w8 (percent, ties to even)
    and n0..n8 (users). A cell the cohort is not old enough for is NULL
    (future); an old-enough cell without activity is 0. Columns past
    min(8, oldest cohort age) are NULL throughout."""

    def cell(users, k, age):
        return F.when(F.lit(k) > age, F.lit(None)).otherwise(F.coalesce(users, F.lit(0)))

    return _grid(long, F.col("_age"), cell, as_of, threshold)


def event_grid(long: DataFrame, as_of=None, threshold: int = SMALL_SAMPLE_THRESHOLD) -> DataFrame:
    """Pivot of :func:`event_retention`: columns up to min(8, largest offset
    present); a missing cell stays NULL."""

    def cell(users, k, age):
        return users

    return _grid(long, F.col("_max_off"), cell, as_of, threshold)
