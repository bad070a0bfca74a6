"""Product metrics over the event view (see ``sources.raw_events.event_view``).

Input columns: ts, u, se_category, se_action, platform, app_version,
influencer, itype. Windows are ``ts >= as_of - d`` with no upper bound.
Distinct-user counts over several windows are computed from one per-user
pre-aggregate (one shuffle, map-side combined, so the anonymous '' user —
often the largest — never lands whole in one task). Top-k lists sort by the
count and then by the group keys so ties are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import ts_lit
from ..functions.timefn import hour_boundaries, ratio, sorted_small
from ..model import (
    ACTIONS_K,
    CHAT_START_ACTION,
    DATA_SPAN_BANNER_DAYS,
    DEPTH_BUCKETS,
    INFLUENCER_K,
    MESSAGE_ACTION,
    PLATFORM_K,
    TOP_EVENTS_K,
    TOP_VIEWS_K,
)
from ..sources.raw_events import since

_DAY = 86400


def _ago(as_of, seconds: int):
    """``seconds`` before the whole second of ``as_of``, as ``since`` counts."""
    return F.timestamp_seconds(F.unix_seconds(ts_lit(as_of)) - seconds)


def active_users(ev: DataFrame, as_of=None) -> DataFrame:
    """dau / wau / mau (exact distinct users in the last 1/7/30 days) and
    stickiness = dau / mau (NULL when mau = 0)."""
    last = since(ev, as_of, 30 * _DAY).groupBy("u").agg(F.max("ts").alias("last_ts"))
    out = last.agg(
        F.count_if(F.col("last_ts") >= _ago(as_of, _DAY)).alias("dau"),
        F.count_if(F.col("last_ts") >= _ago(as_of, 7 * _DAY)).alias("wau"),
        F.count(F.lit(1)).alias("mau"),
    )
    return out.select("dau", "wau", "mau", ratio(F.col("dau"), F.col("mau")).alias("stickiness"))


def dau_trend(ev: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    return sorted_small(
        since(ev, as_of, days * _DAY)
        .select(F.to_date("ts").alias("d"), "u")
        .distinct()
        .groupBy("d")
        .agg(F.count(F.lit(1)).alias("dau")),
        "d",
    )


def _events(weight: str | None, condition=None):
    """Number of events: rows, or the sum of ``weight`` where rows stand for several events."""
    n = F.lit(1) if weight is None else F.col(weight)
    return F.coalesce(F.sum(n if condition is None else F.when(condition, n)), F.lit(0)).cast("long")


def event_volume(ev: DataFrame, as_of=None, days: int = 30, weight: str | None = None) -> DataFrame:
    return sorted_small(since(ev, as_of, days * _DAY).groupBy(F.to_date("ts").alias("d")).agg(_events(weight).alias("events")), "d")


def total_events(volume: DataFrame) -> DataFrame:
    """Sum of the daily volume (the banner's event count)."""
    return volume.agg(F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("total_events"))


def _top(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), *[F.col(c).asc() for c in keys])
        .limit(k)
    )


def top_events(ev: DataFrame, as_of=None, k: int = TOP_EVENTS_K) -> DataFrame:
    w = since(ev, as_of, 7 * _DAY).where(F.col("se_action") != "")
    top = _top(w.select(F.col("se_category").alias("category"), F.col("se_action").alias("action")), ["category", "action"], k)
    return top.select("category", "action", "n", F.concat_ws("/", "category", "action").alias("label"))


def top_views(ev: DataFrame, as_of=None, k: int = TOP_VIEWS_K, suffix: str = "_viewed") -> DataFrame:
    w = since(ev, as_of, 7 * _DAY).where(F.col("se_action").endswith(suffix))
    return _top(w.select(F.col("se_action").alias("view")), ["view"], k)


def platform_breakdown(ev: DataFrame, as_of=None, k: int = PLATFORM_K) -> DataFrame:
    return _top(since(ev, as_of, 7 * _DAY).select("platform", "app_version"), ["platform", "app_version"], k)


def events_by_action(ev: DataFrame, as_of=None, k: int = ACTIONS_K) -> DataFrame:
    w = since(ev, as_of, 7 * _DAY).where(F.col("se_action") != "")
    return _top(w.select(F.col("se_action").alias("action")), ["action"], k)


def data_span_days(ev: DataFrame, as_of=None, banner_days: float = DATA_SPAN_BANNER_DAYS) -> DataFrame:
    """Hour boundaries crossed between the oldest event and ``as_of``, / 24.
    Empty input gives 0. ``filling_in`` is the banner flag (span < 3 days)."""
    span = ev.agg(F.min("ts").alias("_min")).select(
        F.coalesce(hour_boundaries(F.col("_min"), ts_lit(as_of)) / F.lit(24.0), F.lit(0.0)).alias("span_days")
    )
    return span.select("span_days", (F.col("span_days") < banner_days).alias("filling_in"))


def influencer_engagement(
    ev: DataFrame,
    as_of=None,
    k: int = INFLUENCER_K,
    start_action: str = CHAT_START_ACTION,
    message_action: str = MESSAGE_ACTION,
) -> DataFrame:
    """Per influencer in the last 30 days: chats started, messages sent,
    distinct users. The type is ``max(itype)``: one of the observed values,
    deterministic, and non-blank whenever any row has one."""
    w = since(ev, as_of, 30 * _DAY).where(
        (F.col("influencer") != "") & F.col("se_action").isin(start_action, message_action)
    )
    per_user = w.groupBy("influencer", "u").agg(
        F.max("itype").alias("itype"),
        F.count_if(F.col("se_action") == start_action).alias("chats"),
        F.count_if(F.col("se_action") == message_action).alias("messages"),
    )
    return (
        per_user.groupBy("influencer")
        .agg(
            F.max("itype").alias("influencer_type"),
            F.sum("chats").cast("long").alias("chats"),
            F.sum("messages").cast("long").alias("messages"),
            F.count(F.lit(1)).alias("users"),
        )
        .orderBy(F.col("messages").desc(), F.col("chats").desc(), F.col("influencer").asc())
        .limit(k)
    )


def message_depth(ev: DataFrame, message_action: str = MESSAGE_ACTION) -> DataFrame:
    """Users by number of messages sent: 1, 2-5, 6-20, 21+ (fixed order; empty
    buckets absent). Over all retained rows."""
    return depth_buckets(ev.where(F.col("se_action") == message_action).groupBy("u").agg(F.count(F.lit(1)).alias("c")))


def depth_buckets(per_user: DataFrame) -> DataFrame:
    """Users per bucket of their count ``c``."""
    c = F.col("c")
    bucket = F.when(c == 1, DEPTH_BUCKETS[0]).when(c <= 5, DEPTH_BUCKETS[1]).when(c <= 20, DEPTH_BUCKETS[2]).otherwise(DEPTH_BUCKETS[3])
    rank = F.when(c == 1, 0).when(c <= 5, 1).when(c <= 20, 2).otherwise(3)
    per_bucket = per_user.groupBy(bucket.alias("bucket"), rank.alias("_rank")).agg(F.count(F.lit(1)).alias("users"))
    return sorted_small(per_bucket, "_rank").select("bucket", "users")


def returning_user_rate(ev: DataFrame) -> DataFrame:
    """Share of users seen on more than one UTC day (all retained rows)."""
    per_user = ev.groupBy("u").agg((F.min(F.to_date("ts")) != F.max(F.to_date("ts"))).alias("returning"))
    out = per_user.agg(F.count_if("returning").alias("returning_users"), F.count(F.lit(1)).alias("n"))
    return out.select(ratio(F.col("returning_users"), F.col("n")).alias("rate"), "returning_users", "n")


def wow(ev: DataFrame, as_of=None, weight: str | None = None) -> DataFrame:
    """This 7 days vs the 7 before: users, events and relative change
    ((this − last) / last, NULL when last = 0), plus the change as a signed
    whole percent for display."""
    split = _ago(as_of, 7 * _DAY)
    per_user = since(ev, as_of, 14 * _DAY).groupBy("u").agg(
        _events(weight, F.col("ts") >= split).alias("e_this"),
        _events(weight, F.col("ts") < split).alias("e_last"),
    )
    out = per_user.agg(
        F.count_if(F.col("e_this") > 0).alias("users_this"),
        F.count_if(F.col("e_last") > 0).alias("users_last"),
        F.coalesce(F.sum("e_this"), F.lit(0)).cast("long").alias("events_this"),
        F.coalesce(F.sum("e_last"), F.lit(0)).cast("long").alias("events_last"),
    )

    def delta(this: str, last: str):
        return ratio(F.col(this) - F.col(last), F.col(last))

    def pct(c: str):  # signed whole percent for the badge, ties to even
        return F.bround(F.col(c) * 100.0, 0).cast("int")

    return out.select(
        "users_this",
        "users_last",
        delta("users_this", "users_last").alias("users_delta"),
        "events_this",
        "events_last",
        delta("events_this", "events_last").alias("events_delta"),
    ).select("*", pct("users_delta").alias("users_delta_pct"), pct("events_delta").alias("events_delta_pct"))


def recent_activity(ev: DataFrame, as_of=None) -> DataFrame:
    """Events in the last 15 and 60 minutes, users in the last 15."""
    cut15 = _ago(as_of, 15 * 60)
    per_user = since(ev, as_of, 60 * 60).groupBy("u").agg(
        F.count_if(F.col("ts") >= cut15).alias("e15"),
        F.count(F.lit(1)).alias("e60"),
    )
    return per_user.agg(
        F.coalesce(F.sum("e15"), F.lit(0)).cast("long").alias("events_15m"),
        F.coalesce(F.sum("e60"), F.lit(0)).cast("long").alias("events_60m"),
        F.count_if(F.col("e15") > 0).alias("users_15m"),
    )
