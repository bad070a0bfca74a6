"""Registered queries over the shared test tables.

Each entry takes (spark, sf_dir) and returns a lazy DataFrame computed from
the ``events`` table through the adapters in ``sources.testviews``. Parameters
follow the fixture plan: as_of 2024-01-31 00:00 (2024-01-30 12:00 for the
"today" card), session gaps of 20 minutes and 24 hours, engaged threshold 2
with the 24-hour gap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohorts, events, funnel, headline, sessions
from ..sources import raw_events as rawv
from ..sources import testviews as tv
from . import marts

AS_OF = "2024-01-31 00:00:00"
TODAY_AS_OF = "2024-01-30 12:00:00"
REFRESH_CUT = "2024-01-30 18:00:00"
TTL_AS_OF = "2024-04-15 00:00:00"
DAY_GAP = 24 * 60
ENGAGED = 2
FUNNEL = ["item_viewed", "click", "signup", "purchase"]
START_ACTION, MESSAGE_ACTION = "signup", "purchase"


def _sessions(spark: SparkSession, sf: str, gap: float = DAY_GAP) -> DataFrame:
    """Sessions built from the messages (lazy; a production card reads the published table)."""
    return sessions.sessionize(tv.messages(spark, sf), tv.conversations(spark, sf), gap_minutes=gap)


def _ev(spark: SparkSession, sf: str) -> DataFrame:
    """The deduplicated event view (lazy; the marts job writes it as a table)."""
    return rawv.event_view(tv.raw_events(spark, sf), as_of=AS_OF)


def q_sessionize_20m(spark, sf):
    return _sessions(spark, sf, 20)


def q_sessionize_24h(spark, sf):
    return _sessions(spark, sf, DAY_GAP)


def _before_cut(spark, sf):
    """The sessions table as an earlier refresh left it: built from the
    messages that existed at REFRESH_CUT."""
    msgs = tv.messages(spark, sf).where(F.col("created_at") < F.lit(REFRESH_CUT).cast("timestamp"))
    return sessions.sessionize(msgs, tv.conversations(spark, sf), gap_minutes=DAY_GAP)


def q_changed_conversations(spark, sf):
    old = _before_cut(spark, sf)
    return sessions.changed_conversations(tv.messages(spark, sf), sessions.high_water_mark(old))


def q_refresh_incremental(spark, sf):
    old = _before_cut(spark, sf)
    msgs, convs = tv.messages(spark, sf), tv.conversations(spark, sf)
    scope = sessions.changed_conversations(msgs, sessions.high_water_mark(old))
    return sessions.refresh(old, msgs, convs, scope, gap_minutes=DAY_GAP)


def q_engaged_sessions_today(spark, sf):
    return headline.engaged_sessions_today(_sessions(spark, sf), as_of=TODAY_AS_OF, min_turns=ENGAGED)


def q_second_message_rate(spark, sf):
    return headline.second_message_rate(_sessions(spark, sf), as_of=AS_OF, days=30)


def q_w1_return_rate(spark, sf):
    return headline.w1_return_rate(_sessions(spark, sf), as_of=AS_OF, min_turns=ENGAGED)


def q_cohort_retention(spark, sf):
    return cohorts.cohort_retention(_sessions(spark, sf), as_of=AS_OF, min_turns=ENGAGED)


def q_cohort_grid(spark, sf):
    return cohorts.session_grid(q_cohort_retention(spark, sf), as_of=AS_OF)


def q_active_users(spark, sf):
    return events.active_users(_ev(spark, sf), AS_OF)


def q_dau_trend(spark, sf):
    return events.dau_trend(_ev(spark, sf), AS_OF)


def q_event_volume(spark, sf):
    return events.event_volume(_ev(spark, sf), AS_OF)


def q_total_events(spark, sf):
    return events.total_events(q_event_volume(spark, sf))


def q_top_events(spark, sf):
    return events.top_events(_ev(spark, sf), AS_OF)


def q_top_views(spark, sf):
    return events.top_views(_ev(spark, sf), AS_OF)


def q_platform_breakdown(spark, sf):
    return events.platform_breakdown(_ev(spark, sf), AS_OF)


def q_data_span_days(spark, sf):
    return events.data_span_days(_ev(spark, sf), AS_OF)


def q_influencer_engagement(spark, sf):
    return events.influencer_engagement(_ev(spark, sf), AS_OF, start_action=START_ACTION, message_action=MESSAGE_ACTION)


def q_message_depth(spark, sf):
    return events.message_depth(_ev(spark, sf), message_action=MESSAGE_ACTION)


def q_returning_user_rate(spark, sf):
    return events.returning_user_rate(_ev(spark, sf))


def q_event_retention(spark, sf):
    # three branches read the view: the dedup exchange is shared by all three
    # (reused), so keeping it is cheaper than parsing the payload three times
    return cohorts.event_retention(_ev(spark, sf), AS_OF)


def q_event_retention_grid(spark, sf):
    return cohorts.event_grid(q_event_retention(spark, sf), AS_OF)


def q_wow(spark, sf):
    return events.wow(_ev(spark, sf), AS_OF)


def q_events_by_action(spark, sf):
    return events.events_by_action(_ev(spark, sf), AS_OF)


def q_recent_activity(spark, sf):
    return events.recent_activity(_ev(spark, sf), AS_OF)


def q_funnel_levels(spark, sf):
    return funnel.funnel_levels(_ev(spark, sf), FUNNEL, AS_OF)


def q_funnel_steps(spark, sf):
    return funnel.window_funnel(_ev(spark, sf), FUNNEL, AS_OF).select("step_no", "step", "users", "conversion")


def q_funnel_dropoff(spark, sf):
    return funnel.window_funnel(_ev(spark, sf), FUNNEL, AS_OF).select("step_no", "step", "users", "dropoff")


def q_kpi_glance(spark, sf):
    ev = _ev(spark, sf)
    return marts.kpi_glance(
        funnel.window_funnel(ev, FUNNEL, AS_OF), events.active_users(ev, AS_OF), events.returning_user_rate(ev)
    )


def q_latest_events(spark, sf):
    return marts.latest(
        _ev(spark, sf), "ts", k=100, columns=["ts", "event_id", "u", "se_action", "platform", "app_version"], tie="event_id"
    )


def _replayed_raw(spark, sf):
    """Whole stream delivered twice (at-least-once replay); the replay copy is
    marked so the newest-wins rule is observable."""
    raw = tv.raw_events(spark, sf)
    first = raw.withColumn("ingest_batch", F.lit(0).cast("long"))
    again = raw.withColumn("app_id", F.lit("app-replay")).withColumn("ingest_batch", F.lit(1).cast("long"))
    return first.unionByName(again)


def q_dedup_events(spark, sf):
    return rawv.dedup(_replayed_raw(spark, sf)).select("event_id", "event_name", "collector_tstamp", "app_id", "platform")


def q_retained_events(spark, sf):
    return rawv.retained(tv.raw_events(spark, sf), as_of=TTL_AS_OF).select("event_id", "collector_tstamp")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
