"""Daily user state: cards whose cost follows the new days.

For each day of the event store one folder holds a row per user: events and
messages sent. Rows add up, so a window is a sum over days, and a day's payload
is parsed when the day changes and never again. ``update`` compares the
store's commit with what the state was built from and rebuilds the days whose
folders differ (new ones, and those that late events reached).

A window that begins within a day takes that day in two parts. All windows of
one ``as_of`` begin at its time of day, so at most the few days at their edges
are read from the store again, and cut there. ``slices`` gives rows (u, ts,
events, messages) that begin at ``ts`` and lie wholly on one side of every
cut; operators that only ask who was active when take them as they are.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EVENT_TTL_DAYS, MESSAGE_ACTION
from ..operators import cohorts, events
from ..sources import raw_events as rawv
from ..sources.event_store import DAY, EventStore
from ..sources.keyed import KeyedTable

STATE = T.StructType(
    [T.StructField("u", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("events", T.LongType()), T.StructField("messages", T.LongType())])
#: Days before ``as_of`` at which the cards' windows begin.
EDGES = (1, 7, 14, 30)


class DailyUsers:
    def __init__(self, spark: SparkSession, base: str, store: EventStore, message_action: str = MESSAGE_ACTION):
        self.spark, self.store, self.message_action = spark, store, message_action
        self.table = KeyedTable(spark, base, STATE, DAY)

    def _slices(self, days: list[str], cuts: list[dt.datetime]) -> DataFrame:
        """Rows of the given days, cut at the given instants."""
        ev = rawv.facts(self.store.days.read(days)).select("u", "ts", "se_action")
        start = F.date_trunc("day", "ts")
        for cut in sorted(cuts):
            at = F.lit(cut.isoformat(sep=" ")).cast("timestamp")
            start = F.when((F.col("ts") >= at) & (at > start), at).otherwise(start)
        return ev.groupBy("u", start.alias("ts")).agg(
            F.count(F.lit(1)).alias("events"), F.count_if(F.col("se_action") == self.message_action).alias("messages"))

    def update(self) -> list[str]:
        """Rebuild the days that changed in the store since the last update; returns them."""
        now, built = self.store.days.manifest()["folders"], self.table.state().get("built", {})
        changed = sorted(d for d in now if now[d] != built.get(d))
        gone = [d for d in built if d not in now]
        if changed or gone:
            rows = self._slices(changed, []).withColumn(DAY, F.date_format("ts", "yyyy-MM-dd"))
            self.table.replace(rows, [*changed, *gone], {"built": now}, ["u"])
        return changed

    def slices(self, as_of, ttl_days: int = EVENT_TTL_DAYS) -> DataFrame:
        """(u, ts, events, messages) inside the TTL at a literal ``as_of``."""
        now = (as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))).replace(microsecond=0)
        oldest = now - dt.timedelta(days=ttl_days) + dt.timedelta(seconds=1)
        cuts = [now - dt.timedelta(days=k) for k in EDGES] + [oldest]
        edges = {c.date().isoformat() for c in cuts if c.time() != dt.time(0)}
        days = [d for d in self.table.manifest()["folders"] if d >= oldest.date().isoformat()]
        whole = self.table.read([d for d in days if d not in edges])
        rows = whole.unionByName(self._slices(sorted(edges & set(days)), cuts)) if edges & set(days) else whole
        return rows.where(F.col("ts") >= F.lit(oldest.isoformat(sep=" ")).cast("timestamp"))

    def cards(self, as_of, ttl_days: int = EVENT_TTL_DAYS) -> dict:
        """The cards that the state answers, as for ``marts.run_cards``."""
        rows = self.slices(as_of, ttl_days)
        return {
            "active_users": lambda: events.active_users(rows, as_of),
            "dau_trend": lambda: events.dau_trend(rows, as_of),
            "event_volume": lambda: events.event_volume(rows, as_of, weight="events"),
            "returning_user_rate": lambda: events.returning_user_rate(rows),
            "message_depth": lambda: events.depth_buckets(rows.where("messages > 0").groupBy("u").agg(F.sum("messages").alias("c"))),
            "wow": lambda: events.wow(rows, as_of, weight="events"),
            "event_retention": lambda: cohorts.event_retention(rows, as_of),
        }
