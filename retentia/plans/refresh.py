"""The hourly sessions refresh job (full build on an empty table, else
incremental) publishing a new snapshot of the sessions table.

Steps: read the latest snapshot → high-water mark (the only value that
reaches the driver) → conversations with a message newer than mark − lookback
(a literal bound, so the filter reaches the parquet scan) → nothing changed:
return 0 → else recompute those conversations from their full history, keep
every other row, publish. Returns the number of session rows recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import REFRESH_LOOKBACK_MINUTES, SESSIONS_SCHEMA
from ..operators import sessions as S
from ..sources.snapshots import SnapshotTable, count_on_write

SORT = ["conversation_id", "session_index"]


def sessions_table(spark, base: str) -> SnapshotTable:
    return SnapshotTable(spark, base, SESSIONS_SCHEMA)


# Changed-conversation ids broadcast to every task when at most this many
# (~40 bytes each); beyond it the semi/anti joins shuffle instead.
BROADCAST_SCOPE_MAX = 2_000_000


def refresh_sessions(
    table: SnapshotTable,
    messages: DataFrame,
    conversations: DataFrame,
    lookback_minutes: float = REFRESH_LOOKBACK_MINUTES,
    broadcast_scope_max: int = BROADCAST_SCOPE_MAX,
    **sessionize_args,
) -> int:
    old = table.read()
    # epoch micros: independent of the driver's local time zone
    mark = old.agg(F.unix_micros(F.max("ended_at")).alias("m")).first()["m"] if table.latest_version() is not None else None
    if mark is None:
        fresh, obs = count_on_write(S.sessionize(messages, conversations, **sessionize_args))
        table.publish(fresh, SORT)
        return int(obs.get["rows"])
    cutoff = F.timestamp_micros(F.lit(int(mark) - int(lookback_minutes * 60 * 1_000_000)))
    # the changed set is small (conversations active since the last run) and is
    # used three times: keep it in executor memory; a lost block is recomputed
    # from its lineage (a cached block is not a lineage cut)
    scope = messages.where(F.col("created_at") > cutoff).select("conversation_id").distinct().persist()
    try:
        n = scope.count()
        if n == 0:
            return 0
        # size-checked broadcast: the semi join then filters the message scan
        # before any shuffle; a larger set falls back to a shuffle join
        ids = F.broadcast(scope) if n <= broadcast_scope_max else scope
        kept = old.join(ids, "conversation_id", "left_anti")
        fresh, obs = count_on_write(S.sessionize(messages, conversations, scope=ids, **sessionize_args))
        table.publish(kept.unionByName(fresh), SORT)
        return int(obs.get["rows"])
    finally:
        scope.unpersist()
