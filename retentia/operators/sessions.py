"""Gap-based sessionization of chat messages and its incremental refresh.

A session is a maximal run of messages of one conversation in which no gap to
the previous message (ordered by ``created_at, id``) exceeds ``gap_minutes``;
a gap of exactly ``gap_minutes`` stays in the session. The session index is the
running count of session starts ordered by ``created_at, role`` with the
default RANGE frame, exactly like the SQL the dashboards were fed by. Two
messages of one conversation at the same instant can therefore get index 0;
``tie_break="id"`` gives the clean numbering instead.

Scale design. One conversation — or one burst inside it — may hold a large
share of all messages, so no window or sort runs over message rows. Time is
cut into slices no wider than the gap, so a gap inside a slice can never start
a session: only the first message of a slice can, and only when the previous
slice's last message is more than the gap earlier. Message rows are reduced by
aggregation only (map-side combined): per instant, then per slice, keeping the
details of the slice's first instant, which is all the running-sum frame needs
(rows at that instant with a smaller role fall outside it). The message rows
are shuffled once, keyed by (conversation, slice, instant), so even a burst
within one slice spreads over many tasks. Cross-slice numbering is a window
over at most two rows per slice of a conversation's time span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import floor_div
from ..model import REFRESH_LOOKBACK_MINUTES, SESSION_GAP_MINUTES

_US = 1_000_000
_COUNTS = [("user_turns", "user"), ("bot_turns", "assistant"), ("system_turns", "system")]


def _whole_conversation(m: DataFrame, gap_us: int, tie_break: str) -> DataFrame:
    """Direct formulation (windows over whole conversations): reference path."""
    sum_order = ["created_at", "role"] if tie_break == "role" else ["created_at", "id"]
    w_lag = Window.partitionBy("conversation_id").orderBy("created_at", "id")
    w_sum = Window.partitionBy("conversation_id").orderBy(*sum_order)
    prev = F.lag("_t").over(w_lag)
    rows = m.withColumn("_flag", F.when(prev.isNull() | (F.col("_t") - prev > gap_us), 1).otherwise(0))
    rows = rows.withColumn("session_index", F.sum("_flag").over(w_sum))
    return rows.groupBy("conversation_id", "session_index").agg(
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("ended_at"),
        *[F.count_if(F.col("role") == r).alias(c) for c, r in _COUNTS],
    )


def _sliced(m: DataFrame, gap_us: int, slice_us: int, tie_break: str) -> DataFrame:
    counts = [c for c, _ in _COUNTS]
    m = m.withColumn("_slice", floor_div(F.col("_t"), slice_us))
    # 1. one row per instant of a slice (messages at the same microsecond
    #    merged); _first_role = role of the instant's smallest id
    instants = m.groupBy("conversation_id", "_slice", "_t").agg(
        *[
            F.expr(e)
            for e in ["min(created_at) AS created_at"]
            + [f"count_if(role = '{r}') AS {c}" for c, r in _COUNTS]
            + ["min(role) AS _min_role", "min_by(role, id) AS _first_role"]
        ]
    )
    # 2. one row per slice, with the details of its first instant
    first = f"min_by(named_struct('created_at', created_at, '_min_role', _min_role, '_first_role', _first_role, {', '.join(f"'{c}', {c}" for c in counts)}), _t) AS _f"
    slices = instants.groupBy("conversation_id", "_slice").agg(
        *[
            F.expr(e)
            for e in ["min(_t) AS _first_t", "max(_t) AS _last_t", "max(created_at) AS ended_at", first]
            + [f"sum({c}) AS {c}" for c in counts]
        ]
    )
    # 3. split the slice into the rows inside the running-sum frame of its
    #    first message and the rows outside it: same instant, smaller role
    #    (only possible with the (created_at, role) order)
    if tie_break == "role":
        out_n = {c: f"CASE WHEN '{r}' < _f._first_role THEN _f.{c} ELSE 0 END" for c, r in _COUNTS}
        out_exists = "_f._min_role < _f._first_role"
    else:
        out_n = {c: "CAST(0 AS BIGINT)" for c in counts}
        out_exists = "false"
    inside = "named_struct('_in', 1, 'started_at', _f.created_at, 'ended_at', ended_at, " + ", ".join(
        f"'{c}', {c} - ({out_n[c]})" for c in counts
    ) + ")"
    outside = "named_struct('_in', 0, 'started_at', _f.created_at, 'ended_at', _f.created_at, " + ", ".join(
        f"'{c}', {out_n[c]}" for c in counts
    ) + ")"
    keys = ["conversation_id", "_slice", "_first_t", "_last_t"]
    groups = slices.selectExpr(
        *keys, f"explode(CASE WHEN {out_exists} THEN array({inside}, {outside}) ELSE array({inside}) END) AS g"
    ).selectExpr(*keys, "g.*")
    # 4. number sessions across slices: a slice starts a session when the
    #    previous slice's last message is more than the gap earlier
    before = "OVER (PARTITION BY conversation_id ORDER BY _slice RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    groups = groups.selectExpr(
        "*", f"CASE WHEN max(_last_t) {before} IS NULL OR _first_t - max(_last_t) {before} > {gap_us} THEN 1 ELSE 0 END AS _tf"
    ).selectExpr("*", f"coalesce(sum(CASE WHEN _in = 1 THEN _tf END) {before}, 0) + _tf * _in AS session_index")
    return groups.groupBy("conversation_id", "session_index").agg(
        *[F.expr(e) for e in ["min(started_at) AS started_at", "max(ended_at) AS ended_at"] + [f"sum({c}) AS {c}" for c in counts]]
    )


def sessionize(
    messages: DataFrame,
    conversations: DataFrame,
    gap_minutes: float = SESSION_GAP_MINUTES,
    scope: DataFrame | None = None,
    slice_seconds: int | None = 3600,
    tie_break: str = "role",
    chat_type: str = "ai_chat",
) -> DataFrame:
    """messages ⋈ conversations → one row per (conversation, session).

    ``scope``: optional DataFrame with a ``conversation_id`` column; only those
    conversations are rebuilt, each from its full history. ``slice_seconds``
    is capped at the gap; ``None`` runs windows over whole conversations.
    """
    if tie_break not in ("role", "id"):
        raise ValueError("tie_break must be 'role' or 'id'")
    gap_us = int(gap_minutes * 60 * _US)
    msgs = messages.select("id", "conversation_id", "role", "created_at", F.unix_micros("created_at").alias("_t"))
    if scope is not None:
        msgs = msgs.join(scope.select("conversation_id"), "conversation_id", "left_semi")
    if slice_seconds and gap_us >= 1:
        sessions = _sliced(msgs, gap_us, min(int(slice_seconds * _US), gap_us), tie_break)
    else:
        sessions = _whole_conversation(msgs, gap_us, tie_break)
    chats = conversations.where(F.col("conversation_type") == chat_type).select(
        F.col("id").alias("conversation_id"), "user_id", "influencer_id"
    )
    return sessions.join(chats, "conversation_id").select(
        "conversation_id",
        F.col("session_index").cast("int").alias("session_index"),
        "user_id",
        "influencer_id",
        "started_at",
        "ended_at",
        *[F.col(c).cast("int").alias(c) for c, _ in _COUNTS],
    )


def high_water_mark(sessions: DataFrame) -> DataFrame:
    """One row: ``watermark`` = max(ended_at); NULL when the table is empty."""
    return sessions.agg(F.max("ended_at").alias("watermark"))


def changed_conversations(
    messages: DataFrame,
    watermark: DataFrame,
    lookback_minutes: float = REFRESH_LOOKBACK_MINUTES,
) -> DataFrame:
    """Conversations with a message strictly newer than watermark − lookback.

    ``watermark`` is the one-row DataFrame of :func:`high_water_mark`; it is
    used as a scalar subquery (evaluated once, then a plain filter), so nothing
    goes through the driver and no join is planned. No conversation-type
    filter here, as in the source job.
    """
    cutoff = watermark.select(
        F.timestamp_micros(F.unix_micros("watermark") - int(lookback_minutes * 60 * _US)).alias("_cutoff")
    ).scalar()
    return messages.where(F.col("created_at") > cutoff).select("conversation_id").distinct()


def refresh(
    old_sessions: DataFrame,
    messages: DataFrame,
    conversations: DataFrame,
    scope: DataFrame,
    **sessionize_args,
) -> DataFrame:
    """Scoped replace: old rows of the changed conversations are dropped and
    their full history is sessionized again."""
    kept = old_sessions.join(scope.select("conversation_id"), "conversation_id", "left_anti")
    fresh = sessionize(messages, conversations, scope=scope, **sessionize_args)
    return kept.unionByName(fresh)
