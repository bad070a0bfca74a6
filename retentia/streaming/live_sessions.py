"""Live chat sessions over a message stream (streaming form of sessionize).

Sessions are event-time session windows per conversation: a message within
``gap_minutes`` of the previous one (exactly the gap included) extends the
session. The watermark bounds state; in append mode a session is emitted once
the watermark passes its end, so still-open sessions are withheld, and there
is no session index. :func:`session_updates` keeps state of its own per
conversation instead: it reports open sessions too, and numbers them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..model import SESSION_GAP_MINUTES


def live_sessions(
    messages: DataFrame,
    conversations: DataFrame,
    gap_minutes: int = SESSION_GAP_MINUTES,
    delay: str = "1 hour",
    chat_type: str = "ai_chat",
) -> DataFrame:
    """Streaming ``messages`` ⋈ static ``conversations`` → closed sessions."""
    chats = conversations.where(F.col("conversation_type") == chat_type).select(
        F.col("id").alias("conversation_id"), "user_id", "influencer_id"
    )
    sessions = (
        messages.select("conversation_id", "role", "created_at")
        .withWatermark("created_at", delay)
        .groupBy("conversation_id", F.session_window("created_at", f"{gap_minutes} minutes").alias("w"))
        .agg(
            F.min("created_at").alias("started_at"),
            F.max("created_at").alias("ended_at"),
            F.count_if(F.col("role") == "user").cast("int").alias("user_turns"),
            F.count_if(F.col("role") == "assistant").cast("int").alias("bot_turns"),
            F.count_if(F.col("role") == "system").cast("int").alias("system_turns"),
        )
    )
    return sessions.join(chats, "conversation_id").select(
        "conversation_id", "user_id", "influencer_id", "started_at", "ended_at", "user_turns", "bot_turns", "system_turns"
    )


#: Messages of one conversation are collapsed by this much time before they are shuffled to their state.
PIECE_SECONDS = 60
#: The state of conversations whose ids share a hash is one row: a call of the state function costs milliseconds, however little it does.
BUCKETS = 1024

_UPDATE = (
    "conversation_id string, session_index int, started_at timestamp, ended_at timestamp, "
    "user_turns int, bot_turns int, system_turns int, status string, version bigint"
)
_STATE = (
    "ids array<string>, closed array<bigint>, versions array<bigint>, owners array<bigint>, "
    "starts array<bigint>, ends array<bigint>, users array<bigint>, bots array<bigint>, systems array<bigint>"
)
_ROLES = ("user", "assistant", "system")


def _pieces(piece_us: int):
    """Rows (conversation_id, role, t) -> one row per conversation and piece of time, for each Arrow batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            turns = {n: (d["role"] == r).astype("int64") for n, r in enumerate(_ROLES)}
            d = pd.DataFrame({"conversation_id": d["conversation_id"], "piece": d["t"] // piece_us, "first": d["t"], "last": d["t"], **turns})
            out = d.groupby(["conversation_id", "piece"], sort=False).agg({"first": "min", "last": "max", 0: "sum", 1: "sum", 2: "sum"})
            yield out.reset_index().drop(columns="piece").set_axis(["conversation_id", "first", "last", "users", "bots", "systems"], axis=1)

    return run


def merge_runs(rows: np.ndarray, gap_us: int) -> np.ndarray:
    """Rows (first, last, counts…) merged wherever one starts at most the gap after all before it have ended."""
    return merge_owned_runs(np.column_stack([np.zeros(len(rows), np.int64), rows]), gap_us)[:, 1:]


def merge_owned_runs(rows: np.ndarray, gap_us: int) -> np.ndarray:
    """``merge_runs`` for the rows (owner, first, last, counts…) of each owner by itself, sorted by owner and time."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    reach = pd.Series(rows[:, 2]).groupby(rows[:, 0]).cummax().to_numpy()
    heads = np.flatnonzero(np.concatenate(([True], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] - reach[:-1] > gap_us))))
    last = np.maximum.reduceat(rows[:, 2], heads)
    return np.column_stack([rows[heads, 0], rows[heads, 1], last, np.add.reduceat(rows[:, 3:], heads, axis=0)])


def _places(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by owner: how many each owner has, where they begin, and each row's place among them."""
    count = np.bincount(owner, minlength=n)
    begin = np.cumsum(count) - count
    return count, begin, np.arange(len(owner)) - begin[owner]


def _advance(gap_us: int, piece_us: int):
    """The state of a bucket of conversations: of each, the sessions that a message may still reach, and how many lie before them."""
    columns = ["first", "last", "users", "bots", "systems"]

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids, closed, version, *lists = state.get if state.exists else ([], [], [], [], [], [], [], [], [])
        held = np.array(lists, dtype=np.int64).T.reshape(-1, 6)
        came = pd.DataFrame({"conversation_id": [], **{c: [] for c in columns}}) if state.hasTimedOut else pd.concat(frames, ignore_index=True)
        codes, ids = pd.factorize(pd.Series([*ids, *came["conversation_id"]], dtype=object))
        n, fresh = len(ids), codes[len(closed):]
        closed, version = (np.pad(np.array(a, dtype=np.int64), (0, n - len(a))) for a in (closed, version))
        now = merge_owned_runs(np.concatenate([held, np.column_stack([fresh, came[columns].to_numpy(np.int64)])]), gap_us)

        # A conversation moves on when messages came or the watermark has passed its first open session.
        watermark = state.getCurrentWatermarkMs()
        moved = np.zeros(n, dtype=bool)
        moved[fresh] = True
        moved[held[-(-(held[:, 2] + gap_us + piece_us) // 1000) < watermark, 0]] = True
        until = now[:, 2] + gap_us + piece_us  # from here on no message can reach the session
        done = moved[now[:, 0]] & (until <= watermark * 1000)

        n_held, begin, held_place = _places(held[:, 0], n)
        n_now, _, place = _places(now[:, 0], n)
        known = place < n_held[now[:, 0]]
        news = done | ~known
        news[known] |= (now[known] != held[begin[now[known, 0]] + place[known]]).any(axis=1)
        gone = held_place >= n_now[held[:, 0]]
        rows = np.concatenate([now[news], held[gone]])
        index = closed[rows[:, 0]] + np.concatenate([place[news], held_place[gone]]) + 1
        told = np.zeros(n, dtype=np.int64)
        told[rows[:, 0]] = 1
        version = version + told
        closed = closed + np.bincount(now[done, 0], minlength=n)
        state.update((list(ids), closed.tolist(), version.tolist(), *now[~done].T.tolist()))
        if not done.all():
            state.setTimeoutTimestamp(int(-(-until[~done].min() // 1000)))
        if len(rows):
            yield pd.DataFrame({
                "conversation_id": ids[rows[:, 0]], "session_index": index,
                "started_at": pd.to_datetime(rows[:, 1], unit="us"), "ended_at": pd.to_datetime(rows[:, 2], unit="us"),
                "user_turns": rows[:, 3], "bot_turns": rows[:, 4], "system_turns": rows[:, 5],
                "status": np.concatenate([np.where(done[news], "closed", "open"), np.full(gone.sum(), "gone")]),
                "version": version[rows[:, 0]],
            })

    return run


def session_updates(
    messages: DataFrame,
    conversations: DataFrame,
    gap_minutes: float = SESSION_GAP_MINUTES,
    delay: str = "1 hour",
    chat_type: str = "ai_chat",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming ``messages`` → append-only updates of numbered sessions, open ones included.

    A row says what session ``session_index`` (1, 2, … by time) of a
    conversation is as of ``version`` (ascending per conversation): ``open``,
    ``closed`` (the watermark says that no message can reach it any more) or
    ``gone`` (a late message joined two sessions, so the last number is no
    longer used). :func:`current_sessions` folds the updates.

    * Messages of other chat types are dropped first, by a semi join with the
      static ``conversations``.
    * Each task collapses its messages by conversation and minute before the
      shuffle, so a conversation with a third of all messages sends one row a
      task and minute.
    * State per conversation: the sessions that a message may still reach (those
      of the last ``delay`` + gap) and two counters, which never expire: the
      numbering depends on them. An event-time timer closes sessions of
      conversations that fall silent. The conversations of a hash bucket
      share one row of the state store and one call a micro-batch; a stream
      with many millions of conversations wants more ``buckets``. A checkpoint
      keeps the number it was started with.
    * Messages without time or conversation are dropped, messages behind the
      watermark as well. Instants that tie belong to one session, as with
      ``sessionize(tie_break="id")``.
    """
    gap_us = int(gap_minutes * 60_000_000)
    piece_us = max(1, min(PIECE_SECONDS * 1_000_000, gap_us))
    chats = conversations.where(F.col("conversation_type") == chat_type).select(F.col("id").alias("conversation_id"))
    chat = messages.where("created_at IS NOT NULL").join(chats, "conversation_id", "left_semi")
    pieces = chat.select("conversation_id", "role", F.unix_micros("created_at").alias("t")).mapInPandas(
        _pieces(piece_us), "conversation_id string, first bigint, last bigint, users bigint, bots bigint, systems bigint")
    timed = pieces.withColumn("seen_at", F.timestamp_micros("last")).withWatermark("seen_at", delay)
    bucketed = timed.withColumn("bucket", F.pmod(F.hash("conversation_id"), F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInPandasWithState(
        _advance(gap_us, piece_us), _UPDATE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def current_sessions(updates: DataFrame, conversations: DataFrame) -> DataFrame:
    """The newest state of every session of :func:`session_updates`, with its chat's user and influencer."""
    keys = ["conversation_id", "session_index"]
    rest = [c for c in updates.columns if c not in keys]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_row")).select(*keys, "_row.*")
    chats = conversations.select(F.col("id").alias("conversation_id"), "user_id", "influencer_id")
    return newest.where("status <> 'gone'").drop("version").join(chats, "conversation_id")
