"""The sessions refresh whose cost follows the change.

Messages arrive as a stream; its offsets, kept by the checkpoint, say what is
new. Nothing depends on a high-water mark, so a message is picked up however
old its time is. Both tables are bucketed by ``pmod(xxhash64(conversation_id),
buckets)``:

* each micro-batch appends its messages to the folders of their buckets;
* the conversations it touches are sessionized again from their full history,
  read from the touched buckets alone;
* a commit replaces the touched buckets of the sessions table and takes over
  the folders of all others.

No message, no batch: an idle hour publishes nothing. Both commits carry the
run and batch that made them, so a batch that is run again after a failure is
neither appended nor replaced twice. After a lost checkpoint the source brings
everything again; messages that are already stored are then left out by id.

A bucket that a hot conversation fills is read by many tasks (its files split)
and sessionized by slices of time, like any other. Folders of a bucket are
merged once there are more than ``MERGE_AT`` of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MESSAGES_SCHEMA, SESSIONS_SCHEMA
from ..operators import sessions as S
from ..sources.keyed import KeyedTable
from ..sources.snapshots import count_on_write
from ..streaming.ingest import run_key
from .refresh import BROADCAST_SCOPE_MAX, SORT

#: Buckets of a new table. More buckets: less is read and written for a small change.
BUCKETS = 256
#: Message folders of a bucket beyond which they are merged into one.
MERGE_AT = 24


class BucketedSessions:
    """The sessions table of one application, with the bucketed messages it is built from."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS, broadcast_scope_max: int = BROADCAST_SCOPE_MAX, **sessionize_args):
        self.spark, self.broadcast_scope_max, self.args = spark, broadcast_scope_max, sessionize_args
        self.messages = KeyedTable(spark, f"{base.rstrip('/')}/messages", MESSAGES_SCHEMA, "bucket")
        self.sessions = KeyedTable(spark, f"{base.rstrip('/')}/sessions", SESSIONS_SCHEMA, "bucket")
        self.buckets = self.messages.state().get("buckets", buckets)  # a table keeps the number it began with

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.expr(f"pmod(xxhash64(conversation_id), {self.buckets})").cast("int"))

    def read(self) -> DataFrame:
        return self.sessions.read()

    def refresh(self, source: DataFrame, conversations, checkpoint: str) -> list[dict]:
        """Take in all messages that ``source`` (a stream) has beyond the checkpoint.

        ``conversations`` is the table or a function that reads it afresh.
        Returns one entry per commit: version, batch, conversations touched,
        session rows recomputed, buckets written. No new message: no entry.
        """
        run, before = run_key(self.spark, checkpoint), self.sessions.latest_version() or 0
        query = source.writeStream.foreachBatch(lambda df, n: self._absorb(df, n, run, conversations)).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return [{"version": v, **self.sessions.manifest(v)["state"]} for v in self.sessions.log.versions() if v > before]

    def _absorb(self, batch: DataFrame, number: int, run: str, conversations) -> None:
        mark = {"run": run, "batch": number, "buckets": self.buckets}
        done = self.sessions.state()
        if done.get("run") == run and done["batch"] >= number:
            return
        new = self._bucketed(batch.select(*MESSAGES_SCHEMA.fieldNames())).persist()
        scope = new.select("conversation_id", "bucket").distinct().persist()
        try:
            touched = [r.bucket for r in scope.select("bucket").distinct().collect()]  # at most one row per bucket
            if not touched:
                return
            self._store(new, touched, mark)
            n = scope.count()
            ids = scope.select("conversation_id")
            ids = F.broadcast(ids) if n <= self.broadcast_scope_max else ids
            table = conversations() if callable(conversations) else conversations
            table = table.join(ids.withColumnRenamed("conversation_id", "id"), "id", "left_semi")
            fresh, counted = count_on_write(S.sessionize(self.messages.read(touched), table, scope=ids, **self.args))
            kept = self.sessions.read(touched).join(ids, "conversation_id", "left_anti")
            self.sessions.replace(
                self._bucketed(kept.unionByName(fresh)), touched, {**mark, "conversations": n, "touched": len(touched)}, SORT,
                counted=lambda: {"rows": int(counted.get["rows"])})
        finally:
            scope.unpersist()
            new.unpersist()

    def _store(self, new: DataFrame, touched: list[int], mark: dict) -> None:
        """Append the batch to the message store, once."""
        state = self.messages.state()
        if state.get("run") == mark["run"] and state["batch"] >= mark["batch"]:
            return
        runs = state.get("runs", [])
        if any(r != mark["run"] for r in runs):  # an earlier run may have stored some of them
            new = new.join(self.messages.read(touched).select("id"), "id", "left_anti")
        mark = {**mark, "runs": runs if mark["run"] in runs else [*runs, mark["run"]]}
        full = [k for k, f in self.messages.manifest()["folders"].items() if int(k) in touched and len(f) >= MERGE_AT]
        if full:
            merged = self._bucketed(self.messages.read(full))
            self.messages.replace(merged, full, state)
        self.messages.append(new, mark, ["conversation_id", "created_at"])

