"""The event store by days: ingest batches merged into one deduplicated folder a day.

The stream appends batches (``ingest_run=…/ingest_batch=…``), which is what
makes its writes idempotent, and leaves many small folders. ``compact`` merges
the finished batches that no commit has absorbed into the folders of the days
they touch: those days' rows and the new ones, one copy of each event, by the
rule of the dedup view. One commit names the days' new folders and the batches
they hold, so a reader sees an event from its batch or from its day, and never
misses it. Run and batch stay with the rows: a copy that arrives later meets
the stored one under the same rule.

* A run reads and writes only the days that new batches touch, usually the
  last few; a month never holds more than its days' folders.
* A day that holds a third of all rows is read by many tasks, deduplicated by
  an aggregation on the event's key, and written as several files.
* Expiry takes days out of the commit; ``vacuum`` deletes what only old commits
  name, and the batches that every kept commit has absorbed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EVENT_TTL_DAYS, INGEST_BATCH_COL, INGEST_RUN_COL, RAW_EVENTS_SCHEMA
from .commits import CommitLog
from .keyed import KeyedTable
from .raw_events import DEDUP_KEY, dedup

STORED = T.StructType(
    [*RAW_EVENTS_SCHEMA.fields, T.StructField(INGEST_RUN_COL, T.StringType()), T.StructField(INGEST_BATCH_COL, T.LongType())])
DAY = "day"


def _first_whole_day(as_of, ttl_days: int) -> str:
    """The oldest day that may hold an event inside the TTL at a literal instant (UTC)."""
    now = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))
    return (now.replace(microsecond=0) - dt.timedelta(days=ttl_days) + dt.timedelta(seconds=1)).date().isoformat()


class EventStore:
    def __init__(self, spark: SparkSession, ingested: str, base: str):
        self.spark, self.ingested = spark, ingested.rstrip("/")
        self.days = KeyedTable(spark, base, STORED, DAY)
        self._batches = CommitLog(spark, self.ingested)

    def batches(self) -> list[str]:
        """Finished batches that lie in the ingest folder, as run/batch."""
        found = [f"{run}/{batch}" for run, _ in self._batches.folders() if run.startswith(f"{INGEST_RUN_COL}=")
                 for batch, _ in self._batches.folders(run) if batch.startswith(f"{INGEST_BATCH_COL}=")]
        return [b for b in found if self._batches.fs.exists(self._batches.path(b, "_SUCCESS"))]

    def _pending(self, absorbed: list[str]) -> list[str]:
        gone = set(absorbed)
        return [b for b in self.batches() if b not in gone]

    def _raw(self, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], STORED)
        read = self.spark.read.schema(STORED).option("basePath", self.ingested).parquet(*[f"{self.ingested}/{b}" for b in batches])
        return read.select(*STORED.fieldNames())

    def read(self, as_of=None, ttl_days: int = EVENT_TTL_DAYS) -> DataFrame:
        """Stored days and batches not yet absorbed: what ``event_view`` takes.
        With a literal ``as_of``, days past the TTL are not opened."""
        manifest = self.days.manifest(version := self.days.latest_version())
        keys = [d for d in manifest["folders"] if as_of is None or d >= _first_whole_day(as_of, ttl_days)]
        pending = self._pending(manifest["state"].get("absorbed", []))
        return self.days.read(keys, version).unionByName(self._raw(pending))

    def compact(self) -> dict | None:
        """Absorb all finished batches; returns the commit's state, or None if there were none."""
        state = self.days.state()
        present = self.batches()
        pending = self._pending(state.get("absorbed", []))
        if not pending:
            return None
        day = F.date_format("collector_tstamp", "yyyy-MM-dd").alias(DAY)
        fresh = self._raw(pending)
        touched = sorted(r[DAY] for r in fresh.select(day).distinct().collect())  # one row a day
        merged = dedup(self.days.read(touched).unionByName(fresh), origin=True)
        # Batches that are deleted need no mention any more.
        absorbed = sorted([b for b in state.get("absorbed", []) if b in set(present)] + pending)
        state = {"absorbed": absorbed, "merged": len(pending), "days": len(touched)}
        version = self.days.replace(merged.select("*", day), touched, state, DEDUP_KEY)
        return {"version": version, **state}

    def expire(self, as_of, ttl_days: int = EVENT_TTL_DAYS) -> list[str]:
        """Commit the store without the days whose every event is past the TTL; returns them."""
        first = _first_whole_day(as_of, ttl_days)
        old = sorted(d for d in self.days.manifest()["folders"] if d < first)
        if old:
            self.days.drop(old, self.days.state())
        return old

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that no kept commit names, and batches that all of them hold."""
        n = self.days.vacuum(keep)
        held = [set(self.days.manifest(v)["state"].get("absorbed", [])) for v in self.days.log.versions()]
        gone = set.intersection(*held) & set(self.batches()) if held else set()
        for b in gone:
            self._batches.delete(b)
        return n + len(gone)
