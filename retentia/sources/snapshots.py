"""Versioned parquet table with atomic publish (the sessions table).

Layout under ``base``::

    v=<n>-<uuid>/...parquet  one full snapshot, written by one publisher
    _commits/<n>             names the folder that is version n

Readers take the highest commit and the folder it names, so they see the old
or the new table, never a mix, and never a half-written folder. A publisher
writes a folder of its own and then commits it (see ``commits``): of two concurrent
refreshers one wins, the other fails, deletes its folder and leaves the
readers' table as it is. A missing table reads as empty
with the declared schema.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..context import ensure_utc
from .commits import CommitConflict, CommitLog


class SnapshotTable:
    def __init__(self, spark: SparkSession, base: str, schema: StructType):
        self.spark = ensure_utc(spark)
        self.base = base.rstrip("/")
        self.schema = schema
        self.log = CommitLog(spark, self.base)

    def versions(self) -> list[int]:
        return self.log.versions()

    def latest_version(self) -> int | None:
        return self.log.latest()

    def read(self, version: int | None = None) -> DataFrame:
        v = self.latest_version() if version is None else version
        if v is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/{self.log.read(v)}")

    def publish(self, df: DataFrame, sort_by: list[str] | None = None) -> int:
        """Write ``df`` as the next version and commit it; returns the version.

        Only a writer that certainly lost deletes its folder. After any other
        error the folder stays: it may have been committed. ``sweep`` removes
        what no commit names.
        """
        v = (self.latest_version() or 0) + 1
        out = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        if sort_by:
            out = out.sortWithinPartitions(*sort_by)
        folder = f"v={v}-{uuid.uuid4().hex}"
        out.write.parquet(f"{self.base}/{folder}")
        try:
            self.log.commit(v, folder)
        except CommitConflict:
            self.log.delete(folder)
            raise
        return v

    def ensure(self) -> int:
        """Idempotent create: publish an empty snapshot with the declared schema
        when the table has no version yet, so readers find a table from the
        start. Returns the latest version."""
        v = self.latest_version()
        if v is None:
            v = self.publish(self.spark.createDataFrame([], self.schema))
        return v

    def vacuum(self, keep: int = 3) -> list[int]:
        """Delete all but the newest ``keep`` committed versions: the commit first,
        so that no reader is sent to a folder that is going, then its data."""
        old = self.versions()[:-keep] if keep > 0 else []
        for v in old:
            folder = self.log.read(v)
            self.log.forget(v)
            self.log.delete(folder)
        return old

    def sweep(self, older_than_hours: float = 24) -> list[str]:
        """Delete folders of crashed publishers: named by no commit and older
        than any publish takes."""
        named = {self.log.read(v) for v in self.versions()}
        before = (time.time() - older_than_hours * 3600) * 1000
        gone = [f for f, t in self.log.folders() if f.startswith("v=") and f not in named and t <= before]
        for f in gone:
            self.log.delete(f)
        return gone


def count_on_write(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Attach a row counter that is filled in by the write itself (no second pass)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
