"""A table in folders per key, with atomic commits that name each key's folders.

Layout under ``base``::

    data/<id>/<key>=<value>/...parquet   what one write has put under a key
    _commits/<n>                          {"folders": {value: [...]}, "state": {...}}

A write touches the folders of its own keys only; the commit takes over the
names of all others. Keys are few and bounded (buckets, days), so a commit is a
short text. Readers open the folders of the keys they ask for: pruning needs no
statistics. ``state`` carries what the writer has to remember with the data
(the stream's batch, what was absorbed), under the same commit.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..context import ensure_utc
from .commits import CommitConflict, CommitLog


class KeyedTable:
    def __init__(self, spark: SparkSession, base: str, schema: StructType, key: str):
        self.spark = ensure_utc(spark)
        self.base = base.rstrip("/")
        self.schema, self.key = schema, key
        self.log = CommitLog(spark, self.base)

    def latest_version(self) -> int | None:
        return self.log.latest()

    def manifest(self, version: int | None = None) -> dict:
        v = self.latest_version() if version is None else version
        return {"folders": {}, "state": {}} if v is None else json.loads(self.log.read(v))

    def state(self) -> dict:
        return self.manifest()["state"]

    def read(self, keys: Iterable | None = None, version: int | None = None) -> DataFrame:
        """Rows of the given keys (all by default), without the key column."""
        folders = self.manifest(version)["folders"]
        wanted = folders if keys is None else [str(k) for k in keys if str(k) in folders]
        paths = [f"{self.base}/{f}" for k in wanted for f in folders[k]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame, keys: Iterable, state: dict, sort_by: list[str] | None = None, counted: Callable[[], dict] = dict) -> int:
        """Commit ``df`` (with the key column) as all rows of ``keys``; a key without rows is empty then.
        ``counted`` gives entries of the state that the write itself has counted."""
        return self._publish(df, {str(k) for k in keys}, state, sort_by, counted)

    def append(self, df: DataFrame, state: dict, sort_by: list[str] | None = None) -> int:
        """Commit ``df`` as more rows of the keys it holds."""
        return self._publish(df, set(), state, sort_by)

    def drop(self, keys: Iterable, state: dict) -> int:
        """Commit the table without ``keys``; ``vacuum`` deletes their folders."""
        return self._publish(None, {str(k) for k in keys}, state, None)

    def _publish(self, df: DataFrame | None, replaced: set[str], state: dict, sort_by: list[str] | None, counted: Callable[[], dict] = dict) -> int:
        v = self.latest_version()
        folders = self.manifest(v)["folders"] if v else {}
        folders = {k: f for k, f in folders.items() if k not in replaced}
        part = f"data/{uuid.uuid4().hex}"
        if df is not None:
            out = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], self.key)
            # Rows of a key meet in few files, and a large key is split into several.
            out = out.hint("rebalance", F.col(self.key)).sortWithinPartitions(self.key, *(sort_by or []))
            out.write.partitionBy(self.key).parquet(f"{self.base}/{part}")
            for name, _ in self.log.folders(part):
                if name.startswith(f"{self.key}="):
                    value = name.split("=", 1)[1]
                    folders[value] = [*folders.get(value, []), f"{part}/{name}"]
        try:
            self.log.commit((v or 0) + 1, json.dumps({"folders": folders, "state": {**state, **counted()}}))
        except CommitConflict:
            self.log.delete(part)
            raise
        return (v or 0) + 1

    def vacuum(self, keep: int = 3) -> int:
        """Forget all but the newest ``keep`` commits, then delete the folders that
        only they named; returns the number of folders."""
        versions = self.log.versions()
        old, new = (versions[:-keep], versions[-keep:]) if keep > 0 else ([], versions)
        names = lambda vs: {f for v in vs for fs in self.manifest(v)["folders"].values() for f in fs}
        gone = names(old) - names(new)
        for v in old:
            self.log.forget(v)
        for f in gone:
            self.log.delete(f)
        return len(gone)

    def sweep(self, older_than_hours: float = 24) -> int:
        """Delete writes that no commit names and that are older than any write takes."""
        named = {f.split("/")[1] for v in self.log.versions() for fs in self.manifest(v)["folders"].values() for f in fs}
        before = (time.time() - older_than_hours * 3600) * 1000
        gone = [f for f, t in self.log.folders("data") if f not in named and t <= before]
        for f in gone:
            self.log.delete("data", f)
        return len(gone)
