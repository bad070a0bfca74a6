"""Numbered commits: the one file operation that makes new data visible.

A commit is a small text file ``_commits/<n>``, written aside and renamed, so
it is whole or absent. Of two writers of one number one wins; the other gets
``CommitConflict``. Once the rename has been done nothing is ever taken back:
an error after it leaves the commit in force.

A rename is atomic on HDFS and local disks. Object stores copy and delete
instead, so there two writers of one table must be kept apart by the scheduler
(one refresh job at a time), as the source's single hourly loop did.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer made this commit; whatever was written for it is unused."""


class CommitLog:
    def __init__(self, spark: SparkSession, base: str):
        jvm = spark._jvm
        self.base = base.rstrip("/")
        self.Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *names) -> object:
        return self.Path("/".join([self.base, *map(str, names)]))

    def versions(self) -> list[int]:
        folder = self.path("_commits")
        if not self.fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(folder) if s.getPath().getName().isdigit())

    def latest(self) -> int | None:
        v = self.versions()
        return v[-1] if v else None

    def read(self, version: int) -> str:
        f = self.fs.open(self.path("_commits", version))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def commit(self, version: int, content: str) -> None:
        mine, target = self.path("_commits", f"_{uuid.uuid4().hex}"), self.path("_commits", version)
        self.fs.mkdirs(self.path("_commits"))
        f = self.fs.create(mine, False)
        f.write(bytearray(content.encode()))
        f.close()
        if self.fs.exists(target) or not self.fs.rename(mine, target):
            self.fs.delete(mine, False)
            raise CommitConflict(f"version {version} was published by another writer")
        try:
            found = self.read(version)
        except Exception:  # noqa: BLE001 - the rename is done: unreadable just now is not undone
            return
        if found != content:
            raise CommitConflict(f"version {version} was published by another writer")

    def forget(self, version: int) -> None:
        self.fs.delete(self.path("_commits", version), False)

    def folders(self, *names) -> list[tuple[str, int]]:
        """(name, time of change in ms) of the folders below ``names``."""
        at = self.path(*names) if names else self.Path(self.base)
        if not self.fs.exists(at):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(at) if s.isDirectory()]

    def files(self, *names) -> int:
        """How many data files lie below ``names``."""
        at = self.path(*names) if names else self.Path(self.base)
        if not self.fs.exists(at):
            return 0
        return sum(s.isFile() and not s.getPath().getName().startswith(("_", ".")) for s in self.fs.listStatus(at))

    def delete(self, *names) -> None:
        self.fs.delete(self.path(*names), True)
