"""Session helpers shared by every operator.

All operators assume ``spark.sql.session.timeZone = UTC``: the source data
stores naive UTC wall-clock times and every window ("today", "last 7 days",
Monday weeks) is a UTC window. ``ensure_utc`` pins it on whatever session the
caller hands us.
"""

from __future__ import annotations

import datetime as _dt
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_utc(spark: SparkSession) -> SparkSession:
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: int | str = "*", app: str = "retentia", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench (cluster jobs get theirs from spark-submit)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return ensure_utc(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared folder (HDFS/object store) and is
    only read here. A fresh temporary folder is set only when it is unset,
    which happens in local tests; on a cluster that is an error, because a
    machine-local folder is lost with its machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="retentia-ckpt-", dir=os.environ.get("RETENTIA_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 - no SparkContext on a Spark Connect session
        pass
    return d


def rocksdb_state(spark: SparkSession) -> SparkSession:
    """Keeps the state of streams started from now on in RocksDB (on the executors' disks, changes in the checkpoint)
    unless the session names another provider than the default: large keyed state does not fit the default one's heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(key):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def ts_lit(value: str | _dt.datetime | _dt.date | Column | None) -> Column:
    """An ``as_of`` instant as a TIMESTAMP column (UTC session).

    ``None`` means "now", like the reference's ``now()``; strings and naive
    datetimes are read as UTC wall-clock time.
    """
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        value = value.isoformat() + " 00:00:00"
    return F.lit(str(value)).cast("timestamp")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an under-partitioned input across the cluster's cores.

    A large unsplittable file (one parquet row group) scans as one task and
    everything before the first shuffle — JSON parsing included — then runs
    on one core. Only when the scan has fewer partitions than the default
    parallelism is it spread; a normal multi-file input is left untouched, so
    at scale this adds no shuffle.

    Apply it to a plain scan only: asking a plan that already contains a
    shuffle for its partition count makes adaptive execution run that shuffle.
    """
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - Spark Connect has no RDD view: leave the plan as is
        return df
    return df.repartition(target) if parts < target else df
