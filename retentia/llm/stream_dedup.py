"""Exact deduplication as a stream: keyed state on disk, without expiry, and a check of full bytes on hits.

Method: documents arrive as a stream of files. A streaming aggregation keeps,
for every digest ever seen, the size of the group, the identifier of the row
that stays, and the content locator (file and row) of one holder of the text.
The state lives in RocksDB on the executors' disks, with its changes in the
checkpoint folder, has no watermark and never expires, so a copy is found
however late it comes and whatever was restarted in between. Each micro-batch
writes the groups that it touched; ``decisions`` reads the last word on each.

A digest only nominates. On a hit the text at the group's locator is fetched
and compared byte by byte with the row's own; rows that differ (a collision)
are grouped anew by their full bytes.

* The aggregation combines map-side, so a text that a third of all rows hold
  reaches its state as one row per task; texts themselves are not shuffled by
  the stream. The fetch moves the texts of groups of two or more only: one per
  group, and each copy to the join with it, a plain equi-join whose skewed
  partitions Spark splits.
* A row is known by its locator, so repeated rows and ids, and null ids, stay
  rows of their own.

Results in the odd cases: a null text counts as empty; empty and blank texts
are one group. The row with the most code points stays, then the smallest id
(null ids last), then the first place in the files. A text of any length is
one row. An empty table gives no rows. Columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_in, saved

#: What is deleted before texts are compared: the ASCII white space.
BLANKS = r"[\\x20\\x09-\\x0D]"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Batches upload what they changed, and a store takes the disk that it fills, not 4 MB ahead.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Files that one micro-batch takes.
FILES_A_BATCH = 64

NORMAL = f"regexp_replace(coalesce(text, ''), '{BLANKS}', '')"
SHA256 = f"unhex(sha2({NORMAL}, 256))"


@contextmanager
def _settings(spark: SparkSession, new: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def located(docs: DataFrame, digest: str = SHA256) -> DataFrame:
    """(digest, doc_id, text, points, file, row) of documents read from files, batch or stream."""
    return docs.select(
        F.expr(digest).alias("digest"), "doc_id", "text", F.expr("cast(char_length(coalesce(text, '')) AS bigint) AS points"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _rank() -> Column:
    """Least for the row that stays: most code points, smallest id, first place."""
    return F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")


def absorb(stream: DataFrame, folder: str, digest: str = SHA256) -> None:
    """Take in everything that ``stream`` (files of documents) holds and ``folder`` has not seen.

    ``folder`` keeps the state and the groups between calls; a batch that is
    run again after a failure overwrites its own output.
    """
    groups = located(stream, digest).groupBy("digest").agg(
        F.count("*").alias("size"), F.min(_rank()).alias("best"), F.min(F.struct("file", "row")).alias("at"))

    def store(touched: DataFrame, batch: int) -> None:
        touched.write.mode("overwrite").parquet(f"{folder}/groups/batch={batch}")

    with _settings(stream.sparkSession, STATE):
        query = groups.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()


def groups(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, size, best, at): the state's last word on each digest."""
    every = spark.read.parquet(f"{folder}/groups").groupBy("digest").agg(F.max_by(F.struct("size", "best", "at"), "batch").alias("g"))
    return every.select("digest", "g.*")


def decisions(docs: DataFrame, known: DataFrame, digest: str = SHA256) -> DataFrame:
    """One row per document of ``docs`` (batch, the same files): (doc_id, keep_id, group_size, kept, text_sha256)."""
    rows = located(docs, digest).withColumn("normal", F.expr(NORMAL))
    shared = saved(known.filter("size > 1"), "dedup-groups")
    # The text at each shared digest's locator.
    held = rows.filter(maybe_in(shared.select(F.expr("hash(at.row, at.file) AS h")), "h", "hash(row, file)")).select("file", "row", F.col("normal").alias("text_at"))
    fetched = shared.join(held, (F.col("at.file") == F.col("file")) & (F.col("at.row") == F.col("row"))).select("digest", "size", "best", "text_at")
    candidate = maybe_in(shared.select("digest"), "digest", "digest")
    own = rows.select(
        "digest", "doc_id", "file", "row", "points", F.when(candidate, F.col("normal")).alias("normal"),
        (F.expr(SHA256) if digest != SHA256 else F.col("digest")).alias("sha"))
    hit = own.join(fetched.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left")
    checked = saved(hit.select(
        "digest", "doc_id", "file", "row", "points", "sha", F.coalesce("size", F.lit(1)).alias("size"), "best",
        F.expr("CASE WHEN text_at <> normal THEN normal END AS other")), "dedup-checked")
    single = F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    out = checked.withColumn("best", F.coalesce("best", single))
    clash = checked.filter("other IS NOT NULL").select("digest").distinct()
    if not clash.isEmpty():  # texts that share a digest: their groups by full bytes instead
        apart = out.drop("size", "best").join(clash, "digest", "left_semi")
        real = apart.groupBy("digest", "other").agg(F.count("*").alias("size"), F.min(_rank()).alias("best")).withColumnsRenamed({"digest": "d", "other": "o"})
        apart = apart.join(real, (F.col("digest") == F.col("d")) & F.col("other").eqNullSafe(F.col("o")))
        out = out.join(clash, "digest", "left_anti").select(*out.columns).unionByName(apart.select(*out.columns))
    return out.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").cast("long").alias("group_size"),
        ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def document_stream(spark: SparkSession, path: str, files: int = FILES_A_BATCH) -> DataFrame:
    """The documents at ``path``, one file or a folder of them, as a stream of Parquet files."""
    as_pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a plain path for a folder, a pattern for either
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(as_pattern)
