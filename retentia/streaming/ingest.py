"""Streaming ingest of tracker events: decode → parse → validate → write.

One Structured Streaming query replaces the poll/buffer/insert/commit loop:

* source: Kafka (``readStream.format("kafka")``) or a folder of text files
  (one record per line); values are base64 text (``encoding="base64"``) or
  raw UTF-8 bytes (``encoding="raw"``);
* decode (I1): ``try_to_binary(value, 'base64')`` + ``try_validate_utf8``:
  bad base64 or bad UTF-8 gives NULL, never a failed query;
* parse (I2): split the tab-separated line by a caller-given field list; the
  field count must match; empty fields are "not populated"; numbers and flags
  keep their type; context fields (``{"data": [{"schema": iglu-uri, "data":
  {...}}]}``) are expanded into ``contexts_<vendor>_<name>_<major>`` arrays, the
  self-describing event (``{"data": {"schema": ..., "data": {...}}}``) into one
  ``unstruct_event_<vendor>_<name>_<major>`` object;
* validate (I3): rows without event_id or a parseable collector_tstamp, or with
  text where a number or flag belongs, go to the dead-letter table with a reason;
* project (I4/I5): the typed raw_events columns ('' for missing strings,
  timestamps truncated to ms) plus the compact JSON payload;
* sink (I8/I11): ``foreachBatch`` writes the batch under
  ``ingest_run=<checkpoint>/ingest_batch=<id>/yyyymm=<month>``; a replayed batch
  id of the same checkpoint overwrites its own folder, so replay after a failure is idempotent, and offsets are committed
  by the checkpoint only after the write;
* deduplication (I9, optional): copies of an event that arrive within a given
  time of the first are dropped in the stream, from keyed state that expires;
* metrics (I12): ``observe`` on the stream plus one metrics row per batch.

Flush cadence (I6) is the trigger interval, backpressure (I7) the per-trigger
cap (``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger``).
"""

from __future__ import annotations

import time
import uuid
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import rocksdb_state
from ..model import BATCH_SECONDS, FIELD_TYPES, INGEST_BATCH_COL, INGEST_RUN_COL, MONTH_COL
from ..sources.raw_events import dedup

TYPED = ["event_id", "event_name", "app_id", "platform", "domain_userid", "domain_sessionid"]
CONTEXT_FIELDS = ("contexts", "derived_contexts")
EVENT_FIELD = "unstruct_event"
_CTX_SCHEMA = "data array<struct<schema string, data string>>"
_EVENT_SCHEMA = "data struct<schema string, data string>"
_ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def kafka_source(
    spark: SparkSession,
    servers: str,
    topic: str,
    starting_offsets: str = "latest",
    max_per_trigger: int | None = None,
    fail_on_data_loss: bool = True,
) -> DataFrame:
    """Kafka topic as a stream of ``value`` (binary). Needs the Kafka connector
    on the classpath. The first start reads from ``starting_offsets``; later
    starts resume from the checkpoint. Offsets that the topic no longer holds
    stop the query unless ``fail_on_data_loss`` is False. ``max_per_trigger``
    caps a micro-batch; without it each takes all that has arrived."""
    r = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
        .option("failOnDataLoss", str(fail_on_data_loss).lower())
    )
    if max_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_per_trigger)
    return r.load().select("value")


def file_source(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Folder of text files, one record per line, as a stream of ``value``."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(folder)


def decode(value: Column, encoding: str = "base64") -> Column:
    """Record value → UTF-8 line, NULL when undecodable (I1)."""
    if encoding == "base64":
        raw = F.try_to_binary(value.cast("string"), F.lit("base64"))
    elif encoding == "raw":
        raw = value.cast("binary")
    else:
        raise ValueError("encoding must be 'base64' or 'raw'")
    return F.try_validate_utf8(raw.cast("string"))


def _context_key(schema: Column) -> Column:
    """iglu:com.acme.app/mobile_context/jsonschema/1-0-2 → com_acme_app_mobile_context_1."""
    vendor = F.regexp_extract(schema, r"^iglu:([^/]+)/", 1)
    name = F.regexp_extract(schema, r"^iglu:[^/]+/([^/]+)/", 1)
    major = F.regexp_extract(schema, r"/(\d+)-\d+-\d+$", 1)
    snake = F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.concat_ws("_", F.regexp_replace(vendor, r"[.\-]", "_"), F.regexp_replace(snake, "-", "_"), major)


def _context_entries(texts: list[Column]) -> Column:
    """The entries of all context columns, each as its key ``k`` and its JSON ``d``."""
    entries = F.array()
    for text in texts:
        found = F.coalesce(F.from_json(text, _CTX_SCHEMA).getField("data"), F.array())
        entries = F.concat(entries, F.transform(found, lambda e: F.struct(_context_key(e["schema"]).alias("k"), e["data"].alias("d"))))
    return entries


def _context_pairs(entries: Column) -> Column:
    """JSON members ``"contexts_<key>":[{...},...]``, the entries under one key together. ``entries`` has
    to be a column of the rows: an expression here is computed again for every key."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.transform(
        keys,
        lambda k: F.concat(
            F.lit('"contexts_'),
            k,
            F.lit('":['),
            F.array_join(F.transform(F.filter(entries, lambda e: e["k"] == k), lambda e: e["d"]), ","),
            F.lit("]"),
        ),
    )


def _event_pair(e: Column) -> Column:
    """The JSON member ``"unstruct_event_<key>":{...}`` in an array, which is empty without one."""
    member = F.concat(F.lit(f'"{EVENT_FIELD}_'), _context_key(e["schema"]), F.lit('":'), e["data"])
    return F.array_compact(F.array(member))


def _typed(value: Column, kind: str) -> Column:
    """The value of a field of this type, NULL where the text is none; flags are ``1`` and ``0``."""
    if kind == "boolean":
        return F.when(value == "1", True).when(value == "0", False)
    return value.try_cast(kind)


def parse(lines: DataFrame, fields: list[str], line_col: str = "line", types: dict[str, str] = FIELD_TYPES) -> DataFrame:
    """Split lines into named string columns (I2) and build the payload (I4).

    Output columns: the decoded line, ``_ok_count`` (field count matches),
    ``_ok_values`` (every populated field of ``types`` reads as its type), one
    column per field (NULL when empty), ``collector_ts``/``derived_ts`` parsed
    timestamps, and ``event`` (JSON of the populated fields, numbers and flags
    by ``types``, contexts and the self-describing event expanded, timestamps
    in ISO-8601 UTC). A context or event that is no such JSON is left out.
    """
    parts = F.split(F.col(line_col), "\t", -1)
    cols = [F.nullif(F.get(parts, i), F.lit("")).alias(f) for i, f in enumerate(fields)]
    df = lines.select("*", (F.size(parts) == len(fields)).alias("_ok_count"), *cols)
    ts = {f: F.date_trunc("MILLISECOND", F.try_to_timestamp(F.col(f))) for f in fields if f.endswith("_tstamp")}
    typed = {f: _typed(F.col(f), types[f]) for f in fields if f in types}
    ok = F.lit(True)
    for f, value in typed.items():
        ok = ok & (F.col(f).isNull() | value.isNotNull())
    scalar = [
        (F.date_format(ts[f], _ISO_MS) if f in ts else typed.get(f, F.col(f))).alias(f)
        for f in fields
        if f not in CONTEXT_FIELDS and f != EVENT_FIELD
    ]
    read = df.select(
        "*",
        ts.get("collector_tstamp", F.lit(None).cast("timestamp")).alias("collector_ts"),
        ts.get("derived_tstamp", F.lit(None).cast("timestamp")).alias("derived_ts"),
        ok.alias("_ok_values"),
        F.to_json(F.struct(*scalar)).alias("_base"),
        _context_entries([F.col(f) for f in fields if f in CONTEXT_FIELDS]).alias("_entries"),
        (F.from_json(EVENT_FIELD, _EVENT_SCHEMA).getField("data") if EVENT_FIELD in fields else F.lit(None)).alias("_event"),
    )
    # Each JSON text is read once: what several expressions use is a column by itself.
    pairs = F.array().cast("array<string>")
    if any(f in CONTEXT_FIELDS for f in fields):
        pairs = F.concat(pairs, _context_pairs(F.col("_entries")))
    if EVENT_FIELD in fields:
        pairs = F.concat(pairs, _event_pair(F.col("_event")))
    base, pairs, joined = F.col("_base"), F.col("_pairs"), read.select("*", pairs.alias("_pairs"))
    payload = F.when(F.size(pairs) == 0, base).otherwise(
        F.concat(
            F.regexp_replace(base, r"\}$", ""),
            F.when(base == "{}", F.lit("")).otherwise(F.lit(",")),
            F.array_join(pairs, ","),
            F.lit("}"),
        )
    )
    return joined.select(*df.columns, "collector_ts", "derived_ts", payload.alias("event"), "_ok_values")


def dead_letter_reason(derived: Column) -> Column:
    """NULL for a good row, else why it was rejected (I3). An empty
    ``derived_tstamp`` is allowed, an unreadable one is not."""
    return (
        F.when(F.col("line").isNull(), "decode")
        .when(~F.col("_ok_count"), "field_count")
        .when(F.col("event_id").isNull(), "missing_event_id")
        .when(F.col("collector_tstamp").isNull(), "missing_collector_tstamp")
        .when(F.col("collector_ts").isNull(), "bad_collector_tstamp")
        .when(derived.isNotNull() & F.col("derived_ts").isNull(), "bad_derived_tstamp")
        .when(~F.col("_ok_values"), "bad_value")
    )


def prepare(values: DataFrame, fields: list[str], encoding: str = "base64") -> DataFrame:
    """Stream of ``value`` → parsed rows with ``_reason`` (NULL = good)."""
    lines = values.select(F.col("value").cast("string").alias("value"), decode(F.col("value"), encoding).alias("line"))
    parsed = parse(lines, fields)
    derived = F.col("derived_tstamp") if "derived_tstamp" in fields else F.lit(None).cast("string")
    return parsed.withColumn("_reason", dead_letter_reason(derived))


def first_copies(rows: DataFrame, remember: str) -> DataFrame:
    """Parsed rows without the copies of an event that arrive up to ``remember``
    (such as ``"2 days"``) after its first one; rejected rows all pass.

    The watermark runs on the arrival time, which is one instant for each
    micro-batch, and not on the event's own time. No row is ever late for it,
    so an event passes however old it is, while a key leaves the state once
    ``remember`` has gone by: the state holds the keys of that time and no more. A copy
    that comes later is stored again and left to the dedup view, as are copies
    from other checkpoints. Which copy of one micro-batch passes is open; a
    rejected row has a key of its own (a random one), since it has no event id.
    """
    own = F.when(F.col("_reason").isNotNull(), F.expr("uuid()"))
    arrived = rows.select("*", F.current_timestamp().alias("_arrived"), own.alias("_own")).withWatermark("_arrived", remember)
    first = arrived.dropDuplicatesWithinWatermark(["collector_ts", "event_name", "event_id", "_own"])
    return first.drop("_arrived", "_own")


def to_raw_events(good: DataFrame, *more: Column) -> DataFrame:
    """Typed raw_events projection (I4/I5) + month partition column (I11), then ``more`` columns."""
    missing = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in good.columns else F.lit("").alias(c) for c in TYPED]
    return good.select(
        missing[0],
        missing[1],
        F.col("collector_ts").alias("collector_tstamp"),
        F.col("derived_ts").alias("derived_tstamp"),
        *missing[2:],
        "event",
        F.date_format("collector_ts", "yyyyMM").cast("int").alias(MONTH_COL),
        *more,
    )


# about one file per micro-batch at the default per-trigger cap (20,000 rows),
# several parallel writers for a large catch-up batch
ROWS_PER_FILE = 50_000


def run_key(spark: SparkSession, checkpoint: str) -> str:
    """The name under which a checkpoint's batches are stored, kept inside it.

    Made once for each checkpoint from the time and a random part. It lives and
    goes with the checkpoint: whoever starts over, at a new path or at the old
    one after the folder was lost, writes into folders of its own and never
    over stored rows, and its rows count as newer. Written aside and renamed,
    so a crash leaves no empty key.
    """
    jvm = spark._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    path = Path(f"{checkpoint.rstrip('/')}/ingest-run")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path.getParent())
        aside = Path(f"{path}-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}".encode()))
        out.close()
        if fs.exists(path) or not fs.rename(aside, path):
            fs.delete(aside, False)
    f = fs.open(path)
    try:
        return bytes(f.readAllBytes()).decode()
    finally:
        f.close()


def write_batch(
    batch: DataFrame, batch_id: int, sink: str, dead_letter: str, metrics: str, rows_per_file: int | None = None,
    run: str = "0", dedup_batch: bool = False,
) -> None:
    """Idempotent per-batch write: every output lives under its run and batch
    id and is overwritten on replay. ``dedup_batch`` stores one row per key of
    the batch, chosen by the rule of the dedup view. The good rows are written in about one file per
    ``rows_per_file`` rows, not one small file per input partition. The batch is
    cached for that, as the columns that are stored only: one pass makes and
    counts it, one writes the good rows, and one the rejected rows if there are any."""
    place = f"{INGEST_RUN_COL}={run}/{INGEST_BATCH_COL}={batch_id}"
    bad = F.col("_reason").isNotNull()
    rows = to_raw_events(batch, F.col("_reason"), F.when(bad, F.col("value")).alias("value")).persist()
    try:
        counts = rows.agg(
            F.count(F.lit(1)).alias("input_rows"), F.count_if(~bad).alias("inserted"), F.count_if(bad).alias("parse_errors")).first()
        files = max(1, -(-counts["inserted"] // (rows_per_file or ROWS_PER_FILE)))  # coalesce never raises the count
        good = rows.where(~bad).drop("_reason", "value")
        (
            (dedup(good) if dedup_batch else good)
            .coalesce(files)
            .sortWithinPartitions("collector_tstamp", "event_name", "event_id")
            .write.mode("overwrite")
            .partitionBy(MONTH_COL)
            .parquet(f"{sink}/{place}")
        )
        (
            rows.where(bad if counts["parse_errors"] else F.lit(False))
            .select("value", F.col("_reason").alias("reason"))
            .write.mode("overwrite")
            .parquet(f"{dead_letter}/{place}")
        )
        (
            batch.sparkSession.range(1)
            .select(
                F.lit(batch_id).cast("long").alias("batch_id"),
                *[F.lit(n).cast("long").alias(c) for c, n in counts.asDict().items()],
                F.current_timestamp().alias("written_at"),
            )
            .coalesce(1)
            .write.mode("overwrite")
            .parquet(f"{metrics}/{place}")
        )
    finally:
        rows.unpersist()


def start_ingest(
    values: DataFrame,
    fields: list[str],
    sink: str,
    dead_letter: str,
    metrics: str,
    checkpoint: str,
    encoding: str = "base64",
    trigger_seconds: int | None = BATCH_SECONDS,
    available_now: bool = False,
    dedup_batch: bool = False,
    remember: str | None = None,
):
    """Start the ingest query. ``dedup_batch`` collapses copies inside each
    micro-batch before writing; copies across batches are resolved by the
    dedup view, so no event is dropped for being late. ``remember`` drops
    copies across micro-batches too (``first_copies``); the metrics rows then
    count what is left, the observed ones what came in. A checkpoint keeps the
    choice it was started with."""
    rows = prepare(values, fields, encoding)
    rows = rows.observe(
        "ingest",
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(F.col("_reason").isNull()).alias("good_rows"),
        F.count_if(F.col("_reason").isNotNull()).alias("bad_rows"),
    )
    if remember:
        rocksdb_state(values.sparkSession)
        rows = first_copies(rows, remember)
    run = run_key(values.sparkSession, checkpoint)
    w = rows.writeStream.foreachBatch(
        lambda df, bid: write_batch(df, bid, sink, dead_letter, metrics, run=run, dedup_batch=dedup_batch)
    ).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


class IngestProgress:
    """Driver-side ingest health (the consumer's /health counters): collects
    one record per micro-batch from the query's progress events — batch id,
    input rows, good/bad rows from the ``observe`` metrics, batch duration —
    for a status page or a small table (``to_df``), the last ``keep`` of them."""

    def __init__(self, spark: SparkSession, query_name_or_id: str | None = None, keep: int = 1_000):
        from pyspark.sql.streaming import StreamingQueryListener

        self.records: deque[dict] = deque(maxlen=keep)
        outer = self

        class _Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                p = event.progress
                if query_name_or_id and query_name_or_id not in (p.name, str(p.id)):
                    return
                obs = p.observedMetrics.get("ingest") if p.observedMetrics else None
                outer.records.append(
                    {
                        "batch_id": int(p.batchId),
                        "input_rows": int(p.numInputRows),
                        "good_rows": int(obs["good_rows"]) if obs is not None else None,
                        "bad_rows": int(obs["bad_rows"]) if obs is not None else None,
                        "duration_ms": int(p.batchDuration),
                        "timestamp": p.timestamp,
                    }
                )

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                pass

        self.spark = spark
        self.listener = _Listener()
        spark.streams.addListener(self.listener)

    def stop(self) -> None:
        self.spark.streams.removeListener(self.listener)

    def to_df(self) -> DataFrame:
        schema = "batch_id long, input_rows long, good_rows long, bad_rows long, duration_ms long, timestamp string"
        return self.spark.createDataFrame([tuple(r.values()) for r in self.records], schema)
