import base64
import json

from pyspark.sql import functions as F

from retentia.model import TEST_TSV_FIELDS
from retentia.sources import raw_events as rawv
from retentia.streaming import ingest

CTX = json.dumps(
    {
        "schema": "iglu:com.snowplowanalytics.snowplow/contexts/jsonschema/1-0-0",
        "data": [{"schema": "iglu:com.snowplowanalytics.mobile/client_session/jsonschema/1-0-2", "data": {"userId": "u7"}}],
    }
)


def line(event_id="e1", ts="2024-01-05 10:00:00.123", user="", action="click", ctx=""):
    vals = [event_id, "event", ts, ts, "app", "mob", "", "", user, "cat", action, "", ctx]
    assert len(vals) == len(TEST_TSV_FIELDS)
    return "\t".join(vals)


def b64(s: str | bytes) -> str:
    return base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()


def run(spark, tmp_path, records, name="in", checkpoint=None, **how):
    src = tmp_path / name
    src.mkdir(exist_ok=True)
    (src / f"part-{len(list(src.iterdir()))}.txt").write_text("\n".join(records) + "\n")
    out = {k: str(tmp_path / k) for k in ("raw", "dead", "metrics")}
    q = ingest.start_ingest(
        ingest.file_source(spark, str(src)), TEST_TSV_FIELDS, out["raw"], out["dead"], out["metrics"],
        checkpoint or str(tmp_path / "ckpt"), available_now=True, **how,
    )
    q.awaitTermination()
    return q, out


def test_progress_listener(spark, tmp_path):
    import time

    progress = ingest.IngestProgress(spark)
    try:
        run(spark, tmp_path, [b64(line("e1")), "junk"])
        for _ in range(50):  # listener events arrive asynchronously
            if any(r["input_rows"] for r in progress.records):
                break
            time.sleep(0.1)
    finally:
        progress.stop()
    rows = [r for r in progress.records if r["input_rows"]]
    assert rows and rows[0]["input_rows"] == 2 and rows[0]["good_rows"] == 1 and rows[0]["bad_rows"] == 1
    assert progress.to_df().count() == len(progress.records)


def test_good_and_dead_letter_rows(spark, tmp_path):
    records = [
        b64(line("e1", user="alice")),
        b64(line("e2", ctx=CTX)),
        "!!!not-base64",
        b64(bytes([0xFF, 0x41])),
        b64("too\tshort"),
        b64(line("")),
        b64(line("e3", ts="")),
        b64(line("e4", ts="yesterday")),
    ]
    q, out = run(spark, tmp_path, records)
    raw = rawv.read_store(spark, out["raw"])
    assert sorted(r.event_id for r in raw.collect()) == ["e1", "e2"]
    assert {r.platform for r in raw.collect()} == {"mob"}
    reasons = sorted(r.reason for r in spark.read.parquet(out["dead"]).collect())
    assert reasons == ["bad_collector_tstamp", "decode", "decode", "field_count", "missing_collector_tstamp", "missing_event_id"]
    m = spark.read.parquet(out["metrics"]).agg(F.sum("input_rows"), F.sum("inserted"), F.sum("parse_errors")).first()
    assert tuple(m) == (8, 2, 6)
    assert q.lastProgress["observedMetrics"]["ingest"]["bad_rows"] == 6
    ev = {r.event_id: r for r in rawv.event_view(raw, as_of="2024-01-31").collect()}
    assert ev["e1"].u == "alice" and ev["e2"].u == "u7" and ev["e1"].se_action == "click"
    payload = json.loads(raw.where("event_id = 'e2'").first().event)
    assert payload["contexts_com_snowplowanalytics_mobile_client_session_1"] == [{"userId": "u7"}]
    assert payload["collector_tstamp"] == "2024-01-05T10:00:00.123Z"


def test_duplicates_and_replay(spark, tmp_path):
    recs = [b64(line("e1")), b64(line("e1")), b64(line("e1", ts="2024-01-05 10:00:01.000"))]
    _, out = run(spark, tmp_path, recs)
    # a second delivery of the same records in a later batch (at-least-once)
    _, out = run(spark, tmp_path, recs)
    raw = rawv.read_store(spark, out["raw"])
    assert raw.count() == 6
    assert rawv.dedup(raw).count() == 2
    assert raw.select(rawv.INGEST_BATCH_COL).distinct().count() == 2


def test_month_partitions(spark, tmp_path):
    _, out = run(spark, tmp_path, [b64(line("e1", ts="2024-01-31 23:59:59.999")), b64(line("e2", ts="2024-02-01 00:00:00.000"))])
    raw = rawv.read_store(spark, out["raw"])
    assert sorted((r.event_id, r.yyyymm) for r in raw.collect()) == [("e1", 202401), ("e2", 202402)]


def test_replayed_batch_id_is_idempotent(spark, tmp_path):
    lines = spark.createDataFrame([(b64(line("e1")),), (b64(line("e2")),), ("bad",)], "value string")
    batch = ingest.prepare(lines, TEST_TSV_FIELDS)
    out = {k: str(tmp_path / k) for k in ("raw", "dead", "metrics")}
    for _ in range(2):  # the same batch id written twice, as after a failure before the commit
        ingest.write_batch(batch, 7, out["raw"], out["dead"], out["metrics"])
    assert rawv.read_store(spark, out["raw"]).count() == 2
    assert spark.read.parquet(out["dead"]).count() == 1
    assert spark.read.parquet(out["metrics"]).count() == 1


def _stream(spark, tmp_path, name, recs, checkpoint, **kw):
    src = tmp_path / "in"
    src.mkdir(exist_ok=True)
    (src / f"{name}.txt").write_text("\n".join(recs) + "\n")
    out = {k: str(tmp_path / k) for k in ("raw", "dead", "metrics")}
    q = ingest.start_ingest(
        ingest.file_source(spark, str(src)), TEST_TSV_FIELDS, out["raw"], out["dead"], out["metrics"],
        str(tmp_path / checkpoint), available_now=True, **kw,
    )
    q.awaitTermination()
    return out


def test_batch_dedup_and_late_unique_events(spark, tmp_path):
    out = _stream(spark, tmp_path, "a", [b64(line("e1")), b64(line("e1")), b64(line("e2")), "junk"], "ckpt", dedup_batch=True)
    assert rawv.read_store(spark, out["raw"]).count() == 2
    assert spark.read.parquet(out["dead"]).count() == 1
    late = b64(line("e0", ts="2024-01-01 00:00:00.000"))  # far behind everything seen, never delivered before
    out = _stream(spark, tmp_path, "b", [late, b64(line("e2"))], "ckpt", dedup_batch=True)
    view = rawv.dedup(rawv.read_store(spark, out["raw"]))
    assert sorted(r.event_id for r in view.collect()) == ["e0", "e1", "e2"]


def test_new_checkpoint_keeps_what_is_stored(spark, tmp_path):
    out = _stream(spark, tmp_path, "a", [b64(line("e1"))], "first")
    (tmp_path / "in" / "a.txt").unlink()
    out = _stream(spark, tmp_path, "b", [b64(line("e2"))], "second")
    raw = rawv.read_store(spark, out["raw"])
    assert sorted(r.event_id for r in raw.collect()) == ["e1", "e2"]
    assert raw.select("ingest_run").distinct().count() == 2


def test_unreadable_derived_tstamp_goes_to_the_dead_letter(spark):
    at = TEST_TSV_FIELDS.index("derived_tstamp")

    def with_derived(value):
        f = line("e1").split("\t")
        f[at] = value
        return (b64("\t".join(f)),)

    rows = spark.createDataFrame([with_derived(""), with_derived("not a time")], "value string")
    got = sorted(str(r["_reason"]) for r in ingest.prepare(rows, TEST_TSV_FIELDS).collect())
    assert got == ["None", "bad_derived_tstamp"]


def test_copies_across_batches_are_dropped_and_late_events_pass(spark, tmp_path):
    stored = lambda out: sorted(r.event_id for r in rawv.read_store(spark, out["raw"]).collect())
    run(spark, tmp_path, [b64(line("e1")), b64(line("e1")), b64(line("e2")), "junk", "junk"], remember="1 day")
    _, out = run(spark, tmp_path, [b64(line("e2")), b64(line("e1", ts="2019-03-01 00:00:00")), b64(line("e3")), "junk"], remember="1 day")
    assert stored(out) == ["e1", "e1", "e2", "e3"]  # the second e1 is another event: years old, not late
    assert spark.read.parquet(out["dead"]).count() == 3
    # a new checkpoint knows nothing of the first: the dedup view settles its copies
    _, out = run(spark, tmp_path, [b64(line("e2"))], name="in2", checkpoint=str(tmp_path / "other"), remember="1 day")
    assert stored(out).count("e2") == 2 and rawv.event_view(rawv.read_store(spark, out["raw"]), as_of="2024-01-31").count() == 3


def test_stream_state_forgets_keys(spark, tmp_path):
    import time

    run(spark, tmp_path, [b64(line("e1"))], remember="1 second")
    time.sleep(3)
    run(spark, tmp_path, [b64(line("e2"))], remember="1 second")  # moves the watermark past e1
    q, out = run(spark, tmp_path, [b64(line("e1")), b64(line("e2"))], remember="1 second")
    rows = [r.event_id for r in rawv.read_store(spark, out["raw"]).collect()]
    assert sorted(rows) == ["e1", "e1", "e2"]  # e1 was forgotten, e2 not yet
    state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert state and all(p["numRowsTotal"] <= 2 for p in state)


def test_typed_payload(spark):
    fields = ["event_id", "event_name", "collector_tstamp", "txn_id", "tr_total", "dvce_ismobile", "contexts", "unstruct_event", "derived_contexts"]
    one = lambda schema, data: {"schema": f"iglu:{schema}/jsonschema/1-0-0", "data": data}
    ctx = lambda *entries: json.dumps({"schema": "iglu:a/contexts/jsonschema/1-0-0", "data": list(entries)})
    event = json.dumps({"schema": "iglu:a/unstruct/jsonschema/1-0-0", "data": one("com.acme-x/linkClick", {"url": "a\"b", "n": 1.5})})
    t = "2024-01-05 10:00:00.123"
    rows = [
        ["e1", "ev", t, "12", "1.25", "1", ctx(one("org.w3/page", {"id": 1})), event, ctx(one("org.w3/page", {"id": 2}), one("b/c", {}))],
        ["e2", "ev", t, "", "", "0", "", "", ""],
        ["e3", "ev", t, "x", "", "", "", "", ""],
        ["e4", "ev", t, "", "1,5", "", "", "", ""],
        ["e5", "ev", t, "", "", "yes", "", "", ""],
        ["e6", "ev", t, "-3", "1e3", "", "{", "[]", ctx()],
    ]
    df = ingest.prepare(spark.createDataFrame([(b64("\t".join(r)),) for r in rows], "value string"), fields)
    got = {r.event_id: r for r in df.collect()}
    assert {k: r["_reason"] for k, r in got.items()} == {"e1": None, "e2": None, "e3": "bad_value", "e4": "bad_value", "e5": "bad_value", "e6": None}
    head = lambda k: {"event_id": k, "event_name": "ev", "collector_tstamp": "2024-01-05T10:00:00.123Z"}
    assert json.loads(got["e1"].event) == {
        **head("e1"), "txn_id": 12, "tr_total": 1.25, "dvce_ismobile": True, "contexts_org_w3_page_1": [{"id": 1}, {"id": 2}], "contexts_b_c_1": [{}],
        "unstruct_event_com_acme_x_link_click_1": {"url": "a\"b", "n": 1.5}}
    assert json.loads(got["e2"].event) == {**head("e2"), "dvce_ismobile": False}
    assert json.loads(got["e6"].event) == {**head("e6"), "txn_id": -3, "tr_total": 1000.0}


def test_each_json_text_is_read_once_a_row(spark):
    fields = [*TEST_TSV_FIELDS, "unstruct_event", "derived_contexts"]
    df = ingest.prepare(spark.createDataFrame([(b64(line("e1")),)], "value string"), fields)
    plan = df.select("event", "_reason")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 3  # two context fields and the self-describing event


def test_batch_caches_the_stored_columns_only(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    cached, persist = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: cached.append(self.columns) or persist(self, *a))
    batch = ingest.prepare(spark.createDataFrame([(b64(line("e1")),), ("bad",)], "value string"), TEST_TSV_FIELDS)
    ingest.write_batch(batch, 1, *(str(tmp_path / k) for k in ("raw", "dead", "metrics")))
    assert len(cached) == 1 and "line" not in cached[0] and "contexts" not in cached[0]
    assert [r.value for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["bad"]


def test_deliveries_are_written_by_all_cores_in_few_batches(spark, tmp_path):
    from retentia.streaming import catalog

    lines = spark.range(0, 1200, numPartitions=12).selectExpr("CAST(id AS string) AS value")
    paths = catalog._paths(str(tmp_path))
    for n in range(2):  # the second delivery comes to the same checkpoint
        catalog._deliver(spark, lines, paths, "0", batches=3)
    assert len(list((tmp_path / "in" / "0").glob("part-*"))) == 24
    assert spark.read.parquet(paths["metrics"]).select("batch_id", "input_rows").orderBy("batch_id").collect() == [(n, 400) for n in range(6)]


def test_filter_by_id_builds_no_tracker_line(spark, tmp_path):
    from retentia.streaming import catalog

    spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, id AS user_id, 'click' AS event_type, 1.0D AS value, '' AS props FROM range(9)"
              ).write.parquet(str(tmp_path / "events.parquet"))
    some = catalog._with_id(spark, str(tmp_path)).where("id % 3 <> 0").select("value")
    filters = [p for p in some._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in p]
    assert some.count() == 6 and filters and not any("concat_ws" in p for p in filters)
