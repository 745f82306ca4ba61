"""Staging, decoding, tables, maintenance and streams."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from telelake.checks import fixtures as X
from telelake.operators import normalize
from telelake.session import materialize, remove_scratch, scratch_path, shared_dir
from telelake.sources import catalog, envelope, ingest, maintenance, tables
from telelake.streaming import changes as stream_changes
from telelake.streaming import ingest as stream_load
from telelake.streaming import output as stream_capture

SF = "/root/testdata/sf0.001"

LOG = {
    "LogBatch": {
        "resourceLogs": [
            {
                "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "test-service"}}]},
                "scopeLogs": [
                    {
                        "logRecords": [
                            {
                                "timeUnixNano": "1680000000000000000",
                                "severityText": "INFO",
                                "body": {"stringValue": "test log message"},
                                "traceId": "0102030405060708090A0B0C0D0E0F10",
                                "spanId": "0102030405060708",
                            }
                        ]
                    }
                ],
            }
        ]
    }
}
SPAN = {
    "SpanBatch": {
        "resourceSpans": [
            {
                "scopeSpans": [
                    {
                        "spans": [
                            {
                                "traceId": "01020304",
                                "spanId": "05060708",
                                "name": "test_span",
                                "events": [{"timeUnixNano": "1000000", "name": "test_event"}],
                            }
                        ]
                    }
                ]
            }
        ]
    }
}
STATUS = {
    "ContainerStatus": {
        "event_id": "x", "timestamp": 1_704_067_200_000_000, "service": "007", "container_id": "c",
        "state": "Running", "health_status": "None", "exit_code": None, "restart_count": 1,
        "uptime_seconds": 5, "failing_streak": 0, "last_health_output": None,
    }
}


def lines(spark, file, *texts):
    rows = [(t if isinstance(t, str) else json.dumps(t), file) for t in texts]
    return spark.createDataFrame(rows, "value string, file string")


def changed(**fields):
    return {"ContainerStatus": {**STATUS["ContainerStatus"], **fields}}


def test_log_request(spark):
    [row] = ingest.table_rows(lines(spark, "logs.jsonl", LOG), "logs").collect()
    assert (row.service, row.severity, row.body) == ("test-service", "INFO", "test log message")
    assert row.trace_id == "0102030405060708090a0b0c0d0e0f10" and row.span_id == "0102030405060708"
    assert row.attributes is None and json.loads(row.resource) == {"service.name": "test-service"}
    assert row.timestamp.timestamp() == 1_680_000_000


def test_span_request(spark):
    df = ingest.table_rows(lines(spark, "traces.jsonl", SPAN), "traces")
    [row] = df.withColumn("at", F.unix_micros(F.col("events")[0]["timestamp"])).collect()
    assert (row.service, row.kind, row.status_code, row.parent_span_id) == ("unknown", "UNSPECIFIED", None, None)
    assert row.at == 1000 and row.events[0].name == "test_event" and row.events[0].attributes is None


def test_empty_requests_give_no_rows(spark):
    empty = ['{"LogBatch":{"resourceLogs":[]}}', '{"LogBatch":{}}', '{"LogBatch":{"resourceLogs":[{"scopeLogs":[]}]}}']
    assert ingest.table_rows(lines(spark, "logs.jsonl", *empty), "logs").count() == 0


def test_nested_attributes_take_the_python_branch(spark):
    request = json.loads(json.dumps(LOG))
    record = request["LogBatch"]["resourceLogs"][0]["scopeLogs"][0]["logRecords"][0]
    record["attributes"] = [{"key": "deep", "value": {"arrayValue": {"values": [{"intValue": "1"}, {"arrayValue": {}}]}}}]
    record["body"] = {"kvlistValue": {"values": [{"key": "a", "value": {"doubleValue": 1.5}}]}}
    rows = ingest.table_rows(lines(spark, "logs.jsonl", request, LOG), "logs").collect()
    assert sorted(r.body for r in rows) == ["test log message", '{"a":1.5}']
    assert [r.attributes for r in rows if r.attributes] == ['{"deep":[1,[]]}']
    plain = normalize.logs(envelope.decode(lines(spark, "logs.jsonl", LOG), "LogBatch", nested=False), nested=False)
    assert "Python" not in plain._jdf.queryExecution().executedPlan().toString()
    strict = normalize.logs(envelope.decode(lines(spark, "logs.jsonl", request), "LogBatch"), nested=False)
    with pytest.raises(Exception, match="nested attribute value"):
        strict.collect()


def test_quarantine_reasons(spark):
    text = json.dumps(STATUS)
    bad = {
        text[:-1]: envelope.MALFORMED,
        "": envelope.MALFORMED,
        json.dumps({**STATUS, **LOG}): envelope.MALFORMED,
        json.dumps(LOG): envelope.WRONG_VARIANT,
        json.dumps(changed(state="Sleeping")): envelope.INVALID,
        json.dumps(changed(service=None)): envelope.INVALID,
        json.dumps(changed(restart_count=3_000_000_000)): envelope.INVALID,
        json.dumps(changed(timestamp="soon")): envelope.INVALID,
    }
    found = envelope.quarantine(lines(spark, "status.jsonl", text, *bad))
    assert {r.value: r.reason for r in found.collect()} == bad
    assert envelope.decode(lines(spark, "status.jsonl", text, *bad), "ContainerStatus").count() == 1
    [unknown] = envelope.quarantine(lines(spark, "else.jsonl", text)).collect()
    assert unknown.reason == envelope.UNKNOWN_FILE


def test_unsigned_counters_out_of_range_are_quarantined(spark):
    event = {"hostname": "h", "timestamp": 1, "mount_point": "/", "disk_name": "d", "file_system": "x",
             "total_space": 2**63, "used_space": 0, "available_space": 0, "usage_percent": 0.0}
    fine = {**event, "total_space": 2**63 - 1}
    both = lines(spark, "host-disk.jsonl", {"HostDisk": event}, {"HostDisk": fine})
    [row] = ingest.table_rows(both, "host-disk").collect()
    assert row.total_space == 2**63 - 1
    assert envelope.quarantine(both).count() == 1


def test_scan_reads_plain_files_and_directories(spark, tmp_path):
    folder = tmp_path / "batch-1"
    folder.mkdir()
    (folder / "status.jsonl").write_text(json.dumps(STATUS) + "\n")
    (folder / "notes.txt").write_text("no\n")
    envelope.stage(lines(spark, "logs.jsonl", LOG), str(tmp_path / "staged"))
    found = envelope.scan_staged(spark, str(tmp_path)).collect()
    assert sorted(r.file for r in found) == ["logs.jsonl", "status.jsonl"]


def test_version_key_is_renamed(spark):
    source = X.deployment_events(spark, SF).drop("event_type").withColumnRenamed("agent_version", "daemon_version")
    staged = X.lines_of(source, "Deployment", "deployments.jsonl")
    assert ingest.table_rows(staged, "deployments", "daemon_version").where("agent_version is not null").count() == source.count()


def test_locations():
    assert tables.table_uri("s3://my-bucket/lake", "deployments") == "s3://my-bucket/lake/deployments"
    assert tables.table_uri("s3://my-bucket/lake/", "deployments") == "s3://my-bucket/lake/deployments"
    assert tables.table_uri("/home/user/data", "logs") == "file:///home/user/data/logs"
    for relative in ("telem", "./telem"):
        assert tables.table_uri(relative, "logs") == f"file://{os.path.abspath('telem')}/logs"


def test_partition_values_keep_their_type_and_prune(spark, tmp_path):
    root = str(tmp_path)
    tables.append(ingest.table_rows(lines(spark, "status.jsonl", STATUS), "status"), root, "status")
    scan = tables.read_date(spark, root, "status", "2024-01-01")
    assert [r.service for r in scan.collect()] == ["007"]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    narrow = scan.select("state")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<state:string>" in narrow


def test_append_refuses_nulls(spark, tmp_path):
    rows = normalize.status(X.status_events(spark, SF)).withColumn("container_id", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="null in container_id"):
        tables.append(rows, str(tmp_path), "status")


def test_create_is_idempotent_and_isolated(spark, tmp_path):
    root = str(tmp_path)
    assert set(tables.ensure_tables(spark, root).values()) == {None}
    assert set(tables.ensure_tables(spark, root).values()) == {None}
    for name, table in tables.TABLES.items():
        assert tables.read(spark, root, name).count() == 0
        assert set(table.schema.fieldNames()) == set(tables.read(spark, root, name).columns)
    broken = tables.ensure_tables(spark, "nowhere://x", ["status"])
    assert broken["status"]


def data_files(root):
    return [f for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")]


def test_compaction_keeps_rows_and_merges_files(spark, tmp_path):
    root = str(tmp_path)
    rows = ingest.table_rows(X.status_lines(spark, SF), "status")
    for _ in range(3):
        tables.append(rows, root, "status")
    before = sorted(map(str, tables.read(spark, root, "status").collect()))
    live = len(data_files(tmp_path / "status"))
    assert maintenance.compact(spark, root, "status", "2025-01-01") > 0
    merged = len(data_files(tmp_path / "status-compacted"))
    assert merged * 3 == live
    assert sorted(map(str, maintenance.read_current(spark, root, "status").collect())) == before
    # Late rows of a compacted date are read as well, and a second run takes only them.
    tables.append(rows, root, "status")
    assert maintenance.read_current(spark, root, "status").count() == len(before) * 4 // 3
    assert maintenance.compact(spark, root, "status", "2025-01-01") == 0
    for _ in range(2):
        tables.append(rows, root, "status")
    assert maintenance.compact(spark, root, "status", "2025-01-01") > 0
    assert maintenance.compact(spark, root, "status", "2025-01-01") == 0
    # Replaced files go after a time of grace, and reading takes fewer files than before.
    expected = sorted(map(str, maintenance.read_current(spark, root, "status").collect()))
    assert len(expected) == len(before) * 2
    assert maintenance.remove_replaced(spark, root, "status", "2020-01-01") == 0
    assert maintenance.remove_replaced(spark, root, "status", "2100-01-01") == 2 * live
    assert data_files(tmp_path / "status") == []
    assert sorted(map(str, maintenance.read_current(spark, root, "status").collect())) == expected
    assert maintenance.compact(spark, root, "status", "2025-01-01") == 0


def test_uncommitted_runs_are_not_read(spark, tmp_path):
    root = str(tmp_path)
    rows = ingest.table_rows(X.status_lines(spark, SF), "status")
    for _ in range(2):
        tables.append(rows, root, "status")
    count = tables.read(spark, root, "status").count()
    maintenance.compact(spark, root, "status", "2025-01-01")
    rows.write.partitionBy("service", "date").parquet(str(tmp_path / "status-compacted" / "run=broken"))
    assert maintenance.read_current(spark, root, "status").count() == count


def test_retention_of_a_table_that_a_stream_writes(spark, tmp_path):
    staged, root, marks = (str(tmp_path / p) for p in ("staged", "lake", "marks"))
    envelope.stage(X.status_lines(spark, SF), staged)
    queries = stream_load.ingest_stream(spark, staged, root, marks, names=["status"], trigger={"availableNow": True})
    assert stream_load.drain(queries) == {"status": None}
    late = "date >= '2024-01-13'"
    kept = tables.read(spark, root, "status").where(late).count()
    assert 0 < kept < tables.read(spark, root, "status").count()
    assert maintenance.apply_retention(spark, root, "status", "2024-01-20 00:00:00", 1) > 0
    assert tables.read(spark, root, "status").count() == kept
    assert not [f for f in os.listdir(tmp_path / "lake" / "status") if "2024-01-12" in f]


def test_maintenance_waits_for_a_whole_load(spark, tmp_path):
    report = spark.createDataFrame([("status", True), ("logs", False)], "table string, ok boolean")
    options = {"closed_before": "2024-01-01", "now": "2024-01-20 00:00:00", "names": ["status"]}
    assert [r.action for r in maintenance.maintain(spark, str(tmp_path), after=report, **options).collect()] == ["skipped"]
    assert [r.action for r in maintenance.maintain(spark, str(tmp_path), after=report.where("ok"), **options).collect()] == ["missing"]
    with pytest.raises(ValueError, match="delta"):
        maintenance.maintain(spark, str(tmp_path), fmt="delta", **options)


def test_maintenance_skips_missing_tables_and_expires_dates(spark, tmp_path):
    root = str(tmp_path)
    rows = ingest.table_rows(X.status_lines(spark, SF), "status")
    tables.append(rows, root, "status")
    report = maintenance.maintain(
        spark, root, closed_before="2024-01-01", now="2024-01-20 00:00:00", retention_hours=1, names=["status", "logs"]
    )
    actions = {(r.table, r.action) for r in report.collect()}
    assert actions == {("status", "compacted"), ("status", "cleaned"), ("status", "expired"), ("logs", "missing")}
    # 168 hours are kept whatever was asked for.
    left = tables.read(spark, root, "status").agg(F.min("date").cast("string")).first()[0]
    assert left == "2024-01-13"


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    staged, root, marks = (str(tmp_path / p) for p in ("staged", "lake", "marks"))
    all_lines = X.deployment_lines(spark, SF)
    expected = ingest.table_rows(all_lines, "deployments")
    for part in (F.col("file") == "deployments.jsonl", F.col("file") != "deployments.jsonl"):
        envelope.stage(all_lines.where(part), staged)
        queries = stream_load.ingest_stream(
            spark, staged, root, marks, names=["deployments"], trigger={"availableNow": True}, maxFilesPerTrigger=3
        )
        assert stream_load.drain(queries) == {"deployments": None}
    found = tables.read(spark, root, "deployments").select(expected.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_stream_drops_repeated_lines_on_request(spark, tmp_path):
    source, root, marks = (str(tmp_path / p) for p in ("chunks", "lake", "marks"))
    chunks = X.chunks(spark, SF).where("stream = 'stdout'")
    again = chunks.withColumn("chunk_id", F.col("chunk_id") + 10_000)
    chunks.union(again).coalesce(1).write.json(source)
    query = stream_capture.output_stream(
        spark, source, root, marks, repeats_within="30 days", trigger={"availableNow": True}
    )
    query.awaitTermination()
    found = tables.read(spark, root, "container-output")
    distinct = stream_capture.captured_rows(chunks).select("service", "timestamp", "stream", "message").distinct()
    assert found.count() == distinct.count()


def test_scratch_needs_a_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


class _Session:
    """Just enough of a session to ask for the shared folder."""

    def __init__(self, master, configured=None):
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})


def test_only_local_sessions_fall_back_to_a_temporary_folder():
    local = shared_dir(_Session("local[2]"))
    assert os.path.isdir(local) and shared_dir(_Session("local[2]")) == local
    assert shared_dir(_Session("spark://host:7077", "s3://bucket/scratch/")) == "s3://bucket/scratch"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session("yarn"))


def test_date_only_layout_reads_the_same(spark, tmp_path):
    rows = ingest.table_rows(X.status_lines(spark, SF), "status")
    wide, narrow = str(tmp_path / "wide"), str(tmp_path / "narrow")
    tables.append(rows, wide, "status")
    tables.append(rows, narrow, "status", by_date_only=True)
    assert len(data_files(narrow)) < len(data_files(wide))
    columns = rows.columns
    both = [sorted(map(str, tables.read(spark, r, "status").select(columns).collect())) for r in (wide, narrow)]
    assert both[0] == both[1]


def test_stream_of_requests_equals_batch(spark, tmp_path):
    staged, root, marks = (str(tmp_path / p) for p in ("staged", "lake", "marks"))
    both = X.log_lines(spark, SF).union(X.span_lines(spark, SF))
    envelope.stage(both, staged)
    queries = stream_load.ingest_stream(
        spark, staged, root, marks, names=["logs", "traces"], trigger={"availableNow": True}
    )
    assert stream_load.drain(queries) == {"logs": None, "traces": None}
    for name in ("logs", "traces"):
        expected = ingest.table_rows(both, name)
        found = tables.read(spark, root, name).select(expected.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_lines_are_parsed_once(spark):
    rows = ingest.table_rows(X.status_lines(spark, SF), "status")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_scratch_can_be_removed(spark):
    stored = materialize(spark.range(5), "probe")
    [file] = {f.rsplit("/", 1)[0] for f in stored.inputFiles()}
    assert tables.exists(spark, file)
    remove_scratch(spark)
    assert not tables.exists(spark, file)


def test_load_reports_and_keeps_tables_apart(spark, tmp_path):
    """One table without a place, good and bad lines in another, lines of no table."""
    root = str(tmp_path / "lake")
    mixed = (
        lines(spark, "status.jsonl", STATUS, changed(state="Sleeping"), "{")
        .union(lines(spark, "logs.jsonl", LOG))
        .union(lines(spark, "else.jsonl", STATUS, STATUS))
    )
    report = ingest.ingest_batch(mixed, root, names=["status", "logs", "traces"], roots={"logs": "nowhere://lake"})
    found = {r.table: (r.ok, r.loaded, r.rejected) for r in report.collect()}
    assert found == {"status": (True, 1, 2), "logs": (False, 0, 0), "traces": (True, 0, 0), None: (True, 0, 2)}
    bad = ingest.quarantined(spark, root).collect()
    assert sorted((r.file, r.reason, r.table) for r in bad) == [
        ("else.jsonl", envelope.UNKNOWN_FILE, "unknown"),
        ("else.jsonl", envelope.UNKNOWN_FILE, "unknown"),
        ("status.jsonl", envelope.INVALID, "status"),
        ("status.jsonl", envelope.MALFORMED, "status"),
    ]
    assert ingest.quarantined(spark, str(tmp_path / "other")).count() == 0
    assert tables.read(spark, root, "status").count() == 1


def test_verdicts_parse_a_line_once(spark):
    for file, variant in (("status.jsonl", "ContainerStatus"), ("logs.jsonl", "LogBatch"), ("traces.jsonl", "SpanBatch")):
        judged = envelope.verdicts(lines(spark, file, STATUS, LOG, SPAN, "{"), variant)
        plan = judged._jdf.queryExecution().optimizedPlan().toString()
        branches = 2 if envelope.VARIANTS[variant].nested else 1
        assert plan.count("from_json(") == branches, plan
        rows = judged.collect()
        assert len(rows) == 4
        # An event or a reason, and the text of rejected lines only.
        assert all((r.event is None) == (r.reason is not None) == (r.value is not None) for r in rows)
        assert sorted(r.reason for r in rows if r.reason) == sorted([envelope.WRONG_VARIANT] * 2 + [envelope.MALFORMED])


def test_streamed_writes_split_a_busy_service_by_size(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    staged, root, marks = (str(tmp_path / p) for p in ("staged", "lake", "marks"))
    pick = random.Random(4)
    some = [changed(service="busy" if n % 10 else f"quiet-{n % 3}", last_health_output=f"{pick.getrandbits(1600):x}") for n in range(6000)]
    envelope.stage(lines(spark, "status.jsonl", *some).repartition(6), staged)
    try:
        spark.conf.set(size, "128k")
        queries = stream_load.ingest_stream(spark, staged, root, marks, names=["status"], trigger={"availableNow": True})
        assert stream_load.drain(queries) == {"status": None}
    finally:
        spark.conf.set(size, before)
    files = {s: len(data_files(f"{root}/status/service={s}")) for s in ("busy", "quiet-0", "quiet-1", "quiet-2")}
    assert files["busy"] > 2 >= max(n for s, n in files.items() if s != "busy")
    assert tables.read(spark, root, "status").count() == 6000


def test_digest_stream_goes_on_from_its_state(spark, tmp_path):
    source, target, marks = (str(tmp_path / p) for p in ("seen", "labelled", "marks"))
    provider = spark.conf.get(stream_changes.PROVIDER)
    digest, other = "a" * 64, "b" * 64
    def feed(*rows):
        seen = [(i, t, f, [f"r@sha256:{d}"] if d else None, None) for i, t, f, d in rows]
        spark.createDataFrame(seen, stream_changes.OBSERVATIONS).coalesce(1).write.mode("append").json(source)
        stream_changes.digest_stream(spark, source, target, marks, trigger={"availableNow": True}).awaitTermination()
        return {(r.image, r.ts_us): (r.previous, r.outcome) for r in spark.read.parquet(target).collect()}
    feed(("x", 2, False, digest), ("x", 1, True, None), ("y", 1, False, digest))
    found = feed(("x", 3, False, digest), ("x", 5, False, other), ("x", 4, True, None), ("z", 9, True, None))
    found = feed(("y", 2, False, other), ("z", 10, False, digest), ("x", 6, False, other))
    assert found == {
        ("x", 1): (None, "Baseline"), ("x", 2): (None, "Updated"), ("y", 1): (None, "Baseline"),
        ("x", 3): (digest, "NotUpdated"), ("x", 4): (digest, "Deleted"), ("x", 5): (digest, "Updated"),
        ("z", 9): (None, "Baseline"), ("y", 2): (digest, "Updated"), ("z", 10): (None, "Updated"), ("x", 6): (other, "NotUpdated"),
    }
    assert spark.conf.get(stream_changes.PROVIDER) == provider


def test_date_only_layout_end_to_end(spark, tmp_path):
    """Created once, followed by loads, streams, compaction and retention."""
    staged, root, marks = (str(tmp_path / p) for p in ("staged", "lake", "marks"))
    assert set(tables.ensure_tables(spark, root, date_only=["status"]).values()) == {None}
    source = X.status_lines(spark, SF)
    expected = sorted(map(str, ingest.table_rows(source, "status").collect()))
    ingest.ingest_batch(source, root, names=["status"]).collect()
    ingest.ingest_batch(source, root, names=["status"]).collect()
    assert not [d for d in os.listdir(f"{root}/status") if d.startswith("service=")]
    columns = ingest.table_rows(source, "status").columns
    assert sorted(map(str, tables.read(spark, root, "status").select(columns).collect())) == sorted(expected * 2)
    assert maintenance.compact(spark, root, "status", "2025-01-01") > 0
    current = maintenance.read_current(spark, root, "status")
    assert sorted(map(str, current.select(columns).collect())) == sorted(expected * 2)
    streamed = str(tmp_path / "streamed")
    tables.ensure_tables(spark, streamed, ["status"], date_only=["status"])
    envelope.stage(source, staged)
    queries = stream_load.ingest_stream(spark, staged, streamed, marks, names=["status"], trigger={"availableNow": True})
    assert stream_load.drain(queries) == {"status": None}
    assert not [d for d in os.listdir(f"{streamed}/status") if d.startswith("service=")]
    assert sorted(map(str, tables.read(spark, streamed, "status").select(columns).collect())) == expected
    one = tables.read_date(spark, root, "status", "2024-01-15")
    assert "PartitionFilters: [isnotnull(date" in one._jdf.queryExecution().executedPlan().toString()


def test_catalog_names_prune_and_guard(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = ingest.table_rows(X.status_lines(spark, SF), "status")
    tables.append(rows, root, "status", by_date_only=True)
    names = catalog.register(spark, root, "named", ["status", "container-output"])
    assert names["container-output"] == "`named`.`container_output`"
    # What was there is kept, in its own layout.
    assert spark.table(names["status"]).count() == rows.count()
    catalog.insert(rows, root, "named", "status")
    assert spark.table(names["status"]).count() == 2 * rows.count() == tables.read(spark, root, "status").count()
    one = spark.sql(f"SELECT state FROM {names['status']} WHERE date = DATE'2024-01-15'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "ReadSchema: struct<state:string>" in plan
    with pytest.raises(Exception, match="null in container_id"):
        catalog.insert(rows.withColumn("container_id", F.lit(None).cast("string")), root, "named", "status")
    assert spark.sql(f"SHOW PARTITIONS {names['status']}").count() > 0
    # Partitions that come by path are known after a refresh.
    tables.append(rows.withColumn("date", F.lit("2031-01-01").cast("date")), root, "status")
    catalog.refresh(spark, "named", ["status"])
    assert spark.sql(f"SELECT * FROM {names['status']} WHERE date = DATE'2031-01-01'").count() == rows.count()
    assert catalog.register(spark, root, "named", ["status"]) == {"status": names["status"]}


def test_shared_fixtures_survive_a_cleared_scratch_folder(spark):
    made = []
    def make():
        made.append(1)
        return spark.range(5).toDF("n")
    for _ in range(2):
        assert X.once(spark, "nowhere", "probe", make).count() == 5
    remove_scratch(spark)
    assert X.once(spark, "nowhere", "probe", make).count() == 5 and len(made) == 1
    remove_scratch(spark, kept=True)
    assert X.once(spark, "nowhere", "probe", make).count() == 5 and len(made) == 2
