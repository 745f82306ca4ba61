"""Scan, routing, decoding, table layout and maintenance."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telelake.checks import fixtures as X
from telelake.operators import normalize
from telelake.session import materialize, scratch_path
from telelake.sources import catalog, envelope, ingest, maintenance, tables
from telelake.streaming import ingest as stream_load


def stamp() -> Column:
    """Event time cut out of a line, whether or not the line is valid JSON."""
    return F.regexp_extract("value", '"timestamp":([0-9]+)', 1).cast("bigint").alias("timestamp")


def staged(spark: SparkSession, lines: DataFrame) -> str:
    path = scratch_path(spark, "staged")
    envelope.stage(lines, path)
    return path


def all_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all eight kinds."""
    parts = [
        X.deployment_lines(spark, sf),
        X.status_lines(spark, sf),
        X.log_lines(spark, sf),
        X.span_lines(spark, sf),
        X.lines_of(X.output_events(spark, sf), "ContainerOutput", "container-output.jsonl"),
        X.lines_of(X.host_cpu_events(spark, sf), "HostCpu", "host-cpu.jsonl"),
        X.lines_of(X.sampled(normalize.disk_sample(X.raw_disk(spark, sf))), "HostDisk", "host-disk.jsonl"),
        X.lines_of(X.sampled(normalize.memory_sample(X.raw_memory(spark, sf))), "HostMemory", "host-memory.jsonl"),
    ]
    return reduce(DataFrame.union, parts)


def scan_staged(spark: SparkSession, sf: str) -> DataFrame:
    lines = X.deployment_lines(spark, sf)
    # Files of another kind in the same folder must not be read.
    strange = X.status_lines(spark, sf).withColumn("file", F.lit("status.txt"))
    found = envelope.scan_staged(spark, staged(spark, lines.union(strange)))
    return found.select("file", stamp())


def route_files(spark: SparkSession, sf: str) -> DataFrame:
    return envelope.route(X.deployment_lines(spark, sf)).select("file", stamp(), "table")


def decode_envelope(spark: SparkSession, sf: str) -> DataFrame:
    decoded = envelope.decode(X.deployment_lines(spark, sf), "Deployment")
    return decoded.select("event_id", "timestamp", "service", "image", "image_size_mb", "memory_limit", "proxy_enabled")


def quarantine_lines(spark: SparkSession, sf: str) -> DataFrame:
    return envelope.quarantine(X.deployment_lines(spark, sf)).select("file", stamp(), "reason")


def split_by_type(spark: SparkSession, sf: str) -> DataFrame:
    split = envelope.split_by_type(all_lines(spark, sf).select("value"))
    found = envelope.scan_staged(spark, staged(spark, split))
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


def ensure_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Create all tables, load three of them, create again: nothing may be lost."""
    root = scratch_path(spark, "lake")
    tables.ensure_tables(spark, root)
    lines = X.status_lines(spark, sf).union(
        X.lines_of(X.host_cpu_events(spark, sf), "HostCpu", "host-cpu.jsonl")
    )
    ingest.ingest_batch(lines, root, names=["status", "host-cpu"]).collect()
    outcome = tables.ensure_tables(spark, root)
    counts = [
        tables.read(spark, root, name).agg(
            F.lit(name).alias("table"),
            F.count(F.lit(1)).alias("rows"),
            F.lit(outcome[name] is None).alias("present"),
        )
        for name in tables.TABLES
    ]
    return reduce(DataFrame.union, counts)


def _loaded(spark: SparkSession, sf: str, name: str, lines: DataFrame) -> str:
    root = scratch_path(spark, "lake")
    tables.append(ingest.table_rows(lines, name), root, name)
    return root


def append_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    root = _loaded(spark, sf, "deployments", X.deployment_lines(spark, sf))
    return X.plain(tables.read(spark, root, "deployments"))


def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Load everything, with one table placed on a file system that does not exist."""
    root = scratch_path(spark, "lake")
    lines = envelope.scan_staged(spark, staged(spark, all_lines(spark, sf)))
    report = ingest.ingest_batch(lines, root, roots={"host-cpu": "nowhere://lake"})
    loaded = [
        tables.read(spark, root, name).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        for name in tables.TABLES
        if name != "host-cpu"
    ]
    known = report.withColumn("table", F.coalesce("table", F.lit("unknown")))
    return known.join(reduce(DataFrame.union, loaded), "table", "left").select("table", "ok", "loaded", "rejected", "rows")


def strange_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose fields, times or nested values cannot be read, among good ones."""
    i, us = F.col("event_id"), F.col("us")
    status = (
        '{"ContainerStatus":{"timestamp":«t»,"service":"s","container_id":"id-«i»","state":"Running","health_status":"None",'
        '"exit_code":"abc","restart_count":1,"uptime_seconds":1,"failing_streak":0}}'
    )
    log = (
        '{"LogBatch":{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"s"}}]},'
        '"scopeLogs":[{"logRecords":[{"timeUnixNano":"%s","severityText":"id-«i»","body":%s}]}]}]}}'
    )
    span = (
        '{"SpanBatch":{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"s"}}]},'
        '"scopeSpans":[{"spans":[{"traceId":"a","spanId":"b","name":"id-«i»","startTimeUnixNano":"1","endTimeUnixNano":"abc"}]}]}]}}'
    )
    time = "«t»000"
    forms = {
        0: (status, "status.jsonl"),
        1: (log % ("9300000000000000000", '{"stringValue":"x"}'), "logs.jsonl"),
        2: (log % (time, '{"arrayValue":{"values":[{"intValue":"abc"}]}}'), "logs.jsonl"),
        3: (log % (time, '{"kvlistValue":{"values":[{"key":"k","value":{"bytesValue":"abc"}}]}}'), "logs.jsonl"),
        4: (log % (time, '{"intValue":"x1"}'), "logs.jsonl"),
        5: (span, "traces.jsonl"),
        6: (log % (time, '{"intValue":"7"}'), "logs.jsonl"),
        7: (log % (time, '{"arrayValue":{"values":[{"intValue":"7"}]}}'), "logs.jsonl"),
    }
    value, file = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (form, name) in forms.items():
        value = F.when(i % 8 == kind, X.text(form, i=i, t=us)).otherwise(value)
        file = F.when(i % 8 == kind, name).otherwise(file)
    return X.events(spark, sf).select(X.stored(value), file.alias("file"))


def quarantine_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every line is either rejected with a reason or loaded."""
    lines = strange_lines(spark, sf)
    root = scratch_path(spark, "lake")
    report = ingest.ingest_batch(lines, root, names=["status", "logs", "traces"])
    counted = report.agg(F.sum("loaded").alias("loaded"), F.sum("rejected").alias("rejected"), F.min("ok").alias("ok"))
    number = F.regexp_extract("value", "id-([0-9]+)", 1).cast("bigint").alias("event_id")
    rejected = ingest.quarantined(spark, root).select(number, "file", "reason")
    loaded = tables.read(spark, root, "logs").select(
        F.substring("severity", 4, 20).cast("bigint").alias("event_id"), F.lit("logs.jsonl").alias("file"), F.col("body").alias("reason")
    )
    total = counted.select(F.col("loaded").alias("event_id"), F.col("rejected").cast("string").alias("file"), F.col("ok").cast("string").alias("reason"))
    return rejected.union(loaded).union(total)


def not_null_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalize.status(X.status_events(spark, sf))
    torn = rows.withColumn("service", F.when(F.col("state") != "dead", F.col("service"))).withColumn(
        "failing_streak", F.when(F.col("failing_streak") > 0, F.col("failing_streak"))
    )
    kept, rejected = tables.not_null_split(torn, tables.TABLES["status"].required)
    both = kept.withColumn("reason", F.lit(None).cast("string")).union(rejected)
    return both.select(F.unix_micros("timestamp").alias("timestamp"), "reason")


def ingest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return envelope.ingest_metrics(X.deployment_lines(spark, sf).union(X.log_lines(spark, sf)))


def file_listing(spark: SparkSession, sf: str) -> DataFrame:
    """A listing with one data file per event."""
    date = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd")
    return X.events(spark, sf).select(
        F.concat(F.lit("service="), "service", F.lit("/date="), date).alias("partition"),
        date.cast("date").alias("date"),
        F.col("event_id").cast("string").alias("path"),
        (F.col("k") * 1_000_000 + F.col("event_id")).alias("length"),
    )


def compact_plan(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.compact_plan(file_listing(spark, sf), "2024-01-20")


def retention_plan(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.retention_plan(file_listing(spark, sf), "2024-01-25 12:00:00", 24)


def compact(spark: SparkSession, sf: str) -> DataFrame:
    """Load twice, compact the closed dates, load once more, read through the manifest."""
    root = scratch_path(spark, "lake")
    # Stored: lines are parsed for the first load only.
    rows = materialize(ingest.table_rows(X.status_lines(spark, sf), "status"), "rows")
    tables.append(rows, root, "status")
    tables.append(rows, root, "status")
    maintenance.compact(spark, root, "status", "2024-01-16")
    # Nothing is left to do for the same dates.
    again = maintenance.compact(spark, root, "status", "2024-01-16")
    tables.append(rows, root, "status")
    current = maintenance.read_current(spark, root, "status")
    counted = current.groupBy("service", "date", "state").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("again", F.lit(again))


def maintain(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads, maintained after a whole one; what is left of each date."""
    lines = X.status_lines(spark, sf)
    root = _loaded(spark, sf, "status", lines)
    report = ingest.ingest_batch(lines, root, names=["status"])
    maintenance.maintain(
        spark, root, closed_before="2024-01-22", now="2024-01-25 12:00:00", names=["status", "logs"], after=report
    ).collect()
    current = maintenance.read_current(spark, root, "status")
    return current.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


def apply_retention(spark: SparkSession, sf: str) -> DataFrame:
    """A table that a stream has written, after its old dates are deleted."""
    path, root, marks = (scratch_path(spark, p) for p in ("staged", "lake", "checkpoint"))
    envelope.stage(X.status_lines(spark, sf), path)
    queries = stream_load.ingest_stream(spark, path, root, marks, names=["status"], trigger={"availableNow": True})
    failed = [error for error in stream_load.drain(queries).values() if error]
    if failed:
        raise RuntimeError(failed[0])
    maintenance.apply_retention(spark, root, "status", "2024-01-25 12:00:00", 24)
    return X.plain(tables.read(spark, root, "status"))


def pruned_scan(spark: SparkSession, sf: str) -> DataFrame:
    root = _loaded(spark, sf, "status", X.status_lines(spark, sf))
    return X.plain(tables.read_date(spark, root, "status", "2024-01-15"))


def catalog_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Both layouts under names: written by name and by path, read by SQL for one date."""
    # Stored: lines are parsed once for the four loads.
    rows = materialize(ingest.table_rows(X.status_lines(spark, sf), "status"), "rows")
    parts = []
    for label, date_only in (("by service", ()), ("by date", ("status",))):
        root = scratch_path(spark, "lake")
        database = f"lake_{uuid.uuid4().hex}"
        name = catalog.register(spark, root, database, ["status"], date_only)["status"]
        catalog.insert(rows, root, database, "status")
        tables.append(rows, root, "status")
        catalog.refresh(spark, database, ["status"])
        parts.append(
            spark.sql(
                f"SELECT '{label}' AS layout, service, state, count(*) AS rows FROM {name}"
                " WHERE date = DATE'2024-01-15' GROUP BY service, state"
            )
        )
    return parts[0].union(parts[1])


QUERIES = {
    f.__name__: f
    for f in (
        scan_staged,
        route_files,
        decode_envelope,
        quarantine_lines,
        split_by_type,
        ensure_tables,
        append_roundtrip,
        ingest_report,
        quarantine_rows,
        not_null_split,
        ingest_metrics,
        compact_plan,
        retention_plan,
        compact,
        maintain,
        apply_retention,
        pruned_scan,
        catalog_tables,
    )
}

_E, _D, _L, _P = f"WITH {X.E}", f"WITH {X.D}", f"WITH {X.L}", f"WITH {X.P}"
_LISTING = f"""{_E}, f AS (SELECT 'service=' || service || '/date=' || strftime(make_timestamp(us), '%Y-%m-%d') AS partition,
  CAST(make_timestamp(us) AS DATE) AS date, k * 1000000 + event_id AS length FROM e)"""
_EVENTS = "(SELECT count(*) FROM events)"

ORACLES = {
    "scan_staged": f"{_D} SELECT file, us AS timestamp FROM lines",
    "route_files": f"""{_D} SELECT file, us AS timestamp,
      CASE WHEN file = 'deployments.jsonl' THEN 'deployments' END AS "table" FROM lines""",
    "decode_envelope": f"""{_D}, rows AS ({X.DEPLOYMENT_ROWS})
      SELECT substr(container_id, 2) AS event_id, timestamp, service, image, image_size_mb, memory_limit, proxy_enabled FROM rows""",
    "quarantine_lines": f"""{_D} SELECT file, us AS timestamp, CASE WHEN file = 'other.jsonl' THEN 'unknown file'
      WHEN event_id % 2 = 0 THEN 'malformed line' ELSE 'wrong variant' END AS reason
      FROM lines WHERE file = 'other.jsonl' OR event_type = 'error'""",
    "split_by_type": f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error' AND event_id % 2 = 0) AS torn,
        count(*) FILTER (event_type = 'error' AND event_id % 2 = 1) AS wrong FROM events),
      s AS (SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS spans)
      SELECT 'deployments.jsonl' AS file, n - torn - wrong AS lines FROM n
      UNION ALL SELECT 'host-cpu.jsonl', n + wrong FROM n
      UNION ALL SELECT unnest(['status.jsonl', 'logs.jsonl', 'container-output.jsonl', 'host-disk.jsonl', 'host-memory.jsonl']), n FROM n
      UNION ALL SELECT 'traces.jsonl', spans FROM s""",
    "ensure_tables": f"""SELECT unnest(['status', 'host-cpu']) AS "table", {_EVENTS} AS rows, true AS present
      UNION ALL SELECT unnest(['deployments', 'logs', 'traces', 'container-output', 'host-disk', 'host-memory']), 0, true""",
    "append_roundtrip": f"{_D} {X.DEPLOYMENT_ROWS}",
    "ingest_report": f"""{_D}, broken AS (SELECT count(*) AS n FROM lines WHERE event_type = 'error' AND file = 'deployments.jsonl'),
      strange AS (SELECT count(*) AS n FROM lines WHERE file = 'other.jsonl'),
      s AS (SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS n)
      SELECT 'deployments' AS "table", true AS ok, count(*) AS loaded, any_value(broken.n) AS rejected, count(*) AS rows FROM d, broken
      UNION ALL SELECT unnest(['status', 'container-output', 'host-disk', 'host-memory']), true, {_EVENTS}, 0, {_EVENTS}
      UNION ALL SELECT 'logs', true, {_EVENTS}, 0, {_EVENTS} + (SELECT count(*) FROM events WHERE event_type = 'error')
      UNION ALL SELECT 'traces', true, s.n, 0, (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) FROM s
      UNION ALL SELECT 'unknown', true, 0, n, NULL FROM strange
      UNION ALL SELECT 'host-cpu', false, 0, 0, NULL""",
    "quarantine_rows": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'status.jsonl' WHEN 5 THEN 'traces.jsonl' ELSE 'logs.jsonl' END AS file,
        CASE event_id % 8 WHEN 2 THEN 'unreadable nested value' WHEN 3 THEN 'unreadable nested value' WHEN 6 THEN '7' WHEN 7 THEN '[7]'
          ELSE 'invalid fields' END AS reason FROM events
      UNION ALL SELECT CAST(count(*) FILTER (event_id % 8 >= 6) AS BIGINT), CAST(count(*) FILTER (event_id % 8 < 6) AS VARCHAR), 'true' FROM events""",
    "not_null_split": f"""{_E}, n AS (SELECT us, concat_ws(',', CASE WHEN event_type = 'error' THEN 'service' END,
      CASE WHEN k % 3 = 0 THEN 'failing_streak' END) AS missing FROM e)
      SELECT us AS timestamp, CASE WHEN missing <> '' THEN 'null in ' || missing END AS reason FROM n""",
    "ingest_metrics": f"""{_D} SELECT file, count(*) AS lines,
        count(*) FILTER (file = 'other.jsonl' OR event_type = 'error') AS skipped,
        count(*) FILTER (file <> 'other.jsonl' AND event_type <> 'error') AS processed FROM lines GROUP BY file
      UNION ALL SELECT 'logs.jsonl', {_EVENTS}, 0, {_EVENTS}""",
    "compact_plan": f"""{_LISTING}, g AS (SELECT partition, date, count(*) AS files,
        count(*) FILTER (length < 134217728) AS small_files, CAST(sum(length) AS BIGINT) AS bytes
        FROM f WHERE date < DATE '2024-01-20' GROUP BY ALL)
      SELECT *, CAST(greatest((bytes + 134217727) // 134217728, 1) AS BIGINT) AS target_files FROM g
      WHERE small_files > 1 AND greatest((bytes + 134217727) // 134217728, 1) < files""",
    "retention_plan": f"""{_LISTING} SELECT partition, date, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes
      FROM f WHERE date < DATE '2024-01-18' GROUP BY ALL""",
    "compact": f"""{_E}, s AS ({X.STATUS_ROWS}) SELECT service, date, state, 3 * count(*) AS rows, CAST(0 AS INTEGER) AS again FROM s GROUP BY ALL""",
    "maintain": f"{_E}, s AS ({X.STATUS_ROWS}) SELECT date, 2 * count(*) AS rows FROM s WHERE date >= DATE '2024-01-18' GROUP BY date",
    "apply_retention": f"{_E}, s AS ({X.STATUS_ROWS}) SELECT * FROM s WHERE date >= DATE '2024-01-18'",
    "catalog_tables": f"""{_E}, s AS ({X.STATUS_ROWS}) SELECT layout, service, state, 2 * count(*) AS rows
      FROM s, (SELECT unnest(['by service', 'by date']) AS layout) WHERE date = DATE '2024-01-15' GROUP BY ALL""",
    "pruned_scan": f"{_E}, s AS ({X.STATUS_ROWS}) SELECT * FROM s WHERE date = DATE '2024-01-15'",
}
