"""Normalisers: staged lines to table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telelake.checks import fixtures as X
from telelake.operators import normalize
from telelake.sources import ingest


def norm_deployments(spark: SparkSession, sf: str) -> DataFrame:
    return X.plain(ingest.table_rows(X.deployment_lines(spark, sf), "deployments"))


def norm_status(spark: SparkSession, sf: str) -> DataFrame:
    return X.plain(ingest.table_rows(X.status_lines(spark, sf), "status"))


def norm_logs(spark: SparkSession, sf: str) -> DataFrame:
    return X.plain(ingest.table_rows(X.log_lines(spark, sf), "logs"))


def norm_traces(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.table_rows(X.span_lines(spark, sf), "traces")
    return X.plain(rows.withColumn("events", F.size("events")))


def norm_span_events(spark: SparkSession, sf: str) -> DataFrame:
    """Span events as stored, as JSON text; NULL where a span has none."""
    rows = ingest.table_rows(X.span_lines(spark, sf), "traces")
    shown = F.transform(
        "events",
        lambda e: F.concat_ws(" ", F.unix_micros(e["timestamp"]), e["name"], e["attributes"]),
    )
    return rows.select("trace_id", "span_id", F.array_join(shown, ";").alias("events"))


def norm_output(spark: SparkSession, sf: str) -> DataFrame:
    lines = X.lines_of(X.output_events(spark, sf), "ContainerOutput", "container-output.jsonl")
    return X.plain(ingest.table_rows(lines, "container-output"))


def norm_host_cpu(spark: SparkSession, sf: str) -> DataFrame:
    lines = X.lines_of(X.host_cpu_events(spark, sf), "HostCpu", "host-cpu.jsonl")
    return X.plain(ingest.table_rows(lines, "host-cpu"))


def norm_host_disk(spark: SparkSession, sf: str) -> DataFrame:
    samples = X.sampled(normalize.disk_sample(X.raw_disk(spark, sf)))
    return X.plain(ingest.table_rows(X.lines_of(samples, "HostDisk", "host-disk.jsonl"), "host-disk"))


def norm_host_memory(spark: SparkSession, sf: str) -> DataFrame:
    samples = X.sampled(normalize.memory_sample(X.raw_memory(spark, sf)))
    return X.plain(ingest.table_rows(X.lines_of(samples, "HostMemory", "host-memory.jsonl"), "host-memory"))


def inspections(spark: SparkSession, sf: str) -> DataFrame:
    """Inspect documents: containers not found, without state, without health, and full ones."""
    k, i, kind = F.col("k"), F.col("event_id"), F.col("event_type")
    started = F.date_format(F.timestamp_micros(F.col("us") - k * 1_500_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    health = F.when(
        k % 3 > 0,
        X.text(
            ',"Health":{"Status":"«h»","FailingStreak":«f»,"Log":[{"Output":"first"},{"Output":"out «i»"}]}',
            h=F.when(k % 3 == 1, "healthy").otherwise("unhealthy"),
            f=k % 4,
            i=i,
        ),
    ).otherwise("")
    status = F.when(kind == "view", "running").when(kind == "click", "paused").otherwise("exited")
    exit_code = F.when(kind == "purchase", X.text(',"ExitCode":«k»', k=k)).otherwise("")
    state = F.when(kind == "signup", "").otherwise(
        X.text(
            ',"State":{"Status":"«s»","StartedAt":"«t»"«e»«h»}',
            s=status,
            t=F.when(k % 5 == 0, "2026").otherwise(started),
            e=exit_code,
            h=health,
        )
    )
    count = F.when(k % 2 == 0, X.text(',"RestartCount":«k»', k=k)).otherwise("")
    doc = X.text('{"Id":"c«i»"«r»«s»}', i=i, r=count, s=state)
    found = kind != "error"
    return X.events(spark, sf).select(
        "service", F.col("us").alias("observed_us"), found.alias("found"), F.when(found, doc).alias("inspect")
    )


def inspect_to_status(spark: SparkSession, sf: str) -> DataFrame:
    return X.plain(normalize.inspect_to_status(inspections(spark, sf)))


def creations(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    created = F.date_format(F.timestamp_micros(F.col("us") - 2_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return X.events(spark, sf).select(
        X.text("Customer#«u»", u=F.lpad(u.cast("string"), 9, "0")).alias("service"),
        X.text("c«i»", i=F.col("event_id")).alias("container_id"),
        X.text("sha256:img«s»", s=F.col("k")).alias("image_id"),
        F.when(F.col("event_type") == "error", "2026").otherwise(created).alias("created"),
        F.when(F.col("event_type") == "click", "Cron").otherwise("Startup").alias("trigger"),
        F.lit("1.0").alias("version"),
        F.col("us").alias("observed_us"),
    )


def service_configs(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey")
    strings = lambda c: F.transform(F.sequence(F.lit(1), c), lambda i: i.cast("string"))
    return X.table(spark, sf, "customer").select(
        F.col("c_name").alias("service"),
        F.concat(F.lit("img-"), "c_mktsegment").alias("image"),
        F.when(n % 2 == 0, "no").otherwise("unless-stopped").alias("restart"),
        F.when(n % 3 > 0, X.text("«n»m", n=n)).alias("memory"),
        F.when(n % 4 > 0, X.text("0.«n»", n=n)).alias("cpus"),
        F.when(n > 12, F.struct(F.col("c_mktsegment").alias("host"))).alias("proxy"),
        F.when(n > 5, strings(n % 3 + 1)).alias("ports"),
        strings(n % 4 + 1).alias("volumes"),
        F.when(n > 20, strings(n % 2 + 1)).alias("networks"),
    )


def image_details(spark: SparkSession, sf: str) -> DataFrame:
    """Images by supplier number; sizes and digests are missing for some."""
    s = F.col("s_suppkey")
    return X.table(spark, sf, "supplier").select(
        X.text("sha256:img«s»", s=s).alias("image_id"),
        F.when(s % 5 > 0, s * 1_234_567).alias("size"),
        F.when(s % 4 > 0, F.array(X.text("repo@sha256:d«s»", s=s))).alias("repo_digests"),
    )


def enrich_deployments(spark: SparkSession, sf: str) -> DataFrame:
    return X.plain(
        normalize.enrich_deployments(
            creations(spark, sf), service_configs(spark, sf), image_details(spark, sf)
        )
    )


def host_percentages(spark: SparkSession, sf: str) -> DataFrame:
    memory = normalize.memory_sample(X.raw_memory(spark, sf)).select(
        F.unix_micros("timestamp").alias("timestamp"),
        "hostname",
        F.lit("memory").alias("kind"),
        F.col("used_memory").alias("used"),
        F.col("memory_usage_percent").alias("usage_percent"),
    )
    disk = normalize.disk_sample(X.raw_disk(spark, sf)).select(
        F.unix_micros("timestamp"), "hostname", F.col("mount_point"), "used_space", "usage_percent"
    )
    return memory.union(disk)


QUERIES = {
    f.__name__: f
    for f in (
        norm_deployments,
        norm_status,
        norm_logs,
        norm_traces,
        norm_span_events,
        norm_output,
        norm_host_cpu,
        norm_host_disk,
        norm_host_memory,
        inspect_to_status,
        enrich_deployments,
        host_percentages,
    )
}

_E = f"WITH {X.E}"
ORACLES = {
    "norm_deployments": f"WITH {X.D} {X.DEPLOYMENT_ROWS}",
    "norm_status": f"{_E} {X.STATUS_ROWS}",
    "norm_logs": f"WITH {X.L} SELECT CAST(make_timestamp(timestamp) AS DATE) AS date, * FROM l",
    "norm_traces": f"""WITH {X.P} SELECT CAST(make_timestamp(start_time) AS DATE) AS date, * EXCLUDE (heavy),
      CASE WHEN heavy IS NOT NULL THEN CAST(1 AS INTEGER) END AS events FROM p""",
    "norm_span_events": f"""WITH {X.P} SELECT trace_id, span_id,
      CASE WHEN heavy IS NOT NULL THEN (start_time + 5) || ' heavy {{"qty":' || heavy || '}}' END AS events FROM p""",
    "norm_output": f"{_E} {X.OUTPUT_ROWS}",
    "norm_host_cpu": f"{_E} {X.HOST_CPU_ROWS}",
    "norm_host_disk": f"{_E} {X.HOST_DISK_ROWS}",
    "norm_host_memory": f"{_E} {X.HOST_MEMORY_ROWS}",
    "inspect_to_status": f"""{_E} SELECT CAST(make_timestamp(us) AS DATE) AS date, us AS timestamp, service,
      CASE WHEN event_type = 'error' THEN '' ELSE 'c' || event_id END AS container_id,
      CASE event_type WHEN 'error' THEN 'not_found' WHEN 'signup' THEN 'unknown' WHEN 'view' THEN 'running'
        WHEN 'click' THEN 'paused' ELSE 'exited' END AS state,
      CASE WHEN event_type IN ('error', 'signup') OR k % 3 = 0 THEN 'none' WHEN k % 3 = 1 THEN 'healthy' ELSE 'unhealthy' END AS health_status,
      CASE WHEN event_type = 'purchase' THEN CAST(k AS INTEGER) END AS exit_code,
      CASE WHEN event_type <> 'error' AND k % 2 = 0 THEN CAST(k AS INTEGER) ELSE 0 END AS restart_count,
      CASE WHEN event_type IN ('error', 'signup') OR k % 5 = 0 THEN 0 ELSE k * 1500000 // 1000000 END AS uptime_seconds,
      CASE WHEN event_type IN ('error', 'signup') OR k % 3 = 0 THEN 0 ELSE CAST(k % 4 AS INTEGER) END AS failing_streak,
      CASE WHEN event_type NOT IN ('error', 'signup') AND k % 3 > 0 THEN 'out ' || event_id END AS last_health_output FROM e""",
    "enrich_deployments": f"""{_E} SELECT CAST(make_timestamp(us) AS DATE) AS date, us AS timestamp, c_name AS service,
      'img-' || c_mktsegment AS image,
      CASE WHEN s_suppkey % 4 > 0 THEN 'repo@sha256:d' || s_suppkey ELSE 'sha256:img' || k END AS image_sha,
      CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey * 1234567 // 1000000 ELSE 0 END AS image_size_mb,
      'c' || event_id AS container_id,
      CASE WHEN event_type = 'error' THEN us ELSE us - 2000000 END AS container_created_at,
      CASE WHEN event_type = 'click' THEN 'cron' ELSE 'startup' END AS trigger_type, '1.0' AS agent_version,
      CASE WHEN c_nationkey % 2 = 0 THEN 'no' ELSE 'unless-stopped' END AS restart_policy,
      CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey || 'm' END AS memory_limit,
      CASE WHEN c_nationkey % 4 > 0 THEN '0.' || c_nationkey END AS cpu_limit,
      c_nationkey > 12 AS proxy_enabled, CASE WHEN c_nationkey > 12 THEN c_mktsegment END AS proxy_host,
      CASE WHEN c_nationkey > 5 THEN c_nationkey % 3 + 1 ELSE 0 END AS port_mappings_count,
      c_nationkey % 4 + 1 AS volume_count, CASE WHEN c_nationkey > 20 THEN c_nationkey % 2 + 1 ELSE 0 END AS network_count
      FROM e JOIN customer ON c_name = 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') LEFT JOIN supplier ON s_suppkey = k""",
    "host_percentages": f"""{_E}, m AS ({X.HOST_MEMORY_ROWS}), d AS ({X.HOST_DISK_ROWS})
      SELECT timestamp, hostname, 'memory' AS kind, used_memory AS used, memory_usage_percent AS usage_percent FROM m
      UNION ALL SELECT timestamp, hostname, mount_point, used_space, usage_percent FROM d""",
}
