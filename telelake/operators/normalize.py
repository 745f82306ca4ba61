"""Decoded events to table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telelake.functions import otlp
from telelake.functions import scalars as S
from telelake.sources.tables import TABLES


def _rows(df: DataFrame, table: str, **derived: Column) -> DataFrame:
    """Project to the table's columns, deriving date and timestamp from microseconds."""
    micros = F.col("timestamp")
    fixed = {"date": S.date_bucket(micros), "timestamp": F.timestamp_micros(micros), **derived}
    fields = TABLES[table].schema
    return df.select(
        *[fixed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in fields]
    )


def deployments(events: DataFrame) -> DataFrame:
    return _rows(
        events,
        "deployments",
        container_created_at=F.timestamp_micros("container_created_at"),
        trigger_type=S.trigger_code(F.col("trigger_type")),
        restart_policy=S.restart_code(F.col("restart_policy")),
    )


def status(events: DataFrame) -> DataFrame:
    return _rows(
        events,
        "status",
        state=S.state_code(F.col("state")),
        health_status=S.health_code(F.col("health_status")),
    )


def container_output(events: DataFrame) -> DataFrame:
    return _rows(events, "container-output")


def host_cpu(events: DataFrame) -> DataFrame:
    return _rows(events, "host-cpu")


def host_disk(events: DataFrame) -> DataFrame:
    return _rows(events, "host-disk")


def host_memory(events: DataFrame) -> DataFrame:
    return _rows(events, "host-memory")


def _nanos(text: Column) -> Column:
    """Nanoseconds of a text field; an absent field counts as 0, an unreadable one is NULL."""
    return F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(text.try_cast("bigint"))


def _lookup(texts: Column, found: Column, nested: bool) -> Column:
    return otlp.nested_lookup(texts, found) if nested else otlp.no_nested_lookup(found)


def logs(requests: DataFrame, nested: bool = True) -> DataFrame:
    """One row per log record of each request.

    ``nested=False`` keeps the whole plan inside the JVM and fails on array or
    key/value-list attributes instead of translating them.
    """
    resources = requests.select(F.explode("resourceLogs").alias("r")).select(
        F.col("r.resource.attributes").alias("_resource"), F.col("r.scopeLogs").alias("_scopes")
    )
    pairs = F.col("_resource")
    names = _lookup(otlp.nested_texts(pairs), otlp.any_nested(pairs), nested)
    resources = resources.withColumn("_names", names)
    resources = resources.select(
        otlp.service_name(F.col("_resource")).alias("service"),
        otlp.key_values_json(F.col("_resource"), F.col("_names")).alias("resource"),
        F.explode("_scopes").alias("_scope"),
    )
    records = resources.select("service", "resource", F.explode("_scope.logRecords").alias("l"))
    texts = F.concat(
        otlp.nested_texts(F.col("l.attributes")),
        F.array_compact(F.array(otlp.nested_text(F.col("l.body")))),
    )
    found = otlp.any_nested(F.col("l.attributes")) | F.coalesce(otlp.is_nested(F.col("l.body")), F.lit(False))
    records = records.withColumn("_lookup", _lookup(texts, found, nested))
    records = records.withColumn("_us", S.nanos_to_micros(_nanos(F.col("l.timeUnixNano"))))
    return records.select(
        S.date_bucket(F.col("_us")).alias("date"),
        F.timestamp_micros("_us").alias("timestamp"),
        "service",
        S.empty_to_null(F.col("l.severityText")).alias("severity"),
        otlp.body_text(F.col("l.body"), F.col("_lookup")).alias("body"),
        otlp.optional_hex_id(F.col("l.traceId")).alias("trace_id"),
        otlp.optional_hex_id(F.col("l.spanId")).alias("span_id"),
        otlp.key_values_json(F.col("l.attributes"), F.col("_lookup")).alias("attributes"),
        "resource",
    )


def span_events(events: Column, lookup: Column | None = None) -> Column:
    """Span events as stored; no events give NULL rather than an empty array."""
    stored = F.transform(
        events,
        lambda e: F.named_struct(
            F.lit("timestamp"),
            F.timestamp_micros(S.nanos_to_micros(_nanos(e.getField("timeUnixNano")))),
            F.lit("name"),
            F.coalesce(e.getField("name"), F.lit("")),
            F.lit("attributes"),
            otlp.key_values_json(e.getField("attributes"), lookup),
        ),
    )
    return F.when(F.size(events) > 0, stored)


def traces(requests: DataFrame, nested: bool = True) -> DataFrame:
    """One row per span of each request; see :func:`logs` for ``nested``."""
    resources = requests.select(F.explode("resourceSpans").alias("r")).select(
        otlp.service_name(F.col("r.resource.attributes")).alias("service"),
        F.explode("r.scopeSpans").alias("_scope"),
    )
    spans = resources.select("service", F.explode("_scope.spans").alias("s"))
    of_events = F.flatten(
        F.transform(F.col("s.events"), lambda e: otlp.nested_texts(e.getField("attributes")))
    )
    texts = F.concat(
        otlp.nested_texts(F.col("s.attributes")),
        F.coalesce(of_events, F.array().cast("array<string>")),
    )
    found = otlp.any_nested(F.col("s.attributes")) | F.coalesce(
        F.exists("s.events", lambda e: otlp.any_nested(e.getField("attributes"))), F.lit(False)
    )
    spans = spans.withColumn("_lookup", _lookup(texts, found, nested))
    spans = spans.withColumns(
        {"_start": _nanos(F.col("s.startTimeUnixNano")), "_end": _nanos(F.col("s.endTimeUnixNano"))}
    )
    status = F.col("s.status")
    return spans.select(
        S.date_bucket(S.nanos_to_micros(F.col("_start"))).alias("date"),
        F.coalesce(otlp.hex_id(F.col("s.traceId")), F.lit("")).alias("trace_id"),
        F.coalesce(otlp.hex_id(F.col("s.spanId")), F.lit("")).alias("span_id"),
        otlp.optional_hex_id(F.col("s.parentSpanId")).alias("parent_span_id"),
        F.coalesce(F.col("s.name"), F.lit("")).alias("name"),
        S.span_kind(F.col("s.kind")).alias("kind"),
        F.timestamp_micros(S.nanos_to_micros(F.col("_start"))).alias("start_time"),
        F.timestamp_micros(S.nanos_to_micros(F.col("_end"))).alias("end_time"),
        S.duration_ms(F.col("_start"), F.col("_end")).alias("duration_ms"),
        F.when(status.isNotNull(), S.span_status(F.col("s.status.code"))).alias("status_code"),
        S.empty_to_null(F.col("s.status.message")).alias("status_message"),
        "service",
        otlp.key_values_json(F.col("s.attributes"), F.col("_lookup")).alias("attributes"),
        span_events(F.col("s.events"), F.col("_lookup")).alias("events"),
    )


NORMALIZERS = {
    "deployments": deployments,
    "status": status,
    "logs": logs,
    "traces": traces,
    "container-output": container_output,
    "host-cpu": host_cpu,
    "host-disk": host_disk,
    "host-memory": host_memory,
}

INSPECT = (
    "struct<Id:string,RestartCount:bigint,State:struct<Status:string,ExitCode:bigint,"
    "StartedAt:string,Health:struct<Status:string,FailingStreak:bigint,"
    "Log:array<struct<Output:string>>>>>"
)
# State and health spellings of a container inspect document.
INSPECT_STATES = "created running paused restarting removing exited dead".split()
INSPECT_HEALTHS = "healthy unhealthy starting none".split()


def inspect_to_status(observations: DataFrame) -> DataFrame:
    """``(service, observed_us, found, inspect)`` to status rows.

    ``inspect`` is the JSON document of a found container. A container that was
    looked for and not found is a status of its own.
    """
    doc = observations.withColumn("i", F.from_json("inspect", INSPECT))
    state, health = F.col("i.State"), F.col("i.State.Health")
    known_state = F.lower(state.getField("Status"))
    known_health = F.lower(health.getField("Status"))
    zero = F.lit(0)
    found = F.col("found")
    last_log = F.try_element_at(health.getField("Log"), F.lit(-1)).getField("Output")
    return doc.select(
        S.date_bucket(F.col("observed_us")).alias("date"),
        F.timestamp_micros("observed_us").alias("timestamp"),
        "service",
        F.when(found, F.coalesce(F.col("i.Id"), F.lit(""))).otherwise("").alias("container_id"),
        F.when(~found, S.STATE_CODES["NotFound"])
        .when(known_state.isin(INSPECT_STATES), known_state)
        .when(known_state == "", S.STATE_CODES["Empty"])
        .otherwise(S.STATE_CODES["Unknown"])
        .alias("state"),
        F.when(found & known_health.isin(INSPECT_HEALTHS), known_health)
        .otherwise(S.HEALTH_CODES["None"])
        .alias("health_status"),
        F.when(found, state.getField("ExitCode").try_cast("int")).alias("exit_code"),
        F.when(found, F.coalesce(F.col("i.RestartCount").try_cast("int"), zero)).otherwise(0).alias("restart_count"),
        F.when(found, S.uptime_seconds(state.getField("StartedAt"), F.col("observed_us")))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("uptime_seconds"),
        F.when(found, F.coalesce(health.getField("FailingStreak").try_cast("int"), zero))
        .otherwise(0)
        .alias("failing_streak"),
        F.when(found, last_log).alias("last_health_output"),
    )


def enrich_deployments(creations: DataFrame, configs: DataFrame, images: DataFrame) -> DataFrame:
    """Container creations joined with their configuration and image.

    ``creations(service, container_id, image_id, created, trigger, version, observed_us)``,
    ``configs(service, image, restart, memory, cpus, proxy, ports, volumes, networks)``
    and ``images(image_id, size, repo_digests)`` are keyed by service and by image.
    """
    joined = creations.join(configs, "service").join(images, "image_id", "left")
    created = F.coalesce(S.rfc3339_micros(F.col("created")), F.col("observed_us"))
    first_digest = F.get(F.col("repo_digests"), F.lit(0))
    size = F.coalesce(F.col("size"), F.lit(0).cast("bigint"))
    count = lambda c: F.coalesce(F.array_size(F.col(c)), F.lit(0))
    return joined.select(
        S.date_bucket(F.col("observed_us")).alias("date"),
        F.timestamp_micros("observed_us").alias("timestamp"),
        "service",
        "image",
        F.coalesce(first_digest, F.col("image_id"), F.lit("")).alias("image_sha"),
        S.int_div(size, 1_000_000).alias("image_size_mb"),
        "container_id",
        F.timestamp_micros(created).alias("container_created_at"),
        S.trigger_code(F.col("trigger")).alias("trigger_type"),
        F.col("version").alias("agent_version"),
        S.restart_code(F.col("restart")).alias("restart_policy"),
        F.col("memory").alias("memory_limit"),
        F.col("cpus").alias("cpu_limit"),
        F.col("proxy").isNotNull().alias("proxy_enabled"),
        F.col("proxy.host").alias("proxy_host"),
        count("ports").alias("port_mappings_count"),
        count("volumes").alias("volume_count"),
        count("networks").alias("network_count"),
    )


def memory_sample(raw: DataFrame) -> DataFrame:
    """Host memory rows from raw counters."""
    return raw.select(
        S.date_bucket(F.col("timestamp")).alias("date"),
        F.timestamp_micros("timestamp").alias("timestamp"),
        "hostname",
        "total_memory",
        "used_memory",
        "available_memory",
        S.percent(F.col("used_memory"), F.col("total_memory")).alias("memory_usage_percent"),
        "total_swap",
        "used_swap",
        S.percent(F.col("used_swap"), F.col("total_swap")).alias("swap_usage_percent"),
    )


def disk_sample(raw: DataFrame) -> DataFrame:
    """Host disk rows from raw counters, one per mount point."""
    used = S.disk_used(F.col("total_space"), F.col("available_space"))
    return raw.select(
        S.date_bucket(F.col("timestamp")).alias("date"),
        F.timestamp_micros("timestamp").alias("timestamp"),
        "hostname",
        "mount_point",
        "disk_name",
        "file_system",
        "total_space",
        used.alias("used_space"),
        "available_space",
        S.percent(used, F.col("total_space")).alias("usage_percent"),
    )
