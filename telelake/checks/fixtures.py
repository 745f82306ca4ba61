"""Telemetry-shaped inputs derived from the test tables, and the SQL for the same values.

Every input uses all rows of its table. Modulo arithmetic chooses which *case* a row
plays (a broken line, an absent field), never whether it takes part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telelake.functions import scalars as S
from telelake.session import materialize, use_utc
from telelake.sources.tables import exists

BASE_US = 1_704_067_200_000_000  # 2024-01-01 00:00 UTC
SPAN_US = 30 * 86_400_000_000  # trace dates are folded into thirty days
SERVICES = 8


_stored: dict[tuple, tuple[DataFrame, str | None]] = {}


def once(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A fixture that several checks may start from: derived by the first, read by the others; no registered query uses it.

    Somebody may have cleared the scratch folder meanwhile; then it is derived again.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    found, file = _stored.get(key, (None, None))
    if found is None or (file and not exists(spark, file)):
        found = materialize(make(), name, keep=True)
        _stored[key] = found, next(iter(found.inputFiles()), None)
    return found


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; one that Spark reads in fewer tasks than there are cores is spread out."""
    use_utc(spark)
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def stored(line: Column) -> Column:
    """A line as if read from a file: built once, however often later steps refer to it."""
    return F.explode(F.array(line)).alias("value")


def as_stored(rows: DataFrame, line: Column, file: Column) -> DataFrame:
    """``(value, file)``; the line is a column first, where parts that it repeats are made once."""
    return rows.select(line.alias("value"), file.alias("file")).select(stored(F.col("value")), "file")


def folded(column: str) -> Column:
    return F.lit(BASE_US) + micros(column) % SPAN_US


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as microsecond integers, also inside arrays of structs."""
    out = []
    for field in df.schema:
        c = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            c = F.unix_micros(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def text(template: str, **columns: Column) -> Column:
    """Fill ``«name»`` marks of a template with columns."""
    parts, rest = [], template
    while "«" in rest:
        before, _, tail = rest.partition("«")
        name, _, rest = tail.partition("»")
        parts += [F.lit(before), columns[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        micros("ts").alias("us"),
        "user_id",
        "event_type",
        "value",
        "props",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        text("svc-«u»", u=F.col("user_id") % SERVICES).alias("service"),
    )


E = f"""e AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, props,
  CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS k, 'svc-' || (user_id % {SERVICES}) AS service FROM events)"""


# --- staged deployments: a fifth of the lines are broken in two ways, some in an unknown file
def deployment_events(spark: SparkSession, sf: str) -> DataFrame:
    k, i = F.col("k"), F.col("event_id")
    trigger = S.lookup(
        F.col("event_type"), {"click": "Cron", "view": "ImageUpdate", "purchase": "ManualReload"}, F.lit("Startup")
    )
    restart = S.lookup(i % 4, {0: "Always", 1: "No", 2: "OnFailure"}, F.lit("UnlessStopped"))
    image = text("reg«r».example.com/app«u»:v«k»", r=F.col("user_id") % 3, u=F.col("user_id"), k=k)
    proxied = k > 50
    return events(spark, sf).select(
        "event_type",
        i.cast("string").alias("event_id"),
        F.col("us").alias("timestamp"),
        "service",
        image.alias("image"),
        F.md5(image.cast("binary")).alias("image_sha"),
        (i % 900).alias("image_size_mb"),
        text("c«i»", i=i).alias("container_id"),
        (F.col("us") - 1_000_000).alias("container_created_at"),
        trigger.alias("trigger_type"),
        text("1.0.«k»", k=k % 5).alias("agent_version"),
        restart.alias("restart_policy"),
        F.when(k % 2 == 1, text("«k»m", k=k)).alias("memory_limit"),
        F.when(k % 3 > 0, text("0.«k»", k=k % 10)).alias("cpu_limit"),
        proxied.alias("proxy_enabled"),
        F.when(proxied, text("h«u».example.org", u=F.col("user_id"))).alias("proxy_host"),
        (k % 4).cast("int").alias("port_mappings_count"),
        (k % 3).cast("int").alias("volume_count"),
        (k % 2).cast("int").alias("network_count"),
    )


def envelope(variant: str, columns: list[str]) -> Column:
    return F.to_json(F.struct(F.struct(*columns).alias(variant)), {"ignoreNullFields": "false"})


def deployment_lines(spark: SparkSession, sf: str) -> DataFrame:
    source = deployment_events(spark, sf)
    number = F.col("event_id").cast("bigint")
    line = envelope("Deployment", [c for c in source.columns if c != "event_type"])
    wrong = text(
        '{"HostCpu":{"hostname":"h","timestamp":«t»,"load_avg_1m":1.0,"load_avg_5m":1.0,'
        '"load_avg_15m":1.0,"core_count":1}}',
        t=F.col("timestamp"),
    )
    failed = F.col("event_type") == "error"
    value = (
        F.when(failed & (number % 2 == 0), F.substring(line, F.lit(1), F.length(line) - 10))
        .when(failed, wrong)
        .otherwise(line)
    )
    file = F.when(number % 50 == 0, "other.jsonl").otherwise("deployments.jsonl")
    return as_stored(source, value, file)


D = (
    E
    + """, lines AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN 'other.jsonl' ELSE 'deployments.jsonl' END AS file FROM e),
d AS (SELECT *, 'reg' || (user_id % 3) || '.example.com/app' || user_id || ':v' || k AS image
  FROM lines WHERE event_type <> 'error' AND file = 'deployments.jsonl')"""
)
DEPLOYMENT_ROWS = """SELECT CAST(make_timestamp(us) AS DATE) AS date, us AS timestamp, service, image,
  md5(image) AS image_sha, event_id % 900 AS image_size_mb, 'c' || event_id AS container_id,
  us - 1000000 AS container_created_at,
  CASE event_type WHEN 'click' THEN 'cron' WHEN 'view' THEN 'image_update'
    WHEN 'purchase' THEN 'manual_reload' ELSE 'startup' END AS trigger_type,
  '1.0.' || (k % 5) AS agent_version,
  CASE event_id % 4 WHEN 0 THEN 'always' WHEN 1 THEN 'no' WHEN 2 THEN 'on-failure'
    ELSE 'unless-stopped' END AS restart_policy,
  CASE WHEN k % 2 = 1 THEN k || 'm' END AS memory_limit,
  CASE WHEN k % 3 > 0 THEN '0.' || (k % 10) END AS cpu_limit,
  k > 50 AS proxy_enabled,
  CASE WHEN k > 50 THEN 'h' || user_id || '.example.org' END AS proxy_host,
  CAST(k % 4 AS INTEGER) AS port_mappings_count, CAST(k % 3 AS INTEGER) AS volume_count,
  CAST(k % 2 AS INTEGER) AS network_count FROM d"""


# --- staged status
def status_events(spark: SparkSession, sf: str) -> DataFrame:
    k, kind = F.col("k"), F.col("event_type")
    state = S.lookup(kind, {"signup": "Created", "purchase": "Exited", "error": "Dead"}, F.lit("Running"))
    health = S.lookup(k % 4, {0: "Healthy", 1: "Unhealthy", 2: "Starting"}, F.lit("None"))
    return events(spark, sf).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("us").alias("timestamp"),
        "service",
        text("c«i»", i=F.col("event_id")).alias("container_id"),
        state.alias("state"),
        health.alias("health_status"),
        F.when(kind == "purchase", k.cast("int")).alias("exit_code"),
        (k % 5).cast("int").alias("restart_count"),
        F.col("event_id").alias("uptime_seconds"),
        (k % 3).cast("int").alias("failing_streak"),
        F.when(kind == "error", F.col("props")).alias("last_health_output"),
    )


def lines_of(source: DataFrame, variant: str, file: str) -> DataFrame:
    return as_stored(source, envelope(variant, source.columns), F.lit(file))


def status_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of(status_events(spark, sf), "ContainerStatus", "status.jsonl")


STATUS_ROWS = """SELECT CAST(make_timestamp(us) AS DATE) AS date, us AS timestamp, service,
  'c' || event_id AS container_id,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'exited'
    WHEN 'error' THEN 'dead' ELSE 'running' END AS state,
  CASE k % 4 WHEN 0 THEN 'healthy' WHEN 1 THEN 'unhealthy' WHEN 2 THEN 'starting' ELSE 'none' END AS health_status,
  CASE WHEN event_type = 'purchase' THEN CAST(k AS INTEGER) END AS exit_code,
  CAST(k % 5 AS INTEGER) AS restart_count, event_id AS uptime_seconds,
  CAST(k % 3 AS INTEGER) AS failing_streak,
  CASE WHEN event_type = 'error' THEN props END AS last_health_output FROM e"""


# --- host samples
def host_cpu_events(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return events(spark, sf).select(
        text("h«u»", u=F.col("user_id") % 10).alias("hostname"),
        F.col("us").alias("timestamp"),
        v.alias("load_avg_1m"),
        (v / 2).alias("load_avg_5m"),
        (v / 4).alias("load_avg_15m"),
        (F.col("k") % 16 + 1).alias("core_count"),
    )


def raw_memory(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return events(spark, sf).select(
        text("h«u»", u=F.col("user_id") % 10).alias("hostname"),
        F.col("us").alias("timestamp"),
        F.when(k % 25 == 0, 0).otherwise(k * 100).alias("total_memory"),
        (F.col("event_id") % 5000).alias("used_memory"),
        (k * 10).alias("available_memory"),
        (k % 7 * 1000).alias("total_swap"),
        (k % 7 * 10).alias("used_swap"),
    )


def raw_disk(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return events(spark, sf).select(
        text("h«u»", u=F.col("user_id") % 10).alias("hostname"),
        F.col("us").alias("timestamp"),
        text("/data«k»", k=k % 3).alias("mount_point"),
        text("sd«k»", k=k % 3).alias("disk_name"),
        F.lit("ext4").alias("file_system"),
        F.when(k % 25 == 0, 0).otherwise(k * 100).alias("total_space"),
        (F.col("event_id") % 5000).alias("available_space"),
    )


def sampled(rows: DataFrame) -> DataFrame:
    """A sample as the event its producer stages."""
    return rows.withColumn("timestamp", F.unix_micros("timestamp")).drop("date")


HOST = "CAST(make_timestamp(us) AS DATE) AS date, us AS timestamp, 'h' || (user_id % 10) AS hostname"
HOST_CPU_ROWS = f"""SELECT {HOST}, value AS load_avg_1m, value / 2 AS load_avg_5m, value / 4 AS load_avg_15m,
  CAST(k % 16 + 1 AS INTEGER) AS core_count FROM e"""
HOST_MEMORY_ROWS = f"""SELECT {HOST}, total_memory, used_memory, available_memory,
  CASE WHEN total_memory > 0 THEN CAST(used_memory AS DOUBLE) / CAST(total_memory AS DOUBLE) * 100.0 ELSE 0.0 END AS memory_usage_percent,
  total_swap, used_swap,
  CASE WHEN total_swap > 0 THEN CAST(used_swap AS DOUBLE) / CAST(total_swap AS DOUBLE) * 100.0 ELSE 0.0 END AS swap_usage_percent
FROM (SELECT *, CASE WHEN k % 25 = 0 THEN 0 ELSE k * 100 END AS total_memory, event_id % 5000 AS used_memory,
  k * 10 AS available_memory, k % 7 * 1000 AS total_swap, k % 7 * 10 AS used_swap FROM e)"""
HOST_DISK_ROWS = f"""SELECT {HOST}, '/data' || (k % 3) AS mount_point, 'sd' || (k % 3) AS disk_name,
  'ext4' AS file_system, total_space, used_space, available_space,
  CASE WHEN total_space > 0 THEN CAST(used_space AS DOUBLE) / CAST(total_space AS DOUBLE) * 100.0 ELSE 0.0 END AS usage_percent
FROM (SELECT *, greatest(total_space - available_space, 0) AS used_space
  FROM (SELECT *, CASE WHEN k % 25 = 0 THEN 0 ELSE k * 100 END AS total_space, event_id % 5000 AS available_space FROM e))"""


def output_events(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        F.col("us").alias("timestamp"),
        "service",
        F.col("service").alias("container_id"),
        F.when(F.col("event_type") == "error", "stderr").otherwise("stdout").alias("stream"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("message"),
        F.col("event_id").alias("sequence"),
    )


OUTPUT_ROWS = """SELECT CAST(make_timestamp(us) AS DATE) AS date, us AS timestamp, service,
  service AS container_id, CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream,
  event_type || ' ' || props AS message, event_id AS sequence FROM e"""


# --- log requests: one per event; an error carries a second record with nested values
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    k, i, u, kind = F.col("k"), F.col("event_id"), F.col("user_id"), F.col("event_type")
    named = '{"key":"service.name","value":{"stringValue":"«s»"}}'
    resource = (
        F.when(u % 10 == 1, text('"resource":{"attributes":[{"key":"service.name","value":{"intValue":"«u»"}}]},', u=u))
        .when(u % 10 == 3, F.lit(""))
        .when(
            u % 2 == 0,
            text(
                '"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"old"}},' + named + "]},",
                s=F.col("service"),
            ),
        )
        .otherwise(text('"resource":{"attributes":[' + named + "]},", s=F.col("service")))
    )
    body = (
        F.when(kind == "view", text('"body":{"stringValue":"viewed «k»"},', k=k))
        .when(kind == "click", text('"body":{"intValue":"«k»"},', k=k))
        .when(kind == "purchase", text('"body":{"doubleValue":«v»},', v=F.col("value")))
        .when(kind == "signup", text('"body":{"boolValue":«b»},', b=k % 2 == 0))
        .otherwise("")
    )
    severity = S.lookup(kind, {"error": "ERROR", "view": "INFO", "click": "INFO"}, F.lit(""))
    no_ids = i % 7 == 0
    trace = F.when(no_ids, "").otherwise(F.lpad(F.hex(i), 32, "0"))
    span = F.when(no_ids, "").otherwise(F.lpad(F.hex(i + (1 << 40)), 16, "0"))
    attributes = F.when(i % 5 == 0, "[]").otherwise(text('[{"key":"k","value":{"intValue":"«k»"}}]', k=k))
    first = text(
        '{"timeUnixNano":"«t»","severityText":"«s»",«b»"traceId":"«tr»","spanId":"«sp»","attributes":«a»}',
        t=F.col("us") * 1000 + 999,
        s=severity,
        b=body,
        tr=trace,
        sp=span,
        a=attributes,
    )
    second = text(
        ',{"timeUnixNano":"«t»","severityText":"FATAL","body":{"kvlistValue":{"values":['
        '{"key":"tags","value":{"arrayValue":{"values":[{"stringValue":"a"},{},{"boolValue":true}]}}},'
        '{"key":"code","value":{"intValue":"«k»"}},{"key":"none"}]}},"attributes":['
        '{"key":"k","value":{"intValue":"«k»"}},{"key":"none"},'
        '{"key":"deep","value":{"arrayValue":{"values":[{"intValue":"«k»"}]}}},'
        '{"key":"k","value":{"stringValue":"last"}}]}',
        t=F.col("us") * 1000 + 1_000_999,
        k=k,
    )
    records = F.concat(first, F.when(kind == "error", second).otherwise(""))
    line = text('{"LogBatch":{"resourceLogs":[{«r»"scopeLogs":[{"logRecords":[«l»]}]}]}}', r=resource, l=records)
    return as_stored(events(spark, sf), line, F.lit("logs.jsonl"))


L = (
    E
    + """, r AS (SELECT *, CASE WHEN user_id % 10 IN (1, 3) THEN 'unknown' ELSE service END AS svc,
  CASE WHEN user_id % 10 = 1 THEN '{"service.name":' || user_id || '}' WHEN user_id % 10 = 3 THEN NULL
    ELSE '{"service.name":"' || service || '"}' END AS resource FROM e),
l AS (SELECT us AS timestamp, svc AS service,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'INFO' WHEN 'click' THEN 'INFO' END AS severity,
  CASE event_type WHEN 'view' THEN 'viewed ' || k WHEN 'click' THEN CAST(k AS VARCHAR)
    WHEN 'purchase' THEN regexp_replace(CAST(value AS VARCHAR), '[.]0$', '')
    WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END END AS body,
  CASE WHEN event_id % 7 <> 0 THEN lpad(lower(to_hex(event_id)), 32, '0') END AS trace_id,
  CASE WHEN event_id % 7 <> 0 THEN lpad(lower(to_hex(event_id + 1099511627776)), 16, '0') END AS span_id,
  CASE WHEN event_id % 5 <> 0 THEN '{"k":' || k || '}' END AS attributes, resource FROM r
UNION ALL SELECT us + 1000, svc, 'FATAL', '{"code":' || k || ',"tags":["a",true]}', NULL, NULL,
  '{"deep":[' || k || '],"k":"last"}', resource FROM r WHERE event_type = 'error')"""
)


# --- span requests: one per order (root span) and one per line item (item and handover)
def item_key(tail: str) -> Column:
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    parts = [
        F.col("l_orderkey"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
        F.col("l_linenumber"),
        F.col("l_quantity").cast("bigint"),
        cents("l_extendedprice"),
        cents("l_discount"),
        cents("l_tax"),
        F.col("l_returnflag"),
        micros("l_shipdate"),
        F.lit(tail),
    ]
    return F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def span_lines(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    elsewhere = F.when(F.col("o_orderstatus") == "P", o + (1 << 50)).otherwise(o)
    start = folded("o_orderdate") * 1000
    root = text(
        '{"SpanBatch":{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":'
        '{"stringValue":"orders"}}]},"scopeSpans":[{"spans":[{"traceId":"«t»","spanId":"«s»","name":"order",'
        '"kind":2,"startTimeUnixNano":"«b»","endTimeUnixNano":"«e»","attributes":[{"key":"priority","value":'
        '{"stringValue":"«p»"}}]}]}]}]}}',
        t=F.lpad(F.hex(elsewhere), 32, "0"),
        s=F.lpad(F.hex(o + (1 << 40)), 16, "0"),
        b=start,
        e=start + 3_600_000_000_000,
        p=F.col("o_orderpriority"),
    )
    roots = as_stored(table(spark, sf, "orders"), root, F.lit("traces.jsonl"))

    number, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("bigint")
    begin = folded("l_shipdate") * 1000 + 999
    end = folded("l_shipdate") * 1000 + (number - 4) * quantity * 1_500_000_000
    code = F.when(number == 4, 9).otherwise(S.lookup(F.col("l_returnflag"), {"N": 0, "A": 1}, F.lit(2)))
    message = F.when(F.col("l_returnflag") == "R", "returned").otherwise("")
    status = F.when(number == 3, "").otherwise(text('"status":{"code":«c»,"message":"«m»"},', c=code, m=message))
    heavy = F.when(
        quantity > 25,
        text(
            '{"timeUnixNano":"«t»","name":"heavy","attributes":[{"key":"qty","value":{"intValue":"«q»"}}]}',
            t=begin + 5000,
            q=quantity,
        ),
    ).otherwise("")
    trace = F.lpad(F.hex("l_orderkey"), 32, "0")
    item = text(
        '{"traceId":"«t»","spanId":"«s»","parentSpanId":"«p»","name":"item","kind":«k»,'
        '"startTimeUnixNano":"«b»","endTimeUnixNano":"«e»",«st»"attributes":[],"events":[«h»]}',
        t=trace,
        s=item_key("item"),
        p=F.lpad(F.hex(F.col("l_orderkey") + (1 << 40)), 16, "0"),
        k=number,
        b=begin,
        e=end,
        st=status,
        h=heavy,
    )
    handover = text(
        '{"traceId":"«t»","spanId":"«s»","parentSpanId":"«p»","name":"handover",'
        '"startTimeUnixNano":"«b»","endTimeUnixNano":"«e»"}',
        t=trace,
        s=item_key("handover"),
        p=item_key("item"),
        b=begin,
        e=begin + 2_000_000,
    )
    line = text('{"SpanBatch":{"resourceSpans":[{"scopeSpans":[{"spans":[«i»,«h»]}]}]}}', i=item, h=handover)
    items = as_stored(table(spark, sf, "lineitem"), line, F.lit("traces.jsonl"))
    return roots.union(items)


_ITEM_KEY = """left(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT),
  CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT),
  CAST(round(l_tax * 100) AS BIGINT), l_returnflag, epoch_us(l_shipdate), '{tail}')), 16)"""
P = f"""i AS (SELECT *, {BASE_US} + epoch_us(l_shipdate) % {SPAN_US} AS us, CAST(l_quantity AS BIGINT) AS q,
  {_ITEM_KEY.format(tail="item")} AS item_id, {_ITEM_KEY.format(tail="handover")} AS handover_id,
  lpad(lower(to_hex(l_orderkey)), 32, '0') AS trace_id,
  lpad(lower(to_hex(l_orderkey + 1099511627776)), 16, '0') AS root_id FROM lineitem),
p AS (SELECT lpad(lower(to_hex(CASE WHEN o_orderstatus = 'P' THEN o_orderkey + 1125899906842624 ELSE o_orderkey END)), 32, '0') AS trace_id,
  lpad(lower(to_hex(o_orderkey + 1099511627776)), 16, '0') AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id,
  'order' AS name, 'SERVER' AS kind, {BASE_US} + epoch_us(o_orderdate) % {SPAN_US} AS start_time, {BASE_US} + epoch_us(o_orderdate) % {SPAN_US} + 3600000000 AS end_time,
  CAST(3600000 AS BIGINT) AS duration_ms, CAST(NULL AS VARCHAR) AS status_code, CAST(NULL AS VARCHAR) AS status_message,
  'orders' AS service, '{{"priority":"' || o_orderpriority || '"}}' AS attributes, CAST(NULL AS BIGINT) AS heavy FROM orders
UNION ALL SELECT trace_id, item_id, root_id, 'item',
  CASE l_linenumber WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'SERVER' WHEN 3 THEN 'CLIENT' WHEN 4 THEN 'PRODUCER'
    WHEN 5 THEN 'CONSUMER' ELSE 'UNSPECIFIED' END,
  us, us + (l_linenumber - 4) * q * 1500000,
  CAST(trunc(((l_linenumber - 4) * q * 1500000000 - 999) / 1000000.0) AS BIGINT),
  CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 'UNKNOWN' WHEN l_returnflag = 'N' THEN 'UNSET'
    WHEN l_returnflag = 'A' THEN 'OK' ELSE 'ERROR' END,
  CASE WHEN l_linenumber <> 3 AND l_returnflag = 'R' THEN 'returned' END,
  'unknown', NULL, CASE WHEN q > 25 THEN q END FROM i
UNION ALL SELECT trace_id, handover_id, item_id, 'handover', 'UNSPECIFIED', us, us + 2000, 2, NULL, NULL, 'unknown', NULL, NULL FROM i)"""


# --- output chunks: one per document
def chunks(spark: SparkSession, sf: str, later_us: int = 0) -> DataFrame:
    """``later_us`` moves all times on."""
    d, base = F.col("doc_id"), BASE_US + later_us
    observed = F.lit(base) + d * 1_000_000 + 500_000
    stream = S.lookup(d % 3, {0: "stdout", 1: "stderr"}, F.lit("console"))

    def stamped(line: Column, i: Column) -> Column:
        at = F.timestamp_micros(F.lit(base) + d * 1_000_000 + i)
        clock = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z "))
        return F.concat(F.when(d % 11 == 0, "").when(d % 13 == 0, "2026 ").otherwise(clock), line)

    body = F.array_join(F.transform(F.split("text", "\n"), stamped), "\n")
    return table(spark, sf, "documents").select(
        d.alias("chunk_id"),
        F.col("source").alias("service"),
        stream.alias("stream"),
        body.alias("text"),
        observed.alias("observed_us"),
    )


C = f"""c AS (SELECT doc_id AS chunk_id, source AS service,
  CASE doc_id % 3 WHEN 0 THEN 'stdout' WHEN 1 THEN 'stderr' ELSE 'console' END AS stream,
  {BASE_US} + doc_id * 1000000 AS t0, string_split(text, chr(10)) AS parts FROM documents),
u AS (SELECT *, unnest(parts) AS raw, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS line_no FROM c),
ln AS (SELECT chunk_id, service, stream, line_no, t0 + 500000 AS observed_us,
  CASE WHEN chunk_id % 11 = 0 OR chunk_id % 13 = 0 THEN t0 + 500000 ELSE t0 + line_no END AS timestamp_us,
  CASE WHEN chunk_id % 11 = 0 THEN raw WHEN chunk_id % 13 = 0 THEN '2026 ' || raw
    ELSE strftime(make_timestamp(t0 + line_no), '%Y-%m-%dT%H:%M:%S.%f') || '789Z ' || raw END AS line FROM u),
kept AS (SELECT * FROM ln WHERE stream IN ('stdout', 'stderr') AND line <> ''),
cut AS (SELECT * EXCLUDE (line), CASE WHEN strlen(line) > 4096 THEN
  left(line, CAST(list_max(list_filter(range(1020, 4097), lambda n: strlen(left(line, CAST(n AS INTEGER))) <= 4096)) AS INTEGER))
    || '...[TRUNCATED]' ELSE line END AS line FROM kept),
parsed AS (SELECT * EXCLUDE (line), CASE WHEN strpos(line, ' ') > 0 THEN substr(line, strpos(line, ' ') + 1) ELSE line END AS message FROM cut)"""
