"""Output capture, joins, rules, changes and reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telelake.checks import fixtures as X
from telelake.checks.functions import OBSERVED, digest_observations
from telelake.functions import scalars as S
from telelake.operators import changes, correlate, dependencies, layers, normalize, output, routing, schedule, slots
from telelake.session import materialize
from telelake.sources import ingest

NOW_S = 1_704_067_200 + 400  # the capture window ends inside the fixture's first minutes
RENEWAL_NOW = 1_717_200_000  # 2024-06-01 UTC


# --- container output
def output_lines(spark: SparkSession, sf: str) -> DataFrame:
    return output.lines(X.chunks(spark, sf)).select("chunk_id", "line_no", "stream", "line")


def output_truncate(spark: SparkSession, sf: str) -> DataFrame:
    lines = output.lines(X.chunks(spark, sf))
    return lines.select("chunk_id", "line_no", output.truncate(F.col("line")).alias("line"))


def output_parse(spark: SparkSession, sf: str) -> DataFrame:
    return output.capture(X.chunks(spark, sf))


def output_sequence(spark: SparkSession, sf: str) -> DataFrame:
    numbered = output.sequence(output.capture(X.chunks(spark, sf)))
    return numbered.select("service", "date", "chunk_id", "line_no", "sequence")


def capture_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of earlier captures; half of the services have none."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("bigint")
    sources = X.table(spark, sf, "documents").select(F.col("source").alias("service"), number.alias("n")).distinct()
    return sources.select("service", F.when(F.col("n") % 2 == 0, F.lit(NOW_S) - 300 + F.col("n")).alias("mark")).where(
        "mark is not null"
    )


def output_increment(spark: SparkSession, sf: str) -> DataFrame:
    read = output.increment(output.capture(X.chunks(spark, sf)), capture_marks(spark, sf), NOW_S)
    return read.select("service", "chunk_id", "line_no", "timestamp_us")


def output_marks(spark: SparkSession, sf: str) -> DataFrame:
    marks = capture_marks(spark, sf)
    read = output.increment(output.capture(X.chunks(spark, sf)), marks, NOW_S)
    return output.advance_marks(marks, read, NOW_S)


def output_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Three captures in a row over all output, each from the marks of the one before; the windows grow with the data."""
    parsed = materialize(output.capture(X.chunks(spark, sf)), "parsed")
    last = X.table(spark, sf, "documents").agg(F.max("doc_id")).first()[0]
    marks, windows = capture_marks(spark, sf).limit(0), []
    for number in (1, 2, 3):
        now_s = X.BASE_US // 1_000_000 + last * number // 3 + 2
        read = output.increment(parsed, marks, now_s)
        # A capture keeps its marks: the next one starts from what is stored.
        marks = materialize(output.advance_marks(marks, read, now_s), "marks")
        windows.append(read.select(F.lit(number).alias("window"), "service", "chunk_id", "line_no"))
    kept = marks.select(F.lit(0), "service", F.col("mark"), F.lit(-1))
    return windows[0].union(windows[1]).union(windows[2]).union(kept)


def output_tail(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalize.container_output(X.output_events(spark, sf))
    return X.plain(output.tail(rows, 5)).select("service", "timestamp", "sequence", "message")


def output_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Place of each line in the replay: by task and, inside a task, by row."""
    rows = output.replay(normalize.container_output(X.output_events(spark, sf)))
    # Numbers of rows as they come; ranks of these numbers do not depend on the tasks.
    placed = X.plain(rows.withColumn("_at", F.monotonically_increasing_id()))
    nth = F.row_number().over(Window.partitionBy("service").orderBy("_at"))
    return placed.select("service", "timestamp", "sequence", nth.alias("place"))


# --- routing and dependencies
def requests(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "pages").select(
        F.col("page_id").alias("request_id"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.regexp_extract("url", "^https?://[^/]+([^?#]*)", 1).alias("path"),
    )


def routes(spark: SparkSession, sf: str) -> DataFrame:
    hosts = requests(spark, sf).select("host").distinct()
    paths = F.when(F.length("host") % 2 == 0, F.array(*map(F.lit, ("en/", "/fr", "/en/8", "/en/853")))).otherwise(
        F.array(*map(F.lit, ("/", "/en", "/fr", "/en/8", "/en/853")))
    )
    listed = hosts.select("host", F.explode(paths).alias("path"))
    return listed.withColumn("service", F.concat("host", S.normal_path(F.col("path"))))


def route_join(spark: SparkSession, sf: str) -> DataFrame:
    return routing.route_join(requests(spark, sf), routes(spark, sf))


def dependent_services(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as services: two neighbours, one target shared by most and one that is never loaded."""
    key = F.col("c_custkey")
    name = lambda c: X.text("Customer#«n»", n=F.lpad(c.cast("string"), 9, "0"))
    kind = S.lookup(key % 3, {0: "started", 1: "service-completed"}, F.lit("Healthy"))
    wanted = F.filter(
        F.array(
            F.struct(name(key + 1).alias("target"), kind.alias("condition")),
            F.struct(name(key + 2).alias("target"), F.lit("healthy").alias("condition")),
            F.struct(
                F.when(F.col("c_acctbal") > 0, name(F.lit(0))).alias("target"),
                F.lit("started").alias("condition"),
            ),
            F.struct(
                F.when(key % 4 == 0, F.lit("ghost")).alias("target"), F.lit("started").alias("condition")
            ),
        ),
        lambda e: e["target"].isNotNull(),
    )
    # The shared target may coincide with a neighbour; a map holds a key once.
    own = F.filter(wanted, lambda e: (key > 0) | (e["target"] != name(F.lit(0))))
    return X.table(spark, sf, "customer").select(
        F.col("c_name").alias("name"),
        F.map_from_entries(own).alias("depends_on"),
    )


def prune_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    pruned = dependencies.prune_dependencies(dependent_services(spark, sf))
    entries = F.transform(F.map_entries("depends_on"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return pruned.select("name", F.array_join(F.array_sort(entries), ",").alias("depends_on"))


def gated_services(spark: SparkSession, sf: str) -> DataFrame:
    """Customers depending on event services; some depend on nothing, many on one service."""
    key, n = F.col("c_custkey"), F.col("c_nationkey")
    kind = S.lookup(n % 3, {0: "started", 1: "completed"}, F.lit("healthy"))
    own = F.struct(X.text("svc-«k»", k=key % 12 + 2).alias("target"), kind.alias("condition"))
    shared = F.struct(
        F.lit("svc-1").alias("target"), S.lookup(n % 2, {0: "started"}, F.lit("completed")).alias("condition")
    )
    edges = F.when(F.col("c_mktsegment") == "BUILDING", F.array(own, shared)).when(
        F.col("c_acctbal") > 0, F.array(own)
    )
    empty = F.create_map().cast("map<string,string>")
    return X.table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.coalesce(F.map_from_entries(edges), empty).alias("depends_on")
    )


def status_rows(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.status(X.status_events(spark, sf))


def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return dependencies.latest_status(status_rows(spark, sf))


def dependency_gate(spark: SparkSession, sf: str) -> DataFrame:
    return dependencies.dependency_gate(gated_services(spark, sf), latest_status(spark, sf))


def assign_slots(spark: SparkSession, sf: str) -> DataFrame:
    customers = X.table(spark, sf, "customer")
    keys = customers.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("position"))
    current = customers.where("c_mktsegment = 'BUILDING'").select(
        F.col("c_name").alias("name"), (F.col("c_custkey") * 2 + 2).alias("slot")
    )
    stale = X.table(spark, sf, "supplier").select(F.col("s_name"), (F.col("s_suppkey") * 2 + 3))
    in_use = X.table(spark, sf, "nation").select((F.col("n_nationkey") * 3 + 5).alias("slot"))
    return slots.assign_slots(keys, current.union(stale), in_use=in_use)


# --- traces and logs
def spans(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Rows of the traces table; with ``columns`` these are stored, for readers that go over them more than once."""
    rows = ingest.table_rows(X.span_lines(spark, sf), "traces")
    return materialize(rows.select(*columns), "traces") if columns else rows


def log_rows(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Rows of the logs table, stored as those of :func:`spans`."""
    rows = ingest.table_rows(X.log_lines(spark, sf), "logs")
    return materialize(rows.select(*columns), "logs") if columns else rows


def logs_with_spans(spark: SparkSession, sf: str) -> DataFrame:
    logs = log_rows(spark, sf, "timestamp", "service", "severity", "trace_id", "span_id")
    # Stored, the engine knows how large they are before it chooses how to join.
    named = spans(spark, sf, "trace_id", "span_id", "name", "kind", "duration_ms")
    joined = correlate.logs_with_spans(logs, named, "left")
    return X.plain(joined).select(
        "timestamp", "service", "severity", "trace_id", "span_id", "span_name", "span_kind", "span_duration_ms"
    )


def span_children(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.span_children(spans(spark, sf, "trace_id", "span_id", "parent_span_id", "duration_ms"))


def span_orphans(spark: SparkSession, sf: str) -> DataFrame:
    rows = spans(spark, sf, "trace_id", "span_id", "parent_span_id", "name")
    return correlate.span_orphans(rows).select("trace_id", "span_id", "parent_span_id", "name")


def attribute_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return log_rows(spark, sf).select(
        F.unix_micros("timestamp").alias("timestamp"),
        correlate.attribute("attributes", "k").alias("k"),
        correlate.attribute("resource", "service.name").alias("named"),
    )


def span_events_flat(spark: SparkSession, sf: str) -> DataFrame:
    return X.plain(correlate.span_events(spans(spark, sf)))


# --- schedules
CRONS = ["0 0 2 * * *", "0 0 */6 * * *", "0 30 9 * * MON-Fri", "@monthly", "0 */30 * * * *"]
BROKEN = ["*/0 * * * * *", "61 * * * * *", "0 0 0 * * mox"]
HORIZON = ("2024-01-01", "2024-01-31")


def schedules(spark: SparkSession, sf: str) -> DataFrame:
    """One schedule per customer."""
    case = F.col("c_custkey") % 5
    return X.table(spark, sf, "customer").select(
        X.text("job-«k»", k=F.col("c_custkey")).alias("service"),
        S.lookup(case, dict(enumerate(CRONS))).alias("cron"),
        F.lit(X.BASE_US).alias("from_us"),
        F.lit(X.BASE_US + 40 * S.MICROS_PER_DAY).alias("until_us"),
    )


def cron_firings(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.cron_firings(schedules(spark, sf), *HORIZON)


def cron_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh schedule cannot be read."""
    key = F.col("c_custkey")
    broken = S.lookup(key % 3, dict(enumerate(BROKEN)))
    rows = X.table(spark, sf, "customer").select(
        X.text("job-«k»", k=key).alias("service"),
        F.when(key % 7 == 0, broken).otherwise(S.lookup(key % 5, dict(enumerate(CRONS)))).alias("cron"),
    )
    return schedule.cron_rejects(rows)


def cron_runs(spark: SparkSession, sf: str) -> DataFrame:
    polls = X.events(spark, sf).select(
        X.text("job-«u»", u=F.col("user_id")).alias("service"), F.col("us").alias("poll_us")
    )
    # Only schedules that somebody polls are expanded.
    polled = schedules(spark, sf).join(polls.select("service").distinct(), "service", "left_semi")
    return schedule.cron_runs(schedule.cron_firings(polled, *HORIZON), polls)


# --- configuration rules
def duplicate_services(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("c_acctbal") < 0, "shared").when(F.col("c_nationkey") == 7, F.col("c_mktsegment"))
    services = X.table(spark, sf, "customer").select(
        F.coalesce(name, F.col("c_name")).alias("name"), X.text("/srv/«k»", k=F.col("c_custkey")).alias("path")
    )
    return layers.duplicate_services(services)


def layered_vars(spark: SparkSession, sf: str) -> DataFrame:
    main = X.table(spark, sf, "nation").select(
        F.lit(0).cast("bigint").alias("layer"),
        X.text("n«k»", k=F.col("n_nationkey")).alias("key"),
        F.col("n_name").alias("value"),
    )
    others = X.table(spark, sf, "customer").select(
        F.col("c_custkey") + 1, X.text("n«k»", k=F.col("c_nationkey") * 2), F.col("c_name")
    )
    return layers.layered_vars(main.union(others))


def proxies(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return X.table(spark, sf, "customer").select(
        X.text("h«k»", k=F.floor(key / 3)).alias("host"),
        key.alias("position"),
        F.when(F.col("c_nationkey") % 4 == 0, X.text("/certs/«k».pem", k=key)).alias("cert_file"),
        F.when(F.col("c_nationkey") % 8 < 2, X.text("/certs/«k».key", k=key)).alias("key_file"),
    )


def preferred_proxy(spark: SparkSession, sf: str) -> DataFrame:
    return layers.preferred_proxy(proxies(spark, sf))


def renewal_due(spark: SparkSession, sf: str) -> DataFrame:
    days = F.floor(F.col("s_acctbal") * 864).cast("bigint")
    certificates = X.table(spark, sf, "supplier").select(
        X.text("h«k»", k=F.col("s_suppkey")).alias("host"),
        F.when(F.col("s_suppkey") % 6 > 0, days + RENEWAL_NOW).alias("not_after_s"),
    )
    return changes.renewal_due(preferred_proxy(spark, sf), certificates, RENEWAL_NOW)


def snapshot(spark: SparkSession, sf: str, new: bool) -> DataFrame:
    """Customers as services; in the new snapshot some are renamed and some get another image."""
    image = F.concat(F.lit("img-"), F.col("c_mktsegment"))
    name = F.col("c_name")
    if new:
        name = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(name, F.lit("-v2"))).otherwise(name)
        image = F.when(F.col("c_acctbal") < 0, F.concat(image, F.lit(":2"))).otherwise(image)
    return X.table(spark, sf, "customer").select(
        name.alias("name"),
        image.alias("image"),
        F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey")).alias("memory"),
        # The order of a map's entries is no difference.
        F.create_map(*[x for k in (("a", "b") if new else ("b", "a")) for x in (F.lit(k), F.col("c_mktsegment"))]).alias("env"),
        F.array(F.col("c_nationkey"), F.lit(80).cast("bigint")).alias("ports"),
    )


def config_diff(spark: SparkSession, sf: str) -> DataFrame:
    return changes.config_diff(snapshot(spark, sf, True), snapshot(spark, sf, False))


def service_filter(spark: SparkSession, sf: str) -> DataFrame:
    services = X.table(spark, sf, "customer").select(
        F.col("c_name").alias("name"),
        F.concat(F.lit("/srv/"), "c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string")).alias("path"),
    )
    return changes.service_filter(services, ["BUILDING/3", "/srv/FURNITURE/7", "5"])


ALLOWED = {
    "": ["service", "agent", "proxy", "port"],
    "port[]": ["host", "target"],
    "service": ["name", "image", "memory"],
    "agent": ["watch", "cron"],
}


def strict_keys(spark: SparkSession, sf: str) -> DataFrame:
    case = F.col("c_custkey") % 5
    extra = lambda n, t: F.when(case == n, t).otherwise("")
    doc = X.text(
        '{"service":{"name":"«n»"«s»},«g»"agent":{"watch":true«a»}«r»}«t»',
        n=F.col("c_name"),
        s=extra(1, ',"colour":"red"'),
        g=extra(2, '"agents":1,'),
        a=extra(1, ',"color":1'),
        r=F.when(case == 3, ',"proxy":{"any":1}').otherwise(extra(0, ',"port":[{"host":1},{"target":2,"bogus":3}]')),
        t=F.lit(""),
    )
    doc = F.when(case == 4, F.substring(doc, F.lit(1), F.length(doc) - 1)).otherwise(doc)
    records = X.table(spark, sf, "customer").select(F.col("c_name").alias("name"), doc.alias("doc"))
    return layers.strict_keys(records, "doc", ALLOWED).select("name", "unknown", "accepted")


def digest_changes(spark: SparkSession, sf: str) -> DataFrame:
    observed = changes.observed_digest(digest_observations(spark, sf))
    return changes.digest_changes(observed).select("image", "ts_us", "digest", "previous", "outcome")


QUERIES = {
    f.__name__: f
    for f in (
        output_lines,
        output_truncate,
        output_parse,
        output_sequence,
        output_increment,
        output_marks,
        output_windows,
        output_tail,
        output_replay,
        route_join,
        prune_dependencies,
        dependency_gate,
        assign_slots,
        logs_with_spans,
        span_children,
        span_orphans,
        cron_firings,
        cron_runs,
        cron_rejects,
        duplicate_services,
        layered_vars,
        preferred_proxy,
        latest_status,
        digest_changes,
        config_diff,
        service_filter,
        renewal_due,
        strict_keys,
        attribute_lookup,
        span_events_flat,
    )
}

_E, _C, _P, _L = f"WITH {X.E}", f"WITH {X.C}", f"WITH {X.P}", f"WITH {X.L}"
_LATEST = f"""{X.E}, s AS ({X.STATUS_ROWS}),
n AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY timestamp DESC) AS rn FROM s),
latest AS (SELECT service, CASE state WHEN 'running' THEN 'running' ELSE 'exited' END AS situation,
  CASE WHEN state = 'running' THEN health_status END AS health,
  CASE WHEN state <> 'running' THEN coalesce(exit_code, -1) END AS exit_code FROM n WHERE rn = 1)"""
_INCREMENT = f"""{X.C}, m AS (SELECT service, CASE WHEN n % 2 = 0 THEN {NOW_S} - 300 + n END AS mark
  FROM (SELECT DISTINCT service, CAST(regexp_extract(service, '([0-9]+)$', 1) AS BIGINT) AS n FROM c)),
inc AS (SELECT p.* FROM parsed p JOIN m USING (service)
  WHERE timestamp_us // 1000000 <= {NOW_S - 1} AND timestamp_us // 1000000 >= coalesce(mark, 0))"""
_ROUTES = """q AS (SELECT page_id AS request_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
  regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages),
t AS (SELECT DISTINCT host, unnest(CASE WHEN length(host) % 2 = 0 THEN ['/en', '/fr', '/en/8', '/en/853']
  ELSE ['/', '/en', '/fr', '/en/8', '/en/853'] END) AS route FROM q)"""
_CUSTOMER = "'Customer#' || lpad(CAST({0} AS VARCHAR), 9, '0')"
_FIRINGS = f"""day AS (SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS d),
base AS (SELECT epoch_us(CAST(d AS TIMESTAMP)) AS us, d FROM day),
cron AS (SELECT 0 AS c, us + 7200000000 AS t0 FROM base
  UNION ALL SELECT 1, us + unnest([0, 6, 12, 18]) * 3600000000 FROM base
  UNION ALL SELECT 2, us + 34200000000 FROM base WHERE dayofweek(d) BETWEEN 1 AND 5
  UNION ALL SELECT 3, us FROM base WHERE day(d) = 1
  UNION ALL SELECT 4, us + unnest(range(48)) * 1800000000 FROM base),
firing AS (SELECT 'job-' || c_custkey AS service, CAST(t0 AS BIGINT) AS firing_us FROM customer JOIN cron ON c_custkey % 5 = c)"""
_PROXY = """px AS (SELECT 'h' || (c_custkey // 3) AS host, c_custkey AS position,
  CASE WHEN c_nationkey % 4 = 0 THEN '/certs/' || c_custkey || '.pem' END AS cert_file,
  CASE WHEN c_nationkey % 8 < 2 THEN '/certs/' || c_custkey || '.key' END AS key_file FROM customer),
pref AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY cert_file IS NULL, position) AS rn FROM px) WHERE rn = 1)"""

ORACLES = {
    "output_lines": f"{_C} SELECT chunk_id, line_no, stream, line FROM kept",
    "output_truncate": f"{_C} SELECT chunk_id, line_no, line FROM cut",
    "output_parse": f"{_C} SELECT chunk_id, service, stream, observed_us, line_no, timestamp_us, message FROM parsed",
    "output_sequence": f"""{_C} SELECT service, CAST(make_timestamp(timestamp_us) AS DATE) AS date, chunk_id, line_no,
      row_number() OVER (PARTITION BY service, CAST(make_timestamp(timestamp_us) AS DATE) ORDER BY timestamp_us, chunk_id, line_no) - 1 AS sequence FROM parsed""",
    "output_increment": f"WITH {_INCREMENT} SELECT service, chunk_id, line_no, timestamp_us FROM inc",
    "output_marks": f"""WITH {_INCREMENT} SELECT service, CASE WHEN service IN (SELECT service FROM inc) THEN {NOW_S - 1} ELSE mark END AS mark
      FROM m WHERE mark IS NOT NULL OR service IN (SELECT service FROM inc)""",
    "output_windows": f"""WITH {X.C}, p AS (SELECT *, timestamp_us // 1000000 AS s FROM parsed),
      b AS (SELECT unnest([1, 2, 3]) AS n, {X.BASE_US // 1_000_000} + (SELECT max(doc_id) FROM documents) * unnest([1, 2, 3]) // 3 + 1 AS top),
      t AS (SELECT max(top) FILTER (n = 1) AS t1, max(top) FILTER (n = 2) AS t2, max(top) FILTER (n = 3) AS t3 FROM b),
      r1 AS (SELECT p.* FROM p, t WHERE s <= t1),
      m1 AS (SELECT DISTINCT service, t1 AS mark FROM r1, t),
      r2 AS (SELECT p.* FROM p CROSS JOIN t LEFT JOIN m1 USING (service) WHERE s <= t2 AND s >= coalesce(mark, 0)),
      m2 AS (SELECT service, max(mark) AS mark FROM (SELECT * FROM m1 UNION ALL SELECT service, t2 FROM r2, t) GROUP BY service),
      r3 AS (SELECT p.* FROM p CROSS JOIN t LEFT JOIN m2 USING (service) WHERE s <= t3 AND s >= coalesce(mark, 0)),
      m3 AS (SELECT service, max(mark) AS mark FROM (SELECT * FROM m2 UNION ALL SELECT service, t3 FROM r3, t) GROUP BY service)
      SELECT 1 AS "window", service, chunk_id, line_no FROM r1 UNION ALL SELECT 2, service, chunk_id, line_no FROM r2
      UNION ALL SELECT 3, service, chunk_id, line_no FROM r3 UNION ALL SELECT 0, service, mark, -1 FROM m3""",
    "output_tail": f"""{_E}, o AS ({X.OUTPUT_ROWS}) SELECT service, timestamp, sequence, message FROM
      (SELECT *, row_number() OVER (PARTITION BY service ORDER BY timestamp DESC, sequence DESC) AS rn FROM o) WHERE rn <= 5""",
    "output_replay": f"""{_E}, o AS ({X.OUTPUT_ROWS}) SELECT service, timestamp, sequence,
      CAST(row_number() OVER (PARTITION BY service ORDER BY timestamp, sequence) AS INTEGER) AS place FROM o""",
    "route_join": f"""WITH {_ROUTES}, b AS (SELECT request_id, arg_max(route, length(route)) AS route FROM
        (SELECT q.request_id, q.host, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM q) q JOIN t ON q.host = t.host
        AND (route = '/' OR path = route OR starts_with(path, route || '/')) GROUP BY request_id)
      SELECT q.request_id, q.host, q.path, b.route, q.host || b.route AS service FROM q LEFT JOIN b USING (request_id)""",
    "prune_dependencies": f"""WITH ed AS (
        SELECT c_custkey, c_name, {_CUSTOMER.format('(c_custkey + 1)')} AS target,
          CASE c_custkey % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'completed' ELSE 'healthy' END AS condition FROM customer
        UNION ALL SELECT c_custkey, c_name, {_CUSTOMER.format('(c_custkey + 2)')}, 'healthy' FROM customer
        UNION ALL SELECT c_custkey, c_name, {_CUSTOMER.format('0')}, 'started' FROM customer WHERE c_acctbal > 0 AND c_custkey > 0
        UNION ALL SELECT c_custkey, c_name, 'ghost', 'started' FROM customer WHERE c_custkey % 4 = 0),
      kept AS (SELECT * FROM ed WHERE target IN (SELECT c_name FROM customer))
      SELECT c.c_name AS name, coalesce(string_agg(target || '=' || condition, ',' ORDER BY target || '=' || condition), '') AS depends_on
      FROM customer c LEFT JOIN kept USING (c_custkey) GROUP BY c.c_name""",
    "dependency_gate": f"""WITH {_LATEST}, ed AS (
        SELECT c_name, 'svc-' || (c_custkey % 12 + 2) AS target, CASE c_nationkey % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'completed' ELSE 'healthy' END AS condition
          FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 0
        UNION ALL SELECT c_name, 'svc-1', CASE WHEN c_nationkey % 2 = 0 THEN 'started' ELSE 'completed' END FROM customer WHERE c_mktsegment = 'BUILDING'),
      j AS (SELECT c_name, coalesce(CASE condition WHEN 'started' THEN situation = 'running'
        WHEN 'completed' THEN situation = 'exited' AND exit_code = 0
        ELSE situation = 'running' AND health IN ('healthy', 'none') END, false) AS holds FROM ed LEFT JOIN latest ON target = service)
      SELECT c.c_name AS service, coalesce(bool_and(holds), true) AS ready, count(*) FILTER (NOT holds) AS waiting
      FROM customer c LEFT JOIN j USING (c_name) GROUP BY c.c_name""",
    "assign_slots": """WITH kept AS (SELECT c_name AS name, c_custkey * 2 + 2 AS slot FROM customer WHERE c_mktsegment = 'BUILDING'),
      used AS (SELECT slot FROM kept UNION SELECT n_nationkey * 3 + 5 FROM nation UNION SELECT 1),
      free AS (SELECT slot, row_number() OVER (ORDER BY slot) AS rn FROM
        (SELECT unnest(range(2, (SELECT 4 * count(*) + 100 FROM customer))) AS slot) WHERE slot NOT IN (SELECT slot FROM used)),
      fresh AS (SELECT c_name AS name, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer WHERE c_mktsegment <> 'BUILDING')
      SELECT name, slot, true AS kept FROM kept UNION ALL SELECT name, slot, false FROM fresh JOIN free USING (rn)""",
    "logs_with_spans": f"""WITH {X.L}, {X.P} SELECT timestamp, l.service, severity, l.trace_id, l.span_id,
      p.name AS span_name, p.kind AS span_kind, p.duration_ms AS span_duration_ms
      FROM l LEFT JOIN p ON l.trace_id = p.trace_id AND l.span_id = p.span_id""",
    "span_children": f"""{_P}, ch AS (SELECT trace_id, parent_span_id, count(*) AS n, sum(duration_ms) AS ms FROM p WHERE parent_span_id IS NOT NULL GROUP BY ALL)
      SELECT p.trace_id, p.span_id, coalesce(n, 0) AS children, CAST(duration_ms - coalesce(ms, 0) AS BIGINT) AS self_ms
      FROM p LEFT JOIN ch ON p.trace_id = ch.trace_id AND p.span_id = ch.parent_span_id""",
    "span_orphans": f"""{_P} SELECT trace_id, span_id, parent_span_id, name FROM p x WHERE parent_span_id IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM p y WHERE y.trace_id = x.trace_id AND y.span_id = x.parent_span_id)""",
    "cron_firings": f"WITH {_FIRINGS} SELECT * FROM firing",
    "cron_runs": f"""WITH {_FIRINGS}, {X.E}, poll AS (SELECT 'job-' || user_id AS service, us AS poll_us FROM e)
      SELECT DISTINCT f.service, p.poll_us FROM firing f ASOF JOIN poll p ON f.service = p.service AND f.firing_us <= p.poll_us""",
    "cron_rejects": f"""SELECT 'job-' || c_custkey AS service, {BROKEN!r}[1 + c_custkey % 3] AS cron FROM customer WHERE c_custkey % 7 = 0""",
    "duplicate_services": """WITH s AS (SELECT CASE WHEN c_acctbal < 0 THEN 'shared' WHEN c_nationkey = 7 THEN c_mktsegment ELSE c_name END AS name,
        '/srv/' || c_custkey AS path FROM customer)
      SELECT name, path, uses FROM s JOIN (SELECT name, count(*) AS uses FROM s GROUP BY name HAVING count(*) > 1) USING (name)""",
    "layered_vars": """WITH a AS (SELECT 0 AS layer, 'n' || n_nationkey AS key, n_name AS value FROM nation
        UNION ALL SELECT c_custkey + 1, 'n' || (c_nationkey * 2), c_name FROM customer)
      SELECT key, arg_max(value, layer) AS value FROM a GROUP BY key""",
    "preferred_proxy": f"WITH {_PROXY} SELECT * FROM pref",
    "latest_status": f"WITH {_LATEST} SELECT * FROM latest",
    "digest_changes": f"""{_E}, {OBSERVED}, g AS (SELECT image, ts_us, CASE WHEN NOT failed THEN digest END AS digest FROM od),
      w AS (SELECT *, last_value(digest IGNORE NULLS) OVER (PARTITION BY image ORDER BY ts_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
        row_number() OVER (PARTITION BY image ORDER BY ts_us) AS rn FROM g)
      SELECT image, ts_us, digest, previous, CASE WHEN rn = 1 THEN 'Baseline' WHEN digest IS NULL THEN 'Deleted'
        WHEN digest IS NOT DISTINCT FROM previous THEN 'NotUpdated' ELSE 'Updated' END AS outcome FROM w""",
    "config_diff": """WITH o AS (SELECT c_name AS name, c_mktsegment, c_acctbal FROM customer),
      n AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN c_name || '-v2' ELSE c_name END AS name FROM customer)
      SELECT coalesce(n.name, o.name) AS name, CASE WHEN o.name IS NULL THEN 'start' WHEN n.name IS NULL THEN 'remove'
        WHEN c_acctbal < 0 THEN 'recreate' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.name = n.name""",
    "service_filter": """WITH s AS (SELECT c_name AS name, '/srv/' || c_mktsegment || '/' || c_nationkey AS path FROM customer)
      SELECT * FROM s WHERE path IN ('/srv/FURNITURE/7') OR path LIKE '%/BUILDING/3' OR path LIKE '%/5'""",
    "renewal_due": f"""WITH {_PROXY}, ct AS (SELECT 'h' || s_suppkey AS host, CASE WHEN s_suppkey % 6 > 0
        THEN CAST(floor(s_acctbal * 864) AS BIGINT) END AS left_s FROM supplier),
      d AS (SELECT host, CAST(sign(left_s) * (abs(left_s) // 86400) AS BIGINT) AS days_left FROM pref LEFT JOIN ct USING (host)
        WHERE cert_file IS NULL AND key_file IS NULL)
      SELECT * FROM d WHERE days_left IS NULL OR days_left < 30""",
    "strict_keys": """SELECT c_name AS name, CASE c_custkey % 5 WHEN 1 THEN 'agent.color,service.colour' WHEN 2 THEN 'agents'
      WHEN 0 THEN 'port[].bogus' ELSE '' END AS unknown, c_custkey % 5 = 3 AS accepted FROM customer""",
    "attribute_lookup": f"""{_L} SELECT timestamp, regexp_extract(attributes, '"k":"?([^"}}]+)', 1) AS k,
      regexp_extract(resource, ':"?([^"}}]+)', 1) AS named FROM l""",
    "span_events_flat": f"""{_P} SELECT trace_id, span_id, start_time + 5 AS timestamp, 'heavy' AS name,
      '{{"qty":' || heavy || '}}' AS attributes FROM p WHERE heavy IS NOT NULL""",
}
