"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telelake.checks import fixtures as X
from telelake.functions import otlp
from telelake.functions import scalars as S
from telelake.sources import envelope

def _signed_us() -> Column:
    """Instants on both sides of 1970."""
    return (F.col("us") % 200_000_000_000) - 100_000_000_000


def fn_date_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return X.events(spark, sf).select("event_id", S.date_bucket(_signed_us()).alias("date"))


def fn_nanos(spark: SparkSession, sf: str) -> DataFrame:
    nanos = _signed_us() * 1000 + F.col("k")
    return X.events(spark, sf).select("event_id", S.nanos_to_micros(nanos).alias("micros"))


def fn_duration_ms(spark: SparkSession, sf: str) -> DataFrame:
    items = X.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        (X.micros("l_shipdate") * 1000 + F.col("l_suppkey")).alias("start"),
        (X.micros("l_shipdate") * 1000 + (F.col("l_linenumber") - 4) * 1_999_999).alias("end"),
    )
    return items.select("l_orderkey", "l_partkey", S.duration_ms(F.col("start"), F.col("end")).alias("duration_ms"))


def fn_hex(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "documents").select("doc_id", S.hex_lower(F.encode("text", "UTF-8")).alias("hex"))


def _resources(spark: SparkSession, sf: str) -> DataFrame:
    requests = envelope.decode(X.log_lines(spark, sf), "LogBatch")
    resource = requests.select(F.explode("resourceLogs").alias("r"))
    return resource.select(F.col("r.resource.attributes").alias("pairs"), "r.scopeLogs")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    scopes = _resources(spark, sf).select(F.explode("scopeLogs").alias("s"))
    return scopes.select(F.explode("s.logRecords").alias("l")).select(
        F.col("l.timeUnixNano").cast("bigint").alias("nanos"),
        F.col("l.attributes").alias("pairs"),
        F.col("l.body").alias("body"),
    )


def fn_service_name(spark: SparkSession, sf: str) -> DataFrame:
    first = F.get(F.get(F.col("scopeLogs.logRecords"), F.lit(0)), F.lit(0)).getField("timeUnixNano")
    return _resources(spark, sf).select(
        first.cast("bigint").alias("nanos"), otlp.service_name(F.col("pairs")).alias("service")
    )


def fn_attributes_json(spark: SparkSession, sf: str) -> DataFrame:
    known = _records(spark, sf).withColumn("_l", otlp.nested_lookup(otlp.nested_texts(F.col("pairs")), otlp.any_nested(F.col("pairs"))))
    return known.select("nanos", otlp.key_values_json(F.col("pairs"), F.col("_l")).alias("attributes"))


def fn_body_text(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.array_compact(F.array(otlp.nested_text(F.col("body"))))
    known = _records(spark, sf).withColumn("_l", otlp.nested_lookup(texts, F.size(texts) > 0))
    return known.select("nanos", otlp.body_text(F.col("body"), F.col("_l")).alias("body"))


def fn_any_value(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind of value, arrays and lists three levels deep among them."""
    k, kind = F.col("k"), F.col("event_type")
    raw = (
        F.when(kind == "view", X.text('{"stringValue":"a\\"«k»"}', k=k))
        .when(kind == "click", X.text('{"intValue":"«k»"}', k=k))
        .when(kind == "signup", F.when(k % 2 == 0, '{"doubleValue":"NaN"}').otherwise('{"bytesValue":"3q2+7w=="}'))
        .when(
            kind == "purchase",
            X.text(
                '{"arrayValue":{"values":[{"intValue":"«k»"},{},{"kvlistValue":{"values":[{"key":"in",'
                '"value":{"arrayValue":{"values":[{"stringValue":"x"},{"doubleValue":"Infinity"}]}}}]}}]}}',
                k=k,
            ),
        )
        .otherwise(
            '{"kvlistValue":{"values":[{"key":"key1","value":{"boolValue":false}},{"key":"key2"},{"key":"key3","value":{}}]}}'
        )
    )
    parsed = X.events(spark, sf).select("event_id", F.from_json(raw, otlp.ANY_VALUE).alias("v"))
    texts = F.array_compact(F.array(otlp.nested_text(F.col("v"))))
    known = parsed.withColumn("_l", otlp.nested_lookup(texts, F.size(texts) > 0))
    return known.select("event_id", otlp.any_value_json(F.col("v"), F.col("_l")).alias("json"))


def fn_enum_codes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    names = X.events(spark, sf).select(
        "event_id",
        F.get(F.array(*[F.lit(n) for n in (*S.TRIGGER_CODES, "Other")]), k % (len(S.TRIGGER_CODES) + 1)).alias("t"),
        F.get(F.array(*[F.lit(n) for n in (*S.RESTART_CODES, "Other")]), k % (len(S.RESTART_CODES) + 1)).alias("r"),
        F.get(F.array(*[F.lit(n) for n in (*S.STATE_CODES, "Other")]), k % (len(S.STATE_CODES) + 1)).alias("s"),
        F.get(F.array(*[F.lit(n) for n in (*S.HEALTH_CODES, "Other")]), k % (len(S.HEALTH_CODES) + 1)).alias("h"),
    )
    return names.select(
        "event_id",
        S.trigger_code(F.col("t")).alias("trigger_type"),
        S.restart_code(F.col("r")).alias("restart_policy"),
        S.state_code(F.col("s")).alias("state"),
        S.health_code(F.col("h")).alias("health_status"),
    )


def fn_span_codes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        S.span_kind(n - 1).alias("kind"),
        S.span_status(F.when(n < 7, n - 1)).alias("status"),
    )


def _images(spark: SparkSession, sf: str) -> DataFrame:
    p, name = F.col("p_partkey"), F.regexp_replace("p_name", " ", "-")
    cases = {
        0: name,
        1: F.concat(name, F.lit(":"), F.col("p_size").cast("string")),
        2: F.concat(F.lit("localhost:5000/"), name),
        3: F.concat(F.lit("localhost:5000/"), name, F.lit(":1.0")),
        4: F.concat(F.lit("ghcr.io/user/"), name, F.lit("@sha256:"), p.cast("string")),
        5: F.concat(F.lit("localhost/"), name),
        6: F.concat(F.lit("user/"), name, F.lit(":")),
    }
    image = None
    for case, value in cases.items():
        image = F.when(p % 7 == case, value) if image is None else image.when(p % 7 == case, value)
    return X.table(spark, sf, "part").select("p_partkey", image.alias("image"))


def fn_image_ref(spark: SparkSession, sf: str) -> DataFrame:
    image = F.col("image")
    return _images(spark, sf).select(
        "p_partkey", S.image_name(image).alias("name"), S.image_tag(image).alias("tag")
    )


def fn_registry(spark: SparkSession, sf: str) -> DataFrame:
    return _images(spark, sf).select("p_partkey", S.image_registry(F.col("image")).alias("registry"))


def _choice(number: Column, cases: list) -> Column:
    return S.lookup(number % len(cases), dict(enumerate(cases)))


def fn_memory_bytes(spark: SparkSession, sf: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    shapes = ["g", "M", "k", "B", "", "m  ", " invalid", "mb", " g"]
    limit = F.when(p % 10 < 9, F.concat(size, _choice(p, shapes)))
    return X.table(spark, sf, "part").select(
        "p_partkey",
        S.memory_bytes(limit).alias("bytes"),
        S.memory_bytes(limit, "documented").alias("documented_bytes"),
    )


def fn_nano_cpus(spark: SparkSession, sf: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    shape = _choice(p, ["", ".5", " ", "x", "e1"])
    return X.table(spark, sf, "part").select(
        "p_partkey", S.nano_cpus(F.when(p % 7 > 0, F.concat(size, shape))).alias("nano_cpus")
    )


def fn_norm_path(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.regexp_extract("url", "^https?://[^/]+/?([^?#]*)", 1)
    p = F.col("page_id")
    path = F.when(p % 5 == 0, F.concat(F.lit("/"), raw)).when(p % 5 == 1, F.concat(raw, F.lit("/"))).when(
        p % 5 == 2, raw
    ).when(p % 5 == 3, "")
    return X.table(spark, sf, "pages").select("page_id", S.normal_path(path).alias("path"))


def digest_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Image reads: failed ones, digests without ``@``, short ones and wrong prefixes."""
    k, kind = F.col("k"), F.col("event_type")
    good = F.concat(F.lit("repo@sha256:"), F.sha2(kind, 256))
    digest = (
        F.when(kind == "click", F.lit("repo-without-digest"))
        .when((kind == "signup") & (k % 10 == 0), F.lit("repo@md5:00"))
        .when((kind == "signup") & (k % 10 == 1), F.lit("repo@sha256:short"))
        .otherwise(good)
    )
    image_id = F.when(k % 4 > 0, F.concat(F.lit("sha256:"), F.sha2((k % 2).cast("string"), 256)))
    return X.events(spark, sf).select(
        X.text("img-«u»", u=F.col("user_id")).alias("image"),
        F.col("us").alias("ts_us"),
        (kind == "error").alias("failed"),
        F.when(k % 6 > 0, F.array(digest)).alias("repo_digests"),
        image_id.alias("image_id"),
    )


OBSERVED = """o AS (SELECT 'img-' || user_id AS image, us AS ts_us, event_type = 'error' AS failed,
  CASE WHEN k % 6 = 0 THEN NULL WHEN event_type = 'click' THEN 'none'
    WHEN event_type = 'signup' AND k % 10 = 0 THEN 'bad' WHEN event_type = 'signup' AND k % 10 = 1 THEN 'none'
    ELSE sha256(event_type) END AS first,
  CASE WHEN k % 4 > 0 THEN sha256(CAST(k % 2 AS VARCHAR)) END AS own FROM e),
od AS (SELECT image, ts_us, failed, CASE WHEN first = 'bad' THEN NULL WHEN first IS NULL OR first = 'none' THEN own ELSE first END AS digest,
  first FROM o)"""


def fn_digest(spark: SparkSession, sf: str) -> DataFrame:
    found = S.image_digest(F.col("repo_digests"), F.col("image_id"))
    return digest_observations(spark, sf).select("ts_us", found.alias("f")).select("ts_us", "f.digest", "f.reason")


def fn_rfc3339(spark: SparkSession, sf: str) -> DataFrame:
    at, i = F.timestamp_micros("us"), F.col("event_id")
    full = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shape = (
        F.when(i % 6 == 0, F.concat(full, F.lit("Z")))
        .when(i % 6 == 1, F.concat(full, F.lit("999z")))
        .when(i % 6 == 2, F.concat(full, F.lit("+02:00")))
        .when(i % 6 == 3, F.date_format(at, "yyyy-MM-dd"))
        .when(i % 6 == 4, F.lit("2026"))
        .otherwise(full)
    )
    return X.events(spark, sf).select(
        "event_id", F.coalesce(S.rfc3339_micros(shape), F.col("us") + 7).alias("micros")
    )


QUERIES = {
    f.__name__: f
    for f in (
        fn_date_bucket,
        fn_nanos,
        fn_duration_ms,
        fn_hex,
        fn_service_name,
        fn_attributes_json,
        fn_body_text,
        fn_any_value,
        fn_enum_codes,
        fn_span_codes,
        fn_image_ref,
        fn_registry,
        fn_memory_bytes,
        fn_nano_cpus,
        fn_norm_path,
        fn_digest,
        fn_rfc3339,
    )
}


def _case(number: str, values) -> str:
    """SQL CASE over the positions of fixed values; one past the end is NULL."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} % {len(values) + 1} {arms} END"


_E, _L = f"WITH {X.E}", f"WITH {X.L}"
_SIGNED = "(us % 200000000000 - 100000000000)"
_TRUNC = "CAST(sign({0}) * (abs({0}) // {1}) AS BIGINT)"
ORACLES = {
    "fn_date_bucket": f"{_E} SELECT event_id, DATE '1970-01-01' + CAST({_TRUNC.format(_SIGNED, 86400000000)} AS INTEGER) AS date FROM e",
    "fn_nanos": f"{_E} SELECT event_id, {_TRUNC.format(f'({_SIGNED} * 1000 + k)', 1000)} AS micros FROM e",
    "fn_duration_ms": f"""SELECT l_orderkey, l_partkey,
      {_TRUNC.format('((l_linenumber - 4) * 1999999 - l_suppkey)', 1000000)} AS duration_ms FROM lineitem""",
    "fn_hex": "SELECT doc_id, lower(hex(text)) AS hex FROM documents",
    "fn_service_name": f"{_L} SELECT us * 1000 + 999 AS nanos, svc AS service FROM r",
    "fn_attributes_json": f"{_L} SELECT timestamp * 1000 + 999 AS nanos, attributes FROM l",
    "fn_body_text": f"{_L} SELECT timestamp * 1000 + 999 AS nanos, body FROM l",
    "fn_any_value": f"""{_E} SELECT event_id, CASE event_type WHEN 'view' THEN '"a\\"' || k || '"'
      WHEN 'click' THEN CAST(k AS VARCHAR) WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'null' ELSE '"deadbeef"' END
      WHEN 'purchase' THEN '[' || k || ',{{"in":["x",null]}}]' ELSE '{{"key1":false}}' END AS json FROM e""",
    # The codes are written out here, so a wrong one in the library shows.
    "fn_enum_codes": f"""{_E} SELECT event_id, {_case('k', "startup cron image_update manual_reload".split())} AS trigger_type,
      {_case('k', ("always always no no no on-failure on-failure on-failure on-failure"
                   " unless-stopped unless-stopped unless-stopped unless-stopped").split())} AS restart_policy,
      {_case('k', "empty created running paused restarting removing exited dead not_found unknown".split())} AS state,
      {_case('k', "healthy unhealthy starting none".split())} AS health_status FROM e""",
    "fn_span_codes": """SELECT l_orderkey, l_partkey, CASE l_linenumber WHEN 2 THEN 'INTERNAL' WHEN 3 THEN 'SERVER'
      WHEN 4 THEN 'CLIENT' WHEN 5 THEN 'PRODUCER' WHEN 6 THEN 'CONSUMER' ELSE 'UNSPECIFIED' END AS kind,
      CASE l_linenumber WHEN 1 THEN 'UNSET' WHEN 2 THEN 'OK' WHEN 3 THEN 'ERROR' WHEN 7 THEN 'UNSET' ELSE 'UNKNOWN' END AS status FROM lineitem""",
    "fn_image_ref": """WITH n AS (SELECT *, replace(p_name, ' ', '-') AS n, p_partkey % 7 AS c FROM part)
      SELECT p_partkey, CASE c WHEN 2 THEN 'localhost:5000/' || n WHEN 3 THEN 'localhost:5000/' || n
        WHEN 4 THEN 'ghcr.io/user/' || n WHEN 5 THEN 'localhost/' || n WHEN 6 THEN 'user/' || n ELSE n END AS name,
      CASE c WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN '1.0' WHEN 4 THEN '@sha256:' || p_partkey
        WHEN 6 THEN '' ELSE 'latest' END AS tag FROM n""",
    "fn_registry": """SELECT p_partkey, CASE p_partkey % 7 WHEN 2 THEN 'localhost:5000' WHEN 3 THEN 'localhost:5000'
      WHEN 4 THEN 'ghcr.io' WHEN 5 THEN 'localhost' ELSE 'docker.io' END AS registry FROM part""",
    "fn_memory_bytes": """SELECT p_partkey,
      CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE CAST(p_size AS BIGINT) * CASE p_partkey % 9 WHEN 0 THEN 1073741824
        WHEN 1 THEN 1048576 WHEN 2 THEN 1024 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1048576 ELSE 0 END END AS bytes,
      CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE CAST(p_size AS BIGINT) * CASE p_partkey % 9 WHEN 0 THEN 1073741824
        WHEN 1 THEN 1048576 WHEN 2 THEN 1024 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1048576 WHEN 7 THEN 1048576 ELSE 0 END END AS documented_bytes
      FROM part""",
    "fn_nano_cpus": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CASE p_partkey % 5
      WHEN 0 THEN CAST(p_size AS BIGINT) * 1000000000 WHEN 1 THEN CAST(p_size AS BIGINT) * 1000000000 + 500000000
      WHEN 4 THEN CAST(p_size AS BIGINT) * 10000000000 ELSE 1000000000 END END AS nano_cpus FROM part""",
    "fn_norm_path": """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/?([^?#]*)', 1) AS raw FROM pages),
      q AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || raw WHEN 1 THEN raw || '/' WHEN 2 THEN raw WHEN 3 THEN '' END AS path FROM p),
      s AS (SELECT page_id, CASE WHEN path IS NULL OR path = '' THEN '/' WHEN left(path, 1) = '/' THEN path ELSE '/' || path END AS path FROM q)
      SELECT page_id, CASE WHEN length(path) > 1 AND right(path, 1) = '/' THEN left(path, length(path) - 1) ELSE path END AS path FROM s""",
    "fn_digest": f"""{_E}, {OBSERVED} SELECT ts_us, digest, CASE WHEN digest IS NOT NULL THEN NULL
      WHEN first = 'bad' THEN 'invalid digest prefix' ELSE 'no digest found' END AS reason FROM od""",
    "fn_rfc3339": f"""{_E} SELECT event_id, CASE WHEN event_id % 6 < 2 THEN us WHEN event_id % 6 = 2 THEN us - 7200000000
      ELSE us + 7 END AS micros FROM e""",
}
