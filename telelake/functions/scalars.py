"""Scalar functions on plain columns. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: codes stored in the tables, by the name used in staged events.
TRIGGER_CODES = {
    "Startup": "startup",
    "Cron": "cron",
    "ImageUpdate": "image_update",
    "ManualReload": "manual_reload",
}
RESTART_CODES = {
    "Always": "always",
    "always": "always",
    "No": "no",
    "no": "no",
    "never": "no",
    "OnFailure": "on-failure",
    "on-failure": "on-failure",
    "on_failure": "on-failure",
    "onfailure": "on-failure",
    "UnlessStopped": "unless-stopped",
    "unless-stopped": "unless-stopped",
    "unless_stopped": "unless-stopped",
    "unlessstopped": "unless-stopped",
}
STATE_CODES = {
    "Empty": "empty",
    "Created": "created",
    "Running": "running",
    "Paused": "paused",
    "Restarting": "restarting",
    "Removing": "removing",
    "Exited": "exited",
    "Dead": "dead",
    "NotFound": "not_found",
    "Unknown": "unknown",
}
HEALTH_CODES = {
    "Healthy": "healthy",
    "Unhealthy": "unhealthy",
    "Starting": "starting",
    "None": "none",
}
SPAN_KINDS = {1: "INTERNAL", 2: "SERVER", 3: "CLIENT", 4: "PRODUCER", 5: "CONSUMER"}
SPAN_KIND_OTHER = "UNSPECIFIED"
SPAN_STATUSES = {0: "UNSET", 1: "OK", 2: "ERROR"}
SPAN_STATUS_OTHER = "UNKNOWN"
DEFAULT_REGISTRY = "docker.io"
DEFAULT_TAG = "latest"
DIGEST_PREFIX = "sha256:"
DIGEST_LENGTH = 64
# --- End of fixed values.

MICROS_PER_DAY = 86_400_000_000
_LONG_MAX = 9_223_372_036_854_775_807
_LONG_MIN = -_LONG_MAX - 1
_DECIMAL_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def int_div(value: Column, divisor: int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", value, F.lit(divisor).cast("bigint"))


def lookup(value: Column, codes: Mapping, default: Column | None = None) -> Column:
    """Translate through a fixed code table; unknown values give ``default`` or NULL."""
    branches = None
    for key, code in codes.items():
        hit = value == F.lit(key)
        branches = F.when(hit, code) if branches is None else branches.when(hit, code)
    return branches if default is None else branches.otherwise(default)


def date_bucket(micros: Column) -> Column:
    """Partition date of a microsecond instant, truncated toward 1970-01-01."""
    return F.date_from_unix_date(int_div(micros, MICROS_PER_DAY).cast("int"))


def nanos_to_micros(nanos: Column) -> Column:
    return int_div(nanos, 1_000)


def duration_ms(start_nanos: Column, end_nanos: Column) -> Column:
    return int_div(F.try_subtract(end_nanos, start_nanos), 1_000_000)


def hex_lower(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def trigger_code(name: Column) -> Column:
    return lookup(name, TRIGGER_CODES)


def restart_code(name: Column) -> Column:
    return lookup(name, RESTART_CODES)


def state_code(name: Column) -> Column:
    return lookup(name, STATE_CODES)


def health_code(name: Column) -> Column:
    return lookup(name, HEALTH_CODES)


def span_kind(kind: Column) -> Column:
    return lookup(kind, SPAN_KINDS, F.lit(SPAN_KIND_OTHER))


def span_status(code: Column) -> Column:
    """Code name of a present status; a NULL code of a present status counts as 0."""
    return lookup(F.coalesce(code, F.lit(0)), SPAN_STATUSES, F.lit(SPAN_STATUS_OTHER))


def image_name(image: Column) -> Column:
    tagged = r"(?s)^(.*):[^/:]*$"
    return (
        F.when(F.contains(image, F.lit("@")), F.substring_index(image, "@", 1))
        .when(image.rlike(tagged), F.regexp_extract(image, tagged, 1))
        .otherwise(image)
    )


def image_tag(image: Column) -> Column:
    """Tag of an image reference; a digest keeps its leading ``@``."""
    tagged = r"(?s)^.*:([^/:]*)$"
    return (
        F.when(F.contains(image, F.lit("@")), F.regexp_extract(image, r"(?s)^[^@]*(@.*)$", 1))
        .when(image.rlike(tagged), F.regexp_extract(image, tagged, 1))
        .otherwise(F.when(image.isNotNull(), F.lit(DEFAULT_TAG)))
    )


def image_registry(image: Column) -> Column:
    head = F.substring_index(image, "/", 1)
    is_host = F.contains(image, F.lit("/")) & (head.rlike("[.:]") | (head == "localhost"))
    return F.when(is_host, head).otherwise(F.when(image.isNotNull(), F.lit(DEFAULT_REGISTRY)))


def percent(used: Column, total: Column) -> Column:
    ratio = used.cast("double") / F.nullif(total, F.lit(0)).cast("double") * F.lit(100.0)
    return F.when(total > 0, ratio).otherwise(F.lit(0.0))


def disk_used(total: Column, available: Column) -> Column:
    return F.greatest(total - available, F.lit(0).cast("bigint"))


def memory_bytes(limit: Column, mode: str = "strict") -> Column:
    """Memory limit text to bytes.

    ``strict`` knows the one-letter suffixes g, m, k, b; a bad number is 0.
    ``documented`` additionally accepts gb, mb and kb.
    """
    text = F.lower(F.regexp_replace(limit, r"^\s+|\s+$", ""))
    if mode == "documented":
        text = F.regexp_replace(text, "([gmk])b$", "$1")
    elif mode != "strict":
        raise ValueError(f"unknown mode: {mode}")
    suffix = F.regexp_extract(text, "([gmkb])$", 1)
    number = F.regexp_replace(text, "[gmkb]$", "")
    parsed = F.when(number.rlike(r"^[+-]?[0-9]+$"), number.try_cast("bigint"))
    factor = lookup(suffix, {"g": 1 << 30, "m": 1 << 20, "k": 1 << 10}, F.lit(1)).cast("bigint")
    return F.when(limit.isNotNull(), F.try_multiply(F.coalesce(parsed, F.lit(0).cast("bigint")), factor))


def nano_cpus(cpus: Column) -> Column:
    """CPU limit text to billionths of a CPU; unreadable text counts as one CPU."""
    bare = F.lower(F.regexp_replace(cpus, "^[+-]", ""))
    sign = F.when(F.startswith(cpus, F.lit("-")), -1.0).otherwise(1.0)
    value = (
        F.when(cpus.rlike(_DECIMAL_NUMBER), cpus.try_cast("double"))
        .when(bare.isin("inf", "infinity"), sign * F.lit(float("inf")))
        .when(bare == "nan", F.lit(0.0))
        .otherwise(F.lit(1.0))
    )
    scaled = value * F.lit(1e9)
    saturated = (
        F.when(scaled >= F.lit(float(_LONG_MAX)), F.lit(_LONG_MAX))
        .when(scaled <= F.lit(float(_LONG_MIN)), F.lit(_LONG_MIN))
        .otherwise(scaled.try_cast("bigint"))
    )
    return F.when(cpus.isNotNull(), saturated)


def normal_path(path: Column) -> Column:
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    trimmed = F.when(F.length(rooted) > 1, F.regexp_replace(rooted, r"(?s)/\z", "")).otherwise(rooted)
    return F.when(path.isNull() | (path == ""), F.lit("/")).otherwise(trimmed)


def _hash_of(text: Column) -> Column:
    body = F.substring(text, len(DIGEST_PREFIX) + 1, 1 << 30)
    return F.when(
        F.startswith(text, F.lit(DIGEST_PREFIX)) & (F.octet_length(body) >= DIGEST_LENGTH),
        F.substring(body, 1, DIGEST_LENGTH),
    )


def image_digest(repo_digests: Column, image_id: Column) -> Column:
    """``struct<digest, reason>``: the digest, or NULL with the reason of failure.

    The first repository digest decides. It is passed over only when it has no
    ``@`` part or its hash is too short; a wrong prefix is an error.
    """
    part = F.get(F.split(F.get(repo_digests, F.lit(0)), "@"), F.lit(1))
    prefixed = F.startswith(part, F.lit(DIGEST_PREFIX))
    id_prefixed = F.startswith(image_id, F.lit(DIGEST_PREFIX))
    bad_part = part.isNotNull() & ~prefixed
    digest = F.when(~F.coalesce(bad_part, F.lit(False)), F.coalesce(_hash_of(part), _hash_of(image_id)))
    reason = (
        F.when(digest.isNotNull(), F.lit(None).cast("string"))
        .when(bad_part, F.lit("invalid digest prefix"))
        .when(image_id.isNotNull() & ~id_prefixed, F.lit("invalid digest prefix"))
        .otherwise(F.lit("no digest found"))
    )
    return F.struct(digest.alias("digest"), reason.alias("reason"))


def rfc3339_micros(text: Column) -> Column:
    """Microsecond instant of RFC 3339 text, NULL when it is anything else."""
    guarded = F.when(text.rlike(_RFC3339), F.upper(text).try_cast("timestamp"))
    return F.unix_micros(guarded)


def uptime_seconds(started_at: Column, observed_us: Column) -> Column:
    elapsed = int_div(observed_us - rfc3339_micros(started_at), 1_000_000)
    return F.coalesce(elapsed, F.lit(0).cast("bigint"))


def plain_double(value: Column) -> Column:
    """Shortest decimal text of a double without exponent and without a bare ``.0``."""
    text = F.abs(value).cast("string")
    spread = F.when(F.contains(text, F.lit("E")), _without_exponent(text))
    body = F.coalesce(spread, F.regexp_replace(text, r"\.0$", ""))
    return (
        F.when(F.isnan(value), F.lit("NaN"))
        .when(value == F.lit(float("inf")), F.lit("inf"))
        .when(value == F.lit(float("-inf")), F.lit("-inf"))
        .when(F.startswith(value.cast("string"), F.lit("-")), F.concat(F.lit("-"), body))
        .otherwise(body)
    )


def _without_exponent(text: Column) -> Column:
    digits = F.regexp_replace(F.substring_index(text, "E", 1), r"\.", "")
    exponent = F.coalesce(F.substring_index(text, "E", -1).try_cast("int"), F.lit(0))
    padded = F.rpad(digits, exponent + 1, F.lit("0"))
    large = F.when(F.length(digits) <= exponent + 1, padded).otherwise(
        F.concat(
            F.substring(digits, F.lit(1), exponent + 1),
            F.lit("."),
            F.substring(digits, exponent + 2, F.length(digits)),
        )
    )
    small = F.concat(
        F.lit("0."), F.repeat(F.lit("0"), F.greatest(-exponent - 1, F.lit(0))), F.regexp_replace(digits, "0+$", "")
    )
    return F.when(exponent >= 0, large).otherwise(small)
