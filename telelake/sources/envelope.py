"""Staged event lines: scan, routing, decoding, quarantine and metrics."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telelake.functions import otlp
from telelake.functions import scalars as S
from telelake.sources.tables import hadoop_path


@dataclass(frozen=True)
class Variant:
    """One kind of staged event: where it is staged and what makes it valid."""

    name: str
    file: str
    table: str
    fields: str
    required: tuple = ()
    codes: tuple = ()
    unsigned: tuple = ()
    # Further test of the parsed event, and its nested values as a list of texts.
    readable: Callable[[Column], Column] | None = None
    nested: Callable[[Column], Column] | None = None


_ATTRIBUTES = f"attributes:{otlp.KEY_VALUES}"
LOG_REQUEST = (
    f"resourceLogs:array<struct<resource:struct<{_ATTRIBUTES}>,scopeLogs:array<struct<logRecords:"
    f"array<struct<timeUnixNano:string,severityText:string,body:{otlp.ANY_VALUE},"
    f"traceId:string,spanId:string,{_ATTRIBUTES}>>>>>>"
)
SPAN_REQUEST = (
    f"resourceSpans:array<struct<resource:struct<{_ATTRIBUTES}>,scopeSpans:array<struct<spans:"
    "array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,"
    "startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int,message:string>,"
    f"{_ATTRIBUTES},events:array<struct<timeUnixNano:string,name:string,{_ATTRIBUTES}>>>>>>>>"
)

# Event kinds, staging file names and field names.
VARIANTS = {
    v.name: v
    for v in (
        Variant(
            "Deployment",
            "deployments.jsonl",
            "deployments",
            "event_id:string,timestamp:bigint,service:string,image:string,image_sha:string,"
            "image_size_mb:bigint,container_id:string,container_created_at:bigint,"
            "trigger_type:string,{version}:string,restart_policy:string,memory_limit:string,"
            "cpu_limit:string,proxy_enabled:boolean,proxy_host:string,port_mappings_count:int,"
            "volume_count:int,network_count:int",
            required=(
                "timestamp service image image_sha image_size_mb container_id"
                " container_created_at trigger_type {version} restart_policy proxy_enabled"
                " port_mappings_count volume_count network_count"
            ).split(),
            codes=(("trigger_type", S.trigger_code), ("restart_policy", S.restart_code)),
        ),
        Variant(
            "ContainerStatus",
            "status.jsonl",
            "status",
            "event_id:string,timestamp:bigint,service:string,container_id:string,state:string,"
            "health_status:string,exit_code:int,restart_count:int,uptime_seconds:bigint,"
            "failing_streak:int,last_health_output:string",
            required=(
                "timestamp service container_id state health_status restart_count"
                " uptime_seconds failing_streak"
            ).split(),
            codes=(("state", S.state_code), ("health_status", S.health_code)),
        ),
        Variant(
            "LogBatch", "logs.jsonl", "logs", LOG_REQUEST, readable=otlp.readable_logs, nested=otlp.log_texts
        ),
        Variant(
            "SpanBatch", "traces.jsonl", "traces", SPAN_REQUEST, readable=otlp.readable_spans, nested=otlp.span_texts
        ),
        Variant(
            "ContainerOutput",
            "container-output.jsonl",
            "container-output",
            "timestamp:bigint,service:string,container_id:string,stream:string,message:string,"
            "sequence:bigint",
            required="timestamp service container_id stream message sequence".split(),
        ),
        Variant(
            "HostCpu",
            "host-cpu.jsonl",
            "host-cpu",
            "hostname:string,timestamp:bigint,load_avg_1m:double,load_avg_5m:double,"
            "load_avg_15m:double,core_count:bigint",
            required="hostname timestamp load_avg_1m load_avg_5m load_avg_15m core_count".split(),
            unsigned=(("core_count", (1 << 31) - 1),),
        ),
        Variant(
            "HostMemory",
            "host-memory.jsonl",
            "host-memory",
            "hostname:string,timestamp:bigint,total_memory:decimal(20,0),"
            "used_memory:decimal(20,0),available_memory:decimal(20,0),"
            "memory_usage_percent:double,total_swap:decimal(20,0),used_swap:decimal(20,0),"
            "swap_usage_percent:double",
            required=(
                "hostname timestamp total_memory used_memory available_memory"
                " memory_usage_percent total_swap used_swap swap_usage_percent"
            ).split(),
            unsigned=tuple(
                (c, (1 << 63) - 1)
                for c in "total_memory used_memory available_memory total_swap used_swap".split()
            ),
        ),
        Variant(
            "HostDisk",
            "host-disk.jsonl",
            "host-disk",
            "hostname:string,timestamp:bigint,mount_point:string,disk_name:string,"
            "file_system:string,total_space:decimal(20,0),used_space:decimal(20,0),"
            "available_space:decimal(20,0),usage_percent:double",
            required=(
                "hostname timestamp mount_point disk_name file_system total_space used_space"
                " available_space usage_percent"
            ).split(),
            unsigned=tuple(
                (c, (1 << 63) - 1) for c in "total_space used_space available_space".split()
            ),
        ),
    )
}
FILES = {v.file: v.name for v in VARIANTS.values()}
TABLE_VARIANT = {v.table: v.name for v in VARIANTS.values()}
DEFAULT_VERSION_KEY = "agent_version"

UNKNOWN_FILE = "unknown file"
MALFORMED = "malformed line"
WRONG_VARIANT = "wrong variant"
INVALID = "invalid fields"
UNREADABLE = "unreadable nested value"
# Field in which the parser reports that some field had a value of another type.
_MISTYPED = "_corrupt_record"


_SUFFIX = ".jsonl"
# A part of a staged file; the file's name is neither escaped nor that of the part.
_PART = re.compile(r"/file=[A-Za-z0-9._-]+/(?!.*\.jsonl$)[^/]+")


def _named(path: Column) -> Column:
    """Staged name of a path: the file itself, or the directory of its parts.

    Plain splitting: this runs for every line, where a regular expression on the long
    path costs more than decoding the line.
    """
    name = F.substring_index(path, "/", -1)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    folder = F.substring_index(folder, "=", -1)
    suffix = F.lit(_SUFFIX)
    return F.when(F.endswith(name, suffix), name).when(F.endswith(folder, suffix), folder)


def scan_staged(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file)`` for every line under ``path`` staged as ``*.jsonl``.

    A staged file may be a plain file or, when Spark wrote it, a directory of parts.
    Files of other kinds are not opened: the filter is on file metadata only.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    if _in_folders(lines, path):
        # The name is a partition value here: nothing is cut out of the path for each line.
        named = spark.read.schema("value string, file string").text(path)
        return named.where(F.endswith("file", F.lit(_SUFFIX))).select("value", "file")
    return _with_file(lines)


def _in_folders(lines: DataFrame, path: str) -> bool:
    """Whether all files below ``path`` lie as :func:`stage` writes them, in folders ``file=<name>`` with plain names."""
    spark = lines.sparkSession
    files = lines.inputFiles()
    fs, top = hadoop_path(spark, path)
    root = fs.makeQualified(top).toUri().toString()
    return bool(files) and all(f.startswith(f"{root}/") and _PART.fullmatch(f[len(root) :]) for f in files)


def scan_staged_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Streaming form of :func:`scan_staged`; pass ``maxFilesPerTrigger`` and the like."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    for key, value in options.items():
        reader = reader.option(key, value)
    return _with_file(reader.text(path))


def _with_file(lines: DataFrame) -> DataFrame:
    name = _named(F.col("_metadata.file_path"))
    return lines.where(name.isNotNull()).select("value", name.alias("file"))


# Lines of one part: parts are compressed, and so read by one task each.
PART_LINES = 250_000
# Spark's setting for files that a task keeps open; with more names than that it sorts the rest.
_OPEN_FILES, _NAMES_OPEN = "spark.sql.maxConcurrentOutputFileWriters", 16


def stage(lines: DataFrame, path: str) -> None:
    """Append ``(value, file)`` lines to the staging area, one directory per file name.

    Lines repeat most of their text, so parts are compressed. A task writes its lines as they come, to
    one part per file name, instead of holding and sorting them all.
    """
    spark = lines.sparkSession
    writer = lines.select("value", "file").write.mode("append").partitionBy("file")
    writer = writer.option("compression", "gzip").option("maxRecordsPerFile", PART_LINES)
    before = spark.conf.get(_OPEN_FILES)
    spark.conf.set(_OPEN_FILES, _NAMES_OPEN)
    try:
        writer.text(path)
    finally:
        spark.conf.set(_OPEN_FILES, before)


def expected_variant(file: Column) -> Column:
    return S.lookup(file, FILES)


def target_table(file: Column) -> Column:
    return S.lookup(file, {v.file: v.table for v in VARIANTS.values()})


def route(lines: DataFrame) -> DataFrame:
    """Add ``table``: where the line belongs, NULL for an unknown file name."""
    return lines.withColumn("table", target_table(F.col("file")))


def split_by_type(events: DataFrame) -> DataFrame:
    """Choose the staging file of each event line from its single key."""
    files = {v.name: v.file for v in VARIANTS.values()}
    keys = F.when(F.size(F.json_object_keys("value")) == 1, F.json_object_keys("value"))
    # As a generator the choice is made once; a filter on it would be evaluated again.
    chosen = F.transform(keys, lambda name: S.lookup(name, files))
    return events.select("value", F.explode(F.array_compact(chosen)).alias("file"))


def may_nest(value: Column) -> Column:
    """Whether a line can hold array or key/value-list attributes, judged by its text.

    Escaped characters could hide the field names, so lines with any count as well. The ends
    of the names are looked for: their first letters are rare in lines, quotes are not.
    """
    marks = ('yValue"', 'vlistValue"', "\\u")
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(value, F.lit(mark))
    return F.coalesce(found, F.lit(False))


def _fields(variant: Variant, version_key: str) -> tuple[str, list[str]]:
    fill = lambda text: text.replace("{version}", version_key)
    return fill(variant.fields), [fill(c) for c in variant.required]


def _parsed(variant: Variant, version_key: str) -> Column:
    """The event of a line; NULL if it is absent or any field has another type."""
    fields, _ = _fields(variant, version_key)
    schema = f"struct<{variant.name}:struct<{fields}>,{_MISTYPED}:string>"
    options = {"columnNameOfCorruptRecord": _MISTYPED}
    return otlp.let(
        F.from_json("value", schema, options),
        lambda line: F.when(line.getField(_MISTYPED).isNull(), line.getField(variant.name)),
    )


def _sound(event: Column, variant: Variant, version_key: str) -> Column:
    """Every required field present, every code known, unsigned numbers in range."""
    _, required = _fields(variant, version_key)
    good = F.lit(True)
    for name in required:
        good = good & event.getField(name).isNotNull()
    for name, code in variant.codes:
        good = good & code(event.getField(name)).isNotNull()
    for name, top in variant.unsigned:
        good = good & event.getField(name).between(F.lit(0), F.lit(top))
    if variant.readable:
        good = good & variant.readable(event)
    return F.coalesce(good, F.lit(False))


def _verdict(variant: Variant, version_key: str, good, bad) -> Column:
    """What a line of the variant's file is worth: ``good(event)``, or ``bad(reason)`` for a line that is not loaded."""

    def of_keys(keys: Column) -> Column:
        judged = otlp.let(
            _parsed(variant, version_key),
            lambda e: F.when(e.isNotNull() & _sound(e, variant, version_key), good(e)).otherwise(bad(INVALID)),
        )
        return (
            F.when(keys.isNull() | (F.size(keys) != 1), bad(MALFORMED))
            .when(F.get(keys, F.lit(0)) != variant.name, bad(WRONG_VARIANT))
            .otherwise(judged)
        )

    return otlp.let(F.json_object_keys("value"), of_keys)


def _nests(specs: Iterable[Variant]) -> Column:
    """Whether a line has to be looked at for nested values that cannot be read."""
    return F.col("file").isin(*[v.file for v in specs if v.nested]) & may_nest(F.col("value"))


def _judged(lines: DataFrame, specs: Iterable[Variant], version_key: str, python: bool, with_event: bool) -> DataFrame:
    """``lines`` with ``_v``: reason, event and whether it is nested, for lines of the files of ``specs``.

    A generator over one element makes the verdict: it is evaluated once, whatever reads its
    fields. Only with ``python`` are nested values tested.
    """
    no_texts = F.lit(None).cast("array<string>")
    chosen = None
    for spec in specs:
        fields, _ = _fields(spec, version_key)
        kind = f"struct<{fields}>" if with_event else "string"

        def found(reason: str | None, event: Column, texts: Column = no_texts, kind: str = kind) -> Column:
            text = F.lit(reason).cast("string")
            return F.struct(text.alias("reason"), event.cast(kind).alias("event"), texts.alias("texts"))

        def good(event: Column, spec: Variant = spec, found: Callable = found) -> Column:
            texts = spec.nested(event) if python and spec.nested else no_texts
            return found(None, event if with_event else F.lit(None), texts)

        # Only the branch of the line's own file is evaluated.
        own = _verdict(spec, version_key, good, lambda reason, found=found: found(reason, F.lit(None)))
        here = F.col("file") == spec.file
        chosen = F.when(here, own) if chosen is None else chosen.when(here, own)
    unknown_file = found(UNKNOWN_FILE, F.lit(None))
    judged = lines.select("*", F.explode(F.array(chosen.otherwise(unknown_file))).alias("_v"))
    reason = F.col("_v.reason")
    if python:
        # Python sees NULL where there are no texts.
        reason = F.coalesce(reason, F.when(~otlp.readable_nested(F.col("_v.texts")), UNREADABLE))
    return judged.select(
        *[F.col(f"`{c}`") for c in lines.columns],
        reason.alias("reason"),
        F.col("_v.event").alias("event"),
        F.coalesce(F.size("_v.texts") > 0, F.lit(False)).alias("nested"),
    )


def _in_two(lines: DataFrame, specs: list[Variant], version_key: str, with_event: bool) -> DataFrame:
    """Verdicts of all lines, those that may nest in a branch with Python; each line is parsed in one of them."""
    nesting = [v for v in specs if v.nested]
    if not nesting:
        return _judged(lines, specs, version_key, False, with_event)
    nests = _nests(nesting)
    plain = _judged(lines.where(~F.coalesce(nests, F.lit(False))), specs, version_key, False, with_event)
    return plain.union(_judged(lines.where(nests), nesting, version_key, True, with_event))


def verdicts(lines: DataFrame, variant: str, version_key: str = DEFAULT_VERSION_KEY) -> DataFrame:
    """``(value, file, reason, event, nested)`` for every line staged in the file of ``variant``.

    A line is parsed once: it has an event, or a reason why it is not loaded and its text.
    ``nested`` says that the event holds nested values; only these go through Python.
    """
    spec = VARIANTS[variant]
    own = lines.where(F.col("file") == spec.file).select("value", "file")
    judged = _in_two(own, [spec], version_key, True)
    good = F.col("reason").isNull()
    return judged.select(
        F.when(~good, F.col("value")).alias("value"),
        "file",
        "reason",
        F.when(good, F.col("event")).alias("event"),
        (good & F.col("nested")).alias("nested"),
    )


def events_of(judged: DataFrame, version_key: str = DEFAULT_VERSION_KEY) -> DataFrame:
    """Event columns of the good lines of :func:`verdicts`."""
    events = judged.where("reason is null").select("event.*")
    if version_key in events.columns and version_key != DEFAULT_VERSION_KEY:
        events = events.withColumnRenamed(version_key, DEFAULT_VERSION_KEY)
    return events


def decode(
    lines: DataFrame, variant: str, version_key: str = DEFAULT_VERSION_KEY, nested: bool = True
) -> DataFrame:
    """Event columns of the valid lines staged in the file of ``variant``.

    Malformed lines, other variants, invalid fields and unreadable nested values are
    dropped; :func:`quarantine` has exactly these lines. ``nested=False`` spares Python
    for lines that :func:`may_nest` rules out.
    """
    spec = VARIANTS[variant]
    own = lines.where(F.col("file") == spec.file)
    single = F.size(F.json_object_keys("value")) == 1
    # One array element or none: the line is parsed once, where a filter on the parsed
    # columns would be pushed below the projection and parse it again.
    valid = F.filter(
        F.array(_parsed(spec, version_key)),
        lambda e: e.isNotNull() & single & _sound(e, spec, version_key),
    )
    valid = own.select(F.explode(valid).alias("event"))
    if spec.nested and nested:
        valid = valid.where(otlp.readable_nested(spec.nested(F.col("event"))))
    valid = valid.select("event.*")
    if version_key in valid.columns and version_key != DEFAULT_VERSION_KEY:
        valid = valid.withColumnRenamed(version_key, DEFAULT_VERSION_KEY)
    return valid


def unknown(lines: DataFrame) -> DataFrame:
    """``(value, file, reason)`` of lines whose file belongs to no table."""
    return lines.where(expected_variant(F.col("file")).isNull()).select("value", "file", F.lit(UNKNOWN_FILE).alias("reason"))


def judge(lines: DataFrame, version_key: str = DEFAULT_VERSION_KEY) -> DataFrame:
    """Add ``reason``: why a line is not loaded, NULL for a good line."""
    judged = _in_two(lines, list(VARIANTS.values()), version_key, False)
    return judged.drop("event", "nested")


def quarantine(lines: DataFrame, version_key: str = DEFAULT_VERSION_KEY) -> DataFrame:
    """Lines that are not loaded, with file and reason."""
    return judge(lines, version_key).select("value", "file", "reason").where("reason is not null")


def ingest_metrics(lines: DataFrame, version_key: str = DEFAULT_VERSION_KEY) -> DataFrame:
    """Per file: lines read, events processed (requests for OTLP) and lines skipped."""
    judged = judge(lines, version_key)
    counted = judged.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.count("reason").alias("skipped")
    )
    return counted.withColumn("processed", F.col("lines") - F.col("skipped"))
