"""The eight tables: schemas, partitioning, locations, create, append and read."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_FORMAT = "parquet"


@dataclass(frozen=True)
class Table:
    name: str
    columns: str
    nullable: frozenset
    partitions: tuple
    sort_by: tuple

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema if f.name not in self.nullable]


def _table(name: str, columns: str, nullable: str = "", by: tuple = ("service", "date"), sort=("timestamp",)):
    return Table(name, columns, frozenset(nullable.split()), by, tuple(sort))


# Names, columns and partitioning of the stored tables.
TABLES = {
    t.name: t
    for t in (
        _table(
            "deployments",
            "date date, timestamp timestamp, service string, image string, image_sha string,"
            " image_size_mb bigint, container_id string, container_created_at timestamp,"
            " trigger_type string, agent_version string, restart_policy string,"
            " memory_limit string, cpu_limit string, proxy_enabled boolean, proxy_host string,"
            " port_mappings_count int, volume_count int, network_count int",
            "memory_limit cpu_limit proxy_host",
        ),
        _table(
            "status",
            "date date, timestamp timestamp, service string, container_id string, state string,"
            " health_status string, exit_code int, restart_count int, uptime_seconds bigint,"
            " failing_streak int, last_health_output string",
            "exit_code last_health_output",
        ),
        _table(
            "logs",
            "date date, timestamp timestamp, service string, severity string, body string,"
            " trace_id string, span_id string, attributes string, resource string",
            "severity body trace_id span_id attributes resource",
        ),
        _table(
            "traces",
            "date date, trace_id string, span_id string, parent_span_id string, name string,"
            " kind string, start_time timestamp, end_time timestamp, duration_ms bigint,"
            " status_code string, status_message string, service string, attributes string,"
            " events array<struct<timestamp:timestamp,name:string,attributes:string>>",
            "parent_span_id status_code status_message attributes events",
            sort=("start_time",),
        ),
        _table(
            "container-output",
            "date date, timestamp timestamp, service string, container_id string, stream string,"
            " message string, sequence bigint",
            sort=("timestamp", "sequence"),
        ),
        _table(
            "host-cpu",
            "date date, timestamp timestamp, hostname string, load_avg_1m double,"
            " load_avg_5m double, load_avg_15m double, core_count int",
            by=("date",),
            sort=("hostname", "timestamp"),
        ),
        _table(
            "host-disk",
            "date date, timestamp timestamp, hostname string, mount_point string,"
            " disk_name string, file_system string, total_space bigint, used_space bigint,"
            " available_space bigint, usage_percent double",
            by=("date",),
            sort=("hostname", "timestamp"),
        ),
        _table(
            "host-memory",
            "date date, timestamp timestamp, hostname string, total_memory bigint,"
            " used_memory bigint, available_memory bigint, memory_usage_percent double,"
            " total_swap bigint, used_swap bigint, swap_usage_percent double",
            by=("date",),
            sort=("hostname", "timestamp"),
        ),
    )
}


def base_uri(raw: str) -> str:
    """Normalised lake root: URIs stay, local paths become absolute ``file://`` URIs."""
    trimmed = raw.rstrip("/")
    if re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*:", trimmed):
        return trimmed
    return "file://" + os.path.abspath(trimmed)


def table_uri(root: str, name: str) -> str:
    return f"{base_uri(root)}/{name}"


def hadoop_path(spark: SparkSession, uri: str):
    """Hadoop file system and path of ``uri``, for listing and partition removal."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = hadoop_path(spark, uri)
    return fs.exists(path)


# A table created with the date-only layout has this file; its name keeps scans away from it.
DATE_ONLY = "_date_only"


def layout(name: str, by_date_only: bool = False) -> tuple:
    """Partition columns of a table.

    With very many services a directory per service and date holds little; the
    date-only layout keeps the rows sorted by service instead.
    """
    return ("date",) if by_date_only else TABLES[name].partitions


def recorded_layout(spark: SparkSession, root: str, name: str) -> tuple:
    """Partition columns that a table was created with."""
    return layout(name, exists(spark, f"{table_uri(root, name)}/{DATE_ONLY}"))


def ensure_table(
    spark: SparkSession, root: str, name: str, fmt: str = DEFAULT_FORMAT, by_date_only: bool = False
) -> None:
    """Create the table's location with its schema unless it already exists.

    The layout is chosen here, once; loads, streams and maintenance follow what is recorded.
    """
    uri = table_uri(root, name)
    if not exists(spark, uri):
        empty = spark.createDataFrame([], TABLES[name].schema)
        partitions = layout(name, by_date_only)
        empty.write.format(fmt).partitionBy(*partitions).mode("ignore").save(uri)
        if by_date_only:
            fs, mark = hadoop_path(spark, f"{uri}/{DATE_ONLY}")
            fs.create(mark).close()


def ensure_tables(
    spark: SparkSession,
    root: str,
    names: Iterable[str] = tuple(TABLES),
    fmt: str = DEFAULT_FORMAT,
    date_only: Iterable[str] = (),
) -> dict[str, str | None]:
    """Create every missing table; the error text per table, None when it is in place.

    Those in ``date_only`` get the layout without services. A failing table does not keep the others from being created.
    """
    outcome: dict[str, str | None] = {}
    date_only = set(date_only)
    for name in names:
        try:
            ensure_table(spark, root, name, fmt, name in date_only)
            outcome[name] = None
        except Exception as error:  # noqa: BLE001 - reported per table
            outcome[name] = first_line(error)
    return outcome


def first_line(error: BaseException) -> str:
    """Class and first line with text of an error; Spark's may begin with empty lines."""
    text = next((line.strip() for line in str(error).splitlines() if line.strip()), "")
    return f"{type(error).__name__}: {text}"


def missing_columns(df: DataFrame, required: Iterable[str]) -> Column:
    """Names of required columns that are NULL, comma separated; empty when complete."""
    names = [F.when(df[c].isNull(), F.lit(c)) for c in required]
    return F.concat_ws(",", *names)


def not_null_split(df: DataFrame, required: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows, offending rows with a ``reason``)."""
    required = list(required)
    complete = F.lit(True)
    for name in required:
        complete = complete & df[name].isNotNull()
    reason = F.concat(F.lit("null in "), missing_columns(df, required))
    return df.where(complete), df.where(~complete).withColumn("reason", reason)


def laid_out(df: DataFrame, name: str, partitions: tuple) -> DataFrame:
    """Rows arranged for the partitioned write.

    REBALANCE lets adaptive execution merge small partition directories into one
    task and split a directory that holds much of the data over many tasks.
    """
    within = [c for c in (*TABLES[name].partitions, *TABLES[name].sort_by) if c not in partitions]
    return df.hint("rebalance", *partitions).sortWithinPartitions(*partitions, *within)


def conformed(df: DataFrame, name: str) -> DataFrame:
    """Rows with the table's columns and types; evaluating an incomplete one is an error."""
    table = TABLES[name]
    missing = missing_columns(df, table.required)
    guard = F.when(
        missing != "", F.raise_error(F.concat(F.lit(f"{name}: null in "), missing)).cast("string")
    )
    first = table.required[0]
    guarded = df.withColumn(first, F.when(guard.isNull(), df[first]))
    return guarded.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema])


def append(
    df: DataFrame, root: str, name: str, fmt: str = DEFAULT_FORMAT, by_date_only: bool | None = None
) -> None:
    """Append complete rows; a row that breaks the non-null contract fails the write.

    The layout is the recorded one; ``by_date_only`` is for tables that nobody has created.
    """
    if by_date_only is None:
        partitions = recorded_layout(df.sparkSession, root, name)
    else:
        ensure_table(df.sparkSession, root, name, fmt, by_date_only)
        partitions = layout(name, by_date_only)
    writer = laid_out(conformed(df, name), name, partitions).write.format(fmt).mode("append")
    writer.partitionBy(*partitions).save(table_uri(root, name))


def read(
    spark: SparkSession, root: str, name: str, fmt: str = DEFAULT_FORMAT, suffix: str = ""
) -> DataFrame:
    """Scan a table with its declared schema, so partition values keep their types."""
    reader = spark.read.format(fmt)
    if fmt == DEFAULT_FORMAT:
        # The list that a stream keeps of its files may still name expired ones.
        reader = reader.schema(TABLES[name].schema).option("ignoreMissingFiles", True)
    return reader.load(table_uri(root, name) + suffix)


def read_date(spark: SparkSession, root: str, name: str, date: str, fmt: str = DEFAULT_FORMAT) -> DataFrame:
    """Rows of one date; the filter prunes partitions before any file is opened."""
    return read(spark, root, name, fmt).where(F.col("date") == F.lit(date).cast("date"))


def try_read(spark: SparkSession, root: str, name: str, fmt: str = DEFAULT_FORMAT) -> DataFrame | None:
    try:
        return read(spark, root, name, fmt)
    except AnalysisException:
        return None
