"""Compaction of closed dates and retention of whole date partitions.

Compaction never rewrites files in place: a run writes larger files next to the table
and then lists the files they replace. Listing is the commit; readers take the table
without listed files plus the files of committed runs. Replaced files are deleted after
a time of grace for readers under way, and their list with them, so lists stay short and
only partitions with listed files are compared with them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telelake.sources import tables

# Target file size and the least retention.
TARGET_BYTES = 128 * 1024 * 1024
MIN_RETENTION_HOURS = 168

COMPACTED = "-compacted"
REPLACED = "-replaced"
SETTLED = "-settled"
# Deletions under way at once; each is one call to the file system.
DELETERS = 16
PLAN_REPORT = "table string, action string, detail string"


def listing(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``(partition, date, path, length, file)`` of the table's data files; no file is opened.

    ``path`` is the name for the file system, ``file`` the one that scans report.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(tables.table_uri(root, name))
    )
    partition = _partition(F.col("path"))
    date = F.regexp_extract("path", r"/date=([^/]*)/[^/]*$", 1).try_cast("date")
    return files.select(
        partition.alias("partition"), date.alias("date"), "path", "length", F.col("_metadata.file_path").alias("file")
    )


def compact_plan(files: DataFrame, closed_before: str, target: int = TARGET_BYTES) -> DataFrame:
    """Closed partitions that hold more files than their size calls for."""
    closed = files.where(F.col("date") < F.lit(closed_before).cast("date"))
    sized = closed.groupBy("partition", "date").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("length") < target).alias("small_files"),
        F.sum("length").alias("bytes"),
    )
    wanted = F.greatest(F.ceil(F.col("bytes") / F.lit(target)), F.lit(1)).cast("bigint")
    planned = sized.withColumn("target_files", wanted)
    return planned.where("small_files > 1 and target_files < files")


def retention_plan(files: DataFrame, now: str, hours: int) -> DataFrame:
    """Partitions whose whole date lies before the retention period."""
    kept = max(hours, MIN_RETENTION_HOURS)
    cutoff = (F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(kept))).cast("date")
    expired = files.where(F.col("date") < cutoff)
    return expired.groupBy("partition", "date").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )


def _partition(path: Column) -> Column:
    return F.regexp_extract(path, r"/((?:service=[^/]*/)?date=[^/]*)/[^/]*$", 1)


def current_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The listing without files that a committed run has replaced."""
    files, replaced = listing(spark, root, name), _replaced(spark, root, name)
    return files if replaced is None else files.join(replaced.select("file"), "file", "left_anti")


def compact(
    spark: SparkSession,
    root: str,
    name: str,
    closed_before: str,
    target: int = TARGET_BYTES,
) -> int:
    """Rewrite the planned partitions of a table into larger files; their number.

    Partitions that need no rewriting are neither read nor listed, so a second run over
    the same files does nothing.
    """
    files = current_files(spark, root, name)
    plan = compact_plan(files, closed_before, target)
    listed = tables.table_uri(root, name) + REPLACED
    run = uuid.uuid4().hex
    pending = f"{listed}-pending/run={run}"
    files.join(plan.select("partition", "target_files"), "partition").select(
        "path", "file", "partition", "target_files"
    ).write.parquet(pending)
    taken = spark.read.schema("path string, file string, partition string, target_files bigint").parquet(pending)
    count = taken.select("partition").distinct().count()
    if not count:
        return 0
    table = tables.TABLES[name]
    # Dates, not files: at most one entry per day of history; they prune directories.
    dates = taken.select(F.regexp_extract("partition", r"date=([^/]*)$", 1).cast("date").alias("d")).distinct()
    live = tables.read(spark, root, name).where(F.col("date").isin([r.d for r in dates.collect()]))
    rows = live.withColumn("file", F.col("_metadata.file_path")).join(
        taken.select("file", "target_files", F.col("partition").alias("_partition")), "file"
    )
    # As many tasks write a partition as it is to have files.
    piece = F.pmod(F.xxhash64(*table.sort_by), F.col("target_files"))
    columns = [f.name for f in table.schema]
    laid = rows.withColumn("_piece", piece).repartition("_partition", "_piece")
    within = [c for c in (*table.partitions, *table.sort_by)]
    writer = laid.sortWithinPartitions(*within).select(*columns).write.partitionBy(*tables.recorded_layout(spark, root, name))
    writer.parquet(f"{tables.table_uri(root, name)}{COMPACTED}/run={run}")
    committed = taken.select("path", "file", "partition", F.unix_micros(F.current_timestamp()).alias("at_us"))
    committed.write.parquet(f"{listed}/run={run}")
    return count


def _replaced(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    listed = tables.table_uri(root, name) + REPLACED
    if not tables.exists(spark, listed):
        return None
    return spark.read.schema("path string, file string, partition string, at_us bigint, run string").parquet(listed)


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table rows, taking compacted files in place of those they replace.

    Only dates with replaced files that still exist are compared with the list.
    """
    live = tables.read(spark, root, name)
    replaced = _replaced(spark, root, name)
    if replaced is None:
        return live
    # The order that a scan with partitions has, also when no partition is left.
    partitions = tables.recorded_layout(spark, root, name)
    columns = [f.name for f in tables.TABLES[name].schema if f.name not in partitions] + list(partitions)
    dates = [r[0] for r in replaced.select(F.regexp_extract("partition", r"date=([^/]*)$", 1).cast("date")).distinct().collect()]
    mixed = F.col("date").isin(dates) if dates else F.lit(False)
    named = live.where(mixed).withColumn("file", F.col("_metadata.file_path"))
    rest = named.join(replaced.select("file"), "file", "left_anti").select(*columns)
    compacted = tables.table_uri(root, name) + COMPACTED
    # A run without a list of its own, present or settled, was not committed.
    runs = [*_run_directories(spark, tables.table_uri(root, name) + REPLACED), *_settled(spark, root, name)]
    known = [f"{compacted}/{r.rsplit('/', 1)[-1]}" for r in runs]
    known = [r for r in known if tables.exists(spark, r)]
    rows = live.where(~mixed).select(*columns).unionByName(rest)
    if not known:
        return rows
    schema = tables.TABLES[name].schema.add("run", "string")
    merged = spark.read.schema(schema).option("basePath", compacted).parquet(*known)
    return rows.unionByName(merged.select(*columns))


def _settled(spark: SparkSession, root: str, name: str) -> list[str]:
    """Committed runs whose replaced files are deleted."""
    uri = tables.table_uri(root, name) + SETTLED
    return _run_directories(spark, uri) if tables.exists(spark, uri) else []


def _delete_all(spark: SparkSession, uris: Iterable[str]) -> int:
    """Delete files or directories, several at once; how many were there."""

    def delete(uri: str) -> bool:
        fs, path = tables.hadoop_path(spark, uri)
        return bool(fs.exists(path) and fs.delete(path, True))

    with ThreadPoolExecutor(DELETERS) as pool:
        return sum(pool.map(delete, uris))


def remove_replaced(spark: SparkSession, root: str, name: str, now: str, hours: int = MIN_RETENTION_HOURS) -> int:
    """Delete files that runs committed ``hours`` before ``now`` have replaced; their number."""
    replaced = _replaced(spark, root, name)
    if replaced is None:
        return 0
    cutoff = F.unix_micros(F.lit(now).cast("timestamp")) - F.lit(hours * 3_600_000_000)
    due = replaced.where(F.col("at_us") <= cutoff)
    runs = [r.run for r in due.select("run").distinct().collect()]
    removed = _delete_all(spark, (r.path for r in due.select("path").toLocalIterator()))
    uri = tables.table_uri(root, name)
    for run in runs:
        fs, mark = tables.hadoop_path(spark, f"{uri}{SETTLED}/run={run}")
        fs.mkdirs(mark)
    _delete_all(spark, [f"{uri}{REPLACED}/run={run}" for run in runs])
    return removed


def apply_retention(spark: SparkSession, root: str, name: str, now: str, hours: int) -> int:
    """Delete expired date partitions, also of tables that a stream writes.

    A stream's own list of files may name deleted ones for a while; readers pass over them.
    """
    removed = 0
    for suffix in ("", COMPACTED):
        uri = tables.table_uri(root, name) + suffix
        if not tables.exists(spark, uri):
            continue
        expired = retention_plan(listing(spark, root, name + suffix), now, hours)
        bases = _run_directories(spark, uri) if suffix else [uri]
        gone = expired.select("partition").distinct().toLocalIterator()
        removed += _delete_all(spark, (f"{base}/{row.partition}" for row in gone for base in bases))
    return removed


def _run_directories(spark: SparkSession, uri: str) -> list[str]:
    fs, path = tables.hadoop_path(spark, uri)
    return [str(s.getPath().toString()) for s in fs.listStatus(path) if s.isDirectory()]


def maintain(
    spark: SparkSession,
    root: str,
    *,
    closed_before: str,
    now: str,
    retention_hours: int = MIN_RETENTION_HOURS,
    names: Iterable[str] = tuple(tables.TABLES),
    after: DataFrame | None = None,
    fmt: str = tables.DEFAULT_FORMAT,
) -> DataFrame:
    """Compact every table, delete what is replaced and expired; ``(table, action, detail)``.

    ``after`` is the report of a load: unless all of it is ``ok`` nothing is done. A
    missing table is skipped, a failing one does not stop the others and is not expired.
    Tables of a format with a log of its own are maintained by that format's engine.
    """
    if fmt != tables.DEFAULT_FORMAT:
        raise ValueError(f"maintenance is for {tables.DEFAULT_FORMAT} tables, not {fmt}")
    report = []
    if after is not None and not after.where("not ok").isEmpty():
        return spark.createDataFrame([(n, "skipped", "load incomplete") for n in names], PLAN_REPORT)
    for name in names:
        if not tables.exists(spark, tables.table_uri(root, name)):
            report.append((name, "missing", None))
            continue
        try:
            count = compact(spark, root, name, closed_before)
            report.append((name, "compacted", f"{count} partitions"))
        except Exception as error:  # noqa: BLE001 - reported per table
            report.append((name, "compaction failed", tables.first_line(error)))
            continue
        try:
            old = remove_replaced(spark, root, name, now, max(retention_hours, MIN_RETENTION_HOURS))
            report.append((name, "cleaned", f"{old} files"))
            removed = apply_retention(spark, root, name, now, retention_hours)
            report.append((name, "expired", f"{removed} partitions"))
        except Exception as error:  # noqa: BLE001 - reported per table
            report.append((name, "retention failed", tables.first_line(error)))
    return spark.createDataFrame(report, PLAN_REPORT)
