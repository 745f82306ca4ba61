"""Continuous load: staged lines to tables, one query and checkpoint per table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from telelake.sources import envelope, tables
from telelake.sources.ingest import table_rows

INTERVAL = "30 seconds"


def start_sink(
    rows: DataFrame, root: str, name: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append a stream to a table through the file sink, whose log makes retries harmless.

    Each micro-batch is rebalanced by what it weighs: partitions with little share a task,
    one that holds much of the batch is split over as many as its bytes ask for. Adaptive
    execution measures that for stateless streams; where it is switched off, and behind
    state, a partition is one task.
    """
    partitions = tables.recorded_layout(rows.sparkSession, root, name)
    return (
        rows.hint("rebalance", *partitions)
        .writeStream.format(tables.DEFAULT_FORMAT)
        .partitionBy(*partitions)
        .option("path", tables.table_uri(root, name))
        .option("checkpointLocation", f"{checkpoint}/{name}")
        .queryName(f"ingest {name}")
        .trigger(**(trigger or {"processingTime": INTERVAL}))
        .start()
    )


def ingest_stream(
    spark: SparkSession,
    staged: str,
    root: str,
    checkpoint: str,
    *,
    names: Iterable[str] = tuple(tables.TABLES),
    version_key: str = envelope.DEFAULT_VERSION_KEY,
    trigger: dict | None = None,
    **source_options,
) -> dict[str, StreamingQuery]:
    """Start one query per table over the staging area.

    Overload is met by back-pressure: pass ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger``; nothing is dropped. A failing table stops only its own
    query, which resumes from its checkpoint.
    """
    queries = {}
    for name in names:
        lines = envelope.scan_staged_stream(spark, staged, **source_options)
        rows = table_rows(lines, name, version_key)
        queries[name] = start_sink(rows, root, name, checkpoint, trigger)
    return queries


def drain(queries: dict[str, StreamingQuery]) -> dict[str, str | None]:
    """Wait for ``availableNow`` queries; the error per table, None when it finished."""
    outcome: dict[str, str | None] = {}
    for name, query in queries.items():
        try:
            query.awaitTermination()
            outcome[name] = None
        except Exception as error:  # noqa: BLE001 - reported per table
            outcome[name] = tables.first_line(error)
    return outcome
