"""Streaming jobs, drained and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telelake.checks import fixtures as X
from telelake.checks.functions import digest_observations
from telelake.checks.operators import ORACLES as BATCH
from telelake.session import scratch_path
from telelake.sources import envelope, tables
from telelake.streaming import changes as stream_changes
from telelake.streaming import ingest as stream_load
from telelake.streaming import output as stream_capture

ONCE = {"availableNow": True}


def _failed(outcome: dict) -> dict:
    return {name: error for name, error in outcome.items() if error}


def _drain(queries: dict) -> None:
    failed = _failed(stream_load.drain(queries))
    if failed:
        raise RuntimeError(f"stream failed: {failed}")


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    staged, root, marks = (scratch_path(spark, p) for p in ("staged", "lake", "checkpoint"))
    envelope.stage(X.deployment_lines(spark, sf), staged)
    _drain(
        stream_load.ingest_stream(
            spark, staged, root, marks, names=["deployments"], trigger=ONCE, maxFilesPerTrigger=8
        )
    )
    return X.plain(tables.read(spark, root, "deployments"))


def stream_restart(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables, stopped, fed again and restarted from their checkpoints."""
    staged, root, marks = (scratch_path(spark, p) for p in ("staged", "lake", "checkpoint"))
    names = ["status", "host-cpu"]
    for lines in (
        X.status_lines(spark, sf),
        X.lines_of(X.host_cpu_events(spark, sf), "HostCpu", "host-cpu.jsonl"),
        X.status_lines(spark, sf),
    ):
        envelope.stage(lines, staged)
        _drain(stream_load.ingest_stream(spark, staged, root, marks, names=names, trigger=ONCE))
    status = tables.read(spark, root, "status").groupBy("date").agg(F.count(F.lit(1)).alias("status_rows"))
    cpu = tables.read(spark, root, "host-cpu").groupBy("date").agg(F.count(F.lit(1)).alias("cpu_rows"))
    return status.join(cpu, "date", "full_outer")


def stream_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Observations in two halves of time, labelled in two micro-batches."""
    source, target, marks = (scratch_path(spark, p) for p in ("seen", "labelled", "checkpoint"))
    observations = digest_observations(spark, sf)
    middle = X.BASE_US + 15 * 86_400_000_000
    for part in (F.col("ts_us") < middle, F.col("ts_us") >= middle):
        observations.where(part).write.mode("append").json(source)
        query = stream_changes.digest_stream(spark, source, target, marks, trigger=ONCE)
        _drain({"digest": query})
    return spark.read.parquet(target).select("image", "ts_us", "digest", "previous", "outcome")


def stream_output(spark: SparkSession, sf: str) -> DataFrame:
    source, root, marks = (scratch_path(spark, p) for p in ("chunks", "lake", "checkpoint"))
    X.chunks(spark, sf).write.json(source)
    _drain({"output": stream_capture.output_stream(spark, source, root, marks, trigger=ONCE)})
    return X.plain(tables.read(spark, root, "container-output"))


def stream_restart_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a table whose stream was stopped, fed the same lines again and restarted."""
    staged, root, marks = (scratch_path(spark, p) for p in ("staged", "lake", "checkpoint"))
    for _ in range(2):
        envelope.stage(X.status_lines(spark, sf), staged)
        _drain(stream_load.ingest_stream(spark, staged, root, marks, names=["status"], trigger=ONCE))
    return X.plain(tables.read(spark, root, "status"))


# How long a line may come again, and how much later the second capture's new lines are.
REPEATS_WITHIN, LATER_US = "1 hour", 40 * 86_400_000_000


def stream_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of a capture that drops repeats: in the second, every chunk comes again and new ones come later.

    What comes again within the delay is known from the state, what is older is late; either way
    it is not stored twice.
    """
    source, root, marks = (scratch_path(spark, p) for p in ("chunks", "lake", "checkpoint"))
    again = X.chunks(spark, sf).withColumn("chunk_id", F.col("chunk_id") + (1 << 30))
    later = X.chunks(spark, sf, LATER_US).withColumn("chunk_id", F.col("chunk_id") + (1 << 31))
    for chunks in (X.chunks(spark, sf), again.union(later)):
        chunks.write.mode("append").option("compression", "gzip").json(source)
        query = stream_capture.output_stream(spark, source, root, marks, repeats_within=REPEATS_WITHIN, trigger=ONCE)
        _drain({"output": query})
    return X.plain(tables.read(spark, root, "container-output")).select("timestamp", "service", "stream", "message")


QUERIES = {f.__name__: f for f in (stream_ingest, stream_restart, stream_restart_rows, stream_digest, stream_output, stream_repeats)}
ORACLES = {
    "stream_ingest": f"WITH {X.D} {X.DEPLOYMENT_ROWS}",
    "stream_restart": f"""WITH {X.E} SELECT CAST(make_timestamp(us) AS DATE) AS date, 2 * count(*) AS status_rows,
      count(*) AS cpu_rows FROM e GROUP BY ALL""",
    "stream_restart_rows": f"""WITH {X.E}, s AS ({X.STATUS_ROWS}) SELECT * FROM s UNION ALL SELECT * FROM s""",
    "stream_repeats": f"""WITH {X.C}, d AS (SELECT DISTINCT timestamp_us, service, stream, message FROM parsed)
      SELECT timestamp_us AS timestamp, service, stream, message FROM d
      UNION ALL SELECT timestamp_us + {LATER_US}, service, stream, message FROM d""",
    "stream_digest": BATCH["digest_changes"],
    "stream_output": f"""WITH {X.C} SELECT CAST(make_timestamp(timestamp_us) AS DATE) AS date, timestamp_us AS timestamp, service,
      service AS container_id, stream, message, chunk_id * 1048576 + line_no AS sequence FROM parsed""",
}
