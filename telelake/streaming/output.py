"""Continuous capture of container output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telelake.functions import scalars as S
from telelake.operators import output
from telelake.sources import tables
from telelake.streaming.ingest import start_sink

CHUNKS = "chunk_id bigint, service string, stream string, text string, observed_us bigint"
# Bits of the line number inside a sequence, and of the chunk number above it.
_LINE_BITS = 20
_CHUNK_BITS = 43


def stream_sequence(chunk_id: Column, line_no: Column) -> Column:
    """Order-preserving number that needs no state: chunk number, then line number.

    Lines of a chunk are in order whatever its length, and no number stops the stream.
    Chunk numbers start again after 2^43; lines beyond the 2^20th of a chunk may be
    numbered like those of the next one, which only matters within one microsecond.
    """
    return F.shiftleft(F.pmod(chunk_id, F.lit(1 << _CHUNK_BITS)), _LINE_BITS) + line_no


def told(message: Column) -> Column:
    """What the state keeps of a message: itself if it is short, or 32 bytes, its SHA-256.

    No digest is as short as the messages kept whole, so the two are never taken for each other.
    """
    held = F.encode(message, "UTF-8")
    return F.when(F.octet_length(message) < 32, held).otherwise(F.unhex(F.sha2(held, 256)))


def captured_rows(chunks: DataFrame, repeats_within: str | None = None) -> DataFrame:
    """Table rows of a chunk stream.

    ``repeats_within`` drops lines that come again within that delay, as at the second
    shared by two captures in a row. Lines of one service and stream with the same text
    and the same microsecond count as repeats.
    """
    parsed = output.capture(chunks)
    rows = parsed.select(
        S.date_bucket(F.col("timestamp_us")).alias("date"),
        F.timestamp_micros("timestamp_us").alias("timestamp"),
        "service",
        F.col("service").alias("container_id"),
        "stream",
        "message",
        stream_sequence(F.col("chunk_id"), F.col("line_no")).alias("sequence"),
    )
    if repeats_within:
        watched = rows.withColumn("_told", told(F.col("message"))).withWatermark("timestamp", repeats_within)
        rows = watched.dropDuplicatesWithinWatermark(["service", "timestamp", "stream", "_told"]).drop("_told")
    return rows


def output_stream(
    spark: SparkSession,
    source: str,
    root: str,
    checkpoint: str,
    *,
    repeats_within: str | None = None,
    trigger: dict | None = None,
    **source_options,
) -> StreamingQuery:
    """Read chunk files (JSON lines) and append to ``container-output``.

    The file source remembers what was read, which takes the place of a capture mark.
    """
    reader = spark.readStream.schema(CHUNKS)
    for key, value in source_options.items():
        reader = reader.option(key, value)
    rows = captured_rows(reader.json(source), repeats_within)
    return start_sink(rows, root, tables.TABLES["container-output"].name, checkpoint, trigger)
