"""Container output capture: chunks to lines, truncation, timestamps, increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telelake.functions import scalars as S
from telelake.plans.running import numbered

# Captured streams, line cap in bytes and truncation mark.
STREAMS = ("stdout", "stderr")
LINE_BYTES = 4096
TRUNCATED = "...[TRUNCATED]"


def lines(chunks: DataFrame) -> DataFrame:
    """Non-empty lines of stdout and stderr chunks with their ``line_no`` in the chunk.

    ``text`` may be text or bytes; invalid UTF-8 is replaced.
    """
    text = F.make_valid_utf8(F.col("text").cast("string"))
    kept = chunks.where(F.col("stream").isin(*STREAMS))
    exploded = kept.select(
        *[c for c in chunks.columns if c != "text"],
        F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"),
    )
    return exploded.where("line <> ''")


def truncate(line: Column, limit: int = LINE_BYTES) -> Column:
    """Cut a line to ``limit`` bytes, never inside a character, and mark the cut."""
    raw = line.cast("binary")
    cuts = [
        F.try_validate_utf8(F.substring(raw, 1, limit - back).cast("string")) for back in range(4)
    ]
    return F.when(F.octet_length(line) > limit, F.concat(F.coalesce(*cuts), F.lit(TRUNCATED))).otherwise(line)


def parse(captured: DataFrame) -> DataFrame:
    """Split each (truncated) line into ``timestamp_us`` and ``message``.

    The part before the first space is taken as the time; when it is not one, the
    observation time stands in and the part is lost all the same. A line without a
    space is all message.
    """
    cut = captured.withColumn("line", truncate(F.col("line")))
    space = F.instr("line", " ")
    stamp = F.when(space > 0, F.substring(F.col("line"), F.lit(1), space - 1))
    rest = F.substring(F.col("line"), space + 1, F.length("line"))
    return cut.select(
        *[c for c in captured.columns if c != "line"],
        F.coalesce(S.rfc3339_micros(stamp), F.col("observed_us")).alias("timestamp_us"),
        rest.alias("message"),
    )


def capture(chunks: DataFrame) -> DataFrame:
    """Chunks to parsed lines."""
    return parse(lines(chunks))


def sequence(parsed: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """Number lines from 0 per service and date by time, chunk and line.

    Numbers come from segment counts, so a service with most of the output does not
    end up in one task.
    """
    dated = parsed.withColumn("date", S.date_bucket(F.col("timestamp_us")))
    order = [F.col("timestamp_us"), F.col(chunk_id), F.col("line_no")]
    return numbered(dated, ["service", "date"], order, "sequence")


def to_rows(sequenced: DataFrame) -> DataFrame:
    """Rows of the ``container-output`` table; the container is known by its service name."""
    return sequenced.select(
        "date",
        F.timestamp_micros("timestamp_us").alias("timestamp"),
        "service",
        F.col("service").alias("container_id"),
        "stream",
        "message",
        "sequence",
    )


def increment(parsed: DataFrame, marks: DataFrame, now_s: int) -> DataFrame:
    """Lines of the window from each service's mark up to ``now_s - 1``, in whole seconds.

    Both ends are included, so the boundary second belongs to two windows in a row.
    ``marks(service, mark)`` has one row per service; a new service starts at 0.
    """
    second = F.floor(F.col("timestamp_us") / 1_000_000)
    upper = parsed.where(second <= now_s - 1)
    marked = upper.join(marks, "service", "left")
    return marked.where(second >= F.coalesce("mark", F.lit(0))).drop("mark")


def advance_marks(marks: DataFrame, read: DataFrame, now_s: int) -> DataFrame:
    """New marks: ``now_s - 1`` for services that were read, the old mark otherwise."""
    seen = read.groupBy("service").agg(F.lit(now_s - 1).cast("bigint").alias("new_mark"))
    merged = marks.join(seen, "service", "full_outer")
    return merged.select("service", F.coalesce("new_mark", "mark").alias("mark"))


def without_repeats(window: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Drop lines the previous window already had, occurrence by occurrence."""
    return window.select(*columns).exceptAll(previous.select(*columns))


def replay(rows: DataFrame) -> DataFrame:
    """Rows in replay order: by service, time and sequence across and inside partitions."""
    order = ["service", "timestamp", "sequence"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def tail(rows: DataFrame, count: int) -> DataFrame:
    """Last ``count`` lines of every service.

    The rank filter is applied before the shuffle too, so each task sends at most
    ``count`` rows per service.
    """
    from pyspark.sql import Window

    latest = Window.partitionBy("service").orderBy(F.desc("timestamp"), F.desc("sequence"))
    ranked = rows.withColumn("_rank", F.row_number().over(latest))
    return ranked.where(F.col("_rank") <= count).drop("_rank")
