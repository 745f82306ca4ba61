"""Batch load of staged lines into the tables."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telelake.operators.normalize import NORMALIZERS
from telelake.session import drop_scratch, scratch_path
from telelake.sources import envelope, tables

REPORT = "table string, ok boolean, loaded bigint, rejected bigint, error string"
QUARANTINE = "_quarantine"
REJECTED = "value string, file string, reason string, table string"


def table_rows(
    lines: DataFrame, table: str, version_key: str = envelope.DEFAULT_VERSION_KEY
) -> DataFrame:
    """Rows of ``table`` from the staged lines that can be loaded whole.

    All other lines are those of :func:`telelake.sources.envelope.quarantine`; nothing is
    left out later on. Requests that may hold nested attribute values take a branch of their own, so
    that the others never pass through Python. The test on the raw text is cheap and
    may only err towards that branch.
    """

    def rows(part: DataFrame, **options) -> DataFrame:
        events = envelope.decode(part, envelope.TABLE_VARIANT[table], version_key, **options)
        return NORMALIZERS[table](events, **options)

    if table not in ("logs", "traces"):
        return rows(lines)
    nested = envelope.may_nest(F.col("value"))
    return rows(lines.where(~nested), nested=False).union(rows(lines.where(nested), nested=True))


def _normalised(judged: DataFrame, table: str, version_key: str) -> DataFrame:
    """Rows of ``table`` from stored verdicts; requests without nested values never see Python."""
    if table not in ("logs", "traces"):
        return NORMALIZERS[table](envelope.events_of(judged, version_key))
    parts = [
        NORMALIZERS[table](envelope.events_of(judged.where(F.col("nested") == nested), version_key), nested=nested)
        for nested in (False, True)
    ]
    return parts[0].union(parts[1])


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    """``(value, file, reason, table)`` of all lines that loads have rejected; none before the first."""
    path = f"{root.rstrip('/')}/{QUARANTINE}"
    if not tables.exists(spark, path):
        return spark.createDataFrame([], REJECTED)
    return spark.read.schema(REJECTED).parquet(path)


def ingest_batch(
    lines: DataFrame,
    root: str,
    *,
    names: Iterable[str] = tuple(tables.TABLES),
    roots: dict[str, str] | None = None,
    version_key: str = envelope.DEFAULT_VERSION_KEY,
    fmt: str = tables.DEFAULT_FORMAT,
) -> DataFrame:
    """Load every table from staged lines and report on each.

    Each line is parsed once. The verdicts on the lines of a table (its event, or the reason
    why it has none) are stored for the time of the load, in the scratch folder; table rows, rejected
    lines and counts are all read from there. ``loaded`` and ``rejected`` count staged lines; rejected lines
    are appended to the table ``_quarantine`` of ``root`` with file and reason, a directory for each
    table, as jobs that write to one directory at a time disturb each other. The row without a table
    stands for lines of unknown files. Each table reads only its own staged files and fails
    on its own; the batch may be discarded when every row says ``ok``. ``roots`` places
    single tables elsewhere.
    """
    spark: SparkSession = lines.sparkSession
    quarantine = f"{root.rstrip('/')}/{QUARANTINE}"

    def load(name: str) -> tuple:
        """Report of one table; what has been counted stays where a later step fails."""
        good = bad = 0
        path = scratch_path(spark, f"verdicts-{name}")
        try:
            judged = envelope.verdicts(lines, envelope.TABLE_VARIANT[name], version_key)
            judged.write.option("compression", "zstd").parquet(path)
            judged = spark.read.schema(judged.schema).parquet(path)
            every, bad = judged.agg(F.count(F.lit(1)), F.count("reason")).first()
            if bad:
                rejected = judged.where("reason is not null").select("value", "file", "reason")
                rejected.write.mode("append").parquet(f"{quarantine}/table={name}")
            good = every - bad
            if good:
                tables.append(_normalised(judged, name, version_key), (roots or {}).get(name, root), name, fmt)
            return name, True, good, bad, None
        except Exception as error:  # noqa: BLE001 - one table must not stop the others
            return name, False, 0, bad, tables.first_line(error)
        finally:
            drop_scratch(spark, path)

    def reject() -> tuple | None:
        """Report of the lines that belong to no table."""
        try:
            strange = envelope.unknown(lines)
            found = strange.count()
            if found:
                strange.write.mode("append").parquet(f"{quarantine}/table=unknown")
            return (None, True, 0, found, None) if found else None
        except Exception as error:  # noqa: BLE001
            return None, False, 0, 0, tables.first_line(error)

    names = list(names)
    with ThreadPoolExecutor(max_workers=len(names) + 1) as pool:
        waiting = pool.submit(reject)
        report = [*pool.map(load, names), waiting.result()]
    return spark.createDataFrame([r for r in report if r], REPORT)
