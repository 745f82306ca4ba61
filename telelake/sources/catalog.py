"""The tables under names of a catalog, for SQL and for writes by name.

The catalog holds schema, place and partitions; the files are the same that loads, streams and
maintenance use. Scans by name ask the catalog for the partitions of a date instead of listing
directories. Partitions that were written by path become known by :func:`refresh`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telelake.sources import tables


def table_name(database: str, name: str) -> str:
    """Name for SQL; hyphens of table names become underscores."""
    return f"`{database}`.`{name.replace('-', '_')}`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(
    spark: SparkSession,
    root: str,
    database: str,
    names: Iterable[str] = tuple(tables.TABLES),
    date_only: Iterable[str] = (),
) -> dict[str, str]:
    """Create the database and its tables where they are missing; the names for SQL by table.

    Tables that exist keep their rows and the layout they were created with; new ones in
    ``date_only`` are partitioned by date alone.
    """
    date_only = set(date_only)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION {_text(tables.base_uri(root))}")
    found = {}
    for name in names:
        tables.ensure_table(spark, root, name, by_date_only=name in date_only)
        partitions = tables.recorded_layout(spark, root, name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tables.TABLES[name].schema)
        target = table_name(database, name)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {target} ({columns}) USING {tables.DEFAULT_FORMAT}"
            f" PARTITIONED BY ({', '.join(partitions)}) LOCATION {_text(tables.table_uri(root, name))}"
        )
        found[name] = target
    refresh(spark, database, found)
    return found


def refresh(spark: SparkSession, database: str, names: Iterable[str] = tuple(tables.TABLES)) -> None:
    """Let the catalog see what loads, streams or maintenance have changed by path: new and gone partitions, new files."""
    for name in names:
        target = table_name(database, name)
        spark.sql(f"MSCK REPAIR TABLE {target} SYNC PARTITIONS")
        spark.sql(f"REFRESH TABLE {target}")


def insert(df: DataFrame, root: str, database: str, name: str) -> None:
    """Append complete rows by name; a row that breaks the non-null contract fails the write."""
    spark, target = df.sparkSession, table_name(database, name)
    partitions = tables.recorded_layout(spark, root, name)
    rows = tables.laid_out(tables.conformed(df, name), name, partitions)
    # Columns go by position: the partition columns of a table come last.
    rows.select(*[F.col(f"`{c}`") for c in spark.table(target).columns]).write.insertInto(target)
