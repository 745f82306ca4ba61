"""Session settings and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Temporary folders of local sessions without a configured one, by application.
_local_dirs: dict[str, str] = {}
# Applications whose executors have got the package.
_shipped: set[str] = set()
# Scratch locations handed out and not yet removed.
_scratch: list[str] = []
# Locations that several later steps share.
_kept: list[str] = []


def use_utc(spark: SparkSession) -> SparkSession:
    """Timestamps in the tables are UTC instants; pin the session zone to match."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster such a
    folder exists on one machine only.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="telelake-")
    return _local_dirs[application]


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of ``spark``, wherever they run; once per application.

    Functions that run in tasks are pickled by reference, and workers need not have the
    package on their path. Spark serves the archive to every executor, new ones too.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="telelake-"), "telelake.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh, never reused location in the shared folder."""
    path = f"{shared_dir(spark)}/telelake/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch location that nothing reads any more."""
    if path in _scratch:
        _scratch.remove(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remove_scratch(spark: SparkSession, kept: bool = False) -> None:
    """Delete what this process has stored so far; DataFrames built on it end here."""
    if kept:
        _scratch.extend(_kept)
        _kept.clear()
    while _scratch:
        drop_scratch(spark, _scratch[-1])


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the stored table.

    Cuts lineage in a way that survives lost executors and fixes values that must
    not change between two uses, such as partition numbers. With ``keep``, the table
    outlives :func:`remove_scratch` unless that is asked to remove kept ones too.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if keep:
        _scratch.remove(path)
        _kept.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
