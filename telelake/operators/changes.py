"""Change detection and snapshot comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telelake.functions import scalars as S
from telelake.plans.running import with_running

# Outcomes of a digest observation.
BASELINE = "Baseline"
UPDATED = "Updated"
NOT_UPDATED = "NotUpdated"
DELETED = "Deleted"


def observed_digest(observations: DataFrame) -> DataFrame:
    """Add ``digest``: NULL for a failed read or an unusable digest."""
    digest = S.image_digest(F.col("repo_digests"), F.col("image_id")).getField("digest")
    return observations.withColumn("digest", F.when(~F.col("failed"), digest))


def classify(digest, previous, first):
    """Outcome of an observation given the last good digest before it."""
    return (
        F.when(first, BASELINE)
        .when(digest.isNull(), DELETED)
        .when(digest.eqNullSafe(previous), NOT_UPDATED)
        .otherwise(UPDATED)
    )


def digest_changes(
    observations: DataFrame, order: Sequence[str] = ("ts_us",), segments: int | None = None
) -> DataFrame:
    """Label every ``(image, <order>, digest)`` observation.

    The first observation of an image sets the baseline. A failed read keeps the last
    good digest. An image observed very often is cut into several segments.
    """
    tracked = with_running(
        observations,
        ["image"],
        [F.col(c) for c in order],
        before={"previous": F.col("digest")},
        sums={"_nth": F.lit(1).cast("bigint")},
        segments=segments,
    )
    outcome = classify(F.col("digest"), F.col("previous"), F.col("_nth") == 1)
    return tracked.withColumn("outcome", outcome).drop("_nth")


def comparable(value: Column, kind: T.DataType) -> Column:
    """The same value in a form that can be compared: maps become sorted lists of pairs."""
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                comparable(e["key"], kind.keyType).alias("key"), comparable(e["value"], kind.valueType).alias("value")
            ),
        )
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[comparable(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def config_diff(new: DataFrame, old: DataFrame, key: str = "name") -> DataFrame:
    """``(name, action)`` for two snapshots with the same columns and unique names.

    ``recreate``: any field differs; ``keep``: all equal, NULLs included; ``start``:
    only in the new snapshot; ``remove``: only in the old one. Fields may be maps, lists
    and structs: the order of a map's entries does not count, that of a list does.
    """
    fields = [c for c in new.columns if c != key]

    def whole(df: DataFrame) -> Column:
        return F.struct(*[comparable(F.col(c), df.schema[c].dataType).alias(c) for c in fields])

    left = new.select(key, whole(new).alias("_new"))
    right = old.select(key, whole(old).alias("_old"))
    action = (
        F.when(F.col("_old").isNull(), "start")
        .when(F.col("_new").isNull(), "remove")
        .when(F.col("_new").eqNullSafe(F.col("_old")), "keep")
        .otherwise("recreate")
    )
    return left.join(right, key, "full_outer").select(key, action.alias("action"))


def service_filter(services: DataFrame, filters: Sequence[str] | None, path: str = "path") -> DataFrame:
    """Services whose path equals a filter or ends in ``/`` + filter; no filter keeps all."""
    if filters is None:
        return services
    wanted = F.lit(False)
    for item in filters:
        wanted = wanted | (F.col(path) == item) | F.endswith(F.col(path), F.lit("/" + item))
    return services.where(wanted)


def renewal_due(hosts: DataFrame, certificates: DataFrame, now_s: int, days: int = 30) -> DataFrame:
    """Hosts whose managed certificate is missing, unreadable or close to its end.

    ``hosts(host, cert_file, key_file)`` and ``certificates(host, not_after_s)`` have
    one row per host. Hosts with their own certificate or key are left alone.
    """
    managed = hosts.where(F.col("cert_file").isNull() & F.col("key_file").isNull())
    known = managed.join(certificates, "host", "left")
    left_days = S.int_div(F.col("not_after_s") - now_s, 86_400)
    due = F.col("not_after_s").isNull() | (left_days < days)
    return known.where(due).select("host", left_days.alias("days_left"))
