"""Stable numbers for a set of keys: reserve what is assigned, fill the gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telelake.plans.running import numbered, with_running

FIRST_SLOT = 2
RESERVED = (1,)


def assign_slots(
    keys: DataFrame,
    existing: DataFrame,
    *,
    key: str = "name",
    order: str = "position",
    in_use: DataFrame | None = None,
    first: int = FIRST_SLOT,
    reserved: Sequence[int] = RESERVED,
    segments: int | None = None,
) -> DataFrame:
    """``(key, slot, kept)`` for every row of ``keys``.

    Keys found in ``existing(key, slot)`` keep their number, numbers of vanished keys
    are free again, and the others get the lowest free numbers from ``first`` on in
    the order of ``order``. ``in_use(slot)`` lists numbers that are taken otherwise.

    The n-th free number is ``first + n`` plus the used numbers below it. Both ranks
    are running counts over range-partitioned rows, so nothing is numbered in one task
    and no range of candidate numbers is generated.
    """
    spark = keys.sparkSession
    held = keys.join(existing.select(key, "slot"), key, "left")
    kept = held.where("slot is not null").select(key, F.col("slot").cast("bigint"))
    fresh = held.where("slot is null").select(key, F.col(order))

    taken = kept.select("slot").union(spark.createDataFrame([(int(r),) for r in reserved], "slot bigint"))
    if in_use is not None:
        taken = taken.union(in_use.select(F.col("slot").cast("bigint")))
    taken = taken.where(F.col("slot") >= first).distinct()

    one = F.lit(1).cast("bigint")
    # Used number u with j used numbers before it has u - first - j free numbers below.
    ranked = numbered(taken, [], [F.col("slot")], "_before", segments)
    gaps = ranked.select((F.col("slot") - first - F.col("_before")).alias("_at"))
    queue = numbered(fresh, [], [F.col(order), F.col(key)], "_at", segments).select(key, "_at")

    # A waiting key passes every used number whose free count is at most its own rank.
    absent = F.lit(None).cast(keys.schema[key].dataType)
    events = gaps.select(absent.alias(key), "_at", F.lit(0).alias("_kind")).union(
        queue.select(key, "_at", F.lit(1).alias("_kind"))
    )
    passed = with_running(
        events,
        [],
        [F.col("_at"), F.col("_kind")],
        sums={"_passed": F.when(F.col("_kind") == 0, one).otherwise(F.lit(0).cast("bigint"))},
        segments=segments,
    )
    filled = passed.where("_kind = 1").select(
        key, (F.col("_at") + F.col("_passed") + first).alias("slot"), F.lit(False).alias("kept")
    )
    return kept.withColumn("kept", F.lit(True)).union(filled)
