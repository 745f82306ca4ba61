"""Running values over ordered rows that do not need one task per key.

A plain window sorts all rows of a key in one task. Here the rows are cut into
evenly sized segments by a range partitioning on (keys, order), so a key that
holds a third of the data is spread over a third of the segments. Values are
computed inside each segment and corrected with the totals of earlier segments of
the same key. A segment can only continue the key its predecessor ended with, so
there is at most one correction row per segment and that table is safe to
broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telelake.session import materialize

POSITION = "_position"
SEGMENT = "_segment"
# monotonically_increasing_id keeps the partition number in the bits above 33.
_ROW_BITS = 33


def in_segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], segments: int | None = None
) -> DataFrame:
    """Store ``df`` sorted by (keys, order) with its global position and segment."""
    count = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = [F.col(k) for k in keys] + list(order)
    ordered = df.repartitionByRange(count, *wanted).sortWithinPartitions(*wanted)
    stored = materialize(ordered.withColumn(POSITION, F.monotonically_increasing_id()), "segments")
    return stored.withColumn(SEGMENT, F.shiftright(POSITION, _ROW_BITS))


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, segments: int | None = None
) -> DataFrame:
    """Add ``name``: the number, from 0, of each row among those with the same ``keys``, along ``order``.

    Rows move once. Inside a segment a number is a difference of positions; one row per
    segment and key, of which all but one per segment begin and end there, says how many
    rows of the key come before.
    """
    rows = in_segments(df, keys, order, segments)
    seg_keys = [SEGMENT, *keys]
    parts = rows.groupBy(*seg_keys).agg(F.count(F.lit(1)).alias("_n"), F.min(POSITION).alias("_first"))
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(SEGMENT)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # Where a key begins its segment, number and position of a row differ by what came before.
    starts = parts.select(
        *[F.col(k).alias(f"_c{k}") for k in seg_keys],
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    match = F.lit(True)
    for key in seg_keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_c{key}"))
    # As many rows as keys and segments: the engine measures whether to broadcast them.
    joined = rows.join(starts, match).withColumn(name, F.col(POSITION) + F.col("_shift"))
    return joined.drop(*[f"_c{k}" for k in seg_keys], "_shift", SEGMENT, POSITION)


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    segments: int | None = None,
) -> DataFrame:
    """Add running columns per ``keys`` along ``order``.

    ``sums``: inclusive running sum. ``lasts``: last non-null value up to and
    including the row. ``before``: last non-null value of strictly earlier rows.
    ``order`` must be a total order for the result to be deterministic; reverse it
    to look forward.
    """
    sums, lasts, before = dict(sums or {}), dict(lasts or {}), dict(before or {})
    inputs = {**sums, **lasts, **before}
    for name, value in inputs.items():
        df = df.withColumn(f"_in_{name}", value)
    rows = in_segments(df, keys, order, segments)

    seg_keys = [SEGMENT, *keys]
    totals = rows.groupBy(*seg_keys).agg(
        *[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in sums],
        *[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col(POSITION))).alias(
                f"_tot_{n}"
            )
            for n in (*lasts, *before)
        ],
    )
    # One row per (key, segment): a group here is never larger than the segment count.
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(SEGMENT)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *seg_keys,
        F.row_number()
        .over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SEGMENT))
        .alias("_nth"),
        *[F.sum(f"_tot_{n}").over(earlier).alias(f"_carry_{n}") for n in sums],
        *[
            F.last(f"_tot_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}")
            for n in (*lasts, *before)
        ],
    )
    carried = carried.where("_nth > 1").drop("_nth")
    for key in seg_keys:
        carried = carried.withColumnRenamed(key, f"_c{key}")

    match = F.lit(True)
    for key in seg_keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_c{key}"))
    joined = rows.join(F.broadcast(carried), match, "left")

    inside = Window.partitionBy(*seg_keys).orderBy(POSITION)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = joined.select(
        "*",
        *[
            (F.coalesce(F.sum(f"_in_{n}").over(upto), F.lit(0)) + F.coalesce(f"_carry_{n}", F.lit(0)))
            .alias(n)
            for n in sums
        ],
        *[
            F.coalesce(F.last(f"_in_{n}", ignorenulls=True).over(upto), f"_carry_{n}").alias(n)
            for n in lasts
        ],
        *[
            F.coalesce(F.last(f"_in_{n}", ignorenulls=True).over(prior), f"_carry_{n}").alias(n)
            for n in before
        ],
    )
    helper = [f"_c{k}" for k in seg_keys] + [SEGMENT, POSITION]
    helper += [f"_in_{n}" for n in inputs] + [f"_carry_{n}" for n in inputs]
    return out.drop(*helper)
