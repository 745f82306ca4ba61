"""Reading traces and logs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logs_with_spans(logs: DataFrame, spans: DataFrame, how: str = "inner") -> DataFrame:
    """Log rows with name, kind and duration of the span they were written in.

    Logs without ids match nothing. They take no part in the join, where they would all be
    one key; a left join gets them back as they are.
    """
    keys = ["trace_id", "span_id"]
    side = spans.where(_named(*keys)).select(
        *keys,
        F.col("name").alias("span_name"),
        F.col("kind").alias("span_kind"),
        F.col("duration_ms").alias("span_duration_ms"),
    )
    joined = logs.where(_named(*keys)).join(side, keys, how)
    if how == "inner":
        return joined
    if how != "left":
        raise ValueError(f"inner or left, not {how}")
    added = [f for f in side.schema if f.name not in keys]
    alone = logs.where(~_named(*keys)).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    return joined.unionByName(alone)


def _named(trace: str, span: str) -> Column:
    """Whether both ids are there; absent ones are NULL or empty."""
    return F.coalesce((F.col(trace) != "") & (F.col(span) != ""), F.lit(False))


def span_children(spans: DataFrame) -> DataFrame:
    """Every span with its number of children and the time not spent in them.

    Children are counted before the join, so a span with very many of them arrives as
    one row per task. Spans without an id can have none and take no part in the join,
    where they would all be one key.
    """
    below = (
        spans.where("parent_span_id is not null")
        .groupBy("trace_id", F.col("parent_span_id").alias("span_id"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("duration_ms").alias("_ms"))
    )
    own = spans.select("trace_id", "span_id", "duration_ms")
    named = _named("trace_id", "span_id")
    childless = own.where(~named).select(
        "trace_id", "span_id", F.lit(0).cast("bigint").alias("children"), F.col("duration_ms").alias("self_ms")
    )
    joined = own.where(named).join(below, ["trace_id", "span_id"], "left")
    counted = joined.select(
        "trace_id",
        "span_id",
        F.coalesce("_n", F.lit(0)).alias("children"),
        (F.col("duration_ms") - F.coalesce("_ms", F.lit(0))).alias("self_ms"),
    )
    return counted.unionByName(childless)


def span_orphans(spans: DataFrame) -> DataFrame:
    """Spans that name a parent which is not in the table.

    Named and existing ids are set against each other by one aggregation over ids alone,
    which combines repeats in each task. Only the missing ones, few as a rule, are joined
    with the spans, whose rows then need no shuffle. Without a trace a parent cannot be found.
    """
    claims = spans.where("parent_span_id is not null")
    ids = [
        claims.select("trace_id", "parent_span_id", F.lit(False).alias("_there")),
        spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_there")),
    ]
    missing = (
        ids[0].unionByName(ids[1])
        .where("trace_id is not null")
        .groupBy("trace_id", "parent_span_id")
        .agg(F.bool_or("_there").alias("_there"))
        .where("not _there")
        .drop("_there")
    )
    found = claims.join(missing, ["trace_id", "parent_span_id"], "left_semi").select(*spans.columns)
    return found.unionByName(claims.where("trace_id is null"))


def attribute(column: str, key: str) -> Column:
    """Value of one attribute in a JSON text column."""
    return F.get_json_object(column, f"$['{key}']")


def span_events(spans: DataFrame) -> DataFrame:
    """One row per span event."""
    return spans.select("trace_id", "span_id", F.explode("events").alias("e")).select(
        "trace_id", "span_id", "e.timestamp", "e.name", "e.attributes"
    )
