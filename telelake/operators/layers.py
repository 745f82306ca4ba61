"""Rules over configuration rows: duplicates, overrides, preferences, strict keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_services(services: DataFrame) -> DataFrame:
    """``(name, path, uses)``: every path of a name that is used more than once.

    One row per path rather than one list per name, so a name used without bound
    stays distributed.
    """
    uses = services.groupBy("name").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    return services.select("name", "path").join(uses, "name")


def layered_vars(layers: DataFrame) -> DataFrame:
    """``(key, value)`` of ``layers(layer, key, value)``; the highest layer wins.

    Layer 0 is the main file, the others follow in file-name order. Each task sends
    one row per key.
    """
    return layers.groupBy("key").agg(F.max_by("value", "layer").alias("value"))


def preferred_proxy(proxies: DataFrame) -> DataFrame:
    """One row per host: the first with a certificate, otherwise the first."""
    rank = F.struct(F.col("cert_file").isNull(), F.col("position"))
    fields = [c for c in proxies.columns if c != "host"]
    best = proxies.groupBy("host").agg(F.min_by(F.struct(*fields), rank).alias("_best"))
    return best.select("host", "_best.*")


def _prefixed(names: Column, prefix: str) -> Column:
    return F.transform(names, lambda k: F.concat(F.lit(prefix), k))


def _field(path: str):
    return lambda text: F.get_json_object(text, path)


def unknown_keys(text: Column, allowed: Mapping[str, Sequence[str]]) -> Column:
    """Keys of a JSON document outside the allowed ones, as ``path.key``.

    ``allowed`` maps a dotted path (``""`` for the root) to the keys known there. A part
    that ends in ``[]`` stands for the elements of a list: ``proxy.port[]``. Absent
    objects and lists pass, and so do elements that are no objects.
    """
    none = F.array().cast("array<string>")
    found = []
    for path, keys in allowed.items():
        levels = F.array(text)
        for part in path.split(".") if path else ():
            name = part.removesuffix("[]")
            levels = F.transform(levels, _field(f"$.{name}"))
            if part.endswith("[]"):
                # An element is kept as its own JSON text, whatever it is.
                items = F.transform(levels, lambda t: F.coalesce(F.from_json(t, "array<string>"), none))
                levels = F.flatten(items)
        known = F.array(*[F.lit(k) for k in keys])
        extra = F.flatten(
            F.transform(levels, lambda t: F.coalesce(F.array_except(F.json_object_keys(t), known), none))
        )
        prefix = f"{path}." if path else ""
        found.append(_prefixed(F.array_distinct(extra), prefix))
    return F.concat(*found)


def strict_keys(records: DataFrame, column: str, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add ``accepted`` and ``unknown``: whether the document is valid JSON without unknown keys."""
    extra = F.array_sort(unknown_keys(F.col(column), allowed))
    known = records.withColumn("unknown", F.array_join(extra, ","))
    valid = F.json_object_keys(column).isNotNull()
    return known.withColumn("accepted", valid & (F.col("unknown") == ""))
