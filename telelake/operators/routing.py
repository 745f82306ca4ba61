"""Longest-prefix routing of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telelake.functions import scalars as S


def route_prefixes(path: Column) -> Column:
    """Every route path that would match ``path``: ``/``, the path, and each head that
    ends before a ``/``."""
    slashes = F.filter(
        F.sequence(F.lit(2), F.greatest(F.length(path), F.lit(2))),
        lambda i: F.substring(path, i, F.lit(1)) == "/",
    )
    heads = F.transform(slashes, lambda i: F.substring(path, F.lit(1), i - 1))
    return F.array_distinct(F.concat(F.array(F.lit("/"), path), heads))


def route_join(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Resolve ``requests(host, path, …)`` against ``routes(host, path, service)``.

    Adds ``route`` and ``service``; every request row stays a row of its own, whatever its
    columns are. Unmatched requests keep NULL. Equal routes of one host are decided by
    service name.

    Each (host, path) that occurs is resolved once, so repeated requests cost one row. Its
    prefixes are joined with the routes, of which only the known ones remain, and the
    longest is kept by length: a number, so that the reduction is a hash aggregation, and
    the prefix follows from it. No step gathers the routes of a host.
    """
    table = (
        routes.select("host", S.normal_path(F.col("path")).alias("route"), "service")
        .groupBy("host", "route")
        .agg(F.min("service").alias("service"))
    )
    known = table.select("host", "route")
    path = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    asked = requests.select("host", "path").where("host is not null and path is not null").distinct()
    prefixes = asked.select("host", "path", F.explode(route_prefixes(path)).alias("route"))
    longest = (
        prefixes.join(known, ["host", "route"], "left_semi")
        .groupBy("host", "path")
        .agg(F.max(F.length("route")).alias("_length"))
    )
    # A route of one character is the root, also for paths that do not begin with it.
    route = F.when(F.col("_length") == 1, "/").otherwise(F.substring(path, F.lit(1), F.col("_length")))
    resolved = longest.select("host", "path", route.alias("route")).join(table, ["host", "route"])
    found = requests.join(resolved.select("host", "path", "route", "service"), ["host", "path"], "left")
    return found.select(*requests.columns, "route", "service")
