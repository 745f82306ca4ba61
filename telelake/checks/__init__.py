"""Registered checks: each operator run on telemetry derived from the test tables,
with the SQL that computes the same rows from the base tables."""

from __future__ import annotations

from telelake.checks import functions, ingest, operators, records, streams

MODULES = (ingest, records, functions, operators, streams)


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(module.ORACLES)
    return found
