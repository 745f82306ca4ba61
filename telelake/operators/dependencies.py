"""Service dependencies: pruning and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telelake.functions.scalars import lookup

# Dependency conditions and their accepted spellings.
CONDITIONS = {
    "Started": "started",
    "service-started": "started",
    "service_started": "started",
    "started": "started",
    "Completed": "completed",
    "service-completed": "completed",
    "service_completed": "completed",
    "completed": "completed",
    "Healthy": "healthy",
    "service-healthy": "healthy",
    "service_healthy": "healthy",
    "healthy": "healthy",
}
RUNNING = "running"
EXITED = "exited"
NOT_FOUND = "not found"
EXIT_UNKNOWN = -1


def edges(services: DataFrame) -> DataFrame:
    """``(service, target, condition)``, one row per declared dependency."""
    listed = services.select(F.col("name").alias("service"), F.explode("depends_on"))
    return listed.select("service", F.col("key").alias("target"), lookup(F.col("value"), CONDITIONS).alias("condition"))


def prune_dependencies(services: DataFrame) -> DataFrame:
    """Remove dependencies on services that are not loaded.

    A target that very many services depend on is split by adaptive execution; the
    lists gathered at the end are no longer than the maps they came from.
    """
    loaded = services.select(F.col("name").alias("target")).distinct()
    kept = edges(services).join(loaded, "target", "left_semi")
    entries = kept.groupBy("service").agg(
        F.map_from_entries(F.collect_list(F.struct("target", "condition"))).alias("_kept")
    )
    joined = services.join(entries.withColumnRenamed("service", "name"), "name", "left")
    empty = F.create_map().cast("map<string,string>")
    return joined.withColumn("depends_on", F.coalesce("_kept", empty)).drop("_kept")


def latest_status(status: DataFrame) -> DataFrame:
    """Newest status of each service reduced to what dependency rules look at.

    ``(service, situation, health, exit_code)``. The newest time of each service is found by
    a hash aggregation over times alone; only the rows of that time are read in full, and
    ties go to the largest container. Any known state other than running counts as exited.
    """
    newest = status.groupBy("service").agg(F.max("timestamp").alias("_newest"))
    newest = newest.withColumnRenamed("service", "_service")
    latest = status.select("service", "timestamp", "container_id", "state", "health_status", "exit_code").join(
        newest, (F.col("service") == F.col("_service")) & F.col("timestamp").eqNullSafe(F.col("_newest"))
    )
    newest = latest.groupBy("service").agg(
        F.max_by(
            F.struct("state", "health_status", "exit_code"), F.struct("container_id", "state", "health_status")
        ).alias("s")
    )
    state = F.col("s.state")
    running, gone = state == "running", state == "not_found"
    return newest.select(
        "service",
        F.when(running, RUNNING).when(gone, NOT_FOUND).otherwise(EXITED).alias("situation"),
        F.when(running, F.col("s.health_status")).alias("health"),
        F.when(~running & ~gone, F.coalesce("s.exit_code", F.lit(EXIT_UNKNOWN))).alias("exit_code"),
    )


def dependency_gate(services: DataFrame, latest: DataFrame) -> DataFrame:
    """``(service, ready, waiting)``: whether every dependency condition holds.

    A service without dependencies is ready; one with a dependency of unknown status
    is not.
    """
    status = latest.withColumnRenamed("service", "target")
    known = edges(services).join(status, "target", "left")
    situation, condition = F.col("situation"), F.col("condition")
    holds = (
        F.when(condition == "started", situation == RUNNING)
        .when(condition == "completed", (situation == EXITED) & (F.col("exit_code") == 0))
        .when(condition == "healthy", (situation == RUNNING) & F.col("health").isin("healthy", "none"))
    )
    judged = known.withColumn("_holds", F.coalesce(holds, F.lit(False)))
    gates = judged.groupBy("service").agg(
        F.bool_and("_holds").alias("_ready"), F.count_if(~F.col("_holds")).alias("_waiting")
    )
    every = services.select(F.col("name").alias("service")).join(gates, "service", "left")
    return every.select(
        "service",
        F.coalesce("_ready", F.lit(True)).alias("ready"),
        F.coalesce("_waiting", F.lit(0)).alias("waiting"),
    )
