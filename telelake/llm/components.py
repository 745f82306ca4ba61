"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telelake.llm.rows import store


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root): every node of ``edges`` and the smallest node it reaches.

    Alternating large-star and small-star steps: each step replaces the links of a node by
    links to the smallest neighbour, so the number of links never grows, and links of a
    hub are dealt over all tasks by their other end. The state is a written table after
    each round; only its checksum reaches the driver. Null ends are passed over.
    """
    links = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    links = store(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    before = None
    while True:
        links = store(_small_star(_large_star(links)), "links")
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)")).alias("sum")
        ).first()
        if state == before:
            break
        before = state
    # Every link now leads from a node to its root.
    return links.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(
        links.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node's whole circle."""
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("least"))
    moved = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("least").alias("y"))
    return moved.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = links.groupBy("x").agg(F.min("y").alias("least"))
    moved = links.join(least, "x").where("y <> least").select(F.col("y").alias("x"), F.col("least").alias("y"))
    own = least.select("x", F.col("least").alias("y"))
    return moved.unionByName(own).distinct()
