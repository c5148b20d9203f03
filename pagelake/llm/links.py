"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node hooks its larger (or smaller) neighbours to the least node it knows."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where(F.col("b") < F.col("a"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = near.where(F.col("b") > F.col("a")) if large else near
    hooked = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        hooked = hooked.unionByName(least.select("a", F.col("m").alias("b")))
    return hooked.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Alternates large-star and small-star steps (Kiveris and others, 2014); the number of rounds follows the
    logarithm of the graph's size.  Each round is written to the shared checkpoint folder, which cuts the lineage."""
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    while True:
        mark = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
        if not mark["n"]:
            break
        current = materialize(_star(_star(current, True), False), "edges")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
