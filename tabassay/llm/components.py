"""Connected components of links that stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm.tables import cut

#: Links that are one task, and the least number of tasks.
TASK_LINKS, LEAST_TASKS = 100_000, 8


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), "m")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), "m")
    return moved.union(least.select("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node it is linked with, of every linked node.

    ``links`` has two columns of comparable ids; nulls, repeated links, either
    direction and links to oneself are allowed. Alternates star contractions, each a
    group-by and a join, until the links are stars; every round is cut. Few links lie in
    few tasks, however many partitions a shuffle has, so that rounds leave few small files.
    """
    edges = links.toDF("a", "b").filter("a != b")
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut(edges.distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 2**31)).first()
        if tuple(state) == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = tuple(state)
        tasks = max(LEAST_TASKS, -(-state[0] // TASK_LINKS))
        large = _large_star(edges.coalesce(tasks)).toDF("u", "v").coalesce(tasks).distinct()
        small = _small_star(large.coalesce(tasks)).toDF("u", "v").coalesce(tasks).distinct()
        edges = cut(small.coalesce(tasks))
