"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step joins edges with the least neighbour of a node; every round is written to the shared folder. A node with very
many edges makes no large group: least neighbours are partial aggregates, and the join back is a sort-merge join whose
large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import materialize, release

ROUNDS = 60
#: Edges of a written file at least, so that a small table is not hundreds of files.
FILE_ROWS = 250_000


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): every node that has an edge to another, with the least node of its component (node, comp)."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    known = _digest(now)
    for _ in range(ROUNDS):
        # large star: neighbours above a node join its least neighbour
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("low")).withColumn("low", F.least("low", "v"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("low").alias("u")).distinct()
        # small star: neighbours below a node, and itself, join the least of them
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        moved = large.join(low, "v")
        small = moved.where("u <> low").select(F.col("u").alias("v"), F.col("low").alias("u")).unionByName(low.select("v", F.col("low").alias("u")))
        # a round never has more edges than twice those of the one before
        after = materialize(small.where("v <> u").distinct().coalesce(1 + 2 * known[0] // FILE_ROWS), "edges")
        if (seen := _digest(after)) == known:
            release(now)
            break
        release(now)
        now, known = after, seen
    else:
        raise RuntimeError("components did not settle")
    nodes = after.select(F.col("v").alias("node"), F.col("u").alias("comp"))
    return nodes.unionByName(after.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge table without repeats."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v", F.lit(3)).cast("decimal(38,0)"))).first())
