"""Connected components by alternating large-star and small-star contraction.

Every round is a few joins and aggregations on the edge table; nothing is gathered on the driver but
two numbers a round. A hub is pre-aggregated where it is grouped and can be split where it is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, save


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a").where("b > a")
    return joined.select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have a < b: what b is linked to below it is linked to the least of that."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    linked = edges.join(least, "b")
    return linked.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(linked.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) for every end of an edge (a, b); the component is its smallest id."""
    spark = edges.sparkSession
    current = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    current, path = save(current, "edges")
    state = None
    for _ in range(max_rounds):
        following, new_path = save(_small_star(_large_star(current)), "edges")
        count, mark = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(spark, path)
        current, path = following, new_path
        if (count, mark) == state:
            break
        state = (count, mark)
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = current.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return roots.unionByName(current.select(F.col("b").alias("id"), F.col("a").alias("component")))
