"""Connected components of an edge table, by alternating large-star and
small-star steps: each is a grouped minimum joined back to the edges, so no
group is gathered in one place, and few rounds suffice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 100) -> DataFrame:
    """(id, component): for every id of an edge that isn't its component's
    smallest, that smallest id. Loops and repeated edges do no harm; ids
    without an edge don't appear; an empty table gives an empty one."""
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, state = materialize(now), None
    for _ in range(most):
        after = materialize(_small(_large(now)))
        r = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(r) == state:
            break
        now, state = after, tuple(r)
    return after.select(F.col("u").alias("id"), F.col("v").alias("component"))
