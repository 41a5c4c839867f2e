"""Connected components of an edge table by alternating large and small stars.

Every round is two shuffles of the edges; what is left after O(log n) rounds is
one star a component, whose centre is its least vertex. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    leaves = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return leaves.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root): every vertex of the edges and the least vertex of its component.

    edges: columns u and v of one orderable type. Null ends, loops and repeated
    edges are ignored; with no edges the result is empty.
    """
    clean = edges.where("u is not null and v is not null and u != v")
    stars = cut(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    kind: T.DataType = stars.schema["u"].dataType
    before = None
    while True:
        # Each is a fixed point of the other once every component is a star.
        stars = cut(_small_star(_large_star(stars)))
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = stars.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots).select(
        F.col("id").cast(kind).alias("id"), F.col("root").cast(kind).alias("root")
    )
