"""Groups of linked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the vertices of edges (u, v) and the least vertex that each is linked to.

    Least labels spread along edges and then along labels (pointer jumping), so
    long chains take a logarithmic number of rounds.
    """
    pairs = edges.where("u is not null and v is not null").select("u", "v")
    both = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).select(F.col("u").alias("id"), "root"))
    while True:
        near = both.join(label, both["v"] == label["id"]).groupBy("u").agg(F.min("root").alias("best"))
        spread = label.join(near, label["id"] == near["u"]).select("id", F.col("root").alias("old"), F.least("root", "best").alias("root"))
        hop = spread.alias("a").join(label.alias("b"), F.col("a.root") == F.col("b.id"))
        new = materialize(hop.select(F.col("a.id").alias("id"), F.col("a.old").alias("old"), F.least("a.root", "b.root").alias("root")))
        label = new.select("id", "root")
        if new.where("old != root").isEmpty():
            return label
