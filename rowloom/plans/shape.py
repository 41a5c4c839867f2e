"""Two ways to shape a plan that Catalyst doesn't find by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, *cols: Column | str) -> DataFrame:
    """The columns, computed once. Rules that merge projections or move filters copy an expression
    into every place that names it; they don't move anything past a generator."""
    return df.select(F.inline(F.array(F.struct(*cols))))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has fewer partitions than there are cores: a file too small to be
    split, or one that can't be. Larger inputs stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
