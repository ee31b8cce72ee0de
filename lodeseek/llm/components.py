"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def components(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(node, root) for every node in ``links`` (a long, b long); ``root`` is the smallest node of the component.

    Every step moves each link's end to the least neighbour, first from larger,
    then from smaller neighbours, and keeps one row a node at least, so the
    table never grows; the number of steps is logarithmic in practice. Only the
    table's size and checksum reach the driver. A link from a node to itself
    gives that node as its own root; nulls are left out; no links, no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null").distinct()
    edges, before, step = work.keep(edges, f"{name}_0"), None, 0
    # Minima are dealt out between aggregation and join, so that Spark can split the join at the root of a large component.
    while True:
        checksum = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(checksum) == before:
            break
        before, step = tuple(checksum), step + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).hint("rebalance")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(edges.where("u = v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = work.keep(small.distinct(), f"{name}_{step}")
        work.drop(f"{name}_{step - 1}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
