"""Connected components of a table of links, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage, unstage


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that ``node`` reaches.

    ``links`` has long columns u and v.  Nodes whose root is themselves have no
    row.  Alternates two steps until nothing changes, each a group and a join:
    a node's larger neighbours are tied to its smallest, then its smaller ones.
    Every round ties nodes to smaller ones or changes nothing, so it ends.  Each
    is staged, so the lineage stays short and only a count and a checksum reach
    the driver.  No links give an empty table.
    """
    edges = stage(
        links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = _mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = stage(small, "edges")
        unstage(edges)
        edges, now = after, _mark(after)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
