"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is two joins with a table of minima that has one row for each node, and two distinct unions; a node with very
many links is a skewed join key with one row on the other side, which adaptive execution splits. Each round is written to
the shared folder. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import materialize


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b); component is the smallest node reachable."""
    a, b = links.columns[:2]
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = materialize(edges, "cc-edges")
    before = _digest(edges)
    while True:
        # large star: each node's larger neighbours go to its least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        # small star: each node's smaller neighbours, and itself, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "cc-edges")
        if (now := _digest(edges)) == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
