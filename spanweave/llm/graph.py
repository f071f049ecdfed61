"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a map-side combined minimum and an equi-join, so a hub with very many edges
is never gathered in one task; the number of steps grows with the logarithm of the longest
path.  Edges live in staged tables, never on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges` (u, v: long, not null, either direction).

    component is the smallest node that can be reached.  Self loops and repeated edges are
    allowed; an edge with a null end is ignored; no edges give no rows.
    """
    both = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = staged(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        # large star: each larger neighbour is tied to the smallest of the neighbourhood
        ring = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minima(ring).select("u", F.least("u", "m").alias("m"))
        large = ring.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours and the node itself are tied to the smallest one
        low = _minima(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        now = staged(small.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
