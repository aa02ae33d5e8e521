"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebed.session import Scratch


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component of each node with an edge to another: component is the least node that it is linked to, itself included.

    Edges are turned in alternation to the least neighbour of the greater and of the smaller nodes until nothing moves, which
    takes about as many rounds as the diameter has binary digits. A hub's neighbours are never gathered: their least comes from a pre-aggregated
    minimum and is joined back. Edges with a null end and of a node with itself are ignored; no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = scratch.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        turned = scratch.keep(small.distinct(), "small")
        before, mark = mark, _mark(turned)
        scratch.drop(large)
        scratch.drop(now)
        now = turned
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and hash sum of the edges: equal as long as the edges are."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first())
