"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: hang the neighbours of every node on its least neighbour.

    The least neighbour is a combinable aggregate; its join back to the edges is
    an equi-join that adaptive execution can split where one node has most edges.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that has an edge; the label is its least member.

    ``edges`` has two long columns; loops and repeated edges are allowed.  The
    number of rounds grows with the logarithm of the longest chain.
    """
    now = stash(edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        now = stash(_star(_star(now, True), False), "edges")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == mark:
            break
        mark = state
    members = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return members.unionByName(roots)
