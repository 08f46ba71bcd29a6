"""Distance joins by grid cells: an equi-join on the cell with the distance as residual.

The side that is exploded to several cells is the one with extent (segments) or
the smaller one; the join stays a hash or sort-merge join that adaptive execution
can split where one cell holds many rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def with_cell(points: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return points.withColumn("cx", G.cell(F.col(x), size)).withColumn("cy", G.cell(F.col(y), size))


def around(df: DataFrame, low_x: Column, high_x: Column, low_y: Column, high_y: Column, size: float) -> DataFrame:
    """One row per cell that the box [low, high] touches."""
    xs = F.sequence(G.cell(low_x, size), G.cell(high_x, size))
    ys = F.sequence(G.cell(low_y, size), G.cell(high_y, size))
    return df.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def shuffled(df: DataFrame) -> DataFrame:
    """Rows whose number Spark's estimates do not see (exploded cells, checkpoints, joins): never broadcast."""
    return df.hint("merge")


def point_pairs(left: DataFrame, right: DataFrame, radius: float, strict: bool = False, on: Column | None = None) -> DataFrame:
    """Rows of ``left`` (id, x, y, ...) and ``right`` (rid, rx, ry, ...) within ``radius``."""
    probe = around(left, F.col("x") - radius, F.col("x") + radius, F.col("y") - radius, F.col("y") + radius, radius)
    build = with_cell(right, radius, "rx", "ry")
    d = G.distance(F.col("x"), F.col("y"), F.col("rx"), F.col("ry"))
    near = (d < radius) if strict else (d <= radius)
    if on is not None:
        near = near & on
    return probe.join(shuffled(build), ["cx", "cy"]).withColumn("distance", d).filter(near).drop("cx", "cy")


def self_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Unordered pairs of points within ``radius``: a_* is the lesser id."""
    left = points.select(*(F.col(c).alias("a_" + c) for c in points.columns), F.col("x"), F.col("y"))
    right = points.select(*(F.col(c).alias("b_" + c) for c in points.columns), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return point_pairs(left, right, radius).filter("a_id < b_id").drop("x", "y", "rx", "ry")


def point_segment_pairs(points: DataFrame, segments: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """Points (x, y, ...) with segments (x1, y1, x2, y2, ...) within ``radius``."""
    size = cell or max(radius, 1e-6)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    build = around(segments, F.least(x1, x2) - radius, F.greatest(x1, x2) + radius, F.least(y1, y2) - radius, F.greatest(y1, y2) + radius, size)
    d = G.point_segment_distance(F.col("x"), F.col("y"), x1, y1, x2, y2)
    return with_cell(points, size).join(shuffled(build), ["cx", "cy"]).withColumn("distance", d).filter(F.col("distance") <= radius).drop("cx", "cy")


def semi_within(points: DataFrame, others: DataFrame, radius: float, anti: bool = False, extra: Callable[[], Column] | None = None) -> DataFrame:
    """Points (id, x, y) that have (or, for ``anti``, lack) one of ``others`` (rid, rx, ry) within ``radius``."""
    build = around(others, F.col("rx") - radius, F.col("rx") + radius, F.col("ry") - radius, F.col("ry") + radius, radius)
    probe = with_cell(points, radius).alias("p")
    build = build.alias("o")
    on = (F.col("p.cx") == F.col("o.cx")) & (F.col("p.cy") == F.col("o.cy")) & (G.distance(F.col("p.x"), F.col("p.y"), F.col("o.rx"), F.col("o.ry")) <= radius)
    if extra is not None:
        on = on & extra()
    return probe.join(shuffled(build), on, "left_anti" if anti else "left_semi").select(*(F.col(c) for c in points.columns))


def nearest_per_key(points: DataFrame, others: DataFrame, radius: float, key: str = "key", order: str = "rid") -> DataFrame:
    """For each point and key the nearest of ``others`` within ``radius``; ties by ``order``.

    What is found within a small radius is the nearest; only points that lack a key
    there are looked at again, with that key, in a wider one.
    """
    from . import graph

    keys = others.select(key).distinct()
    wanted = graph._checkpoint(points.crossJoin(keys.withColumnRenamed(key, "_key")))
    found = None
    for share in (64, 16, 4, 1):
        pairs = point_pairs(wanted, others, radius / share, on=F.col("_key").eqNullSafe(F.col(key))).drop("_key")
        first = F.min(F.struct("distance", order, F.struct(*(c for c in pairs.columns if c not in ("distance", order))).alias("rest"))).alias("best")
        best = pairs.groupBy(F.col("id").alias("_id"), F.col(key).alias("_of")).agg(first)
        now = best.select("best.rest.*", "best.distance", f"best.{order}").select(*pairs.columns)
        if share > 1:
            now = graph._checkpoint(now)
            gone = now.select(F.col("id").alias("_id"), F.col(key).alias("_of"))
            wanted = graph._checkpoint(wanted.join(shuffled(gone), (F.col("id") == F.col("_id")) & F.col("_key").eqNullSafe(F.col("_of")), "left_anti"))
        found = now if found is None else found.unionByName(now)
    return found


def spacing_failures(points: DataFrame, spacing: str = "spacing", footprint: str = "footprint", bound: float | None = None) -> DataFrame:
    """Pairs of one type (column kind) that stand closer than their profiles ask.

    The search radius is the largest requirement of all points, one scalar.
    """
    if bound is None:
        top = points.agg(F.max(F.greatest(spacing, F.col(footprint) * 2))).first()[0]
        bound = float(top or 0.0)
    if bound <= 0:
        bound = 1e-9
    required = F.greatest(F.col("a_" + spacing), F.col("b_" + spacing), F.col("a_" + footprint) + F.col("b_" + footprint))
    pairs = self_pairs(points.filter(~F.isnan("x") & ~F.isnan("y")), bound).filter("a_kind = b_kind")
    return pairs.withColumn("required", required).filter(F.col("distance") + 1e-7 < F.col("required"))
