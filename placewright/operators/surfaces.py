"""Surfaces, footprints and regions from drawing records, as predicates where only points are asked."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import areas, graph, grid, planning, verify

FULL_CIRCLE = 350.0


# -- anchors and footprints -------------------------------------------------------------------


def tree_anchors(records: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(id, x, y) of trees: centres of circles and nearly full arcs, one per 0.01 cell.

    ``records`` are (id, kind, x, y, r, start, end); without any anchor the centroids of
    ``fallback`` (id, x, y) are taken.
    """
    whole = (F.col("kind") == "circle") | ((F.col("kind") == "arc") & ((G.arc_sweep(F.col("start"), F.col("end")) >= FULL_CIRCLE) | (F.col("start") == F.col("end") - 360)))
    found = verify.grid_first(records.filter(whole).select("id", "x", "y"), 0.01, "id")
    if fallback is None:
        return found
    return found.unionByName(fallback.select("id", "x", "y").filter(F.lit(found.isEmpty())))


def well_footprints(records: DataFrame) -> DataFrame:
    """Disks (x, y, r) of full circles, repeated ones once (to 1e-6)."""
    key = [F.round(c, 6).alias(c) for c in ("x", "y", "r")]
    return records.filter("kind = 'circle'").select(*key).distinct()


def ring_metrics(rings: DataFrame) -> DataFrame:
    """(region_id, area, perimeter, x1, y1, x2, y2) of outer rings (region_id, seq, x, y)."""
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    w = Window.partitionBy("region_id").orderBy("seq")
    df = rings.withColumn("nx", nxt("x")).withColumn("ny", nxt("y"))
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    return df.groupBy("region_id").agg(
        (F.abs(F.sum(cross)) / 2).alias("area"), F.sum(G.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))).alias("perimeter"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2")
    )


def context_buildings(metrics: DataFrame) -> DataFrame:
    """Footprints worth showing: area of at least 1 and not a sliver; with a height."""
    return metrics.filter("area >= 1 and 2 * area >= 0.10 * perimeter").withColumn("height", F.when(F.col("area") < 100, 3.0).otherwise(12.0))


def longest_part(parts: DataFrame) -> DataFrame:
    """Longest line part of each record (record, part, length)."""
    return parts.groupBy("record").agg(F.max_by("part", F.struct("length", -F.col("part"))).alias("part"), F.max("length").alias("length"))


# -- regions as predicates ---------------------------------------------------------------------------


def boundary_distance(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """(id, edge_distance): distance of each point to the nearest edge (x1..y2) within ``radius``."""
    hits = grid.point_segment_pairs(points.select("id", "x", "y"), edges.select("x1", "y1", "x2", "y2"), radius, max(radius, 1.0))
    return hits.groupBy("id").agg(F.min("distance").alias("edge_distance"))


def eroded(points: DataFrame, edges: DataFrame, by: float) -> DataFrame:
    """Points that lie at least ``by`` from every edge (erosion of a region that holds them)."""
    near = boundary_distance(points, edges, by).filter(F.col("edge_distance") < by)
    return points.join(near.select("id"), "id", "left_anti")


def safe_scope(points: DataFrame, zone_edges: DataFrame, footprint: float, trees: DataFrame, clearance: float, belts: DataFrame | None = None, physical: bool = False, ground_edges: DataFrame | None = None) -> DataFrame:
    """Points inside a zone where a plant of this footprint may stand.

    The zone's edge (or, for ``physical``, the ground's) is kept a footprint away,
    existing trees (rid, rx, ry) the clearance, belts (segments) a footprint.
    """
    edges = ground_edges if physical and ground_edges is not None else zone_edges
    out = eroded(points, edges, footprint) if footprint > 0 else points
    if clearance > 0:
        out = grid.semi_within(out, trees, clearance, anti=True)
    return eroded(out, belts, footprint) if belts is not None and footprint > 0 else out


def hedge_corridor(points: DataFrame, guide: DataFrame, width: float) -> DataFrame:
    """Points within half the width of a guide line, square at its ends."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    hits = grid.point_segment_pairs(points, guide, width / 2, max(width, 1.0))
    n = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = F.try_divide((F.col("x") - x1) * (x2 - x1) + (F.col("y") - y1) * (y2 - y1), n)
    return points.join(hits.filter(t.between(0, 1)).select("id").distinct(), "id", "left_semi")


def sidewalk_for_checks(reconstructed: DataFrame, raw: DataFrame, boundary: DataFrame, setback: float) -> DataFrame:
    """Reconstructed sidewalk edges with the raw ones near the work boundary."""
    mid = raw.withColumn("id", F.monotonically_increasing_id()).withColumn("x", (F.col("x1") + F.col("x2")) / 2).withColumn("y", (F.col("y1") + F.col("y2")) / 2)
    near = boundary_distance(mid, boundary, max(setback, 1e-9)).select("id")
    return reconstructed.select("x1", "y1", "x2", "y2").unionByName(mid.join(near, "id", "left_semi").select("x1", "y1", "x2", "y2")).distinct()


def surface_areas(records: DataFrame, wanted: Column, boundary: list[np.ndarray], least: float = 0.01) -> DataFrame:
    """(region_id, layer, class, area) of wanted surfaces inside the work boundary, slivers left out.

    ``records`` are ring vertices (region_id, layer, class, ring, seq, x, y); one region
    is one task's input, the boundary is one polygon.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = [g.sort_values("seq")[["x", "y"]].to_numpy(float) for _, g in pdf.groupby("ring")]
        area = areas.intersection_area(rings, boundary)
        first = pdf.iloc[0]
        rows = [(first["region_id"], first["layer"], first["class"], area)] if area >= least else []
        return pd.DataFrame(rows, columns=["region_id", "layer", "class", "area"]).astype({"region_id": "int64", "area": "float64"})

    return records.filter(wanted).groupBy("region_id").applyInPandas(run, "region_id long, layer string, class string, area double")


def base_area(rings: DataFrame) -> DataFrame:
    """Allowed area of each bed and its balance: base less all obstacles (see ``areas.overlay``)."""
    out = areas.overlay(rings)
    return out.withColumn("balance", F.col("base") - F.col("excluded") - F.col("allowed"))


def coverage_quality(rings: DataFrame) -> DataFrame:
    """(bed_id, reference, candidate, both, coverage, precision) of a candidate surface."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {role: [g.sort_values("seq")[["x", "y"]].to_numpy(float) for _, g in part.groupby("ring")] for role, part in pdf.groupby("role")}
        a, b = by.get("reference", []), by.get("candidate", [])
        ra, rb, both = areas.union_area(a) if a else 0.0, areas.union_area(b) if b else 0.0, areas.intersection_area(a, b) if a and b else 0.0
        return pd.DataFrame({"bed_id": [pdf["bed_id"].iloc[0]], "reference": [ra], "candidate": [rb], "both": [both], "coverage": [both / ra if ra else 0.0], "precision": [both / rb if rb else 0.0]})

    return rings.groupBy("bed_id").applyInPandas(run, "bed_id long, reference double, candidate double, both double, coverage double, precision double")


def reviewed_surface_faults(rings: DataFrame, boundary: list[np.ndarray], tolerance: float = 0.01) -> DataFrame:
    """(region_id, outside): reviewed surfaces that reach over the work boundary."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [g.sort_values("seq")[["x", "y"]].to_numpy(float) for _, g in pdf.groupby("ring")]
        return pd.DataFrame({"region_id": [pdf["region_id"].iloc[0]], "outside": [areas.difference_area(own, boundary)]})

    return rings.groupBy("region_id").applyInPandas(run, "region_id long, outside double").filter(F.col("outside") > tolerance)


# -- roads ------------------------------------------------------------------------------------------------


def road_cells(boundary: np.ndarray, curbs: np.ndarray, blocked: list[np.ndarray], seeds: list[np.ndarray], stitch: float = 0.30, cell: float = 0.25, least_seed: float = 0.5, low: float = 0.001, high: float = 0.65) -> dict:
    """Road area of one work area by flood fill on a raster of ``cell`` side.

    Cells within ``stitch`` of a curb are a barrier (so dashes up to twice that close),
    known non-road cells are blocked, and the connected faces that overlap the seeds by
    at least ``least_seed`` are the road, grown back over the barrier.  An area share
    outside [low, high] is an error.  The area is exact to about a cell along the edge.
    """
    x0, y0 = boundary.min(0)
    nx, ny = (np.ceil((boundary.max(0) - (x0, y0)) / cell).astype(int) + 1).tolist()
    cx, cy = np.meshgrid(x0 + (np.arange(nx) + 0.5) * cell, y0 + (np.arange(ny) + 0.5) * cell)

    def inside(ring: np.ndarray) -> np.ndarray:
        hit = np.zeros(cx.shape, bool)
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0)):
            if ay != by:
                hit ^= ((ay > cy) != (by > cy)) & (cx < (bx - ax) * (cy - ay) / (by - ay) + ax)
        return hit

    free = inside(boundary)
    whole = int(free.sum())
    for ring in blocked:
        free &= ~inside(ring)
    barrier = np.zeros(cx.shape, bool)
    for ax, ay, bx, by in curbs:
        i0, i1 = np.clip([int((min(ax, bx) - stitch - x0) / cell) - 1, int((max(ax, bx) + stitch - x0) / cell) + 2], 0, nx)
        j0, j1 = np.clip([int((min(ay, by) - stitch - y0) / cell) - 1, int((max(ay, by) + stitch - y0) / cell) + 2], 0, ny)
        px, py = cx[j0:j1, i0:i1], cy[j0:j1, i0:i1]
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = np.clip(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n, 0, 1) if n else 0.0
        barrier[j0:j1, i0:i1] |= np.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)) <= stitch
    open_ = free & ~barrier
    seed = np.zeros(cx.shape, bool)
    for ring in seeds:
        seed |= inside(ring)
    label = np.where(open_, np.arange(open_.size).reshape(open_.shape) + 1, 0)
    while True:  # least label of the four neighbours, with whole rows and columns at a time
        old = label.copy()
        for axis in (0, 1):
            for step in (1, -1):
                moved = np.roll(label, step, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if step == 1 else -1
                moved[tuple(edge)] = 0
                label = np.where(open_ & (moved > 0), np.minimum(label, moved), label)
        if (label == old).all():
            break
        top = np.concatenate([[0], label.reshape(-1)])
        label = np.where(open_, top[label], 0)
    names, overlap = np.unique(label[seed & open_], return_counts=True)
    road = np.isin(label, names[overlap * cell * cell >= least_seed])
    grow = road.copy()
    for _ in range(math.ceil(stitch / cell)):
        wide = grow.copy()
        for axis in (0, 1):
            for step in (1, -1):
                wide |= np.roll(grow, step, axis)
        grow = wide & free
    share = grow.sum() / max(whole, 1)
    if not low <= share <= high:
        raise ValueError(f"implausible area ratio {share:.4f}")
    return {"cells": grow, "area": float(grow.sum() * cell * cell), "share": float(share), "faces": int((overlap * cell * cell >= least_seed).sum()), "origin": (float(x0), float(y0)), "cell": cell}


def horizontal_spans(rings: list[np.ndarray], y: float) -> list[tuple[float, float]]:
    """Intervals in which a horizontal line meets a region (even-odd)."""
    xs = []
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0)):
            if (ay > y) != (by > y):
                xs.append(ax + (y - ay) * (bx - ax) / (by - ay))
    xs.sort()
    return list(zip(xs[::2], xs[1::2]))


def corridor(parcels: DataFrame, max_gap: float = 25.0, narrow: float = 15.0, wide: float = 25.0) -> DataFrame:
    """Continue a road through aligned parcels of one street, bottom to top.

    ``parcels`` are (street, miny, maxy, centre, width, seeded): a seeded parcel sets
    centre and width; an unseeded one that follows within the gap inherits them.  The
    carried state makes this a scan of each street, whose parcels are one task's input.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top = centre = width = None
        rows = []
        for p in pdf.sort_values("miny").itertuples():
            if p.seeded:
                top, centre, width = p.maxy, p.centre, min(wide, max(narrow, 1.4 * p.width))
                rows.append((p.street, p.miny, p.maxy, centre, width, "seeded"))
            elif top is not None and 0 <= p.miny - top <= max_gap:
                rows.append((p.street, p.miny, p.maxy, centre, width, "continued"))
                top = p.maxy
            else:
                top = centre = width = None
                rows.append((p.street, p.miny, p.maxy, None, None, "open"))
        return pd.DataFrame(rows, columns=["street", "miny", "maxy", "centre", "width", "state"])

    return parcels.groupBy("street").applyInPandas(run, "street long, miny double, maxy double, centre double, width double, state string")


# -- dashed chambers ----------------------------------------------------------------------------------------


def _dash_runs(strokes: DataFrame, offset: str, low: str, high: str) -> DataFrame:
    """Runs of collinear strokes of each (well, bucket): offset groups, then chunks along the axis."""
    key = ["well", "bucket"]
    w = Window.partitionBy(*key).orderBy(offset, low)
    step = F.when(F.col(offset) - F.lag(offset).over(w) > 0.22, 1).otherwise(0)
    rows = strokes.withColumn("_s", step).withColumn("line", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = verify.runs(rows.select(*key, "line", offset, low, high, "length"), [*key, "line"], low, high, 1.0)
    own = rows.join(runs.select(*key, "line", "run", "lo", "hi"), [*key, "line"]).filter((F.col(low) >= F.col("lo")) & (F.col(high) <= F.col("hi")))
    out = own.groupBy(*key, "line", "run", "lo", "hi").agg(
        F.sum("length").alias("support"), (F.sum(F.col(offset) * F.col("length")) / F.sum("length")).alias("at"), F.collect_list(F.struct(F.col(low).alias("lo"), F.col(high).alias("hi"))).alias("dashes")
    )
    return out.filter((F.col("support") >= 0.7) & (F.col("hi") - F.col("lo") >= 1.2)).withColumn("run_id", F.xxhash64("line", "run"))


def dashed_chambers(lines: DataFrame, wells: DataFrame, reach: float = 14.0) -> DataFrame:
    """(well, x1, y1, x2, y2, score): rectangles of dashed sides beside wells, best ones kept.

    Strokes of 0.3 to 1.3 near a well are turned into the frame of their direction; two
    parallel and two cross runs, 2 to 15 apart, aspect to 2.2, of which each covers 0.3
    of its side and all together 2, are a chamber; overlapping ones go by score.  Boxes
    are given in the turned frame of their bucket (column bucket, degrees).
    """
    length = graph.length_of()
    strokes = lines.withColumn("length", length).filter(F.col("length").between(0.3, 1.3))
    strokes = strokes.withColumn("x", (F.col("x1") + F.col("x2")) / 2).withColumn("y", (F.col("y1") + F.col("y2")) / 2)
    angle = F.pmod(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))), F.lit(180.0))
    near = grid.point_pairs(strokes.withColumn("angle", angle), wells.select(F.col("well"), F.col("x").alias("rx"), F.col("y").alias("ry")), reach * math.sqrt(2))
    bucket = F.pmod(F.floor(F.col("angle") / 5 + 0.5) * 5, F.lit(90)).cast("int")
    near = near.withColumn("bucket", bucket)
    r = F.radians(F.col("bucket").cast("double"))
    u = lambda a, b: F.col(a) * F.cos(r) + F.col(b) * F.sin(r)
    v = lambda a, b: F.col(b) * F.cos(r) - F.col(a) * F.sin(r)
    near = near.withColumn("ua", u("x1", "y1")).withColumn("ub", u("x2", "y2")).withColumn("va", v("x1", "y1")).withColumn("vb", v("x2", "y2"))
    along = G.undirected_angle(F.col("angle"), F.col("bucket").cast("double")) <= 45
    flat = near.filter(along).select("well", "bucket", "length", F.least("ua", "ub").alias("lo_"), F.greatest("ua", "ub").alias("hi_"), ((F.col("va") + F.col("vb")) / 2).alias("off"))
    tall = near.filter(~along).select("well", "bucket", "length", F.least("va", "vb").alias("lo_"), F.greatest("va", "vb").alias("hi_"), ((F.col("ua") + F.col("ub")) / 2).alias("off"))
    h, k = _dash_runs(flat, "off", "lo_", "hi_"), _dash_runs(tall, "off", "lo_", "hi_")

    def two(runs: DataFrame, p: str) -> DataFrame:
        side = lambda q: runs.select("well", "bucket", F.col("at").alias(q + "at"), F.col("dashes").alias(q + "d"), F.col("run_id").alias(q + "id"))
        a, b = side(p + "1"), side(p + "2")
        gap = F.col(p + "2at") - F.col(p + "1at")
        return a.join(b, ["well", "bucket"]).filter(gap.between(2, 15))

    both = two(h, "h").join(two(k, "k"), ["well", "bucket"])
    w_, h_ = F.col("k2at") - F.col("k1at"), F.col("h2at") - F.col("h1at")
    both = both.filter(F.greatest(w_, h_) <= 2.2 * F.least(w_, h_))
    cover = [G.interval_coverage(F.col(s + "d"), F.col(a), F.col(b)) for s, a, b in (("h1", "k1at", "k2at"), ("h2", "k1at", "k2at"), ("k1", "h1at", "h2at"), ("k2", "h1at", "h2at"))]
    both = both.withColumn("least", F.least(*cover)).withColumn("score", sum(cover[1:], cover[0])).filter("least >= 0.3 and score >= 2.0")
    boxes = both.select("well", "bucket", F.col("k1at").alias("x1"), F.col("h1at").alias("y1"), F.col("k2at").alias("x2"), F.col("h2at").alias("y2"), "score")
    boxes = boxes.withColumn("id", F.xxhash64("well", "bucket", "x1", "y1", "x2", "y2"))
    boxes = graph._checkpoint(boxes)
    kept = planning.suppress(boxes.select("id", "score", "x1", "y1", "x2", "y2"))
    return boxes.join(kept.select("id"), "id", "left_semi").drop("id")


# -- arrow tips and diagnostic candidates --------------------------------------------------------------------


def arrow_tips(polylines: DataFrame, strokes: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """(x, y): middles of three-vertex Vs of 0.75 to 1.30, and meetings of two short strokes at 20-100 degrees."""
    p = F.col("pts")
    leg = lambda a, b: G.distance(p[a]["x"], p[a]["y"], p[b]["x"], p[b]["y"])
    vs = polylines.filter((F.size(p) == 3) & leg(0, 1).between(0.75, 1.30) & leg(1, 2).between(0.75, 1.30)).select(p[1]["x"].alias("x"), p[1]["y"].alias("y"))
    pairs = graph._node_pairs(strokes.filter(graph.length_of().between(0.75, 1.30)), tolerance).filter(F.col("angle").between(20, 100))
    return vs.unionByName(pairs.select((F.col("kx") * F.lit(tolerance)).alias("x"), (F.col("ky") * F.lit(tolerance)).alias("y"))).distinct()


def round_robin(candidates: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """Up to ``limit`` candidates, one of each group in turn (a report's diagnostic sample)."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return candidates.withColumn("_turn", n).orderBy("_turn", group).limit(limit).drop("_turn")


def clip_lines(lines: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Segments clipped to a box; what lies outside is left out (parametric clipping)."""
    ax, ay, bx, by = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    dx, dy = bx - ax, by - ay
    lo, hi = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for p, q in ((-dx, ax - x1), (dx, F.lit(x2) - ax), (-dy, ay - y1), (dy, F.lit(y2) - ay)):
        t = F.try_divide(q, p)
        outside = outside | ((p == 0) & (q < 0))
        lo = F.when(p < 0, F.greatest(lo, t)).otherwise(lo)
        hi = F.when(p > 0, F.least(hi, t)).otherwise(hi)
    df = lines.withColumn("_lo", lo).withColumn("_hi", hi).filter(~outside & (F.col("_lo") < F.col("_hi")))
    at = lambda a, d, t: a + d * F.col(t)
    rest = [c for c in lines.columns if c not in ("x1", "y1", "x2", "y2")]
    return df.select(*rest, at(ax, dx, "_lo").alias("x1"), at(ay, dy, "_lo").alias("y1"), at(ax, dx, "_hi").alias("x2"), at(ay, dy, "_hi").alias("y2"))
