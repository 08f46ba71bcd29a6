"""Scalar geometry as Column expressions (no Python on the executors).

Angles are in degrees where a name says so.  A line is ``array<struct<x,y>>``;
an affine matrix is ``struct<a,b,c,d,tx,ty>`` with x' = a x + c y + tx and
y' = b x + d y + ty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
MAX_LATITUDE = 85.05112877980659


def lit(v: float) -> Column:
    return F.lit(float(v))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


# -- affine matrices -------------------------------------------------------------


def matrix(a: Column, b: Column, c: Column, d: Column, tx: Column, ty: Column) -> Column:
    return F.struct(*(v.cast("double").alias(n) for n, v in zip("a b c d tx ty".split(), (a, b, c, d, tx, ty))))


def insert_matrix(x: Column, y: Column, sx: Column, sy: Column, rotation_deg: Column) -> Column:
    """Translate, rotate, scale: the matrix of a block insert."""
    r = F.radians(rotation_deg)
    return matrix(F.cos(r) * sx, F.sin(r) * sx, -F.sin(r) * sy, F.cos(r) * sy, x, y)


def compose(p: Column, c: Column) -> Column:
    """Parent after child."""
    return matrix(
        p["a"] * c["a"] + p["c"] * c["b"],
        p["b"] * c["a"] + p["d"] * c["b"],
        p["a"] * c["c"] + p["c"] * c["d"],
        p["b"] * c["c"] + p["d"] * c["d"],
        p["a"] * c["tx"] + p["c"] * c["ty"] + p["tx"],
        p["b"] * c["tx"] + p["d"] * c["ty"] + p["ty"],
    )


def apply_matrix(m: Column, x: Column, y: Column) -> Column:
    return point(m["a"] * x + m["c"] * y + m["tx"], m["b"] * x + m["d"] * y + m["ty"])


def apply_vector(m: Column, x: Column, y: Column) -> Column:
    """Linear part only."""
    return point(m["a"] * x + m["c"] * y, m["b"] * x + m["d"] * y)


def radius_scale(m: Column) -> Column:
    return F.sqrt(F.abs(m["a"] * m["d"] - m["b"] * m["c"]))


# -- distances, vectors, angles ----------------------------------------------------


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def unit_vector(dx: Column, dy: Column) -> Column:
    n = F.sqrt(dx * dx + dy * dy)
    return F.when(n > 0, point(dx / n, dy / n)).otherwise(point(lit(0), lit(0)))


def angle_deg(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two unit vectors, cosine clamped."""
    return F.degrees(F.acos(F.greatest(lit(-1), F.least(lit(1), dot(ax, ay, bx, by)))))


def vector_angle_deg(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between any two vectors; NaN if one is zero."""
    n = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(F.degrees(F.acos(F.greatest(lit(-1), F.least(lit(1), dot(ax, ay, bx, by) / n)))))


def undirected_angle(left: Column, right: Column) -> Column:
    """Difference of two directions modulo 180."""
    d = F.pmod(F.abs(left - right), lit(180))
    return F.least(d, lit(180) - d)


def projection_share(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Place of the nearest point on a segment, 0 to 1."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    return F.when(n == 0, lit(0)).otherwise(F.greatest(lit(0), F.least(lit(1), ((px - x1) * dx + (py - y1) * dy) / n)))


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    t = projection_share(px, py, x1, y1, x2, y2)
    return distance(px, py, x1 + t * (x2 - x1), y1 + t * (y2 - y1))


def ray_error(ox: Column, oy: Column, dx: Column, dy: Column, tx: Column, ty: Column) -> Column:
    """struct(angle, lateral, distance) of a target against a ray; infinite behind it."""
    vx, vy = tx - ox, ty - oy
    along = dot(vx, vy, dx, dy)
    far = F.sqrt(vx * vx + vy * vy)
    inf = F.lit(float("inf"))
    ahead = (along > 0) & (far > 0)
    return F.struct(
        F.when(ahead, F.degrees(F.acos(F.greatest(lit(-1), F.least(lit(1), F.try_divide(along, far)))))).otherwise(inf).alias("angle"),
        F.when(ahead, F.abs(vx * dy - vy * dx)).otherwise(inf).alias("lateral"),
        far.alias("distance"),
    )


def snap(value: Column, tolerance: float) -> Column:
    """Grid key of a coordinate; ties go up (not to even)."""
    return F.floor(value / lit(tolerance) + lit(0.5)).cast("long")


def cell(value: Column, size: float | Column) -> Column:
    return F.floor(value / (size if isinstance(size, Column) else lit(size))).cast("long")


# -- curves and lines ---------------------------------------------------------------


def arc_sweep(start_deg: Column, end_deg: Column) -> Column:
    return F.pmod(end_deg - start_deg, lit(360))


def _steps(length: Column, tolerance: float, low: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(720), F.ceil(length / lit(tolerance)).cast("int")))


def arc_points(cx: Column, cy: Column, r: Column, start_deg: Column, end_deg: Column, tolerance: float) -> Column:
    """Chords of an arc; the sweep goes on through 360."""
    sweep = end_deg - start_deg + F.when(end_deg < start_deg, lit(360)).otherwise(lit(0))
    n = _steps(r * F.radians(sweep), tolerance, 8)
    at = lambda i: F.radians(start_deg + sweep * i / n)
    return F.transform(F.sequence(F.lit(0), n), lambda i: point(cx + r * F.cos(at(i)), cy + r * F.sin(at(i))))


def ellipse_points(cx: Column, cy: Column, mx: Column, my: Column, ratio: Column, start: Column, end: Column, tolerance: float) -> Column:
    """Chords of an elliptic arc: (mx, my) is the major half axis, angles in radians."""
    full = lit(2 * math.pi)
    sweep = F.when(end <= start, end - start + full).otherwise(end - start)
    n = _steps(F.sqrt(mx * mx + my * my) * sweep, tolerance, 12)
    at = lambda i: start + sweep * i / n
    return F.transform(
        F.sequence(F.lit(0), n),
        lambda i: point(cx + mx * F.cos(at(i)) - my * ratio * F.sin(at(i)), cy + my * F.cos(at(i)) + mx * ratio * F.sin(at(i))),
    )


def line_length(points: Column) -> Column:
    n = F.size(points)
    parts = F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda p, q: distance(p["x"], p["y"], q["x"], q["y"]))
    return F.when(n < 2, lit(0)).otherwise(F.aggregate(parts, lit(0), lambda s, x: s + x))


def _extreme(points: Column, axis: str, fn) -> Column:
    return fn(F.transform(points, lambda p: p[axis]))


def span(points: Column) -> Column:
    """Diagonal of the bounding box."""
    w = _extreme(points, "x", F.array_max) - _extreme(points, "x", F.array_min)
    h = _extreme(points, "y", F.array_max) - _extreme(points, "y", F.array_min)
    return F.sqrt(w * w + h * h)


def chord(points: Column) -> Column:
    a, b = points[0], F.element_at(points, -1)
    return distance(a["x"], a["y"], b["x"], b["y"])


def straightness(points: Column) -> Column:
    n = line_length(points)
    return F.when(n > 0, chord(points) / n).otherwise(lit(0))


def centroid(points: Column) -> Column:
    n = F.size(points)
    mean = lambda axis: F.aggregate(points, lit(0), lambda s, p: s + p[axis]) / n
    return point(mean("x"), mean("y"))


def outward_vector(points: Column, at_start: bool) -> Column:
    """Direction that leaves the line at one end: from its first differing neighbour to the end's far side."""
    seq = points if at_start else F.reverse(points)
    origin = seq[0]
    far = F.filter(seq, lambda p: distance(p["x"], p["y"], origin["x"], origin["y"]) > lit(1e-9))
    return F.when(F.size(far) > 0, unit_vector(far[0]["x"] - origin["x"], far[0]["y"] - origin["y"])).otherwise(point(lit(0), lit(0)))


def chord_vector(points: Column) -> Column:
    a, b = points[0], F.element_at(points, -1)
    return unit_vector(b["x"] - a["x"], b["y"] - a["y"])


def is_compact_ring(points: Column, max_span: float) -> Column:
    a, b = points[0], F.element_at(points, -1)
    return (F.size(points) >= 4) & (a["x"] == b["x"]) & (a["y"] == b["y"]) & (span(points) <= lit(max_span))


def ring_area(points: Column) -> Column:
    """Unsigned area of a ring given by its vertices (closed or not)."""
    n = F.size(points)
    nxt = F.concat(F.slice(points, 2, n), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), lit(0), lambda s, v: s + v)) / lit(2)


def crosses_upward(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray to the right of the point crosses an edge (even-odd rule)."""
    return ((y1 > py) != (y2 > py)) & F.coalesce(px < F.try_divide((x2 - x1) * (py - y1), y2 - y1) + x1, F.lit(False))


def in_ring(px: Column, py: Column, points: Column) -> Column:
    n = F.size(points)
    nxt = F.concat(F.slice(points, 2, n), F.slice(points, 1, 1))
    hits = F.zip_with(points, nxt, lambda p, q: F.coalesce(crosses_upward(px, py, p["x"], p["y"], q["x"], q["y"]), F.lit(False)).cast("int"))
    return F.aggregate(hits, F.lit(0), lambda s, v: s + v) % 2 == 1


def interval_coverage(intervals: Column, start: Column, end: Column) -> Column:
    """Share of [start, end] that a union of struct(lo, hi) covers."""
    clipped = F.array_sort(F.filter(F.transform(intervals, lambda i: F.struct(F.greatest(i["lo"], start).alias("lo"), F.least(i["hi"], end).alias("hi"))), lambda i: i["hi"] > i["lo"]))
    state = F.aggregate(
        clipped,
        F.struct(lit(0).alias("sum"), start.cast("double").alias("at")),
        lambda s, i: F.struct((s["sum"] + F.greatest(lit(0), i["hi"] - F.greatest(i["lo"], s["at"]))).alias("sum"), F.greatest(s["at"], i["hi"]).alias("at")),
    )
    return F.when(end > start, state["sum"] / (end - start)).otherwise(lit(0))


# -- map projection --------------------------------------------------------------------


def wgs84_to_mercator(lon: Column, lat: Column) -> Column:
    lat = F.greatest(lit(-MAX_LATITUDE), F.least(lit(MAX_LATITUDE), lat))
    return point(lit(RADIUS) * F.radians(lon), lit(RADIUS) * F.log(F.tan(lit(math.pi / 4) + F.radians(lat) / 2)))


def mercator_to_wgs84(x: Column, y: Column) -> Column:
    return point(F.degrees(x / lit(RADIUS)), F.degrees(lit(2) * F.atan(F.exp(y / lit(RADIUS))) - lit(math.pi / 2)))


def local_to_mercator(x: Column, y: Column, m: tuple[float, float, float, float], offset: tuple[float, float]) -> Column:
    """``m`` is the row-major 2 x 2 matrix."""
    return point(lit(m[0]) * x + lit(m[1]) * y + lit(offset[0]), lit(m[2]) * x + lit(m[3]) * y + lit(offset[1]))


def mercator_to_local(x: Column, y: Column, m: tuple[float, float, float, float], offset: tuple[float, float]) -> Column:
    det = m[0] * m[3] - m[1] * m[2]
    if abs(det) < 1e-15:
        raise ValueError("the transform cannot be inverted")
    u, v = x - lit(offset[0]), y - lit(offset[1])
    return point((lit(m[3]) * u - lit(m[1]) * v) / lit(det), (lit(m[0]) * v - lit(m[2]) * u) / lit(det))


def local_to_wgs84(x: Column, y: Column, m: tuple, offset: tuple) -> Column:
    p = local_to_mercator(x, y, m, offset)
    return mercator_to_wgs84(p["x"], p["y"])


def wgs84_to_local(lon: Column, lat: Column, m: tuple, offset: tuple) -> Column:
    p = wgs84_to_mercator(lon, lat)
    return mercator_to_local(p["x"], p["y"], m, offset)


# -- aggregates ------------------------------------------------------------------------


def principal_angle(x: str, y: str) -> Column:
    """Aggregate: angle in radians of the first principal axis, within (-pi/2, pi/2]."""
    return F.atan2(lit(2) * F.covar_samp(x, y), F.var_samp(x) - F.var_samp(y)) / lit(2)


def mean_direction_deg(length: str, angle_deg_col: str) -> Column:
    """Aggregate: length-weighted mean of undirected angles (doubled-angle mean), in [0, 180)."""
    double = F.radians(F.col(angle_deg_col) * 2)
    s, c = F.sum(F.col(length) * F.sin(double)), F.sum(F.col(length) * F.cos(double))
    return F.pmod(F.degrees(F.atan2(s, c)) / 2, lit(180))


def deterministic_fraction(*values: Column) -> Column:
    """First 8 bytes of the values' sha256 over 2**64 - 1."""
    digest = F.sha2(F.concat_ws("|", *(v.cast("string") for v in values)).cast("binary"), 256)
    high, low = (F.conv(F.substring(digest, k, 8), 16, 10).cast("double") for k in (1, 9))
    return (high * lit(4294967296) + low) / lit(18446744073709551615)


def number(text: Column, fallback: float) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), lit(fallback))
