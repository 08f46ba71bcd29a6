"""Polygon areas: exact overlay areas by a vectorised scanline, region algebra as predicates.

A region is a set of rings (region_id, ring, seq, x, y).  Straight-edged regions
are overlaid exactly: between two consecutive vertex or crossing heights every
edge is a straight line, so areas are sums of trapezoids.  Buffers are not built;
a distance to a target is a predicate on points (see ``operators.rules``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    """Rows x1, y1, x2, y2 of all rings, closed."""
    out = [np.hstack([r, np.roll(r, -1, 0)]) for r in rings if len(r) >= 3]
    return np.vstack(out) if out else np.zeros((0, 4))


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def _crossing_heights(edges: np.ndarray) -> np.ndarray:
    """Heights at which two edges cross."""
    out = []
    for i in range(len(edges) - 1):
        a, b = edges[i], edges[i + 1 :]
        d = (a[2] - a[0]) * (b[:, 3] - b[:, 1]) - (a[3] - a[1]) * (b[:, 2] - b[:, 0])
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((b[:, 0] - a[0]) * (b[:, 3] - b[:, 1]) - (b[:, 1] - a[1]) * (b[:, 2] - b[:, 0])) / d
            u = ((b[:, 0] - a[0]) * (a[3] - a[1]) - (b[:, 1] - a[1]) * (a[2] - a[0])) / d
        hit = (d != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        out.append(a[1] + t[hit] * (a[3] - a[1]))
    return np.concatenate(out) if out else np.zeros(0)


def overlay_areas(regions: list[list[np.ndarray]]) -> dict[tuple[bool, ...], float]:
    """Area of every combination of inside / outside of the regions (even-odd rings).

    The all-outside combination is left out.
    """
    edges = [_edges(r) for r in regions]
    owner = np.concatenate([np.full(len(e), k) for k, e in enumerate(edges)]) if edges else np.zeros(0, int)
    every = np.vstack(edges) if edges else np.zeros((0, 4))
    level = every[:, 1] != every[:, 3] if len(every) else np.zeros(0, bool)
    every, owner = every[level], owner[level]
    sums: dict[tuple[bool, ...], float] = {}
    if not len(every):
        return sums
    heights = np.unique(np.concatenate([every[:, 1], every[:, 3], _crossing_heights(every)]))
    low, high = np.minimum(every[:, 1], every[:, 3]), np.maximum(every[:, 1], every[:, 3])
    for y0, y1 in zip(heights, heights[1:]):
        mid = (y0 + y1) / 2
        on = (low <= mid) & (high >= mid)
        e, own = every[on], owner[on]
        slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
        at = e[:, 0] + (mid - e[:, 1]) * slope
        order = np.argsort(at, kind="stable")
        inside = np.zeros(len(regions), bool)
        for k, i in enumerate(order[:-1]):
            inside[own[i]] ^= True
            if inside.any():
                # edges do not cross inside the strip: the middle width is the mean width
                width = at[order[k + 1]] - at[i]
                if width > 0:
                    name = tuple(bool(v) for v in inside)
                    sums[name] = sums.get(name, 0.0) + float(width * (y1 - y0))
    return sums


def intersection_area(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    return overlay_areas([a, b]).get((True, True), 0.0)


def difference_area(base: list[np.ndarray], *cut: list[np.ndarray]) -> float:
    sums = overlay_areas([base, *cut])
    return sum(v for k, v in sums.items() if k[0] and not any(k[1:]))


def union_area(*regions: list[np.ndarray]) -> float:
    return sum(overlay_areas(list(regions)).values())


def min_rotated_rect(points: np.ndarray) -> tuple[float, float, float]:
    """(short side, long side, angle of the long side in degrees) of the least rectangle."""
    pts = np.unique(points, axis=0)
    hull = convex_hull(pts)
    best = (float("inf"), 0.0, 0.0, 0.0)
    for a, b in zip(hull, np.roll(hull, -1, 0)):
        t = np.arctan2(b[1] - a[1], b[0] - a[0])
        c, s = np.cos(t), np.sin(t)
        u, v = hull @ np.array([c, s]), hull @ np.array([-s, c])
        w, h = np.ptp(u), np.ptp(v)
        if w * h < best[0] - 1e-12:
            best = (w * h, w, h, np.degrees(t) % 180)
    _, w, h, angle = best
    return (h, w, angle) if w >= h else (w, h, (angle + 90) % 180)


def convex_hull(points: np.ndarray) -> np.ndarray:
    pts = points[np.lexsort((points[:, 1], points[:, 0]))]
    if len(pts) < 3:
        return pts

    def half(seq: np.ndarray) -> list:
        out: list = []
        for p in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def polygonize(segments: np.ndarray, snap: float = 1e-8) -> list[np.ndarray]:
    """Faces of a planar arrangement of segments (rows x1, y1, x2, y2), without the outer one.

    Segments are cut at their crossings, dangling ends fall away, and half-edges are
    walked with the next one clockwise.
    """
    cuts: list[set[float]] = [{0.0, 1.0} for _ in segments]
    for i in range(len(segments)):
        x1, y1, x2, y2 = segments[i]
        for j in range(i + 1, len(segments)):
            u1, v1, u2, v2 = segments[j]
            d = (x2 - x1) * (v2 - v1) - (y2 - y1) * (u2 - u1)
            if d == 0:
                continue
            t = ((u1 - x1) * (v2 - v1) - (v1 - y1) * (u2 - u1)) / d
            s = ((u1 - x1) * (y2 - y1) - (v1 - y1) * (x2 - x1)) / d
            if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= s <= 1 + 1e-12:
                cuts[i].add(min(1.0, max(0.0, t)))
                cuts[j].add(min(1.0, max(0.0, s)))
    key = lambda p: (round(p[0] / snap), round(p[1] / snap))
    place: dict = {}
    links: dict = {}
    for (x1, y1, x2, y2), at in zip(segments, cuts):
        pts = [(x1 + t * (x2 - x1), y1 + t * (y2 - y1)) for t in sorted(at)]
        for p, q in zip(pts, pts[1:]):
            a, b = key(p), key(q)
            if a != b:
                place.setdefault(a, p)
                place.setdefault(b, q)
                links.setdefault(a, set()).add(b)
                links.setdefault(b, set()).add(a)
    loose = [n for n, v in links.items() if len(v) == 1]
    while loose:
        n = loose.pop()
        for m in links.pop(n, set()):
            links[m].discard(n)
            if len(links[m]) == 1:
                loose.append(m)
    turn = {n: sorted(v, key=lambda m: np.arctan2(place[m][1] - place[n][1], place[m][0] - place[n][0])) for n, v in links.items() if v}
    seen: set = set()
    faces = []
    for n in turn:
        for m in turn[n]:
            if (n, m) in seen:
                continue
            walk, a, b = [], n, m
            while (a, b) not in seen:
                seen.add((a, b))
                walk.append(place[a])
                around = turn[b]
                a, b = b, around[(around.index(a) - 1) % len(around)]
            ring = np.array(walk)
            signed = float(np.dot(ring[:, 0], np.roll(ring[:, 1], -1)) - np.dot(ring[:, 1], np.roll(ring[:, 0], -1))) / 2
            if signed > snap:
                faces.append(ring)
    return faces


def close_chain(points: np.ndarray, max_gap: float = 0.1, repair_gap: float = 1.0, share: float = 0.01) -> tuple[np.ndarray | None, str]:
    """A chain closed into a ring, with the reason, or None.

    Closed are gaps of at most ``max_gap``; of at most ``repair_gap`` and ``share`` of
    the length; and a missing fourth wall (both end angles 90 +- 18 degrees, area of at
    least 10, width of at least 3).
    """
    if len(points) < 3:
        return None, "too_short"
    gap = float(np.hypot(*(points[0] - points[-1])))
    length = float(np.hypot(*np.diff(points, axis=0).T).sum())
    if gap <= max_gap:
        return points, "closed"
    if gap <= repair_gap and gap <= share * length:
        return points, "repaired_gap"
    v = points[0] - points[-1]

    def angle(w: np.ndarray) -> float:
        n = np.hypot(*v) * np.hypot(*w)
        return float(np.degrees(np.arccos(np.clip(v @ w / n, -1, 1)))) if n else 0.0

    if abs(angle(points[1] - points[0]) - 90) <= 18 and abs(angle(points[-2] - points[-1]) - 90) <= 18 and ring_area(points) >= 10 and min_rotated_rect(points)[0] >= 3:
        return points, "orthogonal_missing_wall"
    return None, "open"


# -- DataFrame operators ----------------------------------------------------------------------


def ring_areas(rings: DataFrame) -> DataFrame:
    """(region_id, area): area of each region by the vertex formula, holes taken off; all Columns."""
    pts = rings.groupBy("region_id", "ring", "is_hole").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))  # one ring's vertices
    own = G.ring_area(F.col("pts"))
    return pts.groupBy("region_id").agg(F.sum(F.when(F.col("is_hole"), -own).otherwise(own)).alias("area"))


def overlay(rings: DataFrame) -> DataFrame:
    """(bed_id, base, excluded, allowed) for rings (bed_id, role, ring, seq, x, y).

    role is ``base`` or a target's name; a bed's rings are one task's input.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by: dict[str, list[np.ndarray]] = {}
        for (role, _), g in pdf.sort_values(["role", "ring", "seq"]).groupby(["role", "ring"]):
            by.setdefault(role, []).append(g[["x", "y"]].to_numpy(float))
        base = by.pop("base", [])
        area = union_area(base) if base else 0.0
        allowed = difference_area(base, *by.values()) if base else 0.0
        return pd.DataFrame({"bed_id": [pdf["bed_id"].iloc[0]], "base": [area], "excluded": [area - allowed], "allowed": [allowed]})

    return rings.groupBy("bed_id").applyInPandas(run, "bed_id long, base double, excluded double, allowed double")


def faces(segments: DataFrame) -> DataFrame:
    """(component, face, area, width, length, angle) of the faces of each component's segments."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, ring in enumerate(polygonize(pdf[["x1", "y1", "x2", "y2"]].to_numpy(float))):
            short, long, angle = min_rotated_rect(ring)
            rows.append((pdf["component"].iloc[0], k, ring_area(ring), short, long, angle))
        return pd.DataFrame(rows, columns=["component", "face", "area", "width", "length", "angle"]).astype({"component": "int64", "face": "int32"})

    return segments.select("component", "x1", "y1", "x2", "y2").groupBy("component").applyInPandas(run, "component long, face int, area double, width double, length double, angle double")


def chamber_faces(faces_: DataFrame) -> DataFrame:
    """Faces that look like chambers: 4-100 m2, sides 2-20, aspect to 1.6, rectangularity 0.85."""
    return faces_.filter("area between 4 and 100 and width >= 2 and length <= 20 and length <= 1.6 * width and area >= 0.85 * width * length")


def plants_for_area(area, spacing: float):
    """Plants of a triangular grid in an area, at least one."""
    return F.greatest(F.lit(1), F.ceil(area / F.lit(spacing * spacing * 3**0.5 / 2))).cast("int")


def linear_reference(pdf: np.ndarray, spacing: float) -> tuple[float, float, float] | None:
    """(angle, length, width) of an elongated ring, else None."""
    short, long, angle = min_rotated_rect(pdf)
    if long >= 2 * spacing and short > 0 and long / short >= 2.5 and ring_area(pdf) / (short * long) >= 0.55:
        return angle, long, short
    return None


def bands(ring: np.ndarray, shares: list[float], steps: int = 48) -> list[float]:
    """Cut positions along the long axis that split a ring's area by ``shares`` (bisection)."""
    _, _, angle = min_rotated_rect(ring)
    t = np.radians(angle)
    u = ring @ np.array([np.cos(t), np.sin(t)])
    v = ring @ np.array([-np.sin(t), np.cos(t)])
    own = np.stack([u, v], 1)
    total, done, cuts = ring_area(ring), 0.0, []
    for share in shares[:-1]:
        done += share
        low, high = float(u.min()), float(u.max())
        for _ in range(steps):
            mid = (low + high) / 2
            box = np.array([[u.min() - 1, v.min() - 1], [mid, v.min() - 1], [mid, v.max() + 1], [u.min() - 1, v.max() + 1]])
            low, high = (mid, high) if intersection_area([own], [box]) < done * total else (low, mid)
        cuts.append((low + high) / 2)
    return cuts
