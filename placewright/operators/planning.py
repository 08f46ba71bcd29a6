"""Candidate generation, packing, layout scores and selection."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import geometry as G
from . import blocks, graph, grid

RETENTION = 0.9


# -- candidates ------------------------------------------------------------------------------


def hex_grid(boxes: DataFrame, spacing: float, angle_deg: float = 0.0, phase_x: float = 0.0, phase_y: float = 0.0) -> DataFrame:
    """Rotated triangular grid over each box (box_id, x1, y1, x2, y2): row, col, x, y inside the box.

    Rows lie spacing * sqrt(3) / 2 apart and every other one is shifted by half a
    step; the grid turns around the box's centre, the phases are shares of a step.
    """
    step = spacing * math.sqrt(3) / 2
    c, s = math.cos(math.radians(angle_deg)), math.sin(math.radians(angle_deg))
    df = boxes.withColumn("mx", (F.col("x1") + F.col("x2")) / 2).withColumn("my", (F.col("y1") + F.col("y2")) / 2)
    reach = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2.0) + F.pow(F.col("y2") - F.col("y1"), 2.0)) / 2
    rows = F.ceil(reach / step).cast("int") + 1
    cols = F.ceil(reach / spacing).cast("int") + 1
    df = df.withColumn("row", F.explode(F.sequence(-rows, rows))).withColumn("col", F.explode(F.sequence(-cols, cols)))
    u = (F.col("col") + phase_x) * spacing + F.when(F.pmod(F.col("row"), F.lit(2)) == 1, spacing / 2).otherwise(0.0)
    v = (F.col("row") + phase_y) * step
    df = df.withColumn("x", F.col("mx") + u * c - v * s).withColumn("y", F.col("my") + u * s + v * c)
    return df.filter("x between x1 and x2 and y between y1 and y2").drop("mx", "my")


def line_grid(boxes: DataFrame, spacing: float, phase_u: float = 0.0, phase_v: float = 0.0) -> DataFrame:
    """Square grid aligned with each box, first station half a phase in."""
    nx = F.floor((F.col("x2") - F.col("x1")) / spacing - phase_u).cast("int")
    ny = F.floor((F.col("y2") - F.col("y1")) / spacing - phase_v).cast("int")
    df = boxes.filter((nx >= 0) & (ny >= 0)).withColumn("col", F.explode(F.sequence(F.lit(0), nx))).withColumn("row", F.explode(F.sequence(F.lit(0), ny)))
    return df.withColumn("x", F.col("x1") + (F.col("col") + phase_u) * spacing).withColumn("y", F.col("y1") + (F.col("row") + phase_v) * spacing)


def alley(guides: DataFrame, spacing: float, rows: int = 1, phase: float = 0.0) -> DataFrame:
    """Stations along each guide segment (guide_id, x1, y1, x2, y2), in one or two rows."""
    if rows not in (1, 2):
        raise ValueError("an alley has one row or two")
    offsets = [0.0] if rows == 1 else [-spacing / 2, spacing / 2]
    n = F.floor(graph.length_of() / spacing - phase).cast("int")
    df = guides.filter(n >= 0).withColumn("k", F.explode(F.sequence(F.lit(0), n))).withColumn("off", F.explode(F.array(*map(F.lit, offsets))))
    ux, uy = F.try_divide(F.col("x2") - F.col("x1"), graph.length_of()), F.try_divide(F.col("y2") - F.col("y1"), graph.length_of())
    at = (F.col("k") + phase) * spacing
    return df.withColumn("x", F.col("x1") + ux * at - uy * F.col("off")).withColumn("y", F.col("y1") + uy * at + ux * F.col("off"))


def free_groups(boxes: DataFrame, spacing: float, seed: int) -> DataFrame:
    """Rings of five around seeded anchors 4.5 spacings apart, radius 1.1 to 1.25 spacings."""
    anchors = line_grid(boxes, 4.5 * spacing, 0.5, 0.5)
    frac = lambda *v: G.deterministic_fraction(F.lit(seed), F.col("box_id"), F.col("col"), F.col("row"), *v)
    df = anchors.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("turn", frac(F.lit("turn")))
    r = spacing * (1.1 + 0.15 * frac(F.lit("radius"), F.col("k")))
    a = (F.col("k") / 5.0 + F.col("turn")) * (2 * math.pi)
    df = df.withColumn("x", F.col("x") + r * F.cos(a)).withColumn("y", F.col("y") + r * F.sin(a))
    return df.filter("x between x1 and x2 and y between y1 and y2")


# -- packing ---------------------------------------------------------------------------------


def pack(candidates: DataFrame, spacing: float, max_count: int | None = None, group: str | None = None) -> DataFrame:
    """Ordered greedy packing, set-wise: candidates (id, x, y[, group]) in the order of id.

    A candidate stands where no earlier accepted one is nearer than ``spacing``.
    Rounds accept every undecided candidate without an undecided earlier neighbour
    and reject the neighbours of the accepted; the result is the sequential one.
    The order of ids is a total order; within ``group`` the packing is independent.
    """
    own = candidates.select("id", "x", "y", *([group] if group else []))
    pairs = grid.self_pairs(own, spacing).filter(F.col("distance") * F.col("distance") + 1e-9 < spacing * spacing)
    if group:
        pairs = pairs.filter(F.col("a_" + group) == F.col("b_" + group))
    pairs = graph._checkpoint(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    state = graph._checkpoint(own.select("id", F.lit(0).alias("state")))  # 0 undecided, 1 accepted, -1 rejected
    while True:
        open_ = state.filter("state = 0").select("id")
        if open_.isEmpty():
            break
        # pairs with a decided end say nothing any more
        live = pairs.join(grid.shuffled(open_.withColumnRenamed("id", "a")), "a", "left_semi").join(grid.shuffled(open_.withColumnRenamed("id", "b")), "b", "left_semi")
        pairs = live = graph._checkpoint(live)
        blocked = live.select(F.col("b").alias("id")).distinct()
        taken = open_.join(blocked, "id", "left_anti").withColumn("now", F.lit(1))
        lost = live.join(taken.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().withColumn("now", F.lit(-1))
        state = graph._checkpoint(
            state.join(grid.shuffled(taken.unionByName(lost).groupBy("id").agg(F.max("now").alias("now"))), "id", "left").select("id", F.when((F.col("state") == 0) & F.col("now").isNotNull(), F.col("now")).otherwise(F.col("state")).alias("state"))
        )
    out = candidates.join(grid.shuffled(state.filter("state = 1").select("id")), "id", "left_semi")
    if max_count is None:
        return out
    if group:
        rank = F.row_number().over(Window.partitionBy(group).orderBy("id"))
        return out.withColumn("_n", rank).filter(F.col("_n") <= max_count).drop("_n")
    return out.orderBy("id").limit(max_count)


def capacity(rows: DataFrame, count: str, order: str, budget: int, group: str) -> DataFrame:
    """Running budget within a group: what each row may still take."""
    before = F.coalesce(F.sum(count).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("taken", F.greatest(F.lit(0), F.least(F.col(count), F.lit(budget) - before)))


# -- variants and scores -------------------------------------------------------------------------


def row_adjacency(stations: DataFrame, spacing: float) -> DataFrame:
    """(variant, row, n, pairs, isolated): stations at u along each row of each variant."""
    nxt = F.lead("u").over(Window.partitionBy("variant", "row").orderBy("u"))
    df = stations.withColumn("pair", F.coalesce(F.abs(nxt - F.col("u") - spacing) < 1e-5, F.lit(False)))
    return df.groupBy("variant", "row").agg(F.count(F.lit(1)).alias("n"), F.count_if("pair").alias("pairs")).withColumn("isolated", (F.col("n") == 1).cast("int"))


def best_linear(variants: DataFrame, key: str = "bed") -> DataFrame:
    """Of variants (bed, variant, n, pairs, isolated, imbalance) with nearly the most plants the most even."""
    most = variants.groupBy(key).agg(F.max("n").alias("most"))
    near = variants.join(most, key).filter(F.col("n") >= F.ceil(F.lit(RETENTION) * F.col("most")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("pairs"), "isolated", "imbalance", F.desc("n"), "variant"))
    return near.withColumn("rank", rank).filter("rank = 1").drop("rank", "most")


def best_count(variants: DataFrame, key: str = "bed") -> DataFrame:
    """First variant with the most plants."""
    return variants.groupBy(key).agg(F.max(F.struct("n", (-F.col("variant")).alias("order"))).alias("b")).select(key, (-F.col("b.order")).alias("variant"), F.col("b.n").alias("n"))


def neighbour_counts(points: DataFrame, radius: float, group: str) -> DataFrame:
    """(group, n, pairs, isolated): points of a scheme within ``radius`` of each other."""
    found = blocks.neighbour_totals(points.select("id", "x", "y", F.col(group).cast("string").alias("kind")), radius + 1e-7)
    own = points.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    out = own.join(found.withColumnRenamed("kind", "_kind"), F.col(group).cast("string") == F.col("_kind"), "left")
    return out.select(group, "n", F.coalesce("pairs", none).alias("pairs"), (F.col("n") - F.coalesce("met", none)).alias("isolated"))


def tree_score(n: Column, pairs: Column, isolated: Column, anchored: Column, elongated: Column, style: Column, shade: Column) -> Column:
    fit = F.when(style == "linear", F.when(elongated, 3.0).otherwise(-1.5)).when(style.isin("tree_grove", "free_group"), F.when(elongated, -1.0).otherwise(2.0)).otherwise(0.0)
    open_space = F.when((style == "tree_grove") & (n >= 3), 1.0).otherwise(0.0)
    return F.round(n + 1.1 * pairs - 1.5 * isolated + 0.6 * anchored + fit + open_space + shade, 4)


def shrub_score(n: Column, pairs: Column, isolated: Column, fit: Column) -> Column:
    return n + 0.12 * F.least(pairs, 2 * n) - 2 * isolated + fit


def prune_fragments(points: DataFrame, spacing: float, group: str) -> DataFrame:
    """Of schemes of at least eight points with a mass of more than five, masses under four go."""
    near = grid.self_pairs(points.select("id", "x", "y", group), 1.55 * spacing).filter(F.col("a_" + group) == F.col("b_" + group))
    label = graph.components(near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), points.select("id"))
    sized = points.join(label, "id").withColumn("mass", F.count(F.lit(1)).over(Window.partitionBy(group, "component")))
    sized = sized.withColumn("most", F.max("mass").over(Window.partitionBy(group))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    return sized.filter((F.col("n") < 8) | (F.col("most") <= 5) | (F.col("mass") >= 4)).drop("component", "mass", "most", "n")


def scheme_conflicts(points: DataFrame, spacing: float) -> DataFrame:
    """(a, b): options of different beds of which two points (option_id, bed, x, y) stand too close."""
    return blocks.option_conflicts(points, spacing)


# -- exact selection -------------------------------------------------------------------------------


def _solve(weights: list[int], counts: list[int], beds: list, conflicts: set[tuple[int, int]], cap: int, nodes: int = 200_000) -> tuple[list[int], str]:
    """Branch and bound over beds: at most one option each, pairwise conflicts, total count."""
    by_bed: dict = {}
    for i, bed in enumerate(beds):
        by_bed.setdefault(bed, []).append(i)
    groups = sorted(by_bed.values(), key=lambda g: -max(weights[i] for i in g))
    rest = [0] * (len(groups) + 1)
    for k in range(len(groups) - 1, -1, -1):
        rest[k] = rest[k + 1] + max(weights[i] for i in groups[k])
    bad: dict[int, set[int]] = {}
    for a, b in conflicts:
        bad.setdefault(a, set()).add(b)
        bad.setdefault(b, set()).add(a)
    best: tuple[int, list[int]] = (-1, [])
    left = nodes
    stack: list[tuple[int, int, int, list[int]]] = [(0, 0, cap, [])]
    while stack and left:
        left -= 1
        k, value, room, chosen = stack.pop()
        if value > best[0]:
            best = (value, chosen)
        if k == len(groups) or value + rest[k] <= best[0]:
            continue
        stack.append((k + 1, value, room, chosen))
        for i in sorted(groups[k], key=lambda i: (weights[i], -i)):
            if counts[i] <= room and not bad.get(i, set()) & set(chosen):
                stack.append((k + 1, value + weights[i], room - counts[i], [*chosen, i]))
    return sorted(best[1]), "FEASIBLE" if stack else "OPTIMAL"


def optimize_layouts(options: DataFrame, conflicts: DataFrame, max_count: int) -> DataFrame:
    """Chosen options (option_id, bed, n, weight, site) of each site, with the solver's status.

    A site is one planning area: its options (a few per bed) are solved in one
    task by exact branch and bound; where the node budget runs out, the best plan
    found is returned as FEASIBLE.
    """
    weighted = options.withColumn("weight", F.greatest(F.lit(1), (F.round(F.col("score") * 100) + 100 * F.col("n")).cast("int")))
    edges = conflicts.join(options.select(F.col("option_id").alias("a"), F.col("site").alias("at_site")), "a").select(F.col("at_site").alias("site"), "a", "b")

    def solve(own: pd.DataFrame, bad: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("option_id").reset_index(drop=True)
        place = {v: i for i, v in enumerate(own["option_id"])}
        pairs = {(place[a], place[b]) for a, b in zip(bad["a"], bad["b"]) if a in place and b in place}
        chosen, status = _solve(own["weight"].tolist(), own["n"].tolist(), own["bed"].tolist(), pairs, max_count)
        return own.loc[chosen, ["site", "bed", "option_id", "n", "weight"]].assign(status=status)

    kinds = {f.name: f.dataType.simpleString() for f in weighted.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("site", "bed", "option_id", "n", "weight")) + ", status string"
    return weighted.groupBy("site").cogroup(edges.groupBy("site")).applyInPandas(solve, schema)


# -- profiles and advisories -----------------------------------------------------------------------------


def resolve_profiles(selections: DataFrame, catalog: DataFrame, base: DataFrame) -> DataFrame:
    """Profile of each selection: request, then recommended, then least, then base spacing.

    A spacing under the catalogue's least or under two crown radii is an error (valid = false).
    """
    c = catalog.select("species", "recommended_spacing", "min_spacing", "crown_radius")
    b = base.select("plant_type", F.col("spacing").alias("base_spacing"), F.col("footprint").alias("base_footprint"))
    df = selections.join(c, "species", "left").join(F.broadcast(b), "plant_type", "left")  # one row per plant type
    spacing = F.coalesce("requested_spacing", "recommended_spacing", "min_spacing", "base_spacing")
    footprint = F.coalesce("crown_radius", "base_footprint")
    least = F.greatest(F.coalesce("min_spacing", F.lit(0.0)), 2 * F.coalesce("crown_radius", F.lit(0.0)))
    return df.select(*selections.columns, spacing.alias("spacing"), footprint.alias("footprint"), (spacing >= least).alias("valid"))


def shrub_advisories(plan: DataFrame, shrubs: DataFrame, masses: DataFrame, near: float = 2.0) -> DataFrame:
    """Isolated existing shrubs inside a mass of another species (boxes mass_id, species, x1..y2)."""
    others = shrubs.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = grid.point_pairs(shrubs.select("id", "x", "y"), others, near).filter("id <> rid").select("id").distinct()
    alone = shrubs.join(pairs, "id", "left_anti")
    size = 25.0
    boxes = grid.around(masses.withColumnRenamed("species", "mass_species"), F.col("x1"), F.col("x2"), F.col("y1"), F.col("y2"), size)
    inside = grid.with_cell(alone, size).join(boxes, ["cx", "cy"]).filter("x between x1 and x2 and y between y1 and y2")
    return inside.filter("species <> mass_species").select("id", "species", "mass_id", "mass_species").distinct()


def tree_advisories(blocked: DataFrame, keep: float = 4.0, replace: float = 2.0) -> DataFrame:
    """Proposed groups (group_id, station, blocker) with one blocking tree and enough gain."""
    g = blocked.groupBy("group_id").agg(F.count_distinct("blocker").alias("blockers"), F.count_distinct("station").alias("stations"), F.min("blocker").alias("tree"))
    return g.filter((F.col("blockers") == 1) & (F.col("stations") >= 2)).withColumn("gain", F.col("stations") * keep - replace).filter(F.col("gain") >= keep).select("group_id", "tree", "stations", "gain")


def spacing_checks(points: DataFrame, occupied: DataFrame, bound: float) -> DataFrame:
    """(id, actual, required, other): the worst of the nearest neighbours of each profile.

    ``points`` and ``occupied`` carry a struct column profile (see functions.checks).
    """
    others = occupied.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("profile").alias("rprofile"), F.col("profile.plant_type").alias("key"))
    near = grid.nearest_per_key(points, others, bound)
    near = near.withColumn("required", C.required_spacing(F.col("profile"), F.col("rprofile")))
    worst = F.min(F.struct((F.col("distance") - F.col("required")).alias("slack"), F.col("rid").alias("other"), F.col("distance").alias("actual"), "required"))
    return near.groupBy("id").agg(worst.alias("w")).select("id", "w.actual", "w.required", "w.other", (F.col("w.slack") + 1e-9 >= 0).alias("passed"))


def suppress(boxes: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Greedy suppression by score: boxes (id, score, x1..y2) that overlap an earlier one too much go.

    Earlier means higher score, then lesser id; solved in rounds like ``pack``.
    """
    size = 25.0
    cells = grid.around(boxes, F.col("x1"), F.col("x2"), F.col("y1"), F.col("y2"), size)
    side = lambda p: cells.select("cx", "cy", *(F.col(c).alias(p + c) for c in ("id", "score", "x1", "y1", "x2", "y2")))
    w = F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")
    h = F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1")
    area = lambda p: (F.col(p + "x2") - F.col(p + "x1")) * (F.col(p + "y2") - F.col(p + "y1"))
    first = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_id") < F.col("b_id")))
    pairs = side("a_").join(side("b_"), ["cx", "cy"]).filter(first & (w > 0) & (h > 0) & (w * h > overlap * F.least(area("a_"), area("b_"))))
    pairs = graph._checkpoint(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct())
    undecided = graph._checkpoint(boxes.select("id"))
    taken = None
    while not undecided.isEmpty():
        live = pairs.join(undecided.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        now = graph._checkpoint(undecided.join(live, "id", "left_anti"))
        taken = now if taken is None else taken.unionByName(now)
        gone = pairs.join(now.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        undecided = graph._checkpoint(undecided.join(now, "id", "left_anti").join(gone, "id", "left_anti"))
    return boxes if taken is None else boxes.join(taken, "id", "left_semi")
