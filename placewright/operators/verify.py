"""Independent verification of plans, schedules and drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import geometry as G
from . import grid


def entity_difference(before: DataFrame, after: DataFrame, key: tuple[str, ...] = ("handle", "type", "layer")) -> DataFrame:
    """(key..., change): rows of either side that the other lacks, repeats counted."""
    a, b = before.select(*key), after.select(*key)
    return a.exceptAll(b).withColumn("change", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("change", F.lit("new")))


def fingerprint_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.select("handle", F.col("fingerprint").alias("old")), after.select("handle", F.col("fingerprint").alias("new"))
    return a.join(b, "handle", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))


def id_differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    lost = expected.select(key).exceptAll(found.select(key)).withColumn("side", F.lit("missing"))
    return lost.unionByName(found.select(key).exceptAll(expected.select(key)).withColumn("side", F.lit("unexpected")))


def plan_counters(plan: DataFrame) -> DataFrame:
    """One wide aggregate over plan rows (planting_id, plant_type, status, checks, x, y)."""
    return plan.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("planting_id").alias("ids"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(F.col("status") == "manual_review").alias("manual_review"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(F.size("checks") == 0).alias("without_checks"),
        F.count_if(~C.has_legal_reference(F.col("checks"))).alias("without_reference"),
        F.count_if(F.exists("checks", lambda c: c["status"] == "failed") & (F.col("status") != "rejected")).alias("accepted_with_failure"),
        F.count_if(F.isnan("x") | F.isnan("y")).alias("bad_points"),
    )


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def cross_type_failures(points: DataFrame, bound: float) -> DataFrame:
    """Pairs of different types (struct column profile) that stand too close."""
    pairs = grid.self_pairs(points, bound).filter(F.col("a_profile.plant_type") != F.col("b_profile.plant_type"))
    return pairs.withColumn("required", C.required_spacing(F.col("a_profile"), F.col("b_profile"))).filter(F.col("distance") + 1e-7 < F.col("required"))


def traces(rows: DataFrame) -> DataFrame:
    """(trace_id, statuses map, n) of the options of each layout trace."""
    by = rows.groupBy("trace_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("trace_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"), F.sum("n").alias("n"))


def tile_schedule(points: DataFrame, size: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(tile, i, j, counts by type): tiles numbered row by row from the top."""
    at = points.withColumn("i", G.cell(F.col("x") - origin[0], size)).withColumn("j", G.cell(F.col("y") - origin[1], size))
    kinds = ["tree", "shrub", "herbaceous"]
    rows = at.groupBy("i", "j").agg(*(F.count_if(F.col("plant_type") == k).alias(k) for k in kinds), F.count_if(F.col("status") == "manual_review").alias("manual_review"))
    # tiles of the rows above, then the place in the row: no window over all tiles
    above = rows.groupBy("j").agg(F.count(F.lit(1)).alias("n"))
    offset = above.alias("a").join(F.broadcast(above.alias("b")), F.col("b.j") > F.col("a.j"), "left").groupBy(F.col("a.j").alias("j")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("offset"))  # one row per tile row
    place = F.row_number().over(Window.partitionBy("j").orderBy("i"))
    return rows.join(F.broadcast(offset), "j").withColumn("tile", (F.col("offset") + place).cast("long")).drop("offset")


def with_ids(rows: DataFrame, prefix: dict[str, str], order: list[str]) -> DataFrame:
    """Sequential ids within each plant type: T-0001 and so on."""
    n = F.row_number().over(Window.partitionBy("plant_type").orderBy(*order))
    name = F.element_at(F.create_map(*(F.lit(v) for kv in prefix.items() for v in kv)), F.col("plant_type"))
    return rows.withColumn("planting_id", F.concat(name, F.lit("-"), F.format_string("%04d", n)))


def legend(plan: DataFrame) -> DataFrame:
    """Distinct (plant_type, species) with the place of each species in its type's palette."""
    return plan.select("plant_type", "species").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("plant_type").orderBy("species")))


def running_area(rows: DataFrame) -> DataFrame:
    """(plant_type, rule_code, before, after): the zone's area as rules are applied in order."""
    w = Window.partitionBy("plant_type").orderBy("rule_code")
    gone = F.sum("excluded").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("after", F.col("base") - gone).withColumn("before", F.col("base") - gone + F.col("excluded"))


def runs(strokes: DataFrame, key: list[str], low: str, high: str, gap: float) -> DataFrame:
    """Gaps and islands: strokes joined where the gap to all before is at most ``gap``; a missing place comes last, as in the SQL."""
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_last(low), F.asc_nulls_last(high))
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(low) - reach > gap), 1).otherwise(0)
    df = strokes.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*key, "run").agg(F.min(low).alias("lo"), F.max(high).alias("hi"), F.count(F.lit(1)).alias("strokes"))


def top_per_group(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def grid_first(rows: DataFrame, tolerance: float, order: str) -> DataFrame:
    """First row of each grid cell of its position."""
    key = [G.snap(F.col("x"), tolerance).alias("kx"), G.snap(F.col("y"), tolerance).alias("ky")]
    at = rows.select("*", *key)
    best = at.groupBy("kx", "ky").agg(F.min(order).alias(order))
    return at.join(best, ["kx", "ky", order], "left_semi").drop("kx", "ky")
