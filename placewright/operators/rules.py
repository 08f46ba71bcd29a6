"""Rules against targets: allow-zone rule states, point checks, decisions, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import geometry as G
from . import blocks, grid


def target_distances(points: DataFrame, targets: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """(id, target_type, actual): least distance of each point to each target type within ``radius``.

    One grid join for all rules: a rule only compares the distance with its own bound.
    """
    near = grid.point_segment_pairs(points.select("id", "x", "y"), targets.select("target_type", "x1", "y1", "x2", "y2"), radius, cell)
    return near.groupBy("id", "target_type").agg(F.min("distance").alias("actual"))


def rule_states(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """Rules with their state; ``targets`` holds target_type and source of what was found."""
    present = targets.groupBy("target_type").agg(F.max("source").alias("source")).withColumn("found", F.lit(True))
    out = rules.join(F.broadcast(present), "target_type", "left")  # one row per target type of the rule catalogue
    return out.withColumn("state", C.rule_status(F.col("found"), F.col("kind"), F.col("target_type"), F.col("source"))).drop("found")


def point_checks(points: DataFrame, rules: DataFrame, targets: DataFrame, units: float = 1.0) -> DataFrame:
    """One row per point (id, plant_type, x, y) and rule of its type, with state, actual and status.

    ``rules`` is the rule catalogue (tens of rows).  Distances beyond every rule's
    bound are left null: the grid join proves that they pass.
    """
    states = rule_states(rules, targets)
    bound = float(states.agg(F.max("required")).first()[0] or 0.0) * units
    actual = target_distances(points, targets, max(bound, 1e-6))
    own = points.join(F.broadcast(states), "plant_type")
    own = own.join(actual, ["id", "target_type"], "left")
    measured = F.col("actual") / units
    status = F.when((F.col("state") == "applied") & F.col("actual").isNull(), "passed").otherwise(C.distance_status(F.col("state"), measured, F.col("required")))
    return own.withColumn("actual", measured).withColumn("status", status)


def decisions(point_checks_: DataFrame) -> DataFrame:
    """(id, plant_type, status, checks): the checks of each point in the order of their code."""
    item = F.struct(
        F.col("rule_code").alias("code"), F.col("target_type").alias("target"), F.col("status").alias("status"), F.col("actual").alias("actual"), F.col("required").alias("required"), F.col("norm").alias("norm")
    )
    grouped = point_checks_.groupBy("id", "plant_type").agg(F.array_sort(F.collect_list(item)).alias("checks"))  # a point has as many checks as its type has rules
    return grouped.withColumn("status", C.decision(F.col("checks")))


def rejection_causes(decided: DataFrame) -> DataFrame:
    return decided.filter("status = 'rejected'").select(F.explode(C.codes(F.col("checks"), "failed")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def audit(trees: DataFrame, rules: DataFrame, targets: DataFrame, units: float = 1.0) -> DataFrame:
    """Existing trees (id, x, y) against the rules of trees: one row per tree and rule.

    status is conflict, passed or unavailable (a rule that is not applied).
    """
    rows = point_checks(trees.withColumn("plant_type", F.lit("tree")), rules, targets, units)
    return rows.withColumn("status", F.when(F.col("state") != "applied", "unavailable").when(F.col("status") == "failed", "conflict").otherwise("passed"))


def audit_status(audited: DataFrame) -> DataFrame:
    """(id, status): conflict, incomplete or clear for each tree."""
    has = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    return audited.groupBy("id").agg(F.when(has("conflict"), "conflict").when(has("unavailable"), "incomplete").otherwise("clear").alias("status"))


def audit_rollup(audited: DataFrame) -> DataFrame:
    """(scope, name, n): trees by status, conflicting trees by target, conflicts by rule."""
    by_status = audit_status(audited).groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("scope", F.lit("status"))
    bad = audited.filter("status = 'conflict'")
    by_target = bad.groupBy(F.col("target_type").alias("name")).agg(F.count_distinct("id").alias("n")).withColumn("scope", F.lit("target"))
    by_rule = bad.groupBy(F.col("rule_code").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("scope", F.lit("rule"))
    return by_status.unionByName(by_target).unionByName(by_rule).select("scope", "name", "n")


def in_region(points: DataFrame, rings: DataFrame) -> DataFrame:
    """Points inside the union of regions: even-odd over the edges of each region.

    ``rings`` are edges (region_id, x1, y1, x2, y2); only the edges that a ray from the
    point's cell can cross inside their region are compared.
    """
    return blocks.inside(points, rings)


def resolve_sources(parts: DataFrame) -> DataFrame:
    """Rows of the best source of each target type: those with the least priority number."""
    best = parts.groupBy("target_type").agg(F.min("priority").alias("priority"))
    return parts.join(F.broadcast(best), ["target_type", "priority"], "left_semi")  # one row per target type


def missing(requested: DataFrame, available: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(available.select(key).distinct(), key, "left_anti")


def status_of(checks: Column) -> Column:
    return C.decision(checks)
