"""Rule checks of a decision: ``array<struct<code,target,status,actual,required,norm>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-7
# Provenance of a network's geometry that a distance rule accepts.
ACCEPTED_SOURCES = (
    "cleaned_high_confidence_geometry",
    "reconstructed_high_confidence_geometry",
    "cleaned_high_confidence_geometry_plus_full_heat_chambers",
    "reconstructed_high_confidence_geometry_plus_full_heat_chambers",
)
UTILITIES = ("water_pipe", "gas_pipe", "heat_pipe", "power_cable")


def check(code: Column, target: Column, status: Column, actual: Column, required: Column, norm: Column) -> Column:
    return F.struct(code.alias("code"), target.alias("target"), status.alias("status"), actual.cast("double").alias("actual"), required.cast("double").alias("required"), norm.cast("string").alias("norm"))


def rule_status(has_target: Column, kind: Column, target: Column, source: Column) -> Column:
    """unavailable, manual_review, unsupported or applied, in that order of precedence."""
    gated = (kind == "min_distance") & target.isin(*UTILITIES) & ~F.coalesce(source, F.lit("")).isin(*ACCEPTED_SOURCES)
    return (
        F.when(~F.coalesce(has_target, F.lit(False)), "unavailable")
        .when((kind == "manual_review") | gated, "manual_review")
        .when(F.coalesce(kind != "min_distance", F.lit(True)), "unsupported")
        .otherwise("applied")
    )


def distance_status(rule_state: Column, actual: Column, required: Column) -> Column:
    """passed or failed for an applied rule, manual_review for any other."""
    passed = actual.isNotNull() & (actual + TOLERANCE >= required)
    return F.when((rule_state == "applied") & required.isNotNull(), F.when(passed, "passed").otherwise("failed")).otherwise("manual_review")


def decision(checks: Column) -> Column:
    return (
        F.when(F.exists(checks, lambda c: c["status"] == "failed"), "rejected").when(F.exists(checks, lambda c: c["status"] == "manual_review"), "manual_review").otherwise("accepted")
    )


def codes(checks: Column, status: str) -> Column:
    return F.transform(F.filter(checks, lambda c: c["status"] == status), lambda c: c["code"])


def failed(checks: Column) -> Column:
    """Failed checks; the overall one goes where a specific one failed too."""
    bad = F.filter(checks, lambda c: c["status"] == "failed")
    own = F.filter(bad, lambda c: c["code"] != "ALLOWED_ZONE")
    return F.when(F.size(own) > 0, own).otherwise(bad)


def failure_details(checks: Column) -> Column:
    return F.transform(
        failed(checks),
        lambda c: F.struct(c["code"].alias("code"), c["target"].alias("target"), F.greatest(F.lit(0.0), c["required"] - c["actual"]).alias("deficit")),
    )


def margins(checks: Column) -> Column:
    """Measured checks by slack (actual - required), then code."""
    measured = F.filter(checks, lambda c: c["actual"].isNotNull() & c["required"].isNotNull())
    keyed = F.transform(measured, lambda c: F.struct((c["actual"] - c["required"]).alias("slack"), c["code"].alias("code")))
    return F.array_sort(keyed)


def references(checks: Column) -> Column:
    """Distinct norm references that name a table or paragraph, in order."""
    norms = F.transform(checks, lambda c: c["norm"])
    return F.array_distinct(F.filter(norms, lambda n: n.isNotNull() & ((n.startswith("СП ") & n.rlike("табл|п\\.")) | n.contains("743-ПП"))))


def has_legal_reference(checks: Column) -> Column:
    return F.exists(checks, lambda c: F.coalesce(c["norm"].rlike("СП |ПП|СанПиН|ФЗ"), F.lit(False)))


def target_label(check_: Column) -> Column:
    code = check_["code"]
    return F.coalesce(
        check_["target"], F.when(code.contains("_GAS_"), "gas_pipe").when(code.contains("_WATER_"), "water_pipe").when(code.contains("_HEAT_"), "heat_pipe").when(code.contains("_BUILDING_"), "building")
    )


def reason_lines(checks: Column) -> Column:
    mark = lambda c: F.when(c["status"] == "passed", "+").when(c["status"] == "failed", "!").otherwise("?")
    show = lambda v: F.coalesce(F.format_string("%.2f", v), F.lit("-"))
    return F.transform(checks, lambda c: F.concat(mark(c), F.lit(" "), c["code"], F.lit(" "), show(c["actual"]), F.lit("/"), show(c["required"])))


def reason_decision(reason: Column) -> Column:
    return F.when(reason.startswith("accepted_"), "accepted").when(reason.startswith("review_"), "manual_review").otherwise("rejected")


def colour_label(color: Column, layer_color: Column, own: int = 3, negative: int = 2) -> Column:
    """positive, negative or skip by an entity's colour (256: its layer's)."""
    c = F.when(color == 256, layer_color).otherwise(color)
    return F.when(c == own, "positive").when(c == negative, "negative").otherwise("skip")


def markdown_cell(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "\\|", "\\\\|"), "\\s*\\n\\s*", " ")


def metadata_pairs(values: dict[str, Column]) -> Column:
    """key=value strings of at most 250 characters (the longest a drawing's string holds)."""
    return F.filter(F.array(*(F.substring(F.concat(F.lit(k + "="), v.cast("string")), 1, 250) for k, v in values.items())), lambda s: s.isNotNull())


def required_spacing(a: Column, b: Column) -> Column:
    """Least distance of two profiles struct(plant_type, spacing, footprint, avoid, trunk, under_canopy)."""
    crowns = a["footprint"] + b["footprint"]

    def canopy(tree: Column, shrub: Column) -> Column:
        return (tree["plant_type"] == "tree") & (shrub["plant_type"] == "shrub") & F.coalesce(tree["trunk"] > 0, F.lit(False)) & F.coalesce(shrub["under_canopy"], F.lit(False))

    avoid = F.greatest(a["avoid"], b["avoid"])
    return (
        F.when(a["plant_type"] == b["plant_type"], F.greatest(a["spacing"], b["spacing"], crowns))
        .when(canopy(a, b), F.greatest(avoid, a["trunk"] + b["footprint"]))
        .when(canopy(b, a), F.greatest(avoid, b["trunk"] + a["footprint"]))
        .otherwise(F.greatest(avoid, crowns))
    )
