"""The rule and plant catalogue as small DataFrames, with validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "rule_code string, plant_type string, target_type string, kind string, required double, norm string, doc_id long"
PLANT = "id long, name string, plant_type string, min_spacing decimal(5,2), recommended_spacing decimal(5,2), crown_radius decimal(5,2), zone_min short, zone_max short, suitability string, priority short, is_invasive boolean, is_toxic boolean, is_thorny boolean"
DOCUMENT = "id long, code string, title string, published date"

# Least distances in metres to the plant's axis by plant type and target.
DISTANCES = (
    ("tree", "building", 5.0),
    ("tree", "sidewalk", 0.7),
    ("tree", "road_edge", 2.0),
    ("tree", "gas_pipe", 1.5),
    ("tree", "heat_pipe", 2.0),
    ("tree", "water_pipe", 2.0),
    ("tree", "power_cable", 2.0),
    ("shrub", "building", 1.5),
    ("shrub", "sidewalk", 0.5),
    ("shrub", "road_edge", 1.0),
    ("shrub", "heat_pipe", 1.0),
    ("shrub", "power_cable", 0.75),
)
PROTECTION = (("tree", "heat_pipe", 3.0), ("shrub", "heat_pipe", 3.0))


def distance_rule(plant: str, target: str, metres: float) -> tuple:
    if isinstance(metres, bool) or not metres >= 0 or metres == float("inf"):
        raise ValueError("a distance must be a finite number of at least 0")
    return (f"{plant}_{target}_{metres:g}".upper(), plant, target, "min_distance", float(metres), "СП 42.13330 табл. 9.1", 1)


def protection_rule(plant: str, target: str = "heat_pipe", metres: float = 3.0) -> tuple:
    return (f"{plant}_HEAT_PROTECTION_{metres:g}".upper(), plant, target, "min_distance", metres, "743-ПП", 2)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*(distance_rule(*d) for d in DISTANCES), *(protection_rule(*p) for p in PROTECTION)], RULE)


def rules_with_documents(rules_: DataFrame, documents: DataFrame, requested: list[str]) -> DataFrame:
    """Rules of the requested plant types with their document, manual ones left out, ordered."""
    own = rules_.filter(F.col("plant_type").isin(requested) & (F.col("kind") != "manual_review"))
    docs = documents.select(F.col("id").alias("doc_id"), "code", "title")
    return own.join(F.broadcast(docs), "doc_id", "left").orderBy("plant_type", "rule_code")  # the catalogue's documents: tens of rows


def ordered_plants(plants: DataFrame) -> DataFrame:
    rank = F.when(F.col("suitability") == "recommended", 0).when(F.col("suitability") == "conditional", 1).otherwise(2)
    return plants.orderBy("plant_type", rank, "priority", F.asc_nulls_last("zone_min"), "name")


def selectable(plants: DataFrame) -> DataFrame:
    return plants.filter(~F.coalesce("is_invasive", F.lit(False)) & (F.coalesce("suitability", F.lit("recommended")) != "seasonal_only"))


def completeness(plants: DataFrame) -> DataFrame:
    """Selectable plants of each type with how many lack each property."""
    own = selectable(plants)
    lacks = [F.count_if(F.col(c).isNull()).alias("no_" + c) for c in ("min_spacing", "recommended_spacing", "crown_radius", "is_toxic", "is_thorny")]
    return own.groupBy("plant_type").agg(F.count(F.lit(1)).alias("n"), *lacks)


def invalid_rules(rules_: DataFrame) -> DataFrame:
    """Distance rules without a finite distance of at least 0, and empty or repeated codes."""
    bad = rules_.filter((F.col("kind") == "min_distance") & (F.col("required").isNull() | F.isnan("required") | (F.col("required") < 0) | (F.col("required") == float("inf"))))
    twice = rules_.groupBy("rule_code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or rule_code is null or trim(rule_code) = ''")
    return bad.select("rule_code", F.lit("distance").alias("fault")).unionByName(twice.select("rule_code", F.lit("code").alias("fault")))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` and those of ``old`` whose key it lacks."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def conform(df: DataFrame, renames: dict[str, str], required: list[str]) -> DataFrame:
    """Old column names renamed; a required column that is still missing is an error."""
    for a, b in renames.items():
        if a in df.columns and b not in df.columns:
            df = df.withColumnRenamed(a, b)
    if lost := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df
