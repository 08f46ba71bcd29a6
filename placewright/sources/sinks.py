"""Outputs: feature files, reports, and a plain drawing of result entities."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks as C

MARK = "PLAN"


def as_feature(properties: dict[str, Column], kind: Column, coordinates: Column) -> Column:
    """A feature as JSON text."""
    props = F.struct(*(v.alias(k) for k, v in properties.items()))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(kind.alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def write_features(df: DataFrame, path: str, properties: list[str]) -> None:
    """Point rows (x, y) as feature lines, replacing what was there."""
    text = as_feature({p: F.col(p) for p in properties}, F.lit("Point"), F.array("x", "y"))
    df.select(text.alias("value")).write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Parquet by partition; a repeated export replaces only the partitions it holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def explanation_rows(decided: DataFrame) -> DataFrame:
    """(id, n, line): one Markdown table row per check of each decision."""
    df = decided.select("id", F.posexplode("checks").alias("n", "c"))
    shown = lambda v: F.coalesce(F.format_string("%.2f", v), F.lit(""))
    cells = [F.col("id").cast("string"), F.col("c.code"), C.target_label(F.col("c")), F.col("c.status"), shown(F.col("c.actual")), shown(F.col("c.required")), F.coalesce("c.norm", F.lit(""))]
    return df.select("id", "n", F.concat(F.lit("| "), F.concat_ws(" | ", *(C.markdown_cell(c) for c in cells)), F.lit(" |")).alias("line"))


def legend_rows(rules: DataFrame) -> DataFrame:
    """(plant_type, rule_code, layer, text): the legend of the rules' exclusion layers."""
    text = F.concat_ws(" ", "rule_code", "state", F.format_string("%.2f m", F.col("required")))
    return rules.select("plant_type", "rule_code", F.concat_ws("_", F.lit(MARK), F.upper("plant_type"), F.upper("target_type")).alias("layer"), text.alias("text"))


def entity_lines(df: DataFrame) -> DataFrame:
    """Result points (planting_id, plant_type, x, y, radius) as the lines of CIRCLE entities."""
    layer = F.concat_ws("_", F.lit(MARK), F.upper("plant_type"))
    number = lambda v: F.format_string("%.6f", v)
    tag = F.substring(F.concat(F.lit("planting_id="), F.col("planting_id")), 1, 250)
    return df.select(F.concat_ws("\n", *(F.lit(v) if isinstance(v, str) else v for v in ("0", "CIRCLE", "8", layer, "10", number(F.col("x")), "20", number(F.col("y")), "40", number(F.col("radius")), "1001", "PLACEWRIGHT", "1000", tag))).alias("value"))


def write_drawing(source: DataFrame | None, results: DataFrame, path: str) -> None:
    """A drawing folder of text parts: header, kept entities of the source, result entities, end.

    Result layers of an earlier export are left out of the source, so exporting
    twice gives the same drawing.
    """
    head = results.sparkSession.createDataFrame([(0, "0\nSECTION\n2\nENTITIES")], "part int, value string")
    tail = results.sparkSession.createDataFrame([(3, "0\nENDSEC\n0\nEOF")], "part int, value string")
    parts = [head, entity_lines(results).select(F.lit(2).alias("part"), "value"), tail]
    if source is not None:
        kept = source.filter(~F.col("layer").startswith(MARK + "_") & (F.col("section") == "ENTITIES"))
        pairs = F.array_join(F.transform("pairs", lambda p: F.concat_ws("\n", p["code"].cast("string"), p["value"])), "\n")
        parts.append(kept.select(F.lit(1).alias("part"), F.concat_ws("\n", F.lit("0"), F.col("type"), pairs).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.repartitionByRange(F.col("part")).sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)


def decision_groups(rows: DataFrame) -> DataFrame:
    """(object_type, decision, reason, n, length, least, most): totals of a classified network."""
    return rows.groupBy("object_type", "decision", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.min("probability").alias("least"), F.max("probability").alias("most"))


