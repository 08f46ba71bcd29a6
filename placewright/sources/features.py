"""Feature files: one JSON object per line with type, id, properties and geometry."""

from __future__ import annotations

import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT_TYPES = ("existing_tree", "existing_shrub", "utility_well", "proposed_planting")
FEATURE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    ]
)
_RING = "array<array<double>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features with line_no, object_type, geometry type and coordinates (JSON text).

    A line that is no feature is an error that names the line.
    """
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("line_no", F.monotonically_increasing_id())
    f = F.from_json("value", FEATURE)
    ok = f.isNotNull() & (f["type"] == "Feature") & f["geometry"]["type"].isNotNull()
    bad = F.raise_error(F.concat(F.lit("no feature: "), F.substring("value", 1, 80)))
    df = lines.select("line_no", F.when(ok, f).otherwise(F.when(~F.coalesce(ok, F.lit(False)), bad)).alias("f"))
    return df.select("line_no", "f.id", F.col("f.properties")["object_type"].alias("object_type"), "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def rings(features: DataFrame) -> DataFrame:
    """(object_type, feature, part, ring, is_hole, seq, x, y) of polygonal features."""
    one = features.filter("kind = 'Polygon'").select("object_type", "line_no", F.array(F.from_json("coordinates", f"array<{_RING}>")).alias("parts"))
    many = features.filter("kind = 'MultiPolygon'").select("object_type", "line_no", F.from_json("coordinates", f"array<array<{_RING}>>").alias("parts"))
    df = one.unionByName(many).select("object_type", F.col("line_no").alias("feature"), F.posexplode("parts").alias("part", "p"))
    df = df.select("object_type", "feature", "part", F.posexplode("p").alias("ring", "r"))
    df = df.select("object_type", "feature", "part", "ring", (F.col("ring") > 0).alias("is_hole"), F.posexplode("r").alias("seq", "c"))
    return df.withColumn("x", F.col("c")[0]).withColumn("y", F.col("c")[1]).drop("c")


def segments(features: DataFrame) -> DataFrame:
    """(object_type, feature, part, seq, x1, y1, x2, y2) of lines and of polygon outlines."""
    line = features.filter("kind = 'LineString'").select("object_type", "line_no", F.array(F.from_json("coordinates", _RING)).alias("parts"))
    lines = features.filter("kind in ('MultiLineString', 'Polygon')").select("object_type", "line_no", F.from_json("coordinates", f"array<{_RING}>").alias("parts"))
    multi = features.filter("kind = 'MultiPolygon'").select("object_type", "line_no", F.flatten(F.from_json("coordinates", f"array<array<{_RING}>>")).alias("parts"))
    df = line.unionByName(lines).unionByName(multi).select("object_type", F.col("line_no").alias("feature"), F.posexplode("parts").alias("part", "pts"))
    n = F.size("pts")
    pairs = F.zip_with(F.slice("pts", 1, n - 1), F.slice("pts", 2, n - 1), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    return df.filter(n > 1).select("object_type", "feature", "part", F.posexplode(pairs).alias("seq", "s")).select("object_type", "feature", "part", "seq", "s.*")


def points(features: DataFrame) -> DataFrame:
    """(object_type, feature, x, y) of point and multi-point features."""
    one = features.filter("kind = 'Point'").select("object_type", "line_no", F.array(F.from_json("coordinates", "array<double>")).alias("pts"))
    many = features.filter("kind = 'MultiPoint'").select("object_type", "line_no", F.from_json("coordinates", _RING).alias("pts"))
    return one.unionByName(many).select("object_type", F.col("line_no").alias("feature"), F.explode("pts").alias("c")).select("object_type", "feature", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"))


def require(features: DataFrame, object_type: str, family: tuple[str, ...]) -> DataFrame:
    """Features of one type; none, or another geometry family, is an error."""
    own = features.filter(F.col("object_type") == object_type)
    kinds = {r.kind for r in own.select("kind").distinct().collect()}  # at most seven names
    if not kinds:
        raise ValueError(f"no {object_type} in the input")
    if kinds - set(family):
        raise ValueError(f"{object_type} holds {', '.join(sorted(kinds - set(family)))}")
    return own


def last_per_type(features: DataFrame, key: str) -> DataFrame:
    """The last feature of each value of a property."""
    name = F.col("properties")[key]
    n = F.row_number().over(Window.partitionBy(name).orderBy(F.desc("line_no")))
    return features.withColumn("_n", n).filter("_n = 1").drop("_n")


def utility_sources(features: DataFrame) -> DataFrame:
    """Provenance of each network type: sums, statuses, any manual review, reconstructed or cleaned."""
    p = F.col("properties")
    return features.filter(F.coalesce(p["decision"], F.lit("accepted")) == "accepted").groupBy("object_type").agg(
        F.count(F.lit(1)).alias("features"),
        F.sum(F.coalesce(p["inferred_count"].try_cast("long"), F.lit(0))).alias("inferred"),
        F.array_sort(F.collect_set(p["status"])).alias("statuses"),
        F.array_sort(F.collect_set(p["reason"])).alias("reasons"),
        F.bool_or(F.coalesce(p["manual_review_required"].try_cast("boolean"), F.lit(False))).alias("manual_review"),
        F.when(F.max(F.coalesce(p["inferred_count"].try_cast("long"), F.lit(0))) > 0, "reconstructed").otherwise("cleaned").alias("source_kind"),
    )


def raw_primitives(spark: SparkSession, path: str, types: list[str]) -> DataFrame:
    """Raw drawing records of the wanted types: lines and polylines as (record, seq, x1..y2)."""
    schema = "object_type string, source_layer string, dxf_type string, handle string, color int, geometry struct<kind:string,start:array<double>,end:array<double>,points:array<array<double>>,closed:boolean>"
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path).filter(F.col("object_type").isin(types)).withColumn("record", F.monotonically_increasing_id())
    pts = F.when(F.col("geometry.kind") == "line", F.array("geometry.start", "geometry.end")).otherwise(F.col("geometry.points"))
    pts = F.when(F.col("geometry.closed"), F.concat(pts, F.array(pts[0]))).otherwise(pts)
    df = df.select("object_type", "source_layer", "dxf_type", "handle", "color", "record", pts.alias("pts")).filter("size(pts) > 1")
    n = F.size("pts")
    pairs = F.zip_with(F.slice("pts", 1, n - 1), F.slice("pts", 2, n - 1), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    df = df.withColumn("s", F.explode(pairs)).select("object_type", "source_layer", "dxf_type", "handle", "color", "record", "s.*")
    return df.filter("abs(x2 - x1) + abs(y2 - y1) > 1e-9")
