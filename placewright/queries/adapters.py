"""Deterministic drawings over the driver tables, and the same as SQL.

Coordinates come from keys by integer arithmetic with distinct primes, so both
engines derive identical doubles.  Whole tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import catalog

TYPES = {"1-URGENT": "building", "2-HIGH": "gas_pipe", "3-MEDIUM": "water_pipe", "4-NOT SPECIFIED": "heat_pipe", "5-LOW": "power_cable"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _xy(key: str, shift: int = 0) -> tuple:
    k = F.col(key).cast("long") + shift
    return ((k * 7919) % 100003).cast("double") / F.lit(100.0), ((k * 15485863) % 99991).cast("double") / F.lit(100.0)


def _xy_sql(key: str, shift: int = 0) -> tuple[str, str]:
    k = f"(cast({key} as bigint) + {shift})"
    return f"cast(({k} * 7919) % 100003 as double) / 100.0::double", f"cast(({k} * 15485863) % 99991 as double) / 100.0::double"


_KIND = "case p_size % 3 when 0 then 'tree' when 1 then 'shrub' else 'herbaceous' end"


def points(spark: SparkSession, sf: str) -> DataFrame:
    """One plant per part: id, plant_type, x, y, spacing, footprint, species."""
    x, y = _xy("p_partkey")
    kind = F.expr(_KIND)
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        kind.alias("plant_type"),
        kind.alias("kind"),
        x.alias("x"),
        y.alias("y"),
        (F.lit(2.0) + (F.col("p_size") % 5).cast("double")).alias("spacing"),
        ((F.col("p_size") % 7).cast("double") / F.lit(2.0)).alias("footprint"),
        F.col("p_brand").alias("species"),
    )


PTS = f"""pts as (select p_partkey as id, {_KIND} as plant_type, {_KIND} as kind, {_xy_sql('p_partkey')[0]} as x, {_xy_sql('p_partkey')[1]} as y,
  2.0::double + cast(p_size % 5 as double) as spacing, cast(p_size % 7 as double) / 2.0::double as footprint, p_brand as species from part)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """One segment per order: line_id, target_type, x1, y1, x2, y2."""
    x, y = _xy("o_orderkey", 31)
    types = F.create_map(*(F.lit(v) for kv in TYPES.items() for v in kv))
    df = table(spark, sf, "orders").select("o_orderkey", F.element_at(types, F.col("o_orderpriority")).alias("target_type"), x.alias("x1"), y.alias("y1"))
    dx = ((F.col("o_orderkey") % 7).cast("double") + 1.0) * F.lit(1.5)
    dy = ((F.col("o_orderkey") % 5).cast("double") - 2.0) * F.lit(1.25)
    return df.select(F.col("o_orderkey").alias("line_id"), "target_type", "x1", "y1", (F.col("x1") + dx).alias("x2"), (F.col("y1") + dy).alias("y2"))


_CASE = "case o_orderpriority " + " ".join(f"when '{k}' then '{v}'" for k, v in TYPES.items()) + " end"
SEG = f"""seg as (select line_id, target_type, x1, y1, x1 + (cast(line_id % 7 as double) + 1.0) * 1.5::double as x2, y1 + (cast(line_id % 5 as double) - 2.0) * 1.25::double as y2
  from (select o_orderkey as line_id, {_CASE} as target_type, {_xy_sql('o_orderkey', 31)[0]} as x1, {_xy_sql('o_orderkey', 31)[1]} as y1 from orders))"""

ENDS = """ends as (
  select line_id, line_id * 2 as id, 0 as "end", x1 as x, y1 as y, (x1 - x2) / n as ox, (y1 - y2) / n as oy from (select *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as n from seg)
  union all
  select line_id, line_id * 2 + 1, 1, x2, y2, (x2 - x1) / n, (y2 - y1) / n from (select *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as n from seg))"""

#: Squared-free distance of point (x, y) to segment (x1, y1, x2, y2), in SQL.
PSD = """sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))"""
SHARE = "case when (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) = 0 then 0 else greatest(0, least(1, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1)) / ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) end"


def targets(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).withColumn("source", F.when(F.col("target_type") == "power_cable", "raw").otherwise("cleaned_high_confidence_geometry"))


def rules(spark: SparkSession) -> DataFrame:
    return catalog.rules(spark)


def rules_sql() -> str:
    rows = [catalog.distance_rule(*d) for d in catalog.DISTANCES] + [catalog.protection_rule(*p) for p in catalog.PROTECTION]
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::double" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    return f"rules(rule_code, plant_type, target_type, kind, required, norm, doc_id) as (values {body})"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as scored primitives: label, probability, length."""
    d = table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 1000).cast("double") / F.lit(1000.0)).alias("probability"), F.col("n_chars").cast("double").alias("length"))
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")).join(d, "doc_id")


SCORED = """scored as (select l.doc_id, l.quality as label, cast(d.n_chars % 1000 as double) / 1000.0::double as probability, cast(d.n_chars as double) as length from labels l join documents d using (doc_id))"""
