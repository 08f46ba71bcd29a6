"""Single shapes and directions, and distance rules on a site dense enough to break them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import blocks, learning, planning
from . import adapters as A
from .registry import query

# A ring per part: a rectangle from the key and the size, left open for every third part.
_RING = "select p_partkey, cast(p_partkey % 50 as double) as x, cast(p_partkey % 30 as double) as y, cast(p_size as double) as w, cast(p_size % 7 + 1 as double) as h from part"


def _rings(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "part")
    x, y = (p["p_partkey"] % 50).cast("double"), (p["p_partkey"] % 30).cast("double")
    w, h = p["p_size"].cast("double"), (p["p_size"] % 7 + 1).cast("double")
    corners = F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + h), G.point(x, y + h))
    return p.select("p_partkey", F.when(p["p_partkey"] % 3 == 0, corners).otherwise(F.concat(corners, F.array(G.point(x, y)))).alias("ring"))


@query("ring_centroids", f"select p_partkey, round(case when p_partkey % 3 = 0 then x + w / 2 else (5 * x + 2 * w) / 5 end, 6) as cx, round(case when p_partkey % 3 = 0 then y + h / 2 else (5 * y + 2 * h) / 5 end, 6) as cy from ({_RING})")
def ring_centroids(spark, sf):
    c = G.centroid(F.col("ring"))
    return _rings(spark, sf).select("p_partkey", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query("compact_rings", f"select p_partkey, p_partkey % 3 <> 0 and sqrt(w * w + h * h) <= 20 as compact from ({_RING})")
def compact_rings(spark, sf):
    return _rings(spark, sf).select("p_partkey", G.is_compact_ring(F.col("ring"), 20.0).alias("compact"))


@query(
    "direction_gaps",
    "select l_orderkey, l_linenumber, cast(l_quantity as double) * cast(l_linenumber as double) - cast(l_partkey % 50 as double) * cast(l_suppkey % 9 as double) as dot, least((abs(l_partkey - l_suppkey) % 360) % 180, 180 - (abs(l_partkey - l_suppkey) % 360) % 180)::double as gap from lineitem",
)
def direction_gaps(spark, sf):
    l = A.table(spark, sf, "lineitem")
    number = lambda c: c.cast("double")
    dot = G.dot(number(F.col("l_quantity")), -number(F.col("l_partkey") % 50), number(F.col("l_linenumber")), number(F.col("l_suppkey") % 9))
    gap = G.undirected_angle(number(F.abs(F.col("l_partkey") - F.col("l_suppkey")) % 360), F.lit(0.0))
    return l.select("l_orderkey", "l_linenumber", dot.alias("dot"), gap.alias("gap"))


@query("line_tiles", f"with {A.SEG} select tile, count(*) as n from (select 'd' || cast(line_id % 3 as varchar) || ':' || cast(cast(floor((x1 + x2) / 2 / 100) as bigint) as varchar) || ':' || cast(cast(floor((y1 + y2) / 2 / 100) as bigint) as varchar) as tile from seg) group by 1")
def line_tiles(spark, sf):
    named = A.lines(spark, sf).withColumn("dataset_id", F.concat(F.lit("d"), (F.col("line_id") % 3).cast("string")))
    return named.groupBy(learning.tile(100.0).alias("tile")).agg(F.count(F.lit(1)).alias("n"))


@query("training_overlap", "select distinct source as dataset_id from documents where doc_id % 2 = 0 and source in (select source from documents where doc_id % 3 = 0)")
def training_overlap(spark, sf):
    d = A.table(spark, sf, "documents").withColumnRenamed("source", "dataset_id")
    return learning.training_overlap(d.filter("doc_id % 3 = 0"), d.filter("doc_id % 2 = 0"))


# The points of the parts on a tenth of the site: neighbours stand within the least distances.
_DENSE = A.PTS.replace("pts as (", "site as (", 1) + ", pts as (select * replace (x / 10 as x, y / 10 as y) from site)"
_NEAR = "pairs as (select a.id as a_id, b.id as b_id, a.kind as a_kind, b.kind as b_kind, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) as d, a.spacing as asp, b.spacing as bsp, a.footprint as af, b.footprint as bf from pts a join pts b on {on} and abs(a.x-b.x) <= 6 and abs(a.y-b.y) <= 6)"
_NEED = """case when a_kind = b_kind then greatest(asp, bsp, af + bf) when a_kind = 'tree' and b_kind = 'shrub' then greatest(1.5, 1.0 + bf)
  when a_kind = 'shrub' and b_kind = 'tree' then greatest(1.5, 1.0 + af) else greatest(1.5, af + bf) end"""


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    return A.points(spark, sf).withColumn("x", F.col("x") / 10).withColumn("y", F.col("y") / 10)


def _profiled(spark: SparkSession, sf: str) -> DataFrame:
    p = F.struct("plant_type", "spacing", "footprint", F.lit(1.5).alias("avoid"), F.when(F.col("plant_type") == "tree", F.lit(1.0)).alias("trunk"), (F.col("plant_type") == "shrub").alias("under_canopy"))
    return _dense(spark, sf).select("id", "x", "y", p.alias("profile"))


@query("dense_spacing_same_type", f"with {_DENSE}, {_NEAR.format(on='a.id < b.id and a.kind = b.kind')} select a_kind as kind, count(*) as n, round(sum({_NEED} - d), 3) as deficit from pairs where d + 1e-7 < {_NEED} group by 1")
def dense_spacing_same_type(spark, sf):
    f = blocks.pair_totals(_dense(spark, sf).select("x", "y", "kind", "spacing", "footprint"), 6.0, blocks.same_type, same=True)
    return f.select(F.col("one").alias("kind"), "n", F.round("deficit", 3).alias("deficit"))


@query(
    "dense_spacing_checks",
    f"""with {_DENSE}, {_NEAR.format(on='a.id % 10 = 1 and b.id % 10 = 0')}, near as (select * from pairs where d <= 6 qualify row_number() over (partition by a_id, b_kind order by d, b_id) = 1)
    select a_id as id, round(min({_NEED} - d), 6) as lacking, max({_NEED} - d) <= 1e-9 as passed from (select *, max({_NEED} - d) over (partition by a_id) as worst from near) where {_NEED} - d = worst group by 1""",
)
def dense_spacing_checks(spark, sf):
    p = _profiled(spark, sf)
    checks = planning.spacing_checks(p.filter("id % 10 = 1"), p.filter("id % 10 = 0"), 6.0)
    return checks.select("id", F.round(F.col("required") - F.col("actual"), 6).alias("lacking"), "passed")


@query("dense_spacing_cross_type", f"with {_DENSE}, {_NEAR.format(on='a.id < b.id and a.kind <> b.kind')} select least(a_kind, b_kind) as one, greatest(a_kind, b_kind) as two, count(*) as n from pairs where d + 1e-7 < {_NEED} group by 1, 2")
def dense_spacing_cross_type(spark, sf):
    p = _profiled(spark, sf).select("x", "y", F.col("profile.plant_type").alias("kind"), "profile.spacing", "profile.footprint", "profile.avoid", "profile.trunk", "profile.under_canopy")
    return blocks.pair_totals(p, 6.0, blocks.profiles, same=False).select("one", "two", "n")


@query(
    "dense_scheme_conflicts",
    f"""with o as (select s_suppkey as option_id, s_suppkey % 40 as bed, unnest(range(0, cast(s_suppkey % 6 + 1 as int))) as k, {A._xy_sql('s_suppkey')[0]} / 40 as bx, {A._xy_sql('s_suppkey')[1]} / 40 as y from supplier), p as (select option_id, bed, bx + k as x, y from o)
    select distinct a.option_id as a, b.option_id as b from p a join p b on a.option_id < b.option_id and a.bed <> b.bed and sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) + 1e-9 < 2""",
)
def dense_scheme_conflicts(spark, sf):
    o = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("option_id"), (F.col("s_suppkey") % 40).alias("bed"), F.explode(F.sequence(F.lit(0), (F.col("s_suppkey") % 6).cast("int"))).alias("k"))
    x, y = A._xy("option_id")
    return planning.scheme_conflicts(o.select("option_id", "bed", (x / 40 + F.col("k")).alias("x"), (y / 40).alias("y")), 2.0)
