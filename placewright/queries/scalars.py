"""Layer names, scalar geometry, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import geometry as G
from ..functions import layers as L
from . import adapters as A
from .registry import query

# Layer names built from part columns: a word by size, a second one by key.
WORDS = ("Газон", "ПЧ", "ТРОТ", "Асфальт покрытие", "Граница покрытия", "ПЧ за ГАЗОН", "уширение за счет газона", "Борт", "грунт", "ЛЭП", "Водопровод", "прочее")
_LAYER = "concat('ДВ_', element_at(array({w}), cast(p_size % {n} as int) + 1), ' ', element_at(array({w}), cast(p_partkey % {n} as int) + 1), '$0$', p_type)".format(w=", ".join(f"'{w}'" for w in WORDS), n=len(WORDS))
_LIST = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
LAY = f"lay as (select p_partkey, p_type, p_size, 'ДВ_' || list_extract({_LIST}, cast(p_size % {len(WORDS)} as int) + 1) || ' ' || list_extract({_LIST}, cast(p_partkey % {len(WORDS)} as int) + 1) || '$0$' || p_type as layer from part)"


def layers(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "part").select("p_partkey", "p_type", "p_size", F.expr(_LAYER).alias("layer"))


def _any_sql(col: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


_REF = f"(contains(n, '{L.COVER_EDGE}') or {_any_sql('n', L.REFERENCE)})"
_SIDE = f"regexp_matches(n, '{L.PROJECT_SIDEWALK}')"
_SURFACE = f"""case when {_REF} then 'reference_geometry'
 when {_SIDE} or regexp_matches(n, '{L.INSTEAD_OF_LAWN}') or (contains(n, 'уширен') and contains(n, 'за счет')) then 'hard_surface'
 when {_any_sql('n', L.PLANTABLE)} and {_any_sql('n', L.HARD)} then 'ambiguous' when {_any_sql('n', L.HARD)} then 'hard_surface' when {_any_sql('n', L.PLANTABLE)} then 'plantable_candidate' else 'unknown' end"""
_SUGGEST = f"""case when {_REF} then 'reference_geometry' when {_any_sql('n', L.PLANTABLE)} and {_any_sql('n', L.HARD)} then 'ambiguous'
 when {_any_sql('n', L.PLANTABLE)} then 'plantable_candidate' when {_any_sql('n', L.HARD)} then 'hard_surface_candidate' else 'unknown' end"""
_WALK = "nullif(least(case when instr(n,'тротуар')>0 then instr(n,'тротуар') else 1000000 end, case when instr(n,'трот')>0 then instr(n,'трот') else 1000000 end), 1000000)"
_ROAD = f"(not {_SIDE} and (contains(n,'пч') or contains(n,'проезж')) and not {_any_sql('n', L.PLANTABLE)} and ({_WALK} is null or instr(n,'пч') = 0 or instr(n,'пч') < {_WALK}))"


@query("layer_tail_counts", f"with {LAY} select regexp_extract(layer, '([^$]*)$', 1) as tail, count(*) as total from lay group by 1")
def layer_tail_counts(spark, sf):
    return layers(spark, sf).groupBy(L.layer_tail(F.col("layer")).alias("tail")).agg(F.count(F.lit(1)).alias("total"))


@query("surface_class_histogram", f"with {LAY} select {_SURFACE} as surface, {_SUGGEST} as suggested, {_ROAD} as road, regexp_matches(n, '{L.PARTITION}') or {_SIDE} as partition_layer, count(*) as n from (select lower(layer) as n from lay) group by 1, 2, 3, 4")
def surface_class_histogram(spark, sf):
    c = F.col("layer")
    return layers(spark, sf).groupBy(L.surface_class(c).alias("surface"), L.suggested_class(c).alias("suggested"), L.is_road_surface(c).alias("road"), L.is_sidewalk_partition(c).alias("partition_layer")).agg(F.count(F.lit(1)).alias("n"))


_RULES = (("lawn", "both", ["LINE", "PROMO"], ["economy", "promo"], "газон", ["асфальт"]), ("road", "modelspace", ["PROMO", "STANDARD", "ECONOMY"], None, "пч|асфальт", None), ("any", "geobase", ["STANDARD"], None, None, None))


@query(
    "layer_rule_match",
    f"""with {LAY}, e as (select *, case when p_size % 2 = 0 then 'geobase' else 'modelspace' end as src, lower(layer) as low, lower(regexp_extract(layer, '([^$]*)$', 1)) as tail from lay)
    select object_type, count(*) as n, cast(sum(p_partkey) as bigint) as keys from (
      select 'lawn' as object_type, p_partkey from e where p_type in ('LINE','PROMO') and tail in ('economy','promo') and regexp_matches(layer, '(?i)газон') and not contains(low, 'асфальт')
      union all select 'road', p_partkey from e where src = 'modelspace' and p_type in ('PROMO','STANDARD','ECONOMY') and regexp_matches(layer, '(?i)пч|асфальт')
      union all select 'any', p_partkey from e where src = 'geobase' and p_type = 'STANDARD') group by 1""",
)
def layer_rule_match(spark, sf):
    schema = "object_type string, rule struct<source:string,dxf_types:array<string>,tails:array<string>,regex:string,excludes:array<string>>"
    rules = spark.createDataFrame([(r[0], (r[1], r[2], r[3], r[4], r[5])) for r in _RULES], schema)
    e = layers(spark, sf).withColumn("src", F.when(F.col("p_size") % 2 == 0, "geobase").otherwise("modelspace"))
    met = e.join(F.broadcast(rules), L.mapping_matches(F.col("src"), F.col("p_type"), F.col("layer"), F.col("rule")))  # three rules
    return met.groupBy("object_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))


@query("network_layers", f"with {LAY} select case lower(w) when 'водопровод' then 'water_pipe' end as network, lower(w) in ('лэп','топо_лэп') as overhead, count(*) as n from (select list_extract({_LIST}, cast(p_size % {len(WORDS)} as int) + 1) as w from lay) group by 1, 2")
def network_layers(spark, sf):
    word = F.expr("element_at(array({w}), cast(p_size % {n} as int) + 1)".format(w=", ".join(f"'{w}'" for w in WORDS), n=len(WORDS)))
    c = F.concat(F.lit("bound$0$"), word)
    return layers(spark, sf).groupBy(L.network_of(c).alias("network"), L.is_overhead(c).alias("overhead")).agg(F.count(F.lit(1)).alias("n"))


_M, _OFF = (0.8, -0.6, 0.6, 0.8), (4180000.0, 7510000.0)


@query(
    "affine_mercator",
    f"""with c as (select s_suppkey, {A._xy_sql('s_suppkey')[0]} as x, {A._xy_sql('s_suppkey')[1]} as y from supplier),
    m as (select *, {_M[0]} * x + {_M[1]} * y + {_OFF[0]} as mx, {_M[2]} * x + {_M[3]} * y + {_OFF[1]} as my from c),
    g as (select *, degrees(mx / {G.RADIUS}) as lon, degrees(2 * atan(exp(my / {G.RADIUS})) - pi() / 2) as lat from m)
    select s_suppkey, round(mx, 6) as mx, round(my, 6) as my, round(lon, 6) as lon, round(lat, 6) as lat, round(x, 3) as back_x, round(y, 3) as back_y from g""",
)
def affine_mercator(spark, sf):
    x, y = A._xy("s_suppkey")
    df = A.table(spark, sf, "supplier").select("s_suppkey", x.alias("x"), y.alias("y"))
    df = df.withColumn("m", G.local_to_mercator(F.col("x"), F.col("y"), _M, _OFF)).withColumn("g", G.local_to_wgs84(F.col("x"), F.col("y"), _M, _OFF))
    back = G.wgs84_to_local(F.col("g.x"), F.col("g.y"), _M, _OFF)
    return df.select("s_suppkey", F.round("m.x", 6).alias("mx"), F.round("m.y", 6).alias("my"), F.round("g.x", 6).alias("lon"), F.round("g.y", 6).alias("lat"), F.round(back["x"], 3).alias("back_x"), F.round(back["y"], 3).alias("back_y"))


@query(
    "arc_points_len",
    """with a as (select p_partkey, 1.0 + p_size % 10 as r, cast(p_partkey % 360 as double) as s, cast((p_partkey * 7) % 360 as double) as e from part),
    b as (select *, e - s + case when e < s then 360 else 0 end as sweep from a),
    c as (select *, greatest(8, least(720, cast(ceil(r * radians(sweep) / 0.5) as int))) as n from b)
    select p_partkey, n + 1 as points, round(n * 2 * r * sin(radians(sweep) / n / 2), 6) as length, round(case when e = s then 0 else sweep end, 6) as sweep from c""",
)
def arc_points_len(spark, sf):
    df = A.table(spark, sf, "part").select("p_partkey", (F.lit(1.0) + F.col("p_size") % 10).alias("r"), (F.col("p_partkey") % 360).cast("double").alias("s"), ((F.col("p_partkey") * 7) % 360).cast("double").alias("e"))
    df = df.withColumn("pts", G.arc_points(F.lit(0.0), F.lit(0.0), F.col("r"), F.col("s"), F.col("e"), 0.5))
    return df.select("p_partkey", F.size("pts").alias("points"), F.round(G.line_length(F.col("pts")), 6).alias("length"), F.round(G.arc_sweep(F.col("s"), F.col("e")), 6).alias("sweep"))


@query(
    "ellipse_extent",
    """with a as (select p_partkey, 2.0 + p_size % 10 as m, 0.5::double as ratio from part),
    n as (select *, greatest(12, least(720, cast(ceil(m * 2 * pi() / 0.5) as int))) as n from a),
    p as (select p_partkey, n, unnest(list_transform(range(0, n + 1), lambda i: m * cos(2 * pi() * i / n))) as x, unnest(list_transform(range(0, n + 1), lambda i: m * ratio * sin(2 * pi() * i / n))) as y from n)
    select p_partkey, count(*) as points, round(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)), 6) as span from p group by 1""",
)
def ellipse_extent(spark, sf):
    import math

    df = A.table(spark, sf, "part").select("p_partkey", (F.lit(2.0) + F.col("p_size") % 10).alias("m"))
    zero = F.lit(0.0)
    pts = G.ellipse_points(zero, zero, F.col("m"), zero, F.lit(0.5), zero, F.lit(2 * math.pi), 0.5)
    return df.select("p_partkey", pts.alias("pts")).select("p_partkey", F.size("pts").cast("long").alias("points"), F.round(G.span(F.col("pts")), 6).alias("span"))


@query(
    "insert_matrix_points",
    """with e as (select l_orderkey * 8 + l_linenumber as k, cast(l_partkey % 50 as double) as x, cast(l_suppkey % 40 as double) as y, l_quantity as q, cast(l_orderkey % 360 as double) as turn from lineitem),
    i as (select *, cos(radians(turn)) * 2 as a, sin(radians(turn)) * 2 as b, -sin(radians(turn)) * 0.5 as c, cos(radians(turn)) * 0.5 as d from e)
    select count(*) as n, round(sum(a * x + c * y + q), 3) as sx, round(sum(b * x + d * y + 1), 3) as sy, round(sum(sqrt(abs(a * d - b * c))), 6) as scale from i""",
)
def insert_matrix_points(spark, sf):
    e = A.table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).cast("double").alias("x"), (F.col("l_suppkey") % 40).cast("double").alias("y"), "l_quantity", (F.col("l_orderkey") % 360).cast("double").alias("turn"))
    unit = G.matrix(*(F.lit(v) for v in (1, 0, 0, 1, 0, 0)))
    m = G.compose(unit, G.insert_matrix(F.col("l_quantity"), F.lit(1.0), F.lit(2.0), F.lit(0.5), F.col("turn")))
    e = e.withColumn("m", m).withColumn("p", G.apply_matrix(F.col("m"), F.col("x"), F.col("y")))
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p.x"), 3).alias("sx"), F.round(F.sum("p.y"), 3).alias("sy"), F.round(F.sum(G.radius_scale(F.col("m"))), 6).alias("scale"))


@query(
    "line_shape",
    f"""with {A.SEG} select target_type, round(sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))), 4) as length, round(max(degrees(acos(greatest(-1, least(1, (x2-x1) / sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))))))), 6) as steepest,
    count(distinct cast(floor((x1+x2)/2/100) as bigint) * 100000 + cast(floor((y1+y2)/2/100) as bigint)) as tiles from seg group by 1""",
)
def line_shape(spark, sf):
    df = A.lines(spark, sf).withColumn("pts", F.array(G.point(F.col("x1"), F.col("y1")), G.point(F.col("x2"), F.col("y2"))))
    u = G.chord_vector(F.col("pts"))
    tile = G.cell((F.col("x1") + F.col("x2")) / 2, 100.0) * 100000 + G.cell((F.col("y1") + F.col("y2")) / 2, 100.0)
    return df.groupBy("target_type").agg(F.round(F.sum(G.line_length(F.col("pts"))), 4).alias("length"), F.round(F.max(G.angle_deg(u["x"], u["y"], F.lit(1.0), F.lit(0.0))), 6).alias("steepest"), F.count_distinct(tile).alias("tiles"))


@query(
    "principal_axis",
    f"with {A.PTS} select plant_type, round(atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2, 6) as angle, round(avg(x), 6) as cx, round(avg(y), 6) as cy from pts group by 1",
)
def principal_axis(spark, sf):
    return A.points(spark, sf).groupBy("plant_type").agg(F.round(G.principal_angle("x", "y"), 6).alias("angle"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))


@query(
    "mean_direction",
    f"""with {A.SEG}, a as (select target_type, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as n, degrees(atan2(y2-y1, x2-x1)) as g from seg),
    s as (select target_type, sum(n * sin(radians(g * 2))) as s, sum(n * cos(radians(g * 2))) as c from a group by 1)
    select target_type, round(case when d < 0 then d + 180 else d end, 6) as angle from (select target_type, degrees(atan2(s, c)) / 2 as d from s)""",
)
def mean_direction(spark, sf):
    df = A.lines(spark, sf).withColumn("n", G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).withColumn("g", F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))))
    return df.groupBy("target_type").agg(F.round(G.mean_direction_deg("n", "g"), 6).alias("angle"))


@query(
    "interval_coverage",
    """with i as (select user_id, value as lo, value + 4 as hi from events), o as (select *, max(hi) over (partition by user_id order by lo, hi rows between unbounded preceding and 1 preceding) as reach
      from (select user_id, greatest(lo, 50) as lo, least(hi, 250) as hi from i) where hi > lo)
    select user_id, round(sum(greatest(0, hi - greatest(lo, coalesce(reach, 50)))) / 200, 6) as share from o group by 1""",
)
def interval_coverage(spark, sf):
    e = A.table(spark, sf, "events").filter("value < 250 and value + 4 > 50").groupBy("user_id").agg(F.collect_list(F.struct(F.col("value").alias("lo"), (F.col("value") + 4).alias("hi"))).alias("i"))
    return e.select("user_id", F.round(G.interval_coverage(F.col("i"), F.lit(50.0), F.lit(250.0)), 6).alias("share"))


@query("fingerprint", "select sha256(coalesce(url, '') || chr(10) || coalesce(html, '')) as digest, count(*) as n from pages group by 1")
def fingerprint(spark, sf):
    p = A.table(spark, sf, "pages")
    text = F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit("")))
    return p.groupBy(F.sha2(text.cast("binary"), 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "reason_decisions",
    "with r as (select case event_type when 'click' then 'accepted_straight' when 'view' then 'review_isolated' else 'rejected_' || event_type end as reason from events) select reason, case when starts_with(reason, 'accepted_') then 'accepted' when starts_with(reason, 'review_') then 'manual_review' else 'rejected' end as decision, count(*) as n from r group by 1, 2",
)
def reason_decisions(spark, sf):
    t = F.col("event_type")
    reason = F.when(t == "click", "accepted_straight").when(t == "view", "review_isolated").otherwise(F.concat(F.lit("rejected_"), t))
    df = A.table(spark, sf, "events").select(reason.alias("reason"))
    return df.groupBy("reason", C.reason_decision(F.col("reason")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "colour_labels",
    "with c as (select l_orderkey, case when cc = 256 then lc else cc end as c from (select l_orderkey, case l_linenumber when 1 then 256 when 2 then 3 when 3 then 2 else 7 end as cc, cast(l_suppkey % 4 as int) as lc from lineitem)) select case c when 3 then 'positive' when 2 then 'negative' else 'skip' end as label, count(*) as n from c group by 1",
)
def colour_labels(spark, sf):
    n = F.col("l_linenumber")
    c = F.when(n == 1, 256).when(n == 2, 3).when(n == 3, 2).otherwise(7)
    return A.table(spark, sf, "lineitem").groupBy(C.colour_label(c, (F.col("l_suppkey") % 4).cast("int")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("number_fallback", "select coalesce(try_cast(trim(replace(p_brand, 'Brand#', '')) as double), -1.0::double) as value, count(*) as n from part group by 1")
def number_fallback(spark, sf):
    return A.table(spark, sf, "part").groupBy(G.number(F.regexp_replace("p_brand", "Brand#", ""), -1.0).alias("value")).agg(F.count(F.lit(1)).alias("n"))
