"""Endpoint graphs, reconstruction of networks, components."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import graph, networks, verify
from . import adapters as A
from .registry import query

RULES = networks.scaled(networks.RULES, 1.0)
_EPS = f"{A.SEG}, {A.ENDS}"


def _touch(r: float) -> str:
    return f"""touch as (select id, line_id, other, {A.PSD} as d from (select e.id, e.line_id, e.x, e.y, s.line_id as other, s.x1, s.y1, s.x2, s.y2,
      case when pow(s.x2-s.x1,2)+pow(s.y2-s.y1,2) = 0 then 0 else greatest(0, least(1, ((e.x-s.x1)*(s.x2-s.x1)+(e.y-s.y1)*(s.y2-s.y1)) / (pow(s.x2-s.x1,2)+pow(s.y2-s.y1,2)))) end as t
      from ends e join seg s on e.line_id <> s.line_id and s.x1 <= e.x + {r} and s.x2 >= e.x - {r} and least(s.y1,s.y2) <= e.y + {r} and greatest(s.y1,s.y2) >= e.y - {r}))"""


@query("endpoint_vectors", f"with {_EPS} select line_id, \"end\", round(x, 6) as x, round(y, 6) as y, round(ox, 6) as ox, round(oy, 6) as oy from ends")
def endpoint_vectors(spark, sf):
    e = graph.endpoints(A.lines(spark, sf))
    return e.select("line_id", "end", *(F.round(c, 6).alias(c) for c in ("x", "y", "ox", "oy")))


@query("free_endpoints", f"with {_EPS}, {_touch(1.0)} select count(*) as n, cast(sum(id) as bigint) as ids from ends where id not in (select id from touch where d <= 1.0)")
def free_endpoints(spark, sf):
    return networks.free_endpoints(A.lines(spark, sf), 1.0).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


_FREE = f"{_EPS}, {_touch(0.05)}, free as (select * from ends where id not in (select id from touch where d <= 0.05))"
_CONT = """cont as (select 'continuation' as kind, a.id as source, b.id as target, b.line_id as target_line, a.x as sx, a.y as sy, b.x as tx, b.y as ty, d as distance, sa, ta,
    greatest(0, least(1, 0.7 * (1 - (sa + ta) / 24.0) + 0.3 * (1 - d / 5.0))) as score from (
    select a, b, d, degrees(acos(greatest(-1, least(1, a.ox * (b.x - a.x) / d + a.oy * (b.y - a.y) / d)))) as sa, degrees(acos(greatest(-1, least(1, -b.ox * (b.x - a.x) / d - b.oy * (b.y - a.y) / d)))) as ta from (
      select a, b, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) as d from free a join free b on a.id < b.id and a.line_id <> b.line_id and abs(a.x-b.x) <= 5 and abs(a.y-b.y) <= 5) where d > 0.05 and d <= 5) where sa <= 12 and ta <= 12)"""
_JUNC = """junc as (select 'junction' as kind, id as source, cast(null as bigint) as target, target_line, x as sx, y as sy, tx, ty, d as distance, sa, cast(null as double) as ta, greatest(0, least(1, 0.65 * (1 - sa / 18.0) + 0.35 * (1 - d / 2.0))) as score from (
    select *, degrees(acos(greatest(-1, least(1, ox * (tx - x) / d + oy * (ty - y) / d)))) as sa from (
      select *, sqrt(pow(x-tx,2)+pow(y-ty,2)) as d from (select *, x1 + t * (x2-x1) as tx, y1 + t * (y2-y1) as ty, t * n as along from (
        select e.id, e.line_id, e.x, e.y, e.ox, e.oy, s.line_id as target_line, s.x1, s.y1, s.x2, s.y2, sqrt(pow(s.x2-s.x1,2)+pow(s.y2-s.y1,2)) as n, greatest(0, least(1, ((e.x-s.x1)*(s.x2-s.x1)+(e.y-s.y1)*(s.y2-s.y1)) / (pow(s.x2-s.x1,2)+pow(s.y2-s.y1,2)))) as t
        from free e join seg s on e.line_id <> s.line_id and s.x1 <= e.x + 2 and s.x2 >= e.x - 2 and least(s.y1,s.y2) <= e.y + 2 and greatest(s.y1,s.y2) >= e.y - 2))
      where along > 0.1 and n - along > 0.1) where d > 0.05 and d <= 2.0) where sa <= 18)"""


@query("continuation_candidates", f"with {_FREE}, {_CONT} select source, target, round(distance, 6) as distance, round(sa, 5) as source_angle, round(ta, 5) as target_angle, round(score, 6) as score from cont")
def continuation_candidates(spark, sf):
    free = networks.free_endpoints(A.lines(spark, sf), RULES["snap_tolerance"])
    c = networks.continuation_candidates(free, RULES)
    return c.select("source", "target", F.round("distance", 6).alias("distance"), F.round("source_angle", 5).alias("source_angle"), F.round("target_angle", 5).alias("target_angle"), F.round("score", 6).alias("score"))


@query("junction_candidates", f"with {_FREE}, {_JUNC} select source, target_line, round(tx, 6) as tx, round(ty, 6) as ty, round(distance, 6) as distance, round(score, 6) as score from junc")
def junction_candidates(spark, sf):
    lines = A.lines(spark, sf)
    c = networks.junction_candidates(networks.free_endpoints(lines, RULES["snap_tolerance"]), lines, RULES)
    return c.select("source", "target_line", F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"), F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


_ALL = f"""{_FREE}, {_CONT}, {_JUNC}, cand as (select row_number() over (order by kind, source, target, target_line) as key, *, (sx+tx)/2 as mx, (sy+ty)/2 as my, (tx-sx)/distance as ux, (ty-sy)/distance as uy from (select * from cont union all select * from junc)),
  pairs as (select a.key as a, b.key as b from cand a join cand b on a.kind = 'continuation' and b.kind = 'continuation' and a.key < b.key and a.source <> b.source and a.target <> b.target
    and sqrt(pow(a.mx-b.mx,2)+pow(a.my-b.my,2)) between 0.0500000000001 and 6 and abs(a.distance-b.distance) <= 0.75 and abs(a.ux*b.ux+a.uy*b.uy) >= cos(radians(5))),
  backed as (select a as key from pairs union select b from pairs),
  c as (select cand.* exclude (score), backed.key is not null as support, case when backed.key is not null then least(1, score + 0.08) else score end as score from cand left join backed using (key)),
  elig as (select key, kind, source, target_line, distance, support, score, source as spot from c where score >= 0.58 union all select key, kind, source, target_line, distance, support, score, target from c where score >= 0.58 and target is not null),
  ranked as (select *, row_number() over w as r, first_value(score) over w as best from elig window w as (partition by spot order by score desc, support desc, (kind = 'continuation') desc, distance, source, target_line)),
  short as (select key, count(*) as n from ranked where r <= 3 and best - score <= 0.12 group by 1),
  acc as (select c.* from c join short using (key) where n = case when target is null then 1 else 2 end),
  used as (select spot, count(*) as n from (select source as spot from acc union all select target from acc where target is not null) group by 1),
  accepted as (select acc.*, (coalesce(us.n, 0) > 1 or coalesce(ut.n, 0) > 1) as fan from acc left join used us on us.spot = acc.source left join used ut on ut.spot = acc.target),
  rest as (select *, row_number() over (partition by source order by score desc, support desc, (kind = 'continuation') desc, distance, source, target_line) as r from c where score >= 0.38 and key not in (select key from acc))"""


@query(
    "select_candidates",
    f"with {_ALL} select 'accepted' as decision, kind, source, target_line, round(score, 6) as score, support as parallel_support, fan from accepted union all select 'review', kind, source, target_line, round(score, 6), support, false from rest where r = 1",
)
def select_candidates(spark, sf):
    s = networks.reconstruct(A.lines(spark, sf), RULES)
    return s.select("decision", "kind", "source", "target_line", F.round("score", 6).alias("score"), "parallel_support", "fan")


@query("completed_network", f"with {_ALL} select false as inferred, count(*) as n from seg union all select true, count(*) from accepted having count(*) > 0")
def completed_network(spark, sf):
    lines = A.lines(spark, sf)
    return networks.completed(lines, networks.reconstruct(lines, RULES)).groupBy("inferred").agg(F.count(F.lit(1)).alias("n"))


_BIP = """nodes as (select distinct l_suppkey as id from lineitem where l_quantity > 45 union select distinct 1000000 + l_partkey from lineitem where l_quantity > 45),
  e as (select l_suppkey as a, 1000000 + l_partkey as b from lineitem where l_quantity > 45 and l_linenumber = 1), b as (select a, b from e union select b, a from e)"""


@query(
    "components",
    f"with recursive {_BIP}, walk(id, root) as (select id, id from nodes union select b.b, w.root from walk w join b on b.a = w.id) select component, count(*) as n from (select id, min(root) as component from walk group by 1) group by 1",
)
def components(spark, sf):
    l = A.table(spark, sf, "lineitem").filter("l_quantity > 45")  # noqa: E741
    nodes = l.select(F.col("l_suppkey").alias("id")).unionByName(l.select((F.col("l_partkey") + 1000000).alias("id"))).distinct()
    edges = l.filter("l_linenumber = 1").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b"))
    return graph.components(edges, nodes).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


_LINKS = f"{_EPS}, {_touch(1.0)}, link as (select distinct line_id as a, other as b from touch where d <= 1.0), both_ as (select a, b from link union select b, a from link)"


@query(
    "line_components",
    f"with recursive {_LINKS}, walk(id, root) as (select line_id, line_id from seg union select b, root from walk join both_ on a = id), lab as (select id, min(root) as component from walk group by 1) select size, count(*) as components, round(sum(length), 4) as length from (select component, count(*) as size, sum(sqrt(pow(x2-x1,2)+pow(y2-y1,2))) as length from lab join seg on id = line_id group by 1) group by 1",
)
def line_components(spark, sf):
    lines = A.lines(spark, sf)
    shapes = graph.component_shapes(lines, graph.line_components(lines, 1.0))
    return shapes.groupBy("size").agg(F.count(F.lit(1)).alias("components"), F.round(F.sum("length"), 4).alias("length"))


_NODE = f"{_EPS}, node as (select *, cast(floor(x / 3.0 + 0.5) as bigint) as kx, cast(floor(y / 3.0 + 0.5) as bigint) as ky from ends)"


@query("node_means", f"with {_NODE} select kx, ky, round(avg(x), 6) as x, round(avg(y), 6) as y, count(*) as degree from node group by 1, 2")
def node_means(spark, sf):
    return graph.node_means(A.lines(spark, sf), 3.0).select("kx", "ky", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "degree")


@query(
    "degree_classes",
    f"""with recursive {_NODE}, places as (select line_id, kx * 1000003 + ky as n from node), edge as (select a.n as a, b.n as b from places a join places b on a.line_id = b.line_id and a.n <> b.n),
    walk(id, root) as (select distinct n, n from places union select b, root from walk join edge on a = id), lab as (select id, min(root) as c from walk group by 1), deg as (select n, count(*) as d from places group by 1),
    k as (select c, case when max(d) > 2 then 'branched' when min(d) = 2 then 'closed' else 'open' end as kind, count(*) as nodes, count(*) filter (where d = 1) as ends from deg join lab on id = n group by 1)
    select kind, count(*) as components, cast(sum(nodes) as bigint) as nodes, cast(sum(ends) as bigint) as ends from k group by 1""",
)
def degree_classes(spark, sf):
    d = graph.degree_class(A.lines(spark, sf), 3.0)
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("components"), F.sum("nodes").alias("nodes"), F.sum("ends").alias("ends"))


_NP = f"""{_NODE}, np as (select a.line_id as a, b.line_id as b, degrees(acos(greatest(-1, least(1, a.ox*b.ox+a.oy*b.oy)))) as angle, a.n as an, b.n as bn from (select node.*, sqrt(pow(x2-x1,2)+pow(y2-y1,2)) as n from node join seg using (line_id)) a
   join (select node.*, sqrt(pow(x2-x1,2)+pow(y2-y1,2)) as n from node join seg using (line_id)) b on a.kx = b.kx and a.ky = b.ky and a.line_id < b.line_id)"""


@query("arrowheads", f"with {_NP}, v as (select a, b from np where greatest(an, bn) <= 14 and least(an, bn) >= 0.65 * greatest(an, bn) and angle between 12 and 75) select a as line_id from v union select b from v")
def arrowheads(spark, sf):
    return graph.arrowheads(A.lines(spark, sf), 3.0)


@query("straight_continuations", f"with {_NP}, v as (select a, b from np where angle >= 150) select a as line_id from v union select b from v")
def straight_continuations(spark, sf):
    return graph.continuations(A.lines(spark, sf), 3.0)


_CLEAN = f"""{_LINKS}, node as (select *, cast(floor(x + 0.5) as bigint) as kx, cast(floor(y + 0.5) as bigint) as ky from ends), len as (select *, sqrt(pow(x2-x1,2)+pow(y2-y1,2)) as n from seg),
  np as (select a.line_id as a, b.line_id as b, degrees(acos(greatest(-1, least(1, a.ox*b.ox+a.oy*b.oy)))) as angle, la.n as an, lb.n as bn from node a join node b on a.kx = b.kx and a.ky = b.ky and a.line_id < b.line_id join len la on la.line_id = a.line_id join len lb on lb.line_id = b.line_id),
  v as (select a, b from np where greatest(an, bn) <= 14 and least(an, bn) >= 0.65 * greatest(an, bn) and angle between 12 and 75), heads as (select a as line_id from v union select b from v),
  linked as (select t.line_id from touch t join len s on s.line_id = t.other join len o on o.line_id = t.line_id where t.d <= 1.0 and s.n >= 9 and o.n <= 10 group by t.line_id having count(distinct t.id) = 2),
  walk(id, root) as (select line_id, line_id from seg union select b, root from walk join both_ on a = id), lab as (select id, min(root) as c from walk group by 1),
  shape as (select c, sum(n) as total, sqrt(pow(max(greatest(x1,x2))-min(least(x1,x2)),2)+pow(max(greatest(y1,y2))-min(least(y1,y2)),2)) as span from lab join len on id = line_id group by 1),
  r as (select n, case when h.line_id is not null and n < 9 then 'rejected_arrowhead' when n < 0.4 then 'rejected_too_short' when n >= 9 then 'accepted_straight' when k.line_id is not null then 'accepted_connector' when total >= 20 and span >= 15 then 'accepted_component' else 'review_isolated' end as reason
    from len join lab on id = len.line_id join shape using (c) left join heads h on h.line_id = len.line_id left join linked k on k.line_id = len.line_id)"""


@query("clean_reasons", f"with recursive {_CLEAN} select reason, case when starts_with(reason, 'accepted_') then 'accepted' when starts_with(reason, 'review_') then 'manual_review' else 'rejected' end as decision, count(*) as n, round(sum(n), 4) as length from r group by 1, 2")
def clean_reasons(spark, sf):
    rules = {**networks.CLEANING, "connect": 1.0, "seed": 9.0}
    return networks.clean(A.lines(spark, sf), rules).groupBy("reason", "decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length"), 4).alias("length"))


@query(
    "merged_chains",
    f"""with recursive {_NODE}, thru as (select min(line_id) as a, max(line_id) as b from node group by kx, ky having count(*) = 2 and min(line_id) <> max(line_id)), both_ as (select a, b from thru union select b, a from thru),
    walk(id, root) as (select line_id, line_id from seg union select b, root from walk join both_ on a = id), lab as (select id, min(root) as chain from walk group by 1)
    select chain, round(sum(sqrt(pow(x2-x1,2)+pow(y2-y1,2))), 6) as length, count(*) as lines from lab join seg on id = line_id group by 1""",
)
def merged_chains(spark, sf):
    return graph.merged_chains(A.lines(spark, sf), 3.0).select("chain", F.round("length", 6).alias("length"), "lines")


def _arrows(spark, sf):
    x, y = A._xy("s_suppkey")
    s = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("arrow_id"), F.col("s_suppkey").alias("node_id"), x.alias("x"), y.alias("y"), F.radians((F.col("s_suppkey") * 37 % 360).cast("double")).alias("g"))
    return s.select("arrow_id", "node_id", "x", "y", F.cos("g").alias("dx"), F.sin("g").alias("dy"))


_ROUTE = f"""ar as (select s_suppkey as id, {A._xy_sql('s_suppkey')[0]} as x, {A._xy_sql('s_suppkey')[1]} as y, radians(cast(s_suppkey * 37 % 360 as double)) as g from supplier),
  hit as (select id, target, dist + 2 * ang + 5 * lat as cost, ang, dist from (select a.id, b.id as target, sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)) as dist, abs((b.x-a.x)*sin(a.g)-(b.y-a.y)*cos(a.g)) as lat, (b.x-a.x)*cos(a.g)+(b.y-a.y)*sin(a.g) as along,
     degrees(acos(greatest(-1, least(1, ((b.x-a.x)*cos(a.g)+(b.y-a.y)*sin(a.g)) / sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)))))) as ang from ar a join ar b on a.id <> b.id) where along > 0 and dist between 6 and 500 and ang <= 7 and lat <= 3 + 0.005 * dist),
  best as (select * from (select *, row_number() over (partition by id order by cost, target) as r from hit) where r = 1)"""


@query("overhead_best_targets", f"with {_ROUTE} select id as arrow_id, target, round(ang, 5) as angle, round(dist, 6) as distance from best")
def overhead_best_targets(spark, sf):
    b = networks.best_targets(_arrows(spark, sf), _arrows(spark, sf).select("node_id", "x", "y"), lateral=3.0)
    return b.select("arrow_id", "target", F.round("angle", 5).alias("angle"), F.round("distance", 6).alias("distance"))


@query("overhead_routes", f"with {_ROUTE}, r as (select least(id, target) as a, greatest(id, target) as b, exists (select 1 from best o where o.id = best.target and o.target = best.id) as rec from best) select a, b, case when bool_or(rec) then 'reciprocal' else 'one_sided' end as kind from r group by 1, 2")
def overhead_routes(spark, sf):
    b = networks.best_targets(_arrows(spark, sf), _arrows(spark, sf).select("node_id", "x", "y"), lateral=3.0)
    return networks.routes(b).select("a", "b", "kind")


@query(
    "route_labels",
    f"with {A.PTS}, {A.SEG}, l as (select * from pts where kind = 'tree'), d as (select id, line_id, {A.PSD} as d from (select p.id, p.x, p.y, s.*, greatest(0, least(1, ((p.x-s.x1)*(s.x2-s.x1)+(p.y-s.y1)*(s.y2-s.y1)) / (pow(s.x2-s.x1,2)+pow(s.y2-s.y1,2)))) as t from l p join seg s on s.x1 <= p.x + 8 and s.x2 >= p.x - 8 and least(s.y1,s.y2) <= p.y + 8 and greatest(s.y1,s.y2) >= p.y - 8)) select id as label_id, line_id as route_id, round(d, 6) as distance from (select *, row_number() over (partition by id order by d, line_id) as r from d where d <= 8) where r = 1",
)
def route_labels(spark, sf):
    l = A.points(spark, sf).filter("kind = 'tree'").select(F.col("id").alias("label_id"), "x", "y")  # noqa: E741
    return networks.label_routes(l, A.lines(spark, sf).withColumnRenamed("line_id", "route_id")).select("label_id", "route_id", F.round("distance", 6).alias("distance"))


@query(
    "dash_runs",
    """with s as (select user_id, value as lo, value + 2 as hi from events), m as (select *, max(hi) over (partition by user_id order by lo, hi rows between unbounded preceding and 1 preceding) as reach from s),
    r as (select *, sum(case when reach is null or lo - reach > 1.0 then 1 else 0 end) over (partition by user_id order by lo, hi rows between unbounded preceding and current row) as run from m)
    select user_id, cast(run as bigint) as run, min(lo) as lo, max(hi) as hi, count(*) as strokes from r group by 1, 2""",
)
def dash_runs(spark, sf):
    s = A.table(spark, sf, "events").select("user_id", F.col("value").alias("lo"), (F.col("value") + 2).alias("hi"))
    return verify.runs(s, ["user_id"], "lo", "hi", 1.0)


@query("endpoint_touch_pairs", f"with {_LINKS} select least(a, b) as a, greatest(a, b) as b from link group by 1, 2")
def endpoint_touch_pairs(spark, sf):
    return graph.touching_lines(A.lines(spark, sf), 1.0)


