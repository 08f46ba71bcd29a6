"""Joins by distance in arrays against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placewright.functions import checks as C
from placewright.functions import geometry as G
from placewright.operators import blocks, graph, grid, learning, networks, planning, rules
from placewright.queries import QUERIES

from .conftest import SF

LINE = "line_id long, x1 double, y1 double, x2 double, y2 double"


def crowd(spark, n=400, side=15.0):
    draw = random.Random(5)
    rows = [(i, draw.uniform(-side, side), draw.uniform(-side, side), draw.choice(["tree", "shrub", "herbaceous"]), draw.choice([2.0, 4.0]), draw.choice([0.5, 3.0]), 1.5, draw.choice([None, 1.0]), draw.choice([None, True, False])) for i in range(n)]
    rows += [(n + i, 1.0, 1.0, "tree", 2.0, 0.5, 1.5, 1.0, False) for i in range(30)] + [(n + 99, math.nan, 0.0, "tree", 2.0, 0.5, 1.5, 1.0, False)]
    return spark.createDataFrame(rows, "id long, x double, y double, kind string, spacing double, footprint double, avoid double, trunk double, under_canopy boolean")


@pytest.mark.parametrize("same", [True, False])
def test_pair_totals(spark, same):
    p = crowd(spark)
    a, b = p.alias("a"), p.alias("b")
    prof = lambda t: F.struct(F.col(t + ".kind").alias("plant_type"), *(F.col(f"{t}.{c}") for c in ("spacing", "footprint", "avoid", "trunk", "under_canopy")))
    d = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    kinds = F.col("a.kind") == F.col("b.kind")
    pairs = a.join(b, (F.col("a.id") < F.col("b.id")) & (kinds if same else ~kinds)).withColumn("lack", C.required_spacing(prof("a"), prof("b")) - d).filter((F.col("lack") > 1e-7) & (d <= 6))
    want = pairs.groupBy(F.least("a.kind", "b.kind").alias("one"), F.greatest("a.kind", "b.kind").alias("two")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lack"), 6).alias("deficit"))
    got = blocks.pair_totals(p.drop("id"), 6.0, blocks.profiles, same).withColumn("deficit", F.round("deficit", 6))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 3


@pytest.mark.parametrize("name", ["dense_spacing_same_type", "dense_spacing_cross_type"])
def test_dense_pairs_never_leave_their_cell(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan


def drawing(spark, n=300):
    draw = random.Random(7)
    at = [(draw.uniform(-20, 20), draw.uniform(-20, 20)) for _ in range(n)]
    rows = [(i, x, y, x + draw.uniform(-9, 9), y + draw.uniform(-9, 9)) for i, (x, y) in enumerate(at)] + [(n, 0.0, 0.0, 0.0, 0.0), (n + 1, 0.0, 0.0, 5.0, 0.0)]
    return spark.createDataFrame(rows, LINE)


def met(spark, net, r):
    """(id, line_id, other) of every end and other line within r, by all pairs."""
    other = net.select(F.col("line_id").alias("other"), "x1", "y1", "x2", "y2")
    d = G.point_segment_distance(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    return graph.endpoints(net).crossJoin(other).filter((F.col("line_id") != F.col("other")) & (d <= r))


def test_touching_lines(spark):
    net = drawing(spark)
    want = met(spark, net, 0.3).select(F.least("line_id", "other").alias("a"), F.greatest("line_id", "other").alias("b")).distinct()
    got = graph.touching_lines(net, 0.3)
    assert sorted(got.collect()) == sorted(want.collect())  # as a list: no pair twice
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    free = {r.id for r in graph.endpoints(net).collect()} - {r.id for r in met(spark, net, 0.3).collect()}
    assert {r.id for r in networks.free_endpoints(net, 0.3).collect()} == free
    all_edges = graph.components(want, net.select(F.col("line_id").alias("id")))
    assert sorted(graph.line_components(net, 0.3).collect()) == sorted(all_edges.collect())


def test_forest_has_few_edges(spark):
    net = spark.createDataFrame([(i, 0.0, 0.0, 1.0 + i, 1.0) for i in range(80)], LINE)
    assert graph.touching_lines(net, 0.1).count() == 80 * 79 // 2
    assert blocks.touching_forest(graph.endpoints(net), net, 0.1).count() <= 79 * 9


def test_contracted_edges_keep_components(spark):
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 7).alias("b")).coalesce(1)
    few = graph._contracted(edges.unionByName(edges).coalesce(1))
    assert few.count() == 3000 and graph.components(edges).select("component").distinct().count() == 7


def test_junctions(spark):
    net, rules = drawing(spark), networks.scaled(networks.RULES, 1.0)
    free = networks.free_endpoints(net, 0.05)
    rows = met(spark, net, 2.0).join(free.select("id"), "id", "left_semi").collect()
    want = set()
    for r in rows:
        dx, dy = r.x2 - r.x1, r.y2 - r.y1
        n = math.hypot(dx, dy)
        t = 0.0 if n == 0 else max(0.0, min(1.0, ((r.x - r.x1) * dx + (r.y - r.y1) * dy) / n**2))
        tx, ty = r.x1 + t * dx, r.y1 + t * dy
        d = math.hypot(tx - r.x, ty - r.y)
        if t * n > 0.1 and n - t * n > 0.1 and d > 0.05 and math.degrees(math.acos(max(-1, min(1, (r.ox * (tx - r.x) + r.oy * (ty - r.y)) / d)))) <= 18:
            want.add((r.id, r.other, round(tx, 6), round(ty, 6)))
    got = networks.junction_candidates(free, net, rules).collect()
    assert len(got) == len(want) > 0 and {(r.source, r.target_line, round(r.tx, 6), round(r.ty, 6)) for r in got} == want


def test_option_conflicts(spark):
    draw = random.Random(3)
    rows = [(o, o % 5, draw.uniform(0, 30), draw.uniform(0, 30)) for o in range(120) for _ in range(o % 4 + 1)]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) + 1e-9 < 2}
    got = planning.scheme_conflicts(spark.createDataFrame(rows, "option_id long, bed long, x double, y double"), 2.0)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Aggregate [a" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["spacing_failures_cross_type", "spacing_failures_same_type", "isolated_points", "composition_neighbours"])
def test_cells_of_points_are_not_broadcast(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution()
    assert "strategy=merge" in plan.optimizedPlan().toString() or "FlatMap" in plan.optimizedPlan().toString()
    assert "BroadcastHashJoin [cx" not in plan.sparkPlan().toString()


def test_nearest_is_looked_for_from_near_to_far(spark):
    draw = random.Random(9)
    own = [(i, draw.uniform(0, 100), draw.uniform(0, 100)) for i in range(25)]
    others = [(j, draw.uniform(0, 100), draw.uniform(0, 100), draw.choice(["a", "b"])) for j in range(60)] + [(90 + j, 1.0, 1.0, "c") for j in range(3)]
    got = grid.nearest_per_key(spark.createDataFrame(own, "id long, x double, y double"), spark.createDataFrame(others, "rid long, rx double, ry double, key string"), 60.0)
    want = set()
    for i, x, y in own:
        for k in "abc":
            near = sorted((math.hypot(x - rx, y - ry), j) for j, rx, ry, key in others if key == k and math.hypot(x - rx, y - ry) <= 60)
            want |= {(i, k, near[0][1])} if near else set()
    rows = got.collect()
    assert len(rows) == len(want) and {(r.id, r.key, r.rid) for r in rows} == want
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["spacing_failures_cross_type", "spacing_failures_same_type", "composition_neighbours", "continuation_candidates", "region_membership"])
def test_pairs_stay_in_arrays(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "GroupsInArrow" in plan


def test_neighbour_counts(spark):
    p = crowd(spark)
    rows = [r for r in p.collect() if not math.isnan(r.x)]
    near = {k: [(a.id, b.id) for a in rows for b in rows if a.id < b.id and a.kind == b.kind == k and math.hypot(a.x - b.x, a.y - b.y) <= 2.0] for k in ("tree", "shrub", "herbaceous")}
    got = {r.kind: (r.n, r.pairs, r.isolated) for r in planning.neighbour_counts(p.select("id", "x", "y", "kind"), 2.0, "kind").collect()}
    total = {k: p.filter(F.col("kind") == k).count() for k in near}
    assert got == {k: (total[k], len(v), total[k] - len({i for ab in v for i in ab})) for k, v in near.items()}


def test_continuations(spark):
    net, now = drawing(spark), networks.scaled(networks.RULES, 1.0)
    free = networks.free_endpoints(net, 0.05)
    ends, want = free.collect(), set()
    for a in ends:
        for b in ends:
            d = math.hypot(a.x - b.x, a.y - b.y)
            if a.id < b.id and a.line_id != b.line_id and 0.05 < d <= 5.0:
                ux, uy = (b.x - a.x) / d, (b.y - a.y) / d
                turn = [math.degrees(math.acos(max(-1.0, min(1.0, c)))) for c in (a.ox * ux + a.oy * uy, -b.ox * ux - b.oy * uy)]
                want |= {(a.id, b.id, round(d, 6))} if max(turn) <= 12 else set()
    got = networks.continuation_candidates(free, now)
    assert sorted((r.source, r.target, round(r.distance, 6)) for r in got.collect()) == sorted(want) and want
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_few_edges_are_labelled_in_one_task(spark):
    edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 7).alias("b"))
    one, rounds = graph._labels(edges), graph._labels(edges, rows=10)
    assert sorted(one.collect()) == sorted(rounds.collect()) and one.count() == 407
    assert "Union" in graph.components(edges)._jdf.queryExecution().optimizedPlan().toString()


def test_both_ends_touch(spark):
    net = drawing(spark)
    near = {(r.line_id, r.end) for r in graph.endpoints(net).crossJoin(net.filter("line_id < 60").select("x1", "y1", "x2", "y2")).filter(G.point_segment_distance(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))) <= 0.4).collect()}
    got = graph.both_ends_touch(net, net.filter("line_id < 60"), 0.4)
    assert sorted(r.line_id for r in got.collect()) == sorted(i for i in range(302) if {(i, 0), (i, 1)} <= near)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_features_in_arrays(spark):
    net = drawing(spark)
    at = {(r.id, r.line_id): (r.x, r.y, r.ox, r.oy) for r in graph.endpoints(net).collect()}
    degree, best = {}, {}
    for (a, la), (x, y, u, v) in at.items():
        for (_, lb), (x2, y2, u2, v2) in at.items():
            if la != lb and math.hypot(x - x2, y - y2) <= 1.0:
                degree.setdefault(a, set()).add(lb)
                best[la] = max(best.get(la, 0.0), (1 - (u * u2 + v * v2)) / 2)
    long = net.withColumn("length", graph.length_of())
    side = lambda p: long.select(*(F.col(c).alias(p + c) for c in long.columns))
    c = lambda p, e: [F.col(f"{p}x{e}"), F.col(f"{p}y{e}")]
    reach = F.least(*(G.point_segment_distance(*c(p, e), *c(q, 1), *c(q, 2)) for p, q in ("ab", "ba") for e in (1, 2)))
    turn = lambda p, q, e: (c(p, 2)[0] - c(p, 1)[0]) * (c(q, e)[1] - c(p, 1)[1]) - (c(p, 2)[1] - c(p, 1)[1]) * (c(q, e)[0] - c(p, 1)[0])
    meets = (turn("a", "b", 1) * turn("a", "b", 2) < 0) & (turn("b", "a", 1) * turn("b", "a", 2) < 0)
    near = {r.line_id: r.n for r in side("a").crossJoin(side("b")).filter("aline_id <> bline_id").filter((reach <= 1.0) | meets).groupBy(F.col("aline_id").alias("line_id")).agg(F.count(F.lit(1)).alias("n")).collect()}
    f = learning.features(net, 1.0)
    for r in f.collect():
        assert (r.start_degree, r.end_degree) == tuple(len(degree.get(r.line_id * 2 + e, ())) for e in (0, 1))
        assert abs(r.best_continuation - best.get(r.line_id, 0.0)) < 1e-9 and r.nearby == near.get(r.line_id, 0)
    assert f._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") >= 2


def test_region_of_repeated_points(spark):
    edge = [(1, 0.0, 0.0, 60.0, 0.0), (1, 60.0, 0.0, 60.0, 30.0), (1, 60.0, 30.0, 0.0, 30.0), (1, 0.0, 30.0, 0.0, 0.0), (2, 10.0, 10.0, 90.0, 20.0), (2, 90.0, 20.0, 10.0, 20.0), (2, 10.0, 20.0, 10.0, 10.0)]
    edges = spark.createDataFrame(edge, "region_id long, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(7, 5.0, 5.0, "a"), (7, 5.0, 5.0, "a"), (8, 85.0, 19.8, "b"), (9, 85.0, 5.0, "c"), (10, math.nan, 5.0, "d"), (11, -1.0, 5.0, "e")], "id long, x double, y double, name string")
    assert sorted((r.id, r.name) for r in rules.in_region(points, edges).collect()) == [(7, "a"), (7, "a"), (8, "b")]


def test_training_reads_kept_features(spark, monkeypatch):
    kept, keep = [], graph._checkpoint
    monkeypatch.setattr(graph, "_checkpoint", lambda df: kept.append(df.columns) or keep(df))
    monkeypatch.setattr(learning, "train", lambda *a, **b: None)
    monkeypatch.setattr(learning, "probabilities", lambda model, rows: rows.withColumn("probability", F.lit(0.5)))
    assert QUERIES["forest_classifier"](spark, SF).count() == 1
    assert [c for c in kept if "tile" in c]


def broken_crowd(spark):
    """A crowd, lines whose inside only touches it, pairs apart and a line without one end."""
    draw = random.Random(11)
    at = lambda k, x, y, r: (k, x, y, x + draw.uniform(-r, r), y + draw.uniform(-r, r))
    rows = [at(i, draw.uniform(0, 12), draw.uniform(0, 12), 3) for i in range(300)]
    rows += [at(300 + i, draw.uniform(-60, 60), draw.uniform(-60, 60), 6) for i in range(150)]
    rows += [(450 + i, 20.0 + 3 * i, -30.0, 20.0 + 3 * i, 30.0) for i in range(6)] + [(460, 21.0, 0.0, 22.7, 0.0), (461, 22.9, 5.0, 22.9, 5.0)]
    return spark.createDataFrame(rows, LINE)


@pytest.mark.parametrize("r", [0.0, 0.4, 1.0])
def test_forests_of_a_broken_crowd(spark, r):
    net = broken_crowd(spark)
    own = net.select(F.col("line_id").alias("id"))
    touch = graph.components(met(spark, net, r).select(F.col("line_id").alias("a"), F.col("other").alias("b")), own)
    assert sorted(graph.line_components(net, r).collect()) == sorted(touch.collect())
    ends = graph.endpoints(net)
    a, b = ends.alias("a"), ends.alias("b")
    near = a.join(b, (F.col("a.line_id") < F.col("b.line_id")) & (G.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) <= r)).select(F.col("a.line_id").alias("a"), F.col("b.line_id").alias("b"))
    want, got = graph.components(near, own), graph.components(blocks.end_forest(ends, r), own)
    assert sorted(got.collect()) == sorted(want.collect())


def test_stars_are_labelled_by_their_roots(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i % 20, 20 + i) for i in range(400)] + [(draw.randrange(10), 20 + i) for i in range(0, 400, 20)] + [(500 + i, 7) for i in range(3)]
    edges = spark.createDataFrame(rows, "a long, b long")
    want = graph._labels(edges).collect()
    kept, keep = [], graph._checkpoint
    monkeypatch.setattr(graph, "_checkpoint", lambda df: kept.append(df) or keep(df))
    assert sorted(graph._labels(edges, rows=30).collect()) == sorted(want) and len(kept) <= 3


def test_forest_has_the_size_of_the_method(spark, monkeypatch):
    class Stop(Exception):
        pass

    def forest(**given):
        raise Stop(given["numTrees"], given["maxDepth"], given["minInstancesPerNode"])

    monkeypatch.setattr(learning, "RandomForestClassifier", forest)
    with pytest.raises(Stop) as stopped:
        QUERIES["forest_classifier"](spark, SF)
    assert stopped.value.args == (350, 18, 2)
