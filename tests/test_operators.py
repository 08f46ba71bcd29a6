"""Golden cases and brute-force comparisons of the engine's operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placewright.functions import checks as C
from placewright.functions import geometry as G
from placewright.operators import areas, graph, grid, learning, networks, planning, rules, verify
from placewright.plans import placement
from placewright.sources import catalog

LINE = "line_id long, x1 double, y1 double, x2 double, y2 double"
RULES = networks.scaled(networks.RULES, 1.0)


def lines(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], LINE)


def test_continuation(spark):
    got = networks.reconstruct(lines(spark, (0, 0, 10, 0), (12, 0, 20, 0)), RULES).collect()
    assert [(r.kind, r.decision, r.sx, r.sy, r.tx, r.ty) for r in got] == [("continuation", "accepted", 10, 0, 12, 0)]


def test_parallel_gaps_support_each_other(spark):
    got = networks.reconstruct(lines(spark, (0, 0, 10, 0), (12, 0, 20, 0), (0, 2, 10, 2), (12, 2, 20, 2)), RULES).collect()
    assert len(got) == 2 and all(r.parallel_support and r.decision == "accepted" for r in got)


def test_junction(spark):
    got = networks.reconstruct(lines(spark, (5, -5, 5, -1), (0, 0, 10, 0)), RULES).collect()
    assert [(r.kind, r.sx, r.sy, r.tx, r.ty) for r in got] == [("junction", 5, -1, 5, 0)]


def test_scaled_rules():
    assert networks.scaled(networks.RULES, 1000.0)["max_gap"] == 5000.0
    for wrong in ({"max_angle_deg": 0}, {"review_score": 0.9}):
        with pytest.raises(ValueError):
            networks.scaled(networks.RULES, 1.0, wrong)


def test_clean_chain_and_noise(spark):
    got = {r.line_id: r.decision for r in networks.clean(lines(spark, (0, 0, 10, 0), (10, 0, 25, 0), (50, 50, 50.1, 50))).collect()}
    assert got == {0: "accepted", 1: "accepted", 2: "rejected"}


def test_components_and_degrees(spark):
    net = lines(spark, (0, 0, 4, 0), (4, 0, 8, 0), (20, 20, 24, 20))
    assert {r.id: r.component for r in graph.line_components(net, 0.2).collect()} == {0: 0, 1: 0, 2: 2}
    square = lines(spark, (0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0), (10, 0, 12, 0), (12, 0, 14, 0), (12, 0, 12, 3))
    assert sorted((r.kind, r.ends) for r in graph.degree_class(square, 0.01).collect()) == [("branched", 3), ("closed", 0)]
    assert sorted((r.lines, r.length) for r in graph.merged_chains(net, 0.01).collect()) == [(1, 4.0), (2, 8.0)]


def test_arrowhead(spark):
    v = lines(spark, (0, 0, 3, 1), (0, 0, 3, -1), (-20, 0, 0, 0))
    assert {r.line_id for r in graph.arrowheads(v, 0.1).collect()} == {0, 1}
    assert {r.line_id for r in graph.continuations(v, 0.1).collect()} == {0, 1, 2}


def test_reciprocal_arrows(spark):
    arrows = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, 0.0), (1, 1, 20.0, 0.0, -1.0, 0.0), (2, 2, 0.0, 30.0, 1.0, 0.0)], "arrow_id long, node_id long, x double, y double, dx double, dy double")
    best = networks.best_targets(arrows, arrows.select("node_id", "x", "y"))
    assert [(r.a, r.b, r.kind) for r in networks.routes(best).collect()] == [(0, 1, "reciprocal")]


def test_detected_arrow(spark):
    tips = spark.createDataFrame([(9, 2.5, 0.0)], "rid long, rx double, ry double")
    got = networks.detect_arrows(lines(spark, (0, 0, 2.5, 0), (0, 9, 9, 9)), tips, 0.1).collect()
    assert [(r.x, r.y, r.dx, r.dy) for r in got] == [(0, 0, 1, 0)]


def test_spacing_failures(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, "tree", 0.0, 0.1), (1, 9.0, 0.0, "tree", 0.0, 10.0), (2, 19.0, 0.0, "tree", 0.0, 0.1)], "id long, x double, y double, kind string, spacing double, footprint double")
    assert grid.spacing_failures(p).count() == 2


def random_points(n, seed=451):
    rng = random.Random(seed)
    return [(i, rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 120])
def test_grid_join_equals_all_pairs(spark, n):
    pts = random_points(n)
    got = {(r.a_id, r.b_id) for r in grid.self_pairs(spark.createDataFrame(pts, "id long, x double, y double"), 5.0).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and math.dist(a[1:], b[1:]) <= 5.0}


def test_pack_equals_sequential_greedy(spark):
    pts = random_points(400, 7)
    taken = []
    for p in pts:
        if all(math.dist(p[1:], q[1:]) ** 2 + 1e-9 >= 16 for q in taken):
            taken.append(p)
    df = spark.createDataFrame(pts, "id long, x double, y double")
    assert [r.id for r in planning.pack(df, 4.0).orderBy("id").collect()] == [p[0] for p in taken]
    assert [r.id for r in planning.pack(df, 4.0, 10).orderBy("id").collect()] == [p[0] for p in taken[:10]]


def test_optimizer(spark):
    options = spark.createDataFrame([(0, 0, 3, 5.0, 0), (1, 0, 2, 3.0, 0), (2, 1, 2, 3.0, 0)], "option_id long, bed int, n int, score double, site int")
    conflicts = spark.createDataFrame([(0, 2)], "a long, b long")
    got = planning.optimize_layouts(options, conflicts, 4).collect()
    assert sorted(r.option_id for r in got) == [1, 2] and {r.status for r in got} == {"OPTIMAL"}
    chosen, status = planning._solve([5, 4, 3], [2, 2, 2], [0, 1, 2], set(), 4)
    assert (chosen, status) == ([0, 1], "OPTIMAL")


def test_suppression(spark):
    boxes = spark.createDataFrame([(1, 5.0, 0.0, 0.0, 10.0, 10.0), (2, 4.0, 1.0, 1.0, 10.0, 10.0), (3, 3.0, 50.0, 50.0, 60.0, 60.0)], "id long, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.id for r in planning.suppress(boxes).collect()) == [1, 3]


def test_fragments(spark):
    rows = [(i, i * 1.0, 0.0, 0) for i in range(6)] + [(10 + i, 100 + i, 0.0, 0) for i in range(3)]
    df = spark.createDataFrame([(i, float(x), y, g) for i, x, y, g in rows], "id long, x double, y double, scheme int")
    assert planning.prune_fragments(df, 1.0, "scheme").count() == 6


ZONE = [np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)]


def test_zone_areas():
    strip = lambda w: [np.array([[5 - w, -1], [5 + w, -1], [5 + w, 11], [5 - w, 11]], float)]
    assert abs(areas.difference_area(ZONE, strip(1)) - 80) < 1e-9 and abs(areas.difference_area(ZONE, strip(2)) - 60) < 1e-9
    assert abs(areas.intersection_area(ZONE, strip(1)) - 20) < 1e-9
    hard = [np.array([[0, 0], [2, 0], [2, 10], [0, 10]], float)]
    walk = [np.array([[8, 0], [10, 0], [10, 10], [8, 10]], float)]
    house = [np.array([[3, 3], [5, 3], [5, 5], [3, 5]], float)]
    well = [np.array([[6, 6], [7, 6], [7, 7], [6, 7]], float)]
    assert abs(areas.difference_area(ZONE, hard, walk, house, well) - 55) < 1e-9


def test_areas_against_samples():
    rng = np.random.default_rng(810)
    for _ in range(10):
        a, b = ([rng.uniform(0, 10, (3, 2))] for _ in range(2))
        pts = rng.uniform(0, 10, (40000, 2))

        def inside(r):
            x, y = pts[:, 0], pts[:, 1]
            hit = np.zeros(len(pts), bool)
            for (x1, y1), (x2, y2) in zip(r[0], np.roll(r[0], -1, 0)):
                hit ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            return hit

        assert abs(areas.intersection_area(a, b) - 100 * (inside(a) & inside(b)).mean()) < 0.8


def test_faces_and_closing(spark):
    cross = np.array([[0, 0, 10, 0], [10, 0, 10, 10], [10, 10, 0, 10], [0, 10, 0, 0], [5, 0, 5, 10], [20, 0, 30, 0]], float)
    assert sorted(round(areas.ring_area(f), 6) for f in areas.polygonize(cross)) == [50, 50]
    gap = np.array([[0.05, 0], [10, 0], [10, 10], [0, 10], [0, 0]], float)
    assert areas.close_chain(gap)[1] == "closed" and abs(areas.ring_area(areas.close_chain(gap)[0]) - 100) < 0.5
    three = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert areas.close_chain(three)[1] == "orthogonal_missing_wall"
    assert areas.close_chain(np.array([[0, 0], [10, 0], [20, 5]], float))[1] == "open"
    df = spark.createDataFrame([(0, *map(float, r)) for r in cross], "component long, x1 double, y1 double, x2 double, y2 double")
    got = areas.faces(df).collect()
    assert sorted(round(r.area) for r in got) == [50, 50] and all(round(r.width) == 5 and round(r.length) == 10 for r in got)
    assert areas.linear_reference(np.array([[0, 0], [40, 0], [40, 4], [0, 4]], float), 6.0)[1] == pytest.approx(40)
    assert areas.linear_reference(ZONE[0], 6.0) is None
    assert areas.bands(np.array([[0, 0], [40, 0], [40, 4], [0, 4]], float), [0.25, 0.75])[0] == pytest.approx(10, abs=1e-6)


def test_rule_states_and_checks(spark):
    rule_rows = spark.createDataFrame([("R1", "tree", "gas_pipe", "min_distance", 2.0, None, 1), ("R2", "tree", "gas_pipe", "min_distance", 3.0, None, 1), ("R3", "tree", "lost", "min_distance", 1.5, None, 1)], catalog.RULE)
    for units in (1.0, 1000.0):
        target = spark.createDataFrame([("gas_pipe", 0.0, -50.0 * units, 0.0, 50.0 * units, "cleaned_high_confidence_geometry")], "target_type string, x1 double, y1 double, x2 double, y2 double, source string")
        trees = spark.createDataFrame([(1, 1.0 * units, 0.0), (2, 9.0 * units, 0.0)], "id long, x double, y double")
        a = rules.audit(trees, rule_rows, target, units)
        assert {(r.id, r.rule_code): r.status for r in a.collect()} == {(1, "R1"): "conflict", (1, "R2"): "conflict", (1, "R3"): "unavailable", (2, "R1"): "passed", (2, "R2"): "passed", (2, "R3"): "unavailable"}
        assert {r.id: r.status for r in rules.audit_status(a).collect()} == {1: "conflict", 2: "incomplete"}
        roll = {(r.scope, r.name): r.n for r in rules.audit_rollup(a).collect()}
        assert roll["target", "gas_pipe"] == 1 and roll["rule", "R1"] == 1 and roll["rule", "R2"] == 1
    raw = target.withColumn("source", F.lit("normalized_raw_geometry"))
    states = {r.rule_code: (r.state, r.required) for r in rules.rule_states(rule_rows, raw).collect()}
    assert states == {"R1": ("manual_review", 2.0), "R2": ("manual_review", 3.0), "R3": ("unavailable", 1.5)}


def test_mixed_canopy_spacing(spark):
    s = "a struct<plant_type:string,spacing:double,footprint:double,avoid:double,trunk:double,under_canopy:boolean>, b struct<plant_type:string,spacing:double,footprint:double,avoid:double,trunk:double,under_canopy:boolean>"
    tree, shrub, plain = ("tree", 6.0, 3.0, 0.5, 1.0, False), ("shrub", 1.5, 0.75, 0.5, None, True), ("shrub", 1.5, 0.75, 0.5, None, False)
    df = spark.createDataFrame([(tree, shrub), (shrub, tree), (tree, plain), (tree, tree), (shrub, plain)], s)
    assert [r[0] for r in df.select(C.required_spacing(F.col("a"), F.col("b"))).collect()] == [1.75, 1.75, 3.75, 6.0, 1.5]


def test_decision_metrics(spark):
    rows = spark.createDataFrame([(1, "accepted", 10.0), (0, "accepted", 5.0), (1, "rejected", 2.0)], "label int, decision string, length double")
    m = learning.decision_metrics(rows, ["accepted"]).first()
    assert (m.precision, m.recall) == (0.5, 0.5) and (m.length_precision, m.length_recall) == (10 / 15, 10 / 12)


def test_classifier(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        x, y = rng.uniform(0, 900), rng.uniform(0, 900)
        n = rng.uniform(8, 14) if i % 2 else rng.uniform(0.3, 1.5)
        rows.append((i, x, y, x + n, y + rng.uniform(0, 0.2), i % 2, "d"))
    df = spark.createDataFrame(rows, LINE + ", label int, dataset_id string")
    f = learning.features(df)
    assert set(learning.FEATURES) <= set(f.columns) and f.count() == 240
    train, held = learning.split(f.withColumn("tile", learning.tile()), "tile")
    model = learning.train(train, trees=10, depth=5)
    learning.save(model, str(tmp_path / "m"))
    scored = learning.probabilities(learning.load(str(tmp_path / "m")), held)
    m = learning.metrics(scored, 0.5).first()
    assert m.f1 > 0.95 and learning.ranking_quality(scored)["areaUnderROC"] > 0.95
    assert learning.training_overlap(train, held).count() == 1
    for kind in ("boosted", "logistic"):
        assert learning.metrics(learning.probabilities(learning.train(train, kind), held), 0.5).first().f1 > 0.9


def test_scalars(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first().v
    d = lambda x: F.lit(float(x))
    assert v(G.point_segment_distance(d(5), d(5), d(0), d(0), d(10), d(0))) == 5
    assert v(G.arc_sweep(d(350), d(10))) == 20
    assert v(G.undirected_angle(d(5), d(175))) == 10
    assert math.isnan(v(G.vector_angle_deg(d(0), d(0), d(1), d(0))))
    back = v(G.wgs84_to_local(F.lit(37.6), F.lit(55.7), (1.0, 0.0, 0.0, 1.0), (0.0, 0.0)))
    again = v(G.local_to_wgs84(d(back.x), d(back.y), (1.0, 0.0, 0.0, 1.0), (0.0, 0.0)))
    assert abs(again.x - 37.6) < 1e-9 and abs(again.y - 55.7) < 1e-9
    assert v(G.wgs84_to_mercator(d(0), d(90)))["y"] == v(G.wgs84_to_mercator(d(0), d(G.MAX_LATITUDE)))["y"]
    with pytest.raises(ValueError):
        G.mercator_to_local(d(0), d(0), (1.0, 2.0, 2.0, 4.0), (0.0, 0.0))
    assert 0 <= v(G.deterministic_fraction(F.lit("a"), F.lit(1))) <= 1
    ring = F.array(*(G.point(d(x), d(y)) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))))
    assert v(G.ring_area(ring)) == 16 and v(G.in_ring(d(1), d(1), ring)) and not v(G.in_ring(d(5), d(1), ring))
    assert v(G.interval_coverage(F.array(F.struct(d(0).alias("lo"), d(4).alias("hi")), F.struct(d(2).alias("lo"), d(6).alias("hi"))), d(0), d(10))) == pytest.approx(0.6)


def test_verifier_finds_faults(spark):
    a = spark.createDataFrame([("1", "LINE", "a"), ("1", "LINE", "a"), ("2", "ARC", "b")], "handle string, type string, layer string")
    b = a.limit(1).unionByName(spark.createDataFrame([("3", "LINE", "a")], a.schema))
    assert verify.entity_difference(a, a).count() == 0
    assert sorted(r.change for r in verify.entity_difference(a, b).collect()) == ["lost", "lost", "new"]
    sched = verify.tile_schedule(spark.createDataFrame([("tree", "accepted", 50.0, 150.0), ("shrub", "manual_review", 150.0, 50.0)], "plant_type string, status string, x double, y double"), 100.0)
    assert {(r.i, r.j): r.tile for r in sched.collect()} == {(0, 1): 1, (1, 0): 2}


def test_plan_end_to_end(spark, tmp_path):
    profiles = {"tree": {"spacing": 6.0, "footprint": 3.0, "species": "lime"}, "shrub": {"spacing": 1.5, "footprint": 0.75, "max_count": 5}}
    request = {"selections": [{"id": "b", "plant_type": "shrub"}, {"id": "a", "plant_type": "tree", "design_style": "alley", "guide": [[0, 5], [40, 5]]}]}
    chosen = placement.parse_request(request, profiles)
    assert [s.request_id for s in chosen] == ["a", "b"]
    for wrong in ({"id": "a", "plant_type": "tree", "rows": 2}, {"id": "a", "plant_type": "fern"}, {"plant_type": "tree"}, {"id": "a", "plant_type": "tree", "design_style": "mixed_flowerbed", "composition": [{"species": "x", "share": 0.5}]}):
        with pytest.raises(ValueError):
            placement.parse_request({"selections": [wrong]}, profiles)
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 40.0, 10.0)], "box_id long, x1 double, y1 double, x2 double, y2 double")
    target = spark.createDataFrame([("gas_pipe", 12.0, -9.0, 12.0, 19.0, "cleaned_high_confidence_geometry")], "target_type string, x1 double, y1 double, x2 double, y2 double, source string")
    out = placement.plan(chosen, boxes, catalog.rules(spark), target).collect()
    trees = [r for r in out if r.plant_type == "tree"]
    assert {(r.x, r.status) for r in trees if abs(r.x - 12) < 1.5} == {(12.0, "rejected")} and len(trees) == 7
    stands = [r for r in out if r.status != "rejected"]
    assert len({r.planting_id for r in stands}) == len(stands) and sum(r.plant_type == "shrub" for r in stands) == 5
    stage = placement.Stage("half", lambda df: df.filter("x1 >= 0"), ("boxes",))
    for status in ("run", "cached"):
        tables, log = placement.run_stages([stage], {"boxes": boxes}, str(tmp_path), "k")
        assert tables["half"].count() == 1 and log[0]["status"] == status


def test_streaming_intake(spark, tmp_path):
    from placewright.streaming import intake

    source = tmp_path / "in"
    source.mkdir()
    pd.DataFrame({"id": [1, 2, 3], "plant_type": ["tree"] * 3, "x": [0.0, 1.0, 20.0], "y": [0.0] * 3}).to_json(source / "a.json", orient="records", lines=True)
    target = spark.createDataFrame([("gas_pipe", 20.5, -9.0, 20.5, 9.0, "cleaned_high_confidence_geometry")], "target_type string, x1 double, y1 double, x2 double, y2 double, source string")
    read = lambda: spark.readStream.schema("id long, plant_type string, x double, y double").json(str(source))
    run = lambda: intake.stream_checks(read(), target, catalog.rules(spark), str(tmp_path / "out"), str(tmp_path / "ck"), 4.0).awaitTermination()
    run()
    pd.DataFrame({"id": [4, 5], "plant_type": ["tree"] * 2, "x": [2.0, 40.0], "y": [0.0] * 2}).to_json(source / "b.json", orient="records", lines=True)
    run()
    got = {r.id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {1, 3, 5} and got[3] == "rejected"


def test_exploded_cells_are_not_broadcast(spark):
    near = spark.createDataFrame([(i, 7.0 * i, 0.0, 7.0 * i + 9, 2.0) for i in range(50)], LINE)
    plan = networks.free_endpoints(near, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    for df in (networks.free_endpoints(near, 1.0), graph.touching_lines(near, 1.0), grid.self_pairs(graph.endpoints(near).select("id", "x", "y"), 1.0)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
