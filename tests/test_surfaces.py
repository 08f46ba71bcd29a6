"""Surfaces, footprints, roads, chambers and configuration."""

import json

import numpy as np
import pytest

from placewright.operators import surfaces as S
from placewright.sources import config

LINE = "line_id long, x1 double, y1 double, x2 double, y2 double"


def test_anchors_and_wells(spark):
    rec = spark.createDataFrame([(1, "circle", 0.0, 0.0, 1.0, 0.0, 0.0), (2, "circle", 0.001, 0.0, 1.0, 0.0, 0.0), (3, "arc", 5.0, 5.0, 1.0, 0.0, 355.0), (4, "arc", 9.0, 9.0, 1.0, 0.0, 90.0)], "id long, kind string, x double, y double, r double, start double, end double")
    assert sorted(r.id for r in S.tree_anchors(rec).collect()) == [1, 3]
    back = spark.createDataFrame([(7, 1.0, 1.0)], "id long, x double, y double")
    assert [r.id for r in S.tree_anchors(rec.filter("id = 4"), back).collect()] == [7]
    assert S.well_footprints(rec.unionByName(rec)).count() == 2


def test_scopes(spark):
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 0.5, 5.0), (3, 5.0, 7.5)], "id long, x double, y double")
    edges = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 0.0), (1, 10.0, 0.0, 10.0, 10.0), (2, 10.0, 10.0, 0.0, 10.0), (3, 0.0, 10.0, 0.0, 0.0)], LINE)
    trees = spark.createDataFrame([(9, 5.0, 8.0)], "rid long, rx double, ry double")
    assert sorted(r.id for r in S.eroded(pts, edges, 1.0).collect()) == [1, 3]
    assert [r.id for r in S.safe_scope(pts, edges, 1.0, trees, 2.0).collect()] == [1]
    guide = spark.createDataFrame([(0, 0.0, 5.0, 4.0, 5.0)], LINE)
    assert [r.id for r in S.hedge_corridor(pts, guide, 1.5).collect()] == [2]
    assert {r.line_id: (r.x1, r.y1, r.x2, r.y2) for r in S.clip_lines(edges, 2.0, -1.0, 8.0, 5.0).collect()} == {0: (2.0, 0.0, 8.0, 0.0)}


def ring_rows(bed, role, pts, ring=0):
    return [(bed, role, ring, k, float(x), float(y)) for k, (x, y) in enumerate(pts)]


BOX = lambda x1, y1, x2, y2: [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]


def test_areas_of_beds(spark):
    schema = "bed_id long, role string, ring int, seq int, x double, y double"
    rows = ring_rows(1, "base", BOX(0, 0, 10, 10)) + ring_rows(1, "hard", BOX(0, 0, 2, 10)) + ring_rows(1, "walk", BOX(8, 0, 10, 10)) + ring_rows(1, "house", BOX(3, 3, 5, 5)) + ring_rows(1, "well", BOX(6, 6, 7, 7))
    got = S.base_area(spark.createDataFrame(rows, schema)).first()
    assert got.allowed == pytest.approx(55) and got.balance == pytest.approx(0)
    q = S.coverage_quality(spark.createDataFrame(ring_rows(1, "reference", BOX(0, 0, 10, 10)) + ring_rows(1, "candidate", BOX(5, 0, 15, 10)), schema)).first()
    assert (q.coverage, q.precision) == (pytest.approx(0.5), pytest.approx(0.5))
    rec = spark.createDataFrame([(1, "a", "hard_surface", 0, k, float(x), float(y)) for k, (x, y) in enumerate(BOX(5, 5, 15, 15))], "region_id long, layer string, class string, ring int, seq int, x double, y double")
    edge = [np.array(BOX(0, 0, 10, 10), float)]
    assert S.surface_areas(rec, rec["class"] == "hard_surface", edge).first().area == pytest.approx(25)
    assert S.reviewed_surface_faults(rec, edge).first().outside == pytest.approx(75)
    m = S.ring_metrics(rec.select("region_id", "seq", "x", "y"))
    assert (m.first().area, m.first().perimeter) == (100, 40) and S.context_buildings(m).first().height == 12


def test_road_between_dashed_curbs():
    boundary = np.array(BOX(0, 0, 40, 40), float)

    def curbs(gap):
        out = []
        for x in (15.0, 25.0):
            y = 0.0
            while y < 40:
                out.append((x, y, x, min(40.0, y + 2)))
                y += 2 + gap
        return np.array(out)

    seed = [np.array(BOX(18, 10, 22, 14), float)]
    road = S.road_cells(boundary, curbs(0.4), [], seed)
    assert 360 < road["area"] < 440 and road["faces"] == 1
    with pytest.raises(ValueError, match="implausible"):
        S.road_cells(boundary, curbs(2.0), [], seed)
    assert S.horizontal_spans([np.array(BOX(2, 0, 5, 9), float)], 4.0) == [(2.0, 5.0)]


def test_corridor(spark):
    p = spark.createDataFrame([(1, 0.0, 50.0, 10.0, 12.0, True), (1, 60.0, 100.0, 0.0, 0.0, False), (1, 140.0, 200.0, 0.0, 0.0, False)], "street long, miny double, maxy double, centre double, width double, seeded boolean")
    assert [(r.state, r.width) for r in S.corridor(p).orderBy("miny").collect()] == [("seeded", 12 * 1.4), ("continued", 12 * 1.4), ("open", None)]


def test_dashed_chamber(spark):
    rows, k = [], 0
    for a, b, axis, at in ((0, 6, "x", 0.0), (0, 6, "x", 4.0), (0, 4, "y", 0.0), (0, 4, "y", 6.0)):
        t = float(a)
        while t + 0.8 <= b:
            rows.append((k, t, at, t + 0.8, at) if axis == "x" else (k, at, t, at, t + 0.8))
            k, t = k + 1, t + 1.3
    lines = spark.createDataFrame([(i, *map(float, r)) for i, *r in rows], LINE)
    wells = spark.createDataFrame([(1, 3.0, 2.0)], "well long, x double, y double")
    got = S.dashed_chambers(lines, wells).collect()
    assert len(got) == 1 and (got[0].x1, got[0].y1, got[0].x2, got[0].y2) == pytest.approx((0, 0, 6, 4))
    assert S.dashed_chambers(lines.filter("y1 < 4 or y2 < 4"), wells).count() == 0


def test_tips_and_samples(spark):
    poly = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)],), ([(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)],)], "pts array<struct<x:double,y:double>>")
    strokes = spark.createDataFrame([(0, 5.0, 5.0, 6.0, 5.0), (1, 5.0, 5.0, 5.6, 5.8)], LINE)
    assert sorted((round(r.x, 1), round(r.y, 1)) for r in S.arrow_tips(poly, strokes).collect()) == [(1.0, 0.0), (5.0, 5.0)]
    c = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, bed string")
    assert {r.id for r in S.round_robin(c, "bed", ["id"], 2).collect()} == {1, 3}


def test_configuration(spark, tmp_path):
    rules, depth = config.layer_map(spark, {"layer_mapping": {"gas": {"source": "both", "dxf_types": ["LINE"], "required": True}}})
    assert rules.count() == 1 and depth == 12
    with pytest.raises(ValueError):
        config.layer_map(spark, {})
    p = config.profiles({"plantingProfiles": [{"plantType": "tree", "species": "x", "spacingM": 6, "footprintRadiusM": 3, "understoryTrunkClearanceM": 1}]})
    assert p["tree"]["boundary"] == "physical_area" and p["tree"]["clearance"] == 5.5
    with pytest.raises(ValueError):
        config.profiles({"plantingProfiles": [{"plantType": "tree", "species": "x", "spacingM": 6, "footprintRadiusM": 3, "understoryTrunkClearanceM": 4}]})
    assert config.georeference({"local_to_epsg3857": {"matrix": [[1, 0], [0, 1]], "offset": [0, 0]}}) == ((1, 0, 0, 1), (0, 0))
    with pytest.raises(ValueError):
        config.georeference({"local_to_epsg3857": {"matrix": [[1, 2]], "offset": [0, 0]}})
    (tmp_path / "a.dxf").touch(), (tmp_path / "B.dxf").touch(), (tmp_path / "B.dxf.exclude").touch()
    assert [f[-5:] for f in config.training_files(str(tmp_path))] == ["a.dxf"]
    survey = {"features": [{"properties": {"id": "s1", "species": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"properties": {"id": "m1", "species": "y"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}
    (tmp_path / "s.json").write_text(json.dumps(survey))
    shrubs, masses = config.shrub_survey(spark, str(tmp_path / "s.json"))
    assert shrubs.count() == 1 and masses.count() == 4
    labels = spark.createDataFrame([("ВЛ 10 кВ 3 пр",), ("0,4 kV",)], "t string").select(config.voltage("t").alias("v"), config.wires("t").alias("w"))
    assert [(r.v, r.w) for r in labels.collect()] == [(10.0, 3), (0.4, None)]
