"""Drawing source, feature files, catalogue, outputs."""

import json

import pytest
from pyspark.sql import functions as F

from placewright.functions import layers as L
from placewright.sources import catalog, dxf, features, sinks


def pairs(*items):
    return "\n".join(f"{c}\n{v}" for c, v in items) + "\n"


DRAWING = pairs(
    (0, "SECTION"), (2, "HEADER"), (9, "$INSUNITS"), (70, 4), (0, "ENDSEC"),
    (0, "SECTION"), (2, "BLOCKS"),
    (0, "BLOCK"), (2, "GEO_1"), (10, 0), (20, 0), (0, "LINE"), (8, "abc$0$Газ"), (62, 3), (10, 0), (20, 0), (11, 5), (21, 0), (0, "INSERT"), (2, "INNER"), (10, 1), (20, 1), (0, "ENDBLK"),
    (0, "BLOCK"), (2, "INNER"), (10, 1), (20, 0), (0, "POINT"), (8, "dots"), (10, 3), (20, 0), (0, "ENDBLK"),
    (0, "ENDSEC"),
    (0, "SECTION"), (2, "ENTITIES"),
    (0, "INSERT"), (5, "A1"), (2, "GEO_1"), (10, 100), (20, 200), (50, 90),
    (0, "INSERT"), (5, "A2"), (2, "LOST"), (10, 0), (20, 0),
    (0, "LINE"), (5, "A3"), (8, "Борт"), (10, 0), (20, 0), (11, 3), (21, 4), (330, "2F"),
    (0, "CIRCLE"), (5, "A4"), (8, "wells"), (10, 1), (20, 1), (40, 2),
    (0, "ARC"), (5, "A5"), (8, "wells"), (10, 0), (20, 0), (40, 10), (50, 350), (51, 10),
    (0, "LWPOLYLINE"), (5, "A6"), (8, "beds"), (70, 1), (10, 0), (20, 0), (10, 4), (20, 0), (10, 4), (20, 4),
    (0, "HATCH"), (5, "A7"), (8, "beds"), (92, 2), (72, 0), (73, 1), (93, 4), (10, 0), (20, 0), (10, 2), (20, 0), (10, 2), (20, 2), (10, 0), (20, 2),
    (0, "ENDSEC"), (0, "EOF"),
)


@pytest.fixture(scope="module")
def drawing(tmp_path_factory):
    path = tmp_path_factory.mktemp("dxf") / "a.dxf"
    path.write_text(DRAWING, encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def entities(spark, drawing):
    return dxf.read_dxf(spark, drawing)


def test_entities_and_inventory(entities):
    got = {r.layer: (r.total, dict(r.types)) for r in dxf.layer_inventory(entities).collect()}
    assert got["wells"] == (2, {"CIRCLE": 1, "ARC": 1}) and got["abc$0$Газ"] == (1, {"LINE": 1})
    assert entities.filter("section = 'ENTITIES'").count() == 7


def test_pruned_scan(spark, drawing):
    df = dxf.read_dxf(spark, drawing, type="LINE", section="ENTITIES")
    assert [r.handle for r in df.collect()] == ["A3"]


def test_geometry(entities):
    df = dxf.with_hatch_loops(dxf.with_geometry(entities)).filter("section = 'ENTITIES'")
    by = {r.handle: r for r in df.collect()}
    assert [(p.x, p.y) for p in by["A3"].points] == [(0, 0), (3, 4)]
    arc = by["A5"].points
    assert abs(arc[0].x - 9.848) < 1e-3 and abs(arc[-1].y - 1.736) < 1e-3 and max(p.x for p in arc) > 9.99
    assert by["A6"].closed and len(by["A6"].points) == 4
    assert len(by["A7"].loops) == 1 and len(by["A7"].loops[0]) == 5


def test_block_expansion(entities):
    df = dxf.placed(dxf.expand_blocks(entities))
    inner = {r.layer: r for r in df.filter("size(block_path) > 0").collect()}
    line = inner["abc$0$Газ"]
    assert line.handle is None and line.color == 3 and list(line.block_path) == ["GEO_1"]
    assert [(round(p.x, 9), round(p.y, 9)) for p in line.points] == [(100, 200), (100, 205)]
    dot = inner["dots"].points[0]  # base point off, then (1, 1), then a quarter turn
    assert (round(dot.x, 9), round(dot.y, 9)) == (99, 203) and list(inner["dots"].block_path) == ["GEO_1", "INNER"]
    assert dxf.expand_blocks(entities, max_depth=1).filter("layer = 'dots'").count() == 0


def test_layer_map(spark, entities):
    rule = "object_type string, required boolean, rule struct<source:string,dxf_types:array<string>,tails:array<string>,regex:string,excludes:array<string>>"
    rules = spark.createDataFrame(
        [("gas_pipe", True, ("geobase", ["LINE"], ["газ"], None, None)), ("curb", True, ("modelspace", ["LINE"], None, "борт", None)), ("none", True, ("both", ["TEXT"], None, None, None)), ("wells", False, ("both", ["CIRCLE", "ARC"], None, None, ["WEL"]))], rule
    )
    got = dxf.extract(dxf.expand_blocks(entities), rules)
    assert {(r.object_type, r.type) for r in got.collect()} == {("gas_pipe", "LINE"), ("curb", "LINE")}
    assert [r.object_type for r in dxf.missing_required(got, rules).collect()] == ["none"]


def test_units_and_fingerprints(entities):
    assert [r.units for r in dxf.units_per_metre(entities).collect()] == [1000.0]
    assert [r.units for r in dxf.units_per_metre(entities, 1.0).collect()] == [1.0]
    prints = {r.handle: r.fingerprint for r in dxf.fingerprints(entities).collect() if r.handle}
    assert len(set(prints.values())) == len(prints)
    assert entities.filter("handle = 'A3'").select(dxf.owner().alias("o")).first().o == "2F"


def test_broken_drawings(spark, tmp_path):
    (tmp_path / "odd.dxf").write_text("0\nSECTION\n2", encoding="utf-8")
    (tmp_path / "old.dxf").write_bytes("0\nSECTION\n2\nENTITIES\n0\nPOINT\n8\nГаз\n10\n1\n20\n2\n0\nENDSEC\n0\nEOF\n".encode("cp1251"))
    assert [r.type for r in dxf.read_dxf(spark, str(tmp_path / "odd.dxf"), "PERMISSIVE").collect()] == ["ERROR"]
    with pytest.raises(Exception, match="inside a pair"):
        dxf.read_dxf(spark, str(tmp_path / "odd.dxf")).collect()
    assert dxf.read_dxf(spark, str(tmp_path / "old.dxf")).first().layer == "Газ"


def test_layer_names(spark):
    names = [("Граница покрытия", "reference_geometry"), ("ПЧ за ГАЗОН", "hard_surface"), ("уширение за счет газона", "hard_surface"), ("Газон", "plantable_candidate"), ("газон и тротуар", "ambiguous"), ("x", "unknown"), ("ДВ_ПП_тип5_ТРОТ за счет Газона", "hard_surface")]
    df = spark.createDataFrame(names, "layer string, want string").select("want", L.surface_class(F.col("layer")).alias("got"))
    assert all(r.got == r.want for r in df.collect())
    road = spark.createDataFrame([("ПЧ за ТРОТ", True), ("ТРОТ за ПЧ", False), ("проезжая часть", True), ("ПЧ газон", False)], "layer string, want boolean")
    assert all(r.got == r.want for r in road.select("want", L.is_road_surface(F.col("layer")).alias("got")).collect())
    assert L.repaired_name("Газон".encode().decode("cp1251", "replace")) in ("Газон", "Газон".encode().decode("cp1251", "replace")) and L.repaired_name("plain") == "plain"


def feature(kind, coordinates, **props):
    return json.dumps({"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coordinates}})


def test_feature_files(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    square = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    path.write_text("\n".join([feature("Polygon", [square, [[1, 1], [2, 1], [2, 2], [1, 1]]], object_type="lawn"), feature("MultiLineString", [[[0, 0], [1, 0]], [[2, 0], [3, 0], [4, 0]]], object_type="gas_pipe", inferred_count="2"), feature("Point", [1, 2], object_type="existing_tree")]))
    f = features.read_features(spark, str(path))
    assert features.rings(f).count() == 9 and features.rings(f).filter("is_hole").count() == 4
    assert features.segments(f).filter("object_type = 'gas_pipe'").count() == 3
    assert [(p.x, p.y) for p in features.points(f).collect()] == [(1, 2)]
    assert [(r.object_type, r.source_kind, r.inferred) for r in features.utility_sources(f).filter("object_type = 'gas_pipe'").collect()] == [("gas_pipe", "reconstructed", 2)]
    assert features.require(f, "lawn", ("Polygon",)).count() == 1
    with pytest.raises(ValueError, match="no road"):
        features.require(f, "road", ("Polygon",))
    path.write_text("{}\n")
    with pytest.raises(Exception, match="no feature"):
        features.read_features(spark, str(path)).collect()


def test_catalogue(spark):
    assert catalog.rules(spark).count() == len(catalog.DISTANCES) + len(catalog.PROTECTION)
    assert catalog.invalid_rules(catalog.rules(spark)).count() == 0
    for wrong in (-1, float("inf"), True):
        with pytest.raises(ValueError):
            catalog.distance_rule("tree", "x", wrong)
    df = spark.createDataFrame([(1, "a")], "id int, old string")
    assert catalog.conform(df, {"old": "new"}, ["new"]).columns == ["id", "new"]
    with pytest.raises(ValueError, match="missing"):
        catalog.conform(df, {}, ["other"])


def test_outputs(spark, entities, tmp_path):
    plan = spark.createDataFrame([("T-0001", "tree", 1.0, 2.0, 3.0), ("S-0001", "shrub", 4.0, 5.0, 0.5)], "planting_id string, plant_type string, x double, y double, radius double")
    out = str(tmp_path / "out")
    for _ in range(2):  # exporting again gives the same drawing
        source = dxf.read_dxf(spark, str(tmp_path / "out/*.txt")) if (tmp_path / "out").exists() else entities
        source = spark.createDataFrame(source.collect(), source.schema)
        sinks.write_drawing(source, plan, out)
    back = dxf.read_dxf(spark, out + "/*.txt")
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).rstrip().endswith("EOF")
    assert back is not None
    sinks.write_features(plan, str(tmp_path / "f"), ["planting_id", "plant_type"])
    assert features.points(features.read_features(spark, str(tmp_path / "f"))).count() == 2
    sinks.write_partitioned(plan, str(tmp_path / "p"), "plant_type")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
