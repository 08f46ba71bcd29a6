"""DXF text drawings as a Spark data source, and their entities as rows.

``spark.read.format("dxf").option("path", glob)`` gives one row per entity of the
BLOCKS and ENTITIES sections: file, section, block, type, layer, handle, color and
the group-code pairs.  One partition per file.  The options section, layer and type
(comma-separated names) prune entities inside the scan, before they become rows.  A
value that is no UTF-8 is read as Windows-1251.
"""

from __future__ import annotations

import glob
import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geometry as G
from ..functions import layers as L

PAIR = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("value", T.StringType())])
ENTITY = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("file", "section", "block", "type", "layer", "handle")),
        T.StructField("color", T.IntegerType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("pairs", T.ArrayType(PAIR)),
    ]
)
MAX_DEPTH = 12


def decoded(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1251", "replace")


def read_pairs(lines: Iterator[bytes]) -> Iterator[tuple[int, str]]:
    """(group code, value) pairs; an odd line or a code that is no integer is an error."""
    for number, code in enumerate(lines):
        value = next(lines, None)
        if value is None:
            raise ValueError("the drawing ends inside a pair")
        try:
            yield int(code.strip()), decoded(value).strip()
        except ValueError:
            raise ValueError(f"pair {number}: {code!r} is no group code") from None


def read_entities(pairs: Iterator[tuple[int, str]]) -> Iterator[dict]:
    """Entities of a drawing in order, with the section and block that hold them."""
    section = block = ""
    entity: dict | None = None
    naming = None
    ordinal = 0

    def done() -> Iterator[dict]:
        nonlocal ordinal
        if entity and entity["section"] in ("BLOCKS", "ENTITIES", "HEADER") and entity["type"] not in ("SECTION", "BLOCK", "ENDBLK"):
            ordinal += 1
            yield {**entity, "ordinal": ordinal}

    for code, value in pairs:
        if code == 0:
            yield from done()
            entity = None
            if value == "SECTION":
                naming = "section"
            elif value == "ENDSEC":
                section = block = ""
            elif value == "BLOCK":
                naming = "block"
            elif value == "ENDBLK":
                block = ""
            elif value != "EOF":
                naming = None
                entity = {"section": section, "block": block or None, "type": value, "layer": "0", "handle": None, "color": 256, "pairs": []}
        elif naming == "section" and code == 2:
            section, naming = value, None
            if section == "HEADER":
                entity = {"section": section, "block": None, "type": "HEADER", "layer": "0", "handle": None, "color": 256, "pairs": []}
        elif naming == "block" and code == 2:
            block, naming = value, "base"
            entity = {"section": section, "block": block, "type": "BLOCK_BASE", "layer": "0", "handle": None, "color": 256, "pairs": []}
        elif entity is not None:
            entity["pairs"].append((code, value))
            if code == 8:
                entity["layer"] = value
            elif code == 5:
                entity["handle"] = value
            elif code == 62:
                entity["color"] = int(value)
    yield from done()


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class DxfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = sorted(p for part in options["path"].split(",") for p in glob.glob(part.strip().removeprefix("file://")))
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.wanted = {k: {v.strip() for v in options[k].split(",")} for k in ("section", "layer", "type") if options.get(k)}

    def partitions(self) -> Sequence[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            try:
                for e in read_entities(read_pairs(iter(f))):
                    if all(e[k] in v for k, v in self.wanted.items()):
                        yield (partition.path, e["section"], e["block"], e["type"], e["layer"], e["handle"], e["color"], e["ordinal"], e["pairs"])
            except ValueError as wrong:
                if not self.permissive:
                    raise
                yield (partition.path, None, None, "ERROR", None, None, None, -1, [(999, str(wrong))])


class DxfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dxf"

    def schema(self) -> T.StructType:
        return ENTITY

    def reader(self, schema: T.StructType) -> DxfReader:
        return DxfReader(self.options)


def read_dxf(spark: SparkSession, path: str, mode: str = "FAILFAST", **prune: str) -> DataFrame:
    spark.dataSource.register(DxfSource)
    reader = spark.read.format("dxf").option("path", path).option("mode", mode)
    for name, names in prune.items():
        reader = reader.option(name, names)
    return reader.load()


# -- values and geometry ---------------------------------------------------------------------


def values(code: int):
    """All values of a group code of column pairs, as doubles."""
    return F.transform(F.filter("pairs", lambda p: p["code"] == code), lambda p: p["value"].cast("double"))


def value(code: int, fallback: float):
    return F.coalesce(F.try_element_at(values(code), F.lit(1)), F.lit(float(fallback)))


def text(code: int):
    return F.try_element_at(F.transform(F.filter("pairs", lambda p: p["code"] == code), lambda p: p["value"]), F.lit(1))


def with_geometry(entities: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Columns kind, closed and points (``array<struct<x,y>>``), in the entity's own space."""
    pt = lambda a, b: G.point(value(a, 0), value(b, 0))
    zipped = F.zip_with(values(10), values(20), lambda x, y: G.point(x, y))
    flag = value(70, 0).cast("int")
    ends = F.size(zipped)
    same = (ends >= 4) & (zipped[0]["x"] == F.element_at(zipped, -1)["x"]) & (zipped[0]["y"] == F.element_at(zipped, -1)["y"])
    kind = (
        F.when(F.col("type") == "LINE", "line")
        .when(F.col("type") == "POINT", "point")
        .when(F.col("type") == "INSERT", "insert_point")
        .when(F.col("type") == "CIRCLE", "circle")
        .when(F.col("type") == "ARC", "arc")
        .when(F.col("type") == "ELLIPSE", "ellipse")
        .when(F.col("type").isin("LWPOLYLINE", "POLYLINE"), "polyline")
        .when(F.col("type") == "HATCH", "hatch")
    )
    points = (
        F.when(F.col("type") == "LINE", F.array(pt(10, 20), pt(11, 21)))
        .when(F.col("type").isin("POINT", "INSERT"), F.array(pt(10, 20)))
        .when(F.col("type") == "CIRCLE", G.arc_points(value(10, 0), value(20, 0), value(40, 0), F.lit(0.0), F.lit(360.0), tolerance))
        .when(F.col("type") == "ARC", G.arc_points(value(10, 0), value(20, 0), value(40, 0), value(50, 0), value(51, 360), tolerance))
        .when(F.col("type") == "ELLIPSE", G.ellipse_points(value(10, 0), value(20, 0), value(11, 1), value(21, 0), value(40, 1), value(41, 0), value(42, 2 * math.pi), tolerance))
        .when(F.col("type").isin("LWPOLYLINE", "POLYLINE"), F.when((flag.bitwiseAND(1) == 1) & ~same & (ends > 1), F.concat(zipped, F.array(zipped[0]))).otherwise(zipped))
    )
    closed = F.when(F.col("type").isin("CIRCLE", "HATCH"), True).when(kind == "polyline", (flag.bitwiseAND(1) == 1) | F.coalesce(same, F.lit(False))).otherwise(False)
    return entities.withColumn("kind", kind).withColumn("closed", closed).withColumn("points", points)


def hatch_loops(pairs: list) -> list[list[tuple[float, float]]]:
    """Boundary loops of a hatch: vertex lists or chains of edges; closed, at least three points."""
    codes = [(int(p["code"]), p["value"]) for p in pairs]
    loops: list[list[tuple[float, float]]] = []
    i, n = 0, len(codes)

    def take(code: int, fallback: float = 0.0) -> float:
        nonlocal i
        while i < n and codes[i][0] != code:
            if codes[i][0] in (92, 98, 75):
                return fallback
            i += 1
        if i == n:
            return fallback
        i += 1
        return float(codes[i - 1][1])

    def arc(cx: float, cy: float, rx: float, ry: float, turn: float, a: float, b: float, ccw: bool, least: int) -> list[tuple[float, float]]:
        sweep = (b - a) % 360 or 360.0
        steps = max(least, math.ceil(sweep / 10))
        out = []
        for k in range(steps + 1):
            t = math.radians(a + sweep * k / steps) * (1 if ccw else -1)
            u, v = rx * math.cos(t), ry * math.sin(t)
            out.append((cx + u * math.cos(turn) - v * math.sin(turn), cy + u * math.sin(turn) + v * math.cos(turn)))
        return out

    while i < n:
        if codes[i][0] != 92:
            i += 1
            continue
        flags = int(float(codes[i][1]))
        i += 1
        loop: list[tuple[float, float]] = []
        if flags & 2:
            bulges = take(72)
            take(73)
            count = int(take(93))
            for _ in range(count):
                loop.append((take(10), take(20)))
                if bulges and i < n and codes[i][0] == 42:
                    i += 1
        else:
            for _ in range(int(take(93))):
                kind = int(take(72))
                if kind == 1:
                    loop += [(take(10), take(20)), (take(11), take(21))]
                elif kind == 2:
                    c, r, a, b, ccw = (take(10), take(20)), take(40), take(50), take(51), take(73, 1)
                    loop += arc(*c, r, r, 0.0, a, b, bool(ccw), 8)
                elif kind == 3:
                    c, m, ratio, a, b, ccw = (take(10), take(20)), (take(11), take(21)), take(40, 1), take(50), take(51), take(73, 1)
                    size = math.hypot(*m)
                    loop += arc(*c, size, size * ratio, math.atan2(m[1], m[0]), a, b, bool(ccw), 12)
                elif kind == 4:
                    take(94)
                    take(73)
                    take(74)
                    knots, controls = int(take(95)), int(take(96))
                    for _ in range(knots):
                        take(40)
                    loop += [(take(10), take(20)) for _ in range(controls)]
        if len(loop) >= 3:
            if loop[0] != loop[-1]:
                loop.append(loop[0])
            if len(loop) >= 4:
                loops.append(loop)
    return loops


LOOPS = "array<array<struct<x:double,y:double>>>"


def with_hatch_loops(entities: DataFrame) -> DataFrame:
    """Column loops of hatches, decoded batch by batch."""

    @F.pandas_udf(LOOPS)
    def loops(pairs: pd.Series) -> pd.Series:
        return pairs.map(lambda p: [[{"x": x, "y": y} for x, y in loop] for loop in hatch_loops(list(p))])

    return entities.withColumn("loops", F.when(F.col("type") == "HATCH", loops("pairs")))


# -- block expansion ------------------------------------------------------------------------------


def expand_blocks(entities: DataFrame, roots: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Entities of the model space with the contents of their inserted blocks.

    Adds block_path and matrix (to drawing space).  Inserts are followed level by
    level, at most ``max_depth`` deep; a block that is not there is skipped.  The
    block's base point is taken off.  ``roots`` limits the blocks that are entered
    from the model space to names that match.
    """
    unit = G.matrix(*(F.lit(v) for v in (1, 0, 0, 1, 0, 0)))
    content = entities.filter("section = 'BLOCKS' and type <> 'BLOCK_BASE'")
    base = entities.filter("type = 'BLOCK_BASE'").select("file", "block", value(10, 0).alias("bx"), value(20, 0).alias("by")).dropDuplicates(["file", "block"])
    now = entities.filter("section = 'ENTITIES'").withColumn("block_path", F.array().cast("array<string>")).withColumn("matrix", unit)
    out = now.filter("type <> 'INSERT'")
    for depth in range(max_depth):
        name = text(2)
        inserts = now.filter("type = 'INSERT'").withColumn("child", name)
        if roots and depth == 0:
            inserts = inserts.filter(F.col("child").rlike(roots))
        own = G.insert_matrix(value(10, 0), value(20, 0), value(41, 1), value(42, 1), value(50, 0))
        inserts = inserts.select("file", F.col("child").alias("block"), F.concat("block_path", F.array("child")).alias("block_path"), G.compose(F.col("matrix"), own).alias("placed"))
        inserts = inserts.join(base, ["file", "block"], "left").withColumn("shift", G.matrix(*(F.lit(v) for v in (1, 0, 0, 1)), -F.coalesce("bx", F.lit(0.0)), -F.coalesce("by", F.lit(0.0))))
        inserts = inserts.select("file", "block", "block_path", G.compose(F.col("placed"), F.col("shift")).alias("matrix"))
        now = content.join(inserts, ["file", "block"]).withColumn("handle", F.lit(None).cast("string")).select(*entities.columns, "block_path", "matrix")
        out = out.unionByName(now.filter("type <> 'INSERT'"))
        if now.filter("type = 'INSERT'").isEmpty():
            break
    return out


def placed(expanded: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Expanded entities with their points in drawing space."""
    return with_geometry(expanded, tolerance).withColumn("points", F.transform("points", lambda p: G.apply_matrix(F.col("matrix"), p["x"], p["y"])))


def extract(expanded: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per entity and layer rule that it meets (object_type, rule, entity columns).

    ``rules`` is the layer map (object_type, rule struct), tens of rows.
    """
    source = F.when(F.size("block_path") > 0, "geobase").otherwise("modelspace")
    on = L.mapping_matches(source, F.col("type"), F.col("layer"), F.col("rule"))
    return expanded.join(F.broadcast(rules), on)


def missing_required(extracted: DataFrame, rules: DataFrame) -> DataFrame:
    return rules.filter("required").select("object_type").join(extracted.select("object_type").distinct(), "object_type", "left_anti")


def units_per_metre(entities: DataFrame, explicit: float | None = None) -> DataFrame:
    """(file, header, units): drawing units per metre from the header or an explicit value, which wins."""
    pairs = F.col("pairs")
    at = F.array_position(F.transform(pairs, lambda p: p["value"]), "$INSUNITS")
    code = F.when(at > 0, F.get(pairs, at.cast("int"))["value"].cast("int"))
    scale = {1: 1 / 0.0254, 2: 1 / 0.3048, 4: 1000.0, 5: 100.0, 6: 1.0, 7: 0.001, 14: 10.0}  # fixed values: drawing unit codes
    known = F.element_at(F.create_map(*(F.lit(v) for kv in scale.items() for v in kv)), F.coalesce(code, F.lit(0)))
    chosen = F.coalesce(F.lit(explicit).cast("double"), known)
    return entities.filter("type = 'HEADER'").select("file", code.alias("header"), F.when(chosen.isNull(), F.raise_error(F.lit("the drawing names no unit; give one"))).otherwise(chosen).cast("double").alias("units"))


def layer_inventory(entities: DataFrame) -> DataFrame:
    """(layer, total, types): entities per layer with a count by type, most first."""
    by = entities.filter("type not in ('HEADER', 'BLOCK_BASE')").groupBy("layer", "type").agg(F.count(F.lit(1)).alias("n"))
    out = by.groupBy("layer").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    return out.orderBy(F.desc("total"), "layer")


def fingerprints(entities: DataFrame, ignored: tuple[int, ...] = (5, 330, 102, 360)) -> DataFrame:
    """(file, handle, type, layer, fingerprint): digest of an entity's pairs without bookkeeping codes."""
    kept = F.filter("pairs", lambda p: ~p["code"].isin(*ignored) & ~((p["code"] == 43) & (p["value"].cast("double") == 0)))
    joined = F.array_join(F.transform(kept, lambda p: F.concat_ws("=", p["code"].cast("string"), p["value"])), "\n")
    return entities.select("file", "handle", "type", "layer", F.sha2(F.concat_ws("\n", F.col("type"), joined).cast("binary"), 256).alias("fingerprint"))


def owner():
    """First owner handle (code 330) of column pairs outside any {...} group."""
    state = F.aggregate(
        "pairs",
        F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("owner")),
        lambda s, p: F.struct(
            F.when((p["code"] == 102) & p["value"].startswith("{"), s["depth"] + 1).when((p["code"] == 102) & p["value"].startswith("}"), s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
            F.when(s["owner"].isNull() & (s["depth"] == 0) & (p["code"] == 330), p["value"]).otherwise(s["owner"]).alias("owner"),
        ),
    )
    return state["owner"]
