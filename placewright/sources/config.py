"""Configuration files: layer maps, profiles, surveys, georeference, training sets."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LAYER_MAP = "object_type string, required boolean, rule struct<source:string,dxf_types:array<string>,tails:array<string>,regex:string,excludes:array<string>>"


def layer_map(spark: SparkSession, config: dict) -> tuple[DataFrame, int]:
    """(rules, greatest block depth) of a layer map; an empty one is an error."""
    entries = config.get("layer_mapping") or {}
    if not entries:
        raise ValueError("the layer map is empty")
    rows = []
    for name, m in entries.items():
        if m.get("source") not in ("modelspace", "geobase", "both") or not m.get("dxf_types"):
            raise ValueError(f"{name}: source and dxf_types are needed")
        rows.append((name, bool(m.get("required")), (m["source"], list(m["dxf_types"]), m.get("layer_tail_in"), m.get("layer_regex"), m.get("exclude_layer_contains"))))
    return spark.createDataFrame(rows, LAYER_MAP), int((config.get("geobase_blocks") or {}).get("max_depth", 12))


def read_layer_map(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    import yaml

    return layer_map(spark, yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def profiles(config: dict, default_count: int = 5000) -> dict[str, dict]:
    """Validated point profiles by plant type."""
    out = {}
    for p in config.get("plantingProfiles", []):
        kind = p["plantType"]
        own = {"species": p["species"], "spacing": float(p["spacingM"]), "footprint": float(p["footprintRadiusM"]), "avoid": float(p.get("avoidOtherPlantingsM", 0)), "trunk": p.get("understoryTrunkClearanceM"), "under_canopy": bool(p.get("allowUnderTreeCanopy", False)), "max_count": int(p.get("maxCount", default_count))}
        own["boundary"] = p.get("footprintBoundary", "physical_area" if kind == "tree" else "allow_zone")
        own["clearance"] = p.get("existingTreeClearanceM", 2.5 + own["footprint"])
        if kind in out:
            raise ValueError(f"two profiles of {kind}")
        if not all(math.isfinite(own[k]) and own[k] >= 0 for k in ("spacing", "footprint", "avoid")) or own["spacing"] <= 0:
            raise ValueError(f"{kind}: distances must be finite and the spacing positive")
        if own["trunk"] is not None and not 0 < own["trunk"] <= own["footprint"]:
            raise ValueError(f"{kind}: the trunk clearance must lie within the footprint")
        out[kind] = own
    if not out:
        raise ValueError("no profile is configured")
    return out


def shrub_survey(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(shrubs, masses) of a surveyed feature collection; ids must differ."""
    shrubs, masses, seen = [], [], set()
    for f in json.loads(Path(path).read_text(encoding="utf-8"))["features"]:
        p, g = f["properties"], f["geometry"]
        name = p.get("id") or f.get("id")
        if not name or name in seen:
            raise ValueError(f"survey id {name!r} is missing or repeated")
        seen.add(name)
        if g["type"] == "Point":
            shrubs.append((name, p.get("species"), *map(float, g["coordinates"][:2])))
        elif g["type"] == "Polygon":
            masses += [(name, p.get("species"), k, float(x), float(y)) for k, (x, y, *_) in enumerate(g["coordinates"][0])]
        else:
            raise ValueError(f"{name}: {g['type']} is neither a shrub nor a mass")
    return spark.createDataFrame(shrubs, "id string, species string, x double, y double"), spark.createDataFrame(masses, "mass_id string, species string, seq int, x double, y double")


def georeference(config: dict) -> tuple[tuple[float, ...], tuple[float, float]]:
    """(matrix row by row, offset) of a local grid; two full rows and a determinant are needed."""
    own = config.get("local_to_epsg3857") or {}
    rows, offset = own.get("matrix") or [], own.get("offset") or []
    if len(rows) != 2 or any(len(r) != 2 for r in rows) or len(offset) != 2:
        raise ValueError("a georeference needs a 2 x 2 matrix and an offset")
    m = tuple(float(v) for r in rows for v in r)
    if abs(m[0] * m[3] - m[1] * m[2]) < 1e-15:
        raise ValueError("the transform cannot be inverted")
    return m, (float(offset[0]), float(offset[1]))


def training_files(directory: str) -> list[str]:
    """Drawings of a folder without those marked by a file of the same name and ``.exclude``."""
    return sorted((str(p) for p in Path(directory).glob("*.dxf") if not p.with_name(p.name + ".exclude").exists()), key=str.casefold)


def voltage(text: str):
    """Column: voltage in kV named in a label's text."""
    from pyspark.sql import functions as F

    return F.regexp_extract(F.regexp_replace(F.col(text), ",", "."), r"(?iu)(\d+(?:\.\d+)?)\s*(?:кв|kv)", 1).try_cast("double")


def wires(text: str):
    """Column: number of wires named in a label's text."""
    from pyspark.sql import functions as F

    return F.regexp_extract(F.col(text), r"(?iu)(\d+)\s*(?:пр|wires?)", 1).try_cast("int")
