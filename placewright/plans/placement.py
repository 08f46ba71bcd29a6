"""From requests to decisions: candidates, packing, checks, status, ids and reports."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks as C
from ..operators import planning, rules, verify

PREFIX = {"tree": "T", "shrub": "S", "herbaceous": "H"}
#: Styles of a request and the options they take.
STYLES = {"alley": {"guide", "rows"}, "hedge": {"guide", "width"}, "free_group": {"seed"}, "shrub_mass": set(), "tree_grove": set(), "mixed_flowerbed": {"composition"}, "grid": set()}


@dataclass
class Selection:
    request_id: str
    plant_type: str
    species: str
    spacing: float
    footprint: float
    max_count: int = 5000
    style: str = "grid"
    options: dict = field(default_factory=dict)


def parse_request(request: dict, profiles: dict[str, dict]) -> list[Selection]:
    """Validated selections of a request; what is wrong is named in the error."""
    out, seen = [], set()
    for item in request.get("selections", []):
        name, kind = item.get("id"), item.get("plant_type")
        if not name or name in seen:
            raise ValueError(f"selection id {name!r} is missing or repeated")
        seen.add(name)
        if kind not in profiles:
            raise ValueError(f"{name}: unknown plant type {kind!r}")
        base = profiles[kind]
        style = item.get("design_style", "grid")
        if style not in STYLES:
            raise ValueError(f"{name}: unknown style {style!r}")
        options = {k: item[k] for k in ("guide", "rows", "width", "seed", "composition") if k in item}
        if set(options) - STYLES[style]:
            raise ValueError(f"{name}: {style} takes no {', '.join(sorted(set(options) - STYLES[style]))}")
        if options.get("rows", 1) not in (1, 2):
            raise ValueError(f"{name}: an alley has one row or two")
        if "width" in options and not options["width"] > 0:
            raise ValueError(f"{name}: the width must be positive")
        if parts := options.get("composition"):
            shares = [p["share"] for p in parts]
            if len({p["species"] for p in parts}) != len(parts) or any(not 0 < s < 1 for s in shares) or abs(sum(shares) - 1) > 1e-8:
                raise ValueError(f"{name}: shares must lie in (0, 1), sum to 1 and name different species")
        spacing = item.get("spacing_m", base["spacing"])
        if spacing < 2 * base["footprint"] and kind == "tree" and "spacing_m" in item and spacing < base.get("min_spacing", 0):
            raise ValueError(f"{name}: the spacing is under the species' least")
        out.append(Selection(name, kind, item.get("species", base.get("species", kind)), float(spacing), float(base["footprint"]), int(item.get("max_count", base.get("max_count", 5000))), style, options))
    # larger plants are placed first
    return sorted(out, key=lambda s: (-s.footprint, s.request_id))


def candidates(boxes: DataFrame, s: Selection) -> DataFrame:
    if s.style == "free_group":
        df = planning.free_groups(boxes, s.spacing, int(s.options.get("seed", 2026)))
    elif s.style in ("alley", "hedge") and s.options.get("guide"):
        (x1, y1), (x2, y2) = s.options["guide"]
        guide = boxes.sparkSession.createDataFrame([(0, float(x1), float(y1), float(x2), float(y2))], "box_id long, x1 double, y1 double, x2 double, y2 double")
        df = planning.alley(guide, s.spacing, int(s.options.get("rows", 1))).withColumn("row", F.lit(0)).withColumn("col", F.col("k"))
    else:
        df = planning.hex_grid(boxes, s.spacing)
    order = F.struct("box_id", "row", "col", "x", "y")
    return df.select("x", "y", F.xxhash64(order).alias("id"), order.alias("place"))


def plan(selections: list[Selection], boxes: DataFrame, rule_rows: DataFrame, targets: DataFrame, existing: DataFrame | None = None, units: float = 1.0) -> DataFrame:
    """Decisions of all selections: each is packed against itself and checked against the
    plants of the selections before it (and ``existing``: id, x, y, profile).

    One pass per selection, as later selections depend on earlier ones.
    """
    done = existing
    out = None
    for n, s in enumerate(selections):
        own = planning.pack(candidates(boxes, s).select("id", "x", "y"), s.spacing * units, None)
        own = own.withColumn("plant_type", F.lit(s.plant_type))
        checked = rules.decisions(rules.point_checks(own, rule_rows, targets, units)).join(own.select("id", "x", "y"), "id")
        profile = F.struct(
            F.lit(s.plant_type).alias("plant_type"),
            F.lit(s.spacing * units).alias("spacing"),
            F.lit(s.footprint * units).alias("footprint"),
            F.lit(0.5 * units).alias("avoid"),
            F.lit(1.0 * units).alias("trunk"),
            F.lit(s.plant_type == "shrub").alias("under_canopy"),
        )
        checked = checked.withColumn("profile", profile)
        if done is not None:
            near = planning.spacing_checks(checked.select("id", "x", "y", "profile"), done, max(2 * s.footprint, s.spacing, 6.0) * units)
            extra = C.check(F.lit("SPACING"), F.lit("planting"), F.when(F.coalesce("passed", F.lit(True)), "passed").otherwise("failed"), F.col("actual"), F.col("required"), F.lit(None))
            checked = checked.join(near, "id", "left").withColumn("checks", F.concat("checks", F.array(extra))).withColumn("status", C.decision(F.col("checks"))).drop("actual", "required", "other", "passed")
        rows = checked.withColumn("request_id", F.lit(s.request_id)).withColumn("species", F.lit(s.species)).withColumn("turn", F.lit(n))
        stands = rows.filter("status <> 'rejected'").orderBy("id").limit(s.max_count)
        rows = stands.unionByName(rows.filter("status = 'rejected'"))
        rows = planning.graph._checkpoint(rows)
        out = rows if out is None else out.unionByName(rows)
        placed = rows.filter("status <> 'rejected'").select("id", "x", "y", "profile")
        done = placed if done is None else done.select("id", "x", "y", "profile").unionByName(placed)
    return verify.with_ids(out.filter("status <> 'rejected'"), PREFIX, ["turn", "id"]).unionByName(out.filter("status = 'rejected'").withColumn("planting_id", F.lit(None).cast("string")))


# -- stages ---------------------------------------------------------------------------------


@dataclass
class Stage:
    name: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()


def cache_key(*parts: object) -> str:
    """Key of a stage's inputs: equal inputs, code and settings give an equal key."""
    return hashlib.sha256(json.dumps([str(p) for p in parts]).encode()).hexdigest()


def run_stages(stages: list[Stage], inputs: dict[str, DataFrame], store: str | None = None, key: str | None = None) -> tuple[dict[str, DataFrame], list[dict]]:
    """Run the stages in order; with ``store`` each result is written under its key and
    reread, and a stage whose key is there already is not run again.

    Returns the tables and one record (stage, status, seconds) per stage.
    """
    tables, log = dict(inputs), []
    spark = next(iter(inputs.values())).sparkSession
    for stage in stages:
        began = time.perf_counter()
        if lost := [n for n in stage.needs if n not in tables]:
            raise ValueError(f"{stage.name} needs {', '.join(lost)}")
        path = f"{store}/{stage.name}-{cache_key(key, stage.name, stage.needs)[:16]}" if store else None
        status = "run"
        if path and _exists(spark, path):
            tables[stage.name], status = spark.read.parquet(path), "cached"
        else:
            df = stage.run(*(tables[n] for n in stage.needs))
            if path:
                df.write.parquet(path)
                df = spark.read.parquet(path)
            tables[stage.name] = df
        log.append({"stage": stage.name, "status": status, "seconds": time.perf_counter() - began})
    return tables, log


def _exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
