"""Endpoint graphs of line networks: nodes, degrees, components, arrowheads.

Lines are rows (line_id, x1, y1, x2, y2); connected components run as rounds of
min-label hooking with pointer jumping, every round cut by a checkpoint.
"""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import blocks, grid


def _checkpoint(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder of spark.checkpoint.dir (a temporary one where unset)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="placewright-"))
    return df.checkpoint()


def _contracted(edges: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """Edges with the same components: those of a task, ``rows`` at a time, become one edge from each node to the least one it is linked with."""
    if any(t not in ("int", "bigint") for _, t in edges.dtypes):
        return edges

    def work(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from contracted(held)
                held, n = [], 0
        yield from contracted(held)

    def contracted(held):
        if held:
            t = pa.Table.from_batches(held)
            node, root = blocks.labels(*(t.column(c).to_numpy() for c in "ab"))
            out = pa.table({"a": root[node != root], "b": node[node != root]})
            yield from out.to_batches(max_chunksize=100_000)

    return edges.filter("a <> b").mapInArrow(work, "a long, b long")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component) with the least member as the component's name.

    ``edges`` has columns a and b; ``nodes`` (id) adds nodes without an edge.
    """
    edges = _checkpoint(_contracted(edges.select("a", "b")))
    labels = _labels(edges)
    if nodes is not None:
        labels = nodes.select("id").join(grid.shuffled(labels), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return labels


def _labels(edges: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """(id, component) of every node of an edge; at most ``rows`` edges of numbers are labelled in one task."""
    whole = all(t in ("int", "bigint") for _, t in edges.dtypes)
    if whole and edges.limit(rows + 1).count() <= rows:
        star = _checkpoint(_contracted(edges.repartition(1), rows + 1))
        roots = star.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
        return star.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(roots)
    if whole and (found := _by_roots(edges, rows)) is not None:
        return found
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = _checkpoint(both)
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"))
    labels = _checkpoint(labels)
    total = None
    while True:
        theirs = labels.select(F.col("id").alias("b"), F.col("component").alias("m"))
        hooked = both.join(grid.shuffled(theirs), "b").groupBy(F.col("a").alias("id")).agg(F.min("m").alias("m"))
        step = labels.join(grid.shuffled(hooked), "id").select("id", F.least("component", "m").alias("component"))
        up = step.select(F.col("id").alias("component"), F.col("component").alias("top"))
        labels = _checkpoint(step.join(grid.shuffled(up), "component").select("id", F.col("top").alias("component")))
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now


def _by_roots(edges: DataFrame, rows: int) -> DataFrame | None:
    """Labels by way of the graph of the nodes in a alone, where that is much smaller than the edges.

    Each node is given to the least of its neighbours in a; two such neighbours of a node are linked.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = edges.unionByName(edges.select("a", F.col("a").alias("b")).distinct())
    up = _checkpoint(stars.groupBy("b").agg(F.min("a").alias("m"), F.max("a").alias("x")))
    # a node with one neighbour links nothing
    several = up.filter("m <> x").select("b", "m")
    links = stars.join(grid.shuffled(several), "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).distinct()
    links = _checkpoint(_contracted(links))
    if links.count() * 2 > edges.count():
        return None
    top = _labels(links, rows).withColumnRenamed("id", "m")
    return up.select(F.col("b").alias("id"), "m").join(grid.shuffled(top), "m", "left").select("id", F.coalesce("component", "m").alias("component"))


def endpoints(lines: DataFrame) -> DataFrame:
    """Two rows per line: end (0 start, 1 end), x, y and the unit vector (ox, oy) that leaves it."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = F.sqrt(dx * dx + dy * dy)
    ux, uy = F.when(n > 0, dx / n).otherwise(0.0), F.when(n > 0, dy / n).otherwise(0.0)
    end = lambda k, x, y, a, b: F.struct(F.lit(k).alias("end"), F.col(x).alias("x"), F.col(y).alias("y"), a.alias("ox"), b.alias("oy"))
    both = F.array(end(0, "x1", "y1", -ux, -uy), end(1, "x2", "y2", ux, uy))
    rest = [c for c in lines.columns if c not in ("x1", "y1", "x2", "y2")]
    return lines.select(*rest, F.explode(both).alias("e")).select(*rest, (F.col("line_id") * 2 + F.col("e.end")).alias("id"), "e.end", "e.x", "e.y", "e.ox", "e.oy")


def nodes(lines: DataFrame, tolerance: float) -> DataFrame:
    """Endpoints with the grid key (kx, ky) of their node."""
    return endpoints(lines).withColumn("kx", G.snap(F.col("x"), tolerance)).withColumn("ky", G.snap(F.col("y"), tolerance))


def node_means(lines: DataFrame, tolerance: float) -> DataFrame:
    return nodes(lines, tolerance).groupBy("kx", "ky").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("degree"))


def endpoint_clusters(lines: DataFrame, tolerance: float) -> DataFrame:
    """(id, component): endpoints that are linked by steps of at most ``tolerance``."""
    ends = endpoints(lines).select("id", "x", "y")
    near = grid.self_pairs(ends, tolerance).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return components(near, ends)


def touching_lines(lines: DataFrame, tolerance: float) -> DataFrame:
    """Pairs (a, b) of lines of which an end of one lies within ``tolerance`` of the other."""
    return blocks.touching_pairs(lines, tolerance)


def line_components(lines: DataFrame, tolerance: float) -> DataFrame:
    return components(blocks.touching_forest(endpoints(lines), lines, tolerance), lines.select(F.col("line_id").alias("id")))


def component_shapes(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Length, span, size and straightness of each component."""
    own = lines.join(grid.shuffled(labels.select(F.col("id").alias("line_id"), "component")), "line_id")
    length = G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    out = own.groupBy("component").agg(
        F.sum(length).alias("length"),
        F.sqrt(
            F.pow(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), 2.0) + F.pow(F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2")), 2.0)
        ).alias("span"),
        F.count(F.lit(1)).alias("size"),
    )
    return out.withColumn("straightness", F.when(F.col("length") > 0, F.col("span") / F.col("length")).otherwise(0.0))


def degree_class(lines: DataFrame, tolerance: float) -> DataFrame:
    """(component, nodes, ends, kind): closed, branched or open chains of the endpoint graph."""
    keyed = nodes(lines, tolerance)
    name = F.xxhash64("kx", "ky")
    at = keyed.select("line_id", name.alias("node"))
    edges = at.groupBy("line_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    label = components(edges, at.select(F.col("node").alias("id")).distinct())
    degree = at.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("degree")).join(grid.shuffled(label), "id")
    kind = F.when(F.max("degree") > 2, "branched").when(F.min("degree") == 2, "closed").otherwise("open")
    return degree.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("degree") == 1).alias("ends"), kind.alias("kind"))


def _node_pairs(lines: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of lines that share a node, with lengths and the angle between them there."""
    keyed = nodes(lines.withColumn("length", length_of()), tolerance)
    side = lambda p: keyed.select("kx", "ky", *(F.col(c).alias(p + c) for c in ("line_id", "ox", "oy", "length")))
    pairs = side("a_").join(grid.shuffled(side("b_")), ["kx", "ky"]).filter("a_line_id < b_line_id")
    # outward vectors point away from the line, so the angle of the lines is that of their opposites
    return pairs.withColumn("angle", G.angle_deg(F.col("a_ox"), F.col("a_oy"), F.col("b_ox"), F.col("b_oy")))


def arrowheads(lines: DataFrame, tolerance: float, leg: float = 14.0, ratio: float = 0.65, low: float = 12.0, high: float = 75.0) -> DataFrame:
    """Lines that form a V: two legs of similar length that meet under an acute angle."""
    short, long = F.least("a_length", "b_length"), F.greatest("a_length", "b_length")
    legs = _node_pairs(lines, tolerance).filter((long <= leg) & (short >= ratio * long) & F.col("angle").between(low, high))
    return legs.select(F.explode(F.array("a_line_id", "b_line_id")).alias("line_id")).distinct()


def continuations(lines: DataFrame, tolerance: float, angle: float = 150.0) -> DataFrame:
    """Lines that go straight on through a shared node."""
    on = _node_pairs(lines, tolerance).filter(F.col("angle") >= angle)
    return on.select(F.explode(F.array("a_line_id", "b_line_id")).alias("line_id")).distinct()


def both_ends_touch(lines: DataFrame, backbone: DataFrame, tolerance: float) -> DataFrame:
    """Lines of which both ends lie within ``tolerance`` of the backbone."""
    # a line of the backbone counts for its own ends: the names only tell the two sides apart
    ends = endpoints(lines).select("id", F.lit(0).cast("long").alias("line_id"), "x", "y")
    target = backbone.select(F.lit(1).cast("long").alias("line_id"), "x1", "y1", "x2", "y2")
    met = blocks.touched_ends(ends, target, tolerance)
    return met.groupBy(F.shiftright("id", 1).alias("line_id")).agg(F.count_distinct("id").alias("ends")).filter("ends = 2").select("line_id")


def merged_chains(lines: DataFrame, tolerance: float) -> DataFrame:
    """(chain, length, lines): lines joined through nodes of exactly two ends."""
    keyed = nodes(lines, tolerance).select("line_id", "kx", "ky")
    through = keyed.groupBy("kx", "ky").agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("a"), F.max("line_id").alias("b")).filter("n = 2 and a <> b")
    label = components(through, lines.select(F.col("line_id").alias("id")))
    length = G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    own = lines.join(grid.shuffled(label.select(F.col("id").alias("line_id"), F.col("component").alias("chain"))), "line_id")
    return own.groupBy("chain").agg(F.sum(length).alias("length"), F.count(F.lit(1)).alias("lines"))


def length_of() -> Column:
    return G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
