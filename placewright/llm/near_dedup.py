"""Near-duplicate groups by chosen-path similarity join (operator 4).

A document's set holds its distinct five-word shingles (A-Z lower-cased).  Equal
sets are one class.  Each class has a sketch of ``POSITIONS`` minwise tokens, and
``TREES`` independent trees branch the classes recursively by selected minwise
tokens: a node's children are chosen by one token (two in a third of the nodes,
so that a pair at the threshold keeps 1 / 0.75 * 0.75 = 1 shared child on
average).  Nodes of at most ``SMALL`` classes are compared exhaustively; larger
ones branch on.

Copies are not expanded into pairs.  First every class meets the most central
member of its nodes (the one with most company over all trees); links confirmed
on the full sets give a first labelling.  Then only nodes that still hold several
labels branch on and are compared exhaustively, leaving out pairs that are linked
already.  A large node that keeps over half of its parent's members holds copies
that no token tells apart; it is compared in blocks, all labels against all, so
nothing is capped.  Such nodes of several trees hold mostly the same classes: those
with the same largest label meet as one, if that costs less.  Once the large nodes
hold at most ``FEW`` pairs a class, all these are compared and nothing branches on.

Links are confirmed on full sets: 100 * intersection >= 75 * union, on 64-bit
shingle hashes.  A sketch only rules out pairs that agree in under half of the
positions, which a pair at the threshold does with probability 2e-6.  The number
of trees follows from the depth they reach: a pair at the threshold is parted in
one tree with probability 0.25 / 0.39 / 0.48 / 0.55 / 0.60 at 1 to 5 levels, and
more often if its sketch happens to agree in fewer positions, so trees are added
until at most 1 - ``RECALL`` of such pairs are parted in all of them (16 trees up
to two levels, 20 / 24 / 32 at 3 / 4 / 5).

Defined cases: null or empty texts and texts without words have an empty set,
link with nothing and are their own component; texts under five words are one
shingle; repeated rows have equal sets and are linked; a row with a null doc_id
takes part, and has a null component_id only if no linked row has an id (it is
kept only then); other columns are ignored; an empty table gives an empty result.
Classes are named by 64 bits of their set's hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textcore as X
from .components import components
from .storage import id_and_text, likely, small_batches, stash, table

SHINGLE = 5
PERCENT = 75
POSITIONS = 64
TREES = 16
RECALL = 0.9999
SMALL = 48
BLOCK = 512
MIN_AGREE = POSITIONS // 2
FEW = 100  # pairs a class that are compared rather than branched on
ROW = 100  # pairs of sketches compared at the cost of one row more
STARS = 3

_rng = np.random.default_rng(75)
_MUL = _rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of several texts, and where each text's begin."""
    words = X.Words(data, offsets, lower=True)
    n = words.counts
    size = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    text = X.owner_of(size)
    first = np.cumsum(size) - size
    start = words.first[:-1][text] + np.arange(len(text)) - first[text]
    end = np.minimum(start + SHINGLE, words.first[1:][text])
    values = X.window_hash(words.hash, start, end)
    for a, b in zip(first.tolist(), (first + size).tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    count = np.bincount(text[keep], minlength=len(size)).astype(np.int64)
    return values[keep], np.concatenate([[0], np.cumsum(count)])


def _sketch_batch(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set hash (two words) and minwise tokens of each text (zeros for empty sets)."""
    rows = len(begin) - 1
    full = np.flatnonzero(np.diff(begin) > 0)
    h1, h2, tokens = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64), np.zeros((rows, POSITIONS), np.uint32)
    if len(full):
        at = begin[full]
        h1[full] = X.mix(np.add.reduceat(X.mix(values, 1), at), 3)
        h2[full] = X.mix(np.add.reduceat(X.mix(values, 2), at), 4)
        for p in range(POSITIONS):
            tokens[full, p] = np.minimum.reduceat(((values * _MUL[p] + _ADD[p]) >> np.uint64(32)).astype(np.uint32), at)
    return h1, h2, tokens


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, class, check, tokens) of every row; key is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in X.slices(batch.column("text")):
                values, begin = shingle_sets(data, offsets)
                h1, h2, tokens = _sketch_batch(values, begin)
                part = batch.slice(a, b - a)
                flat = pa.array(tokens.view(np.int32).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, POSITIONS, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(np.diff(begin)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists],
                    ["doc_id", "key", "n", "class", "check", "tokens"],
                )

    rows = id_and_text(docs).withColumn("key", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, key long, n long, class long, check long, tokens array<int>")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(-1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, POSITIONS)


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sets(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in X.slices(pa.array(texts, pa.string())):
        values, begin = shingle_sets(data, offsets)
        out += [values[a:b] for a, b in zip(begin, begin[1:])]
    return out


def _close_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _agree(_matrix(batch.column("ta")), _matrix(batch.column("tb"))) >= MIN_AGREE
            yield batch.select(["a", "b"]).filter(pa.array(near))

    tokens = classes.select("class", "tokens")
    both = pairs.join(tokens.select(F.col("class").alias("a"), F.col("tokens").alias("ta")), "a").join(tokens.select(F.col("class").alias("b"), F.col("tokens").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, text): one text of every class in ``wanted``; few others are exchanged."""
    rep = classes.join(wanted, "class", "left_semi").select("class", F.col("rep.key").alias("key"), F.coalesce("rep.doc_id", F.lit(0)).alias("at"))
    rep = stash(rep.withColumn("name", F.xxhash64("key", "at")), "wanted")
    rows = id_and_text(docs).select(F.xxhash64("text").alias("key"), F.coalesce("doc_id", F.lit(0)).alias("at"), "text")
    rows = likely(rows.withColumn("name", F.xxhash64("key", "at")), "name", rep)
    return rows.join(rep, ["name", "key", "at"]).groupBy("class").agg(F.first("text").alias("text"))


def _confirm_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that are linked, judged on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                first, second = _sets(part.column("xa").to_pylist()), _sets(part.column("xb").to_pylist())
                yield part.select(["a", "b"]).filter(pa.array([_similar(x, y) for x, y in zip(first, second)], pa.bool_()))

    left = texts.select(F.col("class").alias("a"), F.col("text").alias("xa"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("xb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def parted(levels: int, trees: int) -> float:
    """Share of the pairs at the threshold that no tree of ``levels`` levels keeps together."""
    total = 0.0
    for same in range(POSITIONS + 1):
        share, below = same / POSITIONS, 0.0
        for _ in range(levels - 1):
            one = 1 - share + share * below
            below = (2 * one + one * one) / 3  # two tokens in a third of the nodes
        chance = math.comb(POSITIONS, same) * (PERCENT / 100) ** same * (1 - PERCENT / 100) ** (POSITIONS - same)
        total += chance * (1 - share + share * below) ** trees
    return total


def trees_for(levels: int) -> int:
    """Trees of ``levels`` levels that find ``RECALL`` of the pairs at the threshold."""
    trees = TREES
    while parted(levels, trees) > 1 - RECALL:
        trees += 4
    return trees


def _roots(classes: DataFrame, trees: range) -> DataFrame:
    """(class, tree, node): the first level of the trees, one token each (used again after ``POSITIONS`` trees)."""
    nodes = F.array(*(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.col("tokens")[t % POSITIONS]).alias("node")) for t in trees))
    return classes.select("class", F.explode(nodes).alias("x")).select("class", "x.tree", "x.node")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows whose node has company, with its size."""
    size = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rows.join(size, "node")


def _star_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): every class with the most central members of its nodes."""
    rows = stash(_sized(_roots(classes, range(TREES))).select("class", "node", "size"), "nodes")
    company = rows.groupBy("class").agg(F.sum("size").alias("company"))
    centre = rows.select("class", "node").join(company, "class").groupBy("node").agg(F.max(F.struct("company", "class")).alias("top")).select("node", F.col("top.class").alias("a"))
    met = rows.select("class", "node").join(centre, "node").filter("a <> class").groupBy("a", F.col("class").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("times"), "a"))  # at most TREES rows each
    return met.withColumn("rank", rank).filter(F.col("rank") <= STARS).select("a", "b")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold several labels, with the node's size."""
    state = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    return rows.join(state.select("node", "size"), "node")


def _branch(rows: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """Children of the nodes of ``rows``: one token, or two for a third of the nodes.

    The members of a node's largest label are linked with each other already, so
    they only go to the children where one of another label is.
    """
    where = [F.pmod(F.xxhash64("node", F.lit(level), F.lit(i)), F.lit(POSITIONS)).cast("int") for i in range(2)]
    child = [F.xxhash64("node", F.lit(i), F.col("tokens")[where[i]]) for i in range(2)]
    two = F.pmod(F.xxhash64("node", F.lit(level), F.lit(2)), F.lit(3)) == 0
    named = _with_most(rows.select("class", "label", "node", "size")).join(classes.select("class", "tokens"), "class")
    # the second child is null where there is one only
    named = stash(named.select("class", "label", F.col("size").alias("parent"), (F.col("label") == F.col("most.label")).alias("major"), child[0].alias("c0"), F.when(two, child[1]).alias("c1")), "children")
    own = ["class", "label", "parent"]
    minor = named.filter("not major").select(*own, F.explode(F.array_compact(F.array("c0", "c1"))).alias("node"))
    met = minor.select("node").distinct()
    out = minor
    for c in ("c0", "c1"):
        out = out.unionByName(named.filter("major").select(*own, F.col(c).alias("node")).join(met, "node", "left_semi"))
    return out


def _with_most(rows: DataFrame) -> DataFrame:
    """Rows with ``most``: number and name of their node's largest label."""
    sizes = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max(F.struct("n", "label")).alias("most"))
    return rows.join(sizes, "node")


def _blocks(rows: DataFrame) -> DataFrame:
    """Nodes that stay large, as nodes of two blocks each: all labels meet.

    The members of a node's largest label are linked with each other already, so
    they are dealt to blocks of their own, which only meet those of the others.
    """
    return _dealt(_families(stash(_with_most(rows.select("class", "label", "node", "size")), "dense")))


def _families(df: DataFrame) -> DataFrame:
    """Dense nodes, those of the same largest label as one node, if that costs less.

    Other trees hold mostly the same members, which then meet once and not once in
    every tree.  The cost is that of the pairs to compare and of the members' rows.
    """
    of = F.col("most.label").alias("of")
    cost = (F.col("size").cast("double") * (F.col("size") - F.col("most.n") + ROW)).alias("cost")
    nodes = df.groupBy("node").agg(F.first(of).alias("of"), F.first(cost).alias("cost"))
    alone = nodes.groupBy("of").agg(F.sum("cost").alias("alone"), F.min("node").alias("node"))
    members = stash(df.select("class", "label", of).distinct(), "merged")
    family = members.groupBy("of").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("label") == F.col("of")).alias("n"))
    family = family.select("of", "size", F.struct("n", F.col("of").alias("label")).alias("most")).select("of", "size", "most", cost)
    # a name of its own: other trees and levels have families of the same label
    one = family.join(alone, "of").filter("cost <= alone").select("of", F.xxhash64(F.lit("family"), "node").alias("node"), "size", "most")
    one = stash(one, "family")
    rest = df.withColumn("of", of).join(one.select("of"), "of", "left_anti")
    return members.join(one, "of").select("class", "label", "node", "size", "most").unionByName(rest.select("class", "label", "node", "size", "most"))


def _dealt(df: DataFrame) -> DataFrame:
    """Members of nodes, with ``most``, in pairs of blocks: those of the largest label do not meet each other."""
    major = F.greatest(F.ceil(F.col("most.n") / BLOCK), F.lit(1)).cast("int")
    minor = F.greatest(F.ceil((F.col("size") - F.col("most.n")) / BLOCK), F.lit(1)).cast("int")
    in_major = F.col("label") == F.col("most.label")
    own = F.when(in_major, F.pmod(F.xxhash64("class"), major)).otherwise(major + F.pmod(F.xxhash64("class"), minor)).cast("int")
    others = F.sequence(F.when(in_major, major).otherwise(F.lit(0)), major + minor - 1)
    pair = F.transform(others, lambda o: F.xxhash64("node", F.least(own, o), F.greatest(own, o)))
    return df.select("class", "label", F.explode(pair).alias("node"))


def _grow(classes: DataFrame, labels: DataFrame, trees: range) -> tuple[DataFrame, int]:
    """(class, label, node) of the nodes of some trees to compare exhaustively, and the levels reached.

    Large nodes branch on until few pairs are left in them: then all of these are compared.
    """
    few = FEW * classes.count()
    roots = _roots(classes, trees).join(labels, "class", "left")
    rows = roots.select("class", F.coalesce("label", "class").alias("label"), F.lit(1 << 62).alias("parent"), "node")
    out, level = None, 0
    while True:
        rows = stash(_mixed(rows), "mixed")
        small = rows.filter(F.col("size") <= SMALL).select("class", "label", "node")
        out = small if out is None else out.unionByName(small)
        large = rows.filter(F.col("size") > SMALL)
        dense = F.col("size") * 2 > F.col("parent")
        crowds, pairs = large.agg(F.count_if(dense), F.sum(F.when(~dense, F.col("size")).otherwise(0))).first()
        last = (pairs or 0) <= few  # none are left, or few
        if crowds or last and pairs:  # written, so that what reads the leaves of all trees stays one small plan
            out = out.unionByName(stash(_mixed(_blocks(large if last else large.filter(dense))).select("class", "label", "node"), "blocks"))
        if last:
            return out, level + 1
        large = large.filter(~dense)
        level += 1
        if level == 1:  # later levels hold no other classes
            classes = stash(likely(classes.select("class", "tokens"), "class", stash(large.select("class").distinct(), "crowd")), "crowded")
        rows = _branch(large, classes, level)


def _leaves(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(class, label, node) of the nodes to compare exhaustively, of as many trees as ``RECALL`` takes."""
    out, have, need, depth = None, 0, TREES, 1
    while have < need:
        more, levels = _grow(classes, labels, range(have, need))
        out = more if out is None else out.unionByName(more)
        depth = max(depth, levels)
        have, need = need, trees_for(depth)
    return out


def _different(leaves: DataFrame) -> DataFrame:
    """``leaves`` without those that have the members of another one (mostly of another tree)."""
    names = [F.bit_xor(F.xxhash64("class", F.lit(i))).alias(f"name{i}") for i in range(2)]
    sets = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("size"), *names)
    one = sets.groupBy("size", "name0", "name1").agg(F.min("node").alias("node"))
    return leaves.join(one.select("node"), "node", "left_semi")


def _involved(leaves: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, label, node): members of leaves with a close member of another label.

    Involved members that are the same in several leaves are taken once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: tuple[list, list, list] = ([], [], [])
            members = batch.column("members")
            starts = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            flat = members.flatten()
            cls, lab = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("class", "label"))
            tok = _matrix(flat.field("tokens"))
            for a, b in zip(starts, starts[1:]):
                close = np.zeros(b - a, bool)
                for i in range(a, b - 1):
                    rest = slice(i + 1, b)
                    hit = (lab[rest] != lab[i]) & (_agree(tok[rest], tok[i]) >= MIN_AGREE)
                    if hit.any():
                        close[i - a] = True
                        close[i + 1 - a :] |= hit
                if close.any():
                    at = np.flatnonzero(close) + a
                    name = int(X.mix(np.array([X.mix(cls[at].view(np.uint64), 9).sum()], np.uint64))[0].view(np.int64))
                    got[0].extend(cls[at].tolist())
                    got[1].extend(lab[at].tolist())
                    got[2].extend([name] * len(at))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["class", "label", "node"])

    leaves = stash(_different(leaves), "leaves")
    tokens = likely(classes.select("class", "tokens"), "class", stash(leaves.select("class").distinct(), "crowd"))
    lists = leaves.join(tokens, "class").groupBy("node").agg(F.collect_list(F.struct("class", "label", "tokens")).alias("members"))
    return lists.select("members").mapInArrow(run, "class long, label long, node long").distinct()


def _linked(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Matrix of the linked pairs: exact intersections as products of incidence matrices.

    Only shingles of two sets or more can be shared; their columns are taken
    ``step`` at a time.
    """
    size = np.array([len(x) for x in sets], np.float64)
    names, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = X.owner_of(size.astype(np.int64))
    place = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    row, column = row[shared], place[column[shared]]
    both = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((len(sets), step), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += part @ part.T
    return 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)


def _confirm_leaves(involved: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between labels, from exhaustive comparison inside each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members"):
                label = members.values.field("label").to_numpy(zero_copy_only=False)
                i, j = np.nonzero(_linked(_sets(members.values.field("text").to_pylist())))
                pairs = np.unique(np.stack([label[i], label[j]], 1)[label[i] < label[j]], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(2)], ["a", "b"])

    lists = involved.join(texts, "class").groupBy("node").agg(F.collect_list(F.struct("class", "label", "text")).alias("members"))
    return lists.select("members").mapInArrow(run, "a long, b long")


def classes_of(rows: DataFrame) -> DataFrame:
    """One row per distinct non-empty set: class, tokens and the row that stands for it."""
    return rows.filter("n > 0").groupBy("class").agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.first("tokens").alias("tokens"))


def label_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, label) of all classes that are linked to another."""
    stars = stash(_close_pairs(_star_pairs(classes), classes), "stars")
    wanted = stars.select(F.col("a").alias("class")).unionByName(stars.select(F.col("b").alias("class"))).distinct()
    links = _confirm_pairs(stars, stash(_texts_of(docs, classes, wanted), "texts"))
    first = components(links).select(F.col("node").alias("class"), "label")
    involved = stash(_involved(_leaves(classes, first), classes), "involved")
    more = stash(_confirm_leaves(involved, _texts_of(docs, classes, involved.select("class").distinct())), "links")
    above = components(more).select(F.col("node").alias("label"), F.col("label").alias("top"))
    all_labels = first.unionByName(involved.select("class", "label").distinct().join(first, "class", "left_anti"))
    return all_labels.join(above, "label", "left").select("class", F.coalesce("top", "label").alias("label"))


def named_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, label) of every row of ``docs``; label names its component."""
    with small_batches(docs.sparkSession):
        rows = stash(sketches(docs), "sketches")
        classes = stash(classes_of(rows), "classes")
        labels = stash(label_classes(docs, classes), "labels")
    return rows.select("doc_id", "key", "n", "class").join(labels, "class", "left").select("doc_id", "key", "n", F.coalesce("label", "class").alias("label"))


def group(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    named = named_rows(docs).drop("key")
    linked = named.filter("n > 0")
    least = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = linked.join(least, "label").select("doc_id", "n", "component_id").unionByName(named.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component (its least doc_id, nulls last); all columns stay.

    Rows with an empty set stay.  Of repeated rows one stays.
    """
    named = stash(named_rows(docs), "named")
    full = named.filter("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one")
    chosen = stash(full.groupBy("label").agg(first).select("one.doc_id", "one.key"), "chosen")
    repeated = full.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    stay = chosen.unionByName(named.filter("n = 0").select("doc_id", "key").distinct())
    # names of the join's columns that no column of ``docs`` has
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key"))
    out = docs.join(stay, own, "left_semi")
    if repeated.isEmpty():
        return out
    twice = repeated.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    some = out.join(twice, own, "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(twice, own, "left_anti").unionByName(some)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))
