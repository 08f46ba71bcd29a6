import random

import pytest
from pyspark.sql import functions as F

from placewright.llm import near_dedup as N
from placewright.llm.components import components
from placewright.llm.storage import likely, stash


def brute(texts):
    """(size, component as least id) of each (id, text), links on full sets."""
    sets = {}
    for i, t in texts:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    near = {(a, b) for v in holders.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, label int")
    got = N.group(docs).collect()
    assert len(got) == len(texts)
    want = brute(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_table_against_brute_force(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()])


@pytest.mark.parametrize("small", [48, 4])
def test_groups_at_the_threshold(spark, small, monkeypatch):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(8):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 120, 300]))]
        for c in range(25):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append((len(texts) + 10, " ".join(own)))
    check(spark, texts)


def deep_texts(documents, seed=11):
    """Texts of 30 passages with three wordings each, and for each a partner at 0.76.

    Every token is in a third of the texts, so that only deep nodes part the pairs.
    """
    rng = random.Random(seed)
    wordings = [[" ".join(f"p{s}v{v}w{w}" for w in range(12)) for v in range(3)] for s in range(30)]
    out = []
    for _ in range(documents // 2):
        first = [rng.randrange(3) for _ in wordings]
        second = list(first)
        at = rng.randrange(25)
        for s in range(at, at + 6, 2):
            second[s] = (second[s] + 1) % 3
        for choice in (first, second):
            out.append((len(out), " ".join(w[c] for w, c in zip(wordings, choice))))
    return out


def test_pairs_in_deep_nodes(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 4)
    check(spark, deep_texts(600))


def test_trees_follow_the_depth():
    # closed form of one tree: 1/4 at the first level, 1/4 + 3/4 * 3/16 at the second
    assert abs(sum(N.parted(1, 1) for _ in range(4)) - 1) < 1e-9
    assert abs(N.parted(2, 1) - 0.39) < 0.01 and abs(N.parted(5, 1) - 0.60) < 0.01
    assert N.trees_for(1) == N.TREES
    for levels in range(1, 9):
        assert N.parted(levels, N.trees_for(levels)) <= 1 - N.RECALL
    assert N.parted(3, 8) > 0.005


def test_odd_rows(spark):
    rows = [(5, "Same short text"), (3, "same short  TEXT"), (9, None), (8, ""), (7, " \n"), (None, "same short text"), (None, "alone here"), (4, "x " * 100000), (4, "x " * 100000), (4, "other words than those before")]
    got = N.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    seen = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr)
    assert seen == sorted(
        [(5, 1, 3, False), (3, 1, 3, True), (9, 0, 9, True), (8, 0, 8, True), (7, 0, 7, True), (None, 1, 3, False), (None, 1, None, True), (4, 1, 4, True), (4, 1, 4, True), (4, 1, 4, True)], key=repr
    )
    assert N.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_linked_members_only_go_where_others_are(spark):
    token = lambda k: [k % 4] * N.POSITIONS
    classes = spark.createDataFrame([(k, token(k)) for k in range(40)], "class long, tokens array<int>")
    rows = spark.createDataFrame([(k, 1000 if k < 37 else k, node, 40) for k in range(40) if k not in (38, 39) for node in (5, 6, 7)], "class long, label long, node long, size int")
    got = N._branch(rows, classes, 1).collect()
    # class 37 is the only one of another label: of the linked ones those with its token stay
    assert {r["class"] for r in got} == {k for k in range(38) if k % 4 == 1}
    by_node = {n: {r["class"] for r in got if r.node == n} for n in {r.node for r in got}}
    assert len(got) == len(set(got)) and all(v == {k for k in range(38) if k % 4 == 1} for v in by_node.values()) and len(by_node) >= 3


def test_dense_nodes_of_several_trees_meet_at_once(spark):
    # twelve trees hold the same 600 linked classes, each with two others of its own; one node has no label that is most of it
    rows = [(k, 1000, node, 602) for k in range(600) for node in range(12)] + [(2000 + 2 * node + i, 2000 + 2 * node + i, node, 602) for node in range(12) for i in range(2)]
    rows += [(5000 + k, 5000 + k // 2, 99, 60) for k in range(60)]
    got = N._blocks(spark.createDataFrame(rows, "class long, label long, node long, size long")).collect()
    at, want = {}, {}
    for r in got:
        at.setdefault(r["class"], set()).add(r.node)
    for c, label, node, _ in rows:
        want.setdefault(node, []).append((c, label))
    for members in want.values():
        assert all(at[a] & at[b] for a, x in members for b, y in members if x != y)
    assert len(got) < 3 * 1000


def test_dense_nodes_of_one_largest_label_meet_once(spark):
    # twenty trees hold the same 1,000 classes, under half of them linked
    rows = [(k, 1 if k < 400 else 1000 + k, node, 1000) for k in range(1000) for node in range(20)]
    got = N._blocks(spark.createDataFrame(rows, "class long, label long, node long, size long")).collect()
    at = {}
    for r in got:
        at.setdefault(r["class"], set()).add(r.node)
    assert all(at[a] & at[b] for a in range(1000) for b in range(max(a + 1, 400), 1000))
    assert len(got) < 3 * 1000


def test_dense_nodes_that_share_only_a_label_stay_apart(spark):
    # as one node the 40 others of each would meet those of all
    rows = [(c, label, node, 60) for node in range(30) for c, label in [(k, 1) for k in range(20)] + [(1000 + 40 * node + k, 1000 + 40 * node + k) for k in range(40)]]
    got = N._blocks(spark.createDataFrame(rows, "class long, label long, node long, size long")).collect()
    members = {}
    for r in got:
        members.setdefault(r.node, set()).add(r["class"])
    # of each node one block of the 40, and one of the 40 with the 20
    assert sorted(map(len, members.values())) == [40] * 30 + [60] * 30


def test_families_of_several_levels_have_names_of_their_own(spark):
    level = lambda nodes: N._blocks(spark.createDataFrame([(k, 1 if k < 40 else k, n, 60) for n in nodes for k in range(60)], "class long, label long, node long, size long"))
    first, second = ({r.node for r in level(nodes).collect()} for nodes in (range(3), range(10, 13)))
    assert first and second and not first & second


def test_leaves_with_the_same_members_are_taken_once(spark):
    rows = [(c, c, node) for node in range(16) for c in (3, 4, 5)] + [(c, c, 50) for c in (3, 4)] + [(c, c, 51) for c in (4, 5)]
    got = {}
    for r in N._different(spark.createDataFrame(rows, "class long, label long, node long")).collect():
        got.setdefault(r.node, set()).add(r["class"])
    assert sorted(map(sorted, got.values())) == [[3, 4], [3, 4, 5], [4, 5]]


def test_few_texts_are_exchanged_for_the_wanted_classes(spark):
    docs = spark.createDataFrame([(i, f"text number {i // 2}") for i in range(4000)], "doc_id long, text string")
    classes = stash(N.classes_of(N.sketches(docs)), "classes")
    wanted = classes.join(docs.filter("doc_id % 80 = 0").select(F.col("doc_id").alias("one")), F.col("rep.doc_id") == F.col("one")).select("class")
    texts = N._texts_of(docs, classes, wanted)
    assert sorted(r.text for r in texts.collect()) == sorted(f"text number {i}" for i in range(0, 2000, 40))
    names = stash(spark.range(0, 200000, 10).select(F.xxhash64("id").alias("name")), "names")
    some = likely(spark.range(200000).select("id", F.xxhash64("id").alias("name")), "name", names)
    assert some.columns == ["id", "name"] and some.filter("id % 10 = 0").count() == 20000
    assert some.count() < 1.03 * 200000 / 10 + 0.03 * 180000
    assert likely(docs.select("doc_id"), "doc_id", stash(docs.select("doc_id").filter("doc_id < 0"), "names")).count() == 0


def test_few_pairs_are_compared_rather_than_branched_on(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 4)
    docs = spark.createDataFrame(deep_texts(600), "doc_id long, text string")
    classes = stash(N.classes_of(N.sketches(docs)), "classes")
    none = spark.createDataFrame([], "class long, label long")
    leaves, levels = N._grow(classes, none, range(2))
    assert levels <= 2
    monkeypatch.setattr(N, "FEW", 0)
    deep, more = N._grow(classes, none, range(2))
    assert more > levels
    # what deep leaves hold together these do too
    met = lambda rows: rows.alias("x").join(rows.alias("y"), F.expr("x.node = y.node and x.class < y.class")).select("x.class", F.col("y.class").alias("other")).distinct()
    assert met(deep).exceptAll(met(leaves)).count() == 0
    check(spark, deep_texts(600))
