import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from placewright.llm import kneser_ney as K

SF = "/root/testdata/sf0.01"
N = K.ORDER


def brute_probability(texts):
    """p(gram) by the textbook recursion over dictionaries of code points."""
    seqs = [" " * (N - 1) + t for t in texts]
    counts = {N: Counter(s[i - N + 1 : i + 1] for s in seqs for i in range(N - 1, len(s)))}
    for k in range(N - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: K.discounts(Counter(v.values())) for k, v in counts.items()}
    ctx = {k: defaultdict(list) for k in counts}
    for k, v in counts.items():
        for g, n in v.items():
            ctx[k][g[:-1]].append(n)
    base = 1 / (len(counts[1]) + 1)

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else base
        own = ctx[k].get(g[:-1])
        if not own:
            return below
        cut = lambda n: d[k][min(n, 3) - 1] if n else 0.0
        n = counts[k].get(g, 0)
        return max(n - cut(n), 0) / sum(own) + sum(map(cut, own)) / sum(own) * below

    return p, set(counts[1])


TRAIN = ["The cat sat on the mat. ", "A dog and a cat! " * 3, "été 12 #x", "aaaa", "кошка и собака", "中文字 中文"]
TEST = ["The dog sat.", "zzz ###", "a", "", None, "MAT été", "собака кошка", "акшок", "中中文", "x" * 3000, "\x00a"]


def test_perplexity_against_brute_force(spark):
    model = K.train(spark.createDataFrame([(t,) for t in TRAIN], "text string"))
    got = K.perplexity(spark.createDataFrame([(i, "en", t) for i, t in enumerate(TEST)], "doc_id long, lang string, text string"), model).collect()
    p, _ = brute_probability(TRAIN)
    assert len(got) == len(TEST)
    for r in got:
        t = TEST[r.doc_id]
        if not t:
            assert r.perplexity is None
            continue
        s = " " * (N - 1) + t.replace("\x00", " ")
        want = math.exp(-np.mean([math.log(p(s[i - N + 1 : i + 1])) for i in range(N - 1, len(s))]))
        assert abs(r.perplexity / want - 1) < 1e-4, t
    by = {r.doc_id: r.perplexity for r in got}
    assert by[6] < by[7]  # words of a script beyond Latin against the same letters in disorder


def test_probabilities_sum_to_one(spark):
    model = K.train(spark.createDataFrame([(t,) for t in TRAIN], "text string"))
    p, letters = brute_probability(TRAIN)
    for context in ("The", " ca", "qqq", "кош"):
        grams = spark.createDataFrame([(context + c,) for c in letters], "gram string")
        got = {r.gram: r.p for r in K.probabilities(model, grams).collect()}
        assert all(abs(got[g] - p(g)) < 1e-9 for g in got) and len(got) == len(letters)
        assert abs(sum(got.values()) + p(context + "￿") - 1) < 1e-9


def test_tables_grow_with_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    few, more = (K.count_grams(docs.filter(f"doc_id % {k} = 0").select("text")).count() for k in (50, 5))
    assert more > 1.5 * few


def quantile(values, q):
    values = sorted(values)
    return values[max(math.ceil(q * len(values)), 1) - 1]


def test_fence_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.choice(["en", "de", "xx", None], p=[0.5, 0.3, 0.1, 0.1]), int(rng.integers(1, 5000)), float(rng.lognormal(1.5, 0.3))) for i in range(400)]
    rows = [(i, None if x in (None, "None") else str(x), n, v) for i, x, n, v in rows] + [(900, "en", 0, None)]
    ids = {i for i in range(400) if i % 4 == 0}
    got = K.judge(spark.createDataFrame(rows, "doc_id long, lang string, n_chars long, perplexity double"), K.stash(spark.createDataFrame([(i,) for i in ids], "doc_id long"), "ids")).collect()
    own = [r for r in rows if r[0] in ids]
    langs = {x for x, k in Counter(r[1] for r in own).items() if x and k >= K.MIN_TRUSTED}
    assert 0 < len(langs) < 3
    of = lambda x: [r for r in own if x not in langs or r[1] == x]

    def drawn(r):
        middle = quantile([math.log(o[3]) for o in of(r[1])], 0.5)
        return math.exp((r[2] * math.log(r[3]) + K.SHORT * middle) / (r[2] + K.SHORT))

    for r, g in zip(sorted(rows), sorted(got, key=lambda g: g.doc_id)):
        if r[3] is None:
            assert g.judged is None and not g.kept
            continue
        fence = quantile([drawn(o) for o in of(r[1])], K.QUANTILE)
        assert abs(g.judged - drawn(r)) < 1e-9 and abs(g.fence - fence) < 1e-9
        assert g.kept == (g.judged <= g.fence)


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = K.op1_quality_classifier(spark, SF).collect()
    assert len(got) == docs.count()
    good = [r.kept for r in got if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in got if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.25


def test_toxic_documents_are_not_trusted(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, None), (5, 1, 0), (5, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in K.trusted_ids(labels).collect()) == [1, 4]


def test_odd_rows(spark):
    text = "some plain words of the trusted kind, again and again. "
    rows = [(i, text * (1 + i % 5), "en", 1.0) for i in range(200)] + [(None, text, None, 0.0)] * 3 + [(500, None, "en", 0.0), (501, "", "xx", 0.0), (502, text * 4000, "xx", 0.0), (502, text * 4000, "xx", 0.0), (503, "#|%" * 40, "en", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(None, 1, 0), (503, None, 0)], "doc_id long, quality int, toxic int")
    assert sum(zlib.crc32(str(i).encode()) % K.HELD_OUT == 0 for i in range(200)) > K.MIN_TRUSTED
    got = K.classify(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[None].kept and by[502].kept and not by[500].kept and not by[501].kept and not by[503].kept
    assert K.classify(docs.limit(0), labels).count() == 0
    assert all(r.kept == bool(r.n_chars) for r in K.classify(docs, labels.limit(0)).collect())


def test_many_equal_rows_without_id(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("words " * 200).alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert K.classify(docs, labels).groupBy("n_chars", "kept").count().collect() == [(1200, True, 20_000)]
