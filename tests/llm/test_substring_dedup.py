import hashlib
import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from placewright.llm import substring_dedup as S
from placewright.llm.substring_dedup import WINDOW


def brute(texts):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + WINDOW]) for w in words for i in range(len(w) - WINDOW + 1))
    out = []
    for w in words:
        free = [True] * len(w)
        for i in range(len(w) - WINDOW + 1):
            if seen[tuple(w[i : i + WINDOW])] > 1:
                free[i : i + WINDOW] = [False] * WINDOW
        out.append((len(w), free.count(False), b" ".join(x for x, f in zip(w, free) if f).decode()))
    return out


def check(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    assert [got[i] for i in range(len(texts))] == want
    return want


def test_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, gone, kept) in zip(rows, brute([r.text for r in rows]))}
    got = S.op2_substring_dedup(spark, sf)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert sum(w[1] for w in want.values()) > 0


def test_repeats_at_every_length(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "a"] + [f"w{i}" for i in range(200)])
    texts = []
    passages = [[word() for _ in range(n)] for n in (33, 34, 35, 36, 40, 70)]
    for i in range(80):
        body = [word() for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            at = rng.randint(0, len(body))
            body[at:at] = p
        texts.append(rng.choice([" ", "\n", " \t "]).join(body))
    want = check(spark, texts)
    assert 0 < sum(w[1] for w in want) < sum(w[0] for w in want)


def test_runs_and_small_alphabets(spark):
    rng = random.Random(2)
    texts = ["a " * 35, "a " * 34, "a " * 90, "b " * 36, "a b " * 60, "a b " * 17 + "a", "a a b " * 30 + "c", "z"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(30, 300))) for _ in range(30)]
    check(spark, texts)


def test_odd_rows(spark):
    long = " ".join(f"n{i}" for i in range(60000))
    rows = [(None, long), (1, None), (2, ""), (3, "few words"), (4, " ".join(f"m{i}" for i in range(40))), (4, " ".join(f"m{i}" for i in range(40))), (4, "other")]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 60000, 0), (1, 0, 0), (2, 0, 0), (3, 2, 0), (4, 40, 40), (4, 40, 40), (4, 1, 0)], key=repr)
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    for _ in range(300):
        window = rng.integers(0, 6, WINDOW).astype(np.uint64)
        got = []
        for _ in range(2):
            pre, post = rng.integers(0, 6, rng.integers(0, 30)), rng.integers(0, 6, rng.integers(0, 30))
            h = S.X.mix(np.concatenate([pre, window, post]).astype(np.uint64))
            _, lo, n, key, _ = S.anchors(h, np.array([0, len(h)]))
            got.append(key[np.searchsorted(lo, len(pre), "right") - 1])
        assert got[0] == got[1]


def test_rounds_follow_the_window():
    assert S.rounds(35) == ((4, 8), 8) and S.rounds(63) == ((4, 8, 16), 16) and S.rounds(20) == ((4,), 4)


def test_many_equal_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    start = time.time()
    got = S.remove_repeats(docs).groupBy("n_words", "n_removed", "kept").count().collect()
    assert [tuple(r) for r in got] == [(60, 60, "", 20_000)]
    assert time.time() - start < 120
