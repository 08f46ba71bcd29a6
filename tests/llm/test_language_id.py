import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from placewright.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = L.op3_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_buckets_do_not_depend_on_the_batch():
    texts = ["Ab, c!", None, "", "été à  l'école", "...", "x", "Straße 12 und", " "]
    whole = L.ngram_buckets(texts)
    for i, t in enumerate(texts):
        alone = L.ngram_buckets([t])
        assert sorted(alone[0]) == sorted(whole[0][whole[1] == i]), t
        assert alone[2][0] == whole[2][i]


def scalar_bucket(gram):
    """The bucket of one n-gram, worked out with plain integers."""
    m = (1 << 64) - 1
    h = 0
    for i, c in enumerate(gram, 1):
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + i) & m
    return (((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & m) >> 48


def scalar_grams(text):
    """All n-grams of the folded text; none begins and ends in a blank alone."""
    folded = " " + re.sub(r"[^a-zäöüß]+", " ", text.lower()).strip() + " "
    return [scalar_bucket(folded[i : i + n]) for n in L.ORDERS for i in range(len(folded) - n + 1) if folded[i : i + n].strip() and (n == 1 or folded[i] != " " or folded[i + 1] != " ")]


TRAIN = [("the quick brown fox jumps over the lazy dog", "en")] * 3 + [("der schnelle braune fuchs springt über den hund", "de")] * 2 + [("die müde katze", "de"), ("el zorro", "es")]
TEST = ["the dog", "der hund über", "zorro y el", "x", "qq zz"]


def brute_posterior(text):
    """Log posteriors by dictionaries: prior plus smoothed likelihood of every n-gram."""
    out = {}
    for lang in sorted({x for _, x in TRAIN}):
        own = Counter(b for t, x in TRAIN if x == lang for b in scalar_grams(t))
        whole = sum(own.values()) + L.SMOOTHING * L.BUCKETS
        prior = sum(x == lang for _, x in TRAIN) / len(TRAIN)
        grams = scalar_grams(text)
        out[lang] = (math.log(prior) + sum(math.log((own[b] + L.SMOOTHING) / whole) for b in grams)) / len(grams)
    return out


@pytest.mark.parametrize("shard", [256, 2, 1])
def test_posterior_against_brute_force(spark, shard):
    train = spark.createDataFrame(TRAIN, "text string, lang string")
    got = L.predict(spark.createDataFrame(list(enumerate(TEST)), "i int, text string"), L.fit(train, shard=shard), "i").collect()
    for r in got:
        want = brute_posterior(TEST[r.i])
        best = max(want, key=lambda x: (want[x], [-ord(c) for c in x]))
        share = 1 / sum(math.exp(L.SHARPNESS * (v - want[best])) for v in want.values())
        assert r.lang_pred == best and abs(r.score - share) < 1e-3


def test_ties_and_many_languages(spark):
    same = spark.createDataFrame([("same text", x) for x in ("b", "a", "c")], "text string, lang string")
    for shard in (256, 1):
        got = L.predict(spark.createDataFrame([(1, "same text")], "i int, text string"), L.fit(same, shard=shard), "i").first()
        assert got.lang_pred == "a" and abs(got.score - 1 / 3) < 1e-6
    word = lambda i: "".join(chr(97 + (i // 26**k) % 26) * 2 for k in range(3))
    many = spark.createDataFrame([(f"{word(i)} {word(i)}", f"l{i:03d}") for i in range(300)], "text string, lang string")
    got = L.predict(many.withColumnRenamed("lang", "real"), L.fit(many), "real").collect()
    assert len(got) == 300 and sum(r.lang_pred == r.real for r in got) > 290


def test_odd_rows(spark):
    train = [(i, "the quick brown fox jumps over the lazy dog " * 3, "en", "x") for i in range(8)] + [(i, "der schnelle braune fuchs springt", "de", "y") for i in range(8, 16)]
    odd = [(None, "der fuchs", None, None), (50, None, "en", ""), (51, "123 !?", "de", ""), (52, "", "en", ""), (53, "the dog " * 50000, None, ""), (53, "the dog " * 50000, None, "")]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, lang_pred string")
    got = L.identify(docs).collect()
    assert len(got) == len(train) + len(odd)
    by = {r.doc_id: r for r in got}
    assert by[None].lang_pred == "de" and not by[None].held_out
    assert [by[i].lang_pred for i in (50, 51, 52, 53)] == ["und", "und", "und", "en"]
    assert L.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(docs.filter("lang is null")).collect()} == {"und"}
