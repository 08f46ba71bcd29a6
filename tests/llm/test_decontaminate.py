import random

import numpy as np

from placewright.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def nearest(item, text):
    """Smallest edit distance of ``item`` to any run of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_best_run_is_the_nearest():
    rng = random.Random(3)
    for _ in range(200):
        item = [rng.randrange(6) for _ in range(rng.randint(1, 9))]
        text = [rng.randrange(6) for _ in range(rng.randint(1, 20))]
        want = nearest(item, text)
        got = D.best_run(np.array(item), np.array(text), want)
        assert got and got[2] == want and nearest(item, text[got[0] : got[1]]) == want
        assert want == 0 or D.best_run(np.array(item), np.array(text), want - 1) is None


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at = rng.randrange(len(words))
        rng.choice([lambda: words.__setitem__(at, "zz%d" % rng.randrange(99)), lambda: words.insert(at, "yy"), lambda: words.pop(at)])()
    return words


def test_recall_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 60
    items = [[rng.choice(vocab) for _ in range(rng.randint(12, 50))] for _ in range(25)]
    docs = []
    for i in range(300):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if i % 2:
            item = rng.choice(items)
            at = rng.randint(0, len(body))
            body[at:at] = edited(rng, item, rng.randint(0, len(item) // 4))
        docs.append(body)
    want = {(i, j) for i, d in enumerate(docs) for j, w in enumerate(items) if d and nearest(w, d) <= int(len(w) * D.MAX_EDIT)}
    got = D.find(
        spark.createDataFrame([(i, " ".join(d).upper(), 0) for i, d in enumerate(docs)], "doc_id long, text string, item_id int"),
        spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string"),
    ).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs <= want
    assert len(pairs) >= 0.98 * len(want) > 100
    for r in got:
        run = docs[r.doc_id][r.start_word : r.start_word + r.n_words]
        assert nearest(items[r.item_id], run) == r.distance


def test_table_and_clean_documents(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.doc_id: " " + " ".join(r.text.lower().split()) + " " for r in docs.collect()}
    passages = {r.item_id: " " + " ".join(r.text.lower().split()) + " " for r in items.collect()}
    exact = {(i, j) for i, t in texts.items() for j, p in passages.items() if p in t}
    found = {(r.doc_id, r.item_id) for r in D.find(docs, items).collect()}
    assert exact <= found and exact
    left = D.clean(docs, items)
    assert left.columns == docs.columns and left.count() == len(texts) - len({i for i, _ in found})


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "one two three four five", 1), (1, None, 1), (2, "", 1), (3, "x " * 200000 + "one two three four five", 1), (3, "one two three", 1)], "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(7, "One two three four five"), (8, None), (9, " \n"), (None, "x"), (7, "One two three four five")], "item_id long, text string")
    got = sorted({(r.doc_id, r.item_id) for r in D.find(docs, items.filter("item_id is not null")).collect()}, key=repr)
    assert got == [(3, 7), (None, 7)]
    assert D.find(docs.limit(0), items).count() == 0 and D.find(docs, items.limit(0)).count() == 0
    assert D.clean(docs, items.limit(0)).count() == 5
