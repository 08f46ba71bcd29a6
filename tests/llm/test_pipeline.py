import hashlib
import re

import corpus_pipeline as P
from placewright.llm import byte_bpe, decontaminate
from placewright.llm import quality_rules as Q

from . import duck
from .test_byte_bpe import WHOLE
from .test_decontaminate import nearest
from .test_near_dedup import brute as groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    outs = []
    for name, stage in P.STAGES:
        now = P.stash(stage(spark, now, SF), "test")
        outs.append(now)
    assert all(o.columns == docs.columns and o.dtypes == docs.dtypes for o in outs[:-1])
    texts = [{r.doc_id: r.text for r in o.collect()} for o in [docs, *outs[:-1]]]
    kept = {r[0]: r[1] for r in [(x[1], x[2]) for x in duck.rows(Q.SQL, SF)]}
    assert set(texts[1]) == {i for i, k in kept.items() if k}
    assert all(set(t.split("\n")) <= set(texts[0][i].split("\n")) for i, t in texts[1].items())
    comp = groups(sorted(texts[1].items()))
    assert set(texts[2]) == {i for i, (_, c) in comp.items() if i == c}
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, t in texts[2].items() for w in items if set(w) & set(t.lower().split()) and nearest(w, t.lower().split()) <= int(len(w) * decontaminate.MAX_EDIT)}
    assert set(texts[3]) == set(texts[2]) - dirty and all(texts[3][i] == texts[2][i] for i in texts[3])
    assert texts[4] == {i: re.sub(r'token = "[0-9a-f]{40}"', 'token = "[SECRET]"', t) for i, t in texts[3].items()}
    last = {r.doc_id: r for r in outs[-1].collect()}
    assert set(last) == set(texts[4])
    for i, r in last.items():
        ids = WHOLE.encode_ordinary(texts[4][i])
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(texts[4][i].encode()).hexdigest()
    whole = {r.doc_id: r.ids_sha256 for r in P.run(spark, SF).collect()}
    assert whole == {i: r.ids_sha256 for i, r in last.items()}


def test_repeated_rows_and_nulls(spark):
    text = "\n".join(" ".join(f"w{i}x{k}" for k in range(9)) + f", and {i} ends." for i in range(12))
    rows = [(5, text, "en", "s", 1), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (None, text, None, None, None), (7, None, "en", "s", 0), (8, "", "en", "s", 0), (8, "", "en", "s", 0), (None, "own words " * 3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(3, text), (7, None), (8, ""), (None, "own words " * 3)], key=repr) or got == sorted([(3, text), (7, None), (8, ""), (8, ""), (None, "own words " * 3)], key=repr)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).count() >= 0
