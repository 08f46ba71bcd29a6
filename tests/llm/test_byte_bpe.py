import hashlib
import time

import regex
import tiktoken

from placewright.llm import byte_bpe as B

PATH, PATTERN = B.public_vocabulary()
WHOLE = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=B._ranks(PATH), special_tokens={})

TEXTS = [
    None,
    "",
    " ",
    "Hello  world\n\n  it's 12,345 — naïve 中文",
    "x" * 5000,
    " " * 4000 + "end",
    "ab \n" * 3000,
    "word one two's 33 !? " * 700 + "   \n  \t tail",
    "é" * 700 + " " * 1300 + "'s" * 900,
]


def rows(spark):
    return spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(TEXTS)] + [(None, "null id", None, 1), (7, TEXTS[7], "en", 7)], "doc_id long, text string, ids string, decoded int")


def test_chunked_encoding_equals_whole_texts(spark):
    for chunk, overlap in ((40, 7), (256, 32), (1 << 15, 1 << 10)):
        got = B.encode(rows(spark), PATH, PATTERN, chunk, overlap).collect()
        assert len(got) == len(TEXTS) + 2
        for r in got:
            text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
            assert r.ids == WHOLE.encode_ordinary(text), (chunk, r.doc_id)


def test_stitching_is_linear_in_the_text():
    took = []
    for copies in (100_000, 1_600_000):  # 4 and 64 MB
        text = "some words here, 123 and été.  plus more\n" * copies
        n = -(-len(text) // B.CHUNK)
        parts = [text[i * B.CHUNK : (i + 1) * B.CHUNK + B.OVERLAP] for i in range(n)]
        chunks = [(i * B.CHUNK, p, B.boundaries(p, PATTERN, i == n - 1)) for i, p in enumerate(parts)]
        start = time.time()
        pieces = B.stitch(chunks, PATTERN)
        took.append(time.time() - start)
        assert sum(map(len, pieces)) == len(text)
        if copies == 100_000:
            assert pieces == regex.findall(PATTERN, text)
    assert took[1] < 60 * max(took[0], 0.2)


def test_decoding_gives_back_the_bytes(spark):
    for r in B.decode(B.encode(rows(spark), PATH, PATTERN, 100, 20), PATH).collect():
        assert bytes(r.decoded).decode() == ("null id" if r.doc_id is None else TEXTS[r.doc_id] or "")


def test_digests_and_empty_table(spark):
    got = {r.doc_id: r for r in B.digests(rows(spark), PATH, PATTERN).collect()}
    ids = WHOLE.encode_ordinary(TEXTS[3])
    assert got[3].n_tokens == len(ids)
    assert got[3].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[3].decoded_sha256 == hashlib.sha256(TEXTS[3].encode()).hexdigest()
    assert got[0].n_tokens == 0 and got[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert B.digests(rows(spark).limit(0), PATH, PATTERN).count() == 0


def test_whole_table_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = B.op5_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = WHOLE.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
