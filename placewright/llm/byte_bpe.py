"""Byte-level BPE encoding and decoding (operator 5).

Texts are cut into overlapping chunks that are pre-tokenised independently.
The pre-token pattern only looks forward, so once two neighbouring chunks agree
on one boundary inside their overlap they agree on all later ones: the chunks
are stitched at the first shared boundary, and the resulting pieces are encoded.
Decoding concatenates the raw bytes of the ids.

Texts of at most ``chunk`` characters are one chunk and never move.  Longer
texts become one row per chunk, are pre-tokenised in parallel and gathered again
per text; such a group holds one text, which was one row before.  Where no
boundary is shared inside an overlap (one endless run of letters), the earlier
chunk's scan goes on through the following text until it meets a boundary of
the later chunk, so the result never depends on the chunk size.

Defined cases: null or empty text gives no ids and decodes to no bytes; repeated
rows (and repeated ids with other texts) each keep their row; a null doc_id is
kept; columns other than doc_id and text are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import functools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import id_and_text, table

CHUNK = 1 << 15
OVERLAP = 1 << 10
PIECE_CACHE = 400_000

IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
BYTES = T.StructType([*IDS.fields, T.StructField("decoded", T.BinaryType())])


@functools.lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    """Rank file of the tiktoken kind: base64 of the bytes, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def _merger(path: str, pattern: str):
    import tiktoken

    own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})
    return own._core_bpe.encode_single_piece


@functools.lru_cache(maxsize=4)
def _token_bytes(path: str) -> dict[int, bytes]:
    return {rank: raw for raw, rank in _ranks(path).items()}


class _PieceEncoder:
    """Ids of pre-tokens; remembers a bounded number of them."""

    def __init__(self, path: str, pattern: str) -> None:
        self.merge, self.known = _merger(path, pattern), {}

    def __call__(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        known = self.known
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode())
                if len(piece) <= 64:
                    if len(known) >= PIECE_CACHE:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def boundaries(text: str, pattern: str, last: bool) -> list[int]:
    """Starts of the pre-tokens of ``text`` that cannot change when text follows.

    Unless the chunk is the last, matches that touch its end (or stop one
    character before it, where a look-ahead could see more) are uncertain.
    """
    out, at = [0], 0
    limit = len(text) - (0 if last else 1)
    for m in regex.compile(pattern).finditer(text):
        at = m.end()
        if at >= limit and not last:
            break
        out.append(at)
    return out


def stitch(chunks: list[tuple[int, str, list[int]]], pattern: str) -> list[str]:
    """Pre-tokens of the whole text from (start, chunk text, boundaries) in order.

    Linear in the text: only the boundaries inside an overlap are looked at twice.
    """
    starts = [c[0] for c in chunks]
    text = "".join(c[1][: (starts[i + 1] if i + 1 < len(chunks) else c[0] + len(c[1])) - c[0]] for i, c in enumerate(chunks))
    cuts = list(chunks[0][2])
    rx = regex.compile(pattern)
    for start, _, own in chunks[1:]:
        both = {b + start for b in own[: bisect_right(own, cuts[-1] - start)]}
        meet = next((i for i in range(bisect_left(cuts, start), len(cuts)) if cuts[i] in both), None)
        if meet is None:
            # no agreement inside the overlap: go on from the last certain boundary
            later = {b + start for b in own}
            while cuts[-1] < len(text) and not (cuts[-1] >= start and cuts[-1] in later):
                cuts.append(rx.match(text, cuts[-1]).end())
        else:
            del cuts[meet + 1 :]
        cuts += [b + start for b in own[bisect_right(own, cuts[-1] - start) :]]
    while cuts[-1] < len(text):
        cuts.append(rx.match(text, cuts[-1]).end())
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def _encode_short(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, find = _PieceEncoder(path, pattern), regex.compile(pattern).findall
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [np.array(encode(find(t)) if t else [], np.int32) for t in part.column("text").to_pylist()]
                yield _id_batch(part.column("doc_id"), ids)

    return run


def _id_batch(doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``."""
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than the chunk")
    rows = id_and_text(docs)
    long = F.length("text") > chunk
    short = rows.filter(~F.coalesce(long, F.lit(False))).mapInArrow(_encode_short(path, pattern), IDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "key"))):
                n = -(-len(text) // chunk)
                for at in range(0, n, 64):
                    some = range(at, min(n, at + 64))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([doc_id] * len(some), pa.int64()),
                            "key": pa.array([key] * len(some), pa.int64()),
                            "nr": pa.array(list(some), pa.int32()),
                            "of": pa.array([n] * len(some), pa.int32()),
                            "part": pa.array([text[i * chunk : (i + 1) * chunk + overlap] for i in some], pa.string()),
                        }
                    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, nr, of = (batch.column(c).to_pylist() for c in ("part", "nr", "of"))
            cuts = [boundaries(t, pattern, (i + 1) * chunk + overlap >= (n - 1) * chunk + len(t) and i == n - 1) for t, i, n in zip(part, nr, of)]
            yield batch.append_column("cuts", pa.array(cuts, pa.list_(pa.int32())))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_pieces = _PieceEncoder(path, pattern)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                found = {c["nr"]: c for c in one.column("chunks").to_pylist()[0]}
                parts = [(i * chunk, found[i]["part"], found[i]["cuts"]) for i in range(len(found))]
                yield _id_batch(one.column("doc_id"), [np.array(encode_pieces(stitch(parts, pattern)), np.int32)])

    pieces = (
        rows.filter(long)
        .withColumn("key", F.xxhash64("text"))
        .mapInArrow(cut, "doc_id long, key long, nr int, of int, part string")
        .repartition("doc_id", "key", "nr")
        .mapInArrow(split, "doc_id long, key long, nr int, of int, part string, cuts array<int>")
    )
    whole = (
        pieces.groupBy("doc_id", "key", "nr")
        .agg(F.first("part").alias("part"), F.first("cuts").alias("cuts"), F.count(F.lit(1)).alias("copies"))
        .groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("nr", "part", "cuts")).alias("chunks"), F.min("copies").alias("copies"))
        # a repeated row gives its result once for each time it occurs
        .select("doc_id", "chunks", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .select("doc_id", "chunks")
    )
    return short.unionByName(whole.mapInArrow(join, IDS))


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes of each row's ids, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = _token_bytes(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                column = part.column("ids")
                values, offsets = column.flatten().to_pylist(), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0))])
                out = [b"".join([raw[i] for i in values[a:b]]) for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), column, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return ids.select("doc_id", "ids").mapInArrow(run, BYTES)


def digest_columns() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 from the columns ids and decoded."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digest columns of the contract, from the operator's own outputs."""
    return decode(encode(docs, path, pattern), path).select("doc_id", *digest_columns())


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *public_vocabulary())
