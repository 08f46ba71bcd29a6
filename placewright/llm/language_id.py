"""Language identification (operator 3): multinomial naive Bayes over hashed
character n-grams.

Counts of hashed n-grams (orders 1 to 4, over letters folded to lower case with
every run of other characters as one blank) are summed per language over whole
texts in Spark; the log-probability matrix, ``BUCKETS`` x languages as float32, is
broadcast, and batches of texts are scored in numpy as sparse bucket counts.  A
text goes to the language with the greatest log prior (share of the training
texts) plus log-likelihood.

The number of languages is not bounded.  The matrix is cut into shards of at most
``SHARD`` languages (64 MB), which are read from the counts and broadcast one
after the other; each pass carries the best language so far.  With one shard, the
usual case, the texts are read once and never moved.

The score of the best language is the softmax of the log-posteriors per n-gram
times ``SHARPNESS`` (an ordinary posterior saturates on any long text).

Defined cases: null text or text without a letter gives ``und`` and score 0;
rows with a null lang or null text teach nothing; ties go to the language that
sorts first; null doc_id is never held out (its remainder is null, reported
false); repeated rows count each and give a row each; other columns are ignored;
with no training rows every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stash, table

BUCKETS = 1 << 16
SHARD = 256
ORDERS = (1, 2, 3, 4)
SHARPNESS = 60.0
SMOOTHING = 0.5
SLICE_CHARS = 1 << 20
UND = "und"

_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> lower-case letter's code point, or blank."""
    if not _FOLD:
        out = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                out[cp] = ord(low) if len(low) == 1 else cp
        _FOLD.append(out)
    return _FOLD[0]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    row = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > row and size + n > SLICE_CHARS:
            yield row, i
            row, size = i, 0
        size += n
    if row < len(texts):
        yield row, len(texts)


def ngram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row of its text) of all n-grams, and which texts hold a letter."""
    joined = " ".join(["", *(t or "" for t in texts), ""])
    codes = _fold()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    lengths = np.array([len(t or "") for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts) + 1), np.concatenate([lengths + 1, [1]]))
    row = np.concatenate([[0], row[:-1]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)  # blanks of two texts meet in one, which belongs to the earlier
    codes, row = codes[keep], row[keep]
    letter = codes != 32
    has = np.bincount(row[letter], minlength=len(texts))[: len(texts)] > 0
    buckets, rows = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x9E3779B97F4A7C15) + (codes[n - 1 :] + np.uint64(n))
        if n not in ORDERS:
            continue
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        first, last = row[:size], row[n - 1 :]
        ok = letter[:size] if n == 1 else (letter[:size] | letter[1 : size + 1]) & ((first == last) | (~letter[:size] & (row[1 : size + 1] == last)))
        buckets.append((mixed >> np.uint64(48)).astype(np.int64)[ok])
        rows.append(last[ok])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    b, r = np.concatenate(buckets), np.concatenate(rows)
    inside = r < len(texts)
    return b[inside], r[inside], has


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", shard: int = SHARD) -> DataFrame:
    """(lang, bucket, n): n-gram counts of each language over whole texts.

    Bucket -1 counts the texts.  A task holds the counts of ``shard`` languages
    at most and hands them on before it takes up another.
    """

    def partial(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32) - 1), pa.array(own[at])], ["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for a, b in _slices(texts):
                bucket, row, _ = ngram_buckets(texts[a:b])
                names, code = np.unique(langs[a:b], return_inverse=True)
                for low in range(0, len(names), 32):  # 16 MB of counts at a time
                    some = names[low : low + 32].tolist()
                    own, size = code[row] - low, np.bincount(code, minlength=len(names))[low:]
                    inside = slice(None) if len(names) <= 32 else (own >= 0) & (own < 32)
                    flat = np.bincount(own[inside] * BUCKETS + bucket[inside], minlength=len(some) * BUCKETS).reshape(len(some), BUCKETS)
                    for k, name in enumerate(some):
                        if name not in sums:
                            if len(sums) >= shard:
                                yield from partial(sums)
                                sums = {}
                            sums[name] = np.zeros(BUCKETS + 1, np.int64)
                        sums[name][0] += size[k]
                        sums[name][1:] += flat[k]
        yield from partial(sums)

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Shard:
    """Some languages (sorted), their log priors and log-probabilities, buckets x languages."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray) -> None:
        self.langs, self.prior, self.logp = langs, prior, logp

    def best(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: whether it has a letter, the best language's number, its
        log-posterior per n-gram (sharpened), and the sum of all relative to it."""
        has, best, top, total = np.zeros(len(texts), bool), np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
        for a, b in _slices(texts):
            bucket, row, has[a:b] = ngram_buckets(texts[a:b])
            size = np.maximum(np.bincount(row, minlength=b - a), 1)
            logs = np.stack([np.bincount(row, self.logp[bucket, k], minlength=b - a) + self.prior[k] for k in range(len(self.langs))], 1)
            logs *= SHARPNESS / size[:, None]
            best[a:b], top[a:b] = logs.argmax(1), logs.max(1)
            total[a:b] = np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        return has, best, top, total


class Model:
    """Counts of the n-grams (a table) and the languages with their numbers of texts, sorted."""

    def __init__(self, counts: DataFrame, langs: list[tuple[str, int]], shard: int = SHARD) -> None:
        self.counts, self.langs, self.size = counts, langs, shard

    def shards(self) -> Iterator[Shard]:
        texts = sum(n for _, n in self.langs)
        for at in range(0, len(self.langs), self.size):
            some = self.langs[at : at + self.size]
            names = [x for x, _ in some]
            # at most ``SHARD`` x ``BUCKETS`` sums come to the driver
            part = self.counts.filter((F.col("lang") >= names[0]) & (F.col("lang") <= names[-1]) & (F.col("bucket") >= 0)).toPandas()
            n = np.zeros((BUCKETS, len(names)))
            place = {x: k for k, x in enumerate(names)}
            n[part["bucket"].to_numpy(int), part["lang"].map(place).to_numpy(int)] = part["n"].to_numpy()
            yield Shard(names, np.log(np.array([k for _, k in some]) / texts), np.log((n + SMOOTHING) / (n + SMOOTHING).sum(0)).astype(np.float32))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", shard: int = SHARD) -> Model:
    """Train on all rows of ``docs`` with a text and a language; the names of the languages come to the driver."""
    table = stash(counts(docs, text, lang, shard), "languages")
    langs = table.filter("bucket = -1").select("lang", "n").collect()
    return Model(table, sorted((r.lang, r.n) for r in langs), shard)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score of its column text."""
    names = [f"__{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("__lang", F.lit(None).cast("string")).withColumn("__top", F.lit(0.0)).withColumn("__total", F.lit(0.0))

    def one(df: DataFrame, shard: Shard) -> DataFrame:
        shared, columns = df.sparkSession.sparkContext.broadcast(shard), df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                has, best, top, total = own.best(batch.column("text").to_pylist())
                before = batch.column("__lang").to_pylist()
                old_top, old_total = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__top", "__total"))
                first = np.array([x is None for x in before], bool)
                # of equal languages the earlier stays
                wins = has & (first | (top > old_top))
                high = np.where(first, top, np.maximum(top, old_top))
                both = total * np.exp(top - high) + np.where(first, 0.0, old_total * np.exp(np.minimum(old_top - high, 0.0)))
                lang = [own.langs[k] if w else b for k, w, b in zip(best.tolist(), wins.tolist(), before)]
                new = [pa.array(lang, pa.string()), pa.array(np.where(has, high, 0.0)), pa.array(np.where(has, both, 0.0))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*names, "text"]), *new], columns)

        return df.mapInArrow(run, df.schema)

    for number, shard in enumerate(model.shards()):
        rows = one(stash(rows, "ranked") if number else rows, shard)
    found = F.col("__lang").isNotNull()
    score = F.when(found, 1.0 / F.col("__total")).otherwise(0.0)
    return rows.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), F.coalesce("__lang", F.lit(UND)).alias("lang_pred"), score.alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, predict all rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    return predict(rows, fit(rows.filter("not held_out")), "doc_id", "held_out")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
