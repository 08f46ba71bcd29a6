"""Quality classifier by n-gram perplexity (operator 1).

An interpolated modified Kneser-Ney model over n-grams of code points, as they
stand in the text (order ``ORDER``, no folding, so the vocabulary is open and its
tables grow with the trusted text), is trained on trusted text: documents labelled
quality 1 and not toxic, without a held-out share of them.  The counts of every
order and of every order's contexts are tables sharded by n-gram; joins between
them give each seen n-gram its probability and each context its back-off weight.

To score, documents are dealt to blocks; the distinct n-grams that all blocks
need are looked up once, order by order (those not seen back off to the next
shorter one, by joins with the sharded tables), and the found probabilities return
to the blocks, where every position of every text is summed.

The perplexity of a short text is a noisy mean, so it is drawn towards the median
of its language by ``SHORT`` characters' worth.  A document is kept where this
value is at most the ``QUANTILE`` quantile of its language over the held-out
trusted documents, which the model has not seen.

Bounds: a block holds about ``BLOCK_CHARS`` characters, their number grows with
the corpus; repeated rows (same doc_id and text) are scored once, so that no block
is filled by copies.  No count is collected: the driver sees counts of counts (4
rows an order) and the number of distinct code points.  Tables are broadcast only
up to ``BROADCAST_ROWS`` rows, and labels up to ``MAX_BROADCAST_IDS``.

Defined cases: null or empty text has perplexity null and is not kept; documents
without a language are judged by the values over all languages, and so are those
of a language without ``MIN_TRUSTED`` held-out documents; with no held-out trusted
text at all every document with text is kept; with no trusted text every code
point is equally likely; repeated rows count and give a row each; a null doc_id
matches no label; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as X
from .storage import if_small, stash, table

ORDER = 4
BLOCK_CHARS = 24_000_000
SLICE_CHARS = 1 << 20
MAX_BROADCAST_IDS = 2_000_000
HELD_OUT = 5
MIN_TRUSTED = 20
QUANTILE = 0.99
SHORT = 100
_PAD = "\x00" * (ORDER - 1)


class Grams:
    """Distinct n-grams: sorted names (64-bit hashes), their code points, how often they occur."""

    def __init__(self) -> None:
        self.name = np.zeros(0, np.uint64)
        self.chars = np.zeros((0, ORDER), np.uint32)
        self.times = np.zeros(0, np.int64)

    def add(self, texts: list[str]) -> None:
        codes, _ = positions(texts)
        names = _names(codes)
        name, times = np.unique(names, return_counts=True)
        at = np.minimum(np.searchsorted(self.name, name), max(len(self.name) - 1, 0))
        known = self.name[at] == name if len(self.name) else np.zeros(len(name), bool)
        self.times[at[known]] += times[known]
        fresh = name[~known]
        if not len(fresh):
            return
        place = np.minimum(np.searchsorted(fresh, names), len(fresh) - 1)
        met = np.flatnonzero(fresh[place] == names)
        where = np.zeros(len(fresh), np.int64)
        where[place[met]] = met
        order = np.argsort(np.concatenate([self.name, fresh]))
        self.name, self.chars, self.times = (np.concatenate(x)[order] for x in ((self.name, fresh), (self.chars, codes[where]), (self.times, times[~known])))

    def strings(self) -> pa.Array:
        # a blank stands for the padding before a text, as NumPy drops trailing zeros
        chars = np.where(self.chars == 0, 32, self.chars).astype(np.uint32)
        return pa.array(np.ascontiguousarray(chars).view(f"<U{ORDER}").ravel().tolist(), pa.string())


def positions(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the n-gram that ends at each character, and each one's text; blanks stand before a text."""
    joined = _PAD + _PAD.join(texts) + "\x00"  # a slice of empty texts still fills a window
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c == 0, 32, c).astype(np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(row)) + (ORDER - 1) * (row + 1)
    return np.lib.stride_tricks.sliding_window_view(c, ORDER)[at - ORDER + 1], row


def _names(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    for k in range(ORDER):
        out = X.mix(out ^ codes[:, k].astype(np.uint64), 41 + k)
    return out


def slices(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or "") > SLICE_CHARS:
            yield first, i, [x or "" for x in texts[first:i]]
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts), [x or "" for x in texts[first:]]


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n) over the column text: summed in each task, then by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grams()
        for batch in batches:
            for _, _, some in slices(batch.column("text").to_pylist()):
                own.add(some)
                if len(own.name) > 4 * SLICE_CHARS:
                    yield pa.RecordBatch.from_arrays([own.strings(), pa.array(own.times)], ["gram", "n"])
                    own = Grams()
        if len(own.name):
            yield pa.RecordBatch.from_arrays([own.strings(), pa.array(own.times)], ["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(histogram: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ of modified Kneser-Ney from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (max(histogram.get(k, 0), 1) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.01), k - 0.01) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


class Model:
    """Sharded tables by order: (gram, p) of the seen n-grams, (context, gamma) of their contexts; p of an unseen code point."""

    def __init__(self, seen: dict[int, DataFrame], back: dict[int, DataFrame], unseen: float) -> None:
        self.seen, self.back, self.unseen = seen, back, unseen


def _context(order: int) -> Column:
    return F.substring("gram", 1, order - 1)


def _rest(order: int) -> Column:
    return F.substring("gram", 2, order - 1)


def train(texts: DataFrame) -> Model:
    """Model of all rows of ``texts`` (column text, null rows give nothing)."""
    # counts of the highest order; of the lower ones, how many code points stand before the n-gram
    counts = {ORDER: stash(count_grams(texts.filter("text is not null")), "grams")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = stash(counts[k + 1].groupBy(_rest(k + 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    seen: dict[int, DataFrame] = {}
    back: dict[int, DataFrame] = {}
    unseen = 1.0
    for k in range(1, ORDER + 1):
        hist = {r.n: r.k for r in counts[k].filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}  # at most 4 rows
        d1, d2, d3 = discounts(hist)
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = F.greatest(F.col("n") - cut, F.lit(0.0))
        if k == 1:
            total, held, kinds = counts[1].agg(F.sum("n"), F.sum(cut), F.count(F.lit(1))).first()
            base = 1.0 / (kinds + 1)
            unseen = held / total * base if total else 1.0
            seen[1] = stash(counts[1].select("gram", (own / F.lit(float(total or 1)) + F.lit(unseen)).alias("p")), "seen")
            continue
        contexts = stash(counts[k].groupBy(_context(k).alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("held")), "contexts")
        back[k] = contexts.select("context", (F.col("held") / F.col("total")).alias("gamma"))
        lower = seen[k - 1].select(F.col("gram").alias("rest"), F.col("p").alias("below"))
        rows = counts[k].select("gram", "n", _context(k).alias("context"), _rest(k).alias("rest"))
        found = rows.join(if_small(contexts), "context").join(if_small(lower), "rest")
        seen[k] = stash(found.select("gram", (own / F.col("total") + F.col("held") / F.col("total") * F.col("below")).alias("p")), "seen")
    return Model(seen, back, unseen)


def probabilities(model: Model, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p) of the distinct n-grams of ``grams``: seen ones from their table, others by back-off."""
    found = grams.join(if_small(model.seen[order]), "gram", "left")
    if order == 1:
        return found.select("gram", F.coalesce("p", F.lit(model.unseen)).alias("p"))
    found = stash(found, "found")
    missed = found.filter("p is null").select("gram", _context(order).alias("context"), _rest(order).alias("rest"))
    below = stash(probabilities(model, missed.select(F.col("rest").alias("gram")).distinct(), order - 1), "below")
    below = if_small(below).select(F.col("gram").alias("rest"), F.col("p").alias("below"))
    missed = missed.join(if_small(model.back[order]), "context", "left").join(below, "rest")
    return found.filter("p is not null").unionByName(missed.select("gram", (F.coalesce("gamma", F.lit(1.0)) * F.col("below")).alias("p")))


def _scored(docs: DataFrame, model: Model, chars: int) -> DataFrame:
    """(doc_id, lang, n_chars, name, nll) of rows whose names differ."""
    blocks = max(24, -(-chars // BLOCK_CHARS))
    rows = docs.select(F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "lang", "name", "text")

    def needs(part: pa.Table) -> pa.Table:
        own = Grams()
        for _, _, some in slices(part.column("text").to_pylist()):
            own.add(some)
        block = np.full(len(own.name), part.column("block")[0].as_py(), np.int32)
        return pa.table({"block": pa.array(block), "code": pa.array(own.name.view(np.int64)), "gram": own.strings()})

    def score(part: pa.Table, known: pa.Table) -> pa.Table:
        code = known.column("code").to_numpy().view(np.uint64)
        order = np.argsort(code)
        code, logp = code[order], known.column("logp").to_numpy()[order]
        texts = part.column("text").to_pylist()
        total, size = np.zeros(len(texts)), np.array([len(t or "") for t in texts], np.int64)
        for a, b, some in slices(texts):
            codes, row = positions(some)
            if len(row):
                total[a:b] = np.bincount(row, logp[np.searchsorted(code, _names(codes))], minlength=b - a)
        value = -total / np.maximum(size, 1)
        return pa.table({**{c: part.column(c) for c in ("doc_id", "lang", "name")}, "n_chars": pa.array(size), "nll": pa.array(value, mask=size == 0)})

    wanted = rows.groupBy("block").applyInArrow(needs, "block int, code long, gram string")
    # the n-grams of all blocks are looked up once
    grams = stash(wanted.groupBy("code").agg(F.first("gram").alias("gram")), "wanted")
    found = stash(grams.join(probabilities(model, grams.select("gram")), "gram").select("code", F.log("p").cast("float").alias("logp")), "logp")
    known = wanted.select("block", "code").join(found, "code").select("block", "code", "logp")
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, "doc_id long, lang string, name long, n_chars long, nll double")


def perplexity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity) of every row of ``docs``."""
    rows = docs.select("doc_id", "lang", "text", F.xxhash64("doc_id", "lang", "text").alias("name"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    repeated = stash(rows.groupBy("name").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "repeated")
    if repeated.isEmpty():
        out = _scored(rows, model, chars)
    else:
        # a row that stands there several times is scored once and given out again
        names = if_small(repeated)
        one = rows.join(names, "name", "left_semi").groupBy("name").agg(*(F.first(c).alias(c) for c in ("doc_id", "lang", "text"))).select(rows.columns)
        scored = stash(_scored(rows.join(names, "name", "left_anti").unionByName(one), model, chars), "scored")
        again = scored.join(names, "name").select(*scored.columns, F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")
        out = scored.join(names, "name", "left_anti").unionByName(again)
    return out.select("doc_id", "lang", "n_chars", F.exp("nll").alias("perplexity"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled quality 1 that no label calls toxic (a missing toxic label does not)."""
    named = labels.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    state = named.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    return state.filter("good = 1 and coalesce(bad, 0) = 0").select("doc_id")


def held_out(doc_id: Column) -> Column:
    """Every ``HELD_OUT``-th trusted document is left out of the training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` named by ``ids`` (a written table); the ids travel to the texts only while few."""
    return docs.join(if_small(ids, MAX_BROADCAST_IDS), "doc_id", "left_semi")


def _per_language(trusted: DataFrame, value: Column, name: str) -> tuple[DataFrame, float | None]:
    """(lang, name) of the languages with ``MIN_TRUSTED`` documents (written), and the value over all documents."""
    own = trusted.filter("lang is not null").groupBy("lang").agg(value.alias(name), F.count(F.lit(1)).alias("n"))
    return stash(own.filter(F.col("n") >= MIN_TRUSTED).select("lang", name), name), trusted.agg(value.alias(name)).first()[0]


def judge(scored: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, judged, fence, kept) of every scored row.

    ``ids`` are the held-out trusted documents; ``judged`` is the perplexity drawn
    towards the median of the language, ``fence`` its quantile.
    """

    def with_value(df: DataFrame, values: tuple[DataFrame, float | None], name: str) -> DataFrame:
        return df.join(if_small(values[0]), "lang", "left").withColumn(name, F.coalesce(name, F.lit(values[1]).cast("double")))

    mean = F.log("perplexity")
    trusted = stash(_only(scored.filter("perplexity is not null"), ids), "trusted")
    middle = _per_language(trusted, F.percentile_approx(mean, 0.5, 10000), "middle")
    drawn = F.exp((F.col("n_chars") * mean + SHORT * F.coalesce("middle", mean)) / (F.col("n_chars") + SHORT)).alias("judged")
    fence = _per_language(with_value(trusted, middle, "middle").select("lang", drawn), F.percentile_approx("judged", QUANTILE, 10000), "fence")
    out = with_value(with_value(scored, middle, "middle"), fence, "fence")
    out = out.select("doc_id", "lang", "n_chars", "perplexity", drawn, "fence")
    kept = F.col("perplexity").isNotNull() & (F.col("fence").isNull() | (F.col("judged") <= F.col("fence")))
    return out.withColumn("kept", kept)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, judged, fence, kept) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    ids = stash(trusted_ids(labels).withColumn("out", held_out(F.col("doc_id"))), "ids")
    model = train(_only(docs, ids.filter("not out").select("doc_id")).select("text"))
    return judge(stash(perplexity(docs, model), "perplexity"), ids.filter("out").select("doc_id"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
