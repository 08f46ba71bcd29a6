"""Substring deduplication by recompression (operator 2).

Every word covered by a window of ``WINDOW`` consecutive words that also starts
anywhere else is removed; windows are judged on the input.

Texts are recompressed in rounds.  Each round renames, by hashes that are the
same everywhere (a name that all machines give alike needs no exchange): first
short runs of one word, then pairs of a symbol of the "left" and one of the
"right" half of the alphabet (a bit of the symbol's hash, new in every round).
Whether two symbols join depends on those two alone, so equal substrings get equal
symbols but for a margin at either end that grows with the symbols.  There are as
many rounds as leave every window a whole symbol of the last one between its
margins (``rounds``); for 35 words that is

    runs of up to 2 words                    2 words may differ at an end
    pairs of up to 4 words (of symbols <= 2) + 2
    pairs of up to 8 words (of symbols <= 4) + 4      = MARGIN 8

(a fourth would need a margin of 16 and 31 words between).

A window therefore has at least one high-level symbol inside its margins, the
same ones wherever the window occurs.  The least of them (by hash, then first) is
its anchor; the windows of one anchor are neighbours and share the anchor's
surroundings, ``MARGIN`` words to either side.

1. *Reveal.* Anchors are counted by the hash of symbol and surroundings; an
   anchor met once holds no repeated window.
2. *Verify at the high level.* The whole stretch that an anchor's windows cover
   is hashed; stretches met twice are repeated in full.
3. *Verify the rest.* Only anchors that occur with different stretches (edges of
   repeats) go down to single windows: one occurrence of each distinct stretch
   gives its windows, and those met twice are repeated.

All counts are combinable sums, written before they are joined back, so that these
joins are broadcast ones while the counts are few and can be split where one
passage holds many rows; no pairs of occurrences are made.

Defined cases: null or empty texts and texts shorter than a window lose nothing
and keep their words; repeated rows repeat each other (both lose the shared
words) and share one set of spans; null doc_ids are kept; other columns are ignored; an empty table gives an
empty result.  Equality is decided on 128 bits of hash; rows are named by 64 bits
of doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as X
from .storage import id_and_text, if_small, stash, table

WINDOW = 35
RUN_CAP = 2


def rounds(window: int) -> tuple[tuple[int, ...], int]:
    """Caps of the pair rounds and the margin: the most rounds that a window guarantees a symbol of."""
    caps, margin = [2 * RUN_CAP], 2 * RUN_CAP
    while True:
        cap, wider = 2 * caps[-1], margin + caps[-1]
        # an interval of 2 * cap - 1 words holds a whole symbol of at most cap words
        if window - 2 * wider < 2 * cap - 1:
            return tuple(caps), margin
        caps, margin = [*caps, cap], wider


PAIR_CAPS, MARGIN = rounds(WINDOW)


def _name(parts: list[np.ndarray], salt: int) -> np.ndarray:
    out = np.full(len(parts[0]), salt, np.uint64)
    for p in parts:
        out = X.mix(out * np.uint64(0x9E3779B97F4A7C15) ^ p, salt)
    return out


def recompress(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, first word, number of words) of the high-level symbols.

    ``h`` are word hashes of several texts, ``first`` the first word of each text.
    """
    sym, start = h, np.arange(len(h))
    size = np.ones(len(h), np.int64)
    cut = np.zeros(len(h) + 1, bool)
    cut[first] = True
    # runs: maximal runs of one word, named where they are short enough
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[1:] == h[:-1]) & ~cut[1:-1]
    head = np.flatnonzero(~same[:-1])
    length = np.diff(np.append(head, len(h)))
    named = (length >= 2) & (length <= RUN_CAP)
    drop = np.zeros(len(h), bool)
    for k in range(1, RUN_CAP):
        drop[head[named & (length > k)] + k] = True
    sym = sym.copy()
    sym[head[named]] = _name([h[head[named]], length[named].astype(np.uint64)], 101)
    size[head[named]] = length[named]
    sym, start, size = sym[~drop], start[~drop], size[~drop]
    for turn, cap in enumerate(PAIR_CAPS):
        if len(sym) < 2:
            break
        left = X.mix(sym, 200 + turn) >> np.uint64(63) == 0
        join = left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= cap) & ~cut[start[1:]]
        at = np.flatnonzero(join)
        sym, size = sym.copy(), size.copy()
        sym[at] = _name([sym[at], sym[at + 1]], 300 + turn)
        size[at] += size[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, start, size = sym[keep], start[keep], size[keep]
    return sym, start, size


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, key, stretch) of every anchor.

    Window numbers count the words of their own text; key names the anchor with
    its surroundings, stretch all words its windows cover.
    """
    counts = np.diff(first)
    n = np.maximum(counts - WINDOW + 1, 0)
    if not n.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    text = X.owner_of(n)
    at = first[:-1][text] + np.arange(len(text)) - (np.cumsum(n) - n)[text]
    sym, start, size = recompress(h, first)
    rank = X.mix(sym, 500)
    # symbols that lie whole inside the margins of each window: [a, b)
    a = np.searchsorted(start, at + MARGIN)
    b = np.searchsorted(start + size, at + WINDOW - MARGIN, "right")
    best = [np.arange(len(sym))]
    width = 1
    while 2 * width <= WINDOW - 2 * MARGIN:
        low = best[-1]
        x, y = low[: len(low) - width], low[width:]
        best.append(np.where(rank[x] <= rank[y], x, y))
        width *= 2
    level = np.frexp((b - a).astype(float))[1] - 1
    chosen = np.zeros(len(at), np.int64)
    for k, low in enumerate(best):
        own = np.flatnonzero(level == k)
        x, y = low[a[own]], low[b[own] - (1 << k)]
        chosen[own] = np.where(rank[x] <= rank[y], x, y)
    head = np.ones(len(at), bool)
    head[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    lead = np.flatnonzero(head)
    windows = np.diff(np.append(lead, len(at)))
    lo, symbol = at[lead], chosen[lead]
    key = X.window_hash(h, start[symbol] - MARGIN, start[symbol] + size[symbol] + MARGIN, salt=11)
    key = X.mix(key ^ X.mix(size[symbol].astype(np.uint64), 12))
    stretch = X.window_hash(h, lo, lo + windows - 1 + WINDOW, "word2", salt=13)
    stretch = X.mix(stretch ^ X.mix(((start[symbol] - lo) * 64 + windows).astype(np.uint64), 14))
    return text[lead], lo - first[:-1][text[lead]], windows, key, stretch


def _keyed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def occurrences(docs: DataFrame) -> DataFrame:
    """(key, stretch, row, lo, n): every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            for r, _, data, offsets in X.slices(batch.column("text")):
                words = X.Words(data, offsets)
                text, lo, n, key, stretch = anchors(words.hash, words.first)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(rows[r + text]), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))],
                        ["key", "stretch", "row", "lo", "n"],
                    )

    return _keyed(docs).select("row", "text").mapInArrow(run, "key long, stretch long, row long, lo int, n int")


def _windows(docs: DataFrame) -> DataFrame:
    """(w1, w2, weight, row, at): the windows that ``docs`` lists in ``ask``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            for r, e, data, offsets in X.slices(batch.column("text")):
                words = X.Words(data, offsets)
                asked = batch.column("ask").slice(r, e - r)
                text = X.owner_of(asked.value_lengths().to_numpy(zero_copy_only=False))
                lo, n, weight = (asked.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("lo", "n", "weight"))
                each = X.owner_of(n)
                at = lo[each] + np.arange(len(each)) - (np.cumsum(n) - n)[each]
                where = words.first[:-1][text[each]] + at
                w1, w2 = X.window_hash(words.hash, where, where + WINDOW, salt=21), X.window_hash(words.hash, where, where + WINDOW, "word2", salt=22)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(weight[each].astype(np.int32)), pa.array(rows[r + text[each]]), pa.array(at.astype(np.int32))],
                    ["w1", "w2", "weight", "row", "at"],
                )

    return docs.select("row", "doc_id", "text", "ask").mapInArrow(run, "w1 long, w2 long, weight int, row long, at int")


def _cut(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) from the repeated windows of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                total, gone, kept = [], [], []
                for text, sure, single in zip(*(part.column(c) for c in ("text", "sure", "single"))):
                    words = (text.as_py() or "").encode().split()
                    total.append(len(words))
                    stay = len(words)
                    if sure.is_valid or single.is_valid:
                        step = np.zeros(len(words) + 1, np.int64)
                        if sure.is_valid:
                            lo, n = (sure.values.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "n"))
                            np.add.at(step, lo, 1)
                            np.add.at(step, lo + n - 1 + WINDOW, -1)
                        if single.is_valid:
                            lo = single.values.to_numpy(zero_copy_only=False)
                            np.add.at(step, lo, 1)
                            np.add.at(step, lo + WINDOW, -1)
                        free = np.cumsum(step[:-1]) == 0
                        stay = int(free.sum())
                        words = compress(words, free.tolist())
                    gone.append(total[-1] - stay)
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text", "sure", "single").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept is the text that stays."""
    found = occurrences(docs)
    shared = stash(found.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key"), "shared")
    met = stash(found.join(if_small(shared), "key"), "anchors")
    classes = stash(met.groupBy("key", "stretch").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "lo", "n")).alias("one")), "stretches")
    twice = stash(classes.filter("times > 1").select("key", "stretch"), "twice")
    sure = met.join(if_small(twice), ["key", "stretch"]).select("row", "lo", "n")
    edges = stash(classes.groupBy("key").agg(F.min("times").alias("least")).filter("least = 1").select("key"), "edges")
    ask = classes.join(if_small(edges), "key").select("one.row", "one.lo", "one.n", F.least("times", F.lit(2)).cast("int").alias("weight"))
    ask = stash(ask.groupBy("row").agg(F.collect_list(F.struct("lo", "n", "weight")).alias("ask")), "ask")
    rows = _keyed(docs)
    # only texts that are asked for move; rows of one name hold one text, which is read once
    some = rows.join(if_small(ask.select("row")), "row", "left_semi").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    windows = _windows(some.join(ask, "row"))
    again = stash(windows.groupBy("w1", "w2").agg(F.sum("weight").alias("times")).filter("times > 1").select("w1", "w2"), "again")
    single = windows.filter("weight = 1").join(if_small(again), ["w1", "w2"]).groupBy("row").agg(F.collect_set("at").alias("single"))
    spans = sure.groupBy("row").agg(F.collect_set(F.struct("lo", "n")).alias("sure"))
    return _cut(rows.join(spans, "row", "left").join(single, "row", "left"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
