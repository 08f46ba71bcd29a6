"""Benchmark decontamination (operator 9).

A text is contaminated by a benchmark item of n words if some run of its words is
within word-level edit distance ``floor(n * MAX_EDIT)`` of the item.  Words are
compared in lower case (A-Z) as they stand.

Windows as long as the item are embedded by CGK random walks: a walk reads the
word under its pointer, writes it, and moves on or stays by a random bit of the
word and the step.  Edit distance becomes Hamming distance, and bit sampling
(``BITS`` sampled steps of one walk, ``WALKS`` walks) finds pairs that agree on
all sampled steps of at least one walk.  Where a window is found, the exact edit
distance of the item to the runs around it decides, once for the windows of one
place.

Before the embedding, windows that cannot match are passed over by a filter that
loses none: a run within k edits of an item holds all but k of the item's seed
words, at offsets that differ by at most k.  Seeds are the item's words that
occur in few items (all its words where those are no more than k).

The items are broadcast in blocks of at most ``BLOCK_WORDS`` words; every block
is held against all texts, so the memory is bounded whatever the benchmark's size.

Recall: the seed filter and the verification are exact.  A pair that shares at
least a tenth of the steps of a walk is found with probability
1 - (1 - 0.1**2)**256 > 0.92 for each window start, and a match is met from
several starts; the tests measure it against brute force.

Defined cases: null or empty texts match nothing; items without a word are
ignored; an item of fewer than 1 / MAX_EDIT words must occur exactly; repeated
rows and repeated items each count; null ids are kept; other columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as X
from .storage import table

MAX_EDIT = 0.2
BITS = 2
WALKS = 256
TURNS = (range(0, 16), range(16, WALKS))  # most matches are met in the first walks
BLOCK_WORDS = 1_000_000
RARE_ITEMS = 2
SCHEMA = "start_word int, n_words int, distance int"


def walks(words: np.ndarray, starts: np.ndarray, steps: int, seeds: range) -> np.ndarray:
    """CGK embeddings of the strings of ``words`` (hashes) that begin at ``starts``.

    One row per start, one column per walk and step: the place in ``words`` that
    is read at that step.  The random bit of a word at a step is bit ``step % 64``
    of a hash of the word, the walk and ``step // 64``; past the end a walk stays.
    """
    width = len(seeds)
    salts = X.mix(np.array([[seed * 8 + k for seed in seeds] for k in range(steps // 64 + 1)], np.uint64), 31)
    bits = np.zeros((len(salts), len(words) + 1, width), np.uint64)
    bits[:, :-1] = X.mix(words[None, :, None] ^ salts[:, None, :], 32)
    # the state of a walk is the place in a (word, walk) table; a row further is ``width`` on
    at = (np.repeat(starts[:, None], width, 1) * width + np.arange(width)).reshape(-1)
    out = np.empty((steps, len(at)), np.int32)
    for t in range(steps):
        out[t] = at
        onward = ((bits[t // 64] >> np.uint64(t % 64)) & np.uint64(1)).astype(np.int32).reshape(-1) * width
        at = at + onward[at]
    return np.moveaxis(out.reshape(steps, len(starts), width) // width, 0, 2)


def sampled_agree(item: np.ndarray, text: np.ndarray, starts: np.ndarray, seeds: range, bits: int = BITS) -> np.ndarray:
    """Which windows of ``text`` (item-sized, at ``starts``) share all sampled steps of a walk with ``item``."""
    n = len(item)
    size = min(bits, 2 * n)
    steps = np.array([np.sort(np.random.default_rng((seed, n)).choice(2 * n, size, replace=False)) for seed in seeds])
    most = int(steps.max()) + 1
    pick = np.broadcast_to(steps[None], (1, *steps.shape))
    own = np.take_along_axis(walks(item, np.zeros(1, np.int64), most, seeds), pick, 2)
    theirs = np.take_along_axis(walks(text, starts, most, seeds), np.broadcast_to(steps[None], (len(starts), *steps.shape)), 2)
    pad_item, pad_text = np.append(item, np.uint64(0)), np.append(text, np.uint64(0))
    inside = theirs < starts[:, None, None] + n
    read = np.where(inside, pad_text[np.minimum(theirs, len(text))], np.uint64(0))
    return (read == pad_item[np.minimum(own, n)]).all(2).any(1)


def best_run(item: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the run of ``text`` nearest to ``item``, if within k.

    Of equally near runs the one that ends first, then the longest.
    """
    m = len(text)
    dist = np.zeros(m + 1, np.int64)
    begin = np.arange(m + 1)
    step = np.arange(m + 1)
    for i, word in enumerate(item, 1):
        diag = dist[:-1] + (text != word)
        up = dist + 1
        new = up.copy()
        src = begin.copy()
        better = diag <= new[1:]
        new[1:] = np.where(better, diag, new[1:])
        src[1:] = np.where(better, begin[:-1], src[1:])
        # runs of insertions: the best value to the left plus its distance
        key = (new - step) * (m + 2) + step
        lead = np.minimum.accumulate(key)
        origin = lead % (m + 2)
        dist = new[origin] + step - origin
        begin = src[origin]
        if dist.min() > k:
            return None
    end = int(dist.argmin())
    return (int(begin[end]), end, int(dist[end])) if dist[end] <= k else None


class Items:
    """A block of items: hashed words, seeds and the offsets at which they stand."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        data = np.frombuffer("\n".join(t for _, t in rows).encode(), np.uint8)
        sizes = np.array([len(t.encode()) + 1 for _, t in rows], np.int64)
        offsets = np.minimum(np.concatenate([[0], np.cumsum(sizes)]), len(data))
        words = X.Words(data, offsets, lower=True)
        self.ids = [i for i, _ in rows]
        self.words = [words.hash[a:b] for a, b in zip(words.first, words.first[1:])]
        self.edits = [int(len(w) * MAX_EDIT) for w in self.words]
        holders: dict[int, int] = defaultdict(int)
        for w in self.words:
            for h in np.unique(w):
                holders[int(h)] += 1
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.need = []
        for j, w in enumerate(self.words):
            rare = [i for i, h in enumerate(w) if holders[int(h)] <= RARE_ITEMS]
            seeds = rare if len(rare) > self.edits[j] else list(range(len(w)))
            self.need.append(len(seeds) - self.edits[j])
            for i in seeds:
                places[int(w[i])].append((j, i))
        keys = np.array(sorted(places), np.uint64)
        self.keys = keys
        flat = [places[int(h)] for h in keys]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
        self.item = np.array([j for x in flat for j, _ in x], np.int64)
        self.offset = np.array([i for x in flat for _, i in x], np.int64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def candidates(self, words: X.Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first and last word where a match may start)."""
        hit = np.flatnonzero(self.sieve[(words.hash & np.uint64((1 << 20) - 1)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, words.hash[hit]), len(self.keys) - 1)
        same = self.keys[key] == words.hash[hit]
        hit, key = hit[same], key[same]
        if not len(hit):
            return
        n = self.first[key + 1] - self.first[key]
        place = np.repeat(self.first[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos = np.repeat(hit, n)
        item, start = self.item[place], pos - self.offset[place]
        text = np.searchsorted(words.first, pos, "right") - 1
        order = np.lexsort((start, item, text))
        item, start, text = item[order], start[order], text[order]
        need, k = np.array(self.need)[item], np.array(self.edits)[item]
        # the need-th next seed of the same text and item lies within 2k starts
        far = np.arange(len(item)) + need - 1
        inside = far < len(item)
        far = np.minimum(far, len(item) - 1)
        ok = inside & (text[far] == text) & (item[far] == item) & (start[far] - start <= 2 * k)
        last: tuple[int, int, int, int] | None = None
        for i in np.flatnonzero(ok):
            t, j, a, b = int(text[i]), int(item[i]), int(start[far[i]] - k[i]), int(start[i] + k[i])
            if last and last[0] == t and last[1] == j and a <= last[3] + 1:
                last = (t, j, last[2], max(last[3], b))
            else:
                if last:
                    yield last
                last = (t, j, a, b)
        if last:
            yield last

    def matches(self, words: X.Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, first word in its text, words, distance), each item once a place."""
        for t, j, a, b in self.candidates(words):
            item, k = self.words[j], self.edits[j]
            n, lo, hi = len(item), int(words.first[t]), int(words.first[t + 1])
            text = words.hash[lo:hi]
            todo = [(max(a - lo, 0), min(max(b, lo), hi - 1) - lo)]
            while todo:
                a, b = todo.pop()
                base = max(0, a - k)
                region = text[base : b + n + k]
                if not any(sampled_agree(item, region, np.arange(a, b + 1) - base, turn).any() for turn in TURNS):
                    continue
                run = best_run(item, region, k)
                if run:
                    yield t, j, base + run[0], run[1] - run[0], run[2]
                    todo += [(x, y) for x, y in ((a, base + run[0] - n), (base + run[1], b)) if x <= y]


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of bounded size, in the order of their hash."""
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows, size = [], 0
    for r in known.toLocalIterator():
        n = len(r.text.encode().split())
        if not n:
            continue
        if rows and size + n > BLOCK_WORDS:
            yield Items(rows)
            rows, size = [], 0
        rows.append((r.item_id, r.text))
        size += n
    if rows:
        yield Items(rows)


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance): every match of an item."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                ids = batch.column("doc_id")
                for first, _, data, offsets in X.slices(batch.column("text")):
                    found = list(block.matches(X.Words(data, offsets, lower=True)))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array([first + f[0] for f in found])),
                                pa.array([block.ids[f[1]] for f in found], pa.int64()),
                                *(pa.array([f[c] for f in found], pa.int32()) for c in (2, 3, 4)),
                            ],
                            ["doc_id", "item_id", "start_word", "n_words", "distance"],
                        )

        part = rows.mapInArrow(run, f"doc_id long, item_id long, {SCHEMA}")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"doc_id long, item_id long, {SCHEMA}")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all their columns) that no item contaminates; nothing is shuffled."""
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for first, _, data, offsets in X.slices(batch.column("text")):
                    good[[first + f[0] for f in block.matches(X.Words(data, offsets, lower=True))]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
