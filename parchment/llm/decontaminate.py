"""Test items found in training texts, as exact, edited or paraphrased copies.

1. Items and texts are words: lower case, letters and digits only.
2. Seeds.  Every n-gram of an item that a training text holds, however frequent, is a seed: whatever an edit leaves
   whole finds the copy.  A copy with no ``SEED_WORDS`` consecutive words of the item left is not found.
3. Join.  Passages around the places of seeds in texts are joined to items by seed and grouped by diagonal.
4. Smith-Waterman local alignment of words scores each passage against its item; the score is a share of the item's own.

Items are a stated query set and are taken in blocks of ``BLOCK_WORDS`` words, so a broadcast vocabulary has that bound.

Null text counts as empty.  Items of fewer than ``LEAST_WORDS`` words say too little to be found and give no rows.
Repeated document rows give one row for each document and item; rows with a null document or item id are left out.
Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import stored, texts

SEED_WORDS = 3
LEAST_WORDS = 5
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score, as a share of what the item would score against itself, that makes a leak.
LEAK = 0.5
#: Diagonals that are aligned together.
BAND = 32
_KEPT = 400_000


def clean(word: str) -> str:
    return word if word.isalnum() else "".join(c for c in word if c.isalnum())


def item_words(text: str | None) -> list[str]:
    return [w for w in (clean(x) for x in (text or "").lower().split()) if w]


class _Ids(dict):
    """Raw word -> number of its cleaned form in a vocabulary; 0: not in it, -1: nothing left."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > _KEPT:
            self.clear()
        c = clean(word)
        found = self[word] = self.vocabulary.get(c, 0) if c else -1
        return found


def _numbers(bodies, ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of texts end to end and the words of each."""
    parts = []
    for b in bodies:
        ws = str(b.as_py(), "utf-8").lower().split()
        a = np.fromiter(map(ids.__getitem__, ws), np.int32, len(ws))
        parts.append(a[a >= 0])
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), sizes


def grams(numbers: np.ndarray, sizes: np.ndarray, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams of known words within one text, and their numbers."""
    if len(numbers) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(numbers) - n + 1
    left = np.repeat(np.cumsum(sizes), sizes)[:m] - np.arange(m)  # words up to the text's end
    ok = left >= n
    for k in range(n):
        ok &= numbers[k : k + m] > 0
    at = np.flatnonzero(ok)
    g = np.zeros(len(at), np.int64)
    for k in range(n):
        g = g * base + numbers[at + k]
    return at, g


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of an item against passages (rows, padded by -1), and where the best alignments end."""
    rows, width = passages.shape
    steps = np.arange(width + 1) * -GAP
    h = np.zeros((rows, width + 1), np.int32)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for w in item:
        pair = np.where((passages == w) & (w > 0), MATCH, MISMATCH)
        t = np.zeros_like(h)
        t[:, 1:] = np.maximum(h[:, :-1] + pair, h[:, 1:] + GAP)
        np.maximum(t, 0, out=t)
        # a run of gaps along the passage: the best start, less the steps since
        h = np.maximum.accumulate(t + steps, axis=1) - steps
        top = h.max(axis=1)
        up = top > best
        end[up] = h[up].argmax(axis=1)
        best = np.maximum(best, top)
    return best, end


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in blocks of bounded size."""
    held, size = [], 0
    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    for r in rows.toLocalIterator():
        words = item_words(r["text"])
        if len(words) < LEAST_WORDS:
            continue
        held.append((r["item_id"], words))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def choose_seeds(codes: np.ndarray, frequency: np.ndarray, spread: int) -> np.ndarray:
    """Places in an item of the n-grams that are rarest (ties: the first) in a run of ``spread``; ``leaks`` takes all instead,
    since an edit's own n-grams are the rarest."""
    if len(codes) <= spread:
        return np.array([int(np.argmin(frequency))]) if len(codes) else np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(frequency, spread)
    return np.unique(runs.argmin(axis=1) + np.arange(len(runs)))


def _passages(seeds: np.ndarray, vocabulary, n: int, base: int, reach: int):
    """Texts -> (doc_id, start, words, places, grams): passages around seeds, merged where they overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(vocabulary.value)
        known = seeds.value
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "start", "words", "places", "grams"]
        for batch in batches:
            doc = batch.column(0)
            numbers, sizes = _numbers(batch.column(1), ids)
            at, g = grams(numbers, sizes, n, base)
            k = np.minimum(np.searchsorted(known, g), len(known) - 1)
            hit = known[k] == g
            at, g = at[hit], g[hit]
            if not len(at):
                continue
            ends = np.cumsum(sizes)
            text = np.searchsorted(ends, at, "right")
            new = np.ones(len(at), bool)
            new[1:] = (text[1:] != text[:-1]) | (at[1:] - at[:-1] > 2 * reach)
            cuts = np.append(np.flatnonzero(new), len(at))
            out: list[list] = [[], [], [], [], []]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                t = text[a]
                first = ends[t] - sizes[t]
                lo, hi = max(first, at[a] - reach), min(ends[t], at[b - 1] + reach)
                out[0].append(doc[int(t)].as_py())
                out[1].append(int(lo - first))
                out[2].append(numbers[lo:hi])
                out[3].append(at[a:b] - lo)
                out[4].append(g[a:b])
                if len(out[0]) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
                    out = [[], [], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return run


def _score(items):
    """(doc_id, item, start, words, low, high) -> scores of the passages cut to the diagonals low..high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = items.value
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            item = cols["item"].to_numpy(zero_copy_only=False)
            low, high = cols["low"].to_numpy(zero_copy_only=False), cols["high"].to_numpy(zero_copy_only=False)
            start = cols["start"].to_numpy(zero_copy_only=False)
            share, first, width = np.zeros(len(item)), np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
            for i in np.unique(item).tolist():
                words = table[i][1]
                rows = np.flatnonzero(item == i)
                slack = 4 + len(words) // 4
                for k in range(0, len(rows), max(1, 2_000_000 // (4 * len(words) + BAND))):
                    some = rows[k : k + max(1, 2_000_000 // (4 * len(words) + BAND))]
                    parts = []
                    for r in some.tolist():
                        all_words = cols["words"][r].values.to_numpy(zero_copy_only=False)
                        a = max(0, low[r] - slack)
                        parts.append(all_words[a : high[r] + len(words) + slack])
                        first[r] = start[r] + a
                        width[r] = len(parts[-1])
                    grid = np.full((len(parts), max(map(len, parts))), -1, np.int32)
                    for j, p in enumerate(parts):
                        grid[j, : len(p)] = p
                    best, end = align(words, grid)
                    share[some] = best / (MATCH * len(words))
                    width[some] = end
            ids = np.array([t[0] for t in table], np.int64)
            yield pa.RecordBatch.from_arrays(
                [cols["doc_id"], pa.array(ids[item]), pa.array(share), pa.array(first + width), cols["seeds"]],
                ["doc_id", "item_id", "score", "end_word", "n_seeds"],
            )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAK) -> DataFrame:
    """(doc_id, item_id, score, end_word, n_seeds): for each text and item whose best alignment scores ``least`` or
    more, the score as a share of the item's own, the word of the text at which the alignment ends, and its seeds."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    source = texts(docs).where(F.col("doc_id").isNotNull())
    found = None
    for block in _blocks(benchmark):
        vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for _, ws in block for w in ws))}
        base = len(vocabulary) + 1
        coded = [(i, np.array([vocabulary[w] for w in ws], np.int32)) for i, ws in block]
        own = [grams(c, np.array([len(c)]), SEED_WORDS, base) for _, c in coded]
        # n-grams that no text holds meet nothing, so all of an item's may be sought
        seeds = [(k, i, p) for i, (at, g) in enumerate(own) for k, p in zip(g.tolist(), at.tolist())]
        reach = max(len(c) for _, c in coded) * 5 // 4 + 8
        sought = sc.broadcast(np.unique(np.array([s[0] for s in seeds], np.int64)))
        passages = source.select("doc_id", "body").mapInArrow(
            _passages(sought, sc.broadcast(vocabulary), SEED_WORDS, base, reach),
            "doc_id long, start long, words array<int>, places array<bigint>, grams array<bigint>",
        )
        seed_table = spark.createDataFrame(seeds, "gram long, item long, place long")
        hits = (
            passages.select("doc_id", "start", "words", F.inline(F.arrays_zip("places", "grams")))
            .withColumnRenamed("grams", "gram")
            .join(F.broadcast(seed_table), "gram")  # a block of items; frequent n-grams stay where they are
            .withColumn("diagonal", F.col("places") - F.col("place"))
        )
        grouped = hits.groupBy("doc_id", "start", "item", F.floor(F.col("diagonal") / BAND).alias("band")).agg(
            F.min("diagonal").alias("low"),
            F.max("diagonal").alias("high"),
            F.count("*").alias("seeds"),
            F.first("words").alias("words"),
        )
        scored = (
            grouped.select("doc_id", "item", "start", "words", "low", "high", "seeds")
            .mapInArrow(_score(sc.broadcast(coded)), "doc_id long, item_id long, score double, end_word long, n_seeds long")
            .where(F.col("score") >= least)
        )
        part = stored(
            scored.groupBy("doc_id", "item_id").agg(
                F.max(F.struct("score", "n_seeds", (-F.col("end_word")).alias("e"))).alias("best")
            ).select("doc_id", "item_id", "best.score", (-F.col("best.e")).alias("end_word"), "best.n_seeds"),
            "leaks",
        )
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, end_word long, n_seeds long")
    return found
