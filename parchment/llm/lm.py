"""Log-bilinear language model trained by noise-contrastive estimation, and text scores.

Symbols: the end of a text, the ``SHORT`` most frequent words, and ``CLASSES`` classes (by a word's last letters)
for all others.  The two symbols before a token predict its symbol: score = (R1[previous] + R2[one before]) . Q[symbol] + b[symbol],
normalised over all symbols; a class's words share its probability by their counts, with one more count for the unseen.

Corpus counts, class totals and the training pass cover every training text.  Each round, tasks train on their share of the round's texts
from the same parameters and the results are averaged, weighted by tokens, so parameters alone leave a task.

Word counts reach the texts without a dictionary of the corpus in any one place: texts are cut into chunks of ``CHUNK`` bytes, each chunk's distinct
words get their counts in one shuffle by word, and meet the chunk again in another.  A frequent word has one row a chunk.

Null text counts as empty: one token, its end.  Repeated rows are texts of their own; a null id is in fold 0.
Without training texts every score is that of the uniform model over one unseen type.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import fold, stored, texts
from parchment.llm.grams import numbered

SHORT = 512
CLASSES = 64
DIM = 24
NOISE = 64
BATCH = 2048
ROUNDS = 3
RATE = 0.2
#: Words below this share of the corpus are not among the most frequent ones, so at most its inverse is looked at.
LEAST_SHARE = 20_000
#: Bytes of text whose words are counted and scored together.
CHUNK = 16 << 20
END = 0

_BASES = ("R1", "R2", "Q", "b")


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def split_words(body: bytes) -> list[bytes]:
    return body.lower().split()


class Symbols:
    """0: end (and what stands before a text), 1..len(short): frequent words, then the classes."""

    def __init__(self, short: list[bytes]):
        self.short = {w: i + 1 for i, w in enumerate(short)}
        self.first_class = len(short) + 1
        self.size = self.first_class + CLASSES

    def of(self, words: list[bytes]) -> np.ndarray:
        get, base = self.short.get, self.first_class
        return np.fromiter((get(w) or base + word_class(w) for w in words), np.int32, len(words))


def new_parameters(size: int, counts: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = (counts + 1) / (counts + 1).sum()
    return {
        "R1": (0.1 * r.standard_normal((size, DIM))).astype(np.float32),
        "R2": (0.1 * r.standard_normal((size, DIM))).astype(np.float32),
        "Q": (0.1 * r.standard_normal((size, DIM))).astype(np.float32),
        "b": np.log(p).astype(np.float32),
    }


def _added(n: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    out[rows[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def nce_step(net, state, target, c1, c2, noise, log_kp, rate: float = RATE) -> None:
    """One step of noise-contrastive estimation with noise shared by the batch; log_kp: log(k * noise probability) by symbol."""
    n, k = len(target), len(noise)
    h = net["R1"][c1] + net["R2"][c2]
    q, qn = net["Q"][target], net["Q"][noise]
    pos = np.einsum("nd,nd->n", h, q) + net["b"][target] - log_kp[target]
    neg = h @ qn.T + net["b"][noise] - log_kp[noise]
    gp = 1 / (1 + np.exp(-np.clip(pos, -30, 30))) - 1
    gn = 1 / (1 + np.exp(-np.clip(neg, -30, 30)))
    dh = gp[:, None] * q + gn @ qn
    size = len(net["b"])
    grads = {"R1": _added(size, c1, dh), "R2": _added(size, c2, dh)}
    dq = _added(size, target, gp[:, None] * h)
    np.add.at(dq, noise, gn.T @ h)
    db = np.bincount(target, gp, size).astype(np.float32)
    np.add.at(db, noise, gn.sum(axis=0))
    grads["Q"], grads["b"] = dq, db
    for name, g in grads.items():
        g /= n
        state[name] += g * g
        net[name] -= rate * g / (np.sqrt(state[name]) + 1e-8)


def log_normalisers(net) -> np.ndarray:
    """log Z of every pair of context symbols, by matrix products."""
    size = len(net["b"])
    out = np.empty((size, size), np.float32)
    for i in range(size):
        s = (net["R1"][i] + net["R2"]) @ net["Q"].T + net["b"]
        top = s.max(axis=1)
        out[i] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
    return out


def contexts(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end (words only) -> targets with ends, the symbol before, the one before that."""
    n = len(symbols) + len(sizes)
    target = np.zeros(n, np.int32)
    stops = np.cumsum(sizes + 1) - 1  # places of the ends
    real = np.ones(n, bool)
    real[stops] = False
    target[real] = symbols
    c1 = np.concatenate([[END], target[:-1]]).astype(np.int32)
    c2 = np.concatenate([[END, END], target[:-2]]).astype(np.int32)[:n]
    starts = stops - sizes  # a text sees nothing of the one before it
    c1[starts] = END
    c2[starts] = END
    second = starts + 1
    c2[second[second < n]] = END
    return target, c1, c2


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, number = 0, 0
    first = TaskContext.get().partitionId() << 32
    for batch in batches:
        numbers = []
        for b in batch.column(1):
            held += len(b.as_py())
            numbers.append(first + number)
            if held >= CHUNK:
                held, number = 0, number + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "chunk"])


def _chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (chunk, word, class, times in training texts): distinct words of each chunk."""
    counts: dict[bytes, int] = {}
    now = None

    def flush() -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for k in range(0, len(words), 20_000):
            some = words[k : k + 20_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(some), now)),
                    pa.array(some, pa.binary()),
                    pa.array([word_class(w) for w in some], pa.int32()),
                    pa.array([counts[w] for w in some], pa.int64()),
                ],
                ["chunk", "word", "class", "n"],
            )
        counts.clear()

    for batch in batches:
        chunks = batch.column(2).to_numpy(zero_copy_only=False)
        for body, chunk, learn in zip(batch.column(0), chunks.tolist(), batch.column(1).to_pylist()):
            if chunk != now:
                yield from flush()
                now = chunk
            if learn:
                for w in split_words(body.as_py()):
                    counts[w] = counts.get(w, 0) + 1
            else:
                for w in split_words(body.as_py()):
                    if w not in counts:
                        counts[w] = 0
    yield from flush()


def _train_task(symbols: Symbols, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, state, counts = held.value
        net = {k: v.copy() for k, v in net.items()}
        state = {k: v.copy() for k, v in state.items()}
        p = (counts + 1) / (counts + 1).sum()
        log_kp = (np.log(p) + np.log(NOISE)).astype(np.float32)
        r = np.random.default_rng(TaskContext.get().partitionId())
        tokens = 0
        for batch in batches:
            lists = [split_words(b.as_py()) for b in batch.column(0)]
            codes, names, sizes = numbered(lists)
            of = symbols.of(names)
            target, c1, c2 = contexts(of[codes] if len(codes) else np.zeros(0, np.int32), sizes)
            order = r.permutation(len(target))
            target, c1, c2 = target[order], c1[order], c2[order]
            noise = r.choice(len(p), (-(-len(target) // BATCH), NOISE), p=p)
            for i, k in enumerate(range(0, len(target), BATCH)):
                cut = slice(k, k + BATCH)
                nce_step(net, state, target[cut], c1[cut], c2[cut], noise[i], log_kp)
            tokens += len(target)
        if tokens:
            flat = np.concatenate([part[k].ravel() for part in (net, state) for k in _BASES]).astype(np.float64) * tokens
            yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([flat.astype(np.float32).tobytes()])], ["tokens", "sum"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, total = 0, None
    for batch in batches:
        for n, s in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = np.frombuffer(s.as_py(), np.float32).astype(np.float64)
            total = v if total is None else total + v
            tokens += n
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([total.astype(np.float32).tobytes()])], ["tokens", "sum"])


def train(source: DataFrame, symbols: Symbols, counts: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """source(body, learn, doc_id): parameters after one pass over all training texts, in ``rounds`` parts."""
    sc = source.sparkSession.sparkContext
    net = new_parameters(symbols.size, counts)
    # the step sizes' state goes on from round to round like the parameters
    state = {k: np.full_like(v, 1e-4) for k, v in net.items()}
    part = F.pmod(F.xxhash64(F.lit("round"), "doc_id", "chunk"), F.lit(rounds))
    for i in range(rounds):
        held = sc.broadcast((net, state, counts))
        done = (
            source.where(F.col("learn") & (part == i))
            .select("body")
            .mapInArrow(_train_task(symbols, held), "tokens long, sum binary")
            .repartition(8)
            .mapInArrow(_add_up, "tokens long, sum binary")
            .collect()
        )  # at most 8 sums of parameters
        tokens = sum(r["tokens"] for r in done)
        if tokens:
            flat = sum(np.frombuffer(r["sum"], np.float32).astype(np.float64) for r in done) / tokens
            at, new = 0, ({}, {})
            for into in new:
                for k in _BASES:
                    into[k] = flat[at : at + net[k].size].reshape(net[k].shape).astype(np.float32)
                    at += net[k].size
            net, state = new
        held.unpersist()
    return net


def _score_chunk(model):
    """A chunk's texts and its words' counts -> scores."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        net, logz, symbols, n_train, v_train, ends, mass = model.value
        known = dict(zip(right.column("word").to_pylist(), right.column("c").to_pylist()))
        lists = [split_words(b) for b in left.column("body").to_pylist()]
        codes, names, sizes = numbered(lists)
        c = np.fromiter((known.get(w, 0) for w in names), np.float64, len(names))
        text = np.repeat(np.arange(len(sizes)), sizes)
        whole = n_train + v_train + 1
        base_of = np.log10((c + 1) / whole)
        k = len(sizes)
        base = np.bincount(text, base_of[codes], k) + np.log10((ends + 1) / whole)
        n_known = np.bincount(text, (c > 0)[codes], k).astype(np.int64) + int(ends > 0)
        of = symbols.of(names)
        inside = np.zeros(len(names))
        rare = of >= symbols.first_class
        inside[rare] = np.log((c[rare] + 1) / (mass[of[rare] - symbols.first_class] + 1))
        target, c1, c2 = contexts(of[codes] if len(codes) else np.zeros(0, np.int32), sizes)
        score = np.empty(len(target), np.float64)
        for a in range(0, len(target), 1 << 18):
            t, x, y = target[a : a + (1 << 18)], c1[a : a + (1 << 18)], c2[a : a + (1 << 18)]
            h = net["R1"][x] + net["R2"][y]
            score[a : a + len(t)] = np.einsum("nd,nd->n", h, net["Q"][t]) + net["b"][t] - logz[x, y]
        by_text = np.repeat(np.arange(k), sizes + 1)
        total = np.bincount(by_text, score, k) + np.bincount(text, inside[codes], k)
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "held_out": pa.array([not x for x in left.column("learn").to_pylist()]),
                "n_tokens": pa.array(sizes + 1),
                "n_known": pa.array(n_known),
                "train_tokens": pa.array(np.full(k, int(n_train))),
                "base_score": pa.array(base),
                "score": pa.array(total / np.log(10)),
            }
        )

    return run


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): learns from the texts whose fold is not
    ``held``, scores all.  Scores are log10 probabilities of whole texts, ends included."""
    spark = docs.sparkSession
    base = texts(docs).withColumn("learn", fold("doc_id", folds) != held)
    source = stored(base.mapInArrow(_chunked, "doc_id long, body binary, learn boolean, chunk long"), "texts")
    words = source.select("body", "learn", "chunk").mapInArrow(
        _chunk_words, "chunk long, word binary, class int, n long"
    )
    words = stored(words, "words")
    # summed before they are shuffled and joined back, so the rows of a frequent word are never together
    totals = stored(words.groupBy("word", "class").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    ends = source.where("learn").count()
    sums = totals.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n_train, v_train = (sums["n"] or 0) + ends, sums["v"] + int(ends > 0)
    top = totals.where(F.col("c") * LEAST_SHARE >= n_train).orderBy(F.desc("c"), "word").limit(SHORT).select("word", "c").collect()
    symbols = Symbols([bytes(r["word"]) for r in top])
    by_class = totals.groupBy("class").agg(F.sum("c").alias("c"), F.sum(F.col("c") + 1).alias("m")).collect()
    counts, mass = np.zeros(symbols.size), np.zeros(CLASSES)
    for r in by_class:
        counts[symbols.first_class + r["class"]] = r["c"]
        mass[r["class"]] = r["m"]
    counts[END] = ends
    for i, r in enumerate(top):
        counts[i + 1] = r["c"]
        k = word_class(bytes(r["word"]))
        counts[symbols.first_class + k] -= r["c"]
        mass[k] -= r["c"] + 1
    net = train(source, symbols, counts)
    model = spark.sparkContext.broadcast((net, log_normalisers(net), symbols, n_train, v_train, ends, mass))
    return (
        source.groupBy("chunk")
        .cogroup(words.join(totals.select("word", "c"), "word").select("chunk", "word", "c").groupBy("chunk"))
        .applyInArrow(
            _score_chunk(model),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
