"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector (hashed vocabulary) beside the scaled sum of the vectors of
its character n-grams, so unseen spellings and inflections keep their stems.  The network reads windows
of ``WINDOW`` words, one every ``STRIDE`` words, so that neighbours overlap; a text's score is that of its highest window, and every window of
every text is scored.  A label marks a text, not a place, so training takes first the windows that hold the n-gram of
highest log-odds and then, in each round, those that the network itself finds highest.

The network is fitted on a bounded sample of labelled rows: at most ``ROWS_EACH`` of either label, those of
least hash of the id.  All windows of these are ranked in every round, and every window of a text of label 0 is read as one
without toxicity: the highest in each pass, the others in ``TURNS`` turns.  Scoring has no bound and reads text alone.

Null text counts as empty; a text without words scores 0.  Without usable labels of both kinds
every score is 0.  Repeated rows are repeated, null ids stay null, rows with null labels are not learned from.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import fold, texts

WINDOW = 32
STRIDE = 24
HIDDEN = 12
WORD_DIM = 8
CHAR_DIM = 12
WORD_BUCKETS = 1 << 15
CHAR_BUCKETS = 1 << 15
GRAMS = (3, 5, 7)
#: Labelled rows of each kind that the network is fitted on.
ROWS_EACH = 2000
#: Passes over the windows that single n-grams point to.
FIRST_PASSES = 2
#: Passes over the windows that the network finds highest.
ROUNDS = 5
#: Passes in which each window of label 0 is read once: all, where they are not repeated.
TURNS = FIRST_PASSES + ROUNDS
#: Below this many sampled rows the passes are repeated, four times at most.
LEAST_ROWS = 1200
#: Share of words hidden from a training step, and decay of the tables' rows that it touches.
HIDE = 0.3
DECAY = 0.1
#: Share of label 0 that the threshold may let through at most.
FALSE_SHARE = 0.02
#: Windows that are scored at once, and distinct words that are hashed at once.
LOT = 1024
WORDS_AT_ONCE = 1 << 14

_A = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    return h ^ (h >> np.uint64(29))


class Words:
    """Hashed inputs of distinct words: own bucket, and n-gram buckets of all words end to end.  Words are hashed ``WORDS_AT_ONCE`` at
    a time, for the steps take some 170 bytes a letter."""

    def __init__(self, words: list[str]):
        parts = [self._hashed(words[k : k + WORDS_AT_ONCE]) for k in range(0, len(words), WORDS_AT_ONCE)]
        self.word, self.gram, self.count = (np.concatenate(x) for x in zip(*parts))
        self.first = np.cumsum(self.count) - self.count

    @staticmethod
    def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = [f"<{w}>".encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        own = np.repeat(np.arange(len(raw)), sizes)
        steps = np.full(len(data) + 1, _A, np.uint64)
        steps[0] = 1
        power = np.cumprod(steps)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * power[:-1])])
        inverse = np.full(len(data) + 1, pow(int(_A), -1, 1 << 64), np.uint64)
        inverse[0] = 1
        inverse = np.cumprod(inverse)

        def span(a, b):
            return _mixed((sums[b] - sums[a]) * inverse[a])

        word = (span(starts, ends) >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
        at, whose = [], []
        for n in GRAMS:
            p = np.arange(max(0, len(data) - n + 1))
            p = p[p + n <= ends[own[p]]]
            at.append((span(p, p + n) >> np.uint64(40)).astype(np.int64) % CHAR_BUCKETS)
            whose.append(own[p])
        order = np.argsort(np.concatenate(whose), kind="stable")
        gram = np.concatenate(at)[order].astype(np.int32)
        return word, gram, np.bincount(np.concatenate(whose), minlength=len(raw))

    def inputs(self, net: dict[str, np.ndarray]) -> np.ndarray:
        """Of each word, and of the pad behind them."""
        # every word has an n-gram, for its two marks alone make one
        n = len(self.word)
        out = np.zeros((n + 1, WORD_DIM + CHAR_DIM), np.float32)
        out[:n, :WORD_DIM] = net["words"][self.word]
        for k in range(0, n, WORDS_AT_ONCE):
            first, count = self.first[k : k + WORDS_AT_ONCE], self.count[k : k + WORDS_AT_ONCE]
            grams = net["chars"][self.gram[first[0] : first[-1] + count[-1]]]
            out[k : min(n, k + WORDS_AT_ONCE), WORD_DIM:] = np.add.reduceat(grams, first - first[0], axis=0) / np.sqrt(count)[:, None]
        return out


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end: the text and the first word of each window.  The last window ends with the text."""
    first = np.cumsum(sizes) - sizes
    n = np.where(sizes == 0, 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)))
    doc = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(k * STRIDE, np.maximum(0, sizes[doc] - WINDOW))
    return doc, first[doc] + start


def cells_of(start: np.ndarray, stop: np.ndarray, codes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of windows, and where they have words."""
    at = start[:, None] + np.arange(WINDOW)
    inside = at < stop[:, None]
    return np.where(inside, codes[np.minimum(at, len(codes) - 1)], pad), inside


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_network(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN

    def init(*shape, scale):
        return (r.standard_normal(shape) * scale).astype(np.float32)

    net = {"words": init(WORD_BUCKETS, WORD_DIM, scale=0.02), "chars": init(CHAR_BUCKETS, CHAR_DIM, scale=0.05)}
    for way in ("f", "b"):
        net[f"W{way}"] = init(d, 3 * h, scale=d**-0.5)
        net[f"U{way}"] = init(h, 3 * h, scale=h**-0.5)
        net[f"c{way}"] = np.zeros(3 * h, np.float32)
    net["A"] = init(2 * h, h, scale=(2 * h) ** -0.5)
    net["v"] = init(h, scale=h**-0.5)
    net["o"] = init(2 * h, scale=(2 * h) ** -0.5)
    net["bias"] = np.zeros(1, np.float32)
    return net


def _pass(net, way: str, proj: np.ndarray, cells: np.ndarray, inside: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction, steps x windows x HIDDEN."""
    h = HIDDEN
    U = net[f"U{way}"]
    state = np.zeros((len(cells), h), np.float32)
    out = np.empty((WINDOW, len(cells), h), np.float32)
    whole = inside.all()
    for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
        x = proj[cells[:, t]]
        u = state @ U
        zr = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
        new = n + z * (state - n)
        if not whole:
            new = np.where(inside[:, t, None], new, state)
        if keep is not None:
            keep.append((t, state, u, z, r, n))
        state = new
        out[t] = state
    return out


def _pass_lean(net, way: str, inputs: np.ndarray, cells: np.ndarray, inside: np.ndarray, out: np.ndarray) -> None:
    """As ``_pass``, without what the gradients need.  A sigmoid is (1 + tanh(x / 2)) / 2."""
    h = HIDDEN
    U = net[f"U{way}"].copy()
    U[:, : 2 * h] *= 0.5
    proj = inputs
    whole = inside.all()
    n_rows = len(cells)
    state = np.zeros((n_rows, h), np.float32)
    u, x = np.empty((n_rows, 3 * h), np.float32), np.empty((n_rows, 3 * h), np.float32)
    zr, n = np.empty((n_rows, 2 * h), np.float32), np.empty((n_rows, h), np.float32)
    columns = np.ascontiguousarray(cells.T)
    for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
        np.take(proj, columns[t], axis=0, out=x, mode="clip")
        np.matmul(state, U, out=u)
        np.add(x[:, : 2 * h], u[:, : 2 * h], out=zr)
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        np.multiply(zr[:, h:], u[:, 2 * h :], out=n)
        n += x[:, 2 * h :]
        np.tanh(n, out=n)
        new = state - n
        new *= zr[:, :h]
        new += n
        if not whole:
            new = np.where(inside[:, t, None], new, state)
        state = new
        out[t] = state


def projections(net, inputs: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    for way in ("f", "b"):
        p = inputs @ net[f"W{way}"]
        p += net[f"c{way}"]
        p[:, : 2 * HIDDEN] *= 0.5
        out[way] = p
    return out


def lean_logits(net, proj: dict[str, np.ndarray], cells: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The logits of ``forward``."""
    h = HIDDEN
    both = np.empty((WINDOW, len(cells), 2 * h), np.float32)
    _pass_lean(net, "f", proj["f"], cells, inside, both[:, :, :h])
    _pass_lean(net, "b", proj["b"], cells, inside, both[:, :, h:])
    flat = both.reshape(-1, 2 * h)
    u = flat @ net["A"]
    np.tanh(u, out=u)
    e = (u @ net["v"]).reshape(WINDOW, -1)
    if not inside.all():
        e = np.where(inside.T, e, np.float32(-1e9))
    a = np.exp(e - e.max(axis=0))
    y = (flat @ net["o"]).reshape(WINDOW, -1)
    return (a * y).sum(axis=0) / a.sum(axis=0) + net["bias"][0]


def forward(net, inputs: np.ndarray, cells: np.ndarray, inside: np.ndarray, cache: dict | None = None) -> np.ndarray:
    """Logits of windows.  inputs: of the distinct words, the last one being the pad's."""
    states = []
    for way in ("f", "b"):
        proj = inputs @ net[f"W{way}"] + net[f"c{way}"]
        keep: list | None = None if cache is None else []
        states.append(_pass(net, way, proj, cells, inside, keep))
        if cache is not None:
            cache[way] = keep
    both = np.concatenate(states, axis=2)
    u = np.tanh(both @ net["A"])
    e = np.where(inside.T, u @ net["v"], -1e9)
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", a, both)
    if cache is not None:
        cache.update(both=both, u=u, a=a, pooled=pooled)
    return pooled @ net["o"] + net["bias"][0]


def _added(n: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values by row number."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    out[rows[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def backward(net, inputs, cells, inside, cache, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the network's matrices and of the distinct words' inputs."""
    h = HIDDEN
    both, u, a, pooled = (cache[k] for k in ("both", "u", "a", "pooled"))
    g = {"o": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
    dpool = dlogit[:, None] * net["o"]
    da = np.einsum("tnk,nk->tn", both, dpool)
    dboth = a[:, :, None] * dpool[None]
    de = a * (da - (a * da).sum(axis=0))
    g["v"] = np.einsum("tn,tnk->k", de, u)
    du = de[:, :, None] * net["v"] * (1 - u * u)
    g["A"] = np.einsum("tni,tnj->ij", both, du)
    dboth += du @ net["A"].T
    dinputs = np.zeros_like(inputs)
    for way, cut in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
        U = net[f"U{way}"]
        dU = np.zeros_like(U)
        dxs, at = [], []
        dstate = np.zeros((len(cells), h), np.float32)
        for t, prev, uu, z, r, n in reversed(cache[way]):
            m = inside[:, t, None]
            dstate = dstate + dboth[t][:, cut]
            dnew = np.where(m, dstate, 0)
            rest = np.where(m, 0, dstate)
            dz = dnew * (prev - n) * z * (1 - z)
            dn = dnew * (1 - z) * (1 - n * n)
            dr = dn * uu[:, 2 * h :] * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], axis=1)
            du_ = np.concatenate([dz, dr, dn * r], axis=1)
            dU += prev.T @ du_
            dstate = dnew * z + du_ @ U.T + rest
            dxs.append(dx)
            at.append(cells[:, t])
        dproj = _added(len(inputs), np.concatenate(at), np.concatenate(dxs))
        dproj[-1] = 0
        g[f"U{way}"] = dU
        g[f"W{way}"] = inputs.T @ dproj
        g[f"c{way}"] = dproj.sum(axis=0)
        dinputs += dproj @ net[f"W{way}"].T
    return g, dinputs


class Fitter:
    """Adam over the matrices, and over the touched rows of the tables."""

    def __init__(self, net, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.items()}
        self.s = {k: np.zeros_like(v) for k, v in net.items()}

    def _move(self, k, rows, g):
        m, s = self.m[k], self.s[k]
        m[rows] = 0.9 * m[rows] + 0.1 * g
        s[rows] = 0.99 * s[rows] + 0.01 * g * g
        c = np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        if k in ("words", "chars"):
            self.net[k][rows] *= 1 - self.rate * DECAY
        self.net[k][rows] -= self.rate * c * m[rows] / (np.sqrt(s[rows]) + 1e-6)

    def step(self, words: Words, cells, inside, target, weight) -> None:
        used, cells = np.unique(cells, return_inverse=True)
        pad = len(words.word)
        real = used[used < pad]
        cells = cells.reshape(inside.shape)
        if len(real) == len(used):
            used = np.append(used, pad)
        inputs = np.concatenate([self.inputs_of(words, real), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])
        cache: dict = {}
        logit = forward(self.net, inputs, cells, inside, cache)
        d = ((_sigmoid(logit) - target) * weight / len(target)).astype(np.float32)
        g, dinputs = backward(self.net, inputs, cells, inside, cache, d)
        self.t += 1
        for k, v in g.items():
            self._move(k, slice(None), v)
        dinputs = dinputs[:-1]
        rows, inv = np.unique(words.word[real], return_inverse=True)
        self._move("words", rows, _added(len(rows), inv, dinputs[:, :WORD_DIM]))
        n = words.count[real]
        at = np.repeat(words.first[real] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows, inv = np.unique(words.gram[at], return_inverse=True)
        each = np.repeat(dinputs[:, WORD_DIM:] / np.sqrt(n)[:, None], n, axis=0)
        self._move("chars", rows, _added(len(rows), inv, each.astype(np.float32)))

    def inputs_of(self, words: Words, real: np.ndarray) -> np.ndarray:
        n = words.count[real]
        first = np.cumsum(n) - n
        at = np.repeat(words.first[real] - first, n) + np.arange(n.sum())
        chars = np.add.reduceat(self.net["chars"][words.gram[at]], first, axis=0) / np.sqrt(n)[:, None]
        return np.concatenate([self.net["words"][words.word[real]], chars], axis=1).astype(np.float32)


def split_words(body: str) -> list[str]:
    return body.lower().split()


def _numbered(bodies: list[str]) -> tuple[np.ndarray, Words | None, np.ndarray]:
    """Word numbers of texts end to end, in the order of their first places, the distinct words, words of each text.  The words of
    one text at a time are held as strings."""
    numbers: dict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    codes = [np.array([numbers[w] for w in split_words(b)], np.int64) for b in bodies]
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    if not numbers:
        return np.zeros(0, np.int64), None, sizes
    return np.concatenate(codes), Words(list(numbers)), sizes


def window_logits(net, words: Words, codes, start, stop) -> np.ndarray:
    proj = projections(net, words.inputs(net))
    out = np.empty(len(start), np.float32)
    for k in range(0, len(start), LOT):
        cells, inside = cells_of(start[k : k + LOT], stop[k : k + LOT], codes, len(words.word))
        out[k : k + LOT] = lean_logits(net, proj, cells, inside)
    return out


def _ranks(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Place of each window among its text's, highest value first."""
    order = np.lexsort((-value, doc))
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
    return rank


def _evidence(words: Words, codes, sizes, labels, doc, start, stop) -> np.ndarray:
    """Of each window the highest log-odds, by texts of either label, of an n-gram in it: where to look first."""
    ends = np.cumsum(sizes)
    texts_with = np.zeros((2, CHAR_BUCKETS))
    for i, end in enumerate(ends.tolist()):
        w = np.unique(codes[end - sizes[i] : end])
        n = words.count[w]
        at = np.repeat(words.first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        texts_with[int(labels[i]), np.unique(words.gram[at])] += 1
    odds = np.zeros(CHAR_BUCKETS)
    for y, sign in ((1, 1), (0, -1)):
        odds += sign * np.log((texts_with[y] + 0.5) / max(1, (labels == y).sum()))
    by_word = np.append(np.maximum.reduceat(odds[words.gram], words.first), -50.0)
    out = np.empty(len(start))
    for k in range(0, len(start), LOT):
        cells, _ = cells_of(start[k : k + LOT], stop[k : k + LOT], codes, len(by_word) - 1)
        out[k : k + LOT] = by_word[cells].max(axis=1)
    return out


def fit(bodies: list[str], labels: np.ndarray, share: float, seed: int = 7) -> dict[str, np.ndarray] | None:
    """Network for texts with labels 0 or 1.  ``share``: of label 1 among all labelled rows, for the threshold."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    r = np.random.default_rng(seed)
    codes, words, sizes = _numbered(bodies)
    if words is None:
        return None
    use = np.arange(len(sizes)) % 5 == 4  # a fifth is kept to set the threshold
    doc, start = windows_of(sizes)
    doc, start = doc[~use[doc]], start[~use[doc]]
    stop = np.cumsum(sizes)[doc]
    best = _ranks(doc, _evidence(words, codes, sizes, labels, doc, start, stop))
    turn = r.integers(0, TURNS, len(doc))
    net = new_network(seed)
    fitter = Fitter(net, 0.01)
    pad = len(words.word)

    def train(number: int, rank: np.ndarray) -> None:
        """A pass over the windows that rank first, more of clean texts, and of those the others whose turn it is."""
        clean = labels[doc] == 0
        rows = (rank == 0) | ((rank < 3) & clean) | ((turn == number % TURNS) & clean)
        rows = r.permutation(np.flatnonzero(rows))
        y = labels[doc[rows]]
        up = (y == 0).sum() / max(1, (y == 1).sum())
        w = np.where(y == 1, min(4, up), 1).astype(np.float32)
        for k in range(0, len(rows), 128):
            part = rows[k : k + 128]
            cells, inside = cells_of(start[part], stop[part], codes, pad)
            cells = np.where(r.random(cells.shape) < HIDE, pad, cells)  # some words are hidden
            fitter.step(words, cells, inside, labels[doc[part]], w[k : k + 128])

    # small samples are read more often
    times = min(4, max(1, LEAST_ROWS // max(1, int((~use).sum()))))
    for number in range(FIRST_PASSES * times):
        train(number, best)
    fitter.rate = 0.004
    for number in range(FIRST_PASSES * times, (FIRST_PASSES + ROUNDS) * times):
        train(number, _ranks(doc, window_logits(net, words, codes, start, stop)))
    if labels[use].min(initial=1) == labels[use].max(initial=0):
        use[:] = True
    # the threshold is for the highest of all windows
    doc, start = windows_of(sizes)
    rows = use[doc]
    doc, start = doc[rows], start[rows]
    top = np.full(len(sizes), -30.0)
    np.maximum.at(top, doc, window_logits(net, words, codes, start, np.cumsum(sizes)[doc]))
    net["bias"] = net["bias"] - np.float32(_threshold(top[use], labels[use], share))
    return net


def _threshold(top: np.ndarray, labels: np.ndarray, share: float) -> float:
    """The logit at which the weighted F1 is highest among those that pass FALSE_SHARE of label 0 at most; amid the
    gap where it lies in one."""
    order = np.argsort(-top, kind="stable")
    t, y = top[order], labels[order]
    w1 = share / max(1, (labels == 1).sum())
    w0 = (1 - share) / max(1, (labels == 0).sum())
    hit, false = np.cumsum(y == 1) * w1, np.cumsum(y == 0) * w0
    f1 = 2 * hit / (hit + false + share)
    f1[:-1][t[:-1] == t[1:]] = -1
    f1[false > FALSE_SHARE * (1 - share) + 1e-9] -= 1
    k = int(np.argmax(f1))
    return float((t[k] + (t[k + 1] if k + 1 < len(t) else t[k] - 1)) / 2)


def train_model(docs: DataFrame, labels: DataFrame, held_out: int = 5) -> dict[str, np.ndarray] | None:
    """Fit on labelled rows whose fold is not 0: at most ROWS_EACH of each label."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(fold("doc_id", held_out) != 0)
        .select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("y"))
        .dropDuplicates(["_id"])
    )
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = counts[1] / (counts[0] + counts[1])
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(ROWS_EACH) for y in (0, 1)]
    rows = texts(docs).join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(i, y, str(b, "utf-8")) for batch in batches for i, y, b in zip(*(c.to_pylist() for c in batch.columns))]
        held.sort(key=lambda r: ((r[0] * 2654435761) % 2**32, r))
        net = fit([r[2] for r in held], np.array([r[1] for r in held]), share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)])], ["net"])

    # the sample is bounded, so one task fits it; the driver gets the network alone
    found = rows.select("doc_id", "y", "body").repartition(1).mapInArrow(run, "net binary").first()
    return pickle.loads(found["net"])


def score(docs: DataFrame, net: dict[str, np.ndarray] | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, carry...) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            bodies = [str(b.as_py(), "utf-8") for b in batch.column(1)]
            top = np.full(len(bodies), -np.inf)
            if net is not None and bodies:
                codes, words, sizes = _numbered(bodies)
                if words is not None:
                    doc, start = windows_of(sizes)
                    np.maximum.at(top, doc, window_logits(net, words, codes, start, np.cumsum(sizes)[doc]))
            scores = np.where(np.isinf(top), 0.0, _sigmoid(top))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), *batch.columns[2:]],
                ["doc_id", "score", *[f"_{i}" for i in range(len(carry))]],
            )

    base = texts(docs, *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)])
    schema = "doc_id long, score double"
    for i in range(len(carry)):
        schema += f", _{i} {base.schema[f'_{i}'].dataType.simpleString()}"
    out = base.mapInArrow(run, schema)
    return out.select("doc_id", "score", *[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)])
