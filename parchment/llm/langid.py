"""Language spans of whole texts: scripts narrow the candidates, Viterbi with a switching penalty labels words.

Learned from labelled texts, over all of them: how often each language uses each hashed byte n-gram, and
which scripts its letters come from.  The counts have a fixed number of buckets for each language.

A word's scores are its n-grams' log-probabilities in the languages that use the word's script (in all of them,
equally, where none does).  The best labelling of a text minimises misfit plus ``SWITCH`` for each change of language.  Texts are cut
into runs of ``RUN`` words whose best scores are found for every starting language at once, then chained, so one very long text
costs no more steps than many short ones.

A text's language is the one with most letters; its score is that language's share of letters.  Null texts and texts without a letter
give ``und`` with score 0 and no spans.  Rows with a null language are not learned from; without labelled rows all is ``und``.
Repeated rows are repeated, null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import fold, texts
from parchment.llm.grams import numbered, word_grams

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
#: Cost of a change of language, in nats.
SWITCH = 10.0
RUN = 128
#: A language uses a script that has this share of its letters.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"

# First code points of the Unicode ranges of common scripts, in order.
SCRIPTS = (
    (0x0041, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0700, "other"),
    (0x0900, "devanagari"),
    (0x0980, "bengali"),
    (0x0A00, "other"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0x20000, "han"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = tuple(dict.fromkeys(n for _, n in SCRIPTS))
_NAME_OF = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # BUCKETS x languages
    scripts: np.ndarray  # languages x scripts: used or not


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def _script(word: str) -> int:
    """The script of most letters (ties: the one listed first); word has letters."""
    if word.isascii():
        return 0
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    kinds = _NAME_OF[np.maximum(np.searchsorted(_STARTS, points, "right") - 1, 0)]
    return int(np.argmax(np.bincount(kinds, minlength=len(SCRIPT_NAMES))))


def _batch(bodies) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words of texts: numbers, the letters of distinct words, words of each text."""
    codes, names, sizes = numbered([str(b.as_py(), "utf-8").lower().split() for b in bodies])
    return codes, [_letters(n) for n in names], sizes


def train(docs: DataFrame, folds: int = 4, held: int = 2) -> Model | None:
    """Counts over all texts with a language whose fold is not ``held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            codes, names, sizes = _batch(batch.column(1))
            langs = np.array(batch.column(2).to_pylist(), object)
            with_letters = np.array([bool(n) for n in names], bool)
            real = np.flatnonzero(with_letters)
            if not len(real):
                continue
            at = np.full(len(names), -1)
            at[real] = np.arange(len(real))
            words = [names[i] for i in real]
            gram, first, n = word_grams([w.encode() for w in words], GRAMS, BUCKETS)
            kind = np.fromiter(map(_script, words), np.int64, len(words))
            length = np.fromiter(map(len, words), np.int64, len(words))
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            for lang in dict.fromkeys(langs.tolist()):
                used = at[codes[(langs == lang)[text_of]]]
                times = np.bincount(used[used >= 0], minlength=len(words))
                counts.setdefault(lang, np.zeros(BUCKETS))
                counts[lang] += np.bincount(gram, np.repeat(times, n), BUCKETS)
                scripts.setdefault(lang, np.zeros(len(SCRIPT_NAMES)))
                scripts[lang] += np.bincount(kind, times * length, len(SCRIPT_NAMES))
        for lang, c in counts.items():
            both = np.concatenate([c, scripts[lang]])
            cell = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cell)), pa.array(cell), pa.array(both[cell])], ["lang", "cell", "n"]
            )

    known = texts(docs.where(F.col("lang").isNotNull() & (fold("doc_id", folds) != held)), F.col("lang").cast("string").alias("lang"))
    rows = (
        known.mapInArrow(run, "lang string, cell long, n double")
        .groupBy("lang", "cell")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )  # at most languages x (BUCKETS + scripts) sums
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    table = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)))
    table[np.searchsorted(languages, rows["lang"].to_numpy(object).astype(str)), rows["cell"]] = rows["n"]
    counts, scripts = table[:, :BUCKETS] + 0.1, table[:, BUCKETS:]
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    logp = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)
    return Model(languages, np.ascontiguousarray(logp), share >= SCRIPT_SHARE)


def emissions(model: Model, names: list[str]) -> np.ndarray:
    """Scores of distinct words in each language, relative to the best; words without letters score alike."""
    out = np.zeros((len(names) + 1, len(model.languages)), np.float32)
    real = np.array([i for i, n in enumerate(names) if n], np.int64)
    if len(real):
        words = [names[i] for i in real]
        gram, first, n = word_grams([w.encode() for w in words], GRAMS, BUCKETS)
        e = np.add.reduceat(model.logp[gram], first, axis=0)
        # n-grams of several sizes tell the same letters more than once
        e /= len(GRAMS)
        fits = model.scripts[:, np.fromiter(map(_script, words), np.int64, len(words))].T
        e = np.where(fits, e, -1e4)
        e[~fits.any(axis=1)] = 0
        out[real] = e - e.max(axis=1, keepdims=True)
    return out


def viterbi(e: np.ndarray, codes: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Label of each word.  e: scores by word number, the last row being neutral."""
    k = e.shape[1]
    pieces = -(-sizes // RUN)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (np.cumsum(sizes) - sizes)[doc] + nth * RUN
    stop = np.minimum(start + RUN, np.cumsum(sizes)[doc])
    at = start[:, None] + np.arange(RUN)
    cells = np.where(at < stop[:, None], codes[np.minimum(at, max(0, len(codes) - 1))], len(e) - 1)
    columns = np.ascontiguousarray(cells.T)
    # best score of each run from each language before it to each at its end
    through = np.empty((len(doc), k, k), np.float32)
    lot = max(1, (1 << 20) // (k * k))
    for a in range(0, len(doc), lot):
        v = np.full((len(doc[a : a + lot]), k, k), -1e6, np.float32)
        v[:, np.arange(k), np.arange(k)] = 0
        for t in range(RUN):
            v = np.maximum(v, v.max(axis=2, keepdims=True) - switch)
            v += e[columns[t, a : a + lot]][:, None, :]
        through[a : a + lot] = v
    # chain the runs of a text
    ends = np.zeros((len(doc), k))
    before = np.zeros((len(doc), k))
    for i in range(int(pieces.max(initial=0))):
        rows = np.flatnonzero(nth == i)
        if i:
            before[rows] = ends[rows - 1] - ends[rows - 1].max(axis=1, keepdims=True)
        ends[rows] = (before[rows][:, :, None] + through[rows]).max(axis=1)
    last = ends.argmax(axis=1)
    entry = np.zeros(len(doc), np.int64)
    for i in range(int(pieces.max(initial=0)) - 1, -1, -1):
        rows = np.flatnonzero(nth == i)
        entry[rows] = (before[rows] + through[rows, :, last[rows]]).argmax(axis=1)
        if i:
            last[rows - 1] = entry[rows]
    # labels within each run
    v = np.full((len(doc), k), -1e6, np.float32)
    v[np.arange(len(doc)), entry] = 0
    came = np.empty((RUN, len(doc)), np.int16)
    stay = np.empty((RUN, len(doc), k), bool)
    for t in range(RUN):
        top = v.max(axis=1, keepdims=True) - switch
        came[t] = v.argmax(axis=1)
        stay[t] = v >= top
        v = np.maximum(v, top) + e[columns[t]]
    labels = np.empty((RUN, len(doc)), np.int16)
    now = last.astype(np.int64)
    for t in range(RUN - 1, -1, -1):
        labels[t] = now
        now = np.where(stay[t][np.arange(len(doc)), now], now, came[t])
    return labels.T[at < stop[:, None]]


def label_spans(docs: DataFrame, model: Model | None, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans array<struct<lang, first_word, n_words>>)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        span = pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])
        for batch in batches:
            n = batch.num_rows
            pred, score, spans = [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)]
            codes, names, sizes = _batch(batch.column(1))
            if model is not None and len(codes):
                labels = viterbi(emissions(model, names), codes, sizes, switch).astype(np.int64)
                letters = np.fromiter(map(len, names), np.int64, len(names))[codes]
                text_of = np.repeat(np.arange(n), sizes)
                k = len(model.languages)
                weight = np.bincount(text_of * k + labels, letters, n * k).reshape(n, k)
                total = weight.sum(axis=1)
                new = np.ones(len(codes), bool)
                new[1:] = (labels[1:] != labels[:-1]) | (text_of[1:] != text_of[:-1])
                at = np.flatnonzero(new)
                width = np.diff(np.append(at, len(codes)))
                first = np.cumsum(sizes) - sizes
                for i, w in zip(at.tolist(), width.tolist()):
                    if total[text_of[i]]:
                        spans[text_of[i]].append((model.languages[labels[i]], i - int(first[text_of[i]]), w))
                for i in np.flatnonzero(total):
                    best = int(weight[i].argmax())
                    pred[i], score[i] = model.languages[best], float(weight[i, best] / total[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred), pa.array(score, pa.float64()), pa.array(spans, pa.list_(span))],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    return texts(docs).mapInArrow(
        run,
        "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first_word:bigint,n_words:bigint>>",
    )
