"""Phrase collocations by prefix-free parsing.

Texts are lower-cased (A-Z), cut at punctuation into pieces and into words.  A piece is parsed into chunks: a window of
``max_words - 1`` words whose hash is divisible by ``period`` ends one chunk and begins the next, so neighbours overlap by
just that window and the same passage is cut the same way wherever it stands.  The distinct chunks of a language with their
frequencies form the dictionary; a chunk is met once however often it is repeated.  Phrases are counted inside distinct
chunks, weighted by the frequency; a phrase belongs to the chunk in which it begins before the closing overlap (or
anywhere in a piece's last chunk), so each occurrence is counted once.

Counting goes by length.  A phrase can only reach the least count if its first and its last words without the other end
do, so of length k only phrases are counted whose two parts of length k - 1 are marked in a bitmap of hashed frequent
phrases; from three words on, the dictionary is cut down to runs of frequent pairs.  The bitmap has a fixed size; what shares
a place with a frequent phrase is counted in vain and dropped by its exact count, so results don't depend on the size, only
the work does (``BITS`` may be raised for larger corpora).  A task sums equal phrases of a batch before the shuffle, so that
a hot word gives one row a batch.

Scores are integers: floor(1000 a n / (l r)) in decimals of 38 digits.

Null text counts as empty; null language is ``und``; rows without words give nothing; repeated rows count each time; an
empty table gives no rows; ids and other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import small_batches, stored

#: What ends a piece and what parts words: fixed values of the contract.
PIECE_END = r"[.,;:!?\x0A-\x0D]"
BLANKS = r"[\x20\x09]+"
UNKNOWN_LANG = "und"
#: A window in about so many ends a chunk.
PERIOD = 16
#: Places of the bitmap of frequent phrases (16 MB).
BITS = 1 << 27
#: Bytes of text whose pieces a task holds at once, and bytes whose words it places at once.
BATCH_BYTES, BLOCK_BYTES = 1 << 24, 1 << 22
#: Phrases that a task sums before it passes them on.
KEPT_PHRASES = 600_000
#: Parts in which a language's phrases are ranked before the last step.
PARTS = 64

#: Bytes in one form: letters lower-cased, every end of a piece a line feed, every blank a space.
_FORM = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES = re.compile(b"  +")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_powers = np.ones((2, 1), np.uint64)


def _powers_to(n: int) -> np.ndarray:
    """Powers of the base of the rolling hash and of its inverse, modulo 2^64."""
    global _powers
    if _powers.shape[1] < n:
        step = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        _powers = np.cumprod(np.concatenate([np.ones((2, 1), np.uint64), np.repeat(step, n, axis=1)], axis=1), axis=1, dtype=np.uint64)
    return _powers


class _Words:
    """Word places and hashes of lines of single-spaced words."""

    def __init__(self, lines: pa.Array):
        n = len(lines)
        self.data = data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), lines), b" ")[0].as_py()
        raw = np.frombuffer(data, np.uint8)
        spaces = np.flatnonzero(raw == 32)
        self.start = np.concatenate([[0], spaces + 1])
        self.end = np.append(spaces, len(raw))
        up, down = _powers_to(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * up[: len(raw)], out=total[1:])
        self.hash = (total[self.end] - total[self.start]) * down[self.start]
        self.hash ^= self.hash >> np.uint64(31)
        self.hash *= _MIX
        sizes = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        self.first = np.searchsorted(self.start, begins)  # first word of each line
        self.size = np.diff(np.append(self.first, len(self.start)))

    def slices(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Texts from a word to a word."""
        data = self.data
        return [data[a:b] for a, b in zip(self.start[first].tolist(), self.end[last].tolist())]


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` word hashes, one for each word but the last ``size - 1``."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += words[k : n + k]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _chunks(pieces: Counter, overlap: int, period: int) -> dict[tuple[bytes, int], int]:
    """(chunk, words of the closing overlap) -> frequency."""
    found: dict[tuple[bytes, int], int] = {(p, 0): f for p, f in pieces.items() if p.count(b" ") <= overlap}
    block: list[bytes] = []
    size = 0
    for p in pieces:
        if p.count(b" ") > overlap:
            block.append(p)
            size += len(p)
            if size > BLOCK_BYTES:
                _cut(block, pieces, overlap, period, found)
                block, size = [], 0
    if block:
        _cut(block, pieces, overlap, period, found)
    return found


def _cut(long: list[bytes], pieces: Counter, overlap: int, period: int, found: dict[tuple[bytes, int], int]) -> None:
    """Adds the chunks of pieces of more than ``overlap`` words."""
    w = _Words(pa.array(long, pa.binary()))
    at = np.flatnonzero(_windows(w.hash, overlap) % np.uint64(period) == 0)
    line = np.searchsorted(w.first, at, "right") - 1
    inside = (at > w.first[line]) & (at + overlap < w.first[line] + w.size[line])
    at, line = at[inside], line[inside]
    last = w.first + w.size - 1
    # chunks begin at a line's first word and at windows, and end with the next window or the line's last word
    begin = np.concatenate([w.first, at])
    order = np.argsort(begin, kind="stable")
    begin, of = begin[order], np.concatenate([np.arange(len(long)), line])[order]
    closing = np.append(of[1:] == of[:-1], False)
    end = np.where(closing, np.append(begin[1:], 0) + overlap - 1, last[of])
    freq = np.fromiter((pieces[p] for p in long), np.int64, len(long))[of]
    for text, tail, f in zip(w.slices(begin, end), np.where(closing, overlap, 0).tolist(), freq.tolist()):
        key = (text, tail)
        found[key] = found.get(key, 0) + f


#: Language, tail and chunk travel as one key, a line each: a chunk holds no line feed.  So a shuffled row is short.
_KEYED = "key binary, freq long"


def _dictionary(found: dict[str, dict[tuple[bytes, int], int]]) -> Iterator[pa.RecordBatch]:
    for lang, chunks in found.items():
        if chunks:
            front = lang.encode()
            keys = [b"%b\n%d\n%b" % (front, tail, text) for text, tail in chunks]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([*chunks.values()], pa.int64())], ["key", "freq"])


def _merged(chunks: DataFrame) -> DataFrame:
    rows = chunks.groupBy("key").agg(F.sum("freq").alias("freq")).withColumn("s", F.col("key").cast("string"))
    rows = rows.withColumn("back", F.substring_index("s", "\n", -2))
    return rows.select(
        F.expr("left(s, length(s) - length(back) - 1)").alias("lang"), F.substring_index("back", "\n", -1).cast("binary").alias("chunk"),
        F.substring_index("back", "\n", 1).cast("int").alias("tail"), "freq",
    )


def parse(docs: DataFrame, max_words: int = 5, period: int = PERIOD, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The dictionary: (lang, chunk binary, tail int: words of its closing overlap, freq long), a row for each distinct chunk."""
    overlap = max_words - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, Counter] = defaultdict(Counter)
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for c in pieces.values():
                c.pop(b"", None)
            yield from _dictionary({lang: _chunks(c, overlap, period) for lang, c in pieces.items()})
            pieces.clear()

        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = body.translate(_FORM)
                if b"  " in text:
                    text = _SPACES.sub(b" ", text)
                pieces[lang].update(text.replace(b"\n ", b"\n").replace(b" \n", b"\n").strip(b" \n").split(b"\n"))
                size += len(text)
                if size > BATCH_BYTES:
                    yield from out()
                    size = 0
        yield from out()

    small_batches(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang")
    rows = docs.select(lang, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    return _merged(rows.mapInArrow(run, _KEYED))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """(lang, chunks, tails, freqs) of a bounded number of bytes."""

    def parts(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held).combine_chunks()
        for lang in pc.unique(rows.column("lang")).to_pylist():
            of = rows.filter(pc.equal(rows.column("lang"), lang)).combine_chunks()
            yield lang, of.column("chunk").chunk(0), of.column("tail").to_numpy(), of.column("freq").to_numpy()

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(1).nbytes
        if size > BLOCK_BYTES:
            yield from parts(held)
            held, size = [], 0
    if held:
        yield from parts(held)


def _add(sums: Counter, texts: list[bytes], weights: np.ndarray) -> None:
    """Adds weights by text, exact; equal weights are counted together."""
    ones = weights == 1
    if ones.all():
        sums.update(texts)
        return
    sums.update(itertools.compress(texts, ones.tolist()))
    for i in np.flatnonzero(~ones).tolist():
        sums[texts[i]] += int(weights[i])


def _marked(lang: str, grams: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    place = _places(lang, grams, bits)
    return ((bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _places(lang: str, grams: np.ndarray, bits: int) -> np.ndarray:
    """Places of phrase hashes of a language in the bitmap."""
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    mixed = (grams ^ seed) * _MIX
    return (mixed >> np.uint64(20)) % np.uint64(bits)


def _all_words(sums: Counter, chunks: pa.Array, tails: np.ndarray, freqs: np.ndarray) -> None:
    w = _Words(chunks)
    owned = np.arange(len(w.start)) < np.repeat(w.first + w.size - tails, w.size)
    _add(sums, [*itertools.compress(w.data.split(b" "), owned.tolist())], np.repeat(freqs, w.size)[owned])


def _phrases_of(sums: Counter, lang: str, chunks: pa.Array, tails: np.ndarray, freqs: np.ndarray, k: int, bitmap: np.ndarray, bits: int) -> None:
    """Adds phrases of ``k`` words that begin before the chunks' tails and have both parts marked."""
    w = _Words(chunks)
    good = _marked(lang, _windows(w.hash, k - 1), bitmap, bits)
    if len(good) < 2:
        return
    at = np.flatnonzero(good[:-1] & good[1:])
    line = np.searchsorted(w.first, at, "right") - 1
    end = w.first[line] + w.size[line]
    kept = (at + k <= end) & (at < end - tails[line])
    at, line = at[kept], line[kept]
    if len(at):
        _add(sums, w.slices(at, at + k - 1), freqs[line])


def count_length(dictionary: DataFrame, k: int, bitmap: np.ndarray | None, bits: int) -> DataFrame:
    """(lang, phrase binary, f): counts of phrases of ``k`` words whose parts are marked in the bitmap; for ``k`` = 1 of all
    words, and of the empty phrase, which begins at every word."""
    shared = dictionary.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None  # a fixed number of bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in sums.items():
                if k == 1:
                    found[b""] = found.total()
                front = lang.encode() + b"\n"
                yield pa.RecordBatch.from_arrays([pa.array([front + p for p in found], pa.binary()), pa.array([*found.values()], pa.int64())], ["key", "f"])
            sums.clear()

        for lang, chunks, tails, freqs in _held(batches):
            if k == 1:
                _all_words(sums[lang], chunks, tails, freqs)
            else:
                _phrases_of(sums[lang], lang, chunks, tails, freqs, k, shared.value, bits)
            if sum(map(len, sums.values())) > KEPT_PHRASES:
                yield from out()
        yield from out()

    rows = dictionary.select("lang", "chunk", "tail", "freq")
    # a task's batch has summed its equal phrases, so they are dealt out at once
    counted = rows.mapInArrow(run, "key binary, f long").repartition("key").groupBy("key").agg(F.sum("f").alias("f"))
    named = counted.withColumn("s", F.col("key").cast("string")).withColumn("p", F.substring_index("s", "\n", -1))
    return named.select(F.expr("left(s, length(s) - length(p) - 1)").alias("lang"), F.col("p").cast("binary").alias("phrase"), "f")


def frequent_runs(dictionary: DataFrame, bitmap: np.ndarray, bits: int) -> DataFrame:
    """The dictionary cut down to runs of at least three words whose neighbouring pairs are marked."""
    shared = dictionary.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunks, tails, freqs in _held(batches):
            w = _Words(chunks)
            if len(w.start) < 3:
                continue
            line = np.repeat(np.arange(len(chunks)), w.size)
            good = _marked(lang, _windows(w.hash, 2), shared.value, bits) & (line[:-1] == line[1:])
            edges = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
            begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # pairs begin .. end - 1: words begin .. end
            of = line[begin]
            owned = w.first[of] + w.size[of] - tails[of]
            kept = (end - begin >= 2) & (begin < owned)
            begin, end, of, owned = begin[kept], end[kept], of[kept], owned[kept]
            found: dict[tuple[bytes, int], int] = {}
            for text, tail, f in zip(w.slices(begin, end), np.maximum(0, end + 1 - owned).tolist(), freqs[of].tolist()):
                found[text, tail] = found.get((text, tail), 0) + f
            yield from _dictionary({lang: found})

    return _merged(dictionary.select("lang", "chunk", "tail", "freq").mapInArrow(run, _KEYED))


def frequent_bitmap(frequent: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bitmap of the hashed phrases of ``frequent`` (lang, phrase binary, all of one length): at most ``bits`` / 64 rows, one
    for each number of 64 places, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            for lang in np.unique(langs):
                w = _Words(pa.array([phrases[i] for i in np.flatnonzero(langs == lang)], pa.binary()))
                whole = _windows(w.hash, int(w.size[0]))[w.first]
                yield pa.RecordBatch.from_arrays([pa.array(_places(str(lang), whole, bits).astype(np.int64))], ["place"])

    cells = (
        frequent.select("lang", "phrase").mapInArrow(run, "place long")
        .groupBy(F.shiftright("place", 6).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("marks"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("marks").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def frequent_phrases(
    docs: DataFrame, least: int = 100, max_words: int = 5, period: int = PERIOD, bits: int = BITS, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, phrase, size int, f): all phrases of 1 to ``max_words`` (two at least) words with at least ``least`` occurrences in
    their language, and the empty phrase (size 0) with the count of all words."""
    dictionary = stored(parse(docs, max_words, period, text_col, lang_col), "phrase-dictionary")
    levels, bitmap = [], None
    for k in range(1, max_words + 1):
        if k == 3:
            dictionary = stored(frequent_runs(dictionary, bitmap, bits), "phrase-runs")
        counted = count_length(dictionary, k, bitmap, bits).where((F.col("f") >= least) | (F.length("phrase") == 0))
        level = stored(counted.withColumn("size", F.when(F.length("phrase") == 0, 0).otherwise(k)), "phrases")
        levels.append(level)
        if k < max_words:
            bitmap = frequent_bitmap(level.where("size > 0"), bits)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.withColumn("phrase", F.col("phrase").cast("string"))


def _part(start: str, count: str) -> F.Column:
    return F.expr(f"array_join(slice(words, {start}, {count}), ' ')")


def collocations(
    docs: DataFrame, least: int = 100, max_words: int = 5, top: int = 2000, covered: int = 100, period: int = PERIOD, bits: int = BITS,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    A phrase inside a longer one that has at least ``covered`` hundredths of its occurrences is left out.
    """
    phrases = frequent_phrases(docs, least, max_words, period, bits, text_col, lang_col)
    parts = phrases.where("size > 0").select("lang", "phrase", "f")
    totals = phrases.where("size = 0").select("lang", F.col("f").alias("n"))
    candidates = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    cuts = candidates.select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("1", "k").alias("first"), _part("k + 1", "size - k").alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    score = F.expr("(cast(a as decimal(19,0)) * cast(1000 as decimal(4,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.max("a").alias("a"), F.max("n").alias("n")
    )

    inner = candidates.where("size > 2").select(
        "lang", "words", "size", "a", F.explode(F.expr("sequence(2, size - 1)")).alias("m")
    ).select("lang", "words", "a", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("s"))
    longest = inner.groupBy("lang", _part("s", "m").alias("phrase")).agg(F.max("a").alias("most"))
    kept = best.join(longest, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(covered) * F.col("a"))
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    rows = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    rows = rows.withColumn("_part", F.pmod(F.hash("phrase"), F.lit(PARTS)))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_at") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql() -> str:
    """The query's result in SQL over ``documents``, with exact 128-bit integers."""
    grams = " UNION ALL ".join(
        f"SELECT lang, array_to_string(w[i:i+{k - 1}], ' ') AS phrase, {k} AS size FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM p WHERE len(w) >= {k})"
        for k in range(1, 6)
    )
    return f"""
        WITH t AS (SELECT coalesce(lang, '{UNKNOWN_LANG}') AS lang,
                          unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PIECE_END}')) AS piece
                   FROM documents),
        p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '{BLANKS}'), lambda x: x <> '') AS w FROM t),
        f AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= 100),
        totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
        c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
        cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k+1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
        scored AS (SELECT cuts.lang, cuts.phrase, a, k, lf.f AS l, rf.f AS r, n, (1000::HUGEINT * a * n) // (lf.f::HUGEINT * rf.f) AS score
                   FROM cuts JOIN f lf ON lf.lang = cuts.lang AND lf.phrase = x JOIN f rf ON rf.lang = cuts.lang AND rf.phrase = y
                   JOIN totals ON totals.lang = cuts.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_ AS (SELECT lang, array_to_string(w[s:s+m-1], ' ') AS phrase, max(a) AS most
                   FROM (SELECT *, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY ALL),
        kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a)
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000"""
