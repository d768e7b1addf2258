"""Removal of strings that repeat in a corpus, by column-wise suffix sorting.

A symbol goes if a string of ``length`` symbols that covers it also starts
anywhere else.  Symbols are the bytes of a text, or its words.  Matches never cross
documents, may overlap, and are judged on the input alone.

1. Anchors.  In each window of ``length`` symbols the short grams of least
   hash are anchors.  They depend on the window's symbols only, so two equal
   windows have the same anchors at the same places.
2. Keys.  A window with an anchor in its first half shares the anchor and the
   symbols right of it with its copy, one with the anchor further on those left
   of it.  So an anchor gives two keys, each over half a window long, and only keys that
   occur twice matter.  Keys are counted by an aggregation and joined back.
3. Pieces.  The symbols around an anchor that a window could cover.  Equal pieces are
   counted, not gathered: with two of them every window in them repeats.
   Each different piece of a key is fetched once.
4. Rounds.  Pieces aligned at their anchors form a collection whose suffixes are
   sorted column by column from the right: each round inserts one symbol per piece,
   as one stable pass over the last round's order, and updates that order (the
   collection's transform is the symbol column read in it) and the common prefix of each
   neighbour from range minima of the last round's.  A piece whose common prefix with a neighbour
   reaches ``length`` has a repeated window that starts in this column.
5. A key with more different pieces than one task should sort is divided first: its range of anchor
   offsets is halved, which makes the key of each half longer and its pieces shorter, and so on.
   Pieces that have become equal are counted again, the others go to the rounds.
6. Windows found are brought back to all occurrences and merged for each document.

Between steps the state lies in tables in the shared folder, written and read in sequence.

Null text is empty (no symbols, no spans).  Repeated rows, with equal or null ids too, are
documents of their own and so repeat each other.  Other columns are ignored unless named
in ``carry``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import stored, texts

MIN_BYTES = 400
GRAM = 64
#: Words of the grams when symbols are words.
WORD_GRAM = 6
#: Different pieces of one key that are sorted together; a key with more is divided.
GROUP = 16_384
#: Pieces whose columns are sorted at once in a task.
PIECES = 24_576
#: Bytes of text whose anchors are sought at once.
CHUNK = 1 << 22

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


class Shape:
    """Lengths that follow from the length of a repeat.

    A side is a range of offsets of the anchor in a window: 1 is all of them, and 2k, 2k + 1 halve k."""

    def __init__(self, length: int, gram: int = GRAM):
        self.gram = min(gram, max(1, length // 4))
        self.length = length
        self.last = length - self.gram  # the largest offset of an anchor in a window
        self._known = {1: (0, self.last)}

    def offsets(self, side: int) -> tuple[int, int]:
        """Least and largest offset; none if the first is the larger."""
        if side not in self._known:
            lo, hi = self.offsets(side // 2)
            mid = (lo + hi) // 2
            self._known[side] = (mid + 1, hi) if side % 2 else (lo, mid)
        return self._known[side]

    def key(self, side: int) -> tuple[int, int]:
        """Symbols that a key takes left and right of the anchor's start."""
        lo, hi = self.offsets(side)
        return lo, self.length - hi

    def span(self, side: int) -> tuple[int, int]:
        """Symbols that a piece takes left and right of the anchor's start."""
        lo, hi = self.offsets(side)
        return hi, self.length - lo


class Rolling:
    """Hashes of all substrings of given length in a byte array."""

    def __init__(self) -> None:
        self.pow = self.inv = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.pow) <= len(data):
            n = max(len(data) + 1, 1 << 16)
            steps = np.full(n, _BASE, np.uint64)
            steps[0] = 1
            self.pow = np.cumprod(steps)
            steps[1:] = pow(_BASE, -1, 1 << 64)
            self.inv = np.cumprod(steps)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.pow[: len(data)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.inv[start]
        h ^= h >> np.uint64(29)
        h *= _MIX
        return h ^ (h >> np.uint64(32))


def word_places(whole: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop: runs between white space, and each character from U+3000 on by itself,
    since scripts there leave no spaces."""
    data = np.frombuffer(whole, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = _SPACE[data]
    start = ~gap
    start[1:] &= gap[:-1]
    wide = data >= 0xE3
    if wide.any():
        inner = (data & 0xC0) == 0x80
        lead = np.maximum.accumulate(np.where(inner, 0, np.arange(len(data))))
        start |= wide
        start[1:] |= wide[lead[:-1]] & ~inner[1:] & ~gap[1:]
    stop = ~gap
    stop[:-1] &= gap[1:] | start[1:]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


class Unit:
    """Texts as symbols: bytes (``length`` of them repeat) or words, whose case A-Z doesn't count."""

    def __init__(self, length: int, words: bool):
        self.shape = Shape(length, WORD_GRAM if words else GRAM)
        self.words = words
        self.type = np.uint64 if words else np.uint8
        self.rolling = Rolling()

    def symbols(self, held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of texts end to end, and each text's end."""
        if not self.words:
            return np.frombuffer(b"".join(held), np.uint8), np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))
        whole = b"\n".join(held).lower()
        starts, stops = word_places(whole)
        sums = self.rolling.sums(np.frombuffer(whole, np.uint8))
        ends = np.cumsum(np.fromiter((len(b) + 1 for b in held), np.int64, len(held)))
        return self.rolling.at(sums, starts, stops), np.searchsorted(starts, ends)


def _sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        a = op(a[: len(a) - done], a[done:])
        done *= 2
    rest = width - done
    return op(a[: len(a) - rest], a[rest:]) if rest else a


def anchors(data: np.ndarray, ends: np.ndarray, shape: Shape, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions in documents laid end to end, and the sums for further hashes."""
    sums = rolling.sums(data)
    n = len(data)
    width = shape.last + 1
    if n < shape.length:
        return np.zeros(0, np.int64), sums
    pos = np.arange(n - shape.gram + 1)
    g = (rolling.at(sums, pos, pos + shape.gram) >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    low = _sliding(g, width, np.minimum)  # of the window at each start
    starts = np.arange(len(low))
    end_of = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    low[starts + shape.length > end_of[: len(low)]] = 0
    pad = np.zeros(width - 1, np.uint32)
    high = _sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    return np.flatnonzero(high == g), sums


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Rows of a batch in runs of about CHUNK bytes."""
    rows, held, size = [], [], 0
    for k, body in enumerate(batch.column(1)):
        b = body.as_py()
        rows.append(k)
        held.append(b)
        size += len(b)
        if size >= CHUNK:
            yield rows, held
            rows, held, size = [], [], 0
    if rows:
        yield rows, held


def _occurrences(length: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = Unit(length, words)
        shape, rolling = unit.shape, unit.rolling
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks = batch.column(2).to_numpy(zero_copy_only=False)
            for rows, held in _blocks(batch):
                data, ends = unit.symbols(held)
                at, sums = anchors(data, ends, shape, rolling)
                if not len(at):
                    continue
                raw = memoryview(data).cast("B")
                wide = data.itemsize
                doc = np.searchsorted(ends, at, "right")
                first = np.concatenate([[0], ends[:-1]])[doc]
                last = ends[doc]
                for side in (2, 3):
                    kl, kr = shape.key(side)
                    sl, sr = shape.span(side)
                    ok = (at - kl >= first) & (at + kr <= last)
                    a, lo, hi = at[ok], np.maximum(first[ok], at[ok] - sl), np.minimum(last[ok], at[ok] + sr)
                    # a window must fit between the piece's ends
                    fits = hi - lo >= shape.length
                    a, lo, hi, d, f = a[fits], lo[fits], hi[fits], doc[ok][fits], first[ok][fits]
                    if not len(a):
                        continue
                    content = np.fromiter(
                        (
                            xxhash.xxh3_64_intdigest(raw[x:y], z)
                            for x, y, z in zip((lo * wide).tolist(), (hi * wide).tolist(), (a - lo).tolist())
                        ),
                        np.uint64,
                        len(a),
                    )
                    r = np.array(rows)[d]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(a), side, np.int32)),
                            pa.array(rolling.at(sums, a - kl, a + kr).view(np.int64)),
                            pa.array(content.view(np.int64)),
                            pa.array(ids[r]),
                            pa.array(marks[r]),
                            pa.array(a - f),
                        ],
                        ["side", "key", "content", "did", "mark", "pos"],
                    )

    return run


def sort_rounds(cells: np.ndarray, length: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """cells[piece, column]: symbols 1..256, or 0 beyond a piece's ends.  Columns are inserted
    from the right; gives the least and largest column below ``starts`` at which a piece has
    ``length`` symbols in common with another piece at the same column (-1: none)."""
    n, width = cells.shape
    columns = np.ascontiguousarray(cells.T)
    order, lcp = np.arange(n), np.zeros(n + 1, np.int32)
    low, high = np.full(n, -1), np.full(n, -1)
    for col in range(width - 1, -1, -1):
        sym = columns[col][order]
        move = np.argsort(sym, kind="stable")
        sym = sym[move]
        same = np.flatnonzero((sym[1:] == sym[:-1]) & (sym[1:] > 0)) + 1
        new = np.zeros(n + 1, np.int32)
        if len(same):
            cuts = np.empty(2 * len(same), np.int64)
            cuts[0::2] = move[same - 1] + 1
            cuts[1::2] = move[same] + 1
            new[same] = np.minimum.reduceat(lcp, cuts)[::2] + 1
        lcp, order = new, order[move]
        if col < starts:
            hit = order[np.maximum(lcp[:-1], lcp[1:]) >= length]
            high[hit] = np.maximum(high[hit], col)
            low[hit] = col
    return low, high


def _fetch(length: int, words: bool):
    """Documents with the places of the pieces wanted -> the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = Unit(length, words)
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for body, want in zip(batch.column(0), batch.column(1)):
                data = unit.symbols([body.as_py()])[0]
                for w in want.as_py():
                    sl, sr = unit.shape.span(w["side"])
                    left = min(sl, w["pos"])
                    piece = data[w["pos"] - left : w["pos"] + sr].tobytes()
                    out.append((w["side"], w["key"], w["content"], w["many"], left, piece))
                    size += len(piece)
                    if size > CHUNK:
                        yield _piece_batch(out)
                        out, size = [], 0
            if out:
                yield _piece_batch(out)

    return run


_PIECE = pa.schema(
    [("side", pa.int32()), ("key", pa.int64()), ("content", pa.int64()), ("many", pa.bool_()), ("left", pa.int32()), ("piece", pa.binary())]
)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE.types)], schema=_PIECE)


def _sorted_windows(length: int, words: bool):
    """Pieces sorted by (side, key) -> (side, key, content, least and largest offset of the anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = Unit(length, words)
        shape = unit.shape
        held: dict[str, list] = {c: [] for c in ("side", "key", "content", "left", "piece")}

        def solve(upto: int) -> pa.RecordBatch | None:
            side = held["side"][0]
            sl, sr = shape.span(side)
            rows = [np.frombuffer(p, unit.type) for p in held["piece"][:upto]]
            flat = np.concatenate(rows)
            # symbols as numbers from 1 in their own order
            codes = np.unique(flat, return_inverse=True)[1] + 1 if words else flat.astype(np.uint16) + 1
            cells, at = np.zeros((upto, sl + sr), np.uint32 if words else np.uint16), 0
            for i, (left, row) in enumerate(zip(held["left"][:upto], rows)):
                cells[i, sl - left : sl - left + len(row)] = codes[at : at + len(row)]
                at += len(row)
            least, _ = shape.offsets(side)
            low, high = sort_rounds(cells, shape.length, sl - least + 1)
            hit = np.flatnonzero(low >= 0)
            out = None
            if len(hit):
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(hit), side, np.int32)),
                        pa.array(np.array(held["key"][:upto], np.int64)[hit]),
                        pa.array(np.array(held["content"][:upto], np.int64)[hit]),
                        pa.array((sl - high[hit]).astype(np.int32)),
                        pa.array((sl - low[hit]).astype(np.int32)),
                    ],
                    ["side", "key", "content", "o_min", "o_max"],
                )
            for c in held.values():
                del c[:upto]
            return out

        def cut() -> int:
            """Rows of the whole groups at the front that are sorted together: one side, PIECES at most
            (a group has GROUP at most)."""
            s, k, end = held["side"], held["key"], 0
            i = 0
            while i < len(k) and s[i] == s[0]:
                j = i
                while j < len(k) and k[j] == k[i] and s[j] == s[i]:
                    j += 1
                if end and j > PIECES:
                    break
                end = i = j
            return end

        for batch in batches:
            for c in held:
                held[c] += batch.column(batch.schema.get_field_index(c)).to_pylist()
            while len(held["key"]) > PIECES + GROUP:
                out = solve(cut())
                if out is not None:
                    yield out
        while held["key"]:
            out = solve(cut())
            if out is not None:
                yield out

    return run


def _halved(length: int, words: bool):
    """Pieces -> the pieces of both halves of their side's offsets, with those offsets at which a window fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = Unit(length, words)
        shape, wide = unit.shape, np.dtype(unit.type).itemsize
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for side, key, content, left, piece in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(piece) // wide
                for half in (2 * side, 2 * side + 1):
                    lo, hi = shape.offsets(half)
                    kl, kr = shape.key(half)
                    sl, sr = shape.span(half)
                    a, b = max(0, left - sl), min(n, left + sr)
                    if lo > hi or left < kl or n - left < kr or b - a < length:
                        continue
                    part = piece[a * wide : b * wide]
                    out.append(
                        (
                            side, key, content, half,
                            _signed(xxhash.xxh3_64_intdigest(piece[(left - kl) * wide : (left + kr) * wide])),
                            _signed(xxhash.xxh3_64_intdigest(part, left - a)),
                            left - a, max(lo, left + length - n), min(hi, left), part,
                        )
                    )
                    size += len(part)
                if size > CHUNK:
                    yield _half_batch(out)
                    out, size = [], 0
            if out:
                yield _half_batch(out)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_HALF = pa.schema(
    [
        ("of_side", pa.int32()), ("of_key", pa.int64()), ("of_content", pa.int64()), ("side", pa.int32()), ("key", pa.int64()),
        ("content", pa.int64()), ("left", pa.int32()), ("o_lo", pa.int32()), ("o_hi", pa.int32()), ("piece", pa.binary()),
    ]
)
_HALF_DDL = "of_side int, of_key long, of_content long, side int, key long, content long, left int, o_lo int, o_hi int, piece binary"


def _half_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _HALF.types)], schema=_HALF)


def _cut_out(length: int, words: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = Unit(length, words).shape
        for batch in batches:
            removed, spans, kept, sizes = [], [], [], []
            for body, hits in zip(batch.column(1), batch.column(2)):
                b = body.as_py()
                sizes.append(len(b))
                gone, n = 0, 0
                if hits.is_valid and (windows := hits.as_py()):
                    starts, stops = word_places(b) if words else (None, None)
                    total = len(starts) if words else len(b)
                    runs = []
                    for w in windows:
                        lo, hi = w["o_min"], w["o_max"]
                        if hi < 0:  # all windows that fit
                            least, most = shape.offsets(w["side"])
                            lo = max(least, w["pos"] + shape.length - total)
                            hi = min(most, w["pos"])
                        runs.append((w["pos"] - hi, w["pos"] - lo + shape.length))
                    runs.sort()
                    merged = [list(runs[0])]
                    for x, y in runs[1:]:
                        if x > merged[-1][1]:
                            merged.append([x, y])
                        else:
                            merged[-1][1] = max(merged[-1][1], y)
                    if words:
                        merged = [(int(starts[x]), int(stops[y - 1])) for x, y in merged]
                    keep, end = [], 0
                    for x, y in merged:
                        keep.append(b[end:x])
                        end = y
                    keep.append(b[end:])
                    n = len(merged)
                    left = b"".join(keep)
                    gone = len(b) - len(left)
                    b = left
                removed.append(gone)
                spans.append(n)
                kept.append(b)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(kept, pa.binary()),
                    *batch.columns[3:],
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *names],
            )

    return run


_WINDOWS = "side int, key long, content long, o_min int, o_max int"


def _all_that_fit(contents: DataFrame) -> DataFrame:
    """Contents met more than once: every window in them repeats."""
    return contents.where("n > 1").select("side", "key", "content", F.lit(-1).alias("o_min"), F.lit(-1).alias("o_max"))


def _repeats_in(pieces: DataFrame, length: int, words: bool, group: int) -> DataFrame:
    """pieces(side, key, content, many, left, piece), each once -> the offsets of their repeated windows."""
    found = (
        pieces.where(~F.col("many"))
        .repartition("side", "key")
        .sortWithinPartitions("side", "key", "content")
        .select("side", "key", "content", "left", "piece")
        .mapInArrow(_sorted_windows(length, words), _WINDOWS)
    )
    large = pieces.where("many").select("side", "key", "content", "left", "piece")
    if large.isEmpty():
        return found
    halves = stored(large.mapInArrow(_halved(length, words), _HALF_DDL), "halves")
    once = stored(
        halves.groupBy("side", "key", "content").agg(F.count("*").alias("n"), F.first(F.struct("left", "piece")).alias("p")), "contents"
    )
    mixed = stored(once.groupBy("side", "key").agg(F.count("*").alias("c")).where("c > 1"), "mixed")
    rest = stored(once.join(mixed, ["side", "key"]).select("side", "key", "content", (F.col("c") > group).alias("many"), "p.*"), "pieces")
    known = _all_that_fit(once)
    deeper = _repeats_in(rest, length, words, group).join(once.where("n = 1").select("side", "key", "content"), ["side", "key", "content"], "left_semi")
    back = (
        halves.drop("piece")
        .join(stored(known.unionByName(deeper), "windows"), ["side", "key", "content"])
        .groupBy("of_side", "of_key", "of_content")
        .agg(
            F.min(F.when(F.col("o_min") < 0, F.col("o_lo")).otherwise(F.col("o_min"))).alias("o_min"),
            F.max(F.when(F.col("o_max") < 0, F.col("o_hi")).otherwise(F.col("o_max"))).alias("o_max"),
        )
        .select(F.col("of_side").alias("side"), F.col("of_key").alias("key"), F.col("of_content").alias("content"), "o_min", "o_max")
    )
    return found.unionByName(back)


def repeated_windows(source: DataFrame, length: int = MIN_BYTES, words: bool = False, group: int = GROUP) -> DataFrame:
    """source(did, mark, body) -> (did, mark, hits): for each document the anchors with repeated windows
    and the offsets of the anchor in them (-1: all that fit)."""
    found = stored(
        source.select("did", "body", "mark").mapInArrow(
            _occurrences(length, words), "side int, key long, content long, did long, mark long, pos long"
        ),
        "anchors",
    )
    # tables of their own, so that a join may split a frequent key's rows
    twice = stored(found.groupBy("side", "key").agg(F.count("*").alias("n")).where("n > 1").select("side", "key"), "keys")
    double = stored(found.join(twice, ["side", "key"]), "repeated")
    contents = stored(
        double.groupBy("side", "key", "content").agg(
            F.count("*").alias("n"), F.min(F.struct("did", "mark", "pos")).alias("at")
        ),
        "contents",
    )
    mixed = stored(contents.groupBy("side", "key").agg(F.count("*").alias("c")).where("c > 1"), "mixed")
    wanted = (
        contents.join(mixed, ["side", "key"])
        .select("side", "key", "content", (F.col("c") > group).alias("many"), "at.*")
        .groupBy("did", "mark")
        .agg(F.collect_list(F.struct("side", "key", "content", "many", "pos")).alias("want"))
    )
    pieces = stored(
        source.join(wanted, ["did", "mark"])
        .groupBy("did", "mark")
        .agg(F.any_value("body").alias("body"), F.any_value("want").alias("want"))
        .select("body", "want")
        .mapInArrow(_fetch(length, words), "side int, key long, content long, many boolean, left int, piece binary"),
        "pieces",
    )
    copies = _all_that_fit(contents)
    alone = contents.where("n = 1").select("side", "key", "content")
    partly = _repeats_in(pieces, length, words, group).join(alone, ["side", "key", "content"], "left_semi")
    return (
        double.join(copies.unionByName(partly), ["side", "key", "content"])
        .groupBy("did", "mark")
        .agg(F.collect_set(F.struct("pos", "side", "o_min", "o_max")).alias("hits"))
    )


def remove_repeats(
    docs: DataFrame, min_bytes: int = MIN_BYTES, carry: tuple[str, ...] = (), group: int = GROUP, min_words: int | None = None
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, carry...): each document without its repeated bytes;
    n_spans counts the maximal runs removed.  With ``min_words`` strings of so many words repeat instead, whatever
    their bytes, and white space around what is removed stays."""
    words = min_words is not None
    length = min_words if words else min_bytes
    base = texts(docs, *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)])
    source = base.select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), F.xxhash64("body").alias("mark"), *base.columns
    )
    hits = repeated_windows(source.select("did", "mark", "body"), length, words, group)
    names = [f"_{i}" for i in range(len(carry))]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    for n in names:
        schema += f", {n} {base.schema[n].dataType.simpleString()}"
    out = (
        source.join(hits, ["did", "mark"], "left")
        .select("doc_id", "body", "hits", *names)
        .mapInArrow(_cut_out(length, words, names), schema)
    )
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", *[F.col(n).alias(c) for n, c in zip(names, carry)])
