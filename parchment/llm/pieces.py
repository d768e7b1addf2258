"""Exact SentencePiece encoding of merge-type models by backtracking, and decoding.

A text is normalised as the model says (a mark before the text, marks for blanks) and cut where no piece of the
vocabulary can reach across, before each run of marks.  The encoding of a segment is the one sequence of pieces in which
every two neighbours, merged again from their characters, come out unchanged.  It is found from the left: an Aho-Corasick
automaton over the reversed pieces names the longest piece that starts at each place; a piece that does not fit the one
before it gives way to its next shorter prefix; a place from which nothing fits is marked in a bitfield, and since one
sequence alone leads to a place, it is never tried again.  So the work grows with the length of the segment, also where
it has no blanks.  Segments that a worker has met are kept, up to a bound.

Characters outside the vocabulary become byte pieces.  Decoding joins the pieces, reads runs of bytes as UTF-8 (a byte
that fits nowhere becomes U+FFFD) and drops the mark that encoding put before the text.

Null text counts as empty (no ids but the end, an empty text back); null ids decode to null; an id outside the vocabulary
is an error.  Repeated rows give repeated rows, null ids of documents stay null, an empty table gives an empty result,
other columns are left behind.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.common import small_batches

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Segments and pairs that a worker keeps; beyond it the store starts afresh.
KEPT = 1_500_000
#: Longest segment that is kept.
KEPT_LENGTH = 64
#: Kinds of pieces and the merge type, fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_TYPE = 2


class PieceModel:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if train.model_type != MERGE_TYPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with byte pieces and marks before words are read")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("models that rewrite characters are not read")
        if kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("pieces of the user or out of use are not read")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.names = [p.piece for p in model.pieces]
        self.size = len(self.names)
        self.number = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.end = next(i for i, p in enumerate(model.pieces) if p.type == CONTROL and p.piece == (train.eos_piece or "</s>"))
        self.bytes_at = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self._decoding(model.pieces, train.unk_surface)

        #: no piece has a mark behind another character: texts may be cut before each run of marks
        cut = not any(MARK in p.lstrip(MARK) for p in self.score)
        self.segments = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if cut else "(?s).+").findall
        #: nor does one hold a line feed and more: texts may be cut on both sides of it too
        self.by_blanks = cut and self.prefix and not any("\n" in p for p in self.score)
        self.starts = ahocorasick.Automaton()
        for p, i in self.number.items():
            self.starts.add_word(p[::-1], i)
        self.starts.make_automaton()
        self.length = {i: len(p) for p, i in self.number.items()}
        self.shorter: dict[int, int] = {}
        self.strange: dict[str, int] = {}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    # encoding

    def merges_into(self, symbols: list[str], border: int) -> bool:
        """Whether the characters merge (the best-scored neighbours first, of equals the leftmost) into the two pieces that meet
        at the border, or into one piece where the border is 0; a merge across it ends the search."""
        score, none = self.score.get, -math.inf
        scores = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            k = scores.index(best)
            if k == border - 1:
                return False
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            border -= k < border
            del scores[k]
            if k:
                scores[k - 1] = score(symbols[k - 1] + symbols[k], none)
            if k < len(scores):
                scores[k] = score(symbols[k] + symbols[k + 1], none)
        return len(symbols) == 1 + (border > 0) and border <= 1

    def symbol(self, c: str) -> int:
        """Number of a single character, in or outside the vocabulary."""
        found = self.number.get(c)
        if found is None:
            found = self.strange.get(c)
            if found is None:
                found = self.strange[c] = len(self.names)
                self.names.append(c)
                self.length[found] = 1
        return found

    def next_shorter(self, t: int) -> int:
        """The longest piece that begins piece t and is shorter (-1: none)."""
        found = self.shorter.get(t)
        if found is None:
            name, found = self.names[t], -1
            for n in range(len(name) - 1, 0, -1):
                found = self.number.get(name[:n], -1) if n > 1 else self.symbol(name[0])
                if found >= 0:
                    break
            self.shorter[t] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the characters of two pieces merge into these again, kept; ``a`` is the first one's number and 1, shifted by
        32 bits, or 0: whether those of b alone merge into b."""
        if len(self.fits) > KEPT:
            self.fits.clear()
        first = self.names[(a >> 32) - 1] if a else ""
        found = self.fits[a | b] = self.merges_into([*first, *self.names[b]], len(first))
        return found

    def encode_segment(self, text: str) -> list[int]:
        """Pieces of a segment; characters outside the vocabulary have numbers beyond it."""
        n = len(text)
        # by the places from the end at which they start; of one place the longest comes first and so is written last
        longest = dict([*self.starts.iter(text[::-1])][::-1])
        fits, length, shorter, failed = self.fits, self.length, self.shorter, bytearray((n >> 3) + 1)
        out: list[int] = []
        pos, before = 0, 0
        t = longest.get(n - 1)
        if t is None:
            t = self.symbol(text[0])
        while True:
            end = pos + length[t]
            if not failed[end >> 3] >> (end & 7) & 1:
                ok = fits.get(before | t)
                if ok is None:
                    ok = self.compatible(before, t)
                if ok:
                    out.append(t)
                    if end == n:
                        return out
                    pos, before = end, t + 1 << 32
                    t = longest.get(n - 1 - end)
                    if t is None:
                        t = self.symbol(text[end])
                    continue
            t = shorter[t] if t in shorter else self.next_shorter(t)
            while t < 0:
                failed[pos >> 3] |= 1 << (pos & 7)
                last = out.pop()
                pos -= length[last]
                before = out[-1] + 1 << 32 if out else 0
                t = self.next_shorter(last)

    def _packed(self, segment: str) -> bytes:
        ids = self.encode_segment(segment)
        if max(ids) >= self.size:
            ids = [i for t in ids for i in ([t] if t < self.size else [self.bytes_at[b] for b in self.names[t].encode()])]
        return array("i", ids).tobytes()

    def _learn(self, key: str, segment: str) -> bytes:
        """Ids of a segment, as bytes, kept by its key."""
        found = self._packed(segment)
        if len(key) <= KEPT_LENGTH:
            if len(self.known) > KEPT:
                self.known.clear()
            self.known[key] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, without begin or end."""
        if not text:
            return np.zeros(0, np.int32)
        if self.by_blanks and text[0] != " " and "  " not in text and MARK not in text:
            # a segment is a mark and a word, or a line feed and what follows without a mark
            keys = text.replace("\n", " \n").split(" ")
            packed = [*map(self.known.get, keys)]
            if None in packed:
                for i, found in enumerate(packed):
                    if found is None:
                        k = keys[i]
                        packed[i] = self.known.get(k) or self._learn(k, k if k[:1] == "\n" else MARK + k)
        else:
            segments = self.segments(self.prefix + text.replace(" ", MARK))
            packed = [self.known.get(MARK + s) or self._learn(MARK + s, s) for s in segments]
        return np.frombuffer(b"".join(packed), np.int32)

    # decoding

    def _decoding(self, pieces, unknown: str) -> None:
        self.kind = [p.type for p in pieces]
        self.silent = {i for i, k in enumerate(self.kind) if k == CONTROL}
        shown = {NORMAL: lambda p: p.replace(MARK, " ").encode(), UNKNOWN: lambda p: unknown.encode(), CONTROL: lambda p: b""}
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else shown[p.type](p.piece) for p in pieces]

    def decode(self, ids: list[int]) -> str:
        if ids and not 0 <= min(ids) <= max(ids) < self.size:
            raise ValueError("an id lies outside the vocabulary")
        # pieces that show nothing end a run of bytes; those before the first shown piece are passed over, then one mark goes
        runs, kind = [[]], self.kind
        if {*ids}.isdisjoint(self.silent):
            runs = [ids]
        else:
            for i in ids:
                if kind[i] == CONTROL:
                    runs.append([])
                else:
                    runs[-1].append(i)
            runs = [x for x in runs if x] or [[]]
        out = [_read(b"".join(map(self.surface.__getitem__, x))) for x in runs]
        if self.prefix and runs[0] and kind[runs[0][0]] == NORMAL and out[0][:1] == " ":
            out[0] = out[0][1:]
        return "".join(out)


def _read(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return _lenient(raw)


def _lenient(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that fits nowhere."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(out)


_models: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]), pa.int32()))


def encode(
    docs: DataFrame, path: str, add_end: bool = True, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids array<int>[, decoded]): each whole text's ids, with the end id if asked, and what they decode to if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        tail = np.array([model.end] * add_end, np.int32)
        for batch in batches:
            ids = [np.concatenate([model.encode(t.as_py()), tail]) for t in batch.column(1)]
            cols = [batch.column(0), _lists(ids)]
            if decoded:
                cols.append(pa.array([model.decode(x.tolist()) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][: len(cols)])

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")
    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``: the text of the ids."""
    names = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            lists = batch.column(names.index(ids_col))
            ids, ends = lists.values.to_pylist(), lists.offsets.to_pylist()
            missing = lists.is_null().to_pylist()
            texts = [None if none else model.decode(ids[a:b]) for none, a, b in zip(missing, ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    small_batches(encoded.sparkSession)
    kept = encoded.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])
    return kept.mapInArrow(run, schema)
