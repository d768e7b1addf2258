"""Exact token counts at every prefix of a text, by dynamic programming.

For byte-pair encoding the tokens of a prefix are those of a shorter prefix and
one token more, and the right last token is the only one whose pairing with
the token before it would come out of the merges unchanged.  So one pass over a piece gives
the count at each of its prefixes: ``plain[j]`` for the first j symbols inside a
longer piece, ``whole[j]`` where the text stops there and the last symbol bears
the word-end mark.  Words are cut at white space, where encodings are independent, and a worker
keeps the words that it has met.

A word is normalised and cut into pieces code point by code point: letters, single numbers, other signs and contractions.
What an ending there would change is taken into account: half a contraction is a sign and a letter, letters that
compose with marks to come stand alone until those come, and a special string is text until its last sign.  Classes and
normal forms of code points are asked from the tokenizer library, once each; it encodes nothing.

The result is a step per code point: the running sum of the steps is the exact count at
that prefix, so truncation and budget questions need no further encoding.

Null text counts as empty: no bytes, no tokens.  Repeated rows give repeated rows;
a null id stays null.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.common import small_batches

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker keeps; beyond it the store starts afresh.
KEPT_WORDS = 1_200_000
#: Longest piece that is kept.
KEPT_LENGTH = 63
#: Pieces of words whose letters are Latin, signs printable and classes beyond doubt.
_LATIN_PIECES = regex.compile(r"\p{L}+|\p{N}|[^\p{L}\p{N}]+")
_SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
#: Fixed by the vocabulary: what may follow an apostrophe that begins a piece.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, SIGN, SPACE = range(4)


@cache
def _seconds() -> frozenset[str]:
    """Letters of combining class 0 that may compose with what stands before them."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # parts of Hangul syllables
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def _joins(c: str) -> bool:
    """Whether a code point may change the normal form of those before it."""
    return c > "\u02ff" and (unicodedata.combining(c) != 0 or c in _seconds())


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PrefixCounter:
    """Steps of words for one vocabulary file of the byte-pair kind with word ends."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.mark = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        vocab = model["vocab"]
        n = len(self.mark)
        self.names = {i: t for t, i in vocab.items()}
        inner = {t: i for t, i in vocab.items() if not t.endswith(self.mark)}
        final = {t[:-n]: i for t, i in vocab.items() if t.endswith(self.mark)}
        #: letters from a token's end to its start -> ... -> "": numbers of the token inside a word and at its end (-1: none)
        self.ends: dict = {}
        for t in {*inner, *final}:
            node = self.ends
            for c in reversed(t):
                node = node.setdefault(c, {})
            node[""] = (inner.get(t, -1), final.get(t, -1))
        self.letters = _byte_letters()
        self.special = [t["content"] for t in json.loads(self.library.to_str())["added_tokens"]]
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {"": b""}
        self.wide: dict[str, np.ndarray] = {}
        self.pieces: dict[str, bytes | list[int]] = {}
        self.kinds: dict[str, int] = {}
        self.forms: dict[str, str] = {}

    def _merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            a, b = symbols[k := ranks.index(best)], symbols[k + 1]
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and symbols[i] == a and symbols[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.mark):
            bare = token[: -len(self.mark)]
            return [*bare[:-1], bare[-1] + self.mark]
        return [*token]

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of a and b together is a, b."""
        found = self.fits.get(a << 32 | b)
        if found is None:
            if len(self.fits) > KEPT_WORDS // 2:
                self.fits.clear()
            x, y = self.names[a], self.names[b]
            found = self.fits[a << 32 | b] = self._merged(self._symbols(x) + self._symbols(y)) == [x, y]
        return found

    def extend(self, s: str | list[str], last: list[int], plain: list[int], whole: list[int]) -> None:
        """Carry the tables on to the end of s."""
        fits, ends = self.fits.get, self.ends
        for j in range(len(last), len(s) + 1):
            # what is still sought: the end of the whole prefix and of the plain one.  Just one token fits each,
            # so spans may be tried in any order: from the shortest, while tokens end like this
            open_, before = True, True
            token = count = ended = 0
            node, k = ends, j
            while k:
                k -= 1
                node = node.get(s[k])
                if node is None:
                    break
                pair = node.get("")
                if pair is None:
                    continue
                t, e = pair
                if k == 0:
                    if before and t >= 0:
                        token, count = t, 1
                    if open_ and e >= 0:
                        ended = 1
                else:
                    a = last[k] << 32
                    if before and t >= 0:
                        ok = fits(a | t)
                        if self.follows(last[k], t) if ok is None else ok:
                            token, count, before = t, plain[k] + 1, False
                    if open_ and e >= 0:
                        ok = fits(a | e)
                        if self.follows(last[k], e) if ok is None else ok:
                            ended, open_ = plain[k] + 1, False
                    if not (open_ or before):
                        break
            last.append(token)
            plain.append(count)
            whole.append(ended)

    def ended(self, piece: str) -> bytes | list[int]:
        """Token counts of the piece's prefixes, by code point, each as a whole piece."""
        found = self.pieces.get(piece)
        if found is not None:
            return found
        s = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
        whole = [0]
        self.extend(s, [-1], [0], whole)
        if s is piece:
            out = whole[1:]
        else:
            out, at = [], 0
            for c in piece:
                at += len(c.encode())
                out.append(whole[at])
        if len(piece) <= KEPT_LENGTH:
            if len(self.pieces) > KEPT_WORDS // 2:
                self.pieces.clear()
            self.pieces[piece] = bytes(out)
        return out

    def kind(self, c: str) -> int:
        """Class of a code point in normal form."""
        found = self.kinds.get(c)
        if found is None:
            cut = self.library.pre_tokenizer.pre_tokenize_str
            if c == " " or not cut(c):
                found = SPACE
            elif len(cut("a" + c)) == 1:
                found = LETTER
            else:
                found = SIGN if len(cut("!" + c)) == 1 else NUMBER
            self.kinds[c] = found
        return found

    def form(self, text: str) -> str:
        """Normal form; kept for single code points."""
        if len(text) > 1:
            return self.library.normalizer.normalize_str(text)
        found = self.forms.get(text)
        if found is None:
            found = self.forms[text] = self.library.normalizer.normalize_str(text)
        return found

    def plain_counts(self, word: str) -> list[int] | None:
        """Of words without apostrophes whose code points have normal forms of one code point each; else None."""
        if word.isprintable() and (word.isascii() or max(word) < "\u0250"):
            low = word.lower()
            if len(low) == len(word):
                if low.isalpha():
                    return self.ended(low)
                out, base = [], 0
                for piece in _LATIN_PIECES.findall(low):
                    own = self.ended(piece)
                    out += [base + x for x in own] if base else own
                    base += own[-1]
                return out
        low = "".join(map(self.form, word))
        if len(low) != len(word) or not unicodedata.is_normalized("NFC", word):
            return None
        kinds = list(map(self.kind, low))
        out, base, start, n = [], 0, 0, len(low)
        while start < n:
            k, end = kinds[start], start + 1
            while end < n and kinds[end] == k and k != NUMBER:
                end += 1
            if k == SPACE:
                out += [base] * (end - start)
            else:
                own = self.ended(low[start:end])
                out += [base + x for x in own] if base else own
                base += own[-1]
            start = end
        return out

    def counts(self, word: str) -> list[int]:
        """Token counts of a word's prefixes, by code point."""
        if "<|" in word:
            places = [(k, s) for s in self.special if (k := word.find(s)) >= 0]
            if places:
                k, special = min(places)
                out = [*self.counts(word[: k + len(special) - 1])]
                out.append((out[k - 1] if k else 0) + 1)
                return out + [out[-1] + x for x in self.counts(word[k + len(special) :])]
        if "'" not in word:
            found = self.plain_counts(word)
            if found is not None:
                return found
        return _Scan(self).counts(word)

    def steps(self, word: str) -> bytes:
        """The change of the count at each code point, as signed bytes; wider ones are kept apart."""
        before, out = 0, []
        for c in self.counts(word):
            out.append(c - before)
            before = c
        if max(out) > 127 or min(out) < -127:
            self.wide[word] = np.array(out, np.int64)
        return bytes([x & 255 for x in out])

    def text_steps(self, text: str) -> np.ndarray:
        """A signed step per code point."""
        words = text.translate(_SPACES).split(" ")
        known = self.words
        if len(known) > KEPT_WORDS:
            known.clear()
            self.wide.clear()
            known[""] = b""
        different = {*words}
        for w in different:
            if w not in known:
                known[w] = self.steps(w)
        out = np.frombuffer(b"\0".join(map(known.__getitem__, words)), np.int8)
        if self.wide and not different.isdisjoint(self.wide):
            out, at = out.astype(np.int64), 0
            for w in words:
                if w in self.wide:
                    out[at : at + len(w)] = self.wide[w]
                at += len(w) + 1
        return out


class _Scan:
    """One word, code point by code point."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter
        self.base = 0  # tokens of the pieces that are closed
        self.open: tuple[int, list[str], list[int], list[int], list[int]] | None = None  # kind, letters and tables of the last piece
        self.half = ""  # what an open contraction has after the apostrophe
        self.outside = 0  # base before it

    def close(self) -> None:
        if self.open:
            self.base += self.open[4][-1]
            self.open = None

    def push(self, c: str) -> None:
        counter = self.counter
        kind = counter.kind(c)
        if self.half is not None and (more := self.half + c) and self.may_contract(more):
            if more in CONTRACTIONS:
                self.base, self.open, self.half = self.outside + counter.ended("'" + more)[-1], None, ""
                return
            half = more
        else:
            half = ""
        if self.open is None or self.open[0] != kind or kind == NUMBER:
            self.close()
            if kind == SPACE:
                self.half = half
                return
            self.outside = self.base if c == "'" else self.outside
            self.open = (kind, [], [-1], [0], [0])
        _, letters, last, plain, whole = self.open
        letters += [c] if "!" <= c <= "~" else [counter.letters[b] for b in c.encode()]
        counter.extend(letters, last, plain, whole)
        self.half = half

    def may_contract(self, more: str) -> bool:
        """Whether an apostrophe that began a piece may go on like this."""
        if len(more) == 1 and not (self.open and self.open[1] == ["'"]):
            return False
        return any(x.startswith(more) for x in CONTRACTIONS)

    def tokens(self) -> int:
        return self.base + (self.open[4][-1] if self.open else 0)

    def tried(self, tail: str) -> int:
        """The count with a tail that may yet change."""
        was, n = (self.base, self.open, self.half, self.outside), len(self.open[1]) if self.open else 0
        for c in tail:
            self.push(c)
        found = self.tokens()
        self.base, self.open, self.half, self.outside = was
        if self.open:
            del self.open[1][n:]
            for t in self.open[2:]:
                del t[n + 1 :]
        return found

    def counts(self, word: str) -> list[int]:
        out, start, n = [], 0, len(word)
        while start < n:
            end = start + 1
            while end < n and _joins(word[end]):
                out.append(self.tried(self.counter.form(word[start:end])))
                end += 1
            for c in self.counter.form(word[start:end]):
                self.push(c)
            out.append(self.tokens())
            start = end
        return out


def pack_steps(steps: np.ndarray) -> bytes:
    """Steps as one byte for their width (1, 2, 4 or 8) and the numbers, in the least width that holds them all."""
    most = int(np.abs(steps.astype(np.int64)).max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def unpack_steps(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<i{packed[0]}", offset=1)


def prefix_counts(
    docs: DataFrame, path: str, keep_steps: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens[, steps binary]): ``steps`` holds a signed number per code point (see ``pack_steps``)
    whose running sum is the exact token count of that prefix of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            sizes, tokens, steps = [], [], []
            for text in batch.column(1):
                t = text.as_py()
                s = counter.text_steps(t)
                sizes.append(len(t.encode()))
                tokens.append(int(s.sum(dtype=np.int64)))
                if keep_steps:
                    steps.append(pack_steps(s))
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens"]
            if keep_steps:
                cols.append(pa.array(steps, pa.binary()))
                names.append("steps")
            yield pa.RecordBatch.from_arrays(cols, names)

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")
    schema = "doc_id long, n_bytes long, n_tokens long" + ", steps binary" * keep_steps
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(run, schema)


_counters: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


@F.pandas_udf(T.LongType())
def tokens_at(steps, chars):
    """Exact tokens of the first ``chars`` code points."""
    import pandas as pd

    return pd.Series([int(unpack_steps(s)[: max(0, int(n))].sum(dtype=np.int64)) for s, n in zip(steps, chars)])


@F.pandas_udf(T.LongType())
def chars_within(steps, budget):
    """Code points of the longest prefix with at most ``budget`` tokens."""
    import pandas as pd

    def longest(s: bytes, most: int) -> int:
        ok = np.flatnonzero(np.cumsum(unpack_steps(s), dtype=np.int64) <= most)
        return int(ok[-1]) + 1 if len(ok) else 0

    return pd.Series([longest(s, int(b)) for s, b in zip(steps, budget)])


def truncated(docs: DataFrame, counts: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents (one row per id) cut to the longest prefix of at most ``budget`` tokens, from stored steps."""
    cut: Column = chars_within("steps", F.lit(budget)).alias("_chars")
    return (
        docs.join(counts.select(F.col("doc_id").alias("_id"), cut), F.col(id_col) == F.col("_id"))
        .withColumn(text_col, F.substring(F.col(text_col), F.lit(1), F.col("_chars").cast("int")))
        .drop("_id", "_chars")
    )
