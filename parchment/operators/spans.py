"""One token stream for all value readers.

A text is cut once into tokens; a longer reading takes its place as one token before a shorter one is tried (dates, then
percentages, then numbers in figures or words with a figure in parentheses, then words and signs).  So a date is no number
and a percentage no amount, and a reader only looks at its neighbours.  The readers of a pass share the tokens; texts are
neither shuffled nor joined.  Letters are folded for comparison only; what is reported is the text as it stands.

Null and empty texts give no readings; equal rows give equal readings; other columns are left behind.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.functions.text import DIACRITICS, DIGITS_FROM, DIGITS_TO, FOLD_FROM, FOLD_TO, TATWEEL

# English and Arabic number words, folded; a letter "and" may be joined to the front of the Arabic ones.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30,
    "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
ARABIC_NUMBERS = {
    "واحد": 1, "واحده": 1, "اثنان": 2, "اثنين": 2, "ثلاثه": 3, "ثلاث": 3, "اربعه": 4, "اربع": 4, "خمسه": 5, "خمس": 5, "سته": 6, "ست": 6, "سبعه": 7, "سبع": 7,
    "ثمانيه": 8, "ثماني": 8, "تسعه": 9, "تسع": 9, "عشره": 10, "عشر": 10, "عشرون": 20, "عشرين": 20, "ثلاثون": 30, "ثلاثين": 30, "اربعون": 40, "اربعين": 40,
    "خمسون": 50, "خمسين": 50, "ستون": 60, "ستين": 60, "سبعون": 70, "سبعين": 70, "ثمانون": 80, "ثمانين": 80, "تسعون": 90, "تسعين": 90,
    "مايه": 100, "ميه": 100, "مايتان": 200, "مايتين": 200,
}
# Units of time, with forms that stand for two, folded.
TIME_UNITS = {
    "day": ("day", "days", "يوم", "يوما", "ايام"), "week": ("week", "weeks", "اسبوع", "اسبوعا", "اسابيع"),
    "month": ("month", "months", "شهر", "شهرا", "اشهر", "شهور"), "year": ("year", "years", "سنه", "سنوات", "سنين", "عام", "عاما", "اعوام"),
}
DUALS = {"day": ("يومان", "يومين"), "week": ("اسبوعان", "اسبوعين"), "month": ("شهران", "شهرين"), "year": ("سنتان", "سنتين", "عامان", "عامين")}
HOUR_UNITS = ("hour", "hours", "hr", "hrs", "ساعه", "ساعات")
QUALIFIERS = ("working", "business", "calendar")
EACH = ("per", "a", "an", "each", "every", "كل")
RANGE_WORDS = ("to", "or", "and", "-", "–", "الي", "او", "حتي")
# How currencies are written beside an amount, folded.
CURRENCIES = {
    "SAR": ("sar", "sr", "riyal", "riyals", "ريال", "ريالا", "ريالات"), "USD": ("usd", "$", "dollar", "dollars", "دولار"), "EUR": ("eur", "€", "euro", "euros", "يورو"),
    "GBP": ("gbp", "£"), "AED": ("aed", "درهم"), "EGP": ("egp", "جنيه"),
}
# Months, folded.
MONTHS = (
    ("january", "jan", "يناير"), ("february", "feb", "فبراير"), ("march", "mar", "مارس"), ("april", "apr", "ابريل"), ("may", "مايو"),
    ("june", "jun", "يونيو", "يونيه"), ("july", "jul", "يوليو", "يوليه"), ("august", "aug", "اغسطس"), ("september", "sept", "sep", "سبتمبر"),
    ("october", "oct", "اكتوبر"), ("november", "nov", "نوفمبر"), ("december", "dec", "ديسمبر"),
)
DAY_MARKS, WEEK_MARKS = ("daily", "يوميا", "يومي", "اليوم"), ("weekly", "اسبوعيا", "اسبوعي", "الاسبوع")

#: Spellings that fold to a letter.
_SPELT = {to: to + "".join(f for f, t in zip(FOLD_FROM, FOLD_TO) if t == to) for to in set(FOLD_TO)}


def _spelt(word: str) -> str:
    """A pattern for a folded word in any spelling, marks between its letters."""
    if word.isascii():
        return word
    return "".join((f"[{_SPELT[c]}]" if c in _SPELT else c) + r"\p{M}*" for c in word)


def _any(words) -> str:
    return "|".join(_spelt(w) for w in sorted(words, key=len, reverse=True))


NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
_EDGE, _NO_EDGE = r"(?![\p{L}\p{M}])", r"(?<![\p{L}\p{M}])"
_ENGLISH = rf"{_NO_EDGE}(?:{_any([*NUMBER_WORDS, 'hundred'])}){_EDGE}"
_ARABIC = rf"{_NO_EDGE}و?(?:{_any(ARABIC_NUMBERS)}){_EDGE}"
_FIGURE = rf"(?:\s*\(\s*(?:{NUMBER})\s*\))?"
_IN_WORDS = rf"(?:{_ENGLISH}(?:[\s-]+(?:and\s+)?{_ENGLISH})*|{_ARABIC}(?:\s+{_ARABIC})*)"
_MONTH = f"(?:{_any(m for names in MONTHS for m in names)})"
_NTH = r"\d{1,2}(?:st|nd|rd|th)?"
_HIJRI = r"(?:\s*(?:هـ|ه(?!\p{L})|(?:h|ah)(?![\p{L}\d])))?"
DATE = (
    rf"(?<![\d/.-])(?:\d{{4}}[/.-]\d{{1,2}}[/.-]\d{{1,2}}|\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{4}})(?!\d){_HIJRI}"
    rf"|(?<!\d){_NTH}\s+(?:of\s+)?{_MONTH}{_EDGE},?\s+\d{{4}}(?!\d)|{_NO_EDGE}{_MONTH}\s+{_NTH},?\s+\d{{4}}(?!\d)"
)
PERCENT = rf"(?:{NUMBER})\s*(?:%|percent{_EDGE}|(?:في\s+|ب)الم[اأ]?[ئيى]\p{{M}}*[ةه])"
LEXER = regex.compile(
    rf"(?i)(?P<date>{DATE})|(?P<percent>{PERCENT})|(?P<number>(?:{_IN_WORDS}|{NUMBER}){_FIGURE})|(?P<other>[\p{{L}}\p{{M}}{TATWEEL}]+|[%()\-–/:+$€£])"
)
_NUMBER = regex.compile(NUMBER)
_WORD_VALUES = {**NUMBER_WORDS, **ARABIC_NUMBERS}
_DIGITS = str.maketrans(DIGITS_FROM, DIGITS_TO)
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO, DIACRITICS + TATWEEL)


def _named(table: dict) -> dict[str, str]:
    return {n: k for k, names in table.items() for n in names}


_UNIT_OF, _DUAL_OF, _CODE_OF = _named(TIME_UNITS), _named(DUALS), _named(CURRENCIES)
_MONTH_OF = {n: k for k, names in enumerate(MONTHS, 1) for n in names}



class Token(NamedTuple):
    kind: str
    key: str
    text: str
    start: int
    end: int


_NONE = Token("", "", "", 0, 0)


class Tokens(list):
    """Tokens of a text; places outside it hold an empty token."""

    def at(self, i: int) -> Token:
        return self[i] if 0 <= i < len(self) else _NONE

    def is_number(self, i: int) -> bool:
        return self.at(i).kind == "number"

    def follows_range(self, i: int) -> bool:
        """Whether the number at ``i`` ends a range or an alternative of numbers."""
        return self.at(i - 1).key in RANGE_WORDS and self.is_number(i - 2)


def tokens(text: str) -> Tokens:
    """Tokens of a text; a token keeps the text as it stands, its key is folded."""
    plain = text.translate(_DIGITS)
    return Tokens(Token(m.lastgroup, m.group().lower().translate(_FOLD), text[m.start() : m.end()], m.start(), m.end()) for m in LEXER.finditer(plain))


def number(token: Token) -> tuple[float | None, str | None]:
    """(value, note) of a number token: what figures and words say alike, or a note."""
    figures = [float(x.replace(",", "")) for x in _NUMBER.findall(token.key)]
    total, worded = 0, False
    for w in regex.findall(r"[^\W\d_]+", token.key):
        if w == "hundred":
            total, worded = max(total, 1) * 100, True
        elif w != "and":
            total, worded = total + _WORD_VALUES.get(w, _WORD_VALUES.get(w[1:], 0)), True
    found = {*figures, *([float(total)] if worded else [])}
    return (found.pop(), None) if len(found) == 1 else (None, "conflicting numbers")


def _unit(key: str, table: dict[str, str]) -> str | None:
    """Unit of a word, also with a letter or an article joined to its front."""
    return table.get(key) or table.get(regex.sub("^(?:ال|[وفبلك])", "", key))


#: A reading: first and last token, and values by column.
Reading = tuple[int, int, dict]


def _durations(t: Tokens, bare_singular: bool) -> Iterator[Reading]:
    for i, token in enumerate(t):
        one, two = _unit(token.key, _UNIT_OF), _unit(token.key, _DUAL_OF)
        before, after = t.at(i - 1), t.at(i + 1)
        if token.kind != "other" or not (one or two) or before.key in EACH:
            continue
        qualifier = before.key if before.key in QUALIFIERS else None
        at = i - 2 if qualifier else i - 1
        first, last, note = i, i, None
        if after.key == "عمل":
            qualifier, last = "working", i + 1
        if t.is_number(at):
            first = at
            count, note = number(t[at])
            if t.follows_range(at):
                first, count, note = at - 2, None, "range"
        elif two:
            count = 2.0
        elif after.kind == "number" and number(after)[0] == 1:
            count, last = 1.0, i + 1
        elif bare_singular and token.key in ("day", "week", "month", "year", "يوم", "اسبوع", "شهر", "سنه", "عام"):
            count, note = 1.0, "no number written"
        else:
            continue
        yield first, last, {"value": count, "unit": two or one, "qualifier": qualifier, "note": note}


def _hours(t: Tokens) -> Iterator[Reading]:
    for i, token in enumerate(t):
        if token.key not in HOUR_UNITS or not t.is_number(i - 1):
            continue
        first, last, per = i - 1, i, None
        count, note = number(t[i - 1])
        if t.follows_range(i - 1):
            first, count, note = i - 3, None, "range"
        for k in range(i + 1, i + 4):
            word, led = t.at(k).key, t.at(k - 1).key in EACH or t.at(k - 1).key == "في"
            if word in DAY_MARKS or word == "day" and led:
                per, last = "day", k
            elif word in WEEK_MARKS or word == "week" and led:
                per, last = "week", k
            if per:
                break
        yield first, last, {"value": count, "unit": per, "note": note}


def _day_counts(t: Tokens) -> Iterator[Reading]:
    for i, token in enumerate(t):
        last = next((k for k in range(i + 1, i + 4) if t.at(k).key in ("week", *WEEK_MARKS)), None)
        at = i - 2 if t.at(i - 1).key in QUALIFIERS else i - 1
        if last and token.kind == "other" and _unit(token.key, _UNIT_OF) == "day" and t.is_number(at):
            count, note = number(t[at])
            yield at, last, {"value": count, "note": note}


def _currency(t: Tokens, i: int) -> tuple[str, int, int] | None:
    """The nearest currency within two tokens: code, first and last token."""
    for k in (i - 1, i + 1, i - 2, i + 2):
        if t.at(k).key == "ر" and t.at(k + 1).key == "س":
            return "SAR", k, k + 1
        if code := _CODE_OF.get(t.at(k).key):
            return code, k, k
    return None


def _money(t: Tokens, require_currency: bool) -> Iterator[Reading]:
    keys = [x.key for x in t]
    monthly, annual = any(k.startswith("month") or "شهر" in k for k in keys), any(k.startswith(("annu", "year")) or "سنو" in k for k in keys)
    period = "monthly" if monthly and not annual else "annual" if annual and not monthly else None
    for i, token in enumerate(t):
        if token.kind != "number" or not token.key[0].isdigit():
            continue
        if "/" in (t.at(i + 1).key, t.at(i - 1).key) or t.at(i + 1).key in ("-", "–") and t.is_number(i + 2):
            continue
        found = _currency(t, i)
        if found or not require_currency:
            code, begin, end = found or (None, i, i)
            yield min(i, begin), max(i, end), {"value": number(token)[0], "currency": code, "period": period}


def _percentages(t: Tokens, text: str) -> Iterator[Reading]:
    for i, token in enumerate(t):
        if token.kind == "percent":
            basis = text[token.end :].strip(" .") or None
            yield i, i, {"value": float(_NUMBER.match(token.key).group().replace(",", "")), "basis": basis}


def _date(token: Token) -> dict:
    """iso_date, calendar and note of a date token."""
    n = [int(x) for x in regex.findall(r"\d+", token.key)]
    named = next((_MONTH_OF[w] for w in regex.findall(r"\p{L}+", token.key) if w in _MONTH_OF), None)
    note = None
    if named:
        year, month, day = n[1], named, n[0]
    elif regex.match(r"\d{4}", token.key):
        year, month, day = n
    else:
        day, month, year = n
        if month > 12 >= day:
            day, month, note = month, day, "read as month/day/year"
        elif day <= 12 and month <= 12 and day != month:
            note = "order unclear"
    if not named and (regex.search(r"\d\s*(?:h|ah|ه)$", token.key) or 1300 <= year <= 1500):
        return {"calendar": "hijri"}
    try:
        iso = None if note == "order unclear" else dt.date(year, month, day)
    except ValueError:
        iso = None
    return {"iso_date": iso, "calendar": "gregorian", "note": note}


def _dates(t: Tokens, text: str) -> Iterator[Reading]:
    found = [(i, _date(x)) for i, x in enumerate(t) if x.kind == "date"]
    k = 0
    while k < len(found):
        i, one = found[k]
        k += 1
        if k < len(found):
            j, two = found[k]
            between = text[t[i].end : t[j].start].replace("(", "", 1).strip()
            if not between and one["calendar"] != two["calendar"]:  # one event in two calendars
                k += 1
                lunar = i if one["calendar"] == "hijri" else j
                yield i, j, {**(two if lunar == i else one), "paired": t[lunar].text}
                continue
        yield i, i, one


READERS: dict[str, Callable[[Tokens, str, dict], Iterator[Reading]]] = {
    "duration": lambda t, text, asked: _durations(t, asked.get("bare_singular", False)),
    "hours": lambda t, text, asked: _hours(t),
    "day_count": lambda t, text, asked: _day_counts(t),
    "money": lambda t, text, asked: _money(t, asked.get("require_currency", True)),
    "percentage": lambda t, text, asked: _percentages(t, text),
    "date": lambda t, text, asked: _dates(t, text),
}
_VALUES = "kind string, no int, raw string, value double, unit string, qualifier string, currency string, period string, basis string, iso_date date, calendar string, paired string, note string"
_TYPES = {"no": pa.int32(), "value": pa.float64(), "iso_date": pa.date32()}


#: Texts, and characters of them, whose readings a task keeps at a time; it starts anew beyond either.
KEPT_TEXTS, KEPT_CHARS = 50_000, 8_000_000
NAMES = [f.split()[0] for f in _VALUES.split(", ")]


class _Readings:
    """Readings of texts as rows of ``NAMES``; equal texts, such as the standard lines of forms, are read once."""

    def __init__(self, kinds: tuple[str, ...], asked: dict):
        self.kinds, self.asked, self.kept, self.chars = kinds, asked, {}, 0

    def of(self, text: str) -> list[tuple]:
        rows = self.kept.get(text)
        if rows is None:
            rows = self._read(text)
            if len(self.kept) >= KEPT_TEXTS or self.chars > KEPT_CHARS:
                self.kept, self.chars = {}, 0
            self.kept[text] = rows
            self.chars += len(text)
        return rows

    def _read(self, text: str) -> list[tuple]:
        t = tokens(text)
        rows = []
        for kind in self.kinds:
            for no, (first, last, values) in enumerate(READERS[kind](t, text, self.asked)):
                values |= {"kind": kind, "no": no, "raw": text[t[first].start : t[last].end]}
                rows.append(tuple(map(values.get, NAMES)))
        return rows


def _read(rows: DataFrame, kinds: tuple[str, ...], asked: dict, nested: bool) -> DataFrame:
    """rows(..., text last) -> the readings of the texts, a row each, beside the other columns; nested: the rows as they are, with an
    array of readings in place of the text."""
    kinds = kinds or tuple(READERS)
    before = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readings = _Readings(kinds, asked)
        for batch in batches:
            texts = batch.column(len(before)).dictionary_encode()
            found: list[tuple] = []
            counts = []
            for text in texts.dictionary.to_pylist():
                some = readings.of(text) if text else []
                found += some
                counts.append(len(some))
            code = texts.indices.fill_null(len(counts)).to_numpy(zero_copy_only=False)
            counts = np.array([*counts, 0], np.int64)
            first = np.cumsum(counts) - counts
            n = counts[code]
            ends = np.cumsum(n)
            taken = pa.array(np.arange(n.sum()) - np.repeat(ends - n, n) + np.repeat(first[code], n))
            cols = [pa.array([r[k] for r in found], _TYPES.get(c, pa.string())).take(taken) for k, c in enumerate(NAMES)]
            if nested:
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(cols, NAMES))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*before, "readings"])
            else:
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), *cols], [*before, *NAMES])

    more = T.StructType.fromDDL(f"readings array<struct<{', '.join(f.replace(' ', ': ') for f in _VALUES.split(', '))}>>" if nested else _VALUES)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *more.fields]))


def read_values(units: DataFrame, *kinds: str, **asked: bool) -> DataFrame:
    """units(document_id, unit_no, text) -> the readings of the kinds asked for (all: duration, hours, day_count, money, percentage,
    date), from one pass over the tokens; ``no`` counts a unit's readings of a kind."""
    return _read(units.select("document_id", "unit_no", F.col("text").cast("string").alias("text")), kinds, asked, nested=False)


def with_readings(rows: DataFrame, text: Column, *kinds: str, **asked: bool) -> DataFrame:
    """The rows with the readings of a text beside them, an array of structs of the columns of ``read_values``; empty without any."""
    return _read(rows.select("*", text.cast("string").alias("_text")), kinds, asked, nested=True)


def durations(units: DataFrame, bare_singular: bool = False) -> DataFrame:
    """(no, raw, count, unit, qualifier, note) in English and Arabic: a number before a unit of time, the dual of a unit, or a unit with
    ``one`` after it.  Figures that differ and ranges give no count and a note."""
    rows = read_values(units, "duration", bare_singular=bare_singular)
    return rows.select("document_id", "unit_no", "no", "raw", F.col("value").cast("int").alias("count"), "unit", "qualifier", "note")


def hours(units: DataFrame) -> DataFrame:
    """(no, raw, hours, per, note): a number of hours with day or week, if one is named within three words."""
    return read_values(units, "hours").select("document_id", "unit_no", "no", "raw", F.col("value").alias("hours"), F.col("unit").alias("per"), "note")


def working_day_counts(units: DataFrame) -> DataFrame:
    """(no, raw, days, note): a number of days with a week named within three words."""
    return read_values(units, "day_count").select("document_id", "unit_no", "no", "raw", F.col("value").cast("int").alias("days"), "note")


def money(units: DataFrame, require_currency: bool = True) -> DataFrame:
    """(no, raw, amount, currency, period): figures that are no dates, percentages or starts of ranges, with the nearest currency
    within two tokens; the unit's period counts where it is either monthly or annual."""
    rows = read_values(units, "money", require_currency=require_currency)
    return rows.select("document_id", "unit_no", "no", "raw", F.col("value").alias("amount"), "currency", "period")


def percentages(units: DataFrame) -> DataFrame:
    """(no, raw, percentage, basis): the basis is what follows in the unit."""
    return read_values(units, "percentage").select("document_id", "unit_no", "no", "raw", F.col("value").alias("percentage"), "basis")


def dates(units: DataFrame) -> DataFrame:
    """(no, raw, iso_date, calendar, note, paired): figures in either order and month names.  An order that can't be told and dates that
    don't exist have no iso form; Hijri dates (marked, or of 1300..1500) are not converted.  A date of one calendar and its neighbour of
    the other, with nothing but blanks and an opening parenthesis between, are one reading; ``paired`` is the Hijri one's text."""
    return read_values(units, "date").select("document_id", "unit_no", "no", "raw", "iso_date", "calendar", "note", "paired")
