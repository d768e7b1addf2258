"""Text functions as Column -> Column, all evaluated by Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that normalisation removes, by kind, and the spaces that it makes plain.
ZERO_WIDTH = "​"
BYTE_ORDER_MARK = "﻿"
SOFT_HYPHEN = "­"
BIDI_MARKS = "‎‏؜" + "".join(map(chr, [*range(0x202A, 0x202F), *range(0x2066, 0x206A)]))
SPACES = "  　" + "".join(map(chr, range(0x2000, 0x200B)))
REMOVED = {
    "zero_width_space": ZERO_WIDTH,
    "byte_order_mark": BYTE_ORDER_MARK,
    "soft_hyphen": SOFT_HYPHEN,
    "bidi_mark": BIDI_MARKS,
}

# Folding of Arabic letters and of Indic digits.
DIACRITICS = "".join(map(chr, [*range(0x0610, 0x061B), *range(0x064B, 0x0660), 0x0670, *range(0x06D6, 0x06EE)]))
TATWEEL = "ـ"
FOLD_FROM = "أإآٱىةؤئ"
FOLD_TO = "اااايهوي"
DIGITS_FROM = "".join(map(chr, [*range(0x0660, 0x066A), *range(0x06F0, 0x06FA)])) + "٫٬"
DIGITS_TO = "0123456789" * 2 + ".,"

ARABIC = r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-ﻼ"
LATIN = r"A-Za-zÀ-ɏ"


def count_of(text: Column, letters: str) -> Column:
    """Characters of ``text`` in a character class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{letters}]", ""))


def normalize_text(text: Column) -> Column:
    gone = "".join(REMOVED.values())
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.translate(t, SPACES + gone, " " * len(SPACES))
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.regexp_replace(t, "[ \t]*\t[ \t]*", "\t")
    t = F.regexp_replace(t, " {2,}", " ")
    t = F.regexp_replace(t, "(?m)^ +| +$", "")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def removed_counts(text: Column) -> Column:
    """Struct of how many characters of each kind normalisation removes."""
    return F.struct(
        *[(F.length(text) - F.length(F.translate(text, cs, ""))).alias(name) for name, cs in REMOVED.items()]
    )


def doc_language(text: Column, share: float = 0.8) -> Column:
    """ar or en with ``share`` of the letters, else mixed; without letters unknown."""
    a, b = count_of(text, ARABIC), count_of(text, LATIN)
    return (
        F.when(a + b == 0, "unknown")
        .when(a >= share * (a + b), "ar")
        .when(b >= share * (a + b), "en")
        .otherwise("mixed")
    )


def question_language(text: Column) -> Column:
    """ar if over half of all characters are Arabic, spaces counted; blank is en."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.trim(t) == "", "en").when(2 * count_of(t, r"؀-ۿ") > F.length(t), "ar").otherwise("en")


def eval_language(text: Column) -> Column:
    """mixed only if there are Arabic letters and more Latin ones."""
    a, b = count_of(text, r"؀-ۿ"), count_of(text, "A-Za-z")
    return F.when((a > 0) & (b > a), "mixed").when(a > 0, "ar").otherwise("en")


def dominant_script(text: Column) -> Column:
    a, b = count_of(text, ARABIC), count_of(text, LATIN)
    return F.when(a + b == 0, F.lit(None).cast("string")).when(a >= b, "ar").otherwise("en")


def scripts(text: Column) -> Column:
    return F.array_compact(
        F.array(F.when(text.rlike(f"[{ARABIC}]"), F.lit("ar")), F.when(text.rlike(f"[{LATIN}]"), F.lit("en")))
    )


def to_ascii_digits(text: Column) -> Column:
    return F.translate(text, DIGITS_FROM, DIGITS_TO)


def matching_key(text: Column) -> Column:
    """Letters and digits only, folded, lower case, single spaces."""
    # translate() deletes the characters that have no counterpart, so they come last
    t = F.translate(text, DIGITS_FROM + FOLD_FROM + DIACRITICS + TATWEEL, DIGITS_TO + FOLD_TO)
    return F.trim(F.regexp_replace(F.lower(t), r"(?U)[^\p{L}\p{N}]+", " "))


def has_phrase(key: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a ``matching_key`` holds any of the phrases (in the same form): at a word's start, Arabic ones anywhere.  Nothing but
    searches for strings, for such lists are tried on every sentence."""
    out = F.lit(False)
    for p in phrases:
        arabic = "\u0600" <= p[0] <= "\u06ff"
        out = out | (F.contains(key, F.lit(p)) if arabic else F.startswith(key, F.lit(p)) | F.contains(key, F.lit(" " + p)))
    return out


def contains_keyword(key_text: Column, keyword: str) -> Column:
    """Arabic keywords anywhere; others where no Latin letter or digit stands before."""
    if not keyword:
        return F.lit(False)
    if any("؀" <= c <= "ۿ" for c in keyword):
        return F.contains(key_text, F.lit(keyword))
    return key_text.rlike(f"(?<![a-z0-9])\\Q{keyword}\\E")


def label_keys(label: Column) -> Column:
    """Keys of a label: whole, without parentheses, and of each parenthetical; clause numbers and ordinals left out."""
    variants = F.when(~F.contains(label, F.lit("(")), F.array(label)).otherwise(
        F.array_distinct(F.concat(F.array(label, F.regexp_replace(label, r"\([^()]*\)", " ")), F.regexp_extract_all(label, F.lit(r"\(([^()]*)\)"), F.lit(1))))
    )
    ordinals = "[a-z]|اولا|ثانيا|ثالثا|رابعا|خامسا|سادسا|سابعا|ثامنا|تاسعا|عاشرا"
    keys = F.transform(
        variants,
        lambda v: F.regexp_replace(
            matching_key(F.regexp_replace(v, r"^\s*\d+(?:\.\d+)*\.?\s+", "")), f"^(?:{ordinals})\\s+", ""
        ),
    )
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def script_runs(text: Column) -> Column:
    """Text cut where Arabic letters follow Latin ones or the other way; anything else stays with the run before."""
    runs = F.regexp_extract_all(
        text, F.lit(f"[^{ARABIC}{LATIN}]*[{ARABIC}][^{LATIN}]*|[^{ARABIC}{LATIN}]*[{LATIN}][^{ARABIC}]*|[^{ARABIC}{LATIN}]+"), F.lit(0)
    )
    return F.filter(F.transform(runs, lambda r: F.trim(r)), lambda r: r != "")


def html_to_text(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>", " ")
    t = F.replace(F.replace(t, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.regexp_replace(t, "[ \t ]+", " ")


def lines(text: Column) -> Column:
    """Array of the lines that are not blank."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))


def sentences(text: Column) -> Column:
    """Array of sentences.  A line break ends a sentence unless the line before it is open (no final mark or colon)
    and the next begins with a small letter."""
    chunks = F.split(text, r"\n(?!(?<=[^.!?؟:\n]\n)\p{Ll})")
    parts = F.flatten(F.transform(chunks, lambda c: F.split(c, r"(?<=[.!?؟])\s+")))
    return F.filter(parts, lambda s: s.rlike(r"\S"))


def page_sentences(text: Column) -> Column:
    """Sentences of a web page: per line, after a final mark, at two or more spaces, at bars."""
    parts = F.flatten(F.transform(F.split(text, r"\r\n|\r|\n"), lambda c: F.split(c, r"(?<=[.!?؟۔])\s+|\s{2,}|\|")))
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" \t‏‎"))), lambda s: s != "")


def text_quality(text: Column) -> Column:
    """Struct of damage flags: replacement or private-use characters; Arabic split into short pieces."""
    tokens = F.regexp_extract_all(text, F.lit("[\\u0600-\\u06FF]+"), F.lit(0))
    short = F.size(F.filter(tokens, lambda t: F.length(t) <= 2))
    return F.struct(
        text.rlike(r"[�-]").alias("bad_characters"),
        ((F.size(tokens) >= 4) & (short > 0.6 * F.size(tokens))).alias("split_arabic"),
    )


def redact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\b(sk|rk|pk)-[A-Za-z0-9_-]{8,}", "[redacted]")


def article_mentions(text: Column) -> Column:
    """Distinct article numbers that a text names, in order."""
    found = F.regexp_extract_all(to_ascii_digits(text), F.lit(r"(?i)(?:article|المادة)\s*\(?\s*(\d+)"), F.lit(1))
    return F.array_distinct(found)


def domain_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def words(text: Column) -> Column:
    """White-space tokens as they are."""
    return F.regexp_extract_all(text, F.lit("[^ \\t\\n\\r]+"), F.lit(0))


def token_overlap(a: Column, b: Column) -> Column:
    """Distinct words of ``a`` that ``b`` has too, as a share of those of ``a``."""
    left = F.array_distinct(words(a))
    return F.when(F.size(left) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, words(b))) / F.size(left))


def emails(text: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), F.lit(0))
    )


def phones(text: Column, labelled: bool = False) -> Column:
    """Phone numbers: 9 to 15 digits (8 to 15 behind a label); year ranges and dates with slashes are none."""
    found = F.regexp_extract_all(to_ascii_digits(text), F.lit(r"\+?\d[\d ()./-]{6,}\d"), F.lit(0))
    least = 8 if labelled else 9

    def good(p):
        digits = F.length(F.regexp_replace(p, r"\D", ""))
        years = p.rlike(r"^(19|20)\d\d\s*-\s*(19|20)\d\d$")
        return (digits >= least) & (digits <= 15) & ~years & ~F.contains(p, F.lit("/"))

    return F.filter(found, good)


def years_in(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"(?<!\d)(?:19|20)\d\d(?!\d)"), F.lit(0)), lambda y: y.cast("int")
    )


def cv_tokens(text: Column, stop: Column) -> Column:
    """Folded words without stop words and without the Arabic article."""
    kept = F.filter(F.split(matching_key(text), " "), lambda t: (t != "") & ~F.array_contains(stop, t))
    return F.transform(kept, lambda t: F.regexp_replace(t, "^(?:وال|ال)(?=..)", ""))
