"""Literal readings of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.functions import values as V


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda col: row.select(col.alias("v")).first()["v"]


def s(x):
    return F.lit(x)


def test_normalize(one):
    raw = "  a​ b\r\n\r\n\r\n\r\nc \t d  e‏\r ﻿f\x07  "
    assert one(T.normalize_text(s(raw))) == "a b\n\nc\td e\nf"
    counts = one(T.removed_counts(s(raw)))
    assert counts["zero_width_space"] == 1 and counts["byte_order_mark"] == 1 and counts["bidi_mark"] == 1


@pytest.mark.parametrize(
    "text,doc,question,ev",
    [
        ("hello world", "en", "en", "en"),
        ("مدة الإجازة السنوية", "ar", "ar", "ar"),
        ("", "unknown", "en", "en"),
        ("123", "unknown", "en", "en"),
        ("مدة annual leave policy", "en", "en", "mixed"),
        ("مدة الإجازة ab", "ar", "ar", "ar"),
        ("مدة الإجازة annual", "mixed", "ar", "ar"),
    ],
)
def test_languages(one, text, doc, question, ev):
    assert one(T.doc_language(s(text))) == doc
    assert one(T.question_language(s(text))) == question
    assert one(T.eval_language(s(text))) == ev


def test_scripts(one):
    assert one(T.dominant_script(s("ab جد"))) == "ar" and one(T.dominant_script(s("12"))) is None
    assert one(T.scripts(s("ab جد"))) == ["ar", "en"] and one(T.scripts(s("7"))) == []
    assert one(T.script_runs(s("Gender ذكر 5 X"))) == ["Gender", "ذكر 5", "X"]


def test_keys(one):
    assert one(T.matching_key(s("  Al-Rest: الإجازةُ السنويـة ٢٥ "))) == "al rest الاجازه السنويه 25"
    assert one(T.to_ascii_digits(s("٣٫٥ ۴٬۰"))) == "3.5 4,0"
    assert sorted(one(T.label_keys(s("9.1.1.2 Housing Allowance (بدل سكن)")))) == sorted(["housing allowance بدل سكن", "housing allowance", "بدل سكن"])
    assert one(T.contains_keyword(s("early termination clause"), "terminat")) and not one(T.contains_keyword(s("determination"), "terminat"))
    assert one(T.contains_keyword(s("وبالراتب"), "راتب"))


def test_html_and_sentences(one):
    html = "<html><style>x{}</style><p>One&nbsp;two &amp; three</p><SCRIPT>var a='</p>'</SCRIPT>"
    assert one(F.trim(T.html_to_text(s(html)))) == "One two & three"
    text = "First line\ncontinues here. Second one!\nThird: yes\nthis is apart.\n\nlast"
    assert one(T.sentences(s(text))) == ["First line\ncontinues here.", "Second one!", "Third: yes\nthis is apart.", "last"]
    assert one(T.sentences(s("Label:\nvalue"))) == ["Label:", "value"]
    assert one(T.page_sentences(s("a. b|c  d\ne"))) == ["a.", "b", "c", "d", "e"]


def test_quality_and_redaction(one):
    assert one(T.text_quality(s("a�b")))["bad_characters"]
    assert one(T.text_quality(s("ال عق د م ر")))["split_arabic"] and not one(T.text_quality(s("العقد الموقع بين الطرفين")))["split_arabic"]
    assert one(T.redact(s("key SK-abcdefgh12 end"))) == "key [redacted] end"
    assert one(T.article_mentions(s("Article 84, المادة ٨٤ and article (7)"))) == ["84", "7"]


def test_contacts(one):
    assert one(T.emails(s("a.b@x.org and a.b@x.org, c@d.co.uk"))) == ["a.b@x.org", "c@d.co.uk"]
    assert one(T.phones(s("+966 50 123 4567; 2019 - 2021; 12/10/2020"))) == ["+966 50 123 4567"]
    assert one(T.years_in(s("1998 to 2021, 12020"))) == [1998, 2021]
    assert one(T.domain_of(s("https://www.Example.com:80/x?y"))) == "example.com"
    assert one(T.cv_tokens(s("The الخبرة of Python"), F.array(s("the"), s("of")))) == ["خبره", "python"]
    assert one(T.token_overlap(s("a b a c"), s("c d"))) == pytest.approx(1 / 3)


@pytest.mark.parametrize("raw,value", [("10.238", 10238), ("12,000", 12000), ("4 080", 4080), ("10.5", 10.5), ("0", None), ("x", None), ("1.234.567", 1234567)])
def test_read_number(one, raw, value):
    assert one(V.read_number(s(raw))) == value


@pytest.mark.parametrize(
    "text,currency,period,basis",
    [
        ("Base salary 5,000 SAR per month", "SAR", "monthly", "base_salary"),
        ("total pay $90,000 a year", "USD", "annual", "total_compensation"),
        ("israel 5", "SAR", None, "unspecified"),  # sr inside a word
        ("eur and sar", "SAR", None, "unspecified"),
        ("sarcasm", None, None, "unspecified"),
    ],
)
def test_pay_words(one, text, currency, period, basis):
    assert (one(V.find_currency(s(text))), one(V.find_period(s(text))), one(V.find_basis(s(text)))) == (currency, period, basis)


@pytest.mark.parametrize(
    "v,a,b,out",
    [
        (14, "day", "week", 2), (1, "year", "month", 12), (40, "hour_per_week", "hour_per_day", None), (30, "day", "month", None),
        (12000, "sar_annual", "sar_monthly", 1000), (5, "day", "day", 5), (1, "sar_annual", "riyal_monthly", None),
    ],
)
def test_units(one, v, a, b, out):
    assert one(V.convert_unit(s(float(v)), s(a), s(b))) == out


def test_money_and_display(one):
    m = one(V.monthly_money(s(24000.0), s("SAR"), s("annual"), s(False)))
    assert (m["amount"], m["problem"]) == (2000, None)
    assert one(V.monthly_money(s(5.0), s("SAR"), F.lit(None).cast("string"), s(False)))["problem"] == "no period"
    d = one(V.base_duration(s(2.0), s("year"), s("working")))
    assert (d["value"], d["unit"]) == (24, "working month")
    assert one(V.display_number(s(1234.0))) == "1,234" and one(V.display_number(s(1234.5))) == "1,234.50"
    assert [one(V.similarity_pct(s(x))) for x in (0.91, 0.006, 0.6051)] == [91, 1, 61]
    assert one(V.opt_int(s("7.0"))) == 7 and one(V.opt_int(s("7.5"))) is None and one(V.opt_str(s("  "))) is None
    assert one(V.citation(s("Law"), F.lit(None).cast("string"), s("part 2"))) == "Law — part 2"
    assert one(V.contract_type(s("عقد غير محدد المدة"))) == "indefinite" and one(V.contract_type(s("fixed-term"))) == "fixed_term"
    assert one(V.normalized_money(s(1800.0), s("SAR"), s("monthly"))) == "SAR 1800 monthly"
    assert one(V.normalized_duration(s(90.0), s("day"), F.lit(None).cast("string"))) == "90 day"
