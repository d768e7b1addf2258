"""Value readers over the token stream."""

import datetime as dt

import pytest

from parchment.operators import spans as X

D = dt.date


@pytest.fixture(scope="module")
def read(spark):
    def run(reader, texts, *cols, **kw):
        units = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "document_id string, unit_no int, text string")
        found = {}
        for r in reader(units, **kw).orderBy("unit_no", "no").collect():
            found.setdefault(r["unit_no"], []).append(tuple(r[c] for c in cols))
        return [found.get(i, []) for i in range(len(texts))]

    return run


def test_durations(read):
    cases = {
        "ninety (90) days from the start date": [(90, "day", None, None, "ninety (90) days")],
        "twenty-one working days": [(21, "day", "working", None, "twenty-one working days")],
        "one hundred and eighty days": [(180, "day", None, None, "one hundred and eighty days")],
        "ninety (60) days": [(None, "day", None, "conflicting numbers", "ninety (60) days")],
        "between 90 to 180 days": [(None, "day", None, "range", "90 to 180 days")],
        "8 hours per day and paid each month": [],
        "until 15/10/2026 days": [],  # a date is no number
        "25% year": [],  # nor is a percentage
        "a term of 1,200 days, then Two Weeks": [(1200, "day", None, None, "1,200 days"), (2, "week", None, None, "Two Weeks")],
        "مدة التجربة تسعون يوماً": [(90, "day", None, None, "تسعون يوماً")],
        "إشعار قبل شهرين": [(2, "month", None, None, "شهرين")],
        "خلال ٣٠ يومَ عمل": [(30, "day", "working", None, "٣٠ يومَ عمل")],
        "لمدة سنة واحدة": [(1, "year", None, None, "سنة واحدة")],
        "خمسة وأربعين يوما وأسبوعين": [(45, "day", None, None, "خمسة وأربعين يوما"), (2, "week", None, None, "وأسبوعين")],
        "the month": [], None: [], "": [],
    }
    assert read(X.durations, [*cases], "count", "unit", "qualifier", "note", "raw") == [*cases.values()]
    assert read(X.durations, ["a month of rest, month by month"], "count", "note", bare_singular=True) == [[(1, "no number written"), (1, "no number written")]]


def test_hours_and_days(read):
    cases = {
        "8 hours per day, 40 hours per week": [(8, "day"), (40, "week")], "eight (8) hours daily": [(8, "day")], "8 or 9 hours weekly": [(None, "week")],
        "٨ ساعات في اليوم و٤٨ ساعة في الأسبوع": [(8, "day"), (48, "week")], "6 hours of work in the day": [(6, None)], "hours": [], "48 hrs a week": [(48, "week")],
    }
    assert read(X.hours, [*cases], "hours", "per") == [*cases.values()]
    cases = {"5 days per week": [5], "خمسة أيام في الأسبوع": [5], "six (5) days a week": [None], "five working days each week": [5], "30 days of leave": []}
    assert read(X.working_day_counts, [*cases], "days") == [[(n,) for n in v] for v in cases.values()]


def test_money_and_percentages(read):
    cases = {
        "12,000 SAR per month": [(12000, "SAR", "monthly", "12,000 SAR")], "Article 90 applies from 15/10/2026": [], "5000 Saudi SAR": [(5000, "SAR", None, "5000 Saudi SAR")],
        "housing 25% of basic": [], "$ 90,000.50 a year": [(90000.5, "USD", "annual", "$ 90,000.50")], "pay of ١٢٬٠٠٠ ريال شهريا": [(12000, "SAR", "monthly", "١٢٬٠٠٠ ريال")],
        "3 days at 500 AED": [(500, "AED", None, "500 AED")], "4-6 SAR": [(6, "SAR", None, "6 SAR")], "٥٠٠ ر.س": [(500, "SAR", None, "٥٠٠ ر.س")],
        "25 percent of 4,000 EUR monthly or annually": [(4000, "EUR", None, "4,000 EUR")],
    }
    assert read(X.money, [*cases], "amount", "currency", "period", "raw") == [*cases.values()]
    assert read(X.money, ["basic 900, from 1/2"], "amount", "currency", require_currency=False) == [[(900, None)]]
    cases = {"housing 25% of basic.": [(25, "of basic")], "٢٥ في المائة من الأجر": [(25, "من الأجر")], "12.5 percent": [(12.5, None)], "25 SAR": []}
    assert read(X.percentages, [*cases], "percentage", "basis") == [*cases.values()]


def test_dates(read):
    cases = {
        "15/10/2026": [(D(2026, 10, 15), "gregorian", None, None)], "01/03/2026": [(None, "gregorian", "order unclear", None)], "31/02/2026": [(None, "gregorian", None, None)],
        "31/10/2027 (01/06/1449 H)": [(D(2027, 10, 31), "gregorian", None, "01/06/1449 H")], "15/10/2026 01/05/1448 H": [(D(2026, 10, 15), "gregorian", None, "01/05/1448 H")],
        "01/05/1448 هـ (15.10.2026)": [(D(2026, 10, 15), "gregorian", None, "01/05/1448 هـ")], "10/25/2026": [(D(2026, 10, 25), "gregorian", "read as month/day/year", None)],
        "joined 5 March 2024": [(D(2024, 3, 5), "gregorian", None, None)], "October 15, 2026 and 1st of Jan 2027": [(D(2026, 10, 15), "gregorian", None, None), (D(2027, 1, 1), "gregorian", None, None)],
        "٥ مارس ٢٠٢٤": [(D(2024, 3, 5), "gregorian", None, None)], "in 1447/05/12": [(None, "hijri", None, None)],
        "15/10/2026 until 01/05/1448": [(D(2026, 10, 15), "gregorian", None, None), (None, "hijri", None, None)],
        "15/10/2026 16/10/2026 01/05/1448": [(D(2026, 10, 15), "gregorian", None, None), (D(2026, 10, 16), "gregorian", None, "01/05/1448")], "May 2024": [], "maybe 3 2024": [],
    }
    assert read(X.dates, [*cases], "iso_date", "calendar", "note", "paired") == [*cases.values()]
    assert read(X.dates, ["from 31/10/2027 (01/06/1449 H)."], "raw", "no") == [[("31/10/2027 (01/06/1449 H", 0)]]


def test_no_rows(spark):
    units = spark.createDataFrame([], "document_id string, unit_no int, text string")
    for reader in (X.durations, X.hours, X.working_day_counts, X.money, X.percentages, X.dates):
        assert reader(units).count() == 0


def test_equal_texts_are_read_once_and_every_row_has_its_readings(spark, monkeypatch):
    """Repeated, null and empty texts between others; the store of readings starts anew when it is full."""
    cut = []
    monkeypatch.setattr(X, "tokens", lambda text, real=X.tokens: cut.append(text) or real(text))
    monkeypatch.setattr(X, "KEPT_TEXTS", 2)
    found = X._Readings(("duration",), {})
    texts = ["two days", "two days", "none", "two days", "1 to 2 weeks and 3 days", "two days"]
    assert [len(found.of(t)) for t in texts] == [1, 1, 0, 1, 2, 1]
    assert cut == ["two days", "none", "1 to 2 weeks and 3 days", "two days"] and len(found.kept) <= 2
    monkeypatch.undo()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([None, "two days", "", "no figure", "1 to 2 weeks and 3 days", "two days"])], "no int, t string").coalesce(1)
    nested = X.with_readings(rows, rows.t, "duration").orderBy("no").collect()
    assert [[(r["no"], r["value"], r["note"]) for r in x["readings"]] for x in nested] == [
        [], [(0, 2.0, None)], [], [], [(0, None, "range"), (1, 3.0, None)], [(0, 2.0, None)]
    ]
    flat = X.durations(rows.selectExpr("no AS document_id", "'u' AS unit_no", "t AS text")).select("document_id", "count").orderBy("document_id", "no").collect()
    assert [tuple(r) for r in flat] == [(1, 2), (4, None), (4, 3), (5, 2)]
