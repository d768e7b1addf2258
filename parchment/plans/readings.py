"""Queries of readers, structure, CV parts, rules and checks.  Inputs are texts and rows made from the columns of given tables, or
short documents repeated for every customer, so what a reader must find is known without reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.functions import values as V
from parchment.operators import clauses as C
from parchment.operators import contracts as K
from parchment.operators import extract as X
from parchment.operators import match as CV
from parchment.operators import structure as S
from parchment.plans.fixtures import choose, items, items_sql, per_customer, registry, rows_sql
from parchment.sources.tables import read_table

QUERIES, SQL, query = registry()


# ---- readers of values -------------------------------------------------------------------------------------------------------

_SPANS = (
    "CASE n % 5 WHEN 0 THEN 'Probation lasts ' || q || ' days from the start' WHEN 1 THEN CASE WHEN q % 2 = 0 THEN 'Notice of ninety (90) days'"
    " ELSE 'Notice of ninety (60) days' END WHEN 2 THEN 'leave of twenty-one working days' WHEN 3 THEN 'a term of 10 to ' || q || ' months'"
    " ELSE 'paid ' || q || ' hours per day' END"
)


@query(
    "ext01_durations",
    f"""WITH {items_sql(text=_SPANS)} SELECT document_id, unit_no, CASE n % 5 WHEN 0 THEN q WHEN 1 THEN CASE WHEN q % 2 = 0 THEN 90 END WHEN 2 THEN 21 END AS count,
    CASE n % 5 WHEN 3 THEN 'month' ELSE 'day' END AS unit, CASE n % 5 WHEN 2 THEN 'working' END AS qualifier,
    CASE WHEN n % 5 = 3 THEN 'range' WHEN n % 5 = 1 AND q % 2 = 1 THEN 'conflicting numbers' END AS note FROM u WHERE n % 5 <> 4""",
)
def _(spark, sf):
    return X.durations(items(spark, sf, text=_SPANS)).select("document_id", "unit_no", "count", "unit", "qualifier", "note")


_ARABIC_SPANS = [
    (0, "مدة التجربة تسعون يوما"), (1, "إشعار قبل شهرين"), (2, "خلال ٣٠ يوماً من تاريخه"), (3, "لمدة سنة واحدة"), (4, "خمسة وأربعين يوما"), (5, "وأسبوعين من العمل"), (6, "بلا مدة"),
]


@query(
    "ext01_arabic_durations",
    rows_sql("unit_no int, count int, unit string", [(0, 90, "day"), (1, 2, "month"), (2, 30, "day"), (3, 1, "year"), (4, 45, "day"), (5, 2, "week")]),
)
def _(spark, sf):
    return X.durations(per_customer(spark, sf, "unit_no int, text string", _ARABIC_SPANS)).select("document_id", "unit_no", "count", "unit")


_ARABIC_TERMS = [(0, "٨ ساعات في اليوم و٤٨ ساعة في الأسبوع"), (1, "من الأحد إلى الخميس"), (2, "الراتب ١٢٬٠٠٠ ريال شهريا"), (3, "الأحد والثلاثاء")]


@query("ext02_arabic_hours", rows_sql("unit_no int, hours double, per string", [(0, 8, "day"), (0, 48, "week")]))
def _(spark, sf):
    return X.hours(per_customer(spark, sf, "unit_no int, text string", _ARABIC_TERMS)).select("document_id", "unit_no", "hours", "per")


@query("ext03_arabic_days", rows_sql("unit_no int, days string", [(0, None), (1, "sunday,monday,tuesday,wednesday,thursday"), (2, None), (3, "sunday,tuesday")]))
def _(spark, sf):
    u = per_customer(spark, sf, "unit_no int, text string", _ARABIC_TERMS)
    return u.select("document_id", "unit_no", F.array_join(X.working_days(F.col("text")), ",").alias("days"))


@query("ext04_arabic_money", rows_sql("unit_no int, amount double, currency string, period string", [(2, 12000, "SAR", "monthly")]))
def _(spark, sf):
    return X.money(per_customer(spark, sf, "unit_no int, text string", _ARABIC_TERMS)).select("document_id", "unit_no", "amount", "currency", "period")


_HOURS = "q || ' hours per day, ' || (q + 5) || ' hours per week'"


@query(
    "ext02_hours",
    f"""WITH {items_sql(text=_HOURS)} SELECT document_id, unit_no, CAST(q AS DOUBLE) AS hours, 'day' AS per FROM u
    UNION ALL SELECT document_id, unit_no, CAST(q + 5 AS DOUBLE), 'week' FROM u""",
)
def _(spark, sf):
    return X.hours(items(spark, sf, text=_HOURS)).select("document_id", "unit_no", "hours", "per")


_DAYS = "CASE n % 4 WHEN 0 THEN 'from Sunday to Thursday' WHEN 1 THEN 'Friday through Monday' WHEN 2 THEN 'Sunday, Monday and Tuesday' ELSE 'on Monday' END"


@query(
    "ext03_working_days",
    f"""WITH {items_sql()} SELECT document_id, unit_no, CASE n % 4 WHEN 0 THEN 'sunday,monday,tuesday,wednesday,thursday' WHEN 1 THEN 'friday,saturday,sunday,monday'
    WHEN 2 THEN 'sunday,monday,tuesday' END AS days FROM u""",
)
def _(spark, sf):
    return items(spark, sf, text=_DAYS).select("document_id", "unit_no", F.array_join(X.working_days(F.col("text")), ",").alias("days"))


_PAY = "CASE n % 3 WHEN 0 THEN 'basic ' || q || ',000 SAR per month' WHEN 1 THEN 'USD ' || q || ' per year' ELSE 'Article ' || q || ' applies from 15/10/2026' END"


@query(
    "ext04_money",
    f"""WITH {items_sql()} SELECT document_id, unit_no, CAST(CASE n % 3 WHEN 0 THEN q * 1000 ELSE q END AS DOUBLE) AS amount, CASE n % 3 WHEN 0 THEN 'SAR' ELSE 'USD' END AS currency,
    CASE n % 3 WHEN 0 THEN 'monthly' ELSE 'annual' END AS period FROM u WHERE n % 3 < 2""",
)
def _(spark, sf):
    return X.money(items(spark, sf, text=_PAY)).select("document_id", "unit_no", "amount", "currency", "period")


_DATES = (
    "CASE n % 5 WHEN 0 THEN 'on ' || (20 + q % 9) || '/10/2026' WHEN 1 THEN 'on 01/03/2026' WHEN 2 THEN 'on 31/02/2026'"
    " WHEN 3 THEN 'until 31/10/2027 (01/06/1449 H)' ELSE 'in 1447/05/12 H' END"
)


@query(
    "ext05_dates",
    f"""WITH {items_sql()} SELECT document_id, unit_no, CASE n % 5 WHEN 0 THEN '2026-10-' || (20 + q % 9) WHEN 3 THEN '2027-10-31' END AS iso_date,
    CASE n % 5 WHEN 4 THEN 'hijri' ELSE 'gregorian' END AS calendar, CASE n % 5 WHEN 1 THEN 'order unclear' END AS note FROM u""",
)
def _(spark, sf):
    return X.dates(items(spark, sf, text=_DATES)).select("document_id", "unit_no", F.col("iso_date").cast("string").alias("iso_date"), "calendar", "note")


_COUNTS = "CASE n % 4 WHEN 0 THEN q || ' days per week' WHEN 1 THEN 'six (' || (q % 3 + 5) || ') working days each week' WHEN 2 THEN q || ' days of leave' ELSE 'open ' || q || ' days in the week' END"


@query(
    "ext03_day_counts",
    f"""WITH {items_sql(text=_COUNTS)} SELECT document_id, unit_no, CASE n % 4 WHEN 1 THEN CASE WHEN q % 3 = 1 THEN 6 END ELSE q END AS days,
    CASE WHEN n % 4 = 1 AND q % 3 <> 1 THEN 'conflicting numbers' END AS note FROM u WHERE n % 4 <> 2""",
)
def _(spark, sf):
    return X.working_day_counts(items(spark, sf, text=_COUNTS)).select("document_id", "unit_no", "days", "note")


_MIXED = (
    "'pay of ' || q || CASE WHEN s % 2 = 0 THEN ',000 Saudi SAR' ELSE ' full Gulf units of SAR' END || ' monthly, housing ' || (q % 40 + 1) || CASE WHEN s % 3 = 0 THEN '%' ELSE ' percent' END"
    " || ' of basic until ' || (q % 28 + 1) || CASE WHEN s % 5 < 3 THEN ' March 2031' ELSE '/12/2031' END || CASE WHEN s % 7 = 0 THEN ' (1/1/1453 H)' ELSE '' END || ' after 2 to ' || q || ' weeks'"
)


@query(
    "ext04_currency_within_two",
    f"WITH {items_sql()} SELECT document_id, unit_no, q * 1000.0::DOUBLE AS amount, 'SAR' AS currency, 'monthly' AS period FROM u WHERE s % 2 = 0",
)
def _(spark, sf):
    """Of a figure, a percentage, a date and a range in one text, the figure with a currency near it is an amount."""
    return X.money(items(spark, sf, text=_MIXED)).select("document_id", "unit_no", "amount", "currency", "period")


@query(
    "ext04_percentages",
    f"""WITH {items_sql(text=_MIXED)} SELECT document_id, unit_no, CAST(q % 40 + 1 AS DOUBLE) AS percentage, 'of basic until' AS basis FROM u""",
)
def _(spark, sf):
    p = X.percentages(items(spark, sf, text=_MIXED))
    return p.select("document_id", "unit_no", "percentage", F.substring("basis", 1, 14).alias("basis"))


@query(
    "ext06_calendar_pairs",
    f"""WITH {items_sql(text=_MIXED)}, d AS (SELECT *, q % 28 + 1 AS day FROM u) SELECT document_id, unit_no, CASE WHEN s % 5 < 3 THEN CAST(make_date(2031, 3, day) AS VARCHAR)
      WHEN day >= 12 THEN CAST(make_date(2031, 12, day) AS VARCHAR) END AS iso_date, CASE WHEN s % 5 >= 3 AND day < 12 THEN 'order unclear' END AS note,
      CASE WHEN s % 7 = 0 THEN '1/1/1453 H' END AS paired FROM d""",
)
def _(spark, sf):
    """One reading for a date and its Hijri neighbour, with month names and figures."""
    d = X.dates(items(spark, sf, text=_MIXED))
    return d.select("document_id", "unit_no", F.col("iso_date").cast("string").alias("iso_date"), "note", "paired")


@query("ext01_ranges", f"WITH {items_sql()} SELECT document_id, unit_no, 'week' AS unit, 'range' AS note, '2 to ' || q || ' weeks' AS raw FROM u")
def _(spark, sf):
    return X.durations(items(spark, sf, text=_MIXED)).select("document_id", "unit_no", "unit", "note", "raw")


_LABELS = [(0, "Basic pay (monthly)", "{k}"), (1, "2. Notice period", "30"), (2, "Other", "x"), (3, "Housing allowance", "5"), (4, "بدل نقل", "7"), (5, "Transport allowance", "9")]
_PAIR = "ord int, label string, value string"


@query("ext07_labels", rows_sql("ord int, field string, value string", [(0, "basic", "{k}"), (0, "pay", "{k}"), (1, "notice", "30"), (3, "housing", "5")]))
def _(spark, sf):
    specs = spark.createDataFrame([("basic", "basic pay"), ("pay", "monthly"), ("notice", "notice period"), ("housing", "housing allowance")], "field string, label_key string")
    return X.label_candidates(per_customer(spark, sf, _PAIR, _LABELS), specs).select("document_id", "ord", "field", "value")


@query("ext20_other_allowances", rows_sql("ord int, label string", [(4, "بدل نقل"), (5, "Transport allowance")]))
def _(spark, sf):
    specs = spark.createDataFrame([("housing", "housing allowance")], "field string, label_key string")
    return X.other_allowances(per_customer(spark, sf, _PAIR, _LABELS), specs).select("document_id", "ord", "label")


_LEAVE = "CASE n % 3 WHEN 0 THEN 'annual leave: ' || q WHEN 1 THEN 'annual leave ' || q || ' weeks' ELSE 'leave of ' || q || ' or 99' END"


@query("ext10_leave", f"WITH {items_sql()} SELECT document_id, unit_no, q AS count, 'day' AS unit FROM u WHERE n % 3 = 0")
def _(spark, sf):
    read = items(spark, sf, text=_LEAVE).select("document_id", "unit_no", X.leave_value(F.col("text")).alias("v"))
    return read.where("v IS NOT NULL").select("document_id", "unit_no", "v.count", "v.unit")


_ALLOWANCE = {"field": "flag", "amount": "CASE WHEN s % 3 <> 0 THEN CAST(q % 2 AS DOUBLE) END", "percentage": "CASE WHEN s % 5 = 0 THEN 25.0 END", "currency": "CASE WHEN line = 'O' THEN 'SAR' END", "period": "CASE WHEN s % 2 = 0 THEN 'monthly' END"}


@query(
    "ext17_allowances",
    f"""WITH {items_sql(**_ALLOWANCE)}, g AS (SELECT document_id, field, max(amount) AS a, CAST(max(percentage) AS DOUBLE) AS b, max(currency) AS c, max(period) AS d,
    count(DISTINCT amount) <= 1 AND count(DISTINCT percentage) <= 1 AND count(DISTINCT currency) <= 1 AND count(DISTINCT period) <= 1 AS agree FROM u GROUP BY ALL)
    SELECT document_id, field, CASE WHEN agree THEN a END AS amount, CASE WHEN agree THEN b END AS percentage, CASE WHEN agree THEN c END AS currency, CASE WHEN agree THEN d END AS period, agree FROM g""",
)
def _(spark, sf):
    return X.merge_allowance(items(spark, sf, **_ALLOWANCE).withColumn("percentage", F.col("percentage").cast("double")))


@query(
    "ext19_working_days_merge",
    f"""WITH {items_sql()} SELECT document_id, unit_no, CASE n % 4 WHEN 0 THEN CASE WHEN q % 7 IN (0, 5) THEN 5 END WHEN 1 THEN CASE WHEN q % 7 IN (0, 4) THEN 4 END WHEN 2 THEN CASE WHEN q % 7 IN (0, 3) THEN 3 END END AS days FROM u""",
)
def _(spark, sf):
    u = items(spark, sf, text=_DAYS, written="CASE WHEN q % 7 > 0 THEN q % 7 END")
    kept = X.merge_days(X.working_days(F.col("text")), F.col("written"))
    return u.select("document_id", "unit_no", F.when(kept.isNotNull(), F.size(kept)).alias("days"))


_BENEFITS = [(0, "Benefits:"), (1, "• medical cover {k}"), (2, "- annual ticket"), (3, "General terms"), (4, "• not a benefit"), (5, "Perks"), (6, "* parking")]


@query("ext21_benefits", rows_sql("line_no int, item string", [(1, "medical cover {k}"), (2, "annual ticket"), (6, "parking")]))
def _(spark, sf):
    return X.bullet_runs(per_customer(spark, sf, "line_no int, text string", _BENEFITS), r"(?i)^\s*(benefits|perks)\b")


_SECTIONS = [(0, "heading", "Scope {k}"), (1, "paragraph", "The employee works in Riyadh."), (2, "heading", "Termination"), (3, "paragraph", "Either party may end it by notice {k}."), (4, "paragraph", ""), (5, "list_item", "Gross misconduct")]


@query("ext22_termination", rows_sql("ord int, title string, text string", [(3, "Termination", "Either party may end it by notice {k}."), (5, "Termination", "Gross misconduct")]))
def _(spark, sf):
    return X.termination_terms(S.sectionise(per_customer(spark, sf, "ord int, kind string, text string", _SECTIONS)))


@query(
    "ext25_derived_status",
    f"""WITH {items_sql(field="flag", status="CASE WHEN q > 25 THEN 'found' ELSE 'ambiguous' END")} SELECT document_id, unit_no, field, status FROM u
    UNION ALL SELECT document_id, unit_no, 'renewal', status FROM u WHERE field = 'A'""",
)
def _(spark, sf):
    return X.derive_status(items(spark, sf, field="flag", status="CASE WHEN q > 25 THEN 'found' ELSE 'ambiguous' END").select("document_id", "unit_no", "field", "status"), "A", "renewal")


@query(
    "ext28_weakest_confidence",
    f"""WITH {items_sql()} SELECT document_id, ['low', 'medium', 'high'][min(q % 3) + 1] AS confidence FROM u GROUP BY document_id""",
)
def _(spark, sf):
    u = items(spark, sf).select("document_id", choose(F.col("q") % 3, "low", "medium", "high").alias("c"))
    return u.groupBy("document_id").agg(F.collect_set("c").alias("cs")).select("document_id", X.weakest_confidence(F.col("cs")).alias("confidence"))


# ---- functions of values -----------------------------------------------------------------------------------------------------


@query("doc05_scripts", """SELECT doc_id, CASE WHEN a + b = 0 THEN NULL WHEN a >= b THEN 'ar' ELSE 'en' END AS script, CASE WHEN a > 0 AND b > 0 THEN 'ar,en' WHEN a > 0 THEN 'ar' WHEN b > 0 THEN 'en' ELSE '' END AS scripts
    FROM (SELECT doc_id, 5 * (doc_id % 200) AS a, length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) AS b FROM documents)""")
def _(spark, sf):
    t = F.concat("text", F.repeat(F.lit("العقد"), (F.col("doc_id") % 200).cast("int")))
    return read_table(spark, sf, "documents").select("doc_id", T.dominant_script(t).alias("script"), F.array_join(T.scripts(t), ",").alias("scripts"))


@query("doc12_script_runs", rows_sql("line_no int, runs string", [(0, "Salary {k}:|الراتب الأساسي 5"), (1, "العقد|fixed|محدد"), (2, "12 / 34")]))
def _(spark, sf):
    lines = per_customer(spark, sf, "line_no int, text string", [(0, "Salary {k}: الراتب الأساسي 5"), (1, "العقد fixed محدد"), (2, " 12 / 34 ")])
    return lines.select("document_id", "line_no", F.array_join(T.script_runs(F.col("text")), "|").alias("runs"))


@query("doc16_label_keys", rows_sql("line_no int, keys string", [(0, "basic pay monthly|basic pay|monthly"), (1, "notice period {k}"), (2, "مده الاشعار")]))
def _(spark, sf):
    lines = per_customer(spark, sf, "line_no int, text string", [(0, "Basic Pay (Monthly)"), (1, "2.1. Notice period {k}"), (2, "ثانيا مدة الإشعار")])
    return lines.select("document_id", "line_no", F.array_join(T.label_keys(F.col("text")), "|").alias("keys"))


_ARTICLES = "'Under article ' || q || ' and Article (' || (q + 1) || '), المادة ' || q || ' too'"


@query("doc24_article_mentions", f"WITH {items_sql()} SELECT document_id, unit_no, q || ',' || (q + 1) AS articles FROM u")
def _(spark, sf):
    return items(spark, sf, text=_ARTICLES).select("document_id", "unit_no", F.array_join(T.article_mentions(F.col("text")), ",").alias("articles"))


@query("fn01_matching_key", rows_sql("line_no int, k string", [(0, "الاجر {k}"), (1, "annual leave days 12"), (2, "سنه 1447")]))
def _(spark, sf):
    lines = per_customer(spark, sf, "line_no int, text string", [(0, "الأَجْرُ  {k}"), (1, "Annual-LEAVE: days (١٢)"), (2, "سنـــة ۱۴۴۷.")])
    return lines.select("document_id", "line_no", T.matching_key(F.col("text")).alias("k"))


@query("fn02_ascii_digits", f"WITH {items_sql()} SELECT document_id, unit_no, q || '.5,' || q AS t FROM u")
def _(spark, sf):
    arabic = F.translate(F.col("q").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    return items(spark, sf).select("document_id", "unit_no", T.to_ascii_digits(F.concat(arabic, F.lit("٫٥٬"), arabic)).alias("t"))


_TENS = ("", "ten", "twenty", "thirty", "forty", "fifty")
_ONES = ("", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


@query("fn04_number_words", f"WITH {items_sql()} SELECT document_id, unit_no, CASE WHEN q >= 20 OR q < 10 THEN 300 + q END AS v FROM u")
def _(spark, sf):
    u = items(spark, sf).withColumn("w", F.split(F.concat_ws(" ", F.lit("three hundred and"), choose(F.floor(F.col("q") / 10), *_TENS), choose(F.col("q") % 10, *_ONES)), r"\s+"))
    value = X.number_words(F.filter("w", lambda t: t != ""))
    return u.select("document_id", "unit_no", F.when((F.col("q") >= 20) | (F.col("q") < 10), value).alias("v"))


@query("fn04_arabic_numbers", rows_sql("line_no int, v int", [(0, 145), (1, 60), (2, None), (3, 207)]))
def _(spark, sf):
    lines = per_customer(spark, sf, "line_no int, text string", [(0, "مائة وخمسة وأربعون"), (1, "ستون"), (2, "ستون ريال"), (3, "مائتان وسبعة")])
    return lines.select("document_id", "line_no", X.arabic_number(F.col("text")).alias("v"))


@query("fn05_ordinals", rows_sql("line_no int, v int", [(0, 1), (1, 25), (2, 105), (3, None), (4, 211)]))
def _(spark, sf):
    lines = per_customer(spark, sf, "line_no int, text string", [(0, "المادة الأولى"), (1, "المادة الخامسة والعشرون"), (2, "المادة الخامسة بعد المائة"), (3, "أحكام عامة"), (4, "المادة الحادية عشرة بعد المائتين")])
    return lines.select("document_id", "line_no", X.ordinal_number(F.col("text")).alias("v"))


_UNITS = {"a": "CASE n % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'year' WHEN 2 THEN 'hour_per_week' ELSE 'sar_annual' END", "b": "CASE n % 4 WHEN 0 THEN 'week' WHEN 1 THEN 'month' WHEN 2 THEN 'hour_per_day' ELSE 'sar_monthly' END"}


@query("fn12_convert_units", f"WITH {items_sql(**_UNITS)} SELECT document_id, unit_no, CASE n % 4 WHEN 0 THEN round(q / 7, 6) WHEN 1 THEN q * 12.0 WHEN 3 THEN round(q / 12, 6) END AS v FROM u")
def _(spark, sf):
    u = items(spark, sf, **_UNITS)
    return u.select("document_id", "unit_no", F.round(V.convert_unit(F.col("q").cast("double"), F.col("a"), F.col("b")), 6).alias("v"))


_MONEY = {"amount": "CASE WHEN s % 7 <> 0 THEN CAST(q AS DOUBLE) END", "currency": "CASE WHEN line = 'O' THEN 'SAR' END", "period": "CASE n % 4 WHEN 0 THEN 'monthly' WHEN 1 THEN 'annual' WHEN 2 THEN 'weekly' END", "pct": "s % 11 = 0"}


@query(
    "fn13_monthly_money",
    f"""WITH {items_sql(**_MONEY)}, p AS (SELECT *, CASE WHEN pct THEN 'percentage' WHEN amount IS NULL THEN 'no amount' WHEN currency IS NULL THEN 'no currency' WHEN period IS NULL THEN 'no period'
    WHEN period = 'weekly' THEN 'other period' END AS problem FROM u) SELECT document_id, unit_no, CASE WHEN problem IS NULL THEN round(CASE WHEN period = 'annual' THEN amount / 12 ELSE amount END, 6) END AS monthly, problem FROM p""",
)
def _(spark, sf):
    m = V.monthly_money(F.col("amount"), F.col("currency"), F.col("period"), F.col("pct"))
    return items(spark, sf, **_MONEY).select("document_id", "unit_no", F.round(m["amount"], 6).alias("monthly"), m["problem"].alias("problem"))


@query(
    "fn14_base_duration",
    f"""WITH {items_sql()} SELECT document_id, unit_no, CASE n % 4 WHEN 1 THEN q * 7 WHEN 3 THEN q * 12 ELSE q END AS v, CASE WHEN line = 'O' THEN 'working ' ELSE '' END || CASE WHEN n % 4 < 2 THEN 'day' ELSE 'month' END AS unit FROM u""",
)
def _(spark, sf):
    d = V.base_duration(F.col("q"), choose(F.col("n") % 4, "day", "week", "month", "year"), F.when(F.col("line") == "O", "working"))
    return items(spark, sf).select("document_id", "unit_no", d["value"].alias("v"), d["unit"].alias("unit"))


@query("fn17_casts", f"""WITH {items_sql()} SELECT document_id, unit_no, CASE n % 4 WHEN 0 THEN CAST(q AS BIGINT) WHEN 1 THEN CAST(q AS BIGINT) END AS i, CASE n % 4 WHEN 3 THEN NULL WHEN 0 THEN CAST(q AS VARCHAR) WHEN 1 THEN q || '.0' ELSE q || '.5' END AS t FROM u""")
def _(spark, sf):
    u = items(spark, sf, raw="CASE n % 4 WHEN 0 THEN '' || q WHEN 1 THEN ' ' || q || '.0 ' WHEN 2 THEN q || '.5' ELSE '  ' END")
    return u.select("document_id", "unit_no", V.opt_int(F.col("raw")).alias("i"), V.opt_str(F.col("raw")).alias("t"))


@query("fn18_canonical_values", f"""WITH {items_sql()} SELECT document_id, unit_no, CASE WHEN line = 'O' THEN 'SAR ' ELSE '' END || q || CASE WHEN n % 2 = 0 THEN ' monthly' ELSE '' END AS money, q || CASE WHEN n % 2 = 0 THEN ' working' ELSE '' END || ' day' AS duration FROM u""")
def _(spark, sf):
    q = F.col("q").cast("double")
    money = V.normalized_money(q, F.when(F.col("line") == "O", "SAR"), F.when(F.col("n") % 2 == 0, "monthly"))
    return items(spark, sf).select("document_id", "unit_no", money.alias("money"), V.normalized_duration(q, F.lit("day"), F.when(F.col("n") % 2 == 0, "working")).alias("duration").alias("duration"))


@query("fn19_citation", f"""WITH {items_sql()} SELECT document_id, unit_no, CASE WHEN line = 'O' AND n % 2 = 0 THEN 'Labour Law — Article ' || q WHEN line = 'O' THEN 'Labour Law' WHEN n % 2 = 0 THEN 'Article ' || q ELSE 'unidentified article' END AS citation FROM u""")
def _(spark, sf):
    c = V.citation(F.when(F.col("line") == "O", "Labour Law"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("Article "), F.col("q").cast("string"))))
    return items(spark, sf).select("document_id", "unit_no", c.alias("citation"))


@query("fn22_contract_type", rows_sql("line_no int, kind string", [(0, "indefinite"), (1, "fixed_term"), (2, "indefinite"), (3, "fixed_term"), (4, None)]))
def _(spark, sf):
    lines = per_customer(spark, sf, "line_no int, text string", [(0, "an Indefinite contract {k}"), (1, "a fixed-term contract"), (2, "عقد غير محدد المدة"), (3, "عقد محدد المدة"), (4, "a contract")])
    return lines.select("document_id", "line_no", V.contract_type(F.col("text")).alias("kind"))


@query("fn23_years", f"WITH {items_sql()} SELECT document_id, unit_no, (1950 + q) || ',2024' AS years FROM u")
def _(spark, sf):
    u = items(spark, sf, text="'from ' || (1950 + q) || ' to 2024, room 12024 of 3050'")
    return u.select("document_id", "unit_no", F.array_join(T.years_in(F.col("text")), ",").alias("years"))


# ---- structure ---------------------------------------------------------------------------------------------------------------

_PAGES = {"chars": "q", "images": "s % 2 = 0", "blank": "q < 5"}


@query(
    "doc06_page_status",
    f"""WITH {items_sql(**_PAGES)}, p AS (SELECT document_id, CASE WHEN chars >= 20 THEN 'text' WHEN blank AND NOT images THEN 'no_text' ELSE 'ocr_required' END AS status FROM u)
    SELECT document_id, CASE WHEN bool_or(status = 'ocr_required') AND bool_or(status = 'text') THEN 'partial' WHEN bool_or(status = 'ocr_required') THEN 'ocr_required' ELSE 'success' END AS status FROM p GROUP BY document_id""",
)
def _(spark, sf):
    return S.doc_status(items(spark, sf, **_PAGES).select("document_id", S.page_status(F.col("chars"), F.col("images"), F.col("blank")).alias("status")))


_RUNS = [
    (0, 0, "Contract {k}", 16.0, False), (1, 0, "The first party is a company that trades in goods of many kinds.", 11.0, False), (1, 1, "The second party is an employee of it.", 11.2, False),
    (2, 0, "Duration", 11.0, True), (3, 0, "This contract runs for a year and may be renewed by both parties in writing.", 10.9, False), (3, 1, "It starts now.", 11.0, True),
]


@query("doc08_headings", rows_sql("block int, is_heading boolean", [(0, True), (1, False), (2, True), (3, False)]))
def _(spark, sf):
    return S.detect_headings(per_customer(spark, sf, "block int, line int, text string, size double, bold boolean", _RUNS)).select("document_id", "block", "is_heading")


@query("doc09_reading_order", rows_sql("full_text string", [("Scope {k}\n\nThe employee works in Riyadh.\n\nPay | {k}\n\nTotal | 5\n\nTermination\n\nEither party may end it by notice {k}.\n\nGross misconduct",)]))
def _(spark, sf):
    sections = S.sectionise(per_customer(spark, sf, "ord int, kind string, text string", _SECTIONS))
    rows = per_customer(spark, sf, "ord int, row_no int, cells array<string>", [(1, 1, ("Pay", "{k}")), (1, 2, ("Total", "5"))])
    return S.full_text(sections, rows)


_LABELLED = [(0, "Employer: Acme {k} | Role：Clerk"), (1, "Start date:"), (2, "next of {k}"), (3, "Grade\t7"), (4, "no pair here"), (5, "Empty:"), (6, "Other: x")]


@query(
    "doc13_labelled_values",
    rows_sql("line_no int, label string, value string, method string", [(0, "Employer", "Acme {k}", "labeled_line"), (0, "Role", "Clerk", "labeled_line"), (1, "Start date", "next of {k}", "labeled_next_line"), (3, "Grade", "7", "labeled_line"), (6, "Other", "x", "labeled_line")]),
)
def _(spark, sf):
    return S.labeled_values(per_customer(spark, sf, "line_no int, text string", _LABELLED)).drop("part_no")


@query("doc15_table_pairs", rows_sql("row_no int, label string, value string", [(0, "Basic", "{k}"), (0, "Housing", "25%"), (1, "Total", "9")]))
def _(spark, sf):
    rows = per_customer(spark, sf, "table_id string, row_no int, cells array<string>", [("t1", 0, ("Basic ", "{k}", "Housing", "25%")), ("t1", 1, ("Total", "9", "loose")), ("t1", 2, ("", "x")), ("t1", 3, ("one",))])
    return S.table_pairs(rows).drop("table_id")


_LAW = "Part One\nChapter A\nArticle 1\nFirst rule {k}\nArticle 2\nSecond rule\nof two lines\nChapter B\nArticle 3\nThird rule"


@query(
    "doc17_statute",
    rows_sql("index long, part string, chapter string, name string, content string", [(1, "Part One", "Chapter A", "Article 1", "First rule {k}"), (2, "Part One", "Chapter A", "Article 2", "Second rule\nof two lines"), (3, "Part One", "Chapter B", "Article 3", "Third rule")]),
)
def _(spark, sf):
    return S.split_statute(per_customer(spark, sf, "text string", [(_LAW,)]))


_RUNNING = {"kind": "CASE WHEN line = 'O' THEN 'header' ELSE 'footer' END", "text": "'text ' || (q % 3)", "ord": "unit_no", "linked": "s % 4 = 0"}


@query("doc26_running_text", f"WITH {items_sql(**_RUNNING)} SELECT document_id, kind, text, min(ord) AS ord FROM u WHERE NOT linked GROUP BY ALL")
def _(spark, sf):
    return S.dedupe_running_text(items(spark, sf, **_RUNNING)).select("document_id", "kind", "text", "ord")


_BLOCKS = [(1, 0.0, 0.0, 10.0, 10.0, "inside"), (1, 0.0, 50.0, 10.0, 60.0, "outside {k}"), (1, 0.0, 16.0, 10.0, 26.0, "cut"), (2, 0.0, 0.0, 10.0, 10.0, "other page")]


@query("doc27_boxed_text", rows_sql("page int, text string", [(1, "outside {k}"), (1, "cut"), (2, "other page")]))
def _(spark, sf):
    blocks = per_customer(spark, sf, "page int, x0 double, y0 double, x1 double, y1 double, text string", _BLOCKS)
    boxes = per_customer(spark, sf, "page int, x0 double, y0 double, x1 double, y1 double", [(1, 0.0, 0.0, 9.0, 20.0)])
    return S.drop_boxed(blocks, boxes).select("document_id", "page", "text")


@query("doc28_list_items", rows_sql("item long, text string", [(0, "Duties of {k}"), (1, "• write letters\nand answer them"), (2, "• file them")]))
def _(spark, sf):
    lines = per_customer(spark, sf, "block int, line int, text string", [(0, 0, "Duties of {k}"), (0, 1, "• write letters"), (0, 2, "and answer them"), (0, 3, "• file them")])
    return S.bullet_items(lines).drop("block")


# ---- clauses -----------------------------------------------------------------------------------------------------------------


@query("cls03_heading_types", rows_sql("line_no int, type string", [(0, "PROBATION"), (1, "TERMINATION"), (2, "WORKING_HOURS"), (3, "ANNUAL_LEAVE"), (4, "SALARY"), (5, None)]))
def _(spark, sf):
    lines = per_customer(spark, sf, "line_no int, text string", [(0, "3. Probation period"), (1, "Termination and notice {k}"), (2, "ساعات العمل"), (3, "Annual leave"), (4, "الأجر"), (5, "Definitions")])
    return lines.select("document_id", "line_no", C.classify(T.matching_key(F.col("text")), K.HEADING_RULES).alias("type"))


@query("cls02_contract_rules", rows_sql("line_no int, type string", [(0, "PROBATION"), (1, "TERMINATION"), (2, "WORKING_HOURS"), (3, "ANNUAL_LEAVE"), (4, "SALARY"), (5, None), (6, "CONFIDENTIALITY"), (7, "OVERTIME")]))
def _(spark, sf):
    lines = per_customer(
        spark, sf, "line_no int, text string",
        [(0, "The employee is on probation for 90 days {k}."), (1, "Either party may terminate the contract by notice."), (2, "Working hours are eight a day."), (3, "The employee has annual leave of 21 days."),
         (4, "A basic salary of 5000 is paid monthly."), (5, "Signed in two copies."), (6, "The employee keeps all confidential information secret."), (7, "Overtime hours are paid at 150%.")],
    )
    return lines.select("document_id", "line_no", C.classify(T.matching_key(F.col("text")), K.SENTENCE_RULES).alias("type"))


@query("cls04_new_items", rows_sql("line_no int, opens boolean", [(0, True), (1, True), (2, True), (3, False), (4, True), (5, False)]))
def _(spark, sf):
    lines = per_customer(spark, sf, "line_no int, text string", [(0, "15. The employee {k}"), (1, "(a) pays"), (2, "• a benefit"), (3, "The employee"), (4, "iv) more"), (5, "2024 was a year")])
    return lines.select("document_id", "line_no", C.starts_new_item(F.col("text")).alias("opens"))


_HEADED = [("a", "h1", 1, "Probation", "It is ninety days for {k}."), ("b", "h1", 2, "Probation", "A second part."), ("c", "h2", 3, "Definitions", "Terms."), ("d", "h3", 4, "Annual leave", "Twenty-one days.")]


@query("cls06_heading_fallback", rows_sql("section_id string, clause_no int, type string, text string", [("a/{k}", 1, "PROBATION", "It is ninety days for {k}.")]))
def _(spark, sf):
    sections = per_customer(spark, sf, "section_id string, heading_id string, ord int, title string, text string", _HEADED)
    key = F.col("document_id").cast("string")
    sections = sections.withColumns({c: F.concat_ws("/", c, key) for c in ("section_id", "heading_id")})
    has = sections.where("title = 'Annual leave'").select("section_id")
    rules = [{"type": r["type"], "pattern": "(?i)" + r["pattern"]} for r in K.HEADING_RULES]
    return C.heading_fallback(sections, has, rules).join(sections.select("section_id", "document_id"), "section_id")


_PARTS = [(0, "heading", "The probation period is ninety days for {k}"), (1, "heading", "Annual leave and holidays"), (2, "list_item", "• 21 days a year"), (3, "list_item", "• 10 days of holidays"), (4, "paragraph", "Other text"), (5, "list_item", "• under nothing")]
_PLAIN_RULES = [{"type": "PROBATION", "pattern": "(?i)probation"}, {"type": "LEAVE", "pattern": "(?i)leave"}]
_PART_DDL = "ord int, kind string, text string"


@query("cls07_heading_clauses", rows_sql("ord int, type string, text string", [(0, "PROBATION", "The probation period is ninety days for {k}"), (1, "LEAVE", "Annual leave and holidays")]))
def _(spark, sf):
    return C.heading_clauses(per_customer(spark, sf, _PART_DDL, _PARTS), _PLAIN_RULES)


@query("cls08_bullet_clauses", rows_sql("ord int, type string, text string", [(2, "LEAVE", "• 21 days a year\n• 10 days of holidays")]))
def _(spark, sf):
    return C.bullet_clauses(per_customer(spark, sf, _PART_DDL, _PARTS), _PLAIN_RULES)


_CELLS = [(10, ("Annual leave", "21 days for {k}")), (11, ("Leave",)), (12, ("Something else", "of no type at all"))]


@query("cls09_row_clauses", rows_sql("ord int, type string, text string", [(10, "LEAVE", "Annual leave | 21 days for {k}")]))
def _(spark, sf):
    return C.row_clauses(per_customer(spark, sf, "ord int, cells array<string>", _CELLS), _PLAIN_RULES)


@query("cls11_clause_names", rows_sql("ord int, clause_name string", [(0, "Probation (Probation period)"), (1, "Leave"), (2, None)]))
def _(spark, sf):
    clauses = per_customer(spark, sf, "ord int, type string, heading string", [(0, "PROBATION", "Probation period"), (1, "LEAVE", "General terms {k}"), (2, "OTHER", "x")])
    names = spark.createDataFrame([("PROBATION", "Probation"), ("LEAVE", "Leave")], "type string, label string")
    return C.name_clauses(clauses, names, _PLAIN_RULES).select("document_id", "ord", "clause_name")


@query(
    "cls12_all_clauses",
    rows_sql("clause_id string, origin string, type string, ord int", [("C01", "heading", "PROBATION", 0), ("C02", "heading", "LEAVE", 1), ("C03", "bullets", "LEAVE", 2), ("C04", "sentences", "LEAVE", 4), ("C05", "row", "LEAVE", 10)]),
)
def _(spark, sf):
    parts = per_customer(spark, sf, _PART_DDL, _PARTS)
    sentences = per_customer(spark, sf, _PART_DDL.replace("kind", "type"), [(4, "LEAVE", "Sick leave is paid for thirty days.")])
    rows = per_customer(spark, sf, "ord int, cells array<string>", _CELLS)
    merged = C.merge_sources(sentences, C.heading_clauses(parts, _PLAIN_RULES), C.bullet_clauses(parts, _PLAIN_RULES), C.row_clauses(rows, _PLAIN_RULES))
    return merged.select("document_id", "clause_id", "origin", "type", "ord")


# ---- CVs ---------------------------------------------------------------------------------------------------------------------

_CV = [
    (0, "Sara {k}", False), (1, "sara{k}@example.com", False), (2, "Education", True), (3, "Bachelor of Science, 2015", False), (4, "King Saud University", False), (5, "Experience", True),
    (6, "Analyst at Acme 2016 - 2019", False), (7, "Lead, Beta", False), (8, "2020 - Present", False), (9, "Hobbies", True), (10, "Chess", False),
]
_LINE = "line_no int, text string, is_heading boolean"
_TITLES = [("education", "education"), ("experience", "experience")]


def _cv(spark, sf, section: str | None = None) -> DataFrame:
    lines = per_customer(spark, sf, _LINE, _CV)
    if section is None:
        return lines
    return CV.cv_sections(lines, spark.createDataFrame(_TITLES, "title_key string, section string")).where(F.col("section") == section)


@query("cvx01_sections", rows_sql("line_no int, section string", [(3, "education"), (4, "education"), (6, "experience"), (7, "experience"), (8, "experience")]))
def _(spark, sf):
    return CV.cv_sections(_cv(spark, sf), spark.createDataFrame(_TITLES, "title_key string, section string")).select("document_id", "line_no", "section")


#: An order as a CV: its lines are headings with and without level, known titles and texts.
_LEVELLED = {
    "text": "CASE (s + n) % 6 WHEN 0 THEN 'Skills' WHEN 1 THEN 'Part ' || q WHEN 2 THEN 'Education:' WHEN 3 THEN 'References' WHEN 4 THEN 'Noor Al Amri' ELSE 'line ' || q END",
    "is_heading": "(s + n) % 6 < 5", "level": "CASE WHEN q % 5 > 0 THEN q % 3 + 1 END", "line_no": "unit_no * 1000000 + s * 100 + q",
}
_LEVEL_TITLES = [("skills", "skills"), ("education", "education"), ("references", "_other")]
_LEVEL_SQL = f"""WITH {items_sql(**_LEVELLED)}, k AS (SELECT *, CASE (s + n) % 6 WHEN 0 THEN 'skills' WHEN 2 THEN 'education' WHEN 3 THEN '_other' END AS section FROM u)"""


@query(
    "cvx01_levels",
    f"""{_LEVEL_SQL}, h AS (SELECT a.document_id, a.line_no, a.text, max(b.line_no) AS at FROM k a JOIN k b ON b.document_id = a.document_id AND b.line_no < a.line_no AND b.section IS NOT NULL WHERE a.section IS NULL GROUP BY ALL)
    SELECT h.document_id, h.line_no, t.section, h.text FROM h JOIN k t ON t.document_id = h.document_id AND t.line_no = h.at WHERE t.section <> '_other' AND NOT EXISTS
    (SELECT 1 FROM k c WHERE c.document_id = h.document_id AND c.line_no > h.at AND c.line_no <= h.line_no AND c.section IS NULL AND c.is_heading AND c.level <= t.level)""",
)
def _(spark, sf):
    lines = items(spark, sf, **_LEVELLED)
    return CV.cv_sections_by_level(lines, spark.createDataFrame(_LEVEL_TITLES, "title_key string, section string")).select("document_id", "line_no", "section", "text")


@query(
    "cvx06_titles",
    f"""{_LEVEL_SQL}, f AS (SELECT document_id, min(line_no) FILTER (section <> '_other') AS first, min(line_no) FILTER (section IS NULL AND is_heading) AS found_at FROM k GROUP BY document_id)
    SELECT f.document_id, k.line_no, text AS title, (s + n) % 6 = 4 AS is_name FROM f JOIN k ON k.document_id = f.document_id AND line_no = found_at WHERE first IS NULL OR found_at < first""",
)
def _(spark, sf):
    lines = items(spark, sf, **_LEVELLED)
    return CV.cv_titles(lines, spark.createDataFrame(_LEVEL_TITLES, "title_key string, section string"))


@query(
    "doc07_heading_parents",
    f"""{_LEVEL_SQL} SELECT a.document_id, a.line_no, (SELECT max(b.line_no) FROM k b WHERE b.document_id = a.document_id AND b.line_no < a.line_no AND b.level < a.level) AS parent FROM k a WHERE level IS NOT NULL""",
)
def _(spark, sf):
    heads = items(spark, sf, **_LEVELLED).where("level IS NOT NULL").selectExpr("document_id", "line_no", "level")
    return CV.heading_parents(heads).select("document_id", "line_no", "parent")


@query("cvx03_languages", rows_sql("ord int, language string, level string", [(0, "English", "fluent"), (1, "Arabic", "native"), (2, "French", None)]))
def _(spark, sf):
    ordered = per_customer(spark, sf, "ord int, item string", [(0, "English (Fluent)"), (1, "Arabic - native"), (2, "French")])
    read = CV.cv_languages(ordered)
    return read.join(spark.createDataFrame([("English", 0), ("Arabic", 1), ("French", 2)], "language string, ord int"), "language").select("document_id", "ord", "language", "level")


@query("cvx03_certificates", rows_sql("certificate string, year int", [("PMP {k}", 2019), ("CPA", None), ("ITIL", 2021)]))
def _(spark, sf):
    return CV.cv_certs(per_customer(spark, sf, "item string", [("PMP {k} (2019)",), ("CPA",), ("ITIL, 2021",)]))


@query("cvx04_education", rows_sql("degree string, institution string, years string", [("Bachelor of Science, 2015", "King Saud University", "2015")]))
def _(spark, sf):
    return CV.cv_education(_cv(spark, sf, "education")).select("document_id", "degree", "institution", F.array_join("years", ",").alias("years"))


@query("cvx05_experience", rows_sql("line_no int, title string, organisation string, start int, end int, current boolean", [(6, "Analyst", "Acme", 2016, 2019, False), (8, None, None, 2020, None, True)]))
def _(spark, sf):
    return CV.cv_experience(_cv(spark, sf, "experience")).drop("header")


@query("cvx06_contact", rows_sql("field string, ord int, key string", [("name", 0, "Sara {k}"), ("email", 1, "sara{k}@example.com"), ("phone", 2, "+966 50 123 4567")]))
def _(spark, sf):
    lines = per_customer(spark, sf, "line_no int, text string", [(0, "Sara {k}"), (1, "sara{k}@example.com"), (2, "+966 50 123 4567"), (3, "2015 - 2019")])
    # a name has no figure, so the customer's key stands for letters here
    read = CV.cv_contact(lines.withColumn("text", F.when(F.col("line_no") == 0, F.translate("text", "0123456789", "abcdefghij")).otherwise(F.col("text"))))
    back = F.when(F.col("field") == "name", F.concat(F.lit("Sara "), F.translate(F.substring("key", 6, 20), "abcdefghij", "0123456789"))).otherwise(F.col("key"))
    return read.select("document_id", "field", "ord", back.alias("key"))


@query("cvx07_requirements", rows_sql("requirement_type string, requirement string, required boolean", [("title", "Analyst {k}", False), ("skill", "sql", True), ("skill", "python", True), ("skill", "excel", False)]))
def _(spark, sf):
    jobs = per_customer(spark, sf, "title string, required_skills array<string>, preferred_skills array<string>", [("Analyst {k}", ("sql", "python"), ("excel",))])
    return CV.requirement_plan(jobs.withColumnRenamed("document_id", "job_id")).withColumnRenamed("job_id", "document_id")


_CV_ITEMS = {
    "cv_field": "CASE n WHEN 2 THEN 'work_experience' WHEN 3 THEN 'summary' WHEN 4 THEN 'education' WHEN 5 THEN 'certifications' WHEN 6 THEN 'languages' ELSE 'skills' END",
    "text": "CASE n WHEN 2 THEN 'title' || (s % 3) || ' grade' || (q % 2) || ' know' || (q % 4) WHEN 3 THEN 'title' || (q % 3) || ' grade' || (s % 2) WHEN 4 THEN 'degree' || (s % 3)"
    " WHEN 6 THEN 'lang' || (q % 3) ELSE 'know' || (s % 4) || ' tool' || (q % 5) END",
}
_JOB = {
    "title": ("'title' || (j % 3) || ' grade1'",), "required_skills": ("'know' || (j % 4) || ' tool' || (j % 5)", "'know3'"), "preferred_skills": ("'tool4'",),
    "required_education": ("'degree' || (j % 3)",), "required_certifications": ("'know' || (j % 4) || ' tool1'",), "required_languages": ("'lang' || (j % 3)",),
}


def _plan_sql() -> str:
    parts, no = [], 0
    for kind, column, importance, primary, others in CV.KINDS:
        for text in _JOB[column]:
            parts.append(f"SELECT j AS job_id, {no} AS no, '{kind}' AS kind, {text} AS req, '{importance}' AS imp, '{primary}' AS prim, {[primary, *others]} AS searched FROM jobs")
            no += 1
    parts.append(f"SELECT j, {no}, '{CV.YEARS}', '3 years', 'required', 'work_experience', ['work_experience'] FROM jobs WHERE j % 2 = 1")
    return " UNION ALL ".join(parts)


_LADDER_SQL = f"""WITH {items_sql(**_CV_ITEMS)}, tok AS (SELECT document_id, cv_field, unit_no, unnest(list_distinct(string_split(text, ' '))) AS word FROM u),
    jobs AS (SELECT n_nationkey AS j FROM nation), plan AS ({_plan_sql()}), r AS (SELECT o_orderkey AS document_id, plan.* FROM orders JOIN plan ON job_id = o_orderkey % 25),
    w AS (SELECT document_id, job_id, no, prim, searched, word, len(words) AS need FROM (SELECT *, unnest(words) AS word FROM (SELECT *, list_distinct(string_split(req, ' ')) AS words FROM r WHERE kind <> '{CV.YEARS}'))),
    m AS (SELECT document_id, job_id, no, cv_field, unit_no, count(*) = any_value(need) AS whole, cv_field = any_value(prim) AS first FROM w JOIN tok USING (document_id, word) WHERE list_contains(searched, cv_field) GROUP BY document_id, job_id, no, cv_field, unit_no),
    g AS (SELECT document_id, job_id, no, bool_or(whole AND first) AS explicit, bool_or(whole AND NOT first) AS other, bool_or(first) AS part FROM m GROUP BY ALL),
    f AS (SELECT DISTINCT document_id, cv_field FROM u WHERE line = 'O' OR q > 20), h AS (SELECT DISTINCT document_id, job_id, no FROM r JOIN u USING (document_id) WHERE list_contains(searched, cv_field)),
    o AS (SELECT r.document_id, r.job_id, r.no, imp, CASE WHEN kind = '{CV.YEARS}' THEN 'insufficient/years not reckoned' WHEN explicit THEN 'explicit/all in the primary field' WHEN other THEN 'partial/all in another field'
      WHEN part THEN 'partial/a part in the primary field' WHEN f.cv_field IS NULL THEN 'insufficient/primary field not found' WHEN kind <> 'language' AND h.no IS NULL THEN 'insufficient/other script' ELSE 'missing/not stated' END AS outcome
      FROM r LEFT JOIN g USING (document_id, job_id, no) LEFT JOIN f ON f.document_id = r.document_id AND f.cv_field = prim LEFT JOIN h ON h.document_id = r.document_id AND h.job_id = r.job_id AND h.no = r.no)"""


def _assessed(spark, sf):
    u = items(spark, sf, **_CV_ITEMS)
    jobs = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("j"))
    lists = [f"array({', '.join(texts)}) AS {c}" for c, texts in _JOB.items() if c != "title"]
    jobs = jobs.selectExpr("j AS job_id", f"{_JOB['title'][0]} AS title", *lists, "CASE WHEN j % 2 = 1 THEN 3.0D END AS minimum_years_experience")
    applied = read_table(spark, sf, "orders").selectExpr("o_orderkey % 25 AS job_id", "o_orderkey AS document_id")
    found = u.where("line = 'O' OR q > 20").select("document_id", "cv_field")
    return CV.assess_jobs(CV.job_plan(jobs), applied, u.selectExpr("document_id", "cv_field", "unit_no AS text_no", "text"), found)


@query("cvx08_ladder", f"{_LADDER_SQL} SELECT document_id, job_id, no, outcome FROM o")
def _(spark, sf):
    """Every order is a CV whose lines are its texts, and applies to the job of a nation."""
    return _assessed(spark, sf).select("document_id", "job_id", "no", F.concat_ws("/", "status", "reason").alias("outcome"))


@query(
    "cvx10_overview",
    f"""{_LADDER_SQL} SELECT document_id, job_id, CASE WHEN bool_or(imp = 'required' AND outcome LIKE 'missing%') THEN 'gaps_identified' WHEN bool_or(imp = 'required' AND outcome LIKE 'insufficient%') THEN 'insufficient_information'
    WHEN bool_and(outcome LIKE 'explicit%') FILTER (imp = 'required') THEN 'required_requirements_explicitly_met' ELSE 'partially_evidenced' END AS overall,
    count(*) FILTER (outcome LIKE 'explicit%') AS explicit, count(*) FILTER (outcome LIKE 'missing%') AS missing FROM o GROUP BY ALL""",
)
def _(spark, sf):
    return CV.job_overview(_assessed(spark, sf)).select("document_id", "job_id", "overall", "explicit", "missing")


@query("cvx09_languages", rows_sql("ord int, language string", [(0, "arabic"), (1, "english"), (2, "klingon")]))
def _(spark, sf):
    rows = per_customer(spark, sf, "ord int, language string", [(0, " العربية "), (1, "English"), (2, "Klingon")])
    return CV.language_alias(rows, spark.createDataFrame([("العربية", "arabic"), ("english", "english")], "alias string, name string"))


@query("cvx11_observations", f"""WITH {items_sql()}, g AS (SELECT document_id, bool_or(flag = 'A') AS x, bool_or(flag = 'N') AS e, count(*) FILTER (s % 2 = 0) AS undated, count(*) FILTER (s % 3 = 0) AS untitled FROM u GROUP BY document_id)
    SELECT document_id, 'no experience section' AS observation FROM g WHERE NOT x UNION ALL SELECT document_id, 'no education section' FROM g WHERE NOT e
    UNION ALL SELECT document_id, 'undated entries' FROM g WHERE undated > 0 UNION ALL SELECT document_id, 'entries without a title' FROM g WHERE untitled > 0""")
def _(spark, sf):
    u = items(spark, sf)
    cvs = u.groupBy("document_id").agg(
        F.collect_set(F.when(F.col("flag") == "A", "experience").when(F.col("flag") == "N", "education").otherwise("skills")).alias("sections"),
        F.count_if(F.col("s") % 2 == 0).alias("undated"), F.count_if(F.col("s") % 3 == 0).alias("untitled"),
    )
    return CV.cv_observations(cvs)
