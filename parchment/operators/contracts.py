"""Rule tables for employment contracts, English and Arabic, and contracts read from end to end.

Phrases are in the folded form of ``matching_key`` and match at the start of a word, Arabic ones anywhere.  All tables are
defaults: every function takes others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import values as V
from parchment.functions.text import has_phrase, matching_key
from parchment.operators import clauses as C
from parchment.operators import extract as X
from parchment.operators import structure as S

#: Tasks that contracts are dealt out to, for each core.
TASKS_A_CORE = 4


def phrases(*found: str) -> str:
    """A pattern for folded text: any of the phrases, at a word's start where they are Latin."""
    arabic = [p for p in found if "؀" <= p[0] <= "ۿ"]
    latin = [p for p in found if p not in arabic]
    return "|".join([*([rf"(?:^|\s)(?:{'|'.join(latin)})"] if latin else []), *arabic])


# The names of the clause types.  Words and order are chosen here: special subjects before general ones, so that a
# housing allowance is housing and notice of termination is notice.
#: Clause types by the first rule that fits: words of which one must stand, and words that forbid it.
_SENTENCE_WORDS: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("NOTICE", ("notice of", "notice period", "days notice", "months notice", "مده الاشعار", "اشعار كتابي"), ("terminate",)),
    ("PROBATION", ("probation", "trial period", "فتره التجربه", "مده التجربه"), ()),
    ("SICK_LEAVE", ("sick", "illness", "اجازه مرضيه"), ()),
    ("ANNUAL_LEAVE", ("annual leave", "yearly leave", "paid vacation", "اجازه سنويه"), ()),
    ("OVERTIME", ("overtime", "extra hours", "additional hours", "ساعات اضافيه", "العمل الاضافي"), ()),
    ("WORKING_HOURS", ("working hours", "hours of work", "hours per", "hours a day", "hours a week", "ساعات العمل"), ()),
    ("WEEKLY_REST", ("weekly rest", "day of rest", "rest day", "الراحه الاسبوعيه"), ()),
    ("TERMINATION", ("terminat", "dismiss", "end of this contract", "انهاء", "فسخ"), ()),
    ("HEALTH_INSURANCE", ("medical insurance", "health insurance", "medical cover", "التامين الطبي", "التامين الصحي"), ()),
    ("HOUSING", ("housing", "accommodation", "بدل سكن"), ()),
    ("TRANSPORTATION", ("transport", "commut", "بدل نقل", "المواصلات"), ()),
    ("NON_COMPETE", ("compete", "competing", "competitor", "منافسه", "المنافسه"), ()),
    ("CONFIDENTIALITY", ("confidential", "secrecy", "trade secret", "السريه", "اسرار"), ()),
    ("DISCIPLINARY", ("disciplin", "penalt", "misconduct", "الجزاءات", "التاديب"), ()),
    ("BENEFITS", ("bonus", "benefit", "air ticket", "مكافاه", "المزايا"), ()),
    ("ALLOWANCES", ("allowance", "بدل"), ()),
    ("SALARY", ("salary", "wage", "remunerat", "basic pay", "الراتب", "الاجر"), ()),
    ("DUTIES", ("duties", "responsib", "reports to", "المهام", "الواجبات"), ()),
    ("CONTRACT_DURATION", ("contract period", "term of this contract", "term of the contract", "مده العقد"), ()),
    ("WORK_LOCATION", ("place of work", "work location", "workplace", "مكان العمل", "مقر العمل"), ()),
    ("EMPLOYMENT", ("is employed as", "appointed as", "position of", "وظيفه"), ()),
)
# The types of headings, the order in which they are tried (the first that fits decides) and their English words must
# be these for the same headings to get the same types.  The Arabic words are added here.
_HEADING_WORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("DUTIES", ("duties", "responsibilities", "المهام")),
    ("CONFIDENTIALITY", ("confidential", "السريه")),
    ("ANNUAL_LEAVE", ("leave policy", "annual leave", "vacation", "الاجازات", "الاجازه")),
    ("HEALTH_INSURANCE", ("health insurance", "التامين")),
    ("BENEFITS", ("benefit", "perk", "bonus", "المزايا")),
    ("SALARY", ("compensation", "salary", "in hand", "inhand", "remuneration", "الاجر", "الراتب")),
    ("ALLOWANCES", ("allowance", "البدلات")),
    ("TERMINATION", ("terminat", "انهاء العقد")),
    ("NOTICE", ("notice", "الاشعار")),
    ("PROBATION", ("probation", "التجربه")),
    ("WORKING_HOURS", ("working hours", "hours of work", "ساعات العمل")),
    ("DISCIPLINARY", ("disciplinary", "conduct", "الجزاءات")),
    ("EMPLOYMENT", ("appointment", "terms and conditions", "employment", "التعيين")),
)
SENTENCE_RULES = [{"type": t, "words": w, "without": x} for t, w, x in _SENTENCE_WORDS]
HEADING_RULES = [{"type": t, "pattern": phrases(*w)} for t, w in _HEADING_WORDS]


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # text, money, duration, date or hours
    labels: tuple[str, ...]
    cues: tuple[str, ...] = ()  # of sentences that state it without a label


FIELDS = (
    Field("employee_name", "text", ("employee name", "name of employee", "employee", "اسم الموظف", "الطرف الثاني")),
    Field("employer_name", "text", ("employer", "company", "employer name", "الطرف الاول", "صاحب العمل")),
    Field("job_title", "text", ("job title", "position", "designation", "المسمي الوظيفي", "المهنه")),
    Field("nationality", "text", ("nationality", "الجنسيه")),
    Field("work_location", "text", ("work location", "place of work", "location", "مكان العمل")),
    Field("contract_type", "text", ("contract type", "type of contract", "نوع العقد")),
    Field("start_date", "date", ("start date", "joining date", "commencement date", "تاريخ المباشره", "تاريخ البدايه")),
    Field("end_date", "date", ("end date", "expiry date", "تاريخ النهايه", "تاريخ الانتهاء")),
    Field("contract_duration", "duration", ("contract duration", "contract period", "term", "مده العقد"), ("contract period", "term of the contract", "مده العقد")),
    Field("probation_period", "duration", ("probation", "probation period", "trial period", "مده التجربه", "فتره التجربه"), ("probation", "trial period", "مده التجربه", "فتره التجربه")),
    Field("notice_period", "duration", ("notice", "notice period", "مده الاشعار", "فتره الاشعار"), ("notice", "اشعار")),
    Field("annual_leave", "duration", ("annual leave", "vacation", "leave", "الاجازه السنويه"), ("annual leave", "paid vacation", "اجازه سنويه")),
    Field("sick_leave", "duration", ("sick leave", "الاجازه المرضيه"), ("sick leave", "اجازه مرضيه")),
    Field("working_hours", "hours", ("working hours", "hours of work", "ساعات العمل"), ("working hours", "hours of work", "ساعات العمل", "hours per")),
    Field("basic_salary", "money", ("basic salary", "basic pay", "base salary", "الراتب الاساسي", "الاجر الاساسي"), ("basic salary", "base salary", "الراتب الاساسي")),
    Field("housing_allowance", "money", ("housing allowance", "housing", "بدل سكن", "بدل السكن"), ("housing allowance", "بدل السكن")),
    Field("transport_allowance", "money", ("transport allowance", "transportation allowance", "transportation", "بدل نقل", "بدل النقل"), ("transport allowance", "بدل النقل")),
    Field("food_allowance", "money", ("food allowance", "meal allowance", "بدل طعام"), ("food allowance",)),
    Field("total_salary", "money", ("total salary", "total", "gross salary", "اجمالي الراتب", "الاجمالي"), ("total salary", "gross salary", "اجمالي الراتب")),
    Field("in_hand_salary", "money", ("in hand salary", "net salary", "صافي الراتب"), ("net salary", "صافي الراتب")),
)


def specs(spark, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """(field, kind, label_key)."""
    return spark.createDataFrame([(f.name, f.kind, k) for f in fields for k in f.labels], "field string, kind string, label_key string")


def canonical(rows: DataFrame) -> DataFrame:
    """rows(document_id, field, kind, ord, raw, source, method) -> candidates with ``key``: texts as they are, others as their one
    reading in canonical form, null where it can't be read or is not the only one."""

    def form(r: Column) -> Column:
        value = F.regexp_replace(r["value"].cast("string"), r"\.0$", "")
        return (
            F.when(r["kind"] == "duration", V.normalized_duration(r["value"], r["unit"], r["qualifier"]))
            .when(r["kind"] == "money", V.normalized_money(r["value"], r["currency"], r["period"]))
            .when(r["kind"] == "hours", F.concat_ws(" ", value, F.lit("hours"), F.concat(F.lit("per "), r["unit"])))
            .otherwise(r["iso_date"].cast("string"))
        )

    # one pass over the texts, beside their rows; a text's readings of its own kind count
    read = X.with_readings(rows, F.when(F.col("kind") != "text", F.col("raw")), "duration", "money", "hours", "date", require_currency=False)
    read = read.withColumn("own", F.filter("readings", lambda r: r["kind"] == F.col("kind")))
    read = read.withColumn("forms", F.array_distinct(F.array_compact(F.transform("own", form))))  # a column, so that it is made once
    ok = F.forall("own", lambda r: r["value"].isNotNull() | r["iso_date"].isNotNull())
    reading = F.when(ok & (F.size("forms") == 1), F.col("forms")[0])
    key = F.when(F.col("kind") == "text", F.nullif(F.trim("raw"), F.lit(""))).otherwise(reading)
    return read.select("document_id", "field", "ord", key.alias("key"), "raw", "source", "method")


def labelled(lines: DataFrame, known: DataFrame) -> DataFrame:
    """lines(document_id, line_no, text) -> (document_id, field, kind, ord, raw, source, method) of known labels."""
    pairs = S.labeled_values(lines).select("document_id", (F.col("line_no") * 100 + F.col("part_no")).alias("ord"), "label", "value", "method")
    return X.label_candidates(pairs, known).select("document_id", "field", "kind", "ord", F.col("value").alias("raw"), F.col("value").alias("source"), "method")


def narrated(sentences: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """sentences(document_id, no, text) -> the same columns for sentences with a field's cue, that are no labelled lines."""
    key = F.col("_key")  # a column, so that the patterns share it
    tried = [F.when(has_phrase(key, f.cues), F.struct(F.lit(f.name).alias("field"), F.lit(f.kind).alias("kind"))) for f in fields if f.cues]
    plain = sentences.where(~F.col("text").rlike("[:：\t]")).withColumn("_key", matching_key(F.col("text")))
    return plain.select("document_id", F.inline(F.array_compact(F.array(*tried))), (F.col("no") * 100).alias("ord"), "text").select(
        "document_id", "field", "kind", "ord", F.col("text").alias("raw"), F.col("text").alias("source"), F.lit("narrative").alias("method")
    )


def read_fields(docs: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """docs(document_id, text) -> (document_id, field, path, status, key) of every field that is stated: by a label, else in a sentence."""
    from parchment.functions.text import lines as lines_of
    from parchment.functions.text import sentences as sentences_of

    known = specs(docs.sparkSession, fields)
    # dealt out once by document: all steps below are within one, and the work is in the texts, whatever files they came in
    docs = docs.select("document_id", "text").repartition(TASKS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism, "document_id")
    lines = docs.select("document_id", lines_of(F.col("text")).alias("l"))
    pairs = F.transform("l", lambda x, i: F.struct(x.alias("text"), F.get("l", i + 1).alias("next")))
    lines = lines.select("document_id", F.posexplode(pairs).alias("line_no", "p")).select("document_id", "line_no", "p.text", "p.next")
    told = docs.select("document_id", F.posexplode(sentences_of(F.col("text"))).alias("no", "text"))
    # one pass of the readers and one grouping for both ways
    read = canonical(labelled(lines, known).unionByName(narrated(told, fields)))
    return X.resolve_paths(read.withColumn("path", F.when(F.col("method") == "narrative", "narrative").otherwise("label")))


def read_clauses(docs: DataFrame) -> DataFrame:
    """docs(document_id, text) -> classified clauses (document_id, clause_no, type, text)."""
    from parchment.functions.text import sentences as sentences_of

    told = docs.select(F.col("document_id").alias("section_id"), F.posexplode(sentences_of(F.col("text"))).alias("pos", "text"))
    keyed = told.withColumn("_key", matching_key(F.col("text")))
    return C.segment(keyed.withColumn("type", C.classify(F.col("_key"), SENTENCE_RULES)).drop("_key")).withColumnRenamed("section_id", "document_id")


def duration_facts(fields: DataFrame) -> DataFrame:
    """(document_id, field, value, unit) of found fields in canonical duration form."""
    parts = F.split("key", " ")
    rows = fields.where((F.col("status") == "found") & F.col("key").rlike(r"^\d+(?:\.\d+)? (?:[a-z]+ )?(?:day|week|month|year)$"))
    return rows.select("document_id", "field", parts[0].cast("double").alias("value"), F.element_at(parts, -1).alias("unit"))


def check_fields(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """facts(document_id, field, value, unit) with rules(rule_id, field, rule_type, value, value_max, unit) -> (document_id, field, status)."""
    from parchment.operators import rules as L

    rules = F.broadcast(rules)
    linked = facts.join(rules.select("rule_id", "field"), "field").withColumns(
        {"fact_id": F.struct("document_id", "field", "rule_id"), "source_text": F.lit(None).cast("string")}
    )
    judged = L.finding_status(L.compare(linked.select("fact_id", "rule_id", "value", "unit", "source_text"), rules.drop("field")))
    return judged.select("fact_id.document_id", "fact_id.field", "status")
