"""Extraction: candidate readings from text rows and rule tables, resolved to one field with a status.

candidates: (document_id, field, ord, key, raw, source, method); key is the reading's canonical form, null if unreadable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import FOLD_FROM, FOLD_TO, label_keys, matching_key, to_ascii_digits
from parchment.operators.spans import (  # noqa: F401 - the readers are part of this module's operators
    ARABIC_NUMBERS,
    NUMBER_WORDS,
    dates,
    durations,
    hours,
    money,
    percentages,
    read_values,
    with_readings,
    working_day_counts,
)

STRONG_METHODS = ("table_row", "labeled_line")
CONFIDENCE = ("low", "medium", "high")
STATUSES = ("found", "not_found", "ambiguous", "not_applicable", "not_extracted")


def number_words(tokens: Column) -> Column:
    """Value of an array of English number words: tens and units add, ``hundred`` multiplies; null with an unknown word."""
    table = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    known = F.filter(tokens, lambda t: t != "and")
    start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("ok"))

    def step(a: Column, t: Column) -> Column:
        v = table[t]
        return F.when(
            t == "hundred", F.struct((F.greatest(a["sum"], F.lit(1)) * 100).alias("sum"), a["ok"].alias("ok"))
        ).otherwise(F.struct((a["sum"] + F.coalesce(v, F.lit(0))).alias("sum"), (a["ok"] & v.isNotNull()).alias("ok")))

    return F.aggregate(known, start, step, lambda a: F.when(a["ok"] & (a["sum"] > 0), a["sum"]))


def folded(text: Column) -> Column:
    """Digits and Arabic letters in one form each; everything else as it is."""
    return F.translate(to_ascii_digits(text), FOLD_FROM, FOLD_TO)


# Days of the week, Sunday first, and their Arabic names, folded.
DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
ARABIC_DAYS = ("الاحد", "الاثنين", "الثلاثاء", "الاربعاء", "الخميس", "الجمعه", "السبت")


def working_days(text: Column) -> Column:
    """Array of day names: a range ``x to y``, which may wrap round the week, or a list of two or more."""
    low = F.lower(folded(text))
    for arabic, english in zip(ARABIC_DAYS, DAYS):
        low = F.replace(low, F.lit(arabic), F.lit(english))
    name = "|".join(DAYS)
    to = r"\s*(?:to|through|-|–|الي|حتي)\s*"
    week = F.array(*[F.lit(d) for d in DAYS])
    a = F.regexp_extract(low, rf"({name}){to}({name})", 1)
    b = F.regexp_extract(low, rf"({name}){to}({name})", 2)
    i, j = F.array_position(week, a).cast("int"), F.array_position(week, b).cast("int")
    span = F.transform(F.sequence(F.lit(0), F.pmod(j - i, F.lit(7))), lambda k: F.element_at(week, F.pmod(i - 1 + k, F.lit(7)) + 1))
    listed = F.array_distinct(F.regexp_extract_all(low, F.lit(f"({name})"), F.lit(1)))
    return F.when(a != "", span).when(F.size(listed) >= 2, listed)


def label_candidates(pairs: DataFrame, specs: DataFrame) -> DataFrame:
    """pairs(document_id, ord, label, value) x specs(field, label_key): every field whose key the label has.
    The specs are a rule table and go to the tasks; the pairs stay where they are."""
    keyed = pairs.select("*", F.explode(label_keys(F.col("label"))).alias("label_key"))
    return keyed.join(F.broadcast(specs), "label_key").drop("label_key").distinct()


def keyword_candidates(sentences: DataFrame, specs: DataFrame, guards: DataFrame) -> DataFrame:
    """sentences(document_id, no, text) x specs(field, keyword) not refused by guards(field, pattern) in this or the previous sentence.

    Both tables are rules, a short list, and become one expression over the sentences."""
    w = Window.partitionBy("document_id").orderBy("no")
    s = sentences.select("*", F.concat_ws(" ", F.lag("text").over(w), "text").alias("context"), F.concat(F.lit(" "), matching_key(F.col("text"))).alias("k"))
    refused: dict[str, list[str]] = {}
    for g in guards.collect():
        refused.setdefault(g["field"], []).append(f"(?:{g['pattern']})")
    tried = []
    for r in specs.collect():
        hit = F.contains("k", F.lit(" " + r["keyword"]))
        if r["field"] in refused:
            hit = hit & ~F.col("context").rlike(_any_pattern(refused[r["field"]]))
        tried.append(F.when(hit, F.lit(r["field"])))
    return s.select("document_id", "no", F.explode(F.array_compact(F.array(*tried))).alias("field"), "text")


def _any_pattern(patterns: list[str]) -> str:
    """One pattern for several; flags at the front of one hold for all of it."""
    flags = sorted({f for p in patterns for f in (["(?i)"] if "(?i)" in p else [])})
    return "".join(flags) + "|".join(p.replace("(?i)", "") for p in patterns)


def narrative_candidates(units: DataFrame, rules: list[dict]) -> DataFrame:
    """units(document_id, no, text) x rules {priority, field, pattern, excludes, max_chars}: value of the pattern's first group.
    One pattern of all rules sorts out the units that no rule can read before the rules are tried."""
    some = "|".join(f"(?:{r['pattern']})" for r in rules)
    tried = [
        F.when(
            ~F.col("text").rlike(r["excludes"]) if r.get("excludes") else F.lit(True),
            F.struct(
                F.lit(r["priority"]).alias("priority"), F.lit(r["field"]).alias("field"),
                F.nullif(F.substring(F.regexp_extract("text", r["pattern"], 1), 1, r.get("max_chars", 200)), F.lit("")).alias("raw"),
            ),
        )
        for r in rules
    ]
    rows = units.where(F.col("text").rlike(some)).select("document_id", "no", F.inline(F.array_compact(F.array(*tried))))
    order = Window.partitionBy("document_id", "field", "raw").orderBy("no", "priority")
    return rows.where("raw IS NOT NULL").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def negations(units: DataFrame, rules: DataFrame) -> DataFrame:
    """units(document_id, no, text) x the short list rules(field, pattern) -> the first sentence that denies each field."""
    tried = [F.when(F.col("text").rlike(r["pattern"]), F.lit(r["field"])) for r in rules.collect()]
    hit = units.select("document_id", "no", "text", F.explode(F.array_compact(F.array(*tried))).alias("field"))
    return hit.groupBy("document_id", "field").agg(F.min_by("text", "no").alias("source"), F.min("no").alias("no"))


def verbatim(candidates: DataFrame) -> DataFrame:
    """Candidates whose raw text is in their source, white space aside."""
    def flat(c: str) -> Column:
        return F.trim(F.regexp_replace(c, r"\s+", " "))

    return candidates.where(F.contains(flat("source"), flat("raw")))


def dedupe(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first of the candidates with equal keys."""
    w = Window.partitionBy("document_id", "field", *keys).orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve(candidates: DataFrame) -> DataFrame:
    """(document_id, field, status, key, confidence, n): ambiguous with any unreadable candidate or several keys, else the first
    reading; confidence is high if any source method is strong.

    Keys differ if the least and the greatest do, and a single one is both: no distinct count, which would shuffle all keys once more."""
    many = (F.count_if(F.col("key").isNull()) > 0) | (F.min("key") < F.max("key"))
    strong = F.bool_or(F.col("method").isin(*STRONG_METHODS))
    return candidates.groupBy("document_id", "field").agg(
        F.when(many, "ambiguous").otherwise("found").alias("status"),
        F.when(~many, F.min("key")).alias("key"),
        F.when(strong, "high").otherwise("medium").alias("confidence"),
        F.count("*").alias("n"),
    )


def resolve_paths(candidates: DataFrame) -> DataFrame:
    """candidates(document_id, field, path, key), path being label or narrative -> (document_id, field, path, status, key): what
    ``merge_semantic`` gives for the resolved candidates of either path, from one grouping.  A narrative without a reading says nothing."""

    def of(path: str, value: Column) -> Column:
        return F.when(F.col("path") == path, value)

    key = F.col("key")
    g = candidates.groupBy("document_id", "field").agg(
        F.count_if(F.col("path") == "label").alias("n"), F.count_if((F.col("path") == "label") & key.isNull()).alias("unread"),
        F.min(of("label", key)).alias("k1"), F.max(of("label", key)).alias("l1"), F.min(of("narrative", key)).alias("k2"), F.max(of("narrative", key)).alias("l2"),
    )
    one = (F.col("n") > 0) & (F.col("unread") == 0) & (F.col("k1") == F.col("l1"))
    two = F.coalesce(F.col("k2") == F.col("l2"), F.lit(False))
    told = F.when(F.col("n") > 0, "label").when(F.col("k2").isNotNull(), "narrative")
    path = F.when(one, "label").when(two, "narrative").otherwise(told)
    return g.where((F.col("n") > 0) | F.col("k2").isNotNull()).select(
        "document_id", "field", path.alias("path"), F.when(one | two, "found").otherwise("ambiguous").alias("status"),
        F.when(one, F.col("k1")).when(two, F.col("k2")).alias("key"),
    )


def resolve_list(candidates: DataFrame) -> DataFrame:
    items = F.transform(F.sort_array(F.collect_list(F.struct("ord", "key"))), lambda x: x["key"])
    return candidates.where("key IS NOT NULL").groupBy("document_id", "field").agg(F.array_distinct(items).alias("items"))


def merge_money(candidates: DataFrame) -> DataFrame:
    """(document_id, field, amount, currency, period, agree): one amount, one currency and one period at most; nulls give way."""
    cols = ("amount", "currency", "period")
    agree = (F.countDistinct("amount") == 1) & (F.countDistinct("currency") <= 1) & (F.countDistinct("period") <= 1)
    agg = candidates.groupBy("document_id", "field").agg(*[F.max(c).alias(c) for c in cols], agree.alias("agree"))
    return agg.select("document_id", "field", *[F.when(F.col("agree"), F.col(c)).alias(c) for c in cols], "agree")


def merge_hours(candidates: DataFrame) -> DataFrame:
    """Hours per day, per week and without either may stand together; several of one kind may not."""
    by = candidates.groupBy("document_id", "per").agg(F.countDistinct("hours").alias("n"), F.max("hours").alias("hours"))
    return by.groupBy("document_id").agg(
        F.max(F.when(F.col("per") == "day", F.col("hours"))).alias("per_day"),
        F.max(F.when(F.col("per") == "week", F.col("hours"))).alias("per_week"),
        (F.max("n") <= 1).alias("agree"),
    )


def merge_days(named: Column, count: Column) -> Column:
    """Named days, if their number is the count written beside them or none is."""
    return F.when(named.isNull(), F.lit(None)).when(count.isNull() | (F.size(named) == count), named)


def other_allowances(pairs: DataFrame, specs: DataFrame) -> DataFrame:
    """Labels that no field knows and that read as an allowance."""
    keyed = pairs.withColumn("k", matching_key(F.col("label")))
    free = keyed.join(F.broadcast(specs.select(F.col("label_key").alias("k"))), "k", "left_anti")
    return free.where(F.col("k").rlike(r"^بدل |\ballowances?$")).drop("k")


def bullet_runs(lines: DataFrame, cue: str, bullets: str = "•●▪◦‣–*·-") -> DataFrame:
    """lines(document_id, line_no, text): bullets directly after a line that fits the cue, up to the first line that is none."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    mark = F.trim("text").rlike(f"^[{bullets}]")
    head = F.col("text").rlike(cue) & ~mark
    runs = lines.withColumn("mark", mark).withColumn("run", F.sum((~mark).cast("int")).over(w)).withColumn("head", head)
    opened = F.max(F.col("head").cast("int")).over(Window.partitionBy("document_id", "run"))
    return runs.withColumn("opened", opened).where("mark AND opened = 1").select(
        "document_id", "line_no", F.trim(F.regexp_replace("text", f"^\\s*[{bullets}]\\s*", "")).alias("item")
    )


def merge_semantic(labels: DataFrame, narrative: DataFrame) -> DataFrame:
    """Fields found by labels, then by narrative, then whatever labels say; ``path`` tells which."""
    a = labels.select("document_id", "field", F.col("status").alias("s1"), F.col("key").alias("k1"))
    b = narrative.select("document_id", "field", F.col("status").alias("s2"), F.col("key").alias("k2"))
    one, two = F.col("s1") == "found", F.col("s2") == "found"
    path = F.when(one, "label").when(two, "narrative").when(F.col("s1").isNotNull(), "label").otherwise("narrative")
    return a.join(b, ["document_id", "field"], "full").select(
        "document_id", "field", path.alias("path"),
        F.when(path == "label", F.col("s1")).otherwise(F.col("s2")).alias("status"),
        F.when(path == "label", F.col("k1")).otherwise(F.col("k2")).alias("key"),
    )


def apply_negations(fields: DataFrame, denied: DataFrame) -> DataFrame:
    """A denial makes a field not applicable unless it was found."""
    d = denied.select("document_id", "field", F.lit(True).alias("denied"))
    status = F.when(F.col("denied") & (F.col("status") != "found"), "not_applicable").otherwise(F.col("status"))
    return fields.join(d, ["document_id", "field"], "left").withColumn("status", status).drop("denied")


def derive_status(fields: DataFrame, source: str, name: str) -> DataFrame:
    """Adds a field whose status is that of another."""
    return fields.unionByName(fields.where(F.col("field") == source).withColumn("field", F.lit(name)))


def field_grid(docs: DataFrame, specs: DataFrame, fields: DataFrame) -> DataFrame:
    """docs(document_id, readable) x the short list specs(field): a row for every field of every document."""
    names = [r["field"] for r in specs.select("field").distinct().collect()]
    grid = docs.withColumn("field", F.explode(F.array(*map(F.lit, names))))
    status = F.when(~F.col("readable"), "not_extracted").otherwise(F.coalesce("status", F.lit("not_found")))
    return grid.join(fields, ["document_id", "field"], "left").select("document_id", "field", status.alias("status"), "key")


def detect_role(fields: DataFrame, contract: tuple[str, ...], cv: tuple[str, ...]) -> DataFrame:
    """contract or cv by which has more of its marker fields; a tie is undetermined."""
    found = F.col("status") == "found"
    n = fields.groupBy("document_id").agg(
        F.count_if(found & F.col("field").isin(*contract)).alias("a"), F.count_if(found & F.col("field").isin(*cv)).alias("b")
    )
    return n.select("document_id", F.when(F.col("a") > F.col("b"), "contract").when(F.col("b") > F.col("a"), "cv").otherwise("undetermined").alias("role"))


def weakest_confidence(confidences: Column) -> Column:
    order = F.array(*[F.lit(c) for c in CONFIDENCE])
    return F.element_at(order, F.array_min(F.transform(confidences, lambda c: F.array_position(order, c).cast("int"))))


def arabic_number(text: Column) -> Column:
    """Sum of the Arabic number words of a phrase, a joined ``and`` letter aside; null if there are none or other words stand between."""
    table = F.create_map(*[F.lit(x) for kv in ARABIC_NUMBERS.items() for x in kv])
    tokens = F.filter(F.split(matching_key(text), " "), lambda t: t != "")
    values = F.transform(tokens, lambda t: F.coalesce(table[t], table[F.regexp_replace(t, "^و", "")]))
    known = F.forall(values, lambda v: v.isNotNull()) & (F.size(values) > 0)
    return F.when(known, F.aggregate(values, F.lit(0), lambda a, v: a + v))


# Arabic ordinals of statute headings, folded.
ARABIC_ORDINALS = {
    "الاولي": 1, "الاول": 1, "الثانيه": 2, "الثاني": 2, "الثالثه": 3, "الثالث": 3, "الرابعه": 4, "الرابع": 4, "الخامسه": 5, "الخامس": 5, "السادسه": 6,
    "السادس": 6, "الحاديه": 1, "الحادي": 1, "السابعه": 7, "السابع": 7, "الثامنه": 8, "الثامن": 8, "التاسعه": 9, "التاسع": 9, "العاشره": 10, "العاشر": 10, "عشره": 10, "عشر": 10,
    "العشرون": 20, "الثلاثون": 30, "الاربعون": 40, "الخمسون": 50, "الستون": 60, "السبعون": 70, "الثمانون": 80, "التسعون": 90, "المايه": 100, "المايتين": 200,
}


def ordinal_number(text: Column) -> Column:
    """Number of a heading such as "the fifth and twentieth after the hundredth": the known words add up, others are passed over."""
    table = F.create_map(*[F.lit(x) for kv in ARABIC_ORDINALS.items() for x in kv])
    values = F.filter(
        F.transform(F.split(matching_key(text), " "), lambda t: F.coalesce(table[t], table[F.regexp_replace(t, "^و", "")])),
        lambda v: v.isNotNull(),
    )
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0), lambda a, v: a + v))


def leave_value(text: Column) -> Column:
    """A leave without a unit is in days, if one number alone is written."""
    numbers = F.regexp_extract_all(to_ascii_digits(text), F.lit(r"(?<![\d.,])\d+(?![\d.,]*\d)"), F.lit(0))
    bare = ~F.lower(text).rlike(r"\b(day|week|month|year|hour)s?\b|يوم|ايام|أيام|شهر|سنة|اسبوع|أسبوع")
    return F.when(bare & (F.size(numbers) == 1), F.struct(numbers[0].cast("int").alias("count"), F.lit("day").alias("unit")))


def merge_allowance(candidates: DataFrame) -> DataFrame:
    """candidates(document_id, field, amount, percentage, currency, period): each attribute has one value at most, or there is no agreement."""
    cols = ("amount", "percentage", "currency", "period")
    agree = F.lit(True)
    for c in cols:
        agree = agree & (F.countDistinct(c) <= 1)
    agg = candidates.groupBy("document_id", "field").agg(*[F.max(c).alias(c) for c in cols], agree.alias("agree"))
    return agg.select("document_id", "field", *[F.when(F.col("agree"), F.col(c)).alias(c) for c in cols], "agree")


def termination_terms(sections: DataFrame, cue: str = r"(?i)terminat|انهاء|إنهاء|فسخ") -> DataFrame:
    """Sections under a heading that speaks of termination."""
    return sections.where((F.col("kind") != "heading") & F.col("title").rlike(cue)).select("document_id", "ord", "title", "text")
