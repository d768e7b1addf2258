"""Threshold rules and the facts that are checked against them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import matching_key
from parchment.functions.values import convert_unit

QUALITATIVE = ("prohibition", "requirement", "informational")


def _phrase(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["phrase"].alias("phrase"), m["unit"].alias("unit"))


def thresholds(articles: DataFrame, numbers: DataFrame, allow_digits: bool = False) -> DataFrame:
    """articles(article_id, text) x numbers(token, value) -> (article_id, kind, value, unit) of phrases such as "not more than
    ninety days".  A phrase's number is the sum of its known words; phrases with none are left out."""
    key = F.col("_key")
    units = "(يوما?|ايام|اسبوعا?|اسابيع|شهرا?|اشهر|سنه|سنوات|ساعه|ساعات|days?|weeks?|months?|years?|hours?)"
    words = r"((?:[^\s]+\s+){1,6}?)"
    # kind, what a text must hold for the pattern to fit, pattern
    patterns = (
        ("max", ("يزيد", "تزيد"), rf"(?:يزيد|تزيد)[^.]{{0,40}}?(?:على|عن|علي)\s+{words}{units}"),
        ("max", ("no more than", "not exceed", "at most"), rf"(?:no more than|not exceed|at most)\s+{words}{units}"),
        ("min", ("يقل", "تقل"), rf"(?:يقل|تقل)[^.]{{0,40}}?عن\s+{words}{units}"),
        ("min", ("no less than", "at least", "not less than"), rf"(?:no less than|at least|not less than)\s+{words}{units}"),
    )
    none = F.array().cast("array<struct<kind:string,phrase:string,unit:string>>")
    found = F.flatten(
        F.array(
            *[
                F.when(
                    reduce(or_, [F.contains(key, F.lit(c)) for c in cues]),
                    F.transform(
                        F.arrays_zip(
                            F.regexp_extract_all(key, F.lit(p), F.lit(1)).alias("phrase"),
                            F.regexp_extract_all(key, F.lit(p), F.lit(2)).alias("unit"),
                        ),
                        _phrase(k),
                    ),
                ).otherwise(none)
                for k, cues, p in patterns
            ]
        )
    )
    rows = articles.select("article_id", matching_key(F.col("text")).alias("_key")).select("article_id", F.posexplode(found).alias("no", "m")).select(
        "article_id", "no", "m.kind", "m.unit", F.explode(F.split(F.trim("m.phrase"), r"\s+")).alias("token")
    )
    # the numbers are a word list; a shuffle by token would gather the texts of each common word.  Dealt out by article once, for all
    # groupings by it here and in ``derive_rules``
    known = rows.join(F.broadcast(numbers), "token", "left").repartition("article_id")
    value = F.coalesce("value", F.col("token").try_cast("double")) if allow_digits else F.col("value")
    unit = (
        F.when(F.col("unit").rlike("^(يوم|ايام|day)"), "day").when(F.col("unit").rlike("^(اسب|اساب|week)"), "week")
        .when(F.col("unit").rlike("^(شهر|اشهر|month)"), "month").when(F.col("unit").rlike("^(سن|year)"), "year").otherwise("hour")
    )
    return (
        known.groupBy("article_id", "no", "kind", unit.alias("unit")).agg(F.sum(value).alias("value"))
        .where("value IS NOT NULL").select("article_id", "kind", "value", "unit").distinct()
    )


def derive_rules(articles: DataFrame, found: DataFrame) -> DataFrame:
    """One rule an article: a range from one maximum and one minimum of a unit; conditional with a cue and one threshold or with
    several; maximum or minimum; prohibition; requirement; unknown."""
    key = F.col("_key")
    by = found.groupBy("article_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "max").alias("n_max"), F.count_if(F.col("kind") == "min").alias("n_min"),
        (F.min("unit") == F.max("unit")).alias("one_unit"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("unit").alias("unit"),
        F.min("kind").alias("kind"),
    )
    joined = articles.withColumn("_key", matching_key(F.col("text"))).join(by, "article_id", "left")
    n = F.coalesce("n", F.lit(0))
    cue = key.rlike(r"\b(if|unless|provided)\b|اذا|بشرط|ما لم")
    kind = (
        F.when((F.col("n_max") == 1) & (F.col("n_min") == 1) & F.col("one_unit"), "range")
        .when(cue & (n == 1), "conditional").when(n == 1, F.when(F.col("kind") == "max", "maximum").otherwise("minimum"))
        .when(n > 1, "conditional").when(key.rlike(r"\b(shall not|may not|prohibited)\b|لا يجوز|يحظر"), "prohibition")
        .when(key.rlike(r"\b(shall|must)\b|يجب|يلتزم"), "requirement").otherwise("unknown")
    )
    return joined.select(
        "article_id", kind.alias("rule_type"), F.col("lo").alias("value"), F.when(kind == "range", F.col("hi")).alias("value_max"), "unit"
    )


def field_facts(fields: DataFrame) -> DataFrame:
    """fields(document_id, field, kind, amount, unit, per, currency, period) -> (document_id, field, value, unit): week before day
    for hours, ``<currency>_<period>`` for pay."""
    unit = (
        F.when(F.col("kind") == "duration", F.col("unit"))
        .when((F.col("kind") == "hours") & (F.col("per") == "week"), "hour_per_week")
        .when((F.col("kind") == "hours") & (F.col("per") == "day"), "hour_per_day")
        .when(F.col("kind") == "hours", "hour")
        .when(F.col("kind") == "money", F.lower(F.concat_ws("_", "currency", "period")))
    )
    return fields.select("document_id", "field", F.col("amount").cast("double").alias("value"), unit.alias("unit"))


def _holding(pairs: DataFrame) -> Column:
    """Whether a fact's source and a clause's text hold each other, folded."""
    return (F.col("fk") != "") & (F.contains("ck", "fk") | F.contains("fk", "ck"))


def _keyed(clauses: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    table = [F.col("table_id").alias("c_table")] if "table_id" in clauses.columns else [F.lit(None).cast("string").alias("c_table")]
    c = clauses.select("document_id", "clause_id", "clause_type", matching_key(F.col("text")).alias("ck"), F.col("section_id").alias("c_section"), *table)
    f = facts.withColumn("fk", matching_key(F.col("source_text")))
    return c, f if "table_id" in f.columns else f.withColumn("table_id", F.lit(None).cast("string"))


#: Clause types that say nothing about their fields.
OPEN_TYPES = ("OTHER", "UNKNOWN")


def link_structural(clauses: DataFrame, facts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Facts of a clause's section, and facts of its table whose text and the clause's hold each other: for clauses of open types, and
    for fields that ``allowed`` gives the clause's type."""
    c, f = _keyed(clauses, facts)
    by_section = c.withColumn("section_id", F.col("c_section")).join(f, ["document_id", "section_id"]).select(*c.columns, *[x for x in f.columns if x != "document_id"])
    by_table = c.withColumn("table_id", F.col("c_table")).join(f, ["document_id", "table_id"]).select(*by_section.columns)
    pairs = by_section.unionByName(by_table.where(_holding(by_table))).distinct()
    agrees = allowed.select("clause_type", "field", F.lit(True).alias("agrees"))
    fit = F.col("clause_type").isin(*OPEN_TYPES) | F.col("clause_type").isNull() | F.col("agrees").isNotNull()
    keep = ["document_id", "clause_id", "field", *[x for x in facts.columns if x not in ("document_id", "field", "section_id", "table_id")]]
    return pairs.join(agrees, ["clause_type", "field"], "left").where(fit).select(*keep)


def link_facts(clauses: DataFrame, facts: DataFrame, allowed: DataFrame) -> DataFrame:
    """clauses(document_id, clause_id, clause_type, text, section_id[, table_id]), facts(document_id, field, source_text,
    section_id[, table_id], ...) and allowed(clause_type, field): facts whose source and the clause hold each other (tier 1); where a
    clause has none, those of its section or table (tier 2)."""
    c, f = _keyed(clauses, facts)
    pairs = c.join(allowed, "clause_type").join(f, ["document_id", "field"])
    first = pairs.where(_holding(pairs))
    rest = clauses.join(first.select("document_id", "clause_id").distinct(), ["document_id", "clause_id"], "left_anti")
    second = link_structural(rest, facts, allowed)
    return first.select(*second.columns, F.lit(1).alias("tier")).unionByName(second.withColumn("tier", F.lit(2)))


def linked_field(links: DataFrame) -> DataFrame:
    """(clause_id, field) where just one field is linked."""
    return links.groupBy("clause_id").agg(F.countDistinct("field").alias("n"), F.min("field").alias("field")).select(
        "clause_id", F.when(F.col("n") == 1, F.col("field")).alias("field")
    )


def contradictions(facts: DataFrame, key: str = "clause_id") -> DataFrame:
    """Clauses that state more than one (value, unit)."""
    pair = F.struct("value", "unit")
    return facts.groupBy(key).agg(F.countDistinct(pair).alias("readings")).where("readings > 1")


def _holds(comparator: Column, value: Column, bound: Column) -> Column:
    return (
        F.when(comparator == ">=", value >= bound).when(comparator == "<=", value <= bound).when(comparator == "==", value == bound)
        .when(comparator == ">", value > bound).when(comparator == "<", value < bound)
    )


def eval_conditions(facts: DataFrame, conditions: DataFrame) -> DataFrame:
    """facts(fact_id, rule_id, value, unit, source_text) x conditions(rule_id, cond_no, comparator, value, unit) -> status of each:
    satisfied, not_satisfied, not_stated, not_applicable (units)."""
    c = conditions.select("rule_id", "cond_no", "comparator", F.col("value").alias("bound"), F.col("unit").alias("to"))
    cue = F.coalesce(F.col("source_text").rlike(r"(?i)written (agreement|consent)|موافقة كتابية"), F.lit(False))
    got = convert_unit(F.col("value"), F.col("unit"), F.col("to"))
    worded = F.col("bound").isNull() | F.col("to").isNull() | F.col("comparator").isNull()
    status = (
        F.when(worded, F.when(cue, "satisfied").otherwise("not_stated"))
        .when(F.col("value").isNull() | F.col("unit").isNull(), "not_stated").when(got.isNull(), "not_applicable")
        .when(_holds(F.col("comparator"), got, F.col("bound")), "satisfied").otherwise("not_satisfied")
    )
    return facts.join(c, "rule_id").select("fact_id", "rule_id", "cond_no", status.alias("status"))


def compare(facts: DataFrame, rules: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """facts(fact_id, rule_id, value, unit, source_text) against rules(rule_id, rule_type, value, value_max, unit) ->
    (fact_id, rule_id, rule_type, converted, satisfied, note, conditions).  Spark broadcasts the rules where they are small."""
    r = rules.select("rule_id", "rule_type", F.col("value").alias("bound"), F.col("value_max").alias("bound_max"), F.col("unit").alias("to"))
    joined = facts.join(r, "rule_id")
    got = convert_unit(F.col("value"), F.col("unit"), F.col("to"))
    holds = (
        F.when(F.col("rule_type") == "range", got.between(F.col("bound"), F.col("bound_max")))
        .when(F.col("rule_type") == "maximum", got <= F.col("bound")).when(F.col("rule_type") == "minimum", got >= F.col("bound"))
        .when(F.col("rule_type") == "exact", got == F.col("bound"))
    )
    numeric = F.col("rule_type").isin("range", "maximum", "minimum", "exact")
    note = F.when(numeric & F.col("value").isNotNull() & F.col("unit").isNotNull() & got.isNull(), "incompatible units")
    out = joined.select("fact_id", "rule_id", "rule_type", "value", got.alias("converted"), holds.alias("plain"), note.alias("note"))
    if conditions is None:
        return out.withColumn("satisfied", F.col("plain")).withColumn("stated", F.lit(None).cast("boolean")).drop("plain")
    judged = eval_conditions(facts, conditions).where("status <> 'not_applicable'").groupBy("fact_id", "rule_id").agg(
        F.bool_and(F.col("status") == "satisfied").alias("all_yes"),
        F.bool_and(F.col("status") == "not_satisfied").alias("all_no"),
        F.bool_and(F.col("status") != "not_stated").alias("stated"),
    )
    conditional = F.when(F.col("all_yes"), True).when(F.col("all_no"), False)
    return out.join(judged, ["fact_id", "rule_id"], "left").select(
        "fact_id", "rule_id", "rule_type", "value", "converted", "note", "stated",
        F.when(F.col("rule_type") == "conditional", conditional).otherwise(F.col("plain")).alias("satisfied"),
    )


def finding_status(compared: DataFrame) -> DataFrame:
    """Status of each compared fact."""
    status = (
        F.when(F.col("fact_id").isNull(), "not_found").when(F.col("value").isNull(), "requires_review")
        .when(F.col("rule_type") == "unknown", "requires_review").when(F.col("rule_type").isin(*QUALITATIVE), "not_applicable")
        .when((F.col("rule_type") == "conditional") & ~F.coalesce("stated", F.lit(False)), "requires_review")
        .when(F.col("satisfied").isNull(), "requires_review").when(F.col("satisfied"), "compliant").otherwise("non_compliant")
    )
    return compared.withColumn("status", status)


def clause_findings(clauses: DataFrame) -> DataFrame:
    """clauses(clause_id, topic, retrieval_status, n_evidence, readings, compared_status): what comes before a comparison, in order."""
    status = (
        F.when(F.col("topic").isNull(), "not_applicable").when(F.col("retrieval_status") == "error", "error")
        .when(F.col("n_evidence") == 0, "insufficient_evidence").when(F.col("readings") > 1, "ambiguous")
        .otherwise(F.coalesce("compared_status", F.lit("not_found")))
    )
    return clauses.withColumn("status", status)


def field_findings(fields: DataFrame) -> DataFrame:
    """Field-level findings: a label on compliance is always brought down to a review."""
    return fields.withColumn(
        "status", F.when(F.col("status").isin("compliant", "non_compliant"), "requires_review").otherwise(F.col("status"))
    )


def explain(findings: DataFrame, templates: DataFrame) -> DataFrame:
    """findings(status, field, ...) with templates(status, template): ``{field}`` is filled in."""
    return findings.join(templates, "status", "left").withColumn(
        "explanation", F.replace(F.col("template"), F.lit("{field}"), F.col("field"))
    ).drop("template")


def contract_status(findings: DataFrame, key: str = "contract_id") -> DataFrame:
    """(contract, status, counts): error over partial over success, and a map of counts by status in order of name."""
    per = findings.groupBy(key, "status").agg(F.count("*").alias("n"))
    agg = per.groupBy(key).agg(
        F.bool_or(F.col("status") == "error").alias("err"), F.bool_or(F.col("status").isin("requires_review", "insufficient_evidence")).alias("open"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("status", "n"))), lambda x: F.concat_ws("=", x["status"], x["n"])), ",").alias("counts"),
    )
    return agg.select(key, F.when(F.col("err"), "partial_error").when(F.col("open"), "partial").otherwise("success").alias("status"), "counts")


def compliance_differences(findings: DataFrame) -> DataFrame:
    """findings(contract_id, field, pos, status): fields whose status differs between contracts, the last row of each counting."""
    last = findings.groupBy("contract_id", "field").agg(F.max_by("status", "pos").alias("status"))
    differ = last.groupBy("field").agg(F.countDistinct("status").alias("n")).where("n > 1").select("field")
    return last.join(differ, "field")


def compliance_view(findings: DataFrame, left_out: tuple[str, ...] = ()) -> DataFrame:
    """Counts by contract: bound facts alone, pay clauses left out."""
    rows = findings.where(F.col("value").isNotNull() & ~F.col("clause_type").isin(*left_out))
    return rows.groupBy("contract_id").agg(
        F.count("*").alias("bound"),
        F.count_if(F.col("status") == "compliant").alias("compliant"),
        F.count_if(F.col("status") == "non_compliant").alias("non_compliant"),
        F.count_if(F.col("status") == "requires_review").alias("review"),
    )
