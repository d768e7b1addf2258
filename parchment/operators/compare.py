"""Comparison of offers: dimensions, leaders, dominance, priorities, risks.

Offers come in long form: (group_id, contract_id, dimension, ranking, status, value, unit, display)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGHER, LOWER, UNRANKED = "higher_is_better", "lower_is_better", "not_ranked"
NO_UNIT = "<none>"
SEVERITY = ("high", "medium", "info")


def dimension_values(offers: DataFrame, dimensions: list[tuple[str, str, str | None]]) -> DataFrame:
    """Wide offers (group_id, contract_id, readable, one column a dimension) -> long form.  ``dimensions``: name, ranking, unit."""
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("dimension"), F.lit(r).alias("ranking"), F.col(n).cast("double").alias("value"),
                F.lit(u).cast("string").alias("unit"),
            )
            for n, r, u in dimensions
        ]
    )
    status = F.when(~F.col("readable"), "analysis_unavailable").when(F.col("value").isNull(), "missing").otherwise("available")
    rows = offers.select("group_id", "contract_id", "readable", F.inline(entries))
    return rows.withColumn("status", status).drop("readable")


def stated_pay(fields: DataFrame) -> DataFrame:
    """fields(document_id, kind, status, amount, currency, problem): kind total, basic or allowance -> (document_id, amount, problem).
    A written total counts first; else basic and allowances in one currency, and any bad part voids the sum."""
    good = F.col("status") == "found"
    bad = F.col("status").isin("ambiguous") | (good & F.col("problem").isNotNull())
    part = F.col("kind").isin("basic", "allowance")
    agg = fields.groupBy("document_id").agg(
        F.max(F.when((F.col("kind") == "total") & good & F.col("problem").isNull(), F.col("amount"))).alias("total"),
        F.coalesce(F.bool_or(bad & part), F.lit(False)).alias("void"),
        F.countDistinct(F.when(good & part, F.col("currency"))).alias("currencies"),
        F.max(F.when((F.col("kind") == "basic") & good, F.lit(1))).alias("has_basic"),
        F.sum(F.when(good & part, F.col("amount"))).alias("parts"),
    )
    problem = (
        F.when(F.col("total").isNotNull(), None).when(F.col("void"), "a part cannot be added")
        .when(F.col("currencies") > 1, "several currencies").when(F.col("has_basic").isNull(), "no basic pay")
    )
    return agg.select("document_id", F.when(problem.isNull(), F.coalesce("total", "parts")).alias("amount"), problem.alias("problem"))


def market_position(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, "below").when(value > high, "above").when((value >= low) & (value <= high), "inside")


def compliance_dimension(findings: DataFrame) -> DataFrame:
    """(contract_id, value, status): clause findings that do not comply; none where a check failed."""
    return findings.groupBy("contract_id").agg(
        F.bool_or(F.col("status") == "error").alias("failed"), F.count_if(F.col("status") == "non_compliant").alias("n")
    ).select(
        "contract_id",
        F.when(~F.col("failed"), F.col("n")).alias("value"),
        F.when(F.col("failed"), "analysis_unavailable").otherwise("available").alias("status"),
    )


def level_map(category: Column, levels: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, level in levels.items():
        out = F.when(category == name, level).otherwise(out)
    return out


def comparability(values: DataFrame) -> DataFrame:
    """(group_id, dimension, ranking, comparable): all available, one unit (none is one), no value missing where ranked."""
    return values.groupBy("group_id", "dimension").agg(
        F.first("ranking").alias("ranking"),
        (
            F.bool_and(F.col("status") == "available")
            & (F.countDistinct(F.coalesce("unit", F.lit(NO_UNIT))) == 1)
            & ((F.first("ranking") == UNRANKED) | F.bool_and(F.col("value").isNotNull()))
        ).alias("comparable"),
    )


def leaders(values: DataFrame) -> DataFrame:
    """(group_id, dimension, contract_id, all_equal) of the best offers, ties included, in comparable ranked dimensions."""
    fit = comparability(values).where(F.col("comparable") & (F.col("ranking") != UNRANKED)).select("group_id", "dimension")
    signed = values.join(fit, ["group_id", "dimension"]).withColumn(
        "v", F.when(F.col("ranking") == HIGHER, F.col("value")).otherwise(-F.col("value"))
    )
    bounds = signed.groupBy("group_id", "dimension").agg(F.max("v").alias("best"), F.min("v").alias("worst"))
    return signed.join(bounds, ["group_id", "dimension"]).where("v = best").select(
        "group_id", "dimension", "contract_id", (F.col("best") == F.col("worst")).alias("all_equal")
    )


def dominance(values: DataFrame) -> DataFrame:
    """(group_id, contract_id) of offers that alone lead every dimension that tells offers apart."""
    lead = leaders(values).where("NOT all_equal")
    need = lead.groupBy("group_id").agg(F.countDistinct("dimension").alias("need"))
    have = lead.groupBy("group_id", "contract_id").agg(F.countDistinct("dimension").alias("have"))
    first = have.join(need, "group_id").where("have = need")
    return first.groupBy("group_id").agg(F.count("*").alias("n"), F.min("contract_id").alias("contract_id")).where("n = 1").drop("n")


def priorities(values: DataFrame, order: list[str]) -> DataFrame:
    """(group_id, contract_id, preferred): offers left after narrowing by the dimensions in turn; preferred if one is left.

    Narrowing to the best in turn is ranking by the values in this order; dimensions that can't be compared are equal for all."""
    fit = comparability(values).where(F.col("comparable") & (F.col("ranking") != UNRANKED)).select("group_id", "dimension")
    used = values.where(F.col("dimension").isin(*order)).join(fit, ["group_id", "dimension"]).withColumn(
        "v", F.when(F.col("ranking") == HIGHER, F.col("value")).otherwise(-F.col("value"))
    )
    keys = [F.coalesce(F.max(F.when(F.col("dimension") == d, F.col("v"))), F.lit(0.0)).alias(f"k{i}") for i, d in enumerate(order)]
    wide = values.select("group_id", "contract_id").distinct().join(
        used.groupBy("group_id", "contract_id").agg(*keys), ["group_id", "contract_id"], "left"
    ).fillna(0.0)
    key = F.struct(*[f"k{i}" for i in range(len(order))])
    best = wide.groupBy("group_id").agg(F.max(key).alias("best"))
    left = wide.join(best, "group_id").where(key == F.col("best"))
    n = left.groupBy("group_id").agg(F.count("*").alias("n"))
    return left.join(n, "group_id").select("group_id", "contract_id", (F.col("n") == 1).alias("preferred"))


def recommend(values: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(group_id, status, contract_id): not_possible, preferred_contract or no_clear_preference."""
    state = values.groupBy("group_id").agg(F.bool_or(F.col("status") == "analysis_unavailable").alias("unreadable"))
    ranked = comparability(values).where(F.col("ranking") != UNRANKED).groupBy("group_id").agg(F.bool_or("comparable").alias("any"))
    one = priorities(values, order).where("preferred").drop("preferred") if order else dominance(values)
    joined = state.join(ranked, "group_id", "left").join(one, "group_id", "left")
    blocked = F.col("unreadable") | ~F.coalesce("any", F.lit(False))
    status = F.when(blocked, "not_possible").when(F.col("contract_id").isNotNull(), "preferred_contract").otherwise("no_clear_preference")
    return joined.select("group_id", status.alias("status"), F.when(~blocked, F.col("contract_id")).alias("contract_id"))


def risks(findings: DataFrame, key_terms: tuple[str, ...] = ()) -> DataFrame:
    """findings(contract_id, field, status, extraction_status, topic) -> (contract_id, field, code, severity): the first
    that fits of a chain, and a missing key term beside it."""
    def row(code: str, severity: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))

    chain = (
        F.when(F.col("status") == "non_compliant", row("non_compliant_finding", "high"))
        .when(F.col("status") == "error", row("regulatory_check_error", "medium"))
        .when(F.col("status") == "insufficient_evidence", row("insufficient_regulatory_evidence", "medium"))
        .when(F.col("extraction_status") == "ambiguous", row("ambiguous_term", "medium"))
        .when((F.col("status") == "requires_review") & F.col("topic").isNotNull(), row("requires_review", "info"))
    )
    missing = F.when(
        F.col("field").isin(*key_terms) & (F.col("extraction_status") == "not_found"), row("key_term_not_found", "info")
    )
    return findings.select("contract_id", "field", F.inline(F.array_compact(F.array(chain, missing))))


def risk_view(rows: DataFrame) -> DataFrame:
    """Risks in order of severity, then contract, then code."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    return rows.withColumn("place", place.cast("int")).orderBy("place", "contract_id", "field", "code")


def comparison_status(members: DataFrame, comparable: DataFrame) -> DataFrame:
    """members(group_id, status) with comparable(group_id, n_comparable) -> status of each group."""
    bad = F.col("status").isin("failed", "unreadable")
    agg = members.groupBy("group_id").agg(
        F.bool_and(bad).alias("none"), F.bool_and(F.col("status") == "rag_error").alias("rag"),
        F.bool_or(bad | (F.col("status") != "success")).alias("some"),
    )
    status = (
        F.when(F.col("none"), "failed").when(F.col("rag"), "rag_error")
        .when(F.coalesce("n_comparable", F.lit(0)) == 0, "insufficient").when(F.col("some"), "partial").otherwise("success")
    )
    return agg.join(comparable, "group_id", "left").select("group_id", status.alias("status"))


def validate_groups(members: DataFrame, low: int = 2, high: int = 5) -> DataFrame:
    """members(group_id, contract_id, label) -> (group_id, problem)."""
    agg = members.groupBy("group_id").agg(
        F.count("*").alias("n"), F.countDistinct("contract_id").alias("d"),
        F.count_if(F.trim(F.coalesce("label", F.lit(""))) == "").alias("blank"),
    )
    checks = F.array_compact(
        F.array(
            F.when(F.col("n") < low, "too few members"),
            F.when(F.col("n") > high, "too many members"),
            F.when(F.col("d") < F.col("n"), "repeated member"),
            F.when(F.col("blank") > 0, "blank label"),
        )
    )
    return agg.select("group_id", F.explode(checks).alias("problem"))


def compensation_matrix(fields: DataFrame, names: list[str]) -> DataFrame:
    """fields(document_id, field, value) -> a column a field; pay in hand stands in for missing basic pay."""
    wide = fields.groupBy("document_id").pivot("field", names).agg(F.max("value"))
    if "basic" in names and "in_hand" in names:
        wide = wide.withColumn("basic", F.coalesce("basic", "in_hand"))
    return wide


def provenance(fields: DataFrame) -> DataFrame:
    """fields(group_id, contract_id, dimension, ord, raw, page) -> distinct raw values and pages in order, blanks left out;
    rows of one place go by raw value, then page."""
    rows = F.sort_array(F.collect_list(F.struct("ord", "raw", "page")))
    return fields.groupBy("group_id", "contract_id", "dimension").agg(rows.alias("r")).select(
        "group_id", "contract_id", "dimension",
        F.array_distinct(F.filter(F.transform("r", lambda x: x["raw"]), lambda v: F.trim(v) != "")).alias("raw_values"),
        F.array_distinct(F.filter(F.transform("r", lambda x: x["page"]), lambda v: v.isNotNull())).alias("pages"),
    )


def headline(matrix: DataFrame, group: str, position: str) -> DataFrame:
    """Letters A, B, ..., Z, AA, AB, ... by position, and total pay or else basic pay."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(position))
    named = matrix.withColumn("_n", n).withColumn("letter", short_name(F.col("_n"))).drop("_n")
    return named.withColumn("pay", F.coalesce("total", "basic"))


def short_name(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, ..."""
    start = F.struct(n.cast("long").alias("rest"), F.lit("").alias("name"))

    def one_more(acc: Column, _: Column) -> Column:
        rest = acc["rest"] - 1
        longer = F.struct(
            F.floor(rest / 26).alias("rest"), F.concat(F.char(F.pmod(rest, F.lit(26)) + 65), acc["name"]).alias("name")
        )
        return F.when(acc["rest"] > 0, longer).otherwise(acc)

    # fourteen letters number more rows than a long can
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, one_more, lambda acc: acc["name"])


def caveats(values: DataFrame) -> DataFrame:
    """(group_id, caveat, dimension): ranked dimensions that can't be compared; those that only some offers have."""
    fit = comparability(values).where((F.col("ranking") != UNRANKED) & ~F.col("comparable"))
    some = values.groupBy("group_id", "dimension").agg(
        F.bool_or(F.col("status") == "available").alias("a"), F.bool_and(F.col("status") == "available").alias("b")
    ).where("a AND NOT b")
    return fit.select("group_id", F.lit("not comparable").alias("caveat"), "dimension").unionByName(
        some.select("group_id", F.lit("not for all").alias("caveat"), "dimension")
    )


def comparison_summary(values: DataFrame) -> DataFrame:
    return comparability(values).where(F.col("ranking") != UNRANKED).groupBy("group_id").agg(
        F.count_if("comparable").alias("comparable"), F.count("*").alias("ranked")
    )


def explain_dimension(values: DataFrame) -> DataFrame:
    """(group_id, dimension, explanation): equal, led by some, not ranked, or why not comparable."""
    lead = leaders(values).groupBy("group_id", "dimension").agg(
        F.array_join(F.sort_array(F.collect_list(F.col("contract_id").cast("string"))), ", ").alias("names"), F.first("all_equal").alias("equal")
    )
    missing = F.array_join(
        F.sort_array(F.collect_list(F.when(F.col("status") != "available", F.concat_ws(": ", F.col("contract_id").cast("string"), "status")))), "; "
    )
    units = F.array_join(F.sort_array(F.collect_set(F.coalesce("unit", F.lit("none")))), ", ")
    facts = values.groupBy("group_id", "dimension").agg(F.first("ranking").alias("ranking"), missing.alias("missing"), units.alias("units"))
    why = F.when(F.col("missing") != "", F.col("missing")).otherwise(F.concat(F.lit("different units ("), F.col("units"), F.lit(")")))
    text = (
        F.when(F.col("ranking") == UNRANKED, "Shown for information; not ranked.")
        .when(F.col("equal"), "All offers are equal.")
        .when(F.col("names").isNotNull(), F.concat(F.lit("Led by "), F.col("names"), F.lit(".")))
        .otherwise(F.concat(F.lit("Not ranked because "), why, F.lit(".")))
    )
    return facts.join(lead, ["group_id", "dimension"], "left").select("group_id", "dimension", text.alias("explanation"))
