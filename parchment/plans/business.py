"""Queries of market ranges, comparison of offers, and rules, over the star-schema tables.

Line items stand for priced observations (part = query, supplier = address) and for measured facts; suppliers of a nation
are offers that compete; the short rule and rate tables are parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions.text import html_to_text
from parchment.functions.values import display_number
from parchment.operators import compare as C
from parchment.operators import market as M
from parchment.operators import rules as L
from parchment.sources.tables import read_table


# ---- market
def _observations(spark, sf):
    li = read_table(spark, sf, "lineitem")
    price = M.cents(F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double"))
    tier = F.element_at(F.array(*[F.lit(t) for t in M.TIERS]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return li.select(
        F.col("l_partkey").alias("query_id"),
        F.col("l_suppkey").alias("url"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
        tier.alias("tier"),
        F.when(F.col("l_returnflag") == "A", "base_salary").when(F.col("l_returnflag") == "R", "total_compensation").otherwise("unspecified").alias("basis"),
        F.when(F.col("l_linenumber") == 1, "USD").when(F.col("l_linenumber") == 2, "EUR").otherwise("SAR").alias("currency"),
        F.when(F.col("l_linestatus") == "O", "monthly").when(F.col("l_linenumber") < 6, "annual").alias("period"),
        price.alias("minimum"),
        F.when(F.col("l_tax").cast("double") > 0.05, price * 2).otherwise(price).alias("maximum"),
    )


def _rates(spark):
    return spark.createDataFrame([("USD", 3.75)], "currency string, rate double")


def _normal(spark, sf):
    return M.normalise(_observations(spark, sf), _rates(spark))


def sal02(spark, sf):
    pages = read_table(spark, sf, "pages")
    found = pages.select((F.col("page_id") % 10).alias("query_id"), F.col("page_id").alias("position"), "url")
    return M.select_urls(found, spark.createDataFrame([("example.com",), ("example.net",)], "domain string"))


def sal03(spark, sf):
    sources = spark.createDataFrame(
        [("example.com", "Com", "market"), ("example.net", "Net", "official"), ("m.ththth.example.net", "Mobile", "lead_only")],
        "domain string, name string, tier string",
    )
    return M.tier_pages(read_table(spark, sf, "pages").select("page_id", "url"), sources).select("page_id", "tier", "source_name")


def sal06(spark, sf):
    return _normal(spark, sf).select("position", "monthly_min", "monthly_max", "converted_from", "usable")


def sal07(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", M.mentions_title(html_to_text(F.col("html")), F.lit("the and of thion")).alias("found"))


def sal08(spark, sf):
    return M.choose_basis(_normal(spark, sf))


def sal09(spark, sf):
    return M.tier_ladder(_normal(spark, sf)).select("position", "tier", "is_range")


def sal10(spark, sf):
    return M.conflicts(_normal(spark, sf).where("usable"))


def sal11(spark, sf):
    return M.benchmark(_normal(spark, sf))


def sal11_report(spark, sf):
    r = M.benchmark_report(_normal(spark, sf))
    return r.select("query_id", "status", "quality", "market_min", "market_max", F.array_join(F.col("source_list").cast("array<string>"), ",").alias("source_list"), F.array_join("limits", "; ").alias("limits"))


def sal12(spark, sf):
    b = M.benchmark(_normal(spark, sf))
    p = read_table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_retailprice").cast("double").alias("amount"))
    return b.join(p, "query_id").select(
        "query_id", M.position(F.col("amount"), F.lit("monthly"), F.col("market_min"), F.col("market_max")).alias("position")
    )


def sal13(spark, sf):
    return M.limitations(_normal(spark, sf))


# ---- comparison
DIMS = [("n_lines", C.HIGHER, "lines"), ("mean_quantity", C.HIGHER, "pieces"), ("mean_discount", C.LOWER, None), ("balance", C.HIGHER, "usd"), ("segment", C.UNRANKED, None)]


def _offers(spark, sf):
    s = read_table(spark, sf, "supplier")
    li = read_table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.avg(F.col("l_quantity").cast("double")).alias("q"), F.avg(F.col("l_discount").cast("double")).alias("d")
    )
    wide = s.join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        F.col("s_nationkey").alias("group_id"),
        F.col("s_suppkey").alias("contract_id"),
        (F.col("s_suppkey") % 17 != 0).alias("readable"),
        F.floor(F.col("n") / 50).alias("n_lines"),
        F.floor("q").alias("mean_quantity"),
        F.round("d", 2).alias("mean_discount"),
        F.when(F.col("s_acctbal") > -800, F.round(F.col("s_acctbal").cast("double") / 1000)).alias("balance"),
        (F.col("s_suppkey") % 3).alias("segment"),
    )
    return C.dimension_values(wide, DIMS)


def cmp01(spark, sf):
    return _offers(spark, sf)


def cmp03(spark, sf):
    b = M.conflicts(_normal(spark, sf).where("usable"))
    p = read_table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_retailprice").cast("double").alias("v"))
    return p.join(b, "query_id").select("query_id", C.market_position(F.col("v"), F.col("low"), F.col("high")).alias("position"))


def cmp04(spark, sf):
    return C.compliance_dimension(_judged(spark, sf).withColumn("contract_id", F.col("l_orderkey")))


def cmp06(spark, sf):
    return C.comparability(_offers(spark, sf))


def cmp07(spark, sf):
    return C.leaders(_offers(spark, sf))


def cmp09(spark, sf):
    return C.dominance(_offers(spark, sf))


ORDER = ["mean_discount", "n_lines", "mean_quantity", "balance"]


def cmp10(spark, sf):
    return C.priorities(_offers(spark, sf), ORDER)


def cmp11(spark, sf):
    return C.recommend(_offers(spark, sf), ORDER)


def _findings(spark, sf):
    return _judged(spark, sf).select(
        F.col("l_orderkey").alias("contract_id"), F.col("l_returnflag").alias("field"), "status",
        F.when(F.col("l_linenumber") == 7, "not_found").when(F.col("l_linenumber") == 6, "ambiguous").otherwise("found").alias("extraction_status"),
        F.when(F.col("l_linestatus") == "O", F.col("l_shipmode")).alias("topic"),
    )


def cmp12(spark, sf):
    return C.risks(_findings(spark, sf), ("A", "N")).groupBy("code", "severity", "field").agg(F.count("*").alias("n"))


def cmp13(spark, sf):
    r = C.risks(_findings(spark, sf), ("A", "N")).select("contract_id", "field", "code", "severity").distinct()
    return C.risk_view(r)


def cmp14(spark, sf):
    o = read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("group_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "failed").when(F.col("o_orderpriority") == "5-LOW", "rag_error")
        .when(F.col("o_orderstatus") == "P", "partial").otherwise("success").alias("status"),
    )
    n = o.groupBy("group_id").agg(F.count_if(F.col("status") == "success").alias("n_comparable"))
    return C.comparison_status(o, n)


def cmp15(spark, sf):
    li = read_table(spark, sf, "lineitem")
    m = li.select(F.col("l_orderkey").alias("group_id"), (F.col("l_suppkey") % 5).alias("contract_id"), F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("label"))
    return C.validate_groups(m)


def cmp16(spark, sf):
    f = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        F.element_at(F.array(F.lit("basic"), F.lit("in_hand"), F.lit("total")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("field"),
        F.col("l_extendedprice").cast("double").alias("value"),
    )
    return C.compensation_matrix(f, ["basic", "in_hand", "total"])


def cmp18(spark, sf):
    m = cmp16(spark, sf).join(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), "o_custkey"), "document_id")
    shown = C.headline(m, "o_custkey", "document_id")
    return shown.select("o_custkey", "document_id", "letter", display_number(F.col("pay")).alias("pay"))


def cmp19(spark, sf):
    return C.caveats(_offers(spark, sf))


def cmp20(spark, sf):
    return C.comparison_summary(_offers(spark, sf))


# ---- rules
RULES = [
    (0, "minimum", 21.0, None, "day"), (1, "maximum", 3.0, None, "week"), (2, "range", 10.0, 40.0, "day"), (3, "exact", 24.0, None, "month"),
    (4, "conditional", None, None, None), (5, "unknown", None, None, None), (6, "prohibition", None, None, None),
]
CONDITIONS = [(4, 1, ">=", 14.0, "day"), (4, 2, "<=", 6.0, "week"), (4, 3, "==", 1.0, "hour")]


def _facts(spark, sf):
    # line numbers repeat within an order: one fact each
    li = read_table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        *[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")]
    )
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", (F.col("l_suppkey") % 7).cast("string").alias("l_shipmode"),
        (F.col("l_partkey") % 7).cast("int").alias("rule_id"),
        F.when(F.col("l_discount").cast("double") > 0.0, F.col("l_quantity").cast("double")).alias("value"),
        F.element_at(F.array(F.lit("day"), F.lit("week"), F.lit("month"), F.lit("year")), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("unit"),
        F.lit(None).cast("string").alias("source_text"),
    )


def _rules(spark):
    return spark.createDataFrame(RULES, "rule_id int, rule_type string, value double, value_max double, unit string")


def _conditions(spark):
    return spark.createDataFrame(CONDITIONS, "rule_id int, cond_no int, comparator string, value double, unit string")


def _judged(spark, sf):
    facts = _facts(spark, sf)
    c = L.finding_status(L.compare(facts, _rules(spark), _conditions(spark)))
    return c.join(facts.select("fact_id", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipmode"), "fact_id")


def law08(spark, sf):
    return L.eval_conditions(_facts(spark, sf), _conditions(spark)).groupBy("cond_no", "status").agg(F.count("*").alias("n"))


def law09(spark, sf):
    return L.compare(_facts(spark, sf), _rules(spark), _conditions(spark)).select("fact_id", F.round("converted", 6).alias("converted"), "satisfied", "note")


def law10(spark, sf):
    return _judged(spark, sf).groupBy("rule_type", "status").agg(F.count("*").alias("n"))


def law06(spark, sf):
    li = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clause_id"), F.col("l_returnflag").alias("field"))
    return L.linked_field(li)


def law07(spark, sf):
    return L.contradictions(_facts(spark, sf).withColumn("clause_id", F.col("l_orderkey")).where("value IS NOT NULL"))


def law14(spark, sf):
    return L.contract_status(_judged(spark, sf).withColumn("contract_id", F.col("l_orderkey")))


def law15(spark, sf):
    j = _judged(spark, sf).withColumn("contract_id", F.col("l_orderkey")).withColumn("clause_type", F.col("l_shipmode"))
    return L.compliance_view(j, ("1", "2"))


def law16(spark, sf):
    j = _judged(spark, sf).select((F.col("l_orderkey") % 500).alias("contract_id"), F.col("l_shipmode").alias("field"), F.col("fact_id").alias("pos"), "status")
    return L.compliance_differences(j).groupBy("field", "status").agg(F.count("*").alias("n"))


QUERIES = {
    "sal02_select_urls": sal02, "sal03_tiers": sal03, "sal06_normalise": sal06, "sal07_title": sal07, "sal08_basis": sal08, "sal09_ladder": sal09,
    "sal10_conflicts": sal10, "sal11_benchmark": sal11, "sal11_report": sal11_report, "sal12_position": sal12, "sal13_limitations": sal13,
    "cmp01_values": cmp01, "cmp03_position": cmp03, "cmp04_compliance": cmp04, "cmp06_comparability": cmp06, "cmp07_leaders": cmp07, "cmp09_dominance": cmp09,
    "cmp10_priorities": cmp10, "cmp11_recommend": cmp11, "cmp12_risks": cmp12, "cmp13_risk_view": cmp13, "cmp14_status": cmp14, "cmp15_validate": cmp15,
    "cmp16_matrix": cmp16, "cmp18_headline": cmp18, "cmp19_caveats": cmp19, "cmp20_summary": cmp20,
    "law06_linked_field": law06, "law07_contradictions": law07, "law08_conditions": law08, "law09_compare": law09, "law10_status": law10,
    "law14_contract_status": law14, "law15_view": law15, "law16_differences": law16,
}

_DOMAIN = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"
_OBS = """obs AS MATERIALIZED (SELECT l_partkey AS query_id, l_suppkey AS url, l_orderkey * 10 + l_linenumber AS position,
   ['official', 'market', 'supplementary', 'lead_only'][l_suppkey % 4 + 1] AS tier, l_suppkey % 4 + 1 AS rank,
   CASE l_returnflag WHEN 'A' THEN 'base_salary' WHEN 'R' THEN 'total_compensation' ELSE 'unspecified' END AS basis,
   CASE l_linenumber WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'SAR' END AS currency,
   CASE WHEN l_linestatus = 'O' THEN 'monthly' WHEN l_linenumber < 6 THEN 'annual' END AS period,
   floor(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) * 100 + 0.5) / 100 AS minimum, CASE WHEN CAST(l_tax AS DOUBLE) > 0.05 THEN 2 ELSE 1 END * floor(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) * 100 + 0.5) / 100 AS maximum FROM lineitem),
 rated AS (SELECT *, CASE currency WHEN 'SAR' THEN 1.0 WHEN 'USD' THEN 3.75 END AS rate, CASE WHEN period = 'annual' THEN 12.0 ELSE 1.0 END AS per FROM obs),
 norm AS MATERIALIZED (SELECT *, floor(CASE WHEN ok THEN minimum * rate / per ELSE minimum END * 100 + 0.5) / 100 AS monthly_min, floor(CASE WHEN ok THEN maximum * rate / per ELSE maximum END * 100 + 0.5) / 100 AS monthly_max,
   CASE WHEN ok AND currency <> 'SAR' THEN currency END AS converted_from, ok AND tier <> 'lead_only' AS usable FROM
   (SELECT *, rate IS NOT NULL AND period IS NOT NULL AS ok FROM rated) WHERE (rate IS NOT NULL OR period IS NOT NULL)
   AND (NOT ok OR (minimum * rate / per BETWEEN 500 AND 500000 AND maximum * rate / per BETWEEN 500 AND 500000))),
 basis AS MATERIALIZED (SELECT query_id, basis FROM (SELECT query_id, basis, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), count(DISTINCT url) DESC, min(position)) AS n
   FROM norm WHERE usable GROUP BY query_id, basis) WHERE n = 1)"""


def _ladder(name: str, source: str) -> str:
    return f"""{name} AS MATERIALIZED (WITH t AS (SELECT query_id, rank, max(CAST(monthly_max > monthly_min AS INT)) AS wide, min(round_even(monthly_min, 0)) AS lo, max(round_even(monthly_min, 0)) AS hi FROM {source} GROUP BY ALL),
   r AS (SELECT query_id, rank, CAST(max(wide) OVER w = 1 OR max(hi) OVER w > min(lo) OVER w AS INT) AS is_range FROM t WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
   u AS (SELECT *, coalesce(max(is_range) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM r)
   SELECT s.*, u.is_range FROM {source} s JOIN u USING (query_id, rank) WHERE done = 0)"""


def _conflict(source: str) -> str:
    return f"""(SELECT query_id, min(lo) AS low, max(hi) AS high, min(lo) > 0 AND max(hi) / min(lo) > 4 AND max(lo) > min(hi) AS conflict
   FROM (SELECT query_id, url, min(monthly_min) AS lo, max(monthly_max) AS hi FROM {source} GROUP BY ALL) GROUP BY query_id)"""


_BENCH = f"""{_OBS}, grp AS (SELECT norm.* FROM norm SEMI JOIN basis USING (query_id, basis) WHERE usable), {_ladder("chosen", "grp")},
 bench AS (SELECT query_id, basis, CASE WHEN is_range = 1 AND NOT conflict THEN 'success' ELSE 'insufficient_data' END AS status,
   CASE WHEN is_range <> 1 THEN 'insufficient' WHEN conflict THEN 'conflicting' WHEN tiers = 1 THEN tier ELSE 'mixed' END AS quality,
   CASE WHEN is_range = 1 AND NOT conflict THEN round(low, 2) END AS market_min, CASE WHEN is_range = 1 AND NOT conflict THEN round(high, 2) END AS market_max, sources
   FROM (SELECT query_id, max(is_range) AS is_range, count(DISTINCT tier) AS tiers, arg_min(tier, rank) AS tier, count(DISTINCT url) AS sources, any_value(basis) AS basis FROM chosen GROUP BY query_id)
   JOIN {_conflict("chosen")} USING (query_id))"""

_OFFERS = """w AS (SELECT s_nationkey AS group_id, s_suppkey AS contract_id, s_suppkey % 17 <> 0 AS readable, CAST(floor(n / 50) AS DOUBLE) AS n_lines, floor(q) AS mean_quantity, round(d, 2) AS mean_discount,
   CASE WHEN s_acctbal > -800 THEN round(CAST(s_acctbal AS DOUBLE) / 1000) + 0.0 END AS balance, CAST(s_suppkey % 3 AS DOUBLE) AS segment FROM supplier LEFT JOIN
   (SELECT l_suppkey, count(*) AS n, avg(CAST(l_quantity AS DOUBLE)) AS q, avg(CAST(l_discount AS DOUBLE)) AS d FROM lineitem GROUP BY l_suppkey) ON s_suppkey = l_suppkey),
 offers AS MATERIALIZED (SELECT group_id, contract_id, dimension, ranking, value, unit, CASE WHEN NOT readable THEN 'analysis_unavailable' WHEN value IS NULL THEN 'missing' ELSE 'available' END AS status FROM (
   SELECT group_id, contract_id, readable, 'n_lines' AS dimension, 'higher_is_better' AS ranking, n_lines AS value, 'lines' AS unit FROM w UNION ALL
   SELECT group_id, contract_id, readable, 'mean_quantity', 'higher_is_better', mean_quantity, 'pieces' FROM w UNION ALL
   SELECT group_id, contract_id, readable, 'mean_discount', 'lower_is_better', mean_discount, NULL FROM w UNION ALL
   SELECT group_id, contract_id, readable, 'balance', 'higher_is_better', balance, 'usd' FROM w UNION ALL
   SELECT group_id, contract_id, readable, 'segment', 'not_ranked', segment, NULL FROM w)),
 fit AS MATERIALIZED (SELECT group_id, dimension, any_value(ranking) AS ranking, bool_and(status = 'available') AND count(DISTINCT coalesce(unit, '<none>')) = 1
   AND (any_value(ranking) = 'not_ranked' OR bool_and(value IS NOT NULL)) AS comparable FROM offers GROUP BY group_id, dimension),
 signed AS (SELECT o.*, CASE WHEN o.ranking = 'higher_is_better' THEN value ELSE -value END AS v FROM offers o JOIN fit USING (group_id, dimension) WHERE comparable AND o.ranking <> 'not_ranked'),
 lead AS MATERIALIZED (SELECT group_id, dimension, contract_id, best = worst AS all_equal FROM (SELECT *, max(v) OVER w AS best, min(v) OVER w AS worst FROM signed WINDOW w AS (PARTITION BY group_id, dimension)) WHERE v = best)"""

_PRIORITIES = _OFFERS + """, keys AS (SELECT o.group_id, o.contract_id, [coalesce(max(v) FILTER (s.dimension = 'mean_discount'), 0), coalesce(max(v) FILTER (s.dimension = 'n_lines'), 0),
   coalesce(max(v) FILTER (s.dimension = 'mean_quantity'), 0), coalesce(max(v) FILTER (s.dimension = 'balance'), 0)] AS k
   FROM (SELECT DISTINCT group_id, contract_id FROM offers) o LEFT JOIN signed s USING (group_id, contract_id) GROUP BY ALL),
 kept AS (SELECT group_id, contract_id, count(*) OVER (PARTITION BY group_id) = 1 AS preferred FROM (SELECT *, rank() OVER (PARTITION BY group_id ORDER BY k DESC) AS r FROM keys) WHERE r = 1)"""

_RULES = ", ".join(f"({a}, '{b}', {'NULL' if c is None else c}, {'NULL' if d is None else d}, {'NULL' if e is None else repr(e)})" for a, b, c, d, e in RULES)
_CONVERT = """CASE WHEN {u} = {t} THEN {v} WHEN {u} = 'day' AND {t} = 'week' THEN {v} / 7 WHEN {u} = 'week' AND {t} = 'day' THEN {v} * 7
   WHEN {u} = 'month' AND {t} = 'year' THEN {v} / 12 WHEN {u} = 'year' AND {t} = 'month' THEN {v} * 12 END"""
_JUDGED = f"""facts AS MATERIALIZED (SELECT l_orderkey * 10 + l_linenumber AS fact_id, l_orderkey, l_linenumber, l_returnflag, l_linestatus, CAST(l_suppkey % 7 AS VARCHAR) AS l_shipmode, l_partkey % 7 AS rule_id,
   CASE WHEN CAST(l_discount AS DOUBLE) > 0 THEN CAST(l_quantity AS DOUBLE) END AS value, ['day', 'week', 'month', 'year'][l_suppkey % 4 + 1] AS unit FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey,
   min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL)),
 rules(rule_id, rule_type, bound, bound_max, t) AS (VALUES {_RULES}),
 conds(rule_id, cond_no, op, bound, t) AS (VALUES (4, 1, '>=', 14.0, 'day'), (4, 2, '<=', 6.0, 'week'), (4, 3, '==', 1.0, 'hour')),
 cond AS MATERIALIZED (SELECT fact_id, cond_no, CASE WHEN value IS NULL THEN 'not_stated' WHEN c IS NULL THEN 'not_applicable'
   WHEN (op = '>=' AND c >= bound) OR (op = '<=' AND c <= bound) OR (op = '==' AND c = bound) THEN 'satisfied' ELSE 'not_satisfied' END AS status
   FROM (SELECT *, {_CONVERT.format(u="unit", t="conds.t", v="value")} AS c FROM facts JOIN conds USING (rule_id))),
 jc AS (SELECT fact_id, bool_and(status = 'satisfied') AS yes, bool_and(status = 'not_satisfied') AS no, bool_and(status <> 'not_stated') AS stated FROM cond WHERE status <> 'not_applicable' GROUP BY fact_id),
 cmp AS MATERIALIZED (SELECT *, CASE rule_type WHEN 'range' THEN converted BETWEEN bound AND bound_max WHEN 'maximum' THEN converted <= bound WHEN 'minimum' THEN converted >= bound
   WHEN 'exact' THEN converted = bound WHEN 'conditional' THEN CASE WHEN yes THEN true WHEN no THEN false END END AS satisfied,
   CASE WHEN rule_type IN ('range', 'maximum', 'minimum', 'exact') AND value IS NOT NULL AND converted IS NULL THEN 'incompatible units' END AS note
   FROM (SELECT *, {_CONVERT.format(u="unit", t="rules.t", v="value")} AS converted FROM facts JOIN rules USING (rule_id) LEFT JOIN jc USING (fact_id))),
 judged AS MATERIALIZED (SELECT *, CASE WHEN value IS NULL THEN 'requires_review' WHEN rule_type = 'unknown' THEN 'requires_review' WHEN rule_type IN ('prohibition', 'requirement', 'informational') THEN 'not_applicable'
   WHEN rule_type = 'conditional' AND NOT coalesce(stated, false) THEN 'requires_review' WHEN satisfied IS NULL THEN 'requires_review' WHEN satisfied THEN 'compliant' ELSE 'non_compliant' END AS status FROM cmp),
 risks AS MATERIALIZED (SELECT contract_id, field, unnest([code, CASE WHEN field IN ('A', 'N') AND ext = 'not_found' THEN 'key_term_not_found' END]) AS code FROM (SELECT l_orderkey AS contract_id, l_returnflag AS field, ext,
   CASE WHEN status = 'non_compliant' THEN 'non_compliant_finding' WHEN status = 'error' THEN 'regulatory_check_error' WHEN ext = 'ambiguous' THEN 'ambiguous_term' WHEN status = 'requires_review' AND l_linestatus = 'O' THEN 'requires_review' END AS code
   FROM (SELECT *, CASE l_linenumber WHEN 7 THEN 'not_found' WHEN 6 THEN 'ambiguous' ELSE 'found' END AS ext FROM judged)))"""
_SEV = "CASE code WHEN 'non_compliant_finding' THEN 'high' WHEN 'ambiguous_term' THEN 'medium' ELSE 'info' END"
_MATRIX = """m AS (SELECT l_orderkey AS document_id, coalesce(max(v) FILTER (k = 0), max(v) FILTER (k = 1)) AS basic, max(v) FILTER (k = 1) AS in_hand, max(v) FILTER (k = 2) AS total
   FROM (SELECT l_orderkey, l_linenumber % 3 AS k, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem) GROUP BY l_orderkey)"""

SQL = {
    "sal02_select_urls": f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY position, url) AS INT) AS place FROM (SELECT page_id % 10 AS query_id, url, min(page_id) AS position FROM pages
        WHERE regexp_matches({_DOMAIN}, '(^|\\.)example\\.(com|net)$') GROUP BY ALL)) WHERE place <= 8""",
    "sal03_tiers": f"""SELECT page_id, CASE WHEN regexp_matches(h, '(^|\\.)m\\.ththth\\.example\\.net$') THEN 'lead_only' WHEN regexp_matches(h, '(^|\\.)example\\.com$') THEN 'market' WHEN regexp_matches(h, '(^|\\.)example\\.net$') THEN 'official' ELSE 'supplementary' END AS tier,
        CASE WHEN regexp_matches(h, '(^|\\.)m\\.ththth\\.example\\.net$') THEN 'Mobile' WHEN regexp_matches(h, '(^|\\.)example\\.com$') THEN 'Com' WHEN regexp_matches(h, '(^|\\.)example\\.net$') THEN 'Net' WHEN h = '' THEN 'unknown source' ELSE h END AS source_name
        FROM (SELECT page_id, {_DOMAIN} AS h FROM pages)""",
    "sal06_normalise": f"WITH {_OBS} SELECT position, monthly_min, monthly_max, converted_from, usable FROM norm",
    "sal07_title": """SELECT page_id, contains(t, 'the') AND contains(t, 'and') AND contains(t, 'thion') AS found FROM (SELECT page_id, lower(regexp_replace(replace(replace(
        regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '[ \t ]+', ' ', 'g')) AS t FROM pages)""",
    "sal08_basis": f"WITH {_OBS} SELECT * FROM basis",
    "sal09_ladder": f"WITH {_OBS}, good AS (SELECT * FROM norm WHERE usable), {_ladder('chosen', 'good')} SELECT position, tier, is_range FROM chosen",
    "sal10_conflicts": f"WITH {_OBS}, good AS (SELECT * FROM norm WHERE usable) SELECT * FROM {_conflict('good')}",
    "sal11_benchmark": f"WITH {_BENCH} SELECT * FROM bench",
    "sal11_report": f"""WITH {_BENCH}, lim AS (SELECT query_id, array_to_string(list_sort(list_distinct(list(currency) FILTER (NOT usable AND currency <> 'SAR' AND converted_from IS NULL AND period IS NOT NULL))), ',') AS un,
        bool_or(tier = 'lead_only') AS leads, bool_or(period IS NULL) AS no_period FROM norm GROUP BY query_id),
        src AS (SELECT query_id, string_agg(url, ',' ORDER BY p) AS source_list FROM (SELECT query_id, url, min(position) AS p FROM chosen GROUP BY ALL) GROUP BY query_id),
        lev AS (SELECT query_id, string_agg(tier, ' and ' ORDER BY rank) AS levels FROM (SELECT DISTINCT query_id, tier, rank FROM chosen) GROUP BY query_id),
        fact AS (SELECT query_id, bool_or(converted_from IS NOT NULL) AS conv, bool_or(coalesce(period = 'annual', false)) AS ann FROM chosen GROUP BY query_id)
        SELECT query_id, coalesce(status, 'insufficient_data') AS status, coalesce(quality, 'insufficient') AS quality, market_min, market_max, coalesce(source_list, '') AS source_list,
          array_to_string(list_filter([CASE WHEN un <> '' THEN 'no rate for ' || un END, CASE WHEN leads THEN 'leads set no range' END, CASE WHEN no_period THEN 'period not stated' END, CASE WHEN status IS NULL THEN 'no usable figure' END,
            CASE WHEN quality = 'insufficient' THEN 'a single figure' END, CASE WHEN quality = 'conflicting' THEN 'sources conflict' END, CASE WHEN status = 'success' THEN 'span of ' || sources || ' at level ' || levels END,
            CASE WHEN status = 'success' AND conv THEN 'converted at the given rate' END, CASE WHEN status = 'success' AND ann THEN 'annual figures divided by 12' END], lambda x: x IS NOT NULL), '; ') AS limits
        FROM lim LEFT JOIN bench USING (query_id) LEFT JOIN src USING (query_id) LEFT JOIN lev USING (query_id) LEFT JOIN fact USING (query_id)""",
    "sal12_position": f"""WITH {_BENCH} SELECT query_id, CASE WHEN a < market_min THEN 'below' WHEN a > market_max THEN 'above' ELSE 'inside' END AS position
        FROM bench JOIN (SELECT p_partkey AS query_id, CAST(p_retailprice AS DOUBLE) AS a FROM part) USING (query_id)""",
    "sal13_limitations": f"""WITH {_OBS} SELECT query_id, coalesce(array_to_string(list_sort(list_distinct(list(currency) FILTER (NOT usable AND currency <> 'SAR' AND converted_from IS NULL AND period IS NOT NULL))), ','), '') AS unconverted,
        bool_or(tier = 'lead_only') AS lead_only, bool_or(period IS NULL) AS no_period FROM norm GROUP BY query_id""",
    "cmp01_values": f"WITH {_OFFERS} SELECT * FROM offers",
    "cmp03_position": f"""WITH {_OBS}, good AS (SELECT * FROM norm WHERE usable) SELECT query_id, CASE WHEN v < low THEN 'below' WHEN v > high THEN 'above' ELSE 'inside' END AS position
        FROM {_conflict("good")} JOIN (SELECT p_partkey AS query_id, CAST(p_retailprice AS DOUBLE) AS v FROM part) USING (query_id)""",
    "cmp04_compliance": f"WITH {_JUDGED} SELECT l_orderkey AS contract_id, count(*) FILTER (status = 'non_compliant') AS value, 'available' AS status FROM judged GROUP BY l_orderkey",
    "cmp06_comparability": f"WITH {_OFFERS} SELECT * FROM fit",
    "cmp07_leaders": f"WITH {_OFFERS} SELECT * FROM lead",
    "cmp09_dominance": f"""WITH {_OFFERS}, a AS (SELECT * FROM lead WHERE NOT all_equal) SELECT group_id, min(contract_id) AS contract_id FROM (SELECT group_id, contract_id, count(DISTINCT dimension) AS have FROM a GROUP BY ALL)
        JOIN (SELECT group_id, count(DISTINCT dimension) AS need FROM a GROUP BY group_id) USING (group_id) WHERE have = need GROUP BY group_id HAVING count(*) = 1""",
    "cmp10_priorities": f"WITH {_PRIORITIES} SELECT * FROM kept",
    "cmp11_recommend": f"""WITH {_PRIORITIES}, st AS (SELECT group_id, bool_or(status = 'analysis_unavailable') AS bad FROM offers GROUP BY group_id),
        an AS (SELECT group_id, bool_or(comparable) AS has FROM fit WHERE ranking <> 'not_ranked' GROUP BY group_id)
        SELECT group_id, CASE WHEN bad OR NOT has THEN 'not_possible' WHEN k.contract_id IS NOT NULL THEN 'preferred_contract' ELSE 'no_clear_preference' END AS status,
        CASE WHEN NOT (bad OR NOT has) THEN k.contract_id END AS contract_id FROM st JOIN an USING (group_id) LEFT JOIN (SELECT * FROM kept WHERE preferred) k USING (group_id)""",
    "cmp12_risks": f"WITH {_JUDGED} SELECT code, {_SEV} AS severity, field, count(*) AS n FROM risks WHERE code IS NOT NULL GROUP BY ALL",
    "cmp13_risk_view": f"""WITH {_JUDGED} SELECT *, CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS place FROM (SELECT DISTINCT contract_id, field, code, {_SEV} AS severity FROM risks WHERE code IS NOT NULL)""",
    "cmp14_status": """WITH m AS (SELECT o_custkey AS group_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' WHEN o_orderpriority = '5-LOW' THEN 'rag_error' WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'success' END AS status FROM orders)
        SELECT group_id, CASE WHEN bool_and(status = 'failed') THEN 'failed' WHEN bool_and(status = 'rag_error') THEN 'rag_error' WHEN count(*) FILTER (status = 'success') = 0 THEN 'insufficient'
        WHEN bool_or(status <> 'success') THEN 'partial' ELSE 'success' END AS status FROM m GROUP BY group_id""",
    "cmp15_validate": """WITH a AS (SELECT l_orderkey AS group_id, count(*) AS n, count(DISTINCT l_suppkey % 5) AS d, count(*) FILTER (l_linenumber = 3) AS blank FROM lineitem GROUP BY l_orderkey)
        SELECT group_id, problem FROM (SELECT group_id, unnest([CASE WHEN n < 2 THEN 'too few members' END, CASE WHEN n > 5 THEN 'too many members' END, CASE WHEN d < n THEN 'repeated member' END, CASE WHEN blank > 0 THEN 'blank label' END]) AS problem FROM a) WHERE problem IS NOT NULL""",
    "cmp16_matrix": f"WITH {_MATRIX} SELECT * FROM m",
    "cmp18_headline": f"""WITH {_MATRIX} SELECT o_custkey, document_id, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) WHEN n <= 702 THEN chr(CAST(64 + (n - 1) // 26 AS INT)) || chr(CAST(65 + (n - 1) % 26 AS INT))
          ELSE chr(CAST(65 + (n - 703) // 676 AS INT)) || chr(CAST(65 + (n - 703) // 26 % 26 AS INT)) || chr(CAST(65 + (n - 703) % 26 AS INT)) END AS letter, CASE WHEN pay = floor(pay) THEN format('{{:,.0f}}', pay) ELSE format('{{:,.2f}}', pay) END AS pay
        FROM (SELECT o_custkey, document_id, coalesce(total, basic) AS pay, row_number() OVER (PARTITION BY o_custkey ORDER BY document_id) AS n FROM m JOIN orders ON o_orderkey = document_id)""",
    "cmp19_caveats": f"""WITH {_OFFERS} SELECT group_id, 'not comparable' AS caveat, dimension FROM fit WHERE ranking <> 'not_ranked' AND NOT comparable UNION ALL
        SELECT group_id, 'not for all', dimension FROM offers GROUP BY group_id, dimension HAVING bool_or(status = 'available') AND NOT bool_and(status = 'available')""",
    "cmp20_summary": f"WITH {_OFFERS} SELECT group_id, count(*) FILTER (comparable) AS comparable, count(*) AS ranked FROM fit WHERE ranking <> 'not_ranked' GROUP BY group_id",
    "law06_linked_field": "SELECT l_orderkey AS clause_id, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS field FROM lineitem GROUP BY l_orderkey",
    "law07_contradictions": f"WITH {_JUDGED} SELECT l_orderkey AS clause_id, count(DISTINCT (value, unit)) AS readings FROM facts WHERE value IS NOT NULL GROUP BY l_orderkey HAVING count(DISTINCT (value, unit)) > 1",
    "law08_conditions": f"WITH {_JUDGED} SELECT cond_no, status, count(*) AS n FROM cond GROUP BY ALL",
    "law09_compare": f"WITH {_JUDGED} SELECT fact_id, round(converted, 6) AS converted, satisfied, note FROM cmp",
    "law10_status": f"WITH {_JUDGED} SELECT rule_type, status, count(*) AS n FROM judged GROUP BY ALL",
    "law14_contract_status": f"""WITH {_JUDGED} SELECT contract_id, CASE WHEN bool_or(status IN ('requires_review', 'insufficient_evidence')) THEN 'partial' ELSE 'success' END AS status, string_agg(status || '=' || n, ',' ORDER BY status) AS counts
        FROM (SELECT l_orderkey AS contract_id, status, count(*) AS n FROM judged GROUP BY ALL) GROUP BY contract_id""",
    "law15_view": f"""WITH {_JUDGED} SELECT l_orderkey AS contract_id, count(*) AS bound, count(*) FILTER (status = 'compliant') AS compliant, count(*) FILTER (status = 'non_compliant') AS non_compliant, count(*) FILTER (status = 'requires_review') AS review
        FROM judged WHERE value IS NOT NULL AND l_shipmode NOT IN ('1', '2') GROUP BY l_orderkey""",
    "law16_differences": f"""WITH {_JUDGED}, l AS (SELECT l_orderkey % 500 AS contract_id, l_shipmode AS field, arg_max(status, fact_id) AS status FROM judged GROUP BY ALL)
        SELECT field, status, count(*) AS n FROM l WHERE field IN (SELECT field FROM l GROUP BY field HAVING count(DISTINCT status) > 1) GROUP BY ALL""",
}
