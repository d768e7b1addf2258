"""Queries of extraction, clauses, CV matching, data quality and request logs.

Line items stand for candidate readings (order = document, return flag = field, line number = order of reading)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.operators import clauses as C
from parchment.operators import evaluate as E
from parchment.operators import extract as X
from parchment.operators import match as M
from parchment.operators import requests as O
from parchment.plans.text import SENTENCES
from parchment.sources.tables import read_table


def _candidates(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_returnflag").alias("field"),
        (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"),
        F.when(F.col("l_discount").cast("double") > 0.005, F.floor(F.col("l_quantity") / 25).cast("string")).alias("key"),
        F.element_at(F.array(*[F.lit(m) for m in ("table_row", "keyword", "narrative", "labeled_line")]), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("method"),
        F.col("l_extendedprice").cast("double").alias("amount"),
        F.when(F.col("l_linestatus") == "O", "SAR").alias("currency"),
        F.when(F.col("l_suppkey") % 3 == 0, "monthly").alias("period"),
        F.element_at(F.array(F.lit("day"), F.lit("week"), F.lit("none")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("per"),
        F.floor(F.col("l_quantity") / 10).cast("double").alias("hours"),
        F.col("l_partkey").cast("string").alias("raw"),
        F.concat_ws(" ", F.lit("part"), F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("source"),
    )


RULES = [
    {"priority": 1, "field": "licence", "pattern": r"[Ll]icensed under the (\w+)"},
    {"priority": 2, "field": "version", "pattern": r"Version (\d+\.\d+)"},
    {"priority": 3, "field": "opening", "pattern": r"^(The \w+)", "excludes": r"[,;]"},
]


def _sentences(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.posexplode(T.sentences(F.col("text"))).alias("no", "text"))


def ext08(spark, sf):
    specs = spark.createDataFrame([("licence", "licens"), ("warranty", "without warranties"), ("insult", "idiot")], "field string, keyword string")
    guards = spark.createDataFrame([("insult", "(?i)clown")], "field string, pattern string")
    return X.keyword_candidates(_sentences(spark, sf), specs, guards).select("document_id", "no", "field")


def ext09(spark, sf):
    return X.narrative_candidates(_sentences(spark, sf), RULES)


def ext11(spark, sf):
    rules = spark.createDataFrame([("rest", "(?i)(^|\\P{L})without($|\\P{L})"), ("leave", "(?i)(^|\\P{L})nicht($|\\P{L})")], "field string, pattern string")
    return X.negations(_sentences(spark, sf), rules).select("document_id", "field", "no")


def ext12(spark, sf):
    c = _candidates(spark, sf).withColumn("raw", F.when(F.col("ord") % 2 == 0, F.col("document_id").cast("string")).otherwise(F.col("raw")))
    return X.verbatim(c).groupBy("field").agg(F.count("*").alias("n"))


def ext13(spark, sf):
    return X.dedupe(_candidates(spark, sf), ["key", "method"], ["ord", "raw"]).groupBy("document_id", "field").agg(F.count("*").alias("n"))


def ext14(spark, sf):
    return X.resolve(_candidates(spark, sf))


def ext15(spark, sf):
    return X.resolve_list(_candidates(spark, sf)).select("document_id", "field", F.array_join("items", ",").alias("items"))


def ext16(spark, sf):
    return X.merge_money(_candidates(spark, sf))


def ext18(spark, sf):
    return X.merge_hours(_candidates(spark, sf))


def _two(spark, sf):
    c = _candidates(spark, sf)
    strong = F.col("method").isin(*X.STRONG_METHODS)
    return X.resolve(c.where(strong)), X.resolve(c.where(~strong))


def ext23(spark, sf):
    a, b = _two(spark, sf)
    return X.merge_semantic(a, b)


def ext24(spark, sf):
    o = read_table(spark, sf, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("document_id"))
    denied = o.join(F.broadcast(spark.createDataFrame([("A",), ("N",)], "field string")))
    return X.apply_negations(X.resolve(_candidates(spark, sf)), denied).groupBy("field", "status").agg(F.count("*").alias("n"))


def ext26(spark, sf):
    docs = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderstatus") != "P").alias("readable"))
    specs = spark.createDataFrame([("A",), ("N",), ("R",)], "field string")
    return X.field_grid(docs, specs, X.resolve(_candidates(spark, sf)))


def ext27(spark, sf):
    return X.detect_role(X.resolve(_candidates(spark, sf)), ("A", "R"), ("N",))


CLAUSE_RULES = [
    {"type": "LICENCE", "pattern": r"(?i)licen[cs]e"},
    {"type": "OPENING", "pattern": r"^The ", "excludes": [r","]},
    {"type": "PAIR", "pattern": r" and ", "requires": [r" the ", r" of "]},
]
NOISE = [r"^\s*\W*$", r"_{5,}", r"\bwww\.[a-z0-9.-]+", r"^\W*\w{1,4}\W*$"]


def _section_sentences(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("section_id"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def cls01(spark, sf):
    return C.drop_noise(_section_sentences(spark, sf), NOISE).groupBy("section_id").agg(F.count("*").alias("n"))


def cls02(spark, sf):
    s = _section_sentences(spark, sf)
    return s.groupBy(C.classify(F.col("sentence"), CLAUSE_RULES).alias("type")).agg(F.count("*").alias("n"))


def _segments(spark, sf):
    s = _section_sentences(spark, sf)
    return C.segment(s.select("section_id", "pos", F.col("sentence").alias("text"), C.classify(F.col("sentence"), CLAUSE_RULES).alias("type")))


def cls05(spark, sf):
    return _segments(spark, sf)


def cls10(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"), T.sentences(F.col("text")).alias("s")).where(F.size("s") >= 1)
    return d.select("doc_id", F.length(C.verbatim_span(F.col("body"), F.col("s")[0], F.element_at("s", -1))).alias("n"))


def cls12(spark, sf):
    return C.number_clauses(_segments(spark, sf).select("section_id", "clause_no", "type"), "section_id", ["clause_no"])


def cvx02(spark, sf):
    return M.cv_items(read_table(spark, sf, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("item")).alias("longest"))


def _tokens(df, id_col, name):
    return df.select(F.col(id_col).alias(name), F.explode(F.array_distinct(F.split(T.matching_key(F.col("text")), " "))).alias("token")).where("token <> ''")


def cvx08(spark, sf):
    req = _tokens(read_table(spark, sf, "benchmark"), "item_id", "req_id")
    txt = _tokens(read_table(spark, sf, "documents"), "doc_id", "doc_id")
    return M.assess(req, txt, 0.5)


def cvx10(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job"),
        F.when(F.col("l_linenumber") == 7, "missing").when(F.col("l_quantity") < 3, "insufficient").when(F.col("l_quantity") > 25, "explicit").otherwise("partial").alias("status"),
        (F.col("l_returnflag") == "A").alias("required"),
    )
    return M.overall_match(rows, "job")


def evl05(spark, sf):
    return E.duplicate_groups(read_table(spark, sf, "documents"), "doc_id", "text")


def evl07(spark, sf):
    """A document's overlap is that with the next one."""
    d = read_table(spark, sf, "documents")
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    cases = d.join(following, "doc_id", "left").select(
        F.col("doc_id").alias("case_id"), F.round(T.token_overlap(F.col("text"), F.coalesce("other", F.lit(""))), 6).alias("overlap"),
        (F.col("doc_id") % 50 == 7).alias("shared"), (F.col("n_chars") < 400).alias("short_neighbour"), F.col("doc_id").alias("index"),
    )
    return E.stratified_subset(cases)


def evl09(spark, sf):
    d = read_table(spark, sf, "documents")
    return E.case_profile(d, ["lang", "source"])


def evl11(spark, sf):
    base = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").cast("string").alias("key"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    m = spark.createDataFrame([("cut", "1", None), ("raise", "2", "99")], "mutation string, key string, new_value string")
    return E.variants(base, m).groupBy("mutation", "key").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


def ops01(spark, sf):
    e = read_table(spark, sf, "events")
    log = e.select(
        F.floor(F.col("event_id") / 4).alias("request_id"),
        F.when(F.col("event_type") == "click", "contract_comparison").when(F.col("event_type") == "view", "regulatory_question")
        .when(F.col("event_type") == "error", "cv_analysis").alias("task"),
        (F.col("value") > 50).alias("has_question"),
        F.when(F.col("user_id") % 3 == 0, "contract").when(F.col("user_id") % 3 == 1, "cv").alias("role"),
        (F.col("value") > 10).alias("usable"),
    )
    return O.route_requests(log)


def ops02(spark, sf):
    o = read_table(spark, sf, "orders")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "error").when(F.col("o_orderpriority") == "2-HIGH", "failed").when(F.col("o_orderpriority") == "5-LOW", "success").otherwise("insufficient")
    return O.combine_status(o.select("o_custkey", status.alias("status")), "o_custkey")


def ops05(spark, sf):
    e = read_table(spark, sf, "events")
    return O.distinct_in_order(e, "user_id", "event_type", "event_id").select("user_id", F.array_join("items", ",").alias("items"))


def ops06(spark, sf):
    x = X.resolve(_candidates(spark, sf))
    li = read_table(spark, sf, "lineitem").withColumn("document_id", F.col("l_orderkey"))
    return O.audit(
        {
            "found has a reading": (x, (F.col("status") != "found") | F.col("key").isNotNull()),
            "ambiguous has none": (x, (F.col("status") != "ambiguous") | F.col("key").isNull()),
            "quantity is positive": (li, F.col("l_quantity") > 0),
            "dates are in order": (li, F.col("l_discount").cast("double") < 0.1),
        },
        "document_id",
    ).groupBy("constraint").agg(F.count("*").alias("n"))


def str02(spark, sf):
    e = read_table(spark, sf, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return O.ttl_reuse(e, "user_id", "s", 3600)


def str03(spark, sf):
    e = read_table(spark, sf, "events")
    return O.first_seen(e.withColumn("k", F.concat_ws("/", "user_id", "event_type")), "k", ["ts", "event_id"]).select("k", "event_id")


QUERIES = {
    "ext08_keywords": ext08, "ext09_narrative": ext09, "ext11_negations": ext11, "ext12_verbatim": ext12, "ext13_dedupe": ext13, "ext14_resolve": ext14,
    "ext15_lists": ext15, "ext16_money": ext16, "ext18_hours": ext18, "ext23_precedence": ext23, "ext24_overlay": ext24, "ext26_grid": ext26, "ext27_role": ext27,
    "cls01_noise": cls01, "cls02_classify": cls02, "cls05_segment": cls05, "cls10_span": cls10, "cls12_number": cls12,
    "cvx02_items": cvx02, "cvx08_coverage": cvx08, "cvx10_overall": cvx10,
    "evl05_duplicates": evl05, "evl07_subset": evl07, "evl09_profile": evl09, "evl11_variants": evl11,
    "ops01_route": ops01, "ops02_combine": ops02, "ops05_order": ops05, "ops06_audit": ops06, "str02_ttl": str02, "str03_first_seen": str03,
}

_C = """c AS MATERIALIZED (SELECT l_orderkey AS document_id, l_returnflag AS field, l_linenumber * 100000 + l_partkey AS ord, CASE WHEN CAST(l_discount AS DOUBLE) > 0.005 THEN CAST(CAST(floor(l_quantity / 25) AS BIGINT) AS VARCHAR) END AS key,
   ['table_row', 'keyword', 'narrative', 'labeled_line'][l_suppkey % 4 + 1] AS method, CAST(l_extendedprice AS DOUBLE) AS amount, CASE WHEN l_linestatus = 'O' THEN 'SAR' END AS currency,
   CASE WHEN l_suppkey % 3 = 0 THEN 'monthly' END AS period, ['day', 'week', 'none'][l_suppkey % 3 + 1] AS per, floor(CAST(l_quantity AS DOUBLE) / 10) AS hours,
   CAST(l_partkey AS VARCHAR) AS raw, 'part ' || l_suppkey || ' ' || l_partkey AS source FROM lineitem)"""


def _resolve(where: str = "true") -> str:
    return f"""(SELECT document_id, field, CASE WHEN many THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN NOT many THEN k END AS key, CASE WHEN strong THEN 'high' ELSE 'medium' END AS confidence, n FROM
   (SELECT document_id, field, count(*) FILTER (key IS NULL) > 0 OR count(DISTINCT key) > 1 AS many, arg_min(key, ord) AS k, bool_or(method IN ('table_row', 'labeled_line')) AS strong, count(*) AS n FROM c WHERE {where} GROUP BY ALL))"""


_KEY = (
    "trim(regexp_replace(lower(translate(text, '" + T.DIGITS_FROM + T.FOLD_FROM + T.DIACRITICS + T.TATWEEL + "', '"
    + T.DIGITS_TO + T.FOLD_TO + "')), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
)
_S = f"{SENTENCES}, s AS MATERIALIZED (SELECT doc_id AS document_id, doc_id AS section_id, sentence_no AS no, sentence_no AS pos, sentence AS text, sentence FROM sentences)"
_TYPE = "CASE WHEN regexp_matches(sentence, '(?i)licen[cs]e') THEN 'LICENCE' WHEN regexp_matches(sentence, '^The ') AND NOT contains(sentence, ',') THEN 'OPENING' WHEN contains(sentence, ' and ') AND contains(sentence, ' the ') AND contains(sentence, ' of ') THEN 'PAIR' END"
_SEG = f"""{_S}, o AS (SELECT *, {_TYPE} AS type FROM s), p AS (SELECT *, type IS NOT NULL OR regexp_matches(sentence, '^\\s*(?:\\(?(?:\\d{{1,2}}|[a-z]|[ivx]{{1,4}})[.)]|[•●▪◦‣–*·-])\\s*') AS opens FROM o),
   g AS (SELECT *, greatest(sum(CAST(opens AS INT)) OVER (PARTITION BY section_id ORDER BY pos), 1) AS grp FROM p),
   seg AS MATERIALIZED (SELECT section_id, CAST(grp AS BIGINT) AS clause_no, arg_min(coalesce(type, 'OTHER'), pos) FILTER (opens) AS type, string_agg(sentence, ' ' ORDER BY pos) AS text FROM g GROUP BY section_id, grp
     HAVING bool_or(opens) AND length(trim(regexp_replace(string_agg(sentence, ' ' ORDER BY pos), '\\s+', ' ', 'g'))) >= 25)"""

SQL = {
    "ext08_keywords": f"""WITH {_S}, k AS (SELECT document_id, no, ' ' || {_KEY} AS k, concat_ws(' ', lag(text) OVER (PARTITION BY document_id ORDER BY no), text) AS context FROM s),
        f(field, keyword) AS (VALUES ('licence', 'licens'), ('warranty', 'without warranties'), ('insult', 'idiot'))
        SELECT document_id, no, field FROM k JOIN f ON contains(k, ' ' || keyword) WHERE NOT (field = 'insult' AND regexp_matches(context, '(?i)clown'))""",
    "ext09_narrative": f"""WITH {_S}, r AS (SELECT document_id, no, 1 AS priority, 'licence' AS field, regexp_extract(text, '[Ll]icensed under the (\\w+)', 1) AS raw FROM s UNION ALL
        SELECT document_id, no, 2, 'version', regexp_extract(text, 'Version (\\d+\\.\\d+)', 1) FROM s UNION ALL
        SELECT document_id, no, 3, 'opening', regexp_extract(text, '^(The \\w+)', 1) FROM s WHERE NOT regexp_matches(text, '[,;]'))
        SELECT document_id, min(no) AS no, priority, field, raw FROM r WHERE raw <> '' GROUP BY document_id, priority, field, raw""",
    "ext11_negations": f"""WITH {_S}, f(field, p) AS (VALUES ('rest', '(?i)(^|\\P{{L}})without($|\\P{{L}})'), ('leave', '(?i)(^|\\P{{L}})nicht($|\\P{{L}})'))
        SELECT document_id, field, min(no) AS no FROM s JOIN f ON regexp_matches(text, p) GROUP BY ALL""",
    "ext12_verbatim": f"WITH {_C} SELECT field, count(*) AS n FROM c WHERE contains(source, CASE WHEN ord % 2 = 0 THEN CAST(document_id AS VARCHAR) ELSE raw END) GROUP BY field",
    "ext13_dedupe": f"WITH {_C} SELECT document_id, field, count(DISTINCT (coalesce(key, '-'), method)) AS n FROM c GROUP BY ALL",
    "ext14_resolve": f"WITH {_C} SELECT * FROM {_resolve()}",
    "ext15_lists": f"""WITH {_C} SELECT document_id, field, string_agg(key, ',' ORDER BY ord) AS items FROM (SELECT document_id, field, key, min((ord, key)) AS ord FROM c WHERE key IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
    "ext16_money": f"""WITH {_C}, a AS (SELECT document_id, field, max(amount) AS amount, max(currency) AS currency, max(period) AS period, count(DISTINCT amount) = 1 AND count(DISTINCT currency) <= 1 AND count(DISTINCT period) <= 1 AS agree FROM c GROUP BY ALL)
        SELECT document_id, field, CASE WHEN agree THEN amount END AS amount, CASE WHEN agree THEN currency END AS currency, CASE WHEN agree THEN period END AS period, agree FROM a""",
    "ext18_hours": f"""WITH {_C} SELECT document_id, max(hours) FILTER (per = 'day') AS per_day, max(hours) FILTER (per = 'week') AS per_week, max(n) <= 1 AS agree FROM (SELECT document_id, per, count(DISTINCT hours) AS n, max(hours) AS hours FROM c GROUP BY ALL) GROUP BY document_id""",
    "ext23_precedence": f"""WITH {_C}, j AS (SELECT document_id, field, a.status AS s1, a.key AS k1, b.status AS s2, b.key AS k2 FROM {_resolve("method IN ('table_row', 'labeled_line')")} a FULL JOIN {_resolve("method NOT IN ('table_row', 'labeled_line')")} b USING (document_id, field)),
        p AS (SELECT *, CASE WHEN s1 = 'found' THEN 'label' WHEN s2 = 'found' THEN 'narrative' WHEN s1 IS NOT NULL THEN 'label' ELSE 'narrative' END AS path FROM j)
        SELECT document_id, field, path, CASE WHEN path = 'label' THEN s1 ELSE s2 END AS status, CASE WHEN path = 'label' THEN k1 ELSE k2 END AS key FROM p""",
    "ext24_overlay": f"""WITH {_C} SELECT field, CASE WHEN o_orderpriority = '5-LOW' AND field IN ('A', 'N') AND status <> 'found' THEN 'not_applicable' ELSE status END AS status, count(*) AS n FROM {_resolve()} LEFT JOIN orders ON o_orderkey = document_id GROUP BY ALL""",
    "ext26_grid": f"""WITH {_C} SELECT o_orderkey AS document_id, f.field, CASE WHEN o_orderstatus = 'P' THEN 'not_extracted' ELSE coalesce(status, 'not_found') END AS status, key FROM orders CROSS JOIN (VALUES ('A'), ('N'), ('R')) f(field) LEFT JOIN {_resolve()} r ON r.document_id = o_orderkey AND r.field = f.field""",
    "ext27_role": f"""WITH {_C} SELECT document_id, CASE WHEN a > b THEN 'contract' WHEN b > a THEN 'cv' ELSE 'undetermined' END AS role FROM (SELECT document_id, count(*) FILTER (status = 'found' AND field IN ('A', 'R')) AS a, count(*) FILTER (status = 'found' AND field = 'N') AS b FROM {_resolve()} GROUP BY document_id)""",
    "cls01_noise": f"""WITH {_S} SELECT section_id, count(*) AS n FROM s WHERE length(trim(sentence)) >= 3 AND NOT regexp_matches(sentence, '^\\s*\\W*$|_{{5,}}|\\bwww\\.[a-z0-9.-]+|^\\W*\\w{{1,4}}\\W*$') GROUP BY section_id""",
    "cls02_classify": f"WITH {_S} SELECT {_TYPE} AS type, count(*) AS n FROM s GROUP BY ALL",
    "cls05_segment": f"WITH {_SEG} SELECT * FROM seg",
    "cls10_span": f"""WITH {_S}, e AS (SELECT document_id AS doc_id, arg_min(sentence, no) AS a, arg_max(sentence, no) AS b FROM s GROUP BY document_id), l AS (SELECT doc_id, text, a, b FROM documents JOIN e USING (doc_id))
        SELECT doc_id, CASE WHEN instr(text, b) + length(b) > instr(text, a) THEN CAST(length(substr(text, instr(text, a), instr(text, b) + length(b) - instr(text, a))) AS INT) END AS n FROM l WHERE b IS NOT NULL""",
    "cls12_number": f"WITH {_SEG} SELECT section_id, clause_no, type, 'C' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS clause_id FROM (SELECT section_id, clause_no, type, row_number() OVER (PARTITION BY section_id ORDER BY clause_no) AS n FROM seg)",
    "cvx02_items": """SELECT doc_id, count(*) AS n, CAST(max(length(item)) AS INT) AS longest FROM (SELECT doc_id, trim(unnest(string_split_regex(text, '\\s*[,،;|•]\\s*|\\s+-\\s+'))) AS item FROM documents) WHERE item <> '' GROUP BY doc_id""",
    "cvx08_coverage": f"""WITH r AS (SELECT DISTINCT item_id AS req_id, unnest(string_split({_KEY}, ' ')) AS token FROM benchmark), t AS (SELECT DISTINCT doc_id, unnest(string_split({_KEY}, ' ')) AS token FROM documents),
        n AS (SELECT req_id, count(*) AS need FROM r WHERE token <> '' GROUP BY req_id), h AS (SELECT req_id, doc_id, count(*) AS have FROM r JOIN t USING (token) WHERE token <> '' GROUP BY ALL)
        SELECT req_id, doc_id, have, CASE WHEN have = need THEN 'explicit' ELSE 'partial' END AS status FROM h JOIN n USING (req_id) WHERE have >= greatest(1, ceil(need * 0.5 - 1e-9))""",
    "cvx10_overall": """WITH r AS (SELECT l_orderkey AS job, CASE WHEN l_linenumber = 7 THEN 'missing' WHEN l_quantity < 3 THEN 'insufficient' WHEN l_quantity > 25 THEN 'explicit' ELSE 'partial' END AS status, l_returnflag = 'A' AS required FROM lineitem)
        SELECT job, CASE WHEN bool_or(required AND status = 'missing') THEN 'missing_required' WHEN bool_or(required AND status = 'insufficient') THEN 'insufficient' WHEN bool_and(status = 'explicit') THEN 'full' ELSE 'partial' END AS match FROM r GROUP BY job""",
    "evl05_duplicates": "SELECT doc_id, 'dup_' || substr(sha1(text), 1, 8) AS duplicate_group FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)",
    "evl07_subset": f"""WITH o AS (SELECT doc_id, n_chars, list_distinct(regexp_extract_all(text, '[^ \t\n\r]+')) AS a FROM documents),
        c AS MATERIALIZED (SELECT x.doc_id AS case_id, x.n_chars, round(CASE WHEN len(x.a) = 0 THEN 0.0 ELSE len(list_intersect(x.a, coalesce(y.a, []))) / len(x.a) END, 6) AS overlap FROM o x LEFT JOIN o y ON y.doc_id = x.doc_id + 1),
        s1 AS MATERIALIZED (SELECT case_id, 'shared_number' AS stratum FROM c WHERE case_id % 50 = 7 ORDER BY case_id LIMIT 8),
        s2 AS MATERIALIZED (SELECT * FROM s1 UNION ALL SELECT * FROM (SELECT case_id, 'high_overlap' FROM c ANTI JOIN s1 USING (case_id) ORDER BY overlap DESC, case_id DESC LIMIT 8)),
        s3 AS MATERIALIZED (SELECT * FROM s2 UNION ALL SELECT * FROM (SELECT case_id, 'low_overlap' FROM c ANTI JOIN s2 USING (case_id) ORDER BY overlap, case_id LIMIT 8)),
        s4 AS MATERIALIZED (SELECT * FROM s3 UNION ALL SELECT * FROM (SELECT case_id, 'near_neighbour' FROM c ANTI JOIN s3 USING (case_id) WHERE n_chars < 400 ORDER BY case_id LIMIT 8)),
        e AS (SELECT case_id FROM (SELECT case_id, row_number() OVER (ORDER BY case_id) AS no FROM c) WHERE (no - 1) % (SELECT greatest(1, floor((SELECT count(*) FROM c) / greatest(1, 40 - (SELECT count(*) FROM s4)))))= 0)
        SELECT * FROM s4 UNION ALL SELECT * FROM (SELECT case_id, 'coverage' FROM e ANTI JOIN s4 USING (case_id) ORDER BY case_id LIMIT (SELECT 40 - count(*) FROM s4))""",
    "evl09_profile": "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)",
    "evl11_variants": """WITH b AS (SELECT CAST(l_linenumber AS VARCHAR) AS key, CAST(l_quantity AS BIGINT) AS v FROM lineitem)
        SELECT 'cut' AS mutation, key, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM b WHERE key <> '1' GROUP BY key UNION ALL
        SELECT 'raise', key, count(*), CAST(sum(CASE WHEN key = '2' THEN 99 ELSE v END) AS BIGINT) FROM b GROUP BY key""",
    "ops01_route": """WITH l AS (SELECT event_id // 4 AS request_id, CASE event_type WHEN 'click' THEN 'contract_comparison' WHEN 'view' THEN 'regulatory_question' WHEN 'error' THEN 'cv_analysis' END AS task,
        value > 50 AS q, CASE user_id % 3 WHEN 0 THEN 'contract' WHEN 1 THEN 'cv' END AS role, value > 10 AS usable FROM events),
        a AS (SELECT request_id, max(task) AS t, bool_or(q) AS q, count(*) FILTER (usable AND role = 'contract') AS c, count(*) FILTER (usable AND role = 'cv') AS v, count(*) FILTER (NOT usable AND role IS NOT NULL) AS u FROM l GROUP BY request_id)
        SELECT request_id, CASE WHEN c > 5 THEN 'too_many_contracts' WHEN t = 'regulatory_question' THEN CASE WHEN q THEN 'regulatory_question' ELSE 'question_missing' END
        WHEN t = 'cv_analysis' THEN CASE WHEN v > 0 THEN 'cv_analysis' ELSE 'not_possible' END
        WHEN t = 'contract_comparison' THEN CASE WHEN c >= 2 THEN 'contract_comparison' WHEN c = 1 AND u > 0 THEN 'contract_analysis_fallback' ELSE 'not_possible' END
        WHEN c >= 2 THEN 'contract_comparison' WHEN c = 1 THEN CASE WHEN u > 0 THEN 'contract_analysis_fallback' ELSE 'contract_analysis' END WHEN v > 0 THEN 'cv_analysis' WHEN q THEN 'regulatory_question' ELSE 'nothing_to_do' END AS route FROM a""",
    "ops02_combine": """WITH s AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'error' WHEN '2-HIGH' THEN 'failed' WHEN '5-LOW' THEN 'success' ELSE 'insufficient' END AS status FROM orders)
        SELECT o_custkey, CASE WHEN count(DISTINCT status) = 1 THEN min(status) WHEN bool_or(status = 'success') THEN 'partial' ELSE arg_min(status, list_position(['error', 'failed', 'partial', 'insufficient', 'success'], status)) END AS status FROM s GROUP BY o_custkey""",
    "ops05_order": "SELECT user_id, string_agg(event_type, ',' ORDER BY p) AS items FROM (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY ALL) GROUP BY user_id",
    "ops06_audit": "SELECT 'dates are in order' AS \"constraint\", count(*) AS n FROM lineitem WHERE NOT (CAST(l_discount AS DOUBLE) < 0.1) HAVING count(*) > 0",
    "str02_ttl": """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        w AS (SELECT event_id, user_id, n, s AS fetched, false AS reused FROM e WHERE n = 1 UNION ALL
          SELECT e.event_id, e.user_id, e.n, CASE WHEN e.s - w.fetched <= 3600 THEN w.fetched ELSE e.s END, e.s - w.fetched <= 3600 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
        SELECT event_id, reused FROM w""",
    "str03_first_seen": "SELECT user_id || '/' || event_type AS k, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1",
}
