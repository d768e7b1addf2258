"""Queries over text: sources, normalisation, lines, sentences, HTML, functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.functions import values as V
from parchment.operators import structure
from parchment.sources.tables import load_vectors, page_source, read_table


def _title(html):
    return T.html_to_text(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1))


def src05(spark, sf):
    p = read_table(spark, sf, "pages")
    return page_source(p, _title(F.col("html")), F.substring(T.html_to_text(F.col("html")), 1, 160), F.col("html"))


def src06(spark, sf):
    return load_vectors(read_table(spark, sf, "embeddings"), 64).groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("first_mean")
    )


def doc01(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", T.normalize_text(F.col("text")).alias("clean"), T.removed_counts(F.col("text"))["bidi_mark"].alias("bidi_removed"))


def doc02(spark, sf):
    d = read_table(spark, sf, "documents")
    t = F.col("text")
    return d.select("doc_id", T.doc_language(t).alias("language"), T.question_language(t).alias("question_language"), T.eval_language(t).alias("eval_language"))


def doc07(spark, sf):
    return structure.page_sections(read_table(spark, sf, "pages")).select("document_id", "ord", "kind", "title", "heading_no", "text")


def doc10(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))


def doc11(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence"))


def doc18(spark, sf):
    d = read_table(spark, sf, "documents")
    # texts have single breaks, so lines are the paragraphs here
    return d.select("doc_id", F.posexplode(structure.pack_chunks(F.split("text", "\n"), 120)).alias("chunk_no", "chunk"))


def doc19(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


def doc20(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", structure.flat_json_line(F.col("props")).alias("line"))


def doc21(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("t"))
    return p.select("page_id", F.posexplode(T.page_sentences(F.col("t"))).alias("no", "sentence"))


def doc22(spark, sf):
    d = read_table(spark, sf, "documents")
    q = T.text_quality(F.col("text"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(q["bad_characters"]).alias("bad"), F.count_if(q["split_arabic"]).alias("split"))


def doc23(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("redacted_sha"))


def doc25(spark, sf):
    d = read_table(spark, sf, "documents")
    return structure.duplicate_docs(d.select("source", F.md5("text").alias("digest"), "doc_id"), "source", "digest", "doc_id")


def fn03(spark, sf):
    d = read_table(spark, sf, "documents")
    key = T.matching_key(F.col("text"))
    return d.select("doc_id", *[T.contains_keyword(key, k).alias(f"has_{k}") for k in ("licens", "idiot", "ention", "the")])


def fn07(spark, sf):
    li = read_table(spark, sf, "lineitem")
    raw = F.format_number("l_extendedprice", 2)
    dotted = F.replace(F.format_number(F.floor("l_extendedprice"), 0), F.lit(","), F.lit("."))
    return li.select("l_orderkey", "l_linenumber", V.read_number(raw).alias("comma"), V.read_number(dotted).alias("dotted"))


def fn08(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("t"))
    t = F.col("t")
    return p.select("page_id", V.find_currency(t).alias("currency"), V.find_period(t).alias("period"), V.find_basis(t).alias("basis"))


def fn11(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.groupBy(T.domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


def fn15(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", V.display_number(F.col("o_totalprice").cast("double")).alias("shown"))


def fn16(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.groupBy(V.similarity_pct(F.col("l_discount").cast("double")).alias("pct")).agg(F.count("*").alias("n"))


def fn20(spark, sf):
    b = read_table(spark, sf, "benchmark")
    stop = F.array(*[F.lit(w) for w in ("the", "of", "and", "to", "in")])
    return b.select("item_id", F.array_join(T.cv_tokens(F.col("text"), stop), " ").alias("tokens"))


def fn21(spark, sf):
    """Each document against the next one."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(following, "doc_id").select("doc_id", F.round(T.token_overlap(F.col("text"), F.col("other")), 6).alias("overlap"))


def fn24(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.size(T.emails(F.col("text"))).alias("n_emails"), F.array_join(T.emails(F.col("text")), ",").alias("emails"))


QUERIES = {
    "src05_page_source": src05,
    "src06_vectors": src06,
    "doc01_normalize": doc01,
    "doc02_languages": doc02,
    "doc07_sections": doc07,
    "doc10_lines": doc10,
    "doc11_sentences": doc11,
    "doc18_pack_chunks": doc18,
    "doc19_html_to_text": doc19,
    "doc20_json_lines": doc20,
    "doc21_page_sentences": doc21,
    "doc22_quality": doc22,
    "doc23_redact": doc23,
    "doc25_duplicates": doc25,
    "fn03_keywords": fn03,
    "fn07_read_number": fn07,
    "fn08_pay_readers": fn08,
    "fn11_domains": fn11,
    "fn15_display": fn15,
    "fn16_percentage": fn16,
    "fn20_cv_tokens": fn20,
    "fn21_overlap": fn21,
    "fn24_emails": fn24,
}

_HTML = (
    "regexp_replace(replace(replace(regexp_replace({}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>', ' ', 'g'),"
    " '&nbsp;', ' '), '&amp;', '&'), '[ \t ]+', ' ', 'g')"
)
PLAIN = _HTML.format("html")
_DOMAIN = (
    "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"
)
_GONE = "".join(T.REMOVED.values())
_KEY = (
    "trim(regexp_replace(lower(translate({}, '" + T.DIGITS_FROM + T.FOLD_FROM + T.DIACRITICS + T.TATWEEL + "', '"
    + T.DIGITS_TO + T.FOLD_TO + "')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
)


def sql_any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


def sql_currency() -> str:
    import re

    out = []
    for code, tokens in V.CURRENCY_TOKENS.items():
        tests = [
            f"contains(low, '{t}')" if t in V.BARE_TOKENS else f"regexp_matches(low, '(^|[^a-z]){re.escape(t)}($|[^a-z])')"
            for t in tokens
        ]
        out.append(f"WHEN {' OR '.join(tests)} THEN '{code}'")
    return "CASE " + " ".join(out) + " END"


PERIOD = f"CASE WHEN {sql_any(V.MONTHLY_WORDS)} THEN 'monthly' WHEN {sql_any(V.ANNUAL_WORDS)} THEN 'annual' END"
BASIS = f"CASE WHEN {sql_any(V.TOTAL_WORDS)} THEN 'total_compensation' WHEN {sql_any(V.BASE_WORDS)} THEN 'base_salary' ELSE 'unspecified' END"
DOMAIN = _DOMAIN
_SENTENCES = """
  lines AS (SELECT doc_id, i, l, lag(l) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM
    (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
  isles AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND p <> '' AND NOT regexp_matches(p, '[.!?؟:]$') AND regexp_matches(l, '^\\p{Ll}')
    THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lines),
  chunks AS (SELECT doc_id, g, string_agg(l, chr(10) ORDER BY i) AS c FROM isles GROUP BY doc_id, g),
  parts AS (SELECT doc_id, g, generate_subscripts(ps, 1) AS k, unnest(ps) AS sentence FROM
    (SELECT doc_id, g, string_split(regexp_replace(c, '([.!?؟])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM chunks)),
  sentences AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g, k) - 1 AS INT) AS sentence_no, sentence
    FROM parts WHERE regexp_matches(sentence, '\\S'))"""
SENTENCES = _SENTENCES

SQL = {
    "src05_page_source": f"""SELECT page_id, url, {_HTML.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
        substr({PLAIN}, 1, 160) AS snippet, substr(coalesce(nullif(html, ''), substr({PLAIN}, 1, 160)), 1, 200000) AS content,
        {_DOMAIN} AS domain FROM pages""",
    "src06_vectors": "SELECT label, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS first_mean FROM embeddings WHERE len(embedding) = 64 GROUP BY label",
    "doc01_normalize": f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        translate(regexp_replace(text, '\r\n?', chr(10), 'g'), '{T.SPACES}{_GONE}', '{" " * len(T.SPACES)}'),
        '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \t]*\t[ \t]*', chr(9), 'g'), ' {{2,}}', ' ', 'g'), '(?m)^ +| +$', '', 'g'),
        '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS clean,
        CAST(length(text) - length(translate(text, '{T.BIDI_MARKS}', '')) AS INT) AS bidi_removed FROM documents""",
    "doc02_languages": """WITH c AS (SELECT doc_id, text, length(text) - length(regexp_replace(text, '[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-ﻼ]', '', 'g')) AS a,
        length(text) - length(regexp_replace(text, '[A-Za-zÀ-ɏ]', '', 'g')) AS b,
        length(text) - length(regexp_replace(text, '[؀-ۿ]', '', 'g')) AS a2, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS b2 FROM documents)
        SELECT doc_id, CASE WHEN a + b = 0 THEN 'unknown' WHEN a >= 0.8 * (a + b) THEN 'ar' WHEN b >= 0.8 * (a + b) THEN 'en' ELSE 'mixed' END AS language,
        CASE WHEN trim(text) = '' THEN 'en' WHEN 2 * a2 > length(text) THEN 'ar' ELSE 'en' END AS question_language,
        CASE WHEN a2 > 0 AND b2 > a2 THEN 'mixed' WHEN a2 > 0 THEN 'ar' ELSE 'en' END AS eval_language FROM c""",
    "doc07_sections": f"""WITH b AS (SELECT page_id AS document_id, generate_subscripts(bs, 1) - 1 AS ord, unnest(bs) AS raw FROM
        (SELECT page_id, regexp_extract_all(html, '(?is)<(?:h1|h2|h3|p|li)[^>]*>.*?</(?:h1|h2|h3|p|li)>') AS bs FROM pages)),
        t AS (SELECT document_id, CAST(ord AS INT) AS ord, CASE WHEN lower(substr(raw, 2, 1)) = 'h' THEN 'heading' ELSE 'paragraph' END AS kind,
        trim({_HTML.format("raw")}) AS text FROM b),
        f AS (SELECT * FROM t WHERE text <> '')
        SELECT document_id, ord, kind, text, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER w AS title,
        last_value(CASE WHEN kind = 'heading' THEN ord END IGNORE NULLS) OVER w AS heading_no FROM f
        WINDOW w AS (PARTITION BY document_id ORDER BY ord ROWS UNBOUNDED PRECEDING)""",
    "doc10_lines": """SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS line_no, unnest(ls) AS line FROM
        (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS ls FROM documents)""",
    "doc11_sentences": f"WITH {_SENTENCES} SELECT * FROM sentences",
    "doc18_pack_chunks": """WITH RECURSIVE p AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS k, para, n FROM
        (SELECT doc_id, i, trim(para) AS para, len(regexp_extract_all(para, '\\S+')) AS n FROM
          (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS para FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)))
        WHERE n > 0),
        q AS (SELECT doc_id, k, piece, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS k2, least(n - 120 * (j - 1), 120) AS m,
              n > 120 AS alone FROM (SELECT *, unnest(range(1, CAST(ceil(n / 120.0) AS BIGINT) + 1)) AS j,
              CASE WHEN n > 120 THEN array_to_string(list_slice(regexp_extract_all(para, '\\S+'), 120 * (j - 1) + 1, 120 * j), ' ') ELSE para END AS piece FROM p)),
        w AS (SELECT doc_id, k2, piece, m, alone, 0 AS chunk, m AS used, alone AS shut FROM q WHERE k2 = 1
          UNION ALL SELECT q.doc_id, q.k2, q.piece, q.m, q.alone,
            CASE WHEN q.alone OR w.shut OR w.used + q.m > 120 THEN w.chunk + 1 ELSE w.chunk END,
            CASE WHEN q.alone OR w.shut OR w.used + q.m > 120 THEN q.m ELSE w.used + q.m END, q.alone
          FROM w JOIN q ON q.doc_id = w.doc_id AND q.k2 = w.k2 + 1)
        SELECT doc_id, CAST(chunk AS INT) AS chunk_no, string_agg(piece, chr(10) || chr(10) ORDER BY k2) AS chunk FROM w GROUP BY doc_id, w.chunk""",
    "doc19_html_to_text": f"SELECT page_id, {PLAIN} AS text FROM pages",
    "doc20_json_lines": """SELECT event_id, array_to_string(list_transform(json_keys(props), lambda k: k || ': ' || json_extract_string(props, '$.' || k)), ', ') AS line FROM events""",
    "doc21_page_sentences": f"""WITH l AS (SELECT page_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM
        (SELECT page_id, string_split_regex({PLAIN}, '\r\n|\r|\n') AS ls FROM pages)),
        s AS (SELECT page_id, i, generate_subscripts(ps, 1) AS k, trim(unnest(ps), ' ' || chr(9) || '‏‎') AS sentence FROM
        (SELECT page_id, i, string_split(regexp_replace(regexp_replace(l, '([.!?؟۔])\\s+', '\\1' || chr(1), 'g'), '\\s{{2,}}|\\|', chr(1), 'g'), chr(1)) AS ps FROM l))
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i, k) - 1 AS INT) AS no, sentence FROM s WHERE sentence <> ''""",
    "doc22_quality": """SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[\\x{FFFD}\\x{E000}-\\x{F8FF}]')) AS bad,
        count(*) FILTER (len(ts) >= 4 AND len(list_filter(ts, lambda x: length(x) <= 2)) > 0.6 * len(ts)) AS split
        FROM (SELECT *, regexp_extract_all(text, '[؀-ۿ]+') AS ts FROM documents) GROUP BY lang""",
    "doc23_redact": "SELECT doc_id, sha256(regexp_replace(text, '(?i)\\b(sk|rk|pk)-[A-Za-z0-9_-]{8,}', '[redacted]', 'g')) AS redacted_sha FROM documents",
    "doc25_duplicates": """SELECT * FROM (SELECT source, md5(text) AS digest, doc_id, first_value(doc_id) OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS first_holder
        FROM documents) WHERE doc_id <> first_holder""",
    "fn03_keywords": f"""WITH k AS (SELECT doc_id, {_KEY.format("text")} AS key FROM documents) SELECT doc_id,
        regexp_matches(key, '(^|[^a-z0-9])licens') AS has_licens, regexp_matches(key, '(^|[^a-z0-9])idiot') AS has_idiot,
        regexp_matches(key, '(^|[^a-z0-9])ention') AS has_ention, regexp_matches(key, '(^|[^a-z0-9])the') AS has_the FROM k""",
    "fn07_read_number": """SELECT l_orderkey, l_linenumber, CAST(replace(format('{:,.2f}', CAST(l_extendedprice AS DOUBLE)), ',', '') AS DOUBLE) AS comma,
        CASE WHEN floor(l_extendedprice) > 0 THEN CAST(floor(l_extendedprice) AS DOUBLE) END AS dotted FROM lineitem""",
    "fn08_pay_readers": f"SELECT page_id, {sql_currency()} AS currency, {PERIOD} AS period, {BASIS} AS basis FROM (SELECT page_id, lower({PLAIN}) AS low FROM pages)",
    "fn11_domains": f"SELECT {_DOMAIN} AS domain, count(*) AS n FROM pages GROUP BY 1",
    "fn15_display": """SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN format('{:,.0f}', CAST(o_totalprice AS DOUBLE))
        ELSE format('{:,.2f}', CAST(o_totalprice AS DOUBLE)) END AS shown FROM orders""",
    "fn16_percentage": "SELECT CAST(round_even(CAST(l_discount AS DOUBLE) * 100, 0) AS INT) AS pct, count(*) AS n FROM lineitem GROUP BY 1",
    "fn20_cv_tokens": f"""SELECT item_id, array_to_string(list_transform(list_filter(string_split({_KEY.format("text")}, ' '),
        lambda t: t <> '' AND t NOT IN ('the', 'of', 'and', 'to', 'in')), lambda t: regexp_replace(t, '^(?:وال|ال)(..)', '\\1')), ' ') AS tokens FROM benchmark""",
    "fn21_overlap": """WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[^ \t\n\r]+')) AS a FROM documents)
        SELECT x.doc_id, round(CASE WHEN len(x.a) = 0 THEN 0.0 ELSE len(list_intersect(x.a, y.a)) / len(x.a) END, 6) AS overlap FROM t x JOIN t y ON y.doc_id = x.doc_id + 1""",
    "fn24_emails": """WITH e AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}') AS es FROM documents),
        u AS (SELECT doc_id, list_filter(es, lambda x, i: list_position(es, x) = i) AS es FROM e)
        SELECT doc_id, CAST(len(es) AS INT) AS n_emails, array_to_string(es, ',') AS emails FROM u""",
}
