"""Queries of hybrid retrieval and its evaluation.  Questions are the words of benchmark items; a question's
vector is the embedding of its number, a document's that of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions.text import words
from parchment.functions.values import similarity_pct
from parchment.operators import evaluate as E
from parchment.operators import impacts as I
from parchment.operators import retrieval as R
from parchment.sources.shared import stored
from parchment.sources.tables import read_table


def questions(spark, sf):
    b = read_table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(words(F.col("text")), " ").alias("query"))


def _vectors(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _lexical(spark, sf):
    docs = read_table(spark, sf, "documents")
    index = R.bm25_index(docs)
    return R.bm25(questions(spark, sf), index), index, docs


def _dense(spark, sf):
    v = _vectors(spark, sf)
    q = questions(spark, sf).join(v, F.col("query_id") == F.col("doc_id")).select("query_id", "embedding")
    return R.dense_topk(q, v)


def _hybrid(spark, sf, k=R.TOP_K):
    """Only documents that may be among the best are scored: those of the stored index's shards that reach the threshold, and
    the dense hits."""
    docs = read_table(spark, sf, "documents")
    index = I.write_index(docs)
    dense = stored(_dense(spark, sf).select("query_id", "doc_id", "score"), "dense")
    lex = I.lexical_topk(questions(spark, sf), index, k, also=dense)
    return R.topk(R.fuse(R.minmax(dense, index.totals), I.scaled(lex)), questions(spark, sf), docs, k)


def _shown(df):
    return df.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def ret01(spark, sf):
    i = R.bm25_index(read_table(spark, sf, "documents"))
    return i.terms.select("term", F.round("idf", 6).alias("idf"))


def ret02(spark, sf):
    return _lexical(spark, sf)[0].select("query_id", "doc_id", F.round("score", 5).alias("score"))


def ret02_topk(spark, sf):
    """The best five by words alone, from the block index."""
    index = I.write_index(read_table(spark, sf, "documents"))
    return _shown(R.ranked(I.lexical_topk(questions(spark, sf), index, 5).scores, 5))


def ret03(spark, sf):
    v = _vectors(spark, sf)
    q = v.where(F.col("doc_id") % 20 == 0).withColumnRenamed("doc_id", "query_id")
    return R.dense_topk(q, v).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def ret04(spark, sf):
    hits = _dense(spark, sf).select("query_id", "rank", F.col("doc_id").alias("index"), "score")
    totals = read_table(spark, sf, "documents").agg(F.count("*").alias("n_docs"))
    return R.credit_hits(hits, totals).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def ret05(spark, sf):
    lex, index, _ = _lexical(spark, sf)
    return R.minmax(lex, index.totals).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def ret06(spark, sf):
    lex, index, _ = _lexical(spark, sf)
    fused = R.fuse(R.minmax(_dense(spark, sf).select("query_id", "doc_id", "score"), index.totals), R.minmax(lex, index.totals))
    return fused.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def ret07(spark, sf):
    return _shown(_hybrid(spark, sf))


def ret08(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", R.compose_query(F.col("role"), F.concat(F.lit("turn "), "turn"), F.col("text")).alias("query"))


def ret10(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("digest"))
    refs = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("ref_id"), "lang", "digest")
    return R.match_reference(refs, d, ["lang", "digest"]).select("ref_id", "match_id")


def _complete(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 300).alias("complete"))
    return _hybrid(spark, sf).join(d, "doc_id")


def ret11(spark, sf):
    return R.retrieval_status(_complete(spark, sf))


def ret13(spark, sf):
    r = R.evidence_registry(_hybrid(spark, sf))
    return r.select("doc_id", "best_rank", F.round("best_score", 6).alias("best_score"), "times", F.array_join("queries", ",").alias("queries"))


def ret14(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.col("lang").alias("topic"))
    return E.topic_evidence(R.evidence_registry(_hybrid(spark, sf)).join(d, "doc_id"), cap=6).select("topic", "place", "doc_id")


def ret18(spark, sf):
    return E.index_health(read_table(spark, sf, "documents"), _vectors(spark, sf), 64)


def ret19(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return R.answer_context(_hybrid(spark, sf).join(d, "doc_id"))


def _gold(spark, sf):
    """The least document that holds an item's whole text."""
    from parchment.operators.grounding import containing

    return containing(read_table(spark, sf, "benchmark"), read_table(spark, sf, "documents"), "item_id", "doc_id").groupBy(
        F.col("item_id").alias("query_id")
    ).agg(F.min("doc_id").alias("gold"))


def evl01(spark, sf):
    m = E.retrieval_metrics(_hybrid(spark, sf), _gold(spark, sf), 5)
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("hit", "recall", "mrr", "ndcg")])


def evl02(spark, sf):
    return E.metrics_by_group(_hybrid(spark, sf), _gold(spark, sf), 5).select("gold", "n", F.round("mrr", 6).alias("mrr"))


def evl04(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return E.pair_similarity(e, "vec_id", "embedding", "label").select("label", "n", F.round("mean", 5).alias("mean"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


def fn16b(spark, sf):
    return _hybrid(spark, sf).select("query_id", "rank", similarity_pct(F.round("score", 6)).alias("pct"))


def grd01(spark, sf):
    from parchment.operators.grounding import containing

    return containing(read_table(spark, sf, "benchmark"), read_table(spark, sf, "documents"), "item_id", "doc_id")


QUERIES = {
    "ret01_index": ret01,
    "ret02_bm25": ret02,
    "ret02_topk": ret02_topk,
    "ret03_dense_topk": ret03,
    "ret04_credit": ret04,
    "ret05_minmax": ret05,
    "ret06_fuse": ret06,
    "ret07_hybrid_topk": ret07,
    "ret08_compose": ret08,
    "ret10_match_reference": ret10,
    "ret11_status": ret11,
    "ret13_registry": ret13,
    "ret14_topic_evidence": ret14,
    "ret18_health": ret18,
    "ret19_context": ret19,
    "evl01_metrics": evl01,
    "evl02_by_article": evl02,
    "evl04_similarity": evl04,
    "grd01_quotes": grd01,
}

_BASE = """
 q AS MATERIALIZED (SELECT item_id AS query_id, regexp_extract_all(text, '[^ \t\n\r]+') AS ts FROM benchmark),
 tok AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+') AS ts FROM documents),
 tot AS MATERIALIZED (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_len FROM tok),
 post AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(ts) AS l, unnest(ts) AS term FROM tok) GROUP BY ALL),
 raw AS MATERIALIZED (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df FROM post GROUP BY term), tot),
 terms AS MATERIALIZED (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
 lex AS MATERIALIZED (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avg_len))) AS score
   FROM (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(ts) AS term FROM q) GROUP BY ALL) JOIN terms USING (term) JOIN post USING (term), tot GROUP BY ALL),
 vq AS (SELECT query_id, CAST(embedding AS DOUBLE[]) AS e FROM q JOIN embeddings ON vec_id = query_id),
 dense AS MATERIALIZED (SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(e, CAST(embedding AS DOUBLE[])) AS score,
   row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(e, CAST(embedding AS DOUBLE[])) DESC, vec_id DESC) AS rank FROM vq, embeddings) WHERE rank <= 3)"""


def _scaled(name: str, source: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT query_id, doc_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS score FROM {source} JOIN
   (SELECT query_id, CASE WHEN n < n_docs THEN least(lo, 0) ELSE lo END AS lo, CASE WHEN n < n_docs THEN greatest(hi, 0) ELSE hi END AS hi FROM
   (SELECT query_id, min(score) AS lo, max(score) AS hi, count(*) AS n FROM {source} GROUP BY query_id), tot) USING (query_id))"""


_FUSED = (
    _BASE
    + ",\n"
    + _scaled("lexs", "lex")
    + ",\n"
    + _scaled("denses", "dense")
    + """,
 fused AS MATERIALIZED (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id,
   0.6 * coalesce(a.score, 0) + 0.4 * coalesce(b.score, 0) AS score FROM denses a FULL JOIN lexs b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
 best AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM fused UNION ALL
   SELECT query_id, doc_id, 0 FROM q, (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 10) d
   WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = q.query_id AND f.doc_id = d.doc_id)),
 hybrid AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC) AS INT) AS rank FROM best) WHERE rank <= 5),
 reg AS (SELECT doc_id, min(rank) AS best_rank, max(score) AS best_score, count(*) AS times, list_sort(list_distinct(list(query_id))) AS qs FROM hybrid GROUP BY doc_id),
 gold AS MATERIALIZED (SELECT item_id AS query_id, min(d.doc_id) AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
 met AS (SELECT g.query_id, gold, h.rank FROM gold g LEFT JOIN hybrid h ON h.query_id = g.query_id AND h.doc_id = g.gold)"""
)

SQL = {
    "ret01_index": f"WITH {_BASE} SELECT term, round(idf, 6) AS idf FROM terms",
    "ret02_bm25": f"WITH {_BASE} SELECT query_id, doc_id, round(score, 5) AS score FROM lex",
    "ret02_topk": f"""WITH {_BASE} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT query_id, doc_id, score,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC) AS INT) AS rank FROM lex) WHERE rank <= 5""",
    "ret03_dense_topk": """SELECT query_id, doc_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
        list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id DESC) AS rank
        FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 3""",
    "ret04_credit": f"WITH {_BASE} SELECT query_id, doc_id, round(score, 6) AS score FROM dense WHERE doc_id BETWEEN 1 AND (SELECT count(*) FROM documents)",
    "ret05_minmax": f"WITH {_BASE}, {_scaled('lexs', 'lex')} SELECT query_id, doc_id, round(score, 6) AS score FROM lexs",
    "ret06_fuse": f"WITH {_FUSED} SELECT query_id, doc_id, round(score, 6) AS score FROM fused",
    "ret07_hybrid_topk": f"WITH {_FUSED} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM hybrid",
    "ret08_compose": """SELECT conv_id, turn, concat_ws(chr(10), role, CASE WHEN trim(text) <> '' THEN 'turn ' || turn || ': ' || text END) AS query FROM conversations""",
    "ret10_match_reference": """WITH m AS (SELECT lang, md5(text) AS digest, count(*) AS n, min(doc_id) AS match_id FROM documents GROUP BY ALL)
        SELECT d.doc_id AS ref_id, CASE WHEN n = 1 THEN match_id END AS match_id FROM documents d LEFT JOIN m ON d.lang = m.lang AND md5(d.text) = m.digest WHERE d.doc_id % 20 = 0""",
    "ret11_status": f"""WITH {_FUSED} SELECT query_id, CASE WHEN NOT bool_or(score > 0) THEN 'insufficient' WHEN NOT bool_and(n_chars > 300) THEN 'partial' ELSE 'success' END AS status
        FROM hybrid JOIN documents USING (doc_id) GROUP BY query_id""",
    "ret13_registry": f"WITH {_FUSED} SELECT doc_id, best_rank, round(best_score, 6) AS best_score, times, array_to_string(qs, ',') AS queries FROM reg",
    "ret14_topic_evidence": f"""WITH {_FUSED} SELECT topic, place, doc_id FROM (SELECT lang AS topic, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY best_rank, round(best_score, 9) DESC, doc_id) AS INT) AS place
        FROM reg JOIN documents USING (doc_id)) WHERE place <= 6""",
    "ret18_health": """SELECT n_docs, n_vectors, n_bad, CASE WHEN n_vectors = 0 THEN 'no vectors' WHEN n_bad > 0 THEN 'wrong dimension' WHEN n_docs <> n_vectors THEN 'counts differ' ELSE 'ok' END AS health
        FROM (SELECT count(*) AS n_docs FROM documents), (SELECT count(*) AS n_vectors, count(*) FILTER (len(embedding) <> 64) AS n_bad FROM embeddings)""",
    "ret19_context": f"""WITH {_FUSED} SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM hybrid JOIN documents USING (doc_id) GROUP BY query_id""",
    "evl01_metrics": f"""WITH {_FUSED} SELECT count(*) AS n, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 6) AS hit, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 6) AS recall,
        round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(coalesce(1 / log2(rank + 1), 0)), 6) AS ndcg FROM met""",
    "evl02_by_article": f"WITH {_FUSED} SELECT gold, count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM met GROUP BY gold",
    "evl04_similarity": """WITH c AS (SELECT label, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY label),
        n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings)
        SELECT label, count(*) AS n, round(avg(s), 5) AS mean, round(min(s), 5) AS low, round(max(s), 5) AS high FROM (SELECT label, list_cosine_similarity(e, f) AS s FROM n WHERE f IS NOT NULL) GROUP BY label""",
    "grd01_quotes": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
}
