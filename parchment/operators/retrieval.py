"""Hybrid retrieval of many questions at once: BM25 and vectors, per-query scaling, weighted sum, top k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import words

K1, B, EPSILON = 1.5, 0.75, 0.25
ALPHA = 0.6
DENSE_K = 3
TOP_K = 5
#: Query vectors that are sent to the tasks at once.
QUERY_BLOCK = 4096
#: Scores held at a time.
CELLS = 500_000


@dataclass
class Index:
    tokens: DataFrame  # doc_id, ts (all tokens), len
    terms: DataFrame  # term, idf
    totals: DataFrame  # one row: n_docs, avg_len


def bm25_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Postings of white-space tokens.  Terms in over half of the documents get a quarter of the mean idf."""
    tokens = docs.select(F.col(id_col).alias("doc_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("ts"))
    tokens = tokens.withColumn("len", F.size("ts"))
    totals = tokens.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    # a document counts once for a term, so one shuffle of combined counts is enough
    df = tokens.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(totals)).select(
        "term", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")
    )
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select(
        "term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf")
    )
    return Index(tokens, terms, totals)


def postings(index: Index, asked: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf, len) of all terms, or of those of ``asked`` alone: the others are left out before they are counted."""
    each = index.tokens.select("doc_id", "len", F.explode("ts").alias("term"))
    if asked is not None:
        each = each.join(asked.select("term").distinct(), "term", "left_semi")
    return each.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def bm25(queries: DataFrame, index: Index, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, doc_id, score) of the documents that share a term; repeated query words count again."""
    asked = (
        queries.select(F.col(id_col).alias("query_id"), F.explode(words(F.col(text_col))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )
    part = (
        F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1)
        / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    )
    return (
        asked.join(index.terms, "term")
        .join(postings(index, asked), "term")
        .crossJoin(F.broadcast(index.totals))
        .groupBy("query_id", "doc_id")
        .agg(F.sum(part).alias("score"))
    )


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = DENSE_K) -> DataFrame:
    """queries(query_id, embedding) x vectors(doc_id, embedding) -> (query_id, doc_id, score, rank) by cosine.

    The queries go to the tasks in blocks; every vector meets every query in matrix products and a task
    passes on its best k for each query."""
    out = None
    rows = queries.select("query_id", "embedding").toLocalIterator()
    while block := [r for _, r in zip(range(QUERY_BLOCK), rows)]:
        ids = np.array([r["query_id"] for r in block], np.int64)
        q = np.array([r["embedding"] for r in block], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        found = vectors.select("doc_id", "embedding").mapInArrow(_best(ids, q, k), "query_id long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(ids: np.ndarray, q: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple | None = None
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(doc):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(doc), -1)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            # a few vectors at a time, so that the scores of a step have a bounded size whatever the batch and the block of queries
            step = max(1, CELLS // len(q))
            for at in range(0, len(doc), step):
                s = q @ x[at : at + step].T
                d = np.broadcast_to(doc[at : at + step], s.shape)
                if best is not None:
                    s, d = np.concatenate([best[0], s], axis=1), np.concatenate([best[1], d], axis=1)
                order = np.lexsort((-d, -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
        if best is not None:
            s, d = best
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, s.shape[1])), pa.array(d.ravel()), pa.array(s.ravel())],
                ["query_id", "doc_id", "score"],
            )

    return run


def credit_hits(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """hits(query_id, rank, index, score), totals(n_docs) one row -> (query_id, doc_id, score): ``index`` is 1-based; others
    than 1..n_docs are ignored; of several hits of one document the later overwrites."""
    n = totals.select("n_docs")
    good = hits.crossJoin(F.broadcast(n)).where(F.col("index").between(1, F.col("n_docs")))
    return good.groupBy("query_id", F.col("index").cast("long").alias("doc_id")).agg(F.max_by("score", "rank").alias("score"))


def minmax(scores: DataFrame, totals: DataFrame) -> DataFrame:
    """Scores scaled per query over all documents, those without a row counting as zero; a constant gives zero."""
    bounds = scores.groupBy("query_id").agg(
        F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n")
    )
    full = bounds.crossJoin(F.broadcast(totals.select("n_docs"))).select(
        "query_id",
        F.when(F.col("n") < F.col("n_docs"), F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("n") < F.col("n_docs"), F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"),
    )
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return scores.join(full, "query_id").select("query_id", "doc_id", scaled.alias("score"))


def fuse(dense: DataFrame | None, lexical: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """alpha * dense + (1 - alpha) * lexical, zero where a side has no row."""
    low = lexical.select("query_id", "doc_id", F.col("score").alias("b"))
    if dense is None:
        return low.select("query_id", "doc_id", ((1 - alpha) * F.col("b")).alias("score"))
    high = dense.select("query_id", "doc_id", F.col("score").alias("a"))
    return high.join(low, ["query_id", "doc_id"], "full").select(
        "query_id",
        "doc_id",
        (alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0))).alias("score"),
    )


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """Best k by score, ties to the higher id; scores equal to nine places are ties, whatever order they were added up in."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, doc_id, score, rank): k rows for every query, filled up by documents of score zero, highest id first."""
    ids = queries.select(F.col("query_id"))
    # the k + k highest ids are enough to fill up, whatever the k best are
    spare = docs.select("doc_id").orderBy(F.desc("doc_id")).limit(2 * k)
    best = ranked(scores.where("score <> 0"), k).select("query_id", "doc_id", "score")
    fill = ids.join(F.broadcast(spare)).join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return ranked(best.unionByName(fill.select("query_id", "doc_id", F.lit(0.0).alias("score"))), k)


def compose_query(question: Column, label: Column, clause: Column) -> Column:
    return F.concat_ws("\n", question, F.when(F.trim(clause) != "", F.concat(label, F.lit(": "), clause)))


def retrieval_status(hits: DataFrame) -> DataFrame:
    """(query_id, status): success if any score is positive, partial if a row is incomplete, else insufficient."""
    return hits.groupBy("query_id").agg(
        F.when(~F.coalesce(F.bool_or(F.col("score") > 0), F.lit(False)), "insufficient")
        .when(~F.bool_and("complete"), "partial")
        .otherwise("success")
        .alias("status")
    )


def evidence_registry(hits: DataFrame) -> DataFrame:
    """One row a document over all queries: best rank, best score, the queries that found it."""
    return hits.groupBy("doc_id").agg(
        F.min("rank").alias("best_rank"),
        F.max("score").alias("best_score"),
        F.count("*").alias("times"),
        F.sort_array(F.collect_set("query_id")).alias("queries"),
    )


def match_reference(refs: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """refs with the id of the one document that has the same keys; none where there are several."""
    single = docs.groupBy(*keys).agg(F.count("*").alias("n"), F.min("doc_id").alias("match_id"))
    return refs.join(single, keys, "left").withColumn("match_id", F.when(F.col("n") == 1, F.col("match_id")))


def answer_context(hits: DataFrame, text: str = "content") -> DataFrame:
    """(query_id, context): texts in order of rank, a blank line between."""
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", text))).alias("r"))
    return rows.select("query_id", F.array_join(F.transform("r", lambda x: x[text]), "\n\n").alias("context"))


PLACEHOLDERS = ("", "-", "n/a", "unknown")


def to_evidence(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits(query_id, doc_id, rank, score) with docs(doc_id, name, part, content): rows with citation and completeness
    (name and content present, the name no placeholder)."""
    name = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    complete = ~name.isin(*PLACEHOLDERS) & (F.trim(F.coalesce("content", F.lit(""))) != "")
    cited = F.concat_ws(" — ", F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("part"), F.lit("")))
    return hits.join(docs, "doc_id", "left").select(
        "query_id", "doc_id", "rank", "score", "content",
        F.when(cited == "", "unidentified article").otherwise(cited).alias("citation"), complete.alias("complete"),
    )


def triggered_topics(fields: DataFrame, topics: DataFrame) -> DataFrame:
    """fields(document_id, field, status) x topics(topic, field): topics that a found or ambiguous field raises, with those fields."""
    raised = fields.where(F.col("status").isin("found", "ambiguous")).join(F.broadcast(topics), "field")
    return raised.groupBy("document_id", "topic").agg(F.sort_array(F.collect_set("field")).alias("fields"))


def clause_eligibility(clauses: DataFrame, topics: DataFrame, cap: int = 60) -> DataFrame:
    """clauses(document_id, clause_id, clause_type, confidence) with topics(clause_type, topic): whether each is looked up, and why not."""
    reason = (
        F.when(F.col("clause_type").isin("OTHER", "UNKNOWN") | F.col("clause_type").isNull(), "unclassified")
        .when(~F.col("confidence").isin("high", "medium"), "low confidence")
        .when(F.col("topic").isNull(), "no topic")
    )
    marked = clauses.join(F.broadcast(topics), "clause_type", "left").withColumn("reason", reason)
    order = Window.partitionBy("document_id", F.col("reason").isNull()).orderBy("clause_id")
    over = F.col("reason").isNull() & (F.row_number().over(order) > cap)
    return marked.withColumn("reason", F.when(over, "over the cap").otherwise(F.col("reason"))).withColumn("eligible", F.col("reason").isNull())


def clause_evidence(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """hits(clause_id, evidence_id, ...) that relevant(clause_id, evidence_id) names; all hits of clauses that it names none of."""
    good = hits.join(relevant, ["clause_id", "evidence_id"], "left_semi")
    rest = hits.join(relevant.select("clause_id").distinct(), "clause_id", "left_anti")
    return good.withColumn("fallback", F.lit(False)).unionByName(rest.withColumn("fallback", F.lit(True)))


def answer_status(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """answers(answer_id, text) with refs(answer_id, score, complete): insufficient without evidence (the text becomes a message) or
    without a positive score; partial with incomplete evidence."""
    by = refs.groupBy("answer_id").agg(F.bool_or(F.col("score") > 0).alias("any"), F.bool_and("complete").alias("whole"))
    status = F.when(~F.coalesce("any", F.lit(False)), "insufficient").when(~F.col("whole"), "partial").otherwise("success")
    none = F.col("any").isNull()
    return answers.join(by, "answer_id", "left").select(
        "answer_id", status.alias("status"), F.when(~none, F.col("text")).alias("answer"), F.when(none, F.col("text")).alias("message")
    )
