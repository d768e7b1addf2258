"""Lexical top k of many questions without gathering pairs: a stored index of posting blocks with their largest impacts.

Documents with like words are put side by side and cut into shards of ``SHARD``; a block holds one term's postings in one
shard with their impacts (the part of a BM25 score that doesn't depend on the question) and the largest of them.  A batch
of questions is answered in joins:

1. the blocks' largest impacts, without their postings, bound what each question can reach in each shard;
2. a question's most promising shards are scored, and its k-th best score so far is its threshold;
3. only shards whose bound reaches the threshold are scored for the question, so blocks of other subjects and languages are
   never read.

A shard scores a block of questions in one task by adding up impacts in an array of bounded size and passes on the best k
of each, with all that are tied for the last place but for copies.  So the rows that leave a shard don't grow with its
documents.  The scaling of a question's scores needs their least and largest over all documents: the largest is the best
one's, the least is zero as soon as one document has none of its words, for which a sample of witnesses is asked; a
question without a witness, or with terms of negative weight, is scored in all shards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.functions.text import words
from parchment.operators.retrieval import K1, B, EPSILON
from parchment.sources.shared import scratch, stored

#: Documents of a shard, and questions that one task scores at once.
SHARD, QUESTIONS = 1024, 1024
#: Shards that are scored for a question's threshold.
PROBES = 2
#: Documents asked for one that has none of a question's words.
WITNESSES = 256
#: Rounding ties that must not be lost, and differences that only come from the order of summation, as shares of a score.
SLACK, NOISE = 1e-8, 1e-12


@dataclass
class BlockIndex:
    """docs(doc_id, len, terms, tfs), blocks(shard, term, top, n, docs, impacts), terms(term, df, idf), totals: one row (n_docs, avg_len)."""

    docs: DataFrame
    blocks: DataFrame
    terms: DataFrame
    totals: DataFrame


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = regex.compile(r"[^ \t\n\r]+").findall
    for batch in batches:
        sizes, terms, tfs, first, second = [], [], [], [], []
        for text in batch.column(1):
            counted = Counter(split(text.as_py()))
            sizes.append(counted.total())
            common = [t for t, _ in counted.most_common(2)]
            first.append(common[0] if common else "")
            second.append(common[1] if len(common) > 1 else "")
            terms.append([*counted])
            tfs.append([*counted.values()])
        cols = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32())), pa.array(first), pa.array(second)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "len", "terms", "tfs", "first", "second"])


def _blocks(avg: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made, docs, sizes, postings = 0, [], [], {}

        def out() -> pa.RecordBatch:
            nonlocal made
            ids, base = np.array(docs, np.int64), K1 * (1 - B + B * np.array(sizes, np.float64) / avg)
            places = np.concatenate([np.array(p[0], np.int32) for p in postings.values()])
            tf = np.concatenate([np.array(p[1], np.float64) for p in postings.values()])
            impacts = tf * (K1 + 1) / (tf + base[places])
            ends = np.cumsum([0, *(len(p[0]) for p in postings.values())])
            offsets = pa.array(ends, pa.int32())
            tops = np.maximum.reduceat(impacts, ends[:-1])
            cols = [
                pa.array(np.full(len(postings), part << 32 | made)), pa.array([*postings], pa.string()), pa.array(tops), pa.array(np.diff(ends), pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(ids[places])), pa.ListArray.from_arrays(offsets, pa.array(impacts)),
            ]
            made += 1
            docs.clear(), sizes.clear(), postings.clear()
            return pa.RecordBatch.from_arrays(cols, ["shard", "term", "top", "n", "docs", "impacts"])

        for batch in batches:
            for doc, size, terms, tfs in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for t, f in zip(terms, tfs):
                    p = postings.get(t)
                    if p is None:
                        p = postings[t] = ([], [])
                    p[0].append(len(docs))
                    p[1].append(f)
                docs.append(doc)
                sizes.append(size)
                if len(docs) == SHARD and postings:
                    yield out()
        if postings:
            yield out()

    return run


def write_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> BlockIndex:
    """Build the index below ``path`` (a new folder of the shared one if none is named).  Documents' ids are unique."""
    spark = docs.sparkSession
    path = path or scratch(spark, "block-index")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    rows.mapInArrow(_counts, "doc_id long, len int, terms array<string>, tfs array<int>, first string, second string").write.parquet(f"{path}/docs")
    held = spark.read.parquet(f"{path}/docs")
    held.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")).write.parquet(f"{path}/totals")
    avg = spark.read.parquet(f"{path}/totals").first()["avg_len"] or 1.0
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    near = held.repartitionByRange(n, "first", "second", "doc_id").sortWithinPartitions("first", "second", "doc_id")
    made = near.select("doc_id", "len", "terms", "tfs").mapInArrow(_blocks(avg), "shard long, term string, top double, n long, docs array<long>, impacts array<double>")
    made.write.parquet(f"{path}/blocks")
    counted = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(spark.read.parquet(f"{path}/totals")))
    counted.select("term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")).write.parquet(f"{path}/terms")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> BlockIndex:
    """An index written before.  Terms in over half of the documents get a quarter of the mean weight."""
    raw = spark.read.parquet(f"{path}/terms")
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"))
    return BlockIndex(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/blocks"), terms, spark.read.parquet(f"{path}/totals"))


def impact(tf: Column, size: Column, avg: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avg))


def pair_scores(pairs: DataFrame, asked: DataFrame, index: BlockIndex) -> DataFrame:
    """Whole scores of few pairs(query_id, doc_id) from the documents' own terms; those without a common term score zero."""
    wanted = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("q"))
    found = index.docs.join(pairs, "doc_id").join(wanted, "query_id").crossJoin(F.broadcast(index.totals))
    found = found.withColumn("m", F.map_from_arrays("terms", "tfs"))
    each = F.transform("q", lambda t: F.struct(t["w"].alias("w"), F.try_element_at("m", t["term"]).alias("tf")))
    part = F.aggregate(each, F.lit(0.0), lambda s, t: s + F.coalesce(t["w"] * impact(t["tf"], F.col("len"), F.col("avg_len")), F.lit(0.0)))
    return found.select("query_id", "doc_id", part.alias("score"))


def _score_shard(k: int):
    def run(table: pa.Table) -> pa.Table:
        """Rows (query_ids, weights, docs, impacts) of one shard and block of questions."""
        query_lists, weight_lists, doc_lists, impact_lists = (table.column(c).to_pylist() for c in ("queries", "weights", "docs", "impacts"))
        queries, docs = np.unique(np.concatenate(query_lists)), np.unique(np.concatenate(doc_lists))
        scores, met = np.zeros((len(queries), len(docs))), np.zeros((len(queries), len(docs)), bool)
        for q, w, d, i in zip(query_lists, weight_lists, doc_lists, impact_lists):
            at = np.ix_(np.searchsorted(queries, q), np.searchsorted(docs, d))
            scores[at] += np.outer(w, i)
            met[at] = True
        out_q, out_d, out_s, out_n, out_lo = [], [], [], [], []
        for row, q in enumerate(queries):
            d = np.flatnonzero(met[row])
            s = scores[row, d]
            if not len(d):
                continue
            bar = -np.inf
            if len(d) > k:
                bar = np.partition(s, len(s) - k)[len(s) - k]
                bar -= SLACK * abs(bar)
            best = d[s >= bar]
            order = best[np.lexsort((-docs[best], -scores[row, best]))]
            v, kept, run_of = scores[row, order], [], 0
            for j in range(len(order)):  # of equal scores the k highest ids are enough
                run_of = run_of + 1 if j and v[j - 1] - v[j] <= NOISE * abs(v[j]) else 1
                if run_of <= k:
                    kept.append(order[j])
            out_q += [q] * len(kept)
            out_d += docs[kept].tolist()
            out_s += scores[row, kept].tolist()
            out_n += [len(d)] + [0] * (len(kept) - 1)
            out_lo += [s.min()] * len(kept)
        cols = {"query_id": pa.array(out_q, pa.int64()), "doc_id": pa.array(out_d, pa.int64()), "score": pa.array(out_s, pa.float64()), "n": pa.array(out_n, pa.int64()), "lo": pa.array(out_lo, pa.float64())}
        return pa.table(cols)

    return run


def _score(wanted: DataFrame, asked: DataFrame, index: BlockIndex, k: int) -> DataFrame:
    """(query_id, doc_id, score, n, lo): the best of wanted(query_id, shard), with the number and least score of all that
    have a word (the number once for a question and shard)."""
    terms = wanted.join(asked.select("query_id", "term", "w"), "query_id")
    part = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("_n") / QUESTIONS)).alias("part")
    n = asked.agg(F.countDistinct("query_id").alias("_n"))
    terms = terms.crossJoin(F.broadcast(n)).groupBy("shard", part, "term").agg(F.collect_list(F.struct("query_id", "w")).alias("q"))
    rows = terms.join(index.blocks.select("shard", "term", "docs", "impacts"), ["shard", "term"])
    rows = rows.select("shard", "part", F.col("q.query_id").alias("queries"), F.col("q.w").alias("weights"), "docs", "impacts")
    return rows.groupBy("shard", "part").applyInArrow(_score_shard(k), "query_id long, doc_id long, score double, n long, lo double")


@dataclass
class Ranked:
    scores: DataFrame  # query_id, doc_id, score: all that may be among the best k, and the pairs asked for
    bounds: DataFrame  # query_id, lo, hi: least and largest score over all documents
    shards: DataFrame  # query_id, shard: what was scored


def lexical_topk(queries: DataFrame, index: BlockIndex, k: int, also: DataFrame | None = None, id_col: str = "query_id", text_col: str = "query") -> Ranked:
    """Scores of each question's best k documents (ties for the last place included) and of the pairs ``also`` (query_id, doc_id)."""
    asked = (
        queries.select(F.col(id_col).cast("long").alias("query_id"), F.explode(words(F.col(text_col))).alias("term"))
        .groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        .join(index.terms, "term")
        .select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    )
    asked = stored(asked, "asked")
    met = asked.join(index.blocks.select("shard", "term", "top"), "term").groupBy("query_id", "shard").agg(F.sum(F.greatest("w", F.lit(0.0)) * F.col("top")).alias("bound"))

    # questions that must be scored whole: terms of negative weight, or no witness without their words
    witnesses = index.docs.select("doc_id", "terms").orderBy(F.xxhash64("doc_id"), "doc_id").limit(WITNESSES)
    n_seen = witnesses.agg(F.count("*").alias("n_seen"))
    held = witnesses.select("doc_id", F.explode("terms").alias("term")).join(asked.select("query_id", "term"), "term")
    covered = held.groupBy("query_id").agg(F.countDistinct("doc_id").alias("c")).crossJoin(F.broadcast(n_seen)).where("c = n_seen").select("query_id")
    whole = covered.unionByName(asked.where("w < 0").select("query_id")).distinct().withColumn("whole", F.lit(True))
    met = stored(met.join(whole, "query_id", "left"), "bounds")

    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "shard")
    first = met.withColumn("at", F.row_number().over(by_bound)).where(F.col("at") <= PROBES).drop("at")
    probed = stored(_score(first.select("query_id", "shard"), asked, index, k), "probed")
    falling = Window.partitionBy("query_id").orderBy(F.desc("score"))
    bar = probed.withColumn("at", F.row_number().over(falling)).where(F.col("at") == k).select("query_id", (F.col("score") - SLACK * F.abs("score")).alias("bar"))
    rest = met.join(first.select("query_id", "shard"), ["query_id", "shard"], "left_anti").join(bar, "query_id", "left")
    rest = stored(rest.where(F.col("whole") | F.col("bar").isNull() | (F.col("bound") >= F.col("bar"))).select("query_id", "shard"), "wanted")
    found = stored(probed.unionByName(_score(rest, asked, index, k)), "found")

    ends = found.groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("score").alias("hi"), F.sum("n").alias("n")).join(whole, "query_id", "left")
    part = F.col("whole").isNull() | (F.col("n") < F.col("n_docs"))  # some document has none of the words
    bounds = ends.crossJoin(F.broadcast(index.totals)).select(
        "query_id", F.when(part, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"), F.when(part, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi")
    )
    scores = found.select("query_id", "doc_id", "score")
    if also is not None:
        new = also.select(F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id")).distinct().join(scores, ["query_id", "doc_id"], "left_anti")
        scores = scores.unionByName(pair_scores(new, asked, index))
    return Ranked(scores, bounds, first.select("query_id", "shard").unionByName(rest))


def scaled(ranked: Ranked) -> DataFrame:
    """Scores scaled by each question's least and largest over all documents; a constant gives zero."""
    part = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return ranked.scores.join(ranked.bounds, "query_id").select("query_id", "doc_id", part.alias("score"))
