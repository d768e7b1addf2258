"""Evaluation of retrieval and quality of labelled data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.sources.shared import stored


def _per_question(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    hits = ranked.where(F.col("rank") <= k).select("query_id", F.col("doc_id").alias("gold"), "rank")
    return gold.join(hits, ["query_id", "gold"], "left").select(
        "query_id",
        "gold",
        F.col("rank").isNotNull().cast("double").alias("hit"),
        F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("mrr"),
        F.coalesce(1 / F.log2(F.col("rank") + 1), F.lit(0.0)).alias("ndcg"),
    )


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """One row: n, hit, recall (the same with one gold document), mrr, ndcg at k; misses count 0."""
    return _per_question(ranked, gold, k).agg(
        F.count("*").alias("n"),
        F.avg("hit").alias("hit"),
        F.avg("hit").alias("recall"),
        F.avg("mrr").alias("mrr"),
        F.avg("ndcg").alias("ndcg"),
    )


def metrics_by_group(ranked: DataFrame, gold: DataFrame, k: int = 5, group: DataFrame | None = None) -> DataFrame:
    """Averages per gold document; with ``group`` (query_id, group) each group of repeated questions counts once."""
    rows = _per_question(ranked, gold, k)
    if group is not None:
        rows = rows.join(group, "query_id", "left").groupBy("gold", F.coalesce("group", F.col("query_id").cast("string"))).agg(
            F.avg("hit").alias("hit"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg")
        )
    return rows.groupBy("gold").agg(F.count("*").alias("n"), F.avg("hit").alias("hit"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"))


def number_accuracy(ranked: DataFrame, gold: DataFrame, articles: DataFrame) -> DataFrame:
    """Share of questions whose first row has the right index, and the right article number."""
    n = articles.select(F.col("index").alias("doc_id"), F.col("article_number").alias("number"))
    first = ranked.where("rank = 1").join(n, "doc_id").select("query_id", F.col("doc_id").alias("got"), F.col("number").alias("got_number"))
    want = gold.join(n, F.col("gold") == F.col("doc_id")).select("query_id", "gold", "number")
    return want.join(first, "query_id", "left").agg(
        F.avg(F.coalesce(F.col("got") == F.col("gold"), F.lit(False)).cast("double")).alias("index_accuracy"),
        F.avg(F.coalesce(F.col("got_number") == F.col("number"), F.lit(False)).cast("double")).alias("number_accuracy"),
    )


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def pair_similarity(df: DataFrame, id_col: str, vector: str, group: str) -> DataFrame:
    """Distribution of the cosine of each vector and the next of its group."""
    nxt = F.lead(vector).over(Window.partitionBy(group).orderBy(id_col))
    s = df.withColumn("_next", nxt).where("_next IS NOT NULL").select(group, cosine(F.col(vector), F.col("_next")).alias("s"))
    return s.groupBy(group).agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.min("s").alias("low"), F.max("s").alias("high"))


def topic_evidence(registry: DataFrame, cap: int = 6) -> DataFrame:
    """registry(topic, doc_id, best_rank, best_score): the first ``cap`` of each topic by rank, then score."""
    order = Window.partitionBy("topic").orderBy("best_rank", F.desc(F.round("best_score", 9)), "doc_id")
    return registry.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def topic_relevance(evidence: DataFrame, keywords: DataFrame) -> DataFrame:
    """evidence(evidence_id, key_text, score) x keywords(topic, group_no, keyword): topics of which every group has a
    keyword at a word's start in the folded text, for evidence with a positive score."""
    groups: dict[str, dict[int, list[str]]] = {}
    for r in keywords.collect():  # a rule table
        groups.setdefault(r["topic"], {}).setdefault(r["group_no"], []).append(r["keyword"])
    spaced = F.concat(F.lit(" "), F.col("key_text"))
    tried = []
    for topic, parts in groups.items():
        every = reduce(Column.__and__, [reduce(Column.__or__, [spaced.contains(" " + w) for w in ws]) for ws in parts.values()])
        tried.append(F.when(every, F.lit(topic)))
    return evidence.where("score > 0").select("evidence_id", F.explode(F.array_compact(F.array(*tried))).alias("topic")).distinct()


def index_health(docs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    n = docs.agg(F.count("*").alias("n_docs"))
    v = vectors.agg(F.count("*").alias("n_vectors"), F.count_if(F.size("embedding") != dim).alias("n_bad"))
    health = (
        F.when(F.col("n_vectors") == 0, "no vectors")
        .when(F.col("n_bad") > 0, "wrong dimension")
        .when(F.col("n_docs") != F.col("n_vectors"), "counts differ")
        .otherwise("ok")
    )
    return n.crossJoin(F.broadcast(v)).withColumn("health", health)  # one row each


def duplicate_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, duplicate_group): ``dup_`` and a digest for texts that occur more than once.  Counts are joined back, so a
    very frequent text is not gathered."""
    digest = F.sha1(text_col)
    rows = df.select(id_col, digest.alias("digest"))
    many = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return rows.join(many, "digest").select(id_col, F.concat(F.lit("dup_"), F.substring("digest", 1, 8)).alias("duplicate_group"))


def quarantine(questions: DataFrame, placeholders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined) by a list of placeholder texts."""
    return questions.join(placeholders, "question", "left_anti"), questions.join(placeholders, "question", "left_semi")


def stratified_subset(cases: DataFrame, target: int = 40, each: int = 8) -> DataFrame:
    """cases(case_id, overlap, shared, short_neighbour, index) -> (case_id, stratum): up to ``each`` of shared number, high and low
    overlap and short neighbours, then every n-th by index up to ``target``; a case is taken once."""
    def take(rest: DataFrame, name: str, order: list[Column], n: int) -> DataFrame:
        return rest.orderBy(*order).limit(n).select("case_id", F.lit(name).alias("stratum"))

    # every stratum looks at all cases: what a case is measured by is reckoned once, and each stratum's few rows are
    cases = stored(cases.select("case_id", "overlap", "shared", "short_neighbour", "index"), "cases")
    chosen = stored(take(cases.where("shared"), "shared_number", [F.col("case_id")], each), "chosen")
    for name, rows, order in (
        ("high_overlap", cases, [F.desc("overlap"), F.desc("case_id")]),
        ("low_overlap", cases, [F.asc("overlap"), F.asc("case_id")]),
        ("near_neighbour", cases.where("short_neighbour"), [F.asc("case_id")]),
    ):
        chosen = stored(chosen.unionByName(take(rows.join(F.broadcast(chosen), "case_id", "left_anti"), name, order, each)), "chosen")
    left = F.lit(target) - F.count("*")
    room = chosen.agg(left.alias("room"))
    n = cases.agg(F.count("*").alias("n"))
    spread = numbered(cases.select("case_id", "index"), "index", ["case_id"], "no")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / F.greatest(F.lit(1), F.col("room"))))
    every = spread.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(room)).where(F.pmod(F.col("no") - 1, step) == 0)
    # the first ``target`` of them are enough, as there is room for fewer
    fill = every.join(F.broadcast(chosen), "case_id", "left_anti").orderBy("no").limit(target)
    fill = fill.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("no")))  # of ``target`` rows
    return chosen.unionByName(fill.where(F.col("k") <= F.col("room")).select("case_id", F.lit("coverage").alias("stratum")))


#: Rows of a range that is numbered by itself, about.
RANGE_ROWS = 500_000


def numbered(df: DataFrame, column: str, ties: list[str], name: str) -> DataFrame:
    """``df`` with row numbers from 1 by a column and its ties, nulls first.

    A sample of the rows gives splitters over column and ties together, so that a value with many ties is many ranges; their
    number follows the number of rows.  Rows are numbered within ranges, and the ranges' sizes give their offsets.  Rows that
    are equal in column and ties stay together; their order is arbitrary."""
    order = [F.col(c).asc_nulls_first() for c in (column, *ties)]
    held = stored(df, "unnumbered")
    n = -(-held.count() // RANGE_ROWS) or 1
    placed = stored(held.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, within + F.col("_before")).drop("_range", "_before")


def case_profile(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each key alone and in all, in one pass of grouping sets."""
    return cases.rollup(*keys).agg(F.count("*").alias("n"))


def validate_cases(cases: DataFrame, articles: DataFrame) -> DataFrame:
    """cases(case_id, gold_index, reviewed_by, review_status, question, duplicate_group) -> (problem, case_id)."""
    def problem(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("problem"), "case_id")

    repeated = cases.groupBy("case_id").count().where("count > 1")
    lost = cases.join(articles.select(F.col("index").alias("gold_index")), "gold_index", "left_anti").where("gold_index IS NOT NULL")
    false_review = cases.where((F.col("review_status") == "reviewed") & F.col("reviewed_by").isNull())
    texts = cases.groupBy("question").agg(F.count("*").alias("n")).where("n > 1").select("question")
    unmarked = cases.where("duplicate_group IS NULL").join(texts, "question", "left_semi")
    parts = [problem(repeated, "repeated id"), problem(lost, "unknown article"), problem(false_review, "review without reviewer"), problem(unmarked, "unmarked duplicate")]
    return reduce(DataFrame.unionByName, parts)


def explode_questions(lists: DataFrame) -> DataFrame:
    """lists(index, json): an array of questions, or an object with ``questions`` -> (index, question_no, question)."""
    both = F.coalesce(F.from_json("json", "array<string>"), F.from_json("json", "questions array<string>")["questions"])
    return lists.select("index", F.posexplode(both).alias("question_no", "question"))


def variants(base: DataFrame, mutations: DataFrame) -> DataFrame:
    """base(record_id, key, value) x mutations(mutation, key, new_value): each record once for each mutation, one key
    replaced, or removed where new_value is null."""
    listed = [
        F.struct(F.lit(m["mutation"]).alias("mutation"), F.lit(m["key"]).alias("_key"), F.lit(m["new_value"]).cast("string").alias("new_value"))
        for m in mutations.collect()  # a short list
    ]
    every = base.select("*", F.inline(F.array(*listed)))
    hit = F.col("key") == F.col("_key")
    return every.where(~hit | F.col("new_value").isNotNull()).select(
        "record_id", "mutation", "key", F.when(hit, F.col("new_value")).otherwise(F.col("value")).alias("value")
    )


def score_extraction(expected: DataFrame, fields: DataFrame) -> DataFrame:
    """expected(case_id, field, status, contains, review_only) against fields(case_id, field, status, value)."""
    f = fields.select("case_id", "field", F.col("status").alias("got"), "value")
    right = (F.col("got") == F.col("status")) & F.coalesce(F.contains("value", "contains"), F.col("contains").isNull())
    return expected.join(f, ["case_id", "field"], "left").select(
        "case_id", "field",
        F.when(F.col("review_only"), "review").when(F.coalesce(right, F.lit(False)), "pass").otherwise("fail").alias("result"),
    )
