"""A training corpus from ``documents``: toxicity filter, near-duplicate removal, repeated passages,
benchmark decontamination, mixing to target weights.

Each stage takes and returns the columns of ``documents``; the last one adds ``copies``.  Decisions are made for
rows, not ids, so rows with a null id or with one id and different texts are treated like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import decontaminate, mixing, simhash, suffixes, toxicity
from parchment.llm.common import row_key, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Words of a passage: 51, less one at each end that other punctuation may alter.
PASSAGE_WORDS = 49

#: SQL can't express the networks, fingerprints and alignments of the stages.
ORACLE_SQL = None


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    net = toxicity.train_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(*COLUMNS), net, carry=COLUMNS[1:])
    return scored.where(F.col("score") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (SimHash candidates, five-word shingle sets of similarity 0.8 or more) the document
    with the least id."""
    return simhash.first_of_groups(docs, COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over fifty words that repeat."""
    cut = suffixes.remove_repeats(docs, min_words=PASSAGE_WORDS, carry=("lang", "source"))
    text = F.col("kept").cast("string")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = docs.select(row_key(COLUMNS).alias("_row"), *COLUMNS)
    leaks = decontaminate.leaks(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(leaks.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, with how often each is taken."""
    return mixing.sample(docs, carry=COLUMNS)


STAGES = [
    ("toxicity", filter_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
