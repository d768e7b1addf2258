"""The registered queries of the numbered operators: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import decontaminate, gif, langid, lm, mixing, phrases, pieces, simhash, suffixes, tokens, toxicity, trie, warc
from parchment.llm.common import fold, stored, table


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(tokens.VOCABULARY)
    counts = stored(tokens.prefix_counts(table(spark, sf_dir, "documents"), path), "token-counts")
    return counts.drop("steps").withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_columns(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.label_spans(docs, langid.train(docs)).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "spans"
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_to_records(table(spark, sf_dir, "pages"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(pieces.VOCABULARY)
    coded = pieces.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op5_lm_scoring": op5_lm_scoring,
    "op4_source_mixing": op4_source_mixing,
    "op2_decontamination": op2_decontamination,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_media_columns": op10_media_columns,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_conversation_trie": op13_conversation_trie,
}

SQL: dict[str, str] = {
    "op1_warc_revisits": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                          sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op4_source_mixing": mixing.sample_sql(),
    "op11_phrase_collocations": phrases.collocations_sql(),
    "op13_conversation_trie": trie.prefix_trie_sql(),
}
