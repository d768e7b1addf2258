"""Checks of recorded answers against their evidence."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.functions.text import article_mentions, matching_key

#: Folded letters that a quote needs at least.
LEAST_QUOTE = 12


#: Bytes of quotes that one automaton holds.
BLOCK_BYTES = 32 << 20


def containing(
    quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str, text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(quote_id, text_id) of every text that holds a quote word for word, a row for each pair of ids (repeated rows repeat it).

    The distinct quotes are dealt by their hash into blocks of about ``block_bytes`` (one block for up to that many bytes); a
    block's quotes become one automaton with failure links, which is sent to the tasks and run once over the scan of the texts,
    whatever the number and length of its quotes.  The texts are not shuffled and not cut into words.  A text's matches are
    joined to the ids of quotes with that wording.  Null and empty quotes and null texts match nothing."""
    spark = quotes.sparkSession
    asked = quotes.where(F.col(text_col) != "").select(F.col(quote_id), F.col(text_col).cast("string").alias("_quote"))
    distinct = asked.select("_quote").distinct()
    size = distinct.agg(F.sum(F.octet_length("_quote"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    scanned = texts.where(F.col(text_col).isNotNull()).select(F.col(text_id), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([scanned.schema[0], T.StructField("_quote", T.StringType())])
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        part = distinct.where(F.pmod(F.xxhash64("_quote"), F.lit(blocks)) == block)
        patterns = spark.sparkContext.broadcast(part.toArrow().column(0).to_pylist())  # about ``block_bytes``
        hits = scanned.mapInArrow(_matches(patterns), schema)
        found = hits if blocks == 1 else found.unionByName(hits)
    return found.join(asked, "_quote").select(quote_id, text_id)


_automata: dict[int, ahocorasick.Automaton] = {}


def _machine(number: int, patterns: list[str]) -> ahocorasick.Automaton:
    """The automaton of a broadcast block, which a worker keeps until it meets another."""
    if number not in _automata:
        machine = ahocorasick.Automaton()
        for p in patterns:
            machine.add_word(p, p)
        machine.make_automaton()
        _automata.clear()
        _automata[number] = machine
    return _automata[number]


def _matches(patterns: Broadcast):
    number = patterns._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(number, patterns.value)
        for batch in batches:
            at, quotes = [], []
            for i, text in enumerate(batch.column(1)):
                met = {p for _, p in machine.iter(text.as_py())}
                at += [i] * len(met)
                quotes += met
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(quotes, pa.string())], [batch.schema.names[0], "_quote"])

    return run


def verify_quotes(quotes: DataFrame, evidence: DataFrame) -> DataFrame:
    """quotes(answer_id, evidence_id, quote) against evidence(evidence_id, arabic, english): where each quote was found."""
    key = matching_key(F.col("quote"))
    return quotes.join(evidence, "evidence_id", "left").select(
        "answer_id",
        "evidence_id",
        F.when(F.length(key) < LEAST_QUOTE, "too_short")
        .when(F.contains(matching_key(F.col("arabic")), key), "arabic")
        .when(F.contains(matching_key(F.col("english")), key), "english")
        .otherwise("not_found")
        .alias("found_in"),
    )


def verify_contract_quote(quote: Column, raw: Column, sources: Column) -> Column:
    key = matching_key(quote)
    inside = F.contains(matching_key(raw), key) | F.exists(sources, lambda s: F.contains(matching_key(s), key))
    return (key != "") & F.coalesce(inside, F.lit(False))


def foreign_articles(text: Column, allowed: Column) -> Column:
    return F.array_except(article_mentions(text), allowed)


def gate_verdicts(verdicts: DataFrame, quotes: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """verdicts(answer_id, assessment, cited_ids, contract_quote_ok, foreign) with quotes(answer_id, evidence_id, found_in) and the
    supplied evidence(answer_id, evidence_id): (answer_id, status, problems).  Where the answers hold them as lists, verdicts has
    ``quotes`` (of evidence_id and found_in) and ``supplied`` (of ids) instead of the tables.

    A verdict on compliance stands only if an Arabic quote of a supplied article that it cites was found, nothing that it cites or
    quotes was not supplied, its contract quote was found and it mentions no foreign article; else it becomes a review.  Ids that are
    null count as not supplied, and each verdict is judged by what it cites itself.

    Lists are judged in their row.  Tables are gathered by answer once: quotes and evidence in one shuffle, verdicts in another."""
    if quotes is not None or evidence is not None:
        verdicts = _with_lists(verdicts, quotes, evidence)
    no, ids, pairs = F.lit(False), F.array().cast("array<string>"), "array<struct<evidence_id:string,found_in:string>>"
    cited, supplied = (F.coalesce(F.col(c).cast("array<string>"), ids) for c in ("cited_ids", "supplied"))
    quoted = F.coalesce(F.transform("quotes", lambda q: F.struct(q["evidence_id"].cast("string"), q["found_in"].cast("string"))).cast(pairs), F.array().cast(pairs))

    def known(e: Column) -> Column:
        return F.coalesce(F.array_contains(supplied, e), no)

    arabic = F.transform(F.filter(quoted, lambda q: q["found_in"] == "arabic"), lambda q: q["evidence_id"])
    strange = F.exists(F.concat(cited, F.transform(quoted, lambda q: q["evidence_id"])), lambda e: ~known(e))
    proven = F.exists(cited, lambda e: known(e) & F.coalesce(F.array_contains(arabic, e), no))
    problems = F.array_compact(
        F.array(
            F.when(strange, "evidence not supplied"),
            F.when(~proven, "no quote of a cited article"),
            F.when(~F.coalesce("contract_quote_ok", no), "contract quote not found"),
            F.when(F.size("foreign") > 0, "foreign article"),
        )
    )
    claim = F.col("assessment").isin("compliant", "non_compliant")
    problems = F.when(claim, problems).otherwise(ids)
    return verdicts.select("answer_id", "assessment", problems.alias("problems")).select(
        "answer_id", F.when(F.size("problems") > 0, "requires_review").otherwise(F.col("assessment")).alias("status"), "problems"
    )


def _with_lists(verdicts: DataFrame, quotes: DataFrame, evidence: DataFrame) -> DataFrame:
    """verdicts with the distinct quotes and supplied ids of their answer as lists."""
    evidence_id = F.col("evidence_id").cast("string")
    quote = F.struct(evidence_id.alias("evidence_id"), F.col("found_in").cast("string").alias("found_in"))
    rows = quotes.select("answer_id", quote.alias("quote"), F.lit(None).cast("string").alias("supplied"))
    given = evidence.select("answer_id", F.lit(None).cast(rows.schema["quote"].dataType).alias("quote"), evidence_id.alias("supplied"))
    rows = rows.unionByName(given).where("answer_id IS NOT NULL")
    lists = rows.groupBy("answer_id").agg(F.collect_set("quote").alias("quotes"), F.collect_set("supplied").alias("supplied"))
    return verdicts.select("answer_id", "assessment", "cited_ids", "contract_quote_ok", "foreign").join(lists, "answer_id", "left")


def parse_verdicts(answers: DataFrame) -> DataFrame:
    """answers(answer_id, text): JSON inside an optional fence -> fields, with ``valid`` false where it is none."""
    schema = (
        "assessment string, explanation string, cited_evidence_ids array<string>, "
        "evidence_quotes array<struct<evidence_id:string,quote:string>>, contract_quote string"
    )
    bare = F.regexp_replace("text", r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    return answers.select("answer_id", F.from_json(bare, schema).alias("v")).select(
        "answer_id", "v.*", F.coalesce(F.col("v.assessment").isNotNull(), F.lit(False)).alias("valid")
    )


def review_payload(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """fields(document_id, field, value, question) and evidence(document_id, field, evidence_id, text) -> one JSON a field."""
    proofs = evidence.groupBy("document_id", "field").agg(
        F.sort_array(F.collect_list(F.struct("evidence_id", "text"))).alias("evidence")
    )
    return fields.join(proofs, ["document_id", "field"], "left").select(
        "document_id", "field", F.to_json(F.struct("question", "value", "evidence")).alias("payload")
    )
