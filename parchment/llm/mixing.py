"""Mixing of sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are counted into cells of (source, language, topic) by tokens.  Raking scales the cells until
their token weights meet the target share of every source, every language and every topic.  A document's
expected number of copies is its cell's factor times the wanted share of all tokens; it is taken as many
times as the whole part says, and once more with the fractional part's probability, decided by a
hash of its id, so the sample is the same in every run.

The topic is a column of the caller or, by default, the form of the text (``form_topic``).  Targets are
shares by value; by default those of tempered counts: shares in proportion to tokens ** power.

Null source, language or topic is a value of its own, ``<none>``.  Null or empty text counts no tokens; such
documents follow their cell's factors.  Repeated rows have the same id and so the same copies.  An empty table
gives an empty result.  Extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import stored

DIMENSIONS = ("source", "lang", "topic")
#: Powers that the default targets temper token counts by.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 8
#: Expected tokens of the sample, as a share of all.
KEEP = 1.0
NONE = "<none>"


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """What form a text has: empty, note, table, licence, essay or book."""
    return (
        F.when(tokens == 0, "empty")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(F.lower(text), F.lit("license")), "licence")
        .when(tokens < 100, "note")
        .when(tokens < 1500, "essay")
        .otherwise("book")
    )


def uniform(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) from the id."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":" + seed))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def cells(counted: DataFrame) -> DataFrame:
    """Tokens of each (source, lang, topic)."""
    return counted.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def tempered(table: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, share): shares in proportion to tokens ** power."""
    by = table.groupBy(dim).agg(F.sum("tokens").alias("t")).select(dim, F.pow("t", F.lit(power)).alias("t"))
    total = by.agg(F.sum("t").alias("all"))
    return by.crossJoin(F.broadcast(total)).select(dim, (F.col("t") / F.nullif(F.col("all"), F.lit(0.0))).alias("share"))


def rake(table: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``factor``: tokens * factor meets every target's shares of all tokens."""
    total = table.agg(F.sum("tokens").alias("all_tokens"))  # one row
    now = table.crossJoin(F.broadcast(total)).withColumn("factor", F.lit(1.0))
    shares = {d: f"share_{d}" for d in targets}
    for dim, goal in targets.items():  # each cell keeps its targets, so a round joins sums alone
        now = now.join(goal.select(dim, F.col("share").alias(shares[dim])), dim, "left")
    kept = [*DIMENSIONS, "tokens", "all_tokens", *[F.coalesce(s, F.lit(0.0)).alias(s) for s in shares.values()]]
    now = stored(now.select(*kept, "factor"), "cells")
    for _ in range(rounds):
        for dim, share in shares.items():
            sums = now.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("factor")).alias("have"))
            scaled = F.col("factor") * F.col(share) * F.col("all_tokens") / F.nullif(F.col("have"), F.lit(0.0))
            now = now.join(sums, dim).select(*DIMENSIONS, "tokens", "all_tokens", *shares.values(), F.coalesce(scaled, F.col("factor")).alias("factor"))
        now = stored(now, "cells")
    return now


def counted_documents(docs: DataFrame, topic: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, _0, _1 ...: the columns of ``carry``)."""
    kept = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    n = docs.select("doc_id", "source", "lang", "text", token_count(F.col("text")).alias("n_tokens"), *kept)
    return n.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        F.coalesce(form_topic(F.col("text"), F.col("n_tokens")) if topic is None else topic, F.lit(NONE)).alias("topic"),
        "n_tokens",
        *[f"_{i}" for i in range(len(carry))],
    )


def sample(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    keep: float = KEEP,
    rounds: int = ROUNDS,
    seed: str = "mix",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, expected, copies) of the documents that are taken at least once; with
    ``carry`` those columns as they are, and copies."""
    counted = stored(counted_documents(docs, carry=carry), "counted")
    table = stored(cells(counted), "cells")
    goals = targets or {d: tempered(table, d, POWERS[d]) for d in DIMENSIONS}
    factors = rake(table, goals, rounds).select(*DIMENSIONS, "factor")
    drawn = counted.join(factors, list(DIMENSIONS)).withColumn("expected", F.col("factor") * F.lit(keep))
    whole = F.floor("expected")
    more = uniform(F.col("doc_id"), seed) < F.col("expected") - whole
    taken = drawn.withColumn("copies", (whole + more.cast("int")).cast("long")).where("copies > 0")
    if carry:
        return taken.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)], "copies")
    return (
        taken.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("expected", 6).alias("expected"), "copies")
    )


def sample_sql(rounds: int = ROUNDS, keep: float = KEEP, seed: str = "mix", documents: str = "documents") -> str:
    """The same in SQL, with the rounds written out."""
    steps = [
        f"""counted AS MATERIALIZED (SELECT doc_id, source, lang, CASE
        WHEN n_tokens = 0 THEN 'empty' WHEN contains(text, ' | ') THEN 'table'
        WHEN contains(lower(text), 'license') THEN 'licence' WHEN n_tokens < 100 THEN 'note'
        WHEN n_tokens < 1500 THEN 'essay' ELSE 'book' END AS topic, n_tokens
        FROM (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, text,
          CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens FROM {documents}))""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, 1.0::DOUBLE AS factor"
        " FROM counted GROUP BY ALL)",
        "total AS MATERIALIZED (SELECT sum(tokens) AS all_tokens FROM c0)",
    ]
    for d in DIMENSIONS:
        steps.append(
            f"g_{d} AS MATERIALIZED (SELECT {d}, t / sum(t) OVER () AS share FROM"
            f" (SELECT {d}, pow(sum(tokens), {POWERS[d]}) AS t FROM c0 GROUP BY {d}))"
        )
    k = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            steps.append(
                f"c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, coalesce(c.factor * g.share * all_tokens"
                f" / nullif(h.have, 0), c.factor) AS factor FROM c{k} c JOIN g_{d} g USING ({d}) JOIN"
                f" (SELECT {d}, sum(tokens * factor) AS have FROM c{k} GROUP BY {d}) h USING ({d}), total)"
            )
            k += 1
    return (
        "WITH "
        + ",\n".join(steps)
        + f""",
        drawn AS (SELECT doc_id, source, lang, topic, n_tokens, factor * {keep} AS expected,
          CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), 1, 12) AS BIGINT) / {float(1 << 48)} AS u
          FROM counted JOIN c{k} USING (source, lang, topic))
        SELECT doc_id, source, lang, topic, n_tokens, round(expected, 6) AS expected,
          CAST(floor(expected) AS BIGINT) + CASE WHEN u < expected - floor(expected) THEN 1 ELSE 0 END AS copies
        FROM drawn WHERE CAST(floor(expected) AS BIGINT) + CASE WHEN u < expected - floor(expected) THEN 1 ELSE 0 END > 0"""
    )
