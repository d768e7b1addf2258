"""Clauses: noise out, sentences classified by ordered rules, grouped to clauses, named and numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import has_phrase

NEW_ITEM = r"^\s*(?:\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)]|[•●▪◦‣–*·-])\s*"
LEAST_CHARS = 25


def drop_noise(sentences: DataFrame, patterns: list[str], text: str = "sentence") -> DataFrame:
    """Sentences of three letters or more that no noise pattern fits."""
    noise = "|".join(f"(?:{p})" for p in patterns)
    return sentences.where((F.length(F.trim(text)) >= 3) & ~F.col(text).rlike(noise))


def classify(text: Column, rules: list[dict]) -> Column:
    """Type of the first rule in order {type, pattern, excludes, requires} that fits; null if none does.  ``words`` and ``without``
    in place of patterns are phrases for folded text."""
    out = None
    for r in rules:
        hit = has_phrase(text, r["words"]) if "words" in r else text.rlike(r["pattern"])
        if r.get("without"):
            hit = hit & ~has_phrase(text, r["without"])
        for e in r.get("excludes", ()):
            hit = hit & ~text.rlike(e)
        for q in r.get("requires", ()):
            hit = hit & text.rlike(q)
        out = F.when(hit, r["type"]) if out is None else out.when(hit, r["type"])
    return out


def starts_new_item(text: Column) -> Column:
    return text.rlike(NEW_ITEM)


def segment(sentences: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """sentences(section_id, pos, text, type) -> clauses (section_id, clause_no, type, text).

    A classified sentence opens a clause, and so does an unclassified one that opens an item (as OTHER); others join the clause
    before, or the first one if there is none yet.  Sections without an opening give nothing.  Short clauses go."""
    w = Window.partitionBy("section_id").orderBy("pos")
    opens = F.col("type").isNotNull() | starts_new_item(F.col("text"))
    g = sentences.withColumn("opens", opens).withColumn("group", F.sum(opens.cast("int")).over(w))
    # sentences before the first opening belong to it
    g = g.withColumn("group", F.greatest("group", F.lit(1)))
    rows = g.groupBy("section_id", "group").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min_by(F.when(F.col("opens"), F.coalesce("type", F.lit("OTHER"))), F.when(F.col("opens"), F.col("pos"))).alias("type"),
        F.bool_or("opens").alias("opened"),
    )
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return rows.where(F.col("opened") & (F.length(flat) >= least)).select("section_id", F.col("group").alias("clause_no"), "type", "text")


def heading_fallback(sections: DataFrame, clauses: DataFrame, rules: list[dict]) -> DataFrame:
    """sections(section_id, heading_id, ord, title, text): the first section under a heading that gave no clause takes its heading's type."""
    order = Window.partitionBy(F.coalesce("heading_id", "title")).orderBy("ord")
    first = sections.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    bare = first.join(clauses.select("section_id").distinct(), "section_id", "left_anti")
    return bare.withColumn("type", classify(F.col("title"), rules)).where("type IS NOT NULL").select(
        "section_id", F.lit(1).alias("clause_no"), "type", "text"
    )


def verbatim_span(section: Column, first: Column, last: Column) -> Column:
    """The section's own text from its first sentence to its last."""
    a = F.position(first, section)
    b = F.position(last, section) + F.length(last)
    return F.when((a > 0) & (b > a), F.substring(section, a, b - a))


def name_clauses(clauses: DataFrame, names: DataFrame, rules: list[dict]) -> DataFrame:
    """clauses(type, heading, ...) with names(type, label): the label, with the heading where that has the clause's type and is short."""
    agrees = (classify(F.col("heading"), rules) == F.col("type")) & (F.length("heading") <= 60)
    name = F.when(F.coalesce(agrees, F.lit(False)), F.concat(F.col("label"), F.lit(" ("), F.col("heading"), F.lit(")"))).otherwise(F.col("label"))
    return clauses.join(F.broadcast(names), "type", "left").withColumn("clause_name", name).drop("label")


def number_clauses(clauses: DataFrame, document: str, order: list[str]) -> DataFrame:
    """Ids C01, C02, ... in each document; wider past 99."""
    n = F.row_number().over(Window.partitionBy(document).orderBy(*order)).cast("string")
    return clauses.withColumn("clause_id", F.concat(F.lit("C"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)))


def heading_clauses(sections: DataFrame, rules: list[dict], least: int = LEAST_CHARS) -> DataFrame:
    """Headings that state a rule of their own are clauses."""
    rows = sections.where((F.col("kind") == "heading") & (F.length(F.trim("text")) >= least))
    return rows.withColumn("type", classify(F.col("text"), rules)).where("type IS NOT NULL").select("document_id", "ord", "type", "text")


def bullet_clauses(sections: DataFrame, rules: list[dict], bullets: str = "•●▪◦‣–*·-") -> DataFrame:
    """Runs of bullets directly under a heading with a type make one clause of that type."""
    w = Window.partitionBy("document_id").orderBy("ord")
    mark = F.trim("text").rlike(f"^[{bullets}]")
    runs = sections.withColumn("bullet", mark).withColumn("run", F.sum((~mark).cast("int")).over(w))
    head = Window.partitionBy("document_id", "run").orderBy("ord")
    typed = runs.withColumn("type", F.first(classify(F.when(F.col("kind") == "heading", F.col("text")), rules)).over(head))
    return typed.where("bullet AND type IS NOT NULL").groupBy("document_id", "run", "type").agg(
        F.min("ord").alias("ord"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"),
    ).select("document_id", "ord", "type", "text")


def row_clauses(rows: DataFrame, rules: list[dict], least: int = LEAST_CHARS) -> DataFrame:
    """Table rows, their cells joined by bars, that state a rule."""
    text = F.array_join("cells", " | ")
    typed = rows.withColumn("text", text).withColumn("type", classify(text, rules))
    return typed.where(F.col("type").isNotNull() & (F.length("text") >= least)).select("document_id", "ord", "type", "text")


def merge_sources(sentences: DataFrame, headings: DataFrame, bullets: DataFrame, rows: DataFrame) -> DataFrame:
    """Clauses (document_id, ord, type, text) of the four sources together, each with its ``origin``, in order of their places,
    with ids."""
    named = (("heading", headings), ("sentences", sentences), ("bullets", bullets), ("row", rows))
    out = None
    for place, (name, df) in enumerate(named):
        part = df.select("document_id", "ord", F.lit(place).alias("_place"), F.lit(name).alias("origin"), "type", "text")
        out = part if out is None else out.unionByName(part)
    return number_clauses(out, "document_id", ["ord", "_place", "text"]).drop("_place")
