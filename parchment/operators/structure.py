"""Document structure: sections with their headings, chunks, pairs, running text, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import html_to_text


def page_sections(pages: DataFrame) -> DataFrame:
    """Blocks of HTML pages (headings, paragraphs, list items) in order, with the nearest heading before."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(?:h1|h2|h3|p|li)[^>]*>.*?</(?:h1|h2|h3|p|li)>"), F.lit(0))
    blocks = pages.select(F.col("page_id").alias("document_id"), F.posexplode(found).alias("ord", "raw"))
    return sectionise(
        blocks.select(
            "document_id",
            "ord",
            F.when(F.lower(F.substring("raw", 2, 1)) == "h", "heading").otherwise("paragraph").alias("kind"),
            F.trim(html_to_text(F.col("raw"))).alias("text"),
        )
    )


def sectionise(blocks: DataFrame) -> DataFrame:
    """blocks(document_id, ord, kind, text) -> sections: blank ones left out, numbered ids, heading filled forward."""
    order = Window.partitionBy("document_id").orderBy("ord")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("kind") == "heading"
    kept = blocks.where(F.trim("text") != "")
    return kept.select(
        "*",
        F.format_string("s%04d", F.row_number().over(order)).alias("section_id"),
        F.last(F.when(head, F.col("text")), ignorenulls=True).over(so_far).alias("title"),
        F.last(F.when(head, F.col("ord")), ignorenulls=True).over(so_far).alias("heading_no"),
    )


def full_text(sections: DataFrame, rows: DataFrame) -> DataFrame:
    """sections(document_id, ord, text) and rows(document_id, ord, row_no, cells) -> (document_id, full_text)."""
    both = sections.select("document_id", "ord", F.lit(0).alias("row_no"), "text").unionByName(
        rows.select("document_id", "ord", "row_no", F.array_join("cells", " | ").alias("text"))
    )
    return both.groupBy("document_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("ord", "row_no", "text"))), lambda x: x["text"]), "\n\n"
        ).alias("full_text")
    )


def page_status(chars: Column, has_images: Column, blank: Column, least: int = 20) -> Column:
    return F.when(chars >= least, "text").when(blank & ~has_images, "no_text").otherwise("ocr_required")


def doc_status(pages: DataFrame) -> DataFrame:
    """pages(document_id, status) -> success, partial or ocr_required."""
    some_text, some_ocr = F.bool_or(F.col("status") == "text"), F.bool_or(F.col("status") == "ocr_required")
    return pages.groupBy("document_id").agg(
        F.when(some_ocr & some_text, "partial").when(some_ocr, "ocr_required").otherwise("success").alias("status")
    )


def detect_headings(spans: DataFrame) -> DataFrame:
    """spans(document_id, block, line, text, size, bold) -> (document_id, block, text, is_heading).

    The body size is the one (to half points) with most letters.  A heading has at most 2 lines and 150 letters and is
    15 % larger than the body, or all bold with at most 80 letters."""
    rounded = spans.withColumn("half", F.round(F.col("size") * 2) / 2)
    body = (
        rounded.groupBy("document_id", "half").agg(F.sum(F.length("text")).alias("n"))
        .groupBy("document_id").agg(F.max_by("half", F.struct("n", -F.col("half"))).alias("body"))
    )
    blocks = rounded.groupBy("document_id", "block").agg(
        F.countDistinct("line").alias("lines"),
        F.max("size").alias("size"),
        F.bool_and("bold").alias("bold"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    n = F.length("text")
    return blocks.join(body, "document_id").select(
        "document_id",
        "block",
        "text",
        (
            (F.col("lines") <= 2) & (n <= 150) & ((F.col("size") >= 1.15 * F.col("body")) | (F.col("bold") & (n <= 80)))
        ).alias("is_heading"),
    )


def pack_chunks(paragraphs: Column, budget: int, legacy_order: bool = False) -> Column:
    """Array of paragraphs -> array of chunks of at most ``budget`` white-space tokens, blank line between paragraphs.

    A longer paragraph is cut into chunks of its own.  They come in their place; with ``legacy_order`` the
    open chunk stays open across them, so they come before earlier text."""
    def size(p: Column) -> Column:
        return F.size(F.regexp_extract_all(p, F.lit(r"\S+"), F.lit(0)))

    paras = F.filter(F.transform(paragraphs, lambda p: F.trim(p)), lambda p: p.rlike(r"\S"))

    def cut(p: Column) -> Column:
        ts = F.regexp_extract_all(p, F.lit(r"\S+"), F.lit(0))
        n = F.ceil(F.size(ts) / F.lit(budget)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(ts, i * budget + 1, F.lit(budget)), " "))

    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("open"), F.lit(0).alias("used"))

    def step(acc: Column, p: Column) -> Column:
        n = size(p)
        closed = F.when(acc["used"] > 0, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
        long = n > budget
        full = acc["used"] + n > budget
        if legacy_order:
            alone = F.struct(F.concat(acc["done"], cut(p)).alias("done"), acc["open"].alias("open"), acc["used"].alias("used"))
        else:
            alone = F.struct(F.concat(closed, cut(p)).alias("done"), F.lit("").alias("open"), F.lit(0).alias("used"))
        fresh = F.struct(closed.alias("done"), p.alias("open"), n.alias("used"))
        more = F.struct(
            acc["done"].alias("done"),
            F.when(acc["used"] > 0, F.concat_ws("\n\n", acc["open"], p)).otherwise(p).alias("open"),
            (acc["used"] + n).alias("used"),
        )
        return F.when(long, alone).when(full, fresh).otherwise(more)

    return F.aggregate(
        paras, start, step, lambda a: F.when(a["used"] > 0, F.array_append(a["done"], a["open"])).otherwise(a["done"])
    )


def flat_json_line(col: Column) -> Column:
    """``key: value`` pairs of a flat JSON object, comma between; anything else unchanged."""
    m = F.from_json(col, "map<string,string>")
    pairs = F.transform(F.map_entries(m), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return F.when(m.isNull(), col).otherwise(F.array_join(pairs, ", "))


def duplicate_docs(df: DataFrame, group: str, digest: str, position: str) -> DataFrame:
    """Rows whose content an earlier row of the group holds, with that first holder."""
    first = F.first_value(position).over(Window.partitionBy(group, digest).orderBy(position))
    return df.withColumn("first_holder", first).where(F.col(position) != F.col("first_holder"))


def dedupe_running_text(blocks: DataFrame) -> DataFrame:
    """Header and footer texts once per document and kind; those linked to an earlier section are left out."""
    order = Window.partitionBy("document_id", "kind", "text").orderBy("ord")
    return blocks.where(~F.col("linked")).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def drop_boxed(blocks: DataFrame, boxes: DataFrame, share: float = 0.8) -> DataFrame:
    """Blocks of which ``share`` of the area or more lies in no box of the page, in reading order of top and left."""
    b = boxes.select("document_id", "page", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    width = F.greatest(F.least("x1", "b_x1") - F.greatest("x0", "b_x0"), F.lit(0.0))
    height = F.greatest(F.least("y1", "b_y1") - F.greatest("y0", "b_y0"), F.lit(0.0))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    a = blocks.alias("a")
    keys = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.page") == F.col("b.page"))
    out = a.join(b.alias("b"), keys & (width * height >= share * area), "left_anti")
    return out.orderBy("document_id", "page", F.round("y0", 1), "x0")


def bullet_items(lines: DataFrame, bullets: str = "•●▪◦‣–*·-") -> DataFrame:
    """lines(document_id, block, line, text) -> items: a bullet opens one, following lines join it; those before the
    first bullet make a paragraph (item 0)."""
    mark = F.trim("text").rlike(f"^[{bullets}]\\s*")
    order = Window.partitionBy("document_id", "block").orderBy("line")
    numbered = lines.withColumn("item", F.sum(mark.cast("int")).over(order))
    return numbered.groupBy("document_id", "block", "item").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text")
    )


def table_pairs(rows: DataFrame, max_label: int = 60) -> DataFrame:
    """rows(document_id, table_id, row_no, cells) -> label and value of cells (0, 1), (2, 3), ..."""
    at = F.expr("sequence(0, size(cells) - 2, 2)")
    pairs = rows.where(F.size("cells") >= 2).select(
        "document_id", "table_id", "row_no",
        F.explode(F.transform(at, lambda i: F.struct(F.trim(F.get("cells", i)).alias("label"), F.trim(F.get("cells", i + 1)).alias("value")))).alias("p"),
    )
    good = (F.col("p.label") != "") & (F.col("p.value") != "") & (F.length("p.label") <= max_label)
    return pairs.where(good).select("document_id", "table_id", "row_no", "p.label", "p.value")


def labeled_values(lines: DataFrame, max_label: int = 60) -> DataFrame:
    """lines(document_id, line_no, text[, next]) -> label and value of parts with a colon or tab; an empty value takes the next line,
    ``next`` where the lines have it."""
    if "next" not in lines.columns:
        lines = lines.withColumn("next", F.lead("text").over(Window.partitionBy("document_id").orderBy("line_no")))
    mark = "[:：\t]"
    parts = lines.where(F.col("text").rlike(mark)).select("document_id", "line_no", "next", F.posexplode(F.split("text", r"\s+[|•·]\s+")).alias("part_no", "part"))
    # cut once, at the first mark and the blanks around it
    read = parts.select("document_id", "line_no", "part_no", "next", F.split("part", rf"\s*{mark}\s*", 2).alias("_cut")).where(F.size("_cut") == 2).select(
        "document_id", "line_no", "part_no", F.trim(F.col("_cut")[0]).alias("label"), F.trim(F.col("_cut")[1]).alias("here"),
        F.when(~F.col("next").rlike(mark), F.trim("next")).alias("after"),
    )
    value = F.coalesce(F.nullif(F.col("here"), F.lit("")), F.col("after"))
    method = F.when(F.col("here") != "", "labeled_line").otherwise("labeled_next_line")
    good = (F.col("label") != "") & (F.length("label") <= max_label)
    return read.where(good).select("document_id", "line_no", "part_no", "label", value.alias("value"), method.alias("method")).where("value IS NOT NULL")


def split_statute(docs: DataFrame) -> DataFrame:
    """docs(document_id, text) of headed law text -> a row per article with its part and chapter and a running number."""
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    w = Window.partitionBy("document_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)

    def last(pattern: str) -> Column:
        return F.last(F.when(F.col("line").rlike(pattern), F.trim("line")), ignorenulls=True).over(w)

    head = r"^\s*(?:الباب|الفصل|Part|Chapter)\b"
    article = r"^\s*(?:المادة|Article)\s"
    placed = lines.select(
        "document_id", "no", "line",
        F.coalesce(last(r"^\s*(?:الباب|Part)\b"), F.lit("main")).alias("part"),
        F.coalesce(last(r"^\s*(?:الفصل|Chapter)\b"), F.lit("main")).alias("chapter"),
        F.sum(F.col("line").rlike(article).cast("int")).over(w).alias("index"),
    )
    kept = placed.where((F.col("index") > 0) & ~F.col("line").rlike(head))
    return kept.groupBy("document_id", "index").agg(
        F.min_by("part", "no").alias("part"),
        F.min_by("chapter", "no").alias("chapter"),
        F.trim(F.min_by("line", "no")).alias("name"),
        F.trim(
            F.array_join(
                F.transform(F.slice(F.sort_array(F.collect_list(F.struct("no", "line"))), 2, 1 << 30), lambda x: x["line"]), "\n"
            )
        ).alias("content"),
    )
