"""Readers and writers: articles, labelled questions, golden cases, file catalogues, vectors, results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions.text import domain_of

ARTICLE_SCHEMA = (
    "index int, article_number int, number_ar string, arabic_name string, english_number string, part_number int, "
    "part_number_ar string, part_title_ar string, chapter_number int, chapter_number_ar string, "
    "chapter_title_ar string, arabic_content string, english_content string"
)
CASE_SCHEMA = (
    "case_id string, task string, title string, language string, input string, expected string, "
    "gold struct<article_indices:array<int>,article_numbers:array<string>>, provenance string, review string, "
    "duplicate_group string, tags array<string>, notes string"
)
CASE_FIELDS = tuple(part.split()[0] for part in CASE_SCHEMA.replace("struct<article_indices:array<int>,article_numbers:", "").split(", "))
#: Upload limits.
MAX_FILE_BYTES = 20 * 1024 * 1024
EXTENSIONS = ("pdf", "docx", "txt")
PAGE_CHARS = 200_000
#: Scheme and authority of a path.
_STORE = "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_articles(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Articles of a JSON array of objects and a status: ok, or invalid where the file holds anything else."""
    whole = spark.read.text(path, wholetext=True)
    ok = whole.where(~F.col("value").rlike(r"^\s*\[[\s\S]*\]\s*$")).isEmpty()
    rows = spark.read.schema(ARTICLE_SCHEMA).option("multiLine", True).json(path)
    return (rows, "ok") if ok else (rows.limit(0), "invalid")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions with the number of their row in the file, the header being 1.

    The file is one row of text, so rows can be numbered in file order."""
    schema = "question string, article_number string, article_orig string, index int"
    rows = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"))
    )
    read = rows.where("pos > 0").select((F.col("pos") + 1).alias("source_row"), F.from_csv("col", schema).alias("r"))
    return read.select("source_row", "r.*")


def load_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) cases of JSON lines: unknown keys, broken JSON and missing ids are rejected with file and line."""
    rows = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n"))
    )
    parsed = rows.where(F.trim("col") != "").select(
        "file",
        (F.col("pos") + 1).alias("line"),
        F.col("col").alias("raw"),
        F.from_json("col", CASE_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("c"),
        F.expr("json_object_keys(col)").alias("keys"),
    )
    known = F.array(*[F.lit(f) for f in CASE_FIELDS])
    problem = (
        F.when(F.col("keys").isNull() | F.col("c._bad").isNotNull(), "not a JSON object of the schema")
        .when(F.size(F.array_except("keys", known)) > 0, "unknown keys")
        .when(F.col("c.case_id").isNull() | (F.trim("c.case_id") == ""), "no case_id")
        .when(F.col("c.task").isNull(), "no task")
    )
    marked = parsed.withColumn("problem", problem)
    good = marked.where("problem IS NULL").select("file", "line", "c.*").drop("_bad")
    return good, marked.where("problem IS NOT NULL").select("file", "line", "problem", "raw")


def _files(spark: SparkSession, glob: str) -> DataFrame:
    """The files of a pattern.  Where the last part alone is one, its folder is listed once: as a path, a pattern is as many input
    paths as it has matches, each of which Spark looks up by itself."""
    folder, _, name = glob.rpartition("/")
    reader, own = spark.read.format("binaryFile"), re.sub("/+", "/", re.sub(_STORE, "", folder)).rstrip("/")
    if not own.startswith("/") or any(c in folder for c in "*?[{\\") or not any(c in name for c in "*?[{"):
        return reader.load(glob)
    # the folders below are listed too, which the pattern does not reach
    found = reader.options(pathGlobFilter=name, recursiveFileLookup=True).load(folder)
    return found.where(F.regexp_replace("path", f"{_STORE}|/[^/]*$", "") == own)


def catalogue_files(spark: SparkSession, glob: str, max_bytes: int = MAX_FILE_BYTES, extensions: tuple[str, ...] = EXTENSIONS, listing: DataFrame | None = None) -> DataFrame:
    """Files with digest, id, size and a verdict: too large, unsupported, empty, content mismatch, or ok, in this order.

    Spark's reader passes over files without a byte; those that a ``listing`` (path) names are added as empty."""
    f = _files(spark, glob).select("path", "length", "content")
    if listing is not None:
        rest = listing.select("path").join(f.select("path"), "path", "left_anti")
        f = f.unionByName(rest.select("path", F.lit(0).cast("long").alias("length"), F.lit("").cast("binary").alias("content")))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring("content", 1, 1024))
    matches = (
        F.when(ext == "pdf", F.contains(head, F.hex(F.lit("%PDF-"))))
        .when(ext == "docx", head.startswith("504B0304"))
        .otherwise(True)
    )
    verdict = (
        F.when(F.col("length") > max_bytes, "too_large")
        .when(~ext.isin(*extensions), "unsupported_type")
        .when(F.col("length") == 0, "empty")
        .when(~matches, "content_mismatch")
        .otherwise("ok")
    )
    digest = F.sha2("content", 256)
    return f.select(
        "path", digest.alias("sha256"), F.concat(F.lit("doc_"), F.substring(digest, 1, 16)).alias("document_id"),
        F.col("length").alias("bytes"), ext.alias("extension"), verdict.alias("verdict"),
    )


def page_source(pages: DataFrame, title: Column, snippet: Column, content: Column) -> DataFrame:
    """(page_id, url, title, snippet, content, domain): content is cut to PAGE_CHARS and falls back to the snippet."""
    return pages.select(
        "page_id",
        "url",
        title.alias("title"),
        snippet.alias("snippet"),
        F.substring(F.coalesce(F.nullif(content, F.lit("")), snippet), 1, PAGE_CHARS).alias("content"),
        domain_of(F.col("url")).alias("domain"),
    )


def load_vectors(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Rows whose vector has the right length and no null."""
    return df.where((F.size(column) == dim) & ~F.exists(column, lambda x: x.isNull()))


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    df.sortWithinPartitions(*order).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def source_drift(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files(name, sha256) against manifest(name, sha256): unrecorded, changed and missing files."""
    both = files.select("name", F.col("sha256").alias("now")).join(
        manifest.select("name", F.col("sha256").alias("then")), "name", "full"
    )
    problem = F.when(F.col("then").isNull(), "unrecorded").when(F.col("now").isNull(), "missing").when(
        F.col("now") != F.col("then"), "changed"
    )
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("name", "problem")
