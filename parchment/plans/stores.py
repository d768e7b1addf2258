"""Queries of readers, sinks, catalogues and streams: rows of given tables are written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.operators import compare as P
from parchment.plans.business import _OFFERS, _offers
from parchment.plans.checks import CONTRACT_FIELDS, contracts
from parchment.plans.fixtures import TASKS_A_CORE, items, items_sql, registry, rows_sql
from parchment.plans.text import SENTENCES
from parchment.sources import tables as S
from parchment.sources.shared import scratch
from parchment.sources.tables import read_table
from parchment.streaming import jobs

QUERIES, SQL, query = registry()


def one_file_each(texts: DataFrame, name: str, ending: str = "txt") -> str:
    """texts(value) -> a folder with a file for each row.

    The rows may come from one small file, so they are dealt out to the tasks first; each task puts its own files in place, as the
    driver would take them one by one."""
    spark = texts.sparkSession
    path = scratch(spark, name)
    dealt = texts.select("value").repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    dealt.write.option("maxRecordsPerFile", 1).option("fileExtension", ending).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    return path


@query("src01_articles", 'SELECT CAST(p_partkey AS INT) AS "index", p_size AS article_number, p_name AS english_content FROM part')
def _(spark, sf):
    entry = F.struct(F.col("p_partkey").alias("index"), F.col("p_size").alias("article_number"), F.col("p_name").alias("english_content"))
    # parts of a hundred neighbours make a file
    files = read_table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 100)).agg(F.to_json(F.collect_list(entry)).alias("value"))
    rows, status = S.load_articles(spark, one_file_each(files, "articles"))
    assert status == "ok"
    return rows.select("index", "article_number", "english_content")


@query(
    "src02_questions",
    """SELECT CAST(c_custkey AS INT) AS "index", CAST(1 + row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS INT) AS source_row, c_name || ', ' || c_mktsegment AS question FROM customer""",
)
def _(spark, sf):
    line = F.concat(F.lit('"'), "c_name", F.lit(", "), "c_mktsegment", F.lit('",'), F.col("c_nationkey").cast("string"), F.lit(",x,"), F.col("c_custkey").cast("string"))
    grouped = read_table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 100)).agg(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("rows"))
    value = F.concat_ws("\n", F.lit("question,article_number,article_orig,index"), F.transform("rows", lambda r: r["line"]))
    return S.load_questions(spark, one_file_each(grouped.select(value.alias("value")), "questions")).select("index", "source_row", "question")


@query(
    "src03_golden_cases",
    """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'unknown keys' WHEN 2 THEN 'not a JSON object of the schema' ELSE 'no case_id' END AS verdict, count(*) AS n FROM orders GROUP BY ALL""",
)
def _(spark, sf):
    key = F.col("o_orderkey").cast("string")
    line = (
        F.when(key % 4 == 0, F.concat(F.lit('{"case_id": "'), key, F.lit('", "task": "t", "tags": ["x"]}')))
        .when(key % 4 == 1, F.concat(F.lit('{"case_id": "'), key, F.lit('", "task": "t", "other": 1}')))
        .when(key % 4 == 2, F.concat(F.lit("no JSON "), key)).otherwise(F.lit('{"task": "t"}'))
    )
    path = scratch(spark, "cases")
    read_table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    good, bad = S.load_cases(spark, path)
    return good.select(F.lit("good").alias("verdict")).unionByName(bad.select(F.col("problem").alias("verdict"))).groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    "src04_catalogue",
    """SELECT sha256(v) AS sha256, 'doc_' || substr(sha256(v), 1, 16) AS document_id, CAST(length(v) AS BIGINT) AS bytes, CASE WHEN length(v) > 16 THEN 'too_large' ELSE 'ok' END AS verdict
    FROM (SELECT repeat(s_name, CAST(s_suppkey % 2 + 1 AS INT))[9:] || chr(10) AS v FROM supplier)""",
)
def _(spark, sf):
    value = F.expr("substring(repeat(s_name, CAST(s_suppkey % 2 + 1 AS INT)), 9)")
    files = one_file_each(read_table(spark, sf, "supplier").select(value.alias("value")), "files")
    return S.catalogue_files(spark, f"{files}/*.txt", max_bytes=16).select("sha256", "document_id", "bytes", "verdict")


@query("src07_sinks", """SELECT c_custkey, c_name, c_acctbal FROM customer""")
def _(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    lines, csv = scratch(spark, "lines"), scratch(spark, "csv")
    S.write_json_lines(c.select("c_custkey", "c_name"), lines, ["c_custkey"])
    S.write_csv(c.select("c_custkey", "c_acctbal"), csv, ["c_custkey"])
    back = spark.read.schema("c_custkey long, c_acctbal double").option("header", True).csv(csv)
    return spark.read.schema("c_custkey long, c_name string").json(lines).join(back, "c_custkey")


@query(
    "src08_drift",
    """SELECT c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'unrecorded' ELSE 'changed' END AS problem FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0 UNION ALL SELECT s_name, 'missing' FROM supplier""",
)
def _(spark, sf):
    c = read_table(spark, sf, "customer")
    manifest = c.where("c_custkey % 7 <> 0").select(F.col("c_name").alias("name"), F.sha2(F.concat("c_name", F.when(F.col("c_custkey") % 5 == 0, "x").otherwise("")), 256).alias("sha256"))
    gone = read_table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("0").alias("sha256"))
    return S.source_drift(c.select(F.col("c_name").alias("name"), F.sha2("c_name", 256).alias("sha256")), manifest.unionByName(gone))


@query(
    "cmp08_explanations",
    f"""WITH {_OFFERS}, l AS (SELECT group_id, dimension, string_agg(c, ', ' ORDER BY c) AS names, any_value(all_equal) AS equal FROM (SELECT *, CAST(contract_id AS VARCHAR) AS c FROM lead) GROUP BY ALL),
    f AS (SELECT group_id, dimension, any_value(ranking) AS ranking, string_agg(m, '; ' ORDER BY m) AS missing, string_agg(DISTINCT u, ', ' ORDER BY u) AS units
      FROM (SELECT *, CASE WHEN status <> 'available' THEN contract_id || ': ' || status END AS m, coalesce(unit, 'none') AS u FROM offers) GROUP BY ALL)
    SELECT group_id, dimension, CASE WHEN ranking = 'not_ranked' THEN 'Shown for information; not ranked.' WHEN equal THEN 'All offers are equal.' WHEN names IS NOT NULL THEN 'Led by ' || names || '.'
      ELSE 'Not ranked because ' || coalesce(missing, 'different units (' || units || ')') || '.' END AS explanation FROM f LEFT JOIN l USING (group_id, dimension)""",
)
def _(spark, sf):
    return P.explain_dimension(_offers(spark, sf))


@query("fn06_threshold_numbers", f"WITH {items_sql()} SELECT document_id, unit_no, CAST(100 + q AS DOUBLE) AS value FROM u")
def _(spark, sf):
    from parchment.operators import rules as L

    u = items(spark, sf, text="'It shall be at most hundred and ' || q || ' days.'").withColumn("article_id", F.struct("document_id", "unit_no", "s", "price"))
    found = L.thresholds(u.select("article_id", "text"), spark.createDataFrame([("hundred", 100.0)], "token string, value double"), allow_digits=True)
    return found.select("article_id.document_id", "article_id.unit_no", "value")


def _streamed(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream; as a pattern the path may also be a single file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


@query("str01_streamed_sentences", f"WITH {SENTENCES} SELECT doc_id, count(*) AS n FROM sentences GROUP BY doc_id")
def _(spark, sf):
    out = scratch(spark, "sentences")
    stream = jobs.stream_sentences(_streamed(spark, f"{sf}/documents.parquet"))
    jobs.run_available(stream, scratch(spark, "progress"), lambda df, _: df.write.mode("append").parquet(out))
    return spark.read.parquet(out).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("str04_streamed_registry", "SELECT l_suppkey AS doc_id, min(l_quantity) AS best_rank, max(l_discount) AS best_score FROM lineitem GROUP BY l_suppkey")
def _(spark, sf):
    out = scratch(spark, "registry")
    hits = _streamed(spark, f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("doc_id"), F.col("l_quantity").alias("rank"), F.col("l_discount").alias("score"))
    jobs.run_available(jobs.stream_registry(hits), scratch(spark, "progress"), lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out), "update")
    # a document's last update holds
    last = F.max_by(F.struct("best_rank", "best_score"), "batch").alias("r")
    return spark.read.parquet(out).groupBy("doc_id").agg(last).select("doc_id", "r.best_rank", "r.best_score")


@query("str01_contract_intake", rows_sql("field string, path string, status string, key string", CONTRACT_FIELDS))
def _(spark, sf):
    arrived, out = scratch(spark, "contracts"), scratch(spark, "fields")
    contracts(spark, sf).write.parquet(arrived)
    stream = spark.readStream.schema("document_id long, text string").option("maxFilesPerTrigger", 1000).parquet(arrived)
    jobs.run_intake(stream, scratch(spark, "progress"), lambda df, _: df.write.mode("append").parquet(out))
    return spark.read.parquet(out)
