"""Helpers shared by the operators: shared scratch tables, null-safe input columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that one Arrow batch may hold; keeps a Python worker's batch small
#: even where texts are long.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (tests, one machine) is an own folder set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = known.rsplit("/", 1)[0] if known else "file:///tmp/checkpoints/parchment"
        if not known:
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage is cut
    and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for text columns (a session setting that only lowers)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def texts(docs: DataFrame, *extra: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body, extra...): the text as UTF-8 bytes, null as empty; all other columns,
    clashing names among them, are left behind."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"), *extra)


def row_key(columns: tuple[str, ...]) -> F.Column:
    """A hash of a whole row, nulls and their places among it: a name for rows whose ids are null or not unique."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def fold(col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: 0)."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % modulus, F.lit(0).cast("long"))
