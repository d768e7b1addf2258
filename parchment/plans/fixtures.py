"""Short documents repeated for every customer, as Spark rows and as SQL, so that readings known beforehand can be checked at any size.

``{k}`` in a text stands for the customer's key, which makes the documents differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.sources.tables import read_table


TASKS_A_CORE = 4


def _fields(ddl: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ", 1)) for part in ddl.split(",")]


def _value(v: object, kind: str) -> Column:
    if isinstance(v, (list, tuple)):
        return F.array(*[F.lit(x) for x in v]).cast(kind)
    return F.lit(v).cast(kind)


def per_customer(spark: SparkSession, sf: str, ddl: str, rows: list[tuple]) -> DataFrame:
    """(document_id, fields of ddl): the rows once for each customer."""
    fields = _fields(ddl)
    entries = F.array(*[F.struct(*[_value(v, kind).alias(c) for v, (c, kind) in zip(row, fields)]) for row in rows])
    # the keys are a small file that one task would read, and all documents with it
    keys = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"))
    out = keys.repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, "document_id").select("document_id", F.inline(entries))
    key = F.col("document_id").cast("string")
    for c, kind in fields:
        if kind == "string":
            out = out.withColumn(c, F.replace(F.col(c), F.lit("{k}"), key))
        elif kind == "array<string>":
            out = out.withColumn(c, F.transform(c, lambda x: F.replace(x, F.lit("{k}"), key)))
    return out


def _quoted(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_quoted, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]"}


def rows_sql(ddl: str, rows: list[tuple]) -> str:
    """The same rows as a SELECT of SQL."""
    fields = _fields(ddl)

    def shown(c: str, kind: str) -> str:
        typed = f'CAST("{c}" AS {_SQL_TYPES[kind]})'
        return f"""replace({typed}, '{{k}}', CAST(c_custkey AS VARCHAR)) AS "{c}\"""" if kind == "string" else f'{typed} AS "{c}"'

    values = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)
    return f"SELECT c_custkey AS document_id, {', '.join(shown(c, k) for c, k in fields)} FROM customer, (VALUES {values}) v({', '.join(f'"{c}"' for c, _ in fields)})"


def registry() -> tuple[dict, dict, Callable]:
    """Queries and SQL by name, and the decorator that enters a query with its SQL."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql: dict[str, str] = {}

    def query(name: str, text: str):
        def add(f):
            queries[name], sql[name] = f, text
            return f

        return add

    return queries, sql, query


#: Columns of line items that the texts are made of.
_ITEM = (
    "l_orderkey AS document_id", "l_linenumber * 100000 + l_partkey AS unit_no", "l_linenumber AS n", "CAST(l_quantity AS INT) AS q",
    "CAST(l_suppkey AS INT) AS s", "l_returnflag AS flag", "l_linestatus AS line", "l_extendedprice AS price", "l_discount AS discount",
)


def items(spark: SparkSession, sf: str, **made: str) -> DataFrame:
    """Line items with further columns; the expressions are those of the SQL."""
    return read_table(spark, sf, "lineitem").selectExpr(*_ITEM).selectExpr("*", *[f"{e} AS {c}" for c, e in made.items()])


def items_sql(**made: str) -> str:
    """The same as SQL, named u."""
    more = "".join(f", {e} AS {c}" for c, e in made.items())
    return f"u AS (SELECT *{more} FROM (SELECT {', '.join(_ITEM)} FROM lineitem))"


def choose(column: Column, *texts: str | None) -> Column:
    """The text whose place, from 0, the column has."""
    out = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        out = F.when(column == i, t).otherwise(out)
    return out
