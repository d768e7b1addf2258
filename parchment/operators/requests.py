"""Roll-ups over request logs: routes, statuses, reuse within a time to live, first-seen filters, constraint audits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.sources.shared import stored

SEVERITY = ("error", "failed", "partial", "insufficient", "success")
MAX_CONTRACTS = 5


def route(task: Column, question: Column, contracts: Column, cvs: Column, unusable: Column, most: int = MAX_CONTRACTS) -> Column:
    """Decision table from a task hint and what is usable to one route, or the reason for none."""
    few, none = contracts == 1, contracts == 0
    fallback = F.lit("contract_analysis_fallback")
    return (
        F.when(contracts > most, "too_many_contracts")
        .when(task == "regulatory_question", F.when(question, "regulatory_question").otherwise("question_missing"))
        .when(task == "salary_benchmark", F.when(none, "no_contract").otherwise("salary_benchmark"))
        .when(task == "cv_analysis", F.when(cvs > 0, "cv_analysis").otherwise("not_possible"))
        .when(task == "contract_analysis", F.when(none, "no_contract").when(few, "contract_analysis").otherwise("not_possible"))
        .when(
            task == "contract_comparison",
            F.when(contracts >= 2, "contract_comparison").when(few & (unusable > 0), fallback).otherwise("not_possible"),
        )
        .when(contracts >= 2, "contract_comparison")
        .when(few, F.when(unusable > 0, fallback).otherwise("contract_analysis"))
        .when(cvs > 0, "cv_analysis")
        .when(question, "regulatory_question")
        .otherwise("nothing_to_do")
    )


def route_requests(log: DataFrame) -> DataFrame:
    """log(request_id, task, has_question, role, usable) -> (request_id, route)."""
    ok = F.coalesce("usable", F.lit(False))
    by = log.groupBy("request_id").agg(
        F.max("task").alias("task"),
        F.coalesce(F.bool_or("has_question"), F.lit(False)).alias("question"),
        F.count_if(ok & (F.col("role") == "contract")).alias("contracts"),
        F.count_if(ok & (F.col("role") == "cv")).alias("cvs"),
        F.count_if(~ok & F.col("role").isNotNull()).alias("unusable"),
    )
    c = {n: F.col(n) for n in ("task", "question", "contracts", "cvs", "unusable")}
    return by.select("request_id", route(**c).alias("route"))


def combine_status(rows: DataFrame, key: str) -> DataFrame:
    """(key, status): one status stays, any usable one makes it partial, else the most severe."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("status"))
    return rows.groupBy(key).agg(
        F.when(F.countDistinct("status") == 1, F.min("status"))
        .when(F.bool_or(F.col("status").isin("success", "partial")), "partial")
        .otherwise(F.min_by("status", place))
        .alias("status")
    )


def finish_status(status: Column, any_unusable: Column) -> Column:
    return F.when(any_unusable & (status == "success"), "partial").otherwise(status)


def unreadable_report(docs: DataFrame, messages: DataFrame) -> DataFrame:
    """docs(document_id, status) with messages(status, message) -> counts of the documents that could not be read."""
    return docs.join(messages, "status").groupBy("status", "message").agg(F.count("*").alias("n"))


def distinct_in_order(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """(key, items): distinct values in order of first appearance."""
    first = rows.groupBy(key, value).agg(F.min(position).alias("_p"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", value))), lambda x: x[value]).alias("items"))


def ttl_reuse(events: DataFrame, key: str, seconds: str, ttl: int) -> DataFrame:
    """events(event_id, key, seconds) -> (event_id, reused): a request within ``ttl`` seconds of the key's last fetch reuses it; the time
    counts from the fetch, not from the last use; ttl 0 never reuses.  Times count in whole microseconds; event ids are unique; a null
    key is a key of its own; requests without a time come first and are fetches.

    A key of at most ``HOT_ROWS`` requests is read in order by one task, which holds one number.  Those of a more frequent key are dealt
    by ranges of time over many tasks and go by links: each names the first one that is more than ``ttl`` later, and the fetches are
    what the first one leads to, marked by doubling the links.  Both ways give the same answers."""
    rows = events.select(
        F.col("event_id").cast("long").alias("event_id"), F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")).alias("k"),
        F.round(F.col(seconds).cast("double") * 1_000_000).cast("long").alias("t"),
    )
    if ttl <= 0:
        return rows.select("event_id", F.lit(False).alias("reused"))
    n = max(1, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    timed, untimed = rows.where(F.col("t").isNotNull()), rows.where(F.col("t").isNull()).select("event_id", F.lit(False).alias("reused"))
    hot = stored(timed.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("k"), "hot-keys")
    inner = timed.join(hot, "k", "left_anti").select("event_id", "k", "t")
    folded = inner.repartition(n, "k").sortWithinPartitions("k", "t", "event_id").mapInArrow(_fold(ttl * 1_000_000), "event_id long, reused boolean")
    out = folded.unionByName(untimed)
    if hot.isEmpty():
        return out
    return out.unionByName(_by_links(timed.join(hot, "k", "left_semi").select("event_id", "k", "t"), ttl * 1_000_000, n))


#: Requests of a key that one task reads.
HOT_ROWS = 1_000_000


def _fold(ttl: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fetched = None, 0
        for batch in batches:
            out = []
            for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                hit = k == now and t - fetched <= ttl
                if not hit:
                    now, fetched = k, t
                out.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_())], ["event_id", "reused"])

    return run


def _by_links(events: DataFrame, ttl: int, n: int) -> DataFrame:
    """(event_id, reused) of events(event_id, k, t): fetches are the events that the first one of a key leads to by links to
    the first event more than ``ttl`` later."""
    links = stored(successors(events, ttl, n), "links")
    if links.isEmpty():
        return events.select("event_id", F.lit(False).alias("reused"))
    first = events.groupBy("k").agg(F.min_by("event_id", F.struct("t", "event_id")).alias("event_id"))
    marked = stored(first.select("event_id"), "fetched")
    jump, count = links.where("next IS NOT NULL"), marked.count()
    while True:
        more = marked.join(jump, "event_id").select(F.col("next").alias("event_id"))
        marked = stored(marked.unionByName(more).distinct(), "fetched")
        now = marked.count()
        if now == count:  # where twice the links lead nowhere new, so do all
            break
        count = now
        ahead = jump.select(F.col("event_id").alias("next"), F.col("next").alias("_next"))
        jump = stored(jump.join(ahead, "next").select("event_id", F.col("_next").alias("next")), "links")
    fetched = marked.withColumn("_f", F.lit(True))
    return links.join(fetched, "event_id", "left").select("event_id", F.col("_f").isNull().alias("reused"))


def successors(events: DataFrame, ttl: int, n: int) -> DataFrame:
    """(event_id, next): for each of events(event_id, k, t) the first event of the key that is more than ``ttl`` later.

    Events and their probes at t + ttl are sorted together by ranges; what follows a probe is found in its range, or is the first event
    of the next range that has one."""
    both = events.select("k", "t", F.lit(0).alias("probe"), "event_id").unionByName(
        events.select("k", (F.col("t") + ttl).alias("t"), F.lit(1).alias("probe"), "event_id")
    )
    ranged = stored(both.repartitionByRange(n, "k", "t", "probe", "event_id").withColumn("r", F.spark_partition_id()), "probes")
    back = Window.partitionBy("r", "k").orderBy(F.desc("t"), F.desc("probe"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("next", F.last(F.when(F.col("probe") == 0, F.col("event_id")), ignorenulls=True).over(back)).where("probe = 1")
    heads = ranged.groupBy("r").agg(F.min(F.when(F.col("probe") == 0, F.struct("k", "t", "event_id"))).alias("head"))
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)  # of ``n`` rows at most
    heads = heads.select("r", F.last("head", ignorenulls=True).over(later).alias("head"))
    following = F.when(F.col("head.k") == F.col("k"), F.col("head.event_id"))
    return inside.join(F.broadcast(heads), "r").select("event_id", F.coalesce("next", following).alias("next"))


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def audit(checks: dict[str, tuple[DataFrame, Column]], key: str) -> DataFrame:
    """name -> (table, condition that must hold): the rows that break one, with its name; a null condition breaks it."""
    parts = [t.where(~F.coalesce(ok, F.lit(False))).select(F.lit(n).alias("constraint"), F.col(key).cast("string").alias("key")) for n, (t, ok) in checks.items()]
    return reduce(DataFrame.unionByName, parts)
