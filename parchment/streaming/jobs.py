"""Structured Streaming jobs over the same functions as the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parchment.functions.text import normalize_text, sentences


def stream_sentences(docs: DataFrame) -> DataFrame:
    """The stateless part of intake: normalised sentences of arriving texts."""
    clean = docs.select("doc_id", normalize_text(F.col("text")).alias("text"))
    return clean.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"))


def stream_first_seen(rows: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once; keys older than the watermark are forgotten, which bounds the state."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


class _Reuse(StatefulProcessor):
    """The time of a key's last fetch, forgotten by a timer once no later request can reuse it."""

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fetched = handle.getValueState("fetched", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.fetched.get()
        before = fetched = found[0] if found is not None else None
        for frame in _in_order(rows):
            out = []
            for t in frame["t"].tolist():
                hit = self.ttl > 0 and fetched is not None and t - fetched <= self.ttl
                if not hit:
                    fetched = t
                out.append(hit)
            yield pd.DataFrame({"event_id": frame["event_id"], "reused": out})
        if fetched != before:
            self.fetched.update((fetched,))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((fetched + self.ttl) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.fetched.clear()
        return iter(())

    def close(self) -> None:
        pass


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that one trigger brings for a key, by time."""
    yield pd.concat(list(frames)).sort_values(["t", "event_id"], ignore_index=True)


def stream_ttl_reuse(events: DataFrame, key: str, seconds: str, ttl: int, delay: str = "0 seconds") -> DataFrame:
    """(event_id, reused) of arriving requests, for ``transformWithState`` (needs the RocksDB state store).

    The state of a key is the time of its last fetch; a timer forgets it when the watermark, ``delay`` behind the latest
    request, has passed that time by ``ttl``, so the state holds keys of the last ``ttl`` and delay alone.  Requests of a
    trigger are taken by time; those behind the watermark are left out by Spark."""
    keyed = events.select(
        F.col("event_id").cast("long").alias("event_id"), F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")).alias("k"),
        F.round(F.col(seconds).cast("double") * 1_000_000).cast("long").alias("t"),
    )
    timed = keyed.withColumn("at", F.timestamp_micros("t")).withWatermark("at", delay)
    return timed.groupBy("k").transformWithStateInPandas(
        _Reuse(ttl), "event_id long, reused boolean", outputMode="Append", timeMode="EventTime"
    )


def stream_registry(hits: DataFrame) -> DataFrame:
    """Best rank and score of each document so far (update mode)."""
    return hits.groupBy("doc_id").agg(F.min("rank").alias("best_rank"), F.max("score").alias("best_score"))


def run_intake(docs: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """docs(document_id, text) as they arrive -> their fields.  A document is one row, so what a batch gives is what all documents at
    once would give."""
    from parchment.operators.contracts import read_fields

    run_available(docs.select("document_id", normalize_text(F.col("text")).alias("text")), checkpoint, lambda df, batch: write(read_fields(df), batch))


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what has arrived, then stop; a repeated run goes on from the checkpoint."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
