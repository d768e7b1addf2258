"""Streams give what the batch operators give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from parchment.functions.text import normalize_text, sentences
from parchment.operators import requests
from parchment.operators.requests import successors, ttl_reuse
from parchment.streaming import jobs


def test_sentences_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"One {i}. Two\nand more. Three") for i in range(20)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.stream_sentences(stream), str(tmp_path / "cp"), lambda df, _: got.extend(map(tuple, df.collect())))
    want = docs.select("doc_id", F.posexplode(sentences(normalize_text(F.col("text"))))).collect()
    assert sorted(got) == sorted(map(tuple, want))


def fold(rows, ttl):
    """(event_id, reused) one by one."""
    out, fetched = [], {}
    for e, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = ttl > 0 and k in fetched and t - fetched[k] <= ttl
        if not hit:
            fetched[k] = t
        out.append((e, hit))
    return sorted(out)


@pytest.mark.parametrize("ttl", [0, 5, 100_000])
@pytest.mark.parametrize("most", [3, 200, 10**6])
def test_reuse_of_a_key_in_many_ranges(spark, monkeypatch, ttl, most):
    monkeypatch.setattr(requests, "HOT_ROWS", most)
    r = random.Random(ttl)
    rows = [(i, 7 if i % 3 else r.randrange(40), float(r.randrange(3000)) + r.choice([0.0, 0.25])) for i in range(1500)]
    rows += [(5000 + i, 7, 44.0) for i in range(30)] + [(6000, None, 3.0), (6001, None, 4.0)]
    e = spark.createDataFrame(rows, "event_id long, key long, s double")
    assert sorted(map(tuple, ttl_reuse(e, "key", "s", ttl).collect())) == fold(rows, ttl)


def test_reuse_of_nothing_and_without_time(spark):
    e = spark.createDataFrame([], "event_id long, key long, s double")
    assert ttl_reuse(e, "key", "s", 9).count() == 0
    e = spark.createDataFrame([(1, 1, None), (2, 1, 5.0), (3, 1, 6.0)], "event_id long, key long, s double")
    assert sorted(map(tuple, ttl_reuse(e, "key", "s", 9).collect())) == [(1, False), (2, False), (3, True)]


def test_successors(spark):
    r = random.Random(1)
    rows = [(i, r.choice("abc"), r.randrange(400)) for i in range(600)]
    got = dict(map(tuple, successors(spark.createDataFrame(rows, "event_id long, k string, t long"), 25, 9).collect()))
    for e, k, t in rows:
        later = [(u, f) for f, q, u in rows if q == k and u > t + 25]
        assert got[e] == (min(later)[1] if later else None)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_ttl_stream_equals_batch(spark, tmp_path, rocksdb):
    r = random.Random(9)
    rows = sorted(((i, i % 5, float(r.randrange(90_000))) for i in range(120)), key=lambda x: x[2])
    for part in range(4):  # files that arrive one after another
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], "event_id long, key long, s double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    got = []
    stream = spark.readStream.schema("event_id long, key long, s double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.stream_ttl_reuse(stream, "key", "s", 3600), str(tmp_path / "cp"), lambda df, _: got.extend(map(tuple, df.collect())))
    assert sorted(got) == fold(rows, 3600)


def test_ttl_state_is_forgotten(spark, tmp_path, rocksdb):
    """After later requests have moved the watermark past fetch and ttl, no state of the key is left."""
    for part in ([(1, 1, 100.0), (2, 2, 110.0)], [(3, 3, 9000.0)], [(4, 3, 9001.0)]):
        spark.createDataFrame(part, "event_id long, key long, s double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("event_id long, key long, s double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.stream_ttl_reuse(stream, "key", "s", 3600), str(tmp_path / "cp"), lambda df, _: df.collect())
    state = spark.read.format("statestore").option("stateVarName", "fetched").load(str(tmp_path / "cp"))
    assert [x["key"]["k"] for x in state.collect()] == ["k3"]


def test_first_seen_and_registry(spark, tmp_path):
    h = spark.createDataFrame([(1, 3, 0.2, "2024-01-01 00:00:00"), (1, 1, 0.1, "2024-01-01 00:00:01"), (2, 2, 0.9, "2024-01-01 00:00:02")], "doc_id long, rank int, score double, t string")
    h = h.withColumn("t", F.col("t").cast("timestamp"))
    h.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(h.schema).parquet(str(tmp_path / "in"))
    seen, reg = [], []
    jobs.run_available(jobs.stream_first_seen(read(), "doc_id", "t", "1 hour"), str(tmp_path / "a"), lambda df, _: seen.extend(r["doc_id"] for r in df.collect()))
    jobs.run_available(jobs.stream_registry(read()), str(tmp_path / "b"), lambda df, _: reg.extend(map(tuple, df.collect())), "update")
    assert sorted(seen) == [1, 2] and sorted(reg) == [(1, 1, 0.2), (2, 2, 0.9)]
