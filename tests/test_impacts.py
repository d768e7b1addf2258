"""Top k from the block index equals scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from parchment.operators import impacts as I
from parchment.operators import retrieval as R


def both(spark, docs, questions, k, also=None):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(questions, "query_id long, query string")
    index = I.write_index(d)
    ranked = I.lexical_topk(q, index, k, also)
    old = R.bm25_index(d)
    lex = R.bm25(q, old)
    show = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 8)) for r in df.collect())
    return show(R.ranked(ranked.scores, k)), show(R.ranked(lex, k)), ranked, R.minmax(lex, old.totals)


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(I, "SHARD", 16)
    monkeypatch.setattr(I, "QUESTIONS", 7)
    monkeypatch.setattr(I, "WITNESSES", 8)


def test_topk_equals_all_pairs(spark, small_shards):
    r = random.Random(3)
    common, rare = ["the", "of", "a"], [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(common if r.random() < 0.5 else rare) for _ in range(n))
    docs = [(i, text(r.randint(1, 60))) for i in range(200)] + [(500 + i, "the same text w1 w2") for i in range(40)] + [(900, None), (901, ""), (902, "x" * 9000)]
    questions = [(i, text(r.randint(1, 12))) for i in range(30)] + [(50, "w1 w2"), (51, "unknown"), (52, None), (53, "the the w5")]
    also = spark.createDataFrame([(50, 3), (50, 500), (53, 900), (51, 2)], "query_id long, doc_id long")
    got, want, ranked, _ = both(spark, docs, questions, 5, also)
    best = {(q, d): s for q, d, s in want}
    assert [x for x in got if x[2] > 0] == want
    # scaled scores of the best equal those from all pairs
    _, _, plain, all_scaled = both(spark, docs, questions, 5)
    exact = {(x["query_id"], x["doc_id"]): x["score"] for x in all_scaled.collect()}
    for x in I.scaled(plain).collect():
        assert x["score"] == pytest.approx(exact[x["query_id"], x["doc_id"]], abs=1e-9)
    pairs = {(x["query_id"], x["doc_id"]) for x in ranked.scores.collect()}
    assert {(50, 3), (50, 500), (53, 900)} <= pairs and best


def test_every_document_shares_a_word(spark, small_shards):
    docs = [(i, f"all u{i} v{i} " + "w " * i) for i in range(40)]
    got, want, ranked, old = both(spark, docs, [(1, "all w"), (2, "w")], 3)
    assert got == want
    lo = {x["query_id"]: x["lo"] for x in ranked.bounds.collect()}
    assert lo[2] == 0 and lo[1] != 0
    exact = {(x["query_id"], x["doc_id"]): x["score"] for x in old.collect()}
    assert all(x["score"] == pytest.approx(exact[x["query_id"], x["doc_id"]], abs=1e-9) for x in I.scaled(ranked).collect())


def test_weights_below_zero(spark):
    got, want, _, _ = both(spark, [(1, "a b"), (2, "a b"), (3, "a")], [(1, "a b"), (2, "b")], 2)
    assert got == want


def test_nothing(spark):
    got, want, ranked, _ = both(spark, [], [(1, "a")], 5)
    assert got == want == [] and ranked.bounds.count() == 0
    got, want, _, _ = both(spark, [(1, "a"), (2, "")], [], 5)
    assert got == want == []


def test_rows_that_leave_a_shard(spark, small_shards):
    """They don't grow with its documents: five a question and shard, and ties but for copies."""
    docs = [(i, f"common word{i % 50} " + "pad " * (i % 7)) for i in range(160)]
    _, _, ranked, _ = both(spark, docs, [(1, "common word3"), (2, "pad")], 5)
    shards = ranked.shards.count()
    assert ranked.scores.count() <= 5 * 5 * shards
    assert ranked.scores.groupBy("query_id").agg(F.count("*").alias("n")).count() == 2
