"""WARC archives, decontamination, mixing, the pipeline."""

import gzip
import hashlib
import random

import numpy as np
import pytest

from parchment.llm import decontaminate, mixing, warc
from parchment.llm.common import scratch
from tests.llm.fixtures import documents, empty, words


def test_warc_revisits(spark):
    big, small = "<p>" + "x" * 120 + "</p>", "tiny"
    rows = [(5, "http://a", big), (2, "http://b", big), (9, "http://c\r\nx", big), (1, None, small), (3, "u", small), (4, "u", None), (6, "u", "é" * 80), (7, "u", "é" * 80), (7, "u", "é" * 80), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(warc.pages_to_records(pages).collect(), key=str)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
    assert by[2] == [("response", None)] and by[5] == by[9] == by[None] == [("revisit", 2)]
    assert by[1] == by[3] == by[4] == by[6] == [("response", None)]
    assert by[7] == [("revisit", 6)] * 2
    for r in got:
        html = {x[0]: x[2] for x in rows}[r["page_id"]]
        body = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
    assert warc.pages_to_records(pages.where("false")).count() == 0


def test_warc_files_are_members_with_fresh_headers(spark):
    pages = spark.createDataFrame([(i, "http://x", "y" * 200 if i % 2 else f"page {i} " * 30) for i in range(20)], "page_id long, url string, html string")
    raw, final = scratch(spark, "w1"), scratch(spark, "w2")
    files = warc.deduplicate(warc.write_raw(pages, raw), raw, final)
    kinds = []
    for f in files.collect():
        data = open(f["path"], "rb").read()
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == f["records"]
        fs, _ = warc.file_system(final)
        for start, length, record in warc.members(fs, f["path"]):
            head, payload = warc.parse(record)
            kinds.append(head["WARC-Type"])
            assert (payload == b"") == (head["WARC-Type"] == "revisit")
            assert gzip.decompress(data[start : start + length]) == record
    assert sorted(kinds) == ["response"] * 11 + ["revisit"] * 9


def test_warc_archives_that_hold_revisits(spark):
    raw, final = scratch(spark, "w3"), scratch(spark, "w4")
    fs, folder = warc.file_system(raw)
    fs.create_dir(folder, recursive=True)
    big, small, gone = b"y" * 300, b"tiny", b"z" * 500

    def one(kind, page, serial, payload, refers=None):
        digest = hashlib.sha256(payload).hexdigest()
        return gzip.compress(warc.record(kind, page, serial, "http://x", digest, len(payload), b"" if refers else payload, refers))

    records = [one("revisit", 1, 0, big, (1, 5)), one("response", 5, 1, big), one("response", 7, 2, big), one("revisit", 2, 3, small, (4, 9)), one("response", 9, 4, small), one("revisit", 3, 5, gone, (77, 70))]
    with fs.open_output_stream(f"{folder}/a.warc.gz", compression=None) as f:
        f.write(b"".join(records))
    files = warc.deduplicate(spark.createDataFrame([(f"{folder}/a.warc.gz", 6)], "path string, records long"), raw, final)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_records(files, final).collect()}
    assert got == {1: ("revisit", 5, 300), 5: ("response", None, 300), 7: ("revisit", 5, 300), 2: ("revisit", 9, 4), 9: ("response", None, 4), 3: ("revisit", 70, 500)}


def test_leaks(spark):
    r = random.Random(8)
    items = [(i, words(r, 40)) for i in range(6)] + [(90, "too short"), (91, None), (None, words(r, 30))]
    clean = [(i, words(r, 300)) for i in range(10)]

    def edited(text, every):
        return " ".join("zzz" if k % every == every - 1 else w for k, w in enumerate(text.split()))

    docs = clean + [
        (100, clean[0][1] + " " + items[0][1].upper() + ". " + clean[1][1]),
        (101, words(r, 20) + " " + edited(items[1][1], 7) + " " + words(r, 20)),
        (102, items[2][1]),
        (102, items[2][1]),
        (103, " ".join(items[3][1].split()[:20]) + " extra words here " + " ".join(items[3][1].split()[20:])),
        (104, None),
        (105, ""),
        (None, items[4][1]),
    ] + [(200 + i, words(r, 5) + " " + items[5][1]) for i in range(30)]  # a passage in many texts
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(x["doc_id"], x["item_id"]): x["score"] for x in got}
    assert set(pairs) == {(100, 0), (101, 1), (102, 2), (103, 3)} | {(200 + i, 5) for i in range(30)}
    assert pairs[100, 0] == 1 and 0.6 < pairs[101, 1] < 0.9 and len(got) == len(pairs)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


def test_leaks_with_an_edit_in_every_few_words(spark):
    r = random.Random(21)
    items = [(i, words(r, 40)) for i in range(3)]

    def edited(text, every):
        return " ".join(f"zz{k}" if k % every == every - 1 else w for k, w in enumerate(text.split()))

    docs = [(i, words(r, 200)) for i in range(5)]
    docs += [(10 + every, words(r, 30) + " " + edited(items[every - 4][1], every) + " " + words(r, 30)) for every in (4, 5, 6)]
    alone = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in alone.collect()} == {(14, 0), (15, 1), (16, 2)}
    docs += [(20 + i, words(r, 10) + " " + t) for i, t in items]  # verbatim copies elsewhere
    both = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in both.collect()} == {(14, 0), (15, 1), (16, 2), (20, 0), (21, 1), (22, 2)}


def test_leaks_match_alignment_of_all_pairs(spark):
    r = random.Random(17)
    items = [(i, words(r, r.randint(12, 45))) for i in range(8)]

    def worn(text):
        out = []
        for w in text.split():
            k = r.random()
            out += [] if k < 0.06 else [w, "inserted"] if k < 0.12 else [f"zz{r.random()}"] if k < 0.22 else [w]
        return " ".join(out)

    docs = [(i, " ".join([words(r, r.randint(0, 60)), worn(items[i % 8][1]) if i % 5 else " ".join(items[i % 8][1].split()[: r.randint(3, 30)]), words(r, r.randint(0, 60))])) for i in range(80)]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in got}
    want, number = {}, {}
    for d, text in docs:
        passage = np.array([number.setdefault(w, len(number) + 1) for w in decontaminate.item_words(text)], np.int32)
        for i, item in items:
            ws = decontaminate.item_words(item)
            best, _ = decontaminate.align(np.array([number.setdefault(w, len(number) + 1) for w in ws], np.int32), passage[None])
            if best[0] >= decontaminate.LEAK * 2 * len(ws):
                want[d, i] = best[0] / (2 * len(ws))
    assert len(want) > 40 and set(got) <= set(want)
    assert len(got) >= 0.95 * len(want)  # those left have no three words of the item side by side
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_alignment_matches_plain_dynamic_programming():
    r = np.random.default_rng(3)
    for _ in range(20):
        item, passage = r.integers(1, 5, 8), r.integers(1, 5, 15)
        h = np.zeros((9, 16), int)
        for i in range(1, 9):
            for j in range(1, 16):
                s = decontaminate.MATCH if item[i - 1] == passage[j - 1] else decontaminate.MISMATCH
                h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
        best, _ = decontaminate.align(item.astype(np.int32), passage[None].astype(np.int32))
        assert best[0] == h.max()


def test_seeds_take_the_rarest_of_each_run():
    f = np.array([5, 1, 9, 9, 9, 9, 2, 9])
    assert decontaminate.choose_seeds(np.arange(8), f, 4).tolist() == [1, 2, 6]
    assert len(decontaminate.choose_seeds(np.arange(3), f[:3], 4)) == 1


def test_raking_meets_the_targets(spark):
    docs = documents(spark)
    counted = mixing.counted_documents(docs)
    table = mixing.cells(counted).where("tokens > 0")
    goals = {d: mixing.tempered(table, d, 0.5) for d in ("source", "lang")}
    got = mixing.rake(table, goals, rounds=25).toPandas()
    got["w"] = got.tokens * got.factor
    for d in ("source", "lang"):
        want = goals[d].toPandas().set_index(d)["share"]
        assert np.allclose(got.groupby(d)["w"].sum() / got["w"].sum(), want.sort_index(), atol=1e-3)


def test_sample(spark):
    docs = documents(spark)
    got = mixing.sample(docs).collect()
    assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in docs.collect()}
    assert all(r["copies"] in (int(r["expected"]), int(r["expected"]) + 1) for r in got)
    assert sum(r["doc_id"] == 5 for r in got) in (0, 3)  # repeated rows share their fate
    assert mixing.sample(empty(spark)).count() == 0


def test_mixing_sql(spark, tmp_path):
    import duckdb

    docs = documents(spark).where("doc_id is not null and doc_id <> 5")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted((r[0], r[6]) for r in con.execute(mixing.sample_sql()).fetchall())
    assert sorted((r["doc_id"], r["copies"]) for r in mixing.sample(docs).collect()) == want


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(12)
    d = tmp_path_factory.mktemp("sf")
    passage, item = words(r, 120), words(r, 40)
    rows, labels = [], []
    for i in range(260):
        w = words(r, r.randint(40, 120)).split()
        if i % 4 == 0:
            w[3] = w[20] = w[-2] = "scumbag"
        labels.append((i, 1, int(i % 4 == 0)))
        rows.append((i, " ".join(w)))
    clean = dict(rows)
    rows += [(500, clean[1]), (501, clean[1]), (502, clean[2] + " " + passage), (503, clean[3][::-1] + " " + passage), (504, words(r, 30) + " " + item + " " + words(r, 30))]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), passage


def test_near_duplicates_reach_the_similarity(spark):
    import corpus_pipeline
    from parchment.llm.simhash import _shingle_hashes

    r = random.Random(31)
    rows = []
    for i in range(40):
        w = words(r, 200).split()
        rows.append((2 * i, " ".join(w)))
        for k in r.sample(range(200), 3 + i % 8):  # similarities on both sides of 0.8
            w[k] = f"edit{k}"
        rows.append((2 * i + 1, " ".join(w)))
    rows += [(200 + i, rows[0][1] + f" tail{i}") for i in range(30)] + [(300, ""), (301, None), (302, "two words"), (None, "x"), (None, "x")]
    sets = {i: set(_shingle_hashes((t or "").encode(), 5)) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a] = label[b]
        if all(label[label[i]] == label[i] for i in label):
            break
    want = sorted(i for i in label if label[i] == i)
    assert 45 < len(want) < 75
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert got.count(None) == 1 and set(want) <= set(got)  # of equal rows one; nothing below 0.8 is lost
    assert len(got) - 1 <= len(want) + 0.3 * (len(sets) - len(want))  # candidates near 0.8 are found by chance
    assert not {200 + i for i in range(30)} & set(got) and 301 not in got


def test_near_duplicates_by_row(spark):
    import corpus_pipeline

    r = random.Random(4)
    a, b = words(r, 80), words(r, 80)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "en", "s", 1), (2, a, None, "s", None), (None, a, "en", "s", 1), (None, words(r, 50), "s", None, 1)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted((x["doc_id"] or 0, x["text"] in (a, b)) for x in got) == [(0, False), (1, True), (1, True)]
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_repeated_passages, corpus_pipeline.mix_sources):
        assert stage(spark, spark.createDataFrame([], schema), "").count() == 0


def test_leaks_by_row(spark, corpus):
    import corpus_pipeline

    d, _ = corpus
    item = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    rows = [(1, item, "en", "s", 1), (1, "other text", "en", "s", 1), (None, item, "en", "s", 1), (None, "clean", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {(x["doc_id"], x["text"]) for x in corpus_pipeline.drop_leaks(spark, docs, d).collect()} == {(1, "other text"), (None, "clean")}


def test_pipeline(spark, corpus):
    import corpus_pipeline

    d, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert tuple(docs.columns[:5]) == corpus_pipeline.COLUMNS
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in rows}
    toxic = {i for i in range(260) if i % 4 == 0}
    assert len(toxic & set(kept["toxicity"])) <= 5 and len(set(range(260)) - toxic - set(kept["toxicity"])) <= 8
    assert {500, 501} & set(kept["near_duplicates"]) == set() if 1 in kept["near_duplicates"] else True
    assert all(passage[:400] not in t for t in kept["repeated_passages"].values())
    assert set(kept["repeated_passages"]) == set(kept["near_duplicates"])
    assert 504 not in kept["decontamination"] and set(kept["repeated_passages"]) - {504} == set(kept["decontamination"])
    assert set(kept["mixing"]) <= set(kept["decontamination"])
