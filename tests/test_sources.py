import json

from pyspark.sql import functions as F

from parchment.sources import tables as S


def test_articles(spark, tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text(json.dumps([{"index": 1, "article_number": 84}, {"index": 2, "article_number": 84}]))
    bad.write_text(json.dumps({"index": 1}))
    rows, status = S.load_articles(spark, str(good))
    assert status == "ok" and sorted(r["index"] for r in rows.collect()) == [1, 2]
    rows, status = S.load_articles(spark, str(bad))
    assert status == "invalid" and rows.count() == 0


def test_questions_keep_their_row(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('question,article_number,article_orig,index\n"one, two",84,84,1\n"line\nbreak",5,5,2\n')
    got = {r["source_row"]: (r["question"], r["index"]) for r in S.load_questions(spark, str(p)).collect()}
    assert got == {2: ("one, two", 1), 3: ("line\nbreak", 2)}


def test_cases_are_split(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"case_id": "a", "task": "t", "tags": ["x"]}\n{"case_id": "b", "task": "t", "other": 1}\nnot json\n{"task": "t"}\n')
    good, bad = S.load_cases(spark, str(p))
    assert [r["case_id"] for r in good.collect()] == ["a"]
    assert {(r["line"], r["problem"]) for r in bad.collect()} == {(2, "unknown keys"), (3, "not a JSON object of the schema"), (4, "no case_id")}


def test_catalogue(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7", "b.pdf": b"nope", "c.docx": b"PK\x03\x04x", "d.exe": b"MZ", "e.txt": b"", "f.txt": b"x" * 50}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["verdict"], r["document_id"]) for r in S.catalogue_files(spark, f"{tmp_path}/*", max_bytes=20, listing=spark.createDataFrame([(f"file:{p}",) for p in tmp_path.iterdir() if not p.name.startswith(".")], "path string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.pdf": "ok", "b.pdf": "content_mismatch", "c.docx": "ok", "d.exe": "unsupported_type", "e.txt": "empty", "f.txt": "too_large"}
    assert got["a.pdf"][1].startswith("doc_") and len(got["a.pdf"][1]) == 20


def test_drift_and_sinks(spark, tmp_path):
    f = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, sha256 string")
    m = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "name string, sha256 string")
    assert {(r["name"], r["problem"]) for r in S.source_drift(f, m).collect()} == {("b", "changed"), ("c", "unrecorded"), ("d", "missing")}
    S.write_json_lines(f, str(tmp_path / "j"), ["name"])
    S.write_csv(f, str(tmp_path / "c"), ["name"])
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def test_vectors_and_pages(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, embedding array<double>")
    assert S.load_vectors(v, 2).count() == 1
    p = spark.createDataFrame([(1, "https://www.x.org/a", "")], "page_id int, url string, html string")
    r = S.page_source(p, F.lit("t"), F.lit("snip"), F.col("html")).first()
    assert r["content"] == "snip" and r["domain"] == "x.org"


def test_a_pattern_of_files_is_one_input_path(spark, tmp_path):
    """Not one for each match, of which each would be looked up by itself; folders below are not reached."""
    (tmp_path / "k=1").mkdir()
    for name in ("a.txt", "b.txt", "c.pdf", "k=1/d.txt"):
        (tmp_path / name).write_text("abc")
    found = S.catalogue_files(spark, f"{tmp_path}/*.txt")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.txt", "b.txt"]
    assert "InMemoryFileIndex(1 paths)" in found._jdf.queryExecution().toString()
