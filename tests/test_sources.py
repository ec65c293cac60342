import json

from pyspark.sql import functions as F

from lexloom.operators import rules
from lexloom.sources import files, sinks


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes("café".encode())
    (tmp_path / "a" / "bad.md").write_bytes(b"ok \xff end")
    (tmp_path / "skip.pdf").write_bytes(b"no")
    got = {r[0]: r[1] for r in files.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a/x.txt": "café", "a/bad.md": "ok � end"}
    only = spark.createDataFrame([("a\\x.txt",)], "corpus_path string")
    assert [r[0] for r in files.read_corpus(spark, str(tmp_path), only).collect()] == ["a/x.txt"]


def test_benchmark_scan(spark, tmp_path):
    data = {
        "cases": [
            "noise",
            {"question": "  What law? ", "answers": "not a list"},
            {"query": "q2", "ground_truth": ["some text", {"path": "d\\b.txt", "start": 3, "end": 9}]},
            {"id": "c7", "query": "q3", "snippets": {"file_path": "a.txt", "span": [1, 5], "answer": "yes"}},
            {"query": "", "snippets": ["x"]},
        ]
    }
    (tmp_path / "set.json").write_text(json.dumps(data))
    rows = files.read_benchmark(spark, str(tmp_path / "set.json")).orderBy("case_id", "snippet_no").collect()
    got = [(r["case_id"], r["query"], r["corpus_path"], r["start"], r["end"], r["text"]) for r in rows]
    assert got == [
        ("c7", "q3", "a.txt", 1, 5, "yes"),
        ("set-2", "q2", None, None, None, "some text"),
        ("set-2", "q2", "d/b.txt", 3, 9, ""),
    ]


def test_benchmark_files_of_one_name(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "tests.json").write_text(json.dumps([{"query": f"{folder}{i}", "answers": ["x"]} for i in range(2)]))
    rows = files.read_benchmark(spark, str(tmp_path / "*")).collect()
    assert sorted((r["case_id"], r["query"]) for r in rows) == [("tests-1", "a0"), ("tests-1", "b0"), ("tests-2", "a1"), ("tests-2", "b1")]


def test_upload_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(b"12345")
    (tmp_path / "y.exe").write_bytes(b"1")
    got = {r["path"].rpartition("/")[2]: (r["length"], r["content_type"]) for r in files.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {"x.PDF": (5, "application/pdf"), "y.exe": (1, "application/octet-stream")}


def test_intake(spark):
    df = spark.createDataFrame(
        [(1, "image/PNG; x=1"), (60 * 1024 * 1024, "image/png"), (1, "text/plain")], "length long, content_type string"
    )
    got = [(r["accepted"], r["reason"]) for r in files.intake_check(df).collect()]
    assert got[0] == (True, None) and not got[1][0] and "50 MB" in got[1][1] and not got[2][0]


def test_chunk_sink_replaces_only_its_folders(spark, tmp_path):
    out = str(tmp_path / "chunks")
    df = spark.range(50).select(
        F.col("id").cast("string").alias("document_id"), F.col("id").cast("string").alias("chunk_id")
    )
    sinks.write_chunks(df, out, buckets=8)
    assert spark.read.parquet(out).count() == 50


def test_line_rules(spark):
    text = "\n".join(
        [
            'token = "abcdefgh12345678abcd"',
            "jwt.decode(x, algorithm='none')",
            'db.execute(f"select * from t where a={x}")',
            "requests.get(u, verify=False)",
            "print(password)",
            'token = os.getenv("abcdefgh12345678abcd")',
        ]
    )
    df = spark.createDataFrame([("f", text)], "file string, text string")
    got = rules.scan_lines(df, "file").orderBy("line_no").collect()
    assert [(r["line_no"], r["severity"]) for r in got] == [
        (1, "CRITICAL"), (2, "CRITICAL"), (3, "CRITICAL"), (4, "WARN"), (5, "WARN"),
    ]


def test_text_files_are_written_by_tasks_as_by_sparks_writer(spark, tmp_path):
    sources = [None, "", "a/b", "x=y", "50%", "é [1]", 'q"#:*?\\^{}\'', "plain", "plain"]
    rows = spark.createDataFrame([(s, None if i == 7 else f"{i}\né\n") for i, s in enumerate(sources)], "source string, text string")
    sinks.write_texts(rows, str(tmp_path / "own"), "source")
    rows.select("source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").option("maxRecordsPerFile", 1).text(str(tmp_path / "spark"))

    def found(name):
        return sorted((p.parent.name, p.read_bytes()) for p in (tmp_path / name).rglob("*.txt"))

    assert found("own") == found("spark") and len(found("own")) == len(sources)
    # Spark's local writer sets modes and writes checksums by two further processes and a second file for each text.
    assert [p for p in (tmp_path / "own").rglob("*") if p.is_file() and p.suffix != ".txt"] == []
