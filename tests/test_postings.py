import random
import re

from pyspark.sql import functions as F

from lexloom.operators import postings
from lexloom.session import shared_folder


def like(text, query):
    if text is None:
        return False
    parts = re.findall(r"(?s)\\.|.", query.lower())
    quoted = [".*" if p == "%" else "." if p == "_" else re.escape(p[-1]) for p in parts]
    return re.search("".join(quoted), text.lower(), re.S) is not None


def test_search_like_a_scan(spark):
    rng = random.Random(9)
    words = ["Straße", "über", "abc", "ab", "a%b", "x_y", "\U0001f600 ok", "naïve", "中文字", "(a+b)*", "line\nbreak", "\\path"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = [(f"d{i}", text(rng.randint(0, 12)), rng.choice(["note", None])) for i in range(120)]
    rows += [("none", None, None), ("empty", "", ""), ("long", text(30_000) + " needle", None)]
    queries = ["abc", "ABC", "ab", "a", "", "%", "_", "__", "a\\%b", "x\\_y", "ß%ü", "b%a%c", "%%", "中文", "文字 ", "😀", "e\nb", "(a+b)*",
               "\\\\path", "zzz", "needle", "abc%needle", "n_te", "a b", "O", "ÜBER", "u_e", "中_字 ", "k a%😀_o"]
    docs = spark.createDataFrame(rows, "document_id string, text string, kind string").repartition(4)
    folder = shared_folder(spark, "postings")
    postings.write_index(docs, ["text", "kind"], folder)
    asked = spark.createDataFrame([(q, q) for q in queries] + [("null", None)], "query_id string, query string")
    found = [tuple(r) for r in postings.search(spark, folder, docs, ["text", "kind"], asked).collect()]
    wanted = {(q, d) for q in queries for d, t, k in rows if like(t, q) or like(k, q)}
    assert len(found) == len(wanted) and set(found) == wanted
    for q in queries:  # and like the engine's own operator
        same = docs.where(F.col("text").ilike(f"%{q}%") | F.col("kind").ilike(f"%{q}%"))
        if q != "abc%needle":  # a pattern that would be tried again and again on the long text
            assert {r[0] for r in same.select("document_id").collect()} == {d for x, d in wanted if x == q}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "document_id string, text string")
    folder = shared_folder(spark, "postings")
    postings.write_index(docs, ["text"], folder)
    asked = spark.createDataFrame([("q", "abc"), ("r", "a")], "query_id string, query string")
    assert postings.search(spark, folder, docs, ["text"], asked).count() == 0


def test_segments_hold_every_gram_of_every_row():
    rng = random.Random(3)
    wide = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))  # too many characters to put beside the places
    for rows in ([], [[]], [["", "ab"], [], ["abab", "b"], ["ü"]], [["".join(rng.choice("abc ") for _ in range(50))] for _ in range(40)], [[wide], ["ab"]]):
        got = [(g, p) for grams, places in postings._segment_grams(rows) for g, p in zip(grams.tolist(), places.tolist())]
        wanted = {(g, k) for k, row in enumerate(rows) for x in row for n in range(4) for g in postings.gram_codes(x, n).tolist()}
        assert len(got) == len(wanted) and set(got) == wanted


def test_index_has_a_row_for_a_gram_of_a_segment_not_of_a_document(spark):
    docs = spark.range(2_000).selectExpr("cast(id as string) AS document_id", "concat('order-', id, '.pdf') AS text").coalesce(2)
    folder = shared_folder(spark, "postings")
    postings.write_index(docs, ["text"], folder)
    index = spark.read.parquet(f"{folder}/postings")
    assert index.count() < 5_000 and index.agg(F.sum("n")).first()[0] > 40_000
    asked = spark.createDataFrame([("a", "order-1_99"), ("b", "9.PDF"), ("c", "")], "query_id string, query string")
    found = {r[0]: r[1] for r in postings.search(spark, folder, docs, ["text"], asked).groupBy("query_id").count().collect()}
    assert found == {"a": 10, "b": 200, "c": 2_000}
