"""Keyword search by posting lists of character trigrams: candidates by an equi join, then the pattern itself."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.session import cut_lineage

#: A segment of the index ends with so many documents or, before that, so many characters.
SEGMENT_DOCUMENTS, SEGMENT_CHARS = 1 << 14, 1 << 21

#: Of a pattern's trigrams, so many of the rarest are looked up.
RAREST = 4


_NONE = 0x1FFFFF  # no character's number


def gram_codes(text: str, n: int) -> np.ndarray:
    """Distinct runs of ``n`` characters (0 to 3) as one number each, 21 bits a character."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    count = max(0, len(chars) - n + 1) if n else 1
    code = np.zeros(count, np.int64)
    for k in range(3):
        code = (code << 21) | (chars[k : k + count] if k < n else _NONE)
    return np.unique(code)


def _gram_rows(key: str, sizes: list[int]):
    """(gram, key) for every distinct gram of the other columns of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(key)
            fields = [batch.column(c).to_pylist() for c in batch.schema.names if c != key]
            found = [
                np.unique(np.concatenate([gram_codes(x, n) for x in texts if x is not None for n in sizes] or [np.zeros(0, np.int64)]))
                for texts in zip(*fields)
            ]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), names.take(pa.array(row))], names=["gram", key])

    return run


def grams_of(rows: DataFrame, key: str, fields: list[str], sizes: list[int]) -> DataFrame:
    """(gram, key): the distinct grams of the lower-case fields of every row."""
    lower = rows.select(key, *[F.lower(F.col(f)).alias(f) for f in fields])
    return lower.mapInArrow(_gram_rows(key, sizes), f"gram long, `{key}` {rows.schema[key].dataType.simpleString()}")


_HEADER = -1  # instead of a gram: the row that names a segment's documents


def _segment_grams(rows: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, place) for every distinct run of 0 to 3 characters of every row, in order."""
    filled = np.array([k for k, texts in enumerate(rows) if texts], np.int64)
    yield np.full(len(filled), gram_codes("", 0)[0]), filled
    texts = [x for row in rows for x in row]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(x) for x in texts], np.int64)
    field = np.repeat(np.arange(len(texts)), lengths)
    place = np.repeat(np.repeat(np.arange(len(rows)), [len(row) for row in rows]), lengths)
    alphabet = np.unique(chars).astype(np.int64)
    dense = np.searchsorted(alphabet, chars)
    wide, low = int(len(alphabet)).bit_length(), int(len(rows)).bit_length()
    for n in (1, 2, 3):
        count = max(0, len(chars) - n + 1)
        inside = np.flatnonzero(field[:count] == field[n - 1 : n - 1 + count])
        code = np.zeros(len(inside), np.int64)
        for k in range(n):
            code = (code << wide) | dense[inside + k]
        known = None
        if n * wide + low > 63:  # more different characters than fit beside the places
            known, code = np.unique(code, return_inverse=True)
        both = np.unique((code << low) | place[inside])
        code = both >> low
        code = code if known is None else known[code]
        gram = np.zeros(len(code), np.int64)
        for k in range(3):
            gram = (gram << 21) | (alphabet[(code >> wide * (n - 1 - k)) & ((1 << wide) - 1)] if k < n else _NONE)
        yield gram, both & ((1 << low) - 1)


def _segments(key: str):
    """Rows (gram, segment, n, places, ids): posting lists of a stretch of a task's rows, and one row with its ids."""

    def written(number: int, ids: pa.Array, rows: list[list[str]]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "segment", "n", "places", "ids"]
        none = pa.array([None], pa.list_(pa.int32()))
        header = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([pa.array([_HEADER], pa.int64()), pa.array([number], pa.int64()), pa.array([0], pa.int32()), none, header], names=names)
        for gram, place in _segment_grams(rows):
            begins = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
            ends = np.append(begins, len(gram))
            for at in range(0, len(begins), 20_000):
                cut = ends[at : at + 20_001]
                lists = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(place[cut[0] : cut[-1]], pa.int32()))
                size = len(cut) - 1
                columns = [pa.array(gram[cut[:-1]]), pa.array([number] * size, pa.int64()), pa.array(np.diff(cut), pa.int32()), lists]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(size, pa.list_(ids.type))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, rows, chars = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            names, fields = batch.column(key), [batch.column(c) for c in batch.schema.names if c != key]
            for i in range(batch.num_rows):
                row = [x for x in (f[i].as_py() for f in fields) if x is not None]
                ids.append(names.slice(i, 1))
                rows.append(row)
                chars += sum(map(len, row))
                if len(rows) >= SEGMENT_DOCUMENTS or chars >= SEGMENT_CHARS:
                    yield from written(number, pa.concat_arrays(ids), rows)
                    number, ids, rows, chars = number + 1, [], [], 0
        if rows:
            yield from written(number, pa.concat_arrays(ids), rows)

    return run


def write_index(documents: DataFrame, fields: list[str], folder: str) -> None:
    """Posting lists of all grams of one to three characters and of the empty one, by segments.

    A segment is a stretch of the rows of one task, so nothing is shuffled and a row of the index is a gram with
    its places in the segment, not with one document. The ids stand in the segment's header, written by the same task.
    """
    lower = documents.select("document_id", *[F.lower(F.col(f)).alias(f) for f in fields])
    kind = documents.schema["document_id"].dataType.simpleString()
    rows = lower.mapInArrow(_segments("document_id"), f"gram long, segment long, n int, places array<int>, ids array<{kind}>")
    rows.write.parquet(f"{folder}/postings")


def _literals(query: Column) -> Column:
    """Parts of a pattern that a match holds as they are; wildcards and escaped characters part them."""
    return F.split(F.lower(query), r"(?s)\\.|[%_]")


def like_anywhere(query: Column) -> Column:
    """A regular expression that finds in lower-case text what ``ilike '%query%'`` matches.

    Parts between ``%`` are atomic: each is taken where it first occurs behind the one before, which is enough
    for such patterns, and nothing is ever tried again. So a long text costs one pass, with or without a match.
    """

    def of_token(token: Column) -> Column:
        literal = F.when(F.startswith(token, F.lit("\\")), F.substring(token, 2, 1)).otherwise(token)
        quoted = F.regexp_replace(literal, r"([^\p{L}\p{N}\s])", r"\\$1")
        return F.when(token == "%", F.lit(")(?>.*?")).when(token == "_", F.lit(".")).otherwise(quoted)

    tokens = F.regexp_extract_all(F.lower(query), F.lit(r"(?s)\\.|."), F.lit(0))
    return F.concat(F.lit(r"(?s)\A(?>.*?"), F.array_join(F.transform(tokens, of_token), ""), F.lit(")"))


def _without_wildcards(query: Column) -> Column:
    """The text that a pattern without wildcards stands for; NULL for any other."""
    tokens = F.regexp_extract_all(F.lower(query), F.lit(r"(?s)\\.|."), F.lit(0))
    literal = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit("\\")), F.substring(t, 2, 1)).otherwise(t))
    return F.when(~F.exists(tokens, lambda t: t.isin("%", "_")), F.array_join(literal, ""))


def search(spark: SparkSession, folder: str, documents: DataFrame, fields: list[str], queries: DataFrame) -> DataFrame:
    """(query_id, document_id) where a field holds the query, case-blind; ``%`` and ``_`` act as wildcards.

    ``queries`` has (query_id, query). A pattern with a literal part of three characters or more looks up its
    rarest trigrams, any other its longest part; the documents on all of these lists are then held against
    the pattern. The result is that of a scan with ``ilike``. Nulls, of a field or a query, match nothing.
    """
    asked = queries.where("query IS NOT NULL").select("query_id", "query", _literals(F.col("query")).alias("parts"))
    size = F.array_max(F.transform("parts", F.length))
    long = grams_of(asked.where(size >= 3).select("query_id", F.explode("parts").alias("part")), "query_id", ["part"], [3]).distinct()
    # What is asked for is written first: its size is then known, and the index is not shuffled to meet it.
    long = cut_lineage(long.withColumn("n_grams", F.count("*").over(Window.partitionBy("query_id"))))
    postings = spark.read.parquet(f"{folder}/postings")
    counts = postings.select("gram", "n").join(long.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n"))
    rare = Window.partitionBy("query_id").orderBy("n", "gram")
    picked = long.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("r", F.row_number().over(rare))
    picked = picked.where(F.col("r") <= RAREST).select("gram", "query_id", F.least("n_grams", F.lit(RAREST)).alias("need"))
    longest = F.reduce("parts", F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    short = asked.where(size < 3).select("query_id", longest.alias("part"))
    whole = [grams_of(short.where(F.length("part") == n), "query_id", ["part"], [n]) for n in (0, 1, 2)]
    looked_up = cut_lineage(picked.unionByName(reduce(DataFrame.unionByName, whole).withColumn("need", F.lit(1).cast("long"))))
    held = looked_up.join(postings.select("gram", "segment", "places"), "gram").groupBy("segment", "query_id")
    held = held.agg(F.collect_list("places").alias("lists"), F.first("need").alias("need")).where(F.size("lists") == F.col("need"))
    common = F.reduce("lists", F.get("lists", F.lit(0)), F.array_intersect)
    ids = postings.where(F.col("gram") == _HEADER).select("segment", "ids")
    met = held.select("segment", "query_id", common.alias("places")).join(ids, "segment").select("query_id", "ids", F.explode("places").alias("place"))
    candidates = met.select("query_id", F.get("ids", "place").alias("document_id"))
    patterns = asked.select("query_id", like_anywhere(F.col("query")).alias("pattern"), _without_wildcards(F.col("query")).alias("literal"))
    lower = documents.select("document_id", *[F.lower(F.col(f)).alias(f) for f in fields])
    found = candidates.join(lower, "document_id").join(cut_lineage(patterns), "query_id")

    def held_in(field: str) -> Column:
        plain = F.col("literal").isNotNull()
        return F.coalesce(F.when(plain, F.contains(field, "literal")).otherwise(F.rlike(field, "pattern")), F.lit(False))

    return found.where(reduce(Column.__or__, [held_in(f) for f in fields])).select("query_id", "document_id")
