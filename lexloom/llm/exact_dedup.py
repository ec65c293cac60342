"""Exact dedup with skew-safe combining.

Texts are equal when they agree after all ASCII white space is deleted. Of equal texts the row with
the most code points stays, then the smallest doc_id. Three stages, each of which compares full
contents under a digest:

1. every map task combines the equal texts of a batch: one leader carries the content, the others
   only point to it;
2. the rows meet by (digest, salt) and are combined in a stream sorted best row first. Only digests
   with a thousandth of all rows or more are salted, so there are never over a thousand of them;
3. the winners of the salts, at most ``salts`` for each hot content, are combined globally.

Null texts count as empty. Null ids sort last. Rows repeated with the same id are separate rows, of
which one may stay. Extra columns are ignored by ``exact_groups`` and kept by ``without_copies``.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.common import slices
from lexloom.session import cut_lineage

_SPACE = b" \t\n\x0b\x0c\r"
_LOCAL = "doc_id long, chars long, digest string, part int, row long, leader long, content binary"
_FOUND = "doc_id long, digest string, hot boolean, row long, head long, head_id long, head_chars long, content binary"


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, _SPACE)


def _digests(batches):
    for batch in batches:
        texts = batch.column(0)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array([hashlib.sha256(_normal(t.as_py())).hexdigest() for t in texts], pa.string())}
        )


def _local(batches):
    part = TaskContext.get().partitionId()
    row = part << 33
    for batch in slices(batches, limit=32 << 20):
        ids = batch.column(0).to_pylist()
        out, leaders = [], {}
        for i, text in enumerate(batch.column(1)):
            text = text.as_py() or ""
            content = _normal(text)
            digest = hashlib.sha256(content).hexdigest()
            mine = [ids[i], len(text), digest, part, row, row, content]
            row += 1
            out.append(mine)
            for k, other in enumerate(same := leaders.setdefault(digest, [])):
                if other[6] == content:
                    if _better(mine, other):
                        same[k] = mine
                    break
            else:
                same.append(mine)
        for mine in out:
            if not any(mine is x for x in leaders[mine[2]]):
                mine[5] = next(x[4] for x in leaders[mine[2]] if x[6] == mine[6])
        for mine in out:
            if mine[5] != mine[4]:
                mine[6] = None
        columns = zip(*out)
        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in _LOCAL.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _better(a, b) -> bool:
    key = lambda x: (-x[1], x[0] is None, x[0] or 0, x[4])
    return key(a) < key(b)


def _combine(batches):
    """Rows come by digest and salt, best first: the first of each content is its head."""
    run, contents, heads = None, [], {}
    types = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _FOUND.split(", ")]
    for batch in batches:
        ids, chars, digests, rows, leaders, salts = (
            batch.column(k).to_pylist() for k in ("doc_id", "chars", "digest", "row", "leader", "salt")
        )
        content = batch.column("content")
        out = []
        for i, digest in enumerate(digests):
            hot = salts[i] >= 0
            if run != (digest, salts[i]):
                run, contents, heads = (digest, salts[i]), [], {}
            kept = None
            if leaders[i] != rows[i]:
                head = heads[leaders[i]]
            else:
                mine = content[i].as_py()
                head = next((h for c, h in contents if c == mine), None)
                if head is None:
                    head = (rows[i], ids[i], chars[i])
                    contents.append((mine, head))
                    kept = mine if hot else None
                heads[rows[i]] = head
            out.append((ids[i], digest, hot, rows[i], *head, kept))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def exact_groups(docs: DataFrame, salts: int = 64, hot_rows: int = 1000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Contents with at least ``hot_rows`` rows, and a thousandth of all, are salted.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    least = max(hot_rows, texts.count() // 1000)
    hot = (
        texts.select("text").mapInArrow(_digests, "digest string")
        .groupBy("digest").count().filter(F.col("count") >= least).select("digest", F.lit(True).alias("hot"))
    )
    salt = F.when(F.col("hot"), F.pmod("part", F.lit(salts))).otherwise(-1)
    found = cut_lineage(
        texts.mapInArrow(_local, _LOCAL)
        .join(F.broadcast(hot), "digest", "left")  # at most a thousand rows, see ``least``
        .withColumn("salt", salt)
        .repartition("digest", "salt")
        .sortWithinPartitions("digest", "salt", F.desc("chars"), F.asc_nulls_last("doc_id"), "row")
        .select("doc_id", "chars", "digest", "row", "leader", "salt", "content")
        .mapInArrow(_combine, _FOUND)
    )
    sizes = found.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    cold = (
        found.filter(~F.col("hot")).join(sizes, "head")
        .select("doc_id", F.col("head_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("head")).alias("kept"), "digest")
    )
    best_first = Window.partitionBy("digest", "content").orderBy(F.desc("head_chars"), F.asc_nulls_last("head_id"), "head")
    whole = Window.partitionBy("digest", "content")
    winners = (
        found.filter(F.col("hot") & F.col("content").isNotNull())
        .select("digest", "content", "head", "head_id", "head_chars")
        .join(sizes, "head")
        .select(
            "head",
            F.first("head").over(best_first).alias("last_head"),
            F.first("head_id").over(best_first).alias("keep_id"),
            F.sum("n").over(whole).alias("group_size"),
        )
    )
    warm = (
        found.filter("hot").join(F.broadcast(winners), "head")  # at most ``salts`` rows for each hot content
        .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("last_head")).alias("kept"), "digest")
    )
    return cold.unionByName(warm).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names."""
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest"))
    normal = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", "")
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col("doc_id").alias("id"),
        F.sha2(normal, 256).alias("digest"),
        F.coalesce(F.char_length("text"), F.lit(0)).alias("n"),
    )
    twice = Window.partitionBy("digest", "id").orderBy(F.desc("n"))
    both = rows.join(kept, (F.col("digest") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("kept_id")))
    return both.withColumn("first", F.row_number().over(twice)).filter("first = 1").select("row.*")
