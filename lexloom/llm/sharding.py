"""Sharding of indivisible groups by Karmarkar-Karp differencing, for shards of near equal bytes.

A partial partition is a list of bins. The two with the largest spread between fullest and emptiest
bin are combined again and again, oppositely ordered: the fullest bin of one joins the emptiest of
the other. Groups are sums of equal texts (null counts as empty), formed with map-side combine, and
differencing runs in two levels:

1. each task differences its own groups, ``block`` at a time. Groups are dealt by a hash of their key
   into four grades of about 7/8, 7/64, 7/512 and the rest, each of which becomes ``shards`` bins;
2. the bins of all tasks, 4 x ``shards`` sums for each block, and the groups over 1/64 of a shard, of
   which there are at most 64 x ``shards``, are differenced on the driver. The small grades fill
   what a large group leaves uneven. No texts, keys or documents get there, but for large groups.

Repeated rows and null ids are rows like others; extra columns are ignored. An empty table has no
rows in any shard.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.session import cut_lineage

_GRADES = 4
_BINS = "key string, unit long, bin int, bytes long"


def differenced(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item."""
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        a = a + [(0, None)] * (shards - len(a))
        b = [(0, None)] * (shards - len(b)) + b[::-1]
        both = [
            (x + y, (p, q) if p is not None and q is not None else q if p is None else p)
            for (x, p), (y, q) in zip(a, b)
        ]
        both = sorted((e for e in both if e[1] is not None), key=lambda e: -e[0])
        low = both[-1][0] if len(both) == shards else 0
        heapq.heappush(heap, (low - both[0][0], serial, both))
        serial += 1
    shard = [0] * len(sizes)
    for number, (_, tree) in enumerate(heap[0][2] if heap else ()):
        open_ = [tree]
        while open_:
            node = open_.pop()
            if isinstance(node, tuple):
                open_.extend(node)
            else:
                shard[node] = number
    return shard


def _grade(key: str) -> int:
    code, grade = zlib.crc32(key.encode()), 0
    while grade < _GRADES - 1 and code & 7 == 0:
        code, grade = code >> 3, grade + 1
    return grade


def _bins(shards: int, block: int):
    def run(batches):
        unit = TaskContext.get().partitionId() << 24
        grades: list[list] = [[] for _ in range(_GRADES)]

        def close(rows):
            if rows:
                keys, sizes = zip(*rows)
                bins = differenced(list(sizes), shards)
                arrays = [keys, [unit] * len(keys), bins, sizes]
                types = [pa.string(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(arrays, types)], names=["key", "unit", "bin", "bytes"])

        for batch in batches:
            for key, size in zip(batch.column("key").to_pylist(), batch.column("bytes").to_pylist()):
                rows = grades[_grade(key)]
                rows.append((key, size))
                if len(rows) >= block:
                    yield from close(rows)
                    unit += 1
                    rows.clear()
        for rows in grades:
            yield from close(rows)
            unit += 1

    return run


def sharded(docs: DataFrame, shards: int = 16, block: int = 200_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot (gapless in a shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("key"),
        )
    )
    groups = cut_lineage(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    large = max(1, total // (shards * 64))
    small = cut_lineage(groups.filter(F.col("bytes") <= large).mapInArrow(_bins(shards, block), _BINS))
    big = groups.filter(F.col("bytes") > large)
    sums = small.groupBy("unit", "bin").agg(F.sum("bytes").alias("bytes")).collect()
    alone = big.collect()
    shard = differenced([r.bytes for r in sums] + [r.bytes for r in alone], shards)
    by_bin = spark.createDataFrame(
        [(r.unit, r.bin, s) for r, s in zip(sums, shard)], "unit long, bin int, shard int"
    )
    by_key = spark.createDataFrame([(r.key, s) for r, s in zip(alone, shard[len(sums) :])], "key string, shard int")
    chosen = small.join(F.broadcast(by_bin), ["unit", "bin"]).select("key", "shard")
    by_key = F.broadcast(by_key)  # rows of large groups stay where they are
    found = rows.join(by_key, "key", "left_anti").join(chosen, "key").unionByName(rows.join(by_key, "key"))
    placed = cut_lineage(
        found.drop("key")
        .sortWithinPartitions("shard", "doc_id").withColumn("at", F.monotonically_increasing_id())
    )
    # A task numbers its rows of a shard one after the other: with the counts of the tasks before it,
    # a table of tasks x shards rows, these become slots.
    task = F.shiftrightunsigned("at", 33)
    counts = placed.groupBy(task.alias("task"), "shard").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return placed.withColumn("task", task).join(F.broadcast(bases), ["task", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("base")).alias("slot")
    )
