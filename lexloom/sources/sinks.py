"""Sinks: exports, chunk replacement, audit append, text files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_exports(payloads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Export payloads as JSON below one folder per document type. Any Hadoop URI works."""
    typed = payloads.withColumn("document_type", F.coalesce("document_type", F.lit("unknown")))
    typed.write.mode(mode).partitionBy("document_type").json(path)


def append_audit(events: DataFrame, path: str) -> None:
    """Append-only event log, one folder per day."""
    events.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(
        path
    )


def write_chunks(chunks: DataFrame, path: str, buckets: int = 1024, spread: int = 8) -> None:
    """Chunk table in folders by a hash of the document, each written by up to ``spread`` tasks,
    so that one huge document does not fall to a single task.

    With dynamic overwrite a re-embedded document rewrites its own folder only; pass the rows of
    the whole folder (old ones through ``replace_chunks``).
    """
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets))
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(spread))
    (
        chunks.withColumn("bucket", bucket)
        .repartition(F.col("bucket"), salt)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


#: What the folder of a partition column may not hold as it is, and the folder of null and empty values.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _text_writer(path: str, by: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        task, made, n = TaskContext.get(), set(), 0
        for batch in batches:
            for value, text in zip(batch.column(by), batch.column("text")):
                name = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value.as_py() or "") or _NO_VALUE
                folder = f"{root}/{by}={name}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                # A repeated task gives its files the same names; other attempts' unfinished ones have no suffix of a text.
                whole = f"{folder}/part-{task.partitionId():05d}-{n:07d}"
                with store.open_output_stream(draft := f"{whole}.{task.taskAttemptId()}", compression=None) as out:
                    out.write(text.as_buffer() or b"")
                    out.write(b"\n")
                store.move(draft, f"{whole}.txt")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    return run


def write_texts(texts: DataFrame, path: str, by: str) -> None:
    """A text file for each row of (``by``, text), ended by a line break, in one folder per value of ``by``.

    On local and mounted paths tasks write them themselves: there Spark's writer starts two processes for each
    file, to set the modes of the file and of its checksums. Other stores are left to Spark's writer, whose
    tasks move their own files into place, so that the driver does not move all of them one by one.
    """
    rows = texts.select(F.col(by).cast("string").alias(by), F.coalesce("text", F.lit("")).alias("text"))
    if urlsplit(path).scheme in ("", "file"):
        raw = rows.withColumn("text", F.col("text").cast("binary"))
        raw.mapInArrow(_text_writer(path, by), "files long").agg(F.sum("files")).collect()
        return
    writer = rows.withColumnRenamed("text", "value").write.partitionBy(by).option("maxRecordsPerFile", 1)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
