"""Incremental ingestion: new documents are classified, read, cut into chunks and stored.

Every micro-batch writes below its own batch number and overwrites it when it is delivered again,
so a retry leaves no second copy. Readers see the latest version of each document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.chunks import chunk_documents
from lexloom.operators.classify import classify
from lexloom.operators.extract import extract_fields

TABLES = ("documents", "chunks", "quarantine")


def read_stream(
    spark: SparkSession, path: str, schema, files_per_trigger: int = 1000, source: str = "parquet"
) -> DataFrame:
    """Files of a drop folder as a stream."""
    return (
        spark.readStream.format(source)
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )


def split_unreadable(documents: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows without an id or with no text at all go to quarantine with a reason."""
    reason = F.when(F.col("document_id").isNull(), "no document id").when(
        F.coalesce(F.btrim(F.col(text)), F.lit("")) == "", "no text"
    )
    marked = documents.withColumn("error", reason)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def latest_in_batch(batch: DataFrame, key: str = "document_id", version: str = "version") -> DataFrame:
    """One row per document: the highest version."""
    order = Window.partitionBy(key).orderBy(F.desc(version))
    return batch.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def store_batch(out: str) -> Callable[[DataFrame, int], None]:
    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # three tables are written from it
        try:
            good, bad = split_unreadable(batch)
            rows = latest_in_batch(good)
            typed = extract_fields(classify(rows))
            folder = f"batch={batch_id:012d}"
            typed.drop("text").write.mode("overwrite").parquet(f"{out}/documents/{folder}")
            chunk_documents(rows, "document_id", keep=["version"]).write.mode("overwrite").parquet(
                f"{out}/chunks/{folder}"
            )
            bad.write.mode("overwrite").parquet(f"{out}/quarantine/{folder}")
        finally:
            batch.unpersist()

    return store


def start_ingestion(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """``stream`` has (document_id, version, text). ``once`` works off what is there and stops."""
    writer = stream.writeStream.foreachBatch(store_batch(out)).option(
        "checkpointLocation", checkpoint
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """Latest version of each document over all batches."""
    rows = spark.read.parquet(f"{out}/documents")
    order = Window.partitionBy("document_id").orderBy(F.desc("version"), F.desc("batch"))
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "batch")


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of the latest version of each document.

    Versions are reduced per document first; the chunks then meet them in a semi join, which AQE
    splits when one document is huge.
    """
    rows = spark.read.parquet(f"{out}/chunks")
    top = rows.groupBy("document_id").agg(F.max(F.struct("version", "batch")).alias("v"))
    keys = top.select("document_id", "v.version", "v.batch")
    return rows.join(keys, ["document_id", "version", "batch"], "left_semi").drop("batch")


def failed_attempts(
    attempts: DataFrame, key: str = "event_id", limit: int = 3
) -> DataFrame:
    """Deliveries that used up their attempts without success, with the last error."""
    last = F.struct("attempt_at", "attempt_no")
    per = attempts.groupBy(key).agg(
        F.count("*").alias("attempts"),
        F.bool_or("success").alias("ok"),
        F.max_by("error", last).alias("error"),
    )
    return per.where(~F.col("ok") & (F.col("attempts") >= limit)).select(
        key, "attempts", "error", F.lit(False).alias("replayed")
    )
