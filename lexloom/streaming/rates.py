"""Daily edit rate and live document state on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_marks(events: DataFrame) -> DataFrame:
    """What each event adds to its day: (day, kind, counted). ``events``: (ts, kind draft/edit, draft_id,
    event_id). An edited draft counts once a day, every draft event counts."""
    counted = F.when(F.col("kind") == "edit", F.col("draft_id").cast("string")).otherwise(
        F.col("event_id").cast("string")
    )
    return events.select(F.to_date("ts").alias("day"), "kind", counted.alias("counted"))


def daily_edit_rate(marks: DataFrame) -> DataFrame:
    """One row per day from the stored marks of a stream (or of a table), open days included.

    Nothing is held in state and no watermark drops a row: a late event is one more mark of its day.
    """

    def distinct(kind: str) -> Column:
        return F.count_distinct(F.when(F.col("kind") == kind, F.col("counted")))

    days = marks.groupBy("day").agg(distinct("draft").alias("drafts_generated"), distinct("edit").alias("drafts_edited"))
    rate = F.when(
        F.col("drafts_generated") > 0, F.col("drafts_edited") / F.col("drafts_generated")
    ).otherwise(0.0)
    return days.withColumn("edit_rate", rate)


def live_state(events: DataFrame, key: str, at: str, event: str, tie: str) -> DataFrame:
    """Latest event per key, kept up to date; write it in update or complete mode."""
    return events.groupBy(key).agg(
        F.max_by(event, F.struct(at, tie)).alias("state"),
        F.max(at).alias("since"),
        F.count("*").alias("events"),
    )


def run_to_table(
    stream: DataFrame, out: str, checkpoint: str, mode: str = "append", snapshot: bool = False, distinct: bool = False
) -> None:
    """Work off a stream into a Parquet folder, one subfolder per batch (overwritten on redelivery).

    ``snapshot`` keeps the last batch only, for complete mode; ``distinct`` leaves out rows that a batch
    holds twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        target = f"{out}/snapshot" if snapshot else f"{out}/batch={batch_id:012d}"
        (batch.distinct() if distinct else batch).write.mode("overwrite").parquet(target)

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
