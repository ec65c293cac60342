"""Review tasks for uncertain fields, and what a reviewer's decision changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import round_even


def with_validation_reason(scored: DataFrame, results: DataFrame, key: str = "document_id"):
    """Adds the reason of the first failed check of each field."""
    reasons = (
        results.where(~F.col("valid"))
        .groupBy(key, F.col("field").alias("name"))
        .agg(F.min_by("reason", "position").alias("validation_reason"))
    )
    return scored.join(reasons, [key, "name"], "left")


def review_tasks(scored: DataFrame, key: str = "document_id") -> DataFrame:
    """One pending task per uncertain field, with deterministic ids."""
    page = F.col("page_number") if "page_number" in scored.columns else F.lit(1)
    return scored.where("requires_review").select(
        F.sha2(F.concat_ws("/", F.col(key).cast("string"), "name"), 256).alias("task_id"),
        key,
        F.col("name").alias("field_name"),
        F.col("value").alias("proposed_value"),
        F.col("value").alias("original_value"),
        "confidence",
        F.coalesce(page, F.lit(1)).alias("page_number"),
        "validation_reason",
        F.lit("pending").alias("status"),
    )


def status_after_scoring(scored: DataFrame, key: str = "document_id") -> DataFrame:
    """A document with a task needs review, any other is complete."""
    return scored.groupBy(key).agg(
        F.when(F.bool_or("requires_review"), "review_required").otherwise("completed").alias("status"),
        F.count_if("requires_review").alias("tasks"),
    )


def replace_tasks(current: DataFrame, fresh: DataFrame, documents: DataFrame, key: str = "document_id"):
    """Reprocessing drops all old tasks of the processed documents."""
    kept = current.join(documents.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh.select(*current.columns))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision per task counts."""
    last = F.struct("created_at", "decision_id")
    return decisions.groupBy("task_id").agg(
        F.max_by("corrected_value", last).alias("corrected_value"),
        F.max_by("reviewer_name", last).alias("reviewer_name"),
    )


def _packed(task_id: str) -> Column:
    """A task id for joins: one of 64 hexadecimal digits in its 32 bytes, any other as it is. Equal for equal ids only."""
    digits = F.unhex(task_id)
    exact = (F.octet_length(digits) == 32) & (F.lower(F.hex(digits)) == F.col(task_id))
    return F.when(exact, digits).otherwise(F.concat(F.lit("=").cast("binary"), F.col(task_id).cast("binary")))


def _by_packed_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("task_id", _packed("task_id"))


def _with_decisions(
    fields: DataFrame, tasks: DataFrame, decisions: DataFrame, key: str
) -> DataFrame:
    """Fields with the value decided on, each once more for each further decided task of its name."""
    decided = (
        _by_packed_id(tasks.select("task_id", key, F.col("field_name").alias("name"), "original_value"))
        .join(latest_decisions(_by_packed_id(decisions)), "task_id")
        .select(
            key, "name", F.col("corrected_value").alias("_new"), F.lit(True).alias("_decided"),
            (
                F.coalesce("corrected_value", F.lit("None"))
                != F.coalesce("original_value", F.lit("None"))
            ).alias("value_changed"),
        )
    )
    joined = fields.join(decided, [key, "name"], "left")
    hit = F.coalesce("_decided", F.lit(False))
    return joined.withColumns(
        {
            "value": F.when(hit, F.col("_new")).otherwise(F.col("value")),
            "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")),
            "requires_review": ~hit & F.col("requires_review"),
        }
    ).drop("_new", "_decided")


def apply_decisions(
    fields: DataFrame, tasks: DataFrame, decisions: DataFrame, key: str = "document_id",
    asked: Column | None = None,
) -> DataFrame:
    """Decided fields take the corrected value, confidence 1.0 and need no review.

    ``asked`` tells which fields can have a task, where the caller knows it (those that need review, as long as the
    tasks come from these very fields). The others meet no task, so they are not shuffled.
    """
    if asked is None:
        return _with_decisions(fields, tasks, decisions, key)
    may = F.coalesce(asked, F.lit(False))
    rest = fields.where(~may).withColumn("value_changed", F.lit(None).cast("boolean"))
    met = _with_decisions(fields.where(may), tasks, decisions, key)
    return met.unionByName(rest)


def documents_after_review(
    documents: DataFrame,
    fields: DataFrame,
    tasks: DataFrame,
    decisions: DataFrame,
    key: str = "document_id",
    asked: Column | None = None,
) -> DataFrame:
    """Status and confidence after the decisions.

    The confidence of a document that was decided on is the plain mean of its fields; it is
    complete once no task is pending. ``asked`` is that of ``apply_decisions``.
    """
    done = _by_packed_id(decisions.select("task_id")).distinct().withColumn("_done", F.lit(1))
    # Per field: its tasks that wait and those decided on. A decided field counts 1.0 for each of the latter.
    outcomes = (
        _by_packed_id(tasks.select("task_id", key, F.col("field_name").alias("name"), "status"))
        .join(done, "task_id", "left")
        .groupBy(key, "name")
        .agg(
            F.count_if(F.col("_done").isNull() & (F.col("status") == "pending")).cast("int").alias("_pending"),
            F.count("_done").cast("int").alias("_hits"),
        )
    )
    score, zero = F.col("confidence").cast("decimal(20,4)"), F.lit(0).cast("int")
    one = F.when(score.isNull(), 0).otherwise(1)
    may = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    rest = fields.where(~may).select(key, score.alias("_sum"), one.alias("_n"), zero.alias("_pending"), zero.alias("_hits"))
    hits = F.coalesce("_hits", zero)
    met = (
        fields.where(may).select(key, "name", score.alias("_sum"), one.alias("_n"), F.lit(True).alias("_field"))
        .join(outcomes, [key, "name"], "full")
        .select(
            key,
            F.when(F.col("_field") & (hits > 0), hits.cast("decimal(20,4)")).otherwise(F.col("_sum")).alias("_sum"),
            F.when(F.col("_field") & (hits > 0), hits).otherwise(F.coalesce("_n", zero)).alias("_n"),
            F.coalesce("_pending", zero).alias("_pending"),
            hits.alias("_hits"),
        )
    )
    means = met.unionByName(rest).groupBy(key).agg(
        (F.sum("_sum").cast("double") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"),
        F.sum("_pending").alias("pending"),
        (F.max("_hits") > 0).alias("touched"),
    )
    joined = documents.join(means, key, "left")
    touched = F.coalesce("touched", F.lit(False))
    return joined.withColumns(
        {
            "document_confidence": F.when(
                touched & F.col("mean").isNotNull(), round_even("mean", 4)
            ).otherwise(F.col("document_confidence")),
            "status": F.when(
                touched & (F.col("pending") == 0) & (F.col("status") == "review_required"),
                "completed",
            ).otherwise(F.col("status")),
        }
    ).drop("pending", "touched", "mean")
