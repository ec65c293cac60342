"""Operational reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import round_even
from lexloom.operators.scope import ANY_TENANT, live, of_live_documents, tenant_is


def overview(
    documents: DataFrame, tasks: DataFrame, corrections: DataFrame, drafts: DataFrame, tenant=None
) -> DataFrame:
    """Long form (metric, name, value): totals, averages, counts by status and by type.

    Counts by status and type come from one pass over the live documents.
    """
    scope = live(documents, tenant)
    by = (
        scope.groupBy("status", "document_type")
        .agg(
            F.count("*").alias("n"),
            F.sum("document_confidence").alias("s"),
            F.count("document_confidence").alias("c"),
        )
    )

    def rows(df: DataFrame, metric: str, name: Column, value: Column) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), name.alias("name"), value.alias("value"))

    none = F.lit("")
    totals = by.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"))
    status = by.groupBy("status").agg(F.sum("n").alias("n"))
    types = (
        by.where(F.coalesce(F.col("document_type"), F.lit("")) != "")
        .groupBy("document_type")
        .agg(F.sum("n").alias("n"))
    )
    pending = of_live_documents(tasks.where(F.col("status") == "pending"), documents, tenant)
    fixed = of_live_documents(corrections, documents, tenant)
    graded = of_live_documents(drafts, documents, tenant)
    number = F.col("n").cast("double")
    return (
        rows(totals, "total_documents", none, F.coalesce(number, F.lit(0.0)))
        .unionByName(
            rows(totals, "avg_document_confidence", none, F.col("s") / F.nullif("c", F.lit(0)))
        )
        .unionByName(rows(status, "by_status", F.col("status"), number))
        .unionByName(rows(types, "by_document_type", F.col("document_type"), number))
        .unionByName(rows(pending.agg(F.count("*").alias("n")), "pending_review_tasks", none, number))
        .unionByName(rows(fixed.agg(F.count("*").alias("n")), "total_corrections", none, number))
        .unionByName(
            rows(
                graded.agg(F.avg("overall_grounding_score").alias("a")),
                "avg_draft_grounding_score", none, F.col("a"),
            )
        )
    )


def confidence_histogram(documents: DataFrame, tenant=None) -> DataFrame:
    """Five buckets, all always present; NULL confidences are not counted."""
    value = F.col("document_confidence")
    counts = []
    for name, low, high in fv.CONFIDENCE_HISTOGRAM:
        inside = value.isNotNull()
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value < high)
        counts.append(
            F.struct(F.lit(name).alias("bucket"), F.count_if(inside).alias("documents"))
        )
    return (
        live(documents, tenant)
        .agg(F.array(*counts).alias("b"))
        .select(F.inline("b"))
    )


def correction_counts(corrections: DataFrame, documents: DataFrame, tenant=None) -> DataFrame:
    """Corrections per field, and their total in the row without a field."""
    rows = of_live_documents(corrections, documents, tenant)
    return rows.rollup("field_name").agg(F.count("*").alias("corrections"))


def improvement_by_day(
    drafts: DataFrame, edits: DataFrame, documents: DataFrame | None, tenant=None, rounded: bool = False
) -> DataFrame:
    """Per day: drafts, distinct drafts edited (by day of edit) and their rate.

    With ``documents`` only rows of live documents of the tenant count; without it the second
    published form results, which looks at the rows' own tenant only and rounds to four digits.
    """
    drafts = drafts.where(tenant_is(tenant))
    edits = edits.where(tenant_is(tenant))
    if documents is not None:
        drafts = of_live_documents(drafts, documents, tenant)
        edits = of_live_documents(edits, documents, tenant)
    made = drafts.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("drafts_generated")
    )
    changed = edits.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count_distinct("draft_id").alias("drafts_edited")
    )
    return join_days(made, changed, rounded)


def join_days(made: DataFrame, changed: DataFrame, rounded: bool = False) -> DataFrame:
    """Days of either side; a day without drafts has rate 0.0."""
    both = made.join(changed, "day", "full_outer").na.fill(0, ["drafts_generated", "drafts_edited"])
    rate = F.when(
        F.col("drafts_generated") > 0, F.col("drafts_edited") / F.col("drafts_generated")
    ).otherwise(0.0)
    return both.withColumn("edit_rate", round_even(rate, 4) if rounded else rate)


def improvement_totals(drafts: DataFrame, edits: DataFrame, preferences: DataFrame, tenant=None):
    """Total drafts, edits and preferences, and edits per draft rounded to four digits."""
    d = drafts.where(tenant_is(tenant)).agg(F.count("*").alias("total_drafts"))
    e = edits.where(tenant_is(tenant)).agg(F.count("*").alias("total_edits"))
    p = preferences.where(tenant_is(tenant)).agg(F.count("*").alias("preference_count"))
    one = d.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k")
    one = one.join(p.withColumn("k", F.lit(1)), "k").drop("k")
    rate = F.when(F.col("total_drafts") > 0, F.col("total_edits") / F.col("total_drafts"))
    return one.withColumn("edit_rate", round_even(F.coalesce(rate, F.lit(0.0)), 4))


def top_preferences(preferences: DataFrame, tenant=None, n: int = 10) -> DataFrame:
    return (
        preferences.where(tenant_is(tenant))
        .orderBy(F.desc("application_count"), F.desc("confidence"), "preference_id")
        .limit(n)
    )


def most_edited_sections(edits: DataFrame, tenant=ANY_TENANT, n: int = 10) -> DataFrame:
    rows = edits if tenant is ANY_TENANT else edits.where(tenant_is(tenant))
    return (
        rows.groupBy("section_key")
        .agg(F.count("*").alias("edit_count"))
        .orderBy(F.desc("edit_count"), "section_key")
        .limit(n)
    )


def cumulative_histogram(df: DataFrame, value: str, buckets: list[float]) -> DataFrame:
    """(le, n) with a cumulative count per bucket and for all values. One partial aggregation."""
    col = F.col(value)
    edges = [F.count_if(col <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    counted = df.agg(*edges, F.count(col).alias("all"))
    pairs = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)
    ]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return counted.select(F.inline(F.array(*pairs)))


def processed_counters(documents: DataFrame) -> DataFrame:
    """Documents by status, type and tenant; no type is "unknown", no tenant is "public"."""
    return documents.groupBy(
        "status",
        F.coalesce(F.nullif("document_type", F.lit("")), F.lit("unknown")).alias("document_type"),
        F.coalesce(F.nullif("tenant_id", F.lit("")), F.lit("public")).alias("tenant_id"),
    ).agg(F.count("*").alias("documents"))


def validation_failures(results: DataFrame, keys: list[str]) -> DataFrame:
    """Invalid results per key; cross-field checks are not counted."""
    failed = ~F.col("valid") & ~F.startswith(F.col("field"), F.lit("_cross"))
    return results.groupBy(*keys).agg(F.count_if(failed).alias("failures"))


def processing_summary(documents: DataFrame, tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Audit payload of each processed document: type, confidence, open tasks, failures, latency."""
    n_tasks = tasks.groupBy("document_id").agg(F.count("*").alias("review_tasks"))
    n_failed = validation_failures(results, ["document_id"])
    return (
        documents.select("document_id", "document_type", "document_confidence", "latency_seconds")
        .join(n_tasks, "document_id", "left")
        .join(n_failed, "document_id", "left")
        .select(
            "document_id",
            "document_type",
            "document_confidence",
            F.coalesce("review_tasks", F.lit(0)).cast("long").alias("review_tasks"),
            F.coalesce("failures", F.lit(0)).cast("long").alias("validation_failures"),
            round_even("latency_seconds", 3).alias("latency_seconds"),
        )
    )


def latest_state(events: DataFrame, key: str, at: str, event: str, tie: str) -> DataFrame:
    """Last event per key by time, then id. ``max_by`` combines on the map side."""
    return events.groupBy(key).agg(
        F.max_by(event, F.struct(at, tie)).alias("state"),
        F.max(at).alias("since"),
        F.count("*").alias("events"),
    )
