"""Scoped reads of the document tables, and the joins between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators import postings

ANY_TENANT = object()


def tenant_is(tenant: str | None, column: str = "tenant_id") -> Column:
    """Tenant equality, in which None stands for rows without a tenant and not for all rows."""
    return F.col(column).isNull() if tenant is None else F.col(column) == tenant


def live(documents: DataFrame, tenant=ANY_TENANT) -> DataFrame:
    """Not deleted, and of the tenant."""
    rows = documents.where(F.col("deleted_at").isNull())
    return rows if tenant is ANY_TENANT else rows.where(tenant_is(tenant))


def _listed(documents: DataFrame, tenant, status: str | None, document_type: str | None):
    rows = live(documents, tenant)
    if status:
        rows = rows.where(F.col("status") == status)
    if document_type:
        rows = rows.where(F.col("document_type") == document_type)
    return rows


def count_documents(documents, tenant=None, status=None, document_type=None) -> DataFrame:
    """Total before paging."""
    return _listed(documents, tenant, status, document_type).agg(F.count("*").alias("total"))


def list_documents(
    documents: DataFrame, tenant=None, status=None, document_type=None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of ``limit`` rows, newest first."""
    rows = _listed(documents, tenant, status, document_type)
    ordered = rows.orderBy(F.desc("created_at"), "document_id")
    return ordered.offset(offset).limit(limit)


def search_documents(
    documents: DataFrame, extractions: DataFrame, query: str, tenant: str | None = None, limit: int = 20
) -> DataFrame:
    """Case-blind search in name, type and text. ``%`` and ``_`` of the query act as wildcards.

    No tenant means no tenant filter here, unlike in every other read.
    """
    like = f"%{query}%"
    rows = live(documents)
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == tenant)
    joined = rows.join(extractions.select("document_id", "ocr_text"), "document_id", "left")
    hit = (
        F.col("filename").ilike(like)
        | F.col("document_type").ilike(like)
        | F.col("ocr_text").ilike(like)
    )
    return joined.where(hit).orderBy(F.desc("created_at"), "document_id").limit(limit)


SEARCHED = ["filename", "document_type", "ocr_text"]


def search_index(documents: DataFrame, extractions: DataFrame, folder: str) -> None:
    """Posting lists over name, type and text of all documents, deleted ones included."""
    joined = documents.join(extractions.select("document_id", "ocr_text"), "document_id", "left")
    postings.write_index(joined, SEARCHED, folder)


def search_many(
    documents: DataFrame, extractions: DataFrame, queries: DataFrame, folder: str, tenant: str | None = None, limit: int = 20
) -> DataFrame:
    """``search_documents`` for many queries (query_id, query) over the lists in ``folder``, with the rank in each."""
    rows = live(documents)
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == tenant)
    joined = rows.join(extractions.select("document_id", "ocr_text"), "document_id", "left")
    found = postings.search(documents.sparkSession, folder, joined, SEARCHED, queries)
    newest = Window.partitionBy("query_id").orderBy(F.desc("created_at"), "document_id")
    ranked = found.join(rows.select("document_id", "created_at"), "document_id").withColumn("rank", F.row_number().over(newest))
    return ranked.where(F.col("rank") <= limit).select("query_id", "document_id", "rank")


def review_fields(extractions: DataFrame) -> DataFrame:
    """Detail view: the fields of each document that need review."""
    return extractions.select(
        "document_id",
        F.filter("field_confidences", lambda f: f["requires_review"]).alias("low_confidence_fields"),
    )


def document_history(audit: DataFrame, documents: DataFrame, tenant=None) -> DataFrame:
    """Audit rows of the documents in scope."""
    return audit.join(live(documents, tenant).select("document_id"), "document_id", "left_semi")


def soft_delete(documents: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows stay; ``deleted_at`` comes from the tombstones (document_id, deleted_at)."""
    marks = tombstones.groupBy("document_id").agg(F.min("deleted_at").alias("_gone"))
    joined = documents.join(marks, "document_id", "left")
    return joined.withColumn("deleted_at", F.coalesce("deleted_at", "_gone")).drop("_gone")


def with_extraction(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    return documents.join(extractions, "document_id", "left")


def of_live_documents(rows: DataFrame, documents: DataFrame, tenant=ANY_TENANT) -> DataFrame:
    """Tasks, corrections, drafts or edits whose document is in scope, with nothing added."""
    return rows.join(live(documents, tenant).select("document_id"), "document_id", "left_semi")


def pending_tasks(tasks: DataFrame, documents: DataFrame, tenant=None) -> DataFrame:
    """Open review tasks, oldest first."""
    rows = tasks.where(F.col("status") == "pending")
    return of_live_documents(rows, documents, tenant).orderBy("created_at", "task_id")


def hook_worklist(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """One row per event and active hook on it. Spark broadcasts the hooks while they are small."""
    active = hooks.where(F.col("status") == "active").select("hook_id", "url", "event")
    return events.join(active, "event")


def failed_deliveries(
    failed: DataFrame, event: str | None = None, replayed: bool | None = None, limit: int = 100
) -> DataFrame:
    rows = failed
    if event:
        rows = rows.where(F.col("event") == event)
    if replayed is not None:
        rows = rows.where(F.col("replayed") == replayed)
    return rows.orderBy(F.desc("created_at"), "failed_id").limit(limit)


def delete_in_scope(preferences: DataFrame, ids: DataFrame, tenant=None) -> DataFrame:
    """Hard delete of the listed preferences, only inside the tenant."""
    doomed = preferences.where(tenant_is(tenant)).join(ids, "preference_id", "left_semi")
    return preferences.join(doomed.select("preference_id"), "preference_id", "left_anti")


def requeue(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of an id list, set to queued for another run."""
    rows = documents.join(ids.select("document_id").distinct(), "document_id", "left_semi")
    return rows.withColumn("status", F.lit("queued"))


def read_payload(extractions: DataFrame, documents: DataFrame, tenant=None) -> DataFrame:
    """Export payloads of the documents in scope."""
    return of_live_documents(extractions, documents, tenant)
