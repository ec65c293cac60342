"""Queries: scoped reads, joins and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.operators import analytics, preferences, scope
from lexloom.plans.registry import query
from lexloom.session import shared_folder


def _text_time(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


@query(
    "S6 J2", ("docs",),
    """SELECT document_id, status, document_confidence FROM docs
       WHERE deleted_at IS NULL AND tenant_id = 'BUILDING'""",
)
def scoped_scan(t):
    return scope.live(t.docs, "BUILDING").select("document_id", "status", "document_confidence")


@query(
    "S6", ("docs",),
    "SELECT document_id, status FROM docs WHERE deleted_at IS NULL AND tenant_id IS NULL",
)
def scoped_scan_without_tenant(t):
    return scope.live(t.docs, None).select("document_id", "status")


@query(
    "F1", ("docs",),
    """SELECT document_id, filename, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
       FROM docs WHERE deleted_at IS NULL AND tenant_id = 'MACHINERY' AND status = 'completed'
       ORDER BY docs.created_at DESC, document_id LIMIT 50 OFFSET 100""",
)
def document_page(t):
    page = scope.list_documents(t.docs, "MACHINERY", "completed", limit=50, offset=100)
    return _text_time(page.select("document_id", "filename", "created_at"), "created_at")


@query(
    "F1", ("docs",),
    """SELECT count(*) AS total FROM docs WHERE deleted_at IS NULL AND tenant_id = 'MACHINERY'
       AND document_type = 'contract'""",
)
def document_total(t):
    return scope.count_documents(t.docs, "MACHINERY", document_type="contract")


@query(
    "F2 J1", ("docs", "extractions"),
    """SELECT d.document_id, filename FROM docs d LEFT JOIN extractions e
       ON d.document_id = e.document_id
       WHERE deleted_at IS NULL AND (filename ILIKE '%tion_the%' OR document_type ILIKE '%tion_the%'
             OR ocr_text ILIKE '%tion_the%')
       ORDER BY created_at DESC, d.document_id LIMIT 20""",
)
def keyword_search(t):
    found = scope.search_documents(t.docs, t.extractions, "tion_the")
    return found.select("document_id", "filename")


_SEARCHES = [
    "tion_the", "THE", "th", "a", "%", "", "_e_", "und%der", "zzzz", "contract", "affidavit", "e%t%h", "100%", "ü", "ÜB",
    "é%s", "la ", "MACH", "with the%and the", "ein_", "\\%", "doc",
]


@query(
    "F2", ("docs", "extractions"),
    f"""WITH q AS (SELECT unnest([{', '.join("'" + q + "'" for q in _SEARCHES)}]) AS q),
         f AS (SELECT q, d.document_id, row_number() OVER (PARTITION BY q ORDER BY created_at DESC, d.document_id) AS rank
           FROM q, docs d LEFT JOIN extractions e ON d.document_id = e.document_id
           WHERE deleted_at IS NULL AND (filename ILIKE concat('%', q, '%') ESCAPE '\\' OR document_type ILIKE concat('%', q, '%') ESCAPE '\\'
             OR ocr_text ILIKE concat('%', q, '%') ESCAPE '\\'))
       SELECT q AS query_id, document_id, rank FROM f WHERE rank <= 20""",
)
def indexed_keyword_search(t):
    """Many patterns at once, with wildcards, short and non-ASCII ones, over trigram posting lists."""
    folder = shared_folder(t.spark, "postings")
    texts = t.spread("extractions")
    docs = t.spread("docs")
    scope.search_index(docs, texts, folder)
    queries = t.spark.createDataFrame([(q, q) for q in _SEARCHES], "query_id string, query string")
    found = scope.search_many(docs, texts, queries, folder)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(
    "F3 J1 S10", ("docs", "extractions"),
    """SELECT d.document_id, status, CAST(length(ocr_text) AS BIGINT) AS text_length
       FROM docs d LEFT JOIN extractions e ON d.document_id = e.document_id
       WHERE deleted_at IS NULL AND tenant_id = 'FURNITURE'""",
)
def document_detail(t):
    rows = scope.with_extraction(scope.live(t.docs, "FURNITURE"), t.extractions)
    return rows.select(
        "document_id", "status", F.length("ocr_text").cast("long").alias("text_length")
    )


@query(
    "F3", ("docs",),
    """SELECT event_id, CAST(user_id AS VARCHAR) AS document_id, event_type
       FROM events JOIN docs ON document_id = CAST(user_id AS VARCHAR)
       WHERE deleted_at IS NULL AND tenant_id = 'BUILDING'""",
)
def document_history(t):
    audit = t.events.withColumn("document_id", F.col("user_id").cast("string"))
    rows = scope.document_history(audit, t.docs, "BUILDING")
    return rows.select("event_id", "document_id", "event_type")


@query(
    "S10", ("docs", "extractions"),
    """SELECT e.document_id, sha256(ocr_text) AS digest FROM extractions e JOIN docs d
       ON e.document_id = d.document_id WHERE deleted_at IS NULL AND tenant_id = 'AUTOMOBILE'""",
)
def export_read(t):
    rows = scope.read_payload(t.extractions, t.docs, "AUTOMOBILE")
    return rows.select("document_id", F.sha2("ocr_text", 256).alias("digest"))


@query(
    "F4", ("docs",),
    """SELECT document_id,
         strftime(coalesce(deleted_at, gone), '%Y-%m-%d %H:%M:%S') AS deleted_at
       FROM docs LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS k, min(l_shipdate) AS gone
         FROM lineitem WHERE l_quantity = 50 GROUP BY 1) ON k = document_id""",
)
def soft_deleted(t):
    marks = t.lineitem.where("l_quantity = 50").select(
        F.col("l_orderkey").cast("string").alias("document_id"),
        F.col("l_shipdate").alias("deleted_at"),
    )
    rows = scope.soft_delete(t.docs, marks).select("document_id", "deleted_at")
    return _text_time(rows, "deleted_at")


@query(
    "F7 J2", ("docs", "tasks"),
    """SELECT task_id, t.document_id, field_name FROM tasks t JOIN docs d
       ON t.document_id = d.document_id
       WHERE t.status = 'pending' AND deleted_at IS NULL AND tenant_id = 'BUILDING'""",
)
def pending_review(t):
    return scope.pending_tasks(t.tasks, t.docs, "BUILDING").select(
        "task_id", "document_id", "field_name"
    )


@query(
    "F8", ("failed",),
    """SELECT failed_id, event, payload FROM failed WHERE event = 'processing.failed'
       AND NOT replayed ORDER BY created_at DESC, failed_id LIMIT 100""",
)
def failed_delivery_list(t):
    rows = scope.failed_deliveries(t.failed, "processing.failed", False)
    return rows.select("failed_id", "event", "payload")


@query(
    "F10", ("preferences",),
    """SELECT preference_id FROM preferences WHERE NOT coalesce(tenant_id = 'tenant-2', false)
       OR preference_id NOT IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem
                                WHERE l_quantity = 1)""",
)
def deleted_preferences(t):
    doomed = t.lineitem.where("l_quantity = 1").select(
        F.col("l_partkey").cast("string").alias("preference_id")
    )
    return scope.delete_in_scope(t.preferences, doomed, "tenant-2").select("preference_id")


@query(
    "J5", ("hooks",),
    """SELECT hook_id, count(*) AS deliveries, CAST(sum(event_id) AS BIGINT) AS id_sum
       FROM events JOIN hooks ON event_type = event WHERE status = 'active' GROUP BY 1""",
)
def hook_worklist(t):
    sent = t.events.select(F.col("event_type").alias("event"), "event_id")
    return (
        scope.hook_worklist(sent, t.hooks)
        .groupBy("hook_id")
        .agg(F.count("*").alias("deliveries"), F.sum("event_id").alias("id_sum"))
    )


@query(
    "S12", ("docs",),
    """SELECT document_id, 'queued' AS status FROM docs WHERE document_id IN
       (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_quantity >= 49)""",
)
def requeued_documents(t):
    ids = t.lineitem.where("l_quantity >= 49").select(
        F.col("l_orderkey").cast("string").alias("document_id")
    )
    return scope.requeue(t.docs, ids).select("document_id", "status")


_SCOPED = "deleted_at IS NULL AND tenant_id = 'BUILDING'"


@query(
    "A1 J2", ("docs", "tasks", "corrections", "drafts"),
    f"""WITH s AS (SELECT * FROM docs WHERE {_SCOPED})
        SELECT 'total_documents' AS metric, '' AS name, CAST(count(*) AS DOUBLE) AS value FROM s
        UNION ALL SELECT 'avg_document_confidence', '',
          CAST(printf('%.6f', avg(document_confidence)) AS DOUBLE) FROM s
        UNION ALL SELECT 'by_status', status, CAST(count(*) AS DOUBLE) FROM s GROUP BY status
        UNION ALL SELECT 'by_document_type', document_type, CAST(count(*) AS DOUBLE) FROM s
          WHERE document_type <> '' GROUP BY document_type
        UNION ALL SELECT 'pending_review_tasks', '', CAST(count(*) AS DOUBLE) FROM tasks t JOIN s
          ON t.document_id = s.document_id WHERE t.status = 'pending'
        UNION ALL SELECT 'total_corrections', '', CAST(count(*) AS DOUBLE) FROM corrections c JOIN s
          ON c.document_id = s.document_id
        UNION ALL SELECT 'avg_draft_grounding_score', '',
          CAST(printf('%.6f', avg(overall_grounding_score)) AS DOUBLE)
          FROM drafts f JOIN s ON f.document_id = s.document_id""",
)
def overview_metrics(t):
    from lexloom.functions.text import round_even

    rows = analytics.overview(t.docs, t.tasks, t.corrections, t.drafts, "BUILDING")
    return rows.withColumn("value", round_even("value", 6))


@query(
    "A2", ("docs",),
    f"""SELECT b.bucket, count(d.document_id) AS documents FROM
        (VALUES ('0-20%', -1.0, 0.2), ('20-40%', 0.2, 0.4), ('40-60%', 0.4, 0.6),
                ('60-80%', 0.6, 0.8), ('80-100%', 0.8, 9.0)) b(bucket, low, high)
        LEFT JOIN (SELECT * FROM docs WHERE {_SCOPED}) d
        ON document_confidence >= CAST(low AS DOUBLE) AND document_confidence < CAST(high AS DOUBLE)
        GROUP BY 1""",
)
def confidence_histogram(t):
    return analytics.confidence_histogram(t.docs, "BUILDING")


@query(
    "A3", ("docs", "corrections"),
    f"""SELECT field_name, count(*) AS corrections FROM corrections c JOIN docs d
        ON c.document_id = d.document_id WHERE {_SCOPED} GROUP BY ROLLUP (field_name)""",
)
def correction_counts(t):
    return analytics.correction_counts(t.corrections, t.docs, "BUILDING")


_DAYS = """
    SELECT coalesce(m.day, e.day) AS day, coalesce(n, 0) AS drafts_generated,
           coalesce(k, 0) AS drafts_edited, {rate} AS edit_rate
    FROM (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM made GROUP BY 1) m
    FULL JOIN (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(DISTINCT draft_id) AS k
               FROM changed GROUP BY 1) e ON m.day = e.day"""


@query(
    "A4 J8", ("docs", "drafts", "edits"),
    """WITH live AS (SELECT document_id FROM docs WHERE deleted_at IS NULL
                     AND tenant_id = 'MACHINERY'),
       made AS (SELECT * FROM drafts WHERE tenant_id = 'MACHINERY'
                AND document_id IN (SELECT document_id FROM live)),
       changed AS (SELECT * FROM edits WHERE tenant_id = 'MACHINERY'
                AND document_id IN (SELECT document_id FROM live))"""
    + _DAYS.format(
        rate="CASE WHEN n > 0 THEN CAST(coalesce(k, 0) AS DOUBLE) / CAST(n AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    ),
)
def draft_improvement(t):
    rows = analytics.improvement_by_day(t.drafts, t.edits, t.docs, "MACHINERY")
    return rows.withColumn("day", F.col("day").cast("string"))


@query(
    "A5 J8", ("drafts", "edits"),
    """WITH made AS (SELECT * FROM drafts WHERE tenant_id IS NULL),
       changed AS (SELECT * FROM edits WHERE tenant_id IS NULL)"""
    + _DAYS.format(
        rate="CASE WHEN n > 0 THEN CAST(printf('%.4f', CAST(coalesce(k, 0) AS DOUBLE) / "
        "CAST(n AS DOUBLE)) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    ),
)
def draft_improvement_by_own_tenant(t):
    rows = analytics.improvement_by_day(t.drafts, t.edits, None, None, rounded=True)
    return rows.withColumn("day", F.col("day").cast("string"))


@query(
    "A5 A4", ("drafts", "edits", "preferences"),
    """SELECT (SELECT count(*) FROM drafts WHERE tenant_id IS NULL) AS total_drafts,
              (SELECT count(*) FROM edits WHERE tenant_id IS NULL) AS total_edits,
              (SELECT count(*) FROM preferences WHERE tenant_id IS NULL) AS preference_count,
              CAST(printf('%.4f', (SELECT count(*) FROM edits WHERE tenant_id IS NULL)::DOUBLE /
                (SELECT count(*) FROM drafts WHERE tenant_id IS NULL)::DOUBLE) AS DOUBLE)
                AS edit_rate""",
)
def draft_improvement_totals(t):
    return analytics.improvement_totals(t.drafts, t.edits, t.preferences, None)


@query(
    "K3 A4", ("preferences",),
    """SELECT preference_text, application_count, effectiveness_score FROM preferences
       WHERE tenant_id = 'tenant-3'
       ORDER BY application_count DESC, confidence DESC, preference_id LIMIT 10""",
)
def top_preferences(t):
    return analytics.top_preferences(t.preferences, "tenant-3").select(
        "preference_text", "application_count", "effectiveness_score"
    )


@query(
    "K3 A4", ("edits",),
    """SELECT section_key, count(*) AS edit_count FROM edits WHERE tenant_id = 'FURNITURE'
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def most_edited_sections(t):
    return analytics.most_edited_sections(t.edits, "FURNITURE")


_LE = ", ".join(f"({b})" for b in fv.DOCUMENT_CONFIDENCE_BUCKETS)


@query(
    "A6", ("docs",),
    f"""SELECT CAST(CAST(b AS DOUBLE) AS VARCHAR) AS le,
               count(CASE WHEN document_confidence <= CAST(b AS DOUBLE) THEN 1 END) AS n
        FROM docs CROSS JOIN (VALUES {_LE}) v(b) GROUP BY 1
        UNION ALL SELECT '+Inf', count(document_confidence) FROM docs""",
)
def confidence_cumulative(t):
    return analytics.cumulative_histogram(
        t.docs, "document_confidence", fv.DOCUMENT_CONFIDENCE_BUCKETS
    )


_LAT = ", ".join(f"({b})" for b in fv.LATENCY_BUCKETS)


@query(
    "A6", ("docs",),
    f"""SELECT CAST(CAST(b AS DOUBLE) AS VARCHAR) AS le,
               count(CASE WHEN latency_seconds <= CAST(b AS DOUBLE) THEN 1 END) AS n
        FROM docs CROSS JOIN (VALUES {_LAT}) v(b) GROUP BY 1
        UNION ALL SELECT '+Inf', count(latency_seconds) FROM docs""",
)
def latency_cumulative(t):
    return analytics.cumulative_histogram(t.docs, "latency_seconds", fv.LATENCY_BUCKETS)


@query(
    "A6", ("docs",),
    """SELECT status, coalesce(document_type, 'unknown') AS document_type,
              coalesce(tenant_id, 'public') AS tenant_id, count(*) AS documents
       FROM docs GROUP BY 1, 2, 3""",
)
def processed_counters(t):
    return analytics.processed_counters(t.docs)


@query(
    "W7 Z6", (),
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS state,
              strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS since, count(*) AS events
       FROM events GROUP BY 1""",
)
def latest_state(t):
    rows = analytics.latest_state(t.events, "user_id", "ts", "event_type", "event_id")
    return _text_time(rows, "since")


@query(
    "K1", ("preferences",),
    """SELECT preference_id, CAST(rank AS BIGINT) AS rank FROM (
         SELECT preference_id, row_number() OVER (PARTITION BY tenant_id, document_type
           ORDER BY application_count * CAST(0.6 AS DOUBLE) + confidence * CAST(0.4 AS DOUBLE) DESC,
                    preference_id) AS rank
         FROM preferences) WHERE rank <= 5""",
)
def best_preferences(t):
    rows = preferences.best_preferences(t.preferences)
    return rows.select("preference_id", F.col("rank").cast("long").alias("rank"))


@query(
    "K4", ("edits",),
    """SELECT edit_id, CAST(row_number() OVER (PARTITION BY document_id
       ORDER BY created_at DESC, edit_id) AS BIGINT) AS place FROM edits""",
)
def newest_first(t):
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy(F.desc("created_at"), "edit_id")
    return t.edits.select("edit_id", F.row_number().over(order).cast("long").alias("place"))


@query(
    "K4", ("edits",),
    """SELECT edit_id AS draft_id, created_at::VARCHAR AS created_at FROM edits WHERE document_id = '7'""",
)
def drafts_of_one_document(t):
    from lexloom.operators import drafts

    rows = drafts.drafts_of_document(t.edits.drop("draft_id").withColumnRenamed("edit_id", "draft_id"), "7")
    return rows.select("draft_id", F.col("created_at").cast("string").alias("created_at"))


_WORD_LE = ", ".join(f"({b})" for b in fv.WORD_CONFIDENCE_BUCKETS)


@query(
    "A6", (),
    f"""SELECT CAST(CAST(b AS DOUBLE) AS VARCHAR) AS le,
               count(CASE WHEN l_quantity / 50 <= CAST(b AS DOUBLE) THEN 1 END) AS n
        FROM lineitem CROSS JOIN (VALUES {_WORD_LE}) v(b) GROUP BY 1
        UNION ALL SELECT '+Inf', count(l_quantity) FROM lineitem""",
)
def word_confidence_cumulative(t):
    rows = t.lineitem.select((F.col("l_quantity") / 50).alias("confidence"))
    return analytics.cumulative_histogram(rows, "confidence", fv.WORD_CONFIDENCE_BUCKETS)


@query(
    "F3", (),
    """SELECT CAST(l_orderkey AS VARCHAR) AS document_id,
         coalesce(string_agg(CASE WHEN l_quantity < 25 THEN concat('field_', l_linenumber) END, ','
           ORDER BY l_linenumber), '') AS fields FROM lineitem GROUP BY 1""",
)
def low_confidence_fields(t):
    field = F.struct(
        F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("name"),
        (F.col("l_quantity") < 25).alias("requires_review"),
    )
    held = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("document_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber"), field.alias("f")))).alias("fs")
    )
    rows = scope.review_fields(held.select("document_id", F.transform("fs", lambda x: x["f"]).alias("field_confidences")))
    names = F.transform("low_confidence_fields", lambda f: f["name"])
    return rows.select("document_id", F.array_join(names, ",").alias("fields"))


@query(
    "V7", ("tasks",),
    """SELECT task_id, document_id, status FROM tasks
         WHERE document_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P')
       UNION ALL SELECT concat('new-', o_orderkey), CAST(o_orderkey AS VARCHAR), 'pending'
         FROM orders WHERE o_orderstatus = 'P'""",
)
def tasks_after_reprocessing(t):
    from lexloom.operators import review

    again = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("document_id"))
    fresh = again.select(F.concat(F.lit("new-"), "document_id").alias("task_id"), "document_id", F.lit("pending").alias("status"))
    return review.replace_tasks(t.tasks.select("task_id", "document_id", "status"), fresh, again)
