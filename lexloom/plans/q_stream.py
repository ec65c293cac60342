"""Queries: streams over the given tables, and file sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.plans.registry import query
from lexloom.plans.tables import table
from lexloom.session import shared_folder
from lexloom.sources import files, sinks
from lexloom.streaming import admission, ingest, rates


def _stream(t, name: str):
    """A given table as a stream of its files."""
    schema = table(t.spark, t.sf_dir, name).schema
    return (
        t.spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}*.parquet")
        .parquet(t.sf_dir)
    )


def _drop_folder(t, df, purpose: str) -> str:
    """The rows as a folder of files, as an upstream job would leave them."""
    folder = shared_folder(t.spark, purpose)
    df.write.parquet(folder)
    return folder


@query(
    "Z4", (),
    """SELECT event_id, n <= 1 AS allowed, greatest(0, 1 - n)::BIGINT AS remaining,
         CASE WHEN n > 1 THEN greatest(1, 60 - second(ts)) ELSE 0 END::BIGINT AS retry_after
       FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts)
         ORDER BY ts, event_id) AS n FROM events)""",
)
def admitted_events(t):
    rows = admission.admit_batch(t.events, "event_type", 1)
    return rows.select(
        "event_id", "allowed", F.col("remaining").cast("long").alias("remaining"),
        F.col("retry_after").cast("long").alias("retry_after"),
    )


@query(
    "Z4", (),
    """SELECT event_id, n <= 1 AS allowed FROM (SELECT event_id, row_number() OVER
         (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS n FROM events)""",
)
def admitted_event_stream(t):
    """The same decisions by keyed state on the stream of events."""
    source = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out, marks = shared_folder(t.spark, "admit"), shared_folder(t.spark, "admit-marks")
    rates.run_to_table(
        admission.admit_stream(source.select("event_id", "ts", "event_type"), "event_type", 1), out, marks
    )
    return t.spark.read.parquet(out).select("event_id", "allowed")


@query(
    "Z4", (),
    """SELECT event_type, CAST(count(*) AS BIGINT) AS events, CAST(count(*) AS BIGINT) AS accounted FROM events GROUP BY 1""",
)
def accounted_events(t):
    """Events in files newest first: what the stream decided and what came too late make up all events."""
    folder = _drop_folder(t, t.events.repartitionByRange(3, F.desc("ts")), "admit-late")
    source = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    source = source.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out, marks = shared_folder(t.spark, "admit"), shared_folder(t.spark, "admit-marks")
    rates.run_to_table(admission.admit_stream(source, "event_type", 1), out, marks)
    decided = t.spark.read.parquet(out).select("event_id", F.col("key").alias("event_type"))
    late = admission.undecided(t.events, decided).select("event_id", "event_type")
    counted = decided.unionByName(late).groupBy("event_type").agg(F.count_distinct("event_id").alias("accounted"))
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events")).join(counted, "event_type")


@query(
    "Z5 A4", (),
    """WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, user_id FROM events)
       SELECT strftime(day, '%Y-%m-%d') AS day, count(CASE WHEN event_type = 'view' THEN 1 END) AS drafts_generated,
         count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS drafts_edited,
         CASE WHEN count(CASE WHEN event_type = 'view' THEN 1 END) > 0 THEN
           CAST(count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS DOUBLE)
           / CAST(count(CASE WHEN event_type = 'view' THEN 1 END) AS DOUBLE) ELSE 0::DOUBLE END AS edit_rate
       FROM d WHERE event_type IN ('view', 'click') GROUP BY 1""",
)
def daily_edit_rate_stream(t):
    """Views are drafts, clicks are edits of the user's draft. The events arrive in several files, newest
    first, so most of them are late."""
    upside = _drop_folder(t, t.events.repartitionByRange(4, F.desc("ts")), "late-events")
    source = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(upside)
    source = source.where("event_type IN ('view', 'click')").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "view", "draft").otherwise("edit").alias("kind"),
        F.col("user_id").alias("draft_id"),
        "event_id",
    )
    out, marks = shared_folder(t.spark, "rate"), shared_folder(t.spark, "rate-marks")
    rates.run_to_table(rates.daily_marks(source), out, marks, distinct=True)
    rows = rates.daily_edit_rate(t.spark.read.parquet(out))
    return rows.select(
        F.col("day").cast("string").alias("day"), "drafts_generated", "drafts_edited", "edit_rate"
    )


@query(
    "Z6 W7", (),
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS events
       FROM events GROUP BY 1""",
)
def live_state_stream(t):
    out, marks = shared_folder(t.spark, "state"), shared_folder(t.spark, "state-marks")
    state = rates.live_state(_stream(t, "events"), "user_id", "ts", "event_type", "event_id")
    rates.run_to_table(state, out, marks, mode="complete", snapshot=True)
    return t.spark.read.parquet(f"{out}/snapshot").select("user_id", "state", "events")


@query(
    "Z1 Z2 Z3", (),
    """SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN lang = 'en' THEN 2 ELSE 1 END::BIGINT AS version,
         true AS whole, true AS numbered, true AS typed
       FROM documents WHERE trim(text) <> ''""",
)
def ingested_documents(t):
    """All documents arrive in version 1, the English ones again in version 2; the latest counts.

    Its stored chunks, read back, cover the text from the first character that is not blank to the last
    (``whole``) and are numbered without gaps; its type and fields are stored with it.
    """
    rows = t.documents.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.explode(F.when(F.col("lang") == "en", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        .alias("version"),
        "text",
    )
    folder = _drop_folder(t, rows.repartition(8), "drop")
    out, marks = shared_folder(t.spark, "ingest"), shared_folder(t.spark, "ingest-marks")
    source = ingest.read_stream(t.spark, folder, rows.schema, files_per_trigger=4)
    ingest.start_ingestion(source, out, marks).awaitTermination()
    stored = ingest.read_documents(t.spark, out)
    parts = ingest.read_chunks(t.spark, out).groupBy("document_id", "version").agg(
        F.min("char_start").alias("first"), F.max("char_end").alias("last"), F.count("*").alias("n"), F.max("chunk_index").alias("top")
    )
    inked = t.documents.select(
        F.col("doc_id").cast("string").alias("document_id"),
        (F.length("text") - F.length(F.regexp_replace("text", r"(?U)^\s+", ""))).alias("begins"),
        F.length(F.regexp_replace("text", r"(?U)\s+$", "")).alias("ends"),
    )
    found = stored.join(parts, ["document_id", "version"]).join(inked, "document_id")
    return found.select(
        "document_id",
        F.col("version").cast("long").alias("version"),
        ((F.col("first") <= F.col("begins")) & (F.col("last") >= F.col("ends"))).alias("whole"),
        (F.col("n") == F.col("top") + 1).alias("numbered"),
        (F.col("document_type").isNotNull() & (F.size("fields") >= 0)).alias("typed"),
    )


@query(
    "Z3", (),
    """SELECT user_id, count(*) AS attempts, arg_max(props, (ts, event_id)) AS error FROM events
       WHERE event_type = 'error' GROUP BY 1 HAVING NOT bool_or(value > 200) AND count(*) >= 3""",
)
def dead_letters(t):
    attempts = t.events.where("event_type = 'error'").select(
        "user_id", F.col("ts").alias("attempt_at"), F.col("event_id").alias("attempt_no"),
        (F.col("value") > 200).alias("success"), F.col("props").alias("error"),
    )
    return ingest.failed_attempts(attempts, "user_id").select("user_id", "attempts", "error")


# ---- sources and sinks --------------------------------------------------------------------------


@query(
    "S1", (),
    """SELECT page_id, kind IN ('application/pdf', 'image/png') AND page_id % 7 <> 3 AS accepted FROM (
         SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png'
           WHEN 2 THEN 'text/plain' ELSE 'text/html' END AS kind FROM pages)""",
)
def checked_uploads(t):
    """Pages as uploads: type by id, with parameters and capitals; some are too large."""
    kind = (
        F.when(F.col("page_id") % 4 == 0, "Application/PDF; version=1.7")
        .when(F.col("page_id") % 4 == 1, " image/png")
        .when(F.col("page_id") % 4 == 2, "text/plain")
        .otherwise("text/html; charset=utf-8")
    )
    size = F.when(F.col("page_id") % 7 == 3, F.lit(60 * 1024 * 1024)).otherwise(F.length("html"))
    rows = t.pages.select("page_id", kind.alias("content_type"), size.cast("long").alias("length"))
    return files.intake_check(rows).select("page_id", "accepted")


def _registered(t):
    rows = t.pages.select(
        F.col("url").alias("path"), F.col("page_id").alias("modificationTime"),
        F.lit("application/pdf").alias("content_type"),
    )
    return files.register(rows, "1.0", F.lit("2024-03-01 00:00:00").cast("timestamp"), "acme")


@query(
    "S2", (),
    """SELECT sha256(concat(url, '|', page_id)) AS document_id, string_split(url, '/')[-1] AS filename,
         'queued' AS status, 'acme' AS tenant_id FROM pages""",
)
def registered_documents(t):
    return _registered(t)[0].select("document_id", "filename", "status", "tenant_id")


@query(
    "S2 S11", (),
    """SELECT sha256(concat(url, '|', page_id)) AS document_id, 'document_uploaded' AS event_type,
         url AS path FROM pages""",
)
def upload_audit(t):
    return _registered(t)[1].select(
        "document_id", "event_type", F.col("payload")["path"].alias("path")
    )


@query(
    "S11", (),
    """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM events GROUP BY 1, 2""",
)
def appended_audit(t):
    """Events appended to the log in two runs and read back by day."""
    rows = t.events.withColumn("created_at", F.col("ts"))
    log = shared_folder(t.spark, "audit")
    sinks.append_audit(rows.where("value < 50"), log)
    sinks.append_audit(rows.where("value >= 50"), log)
    stored = t.spark.read.parquet(log)
    return stored.groupBy("event_type", F.col("day").cast("string").alias("day")).agg(
        F.count("*").alias("events")
    )


@query(
    "S3 S10", (),
    """SELECT lang AS document_type, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters
       FROM documents GROUP BY 1""",
)
def exported_payloads(t):
    out = shared_folder(t.spark, "export")
    rows = t.documents.select("doc_id", F.col("lang").alias("document_type"), "text")
    sinks.write_exports(rows, out)
    back = t.spark.read.schema("doc_id long, text string, document_type string").json(out)
    return back.groupBy("document_type").agg(
        F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters")
    )


@query(
    "S4", (),
    """SELECT concat('source=', source, '/doc_id=', doc_id) AS folder, length(text)::BIGINT AS characters
       FROM documents""",
)
def scanned_corpus(t):
    """Documents written as one text file each, below a folder per source, and scanned back.

    The id is a file's first line: a folder for each document would have to be made and listed.
    """
    folder = shared_folder(t.spark, "corpus")
    headed = F.concat(F.lit("doc_id="), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    sinks.write_texts(t.spread("documents").select("source", headed.alias("text")), folder, "source")
    corpus = files.read_corpus(t.spark, folder)
    head = F.substring_index("text", "\n", 1)
    return corpus.select(
        F.concat(F.regexp_replace("corpus_path", r"/[^/]*$", ""), F.lit("/"), head).alias("folder"),
        # without the first line; the writer ends each file with a line break, too
        (F.length("text") - F.length(head) - 2).cast("long").alias("characters"),
    )


@query(
    "S5", (),
    """SELECT concat('case-', item_id) AS case_id, trim(text) AS query, 'docs/a.txt' AS corpus_path,
         item_id AS start, item_id + 10 AS "end" FROM benchmark""",
)
def scanned_benchmark(t):
    """Benchmark items written as JSON files of one case each and read back."""
    case = F.struct(
        F.concat(F.lit("case-"), F.col("item_id").cast("string")).alias("id"),
        F.col("text").alias("question"),
        F.array(
            F.struct(
                F.lit("docs\\a.txt").alias("filepath"),
                F.array("item_id", F.col("item_id") + 10).alias("span"),
            )
        ).alias("snippets"),
    )
    folder = shared_folder(t.spark, "cases")
    one = t.benchmark.select(F.to_json(F.struct(F.array(case).alias("tests"))).alias("value"))
    one.write.option("maxRecordsPerFile", 1).text(folder)
    rows = files.read_benchmark(t.spark, folder)
    return rows.select(
        "case_id", "query", "corpus_path", F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
    )
