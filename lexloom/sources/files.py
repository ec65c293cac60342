"""File sources: intake check, registration, corpus text, benchmark files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import strip


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """File listing with size and content type by suffix. The content itself is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    types = F.create_map(*[F.lit(x) for p in fv.CONTENT_TYPE_BY_SUFFIX.items() for x in p])
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select(
        "path",
        "length",
        "modificationTime",
        F.coalesce(types[suffix], F.lit("application/octet-stream")).alias("content_type"),
    )


def intake_check(uploads: DataFrame) -> DataFrame:
    """Adds ``accepted`` and ``reason``: size first, then type without its parameters."""
    kind = F.lower(strip(F.element_at(F.split(F.coalesce("content_type", F.lit("")), ";"), 1)))
    reason = F.when(
        F.col("length") > fv.MAX_UPLOAD_MB * 1024 * 1024,
        F.lit(f"File exceeds {fv.MAX_UPLOAD_MB} MB limit."),
    ).when(
        ~kind.isin(*fv.ALLOWED_CONTENT_TYPES),
        F.concat(F.lit("Unsupported file type '"), kind, F.lit("'.")),
    )
    return uploads.withColumns({"accepted": reason.isNull(), "reason": reason})


def register(
    accepted: DataFrame, version: str, at: Column, tenant: str | None = None, tags: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """New document rows (queued, deterministic ids) and their audit rows."""
    name = F.element_at(F.split("path", "/"), -1)
    documents = accepted.select(
        F.sha2(F.concat_ws("|", "path", F.col("modificationTime").cast("string")), 256).alias(
            "document_id"
        ),
        name.alias("filename"),
        F.col("path").alias("stored_path"),
        "content_type",
        F.lit("queued").alias("status"),
        F.lit(version).alias("pipeline_version"),
        F.lit(tenant).cast("string").alias("tenant_id"),
        (tags if tags is not None else F.create_map().cast("map<string,string>")).alias("tags"),
        at.alias("created_at"),
    )
    audit = audit_rows(
        documents,
        "document_uploaded",
        F.create_map(
            F.lit("filename"), F.col("filename"), F.lit("path"), F.col("stored_path")
        ),
        at,
    )
    return documents, audit


def audit_rows(
    rows: DataFrame, event: str, payload: Column, at: Column, actor: str = "system",
    correlation: str | None = None,
) -> DataFrame:
    """One append-only event per row."""
    return rows.select(
        F.sha2(F.concat_ws("|", "document_id", F.lit(event), at.cast("string")), 256).alias("event_id"),
        "document_id",
        F.lit(event).alias("event_type"),
        F.lit(actor).alias("actor"),
        payload.alias("payload"),
        F.lit(correlation).cast("string").alias("correlation_id"),
        at.alias("created_at"),
    )


def read_corpus(spark: SparkSession, folder: str, include: DataFrame | None = None) -> DataFrame:
    """(corpus_path, text) of all text files below a folder; ``include`` limits it to its paths.

    Undecodable bytes become replacement characters. Files of other kinds are not opened. The include
    list is a semi join on the path, made before the text is decoded.
    """
    either = ["".join(f"[{c}{c.upper()}]" for c in suffix) for suffix in fv.CORPUS_SUFFIXES]
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(either) + "}")
        .load(folder)
    )
    root = folder.rstrip("/") + "/"
    relative = F.regexp_replace(
        F.substring_index(F.replace("path", F.lit("\\"), F.lit("/")), root, -1), r"^/+", ""
    )
    listed = files.select(relative.alias("corpus_path"), "content")
    if include is not None:
        wanted = include.select(
            F.replace("corpus_path", F.lit("\\"), F.lit("/")).alias("corpus_path")
        ).distinct()
        listed = listed.join(wanted, "corpus_path", "left_semi")
    return listed.select(
        "corpus_path", F.try_validate_utf8(F.col("content").cast("string")).alias("valid"), "content"
    ).select(
        "corpus_path",
        F.coalesce("valid", F.make_valid_utf8(F.col("content").cast("string"))).alias("text"),
    )


_RECORD_LISTS = ["tests", "test_cases", "cases", "queries", "data", "benchmark"]
_SNIPPET_LISTS = ["ground_truth", "ground_truths", "snippets", "gold_snippets", "answers"]
_PATH_KEYS = ["file_path", "filepath", "path", "corpus_path", "document_path"]
_START_KEYS = ["start", "start_index", "char_start"]
_END_KEYS = ["end", "end_index", "char_end"]
_TEXT_KEYS = ["text", "snippet", "answer"]


def _pick(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _starts(value: Column, mark: str) -> Column:
    return F.startswith(F.ltrim(F.to_json(value)), F.lit(mark))


def _text(value: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.nullif(_pick(value, f"$.{k}", "string"), F.lit("")) for k in keys])


def _number(value: Column, keys: list[str]) -> Column:
    return F.coalesce(*[_pick(value, f"$.{k}", "double") for k in keys]).cast("int")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Cases with their gold snippets, one row per snippet: (case_id, query, snippet_no,
    corpus_path, start, end, text). Cases without a query or a usable snippet are left out."""
    raw = spark.read.option("wholetext", "true").text(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("stem"),
        F.try_parse_json("value").alias("doc"),
    )
    doc = F.col("doc")

    def as_list(value: Column) -> Column:
        return F.when(_starts(value, "["), F.try_variant_get(value, "$", "array<variant>"))

    lists = [as_list(_pick(doc, f"$.{k}", "variant")) for k in _RECORD_LISTS]
    single = F.when(
        _pick(doc, "$.query", "string").isNotNull() | _pick(doc, "$.question", "string").isNotNull(),
        F.array(doc),
    )
    records = F.coalesce(as_list(doc), *lists, single)
    # The number counts the objects of a file only.
    objects = F.filter(records, lambda r: _starts(r, "{"))
    cases = raw.select("stem", F.posexplode(objects).alias("no", "r")).withColumn("no", F.col("no") + 1)
    r = F.col("r")

    def snippet_list(key: str) -> Column:
        value = _pick(r, f"$.{key}", "variant")
        return F.coalesce(as_list(value), F.when(_starts(value, "{"), F.array(value)))

    query = strip(F.coalesce(_text(r, ["query", "question"]), F.lit("")))
    case_id = F.coalesce(
        _text(r, ["id", "case_id"]), F.concat_ws("-", "stem", F.col("no").cast("string"))
    )
    snippets = cases.select(
        case_id.alias("case_id"),
        query.alias("query"),
        F.posexplode(F.coalesce(*[snippet_list(k) for k in _SNIPPET_LISTS])).alias(
            "snippet_no", "s"
        ),
    ).where("query <> ''")
    s = F.col("s")
    bare = F.when(_starts(s, '"'), _pick(s, "$", "string"))
    span = _pick(s, "$.span", "array<double>")
    two = F.coalesce(F.size(span), F.lit(0)) == 2
    return snippets.select(
        "case_id",
        "query",
        "snippet_no",
        F.replace(_text(s, _PATH_KEYS), F.lit("\\"), F.lit("/")).alias("corpus_path"),
        F.when(two, span[0].cast("int")).otherwise(_number(s, _START_KEYS)).alias("start"),
        F.when(two, span[1].cast("int")).otherwise(_number(s, _END_KEYS)).alias("end"),
        F.coalesce(bare, _text(s, _TEXT_KEYS), F.lit("")).alias("text"),
    ).where("text <> '' OR corpus_path IS NOT NULL")
