"""Drafts: prompts in, replies and edits back into tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import clean_reply
from lexloom.operators.grounding import draft_scores, grounding_score

SECTION = (
    "struct<key:string,title:string,content:string,evidence_chunk_ids:array<string>,confidence:string>"
)
_REPLY = f"struct<sections:array<{SECTION}>>"


def placeholder_drafts(requests: DataFrame) -> DataFrame:
    """Requested drafts before their reply is there."""
    return requests.withColumns(
        {
            "status": F.lit("generating"),
            "sections": F.array().cast(f"array<{SECTION}>"),
            "word_count": F.lit(0),
            "overall_grounding_score": F.lit(None).cast("double"),
        }
    )


def normal_sections(sections: Column) -> Column:
    """Missing parts of a reply's sections get their defaults."""

    def filled(value: Column, default: Column) -> Column:
        return F.coalesce(F.nullif(value, F.lit("")), default)

    return F.transform(
        F.coalesce(sections, F.array().cast(f"array<{SECTION}>")),
        lambda s, i: F.struct(
            filled(s["key"], F.concat(F.lit("section_"), (i + 1).cast("string"))).alias("key"),
            filled(s["title"], F.concat(F.lit("Section "), (i + 1).cast("string"))).alias("title"),
            F.coalesce(s["content"], F.lit("")).alias("content"),
            F.coalesce(s["evidence_chunk_ids"], F.array().cast("array<string>")).alias(
                "evidence_chunk_ids"
            ),
            filled(s["confidence"], F.lit("low")).alias("confidence"),
        ),
    )


def parse_replies(replies: DataFrame, raw: str = "reply") -> DataFrame:
    """Adds ``sections`` and ``parsed``. What cannot be read keeps NULL sections for quarantine."""
    body = clean_reply(F.col(raw))
    found = F.from_json(F.col("_body"), _REPLY)["sections"]
    return (
        replies.withColumn("_body", body)
        .withColumn("parsed", F.col("_body").isNotNull())
        .withColumn("sections", F.when(F.col("parsed"), normal_sections(found)))
        .drop("_body")
    )


def finished_drafts(parsed: DataFrame, error: str = "error") -> DataFrame:
    """Failed drafts hold one error section with score 0.0; the others are ready for review."""
    text = F.coalesce(F.col(error), F.lit("reply is not JSON"))
    failed = ~F.col("parsed") | F.col(error).isNotNull()
    notice = F.array(
        F.struct(
            F.lit("generation_error").alias("key"),
            F.lit("Generation Error").alias("title"),
            F.concat(F.lit("[UNSUPPORTED: Draft generation failed: "), text, F.lit("]")).alias(
                "content"
            ),
            F.array().cast("array<string>").alias("evidence_chunk_ids"),
            F.lit("unsupported").alias("confidence"),
        )
    )
    return parsed.withColumns(
        {
            "status": F.when(failed, "failed").otherwise("draft"),
            "sections": F.when(failed, notice).otherwise(F.col("sections")),
        }
    )


def section_rows(drafts: DataFrame, key: str = "draft_id") -> DataFrame:
    """One row per section with its position and grounding score."""
    rows = drafts.select(key, "status", F.posexplode("sections").alias("position", "s")).select(
        key, "status", "position", "s.*"
    )
    score = F.when(F.col("status") == "failed", 0.0).otherwise(grounding_score("content"))
    return rows.withColumn("grounding_score", score)


def offered_evidence(cited: Column | str, offered: Column | str) -> Column:
    """Cited ids that were offered, first citation first, each once."""
    cited = F.col(cited) if isinstance(cited, str) else cited
    offered = F.col(offered) if isinstance(offered, str) else offered
    return F.array_distinct(F.filter(cited, lambda c: F.array_contains(offered, c)))


def evidence_chunks(drafts: DataFrame, chunks: DataFrame, key: str = "draft_id") -> DataFrame:
    """Chunks that a draft cites, in reading order."""
    cited = drafts.select(key, F.explode("evidence_chunk_ids").alias("chunk_id")).distinct()
    return cited.join(chunks, "chunk_id").orderBy(key, "page_number", "chunk_index")


def apply_section_edits(sections: DataFrame, edits: DataFrame, key: str = "draft_id"):
    """(new sections, edit rows, draft rows) after a reviewer's edits (draft, key, edited_content).

    Unknown keys and unchanged texts have no effect. Every edited draft counts as reviewed.
    """
    asked = edits.select(
        key, F.col("section_key").alias("key"), "edited_content", "reviewer_name"
    )
    joined = sections.join(asked, [key, "key"], "left")
    changed = F.col("edited_content").isNotNull() & (F.col("edited_content") != F.col("content"))
    joined = joined.withColumn("_changed", changed)
    edit_rows = joined.where("_changed").select(
        key,
        F.col("key").alias("section_key"),
        F.col("content").alias("original_content"),
        "edited_content",
        "reviewer_name",
    )
    updated = joined.withColumns(
        {
            "content": F.when(F.col("_changed"), F.col("edited_content")).otherwise(F.col("content")),
            "grounding_score": F.when(
                F.col("_changed"), grounding_score("edited_content")
            ).otherwise(F.col("grounding_score")),
        }
    ).drop("edited_content", "reviewer_name", "_changed")
    scores = draft_scores(updated, key)
    reviewed = edits.select(key).distinct().withColumn("status", F.lit("reviewed"))
    return updated, edit_rows, scores.join(reviewed, key)


def drafts_of_document(drafts: DataFrame, document_id) -> DataFrame:
    return drafts.where(F.col("document_id") == document_id).orderBy(
        F.desc("created_at"), "draft_id"
    )


def source_block(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """The selected chunks of each document as one text block, in order of ``position``."""
    entry = F.concat(
        F.lit("[Chunk "), F.col("position").cast("string"),
        F.lit(" | Page "), F.col("page_number").cast("string"),
        F.lit(" | "), F.coalesce("section_header", F.lit("")), F.lit("] "), F.col("chunk_id"),
        F.lit("\n"), F.col("text"),
    )
    return chunks.groupBy(key).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", entry.alias("e")))),
                lambda x: x["e"],
            ),
            "\n---\n",
        ).alias("source_block")
    )


def section_plan(draft_type: str, document_type: Column, draft_date: str, templates: dict | None = None) -> Column:
    """Section plan of a template as text: whether it was made for the type, its defaults, and what each section asks for."""
    found = (templates or fv.DRAFT_TEMPLATES).get(draft_type)
    if not found:
        return F.lit("DRAFT TEMPLATE: none; follow the requested draft type.")
    types, sections = found
    fits = document_type.isin(*types) if types else F.lit(True)
    head = F.concat(
        F.lit(f"DRAFT TEMPLATE: {draft_type}. "),
        F.when(fits, F.concat(F.lit("Applicable to "), document_type, F.lit("."))).otherwise(
            F.concat(F.lit("Not listed for "), document_type, F.lit("; use it as well as it fits."))
        ),
    )
    lines = []
    if defaults := fv.TEMPLATE_DEFAULTS.get(draft_type):
        given = {k: draft_date if v is None else v for k, v in defaults.items()}
        lines.append(f"Defaults: {json.dumps(given)}")
    lines.append("Section plan:")
    asked = fv.SECTION_INSTRUCTIONS.get(draft_type, {})
    lines += [f"- {t} ({'required' if r else 'optional'}): {asked.get(k, '')}" for k, t, r, _ in sections]
    return F.concat_ws("\n", head, *[F.lit(line) for line in lines])


def draft_instructions(draft_type: str, document_type: Column) -> Column:
    """What a draft type asks for besides its template, for this type of document."""
    found = [
        F.lit(f"- {text}") if kind is None else F.when(document_type == kind, F.lit(f"- {text}"))
        for draft, kind, text in fv.DRAFT_INSTRUCTIONS
        if draft == draft_type
    ]
    if not found:
        return F.lit("INSTRUCTIONS: follow the requested draft type.")
    return F.concat_ws("\n", F.lit("INSTRUCTIONS:"), *found)


def memo_rules(draft_type: str, draft_date: str) -> str | None:
    """Template metadata that stands in a draft without a source."""
    defaults = fv.TEMPLATE_DEFAULTS.get(draft_type)
    if not defaults:
        return None
    lines = [f"- {key.upper()}: {draft_date if value is None else value}" for key, value in defaults.items()]
    return "\n".join(["TEMPLATE RULES (metadata, not facts of the document; never mark it unsupported):", *lines])


def prompts(documents: DataFrame, draft_type: str, draft_date: str) -> DataFrame:
    """(system_prompt, user_prompt) per document.

    ``documents`` carries document_type, fields_json, terms_block, conflicts_block, source_block,
    preferences (array of rules) and examples (array of original/edited pairs). The date is a
    parameter, so a rerun gives the same text. Parts that are empty or null leave no line.
    """
    rules = F.transform("preferences", lambda p: F.concat(F.lit("- "), p))
    learned = F.when(
        F.size("preferences") > 0,
        F.concat(F.lit("PREFERENCES LEARNED FROM EDITS:\n"), F.array_join(rules, "\n")),
    )
    shown = F.transform(
        "examples",
        lambda e: F.concat(F.lit("EXAMPLE\n[ORIGINAL]\n"), e["original"], F.lit("\n[EDITED]\n"), e["edited"]),
    )
    fixed = [
        f"Write a {draft_type} from the given sources only, in formal legal style.",
        "Cite every fact as [Page N] or [Page N - Section Title].",
        "Where the sources are silent write [UNSUPPORTED: reason]; general knowledge fills no gaps.",
        f"Date the draft {draft_date}. Do not invent filing, review, or memo dates.",
        'Repair scanning errors only where the term is clear, as in "Landmark Credit Union" for "Iandmark Credit Union".',
        *filter(None, [memo_rules(draft_type, draft_date)]),
    ]
    system = F.concat_ws(
        "\n",
        *[F.lit(line) for line in fixed],
        learned,
        F.nullif(F.array_join(shown, "\n\n"), F.lit("")),
        F.lit("Answer in JSON: sections of key, title, content, evidence_chunk_ids, confidence."),
    )
    kind = F.coalesce("document_type", F.lit("unknown"))
    user = F.concat_ws(
        "\n\n",
        F.concat(F.lit("DOCUMENT TYPE: "), kind),
        F.lit(f"DRAFT DATE: {draft_date}"),
        F.concat(F.lit("FIELDS: "), F.col("fields_json")),
        F.nullif("terms_block", F.lit("")),
        F.nullif("conflicts_block", F.lit("")),
        draft_instructions(draft_type, kind),
        section_plan(draft_type, kind, draft_date),
        F.concat(F.lit("SOURCES:\n---\n"), F.coalesce("source_block", F.lit("")), F.lit("\n---")),
    )
    return documents.select("document_id", system.alias("system_prompt"), user.alias("user_prompt"))
