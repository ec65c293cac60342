"""Contradictions inside a document, found over its chunks.

All chunks are scanned once. Matches are reduced to one row per document, label and distinct value
(with partial aggregation before the shuffle), so what reaches the last step for a document grows
with the number of different values and not with the number of chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import collapse, strip, strip_chars, unpack

_MENTION = "array<struct<kind:string,label:string,value:string,at:int>>"
_KINDS = ["governing_law", "defined_term", "date", "amount"]


def normal_value(value: Column) -> Column:
    return F.lower(strip_chars(collapse(value), " .,;:'\"-"))


def clean_meaning(value: Column) -> Column:
    return strip_chars(collapse(value), " .,;:'\"")


def _parts(text: Column, pattern: str, build) -> Column:
    """Both groups of every match, with one scan of the text: the groups are read again from the
    match itself, which is exact for a pattern that does not look beyond its match, or looks only for an end
    that the match's own end is, too."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: build(F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)),
    )


#: The first three letters of every way in which a pattern can begin, tested before all its ways are tried.
_LAW_BEGINS = "(?=[gcs][ou][vnb])"
_DATE_BEGINS = "(?=[ecads][fxogai][femrtg])"
_AMOUNT_BEGINS = "(?=[mayqtblspc][oneuai][natscr])"


def _mention(kind: str, label: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), label.alias("label"), value.alias("value"))


def mentions(text: Column, kinds: list[str] | None = None) -> Column:
    """All statements of these kinds (all four if not named) that can contradict each other, in text
    order within each kind."""
    laws = F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit("(?iUd)" + _LAW_BEGINS + fv.GOVERNING_LAW), F.lit(1)),
            lambda v: _mention("governing_law", F.lit(""), normal_value(v)),
        ),
        lambda m: (F.length(m["value"]) >= 3) & ~m["value"].isin(*fv.GOVERNING_LAW_NOISE),
    )
    meanings = F.filter(
        _parts(
            text,
            "(?isUd)" + fv.QUOTED_MEANING,
            lambda t, d: _mention("defined_term", F.lower(strip(t)), clean_meaning(d)),
        ),
        lambda m: (F.length(m["label"]) >= 2) & (F.length(m["value"]) >= 5),
    )
    dates = _parts(
        text,
        "(?iUd)" + _DATE_BEGINS + fv.LABELLED_DATE,
        lambda label, d: _mention("date", normal_value(label), strip(d)),
    )
    amounts = _parts(
        text,
        "(?iUd)" + _AMOUNT_BEGINS + fv.LABELLED_AMOUNT,
        lambda label, a: _mention(
            "amount", normal_value(label), strip(F.replace(a, F.lit(","), F.lit("")))
        ),
    )

    low = F.lower(text)

    def numbered(values: Column, *needed: str) -> Column:
        """Matches with their place; a text without any of the needed words is not matched."""
        possible = reduce(lambda a, b: a | b, [low.contains(n) for n in needed])
        placed = F.transform(values, lambda m, i: m.withField("at", i)).cast(_MENTION)
        return F.coalesce(F.when(possible, placed), F.array().cast(_MENTION))

    found = {
        "governing_law": numbered(laws, "governed", "construed", "subject"),
        "defined_term": numbered(meanings, '"'),
        "date": numbered(dates, "date", "signed"),
        "amount": numbered(amounts, "fee", "payment", "price", "value", "salary"),
    }
    return F.concat(*[found[k] for k in _KINDS if kinds is None or k in kinds])


def distinct_statements(
    chunks: DataFrame,
    text: str = "text",
    doc: str = "document_id",
    index: str = "chunk_index",
    terms: DataFrame | None = None,
    kinds: list[str] | None = None,
) -> DataFrame:
    """One row per document, kind, label and value: where it was seen first and in which chunks.

    ``terms`` seeds document-level definitions (doc, term, definition); a seed counts as a
    statement before all chunks, yet lists no chunk. With ``kinds``, texts are searched for these only.
    """
    keys = [F.col(doc).alias("document_id"), F.col(index).cast("int").alias("idx")]
    found = unpack(chunks, keys, mentions(F.col(text), kinds), "kind")
    if terms is not None and (kinds is None or "defined_term" in kinds):
        seeds = terms.select(
            F.col(doc).alias("document_id"),
            F.lit(-1).alias("idx"),
            F.lit("defined_term").alias("kind"),
            F.lower("term").alias("label"),
            clean_meaning(F.col("definition")).alias("value"),
            F.lit(0).alias("at"),
        )
        found = found.unionByName(seeds)
    return found.groupBy("document_id", "kind", "label", "value").agg(
        F.min(F.struct("idx", "at")).alias("first"),
        F.collect_set(F.when(F.col("idx") >= 0, F.col("idx"))).alias("chunks"),
    )


def find_conflicts(chunks: DataFrame, **options) -> DataFrame:
    """One row per contradiction: (document_id, conflict_type, description, chunk_indices,
    severity, field, values, position). The description names the first few values, ``values`` all;
    ``position`` gives the report order."""
    values = distinct_statements(chunks, **options)
    # A label with one single value cannot conflict: drop it before anything is collected.
    grouped = values.groupBy("document_id", "kind", "label").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("first", "value"))).alias("seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunk_indices"),
    )
    rows = grouped.where("n >= 2")
    shown = F.transform(F.col("seen"), lambda s: s["value"])
    kind, label = F.col("kind"), F.col("label")
    description = (
        F.when(
            kind == "governing_law",
            F.concat(
                F.lit("Conflicting governing law references: "),
                F.array_join(
                    F.transform(
                        F.slice(shown, 1, 4), lambda v: F.concat(F.lit('"'), v, F.lit('"'))
                    ),
                    ", ",
                ),
                F.lit("."),
            ),
        )
        .when(
            kind == "defined_term",
            F.concat(F.lit('"'), label, F.lit('" has conflicting definitions across sections.')),
        )
        .when(
            kind == "date",
            F.concat(
                F.lit('Inconsistent "'), label, F.lit('": '),
                F.array_join(F.slice(shown, 1, 3), " vs. "), F.lit("."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit('Inconsistent "'), label, F.lit('": $'),
                F.array_join(F.slice(shown, 1, 3), " vs. $"), F.lit("."),
            )
        )
    )
    severity = F.when(kind.isin("governing_law", "amount"), "high").otherwise("medium")
    order = F.array_position(F.array(*[F.lit(k) for k in _KINDS]), kind).cast("int")
    return rows.select(
        "document_id",
        kind.alias("conflict_type"),
        description.alias("description"),
        "chunk_indices",
        severity.alias("severity"),
        F.when(kind != "defined_term", kind).alias("field"),
        shown.alias("values"),
        F.struct(order.alias("kind"), F.element_at("seen", 1)["first"].alias("first")).alias(
            "position"
        ),
    )


def conflict_report(conflicts: DataFrame) -> DataFrame:
    """Per document: number of conflicts, whether one is severe, and the items in report order."""
    item = F.struct(
        "position", "conflict_type", "description", "chunk_indices", "severity", "field", "values"
    )
    return conflicts.groupBy("document_id").agg(
        F.count("*").alias("conflict_count"),
        F.bool_or(F.col("severity") == "high").alias("has_high_severity"),
        F.array_sort(F.collect_list(item)).alias("items"),
    )


def report_with_cache(reports: DataFrame, chunks: DataFrame, terms: DataFrame | None = None):
    """Cached items where a document has them; the others are scanned now on their stored text.

    ``reports`` holds (document_id, conflicts), NULL for never scanned.
    """
    missing = reports.where("conflicts IS NULL").select("document_id")
    stored = chunks.join(missing, "document_id", "left_semi")
    seeds = terms.join(missing, "document_id", "left_semi") if terms is not None else None
    fresh = find_conflicts(stored, terms=seeds).select(
        "document_id", "conflict_type", "description", "chunk_indices", "severity", "field"
    )
    cached = reports.where("conflicts IS NOT NULL").select(
        "document_id", F.inline("conflicts")
    )
    return cached.select(*fresh.columns).unionByName(fresh)


def conflicts_block(items: Column) -> Column:
    """Text block for a prompt; empty without conflicts."""
    lines = F.transform(
        items,
        lambda c: F.concat(
            F.lit("  "),
            F.when(c["severity"] == "high", "[HIGH]")
            .when(c["severity"] == "medium", "[MEDIUM]")
            .when(c["severity"] == "low", "[LOW]")
            .otherwise("[?]"),
            F.lit(" "), F.upper(c["conflict_type"]), F.lit(": "), c["description"],
        ),
    )
    block = F.concat_ws("\n", F.lit(fv.CONFLICTS_HEADING), F.lit(fv.CONFLICTS_NOTE), lines)
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, block).otherwise("")
