"""Confidence of fields and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import as_col, bind, round_even, strip, with_fixed
from lexloom.operators.extract import is_empty


def format_score(name: Column, value: Column, values: Column, kind: Column) -> Column:
    """How well a present value fits its field, by the field's rule; 0.7 without a rule."""
    shown = F.when(kind == "list", F.array_join(values, ", ")).otherwise(value)
    empty = is_empty(value, values, kind)
    number = value.try_cast("double")
    trimmed = strip(shown)
    dated = shown.rlike("(?iU)" + fv.FORMAT_DATE)
    parted = shown.rlike("(?iU)" + fv.PERIOD_SEPARATOR)
    scores = {
        "date": F.when(dated, 1.0).otherwise(0.3),
        "amount": F.when(number > 0, 1.0).otherwise(0.2),
        "invoice_id": F.when(trimmed.rlike("(?iU)" + fv.FORMAT_INVOICE_ID), 1.0).otherwise(0.4),
        "case_number": F.when(trimmed.rlike("(?iU)" + fv.FORMAT_CASE_NUMBER), 1.0).otherwise(0.4),
        "account": F.when(
            trimmed.rlike("(?U)" + fv.ACCOUNT_DIGITS) & (F.length(trimmed) >= 4), 1.0
        ).otherwise(0.4),
        "period": F.when(parted & dated, 1.0).when(dated, 0.6).otherwise(0.3),
        "text": F.when(F.length(shown) > 2, 0.8).otherwise(0.0),
        "short_text": F.when(F.length(shown) > 1, 0.8).otherwise(0.0),
        "list": F.when(kind == "list", 0.85).otherwise(0.0),
        "boolean": F.when(kind == "boolean", 0.8).otherwise(0.0),
    }
    out = F.when(empty, 0.0)
    for rule, score in scores.items():
        # A test against a list of names is compiled; a map of rules would be searched again for every rule.
        names = [field for field, own in fv.FORMAT_RULE_BY_FIELD.items() if own == rule]
        out = out.when(name.isin(*names), F.coalesce(score, F.lit(0.0)))
    return out.otherwise(0.7)


def cross_scores(fields: Column | str) -> Column:
    """``map<field,score>`` of fields that other fields confirm or contradict.

    ``fields`` maps names to text; unreadable numbers leave the group out.
    """
    values = as_col(fields)
    names = ("subtotal", "tax", "total_amount", "opening_balance", "closing_balance", "available_balance")

    # Each number is read once, and each score computed once: a use of an expression computes all of it again.
    def scored(x: Column) -> Column:
        total, opening, closing, available = (x[n] for n in names[2:])
        sums = F.when(
            total > 0,
            F.greatest(F.lit(0.0), 1.0 - F.abs(x["subtotal"] + x["tax"] - total) / F.nullif(total, F.lit(0.0)) * 10),
        )
        base = F.when(opening.isNotNull() & closing.isNotNull(), F.lit(1.0))
        near = F.greatest(
            F.lit(0.0), 1.0 - F.abs(available - closing) / F.greatest(closing, F.lit(1.0)) * 5
        )
        near = F.when(available.isNotNull() & closing.isNotNull(), near)
        return F.struct(sums.alias("sums"), base.alias("base"), near.alias("near"))

    def entries(s: Column) -> Column:
        scores = [
            *((n, s["sums"]) for n in names[:3]),
            ("opening_balance", s["base"]),
            ("closing_balance", F.greatest(s["base"], s["near"])),
            ("available_balance", s["near"]),
        ]
        return F.array(*[F.struct(F.lit(n).alias("k"), score.alias("v")) for n, score in scores])

    numbers = F.struct(*[values[n].try_cast("double").alias(n) for n in names])
    kept = bind(bind(numbers, scored), lambda s: F.filter(entries(s), lambda e: e["v"].isNotNull()))
    return F.map_from_entries(kept)


def score_fields(rows: DataFrame, cross: Column | None = None) -> DataFrame:
    """Adds ``confidence`` and ``requires_review`` to the long field table.

    ``rows`` carries (name, kind, required, value, values, ocr_conf, clf_conf); ``cross`` is the
    field's cross-field score, NULL for neutral.
    """
    w = fv.FIELD_WEIGHTS
    empty = is_empty()
    fit = format_score(F.col("name"), F.col("value"), F.col("values"), F.col("kind"))
    agreed = F.coalesce(cross if cross is not None else F.lit(None).cast("double"), F.lit(0.5))
    rows = rows.withColumns({"_empty": empty, "_fit": fit, "_cross": agreed})
    raw = (
        F.when(F.col("_empty"), 0.0).otherwise(w["present"])
        + w["ocr"] * F.col("ocr_conf")
        + w["classifier"] * F.col("clf_conf")
        + w["format"] * F.col("_fit")
        + w["cross"] * F.col("_cross")
    )
    bounded = F.least(F.lit(fv.CONFIDENCE_CAP), F.greatest(F.lit(0.0), raw))
    final = (
        F.when(F.col("required") & F.col("_empty"), F.least(bounded, F.lit(0.30)))
        .when(~F.col("_empty") & (F.col("_fit") < 0.5), F.least(bounded, F.lit(0.49)))
        .otherwise(bounded)
    )
    scored = with_fixed(rows, "_raw", final)
    return scored.withColumns(
        {
            "format_score": F.col("_fit"),
            "confidence": round_even("_raw", 4),
            "requires_review": F.col("_raw") < fv.REVIEW_THRESHOLD,
        }
    ).drop("_empty", "_fit", "_cross", "_raw")


def mean_confidence(value: str = "confidence") -> Column:
    """Mean of four-digit values; the decimal sum does not depend on the order of rows."""
    return F.sum(F.col(value).cast("decimal(20,4)")).cast("double") / F.count(value)


def score_documents(scored: DataFrame, key: str = "document_id") -> DataFrame:
    """Document confidence: fields, classifier, scan and coverage of required fields."""
    w = fv.DOCUMENT_WEIGHTS
    sums = scored.groupBy(key).agg(
        mean_confidence().alias("mean_field"),
        F.count_if(F.col("required") & ~is_empty()).alias("present"),
        F.count_if("required").alias("required"),
        F.max("clf_conf").alias("clf_conf"),
        F.max("ocr_conf").alias("ocr_conf"),
    )
    total = (
        w["fields"] * F.col("mean_field")
        + w["classifier"] * F.col("clf_conf")
        + w["ocr"] * F.col("ocr_conf")
        + w["coverage"] * F.col("present") / F.greatest(F.col("required"), F.lit(1))
    )
    return sums.select(
        key, round_even(F.least(F.lit(fv.CONFIDENCE_CAP), total), 4).alias("document_confidence")
    )
