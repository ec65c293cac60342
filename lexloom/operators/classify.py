"""Document type by keywords, patterns and (optionally) near matches. One pass, no shuffle."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.fuzzy import fuzzy_udf
from lexloom.functions.text import round_even, word_total

_MATCH = "(?iUd)"


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def keyword_count(lowered: Column, keyword: str) -> Column:
    """Whole-word occurrences. The plain substring test spares the pattern on most rows."""
    pattern = r"(?U)\b" + re.escape(keyword).replace(r"\ ", " ") + r"\b"
    return F.when(lowered.contains(keyword), F.regexp_count(lowered, F.lit(pattern))).otherwise(0)


def keyword_score(lowered: Column, word_count: Column, keywords: list[str], labels: int) -> Column:
    hits = _total([keyword_count(lowered, k) for k in keywords])
    return hits / F.greatest(word_count, F.lit(1)) * F.lit(math.log(labels))


def pattern_score(lowered: Column, patterns: list[tuple[str, list[str]]]) -> Column:
    def hit(pattern: str, needed: list[str]) -> Column:
        possible = reduce(lambda a, b: a | b, [lowered.contains(n) for n in needed])
        return F.when(possible & lowered.rlike(_MATCH + pattern), 0.5).otherwise(0.0)

    return _total([hit(p, n) for p, n in patterns])


def strong_complaint(lowered: Column, keyword: Column, pattern: Column) -> Column:
    """Caption, adversaries and body of a civil complaint all present."""

    def occurs(word: str) -> Column:
        gone = F.length(lowered) - F.length(F.replace(lowered, F.lit(word), F.lit("")))
        return gone / len(word)

    caption = reduce(
        lambda a, b: a | b,
        [lowered.contains(lit) & lowered.rlike(_MATCH + p) for p, lit in fv.COMPLAINT_CAPTION],
    )
    adversaries = lowered.contains("plaintiff") & (
        lowered.rlike(_MATCH + fv.COMPLAINT_ADVERSARIES)
        | ((occurs("plaintiff") >= 2) & (occurs("defendant") >= 2))
    )
    body = lowered.rlike(_MATCH + fv.COMPLAINT_WORD) & reduce(
        lambda a, b: a | b, [lowered.rlike(_MATCH + p) for p in fv.COMPLAINT_BODY]
    )
    return (keyword + pattern > 0.5) & caption & adversaries & body


def score_types(
    df: DataFrame,
    text: str = "text",
    keywords: dict[str, list[str]] | None = None,
    patterns: dict[str, list[tuple[str, list[str]]]] | None = None,
    fuzzy: bool = False,
) -> DataFrame:
    """Adds ``kw_<label>``, ``pat_<label>``, ``fuzzy_<label>`` and ``score_<label>``."""
    keywords = keywords or fv.KEYWORDS
    patterns = patterns or fv.PATTERNS
    labels = list(keywords)
    out = df.withColumn("_lower", F.lower(F.col(text))).withColumn(
        "_words", word_total(F.col("_lower"))
    )
    low = F.col("_lower")
    out = out.withColumns(
        {f"kw_{k}": keyword_score(low, F.col("_words"), keywords[k], len(labels)) for k in labels}
        | {f"pat_{k}": pattern_score(low, patterns[k]) for k in labels}
    )
    if fuzzy:
        exact = F.array_compact(
            F.array(*[F.when(F.col(f"kw_{k}") > 0, F.lit(k)) for k in labels])
        )
        out = out.withColumn("_exact", exact)
        out = out.withColumn(
            "_fuzzy",
            F.when(F.size("_exact") > 0, fuzzy_udf(keywords)(F.col("_lower"), F.col("_exact"))),
        )
        near = {
            f"fuzzy_{k}": F.coalesce(F.col("_fuzzy")[i], F.lit(0.0)) for i, k in enumerate(labels)
        }
    else:
        near = {f"fuzzy_{k}": F.lit(0.0) for k in labels}
    out = out.withColumns(near)
    return out.withColumns(
        {
            f"score_{k}": 0.5 * F.col(f"kw_{k}")
            + 0.3 * F.col(f"pat_{k}")
            + 0.2 * F.col(f"fuzzy_{k}")
            for k in labels
        }
    )


def classify(
    df: DataFrame,
    text: str = "text",
    keywords: dict[str, list[str]] | None = None,
    patterns: dict[str, list[tuple[str, list[str]]]] | None = None,
    fuzzy: bool = False,
    keep_scores: bool = False,
) -> DataFrame:
    """Adds ``document_type`` and ``classifier_confidence``. Ties go to vocabulary order."""
    labels = list(keywords or fv.KEYWORDS)
    scored = score_types(df, text, keywords, patterns, fuzzy)
    total = _total([F.col(f"score_{k}") for k in labels])
    best = F.greatest(*[F.col(f"score_{k}") for k in labels])
    scored = scored.withColumns({"_total": total, "_best": best})
    share = F.col("_best") / F.col("_total")
    winner = F.coalesce(*[F.when(F.col(f"score_{k}") == F.col("_best"), F.lit(k)) for k in labels])
    nothing = F.col("_total") <= 0
    unclear = nothing | (F.col("_best") < 0.015) | (share < 0.40)
    label = F.when(unclear, F.lit("unknown")).otherwise(winner)
    confidence = F.when(unclear, F.lit(0.2)).otherwise(
        round_even(F.least(F.lit(0.98), F.greatest(F.lit(0.25), share + 0.15)), 4)
    )
    if "legal_complaint" in labels:
        strong = ~nothing & strong_complaint(
            F.col("_lower"), F.col("kw_legal_complaint"), F.col("pat_legal_complaint")
        )
        own = F.col("score_legal_complaint") / F.col("_total") + 0.45
        label = F.when(strong, F.lit("legal_complaint")).otherwise(label)
        confidence = F.when(
            strong, round_even(F.least(F.lit(0.95), F.greatest(F.lit(0.72), own)), 4)
        ).otherwise(confidence)
    out = scored.withColumns({"document_type": label, "classifier_confidence": confidence})
    drop = ["_lower", "_words", "_total", "_best", "_exact", "_fuzzy"]
    if not keep_scores:
        drop += [f"{p}_{k}" for p in ("kw", "pat", "fuzzy", "score") for k in labels]
    return out.drop(*drop)
