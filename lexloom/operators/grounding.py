"""Grounding of drafted text. Column functions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import as_col, bind, round_even, strip, word_total


def sentences(content: Column | str) -> Column:
    """Split behind ``.!?`` and white space, or behind ``]`` at a line end; blanks dropped."""
    parts = F.split(strip(content), "(?U)" + fv.GROUNDING_SENTENCE_END)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + fv.GROUNDING_WORD), F.lit(0))


def qualifies(sentence: Column) -> Column:
    """Eight words or more, one of them a capitalised word of over two letters or a legal noun."""
    nouns = F.array(*[F.lit(n) for n in fv.GROUNDING_NOUNS])

    def enough(parts: Column) -> Column:
        capital = F.exists(parts, lambda w: (F.length(w) > 2) & w.rlike(r"\A\p{Lu}"))
        return (F.size(parts) >= 8) & (
            capital | F.arrays_overlap(F.transform(parts, lambda w: F.lower(w)), nouns)
        )

    return bind(tokens(sentence), enough)


def grounding_counts(content: Column | str) -> Column:
    """Struct of qualifying and grounded sentences."""

    def counts(kept: Column) -> Column:
        cited = F.filter(
            kept,
            lambda s: s.rlike("(?iU)" + fv.GROUNDING_CITATION)
            & ~s.rlike("(?i)" + fv.GROUNDING_UNSUPPORTED),
        )
        return F.struct(F.size(kept).alias("qualifying"), F.size(cited).alias("grounded"))

    return bind(F.filter(sentences(F.coalesce(as_col(content), F.lit(""))), qualifies), counts)


def grounding_score(content: Column | str) -> Column:
    """Share of qualifying sentences with a citation; 1.0 when none qualifies."""
    return bind(
        grounding_counts(content),
        lambda n: F.when(
            n["qualifying"] > 0, round_even(n["grounded"] / n["qualifying"], 2)
        ).otherwise(1.0),
    )


def grounding_words(content: Column | str) -> Column:
    return F.size(tokens(F.coalesce(as_col(content), F.lit(""))))


def score_sections(sections: DataFrame) -> DataFrame:
    """Adds ``grounding_score`` to one row per section."""
    return sections.withColumn("grounding_score", grounding_score("content"))


def draft_scores(sections: DataFrame, key: str = "draft_id") -> DataFrame:
    """Overall grounding (mean weighted by words, NULL without words) and word count per draft.

    The weights count word tokens, the word count counts white-space tokens.
    """
    weighted = sections.select(
        key,
        grounding_words("content").alias("w"),
        F.coalesce("grounding_score", grounding_score("content")).alias("score"),
        word_total(F.coalesce("content", F.lit(""))).alias("n"),
    )
    return weighted.groupBy(key).agg(
        round_even(
            F.sum(F.col("score") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0)), 2
        ).alias("overall_grounding_score"),
        F.sum("n").alias("word_count"),
    )
