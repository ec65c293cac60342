"""Words of a scan to page text and document text, and routing of poor scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import collapse


def scale_confidence(raw, engine: str = "percent"):
    """Engine confidence to [0, 1]: -1 counts as 0, percent is divided by 100."""
    value = F.col(raw) if isinstance(raw, str) else raw
    value = F.when(value < 0, 0.0).otherwise(value / 100 if engine == "percent" else value)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def _joined(ordered: str, part: str, glue: str):
    return F.array_join(F.transform(F.array_sort(ordered), lambda w: w[part]), glue)


def page_texts(words: DataFrame) -> DataFrame:
    """(doc_id, page_number, text, confidence, word_count) from one row per word.

    Blank words are dropped; sums of confidences are kept so that pages combine exactly.
    """
    clean = words.select(
        "doc_id", "page_number", "word_idx", collapse("text").alias("word"), "confidence"
    ).where(F.col("word") != "")
    return (
        clean.groupBy("doc_id", "page_number")
        .agg(
            F.collect_list(F.struct("word_idx", "word")).alias("ws"),
            F.sum("confidence").alias("confidence_sum"),
            F.count("*").alias("word_count"),
        )
        .select(
            "doc_id",
            "page_number",
            _joined("ws", "word", " ").alias("text"),
            (F.col("confidence_sum") / F.col("word_count")).alias("confidence"),
            "confidence_sum",
            "word_count",
        )
    )


def document_texts(pages: DataFrame) -> DataFrame:
    """Pages joined by form feeds; the average runs over all words, not over pages."""
    return (
        pages.groupBy("doc_id")
        .agg(
            F.collect_list(F.struct("page_number", "text")).alias("ps"),
            F.sum("confidence_sum").alias("s"),
            F.sum("word_count").alias("word_count"),
            F.count("*").alias("pages"),
        )
        .select(
            "doc_id",
            _joined("ps", "text", "\f").alias("text"),
            F.when(F.col("word_count") > 0, F.col("s") / F.col("word_count"))
            .otherwise(0.0)
            .alias("average_confidence"),
            "word_count",
            "pages",
        )
    )


def needs_second_engine(average, word_count, threshold: float = fv.LOW_WORD_CONFIDENCE):
    """A document without words counts as certain and is never routed."""
    score = F.when(F.coalesce(word_count, F.lit(0)) > 0, average).otherwise(F.lit(1.0))
    return score < threshold


def route_low_confidence(
    documents: DataFrame, first: DataFrame, second: DataFrame, threshold: float = fv.LOW_WORD_CONFIDENCE
) -> DataFrame:
    """Text of the second engine where the first one is unsure; its score stays the first one's."""
    a = first.select("doc_id", F.col("text").alias("t1"), "average_confidence", "word_count")
    b = second.select("doc_id", F.col("text").alias("t2"))
    low = needs_second_engine(F.col("average_confidence"), F.col("word_count"), threshold)
    return (
        documents.select("doc_id")
        .join(a, "doc_id", "left")
        .withColumn("rerouted", low)
        .join(b, "doc_id", "left")
        .select(
            "doc_id",
            "rerouted",
            F.when(F.col("rerouted"), F.coalesce("t2", F.lit("")))
            .otherwise(F.coalesce("t1", F.lit("")))
            .alias("text"),
            F.coalesce("average_confidence", F.lit(0.0)).alias("average_confidence"),
        )
    )
