"""Chunk tables: cut, annotate, tag, embed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import fixed_values as fv
from lexloom.functions.chunker import CHUNK_FIELDS, chunk_rows
from lexloom.functions.hashing import sparse_embedding, squared_norm
from lexloom.operators.jurisdiction import jurisdiction_tags, primary_tag
from lexloom.operators.terms import annotate


def chunk_documents(
    df: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP,
    sections: bool = True,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per chunk with a deterministic ``chunk_id``. Narrow: reads only the named columns."""
    keep = keep or []
    read = df.select(F.col(doc).alias("document_id"), *keep, F.col(text).alias("_text"))
    schema = T.StructType([*read.drop("_text").schema.fields, *CHUNK_FIELDS.fields])
    rows = read.mapInArrow(chunk_rows("_text", size, overlap, sections), schema)
    chunk_id = F.concat_ws("::", F.col("document_id").cast("string"), F.col("chunk_index"))
    return rows.select(chunk_id.alias("chunk_id"), "*")


def add_embedding(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``vec`` (sparse counts) and ``norm2``."""
    encoded = df.withColumn("vec", sparse_embedding(F.col(text)))
    return encoded.withColumn("norm2", squared_norm("vec"))


def embed_documents(df: DataFrame, doc: str = "doc_id", text: str = "text", terms: str | None = None):
    """The stored chunk table: annotated text and its vector, jurisdiction of the raw text.

    ``raw_text`` is kept for the contradiction scan, which must not see the annotations.
    """
    chunks = chunk_documents(df, doc, text, keep=[terms] if terms else None)
    chunks = chunks.withColumnRenamed("text", "raw_text")
    stored = annotate(F.col("raw_text"), F.col(terms)) if terms else F.col("raw_text")
    tagged = chunks.withColumns(
        {
            "text": stored,
            "jurisdiction": primary_tag(jurisdiction_tags(F.col("raw_text"))),
        }
    )
    if terms:
        tagged = tagged.drop(terms)
    return add_embedding(tagged, "text")


def replace_chunks(current: DataFrame, fresh: DataFrame, doc: str = "document_id") -> DataFrame:
    """Replace by document: old chunks of every re-embedded document go, the new ones come."""
    kept = current.join(fresh.select(doc).distinct(), doc, "left_anti")
    return kept.unionByName(fresh.select(*current.columns))
