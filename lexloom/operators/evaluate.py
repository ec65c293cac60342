"""Retrieval, draft and improvement quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import bind, collapse, fraction_of, round_even, token_set
from lexloom.operators.occurrences import enclosing, occurrences

_STRETCH = 1000


def normal_text(text: Column | str) -> Column:
    return F.lower(collapse(text))


def referenced_only(chunks: DataFrame, gold: DataFrame, path: str = "corpus_path") -> DataFrame:
    """Corpus restricted to the files that the gold snippets name."""
    return chunks.join(gold.select(path).where(F.col(path).isNotNull()).distinct(), path, "left_semi")


def _path_pairs(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """(corpus_path, gold_path): the file's path ends with the snippet's path.

    Every suffix of a *distinct* path is listed and equi-joined, so no pair is ever guessed.
    """
    paths = chunks.select("corpus_path").distinct()
    suffixes = paths.select(
        "corpus_path",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("corpus_path")),
                lambda i: F.substring(F.col("corpus_path"), i, F.length("corpus_path")),
            )
        ).alias("gold_path"),
    )
    wanted = gold.select(F.col("corpus_path").alias("gold_path")).distinct()
    return suffixes.join(wanted, "gold_path")


def match_gold(chunks: DataFrame, gold: DataFrame, both_ways: bool = True) -> DataFrame:
    """Relevant chunks: distinct (case_id, chunk_id) with the snippet that found them first.

    ``chunks`` has (chunk_id, corpus_path, chunk_index, text, char_start, char_end); ``gold`` has
    (case_id, snippet_no, corpus_path, start, end, text). A path must be a suffix of the chunk's
    path; a span then decides by inclusive overlap, and only without a span does the text.
    """
    gold = gold.withColumn("norm", normal_text(F.coalesce("text", F.lit(""))))
    spanned = F.col("start").isNotNull() & F.col("end").isNotNull()
    named = gold.where(F.col("corpus_path").isNotNull())
    by_path = named.withColumnRenamed("corpus_path", "gold_path").withColumn("spanned", spanned)
    on_path = (
        by_path.withColumnRenamed("text", "gold_text")
        .join(_path_pairs(chunks, named), "gold_path")
        .join(
            chunks.select(
                "chunk_id", "corpus_path", "chunk_index", "char_start", "char_end",
                normal_text("text").alias("chunk_norm"),
            ),
            "corpus_path",
        )
    )
    inside = F.col("chunk_norm").contains(F.col("norm"))
    if both_ways:
        inside = inside | F.col("norm").contains(F.col("chunk_norm"))
    overlap = (F.col("char_start") <= F.col("end")) & (F.col("char_end") >= F.col("start"))
    found = on_path.where(
        F.when(F.col("spanned"), overlap).otherwise((F.col("norm") != "") & inside)
    ).select("case_id", "snippet_no", "chunk_id", "chunk_index")

    free = gold.where(F.col("corpus_path").isNull())
    # Without a path a span alone decides, for chunks of every file: a range join by stretches.
    def stretches(low: str, high: str) -> Column:
        return F.explode(
            F.sequence(F.floor(F.col(low) / _STRETCH), F.floor(F.col(high) / _STRETCH))
        )

    free_spans = free.where(spanned & (F.col("start") <= F.col("end"))).select(
        "case_id", "snippet_no", "start", "end", stretches("start", "end").alias("stretch")
    )
    on_span = (
        chunks.select(
            "chunk_id", "chunk_index", "char_start", "char_end",
            stretches("char_start", "char_end").alias("stretch"),
        )
        .join(free_spans, "stretch")
        .where(overlap)
        .select("case_id", "snippet_no", "chunk_id", "chunk_index")
    )
    free_text = free.where(~spanned & (F.col("norm") != ""))
    left = chunks.select(F.col("chunk_id").alias("id"), normal_text("text").alias("norm"))
    right = free_text.select(
        F.concat_ws("\u0001", F.col("case_id").cast("string"), F.col("snippet_no")).alias("id"), "norm"
    )
    pairs = occurrences(left, right).select(
        F.col("text_id").alias("chunk_id"), F.col("pattern_id").alias("key")
    )
    if both_ways:
        inner = enclosing(right, left).select(
            F.col("pattern_id").alias("chunk_id"), F.col("text_id").alias("key")
        )
        pairs = pairs.unionByName(inner).distinct()
    keys = free_text.select(
        F.concat_ws("\u0001", F.col("case_id").cast("string"), F.col("snippet_no")).alias("key"),
        "case_id",
        "snippet_no",
    )
    loose = (
        pairs.join(keys, "key")
        .join(chunks.select("chunk_id", "chunk_index"), "chunk_id")
        .select("case_id", "snippet_no", "chunk_id", "chunk_index")
    )
    return (
        found.unionByName(on_span)
        .unionByName(loose)
        .groupBy("case_id", "chunk_id")
        .agg(F.min(F.struct("snippet_no", "chunk_index")).alias("found"))
        .select("case_id", "chunk_id", "found.snippet_no", "found.chunk_index")
    )


def first_hits(ranked: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """Per case with a relevant chunk: rank of the first hit and number of hits within each k.

    ``ranked`` has (case_id, chunk_id, rank). Cases without a relevant chunk are not counted.
    """
    cases = relevant.select("case_id").distinct()
    hits = ranked.join(relevant.select("case_id", "chunk_id"), ["case_id", "chunk_id"])
    counts = hits.groupBy("case_id").agg(
        F.min("rank").alias("first_hit_rank"),
        *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks],
    )
    return cases.join(counts, "case_id", "left").na.fill(0, [f"hits_{k}" for k in ks])


def retrieval_metrics(hits: DataFrame, ks: list[int]) -> DataFrame:
    """One row: recall@k, precision@k (always divided by k), MRR; four digits."""

    def mean(value: Column) -> Column:
        return round_even(F.coalesce(F.avg(value), F.lit(0.0)), 4)

    measures = []
    for k in ks:
        n = F.col(f"hits_{k}")
        measures.append(mean(F.when(n > 0, 1.0).otherwise(0.0)).alias(f"recall_{k}"))
        measures.append(mean(n / k).alias(f"precision_{k}"))
    return hits.agg(
        F.count("*").alias("total_queries"),
        *measures,
        mean(F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0))).alias("mrr"),
    )


def simple_retrieval_metrics(ranked: DataFrame, relevant: DataFrame, cases: DataFrame, k: int = 5):
    """Recall@k and MRR within the top k; a case without relevant chunk counts as a miss."""
    hits = (
        ranked.where(F.col("rank") <= k)
        .join(relevant.select("case_id", "chunk_id"), ["case_id", "chunk_id"])
        .groupBy("case_id")
        .agg(F.min("rank").alias("first_hit_rank"))
    )
    joined = cases.select("case_id").join(hits, "case_id", "left")
    hit = F.when(F.col("first_hit_rank").isNotNull(), 1.0).otherwise(0.0)
    return joined.agg(
        F.count("*").alias("cases"),
        round_even(F.coalesce(F.avg(hit), F.lit(0.0)), 4).alias(f"recall_{k}"),
        round_even(
            F.coalesce(F.avg(F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0))), F.lit(0.0)), 4
        ).alias("mrr"),
    )


def rouge_lite(candidate: Column | str, reference: Column | str) -> Column:
    """Share of the reference's token set that the candidate has."""
    return fraction_of(token_set(candidate), token_set(reference))


def evidence_support(content: Column | str, source: Column | str) -> Column:
    """Share of sentences with at least half of their tokens in the evidence; 1.0 when the text
    says that it is unsupported."""
    content = F.col(content) if isinstance(content, str) else content

    def supported(have: Column) -> Column:
        def enough(sentence: Column) -> Column:
            return bind(
                token_set(sentence),
                lambda own: (F.size(own) > 0)
                & (F.size(F.array_intersect(have, own)) / F.greatest(F.size(own), F.lit(1)) >= 0.5),
            )

        parts = F.filter(F.split(content, r"(?U)(?<=[.!?])\s+"), lambda s: F.btrim(s) != "")
        return bind(
            parts,
            lambda ps: F.when(F.size(ps) > 0, F.size(F.filter(ps, enough)) / F.size(ps)).otherwise(0.0),
        )

    return F.when(content.contains("[UNSUPPORTED:"), 1.0).otherwise(
        bind(token_set(source), supported)
    )


def draft_metrics(sections: DataFrame, cases: Column | None = None) -> DataFrame:
    """``sections``: (case_id, content, reference, source). One row over all sections."""
    blank = F.coalesce(F.col("reference"), F.lit("")) == ""
    honest = blank & F.col("content").contains("[UNSUPPORTED:")
    scored = sections.select(
        "case_id",
        rouge_lite("content", F.coalesce("reference", F.lit(""))).alias("rouge"),
        evidence_support("content", F.coalesce("source", F.lit(""))).alias("ground"),
        blank.alias("blank"),
        honest.alias("honest"),
    )
    blanks = F.count_if("blank")
    return scored.agg(
        F.count_distinct("case_id").alias("cases"),
        round_even(F.coalesce(F.avg("rouge"), F.lit(0.0)), 4).alias("rouge_lite"),
        round_even(F.coalesce(F.avg("ground"), F.lit(0.0)), 4).alias("groundedness"),
        round_even(
            F.when(blanks > 0, F.count_if("honest") / blanks).otherwise(F.lit(1.0)), 4
        ).alias("unsupported_honesty_rate"),
    )


def improvement_metrics(rows: DataFrame) -> DataFrame:
    """``rows``: (phase before/after, edited). Edit rates, drop, and whether it reaches 20 %."""

    def rate(phase: str) -> Column:
        mine = F.col("phase") == phase
        return F.coalesce(
            F.count_if(mine & F.col("edited")) / F.nullif(F.count_if(mine), F.lit(0)), F.lit(0.0)
        )

    rates = rows.agg(rate("before").alias("b"), rate("after").alias("a"))
    drop = F.col("b") - F.col("a")
    relative = F.when(F.col("b") != 0, drop / F.nullif(F.col("b"), F.lit(0.0))).otherwise(0.0)
    return rates.select(
        round_even("b", 4).alias("before_edit_rate"),
        round_even("a", 4).alias("after_edit_rate"),
        round_even(drop, 4).alias("absolute_drop"),
        round_even(relative, 4).alias("relative_drop"),
        F.when(F.col("b") != 0, relative >= 0.2).otherwise(False).alias("target_met"),
    )


def word_overlap(left: Column | str, right: Column | str) -> Column:
    """Number of distinct tokens in both texts."""
    return F.size(F.array_intersect(token_set(left), token_set(right)))


