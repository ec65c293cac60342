"""Exact top-k similarity over chunks.

Two shapes of work:

* *inside a document* - queries meet the chunks of their own document in an equi join; each pair is
  scored in its row. The join is skew-split by AQE, and ``row_number <= k`` keeps k rows per task
  before the shuffle (WindowGroupLimit), so a document of any size never sits in one task whole.
* *whole corpus* - queries and chunks meet by (list, block of queries, part of the list); every task
  keeps exactly its best k per query, so only that many candidates are shuffled. Without an index all
  chunks are one list; with one, lists whose bound is below a query's k-th score are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import fixed_values as fv
from lexloom.functions.hashing import (
    query_text, sparse_embedding, sparse_products, squared_norm,
)
from lexloom.functions.text import join_expansion, round_even
from lexloom.session import cut_lineage

BLOCK_QUERIES = 2000


def expand_queries(
    queries: DataFrame, expansions: DataFrame, always: bool = False, text: str = "query"
) -> DataFrame:
    """Queries extended from a table (query, expansion); a query without one stays as it is."""
    trimmed = F.btrim(F.col(text))
    right = expansions.select(
        F.btrim(F.col("query")).alias("_q"), F.col("expansion").alias("_e")
    ).dropDuplicates(["_q"])
    joined = queries.join(right, trimmed == F.col("_q"), "left")
    return joined.withColumn(text, join_expansion(F.col(text), F.col("_e"), always)).drop("_q", "_e")


def encode_queries(queries: DataFrame, text: str = "query", instruct: bool = True) -> DataFrame:
    """Adds ``qvec`` and ``qnorm2``."""
    source = query_text(F.col(text)) if instruct else F.col(text)
    encoded = queries.withColumn("qvec", sparse_embedding(source))
    return encoded.withColumn("qnorm2", squared_norm("qvec"))


def cosine_of(dot: Column, norm2: Column, qnorm2: Column) -> Column:
    """0.0 when either side is empty."""
    product = norm2.cast("double") * qnorm2.cast("double")
    return F.when(product > 0, dot.cast("double") / F.sqrt(product)).otherwise(F.lit(0.0))


def allowed_jurisdiction(tags: Column, jurisdiction: Column) -> Column:
    """Soft filter: documents without tags and chunks without a tag always pass."""
    return (
        (F.coalesce(F.size(tags), F.lit(0)) <= 0)
        | jurisdiction.isNull()
        | F.array_contains(tags, jurisdiction)
    )


def score_within_documents(
    chunks: DataFrame, queries: DataFrame, on: str = "document_id", tags: DataFrame | None = None
) -> DataFrame:
    """Scores of all (query, chunk) pairs that share ``on``.

    ``tags`` (document_id, tags) switches the jurisdiction filter on; it runs before scoring.
    """
    if tags is not None:
        chunks = chunks.join(tags.select("document_id", "tags"), "document_id", "left")
        chunks = chunks.where(allowed_jurisdiction(F.col("tags"), F.col("jurisdiction"))).drop("tags")
    pairs = chunks.join(queries.select("query_id", on, "qvec", "qnorm2"), on)
    dot = sparse_products("vec", "qvec")
    return pairs.withColumn("score", cosine_of(dot, F.col("norm2"), F.col("qnorm2"))).drop(
        "qvec", "qnorm2"
    )


def top_k(
    scored: DataFrame,
    per: list[str],
    k: int = fv.RETRIEVAL_TOP_K,
    min_score: float | None = fv.RETRIEVAL_MIN_SCORE,
    ties: list[str] | None = None,
) -> DataFrame:
    """Best k rows per group: unrounded filter, score descending, then ``ties``."""
    ties = ties or ["chunk_index"]
    kept = scored if min_score is None else scored.where(F.col("score") >= min_score)
    order = Window.partitionBy(*per).orderBy(F.desc("score"), *ties)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    min_score: float | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """Top-k per query and document. ``k`` of 0 or None means the default, as does no score."""
    floor = fv.RETRIEVAL_MIN_SCORE if min_score is None else min_score
    slim = chunks.select(
        *[c for c in ("chunk_id", "document_id", "chunk_index", "jurisdiction") if c in chunks.columns],
        "vec",
        "norm2",
    )
    scored = score_within_documents(slim, queries, tags=tags).drop("vec", "norm2")
    best = top_k(
        scored, ["query_id", "document_id"], k or fv.RETRIEVAL_TOP_K, floor, ["chunk_index", "chunk_id"]
    )
    return best.withColumn("similarity", round_even("score", 4))


def retrieve_many_documents(
    chunks: DataFrame, queries: DataFrame, k: int = fv.MULTI_DOCUMENT_TOP_K, **options
) -> DataFrame:
    """Per-document top-k of many documents in one job, sorted by score without a global cut."""
    return retrieve(chunks, queries, k, **options).orderBy(
        "query_id", F.desc("score"), "document_id", "chunk_index"
    )


_SCORED = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def _dense(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a matrix from lists of (dim, w)."""
    flat = vectors.flatten()
    return _filled(vectors, flat.field("dim"), flat.field("w"), width)


def _filled(lists: pa.Array, dims: pa.Array, weights: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    np.add.at(out, (row, dims.to_numpy(zero_copy_only=False)), weights.to_numpy(zero_copy_only=False))
    return out


def _first_k(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k, the smaller id first among equal scores."""
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        sure = np.flatnonzero(score > floor)
        tied = np.flatnonzero(score == floor)
        tied = tied[np.argsort(ids[tied], kind="stable")][: k - len(sure)]
        places = np.concatenate([sure, tied])
    else:
        places = np.arange(len(score))
    return places[np.lexsort((ids[places], -score[places]))]


#: A task makes matrices of so many rows at a time, however many rows a batch has.
_MATRIX_ROWS = 1 << 12


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


class _Asked:
    """The queries of one key and the best k chunks of each so far."""

    def __init__(self, k: int, block: int) -> None:
        self.k, self.block = k, block
        self.vectors: dict[str, tuple[np.ndarray, float]] = {}
        self.matrix: np.ndarray | None = None

    def add(self, names: list[str], vectors: np.ndarray, norm2: np.ndarray) -> None:
        for name, vector, n in zip(names, vectors, norm2):
            self.vectors.setdefault(name, (vector, n))  # a task may have the queries once for each of its salts

    def see(self, names: list[str], vectors: np.ndarray, norm2: np.ndarray) -> None:
        if not self.vectors:
            return
        if self.matrix is None:
            self.matrix = np.stack([v for v, _ in self.vectors.values()], axis=1)
            self.norm2 = np.array([n for _, n in self.vectors.values()])
            self.best = [(np.zeros(0), np.zeros(0, object)) for _ in self.vectors]
        ids = np.array(names, object)
        for at in range(0, len(self.best), self.block):
            part = slice(at, at + self.block)
            product = np.outer(norm2, self.norm2[part])
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(product > 0, (vectors @ self.matrix[:, part]) / np.sqrt(product), 0.0)
            for j, (held, known) in enumerate(self.best[part]):
                mine = _first_k(score[:, j], ids, self.k)
                both, every = np.concatenate([held, score[mine, j]]), np.concatenate([known, ids[mine]])
                keep = _first_k(both, every, self.k)
                self.best[at + j] = both[keep], every[keep]

    def found(self) -> Iterator[pa.RecordBatch]:
        for query_id, (held, names) in zip(self.vectors, self.best if self.matrix is not None else ()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([query_id] * len(held), pa.string()), pa.array(names, pa.string()), pa.array(held)],
                names=["query_id", "chunk_id", "score"],
            )


def _best_of_keys(k: int, block: int):
    """The best k of a task per query and key; rows are sorted by (list, block, is_chunk), so queries come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked = None, _Asked(k, block)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("list", "block", "is_chunk")])
            edges = [0, *(np.flatnonzero((parts[:, 1:] != parts[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for at, stop in pairwise(edges):
                if tuple(parts[:2, at]) != key:
                    yield from asked.found()
                    key, asked = tuple(parts[:2, at]), _Asked(k, block)
                rows = batch.slice(at, stop - at)
                handle = asked.see if parts[2, at] else asked.add
                for some in _slices(rows, _MATRIX_ROWS):
                    dims, weights = some.column("dims"), some.column("weights")
                    vectors = _filled(dims, dims.flatten(), weights.flatten(), fv.EMBEDDING_DIMENSIONS)
                    handle(some.column("id").to_pylist(), vectors, some.column("norm2").to_numpy().astype(np.float64))
        yield from asked.found()

    return run


def _met(chunks: DataFrame, visits: DataFrame, k: int, block: int, rows_a_task: int) -> DataFrame:
    """At least the best k chunks of its lists per query: (query_id, chunk_id, score).

    ``chunks`` has (list, id, vec, norm2), ``visits`` the same for queries and the lists that they visit. Lists are
    cut by their counts into parts of about ``rows_a_task`` chunks and blocks of queries; one plan serves any number of
    either. A task scores ``block`` queries at once; a chunk is sent once for ``BLOCK_QUERIES`` of them (or ``block``, if
    that is more), with its dimensions and weights as plain numbers, a fifth of the memory of structs.
    """
    load = (
        visits.groupBy("list").agg(F.ceil(F.count("*") / max(block, BLOCK_QUERIES)).alias("blocks"))
        .join(chunks.groupBy("list").agg(F.ceil(F.count("*") / rows_a_task).alias("salts")), "list")
    )

    def dealt(df: DataFrame, is_chunk: bool) -> DataFrame:
        spread, every = ("salts", "blocks") if is_chunk else ("blocks", "salts")
        one, all_of = F.pmod(F.xxhash64("id"), F.col(spread)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(every) - 1))
        block_no, salt = (all_of, one) if is_chunk else (one, all_of)
        plain = F.col("vec.dim").cast("array<smallint>").alias("dims"), F.col("vec.w").alias("weights")
        slim = df.select("list", "id", *plain, "norm2")
        return slim.join(load, "list").select("list", block_no.alias("block"), salt.alias("salt"), F.lit(is_chunk).alias("is_chunk"), "id", "dims", "weights", "norm2")

    rows = dealt(visits, False).unionByName(dealt(chunks, True))
    rows = rows.repartition("list", "block", "salt").sortWithinPartitions("list", "block", "is_chunk")
    return rows.mapInArrow(_best_of_keys(k, block), _SCORED)


def _slim(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").cast("string").alias("id"), "vec", F.coalesce("norm2", F.lit(0)).cast("double").alias("norm2"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("query_id").cast("string").alias("id"), F.col("qvec").alias("vec"), F.coalesce("qnorm2", F.lit(0)).cast("double").alias("norm2"))


def corpus_top_k(chunks: DataFrame, queries: DataFrame, k: int, block_queries: int = BLOCK_QUERIES, rows_a_task: int = 200_000) -> DataFrame:
    """Best k chunks of the whole corpus per query: (query_id, chunk_id, score, rank).

    All pairs are scored whatever the number of queries, block by block of them; a task sends k rows per
    query at most. A pair without a common dimension scores 0.0.
    """
    one = F.lit(0).alias("list")
    scored = _met(_slim(chunks).select(one, "*"), _asked(queries).select(one, "*"), k, block_queries, rows_a_task)
    return top_k(scored, ["query_id"], k, None, ["chunk_id"])


def _around_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their angles to the pivots; the last place stands for zero vectors. The first row of a task brings the pivots."""
    pivots = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if pivots is None:
            given = batch.column("pivots").slice(0, 1).flatten()
            pivots = _dense(given, fv.EMBEDDING_DIMENSIONS)
            pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), np.finfo(float).tiny)
        for some in _slices(batch, _MATRIX_ROWS // 4):
            x = _dense(some.column("vec"), fv.EMBEDDING_DIMENSIONS)
            norm = np.linalg.norm(x, axis=1)
            angles = np.arccos(np.clip((x @ pivots.T) / np.maximum(norm, np.finfo(float).tiny)[:, None], -1, 1))
            nearest = np.where(norm > 0, angles.argmin(1) if len(pivots) else 0, len(pivots))
            kept = [some.column(c) for c in ("id", "vec", "norm2")]
            wide = np.append(angles, np.zeros((len(x), 1)), axis=1)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * wide.shape[1])
            columns = [pa.array(nearest, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(wide.ravel()))]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=["id", "vec", "norm2", "list", "angles"])


def _placed(rows: DataFrame, pivots: Column) -> DataFrame:
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    kind = rows.schema["vec"].dataType.simpleString()
    out = f"id string, vec {kind}, norm2 double, list int, angles array<double>"
    return rows.withColumn("pivots", F.when(first, pivots)).mapInArrow(_around_pivots, out)


def write_lists(chunks: DataFrame, folder: str, lists: int = 64) -> None:
    """An index of coarse lists: each chunk in the list of its nearest pivot, with the range of angles of each list.

    Pivots are ``lists`` vectors drawn by digest; zero vectors have a list of their own.
    """
    rows = _slim(chunks)
    drawn = rows.where("norm2 > 0").select("vec").orderBy(F.xxhash64("vec")).limit(lists)
    spark = chunks.sparkSession
    drawn.agg(F.collect_list("vec").alias("pivots")).write.parquet(f"{folder}/pivots")  # at most ``lists`` vectors
    pivots = spark.read.parquet(f"{folder}/pivots").select("pivots").scalar()
    placed = _placed(rows, pivots).withColumn("angle", F.get("angles", "list")).drop("angles")
    placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(64))).write.parquet(f"{folder}/chunks")
    ranges = spark.read.parquet(f"{folder}/chunks").groupBy("list").agg(
        F.count("*").alias("n"), F.min("angle").alias("nearest"), F.max("angle").alias("farthest")
    )
    ranges.write.parquet(f"{folder}/ranges")


def list_top_k(spark: SparkSession, folder: str, queries: DataFrame, k: int, block_queries: int = BLOCK_QUERIES, rows_a_task: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """``corpus_top_k`` over the lists in ``folder``, and per query how many lists it skipped.

    No chunk of a list can score above the cosine of the least angle that the list's range allows (triangle
    inequality). A query first visits its most promising lists until they hold k chunks; of the others it
    then visits those whose bound reaches the k-th score so far. The result is exact.
    """
    chunks = spark.read.parquet(f"{folder}/chunks").select("list", "id", "vec", "norm2")
    ranges = spark.read.parquet(f"{folder}/ranges")
    pivots = spark.read.parquet(f"{folder}/pivots").select("pivots").scalar()
    asked = _placed(_asked(queries), pivots).drop("list").select("id", "vec", "norm2", F.posexplode("angles").alias("list", "angle"))
    zero = (F.col("norm2") == 0) | (F.col("list") == F.size(pivots))
    least = F.greatest(F.lit(0.0), F.col("angle") - F.col("farthest"), F.col("nearest") - F.col("angle"))
    bound = F.when(zero, F.lit(0.0)).otherwise(F.cos(least)) + 1e-9
    order = Window.partitionBy("id").orderBy(F.desc("bound"), "list")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    able = cut_lineage(asked.join(ranges, "list").withColumn("bound", bound).withColumn("sure", before < k).drop("angle", "nearest", "farthest"))
    columns = ["list", "id", "vec", "norm2"]
    early = cut_lineage(_met(chunks, able.where("sure").select(*columns), k, block_queries, rows_a_task))
    kth = top_k(early, ["query_id"], k, None, ["chunk_id"]).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    open_ = able.join(kth, "id", "left").withColumn("visited", F.col("sure") | F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
    late = _met(chunks, open_.where(F.col("visited") & ~F.col("sure")).select(*columns), k, block_queries, rows_a_task)
    best = top_k(early.unionByName(late), ["query_id"], k, None, ["chunk_id"])
    skipped = open_.groupBy(F.col("id").alias("query_id")).agg(F.count_if(~F.col("visited")).alias("skipped"), F.count("*").alias("lists"))
    return best, skipped


@F.pandas_udf(T.DoubleType())
def dense_cosine(left: pd.Series, right: pd.Series) -> pd.Series:
    """Cosine of two dense vectors per row; a zero vector counts as length one."""
    if left.empty:
        return pd.Series([], dtype="float64")
    a = np.stack(left.to_numpy()).astype(np.float64)
    b = np.stack(right.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    norm = [np.where(n == 0, 1.0, n) for n in norm]
    return pd.Series(np.einsum("ij,ij->i", a, b) / (norm[0] * norm[1]))


def best_per_chunk(scored: DataFrame) -> DataFrame:
    """Each chunk once with its best score over all queries; the first query wins a tie."""
    order = F.struct(F.col("score"), -F.col("query_no"))
    return scored.groupBy("document_id", "chunk_id", "chunk_index").agg(
        F.max("score").alias("score"),
        F.max_by("query_id", order).alias("query_id"),
    )


def keyword_support(
    chunks: DataFrame,
    documents: DataFrame,
    terms: list[str] | None = None,
    text: str = "text",
    document_type: str = "legal_complaint",
) -> DataFrame:
    """For complaints: the first three chunks that mention each of the fixed terms, at score 0.5.

    The chunks of all complaints are read once; the terms are constants of the plan.
    """
    terms = terms or fv.KEYWORD_SUPPORT_TERMS
    wanted = documents.where(F.col("document_type") == document_type).select("document_id")
    low = F.lower(F.col(text))
    hits = F.array_compact(
        F.array(*[F.when(low.contains(t.lower()), F.lit(i)) for i, t in enumerate(terms)])
    )
    mentions = (
        chunks.select("document_id", "chunk_id", "chunk_index", F.explode(hits).alias("term_no"))
        .join(wanted, "document_id", "left_semi")
    )
    order = Window.partitionBy("document_id", "term_no").orderBy("chunk_index", "chunk_id")
    return (
        mentions.withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= fv.KEYWORD_SUPPORT_PER_TERM)
        .groupBy("document_id", "chunk_id", "chunk_index")
        .agg(F.min("term_no").alias("term_no"))
        .withColumn("score", F.lit(fv.KEYWORD_SUPPORT_SCORE))
    )


def union_first(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose key is new. Both are read once.

    Keys are distinct within each input.
    """
    rest = [c for c in first.columns if c not in keys]
    both = first.withColumn("_from", F.lit(0)).unionByName(second.select(*first.columns).withColumn("_from", F.lit(1)))
    chosen = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_from").alias("_row")) if rest else both.select(*keys).distinct()
    return chosen.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in first.columns])


def select_diverse(
    candidates: DataFrame,
    k: int = fv.DRAFT_MAX_CHUNKS,
    window: int = fv.DIVERSITY_WINDOW,
    per_window: int = fv.DIVERSITY_PER_WINDOW,
) -> DataFrame:
    """At most two chunks per stretch of 20 first, by score; if short of k, the others by score.

    A document with no more than k candidates keeps them all in score order. All steps are windows
    over the candidates of a document, so they share one shuffle of one input.
    """
    stretch = F.floor(F.greatest(F.col("chunk_index"), F.lit(0)) / window)
    order = [F.desc("score"), "chunk_index", "chunk_id"]
    whole = Window.partitionBy("document_id")
    ranked = candidates.withColumn("_stretch", stretch).withColumns(
        {
            "_all": F.count(F.lit(1)).over(whole),
            "_rn": F.row_number().over(Window.partitionBy("document_id", "_stretch").orderBy(*order)),
        }
    )
    late = F.when(F.col("_all") <= k, F.lit(0)).otherwise((F.col("_rn") > per_window).cast("int"))
    placed = ranked.withColumn("_late", late)
    return (
        placed.withColumn("position", F.row_number().over(whole.orderBy("_late", *order)))
        .where(F.col("position") <= k)
        .drop("_stretch", "_rn", "_all", "_late")
    )


def draft_queries(draft_type: Column, document_type: Column, templates: dict | None = None) -> Column:
    """Queries of a draft: those of its template's sections, else those of its two types."""
    templates = templates or fv.DRAFT_TEMPLATES

    def listed(values) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    def chosen(table: dict, key: Column, default: Column) -> Column:
        out = default
        for name, values in table.items():
            out = F.when(key == name, listed(values)).otherwise(out)
        return out

    by_section = {name: [q for _, _, _, q in sections if q] for name, (_, sections) in templates.items()}
    spoken = F.array(F.replace(draft_type, F.lit("_"), F.lit(" ")))
    fallback = F.concat(chosen(fv.DRAFT_QUERIES, draft_type, spoken), chosen(fv.DOCUMENT_TYPE_QUERIES, document_type, listed([])))
    return chosen(by_section, draft_type, fallback)


def draft_candidates(
    chunks: DataFrame,
    documents: DataFrame,
    tags: DataFrame | None = None,
    max_chunks: int = fv.DRAFT_MAX_CHUNKS,
    templates: dict | None = None,
) -> DataFrame:
    """Evidence for the drafts of all documents in one job.

    ``documents`` has (document_id, document_type, draft_type). Every query keeps max(5 k, 30) chunks
    per document, a chunk keeps its best score, keyword support joins in, and the diverse selection
    makes the result. Chunks are scored once.
    """
    kinds = documents.select("draft_type", "document_type").distinct()
    listed = kinds.select("*", F.posexplode(draft_queries(F.col("draft_type"), F.col("document_type"), templates)).alias("query_no", "query"))
    encoded = encode_queries(listed).drop("query")
    asked = documents.select("document_id", "draft_type", "document_type").join(encoded, ["draft_type", "document_type"])
    asked = asked.select(F.col("query_no").cast("string").alias("query_id"), "document_id", "qvec", "qnorm2")
    slim = chunks.select("chunk_id", "document_id", "chunk_index", "jurisdiction", "vec", "norm2")
    scored = score_within_documents(slim, asked, tags=tags).drop("vec", "norm2")
    best = top_k(
        scored, ["query_id", "document_id"], max(max_chunks * 5, 30), 0.0, ["chunk_index", "chunk_id"]
    )
    per_chunk = best_per_chunk(
        best.withColumns({"query_no": F.col("query_id").cast("int"), "score": round_even("score", 4)})
    ).select("document_id", "chunk_id", "chunk_index", "score")
    support = keyword_support(chunks, documents).select(*per_chunk.columns)
    return select_diverse(union_first(per_chunk, support, ["document_id", "chunk_id"]), max_chunks)
