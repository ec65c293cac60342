"""Drafting preferences learned from edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import strip, words
from lexloom.operators.components import components
from lexloom.operators.scan import fold_clamped
from lexloom.session import cut_lineage


def is_trivial_edit(original: Column | str, edited: Column | str) -> Column:
    """Equal but for white space at the ends, or equal word by word and about as long."""
    a = F.col(original) if isinstance(original, str) else original
    b = F.col(edited) if isinstance(edited, str) else edited
    return (strip(a) == strip(b)) | (
        (F.abs(F.length(b) - F.length(a)) < 20) & (words(a) == words(b))
    )


def _score() -> Column:
    return F.col("application_count") * 0.6 + F.col("confidence") * 0.4


def best_preferences(preferences: DataFrame, n: int | None = None) -> DataFrame:
    """The n best rules per tenant and document type, by use and confidence."""
    order = Window.partitionBy("tenant_id", "document_type").orderBy(F.desc("_s"), "preference_id")
    ranked = preferences.withColumn("_s", _score()).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= (n or fv.PREFERENCES_PER_DRAFT)).drop("_s")


def with_source_edit(preferences: DataFrame, edits: DataFrame) -> DataFrame:
    """Rules with the texts of the edit that they were learned from, if it is known."""
    sources = edits.select(
        F.col("edit_id").alias("source_edit_id"), "original_content", "edited_content"
    )
    return preferences.join(sources, "source_edit_id", "left")


def few_shot_pairs(preferences: DataFrame, edits: DataFrame, n: int = fv.FEW_SHOT_PAIRS) -> DataFrame:
    """Of the n best rules, those with a known edit."""
    best = best_preferences(preferences, n)
    return with_source_edit(best, edits).where(F.col("original_content").isNotNull())


def count_applications(preferences: DataFrame, drafts: DataFrame) -> DataFrame:
    """Adds one application per draft to each rule it used."""
    used = (
        drafts.select(F.explode("preferences_applied").alias("preference_id"))
        .groupBy("preference_id")
        .agg(F.count("*").alias("_n"))
    )
    joined = preferences.join(used, "preference_id", "left")
    return joined.withColumn(
        "application_count", F.col("application_count") + F.coalesce("_n", F.lit(0))
    ).drop("_n")


def review_delta(edited: Column, total: Column) -> Column:
    """An unedited review adds 0.10; an edited one takes 0.05 times the share of edited sections."""
    return F.when(edited == 0, F.lit(fv.EFFECTIVENESS_GAIN)).otherwise(
        -fv.EFFECTIVENESS_LOSS * edited / F.greatest(total, F.lit(1))
    )


def update_effectiveness(preferences: DataFrame, reviews: DataFrame) -> DataFrame:
    """Effectiveness after all reviews, clamped to [0, 1] after each of them.

    ``reviews`` has (preferences_applied, edited_sections, total_sections, reviewed_at, draft_id).
    Order matters, yet runs of clamped additions compose: each task folds its stretch of time of a
    rule, so one that every draft uses is spread like any other.
    """
    steps = reviews.select(
        F.explode("preferences_applied").alias("preference_id"),
        "reviewed_at",
        "draft_id",
        review_delta(F.col("edited_sections"), F.col("total_sections")).alias("delta"),
    ).where(F.col("preference_id").isNotNull())
    whole = fold_clamped(steps, "preference_id", ["reviewed_at", "draft_id", "delta"], "delta")
    start = F.coalesce("effectiveness_score", F.lit(fv.DEFAULT_EFFECTIVENESS))
    moved = F.least(F.col("hi"), F.greatest(F.col("lo"), start + F.col("shift")))
    joined = preferences.join(whole, "preference_id", "left")
    return joined.withColumn(
        "effectiveness_score",
        F.when(F.col("lo").isNotNull(), moved).otherwise(F.col("effectiveness_score")),
    ).drop("lo", "hi", "shift")


_PLACED = "node string, grp string, learned boolean, vector array<double>, cell int, angle double, angles array<double>"
_EDGES = "a string, b string"
_SLACK = 1e-6


def _around_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors with their angles to the pivots; the first row of a task brings these."""
    pivots = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if pivots is None:
            pivots = np.array(batch.column("pivots")[0].as_py(), np.float64)
        x = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        angles = np.arccos(np.clip(x @ pivots.T, -1, 1))
        cell = angles.argmin(1)
        of_learned = [row if learned else None for row, learned in zip(angles.tolist(), batch.column("learned").to_pylist())]
        columns = [pa.array(list(x), pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(angles.min(1)), pa.array(of_learned, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "grp", "learned")), *columns], names=["node", "grp", "learned", "vector", "cell", "angle", "angles"])


class _Asked:
    """The learned rules of one key, and how the rows that passed connect them."""

    def __init__(self) -> None:
        self.nodes: list[str] = []
        self.vectors: list[np.ndarray] = []
        self.matrix = None

    def closed(self) -> None:
        if self.matrix is None:
            self.matrix = np.concatenate(self.vectors) if self.vectors else np.zeros((0, 1))
            self.parent = list(range(len(self.nodes)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def edges_of(self, names: list[str], rows: np.ndarray, threshold: float) -> list[tuple[str, str]]:
        self.closed()
        if not len(self.matrix):
            return []
        near = rows @ self.matrix.T >= threshold
        found = []
        for i in np.flatnonzero(near.any(1)):
            first, *others = np.flatnonzero(near[i]).tolist()
            found.append((names[i], self.nodes[first]))
            for other in others:
                self.parent[self.root(other)] = self.root(first)
        return found

    def links(self) -> list[tuple[str, str]]:
        self.closed()
        return [(node, self.nodes[self.root(i)]) for i, node in enumerate(self.nodes) if self.root(i) != i]


def _alike(threshold: float):
    """Edges between rules and the learned rules of their key; rows are sorted by (key, is_row).

    A row gives one edge, to its first learned rule; what else it connects is kept as links between the
    learned rules of the key and sent when the key ends. So a key gives rows + learned rules edges at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked = None, _Asked()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
            names, is_row = batch.column("node").to_pylist(), np.array(batch.column("is_row").to_pylist())
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "cell", "block", "salt"))))
            changes = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or is_row[i] != is_row[i - 1]]
            edges: list[tuple[str, str]] = []
            for at, stop in zip(changes, [*changes[1:], len(keys)]):
                if keys[at] != key:
                    edges += asked.links()
                    key, asked = keys[at], _Asked()
                if is_row[at]:
                    edges += asked.edges_of(names[at:stop], rows[at:stop], threshold)
                else:
                    asked.nodes += names[at:stop]
                    asked.vectors.append(rows[at:stop].copy())
            yield _edge_batch(edges)
        yield _edge_batch(asked.links())

    return run


def _edge_batch(edges: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.string()) for k in (0, 1)], names=["a", "b"])


def similar_rules(rules: DataFrame, threshold: float, block: int = 1000, rows_a_task: int = 50_000, pivots: int = 16) -> DataFrame:
    """Edges (a, b) that connect every learned rule with all rules of its group at the threshold or above.

    ``rules`` has (node, grp, learned, vector), one row for each node. Angles obey the triangle inequality, so the
    angles to a few pivots rule most rules out: each rule lies in the cell of its nearest pivot, and a learned rule
    visits a cell only if the cell's range of angles, and its distance beyond the border, come within the threshold's
    angle. Learned rules and cells meet in an equi join; cells are cut by their counts into blocks of about
    ``block`` learned rules and parts of about ``rows_a_task`` rules. The plan is the same for any number of rules.
    Pivots decide only how much is ruled out. Zero vectors are similar to nothing.
    """
    reach = float(np.arccos(threshold)) + _SLACK
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    some = rules.where((square > 0) & (square < float("inf"))).select("node", "grp", "learned", "vector")
    unit = F.transform("vector", lambda x: x / F.sqrt(F.col("square")))
    drawn = some.select("vector", square.alias("square"), F.xxhash64("vector").alias("h")).orderBy("h").limit(pivots)
    chosen = drawn.agg(F.collect_list(unit)).scalar()  # a fixed number of vectors
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    placed = cut_lineage(some.withColumn("pivots", F.when(first, chosen)).mapInArrow(_around_pivots, _PLACED))
    cells = placed.groupBy("grp", "cell").agg(F.min("angle").alias("nearest"), F.max("angle").alias("farthest"), F.count("*").alias("n_rows"))
    visits = placed.where("learned").select("node", "grp", "vector", F.col("angle").alias("own"), F.posexplode("angles").alias("cell", "angle"))
    near = F.col("angle").between(F.col("nearest") - reach, F.col("farthest") + reach) & (F.col("angle") <= F.col("own") + 2 * reach)
    visits = visits.join(cells, ["grp", "cell"]).where(near).select("grp", "cell", "node", "vector")
    load = visits.groupBy("grp", "cell").agg(F.count("*").alias("n_asked")).join(cells, ["grp", "cell"])
    load = load.select(
        "grp", "cell", F.ceil(F.col("n_asked") / block).alias("blocks"), F.ceil(F.col("n_rows") / rows_a_task).alias("salts")
    )

    def dealt(df: DataFrame, counted: str, spread: str, is_row: bool) -> DataFrame:
        one, every = F.pmod(F.xxhash64("node"), F.col(counted)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(spread) - 1))
        block_no, salt = (every, one) if is_row else (one, every)
        return df.join(load, ["grp", "cell"]).select("grp", "cell", block_no.alias("block"), salt.alias("salt"), F.lit(is_row).alias("is_row"), "node", "vector")

    key = ["grp", "cell", "block", "salt"]
    met = dealt(visits, "blocks", "salts", False).unionByName(dealt(placed.select("grp", "cell", "node", "vector"), "salts", "blocks", True))
    return met.repartition(*key).sortWithinPartitions(*key, "is_row").mapInArrow(_alike(threshold), _EDGES).where("a <> b")


def merge_rules(existing: DataFrame, learned: DataFrame, threshold: float = fv.DEDUP_THRESHOLD, block: int = 1000) -> DataFrame:
    """Existing and newly learned rules with near duplicates merged.

    Learned rules are compared with all rules of their tenant and type; similar ones are connected, and
    each connected group with a learned rule is merged: into the best existing rule (by use and
    confidence), which takes over the text of the most confident learned one if that is more confident
    than itself, else into the earliest learned rule with that text. Other existing rules stay. The
    result does not depend on the order of arrival within a run. Rules of one vector are compared once.

    Both tables: (tenant_id, document_type, preference_id, preference_text, source_edit_id, vector,
    confidence, application_count, effectiveness_score, created_at); preference_id is unique.
    """
    columns = ["tenant_id", "document_type", "preference_id", "preference_text", "source_edit_id", "confidence", "application_count", "effectiveness_score"]
    group = F.to_json(F.struct("tenant_id", "document_type"))
    given = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, F.lit(fv.DEFAULT_RULE_CONFIDENCE)).otherwise(F.col("confidence"))
    fresh = learned.where(F.coalesce("preference_text", F.lit("")) != "").withColumns({"confidence": given, "stored": F.lit(False)})
    both = existing.withColumn("stored", F.lit(True)).unionByName(fresh).withColumn("grp", group)
    both = both.withColumn("vector", F.col("vector").cast("array<double>"))
    zero = F.coalesce(F.forall("vector", lambda x: x == 0), F.lit(True))
    alone = F.concat(F.lit("="), F.col("preference_id"))
    # stored rules of one vector are alike only if a learned rule is like them
    both = both.withColumn("node", F.when(zero, alone).otherwise(F.sha2(F.to_json(F.struct("grp", "stored", "vector")), 256)))
    rules = both.groupBy("node").agg(F.first("grp").alias("grp"), F.bool_and(~F.col("stored")).alias("learned"), F.first("vector").alias("vector"))
    edges = similar_rules(rules, threshold, block)
    placed = both.drop("vector").join(components(edges), "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", F.when(F.col("stored"), alone).otherwise(F.col("node"))))
    ahead = F.struct(-_score(), F.col("preference_id"))
    early = F.struct("created_at", "preference_id")
    sure = F.struct(-F.col("confidence"), F.col("created_at"), F.col("preference_id"))
    best = placed.groupBy("component").agg(
        F.min_by("preference_id", F.when(F.col("stored"), ahead)).alias("stored_id"),
        F.min_by("preference_id", F.when(~F.col("stored"), early)).alias("new_id"),
        F.min_by(F.struct("preference_text", "confidence"), F.when(~F.col("stored"), sure)).alias("best"),
    )
    joined = placed.join(best, "component").where(F.col("stored") | (F.col("stored_id").isNull() & (F.col("preference_id") == F.col("new_id"))))
    better = F.col("best").isNotNull() & (
        ~F.col("stored") | ((F.col("preference_id") == F.col("stored_id")) & (F.col("best.confidence") > F.coalesce("confidence", F.lit(0.0))))
    )
    return joined.withColumns(
        {
            "preference_text": F.when(better, F.col("best.preference_text")).otherwise(F.col("preference_text")),
            "confidence": F.when(better, F.col("best.confidence")).otherwise(F.col("confidence")),
            "application_count": F.when(F.col("stored"), F.col("application_count")).otherwise(F.lit(0)),
            "effectiveness_score": F.when(F.col("stored"), F.col("effectiveness_score")).otherwise(F.lit(fv.DEFAULT_EFFECTIVENESS)),
        }
    ).select(*columns)
