"""Ordered work on groups of any size: rows are range-partitioned by (group, order) and each task works on its range.

A group that fills several tasks is put together from what each of them made of its part, so no task holds
a group and none gets more rows than another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.session import cut_lineage


def in_ranges(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows sorted by (group, order) over the tasks and inside each, with the task's number as ``_part``.

    Rows that are equal in all of these may still be many; they are told apart by their place in the input.
    """
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first(c) for c in (group, *order, "_tie")]
    ranged = tie.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ranged.withColumn("_part", F.spark_partition_id()).drop("_tie")


def _composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Columns (lo, hi, shift) of x -> min(hi, max(lo, x + shift)); one after the other is again such a step."""
    lo, hi = (np.minimum(then[:, 1], np.maximum(then[:, 0], first[:, k] + then[:, 2])) for k in (0, 1))
    return np.stack([lo, hi, first[:, 2] + then[:, 2]], axis=1)


def folded(groups: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step for each run of equal groups: neighbours are composed pair by pair, halving the rows each time."""
    while len(groups) > 1:
        begins = np.concatenate([[True], groups[1:] != groups[:-1]])
        first = np.flatnonzero(begins)
        if len(first) == len(groups):
            break
        place = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))
        left = np.flatnonzero(place % 2 == 0)
        paired = np.append(~begins[1:], False)[left]
        made = steps[left]
        made[paired] = _composed(steps[left[paired]], steps[left[paired] + 1])
        groups, steps = groups[left], made
    return groups, steps


def _fold(low: float, high: float):
    schema = ["grp", "part", "lo", "hi", "shift"]

    def run(batches):
        held, part = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("_part")[0].as_py()
            shift = batch.column("shift").to_numpy()
            steps = np.stack([np.full(len(shift), low), np.full(len(shift), high), shift], axis=1)
            groups = np.array(batch.column("grp").to_pylist(), object)
            if held is not None:
                groups, steps = np.append(held[0], groups), np.concatenate([held[1], steps])
            groups, steps = folded(groups, steps)
            held = groups[-1:], steps[-1:]
            if len(groups) > 1:
                yield _pieces(groups[:-1], part, steps[:-1], schema)
        if held is not None:
            yield _pieces(held[0], part, held[1], schema)

    return run


def _pieces(groups, part, steps, names):
    columns = [pa.array(groups.tolist(), pa.string()), pa.array([part] * len(groups), pa.int32()), *(pa.array(steps[:, k]) for k in range(3))]
    return pa.RecordBatch.from_arrays(columns, names=names)


def fold_clamped(df: DataFrame, group: str, order: list[str], shift: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(group, lo, hi, shift): all clamped additions of a group, in order, as one.

    Each row is x -> min(high, max(low, x + shift)). A task folds its stretch of each group to one step,
    whatever the number of rows; a group then has at most one step for each task, and these are folded.
    """
    ranged = in_ranges(df, group, *order)
    rows = ranged.select(F.col(group).cast("string").alias("grp"), "_part", F.coalesce(shift, F.lit(0.0)).cast("double").alias("shift"))
    pieces = rows.mapInArrow(_fold(low, high), "grp string, part int, lo double, hi double, shift double")

    def clamp(value: Column, s: Column) -> Column:
        return F.least(s["hi"], F.greatest(s["lo"], value))

    identity = F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0.0).alias("shift"))
    whole = F.aggregate(
        F.array_sort(F.collect_list(F.struct("part", "lo", "hi", "shift"))),
        identity,
        lambda a, s: F.struct(
            clamp(a["lo"] + s["shift"], s).alias("lo"), clamp(a["hi"] + s["shift"], s).alias("hi"), (a["shift"] + s["shift"]).alias("shift")
        ),
    )
    return pieces.groupBy("grp").agg(whole.alias("step")).select(F.col("grp").alias(group), "step.*")


def _number(schema: T.StructType):
    def run(batches):
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.array(batch.column("_group").to_pylist(), object)
            begins = np.concatenate([[count == 0 or groups[0] != last], groups[1:] != groups[:-1]])
            first = np.flatnonzero(np.append(True, begins[1:]))
            number = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups)))) + 1
            if not begins[0]:
                number[: first[1] if len(first) > 1 else None] += count
            last, count = groups[-1], int(number[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], names=[*batch.schema.names, "_number"])

    return run


def numbered(df: DataFrame, keys: list[Column | str], order: list[str], name: str) -> DataFrame:
    """Rows with their place (from 1) among those of equal keys, like ``row_number``, for groups of any size.

    Tasks number their own ranges; a table with one row for each task then says how many rows of its first
    group came in the tasks before.
    """
    group = df.withColumn("_group", F.to_json(F.struct(*[F.col(k) if isinstance(k, str) else k for k in keys]), {"ignoreNullFields": "false"}))
    ranged = in_ranges(group, "_group", *order)
    schema = T.StructType([*ranged.schema.fields, T.StructField("_number", T.LongType())])
    rows = cut_lineage(ranged.mapInArrow(_number(schema), schema))
    ends = rows.groupBy("_part").agg(
        F.min("_group").alias("first"), F.max(F.struct("_group", "_number")).alias("last"), F.count_distinct("_group").alias("n")
    )
    # groups are in order of their strings, so the first of a task is the least and the last the greatest
    before, before_last, offsets = None, 0, []
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row for each task
        offset = before_last if r["first"] == before else 0
        offsets.append((r["_part"], r["first"], offset))
        before, before_last = r["last"]["_group"], r["last"]["_number"] + (offset if r["n"] == 1 else 0)
    known = df.sparkSession.createDataFrame(offsets, "_part int, _first string, _before long")
    place = F.col("_number") + F.when(F.col("_group") == F.col("_first"), F.col("_before")).otherwise(F.lit(0))
    return rows.join(F.broadcast(known), "_part").withColumn(name, place).drop("_part", "_group", "_number", "_first", "_before")
