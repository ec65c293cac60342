"""Many languages, and pipeline stages on empty tables, clashing names and long texts."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lexloom.llm.exact_dedup import without_copies
from lexloom.llm.jaccard import one_of_each
from lexloom.llm.language import labels
from tests.llm.cases import AWKWARD, LONG, docs


@pytest.mark.parametrize("langs", [1, 3, 127, 128, 129, 200, 300])
def test_viterbi_against_all_steps_one_by_one(langs):
    rng = np.random.default_rng(langs)
    lengths = np.array([3, 0, 7, 1, 12])
    scores = rng.normal(size=(lengths.sum(), langs)).astype(np.float32)
    switch, found, at = 1.5, labels(scores, lengths, 1.5), 0
    for n in lengths:
        part = scores[at : at + n].astype(np.float64)

        def value(path, part=part):
            return sum(part[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))

        best = part[0].copy() if n else None
        for t in range(1, n):
            best = np.maximum(best, best.max() - switch) + part[t]
        if n:
            path = found[at : at + n].tolist()
            assert min(path) >= 0 and max(path) < langs and value(path) == pytest.approx(best.max(), abs=1e-3)
        at += n


def test_rows_keep_columns_of_any_name(spark):
    rows = [*AWKWARD, (20, LONG + " one end"), (21, "a b c d e f g"), (22, "a b c d e f g ")]
    table = docs(spark, rows)
    for stage in (without_copies, one_of_each):
        left = stage(table)
        assert left.columns == table.columns
        kept = left.collect()
        assert all(r[c] == "x" for r in kept for c in ("_d", "_n", "_first", "_digest", "_id", "_k", "_kept", "kept_id", "id", "digest", "row"))
    assert Counter(r.doc_id for r in without_copies(table).collect()) == Counter([3, 4, 5, 6, 8, 9, 20, 22])


def test_stages_on_empty_tables_and_awkward_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    for rows in ([], [*AWKWARD[:9], (30, LONG[:60_000])]):
        frame = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, frame, sf_dir)
            assert left.columns == frame.columns
            assert {r.doc_id for r in left.collect()} <= {i for i, _ in rows}
        assert corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).count() >= len(rows)
