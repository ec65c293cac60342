import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexloom.llm.centroids import Nearest, clustered
from tests.llm.cases import CLASHING

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("largest, k, dims", [(50, 40, 64), (3, 7, 2), (2, 40, 3), (1 << 27, 5, 64), (0, 3, 2), (9, 1, 4)])
def test_walk_finds_what_brute_force_finds(largest, k, dims):
    rng = np.random.default_rng(k)
    x, c = (rng.integers(-largest, largest + 1, (n, dims)) for n in (1500, k))
    number, distance = Nearest(c).of(x)
    full = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (distance == full.min(axis=1)).all() and (number == full.argmin(axis=1)).all()


def brute(rows, k, dims, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    draw = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in draw[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[near(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for c, m in zip(centroids, members)]
    placed = [(i, near(v)) for i, v in kept]
    spent = [sum(d for _, (d, n) in placed if n == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, spent[n], sum(spent), digest[n]) for i, (d, n) in placed), key=repr)


def rows_of(n, dims, seed):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, dims)]) for i in range(n)]


def test_clustered(spark):
    vectors = rows_of(120, 4, 1)
    odd = [(200, None), (201, []), (202, [1.0]), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan"), 0.0, 0.0, 0.0])]
    odd += [(205, [float("-inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5]), (206, [0.0] * 5)]
    hot = [(300 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(90)]
    rows = vectors + odd + hot + vectors[:3]  # repeated rows
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in [*CLASHING, "cluster", "v", "distance"]})
    found = clustered(table.repartition(5), k=9, dims=4, rounds=3)
    assert found.columns[:3] == ["vec_id", "cluster", "distance"]
    assert sorted((tuple(r)[:6] for r in found.collect()), key=repr) == brute(rows, 9, 4, 3)


def test_fewer_vectors_than_centroids_and_empty_table(spark):
    rows = rows_of(3, 2, 2)
    found = clustered(spark.createDataFrame(rows, SCHEMA), k=5, dims=2)
    assert sorted((tuple(r)[:6] for r in found.collect()), key=repr) == brute(rows, 5, 2, 5)
    assert clustered(spark.createDataFrame([], SCHEMA), k=5, dims=2).count() == 0
    assert clustered(spark.createDataFrame([(1, None)], SCHEMA), k=5, dims=2).count() == 0


def test_components_too_large_for_a_long_stop_the_job(spark):
    with pytest.raises(PySparkException, match="beyond"):
        clustered(spark.createDataFrame([(1, [1e30, 0.0])], SCHEMA), k=1, dims=2).collect()
