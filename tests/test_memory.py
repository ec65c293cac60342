"""What a task holds does not grow with the rows of a batch."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lexloom.functions import fixed_values as fv
from lexloom.functions import hashing
from lexloom.operators import retrieve


def _vectors(texts):
    out = []
    for text in texts:
        totals = Counter()
        for token in (text or "").lower().split():
            dim, sign = hashing._hash_token(token)
            totals[dim] += sign
        out.append([{"dim": d, "w": w} for d, w in sorted(totals.items()) if w])
    return out


def test_texts_are_encoded_slice_by_slice(monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)] + ["É", "\U0001f600", "İx", "Fee"]
    texts = [None, "", "  "] + [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(200)]
    sizes, encoded = [], hashing._encoded
    monkeypatch.setattr(hashing, "_SLICE_CHARS", 1000)
    monkeypatch.setattr(hashing, "_encoded", lambda tokens, codes: sizes.append(len(tokens)) or encoded(tokens, codes))
    got = list(hashing.sparse_embedding.func(iter([pa.array(texts), pa.array([], pa.string()), pa.array(texts[:5])])))
    assert [g.to_pylist() for g in got] == [_vectors(texts), [], _vectors(texts[:5])]
    assert len(sizes) > 20 and max(sizes) < len(texts)


def test_matrices_hold_some_rows_of_a_batch(monkeypatch):
    texts = [f"a{i % 7} b{i % 11} c{i}" for i in range(50)] + [""]
    vectors = pa.array(_vectors(texts), pa.list_(pa.struct([("dim", pa.int32()), ("w", pa.int32())])))
    pivots = pa.array([_vectors(texts[:3])] + [None] * 50, pa.list_(vectors.type))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(51)]), vectors, pa.array([3.0] * 51), pivots], names=["id", "vec", "norm2", "pivots"])

    def run():
        return pa.Table.from_batches(retrieve._around_pivots(iter([batch]))).combine_chunks()

    whole, seen, dense = run(), [], retrieve._dense
    monkeypatch.setattr(retrieve, "_MATRIX_ROWS", 32)
    monkeypatch.setattr(retrieve, "_dense", lambda v, width: seen.append(len(v)) or dense(v, width))
    parts = run()
    assert max(seen) == 8 and parts.drop_columns("angles").equals(whole.drop_columns("angles"))
    assert np.allclose(np.stack(parts["angles"].to_pylist()), np.stack(whole["angles"].to_pylist()))
    assert parts["list"].to_pylist()[-1] == 3 and fv.EMBEDDING_DIMENSIONS == 768


def test_pairs_are_multiplied_by_slices(monkeypatch):
    rng = random.Random(8)
    kind = pa.list_(pa.struct([("dim", pa.int32()), ("w", pa.int32())]))

    def vectors(n, repeated):
        some = [[{"dim": d, "w": rng.randint(-9, 9)} for d in (rng.choices if repeated else rng.sample)(range(40), k=rng.randint(0, 20))] for _ in range(n)]
        return [rng.choice([None, []]) if rng.random() < 0.1 else v for v in some]

    left, right = vectors(500, True), vectors(500, False)
    want = [None if a is None else sum(x["w"] * y["w"] for x in a for y in b or [] if x["dim"] == y["dim"]) for a, b in zip(left, right)]
    sizes, products = [], hashing._products
    monkeypatch.setattr(hashing, "_PAIRS", 64)
    monkeypatch.setattr(hashing, "_products", lambda a, b: sizes.append(len(a)) or products(a, b))
    assert hashing.sparse_products.func(pa.array(left, kind), pa.array(right, kind)).to_pylist() == want
    assert max(sizes) == 64 and len(sizes) == 8
    assert hashing.sparse_products.func(pa.array([], kind), pa.array([], kind)).to_pylist() == []
