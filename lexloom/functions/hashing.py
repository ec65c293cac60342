"""Hash embedding: a signed count per hash dimension, kept as integers and scaled on demand.

Keeping integer counts makes every dot product exact, whatever order the engine adds them in.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import words

SPARSE_TYPE = T.ArrayType(
    T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("w", T.IntegerType())])
)
_CACHE_LIMIT = 200_000


def token_dimension(token: Column) -> Column:
    """Dimension of a token: first two digest bytes modulo the number of dimensions."""
    digest = F.sha2(token, 256)
    return (
        F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % fv.EMBEDDING_DIMENSIONS
    )


def token_sign(token: Column) -> Column:
    """+1 when the third digest byte is even, else -1."""
    digest = F.sha2(token, 256)
    even = F.conv(F.substring(digest, 5, 2), 16, 10).cast("int") % 2 == 0
    return F.when(even, F.lit(1)).otherwise(F.lit(-1))


def hash_weights(df: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """Long form on built-in functions only: one row per key and non-zero dimension.

    Equal tokens are counted first, with partial counts before the shuffle, so each distinct token of
    a key is digested once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    tokens = df.select(
        *keys, F.explode_outer(words(F.lower(F.col(text)))).alias("token")
    ).where(F.col("token").isNotNull())
    counted = tokens.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.select(
            *keys, token_dimension(F.col("token")).alias("dim"), (token_sign(F.col("token")) * F.col("n")).alias("s")
        )
        .groupBy(*keys, "dim")
        .agg(F.sum("s").alias("w"))
        .where("w <> 0")
    )


def _hash_token(token: str) -> tuple[int, int]:
    digest = hashlib.sha256(token.encode("utf-8")).digest()
    dim = ((digest[0] << 8) | digest[1]) % fv.EMBEDDING_DIMENSIONS
    return dim, -1 if digest[2] & 1 else 1


class _Codes(dict):
    """Token to twice its dimension, plus one for a negative sign. Frequent tokens are digested once per worker."""

    def __missing__(self, token: str) -> int:
        dim, sign = _hash_token(token)
        code = 2 * dim + (sign < 0)
        if len(self) < _CACHE_LIMIT:
            self[token] = code
        return code


#: Texts are encoded by slices of about so many characters, and so many texts at most.
_SLICE_CHARS, _SLICE_TEXTS = 1 << 20, 1 << 11


def _encoded(tokens: list[list[str]], codes: _Codes) -> pa.Array:
    """One list of (dim, w) per text, by dimension and without zeros."""
    lengths = [len(row) for row in tokens]
    code = np.fromiter(map(codes.__getitem__, chain.from_iterable(tokens)), np.int64, sum(lengths))
    place = np.repeat(np.arange(len(tokens)), lengths) * fv.EMBEDDING_DIMENSIONS + (code >> 1)
    counts = np.bincount(place, 1 - 2 * (code & 1), len(tokens) * fv.EMBEDDING_DIMENSIONS)
    place = np.flatnonzero(counts)
    weight = counts[place].astype(np.int32)
    ends = np.searchsorted(place, np.arange(len(tokens) + 1) * fv.EMBEDDING_DIMENSIONS).astype(np.int32)
    dim = (place % fv.EMBEDDING_DIMENSIONS).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(dim), pa.array(weight)], ["dim", "w"]))


@F.arrow_udf(SPARSE_TYPE)
def sparse_embedding(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Row-local form: no shuffle. Counts are made by slices of a batch, however many texts it has, and never as objects."""
    codes = _Codes()
    for batch in batches:
        done, tokens, chars = [], [], 0
        for text in batch:
            value = (text.as_py() or "").lower()
            tokens.append(value.split())
            chars += len(value)
            if chars >= _SLICE_CHARS or len(tokens) >= _SLICE_TEXTS:
                done.append(_encoded(tokens, codes))
                tokens, chars = [], 0
        yield pa.concat_arrays([*done, _encoded(tokens, codes)])


def squared_norm(sparse: Column | str) -> Column:
    """Sum of squared counts as long."""
    col = F.col(sparse) if isinstance(sparse, str) else sparse
    return F.aggregate(
        col, F.lit(0).cast("long"), lambda acc, x: acc + (x["w"] * x["w"]).cast("long")
    )


def sparse_dot(left: Column, right_map: Column) -> Column:
    """Exact dot product of a sparse vector and a small ``map<dim,count>``."""
    return F.aggregate(
        left,
        F.lit(0).cast("long"),
        lambda acc, x: acc
        + (x["w"] * F.coalesce(F.element_at(right_map, x["dim"]), F.lit(0))).cast("long"),
    )


#: Pairs of vectors are multiplied by slices of so many.
_PAIRS = 1 << 11


def _places(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all elements: their row, row and dimension as one number, and weight."""
    flat = vectors.flatten()
    row = np.repeat(np.arange(len(vectors)), pc.fill_null(pc.list_value_length(vectors), 0).to_numpy())
    dim, weight = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "w"))
    return row, row * fv.EMBEDDING_DIMENSIONS + dim, weight


def _products(left: pa.Array, right: pa.Array) -> pa.Array:
    row, place, weight = _places(left)
    _, other, factor = _places(right)
    order = np.argsort(other, kind="stable")
    other, factor = np.append(other[order], -1), np.append(factor[order], 0)
    at = np.searchsorted(other[:-1], place)
    out = np.zeros(len(left), np.int64)
    np.add.at(out, row, np.where(other[at] == place, weight * factor[at], 0))
    return pa.array(out, mask=left.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.LongType())
def sparse_products(left: pa.Array, right: pa.Array) -> pa.Array:
    """Exact dot products of two columns of sparse vectors, each dimension at most once on the right.

    A map is searched from its beginning for each of the other side's dimensions; here a batch is merged at once.
    """
    parts = [_products(left.slice(at, _PAIRS), right.slice(at, _PAIRS)) for at in range(0, len(left), _PAIRS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.int64())


def as_map(sparse: Column | str) -> Column:
    return F.map_from_entries(F.col(sparse) if isinstance(sparse, str) else sparse)


def encoder_udf(
    load: Callable[[], Callable[[list[str]], list[list[float]]]],
    batch_size: int = 32,
    query: bool = False,
):
    """Plug-in for a real encoder: ``load`` runs once per worker and returns a batch function.

    Queries get the fixed instruction in front; passages are encoded as they are.
    """
    prefix = fv.QUERY_INSTRUCTION if query else ""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            texts = [prefix + (t or "") for t in batch]
            rows: list[list[float]] = []
            for at in range(0, len(texts), batch_size):
                for vector in model(texts[at : at + batch_size]):
                    norm = math.sqrt(sum(float(v) ** 2 for v in vector)) or 1.0
                    rows.append([float(v) / norm for v in vector])
            yield pd.Series(rows)

    return encode


def query_text(text: Column | str) -> Column:
    """Query text with the fixed instruction in front."""
    return F.concat(F.lit(fv.QUERY_INSTRUCTION), F.col(text) if isinstance(text, str) else text)
