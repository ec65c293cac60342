"""What several operators share: Arrow text access, slices of bounded size, rolling hashes."""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def slices(batches, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, cut so that the texts of a slice have at most ``limit`` bytes.

    A single longer text is a slice of its own; no text is cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = max(start + 1, stop)
            yield batch.slice(start, stop - start)
            start = stop


IDLE_SECONDS = 2.0
_caches: dict[str, dict] = {}
_release: threading.Timer | None = None


def _emptied(owners: list[str]) -> None:
    """Drops what these operators keep and gives the pages back to the system."""
    for owner in owners:
        _caches.pop(owner, None)
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@contextmanager
def worker_cache(owner: str) -> Iterator[dict]:
    """What tasks of one operator keep in a Python worker from task to task.

    It is released when the worker is idle for a while or takes a task of another operator.
    """
    global _release
    if _release is not None:
        _release.cancel()
    others = [o for o in _caches if o != owner]
    if others:
        _emptied(others)
    try:
        yield _caches.setdefault(owner, {})
    finally:
        _release = threading.Timer(IDLE_SECONDS, lambda: _emptied(list(_caches)))
        _release.daemon = True
        _release.start()


def utf8(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the n + 1 offsets between them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


class Rolling:
    """Polynomial hash modulo 2^64 of every substring of a byte array, from prefix sums.

    Hashes of another ``seed`` are independent of those of the first.
    """

    def __init__(self, data: np.ndarray, seed: int = 0) -> None:
        n = len(data)
        factor = MULTIPLIER if not seed else mixed(np.array([seed], np.uint64))[0] | np.uint64(5)
        self.down = np.full(n + 1, np.uint64(pow(int(factor), -1, 1 << 64)))
        self.down[0] = 1
        np.multiply.accumulate(self.down, out=self.down)
        up = np.full(n, factor)
        if n:
            up[0] = 1
            np.multiply.accumulate(up, out=up)
        codes = _BYTE_CODE if not seed else mixed(_BYTE_CODE + np.uint64(seed))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[data] * up, out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        """Hashes of ``data[start:stop]`` for arrays (or equally long slices) of bounds."""
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def frame(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch with the columns in the order of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in ((f.name, columns[f.name]) for f in schema)],
        schema=schema,
    )


def bounded_runs(batches, names: list[str], most: int, unique: int):
    """Distinct rows of sorted batches with the size of their group, counted up to ``most``.

    Rows are sorted by, and distinct in, the first ``unique`` columns; the first one is the group.
    At most ``most`` rows of a group are held back until its size is known.
    """
    held: list[np.ndarray] | None = None
    full, last = None, None

    def distinct(rows):
        keep = np.zeros(len(rows[0]), bool)
        for k in range(unique):
            keep[1:] |= rows[k][1:] != rows[k][:-1]
        keep[:1] = last is None or any(rows[k][0] != last[k] for k in range(unique))
        return [r[keep] for r in rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(n).to_numpy() for n in names]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
            held = None
        rows = distinct(rows)
        if full is not None and len(rows[0]):
            lead = int((rows[0] == full).sum())
            if lead:
                yield [r[:lead] for r in rows], np.full(lead, most)
                last = tuple(r[lead - 1] for r in rows)
                rows = [r[lead:] for r in rows]
        if not len(rows[0]):
            continue
        full, last = None, None
        tail = int(np.searchsorted(rows[0], rows[0][-1]))
        if tail:
            _, which, count = np.unique(rows[0][:tail], return_inverse=True, return_counts=True)
            yield [r[:tail] for r in rows], np.minimum(count, most)[which]
        held = [r[tail:] for r in rows]
        if len(held[0]) >= most:
            yield held, np.full(len(held[0]), most)
            full, last, held = held[0][-1], tuple(r[-1] for r in held), None
    if held is not None:
        yield held, np.full(len(held[0]), len(held[0]))


def whole_groups(batches, keys: list[str]):
    """Batches of rows sorted by ``keys[0]``, cut at its changes: whole groups, many at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(keys[0]).to_numpy()
        edge = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if held and (edge or held[-1].column(keys[0])[-1].as_py() != key[0]):
            if held[-1].column(keys[0])[-1].as_py() != key[0]:
                yield _together(held, keys)
                held = []
                if edge:
                    yield _together([batch.slice(0, edge)], keys)
            else:
                yield _together([*held, batch.slice(0, edge)], keys)
                held = []
        elif edge:
            yield _together([batch.slice(0, edge)], keys)
        held.append(batch.slice(edge))
    if held:
        yield _together(held, keys)


def _together(parts, keys):
    return [np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in keys]
