"""Removal of long repeated byte strings with a run-length index.

A byte is removed when a string of ``length`` bytes covers it that also starts earlier: in a document
with a smaller doc_id, or earlier in the same one. All whole texts are compared, overlaps count.

1. Equal texts are one class at the place of its smallest doc_id; its other copies go as a whole.
2. The smallest hash of the ``gram``-byte strings in each window of ``length`` bytes is the window's
   anchor; equal windows have equal anchors at the same distance. Windows whose anchor is unique in
   the corpus cannot repeat. The others form segments, one for each anchor.
3. A segment that occurred in the same task before is removed at once; first occurrences meet by
   anchor. An anchor with over ``hot`` places is split into single windows, which meet by the hash of
   the whole window, so no anchor fills a task.
4. Each task sorts the suffixes of its distinct segments, ``block`` bytes or one anchor at a time, and
   keeps the Burrows-Wheeler transform as runs with sampled run ends: for the first suffix of each run
   its place, its neighbour in suffix order and their common length. Streaming over the segments in
   text order, the matching statistics of every position follow from the sample before it. Positions
   that match ``length`` bytes are chained to their neighbours; all of a chain but the first go.

Null texts are empty. Null ids come last; of different texts with one id the order is that of their
classes. Rows repeated with one id and text are one document, each with its result. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Rolling, bounded_runs, signed, slices, utf8, whole_groups
from lexloom.session import cut_lineage

LENGTH = 100
GRAM = 24
HOT = 20_000
_SEGMENT = "key long, doc_id long, class long, start int, width int, segment binary"


def class_of(text: bytes) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "little", signed=True)


def _windows(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Anchors of all windows: text, place, first and last window of each, and its hash (by document)."""
    n = len(data)
    if n < length:
        return None
    roll = Rolling(data)
    at = np.arange(n - gram + 1)
    value = roll.of(at, at + gram)
    place = at.astype(np.int64)
    span, reach = length - gram + 1, 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = value[:-step], value[step:]
        later = right < left
        place = np.where(later, place[step:], place[:-step])
        value = np.where(later, right, left)
        reach += step
    windows = np.arange(len(value))
    text = np.searchsorted(ends, windows, side="right") - 1
    inside = windows + length <= ends[text + 1]
    windows, text, place, value = windows[inside], text[inside], place[inside], value[inside]
    if not len(windows):
        return None
    new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    return text[first], windows[first], windows[last], value[first], roll


def _new_classes(texts, seen: set[int]) -> tuple[np.ndarray, list[bool]]:
    codes = [class_of((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in texts]
    return np.array(codes, np.int64), [c not in seen and not seen.add(c) for c in codes]


def _anchors(length: int, gram: int):
    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            codes, fresh = _new_classes(batch.column("text"), seen)
            data, ends = utf8(batch.column("text"))
            found = _windows(data, ends, length, gram)
            if found is None:
                continue
            text, first, _, key, _ = found
            keep = np.array(fresh)[text]
            text = text[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(key[keep])), pa.array(codes[text]), pa.array((first[keep] - ends[text]).astype(np.int32))],
                names=["key", "class", "start"],
            )

    return run


def _repeated(hot: int):
    def run(batches):
        for (key, owner, start), count in bounded_runs(batches, ["key", "class", "start"], hot, 3):
            often = count > 1
            if often.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner[often]), pa.array(start[often]), pa.array(count[often] >= hot)], names=["class", "start", "hot"]
                )

    return run


def _fresh_texts(batches):
    seen: set[int] = set()
    for batch in slices(batches):
        codes, fresh = _new_classes(batch.column("text"), seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(codes).filter(pa.array(fresh)), batch.column("text").filter(pa.array(fresh))], names=["class", "text"]
        )


def _joined(first: np.ndarray, last: np.ndarray, owner: np.ndarray):
    """Ranges of one owner that follow on each other, as one."""
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != last[:-1] + 1) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return first[at], last[np.append(at[1:], len(first)) - 1] if len(at) else last, owner[at]


def _gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The byte strings ``data[first : first + size]``."""
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at])])


def _segments(length: int, gram: int):
    """Rows come by place in the corpus, so an equal segment that was seen stands earlier."""

    def run(batches):
        seen: dict[int, int] = {}
        for batch in slices(batches):
            data, ends = utf8(batch.column("text"))
            found = _windows(data, ends, length, gram)
            if found is None:
                continue
            text, first, last, key, roll = found
            other = Rolling(data, 1)
            # The anchors that are repeated, and those of them that are hot.
            places = batch.column("places")
            flat = places.flatten()
            row = np.repeat(np.arange(len(places)), pc.list_value_length(places).to_numpy())
            wanted = ends[row] + flat.field("start").to_numpy()
            order = np.argsort(wanted)
            wanted, is_hot = wanted[order], flat.field("hot").to_numpy(zero_copy_only=False)[order]
            at = np.searchsorted(wanted, first)
            hit = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == first)
            text, first, last, key, hot = text[hit], first[hit], last[hit], key[hit], is_hot[at[hit]]
            # Hot ones become single windows under the hash of the whole window.
            times = np.where(hot, last - first + 1, 1)
            part = np.repeat(np.arange(len(first)), times)
            step = np.arange(len(part)) - np.repeat(np.cumsum(times) - times, times)
            text, hot, key = text[part], hot[part], key[part]
            first = first[part] + step
            last = np.where(hot, first, last[part])
            size = last - first + length
            code = roll.of(first, first + size)
            key = np.where(hot, code, key)
            twin = other.of(first, first + size)
            _, lead, group = np.unique(code, return_index=True, return_inverse=True)
            fresh = np.zeros(len(code), bool)
            fresh[lead] = [seen.setdefault(c, t) == t and known for c, t, known in zip(
                code[lead].tolist(), twin[lead].tolist(), [c not in seen for c in code[lead].tolist()])]
            gone = ~fresh & (np.array([seen[c] for c in code[lead].tolist()], np.uint64)[group] == twin) if len(code) else fresh
            codes = batch.column("class").to_numpy()
            docs = batch.column("doc_id").to_numpy()
            a, b, owner = _joined(first[gone], last[gone], text[gone])
            stay = np.flatnonzero(~gone)
            columns = [
                np.concatenate([codes[owner], signed(key[stay])]),
                np.concatenate([docs[owner], docs[text[stay]]]),
                np.concatenate([codes[owner], codes[text[stay]]]),
                np.concatenate([a - ends[owner], first[stay] - ends[text[stay]]]).astype(np.int32),
                np.concatenate([b - a + 1, last[stay] - first[stay] + 1]).astype(np.int32),
            ]
            strings = pa.concat_arrays([pa.nulls(len(a), pa.binary()), _gathered(data, first[stay], size[stay])])
            if len(strings):
                names = [c.split()[0] for c in _SEGMENT.split(", ")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), strings], names=names)

    return run


def suffixes(code: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. ``code`` is 0 at the end of each string, which counts as a
    letter of its own, in text order; ``left`` is the number of letters up to it."""
    n = len(code)
    packed = np.zeros(n, np.int64)
    padded = np.concatenate([code, np.zeros(7, np.int64)])
    for j in range(7):
        packed = packed << 9 | np.where(j <= left, padded[j : j + n], 0)
    order = np.argsort(packed, kind="stable")
    ranked = packed[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = 7
    while len(slots):
        u = order[slots]
        second = np.where(left[u] < h, n + u, rank[np.minimum(u + h, n - 1)])
        both = rank[u] * (2 * n) + second
        turn = np.argsort(both, kind="stable")
        u, both = u[turn], both[turn]
        order[slots] = u
        new = np.append(True, both[1:] != both[:-1])
        rank[u] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class RunLengthIndex:
    """Burrows-Wheeler transform of strings as runs, with the place, neighbour and match at each run's start."""

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.array([len(s) for s in strings]) + 1
        self.ends = np.cumsum(sizes)
        self.n = int(self.ends[-1])
        code = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        code[self.ends - 1] = 0
        left = np.repeat(self.ends, sizes) - np.arange(self.n) - 1
        order = suffixes(code, left)
        letters = code[order - 1]
        new = np.append(True, (letters[1:] != letters[:-1]) | (letters[1:] == 0))
        starts = np.flatnonzero(new)
        self.letters, self.lengths = letters[starts], np.diff(np.append(starts, self.n))
        place = order[starts]
        near = order[np.maximum(starts - 1, 0)]
        match = self._common(code, left, place, near)
        match[0] = 0  # the first of all suffixes has no neighbour
        by_place = np.argsort(place)
        self.place, self.near, self.match = place[by_place], near[by_place], match[by_place]

    @staticmethod
    def _common(code, left, a, b) -> np.ndarray:
        """Letters that the strings at ``a`` and ``b`` share."""
        length = np.zeros(len(a), np.int64)
        most = np.minimum(left[a], left[b])
        open_ = np.flatnonzero(most > 0)
        while len(open_):
            same = code[a[open_] + length[open_]] == code[b[open_] + length[open_]]
            open_ = open_[same]
            length[open_] += 1
            open_ = open_[length[open_] < most[open_]]
        return length

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the text, streamed in order: its neighbour, and the length they match."""
        gap = np.diff(np.append(self.place, self.n))
        past = np.arange(self.n) - np.repeat(self.place, gap)
        return np.repeat(self.near, gap) + past, np.repeat(self.match, gap) - past


def repeated_places(strings: list[bytes], length: int) -> np.ndarray:
    """Places, in the text of all strings each with an end mark, whose next ``length`` bytes occurred before."""
    index = RunLengthIndex(strings)
    near, match = index.statistics()
    linked = match >= length
    head = np.where(linked, near, np.arange(index.n))
    while True:
        further = head[head]
        if (further == head).all():
            break
        head = further
    chained = np.flatnonzero(linked)
    root = head[chained]
    least = np.arange(index.n)
    np.minimum.at(least, root, chained)
    both = np.union1d(chained, root)
    return both[both > least[head[both]]]


def _marked(length: int, block: int):
    """Rows (class, first, last) of windows to go, from segments sorted by key."""

    def index(docs, owners, starts, widths, segments):
        """Marks within whole groups of segments, the earlier ones first: of equal ones the first stays."""
        order = np.lexsort((starts, owners, docs))
        docs, owners, starts, widths, segments = (x[order] for x in (docs, owners, starts, widths, segments))
        where: dict[bytes, int] = {}
        again = np.array([where.setdefault(s, i) != i for i, s in enumerate(segments)])
        marks = [(owners[again], starts[again], starts[again] + widths[again] - 1)]
        strings, kept = list(where), np.flatnonzero(~again)
        if len(strings) > 1:
            at = repeated_places(strings, length)
            size = np.array([len(s) + 1 for s in strings])
            ends = np.cumsum(size)
            which = np.searchsorted(ends, at, side="right")
            a, b, which = _joined(at, at, which)
            shift = starts[kept[which]] - (ends - size)[which]
            marks.append((owners[kept[which]], a + shift, b + shift))
        return [np.concatenate(x) for x in zip(*marks)]

    def run(batches):
        for key, docs, owners, starts, widths, segments in whole_groups(batches, [c.split()[0] for c in _SEGMENT.split(", ")]):
            ready = np.array([s is None for s in segments])
            found = [(owners[ready], starts[ready], starts[ready] + widths[ready] - 1)]
            key, docs, owners, starts, widths, segments = (x[~ready] for x in (key, docs, owners, starts, widths, segments))
            sizes = np.cumsum(widths + length)
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
            at = 0
            while at < len(key):
                reach = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + block))
                to = int(np.append(heads, len(key))[np.searchsorted(heads, reach, side="right")]) if reach < len(key) else len(key)
                found.append(index(*(x[at:to] for x in (docs, owners, starts, widths, segments))))
                at = to
            owner, first, last = (np.concatenate(x) for x in zip(*found))
            if len(owner):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["class", "first", "last"]
                )

    return run


def _cut(length: int):
    """What is left of each text without the marked windows."""

    def run(batches):
        for batch in slices(batches):
            out = []
            for text, marks in zip(batch.column("text"), batch.column("marks").to_pylist()):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                kept, at, spans, removed = hashlib.sha256(), 0, [], 0
                for first, last in sorted((m["first"], m["last"]) for m in marks or ()):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last + length)
                    else:
                        spans.append([first, last + length])
                for first, stop in spans:
                    kept.update(raw[at:first])
                    removed += stop - first
                    at = stop
                kept.update(raw[at:])
                out.append((removed, kept.hexdigest(), [{"start": a, "stop": b} for a, b in spans]))
            removed, digest, spans = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                names=["class", "n_removed", "kept_sha256", "spans"],
            )

    return run


def without_long_matches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block: int = 256 << 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    members = cut_lineage(
        rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"))
    )
    # The class is the number in the first eight bytes of the digest, lowest byte first.
    low_first = F.concat(*[F.substring("digest", i, 2) for i in range(15, 0, -2)])
    high, rest = (F.conv(F.substring(low_first, i, 8), 16, 10).cast("long") for i in (1, 9))
    members = members.withColumn("class", F.shiftleft(high, 32).bitwiseOR(rest))
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    classes = cut_lineage(
        members.groupBy("class").agg(F.min(order).alias("first"), F.min("digest").alias("d"), F.max("digest").alias("e"))
    )
    if not classes.filter("d <> e").isEmpty():
        raise RuntimeError("two texts have the same 64 bits of SHA-256")
    texts = rows.select("text").filter(F.octet_length("text") >= length)
    places = (
        texts.mapInArrow(_anchors(length, gram), "key long, class long, start int")
        .repartition("key").sortWithinPartitions("key", "class", "start")
        .mapInArrow(_repeated(hot), "class long, start int, hot boolean")
        .groupBy("class").agg(F.collect_list(F.struct("start", "hot")).alias("places"))  # of one text
    )
    open_ = cut_lineage(
        texts.mapInArrow(_fresh_texts, "class long, text string").dropDuplicates(["class"])
        .join(places, "class").join(classes.select("class", F.col("first").alias("doc_id")), "class")
        .select("doc_id", "class", "text", "places")
    )
    marks = (
        open_.sortWithinPartitions("doc_id", "class").mapInArrow(_segments(length, gram), _SEGMENT)
        .repartition("key").sortWithinPartitions("key")
        .mapInArrow(_marked(length, block), "class long, first int, last int")
        .groupBy("class").agg(F.collect_list(F.struct("first", "last")).alias("marks"))  # of one text
    )
    cut = open_.select("class", "text").join(marks, "class").mapInArrow(
        _cut(length), "class long, n_removed long, kept_sha256 string, spans array<struct<start: int, stop: int>>"
    )
    again = (F.col("n_bytes") >= length) & (order != F.col("first"))
    return (
        members.join(classes.select("class", "first"), "class").join(cut, "class", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(again, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(again, 1).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
            F.when(again, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
            F.when(again, F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))).otherwise(F.col("spans")).alias("spans"),
        )
    )
