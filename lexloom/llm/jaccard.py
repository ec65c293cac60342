"""Self-join of documents on the Jaccard similarity of their word n-grams, by adaptive prefixes.

Two documents link when ``den * |intersection| >= num * |union|``. Equal sets are one class from the
start. A class of n shingles needs an overlap of at least a = ceil(num * n / den) with any partner.
Under any common order of shingles, partners share l shingles in their first n - a + l.

1. Extended prefixes: the first n - a + EXTRA shingles in the order of their hashes, or all there are.
   Partners share at least EXTRA of them. The classes with each of these shingles are counted.
2. Adaptive prefixes: the extended prefix is ordered from rare to frequent, and each class picks an l
   of its own: a longer prefix meets more postings, but l shared shingles instead of one make a
   candidate. The l with the least estimated cost of postings and verifications is taken. Dropping the
   EXTRA - l most frequent shingles cannot lose a partner: of the EXTRA shared ones, the l rarest stay.
   Passages that many documents share are frequent, and so stay out of most prefixes.
3. Stars: in each posting list the members that share enough with the class with the fewest unique
   shingles, the likely origin, are verified against it. A group of near copies costs one verification
   for each member, not for each pair.
4. The rest: in posting lists that still hold several components, pairs across components are compared
   by odd sketches: each shingle flips one bit, so sketches that differ in more bits than two similar
   sets can differ in shingles rule a pair out for certain. Pairs that remain and share l shingles are
   verified. Nothing is capped: what is left out is connected already, or cannot be similar. Lists of
   more than CHUNK classes are cut into parts, and each two parts meet under a key of their own.

Shingles are 64-bit hashes; verification counts whole sets. A text with fewer words than a shingle is
one shingle; without words or text it has none and links with nothing. Null ids count as larger than
all others in a component. Repeated rows are documents of one class. Extra columns are ignored by
``similar`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Rolling, bounded_runs, signed, slices, utf8, whole_groups
from lexloom.llm.components import components
from lexloom.session import cut_lineage

EXTRA = 128
#: Longer posting lists are compared in several tasks.
CHUNK = 1 << 14
#: 64-bit words of a sketch.
WORDS = 16
#: Shingles of more classes are all equally frequent, which is an order too.
MOST_COUNTED = 50_000
_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text."""
    raw, ends = utf8(texts)
    data = _LOWER[raw]
    n = len(data)
    inner = ~_SPACES[data]
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    before = np.concatenate([[False], inner[:-1]]) & ~cut[:n] if n else inner
    following = np.concatenate([inner[1:], [False]]) & ~cut[1:] if n else inner
    start, stop = np.flatnonzero(inner & ~before), np.flatnonzero(inner & ~following) + 1
    # All words one after the other, each with one blank behind it.
    width = stop - start + 1
    at = np.cumsum(width) - width
    owner = np.repeat(np.arange(len(start)), width)
    inside = np.arange(len(owner)) - at[owner]
    line = np.full(len(owner), 32, np.uint8)
    body = inside < width[owner] - 1
    line[body] = data[start[owner[body]] + inside[body]]
    roll = Rolling(line)
    first = np.searchsorted(start, ends[:-1])
    last = np.searchsorted(start, ends[1:])
    close = at + width - 1
    whole = roll.of(at[: len(at) - size + 1], close[size - 1 :]) if len(at) >= size else np.zeros(0, np.uint64)
    sets = []
    for a, b in zip(first, last):
        if b - a >= size:
            sets.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            sets.append(roll.of(at[a : a + 1], close[b - 1 : b]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _class_of(found: np.ndarray, salt: int) -> tuple[int, int]:
    """A number for equal sets, and another to tell two sets of one number apart."""
    code = hashlib.blake2b(found.tobytes(), digest_size=16, key=str(salt).encode()).digest()
    return int.from_bytes(code[:8], "little", signed=True), int.from_bytes(code[8:], "little", signed=True)


def _sketch(found: np.ndarray) -> bytes:
    """An odd sketch: each element flips one of 64 x WORDS bits."""
    bits = np.bincount((found >> np.uint64(32)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _needed(n, num: int, den: int):
    return -(-num * n // den)


def _members(size: int, salt: int):
    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), size)
            codes = [_class_of(s, salt) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array(c, pa.int64()) for c in zip(*codes)),
                    pa.array([_sketch(s) for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "class", "twin", "sketch"],
            )

    return run


def _extended(size: int, num: int, den: int, salt: int):
    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            tokens, classes, sizes = [], [], []
            for found in shingle_sets(batch.column("text"), size):
                if not len(found) or (mine := _class_of(found, salt)[0]) in seen:
                    continue
                seen.add(mine)
                n = len(found)
                tokens.append(found[: n - _needed(n, num, den) + EXTRA])
                classes.append(np.full(len(tokens[-1]), mine))
                sizes.append(np.full(len(tokens[-1]), n, np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(classes)), pa.array(np.concatenate(sizes))],
                    names=["token", "class", "n"],
                )

    return run


def _counted(batches):
    for (token, owner, n), df in bounded_runs(batches, ["token", "class", "n"], MOST_COUNTED, 2):
        often = df > 1
        if often.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[often]) for x in (token, owner, n)] + [pa.array(df[often])], names=["token", "class", "n", "df"]
            )


def _adapted(num: int, den: int, verify: float):
    def run(batches):
        for owner, token, n, df in whole_groups(batches, ["class", "token", "n", "df"]):
            order = np.lexsort((token, df, owner))
            owner, token, n, df = owner[order], token[order], n[order], df[order]
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            kept, need, unique = [], [], []
            for a, b in zip(starts, np.append(starts[1:], len(owner))):
                size = int(n[a])
                enough = int(_needed(size, num, den))
                extended = min(size, size - enough + EXTRA)
                rare = extended - (b - a)  # shingles of no other class come first
                most = extended - size + enough
                l = np.arange(1, most + 1)
                take = np.clip(size - enough + l - rare, 0, b - a)
                cost = np.concatenate([[0], np.cumsum(df[a:b] - 1)])[take] * (1 + verify / l)
                best = int(np.argmin(cost))
                kept.append(np.arange(a, a + take[best]))
                need.append(np.full(take[best], l[best], np.int32))
                unique.append(np.full(take[best], rare, np.int32))
            at = np.concatenate(kept)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[at]), pa.array(owner[at]), pa.array(n[at]), pa.array(np.concatenate(need)), pa.array(np.concatenate(unique))],
                    names=["token", "class", "n", "need", "rare"],
                )

    return run


def _combined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Rows (a, b, need, shared) with those of one pair added up."""
    a, b, need, shared = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((b, a))
    a, b, need, shared = a[order], b[order], need[order], shared[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, int)
    return [a[first], b[first], need[first], np.add.reduceat(shared, first) if len(a) else shared]


def _crossing(num: int, den: int, most: int = 1 << 16, held: int = 1 << 19):
    """Pairs of different components that may be similar, smaller class first, with the number of
    shingles they share in the posting lists of the task. At most about ``held`` rows are held back."""

    def run(batches):
        found, size = [], 0
        for token, owner, n, need, part, chunk, sketch in whole_groups(batches, ["key", "class", "n", "need", "component", "chunk", "sketch"]):
            order = np.lexsort((n, token))
            token, owner, n, need, part, chunk = (x[order] for x in (token, owner, n.astype(np.int64), need, part, chunk))
            sketch = np.frombuffer(b"".join(sketch[order]), np.uint64).reshape(-1, WORDS)
            group = np.cumsum(np.append(False, token[1:] != token[:-1]))
            # Partners of a row stand behind it, up to the last of its list with a compatible size.
            span = int(n.max()) * den // num + 2
            reach = np.searchsorted(group * span + n, group * span + np.minimum(n * den // num, span - 1), side="right")
            count = np.maximum(reach - np.arange(len(n)) - 1, 0)
            total = np.cumsum(count)
            at = 0
            while at < len(n):
                done = total[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
                a = np.repeat(np.arange(at, to), count[at:to])
                b = np.arange(len(a)) - np.repeat(total[at:to] - count[at:to] - done, count[at:to]) + a + 1
                at = to
                apart = (part[a] != part[b]) & ((chunk[a] < 0) | (chunk[a] != chunk[b]))
                a, b = a[apart], b[apart]
                differ = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64)
                able = differ * (den + num) <= (n[a] + n[b]) * (den - num)
                a, b = a[able], b[able]
                if len(a):
                    low, high = np.minimum(owner[a], owner[b]), np.maximum(owner[a], owner[b])
                    found.append([low, high, np.minimum(need[a], need[b]), np.ones(len(a), np.int64)])
                    size += len(a)
                if size > held:
                    found = [_combined(found)]
                    size = len(found[0][0])
                    if size > held // 2:
                        yield _pairs(found[0])
                        found, size = [], 0
        if found:
            yield _pairs(_combined(found))

    return run


def _in_chunks(rows: DataFrame) -> DataFrame:
    """Rows of posting lists, each once for every key it is compared under; ``parts`` of a list meet in pairs.

    ``chunk`` is the part of a row where two parts meet, which is compared with the other part only, and
    -1 where a part meets itself. Equal keys of two lists would only add pairs to verify.
    """
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class", F.lit("chunk")), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(
        F.when(F.col("parts") == 1, F.col("token")).otherwise(pair).alias("key"), "class", "n", "need", "component", "sketch",
        F.when(F.col("own") == F.col("other"), F.lit(-1).cast("long")).otherwise(F.col("own")).alias("chunk"),
    )


def _pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["a", "b", "need", "shared"])


def _texts(size: int, salt: int):
    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            codes = [_class_of(s, salt)[0] if len(s) else None for s in shingle_sets(batch.column("text"), size)]
            first = [c is not None and c not in seen and not seen.add(c) for c in codes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes, pa.int64()).filter(pa.array(first)), batch.column("text").filter(pa.array(first))], names=["class", "text"]
            )

    return run


def _verified(size: int):
    def run(batches):
        known: tuple = (None, None)
        for batch in slices(slices(batches, "left"), "right"):
            right = shingle_sets(batch.column("right"), size)
            inter, sizes = [], []
            for i, a in enumerate(batch.column("a").to_pylist()):
                if known[0] != a:
                    known = (a, shingle_sets(batch.column("left").slice(i, 1), size)[0])
                inter.append(len(np.intersect1d(known[1], right[i], assume_unique=True)))
                sizes.append(len(known[1]) + len(right[i]) - inter[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(inter, pa.int64()), pa.array(sizes, pa.int64())], names=["a", "b", "common", "both"]
            )

    return run


def _verify(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b) with the sizes of intersection and union of their whole sets."""
    right = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("right")), "b")
    both = right.join(texts.select(F.col("class").alias("a"), F.col("text").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(_verified(size), "a long, b long, common long, both long")


def similar(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, verify: float = 20.0, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id it is connected with)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    salt = 0
    while True:
        members = cut_lineage(texts.mapInArrow(_members(size, salt), "doc_id long, n long, class long, twin long, sketch binary"))
        classes = members.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.min("twin").alias("t"), F.max("twin").alias("u"), F.first("sketch").alias("sketch"))
        classes = cut_lineage(classes)
        if classes.filter("t <> u").isEmpty():
            break
        salt += 1  # two different sets had the same number
    only = texts.select("text")
    extended = only.mapInArrow(_extended(size, num, den, salt), "token long, class long, n int")
    counted = extended.repartition("token").sortWithinPartitions("token", "class").mapInArrow(
        _counted, "token long, class long, n int, df long"
    )
    posts = cut_lineage(
        counted.repartition("class").sortWithinPartitions("class").mapInArrow(
            _adapted(num, den, verify), "token long, class long, n int, need int, rare int"
        )
    )
    involved = posts.select("class").distinct()
    found = cut_lineage(
        only.mapInArrow(_texts(size, salt), "class long, text string").join(involved, "class", "left_semi").dropDuplicates(["class"])
    )
    linked = F.col("common") * den >= F.col("both") * num

    heads = posts.groupBy("token").agg(F.min_by(F.struct("class", "n", "need"), F.struct("rare", "class")).alias("head"))
    fits = (F.col("n") * den >= F.col("head.n") * num) & (F.col("head.n") * den >= F.col("n") * num)
    stars = (
        posts.join(heads, "token").filter((F.col("class") != F.col("head.class")) & fits)
        .groupBy(F.col("head.class").alias("a"), F.col("class").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("need", "head.need")).alias("need"))
        .filter("shared >= need").select("a", "b")
    )
    done = cut_lineage(_verify(stars, found, size))
    edges = done.filter(linked).select("a", "b")
    joined = components(edges)
    # Posting lists in one component have nothing left to find.
    placed = posts.join(joined, F.col("class") == F.col("node"), "left").select(
        "token", "class", "n", "need", F.coalesce("component", "class").alias("component")
    )
    placed = cut_lineage(placed)
    mixed = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size"))
    mixed = mixed.filter("x < y").select("token", F.ceil(F.col("size") / chunk).cast("long").alias("parts"))
    rest = (
        _in_chunks(placed.join(mixed, "token").join(classes.select("class", "sketch"), "class")).repartition("key").sortWithinPartitions("key")
        .mapInArrow(_crossing(num, den), "a long, b long, need int, shared long")
        .groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))
        .filter("shared >= need").join(done.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")
    )
    late = cut_lineage(_verify(rest, found, size)).filter(linked).select("a", "b")
    # Both results are small trees of links; the stars of the first rounds stand for their edges.
    final = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late))
    named = classes.join(final, F.col("class") == F.col("node"), "left").select(
        "class", "first", F.coalesce("component", "class").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = named.join(smallest, "component").select("class", "component_id")
    return members.join(labels, "class", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, whatever their columns' names."""
    kept = similar(docs, size, num, den).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"))
    ids = kept.select(F.col("doc_id").alias("kept_id")).distinct()
    return rows.join(ids, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")
