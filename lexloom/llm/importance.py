"""Resampling of documents by importance towards a target collection, on hashed word n-grams.

Texts lower-case A-Z and split into words (digits, letters and non-ASCII characters). Features are all
runs of 1 to ``most`` consecutive words joined by one space; a feature's bucket is the CRC-32 of its
UTF-8 bytes modulo ``buckets``. The buckets of all documents and of all target texts are counted; the
gain of a bucket is the floored, scaled logarithm of its share in the target against its share in the
documents, and a document's weight is the sum of the gains of its features. Adding Gumbel noise from a
digest of seed and doc_id and taking the highest scores draws without replacement.

The distinct words form an Aho-Corasick dictionary: each word, bounded by delimiters, carries its CRC
and its length. One scan of a text emits the payloads of its words, and the CRC of a run follows from
the payloads of its neighbours alone, since the CRC of a concatenation is linear in that of its left
part: no n-gram is ever spelled out. A task's dictionary grows with the words that it meets, up to
``dictionary_bytes``; words beyond that, or of more than 64 bytes, are digested where they stand, with
the same result.

Two passes over the texts, counting and weighing, both row-local; a task emits at most ``buckets``
counts, and ``buckets`` numbers are collected and broadcast. Ranks come from ranges of (score, doc_id),
each numbered by its own task. Very long texts are scanned in pieces that carry their last words over.

Null texts have no words, and documents without words weigh 0. Null ids are kept, draw as if their id
were the empty string, and come last among ties; rows of one id and score come in any order, each with
a rank of its own. An empty target or an empty table is one with no counts. Extra columns are ignored,
and kept by ``drawn_documents``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import slices, utf8
from lexloom.session import cut_lineage

MOST, BUCKETS, LEAST_WORDS, SHARE, SEED = 3, 10_000, 20, (5, 100), 42
_PIECE = 2 << 20
_LONGEST = 64
_SPACE = 32
_LOWER_WORDS = np.array(
    [c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else _SPACE for c in range(256)], np.uint8
)


class Composition:
    """CRC-32 of concatenations: ``crc(a + b) = after(crc(a), len(b)) ^ crc(b)``, for arrays."""

    def __init__(self) -> None:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
        # tables of the linear maps "n bytes follow", one for each of the four bytes of a CRC
        maps = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
        for _ in range(64):
            maps.append((maps[-1] >> 8) ^ step[maps[-1] & 255])
        self.short = np.stack(maps[:64]).ravel()
        self.long = [maps[64]]  # for 64, 128, 256, ... bytes
        for _ in range(24):
            self.long.append(self._mapped(self.long[-1].ravel(), self.long[-1], 0))

    @staticmethod
    def _mapped(tables: np.ndarray, crc: np.ndarray, at) -> np.ndarray:
        out = tables[at + (crc & 255)]
        for byte in (1, 2, 3):
            out = out ^ tables[at + 256 * byte + ((crc >> (8 * byte)) & 255)]
        return out

    def after(self, crc: np.ndarray, lengths) -> np.ndarray:
        lengths = np.asarray(lengths, np.int64)
        out = self._mapped(self.short, crc, (lengths & 63) << 10)
        high = lengths >> 6
        bit = 0
        while high.any():
            which = np.flatnonzero(high & 1)
            out[which] = self._mapped(self.long[bit].ravel(), out[which], 0)
            high, bit = high >> 1, bit + 1
        return out


class Dictionary:
    """Payloads (CRC, length) of words from an Aho-Corasick automaton that learns new words."""

    def __init__(self, most_bytes: int) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.fresh: dict[bytes, int] = {}
        self.known = 0
        self.room = most_bytes

    def crcs(self, line: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRCs of the words of a line that begins and ends with a space; bounds are those of the words."""
        raw = line.tobytes()
        crc = np.zeros(len(starts), np.uint32)
        missing = np.ones(len(starts), bool)
        if self.known:
            # one character a byte, so places are byte offsets; a match ends with the space after its word
            hits = np.fromiter(self.automaton.iter(raw.decode("latin-1")), [("end", np.int64), ("payload", np.int64)])
            word = np.searchsorted(ends, hits["end"])
            crc[word] = hits["payload"] & 0xFFFFFFFF
            missing[word] = False
        for i in np.flatnonzero(missing).tolist():
            word = raw[starts[i] : ends[i]]
            found = self.fresh.get(word)
            if found is None:
                found = zlib.crc32(word)
                if len(word) <= min(_LONGEST, self.room):
                    self.fresh[word] = found
                    self.room -= len(word)
            crc[i] = found
        if len(self.fresh) > max(500, self.known // 4):
            for word, value in self.fresh.items():
                self.automaton.add_word(f" {word.decode('latin-1')} ", len(word) << 32 | value)
            self.automaton.make_automaton()
            self.known += len(self.fresh)
            self.fresh = {}
        return crc


class Features:
    """Buckets of the features of texts."""

    def __init__(self, most: int, buckets: int, dictionary_bytes: int, piece: int = _PIECE) -> None:
        self.most, self.buckets, self.piece = most, buckets, piece
        self.dictionary = Dictionary(dictionary_bytes)
        self.composition = Composition()

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of the words' texts, and numbers and buckets of the features', piece by piece."""
        data, ends = utf8(texts)
        line = np.insert(_LOWER_WORDS[data], ends, _SPACE)  # a space before, between and after
        ends = ends[1:] + np.arange(1, len(ends))
        at, carried = 0, None
        while at < len(line) - 1:
            stop = min(at + self.piece, len(line) - 1)
            if line[stop] != _SPACE:  # no word is cut
                back = np.flatnonzero(line[at + 1 : stop] == _SPACE)
                if len(back):
                    stop = at + 1 + int(back[-1])
                else:
                    while line[stop] != _SPACE:
                        stop += 1
            part = line[at : stop + 1]
            edges = np.flatnonzero(np.diff(part != _SPACE)) + 1
            starts, stops = edges[::2], edges[1::2]
            row = np.searchsorted(ends, starts + at, side="right")
            crc = self.dictionary.crcs(part, starts, stops)
            yield row, *self._runs(row, crc, stops - starts, carried)
            carried = self._last(row, crc, stops - starts, carried)
            at = stop

    def _last(self, *new_and_carried):
        *new, carried = new_and_carried
        both = new if carried is None else [np.concatenate(x) for x in zip(carried, new)]
        return [x[max(0, len(x) - self.most + 1) :] for x in both]

    def _runs(self, row, crc, size, carried):
        before = 0
        if carried is not None:
            before = len(carried[0])
            row, crc, size = (np.concatenate(x) for x in zip(carried, (row, crc, size)))
        rows, found = [row[before:]], [crc[before:]]
        run = crc  # of the words i - n + 2 to i
        for n in range(2, self.most + 1):
            # one space, then the next word
            run = self.composition.after(run[:-1], 1) ^ np.uint32(zlib.crc32(b" "))
            run = self.composition.after(run, size[n - 1 :]) ^ crc[n - 1 :]
            new = max(0, before - n + 1)
            within = row[: len(row) - n + 1][new:] == row[n - 1 :][new:]
            rows.append(row[n - 1 :][new:][within])
            found.append(run[new:][within])
        return np.concatenate(rows), np.concatenate(found) % np.uint32(self.buckets)


def _counted(most, buckets, dictionary_bytes):
    def run(batches):
        features = Features(most, buckets, dictionary_bytes)
        total = np.zeros(buckets, np.int64)
        for part in slices(batches):
            for _, _, bucket in features.of(part.column("text")):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    return run


def feature_counts(texts: DataFrame, most: int = MOST, buckets: int = BUCKETS, dictionary_bytes: int = 1 << 20) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    counted = texts.select(F.col("text").cast("string").alias("text"))
    counted = counted.mapInArrow(_counted(most, buckets, dictionary_bytes), "bucket int, n long")
    total = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        total[r["bucket"]] = r["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of each bucket, with one added to every count."""
    buckets = len(source)
    s_all, t_all = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def _weighed(shared, most, dictionary_bytes):
    def run(batches):
        gain = shared.value
        features = Features(most, len(gain), dictionary_bytes)
        for part in slices(batches):
            n = part.num_rows
            words, weight, count = (np.zeros(n, np.int64) for _ in range(3))
            for word_row, row, bucket in features.of(part.column("text")):
                words += np.bincount(word_row, minlength=n)
                count += np.bincount(row, minlength=n)
                weight += np.bincount(row, weights=gain[bucket], minlength=n).astype(np.int64)  # whole numbers
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), pa.array(words), pa.array(count), pa.array(weight)],
                names=[*kept, "n_words", "n_features", "weight"],
            )

    return run


def weighed(texts: DataFrame, gain: np.ndarray, most: int = MOST, dictionary_bytes: int = 1 << 20) -> DataFrame:
    """``texts`` with n_words, n_features and weight instead of the column text."""
    shared = texts.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    result = T.StructType([f for f in texts.schema if f.name != "text"])
    for name in ("n_words", "n_features", "weight"):
        result = result.add(name, T.LongType())
    return texts.mapInArrow(_weighed(shared, most, dictionary_bytes), result)


def _noise(doc_id, seed: int):
    """Gumbel noise in thousandths from the first 32 bits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def _gain(docs, target, most, buckets, dictionary_bytes):
    counts = (feature_counts(t, most, buckets, dictionary_bytes) for t in (docs, target))
    return gains(*counts)


def _ranked(scored: DataFrame, share: tuple[int, int], least_words: int) -> tuple[DataFrame, int]:
    """``scored`` with ranks (null where not drawn), and the number of drawn rows."""
    fits = F.col("n_words") >= least_words
    tie = F.monotonically_increasing_id()  # repeated rows may fill several ranges
    placed = scored.select("*", (~fits).alias("_last"), tie.alias("_tie"))
    order = [F.asc("_last"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_tie")]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # the task and the place in it
    placed = placed.withColumn("_part", F.shiftright(number, 33).cast("int"))
    placed = cut_lineage(placed.withColumn("_place", number.bitwiseAND(F.lit((1 << 33) - 1))))
    parts = placed.groupBy("_part").agg(F.count("*").alias("n"), F.count_if(~F.col("_last")).alias("fit")).collect()
    n_drawn = share[0] * sum(p["fit"] for p in parts) // share[1]
    before, rows = 0, []
    for p in sorted(parts, key=lambda p: p["_part"]):  # one row for each range
        rows.append((p["_part"], before))
        before += p["n"]
    starts = scored.sparkSession.createDataFrame(rows, "_part int, _before long")
    rank = F.col("_before") + F.col("_place") + 1
    ranked = placed.join(F.broadcast(starts), "_part").withColumn("rank", F.when(rank <= n_drawn, rank))
    return ranked.drop("_part", "_place", "_before", "_last", "_tie"), n_drawn


def resampled(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = SHARE,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    most: int = MOST,
    buckets: int = BUCKETS,
    dictionary_bytes: int = 1 << 20,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of all documents; rank is null if not drawn."""
    gain = _gain(docs, target, most, buckets, dictionary_bytes)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = weighed(texts, gain, most, dictionary_bytes)
    scored = scored.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))
    return _ranked(cut_lineage(scored), share, least_words)[0]


def drawn_documents(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = SHARE,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    most: int = MOST,
    buckets: int = BUCKETS,
    dictionary_bytes: int = 1 << 20,
) -> DataFrame:
    """The drawn rows of ``docs``, whole. Rows repeated with the id and score of the last one all stay."""
    gain = _gain(docs, target, most, buckets, dictionary_bytes)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), "doc_id", F.col("text").cast("string").alias("text")
    )
    noise = F.col("weight") + _noise(F.col("doc_id"), seed)
    narrow = weighed(rows.select("doc_id", "text"), gain, most, dictionary_bytes).withColumn("score", noise)
    ranked, n_drawn = _ranked(cut_lineage(narrow), share, least_words)
    last = ranked.filter(F.col("rank") == n_drawn).select("score", "doc_id").first()
    if last is None:
        return docs.limit(0)
    scored = weighed(rows, gain, most, dictionary_bytes).withColumn("score", noise)
    if last["doc_id"] is None:
        ahead = F.lit(True)
    else:
        ahead = F.col("doc_id") <= last["doc_id"]
    in_draw = (F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & F.coalesce(ahead, F.lit(False)))
    return scored.filter((F.col("n_words") >= least_words) & in_draw).select("row.*")
