"""Packing of token sequences by bounded-space online best-fit.

Each map task packs its own rows: at most ``open_bins`` sequences are open at a time, in a bitset
keyed by free space. A piece goes to the fullest open sequence it fits in; when too many are open,
the fullest closes. Memory is bounded by ``open_bins`` and one slice of texts, and no row is
shuffled. Pieces of a slice are placed longest first. Only documents over ``room`` tokens are cut,
and all their pieces but the last fill a sequence each.

Null and empty texts have no ids but the end mark. Repeated rows are packed each. A lost task gives
the same pieces and sequence numbers again: they follow from the partition and the row order.
"""

from __future__ import annotations

import zlib
from array import array
from itertools import chain, filterfalse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import slices, worker_cache

ROOM = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_MARKS = ".,!?;:"


class OpenBins:
    """Free space of the open sequences: ``self.bits`` has bit f set while one has f tokens free."""

    def __init__(self, room: int, limit: int, first_number: int) -> None:
        self.room, self.limit, self.number = room, limit, first_number
        self.bits = 0
        self.open: dict[int, list[int]] = {}
        self.count = 0

    def _take(self, free: int) -> int:
        same = self.open[free]
        number = same.pop()
        if not same:
            del self.open[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset for a piece; the tightest fit wins."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.room, self.number
            self.number += 1
        left = free - length
        if left:
            self.open.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.room - free


#: Letters that byte-level vocabularies write for bytes: printable ones stand for themselves.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_LETTER = {b: chr(b if b in _PRINTED else 256 + sum(x not in _PRINTED for x in range(b))) for b in range(256)}


class WordIds:
    """Ids of a text by way of its words, which the tokenizer never joins across a blank.

    Little-endian 32-bit ids are kept of the last ``limit`` to ``2 * limit`` distinct words as
    written, from their second occurrence on, and of at most ``limit`` without their case and
    closing marks.
    """

    def __init__(self, tokenizer_file: str, limit: int = 250_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        self.limit = limit
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {"": b""}
        self.met = bytearray(1 << 24)
        self.n_met = 0

    def _encoded(self, part: str) -> bytes:
        # A run of Latin letters is one piece of the tokenizer's split, so its model can take it as it is.
        if part.isalpha() and max(part) < "\u0250":
            if not part.isascii():
                part = self.tokenizer.normalizer.normalize_str(part)
            if part.isalpha():
                letters = part if part.isascii() else "".join(map(_LETTER.__getitem__, part.encode()))
                return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _plain(self, part: str) -> bytes:
        found = self.plain.get(part)
        if found is None:
            if len(self.plain) >= self.limit:
                self.plain = {"": b""}
            found = self.plain[part] = self._encoded(part)
        return found

    def _learn(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isascii() and core.isalpha():
            return self._plain(core.lower()) + self._plain(word[len(core) :])
        if core != word and core.isalpha():  # letters and closing marks are split apart
            return self._plain(core) + self._plain(word[len(core) :])
        return self._plain(word)

    def of(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.seen) > self.limit:
            self.seen, self.older = {}, self.seen
        once = []
        for word in set(filterfalse(self.seen.__contains__, chain.from_iterable(split))):
            ids = self.older.get(word)
            if ids is None:
                ids = self._learn(word)
                if not self.met[(at := hash(word) & 0xFFFFFF)]:
                    self.met[at] = 1
                    once.append(word)
            self.seen[word] = ids
        get = self.seen.__getitem__
        found = [b"".join(map(get, words)) for words in split]
        for word in once:
            del self.seen[word]
        self.n_met += len(once)
        if self.n_met > 1 << 22:
            self.met, self.n_met = bytearray(1 << 24), 0
        return found


def _pack(tokenizer_file: str, room: int, open_bins: int):
    def run(batches):
        with worker_cache("packing") as known:
            yield from pack(batches, known)

    def pack(batches, known):
        if tokenizer_file not in known:
            known[tokenizer_file] = WordIds(tokenizer_file)
        ids_of = known[tokenizer_file]
        bins = OpenBins(room, open_bins, TaskContext.get().partitionId() << 36)
        size = 4 * room
        for batch in slices(batches):
            docs = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pieces = []
            for doc, ids in zip(docs, ids_of.of(texts)):
                ids += b"\0\0\0\0"
                for k in range(0, len(ids), size):
                    part = ids[k : k + size]
                    pieces.append((doc, k // size, k // 4, len(part) // 4, zlib.crc32(part)))
            pieces.sort(key=lambda p: -p[3])
            rows = [(*p, *bins.place(p[3])) for p in pieces]
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            names = [c.split()[0] for c in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def packed(docs: DataFrame, tokenizer_file: str, room: int = ROOM, open_bins: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_pack(tokenizer_file, room, open_bins), _PIECES)
