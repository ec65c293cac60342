"""Benchmark decontamination with one Aho-Corasick automaton.

Items and documents are normalised alike: A-Z to lower case, words are runs of digits, letters and
non-ASCII characters. A window is ``width`` consecutive words of an item; an item with fewer words
is one window. Windows, bounded by spaces, are the patterns; each text is scanned once, and matches
are mapped to word numbers and to character offsets of the original text.

Items are a stated set, but not a bounded one: they are cut into blocks of at most ``block_bytes``
of patterns, with one automaton and one pass over the texts for each block. Null texts have no
words; items without words have no windows; words hit by an item without item_id are hit, but the
item is not listed. Repeated items count once, repeated documents each get their row. Extra columns
are ignored by ``contamination`` and kept by ``clean_documents``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import worker_cache
from lexloom.session import cut_lineage

WIDTH = 10
_LOWER_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOUND = pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("item", pa.string())])
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_HITS = "array<struct<first: int, stop: int, item: string>>"
_RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, stop: int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_WORDS).split()


def windows_of(text: str | None, width: int) -> set[str]:
    words = words_of(text)
    starts = range(max(1, len(words) - width + 1)) if words else ()
    return {f" {b' '.join(words[i : i + width]).decode('utf-8', 'surrogatepass')} " for i in starts}


def item_blocks(items: DataFrame, width: int, block_bytes: int) -> Iterator[dict[str, list[str | None]]]:
    """Patterns with the ids of their items, in blocks of bounded size; items stream through the driver."""
    block: dict[str, list[str | None]] = {}
    size = 0
    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for item, text in rows.toLocalIterator():
        for window in windows_of(text, width):
            known = block.setdefault(window, [])
            if item not in known:
                known.append(item)
            size += len(window) + 64
        if size > block_bytes:
            yield block
            block, size = {}, 0
    yield block


def _automaton(shared, built: dict):
    """The automaton of a block, built once in each Python worker; only the last one is kept."""
    import ahocorasick

    name, patterns = shared.value
    if name not in built:
        built.clear()
        made = ahocorasick.Automaton()
        for pattern, items in patterns.items():
            made.add_word(pattern, (len(pattern), pattern.count(" ") - 1, items))
        made.make_automaton()
        built[name] = made
    return built[name]


def _matches(automaton, words: list[bytes]) -> list[tuple[int, int, str | None]]:
    """Word ranges and items of all windows that occur."""
    if not words or not len(automaton):
        return []
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    found, at, passed = [], 0, 0
    for end, (_, n, items) in automaton.iter(line):
        passed += line.count(" ", at, end)  # spaces before the one that ends the match
        at = end
        found.extend((passed - n, passed, item) for item in items)
    return found


def _ranges(found) -> list[list[int]]:
    merged: list[list[int]] = []
    for first, stop in sorted({(f, s) for f, s, _ in found}):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([first, stop])
    return merged


def _scan(shared, last: bool):
    def run(batches):
        with worker_cache("decontamination") as built:
            yield from scan(batches, _automaton(shared, built))

    def scan(batches, automaton):
        for batch in batches:
            texts = batch.column("text")
            hits = []
            n_words = []
            for text, before in zip(texts, batch.column("_hits").to_pylist()):
                words = words_of(text.as_py())
                n_words.append(len(words))
                hits.append([*((h["first"], h["stop"], h["item"]) for h in before), *_matches(automaton, words)])
            if not last:
                keys = [[dict(zip(("first", "stop", "item"), h)) for h in found] for found in hits]
                yield batch.set_column(batch.schema.get_field_index("_hits"), "_hits", pa.array(keys, pa.list_(_FOUND)))
                continue
            ranges = [_ranges(found) for found in hits]
            spans = []
            for i, merged in enumerate(ranges):
                at = [m.span() for m in _WORD.finditer(texts[i].as_py())] if merged else []
                spans.append([{"start": at[first][0], "stop": at[stop - 1][1]} for first, stop in merged])
            kept = [n for n in batch.schema.names if n not in ("text", "_hits")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in kept),
                    pa.array(n_words, pa.int64()),
                    pa.array([sum(b - a for a, b in merged) for merged in ranges], pa.int64()),
                    pa.array([sorted({h[2] for h in found if h[2] is not None}) for found in hits], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(_SPAN)),
                ],
                names=[*kept, "n_words", "n_hit", "items", "spans"],
            )

    return run


def _scanned(texts: DataFrame, items: DataFrame, width: int, block_bytes: int) -> DataFrame:
    """``texts`` without its column text, with n_words, n_hit, items and spans."""
    spark = texts.sparkSession
    texts = texts.withColumn("_hits", F.lit(None).cast(_HITS)).withColumn("_hits", F.coalesce("_hits", F.array().cast(_HITS)))
    kept = T.StructType([f for f in texts.schema if f.name not in ("text", "_hits")])
    result = T.StructType([*kept, *T._parse_datatype_string(_RESULT)])
    ahead = None
    for block in item_blocks(items, width, block_bytes):
        if ahead is not None:
            texts = cut_lineage(texts.mapInArrow(_scan(ahead, False), texts.schema))
        ahead = spark.sparkContext.broadcast((uuid.uuid4().hex, block))  # at most block_bytes and one item
    return texts.mapInArrow(_scan(ahead, True), result)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = 16 << 20) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_hit, items, and spans, the hit character ranges."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _scanned(texts, items, width, block_bytes)


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return _scanned(rows, items, width, block_bytes).filter("n_hit = 0").select("row.*")
