"""Which short texts occur inside which long ones: one multi-pattern automaton for each block of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a pattern that the automaton holds; the rest is compared where these are found.
_KEY = 32


def _middle(text: str) -> tuple[str, int]:
    """A pattern's inner characters, which are the rarer ones as a rule, and where they begin."""
    at = max(0, (len(text) - _KEY) // 2)
    return text[at : at + _KEY], at


class _Block:
    """The patterns of one block."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.digests: set[str] = set()
        self.of_key: dict[str, list[tuple[str, int, str]]] = {}
        self.ready = False

    def add(self, digest: str, text: str) -> None:
        if digest in self.digests:  # once for each salt of the task
            return
        self.digests.add(digest)
        key, at = _middle(text)
        self.of_key.setdefault(key, []).append((text, at, digest))

    def found_in(self, text: str) -> set[str]:
        if not self.ready:
            for key, patterns in self.of_key.items():
                self.automaton.add_word(key, (len(key), patterns))
            if self.of_key:
                self.automaton.make_automaton()
            self.ready = True
        found: set[str] = set()
        if not self.of_key:
            return found
        for end, (size, patterns) in self.automaton.iter(text):
            start = end + 1 - size
            for pattern, at, digest in patterns:
                if digest not in found and start >= at and text.startswith(pattern, start - at):
                    found.add(digest)
        return found


def _matched(batches):
    """Rows sorted by (block, is_text): the patterns of a block come before the texts they are looked up in."""
    import pyarrow as pa

    block, key = _Block(), None
    for batch in batches:
        ids, digests = [], []
        columns = [batch.column(c).to_pylist() for c in ("block", "is_text", "id", "norm")]
        for number, is_text, name, text in zip(*columns):
            if number != key:
                block, key = _Block(), number
            if not is_text:
                block.add(name, text)
            else:
                found = block.found_in(text)
                ids += [name] * len(found)
                digests += found
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(digests)], names=["text_id", "digest"])


def occurrences(texts: DataFrame, patterns: DataFrame, block_bytes: int = 16 << 20, salts: int | None = None) -> DataFrame:
    """Distinct (text_id, pattern_id): the pattern's text occurs in the text, at whatever place.

    Both sides have (id string, norm). Distinct patterns are dealt into blocks of about ``block_bytes``
    and each block is met by all texts, which go through one shuffle for each block. The number of
    blocks is a subquery, so nothing runs before the result is asked for, and without patterns no text
    moves. The texts of a block are dealt out by ``salts`` (as many as shuffle partitions, if not given);
    a task gets the block's patterns first, then its texts as a stream. Empty and null texts or patterns match nothing.
    """
    salts = salts or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = patterns.where("norm <> ''").select(F.col("id").alias("pattern_id"), "norm", F.sha2("norm", 256).alias("digest"))
    distinct = named.select("digest", "norm").distinct()
    size = F.coalesce(F.sum(F.length("norm") + 64 * _KEY), F.lit(0))
    blocks = distinct.agg(F.ceil(size / block_bytes).cast("int").alias("n")).scalar()
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    dealt = distinct.select(
        F.pmod(F.xxhash64("digest"), blocks).cast("int").alias("block"),
        every_salt.alias("salt"),
        F.lit(False).alias("is_text"),
        F.col("digest").alias("id"),
        "norm",
    )
    every_block = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
    read = texts.where("norm <> ''").select(
        F.explode(every_block).alias("block"),
        F.pmod(F.xxhash64("id", "norm"), F.lit(salts)).cast("int").alias("salt"),
        F.lit(True).alias("is_text"),
        F.col("id").cast("string").alias("id"),
        "norm",
    )
    rows = dealt.unionByName(read).repartition("block", "salt").sortWithinPartitions("block", "is_text")
    found = rows.mapInArrow(_matched, "text_id string, digest string")
    return found.join(named.select("digest", "pattern_id"), "digest").select("text_id", "pattern_id").distinct()


def enclosing(texts: DataFrame, patterns: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """``occurrences`` for few texts and very many patterns, which stay where they are.

    A pattern of at least ``_KEY`` characters is looked up by its first ones among all such runs of the
    few texts and then compared in place: an equi join. Shorter patterns go through ``occurrences``.
    """
    start = F.explode(F.sequence(F.lit(1), F.length("norm") - (_KEY - 1)))
    runs = texts.where(F.length("norm") >= _KEY).select(F.col("id").alias("text_id"), F.col("norm").alias("outer"), start.alias("at"))
    runs = runs.withColumn("h", F.xxhash64(F.substring(F.col("outer"), F.col("at"), F.lit(_KEY))))
    whole = patterns.where(F.length("norm") >= _KEY).select(
        F.col("id").alias("pattern_id"), "norm", F.xxhash64(F.substring(F.col("norm"), F.lit(1), F.lit(_KEY))).alias("h")
    )
    placed = whole.join(runs.select("text_id", "at", "h"), "h").join(texts.select(F.col("id").alias("text_id"), F.col("norm").alias("outer")), "text_id")
    long = placed.where(F.substring(F.col("outer"), F.col("at"), F.length("norm")) == F.col("norm")).select("text_id", "pattern_id")
    short = occurrences(texts, patterns.where(F.length("norm") < _KEY), block_bytes)
    return long.unionByName(short).distinct()
