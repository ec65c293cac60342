"""Section headers and section spans on built-in functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import strip, strip_chars


def header_text(line: Column) -> Column:
    """Header of a line, NULL for an ordinary line."""
    line = strip(line)
    numbered = F.regexp_extract(line, "(?iUd)" + fv.NUMBERED_HEADER, 1)
    capitals = (F.length(line) < 60) & (F.upper(line) == line) & line.rlike("[A-Z]{4,}")
    header = (
        F.when(numbered != "", strip_chars(numbered, " ."))
        .when(line.rlike("(?iUd)" + fv.NAMED_HEADER), line)
        .when(capitals, strip_chars(line, " ."))
    )
    return F.nullif(header, F.lit(""))


def text_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per line of a text with ``line_no`` from 0; line breaks are ``\\n``."""
    lines = F.posexplode_outer(F.split(F.col(text), "\n")).alias("line_no", "line")
    return df.select(key, lines).where(F.col("line").isNotNull())


def _spans(batches):
    """Sections of whole texts from the size, header and ink of their lines, a batch at a time."""
    for batch in batches:
        lines = batch.column("lines")
        count = pc.fill_null(pc.list_value_length(lines), 0).to_numpy().astype(np.int64)
        if not count.sum():
            continue
        fields = lines.flatten()
        size, inked = (fields.field(n).to_numpy(zero_copy_only=False) for n in ("size", "inked"))
        header = fields.field("header")
        row = np.repeat(np.arange(len(count)), count)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])[row]  # of the line's text
        ends = np.cumsum(size + 1)
        start = ends - size - 1
        start = start - start[first]
        new = np.flatnonzero((first == np.arange(len(row))) | header.is_valid().to_numpy(zero_copy_only=False))
        last = np.append(new[1:], len(row)) - 1
        # a section ends where the next one starts: behind the line break, except at the end of text
        more = np.append(row[new[1:]] == row[new[:-1]], False)
        stop = start[last] + size[last] + more
        kept = np.logical_or.reduceat(inked, new)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row[new][kept])), header.take(pa.array(new[kept])), pa.array(start[new][kept], pa.int32()), pa.array(stop[kept], pa.int32())],
            names=[batch.schema.names[0], "header", "char_start", "char_end"],
        )


def section_spans(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, header, char_start, char_end): a section ends where the next header begins.

    Text before the first header is a section without a name; a text without headers is one
    section; blank sections are left out. Texts stay where they are: lines are looked at inside
    their row, and their lengths are added up over a batch of texts at once.
    """

    def seen(line: Column) -> Column:
        return F.struct(
            F.length(line).cast("long").alias("size"), header_text(line).alias("header"), (strip(line) != "").alias("inked")
        )

    lines = df.select(key, F.transform(F.split(F.col(text), "\n"), seen).alias("lines"))
    kind = df.schema[key].dataType.simpleString()
    return lines.mapInArrow(_spans, f"`{key}` {kind}, header string, char_start int, char_end int")
