"""Section-aware chunks with overlap, as an Arrow table function.

Where a chunk ends decides where the next one starts, so the walk along one text is sequential. It
is kept small: one pass finds all sentence ends and page marks of a text, then each cut is a binary
search. Texts are independent, so Spark spreads them over tasks freely.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import fixed_values as fv

CHUNK_FIELDS = T.StructType(
    [
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("section_header", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("char_start", T.IntegerType()),
        T.StructField("char_end", T.IntegerType()),
        T.StructField("word_count", T.IntegerType()),
    ]
)

_GAP = re.compile(r"(?<=[.!?])\s+")
_NUMBERED = re.compile(fv.NUMBERED_HEADER, re.IGNORECASE)
_NAMED = re.compile(fv.NAMED_HEADER, re.IGNORECASE)
_CAPITALS = re.compile(r"[A-Z]{4,}")
_PAGE_WORD = re.compile(r"\bPage\s+(?=\d)", re.IGNORECASE)
_COURT_PAGE = re.compile(r"\bPage\s+(\d{1,4})\s+Case", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_WORD_CHARACTER = re.compile(r"\w")
_LAST_TOKEN = re.compile(r"[A-Za-z]{1,10}\.\Z")
_ABBREVIATIONS = frozenset(fv.ABBREVIATIONS)
_LOOKAHEAD = 160


def header_of(line: str) -> str | None:
    """Header text of a stripped line, or None for an ordinary line."""
    numbered = _NUMBERED.match(line)
    if numbered:
        return numbered.group(1).strip(" .") or None
    if _NAMED.match(line):
        return line
    if len(line) < 60 and line == line.upper() and _CAPITALS.search(line):
        return line.strip(" .") or None
    return None


def _section_spans(text: str) -> list[tuple[str | None, int, int]]:
    marks: list[tuple[str | None, int]] = []
    at = 0
    for line in text.splitlines(keepends=True):
        header = header_of(line.strip())
        if header:
            marks.append((header, at))
        at += len(line)
    if not marks or marks[0][1] > 0:
        marks.insert(0, (None, 0))
    ends = [start for _, start in marks[1:]] + [len(text)]
    return [(h, s, e) for (h, s), e in zip(marks, ends) if text[s:e].strip()]


class _Page:
    """Page number at any offset: form feeds against printed page marks, of which those before a case number win.

    Only the text before the offset counts, so a mark that the offset cuts reads as its first digits, and a
    number of five digits is a mark as long as one to four of them are seen. Each mark gives the offsets
    at which it counts; a lookup is a binary search in these.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.feeds = [i for i, c in enumerate(text) if c == "\f"]
        self.digits: list[tuple[int, int]] = []  # where the digits of a mark begin, and up to where they are one
        self.kept: list[tuple[int, int]] = []  # (from this offset on, page)
        for m in _PAGE_WORD.finditer(text):
            at = m.end()
            stop = _DIGITS.match(text, at).end()
            self.digits.append((at, min(stop, at + 4)))
            if stop - at <= 4 and not _WORD_CHARACTER.match(text, stop):
                self.kept.append((stop, int(text[at:stop])))
        self.court: list[tuple[int, int]] = []
        self.court_cut: dict[int, int] = {}
        for m in _COURT_PAGE.finditer(text):
            if _WORD_CHARACTER.match(text, m.end()):
                self.court_cut[m.end()] = int(m.group(1))  # a longer word that the offset cuts
            else:
                self.court.append((m.end(), int(m.group(1))))

    def _printed(self, offset: int) -> int:
        if offset in self.court_cut:
            return self.court_cut[offset]
        seen = bisect_right(self.court, offset, key=lambda mark: mark[0])
        if seen:
            return self.court[seen - 1][1]
        cut = bisect_left(self.digits, offset, key=lambda mark: mark[0])
        if cut and offset <= self.digits[cut - 1][1]:
            return int(self.text[self.digits[cut - 1][0] : offset])
        seen = bisect_right(self.kept, offset, key=lambda mark: mark[0])
        return self.kept[seen - 1][1] if seen else 1

    def at(self, offset: int) -> int:
        return max(bisect_left(self.feeds, offset) + 1, self._printed(offset))


def _abbreviated(prefix_tail: str) -> bool:
    token = _LAST_TOKEN.search(prefix_tail)
    if not token:
        return False
    word = token.group(0)
    return word.lower() in _ABBREVIATIONS or bool(re.fullmatch(r"[A-Z]\.", word))


class _Cutter:
    def __init__(self, text: str, size: int) -> None:
        self.text = text
        self.size = size
        gaps = [(m.start(), m.end()) for m in _GAP.finditer(text)]
        self.starts = [s for s, _ in gaps]
        self.ends = [e for _, e in gaps]

    def cut(self, start: int, section_end: int) -> int:
        target = min(section_end, start + self.size)
        if target >= section_end:
            return section_end
        inside = self._last_inside(start, target)
        if inside is not None and inside - start > max(80, int((target - start) * 0.55)):
            return inside
        return self._next_after(start, target, section_end)

    def _last_inside(self, start: int, target: int) -> int | None:
        """End of the last sentence gap in the window. An abbreviation only hides a gap that
        begins with a line break there."""
        k = bisect_left(self.starts, target) - 1
        while k >= 0 and self.starts[k] > start:
            gap = self.starts[k]
            hidden = self.text[gap] == "\n" and _abbreviated(self.text[max(start, gap - 11) : gap])
            if not hidden:
                return min(self.ends[k], target)
            k -= 1
        return None

    def _next_after(self, start: int, target: int, section_end: int) -> int:
        limit = min(section_end, target + _LOOKAHEAD)
        k = bisect_right(self.starts, target)
        while k < len(self.starts) and self.starts[k] < limit:
            gap = self.starts[k]
            if not _abbreviated(self.text[max(start, gap - 11) : gap]):
                return min(self.ends[k], limit)
            k += 1
        return target


def split_text(text: str | None, size: int, overlap: int, sections: bool = True) -> list[dict]:
    """Chunks of one text. Offsets refer to the slice before white space is trimmed."""
    if not text or not text.strip():
        return []
    spans = _section_spans(text) if sections else [(None, 0, len(text))]
    # Sentence ends count only in sections longer than a chunk, and pages only behind the first character.
    cutter = _Cutter(text, size) if any(end - begin > size for _, begin, end in spans) else None
    page = _Page(text) if cutter or spans[-1][1] > 0 else None
    out: list[dict] = []
    for header, begin, end in spans:
        at = begin
        while at < end:
            stop = cutter.cut(at, end) if end - at > size else end
            body = text[at:stop].strip()
            if body:
                out.append(
                    {
                        "chunk_index": len(out),
                        "page_number": page.at(at) if at else 1,
                        "section_header": header,
                        "text": body,
                        "char_start": at,
                        "char_end": stop,
                        "word_count": max(1, len(body.split())),
                    }
                )
            if stop >= end:
                break
            at = max(begin, stop - overlap)
    return out


#: Rows of chunks are handed on after so many characters of text.
_SLICE_CHARS = 1 << 19


def _check_overlap(size: int, overlap: int) -> None:
    if not 0 <= overlap < min(size, max(80, int(size * 0.55))):
        raise ValueError("overlap must be smaller than the shortest possible chunk")


def chunk_rows(text: str, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP, sections: bool = True):
    """Arrow table function: one row per chunk with the row's other columns in front.

    A task holds the chunks of one slice of texts at a time, however many rows a batch has.
    """
    _check_overlap(size, overlap)
    kinds = {T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
    fields = [(f.name, kinds[f.dataType]) for f in CHUNK_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [c for c in batch.schema.names if c != text]
            texts, begin, chars, counts, rows = batch.column(text), 0, 0, [], []
            for i in range(batch.num_rows):
                value = texts[i].as_py()
                found = split_text(value, size, overlap, sections)
                counts.append(len(found))
                rows += found
                chars += len(value or "")
                if chars < _SLICE_CHARS and i + 1 < batch.num_rows:
                    continue
                if rows:
                    source = pa.array(np.repeat(np.arange(begin, i + 1), counts))
                    columns = [batch.column(c).take(source) for c in keep]
                    columns += [pa.array([r[name] for r in rows], kind) for name, kind in fields]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(name for name, _ in fields)])
                begin, chars, counts, rows = i + 1, 0, [], []

    return run


def chunk_udf(size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP, sections: bool = True):
    """Arrow UDF: text to an array of chunks."""
    _check_overlap(size, overlap)

    @F.pandas_udf(T.ArrayType(CHUNK_FIELDS))
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: split_text(t, size, overlap, sections))

    return chunks
