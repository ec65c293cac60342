"""License scans by template-markup matching.

A template is wording with markup: ``[[ ... ]]`` is an optional region (regions nest), ``{{n}}`` a
replaceable region of at most n words, ``{{a|b c}}`` one of several wordings; all else is mandatory. Each
template is compiled to a token automaton: a state for every word or replaceable word, and for each
state the set of states that may follow, past the regions that may be left out. The automaton walks a
text's words as a set of states held in the bits of a number and accepts where it reaches a last state,
so all mandatory words must stand there, in order, with nothing between them but what the markup allows.
A phrase is a template without markup.

Texts lower-case A-Z and split into words (digits, letters and non-ASCII characters). A place is a word
at which a template accepts, with the longest wording that it accepts from there; a place within an
earlier one of the same template is left out. The anchor of each template is its longest mandatory run
of words (or choice of wordings, if longer). Anchors are looked for first, with one Aho-Corasick
automaton over whole slices of texts; token automata walk only the words around anchors, as far as the
template reaches, so a long text takes no more of them than its places need.

No row moves. Null and empty texts have no words and no places; repeated rows each get their row. Extra
columns are ignored. A template must begin with words, not with a replaceable region, and have mandatory
wording.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import slices, utf8
from lexloom.llm.license_templates import LICENSE_TEMPLATES

_SPACE, _BREAK = 32, 10
_LOWER_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else _SPACE for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"(\[\[|\]\]|\{\{.*?\}\})", re.S)
_PLACE = pa.struct(
    [("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("stop", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
)
_RESULT = (
    "n_words long, places array<struct<label: string, template: int, first: long, stop: long, start: long, end: long>>"
)


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER_WORDS).split()


def parsed(markup: str) -> list:
    """Parts of a template: a word (bytes), an int (at most so many words), ("optional", parts), ("choice", [parts])."""
    stack: list[list] = [[]]
    for piece in _MARKUP.split(markup):
        if piece == "[[":
            stack.append([])
        elif piece == "]]":
            inner = stack.pop()
            if not stack:
                raise ValueError(f"an optional region ends that never began: {markup[:60]!r}")
            stack[-1].append(("optional", inner))
        elif piece.startswith("{{"):
            inside = piece[2:-2].strip()
            stack[-1].append(int(inside) if inside.isdecimal() else ("choice", [_words(w) for w in inside.split("|")]))
        else:
            stack[-1].extend(_words(piece))
    if len(stack) > 1:
        raise ValueError(f"an optional region never ends: {markup[:60]!r}")
    return stack[0]


def _bits(states: int):
    while states:
        low = states & -states
        yield low.bit_length() - 1
        states ^= low


class TokenAutomaton:
    """Accepts the wordings of one template; states are bits."""

    def __init__(self, markup: str) -> None:
        self.any = 0
        self.of_word: dict[bytes, int] = {}
        self.follow: list[int] = []
        parts = parsed(markup)
        self.first, self.last, empty = self._sequence(parts)
        self.longest = len(self.follow)
        sets: list[list[list[bytes]]] = [[[]]]  # one of each set stands in every accepted wording
        for part in parts:
            if isinstance(part, bytes):
                sets[-1][0].append(part)
            else:
                sets += [part[1] if not isinstance(part, int) and part[0] == "choice" else [[]], [[]]]
        self.anchors = max(sets, key=lambda wordings: min(map(len, wordings)))
        if empty or not all(self.anchors) or self.first & self.any:
            raise ValueError(f"a template begins with words and has mandatory ones: {markup[:60]!r}")
        self.first_words = {w for w, states in self.of_word.items() if states & self.first}
        self.jumps = {s: f for s, f in enumerate(self.follow) if f != 2 << s}
        self.jumpers = sum(1 << s for s in self.jumps)

    def _state(self) -> int:
        self.follow.append(0)
        return 1 << (len(self.follow) - 1)

    def _part(self, part) -> tuple[int, int, bool]:
        """First states, last states, and whether the part may be left out."""
        if isinstance(part, bytes):
            state = self._state()
            self.of_word[part] = self.of_word.get(part, 0) | state
            return state, state, False
        if isinstance(part, int):  # a chain that can be entered anywhere and is left at its end
            states = [self._state() for _ in range(part)]
            for a, b in pairwise(states):
                self.follow[a.bit_length() - 1] = b
            self.any |= sum(states)
            return sum(states), states[-1] if states else 0, True
        kind, inner = part
        if kind == "optional":
            first, last, _ = self._sequence(inner)
            return first, last, True
        found = [self._sequence(words) for words in inner]
        first = last = 0
        for f, l, _ in found:
            first, last = first | f, last | l
        return first, last, any(e for *_, e in found)

    def _sequence(self, parts) -> tuple[int, int, bool]:
        first, last, empty = 0, 0, True
        for part in parts:
            f, l, e = self._part(part)
            for s in _bits(last):
                self.follow[s] |= f
            first |= f if empty else 0
            last = last | l if e else l
            empty = empty and e
        return first, last, empty

    def accepted(self, words: list[bytes], at: int) -> int:
        """The end of the longest wording that begins at word ``at``, or 0."""
        active = self.first & self.of_word.get(words[at], 0)
        end = 0
        for n in range(at + 1, len(words) + 1):
            if active & self.last:
                end = n
            if not active or n == len(words):
                break
            following = (active & ~self.jumpers) << 1
            for s in _bits(active & self.jumpers):
                following |= self.jumps[s]
            active = following & (self.of_word.get(words[n], 0) | self.any)
        return end

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        for at, word in enumerate(words):
            if word in self.first_words:
                end = self.accepted(words, at)
                if end and (not found or end > found[-1][1]):
                    found.append((at, end))
        return found


class Scanner:
    """Places of all templates in slices of texts."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.labels = [label for label, _ in templates]
        self.automata = [TokenAutomaton(markup) for _, markup in templates]
        self.anchors = ahocorasick.Automaton()
        by_anchor: dict[str, list[int]] = {}
        for n, automaton in enumerate(self.automata):
            for anchor in automaton.anchors:
                by_anchor.setdefault(f" {b' '.join(anchor).decode('latin-1')} ", []).append(n)
        for anchor, owners in by_anchor.items():
            self.anchors.add_word(anchor, (len(anchor), owners))
        if by_anchor:
            self.anchors.make_automaton()

    def of(self, texts: pa.Array) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
        """Words of each text, and for texts with places their (first word, end, template), sorted."""
        data, ends = utf8(texts)
        line = np.frombuffer(_LOWER_WORDS, np.uint8)[data]
        # a space, a break and a space around every text; then runs of spaces become one
        line = np.insert(line, np.repeat(ends, 3), np.tile(np.array([_SPACE, _BREAK, _SPACE], np.uint8), len(ends)))
        line = line[~((line == _SPACE) & (np.concatenate([[0], line[:-1]]) == _SPACE))]
        gap = line <= _SPACE
        starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        stops = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        text_of = np.searchsorted(np.flatnonzero(line == _BREAK), starts) - 1
        first_word = np.searchsorted(text_of, np.arange(len(ends)))  # and the end of the last text's
        raw = line.tobytes()
        found: dict[int, set] = {}
        if len(self.anchors):
            near: dict[tuple[int, int], list[int]] = {}
            for end, (size, owners) in self.anchors.iter(raw.decode("latin-1")):
                word = int(np.searchsorted(starts, end - size + 2))
                for n in owners:
                    near.setdefault((int(text_of[word]), n), []).append(word)
            for (text, n), words in near.items():
                for low, high in self._windows(words, self.automata[n].longest, first_word[text], first_word[text + 1]):
                    part = raw[starts[low] : stops[high - 1]].split(b" ")
                    offset = low - int(first_word[text])
                    found.setdefault(text, set()).update((a + offset, b + offset, n) for a, b in self.automata[n].places(part))
        return np.diff(first_word), {text: sorted(places) for text, places in found.items() if places}

    @staticmethod
    def _windows(words: list[int], reach: int, least: int, most: int):
        low = high = None
        for word in sorted(words):
            a, b = max(int(least), word - reach), min(int(most), word + reach)
            if high is not None and a <= high:
                high = b
                continue
            if high is not None:
                yield low, high
            low, high = a, b
        yield low, high


def _characters(text: str, places) -> dict[int, tuple[int, int]]:
    """Character ranges of the words at which places begin or end."""
    needed = {w for first, stop, _ in places for w in (first, stop - 1)}
    last = max(needed)
    found = {}
    for n, m in enumerate(_WORD.finditer(text)):
        if n in needed:
            found[n] = m.span()
        if n == last:
            break
    return found


def _scan(templates):
    def run(batches):
        scanner = Scanner(templates)
        for part in slices(batches):
            texts = part.column("text")
            n_words, found = scanner.of(texts)
            places = []
            for i in range(part.num_rows):
                mine = found.get(i, ())
                at = _characters(texts[i].as_py(), mine) if mine else {}
                places.append([(scanner.labels[n], n, a, b, at[a][0], at[b - 1][1]) for a, b, n in mine])
            rows = [[dict(zip(("label", "template", "first", "stop", "start", "end"), p)) for p in mine] for mine in places]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(rows, pa.list_(_PLACE))],
                names=["doc_id", "n_words", "places"],
            )

    return run


def license_places(docs: DataFrame, templates: list[tuple[str, str]] = LICENSE_TEMPLATES) -> DataFrame:
    """doc_id, n_words and places: label, number of the template, words [first, stop) and characters [start, end)."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_scan(list(templates)), f"doc_id {doc_id}, {_RESULT}")


def license_labels(
    docs: DataFrame, phrases: list[tuple[str, str]], templates: list[tuple[str, str]] = LICENSE_TEMPLATES
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    ``phrases`` are the base: n_base counts their places, first_word and last_word are the least and the
    largest first word of these. ``labels`` adds those of the templates. Labels are distinct, sorted and joined by
    commas. The score is the share of the text's words in its longest place, 0 without a place.
    """
    found = license_places(docs, [*phrases, *templates])
    base = F.filter("places", lambda p: p["template"] < len(phrases))
    first = F.transform(base, lambda p: p["first"])
    sizes = F.transform("places", lambda p: p["stop"] - p["first"])
    share = F.array_max(sizes) / F.col("n_words")

    def joined(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.when(F.size("places") > 0, share).otherwise(F.lit(0.0)).alias("score"),
    )
