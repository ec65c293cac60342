"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

Words are runs of letters. A word's score for a language is the log-likelihood of its byte n-grams,
within ``reach`` of the word's best language, so that one odd word cannot force a switch. Languages
that are not written in the word's script are out; words in a script that no language was trained on
say nothing. Viterbi takes the best labelling of a text's words, where each switch of language costs
``switch``. The prediction is the language with the most letters; its share of all letters is the score.

The model is fitted on at most about ``per_lang`` distinct labelled texts of each language, drawn by
a hash of the text; every text is labelled whole. A text that is null or has no letter, or a model without
languages, gives ``und`` and 0. A text whose letters are no words to us gets the commonest language
and 0. Ties go to the language first in order. Repeated rows are labelled alike; extra columns are
ignored by ``languages`` and kept by ``identified``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Rolling, slices, utf8

BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
#: First code points of ranges, each up to the next; "" is no script.
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0780, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, ""),
    (0x0B80, "Tamil"), (0x0C00, ""), (0x0E00, "Thai"), (0x0E80, ""), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"),
    (0x3100, ""), (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""),
)
_FIRST = np.array([r[0] for r in SCRIPT_RANGES])
SCRIPTS = sorted({r[1] for r in SCRIPT_RANGES})
_SCRIPT = np.array([SCRIPTS.index(r[1]) for r in SCRIPT_RANGES])
_RESULT = "lang string, score double, spans array<struct<start: long, stop: long, lang: string>>"


@dataclass
class Words:
    """The words of a slice of texts: byte bounds, owners, code-point bounds, and the distinct words."""

    n_texts: int
    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    kind: np.ndarray
    script: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    letters: np.ndarray


def words_in(texts: pa.Array) -> Words:
    data, ends = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    n = len(data)
    letter = ((data >= 97) & (data <= 122)) | (data >= 0x80)
    ascii_letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    # Latin-1 signs, general and CJK punctuation are no letters.
    after = np.append(data[1:], 0) if n else data
    for lead, low, high, width in ((0xC2, 0x80, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3)):
        for k in range(width):
            at = np.flatnonzero((data == lead) & (after >= low) & (after <= high)) + k
            letter[at[at < n]] = False
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    before = np.concatenate([[False], letter[:-1]]) & ~cut[:n] if n else letter
    following = np.concatenate([letter[1:], [False]]) & ~cut[1:] if n else letter
    start = np.flatnonzero(letter & ~before)
    stop = np.flatnonzero(letter & ~following) + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = np.searchsorted(ends, start, side="right") - 1
    base = points[ends[:-1]]
    # Distinct words, by their hash.
    roll = Rolling(data)
    _, sample, kind = np.unique(roll.of(start, stop), return_index=True, return_inverse=True)
    s, e = start[sample], stop[sample]
    code = data[s].astype(np.int64)
    follow = [data[np.minimum(s + k, n - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)] if n else []
    if n:
        code = np.where(code >= 0xF0, (code & 7) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2],
               np.where(code >= 0xE0, (code & 15) << 12 | follow[0] << 6 | follow[1],
               np.where(code >= 0xC0, (code & 31) << 6 | follow[0], code)))
    script = _SCRIPT[np.searchsorted(_FIRST, code, side="right") - 1]
    # Byte n-grams of the distinct words, each between two blanks.
    width = e - s + 2
    begin = np.cumsum(width) - width
    padded = np.full(int(width.sum()), 32, np.uint8)
    owner = np.repeat(np.arange(len(s)), width)
    inside = np.arange(len(padded)) - begin[owner]
    body = (inside > 0) & (inside < width[owner] - 1)
    padded[body] = data[s[owner[body]] + inside[body] - 1]
    roll = Rolling(padded)
    grams = []
    for size in GRAMS:
        at = np.flatnonzero(inside + size <= width[owner])
        grams.append((owner[at], (roll.of(at, at + size) >> np.uint64(49)).astype(np.int64)))
    return Words(len(ends) - 1, start, stop, text, points[start] - base[text], points[stop] - base[text], kind, script,
                 grams, ascii_letters[ends[1:]] - ascii_letters[ends[:-1]])


def _counted(batches):
    """Rows (lang, place, n): place is a bucket of n-grams, or BUCKETS + a script."""
    total: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            words = words_in(batch.column("text").filter(pa.array(langs == lang)))
            count = np.bincount(words.kind, minlength=len(words.script))
            mine = total.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS)))
            for owner, bucket in words.grams:
                mine[:BUCKETS] += np.bincount(bucket, count[owner], BUCKETS)
            mine[BUCKETS:] += np.bincount(words.script, count, len(SCRIPTS))
    for lang, counts in total.items():
        places = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([lang] * len(places), pa.string()), "place": pa.array(places, pa.int32()), "n": pa.array(counts[places].astype(np.int64))}
        )


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # languages x buckets
    written: np.ndarray  # scripts x languages
    common: int


def trained(labelled: DataFrame, per_lang: int = 3000) -> Model:
    """A model from rows (text, lang), of which rows with a null are left out.

    What reaches the driver is at most BUCKETS + scripts counts for each language.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    code = F.xxhash64("text")
    sizes = {r["lang"]: r["count"] for r in rows.select("lang", code.alias("code")).distinct().groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((len(SCRIPTS), 0), bool), 0)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(per_lang / sizes[lang])).otherwise(share)
    drawn = rows.filter(F.pmod(code, F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["lang", "text"])
    counts = drawn.mapInArrow(_counted, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    table = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    found = counts.toPandas()
    table[found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), found["place"].to_numpy()] = found["n"]
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    logs = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
    written = scripts.T >= np.maximum(1, 0.005 * scripts.sum(1))
    return Model(langs, logs, written, int(np.argmax([sizes[x] for x in langs])))


def word_scores(words: Words, model: Model, reach: float) -> np.ndarray:
    """Distinct words x languages: 0 for the best language, down to -reach."""
    n = len(words.script)
    scores = np.zeros((n, len(model.langs)), np.float32)
    for owner, bucket in words.grams:
        for k, logs in enumerate(model.logs):
            scores[:, k] += np.bincount(owner, logs[bucket], n).astype(np.float32)
    able = model.written[words.script]
    scores[~able] = -np.inf
    best = scores.max(1, keepdims=True)
    known = able.any(1)
    scores[known] = np.maximum(scores[known] - best[known], -reach)
    scores[~known] = 0
    return scores


def labels(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; ``scores`` holds the words of all texts, one text after the other.

    All texts advance together, longest first, so that each step is one operation on arrays.
    """
    total, langs = scores.shape
    kind = np.int8 if langs < 128 else np.int16 if langs < 1 << 15 else np.int32
    label = np.zeros(total, kind)
    if not total:
        return label
    order = np.argsort(-lengths, kind="stable")
    base = (np.cumsum(lengths) - lengths)[order]
    length = lengths[order]
    live = len(order) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")
    came = np.empty((total, langs), kind)
    every = np.arange(langs, dtype=kind)
    value = np.zeros((len(order), langs), np.float32)
    for t in range(length[0]):
        n = live[t]
        at = base[:n] + t
        v = value[:n]
        best = v.argmax(1)
        jump = v[np.arange(n), best] - switch
        hop = v < jump[:, None]
        came[at] = np.where(hop, best[:, None], every)
        np.copyto(v, jump[:, None], where=hop)
        v -= v.max(1, keepdims=True)
        v += scores[at]
    now = value.argmax(1)
    for t in range(length[0] - 1, -1, -1):
        n = live[t]
        at = base[:n] + t
        label[at] = now[:n]
        now[:n] = came[at, now[:n]]
    return label


def _label(shared, switch: float, reach: float):
    def run(batches):
        model = shared.value
        langs = np.array([*model.langs, "und"], object)
        for batch in slices(batches, limit=1 << 20):
            texts = batch.column("text")
            words = words_in(texts)
            n, k = words.n_texts, len(model.langs)
            lengths = np.bincount(words.text, minlength=n)
            size = words.last - words.first
            if k:
                label = labels(word_scores(words, model, reach)[words.kind], lengths, switch)
            else:
                label = np.zeros(len(size), np.int8)
            share = np.bincount(words.text * max(k, 1) + label.astype(np.int64), size, n * max(k, 1)).reshape(n, -1)
            pick = share.argmax(1)
            whole = share.sum(1)
            score = np.where(whole > 0, share.max(1) / np.maximum(whole, 1), 0.0)
            pick[whole == 0] = model.common
            for i in np.flatnonzero(words.letters == 0):
                if not any(c.isalpha() for c in texts[int(i)].as_py() or ""):
                    pick[i], score[i] = k, 0.0
            if not k:
                pick[:], score[:] = 0, 0.0
            new = np.ones(len(label), bool)
            new[1:] = (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])
            lead = np.flatnonzero(new)
            tail = np.append(lead[1:], len(label)) - 1 if len(lead) else lead
            bounds = np.searchsorted(words.text[lead], np.arange(n + 1))
            spans = pa.ListArray.from_arrays(
                pa.array(bounds, pa.int32()),
                pa.StructArray.from_arrays(
                    [pa.array(words.first[lead]), pa.array(words.last[tail]), pa.array(langs[label[lead]], pa.string())],
                    names=["start", "stop", "lang"],
                ),
            )
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(langs[pick], pa.string()), pa.array(score, pa.float64()), spans],
                names=[*kept, "lang", "score", "spans"],
            )

    return run


def _labelled(texts: DataFrame, model: Model, switch: float, reach: float) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats
    kept = [f for f in texts.schema if f.name != "text"]
    return texts.mapInArrow(_label(shared, switch, reach), T.StructType([*kept, *T._parse_datatype_string(_RESULT)]))


def languages(docs: DataFrame, model: Model, switch: float = 8.0, reach: float = 5.0) -> DataFrame:
    """For each row of ``docs``: doc_id, lang, score, and spans of one language by code points."""
    return _labelled(docs.select("doc_id", F.col("text").cast("string").alias("text")), model, switch, reach)


def identified(docs: DataFrame, model: Model, switch: float = 8.0, reach: float = 5.0) -> DataFrame:
    """The rows of ``docs`` whose text has letters: all that a model does not label ``und``, mixed texts too."""
    if not model.langs:  # it labels every text und
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return _labelled(rows, model, switch, reach).filter(F.col("lang") != "und").select("row.*")


def held_out(doc_id: Column) -> Column:
    """True for about a fifth of the documents, which no model may learn from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0
