import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm.importance import Composition, Features, drawn_documents, resampled
from tests.llm.cases import AWKWARD, docs

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", "  ", "One", "a b", "A-b  c d; e", "x" * 200 + " y " + "z" * 5000, "ü ß 中文 wörd\x7f", "the the the " * 90]


def features(text, most=3):
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return len(words), [b" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def test_composed_crcs():
    rng = np.random.default_rng(5)
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in zip(rng.integers(0, 90, 300), rng.integers(0, 9000, 300))]
    left, right = (np.array([zlib.crc32(p[i]) for p in parts], np.uint32) for i in (0, 1))
    both = Composition().after(left, np.array([len(b) for _, b in parts])) ^ right
    assert both.tolist() == [zlib.crc32(a + b) for a, b in parts]


@pytest.mark.parametrize("piece, room, most", [(2 << 20, 1 << 20, 3), (50, 1 << 20, 3), (1000, 40, 3), (64, 0, 1), (90, 1 << 20, 5)])
def test_buckets_of_features(piece, room, most):
    made = Features(most, 10_000, room, piece)
    texts = ODD + [" ".join(f"w{i * j % 900}" for j in range(40)) for i in range(60)]
    for _ in range(3):  # the later rounds find their words in the automaton
        words, found = np.zeros(len(texts), int), [[] for _ in texts]
        for word_row, row, bucket in made.of(pa.array(texts)):
            words += np.bincount(word_row, minlength=len(texts))
            for i, b in zip(row.tolist(), bucket.tolist()):
                found[i].append(b)
        for text, n, mine in zip(texts, words.tolist(), found):
            count, runs = features(text, most)
            assert n == count and sorted(mine) == sorted(zlib.crc32(r) % 10_000 for r in runs)
    assert bool(made.dictionary.known) == (room > 5000)


def brute(rows, target, share=(5, 100), least=20, buckets=10_000):
    def counts(texts):
        return Counter(zlib.crc32(f) % buckets for t in texts for f in features(t)[1])

    s, t = counts(x for _, x in rows), counts(target)
    s_all, t_all = s.total() + buckets, t.total() + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in s}
    scored = []
    for i, text in rows:
        n, runs = features(text)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in runs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fits = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    k = share[0] * len(fits) // share[1]
    return Counter(scored), [(r[4], r[0], n + 1) for n, r in enumerate(fits[:k])], fits[k - 1] if k else None


def rows_of(n):
    return [(100 + i, " ".join(f"w{(i * 31 + j * j) % 700}" for j in range(10 + i % 50))) for i in range(n)]


def test_resampled(spark):
    rows = AWKWARD + rows_of(300) + rows_of(4)
    target = [None, "", "w1 w2 w3 w4", "w31 w32 w35 w40 w47", "the same text"]
    table = docs(spark, rows).repartition(6)
    items = docs(spark, list(enumerate(target)))
    scored, drawn, last = brute(rows, target, (20, 100))
    found = resampled(table, items, share=(20, 100)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in found) == scored
    assert sorted((r.rank for r in found if r.rank)) == list(range(1, len(drawn) + 1))
    assert sorted(((r.score, r.doc_id, r.rank) for r in found if r.rank), key=lambda r: r[2]) == drawn
    whole = drawn_documents(table, items, share=(20, 100))
    assert whole.columns == table.columns
    least = (-last[4], last[0] is None, last[0] or 0)
    expected = Counter(r[0] for r in scored.elements() if r[1] >= 20 and (-r[4], r[0] is None, r[0] or 0) <= least)
    assert Counter(r.doc_id for r in whole.collect()) == expected


def test_many_rows_of_one_id_and_empty_tables(spark):
    rows = [(7, "a b c d e f g h i j k l m n o p q r s t u")] * 400
    found = resampled(docs(spark, rows).repartition(5), docs(spark, []), share=(50, 100)).collect()
    assert sorted(r.rank for r in found if r.rank) == list(range(1, 201)) and len(found) == 400
    empty = docs(spark, [])
    assert resampled(empty, empty).count() == 0 and drawn_documents(empty, empty).count() == 0
    assert drawn_documents(docs(spark, AWKWARD[:5]), empty).count() == 0
