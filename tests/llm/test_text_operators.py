import random
import re
import hashlib
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from lexloom.llm.decontaminate import clean_documents, contamination
from lexloom.llm.jaccard import _in_chunks, one_of_each, similar
from lexloom.llm.language import held_out, identified, languages, trained
from lexloom.llm.long_matches import RunLengthIndex, repeated_places, without_long_matches
from lexloom.llm.packing import OpenBins, WordIds, packed
from tests.llm.cases import AWKWARD, docs

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# Language ID


def test_languages_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = trained(table.filter(~held_out(table.doc_id)))
    found = {r.doc_id: r for r in languages(table, model).collect()}
    known = {r.doc_id: r.lang for r in table.filter(held_out(table.doc_id)).collect()}
    assert len(found) == table.count()
    assert sum(found[i].lang == lang for i, lang in known.items()) >= 0.97 * len(known)


def test_language_spans_and_scripts(spark):
    en, de, el = "the cat and the dog of this house ", "der hund und die katze in diesem haus ", "η γάτα και ο σκύλος του σπιτιού "
    labelled = spark.createDataFrame([(en * 9, "en"), (de * 9, "de"), (el * 9, "el"), (None, "en"), ("x", None)], "text string, lang string")
    model = trained(labelled)
    rows = [(20, en * 4), (21, en * 4 + de * 2), (22, "Και Η ΓΆΤΑ"), (23, "\u4e2d\u6587"), (24, "12 ?! ..."), (25, "caf\u00e9 " + en)]
    found = {r.doc_id: r for r in languages(docs(spark, rows + AWKWARD), model).collect()}
    assert [found[i].lang for i in (20, 21, 22, 24, 25)] == ["en", "en", "el", "und", "en"]
    assert found[23].lang in model.langs
    text = en * 4 + de * 2
    assert [(text[s.start : s.stop], s.lang) for s in found[21].spans] == [((en * 4).strip(), "en"), ((de * 2).strip(), "de")]
    assert found[1].lang == found[2].lang == found[3].lang == "und" and found[1].score == 0
    assert all(0 <= r.score <= 1 for r in found.values())
    kept = identified(docs(spark, rows), model)
    assert kept.columns == docs(spark, rows).columns and {r.doc_id for r in kept.collect()} >= {20, 21, 22, 25}
    nothing = trained(labelled.filter("lang is null"))
    assert {r.lang for r in languages(docs(spark, rows), nothing).collect()} == {"und"}
    assert languages(docs(spark, []), model).count() == 0


# Decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_hits(text, items, width):
    w, hit, ids = words(text), set(), set()
    for item, body in items:
        q = words(body)
        n = min(width, len(q))
        for k in range(len(q) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == q[k : k + n]:
                    hit |= set(range(i, i + n))
                    ids |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination(spark, block_bytes):
    rng = random.Random(5)
    vocabulary = ["Al\u00fc", "be", "CE", "de9", "e", "f"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, say(9)), (2, say(5) + "!"), (3, "be, CE"), (3, "be, CE"), (4, None), (5, "?"), (None, "de9-de9-de9"), (12, say(30))]
    rows = AWKWARD[:-2] + [(50 + i, say(rng.randrange(60)) + ("..." + items[i % 3][1]) * (i % 2)) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(docs(spark, rows), bench, width=4, block_bytes=block_bytes).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in found) == Counter(
        (i, n, h, tuple(x)) for i, t in rows for n, h, x in [brute_hits(t, items, 4)]
    )
    texts = dict(rows)
    for r in found:
        covered = " ".join(texts[r.doc_id][s.start : s.stop] for s in r.spans)
        assert len(words(covered)) == r.n_hit
    clean = clean_documents(docs(spark, rows), bench, width=4)
    assert clean.columns == docs(spark, rows).columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in found if not r.n_hit)
    assert contamination(docs(spark, []), bench).count() == 0
    assert {r.n_hit for r in contamination(docs(spark, rows), bench.filter("false")).collect()} == {0}


# Long matches


def brute_cut(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                mark[k : k + length] = b"\1" * length
            seen.add(raw[k : k + length])
        kept = bytes(c for c, m in zip(raw, mark) if not m)
        spans = len(re.findall(rb"\x01+", bytes(mark)))
        out.append((i, len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot,block", [(20_000, 1 << 18), (3, 40)])
def test_long_matches(spark, hot, block):
    rng = random.Random(1)
    say = lambda n: "".join(rng.choice("ab\u00e9\0 \n") for _ in range(n))
    shared, base = say(60), say(300)
    rows = [(i, t) for i, t in AWKWARD if i not in (None, 7, 9)]
    rows += [(100 + i, say(rng.randrange(80)) + shared[: rng.randrange(61)] + say(rng.randrange(80))) for i in range(30)]
    rows += [(300 + i, base[:k] + "#" + base[k:]) for i, k in enumerate(range(0, 300, 30))]
    rows += [(400, "x" * 200), (401, base), (402, base), (7, "xyz" * 50), (403, "short"), (404, "short")]
    found = without_long_matches(docs(spark, rows).repartition(4), length=20, gram=6, hot=hot, block=block).drop("spans")
    assert Counter(map(tuple, found.collect())) == brute_cut(rows, 20)


def test_long_matches_awkward(spark):
    assert without_long_matches(docs(spark, [])).count() == 0
    found = without_long_matches(docs(spark, AWKWARD)).collect()
    assert len(found) == len(AWKWARD)
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in found if r.doc_id == 9] == [(810_000, 810_000 - 27, 1)]


def test_run_length_index():
    strings = [b"abracadabra", b"abra", b"", b"cadabra\0x", b"aaaaaaa"]
    index = RunLengthIndex(strings)
    text = b"$".join(strings) + b"$"
    near, match = index.statistics()
    ends = [i for i, c in enumerate(text) if c == 36]
    left = lambda p: min(e for e in ends if e >= p) - p
    order = sorted(range(len(text)), key=lambda p: [*(c + 1 for c in text[p : p + left(p)]), 0, p + left(p)])
    for a, b in zip(order, order[1:]):
        common = 0
        while common < min(left(a), left(b)) and text[a + common] == text[b + common]:
            common += 1
        assert near[b] == a and match[b] == common
    assert index.lengths.sum() == len(text) and len(index.letters) < len(text)
    assert list(repeated_places([b"abcabcabc"], 3)) == [3, 4, 5, 6]


# N-gram Jaccard join


def brute_components(rows, size, num, den):
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None and (least[root(k)] is None or i < least[root(k)]):
            least[root(k)] = i
    return Counter((i, len(sets[k]), least[root(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("size,num", [(3, 90), (5, 80), (2, 60)])
def test_similar(spark, size, num):
    rng = random.Random(size)
    say = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) for _ in range(n)]
    rows = list(AWKWARD)
    boiler = say(25)
    for group in range(12):  # near copies that drift, in groups from one to many
        base = say(rng.choice([8, 40, 150]))
        for _ in range(rng.choice([1, 2, 5, 25])):
            base = list(base)
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = rng.choice(["new", "other", "more"])
            text = " ".join(base).title() if rng.random() < 0.2 else "\n".join(base)
            rows.append((1000 + len(rows), text))
    rows += [(5000 + i, " ".join(boiler + say(12))) for i in range(40)]  # one passage shared by many
    found = similar(docs(spark, rows).repartition(3), size, num, 100)
    assert Counter(map(tuple, found.collect())) == brute_components(rows, size, num, 100)


def test_one_of_each(spark):
    rows = [(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, "a b c"), (4, None), (5, None)]
    left = one_of_each(docs(spark, rows))
    assert left.columns == docs(spark, rows).columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5]
    assert similar(docs(spark, [])).count() == 0


# Packing


def test_word_ids_equal_whole_texts():
    ids = WordIds(TOKENIZER, limit=30)
    texts = [t or "" for _, t in AWKWARD[:10]] + [
        "don't  stop now!! it's \u0130stanbul \u0391\u03a3 J\u030c x.y... 12,3 a'll b \x1c c <|endoftext|> na\u00efve. \u00dcn\u00efcode!?",
        "l'\u00e9t\u00e9, 'S 'LL a\u00a0b \u2028c " + " ".join(f"w{i}x, Word{'abcdefghij'[i % 10] * (i % 9)}." for i in range(200)),
    ]
    for _ in range(3):
        for text in texts:
            want = ids.tokenizer.encode(text, add_special_tokens=False).ids
            assert ids.of([text]) == [array("I", want).tobytes()]


def test_open_bins():
    bins = OpenBins(10, 2, 0)
    assert [bins.place(n) for n in (6, 5, 3, 5)] == [(0, 0), (1, 0), (0, 6), (1, 5)]
    bins = OpenBins(10, 2, 0)
    assert [bins.place(n) for n in (9, 8, 7, 1)] == [(0, 0), (1, 0), (2, 0), (1, 8)]  # three open: the fullest closed


def test_packed(spark):
    rows = [(i, t) for i, t in AWKWARD if t is None or len(t) < 1000] + [(100 + i, "alpha beta " * (i * 9)) for i in range(60)] + [(9, "long text " * 9000)]
    found = packed(docs(spark, rows).repartition(2), TOKENIZER, room=256, open_bins=8).collect()
    ids = WordIds(TOKENIZER)
    want = []
    for i, text in rows:
        raw = ids.of([text or ""])[0] + bytes(4)
        for k in range(0, len(raw), 1024):
            part = raw[k : k + 1024]
            want.append((i, k // 1024, k // 4, len(part) // 4, zlib.crc32(part)))
    assert Counter(r[:5] for r in map(tuple, found)) == Counter(want)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.1 * sum(w[3] for w in want) / 256 + 2
    assert packed(docs(spark, []), TOKENIZER).count() == 0


def test_long_posting_lists_in_chunks(spark):
    """Texts of one form: a list above the chunk size is compared in parts, with the same result."""
    rng = random.Random(8)
    form = [f"form{k}" for k in range(60)]
    rows = []
    for i in range(60):
        filled = list(form)
        filled[rng.randrange(60)] = f"own{i}"
        filled[rng.randrange(60)] = f"other{i // 2}"
        rows.append((i, " ".join(filled)))
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 60, 7)]
    want = sorted((i, c) for i, _, c in brute_components(rows, 3, 90, 100))
    for chunk in (7, 1 << 14):
        found = similar(docs(spark, rows), chunk=chunk).collect()
        assert sorted((r.doc_id, r.component_id) for r in found) == want
    lists = spark.range(50).selectExpr("5L token", "id class", "60 n", "1 need", "id component", "binary('') sketch", "8L parts")
    met = Counter()
    keys = defaultdict(list)
    for r in _in_chunks(lists).collect():
        keys[r.key].append((r["class"], r.chunk))
    for members in keys.values():
        met.update((a, b) for a, x in members for b, y in members if a < b and (x < 0 or x != y))
    assert met == Counter((a, b) for a in range(50) for b in range(a + 1, 50)) and max(map(len, keys.values())) < 30
