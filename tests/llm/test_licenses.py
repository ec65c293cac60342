import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from lexloom.llm.license_templates import LICENSE_TEMPLATES
from lexloom.llm.licenses import Scanner, TokenAutomaton, license_labels, license_places, parsed
from tests.llm.cases import AWKWARD, LONG, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def pattern(parts):
    """A template as a regular expression over words that stand between two spaces each."""
    found = ""
    for part in parts:
        if isinstance(part, bytes):
            found += f" {part.decode()} "
        elif isinstance(part, int):
            found += f"(?: [^ ]+ ){{0,{part}}}"
        elif part[0] == "optional":
            found += f"(?:{pattern(part[1])})?"
        else:
            found += f"(?:{'|'.join(pattern(p) for p in part[1])})"
    return found


def brute(text, templates):
    """Longest acceptance from every word, by trying all ends."""
    words, places = words_of(text), []
    for n, (_, markup) in enumerate(templates):
        whole, end = re.compile(pattern(parsed(markup))), -1
        for a in range(len(words)):
            ends = [b for b in range(len(words), a, -1) if whole.fullmatch("".join(f" {w} " for w in words[a:b]))]
            if ends and ends[0] > end:
                end = ends[0]
                places.append((a, end, n))
    return sorted(places)


def scanned(texts, templates):
    n_words, found = Scanner(templates).of(pa.array(texts, pa.string()))
    return n_words.tolist(), [found.get(i, []) for i in range(len(texts))]


def spelled(parts, rng):
    """One wording that a template accepts."""
    for part in parts:
        if isinstance(part, bytes):
            yield part.decode()
        elif isinstance(part, int):
            yield from (rng.choice("uvw") for _ in range(rng.randint(0, part)))
        elif part[0] == "optional":
            if rng.random() < 0.5:
                yield from spelled(part[1], rng)
        else:
            yield from (w.decode() for w in rng.choice(part[1]))


SMALL = [
    ("x", "a b [[c {{2}} d]] e"),
    ("y", "[[a]] b {{c|d e|e}} [[f [[g]] h]] a"),
    ("z", "{{a b|b a}} {{3}} c"),
    ("p", "a b a"),
    ("q", "[[[[a]] b [[c]]]] d e"),
]


def test_small_templates_against_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [" ".join(spelled(parsed(rng.choice(SMALL)[1]), rng)) + " " + rng.choice("abc") for _ in range(150)] + [None, "", "A-B.a"]
    n_words, found = scanned(texts, SMALL)
    for text, n, places in zip(texts, n_words, found):
        assert n == len(words_of(text)) and places == brute(text, SMALL), text
    assert min(Counter(n for p in found for *_, n in p).values()) > 5


def test_published_wordings_are_accepted_and_changed_ones_are_not():
    rng = random.Random(4)
    for n, (label, markup) in enumerate(LICENSE_TEMPLATES):
        automaton = TokenAutomaton(markup)
        for _ in range(3):
            words = [w.encode() for w in spelled(parsed(markup), rng)]
            assert automaton.accepted(words, 0) == len(words), label
        text = " ".join(spelled(parsed(markup), rng))
        changed = text.replace(" ".join(w.decode() for w in automaton.anchors[0]), "other wording")
        _, found = scanned([f"Before. {text.upper()}! after", changed], LICENSE_TEMPLATES)
        assert n in {t for *_, t in found[0]} and (changed == text or n not in {t for *_, t in found[1]})


@pytest.mark.parametrize("markup", ["", "[[a]]", "{{3}} a", "{{a|}}", "[[a b", "a ]]"])
def test_templates_without_a_beginning_are_refused(markup):
    with pytest.raises(ValueError):
        TokenAutomaton(markup)


def test_license_labels(spark):
    mit = next(m for label, m in LICENSE_TEMPLATES if label == "mit")
    full = " ".join(spelled(parsed(mit), random.Random(1)))
    rows = AWKWARD + [
        (20, "Released under the MIT License. Also under the MIT-license, and CC/BY NC"),
        (21, LONG + full + " " + LONG + "under the\nMIT license " + LONG),
        (22, "under the mit"),
        (23, "license under the apache license, VERSION 2.0"),
        (24, "This work is licensed under the GNU General Public License, version 3."),
    ]
    found = {r.doc_id: r for r in license_labels(docs(spark, rows).repartition(4), PHRASES).collect()}
    assert Counter(r.doc_id for r in license_labels(docs(spark, rows), PHRASES).collect()) == Counter(i for i, _ in rows)
    for i, text in (r for r in rows if r[0] is not None):
        words = words_of(text)
        at = [n for _, p in PHRASES for n in range(len(words)) if words[n : n + len(p.split())] == p.split()]
        r = found[i]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert found[20].base_labels == "cc-by-nc,mit" and found[20].labels == "cc-by-nc,mit"
    assert found[21].score == pytest.approx(len(words_of(full)) / found[21].n_words) and found[21].labels == "mit"
    assert found[23].labels == "apache-2" and found[24].labels == "gpl-3" and found[24].base_labels == ""
    assert found[1].labels == "" and found[1].score == 0
    text = rows[-5][1]
    places = next(r.places for r in license_places(docs(spark, rows[-5:-4]), PHRASES).collect())
    assert [text[p.start : p.end] for p in places] == ["under the MIT License", "under the MIT-license", "CC/BY NC"]
    assert license_labels(docs(spark, []), PHRASES).count() == 0
