import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from lexloom.llm.exact_dedup import exact_groups, without_copies
from lexloom.llm.sharding import differenced, sharded
from tests.llm.cases import AWKWARD, docs


def normal(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def expected(rows):
    groups = defaultdict(list)
    for place, (i, text) in enumerate(rows):
        groups[normal(text)].append((-len(text or ""), i is None, i or 0, place, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m is best, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return Counter(out)


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_exact_groups(spark, hot_rows):
    rows = AWKWARD + [(100 + i, "a b\tc" + " " * (i % 7)) for i in range(40)] + [(200 + i, f"text {i // 3}") for i in range(30)]
    found = exact_groups(docs(spark, rows).repartition(5), salts=3, hot_rows=hot_rows)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, found.collect())) == expected(rows)


def test_without_copies_keeps_columns(spark):
    table = docs(spark, AWKWARD)
    left = without_copies(table)
    assert left.columns == table.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([3, 4, 5, 6, 8, 9])
    assert without_copies(docs(spark, [])).count() == 0 and exact_groups(docs(spark, [])).count() == 0


def test_differencing_balances():
    assert differenced([], 4) == []
    sizes = [8, 7, 6, 5, 4]
    shard = differenced(sizes, 2)
    loads = [sum(s for s, x in zip(sizes, shard) if x == k) for k in (0, 1)]
    assert sorted(loads) == [14, 16]  # the classical example of the differencing method
    sizes = [(i * 7919) % 1000 + 1 for i in range(3000)]
    loads = Counter()
    for s, x in zip(sizes, differenced(sizes, 16)):
        loads[x] += s
    assert max(loads.values()) - min(loads.values()) <= 2


def test_sharded(spark):
    rows = AWKWARD + [(1000 + i, "word " * ((i * 37) % 200) + str(i // 2)) for i in range(2000)]
    found = sharded(docs(spark, rows).repartition(6), shards=8, block=100).collect()
    assert len(found) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    for k in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == k) == list(range(sum(r.shard == k for r in found)))
    homes = defaultdict(set)
    texts = {(i, zlib.crc32((t or "").encode())): t or "" for i, t in rows}
    for r in found:
        homes[texts[r.doc_id, r.text_crc32]].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    loads = Counter()
    for r in found:
        loads[r.shard] += r.size
    rest = sorted(loads.values())[:-1]  # one text holds more than a shard's share
    assert len(loads) == 8 and max(rest) - min(rest) < 0.01 * max(rest)
    assert sharded(docs(spark, [])).count() == 0
