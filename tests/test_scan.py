import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.operators import preferences, sections
from lexloom.operators.scan import fold_clamped, numbered


def test_fold_against_sequential_rule(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aabc"), i // 3, rng.choice([0.3, -0.2, 0.05, -0.9, None])) for i in range(3000)] + [(None, 1, 0.5)]
    table = spark.createDataFrame(rows, "k string, t int, d double").repartition(4)
    found = {r["k"]: r for r in fold_clamped(table, "k", ["t", "d"], "d").collect()}
    for k in {r[0] for r in rows}:
        value = 0.5
        for _, _, d in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
            value = min(1.0, max(0.0, value + (d or 0.0)))
        r = found[k]
        assert min(r["hi"], max(r["lo"], 0.5 + r["shift"])) == pytest.approx(value, abs=1e-9)


def test_a_million_reviews_of_one_rule_in_one_hour(spark):
    n = 1_000_000
    reviews = spark.range(n, numPartitions=6).select(
        F.array(F.lit("hot")).alias("preferences_applied"),
        (F.col("id") % 3).cast("int").alias("edited_sections"),
        F.lit(4).alias("total_sections"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919 % n) / 300).alias("reviewed_at"),
        F.col("id").alias("draft_id"),
    )
    rules = spark.createDataFrame([("hot", 0.5), ("cold", None)], "preference_id string, effectiveness_score double")
    found = {r[0]: r[1] for r in preferences.update_effectiveness(rules, reviews).select("preference_id", "effectiveness_score").collect()}
    value = 0.5
    for i in sorted(range(n), key=lambda i: (int(i * 7919 % n / 300 * 1_000_000), i)):
        edited = i % 3
        value = min(1.0, max(0.0, value + (0.10 if edited == 0 else -0.05 * edited / 4)))
    assert found["hot"] == pytest.approx(value, abs=1e-6) and found["cold"] is None


def test_numbered_like_row_number(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 6 + ["b", None, "ü"]), rng.randint(0, 1), rng.randint(0, 50), i) for i in range(4000)]
    rows += [("same", 0, 7, 1)] * 500  # equal in all that orders them
    table = spark.createDataFrame(rows, "k string, m int, t int, id int").repartition(5)
    found = numbered(table, ["k", "m"], ["t", "id"], "n").collect()
    assert Counter(tuple(r)[:4] for r in found) == Counter(rows)
    groups = defaultdict(list)
    for r in found:
        groups[r["k"], r["m"]].append((r["t"], r["id"], r["n"]))
    for members in groups.values():
        assert [n for *_, n in sorted(members)] == list(range(1, len(members) + 1))
    assert numbered(table.where("false"), ["k"], ["t"], "n").count() == 0


def test_section_spans_against_line_loop(spark):
    rng = random.Random(6)
    lines = ["1. Terms of use", "DEFINITIONS", "plain words", "", "   ", "über", "Article 4 Payment", "x" * 300]
    texts = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 40)))) for i in range(80)]
    texts += [(100, None), (101, ""), (102, "\n\n"), (103, "TERMS AND MORE\n" * 20_000), (104, "one line")]
    table = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    of_line = {
        r["line"]: r["h"]
        for r in spark.createDataFrame([(x,) for x in {*lines, "TERMS AND MORE", "one line"}], "line string")
        .select("line", sections.header_text(F.col("line")).alias("h")).collect()
    }
    wanted = []
    for doc, text in texts:
        if text is None:
            continue
        at, parts = 0, []
        for no, line in enumerate(text.split("\n")):
            header = of_line.get(line)
            if no == 0 or header:
                parts.append([header, at, at, ""])
            at += len(line) + 1
            parts[-1][2] = at
            parts[-1][3] += line
        parts[-1][2] -= 1
        wanted += [(doc, h, a, b) for h, a, b, ink in parts if ink.strip()]
    assert Counter(tuple(r) for r in sections.section_spans(table, "doc_id").collect()) == Counter(wanted)
    assert any(h for _, h, *_ in wanted)
