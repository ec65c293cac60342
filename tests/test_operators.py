import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions.chunker import chunk_udf, split_text
from lexloom.functions.fuzzy import fuzzy_total
from lexloom.operators import (
    analytics, classify, conflicts, evaluate, preferences, retrieve, validate,
)
from lexloom.operators.confidence import score_fields
from lexloom.operators.occurrences import enclosing, occurrences


def test_chunks_cover_and_overlap():
    rng = random.Random(7)
    words = ["alpha", "Inc.", "beta", "gamma!", "No.", "delta.", "x", "\f", "4. Terms of use\n", "END MATTER\n"]
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 900)))
        got = split_text(text, 600, 120)
        if not got:
            continue
        assert got[0]["char_start"] == 0 and got[-1]["char_end"] == len(text)
        assert [c["chunk_index"] for c in got] == list(range(len(got)))
        for a, b in zip(got, got[1:]):
            assert b["char_start"] <= a["char_end"] and b["char_start"] > a["char_start"]
        for c in got:
            assert c["text"] == text[c["char_start"] : c["char_end"]].strip()
            assert c["page_number"] >= text[: c["char_start"]].count("\f") + 1


def test_chunk_boundary_after_abbreviation():
    text = "a" * 590 + " by Acme Inc. of Ohio ends here. " + "b" * 300
    first = split_text(text, 600, 120, sections=False)[0]
    assert first["text"].endswith("ends here.")


def test_chunk_pages_and_sections():
    text = "INTRODUCTION\nSome text. Page 23 Case 1:20 follows.\n1. Duties of the seller\n" + "c. " * 300
    got = split_text(text, 600, 120)
    assert got[0]["section_header"] == "INTRODUCTION"
    assert got[1]["section_header"] == "Duties of the seller"
    assert got[1]["page_number"] == 23
    with pytest.raises(ValueError):
        chunk_udf(600, 400)


def test_fuzzy():
    assert fuzzy_total("statement", ["statement"]) == pytest.approx(0.3)
    assert fuzzy_total("st4tement", ["statement"]) == pytest.approx(8 / 9 * 0.3)
    assert fuzzy_total("zzzzzzzzz", ["statement"]) == 0.0


@pytest.mark.parametrize("size", [1, 7, 63, 64, 65, 70, 128, 200])
def test_window_similarity_against_dynamic_program(size):
    import numpy as np

    from lexloom.functions.fuzzy import _window_similarity

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(size)
    keyword = "".join(rng.choice("abcdeé") for _ in range(size))
    changed = "".join(c if rng.random() < 0.8 else rng.choice("xyz") for c in keyword)
    text = "".join(rng.choice("abcx") for _ in range(size + 5)) + keyword + changed + keyword
    got = _window_similarity(np.fromiter(map(ord, text), np.int64), keyword)
    step = max(1, size // 2)
    wanted = [100.0 * common(keyword, text[i : i + size]) / size for i in range(0, len(text) - size + 1, step)]
    assert got.tolist() == pytest.approx(wanted)
    assert fuzzy_total(f"{keyword} and more", [keyword]) == pytest.approx(0.3)


def test_page_numbers_against_the_text_before():
    import re

    from lexloom.functions import fixed_values as fv
    from lexloom.functions.chunker import _Page

    rng = random.Random(11)
    parts = ["Page", "page ", " ", "\n", " " * 90, "12", "3", "45678", "of", " of 9", "Case", "Cases ", "- ", "x", "\f", "Page 7 Case", "PAGE 1234 of 20", "Page 5a"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        page = _Page(text)
        for at in range(len(text) + 1):
            before, printed = text[:at], None
            for pattern in (fv.COURT_PAGE_MARKER, fv.PAGE_MARKER):
                for m in re.finditer(pattern, before, re.IGNORECASE):
                    printed = int(m.group(1))
                if printed is not None:
                    break
            assert page.at(at) == max(before.count("\f") + 1, printed or 1), (text, at)


def test_classifier(spark):
    rows = [
        (1, "This agreement is made whereas the parties hereby agree. Governing law: Ohio."),
        (2, "qwerty asdf"),
        (3, ""),
        (4, "Affidavit of Jo. Subscribed and sworn before a notary public under penalty of perjury."),
    ]
    got = classify.classify(spark.createDataFrame(rows, "id int, text string")).orderBy("id").collect()
    assert [r["document_type"] for r in got] == ["contract", "unknown", "unknown", "affidavit"]
    assert got[1]["classifier_confidence"] == 0.2


def _conflicts(spark, texts, terms=None):
    df = spark.createDataFrame(
        [("d", i, x) for i, x in enumerate(texts)], "document_id string, chunk_index int, text string"
    )
    seeds = None
    if terms:
        seeds = spark.createDataFrame(
            [("d", t, m) for t, m in terms.items()], "document_id string, term string, definition string"
        )
    return conflicts.find_conflicts(df, terms=seeds).orderBy("position").collect()


def test_conflicts(spark):
    got = _conflicts(
        spark, ["governed by the laws of the State of Ohio.", "none", "governed by the laws of the State of Texas."]
    )
    assert [(c["conflict_type"], c["severity"], c["chunk_indices"]) for c in got] == [
        ("governing_law", "high", [0, 2])
    ]
    same = '"Fee" means ten dollars.'
    assert _conflicts(spark, [same, same]) == []
    got = _conflicts(spark, ['"Fee" means ten dollars a day.'], {"Fee": "twelve dollars a day"})
    assert [(c["conflict_type"], c["severity"], c["chunk_indices"]) for c in got] == [
        ("defined_term", "medium", [0])
    ]
    labels = ["effective date: 2020-01-01", "execution date: 2020-01-02", "agreement date: 2020-01-03"]
    assert _conflicts(spark, labels) == []


def test_metrics(spark):
    ranked = spark.createDataFrame(
        [(c, f"{c}{r}", r) for c in "abc" for r in (1, 2, 3)], "case_id string, chunk_id string, rank int"
    )
    relevant = spark.createDataFrame(
        [("a", "a1"), ("b", "b3"), ("c", "zz")], "case_id string, chunk_id string"
    )
    hits = evaluate.first_hits(ranked, relevant, [1, 3])
    got = evaluate.retrieval_metrics(hits, [1, 3]).first()
    assert (got["recall_1"], got["recall_3"], got["precision_1"], got["mrr"]) == (
        0.3333, 0.6667, 0.3333, 0.4444,
    )


@pytest.mark.parametrize("block_bytes", [16 << 20, 6000])
def test_occurrences_against_brute_force(spark, block_bytes):
    rng = random.Random(3)
    vocab = ["ab", "abc", "b", "cab", "dog", "do", "xy", "\u00fc\U0001f600"]

    def text(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    outer = [(f"o{i}", text(rng.randint(1, 30))) for i in range(60)] + [("long", text(20_000)), ("none", None), ("empty", "")]
    inner = [(f"i{i}", text(rng.randint(1, 6))[rng.randint(0, 1) :].strip()) for i in range(60)]
    inner += [("word", "b"), ("same", "b"), ("part", outer[60][1][50_001:50_200]), ("none", None), ("empty", "")]
    inner += [(f"w{i}", x[3:]) for i, (_, x) in enumerate(outer[:20])]  # some longer than the automaton's keys
    a = spark.createDataFrame(outer, "id string, norm string").repartition(3)
    b = spark.createDataFrame(inner, "id string, norm string").repartition(2)
    wanted = {(o, i) for o, x in outer for i, y in inner if x and y and y in x}
    for found in (occurrences(a, b, block_bytes, 3), enclosing(a, b, block_bytes)):
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(wanted) and set(rows) == wanted
    assert occurrences(a, b.where("false")).count() == 0 == enclosing(a.where("false"), b).count()


def test_gold_span_without_path(spark):
    chunks = spark.createDataFrame(
        [("c1", "p/a.txt", 0, "x", 0, 600), ("c2", "p/a.txt", 1, "y", 480, 1080)],
        "chunk_id string, corpus_path string, chunk_index int, text string, char_start int, char_end int",
    )
    gold = spark.createDataFrame(
        [("q", 0, None, 1080, 1100, "z"), ("r", 0, "a.txt", 600, 600, "")],
        "case_id string, snippet_no int, corpus_path string, start int, end int, text string",
    )
    got = {(r["case_id"], r["chunk_id"]) for r in evaluate.match_gold(chunks, gold).collect()}
    assert got == {("q", "c2"), ("r", "c1"), ("r", "c2")}


def _sequential_diverse(rows, k=10):
    ranked = sorted(rows, key=lambda r: (-r[3], r[2], r[1]))
    if len(rows) <= k:
        return [r[1] for r in ranked]
    picked, used = [], {}
    for r in ranked:
        if used.get(r[2] // 20, 0) < 2 and len(picked) < k:
            picked.append(r[1])
            used[r[2] // 20] = used.get(r[2] // 20, 0) + 1
    picked += [r[1] for r in ranked if r[1] not in picked][: k - len(picked)]
    return picked


def test_diverse_selection_against_sequential_rule(spark):
    rng = random.Random(5)
    rows = []
    for d in range(12):
        for i in rng.sample(range(120), rng.randint(1, 40)):
            rows.append((f"d{d}", f"d{d}c{i}", i, rng.randint(0, 20) / 20))
    df = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, score double")
    got = {}
    for r in retrieve.select_diverse(df).orderBy("document_id", "position").collect():
        got.setdefault(r["document_id"], []).append(r["chunk_id"])
    for d in got:
        assert got[d] == _sequential_diverse([r for r in rows if r[0] == d])


def test_corpus_paths_agree(spark):
    from lexloom.operators.chunks import add_embedding

    chunks = add_embedding(
        spark.createDataFrame(
            [(f"c{i}", f"alpha beta {i % 5} gamma {i % 3}") for i in range(40)], "chunk_id string, text string"
        )
    )
    queries = retrieve.encode_queries(
        spark.createDataFrame([("q1", "alpha 3"), ("q2", "gamma 1 beta")], "query_id string, query string")
    )
    a = retrieve.corpus_top_k(chunks, queries, 5).collect()
    b = retrieve.corpus_top_k(chunks, queries, 5, block_queries=1).collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in b}


@pytest.mark.parametrize("k, lists", [(3, 12), (7, 4), (500, 3)])
def test_lists_give_the_exact_top_k(spark, tmp_path, k, lists):
    """Clustered vectors, ties, zero vectors; most lists are skipped where few neighbours are asked for."""
    rng = random.Random(k)
    rows = []
    for i in range(400):
        base = i % 8
        vec = {base * 40 + d: rng.randint(20, 30) for d in range(6)} | {300 + rng.randint(0, 30): rng.randint(-2, 2)}
        vec = {d: w for d, w in vec.items() if w} if i % 50 else {}
        rows.append((f"c{i:03d}", [(d, w) for d, w in sorted(vec.items())], sum(w * w for w in vec.values())))
    rows += [(f"t{i}", rows[7][1], rows[7][2]) for i in range(9)]
    kind = "array<struct<dim:int,w:int>>"
    chunks = spark.createDataFrame(rows, f"chunk_id string, vec {kind}, norm2 long").repartition(4)
    asked = [(f"q{i}", rows[i][1], rows[i][2]) for i in (3, 7, 60, 0)]
    queries = spark.createDataFrame(asked, f"query_id string, qvec {kind}, qnorm2 long")
    retrieve.write_lists(chunks, str(tmp_path / "lists"), lists)
    best, skipped = retrieve.list_top_k(spark, str(tmp_path / "lists"), queries, k, block_queries=2, rows_a_task=60)
    flat = retrieve.corpus_top_k(chunks, queries, k, block_queries=3, rows_a_task=100)
    wanted = set()
    for q, qv, qn in asked:
        scored = []
        for c, cv, cn in rows:
            dot = sum(w * dict(cv).get(d, 0) for d, w in qv)
            scored.append((-(dot / (qn * cn) ** 0.5 if qn and cn else 0.0), c))
        wanted |= {(q, c, r + 1) for r, (_, c) in enumerate(sorted(scored)[:k])}
    for found in (best, flat):
        assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in found.collect()} == wanted
    counts = {r["query_id"]: (r["skipped"], r["lists"]) for r in skipped.collect()}
    assert set(counts) == {"q3", "q7", "q60", "q0"} and counts["q0"][0] == 0
    if (k, lists) == (3, 12):
        assert counts["q7"][0] > 0


def test_effectiveness(spark):
    prefs = spark.createDataFrame([("p", 0.5), ("q", 0.95)], "preference_id string, effectiveness_score double")
    reviews = spark.createDataFrame(
        [(["p", "q"], 0, 1, "2024-01-01 10:00:00", 1), (["p", "q"], 1, 1, "2024-01-01 11:00:00", 2)],
        "preferences_applied array<string>, edited_sections int, total_sections int, reviewed_at string, draft_id int",
    ).withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp"))
    got = {r[0]: r[1] for r in preferences.update_effectiveness(prefs, reviews).select(
        "preference_id", "effectiveness_score").collect()}
    assert got["p"] == pytest.approx(0.55)
    assert got["q"] == pytest.approx(0.95)  # clamped at 1.0 before the second review


def test_preference_ranking_and_merge(spark):
    rows = [
        (None, "contract", f"p{i}", f"rule {i}", None, [1.0 if j == i else 0.0 for j in range(9)], 0.4, i, 0.5, i)
        for i in range(8)
    ]
    schema = (
        "tenant_id string, document_type string, preference_id string, preference_text string, "
        "source_edit_id string, vector array<double>, confidence double, application_count long, "
        "effectiveness_score double, created_at int"
    )
    stored = spark.createDataFrame(rows, schema)
    best = preferences.best_preferences(stored, 3).orderBy("rank").collect()
    assert [r["application_count"] for r in best] == [7, 6, 5]
    near = [1.0, 0.1] + [0.0] * 7
    fresh = spark.createDataFrame(
        [
            (None, "contract", "n1", "better rule", "e1", near, 0.9, 0, 0.5, 100),
            (None, "contract", "n2", "other rule", "e2", [0.0] * 8 + [1.0], None, 0, 0.5, 101),
            (None, "contract", "n3", "other rule again", "e3", [0.0] * 8 + [1.0], 0.2, 0, 0.5, 102),
        ],
        schema,
    )
    got = {r["preference_id"]: r for r in preferences.merge_rules(stored, fresh).collect()}
    assert len(got) == 9
    assert got["p0"]["preference_text"] == "better rule" and got["p0"]["confidence"] == 0.9
    assert got["n2"]["confidence"] == 0.8 and got["n2"]["preference_text"] == "other rule"


def test_cross_checks(spark):
    df = spark.createDataFrame(
        [(100.0, 20.0, 120.0), (100.0, 20.0, 200.0), (None, 20.0, 120.0), (1.0, 1.0, 0.0)],
        "s double, t double, x double",
    )
    got = df.select(validate.check_total(F.col("s"), F.col("t"), F.col("x")).alias("r")).collect()
    assert [r["r"]["valid"] for r in got] == [True, False, True, False]
    assert got[1]["r"]["reason"] == (
        "subtotal(100.0) + tax(20.0) = 120.00 but total = 200.00 (error 40.0%)"
    )
    df = spark.createDataFrame([(1000.0, 1200.0, 1200.0), (1000.0, 1200.0, 900.0)], "o double, c double, a double")
    got = df.select(validate.check_balances(F.col("o"), F.col("c"), F.col("a")).alias("r")).collect()
    assert [r["r"]["valid"] for r in got] == [True, False]


def test_missing_required_field(spark):
    df = spark.createDataFrame(
        [("case_number", "string", True, None, [], 1.0, 1.0), ("jury_demand", "boolean", False, "false", [], 1.0, 1.0)],
        "name string, kind string, required boolean, value string, values array<string>, ocr_conf double, clf_conf double",
    )
    got = {r["name"]: r for r in score_fields(df).collect()}
    assert got["case_number"]["confidence"] <= 0.30 and got["case_number"]["requires_review"]
    assert got["jury_demand"]["confidence"] == 0.885  # false is a value


def test_histogram_has_all_buckets(spark):
    docs = spark.createDataFrame(
        [("a", None, None, 0.85)], "document_id string, tenant_id string, deleted_at timestamp, document_confidence double"
    )
    got = {r[0]: r[1] for r in analytics.confidence_histogram(docs).collect()}
    assert got == {"0-20%": 0, "20-40%": 0, "40-60%": 0, "60-80%": 0, "80-100%": 1}


def test_improvement(spark):
    rows = [("before", i < 4) for i in range(5)] + [("after", i < 1) for i in range(5)]
    got = evaluate.improvement_metrics(spark.createDataFrame(rows, "phase string, edited boolean")).first()
    assert (got["before_edit_rate"], got["after_edit_rate"], got["relative_drop"], got["target_met"]) == (
        0.8, 0.2, 0.75, True,
    )


@pytest.mark.parametrize("threshold, block, rows_a_task", [(0.85, 1000, 50_000), (0.6, 5, 20), (0.3, 3, 7)])
def test_similar_rules_against_brute_force(spark, threshold, block, rows_a_task):
    import numpy as np

    from lexloom.operators.components import components

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6))
    rows = []
    for i in range(160):
        vector = centres[i % 12] + rng.normal(size=6) * 0.4 if i % 3 else rng.normal(size=6)
        rows.append((f"n{i:03d}", "gh"[i % 7 == 0], bool(i % 4 == 0), [float(x) for x in vector]))
    rows += [("zero", "g", True, [0.0] * 6), ("none", "g", True, None)]
    table = spark.createDataFrame(rows, "node string, grp string, learned boolean, vector array<double>").repartition(3)
    edges = preferences.similar_rules(table, threshold, block, rows_a_task, pivots=4)
    found = {}
    for r in components(edges).collect():
        found.setdefault(r["component"], set()).add(r["node"])
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, g, la, x in rows[:160]:
        for b, h, lb, y in rows[:160]:
            if a < b and g == h and (la or lb) and np.dot(x, y) >= threshold * np.linalg.norm(x) * np.linalg.norm(y):
                parent[root(a)] = root(b)
    wanted = {}
    for i in parent:
        wanted.setdefault(root(i), set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(sorted(c) for c in wanted.values() if len(c) > 1)
    assert any(len(c) > 1 for c in wanted.values())


def test_merging_rules_of_one_vector(spark):
    """Copies of one stored rule stay apart unless a learned rule is like them."""
    schema = (
        "tenant_id string, document_type string, preference_id string, preference_text string, source_edit_id string, "
        "vector array<double>, confidence double, application_count long, effectiveness_score double, created_at int"
    )

    def rule(i, vector, confidence):
        return (None, "contract", i, f"text {i}", None, vector, confidence, 0, 0.5, 0)

    stored = spark.createDataFrame([rule(f"s{i}", [1.0, 0.0], 0.3) for i in range(50)] + [rule("t", [0.0, 1.0], 0.3), rule("u", [0.0, 1.0], 0.3)], schema)
    learned = spark.createDataFrame([rule(f"l{i}", [1.0, 0.1], 0.5) for i in range(50)] + [rule("z", [0.0, 0.0], 0.9), rule("y", None, 0.9)], schema)
    got = {r["preference_id"]: r["preference_text"] for r in preferences.merge_rules(stored, learned).collect()}
    assert sorted(got) == sorted([*(f"s{i}" for i in range(50)), "t", "u", "z", "y"])
    assert got["s0"] == "text l0" and got["s1"] == "text s1" and got["t"] == "text t"


def test_prompts_carry_template_metadata_and_instructions(spark):
    from lexloom.operators import drafts

    schema = (
        "document_id string, document_type string, fields_json string, terms_block string, conflicts_block string, source_block string, "
        "preferences array<string>, examples array<struct<original:string,edited:string>>"
    )
    rows = [
        ("a", "legal_complaint", "{}", "", None, "source", [], []),
        ("b", None, "{}", "TERMS", "CONFLICTS", None, ["be brief"], [("old", "new")]),
        ("c", "invoice", "{}", "", "", "", [], []),
    ]
    docs = spark.createDataFrame(rows, schema)
    memo = {r["document_id"]: r for r in drafts.prompts(docs, "internal_memo", "May 2, 2024").collect()}
    for r in memo.values():
        for part in ("Do not invent filing, review, or memo dates", "Landmark Credit Union", "TO: Senior Partner", "FROM: Legal Document Analyst"):
            assert part in r["system_prompt"]
        assert "May 2, 2024" in r["system_prompt"] and '"date": "May 2, 2024"' in r["user_prompt"]
        assert "- IV. Claims Asserted (required): Enumerate each count" in r["user_prompt"]
    assert "enumerate each cause of action" in memo["a"]["user_prompt"] and "statute or legal basis" in memo["a"]["user_prompt"]
    assert "enumerate each cause of action" not in memo["b"]["user_prompt"]
    assert "Applicable to unknown." in memo["b"]["user_prompt"] and "Not listed for invoice" in memo["c"]["user_prompt"]
    assert "- be brief" in memo["b"]["system_prompt"] and "[EDITED]\nnew" in memo["b"]["system_prompt"]
    assert "TERMS\n\nCONFLICTS" in memo["b"]["user_prompt"] and "\n\n\n" not in memo["a"]["user_prompt"]
    plain = drafts.prompts(docs, "settlement_offer", "May 2, 2024").first()
    assert "DRAFT TEMPLATE: none" in plain["user_prompt"] and "Senior Partner" not in plain["system_prompt"]


def test_line_rules_name_fix_and_frameworks(spark):
    from lexloom.operators import rules

    lines = [
        'api_key = "AIzaSyAAAAAAAAAAAAAAAAAAAAAAAAAAAA"',
        'raw_sql = f"SELECT * FROM users WHERE id = {user_id}"',
        'jwt_options = {"alg": "none"}',
        'logger.info("token %s", token)',
        'response = requests.get("https://example.test", verify=False)',
        'password = os.getenv("secret_token_0123456789")',
    ]
    df = spark.createDataFrame([("f", "\n".join(lines))], "file string, text string")
    found = sorted(rules.scan_lines(df, "file").collect(), key=lambda r: r["line_no"])
    assert [(r["line_no"], r["severity"], r["urgency"]) for r in found] == [
        (1, "CRITICAL", "before-merge"), (2, "CRITICAL", "before-merge"), (3, "CRITICAL", "before-merge"),
        (4, "WARN", "within-sprint"), (5, "WARN", "within-sprint"),
    ]
    assert "hardcoded secret" in found[0]["issue"] and "SQL injection" in found[1]["issue"]
    assert all(r["frameworks"] and r["suggested_fix"] for r in found)
