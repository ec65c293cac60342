"""Steps that must not grow faster than their input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexloom import session
from lexloom.functions import fixed_values as fv
from lexloom.functions import chunker, fuzzy
from lexloom.functions import text as tx
from lexloom.operators import confidence, conflicts, jurisdiction, retrieve, review, terms, validate
from lexloom.plans import q_review, q_stream
from lexloom.plans.registry import Inputs


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_grow_with_the_files(spark, tmp_path, monkeypatch):
    spark.range(50_000).coalesce(1).write.parquet(str(tmp_path / "a %41 t"))
    rows = spark.read.parquet(str(tmp_path / "a %41 t"))
    monkeypatch.setattr(session, "_DEALT_BYTES", 4096)
    dealt = session.spread(rows)
    assert dealt.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert dealt.count() == 50_000


def test_given_columns_are_dealt_before_texts_are_built(spark):
    plan = _plan(Inputs(spark, "/root/testdata/sf0.001").spread("contract_lines"))
    assert plan.index("governed by the laws") < plan.index("Repartition")


def test_format_rules_are_no_map(spark):
    rows = spark.createDataFrame(
        [("due_date", "1-2-2024"), ("tax", "3"), ("tax", "x"), ("claims", "y"), ("other", "z"), (None, "z"), ("tax", None)],
        "name string, value string",
    ).withColumns({"kind": F.lit("string"), "values": F.array().cast("array<string>")})
    score = confidence.format_score(F.col("name"), F.col("value"), F.col("values"), F.col("kind"))
    scored = rows.select(score.alias("s"))
    assert [r.s for r in scored.collect()] == [1.0, 1.0, 0.2, 0.0, 0.7, 0.7, 0.0]
    assert "map(" not in _plan(scored) and "keys:" not in _plan(scored)


def test_near_matches_of_many_texts_at_once(monkeypatch):
    rng = random.Random(5)
    keywords = ["statement", "civil action", "x" * 70, "q", "é" * 5]
    texts = ["", "a", "x" * 69]
    for _ in range(60):
        text = " ".join(rng.choice([*keywords, "und", "\U0001f600"]) for _ in range(rng.randint(0, 12)))
        texts.append("".join(c if rng.random() < 0.95 else rng.choice("abxé ") for c in text))

    def plain(text):
        total = 0.0
        for keyword in keywords:
            near = fuzzy._window_similarity(fuzzy._codes(text), keyword)
            near = near[near >= fv.FUZZY_THRESHOLD]
            total += float(near[0]) / 100.0 * 0.3 if near.size else 0.0
        return total

    monkeypatch.setattr(fuzzy, "_SLICE", 300)
    assert fuzzy.fuzzy_totals(texts, keywords).tolist() == [plain(t) for t in texts]


def test_repair_runs_a_rule_only_where_its_literal_stands(spark):
    rng = random.Random(7)
    bits = [
        "l  N V 0 l C E", "\u0131 N V O I C E", "STAT EMENT", "\u017ftat ement", "Acc oun\u212a", "ACC OUNT", "lnvoice", "lnv", "T0TAL",
        "Bi1l", "\u0130nv0ice", "deb1t\u017f", "N0. 5", "BAL: $3", "bal", "AB0C", "Landmark", "l", "AB1CD", "inv-1O23", "{name:str}", "{", "\u00e9", "und",
        "Sa1ary", "\u017fa1ary", "Stat Date", "per10d", "Peri0d", "P3rio0d", "0pening", "C1osing", "fr0m",
    ]
    texts = [("".join(rng.choice([*bits, " ", " ", "\n"]) for _ in range(rng.randint(0, 12))),) for _ in range(400)]
    rows = spark.createDataFrame([*texts, *[(b,) for b in bits], (None,)], "t string")
    for mode, prefix in (("faithful", "(?iU)"), ("case_sensitive", "(?U)")):
        plain = F.col("t")
        for pattern, replacement in fv.REPAIR_RULES:
            plain = F.regexp_replace(plain, prefix + pattern, replacement)
        plain = F.regexp_replace(plain, fv.PLACEHOLDER, "")
        shown = rows.select(tx.repair_scanned_text("t", mode).alias("a"), plain.alias("b"))
        assert shown.where("NOT a <=> b").collect() == []
        assert "contains" in _plan(shown.select("a")).lower()


def test_conflicts_of_one_kind_search_for_that_kind(spark):
    chunks = Inputs(spark, "/root/testdata/sf0.001").contract_lines.where("CAST(document_id AS INT) < 40")
    seeds = chunks.selectExpr("document_id", "'Service Level' AS term", "'grade X of old' AS definition").distinct()
    everything = conflicts.find_conflicts(chunks, terms=seeds).collect()
    for kind in ("governing_law", "defined_term", "date", "amount"):
        one = conflicts.find_conflicts(chunks, terms=seeds, kinds=[kind])
        assert ("salary" in _plan(one)) == (kind == "amount")
        assert sorted(map(str, one.collect())) == sorted(str(r) for r in everything if r.conflict_type == kind) != []


def test_fields_are_scored_once_for_review(spark):
    plan = _plan(q_review.documents_after_review(Inputs(spark, "/root/testdata/sf0.001")))
    assert "lineitem" not in plan and "l_orderkey" not in plan


def test_scanned_corpus_makes_a_folder_per_source_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_stream, "shared_folder", lambda _, purpose: str(tmp_path / purpose))
    rows = [(1, "a", "x\ny"), (2, "a", ""), (3, "b", "doc_id=9\n\n"), (4, "b", None), (5, None, "\u00e9\U0001f600")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = q_stream.scanned_corpus(Inputs(spark, str(tmp_path))).collect()
    none = "source=__HIVE_DEFAULT_PARTITION__"
    assert sorted((r.folder, r.characters) for r in got) == sorted(
        [("source=a/doc_id=1", 3), ("source=a/doc_id=2", 0), ("source=b/doc_id=3", 10), ("source=b/doc_id=4", 0), (none + "/doc_id=5", 2)]
    )
    assert len([p for p in (tmp_path / "corpus").rglob("*") if p.is_dir()]) == 3
    assert len(list((tmp_path / "corpus").rglob("*.txt"))) == 5


def _texts(spark, bits, seed, n=1500):
    rng = random.Random(seed)
    return spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))),) for _ in range(n)] + [(None,)], "t string")


def test_checks_look_a_field_up_once(spark):
    rows = spark.createDataFrame([({"due_date": "1/2/2020"}, "invoice")], "fields map<string,string>, kind string")
    plan = _plan(rows.select(validate.validation_results("fields", "kind").alias("r")))
    assert plan.count("[due_date]") == 1 and plan.count("[invoice_number]") == 1 and plan.count("[account_number]") == 1


def test_amounts_are_found_with_one_search(spark):
    rows = _texts(spark, ["$", "€", " ", "1", "2,5", ".", ".75", ",", "a", " ", "\n"], 5)
    digits = tx.first_match(tx.strip("t"), fv.CURRENCY, 1)
    plain = F.replace(digits, F.lit(","), F.lit("")).try_cast("double")
    shown = rows.select(plain.alias("a"), tx.currency_amount("t").alias("b"))
    assert shown.where("NOT a <=> b").collect() == [] and shown.where("a IS NOT NULL").count() > 200
    assert "RLIKE" not in _plan(shown.select("b"))


def test_inline_definitions_are_searched_once_per_run(spark):
    bits = [
        "Firm 7", "A", "1234", "-9 ", " and ", "Shopſ Co., Ltd. ", "(the ", "(", '"', ")", '"Seller"', '("Buyer") ', ' (the  "Seller" ) ', "\n", "é", ":", "x" * 190,
        " ", '(" ', 'abcd (" ) xx") ',
    ]
    text, rows, full = F.col("t"), _texts(spark, bits, 4, 4000), terms._FLAGS + fv.INLINE_DEFINITION
    plain = F.zip_with(
        F.regexp_extract_all(text, F.lit(full), F.lit(1)), F.regexp_extract_all(text, F.lit(full), F.lit(2)),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    found = F.regexp_extract_all(text, F.lit(terms._FLAGS + terms._INLINE_SEARCH), F.lit(0))
    new = F.transform(found, lambda m: F.struct(F.regexp_extract(m, full, 1).alias("a"), F.regexp_extract(m, full, 2).alias("b")))
    assert rows.where(~plain.eqNullSafe(new)).collect() == [] and rows.where(F.size(plain) > 0).count() > 200
    assert "{4,}+" in _plan(rows.select(terms.term_candidates(text)))


def test_mentions_are_searched_where_a_pattern_can_begin(spark):
    bits = [
        "governed by ", "Conſtrued under ", "subject to the laws of ", "the State of ", "Ohio", "Texas, ", "Effective Date", "EXECUTıON date",
        "commencement date: ", "agreement date", "dated as of ", "ſigned on ", "İ", "May 3, 2020", "1/2/2020", "2020-01-02", "monthly fee", "Annual paymentſ",
        "yearly fees ", "QUARTERLY fee", "total payment", "baſe salary", "lİcense fee", "lıcense fee ", "ſervice  fee", "purchaſe price", "contract value", "$12", " 5,000.25 ",
        '"Term" means ', '"Law" is defined as ', "an old\nthing\n", "abcd\n", ";", ".", " ", "\n", "x",
    ]
    text = F.col("t")
    rows = _texts(spark, bits, 3, 4000)
    for begins, pattern in (
        (conflicts._LAW_BEGINS, fv.GOVERNING_LAW), (conflicts._DATE_BEGINS, fv.LABELLED_DATE), (conflicts._AMOUNT_BEGINS, fv.LABELLED_AMOUNT),
    ):
        a, b = (F.regexp_extract_all(text, F.lit("(?iUd)" + p), F.lit(0)) for p in (pattern, begins + pattern))
        assert rows.where(~a.eqNullSafe(b)).collect() == []
        assert rows.where(F.size(a) > 0).count() > 50
    full = "(?isUd)" + fv.QUOTED_MEANING
    plain = F.zip_with(
        F.regexp_extract_all(text, F.lit(full), F.lit(1)), F.regexp_extract_all(text, F.lit(full), F.lit(2)),
        lambda t, d: F.struct(t.alias("a"), conflicts.clean_meaning(d).alias("b")),
    )
    once = conflicts._parts(text, full, lambda t, d: F.struct(t.alias("a"), conflicts.clean_meaning(d).alias("b")))
    assert rows.where(~plain.eqNullSafe(once)).collect() == [] and rows.where(F.size(plain) > 0).count() > 50
    plan = _plan(rows.select(conflicts.mentions(text, ["defined_term"]).alias("m")))
    assert plan.count("regexp_extract_all(") == 1


def test_a_chunk_is_sent_once_for_many_blocks(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)

    def vectors(n, name):
        rows = []
        for i in range(n):
            w = {rng.randrange(768): rng.randint(-3, 3) or 1 for _ in range(rng.randint(0, 6))}
            rows.append((f"{name}{i}", sorted(w.items()) if i % 7 else None, float(sum(x * x for x in w.values())) if i % 7 else 0.0))
        return spark.createDataFrame(rows, "id string, vec array<struct<dim:int,w:int>>, norm2 double"), rows

    (chunks, c), (queries, q) = vectors(40, "c"), vectors(9, "q")
    chunks = chunks.select(F.col("id").alias("chunk_id"), "vec", "norm2")
    queries = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"), F.col("norm2").alias("qnorm2"))
    want = []
    for query, a, n in q:
        dots = [(-(sum(w * dict(a or []).get(d, 0) for d, w in b or []) / np.sqrt(n * m) if n * m else 0.0), chunk) for chunk, b, m in c]
        want += [(query, chunk, -score, i + 1) for i, (score, chunk) in enumerate(sorted(dots)[:5])]
    got = retrieve.corpus_top_k(chunks, queries, 5, block_queries=2, rows_a_task=15).collect()
    assert sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in got) == sorted(want)

    def counted(*_):
        def run(batches):
            for batch in batches:
                ids = batch.filter(batch.column("is_chunk")).column("id")
                yield pa.RecordBatch.from_arrays([ids, ids, pa.array([0.0] * len(ids))], names=["query_id", "chunk_id", "score"])

        return run

    monkeypatch.setattr(retrieve, "_best_of_keys", counted)
    one = F.lit(0).alias("list")
    sent = retrieve._met(retrieve._slim(chunks).select(one, "*"), retrieve._asked(queries).select(one, "*"), 5, 2, 15)
    assert sent.count() == 40


def test_review_tasks_need_no_join_and_score_once(spark):
    plan = _plan(q_review.review_tasks(Inputs(spark, "/root/testdata/sf0.001")))
    assert "Join" not in plan and plan.count("Relation") == 1
    # The filter stays behind the scores; in front of them it holds the format rules once more.
    assert plan.count("case_number") == 1


def test_reason_of_one_field_is_that_of_its_check(spark):
    values = [None, "", " ", "x", "12", "-3", "$1,000.50", "9999999999", "2020-02-30", "2020-2-3", "3/4/2021", "INV-1", "DE12 3456", "1-2-2020 to 3-4-2021"]
    names = ["invoice_number", "invoice_date", "due_date", "subtotal", "tax", "total_amount", "account_number", "statement_period", "opening_balance", "closing_balance", "available_balance", "other"]
    rng = random.Random(3)
    docs = [(str(i), k, {n: rng.choice(values) for n in names if rng.random() < 0.9}) for i in range(150) for k in ("invoice", "bank_statement", "memo")]
    docs = spark.createDataFrame([(f"{i}{k}", k, f) for i, k, f in docs], "document_id string, document_type string, fields map<string,string>")
    asked = docs.select("*", F.explode(F.array(*[F.lit(n) for n in [*names, "_cross_total", "_cross_balance"]])).alias("name"))
    own = asked.select("document_id", "name", validate.failed_reason("name", "fields", "document_type").alias("validation_reason"))
    joined = review.with_validation_reason(asked.select("document_id", "name"), validate.validate_documents(docs))
    got, want = (sorted(map(str, d.select("document_id", "name", "validation_reason").collect())) for d in (own, joined))
    assert got == want and sum("None" not in x for x in got) > 500


def test_state_citations_are_looked_for_once_per_word(spark):
    bits = ["Wis", "wis", "Wi\u017f", "O\u212aLA", "N", "ny", "NY", "Cal", "la", "x", ".", ". ", " ", "\u00a0", "\n", "Stat.", "\u017ftat.", "Code", "C\u0130v.", "Civ.", "Civ", "CPLR", "Rev.", "Adm\u0131n.", "Admin.", "9"]
    rows = _texts(spark, bits, 11, 4000)
    prefixes = "|".join(sorted(fv.STATE_CITATION_PREFIXES, key=len, reverse=True))
    plain = rf"(?iU)\b({prefixes}){fv.STATE_CODE_TAIL}"
    both = rows.select(F.regexp_extract_all("t", F.lit(plain)).alias("a"), F.regexp_extract_all("t", F.lit("(?iU)" + jurisdiction._code_pattern())).alias("b"))
    assert both.where("NOT a <=> b").collect() == [] and both.where("size(a) > 0").count() > 200
    low = rows.select("t", F.lower("t").alias("low"), F.col("t").rlike(plain).alias("a"))
    assert low.where(F.col("a") & ~tx.holds_any(F.col("low"), "tat.", "code", "v.", "cplr", "adm")).collect() == []
    # the tags of a text are made once, not once for each place that looks at them
    assert _plan(rows.select(jurisdiction.primary_tag(jurisdiction.jurisdiction_tags("t")).alias("tag"))).count("cplr") == 1


def test_plain_parts_of_definition_verbs(spark):
    bits = ['"Fee"', '"Te\u212a"', " means ", " SHALL MEAN ", " refer\u017f to ", " \u0130s def\u0131ned as ", " is defined as ", " shall have the meaning set forth in ", " has the meaning given in ", " has the mean\u0131ng g\u0130ven in ", "part", ". A", "; "]
    rows = _texts(spark, bits, 12, 3000)
    for (lead, verb), parts in zip(fv.DEFINITION_VERBS, terms._VERB_PARTS):
        fits = F.col("t").rlike(rf"(?isUd){lead}{fv.TERM_IN_QUOTES}\s+{verb}\s+")
        assert rows.where(fits).count() > 100
        assert rows.where(fits & ~tx.holds_any(F.lower("t"), *parts)).collect() == []


def test_short_texts_are_cut_without_sentence_ends(monkeypatch):
    rng = random.Random(13)
    texts = ["".join(rng.choice(["a b. ", "\f", "Page 3 ", "Page 12 Case ", "1. Terms and so on\n", "WHEREAS\n", "\n", " ", "Dr. No"]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text in texts:
        page = chunker._Page(text)
        found = chunker.split_text(text, 100, 20)
        assert [c["page_number"] for c in found] == [page.at(c["char_start"]) for c in found]
    monkeypatch.setattr(chunker, "_Cutter", None)
    monkeypatch.setattr(chunker, "_Page", None)
    assert [c["text"] for c in chunker.split_text('"Service" means repair. It ends.', 600, 120)] == ['"Service" means repair. It ends.']
