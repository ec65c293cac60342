import random
import shutil

import corpus_pipeline
from lexloom.session import cut_lineage
from tests.llm.test_dedup_and_sharding import normal
from tests.llm.test_text_operators import brute_components, brute_hits


def test_stages_on_a_small_corpus(spark, tmp_path):
    """Every stage against brute force, each on what the stage before kept."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rng = random.Random(3)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in given if r.n_chars < 20_000]
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(5).collect()
    for k in range(12):
        _, text, lang, *rest = rng.choice(rows[:40])
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + k, [text, text + "\n", " ".join(words), f"{text} {bench[k % 5].text}"][k % 4], lang, *rest))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "123 !?", "en", "s", 6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy("/root/testdata/sf0.001/benchmark.parquet", tmp_path / "benchmark.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = frame.columns, {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = cut_lineage(stage(spark, frame, str(tmp_path)))
        assert frame.columns == columns
        found = {r.doc_id: r.text for r in frame.collect()}
        if name == "language":
            assert {2000, 2001, 2002} == set(kept) - set(found)
        elif name == "exact copies":
            best = {}
            for i, text in sorted(kept.items(), key=lambda x: (-len(x[1]), x[0])):
                best.setdefault(normal(text), i)
            assert set(found) == set(best.values())
        elif name == "near copies":
            assert set(found) == {c for _, _, c in brute_components(sorted(kept.items()), 5, 80, 100)}
        else:
            assert set(found) == {i for i, t in kept.items() if not brute_hits(t, items, 10)[1]}
        kept = found
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(kept)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.drop("sequence_id", "offset").collect())) == sorted(map(tuple, packed.drop("sequence_id", "offset").collect()))


def test_language_stage_keeps_all_texts_with_letters(spark):
    en, de, el = "the cat and the dog of this house ", "der hund und die katze in diesem haus ", "\u03b7 \u03b3\u03ac\u03c4\u03b1 \u03ba\u03b1\u03b9 \u03bf \u03c3\u03ba\u03cd\u03bb\u03bf\u03c2 \u03c4\u03bf\u03c5 \u03c3\u03c0\u03b9\u03c4\u03b9\u03bf\u03cd "
    texts = [(en * 9, "en"), (de * 9, "de"), (el * 9, "el"), (en * 3 + de * 3 + el * 3, None), ("12 ?!", "en"), ("", "de"), (None, "el")]
    stage = corpus_pipeline.STAGES[0][1]
    for known in (True, False):
        rows = [(i, t, lang if known else None, "s", 0) for i, (t, lang) in enumerate(texts)]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        found = stage(spark, frame, "")
        assert found.columns == frame.columns and sorted(r.doc_id for r in found.collect()) == [0, 1, 2, 3]


def test_language_sample_is_of_distinct_texts(spark):
    """A hot copied text counts once, and does not crowd out the other texts of its language."""
    from lexloom.llm.language import trained

    other = [(f"word{chr(97 + i)} some text {i}", "en") for i in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, "text string, lang string")
    hot, once = trained(frame(other + [("hot text", "en")] * 5000), per_lang=100), trained(frame([*other, ("hot text", "en")]), per_lang=100)
    assert (hot.logs == once.logs).all()
