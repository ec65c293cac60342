import hashlib
import random

from pyspark.sql import functions as F

from lexloom.operators import review
from lexloom.plans import q_review
from lexloom.plans.registry import Inputs


def _id(i):
    digits = hashlib.sha256(str(i // 3).encode()).hexdigest()
    return [digits, digits.upper(), f"task {i}"][i % 3]


def _case(spark, seed):
    """Tasks without a field, decisions without a task, two tasks of one field, ids that differ in case only."""
    rng = random.Random(seed)
    docs = [str(d) for d in range(60)]
    fields = [(d, n, rng.choice([None, "v"]), rng.choice([None, 0.1234, 0.5, 0.9]), rng.random() < 0.4) for d in docs[:50] for n in "abcd"]
    asked = [(d, n) for d, n, _, _, r in fields if r]
    tasks = [(_id(i), *rng.choice([*asked, ("55", "a"), ("70", "b")]), "v", rng.choice(["pending", "completed"])) for i in range(120)]
    decisions = [(_id(rng.randrange(150)), k, "new", rng.randrange(3), "Kim") for k in range(70)]
    documents = [(d, rng.choice(["review_required", "completed"]), rng.choice([None, 0.3])) for d in docs]
    return (
        spark.createDataFrame(documents, "document_id string, status string, document_confidence double"),
        spark.createDataFrame(fields, "document_id string, name string, value string, confidence double, requires_review boolean"),
        spark.createDataFrame(tasks, "task_id string, document_id string, field_name string, original_value string, status string"),
        spark.createDataFrame(decisions, "task_id string, decision_id int, corrected_value string, created_at int, reviewer_name string"),
    )


def test_decisions_meet_only_fields_that_were_asked_for(spark):
    for seed in range(3):
        documents, fields, tasks, decisions = _case(spark, seed)
        done = {r.task_id for r in decisions.collect()}
        hits, waits = {}, {}
        for r in tasks.collect():
            key = (r.document_id, r.field_name)
            hits[key] = hits.get(key, 0) + (r.task_id in done)
            waits[key] = waits.get(key, 0) + (r.task_id not in done and r.status == "pending")
        assert sum(hits.values()) > 10 and sum(waits.values()) > 10
        rows = fields.collect()
        want = [x for r in rows for x in ([("new", 1.0, False)] * hits.get((r.document_id, r.name), 0) or [(r.value, r.confidence, r.requires_review)]) for x in [(r.document_id, r.name, *x)]]
        means = {}
        for d in {r.document_id for r in rows}:
            known = [c for x, _, _, c, _ in want if x == d and c is not None]
            means[d] = sum(round(c * 10_000) for c in known) / 10_000 / len(known) if known else None
        after = []
        for r in documents.collect():
            touched = any(n for (d, _), n in hits.items() if d == r.document_id)
            left = sum(n for (d, _), n in waits.items() if d == r.document_id)
            mean = means.get(r.document_id)
            status = "completed" if touched and not left and r.status == "review_required" else r.status
            after.append((r.document_id, status, round(mean, 4) if touched and mean is not None else r.document_confidence))
        for asked in (None, F.col("requires_review")):
            got = review.apply_decisions(fields, tasks, decisions, asked=asked).select("document_id", "name", "value", "confidence", "requires_review")
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
            got = review.documents_after_review(documents, fields, tasks, decisions, asked=asked)
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(after, key=repr)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_without_a_task_are_not_joined(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    decided, after = _plan(q_review.decided_fields(t)), _plan(q_review.documents_after_review(t))
    assert "Union" in decided and decided.count("Join LeftOuter") == 1
    assert "Union" in after and after.count("Join FullOuter") == 1 and after.count("Join") == 3
