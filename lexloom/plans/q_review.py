"""Queries: validation, confidence, review, drafts, preferences, draft quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import clean_reply, round_even
from lexloom.operators import (
    analytics, confidence, drafts, evaluate, extract, grounding, preferences, review, validate,
)
from lexloom.plans.registry import query
from lexloom.session import cut_lineage

# ---- validation ---------------------------------------------------------------------------------


_TEXTS = ["invoice_number", "due_date", "subtotal_text", "tax_text", "total_text"]


def _fields_of_row():
    """Invoice and statement fields as a text map, from the columns of the invoice table.

    A lookup in this very expression is the column itself, and no map is made for it.
    """
    names = {
        "invoice_number": F.col("invoice_number"),
        "invoice_date": F.col("due_date"),
        "due_date": F.col("due_date"),
        "subtotal": F.col("subtotal_text"),
        "tax": F.col("tax_text"),
        "total_amount": F.col("total_text"),
        "account_number": F.col("invoice_number"),
        "statement_period": F.concat(F.col("due_date"), F.lit(" to "), F.col("due_date")),
        "opening_balance": F.col("subtotal_text"),
        "closing_balance": F.col("total_text"),
        "available_balance": F.col("subtotal_text"),
    }
    return F.create_map(*[x for k, v in names.items() for x in (F.lit(k), v)])


def _field_map(t):
    return t.spread("invoices").select(
        "document_id", "document_type", "subtotal", "tax", "total", _fields_of_row().alias("fields")
    )


_VALID = """
  v AS (SELECT *, due_date <> 'soon' AS dated,
      CASE WHEN total = 0 THEN 1::DOUBLE ELSE abs(subtotal + tax - total) / total END AS err,
      abs(total - subtotal) / abs(total) AS gap FROM invoices),
  r AS (
    SELECT document_id, document_type, 0 AS position, 'invoice_number' AS field, invoice_number IS NOT NULL AS valid,
      CASE WHEN invoice_number IS NULL THEN 'invoice_number is missing' ELSE 'ok' END AS reason,
      upper(invoice_number) AS normalized_value FROM v WHERE document_type = 'invoice'
    UNION ALL SELECT document_id, document_type, p, f, dated, CASE WHEN dated THEN 'ok' ELSE
      'unrecognised date format: ''soon''' END, due_date
      FROM v CROSS JOIN (VALUES (1, 'invoice_date'), (2, 'due_date')) x(p, f) WHERE document_type = 'invoice'
    UNION ALL SELECT document_id, document_type, 3, 'subtotal', true, 'ok', subtotal_text FROM v WHERE document_type = 'invoice'
    UNION ALL SELECT document_id, document_type, 4, 'tax', true, 'ok', tax_text FROM v WHERE document_type = 'invoice'
    UNION ALL SELECT document_id, document_type, 5, 'total_amount', true, 'ok',
      CAST(CAST(regexp_extract(total_text, '[0-9]+(\\.[0-9]{1,2})?') AS DOUBLE) AS VARCHAR) FROM v WHERE document_type = 'invoice'
    UNION ALL SELECT document_id, document_type, 0, 'account_number', false,
      CASE WHEN invoice_number IS NULL THEN 'account_number is missing' ELSE
        concat('account_number ''', invoice_number, ''' does not match expected format') END,
      invoice_number FROM v WHERE document_type = 'bank_statement'
    UNION ALL SELECT document_id, document_type, 1, 'statement_period', dated AND due_date LIKE '20%',
      CASE WHEN dated AND due_date LIKE '20%' THEN 'ok' ELSE concat('statement_period ''', due_date, ' to ',
        due_date, ''': could not identify two dates') END,
      concat(due_date, ' to ', due_date) FROM v WHERE document_type = 'bank_statement')"""


@query(
    "V1 V3", ("invoices",),
    f"""WITH {_VALID} SELECT document_id, field, valid, reason, normalized_value FROM r""",
)
def field_validation(t):
    rows = validate.validate_documents(_field_map(t))
    plain = ~F.col("field").isin(
        "_cross_total", "_cross_balance", "opening_balance", "closing_balance", "available_balance"
    )
    return rows.where(plain).select("document_id", "field", "valid", "reason", "normalized_value")


@query(
    "V2 V3", ("invoices",),
    f"""WITH {_VALID}
        SELECT document_id, '_cross_total' AS field, err <= 0.05::DOUBLE AS valid FROM v
          WHERE document_type = 'invoice'
        UNION ALL SELECT document_id, '_cross_balance', gap <= 0.02::DOUBLE FROM v
          WHERE document_type = 'bank_statement'""",
)
def cross_field_checks(t):
    rows = validate.validate_documents(_field_map(t))
    return rows.where(F.startswith("field", F.lit("_cross"))).select("document_id", "field", "valid")


@query(
    "V2", ("invoices",),
    """SELECT document_id, abs(subtotal + tax - total) / abs(total) <= 0.02::DOUBLE
         AND abs(total - subtotal) / abs(total) <= 0.02::DOUBLE AS valid FROM invoices""",
)
def balance_checks(t):
    checked = validate.check_balances(
        F.col("subtotal"), F.col("total"), F.col("subtotal"), F.col("tax")
    )
    return t.invoices.select("document_id", checked["valid"].alias("valid"))


@query(
    "A19", ("invoices",),
    f"""WITH {_VALID} SELECT document_type, field, count(CASE WHEN NOT valid THEN 1 END) AS failures
        FROM r GROUP BY 1, 2 UNION ALL SELECT 'invoice', '_cross_total', 0
        UNION ALL SELECT 'bank_statement', '_cross_balance', 0
        UNION ALL SELECT 'bank_statement', unnest(['opening_balance', 'closing_balance', 'available_balance']), 0""",
)
def validation_failures(t):
    rows = validate.validate_documents(_field_map(t))
    return analytics.validation_failures(rows, ["document_type", "field"])


# ---- confidence ---------------------------------------------------------------------------------

_NAMES = ["invoice_number", "due_date", "subtotal", "tax", "total_amount"]


def _scored_fields(t, keep=()):
    """Long field table of all invoices, with scan and classifier confidences from columns."""
    docs = t.spread("invoices").withColumns(
        {
            "ocr_conf": F.col("l_discount") * 10,
            "clf_conf": F.col("l_linenumber") / 8,
            "fields": F.create_map(
                F.lit("subtotal"), F.col("subtotal_text"), F.lit("tax"), F.col("tax_text"),
                F.lit("total_amount"), F.col("total_text"),
            ),
        }
    )
    docs = docs.withColumn("cross", confidence.cross_scores("fields"))
    values = {
        "invoice_number": "invoice_number", "due_date": "due_date", "subtotal": "subtotal_text",
        "tax": "tax_text", "total_amount": "total_text",
    }
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"), F.lit("string").alias("kind"),
                F.lit(n in ("invoice_number", "total_amount")).alias("required"),
                F.col(c).alias("value"), F.array().cast("array<string>").alias("values"),
            )
            for n, c in values.items()
        ]
    )
    rows = docs.select("document_id", "document_type", "ocr_conf", "clf_conf", "cross", *keep, F.inline(entries))
    return confidence.score_fields(rows, F.col("cross")[F.col("name")])


_SCORED = """
  f AS (
    SELECT document_id, document_type, l_discount * 10 AS ocr, l_linenumber / 8::DOUBLE AS clf, name, required, value,
      CASE WHEN value IS NULL THEN 0::DOUBLE
           WHEN name = 'invoice_number' THEN 1::DOUBLE
           WHEN name = 'due_date' THEN CASE WHEN regexp_matches(value, '\\d{1,2}-\\d{1,2}-\\d{2,4}')
             THEN 1::DOUBLE ELSE 0.3::DOUBLE END
           ELSE CASE WHEN CAST(value AS DOUBLE) > 0 THEN 1::DOUBLE ELSE 0.2::DOUBLE END END AS fit,
      CASE WHEN name IN ('subtotal', 'tax', 'total_amount') THEN greatest(0::DOUBLE,
             1::DOUBLE - abs(subtotal + tax - total) / total * 10) ELSE 0.5::DOUBLE END AS agreed
    FROM invoices CROSS JOIN LATERAL (VALUES ('invoice_number', true, invoice_number),
      ('due_date', false, due_date), ('subtotal', false, subtotal_text), ('tax', false, tax_text),
      ('total_amount', true, total_text)) x(name, required, value)),
  raw AS (SELECT *, least(0.99::DOUBLE, greatest(0::DOUBLE,
      CASE WHEN value IS NULL THEN 0::DOUBLE ELSE 0.40::DOUBLE END + 0.15::DOUBLE * ocr + 0.10::DOUBLE * clf
      + 0.20::DOUBLE * fit + 0.15::DOUBLE * agreed)) AS c FROM f),
  s AS (SELECT *, CASE WHEN required AND value IS NULL THEN least(c, 0.30::DOUBLE)
      WHEN value IS NOT NULL AND fit < 0.5 THEN least(c, 0.49::DOUBLE) ELSE c END AS final FROM raw),
  scored AS (SELECT *, CAST(printf('%.4f', final) AS DOUBLE) AS confidence,
      final < 0.75::DOUBLE AS requires_review FROM s)"""


@query(
    "V4 V5 V6", ("invoices",),
    f"""WITH {_SCORED} SELECT document_id, name, fit AS format_score, confidence, requires_review
        FROM scored""",
)
def field_confidence(t):
    return _scored_fields(t).select(
        "document_id", "name", "format_score", "confidence", "requires_review"
    )


@query(
    "V6", ("invoices",),
    """SELECT document_id, CAST(printf('%.9f', greatest(0::DOUBLE, 1::DOUBLE
         - abs(subtotal + tax - total) / total * 10)) AS DOUBLE) AS score FROM invoices""",
)
def cross_field_scores(t):
    fields = F.create_map(
        F.lit("subtotal"), F.col("subtotal_text"), F.lit("tax"), F.col("tax_text"),
        F.lit("total_amount"), F.col("total_text"),
    )
    score = confidence.cross_scores(fields)["total_amount"]
    return t.invoices.select("document_id", round_even(score, 9).alias("score"))


@query(
    "A7", ("invoices",),
    f"""WITH {_SCORED} SELECT document_id, CAST(printf('%.4f', least(0.99::DOUBLE,
          0.45::DOUBLE * (CAST(sum(CAST(confidence AS DECIMAL(20,4))) AS DOUBLE) / count(confidence)) + 0.20::DOUBLE * max(clf) + 0.10::DOUBLE * max(ocr)
          + 0.25::DOUBLE * count(CASE WHEN required AND value IS NOT NULL THEN 1 END)
            / count(CASE WHEN required THEN 1 END))) AS DOUBLE)
          AS document_confidence FROM scored GROUP BY 1""",
)
def document_confidence(t):
    return confidence.score_documents(_scored_fields(t))


@query(
    "J11 V7", ("invoices",),
    f"""WITH {_SCORED}, {_VALID}
        SELECT s.document_id, name AS field_name, value AS proposed_value, confidence,
          CASE WHEN NOT valid THEN reason END AS validation_reason, 1::BIGINT AS page_number,
          'pending' AS status
        FROM scored s LEFT JOIN (SELECT * FROM r WHERE document_type = 'invoice') x
          ON x.document_id = s.document_id AND x.field = s.name
        WHERE requires_review""",
)
def review_tasks(t):
    # The texts stay with their fields, so that only fields that get a task are checked, and nothing is joined.
    reason = validate.failed_reason("name", _fields_of_row(), "document_type")
    scored = _scored_fields(t, _TEXTS).withColumn("validation_reason", reason)
    return review.review_tasks(scored).select(
        "document_id", "field_name", "proposed_value", "confidence", "validation_reason",
        F.col("page_number").cast("long").alias("page_number"), "status",
    )


@query(
    "V7", ("invoices",),
    f"""WITH {_SCORED} SELECT document_id, CASE WHEN bool_or(requires_review) THEN 'review_required'
          ELSE 'completed' END AS status, count(CASE WHEN requires_review THEN 1 END) AS tasks
        FROM scored GROUP BY 1""",
)
def status_after_scoring(t):
    return review.status_after_scoring(_scored_fields(t))


def _decided(t):
    # Fields, tasks and decisions all need the scores: written once, as each use would compute them again.
    scored = cut_lineage(
        _scored_fields(t).select("document_id", "name", "value", "confidence", "requires_review")
    ).withColumn("validation_reason", F.lit(None).cast("string"))
    tasks = review.review_tasks(scored)
    decisions = tasks.where("field_name <> 'tax'").select(
        "task_id",
        F.lit(1).alias("decision_id"),
        F.lit("Kim").alias("reviewer_name"),
        F.lit("fixed").alias("corrected_value"),
        F.lit(0).alias("created_at"),
    )
    return scored, tasks, decisions


@query(
    "V8", ("invoices",),
    f"""WITH {_SCORED}, d AS (SELECT *, requires_review AND name <> 'tax' AS hit FROM scored)
        SELECT document_id, name, CASE WHEN hit THEN 'fixed' ELSE value END AS value,
          CASE WHEN hit THEN 1::DOUBLE ELSE confidence END AS confidence,
          requires_review AND NOT hit AS requires_review FROM d""",
)
def decided_fields(t):
    rows = review.apply_decisions(*_decided(t), asked=F.col("requires_review"))
    return rows.select("document_id", "name", "value", "confidence", "requires_review")


@query(
    "V8", ("invoices",),
    f"""WITH {_SCORED}, d AS (SELECT *, requires_review AND name <> 'tax' AS hit FROM scored)
        SELECT document_id,
          CASE WHEN NOT bool_or(requires_review) THEN 'completed'
               WHEN bool_or(hit) AND NOT bool_or(requires_review AND NOT hit) THEN 'completed'
               ELSE 'review_required' END AS status,
          CASE WHEN bool_or(hit) THEN CAST(printf('%.4f', CAST(sum(CAST(CASE WHEN hit THEN 1::DOUBLE ELSE confidence END
               AS DECIMAL(20,4))) AS DOUBLE) / count(*)) AS DOUBLE) END AS document_confidence
        FROM d GROUP BY 1""",
)
def documents_after_review(t):
    scored, tasks, decisions = _decided(t)
    docs = review.status_after_scoring(scored).select(
        "document_id", "status", F.lit(None).cast("double").alias("document_confidence")
    )
    rows = review.documents_after_review(docs, scored, tasks, decisions, asked=F.col("requires_review"))
    return rows.select("document_id", "status", "document_confidence")


@query(
    "A20", ("invoices",),
    f"""WITH {_SCORED}, {_VALID},
          n AS (SELECT document_id, count(CASE WHEN requires_review THEN 1 END) AS k FROM scored GROUP BY 1),
          e AS (SELECT document_id, count(CASE WHEN NOT valid THEN 1 END) AS k FROM r GROUP BY 1)
        SELECT i.document_id, i.document_type, n.k AS review_tasks, e.k AS validation_failures,
          CAST(printf('%.3f', l_discount * 3) AS DOUBLE) AS latency_seconds
        FROM invoices i JOIN n ON n.document_id = i.document_id JOIN e ON e.document_id = i.document_id""",
)
def processing_summary(t):
    scored, tasks, _ = _decided(t)
    docs = t.invoices.select(
        "document_id", "document_type", F.lit(0.5).alias("document_confidence"),
        (F.col("l_discount") * 3).alias("latency_seconds"),
    )
    rows = analytics.processing_summary(docs, tasks, validate.validate_documents(_field_map(t)))
    return rows.drop("document_confidence")


# ---- missing fields and snippets ----------------------------------------------------------------


@query(
    "E3", ("invoices",),
    """WITH f AS (SELECT document_id, l_linenumber, name, value FROM invoices CROSS JOIN LATERAL (VALUES
           ('invoice_number', invoice_number), ('due_date', due_date)) x(name, value))
       SELECT f.document_id, f.name, CASE WHEN g.asked AND f.l_linenumber > 3 THEN 'reply' ELSE value END AS value
       FROM f JOIN (SELECT document_id, bool_or(value IS NULL) AS asked FROM f GROUP BY 1) g
         ON f.document_id = g.document_id""",
)
def filled_fields(t):
    """Replies for late lines name every field; documents with nothing missing are not asked."""
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"), F.lit("string").alias("kind"), F.col(n).alias("value"),
                F.array().cast("array<string>").alias("values"),
            )
            for n in ("invoice_number", "due_date")
        ]
    )
    rows = t.invoices.select("document_id", F.inline(entries))
    names = F.explode(F.array(F.lit("invoice_number"), F.lit("due_date"), F.lit("other")))
    replies = t.invoices.where("l_linenumber > 3").select(
        "document_id", names.alias("name"), F.lit("reply").alias("value"),
        F.array().cast("array<string>").alias("values"),
    )
    filled = extract.fill_missing(rows, replies, ["document_id"])
    return filled.select("document_id", "name", "value")


@query(
    "E4", ("legal_texts",),
    """SELECT document_id, trim(regexp_replace(substr(text, greatest(1, strpos(text, signed_on) - 100),
          strpos(text, signed_on) + length(signed_on) + 100 - greatest(1, strpos(text, signed_on) - 100)),
          '\\s+', ' ', 'g')) AS snippet
       FROM legal_texts WHERE o_orderpriority = '3-MEDIUM'""",
)
def field_snippets(t):
    typed = t.spread("legal_texts").where("o_orderpriority = '3-MEDIUM'").withColumn(
        "document_type", F.lit("contract")
    )
    rows = extract.field_rows(extract.extract_fields(typed), ["document_id", "text"])
    rows = rows.where("name = 'effective_date'")
    return extract.with_snippets(rows).select("document_id", "snippet")


@query("E6 E7 E8 E9 E10")
def class_extractors(t):
    """All five fixed extractors over the texts of their type, as JSON."""
    from lexloom.operators.extract_classes import EXTRACTORS

    kind = (
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "contract")
        .when(F.col("o_orderpriority") == "2-HIGH", "legal_notice")
        .when(F.col("o_orderpriority") == "5-LOW", "affidavit")
        .when(F.col("o_orderpriority") == "1-URGENT", "legal_complaint")
        .otherwise("case_brief")
    )
    rows = t.spread("legal_texts").select("document_id", kind.alias("document_type"), "text")
    out = F.lit(None).cast("string")
    for name, extractor in EXTRACTORS.items():
        out = F.when(F.col("document_type") == name, F.to_json(extractor("text"))).otherwise(out)
    return rows.select("document_id", "document_type", out.alias("fields"))


@query(
    "E6", ("legal_texts",),
    """SELECT document_id, signed_on AS effective_date, concat('Buyer ', o_custkey) AS party_a,
         concat('Seller ', c_nationkey) AS party_b, state AS governing_law,
         concat('$', amount) AS contract_value, concat('$', amount) AS consideration,
         concat('the laws of the State of ', state, '; Signer') AS signers, 0::BIGINT AS signature_dates,
         concat('Buyer ', o_custkey, ' (party_a); Seller ', c_nationkey, ' (party_b)') AS parties,
         NULL::VARCHAR AS termination_date, NULL::VARCHAR AS payment_terms, NULL::VARCHAR AS notice_period,
         NULL::VARCHAR AS ip_ownership, NULL::VARCHAR AS dispute_resolution, true AS confidential, false AS indemnified,
         contains(regexp_replace(text, '\\s+', ' ', 'g'), 'Confidential data stay') AS confidential_in_text
       FROM legal_texts WHERE o_orderpriority = '3-MEDIUM'""",
)
def contract_class_fields(t):
    from lexloom.operators.extract_classes import class_fields

    rows = t.spread("legal_texts").where("o_orderpriority = '3-MEDIUM'")
    rows = rows.select("document_id", class_fields("text", "contract").alias("f"))
    return rows.select(
        "document_id", "f.effective_date", "f.party_a", "f.party_b", "f.governing_law",
        "f.contract_value", "f.consideration", F.array_join("f.signatures.name", "; ").alias("signers"),
        F.size(F.array_compact("f.signatures.date")).cast("long").alias("signature_dates"),
        F.array_join(F.transform("f.parties", lambda p: F.concat(p["name"], F.lit(" ("), p["role"], F.lit(")"))), "; ").alias("parties"),
        "f.termination_date", "f.payment_terms", "f.notice_period", "f.ip_ownership", "f.dispute_resolution",
        F.col("f.confidentiality_clause.present").alias("confidential"), F.col("f.indemnification.present").alias("indemnified"),
        F.col("f.confidentiality_clause.snippet").contains("Confidential data stay").alias("confidential_in_text"),
    )


@query(
    "E7", ("legal_texts",),
    """SELECT document_id, concat(c_nationkey, '-', o_custkey) AS case_number, signed_on AS filing_date,
         'Federal question jurisdiction under 28 U.S.C. § 1331' AS jurisdiction,
         'Venue alleged under 28 U.S.C. § 1391' AS venue,
         concat('I breach of duty ', o_custkey, '; II unjust gain') AS claims, true AS jury_demand,
         concat('I breach of duty ', o_custkey, '; II unjust gain') AS causes_of_action,
         rtrim(split_part(text, chr(10), 3), '.') AS case_caption, 'UNITED STATES DISTRICT COURT Civil Actio' AS court,
         split_part(split_part(text, chr(10), 3), ',', 1) AS plaintiffs, 'BETA HOLDINGS' AS defendants,
         '28 U.S.C. § 1331; 28 U.S.C. § 1391' AS statutes, '' AS relief_sought
       FROM legal_texts WHERE o_orderpriority = '1-URGENT'""",
)
def complaint_class_fields(t):
    from lexloom.operators.extract_classes import class_fields

    rows = t.spread("legal_texts").where("o_orderpriority = '1-URGENT'")
    rows = rows.select("document_id", class_fields("text", "legal_complaint").alias("f"))
    return rows.select(
        "document_id", "f.case_number", "f.filing_date", "f.jurisdiction", "f.venue",
        "f.jury_demand", "f.case_caption", "f.court",
        *[F.array_join(f"f.{n}", "; ").alias(n) for n in ("claims", "causes_of_action", "plaintiffs", "defendants", "statutes", "relief_sought")],
    )


@query(
    "E8", ("legal_texts",),
    """SELECT document_id, 'cease_and_desist' AS notice_type, concat('Firm ', c_nationkey) AS issuing_party,
         signed_on AS response_deadline, concat('stop the sale of lot ', o_custkey) AS actions,
         CASE WHEN signed_on LIKE 'October%' THEN substr(signed_on, 5) ELSE concat('p the sale of lot ', o_custkey, '.') END AS receiving_party, NULL::VARCHAR AS issue_date,
         NULL::VARCHAR AS jurisdiction, '' AS referenced
       FROM legal_texts WHERE o_orderpriority = '2-HIGH'""",
)
def notice_class_fields(t):
    from lexloom.operators.extract_classes import class_fields

    rows = t.spread("legal_texts").where("o_orderpriority = '2-HIGH'")
    rows = rows.select("document_id", class_fields("text", "legal_notice").alias("f"))
    return rows.select(
        "document_id", "f.notice_type", "f.issuing_party", "f.response_deadline",
        F.array_join("f.required_actions", "; ").alias("actions"), "f.receiving_party", "f.issue_date", "f.jurisdiction",
        F.array_join("f.referenced_documents", "; ").alias("referenced"),
    )


@query(
    "E9", (),
    """SELECT p_partkey, concat('Brand ', p_size, ' v. Maker') AS case_name, concat(p_size, '-', p_partkey) AS case_number,
         'Whether the sale was void; Whether notice was given' AS legal_issues,
         concat('42 U.S.C. ', p_size, '; section ', p_partkey) AS cited_statutes,
         NULL::VARCHAR AS court, NULL::VARCHAR AS jurisdiction, NULL::VARCHAR AS filing_date, NULL::VARCHAR AS decision_date,
         NULL::VARCHAR AS plaintiff, NULL::VARCHAR AS defendant, NULL::VARCHAR AS holding
       FROM part""",
)
def brief_class_fields(t):
    from lexloom.operators.extract_classes import class_fields

    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("Case name: Brand "), size, F.lit(" v. Maker\nDocket no. "), size, F.lit("-"), key,
        F.lit("\nLegal issues: Whether the sale was void? Whether notice was given?\n\nUnder 42 U.S.C. "),
        size, F.lit("\nSee section "), key, F.lit("\n"),
    )
    rows = t.part.select("p_partkey", class_fields(text, "case_brief").alias("f"))
    return rows.select(
        "p_partkey", "f.case_name", "f.case_number",
        F.array_join("f.legal_issues", "; ").alias("legal_issues"),
        F.array_join("f.cited_statutes", "; ").alias("cited_statutes"),
        "f.court", "f.jurisdiction", "f.filing_date", "f.decision_date", "f.plaintiff", "f.defendant", "f.holding",
    )


@query(
    "E10", ("legal_texts",),
    """SELECT document_id, 'Person' AS declarant_name, 'Clerk' AS declarant_role, state AS notary_jurisdiction,
         'Public' AS notary_name, NULL::VARCHAR AS execution_date, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS statement_summary
       FROM legal_texts WHERE o_orderpriority = '5-LOW'""",
)
def affidavit_class_fields(t):
    from lexloom.operators.extract_classes import class_fields

    rows = t.spread("legal_texts").where("o_orderpriority = '5-LOW'")
    rows = rows.select("document_id", class_fields("text", "affidavit").alias("f"))
    return rows.select("document_id", "f.declarant_name", "f.declarant_role", "f.notary_jurisdiction", "f.notary_name", "f.execution_date", "f.statement_summary")


# ---- model replies and drafts -------------------------------------------------------------------

_REPLY_KINDS = 5


def _replies(t):
    """Raw replies of five shapes around the same object, from the orders."""
    key = F.col("o_orderkey").cast("string")
    body = F.concat(
        F.lit('{"sections": [{"key": "facts", "title": "Facts", "content": "Order '), key,
        F.lit(' was paid.", "evidence_chunk_ids": ["c1", "c9", "c1"], "confidence": "high"}, {"content": "x"}]}'),
    )
    loose = F.regexp_replace(body, r'"x"\}\]', '"x",},]')
    kind = F.col("o_custkey") % _REPLY_KINDS
    raw = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Bye.")))
        .when(kind == 3, loose)
        .otherwise("I cannot answer.")
    )
    return t.orders.select(
        key.alias("draft_id"), raw.alias("reply"), F.lit(None).cast("string").alias("error")
    )


@query(
    "X8", (),
    """SELECT CAST(o_orderkey AS VARCHAR) AS draft_id, o_custkey % 5 < 4 AS parsed FROM orders""",
)
def repaired_replies(t):
    return _replies(t).select("draft_id", clean_reply("reply").isNotNull().alias("parsed"))


@query(
    "R11 R15", (),
    """SELECT CAST(o_orderkey AS VARCHAR) AS draft_id, 'draft' AS status, x.* FROM orders
       CROSS JOIN LATERAL (VALUES (0::BIGINT, 'facts', 'Facts', concat('Order ', o_orderkey, ' was paid.'), 'high'),
         (1, 'section_2', 'Section 2', 'x', 'low')) x(position, key, title, content, confidence)
       WHERE o_custkey % 5 < 4
       UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'failed', 0, 'generation_error', 'Generation Error',
         '[UNSUPPORTED: Draft generation failed: reply is not JSON]', 'unsupported' FROM orders
       WHERE o_custkey % 5 = 4""",
)
def draft_sections(t):
    done = drafts.finished_drafts(drafts.parse_replies(_replies(t)))
    rows = drafts.section_rows(done)
    return rows.select(
        "draft_id", "status", F.col("position").cast("long").alias("position"), "key", "title",
        "content", "confidence",
    )


@query(
    "R15", (),
    "SELECT CAST(o_orderkey AS VARCHAR) AS draft_id, 'generating' AS status, 0::BIGINT AS word_count FROM orders",
)
def draft_placeholders(t):
    asked = t.orders.select(F.col("o_orderkey").cast("string").alias("draft_id"))
    rows = drafts.placeholder_drafts(asked)
    return rows.select("draft_id", "status", F.col("word_count").cast("long").alias("word_count"))


@query(
    "J9", (),
    """SELECT CAST(o_orderkey AS VARCHAR) AS draft_id, CASE WHEN o_custkey % 2 = 0 THEN 'c9,c1' ELSE 'c1' END AS kept
       FROM orders""",
)
def offered_evidence(t):
    rows = t.orders.select(
        F.col("o_orderkey").cast("string").alias("draft_id"),
        F.array(F.lit("c9"), F.lit("c1"), F.lit("c4"), F.lit("c9"), F.lit("c1")).alias("cited"),
        F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("c1"), F.lit("c9")))
        .otherwise(F.array(F.lit("c1"))).alias("offered"),
    )
    return rows.select(
        "draft_id", F.array_join(drafts.offered_evidence("cited", "offered"), ",").alias("kept")
    )


@query(
    "J4", (),
    """SELECT DISTINCT CAST(o.o_orderkey AS VARCHAR) AS draft_id, CAST(d.doc_id AS VARCHAR) AS chunk_id, lang
       FROM orders o JOIN documents d ON d.doc_id IN (o.o_custkey, o.o_orderkey)""",
)
def evidence_chunks(t):
    made = t.orders.select(
        F.col("o_orderkey").cast("string").alias("draft_id"),
        F.array(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias(
            "evidence_chunk_ids"
        ),
    )
    stored = t.documents.select(
        F.col("doc_id").cast("string").alias("chunk_id"), "lang", F.lit(1).alias("page_number"),
        F.col("doc_id").alias("chunk_index"),
    )
    return drafts.evidence_chunks(made, stored).select("draft_id", "chunk_id", "lang")


_GROUND_VIEW = """
    SELECT CAST(l_orderkey AS STRING) AS draft_id, concat(l_linenumber, '-', l_partkey, '-', l_suppkey) AS key,
      CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS cited,
      concat('The Buyer agreed to pay the price of the goods',
        CASE WHEN l_linenumber % 3 > 0 THEN ' [Page 3]' ELSE '' END, '. ',
        'The Seller agreed to ship all parts of lot ', l_partkey,
        CASE WHEN l_linenumber % 3 > 1 THEN ' [Chunk 2]' ELSE ' [UNSUPPORTED: none]' END, '. ',
        'Short one here. the goods were sent on a very long trip then.') AS content
    FROM {lineitem}"""
_GROUND_SQL = _GROUND_VIEW.replace("{lineitem}", "lineitem")
# Two sentences qualify: the third is short, the last has neither a name nor a legal noun.
_GROUND_SCORED = f"""g AS (SELECT *, CASE cited WHEN 0 THEN 0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS score,
    len(regexp_extract_all(content, '\\b[\\w''-]+\\b')) AS w,
    len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS n FROM ({_GROUND_SQL}))"""


def _ground(t):
    from lexloom.plans.tables import table
    from lexloom.session import spread

    return spread(t.spark.sql(_GROUND_VIEW, lineitem=table(t.spark, t.sf_dir, "lineitem")))


@query("R12", (), f"WITH {_GROUND_SCORED} SELECT draft_id, key, score AS grounding_score FROM g")
def section_grounding(t):
    return grounding.score_sections(_ground(t)).select("draft_id", "key", "grounding_score")


@query(
    "A13 A14", (),
    f"""WITH {_GROUND_SCORED} SELECT draft_id, CAST(printf('%.2f', sum(score * w) / CAST(sum(w) AS DOUBLE)) AS DOUBLE)
          AS overall_grounding_score, CAST(sum(n) AS BIGINT) AS word_count FROM g GROUP BY 1""",
)
def draft_scores(t):
    return grounding.draft_scores(grounding.score_sections(_ground(t)))


@query(
    "R13", (),
    """SELECT a.conv_id, a.turn, a.text AS original_content, b.text AS edited_content
       FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
       WHERE a.role = 'assistant' AND a.text <> b.text""",
)
def section_edits(t):
    """Assistant turns are sections, the next turn is the edited text."""
    rows = t.conversations
    made = rows.where("role = 'assistant'").select(
        F.col("conv_id").alias("draft_id"), F.col("turn").cast("string").alias("key"),
        F.col("text").alias("content"), F.lit(1.0).alias("grounding_score"),
    )
    asked = rows.select(
        F.col("conv_id").alias("draft_id"), (F.col("turn") - 1).cast("string").alias("section_key"),
        F.col("text").alias("edited_content"), F.lit("Kim").alias("reviewer_name"),
    )
    _, edits, _ = drafts.apply_section_edits(made, asked)
    return edits.select(
        F.col("draft_id").alias("conv_id"), F.col("section_key").cast("long").alias("turn"),
        "original_content", "edited_content",
    )


@query("R13 R12 A13 A14")
def drafts_after_edits(t):
    rows = t.conversations
    made = grounding.score_sections(
        rows.where("role = 'assistant'").select(
            F.col("conv_id").alias("draft_id"), F.col("turn").cast("string").alias("key"),
            F.col("text").alias("content"),
        )
    )
    asked = rows.select(
        F.col("conv_id").alias("draft_id"), (F.col("turn") - 1).cast("string").alias("section_key"),
        F.col("text").alias("edited_content"), F.lit("Kim").alias("reviewer_name"),
    )
    return drafts.apply_section_edits(made, asked)[2]


_PROMPT_DATE = "March 1, 2024"


def _prompt_sql(draft: str, types: dict[str, str]) -> str:
    """The prompts spelled out: constant lines around what comes from the row."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    applicable, sections = fv.DRAFT_TEMPLATES[draft]
    memo = draft == "internal_memo"
    system = [
        f"Write a {draft} from the given sources only, in formal legal style.",
        "Cite every fact as [Page N] or [Page N - Section Title].",
        "Where the sources are silent write [UNSUPPORTED: reason]; general knowledge fills no gaps.",
        f"Date the draft {_PROMPT_DATE}. Do not invent filing, review, or memo dates.",
        'Repair scanning errors only where the term is clear, as in "Landmark Credit Union" for "Iandmark Credit Union".',
    ]
    if memo:
        system.append("TEMPLATE RULES (metadata, not facts of the document; never mark it unsupported):")
        system += ["- TO: Senior Partner", "- FROM: Legal Document Analyst", f"- DATE: {_PROMPT_DATE}"]
    system.append("PREFERENCES LEARNED FROM EDITS:\n")
    answer = "\nAnswer in JSON: sections of key, title, content, evidence_chunk_ids, confidence."
    plan = [f'Defaults: {{"to": "Senior Partner", "from": "Legal Document Analyst", "date": "{_PROMPT_DATE}"}}'] if memo else []
    plan.append("Section plan:")
    plan += [f"- {t} ({'required' if r else 'optional'}): {fv.SECTION_INSTRUCTIONS[draft][k]}" for k, t, r, _ in sections]
    header = "The memo header should use TO: Senior Partner, FROM: Legal Document Analyst, and the provided DRAFT DATE."
    claims = fv.DRAFT_INSTRUCTIONS[0][2]
    if memo:
        asked = f"concat({text('INSTRUCTIONS:')}, CASE WHEN kind = 'legal_complaint' THEN {text(chr(10) + '- ' + claims)} ELSE '' END, {text(chr(10) + '- ' + header)})"
    else:
        asked = text("INSTRUCTIONS: follow the requested draft type.")
    kinds = ", ".join(text(k) for k in applicable)
    cases = " ".join(f"WHEN lang = '{lang}' THEN '{kind}'" for lang, kind in types.items())
    return f"""
      WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, lang, source, text, CASE {cases} ELSE 'legal_notice' END AS kind FROM documents),
      f AS (SELECT *, concat('{{', array_to_string(list_filter([CASE WHEN lang IS NOT NULL THEN concat('"lang":"', lang, '"') END,
              CASE WHEN source IS NOT NULL THEN concat('"source":"', source, '"') END], lambda x: x IS NOT NULL), ','), '}}') AS fields FROM d)
      SELECT document_id,
        concat({text(chr(10).join(system))}, CASE WHEN lang IS NOT NULL THEN concat('- Write in ', lang) ELSE '' END, {text(answer)}) AS system_prompt,
        concat('DOCUMENT TYPE: ', kind, {text(f"{chr(10) * 2}DRAFT DATE: {_PROMPT_DATE}{chr(10) * 2}FIELDS: ")}, fields, {text(chr(10) * 2)},
          {asked}, {text(f"{chr(10) * 2}DRAFT TEMPLATE: {draft}. ")},
          CASE WHEN kind IN ({kinds}) THEN concat('Applicable to ', kind, '.')
               ELSE concat('Not listed for ', kind, '; use it as well as it fits.') END,
          {text(chr(10) + chr(10).join(plan) + chr(10) * 2 + "SOURCES:" + chr(10) + "---" + chr(10))},
          coalesce('[Chunk 1 | Page 1 | ] ' || document_id || chr(10) || text, ''), {text(chr(10) + "---")}) AS user_prompt
      FROM f"""


def _prompted(t, draft: str, types: dict[str, str]):
    kind = F.coalesce(*[F.when(F.col("lang") == lang, kind) for lang, kind in types.items()], F.lit("legal_notice"))
    docs = t.documents.select(
        F.col("doc_id").cast("string").alias("document_id"),
        kind.alias("document_type"),
        F.to_json(F.struct("lang", "source")).alias("fields_json"),
        F.lit("").alias("terms_block"),
        F.lit("").alias("conflicts_block"),
        F.array(F.concat(F.lit("Write in "), "lang")).alias("preferences"),
        F.array().cast("array<struct<original:string,edited:string>>").alias("examples"),
    )
    selected = t.documents.select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("position"),
        F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("section_header"),
        F.col("doc_id").cast("string").alias("chunk_id"), "text",
    )
    block = drafts.source_block(selected)
    return drafts.prompts(docs.join(block, "document_id", "left"), draft, _PROMPT_DATE)


@query("R10 T3", (), _prompt_sql("contract_summary", {"en": "contract"}))
def draft_prompts(t):
    """Prompts of all documents with their whole text as the one source."""
    return _prompted(t, "contract_summary", {"en": "contract"})


@query("R10", (), _prompt_sql("internal_memo", {"en": "legal_complaint", "de": "affidavit"}))
def memo_prompts(t):
    """Memo prompts: template metadata, instructions for complaints, a type the template is not listed for."""
    return _prompted(t, "internal_memo", {"en": "legal_complaint", "de": "affidavit"})


# ---- draft quality ------------------------------------------------------------------------------

_TOKENS = "list_distinct(list_transform(regexp_extract_all({0}, '[a-zA-Z0-9]{{3,}}'), lambda x: lower(x)))"


@query(
    "R14", (),
    f"""WITH p AS (SELECT a.conv_id, a.turn, {_TOKENS.format('a.text')} AS c, {_TOKENS.format('b.text')} AS r
          FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
        SELECT conv_id, turn, CASE WHEN len(r) > 0 THEN CAST(len(list_intersect(c, r)) AS DOUBLE) / len(r)
          ELSE 0::DOUBLE END AS rouge FROM p""",
)
def rouge_by_turn(t):
    a = t.conversations.select("conv_id", "turn", "text")
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return a.join(b, ["conv_id", "turn"]).select(
        "conv_id", "turn", evaluate.rouge_lite("text", "next").alias("rouge")
    )


@query("R14 A17")
def draft_quality(t):
    a = t.conversations.where("role = 'assistant'").select("conv_id", "turn", "text")
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    rows = a.join(b, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("case_id"), F.col("text").alias("content"),
        F.col("next").alias("reference"), F.col("next").alias("source"),
    )
    return evaluate.draft_metrics(rows)


@query(
    "A17", (),
    f"""WITH p AS (SELECT a.conv_id, {_TOKENS.format('a.text')} AS c, {_TOKENS.format("coalesce(b.text, '')")} AS r,
            coalesce(b.text, '') = '' AS blank
          FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
          WHERE a.role = 'assistant')
        SELECT count(DISTINCT conv_id) AS cases, CAST(printf('%.4f', avg(CASE WHEN len(r) > 0
            THEN CAST(len(list_intersect(c, r)) AS DOUBLE) / len(r) ELSE 0::DOUBLE END)) AS DOUBLE) AS rouge_lite,
          CASE WHEN count(CASE WHEN blank THEN 1 END) > 0 THEN 0::DOUBLE ELSE 1::DOUBLE END
            AS unsupported_honesty_rate FROM p""",
)
def draft_quality_rouge(t):
    return draft_quality(t).select("cases", "rouge_lite", "unsupported_honesty_rate")


@query(
    "A18", (),
    """WITH r AS (SELECT avg(CASE WHEN toxic = 0 THEN CAST(1 - quality AS DOUBLE) END) AS b,
         avg(CASE WHEN toxic = 1 THEN CAST(1 - quality AS DOUBLE) END) AS a FROM labels)
       SELECT CAST(printf('%.4f', b) AS DOUBLE) AS before_edit_rate, CAST(printf('%.4f', a) AS DOUBLE) AS after_edit_rate,
         CAST(printf('%.4f', b - a) AS DOUBLE) AS absolute_drop, CAST(printf('%.4f', (b - a) / b) AS DOUBLE) AS relative_drop,
         (b - a) / b >= 0.2 AS target_met FROM r""",
)
def improvement_quality(t):
    rows = t.labels.select(
        F.when(F.col("toxic") == 0, "before").otherwise("after").alias("phase"),
        (F.col("quality") == 0).alias("edited"),
    )
    return evaluate.improvement_metrics(rows)


# ---- preferences --------------------------------------------------------------------------------


@query(
    "F6", (),
    """WITH p AS (SELECT conv_id, turn, text AS a, CASE turn % 3 WHEN 0 THEN concat('  ', text, ' ')
         WHEN 1 THEN replace(text, ' ', '  ') ELSE concat(text, ' more') END AS b FROM conversations),
       s AS (SELECT *, regexp_replace(a, '^\\s+|\\s+$', '', 'g') AS sa, regexp_replace(b, '^\\s+|\\s+$', '', 'g') AS sb FROM p)
       SELECT conv_id, turn, sa = sb OR (abs(length(b) - length(a)) < 20
         AND list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '')
           = list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '')) AS trivial FROM s""",
)
def trivial_edits(t):
    edited = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), "text", F.lit(" ")))
        .when(F.col("turn") % 3 == 1, F.replace("text", F.lit(" "), F.lit("  ")))
        .otherwise(F.concat("text", F.lit(" more")))
    )
    return t.conversations.select(
        "conv_id", "turn", preferences.is_trivial_edit(F.col("text"), edited).alias("trivial")
    )


@query(
    "J3 K2", ("preferences",),
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, document_type
          ORDER BY application_count * 0.6::DOUBLE + confidence * 0.4::DOUBLE DESC, preference_id) AS k FROM preferences)
       SELECT preference_id, lang AS original, source AS edited FROM r JOIN documents
         ON preference_id = CAST(doc_id AS VARCHAR) WHERE k <= 2""",
)
def few_shot_pairs(t):
    edits = t.documents.select(
        F.col("doc_id").cast("string").alias("edit_id"), F.col("lang").alias("original_content"),
        F.col("source").alias("edited_content"),
    )
    rules = t.preferences.withColumn("source_edit_id", F.col("preference_id"))
    rows = preferences.few_shot_pairs(rules, edits)
    return rows.select(
        "preference_id", F.col("original_content").alias("original"),
        F.col("edited_content").alias("edited"),
    )


@query(
    "P3", ("preferences",),
    """SELECT preference_id, application_count + coalesce(n, 0) AS application_count FROM preferences
       LEFT JOIN (SELECT CAST(k AS VARCHAR) AS k, count(*) AS n FROM (SELECT l_partkey AS k FROM lineitem
         UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY 1) ON k = preference_id""",
)
def counted_applications(t):
    made = t.lineitem.select(
        F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias(
            "preferences_applied"
        )
    )
    rows = preferences.count_applications(t.preferences, made)
    return rows.select("preference_id", "application_count")


@query(
    "P2", ("preferences",),
    """WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS preference_id,
         list(CASE WHEN l_quantity < 25 THEN 0.10::DOUBLE ELSE -0.05::DOUBLE * l_linenumber / 7 END
              ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS deltas FROM lineitem GROUP BY 1)
       SELECT p.preference_id, CAST(printf('%.6f', CASE WHEN deltas IS NULL THEN effectiveness_score ELSE
         list_reduce(list_prepend(effectiveness_score, deltas),
           lambda a, d: greatest(0::DOUBLE, least(1::DOUBLE, a + d))) END) AS DOUBLE) AS effectiveness_score
       FROM preferences p LEFT JOIN s ON s.preference_id = p.preference_id""",
)
def updated_effectiveness(t):
    """Every line is a review of the draft that applied the supplier's rule."""
    reviews = t.lineitem.select(
        F.array(F.col("l_suppkey").cast("string")).alias("preferences_applied"),
        F.when(F.col("l_quantity") < 25, 0).otherwise(F.col("l_linenumber")).alias("edited_sections"),
        F.lit(7).alias("total_sections"),
        F.col("l_shipdate").alias("reviewed_at"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("draft_id"),
    )
    rows = preferences.update_effectiveness(t.preferences, reviews)
    return rows.select(
        "preference_id", round_even("effectiveness_score", 6).alias("effectiveness_score")
    )


@query(
    "P1", (),
    """WITH RECURSIVE e AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, label % 2 = 1 AS stored,
           floor(label / 2) AS g, CAST(embedding AS DOUBLE[]) AS v,
           CASE WHEN label % 2 = 0 AND vec_id % 101 = 0 THEN 0.8::DOUBLE ELSE CAST(vec_id % 101 AS DOUBLE) / 100 END AS c
         FROM embeddings),
       edge AS (SELECT a.id AS x, b.id AS y FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id
           AND NOT (a.stored AND b.stored) AND list_cosine_similarity(a.v, b.v) >= 0.35),
       reach AS (SELECT id AS x, id AS y FROM e UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
       part AS (SELECT x AS id, min(y) AS p FROM reach GROUP BY 1),
       r AS (SELECT e.*, p, first_value(CASE WHEN stored THEN e.id END) OVER (PARTITION BY p ORDER BY stored DESC, -(c * 0.4::DOUBLE), e.id) AS stored_id,
           first_value(CASE WHEN NOT stored THEN e.id END) OVER (PARTITION BY p ORDER BY stored, vec_id) AS new_id,
           first_value(CASE WHEN NOT stored THEN e.id END) OVER (PARTITION BY p ORDER BY stored, -c, vec_id) AS best_id,
           first_value(CASE WHEN NOT stored THEN c END) OVER (PARTITION BY p ORDER BY stored, -c, vec_id) AS best_c
         FROM e JOIN part ON e.id = part.id)
       SELECT id AS preference_id, concat('type-', CAST(g AS INTEGER)) AS document_type,
         concat('rule ', CASE WHEN NOT stored OR (id = stored_id AND best_c > c) THEN best_id ELSE id END) AS preference_text,
         CASE WHEN NOT stored OR (id = stored_id AND best_c > c) THEN best_c ELSE c END AS confidence,
         CAST(0 AS BIGINT) AS application_count, 0.5::DOUBLE AS effectiveness_score
       FROM r WHERE stored OR (stored_id IS NULL AND id = new_id)""",
)
def merged_rules(t):
    """Stored rules (odd labels) and newly learned ones (even labels); these vectors are far apart, hence the threshold."""
    base = t.embeddings.select(
        F.lit(None).cast("string").alias("tenant_id"),
        F.concat(F.lit("type-"), F.floor(F.col("label") / 2).cast("string")).alias("document_type"),
        F.col("vec_id").cast("string").alias("preference_id"),
        F.concat(F.lit("rule "), F.col("vec_id").cast("string")).alias("preference_text"),
        F.lit(None).cast("string").alias("source_edit_id"),
        F.col("embedding").alias("vector"),
        (F.col("vec_id") % 101 / 100).alias("confidence"),
        F.lit(0).cast("long").alias("application_count"),
        F.lit(0.5).alias("effectiveness_score"),
        F.timestamp_seconds(F.col("vec_id")).alias("created_at"),
        "label",
    )
    stored = base.where("label % 2 = 1").drop("label")
    learned = base.where("label % 2 = 0").drop("label")
    rows = preferences.merge_rules(stored, learned, threshold=0.35)
    return rows.drop("tenant_id", "source_edit_id")
