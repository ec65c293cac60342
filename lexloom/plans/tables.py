"""The engine's input tables, derived from the given tables.

Legal wording is templated from columns, so that a second engine can build the same tables. Every
view is one SQL text for Spark and for the checking engine; ``longdate`` and ``money`` are the only
places where the two dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lexloom.session import spread

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_STATE = (
    "CASE l_suppkey % 4 WHEN 0 THEN 'Delaware' WHEN 1 THEN 'New York' WHEN 2 THEN 'Ohio' "
    "ELSE 'Texas' END"
)
_BUYER_STATE = _STATE.replace("l_suppkey", "c_nationkey")

VIEWS = {
    "docs": """
        SELECT CAST(o_orderkey AS STRING) AS document_id,
               concat('order-', o_orderkey, '.pdf') AS filename,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued'
                    ELSE 'review_required' END AS status,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'legal_complaint'
                    WHEN '2-HIGH' THEN 'legal_notice' WHEN '3-MEDIUM' THEN 'contract'
                    WHEN '5-LOW' THEN 'affidavit' END AS document_type,
               NULLIF(c_mktsegment, 'HOUSEHOLD') AS tenant_id,
               CASE WHEN o_totalprice < 30000 THEN o_orderdate + INTERVAL 30 DAY END AS deleted_at,
               o_orderdate AS created_at,
               CASE WHEN o_orderstatus <> 'O' THEN CAST(o_custkey % 101 AS DOUBLE) / 100 END
                    AS document_confidence,
               o_totalprice / 100000 AS latency_seconds
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "extractions": """
        SELECT CAST(doc_id AS STRING) AS document_id, text AS ocr_text FROM {documents}""",
    "tasks": """
        SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS task_id,
               CAST(l_orderkey AS STRING) AS document_id,
               CASE l_returnflag WHEN 'A' THEN 'total_amount' WHEN 'N' THEN 'due_date'
                    ELSE 'party_a' END AS field_name,
               CASE l_linestatus WHEN 'O' THEN 'pending' ELSE 'completed' END AS status,
               l_shipdate AS created_at
        FROM {lineitem}""",
    "corrections": """
        SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS correction_id,
               CAST(l_orderkey AS STRING) AS document_id,
               concat('field_', l_linenumber) AS field_name
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    "drafts": """
        SELECT CAST(o_orderkey AS STRING) AS draft_id, CAST(o_orderkey AS STRING) AS document_id,
               NULLIF(c_mktsegment, 'HOUSEHOLD') AS tenant_id, o_orderdate AS created_at,
               CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 128 AS DOUBLE) / 128 END
                    AS overall_grounding_score
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "edits": """
        SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS edit_id,
               CAST(l_orderkey AS STRING) AS draft_id, CAST(l_orderkey AS STRING) AS document_id,
               NULLIF(c_mktsegment, 'HOUSEHOLD') AS tenant_id,
               concat('section_', l_linenumber) AS section_key, l_shipdate AS created_at
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
             JOIN {customer} ON o_custkey = c_custkey""",
    "preferences": """
        SELECT CAST(p_partkey AS STRING) AS preference_id,
               CASE WHEN p_size % 5 > 0 THEN concat('tenant-', p_size % 5) END AS tenant_id,
               p_type AS document_type,
               concat('Prefer ', p_name, ' wording for ', p_brand) AS preference_text,
               CAST(p_size AS BIGINT) AS application_count,
               CAST(p_partkey % 101 AS DOUBLE) / 100 AS confidence,
               CAST(p_partkey % 64 AS DOUBLE) / 64 AS effectiveness_score
        FROM {part}""",
    "hooks": """
        SELECT CAST(n_nationkey AS STRING) AS hook_id,
               concat('https://hooks.example.com/', n_name) AS url,
               CASE n_nationkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'view'
                    WHEN 3 THEN 'purchase' ELSE 'signup' END AS event,
               CASE n_regionkey WHEN 0 THEN 'inactive' ELSE 'active' END AS status
        FROM {nation}""",
    "failed": """
        SELECT event_id AS failed_id, props AS payload,
               CASE WHEN value < 30 THEN 'processing.completed' ELSE 'processing.failed' END AS event,
               value > 100 AS replayed, ts AS created_at
        FROM {events} WHERE event_type = 'error'""",
    "contract_lines": f"""
        SELECT CAST(l_orderkey AS STRING) AS document_id, l_linenumber AS chunk_index,
               {_STATE} AS state, [[longdate:l_shipdate]] AS start_date,
               [[money:l_extendedprice]] AS fee,
               concat('grade ', l_returnflag, ' delivery under status ', l_linestatus) AS meaning,
               concat('This Agreement shall be governed by the laws of the State of ', {_STATE},
                      '. Effective Date: ', [[longdate:l_shipdate]],
                      '. The monthly fee is $', [[money:l_extendedprice]],
                      '. "Service Level" means grade ', l_returnflag, ' delivery under status ',
                      l_linestatus, '.') AS text
        FROM {{lineitem}}""",
    "seed_terms": """
        SELECT CAST(o_orderkey AS STRING) AS document_id, 'Service Level' AS term,
               concat('grade A delivery under status ', o_orderstatus) AS definition
        FROM {orders}""",
    "legal_texts": f"""
        SELECT CAST(o_orderkey AS STRING) AS document_id, o_orderpriority, o_orderstatus,
               o_custkey, c_nationkey, {_BUYER_STATE} AS state,
               [[longdate:o_orderdate]] AS signed_on, [[money:o_totalprice]] AS amount,
               CASE o_orderpriority
               WHEN '3-MEDIUM' THEN concat(
                   'SERVICE AGREEMENT', chr(10),
                   'Effective Date: ', [[longdate:o_orderdate]], chr(10),
                   'This Agreement is made between Buyer ', o_custkey, ' and Seller ', c_nationkey,
                   chr(10), 'Party B: Seller ', c_nationkey, chr(10),
                   'It shall be governed by the laws of the State of ', {_BUYER_STATE}, '.', chr(10),
                   'Contract Value: $', [[money:o_totalprice]], chr(10),
                   'Confidential data stay with the parties.', chr(10),
                   'By: Signer ', o_custkey, chr(10))
               WHEN '1-URGENT' THEN concat(
                   'UNITED STATES DISTRICT COURT', chr(10), 'Civil Action No. ',
                   c_nationkey, '-', o_custkey, chr(10),
                   'ACME ', c_mktsegment, ', Plaintiff, v. BETA HOLDINGS, Defendants.', chr(10),
                   'COMPLAINT', chr(10), 'Filed: ', [[longdate:o_orderdate]], chr(10),
                   'Jurisdiction rests on 28 U.S.C. § 1331 and venue on 28 U.S.C. § 1391.', chr(10),
                   'COUNT I breach of duty ', o_custkey, chr(10),
                   'COUNT II unjust gain', chr(10),
                   'Plaintiff asks for a jury trial demanded of right against the defendant.', chr(10))
               WHEN '2-HIGH' THEN concat(
                   'CEASE AND DESIST', chr(10), 'Notice of demand letter', chr(10),
                   'From: Firm ', c_nationkey, chr(10), 'Issued: ', [[longdate:o_orderdate]], chr(10),
                   'Response deadline: ', [[longdate:o_orderdate]], chr(10),
                   'The firm must stop the sale of lot ', o_custkey, '.', chr(10))
               WHEN '5-LOW' THEN concat(
                   'Affidavit of Person ', o_custkey, chr(10), 'Title: Clerk ', c_nationkey, chr(10),
                   'Notary Public: Notary ', c_nationkey, chr(10),
                   'County of ', {_BUYER_STATE}, chr(10),
                   'Sworn: ', [[longdate:o_orderdate]], chr(10))
               ELSE concat('Memo for account ', o_custkey, ' of ', [[longdate:o_orderdate]],
                           ' over $', [[money:o_totalprice]], ' in all.', chr(10))
               END AS text
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "invoices": """
        SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS document_id,
               CASE WHEN l_linestatus = 'F' THEN 'invoice' ELSE 'bank_statement' END AS document_type,
               CASE WHEN l_returnflag <> 'R' THEN concat('inv-', l_partkey) END AS invoice_number,
               CASE WHEN l_linenumber > 1 THEN [[isodate:l_shipdate]] ELSE 'soon' END AS due_date,
               l_extendedprice AS subtotal, l_tax AS tax_rate,
               CAST(l_extendedprice AS STRING) AS subtotal_text,
               CAST(l_quantity AS STRING) AS tax_text,
               CAST(l_extendedprice + CASE WHEN l_discount > 0.08 THEN 5000 ELSE l_quantity END
                    AS STRING) AS total_text,
               l_quantity AS tax,
               l_extendedprice + CASE WHEN l_discount > 0.08 THEN 5000 ELSE l_quantity END AS total,
               l_discount, l_linenumber
        FROM {lineitem}""",
}

_MACROS = {
    "spark": {
        "longdate": "date_format({0}, 'MMMM d, yyyy')",
        "money": "format_string('%.2f', {0})",
        "isodate": "date_format({0}, 'yyyy-MM-dd')",
    },
    "check": {
        "longdate": "strftime({0}, '%B %-d, %Y')",
        "money": "printf('%.2f', {0})",
        "isodate": "strftime({0}, '%Y-%m-%d')",
    },
}


def dialect(sql: str, name: str) -> str:
    return re.sub(
        r"\[\[(\w+):(\w+)\]\]", lambda m: _MACROS[name][m.group(1)].format(m.group(2)), sql
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """One of the derived tables. ``dealt`` spreads its rows over all cores: those of a single given table
    before they are derived, as the given columns are narrower than the texts built from them."""
    sql = dialect(VIEWS[name], "spark")
    used = {t: table(spark, sf_dir, t) for t in GIVEN if "{" + t + "}" in sql}
    if dealt and len(used) == 1:
        used = {t: spread(rows) for t, rows in used.items()}
    elif dealt:
        return spread(spark.sql(sql, **used))
    return spark.sql(sql, **used)


def check_sql(views: list[str], body: str) -> str:
    """A query of the checking engine with the derived tables as leading CTEs."""
    parts = []
    for name in views:
        text = dialect(VIEWS[name], "check")
        for t in GIVEN:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{name} AS ({text})")
    body = body.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE"):].lstrip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + body
