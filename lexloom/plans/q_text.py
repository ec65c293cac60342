"""Queries: text kernel, classification, entities, terms, jurisdictions, contradictions, rules."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions import text as tx
from lexloom.operators import (
    classify, conflicts, extract, jurisdiction, rules, sections, terms,
)
from lexloom.plans.registry import query
from lexloom.session import spread

# DuckDB's regular expressions know ASCII classes only; both engines see the letters below mapped to
# an ASCII letter where word borders matter.
_ASCII = "regexp_replace(text, '[\\x{00C0}-\\x{024F}]', 'q', 'g')"


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---- text kernel --------------------------------------------------------------------------------


@query(
    "X2", (),
    """SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest
       FROM documents""",
)
def collapsed_text(t):
    return t.documents.select("doc_id", F.sha2(tx.collapse("text"), 256).alias("digest"))


@query(
    "X4", (),
    """WITH d AS (SELECT doc_id, text, strpos(lower(text), 'token') AS p0 FROM documents)
       SELECT doc_id, trim(regexp_replace(substr(text, greatest(1, p0 - 100),
         p0 + 5 + 100 - greatest(1, p0 - 100)), '\\s+', ' ', 'g')) AS snippet
       FROM d WHERE p0 > 0""",
)
def snippets(t):
    rows = t.documents.select("doc_id", tx.snippet("text", F.lit("TOKEN")).alias("snippet"))
    return rows.where("snippet IS NOT NULL")


@query(
    "X5", (),
    """SELECT event_id,
         TRY_CAST(replace(regexp_extract(v, '[$€£¥]?\\s*([0-9,]+(?:\\.[0-9]{1,2})?)', 1), ',', '')
                  AS DOUBLE) AS currency,
         TRY_CAST(regexp_replace(v, '[^\\d.\\-]', '', 'g') AS DOUBLE) AS digits
       FROM (SELECT event_id, concat('Total: $ ', CAST(CAST(event_id AS BIGINT) * 7 + 1000 AS VARCHAR), ',',
         printf('%.2f', value)) AS v FROM events)""",
)
def parsed_amounts(t):
    v = F.concat(
        F.lit("Total: $ "), (F.col("event_id") * 7 + 1000).cast("string"), F.lit(","),
        F.format_string("%.2f", F.col("value")),
    )
    return t.events.select(
        "event_id", tx.currency_amount(v).alias("currency"), tx.digits_amount(v).alias("digits")
    )


_DATE_CASES = [
    ("strftime(o_orderdate, '%d/%m/%Y')", "date_format(o_orderdate, 'dd/MM/yyyy')"),
    ("strftime(o_orderdate, '%d-%m-%Y')", "date_format(o_orderdate, 'dd-MM-yyyy')"),
    ("strftime(o_orderdate, '%Y-%m-%d')", "date_format(o_orderdate, 'yyyy-MM-dd')"),
    ("strftime(o_orderdate, '%-d %B %Y')", "date_format(o_orderdate, 'd MMMM yyyy')"),
    ("strftime(o_orderdate, '%B %-d, %Y')", "date_format(o_orderdate, 'MMMM d, yyyy')"),
    ("strftime(o_orderdate, '%B %-d %Y')", "date_format(o_orderdate, 'MMMM d yyyy')"),
    ("upper(strftime(o_orderdate, '%b %-d, %Y'))", "upper(date_format(o_orderdate, 'MMM d, yyyy'))"),
    ("strftime(o_orderdate, '%d/%m/%y')", "date_format(o_orderdate, 'dd/MM/yy')"),
    ("'not a date'", "'not a date'"),
]


def _date_case(k: int) -> str:
    return "CASE o_custkey % 9 " + " ".join(
        f"WHEN {i} THEN {pair[k]}" for i, pair in enumerate(_DATE_CASES)
    ) + " END"


@query(
    "X6", (),
    f"""SELECT o_orderkey, {_date_case(0)} AS raw,
          CASE WHEN o_custkey % 9 < 8 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso
        FROM orders""",
)
def parsed_dates(t):
    raw = t.orders.select("o_orderkey", F.expr(_date_case(1)).alias("raw"))
    return raw.withColumn("iso", tx.iso_date("raw"))


@query(
    "X7", (),
    """SELECT p_partkey, 'v2' AS label, p_size + 1 AS size FROM (
       SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)""",
)
def set_nested_path(t):
    rows = t.part.select(
        "p_partkey",
        F.struct(
            F.struct(F.lit("v1").alias("label"), F.col("p_size").cast("long").alias("size")).alias("a")
        ).alias("s"),
    )
    changed = tx.set_path(
        tx.set_path(F.col("s"), "a.label", F.lit("v2")), "a.size", F.col("s.a.size") + 1
    )
    return rows.select("p_partkey", changed.alias("s")).select("p_partkey", "s.a.label", "s.a.size")


@query(
    "X7", (),
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, 'yes' AS flag
       FROM events""",
)
def set_payload_key(t):
    payload = F.from_json("props", "map<string,string>")
    changed = t.events.select(
        "event_id", tx.set_map_path(payload, "fields.flag", F.lit("yes")).alias("m")
    )
    return changed.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["fields.flag"].alias("flag"))


@query(
    "U3", (),
    """WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'),
           lambda x: x <> '')) AS v,
         generate_subscripts(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1)
           AS i FROM documents),
       f AS (SELECT doc_id, lower(v) AS k, min(i) AS i, arg_min(v, i) AS v FROM w GROUP BY 1, 2)
       SELECT doc_id, count(*) AS n, sha256(string_agg(v, ' ' ORDER BY i)) AS digest
       FROM f GROUP BY 1""",
)
def distinct_words(t):
    kept = tx.distinct_ignore_case(tx.words("text"))
    rows = t.documents.select("doc_id", kept.alias("w")).where(F.size("w") > 0)
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n"),
        F.sha2(F.array_join("w", " "), 256).alias("digest"),
    )


@query(
    "U4", (),
    """WITH a AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(text,
           '[a-zA-Z0-9]{3,}'), lambda x: lower(x))) AS s FROM conversations)
       SELECT a.conv_id, a.turn, CAST(len(list_intersect(a.s, b.s)) AS BIGINT) AS common
       FROM a JOIN a b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def turn_overlap(t):
    from lexloom.operators.evaluate import word_overlap

    a = t.conversations.select("conv_id", "turn", "text")
    b = t.conversations.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text")
    )
    return a.join(b, ["conv_id", "turn"]).select(
        "conv_id", "turn", word_overlap("text", "next_text").cast("long").alias("common")
    )


@query(
    "X3", (),
    """SELECT doc_id, coalesce(NULLIF(regexp_extract(text, 'token = "([a-f0-9]+)"|([a-z0-9.]+@[a-z0-9.]+)', 1), ''),
         NULLIF(regexp_extract(text, 'token = "([a-f0-9]+)"|([a-z0-9.]+@[a-z0-9.]+)', 2), '')) AS value
       FROM documents""",
)
def first_group_search(t):
    """The token or the mail address that comes first in each document."""
    pattern = r'token = "([a-f0-9]+)"|([a-z0-9.]+@[a-z0-9.]+)'
    return t.documents.select("doc_id", tx.search("text", pattern, 2, "Ud").alias("value"))


@query("X1")
def repaired_text(t):
    return t.spread("documents").select(
        "doc_id",
        tx.repair_scanned_text("text").alias("text"),
        tx.repair_scanned_text("text", "case_sensitive").alias("careful_text"),
    )


@query(
    "X1", (),
    """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id,
         concat('INVOICE Inv No: INV-', l_linenumber % 10, '023 Total ', CAST(l_quantity AS BIGINT),
                ' From A Account Period ') AS text
       FROM lineitem""",
)
def repaired_scans(t):
    """Scans with known damage: the repair must give back the clean line."""
    damaged = F.concat(
        F.lit("l N V 0 l C E lnv N0: INV-"), (F.col("l_linenumber") % 10).cast("string"),
        F.lit("O23 T0tal "), F.col("l_quantity").cast("long").cast("string"),
        F.lit(" Fr0m A Acc0unt Peri0d {name:str}"),
    )
    return t.spread("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        tx.repair_scanned_text(damaged).alias("text"),
    )


# ---- classification -----------------------------------------------------------------------------


def _kw_sql(label: str) -> str:
    return " + ".join(
        f"len(regexp_extract_all(t, {_sql_text(chr(92) + 'b' + re.escape(k).replace(chr(92) + ' ', ' ') + chr(92) + 'b')}))"
        for k in fv.KEYWORDS[label]
    )


def _pat_sql(label: str) -> str:
    return " + ".join(
        f"CASE WHEN regexp_matches(t, {_sql_text('(?i)' + p)}) THEN 0.5::DOUBLE ELSE 0::DOUBLE END"
        for p, _ in fv.PATTERNS[label]
    )


def _scores_sql(source: str, key: str) -> str:
    ln = repr(math.log(len(fv.KEYWORDS)))
    kw = ", ".join(
        f"CAST({_kw_sql(k)} AS DOUBLE) / CAST(greatest(n, 1) AS DOUBLE) * CAST({ln} AS DOUBLE) AS kw_{k}, "
        f"{_pat_sql(k)} AS pat_{k}"
        for k in fv.KEYWORDS
    )
    score = ", ".join(
        f"0.5::DOUBLE * kw_{k} + 0.3::DOUBLE * pat_{k} AS score_{k}" for k in fv.KEYWORDS
    )
    return f"""
      src AS (SELECT {key} AS id, lower({_ASCII}) AS t,
                len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS n
              FROM {source}),
      kw AS (SELECT *, {kw} FROM src),
      sc AS (SELECT *, {score} FROM kw),
      tot AS (SELECT *, {' + '.join(f'score_{k}' for k in fv.KEYWORDS)} AS total,
                greatest({', '.join(f'score_{k}' for k in fv.KEYWORDS)}) AS best FROM sc)"""


_WINNER = "CASE " + " ".join(f"WHEN score_{k} = best THEN '{k}'" for k in fv.KEYWORDS) + " END"
_CAPTION_SQL = " OR ".join(f"regexp_matches(t, {_sql_text(p)})" for p, _ in fv.COMPLAINT_CAPTION)
_BODY_SQL = " OR ".join(f"regexp_matches(t, {_sql_text(p)})" for p in fv.COMPLAINT_BODY)
_STRONG = f"""(kw_legal_complaint + pat_legal_complaint > 0.5 AND ({_CAPTION_SQL})
    AND (regexp_matches(t, {_sql_text(fv.COMPLAINT_ADVERSARIES)})
         OR (len(regexp_extract_all(t, 'plaintiff')) >= 2
             AND len(regexp_extract_all(t, 'defendant')) >= 2))
    AND regexp_matches(t, '\\bcomplaint\\b') AND ({_BODY_SQL}))"""


def _decision_sql(source: str, key: str) -> str:
    return f"""WITH {_scores_sql(source, key)}
      SELECT id, CASE WHEN total > 0 AND {_STRONG} THEN 'legal_complaint'
               WHEN total <= 0 OR best < 0.015 OR best / total < 0.40 THEN 'unknown'
               ELSE {_WINNER} END AS document_type,
             CASE WHEN total > 0 AND {_STRONG} THEN CAST(printf('%.4f', least(0.95::DOUBLE,
                    greatest(0.72::DOUBLE, score_legal_complaint / total + 0.45::DOUBLE))) AS DOUBLE)
               WHEN total <= 0 OR best < 0.015 OR best / total < 0.40 THEN 0.2::DOUBLE
               ELSE CAST(printf('%.4f', least(0.98::DOUBLE, greatest(0.25::DOUBLE,
                    best / total + 0.15::DOUBLE))) AS DOUBLE) END AS classifier_confidence
      FROM tot"""


@query("C4 C5", ("legal_texts",), _decision_sql("legal_texts", "document_id"))
def classified_legal_texts(t):
    rows = classify.classify(t.spread("legal_texts").select(F.col("document_id").alias("id"), "text"))
    return rows.drop("text")


@query("C4", (), _decision_sql("documents", "CAST(doc_id AS VARCHAR)"))
def classified_documents(t):
    rows = t.spread("documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return classify.classify(rows).drop("text")


@query(
    "C1 C2", ("legal_texts",),
    f"""WITH {_scores_sql('legal_texts', 'document_id')}
        SELECT id, {', '.join(f"CAST(printf('%.9f', kw_{k}) AS DOUBLE) AS kw_{k}, pat_{k}" for k in fv.KEYWORDS)}
        FROM tot""",
)
def type_scores(t):
    rows = classify.score_types(t.spread("legal_texts").select(F.col("document_id").alias("id"), "text"))
    return rows.select(
        "id",
        *[tx.round_even(f"kw_{k}", 9).alias(f"kw_{k}") for k in fv.KEYWORDS],
        *[f"pat_{k}" for k in fv.KEYWORDS],
    )


@query(
    "C5", ("legal_texts",),
    """SELECT document_id, o_orderpriority = '1-URGENT' AS strong FROM legal_texts""",
)
def strong_complaints(t):
    scored = classify.score_types(t.spread("legal_texts").select("document_id", "text"))
    strong = classify.strong_complaint(
        F.col("_lower"), F.col("kw_legal_complaint"), F.col("pat_legal_complaint")
    )
    return scored.select("document_id", strong.alias("strong"))


@query("C3 C4")
def classified_with_near_matches(t):
    rows = classify.classify(t.spread("legal_texts").select("document_id", "text"), fuzzy=True)
    return rows.drop("text")


# ---- entities -----------------------------------------------------------------------------------


def _entity_sql(label: str, pattern: str, confidence: float) -> str:
    found = f"regexp_extract_all(t, {_sql_text(pattern)})"
    return f"""SELECT doc_id, '{label}' AS label, unnest({found}) AS entity,
        CAST(generate_subscripts({found}, 1) - 1 AS BIGINT) AS position,
        {confidence}::DOUBLE AS confidence FROM d"""


@query(
    "E5 E11", (),
    f"WITH d AS (SELECT doc_id, {_ASCII} AS t FROM documents) "
    + " UNION ALL ".join(
        [
            _entity_sql("ACCOUNT_OR_ID", fv.ENTITY_NUMBER, 0.7),
            _entity_sql("AMOUNT", fv.ENTITY_AMOUNT, 0.7),
            _entity_sql("DATE", "(?i)" + fv.ENTITY_DATE, 0.8),
        ]
    ),
)
def pattern_entities(t):
    rows = extract.pattern_entities(t.documents, ["doc_id"])
    return rows.withColumn("position", F.col("position").cast("long"))


# ---- terms --------------------------------------------------------------------------------------

_TERM_VIEW = """
    SELECT CAST(o_orderkey AS STRING) AS document_id, o_custkey, c_nationkey, o_orderstatus,
      concat('As used herein, "Goods" means steel items of lot ', o_custkey,
        '. The term "Fee" shall have the meaning set forth in Schedule ', c_nationkey,
        '; this deed is made by Firm ', c_nationkey, ' (the "Seller") and Shop ', o_custkey,
        ' (the "Buyer"). The Goods and the Fee are due. "Goods" means items of class ',
        o_orderstatus, ' only. The Buyer pays.') AS text
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""


def _term_texts(t):
    from lexloom.plans.tables import dialect, table

    return spread(
        t.spark.sql(
            dialect(_TERM_VIEW, "spark"),
            orders=table(t.spark, t.sf_dir, "orders"),
            customer=table(t.spark, t.sf_dir, "customer"),
        )
    )


_TERM_SQL = _TERM_VIEW.replace("{orders}", "orders").replace("{customer}", "customer")
_TERMS_EXPECTED = """
    SELECT document_id, 'Goods' AS term, concat('items of class ', o_orderstatus, ' only') AS definition FROM tt
    UNION ALL SELECT document_id, 'Fee', concat('Schedule ', c_nationkey) FROM tt
    UNION ALL SELECT document_id, 'Seller', concat('Firm ', c_nationkey) FROM tt
    UNION ALL SELECT document_id, 'Buyer', concat('Shop ', o_custkey) FROM tt"""


@query("T1", (), f"WITH tt AS ({_TERM_SQL}) {_TERMS_EXPECTED}")
def defined_terms(t):
    return terms.term_rows(terms.defined_terms(_term_texts(t)), "document_id")


@query(
    "T2", (),
    f"""WITH tt AS ({_TERM_SQL}), d AS (SELECT *, concat('Firm ', c_nationkey) AS seller,
          concat('Shop ', o_custkey) AS buyer FROM tt)
        SELECT document_id, concat('As used herein, "Goods" means steel items of lot ', o_custkey,
        '. The term "Fee" shall have the meaning set forth in Schedule ', c_nationkey,
        '; this deed is made by Firm ', c_nationkey, ' (the "Seller") and Shop ', o_custkey,
        ' (the "Buyer"). The Goods [items of class ', o_orderstatus, ' only] and the Fee [Schedule ',
        c_nationkey, '] are due. "Goods" means items of class ', o_orderstatus,
        ' only. The Buyer [', buyer, '] pays.') AS text FROM d""",
)
def annotated_text(t):
    rows = terms.defined_terms(_term_texts(t))
    return rows.select("document_id", terms.annotate("text", "defined_terms").alias("text"))


@query(
    "T3", (),
    f"""WITH tt AS ({_TERM_SQL}), e AS ({_TERMS_EXPECTED})
        SELECT document_id, concat({_sql_text(fv.TERMS_HEADING)}, chr(10),
          string_agg(concat('- "', term, '" = ', definition), chr(10) ORDER BY lower(term)), chr(10),
          {_sql_text(fv.TERMS_FOOTER)}) AS block FROM e GROUP BY 1""",
)
def terms_block(t):
    rows = terms.defined_terms(_term_texts(t))
    return rows.select("document_id", terms.terms_block("defined_terms").alias("block"))


@query(
    "T7", (),
    f"""WITH tt AS ({_TERM_SQL}), e AS ({_TERMS_EXPECTED})
        SELECT e.document_id, term, substr(text, greatest(1, strpos(lower(text), lower(term)) - 250),
          strpos(lower(text), lower(term)) + length(term) + 250
            - greatest(1, strpos(lower(text), lower(term)) - 250)) AS context
        FROM e JOIN tt ON e.document_id = tt.document_id""",
)
def term_contexts(t):
    rows = terms.defined_terms(_term_texts(t)).select(
        "document_id", "text", F.inline("defined_terms")
    )
    return rows.select("document_id", "term", terms.term_context("text", "term").alias("context"))


@query(
    "T7", (),
    f"""WITH tt AS ({_TERM_SQL}), e AS ({_TERMS_EXPECTED}),
          r AS (SELECT CAST(l_orderkey AS VARCHAR) AS document_id,
                  concat('Part ', max(l_partkey)) AS term, 'a listed part' AS definition
                FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
        SELECT document_id, term, definition FROM e
        WHERE document_id NOT IN (SELECT document_id FROM r)
        UNION ALL SELECT document_id, term, definition FROM r""",
)
def confirmed_terms(t):
    candidates = terms.term_rows(terms.defined_terms(_term_texts(t)), "document_id")
    replies = (
        t.lineitem.where("l_quantity > 45")
        .groupBy(F.col("l_orderkey").cast("string").alias("document_id"))
        .agg(F.max("l_partkey").alias("p"))
        .select(
            "document_id",
            F.concat(F.lit(' "Part '), F.col("p").cast("string"), F.lit('". ')).alias("term"),
            F.lit("a  listed part;").alias("definition"),
        )
    )
    return terms.confirm_terms(candidates, replies, "document_id")


# ---- jurisdictions ------------------------------------------------------------------------------

_LAW_VIEW = """
    SELECT CAST(o_orderkey AS STRING) AS document_id, o_custkey % 4 AS a, c_nationkey % 5 AS b,
      concat(CASE o_custkey % 4 WHEN 0 THEN 'Under 42 U.S.C. 1983 ' WHEN 1 THEN 'Filed in E.D. Wis. '
        WHEN 2 THEN 'See M.D. Fla. ' ELSE 'No federal text here ' END,
        CASE c_nationkey % 5 WHEN 0 THEN 'and Wis. Stat. 100.18' WHEN 1 THEN 'and the State of Ohio, too'
        WHEN 2 THEN 'and Cal. Civ. Code 17' WHEN 3 THEN 'and State of New York and the courts'
        ELSE 'and nothing else' END, '.') AS text
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
_LAW_SQL = _LAW_VIEW.replace("{orders}", "orders").replace("{customer}", "customer")
_FED = ["federal", "federal:EDWI,federal", "federal:DFL,federal", ""]
_STATES = ["state:WI", "state:OH", "state:CA", "", ""]


def _case(column: str, values: list[str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _law_texts(t):
    from lexloom.plans.tables import table

    return t.spark.sql(
        _LAW_VIEW,
        orders=table(t.spark, t.sf_dir, "orders"),
        customer=table(t.spark, t.sf_dir, "customer"),
    )


@query(
    "T4", (),
    f"""WITH l AS ({_LAW_SQL})
        SELECT document_id, concat_ws(',', NULLIF({_case('a', _FED)}, ''),
          NULLIF({_case('b', _STATES)}, '')) AS tags FROM l""",
)
def jurisdiction_tags(t):
    return _law_texts(t).select(
        "document_id", F.array_join(jurisdiction.jurisdiction_tags("text"), ",").alias("tags")
    )


@query(
    "T5", (),
    f"""WITH l AS ({_LAW_SQL})
        SELECT document_id, CASE a WHEN 1 THEN 'federal:EDWI' WHEN 2 THEN 'federal:DFL'
          ELSE coalesce(NULLIF({_case('b', _STATES)}, ''), CASE a WHEN 0 THEN 'federal' END) END AS tag
        FROM l""",
)
def primary_tags(t):
    rows = _law_texts(t).withColumn("tags", jurisdiction.jurisdiction_tags("text"))
    return rows.select("document_id", jurisdiction.primary_tag("tags").alias("tag"))


@query(
    "T6", (),
    f"""WITH l AS ({_LAW_SQL}), s AS (SELECT *, NULLIF({_case('b', _STATES)}, '') AS st FROM l)
        SELECT document_id, concat_ws(',', NULLIF({_case('a', _FED)}, ''), st,
          CASE WHEN coalesce(st, '') <> 'state:OH' AND a < 3 THEN 'state:OH' END,
          CASE WHEN a = 3 THEN 'state:TX' END) AS tags FROM s""",
)
def document_tags(t):
    law = F.when(F.col("a") < 3, F.lit("State of Ohio"))
    court = F.when(F.col("a") == 3, F.lit("District of state of Texas"))
    return _law_texts(t).select(
        "document_id",
        F.array_join(jurisdiction.document_tags("text", law, court), ",").alias("tags"),
    )


# ---- contradictions -----------------------------------------------------------------------------

_SEEN = """
  seen AS (SELECT document_id, kind, label, value, min(chunk_index) AS first FROM (
      SELECT document_id, 'governing_law' AS kind, '' AS label, lower(state) AS value, chunk_index
        FROM contract_lines
      UNION ALL SELECT document_id, 'defined_term', 'service level', meaning, chunk_index
        FROM contract_lines
      UNION ALL SELECT document_id, 'date', 'effective date', start_date, chunk_index
        FROM contract_lines
      UNION ALL SELECT document_id, 'amount', 'monthly fee', fee, chunk_index FROM contract_lines
      {seeds}) GROUP BY 1, 2, 3, 4),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id, kind ORDER BY first, value) AS r,
      count(*) OVER (PARTITION BY document_id, kind) AS n FROM seen),
  idx AS (SELECT document_id, string_agg(DISTINCT chunk_index, ',' ORDER BY chunk_index)
      AS chunk_indices FROM contract_lines GROUP BY 1),
  conf AS (SELECT ranked.document_id, kind AS conflict_type,
      CASE kind
        WHEN 'governing_law' THEN concat('Conflicting governing law references: ',
          string_agg(concat('"', value, '"'), ', ' ORDER BY r) FILTER (r <= 4), '.')
        WHEN 'defined_term' THEN '"service level" has conflicting definitions across sections.'
        WHEN 'date' THEN concat('Inconsistent "effective date": ',
          string_agg(value, ' vs. ' ORDER BY r) FILTER (r <= 3), '.')
        ELSE concat('Inconsistent "monthly fee": $',
          string_agg(value, ' vs. $' ORDER BY r) FILTER (r <= 3), '.') END AS description,
      any_value(chunk_indices) AS chunk_indices,
      CASE WHEN kind IN ('governing_law', 'amount') THEN 'high' ELSE 'medium' END AS severity,
      CASE WHEN kind <> 'defined_term' THEN kind END AS field,
      string_agg(value, ' || ' ORDER BY r) AS all_values
    FROM ranked JOIN idx ON ranked.document_id = idx.document_id WHERE n >= 2
    GROUP BY ranked.document_id, kind)"""
_SEED_ROWS = """UNION ALL SELECT document_id, 'defined_term', 'service level', definition, -1
        FROM seed_terms"""


def _conflict_check(kind: str, seeds: str = "") -> str:
    return (
        "WITH " + _SEEN.format(seeds=seeds)
        + f" SELECT document_id, description, chunk_indices, severity, field, all_values FROM conf WHERE conflict_type = '{kind}'"
    )


def _conflicts_of(t, kind: str, seeds=None):
    rows = conflicts.find_conflicts(t.spread("contract_lines"), terms=seeds, kinds=[kind])
    joined = F.array_join(F.transform("chunk_indices", lambda i: i.cast("string")), ",")
    return rows.select(
        "document_id", "description", joined.alias("chunk_indices"), "severity", "field",
        F.array_join("values", " || ").alias("all_values"),
    )


@query("A8", ("contract_lines",), _conflict_check("governing_law"))
def governing_law_conflicts(t):
    return _conflicts_of(t, "governing_law")


@query("A9", ("contract_lines", "seed_terms"), _conflict_check("defined_term", _SEED_ROWS))
def defined_term_conflicts(t):
    return _conflicts_of(t, "defined_term", t.seed_terms)


@query("A10", ("contract_lines",), _conflict_check("date"))
def date_conflicts(t):
    return _conflicts_of(t, "date")


@query("A11", ("contract_lines",), _conflict_check("amount"))
def amount_conflicts(t):
    return _conflicts_of(t, "amount")


_ORDER = (
    "CASE conflict_type WHEN 'governing_law' THEN 1 WHEN 'defined_term' THEN 2 "
    "WHEN 'date' THEN 3 ELSE 4 END"
)


@query(
    "A12", ("contract_lines",),
    "WITH " + _SEEN.format(seeds="")
    + f""" SELECT document_id, count(*) AS conflict_count,
             bool_or(severity = 'high') AS has_high_severity,
             string_agg(description, ' | ' ORDER BY {_ORDER}) AS items FROM conf GROUP BY 1""",
)
def conflict_report(t):
    report = conflicts.conflict_report(conflicts.find_conflicts(t.spread("contract_lines")))
    return report.withColumn(
        "items", F.array_join(F.transform("items", lambda i: i["description"]), " | ")
    )


@query(
    "R7", ("contract_lines",),
    "WITH " + _SEEN.format(seeds="")
    + """ SELECT document_id, conflict_type, description FROM conf
          WHERE document_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders
                                    WHERE o_orderstatus = 'F')
          UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'date', 'kept from the last run'
          FROM orders WHERE o_orderstatus = 'F'""",
)
def conflicts_with_cache(t):
    item = F.struct(
        F.lit("date").alias("conflict_type"), F.lit("kept from the last run").alias("description"),
        F.array().cast("array<int>").alias("chunk_indices"), F.lit("medium").alias("severity"),
        F.lit("date").alias("field"),
    )
    reports = t.orders.select(
        F.col("o_orderkey").cast("string").alias("document_id"),
        F.when(F.col("o_orderstatus") == "F", F.array(item)).alias("conflicts"),
    )
    rows = conflicts.report_with_cache(reports, t.spread("contract_lines"))
    return rows.select("document_id", "conflict_type", "description")


@query(
    "T3", ("contract_lines",),
    "WITH " + _SEEN.format(seeds="")
    + f""" SELECT document_id, concat({_sql_text(fv.CONFLICTS_HEADING)}, chr(10),
             {_sql_text(fv.CONFLICTS_NOTE)}, chr(10), string_agg(concat('  [', upper(severity), '] ',
               upper(conflict_type), ': ', description), chr(10) ORDER BY {_ORDER})) AS block
           FROM conf GROUP BY 1""",
)
def conflicts_block(t):
    report = conflicts.conflict_report(conflicts.find_conflicts(t.spread("contract_lines")))
    return report.select("document_id", conflicts.conflicts_block(F.col("items")).alias("block"))


# ---- line rules ---------------------------------------------------------------------------------


def _rule_sql(rule: tuple) -> str:
    severity, issue, patterns, exempt, fix, frameworks, urgency = rule
    hit = " OR ".join(f"regexp_matches(line, {_sql_text(p)})" for p in patterns)
    skip = "".join(f" AND NOT contains(line, '{e}')" for e in exempt)
    return (
        f"SELECT doc_id, line_no, '{severity}' AS severity, {_sql_text(issue)} AS issue, {_sql_text(fix)} AS suggested_fix, "
        f"'{', '.join(frameworks)}' AS frameworks, '{urgency}' AS urgency FROM l "
        f"WHERE ({hit}){skip}"
    )


_CHECKABLE_RULES = [r for r in [*fv.LINE_RULES, fv.UNQUOTED_SECRET_RULE] if "(?=" not in r[2][0]]
_ALG_SQL = (
    f"SELECT doc_id, line_no, 'CRITICAL', {_sql_text(fv.LINE_RULES[1][1])}, {_sql_text(fv.LINE_RULES[1][4])}, "
    f"'{', '.join(fv.LINE_RULES[1][5])}', 'before-merge' FROM l "
    "WHERE contains(lower(line), 'alg') AND contains(lower(line), 'none') "
    "AND (contains(lower(line), 'jwt') OR contains(lower(line), 'algorithm'))"
)


@query(
    "F9", (),
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no
         FROM documents) """
    + " UNION ".join([*[_rule_sql(r) for r in _CHECKABLE_RULES], _ALG_SQL]),
)
def line_rule_findings(t):
    found = rules.scan_lines(t.documents, "doc_id", rules=[*fv.LINE_RULES, fv.UNQUOTED_SECRET_RULE])
    return found.withColumn("line_no", F.col("line_no").cast("long")).withColumn("frameworks", F.array_join("frameworks", ", "))


# ---- sections -----------------------------------------------------------------------------------

_HEADER_SQL = f"""
  ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  st AS (SELECT doc_id, i, length(line) AS size,
           regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM ln),
  hd AS (SELECT *, NULLIF(CASE
       WHEN regexp_extract(s, {_sql_text('(?i)' + fv.NUMBERED_HEADER)}, 1) <> ''
         THEN trim(regexp_extract(s, {_sql_text('(?i)' + fv.NUMBERED_HEADER)}, 1), ' .')
       WHEN regexp_matches(s, {_sql_text('(?i)' + fv.NAMED_HEADER)}) THEN s
       WHEN length(s) < 60 AND upper(s) = s AND regexp_matches(s, '[A-Z]{{4,}}') THEN trim(s, ' .')
       END, '') AS header FROM st)"""


@query(
    "R1", (),
    f"""WITH {_HEADER_SQL} SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, header FROM hd
        WHERE header IS NOT NULL""",
)
def section_headers(t):
    lines = sections.text_lines(t.documents, "doc_id")
    rows = lines.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"),
        sections.header_text(F.col("line")).alias("header"),
    )
    return rows.where("header IS NOT NULL")


@query(
    "W6", (),
    f"""WITH {_HEADER_SQL},
      pos AS (SELECT *, CAST(coalesce(sum(size + 1) OVER (PARTITION BY doc_id ORDER BY i
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM hd),
      cuts AS (SELECT doc_id, start AS char_start, header FROM pos WHERE header IS NOT NULL
               UNION SELECT doc_id, 0, NULL FROM documents WHERE doc_id NOT IN
                 (SELECT doc_id FROM pos WHERE header IS NOT NULL AND start = 0)),
      spans AS (SELECT c.doc_id, header, char_start, CAST(coalesce(lead(char_start) OVER
                (PARTITION BY c.doc_id ORDER BY char_start), length(text)) AS BIGINT) AS char_end,
                text FROM cuts c JOIN documents d ON c.doc_id = d.doc_id)
      SELECT doc_id, header, char_start, char_end FROM spans
      WHERE regexp_replace(substr(text, char_start + 1, char_end - char_start), '\\s', '', 'g') <> ''""",
)
def section_spans(t):
    rows = sections.section_spans(t.documents, "doc_id")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("char_start", "char_end")})


# ---- extraction ---------------------------------------------------------------------------------

_FIELD_VALUES = {
    "contract": ("o_orderpriority = '3-MEDIUM'", {
        "effective_date": "signed_on",
        "party_a": "concat('Buyer ', o_custkey)",
        "party_b": "concat('Seller ', c_nationkey)",
        "governing_law": "state",
        "termination_date": "NULL",
        "contract_value": "concat('$', amount)",
        "parties": "[concat('Buyer ', o_custkey, ' and Seller ', c_nationkey)]",
        "confidentiality_clause": "'Confidential data stay with the parties'",
        "indemnification": "NULL",
        "signatures": "[concat('Signer ', o_custkey)]",
    }),
    "legal_notice": ("o_orderpriority = '2-HIGH'", {
        "notice_type": "'CEASE AND DESIST'",
        "issuing_party": "concat('Firm ', c_nationkey)",
        "receiving_party": (
            "CASE WHEN signed_on LIKE 'October%' THEN substr(signed_on, 5) "
            "ELSE concat('p the sale of lot ', o_custkey) END"
        ),
        "issue_date": "signed_on",
        "response_deadline": "signed_on",
        "jurisdiction": "NULL",
        "required_actions": "[concat('stop the sale of lot ', o_custkey)]",
    }),
    "affidavit": ("o_orderpriority = '5-LOW'", {
        "declarant_name": "concat('Person ', o_custkey)",
        "declarant_role": "concat('Clerk ', c_nationkey)",
        "notary_name": "concat('Notary ', c_nationkey)",
        "notary_jurisdiction": "state_line",
        "execution_date": "signed_on",
        "statement_summary": "NULL",
    }),
    "legal_complaint": ("o_orderpriority = '1-URGENT'", {
        "case_number": "concat(c_nationkey, '-', o_custkey)",
        "filing_date": "signed_on",
        "causes_of_action": "[concat('I breach of duty ', o_custkey), 'II unjust gain']",
        "claims": "[concat('I breach of duty ', o_custkey), 'II unjust gain']",
        "jurisdiction": "'28 U.S.C. § 1331'",
        "venue": "'28 U.S.C. § 1391'",
        "defendants": "['BETA HOLDINGS']",
        "statutes": "['28 U.S.C. § 1331', '28 U.S.C. § 1391']",
        "jury_demand": "'true'",
        "case_caption": "rtrim(split_part(text, chr(10), 3), '.')",
        "court": "'UNITED STATES DISTRICT COURT'",
        "plaintiffs": "[split_part(split_part(text, chr(10), 3), ',', 1)]",
        "relief_sought": "[]",
    }),
    "unknown": ("o_orderpriority = '4-NOT SPECIFIED'", {
        "inferred_document_type": "NULL",
        "summary": "NULL",
        "key_parties": "[]",
        "important_dates": "[signed_on]",
    }),
}


def _expected_fields(kind: str) -> str:
    where, values = _FIELD_VALUES[kind]
    parts = []
    for name, expr in values.items():
        listed = expr.startswith("[")
        value = "CAST(NULL AS VARCHAR)" if listed or expr == "NULL" else f"CAST({expr} AS VARCHAR)"
        joined = f"array_to_string(CAST({expr} AS VARCHAR[]), '; ')" if listed else "''"
        parts.append(
            f"SELECT document_id, '{name}' AS name, {value} AS value, {joined} AS items "
            f"FROM x WHERE {where}"
        )
    return " UNION ALL ".join(parts)


_LEGAL_X = (
    "WITH x AS (SELECT *, state AS state_line FROM legal_texts) "
)


def _extracted(t, kinds: list[str], names: dict[str, list[str]] | None = None):
    kind = (
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "contract")
        .when(F.col("o_orderpriority") == "2-HIGH", "legal_notice")
        .when(F.col("o_orderpriority") == "5-LOW", "affidavit")
        .when(F.col("o_orderpriority") == "1-URGENT", "legal_complaint")
        .otherwise("memo")
    )
    typed = t.spread("legal_texts").withColumn("document_type", kind)
    typed = typed.where(extract.schema_for(F.col("document_type")).isin(*kinds))
    rows = extract.field_rows(extract.extract_fields(typed), ["document_id", "document_type"])
    shown = [n for k in kinds for n in _FIELD_VALUES[k][1]]
    return rows.where(F.col("name").isin(*shown)).select(
        "document_id", "name", "value", F.array_join("values", "; ").alias("items")
    )


@query("E1 E2 E12", ("legal_texts",), _LEGAL_X + _expected_fields("contract"))
def contract_schema_fields(t):
    return _extracted(t, ["contract"])


@query("E1 E2 E12", ("legal_texts",), _LEGAL_X + _expected_fields("legal_notice"))
def notice_schema_fields(t):
    return _extracted(t, ["legal_notice"])


@query("E1 E2 E12", ("legal_texts",), _LEGAL_X + _expected_fields("affidavit"))
def affidavit_schema_fields(t):
    return _extracted(t, ["affidavit"])


@query("E1 E2 E12", ("legal_texts",), _LEGAL_X + _expected_fields("legal_complaint"))
def complaint_schema_fields(t):
    return _extracted(t, ["legal_complaint"])


@query("E1 E12", ("legal_texts",), _LEGAL_X + _expected_fields("unknown"))
def unknown_schema_fields(t):
    return _extracted(t, ["unknown"])


_BRIEF_VALUES = {
    "case_name": "concat('Brand ', p_size, ' v. Maker')",
    "case_number": "concat(p_size, '-', p_partkey)",
    "court": "concat('Maker Court: Court of Lot ', p_size)",
    "jurisdiction": "NULL",
    "legal_issues": "['s: Whether the sale was void?']",
    "holding": "concat('The sale of lot ', p_partkey, ' was void')",
    "cited_statutes": "[concat('42 U.S.C. § ', p_size)]",
}


@query(
    "E1 E2 E12", (),
    " UNION ALL ".join(
        f"SELECT CAST(p_partkey AS VARCHAR) AS document_id, '{name}' AS name, "
        + (f"CAST(NULL AS VARCHAR) AS value, array_to_string({expr}, '; ') AS items" if expr[0] == "[" else f"CAST({expr} AS VARCHAR) AS value, '' AS items")
        + " FROM part"
        for name, expr in _BRIEF_VALUES.items()
    ),
)
def brief_schema_fields(t):
    """All fields of case briefs, one brief for each part."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("Case name: Brand "), size, F.lit(" v. Maker\nCourt: Court of Lot "), size, F.lit("\nDocket no. "), size, F.lit("-"), key,
        F.lit("\nFiled: March 3, 2020\nLegal issues: Whether the sale was void? Whether notice was given?\n\nHolding: The sale of lot "),
        key, F.lit(" was void.\n\nUnder 42 U.S.C. § "), size, F.lit("\n"),
    )
    briefs = t.part.select(key.alias("document_id"), F.lit("case_brief").alias("document_type"), text.alias("text"))
    rows = extract.field_rows(extract.extract_fields(briefs), ["document_id", "document_type"])
    return rows.select("document_id", "name", "value", F.array_join("values", "; ").alias("items"))
