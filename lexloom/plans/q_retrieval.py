"""Queries: words, chunks, embeddings, retrieval, gold matching, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions import hashing
from lexloom.functions.text import round_even
from lexloom.operators import chunks, evaluate, retrieve, sections, terms, words
from lexloom.plans.registry import query
from lexloom.session import cut_lineage, shared_folder, spread

# ---- words of a scan ----------------------------------------------------------------------------


def _words(t):
    tokens = t.documents.select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("word_idx", "text"))
    return tokens.select(
        "doc_id",
        (F.floor(F.col("word_idx") / 200) + 1).alias("page_number"),
        "word_idx",
        "text",
        # as an engine gives it: below zero for what it could not read
        words.scale_confidence((F.col("word_idx") * 7 % 130 - 1) / 128, "fraction").alias("confidence"),
    )


_WORDS_SQL = """
  tok AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w,
            generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) - 1 AS i FROM documents),
  wd AS (SELECT doc_id, i // 200 + 1 AS page, i, w, greatest(CAST(0 AS DOUBLE), CAST(i * 7 % 130 - 1 AS DOUBLE) / 128) AS c
         FROM tok WHERE w <> ''),
  pg AS (SELECT doc_id, page, string_agg(w, ' ' ORDER BY i) AS text, sum(c) AS s, count(*) AS n
         FROM wd GROUP BY 1, 2),
  dc AS (SELECT doc_id, string_agg(text, chr(12) ORDER BY page) AS text,
           sum(s) / CAST(sum(n) AS DOUBLE) AS avg, CAST(sum(n) AS BIGINT) AS n, count(*) AS pages
         FROM pg GROUP BY 1)"""


@query(
    "S7", (),
    f"""WITH {_WORDS_SQL} SELECT doc_id, page AS page_number, sha256(text) AS digest,
          s / CAST(n AS DOUBLE) AS confidence FROM pg""",
)
def page_texts(t):
    pages = words.page_texts(_words(t))
    return pages.select(
        "doc_id", "page_number", F.sha2("text", 256).alias("digest"), "confidence"
    )


@query(
    "S7", (),
    f"""WITH {_WORDS_SQL} SELECT doc_id, sha256(text) AS digest, avg AS average_confidence,
          n AS word_count, pages FROM dc""",
)
def document_texts(t):
    rows = words.document_texts(words.page_texts(_words(t)))
    return rows.select(
        "doc_id", F.sha2("text", 256).alias("digest"), "average_confidence", "word_count", "pages"
    )


@query(
    "S8", (),
    f"""WITH {_WORDS_SQL}
        SELECT d.doc_id, coalesce(avg < 0.5::DOUBLE, false) AS rerouted,
          sha256(CASE WHEN avg < 0.5::DOUBLE THEN concat('second reading: ', dc.text) ELSE coalesce(dc.text, '') END) AS digest,
          coalesce(avg, 0::DOUBLE) AS average_confidence
        FROM documents d LEFT JOIN dc ON d.doc_id = dc.doc_id""",
)
def rerouted_scans(t):
    first = words.document_texts(words.page_texts(_words(t)))
    second = first.withColumn("text", F.concat(F.lit("second reading: "), "text"))
    rows = words.route_low_confidence(t.documents, first, second, threshold=0.5)
    return rows.select(
        "doc_id", "rerouted", F.sha2("text", 256).alias("digest"), "average_confidence"
    )


# ---- chunks -------------------------------------------------------------------------------------


@query("R2 R3")
def document_chunks(t):
    return chunks.chunk_documents(t.spread("documents"))


@query(
    "R2", (),
    """SELECT doc_id, CAST(0 AS BIGINT) AS first_start, CAST(length(text) AS BIGINT) AS last_end,
         true AS dense, true AS joined, true AS bounded FROM documents
       WHERE regexp_replace(text, '\\s', '', 'g') <> ''""",
)
def chunk_coverage(t):
    """What must hold for every document: chunks cover the text without gaps, in dense order, and
    none is longer than the window with its look-ahead."""
    from pyspark.sql import Window

    rows = chunks.chunk_documents(t.spread("documents"))
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    after = F.lead("char_start").over(order)
    seen = rows.withColumn("ok", F.coalesce(after <= F.col("char_end"), F.lit(True)))
    return seen.groupBy(F.col("document_id").alias("doc_id")).agg(
        F.min("char_start").cast("long").alias("first_start"),
        F.max("char_end").cast("long").alias("last_end"),
        (F.max("chunk_index") + 1 == F.count("*")).alias("dense"),
        F.bool_and("ok").alias("joined"),
        (F.max(F.col("char_end") - F.col("char_start")) <= fv.CHUNK_SIZE + 160).alias("bounded"),
    )


@query("R2 R4 R6")
def embedded_documents(t):
    docs = t.spread("documents").select("doc_id", "text")
    with_terms = terms.defined_terms(docs, "text", "terms")
    rows = chunks.embed_documents(with_terms, terms="terms")
    return rows.select(
        "chunk_id", "document_id", "chunk_index", "page_number", "section_header", "jurisdiction",
        "char_start", "char_end", "norm2", F.size("vec").alias("dimensions"),
    )


@query(
    "R6 T2 T4", (),
    """SELECT CAST(l_orderkey AS VARCHAR) AS document_id, l_linenumber::BIGINT AS chunk_index,
         concat('"Service" means repair of part ', l_partkey, '. The Service [repair of part ',
           l_partkey, '] ends under Wis. Stat. 100.') AS text,
         'state:WI' AS jurisdiction FROM lineitem""",
)
def annotated_chunks(t):
    """Stored text is annotated, the tag comes from the raw text."""
    raw = F.concat(
        F.lit('"Service" means repair of part '), F.col("l_partkey").cast("string"),
        F.lit(". The Service ends under Wis. Stat. 100."),
    )
    docs = spread(
        t.lineitem.select(
            F.col("l_orderkey").cast("string").alias("document_id"),
            F.col("l_linenumber").cast("long").alias("no"),
            raw.alias("text"),
        )
    )
    rows = chunks.embed_documents(
        terms.defined_terms(docs, "text", "terms").withColumn(
            "key", F.struct("document_id", "no")
        ),
        doc="key", terms="terms",
    )
    return rows.select(
        "document_id.document_id", F.col("document_id.no").alias("chunk_index"), "text", "jurisdiction"
    )


@query(
    "S9", (),
    """WITH c AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
          unnest(string_split(text, chr(10))) AS line, lang FROM documents)
        SELECT doc_id, line_no::BIGINT AS line_no,
          CASE WHEN lang = 'en' THEN concat('new: ', line) ELSE line END AS line FROM c""",
)
def replaced_chunks(t):
    """English documents are embedded anew; the other documents keep their chunks."""
    old = sections.text_lines(t.documents, "doc_id")
    new = sections.text_lines(t.documents.where("lang = 'en'"), "doc_id").withColumn(
        "line", F.concat(F.lit("new: "), "line")
    )
    rows = chunks.replace_chunks(old, new, "doc_id")
    return rows.withColumn("line_no", F.col("line_no").cast("long"))


# ---- hash embedding -----------------------------------------------------------------------------


def _weights_sql(source: str, key: str, text: str, name: str) -> str:
    """Sparse weights of a text, computed from digests."""
    return f"""
  {name}_tok AS (SELECT {key} AS id, unnest(list_filter(regexp_split_to_array(lower({text}), '\\s+'),
      lambda x: x <> '')) AS token FROM {source}),
  {name}_dig AS (SELECT token, sha256(token) AS h FROM (SELECT DISTINCT token FROM {name}_tok)),
  {name}_dim AS (SELECT token, CAST(concat('0x', substr(h, 1, 4)) AS INTEGER) % 768 AS dim,
      CASE WHEN CAST(concat('0x', substr(h, 5, 2)) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END AS sg FROM {name}_dig),
  {name} AS (SELECT id, dim, CAST(sum(sg) AS BIGINT) AS w FROM {name}_tok JOIN {name}_dim USING (token)
      GROUP BY 1, 2 HAVING sum(sg) <> 0),
  {name}_norm AS (SELECT id, CAST(sum(w * w) AS BIGINT) AS n2 FROM {name} GROUP BY 1)"""


_INSTRUCTED = f"concat('{fv.QUERY_INSTRUCTION}', text)"


@query(
    "R4", (),
    f"WITH {_weights_sql('documents', 'doc_id', 'text', 'v')} SELECT id AS doc_id, dim::BIGINT AS dim, w FROM v",
)
def hash_weights(t):
    rows = hashing.hash_weights(t.spread("documents"), "doc_id", "text")
    return rows.select("doc_id", F.col("dim").cast("long").alias("dim"), "w")


@query(
    "R4", (),
    f"WITH {_weights_sql('documents', 'doc_id', 'text', 'v')} SELECT id AS doc_id, dim::BIGINT AS dim, w FROM v",
)
def row_local_embedding(t):
    vec = hashing.sparse_embedding(F.col("text"))
    rows = t.spread("documents").select("doc_id", vec.alias("vec"))
    return rows.select("doc_id", F.inline("vec")).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.col("w").cast("long").alias("w")
    )


_LETTERS = "etaoinsh"


@query(
    "R5", (),
    f"""WITH n AS (SELECT doc_id, [{", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in _LETTERS)}] AS v
          FROM documents)
        SELECT doc_id, CAST(unnest(range(len(v))) AS BIGINT) AS position,
          CAST(CAST(unnest(list_transform(v, lambda x: x / CASE WHEN list_sum(list_transform(v, lambda y: y * y)) > 0
            THEN sqrt(list_sum(list_transform(v, lambda y: y * y))) ELSE 1::DOUBLE END)) AS FLOAT) AS DOUBLE) AS weight FROM n""",
)
def plugged_in_encoder(t):
    """The plug-in with a small stand-in model: letter counts, scaled to unit length."""

    def load():
        return lambda texts: [[float(x.count(c)) for c in _LETTERS] for x in texts]

    encode = hashing.encoder_udf(load)
    rows = t.spread("documents").select("doc_id", F.posexplode(encode(F.col("text"))).alias("position", "weight"))
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), F.col("weight").cast("double").alias("weight"))


# ---- retrieval ----------------------------------------------------------------------------------


def _whole_documents(t):
    return chunks.add_embedding(
        t.spread("documents").select(
            F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text"
        )
    )


def _benchmark_queries(t):
    rows = t.benchmark.select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    return retrieve.encode_queries(rows)


_CORPUS_SQL = (
    _weights_sql("documents", "CAST(doc_id AS VARCHAR)", "text", "c")
    + ","
    + _weights_sql("benchmark", "CAST(item_id AS VARCHAR)", _INSTRUCTED, "q")
    + """,
  dots AS (SELECT q.id AS query_id, c.id AS chunk_id, CAST(sum(c.w * q.w) AS BIGINT) AS dot
           FROM c JOIN q USING (dim) GROUP BY 1, 2),
  pairs AS (SELECT q.id AS query_id, d.chunk_id, q.n2 AS qn, d.n2 AS cn FROM q_norm q CROSS JOIN
     (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, coalesce(n2, 0) AS n2 FROM documents
      LEFT JOIN c_norm ON CAST(doc_id AS VARCHAR) = id) d),
  scored AS (SELECT p.query_id, p.chunk_id,
     CASE WHEN qn > 0 AND cn > 0 THEN CAST(coalesce(dot, 0) AS DOUBLE)
          / sqrt(CAST(cn AS DOUBLE) * CAST(qn AS DOUBLE)) ELSE 0::DOUBLE END AS score
     FROM pairs p LEFT JOIN dots d ON p.query_id = d.query_id AND p.chunk_id = d.chunk_id),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)
     AS BIGINT) AS rank FROM scored)"""
)


@query(
    "K5 J6 R8", (),
    f"WITH {_CORPUS_SQL} SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 10",
)
def corpus_top_k(t):
    best = retrieve.corpus_top_k(_whole_documents(t), _benchmark_queries(t), 10)
    return best.withColumn("rank", F.col("rank").cast("long"))


@query(
    "K5 J6 R8", (),
    "WITH "
    + _CORPUS_SQL.replace("FROM q_norm q CROSS", "FROM (SELECT id, n2 FROM q_norm UNION ALL SELECT 'empty', 0) q CROSS")
    + " SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 10",
)
def corpus_top_k_in_blocks(t):
    """Three blocks of queries or more, and one query without any word."""
    asked = _benchmark_queries(t).select("query_id", "qvec", "qnorm2")
    empty = t.benchmark.limit(1).select(
        F.lit("empty").alias("query_id"), F.slice(F.lit(None).cast(asked.schema["qvec"].dataType), 1, 1).alias("qvec"), F.lit(0).alias("qnorm2")
    )
    best = retrieve.corpus_top_k(_whole_documents(t), asked.unionByName(empty), 10, block_queries=15)
    return best.withColumn("rank", F.col("rank").cast("long"))


@query(
    "K5 J6 R8", (),
    f"WITH {_CORPUS_SQL} SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 10",
)
def indexed_corpus_top_k(t):
    """The same through coarse lists with exact bounds."""
    folder = shared_folder(t.spark, "lists")
    retrieve.write_lists(_whole_documents(t), folder, lists=32)
    best, _ = retrieve.list_top_k(t.spark, folder, _benchmark_queries(t), 10, block_queries=64)
    return best.withColumn("rank", F.col("rank").cast("long"))


_LINE_CHUNKS = """
  lines AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(string_split(text, chr(10))) AS text,
      CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS chunk_index, lang
      FROM documents),
  keyed AS (SELECT *, concat(document_id, '::', chunk_index) AS chunk_id FROM lines)"""


def _line_chunks(t):
    lines = sections.text_lines(t.spread("documents"), "doc_id")
    return lines.select(
        F.concat_ws("::", F.col("doc_id").cast("string"), "line_no").alias("chunk_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("line_no").cast("long").alias("chunk_index"),
        F.col("line").alias("text"),
    )


def _document_queries(t):
    """One query per document: the most frequent words of its language, by name of its source."""
    asked = t.documents.select(
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(
            F.lit("the and of "),
            F.when(F.col("lang") == "fr", "le la de").when(F.col("lang") == "es", "el la de")
            .when(F.col("lang") == "de", "der die und").otherwise("that with for"),
        ).alias("query"),
    )
    return retrieve.encode_queries(asked)


_DOC_QUERY = (
    "concat('the and of ', CASE lang WHEN 'fr' THEN 'le la de' WHEN 'es' THEN 'el la de' "
    "WHEN 'de' THEN 'der die und' ELSE 'that with for' END)"
)
_WITHIN_SQL = (
    _LINE_CHUNKS
    + ","
    + _weights_sql("keyed", "chunk_id", "text", "c")
    + f""",
  asked AS (SELECT CAST(doc_id AS VARCHAR) AS document_id,
      concat('{fv.QUERY_INSTRUCTION}', {_DOC_QUERY}) AS text FROM documents)"""
    + ","
    + _weights_sql("asked", "document_id", "text", "q")
    + """,
  wdots AS (SELECT k.document_id, k.chunk_id, CAST(sum(c.w * q.w) AS BIGINT) AS dot
     FROM c JOIN keyed k ON k.chunk_id = c.id JOIN q ON q.id = k.document_id AND q.dim = c.dim
     GROUP BY 1, 2),
  scored AS (SELECT concat('q', k.document_id) AS query_id, k.document_id, k.chunk_id, k.chunk_index,
     CASE WHEN coalesce(cn.n2, 0) > 0 AND coalesce(qn.n2, 0) > 0 THEN CAST(coalesce(dot, 0) AS DOUBLE)
       / sqrt(CAST(cn.n2 AS DOUBLE) * CAST(qn.n2 AS DOUBLE)) ELSE 0::DOUBLE END AS score
     FROM keyed k LEFT JOIN c_norm cn ON cn.id = k.chunk_id LEFT JOIN q_norm qn ON qn.id = k.document_id
     LEFT JOIN wdots d ON d.chunk_id = k.chunk_id)"""
)


@query(
    "W1 J6 R8", (),
    f"""WITH {_WITHIN_SQL} SELECT query_id, document_id, chunk_id, rank,
          CAST(printf('%.4f', score) AS DOUBLE) AS similarity FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_index)
            AS BIGINT) AS rank FROM scored WHERE score >= 0.05::DOUBLE) WHERE rank <= 8""",
)
def document_top_k(t):
    best = retrieve.retrieve(
        chunks.add_embedding(_line_chunks(t)), _document_queries(t), min_score=0.05
    )
    return best.select(
        "query_id", "document_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "similarity"
    )


@query(
    "U1", (),
    f"""WITH {_WITHIN_SQL} SELECT document_id, chunk_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_index)
            AS rank FROM scored WHERE score >= 0.35::DOUBLE) WHERE rank <= 4""",
)
def many_document_top_k(t):
    best = retrieve.retrieve_many_documents(
        chunks.add_embedding(_line_chunks(t)), _document_queries(t)
    )
    return best.select("document_id", "chunk_id", "score")


_TAGGED = """
  SELECT CAST(l_orderkey AS VARCHAR) AS document_id,
    CASE l_linenumber WHEN 1 THEN 'federal' WHEN 2 THEN 'state:CA' WHEN 3 THEN 'state:NY' END
      AS jurisdiction, l_partkey, l_suppkey, l_linenumber FROM lineitem"""


@query(
    "F5", (),
    f"""WITH c AS ({_TAGGED})
        SELECT c.document_id, c.l_partkey, c.l_suppkey, jurisdiction FROM c JOIN orders
          ON document_id = CAST(o_orderkey AS VARCHAR)
        WHERE o_orderstatus = 'O' OR jurisdiction IS NULL
          OR (o_orderstatus = 'F' AND jurisdiction = 'federal')
          OR (o_orderstatus = 'P' AND jurisdiction IN ('federal', 'state:NY'))""",
)
def jurisdiction_filter(t):
    tags = t.orders.select(
        F.col("o_orderkey").cast("string").alias("document_id"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("federal")))
        .when(F.col("o_orderstatus") == "P", F.array(F.lit("federal"), F.lit("state:NY")))
        .otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    rows = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("document_id"),
        F.when(F.col("l_linenumber") == 1, "federal").when(F.col("l_linenumber") == 2, "state:CA")
        .when(F.col("l_linenumber") == 3, "state:NY").alias("jurisdiction"),
        "l_partkey", "l_suppkey",
    )
    joined = rows.join(tags, "document_id")
    return joined.where(
        retrieve.allowed_jurisdiction(F.col("tags"), F.col("jurisdiction"))
    ).drop("tags")


@query(
    "R8", (),
    """WITH mid AS (SELECT label, list(m ORDER BY i) AS centre FROM (
           SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x,
             generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
       SELECT vec_id, CAST(printf('%.6f', list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre)) AS DOUBLE)
         AS score FROM embeddings e JOIN mid ON e.label = mid.label""",
)
def dense_similarity(t):
    """Each vector against the centre of its label; the centres are a few rows."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    centre = (
        parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre")
        )
    )
    joined = t.embeddings.join(centre, "label")
    return joined.select(
        "vec_id", round_even(retrieve.dense_cosine("embedding", "centre"), 6).alias("score")
    )


@query(
    "X9", (),
    """SELECT p_partkey, CASE WHEN r.p_type IS NULL THEN q
         WHEN lower(e) = lower(q) THEN q
         WHEN starts_with(lower(e), lower(q)) THEN e ELSE concat(q, ' ', e) END AS query
       FROM (SELECT p_partkey, p_name AS q, p_brand, p_type FROM part) p
       LEFT JOIN (SELECT p_name, any_value(p_type) AS p_type,
           CASE WHEN p_name LIKE 'red%' THEN upper(p_name) WHEN p_name LIKE 'small%'
             THEN concat(upper(p_name), ' and more') ELSE 'other terms' END AS e
         FROM part WHERE p_name NOT LIKE '%ring' GROUP BY p_name) r ON p.q = r.p_name""",
)
def expanded_queries(t):
    asked = t.part.select("p_partkey", F.col("p_name").alias("query"))
    name = F.col("p_name")
    table = t.part.where("p_name NOT LIKE '%ring'").select(name).distinct().select(
        name.alias("query"),
        F.when(name.startswith("red"), F.upper(name))
        .when(name.startswith("small"), F.concat(F.upper(name), F.lit(" and more")))
        .otherwise("other terms").alias("expansion"),
    )
    return retrieve.expand_queries(asked, table)


# ---- draft evidence -----------------------------------------------------------------------------

_CANDIDATE_SQL = """
  cand AS (SELECT CAST(l_orderkey AS VARCHAR) AS document_id,
      concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS chunk_id,
      CAST(l_partkey % 240 AS BIGINT) AS chunk_index, CAST(l_suppkey AS BIGINT) AS query_no,
      l_quantity / 50 AS score FROM lineitem)"""


def _candidates(t):
    return t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("document_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("chunk_id"),
        (F.col("l_partkey") % 240).alias("chunk_index"),
        F.col("l_suppkey").alias("query_no"),
        (F.col("l_quantity") / 50).alias("score"),
    )


@query(
    "W2", (),
    f"""WITH {_CANDIDATE_SQL},
      sized AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n, row_number() OVER
        (PARTITION BY document_id, chunk_index // 20 ORDER BY score DESC, chunk_index, chunk_id) AS r
        FROM cand),
      placed AS (SELECT document_id, chunk_id, CAST(row_number() OVER (PARTITION BY document_id
        ORDER BY CASE WHEN n > 3 AND r > 1 THEN 1 ELSE 0 END, score DESC, chunk_index, chunk_id)
        AS BIGINT) AS position FROM sized)
      SELECT * FROM placed WHERE position <= 3""",
)
def diverse_selection(t):
    """Three chunks per document, one per stretch first (small numbers, as orders are short)."""
    rows = retrieve.select_diverse(_candidates(t).drop("query_no"), k=3, per_window=1)
    return rows.select("document_id", "chunk_id", F.col("position").cast("long").alias("position"))


@query(
    "W3", (),
    f"""WITH {_CANDIDATE_SQL}
        SELECT document_id, chunk_index, max(score) AS score,
          CAST(arg_max(query_no, (score, -query_no)) AS BIGINT) AS query_no
        FROM cand GROUP BY 1, 2""",
)
def best_score_per_chunk(t):
    rows = _candidates(t).withColumns(
        {"chunk_id": F.concat_ws("::", "document_id", "chunk_index"), "query_id": F.col("query_no")}
    )
    best = retrieve.best_per_chunk(rows)
    return best.select(
        "document_id", "chunk_index", "score", F.col("query_id").alias("query_no")
    )


_SUPPORT_TERMS = ["token", "secret", "the ", "license", "le ", "und ", "copyright", "void"]


@query(
    "W4", (),
    f"""WITH {_LINE_CHUNKS}, terms AS (SELECT * FROM (VALUES
          {', '.join(f"({i}, '{x}')" for i, x in enumerate(_SUPPORT_TERMS))}) v(no, term)),
        hits AS (SELECT document_id, chunk_id, no, row_number() OVER (PARTITION BY document_id, no
          ORDER BY chunk_index) AS r FROM keyed JOIN terms ON contains(lower(text), term)
          WHERE lang IN ('en', 'fr'))
        SELECT document_id, chunk_id, min(no)::BIGINT AS term_no, 0.5::DOUBLE AS score
        FROM hits WHERE r <= 3 GROUP BY 1, 2""",
)
def keyword_support(t):
    docs = t.documents.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.when(F.col("lang").isin("en", "fr"), "legal_complaint").alias("document_type"),
    )
    rows = retrieve.keyword_support(_line_chunks(t), docs, _SUPPORT_TERMS)
    return rows.select("document_id", "chunk_id", F.col("term_no").cast("long").alias("term_no"), "score")


@query(
    "U2", (),
    f"""WITH {_CANDIDATE_SQL}
        SELECT chunk_id, 'first' AS origin FROM cand WHERE score >= 0.5::DOUBLE
        UNION ALL SELECT chunk_id, 'second' FROM cand WHERE query_no < 50
          AND chunk_id NOT IN (SELECT chunk_id FROM cand WHERE score >= 0.5::DOUBLE)""",
)
def first_wins_union(t):
    rows = _candidates(t)
    a = rows.where("score >= 0.5").select("chunk_id", F.lit("first").alias("origin"))
    b = rows.where("query_no < 50").select("chunk_id", F.lit("second").alias("origin"))
    return retrieve.union_first(a, b, ["chunk_id"])


@query("R9 W2 W3 W4 U2")
def draft_evidence(t):
    """Section queries of every draft template against all chunks of all documents, in one job."""
    kinds = F.array(*[F.lit(k) for k in sorted(fv.DRAFT_TEMPLATES)])
    docs = t.documents.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.when(F.col("lang") == "en", "legal_complaint").otherwise("contract").alias("document_type"),
        F.element_at(kinds, (F.col("doc_id") % len(fv.DRAFT_TEMPLATES) + 1).cast("int")).alias("draft_type"),
    )
    rows = chunks.embed_documents(
        t.spread("documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    )
    stored = cut_lineage(
        rows.select("chunk_id", "document_id", "chunk_index", "jurisdiction", "text", "vec", "norm2")
    )
    return retrieve.draft_candidates(stored, docs)


_DRAFT_KINDS = [*sorted(fv.DRAFT_TEMPLATES), "settlement_offer", "internal_note"]


def _draft_queries_sql() -> str:
    """Rows (draft_type, document_type, query_no, text) of all types in the query below."""
    rows = []
    for draft in _DRAFT_KINDS:
        for kind in ("legal_complaint", "contract"):
            if draft in fv.DRAFT_TEMPLATES:
                asked = [q for _, _, _, q in fv.DRAFT_TEMPLATES[draft][1] if q]
            else:
                asked = [*fv.DRAFT_QUERIES.get(draft, [draft.replace("_", " ")]), *fv.DOCUMENT_TYPE_QUERIES.get(kind, [])]
            rows += [f"('{draft}', '{kind}', {i}, '" + fv.QUERY_INSTRUCTION.replace("'", "''") + q.replace("'", "''") + "')" for i, q in enumerate(asked)]
    return ", ".join(rows)


@query(
    "R9", (),
    f"""WITH {_LINE_CHUNKS}, qv AS (SELECT *, concat(draft_type, '#', document_type, '#', no) AS qid FROM
          (VALUES {_draft_queries_sql()}) v(draft_type, document_type, no, text)),"""
    + _weights_sql("keyed", "chunk_id", "text", "c") + "," + _weights_sql("qv", "qid", "text", "q")
    + f""",
      dd AS (SELECT CAST(doc_id AS VARCHAR) AS document_id,
          CASE WHEN lang = 'en' THEN 'legal_complaint' ELSE 'contract' END AS document_type,
          [{", ".join(f"'{k}'" for k in _DRAFT_KINDS)}][doc_id % {len(_DRAFT_KINDS)} + 1] AS draft_type FROM documents),
      asked AS (SELECT document_id, qid, no FROM dd JOIN qv USING (draft_type, document_type)),
      pairs AS (SELECT a.document_id, qid, no, chunk_id, chunk_index FROM asked a JOIN keyed k ON a.document_id = k.document_id),
      dots AS (SELECT p.qid, p.chunk_id, sum(c.w * q.w) AS dot FROM pairs p JOIN c ON c.id = p.chunk_id
          JOIN q ON q.id = p.qid AND q.dim = c.dim GROUP BY 1, 2),
      scored AS (SELECT p.*, CASE WHEN cn.n2 > 0 AND qn.n2 > 0 THEN CAST(coalesce(dot, 0) AS DOUBLE)
            / sqrt(CAST(cn.n2 AS DOUBLE) * CAST(qn.n2 AS DOUBLE)) ELSE 0::DOUBLE END AS score
          FROM pairs p LEFT JOIN dots d ON p.qid = d.qid AND p.chunk_id = d.chunk_id
          LEFT JOIN c_norm cn ON cn.id = p.chunk_id LEFT JOIN q_norm qn ON qn.id = p.qid),
      best AS (SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY score DESC, chunk_index, chunk_id) AS r
          FROM scored WHERE score >= 0),
      per AS (SELECT document_id, chunk_id, chunk_index, max(CAST(printf('%.4f', score) AS DOUBLE)) AS score
          FROM best WHERE r <= 50 GROUP BY 1, 2, 3),
      terms AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(fv.KEYWORD_SUPPORT_TERMS))}) v(no, term)),
      hits AS (SELECT k.document_id, chunk_id, chunk_index, row_number() OVER (PARTITION BY k.document_id, terms.no ORDER BY chunk_index) AS r
          FROM keyed k JOIN dd ON dd.document_id = k.document_id AND document_type = 'legal_complaint'
          JOIN terms ON contains(lower(text), term)),
      cand AS (SELECT * FROM per UNION ALL SELECT DISTINCT document_id, chunk_id, chunk_index, 0.5::DOUBLE FROM hits
          WHERE r <= 3 AND chunk_id NOT IN (SELECT chunk_id FROM per)),
      sized AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n, row_number() OVER (PARTITION BY document_id,
          chunk_index // 20 ORDER BY score DESC, chunk_index, chunk_id) AS r FROM cand),
      placed AS (SELECT document_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY document_id ORDER BY
          CASE WHEN n > 10 AND r > 2 THEN 1 ELSE 0 END, score DESC, chunk_index, chunk_id) AS BIGINT) AS position FROM sized)
      SELECT * FROM placed WHERE position <= 10""",
)
def draft_evidence_lines(t):
    """Evidence for drafts over the lines of all documents; two draft types have no template."""
    kinds = F.array(*[F.lit(k) for k in _DRAFT_KINDS])
    docs = t.documents.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.when(F.col("lang") == "en", "legal_complaint").otherwise("contract").alias("document_type"),
        F.element_at(kinds, (F.col("doc_id") % len(_DRAFT_KINDS) + 1).cast("int")).alias("draft_type"),
    )
    lines = chunks.add_embedding(_line_chunks(t).withColumn("jurisdiction", F.lit(None).cast("string")))
    rows = retrieve.draft_candidates(lines, docs)
    return rows.select("document_id", "chunk_id", "score", F.col("position").cast("long").alias("position"))


# ---- gold and metrics ---------------------------------------------------------------------------

_GOLD_SQL = """
  dn AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id,
           trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents),
  bn AS (SELECT CAST(item_id AS VARCHAR) AS case_id,
           trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM benchmark),
  gold AS (SELECT case_id, chunk_id FROM bn JOIN dn ON contains(dn.n, bn.n) OR contains(bn.n, dn.n)
           WHERE bn.n <> '')"""


def _gold_inputs(t):
    docs = t.spread("documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.concat(F.lit("corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        .alias("corpus_path"),
        F.lit(0).alias("chunk_index"),
        "text",
        F.lit(0).alias("char_start"),
        F.length("text").alias("char_end"),
    )
    gold = t.benchmark.select(
        F.col("item_id").cast("string").alias("case_id"),
        F.lit(0).alias("snippet_no"),
        F.lit(None).cast("string").alias("corpus_path"),
        F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("end"),
        "text",
    )
    return docs, gold


@query("J7", (), f"WITH {_GOLD_SQL} SELECT case_id, chunk_id FROM gold")
def gold_by_text(t):
    docs, gold = _gold_inputs(t)
    return evaluate.match_gold(docs, gold).select("case_id", "chunk_id")


@query(
    "J7", (),
    """WITH c AS (SELECT doc_id, k, k * 480 AS s, k * 480 + 600 AS e FROM (SELECT doc_id,
           unnest(range(0, length(text) // 480 + 1)) AS k FROM documents)),
         g AS (SELECT doc_id, quality * 700 AS s, quality * 700 + 300 AS e FROM labels)
       SELECT CAST(g.doc_id AS VARCHAR) AS case_id, concat(c.doc_id, '::', k) AS chunk_id
       FROM g JOIN c ON c.doc_id = g.doc_id WHERE c.s <= g.e AND c.e >= g.s""",
)
def gold_by_span(t):
    """Snippets by path suffix and span; chunks are fixed windows of the documents."""
    k = F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 480).cast("int")))
    rows = t.documents.select("doc_id", "source", k.alias("k"), F.lit("").alias("text"))
    docs = rows.select(
        F.concat_ws("::", "doc_id", "k").alias("chunk_id"),
        F.concat(F.lit("corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        .alias("corpus_path"),
        F.col("k").alias("chunk_index"),
        "text",
        (F.col("k") * 480).alias("char_start"),
        (F.col("k") * 480 + 600).alias("char_end"),
    )
    gold = t.labels.select(
        F.col("doc_id").cast("string").alias("case_id"),
        F.lit(0).alias("snippet_no"),
        F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("corpus_path"),
        (F.col("quality") * 700).alias("start"),
        (F.col("quality") * 700 + 300).alias("end"),
        F.lit("").alias("text"),
    )
    return evaluate.match_gold(docs, gold).select("case_id", "chunk_id")


@query(
    "J10", (),
    "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def referenced_corpus(t):
    gold = t.labels.select("doc_id")
    return evaluate.referenced_only(t.documents, gold, "doc_id").select("doc_id")


def _case_hits(t):
    docs, gold = _gold_inputs(t)
    relevant = evaluate.match_gold(docs, gold)
    ranked = retrieve.corpus_top_k(_whole_documents(t), _benchmark_queries(t), 10)
    ranked = ranked.select(F.col("query_id").alias("case_id"), "chunk_id", "rank")
    return evaluate.first_hits(ranked, relevant, [5, 10])


_HITS_SQL = f"""{_CORPUS_SQL}, {_GOLD_SQL},
  hits AS (SELECT g.case_id, min(r.rank) AS first_hit_rank,
      count(CASE WHEN r.rank <= 5 THEN 1 END) AS hits_5, count(r.rank) AS hits_10
    FROM gold g LEFT JOIN ranked r ON r.query_id = g.case_id AND r.chunk_id = g.chunk_id
      AND r.rank <= 10 GROUP BY 1)"""


@query("W5", (), f"WITH {_HITS_SQL} SELECT case_id, first_hit_rank, hits_5, hits_10 FROM hits")
def first_hit_ranks(t):
    return _case_hits(t).withColumn("first_hit_rank", F.col("first_hit_rank").cast("long"))


@query(
    "A15", (),
    f"""WITH {_HITS_SQL} SELECT count(*) AS total_queries,
          CAST(printf('%.4f', avg(CASE WHEN hits_5 > 0 THEN 1.0::DOUBLE ELSE 0::DOUBLE END)) AS DOUBLE) AS recall_5,
          CAST(printf('%.4f', avg(hits_5::DOUBLE / 5)) AS DOUBLE) AS precision_5,
          CAST(printf('%.4f', avg(CASE WHEN hits_10 > 0 THEN 1.0::DOUBLE ELSE 0::DOUBLE END)) AS DOUBLE) AS recall_10,
          CAST(printf('%.4f', avg(hits_10::DOUBLE / 10)) AS DOUBLE) AS precision_10,
          CAST(printf('%.4f', avg(coalesce(1.0::DOUBLE / first_hit_rank, 0::DOUBLE))) AS DOUBLE) AS mrr
        FROM hits""",
)
def retrieval_quality(t):
    return evaluate.retrieval_metrics(_case_hits(t), [5, 10])


@query(
    "A16", (),
    f"""WITH {_HITS_SQL}, every AS (SELECT CAST(item_id AS VARCHAR) AS case_id FROM benchmark)
        SELECT count(*) AS cases,
          CAST(printf('%.4f', avg(CASE WHEN first_hit_rank <= 5 THEN 1::DOUBLE ELSE 0::DOUBLE END)) AS DOUBLE) AS recall_5,
          CAST(printf('%.4f', avg(CASE WHEN first_hit_rank <= 5 THEN 1.0::DOUBLE / first_hit_rank
             ELSE 0::DOUBLE END)) AS DOUBLE) AS mrr
        FROM every LEFT JOIN hits ON every.case_id = hits.case_id""",
)
def simple_retrieval_quality(t):
    docs, gold = _gold_inputs(t)
    ranked = retrieve.corpus_top_k(_whole_documents(t), _benchmark_queries(t), 5)
    return evaluate.simple_retrieval_metrics(
        ranked.select(F.col("query_id").alias("case_id"), "chunk_id", "rank"),
        evaluate.match_gold(docs, gold),
        gold.select("case_id"),
    )


def flagship(spark, sf_dir: str):
    """Chunks of all documents, ranked for every benchmark passage, scored against the gold chunks."""
    from lexloom.plans.registry import Inputs

    t = Inputs(spark, sf_dir)
    rows = chunks.chunk_documents(t.spread("documents"))
    embedded = cut_lineage(
        chunks.add_embedding(rows).select(
            "chunk_id", F.col("document_id").cast("string").alias("corpus_path"), "chunk_index",
            "text", "char_start", "char_end", "vec", "norm2",
        )
    )
    _, gold = _gold_inputs(t)
    relevant = evaluate.match_gold(embedded, gold)
    ranked = retrieve.corpus_top_k(embedded, _benchmark_queries(t), 10)
    hits = evaluate.first_hits(
        ranked.select(F.col("query_id").alias("case_id"), "chunk_id", "rank"), relevant, [5, 10]
    )
    return evaluate.retrieval_metrics(hits, [5, 10])


@query("R2 R4 J6 K5 J7 A15")
def chunk_retrieval_quality(t):
    return flagship(t.spark, t.sf_dir)
