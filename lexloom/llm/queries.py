"""The registered queries of this subpackage, and SQL for a second engine where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import shared_folder, ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.language import held_out, languages, trained

    docs = _table(spark, sf_dir, "documents")
    model = trained(docs.filter(~held_out(F.col("doc_id"))))
    return languages(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("lang").alias("lang_pred"), "score"
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_long_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.long_matches import without_long_matches

    return without_long_matches(_table(spark, sf_dir, "documents")).drop("spans")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.warc import read_records, write_archives

    folder = shared_folder(spark, "warc")
    index = write_archives(_table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.html_text import page_texts

    return page_texts(_table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.url_filter import judged, labelled_urls, trained

    rules = [
        ("allow", "org/"),
        ("block", "example.org/es/"),
        ("block", "example.org/en/1"),
        ("allow", "com/fr/"),
        ("block", "com/de/"),
    ]
    return judged(_table(spark, sf_dir, "pages"), rules, trained(labelled_urls(spark)))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.jaccard import similar

    return similar(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexloom.llm.packing import packed

    return packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.sharding import sharded

    return sharded(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.centroids import clustered

    return clustered(_table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.importance import resampled

    found = resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: The base of op13: wordings that stand for a license by themselves.
LICENSE_PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.licenses import license_labels

    return license_labels(_table(spark, sf_dir, "documents"), LICENSE_PHRASES)


_PLANS = [op1_language, op2_decontamination, op3_long_matches, op4_warc, op5_html_text, op6_url_filter, op7_jaccard_join, op8_packing, op9_exact_dedup, op10_sharding, op11_centroids, op12_importance, op13_licenses]


def _centroid_sql(k: int = 40, dims: int = 64, rounds: int = 5) -> str:
    """Every vector against every centroid, round by round; whole numbers are exact in doubles."""

    def nearest(r: int) -> str:
        square = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
        return f"""
        a{r} AS MATERIALIZED (SELECT row, vec_id, v, n AS cluster, d AS distance FROM (
          SELECT row, vec_id, v, n, d, row_number() OVER (PARTITION BY row ORDER BY d, n) AS first
          FROM (SELECT row, vec_id, v, n, {square} AS d FROM e CROSS JOIN c{r})) WHERE first = 1)"""

    steps = []
    for r in range(rounds):
        steps.append(nearest(r))
        steps.append(f"""
        m{r} AS (SELECT cluster, list(x ORDER BY i) AS c FROM (
          SELECT cluster, i, CAST(floor(sum(CAST(x AS HUGEINT)) / count(*)) AS DOUBLE) AS x
          FROM (SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY 1),
        c{r + 1} AS MATERIALIZED (SELECT n, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.cluster = n)""")
    steps.append(nearest(rounds))
    return f"""
        WITH e AS MATERIALIZED (
          SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
          FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS n, v AS c FROM (
          SELECT sha256(concat('2:', vec_id)) AS h, v FROM e ORDER BY h, v LIMIT {k})),{",".join(steps)},
        t AS (SELECT cluster, sum(distance) AS d FROM a{rounds} GROUP BY 1)
        SELECT vec_id, CAST(a{rounds}.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
               CAST(d AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM t) AS BIGINT) AS inertia,
               sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
        FROM a{rounds} JOIN t ON t.cluster = a{rounds}.cluster JOIN c{rounds} ON n = a{rounds}.cluster"""


def _license_sql() -> str:
    """Phrases by lists of words; templates as regular expressions over words that stand between two spaces each."""
    from lexloom.llm.license_templates import LICENSE_TEMPLATES
    from lexloom.llm.licenses import parsed

    def pattern(parts) -> str:
        found = ""
        for part in parts:
            if isinstance(part, bytes):
                found += f" {part.decode()} "
            elif isinstance(part, int):
                found += f"( [^ ]+ ){{0,{part}}}"
            elif part[0] == "optional":
                found += f"({pattern(part[1])})?"
            else:
                found += f"({'|'.join(pattern(p) for p in part[1])})"
        return found

    phrases = ", ".join(
        f"{{'label': '{label}', 'places': list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(words)}] = {words})}}"
        for label, words in ((label, text.split()) for label, text in LICENSE_PHRASES)
    )
    templates = ", ".join(
        f"{{'label': '{label}', 'found': regexp_extract_all(line, '{pattern(parsed(markup))}')}}"
        for label, markup in [*LICENSE_PHRASES, *LICENSE_TEMPLATES]
    )
    return rf"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT *, concat(' ', array_to_string(w, '  '), ' ') AS line FROM d),
        m AS (SELECT doc_id, len(w) AS n, list_filter([{phrases}], lambda p: len(p.places) > 0) AS p,
              list_filter([{templates}], lambda p: len(p.found) > 0) AS t FROM s),
        f AS (SELECT doc_id, n, flatten(list_transform(p, lambda x: x.places)) AS places, list_transform(p, lambda x: x.label) AS base,
              list_transform(t, lambda x: x.label) AS found,
              list_max(list_transform(flatten(list_transform(t, lambda x: x.found)), lambda x: len(string_split(trim(x), '  ')))) AS most FROM m)
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
               array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(found)), ',') AS labels, coalesce(most / n, 0) AS score FROM f"""


def _shipped(plan):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return plan(spark, sf_dir)

    return run


QUERIES = {plan.__name__: _shipped(plan) for plan in _PLANS}

CHECKS = {
    "op13_licenses": _license_sql(),
    "op12_importance": r"""
        WITH texts AS (SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS row, text FROM documents
                       UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
        w AS MATERIALIZED (SELECT kind, id, row, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
        g AS (SELECT kind, row, array_to_string(w[i : i + n - 1], ' ') AS f
              FROM (SELECT kind, row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)),
        c AS MATERIALIZED (SELECT kind, row, f, count(*) AS c FROM g GROUP BY ALL),
        step AS (SELECT list(v ORDER BY x) AS t FROM (SELECT x, list_reduce(list_prepend(x, range(4)),
               lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(16)) AS x))),
        d AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM c)),
        k AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(h)), lambda i:
               CAST(strpos('0123456789ABCDEF', substr(h, xor(i, 1) + 1, 1)) - 1 AS BIGINT))),
               lambda a, x: xor(a >> 4, t[(xor(a, x) & 15) + 1])), 4294967295) % 10000 AS bucket FROM d, step),
        n AS (SELECT bucket, sum(CASE WHEN kind = 0 THEN c ELSE 0 END) AS s, sum(CASE WHEN kind = 1 THEN c ELSE 0 END) AS t FROM c JOIN k USING (f) GROUP BY 1),
        gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM n) + 10000) AS DOUBLE) /
               CAST((s + 1) * ((SELECT sum(t) FROM n) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM n),
        weight AS (SELECT row, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * gain) AS BIGINT) AS weight FROM c JOIN k USING (f) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY 1),
        scored AS (SELECT id AS doc_id, len(w) >= 20 AS fits, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('42:', id)), 1, 8)) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
               FROM w LEFT JOIN weight USING (row) WHERE kind = 0)
        SELECT doc_id, n_features, weight, score, CASE WHEN fits AND r <= 5 * (SELECT count(*) FROM scored WHERE fits) // 100 THEN r END AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id) AS r FROM scored)""",
    "op11_centroids": _centroid_sql(),
    "op3_long_matches": r"""
        WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
        h AS (SELECT doc_id, hex(raw) AS h, octet_length(raw) AS n FROM b),
        blk AS (SELECT doc_id, n, j, substr(h, CAST(2000 * j + 1 AS BIGINT), 2198) AS t
                FROM (SELECT doc_id, h, n, unnest(range(0, (n - 100) // 1000 + 1)) AS j FROM h WHERE n >= 100)),
        w AS (SELECT doc_id, j * 1000 + o AS i, md5(substr(t, CAST(2 * o + 1 AS BIGINT), 200)) AS g
              FROM (SELECT doc_id, t, j, unnest(range(0, least(1000, n - 99 - 1000 * j))) AS o FROM blk)),
        seen AS (SELECT g, min(doc_id) AS doc_id FROM w GROUP BY g HAVING count(*) > 1),
        first AS (SELECT w.g, w.doc_id, min(i) AS i FROM w JOIN seen ON w.g = seen.g AND w.doc_id = seen.doc_id GROUP BY 1, 2),
        hit AS (SELECT w.doc_id, w.i FROM w JOIN first f ON w.g = f.g WHERE w.doc_id > f.doc_id OR w.i > f.i),
        step AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM hit),
        part AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM step),
        span AS (SELECT doc_id, k, min(i) AS s, max(i) + 100 AS e FROM part GROUP BY 1, 2),
        gap AS (SELECT doc_id, k, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS a, s AS z FROM span
                UNION ALL SELECT h.doc_id, 1000000000, coalesce(max(e), 0), max(h.n) FROM h LEFT JOIN span ON h.doc_id = span.doc_id GROUP BY 1),
        kept AS (SELECT gap.doc_id, sha256(unhex(string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (z - a) AS BIGINT)), '' ORDER BY k))) AS kept_sha256
                 FROM gap JOIN h ON h.doc_id = gap.doc_id GROUP BY 1)
        SELECT h.doc_id, CAST(h.n AS BIGINT) AS n_bytes, CAST(coalesce((SELECT sum(e - s) FROM span WHERE span.doc_id = h.doc_id), 0) AS BIGINT) AS n_removed,
               (SELECT count(*) FROM span WHERE span.doc_id = h.doc_id) AS n_spans, kept_sha256
        FROM h JOIN kept ON kept.doc_id = h.doc_id""",
    "op4_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 ((CAST(concat('0x', substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    "op7_jaccard_join": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
          SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
                 WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) END)) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT x, y FROM pairs JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y
                 WHERE 100 * c >= 90 * (na.n + nb.n - c)),
        edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y) AS component_id
        FROM d JOIN reach ON d.doc_id = x LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1""",
    "op9_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents),
        r AS (
          SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS k,
                 first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY norm) AS group_size
          FROM d)
        SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op2_decontamination": r"""
        WITH dw AS (
          SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
        d AS (SELECT doc_id, CASE WHEN w = [''] THEN CAST([] AS VARCHAR[]) ELSE w END AS w FROM dw),
        iw AS (
          SELECT item_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') AS w FROM benchmark),
        win AS (
          SELECT DISTINCT item_id, least(len(w), 10) AS n,
                 array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE w <> [''])),
        sizes AS (SELECT DISTINCT n FROM win),
        pos AS (
          SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hit AS (SELECT DISTINCT doc_id, item_id, i, pos.n FROM pos JOIN win ON pos.g = win.g AND pos.n = win.n),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
                  FROM hit GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
