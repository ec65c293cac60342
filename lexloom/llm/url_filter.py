"""URL filter in DataFrame functions: longest rule first, else logistic regression.

Features of a URL are the distinct hashed character n-grams of host and path, of equal weight and
unit length. The model is trained by gradient descent on a small labelled table of at most a few
thousand rows: the weights stay a combination of the training rows, so that one step needs only
their products with each other. What is learned is ``buckets`` weights, a fixed size.

A URL that is null or has no ``://`` has an empty host and path, and takes no rule. Repeated rows
are judged each. ``judged`` reads only ``id_col`` and url, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.labelled_urls import LABELLED

BUCKETS = 4096
SIZES = (2, 3, 4)

#: A labelled table: 1 blocks, 0 allows.
LABELLED_URLS = tuple((url, label) for url, label, _ in LABELLED)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the (verdict, rule) pairs that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):
        where, slash, rest = text.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, mark: str, n: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.transform(at, lambda i: F.concat(F.lit(mark), text.substr(i, F.lit(n))))


def features(host: Column, path: Column, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> Column:
    """Sorted distinct buckets of the n-grams of ``^host$`` and of ``path$``."""
    host = F.concat(F.lit("^"), host, F.lit("$"))
    path = F.concat(path, F.lit("$"))
    grams = F.concat(*[_grams(t, m, n) for t, m in ((host, "h"), (path, "p")) for n in sizes])
    return F.array_sort(F.array_distinct(F.transform(grams, lambda g: F.pmod(F.crc32(g), F.lit(buckets)).cast("int"))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in LABELLED_URLS])
    return spark.range(1).select(F.inline(rows))


def trained(labelled: DataFrame, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES, steps: int = 300, rate: float = 8.0, decay: float = 1e-3) -> list[float]:
    """Weights by bucket, then the bias. ``labelled`` (url, label) is small: its rows meet in one array."""
    url = F.col("url")
    rows = labelled.filter("label is not null").select(
        url, F.col("label").cast("double").alias("y"), features(host_of(url), path_of(url), buckets, sizes).alias("f")
    )
    table = rows.agg(F.array_sort(F.collect_list(F.struct("url", "y", "f"))).alias("t"))
    like = lambda a, b: F.size(F.array_intersect(a.f, b.f)) / F.sqrt(F.size(a.f) * F.size(b.f)) + 1
    table = table.withColumn("k", F.transform("t", lambda a: F.transform("t", lambda b: like(a, b))))
    table = table.agg(F.first("t").alias("t"), F.first("k").alias("k"))  # else every step would compute k again
    n = F.greatest(F.size("t"), F.lit(1))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def step(w: Column, _: Column) -> Column:
        miss = lambda row, i: 1 / (1 + F.exp(-dot(row, w))) - F.get("t", i).y
        return F.transform("k", lambda row, i: F.get(w, i) * (1 - rate * decay) - miss(row, i) * rate / n)

    zeros = F.transform("t", lambda _: F.lit(0.0))
    shares = table.select(
        "t", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zeros, step).alias("w")
    ).select(F.inline(F.zip_with("t", "w", lambda t, w: F.struct(t.f.alias("f"), w.alias("w")))))
    by_bucket = shares.select(F.explode("f").alias("b"), (F.col("w") / F.sqrt(F.size("f"))).alias("w"))
    bias = shares.select(F.lit(buckets).alias("b"), "w")
    weights = [0.0] * (buckets + 1)
    for b, w in by_bucket.unionAll(bias).groupBy("b").agg(F.sum("w")).collect():  # at most buckets + 1 rows
        weights[b] = w
    return weights


def score(found: Column, weights: list[float]) -> Column:
    """Probability that a URL with these ``features`` is to be blocked."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(table, b))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.size(found)) + weights[-1])))


def judged(urls: DataFrame, rules: list[tuple[str, str]], weights: list[float], id_col: str = "page_id", threshold: float = 0.5, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """For each row: its id, host, path, rule, verdict (allow or block) and score."""
    parts = urls.select(id_col, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    found = features(F.col("host"), F.col("path"), len(weights) - 1, sizes)
    scored = parts.select("*", rule.alias("rule"), ruled.alias("ruled"), found.alias("found")).withColumn(
        "score", score(F.col("found"), weights)
    )
    by_score = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("ruled", by_score).alias("verdict"), "score")
