"""Awkward rows that every operator has to take."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = "row key class n digest host score spans items shard slot kept length token part component chars hits first content head url_ _hits _d _n _first _digest _id _k _kept kept_id kept_digest id bucket weight rank".split()
LONG = "lorem ipsum dolor sit amet " * 30_000


def docs(spark, rows):
    """Rows (doc_id, text) with extra columns of clashing names."""
    made = spark.createDataFrame([(i, t, None if t is None else "en", "s", 0) for i, t in rows], SCHEMA)
    return made.withColumns({c: F.lit("x") for c in CLASHING})


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "one two"),
    (6, "The same text, twice."),
    (7, "The same text, twice."),
    (7, "The same text, twice."),
    (None, "The same text, twice."),
    (8, "\u00fcml\u00e4ut \U0001f600 \u4e2d\u6587 caf\u00e9"),
    (9, LONG),
    (None, None),
]
