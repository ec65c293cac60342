"""Line rule scan: secrets, unsafe code and sensitive values, line by line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import unpack
from lexloom.operators.sections import text_lines


def rule_hit(line: Column, rule: tuple) -> Column:
    _, _, patterns, exempt, *_ = rule
    hit = reduce(lambda a, b: a | b, [line.rlike(p) for p in patterns])
    for literal in exempt:
        hit = hit & ~line.contains(literal)
    return hit


def scan_lines(
    df: DataFrame, key: str, text: str = "text", rules: list[tuple] | None = None
) -> DataFrame:
    """Findings (key, line_no from 1, severity, issue, suggested_fix, frameworks, urgency), each once.

    Rules are constants of the plan; only findings are shuffled.
    """
    rules = rules or fv.LINE_RULES
    line = F.col("line")
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    rule_hit(line, r),
                    F.struct(
                        F.lit(r[0]).alias("severity"),
                        F.lit(r[1]).alias("issue"),
                        F.lit(r[4]).alias("suggested_fix"),
                        F.array(*[F.lit(f) for f in r[5]]).alias("frameworks"),
                        F.lit(r[6]).alias("urgency"),
                    ),
                )
                for r in rules
            ]
        )
    )
    rows = unpack(
        text_lines(df, key, text), [key, (F.col("line_no") + 1).alias("line_no")], found, "issue"
    )
    return rows.dropDuplicates([key, "line_no", "severity", "issue"])
