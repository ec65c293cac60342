"""Jurisdiction tags from citations and state names. Column functions, no shuffle."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import as_col, bind, holds_any, strip

_FLAGS = "(?iU)"


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def state_code(raw: Column) -> Column:
    """Two-letter code of a state name, code or citation prefix; NULL when it is none."""
    known = F.array(*[F.lit(c) for c in sorted(set(fv.STATE_NAMES.values()))])

    def found(name: Column) -> Column:
        code = F.upper(name)
        return F.when((F.length(name) == 2) & F.array_contains(known, code), code).otherwise(
            bind(
                F.regexp_replace(name, r"(?U)\s+", " "),
                lambda spaced: F.coalesce(
                    _lookup(fv.STATE_NAMES)[spaced], _lookup(fv.STATE_CITATION_PREFIXES)[spaced]
                ),
            )
        )

    return bind(F.lower(F.btrim(strip(raw), F.lit("."))), found)


def _code_pattern() -> str:
    """A state's citation prefix with what follows it. The words that follow are looked for first: that costs a word
    of the text one test and not one for each prefix."""
    prefixes = sorted(fv.STATE_CITATION_PREFIXES, key=len, reverse=True)
    letters = re.escape("".join(sorted(set("".join(prefixes)) - set(string.ascii_letters))))
    some = rf"[A-Za-z{letters}]{{{len(prefixes[-1])},{len(prefixes[0])}}}"
    return rf"\b(?={some}{fv.STATE_CODE_TAIL})({'|'.join(prefixes)}){fv.STATE_CODE_TAIL}"


def jurisdiction_tags(text: Column | str) -> Column:
    """Distinct tags: citation, then districts, then state codes, then state names."""
    col = as_col(text)
    return bind(F.lower(col), lambda low: _tags(col, low))


def _tags(col: Column, low: Column) -> Column:
    none = F.array().cast("array<string>")
    code_pattern = _FLAGS + _code_pattern()
    district_pattern = _FLAGS + fv.DISTRICT_CITATION
    name_pattern = _FLAGS + fv.STATE_BY_NAME

    federal = F.when(holds_any(low, "u.", "fed") & col.rlike(_FLAGS + fv.FEDERAL_CITATION), F.array(F.lit("federal")))
    districts = F.zip_with(
        F.regexp_extract_all(col, F.lit(district_pattern), F.lit(1)),
        F.regexp_extract_all(col, F.lit(district_pattern), F.lit(2)),
        lambda d, s: F.struct(
            F.replace(F.upper(d), F.lit("."), F.lit("")).alias("d"), state_code(s).alias("s")
        ),
    )
    district_tags = F.flatten(
        F.transform(
            F.filter(districts, lambda x: x["s"].isNotNull()),
            lambda x: F.array(
                F.concat(
                    F.lit("federal:"),
                    F.when(x["d"].isin(*fv.LETTERED_DISTRICTS), x["d"]).otherwise("D"),
                    x["s"],
                ),
                F.lit("federal"),
            ),
        )
    )

    def states(pattern: str) -> Column:
        codes = F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(1)), state_code)
        return F.transform(
            F.filter(codes, lambda c: c.isNotNull()), lambda c: F.concat(F.lit("state:"), c)
        )

    tags = F.concat(
        F.coalesce(federal, none),
        F.when(holds_any(low, "d.") & col.rlike(district_pattern), district_tags).otherwise(none),
        F.when(holds_any(low, "tat.", "code", "v.", "cplr", "adm"), states(code_pattern)).otherwise(none),
        F.when(holds_any(low, "tate"), states(name_pattern)).otherwise(none),
    )
    return F.array_distinct(F.coalesce(tags, none))


def primary_tag(tags: Column | str) -> Column:
    """The first federal district, else the first state, else the first tag."""

    def chosen(known: Column) -> Column:
        def first(prefix: str) -> Column:
            return F.get(F.filter(known, lambda t: F.startswith(t, F.lit(prefix))), F.lit(0))

        return F.coalesce(first("federal:"), first("state:"), F.get(known, F.lit(0)))

    return bind(as_col(tags), chosen)


def document_tags(text: Column | str, *fields: Column | str) -> Column:
    """Tags of the text and of the jurisdiction-bearing field values, joined by line breaks."""
    return jurisdiction_tags(F.concat_ws("\n", as_col(text), *[as_col(f) for f in fields]))
