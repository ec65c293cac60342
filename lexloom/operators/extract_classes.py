"""Fields of the per-type extractors, evaluated from a table of rules.

``fixed_values.CLASS_FIELDS`` names, for every type and field, a kind and its rule. Each kind below is
one column expression; lists share one sequence of optional steps. Nothing is capped: a list holds
all finds. A struct of columns comes out, so Spark reads the text once and prunes unused fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import as_col, bind, collapse, distinct_ignore_case, search, snippet, strip, strip_chars

_NONE = "array<string>"
_FLAGS = "(?iUd)"


def _once(text: Column, rule: dict) -> Column:
    """The one find of a rule as a list, empty where there is none."""
    pattern = _FLAGS + rule["once"]
    hit = F.array(F.regexp_extract(text, pattern, rule.get("group", 0)))
    return F.when(text.rlike(pattern), hit).otherwise(F.array().cast(_NONE))


def _finds(text: Column, rule: dict) -> Column:
    if "once" in rule:
        return _once(text, rule)
    if "search" in rule:
        return F.array_compact(F.array(*[search(text, p) for p in rule["search"]]))
    return F.concat(*[F.regexp_extract_all(text, F.lit(_FLAGS + p), F.lit(g)) for p, g in rule["find"]])


def _steps(text: Column, rule: dict) -> Column:
    """Finds, then in this order: cut, white space, trim, drop, split, trim of parts, tests."""

    def tidy(value: Column) -> Column:
        if "cut" in rule:
            value = F.regexp_replace(value, _FLAGS + rule["cut"], "")
        value = strip(value) if rule.get("raw") else collapse(value)
        if "trim" in rule and "split" not in rule or "drop" in rule:
            value = strip_chars(value, rule["trim"])
        if "drop" in rule and "split" not in rule or "once" in rule and "drop" in rule:
            value = F.regexp_replace(value, _FLAGS + rule["drop"], "")
        return value

    out = F.transform(_finds(text, rule), tidy)
    if "split" in rule:
        parts = F.flatten(F.transform(out, lambda v: F.split(v, _FLAGS + rule["split"])))
        parts = F.filter(parts, lambda p: F.length(strip(p)) > rule["part_longer_than"])
        out = F.transform(parts, lambda p: strip_chars(p, rule["trim"]))
        if "drop" in rule and "once" not in rule:
            out = F.transform(out, lambda p: F.regexp_replace(p, _FLAGS + rule["drop"], ""))
    if "longer_than" in rule:
        out = F.filter(out, lambda v: F.length(v) > rule["longer_than"])
    if "but" in rule:
        out = F.filter(out, lambda v: ~F.lower(v).isin(*rule["but"]))
    if "also" in rule:
        out = F.concat(out, _steps(text, rule["also"]))
    distinct = {"ignore case": distinct_ignore_case, "sorted": lambda v: F.array_sort(F.array_distinct(v)), None: lambda v: v}
    return distinct[rule.get("distinct")](out)


def _first_of(text: Column, rules: list[dict]) -> Column:
    """The list of the first rule that finds something."""
    lists = [_steps(text, r) for r in rules]
    if len(lists) == 1:
        return lists[0]
    return F.coalesce(*[bind(x, lambda a: F.when(F.size(a) > 0, a)) for x in lists], F.array().cast(_NONE))


def _snippet(text: Column, rule: tuple) -> Column:
    needles, window = rule
    return F.coalesce(*[snippet(text, F.lit(n), window) for n in needles])


def _clause(text: Column, rule: tuple) -> Column:
    found = _snippet(text, rule)
    return F.struct(found.isNotNull().alias("present"), found.alias("snippet"))


def _pairs(text: Column, rule: dict, body) -> Column:
    groups = [F.regexp_extract_all(text, F.lit(_FLAGS + rule["pattern"]), F.lit(g)) for g in (1, 2)]
    return F.zip_with(*groups, body)


def _signatures(text: Column, rule: dict) -> Column:
    tidy = lambda v: strip_chars(v, rule["trim"])
    return _pairs(text, rule, lambda name, date: F.struct(tidy(name).alias("name"), F.nullif(tidy(date), F.lit("")).alias("date")))


def _people(text: Column, rule: dict, fields: dict) -> Column:
    """Named fields first, then other (role, name) finds that differ from them."""
    person = lambda name, role: F.struct(name.alias("name"), role.alias("role"))
    named = [F.when(v.isNotNull(), person(v, F.lit(f))) for f in rule["fields"] for v in [_evaluate(text, *fields[f], fields)]]
    found = _pairs(text, rule, lambda role, name: person(strip_chars(name, rule["trim"]), F.lower(role)))
    return F.array_distinct(F.concat(F.array_compact(F.array(*named)), F.filter(found, lambda p: p["name"] != "")))


def _titled(text: Column, rule: dict) -> Column:
    """A find in capitals behind a fixed title, narrowed where a closer pattern occurs in it."""
    pattern = _FLAGS + rule["pattern"]
    whole = strip_chars(collapse(F.regexp_extract(text, pattern, rule["group"])), rule["trim"])
    close = F.regexp_extract(whole, _FLAGS + rule["narrow"], 1)
    title = F.concat(F.lit(rule["title"]), F.upper(F.when(close != "", close).otherwise(whole)))
    return F.when(text.rlike(pattern), title).otherwise(_evaluate(text, "first", rule["else"]))


def _bases(text: Column, rule: dict) -> Column:
    known = F.concat_ws("; ", *[F.when(text.rlike(_FLAGS + p), said) for p, said in rule["bases"]])
    return F.coalesce(F.nullif(known, F.lit("")), F.get(_steps(text, rule["else"]), F.lit(0)))


def _quoted(text: Column, rule: dict) -> Column:
    found = F.regexp_extract(text, _FLAGS + rule["pattern"], 0)
    return F.coalesce(F.when(found != "", F.concat(F.lit(rule["title"]), found)), F.get(_steps(text, rule["else"]), F.lit(0)))


def _word(text: Column, rule: list) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(needle), F.lit(name)) for needle, name in rule])


_KINDS = {
    "first": lambda text, rule: F.coalesce(*[search(text, p) for p in rule]),
    "list": _first_of,
    "flag": lambda text, rule: text.rlike(_FLAGS + rule),
    "snippet": _snippet,
    "clause": _clause,
    "signatures": _signatures,
    "titled": _titled,
    "bases": _bases,
    "quoted": _quoted,
    "word": _word,
}


def _evaluate(text: Column, kind: str, rule, fields: dict | None = None) -> Column:
    return _people(text, rule, fields) if kind == "people" else _KINDS[kind](text, rule)


def class_fields(text: Column | str, document_type: str) -> Column:
    """All fields of a type as one struct column."""
    text, fields = as_col(text), fv.CLASS_FIELDS[document_type]
    return F.struct(*[_evaluate(text, kind, rule, fields).alias(name) for name, (kind, rule) in fields.items()])


EXTRACTORS = {t: (lambda text, t=t: class_fields(text, t)) for t in fv.CLASS_FIELDS}
