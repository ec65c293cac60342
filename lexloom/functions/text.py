"""Text kernel: Column functions with no shuffle and no Python.

Regular expressions follow one convention. ``(?U)`` makes ``\\w \\s \\b`` Unicode-aware, ``(?d)``
makes a line end mean ``\\n`` only, so that a pattern behaves the same on text in any language.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv

WS = r"(?U)\s+"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(as_col(text), r"(?U)\A\s+|\s+\z", "")


def collapse(text: Column | str) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.btrim(F.regexp_replace(as_col(text), WS, " "))


def strip_chars(text: Column | str, chars: str) -> Column:
    return F.btrim(as_col(text), F.lit(chars))


def words(text: Column | str) -> Column:
    """White-space tokens, without empty ones."""
    return F.array_remove(F.split(as_col(text), WS), "")


def word_total(text: Column | str) -> Column:
    return F.size(words(text))


def find_all(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(as_col(text), F.lit(pattern), F.lit(group))


def first_match(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The first match's group, NULL when the pattern does not occur."""
    col = as_col(text)
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def search(text: Column | str, pattern: str, groups: int = 1, flags: str = "iUd") -> Column:
    """First non-empty group of the first match, collapsed; NULL when it holds a placeholder."""
    col = as_col(text)
    full = f"(?{flags}){pattern}"
    parts = [F.nullif(F.regexp_extract(col, full, g), F.lit("")) for g in range(1, groups + 1)]
    value = parts[0] if len(parts) == 1 else F.coalesce(*parts)
    return F.when(~value.contains("{"), F.nullif(collapse(value), F.lit("")))


def holds_any(text: Column, *parts: str) -> Column:
    """Whether one of some plain parts occurs: before a pattern, as each of its matches holds one of them.

    On a lower-case text the parts have no s, k or i, as a pattern takes some letters outside ASCII for these.
    """
    return reduce(Column.__or__, [text.contains(p) for p in parts])


def snippet(text: Column | str, needle: Column | str, window: int = 100) -> Column:
    """The needle's first occurrence, ignoring case, with ``window`` characters on both sides."""
    text, needle = as_col(text), as_col(needle)
    at = F.instr(F.lower(text), F.lower(needle)) - 1
    start = F.greatest(F.lit(0), at - window)
    piece = F.substring(text, start + 1, at + F.length(needle) + window - start)
    return F.when((needle != "") & (at >= 0), collapse(piece))


def repair_scanned_text(text: Column | str, mode: str = "faithful") -> Column:
    """Undo frequent character confusions of scanned text and drop unrendered placeholders.

    ``faithful`` ignores case in every rule, which also rewrites ordinary words that begin with
    the letter l; ``case_sensitive`` keeps those words.
    """
    if mode not in ("faithful", "case_sensitive"):
        raise ValueError(f"unknown mode {mode!r}")
    folded = mode == "faithful"
    out = as_col(text)
    for pattern, replacement in fv.REPAIR_RULES:
        out = _repaired(out, pattern, replacement, folded)
    return bind(out, lambda o: F.when(o.contains("{"), F.regexp_replace(o, fv.PLACEHOLDER, "")).otherwise(o))


#: Letters outside ASCII that a pattern takes for an ASCII one when it ignores case.
_FOLDED = {"s": "\u017f", "k": "\u212a", "i": "\u0130\u0131"}


def rule_literal(pattern: str) -> str:
    """The longest run of letters and digits that every match of a repair rule contains."""
    plain = re.sub(r"\(\?.*?\)|\[[^\]]*\]|\{[^}]*\}|\\.|[^A-Za-z0-9]", " ", pattern)
    return max(plain.split(), key=len)


def _repaired(text: Column, pattern: str, replacement: str, folded: bool) -> Column:
    """One rule. Its pattern runs only on a text that holds the rule's literal, and tests a place's first
    character before its word boundary."""
    literal = rule_literal(pattern)
    quick = re.sub(r"\A\\b(\w)", r"(?=\1)\\b\1", pattern)

    def replaced(o: Column) -> Column:
        possible = (F.lower(o) if folded else o).contains(literal.lower() if folded else literal)
        for letter, others in _FOLDED.items() if folded else ():
            for other in others if letter in literal.lower() else "":
                possible = possible | o.contains(other)
        fixed = F.regexp_replace(o, ("(?iU)" if folded else "(?U)") + quick, replacement)
        return F.when(possible, fixed).otherwise(o)

    return bind(text, replaced)


def currency_amount(text: Column | str) -> Column:
    """The first currency-like number as double."""
    # The pattern's group is never empty, and blanks around it are no part of it.
    digits = F.nullif(F.regexp_extract(as_col(text), fv.CURRENCY, 1), F.lit(""))
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def digits_amount(text: Column | str) -> Column:
    """Everything but digits, points and minus signs dropped, then read as a number."""
    col = as_col(text)
    cleaned = F.regexp_replace(col, r"[^\d.\-]", "")
    return F.when(~col.contains("{"), cleaned.try_cast("double"))


def schema_number(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), r"[^0-9.\-]", "").try_cast("double")


def iso_date(text: Column | str) -> Column:
    """The first of the accepted date formats that fits, as an ISO string.

    Two-digit years above 68 belong to the previous century.
    """
    shape = {
        "yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}",
        "M": r"\d{1,2}", "d": r"\d{1,2}",
    }

    def parsed(raw: Column) -> Column:
        tries = []
        for fmt in fv.DATE_FORMATS:
            guard = re.sub("yyyy|yy|MMMM|MMM|M|d", lambda m: shape[m.group(0)], fmt)
            guard = guard.replace(" ", r"\s+")
            value = F.try_to_timestamp(F.initcap(F.regexp_replace(raw, r"\s+", " ")), F.lit(fmt))
            if fmt.endswith("/yy"):
                value = F.when(
                    F.year(value) > 2068, F.add_months(value, -1200).cast("timestamp")
                ).otherwise(value)
            tries.append(F.when(raw.rlike(rf"\A{guard}\z"), value))
        # Every accepted form has a digit and ends with one.
        return F.when(raw.rlike(r"\d\z"), F.date_format(F.coalesce(*tries), "yyyy-MM-dd"))

    return bind(strip(text), parsed)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    An expression named inside a lambda is computed again for every element; a bound one is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unpack(df, keys: list, array: Column, present: str):
    """One row per struct of an array whose field ``present`` is never NULL.

    The outer form with a filter behind it: for the plain form the optimizer adds a size test in
    front, which computes an expensive array a second time.
    """
    return df.select(*keys, F.inline_outer(array)).where(F.col(present).isNotNull())


def with_fixed(df, name: str, value: Column):
    """Adds a column that a later filter uses as it is.

    A filter on a plain column moves in front of it with the whole expression, which is then computed once for each
    of its uses, and makes code too long to be compiled; it does not move in front of a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def distinct_ignore_case(values: Column | str) -> Column:
    """Keep the first spelling of each value, in order. Sorts instead of searching, so a long
    list costs n log n."""
    keyed = F.array_sort(
        F.transform(
            as_col(values),
            lambda v, i: F.struct(F.lower(v).alias("key"), i.alias("at"), v.alias("value")),
        )
    )

    def firsts(ordered: Column) -> Column:
        kept = F.filter(
            ordered,
            lambda o, i: (i == 0) | (o["key"] != F.get(ordered, F.greatest(i - 1, F.lit(0)))["key"]),
        )
        back = F.array_sort(
            F.transform(kept, lambda o: F.struct(o["at"].alias("at"), o["value"].alias("value")))
        )
        return F.transform(back, lambda o: o["value"])

    return bind(keyed, firsts)


def token_set(text: Column | str) -> Column:
    """Distinct lower-case ASCII tokens of three characters or more."""
    return F.array_distinct(
        F.transform(find_all(text, r"[a-zA-Z0-9]{3,}", 0), lambda t: F.lower(t))
    )


def fraction_of(part: Column, whole: Column) -> Column:
    """Share of ``whole`` that also occurs in ``part``; 0.0 for an empty ``whole``."""
    return bind(
        whole,
        lambda w: F.when(
            F.size(w) > 0, F.size(F.array_intersect(part, w)) / F.size(w)
        ).otherwise(F.lit(0.0)),
    )


def round_even(value: Column | str, digits: int) -> Column:
    """Round the exact binary value, ties to even.

    A named column is scaled, rounded and divided where its product is not near a tie: the quotient of a whole number
    and a power of ten is the double next to that decimal. Near ties and for very large values the digits are written out.
    """
    col = as_col(value)
    exact = F.replace(F.format_number(col, digits), F.lit(","), F.lit("")).cast("double")
    if not isinstance(value, str):
        return exact  # an expression would be computed once for each use
    scaled = col.cast("double") * 10.0**digits
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.rint(scaled)) < 0.499999)
    return F.when(plain, F.rint(scaled) / 10.0**digits).otherwise(exact)


def set_path(struct: Column, path: str, value: Column) -> Column:
    """Replace a (nested) struct field given by a dotted path."""
    return struct.withField(path, value)


def set_map_path(payload: Column | str, path: str, value: Column) -> Column:
    """Set a dotted key of a ``map<string,string>`` payload, replacing an earlier value."""
    col = as_col(payload)
    rest = F.map_filter(col, lambda k, _: k != F.lit(path))
    return F.map_concat(rest, F.create_map(F.lit(path), value))


def clean_reply(raw: Column | str) -> Column:
    """A model reply as JSON text: fences stripped, else the outermost object, else that object
    with its trailing commas removed. NULL when none of them parses."""
    col = strip(raw)
    body = F.regexp_replace(F.regexp_replace(col, r"(?i)\A```(?:json)?\s*", ""), r"\s*```\z", "")
    block = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    relaxed = F.regexp_replace(block, r",\s*([}\]])", "$1")

    def parsed(candidate: Column) -> Column:
        return F.when(F.try_parse_json(candidate).isNotNull(), candidate)

    return F.coalesce(parsed(body), parsed(block), parsed(relaxed))


def join_expansion(query: Column | str, expansion: Column | str, always: bool = False) -> Column:
    """Query text extended by its expansion. ``always`` appends without looking at the overlap."""
    query, extra = strip(query), strip(expansion)
    both = F.concat_ws(" ", query, extra)
    out = F.when(F.coalesce(extra, F.lit("")) == "", query)
    if not always:
        out = out.when(query == "", query)
        out = out.when(F.lower(extra) == F.lower(query), query)
        out = out.when(F.startswith(F.lower(extra), F.lower(query)), extra)
    return out.otherwise(both)
