"""Field validators as struct-returning column functions, and the runner by document type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions.text import as_col, bind, currency_amount, iso_date, strip


def _result(normalized: Column, valid: Column, reason: Column) -> Column:
    return F.struct(
        normalized.cast("string").alias("normalized_value"),
        valid.alias("valid"),
        reason.alias("reason"),
    )


def _quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'"))


def _blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def check_date(value: Column | str) -> Column:
    raw = as_col(value)
    told = F.concat(
        F.lit("unrecognised date format: "), _quoted(strip(F.coalesce(raw, F.lit(""))))
    )
    return bind(
        iso_date(raw),
        lambda iso: _result(
            F.coalesce(iso, raw), iso.isNotNull(), F.when(iso.isNotNull(), "ok").otherwise(told)
        ),
    )


def check_amount(value: Column | str, field: str) -> Column:
    raw = as_col(value)

    def judged(number: Column) -> Column:
        reason = (
            F.when(raw.isNull(), f"{field} is missing")
            .when(
                number.isNull(),
                F.concat(F.lit(f"{field}: cannot parse "), _quoted(raw), F.lit(" as amount")),
            )
            .when(number < 0, F.concat(F.lit(f"{field}: negative amount "), number.cast("string")))
            .when(
                number > fv.LARGEST_AMOUNT,
                F.concat(F.lit(f"{field}: suspiciously large "), F.format_number(number, 2)),
            )
            .otherwise("ok")
        )
        return bind(
            reason,
            lambda told: _result(F.coalesce(number.cast("string"), raw), told == "ok", told),
        )

    return bind(currency_amount(raw), judged)


def check_invoice_number(value: Column | str) -> Column:
    raw = as_col(value)
    blank = _blank(raw)

    def judged(code: Column) -> Column:
        fits = F.coalesce(code.rlike("(?iU)" + fv.INVOICE_ID), F.lit(False))
        told = F.concat(
            F.lit("invoice_number "), _quoted(raw), F.lit(" does not match expected pattern")
        )
        return bind(
            fits,
            lambda ok: _result(
                F.when(blank, None).when(ok, code).otherwise(raw),
                ~blank & ok,
                F.when(blank, "invoice_number is missing").when(ok, "ok").otherwise(told),
            ),
        )

    return bind(F.upper(strip(raw)), judged)


def check_account_number(value: Column | str) -> Column:
    raw = as_col(value)
    text = strip(raw)
    iban = F.coalesce(F.replace(text, F.lit(" "), F.lit("")).rlike(fv.IBAN), F.lit(False))
    digits = F.coalesce(text.rlike(fv.ACCOUNT_DIGITS), F.lit(False))
    reason = (
        F.when(_blank(raw), "account_number is missing")
        .when(iban, "ok (IBAN)")
        .when(digits, "ok")
        .otherwise(
            F.concat(
                F.lit("account_number "), _quoted(raw), F.lit(" does not match expected format")
            )
        )
    )
    normal = F.when(_blank(raw), None).when(iban | digits, text).otherwise(raw)
    return _result(normal, ~_blank(raw) & (iban | digits), reason)


def check_statement_period(value: Column | str) -> Column:
    raw = as_col(value)
    text = strip(raw)
    parted = text.rlike("(?iU)" + fv.PERIOD_SEPARATOR) | text.contains("/")
    fits = F.coalesce(parted & text.rlike("(?U)" + fv.PERIOD_YEAR), F.lit(False))
    reason = (
        F.when(_blank(raw), "statement_period is missing")
        .when(fits, "ok")
        .otherwise(
            F.concat(
                F.lit("statement_period "), _quoted(raw), F.lit(": could not identify two dates")
            )
        )
    )
    normal = F.when(_blank(raw), None).when(fits, text).otherwise(raw)
    return _result(normal, ~_blank(raw) & fits, reason)


def _fixed(value: Column, digits: int) -> Column:
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def _percent(value: Column) -> Column:
    return F.concat(_fixed(value * 100, 1), F.lit("%"))


def check_total(subtotal: Column, tax: Column, total: Column, tolerance: float = 0.05) -> Column:
    """Subtotal plus tax against the total, relative to the total."""

    def judged(x: Column) -> Column:
        sub, add, whole = x["subtotal"], x["tax"], x["total"]
        error = F.abs(sub + add - whole) / F.nullif(whole, F.lit(0.0))
        reason = (
            F.when(sub.isNull() | add.isNull() | whole.isNull(), "skip (incomplete)")
            .when(whole == 0, "total is zero")
            .when(
                error > tolerance,
                F.concat(
                    F.lit("subtotal("), sub.cast("string"), F.lit(") + tax("), add.cast("string"),
                    F.lit(") = "), _fixed(sub + add, 2), F.lit(" but total = "), _fixed(whole, 2),
                    F.lit(" (error "), _percent(error), F.lit(")"),
                ),
            )
            .otherwise("ok")
        )
        return bind(
            reason, lambda told: _result(F.lit(None), told.isin("ok", "skip (incomplete)"), told)
        )

    return bind(
        F.struct(subtotal.alias("subtotal"), tax.alias("tax"), total.alias("total")), judged
    )


def check_balances(
    opening: Column,
    closing: Column,
    available: Column,
    net: Column | None = None,
    tolerance: float = 0.02,
) -> Column:
    """Closing against available, and opening plus movements against closing."""

    def judged(x: Column) -> Column:
        first, last, free, moved = x["opening"], x["closing"], x["available"], x["net"]
        scale = F.abs(F.nullif(last, F.lit(0.0)))
        gap = F.abs(last - free) / scale
        computed = first + moved
        drift = F.abs(computed - last) / scale
        told = F.concat_ws(
            "; ",
            F.when(
                gap > tolerance,
                F.concat(
                    F.lit("closing("), last.cast("string"), F.lit(") vs available("),
                    free.cast("string"), F.lit("): "), _percent(gap), F.lit(" discrepancy"),
                ),
            ),
            F.when(
                drift > tolerance,
                F.concat(
                    F.lit("opening("), first.cast("string"), F.lit(") + net("), _fixed(moved, 2),
                    F.lit(") = "), _fixed(computed, 2), F.lit(" vs closing("),
                    last.cast("string"), F.lit("): "), _percent(drift),
                ),
            ),
        )
        return bind(
            told, lambda t: _result(F.lit(None), t == "", F.when(t == "", "ok").otherwise(t))
        )

    moved = F.lit(None).cast("double") if net is None else net
    return bind(
        F.struct(
            opening.alias("opening"), closing.alias("closing"), available.alias("available"),
            moved.alias("net"),
        ),
        judged,
    )


def _named(field: str, raw: Column, check) -> Column:
    """One check as a row. The value is looked up once and not at each of its uses in ``check``."""
    return bind(
        raw,
        lambda value: bind(
            check(value),
            lambda r: F.struct(
                F.lit(field).alias("field"),
                value.cast("string").alias("raw_value"),
                r["normalized_value"].alias("normalized_value"),
                r["valid"].alias("valid"),
                r["reason"].alias("reason"),
            ),
        ),
    )


def _failed(raw: Column, check) -> Column:
    return bind(raw, lambda value: bind(check(value), lambda r: F.when(~r["valid"], r["reason"])))


_RESULTS = (
    "array<struct<field:string,raw_value:string,normalized_value:string,valid:boolean,reason:string>>"
)


def _checks(values: Column) -> tuple[dict, dict]:
    """The checks of an invoice and of a bank statement in order: field to (value, check)."""
    none = F.lit(None).cast("string")
    sums, balances = ("subtotal", "tax", "total_amount"), ("opening_balance", "closing_balance", "available_balance")

    def amounts(fields: tuple) -> dict:
        return {f: (values[f], lambda value, f=f: check_amount(value, f)) for f in fields}

    invoice = {
        "invoice_number": (values["invoice_number"], check_invoice_number),
        "invoice_date": (values["invoice_date"], check_date),
        "due_date": (values["due_date"], check_date),
        **amounts(sums),
        "_cross_total": (none, lambda _: check_total(*[currency_amount(values[f]) for f in sums])),
    }
    statement = {
        "account_number": (values["account_number"], check_account_number),
        "statement_period": (values["statement_period"], check_statement_period),
        **amounts(balances),
        "_cross_balance": (none, lambda _: check_balances(*[currency_amount(values[f]) for f in balances])),
    }
    return invoice, statement


def validation_results(fields: Column | str, document_type: Column | str) -> Column:
    """All checks of an invoice or a bank statement over ``map<string,string>`` fields.

    Other document types have none.
    """
    kind = as_col(document_type)
    invoice, statement = (
        F.array(*[_named(field, raw, check) for field, (raw, check) in checks.items()]).cast(_RESULTS)
        for checks in _checks(as_col(fields))
    )
    return (
        F.when(kind == "invoice", invoice)
        .when(kind == "bank_statement", statement)
        .otherwise(F.array().cast(_RESULTS))
    )


def failed_reason(field: Column | str, fields: Column | str, document_type: Column | str) -> Column:
    """Why the check of one field failed, NULL when it did not or the document's type has none for it.

    Only the check of that field runs, so a row of a long field table needs no join with the results.
    """
    name, kind = as_col(field), as_col(document_type)
    out = F.lit(None).cast("string")
    for document, checks in zip(("invoice", "bank_statement"), _checks(as_col(fields))):
        for own, (raw, check) in checks.items():
            out = F.when((kind == document) & (name == own), _failed(raw, check)).otherwise(out)
    return out


def validate_documents(df: DataFrame, key: str = "document_id") -> DataFrame:
    """Long form with the position of each check. No shuffle."""
    return df.select(
        key,
        "document_type",
        F.posexplode_outer(validation_results("fields", "document_type")).alias("position", "r"),
    ).where("r IS NOT NULL").select(key, "document_type", "position", "r.*")
