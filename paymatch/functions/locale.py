"""Amounts, currencies, units, dates, payment terms and charge labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paymatch.functions.expr import col
from paymatch.policy import (CHARGE_LABELS, CURRENCY_SYMBOLS, DATE_PATTERNS, TERMS_PATTERNS, UNIT_ALIASES)


def parse_amount(raw, decimal_sep=".") -> Column:
    """B7. Printed amount to double: `(1,234.50)` is negative; a decimal comma only where the locale says so."""
    s = F.trim(col(raw).cast("string"))
    sep = col(decimal_sep) if isinstance(decimal_sep, Column) else F.lit(decimal_sep)
    negative = F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")"))
    digits = F.regexp_replace(s, r"[^\d,.\-]", "")
    commas = F.length(digits) - F.length(F.translate(digits, ",", ""))
    european = (sep == ",") & (commas == 1) & ~F.contains(digits, F.lit("."))
    plain = F.when(european, F.translate(digits, ",", ".")).otherwise(F.translate(digits, ",", ""))
    value = F.when(plain != "", plain.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def to_cents(amount) -> Column:
    """Money enters the engine once, as integer cents."""
    return F.floor(col(amount) * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def normalize_currency(value) -> Column:
    """B8. Three letters are a code; else the first listed symbol contained wins, so C$ reads as USD."""
    raw = col(value)
    code = F.upper(F.trim(raw))
    out = F.when(raw.isNull(), None).when(code.rlike("^[A-Za-z]{3}$"), code)
    for symbol, iso in CURRENCY_SYMBOLS:
        out = out.when(F.contains(raw, F.lit(symbol)), F.lit(iso))
    return out.otherwise(raw)


def normalize_unit(value) -> Column:
    """B9."""
    key = F.lower(F.trim(col(value)))
    out = F.when(F.coalesce(col(value), F.lit("")) == "", None)
    for alias, unit in UNIT_ALIASES.items():
        out = out.when(key == alias, F.lit(unit))
    return out.otherwise(key)


def normalize_lines(lines: Column, decimal_sep=".") -> Column:
    """B10. On ARRAY<STRUCT<quantity, unit_price, amount, uom>> of raw strings."""
    def one(x: Column) -> Column:
        qty, price, amount = (parse_amount(x[f], decimal_sep) for f in ("quantity", "unit_price", "amount"))
        given = x["amount"].isNotNull()
        derived = F.when((qty != 0) & (price != 0), F.floor(qty * price * 10000.0 + 0.5) / 10000.0)
        return F.struct(qty.alias("quantity"), price.alias("unit_price"),
                        F.when(given, amount).otherwise(derived).alias("amount"),
                        normalize_unit(x["uom"]).alias("uom"))
    return F.transform(lines, one)


def reconciliation_mode(n_tax_components, n_lines, subtotal_cents, tax_cents, total_cents, given) -> Column:
    """B11. Amounts of zero count as absent, as in the checks that follow."""
    sub, total = F.nullif(col(subtotal_cents), F.lit(0)), F.nullif(col(total_cents), F.lit(0))
    tax = F.coalesce(col(tax_cents), F.lit(0))
    full = sub.isNotNull() & total.isNotNull() & (tax != 0)
    return (F.when(col(n_tax_components) > 1, "multi_tax")
            .when((col(n_lines) > 0) & sub.isNull() & total.isNotNull(), "lines_only")
            .when(total.isNotNull() & (col(n_lines) == 0), "header_only")
            .when(full & (F.abs(sub + tax - total) < 2), "tax_exclusive")
            .when(full & (F.abs(sub - total) < 2), "tax_inclusive")
            .otherwise(F.coalesce(F.nullif(col(given), F.lit("")), F.lit("tax_exclusive"))))


def parse_date(value) -> Column:
    """B12. Day-first wins over month-first; impossible dates are NULL."""
    s = F.trim(col(value))
    iso = s.rlike(r"^\d{4}-\d{2}-\d{2}$")
    tried = F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(p))) for p in DATE_PATTERNS])
    return F.when(iso, s.try_cast("date")).otherwise(tried)


def terms_days(terms) -> Column:
    """B13. Days in a payment-terms text."""
    text = F.lower(col(terms))
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("int") for p in TERMS_PATTERNS]
    return F.coalesce(*found)


def due_date(invoice_date, terms) -> Column:
    """B13."""
    return F.date_add(col(invoice_date), terms_days(terms))


def categorize_charge(label) -> Column:
    """B14. Containment counts in both directions, so a bare `fee` is a processing fee."""
    x = F.lower(F.trim(col(label)))
    out = F.when(F.coalesce(col(label), F.lit("")) == "", F.lit("other"))
    for category, patterns in CHARGE_LABELS:
        hit = None
        for p in patterns:
            cond = F.contains(x, F.lit(p)) | F.contains(F.lit(p), x)
            hit = cond if hit is None else hit | cond
        out = out.when(hit, F.lit(category))
    return out.otherwise(F.lit("other"))
