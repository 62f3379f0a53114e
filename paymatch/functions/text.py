"""Text normalizers: vendor names, PO numbers, descriptions, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paymatch.functions.expr import col
from paymatch.policy import CORPORATE_WORDS, NOISE_WORDS, PO_PLACEHOLDERS

_CORPORATE = r"\b(?:" + "|".join(w.upper() for w in CORPORATE_WORDS) + r")\b"


def vendor_key(name) -> Column:
    """B1. Canonical vendor key.  The corporate words cannot merge with their neighbours when removed, so
    one alternation equals removing them one by one; the ampersand can, so it and AND follow in order."""
    x = F.regexp_replace(F.trim(F.upper(col(name))), r"[.,;:'\"\-]", " ")
    x = F.regexp_replace(x, _CORPORATE, "")
    x = F.regexp_replace(x, r"\b&\b", "")
    x = F.regexp_replace(x, r"\bAND\b", "")
    return F.coalesce(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def vendor_names_equivalent(a, b) -> Column:
    """B2."""
    present = F.coalesce(col(a), F.lit("")) != ""
    present = present & (F.coalesce(col(b), F.lit("")) != "")
    return present & (vendor_key(a) == vendor_key(b))


def ocr_aliases(name) -> Column:
    """B3. `Acme Tools Inc` -> `Acme, Tools Inc`; a name with commas loses them."""
    s = F.trim(col(name))
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    alias = F.when(F.contains(s, F.lit(",")), F.replace(s, F.lit(","), F.lit(""))).when(
        F.size(words) >= 2, F.concat(F.element_at(words, 1), F.lit(", "), rest))
    return F.filter(F.array_compact(F.array(alias)), lambda a: (a != "") & (a != s))


def po_key(value) -> Column:
    """B4. Upper case without dashes, blanks, dots and hashes."""
    return F.regexp_replace(F.upper(col(value)), r"[\-\s.#]", "")


def po_key_loose(value) -> Column:
    """The narrower variant of the stored-number lookup: only dashes and spaces are ignored."""
    return F.regexp_replace(F.upper(col(value)), r"[\- ]", "")


def valid_po_number(value, placeholders=PO_PLACEHOLDERS) -> Column:
    """B5. Trimmed PO number, NULL for placeholders."""
    s = safe_str(value)
    return F.when((s != "") & ~F.lower(s).isin(*placeholders), s)


def safe_str(value) -> Column:
    """B6."""
    return F.coalesce(F.trim(col(value).cast("string")), F.lit(""))


def safe_float(value, default: float = 0.0) -> Column:
    """B6. Blank, unparsable and NaN become the default."""
    c = col(value)
    x = c.try_cast("double")
    return F.coalesce(F.when(F.isnan(x), None).otherwise(x), F.lit(float(default)))


def header_key(name) -> Column:
    """B15. Column header to snake case."""
    return F.regexp_replace(F.lower(F.trim(col(name))), r"\s+", "_")


def description_key(desc) -> Column:
    """L1. Upper case, without noise words and punctuation."""
    words = F.filter(F.split(F.upper(F.trim(col(desc))), r"\s+"), lambda w: ~w.isin(*NOISE_WORDS))
    x = F.regexp_replace(F.array_join(words, " "), r"[^\w\s]", "")
    return F.coalesce(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def word_set(key) -> Column:
    """Distinct blank-separated tokens of an already normalized key."""
    return F.array_distinct(F.filter(F.split(col(key), " "), lambda w: w != ""))


def jaccard(a, b) -> Column:
    """Token overlap of two token sets; 0 when either is empty."""
    both = F.size(col(a)) + F.size(col(b))
    # a one-element array binds the intersection size, so that it is worked out once even inside a lambda
    common = F.array(F.size(F.array_intersect(col(a), col(b))))
    share = F.get(F.transform(common, lambda c: c / (both - c)), F.lit(0))
    return F.when((F.size(col(a)) > 0) & (F.size(col(b)) > 0), share).otherwise(F.lit(0.0))


def duplicate_vendor_key(name) -> Column:
    """The duplicate check compares names only up to case, dots and commas."""
    return F.translate(F.trim(F.upper(col(name))), ".,", "")
