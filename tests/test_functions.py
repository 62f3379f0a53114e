"""Expected values of the scalar functions on literal rows."""

from datetime import date

from pyspark.sql import functions as F

from paymatch.functions import fields as fld
from paymatch.functions import locale as loc
from paymatch.functions import text as txt


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).first()[0]


def test_vendor_key(spark):
    cases = {"Acme Corp.": "ACME", "Acme, Inc": "ACME", "Smith & Sons Ltd": "SMITH & SONS", "A&B Company": "AB", "AN&D Tools": "TOOLS", "Co-op Group": "OP", "": ""}
    for given, want in cases.items():
        assert one(spark, given, txt.vendor_key) == want, given


def test_po_numbers(spark):
    assert one(spark, "po-12 3.4#", txt.po_key) == "PO1234"
    assert one(spark, "po-12 3.4", txt.po_key_loose) == "PO123.4"
    for given, want in {" N/A ": None, "none": None, "": None, " PO-1 ": "PO-1", "Not Applicable": None}.items():
        assert one(spark, given, txt.valid_po_number) == want


def test_ocr_aliases(spark):
    assert one(spark, "Rogers Smith Hobbs", txt.ocr_aliases) == ["Rogers, Smith Hobbs"]
    assert one(spark, "Rogers, Smith", txt.ocr_aliases) == ["Rogers Smith"]
    assert one(spark, "Acme", txt.ocr_aliases) == []


def test_amounts(spark):
    for given, want in {"(1,234.50)": -1234.5, "$ 99": 99.0, "abc": None, "-5": -5.0, "": None, "1.2.3": None}.items():
        assert one(spark, given, loc.parse_amount) == want
    assert one(spark, "12,5", lambda c: loc.parse_amount(c, ",")) == 12.5
    assert one(spark, "1.234,5", lambda c: loc.parse_amount(c, ",")) == 1.2345


def test_currency_symbol_order(spark):
    for given, want in {"usd": "USD", "C$5": "USD", "€": "EUR", "dollars": "dollars", None: None}.items():
        assert one(spark, given, loc.normalize_currency) == want


def test_dates_and_terms(spark):
    for given, want in {"05/06/2024": date(2024, 6, 5), "12/25/2024": date(2024, 12, 25), "3 Jan 2024": date(2024, 1, 3), "January 3, 2024": date(2024, 1, 3), "2024-13-99": None, "soon": None}.items():
        assert one(spark, given, loc.parse_date) == want, given
    for given, want in {"Net 30": 30, "NET45": 45, "payment 14 days": 14, "due in 7 days": 7, "10 days after invoice": 10, "cash": None}.items():
        assert one(spark, given, loc.terms_days) == want


def test_charges(spark):
    for given, want in {"Fee": "handling", "Shipping & Handling": "shipping", "Volume Discount": "discount", "packing": "other", "": "other"}.items():
        assert one(spark, given, loc.categorize_charge) == want


def test_gate_and_presence(spark):
    rows = spark.createDataFrame([("PO-1", 0.95, "extracted"), ("PO-1", 0.75, "extracted"), ("PO-1", 0.5, "extracted"), ("PO-1", 0.99, "uncertain"), (None, 0.0, "not_found"), ("N/A", 0.9, "extracted")],
                                 "po_value string, po_conf double, po_status string")
    out = rows.select(fld.confidence_gate().alias("g"), fld.po_presence().alias("p"), fld.suggestion_mode().alias("s")).collect()
    assert [r.g for r in out] == ["trust", "validate", "expand", "validate", "expand", "trust"]
    assert [r.p for r in out] == ["po_invoice"] * 4 + ["non_po"] * 2
    assert [r.s for r in out] == [False, True, True, True, True, False]


def test_description_key(spark):
    assert one(spark, "The Box, of-4 for A user", txt.description_key) == "BOX OF4 USER"


def test_json_safe(spark):
    x = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),)], "x double").select(fld.json_safe("x").alias("y"))
    assert [r.y for r in x.collect()] == [1.5, None, None]


def test_half_up_matches_sql_steps(spark):
    from paymatch.functions.expr import half_up
    assert spark.range(1).select(half_up(F.lit(2.25), 1)).first()[0] == 2.3
