"""Line assignment, scores and match states on small literal tables."""

from datetime import date

from pyspark.sql import functions as F

from paymatch.operators import lines as ln
from paymatch.operators import matching as mat
from paymatch.operators import scoring as sc
from paymatch.policy import MATCH

INV = ("company_id string, document_id string, invoice_number string, vendor_name string, po_value string, po_conf double, po_status string, "
       "invoice_date date, currency string, total_cents bigint, refs array<struct<type:string,value:string>>")
PO = ("company_id string, po_number string, vendor_id string, vendor_name string, total_amount bigint, previously_invoiced bigint, currency string, "
      "status string, po_type string, issue_date date, expiry_date date, import_derived boolean")
D = date(2024, 6, 1)


def masters(spark, pos, lines=(), grn=()):
    vendors = spark.createDataFrame([("C", "V1", "Acme Tools Inc", [], "active", "ACME TOOLS")],
                                    "company_id string, vendor_id string, name string, aliases array<string>, status string, normalized_name string")
    return mat.Masters(
        vendors, spark.createDataFrame(pos, PO),
        spark.createDataFrame(list(lines), "company_id string, po_number string, line_number bigint, description string, sku string, quantity bigint, unit_price bigint"),
        spark.createDataFrame(list(grn), "company_id string, po_number string, received_amount bigint"),
        spark.createDataFrame([], "company_id string, po_number string, reference_type string, reference_value string"),
        spark.createDataFrame([], "company_id string, source_record_id string, vendor_name string, invoice_number string, invoice_date date, invoice_total bigint, currency string, po_reference string, created_at timestamp"))


def po(number, total, prior=0, status="open", kind="blanket", vendor="V1", name="Acme Tools Inc"):
    return ("C", number, vendor, name, total, prior, "USD", status, kind, D, None, False)


def invoice(doc, total, po_value=None, conf=0.0, vendor="Acme Tools"):
    return ("C", doc, f"N{doc}", vendor, po_value, conf, "extracted" if po_value else "not_found", D, "USD", total, [])


def run(spark, invoices, m, lines=()):
    inv = spark.createDataFrame(invoices, INV)
    il = spark.createDataFrame(list(lines), "company_id string, document_id string, line_no bigint, description string, quantity bigint, unit_price bigint")
    return {r.document_id: r for r in mat.match_invoices(inv, il, m, "2024-06-02").collect()}


def test_single_open_order_matches_without_number(spark):
    r = run(spark, [invoice("A", 30046)], masters(spark, [po("PO-1", 1000000)]))["A"]
    assert (r.match_status, r.provenance, r.matched_pos[0].po_number) == ("high_confidence_match", "evidence", "PO-1")


def test_two_equal_orders_are_ambiguous(spark):
    r = run(spark, [invoice("A", 50000)], masters(spark, [po("PO-1", 50000), po("PO-2", 50000)]))["A"]
    assert r.match_status == "ambiguous_match"
    assert [p.po_number for p in r.matched_pos] == ["PO-1", "PO-2"]


def test_closed_order_goes_to_review(spark):
    r = run(spark, [invoice("A", 50000, "PO-1", 0.95)], masters(spark, [po("PO-1", 50000, status="closed")]))["A"]
    assert r.match_status == "closed_po_review" and r.flags == ["closed_po_exception"]


def test_trusted_number_that_is_unknown_waits(spark):
    r = run(spark, [invoice("A", 50000, "XX-9", 0.95)], masters(spark, [po("PO-1", 50000)]))["A"]
    assert r.match_status == "waiting_for_po" and r.candidate_count == 0


def test_split_billing_fits_the_remaining_balance(spark):
    m = masters(spark, [po("PO-1", 1000000, prior=400000)])
    out = run(spark, [invoice("A", 350000, "PO-1", 0.95), invoice("B", 700000, "PO-1", 0.95)], m)
    assert out["A"].match_status == "high_confidence_match" and out["A"].flags == []
    assert out["B"].flags == ["overbilling_warning"]


def test_unresolved_vendor_without_orders(spark):
    r = run(spark, [invoice("A", 100, vendor="Nobody Ever")], masters(spark, [po("PO-1", 100)]))["A"]
    assert r.match_status == "unmatched" and r.vendor_master_status == "unresolved"


def test_assignment_is_one_to_one_and_greedy(spark):
    il = spark.createDataFrame([("C", "A", 1, "blue widget", 5, 100), ("C", "A", 2, "blue widget", 5, 100), ("C", "A", 3, "zzz", None, None)],
                               "company_id string, document_id string, line_no bigint, description string, quantity bigint, unit_price bigint")
    pl = spark.createDataFrame([("C", "P", 1, "blue widget large", None, 5, 100), ("C", "P", 2, "blue widget", "SK", 5, 100)],
                               "company_id string, po_number string, line_number bigint, description string, sku string, quantity bigint, unit_price bigint")
    pairs = spark.createDataFrame([("C", "A", "P")], "company_id string, document_id string, po_number string")
    maps = ln.match_lines(pairs, il, pl).first().maps
    assert [(m.po_line, m.match_type) for m in maps] == [(2, "semantic"), (1, "semantic"), (0, "unmatched")]


def test_score_parts(spark):
    x = spark.createDataFrame([(100, 100), (104, 100), (120, 100), (None, 100), (50, 0)], "t bigint, r bigint")
    assert [r[0] for r in x.select(sc.score_amount(F.col("t"), F.col("r"))).collect()] == [10.0, 5.0, 1.0, 0.0, 0.0]
    d = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 20)), (date(2024, 1, 1), date(2024, 3, 15)), (date(2024, 1, 1), date(2024, 6, 1)), (date(2024, 1, 1), date(2025, 1, 1)), (None, D)], "a date, b date")
    assert [r[0] for r in d.select(sc.score_date(F.col("a"), F.col("b"))).collect()] == [5.0, 3.5, 2.0, 0.5, 0.0]
    assert MATCH.max_candidates == 20
