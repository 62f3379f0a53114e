"""Saved column maps of sources whose headers recur, and rows that are decided without the maps they come from."""

from paymatch.operators import imports as im
from paymatch.operators.vendors import vendor_key


def test_a_header_with_two_fields_is_kept_once_in_the_map(spark):
    rows = [("S", "po", "PO", "po_number", 0.95, "auto"), ("S", "po", " po ", "po_type", 0.75, "review"), ("S", "po", "Total", "total_amount", 0.75, "review"),
            ("S", "po", "x", None, 0.0, "metadata"), ("T", "po", "PO", "po_number", 0.95, "auto")]
    got = im.mapping_profile(spark.createDataFrame(rows, "source_id string, entity string, source_column string, canonical_field string, confidence double, status string")).collect()
    assert {r.source_id: r.column_map for r in got} == {"S": {"po": "po_number", "total": "total_amount"}, "T": {"po": "po_number"}}
    assert {r.source_id: [tuple(m) for m in r.mappings] for r in got}["S"] == [("po", "po_number"), ("po", "po_type"), ("total", "total_amount")]


def test_rows_with_few_columns_kept_get_the_same_status(spark):
    kinds = [("purchase_order", {"po_number": "PO-1", "vendor_name": "Acme", "total_amount": "5"}), ("purchase_order", {"po_number": " PO-1 ", "vendor_name": "Acme", "total_amount": "5"}),
             ("purchase_order", {"po_number": "N/A"}), ("purchase_order", {"po_number": "PO-2", "total_amount": "5"}), ("purchase_order", {"po_number": "PO-3", "vendor_name": "Acme", "total_amount": "nan"}),
             ("line", {"po_number": "PO-1", "line_number": "2"}), ("line", {"po_number": "PO-9", "line_number": "0"}), ("line", {"po_number": "PO-8", "line_number": "1"}), ("line", {}),
             ("invoice_transaction", {"vendor_name": "Acme", "invoice_total": "-1"}), ("invoice_with_po_reference", {"vendor_name": "Acme"}), ("invoice_transaction", {}),
             ("vendor", {"name": "Acme"}), ("vendor", {}), ("grn", {"po_number": "PO-1"}), ("grn", {}), ("reference", {"po_number": "PO-1", "reference_value": "R"}), ("reference", {"po_number": "PO-1"}), ("unclassified", {})]
    rows = spark.createDataFrame([("C" if i else None, i, {}, c, {"total": "7"} if i == 4 else {}, k) for i, (k, c) in enumerate(kinds + [("line", None)])],
                                 "company_id string, row_id long, raw map<string,string>, canonical map<string,string>, metadata map<string,string>, record_type string")
    vendors = spark.createDataFrame([("C", "V1", "Acme", None, None)], "company_id string, vendor_id string, name string, supplier_code string, tax_id string").withColumn("normalized_name", vendor_key("name"))
    open_pos = spark.createDataFrame([("C", "PO-9")], "company_id string, po_number string")
    status = lambda x: sorted((r.row_id, r.record_type, r.row_status, r.issue) for r in x.select("row_id", "record_type", "row_status", "issue").collect())
    few = im.canonicalize(rows, open_pos, vendors, False, ("row_id", "record_type"))
    assert "canonical" not in few.columns
    got = status(few)
    assert got == status(im.canonicalize(rows, open_pos, vendors, False)) and len(got) == 20
    assert [s for _, _, s, _ in got] == ["ready", "ready", "skipped", "blocked", "ready", "ready", "blocked", "blocked", "blocked", "blocked", "blocked", "blocked",
                                         "ready", "blocked", "ready", "blocked", "ready", "blocked", "skipped", "blocked"]
