"""Vendor retrieval and vendor-and-amount search on literal masters with more orders than any cut."""

from datetime import date, datetime, timedelta

import pytest

from paymatch.operators import candidates as cand
from paymatch.plans.runtime import stage

PO = ("company_id string, po_number string, vendor_id string, vendor_name string, total_amount bigint, previously_invoiced bigint, currency string, "
      "status string, po_type string, issue_date date, expiry_date date, import_derived boolean")
RECORD = ("company_id string, source_record_id string, vendor_name string, invoice_number string, invoice_date date, invoice_total bigint, currency string, "
          "po_reference string, created_at timestamp")
INV = ("company_id string, document_id string, invoice_number string, vendor_name string, po_value string, po_conf double, po_status string, total_cents bigint")
D = date(2024, 6, 1)


def po(number, total=1000, vendor="V1", name="Acme Tools Inc", imported=False, prior=0):
    return ("C", number, vendor, name, total, prior, "USD", "open", "standard", D, None, imported)


def record(i, number, name="Acme Tools", total=500):
    return ("C", f"R{i:04d}", name, f"N{i}", D, total, "USD", number, datetime(2024, 1, 1) + timedelta(days=i))


@pytest.fixture
def world(spark):
    def build(pos=(), records=(), vendor="V1", total=900, name="Acme Tools", master="ACME TOOLS"):
        vendors = spark.createDataFrame([("C", "V1", "Acme Tools Inc", master)], "company_id string, vendor_id string, name string, normalized_name string")
        p, r = spark.createDataFrame(list(pos), PO), spark.createDataFrame(list(records), RECORD)
        inv = spark.createDataFrame([("C", "A", "N1", name, None, 0.0, "not_found", total)], INV)
        resolved = spark.createDataFrame([("C", name, vendor)], "company_id string, vendor_name string, vendor_id string")
        return inv, resolved, p, vendors, r, stage(cand.tenant_flags(p, r))
    return build


def found(df):
    return [(r.po_number, r.method, r.confidence) for r in df.orderBy("seq").collect()]


def test_repeated_orders_do_not_push_others_out(world):
    records = [record(100 + i, "PO-BLANKET") for i in range(70)] + [record(i, f"PO-{i}") for i in range(5)]
    hits = found(cand.by_vendor(*world(records=records, vendor=None), k=20))
    assert [h[0] for h in hits] == ["PO-BLANKET", "PO-4", "PO-3", "PO-2", "PO-1", "PO-0"] and {h[1:] for h in hits} == {("source_record", 0.72)}


def test_record_orders_beyond_the_name_cut_stay_name_hits(world):
    orders = [po(f"PO-{i:03d}", vendor="V9", imported=True) for i in range(100)]
    records = [record(i, f"PO-{i:03d}") for i in range(40, 100)]
    hits = found(cand.by_vendor(*world(orders, records, vendor=None), k=20))
    assert hits == [(f"PO-{i:03d}", "import_derived", 0.70) for i in range(20)]


@pytest.mark.parametrize("k", [None, 20])
def test_a_vendor_with_many_orders(world, k):
    orders = [po(f"PO-{i:03d}") for i in range(130)] + [po("PO-NAME", vendor="V2", name="ACME TOOLS, LLC")]
    hits = found(cand.by_vendor(*world(orders), k=k))
    want = [(f"PO-{i:03d}", "vendor_search", 0.75) for i in range(130)] + [("PO-NAME", "vendor_name", 0.70)]
    assert hits == want[:k]


def test_amounts_of_any_size(world):
    for total in (4**20, 4**20 + 5, 2**62, 2**63 - 1):
        hits = found(cand.by_vendor_amount(*world([po("PO-1", total)], total=total)))
        assert hits == [("PO-1", "unique_vendor_amount", 0.95)]
        assert not found(cand.by_vendor_amount(*world([po("PO-1", total // 2)], total=total)))


def test_amount_search_covers_all_four_sources(world):
    orders = [po("PO-ID", name="Other"), po("PO-OWN", vendor="V7"), po("PO-MASTER", vendor="V1", name="Other")]
    by_master = world(orders[2:], vendor=None)
    assert [h[0] for h in found(cand.by_vendor_amount(*by_master))] == ["PO-MASTER"]
    everything = found(cand.by_vendor_amount(*world(orders, [record(1, "PO-REC", total=950), record(2, "PO-LOW", total=500), record(3, "PO-ID", total=990)])))
    assert [h[0] for h in everything] == ["PO-REC"]  # the company imported data, so only imported orders show
    own = found(cand.by_vendor_amount(*world(orders)))
    assert {h[0] for h in own} == {"PO-ID", "PO-OWN", "PO-MASTER"} and {h[2] for h in own} == {0.85}


def test_amount_search_keeps_ten_in_list_order(world):
    orders = [po(f"PO-{i:03d}", 10_000 + i) for i in range(60)] + [po("PO-TIGHT", 850)]
    hits = found(cand.by_vendor_amount(*world(orders)))
    assert [h[0] for h in hits] == [f"PO-{i:03d}" for i in range(10)]
