"""Vendors of imported rows: near names count as one, several near names call for a review."""

from difflib import SequenceMatcher

from paymatch.operators import imports as im
from paymatch.operators.vendors import vendor_key

BOOK = ["Northwind Steel Works 12", "Acme Paper Goods 71", "Acme Paper Goods 72", "Global Freight Carriers", "Zeta"]
NAMES = ["Northwind Steel Works 13", "Nrthwind Steel Works 12", "Acme Paper Goods 73", "Acme Paper Goods 71", "Global Freight Carier", "Completely New Vendor", "Zetas", "Zeta", ""]


def expected(name):
    key, keys = name.upper(), [b.upper() for b in BOOK]
    if not key:
        return "blocked", None
    if key in keys:
        return "existing", f"V{keys.index(key)}"
    near = [i for i, b in enumerate(keys) if SequenceMatcher(None, key, b).ratio() >= 0.88]
    return ("existing", f"V{near[0]}") if len(near) == 1 else ("ambiguous", None) if near else ("safe_create", None)


def test_fuzzy_vendors_and_review_rows_equal_brute_force(spark):
    vendors = spark.createDataFrame([("C", f"V{i}", n, None, None) for i, n in enumerate(BOOK)] + [("D", "V9", "Completely New Vendor", None, None)],
                                    "company_id string, vendor_id string, name string, supplier_code string, tax_id string").withColumn("normalized_name", vendor_key("name"))
    raw = lambda i, n: {"record_type": "purchase_order", "po_no": f"PO-10{i}", "po_total": "10", "vendor_name": n}
    rows = spark.createDataFrame([("C", i, raw(i, n), {"po_number": f"PO-10{i}", "total_amount": "10", "vendor_name": n}, {}, "purchase_order") for i, n in enumerate(NAMES)],
                                 "company_id string, row_id long, raw map<string,string>, canonical map<string,string>, metadata map<string,string>, record_type string")
    open_pos = spark.createDataFrame([], "company_id string, po_number string")
    got = {r.row_id: r for r in im.canonicalize(rows, open_pos, vendors).collect()}
    status = {"existing": ("ready", ""), "safe_create": ("ready", ""), "ambiguous": ("review", "ambiguous vendor"), "blocked": ("blocked", "missing vendor name and identifiers")}
    assert "ambiguous" in {expected(n)[0] for n in NAMES}
    for i, n in enumerate(NAMES):
        kind, vendor = expected(n)
        assert (got[i].vendor_status, got[i].resolved_id) == (kind, vendor), n
        assert (got[i].row_status, got[i].issue) == status[kind], n
