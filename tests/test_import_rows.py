"""Classification of imported rows: every alias counts, and the generated code stays short enough to be compiled."""

import pytest

from paymatch import import_policy as ip
from paymatch.operators import imports as im


@pytest.mark.parametrize("field,rest,kind", [
    ("line_number", {"po_number": "PO-1"}, "line"), ("grn_id", {}, "grn"), ("reference_type", {}, "reference"), ("tax_id", {}, "vendor"),
    ("invoice_number", {"invoice_total": "5"}, "invoice_transaction"), ("invoice_total", {"invoice_number": "A"}, "invoice_transaction")])
def test_every_alias_classifies(spark, field, rest, kind):
    names = ip.row_aliases()[field]
    rows = [(i, {**rest, f" {a.upper().replace('_', ' ')} ": "7"}) for i, a in enumerate(names)]
    got = im.classify_rows(spark.createDataFrame(rows, "row_id long, raw map<string,string>")).select("row_id", "record_type").collect()
    want = {i: kind for i, a in enumerate(names) if sum(a in n for n in ip.row_aliases().values()) == 1}
    assert want and {r.row_id: r.record_type for r in got if r.row_id in want} == want


def test_first_alias_of_a_field_wins_and_nothing_is_unclassified(spark):
    first, second = ip.row_aliases()["po_number"][:2]
    rows = [(0, {second: "PO-2", first: "PO-1"}), (1, {first: " ", second: "PO-2"}), (2, None), (3, {}), (4, {"invoice_number": "A", "invoice_total": "abc"})]
    got = {r.row_id: (r.record_type, r.po_reference) for r in im.classify_rows(spark.createDataFrame(rows, "row_id long, raw map<string,string>")).collect()}
    assert got[0][1] == "PO-1" and got[1][1] == "PO-2" and got[2] == got[3] == got[4] == ("unclassified", None)


def test_generated_methods_are_short_enough_to_compile(spark, tmp_path):
    spark.createDataFrame([(0, {"grn_id": "1"})], "row_id long, raw map<string,string>").write.parquet(f"{tmp_path}/raw")
    rows = im.classify_rows(spark.read.parquet(f"{tmp_path}/raw")).select("row_id", "record_type", "po_reference")
    parts = rows._jdf.queryExecution().debug().codegenToSeq()
    assert max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) < 8000  # HotSpot compiles no longer method
