"""The derived master-data views themselves (A1)."""

from paymatch.plans.registry import query


@query("a1_vendors", "SELECT company_id, vendor_id, name, array_to_string(aliases, '|') AS aliases, status, normalized_name FROM v_vendors")
def vendors(fx):
    return fx.vendors.selectExpr("company_id", "vendor_id", "name", "array_join(aliases, '|') as aliases", "status",
                                 "normalized_name")


@query("a1_pos", """SELECT company_id, po_number, vendor_id, vendor_name, total_amount, status, po_type, previously_invoiced,
  issue_date::VARCHAR AS issue_date, coalesce(expiry_date::VARCHAR, '') AS expiry_date, currency, import_derived FROM v_pos""")
def pos(fx):
    return fx.pos.selectExpr("company_id", "po_number", "vendor_id", "vendor_name", "total_amount", "status", "po_type",
                             "previously_invoiced", "cast(issue_date as string) as issue_date",
                             "coalesce(cast(expiry_date as string), '') as expiry_date", "currency", "import_derived")


@query("a1_po_lines", "SELECT po_number, line_number, description, sku, quantity, unit_price, amount FROM v_po_lines")
def po_lines(fx):
    return fx.po_lines.drop("k")


@query("a1_grn", "SELECT company_id, grn_id, po_number, received_amount FROM v_grn")
def grn(fx):
    return fx.grn


@query("a1_invoices", """SELECT company_id, document_id, coalesce(invoice_number,'') AS invoice_number, coalesce(vendor_name,'') AS vendor_name,
  coalesce(po_value,'') AS po_value, po_conf, po_status, coalesce(invoice_date::VARCHAR,'') AS invoice_date, subtotal_cents, tax_cents,
  coalesce(total_cents, -1) AS total_cents, total_conf, total_status, coalesce(ref_value,'') AS ref_value, epoch(arrival_ts)::BIGINT AS arrival
  FROM v_invoices""")
def invoices(fx):
    return fx.invoices.selectExpr(
        "company_id", "document_id", "coalesce(invoice_number,'') as invoice_number", "coalesce(vendor_name,'') as vendor_name",
        "coalesce(po_value,'') as po_value", "po_conf", "po_status", "coalesce(cast(invoice_date as string),'') as invoice_date",
        "subtotal_cents", "tax_cents", "coalesce(total_cents, -1) as total_cents", "total_conf", "total_status",
        "coalesce(ref_value,'') as ref_value", "unix_timestamp(arrival_ts) as arrival")


@query("a1_invoice_lines", "SELECT * FROM v_invoice_lines")
def invoice_lines(fx):
    return fx.invoice_lines
