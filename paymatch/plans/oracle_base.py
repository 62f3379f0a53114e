"""Reference SQL for the derived views: the same definitions as `sources.fixtures`, as DuckDB CTEs.

`oracle(body)` prepends exactly the CTEs a query text mentions, in dependency order.
"""

from __future__ import annotations

import re

from paymatch.policy import CORPORATE_WORDS, NOISE_WORDS, PO_PLACEHOLDERS
from paymatch.sources.fixtures import SUFFIX, WORD1, WORD2

CTES: dict[str, str] = {}


def oracle(body: str, instead: dict[str, str] | None = None) -> str:
    """The text with the CTEs it needs before it; `instead` replaces or adds some for this text."""
    tables = CTES | (instead or {})
    need: list[str] = []

    def visit(text: str, open_names: tuple = ()) -> None:
        for name in tables:  # a recursive CTE mentions itself
            if name not in need and name not in open_names and re.search(rf"\b{name}\b", text):
                visit(tables[name], (*open_names, name))
                if name not in need:
                    need.append(name)

    visit(body)
    if not need:
        return body
    recursive = "RECURSIVE " if any("/*recursive*/" in tables[n] for n in need) or "/*recursive*/" in body else ""
    head = "WITH " + recursive + ",\n".join(f"{n} AS ({tables[n]})" for n in need)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return head + ",\n" + re.sub(r"^WITH( RECURSIVE)? ", "", body, flags=re.I)
    return head + "\n" + body


# --- expression snippets --------------------------------------------------------------------------
_CORP = "|".join(w.upper() for w in CORPORATE_WORDS)


def sql_vendor_key(x: str) -> str:
    e = f"regexp_replace(trim(upper({x})), '[.,;:''\"\\-]', ' ', 'g')"
    e = f"regexp_replace({e}, '\\b(?:{_CORP})\\b', '', 'g')"
    e = f"regexp_replace({e}, '\\b&\\b', '', 'g')"
    e = f"regexp_replace({e}, '\\bAND\\b', '', 'g')"
    return f"coalesce(trim(regexp_replace({e}, '\\s+', ' ', 'g')), '')"


def sql_po_key(x: str) -> str:
    return f"regexp_replace(upper({x}), '[\\-\\s.#]', '', 'g')"


def sql_po_key_loose(x: str) -> str:
    return f"regexp_replace(upper({x}), '[\\- ]', '', 'g')"


def sql_valid_po(x: str, words=PO_PLACEHOLDERS) -> str:
    items = ",".join(f"'{w}'" for w in words)
    return f"(case when trim(coalesce({x}, '')) <> '' and lower(trim({x})) not in ({items}) then trim({x}) end)"


def sql_description_key(x: str) -> str:
    noise = ",".join(f"'{w}'" for w in NOISE_WORDS)
    words = f"list_filter(regexp_split_to_array(upper(trim({x})), '\\s+'), lambda w: w not in ({noise}))"
    e = f"regexp_replace(array_to_string({words}, ' '), '[^\\w\\s]', '', 'g')"
    return f"coalesce(trim(regexp_replace({e}, '\\s+', ' ', 'g')), '')"


def sql_word_set(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def sql_jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return (f"(case when len({a}) > 0 and len({b}) > 0 then {common}::DOUBLE / (len({a}) + len({b}) - {common}) "
            "else 0e0 end)")


def sql_half_up(x: str, digits: int) -> str:
    scale = f"1{'0' * digits}e0"
    return f"(floor(({x}) * {scale} + 0.5e0)::DOUBLE / {scale})"


def _pick(values, index: str) -> str:
    items = ",".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{items}], ({index})::INTEGER + 1)"


_W1, _W2 = _pick(WORD1, "s % 8"), _pick(WORD2, "(s // 8) % 5")

CTES["v_vendors"] = f"""
  SELECT *, {sql_vendor_key('name')} AS normalized_name FROM (
  SELECT 'C' || (s % 3) AS company_id, 'V' || lpad(s::VARCHAR, 5, '0') AS vendor_id,
         {_W1} || ' ' || {_W2} || ' ' || s || {_pick(SUFFIX, 's % 4')} AS name,
         CASE WHEN s % 6 = 0 THEN [{_W2} || ' ' || {_W1} || ' ' || s] ELSE []::VARCHAR[] END AS aliases,
         CASE WHEN s % 17 = 0 THEN 'suspended' WHEN s % 13 = 0 THEN 'inactive' ELSE 'active' END AS status,
         'TAX' || s AS tax_id, 'SUP' || s AS supplier_code, s
  FROM (SELECT s_suppkey AS s FROM supplier))"""

CTES["v_po_lines"] = """
  SELECT 'PO-' || lpad(l_orderkey::VARCHAR, 7, '0') AS po_number, line_number,
         p_name || ' ' || p_type || ' ' || p_size AS description, 'SKU-' || p_partkey AS sku,
         l_quantity::BIGINT AS quantity, unit_price, unit_price * l_quantity::BIGINT AS amount, l_orderkey AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                     l_quantity, l_extendedprice, l_shipdate) AS line_number,
               floor(l_extendedprice * 100e0 / l_quantity + 0.5e0)::BIGINT AS unit_price FROM lineitem)
  JOIN part ON p_partkey = l_partkey"""

CTES["v_pos"] = """
  SELECT company_id, 'PO-' || lpad(k::VARCHAR, 7, '0') AS po_number, vendor_id,
         CASE WHEN k % 17 = 5 THEN 'Legacy ' || o.s ELSE name END AS vendor_name, total_amount,
         CASE WHEN k % 20 = 0 THEN 'closed' WHEN k % 29 = 0 THEN 'cancelled'
              WHEN k % 31 = 0 THEN 'closed_for_invoicing' ELSE 'open' END AS status,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'blanket' ELSE 'standard' END AS po_type,
         floor(total_amount * (k % 4) / 4)::BIGINT AS previously_invoiced,
         o_orderdate::DATE AS issue_date, CASE WHEN k % 47 = 0 THEN o_orderdate::DATE + 30 END AS expiry_date,
         'USD' AS currency, (o.s % 3 = 2 AND k % 9 = 0) AS import_derived, k, o.s, name AS master_name
  FROM (SELECT o_orderkey AS k, o_custkey % (SELECT count(*) FROM supplier) AS s, o_orderdate, o_orderpriority FROM orders) o
  JOIN (SELECT k AS lk, sum(amount)::BIGINT AS total_amount FROM v_po_lines GROUP BY k) t ON lk = o.k
  JOIN v_vendors v ON v.s = o.s"""

CTES["v_grn"] = """
  SELECT company_id, 'GRN-' || l.k || '-' || line_number AS grn_id, l.po_number, amount AS received_amount
  FROM v_po_lines l JOIN v_pos p ON p.po_number = l.po_number
  WHERE l.k % 5 <> 0 AND (l.k + line_number) % 3 <> 0"""

CTES["v_po_references"] = """
  SELECT company_id, po_number, 'order_ref' AS reference_type, 'ORD-' || k AS reference_value FROM v_pos WHERE k % 13 < 2"""

CTES["v_invoices"] = f"""
  SELECT company_id, 'DOC-' || lpad(k::VARCHAR, 7, '0') AS document_id,
    CASE WHEN k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN 'A1' ELSE 'INV-' || lpad(k::VARCHAR, 7, '0') END AS invoice_number,
    CASE WHEN k % 37 = 0 THEN 0e0 ELSE 0.95e0 END AS number_conf,
    CASE WHEN k % 37 = 0 THEN 'not_found' WHEN k % 43 = 0 THEN 'uncertain' ELSE 'extracted' END AS number_status,
    CASE WHEN k % 71 = 0 OR k % 83 = 0 THEN NULL WHEN k % 11 = 3 THEN replace(replace(master_name, 'or', 'r'), 'al', 'a1')
         WHEN k % 11 = 5 THEN upper(replace(master_name, ',', ''))
         WHEN k % 11 = 7 AND s % 6 = 0 THEN {_W2} || ' ' || {_W1} || ' ' || s ELSE master_name END AS vendor_name,
    CASE WHEN k % 71 = 0 OR k % 83 = 0 THEN 0e0 WHEN k % 7 = 3 THEN 0.8e0 ELSE 0.95e0 END AS vendor_conf,
    CASE WHEN k % 71 = 0 OR k % 83 = 0 THEN 'not_found' WHEN k % 61 = 0 THEN 'uncertain' ELSE 'extracted' END AS vendor_status,
    CASE WHEN k % 83 = 0 THEN NULL WHEN scn = 1 THEN replace(po_number, '-', CASE WHEN k % 2 = 0 THEN '' ELSE '.' END) WHEN scn = 2 THEN NULL WHEN scn = 3 THEN 'N/A'
         WHEN scn = 4 THEN substring(po_number, 1, 9) || 'X' ELSE po_number END AS po_value,
    CASE WHEN scn IN (2, 3) OR k % 83 = 0 THEN 0e0 WHEN scn = 4 THEN 0.6e0 ELSE 0.95e0 END AS po_conf,
    CASE WHEN scn = 2 OR k % 83 = 0 THEN 'not_found' ELSE 'extracted' END AS po_status,
    CASE WHEN k % 53 = 0 THEN NULL ELSE issue_date + (k % 200)::INTEGER END AS invoice_date,
    CASE WHEN k % 53 = 0 THEN 0e0 ELSE 0.88e0 END AS date_conf,
    CASE WHEN k % 53 = 0 THEN 'not_found' ELSE 'extracted' END AS date_status,
    CASE WHEN k % 59 = 0 THEN NULL ELSE 'USD' END AS currency,
    CASE WHEN k % 59 = 0 THEN 0e0 ELSE 0.9e0 END AS currency_conf,
    CASE WHEN k % 59 = 0 THEN 'not_found' WHEN k % 3 = 0 THEN 'inferred' ELSE 'extracted' END AS currency_status,
    subtotal0 - CASE WHEN k % 16 = 0 THEN 1500 ELSE 0 END AS subtotal_cents, 0.95e0 AS subtotal_conf,
    CASE WHEN k % 73 = 0 THEN 0 ELSE total0 - subtotal0
         - CASE WHEN k % 29 = 0 THEN 6000 WHEN k % 31 = 0 THEN 700 ELSE 0 END END AS tax_cents, 0.95e0 AS tax_conf,
    CASE WHEN k % 67 = 0 OR k % 83 = 0 THEN NULL ELSE total0 END AS total_cents,
    CASE WHEN k % 67 = 0 OR k % 83 = 0 THEN 0e0 WHEN k % 19 = 0 THEN 0.8e0 WHEN k % 5 = 2 THEN 0.92e0 ELSE 0.97e0 END AS total_conf,
    CASE WHEN k % 67 = 0 OR k % 83 = 0 THEN 'not_found' ELSE 'extracted' END AS total_status,
    CASE WHEN k % 13 = 0 AND k % 83 <> 0 THEN 'ORD-' || k END AS ref_value,
    make_timestamp((1709251200 + (k * 7919) % 100003) * 1000000) AS arrival_ts, k, scn, po_number AS true_po
  FROM (SELECT *, CASE WHEN scn = 8 THEN (total0 * 10 + 6) // 12 ELSE (total0 * 100 + 54) // 108 END AS subtotal0
        FROM (SELECT *, CASE scn WHEN 0 THEN remaining WHEN 5 THEN remaining * 101 // 100 WHEN 6 THEN remaining * 104 // 100
                             WHEN 7 THEN remaining * 120 // 100 WHEN 9 THEN 500000 WHEN 11 THEN 990000
                             ELSE remaining // 2 END AS total0
              FROM (SELECT *, (k // 3) % 12 AS scn, total_amount - previously_invoiced AS remaining
                    FROM v_pos)))"""

CTES["v_invoice_lines"] = """
  SELECT company_id, document_id, CASE WHEN scn % 3 = 1 THEN line_number - line_number // 4 ELSE line_number END AS line_no,
         l.description || CASE WHEN scn % 2 = 1 THEN ' item' ELSE '' END
           || CASE WHEN l.k % 3 = 0 THEN ' ' || sku ELSE '' END AS description,
         quantity, CASE WHEN scn = 6 THEN unit_price * 105 // 100 ELSE unit_price END AS unit_price,
         quantity * (CASE WHEN scn = 6 THEN unit_price * 105 // 100 ELSE unit_price END)
           + CASE WHEN l.k % 23 = 0 AND line_number = 1 THEN 100 ELSE 0 END AS amount
  FROM v_po_lines l JOIN v_invoices i ON i.true_po = l.po_number WHERE NOT (scn % 3 = 1 AND line_number % 4 = 0) AND l.k % 83 <> 0"""

CTES["v_charges"] = """
  SELECT document_id, 'Shipping & Handling' AS label, 1500::BIGINT AS amount FROM v_invoices WHERE k % 8 = 0
  UNION ALL SELECT document_id, 'Loyalty discount', 500::BIGINT FROM v_invoices WHERE k % 24 = 0"""

CTES["v_prior_runs"] = """
  SELECT company_id, document_id || '-P' AS document_id, vendor_name,
         CASE WHEN k % 4 = 1 THEN invoice_number || 'X' ELSE invoice_number END AS invoice_number,
         total_cents + CASE WHEN k % 4 = 2 THEN 500 ELSE 0 END AS total_cents,
         invoice_date + (k % 6)::INTEGER AS invoice_date,
         CASE WHEN k % 5 = 1 THEN '' WHEN k % 3 = 0 THEN 'AUTO_APPROVED' WHEN k % 3 = 1 THEN 'REJECT'
              ELSE 'APPROVAL_REQUIRED' END AS decision,
         CASE WHEN k % 7 = 0 THEN 'BLOCKED' ELSE 'VALIDATED' END AS stage3_status,
         make_timestamp((1706745600 + k % 1000) * 1000000) AS arrival_ts, k
  FROM v_invoices WHERE scn = 10"""

CTES["v_allocations"] = """
  SELECT company_id, document_id || '-P' AS document_id, true_po AS po_number, total_cents AS amount
  FROM v_invoices WHERE scn = 10 AND k % 2 = 0"""

CTES["v_source_records"] = """
  SELECT company_id, 'SR' || lpad(k::VARCHAR, 7, '0') AS source_record_id, vendor_name, invoice_number, invoice_date,
         total_cents AS invoice_total, currency, CASE WHEN k % 14 = 0 THEN NULL WHEN k % 7 = 3 THEN 'EXT-' || k ELSE true_po END AS po_reference,
         make_timestamp((1704067200 + (k * 31) % 9973) * 1000000) AS created_at, k
  FROM v_invoices WHERE company_id = 'C2'"""

CTES["v_runs"] = """
  SELECT company_id, document_id, arrival_ts,
    CASE WHEN k % 67 = 0 THEN 'extraction_failed' WHEN scn IN (2, 3, 4) THEN 'needs_human_review' ELSE 'stage1_passed' END AS status,
    (k % 900) * 10 AS processing_ms,
    CASE WHEN k % 29 = 0 THEN 'residual_review' WHEN k % 16 = 0 THEN 'reconciled_with_inferred_charges' ELSE 'reconciled' END AS reconciliation_status,
    CASE WHEN k % 83 = 0 THEN 'extraction_weak' WHEN scn IN (2, 3) THEN 'extraction_partial' ELSE 'extraction_complete' END AS extraction_quality,
    CASE scn WHEN 0 THEN 'high_confidence_match' WHEN 2 THEN 'suggested_po_match' WHEN 3 THEN 'ambiguous_match' WHEN 4 THEN 'waiting_for_po'
         WHEN 10 THEN 'partial_match' WHEN 11 THEN 'no_matching_evidence' ELSE 'high_confidence_match' END AS stage2_status,
    CASE scn WHEN 6 THEN 'HOLD' WHEN 7 THEN 'HOLD' WHEN 9 THEN 'REVIEW_REQUIRED' WHEN 10 THEN 'BLOCKED' WHEN 5 THEN 'VALIDATION_INCOMPLETE'
         WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN '' ELSE 'VALIDATED' END AS stage3_status,
    CASE scn WHEN 6 THEN 'HIGH_PRIORITY_REVIEW' WHEN 7 THEN 'STANDARD_REVIEW' WHEN 9 THEN 'FRAUD_REVIEW' WHEN 10 THEN 'TERMINAL_REJECT'
         WHEN 5 THEN 'WAITING_FOR_GRN' WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN '' WHEN 8 THEN 'APPROVAL_REQUIRED' ELSE 'AUTO_APPROVED' END AS stage4_status,
    CASE scn WHEN 6 THEN 'REVIEW_REQUIRED' WHEN 7 THEN 'REVIEW_REQUIRED' WHEN 9 THEN 'REVIEW_REQUIRED' WHEN 10 THEN 'REJECT'
         WHEN 5 THEN 'WAITING_FOR_VALIDATION' WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN '' ELSE 'APPROVE' END AS stage4_decision,
    (k % 100)::DOUBLE / 100 AS quality_score, k
  FROM v_invoices"""

CTES["v_first_answers"] = """
  SELECT document_id, CASE WHEN k % 3 = 0 THEN 'reject' ELSE 'confirm' END AS action, CASE WHEN k % 3 <> 0 THEN true_po END AS po_number,
         'ap-clerk' AS actor, make_timestamp((1709424000 + k % 5000) * 1000000) AS acted_at, k
  FROM v_invoices WHERE scn IN (2, 3, 4)"""
CTES["v_confirmations"] = """
  SELECT * FROM v_first_answers UNION ALL
  SELECT document_id, CASE WHEN action = 'confirm' THEN 'reject' ELSE 'confirm' END,
         CASE WHEN action = 'reject' THEN 'PO-' || lpad(k::VARCHAR, 7, '0') END, 'ap-lead', acted_at + INTERVAL 1 DAY, k
  FROM v_first_answers WHERE k % 4 = 0"""

CTES["v_corrections"] = """
  SELECT document_id, 'invoice_number' AS field_name, 'FIX-' || k AS new_value, 'ap-clerk' AS actor_id,
         make_timestamp((1709424000 + k % 5000) * 1000000) AS acted_at FROM v_invoices WHERE k % 37 = 0
  UNION ALL SELECT document_id, 'invoice_number', 'FIX2-' || k, 'ap-lead', make_timestamp((1709524000 + k % 5000) * 1000000)
         FROM v_invoices WHERE k % 74 = 0
  UNION ALL SELECT document_id, 'total_amount', (subtotal_cents + tax_cents)::VARCHAR, 'ap-clerk',
         make_timestamp((1709424000 + k % 5000) * 1000000) FROM v_invoices WHERE k % 67 = 0
  UNION ALL SELECT document_id, 'line_items', '[]', 'ap-clerk', make_timestamp((1709424000 + k % 5000) * 1000000)
         FROM v_invoices WHERE k % 67 = 0"""

CTES["v_human_actions"] = """
  SELECT document_id, CASE WHEN k % 12 = 0 THEN 'APPROVE' ELSE 'COMMENT' END AS action_type,
         CASE WHEN k % 18 = 0 THEN 'APPROVAL' ELSE 'noted' END AS outcome, 'user' || (k % 9) AS actor_id,
         'checked ' || k AS detail, make_timestamp((1709424000 + k % 5000) * 1000000) AS acted_at
  FROM v_invoices WHERE k % 6 = 0"""

_IMPORT = ("record_type", "supplier_name", "supplier_code", "tax_id", "po_no", "po_total", "po_status", "line_no",
           "qty", "price", "inv_number", "inv_total", "inv_date", "grn", "remarks")


def _shape(kind: str, rid: str, source: str, **exprs) -> str:
    cols = ", ".join(f"({exprs.get(c, 'NULL')})::VARCHAR AS {c}" for c in _IMPORT)
    return f"SELECT company_id, '{kind}' || lpad(({rid})::VARCHAR, 10, '0') AS row_id, {cols} FROM {source}"


CTES["v_import_rows"] = "\n UNION ALL ".join((
    _shape("A", "s", "v_vendors", record_type="CASE WHEN s % 2 = 0 THEN 'vendor' END", supplier_name="name",
           supplier_code="CASE WHEN s % 5 = 0 THEN supplier_code END", tax_id="tax_id", remarks="'r' || s"),
    _shape("B", "k", "v_pos", record_type="CASE WHEN k % 3 = 0 THEN 'purchase_order' END", supplier_name="vendor_name",
           po_no="CASE WHEN k % 11 = 0 THEN 'N/A' WHEN k % 23 = 0 THEN po_number || ' ' "
                 "WHEN k % 46 = 1 THEN 'PO-0000001' ELSE po_number END",
           po_total="CASE WHEN k % 97 = 0 THEN 'abc' ELSE total_amount::VARCHAR END", po_status="status"),
    _shape("C", "l.k * 100 + line_number", "v_po_lines l JOIN (SELECT po_number AS pn, company_id FROM v_pos) ON pn = l.po_number",
           po_no="CASE WHEN k % 30 = 0 THEN 'PO-MISSING' ELSE po_number END",
           line_no="CASE WHEN k % 33 = 0 THEN 0 ELSE line_number END", qty="quantity", price="unit_price"),
    _shape("D", "k", "v_invoices", record_type="CASE WHEN k % 2 = 0 THEN 'invoice' END",
           supplier_name="CASE WHEN k % 49 = 0 THEN NULL ELSE vendor_name END", po_no="po_value",
           inv_number="invoice_number", inv_total="total_cents", inv_date="invoice_date"),
    _shape("E", "l.k * 100 + line_number", "v_po_lines l JOIN (SELECT po_number AS pn, company_id FROM v_pos) ON pn = l.po_number WHERE l.k % 5 <> 0 AND (l.k + line_number) % 3 <> 0",
           grn="'GRN-' || k", po_no="CASE WHEN k % 21 = 0 THEN NULL ELSE po_number END"),
))
