"""Scalar normalizers over the whole derived tables."""

from pyspark.sql import functions as F

from paymatch.functions import fields as fld
from paymatch.functions import locale as loc
from paymatch.functions import text as txt
from paymatch.plans.oracle_base import (sql_description_key, sql_po_key, sql_valid_po, sql_vendor_key)
from paymatch.plans.registry import query
from paymatch.policy import CHARGE_LABELS, CURRENCY_SYMBOLS, PO_PLACEHOLDERS, UNIT_ALIASES

AS_OF = "2000-01-01"


@query("b1_normalize_vendor_name", f"""SELECT document_id, {sql_vendor_key("vendor_name || ' & Co., Group-Services A&B and Sons'")} AS vendor_key
  FROM v_invoices WHERE vendor_name IS NOT NULL""")
def b1(fx):
    noisy = F.concat("vendor_name", F.lit(" & Co., Group-Services A&B and Sons"))
    return fx.invoices.filter("vendor_name is not null").select("document_id", txt.vendor_key(noisy).alias("vendor_key"))


@query("b2_vendor_names_equivalent", f"""SELECT document_id, coalesce(vendor_name,'') <> '' AND {sql_vendor_key('i.vendor_name')} = {sql_vendor_key('p.vendor_name')} AS equivalent
  FROM v_invoices i JOIN v_pos p ON p.po_number = i.true_po""".replace("coalesce(vendor_name", "coalesce(i.vendor_name"))
def b2(fx):
    p = fx.pos.select(F.col("po_number").alias("true_po"), F.col("vendor_name").alias("po_vendor"))
    return fx.invoices.join(p, "true_po").select(
        "document_id", F.coalesce(txt.vendor_names_equivalent("vendor_name", "po_vendor"), F.lit(False)).alias("equivalent"))


@query("b3_ocr_vendor_aliases", """SELECT vendor_id, CASE WHEN contains(name, ',') THEN replace(name, ',', '')
  ELSE regexp_replace(name, '^(\\S+)\\s+', '\\1, ') END AS aliases FROM v_vendors""")
def b3(fx):
    return fx.vendors.select("vendor_id", F.array_join(txt.ocr_aliases("name"), "|").alias("aliases"))


@query("b4_normalize_po_number", f"SELECT document_id, {sql_po_key('''po_value || ' #1.2' ''')} AS po_key FROM v_invoices WHERE po_value IS NOT NULL")
def b4(fx):
    return fx.invoices.filter("po_value is not null").select(
        "document_id", txt.po_key(F.concat("po_value", F.lit(" #1.2"))).alias("po_key"))


_RAW_PO = "CASE k % 6 WHEN 0 THEN po_value WHEN 1 THEN ' N/A ' WHEN 2 THEN 'Not Applicable' WHEN 3 THEN '' WHEN 4 THEN po_value || ' ' ELSE '-' END"


@query("b5_valid_po_number", f"SELECT document_id, coalesce({sql_valid_po('raw')}, '(none)') AS po FROM (SELECT document_id, {_RAW_PO} AS raw FROM v_invoices)")
def b5(fx):
    return fx.invoices.selectExpr("document_id", f"{_RAW_PO} as raw").select(
        "document_id", F.coalesce(txt.valid_po_number("raw", PO_PLACEHOLDERS), F.lit("(none)")).alias("po"))


_RAW_NUM = "CASE k % 4 WHEN 0 THEN CAST(total_amount AS {s}) WHEN 1 THEN 'abc' WHEN 2 THEN NULL ELSE ' 12.5 ' END"


@query("b6_safe_str_and_float", f"""SELECT po_number, coalesce(trim(raw), '') AS s, coalesce(try_cast(trim(raw) AS DOUBLE), 0e0) AS f
  FROM (SELECT po_number, {_RAW_NUM.format(s='VARCHAR')} AS raw FROM v_pos)""")
def b6(fx):
    return fx.pos.selectExpr("po_number", f"{_RAW_NUM.format(s='string')} as raw").select(
        "po_number", txt.safe_str("raw").alias("s"), txt.safe_float("raw").alias("f"))


_RAW_AMOUNT = ("CASE k % 7 WHEN 0 THEN '(' || total_amount || '.50)' WHEN 1 THEN '$ ' || total_amount || ',25' "
               "WHEN 2 THEN '1,234,567.8' WHEN 3 THEN 'abc' WHEN 4 THEN '-' || total_amount WHEN 5 THEN '1.2.3' ELSE NULL END")


@query("b7_parse_amount", f"""SELECT po_number, coalesce(CASE WHEN neg THEN -v ELSE v END, -999e0) AS amount FROM (
  SELECT po_number, starts_with(raw, '(') AND ends_with(raw, ')') AS neg,
    try_cast(CASE WHEN sep = ',' AND length(d) - length(replace(d, ',', '')) = 1 AND NOT contains(d, '.') THEN replace(d, ',', '.')
             ELSE replace(d, ',', '') END AS DOUBLE) AS v
  FROM (SELECT *, regexp_replace(raw, '[^\\d,.\\-]', '', 'g') AS d
        FROM (SELECT po_number, {_RAW_AMOUNT} AS raw, CASE WHEN k % 2 = 0 THEN ',' ELSE '.' END AS sep FROM v_pos)))""")
def b7(fx):
    raw = fx.pos.selectExpr("po_number", f"{_RAW_AMOUNT} as raw", "case when k % 2 = 0 then ',' else '.' end as sep")
    return raw.select("po_number", F.coalesce(loc.parse_amount("raw", F.col("sep")), F.lit(-999.0)).alias("amount"))


_RAW_CUR = ("CASE k % 9 WHEN 0 THEN 'usd' WHEN 1 THEN ' eur ' WHEN 2 THEN '$' WHEN 3 THEN 'C$ 12' WHEN 4 THEN '€5' "
            "WHEN 5 THEN '₹' WHEN 6 THEN 'dollars' WHEN 7 THEN NULL ELSE '12£' END")


@query("b8_normalize_currency", "SELECT po_number, coalesce(CASE WHEN regexp_full_match(trim(raw), '[A-Za-z]{3}') THEN upper(trim(raw)) "
       + " ".join(f"WHEN contains(raw, '{s}') THEN '{c}'" for s, c in CURRENCY_SYMBOLS)
       + f" ELSE raw END, '(none)') AS currency FROM (SELECT po_number, {_RAW_CUR} AS raw FROM v_pos)")
def b8(fx):
    return fx.pos.selectExpr("po_number", f"{_RAW_CUR} as raw").select(
        "po_number", F.coalesce(loc.normalize_currency("raw"), F.lit("(none)")).alias("currency"))


_RAW_UOM = "CASE k % 7 WHEN 0 THEN ' EA ' WHEN 1 THEN 'pcs' WHEN 2 THEN 'Hrs' WHEN 3 THEN 'LBS' WHEN 4 THEN 'Box' WHEN 5 THEN NULL ELSE '' END"


@query("b9_normalize_uom", "SELECT po_number, line_number, coalesce(CASE WHEN raw = '' THEN NULL "
       + " ".join(f"WHEN lower(trim(raw)) = '{a}' THEN '{u}'" for a, u in UNIT_ALIASES.items())
       + f" ELSE lower(trim(raw)) END, '(none)') AS uom FROM (SELECT po_number, line_number, {_RAW_UOM} AS raw FROM v_po_lines)")
def b9(fx):
    return fx.po_lines.selectExpr("po_number", "line_number", f"{_RAW_UOM} as raw").select(
        "po_number", "line_number", F.coalesce(loc.normalize_unit("raw"), F.lit("(none)")).alias("uom"))


@query("b10_normalize_line_item", """SELECT po_number, line_number, qty AS quantity, price AS unit_price,
  CASE WHEN line_number % 3 = 0 THEN coalesce(CASE WHEN qty <> 0 AND price <> 0 THEN floor(qty * price * 10000e0 + 0.5e0) / 10000e0 END, -1e0)
       ELSE amount::DOUBLE END AS amount, 'each' AS uom
  FROM (SELECT *, quantity::DOUBLE AS qty, unit_price::DOUBLE / 100 AS price FROM v_po_lines)""")
def b10(fx):
    lines = fx.po_lines.selectExpr(
        "po_number", "line_number", "array(named_struct('quantity', cast(quantity as string), "
        "'unit_price', concat('$', cast(cast(unit_price as double) / 100 as string)), "
        "'amount', case when line_number % 3 = 0 then cast(null as string) else cast(amount as string) end, 'uom', 'PCS')) as l")
    return lines.withColumn("n", loc.normalize_lines(F.col("l"))[0]).select(
        "po_number", "line_number", "n.quantity", "n.unit_price", F.coalesce("n.amount", F.lit(-1.0)).alias("amount"), "n.uom")


@query("b11_infer_reconciliation_mode", """SELECT document_id, CASE WHEN k % 12 = 0 THEN 'multi_tax'
    WHEN coalesce(n, 0) > 0 AND sub IS NULL AND tot IS NOT NULL THEN 'lines_only'
    WHEN tot IS NOT NULL AND coalesce(n, 0) = 0 THEN 'header_only'
    WHEN sub IS NOT NULL AND tot IS NOT NULL AND tax_cents <> 0 AND abs(sub + tax_cents - tot) < 2 THEN 'tax_exclusive'
    WHEN sub IS NOT NULL AND tot IS NOT NULL AND tax_cents <> 0 AND abs(sub - tot) < 2 THEN 'tax_inclusive'
    ELSE 'tax_exclusive' END AS mode
  FROM (SELECT *, CASE WHEN k % 10 = 7 THEN NULL WHEN k % 10 = 4 THEN total_cents ELSE subtotal_cents END AS sub, nullif(total_cents, 0) AS tot FROM v_invoices) i
  LEFT JOIN (SELECT document_id AS d, count(*) AS n FROM v_invoice_lines GROUP BY 1) ON d = document_id AND k % 9 <> 0""")
def b11(fx):
    n = fx.invoice_lines.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    i = fx.invoices.join(n, "document_id", "left").selectExpr(
        "document_id", "if(k % 12 = 0, 2, 1) as taxes", "if(k % 9 <> 0, coalesce(n, 0), 0) as n_lines",
        "case when k % 10 = 7 then null when k % 10 = 4 then total_cents else subtotal_cents end as sub",
        "tax_cents", "total_cents", "'' as given")
    return i.select("document_id", loc.reconciliation_mode("taxes", "n_lines", "sub", "tax_cents", "total_cents", "given").alias("mode"))


@query("b12_parse_date", """SELECT po_number, coalesce(try_strptime(raw, ['%Y-%m-%d','%d/%m/%Y','%m/%d/%Y','%d-%m-%Y','%d %b %Y','%d %B %Y','%b %d, %Y','%B %d, %Y'])::DATE::VARCHAR, '(none)') AS parsed
  FROM (SELECT po_number, CASE k % 10 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%d/%m/%Y') WHEN 2 THEN strftime(d, '%m/%d/%Y')
    WHEN 3 THEN strftime(d, '%d-%m-%Y') WHEN 4 THEN strftime(d, '%d %b %Y') WHEN 5 THEN strftime(d, '%d %B %Y') WHEN 6 THEN strftime(d, '%b %d, %Y')
    WHEN 7 THEN strftime(d, '%B %d, %Y') WHEN 8 THEN '2024-13-99' ELSE 'soon' END AS raw FROM (SELECT po_number, k, issue_date AS d FROM v_pos))""")
def b12(fx):
    raw = fx.pos.selectExpr("po_number", """case k % 10 when 0 then date_format(issue_date, 'yyyy-MM-dd') when 1 then date_format(issue_date, 'dd/MM/yyyy')
      when 2 then date_format(issue_date, 'MM/dd/yyyy') when 3 then date_format(issue_date, 'dd-MM-yyyy') when 4 then date_format(issue_date, 'dd MMM yyyy')
      when 5 then date_format(issue_date, 'dd MMMM yyyy') when 6 then date_format(issue_date, 'MMM dd, yyyy')
      when 7 then date_format(issue_date, 'MMMM dd, yyyy') when 8 then '2024-13-99' else 'soon' end as raw""")
    return raw.select("po_number", F.coalesce(loc.parse_date("raw").cast("string"), F.lit("(none)")).alias("parsed"))


_TERMS = "CASE k % 7 WHEN 0 THEN 'Net 30' WHEN 1 THEN 'payment 14 days' WHEN 2 THEN 'Due in 21 days' WHEN 3 THEN '10 days after receipt' WHEN 4 THEN 'NET45' WHEN 5 THEN 'cash' ELSE NULL END"


@query("b13_due_date_from_terms", f"""SELECT document_id, coalesce((invoice_date + coalesce(
    try_cast(nullif(regexp_extract(t, 'net\\s*(\\d+)', 1), '') AS INTEGER), try_cast(nullif(regexp_extract(t, '(\\d+)\\s*days?\\s*after', 1), '') AS INTEGER),
    try_cast(nullif(regexp_extract(t, 'payment\\s*(\\d+)\\s*days', 1), '') AS INTEGER), try_cast(nullif(regexp_extract(t, 'due\\s*in\\s*(\\d+)\\s*days', 1), '') AS INTEGER)))::VARCHAR, '(none)') AS due_date
  FROM (SELECT document_id, invoice_date, lower({_TERMS}) AS t FROM v_invoices)""")
def b13(fx):
    return fx.invoices.selectExpr("document_id", "invoice_date", f"{_TERMS} as t").select(
        "document_id", F.coalesce(loc.due_date("invoice_date", "t").cast("string"), F.lit("(none)")).alias("due_date"))


_LABEL = ("CASE k % 8 WHEN 0 THEN 'Shipping & Handling' WHEN 1 THEN 'Fee' WHEN 2 THEN 'Fuel surcharge 3%' WHEN 3 THEN 'Loyalty discount' "
          "WHEN 4 THEN 'Service Fee' WHEN 5 THEN '' WHEN 6 THEN 'packing' ELSE 'FREIGHT' END")


@query("b14_categorize_charge", "SELECT document_id, CASE WHEN label = '' THEN 'other' "
       + " ".join("WHEN " + " OR ".join(f"contains(x, '{p}') OR contains('{p}', x)" for p in ps) + f" THEN '{c}'" for c, ps in CHARGE_LABELS)
       + f" ELSE 'other' END AS category FROM (SELECT *, lower(trim(label)) AS x FROM (SELECT document_id, {_LABEL} AS label FROM v_invoices))")
def b14(fx):
    return fx.invoices.selectExpr("document_id", f"{_LABEL} as label").select("document_id", loc.categorize_charge("label").alias("category"))


@query("b15_normalize_header", "SELECT DISTINCT regexp_replace(lower(trim('  ' || p_brand || ' ' || p_type || '  No ')), '\\s+', '_', 'g') AS header FROM part")
def b15(fx):
    return fx.table("part").selectExpr("concat('  ', p_brand, ' ', p_type, '  No ') as h").select(txt.header_key("h").alias("header")).distinct()


@query("b16_source_fingerprint", """SELECT source_id, substring(sha256(string_agg(sheet || ':' || cols, chr(10) ORDER BY sheet || ':' || cols)), 1, 16) AS fingerprint FROM (
    SELECT vendor_id AS source_id, po_type AS sheet, string_agg(lower(trim(po_number || ' ' || status)), '|' ORDER BY k, po_number || ' ' || status) AS cols
    FROM v_pos GROUP BY 1, 2) GROUP BY 1""")
def b16(fx):
    catalog = fx.pos.selectExpr("vendor_id as source_id", "po_type as sheet", "k as position", "concat(po_number, ' ', status) as column_name")
    return fld.source_fingerprint(catalog)


@query("b17_confidence_gate", """SELECT document_id, CASE WHEN po_value IS NULL OR po_status = 'not_found' THEN 'expand' WHEN po_status = 'uncertain' THEN 'validate'
  WHEN po_conf >= 0.90 THEN 'trust' WHEN po_conf >= 0.70 THEN 'validate' ELSE 'expand' END AS action
  FROM (SELECT * REPLACE (CASE WHEN k % 14 = 3 THEN 'uncertain' ELSE po_status END AS po_status, CASE WHEN k % 8 = 5 THEN 0.75e0 ELSE po_conf END AS po_conf) FROM v_invoices)""")
def b17(fx):
    i = fx.invoices.withColumns({"po_status": F.expr("case when k % 14 = 3 then 'uncertain' else po_status end"),
                                 "po_conf": F.expr("case when k % 8 = 5 then 0.75e0 else po_conf end")})
    return i.select("document_id", fld.confidence_gate().alias("action"))


@query("b18_po_presence", """SELECT document_id, CASE WHEN po_value IS NULL OR po_status = 'not_found' OR trim(po_value) = '' OR lower(trim(po_value)) IN ('n/a','none','null','-')
  THEN 'non_po' ELSE 'po_invoice' END AS presence FROM v_invoices""")
def b18(fx):
    return fx.invoices.select("document_id", fld.po_presence().alias("presence"))


SQL_PO_FLAGS = """CASE WHEN status = 'open' AND expiry_date < DATE '{as_of}' THEN 'expired_po' WHEN status IN ('closed', 'closed_for_invoicing') THEN 'closed_po,review_required'
  WHEN status = 'cancelled' THEN 'cancelled_po,escalation_required' WHEN status = 'open' THEN '' ELSE 'unknown_status' END"""


@query("b19_po_validity", f"SELECT po_number, {SQL_PO_FLAGS.format(as_of=AS_OF)} AS flags FROM v_pos")
def b19(fx):
    return fx.pos.select("po_number", F.array_join(fld.po_validity_flags(AS_OF), ",").alias("flags"))


@query("b20_suggestion_mode", "SELECT document_id, NOT (coalesce(po_value, '') <> '' AND po_conf >= 0.85 AND po_status IN ('extracted', 'inferred')) AS suggestion_mode FROM v_invoices")
def b20(fx):
    return fx.invoices.select("document_id", fld.suggestion_mode().alias("suggestion_mode"))


@query("b21_effective_typed_refs", """SELECT document_id, array_to_string(list_filter([CASE WHEN ref_value IS NOT NULL AND 0.3 + (k % 5) * 0.1 >= 0.5 THEN 'order_ref=' || ref_value END,
    CASE WHEN coalesce(po_value, '') <> '' AND po_conf >= 0.7 THEN 'order_ref=' || po_value END], lambda x: x IS NOT NULL), '|') AS refs FROM v_invoices""")
def b21(fx):
    i = fx.invoices.selectExpr("document_id", "po_value", "po_conf", "case when ref_value is null then cast(array() as array<struct<type:string,value:string,confidence:double>>) "
                               "else array(named_struct('type', 'order_ref', 'value', ref_value, 'confidence', 0.3e0 + (k % 5) * 0.1e0)) end as refs")
    refs = fld.effective_references(F.col("refs"))
    return i.select("document_id", F.array_join(F.transform(refs, lambda r: F.concat_ws("=", r["type"], r["value"])), "|").alias("refs"))


@query("b23_json_safe_numbers", """SELECT po_number, '{"po_number":"' || po_number || '"' || CASE WHEN k % 3 = 0 THEN ',"x":' || k ELSE '' END || '}' AS json FROM v_pos""")
def b23(fx):
    x = F.when(F.expr("k % 3 = 1"), F.lit(float("nan"))).when(F.expr("k % 3 = 2"), F.lit(float("inf"))).otherwise(F.col("k").cast("double"))
    return fx.pos.select("po_number", fld.json_safe(x).cast("bigint").alias("x")).select("po_number", F.to_json(F.struct("po_number", "x")).alias("json"))


@query("b24_vendor_threshold_overrides", """WITH book AS (SELECT s % 7 AS g, vendor_id, lower(vendor_id) AS a1, lower(name) AS a2 FROM v_vendors WHERE s % 25 = 0)
  SELECT document_id, coalesce(coalesce(p.vendor_id, (SELECT min(b.vendor_id) FROM book b WHERE contains(lower(i.vendor_name), a1) OR contains(a1, lower(i.vendor_name))
      OR contains(lower(i.vendor_name), a2) OR contains(a2, lower(i.vendor_name)))), '') AS profile_id,
    CASE WHEN coalesce(p.vendor_id, (SELECT min(b.vendor_id) FROM book b WHERE contains(lower(i.vendor_name), a1) OR contains(a1, lower(i.vendor_name))
      OR contains(lower(i.vendor_name), a2) OR contains(a2, lower(i.vendor_name)))) IS NULL THEN 0.90e0 ELSE 0.85e0 END AS threshold_invoice_date, 0.95e0 AS threshold_total_amount
  FROM (SELECT i.document_id, trim(i.vendor_name) AS vendor_name, CASE WHEN i.k % 2 = 0 THEN p.vendor_id END AS vendor_id FROM v_invoices i JOIN v_pos p ON p.po_number = i.true_po) i
  LEFT JOIN book p ON p.vendor_id = i.vendor_id""")
def b24(fx):
    profiles = fx.vendors.filter("s % 25 = 0").selectExpr("vendor_id", "array(name) as aliases", "map('invoice_date', 0.85e0) as overrides")
    po = fx.pos.selectExpr("po_number as true_po", "vendor_id as vid")
    inv = fx.invoices.join(po, "true_po").selectExpr("document_id", "vendor_name", "case when k % 2 = 0 then vid end as vendor_id")
    out = fld.vendor_thresholds(inv, profiles, {"invoice_date": 0.90, "total_amount": 0.95})
    return out.select("document_id", F.coalesce("profile_id", F.lit("")).alias("profile_id"), "threshold_invoice_date", "threshold_total_amount")


@query("l1_normalize_description", f"SELECT document_id, line_no, {sql_description_key('''description || ' for the Box, of-4' ''')} AS description_key FROM v_invoice_lines")
def l1(fx):
    return fx.invoice_lines.select("document_id", "line_no", txt.description_key(F.concat("description", F.lit(" for the Box, of-4"))).alias("description_key"))
