"""Service responses, arithmetic, reconciliation, evidence and routing."""

from pyspark.sql import functions as F

from paymatch.operators import arithmetic as ar
from paymatch.plans.oracle_base import CTES
from paymatch.plans.registry import query
from paymatch.sources import extraction_json as xj

# --- A3/A4: the same JSON text is built in both engines --------------------------------------------
_RAW = """CASE WHEN k % 17 = 0 THEN '{"vendor_name": ' WHEN k % 19 = 0 THEN '[1, 2]' WHEN k % 23 = 0 THEN '{"total_amount": {"value": 5, "confidence": "high"}}'
  ELSE '{"invoice_number": ' || CASE k % 4 WHEN 0 THEN '"INV' || k || '"' WHEN 1 THEN 'null' WHEN 2 THEN '{"value": "N' || k || '", "confidence": 1.7, "status": "odd"}'
     ELSE '{"value": null, "confidence": 0.4, "status": "odd"}' END
    || ', "total_amount": {"value": ' || k || '.5, "confidence": 0.9, "status": "inferred"}, "currency": "USD"'
    || ', "extra_charges": [{"label": "Freight", "amount": ' || CASE WHEN k % 3 = 0 THEN '"n/a"' ELSE '12' END || '}, {"label": "Rebate", "amount": "-3.5"}]'
    || ', "line_items": [{"description": "d", "quantity": 2, "unit_price": "x"}]}' END"""
CTES["q_raw_json"] = f"SELECT document_id, k, {_RAW} AS raw_json FROM v_invoices"
_NUM = "json_extract_string(j, '$.invoice_number')"
CTES["q_parsed_json"] = f"""
  SELECT document_id, CASE WHEN k % 4 = 0 THEN 'INV' || k WHEN k % 4 = 2 THEN json_extract_string(j, '$.invoice_number.value') END AS number_value,
    CASE k % 4 WHEN 0 THEN 0.5e0 WHEN 1 THEN 0e0 ELSE greatest(0e0, least(1e0, json_extract_string(j, '$.invoice_number.confidence')::DOUBLE)) END AS number_conf,
    CASE k % 4 WHEN 0 THEN 'extracted' WHEN 1 THEN 'not_found' WHEN 2 THEN 'extracted' ELSE 'not_found' END AS number_status,
    json_extract_string(j, '$.total_amount.value')::DOUBLE AS total_value, json_extract_string(j, '$.total_amount.status') AS total_status,
    CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS n_charges, 1 AS n_lines
  FROM (SELECT document_id, k, raw_json::JSON AS j FROM q_raw_json WHERE k % 17 <> 0 AND k % 19 <> 0 AND k % 23 <> 0)"""


def raw_json(fx):
    return fx.invoices.selectExpr("document_id", "k", f"{_RAW} as raw_json")


@query("a3_parse_extraction_json", """SELECT document_id, coalesce(number_value, '(null)') AS number_value, number_conf, number_status, total_value, total_status,
  n_charges::BIGINT AS n_charges, n_lines::BIGINT AS n_lines FROM q_parsed_json""")
def a3(fx):
    good, _ = xj.parse_extractions(raw_json(fx))
    return good.select("document_id", F.coalesce("invoice_number.value", F.lit("(null)")).alias("number_value"), F.col("invoice_number.confidence").alias("number_conf"),
                       F.col("invoice_number.status").alias("number_status"), F.col("total_amount.value").cast("double").alias("total_value"),
                       F.col("total_amount.status").alias("total_status"), F.size("extra_charges").cast("bigint").alias("n_charges"), F.size("line_items").cast("bigint").alias("n_lines"))


@query("a3_extraction_quarantine", """SELECT document_id, CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN 'not a JSON object' ELSE 'bad confidence' END AS error FROM q_raw_json
  WHERE k % 17 = 0 OR k % 19 = 0 OR k % 23 = 0""")
def a3_bad(fx):
    return xj.parse_extractions(raw_json(fx))[1].select("document_id", "error")


_VER = """CASE k % 6 WHEN 0 THEN '{"verification_status": "pass", "overall_confidence": 1.4, "issues": [{"field": "total_amount", "severity": "high", "reason": "r"}]}'
  WHEN 1 THEN '{"verification_status": "pass", "overall_confidence": 0.8}' WHEN 2 THEN '{"verification_status": "ok", "issues": [{"severity": "fatal"}]}'
  WHEN 3 THEN 'oops' WHEN 4 THEN '{"verification_status": "flag", "overall_confidence": "x", "issues": []}' ELSE '[]' END"""


@query("a4_parse_verification_json", """SELECT document_id, CASE k % 6 WHEN 0 THEN 'flag' WHEN 1 THEN 'pass' WHEN 4 THEN 'flag' ELSE 'uncertain' END AS verification_status,
  CASE k % 6 WHEN 0 THEN 1e0 WHEN 1 THEN 0.8e0 ELSE 0e0 END AS overall_confidence,
  CASE k % 6 WHEN 0 THEN 'total_amount/high/r' WHEN 2 THEN 'unknown/medium/No reason provided' WHEN 3 THEN 'system/medium/Verification response was not valid JSON'
    WHEN 5 THEN 'system/medium/Verification response was not valid JSON' ELSE '' END AS issues FROM v_invoices""")
def a4(fx):
    v = xj.parse_verifications(fx.invoices.selectExpr("document_id", f"{_VER} as raw_json"))
    return v.withColumn("issues", F.array_join(F.transform("issues", lambda i: F.concat_ws("/", i["field"], i["severity"], i["reason"])), "|"))


CTES["q_page_docs"] = "SELECT doc_id AS document_id, 1 + doc_id % 5 AS total_pages, doc_id % 11 <> 0 AS parsed FROM documents"
CTES["q_page_labels"] = """SELECT document_id, page_number, CASE WHEN document_id % 7 = 1 THEN 'signature_block' ELSE CASE (document_id + page_number) % 6 WHEN 0 THEN 'line_items' WHEN 1 THEN 'terms_and_conditions'
    WHEN 2 THEN 'signature_block' WHEN 3 THEN 'other' WHEN 4 THEN 'cover' ELSE 'attachment' END END AS classification, 0.9e0 AS confidence
  FROM (SELECT document_id, unnest(range(1, total_pages + 1)) AS page_number FROM q_page_docs) WHERE (document_id * 3 + page_number) % 4 <> 0"""
CTES["q_pages"] = """SELECT p.document_id, p.page_number, CASE WHEN l.classification IN ('line_items','terms_and_conditions','signature_block','attachment','other') THEN l.classification ELSE 'line_items' END AS classification,
    coalesce(l.confidence, 0.5e0) AS confidence
  FROM (SELECT document_id, parsed, unnest(range(1, total_pages + 1)) AS page_number FROM q_page_docs) p LEFT JOIN q_page_labels l ON l.document_id = p.document_id AND l.page_number = p.page_number AND p.parsed"""


def page_inputs(fx):
    docs = fx.table("documents").selectExpr("doc_id as document_id", "1 + doc_id % 5 as total_pages", "doc_id % 11 <> 0 as parsed")
    labels = docs.selectExpr("document_id", "explode(sequence(1L, total_pages)) as page_number").filter("(document_id * 3 + page_number) % 4 <> 0").selectExpr(
        "document_id", "page_number", """case when document_id % 7 = 1 then 'signature_block' else case (document_id + page_number) % 6 when 0 then 'line_items' when 1 then 'terms_and_conditions'
        when 2 then 'signature_block' when 3 then 'other' when 4 then 'cover' else 'attachment' end end as classification""", "0.9e0 as confidence")
    return docs, labels


@query("a5_normalize_page_labels", "SELECT * FROM q_pages")
def a5(fx):
    return xj.normalize_page_labels(*page_inputs(fx))


@query("a6_select_invoice_pages", """SELECT document_id, page_number, classification FROM (SELECT *, bool_or(keep) OVER (PARTITION BY document_id) AS has FROM (
  SELECT *, classification NOT IN ('terms_and_conditions', 'signature_block') AS keep FROM q_pages)) WHERE keep OR NOT has""")
def a6(fx):
    return xj.select_invoice_pages(xj.normalize_page_labels(*page_inputs(fx))).drop("confidence")


# --- C1-C7 -----------------------------------------------------------------------------------------
CTES["q_line_facts"] = """SELECT document_id AS d, count(*) AS n_lines, sum(amount)::BIGINT AS line_sum, count(*) FILTER (abs(quantity * unit_price - amount) <= 1) AS ok,
  count(*) FILTER (abs(quantity * unit_price - amount) > 1) AS bad FROM v_invoice_lines GROUP BY 1"""
CTES["q_arith"] = """SELECT *, CASE WHEN c_total = 'fail' OR c_lines_sum = 'fail' OR c_positive = 'fail' OR c_tax = 'fail' OR coalesce(bad, 0) > 0 THEN 'fail'
    WHEN c_total = 'skipped' OR c_lines_sum = 'skipped' OR c_positive = 'skipped' OR c_tax = 'skipped' THEN 'partial' ELSE 'pass' END AS arithmetic FROM (
  SELECT document_id, bad, CASE WHEN total_cents IS NULL THEN 'skipped' WHEN abs(subtotal_cents + tax_cents - total_cents) <= 1 THEN 'pass' ELSE 'fail' END AS c_total,
    CASE WHEN n_lines IS NULL THEN 'skipped' WHEN abs(line_sum - subtotal_cents) <= 1 THEN 'pass' ELSE 'fail' END AS c_lines_sum,
    CASE WHEN total_cents IS NULL THEN 'skipped' WHEN total_cents > 0 THEN 'pass' ELSE 'fail' END AS c_positive,
    CASE WHEN total_cents IS NULL THEN 'skipped' WHEN tax_cents <= total_cents THEN 'pass' ELSE 'fail' END AS c_tax
  FROM v_invoices LEFT JOIN q_line_facts ON d = document_id)"""


def arith(fx):
    return ar.arithmetic_checks(fx.invoices, fx.invoice_lines)


@query("c1_check_total", "SELECT document_id, c_total FROM q_arith")
def c1(fx):
    return arith(fx).select("document_id", "c_total")


@query("c2_check_line_amounts", "SELECT document_id, line_no, CASE WHEN abs(quantity * unit_price - amount) <= 1 THEN 'pass' ELSE 'fail' END AS status FROM v_invoice_lines")
def c2(fx):
    return fx.invoice_lines.select("document_id", "line_no", ar.check_line_amount().alias("status"))


@query("c3_check_lines_sum", "SELECT document_id, c_lines_sum FROM q_arith")
def c3(fx):
    return arith(fx).select("document_id", "c_lines_sum")


@query("c4_check_sanity", "SELECT document_id, c_positive, c_tax FROM q_arith")
def c4(fx):
    return arith(fx).select("document_id", "c_positive", "c_tax")


@query("c5_arithmetic_overall", "SELECT document_id, arithmetic FROM q_arith")
def c5(fx):
    return arith(fx).select("document_id", "arithmetic")


CTES["q_charges"] = """SELECT document_id AS d, sum(CASE WHEN contains(lower(label), 'discount') THEN 0 ELSE amount END)::BIGINT AS charge_sum,
  sum(CASE WHEN contains(lower(label), 'discount') THEN abs(amount) ELSE 0 END)::BIGINT AS discount_sum, count(*) AS n FROM v_charges GROUP BY 1"""
CTES["q_recon"] = """SELECT *, CASE WHEN total_cents IS NULL THEN 'partial' WHEN abs(residual) <= 1 AND n_charges > 0 THEN 'reconciled_with_inferred_charges' WHEN abs(residual) <= 1 THEN 'reconciled'
    WHEN charge_sum = 0 AND discount_sum <= 1 AND abs(residual) >= 5000 THEN 'residual_review' WHEN charge_sum = 0 AND discount_sum <= 1 THEN 'reconciled_with_inferred_charges' ELSE 'failed' END AS reconciliation
  FROM (SELECT i.*, coalesce(charge_sum, 0) AS charge_sum, coalesce(discount_sum, 0) AS discount_sum, coalesce(c.n, 0) AS n_charges, coalesce(l.n_lines, 0) AS n_lines, coalesce(line_sum, 0) AS line_sum, coalesce(bad, 0) AS bad,
      coalesce(ok, 0) AS ok, total_cents - (subtotal_cents + tax_cents + coalesce(charge_sum, 0) - coalesce(discount_sum, 0)) AS residual
    FROM v_invoices i LEFT JOIN q_line_facts l ON l.d = document_id LEFT JOIN q_charges c ON c.d = document_id)"""
CTES["q_recon2"] = """SELECT *, CASE WHEN reconciliation = 'failed' THEN 1 + bad ELSE 0 END + CASE WHEN line_sum > 0 AND abs(line_sum - subtotal_cents) > 1 THEN 1 ELSE 0 END AS fail_checks FROM q_recon"""


def recon(fx):
    return ar.reconcile(fx.invoices, fx.invoice_lines, fx.charges)


@query("c6_reconcile", """SELECT document_id, reconciliation, CASE WHEN total_cents IS NULL OR abs(residual) <= 1 THEN 0 ELSE residual END AS residual,
  concat_ws(',', CASE WHEN line_sum > 0 THEN 'line_items_sum_equals_subtotal:' || CASE WHEN abs(line_sum - subtotal_cents) <= 1 THEN 'pass' ELSE 'fail' END END,
    CASE WHEN total_cents IS NULL THEN 'primary_total_reconciliation:skipped' WHEN abs(residual) <= 1 THEN 'primary_total_reconciliation:pass'
         WHEN reconciliation <> 'failed' THEN 'residual_inferred_charge:review' ELSE 'primary_total_reconciliation:fail' END,
    CASE WHEN reconciliation = 'failed' AND n_lines > 0 THEN 'line_item_amounts:pass=' || ok || ' fail=' || bad END,
    CASE WHEN reconciliation = 'failed' AND total_cents > 0 THEN 'positive_total:pass' END, CASE WHEN reconciliation = 'failed' AND tax_cents <= total_cents THEN 'tax_not_exceeds_total:pass' END) AS checks FROM q_recon""")
def c6(fx):
    return recon(fx).select("document_id", "reconciliation", "residual", F.array_join("recon_checks", ",").alias("checks"))


@query("c7_reconciliation_to_arithmetic", "SELECT document_id, CASE WHEN reconciliation = 'failed' THEN 'fail' WHEN reconciliation LIKE 'reconciled%' THEN 'pass' ELSE 'partial' END AS arithmetic FROM q_recon")
def c7(fx):
    return recon(fx).select("document_id", ar.reconciliation_to_arithmetic("reconciliation").alias("arithmetic"))


# --- C8-C12 ----------------------------------------------------------------------------------------
_ALL = (("vendor", "vendor_name IS NOT NULL AND vendor_status <> 'not_found'"), ("total", "total_cents IS NOT NULL AND total_status <> 'not_found'"),
        ("po_reference", "po_value IS NOT NULL AND po_status <> 'not_found'"), ("line_items", "n_lines > 0"), ("typed_references", "ref_value IS NOT NULL"),
        ("currency", "currency IS NOT NULL AND currency_status <> 'not_found'"), ("invoice_number", "invoice_number IS NOT NULL AND number_status <> 'not_found'"),
        ("invoice_date", "invoice_date IS NOT NULL AND date_status <> 'not_found'"))
_APPROVAL, _MATCHABLE = ("vendor", "total", "currency"), ("vendor", "total", "po_reference", "line_items", "typed_references")


def _labels(names, negate=False):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {'NOT ' if negate else ''}({c}) THEN '{n}' END" for n, c in _ALL if n in names) + ")"


CTES["q_evidence"] = f"""SELECT *, {_labels([n for n, _ in _ALL])} AS available, {_labels(_APPROVAL, True)} AS missing, {_labels([n for n, _ in _ALL if n not in _APPROVAL], True)} AS optional_missing,
  {_labels(_MATCHABLE)} AS matchable FROM q_recon2"""
CTES["q_quality"] = """SELECT *, CASE WHEN matchable = '' THEN 'extraction_weak' WHEN missing <> '' THEN 'extraction_partial' ELSE 'extraction_complete' END AS quality FROM q_evidence"""


def evidence(fx):
    return ar.evidence_profile(recon(fx).withColumn("n_refs", F.col("ref_value").isNotNull().cast("int")))


@query("c8_evidence_profile", "SELECT document_id, available, missing, optional_missing, matchable, '' AS uncertain, missing AS critical_missing FROM q_evidence")
def c8(fx):
    return evidence(fx).select("document_id", *[F.array_join(c, ",").alias(c) for c in ("available", "missing", "optional_missing", "matchable", "uncertain", "critical_missing")])


@query("c9_can_match", "SELECT document_id, matchable <> '' AS can_match FROM q_evidence")
def c9(fx):
    return evidence(fx).select("document_id", "can_match")


@query("c10_extraction_quality", "SELECT document_id, quality AS extraction_quality FROM q_quality")
def c10(fx):
    return evidence(fx).select("document_id", "extraction_quality")


CTES["q_route"] = """SELECT document_id, quality, concat_ws(',', CASE WHEN v = 'unavailable' THEN 'verification:unavailable' END,
    CASE WHEN total_cents IS NULL THEN 'total_amount:missing' WHEN CASE WHEN boosted THEN least(1e0, total_conf + 0.05e0) ELSE total_conf END < 0.95e0 THEN 'total_amount:below_threshold' END,
    CASE WHEN vendor_name IS NULL THEN 'vendor_name:missing' WHEN vendor_status = 'uncertain' THEN 'vendor_name:uncertain' WHEN vendor_conf < 0.85e0 THEN 'vendor_name:below_threshold' END,
    CASE WHEN currency IS NULL THEN 'currency:missing' END, CASE WHEN k % 9 = 0 THEN 'verification:flag' WHEN v = 'uncertain' THEN 'verification:uncertain' END,
    CASE WHEN reconciliation = 'residual_review' THEN 'reconciliation:residual_review' WHEN reconciliation = 'failed' THEN 'reconciliation:failed_checks=' || fail_checks END) AS flags
  FROM (SELECT *, v = 'pass' AND reconciliation <> 'failed' AS boosted FROM (SELECT *, CASE k % 9 WHEN 0 THEN 'flag' WHEN 1 THEN 'flag' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'unavailable' ELSE 'pass' END AS v FROM q_quality))"""


def verified(x):
    return x.withColumns({
        "verification_status": F.expr("case k % 9 when 0 then 'flag' when 1 then 'flag' when 2 then 'uncertain' when 3 then 'unavailable' else 'pass' end"),
        "issues": F.expr("case k % 9 when 0 then array(named_struct('field', 'total_amount', 'severity', 'low')) "
                         "when 1 then array(named_struct('field', 'due_date', 'severity', 'high')) else cast(array() as array<struct<field:string,severity:string>>) end")})


@query("c11_route_invoice", "SELECT document_id, flags, CASE WHEN quality = 'extraction_weak' OR flags <> '' THEN 'needs_human_review' ELSE 'stage1_passed' END AS status FROM q_route")
def c11(fx):
    return ar.route_invoice(verified(evidence(fx))).select("document_id", F.array_join("review_flags", ",").alias("flags"), "status")


@query("c12_avg_field_confidence", "SELECT document_id, (0e0 + vendor_conf + number_conf + date_conf + total_conf + subtotal_conf + tax_conf) / 6 AS confidence FROM v_invoices")
def c12(fx):
    return fx.invoices.select("document_id", ar.avg_field_confidence("vendor_conf", "number_conf", "date_conf", "total_conf", "subtotal_conf", "tax_conf").alias("confidence"))
