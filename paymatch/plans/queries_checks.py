"""Validation context and checks."""

from pyspark.sql import functions as F

from paymatch.operators import chain
from paymatch.operators import checks as ck
from paymatch.plans.oracle_base import CTES
from paymatch.plans.queries_extraction import recon
from paymatch.plans.queries_match import masters, packages, prepared
from paymatch.plans.registry import query
from paymatch.policy import CHECK_ORDER, LIMITED_CHECKS

CTES["v_vendor_changes"] = "SELECT company_id, vendor_id, CASE WHEN s % 19 = 0 THEN 'unverified' ELSE 'verified' END AS bank_change FROM v_vendors WHERE s % 19 = 0 OR s % 23 = 0"
CTES["v_paid_vendors"] = """SELECT DISTINCT p.company_id, p.vendor_id FROM v_allocations a JOIN v_pos p ON p.po_number = a.po_number WHERE p.s % 3 <> 1"""
CTES["q_findings"] = """
  SELECT m.document_id, m.po_number, bool_or(p.p > 0 AND abs(i.p - p.p) / p.p > 0.02e0) AS price_fail, bool_or(p.q > 0 AND abs(i.q - p.q) / p.q > 0.05e0) AS qty_flag
  FROM q_maps m JOIN q_match s ON s.document_id = m.document_id AND s.selected[1] = m.po_number
  LEFT JOIN q_split_lines o ON o.document_id = m.document_id AND o.il = m.il AND o.po_number = m.po_number
  JOIN q_il i ON i.document_id = m.document_id AND i.il = m.il JOIN q_pl p ON p.po_number = m.po_number AND p.pl = m.po_line
  WHERE m.match_type <> 'unmatched' AND (NOT s.multi OR o.il IS NOT NULL) GROUP BY ALL"""
CTES["q_dup"] = """
  SELECT x.document_id, count(*) FILTER (p.n = x.n AND p.a = x.a) AS n_exact, count(*) FILTER (p.n = x.n AND NOT coalesce(p.a = x.a, false)) AS n_number,
    count(*) FILTER (NOT coalesce(p.n = x.n, false) AND p.a = x.a AND abs(datediff('day', p.d, x.d)) <= 3) AS n_near
  FROM (SELECT company_id, document_id, translate(trim(upper(vendor_name)), '.,', '') AS v, upper(trim(invoice_number)) AS n, total_cents AS a, invoice_date AS d FROM v_invoices WHERE vendor_name <> '') x
  JOIN (SELECT company_id, document_id, translate(trim(upper(vendor_name)), '.,', '') AS v, upper(trim(invoice_number)) AS n, total_cents AS a, invoice_date AS d FROM q_blocking WHERE blocking AND vendor_name <> '') p
    ON p.company_id = x.company_id AND p.v = x.v AND p.document_id <> x.document_id GROUP BY 1"""
CTES["q_blocking"] = """
  SELECT *, CASE WHEN decision IN ('REJECT', 'TERMINAL_REJECT') OR stage3_status = 'BLOCKED' THEN false WHEN decision IN ('APPROVE', 'AUTO_APPROVED', 'APPROVAL_REQUIRED') THEN true
    ELSE document_id IN (SELECT document_id FROM v_allocations) END AS blocking FROM v_prior_runs"""
_MODE = """CASE WHEN suggestion AND match_status IN ('waiting_for_po', 'suggested_po_match', 'unmatched', 'multiple_candidates') AND len(selected) = 0 THEN 'none'
    WHEN match_status IN ('matched', 'high_confidence_match', 'partial_match', 'ambiguous_match', 'waiting_for_grn', 'closed_po_review') THEN
      CASE WHEN suggestion AND provenance NOT IN ('evidence', 'authoritative_po', 'human_confirmed') THEN 'none' WHEN match_status = 'ambiguous_match' AND provenance <> 'human_confirmed' THEN 'none' ELSE 'full' END
    WHEN match_status = 'non_po_workflow' THEN 'limited' WHEN match_status IN ('waiting_for_po', 'suggested_po_match', 'unmatched', 'multiple_candidates') THEN 'none' ELSE 'invalid' END"""
CTES["q_ctx"] = f"""
  SELECT i.*, m.selected[1] AS po_number, p.po_number IS NOT NULL AS has_po, p.vendor_id AS po_vendor_id, p.total_amount AS po_total, p.previously_invoiced AS po_prior, p.total_amount - p.previously_invoiced AS po_remaining,
    p.po_type, v.vendor_id IS NOT NULL AS has_vendor, v.status AS vendor_state, CASE WHEN len(m.selected) > 0 THEN nullif(m.vendor_id, '') END AS resolved_vendor_id, m.cand_vendor AS match_vendor_id,
    g.n AS n_grn, coalesce(g.received, 0) AS received_cents, c.bank_change, m.match_status, m.mode, e.reconciliation, coalesce(f.price_fail, false) AS price_fail, coalesce(f.qty_flag, false) AS qty_flag,
    coalesce(d.n_exact, 0) AS n_exact, coalesce(d.n_number, 0) AS n_number, coalesce(d.n_near, 0) AS n_near, nullif(m.cand_vendor, '') IS NOT NULL AND pv.vendor_id IS NULL AS is_new_vendor,
    CASE WHEN p.import_derived THEN CASE WHEN subtotal_cents > 0 THEN tax_cents::DOUBLE / subtotal_cents ELSE 0.08e0 END ELSE 0.08e0 END AS tax_rate, p.import_derived AS po_import
  FROM v_invoices i JOIN (SELECT *, {_MODE} AS mode FROM q_match) m ON m.document_id = i.document_id LEFT JOIN v_pos p ON p.company_id = i.company_id AND p.po_number = m.selected[1]
  LEFT JOIN v_vendors v ON v.company_id = i.company_id AND v.vendor_id = m.cand_vendor
  LEFT JOIN (SELECT company_id, po_number, sum(received_amount)::BIGINT AS received, count(*) AS n FROM v_grn GROUP BY ALL) g ON g.company_id = i.company_id AND g.po_number = m.selected[1]
  LEFT JOIN v_vendor_changes c ON c.company_id = v.company_id AND c.vendor_id = v.vendor_id LEFT JOIN q_findings f ON f.document_id = i.document_id LEFT JOIN (SELECT document_id, reconciliation FROM q_recon) e ON e.document_id = i.document_id
  LEFT JOIN q_dup d ON d.document_id = i.document_id LEFT JOIN v_paid_vendors pv ON pv.company_id = i.company_id AND pv.vendor_id = m.cand_vendor"""


def chain_inputs(fx):
    """What validation needs besides the match: vendor changes, vendors paid before, counts of duplicates, reconciliation."""
    changes = fx.vendors.filter("s % 19 = 0 or s % 23 = 0").selectExpr("company_id", "vendor_id as match_vendor_id", "case when s % 19 = 0 then 'unverified' else 'verified' end as bank_change")
    paid = fx.allocations.select("po_number").join(fx.pos.filter("s % 3 <> 1").select("company_id", "po_number", "vendor_id"), "po_number")
    return chain.History(changes, paid, ck.prior_is_blocking(fx.prior_runs, fx.allocations))


def build_context(fx):
    prepared(fx)
    state = recon(fx).select("company_id", "document_id", "reconciliation")
    return chain.validation_inputs(fx.invoices.join(state, ["company_id", "document_id"]), fx.invoice_lines, packages(fx), masters(fx), chain_inputs(fx))


def context(fx):
    return fx.memo("context", lambda: build_context(fx))


@query("j16_validation_context", """SELECT document_id, coalesce(po_number, '') AS po_number, has_po, coalesce(po_total, -1) AS po_total, coalesce(po_remaining, -1) AS po_remaining, coalesce(po_type, '') AS po_type,
  coalesce(vendor_state, '') AS vendor_state, n_grn IS NOT NULL AS has_grn, received_cents, tax_rate FROM q_ctx""")
def j16(fx):
    return context(fx).select("document_id", F.coalesce("po_number", F.lit("")).alias("po_number"), "has_po", F.coalesce("po_total", F.lit(-1)).alias("po_total"),
                              F.coalesce("po_remaining", F.lit(-1)).alias("po_remaining"), F.coalesce("po_type", F.lit("")).alias("po_type"),
                              F.coalesce("vendor_state", F.lit("")).alias("vendor_state"), "has_grn", "received_cents", "tax_rate")


@query("v1_validation_mode", f"SELECT document_id, {_MODE} AS mode FROM q_match")
def v1(fx):
    return packages(fx).withColumn("n_matched", F.size("matched_pos")).select("document_id", ck.validation_mode().alias("mode"))


_OVER = "(po_total > 0 AND abs(total_cents - po_total)::DOUBLE / po_total > 0.04e0)"
CTES["q_checks"] = f"""
  SELECT *, CASE WHEN NOT has_po THEN 'NOT_APPLICABLE' WHEN price_fail THEN 'FAIL' WHEN qty_flag OR coalesce({_OVER}, false) OR coalesce(total_cents > po_remaining, false) THEN 'FLAG' ELSE 'PASS' END AS s_amount_variance,
    CASE WHEN tax_cents = 0 THEN 'PASS' WHEN subtotal_cents > 0 THEN CASE WHEN CASE WHEN subtotal_cents * tax_rate > 0 THEN abs(tax_cents - subtotal_cents * tax_rate) / (subtotal_cents * tax_rate) ELSE 0e0 END > 0.12e0 THEN 'FAIL' ELSE 'PASS' END
         ELSE 'FLAG' END AS s_tax_validation,
    CASE WHEN coalesce(invoice_number, '') = '' AND coalesce(vendor_name, '') = '' THEN 'NOT_APPLICABLE' WHEN n_exact > 0 THEN 'FAIL' WHEN n_number > 0 OR n_near > 0 THEN 'FLAG' ELSE 'PASS' END AS s_duplicate_detection,
    CASE WHEN NOT has_vendor THEN CASE WHEN match_status = 'non_po_workflow' THEN 'FLAG' ELSE 'UNAVAILABLE' END WHEN vendor_state IN ('inactive', 'suspended') OR coalesce(bank_change = 'unverified', false) THEN 'FAIL'
         WHEN vendor_state <> 'active' OR (has_po AND coalesce(coalesce(resolved_vendor_id, match_vendor_id) <> po_vendor_id, false)) THEN 'FLAG' ELSE 'PASS' END AS s_vendor_validation,
    CASE WHEN NOT has_po THEN 'NOT_APPLICABLE' WHEN po_type = 'blanket' THEN 'PASS' WHEN n_grn IS NULL THEN 'UNAVAILABLE' WHEN total_cents IS NULL OR received_cents <= 0 THEN 'PASS'
         WHEN CASE WHEN total_cents > 0 THEN received_cents::DOUBLE / total_cents ELSE 0e0 END >= 0.95e0 THEN 'PASS' ELSE 'FLAG' END AS s_receipt_match,
    CASE WHEN NOT has_po THEN 'NOT_APPLICABLE' WHEN total_cents IS NULL THEN 'UNAVAILABLE' WHEN total_cents <= po_remaining THEN 'PASS' WHEN total_cents <= po_remaining + po_total * 0.05e0 THEN 'FLAG' ELSE 'FAIL' END AS s_budget_tolerance,
    coalesce((total_cents >= 100000 AND total_cents % 100000 = 0) OR (total_cents >= 500000 AND total_cents % 50000 = 0), false) AS g_round,
    coalesce(CASE WHEN total_cents < 1000000 AND 1000000 - total_cents <= 30000 THEN 1000000 END, CASE WHEN total_cents < 2500000 AND 2500000 - total_cents <= 75000 THEN 2500000 END,
             CASE WHEN total_cents < 5000000 AND 5000000 - total_cents <= 150000 THEN 5000000 END, 0) AS g_shaved,
    coalesce(length(trim(invoice_number)) < 3, false) AS g_short, coalesce(total_cents > 2000000 AND is_new_vendor, false) AS g_new,
    list_filter([CASE WHEN match_status NOT IN ('matched', 'high_confidence_match', 'partial_match') AND invoice_number IS NULL THEN 'missing_invoice_number' WHEN match_status NOT IN ('matched', 'high_confidence_match', 'partial_match') AND number_status = 'uncertain' THEN 'missing_invoice_number_uncertain' END,
      CASE WHEN match_status NOT IN ('matched', 'high_confidence_match', 'partial_match') AND invoice_date IS NULL THEN 'missing_invoice_date' END, CASE WHEN currency IS NULL THEN 'missing_currency' END,
      CASE WHEN reconciliation = 'residual_review' THEN 'reconciliation_residual' END], lambda c: c IS NOT NULL) AS x_reasons
  FROM q_ctx"""
CTES["q_checked"] = """
  SELECT *, CASE WHEN g_shaved > 0 OR g_new THEN 'FLAG' ELSE 'PASS' END AS s_fraud_signals, CASE WHEN len(x_reasons) = 0 THEN 'PASS' ELSE 'FLAG' END AS s_extraction_completeness,
    CASE s_amount_variance WHEN 'NOT_APPLICABLE' THEN 'NO_PO_CONTEXT' WHEN 'FAIL' THEN 'PRICE_VARIANCE_EXCEEDED' WHEN 'FLAG' THEN 'AMOUNT_VARIANCE_DETECTED' ELSE '' END AS r_amount_variance,
    CASE s_tax_validation WHEN 'FAIL' THEN 'TAX_VARIANCE' WHEN 'FLAG' THEN 'TAX_BASE_MISSING' ELSE '' END AS r_tax_validation,
    CASE s_duplicate_detection WHEN 'NOT_APPLICABLE' THEN 'INSUFFICIENT_DATA' WHEN 'FAIL' THEN 'DUPLICATE_CONFIRMED' WHEN 'FLAG' THEN 'DUPLICATE_SUSPECTED' ELSE '' END AS r_duplicate_detection,
    CASE WHEN NOT has_vendor THEN CASE WHEN match_status = 'non_po_workflow' THEN 'VENDOR_NOT_VERIFIED' ELSE 'NO_VENDOR_DATA' END WHEN s_vendor_validation = 'FAIL' THEN 'VENDOR_INELIGIBLE'
         WHEN s_vendor_validation = 'FLAG' THEN 'VENDOR_REVIEW_REQUIRED' ELSE '' END AS r_vendor_validation,
    CASE s_receipt_match WHEN 'NOT_APPLICABLE' THEN 'NO_PO_CONTEXT' WHEN 'UNAVAILABLE' THEN 'GRN_MISSING' WHEN 'FLAG' THEN CASE WHEN total_cents <= 0 OR received_cents::DOUBLE / total_cents < 0.5e0 THEN 'LOW_RECEIPT_COVERAGE' ELSE 'PARTIAL_RECEIPT' END ELSE '' END AS r_receipt_match,
    CASE s_budget_tolerance WHEN 'NOT_APPLICABLE' THEN 'NO_PO_CONTEXT' WHEN 'UNAVAILABLE' THEN 'NO_INVOICE_TOTAL' WHEN 'FLAG' THEN 'BUDGET_TOLERANCE_USED' WHEN 'FAIL' THEN 'BUDGET_EXCEEDED' ELSE '' END AS r_budget_tolerance,
    CASE WHEN g_shaved > 0 OR g_new THEN 'FRAUD_SIGNALS_MEDIUM' WHEN g_round OR g_short THEN 'FRAUD_SIGNALS_LOW' ELSE '' END AS r_fraud_signals,
    CASE WHEN len(x_reasons) = 0 THEN 'EXTRACTION_OK' WHEN len(x_reasons) >= 2 THEN 'EXTRACTION_FIELDS_INCOMPLETE' ELSE upper(x_reasons[1]) END AS r_extraction_completeness
  FROM q_checks"""

CTES["q_check_rows"] = "\n UNION ALL ".join(
    f"SELECT document_id, {i} AS ord, '{c}' AS check_id, s_{c} AS status, r_{c} AS reason_code FROM q_checked WHERE mode = 'full'"
    + (" OR mode = 'limited'" if c in LIMITED_CHECKS or c == "extraction_completeness" else "") for i, c in enumerate(CHECK_ORDER))


def _one_check(name, check_id, fn, prepare=None):
    @query(name, f"SELECT document_id, s_{check_id} AS status, r_{check_id} AS reason_code FROM q_checked")
    def run(fx):
        x = context(fx)
        x = prepare(x) if prepare else x
        return x.withColumn("c", fn()).select("document_id", "c.status", "c.reason_code")
    return run


_one_check("v2_check_amount", "amount_variance", ck.check_amount)
_one_check("v3_check_tax", "tax_validation", ck.check_tax)
_one_check("v5_check_duplicates", "duplicate_detection", ck.check_duplicates)
_one_check("v7_check_vendor", "vendor_validation", ck.check_vendor)
_one_check("v8_check_receipt", "receipt_match", ck.check_receipt)
_one_check("v9_check_budget", "budget_tolerance", ck.check_budget)
_one_check("v14_check_fraud", "fraud_signals", ck.check_fraud, lambda x: x.withColumn("signals", ck.fraud_signals()))
_one_check("v15_check_extraction_fields", "extraction_completeness", ck.check_extraction_fields)


@query("v4_expected_tax_rate", "SELECT document_id, tax_rate FROM q_ctx")
def v4(fx):
    return context(fx).select("document_id", ck.expected_tax_rate().alias("tax_rate"))


@query("v5_duplicate_counts", "SELECT document_id, n_exact, n_number, n_near FROM q_dup WHERE n_exact + n_number + n_near > 0")
def v5_counts(fx):
    d = ck.duplicate_counts(fx.invoices, ck.prior_is_blocking(fx.prior_runs, fx.allocations))
    return d.filter("n_exact + n_number + n_near > 0").select("document_id", "n_exact", "n_number", "n_near")


@query("v6_prior_is_blocking", "SELECT document_id, blocking FROM q_blocking")
def v6(fx):
    return ck.prior_is_blocking(fx.prior_runs, fx.allocations).select("document_id", "blocking")


@query("v10_signal_round_number", "SELECT document_id, g_round AS hit FROM q_checks")
def v10(fx):
    return fx.invoices.select("document_id", ck.round_number().alias("hit"))


@query("v11_signal_threshold_shaving", "SELECT document_id, g_shaved AS threshold FROM q_checks")
def v11(fx):
    return fx.invoices.select("document_id", F.coalesce(ck.shaved_threshold(), F.lit(0)).cast("bigint").alias("threshold"))


@query("v12_signal_short_number", "SELECT document_id, g_short AS hit FROM q_checks")
def v12(fx):
    return fx.invoices.select("document_id", ck.short_number().alias("hit"))


@query("v13_signal_new_vendor_high", "SELECT document_id, g_new AS hit FROM q_checks")
def v13(fx):
    return context(fx).select("document_id", ck.new_vendor_high().alias("hit"))


_SIGNALS = "concat_ws(',', CASE WHEN g_round THEN 'ROUND_NUMBER' END, CASE WHEN g_shaved > 0 THEN 'THRESHOLD_SHAVING' END, CASE WHEN g_short THEN 'SEQUENCE_ANOMALY' END, CASE WHEN g_new THEN 'NEW_VENDOR_HIGH_AMOUNT' END)"
CTES["q_controls"] = """
  SELECT document_id, count(*) FILTER (reason_code IN ('DUPLICATE_CONFIRMED', 'VENDOR_BLACKLISTED')) AS n_block, count(*) FILTER (status = 'FAIL' AND reason_code <> 'DUPLICATE_CONFIRMED') AS n_hold,
    count(*) FILTER (status = 'UNAVAILABLE') AS n_gone, count(*) FILTER (status = 'FLAG') AS n_flag,
    list(reason_code ORDER BY ord) FILTER (reason_code = 'DUPLICATE_CONFIRMED') AS l_block, list(reason_code ORDER BY ord) FILTER (status = 'FAIL' AND reason_code <> 'DUPLICATE_CONFIRMED') AS l_hold,
    list(reason_code ORDER BY ord) FILTER (status = 'UNAVAILABLE') AS l_gone, list(reason_code ORDER BY ord) FILTER (status = 'FLAG') AS l_flag
  FROM q_check_rows GROUP BY 1"""
CTES["q_report"] = """
  SELECT * REPLACE (CASE WHEN mode = 'none' THEN ['CONTRACT_GATE_NO_VALIDATION'] WHEN mode = 'invalid' THEN ['CONTRACT_FAILURE'] ELSE list_filter(list_concat(reasons, x_reasons), lambda r, i: list_position(list_concat(reasons, x_reasons), r) = i) END AS reasons) FROM (
  SELECT c.*, CASE WHEN mode IN ('none', 'invalid') THEN 'VALIDATION_INCOMPLETE' WHEN n_block > 0 THEN 'BLOCKED' WHEN n_hold > 0 THEN 'HOLD' WHEN n_gone > 0 THEN 'VALIDATION_INCOMPLETE'
      WHEN n_flag > 0 OR g_shaved > 0 OR g_new OR match_status = 'ambiguous_match' THEN 'REVIEW_REQUIRED' ELSE 'VALIDATED' END AS overall_state,
    CASE WHEN n_block > 0 THEN l_block WHEN n_hold > 0 THEN l_hold WHEN n_gone > 0 THEN l_gone
      ELSE list_filter(list_concat(coalesce(l_flag, []), [CASE WHEN g_shaved > 0 THEN 'THRESHOLD_SHAVING' END, CASE WHEN g_new THEN 'NEW_VENDOR_HIGH_AMOUNT' END,
        CASE WHEN match_status = 'ambiguous_match' THEN 'AMBIGUOUS_PO_MATCH' END]), lambda r: r IS NOT NULL) END AS reasons,
    CASE WHEN mode IN ('none', 'invalid') THEN '' WHEN n_block > 0 THEN 'BLOCK' WHEN n_hold > 0 THEN 'HOLD' ELSE '' END AS control_type,
    CASE WHEN mode IN ('none', 'invalid') THEN 0 WHEN n_block > 0 THEN n_block WHEN n_hold > 0 THEN n_hold ELSE 0 END AS n_controls
  FROM q_checked c LEFT JOIN q_controls t ON t.document_id = c.document_id)"""


def report(fx):
    return fx.memo("report", lambda: ck.validation_report(context(fx), F.col("arrival_ts")))


@query("v14_fraud_signal_list", f"SELECT document_id, {_SIGNALS} AS signals FROM q_checks")
def v14_signals(fx):
    return context(fx).withColumn("g", ck.fraud_signals()).select("document_id", F.array_join(F.transform("g", lambda s: s["signal"]), ",").alias("signals"))


@query("v16_aggregate_controls", "SELECT document_id, overall_state, control_type, n_controls FROM q_report WHERE mode IN ('full', 'limited')")
def v16(fx):
    x = ck.aggregate_controls(ck.run_checks(context(fx))).filter("mode in ('full', 'limited')")
    return x.select("document_id", "overall_state", F.coalesce(F.try_element_at("controls", F.lit(1))["control_type"], F.lit("")).alias("control_type"), F.size("controls").cast("bigint").alias("n_controls"))


@query("v16_check_rows", "SELECT document_id, check_id, status, reason_code FROM q_check_rows")
def v16_rows(fx):
    return ck.run_checks(context(fx)).select("document_id", F.explode("checks").alias("c")).select("document_id", "c.check_id", "c.status", "c.reason_code")


@query("v17_validation_report", """SELECT document_id, overall_state, array_to_string(reasons, ',') AS reason_codes, CASE WHEN mode = 'none' THEN 'MANUAL_REVIEW' WHEN mode = 'invalid' THEN 'INVESTIGATE' WHEN overall_state IN ('VALIDATED', 'REVIEW_REQUIRED') THEN 'STAGE4_DECISION'
    WHEN overall_state IN ('HOLD', 'BLOCKED') THEN 'EXCEPTION_RESOLUTION' ELSE 'WAIT_OR_REVALIDATE' END AS next_action, mode = 'none' OR (mode <> 'invalid' AND overall_state IN ('HOLD', 'VALIDATION_INCOMPLETE')) AS revalidation_eligible FROM q_report""")
def v17(fx):
    return report(fx).select("document_id", "overall_state", F.array_join("reason_codes", ",").alias("reason_codes"), "next_action", "revalidation_eligible")


@query("q10_po_utilization", "SELECT document_id, coalesce((po_prior + total_cents)::DOUBLE / po_total, -1e0) AS utilization, coalesce(po_remaining - total_cents, 0) AS left_cents FROM q_ctx WHERE has_po")
def q10(fx):
    return context(fx).filter("has_po").select("document_id", F.coalesce(ck.po_utilization(), F.lit(-1.0)).alias("utilization"),
                                               F.coalesce(F.col("po_remaining") - F.col("total_cents"), F.lit(0)).alias("left_cents"))
