"""Validation checks over matched invoices.

A check is a column STRUCT<check_id, status, reason_code, severity>; all of them sit on one row per invoice, so
running every check costs no shuffle beyond the joins of the context.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.functions.expr import flags, lookup, true
from paymatch.functions.text import duplicate_vendor_key
from paymatch.policy import (BLOCK_REASONS, CHECK_ORDER, CHECKS, FULL_VALIDATION_STATES, LIMITED_CHECKS, MATCH_STATES,
                             NO_VALIDATION_STATES, PO_RESOLVED_STATES, TRUSTED_PROVENANCE, CheckPolicy)


def check(check_id: str, status, reason, severity) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(F.lit(check_id).alias("check_id"), lit(status).alias("status"),
                    F.coalesce(lit(reason), F.lit("")).alias("reason_code"), lit(severity).alias("severity"))


# --- J16 context ----------------------------------------------------------------------------------
def receipts(grn: DataFrame) -> DataFrame:
    """Receipts folded to one row per order before any join.  Their status is not looked at."""
    return grn.groupBy("company_id", "po_number").agg(F.sum("received_amount").alias("received_cents"), F.count(F.lit(1)).alias("n_grn"))


def validation_context(inv: DataFrame, matched: DataFrame, pos: DataFrame, vendors: DataFrame, grn: DataFrame,
                       policy: CheckPolicy = CHECKS) -> DataFrame:
    """J16.  `matched`: (company_id, document_id, po_number, match_vendor_id, resolved_vendor_id, match_status ...)."""
    p = pos.select("company_id", "po_number", F.col("vendor_id").alias("po_vendor_id"), F.col("total_amount").alias("po_total"),
                   F.col("previously_invoiced").alias("po_prior"), "po_type", F.col("import_derived").alias("po_import"),
                   F.lit(True).alias("has_po"))
    v = vendors.select("company_id", F.col("vendor_id").alias("match_vendor_id"), F.col("status").alias("vendor_state"), F.lit(True).alias("has_vendor"))
    x = inv.join(matched, ["company_id", "document_id"], "left").join(p, ["company_id", "po_number"], "left")
    x = x.join(v, ["company_id", "match_vendor_id"], "left").join(receipts(grn), ["company_id", "po_number"], "left")
    x = x.withColumns({"has_po": true(F.col("has_po")), "has_vendor": true(F.col("has_vendor")),
                       "po_remaining": F.col("po_total") - F.col("po_prior"), "has_grn": F.col("n_grn").isNotNull(),
                       "received_cents": F.coalesce("received_cents", F.lit(0).cast("bigint"))})
    return x.withColumn("tax_rate", expected_tax_rate(policy))


def expected_tax_rate(policy: CheckPolicy = CHECKS) -> Column:
    """V4."""
    own = F.when(true(F.col("subtotal_cents") > 0) & F.col("tax_cents").isNotNull(), F.col("tax_cents") / F.col("subtotal_cents"))
    consistency = F.coalesce(own, F.lit(policy.default_tax_rate))
    by_mode = {"zero_exempt": F.lit(0.0), "consistency_only": consistency}.get(policy.tax_mode, F.lit(policy.default_tax_rate))
    base = F.when(true(F.col("po_import")), consistency).otherwise(by_mode)
    return F.coalesce(lookup(F.lower(F.trim("vendor_name")), dict(policy.vendor_tax_rates), None, "double"), base)


# --- V1 -------------------------------------------------------------------------------------------
def validation_mode() -> Column:
    """V1.  From match_status, suggestion, provenance and the number of matched orders."""
    s = F.col("match_status")
    unsure = F.col("suggestion") & s.isin(*NO_VALIDATION_STATES) & (F.col("n_matched") == 0)
    full = (F.when(F.col("suggestion") & ~F.col("provenance").isin(*TRUSTED_PROVENANCE), "none")
            .when((s == "ambiguous_match") & (F.col("provenance") != "human_confirmed"), "none").otherwise("full"))
    return (F.when(~s.isin(*MATCH_STATES), "invalid").when(unsure, "none").when(s.isin(*FULL_VALIDATION_STATES), full)
            .when(s == "non_po_workflow", "limited").when(s.isin(*NO_VALIDATION_STATES), "none").otherwise("invalid"))


# --- V2, V3, V7-V9, V15 ---------------------------------------------------------------------------
def line_variances(policy: CheckPolicy = CHECKS) -> tuple[Column, Column]:
    """(price fails, quantity flags) over `maps` with the `inv_lines` and `po_lines` arrays of the pair."""
    def both(test):
        def one(m):
            i = F.try_element_at(F.filter("inv_lines", lambda l: l["no"] == m["invoice_line"]), F.lit(1))
            p = F.try_element_at(F.filter("po_lines", lambda l: l["no"] == m["po_line"]), F.lit(1))
            return (m["match_type"] != "unmatched") & true(test(i, p))
        return F.exists("maps", one)
    price = both(lambda i, p: (p["p"] > 0) & (F.abs(i["p"] - p["p"]) / p["p"] > policy.price_tolerance))
    qty = both(lambda i, p: (p["q"] > 0) & (F.abs(i["q"] - p["q"]) / p["q"] > policy.quantity_tolerance))
    return price, qty


def check_amount(policy: CheckPolicy = CHECKS) -> Column:
    """V2.  Needs price_fail and qty_flag."""
    total = F.col("total_cents")
    header = true((F.col("po_total") > 0) & (F.abs(total - F.col("po_total")) / F.col("po_total") > policy.price_tolerance * 2))
    flagged = true(F.col("qty_flag")) | header | true(total > F.col("po_remaining"))
    fail = true(F.col("price_fail"))
    return check("amount_variance",
                 F.when(~F.col("has_po"), "NOT_APPLICABLE").when(fail, "FAIL").when(flagged, "FLAG").otherwise("PASS"),
                 F.when(~F.col("has_po"), "NO_PO_CONTEXT").when(fail, "PRICE_VARIANCE_EXCEEDED").when(flagged, "AMOUNT_VARIANCE_DETECTED"),
                 F.when(F.col("has_po") & fail, "HIGH").when(F.col("has_po") & flagged, "MEDIUM").otherwise("LOW"))


def check_tax(policy: CheckPolicy = CHECKS) -> Column:
    """V3."""
    tax, sub = F.col("tax_cents"), F.col("subtotal_cents")
    expected = sub * F.col("tax_rate")
    variance = F.when(expected > 0, F.abs(tax - expected) / expected).otherwise(F.lit(0.0))
    status = (F.when(tax.isNull() & sub.isNull(), "NOT_APPLICABLE").when(tax == 0, "PASS")
              .when(tax.isNotNull() & (sub > 0), F.when(variance > policy.tax_tolerance, "FAIL").otherwise("PASS"))
              .when(tax.isNotNull(), "FLAG").otherwise("NOT_APPLICABLE"))
    reason = F.when(tax.isNull() & sub.isNull(), "NO_TAX_DATA").when(status == "FAIL", "TAX_VARIANCE").when(status == "FLAG", "TAX_BASE_MISSING")
    return check("tax_validation", status, reason, F.when(status == "FAIL", "HIGH").when(status == "FLAG", "MEDIUM").otherwise("LOW"))


def check_vendor() -> Column:
    """V7.  Needs bank_change ('unverified', 'verified' or NULL)."""
    s = F.coalesce("vendor_state", F.lit(""))
    fail = s.isin("inactive", "suspended") | true(F.col("bank_change") == "unverified")
    invoice_vendor = F.coalesce("resolved_vendor_id", "match_vendor_id")
    mismatch = F.col("has_po") & true(invoice_vendor != F.coalesce("po_vendor_id", F.lit("")))
    flagged = (s != "active") | mismatch
    non_po = F.coalesce(F.col("match_status") == "non_po_workflow", F.lit(False))
    none = ~F.col("has_vendor")
    return check("vendor_validation",
                 F.when(none & non_po, "FLAG").when(none, "UNAVAILABLE").when(fail, "FAIL").when(flagged, "FLAG").otherwise("PASS"),
                 F.when(none & non_po, "VENDOR_NOT_VERIFIED").when(none, "NO_VENDOR_DATA").when(fail, "VENDOR_INELIGIBLE").when(flagged, "VENDOR_REVIEW_REQUIRED"),
                 F.when(none & non_po, "MEDIUM").when(none, "LOW").when(fail, "HIGH").when(flagged, "MEDIUM").otherwise("LOW"))


def check_receipt(policy: CheckPolicy = CHECKS) -> Column:
    """V8."""
    total, got = F.col("total_cents"), F.col("received_cents")
    comparable = true(total.isNotNull() & (got > 0))
    coverage = F.when(total > 0, got / total).otherwise(F.lit(0.0))
    status = (F.when(~F.col("has_po"), "NOT_APPLICABLE").when(F.col("po_type").isin(*policy.two_way_types), "PASS")
              .when(~F.col("has_grn"), "UNAVAILABLE").when(~comparable, "PASS").when(coverage >= 0.95, "PASS").otherwise("FLAG"))
    low = coverage < 0.5
    reason = (F.when(status == "NOT_APPLICABLE", "NO_PO_CONTEXT").when(status == "UNAVAILABLE", "GRN_MISSING")
              .when((status == "FLAG") & low, "LOW_RECEIPT_COVERAGE").when(status == "FLAG", "PARTIAL_RECEIPT"))
    return check("receipt_match", status, reason, F.when((status == "UNAVAILABLE") | ((status == "FLAG") & low), "HIGH").when(status == "FLAG", "MEDIUM").otherwise("LOW"))


def check_budget(policy: CheckPolicy = CHECKS) -> Column:
    """V9."""
    total, rest = F.col("total_cents"), F.col("po_remaining")
    limit = rest + F.col("po_total") * policy.budget_tolerance
    status = (F.when(~F.col("has_po"), "NOT_APPLICABLE").when(total.isNull(), "UNAVAILABLE").when(total <= rest, "PASS")
              .when(total <= limit, "FLAG").otherwise("FAIL"))
    reason = (F.when(status == "NOT_APPLICABLE", "NO_PO_CONTEXT").when(status == "UNAVAILABLE", "NO_INVOICE_TOTAL")
              .when(status == "FLAG", "BUDGET_TOLERANCE_USED").when(status == "FAIL", "BUDGET_EXCEEDED"))
    return check("budget_tolerance", status, reason, F.when(status == "FAIL", "HIGH").when(status == "FLAG", "MEDIUM").otherwise("LOW"))


def po_utilization(total="total_cents", prior="po_prior", po_total="po_total") -> Column:
    """Q10.  Share of the order used once this invoice is counted."""
    return F.when(F.col(po_total) > 0, (F.col(prior) + F.col(total)) / F.col(po_total)).otherwise(F.lit(0.0))


def extraction_reasons() -> Column:
    """V15 reason codes.  Number and date are optional once an order is matched."""
    resolved = F.coalesce(F.col("match_status").isin(*PO_RESOLVED_STATES), F.lit(False))

    def codes(value, status, code, optional):
        gone = F.col(value).isNull() | (F.col(status) == "not_found")
        need = ~resolved if optional else F.lit(True)
        return [(code, need & gone), (f"{code}_uncertain", need & ~gone & (F.col(status) == "uncertain"))]

    return flags(*codes("invoice_number", "number_status", "missing_invoice_number", True),
                 *codes("invoice_date", "date_status", "missing_invoice_date", True),
                 *codes("currency", "currency_status", "missing_currency", False),
                 ("reconciliation_residual", F.coalesce(F.col("reconciliation") == "residual_review", F.lit(False))))


def check_extraction_fields() -> Column:
    """V15."""
    r = extraction_reasons()
    n = F.size(r)
    return check("extraction_completeness", F.when(n == 0, "PASS").otherwise("FLAG"),
                 F.when(n == 0, "EXTRACTION_OK").when(n >= 2, "EXTRACTION_FIELDS_INCOMPLETE").otherwise(F.upper(F.get(r, F.lit(0)))), "LOW")


# --- V5, V6 duplicates ----------------------------------------------------------------------------
def prior_is_blocking(priors: DataFrame, allocations: DataFrame, policy: CheckPolicy = CHECKS) -> DataFrame:
    """V6.  Adds `blocking`."""
    paid = allocations.select("document_id").distinct().withColumn("_paid", F.lit(True))
    x = priors.join(paid, "document_id", "left")
    d, s = F.trim(F.coalesce("decision", F.lit(""))), F.trim(F.coalesce("stage3_status", F.lit("")))
    paid_blocks = true(F.col("_paid")) if policy.block_if_allocated else F.lit(False)
    return x.withColumn("blocking", F.when(d.isin(*policy.ignored_decisions) | s.isin(*policy.ignored_stage3), False)
                        .when(d.isin(*policy.blocking_decisions), True).otherwise(paid_blocks)).drop("_paid")


def duplicate_counts(inv: DataFrame, priors: DataFrame, policy: CheckPolicy = CHECKS) -> DataFrame:
    """V5 counts per invoice: exact, same number with another amount, same amount within a few days.

    Priors are counted per key before the join, so an invoice meets one row per key however often a vendor
    repeats a number or an amount.  Whole history, no newest-N limit.
    """
    p = priors.filter("blocking").select(
        "company_id", "document_id", duplicate_vendor_key("vendor_name").alias("v"), F.upper(F.trim("invoice_number")).alias("n"),
        F.col("total_cents").alias("a"), F.col("invoice_date").alias("d")).filter("v <> ''")
    x = inv.select("company_id", "document_id", duplicate_vendor_key("vendor_name").alias("v"), F.upper(F.trim("invoice_number")).alias("n"),
                   F.col("total_cents").alias("a"), F.col("invoice_date").alias("d")).filter("v <> ''")
    # a re-run document is not its own prior
    own = p.select("company_id", "document_id", *[F.col(c).alias(f"o{c}") for c in "vnad"])
    x = x.join(own.dropDuplicates(["company_id", "document_id"]), ["company_id", "document_id"], "left")
    is_own = lambda *cs: F.when(reduce(lambda l, r: l & r, [true(F.col(c) == F.col(f"o{c}")) for c in cs]), 1).otherwise(0)
    per_number = p.groupBy("company_id", "v", "n").agg(F.count(F.lit(1)).alias("c_num"))
    per_exact = p.groupBy("company_id", "v", "n", "a").agg(F.count(F.lit(1)).alias("c_exact"))
    y = x.join(per_number, ["company_id", "v", "n"], "left").join(per_exact, ["company_id", "v", "n", "a"], "left")
    n_num = F.coalesce("c_num", F.lit(0)) - is_own("v", "n")
    n_exact = F.coalesce("c_exact", F.lit(0)) - is_own("v", "n", "a")
    days = policy.near_duplicate_days
    per_day = p.filter("a is not null and d is not null").groupBy("company_id", "v", "a", "d", F.coalesce("n", F.lit("")).alias("pn")).agg(F.count(F.lit(1)).alias("c"))
    # the few priors are spread over the days they are near to, so that the many invoices need not be
    around = per_day.withColumn("d", F.explode(F.sequence(F.date_sub("d", days), F.date_add("d", days))))
    all_day = around.groupBy("company_id", "v", "a", "d").agg(F.sum("c").alias("c_day"))
    same_n = around.groupBy("company_id", "v", "a", "d", F.col("pn").alias("n")).agg(F.sum("c").alias("c_same"))
    y = y.join(all_day, ["company_id", "v", "a", "d"], "left").join(same_n, ["company_id", "v", "a", "d", "n"], "left")
    own_near = F.when(true(F.col("v") == F.col("ov")) & true(F.col("a") == F.col("oa")) & true(F.abs(F.datediff("d", "od")) <= days)
                      & ~true(F.col("n") == F.col("on")), 1).otherwise(0)
    n_near = F.coalesce(F.col("c_day") - F.coalesce("c_same", F.lit(0)) - own_near, F.lit(0)).alias("n_near")
    return y.select("company_id", "document_id", n_exact.alias("n_exact"), (n_num - n_exact).alias("n_number"), n_near)


def check_duplicates() -> Column:
    """V5.  Needs n_exact, n_number, n_near (NULL when nothing was counted)."""
    blank = (F.coalesce("invoice_number", F.lit("")) == "") & (F.coalesce("vendor_name", F.lit("")) == "")
    exact = true(F.col("n_exact") > 0)
    near = true((F.col("n_number") > 0) | (F.col("n_near") > 0))
    return check("duplicate_detection", F.when(blank, "NOT_APPLICABLE").when(exact, "FAIL").when(near, "FLAG").otherwise("PASS"),
                 F.when(blank, "INSUFFICIENT_DATA").when(exact, "DUPLICATE_CONFIRMED").when(near, "DUPLICATE_SUSPECTED"),
                 F.when(blank, "LOW").when(exact, "CRITICAL").when(near, "HIGH").otherwise("LOW"))


# --- V10-V14 fraud --------------------------------------------------------------------------------
def round_number(total="total_cents") -> Column:
    """V10."""
    c = F.col(total)
    return true(((c >= 100_000) & (c % 100_000 == 0)) | ((c >= 500_000) & (c % 50_000 == 0)))


def shaved_threshold(total="total_cents", policy: CheckPolicy = CHECKS) -> Column:
    """V11.  The first approval threshold the total stays just below, else NULL."""
    c = F.col(total)
    return F.coalesce(*[F.when((t - c > 0) & (t - c <= t * policy.shaving_band), F.lit(t).cast("bigint")) for t in policy.approval_thresholds_cents])


def short_number(number="invoice_number") -> Column:
    """V12."""
    c = F.col(number)
    return true((F.coalesce(c, F.lit("")) != "") & (F.length(F.trim(c)) < 3))


def new_vendor_high(total="total_cents", is_new="is_new_vendor", policy: CheckPolicy = CHECKS) -> Column:
    """V13."""
    return true((F.col(total) > policy.new_vendor_amount_cents) & F.col(is_new))


def unpaid_vendors(ctx: DataFrame, paid: DataFrame) -> DataFrame:
    """Adds `is_new_vendor`: the matched vendor has no earlier payment.  `paid` holds (company_id, vendor_id)."""
    p = paid.select("company_id", F.col("vendor_id").alias("match_vendor_id")).distinct().withColumn("_paid", F.lit(True))
    return ctx.join(p, ["company_id", "match_vendor_id"], "left").withColumn(
        "is_new_vendor", F.col("match_vendor_id").isNotNull() & F.col("_paid").isNull()).drop("_paid")


def fraud_signals(policy: CheckPolicy = CHECKS) -> Column:
    """ARRAY<STRUCT<signal, severity>> in a fixed order."""
    row = lambda name, sev: F.struct(F.lit(name).alias("signal"), F.lit(sev).alias("severity"))
    return F.array_compact(F.array(
        F.when(round_number(), row("ROUND_NUMBER", "LOW")), F.when(shaved_threshold(policy=policy).isNotNull(), row("THRESHOLD_SHAVING", "MEDIUM")),
        F.when(short_number(), row("SEQUENCE_ANOMALY", "LOW")), F.when(new_vendor_high(policy=policy), row("NEW_VENDOR_HIGH_AMOUNT", "MEDIUM"))))


def check_fraud() -> Column:
    """V14.  Needs `signals`."""
    has = lambda *s: F.exists("signals", lambda x: x["severity"].isin(*s))
    high, medium = has("HIGH", "CRITICAL"), has("MEDIUM")
    return check("fraud_signals", F.when(high | medium, "FLAG").otherwise("PASS"),
                 F.when(high, "FRAUD_SIGNALS_HIGH").when(medium, "FRAUD_SIGNALS_MEDIUM").when(F.size("signals") > 0, "FRAUD_SIGNALS_LOW"),
                 F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW"))


# --- V16, V17 -------------------------------------------------------------------------------------
def run_checks(ctx: DataFrame, policy: CheckPolicy = CHECKS) -> DataFrame:
    """All checks of the invoice's validation mode as `checks` ARRAY<STRUCT>, in the fixed check order."""
    x = ctx.withColumn("signals", fraud_signals(policy))
    made = {"amount_variance": check_amount(policy), "tax_validation": check_tax(policy), "duplicate_detection": check_duplicates(),
            "vendor_validation": check_vendor(), "receipt_match": check_receipt(policy), "budget_tolerance": check_budget(policy),
            "fraud_signals": check_fraud(), "extraction_completeness": check_extraction_fields()}
    everything = F.array(*[made[c] for c in CHECK_ORDER])
    mode = F.col("mode")
    wanted = F.filter(everything, lambda c: (mode == "full") | (c["check_id"] == "extraction_completeness") | c["check_id"].isin(*LIMITED_CHECKS))
    none = F.array().cast("array<struct<check_id:string,status:string,reason_code:string,severity:string>>")
    return x.withColumns({"checks": F.when(mode.isin("full", "limited"), wanted).otherwise(none), "extraction_reasons": extraction_reasons()})


def aggregate_controls(x: DataFrame) -> DataFrame:
    """V16.  Precedence, never a vote: BLOCKED, HOLD, VALIDATION_INCOMPLETE, REVIEW_REQUIRED, VALIDATED."""
    of = lambda cond: F.filter("checks", cond)
    block = of(lambda c: c["reason_code"].isin(*BLOCK_REASONS))
    hold = of(lambda c: (c["status"] == "FAIL") & ~c["reason_code"].isin(*BLOCK_REASONS))
    gone = of(lambda c: (c["status"] == "UNAVAILABLE") & ~c["reason_code"].isin(*BLOCK_REASONS))
    flag = of(lambda c: (c["status"] == "FLAG") & ~c["reason_code"].isin(*BLOCK_REASONS))
    codes = lambda a: F.transform(a, lambda c: c["reason_code"])
    loud = F.concat(F.filter("signals", lambda s: s["severity"].isin("HIGH", "CRITICAL")), F.filter("signals", lambda s: s["severity"] == "MEDIUM"))
    vague = F.coalesce(F.col("match_status") == "ambiguous_match", F.lit(False))
    vague_code = F.when(vague, F.array(F.lit("AMBIGUOUS_PO_MATCH"))).otherwise(F.array().cast("array<string>"))
    review = (F.size(flag) > 0) | (F.size(loud) > 0) | vague
    state = (F.when(F.size(block) > 0, "BLOCKED").when(F.size(hold) > 0, "HOLD").when(F.size(gone) > 0, "VALIDATION_INCOMPLETE")
             .when(review, "REVIEW_REQUIRED").otherwise("VALIDATED"))
    reasons = (F.when(F.size(block) > 0, codes(block)).when(F.size(hold) > 0, codes(hold)).when(F.size(gone) > 0, codes(gone))
               .otherwise(F.concat(codes(flag), F.transform(loud, lambda s: s["signal"]), vague_code)))
    control = lambda a, kind: F.transform(a, lambda c: F.struct(F.lit(kind).alias("control_type"), c["reason_code"].alias("reason_code"), c["check_id"].alias("check_id")))
    none = F.array().cast("array<struct<control_type:string,reason_code:string,check_id:string>>")
    return x.withColumns({
        "overall_state": state, "control_reasons": reasons,
        "controls": F.when(F.size(block) > 0, control(block, "BLOCK")).when(F.size(hold) > 0, control(hold, "HOLD")).otherwise(none)})


def validation_report(ctx: DataFrame, completed_at, policy: CheckPolicy = CHECKS) -> DataFrame:
    """V17.  One report per invoice.  Where validation cannot run, the report says so."""
    x = aggregate_controls(run_checks(ctx, policy))
    mode = F.col("mode")
    ran = mode.isin("full", "limited")
    state = F.when(ran, F.col("overall_state")).otherwise("VALIDATION_INCOMPLETE")
    reasons = (F.when(ran, F.array_distinct(F.concat("control_reasons", "extraction_reasons")))
               .when(mode == "none", F.array(F.lit("CONTRACT_GATE_NO_VALIDATION"))).otherwise(F.array(F.lit("CONTRACT_FAILURE"))))
    x = x.withColumns({"overall_state": state, "reason_codes": reasons,
                       "processing_state": F.when(mode == "invalid", "FAILED").otherwise("COMPLETED"),
                       "controls": F.when(ran, F.col("controls")).otherwise(F.slice("controls", 1, 0)),
                       "completed_at": completed_at})
    s = F.col("overall_state")
    action = (F.when(mode == "none", "MANUAL_REVIEW").when(mode == "invalid", "INVESTIGATE").when(s.isin("VALIDATED", "REVIEW_REQUIRED"), "STAGE4_DECISION")
              .when(s.isin("HOLD", "BLOCKED"), "EXCEPTION_RESOLUTION").otherwise("WAIT_OR_REVALIDATE"))
    return x.withColumns({"next_action": action, "revalidation_eligible": F.when(ran, s.isin("HOLD", "VALIDATION_INCOMPLETE")).otherwise(mode == "none"),
                          "validation_run_id": F.concat(F.lit("VR-"), F.substring(F.sha2(F.concat_ws("|", "company_id", "document_id", F.col("completed_at").cast("string")), 256), 1, 12))})
