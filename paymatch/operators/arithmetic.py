"""Arithmetic, reconciliation, evidence and routing of extracted invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.functions.expr import flags, true
from paymatch.functions.locale import categorize_charge
from paymatch.policy import EXTRACTION, ExtractionPolicy


def _verdict(skipped: Column, ok: Column) -> Column:
    return F.when(skipped, "skipped").when(ok, "pass").otherwise("fail")


def line_facts(lines: DataFrame, tolerance: int = EXTRACTION.arithmetic_tolerance_cents) -> DataFrame:
    """C2 per line, folded to one row per document: counts and the sum of amounts."""
    s = check_line_amount(tolerance)
    return lines.withColumn("_s", s).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count("amount").alias("n_amounts"), F.sum("amount").alias("line_sum"),
        F.count_if(F.col("_s") == "pass").alias("lines_pass"), F.count_if(F.col("_s") == "fail").alias("lines_fail"),
        F.count_if(F.col("_s") == "skipped").alias("lines_skipped"))


def check_line_amount(tolerance: int = EXTRACTION.arithmetic_tolerance_cents) -> Column:
    """C2."""
    q, p, a = F.col("quantity"), F.col("unit_price"), F.col("amount")
    return _verdict(q.isNull() | p.isNull() | a.isNull(), F.abs(q * p - a) <= tolerance)


def arithmetic_checks(inv: DataFrame, lines: DataFrame, tolerance: int = EXTRACTION.arithmetic_tolerance_cents) -> DataFrame:
    """C1, C3, C4 and C5, one row per invoice."""
    x = inv.join(line_facts(lines, tolerance), "document_id", "left")
    sub, tax, total = F.col("subtotal_cents"), F.col("tax_cents"), F.col("total_cents")
    n = F.coalesce("n_lines", F.lit(0))
    x = x.withColumns({
        "c_total": _verdict(sub.isNull() | tax.isNull() | total.isNull(), F.abs(sub + tax - total) <= tolerance),
        "c_lines_sum": _verdict((n == 0) | sub.isNull() | (F.coalesce("n_amounts", F.lit(0)) == 0), F.abs(F.col("line_sum") - sub) <= tolerance),
        "c_positive": _verdict(total.isNull(), total > 0),
        "c_tax": _verdict(tax.isNull() | total.isNull(), tax <= total)})
    one = F.array("c_total", "c_lines_sum", "c_positive", "c_tax")
    has = lambda s, col: F.array_contains(one, s) | (F.coalesce(col, F.lit(0)) > 0)
    overall = (F.when(has("fail", F.col("lines_fail")), "fail").when(has("skipped", F.col("lines_skipped")), "partial").otherwise("pass"))
    return x.withColumn("arithmetic", overall)


def charge_totals(charges: DataFrame) -> DataFrame:
    """Charges and discounts per invoice; a negative charge is a discount."""
    c = charges.filter("amount is not null").withColumn("_d", (categorize_charge("label") == "discount") | (F.col("amount") < 0))
    return c.groupBy("document_id").agg(
        F.sum(F.when(~F.col("_d"), F.col("amount")).otherwise(0)).alias("charge_sum"),
        F.sum(F.when(F.col("_d"), F.abs("amount")).otherwise(0)).alias("discount_sum"), F.count(F.lit(1)).alias("n_charges"))


def reconcile(inv: DataFrame, lines: DataFrame, charges: DataFrame, policy: ExtractionPolicy = EXTRACTION) -> DataFrame:
    """C6.  Adds reconciliation status, residual and the list of `check:status`."""
    tol = policy.arithmetic_tolerance_cents
    x = inv.join(line_facts(lines, tol), "document_id", "left").join(charge_totals(charges), "document_id", "left")
    zero = F.lit(0).cast("bigint")
    x = x.withColumns({c: F.coalesce(c, zero) for c in ("charge_sum", "discount_sum", "n_charges", "line_sum", "n_lines",
                                                        "lines_pass", "lines_fail")})
    sub, tax, total = F.col("subtotal_cents"), F.col("tax_cents"), F.col("total_cents")
    missing = sub.isNull() | tax.isNull() | total.isNull()
    x = x.withColumn("residual", total - (sub + tax + F.col("charge_sum") - F.col("discount_sum")))
    exact = F.abs("residual") <= tol
    explained = (F.col("charge_sum") == 0) & (F.col("discount_sum") <= tol)
    status = (F.when(missing, "partial")
              .when(exact & (F.col("n_charges") > 0), "reconciled_with_inferred_charges").when(exact, "reconciled")
              .when(explained & (F.abs("residual") >= policy.residual_review_cents), "residual_review")
              .when(explained, "reconciled_with_inferred_charges").otherwise("failed"))
    failed = ~missing & ~exact & ~explained
    checks = F.concat(
        flags((F.concat(F.lit("line_items_sum_equals_subtotal:"), F.when(F.abs(F.col("line_sum") - sub) <= tol, "pass").otherwise("fail")),
               (F.col("line_sum") > 0) & sub.isNotNull()),
              ("primary_total_reconciliation:skipped", missing), ("primary_total_reconciliation:pass", ~missing & exact),
              ("residual_inferred_charge:review", ~missing & ~exact & explained), ("primary_total_reconciliation:fail", failed),
              (F.concat(F.lit("line_item_amounts:pass="), F.col("lines_pass").cast("string"), F.lit(" fail="), F.col("lines_fail").cast("string")), failed & (F.col("n_lines") > 0)),
              ("positive_total:pass", failed & (total > 0)), ("tax_not_exceeds_total:pass", failed & (tax <= total))))
    n_failed = (F.when(failed, 1 + F.col("lines_fail")).otherwise(0)
                + F.when((F.col("line_sum") > 0) & (F.abs(F.col("line_sum") - sub) > tol), 1).otherwise(0))
    return x.withColumns({
        "reconciliation": status, "recon_checks": checks, "recon_fail_checks": F.coalesce(n_failed, zero).cast("bigint"),
        "residual": F.when(missing | exact, 0).otherwise(F.col("residual"))})


def reconciliation_to_arithmetic(status) -> Column:
    """C7."""
    c = F.col(status) if isinstance(status, str) else status
    return F.when(c == "failed", "fail").when(c.isin("reconciled", "reconciled_with_inferred_charges"), "pass").otherwise("partial")


# signal label -> (value column, status column); lists are judged by their own counts
SIGNALS = (("vendor", "vendor_name", "vendor_status"), ("total", "total_cents", "total_status"),
           ("po_reference", "po_value", "po_status"), ("line_items", None, None), ("typed_references", None, None),
           ("currency", "currency", "currency_status"), ("invoice_number", "invoice_number", "number_status"),
           ("invoice_date", "invoice_date", "date_status"))
_LABEL = {"vendor_name": "vendor", "total_amount": "total"}


def evidence_profile(inv: DataFrame, policy: ExtractionPolicy = EXTRACTION) -> DataFrame:
    """C8-C10.  Needs `n_lines` and `n_refs`.  Label lists keep one fixed order."""
    approval = {_LABEL.get(f, f) for f in policy.approval_fields}
    matchable = {_LABEL.get(f, f) for f in policy.matchable_signals}

    def usable(label, value, status):
        if label == "line_items":
            return F.coalesce("n_lines", F.lit(0)) > 0
        if label == "typed_references":
            return F.coalesce("n_refs", F.lit(0)) > 0
        return F.col(value).isNotNull() & (F.col(status) != "not_found")

    u = {s[0]: true(usable(*s)) for s in SIGNALS}
    un = {label: (true(F.col(status) == "uncertain") & ~u[label]) if status else F.lit(False) for label, _, status in SIGNALS}
    x = inv.withColumns({
        "available": flags(*[(s, u[s]) for s in u]),
        "missing": flags(*[(s, ~u[s]) for s in u if s in approval]),
        "optional_missing": flags(*[(s, ~u[s]) for s in u if s not in approval]),
        "uncertain": flags(*[(s, un[s]) for s in u]),
        "critical_missing": flags(*[(s, ~u[s]) for s in u if s in approval]),
        "matchable": flags(*[(s, u[s]) for s in u if s in matchable])})
    enough = F.size("matchable") > 0 if policy.allow_partial_evidence else F.size("matchable") == len(matchable)
    quality = (F.when(F.size("matchable") == 0, "extraction_weak")
               .when((F.size("critical_missing") > 0) | (F.size("uncertain") > 0), "extraction_partial").otherwise("extraction_complete"))
    return x.withColumns({"can_match": enough, "extraction_quality": quality})


def route_invoice(x: DataFrame, policy: ExtractionPolicy = EXTRACTION) -> DataFrame:
    """C11.  Needs the evidence profile, reconciliation status, `verification_status` and `issues`
    ARRAY<STRUCT<field, severity>>."""
    settled = F.col("reconciliation").isin("reconciled", "reconciled_with_inferred_charges", "partial", "residual_review")
    boosted = settled & (F.col("verification_status") == "pass")

    def field_flag(label, value, conf, status, field):
        c = F.col(conf)
        if field in policy.boosted_fields:
            c = F.when(boosted, F.least(F.lit(1.0), c + policy.confidence_boost)).otherwise(c)
        out = (F.when(F.col(value).isNull() | (F.col(status) == "not_found"), f"{field}:missing")
               .when(F.col(status) == "uncertain", f"{field}:uncertain"))
        if field == "currency":
            out = out.when(F.col(status).isin("inferred", "extracted") & (F.col(conf) >= policy.inferred_currency_confidence)
                           & (F.length(F.trim(F.col(value))) == 3), F.lit(None))
        return out.when(c < policy.threshold(field), f"{field}:below_threshold")

    actionable = F.filter("issues", lambda i: ~i["field"].isin(*policy.quiet_verification_fields)
                          & (i["field"].isin(*policy.blocking_verification_fields) | (i["severity"] == "high")))
    v = F.col("verification_status")
    found = F.array_compact(F.array(
        F.when(v == "unavailable", "verification:unavailable"),
        field_flag("total", "total_cents", "total_conf", "total_status", "total_amount"),
        field_flag("vendor", "vendor_name", "vendor_conf", "vendor_status", "vendor_name"),
        field_flag("currency", "currency", "currency_conf", "currency_status", "currency"),
        F.when((v == "flag") & (F.size(actionable) > 0), "verification:flag").when(v == "uncertain", "verification:uncertain"),
        F.when(F.col("reconciliation") == "residual_review", "reconciliation:residual_review")
         .when(F.col("reconciliation") == "failed", F.concat(F.lit("reconciliation:failed_checks="), F.col("recon_fail_checks").cast("string")))))
    x = x.withColumn("review_flags", found)
    review = (F.col("extraction_quality") == "extraction_weak") | (F.size("review_flags") > 0)
    return x.withColumn("status", F.when(F.col("extraction_quality") == "extraction_failed", "extraction_failed")
                        .when(review, "needs_human_review").otherwise("stage1_passed"))


def avg_field_confidence(*confidences: str) -> Column:
    """C12.  A missing confidence counts as zero."""
    total = F.lit(0.0)
    for c in confidences:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return total / len(confidences)
