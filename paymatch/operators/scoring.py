"""Explainable scores per (invoice, order) candidate (S1-S7).  Points are integer tenths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.functions.expr import lookup, true
from paymatch.functions.text import vendor_names_equivalent
from paymatch.operators.lines import balance_flags, line_coverage, matched
from paymatch.functions.fields import po_validity_flags
from paymatch.policy import DEFAULT_RETRIEVAL_WEIGHT, MATCH, RETRIEVAL_WEIGHTS, MatchPolicy


def tenths(points: Column) -> Column:
    return F.floor(points * 10.0 + 0.5).cast("bigint")


def score_po(method: Column, confidence: Column, policy: MatchPolicy = MATCH) -> Column:
    """S1."""
    return F.lit(policy.max_po) * lookup(method, RETRIEVAL_WEIGHTS, DEFAULT_RETRIEVAL_WEIGHT, "double") * confidence


def score_vendor(resolved_id: Column, resolved_conf: Column, candidate_id: Column, same_name: Column,
                 policy: MatchPolicy = MATCH) -> Column:
    """S2.  Same id, or an equivalent name when the ids diverge or the vendor is unresolved."""
    resolved = resolved_id.isNotNull()
    conf = F.when(resolved & (resolved_conf > 0), resolved_conf).otherwise(F.lit(0.9))
    same_id = true(resolved & (candidate_id != "") & (resolved_id == candidate_id))
    return F.when(same_id | same_name, F.lit(policy.max_vendor) * conf).otherwise(F.lit(0.0))


def score_lines(maps: Column, policy: MatchPolicy = MATCH) -> Column:
    """S3."""
    hit = matched(maps)
    total = F.aggregate(hit, F.lit(0).cast("bigint"), lambda a, m: a + m["milli"])
    n = F.size(hit)
    average = total / n / F.lit(1000.0)
    share = n / F.size(maps)
    return F.when(n > 0, F.lit(policy.max_line) * (share * 0.6 + average * 0.4)).otherwise(F.lit(0.0))


def score_amount(total: Column, remaining: Column, policy: MatchPolicy = MATCH) -> Column:
    """S4."""
    m = policy.max_amount
    over = (total - remaining) / remaining
    ratio = F.least(total, remaining) / F.greatest(total, remaining)
    within = F.lit(m) if policy.partial_usage_full_score else (
        F.when(ratio >= 0.95, m).when(ratio >= 0.80, m * 0.7).when(ratio >= 0.60, m * 0.4).otherwise(m * 0.1))
    return (F.when(total.isNull() | (remaining <= 0), F.lit(0.0))
            .when(total <= remaining, within)
            .when(over <= policy.over_remaining_tolerance, F.lit(m * 0.5)).otherwise(F.lit(m * 0.1)))


def score_date(invoice_date: Column, issue_date: Column, policy: MatchPolicy = MATCH) -> Column:
    """S5."""
    m = policy.max_date
    days = F.abs(F.datediff(invoice_date, issue_date))
    return (F.when(days.isNull(), F.lit(0.0)).when(days <= 30, F.lit(m)).when(days <= 90, F.lit(m * 0.7))
            .when(days <= 180, F.lit(m * 0.4)).otherwise(F.lit(m * 0.1)))


def score_candidates(pairs: DataFrame, as_of: str, policy: MatchPolicy = MATCH) -> DataFrame:
    """S6.  `pairs`: invoice total and date, resolved vendor, order attributes, retrieval method and `maps`."""
    remaining = F.col("total_amount") - F.col("previously_invoiced")
    same_name = true(vendor_names_equivalent("inv_vendor_name", "vendor_name"))
    resolved = F.col("resolved_vendor_id")
    aligned = F.when(resolved.isNotNull() & same_name, resolved).otherwise(F.coalesce("vendor_id", F.lit("")))
    x = pairs.withColumns({"remaining": remaining, "_same": same_name}).withColumn("cand_vendor_id", aligned)
    x = x.withColumns({
        "s_po": tenths(score_po(F.col("method"), F.col("confidence"), policy)),
        "s_vendor": tenths(score_vendor(resolved, F.col("resolved_conf"), F.col("cand_vendor_id"), F.col("_same"), policy)),
        "s_line": tenths(score_lines(F.col("maps"), policy)),
        "s_amount": tenths(score_amount(F.col("total_cents"), F.col("remaining"), policy)),
        "s_date": tenths(score_date(F.col("invoice_date"), F.col("issue_date"), policy)),
        "coverage": line_coverage(F.col("maps")),
        "over": true(F.col("total_cents") > F.col("remaining")),
        "flags": F.concat(po_validity_flags(as_of), balance_flags(F.col("total_cents"), F.col("remaining"))),
    })
    return x.withColumn("score", F.expr("s_po + s_vendor + s_line + s_amount + s_date")).drop("_same")


def structured_signals(policy: MatchPolicy = MATCH) -> Column:
    """S7.  Typed evidence rows of a scored candidate."""
    def row(signal, status, score, max_score):
        return F.struct(F.lit(signal).alias("signal"), status.alias("status"), (score / 10.0).alias("score"), F.lit(max_score).alias("max_score"))

    cov = F.col("coverage")
    zero = F.lit(0)
    return F.array_compact(F.array(
        F.when(F.col("method") == "source_record_po_hint", row(
            "source_record_po_hint", F.when(F.col("s_po") > 0, "hint").otherwise("not_available"), F.col("s_po"), policy.max_po)),
        row("po_reference", F.when(F.col("s_po") > 0, "match").otherwise("not_available"), F.col("s_po"), policy.max_po),
        row("vendor", F.when(F.col("s_vendor") >= policy.max_vendor * 7.5, "exact_match").otherwise("weak"), F.col("s_vendor"), policy.max_vendor),
        row("amount", F.when(F.col("s_amount") >= policy.max_amount * 8, "exact_remaining_balance").otherwise("weak"), F.col("s_amount"), policy.max_amount),
        row("line_match", F.when(cov >= 0.85, "match").when(cov > 0, "partial").otherwise("not_available"), F.col("s_line"), policy.max_line),
        row("balance", F.when(F.col("over"), "over_invoice").otherwise("within_balance"), zero, 0.0)))
