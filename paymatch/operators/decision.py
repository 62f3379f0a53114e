"""The payment decision: gates in strict order, policy, authority and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.functions.expr import lookup, true
from paymatch.policy import (APPROVAL_GROUPS, APPROVAL_LIMITS, BLOCK_REASONS, DECISION, DEFAULT_ROUTE, ROUTING,
                             DecisionPolicy)

RULES = "array<struct<rule_id:string,result:string,priority:int>>"


def rule(rule_id, result, priority: int) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(lit(rule_id).alias("rule_id"), lit(result).alias("result"), F.lit(priority).alias("priority"))


def decision_context(report: DataFrame) -> DataFrame:
    """D1.  A zero total counts as missing.  The bank flag needs a control reason that mentions the bank."""
    return report.withColumns({
        "amount": F.nullif(F.col("total_cents"), F.lit(0).cast("bigint")),
        "first_payment": F.exists("signals", lambda s: s["signal"] == "NEW_VENDOR_HIGH_AMOUNT"),
        "bank_change_seen": F.exists("controls", lambda c: F.contains(F.lower(c["reason_code"]), F.lit("bank"))),
        "ctx_vendor_status": F.coalesce("vendor_state", F.lit(""))})


def decision_contract(as_of, policy: DecisionPolicy = DECISION) -> Column:
    """D2.  Reason code when the report may not be decided on, else NULL."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("completed_at")
    return (F.when(blank("document_id"), "MISSING_INVOICE_ID").when(blank("validation_run_id"), "MISSING_VALIDATION_RUN_ID")
            .when(blank("overall_state"), "MISSING_VALIDATION_STATE").when(F.col("processing_state") != "COMPLETED", "STAGE3_NOT_COMPLETED")
            .when(age > policy.freshness_hours * 3600, "STALE_VALIDATION"))


def hard_controls() -> Column:
    """D3.  Reason codes of a terminal rejection, NULL when none applies."""
    blocks = F.filter("controls", lambda c: c["control_type"] == "BLOCK")
    terminal = F.filter("reason_codes", lambda r: r.isin(*BLOCK_REASONS))
    return (F.when(F.col("overall_state") == "BLOCKED", F.col("reason_codes"))
            .when(F.size(blocks) > 0, F.transform(blocks, lambda c: c["reason_code"])).when(F.size(terminal) > 0, terminal))


def mandatory_overrides(policy: DecisionPolicy = DECISION) -> dict[str, Column]:
    """D4.  Conditions in evaluation order."""
    return {
        "UNVERIFIED_BANK_CHANGE": true(F.col("bank_change_seen")),
        "NEW_VENDOR_FIRST_PAYMENT": F.col("first_payment") & true(F.col("amount") > policy.new_vendor_threshold_cents),
        "THRESHOLD_CLUSTERING": F.exists("signals", lambda s: s["signal"] == "THRESHOLD_SHAVING"),
        "HIGH_FRAUD_SIGNAL": F.exists("signals", lambda s: s["severity"].isin("HIGH", "CRITICAL"))}


def override_substate(o: dict[str, Column]) -> Column:
    return (F.when(o["HIGH_FRAUD_SIGNAL"], "FRAUD_REVIEW").when(o["UNVERIFIED_BANK_CHANGE"], "VENDOR_SECURITY_REVIEW")
            .when(o["NEW_VENDOR_FIRST_PAYMENT"], "HIGH_PRIORITY_REVIEW").when(o["THRESHOLD_CLUSTERING"], "FRAUD_REVIEW"))


def map_validation_state() -> Column:
    """D5.  STRUCT<decision, substate>, NULL when the invoice may go on to policy."""
    s = F.col("overall_state")
    has = lambda *codes: F.arrays_overlap("reason_codes", F.array(*[F.lit(c) for c in codes]))
    out = lambda d, sub: F.struct(F.lit(d).alias("decision"), sub.alias("substate"))
    return (F.when(s == "HOLD", out("REVIEW_REQUIRED", F.when(has("PRICE_VARIANCE_EXCEEDED", "BUDGET_EXCEEDED", "TAX_VARIANCE"), "HIGH_PRIORITY_REVIEW").otherwise("STANDARD_REVIEW")))
            .when(s == "REVIEW_REQUIRED", out("REVIEW_REQUIRED", F.lit("STANDARD_REVIEW")))
            .when(s == "VALIDATION_INCOMPLETE", out("WAITING_FOR_VALIDATION", F.when(has("GRN_MISSING"), "WAITING_FOR_GRN").otherwise("WAITING_FOR_REQUIRED_DATA")))
            .when(s != "VALIDATED", out("REVIEW_REQUIRED", F.lit("POLICY_EXCEPTION_REVIEW"))))


def resolve_policy(policy: DecisionPolicy = DECISION) -> dict[str, Column]:
    """D6.  Materiality tier, vendor risk and whether the invoice may be approved automatically."""
    a = F.coalesce("amount", F.lit(0))
    tier = (F.when(a <= policy.auto_limit_cents, "LOW").when(a <= policy.manager_limit_cents, "MEDIUM")
            .when(a <= policy.director_limit_cents, "HIGH").otherwise("CRITICAL"))
    risk = F.when(F.col("ctx_vendor_status").isin("inactive", "suspended"), "HIGH").when(F.col("first_payment"), "ELEVATED").otherwise("STANDARD")
    return {"tier": tier, "risk_tier": risk, "auto_eligible": (tier == "LOW") & (risk == "STANDARD")}


def resolve_authority() -> dict[str, Column]:
    """D7.  Needs tier and auto_eligible."""
    auto = F.col("auto_eligible")
    return {"approval_substate": F.when(auto, "AUTO_APPROVED").otherwise("APPROVAL_REQUIRED"),
            "approver_group": F.when(auto, F.lit(None)).otherwise(lookup(F.col("tier"), APPROVAL_GROUPS, "finance-manager-group")),
            "approval_limit": F.when(auto, F.lit(APPROVAL_LIMITS["LOW"])).otherwise(lookup(F.col("tier"), APPROVAL_LIMITS, 50000.0, "double")),
            "dual_control": ~auto & (F.col("tier") == "CRITICAL")}


def resolve_routing(substate="substate", group="approver_group") -> dict[str, Column]:
    """D8."""
    s = F.col(substate)
    pick = lambda i, t="string": lookup(s, {k: v[i] for k, v in ROUTING.items()}, DEFAULT_ROUTE[i], t)
    target = F.when((s == "APPROVAL_REQUIRED") & F.col(group).isNotNull(), F.col(group)).otherwise(pick(0))
    return {"route_target": target, "route_priority": pick(1), "sla_hours": pick(2, "bigint"), "resume_condition": pick(3)}


def decide(report: DataFrame, as_of, policy: DecisionPolicy = DECISION) -> DataFrame:
    """D9.  The first gate that speaks decides; `rules` lists every rule looked at on the way."""
    x = decision_context(report).withColumns({"contract_reason": decision_contract(as_of, policy), "hard_reasons": hard_controls()})
    o = mandatory_overrides(policy)
    x = x.withColumns({"override_reasons": F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in o.items()])),
                       "override_substate": override_substate(o), "state_map": map_validation_state()})
    x = x.withColumns(resolve_policy(policy)).withColumns(resolve_authority())
    stopped, hard = F.col("contract_reason").isNotNull(), F.col("hard_reasons").isNotNull()
    over, mapped = F.size("override_reasons") > 0, F.col("state_map").isNotNull()
    contract_config = F.col("contract_reason").startswith("MISSING_")
    step = (F.when(stopped, "contract").when(hard, "hard").when(over, "override").when(mapped, "state").otherwise("authority"))
    x = x.withColumn("decided_by", step)
    by = F.col("decided_by")
    decision = (F.when(by == "contract", F.when(contract_config, "REVIEW_REQUIRED").otherwise("WAITING_FOR_VALIDATION")).when(by == "hard", "REJECT")
                .when(by == "override", "REVIEW_REQUIRED").when(by == "state", F.col("state_map.decision")).otherwise("APPROVE"))
    sub = (F.when((by == "contract") & contract_config, "POLICY_CONFIGURATION_ERROR")
           .when((by == "contract") & (F.col("contract_reason") == "STAGE3_NOT_COMPLETED"), "WAITING_FOR_REQUIRED_DATA").when(by == "contract", "REVALIDATION_REQUIRED")
           .when(by == "hard", "TERMINAL_REJECT").when(by == "override", F.col("override_substate")).when(by == "state", F.col("state_map.substate"))
           .otherwise(F.col("approval_substate")))
    none = F.array().cast("array<string>")
    reasons = (F.when(by == "contract", F.array("contract_reason")).when(by == "hard", F.col("hard_reasons")).when(by == "override", F.col("override_reasons"))
               .when(by == "state", F.col("reason_codes")).otherwise(none))
    late = by.isin("state", "authority")
    trig = lambda cond: F.when(cond, "TRIGGERED").otherwise("NOT_TRIGGERED")
    hard_id = (F.when(F.col("overall_state") == "BLOCKED", "HARD_CONTROL_BLOCKED")
               .when(F.exists("controls", lambda c: c["control_type"] == "BLOCK"), "HARD_CONTROL_BLOCK_ACTIVE").otherwise("HARD_CONTROL_TERMINAL_CODE"))
    contract_id = F.when(contract_config, "CONTRACT_SCHEMA").when(F.col("contract_reason") == "STAGE3_NOT_COMPLETED", "CONTRACT_PROCESSING_STATE").otherwise("CONTRACT_FRESHNESS")
    rules = F.array_compact(F.array(
        F.when(by == "contract", rule(contract_id, "TRIGGERED", 0)).otherwise(rule("CONTRACT_GATE", "NOT_TRIGGERED", 0)),
        F.when(by == "hard", rule(hard_id, "TRIGGERED", 1)).when(by != "contract", rule("HARD_CONTROL_GATE", "NOT_TRIGGERED", 1)),
        *[F.when(by.isin("override", "state", "authority"), rule(r, trig(o[k]), p)) for k, r, p in (
            ("UNVERIFIED_BANK_CHANGE", "BANK_CHANGE_OVERRIDE", 2), ("NEW_VENDOR_FIRST_PAYMENT", "NEW_VENDOR_OVERRIDE", 4),
            ("THRESHOLD_CLUSTERING", "CLUSTERING_OVERRIDE", 4), ("HIGH_FRAUD_SIGNAL", "HIGH_FRAUD_OVERRIDE", 3))],
        F.when(late, rule("STAGE3_STATE", trig(mapped), 5)),
        F.when(by == "authority", rule(F.concat(F.lit("MATERIALITY_"), "tier"), trig(~F.col("auto_eligible")), 6)),
        F.when((by == "authority") & F.col("risk_tier").isin("HIGH", "ELEVATED"), rule("VENDOR_RISK", "TRIGGERED", 5)),
        F.when(by == "authority", F.when(F.col("auto_eligible"), rule("AUTHORITY_AUTO_APPROVE", "TRIGGERED", 9))
               .otherwise(rule(F.concat(F.lit("AUTHORITY_"), "tier"), "TRIGGERED", 7)))))
    x = x.withColumns({"decision": decision, "substate": sub, "decision_reasons": reasons, "rules": rules})
    x = x.withColumns({"approver_group": F.when(by == "authority", F.col("approver_group")), "approval_limit": F.when(by == "authority", F.col("approval_limit")),
                       "dual_control": (by == "authority") & F.col("dual_control")})
    # an early stop is recorded without a route; only the later gates assign one
    x = x.withColumns(resolve_routing())
    routed = ~by.isin("contract", "hard")
    x = x.withColumns({"route_target": F.when(routed, F.col("route_target")), "route_priority": F.when(routed, F.col("route_priority")).otherwise("NORMAL"),
                       "sla_hours": F.when(routed, F.col("sla_hours")).otherwise(F.lit(0).cast("bigint")),
                       "resume_condition": F.when(routed, F.col("resume_condition"))})
    x = x.withColumn("decision_id", F.concat(F.lit("DEC-"), F.substring(F.sha2(F.concat_ws("|", "document_id", "validation_run_id"), 256), 1, 12)))
    return x.withColumn("triggered_rules", F.transform(F.filter("rules", lambda r: r["result"] == "TRIGGERED"), lambda r: r["rule_id"]))


def post_allocations(decisions: DataFrame, allocations: DataFrame, pos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D10.  (new allocations, orders with the approved amounts added).  Posting twice changes nothing."""
    wanted = decisions.filter("substate = 'AUTO_APPROVED' and po_number is not null and amount is not null").select(
        "company_id", "document_id", "po_number", "amount").dropDuplicates(["company_id", "document_id", "po_number"])
    new = wanted.join(allocations.select("company_id", "document_id", "po_number"), ["company_id", "document_id", "po_number"], "left_anti")
    used = new.groupBy("company_id", "po_number").agg(F.sum("amount").alias("_used"))
    out = pos.join(used, ["company_id", "po_number"], "left").withColumn(
        "previously_invoiced", F.col("previously_invoiced") + F.coalesce("_used", F.lit(0))).drop("_used")
    return new, out


def post_line_quantities(po_lines: DataFrame, line_allocations: DataFrame) -> DataFrame:
    """D10 for line allocations where they are supplied."""
    used = line_allocations.groupBy("company_id", "po_number", "line_number").agg(F.sum("quantity").alias("_q"))
    return po_lines.join(used, ["company_id", "po_number", "line_number"], "left").withColumn(
        "invoiced_quantity", F.coalesce("invoiced_quantity", F.lit(0)) + F.coalesce("_q", F.lit(0))).drop("_q")


_OPEN_MATCHES = ("ambiguous_match", "multiple_candidates", "no_matching_evidence", "waiting_for_po", "suggested_po_match",
                 "partial_match", "unmatched", "non_po_workflow")


def buyer_verdict(decision="stage4_decision", substate="stage4_status", stage3="stage3_status", stage2="stage2_status",
                  quality="extraction_quality") -> Column:
    """D11."""
    d = F.col(decision)
    return (F.when(d.isin("TERMINAL_REJECT", "REJECT"), "do_not_pay").when((F.col(substate) == "AUTO_APPROVED") | (d == "APPROVE"), "pay")
            .when(d == "APPROVAL_REQUIRED", "pay").when(d == "REVIEW_REQUIRED", "needs_review")
            .when((F.col(stage3) == "HOLD") & (d != "AUTO_APPROVED"), "needs_review").when(F.col(stage2).isin(*_OPEN_MATCHES), "needs_review")
            .when(F.col(quality) == "extraction_weak", "needs_review").otherwise("pending"))


GOOD_NEWS_RULES = ("AUTHORITY_AUTO_APPROVE", "HARD_CONTROL_GATE", "STAGE3_STATE", "CONTRACT_GATE", "CONTRACT_SCHEMA",
                   "CONTRACT_PROCESSING_STATE", "CONTRACT_FRESHNESS")


def attention_rules(rules="rules") -> Column:
    """D12.  Triggered rules a person should look at."""
    return F.transform(F.filter(rules, lambda r: (r["result"] == "TRIGGERED") & ~r["rule_id"].isin(*GOOD_NEWS_RULES)
                                & ~F.startswith(r["rule_id"], F.lit("MATERIALITY_"))), lambda r: r["rule_id"])
