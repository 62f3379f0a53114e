"""Decision, allocations and buyer-facing derivations (D1-D12, three-way report, sequential mode)."""

from pyspark.sql import functions as F

from paymatch.operators import checks as ck
from paymatch.operators import decision as dec
from paymatch.operators import sequential as seq
from paymatch.plans.oracle_base import CTES
from paymatch.plans.queries_checks import report
from paymatch.plans.registry import query
from paymatch.policy import ROUTING, DecisionPolicy

AS_OF = "2024-03-02 02:00:00"

CTES["q_dctx"] = f"""
  SELECT *, CASE WHEN total_cents = 0 THEN NULL ELSE total_cents END AS amount, control_type = 'BLOCK' AS hard, g_new AS first_payment,
    epoch(TIMESTAMP '{AS_OF}') - epoch(arrival_ts) > 24 * 3600 AS stale, coalesce(vendor_state, '') AS vstate FROM q_report"""
CTES["q_dec0"] = """
  SELECT *, CASE WHEN coalesce(amount, 0) <= 500000 THEN 'LOW' WHEN amount <= 5000000 THEN 'MEDIUM' WHEN amount <= 50000000 THEN 'HIGH' ELSE 'CRITICAL' END AS tier,
    CASE WHEN vstate IN ('inactive', 'suspended') THEN 'HIGH' WHEN first_payment THEN 'ELEVATED' ELSE 'STANDARD' END AS risk,
    CASE WHEN first_payment AND coalesce(amount > 1000000, false) THEN 'HIGH_PRIORITY_REVIEW' WHEN g_shaved > 0 THEN 'FRAUD_REVIEW' END AS override,
    CASE overall_state WHEN 'HOLD' THEN CASE WHEN list_has_any(reasons, ['PRICE_VARIANCE_EXCEEDED', 'BUDGET_EXCEEDED', 'TAX_VARIANCE']) THEN 'HIGH_PRIORITY_REVIEW' ELSE 'STANDARD_REVIEW' END
      WHEN 'REVIEW_REQUIRED' THEN 'STANDARD_REVIEW' WHEN 'VALIDATION_INCOMPLETE' THEN CASE WHEN list_contains(reasons, 'GRN_MISSING') THEN 'WAITING_FOR_GRN' ELSE 'WAITING_FOR_REQUIRED_DATA' END
      WHEN 'BLOCKED' THEN 'POLICY_EXCEPTION_REVIEW' END AS mapped
  FROM q_dctx"""
_ROUTE = lambda i, default: "CASE substate " + " ".join(f"WHEN '{k}' THEN " + ("NULL" if v[i] is None else f"'{v[i]}'" if isinstance(v[i], str) else str(v[i])) for k, v in ROUTING.items()) + f" ELSE {default} END"
CTES["q_decision"] = f"""
  SELECT *, CASE WHEN step IN ('contract', 'hard') THEN NULL WHEN substate = 'APPROVAL_REQUIRED' THEN grp ELSE {_ROUTE(0, "'ap-exception-queue'")} END AS target,
    CASE WHEN step IN ('contract', 'hard') THEN 'NORMAL' ELSE {_ROUTE(1, "'NORMAL'")} END AS prio, CASE WHEN step IN ('contract', 'hard') THEN 0 ELSE {_ROUTE(2, "48")} END AS sla
  FROM (SELECT *, CASE step WHEN 'contract' THEN 'WAITING_FOR_VALIDATION' WHEN 'hard' THEN 'REJECT' WHEN 'override' THEN 'REVIEW_REQUIRED'
      WHEN 'state' THEN CASE WHEN overall_state = 'VALIDATION_INCOMPLETE' THEN 'WAITING_FOR_VALIDATION' ELSE 'REVIEW_REQUIRED' END ELSE 'APPROVE' END AS decision,
    CASE step WHEN 'contract' THEN CASE WHEN mode = 'invalid' THEN 'WAITING_FOR_REQUIRED_DATA' ELSE 'REVALIDATION_REQUIRED' END WHEN 'hard' THEN 'TERMINAL_REJECT' WHEN 'override' THEN override WHEN 'state' THEN mapped
      ELSE CASE WHEN auto THEN 'AUTO_APPROVED' ELSE 'APPROVAL_REQUIRED' END END AS substate,
    CASE tier WHEN 'LOW' THEN 'finance-manager-group' WHEN 'MEDIUM' THEN 'finance-manager-group' WHEN 'HIGH' THEN 'finance-director-group' ELSE 'cfo-group' END AS grp
   FROM (SELECT *, tier = 'LOW' AND risk = 'STANDARD' AS auto,
      CASE WHEN stale OR mode = 'invalid' THEN 'contract' WHEN hard THEN 'hard' WHEN override IS NOT NULL THEN 'override' WHEN mapped IS NOT NULL THEN 'state' ELSE 'authority' END AS step FROM q_dec0))"""


def decisions(fx):
    return fx.memo("decisions", lambda: dec.decide(report(fx), AS_OF + "Z"))


@query("d1_decision_context", "SELECT document_id, coalesce(amount, -1) AS amount, first_payment, vstate AS vendor_status FROM q_dctx")
def d1(fx):
    # the first-payment mark is read from the fraud signals, which exist in every mode
    return dec.decision_context(report(fx)).select("document_id", F.coalesce("amount", F.lit(-1)).alias("amount"), "first_payment", F.col("ctx_vendor_status").alias("vendor_status"))


@query("d2_decision_contract", "SELECT document_id, CASE WHEN mode = 'invalid' THEN 'STAGE3_NOT_COMPLETED' WHEN stale THEN 'STALE_VALIDATION' ELSE '' END AS reason FROM q_dctx")
def d2(fx):
    return report(fx).select("document_id", F.coalesce(dec.decision_contract(AS_OF + "Z"), F.lit("")).alias("reason"))


@query("d3_hard_controls", "SELECT document_id, CASE WHEN hard THEN array_to_string(reasons, ',') ELSE '' END AS reasons FROM q_dctx")
def d3(fx):
    return report(fx).select("document_id", F.coalesce(F.array_join(dec.hard_controls(), ","), F.lit("")).alias("reasons"))


@query("d4_mandatory_overrides", """SELECT document_id, coalesce(override, '') AS substate, concat_ws(',', CASE WHEN first_payment AND amount > 1000000 THEN 'NEW_VENDOR_FIRST_PAYMENT' END,
  CASE WHEN g_shaved > 0 THEN 'THRESHOLD_CLUSTERING' END) AS reasons FROM q_dec0""")
def d4(fx):
    x = dec.decision_context(report(fx))
    o = dec.mandatory_overrides()
    return x.select("document_id", F.coalesce(dec.override_substate(o), F.lit("")).alias("substate"),
                    F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in o.items()])), ",").alias("reasons"))


@query("d5_map_validation_state", "SELECT document_id, coalesce(mapped, '') AS substate FROM q_dec0")
def d5(fx):
    return report(fx).select("document_id", F.coalesce(dec.map_validation_state()["substate"], F.lit("")).alias("substate"))


@query("d6_resolve_policy", "SELECT document_id, tier, risk AS risk_tier, tier = 'LOW' AND risk = 'STANDARD' AS auto_eligible FROM q_dec0")
def d6(fx):
    return dec.decision_context(report(fx)).withColumns(dec.resolve_policy()).select("document_id", "tier", "risk_tier", "auto_eligible")


@query("d7_resolve_authority", """SELECT document_id, CASE WHEN auto THEN 'AUTO_APPROVED' ELSE 'APPROVAL_REQUIRED' END AS approval_substate, CASE WHEN auto THEN '' ELSE grp END AS approver_group,
  NOT auto AND tier = 'CRITICAL' AS dual_control FROM q_decision""")
def d7(fx):
    x = dec.decision_context(report(fx)).withColumns(dec.resolve_policy()).withColumns(dec.resolve_authority())
    return x.select("document_id", "approval_substate", F.coalesce("approver_group", F.lit("")).alias("approver_group"), "dual_control")


@query("d8_resolve_routing", f"SELECT document_id, coalesce({_ROUTE(0, chr(39) + 'ap-exception-queue' + chr(39))}, '') AS target, {_ROUTE(1, chr(39) + 'NORMAL' + chr(39))} AS priority, {_ROUTE(2, '48')} AS sla_hours, coalesce({_ROUTE(3, 'NULL')}, '') AS resume_condition FROM (SELECT document_id, stage4_status AS substate FROM v_runs)")
def d8(fx):
    x = fx.runs.select("document_id", F.col("stage4_status").alias("substate"), F.lit(None).cast("string").alias("approver_group"))
    r = dec.resolve_routing()
    return x.select("document_id", F.coalesce(r["route_target"], F.lit("")).alias("target"), r["route_priority"].alias("priority"), r["sla_hours"].alias("sla_hours"),
                    F.coalesce(r["resume_condition"], F.lit("")).alias("resume_condition"))


@query("d9_decide", "SELECT document_id, decision, substate, step AS decided_by, coalesce(target, '') AS route_target, prio AS route_priority, sla AS sla_hours FROM q_decision")
def d9(fx):
    return decisions(fx).select("document_id", "decision", "substate", "decided_by", F.coalesce("route_target", F.lit("")).alias("route_target"), "route_priority", "sla_hours")


CTES["q_rules"] = """
  SELECT document_id, step, tier, auto, risk, concat_ws(',', CASE WHEN step = 'contract' THEN CASE WHEN mode = 'invalid' THEN 'CONTRACT_PROCESSING_STATE!' ELSE 'CONTRACT_FRESHNESS!' END ELSE 'CONTRACT_GATE' END,
    CASE WHEN step = 'hard' THEN 'HARD_CONTROL_BLOCKED!' WHEN step <> 'contract' THEN 'HARD_CONTROL_GATE' END,
    CASE WHEN step IN ('override', 'state', 'authority') THEN 'BANK_CHANGE_OVERRIDE,NEW_VENDOR_OVERRIDE' || CASE WHEN first_payment AND amount > 1000000 THEN '!' ELSE '' END
      || ',CLUSTERING_OVERRIDE' || CASE WHEN g_shaved > 0 THEN '!' ELSE '' END || ',HIGH_FRAUD_OVERRIDE' END,
    CASE WHEN step = 'state' THEN 'STAGE3_STATE!' WHEN step = 'authority' THEN 'STAGE3_STATE' END,
    CASE WHEN step = 'authority' THEN 'MATERIALITY_' || tier || CASE WHEN auto THEN '' ELSE '!' END END, CASE WHEN step = 'authority' AND risk <> 'STANDARD' THEN 'VENDOR_RISK!' END,
    CASE WHEN step = 'authority' THEN CASE WHEN auto THEN 'AUTHORITY_AUTO_APPROVE!' ELSE 'AUTHORITY_' || tier || '!' END END) AS rules FROM q_decision"""


@query("d9_rules_evaluated", "SELECT document_id, rules FROM q_rules")
def d9_rules(fx):
    mark = F.transform("rules", lambda r: F.concat(r["rule_id"], F.when(r["result"] == "TRIGGERED", "!").otherwise("")))
    return decisions(fx).select("document_id", F.array_join(mark, ",").alias("rules"))


# a wider automatic limit, so that the posting has approvals to work on
WIDE = DecisionPolicy(auto_limit_cents=20_000_000)
CTES["q_auto"] = """SELECT d.company_id, d.document_id, d.po_number, d.amount FROM q_decision d WHERE step = 'authority' AND risk = 'STANDARD' AND d.amount <= 20000000 AND d.po_number IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM v_allocations a WHERE a.document_id = d.document_id AND a.po_number = d.po_number)"""


def postings(fx):
    return dec.post_allocations(dec.decide(report(fx), AS_OF + "Z", WIDE), fx.allocations, fx.pos)


@query("d10_post_allocations", """SELECT p.po_number, (previously_invoiced + coalesce(u.used, 0))::BIGINT AS previously_invoiced FROM v_pos p
  LEFT JOIN (SELECT po_number, sum(amount) AS used FROM q_auto GROUP BY 1) u ON u.po_number = p.po_number""")
def d10(fx):
    return postings(fx)[1].select("po_number", "previously_invoiced")


@query("d10_new_allocations", "SELECT document_id, po_number, amount FROM q_auto")
def d10_new(fx):
    return postings(fx)[0].select("document_id", "po_number", "amount")


@query("d10_post_line_quantities", "SELECT po_number, line_number, (quantity // 2 + CASE WHEN k % 3 = 0 THEN 2 * quantity ELSE 0 END) AS invoiced_quantity FROM v_po_lines")
def d10_lines(fx):
    lines = fx.po_lines.selectExpr("'X' as company_id", "po_number", "line_number", "quantity div 2 as invoiced_quantity", "quantity", "k")
    posted = lines.filter("k % 3 = 0").select("company_id", "po_number", "line_number", "quantity")
    return dec.post_line_quantities(lines, posted.unionByName(posted)).select("po_number", "line_number", "invoiced_quantity")


@query("d11_buyer_verdict", """SELECT document_id, CASE WHEN stage4_decision IN ('TERMINAL_REJECT', 'REJECT') THEN 'do_not_pay' WHEN stage4_status = 'AUTO_APPROVED' OR stage4_decision = 'APPROVE' THEN 'pay'
    WHEN stage4_decision = 'APPROVAL_REQUIRED' THEN 'pay' WHEN stage4_decision = 'REVIEW_REQUIRED' THEN 'needs_review' WHEN stage3_status = 'HOLD' THEN 'needs_review'
    WHEN stage2_status IN ('ambiguous_match', 'multiple_candidates', 'no_matching_evidence', 'waiting_for_po', 'suggested_po_match', 'partial_match', 'unmatched', 'non_po_workflow') THEN 'needs_review'
    WHEN extraction_quality = 'extraction_weak' THEN 'needs_review' ELSE 'pending' END AS verdict FROM v_runs""")
def d11(fx):
    return fx.runs.select("document_id", dec.buyer_verdict().alias("verdict"))


@query("d12_attention_rules", """SELECT document_id, array_to_string(list_transform(list_filter(string_split(rules, ','), lambda r: ends_with(r, '!') AND r NOT IN ('AUTHORITY_AUTO_APPROVE!', 'STAGE3_STATE!', 'CONTRACT_FRESHNESS!', 'CONTRACT_PROCESSING_STATE!')
  AND NOT starts_with(r, 'MATERIALITY_')), lambda r: replace(r, '!', '')), ',') AS rules FROM q_rules""")
def d12(fx):
    return decisions(fx).select("document_id", F.array_join(dec.attention_rules(), ",").alias("rules"))


@query("three_way_match_report", """SELECT document_id, coalesce(po_number, '') AS po_number, s_receipt_match AS receipt, s_budget_tolerance AS budget, s_tax_validation AS tax, overall_state, decision, substate, tier,
  coalesce(target, '') AS route_target FROM q_decision""")
def three_way(fx):
    d = decisions(fx)
    return d.select("document_id", F.coalesce("po_number", F.lit("")).alias("po_number"), ck.check_receipt()["status"].alias("receipt"), ck.check_budget()["status"].alias("budget"),
                    ck.check_tax()["status"].alias("tax"), "overall_state", "decision", "substate", "tier", F.coalesce("route_target", F.lit("")).alias("route_target"))


# --- order-dependent balance ------------------------------------------------------------------------
CTES["q_requests"] = """SELECT document_id, true_po AS po_number, total_cents AS amount, arrival_ts, row_number() OVER (PARTITION BY true_po ORDER BY arrival_ts, document_id) AS r FROM (
    SELECT document_id, true_po, total_cents, arrival_ts FROM v_invoices WHERE total_cents > 0
    UNION ALL SELECT document_id || '-2', true_po, total_cents // 2 + 7, arrival_ts + INTERVAL 1 HOUR FROM v_invoices WHERE total_cents > 0
    UNION ALL SELECT document_id || '-3', true_po, total_cents // 3 + 1, arrival_ts + INTERVAL 2 HOUR FROM v_invoices WHERE total_cents > 0)"""
CTES["q_fold"] = """ /*recursive*/
  SELECT p.po_number, 0::BIGINT AS r, p.total_amount - p.previously_invoiced AS remaining, '' AS document_id, false AS accepted FROM v_pos p
  UNION ALL SELECT f.po_number, q.r, CASE WHEN q.amount <= f.remaining THEN f.remaining - q.amount ELSE f.remaining END, q.document_id, q.amount <= f.remaining
  FROM q_fold f JOIN q_requests q ON q.po_number = f.po_number AND q.r = f.r + 1"""


def requests(fx):
    base = fx.invoices.filter("total_cents > 0").select("company_id", "document_id", F.col("true_po").alias("po_number"), F.col("total_cents").alias("amount"), "arrival_ts")
    second = base.selectExpr("company_id", "concat(document_id, '-2') as document_id", "po_number", "amount div 2 + 7 as amount", "arrival_ts + interval 1 hour as arrival_ts")
    third = base.selectExpr("company_id", "concat(document_id, '-3') as document_id", "po_number", "amount div 3 + 1 as amount", "arrival_ts + interval 2 hour as arrival_ts")
    return base.unionByName(second).unionByName(third)


@query("sequential_po_balance", "SELECT document_id, accepted, remaining FROM q_fold WHERE r > 0")
def sequential_balance(fx):
    balances = fx.pos.selectExpr("company_id", "po_number", "total_amount - previously_invoiced as remaining")
    return seq.consume_balances(requests(fx), balances).select("document_id", "accepted", "remaining")
