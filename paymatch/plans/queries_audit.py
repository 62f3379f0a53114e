"""Explanations, ledger, queues and figures."""

from pyspark.sql import functions as F

from paymatch.operators import analytics as an
from paymatch.operators import explain as ex
from paymatch.operators import ledger as lg
from paymatch.plans.oracle_base import CTES
from paymatch.plans.queries_decision import decisions
from paymatch.plans.registry import query

AS_OF = "2024-03-03 00:00:00"


# --- evidence and narrative -------------------------------------------------------------------------
def stage_tables(fx):
    inv = fx.invoices
    return {1: ("extraction", inv.filter("k % 5 <> 0").selectExpr("document_id", "concat('x', k) as content")),
            2: ("po_match", inv.filter("k % 7 <> 0").selectExpr("document_id", "concat('m', k) as content")),
            3: ("validation_report", inv.selectExpr("document_id", "concat('v', k) as content"))}


@query("j17_evidence_artifacts", """SELECT document_id, stage, artifact_type, c IS NOT NULL AS resolved, coalesce('sha256:' || substring(sha256(c), 1, 16), '') AS artifact_hash FROM (
  SELECT document_id, 1::BIGINT AS stage, 'extraction' AS artifact_type, CASE WHEN k % 5 <> 0 THEN 'x' || k END AS c FROM v_invoices
  UNION ALL SELECT document_id, 2, 'po_match', CASE WHEN k % 7 <> 0 THEN 'm' || k END FROM v_invoices UNION ALL SELECT document_id, 3, 'validation_report', 'v' || k FROM v_invoices
  UNION ALL SELECT document_id, 4, 'decision_record', 'd' || k FROM v_invoices)""")
def j17(fx):
    d = fx.invoices.selectExpr("document_id", "concat('DEC', k) as decision_id", "concat('d', k) as content")
    return ex.evidence_artifacts(d, stage_tables(fx)).drop("decision_id")


@query("j18_reconstruct_decision", """SELECT document_id, status, CASE WHEN k % 3 = 0 THEN 'VALIDATED' ELSE stage3_status END AS overall_state, stage4_decision AS decision, stage4_status AS substate,
  CASE WHEN k % 4 = 0 THEN '' ELSE 'COMPLETE' END AS explanation_status FROM v_runs""")
def j18(fx):
    r = fx.runs
    v = r.selectExpr("document_id", "arrival_ts as created_at", "stage3_status as overall_state").unionByName(
        r.filter("k % 3 = 0").selectExpr("document_id", "arrival_ts + interval 1 hour as created_at", "'VALIDATED' as overall_state"))
    d = r.selectExpr("document_id", "arrival_ts as created_at", "stage4_decision as decision", "stage4_status as substate").unionByName(
        r.selectExpr("document_id", "arrival_ts - interval 1 hour as created_at", "'OLD' as decision", "'OLD' as substate"))
    e = r.filter("k % 4 <> 0").selectExpr("document_id", "arrival_ts as created_at", "'COMPLETE' as explanation_status")
    return ex.reconstruct_decision(r.select("document_id", "status"), v, d, e).withColumn("explanation_status", F.coalesce("explanation_status", F.lit("")))


def narrated(fx):
    return fx.memo("narrated", lambda: ex.build_narrative(decisions(fx)))


_SUB = "CASE substate " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ex.SUBSTATE_TEXT.items()) + " END"


@query("e1_buyer_summary", f"""SELECT document_id, CASE decision WHEN 'APPROVE' THEN 'This invoice can be paid' || po || '.' WHEN 'REVIEW_REQUIRED' THEN CASE WHEN po <> '' THEN 'This invoice matched a PO' || po || ' but needs a person to review before payment.'
    ELSE 'This invoice needs a person to review before we pay.' END WHEN 'REJECT' THEN 'Do not pay this invoice — a blocking rule failed.' ELSE 'We are waiting for more information before deciding.' END || ' '
  || CASE substate WHEN 'AUTO_APPROVED' THEN 'All checks passed within auto-approval limits.' WHEN 'APPROVAL_REQUIRED' THEN 'A manager must approve because of amount or policy limits.' ELSE {_SUB} END AS text
  FROM (SELECT *, CASE WHEN po_number IS NULL THEN '' ELSE ' against ' || po_number END AS po FROM q_decision)""")
def e1_summary(fx):
    return ex.narrative_rows(narrated(fx)).filter("step = 1").select("document_id", "text")


@query("e1_narrative_shape", """SELECT d.document_id, (5 + len(CASE step WHEN 'contract' THEN ['x'] WHEN 'hard' THEN reasons WHEN 'override' THEN list_filter([CASE WHEN first_payment AND amount > 1000000 THEN 'a' END, CASE WHEN g_shaved > 0 THEN 'b' END], lambda x: x IS NOT NULL)
     WHEN 'state' THEN reasons ELSE [] END) + len(string_split(r.rules, ',')) + CASE WHEN step IN ('state', 'authority') THEN 1 ELSE 0 END + CASE WHEN step = 'authority' AND NOT d.auto THEN 1 ELSE 0 END
     + CASE WHEN target IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN mode IN ('full', 'limited') THEN 1 ELSE 0 END)::BIGINT AS n_entries
  FROM q_decision d JOIN (SELECT document_id, rules FROM q_rules) r ON r.document_id = d.document_id""")
def e1_shape(fx):
    return narrated(fx).select("document_id", F.size("narrative").cast("bigint").alias("n_entries"))


@query("e1_build_narrative")
def e1(fx):
    return ex.narrative_rows(narrated(fx))


@query("e2_verify_controls", """WITH act AS (SELECT document_id, actor_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY acted_at) AS r FROM v_human_actions
    WHERE action_type IN ('APPROVE', 'OVERRIDE', 'APPROVAL') OR outcome IN ('APPROVE', 'OVERRIDE', 'APPROVAL')) WHERE r = 1),
  base AS (SELECT d.document_id, substate, tier, step, a.actor_id FROM q_decision d LEFT JOIN act a ON a.document_id = d.document_id)
  SELECT document_id, CASE WHEN substate = 'AUTO_APPROVED' THEN 'AUTO_APPROVAL' WHEN substate = 'TERMINAL_REJECT' THEN 'TERMINAL_REJECT' WHEN substate IN ('WAITING_FOR_GRN', 'WAITING_FOR_REQUIRED_DATA', 'REVALIDATION_REQUIRED') THEN 'DATA_RECEIPT'
      WHEN substate = 'APPROVAL_REQUIRED' THEN 'APPROVAL' WHEN substate = 'FRAUD_REVIEW' THEN 'FRAUD_INVESTIGATION' WHEN substate = 'HIGH_PRIORITY_REVIEW' THEN 'SENIOR_REVIEW' WHEN substate = 'STANDARD_REVIEW' THEN 'AP_REVIEW' END AS control_type,
    CASE WHEN substate IN ('AUTO_APPROVED', 'TERMINAL_REJECT') THEN 'NOT_REQUIRED' WHEN substate IN ('WAITING_FOR_GRN', 'WAITING_FOR_REQUIRED_DATA', 'REVALIDATION_REQUIRED') THEN 'PENDING' WHEN actor_id IS NOT NULL THEN 'VERIFIED' ELSE 'PENDING' END AS status,
    CASE WHEN substate IN ('AUTO_APPROVED', 'TERMINAL_REJECT') THEN 'system' WHEN substate IN ('WAITING_FOR_GRN', 'WAITING_FOR_REQUIRED_DATA', 'REVALIDATION_REQUIRED') THEN '' ELSE coalesce(actor_id, '') END AS verified_by FROM base
  UNION ALL SELECT document_id, 'DUAL_CONTROL', 'PENDING', '' FROM base WHERE step = 'authority' AND tier = 'CRITICAL' AND substate = 'APPROVAL_REQUIRED'""")
def e2(fx):
    x = ex.verify_controls(decisions(fx), fx.human_actions)
    return x.select("document_id", F.explode("control_rows").alias("c")).select("document_id", "c.*")


def explained(fx):
    x = narrated(fx).withColumns({"generated_at": F.when(F.expr("k % 31 <> 0"), F.col("completed_at")), "policy_version": F.when(F.expr("k % 41 <> 0"), "AP-2026.08.1").otherwise(""),
                                  "stage4_resolved": F.expr("k % 43 <> 0")})
    return ex.completeness_gate(x)


@query("e3_completeness_gate", """SELECT document_id, CASE WHEN failed = '' THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS explanation_status, failed AS checks_failed FROM (SELECT document_id,
  concat_ws(',', CASE WHEN k % 31 = 0 THEN 'generated_at' END, CASE WHEN k % 41 = 0 THEN 'policy_version' END, CASE WHEN k % 43 = 0 THEN 'stage4_artifact' END) AS failed FROM v_invoices)""")
def e3(fx):
    return explained(fx).select("document_id", "explanation_status", F.array_join("checks_failed", ",").alias("checks_failed"))


@query("e4_explanation_snapshot", "SELECT document_id, decision, substate FROM q_decision WHERE k % 9 <> 0")
def e4(fx):
    x = explained(fx)
    return ex.explanation_snapshot(x, x.filter("k % 9 = 0").select("decision_id")).select("document_id", "decision", "substate")


# --- ledger -----------------------------------------------------------------------------------------
CTES["q_ledger"] = """
  SELECT ledger_sequence, document_id, content_hash, coalesce(lag(content_hash) OVER (ORDER BY ledger_sequence), 'GENESIS') AS previous_hash FROM (
    SELECT 100 + row_number() OVER (ORDER BY arrival_ts, document_id) AS ledger_sequence, document_id, sha256('{"id":"' || document_id || '","total":' || coalesce(total_cents, 0) || '}') AS content_hash FROM v_invoices)"""


def ledger_events(fx):
    return fx.invoices.selectExpr("document_id as event_id", "document_id", "arrival_ts as created_at", "k",
                                  """concat('{"id":"', document_id, '","total":', coalesce(total_cents, 0), '}') as content""")


def ledger(fx):
    return fx.memo("ledger", lambda: lg.append_ledger(ledger_events(fx), last_sequence=100))


@query("e5_append_ledger", "SELECT ledger_sequence, document_id, content_hash, previous_hash FROM q_ledger")
def e5(fx):
    return ledger(fx).select("ledger_sequence", "document_id", "content_hash", "previous_hash")


CTES["q_bad_ledger"] = """SELECT ledger_sequence, CASE WHEN ledger_sequence % 97 = 0 THEN 'tampered' ELSE previous_hash END AS previous_hash, content_hash FROM q_ledger WHERE ledger_sequence % 101 <> 0"""


def bad_ledger(fx):
    return ledger(fx).filter("ledger_sequence % 101 <> 0").withColumn("previous_hash", F.expr("case when ledger_sequence % 97 = 0 then 'tampered' else previous_hash end"))


@query("e6_verify_ledger", """WITH x AS (SELECT *, lag(ledger_sequence) OVER (ORDER BY ledger_sequence) AS ps, coalesce(lag(content_hash) OVER (ORDER BY ledger_sequence), 'GENESIS') AS ph FROM q_bad_ledger)
  SELECT ledger_sequence, 'PREV_HASH_MISMATCH' AS breach FROM x WHERE previous_hash <> ph UNION ALL SELECT ledger_sequence, 'SEQUENCE_GAP' FROM x WHERE ledger_sequence <> ps + 1""")
def e6(fx):
    return lg.verify_ledger(bad_ledger(fx).select("ledger_sequence", "previous_hash", "content_hash"), bucket=256).select("ledger_sequence", "breach")


@query("e6_ledger_status", "SELECT count(*) AS records_checked, min(ledger_sequence) AS first_sequence, max(ledger_sequence) AS last_sequence, 0::BIGINT AS breaches, 'INTACT' AS status FROM q_ledger")
def e6_status(fx):
    x = ledger(fx).select("ledger_sequence", "previous_hash", "content_hash", "content")
    return lg.ledger_status(x, lg.verify_ledger(x, bucket=256))


# --- queues and figures -----------------------------------------------------------------------------
CTES["q_items0"] = """SELECT *, concat_ws(',', CASE WHEN status = 'needs_human_review' THEN 'STAGE1_REVIEW' END, CASE WHEN extraction_quality = 'extraction_weak' THEN 'EXTRACTION_PARTIAL' END,
    CASE WHEN stage2_status = 'no_matching_evidence' THEN 'NO_MATCHING_EVIDENCE' END, CASE WHEN stage2_status IN ('ambiguous_match', 'multiple_candidates') THEN 'PO_AMBIGUOUS' END,
    CASE WHEN reconciliation_status = 'residual_review' THEN 'UNEXPLAINED_RESIDUAL' END, CASE WHEN quality_score < 0.5 THEN 'POOR_SCAN_QUALITY' END,
    CASE WHEN stage2_status IN ('ambiguous_match', 'waiting_for_po', 'suggested_po_match', 'partial_match') THEN 'PO_CONFIRMATION_REQUIRED' END, CASE WHEN stage3_status IN ('REVIEW_REQUIRED', 'HOLD') THEN 'VALIDATION_REVIEW' END,
    CASE WHEN stage4_status <> '' AND stage4_status NOT IN ('AUTO_APPROVED', 'TERMINAL_REJECT') THEN 'CONTROL_PENDING' END) AS reasons FROM v_runs"""
CTES["q_items"] = """SELECT *, arrival_ts + to_hours(CASE queue WHEN 'ap-exception-queue' THEN 48 WHEN 'senior-finance-queue' THEN 8 WHEN 'security-fraud-queue' THEN 4 ELSE 48 END) AS sla_due_at FROM (
  SELECT *, CASE WHEN quality_score < 0.5 THEN 'scan-quality-queue' WHEN stage4_status = 'FRAUD_REVIEW' THEN 'security-fraud-queue' WHEN stage4_decision = 'REVIEW_REQUIRED' THEN
      CASE stage4_status WHEN 'HIGH_PRIORITY_REVIEW' THEN 'senior-finance-queue' ELSE 'ap-exception-queue' END ELSE 'ap-exception-queue' END AS queue,
    CASE WHEN stage4_status IN ('FRAUD_REVIEW', 'HIGH_PRIORITY_REVIEW') THEN 'URGENT' WHEN quality_score < 0.5 THEN 'HIGH' ELSE 'NORMAL' END AS priority FROM q_items0 WHERE reasons <> '')"""


def items(fx):
    return an.work_items(fx.runs, F.col("arrival_ts"))


@query("q1_work_items", "SELECT document_id, queue, priority, reasons, epoch(sla_due_at)::BIGINT AS sla_due FROM q_items")
def q1(fx):
    return items(fx).select("document_id", "queue", "priority", F.array_join("reason_codes", ",").alias("reasons"), F.unix_timestamp("sla_due_at").alias("sla_due"))


@query("q2_review_queue", "SELECT document_id, priority FROM q_items WHERE queue = 'ap-exception-queue' ORDER BY sla_due_at, document_id LIMIT 50")
def q2(fx):
    return an.review_queue(items(fx), "ap-exception-queue").select("document_id", "priority")


@query("q3_complete_work_items", "SELECT document_id, CASE WHEN document_id IN (SELECT document_id FROM v_confirmations) THEN 'completed' ELSE 'open' END AS item_status FROM q_items")
def q3(fx):
    return an.complete_work_items(items(fx), fx.confirmations).select("document_id", "item_status")


@query("q4_run_stats", """SELECT count(*) AS total, count(*) FILTER (status = 'stage1_passed') AS stage1_passed, count(*) FILTER (status = 'needs_human_review') AS needs_human_review, count(*) FILTER (status = 'extraction_failed') AS extraction_failed,
  floor(sum(processing_ms) FILTER (status <> 'extraction_failed')::DOUBLE / count(*) FILTER (status <> 'extraction_failed') / 10 + 0.5e0) / 100 AS avg_seconds,
  floor(count(*) FILTER (status = 'stage1_passed') * 1000::DOUBLE / count(*) + 0.5e0) / 10 AS auto_approval_rate FROM v_runs""")
def q4(fx):
    return an.run_stats(fx.runs)


@query("q5_exception_totals", """SELECT count(*) FILTER (reconciliation_status = 'residual_review') AS residual_review_count, floor(count(*) FILTER (status = 'stage1_passed') * 1000::DOUBLE / count(*) + 0.5e0) / 10 AS auto_pass_rate, count(*) AS total_processed,
  (SELECT floor(count(*) FILTER (action = 'confirm') * 1000::DOUBLE / count(*) + 0.5e0) / 10 FROM v_confirmations) AS po_suggestion_acceptance_rate FROM v_runs""")
def q5(fx):
    return an.exception_totals(fx.runs, fx.confirmations)


@query("q5_reason_breakdown", "SELECT reasons, count(*) AS cnt FROM q_items GROUP BY 1 ORDER BY cnt DESC, reasons LIMIT 10")
def q5_sets(fx):
    return an.reason_breakdown(items(fx))


@query("q5_reason_counts", "SELECT reason, count(*) AS cnt FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM q_items) GROUP BY 1")
def q5_counts(fx):
    return an.reason_counts(items(fx))


@query("q6_master_stats", " UNION ALL ".join(f"SELECT company_id, '{n}' AS name, count(*) AS n FROM {v} GROUP BY 1" for n, v in (("vendors", "v_vendors"), ("purchase_orders", "v_pos"), ("source_records", "v_source_records"), ("invoice_runs", "v_runs")))
       + " UNION ALL SELECT company_id, 'import_pos', count(*) FILTER (po_number LIKE 'IMP-%') FROM v_pos GROUP BY 1 UNION ALL SELECT company_id, 'demo_po_90xx', count(*) FILTER (po_number LIKE 'PO-90%') FROM v_pos GROUP BY 1")
def q6(fx):
    return an.master_stats({"vendors": fx.vendors, "purchase_orders": fx.pos, "source_records": fx.source_records, "invoice_runs": fx.runs})


@query("q7_list_runs", "SELECT document_id, status FROM v_runs WHERE status = 'needs_human_review' ORDER BY arrival_ts DESC, document_id LIMIT 50 OFFSET 20")
def q7_runs(fx):
    return an.page(fx.runs, [F.col("arrival_ts").desc(), "document_id"], 50, 20, "needs_human_review").select("document_id", "status")


@query("q7_list_source_records", "SELECT source_record_id, coalesce(invoice_number, '') AS invoice_number FROM v_source_records ORDER BY created_at DESC, source_record_id LIMIT 25 OFFSET 5")
def q7_records(fx):
    return an.page(fx.source_records, [F.col("created_at").desc(), "source_record_id"], 25, 5).select("source_record_id", F.coalesce("invoice_number", F.lit("")).alias("invoice_number"))


@query("q7_list_imports", """SELECT company_id, created_at::DATE::VARCHAR AS imported_on, count(*) AS rows, count(po_reference) AS with_order, sum(invoice_total)::BIGINT AS total_cents
  FROM v_source_records GROUP BY 1, created_at::DATE ORDER BY created_at::DATE DESC, company_id LIMIT 20""")
def q7_imports(fx):
    return an.list_imports(fx.source_records).withColumn("imported_on", F.col("imported_on").cast("string"))


@query("q8_extraction_feedback", """SELECT c.document_id, coalesce(trim(vendor_name), '') AS vendor_id, c.field_name, '' AS original_value, new_value AS corrected_value, actor_id FROM v_corrections c
  JOIN v_invoices i ON i.document_id = c.document_id WHERE field_name IN ('invoice_number', 'total_amount')""")
def q8(fx):
    x = an.extraction_feedback(fx.corrections, fx.invoices, {"invoice_number": "invoice_number", "total_amount": "total_cents"})
    return x.select("document_id", "vendor_id", "field_name", F.coalesce("original_value", F.lit("")).alias("original_value"), "corrected_value", "actor_id")


@query("q9_status_messages", "SELECT document_id, concat_ws(' / ', '📋 ' || CASE extraction_quality " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ex.QUALITY_LABELS.items())
       + " END, '📦 Stage 2: ' || CASE stage2_status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ex.STAGE2_LABELS.items())
       + """ END, CASE stage3_status WHEN '' THEN NULL WHEN 'HOLD' THEN '🛡️ Stage 3: Hold' WHEN 'REVIEW_REQUIRED' THEN '🛡️ Stage 3: Review Required' WHEN 'BLOCKED' THEN '🛡️ Stage 3: Blocked' WHEN 'VALIDATION_INCOMPLETE' THEN '🛡️ Stage 3: Validation Incomplete'
       ELSE '🛡️ Stage 3: Validated' END, CASE WHEN stage4_decision <> '' THEN '⚖️ Stage 4: ' || stage4_decision || CASE WHEN stage4_status <> '' THEN ' (' || stage4_status || ')' ELSE '' END END) AS messages FROM v_runs""")
def q9(fx):
    return ex.status_messages(fx.runs).select("document_id", F.array_join("messages", " / ").alias("messages"))


@query("b22_apply_field_corrections", """SELECT document_id, CASE WHEN k % 74 = 0 THEN 'FIX2-' || k WHEN k % 37 = 0 THEN 'FIX-' || k ELSE coalesce(invoice_number, '') END AS invoice_number,
  CASE WHEN k % 37 = 0 THEN greatest(number_conf, 0.95e0) ELSE number_conf END AS number_conf, CASE WHEN k % 37 = 0 THEN 'extracted' ELSE number_status END AS number_status,
  CASE WHEN k % 67 = 0 THEN subtotal_cents + tax_cents ELSE total_cents END AS total_cents, CASE WHEN k % 67 = 0 THEN 0.95e0 ELSE total_conf END AS total_conf FROM v_invoices""")
def b22(fx):
    x = an.apply_corrections(fx.invoices, fx.corrections, {"invoice_number": ("invoice_number", "number_conf", "number_status", "string"),
                                                           "total_amount": ("total_cents", "total_conf", "total_status", "bigint")})
    return x.select("document_id", F.coalesce("invoice_number", F.lit("")).alias("invoice_number"), "number_conf", "number_status", "total_cents", "total_conf")


