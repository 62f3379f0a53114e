"""The stored chain and its re-run after answers, corrections and late submissions (A11, B22, J17, J18, M10, ST1)."""

import re

from pyspark.sql import functions as F

from paymatch.operators import chain
from paymatch.plans.oracle_base import CTES
from paymatch.plans.queries_checks import chain_inputs, report
from paymatch.plans.queries_decision import AS_OF, decisions
from paymatch.plans.queries_match import AS_OF as MATCH_AS_OF
from paymatch.plans.queries_match import masters, packages, prepared, with_refs
from paymatch.plans.registry import query
from paymatch.plans.runtime import shared_dir, stage
from paymatch.policy import MATCH_TOKENS
from paymatch.sources.artifacts import PAYLOADS, ArtifactStore

CUTOFF = "2024-03-02 00:00:00"  # what arrives later is not in the first run
RERUN = "2024-03-05 00:00:00Z"
_LATE = f"arrival_ts > TIMESTAMP '{CUTOFF}'"

# --- the SQL: the same chain over corrected extractions, with the answers laid over the match ---------
_AFTER = {name: re.sub(r"\bv_invoices\b", "v_invoices0", CTES[name]) for name in
          ("v_prior_runs", "v_allocations", "v_source_records", "v_first_answers", "v_corrections", "v_charges", "v_invoice_lines")}
_AFTER["v_invoices0"] = CTES["v_invoices"]
_AFTER["v_invoices"] = """
  SELECT i.* REPLACE (coalesce(c.num, invoice_number) AS invoice_number, CASE WHEN c.num IS NOT NULL THEN greatest(number_conf, 0.95e0) ELSE number_conf END AS number_conf,
      CASE WHEN c.num IS NOT NULL THEN 'extracted' ELSE number_status END AS number_status, coalesce(c.total, total_cents) AS total_cents,
      CASE WHEN c.total IS NOT NULL THEN greatest(total_conf, 0.95e0) ELSE total_conf END AS total_conf, CASE WHEN c.total IS NOT NULL THEN 'extracted' ELSE total_status END AS total_status)
  FROM v_invoices0 i LEFT JOIN (SELECT document_id AS cd, arg_max(new_value, acted_at) FILTER (field_name = 'invoice_number') AS num, arg_max(new_value, acted_at) FILTER (field_name = 'total_amount')::BIGINT AS total
    FROM v_corrections GROUP BY 1) c ON c.cd = i.document_id"""
_AFTER["q_confirmed"] = """SELECT i.company_id, i.document_id, p.po_number, p.vendor_id FROM q_answers a JOIN v_invoices0 i ON i.document_id = a.document_id
  JOIN v_pos p ON p.company_id = i.company_id AND p.po_number = a.po_number WHERE a.action = 'confirm'"""
_AFTER["q_candidates0"] = CTES["q_candidates"]
_AFTER["q_candidates"] = """SELECT * FROM q_candidates0 WHERE document_id NOT IN (SELECT document_id FROM q_confirmed)
  UNION ALL SELECT company_id, document_id, po_number, 'exact', 1e0, 1, 1 FROM q_confirmed"""
_AFTER["q_match0"] = CTES["q_match"]
_AFTER["q_match"] = """
  SELECT m.* REPLACE (CASE WHEN c.document_id IS NOT NULL THEN 'matched' WHEN r.document_id IS NOT NULL THEN 'po_suggestions_rejected' ELSE match_status END AS match_status,
      CASE WHEN c.document_id IS NOT NULL THEN [c.po_number] WHEN r.document_id IS NOT NULL THEN [] ELSE selected END AS selected,
      c.document_id IS NULL AND r.document_id IS NULL AND suggestion AS suggestion, c.document_id IS NULL AND multi AS multi,
      CASE WHEN c.document_id IS NOT NULL THEN 'human_confirmed' ELSE provenance END AS provenance, coalesce(c.vendor_id, m.vendor_id) AS vendor_id,
      CASE WHEN c.document_id IS NOT NULL THEN c.vendor_id WHEN r.document_id IS NOT NULL THEN NULL ELSE cand_vendor END AS cand_vendor)
  FROM q_match0 m LEFT JOIN q_confirmed c ON c.document_id = m.document_id LEFT JOIN (SELECT document_id FROM q_answers WHERE action = 'reject') r ON r.document_id = m.document_id"""
_AFTER["q_touched"] = f"""SELECT document_id FROM v_confirmations UNION SELECT document_id FROM v_corrections WHERE field_name IN ('invoice_number', 'total_amount')
  UNION SELECT document_id FROM v_invoices0 WHERE {_LATE}"""
_AFTER["q_dctx"] = CTES["q_dctx"].replace("epoch(TIMESTAMP", "document_id NOT IN (SELECT document_id FROM q_touched) AND epoch(TIMESTAMP")
_NEXT = """CASE WHEN mode = 'none' THEN 'MANUAL_REVIEW' WHEN mode = 'invalid' THEN 'INVESTIGATE' WHEN overall_state IN ('VALIDATED', 'REVIEW_REQUIRED') THEN 'STAGE4_DECISION'
    WHEN overall_state IN ('HOLD', 'BLOCKED') THEN 'EXCEPTION_RESOLUTION' ELSE 'WAIT_OR_REVALIDATE' END"""


def store(fx) -> ArtifactStore:
    """The artifact store after a first run over what had arrived by then, and one re-run."""
    if "artifact_store" not in fx.__dict__:
        prepared(fx)
        s = ArtifactStore(fx.spark, f"{shared_dir(fx.spark).rstrip('/')}/paymatch-artifacts/{__import__('uuid').uuid4().hex}")
        inv = stage(with_refs(fx.invoices))
        late = inv.filter(F.expr(f"arrival_ts > timestamp '{CUTOFF}Z'"))
        first = chain.assessed(inv, fx.invoice_lines, fx.charges).join(late.select("document_id"), "document_id", "left_anti")
        chain.first_run(s, "first", first, packages(fx), report(fx), decisions(fx), AS_OF + "Z")
        changes = chain.Changes(fx.confirmations, fx.corrections, late)
        fx.__dict__["reruns"] = chain.rerun(s, "rerun", inv, fx.invoice_lines, fx.charges, masters(fx), chain_inputs(fx), changes, RERUN, MATCH_AS_OF, MATCH_TOKENS)
        fx.__dict__["touched"] = stage(changes.documents(inv))
        fx.__dict__["artifact_store"] = s
    return fx.__dict__["artifact_store"]


@query("m10_rerun_decisions", """SELECT d.document_id, m.match_status, m.provenance, array_to_string(m.selected, ',') AS matched_pos, d.overall_state, d.decision, d.substate,
    d.document_id IN (SELECT document_id FROM q_touched) AS touched FROM q_decision d JOIN q_match m ON m.document_id = d.document_id""", _AFTER)
def m10_rerun(fx):
    x = store(fx).reconstruct()
    touched = fx.__dict__["touched"].select("document_id", F.lit(True).alias("touched"))
    return x.join(touched, "document_id", "left").select("document_id", "match_status", "provenance", "matched_pos", "overall_state", "decision", "substate",
                                                         F.coalesce("touched", F.lit(False)).alias("touched"))


@query("m10_rerun_causes", f"""SELECT document_id, string_agg(cause, ',' ORDER BY cause) AS causes FROM (SELECT document_id, 'answer' AS cause FROM v_confirmations UNION
  SELECT document_id, 'correction' FROM v_corrections WHERE field_name IN ('invoice_number', 'total_amount') UNION SELECT document_id, 'late' FROM v_invoices WHERE {_LATE}) GROUP BY 1""")
def m10_causes(fx):
    store(fx)
    return fx.__dict__["touched"].select("document_id", F.array_join("causes", ",").alias("causes"))


@query("j18_reconstruct_stored", f"""SELECT d.document_id, m.match_status, d.overall_state, array_to_string(d.reasons, ',') AS reason_codes, {_NEXT} AS next_action, d.decision, d.substate, d.step AS decided_by,
  coalesce(d.target, '') AS route_target, d.sla AS sla_hours, 'COMPLETE' AS explanation_status FROM q_decision d JOIN q_match m ON m.document_id = d.document_id""", _AFTER)
def j18_stored(fx):
    return store(fx).reconstruct().select("document_id", "match_status", "overall_state", "reason_codes", "next_action", "decision", "substate", "decided_by",
                                          F.coalesce("route_target", F.lit("")).alias("route_target"), "sla_hours", "explanation_status")


def _hash(columns: dict[str, str]) -> str:
    return "'sha256:' || substring(sha256(" + " || '|' || ".join(f"'{k}=' || coalesce(({v})::VARCHAR, '')" for k, v in columns.items()) + "), 1, 16)"


_MATCH_HASH = _hash(dict(zip(PAYLOADS["match"], ("m.match_status", "m.provenance", "array_to_string(m.selected, ',')", "m.vendor_id"))))
_REPORT_HASH = _hash(dict(zip(PAYLOADS["validation"], ("d.mode", "d.overall_state", "array_to_string(d.reasons, ',')", _NEXT.replace("mode", "d.mode").replace("overall_state", "d.overall_state")))))
_DECISION_HASH = _hash(dict(zip(PAYLOADS["decision"], ("d.decision", "d.substate", "d.step", "d.target", "d.sla"))))
_EXTRACTION_HASH = _hash(dict(zip(PAYLOADS["extraction"], ("e.quality", "e.reconciliation"))))


@query("j17_stored_artifacts", f"""SELECT document_id, stage, artifact_type, h IS NOT NULL AS resolved, coalesce(h, '') AS artifact_hash FROM (
  SELECT document_id, 1::BIGINT AS stage, 'extraction' AS artifact_type, CASE WHEN quality <> 'extraction_weak' THEN {_EXTRACTION_HASH} END AS h FROM q_quality e
  UNION ALL SELECT document_id, 2, 'match', CASE WHEN match_status <> 'no_matching_evidence' THEN {_MATCH_HASH} END FROM q_match m
  UNION ALL SELECT document_id, 3, 'validation', CASE WHEN mode IN ('full', 'limited') THEN {_REPORT_HASH} END FROM q_decision d
  UNION ALL SELECT document_id, 4, 'decision', {_DECISION_HASH} FROM q_decision d)""", _AFTER)
def j17_stored(fx):
    return store(fx).artifacts().filter("stage <= 4").select("document_id", "stage", "artifact_type", "resolved", "artifact_hash")


@query("a11_stored_versions", f"""WITH late AS (SELECT document_id FROM v_invoices WHERE {_LATE})
  SELECT document_id, CASE WHEN document_id IN (SELECT document_id FROM late) THEN 'rerun' ELSE 'first' END AS run_id FROM v_invoices""")
def a11_versions(fx):
    return store(fx).history("match").filter("version = 1").select("document_id", "run_id")
