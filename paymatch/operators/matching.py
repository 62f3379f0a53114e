"""From scored candidates to one match package per invoice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.functions.expr import flags, true
from paymatch.functions.fields import confidence_gate, po_presence, suggestion_mode
from paymatch.operators.candidates import candidate_orders, discover, resolve_for
from paymatch.operators.lines import match_lines, resolve_multi_po
from paymatch.operators.scoring import score_candidates
from paymatch.plans.runtime import stage
from paymatch.policy import CHECKS, MATCH, MatchPolicy


@dataclass
class Masters:
    """The master tables a match runs against."""

    vendors: DataFrame
    pos: DataFrame
    po_lines: DataFrame
    grn: DataFrame
    references: DataFrame
    source_records: DataFrame


CANDIDATE_FIELDS = ("po_number", "cand_vendor_id", "vendor_name", "score", "s_po", "s_vendor", "s_line", "s_amount", "s_date",
                    "coverage", "over", "remaining", "flags", "status", "po_type", "currency", "method", "maps")
#: What a person who has to choose an order is shown of each suggested one.
SUGGESTION_FIELDS = ("po_number", "vendor_name", "score", "s_po", "s_vendor", "s_line", "s_amount", "s_date", "remaining", "status", "po_type")


def scored_pairs(inv: DataFrame, invoice_lines: DataFrame, m: Masters, as_of: str, policy: MatchPolicy = MATCH,
                 resolved: DataFrame | None = None) -> DataFrame:
    """One row per (invoice, candidate order) with scores."""
    if resolved is None:
        resolved = stage(resolve_for(inv, m.vendors, policy))
    cands = stage(discover(inv, resolved, m.pos, m.vendors, m.references, m.source_records, policy))
    head = inv.select("company_id", "document_id", F.col("vendor_name").alias("inv_vendor_name"), "total_cents", "invoice_date")
    res = resolved.select("company_id", F.col("vendor_name").alias("inv_vendor_name"),
                          F.col("vendor_id").alias("resolved_vendor_id"), F.col("confidence").alias("resolved_conf"))
    head = head.join(res, ["company_id", "inv_vendor_name"], "left")
    orders = candidate_orders(m.pos, m.source_records)
    pairs = cands.join(head, ["company_id", "document_id"]).join(orders, ["company_id", "po_number"])
    return score_candidates(match_lines(pairs, invoice_lines, m.po_lines, policy), as_of, policy)


def ranked_candidates(scored: DataFrame) -> DataFrame:
    """One row per invoice: its candidates by score, retrieval order on ties (at most the retrieval cap)."""
    row = F.struct((-F.col("score")).alias("o"), F.col("rank"), *[F.col(c) for c in CANDIDATE_FIELDS])
    return scored.groupBy("company_id", "document_id").agg(F.array_sort(F.collect_list(row)).alias("cands"))


def _fits(c: Column, tolerance: float, partial: bool) -> Column:
    total, r = F.col("total_cents"), c["remaining"]
    ok = (r > 0) & (total <= r * (1 + tolerance))
    return true(ok & (total > 0) if partial else ok & (total >= r * (1 - tolerance)))


def _count(cond) -> Column:
    return F.size(F.filter("cands", cond))


def gate_columns(x: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    """M1-M5 as columns over the ranked candidate array."""
    top = F.try_element_at("cands", F.lit(1))
    second = F.try_element_at("cands", F.lit(2))
    v_min, a_min = int(policy.gate_min_vendor * 10), int(policy.gate_min_amount * 10)

    def unique(c):
        return (c["s_vendor"] >= v_min) & (c["s_amount"] >= a_min) & ~c["over"] & _fits(c, policy.unique_tolerance, True)

    x = x.withColumns({
        "n_cands": F.size("cands"), "top": top,
        "gap": top["score"] - F.coalesce(second["score"], F.lit(0)),
        # the order currency is that of the first retrieved candidate, not of the best scored one
        "po_currency": F.array_min(F.transform("cands", lambda c: F.struct(c["rank"].alias("r"), c["currency"].alias("c"))))["c"],
        "n_vendor": _count(lambda c: c["s_vendor"] > 0),
        "n_unique": _count(unique),
        "n_tight": _count(lambda c: (c["s_vendor"] > 0) & (c["s_amount"] >= a_min) & _fits(c, policy.unique_tolerance, False)),
    })
    same_currency = F.col("currency").isNull() | F.col("po_currency").isNull() | (F.upper("currency") == F.upper("po_currency"))
    t = F.col("top")
    return x.withColumns({
        "g_unique": true((F.col("n_unique") == 1) & unique(t) & same_currency),
        "g_ambiguous": F.col("n_tight") >= 2,
        "g_vendor_only": F.col("total_cents").isNull() & (F.col("n_lines") == 0) & (F.col("n_vendor") >= 2),
        "g_evidence": true(F.col("suggestion") & (t["s_vendor"] >= v_min) & (t["s_line"] >= int(policy.gate_min_line * 10))
                           & (t["s_amount"] >= a_min) & (t["coverage"] >= policy.gate_min_coverage)
                           & (F.col("gap") >= int(policy.gate_min_gap * 10)) & ~t["over"]),
        "g_single": true(F.col("suggestion") & (F.col("n_vendor") == 1) & (t["s_vendor"] >= v_min) & (t["s_amount"] >= a_min)
                         & ~t["over"] & _fits(t, policy.single_po_tolerance, True)),
    })


def detect_ambiguity(x: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    """M6.  Adds `ambiguity` and `n_selected` (how many leading candidates are selected)."""
    s, tenth = F.col("top")["score"], lambda v: int(v * 10)

    def by_score(gap_ok):
        return (F.when(s >= tenth(policy.exact_threshold), "matched")
                .when(s >= tenth(policy.high_confidence_threshold), "high_confidence_match")
                .when((s >= tenth(policy.minimum_threshold)) & gap_ok, "high_confidence_match").otherwise("unmatched"))

    review = F.when(F.col("presence") == "non_po", "suggested_po_match").otherwise("waiting_for_po")
    worth = s >= tenth(policy.minimum_threshold * 0.5)
    suggest = F.when(worth, review).otherwise("unmatched")
    many = by_score(F.col("gap") >= tenth(policy.auto_select_gap))
    status = (F.when(F.col("g_vendor_only"), "multiple_candidates")
              .when(F.col("g_ambiguous"), "ambiguous_match")
              .when(F.col("g_unique") | F.col("g_evidence") | F.col("g_single"), "high_confidence_match")
              .when((F.col("n_cands") == 1) & F.col("suggestion"), suggest)
              .when(F.col("n_cands") == 1, by_score(F.lit(True)))
              .when(F.col("gap") < tenth(policy.ambiguous_gap), "ambiguous_match")
              .when((many == "unmatched") & F.col("suggestion"), suggest)
              .otherwise(many))
    x = x.withColumn("ambiguity", status)
    a = F.col("ambiguity")
    return x.withColumn("n_selected", F.when(a == "multiple_candidates", 5).when(a == "ambiguous_match", 2)
                        .when(a.isin("matched", "high_confidence_match"), 1).otherwise(0))


def final_match_state(x: DataFrame, grn: DataFrame, required=CHECKS.grn_required_types) -> DataFrame:
    """M7, after the multi-order split.  Needs `ambiguity`, `selected`, `cands`, `n_lines`."""
    unmatched = F.array_distinct(F.flatten(F.transform("selected", lambda c: F.transform(
        F.filter(c["maps"], lambda m: m["match_type"] == "unmatched"), lambda m: m["invoice_line"]))))
    received = grn.select("company_id", F.col("po_number").alias("sel_po")).distinct().withColumn("has_grn", F.lit(True))
    x = x.withColumns({"unmatched_lines": F.coalesce(unmatched, F.array().cast("array<bigint>")),
                       "sel_po": F.try_element_at("selected", F.lit(1))["po_number"]})
    x = x.join(received, ["company_id", "sel_po"], "left")
    any_flag = lambda f: F.exists("cands", lambda c: F.array_contains(c["flags"], f))
    sure = F.col("ambiguity").isin("matched", "high_confidence_match")
    # nothing selected counts as a standard order without receipt, but then the status is not a sure match
    kind = F.coalesce(F.try_element_at("selected", F.lit(1))["po_type"], F.lit("standard"))
    no_grn = ~true(F.col("has_grn")) & sure & kind.isin(*required) & (F.col("n_lines") > 0)
    share = (F.col("n_lines") - F.size("unmatched_lines")) / F.col("n_lines")
    partial = (F.size("unmatched_lines") > 0) & (F.col("n_lines") > 0) & (share > 0) & (share < 1)
    closed, cancelled = any_flag("closed_po"), any_flag("cancelled_po")
    status = (F.when(cancelled | closed, "closed_po_review").when(no_grn, "waiting_for_grn")
              .when(partial & (share >= 0.5), "partial_match").when(partial, "unmatched").otherwise(F.col("ambiguity")))
    part_label = F.concat(F.lit("partial_match_"), F.size("unmatched_lines").cast("string"), F.lit("_unmatched"))
    fl = (F.when(cancelled, F.array(F.lit("cancelled_po_exception")))
          .when(closed, F.array(F.lit("closed_po_exception"))).when(no_grn, F.array(F.lit("no_grn_record")))
          .when(partial, flags((part_label, F.lit(True)), ("partial_invoice", share >= 0.5)))
          .otherwise(flags(("overbilling_warning", F.exists("cands", lambda c: c["over"])))))
    return x.withColumns({"match_status": status, "flags": fl})


def match_package(inv: DataFrame, scored: DataFrame, n_lines: DataFrame, m: Masters, resolved: DataFrame,
                  policy: MatchPolicy = MATCH) -> DataFrame:
    """M8.  One row per invoice.  `inv` may carry `can_match` (the evidence gate, C9); without it every invoice may be matched.

    `suggested_pos` holds the best-scored candidates, at most `policy.suggestions`, whatever was selected.
    """
    head = inv.withColumns({
        "presence": po_presence(), "gate": confidence_gate(),
        "suggestion": suggestion_mode() | (po_presence() == "non_po"),
        "may_match": F.col("can_match") if "can_match" in inv.columns else F.lit(True)})
    head = head.join(n_lines, ["company_id", "document_id"], "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    head = head.select("company_id", "document_id", "vendor_name", "total_cents", "currency", "presence", "gate", "suggestion", "may_match", "n_lines")
    res = resolved.select("company_id", "vendor_name", F.col("vendor_id").alias("resolved_id"))
    head = head.join(res, ["company_id", "vendor_name"], "left")
    x = head.join(ranked_candidates(scored), ["company_id", "document_id"], "left")
    x = detect_ambiguity(gate_columns(x.withColumn("cands", F.when(F.col("may_match"), F.col("cands"))), policy), policy)
    split = F.when((F.col("n_cands") > 1) & F.col("ambiguity").isin("high_confidence_match", "matched", "ambiguous_match"),
                   resolve_multi_po(F.col("cands"), policy))
    x = x.withColumn("split", split)
    multi = true(F.size("split") > 1)
    entry = lambda c, maps: F.struct(c["po_number"].alias("po_number"), c["cand_vendor_id"].alias("vendor_id"), c["score"].alias("score"),
                                     c["s_vendor"].alias("s_vendor"), c["po_type"].alias("po_type"), maps.alias("maps"))
    leaders = F.transform(F.when(F.col("n_selected") > 0, F.slice("cands", F.lit(1), F.col("n_selected"))), lambda c: entry(c, c["maps"]))
    spread = F.transform("split", lambda s: entry(F.element_at(F.filter("cands", lambda c: c["po_number"] == s["po_number"]), 1), s["maps"]))
    x = x.withColumns({"multi_po": multi, "selected": F.when(multi, spread).otherwise(leaders)})
    x = x.withColumn("ambiguity", F.when(F.col("multi_po"), "high_confidence_match").otherwise(F.col("ambiguity")))
    x = final_match_state(x, m.grn)
    # `cands` is NULL where nothing was found or matching was not attempted
    none = F.col("cands").isNull()
    picked = F.coalesce(F.size("selected"), F.lit(0)) > 0
    has_name = F.coalesce("vendor_name", F.lit("")) != ""
    empty = F.when(F.col("suggestion") & has_name, "unmatched").when(F.col("presence") != "non_po", "waiting_for_po").otherwise("non_po_workflow")
    only_suggested = F.col("suggestion") & (F.col("presence") == "non_po") & ~picked
    status = (F.when(~F.col("may_match"), "no_matching_evidence").when(none, empty)
              .when(only_suggested, "suggested_po_match").otherwise(F.col("match_status")))
    first = F.try_element_at("selected", F.lit(1))
    aligned = F.col("resolved_id").isNull() & picked & (first["s_vendor"] > 0) & (first["vendor_id"] != "")
    provenance = (F.when(none, "").when(only_suggested, "suggestion").when(~picked, "")
                  .when(~F.col("suggestion") & (F.col("presence") == "po_invoice"), "authoritative_po")
                  .when(F.col("ambiguity").isin("matched", "high_confidence_match"), "evidence").otherwise("suggestion"))
    x = x.select(
        "company_id", "document_id", status.alias("match_status"),
        F.coalesce("selected", F.array().cast(x.schema["selected"].dataType)).alias("matched_pos"),
        F.coalesce("cands", F.array().cast(x.schema["cands"].dataType)).alias("candidates"),
        F.coalesce(F.transform(F.slice("cands", 1, policy.suggestions), lambda c: F.struct(*[c[f].alias(f) for f in SUGGESTION_FIELDS])), F.array()).alias("suggested_pos"),
        F.coalesce("n_cands", F.lit(0)).cast("bigint").alias("candidate_count"), "unmatched_lines",
        F.when(none & F.col("may_match"), F.array(F.lit("po_not_found"))).when(none, F.array().cast("array<string>")).otherwise(F.col("flags")).alias("flags"),
        provenance.alias("provenance"), "suggestion", "presence", F.col("gate").alias("confidence_action"),
        F.coalesce("resolved_id", F.when(aligned, first["vendor_id"])).alias("vendor_id"),
        F.when(F.col("resolved_id").isNotNull() & ~none, "master_hit").when(true(aligned), "po_aligned").otherwise("unresolved").alias("vendor_master_status"),
        F.coalesce("gap", F.lit(0)).alias("gap"), "n_lines", F.col("multi_po"))
    next_stage = (F.when(F.col("match_status").isin("matched", "high_confidence_match", "partial_match"), "validation")
                  .when(F.col("match_status").isin("ambiguous_match", "unmatched", "no_matching_evidence", "multiple_candidates",
                                                   "waiting_for_po", "suggested_po_match"), "human_review").otherwise(""))
    return x.withColumn("next_stage", next_stage)


def match_invoices(inv: DataFrame, invoice_lines: DataFrame, m: Masters, as_of: str, policy: MatchPolicy = MATCH) -> DataFrame:
    """The whole of stage 2 over a table of invoices."""
    resolved = stage(resolve_for(inv, m.vendors, policy))
    scored = scored_pairs(inv, invoice_lines, m, as_of, policy, resolved)
    n = invoice_lines.groupBy("company_id", "document_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return match_package(inv, scored, n, m, resolved, policy)


# --- fixed values: sentences shown to people ---------------------------------------------------------
SUMMARIES = {
    "no_matching_evidence": "Extraction was unable to provide enough information for PO matching.",
    "one_match": "One open PO uniquely matched the available evidence.",
    "ambiguous": "Available evidence was insufficient to distinguish PO candidates.",
    "none_viable": "No open PO matched the extracted evidence.",
    "waiting_for_po": "PO reference or evidence insufficient for confident match.",
    "suggested_po_match": "No PO on invoice — suggested PO match available for confirmation.",
}
DETAILS = {
    "no_candidates": "PO matching found 0 candidates.",
    "none_viable": "PO matching found 0 viable candidates.",
    "vendor": "Vendor matched exactly.",
    "amount": "Invoice amount aligns with remaining PO balance.",
    "lines": "Line items matched PO lines.",
    "hint": "PO candidate surfaced from imported transaction po_reference (hint only).",
    "no_contradiction": "No contradictory evidence was found.",
}


def match_explanation(pkg: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """M9.  Summary, detail lines, counts and what the extraction had and lacked, for people.

    `evidence`: (company_id, document_id, available, missing) of the evidence profile (C8); without it both lists are empty.
    """
    none = F.array().cast("array<string>")
    if evidence is None:
        pkg = pkg.withColumns({"available": none, "missing": none})
    else:
        pkg = pkg.join(evidence.select("company_id", "document_id", "available", "missing"), ["company_id", "document_id"], "left")
    c, s = F.col("match_status"), F.col("matched_pos")
    viable = F.filter("candidates", lambda x: (x["score"] > 0) | (x["s_vendor"] > 0))
    top = F.try_element_at("candidates", F.lit(1))
    found = F.concat(F.lit("PO matching found "), F.size(viable).cast("string"), F.lit(" viable candidate(s)."))
    one = c.isin("matched", "high_confidence_match") & (F.size(s) == 1)
    unsure = c.isin("ambiguous_match", "multiple_candidates")
    hopeless = (c == "unmatched") & (F.size(viable) == 0)
    ranked = lambda tail: F.concat(F.lit("Ranked "), F.col("candidate_count").cast("string"), F.lit(tail))
    listed = lambda label, x: (F.concat(F.lit(f"{label}: "), F.array_join(x, ", ")), F.size(x) > 0)
    around = lambda text: flags(listed("Available", F.col("available")), (text, F.lit(True)), listed("Missing", F.col("missing")))
    summary = (F.when(c == "no_matching_evidence", SUMMARIES["no_matching_evidence"]).when(one, SUMMARIES["one_match"]).when(unsure, SUMMARIES["ambiguous"])
               .when(hopeless, SUMMARIES["none_viable"]).when(c == "waiting_for_po", SUMMARIES["waiting_for_po"])
               .when(c == "suggested_po_match", SUMMARIES["suggested_po_match"]).otherwise(F.concat(F.lit("PO resolution outcome: "), c)))
    details = (F.when(c == "no_matching_evidence", around(DETAILS["no_candidates"]))
               .when(one, flags((F.concat(F.lit("Matched PO: "), F.try_element_at(s, F.lit(1))["po_number"]), F.lit(True)),
                                (DETAILS["vendor"], top["s_vendor"] > 0), (DETAILS["amount"], top["s_amount"] > 0), (DETAILS["lines"], top["s_line"] > 0),
                                (DETAILS["hint"], top["method"] == "source_record_po_hint"), (DETAILS["no_contradiction"], F.lit(True))))
               .when(unsure, F.concat(F.array(found), F.transform(F.slice(viable, 1, 5), lambda x: F.concat(
                   F.lit("Candidate: "), x["po_number"], F.lit(" (score "), F.round(x["score"] / 10.0).cast("bigint").cast("string"), F.lit(")")))))
               .when(hopeless, around(DETAILS["none_viable"]))
               .when(c == "waiting_for_po", F.array(ranked(" candidate(s) for human review.")))
               .when(c == "suggested_po_match", F.array(ranked(" candidate(s) by vendor, amount, and lines.")))
               .otherwise(none))
    return pkg.select("document_id", "match_status", summary.alias("summary"), details.alias("details"), F.coalesce("available", none).alias("available"),
                      F.coalesce("missing", none).alias("missing"), "candidate_count", F.size(viable).cast("bigint").alias("viable"), "next_stage")


def latest_confirmations(confirmations: DataFrame) -> DataFrame:
    """The last human answer per document."""
    return confirmations.groupBy("document_id").agg(F.max(F.struct("acted_at", "action", "po_number", "actor")).alias("c")).select(
        "document_id", "c.action", "c.po_number", "c.actor")


def confirm_po(inv: DataFrame, invoice_lines: DataFrame, m: Masters, confirmations: DataFrame, as_of: str,
               policy: MatchPolicy = MATCH) -> DataFrame:
    """M10.  Confirmed documents get their order as the one exact candidate and count as matched."""
    c = latest_confirmations(confirmations).filter("action = 'confirm'").select("document_id", "po_number", "actor")
    x = inv.join(c.select("document_id"), "document_id", "left_semi")
    orders = m.pos.select("company_id", "po_number", F.col("vendor_id").alias("resolved_vendor_id"))
    pairs = x.select("company_id", "document_id", "total_cents", "invoice_date").join(c, "document_id").withColumns({
        "method": F.lit("exact"), "confidence": F.lit(1.0), "rank": F.lit(1), "inv_vendor_name": F.lit(None).cast("string"), "resolved_conf": F.lit(1.0)})
    pairs = pairs.join(orders, ["company_id", "po_number"]).join(candidate_orders(m.pos, m.source_records), ["company_id", "po_number"])
    scored = score_candidates(match_lines(pairs, invoice_lines, m.po_lines, policy), as_of, policy)
    over = F.filter("flags", lambda f: F.startswith(f, F.lit("potential_")) | F.startswith(f, F.lit("overage_")))
    return scored.select("company_id", "document_id", "po_number", F.lit("matched").alias("match_status"),
                         F.lit("human_confirmed").alias("provenance"), F.col("cand_vendor_id").alias("vendor_id"), "score", "s_line",
                         over.alias("flags"), "maps", F.concat(F.lit("Human confirmed PO "), "po_number", F.lit(" by "), "actor").alias("evidence"))


def reject_suggestions(pkg: DataFrame, confirmations: DataFrame) -> DataFrame:
    """M11.  The last answer is a rejection: the match is cleared and goes to a person."""
    r = latest_confirmations(confirmations).filter("action = 'reject'").select("document_id", F.lit(True).alias("_r"), F.col("po_number").alias("manual_po_number"))
    x = pkg.join(r, "document_id", "left")
    gone = true(F.col("_r"))
    empty = F.array().cast(pkg.schema["matched_pos"].dataType)
    return x.withColumns({
        "match_status": F.when(gone, "po_suggestions_rejected").otherwise(F.col("match_status")),
        "matched_pos": F.when(gone, empty).otherwise(F.col("matched_pos")),
        "suggestion": ~gone & F.col("suggestion"),
        "next_stage": F.when(gone, "human_review").otherwise(F.col("next_stage"))}).drop("_r")


