"""One chain from the match of an invoice to its decision, and the re-run of that chain for documents that changed (M10, B22, ST1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paymatch.functions.expr import true
from paymatch.operators import arithmetic as ar
from paymatch.operators import checks as ck
from paymatch.operators import explain as ex
from paymatch.operators.analytics import apply_corrections
from paymatch.operators.decision import decide
from paymatch.operators.lines import line_arrays
from paymatch.operators.matching import Masters, confirm_po, match_invoices, reject_suggestions
from paymatch.plans.runtime import stage
from paymatch.policy import MATCH, MatchPolicy
from paymatch.sources.artifacts import ArtifactStore

KEY = ["company_id", "document_id"]
#: Header fields a person may correct: value, confidence and status column, and the type of the value.
CORRECTABLE = {"invoice_number": ("invoice_number", "number_conf", "number_status", "string"),
               "total_amount": ("total_cents", "total_conf", "total_status", "bigint")}


@dataclass
class History:
    """What validation compares an invoice with: changes of vendors' bank data, vendors of paid orders, earlier blocking runs."""

    vendor_changes: DataFrame
    paid: DataFrame
    priors: DataFrame


def matched_findings(matched: DataFrame, invoice_lines: DataFrame, po_lines: DataFrame) -> DataFrame:
    """Adds price_fail and qty_flag of the mapped lines of the first matched order; needs (keys, po_number, maps)."""
    price, qty = ck.line_variances()
    i = line_arrays(invoice_lines, "document_id", "line_no", False).withColumnRenamed("lines", "inv_lines")
    p = line_arrays(po_lines, "po_number", "line_number", True).withColumnRenamed("lines", "po_lines")
    x = matched.join(i, KEY, "left").join(p, ["company_id", "po_number"], "left")
    return x.withColumns({"price_fail": true(price), "qty_flag": true(qty)}).drop("inv_lines", "po_lines", "maps")


def validation_inputs(inv: DataFrame, invoice_lines: DataFrame, packages: DataFrame, m: Masters, history: History) -> DataFrame:
    """J16 from the match packages (M8): the validation context of every invoice, with V1's mode.

    `inv` carries `reconciliation` (C6).  The context is that of the first matched order; an invoice without one keeps its
    row and goes where its match status sends it.
    """
    inv = stage(inv)
    first = F.try_element_at("matched_pos", F.lit(1))
    found = packages.select(*KEY, "match_status", "suggestion", "provenance", F.size("matched_pos").alias("n_matched"), first["po_number"].alias("po_number"),
                            F.nullif(first["vendor_id"], F.lit("")).alias("match_vendor_id"), F.when(F.size("matched_pos") > 0, F.nullif(F.col("vendor_id"), F.lit(""))).alias("resolved_vendor_id"),
                            first["maps"].alias("maps"))
    # findings and duplicates are written on their own, so that the driver never holds the plan of the whole context
    ctx = ck.validation_context(inv, stage(matched_findings(found, invoice_lines, m.po_lines)), m.pos, m.vendors, m.grn)
    ctx = ck.unpaid_vendors(ctx.join(history.vendor_changes, ["company_id", "match_vendor_id"], "left"), history.paid)
    return ctx.join(stage(ck.duplicate_counts(inv, history.priors)), KEY, "left").withColumn("mode", ck.validation_mode())


@dataclass
class Changes:
    """What makes documents run again: answers to suggested orders, corrected header fields, submissions that came late."""

    confirmations: DataFrame
    corrections: DataFrame
    late: DataFrame

    def documents(self, inv: DataFrame) -> DataFrame:
        """(company_id, document_id, causes) of the documents of `inv` that are touched, each once."""
        fields = self.corrections.filter(F.col("field_name").isin(*CORRECTABLE))
        causes = (self.confirmations.select("document_id", F.lit("answer").alias("cause"))
                  .union(fields.select("document_id", F.lit("correction"))).union(self.late.select("document_id", F.lit("late"))))
        causes = causes.groupBy("document_id").agg(F.array_sort(F.collect_set("cause")).alias("causes"))
        return inv.select(*KEY).join(causes, "document_id").select(*KEY, "causes")


def assessed(inv: DataFrame, lines: DataFrame, charges: DataFrame) -> DataFrame:
    """`inv` with reconciliation (C6), evidence gate (C9) and extraction quality."""
    x = ar.evidence_profile(ar.reconcile(inv, lines, charges).withColumn("n_refs", F.size("refs")))
    return x.select(*inv.columns, "reconciliation", "can_match", "extraction_quality")


def stage_rows(inv: DataFrame, packages: DataFrame, report: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """What the artifact store keeps of each stage, one flat row per document."""
    told = ex.completeness_gate(ex.build_narrative(decisions).withColumns({
        "generated_at": F.col("completed_at"), "policy_version": F.lit("AP-2026.08.1"), "stage4_resolved": F.lit(True)}))
    return {"extraction": inv,
            "match": packages.withColumn("matched_pos", F.array_join(F.transform("matched_pos", lambda p: p["po_number"]), ",")),
            "validation": report.withColumn("reason_codes", F.array_join("reason_codes", ",")), "decision": decisions,
            "explanation": told.withColumn("steps", F.size("narrative"))}


def run_stages(inv: DataFrame, lines: DataFrame, packages: DataFrame, m: Masters, history: History, completed_at, as_of: str) -> dict[str, DataFrame]:
    """Stages 3 to 5 over match packages; `inv` is `assessed`."""
    report = stage(ck.validation_report(validation_inputs(inv, lines, packages, m, history), completed_at))
    return stage_rows(inv, packages, report, stage(decide(report, as_of)))


def _package_rows(packages: DataFrame) -> DataFrame:
    orders = F.transform("matched_pos", lambda p: F.struct(p["po_number"].alias("po_number"), p["vendor_id"].alias("vendor_id"), p["maps"].alias("maps")))
    return packages.select(*KEY, "match_status", "suggestion", "provenance", orders.alias("matched_pos"), F.coalesce("vendor_id", F.lit("")).alias("vendor_id"))


def rematch(inv: DataFrame, lines: DataFrame, m: Masters, confirmations: DataFrame, as_of: str, policy: MatchPolicy = MATCH) -> DataFrame:
    """Stage 2 again: confirmed documents get their order, rejected ones lose what was selected, all others are matched anew."""
    human = confirm_po(inv, lines, m, confirmations, as_of, policy).select(
        *KEY, "match_status", F.lit(False).alias("suggestion"), "provenance", F.array(F.struct("po_number", "vendor_id", "maps")).alias("matched_pos"), "vendor_id")
    human = stage(human)
    rest = inv.join(human.select(*KEY), KEY, "left_anti")
    matched = reject_suggestions(match_invoices(rest, lines, m, as_of, policy), confirmations)
    return _package_rows(matched).unionByName(_package_rows(human))


def rerun(store: ArtifactStore, run_id: str, inv: DataFrame, lines: DataFrame, charges: DataFrame, m: Masters, history: History, changes: Changes,
          at: str, match_as_of: str, policy: MatchPolicy = MATCH) -> dict[str, DataFrame]:
    """M10, B22, ST1.  Stages 2 to 5 again for exactly the documents that `changes` touches; returns the versions added.

    `inv` (with `refs`) holds all extractions.  The set of touched documents is semi-joined to every input before anything
    is computed, so a re-run costs what the change costs; other documents keep their stored versions.  `at` is the time
    of the re-run: a document's new validation is as fresh as that.
    """
    ids = stage(changes.documents(inv))
    x = apply_corrections(inv.join(ids, KEY, "left_semi"), changes.corrections, CORRECTABLE)
    own = stage(lines.join(ids, KEY, "left_semi"))
    x = stage(assessed(x, own, charges.join(ids, "document_id", "left_semi")))
    packages = stage(rematch(x, own, m, changes.confirmations.join(ids, "document_id", "left_semi"), match_as_of, policy))
    out = run_stages(x, own, packages, m, history, F.lit(at).cast("timestamp"), at)
    return {name: store.append(name, rows, run_id, at) for name, rows in out.items()}


def first_run(store: ArtifactStore, run_id: str, inv: DataFrame, packages: DataFrame, report: DataFrame, decisions: DataFrame, at: str) -> dict[str, DataFrame]:
    """The outputs of a whole run into the store; `inv` says which documents were there, all others are left out."""
    keys = inv.select(*KEY)
    rows = stage_rows(inv, _package_rows(packages), report, decisions)
    return {name: store.append(name, df.join(keys, KEY, "left_semi"), run_id, at) for name, df in rows.items()}
