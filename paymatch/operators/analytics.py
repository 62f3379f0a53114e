"""Review queues and operational figures (Q1-Q8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paymatch.functions.expr import flags, lookup
from paymatch.functions.text import safe_str
from paymatch.policy import ROUTING

# the first listed route with a queue gives its SLA
QUEUE_HOURS: dict = {}
for _target, _priority, _hours, _resume in ROUTING.values():
    if _target:
        QUEUE_HOURS.setdefault(_target, _hours)


def work_items(runs: DataFrame, as_of) -> DataFrame:
    """Q1.  One work item per run that needs attention."""
    s2, s4 = F.col("stage2_status"), F.col("stage4_status")
    poor = F.col("quality_score") < 0.5
    reasons = flags(
        ("STAGE1_REVIEW", F.col("status") == "needs_human_review"), ("EXTRACTION_PARTIAL", F.col("extraction_quality") == "extraction_weak"),
        ("NO_MATCHING_EVIDENCE", s2 == "no_matching_evidence"), ("PO_AMBIGUOUS", s2.isin("ambiguous_match", "multiple_candidates")),
        ("UNEXPLAINED_RESIDUAL", F.col("reconciliation_status") == "residual_review"), ("POOR_SCAN_QUALITY", poor),
        ("PO_CONFIRMATION_REQUIRED", s2.isin("ambiguous_match", "waiting_for_po", "suggested_po_match", "partial_match")),
        ("VALIDATION_REVIEW", F.col("stage3_status").isin("REVIEW_REQUIRED", "HOLD")),
        ("CONTROL_PENDING", (s4 != "") & ~s4.isin("AUTO_APPROVED", "TERMINAL_REJECT")))
    x = runs.withColumn("reason_codes", reasons).filter(F.size("reason_codes") > 0)
    routed = lookup(s4, {k: v[0] for k, v in ROUTING.items() if v[0]}, None)
    queue = (F.when(poor, "scan-quality-queue").when(s4 == "FRAUD_REVIEW", "security-fraud-queue")
             .when(F.col("stage4_decision") == "REVIEW_REQUIRED", F.coalesce(routed, F.lit("ap-exception-queue"))).otherwise("ap-exception-queue"))
    x = x.withColumn("queue", queue)
    hours = lookup(F.col("queue"), QUEUE_HOURS, 48, "int")
    return x.withColumns({
        "priority": F.when(s4.isin("FRAUD_REVIEW", "HIGH_PRIORITY_REVIEW"), "URGENT").when(poor, "HIGH").otherwise("NORMAL"),
        "sla_due_at": F.lit(as_of).cast("timestamp") + F.make_dt_interval(hours=hours) if isinstance(as_of, str) else as_of + F.make_dt_interval(hours=hours),
        "item_status": F.lit("open")})


def review_queue(items: DataFrame, queue: str | None = None, status: str = "open", limit: int = 50) -> DataFrame:
    """Q2.  The most urgent items of a queue."""
    x = items.filter(F.col("item_status") == status)
    if queue:
        x = x.filter(F.col("queue") == queue)
    return x.orderBy("sla_due_at", "document_id").limit(limit)


def complete_work_items(items: DataFrame, done: DataFrame) -> DataFrame:
    """Q3.  Close the open items of the given documents."""
    d = done.select("document_id").distinct().withColumn("_d", F.lit(True))
    return items.join(d, "document_id", "left").withColumn(
        "item_status", F.when(F.col("_d") & (F.col("item_status") == "open"), "completed").otherwise(F.col("item_status"))).drop("_d")


def run_stats(runs: DataFrame) -> DataFrame:
    """Q4.  One pass over the runs."""
    n = F.count(F.lit(1))
    of = lambda s: F.count_if(F.col("status") == s)
    x = runs.agg(n.alias("total"), of("stage1_passed").alias("stage1_passed"), of("needs_human_review").alias("needs_human_review"),
                 of("extraction_failed").alias("extraction_failed"), F.sum(F.when(F.col("status") != "extraction_failed", F.col("processing_ms"))).alias("_ms"),
                 F.count_if(F.col("status") != "extraction_failed").alias("_n"))
    return x.select("total", "stage1_passed", "needs_human_review", "extraction_failed",
                    F.when(F.col("_n") > 0, F.floor(F.col("_ms") / F.col("_n") / 10 + 0.5) / 100).otherwise(F.lit(0.0)).alias("avg_seconds"),
                    F.when(F.col("total") > 0, F.floor(F.col("stage1_passed") * 1000 / F.col("total") + 0.5) / 10).otherwise(F.lit(0.0)).alias("auto_approval_rate"))


def exception_totals(runs: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Q5, the single figures."""
    rate = lambda a, b: F.when(b > 0, F.floor(a * 1000 / b + 0.5) / 10).otherwise(F.lit(0.0))
    r = runs.agg(F.count_if(F.col("reconciliation_status") == "residual_review").alias("residual_review_count"),
                 rate(F.count_if(F.col("status") == "stage1_passed"), F.count(F.lit(1))).alias("auto_pass_rate"), F.count(F.lit(1)).alias("total_processed"))
    share = confirmations.agg(rate(F.count_if(F.col("action") == "confirm"), F.count_if(F.col("action").isin("confirm", "reject")))).scalar()
    return r.withColumn("po_suggestion_acceptance_rate", share)


def reason_breakdown(items: DataFrame, top: int = 10) -> DataFrame:
    """Q5, the most frequent sets of reasons."""
    return items.groupBy(F.array_join("reason_codes", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), "reasons").limit(top)


def reason_counts(items: DataFrame) -> DataFrame:
    return items.select(F.explode("reason_codes").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("cnt"))


def master_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Q6.  Rows per table and company, with imported and demo orders counted apart."""
    count = lambda name, df: df.groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).select("company_id", F.lit(name).alias("name"), "n")
    parts = [count(name, df) for name, df in tables.items()]
    if "purchase_orders" in tables:
        p = tables["purchase_orders"].groupBy("company_id").agg(F.count_if(F.startswith("po_number", F.lit("IMP-"))).alias("i"),
                                                                 F.count_if(F.startswith("po_number", F.lit("PO-90"))).alias("d"))
        parts += [p.select("company_id", F.lit("import_pos").alias("name"), F.col("i").alias("n")), p.select("company_id", F.lit("demo_po_90xx").alias("name"), F.col("d").alias("n"))]
    return reduce(DataFrame.unionByName, parts)


def page(df: DataFrame, order: list, limit: int, offset: int = 0, status: str | None = None) -> DataFrame:
    """Q7.  One page of a listing; `order` must be total for stable pages."""
    x = df if status is None else df.filter(F.col("status") == status)
    return x.orderBy(*order).offset(offset).limit(limit)


def list_imports(records: DataFrame, limit: int = 20) -> DataFrame:
    """Q7.  The newest imports: each company's records of one day are one import."""
    imports = records.groupBy("company_id", F.to_date("created_at").alias("imported_on")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("po_reference").alias("with_order"), F.sum("invoice_total").alias("total_cents"))
    return page(imports, [F.col("imported_on").desc(), "company_id"], limit)


def extraction_feedback(corrections: DataFrame, inv: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Q8.  Old and new value per corrected field.  `fields` maps the field name to the invoice column."""
    old = inv.select("document_id", "vendor_name", *[F.col(c).cast("string").alias(f) for f, c in fields.items()])
    old = old.unpivot(["document_id", "vendor_name"], list(fields), "field_name", "original_value")
    return corrections.join(old, ["document_id", "field_name"]).select(
        "document_id", safe_str("vendor_name").alias("vendor_id"), "field_name", "original_value", F.col("new_value").alias("corrected_value"), "actor_id", "acted_at")


def apply_corrections(inv: DataFrame, corrections: DataFrame, fields: dict[str, tuple[str, str, str | None, str]]) -> DataFrame:
    """B22.  Lay the latest correction of each header field over the extraction; lines are never corrected.

    `fields`: field name -> (value column, confidence column, status column, type of the value).
    """
    c = corrections.filter(F.col("field_name").isin(*fields)).groupBy("document_id", "field_name").agg(F.max(F.struct("acted_at", "new_value")).alias("c"))
    wide = c.groupBy("document_id").agg(*[F.max(F.when(F.col("field_name") == f, F.struct(F.col("c.new_value").alias("v")))).alias(f"_{f}") for f in fields])
    x = inv.join(wide, "document_id", "left")
    for f, (value, conf, status, kind) in fields.items():
        hit = F.col(f"_{f}").isNotNull()
        x = x.withColumn(value, F.when(hit, F.col(f"_{f}.v").try_cast(kind)).otherwise(F.col(value)))
        x = x.withColumn(conf, F.when(hit, F.greatest(conf, F.lit(0.95))).otherwise(F.col(conf)))
        if status:
            x = x.withColumn(status, F.when(hit, "extracted").otherwise(F.col(status)))
    return x.drop(*[f"_{f}" for f in fields])
