"""Checks, decisions, ledger and folds on literal rows, plus the scenarios of the decision steps."""

from datetime import datetime

from pyspark.sql import functions as F

from paymatch.operators import checks as ck
from paymatch.operators import decision as dec
from paymatch.operators import ledger as lg
from paymatch.operators import sequential as seq
from paymatch.sources import tables as tb

REPORT = ("company_id string, document_id string, validation_run_id string, overall_state string, processing_state string, completed_at timestamp, reason_codes array<string>, "
          "controls array<struct<control_type:string,reason_code:string,check_id:string>>, signals array<struct<signal:string,severity:string>>, total_cents bigint, vendor_state string")
NOW = datetime(2024, 1, 2)


def decide(spark, **kw):
    row = {"company_id": "C", "document_id": "D", "validation_run_id": "VR", "overall_state": "VALIDATED", "processing_state": "COMPLETED", "completed_at": NOW,
           "reason_codes": [], "controls": [], "signals": [], "total_cents": 100000, "vendor_state": "active", **kw}
    r = dec.decide(spark.createDataFrame([tuple(row.values())], REPORT), "2024-01-02 01:00:00").first()
    return r


def test_decision_scenarios(spark):
    r = decide(spark)
    assert (r.decision, r.substate) == ("APPROVE", "AUTO_APPROVED")
    r = decide(spark, total_cents=2_000_000)
    assert (r.substate, r.route_target, r.dual_control) == ("APPROVAL_REQUIRED", "finance-manager-group", False)
    r = decide(spark, total_cents=90_000_000)
    assert (r.route_target, r.dual_control) == ("cfo-group", True)
    r = decide(spark, overall_state="BLOCKED", reason_codes=["DUPLICATE_CONFIRMED"], signals=[("THRESHOLD_SHAVING", "MEDIUM")])
    assert (r.decision, r.substate) == ("REJECT", "TERMINAL_REJECT")
    r = decide(spark, overall_state="REVIEW_REQUIRED", signals=[("THRESHOLD_SHAVING", "MEDIUM")])
    assert r.substate == "FRAUD_REVIEW" and r.route_target == "security-fraud-queue"
    r = decide(spark, signals=[("NEW_VENDOR_HIGH_AMOUNT", "MEDIUM")], total_cents=3_000_000)
    assert r.substate == "HIGH_PRIORITY_REVIEW"
    r = decide(spark, overall_state="HOLD", reason_codes=["TAX_VARIANCE"])
    assert r.substate == "HIGH_PRIORITY_REVIEW"
    r = decide(spark, overall_state="HOLD", reason_codes=["VENDOR_INELIGIBLE"])
    assert r.substate == "STANDARD_REVIEW"
    r = decide(spark, overall_state="VALIDATION_INCOMPLETE", reason_codes=["GRN_MISSING"])
    assert (r.decision, r.substate) == ("WAITING_FOR_VALIDATION", "WAITING_FOR_GRN")
    r = decide(spark, completed_at=datetime(2023, 12, 1))
    assert (r.substate, r.decided_by) == ("REVALIDATION_REQUIRED", "contract")
    r = decide(spark, validation_run_id="")
    assert r.substate == "POLICY_CONFIGURATION_ERROR"
    r = decide(spark, vendor_state="suspended")
    assert (r.substate, r.tier, r.approver_group) == ("APPROVAL_REQUIRED", "LOW", "finance-manager-group")


def test_duplicates(spark):
    cols = "company_id string, document_id string, vendor_name string, invoice_number string, total_cents bigint, invoice_date date"
    d = lambda n: datetime(2024, 1, n).date()
    inv = spark.createDataFrame([("C", "A", "Acme, Inc.", "1", 100, d(5)), ("C", "B", "ACME INC", "2", 100, d(5)), ("C", "P", "Acme Inc", "1", 100, d(5)), ("C", "Z", "Other", "1", 100, d(5))], cols)
    priors = spark.createDataFrame([("C", "P", "Acme Inc", "1", 100, d(7), True), ("C", "Q", "Acme Inc", "2", 999, d(7), True), ("C", "R", "Acme Inc", "3", 100, d(20), False)], cols + ", blocking boolean")
    out = {r.document_id: (r.n_exact, r.n_number, r.n_near) for r in ck.duplicate_counts(inv, priors).collect()}
    assert out == {"A": (1, 0, 0), "B": (0, 1, 1), "P": (0, 0, 0), "Z": (0, 0, 0)}


def test_round_and_shaving(spark):
    x = spark.createDataFrame([(100000,), (550000,), (150000,), (990000,), (1000000,), (None,)], "total_cents bigint")
    out = x.select(ck.round_number().alias("r"), ck.shaved_threshold().alias("s")).collect()
    assert [r.r for r in out] == [True, True, False, False, True, False]
    assert [r.s for r in out] == [None, None, None, 1000000, None, None]


def test_fold_skips_what_does_not_fit(spark):
    rows = [(c, "P", datetime(2024, 1, i + 1), f"{c}{i}", a) for c in "DE" for i, a in enumerate([4000, 3500, 3000, 2000])]
    req = spark.createDataFrame(rows, "company_id string, po_number string, arrival_ts timestamp, document_id string, amount bigint")
    bal = spark.createDataFrame([("D", "P", 10000), ("E", "P", 12500)], "company_id string, po_number string, remaining bigint")
    out = {r.document_id: r.accepted for r in seq.consume_balances(req, bal).collect()}
    assert out == {"D0": True, "D1": True, "D2": False, "D3": True, "E0": True, "E1": True, "E2": True, "E3": True}


def test_ledger_roundtrip_and_breaches(spark):
    ev = spark.range(1000).select(F.concat(F.lit("E"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("event_id"), F.timestamp_seconds(F.col("id") % 7).alias("created_at"), F.col("id").cast("string").alias("content"))
    led = lg.append_ledger(ev, 10, "abc").cache()
    assert (led.agg(F.min("ledger_sequence"), F.max("ledger_sequence"), F.count_distinct("ledger_sequence")).first()) == (11, 1010, 1000)
    assert lg.verify_ledger(led, "abc", bucket=64).count() == 0
    broken = led.filter("ledger_sequence <> 500").withColumn("content", F.expr("case when ledger_sequence = 77 then 'x' else content end"))
    got = sorted((r.ledger_sequence, r.breach) for r in lg.verify_ledger(broken, "abc", bucket=64).collect())
    assert got == [(77, "CONTENT_HASH_MISMATCH"), (501, "PREV_HASH_MISMATCH"), (501, "SEQUENCE_GAP")]


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    inc = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, o int")
    once = tb.upsert_by_key(base, inc, ["k"], "o")
    twice = tb.upsert_by_key(once, inc, ["k"], "o")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 4), ("c", 5)]
