"""The chain of the ledger: one pass over the rows, also where rows tie."""

from pyspark.sql import functions as F

from paymatch.operators import ledger as lg


def test_rows_that_tie_still_chain_and_contents_are_written_once(spark, monkeypatch):
    written, stage = [], lg.stage
    monkeypatch.setattr(lg, "stage", lambda df: written.append(df.columns) or stage(df))
    ev = spark.range(600).select(F.lit("E").alias("event_id"), F.timestamp_seconds(F.col("id") % 5).alias("created_at"), F.expr("cast(id div 2 as string)").alias("content"))
    rows = sorted(lg.append_ledger(ev, 10, "abc").collect(), key=lambda r: r.ledger_sequence)
    assert len(written) == 1
    assert [r.ledger_sequence for r in rows] == list(range(11, 611))
    assert [r.previous_hash for r in rows] == ["abc", *(r.content_hash for r in rows[:-1])]


def test_verification_leaves_contents_where_they_lie(spark):
    led = lg.append_ledger(spark.range(50).selectExpr("cast(id as string) as event_id", "timestamp_seconds(id) as created_at", "repeat('x', id) as content"))
    plan = lg.verify_ledger(led.withColumn("content", F.concat("content", F.lit("?"))), bucket=16)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "CONTENT_HASH_MISMATCH" in plan and "_bad" in window.split("Scan")[0] and "sha2" not in plan[:plan.index("Window")]
