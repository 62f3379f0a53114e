"""Streaming queries, replayed from the event table as four files in time order (ST1-ST6)."""

from pyspark.sql import functions as F

from paymatch.plans.oracle_base import CTES
from paymatch.plans.registry import query
from paymatch.streaming import stream as st

CTES["v_submissions"] = """SELECT 'E' || event_id AS document_id, ts, 'U' || user_id AS po_number, floor(value * 100e0 + 0.5e0)::BIGINT AS amount, event_type, event_id FROM events"""


def submissions(fx):
    """Write the events once as four files whose modification order is the time order."""
    if "submissions" not in fx.__dict__:
        path = st.work_dir(fx.spark, "events")
        # the table holds plain UTC wall-clock times; take them as instants whatever the session's time zone is
        x = fx.table("events").selectExpr("concat('E', event_id) as document_id", "from_utc_timestamp(cast(ts as timestamp), current_timezone()) as ts", "day(ts) as d", "concat('U', user_id) as po_number", "floor(value * 100e0 + 0.5e0) as amount", "event_type", "event_id")
        for lo, hi in ((1, 8), (9, 16), (17, 24), (25, 31)):
            x.filter(f"d between {lo} and {hi}").drop("d").coalesce(1).write.mode("append").parquet(path)
        fx.__dict__["submissions"] = (path, x.drop("d").schema)
    return st.read_submissions(fx.spark, *fx.__dict__["submissions"])


@query("st1_stream_dedupe_submissions", "SELECT DISTINCT 'D' || (event_id // 2) AS document_id FROM events")
def st1(fx):
    s = submissions(fx).selectExpr("concat('D', event_id div 2) as document_id", "ts")
    root = st.work_dir(fx.spark, "st1")
    st.run_batches(st.dedupe_submissions(s), lambda b, i: st.write_batch(b.select("document_id"), f"{root}/out", i), root)
    return st.read_back(fx.spark, f"{root}/out").drop("batch_id")


@query("st1_late_submissions", """WITH x AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN ts - INTERVAL 12 DAY ELSE ts END AS late_ts, CASE WHEN day(ts) <= 8 THEN 0 WHEN day(ts) <= 16 THEN 1 WHEN day(ts) <= 24 THEN 2 ELSE 3 END AS b FROM v_submissions),
  m AS (SELECT b, max(late_ts) AS m FROM x GROUP BY 1)
  SELECT document_id FROM x WHERE floor(epoch(late_ts)) < (SELECT floor(epoch(max(m))) - 172800 FROM m WHERE m.b < x.b)""")
def st1_late(fx):
    s = submissions(fx).withColumn("ts", F.expr("case when event_id % 50 = 0 then ts - interval 12 day else ts end"))
    return st.route_late(s, st.work_dir(fx.spark, "late")).select("document_id")


@query("st2_stream_duplicate_guard", "SELECT document_id, row_number() OVER (PARTITION BY po_number, amount // 100 ORDER BY ts, document_id) > 1 AS duplicate FROM v_submissions")
def st2(fx):
    s = submissions(fx).selectExpr("document_id", "ts", "po_number as vendor_key", "amount div 100 as number")
    return st.duplicate_guard(s, st.work_dir(fx.spark, "st2"), ["vendor_key", "number"])


CTES["q_arrivals"] = """SELECT document_id, ts, user_id % 40 AS v, 'N' || (event_id % 400) AS n, CASE WHEN event_id % 13 = 0 THEN NULL ELSE floor(value)::BIGINT * 100 END AS a, ts::DATE AS d FROM v_submissions JOIN (SELECT event_id, user_id, value FROM events) USING (event_id)"""


@query("st2_three_duplicate_tests", """WITH x AS (SELECT *, row_number() OVER (ORDER BY ts, document_id) AS r, count(*) OVER (PARTITION BY v, n ORDER BY ts, document_id ROWS UNBOUNDED PRECEDING) - 1 AS c_number,
      CASE WHEN a IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY v, n, a ORDER BY ts, document_id ROWS UNBOUNDED PRECEDING) - 1 END AS n_exact FROM q_arrivals),
  near AS (SELECT x.document_id, count(*) AS n_near FROM x JOIN x y ON y.v = x.v AND y.a = x.a AND y.n <> x.n AND y.r < x.r AND abs(datediff('day', y.d, x.d)) <= 3 GROUP BY 1)
  SELECT x.document_id, n_exact, c_number - n_exact AS n_number, coalesce(n_near, 0) AS n_near, CASE WHEN n_exact > 0 THEN 'FAIL' WHEN c_number > n_exact OR n_near > 0 THEN 'FLAG' ELSE 'PASS' END AS status
  FROM x LEFT JOIN near ON near.document_id = x.document_id""")
def st2_three(fx):
    s = submissions(fx).selectExpr("document_id", "ts", "cast(substring(po_number, 2) as bigint) % 40 as vendor", "concat('N', event_id % 400) as number",
                                   "case when event_id % 13 = 0 then null else amount div 100 * 100 end as amount", "to_date(to_utc_timestamp(ts, current_timezone())) as invoice_date")
    return st.three_duplicate_tests(s, st.work_dir(fx.spark, "three"))


CTES["q_stream_requests"] = "SELECT *, row_number() OVER (PARTITION BY po_number ORDER BY ts, document_id) AS r FROM v_submissions WHERE event_type = 'purchase'"
CTES["q_stream_fold"] = """ /*recursive*/
  SELECT DISTINCT po_number, 0::BIGINT AS r, 20000::BIGINT AS remaining, '' AS document_id, false AS accepted FROM v_submissions
  UNION ALL SELECT f.po_number, q.r, CASE WHEN q.amount <= f.remaining THEN f.remaining - q.amount ELSE f.remaining END, q.document_id, q.amount <= f.remaining
  FROM q_stream_fold f JOIN q_stream_requests q ON q.po_number = f.po_number AND q.r = f.r + 1"""


@query("st3_stream_po_balance", "SELECT document_id, accepted, remaining FROM q_stream_fold WHERE r > 0")
def st3(fx):
    balances = fx.table("events").selectExpr("'C1' as company_id", "concat('U', user_id) as po_number").distinct().withColumn("remaining", F.lit(20000).cast("bigint"))
    s = submissions(fx).filter("event_type = 'purchase'").select(F.lit("C1").alias("company_id"), "po_number", "ts", "document_id", "amount")
    return st.po_balance(s, balances, st.work_dir(fx.spark, "st3")).select("document_id", "accepted", "remaining")


_QUEUE = "CASE event_type WHEN 'error' THEN 'security-fraud-queue' ELSE 'ap-exception-queue' END"


@query("st4_stream_due_items", f"""SELECT floor(epoch(ts + to_hours(CASE event_type WHEN 'error' THEN 4 ELSE 48 END)) / 86400)::BIGINT * 86400 AS day, {_QUEUE} AS queue, count(*) AS due
  FROM v_submissions WHERE event_type <> 'view' GROUP BY 1, 2""")
def st4_due(fx):
    s = submissions(fx).filter("event_type <> 'view'").withColumn("queue", F.expr(_QUEUE))
    hours = F.when(F.col("queue") == "security-fraud-queue", 4).otherwise(48)
    return st.update_results(st.due_items(s, hours), st.work_dir(fx.spark, "st4"), ["day", "queue"])


# a view completes the work item that the event with the number before it opened
CTES["q_items"] = f"""SELECT 'W' || event_id AS item, {_QUEUE} AS queue, floor(epoch(ts))::BIGINT + CASE event_type WHEN 'error' THEN 4 ELSE 48 END * 3600 AS due_at, event_id FROM v_submissions WHERE event_type <> 'view'"""


@query("st4_stream_sla_breaches", """SELECT item, queue, due_at FROM q_items i LEFT JOIN (SELECT event_id - 1 AS closes, floor(epoch(ts))::BIGINT AS done_at FROM v_submissions WHERE event_type = 'view') v ON v.closes = i.event_id
  WHERE NOT coalesce(done_at <= due_at, false) AND due_at <= (SELECT floor(epoch(max(ts)))::BIGINT - 172800 FROM v_submissions)""")
def st4(fx):
    s = submissions(fx).selectExpr("concat('W', case when event_type = 'view' then event_id - 1 else event_id end) as item", "ts", "event_type <> 'view' as opened", f"{_QUEUE} as queue",
                                   "case event_type when 'error' then 4 else 48 end as hours")
    return st.sla_breaches(s, st.work_dir(fx.spark, "breaches"))


@query("st5_stream_ledger_append", """SELECT row_number() OVER (ORDER BY ts, document_id) AS ledger_sequence, document_id AS event_id, sha256(h) AS content_hash,
    coalesce(sha256(lag(h) OVER (ORDER BY ts, document_id)), 'GENESIS') AS previous_hash FROM (SELECT *, document_id || ':' || amount AS h FROM v_submissions)""")
def st5(fx):
    s = submissions(fx).selectExpr("document_id as event_id", "ts", "concat(document_id, ':', amount) as content")
    return st.ledger_appends(s, st.work_dir(fx.spark, "st5")).select("ledger_sequence", "event_id", "content_hash", "previous_hash")


@query("st6_stream_run_stats", "SELECT floor(epoch(ts) / 86400)::BIGINT * 86400 AS day, event_type AS status, count(*) AS n, sum(amount)::BIGINT AS cents FROM v_submissions GROUP BY 1, 2")
def st6(fx):
    s = submissions(fx).select("ts", F.col("event_type").alias("status"), F.col("amount").alias("cents"))
    return st.update_results(st.daily_stats(s), st.work_dir(fx.spark, "st6"), ["day", "status"])
