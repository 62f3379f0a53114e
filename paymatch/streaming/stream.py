"""Streaming forms of the order-dependent steps (ST1-ST6).

Sources and sinks are file streams and parquet folders under the shared folder.  Every sink writes one partition
per micro-batch and overwrites it on replay, so a batch that runs twice leaves one result.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from paymatch.operators.ledger import GENESIS, append_ledger
from paymatch.plans.runtime import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/paymatch-stream/{name}-{uuid.uuid4().hex}"


def read_submissions(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder that files keep arriving in, one file per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_batches(stream: DataFrame, handle, root: str, mode: str = "append") -> None:
    """Drive `handle(batch, batch_id)` over all files that are there."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(handle).start()
    q.awaitTermination()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def latest(spark: SparkSession, path: str, schema, batch_id: int) -> DataFrame:
    """What the batch just before this one left behind."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id - 1}")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dedupe_submissions(stream: DataFrame, key: str = "document_id", ts: str = "ts", delay: str = "2 days") -> DataFrame:
    """ST1.  A repeated delivery inside the watermark is skipped; the state forgets older keys."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def route_late(stream: DataFrame, root: str, ts: str = "ts", delay_seconds: int = 172800) -> DataFrame:
    """Rows older than the watermark of the batches before them, kept for the batch re-run.

    Each batch leaves the largest time so far, one row, for the next.
    """
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        mark = latest(spark, f"{root}/seen", "m timestamp", batch_id)
        write_batch(batch.agg(F.max(ts).cast("timestamp").alias("m")).union(mark).agg(F.max("m").alias("m")), f"{root}/seen", batch_id)
        late = batch.filter(F.unix_timestamp(ts) < F.unix_timestamp(mark.scalar()) - delay_seconds)
        write_batch(late, f"{root}/late", batch_id)

    run_batches(stream, handle, root)
    return read_back(spark, f"{root}/late")


def _mark_repeats(key, frames, state):
    """Rows of one key in arrival order; whether the key was seen before is the state."""
    pdf = pd.concat(list(frames)).sort_values(["ts", "document_id"])
    repeat = np.ones(len(pdf), bool)
    repeat[0] = state.exists
    state.update((True,))
    yield pd.DataFrame({"document_id": pdf["document_id"].to_numpy(), "duplicate": repeat})


def duplicate_guard(stream: DataFrame, root: str, keys: list[str]) -> DataFrame:
    """ST2.  Marks a submission whose key was submitted before, in arrival order (`ts`, `document_id`).

    The state store keeps one flag a key; a batch reads the state of its own keys only.
    """
    marked = stream.select(*keys, "ts", "document_id").groupBy(*keys).applyInPandasWithState(
        _mark_repeats, "document_id string, duplicate boolean", "seen boolean", "append", GroupStateTimeout.NoTimeout)
    run_batches(marked, lambda b, i: write_batch(b, f"{root}/out", i), root)
    return read_back(stream.sparkSession, f"{root}/out").drop("batch_id")


#: The tests of a submission against earlier ones of its vendor: key columns, and whether dates must lie close together.
#: `same` counts what `near` must leave out, because there the number is equal.
TESTS = {"exact": (("number", "amount"), False), "number": (("number",), False), "near": (("amount",), True), "same": (("amount", "number"), True)}
_DAY_MS = 86_400_000


def _earlier(band: int, lag: int):
    """Counts the earlier submissions of one key, in arrival order, those of dated tests within `band` days only.

    The state maps days to counts (undated tests use one entry).  A timer drops the days that no later submission can come
    near to any more: more than `band` + `lag` days before the watermark.
    """
    def run(key, frames, state):
        dated = TESTS[key[0]][1]
        seen = dict(zip(*state.get)) if state.exists else {}
        if state.hasTimedOut:
            first = state.getCurrentWatermarkMs() // _DAY_MS - band - lag
            seen = {day: n for day, n in seen.items() if day >= first}
        else:
            pdf = pd.concat(list(frames)).sort_values(["ts", "document_id"])
            counts = []
            for day in pdf["day"].tolist():
                counts.append(sum(seen.get(d, 0) for d in range(day - band, day + band + 1)) if dated else seen.get(day, 0))
                seen[day] = seen.get(day, 0) + 1
            yield pd.DataFrame({"document_id": pdf["document_id"].to_numpy(), "test": key[0], "n": counts})
        if not seen:
            state.remove()
            return
        state.update((list(seen), list(seen.values())))
        if dated:
            state.setTimeoutTimestamp(max((min(seen) + band + lag + 1) * _DAY_MS, state.getCurrentWatermarkMs() + 1))

    return run


def three_duplicate_tests(stream: DataFrame, root: str, band: int = 3, lag: int = 0, delay: str = "2 days") -> DataFrame:
    """ST2.  The three tests of V5 in arrival order: (document_id, n_exact, n_number, n_near, status).

    `stream`: (document_id, ts, vendor, number, amount, invoice_date).  A submission is compared with those that arrived
    before it: equal number and amount, equal number and another amount, equal amount with another number and a date at most
    `band` days away.  Each test counts under its own key, so a vendor with very many submissions is no single key, and each
    key's state is a few counters; `lag` says by how many days an invoice's date may lie before its submission.
    Submissions without a vendor, number, amount or date skip the tests that need it.
    """
    day = F.datediff("invoice_date", F.lit("1970-01-01").cast("date"))
    rows = [F.struct(F.lit(name).alias("test"), F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("key"),
                     (day if dated else F.lit(0)).alias("day"),
                     F.coalesce(*[F.when(F.col(k).isNull(), False) for k in (*keys, "vendor", *(("invoice_date",) if dated else ()))], F.lit(True)).alias("may"))
            for name, (keys, dated) in TESTS.items()]
    x = stream.withWatermark("ts", delay).withColumn("t", F.explode(F.array(*rows))).filter("t.may")
    counted = x.select("document_id", "ts", "vendor", "t.test", "t.key", "t.day").groupBy("test", "vendor", "key").applyInPandasWithState(
        _earlier(band, lag), "document_id string, test string, n bigint", "days array<int>, counts array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    run_batches(counted, lambda b, i: write_batch(b, f"{root}/out", i), root)
    n = {t: F.coalesce(F.max(F.when(F.col("test") == t, F.col("n"))), F.lit(0)) for t in TESTS}
    out = read_back(stream.sparkSession, f"{root}/out").groupBy("document_id").agg(
        n["exact"].alias("n_exact"), (n["number"] - n["exact"]).alias("n_number"), (n["near"] - n["same"]).alias("n_near"))
    return out.withColumn("status", F.when(F.col("n_exact") > 0, "FAIL").when((F.col("n_number") > 0) | (F.col("n_near") > 0), "FLAG").otherwise("PASS"))


def _consume(key, frames, state):
    """Requests of one order in arrival order; the balance left is the state."""
    pdf = pd.concat(list(frames)).sort_values(["ts", "document_id"])
    left = state.get[0] if state.exists else int(pdf["start"].iloc[0])
    accepted, rest = [], []
    for amount in pdf["amount"].tolist():
        accepted.append(amount <= left)
        left -= amount if amount <= left else 0
        rest.append(left)
    state.update((left,))
    yield pd.DataFrame({"company_id": key[0], "po_number": key[1], "document_id": pdf["document_id"].to_numpy(), "accepted": accepted, "remaining": rest})


def po_balance(stream: DataFrame, balances: DataFrame, root: str) -> DataFrame:
    """ST3.  Approve and consume in arrival order; the state store keeps each order's balance, per company."""
    key = ["company_id", "po_number"]
    start = balances.select(*key, F.col("remaining").cast("long").alias("start"))
    done = stream.select(*key, "ts", "document_id", "amount").join(start, key).groupBy(*key).applyInPandasWithState(
        _consume, "company_id string, po_number string, document_id string, accepted boolean, remaining bigint", "remaining bigint", "append",
        GroupStateTimeout.NoTimeout)
    run_batches(done, lambda b, i: write_batch(b, f"{root}/out", i), root)
    return read_back(stream.sparkSession, f"{root}/out").drop("batch_id")


def update_results(stream: DataFrame, root: str, keys: list[str]) -> DataFrame:
    """Run an aggregation in update mode; the newest value per key is its result."""
    values = [c for c in stream.columns if c not in keys]
    run_batches(stream, lambda b, i: write_batch(b, f"{root}/out", i), root, "update")
    x = read_back(stream.sparkSession, f"{root}/out")
    return x.groupBy(*keys).agg(F.max(F.struct("batch_id", *values)).alias("v")).select(*keys, *[f"v.{c}" for c in values])


def due_items(stream: DataFrame, hours, delay: str = "2 days") -> DataFrame:
    """Items falling due per day and queue."""
    due = stream.withColumn("due_at", F.col("ts") + F.make_dt_interval(hours=hours)).withWatermark("due_at", delay)
    return due.groupBy(F.window("due_at", "1 day").alias("w"), "queue").agg(F.count(F.lit(1)).alias("due")).select(
        F.unix_timestamp("w.start").alias("day"), "queue", "due")


def _breach(longest: int):
    """One work item: opened with a due time, closed by a completion, or open when the watermark passes the due time.

    The state is (due time, queue, time of the first completion); -1 stands for what is not known yet.
    """
    def run(key, frames, state):
        due, queue, closed = state.get if state.exists else (-1, "", -1)
        if state.hasTimedOut:
            state.remove()
            if due >= 0:
                yield pd.DataFrame({"item": [key[0]], "queue": [queue], "due_at": [due]})
            return
        for pdf in frames:
            for at, opened, name, hours in zip(pdf["at"].tolist(), pdf["opened"].tolist(), pdf["queue"].tolist(), pdf["hours"].tolist()):
                if opened:
                    due, queue = at + int(hours) * 3600, name
                else:
                    closed = at if closed < 0 else min(at, closed)
        mark = state.getCurrentWatermarkMs()
        if due >= 0 and 0 <= closed <= due:
            state.remove()  # done in time: the timer goes with the state
            return
        state.update((due, queue, closed))
        state.setTimeoutTimestamp(max(1000 * (due if due >= 0 else closed + longest), mark + 1))

    return run


def sla_breaches(stream: DataFrame, root: str, longest_hours: int = 24 * 30, delay: str = "2 days") -> DataFrame:
    """ST4.  Items that are open at their due time: (item, queue, due_at in seconds), once the watermark has passed it.

    `stream`: (item, ts, opened, queue, hours); a row without `opened` completes its item.  A timer in event time waits
    for the due time of each open item, and a completion up to then cancels it.  A completion that comes before its opening is
    remembered for `longest_hours`.
    """
    x = stream.withWatermark("ts", delay).select("item", "ts", F.unix_timestamp("ts").alias("at"), "opened", "queue", "hours").groupBy("item").applyInPandasWithState(
        _breach(longest_hours * 3600), "item string, queue string, due_at bigint", "due bigint, queue string, closed bigint", "append", GroupStateTimeout.EventTimeTimeout)
    run_batches(x, lambda b, i: write_batch(b, f"{root}/out", i), root)
    return read_back(stream.sparkSession, f"{root}/out").drop("batch_id")


def ledger_appends(stream: DataFrame, root: str) -> DataFrame:
    """ST5.  One ordered append per micro-batch; each batch leaves the end of the chain, one row, for the next."""
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        tail = latest(spark, f"{root}/tail", "ledger_sequence bigint, content_hash string", batch_id)
        last = tail.first()
        rows = append_ledger(batch.withColumnRenamed("ts", "created_at"), *(last or (0, GENESIS)))
        write_batch(rows.select("ledger_sequence", "content_hash", "previous_hash", "event_id"), f"{root}/out", batch_id)
        written = spark.read.parquet(f"{root}/out/batch_id={batch_id}").select("ledger_sequence", "content_hash")
        write_batch(written.union(tail).agg(F.max(F.struct("ledger_sequence", "content_hash")).alias("l")).where("l is not null").select("l.*"), f"{root}/tail", batch_id)

    run_batches(stream, handle, root)
    return read_back(spark, f"{root}/out").drop("batch_id")


def daily_stats(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """ST6.  Runs per day and status with the summed amount."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).select(F.unix_timestamp("w.start").alias("day"), "status", "n", "cents")
