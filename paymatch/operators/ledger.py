"""The hash-chained audit ledger (E5, E6) and gap-free numbering at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paymatch.plans.runtime import stage

GENESIS = "GENESIS"


def number_rows(df: DataFrame, order: list[str], start: int = 0, partitions: int | None = None, trail: str | None = None) -> DataFrame:
    """Adds `seq` = start + 1, start + 2 ... in `order`, without sorting everything in one task.

    With `trail`, the last column of an ascending `order`, `previous` is that column's value in the row before (NULL in the first).

    Rows are range-partitioned and written out, which fixes their partition once and for all.  Rank inside the
    partition plus the number of rows before it gives the position; only one count per partition is summed up.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    w = W.partitionBy("_p").orderBy(*order)
    inside = placed.withColumn("_r", F.row_number().over(w))
    counts, total = [F.count(F.lit(1)).alias("_n")], W.orderBy("_p")
    if trail:
        # rows that tie have the same value in `trail`, the last column of the order, so either way of finding the last one agrees
        inside = inside.withColumn("previous", F.lag(trail).over(w))
        counts.append(F.max(F.struct(*order)).alias("_l"))
    counts = placed.groupBy("_p").agg(*counts)
    # one row per partition: the running total over them is a small job by construction
    before = counts.select("_p", (F.sum("_n").over(total.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_b"),
                           *([F.lag(F.col("_l")[trail]).over(total).alias("_s")] if trail else []))
    x = inside.join(before, "_p")
    if trail:
        x = x.withColumn("previous", F.when(F.col("_r") > 1, F.col("previous")).otherwise(F.col("_s"))).drop("_s")
    return x.withColumn("seq", F.lit(start).cast("bigint") + F.col("_b") + F.col("_r")).drop("_p", "_r", "_b")


def append_ledger(events: DataFrame, last_sequence: int = 0, last_hash: str = GENESIS) -> DataFrame:
    """E5.  (created_at, event_id, content ...) to ledger rows; each row names the content hash before it."""
    x = number_rows(events.withColumn("content_hash", F.sha2("content", 256)), ["created_at", "event_id", "content_hash"], last_sequence, trail="content_hash")
    return x.withColumnsRenamed({"seq": "ledger_sequence", "previous": "previous_hash"}).withColumn(
        "previous_hash", F.coalesce("previous_hash", F.lit(last_hash)))


BUCKET = 1 << 20


def verify_ledger(ledger: DataFrame, start_hash: str = GENESIS, bucket: int = BUCKET) -> DataFrame:
    """E6.  One row per breach: PREV_HASH_MISMATCH, SEQUENCE_GAP, CONTENT_HASH_MISMATCH (where content is kept).

    Sequence numbers are unique, so a bucket of them has a bounded size whatever the data; the last entry of
    each bucket is handed to the next one through a table of one row per bucket.
    """
    # contents are checked where they lie; only numbers and hashes cross the network
    bad = F.col("content").isNotNull() & (F.sha2("content", 256) != F.col("content_hash")) if "content" in ledger.columns else F.lit(False)
    x = ledger.select("ledger_sequence", "previous_hash", "content_hash", bad.alias("_bad"), F.floor(F.col("ledger_sequence") / bucket).alias("_b"))
    w = W.partitionBy("_b").orderBy("ledger_sequence")
    x = x.withColumns({"_ps": F.lag("ledger_sequence").over(w), "_ph": F.lag("content_hash").over(w)})
    last = ledger.withColumn("_b", F.floor(F.col("ledger_sequence") / bucket)).groupBy("_b").agg(
        F.max(F.struct("ledger_sequence", "content_hash")).alias("l"))
    seams = last.select("_b", F.lag("l").over(W.orderBy("_b")).alias("_l"))
    x = x.join(seams, "_b", "left").withColumns({
        "prev_seq": F.coalesce("_ps", F.col("_l.ledger_sequence")),
        "prev_hash": F.when(F.col("_ps").isNotNull(), F.col("_ph")).otherwise(F.coalesce(F.col("_l.content_hash"), F.lit(start_hash)))})
    kinds = [F.when(F.col("previous_hash") != F.col("prev_hash"), F.lit("PREV_HASH_MISMATCH")),
             F.when(F.col("ledger_sequence") != F.col("prev_seq") + 1, F.lit("SEQUENCE_GAP")),
             F.when(F.col("_bad"), F.lit("CONTENT_HASH_MISMATCH"))]
    return x.select("ledger_sequence", "prev_seq", F.explode(F.array_compact(F.array(*kinds))).alias("breach"))


def ledger_status(ledger: DataFrame, breaches: DataFrame) -> DataFrame:
    """INTACT, BREACH or EMPTY with the checked range."""
    a = ledger.agg(F.count(F.lit(1)).alias("records_checked"), F.min("ledger_sequence").alias("first_sequence"), F.max("ledger_sequence").alias("last_sequence"))
    n = breaches.select(F.count(F.lit(1))).scalar()
    return a.withColumn("breaches", n).withColumn("status", F.when(F.col("records_checked") == 0, "EMPTY").when(F.col("breaches") > 0, "BREACH").otherwise("INTACT"))
