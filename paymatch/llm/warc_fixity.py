"""WARC fixity (operator 5): Merkle trees over records and ordered offset ranges; replicas are compared from the roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paymatch.plans.runtime import stage

FAN = 16  # children of a node by record number
LEVELS = ("archive", "section", "block")  # ranges of FAN**3, FAN**2 and FAN record numbers


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """One response record as text; its length is that of the text in UTF-8."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
                    F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """Rows (archive, section, block, page_id, copy, offset, length, digest): one for each record, in the order of an archive.

    Records lie in an archive by number, those of one number by digest; without a number they are spread over archives -1 to
    -64.  `copy` counts records of one number from 0.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select("page_id", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    spread = -1 - F.pmod(F.xxhash64("digest"), F.lit(64))
    number = lambda size: F.coalesce(F.floor(F.col("page_id") / F.lit(size)), spread).cast("long")
    rows = rows.withColumns({"archive": number(FAN**3), "section": number(FAN**2), "block": number(FAN)})
    order = Window.partitionBy("archive").orderBy("page_id", "digest")
    return (rows.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
            .withColumn("copy", F.row_number().over(Window.partitionBy("archive", "page_id").orderBy("digest", "offset")) - 1))


def tree(records: DataFrame) -> dict[str, DataFrame]:
    """Nodes of each level: (level columns, start, end, node), each node the digest of its children in order and their number.

    `start` and `end` are the range of offsets below the node.
    """
    out, below = {}, records.select(*LEVELS, F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), F.col("digest").alias("node"))
    for i in range(len(LEVELS), 0, -1):
        ordered = F.array_sort(F.collect_list(F.struct("start", "node")))
        below = (below.groupBy(*LEVELS[:i]).agg(F.min("start").alias("start"), F.max("end").alias("end"), ordered.alias("_below"))
                 .withColumn("node", F.sha2(F.concat_ws(",", F.size("_below").cast("string"), F.array_join(F.transform("_below", lambda x: x["node"]), ",")), 256))
                 .drop("_below"))
        out[LEVELS[i - 1]] = below
    return out


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Rows (archive, page_id, copy, status, offset, length, digest, replica_length, replica_digest, ranges) of damaged records.

    Both tables have (page_id, url, html); other columns are ignored.  `status` is changed, missing (from the replica) or
    extra; offset is the record's place in the archive of `pages`, null for an extra one; `ranges` lists the offset ranges of the
    nodes passed on the way down.  Equal tables, empty ones included, give no rows.  Null pages and urls are empty; repeated
    rows are records each, told apart by `copy`; null page_ids are compared by digest.

    Only the roots of all archives are compared; each further level is compared below nodes that differ.
    """
    ours, theirs = stage(leaves(pages)), stage(leaves(replica))
    mine, other = tree(ours), tree(theirs)
    open_ = None
    for i, level in enumerate(LEVELS):
        key = list(LEVELS[:i + 1])
        a, b = mine[level], other[level]
        if open_ is not None:
            a, b = a.join(open_.select(*key[:-1]), key[:-1], "left_semi"), b.join(open_.select(*key[:-1]), key[:-1], "left_semi")
        a, b = a.select(*key, F.concat_ws("-", "start", "end").alias("range"), "node"), b.select(*key, F.col("node").alias("other"))
        differ = a.join(b, key, "full_outer").where(~F.col("node").eqNullSafe(F.col("other"))).select(*key, "range")
        if open_ is not None:
            differ = differ.join(open_.select(*key[:-1], "ranges"), key[:-1]).withColumn("ranges", F.concat_ws("/", "ranges", "range"))
        else:
            differ = differ.withColumn("ranges", F.coalesce("range", F.lit("")))
        open_ = stage(differ.select(*key, "ranges"))
    key = [*LEVELS, "page_id", "copy"]
    a = ours.join(open_.select(*LEVELS), list(LEVELS), "left_semi").select(*key, "offset", "length", "digest")
    b = theirs.join(open_.select(*LEVELS), list(LEVELS), "left_semi").select(*(F.col(c).alias(f"_{c}") for c in key), F.col("length").alias("replica_length"),
                                                                         F.col("digest").alias("replica_digest"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = a.join(b, same, "full_outer").where(~F.col("digest").eqNullSafe(F.col("replica_digest")))
    both = both.select(*(F.coalesce(c, f"_{c}").alias(c) for c in key), "offset", "length", "digest", "replica_length", "replica_digest")
    return both.join(open_, list(LEVELS)).select(
        "archive", "page_id", "copy", F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed").alias("status"),
        "offset", "length", "digest", "replica_length", "replica_digest", "ranges")


def damaged(pages: DataFrame) -> DataFrame:
    """A second copy of an archive with faults at fixed page numbers: a changed character, a lost tail, lost and added records."""
    n = F.length("html")
    flipped = F.concat(F.substring(F.col("html"), F.lit(1), F.floor(n / 2).cast("int")), F.lit("\u0001"), F.substring(F.col("html"), F.floor(n / 2).cast("int") + 2, n))
    body = (F.when(F.col("page_id") % 97 == 7, flipped).when(F.col("page_id") % 193 == 11, F.substring(F.col("html"), F.lit(1), n - 1)).otherwise(F.col("html")))
    kept = pages.select("page_id", "url", body.alias("html")).where("page_id is null or page_id % 389 <> 13")
    return kept.unionByName(pages.where("page_id % 401 = 17").select((-F.col("page_id") - 1).alias("page_id"), "url", "html"))
