"""Reading and writing the master and stage tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paymatch.functions.text import header_key

KEYS = {
    "vendors": ["vendor_id"], "purchase_orders": ["company_id", "po_number"], "po_lines": ["company_id", "po_number", "line_number"],
    "grn_records": ["grn_id"], "po_references": ["company_id", "reference_type", "normalized_value"],
    "source_records": ["company_id", "invoice_number", "vendor_name"], "mapping_profiles": ["company_id", "source_fingerprint"],
    "match_results": ["document_id"],
}


def read_master_table(spark: SparkSession, path: str, schema=None, company_id: str | None = None) -> DataFrame:
    """A1.  Parquet, or CSV with a given schema; the tenant filter reaches the scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.option("header", True).csv(path) if path.endswith(".csv") else reader.parquet(path)
    return df if company_id is None else df.filter(F.col("company_id") == company_id)


def read_import_files(spark: SparkSession, path: str, **csv_options: str) -> DataFrame:
    """A2.  A folder of CSV files to (file_name, raw) rows; all values stay text.

    Every file has its own header: names, order and number of columns may differ from file to file.  Headers become
    snake case; a name that repeats in a header gets its place as a suffix, and an empty one is named by its place.  A row with too few values
    lacks the keys of the rest, further values are kept under column_<place>; blank lines are left out.  Rows end at line ends.

    The first line of a file's first split is its header; headers are a small table that is joined to the lines by file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"),
                                         F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = lines.filter(F.trim("value") != "")
    headers = lines.filter("split = 0").groupBy("file").agg(F.min(F.struct("line", "value")).alias("h")).select("file", F.col("h.line").alias("first"), F.col("h.value").alias("header"))
    n = lines.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1  # at least as many as values, whatever is quoted
    fields = lambda c: F.array(*[F.from_csv(c, F.lit(", ".join(f"c{i} string" for i in range(n))), dict(csv_options))[f"c{i}"] for i in range(n)])
    keys = F.transform(fields(F.col("header")), lambda h, i: F.coalesce(F.nullif(header_key(F.trim(h)), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))
    headers = headers.select("file", "first", keys.alias("k0")).select("file", "first", F.transform("k0", lambda k, i: F.when(
        F.array_position("k0", k) == i + 1, k).otherwise(F.concat(k, F.lit("__"), (i + 1).cast("string")))).alias("keys"))
    rows = lines.join(headers, "file").filter("line <> first").withColumn("values", fields(F.col("value")))
    pairs = F.filter(F.arrays_zip(F.col("keys").alias("k"), F.col("values").alias("v")), lambda e: e["v"].isNotNull())
    return rows.select("file_name", F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["k"], e["v"]))).alias("raw"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """A2.  SHA-256 of every file of an upload folder."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.sha2("content", 256).alias("checksum"))


def upsert_by_key(base: DataFrame, incoming: DataFrame, keys: list[str], order: str, keep: tuple = ()) -> DataFrame:
    """A7.  Incoming rows replace base rows of the same key; among incoming ones the last by `order` wins.

    `keep` columns survive from the replaced row (a record keeps its id and creation time).
    """
    cols = [c for c in base.columns]
    last = incoming.groupBy(*keys).agg(F.max(F.struct(order, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols) if c not in keys])).alias("r"))
    new = last.select(*keys, *[F.col(f"r._c{i}").alias(c) for i, c in enumerate(cols) if c not in keys])
    if keep:
        # NULL keys never match, as in a unique index
        old = base.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
        new = new.join(old, keys, "left")
        for c in keep:
            new = new.withColumn(c, F.coalesce(f"_old_{c}", c))
    return base.join(new.select(*keys), keys, "left_anti").select(*cols).unionByName(new.select(*cols))


def insert_if_absent(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """A8.  Append the rows whose key is new; repeating the call adds nothing."""
    return base.unionByName(incoming.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti").select(*base.columns))


def stage_batch_replace(rows: DataFrame, path: str) -> None:
    """A9.  A re-upload of the same file replaces its earlier rows: partitions (company_id, checksum) are overwritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("company_id", "checksum").parquet(path)


def tenant_purge(tables: dict[str, DataFrame], company_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """A10.  The tables without one company, and what remains in each."""
    left = {n: t.filter(F.col("company_id") != company_id) for n, t in tables.items()}
    return left, reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("remaining")) for n, t in left.items()])


def append_history(rows: DataFrame, path: str, day: str = "run_date") -> None:
    """A11.  Append-only stage outputs, partitioned by day."""
    rows.write.mode("append").partitionBy(day).parquet(path)


def latest_per_key(history: DataFrame, keys: list[str], order: list) -> DataFrame:
    """W3.  Newest row per key when whole rows are wanted."""
    return history.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
