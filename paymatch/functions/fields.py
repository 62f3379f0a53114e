"""Predicates over extracted fields and stored orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.functions.expr import col, flags, true
from paymatch.functions.text import po_key
from paymatch.operators.similar import containment_pairs
from paymatch.policy import HEADER_PO_PLACEHOLDERS


def source_fingerprint(catalog: DataFrame) -> DataFrame:
    """B16. One fingerprint per source from its column catalog `(source_id, sheet, position, column_name)`."""
    sheet = catalog.groupBy("source_id", "sheet").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "column_name"))),
        lambda c: F.lower(F.trim(c["column_name"]))), "|").alias("cols"))
    parts = sheet.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws(":", "sheet", "cols"))), "\n").alias("text"))
    return parts.select("source_id", F.substring(F.sha2("text", 256), 1, 16).alias("fingerprint"))


def confidence_gate(po_value="po_value", po_conf="po_conf", po_status="po_status") -> Column:
    """B17."""
    return (F.when(col(po_value).isNull() | (col(po_status) == "not_found"), "expand")
            .when(col(po_status) == "uncertain", "validate")
            .when(col(po_conf) >= 0.90, "trust").when(col(po_conf) >= 0.70, "validate").otherwise("expand"))


def po_presence(po_value="po_value", po_status="po_status") -> Column:
    """B18."""
    s = F.trim(col(po_value))
    absent = (col(po_value).isNull() | (col(po_status) == "not_found") | (s == "")
              | F.lower(s).isin(*HEADER_PO_PLACEHOLDERS))
    return F.when(absent, "non_po").otherwise("po_invoice")


def po_validity_flags(as_of, status="status", expiry="expiry_date") -> Column:
    """B19. Flags only; an invalid order is still scored."""
    s = F.coalesce(col(status), F.lit("unknown"))
    return flags(
        ("expired_po", (s == "open") & (col(expiry) < F.lit(as_of).cast("date"))),
        ("closed_po", s.isin("closed", "closed_for_invoicing")),
        ("review_required", s.isin("closed", "closed_for_invoicing")),
        ("cancelled_po", s == "cancelled"), ("escalation_required", s == "cancelled"),
        ("unknown_status", ~s.isin("open", "closed", "closed_for_invoicing", "cancelled")))


def suggestion_mode(po_value="po_value", po_conf="po_conf", po_status="po_status") -> Column:
    """B20. True unless the document itself carries a trusted PO number."""
    trusted = (F.coalesce(col(po_value), F.lit("")) != "") & (col(po_conf) >= 0.85) & col(po_status).isin(
        "extracted", "inferred")
    return ~true(trusted)


def effective_references(refs: Column, po_value="po_value", po_conf="po_conf") -> Column:
    """B21. ARRAY<STRUCT<type, value, confidence>> to the references worth looking up."""
    kept = F.transform(F.filter(refs, lambda r: (F.coalesce(r["value"], F.lit("")) != "") & (r["confidence"] >= 0.5)),
                       lambda r: F.struct(r["type"].alias("type"), r["value"].alias("value")))
    usable = (F.coalesce(col(po_value), F.lit("")) != "") & (col(po_conf) >= 0.7)
    missing = ~F.exists(kept, lambda r: r["value"] == col(po_value))
    own = F.array(F.struct(F.lit("order_ref").alias("type"), col(po_value).alias("value")))
    return F.when(usable & missing, F.concat(kept, own)).otherwise(kept)


def reference_key(value) -> Column:
    return po_key(value)


def json_safe(x) -> Column:
    """B23. NaN and infinities become NULL before JSON."""
    c = col(x)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def vendor_thresholds(invoices: DataFrame, profiles: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """B24. Profile by vendor id, else by alias containment either way; overrides laid over the defaults."""
    by_id = profiles.select("vendor_id", F.col("vendor_id").alias("_id"), F.col("overrides").alias("_o1"))
    names = invoices.select(F.lower(F.trim("vendor_name")).alias("_n")).filter("_n <> ''")
    forms = profiles.select(F.col("vendor_id").alias("_pid"), "overrides", F.explode(F.transform(
        F.concat(F.array("vendor_id"), "aliases"), F.lower)).alias("_a")).filter("_a <> ''")
    by_name = containment_pairs(names, forms, [], "_n", "_a").join(forms, "_a").groupBy("_n").agg(
        F.min("_pid").alias("_nid"), F.min_by("overrides", "_pid").alias("_o2"))
    x = invoices.withColumn("_n", F.lower(F.trim("vendor_name"))).join(by_id, "vendor_id", "left").join(by_name, "_n", "left")
    over = F.coalesce("_o1", "_o2")
    return x.select(*invoices.columns, F.coalesce("_id", "_nid").alias("profile_id"), *[
        F.coalesce(over[field], F.lit(value)).alias(f"threshold_{field}") for field, value in defaults.items()])
