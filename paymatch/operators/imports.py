"""Master-data import over tables of raw rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paymatch import import_policy as ip
from paymatch.functions.expr import lookup, true
from paymatch.functions.similarity import sequence_ratio
from paymatch.functions.text import header_key, po_key, safe_float, safe_str, valid_po_number, vendor_key
from paymatch.operators.ledger import number_rows
from paymatch.operators.similar import grams, overlap_pairs, tagged
from paymatch.plans.runtime import stage
from paymatch.policy import ROW_PO_PLACEHOLDERS


# --- I1-I3, I12, I13: columns -----------------------------------------------------------------------
def infer_entity(catalog: DataFrame) -> DataFrame:
    """I1.  (source_id, sheet, column_name) to one entity per sheet: name hint, longer hint inside the name, then
    the entity with the most known fields."""
    x = catalog.groupBy("source_id", "sheet").agg(F.collect_set(header_key("column_name")).alias("cols"))
    sheet = F.col("sheet")
    exact = F.coalesce(*[F.when(sheet.isin(*names), F.lit(e)) for e, names in ip.SHEET_HINTS.items()])
    inside = F.coalesce(*[F.when(_any([F.contains(sheet, F.lit(h)) for h in names if len(h) >= 4]), F.lit(e)) for e, names in ip.SHEET_HINTS.items()])
    hits = F.array(*[F.struct(_sum([F.arrays_overlap("cols", F.array(*[F.lit(a) for a in names])).cast("int") for names in fields.values()]).alias("n"),
                              F.lit(-i).alias("o"), F.lit(e).alias("e")) for i, (e, fields) in enumerate(ip.FIELDS.items())])
    best = F.array_max(hits)
    return x.select("source_id", "sheet", F.coalesce(exact, inside, F.when(best["n"] > 0, best["e"]), F.lit("unknown")).alias("entity"))


def _any(conds) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def _sum(cols) -> Column:
    out = F.lit(0)
    for c in cols:
        out = out + c
    return out


def flat_entity(record_type) -> Column:
    """I1 for flat files: the row's own type."""
    return lookup(header_key(record_type), {t: e for e, types in ip.FLAT_TYPES.items() for t in types}, None)


def profile_rows(rows: DataFrame, header: list[str] | None = None) -> DataFrame:
    """I2.  Row count, columns and the first three rows per entity of a flat file (`raw` map, `row_id`).

    The columns are the file's header where it is given, as a column may be empty, else those that hold anything.
    """
    x = rows.withColumn("entity", F.coalesce(flat_entity(F.col("raw")["record_type"]), F.lit("unknown")))
    counts = x.groupBy("entity").agg(F.count(F.lit(1)).alias("row_count"), F.min("row_id").alias("first_row"))
    leading = x.withColumn("_r", F.row_number().over(W.partitionBy("entity").orderBy("row_id"))).filter("_r <= 3")
    samples = leading.groupBy("entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_id", F.map_entries("raw").alias("raw")))),
                                                        lambda r: F.map_from_entries(r["raw"])).alias("sample_rows"))
    if header is not None:
        return counts.withColumn("columns", F.lit(",".join(sorted(header)))).join(samples, "entity")
    used = x.select("entity", F.explode(F.map_keys(F.map_filter("raw", lambda k, v: v.isNotNull()))).alias("c")).groupBy("entity").agg(
        F.array_join(F.array_sort(F.collect_set("c")), ",").alias("columns"))
    return counts.join(used, "entity").join(samples, "entity")


def propose_mappings(catalog: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """I3.  (source_id, entity, position, column_name) to one proposal per column.

    A fold in column order, because a canonical field is given away only once.  The array holds one file's columns.
    """
    def scores(fields: dict, norm: Column) -> Column:
        return F.array(*[F.struct(F.when(norm.isin(*names), 1.0).when(_any([F.contains(norm, F.lit(a)) | F.contains(F.lit(a), norm) for a in names]), 0.75)
                                  .otherwise(0.0).alias("s"), F.lit(-i).alias("o"), F.lit(f).alias("f")) for i, (f, names) in enumerate(fields.items())])

    # score every column against its entity's fields first, in generated code; the fold only picks
    x = catalog.withColumn("norm", header_key("column_name"))
    x = x.withColumn("opts", F.coalesce(*[F.when(F.col("entity") == e, scores(fields, F.col("norm"))) for e, fields in ip.FIELDS.items()]))
    x = x.withColumn("opts", F.filter("opts", lambda o: o["s"] >= ip.REVIEW_BELOW))
    x = x.groupBy("source_id", "entity").agg(F.array_sort(F.collect_list(F.struct("position", "column_name", "norm", "opts"))).alias("cols"))
    x = x.join(saved.select("source_id", "entity", "column_map"), ["source_id", "entity"], "left") if saved is not None else x.withColumn(
        "column_map", F.lit(None).cast("map<string,string>"))
    out_type = "array<struct<source_column:string,canonical_field:string,confidence:double,status:string>>"
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(out_type).alias("out"))

    def step(acc: Column, c: Column) -> Column:
        kept = F.col("column_map")[c["norm"]]
        best = F.array_max(F.filter(c["opts"], lambda o: ~F.array_contains(acc["used"], o["f"])))
        ok = best.isNotNull()
        field = F.when(kept.isNotNull(), kept).when(ok, best["f"])
        conf = F.when(kept.isNotNull(), 1.0).when(ok, best["s"]).otherwise(0.0)
        status = F.when(kept.isNotNull(), "profile").when(ok & (best["s"] >= ip.AUTO_ACCEPT), "auto").when(ok, "review").otherwise("metadata")
        row = F.struct(c["column_name"].alias("source_column"), field.alias("canonical_field"), conf.alias("confidence"), status.alias("status"))
        return F.struct(F.when(field.isNotNull(), F.array_append(acc["used"], field)).otherwise(acc["used"]).alias("used"), F.array_append(acc["out"], row).alias("out"))

    folded = F.aggregate("cols", start, step, lambda a: a["out"])
    return x.select("source_id", "entity", F.explode(folded).alias("p")).select("source_id", "entity", "p.*")


def unknown_columns(proposals: DataFrame) -> DataFrame:
    """I12."""
    return proposals.filter("status = 'metadata'").select("source_id", "entity", "source_column")


def mapping_profile(proposals: DataFrame) -> DataFrame:
    """I13.  Confirmed mappings as one reusable column map per source and entity.

    A header that a source has twice can be given two fields; the map, which holds a header once, has the surest of them, the first by
    name among equals, and `mappings` lists all.
    """
    x = proposals.filter("canonical_field is not null and status <> 'metadata'").select("source_id", "entity", header_key("source_column").alias("k"), "canonical_field", "confidence")
    x = x.groupBy("source_id", "entity", "k").agg(F.min(F.struct((-F.col("confidence")).alias("o"), F.col("canonical_field").alias("v")))["v"].alias("v"),
                                                  F.collect_set("canonical_field").alias("vs"))
    pairs = F.flatten(F.collect_list(F.transform("vs", lambda v: F.struct("k", v.alias("v")))))
    return x.groupBy("source_id", "entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("column_map"), F.array_sort(pairs).alias("mappings"))


def apply_mappings(rows: DataFrame, mapping: Column) -> DataFrame:
    """I4.  `raw` map and a column map to `canonical` and `metadata` maps; empty values are dropped."""
    there = F.map_filter("raw", lambda k, v: v.isNotNull())
    x = rows.withColumns({"_there": there, "_map": mapping})
    known = lambda k: F.coalesce(F.col("_map")[k], F.col("_map")[header_key(k)])
    return x.withColumns({
        "canonical": F.transform_keys(F.map_filter("_there", lambda k, v: known(k).isNotNull()), lambda k, v: known(k)),
        "metadata": F.map_filter("_there", lambda k, v: known(k).isNull())}).drop("_there", "_map")


# --- I5 ---------------------------------------------------------------------------------------------
_AMOUNTS = ("invoice_total", "invoice_subtotal", "total_amount")


def classify_rows(rows: DataFrame) -> DataFrame:
    """I5.  Adds record_type, class_confidence and po_reference from the headers a row fills."""
    aliases = ip.row_aliases()
    norm = rows.withColumn("_n", F.transform_keys(F.map_filter("raw", lambda k, v: safe_str(v) != ""), lambda k, v: header_key(k)))
    there = F.map_keys("_n")
    # one short expression a field: a lookup for each of the hundred aliases makes a method too long for the JVM to compile
    val = {c: F.col("_n")[F.get(F.array_intersect(F.array(*map(F.lit, names)), there), F.lit(0))] for c, names in aliases.items()}

    def has(*fields: str) -> Column:
        plain = sorted({a for f in fields if f not in _AMOUNTS for a in aliases.get(f, ())})
        filled = [true(F.arrays_overlap(there, F.array(*map(F.lit, plain))))] if plain else []
        return _any([safe_float(val[f]) > 0 for f in fields if f in _AMOUNTS and f in aliases] + filled)

    x = norm.withColumns({"_raw_po": F.coalesce(val["po_number"], val["po_reference"])})
    x = x.withColumn("_po", valid_po_number("_raw_po", ROW_PO_PLACEHOLDERS))
    kinds = {"vendor": "vendor", "po": "purchase_order", "line": "line", "grn": "grn", "reference": "reference", "invoice_transaction": "invoice_transaction"}
    x = x.withColumn("_type", header_key(F.col("raw")["record_type"]))
    explicit = F.coalesce(*[F.when(F.col("_type").isin(*types), F.lit(kinds[e])) for e, types in ip.FLAT_TYPES.items() if e in kinds])
    x = x.withColumns({
        "_explicit": explicit, "_inv": has("invoice_number", "secondary_id_number") & has("invoice_total", "invoice_subtotal", "invoice_date"),
        "_sup": has("total_amount", "issue_date", "status"), "_vid": has("vendor_id", "tax_id", "supplier_code"), "_vname": has("name", "vendor_name"),
        "_line": has("line_number"), "_grn": has("grn_id"), "_ref": has("reference_type", "reference_value")})
    po, inv, sup = F.col("_po").isNotNull(), F.col("_inv"), F.col("_sup")
    kind = lambda t, c: F.struct(F.lit(t).alias("t"), F.lit(c).alias("c"))
    cls = (F.when(F.col("_explicit").isNotNull(), F.struct(F.col("_explicit").alias("t"), F.lit(1.0).alias("c")))
           .when(F.col("_line") & po, kind("line", 0.85)).when(po & sup & ~inv, kind("purchase_order", 0.99))
           .when(inv & po, kind("invoice_with_po_reference", 0.94)).when(inv, kind("invoice_transaction", 0.92))
           .when(F.col("_grn"), kind("grn", 0.85)).when(F.col("_ref"), kind("reference", 0.85))
           .when(F.col("_raw_po").isNotNull() & ~po & (sup | F.col("_vname")), kind("purchase_order", 0.7))
           .when((F.col("_vid") | F.col("_vname")) & ~po, kind("vendor", 0.8)).otherwise(kind("unclassified", 0.0)))
    x = x.withColumn("_c", cls)
    return x.select(*rows.columns, F.col("_c.t").alias("record_type"), F.col("_c.c").alias("class_confidence"), F.col("_po").alias("po_reference"))


# --- I6, I7 -----------------------------------------------------------------------------------------
_ID = ("vendor_name", "supplier_code", "tax_id", "vendor_id")


def resolve_import_vendors(rows: DataFrame, vendors: DataFrame, fuzzy: bool = True, threshold: float = 0.88) -> DataFrame:
    """I6.  One row per distinct vendor identity: existing, ambiguous, safe_create or blocked.

    Rows repeat their vendor, so the work is done on distinct identities.  Fuzzy names are blocked by their rarest
    bigrams; equal ratios can only come from names that share a known number of bigrams.
    """
    x = rows.select("company_id", *[safe_str(c).alias(c) for c in _ID]).distinct().withColumn("key", vendor_key("vendor_name"))

    def by(column: str, key) -> DataFrame:
        v = vendors.select("company_id", key.alias(column), F.struct(F.col("vendor_id").alias("id"), F.col("name")).alias("v")).filter(F.coalesce(F.col(column), F.lit("")) != "")
        return v.groupBy("company_id", column).agg(F.max("v").alias(f"by_{column}"))

    for column, key in (("supplier_code", F.col("supplier_code")), ("tax_id", F.col("tax_id")), ("vendor_id", F.col("vendor_id")), ("key", F.col("normalized_name"))):
        x = x.join(by(column, key), ["company_id", column], "left")
    named = F.when(F.col("vendor_name") != "", F.col("by_key"))
    x = x.withColumn("hit", F.coalesce("by_supplier_code", "by_tax_id", "by_vendor_id", named))
    if fuzzy:
        left = x.filter("hit is null and vendor_name <> ''").select("company_id", F.col("key").alias("lk")).filter("length(lk) > 1")
        right = vendors.select("company_id", F.col("normalized_name").alias("rk"))
        half = threshold / 2
        m = lambda n, s: F.ceil((n + s + 2) * half).cast("int")  # noqa: E731 - matched characters for lengths n+1 and s+1
        need = lambda n, s: m(n, s) * 3 - (n + s + 2) - 1
        pairs = overlap_pairs(left, right, ["company_id"], "lk", "rk", lambda k: tagged(grams(k, 2)), need,
                              lambda n: F.greatest(F.ceil((n + 1) * (half / (1 - half))).cast("int") - 1, F.lit(1)), lambda n: F.floor((n + 1) * ((1 - half) / half)).cast("int"))
        close = pairs.withColumn("r", sequence_ratio("lk", "rk")).filter(F.col("r") >= threshold).join(
            vendors.select("company_id", F.col("normalized_name").alias("rk"), "vendor_id", "name"), ["company_id", "rk"])
        near = close.groupBy("company_id", F.col("lk").alias("key")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(F.col("vendor_id").alias("id"), "name")).alias("near"))
        x = x.join(near, ["company_id", "key"], "left")
    else:
        x = x.withColumns({"n_near": F.lit(None).cast("bigint"), "near": F.lit(None).cast("struct<id:string,name:string>")})
    open_ = F.col("hit").isNull() & (F.col("vendor_name") != "")
    one, many = open_ & true(F.col("n_near") == 1), open_ & true(F.col("n_near") > 1)
    status = (F.when(F.col("hit").isNotNull() | one, "existing").when(many, "ambiguous")
              .when((F.col("vendor_name") != "") | (F.col("vendor_id") != ""), "safe_create").otherwise("blocked"))
    return x.select("company_id", *_ID, "key", status.alias("vendor_status"),
                    F.when(F.col("hit").isNotNull(), F.col("hit.id")).when(one, F.col("near.id")).when(status == "safe_create", F.nullif(F.col("vendor_id"), F.lit(""))).alias("resolved_id"),
                    F.when(F.col("hit").isNotNull(), F.col("hit.name")).when(one, F.col("near.name")).otherwise(F.nullif(F.col("vendor_name"), F.lit(""))).alias("resolved_name"))


def assign_vendor_ids(new_keys: DataFrame, vendors: DataFrame) -> DataFrame:
    """I7.  Consecutive V-numbers after the largest one in use, in key order."""
    top = vendors.select(F.max(F.when(F.col("vendor_id").rlike(r"^V\d+$"), F.substring("vendor_id", 2, 30).try_cast("bigint"))).alias("m")).scalar()
    x = number_rows(new_keys.select("company_id", "key").distinct(), ["company_id", "key"])
    n = F.coalesce(top, F.lit(0)) + F.col("seq")
    digits = F.col("n").cast("string")
    return x.withColumn("n", n).select("company_id", "key", F.concat(
        F.lit("V"), F.when(F.col("n") < 1000, F.lpad(digits, 3, "0")).otherwise(digits)).alias("vendor_id"))


# --- I8, I9, I11 ------------------------------------------------------------------------------------
def canonicalize(rows: DataFrame, open_pos: DataFrame, vendors: DataFrame, fuzzy: bool = True, keep: tuple[str, ...] | None = None) -> DataFrame:
    """I8.  Adds `row_status` (ready, review, blocked, skipped) and `issue` to classified rows with a `canonical` map.

    The first row of a PO number wins; it is found by aggregation, so a number that fills a third of the file
    does not gather in one task.  Rows are written once, with the values that decide and not the maps they come from, and each type of
    row is joined to what decides about it only.  `keep` names the
    columns of `rows` wanted; without it all are kept, and vendors are looked up for rows of every type.
    """
    c, meta = F.col("canonical"), F.col("metadata")
    # numbers by lambda and not spelled out one by one: that made a method too long for the JVM to compile
    first = lambda ok, *texts: F.coalesce(F.get(F.filter(F.transform(F.array(*texts), lambda t: safe_float(t)), ok), F.lit(0)), F.lit(0.0))
    total = first(lambda v: v > 0, c["total_amount"], meta["po_amount"], c["invoice_total"], meta["invoice_total"], meta["invoice_subtotal"], meta["total"])
    inv_total = first(lambda v: v != 0, c["invoice_total"], c["invoice_subtotal"])
    e, vs = F.col("entity"), F.col("vendor_status")
    kept = rows.columns if keep is None else [n for n in rows.columns if n in {"company_id", "row_id", *keep}]
    x = rows.withColumns({
        "entity": lookup(F.col("record_type"), ip.ENTITY_OF, "unclassified"), "f_po_raw": safe_str(c["po_number"]),
        "vendor_name": safe_str(F.coalesce(c["vendor_name"], c["name"])), "supplier_code": safe_str(c["supplier_code"]), "tax_id": safe_str(c["tax_id"]), "vendor_id": safe_str(c["vendor_id"]),
        "po_total": total, "inv_total": inv_total, "_number": safe_str(c["invoice_number"]) != "", "_line": first(lambda v: v != 0, c["line_number"]).cast("bigint") > 0,
        "_value": safe_str(c["reference_value"]) != ""})
    # read several times below; without a cut each of them would drag the whole classification along
    x = stage(x.select(*dict.fromkeys([*kept, "entity", "f_po_raw", *_ID, "po_total", "inv_total", "_number", "_line", "_value"])))
    x = x.withColumn("f_po", valid_po_number("f_po_raw"))
    firsts = x.filter("entity = 'po' and f_po is not null").groupBy("company_id", "f_po").agg(F.min("row_id").alias("first_row"))
    known = firsts.select("company_id", F.col("f_po").alias("f_po_raw")).unionByName(open_pos.select("company_id", F.col("po_number").alias("f_po_raw"))).distinct().withColumn("po_known", F.lit(True))
    res = resolve_import_vendors(x.filter("entity in ('po', 'invoice_transaction')"), vendors, fuzzy).drop("key")
    named = lambda part: part.join(res, ["company_id", *_ID], "left")
    other = named if keep is None else lambda part: part
    out = lambda s, m: F.struct(F.lit(s).alias("s"), F.lit(m).alias("m"))
    ready = out("ready", "")
    vendor = F.when(F.col("vendor_name") == "", out("blocked", "missing name")).otherwise(ready)
    po = (F.when(F.col("f_po").isNull(), out("skipped", "no valid po_number")).when(F.col("row_id") != F.col("first_row"), out("blocked", "duplicate po_number"))
          .when(vs == "blocked", out("blocked", "missing vendor name and identifiers")).when(vs == "ambiguous", out("review", "ambiguous vendor"))
          .when(F.col("po_total") <= 0, out("blocked", "invalid total_amount")).otherwise(ready))
    txn = (F.when(F.col("vendor_name") == "", out("blocked", "missing vendor_name")).when(~F.col("_number") & (F.col("inv_total") <= 0), out("blocked", "missing invoice identifier/amount"))
           .when(vs == "ambiguous", out("review", "ambiguous vendor")).otherwise(ready))
    line = (F.when(F.col("f_po_raw") == "", out("blocked", "missing po_number")).when(~true(F.col("po_known")), out("blocked", "PO not found"))
            .when(~F.col("_line"), out("blocked", "invalid line_number")).otherwise(ready))
    grn = F.when(F.col("f_po_raw") == "", out("blocked", "missing po_number")).otherwise(ready)
    ref = F.when((F.col("f_po_raw") == "") | ~F.col("_value"), out("blocked", "missing po_number or reference_value")).otherwise(ready)
    rest = F.when(e == "vendor", vendor).when(e == "grn", grn).when(e == "reference", ref).otherwise(out("skipped", "unclassified row, kept in staging only"))
    parts = [(named(x.filter(e == "po").join(firsts, ["company_id", "f_po"], "left")), po), (named(x.filter(e == "invoice_transaction")), txn),
             (other(x.filter(e == "line").join(known, ["company_id", "f_po_raw"], "left")), line), (other(x.filter(~e.isin("po", "invoice_transaction", "line"))), rest)]
    added = [n for n in ("entity", "f_po", "f_po_raw", *_ID, *(n for n in res.columns if keep is None)) if n not in kept]
    return reduce(DataFrame.unionByName, [part.withColumn("_v", v).select(
        *kept, *dict.fromkeys(added), F.col("_v.s").alias("row_status"), F.col("_v.m").alias("issue"), "po_total", "inv_total") for part, v in parts])


def activation_summary(rows: DataFrame) -> DataFrame:
    """I11.  Counts per record type and status."""
    return rows.groupBy("record_type").pivot("row_status", ["ready", "skipped", "review", "blocked"]).count().na.fill(0)


def import_outcome(rows: DataFrame, review_needed: bool = False) -> DataFrame:
    """I11.  Whether the batch counts as valid or as a partial success."""
    x = rows.agg(F.count_if(F.col("row_status") == "ready").alias("ready"), F.count_if(F.col("row_status") == "blocked").alias("blocked"))
    return x.select("ready", "blocked", ((F.col("ready") > 0) & (F.col("blocked") == 0) & ~F.lit(review_needed)).alias("valid"),
                    (F.col("ready") > 0).alias("partial_success"), F.lit(review_needed).alias("review_needed"))


def mirror_orders(records: DataFrame, existing: DataFrame) -> DataFrame:
    """I9.  Transactions with a total become open blanket orders under their PO reference, or IMP-<id> where that
    number is taken.  Among new transactions with the same reference the first one keeps it."""
    x = records.filter("invoice_total > 0").withColumn("ref", valid_po_number("po_reference"))
    taken = existing.select("company_id", F.col("po_number").alias("ref")).distinct().withColumn("_t", F.lit(True))
    first = x.filter("ref is not null").groupBy("company_id", "ref").agg(F.min("source_record_id").alias("_f"))
    x = x.join(taken, ["company_id", "ref"], "left").join(first, ["company_id", "ref"], "left")
    free = F.col("ref").isNotNull() & ~true(F.col("_t")) & (F.col("source_record_id") == F.col("_f"))
    return x.select("company_id", "source_record_id", F.when(free, F.col("ref")).otherwise(F.concat(F.lit("IMP-"), "source_record_id")).alias("po_number"), "vendor_name",
                    F.col("invoice_total").alias("total_amount"), F.coalesce("currency", F.lit("USD")).alias("currency"), F.lit("open").alias("status"), F.lit("blanket").alias("po_type"),
                    F.col("invoice_date").alias("issue_date"), F.lit(0).cast("bigint").alias("previously_invoiced"), F.lit(True).alias("import_derived"))


def backfill_mirrors(records: DataFrame, mirrored: DataFrame, existing: DataFrame, repair: bool = False) -> DataFrame:
    """I10.  Adds `outcome` (mirrored, repaired, skipped) per transaction.  `mirrored`: (company_id, source_record_id,
    po_number, vendor_name) of the orders that stem from one."""
    m = mirrored.select("company_id", "source_record_id", F.col("po_number").alias("m_po"), F.col("vendor_name").alias("m_vendor"))
    x = records.join(m, ["company_id", "source_record_id"], "left")
    has_total = F.coalesce("invoice_total", F.lit(0)) > 0
    named = F.coalesce("vendor_name", F.lit("")) != ""
    same = vendor_key("m_vendor") == vendor_key("vendor_name")
    there = F.col("m_po").isNotNull()
    fix = there & ~same if repair else F.lit(False)
    outcome = F.when(has_total & named & ~there, "mirrored").when(has_total & named & fix, "repaired").otherwise("skipped")
    x = x.withColumn("outcome", outcome)
    new = mirror_orders(x.filter("outcome = 'mirrored'"), existing).select("company_id", "source_record_id", F.col("po_number").alias("n_po"))
    return x.join(new, ["company_id", "source_record_id"], "left").select("company_id", "source_record_id", "outcome", F.coalesce("n_po", "m_po").alias("po_number"))


def reference_rows(rows: DataFrame) -> DataFrame:
    """Ready reference rows with the key they are looked up by."""
    c = F.col("canonical")
    return rows.filter("entity = 'reference' and row_status = 'ready'").select(
        "company_id", c["po_number"].alias("po_number"), F.coalesce(F.nullif(safe_str(c["reference_type"]), F.lit("")), F.lit("order_ref")).alias("reference_type"),
        c["reference_value"].alias("reference_value"), po_key(c["reference_value"]).alias("normalized_value"))

