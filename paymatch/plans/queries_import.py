"""Import, upserts and table maintenance."""

from pyspark.sql import functions as F

from paymatch import import_policy as ip
from paymatch.operators import imports as im
from paymatch.plans.oracle_base import CTES, sql_valid_po, sql_vendor_key
from paymatch.plans.registry import query
from paymatch.plans.runtime import shared_dir
from paymatch.policy import ROW_PO_PLACEHOLDERS
from paymatch.sources import tables as tb

_COLS = ("record_type", "supplier_name", "supplier_code", "tax_id", "po_no", "po_total", "po_status", "line_no", "qty", "price", "inv_number", "inv_total", "inv_date", "grn", "remarks")
_MAP = {"supplier_name": "vendor_name", "supplier_code": "supplier_code", "tax_id": "tax_id", "po_no": "po_number", "po_total": "total_amount", "po_status": "status", "line_no": "line_number",
        "qty": "quantity", "price": "unit_price", "inv_number": "invoice_number", "inv_total": "invoice_total", "inv_date": "invoice_date", "grn": "grn_id"}


def raw_rows(fx):
    pairs = [x for c in _COLS for x in (F.lit(c), F.col(c))]
    return fx.import_rows.select("company_id", "row_id", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("raw"))


def classified(fx):
    mapping = F.create_map(*[F.lit(x) for kv in _MAP.items() for x in kv])
    return im.apply_mappings(im.classify_rows(raw_rows(fx)), mapping)


# --- A2, A7-A11 -------------------------------------------------------------------------------------
def import_folder(fx):
    if "import_folder" not in fx.__dict__:
        from paymatch.streaming.stream import work_dir
        path = work_dir(fx.spark, "import")
        fx.vendors.selectExpr("vendor_id as `Vendor ID`", "name as `Vendor Name`", "status as ` Status `").repartition(2).write.option("header", True).csv(path)
        fx.__dict__["import_folder"] = path
    return fx.__dict__["import_folder"]


@query("a2_read_import_files", "SELECT vendor_id, name, status FROM v_vendors")
def a2(fx):
    raw = tb.read_import_files(fx.spark, import_folder(fx))
    return raw.select(F.col("raw")["vendor_id"].alias("vendor_id"), F.col("raw")["vendor_name"].alias("name"), F.col("raw")["status"].alias("status"))


def mixed_folder(fx):
    """Two uploads of the vendors under different headers, in another order, with quoted names; the second lacks what the first has."""
    if "mixed_folder" not in fx.__dict__:
        from paymatch.streaming.stream import work_dir
        path = work_dir(fx.spark, "mixed")
        out = lambda df: df.coalesce(1).write.mode("append").option("header", True).csv(path)
        out(fx.vendors.filter("s % 2 = 0").selectExpr("vendor_id as `Vendor ID`", "name as `Vendor Name`", "status as ` Status `", "tax_id as `Tax ID`"))
        out(fx.vendors.filter("s % 2 = 1").selectExpr("concat('\"', name, '\", quoted') as `Vendor Name`", "company_id as `Company  Id`", "vendor_id as `vendor id`"))
        fx.__dict__["mixed_folder"] = path
    return fx.__dict__["mixed_folder"]


@query("a2_mixed_headers", """SELECT vendor_id, CASE WHEN s % 2 = 0 THEN name ELSE '"' || name || '", quoted' END AS name, CASE WHEN s % 2 = 0 THEN 'status,tax_id,vendor_id,vendor_name' ELSE 'company_id,vendor_id,vendor_name' END AS keys,
  CASE WHEN s % 2 = 0 THEN tax_id ELSE company_id END AS other FROM v_vendors""")
def a2_mixed(fx):
    r = F.col("raw")
    return tb.read_import_files(fx.spark, mixed_folder(fx)).select(
        r["vendor_id"].alias("vendor_id"), r["vendor_name"].alias("name"), F.array_join(F.array_sort(F.map_keys(r)), ",").alias("keys"), F.coalesce(r["tax_id"], r["company_id"]).alias("other"))


@query("a1_read_master_table", "SELECT vendor_id, name, status FROM v_vendors WHERE company_id = 'C1'")
def a1_read(fx):
    if "vendor_file" not in fx.__dict__:
        from paymatch.streaming.stream import work_dir
        fx.__dict__["vendor_file"] = work_dir(fx.spark, "vendors") + ".csv"
        fx.vendors.select("company_id", "vendor_id", "name", "status").write.option("header", True).csv(fx.__dict__["vendor_file"])
    return tb.read_master_table(fx.spark, fx.__dict__["vendor_file"], "company_id string, vendor_id string, name string, status string", "C1").select("vendor_id", "name", "status")


@query("a2_file_checksums")
def a2_checksums(fx):
    return tb.file_checksums(fx.spark, import_folder(fx)).select("length", "checksum")


CTES["q_incoming_pos"] = """SELECT company_id, po_number, total_amount + 1 AS total_amount, 'open' AS status, 1 AS ord FROM v_pos WHERE k % 10 = 3
  UNION ALL SELECT company_id, po_number, total_amount + 2, 'closed', 2 FROM v_pos WHERE k % 20 = 3 UNION ALL SELECT company_id, po_number || '-NEW', total_amount, 'open', 1 FROM v_pos WHERE k % 50 = 3"""


def incoming_pos(fx):
    p = fx.pos
    return p.filter("k % 10 = 3").selectExpr("company_id", "po_number", "total_amount + 1 as total_amount", "'open' as status", "1 as ord").unionByName(
        p.filter("k % 20 = 3").selectExpr("company_id", "po_number", "total_amount + 2 as total_amount", "'closed' as status", "2 as ord")).unionByName(
        p.filter("k % 50 = 3").selectExpr("company_id", "concat(po_number, '-NEW') as po_number", "total_amount", "'open' as status", "1 as ord"))


@query("a7_upsert_by_key", """WITH inc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, po_number ORDER BY ord DESC) AS r FROM q_incoming_pos) WHERE r = 1)
  SELECT company_id, po_number, total_amount, status FROM inc UNION ALL SELECT company_id, po_number, total_amount, status FROM v_pos p WHERE NOT EXISTS (SELECT 1 FROM inc WHERE inc.company_id = p.company_id AND inc.po_number = p.po_number)""")
def a7(fx):
    return tb.upsert_by_key(fx.pos.select("company_id", "po_number", "total_amount", "status"), incoming_pos(fx), tb.KEYS["purchase_orders"], "ord")


@query("a7_upsert_keeps_record_id", """SELECT company_id, coalesce(invoice_number, '') AS invoice_number, source_record_id, invoice_total + CASE WHEN k % 21 = 0 AND invoice_number IS NOT NULL AND vendor_name IS NOT NULL THEN 5 ELSE 0 END AS invoice_total
  FROM v_source_records WHERE invoice_total IS NOT NULL AND invoice_number LIKE 'INV%' AND vendor_name IS NOT NULL""")
def a7_keep(fx):
    base = fx.source_records.filter("invoice_total is not null and invoice_number like 'INV%' and vendor_name is not null").select("company_id", "invoice_number", "vendor_name", "source_record_id", "invoice_total")
    inc = base.join(fx.source_records.select("source_record_id", "k"), "source_record_id").filter("k % 21 = 0").selectExpr(
        "company_id", "invoice_number", "vendor_name", "concat('NEW', source_record_id) as source_record_id", "invoice_total + 5 as invoice_total", "1 as ord")
    out = tb.upsert_by_key(base, inc, tb.KEYS["source_records"], "ord", keep=("source_record_id",))
    return out.select("company_id", "invoice_number", "source_record_id", "invoice_total")


@query("a8_insert_if_absent", """SELECT document_id, po_number, amount FROM v_allocations UNION ALL SELECT document_id || '-P', true_po, 1 FROM v_invoices WHERE scn = 10 AND k % 2 = 1""")
def a8(fx):
    inc = fx.invoices.filter("scn = 10").selectExpr("company_id", "concat(document_id, '-P') as document_id", "true_po as po_number", "cast(1 as bigint) as amount")
    return tb.insert_if_absent(fx.allocations, inc, ["document_id", "po_number"]).select("document_id", "po_number", "amount")


@query("a9_stage_batch_replace", "SELECT company_id, 'sum' || (k % 5) AS checksum, po_number, CASE WHEN k % 5 = 2 THEN 'second' ELSE 'first' END AS upload FROM v_pos WHERE NOT (k % 5 = 2 AND k % 2 = 0)")
def a9(fx):
    path = f"{shared_dir(fx.spark).rstrip('/')}/paymatch-stage/batches-{__import__('uuid').uuid4().hex}"
    rows = fx.pos.selectExpr("company_id", "concat('sum', k % 5) as checksum", "po_number", "'first' as upload", "k")
    tb.stage_batch_replace(rows.drop("k"), path)
    tb.stage_batch_replace(rows.filter("k % 5 = 2 and k % 2 = 1").withColumn("upload", F.lit("second")).drop("k"), path)
    return fx.spark.read.parquet(path).select("company_id", "checksum", "po_number", "upload")


@query("a10_tenant_purge", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS remaining FROM {v} WHERE company_id <> 'C1'" for n, v in (("vendors", "v_vendors"), ("purchase_orders", "v_pos"), ("grn_records", "v_grn"))))
def a10(fx):
    return tb.tenant_purge({"vendors": fx.vendors, "purchase_orders": fx.pos, "grn_records": fx.grn}, "C1")[1]


@query("a11_write_stage_outputs", "SELECT document_id, 'rerun' AS overall_state FROM v_runs WHERE k % 3 = 0 UNION ALL SELECT document_id, stage3_status FROM v_runs WHERE k % 3 <> 0")
def a11(fx):
    path = f"{shared_dir(fx.spark).rstrip('/')}/paymatch-stage/history-{__import__('uuid').uuid4().hex}"
    tb.append_history(fx.runs.selectExpr("document_id", "stage3_status as overall_state", "1 as version", "'d1' as run_date"), path)
    tb.append_history(fx.runs.filter("k % 3 = 0").selectExpr("document_id", "'rerun' as overall_state", "2 as version", "'d2' as run_date"), path)
    return tb.latest_per_key(fx.spark.read.parquet(path), ["document_id"], [F.col("version").desc()]).select("document_id", "overall_state")


# --- I1-I5, I12, I13 --------------------------------------------------------------------------------
CTES["q_aliases"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{e}', {ei}, '{f}', {fi}, '{a}')" for ei, (e, fields) in enumerate(ip.FIELDS.items()) for fi, (f, names) in enumerate(fields.items()) for a in names) + ") t(entity, eo, field, fo, alias)"
_SHEET = "CASE k % 6 WHEN 0 THEN 'vendors' WHEN 1 THEN 'my_purchase_orders_2024' WHEN 2 THEN 'x' WHEN 3 THEN 'polines' WHEN 4 THEN 'zz' ELSE 'receipts' END"
_HEADS = {0: ("Vendor Name", "Tax ID", "Status"), 1: ("PO", "Line No", "Qty Ordered"), 2: ("invoice_number", "inv_total", "Inv Date"), 3: ("foo", "bar", "Grand Total")}
CTES["q_catalog"] = f"""SELECT po_number AS source_id, {_SHEET} AS sheet, pos AS position, list_extract(heads, pos) AS column_name FROM (SELECT po_number, k, unnest([1, 2, 3]) AS pos, CASE k % 4 """ + " ".join(
    f"WHEN {i} THEN [{', '.join(chr(39) + h + chr(39) for h in hs)}]" for i, hs in _HEADS.items()) + " END AS heads FROM v_pos)"
_NORM = "regexp_replace(lower(trim({x})), '\\s+', '_', 'g')"


def catalog(fx):
    heads = "case k % 4 " + " ".join(f"when {i} then array({', '.join(chr(39) + h + chr(39) for h in hs)})" for i, hs in _HEADS.items()) + " end"
    return fx.pos.selectExpr("po_number as source_id", f"{_SHEET} as sheet", f"posexplode({heads}) as (p, column_name)").withColumn("position", F.col("p") + 1).drop("p")


@query("i1_infer_entity", f"""WITH hits AS (SELECT source_id, sheet, entity, eo, count(DISTINCT field) AS n FROM q_catalog c JOIN q_aliases a ON a.alias = {_NORM.format(x='c.column_name')} GROUP BY ALL),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, sheet ORDER BY n DESC, eo) AS r FROM hits) WHERE r = 1)
  SELECT s.source_id, s.sheet, CASE s.sheet WHEN 'vendors' THEN 'vendor' WHEN 'my_purchase_orders_2024' THEN 'po' WHEN 'polines' THEN 'line' WHEN 'receipts' THEN 'grn' ELSE coalesce(b.entity, 'unknown') END AS entity
  FROM (SELECT DISTINCT source_id, sheet FROM q_catalog) s LEFT JOIN best b ON b.source_id = s.source_id AND b.sheet = s.sheet""")
def i1(fx):
    return im.infer_entity(catalog(fx))


@query("i2_profile_tables", """SELECT entity, count(*) AS row_count, '""" + ",".join(sorted(_COLS)) + """' AS columns, string_agg(line, ';' ORDER BY row_id) FILTER (r <= 3) AS samples FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY row_id) AS r FROM (
    SELECT row_id, CASE record_type WHEN 'vendor' THEN 'vendor' WHEN 'purchase_order' THEN 'po' WHEN 'invoice' THEN 'invoice_transaction' ELSE 'unknown' END AS entity,
      concat_ws('|', """ + ", ".join(f"'{c}=' || {c}" for c in sorted(_COLS)) + """) AS line FROM v_import_rows)) GROUP BY entity""")
def i2(fx):
    entries = lambda r: F.transform(F.array_sort(F.map_entries(r)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    samples = F.array_join(F.transform("sample_rows", lambda r: F.concat_ws("|", entries(r))), ";")
    return im.profile_rows(raw_rows(fx), _COLS).select("entity", "row_count", "columns", samples.alias("samples"))


CTES["q_cat_entity"] = "SELECT source_id, position, column_name, CASE WHEN sheet = 'polines' THEN 'line' WHEN sheet = 'vendors' THEN 'vendor' ELSE 'po' END AS entity FROM q_catalog"
CTES["q_col_scores"] = f"""SELECT source_id, entity, position, column_name, list({{'s': s, 'o': -fo, 'f': field}}) AS opts FROM (
    SELECT c.source_id, c.entity, c.position, c.column_name, a.fo, a.field, max(CASE WHEN a.alias = {_NORM.format(x='c.column_name')} THEN 1e0 WHEN contains({_NORM.format(x='c.column_name')}, a.alias) OR contains(a.alias, {_NORM.format(x='c.column_name')}) THEN 0.75e0 ELSE 0e0 END) AS s
    FROM q_cat_entity c JOIN q_aliases a ON a.entity = c.entity GROUP BY ALL) GROUP BY ALL"""
CTES["q_proposals"] = """ /*recursive*/
  SELECT DISTINCT source_id, entity, 0 AS position, []::VARCHAR[] AS used, '' AS column_name, NULL::VARCHAR AS field, 0e0 AS confidence FROM q_cat_entity
  UNION ALL SELECT source_id, entity, position, CASE WHEN best.s >= 0.55e0 THEN list_append(used, best.f) ELSE used END, column_name, CASE WHEN best.s >= 0.55e0 THEN best.f END, CASE WHEN best.s >= 0.55e0 THEN best.s ELSE 0e0 END
  FROM (SELECT p.source_id, p.entity, s.position, p.used, s.column_name, list_max(list_filter(s.opts, lambda o: NOT list_contains(p.used, o.f))) AS best
        FROM q_proposals p JOIN q_col_scores s ON s.source_id = p.source_id AND s.entity = p.entity AND s.position = p.position + 1)"""


def proposals(fx):
    x = catalog(fx).selectExpr("source_id", "position", "column_name", "case when sheet = 'polines' then 'line' when sheet = 'vendors' then 'vendor' else 'po' end as entity")
    return fx.memo("proposals", lambda: im.propose_mappings(x))


@query("i3_propose_mappings", """SELECT source_id, entity, column_name AS source_column, coalesce(field, '') AS canonical_field, confidence, CASE WHEN field IS NULL THEN 'metadata' WHEN confidence >= 0.85 THEN 'auto' ELSE 'review' END AS status
  FROM q_proposals WHERE position > 0""")
def i3(fx):
    return proposals(fx).withColumn("canonical_field", F.coalesce("canonical_field", F.lit("")))


@query("i4_apply_mappings", "SELECT row_id, concat_ws('|', " + ", ".join(f"'{_MAP[c]}=' || {c}" for c in sorted(_MAP, key=_MAP.get)) + ") AS canonical, concat_ws('|', 'record_type=' || record_type, 'remarks=' || remarks) AS metadata FROM v_import_rows")
def i4(fx):
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return classified(fx).select("row_id", text("canonical").alias("canonical"), text("metadata").alias("metadata"))


_FULL = lambda c: f"trim(coalesce({c}, '')) <> ''"
CTES["q_classified"] = f"""
  SELECT *, CASE WHEN explicit IS NOT NULL THEN explicit WHEN {_FULL('line_no')} AND po IS NOT NULL THEN 'line' WHEN po IS NOT NULL AND sup AND NOT inv THEN 'purchase_order' WHEN inv AND po IS NOT NULL THEN 'invoice_with_po_reference'
      WHEN inv THEN 'invoice_transaction' WHEN {_FULL('grn')} THEN 'grn' WHEN {_FULL('po_no')} AND po IS NULL AND (sup OR {_FULL('supplier_name')}) THEN 'purchase_order'
      WHEN ({_FULL('tax_id')} OR {_FULL('supplier_code')} OR {_FULL('supplier_name')}) AND po IS NULL THEN 'vendor' ELSE 'unclassified' END AS rt
  FROM (SELECT *, CASE record_type WHEN 'vendor' THEN 'vendor' WHEN 'purchase_order' THEN 'purchase_order' WHEN 'invoice' THEN 'invoice_transaction' END AS explicit, {sql_valid_po('po_no', ROW_PO_PLACEHOLDERS)} AS po,
      {_FULL('inv_number')} AND (coalesce(try_cast(inv_total AS DOUBLE), 0) > 0) AS inv, (coalesce(try_cast(po_total AS DOUBLE), 0) > 0) OR {_FULL('po_status')} AS sup FROM v_import_rows)"""


@query("i5_classify_row", "SELECT row_id, rt AS record_type, coalesce(po, '') AS po_reference FROM q_classified".replace("q_classified", "q_classified2"))
def i5(fx):
    return im.classify_rows(raw_rows(fx)).select("row_id", "record_type", F.coalesce("po_reference", F.lit("")).alias("po_reference"))


# an invoice date alone also supports an invoice number
CTES["q_classified2"] = CTES["q_classified"].replace(f"{_FULL('inv_number')} AND (coalesce(try_cast(inv_total AS DOUBLE), 0) > 0) AS inv",
                                                     f"{_FULL('inv_number')} AND (coalesce(try_cast(inv_total AS DOUBLE), 0) > 0 OR {_FULL('inv_date')}) AS inv")

# --- I6-I11 -----------------------------------------------------------------------------------------
CTES["q_identities"] = f"""SELECT DISTINCT company_id, trim(coalesce(supplier_name, '')) AS vendor_name, trim(coalesce(supplier_code, '')) AS supplier_code, trim(coalesce(tax_id, '')) AS tax_id, {sql_vendor_key("trim(coalesce(supplier_name, ''))")} AS key FROM v_import_rows"""
CTES["q_import_vendors"] = """SELECT i.*, coalesce(a.vendor_id, b.vendor_id, c.vendor_id) AS hit FROM q_identities i
  LEFT JOIN v_vendors a ON a.company_id = i.company_id AND i.supplier_code <> '' AND a.supplier_code = i.supplier_code LEFT JOIN v_vendors b ON b.company_id = i.company_id AND i.tax_id <> '' AND b.tax_id = i.tax_id
  LEFT JOIN v_vendors c ON c.company_id = i.company_id AND i.vendor_name <> '' AND c.normalized_name = i.key AND i.key <> ''"""


def identities(fx):
    c = F.col("raw")
    return raw_rows(fx).select("company_id", c["supplier_name"].alias("vendor_name"), c["supplier_code"].alias("supplier_code"), c["tax_id"].alias("tax_id"), F.lit("").alias("vendor_id"))


@query("i6_resolve_import_vendor_by_key", "SELECT company_id, vendor_name, supplier_code, tax_id, CASE WHEN hit IS NOT NULL THEN 'existing' WHEN vendor_name <> '' THEN 'safe_create' ELSE 'blocked' END AS status, coalesce(hit, '') AS resolved_id FROM q_import_vendors")
def i6(fx):
    r = im.resolve_import_vendors(identities(fx), fx.vendors, fuzzy=False)
    return r.select("company_id", "vendor_name", "supplier_code", "tax_id", F.col("vendor_status").alias("status"), F.coalesce("resolved_id", F.lit("")).alias("resolved_id"))


@query("i6_resolve_import_vendor")
def i6_full(fx):
    return im.resolve_import_vendors(identities(fx), fx.vendors).select("company_id", "vendor_name", "supplier_code", "tax_id", "vendor_status", "resolved_id")


@query("i7_assign_vendor_ids", """SELECT company_id, key, 'V' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS vendor_id FROM (SELECT company_id, key, (SELECT max(substring(vendor_id, 2)::BIGINT) FROM v_vendors) + row_number() OVER (ORDER BY company_id, key) AS n
  FROM (SELECT DISTINCT company_id, key FROM q_import_vendors WHERE hit IS NULL AND vendor_name <> ''))""")
def i7(fx):
    new = im.resolve_import_vendors(identities(fx), fx.vendors, fuzzy=False).filter("vendor_status = 'safe_create'")
    return im.assign_vendor_ids(new, fx.vendors).select("company_id", "key", "vendor_id")


@query("i7_assign_vendor_ids_fuzzy")
def i7_full(fx):
    new = im.resolve_import_vendors(identities(fx), fx.vendors).filter("vendor_status = 'safe_create'")
    return im.assign_vendor_ids(new, fx.vendors).select("company_id", "key", "vendor_id")


CTES["q_firsts"] = f"SELECT {sql_valid_po('po_no')} AS po, company_id, min(row_id) AS first_row FROM q_classified2 WHERE rt = 'purchase_order' AND {sql_valid_po('po_no')} IS NOT NULL GROUP BY 1, 2"
CTES["q_known_pos"] = "SELECT company_id, po FROM q_firsts UNION SELECT company_id, po_number FROM v_pos WHERE status = 'open'"
CTES["q_canonical"] = f"""
  SELECT c.row_id, c.rt AS record_type, CASE
    WHEN rt = 'vendor' THEN CASE WHEN {_FULL('supplier_name')} THEN 'ready|' ELSE 'blocked|missing name' END
    WHEN rt = 'purchase_order' THEN CASE WHEN {sql_valid_po('po_no')} IS NULL THEN 'skipped|no valid po_number' WHEN c.row_id <> f.first_row THEN 'blocked|duplicate po_number'
      WHEN NOT ({_FULL('supplier_name')}) THEN 'blocked|missing vendor name and identifiers' WHEN coalesce(try_cast(po_total AS DOUBLE), 0) <= 0 AND coalesce(try_cast(inv_total AS DOUBLE), 0) <= 0 THEN 'blocked|invalid total_amount' ELSE 'ready|' END
    WHEN rt IN ('invoice_transaction', 'invoice_with_po_reference') THEN CASE WHEN NOT ({_FULL('supplier_name')}) THEN 'blocked|missing vendor_name'
      WHEN NOT ({_FULL('inv_number')}) AND coalesce(try_cast(inv_total AS DOUBLE), 0) <= 0 THEN 'blocked|missing invoice identifier/amount' ELSE 'ready|' END
    WHEN rt = 'line' THEN CASE WHEN NOT ({_FULL('po_no')}) THEN 'blocked|missing po_number' WHEN n.po IS NULL THEN 'blocked|PO not found' WHEN coalesce(try_cast(line_no AS DOUBLE), 0)::BIGINT <= 0 THEN 'blocked|invalid line_number' ELSE 'ready|' END
    WHEN rt = 'grn' THEN CASE WHEN NOT ({_FULL('po_no')}) THEN 'blocked|missing po_number' ELSE 'ready|' END ELSE 'skipped|unclassified row, kept in staging only' END AS verdict
  FROM q_classified2 c LEFT JOIN q_firsts f ON f.po = {sql_valid_po('c.po_no')} AND f.company_id = c.company_id AND c.rt = 'purchase_order'
  LEFT JOIN q_known_pos n ON n.company_id = c.company_id AND n.po = trim(c.po_no)"""


_STATUS = ("row_id", "record_type", "row_status", "issue")


def canonical(fx, fuzzy=False):
    fx.staged("pos")
    return fx.memo(f"canonical_{fuzzy}", lambda: im.canonicalize(classified(fx), fx.pos.filter("status = 'open'"), fx.vendors, fuzzy, _STATUS).select(*_STATUS))


@query("i8_canonicalize_batch", "SELECT row_id, record_type, string_split(verdict, '|')[1] AS row_status, string_split(verdict, '|')[2] AS issue FROM q_canonical")
def i8(fx):
    return canonical(fx)


@query("i8_canonicalize_batch_fuzzy")
def i8_full(fx):
    return canonical(fx, fuzzy=True)


CTES["q_mirror"] = f"""SELECT s.company_id, s.source_record_id, CASE WHEN ref IS NOT NULL AND t.po_number IS NULL AND r = 1 THEN ref ELSE 'IMP-' || source_record_id END AS po_number, invoice_total AS total_amount
  FROM (SELECT *, {sql_valid_po('po_reference')} AS ref, row_number() OVER (PARTITION BY company_id, po_reference ORDER BY source_record_id) AS r FROM v_source_records WHERE invoice_total > 0) s LEFT JOIN v_pos t ON t.company_id = s.company_id AND t.po_number = ref"""


@query("i9_mirror_source_to_po", "SELECT source_record_id, po_number, total_amount FROM q_mirror")
def i9(fx):
    return im.mirror_orders(fx.source_records, fx.pos).select("source_record_id", "po_number", "total_amount")


@query("i10_backfill_mirrors", f"""WITH m AS (SELECT source_record_id, 'MIR-' || k AS m_po, CASE WHEN k % 6 = 0 THEN 'Somebody Else' ELSE vendor_name END AS m_vendor FROM v_source_records WHERE k % 2 = 0),
  o AS (SELECT s.*, m.m_po, CASE WHEN coalesce(invoice_total, 0) > 0 AND coalesce(vendor_name, '') <> '' THEN CASE WHEN m.m_po IS NULL THEN 'mirrored' WHEN {sql_vendor_key('m.m_vendor')} <> {sql_vendor_key('s.vendor_name')} THEN 'repaired' ELSE 'skipped' END ELSE 'skipped' END AS outcome
    FROM v_source_records s LEFT JOIN m ON m.source_record_id = s.source_record_id)
  SELECT source_record_id, outcome, coalesce(CASE WHEN outcome = 'mirrored' THEN CASE WHEN po_reference IS NOT NULL AND t.po_number IS NULL THEN po_reference ELSE 'IMP-' || source_record_id END ELSE m_po END, '') AS po_number FROM o LEFT JOIN v_pos t ON t.company_id = o.company_id AND t.po_number = o.po_reference""")
def i10(fx):
    m = fx.source_records.filter("k % 2 = 0").selectExpr("company_id", "source_record_id", "concat('MIR-', k) as po_number", "case when k % 6 = 0 then 'Somebody Else' else vendor_name end as vendor_name")
    x = im.backfill_mirrors(fx.source_records, m, fx.pos, repair=True)
    return x.select("source_record_id", "outcome", F.coalesce("po_number", F.lit("")).alias("po_number"))


@query("i11_activation_summary", "SELECT record_type, count(*) FILTER (verdict LIKE 'ready%') AS ready, count(*) FILTER (verdict LIKE 'skipped%') AS skipped, count(*) FILTER (verdict LIKE 'review%') AS review, count(*) FILTER (verdict LIKE 'blocked%') AS blocked FROM q_canonical GROUP BY 1")
def i11(fx):
    return im.activation_summary(canonical(fx))


@query("i11_activation_summary_fuzzy")
def i11_full(fx):
    return im.activation_summary(canonical(fx, fuzzy=True))


@query("i11_import_outcome", "SELECT count(*) FILTER (verdict LIKE 'ready%') AS ready, count(*) FILTER (verdict LIKE 'blocked%') AS blocked, count(*) FILTER (verdict LIKE 'ready%') > 0 AND count(*) FILTER (verdict LIKE 'blocked%') = 0 AS valid, count(*) FILTER (verdict LIKE 'ready%') > 0 AS partial_success, false AS review_needed FROM q_canonical")
def i11_outcome(fx):
    return im.import_outcome(canonical(fx))


@query("i12_unknown_columns", "SELECT source_id, entity, column_name AS source_column FROM q_proposals WHERE position > 0 AND field IS NULL")
def i12(fx):
    return im.unknown_columns(proposals(fx))


@query("i13_column_map_profile", f"""SELECT source_id, entity, string_agg(DISTINCT {_NORM.format(x='column_name')} || '=' || field, ',' ORDER BY {_NORM.format(x='column_name')} || '=' || field) AS column_map FROM q_proposals WHERE position > 0 AND field IS NOT NULL GROUP BY 1, 2""")
def i13(fx):
    p = im.mapping_profile(proposals(fx))
    return p.select("source_id", "entity", F.array_join(F.array_sort(F.transform("mappings", lambda e: F.concat_ws("=", e["k"], e["v"]))), ",").alias("column_map"))
