"""Vendor resolution, candidate retrieval, line matching, scoring and match state (J1-J15, L*, S*, M*)."""

from pyspark.sql import functions as F

from paymatch.functions import fields as fld
from paymatch.functions import text as txt
from paymatch.functions.similarity import sequence_ratio
from paymatch.operators import candidates as cand
from paymatch.operators import lines as ln
from paymatch.operators import matching as mat
from paymatch.operators import scoring as sc
from paymatch.operators import vendors as ven
from paymatch.plans.oracle_base import CTES, sql_description_key, sql_jaccard, sql_po_key, sql_po_key_loose, sql_vendor_key, sql_word_set
from paymatch.plans.queries_extraction import evidence
from paymatch.plans.registry import query
from paymatch.plans.runtime import stage
from paymatch.policy import MATCH, MATCH_TOKENS

# --- vendor resolution ----------------------------------------------------------------------------
CTES["q_names"] = f"""SELECT DISTINCT company_id, vendor_name, {sql_vendor_key('vendor_name')} AS key FROM v_invoices WHERE vendor_name <> ''"""
CTES["q_book"] = f"""
  SELECT company_id, vendor_id, {sql_vendor_key('name')} AS key, 'normalized' AS method, 0.90e0 AS conf FROM v_vendors WHERE status = 'active'
  UNION SELECT company_id, vendor_id, {sql_vendor_key('alias')}, 'alias', 0.85e0
  FROM (SELECT company_id, vendor_id, status, unnest(aliases) AS alias FROM v_vendors) WHERE status = 'active'"""
CTES["q_resolved"] = """
  SELECT company_id, vendor_name, vendor_id, method, conf AS confidence FROM (
    SELECT n.company_id, n.vendor_name, b.vendor_id, b.method, b.conf,
           row_number() OVER (PARTITION BY n.company_id, n.vendor_name ORDER BY b.vendor_id, b.conf DESC) AS r
    FROM q_names n JOIN q_book b ON b.company_id = n.company_id AND b.key = n.key) WHERE r = 1"""


@query("j1_resolve_vendor_normalized", "SELECT document_id, vendor_id, method, confidence FROM v_invoices i JOIN q_resolved r ON r.company_id = i.company_id AND r.vendor_name = i.vendor_name")
def j1(fx):
    r = ven.resolve_normalized(fx.invoices, fx.vendors)
    return fx.invoices.join(r, ["company_id", "vendor_name"]).select("document_id", "vendor_id", "method", "confidence")


@query("j2_resolve_vendor_equivalent", f"""SELECT document_id, coalesce((SELECT min(vendor_id) FROM v_vendors v WHERE v.status = 'active' AND v.company_id = i.company_id
    AND {sql_vendor_key('v.name')} = {sql_vendor_key('i.vendor_name')} AND coalesce(i.vendor_name, '') <> ''), '') AS vendor_id FROM v_invoices i""")
def j2(fx):
    book = ven.active_names(fx.vendors).filter("method = 'normalized'").groupBy("company_id", "key").agg(F.min("vendor_id").alias("vendor_id"))
    i = fx.invoices.select("company_id", "document_id", F.when(F.col("vendor_name") != "", ven.vendor_key("vendor_name")).alias("key"))
    return i.join(book, ["company_id", "key"], "left").select("document_id", F.coalesce("vendor_id", F.lit("")).alias("vendor_id"))


@query("j3_fuzzy_vendor_token_pairs", f"""SELECT DISTINCT n.company_id, n.key AS lk, b.key AS rk, {sql_jaccard(sql_word_set('n.key'), sql_word_set('b.key'))} AS token_overlap
  FROM q_names n JOIN q_book b ON b.company_id = n.company_id WHERE {sql_jaccard(sql_word_set('n.key'), sql_word_set('b.key'))} > 0.25e0""")
def j3_pairs(fx):
    return ven.fuzzy_pairs(fx.invoices.filter("vendor_name <> ''"), fx.vendors).filter("token_overlap > 0.25e0")


@query("j3_resolve_vendor_fuzzy")
def j3(fx):
    return ven.resolve_fuzzy(fx.invoices, fx.vendors)


@query("j4_resolve_vendor")
def j4(fx):
    r = ven.resolve_vendor(fx.invoices, fx.vendors)
    return fx.invoices.join(r, ["company_id", "vendor_name"], "left").select(
        "document_id", F.coalesce("vendor_id", F.lit("")).alias("vendor_id"), F.coalesce("method", F.lit("none")).alias("method"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


# --- candidate retrieval --------------------------------------------------------------------------
CTES["q_flags"] = """
  SELECT company_id, bool_or(import_derived) OR company_id IN (SELECT company_id FROM v_source_records) AS has_import,
         bool_or(import_derived AND status = 'open') AS open_import FROM v_pos GROUP BY company_id"""
CTES["q_source_orders"] = f"""
  SELECT *, coalesce(po_reference, 'IMP-' || source_record_id) AS po_number, {sql_vendor_key('vendor_name')} AS vkey
  FROM v_source_records WHERE invoice_total > 0"""
CTES["q_c_source"] = f"""
  SELECT company_id, document_id, po_number, 'source_record_invoice' AS method, 0.88e0 AS confidence, 1 AS strategy, row_number() OVER (PARTITION BY document_id ORDER BY sid) AS seq
  FROM (SELECT i.company_id, document_id, po_number, min(source_record_id) AS sid FROM v_invoices i JOIN q_source_orders s
    ON s.company_id = i.company_id AND s.invoice_number = i.invoice_number
    WHERE i.vendor_name <> '' AND (contains(s.vkey, {sql_vendor_key('i.vendor_name')}) OR contains({sql_vendor_key('i.vendor_name')}, s.vkey)) GROUP BY ALL)"""
CTES["q_refs"] = """
  SELECT company_id, document_id, 0 AS i, ref_value AS value FROM v_invoices WHERE ref_value IS NOT NULL
  UNION ALL SELECT company_id, document_id, 1, po_value FROM v_invoices WHERE coalesce(po_value, '') <> '' AND po_conf >= 0.7"""
CTES["q_c_reference"] = f"""
  SELECT company_id, document_id, po_number, 'reference' AS method, 0.9e0 AS confidence, 2 AS strategy,
         row_number() OVER (PARTITION BY document_id ORDER BY i, po_number) AS seq
  FROM (SELECT r.company_id, document_id, p.po_number, min(i) AS i FROM q_refs r JOIN v_po_references p
        ON p.company_id = r.company_id AND {sql_po_key('p.reference_value')} = {sql_po_key('r.value')} GROUP BY ALL)"""
CTES["q_c_exact"] = f"""
  SELECT company_id, document_id, po_number, 'exact' AS method, 1e0 AS confidence, 3 AS strategy, row_number() OVER (PARTITION BY document_id ORDER BY po_number) AS seq
  FROM (SELECT *, bool_or(imp) OVER (PARTITION BY document_id, how) AS any_imp, min(how) OVER (PARTITION BY document_id) AS best FROM (
    SELECT i.company_id, i.document_id, p.po_number, CASE WHEN p.po_number = i.po_value THEN 1 ELSE 2 END AS how, f.has_import AND p.import_derived AS imp
    FROM v_invoices i JOIN v_pos p ON p.company_id = i.company_id AND {sql_po_key_loose('p.po_number')} = {sql_po_key_loose('i.po_value')}
    JOIN q_flags f ON f.company_id = i.company_id)) WHERE how = best AND (NOT any_imp OR imp)"""
CTES["q_c_normalized"] = f"""
  SELECT company_id, document_id, po_number, 'normalized' AS method, 0.85e0 AS confidence, 4 AS strategy, row_number() OVER (PARTITION BY document_id ORDER BY po_number) AS seq
  FROM (SELECT *, bool_or(imp) OVER (PARTITION BY document_id) AS any_imp FROM (
    SELECT i.company_id, i.document_id, p.po_number, f.has_import AND p.import_derived AS imp FROM v_invoices i
    JOIN v_pos p ON p.company_id = i.company_id AND p.status = 'open' AND {sql_po_key('p.po_number')} = {sql_po_key('i.po_value')}
    JOIN q_flags f ON f.company_id = i.company_id
    WHERE i.document_id NOT IN (SELECT document_id FROM q_c_exact))) WHERE NOT any_imp OR imp"""
CTES["q_v_hits"] = f"""
  SELECT n.company_id, n.vendor_name, p.po_number, p.import_derived, CASE WHEN p.import_derived THEN 'import_derived' ELSE 'vendor_search' END AS method,
         0.75e0 AS conf, 1 AS tier, p.po_number AS ord, p.total_amount - p.previously_invoiced AS remaining FROM q_names n JOIN q_resolved r ON r.company_id = n.company_id AND r.vendor_name = n.vendor_name
    JOIN (SELECT p.*, bool_or(has_import AND import_derived) OVER (PARTITION BY p.company_id, vendor_id) AS hide FROM v_pos p JOIN q_flags f ON f.company_id = p.company_id
          WHERE status = 'open') p ON p.company_id = n.company_id AND p.vendor_id = r.vendor_id WHERE NOT hide OR p.import_derived
  UNION ALL
  SELECT n.company_id, n.vendor_name, p.po_number, p.import_derived, CASE WHEN p.import_derived THEN 'import_derived' ELSE 'vendor_name' END,
         CASE WHEN pkey = n.key AND p.vendor_name <> '' THEN 0.70e0 ELSE 0.65e0 END, 2, p.po_number, p.total_amount - p.previously_invoiced
    FROM q_names n JOIN (SELECT p.*, {sql_vendor_key('p.vendor_name')} AS pkey, {sql_vendor_key('v.normalized_name')} AS mkey FROM v_pos p
      JOIN q_flags f ON f.company_id = p.company_id LEFT JOIN v_vendors v ON v.company_id = p.company_id AND v.vendor_id = p.vendor_id
      WHERE p.status = 'open' AND (NOT (has_import AND open_import) OR import_derived)) p ON p.company_id = n.company_id AND (pkey = n.key OR mkey = n.key)
  UNION ALL
  SELECT n.company_id, n.vendor_name, s.po_number, true, 'source_record', 0.72e0, 3, lpad((9999999999 - epoch(s.created_at))::BIGINT::VARCHAR, 12, '0') || s.source_record_id, s.invoice_total
    FROM q_names n JOIN q_source_orders s ON s.company_id = n.company_id AND (contains(s.vkey, n.key) OR contains(n.key, s.vkey))"""
CTES["q_v_lists"] = """
  SELECT company_id, vendor_name, po_number, method, conf, tier, ord, remaining, row_number() OVER (PARTITION BY company_id, vendor_name ORDER BY conf DESC, tier, ord) AS seq FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id, vendor_name, po_number ORDER BY tier, ord) AS pick FROM (
      SELECT h.*, bool_or(has_import AND import_derived) OVER (PARTITION BY h.company_id, vendor_name) AS hide FROM q_v_hits h JOIN q_flags f ON f.company_id = h.company_id)
    WHERE NOT hide OR import_derived) WHERE pick = 1"""
CTES["q_c_vendor"] = """
  SELECT i.company_id, document_id, po_number, method, conf AS confidence, 5 AS strategy, seq FROM v_invoices i
  JOIN q_v_lists l ON l.company_id = i.company_id AND l.vendor_name = i.vendor_name WHERE seq <= 20"""
CTES["q_lookups"] = """
  SELECT * FROM q_c_source UNION ALL SELECT * FROM q_c_reference UNION ALL SELECT * FROM q_c_exact UNION ALL SELECT * FROM q_c_normalized"""
CTES["q_candidates"] = """
  SELECT company_id, document_id, po_number, method, confidence, strategy, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, strategy, seq, po_number) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY document_id, po_number ORDER BY strategy, seq) AS pick FROM (
        SELECT * FROM q_lookups UNION ALL
        SELECT v.* FROM q_c_vendor v JOIN v_invoices i ON i.document_id = v.document_id
        WHERE NOT (coalesce(po_value, '') <> '' AND po_conf >= 0.85 AND po_status IN ('extracted', 'inferred')
                   AND lower(trim(po_value)) NOT IN ('n/a', 'none', 'null', '-'))
           OR v.document_id IN (SELECT document_id FROM q_lookups WHERE method IN ('exact', 'normalized', 'reference'))))
    WHERE pick = 1) WHERE rank <= 20"""


def with_refs(inv):
    own = F.when((F.coalesce("po_value", F.lit("")) != "") & (F.col("po_conf") >= 0.7), F.col("po_value"))
    ref = lambda v: F.when(v.isNotNull(), F.struct(F.lit("order_ref").alias("type"), v.alias("value")))
    return inv.withColumn("refs", F.array_compact(F.array(ref(F.col("ref_value")), ref(own))))


@query("j5_candidates_source_invoice", "SELECT document_id, po_number, method, confidence FROM q_c_source")
def j5(fx):
    return cand.by_source_invoice(fx.invoices, fx.source_records).select("document_id", "po_number", "method", "confidence")


@query("j6_candidates_reference", "SELECT document_id, po_number, method, confidence FROM q_c_reference")
def j6(fx):
    return cand.by_reference(with_refs(fx.invoices), fx.po_references, fx.pos).select("document_id", "po_number", "method", "confidence")


@query("j7_candidates_exact_po", "SELECT document_id, po_number, method, confidence FROM q_c_exact")
def j7(fx):
    c = cand.by_number(fx.invoices, fx.pos, cand.tenant_flags(fx.pos, fx.source_records))
    return c.filter("method = 'exact'").select("document_id", "po_number", "method", "confidence")


@query("j8_candidates_normalized_po", "SELECT document_id, po_number, method, confidence FROM q_c_normalized")
def j8(fx):
    c = cand.by_number(fx.invoices, fx.pos, cand.tenant_flags(fx.pos, fx.source_records))
    return c.filter("method = 'normalized'").select("document_id", "po_number", "method", "confidence")


@query("j9_candidates_vendor", "SELECT document_id, po_number, method, confidence FROM q_c_vendor")
def j9(fx):
    inv = fx.invoices
    r = cand.resolve_for(inv, fx.vendors, MATCH_TOKENS)
    c = cand.by_vendor(inv, r, fx.pos, fx.vendors, fx.source_records, cand.tenant_flags(fx.pos, fx.source_records), MATCH.max_candidates)
    return c.select("document_id", "po_number", "method", "confidence")


@query("j9_vendor_order_lists", "SELECT company_id, vendor_name, po_number, method, conf AS confidence FROM q_v_lists")
def j9_lists(fx):
    r = cand.resolve_for(fx.invoices, fx.vendors, MATCH_TOKENS)
    c = cand.vendor_lists(fx.invoices, r, fx.pos, fx.vendors, fx.source_records, cand.tenant_flags(fx.pos, fx.source_records))
    return c.select("company_id", "vendor_name", "po_number", "method", F.col("conf").alias("confidence"))


@query("j10_candidates_vendor_amount", """
  WITH hits AS (SELECT document_id, total_cents, l.po_number, l.remaining, tier, ord,
      CASE WHEN total_cents <= l.remaining THEN 0.85e0 ELSE greatest(0.3e0, 0.85e0 - (total_cents - l.remaining)::DOUBLE / l.remaining * 2) END AS confidence
    FROM v_invoices i JOIN q_v_lists l ON l.company_id = i.company_id AND l.vendor_name = i.vendor_name AND l.remaining > 0 AND total_cents <= l.remaining * 1.15e0
    WHERE i.vendor_name <> '' AND NOT (coalesce(po_value, '') <> '' AND po_conf >= 0.85 AND po_status IN ('extracted', 'inferred'))),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, tier, ord, po_number) AS r FROM hits),
  top AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM ranked WHERE r <= 10)
  SELECT document_id, po_number, CASE WHEN n = 1 AND abs(total_cents - remaining) <= remaining * 0.02e0 THEN 'unique_vendor_amount' ELSE 'vendor_amount' END AS method,
    CASE WHEN n = 1 AND abs(total_cents - remaining) <= remaining * 0.02e0 THEN 0.95e0 ELSE confidence END AS confidence FROM top""")
def j10(fx):
    r = cand.resolve_for(fx.invoices, fx.vendors, MATCH_TOKENS)
    c = cand.by_vendor_amount(fx.invoices, r, fx.pos, fx.vendors, fx.source_records, cand.tenant_flags(fx.pos, fx.source_records))
    return c.select("document_id", "po_number", "method", "confidence")


@query("j11_candidates_fuzzy_po")
def j11(fx):
    inv = fx.invoices.filter("po_conf < 0.7 and po_value <> ''")
    return cand.by_fuzzy_number(inv, fx.pos, cand.tenant_flags(fx.pos, fx.source_records)).select("document_id", "po_number", "method", "confidence")


@query("j12_candidates_broadcast", """SELECT document_id, po_number, 'broadcast' AS method, 0.1e0 AS confidence FROM v_invoices i
  JOIN (SELECT company_id, po_number, row_number() OVER (PARTITION BY company_id ORDER BY po_number) AS r FROM v_pos WHERE status = 'open') p
    ON p.company_id = i.company_id AND r <= 20 WHERE po_value IS NULL""")
def j12(fx):
    return cand.by_broadcast(fx.invoices.filter("po_value is null"), fx.pos).select("document_id", "po_number", "method", "confidence")


def candidates(fx, policy=MATCH):
    prepared(fx)
    inv = fx.invoices
    r = stage(cand.resolve_for(inv, fx.vendors, policy))
    return cand.discover(with_refs(inv), r, fx.pos, fx.vendors, fx.po_references, fx.source_records, policy)


@query("j13_discover_candidates", "SELECT document_id, po_number, method, confidence, rank FROM q_candidates")
def j13(fx):
    return candidates(fx, MATCH_TOKENS).select("document_id", "po_number", "method", "confidence", F.col("rank").cast("bigint").alias("rank"))


@query("j13_discover_candidates_with_fuzzy")
def j13_full(fx):
    return candidates(fx).select("document_id", "po_number", "method", "confidence", "rank")


@query("j14_hide_seed_pos", """SELECT company_id, vendor_id, po_number FROM (SELECT p.*, bool_or(has_import AND import_derived) OVER (PARTITION BY p.company_id, vendor_id) AS hide
  FROM v_pos p JOIN q_flags f ON f.company_id = p.company_id) WHERE NOT hide OR import_derived""")
def j14(fx):
    return cand.hide_seed_orders(fx.pos, cand.tenant_flags(fx.pos, fx.source_records), ["company_id", "vendor_id"]).select(
        "company_id", "vendor_id", "po_number")


@query("j15_source_record_as_po", """SELECT po_number, coalesce(vendor_name, '') AS vendor_name, invoice_total AS total_amount, coalesce(currency, 'USD') AS currency,
  'open' AS status, 'blanket' AS po_type, coalesce(invoice_date::VARCHAR, '') AS issue_date FROM q_source_orders""")
def j15(fx):
    return cand.source_record_orders(fx.source_records).select(
        "po_number", "vendor_name", "total_amount", "currency", "status", "po_type",
        F.coalesce(F.col("issue_date").cast("string"), F.lit("")).alias("issue_date"))




# --- lines, scores, match state -------------------------------------------------------------------
AS_OF = "2000-01-01"

CTES["q_orders"] = """
  SELECT company_id, po_number, vendor_id, vendor_name, total_amount, previously_invoiced, currency, status, po_type, issue_date, expiry_date, import_derived FROM v_pos
  UNION ALL SELECT company_id, po_number, '', vendor_name, invoice_total, 0, currency, 'open', 'blanket', invoice_date, NULL, true FROM (
    SELECT company_id, po_number, coalesce(vendor_name, '') AS vendor_name, invoice_total, coalesce(currency, 'USD') AS currency, invoice_date,
           row_number() OVER (PARTITION BY company_id, po_number ORDER BY source_record_id) AS r FROM q_source_orders)
  WHERE r = 1 AND po_number NOT IN (SELECT po_number FROM v_pos)"""
CTES["q_il"] = f"SELECT document_id, line_no AS il, description AS d, {sql_word_set('key')} AS w, quantity::DOUBLE AS q, unit_price::DOUBLE AS p FROM (SELECT *, {sql_description_key('description')} AS key FROM v_invoice_lines)"
CTES["q_pl"] = f"SELECT po_number, line_number AS pl, description AS d, upper(sku) AS sku, {sql_word_set('key')} AS w, quantity::DOUBLE AS q, unit_price::DOUBLE AS p FROM (SELECT *, {sql_description_key('description')} AS key FROM v_po_lines)"
CTES["q_pairs"] = f"""
  SELECT c.document_id, c.po_number, i.il, l.pl, contains(upper(i.d), l.sku) AS sku_hit,
    CASE WHEN contains(upper(i.d), l.sku) THEN 0.4e0 ELSE 0e0 END + {sql_jaccard('i.w', 'l.w')} * 0.35e0
      + (least(i.q, l.q) / greatest(i.q, l.q)) * 0.15e0 + (least(i.p, l.p) / greatest(i.p, l.p)) * 0.10e0 AS s
  FROM q_candidates c JOIN q_il i ON i.document_id = c.document_id JOIN q_pl l ON l.po_number = c.po_number"""
CTES["q_options"] = """
  SELECT document_id, po_number, il, list({'s': s, 'n': -pl, 't': CASE WHEN sku_hit THEN 'exact' ELSE 'semantic' END}) AS opts FROM q_pairs GROUP BY ALL"""
CTES["q_assign"] = """ /*recursive*/
  SELECT document_id, po_number, 0::BIGINT AS il, []::BIGINT[] AS used, 0::BIGINT AS po_line, '' AS match_type, 0::BIGINT AS milli FROM q_options WHERE il = 1
  UNION ALL
  SELECT document_id, po_number, il, CASE WHEN best.s >= 0.25e0 THEN list_append(used, -best.n) ELSE used END,
         CASE WHEN best.s >= 0.25e0 THEN -best.n ELSE 0 END, CASE WHEN best.s >= 0.25e0 THEN best.t ELSE 'unmatched' END,
         floor(coalesce(best.s, 0e0) * 1000e0 + 0.5e0)::BIGINT
  FROM (SELECT a.document_id, a.po_number, o.il, a.used, list_max(list_filter(o.opts, lambda o: NOT list_contains(a.used, -o.n))) AS best
        FROM q_assign a JOIN q_options o ON o.document_id = a.document_id AND o.po_number = a.po_number AND o.il = a.il + 1)"""
CTES["q_maps"] = """
  SELECT c.document_id, c.po_number, i.il, coalesce(a.po_line, 0) AS po_line, coalesce(a.match_type, 'unmatched') AS match_type, coalesce(a.milli, 0) AS milli
  FROM q_candidates c JOIN q_il i ON i.document_id = c.document_id
  LEFT JOIN q_assign a ON a.document_id = c.document_id AND a.po_number = c.po_number AND a.il = i.il"""
CTES["q_cover"] = """
  SELECT document_id, po_number, count(*) AS n, count(*) FILTER (match_type <> 'unmatched') AS hit, coalesce(sum(milli) FILTER (match_type <> 'unmatched'), 0)::BIGINT AS milli
  FROM q_maps GROUP BY ALL"""
CTES["q_scored"] = f"""
  SELECT *, s_po + s_vendor + s_line + s_amount + s_date AS score FROM (
   SELECT document_id, po_number, method, rank, status, po_type, currency, remaining, total_cents, over, resolved_id, cand_vendor_id, coverage,
    CASE WHEN status = 'open' AND expiry_date < DATE '{AS_OF}' THEN 'expired_po' WHEN status IN ('closed', 'closed_for_invoicing') THEN 'closed_po,review_required'
         WHEN status = 'cancelled' THEN 'cancelled_po,escalation_required' ELSE '' END AS po_flags,
    floor(40e0 * CASE method WHEN 'exact' THEN 1.0e0 WHEN 'normalized' THEN 0.85e0 WHEN 'reference' THEN 0.75e0 WHEN 'vendor_search' THEN 0.55e0 WHEN 'vendor_name' THEN 0.5e0
       WHEN 'import_derived' THEN 0.55e0 WHEN 'source_record' THEN 0.55e0 WHEN 'source_record_invoice' THEN 0.65e0 ELSE 0.1e0 END * confidence * 10e0 + 0.5e0)::BIGINT AS s_po,
    CASE WHEN (resolved_id IS NOT NULL AND cand_vendor_id <> '' AND resolved_id = cand_vendor_id) OR same_name
         THEN floor(20e0 * CASE WHEN resolved_id IS NOT NULL AND resolved_conf > 0 THEN resolved_conf ELSE 0.9e0 END * 10e0 + 0.5e0)::BIGINT ELSE 0 END AS s_vendor,
    CASE WHEN hit > 0 THEN floor(20e0 * (hit::DOUBLE / n * 0.6e0 + milli::DOUBLE / hit / 1000e0 * 0.4e0) * 10e0 + 0.5e0)::BIGINT ELSE 0 END AS s_line,
    CASE WHEN total_cents IS NULL OR remaining <= 0 THEN 0 WHEN total_cents <= remaining THEN 100 WHEN (total_cents - remaining)::DOUBLE / remaining <= 0.05e0 THEN 50 ELSE 10 END AS s_amount,
    CASE WHEN days IS NULL THEN 0 WHEN days <= 30 THEN 50 WHEN days <= 90 THEN 35 WHEN days <= 180 THEN 20 ELSE 5 END AS s_date
   FROM (SELECT c.document_id, c.po_number, c.method, c.confidence, c.rank, o.status, o.po_type, o.currency, o.expiry_date, o.total_amount - o.previously_invoiced AS remaining, i.total_cents,
      coalesce(i.total_cents > o.total_amount - o.previously_invoiced, false) AS over, r.vendor_id AS resolved_id, r.confidence AS resolved_conf,
      coalesce(i.vendor_name <> '' AND o.vendor_name <> '' AND {sql_vendor_key('i.vendor_name')} = {sql_vendor_key('o.vendor_name')}, false) AS same_name,
      CASE WHEN r.vendor_id IS NOT NULL AND coalesce(i.vendor_name <> '' AND o.vendor_name <> '' AND {sql_vendor_key('i.vendor_name')} = {sql_vendor_key('o.vendor_name')}, false)
           THEN r.vendor_id ELSE coalesce(o.vendor_id, '') END AS cand_vendor_id,
      abs(datediff('day', i.invoice_date, o.issue_date)) AS days, coalesce(v.n, 0) AS n, coalesce(v.hit, 0) AS hit, coalesce(v.milli, 0) AS milli,
      CASE WHEN v.n > 0 THEN v.hit::DOUBLE / v.n ELSE 0e0 END AS coverage
    FROM q_candidates c JOIN v_invoices i ON i.document_id = c.document_id JOIN q_orders o ON o.company_id = c.company_id AND o.po_number = c.po_number
    LEFT JOIN q_resolved r ON r.company_id = i.company_id AND r.vendor_name = i.vendor_name
    LEFT JOIN q_cover v ON v.document_id = c.document_id AND v.po_number = c.po_number))"""
CTES["q_ranked"] = "SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, rank) AS pos FROM q_scored"
_FIT = "coalesce({r} > 0 AND total_cents <= {r} * (1 + {t}e0) AND {low}, false)"
_TIGHT = _FIT.format(r="remaining", t="0.02", low="total_cents >= remaining * (1 - 0.02e0)")
_VIABLE = "s_vendor >= 150 AND s_amount >= 80 AND NOT over AND " + _FIT.format(r="remaining", t="0.02", low="total_cents > 0")
CTES["q_gates"] = f"""
  SELECT i.document_id, i.company_id, i.vendor_name, i.total_cents, i.suggestion, i.presence, coalesce(n.n, 0) AS n_lines, c.* EXCLUDE (document_id, total_cents) FROM (
    SELECT *, NOT (coalesce(po_value, '') <> '' AND po_conf >= 0.85 AND po_status IN ('extracted', 'inferred')) OR presence = 'non_po' AS suggestion FROM (
      SELECT *, CASE WHEN po_value IS NULL OR po_status = 'not_found' OR trim(po_value) = '' OR lower(trim(po_value)) IN ('n/a','none','null','-') THEN 'non_po' ELSE 'po_invoice' END AS presence FROM v_invoices)) i
  LEFT JOIN (SELECT document_id, count(*) AS n FROM v_invoice_lines GROUP BY 1) n ON n.document_id = i.document_id
  LEFT JOIN (SELECT document_id, any_value(total_cents) AS total_cents, count(*) AS n_cands, max(score) FILTER (pos = 1) AS top_score, max(po_number) FILTER (pos = 1) AS top_po,
      max(score) FILTER (pos = 1) - coalesce(max(score) FILTER (pos = 2), 0) AS gap, max(s_vendor) FILTER (pos = 1) AS t_vendor, max(s_line) FILTER (pos = 1) AS t_line,
      max(s_amount) FILTER (pos = 1) AS t_amount, max(coverage) FILTER (pos = 1) AS t_cov, bool_or(over) FILTER (pos = 1) AS t_over,
      bool_or({_VIABLE}) FILTER (pos = 1) AS t_viable, bool_or({_FIT.format(r='remaining', t='0.15', low='total_cents > 0')}) FILTER (pos = 1) AS t_fit,
      count(*) FILTER (s_vendor > 0) AS n_vendor, count(*) FILTER ({_VIABLE}) AS n_unique, count(*) FILTER (s_vendor > 0 AND s_amount >= 80 AND {_TIGHT}) AS n_tight,
      bool_or(contains(po_flags, 'cancelled_po')) AS any_cancelled, bool_or(contains(po_flags, 'closed_po')) AS any_closed, bool_or(over) AS any_over
    FROM q_ranked GROUP BY document_id) c ON c.document_id = i.document_id"""
CTES["q_ambiguity"] = """
  SELECT *, CASE WHEN n_cands IS NULL THEN NULL
      WHEN total_cents IS NULL AND n_lines = 0 AND n_vendor >= 2 THEN 'multiple_candidates' WHEN n_tight >= 2 THEN 'ambiguous_match'
      WHEN g_unique OR g_evidence OR g_single THEN 'high_confidence_match'
      WHEN n_cands = 1 AND suggestion THEN suggest WHEN n_cands = 1 THEN CASE WHEN top_score >= 950 THEN 'matched' WHEN top_score >= 700 THEN 'high_confidence_match' ELSE 'unmatched' END
      WHEN gap < 50 THEN 'ambiguous_match' WHEN many = 'unmatched' AND suggestion THEN suggest ELSE many END AS ambiguity
  FROM (SELECT *, n_unique = 1 AND t_viable AS g_unique,
      coalesce(suggestion AND t_vendor >= 150 AND t_line >= 140 AND t_amount >= 80 AND t_cov >= 0.85e0 AND gap >= 100 AND NOT t_over, false) AS g_evidence,
      coalesce(suggestion AND n_vendor = 1 AND t_vendor >= 150 AND t_amount >= 80 AND NOT t_over AND t_fit, false) AS g_single,
      CASE WHEN top_score >= 350 THEN CASE WHEN presence = 'non_po' THEN 'suggested_po_match' ELSE 'waiting_for_po' END ELSE 'unmatched' END AS suggest,
      CASE WHEN top_score >= 950 THEN 'matched' WHEN top_score >= 850 OR (top_score >= 700 AND gap >= 150) THEN 'high_confidence_match' ELSE 'unmatched' END AS many FROM q_gates)"""
CTES["q_split_lines"] = """
  SELECT * FROM (SELECT m.document_id, m.il, m.po_number, row_number() OVER (PARTITION BY m.document_id, m.il ORDER BY m.milli DESC, r.pos) AS pick
    FROM q_maps m JOIN q_ranked r ON r.document_id = m.document_id AND r.po_number = m.po_number AND r.pos <= 5 WHERE m.match_type <> 'unmatched') WHERE pick = 1"""
CTES["q_split"] = """
  SELECT document_id, list(po_number ORDER BY il) AS pos_list, count(*) AS n FROM (SELECT document_id, po_number, min(il) AS il FROM q_split_lines GROUP BY ALL) GROUP BY 1"""
CTES["q_selected"] = """
  SELECT a.*, s.pos_list, coalesce(n_cands > 1 AND ambiguity IN ('high_confidence_match', 'matched', 'ambiguous_match') AND s.n > 1, false) AS multi,
    (SELECT list(po_number ORDER BY pos) FROM q_ranked r WHERE r.document_id = a.document_id AND pos <= CASE ambiguity WHEN 'multiple_candidates' THEN 5 WHEN 'ambiguous_match' THEN 2
        WHEN 'matched' THEN 1 WHEN 'high_confidence_match' THEN 1 ELSE 0 END) AS leaders
  FROM q_ambiguity a LEFT JOIN q_split s ON s.document_id = a.document_id"""
CTES["q_state0"] = """
  SELECT * REPLACE (CASE WHEN multi THEN 'high_confidence_match' ELSE ambiguity END AS ambiguity), CASE WHEN multi THEN pos_list ELSE coalesce(leaders, []) END AS selected FROM q_selected"""
CTES["q_unmatched"] = """
  SELECT document_id, list(il ORDER BY ord, il) AS lines FROM (SELECT m.document_id, m.il, min(list_position(s.selected, m.po_number)) AS ord FROM q_state0 s
    JOIN q_maps m ON m.document_id = s.document_id AND list_contains(s.selected, m.po_number) AND m.match_type = 'unmatched' WHERE NOT s.multi GROUP BY ALL) GROUP BY 1"""
CTES["q_state"] = """
  SELECT s.*, coalesce(u.lines, []) AS unmatched, o.po_type AS sel_type, s.selected[1] IN (SELECT po_number FROM v_grn) AS has_grn,
         (n_lines - len(coalesce(u.lines, [])))::DOUBLE / nullif(n_lines, 0) AS share
  FROM q_state0 s LEFT JOIN q_unmatched u ON u.document_id = s.document_id LEFT JOIN q_orders o ON o.company_id = s.company_id AND o.po_number = s.selected[1]"""
CTES["q_final"] = """
  SELECT *, CASE WHEN any_cancelled OR any_closed THEN 'closed_po_review' WHEN no_grn THEN 'waiting_for_grn' WHEN partial AND share >= 0.5e0 THEN 'partial_match'
      WHEN partial THEN 'unmatched' ELSE ambiguity END AS state,
    CASE WHEN any_cancelled THEN 'cancelled_po_exception' WHEN any_closed THEN 'closed_po_exception' WHEN no_grn THEN 'no_grn_record'
      WHEN partial THEN 'partial_match_' || len(unmatched) || '_unmatched' || CASE WHEN share >= 0.5e0 THEN ',partial_invoice' ELSE '' END
      WHEN any_over THEN 'overbilling_warning' ELSE '' END AS state_flags
  FROM (SELECT *, NOT coalesce(has_grn, false) AND ambiguity IN ('matched', 'high_confidence_match') AND coalesce(sel_type, 'standard') = 'standard' AND n_lines > 0 AS no_grn,
               len(unmatched) > 0 AND n_lines > 0 AND share > 0 AND share < 1 AS partial FROM q_state)"""
CTES["q_match"] = """
  SELECT f.company_id, f.document_id, f.selected, f.suggestion, f.multi, f.n_lines, f.top_score, f.n_cands, f.unmatched, f.ambiguity, f.total_cents,
    CASE WHEN e.matchable = '' THEN 'no_matching_evidence' WHEN n_cands IS NULL THEN CASE WHEN suggestion AND coalesce(f.vendor_name, '') <> '' THEN 'unmatched' WHEN presence <> 'non_po' THEN 'waiting_for_po' ELSE 'non_po_workflow' END
         WHEN suggestion AND presence = 'non_po' AND len(selected) = 0 THEN 'suggested_po_match' ELSE state END AS match_status,
    CASE WHEN e.matchable = '' THEN '' WHEN n_cands IS NULL THEN 'po_not_found' ELSE state_flags END AS flags,
    CASE WHEN n_cands IS NULL THEN '' WHEN suggestion AND presence = 'non_po' AND len(selected) = 0 THEN 'suggestion' WHEN len(selected) = 0 THEN ''
         WHEN NOT suggestion AND presence = 'po_invoice' THEN 'authoritative_po' WHEN ambiguity IN ('matched', 'high_confidence_match') THEN 'evidence' ELSE 'suggestion' END AS provenance,
    CASE WHEN n_cands IS NULL THEN 'unresolved' WHEN r.vendor_id IS NOT NULL THEN 'master_hit' WHEN len(selected) > 0 AND t.s_vendor > 0 AND t.cand_vendor_id <> '' THEN 'po_aligned' ELSE 'unresolved' END AS vendor_master_status,
    coalesce(r.vendor_id, CASE WHEN len(selected) > 0 AND t.s_vendor > 0 AND t.cand_vendor_id <> '' THEN t.cand_vendor_id END, '') AS vendor_id, t.cand_vendor_id AS cand_vendor
  FROM q_final f JOIN q_evidence e ON e.document_id = f.document_id LEFT JOIN q_resolved r ON r.company_id = f.company_id AND r.vendor_name = f.vendor_name
  LEFT JOIN q_scored t ON t.document_id = f.document_id AND t.po_number = f.selected[1]"""


def masters(fx):
    lines = fx.po_lines.join(fx.pos.select("company_id", "po_number"), "po_number")
    return mat.Masters(fx.vendors, fx.pos, lines, fx.grn, fx.po_references, fx.source_records)


def prepared(fx):
    return fx.staged("vendors", "pos", "po_lines", "invoices", "invoice_lines", "grn", "source_records")


def scored(fx, policy=MATCH_TOKENS):
    prepared(fx)
    return fx.memo(f"scored_{policy.similarity}", lambda: mat.scored_pairs(
        with_refs(fx.invoices), fx.invoice_lines, masters(fx), AS_OF, policy))


def packages(fx, policy=MATCH_TOKENS):
    n = fx.invoice_lines.groupBy("company_id", "document_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return fx.memo(f"packages_{policy.similarity}", lambda: mat.match_package(
        with_refs(fx.invoices).join(evidence(fx).select("company_id", "document_id", "can_match"), ["company_id", "document_id"]),
        scored(fx, policy), n, masters(fx), cand.resolve_for(fx.invoices, fx.vendors, policy), policy))


def own_pairs(fx):
    """Each invoice against the order it stems from."""
    return fx.invoices.select("company_id", "document_id", F.col("true_po").alias("po_number"))


@query("l2_description_similarity")
def l2(fx):
    i = fx.invoice_lines.select("company_id", "document_id", "line_no", txt.description_key("description").alias("a"))
    p = fx.po_lines.select("po_number", "line_number", txt.description_key("description").alias("b"))
    x = i.join(own_pairs(fx), ["company_id", "document_id"]).join(p, "po_number")
    # few pairs of texts recur: sorting them out by two more shuffles cost more than the ratios, which a batch works out once each
    similarity = txt.jaccard(txt.word_set("a"), txt.word_set("b")) * 0.5 + sequence_ratio("a", "b") * 0.5
    return x.select("document_id", "line_no", "line_number", similarity.alias("similarity"))


_OWN = "own AS (SELECT document_id, true_po AS po_number FROM v_invoices)"


@query("l3_line_pair_score", f"""WITH {_OWN} SELECT o.document_id, i.il AS line_no, l.pl AS line_number, contains(upper(i.d), l.sku) AS sku_hit,
    CASE WHEN contains(upper(i.d), l.sku) THEN 0.4e0 ELSE 0e0 END + {sql_jaccard('i.w', 'l.w')} * 0.35e0
      + (least(i.q, l.q) / greatest(i.q, l.q)) * 0.15e0 + (least(i.p, l.p) / greatest(i.p, l.p)) * 0.10e0 AS score
  FROM own o JOIN q_il i ON i.document_id = o.document_id JOIN q_pl l ON l.po_number = o.po_number""")
def l3(fx):
    prepared(fx)
    i = ln.line_arrays(fx.invoice_lines, "document_id", "line_no", False).withColumnRenamed("lines", "inv_lines")
    p = ln.line_arrays(masters(fx).po_lines, "po_number", "line_number", True).withColumnRenamed("lines", "po_lines")
    x = own_pairs(fx).join(i, ["company_id", "document_id"]).join(p, ["company_id", "po_number"])
    x = ln.score_matrix(x, MATCH_TOKENS).select("document_id", F.posexplode("scores").alias("x", "row"), "inv_lines")
    x = x.select("document_id", F.expr("inv_lines[x].no").alias("line_no"), F.explode("row").alias("o"))
    return x.select("document_id", "line_no", (-F.col("o.n")).alias("line_number"), (F.col("o.t") == "exact").alias("sku_hit"), F.col("o.s").alias("score"))


@query("l4_assign_lines", "SELECT document_id, po_number, il AS line_no, po_line, match_type, milli FROM q_maps")
def l4(fx):
    return scored(fx).select("document_id", "po_number", F.explode("maps").alias("m")).select(
        "document_id", "po_number", F.col("m.invoice_line").alias("line_no"), "m.po_line", "m.match_type", "m.milli")


@query("l4_assign_lines_with_sequence_ratio")
def l4_full(fx):
    prepared(fx)
    return ln.match_lines(own_pairs(fx), fx.invoice_lines, masters(fx).po_lines).select("document_id", "po_number", F.explode("maps").alias("m")).select(
        "document_id", "po_number", F.col("m.invoice_line").alias("line_no"), "m.po_line", "m.match_type", "m.milli")


@query("l5_line_coverage", "SELECT document_id, po_number, coverage FROM q_scored")
def l5(fx):
    return scored(fx).select("document_id", "po_number", "coverage")


@query("l6_resolve_multi_po", "SELECT document_id, array_to_string(pos_list, ',') AS pos, n AS n_pos FROM q_split")
def l6(fx):
    x = mat.ranked_candidates(scored(fx)).withColumn("s", ln.resolve_multi_po(F.col("cands")))
    return x.filter(F.size("s") > 0).select("document_id", F.array_join(F.transform("s", lambda o: o["po_number"]), ",").alias("pos"), F.size("s").cast("bigint").alias("n_pos"))


@query("l7_check_balance", """SELECT document_id, CASE WHEN total_cents > r THEN 'potential_overbilling,overage_' || ((total_cents - r) // 100) || '.' || lpad(((total_cents - r) % 100)::VARCHAR, 2, '0') ELSE '' END AS flags
  FROM (SELECT document_id, total_cents, total_amount - previously_invoiced AS r FROM v_invoices i JOIN v_pos p ON p.po_number = i.true_po)""")
def l7(fx):
    p = fx.pos.selectExpr("po_number as true_po", "total_amount - previously_invoiced as r")
    return fx.invoices.join(p, "true_po").select("document_id", F.array_join(ln.balance_flags(F.col("total_cents"), F.col("r")), ",").alias("flags"))


@query("l7_line_quantity_flags", """SELECT document_id, true_po AS po_number, string_agg('line_' || l.line_number || '_qty_exceeded', ',' ORDER BY 'line_' || l.line_number || '_qty_exceeded') AS flags
  FROM v_invoices i JOIN v_po_lines l ON l.po_number = i.true_po WHERE l.quantity > l.quantity - l.quantity * (i.k % 3) // 4 + 1e-6 GROUP BY 1, 2""")
def l7_lines(fx):
    pl = masters(fx).po_lines.withColumn("invoiced_quantity", F.expr("quantity * (k % 3) div 4"))
    alloc = own_pairs(fx).join(pl, ["company_id", "po_number"]).selectExpr("company_id", "document_id", "po_number", "line_number as po_line", "quantity as allocated_quantity")
    return ln.quantity_flags(alloc, pl).select("document_id", "po_number", "flags")


def _part(name, column):
    @query(name, f"SELECT document_id, po_number, {column} AS points_x10 FROM q_scored")
    def part(fx):
        return scored(fx).select("document_id", "po_number", F.col(column).alias("points_x10"))
    return part


for _name, _column in (("s1_score_po", "s_po"), ("s2_score_vendor", "s_vendor"), ("s3_score_lines", "s_line"),
                       ("s4_score_amount", "s_amount"), ("s5_score_date", "s_date")):
    _part(_name, _column)


@query("s6_score_candidates", "SELECT document_id, po_number, method, score AS score_x10, pos, over FROM q_ranked")
def s6(fx):
    x = mat.ranked_candidates(scored(fx)).select("document_id", F.posexplode("cands").alias("i", "c"))
    return x.select("document_id", "c.po_number", "c.method", F.col("c.score").alias("score_x10"), (F.col("i") + 1).cast("bigint").alias("pos"), "c.over")


@query("s7_structured_signals", """SELECT document_id, po_number, 'po_reference:' || CASE WHEN s_po > 0 THEN 'match' ELSE 'not_available' END || '|vendor:' || CASE WHEN s_vendor >= 150 THEN 'exact_match' ELSE 'weak' END
  || '|amount:' || CASE WHEN s_amount >= 80 THEN 'exact_remaining_balance' ELSE 'weak' END || '|line_match:' || CASE WHEN coverage >= 0.85e0 THEN 'match' WHEN coverage > 0 THEN 'partial' ELSE 'not_available' END
  || '|balance:' || CASE WHEN over THEN 'over_invoice' ELSE 'within_balance' END AS signals FROM q_scored""")
def s7(fx):
    sig = F.transform(sc.structured_signals(), lambda s: F.concat_ws(":", s["signal"], s["status"]))
    return scored(fx).select("document_id", "po_number", F.array_join(sig, "|").alias("signals"))


def gated(fx):
    inv = with_refs(fx.invoices)
    n = fx.invoice_lines.groupBy("company_id", "document_id").agg(F.count(F.lit(1)).alias("n_lines"))
    x = inv.withColumns({"presence": fld.po_presence(), "suggestion": fld.suggestion_mode() | (fld.po_presence() == "non_po")})
    x = x.join(n, ["company_id", "document_id"], "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    x = x.join(mat.ranked_candidates(scored(fx)), ["company_id", "document_id"])
    return mat.detect_ambiguity(mat.gate_columns(x))


@query("m1_m5_match_gates", """SELECT document_id, coalesce(n_unique = 1 AND t_viable, false) AS g_unique, n_tight >= 2 AS g_ambiguous, (total_cents IS NULL AND n_lines = 0 AND n_vendor >= 2) AS g_vendor_only,
  g_evidence, g_single, gap AS gap_x10, n_cands AS n FROM q_ambiguity WHERE n_cands IS NOT NULL""")
def m1_m5(fx):
    return gated(fx).select("document_id", "g_unique", "g_ambiguous", "g_vendor_only", "g_evidence", "g_single",
                            F.col("gap").alias("gap_x10"), F.col("n_cands").cast("bigint").alias("n"))


@query("m6_detect_ambiguity", "SELECT document_id, ambiguity FROM q_ambiguity WHERE n_cands IS NOT NULL")
def m6(fx):
    return gated(fx).select("document_id", "ambiguity")


@query("m7_final_match_state", "SELECT document_id, match_status, flags, array_to_string(unmatched, ',') AS unmatched FROM q_match")
def m7(fx):
    return packages(fx).select("document_id", "match_status", F.array_join("flags", ",").alias("flags"), F.array_join(F.col("unmatched_lines").cast("array<string>"), ",").alias("unmatched"))


def package_columns(x):
    return x.select("document_id", "match_status", F.array_join(F.transform("matched_pos", lambda p: p["po_number"]), ",").alias("matched_pos"), "candidate_count",
                    F.array_join("flags", ",").alias("flags"), "provenance", "vendor_master_status", F.coalesce("vendor_id", F.lit("")).alias("vendor_id"))


@query("m8_match_package", """SELECT document_id, match_status, array_to_string(selected, ',') AS matched_pos, coalesce(n_cands, 0) AS candidate_count, flags, provenance, vendor_master_status, vendor_id FROM q_match""")
def m8(fx):
    return package_columns(packages(fx))


@query("m8_suggested_candidates", """SELECT r.document_id, r.pos, r.po_number, r.score AS score_x10 FROM q_ranked r JOIN q_match m ON m.document_id = r.document_id
  WHERE r.pos <= 10 AND m.match_status <> 'no_matching_evidence'""")
def m8_suggested(fx):
    x = packages(fx).select("document_id", F.posexplode("suggested_pos").alias("i", "c"))
    return x.select("document_id", (F.col("i") + 1).cast("bigint").alias("pos"), "c.po_number", F.col("c.score").alias("score_x10"))


@query("m8_match_package_with_fuzzy")
def m8_full(fx):
    return package_columns(packages(fx, MATCH))


@query("m9_match_explanation", """SELECT m.document_id, m.match_status, CASE WHEN m.match_status IN ('matched', 'high_confidence_match') AND len(selected) = 1 THEN 'One open PO uniquely matched the available evidence.'
    WHEN m.match_status = 'no_matching_evidence' THEN 'Extraction was unable to provide enough information for PO matching.'
    WHEN m.match_status IN ('ambiguous_match', 'multiple_candidates') THEN 'Available evidence was insufficient to distinguish PO candidates.'
    WHEN m.match_status = 'unmatched' AND coalesce(v.n, 0) = 0 THEN 'No open PO matched the extracted evidence.'
    WHEN m.match_status = 'waiting_for_po' THEN 'PO reference or evidence insufficient for confident match.'
    WHEN m.match_status = 'suggested_po_match' THEN 'No PO on invoice — suggested PO match available for confirmation.' ELSE 'PO resolution outcome: ' || m.match_status END AS summary,
  coalesce(n_cands, 0) AS candidate_count, coalesce(v.n, 0) AS viable,
  CASE WHEN m.match_status IN ('matched', 'high_confidence_match', 'partial_match') THEN 'validation' WHEN m.match_status IN ('ambiguous_match', 'unmatched', 'no_matching_evidence', 'multiple_candidates', 'waiting_for_po', 'suggested_po_match') THEN 'human_review' ELSE '' END AS next_stage
  FROM q_match m LEFT JOIN (SELECT document_id, count(*) AS n FROM q_scored WHERE score > 0 OR s_vendor > 0 GROUP BY 1) v ON v.document_id = m.document_id""")
def m9(fx):
    return mat.match_explanation(packages(fx)).drop("details", "available", "missing")


_D = mat.DETAILS
_AROUND = "concat_ws(' ', CASE WHEN e.available <> '' THEN 'Available: ' || replace(e.available, ',', ', ') END, '{text}', CASE WHEN e.missing <> '' THEN 'Missing: ' || replace(e.missing, ',', ', ') END)"


@query("m9_match_explanation_details", f"""SELECT m.document_id, e.available, e.missing, CASE WHEN m.match_status = 'no_matching_evidence' THEN {_AROUND.format(text=_D['no_candidates'])}
    WHEN m.match_status IN ('matched', 'high_confidence_match') AND len(selected) = 1 THEN concat_ws(' ', 'Matched PO: ' || selected[1], CASE WHEN t.s_vendor > 0 THEN '{_D['vendor']}' END,
      CASE WHEN t.s_amount > 0 THEN '{_D['amount']}' END, CASE WHEN t.s_line > 0 THEN '{_D['lines']}' END, CASE WHEN t.method = 'source_record_po_hint' THEN '{_D['hint']}' END, '{_D['no_contradiction']}')
    WHEN m.match_status IN ('ambiguous_match', 'multiple_candidates') THEN concat_ws(' ', 'PO matching found ' || coalesce(v.n, 0) || ' viable candidate(s).', v.lines)
    WHEN m.match_status = 'unmatched' AND coalesce(v.n, 0) = 0 THEN {_AROUND.format(text=_D['none_viable'])}
    WHEN m.match_status = 'waiting_for_po' THEN 'Ranked ' || coalesce(n_cands, 0) || ' candidate(s) for human review.'
    WHEN m.match_status = 'suggested_po_match' THEN 'Ranked ' || coalesce(n_cands, 0) || ' candidate(s) by vendor, amount, and lines.' ELSE '' END AS details
  FROM q_match m JOIN q_evidence e ON e.document_id = m.document_id LEFT JOIN q_ranked t ON t.document_id = m.document_id AND t.pos = 1
  LEFT JOIN (SELECT document_id, count(*) AS n, string_agg('Candidate: ' || po_number || ' (score ' || round(score / 10e0)::BIGINT || ')', ' ' ORDER BY pos) FILTER (w <= 5) AS lines
    FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS w FROM q_ranked WHERE score > 0 OR s_vendor > 0) GROUP BY 1) v ON v.document_id = m.document_id""")
def m9_details(fx):
    x = mat.match_explanation(packages(fx), evidence(fx))
    return x.select("document_id", F.array_join("available", ",").alias("available"), F.array_join("missing", ",").alias("missing"), F.array_join("details", " ").alias("details"))


CTES["q_answers"] = """SELECT document_id, action, po_number, actor FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY acted_at DESC) AS r FROM v_confirmations) WHERE r = 1"""


@query("m10_confirm_po", """SELECT i.document_id, c.po_number, 'matched' AS match_status, 'human_confirmed' AS provenance, p.vendor_id,
    CASE WHEN i.total_cents > p.total_amount - p.previously_invoiced THEN 'potential_overbilling' ELSE '' END AS flag, 'Human confirmed PO ' || c.po_number || ' by ' || c.actor AS evidence
  FROM v_invoices i JOIN q_answers c ON c.document_id = i.document_id AND c.action = 'confirm' JOIN v_pos p ON p.po_number = c.po_number AND p.company_id = i.company_id""")
def m10(fx):
    prepared(fx)
    x = mat.confirm_po(fx.invoices, fx.invoice_lines, masters(fx), fx.confirmations, AS_OF)
    return x.select("document_id", "po_number", "match_status", "provenance", "vendor_id", F.coalesce(F.try_element_at("flags", F.lit(1)), F.lit("")).alias("flag"), "evidence")


@query("m11_reject_suggestions", """SELECT m.document_id, CASE WHEN c.action = 'reject' THEN 'po_suggestions_rejected' ELSE match_status END AS match_status,
  CASE WHEN c.action = 'reject' THEN '' ELSE array_to_string(selected, ',') END AS matched_pos FROM q_match m LEFT JOIN q_answers c ON c.document_id = m.document_id""")
def m11(fx):
    return mat.reject_suggestions(packages(fx), fx.confirmations).select(
        "document_id", "match_status", F.array_join(F.transform("matched_pos", lambda p: p["po_number"]), ",").alias("matched_pos"))
