"""Domain views over the given test tables (see FIXTURES.md): vendors, orders, receipts, invoices ...

Each view is a lazy DataFrame derived from the parquet tables, so its size follows theirs.  Money is
BIGINT cents.  `k` is the order key an invoice or PO stems from; `scn` picks the invoice scenario.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paymatch.functions.text import vendor_key
from paymatch.plans.runtime import stage

# --- fixed values: generated vendor names ---------------------------------------------------------
WORD1 = ("Northwind", "Acme", "Global", "Pioneer", "Harbor", "Summit", "Rogers", "Delta")
WORD2 = ("Steel", "Paper", "Freight", "Office", "Chemical")
SUFFIX = (", Inc.", " LLC", " Ltd", "")


def _pick(values, index: str) -> str:
    items = ",".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"element_at(array({items}), cast({index} as int) + 1)"


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._staged: set[str] = set()
        self._memo: dict[str, DataFrame] = {}

    def memo(self, name: str, build) -> DataFrame:
        """A derived result that several queries of one session share, written once."""
        if name not in self._memo:
            self._memo[name] = stage(build())
        return self._memo[name]

    def staged(self, *names: str) -> "Fixtures":
        """Write the named views once for plans that read them many times over."""
        for name in names:
            if name not in self._staged:
                self.__dict__[name] = stage(getattr(self, name))
                self._staged.add(name)
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def vendors(self) -> DataFrame:
        s = self.table("supplier").select(F.col("s_suppkey").alias("s"))
        w1, w2 = _pick(WORD1, "s % 8"), _pick(WORD2, "(s div 8) % 5")
        return s.selectExpr(
            "concat('C', s % 3) as company_id",
            "concat('V', lpad(cast(s as string), 5, '0')) as vendor_id",
            f"concat({w1}, ' ', {w2}, ' ', s, {_pick(SUFFIX, 's % 4')}) as name",
            f"case when s % 6 = 0 then array(concat({w2}, ' ', {w1}, ' ', s)) "
            "else cast(array() as array<string>) end as aliases",
            "case when s % 17 = 0 then 'suspended' when s % 13 = 0 then 'inactive' else 'active' end as status",
            "concat('TAX', s) as tax_id", "concat('SUP', s) as supplier_code", "s",
        ).withColumn("normalized_name", vendor_key("name"))

    @cached_property
    def po_lines(self) -> DataFrame:
        w = W.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        li = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_linenumber", "l_suppkey", "l_shipdate")
        li = li.withColumn("line_number", F.row_number().over(w).cast("bigint"))
        part = self.table("part").select("p_partkey", "p_name", "p_type", "p_size")
        return li.join(part, li.l_partkey == part.p_partkey).selectExpr(
            "concat('PO-', lpad(cast(l_orderkey as string), 7, '0')) as po_number", "line_number",
            "concat(p_name, ' ', p_type, ' ', p_size) as description", "concat('SKU-', p_partkey) as sku",
            "cast(l_quantity as bigint) as quantity",
            "floor(l_extendedprice * 100e0 / l_quantity + 0.5e0) as unit_price",
            "floor(l_extendedprice * 100e0 / l_quantity + 0.5e0) * cast(l_quantity as bigint) as amount",
            "l_orderkey as k",
        )

    @cached_property
    def po_totals(self) -> DataFrame:
        li = self.table("lineitem").selectExpr(
            "l_orderkey", "floor(l_extendedprice * 100e0 / l_quantity + 0.5e0) * cast(l_quantity as bigint) as amount")
        return li.groupBy("l_orderkey").agg(F.sum("amount").alias("total_amount"))

    @cached_property
    def pos(self) -> DataFrame:
        n_vendors = self.table("supplier").select(F.count(F.lit(1))).scalar()
        o = self.table("orders").withColumn("s", F.col("o_custkey") % n_vendors)
        o = o.join(self.po_totals, o.o_orderkey == F.col("l_orderkey"))
        v = self.vendors.select("s", "company_id", "vendor_id", "name")
        return o.join(v, "s").selectExpr(
            "company_id", "concat('PO-', lpad(cast(o_orderkey as string), 7, '0')) as po_number", "vendor_id",
            "case when o_orderkey % 17 = 5 then concat('Legacy ', s) else name end as vendor_name",
            "total_amount",
            "case when o_orderkey % 20 = 0 then 'closed' when o_orderkey % 29 = 0 then 'cancelled' "
            "when o_orderkey % 31 = 0 then 'closed_for_invoicing' else 'open' end as status",
            "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'blanket' else 'standard' end as po_type",
            "floor(total_amount * (o_orderkey % 4) / 4) as previously_invoiced",
            "to_date(o_orderdate) as issue_date",
            "case when o_orderkey % 47 = 0 then date_add(to_date(o_orderdate), 30) end as expiry_date",
            "'USD' as currency", "s % 3 = 2 and o_orderkey % 9 = 0 as import_derived",
            "o_orderkey as k", "s", "name as master_name",
        )

    @cached_property
    def grn(self) -> DataFrame:
        """One receipt per received PO line."""
        li = self.po_lines.filter("k % 5 <> 0 and (k + line_number) % 3 <> 0")
        return li.join(self.pos.select("po_number", "company_id"), "po_number").selectExpr(
            "company_id", "concat('GRN-', k, '-', line_number) as grn_id", "po_number", "amount as received_amount")

    @cached_property
    def po_references(self) -> DataFrame:
        return self.pos.filter("k % 13 < 2").selectExpr(
            "company_id", "po_number", "'order_ref' as reference_type", "concat('ORD-', k) as reference_value")

    @cached_property
    def invoices(self) -> DataFrame:
        p = self.pos.withColumns({
            "scn": F.expr("(k div 3) % 12"), "remaining": F.col("total_amount") - F.col("previously_invoiced")})
        p = p.withColumn("total0", F.expr(
            "case scn when 0 then remaining when 5 then remaining * 101 div 100 when 6 then remaining * 104 div 100 "
            "when 7 then remaining * 120 div 100 when 9 then 500000 when 11 then 990000 else remaining div 2 end"))
        p = p.withColumn("subtotal0", F.expr(
            "case when scn = 8 then (total0 * 10 + 6) div 12 else (total0 * 100 + 54) div 108 end"))
        return p.selectExpr(
            "company_id", "concat('DOC-', lpad(cast(k as string), 7, '0')) as document_id",
            "case when k % 37 = 0 then null when k % 41 = 0 then 'A1' "
            "else concat('INV-', lpad(cast(k as string), 7, '0')) end as invoice_number",
            "case when k % 37 = 0 then 0e0 else 0.95e0 end as number_conf",
            "case when k % 37 = 0 then 'not_found' when k % 43 = 0 then 'uncertain' else 'extracted' end as number_status",
            "case when k % 71 = 0 or k % 83 = 0 then null "
            "when k % 11 = 3 then replace(replace(master_name, 'or', 'r'), 'al', 'a1') "
            "when k % 11 = 5 then upper(replace(master_name, ',', '')) "
            f"when k % 11 = 7 and s % 6 = 0 then concat({_pick(WORD2, '(s div 8) % 5')}, ' ', "
            f"{_pick(WORD1, 's % 8')}, ' ', s) else master_name end as vendor_name",
            "case when k % 71 = 0 or k % 83 = 0 then 0e0 when k % 7 = 3 then 0.8e0 else 0.95e0 end as vendor_conf",
            "case when k % 71 = 0 or k % 83 = 0 then 'not_found' when k % 61 = 0 then 'uncertain' else 'extracted' end as vendor_status",
            "case when k % 83 = 0 then null when scn = 1 then replace(po_number, '-', case when k % 2 = 0 then '' else '.' end) when scn = 2 then null when scn = 3 then 'N/A' "
            "when scn = 4 then concat(substring(po_number, 1, 9), 'X') else po_number end as po_value",
            "case when scn in (2, 3) or k % 83 = 0 then 0e0 when scn = 4 then 0.6e0 else 0.95e0 end as po_conf",
            "case when scn = 2 or k % 83 = 0 then 'not_found' else 'extracted' end as po_status",
            "case when k % 53 = 0 then null else date_add(issue_date, cast(k % 200 as int)) end as invoice_date",
            "case when k % 53 = 0 then 0e0 else 0.88e0 end as date_conf",
            "case when k % 53 = 0 then 'not_found' else 'extracted' end as date_status",
            "case when k % 59 = 0 then null else 'USD' end as currency",
            "case when k % 59 = 0 then 0e0 else 0.9e0 end as currency_conf",
            "case when k % 59 = 0 then 'not_found' when k % 3 = 0 then 'inferred' else 'extracted' end as currency_status",
            "subtotal0 - case when k % 16 = 0 then 1500 else 0 end as subtotal_cents", "0.95e0 as subtotal_conf",
            "case when k % 73 = 0 then 0 else total0 - subtotal0 "
            "- case when k % 29 = 0 then 6000 when k % 31 = 0 then 700 else 0 end end as tax_cents", "0.95e0 as tax_conf",
            "case when k % 67 = 0 or k % 83 = 0 then null else total0 end as total_cents",
            "case when k % 67 = 0 or k % 83 = 0 then 0e0 when k % 19 = 0 then 0.8e0 when k % 5 = 2 then 0.92e0 else 0.97e0 end as total_conf",
            "case when k % 67 = 0 or k % 83 = 0 then 'not_found' else 'extracted' end as total_status",
            "case when k % 13 = 0 and k % 83 <> 0 then concat('ORD-', k) end as ref_value",
            "timestamp_seconds(1709251200 + (k * 7919) % 100003) as arrival_ts",
            "k", "scn", "po_number as true_po",
        )

    @cached_property
    def invoice_lines(self) -> DataFrame:
        inv = self.invoices.select("company_id", "document_id", F.col("true_po").alias("po_number"), "scn")
        return self.po_lines.join(inv, "po_number").filter("not (scn % 3 = 1 and line_number % 4 = 0) and k % 83 <> 0").selectExpr(
            "company_id", "document_id",
            "case when scn % 3 = 1 then line_number - line_number div 4 else line_number end as line_no",
            "concat(description, case when scn % 2 = 1 then ' item' else '' end, "
            "case when k % 3 = 0 then concat(' ', sku) else '' end) as description",
            "quantity", "case when scn = 6 then unit_price * 105 div 100 else unit_price end as unit_price",
            "quantity * (case when scn = 6 then unit_price * 105 div 100 else unit_price end) "
            "+ case when k % 23 = 0 and line_number = 1 then 100 else 0 end as amount",
        )

    @cached_property
    def charges(self) -> DataFrame:
        inv = self.invoices.select("document_id", "k")
        return inv.filter("k % 8 = 0").selectExpr(
            "document_id", "'Shipping & Handling' as label", "cast(1500 as bigint) as amount").unionByName(
            inv.filter("k % 24 = 0").selectExpr(
                "document_id", "'Loyalty discount' as label", "cast(500 as bigint) as amount"))

    @cached_property
    def prior_runs(self) -> DataFrame:
        return self.invoices.filter("scn = 10").selectExpr(
            "company_id", "concat(document_id, '-P') as document_id", "vendor_name",
            "case when k % 4 = 1 then concat(invoice_number, 'X') else invoice_number end as invoice_number",
            "total_cents + case when k % 4 = 2 then 500 else 0 end as total_cents",
            "date_add(invoice_date, cast(k % 6 as int)) as invoice_date",
            "case when k % 5 = 1 then '' when k % 3 = 0 then 'AUTO_APPROVED' when k % 3 = 1 then 'REJECT' "
            "else 'APPROVAL_REQUIRED' end as decision",
            "case when k % 7 = 0 then 'BLOCKED' else 'VALIDATED' end as stage3_status",
            "timestamp_seconds(1706745600 + k % 1000) as arrival_ts", "k")

    @cached_property
    def allocations(self) -> DataFrame:
        return self.invoices.filter("scn = 10 and k % 2 = 0").selectExpr(
            "company_id", "concat(document_id, '-P') as document_id", "true_po as po_number", "total_cents as amount")

    @cached_property
    def source_records(self) -> DataFrame:
        return self.invoices.filter("company_id = 'C2'").selectExpr(
            "company_id", "concat('SR', lpad(cast(k as string), 7, '0')) as source_record_id", "vendor_name",
            "invoice_number", "invoice_date", "total_cents as invoice_total", "currency",
            "case when k % 14 = 0 then null when k % 7 = 3 then concat('EXT-', k) else true_po end as po_reference",
            "timestamp_seconds(1704067200 + (k * 31) % 9973) as created_at", "k")

    @cached_property
    def runs(self) -> DataFrame:
        """Finished runs, one row per invoice, with a plausible end state per scenario."""
        return self.invoices.selectExpr(
            "company_id", "document_id", "arrival_ts",
            "case when k % 67 = 0 then 'extraction_failed' when scn in (2, 3, 4) then 'needs_human_review' "
            "else 'stage1_passed' end as status",
            "cast(k % 900 as bigint) * 10 as processing_ms",
            "case when k % 29 = 0 then 'residual_review' when k % 16 = 0 then 'reconciled_with_inferred_charges' "
            "else 'reconciled' end as reconciliation_status",
            "case when k % 83 = 0 then 'extraction_weak' when scn in (2, 3) then 'extraction_partial' "
            "else 'extraction_complete' end as extraction_quality",
            "case scn when 0 then 'high_confidence_match' when 2 then 'suggested_po_match' "
            "when 3 then 'ambiguous_match' when 4 then 'waiting_for_po' when 10 then 'partial_match' "
            "when 11 then 'no_matching_evidence' else 'high_confidence_match' end as stage2_status",
            "case scn when 6 then 'HOLD' when 7 then 'HOLD' when 9 then 'REVIEW_REQUIRED' when 10 then 'BLOCKED' "
            "when 5 then 'VALIDATION_INCOMPLETE' when 2 then '' when 3 then '' when 4 then '' "
            "else 'VALIDATED' end as stage3_status",
            "case scn when 6 then 'HIGH_PRIORITY_REVIEW' when 7 then 'STANDARD_REVIEW' when 9 then 'FRAUD_REVIEW' "
            "when 10 then 'TERMINAL_REJECT' when 5 then 'WAITING_FOR_GRN' when 2 then '' when 3 then '' when 4 then '' "
            "when 8 then 'APPROVAL_REQUIRED' else 'AUTO_APPROVED' end as stage4_status",
            "case scn when 6 then 'REVIEW_REQUIRED' when 7 then 'REVIEW_REQUIRED' when 9 then 'REVIEW_REQUIRED' "
            "when 10 then 'REJECT' when 5 then 'WAITING_FOR_VALIDATION' when 2 then '' when 3 then '' when 4 then '' "
            "else 'APPROVE' end as stage4_decision",
            "cast(k % 100 as double) / 100 as quality_score", "k")

    @cached_property
    def confirmations(self) -> DataFrame:
        """Human answers to PO suggestions; a later answer overrides an earlier one."""
        inv = self.invoices.filter("scn in (2, 3, 4)")
        first = inv.selectExpr(
            "document_id", "case when k % 3 = 0 then 'reject' else 'confirm' end as action",
            "case when k % 3 <> 0 then true_po end as po_number", "'ap-clerk' as actor",
            "timestamp_seconds(1709424000 + k % 5000) as acted_at", "k")
        second = first.filter("k % 4 = 0").selectExpr(
            "document_id", "case when action = 'confirm' then 'reject' else 'confirm' end as action",
            "case when action = 'reject' then concat('PO-', lpad(cast(k as string), 7, '0')) end as po_number",
            "'ap-lead' as actor", "acted_at + interval 1 day as acted_at", "k")
        return first.unionByName(second)

    @cached_property
    def corrections(self) -> DataFrame:
        """Field corrections as (document, field, value) events."""
        inv = self.invoices
        number = inv.filter("k % 37 = 0").selectExpr(
            "document_id", "'invoice_number' as field_name", "concat('FIX-', k) as new_value", "'ap-clerk' as actor_id",
            "timestamp_seconds(1709424000 + k % 5000) as acted_at")
        again = inv.filter("k % 74 = 0").selectExpr(
            "document_id", "'invoice_number' as field_name", "concat('FIX2-', k) as new_value", "'ap-lead' as actor_id",
            "timestamp_seconds(1709524000 + k % 5000) as acted_at")
        total = inv.filter("k % 67 = 0").selectExpr(
            "document_id", "'total_amount' as field_name", "cast(subtotal_cents + tax_cents as string) as new_value",
            "'ap-clerk' as actor_id", "timestamp_seconds(1709424000 + k % 5000) as acted_at")
        lines = inv.filter("k % 67 = 0").selectExpr(
            "document_id", "'line_items' as field_name", "'[]' as new_value", "'ap-clerk' as actor_id",
            "timestamp_seconds(1709424000 + k % 5000) as acted_at")
        return number.unionByName(again).unionByName(total).unionByName(lines)

    @cached_property
    def human_actions(self) -> DataFrame:
        return self.invoices.filter("k % 6 = 0").selectExpr(
            "document_id", "case when k % 12 = 0 then 'APPROVE' else 'COMMENT' end as action_type",
            "case when k % 18 = 0 then 'APPROVAL' else 'noted' end as outcome", "concat('user', k % 9) as actor_id",
            "concat('checked ', k) as detail", "timestamp_seconds(1709424000 + k % 5000) as acted_at")

    @cached_property
    def import_rows(self) -> DataFrame:
        """A flat import file: vendors, orders, order lines, receipts and transactions under alias headers."""
        cols = ("record_type", "supplier_name", "supplier_code", "tax_id", "po_no", "po_total", "po_status", "line_no",
                "qty", "price", "inv_number", "inv_total", "inv_date", "grn", "remarks")

        def row(kind: str, **exprs) -> str:
            values = ", ".join(f"'{c}', cast({exprs.get(c, 'null')} as string)" for c in cols)
            return f"named_struct('row_id', concat('{kind}', lpad(cast(rid as string), 10, '0')), {values})"

        def shape(df: DataFrame, *rows: str) -> DataFrame:
            """The rows that each row of `df` gives, without those that are null."""
            return df.select("company_id", F.explode(F.array_compact(F.array(*map(F.expr, rows)))).alias("r")).select("company_id", "r.*")

        v = self.vendors.selectExpr("s as rid", "*")
        p = self.pos.selectExpr("k as rid", "*")
        # the lines once for both of their kinds: numbering and joining them costs more than all other rows
        ln = self.po_lines.join(self.pos.select("po_number", "company_id"), "po_number").selectExpr("k * 100 + line_number as rid", "*")
        iv = self.invoices.selectExpr("k as rid", "*")
        vendor = shape(v, row("A", record_type="case when s % 2 = 0 then 'vendor' end", supplier_name="name",
                              supplier_code="case when s % 5 = 0 then supplier_code end", tax_id="tax_id",
                              remarks="concat('r', s)"))
        po = shape(p, row("B", record_type="case when k % 3 = 0 then 'purchase_order' end", supplier_name="vendor_name",
                          po_no="case when k % 11 = 0 then 'N/A' when k % 23 = 0 then po_number || ' ' "
                                "when k % 46 = 1 then 'PO-0000001' else po_number end",
                          po_total="case when k % 97 = 0 then 'abc' else cast(total_amount as string) end", po_status="status"))
        line = row("C", po_no="case when k % 30 = 0 then 'PO-MISSING' else po_number end",
                   line_no="case when k % 33 = 0 then 0 else line_number end", qty="quantity", price="unit_price")
        inv = shape(iv, row("D", record_type="case when k % 2 = 0 then 'invoice' end",
                            supplier_name="case when k % 49 = 0 then null else vendor_name end", po_no="po_value",
                            inv_number="invoice_number", inv_total="total_cents", inv_date="invoice_date"))
        grn = row("E", grn="concat('GRN-', k)", po_no="case when k % 21 = 0 then null else po_number end")
        lines = shape(ln, line, f"case when k % 5 <> 0 and (k + line_number) % 3 <> 0 then {grn} end")
        return vendor.unionByName(po).unionByName(lines).unionByName(inv)
