"""Purchase-order candidates per invoice.

Every strategy yields (company_id, document_id, po_number, method, confidence, strategy, seq): `strategy` is the
retrieval order, `seq` the order inside it.  A strategy returns all hits, or with k the first k of each lookup key; only
`discover` asks for a cut, because at most `max_candidates` survive per invoice there.  All hits of one lookup
key share a confidence, so an order beyond the lead of its key can never rank among the invoice's survivors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paymatch.functions.expr import true
from paymatch.functions.fields import confidence_gate, po_presence, suggestion_mode
from paymatch.functions.similarity import sequence_ratio
from paymatch.functions.text import po_key, po_key_loose, vendor_key
from paymatch.operators.similar import containment_pairs, deletion_pairs, overlap_pairs, tagged
from paymatch.operators.vendors import resolve_vendor
from paymatch.plans.runtime import stage
from paymatch.policy import MATCH, MatchPolicy

OUT = ("company_id", "document_id", "po_number", "method", "confidence", "strategy", "seq")


def lead(df: DataFrame, keys: list[str], order: list, k: int | None) -> DataFrame:
    """First k rows per key (None: all), numbered.  Spark limits each partition before the shuffle, so hot keys stay cheap."""
    ranked = df.withColumn("seq", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col("seq") <= k)


def source_record_orders(records: DataFrame) -> DataFrame:
    """J15.  An imported transaction with a total acts as an open blanket order."""
    return records.filter("invoice_total > 0").select(
        "company_id", F.coalesce("po_reference", F.concat(F.lit("IMP-"), "source_record_id")).alias("po_number"),
        F.lit("").alias("vendor_id"), F.coalesce("vendor_name", F.lit("")).alias("vendor_name"),
        F.col("invoice_total").alias("total_amount"), F.coalesce("currency", F.lit("USD")).alias("currency"),
        F.lit("open").alias("status"), F.lit("blanket").alias("po_type"), F.col("invoice_date").alias("issue_date"),
        F.lit(0).cast("bigint").alias("previously_invoiced"), F.lit(True).alias("import_derived"),
        "invoice_number", "source_record_id", "created_at", vendor_key("vendor_name").alias("vkey"))


def tenant_flags(pos: DataFrame, records: DataFrame) -> DataFrame:
    """Per company: has it imported anything, and are any of its open orders imported?"""
    imported = F.col("import_derived") | F.startswith(F.upper("po_number"), F.lit("IMP-"))
    a = pos.groupBy("company_id").agg(F.bool_or(imported).alias("u"),
                                      F.bool_or(imported & (F.col("status") == "open")).alias("open_import"))
    b = records.groupBy("company_id").agg(F.lit(True).alias("r"))
    return a.join(b, "company_id", "full").select(
        "company_id", (true(F.col("u")) | true(F.col("r"))).alias("has_import"), true(F.col("open_import")).alias("open_import"))


def hide_seed_orders(hits: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """J14.  Once a company imported data, a result list that holds imported orders shows only those."""
    any_import = hits.groupBy(*keys).agg(F.bool_or("import_derived").alias("_any"))
    return hits.join(any_import, keys).join(flags.select("company_id", "has_import"), "company_id", "left").filter(
        ~(true(F.col("has_import")) & F.col("_any")) | F.col("import_derived")).drop("_any", "has_import")


def lead_visible(df: DataFrame, flags: DataFrame, keys: list[str], order: list, k: int | None) -> DataFrame:
    """`lead` after J14: imported orders go first, and push the others out where the company imported data."""
    x = df.join(flags.select("company_id", "has_import"), "company_id", "left").withColumn(
        "_imp", true(F.col("has_import")) & F.col("import_derived"))
    top = lead(x, keys, [F.col("_imp").desc(), *order], k)
    return only_imported(top, keys).drop("has_import")


def only_imported(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the `_imp` rows of every list that has any."""
    any_import = F.max("_imp").over(W.partitionBy(*keys))
    return lists.withColumn("_any", any_import).filter(~F.col("_any") | F.col("_imp")).drop("_any", "_imp")


def _emit(df: DataFrame, method, confidence, strategy: int) -> DataFrame:
    m = F.lit(method) if isinstance(method, str) else method
    c = F.lit(float(confidence)) if not isinstance(confidence, Column) else confidence
    return df.select("company_id", "document_id", "po_number", m.alias("method"), c.alias("confidence"),
                     F.lit(strategy).alias("strategy"), F.col("seq").cast("bigint").alias("seq"))


def by_source_invoice(inv: DataFrame, records: DataFrame, k: int | None = None) -> DataFrame:
    """J5.  Imported transactions with the same number and a vendor key containing, or contained in, the printed one: all, or
    the first k of an invoice."""
    so = source_record_orders(records).filter("invoice_number is not null")
    top = stage(lead(so.groupBy("company_id", "invoice_number", "vkey", "po_number").agg(F.min("source_record_id").alias("sid")),
                     ["company_id", "invoice_number", "vkey"], ["sid"], k))
    x = inv.filter("invoice_number is not null and vendor_name <> ''").select(
        "company_id", "document_id", "invoice_number", vendor_key("vendor_name").alias("ikey"))
    on = ["company_id", "invoice_number"]
    pairs = containment_pairs(x, top, on, "ikey", "vkey")
    hits = pairs.join(top, [*on, "vkey"])
    best = hits.groupBy(*on, "ikey", "po_number").agg(F.min("sid").alias("sid"))
    best = lead(best, [*on, "ikey"], ["sid"], k)
    return _emit(x.join(best, [*on, "ikey"]), "source_record_invoice", 0.88, 1)


def by_reference(inv: DataFrame, references: DataFrame, pos: DataFrame, k: int | None = None) -> DataFrame:
    """J6.  `inv` carries `refs` ARRAY<STRUCT<type, value>> in lookup order.  All orders, or the first k of each reference."""
    r = references.select("company_id", "po_number", F.col("reference_type").alias("rt"), po_key("reference_value").alias("rv"))
    r = r.join(pos.select("company_id", "po_number"), ["company_id", "po_number"], "left_semi").distinct()
    top = lead(r, ["company_id", "rt", "rv"], ["po_number"], k).withColumnRenamed("seq", "rn")
    x = inv.select("company_id", "document_id", F.posexplode("refs").alias("i", "ref")).select(
        "company_id", "document_id", "i", F.col("ref.type").alias("rt"), po_key(F.col("ref.value")).alias("rv"))
    hits = x.join(top, ["company_id", "rt", "rv"]).groupBy("company_id", "document_id", "po_number").agg(
        F.min(F.col("i").cast("long") * 2**32 + F.col("rn")).alias("seq"))
    return _emit(hits, "reference", 0.9, 2)


def by_number(inv: DataFrame, pos: DataFrame, flags: DataFrame, k: int | None = None) -> DataFrame:
    """J7 and J8.  Stored number, else dash- and space-insensitive (any status); only then B4 among open orders.  All orders,
    or the first k of each number."""
    x = inv.filter("po_value <> ''").select("company_id", "document_id", "po_value")
    p = pos.select("company_id", "po_number", "status", "import_derived")

    def probe(left: DataFrame, right: DataFrame, lkey: Column, rkey: Column) -> DataFrame:
        top = lead_visible(right.withColumn("_k", rkey), flags, ["company_id", "_k"], ["po_number"], k)
        return left.withColumn("_k", lkey).join(top, ["company_id", "_k"]).drop("_k")

    exact = stage(probe(x, p, F.col("po_value"), F.col("po_number")))
    # the looser key contains the equal numbers too: only invoices without an equal number may use it
    known = p.select("company_id", F.col("po_number").alias("po_value"))
    rest = stage(x.join(known, ["company_id", "po_value"], "left_anti"))
    loose = stage(probe(rest, p, po_key_loose("po_value"), po_key_loose("po_number")))
    hit = exact.unionByName(loose)
    misses = rest.join(loose.select("document_id"), "document_id", "left_anti")
    normal = stage(probe(misses, p.filter("status = 'open'"), po_key("po_value"), po_key("po_number")))
    return _emit(hit, "exact", 1.0, 3).unionByName(_emit(normal, "normalized", 0.85, 4))


def vendor_order_lists(pos: DataFrame, vendors: DataFrame, flags: DataFrame, k: int | None):
    """Leading open orders per vendor id, and per vendor name key (own header name first, then the master name)."""
    m = vendors.select("company_id", "vendor_id", vendor_key("normalized_name").alias("mkey"))
    p = pos.filter("status = 'open'").select(
        "company_id", "po_number", "vendor_id", "vendor_name", "import_derived",
        F.when(F.col("import_derived"), "import_derived").alias("imp"))
    by_id = lead_visible(p, flags, ["company_id", "vendor_id"], ["po_number"], k).drop("vendor_name", "_imp")
    visible = p.join(flags, "company_id", "left").filter(
        ~(true(F.col("has_import")) & true(F.col("open_import"))) | F.col("import_derived"))
    named = visible.withColumn("key", vendor_key("vendor_name")).join(m, ["company_id", "vendor_id"], "left")
    own = named.filter("vendor_name <> ''").select("company_id", "po_number", "imp", "import_derived", "key", F.lit(0.70).alias("conf"))
    master = named.filter("mkey is not null and (mkey <> key or vendor_name = '')").select(
        "company_id", "po_number", "imp", "import_derived", F.col("mkey").alias("key"), F.lit(0.65).alias("conf"))
    # the id list may already hold up to k of these, hence the deeper lead
    by_name = lead(own.unionByName(master), ["company_id", "key"], [F.col("conf").desc(), "po_number"], k and 2 * k)
    return by_id, by_name


def claims(pos: DataFrame, vendors: DataFrame, flags: DataFrame) -> DataFrame:
    """Open orders with what finds them: the vendor id where the id list shows them, the own and master name keys where the
    name list does."""
    m = vendors.select("company_id", "vendor_id", vendor_key("normalized_name").alias("mkey"))
    p = pos.filter("status = 'open'").join(flags, "company_id", "left").join(m, ["company_id", "vendor_id"], "left")
    any_import = p.groupBy("company_id", "vendor_id").agg(F.bool_or("import_derived").alias("_any"))
    p = p.join(any_import, ["company_id", "vendor_id"], "left")
    in_ids = ~(true(F.col("has_import")) & true(F.col("_any"))) | F.col("import_derived")
    in_names = ~(true(F.col("has_import")) & true(F.col("open_import"))) | F.col("import_derived")
    own = F.when(F.col("vendor_name") != "", vendor_key("vendor_name"))
    return p.select("company_id", "po_number", "import_derived", (F.col("total_amount") - F.col("previously_invoiced")).alias("remaining"),
                    F.when(in_ids, F.col("vendor_id")).alias("vid"), F.when(in_names, own).alias("own"),
                    F.when(in_names & F.col("mkey").isNotNull(), F.col("mkey")).alias("master"))


_CLAIM = ("vid", "own", "master")


def record_orders(records: DataFrame, pos: DataFrame, vendors: DataFrame, flags: DataFrame) -> DataFrame:
    """Distinct orders of imported transactions per vendor key, newest record first (`at`), with what claims their number."""
    so = source_record_orders(records)
    newest = F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), F.col("source_record_id").alias("sid"))
    so = so.groupBy("company_id", "vkey", "po_number").agg(F.min(newest).alias("at"), F.min_by("total_amount", newest).alias("remaining"))
    return so.join(claims(pos, vendors, flags).select("company_id", "po_number", *_CLAIM), ["company_id", "po_number"], "left")


def record_lists(records: DataFrame, pos: DataFrame, vendors: DataFrame, flags: DataFrame, k: int) -> DataFrame:
    """The first k of those orders for each vendor key and claim: whatever claims a name rules out, the rest holds its first k."""
    return lead(record_orders(records, pos, vendors, flags), ["company_id", "vkey", *_CLAIM], ["at"], k).drop("seq")


def ids_or_none(names: DataFrame, resolved: DataFrame) -> DataFrame:
    return names.join(resolved.select("company_id", "vendor_name", "vendor_id"), ["company_id", "vendor_name"], "left")


def unclaimed() -> Column:
    """Whether an order's number is found neither by the name's vendor id nor by its key."""
    by_id = F.col("vid").isNotNull() & (F.col("vendor_id") != "") & (F.col("vid") == F.col("vendor_id"))
    return ~(true(by_id) | true(F.col("own") == F.col("key")) | true(F.col("master") == F.col("key")))


def record_hits(names: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders whose vendor key contains, or is contained in, a name's, unless the order lists hold them already."""
    keys = names.select("company_id", "key").distinct()
    vkeys = orders.select("company_id", "vkey").distinct()
    pairs = stage(containment_pairs(keys, vkeys, ["company_id"], "key", "vkey"))
    return names.join(pairs, ["company_id", "key"]).join(orders, ["company_id", "vkey"]).filter(unclaimed())


def vendor_lists(inv: DataFrame, resolved: DataFrame, pos: DataFrame, vendors: DataFrame, records: DataFrame,
                 flags: DataFrame, k: int | None = None) -> DataFrame:
    """J9 per distinct printed name: open orders by vendor id, by name, and imported transactions by name containment.

    All orders, or the first k by confidence.  Record orders are made distinct, and those that the uncut id or name list
    holds are taken out, before anything is cut.
    """
    by_id, by_name = vendor_order_lists(pos, vendors, flags, k)
    names = stage(inv.filter("vendor_name <> ''").select("company_id", "vendor_name").distinct().withColumn(
        "key", vendor_key("vendor_name")))
    ids = names.join(resolved.select("company_id", "vendor_name", "vendor_id"), ["company_id", "vendor_name"])
    on = ["company_id", "vendor_name"]
    a = ids.join(by_id, ["company_id", "vendor_id"]).select(
        *on, "po_number", "import_derived", F.coalesce("imp", F.lit("vendor_search")).alias("method"),
        F.lit(0.75).alias("conf"), F.lit(1).alias("tier"), "seq")
    b = names.join(by_name, ["company_id", "key"]).select(
        *on, "po_number", "import_derived", F.coalesce("imp", F.lit("vendor_name")).alias("method"),
        "conf", F.lit(2).alias("tier"), "seq")
    s = record_hits(ids_or_none(names, resolved), stage(record_lists(records, pos, vendors, flags, k)))
    s = s.groupBy(*on, "po_number").agg(F.min("at").alias("at"))
    c = lead(s, on, ["at"], k).select(
        *on, "po_number", F.lit(True).alias("import_derived"), F.lit("source_record").alias("method"),
        F.lit(0.72).alias("conf"), F.lit(3).alias("tier"), "seq")
    hits = stage(a.unionByName(b).unionByName(stage(c))).join(flags.select("company_id", "has_import"), "company_id", "left")
    hits = only_imported(hits.withColumn("_imp", true(F.col("has_import")) & F.col("import_derived")), on)
    first = hits.groupBy(*on, "po_number").agg(F.min(F.struct("tier", "seq", "method", "conf")).alias("h")).select(
        *on, "po_number", "h.*")
    # higher confidences come first in the end; keep enough of them per name
    return lead(first.withColumnRenamed("seq", "pos"), on, [F.col("conf").desc(), "tier", "pos"], k)


def by_vendor(inv: DataFrame, resolved: DataFrame, pos: DataFrame, vendors: DataFrame, records: DataFrame,
              flags: DataFrame, k: int | None = None) -> DataFrame:
    """J9.  The vendor's orders (`vendor_lists`) joined to the invoices."""
    on = ["company_id", "vendor_name"]
    top = vendor_lists(inv, resolved, pos, vendors, records, flags, k)
    return _emit(inv.select("company_id", "document_id", "vendor_name").join(top, on), F.col("method"), F.col("conf"), 5)


def by_fuzzy_number(inv: DataFrame, pos: DataFrame, flags: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    """J11.  The five most similar open order numbers with ratio >= .6, per distinct printed number.

    Tiers of falling similarity: a number that already has five hits at or above a tier's floor is settled,
    since every pair not found yet is less similar.  Only the rest goes on to the next, wider tier.  The last tier
    finds all pairs a hit may have, so it settles every number; those with a partner too long for deletion variants
    (`MAX_VARIANTS`, some 15 characters) are searched by their characters.
    """
    open_ = pos.filter("status = 'open'").join(flags, "company_id", "left").filter(
        ~(true(F.col("has_import")) & true(F.col("open_import"))) | F.col("import_derived"))
    stock = stage(open_.select("company_id", "po_number", po_key("po_number").alias("rk")).filter("rk <> ''"))
    want = stage(inv.filter("po_value <> ''").select("company_id", po_key("po_value").alias("lk")).filter("lk <> ''").distinct())
    k = policy.fuzzy_top

    def rank(pairs: DataFrame, floor: float) -> DataFrame:
        scored = pairs.withColumn("ratio", sequence_ratio("lk", "rk")).filter(F.col("ratio") >= floor)
        return lead(scored.join(lead(stock, ["company_id", "rk"], ["po_number"], k).drop("seq"), ["company_id", "rk"]),
                    ["company_id", "lk"], [F.col("ratio").desc(), "po_number"], k)

    settled, todo = [], want
    for floor in (0.88, 0.75, policy.fuzzy_min_ratio):
        pairs, skipped = deletion_pairs(todo, stock, ["company_id"], "lk", "rk", floor)
        ranked = stage(rank(pairs, floor))
        if floor > policy.fuzzy_min_ratio:
            done = ranked.groupBy("company_id", "lk").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("company_id", "lk")
        else:
            done = todo
        done = done.join(skipped, ["company_id", "lk"], "left_anti")
        settled.append(ranked.join(done, ["company_id", "lk"], "left_semi"))
        todo = stage(todo.join(done, ["company_id", "lk"], "left_anti"))
        if todo.isEmpty():
            break
    else:
        half = policy.fuzzy_min_ratio / 2.0
        chars = lambda s: tagged(F.filter(F.split(s, ""), lambda c: c != ""))
        wide = overlap_pairs(
            todo, stock, ["company_id"], "lk", "rk", chars, lambda n, s: F.ceil((n + s) * half).cast("int"),
            lambda n: F.greatest(F.ceil(n * (half / (1 - half))).cast("int"), F.lit(1)),
            lambda n: F.floor(n * ((1 - half) / half)).cast("int"))
        settled.append(rank(wide, policy.fuzzy_min_ratio))
    best = reduce(DataFrame.unionByName, settled).select("company_id", "lk", "po_number", "ratio", "seq")
    x = inv.filter("po_value <> ''").select("company_id", "document_id", po_key("po_value").alias("lk"))
    return _emit(x.join(best, ["company_id", "lk"]), "fuzzy", F.col("ratio"), 7)


def by_broadcast(inv: DataFrame, pos: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    """J12.  Policy-gated fallback: the company's first open orders."""
    top = lead(pos.filter("status = 'open'").select("company_id", "po_number"), ["company_id"], ["po_number"], policy.max_candidates)
    return _emit(inv.select("company_id", "document_id").join(top, "company_id"), "broadcast", 0.1, 8)


# --- J10: vendor and amount -----------------------------------------------------------------------
def _digit_nodes(amount: Column, upper: bool, levels: int) -> Column:
    """Tree nodes that tile [amount, top) or [0, amount): at every level the siblings beyond the own digit.

    The tree has base-4 digits up to `levels` and one root above them; an amount beyond the root has all balances below it.
    """
    nodes = []
    for level in range(levels):
        digit = F.shiftright(amount, 2 * level).bitwiseAND(F.lit(3))
        parent = F.shiftright(amount, 2 * level + 2) if level < 31 else F.lit(0).cast("long")
        for d in (1, 2, 3) if upper else (0, 1, 2):
            cond = digit < d if upper else digit > d
            nodes.append(F.when(cond, F.struct(F.lit(level).alias("level"), (parent * 4 + d).alias("node"))))
    if upper:
        nodes.append(F.struct(F.lit(0).alias("level"), amount.alias("node")))
    elif levels < 32:
        nodes.append(F.when(F.shiftright(amount, 2 * levels) > 0, F.struct(F.lit(levels).alias("level"), F.lit(0).cast("long").alias("node"))))
    return F.array_compact(F.array(*nodes))


def _vendor_stock(records: DataFrame, pos: DataFrame, vendors: DataFrame, flags: DataFrame) -> DataFrame:
    """Open balances under every key that finds them (vk), with the order of the lists: tier, then `at`."""
    claim = lambda kind, c: F.when(F.col(c).isNotNull() & (F.col(c) != "" if c == "vid" else F.lit(True)), F.struct(F.concat(F.lit(kind), F.col(c)).alias("vk"), F.lit(1 if c == "vid" else 2).alias("tier")))
    master = F.when(~true(F.col("own") == F.col("master")), F.col("master"))
    p = claims(pos, vendors, flags).filter("remaining > 0").withColumn("master", master)
    p = p.select("company_id", "po_number", "import_derived", "remaining", F.lit(0).cast("long").alias("age"), F.col("po_number").alias("sid"),
                 F.explode(F.array_compact(F.array(claim("id:", "vid"), claim("nm:", "own"), claim("nm:", "master")))).alias("x"))
    r = record_orders(records, pos, vendors, flags).filter("remaining > 0").select(
        "company_id", "po_number", F.lit(True).alias("import_derived"), "remaining", "at.age", "at.sid", F.struct(_record_key().alias("vk"), F.lit(3).alias("tier")).alias("x"))
    return p.unionByName(r).select("company_id", "x.vk", "x.tier", F.col("import_derived").alias("imp"), "po_number", "remaining", "age", "sid")


def _record_key() -> Column:
    return F.concat_ws("\u0001", F.lit("rec"), "vkey", *(F.coalesce(c, F.lit("\u0002")) for c in _CLAIM))


def by_vendor_amount(inv: DataFrame, resolved: DataFrame, pos: DataFrame, vendors: DataFrame, records: DataFrame, flags: DataFrame,
                     policy: MatchPolicy = MATCH) -> DataFrame:
    """J10.  The ten best open orders of the vendor whose remaining balance covers the total, within 15 %.

    The orders are those of the vendor strategy, all of them: by id, by own and master name, and imported transactions by
    name containment that the others do not claim; where the company imported data and the list holds imported orders, only
    those.  Orders hang in a radix tree over their remaining cents, per key that finds them; every node keeps its first ten
    orders in list order and its ten largest balances.  An invoice reads the few dozen nodes that tile its amount
    range, so the work per invoice does not depend on how many orders a vendor has.
    """
    k = policy.vendor_amount_top
    stock = stage(_vendor_stock(records, pos, vendors, flags))
    # as many levels as the largest balance has digits, and a root
    levels = min(32, max(1, (int(stock.agg(F.max("remaining")).first()[0] or 0).bit_length() + 1) // 2))
    node = stock.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(min(levels, 31))))).withColumn(
        "node", F.call_function("shiftright", F.col("remaining"), (F.col("level") * 2).cast("int")))
    nk = ["company_id", "vk", "imp", "level", "node"]
    first = lead(node, nk, ["tier", "age", "sid", "po_number"], k).drop("seq")
    largest = lead(node, nk, [F.col("remaining").desc(), "age", "sid", "po_number"], k).drop("seq")

    x = inv.filter(suggestion_mode()).filter("total_cents is not null and vendor_name <> ''")
    on = ["company_id", "vendor_name"]
    names = ids_or_none(x.select(*on).distinct().withColumn("key", vendor_key("vendor_name")), resolved)
    keys = names.select(*on, F.explode(F.array_compact(F.array(
        F.when(F.col("vendor_id").isNotNull() & (F.col("vendor_id") != ""), F.concat(F.lit("id:"), "vendor_id")), F.concat(F.lit("nm:"), "key")))).alias("vk"))
    # claims of records without an amount left still rule them out, hence all records here
    groups = record_orders(records, pos, vendors, flags).select("company_id", "vkey", *_CLAIM, _record_key().alias("vk")).distinct()
    keys = stage(keys.unionByName(record_hits(names, groups).select(*on, "vk")))
    # J14 looks at the whole list, whatever the balances
    every = claims(pos, vendors, flags).filter("import_derived").select("company_id", F.explode(F.array_compact(F.array(
        F.when(F.col("vid") != "", F.concat(F.lit("id:"), "vid")), F.concat(F.lit("nm:"), "own"), F.concat(F.lit("nm:"), "master")))).alias("vk")).distinct()
    imported = keys.join(every, ["company_id", "vk"], "left_semi").select(*on).union(keys.filter(F.startswith("vk", F.lit("rec"))).select(*on)).distinct()
    hide = imported.join(flags.filter("has_import").select("company_id"), "company_id", "left_semi").withColumn("hide", F.lit(True))
    keys = keys.join(hide, on, "left").withColumn("imp", F.explode(F.when(F.col("hide"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False))))).drop("hide")

    t = F.greatest(F.col("total_cents"), F.lit(0))
    x = x.select(*on, "document_id", "total_cents", t.alias("t")).join(keys, on)
    fits = x.withColumn("n", F.explode(_digit_nodes(F.col("t"), True, levels))).select("*", "n.level", "n.node").drop("n").join(first, nk)
    over = x.withColumn("n", F.explode(_digit_nodes(F.col("t"), False, levels))).select("*", "n.level", "n.node").drop("n").join(largest, nk)
    excess = (F.col("total_cents") - F.col("remaining")) / F.col("remaining")
    over = over.filter(F.col("total_cents") <= F.col("remaining") * (1 + policy.vendor_amount_tolerance))
    cols = ["company_id", "document_id", "total_cents", "po_number"]
    order = F.struct("tier", "age", "sid", "remaining", "confidence")
    hits = fits.withColumn("confidence", F.lit(0.85)).unionByName(
        over.withColumn("confidence", F.greatest(F.lit(0.3), F.lit(0.85) - excess * 2)))
    hits = hits.groupBy(*cols).agg(F.min(order).alias("h")).select(*cols, "h.*")
    top = lead(hits, ["company_id", "document_id"], [F.col("confidence").desc(), "tier", "age", "sid", "po_number"], k)
    n = F.count(F.lit(1)).over(W.partitionBy("company_id", "document_id"))
    tight = F.abs(F.col("total_cents") - F.col("remaining")) <= F.col("remaining") * policy.unique_tolerance
    unique = (n == 1) & tight
    top = top.withColumn("u", unique)
    return _emit(top, F.when(F.col("u"), "unique_vendor_amount").otherwise(F.lit("vendor_amount")),
                 F.when(F.col("u"), F.lit(0.95)).otherwise(F.col("confidence")), 6)


def discover(inv: DataFrame, resolved: DataFrame, pos: DataFrame, vendors: DataFrame, references: DataFrame,
             records: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    """J13.  Union in retrieval order; the first method per order wins; best twenty by confidence.

    The vendor-amount strategy searches the same orders as the vendor strategy, which has already claimed them,
    so it cannot add to the union and is left out here.
    """
    k = policy.max_candidates
    flags = stage(tenant_flags(pos, records))
    # every strategy is written on its own: planned as one query they took the driver more memory than the tasks' results
    lookups = reduce(DataFrame.unionByName, [
        stage(by_source_invoice(inv, records, k)), stage(by_reference(inv, references, pos, k)), by_number(inv, pos, flags, k)])
    # a trusted printed number that is not in the master must not fall back to the vendor's other orders
    trusted = ~suggestion_mode() & (po_presence() == "po_invoice")
    found = lookups.filter(F.col("method").isin("exact", "normalized", "reference")).select("document_id").distinct()
    barred = inv.filter(trusted).select("document_id").join(found, "document_id", "left_anti")
    open_inv = stage(inv.join(barred, "document_id", "left_anti"))
    union = lookups.unionByName(stage(by_vendor(open_inv, resolved, pos, vendors, records, flags, k)))
    expand = (confidence_gate() == "expand") | (suggestion_mode() & (po_presence() == "non_po"))
    if policy.similarity != "tokens":
        rest = inv.filter(expand & (F.col("po_value") != "")).join(union.select("document_id"), "document_id", "left_anti")
        union = union.unionByName(by_fuzzy_number(rest, pos, flags, policy))
    if policy.allow_broadcast:
        rest = inv.filter(expand).join(union.select("document_id"), "document_id", "left_anti")
        union = union.unionByName(by_broadcast(rest, pos, policy))
    key = ["company_id", "document_id"]
    first = union.groupBy(*key, "po_number").agg(F.min(F.struct("strategy", "seq", "method", "confidence")).alias("h")).select(
        *key, "po_number", "h.*")
    return first.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(
        F.col("confidence").desc(), "strategy", "seq", "po_number"))).filter(F.col("rank") <= policy.max_candidates)


def candidate_orders(pos: DataFrame, records: DataFrame) -> DataFrame:
    """Order attributes for candidates: the master, and imported transactions that have no master row."""
    cols = ["company_id", "po_number", "vendor_id", "vendor_name", "total_amount", "previously_invoiced", "currency",
            "status", "po_type", "issue_date", "expiry_date", "import_derived"]
    so = source_record_orders(records).withColumn("expiry_date", F.lit(None).cast("date"))
    so = so.groupBy("company_id", "po_number").agg(F.min(F.struct("source_record_id", *cols[2:])).alias("o")).select(
        "company_id", "po_number", *[f"o.{c}" for c in cols[2:]])
    so = so.join(pos.select("company_id", "po_number"), ["company_id", "po_number"], "left_anti")
    return pos.select(*cols).unionByName(so.select(*cols))


def vendor_names(inv: DataFrame) -> DataFrame:
    return inv.select("company_id", "vendor_name")


def resolve_for(inv: DataFrame, vendors: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    return resolve_vendor(vendor_names(inv), vendors, policy)


